import re

import pytest

from fixweave.llm.encoding import DOUBLE, WRONG, Repair

CLEAN = [
    "Climb heading 090° to 4500, then direct ÅBLER and hold.",
    "Virage à gauche après l’arrêt, cap 270° jusqu’à 5000 pieds.",
    "Giro a la derecha según la señal, rumbo 045° — después ascender.",
    "Größe über 300°, naïve café “note” – 5 µs, ½ mile.",
    "Année suivante : éviter la zone n° 7.",
]
#: Text that is right as it is.
LEGITIMATE = [
    "飞行员应在导航台上空等待 气象报告 GPS进近 跑道09L 左转",
    "滑走路 ﾚｰﾀﾞｰ 誘導 旋回 ILS進入 高度5000フィート",
    "활주로 접근 관제탑 RNAV접근 고도 3000피트",
    "Экипаж сообщил о её заходе на ВПП 09, ещё раз проверьте высоту",
    "Το πλήρωμα ανέφερε την προσέγγιση στον διάδρομο 27, ύψος 3000",
    "Zażółć gęślą jaźń, podejście do pasa 33 według żądania",
    "İniş pisti 05, yükseklik 3000 fit, dönüş sağa şğı",
    "Přistání na dráhu 24, výška 3000 stop, otočte doleva",
    "ﾂ Ć µ ° é Ă",
]


@pytest.fixture(scope="module")
def repair():
    # the words that the corpus knows
    return Repair({re.sub(r"[0-9]+", "9", w): 9 for t in CLEAN for w in t.split() if not w.isascii()})


@pytest.mark.parametrize("codec", WRONG + DOUBLE)
def test_restored_text_equals_the_original(repair, codec):
    made = exact = 0
    for text in CLEAN:
        try:
            garbled = text.encode("utf-8").decode(codec)
        except UnicodeDecodeError:
            continue
        made += 1
        restored, kinds = repair.text(garbled)
        assert kinds, (codec, garbled)
        exact += restored == text
    assert made and exact >= 0.6 * made, (codec, exact, made)


def test_reading_of_the_recorded_degree_sign(repair):
    assert repair.text("heading 090掳 to") == ("heading 090° to", ["multibyte"])
    assert repair.text("cafĂ© and cafц╘ and caf茅") == ("café and café and café", ["multibyte"])


@pytest.mark.parametrize("text", LEGITIMATE)
def test_legitimate_text_stays(text):
    assert Repair({}).text(text) == (text, [])
