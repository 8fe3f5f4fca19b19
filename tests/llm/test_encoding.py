import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from fixweave.llm.encoding import Codec, Repair, repair_encoding, utf8_spans

KNOWN = {"9°": 500, "Bjørnvik": 90, "–": 90, "“LNAV”": 90, "apply…": 90, "½": 90, "Señal": 90, "·": 60}


def test_automaton_finds_well_formed_spans():
    data = "aé€😀b".encode() + b"\xc3(" + b"\xe0\x80\x80" + b"\xed\xa0\x80" + b"\xc1\xbf"
    starts, ends = utf8_spans(np.frombuffer(data, np.uint8).astype(np.int16))
    assert [data[s:e].decode() for s, e in zip(starts, ends)] == ["é€😀"]


@settings(max_examples=200, deadline=None)
@given(st.binary(max_size=12))
def test_automaton_against_the_decoder(data):
    spans = {i for s, e in zip(*utf8_spans(np.frombuffer(data, np.uint8).astype(np.int16))) for i in range(s, e)}
    for s, e in zip(*utf8_spans(np.frombuffer(data, np.uint8).astype(np.int16))):
        data[s:e].decode("utf-8")
    expected, i = set(), 0
    while i < len(data):
        for n in (4, 3, 2):
            part = data[i : i + n]
            try:
                if len(part) == n and len(part.decode("utf-8")) == 1:
                    expected |= set(range(i, i + n))
                    i += n
                    break
            except UnicodeDecodeError:
                pass
        else:
            i += 1
    assert spans == expected


@pytest.mark.parametrize("codec", ["cp1252", "latin_1", "cp437", "cp850", "mac_roman", "cp1251"])
@pytest.mark.parametrize("text", ["148°", "Bjørnvik", "“LNAV”", "½", "apply…"])
def test_wrong_reading_round_trip(codec, text):
    back = {b: c for c, b in Codec(codec).back.items()}
    garbled = "".join(chr(back.get(b, b)) if b >= 0x80 else chr(b) for b in text.encode())
    assert Repair(KNOWN).text(f"to {garbled} now") == (f"to {text} now", ["multibyte"])


def test_twice_garbled_and_lowered():
    repair = Repair(KNOWN)
    assert repair.word("BjÃƒÂ¸rnvik")[0] == "Bjørnvik"
    assert repair.word("148â°") == ("148°", ("multibyte",))
    assert repair.word("bjã¸rnvik")[0] == "bjørnvik"


def test_single_byte_reading_needs_the_corpus():
    repair = Repair(KNOWN)
    assert repair.word("091¡") == ("091°", ("single_byte",))
    assert repair.word("Bj¯rnvik") == ("Bjørnvik", ("single_byte",))
    assert Repair({}).word("091¡") == ("091¡", ())
    assert Repair({"∞": 50, "9°": 900}).word("∞") == ("∞", ())


def test_utf7_and_lost():
    repair = Repair(KNOWN)
    assert repair.word("Se+APE-al") == ("Señal", ("utf7",))
    assert repair.text("CA 766+ft and +1200 and +120 now")[1] == []
    assert repair.word("31�") == ("31�", ("lost",))


@pytest.mark.parametrize("text", ["Área Â closed; Área Ã open.", "SÃO TELMO", "GARÇÃO", "Заход только днём.", "Σταθμός", "Saint-Éloi – 1′30″", "Ærø ±5%", "“¿viento?”", "¬ shown", "日本語 テキスト", "Ôte à gauche", "naïve café", "−15°C: add 200 ft."])
def test_legitimate_text_stays(text):
    assert Repair(KNOWN).text(text) == (text, [])


def test_table(spark):
    rows = [(1, "heading 148Â° and 9°", "x"), (1, "heading 148Â° and 9°", "x"), (2, None, "x"), (3, "", "x"), (4, "plain", "x"), (None, "lost �", "x"), (5, "Â°" + " 9°" * 100_000, "x")]
    rows += [(10 + i, "climb 9°", "x") for i in range(40)]
    df = spark.createDataFrame(rows, "id long, t string, restored string")
    got = repair_encoding(df, "id", "t").collect()
    assert sorted((r.id, r.complete) for r in got if r.id) == [(1, True), (1, True), (5, True)]
    assert {r.restored for r in got if r.id == 1} == {"heading 148° and 9°"}
    assert [(r.id, r.kinds) for r in got if not r.complete] == [(None, ["lost"])]
    assert repair_encoding(df.where("false"), "id", "t").count() == 0
