from fixweave.llm.encoding import Repair, repair_encoding

#: A third of the rows in Mac Roman read as cp1252.
SKEWED = {"9°": 600, "9¡": 300, "Bjørnvik": 90, "Bj¿rnvik": 45, "Señal": 80, "Se–al": 40, "–": 60, "Ð": 30, "½": 50, "∞": 40, "Île": 50}


def test_frequent_damage_is_found():
    repair = Repair(SKEWED)
    assert repair.text("heading 091¡ to Bj¿rnvik") == ("heading 091° to Bjørnvik", ["single_byte"])
    assert repair.text("heading 091¡") == ("heading 091°", ["single_byte"])
    for text in ("heading 091° to Bjørnvik – ½", "Señal ∞", "Île ½", "– ∞"):
        assert repair.text(text) == (text, [])


def test_one_garbled_word_of_the_corpus_is_not_enough():
    assert Repair({"9°": 600, "9¡": 300}).text("heading 091¡") == ("heading 091¡", [])


def test_words_of_a_record_are_judged_together():
    repair = Repair({"9°": 600, "9¡": 300, "–": 60, "Ð": 30})
    assert repair.common == set()
    assert repair.text("091¡ Ð 100¡") == ("091° – 100°", ["single_byte"])
    assert repair.text("091° – 100°") == ("091° – 100°", [])
    assert repair.text("Ð") == ("Ð", [])


def test_copies_count_once(spark):
    rows = [(i, f"climb on 9° at {'abcdefgh'[i % 8]}{'xyz'[i % 3]}{'kl'[i % 2]} {'mnop'[i // 12]}") for i in range(48)] + [(100 + i, "climb on 091¡ now") for i in range(30)]
    got = repair_encoding(spark.createDataFrame(rows, "id long, t string"), "id", "t").collect()
    assert sorted(r.id for r in got) == [100 + i for i in range(30)]
    assert {r.restored for r in got} == {"climb on 091° now"}
