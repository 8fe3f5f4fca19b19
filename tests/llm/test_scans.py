import random
from functools import lru_cache

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from fixweave.llm.lexicon import Trie
from fixweave.llm.scans import Cleaner, Statistics, _count_words, clean_scans

SENTENCES = [
    "The tower reported heavy traffic near the northern runway before noon.",
    "Pilots should contact the approach controller and maintain 4500 until established.",
    "Circling is prohibited between sunset and sunrise without clearance.",
    "The localizer minimums published on this procedure apply to all categories.",
    "Climb to 3200 direct EVVIS and hold, continue climb-in-hold to 3200.",
    "Obstruction lighting on the communications tower is temporarily unserviceable.",
]


def distance(a, b):
    @lru_cache(None)
    def d(i, j):
        if not i or not j:
            return i + j
        return min(d(i - 1, j) + 1, d(i, j - 1) + 1, d(i - 1, j - 1) + (a[i - 1] != b[j - 1]))

    return d(len(a), len(b))


@settings(max_examples=100, deadline=None)
@given(st.sets(st.text("abc", min_size=1, max_size=6), min_size=1, max_size=25), st.text("abc", max_size=6), st.integers(0, 3))
def test_trie_is_complete(words, word, most):
    found = Trie({w: 1 for w in words}).within(word, most)
    assert found == {w: distance(w, word) for w in words if distance(w, word) <= most}


def wrap(text, width):
    lines, line = [], ""
    for w in text.split():
        if len(line) + len(w) > width:
            lines.append(line.strip())
            line = ""
        line += f" {w}"
    return [*lines, line.strip()]


def corpus(n=400, seed=2):
    r = random.Random(seed)
    texts = []
    for _ in range(n):
        lines = wrap(" ".join(r.sample(SENTENCES, 4)), r.randint(38, 70))
        if r.random() < 0.3:
            lines.insert(r.randrange(1, len(lines)), r.choice(["CHART SUPPLEMENT VOL 3", f"- {r.randint(10, 400)} -", f"Page {r.randint(10, 400)} of 500"]))
        texts.append("\n".join(lines))
    return texts


@pytest.fixture(scope="module")
def cleaner():
    counters = {}
    texts = corpus()
    for t in texts:
        _count_words(t, counters)
    stats = Statistics(counters["word"], sum(counters["word"].values()))
    more = {}
    for t in texts:
        stats.count(t, more)
    stats.pairs, stats.begins, stats.ends, stats.alone = (more[k] for k in ("pair", "begin", "end", "alone"))
    return Cleaner(stats)


def test_clean_text_stays(cleaner):
    for s in SENTENCES:
        assert cleaner.clean(s) == (s, set())
    text = "\n".join(wrap(" ".join(SENTENCES), 45))
    assert cleaner.clean(text) == (" ".join(SENTENCES), set())
    assert cleaner.clean(SENTENCES[0] + "\n\n" + SENTENCES[1]) == (SENTENCES[0] + "\n\n" + SENTENCES[1], set())


@pytest.mark.parametrize("mark", ["-", "¬", "­", "‐", " -", "- "])
def test_hyphenation(cleaner, mark):
    assert cleaner.clean(f"Circling is prohi{mark}\r\nbited between sunset and sunrise.") == ("Circling is prohibited between sunset and sunrise.", {"hyphenation"})


def test_compound_at_its_own_hyphen(cleaner):
    assert cleaner.clean("and hold, continue climb-\nin-hold to 3200.") == ("and hold, continue climb-in-hold to 3200.", set())


@pytest.mark.parametrize("bad, good", [("tbe tower reported", "the tower reported"), ("sunset arid sunrise", "sunset and sunrise"), ("Pilots sh0uld contact", "Pilots should contact"), ("maintain 45O0 until", "maintain 4500 until"), ("Climb to BZOo direct", "Climb to 8200 direct"), ("rninimums published", "minimums published")])
def test_misread(cleaner, bad, good):
    assert cleaner.clean(bad) == (good, {"misread"})


def test_names_are_no_misreads(cleaner):
    assert cleaner.clean("Climb to 3200 direct BOSIS and hold,", frozenset(["BOSIS"]))[1] == set()


def test_furniture(cleaner):
    assert cleaner.clean("The tower reported heavy\nCHART SUPPLEMENT VOL 3\ntraffic near the northern\n\n- 17 -\n\nrunway before noon.") == (SENTENCES[0], {"running_header", "page_number"})
    assert cleaner.clean("Climb to\n3200\ndirect EVVIS and hold,") == ("Climb to 3200 direct EVVIS and hold,", set())
    assert cleaner.clean("Circling is prohi-\nPage 12 of 500\nbited between sunset") == ("Circling is prohibited between sunset", {"hyphenation", "page_number"})


def test_table(spark):
    rows = [(i, t, ["EVVIS"], "x") for i, t in enumerate(corpus(200))]
    rows += [(1000, None, None, "x"), (1001, "", None, "x"), (1002, "Circling is prohi-\nbited between sunset and sunrise.", None, "x"), (1002, "Circling is prohi-\nbited between sunset and sunrise.", None, "x"), (None, "\n\n", [None], None)]
    rows += [(1003, " ".join(SENTENCES * 300), None, "x")]
    df = spark.createDataFrame(rows, "id long, t string, names array<string>, noise string")
    got = clean_scans(df, "id", "t", "names").collect()
    assert len(got) == len(rows)
    by = {r.id: r for r in got}
    assert (by[1000].repaired, by[1000].noise, by[1001].noise, by[None].noise) == ("", [], [], [])
    assert by[1002].noise == ["hyphenation"] and by[1003].noise == []
    expected = {i: {k for k, p in (("running_header", "SUPPLEMENT"), ("page_number", "- "), ("page_number", "Page ")) if p in t} for i, t, *_ in rows[:200]}
    assert {i: set(by[i].noise) for i in range(200)} == expected
    assert clean_scans(df.where("false"), "id", "t").count() == 0
