import random

import pytest

from fixweave.llm.scans import Cleaner, Statistics, _count_words, clean_scans, confused

SENTENCES = [
    "The tower reported that the heavy traffic left the northern runway before noon.",
    "Pilots should contact the approach controller and maintain 4500 until established.",
    "Hold as published and climb in the hold to 3200 before turning to the north.",
    "Notes in bold letters apply to all categories and to the circling minimums.",
]
BAD = {"the": "tbe", "and": "arid", "4500": "45O0"}


def misread(text):
    return " ".join(BAD.get(w, w) for w in text.split())


def texts(n=300, seed=3):
    """A third of the rows comes from a feed that misreads half of its sentences."""
    r = random.Random(seed)
    out = []
    for i in range(n):
        s = r.sample(SENTENCES, 3)
        out.append(" ".join(misread(x) if i % 3 == 0 and r.random() < 0.5 else x for x in s))
    return out


@pytest.fixture(scope="module")
def cleaner():
    counters, more = {}, {}
    for t in texts():
        _count_words(t, counters)
    stats = Statistics(counters["word"], sum(counters["word"].values()))
    for t in texts():
        stats.count(t, more)
    stats.pairs, stats.begins, stats.ends, stats.alone = (more[k] for k in ("pair", "begin", "end", "alone"))
    return Cleaner(stats)


def test_misreads_of_a_third_of_the_rows(cleaner):
    for s in SENTENCES[:3]:
        assert cleaner.clean(misread(s)) == (s, {"misread"})


def test_words_of_their_own_stay(cleaner):
    # bold is confusable with the commoner hold, but stands between other words
    for s in SENTENCES:
        assert cleaner.clean(s) == (s, set())


def test_copies_count_once(spark):
    clean = [" ".join(random.Random(i).sample(SENTENCES, 3)) for i in range(60)]
    rows = [(i, f"{t} {i}") for i, t in enumerate(clean)] + [(1000 + i, misread(SENTENCES[0])) for i in range(30)]
    got = {r.id: r for r in clean_scans(spark.createDataFrame(rows, "id long, t string"), "id", "t").collect()}
    assert len(got) == len(rows)
    assert all(got[1000 + i].repaired == SENTENCES[0] and got[1000 + i].noise == ["misread"] for i in range(30))
    assert not any(got[i].noise for i in range(60))


def test_confused():
    assert confused("the", "tbe") and confused("and", "arid") and confused("minimums", "rninirnums") and confused("turn", "tum")
    assert not confused("the", "then") and not confused("north", "south") and confused("via", "via")
