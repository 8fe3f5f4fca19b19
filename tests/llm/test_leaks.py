import random

import pytest

from fixweave.llm.leaks import ItemIndex, find_leaks, words

VOCABULARY = [f"w{i}" for i in range(60)] + ["the", "to", "at"] * 5


def brute(items, text, span=8):
    runs = lambda w: {tuple(w[i : i + span]) for i in range(len(w) - span + 1)}
    own = runs(words(text))
    return {i for i, t in items if runs(words(t)) & own}


def texts(seed, n_items=60, n_docs=150):
    r = random.Random(seed)
    items = [(i, " ".join(r.choice(VOCABULARY) for _ in range(r.randint(5, 40)))) for i in range(n_items)]
    docs = []
    for d in range(n_docs):
        w = [r.choice(VOCABULARY) for _ in range(r.randint(0, 120))]
        for _ in range(r.randint(0, 2)):
            source = items[r.randrange(n_items)][1].split()
            k = r.randint(6, 9)
            s = r.randrange(max(1, len(source) - k + 1))
            at = r.randrange(len(w) + 1)
            w[at:at] = source[s : s + k]
        docs.append((1000 + d, r.choice([" ", ", ", "\n"]).join(w).title() if d % 2 else " ".join(w)))
    return items, docs


def test_index_against_brute_force():
    for seed in range(4):
        items, docs = texts(seed)
        index = ItemIndex(items, block=4)
        for _, text in docs:
            assert index.leaked(words(text)) == brute(items, text)


def test_wand_returns_all_above_the_threshold():
    items, docs = texts(9)
    index = ItemIndex(items, block=3)
    for _, text in docs:
        terms = sorted({index.term[w] for w in words(text)[:24] if w in index.term})
        score = {}
        for t in terms:
            for i, s in zip(index.items[t], index.scores[t]):
                score[i] = score.get(i, 0) + s
        assert sorted(index.above(terms)) == sorted(i for i, s in score.items() if s >= 1 - 1e-9)


def test_words():
    assert words("A-b_c 1É!") == ["a", "b", "c", "1é"] and words(None) == []


def test_table(spark):
    items, docs = texts(3)
    rows = docs + [(1, None), (2, ""), (None, items[0][1]), docs[0], (3, "filler " * 50_000 + items[1][1])]
    df = spark.createDataFrame([(*r, 0) for r in rows], "doc_id long, text string, item_id int")
    tests = spark.createDataFrame([*items, (900, None), (901, "too short")], "item_id long, text string")
    got = sorted((tuple(r) for r in find_leaks(df, tests, "doc_id", "item_id").collect()), key=repr)
    assert got == sorted({(i, d) for d, t in rows if t for i in brute(items, t)}, key=repr)
    assert find_leaks(df, tests.where("false"), "doc_id", "item_id").count() == 0
    assert find_leaks(df.where("false"), tests, "doc_id", "item_id").count() == 0


@pytest.mark.parametrize("span", [1, 2, 4, 8, 24, 25, 30, 64])
def test_any_length_of_run(span):
    r = random.Random(span)
    items = [(i, " ".join(r.choice(VOCABULARY) for _ in range(r.randint(max(1, span - 2), 3 * span)))) for i in range(25)]
    index = ItemIndex(items, span, block=3)
    hits = 0
    for _ in range(60):
        w = [r.choice(VOCABULARY) for _ in range(r.randint(0, 5 * span))]
        source = r.choice(items)[1].split()
        k = r.randint(max(1, span - 1), span + 2)
        at = r.randrange(len(w) + 1)
        w[at:at] = source[:k] if r.random() < 0.5 else source[-k:]
        want = brute(items, " ".join(w), span)
        hits += len(want)
        assert index.leaked(w) == want
    assert hits


def test_many_blocks_and_passes(spark):
    items, docs = texts(5)
    df = spark.createDataFrame(docs, "doc_id long, text string")
    tests = spark.createDataFrame(items, "item_id long, text string")
    got = sorted(map(tuple, find_leaks(df, tests, "doc_id", "item_id", chars=700, pass_bytes=10_000).collect()))
    assert got == sorted({(i, d) for d, t in docs for i in brute(items, t)})
