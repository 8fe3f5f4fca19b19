import os
import random

import pytest
from pyspark.sql import functions as F

from fixweave.llm.mixing import TOKENIZER, Share, count_tokens, mix_sources, water_fill

needs_files = pytest.mark.skipif(not os.path.exists(TOKENIZER), reason="no tokenizer")


def test_water_filling():
    shares = water_fill([Share("a", 0.5, 1, 100), Share("b", 0.3, 4, 1000), Share("c", 0.2, 4, 1000), Share("d", 0.0, 4, 50), Share("e", 0.1, 3, 0)], 1000)
    by = {s.source: s for s in shares}
    assert by["a"].passes == 1 and by["b"].passes == pytest.approx(0.54) and by["c"].passes == pytest.approx(0.36)
    assert by["d"].passes == by["e"].passes == 0
    assert sum(s.weight for s in shares) == pytest.approx(1)


def test_water_filling_when_all_are_clamped_or_empty():
    shares = water_fill([Share("a", 0.5, 1, 10), Share("b", 0.5, 2, 10)], 1000)
    assert [s.passes for s in shares] == [1, 2]
    assert [s.passes for s in water_fill([Share("a", 1.0, 3, 0)])] == [0]
    assert water_fill([]) == []


@needs_files
def test_mix(spark):
    rows = [(i, f"word {i} " * (1 + i % 5), s) for i, s in enumerate([" Big-One"] * 300 + ["big_one"] * 300 + ["small"] * 20 + ["other"] * 50 + [None] * 10)]
    rows += [(1000, None, "small"), (1001, "", "small"), (1002, "long " * 100_000, "other")]
    df = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, source string, copies int")
    targets = spark.createDataFrame([("BIG_ONE", 0.5, 2), ("small", 0.4, 3), ("missing", 0.1, 5), (None, 0.1, 5)], "source string, target_share double, max_repeats int")
    mix = mix_sources(df, targets)
    report = {r.source: r for r in mix.report.collect()}
    docs = mix.documents.collect()
    assert set(report) == {"big_one", "small", "missing"} and {d.source for d in docs} == {"big_one", "small"}
    assert max(d.copies for d in docs if d.source == "small") == 3 and max(d.copies for d in docs) <= 3
    for s in ("big_one", "small"):
        r = report[s]
        longest = max(d.n_tokens for d in docs if d.source == s)
        assert sum(d.n_tokens * d.copies for d in docs if d.source == s) == r.mix_tokens
        assert abs(r.mix_tokens - r.passes * r.available_tokens) <= longest
        assert r.most_copies <= r.max_repeats
    assert sum(r.actual_share for r in report.values()) == pytest.approx(1)
    again = sorted((d.doc_id, d.copies) for d in mix_sources(df.repartition(7), targets).documents.collect())
    assert again == sorted((d.doc_id, d.copies) for d in docs)
    assert mix_sources(df.where("false"), targets).documents.count() == 0


@needs_files
def test_total(spark):
    df = spark.createDataFrame([(i, "a b c d", "abc"[i % 3]) for i in range(3000)], "doc_id long, text string, source string")
    targets = spark.createDataFrame([("a", 0.5, 1), ("b", 0.3, 1), ("c", 0.2, 1)], "source string, target_share double, max_repeats int")
    report = {r.source: r.actual_share for r in mix_sources(df, targets, total=4000).report.collect()}
    assert report == {"a": pytest.approx(0.5, abs=0.002), "b": pytest.approx(0.3, abs=0.002), "c": pytest.approx(0.2, abs=0.002)}


def brute_force(rows, goals, order):
    """Copies per document: whole passes, then documents in order while their middle lies before the cut."""
    shares = water_fill([Share(s, t, c, sum(n for _, source, n in rows if source == s)) for s, t, c in sorted(goals)])
    out = {}
    for share in shares:
        own = sorted((order[k], k, n) for k, source, n in rows if source == share.source)
        whole = min(int(share.passes + 1e-9), share.cap)
        rest, before = share.passes * share.available - whole * share.available, 0
        for _, k, n in own:
            extra = n > 0 and whole < share.cap and rest > 1e-6 and before + n / 2 <= rest
            before += n
            if whole + extra:
                out[k] = whole + extra
    return out


@needs_files
@pytest.mark.parametrize("seed", range(6))
def test_equals_brute_force_and_keeps_every_cap(spark, seed):
    r = random.Random(seed)
    sources = "abcde"
    rows = [(i, r.choice(sources), " a" * r.choice([0, 0, 0, 1, 2, 30])) for i in range(r.choice([0, 40, 400, 1500]))]
    rows += [(5000 + i, "empty", "") for i in range(20)]
    goals = [(s, r.choice([0.0, 0.1, 0.5]), r.choice([0, 1, 2, 5])) for s in sources] + [("empty", 0.2, 2)]
    df = spark.createDataFrame([(k, t, s) for k, s, t in rows], "doc_id long, text string, source string")
    mix = mix_sources(df, spark.createDataFrame(goals, "source string, target_share double, max_repeats int"), seed=seed)
    docs = {d.doc_id: d for d in mix.documents.collect()}
    caps = {s: c for s, _, c in goals}
    assert all(1 <= d.copies <= caps[d.source] for d in docs.values())
    assert all(x.most_copies <= x.max_repeats for x in mix.report.collect())
    order = {x.doc_id: x.o for x in df.select("doc_id", F.xxhash64(F.lit(seed), "doc_id").alias("o")).collect()}
    # ranges follow the order's upper bits without sign
    order = {k: o % 2**64 for k, o in order.items()}
    want = brute_force([(k, s, len(t.split())) for k, s, t in rows], goals, order)
    assert {k: d.copies for k, d in docs.items()} == want


@needs_files
@pytest.mark.parametrize("seed", [1, 2, 3])
def test_no_document_beyond_its_cap_where_texts_are_empty(spark, seed):
    rows = [(i, "" if i % 5 else "some words here", "thin") for i in range(500)] + [(1000 + i, "word " * 500, "rich") for i in range(50)] + [(2000, "", "none")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    targets = spark.createDataFrame([("thin", 0.5, 2), ("rich", 0.5, 4), ("none", 0.0, 0)], "source string, target_share double, max_repeats int")
    mix = mix_sources(df, targets, seed=seed)
    assert all(d.copies <= {"thin": 2, "rich": 4}[d.source] for d in mix.documents.collect())
    assert all(x.most_copies <= x.max_repeats for x in mix.report.collect())


@needs_files
def test_tokens_are_those_of_the_tokenizer(spark):
    from tokenizers import Tokenizer

    tool = Tokenizer.from_file(TOKENIZER.replace(".tiktoken", ".json"))
    tool.encode_special_tokens = True
    texts = ["", None, "RNAV (GPS) RWY 21R", "  l'état d'été\r\n\n 50 % ", "<|endoftext|>", "日本語 🛫", "x" * 20_000, "we'll\tclimb to 3,000' "]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r.n_tokens for r in count_tokens(df, "text", TOKENIZER, ["doc_id"]).collect()}
    assert got == {i: len(tool.encode(t, add_special_tokens=False)) if t else 0 for i, t in enumerate(texts)}
