"""Evaluation texts that leaked into training text.

The items are held in a BM25 inverted index whose postings come in blocks with their
maximum impact. Every passage of every document queries it by block-max WAND: lists are
kept in item order, a pivot is sought whose upper bounds reach the threshold, and blocks
whose maxima can't reach it are skipped. Impacts are divided by the least score that
``span`` consecutive words of the item can have, so that the threshold is 1 for every item
and no passage with such a run can fall below it. What is retrieved is verified word by word.
"""

from __future__ import annotations

import math
import pickle
import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import scratch_tables

WORD = re.compile(r"[^\W_]+")
SPAN = 8
#: A passage has so many times the words of a run.
PASSAGE = 3
BLOCK = 16
K1, B = 1.2, 0.75
#: Characters of item text per index; more make more indexes.
INDEX_CHARS = 8_000_000
#: Indexes are sent to the executors as long as they hold so many bytes together; the rest
#: follows in further passes over the documents.
PASS_BYTES = 128 << 20


def words(text: str | None) -> list[str]:
    return WORD.findall(text.lower()) if text else []


class ItemIndex:
    """Block-max postings of a set of items."""

    def __init__(self, items: list[tuple[int, str]], span: int = SPAN, block: int = BLOCK):
        if span < 1:
            raise ValueError("a run has one word at least")
        self.span, self.passage = span, PASSAGE * span
        texts = [(i, words(t)) for i, t in items]
        texts = [(i, w) for i, w in texts if len(w) >= span]
        self.ids = [i for i, _ in texts]
        n = len(texts)
        tf = [Counter(w) for _, w in texts]
        df = Counter(t for c in tf for t in c)
        mean = sum(len(w) for _, w in texts) / n if n else 1.0
        idf = {t: math.log(1 + (n - d + 0.5) / (d + 0.5)) for t, d in df.items()}
        self.term = {t: i for i, t in enumerate(sorted(df))}
        impact: list[dict[int, float]] = [{} for _ in self.term]
        #: the runs of ``span`` words of each item, as term numbers
        self.runs: list[set[tuple[int, ...]]] = []
        for at, (_, w) in enumerate(texts):
            norm = K1 * (1 - B + B * len(w) / mean)
            score = {t: idf[t] * c * (K1 + 1) / (c + norm) for t, c in tf[at].items()}
            numbers = [self.term[t] for t in w]
            least = min(sum(score[t] for t in set(w[k : k + span])) for k in range(len(w) - span + 1))
            for t, s in score.items():
                impact[self.term[t]][at] = s / least
            self.runs.append({tuple(numbers[k : k + span]) for k in range(len(numbers) - span + 1)})
        self.items = [sorted(p) for p in impact]
        self.scores = [[p[i] for i in sorted(p)] for p in impact]
        self.best = np.array([max(s) for s in self.scores] or [0.0])
        self.block_best = [[max(s[k : k + block]) for k in range(0, len(s), block)] for s in self.scores]
        self.block_last = [[i[min(k + block, len(i)) - 1] for k in range(0, len(i), block)] for i in self.items]
        self.block = block

    def above(self, terms: list[int]) -> list[int]:
        """Items whose score for the distinct ``terms`` is at least 1, by block-max WAND."""
        limit, block, best = 1.0 - 1e-9, self.block, self.best
        lists = [[self.items[t][0], 0, t] for t in terms]  # current item, position, term
        out = []
        while lists:
            lists.sort()
            bound, pivot = 0.0, -1
            for k, entry in enumerate(lists):
                bound += best[entry[2]]
                if bound >= limit:
                    pivot = k
                    break
            if pivot < 0:
                break
            item = lists[pivot][0]
            while pivot + 1 < len(lists) and lists[pivot + 1][0] == item:
                pivot += 1
            # the maxima of the blocks that may hold the item, and where the first of them ends
            bound, until = 0.0, None
            for current, _, t in lists[: pivot + 1]:
                b = bisect_left(self.block_last[t], item)
                if b < len(self.block_last[t]):
                    bound += self.block_best[t][b]
                    last = self.block_last[t][b]
                    until = last if until is None or last < until else until
            if bound < limit:
                target = max(item, until if until is not None else item) + 1
                if pivot + 1 < len(lists):
                    target = min(target, max(lists[pivot + 1][0], item + 1))
                move = range(pivot + 1)
            elif lists[0][0] == item:
                score = sum(self.scores[t][p] for _, p, t in lists[: pivot + 1])
                if score >= limit:
                    out.append(item)
                target, move = item + 1, range(pivot + 1)
            else:
                target, move = item, [k for k in range(pivot) if lists[k][0] < item]
            done = []
            for k in move:
                _, p, t = lists[k]
                p = bisect_left(self.items[t], target, p)
                if p < len(self.items[t]):
                    lists[k][0], lists[k][1] = self.items[t][p], p
                else:
                    done.append(k)
            for k in reversed(done):
                del lists[k]
        return out

    def leaked(self, text_words: list[str]) -> set[int]:
        """Items of which the words hold at least one run."""
        span, step = self.span, self.passage - self.span + 1
        get = self.term.get
        numbers = [get(w, -1) for w in text_words]
        if len(numbers) < span or not self.ids:
            return set()
        # no passage whose terms' greatest impacts stay below the threshold is asked
        row = np.array(numbers)
        weight = np.where(row >= 0, self.best[np.maximum(row, 0)], 0.0)
        total = np.concatenate(([0.0], np.cumsum(weight)))
        starts = np.arange(0, max(len(row) - span, 0) + 1, step)
        ends = np.minimum(starts + self.passage, len(row))
        found: set[int] = set()
        for s, e in zip(starts[total[ends] - total[starts] >= 1.0 - 1e-6], ends[total[ends] - total[starts] >= 1.0 - 1e-6]):
            passage = numbers[s:e]
            hits = self.above([t for t in dict.fromkeys(passage) if t >= 0])
            if hits:
                runs = [tuple(passage[k : k + span]) for k in range(len(passage) - span + 1)]
                found |= {h for h in hits if h not in found and not self.runs[h].isdisjoint(runs)}
        return {self.ids[h] for h in found}


def item_indexes(items: DataFrame, item_key: str, text: str, span: int, chars: int = INDEX_CHARS) -> DataFrame:
    """Indexes over all items as pickled rows ``(block, size, data)``, built where the items are."""
    rows = items.where(F.col(text).isNotNull()).select(F.col(item_key).alias("__fw_item"), F.col(text).alias("__fw_text")).distinct()
    total = rows.agg(F.sum(F.length("__fw_text").cast("bigint")).alias("n")).first().n or 0
    blocks = max(1, -(-total // chars))

    def build(frame: pd.DataFrame) -> pd.DataFrame:
        pairs = sorted(zip(frame["__fw_item"], frame["__fw_text"]))
        data = pickle.dumps(ItemIndex(pairs, span), protocol=5)
        return pd.DataFrame({"block": [int(frame["block"].iloc[0])], "size": [len(data)], "data": [data]})

    placed = rows.withColumn("block", F.pmod(F.xxhash64("__fw_item", "__fw_text"), F.lit(blocks)).cast("int"))
    return placed.groupBy("block").applyInPandas(build, "block int, size bigint, data binary")


def find_leaks(
    documents: DataFrame, items: DataFrame, doc_key: str, item_key: str, text: str = "text", span: int = SPAN, chars: int = INDEX_CHARS, pass_bytes: int = PASS_BYTES
) -> DataFrame:
    """Every (item, document) pair that shares ``span`` consecutive words or more, once.

    Case doesn't count and everything but letters and digits only separates words. Null and
    short texts match nothing; a document key that occurs again counts once; texts are taken
    whole; empty tables give no rows. The items are the query side: any number of them, in
    blocks; documents are never shuffled.
    """
    spark = documents.sparkSession
    kind = lambda df, c: df.schema[c].dataType.simpleString()
    schema = f"__fw_item {kind(items, item_key)}, __fw_key {kind(documents, doc_key)}"
    bodies = documents.where(F.col(text).isNotNull()).select(F.col(doc_key).alias("__fw_key"), F.col(text).alias("__fw_text"))

    def ask(shared: list[Broadcast]) -> DataFrame:
        def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            indexes = [pickle.loads(s.value) for s in shared]
            for frame in frames:
                out = []
                for key, body in zip(frame["__fw_key"], frame["__fw_text"]):
                    of = words(body)
                    for index in indexes:
                        out += [(i, key) for i in index.leaked(of)]
                yield pd.DataFrame(out, columns=["__fw_item", "__fw_key"])

        return bodies.mapInPandas(run, schema)

    with scratch_tables(spark) as keep:
        built = keep(item_indexes(items, item_key, text, span, chars), "item-indexes")
        passes: list[list[int]] = []
        room = 0
        for r in built.select("block", "size").orderBy("block").toLocalIterator():
            if not passes or r["size"] > room:
                passes.append([])
                room = pass_bytes
            passes[-1].append(r["block"])
            room -= r["size"]
        found = [ask([spark.sparkContext.broadcast(bytes(r.data)) for r in built.where(F.col("block").isin(blocks)).toLocalIterator()]) for blocks in passes]
    out = reduce(DataFrame.unionByName, found) if found else spark.createDataFrame([], schema)
    return out.distinct().select(F.col("__fw_item").alias(item_key), F.col("__fw_key").alias(doc_key))
