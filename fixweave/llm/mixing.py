"""Mixing sources to target weights by capped water-filling.

Documents are measured in tokens of a public tokenizer. A source that would need more
passes than it may have is clamped at its cap and its excess weight goes to the others in
proportion, until every source is feasible. Whole passes take every document; the
remaining fraction takes documents in a seeded order until its share of tokens is filled.
The order is cut into ranges, and the cut of a source falls into one of them: ranges
before it are taken whole, those after it not at all, and only that one is sorted.
"""

from __future__ import annotations

from base64 import b64decode
from collections.abc import Iterator
from dataclasses import dataclass
from pathlib import Path

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from ..session import collect_bounded, materialise

#: The driver's copy of the tokenizer's ranks; executors get its content, of this size at most.
TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"
MAX_TOKENIZER_BYTES = 64 << 20
#: Fixed value: how that public tokenizer cuts a text into the pieces that it encodes.
PIECES = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: The seeded order is cut into so many ranges; only the range that a cut falls into is sorted.
RANGES = 4096
MAX_SOURCES = 10_000


def source_form(value: Column) -> Column:
    """Source names compare without regard to case, blanks around them and ``-`` against ``_``."""
    return F.translate(F.lower(F.regexp_replace(value, r"(?U)^\s+|\s+$", "")), "-", "_")


def count_tokens(df: DataFrame, text: str, tokenizer: str, kept: list[str]) -> DataFrame:
    """``kept`` columns and ``n_tokens`` of the whole text; null and empty texts have none.

    ``tokenizer`` is a file of ranks on the driver; its content is sent to the executors.
    """
    if (size := Path(tokenizer).stat().st_size) > MAX_TOKENIZER_BYTES:
        raise ValueError(f"{tokenizer}: {size} bytes, more than {MAX_TOKENIZER_BYTES}")
    content = df.sparkSession.sparkContext.broadcast(Path(tokenizer).read_bytes())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from tiktoken import Encoding

        ranks = {b64decode(piece): int(rank) for piece, rank in map(bytes.split, content.value.splitlines())}
        encode = Encoding("mixing", pat_str=PIECES, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
        for batch in batches:
            counts = [len(encode(t)) if t else 0 for t in batch.column(text).to_pylist()]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), pa.array(counts, pa.int64())], names=[*kept, "n_tokens"])

    small = df.select(*kept, text)
    return small.mapInArrow(run, small.select(*kept).schema.add("n_tokens", LongType()))


@dataclass
class Share:
    source: str
    target: float
    cap: int
    available: int
    weight: float = 0.0
    passes: float = 0.0


def water_fill(shares: list[Share], total: float | None = None) -> list[Share]:
    """Weights and passes per source for a mix of ``total`` tokens (default: all that is there once).

    A source is clamped at ``cap`` passes and its excess goes to the unclamped ones in
    proportion to their targets; where all are clamped the mix is as large as the caps
    allow. Empty sources get nothing; nothing is divided by zero.
    """
    total = float(sum(s.available for s in shares) if total is None else total)
    clamped: set[int] = set()
    room = total
    while True:
        open_ = [i for i, s in enumerate(shares) if i not in clamped and s.target > 0]
        weight = sum(shares[i].target for i in open_)
        over = [i for i in open_ if shares[i].target / weight * room > shares[i].cap * shares[i].available]
        if not over:
            break
        clamped |= set(over)
        room = total - sum(shares[i].cap * shares[i].available for i in clamped)
    for i, s in enumerate(shares):
        tokens = s.cap * s.available if i in clamped else s.target / weight * room if i in open_ else 0.0
        s.passes = tokens / s.available if s.available else 0.0
    size = sum(s.passes * s.available for s in shares)
    for s in shares:
        s.weight = s.passes * s.available / size if size else 0.0
    return shares


def whole_and_cut(share: Share) -> tuple[int, float]:
    """Whole passes over a source, and the tokens of its last, partial pass; none beyond the cap."""
    whole = min(int(share.passes + 1e-9), share.cap)
    return whole, max(0.0, (share.passes - whole) * share.available) if whole < share.cap and share.passes > whole + 1e-9 else 0.0


@dataclass
class Mix:
    documents: DataFrame
    report: DataFrame


def mix_sources(
    documents: DataFrame, targets: DataFrame, key: str = "doc_id", text: str = "text", tokenizer: str = TOKENIZER, total: float | None = None, seed: int = 7
) -> Mix:
    """The mix (``key, source, n_tokens, copies``) and its report per source.

    Documents of null or unlisted sources and those without a copy stay out. The order
    within a source hashes key and seed, so a rerun gives the same mix; rows with the same
    key and size are alike and taken in any order. A document has ``max_repeats`` copies at
    most; one without tokens takes part in whole passes only. A source listed twice adds up
    its targets and has the larger cap; null targets and caps count as 0.
    """
    wanted = targets.groupBy(source_form(F.col("source")).alias("source")).agg(
        F.sum(F.coalesce("target_share", F.lit(0.0))).alias("target_share"), F.max(F.coalesce("max_repeats", F.lit(0))).alias("max_repeats")
    ).where(F.col("source").isNotNull())
    goals = collect_bounded(wanted, MAX_SOURCES, "sources")
    spark = documents.sparkSession
    named = documents.select(F.col(key), source_form(F.col("source")).alias("source"), F.col(text)).where(F.col("source").isin([g.source for g in goals]))
    order = F.xxhash64(F.lit(seed), F.col(key))
    sized = count_tokens(named, text, tokenizer, [key, "source"]).withColumn("__fw_order", order)
    sized = materialise(sized.withColumn("__fw_range", F.shiftrightunsigned("__fw_order", 52).cast("int")), "token-counts")

    ranges = sized.groupBy("source", "__fw_range").agg(F.sum("n_tokens").alias("tokens"), F.count("*").alias("docs"))
    sums = {r.source: r for r in collect_bounded(ranges.groupBy("source").agg(F.sum("tokens").alias("tokens"), F.sum("docs").alias("docs")), MAX_SOURCES, "sources")}
    shares = [Share(g.source, g.target_share, g.max_repeats, sums[g.source].tokens if g.source in sums else 0) for g in sorted(goals, key=lambda g: g.source)]
    water_fill(shares, total)
    plan = spark.createDataFrame(
        [(s.source, s.target, s.cap, sums[s.source].docs if s.source in sums else 0, s.available, s.weight, s.passes, *whole_and_cut(s)) for s in shares],
        "source string, target_share double, max_repeats int, n_docs bigint, available_tokens bigint, planned_share double, passes double, whole int, cut double",
    )
    # one row per source: the range that its cut falls into, and the tokens before that range
    goal = plan.select("source", "whole", "cut")
    before = F.coalesce(F.sum("tokens").over(Window.partitionBy("source").orderBy("__fw_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    reached = ranges.join(F.broadcast(goal), "source").withColumn("before", before).where((F.col("before") < F.col("cut")) & (F.col("before") + F.col("tokens") >= F.col("cut")))
    edges = goal.join(F.broadcast(reached.select("source", F.col("__fw_range").alias("edge"), "before")), "source", "left")
    joined = sized.join(F.broadcast(edges), "source")  # MAX_SOURCES rows at most
    first = F.when(F.col("edge").isNull(), F.col("cut") > 0).otherwise(F.col("__fw_range") < F.col("edge")) & (F.col("n_tokens") > 0)
    at_edge = F.col("edge").isNotNull() & (F.col("__fw_range") == F.col("edge"))
    decided = joined.where(~at_edge).withColumn("extra", F.when(first, 1).otherwise(0))
    within = Window.partitionBy("source").orderBy("__fw_order", key, "n_tokens")
    upto = F.col("before") + F.sum("n_tokens").over(within.rowsBetween(Window.unboundedPreceding, 0)) - F.col("n_tokens") / 2
    cut = joined.where(at_edge).withColumn("extra", F.when((upto <= F.col("cut")) & (F.col("n_tokens") > 0), 1).otherwise(0))
    mixed = decided.unionByName(cut).select(key, "source", "n_tokens", (F.col("whole") + F.col("extra")).alias("copies")).where(F.col("copies") > 0)
    used = mixed.groupBy("source").agg(F.sum(F.col("n_tokens") * F.col("copies")).alias("mix_tokens"), F.max("copies").alias("most_copies"))
    report = plan.drop("whole", "cut").join(F.broadcast(used), "source", "left").na.fill(0, ["mix_tokens", "most_copies"])
    share = F.when(F.sum("mix_tokens").over(Window.partitionBy()) > 0, F.col("mix_tokens") / F.sum("mix_tokens").over(Window.partitionBy())).otherwise(0.0)
    return Mix(mixed, report.withColumn("actual_share", share))
