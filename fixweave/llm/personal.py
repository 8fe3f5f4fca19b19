"""Personal information inside free text.

A linear-chain conditional random field over word-shape features is trained on the
driver from the small labelled table and sent to the executors, where whole texts are
decoded by Viterbi in numpy batches. Two things are learnt from the corpus itself: whether
a word is mostly written in lower case, with a capital or in capitals, which tells a name
in lower case from a word and a word at the start of a sentence from a name; and whether
it often follows a word such as "near", as places do. Labelled spans pass an exact check
of their form and are replaced by typed placeholders.
"""

from __future__ import annotations

import random
import re
from collections.abc import Iterable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import collect_bounded, scratch_tables
from .crf import Chain
from .labelled import KINDS, TITLES, Filler, examples, literal_words

TOKEN = re.compile(r"\n+|[^\W_]+(?:[.'’+_@/-]+[^\W_]+)*|[^\w\s]|_")
PLACEHOLDERS = {"email": "[EMAIL]", "phone": "[PHONE]", "identity_number": "[ID_NUMBER]", "street_address": "[ADDRESS]", "person_name": "[NAME]"}
#: Least share of all words of which the corpus's way of writing is learnt: at most 1 / share words.
CASE_SHARE = 5e-6

_WORD = re.compile(r"[^\W\d_]+(?:['’-][^\W\d_]+)*")
_DIGIT = re.compile(r"[0-9]")
_TITLES = frozenset(t.rstrip(".").lower() for t in TITLES)


#: The end of a mail host.
_HOST = re.compile(r"@.*\.[^\W\d_]{2,}$")


def _form(token: str) -> str:
    """Digits as 9, capitals as A, runs of small letters as a."""
    return re.sub("[a-z]+", "a", re.sub("[A-Z]", "A", _DIGIT.sub("9", token)))


#: Words before a place, by which the corpus tells its places from its people.
LOCATIVE = frozenset("at near in from over around toward towards between beyond above vers près cerca en desde hacia sobre".split())
#: Share of a word's places in the corpus that follow such a word, from which it is a place's.
PLACE_SHARE = 0.2


def case_profile(lower: int, title: int, upper: int, placed: int) -> str:
    """How a word is mostly written: small (l), in capitals (u), with a capital (t), or so in the names of places (p)."""
    total = lower + title + upper
    return "l" if lower * 4 >= total else "u" if upper * 2 > total else "p" if placed >= PLACE_SHARE * total else "t"


_BARE = re.compile(r"^[\W\d_]+|[\W\d_]+$")


def count_cases(texts: Iterable[str]) -> dict[str, list[int]]:
    """Of each word how often it is small, has a capital, is in capitals, and has a capital after a
    word of ``LOCATIVE`` (or one or two such words after it)."""
    counts: dict[str, list[int]] = {}
    for text in texts:
        before, open_ = "", 0  # the word before, and how many words of a place may follow it
        for raw in text.split():
            word, low = _BARE.sub("", raw), ""
            room = 3 if before in LOCATIVE else open_
            open_ = 0
            if word and _WORD.fullmatch(word):
                low = word.lower()
                entry = counts.setdefault(low, [0, 0, 0, 0])
                kind = 0 if word == low else 2 if len(word) > 1 and word == word.upper() else 1
                entry[kind] += 1
                if kind == 1 and room:
                    entry[3] += 1
                    open_ = room - 1 if raw == word else 0
            before = raw.lower()
    return counts


class Features:
    """Word-shape features of a token."""

    def __init__(self, literal: set[str], cases: dict[str, str], given: frozenset[str] = frozenset()):
        self.literal, self.cases, self.given = literal, cases, given

    def __call__(self, token: str) -> list[str]:
        if token[0] == "\n":
            return ["line", "lines" if len(token) > 1 else "line1"]
        if not token[0].isalnum():
            return [f"mark{token}"]
        low = token.lower()
        if "@" in token:
            return ["email"] if _HOST.search(token) else ["fixed", f"form{_form(token)[:24]}"]
        out = []
        if _DIGIT.search(token):
            form = _form(token)
            out += [f"form{form[:24]}", f"digits{min(len(_DIGIT.findall(token)), 12)}", f"kinds{re.sub(r'(.)\1+', r'\1', form)[:12]}"]
            return out
        if low in self.literal:
            out += [f"word{low}", "literal"]
            # the words that make a name or an address may be written in any way
        if _WORD.fullmatch(token):
            shape = "a" if token == low else "A" if len(token) == 1 else "AA" if token == token.upper() else "Aa"
            profile = self.cases.get(low, "r")
            out += [f"shape{shape}", f"profile{profile}", f"both{shape}{profile}"]
            if shape == "AA":
                out.append(f"capitals{min(len(token), 7)}")
            if low not in self.literal:
                out.append(f"open{shape}{profile}")
            if low in self.given and profile != "l":
                out += ["given", f"given{shape}"]
            if "'" in token or "’" in token or "-" in token:
                out.append("joined")
        else:
            out += ["host" if "." in token else "mixed", f"tail{low.rpartition('.')[2][:8]}" if "." in token else "untailed"]
        return out


def tokens_of(text: str) -> tuple[list[str], list[tuple[int, int]]]:
    found = [(m.group(), m.span()) for m in TOKEN.finditer(text)]
    return [t for t, _ in found], [s for _, s in found]


def train(cases: dict[str, str], fills: int = 8, seed: int = 11, lines: Sequence[str] = (), part: int | None = None) -> Chain:
    """The tagger from the labelled table (``examples``), with the corpus's ways of writing.

    ``lines`` and ``part`` train on some of the table's lines and names, to measure on others.
    """
    labels = ["O", *(f"{p}-{k}" for k in dict.fromkeys(KINDS.values()) for p in "BI")]
    rows = examples(fills, seed, lines, part)
    sequences, tags = [], []
    for text, spans in rows:
        tokens, places = tokens_of(text)
        tag = ["O"] * len(tokens)
        for start, end, kind in spans:
            inside = [i for i, (s, e) in enumerate(places) if s >= start and e <= end]
            for k, i in enumerate(inside):
                tag[i] = ("I-" if k else "B-") + kind
        sequences.append(tokens)
        tags.append(tag)
    own = count_cases(text for text, _ in rows)
    profiles = {w: case_profile(*n) for w, n in own.items()}
    # a corpus knows the case of most words, but not of all: half of the table's rarer words are left unknown
    rare = random.Random(seed)
    seen = {w: p for w, p in sorted(profiles.items()) if sum(own[w][:3]) >= 12 or rare.random() < 0.5}
    # and most names of a corpus stand in no list: four in five are left out here
    given = [n.lower() for n in Filler(seed, part).given]
    features = Features(literal_words(lines), seen, frozenset(given[::5]))
    chain = Chain(labels, features).fit(sequences, tags)
    # words that the corpus hardly has keep the profile of the table
    known = {w: p for w, p in profiles.items() if sum(own[w][:3]) >= 3}
    chain.features = Features(features.literal, {**known, **cases}, frozenset(given))
    return chain


def corpus_cases(df: DataFrame, text: str, share: float = CASE_SHARE) -> dict[str, str]:
    """How the corpus writes its words (``case_profile``), counted over all texts before the shuffle."""
    # a column of its own: within a lambda the split would run again for every word
    rows = df.where(F.col(text).isNotNull()).select(F.filter(F.split(text, r"(?U)\s+"), lambda w: w != "").alias("raw"))
    at = lambda i: F.when(i >= 0, F.get("raw", i))
    seen = rows.select(F.explode(F.transform("raw", lambda w, i: F.struct(w.alias("raw"), *[at(i - k).alias(f"b{k}") for k in (1, 2, 3)]))).alias("x")).select("x.*")
    # most words are plain as they stand: marks around the others are cut off only then
    plain = lambda c: c.rlike(r"^\p{L}+(['’-]\p{L}+)*$")
    bare = F.regexp_replace("raw", r"(?U)^[\W\d_]+|[\W\d_]+$", "")
    words = seen.select("*", F.when(plain(F.col("raw")), F.col("raw")).otherwise(F.when(plain(bare), bare)).alias("w")).where(F.col("w").isNotNull())
    low = F.lower("w")
    titled = lambda w: (w != F.lower(w)) & ((F.length(w) == 1) | (w != F.upper(w)))
    kind = F.when(F.col("w") == low, "l").when((F.length("w") > 1) & (F.col("w") == F.upper("w")), "u").otherwise("t")
    named = lambda c: titled(F.col(c)) & plain(F.col(c))
    locates = lambda c: F.lower(c).isin(*LOCATIVE)
    after = locates("b1") | named("b1") & (locates("b2") | named("b2") & locates("b3"))
    placed = F.coalesce(titled(F.col("w")) & after, F.lit(False))
    counts = words.select(low.alias("word"), kind.alias("kind"), placed.alias("placed")).groupBy("word").agg(
        *[F.sum(F.when(F.col("kind") == k, 1).otherwise(0)).alias(k) for k in "ltu"], F.sum(F.col("placed").cast("int")).alias("p")
    )
    with scratch_tables(df.sparkSession) as keep:
        counts = keep(counts.withColumn("n", F.col("l") + F.col("t") + F.col("u")), "word-cases")  # used twice
        total = counts.agg(F.sum("n").alias("n")).first().n or 0
        kept = counts.where(F.col("n") >= max(3, total * share))
        return {r.word: case_profile(r.l, r.t, r.u, r.p) for r in collect_bounded(kept, int(1 / share) + 1, "words of the corpus")}


def _valid(kind: str, text: str) -> bool:
    """The exact check of a labelled span."""
    digits = len(_DIGIT.findall(text))
    if kind == "email":
        return bool(re.search(r"@|\bat\b", text, re.I)) and bool(re.search(r"(\.|\bdot\b)[^\W\d_]*\W*[^\W\d_]{2}", text, re.I))
    if kind == "phone":
        return 7 <= digits <= 17
    if kind == "identity_number":
        return digits >= 5
    if kind == "street_address":
        return digits >= 1 and bool(re.search(r"[^\W\d_]{3}", text))
    if digits or re.search(r"[()\[\]<>]", text) or not re.search(r"[^\W\d_]{2}", text):
        return False
    # two words, and a full stop inside only after an initial or a title
    stops = re.findall(r"([^\W\d_]+)\.\s", text)
    return len(_WORD.findall(text)) > 1 and all(len(w) == 1 or w.lower() in _TITLES for w in stops)


class Finder:
    """Finds the personal data of many texts at once."""

    def __init__(self, chain: Chain):
        self.chain = chain
        self.kinds = [x[2:] for x in chain.labels]
        self.begins = np.array([x.startswith("B-") for x in chain.labels])
        self.outside = np.array([x == "O" for x in chain.labels])

    def __call__(self, texts: list[str]) -> list[list[tuple[int, int, str]]]:
        number: dict[str, int] = {}
        rows, places = [], []
        for t in texts:
            tokens, spots = tokens_of(t)
            rows.append(np.fromiter((number.setdefault(x, len(number)) for x in tokens), np.int64, len(tokens)))
            places.append(spots)
        scores = self.chain.token_scores(list(number))
        found = []
        for text, labels, spots in zip(texts, self.chain.decode(rows, scores), places):
            spans: list[tuple[int, int, str]] = []
            inside = np.flatnonzero(~self.outside[labels]) if len(labels) else labels
            for i in inside:
                if self.begins[labels[i]] or not spans or spans[-1][3] != i - 1:
                    spans.append((*spots[i], self.kinds[labels[i]], i))
                else:
                    spans[-1] = (spans[-1][0], spots[i][1], spans[-1][2], i)
            found.append([(s, e, k) for s, e, k, _ in spans if _valid(k, text[s:e])])
        return found


def redact(text: str, spans: list[tuple[int, int, str]]) -> str:
    out, at = [], 0
    for start, end, kind in spans:
        out += [text[at:start], PLACEHOLDERS[kind]]
        at = end
    return "".join([*out, text[at:]])


def tagger(df: DataFrame, text: str = "text", fills: int = 8, seed: int = 11, share: float = CASE_SHARE) -> Broadcast:
    """The trained tagger for a corpus, on all executors; trained once in a session for equal counts."""
    spark = df.sparkSession
    cases = corpus_cases(df, text, share)
    key = (fills, seed, frozenset(cases.items()))
    if (held := getattr(spark, "_fixweave_tagger", None)) is None or held[0] != key:
        held = spark._fixweave_tagger = (key, spark.sparkContext.broadcast(train(cases, fills, seed)))
    return held[1]


def find_personal(df: DataFrame, key: str, text: str = "text", chain: Broadcast | None = None) -> DataFrame:
    """Each text with placeholders for its personal data, and the kinds found (sorted, once each).

    ``chain`` is a ``tagger``, by default one that knows the words of these very texts. Null
    texts come out empty without kinds, empty texts as they are; every row comes out once,
    equal texts alike, texts are decoded whole.
    """
    chain = chain or tagger(df, text)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        finder = Finder(chain.value)
        for frame in frames:
            for k in range(0, len(frame), 2000):
                part = frame.iloc[k : k + 2000]
                texts = [t or "" for t in part["__fw_text"]]
                spans = finder(texts)
                yield pd.DataFrame({"__fw_key": part["__fw_key"].to_numpy(), "redacted": [redact(t, s) for t, s in zip(texts, spans)], "kinds": [sorted({x[2] for x in s}) for s in spans]})

    rows = df.select(F.col(key).alias("__fw_key"), F.col(text).alias("__fw_text"))
    kind = df.schema[key].dataType.simpleString()
    return rows.mapInPandas(run, f"__fw_key {kind}, redacted string, kinds array<string>").withColumnRenamed("__fw_key", key)
