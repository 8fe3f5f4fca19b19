"""Noise in text from scanned pages: broken words, misread characters, page furniture.

Three passes, each pre-aggregated where the rows are: counts of words, then counts of
neighbouring words and of how lines begin and end, both over distinct texts so that copies
don't count, then the repair of the whole table. Only
words, pairs and line ends above a share of all are brought together, which bounds them
by one over that share. A record is cleaned of page furniture, its broken words are
joined, and each word is looked up: candidates come from the intersection of a
Levenshtein automaton with the vocabulary trie, and the words beside it decide among them.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import collect_bounded, scratch_tables
from .lexicon import Trie

#: Least share of all words that makes a word known; words in capitals (names, codes) need more.
WORD_SHARE, CAPITAL_SHARE = 1e-5, 1e-4
#: Least share of all pairs.
PAIR_SHARE = 2e-6
#: How much better the words beside it must know a candidate than the word as read, and how
#: much commoner a candidate must be than a word that is known itself.
BETTER, COMMONER = 8, 20
#: Furniture begins and ends lines: the least share of its places in the corpus that do.
EDGE = 0.9

#: Marks that break a word at a line's end, what may be read for a digit,
#: and words of page numbers.
MARKS = "-‐­¬"
DIGITS = str.maketrans({"O": "0", "o": "0", "Q": "0", "D": "0", "I": "1", "l": "1", "i": "1", "|": "1", "!": "1", "Z": "2", "z": "2", "S": "5", "s": "5", "b": "6", "G": "6", "B": "8", "g": "9", "q": "9"})
PAGE_WORDS = {"page", "p", "pg", "of"}
#: Letters that scanning takes for one another, in either direction.
CONFUSED = {frozenset(p.split(":")) for p in "m:rn n:ri h:b h:li e:c i:l i:1 i:I i:! l:1 l:I l:| u:n u:ii w:vv d:cl k:l< a:o a:@ o:0 c:o s:5 t:l t:i t:f g:q g:9 b:6 y:v z:2 B:8 O:0 S:5 Z:2".split()}

_EDGE_MARKS = ".,;:()[]\"'"
_LINE = re.compile(r"\r\n|\n|\r")
_BROKEN = re.compile(rf"(\S*?\w)[ \t]?[{MARKS}][ \t]*$")


def shape(token: str) -> str:
    """The token without marks around it, digits as 9."""
    return re.sub(r"[0-9]", "9", token.strip(".,;:\"'") or token)


def confused(right: str, read: str) -> bool:
    """Whether ``read`` is ``right`` with some letters taken for those of ``CONFUSED``."""
    if not right or not read:
        return right == read
    if right[0] == read[0] and confused(right[1:], read[1:]):
        return True
    return any(frozenset((right[:i], read[:j])) in CONFUSED and confused(right[i:], read[j:]) for i in (1, 2) for j in (1, 2))


def broken_at_end(line: str) -> re.Match | None:
    """The part of a word that a mark breaks off at the line's end."""
    end = line.rstrip(" \t")
    return _BROKEN.search(line) if end and end[-1] in MARKS else None


def lines_of(text: str) -> list[str]:
    return _LINE.split(text)


def _sums(kind: str, counts: Counter) -> pd.DataFrame:
    return pd.DataFrame({"kind": kind, "entry": list(counts), "n": list(counts.values())})


def _count(df: DataFrame, text: str, count, limit: int = 200_000) -> DataFrame:
    """Sums of what ``count(text, counters)`` counts, pre-aggregated per task in bounded memory."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        counters: dict[str, Counter] = {}
        for frame in frames:
            for t in frame["__fw_text"]:
                count(t, counters)
            if sum(map(len, counters.values())) > limit:
                yield from (_sums(k, c) for k, c in counters.items() if c)
                counters.clear()
        yield from (_sums(k, c) for k, c in counters.items() if c)

    rows = df.where(F.col(text).isNotNull()).select(F.col(text).alias("__fw_text"))
    return rows.mapInPandas(run, "kind string, entry string, n bigint").groupBy("kind", "entry").agg(F.sum("n").alias("n"))


def _above(counts: DataFrame, share: float, what: str) -> dict[str, Counter]:
    """Entries seen three times or more with at least ``share`` of their kind; at most 1 / share of each kind."""
    totals = {r.kind: r.n for r in counts.groupBy("kind").agg(F.sum("n").alias("n")).collect()}  # a handful of kinds
    least = F.coalesce(*[F.when(F.col("kind") == k, F.lit(max(3.0, n * share))) for k, n in totals.items()], F.lit(3.0))
    kept = counts.where(F.col("n") >= least)
    out: dict[str, Counter] = {}
    for r in collect_bounded(kept, 8 * int(1 / share), what):
        out.setdefault(r.kind, Counter())[r.entry] = r.n
    return out


def _count_words(text: str, counters: dict[str, Counter]) -> None:
    """What ``_word_counts`` counts, in plain words."""
    counters.setdefault("word", Counter()).update(shape(t) for t in text.split())


def _word_counts(df: DataFrame, text: str) -> DataFrame:
    """Counts of the words' ``shape`` by built-in functions."""
    token = df.where(F.col(text).isNotNull()).select(F.explode(F.split(text, r"(?U)\s+")).alias("t")).where("t <> ''")
    bare = F.regexp_replace("t", r"^[.,;:\"']+|[.,;:\"']+$", "")
    shapes = token.select(F.regexp_replace(F.when(bare == "", F.col("t")).otherwise(bare), "[0-9]", "9").alias("entry"))
    return shapes.groupBy("entry").agg(F.count("*").alias("n")).select(F.lit("word").alias("kind"), "entry", "n")


class Statistics:
    """What the corpus says of words, pairs of neighbours and ends of lines."""

    def __init__(self, words: Counter, total: int):
        least = total * CAPITAL_SHARE
        self.words = Counter({w: n for w, n in words.items() if n >= least or w != w.upper() or not any(c.isalpha() for c in w)})
        self.pairs: Counter = Counter()
        self.begins: Counter = Counter()
        self.ends: Counter = Counter()
        self.alone: Counter = Counter()
        self.forms: dict[str, str] = {}

    def form(self, token: str) -> str:
        """A known word itself, any other by the kinds of its letters."""
        if (hit := self.forms.get(token)) is None:
            s = shape(token)
            hit = s if s in self.words else re.sub(r"[a-z]+", "a", re.sub(r"[A-Z]+", "A", s))
            if len(self.forms) > 200_000:
                self.forms.clear()
            self.forms[token] = hit
        return hit

    def count(self, text: str, counters: dict[str, Counter]) -> None:
        pairs, begins, ends, alone = (counters.setdefault(k, Counter()) for k in ("pair", "begin", "end", "alone"))
        broken = False
        for line in lines_of(text):
            forms = [self.form(t) for t in line.split()]
            if not forms:
                continue
            # parts of a broken word are no words
            first, broken = broken, bool(broken_at_end(line))
            forms = forms[1 if first else 0 : len(forms) - (1 + (forms[-1] in MARKS) if broken else 0)]
            found = [f"{a} {b}" for a, b in zip(forms, forms[1:])]
            pairs.update(found)
            if found and not first:
                begins[found[0]] += 1
            if found and not broken:
                ends[found[-1]] += 1
            if len(forms) == 1 and not first and not broken:
                alone[forms[0]] += 1


def corpus_statistics(df: DataFrame, text: str) -> Statistics:
    with scratch_tables(df.sparkSession) as keep:
        df = keep(df.where(F.col(text).isNotNull()).select(text).distinct(), "distinct-texts")  # used twice
        counts = keep(_word_counts(df, text), "word-counts")  # used twice
        total = counts.agg(F.sum("n").alias("n")).first().n or 0
        words = _above(counts, WORD_SHARE, "known words").get("word", Counter())
        stats = Statistics(words, total)
        shared = df.sparkSession.sparkContext.broadcast(stats)
        pairs = keep(_count(df, text, lambda t, c: shared.value.count(t, c)), "pair-counts")
        found = _above(pairs, PAIR_SHARE, "known pairs")
    stats.pairs, stats.begins, stats.ends, stats.alone = (found.get(k, Counter()) for k in ("pair", "begin", "end", "alone"))
    return stats


class Cleaner:
    """Repairs one text at a time from the corpus's statistics."""

    def __init__(self, stats: Statistics):
        self.s = stats
        self.vocabulary = {w: n for w, n in stats.words.items() if re.fullmatch(r"[A-Za-z][A-Za-z-]*[A-Za-z]|a", w)}
        self.trie = Trie(self.vocabulary)
        self.log: list[tuple[str, str, str | None, str | None]] | None = None
        self.near: dict[str, list[tuple[int, int, str]]] = {}
        self.read: dict[tuple[str, str | None, str | None], str] = {}
        self.shadows: dict[tuple[str, str], bool] = {}

    # page furniture

    def _page_number(self, line: str) -> bool:
        letters = re.findall(r"[^\W\d_]+", line)
        return bool(re.search(r"\d", line)) and all(w.lower() in PAGE_WORDS for w in letters)

    def _linked(self, a: str | None, b: str | None) -> int:
        return self.s.pairs[f"{self.s.form(a)} {self.s.form(b)}"] if a and b else 0

    def furniture(self, line: str, before: str | None, after: str | None) -> str:
        """``page_number``, ``running_header`` or nothing, from where its ends stand in the corpus
        and, where that is open, from whether the text reads better without it."""
        tokens = line.split()
        forms = [self.s.form(t) for t in tokens]
        kind = "page_number" if self._page_number(line) else "running_header"
        if broken_at_end(line) and re.search(r"[^\W\d_][ \t]?.[ \t]*$", line):
            return ""
        if before and kind == "running_header" and (cut := broken_at_end(before)):
            # after a broken word the text goes on with its other part, here or in the next line
            if self._joins(cut.group(1), tokens[0]) or tokens[0][0].islower():
                return ""
            if after and self._joins(cut.group(1), after):
                return kind
        if len(forms) == 1:
            if kind == "page_number" and tokens[0].strip("[](){}<>~|") != tokens[0]:
                return kind
            whole = self.s.alone[forms[0]]
            seen = whole + sum(n for p, n in self._pairs_of(forms[0]))
            if whole >= 3 and whole >= EDGE * seen:
                return kind
            if kind == "running_header":
                return ""
            if not re.fullmatch(r"[0-9]+", tokens[0]):
                return kind if not seen and not re.search(r"\.", line) else ""
            if len(line) - len(line.lstrip()) >= 4:
                return kind
            keep = min([n for n in (self._linked(before, tokens[0]) if before else None, self._linked(tokens[0], after) if after else None) if n is not None], default=0)
            drop = self._linked(before, after)
            return kind if drop > keep or drop == keep and len(tokens[0]) <= 3 else ""
        first, last = f"{forms[0]} {forms[1]}", f"{forms[-2]} {forms[-1]}"
        begins, ends = self.s.begins[first], self.s.ends[last]
        if begins >= 3 and begins >= EDGE * self.s.pairs[first] and (kind == "page_number" or ends >= 3 and ends >= EDGE * self.s.pairs[last]):
            return kind
        if kind == "page_number" and not self.s.pairs[first]:
            return kind
        # a line no one else has: the text must go on across it and not into or out of it
        if before and broken_at_end(before):
            return ""
        known = sum(self.s.pairs[f"{a} {b}"] > 0 for a, b in zip(forms, forms[1:]))
        if known * 2 < len(forms) - 1 and self._linked(before, after) and not self._linked(before, tokens[0]) and not self._linked(tokens[-1], after):
            return kind
        return ""

    def _pairs_of(self, form: str) -> list[tuple[str, int]]:
        if not hasattr(self, "by_word"):
            self.by_word: dict[str, list[tuple[str, int]]] = {}
            for p, n in self.s.pairs.items():
                for w in set(p.split(" ")):
                    self.by_word.setdefault(w, []).append((p, n))
        return self.by_word.get(form, [])

    # broken words

    def _known(self, token: str) -> int:
        return self.s.words[shape(token)]

    def _joins(self, left: str, right: str) -> bool:
        """Whether the parts make a known word, or nearly one that the second part isn't by itself."""
        if self._known(left + right) or self._known(f"{left}-{right}"):
            return True
        if left[-1:].islower() and right[:1].isupper():
            return False
        whole, part = (left + right).strip(_EDGE_MARKS), right.strip(_EDGE_MARKS)
        return any(w != part and edits <= 2 for edits, _, w in self._candidates(whole))

    def join(self, left: str, right: str) -> tuple[str, bool]:
        """Two parts of a word over a line's end, and whether the mark between them was no part of it."""
        joined, compound = left + right, f"{left}-{right}"
        plain, whole = self._known(joined), self._known(compound)
        if whole > plain:
            return compound, False
        if plain or self._candidates(joined.strip(_EDGE_MARKS)):
            return joined, True
        if "-" in right or "-" in left:
            tail, head = right.split("-")[0], left.split("-")[-1]
            if self._candidates(head + tail) or self._known(head + tail):
                return joined, True
            return compound, False
        return (joined, True) if left[-1:].islower() and right[:1].islower() else (compound, False)

    # misread words

    def _candidates(self, word: str) -> list[tuple[int, int, str]]:
        """Known words within reach: (edits, -count, word), nearest and commonest first."""
        if (hit := self.near.get(word)) is None:
            reach = 1 if len(word) < 3 else 2 if len(word) < 8 else 3
            found = self.trie.within(word, reach)
            hit = sorted((d, -self.vocabulary[w], w) for w, d in found.items() if d)
            if len(self.near) > 200_000:
                self.near.clear()
            self.near[word] = hit
        return hit

    def _readings(self, form: str) -> list[str]:
        """The form and the commoner words that it may be a misreading of."""
        if not re.search(r"[A-Za-z]", form):
            return [form]
        read = [form.replace("9", d) for d in "0125689"] if "9" in form else [form]
        return [form, *(w for _, minus, w in self._candidates(form) if -minus >= self.s.words[form] and any(confused(w, r) for r in read))]

    def _beside(self, left: str | None, right: str | None) -> int:
        """How often the forms stand together, as they are or as what they may be misreadings of."""
        return max((self.s.pairs[f"{a} {b}"] for a in self._readings(left) for b in self._readings(right)), default=0) if left and right else 0

    def _shadow(self, read: str, right: str) -> bool:
        """Whether a known form stands only between words that have ``right`` beside them as often:
        no word of its own then, but one that many rows misread."""
        if (hit := self.shadows.get((read, right))) is None:
            seen = agreed = 0
            for pair, n in self._pairs_of(read) if self.s.words[right] >= self.s.words[read] else []:
                a, b = pair.split(" ")
                if a != b:
                    seen += n
                    agreed += n * (max(self.s.pairs[f"{x} {right}"] if b == read else self.s.pairs[f"{right} {x}"] for x in self._readings(a if b == read else b)) >= n)
            hit = self.shadows[read, right] = seen > 0 and agreed >= EDGE * seen
        return hit

    def _number(self, core: str, before: str | None, after: str | None) -> str | None:
        """The token with letters read back as digits, if that is what stands there."""
        digits = core.translate(DIGITS)
        prefix = re.match(r"[A-Z]-", core)
        if prefix:
            digits = core[:2] + core[2:].translate(DIGITS)
        if digits == core or not re.fullmatch(r"([A-Z]-)?[0-9][0-9.,]*", digits) or not self.s.words[shape(digits)]:
            return None
        have = self.s.words[shape(core)]
        if re.search(r"[0-9]", core) or prefix:
            return digits if self.s.words[shape(digits)] >= BETTER * have or self._shadow(shape(core), shape(digits)) else None
        # letters only: the words beside it must ask for a number
        asked = self.s.pairs[f"{self.s.form(before)} {shape(digits)}"] if before else 0
        named = self.s.pairs[f"{self.s.form(before)} {self.s.form(core)}"] if before else 0
        mixed = core != core.upper()
        return digits if len(core) >= 2 and asked and not have and (mixed and asked * 2 > named or asked >= BETTER * max(named, 0.5)) else None

    def word(self, token: str, before: str | None, after: str | None, names: frozenset[str]) -> str:
        """The word as it should read between its neighbours; ``names`` are right as they are."""
        if token.isdigit() or names and token.strip(_EDGE_MARKS) in names:
            return token
        key = (token, self.s.form(before) if before else None, self.s.form(after) if after else None)
        if (hit := self.read.get(key)) is None:
            if len(self.read) > 500_000:
                self.read.clear()
            hit = self.read[key] = self._word(token, before, after)
        return hit

    def _word(self, token: str, before: str | None, after: str | None) -> str:
        core = token.strip(_EDGE_MARKS)
        if not core:
            return token
        if (fixed := self._number(core, before, after)) is not None:
            return token.replace(core, fixed, 1)
        if not re.search(r"[a-z]", core) and len(core) < 6 or not re.search(r"[A-Za-z]", core) or re.fullmatch(r"[A-Z/-]*[0-9.]*[A-Z]?|[A-Z/-]+", core):
            return token
        have = self.s.words[shape(core)] if not re.search(r"[0-9]", core) else 0
        left, right = (self.s.form(t) if t else None for t in (before, after))
        left_own, right_own = (self.s.pairs[f"{left} {core}"] if left else 0), (self.s.pairs[f"{core} {right}"] if right else 0)
        best: tuple[float, str] | None = None
        for edits, minus, candidate in self._candidates(core):
            # a misread word may be common: the words beside it then show that it is none of its own
            sure = -minus < COMMONER * have and confused(candidate, core) and self._shadow(core, candidate)
            if -minus < COMMONER * have and not sure or core[0].islower() and candidate[0].isupper() or candidate[0].islower() and core[0].isupper() and core[1:].islower() and have:
                continue
            a = self.s.pairs[f"{left} {candidate}"] if left else 0
            b = self.s.pairs[f"{candidate} {right}"] if right else 0
            better = (a >= BETTER * max(left_own, 0.3)) + (b >= BETTER * max(right_own, 0.3))
            worse = (a < left_own) + (b < right_own)
            if sure:
                if max(a, self._beside(left, candidate)) < left_own or max(b, self._beside(candidate, right)) < right_own:
                    continue
            elif have and (better < (left is not None) + (right is not None) and (better < 1 or min(a, b) < BETTER * min(left_own, right_own)) or worse):
                continue
            if not have and not better and edits > max(1, len(core) // 4):
                continue
            score = 4.0 * better - edits + (1 if a and b else 0)
            if best is None or score > best[0]:
                best = (score, candidate)
        return token.replace(core, best[1], 1) if best else token

    def clean(self, text: str, names: frozenset[str] = frozenset()) -> tuple[str, set[str]]:
        """The text in continuous paragraphs and the kinds of noise found."""
        noise: set[str] = set()
        lines = lines_of(text)
        words = [ln.split() for ln in lines]
        dropped: set[int] = set()
        filled = [i for i, w in enumerate(words) if w]
        # lines that show what they are first, bare numbers after them: their neighbours are then known
        bare = {i for i in filled if len(words[i]) == 1 and words[i][0].isdigit()}
        for late in (False, True):
            for pos, i in enumerate(filled):
                if len(filled) == 1 or (i in bare) != late:
                    continue
                before = next((words[j][-1] for j in reversed(filled[:pos]) if j not in dropped), None)
                after = next((words[j][0] for j in filled[pos + 1 :] if j not in dropped and (late or j not in bare)), None)
                if kind := self.furniture(lines[i], before, after):
                    dropped.add(i)
                    noise.add(kind)
        paragraphs: list[list[str]] = [[]]
        open_end: str | None = None
        for i, tokens in enumerate(words):
            if i in dropped:
                continue
            if not tokens:
                # a blank line beside furniture is part of the page, not of the text
                beside = {i - 1, i + 1} & dropped
                if not beside and paragraphs[-1] and open_end is None:
                    paragraphs.append([])
                continue
            if open_end is not None and paragraphs[-1]:
                joined, broken = self.join(open_end, tokens[0])
                if broken:
                    noise.add("hyphenation")
                paragraphs[-1][-1] = joined
                tokens = tokens[1:]
            open_end = None
            if not tokens:
                continue
            paragraphs[-1] += tokens
            m = broken_at_end(lines[i])
            if m and i != filled[-1]:
                if paragraphs[-1][-1] in MARKS and len(paragraphs[-1]) > 1:
                    paragraphs[-1].pop()
                open_end = m.group(1)
                paragraphs[-1][-1] = open_end
        out = []
        for tokens in paragraphs:
            fixed: list[str] = []
            for k, t in enumerate(tokens):
                new = self.word(t, fixed[-1] if fixed else None, tokens[k + 1] if k + 1 < len(tokens) else None, names)
                if new != t:
                    noise.add("misread")
                    if self.log is not None:
                        self.log.append((t, new, fixed[-1] if fixed else None, tokens[k + 1] if k + 1 < len(tokens) else None))
                fixed.append(new)
            if fixed:
                out.append(" ".join(fixed))
        return "\n\n".join(out), noise


def clean_scans(df: DataFrame, key: str, text: str, names: str | None = None) -> DataFrame:
    """Each record's repaired text and the sorted kinds of noise found in it.

    ``names`` is an optional array column of names that may stand in the text. Null texts
    give an empty text without noise, empty ones too; texts are taken whole, equal rows
    alike, and every row comes out once.
    """
    spark = df.sparkSession
    shared = spark.sparkContext.broadcast(corpus_statistics(df, text))
    column = F.col(names) if names else F.array().cast("array<string>")
    rows = df.select(F.col(key).alias("__fw_key"), F.col(text).alias("__fw_text"), column.alias("__fw_names"))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        cleaner = Cleaner(shared.value)
        for frame in frames:
            done = [cleaner.clean(t, frozenset(n) if n is not None else frozenset()) if t is not None else ("", set()) for t, n in zip(frame["__fw_text"], frame["__fw_names"])]
            yield pd.DataFrame({"__fw_key": frame["__fw_key"], "repaired": [d[0] for d in done], "noise": [sorted(d[1]) for d in done]})

    kind = df.schema[key].dataType.simpleString()
    return rows.mapInPandas(run, f"__fw_key {kind}, repaired string, noise array<string>").withColumnRenamed("__fw_key", key)
