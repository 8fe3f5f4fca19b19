"""Text that was decoded with the wrong character encoding.

Characters are mapped back to the bytes of a legacy encoding, an automaton over the byte
classes of UTF-8 finds maximal well-formed multibyte spans, and only those spans are
decoded again, round after round, so that doubly garbled text comes out too. Two kinds of
damage leave no multibyte structure: single-byte text read in another single-byte
encoding, which is undone where the corpus knows the resulting word and hardly knows the
present one, or where several words of the corpus or of the record have the same cause,
and UTF-7 shifts. Replacement marks stand for characters that are lost.
"""

from __future__ import annotations

import base64
import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import collect_bounded, scratch_tables

#: Encodings that text is read in by mistake, one byte a character.
WRONG = ("cp1252", "latin_1", "iso8859_15", "cp437", "cp850", "mac_roman", "cp1251", "cp1250", "iso8859_2", "cp1254", "koi8_r", "cp866", "cp1253")
#: Those in whose own scripts letters alone are no sign of damage, unless Latin ones stand in the same word.
CAREFUL = frozenset(("koi8_r", "cp866", "cp1253"))
#: Encodings with one or two bytes a character.
DOUBLE = ("gb18030", "shift_jis", "euc_kr", "big5")
#: Pairs (read as, really) of single-byte encodings.
SINGLE = tuple((w, t) for w in ("cp437", "cp850", "mac_roman", "cp1252", "latin_1", "cp1251") for t in ("cp1252", "mac_roman", "cp437", "cp850") if w != t)
#: A word is known if it makes up this share of the corpus's words that aren't plain ASCII: at most 1 / share words.
KNOWN_SHARE = 1e-4
#: How many times more often the corpus must have the word that a single-byte reading gives.
RARER = 20
#: How many words of the corpus must be garbled alike for damage that is common itself.
SEVERAL = 3

REPLACED = "�"


def _back(codec: str) -> dict[int, int]:
    """Character to byte; bytes that the encoding leaves undefined stand for themselves."""
    out = {}
    for b in range(0x80, 0x100):
        try:
            out[ord(bytes([b]).decode(codec))] = b
        except UnicodeDecodeError:
            out[b] = b
    return out


class Codec:
    def __init__(self, name: str):
        self.name, self.back = name, _back(name)
        self.table = np.full(0x10000, -1, np.int16)
        self.table[:0x80] = np.arange(0x80)
        for char, byte in self.back.items():
            self.table[char] = byte
        # a span needs a byte that leads and one that follows
        self.leads = frozenset(chr(c) for c, b in self.back.items() if 0xC2 <= b <= 0xF4)
        self.tails = frozenset(chr(c) for c, b in self.back.items() if b <= 0xBF)


class DoubleCodec:
    """An encoding in which a character is one byte or two; a wide one may have swallowed a plain character."""

    def __init__(self, name: str):
        self.name = name

    def spans(self, text: str) -> list[tuple[int, int, str]]:
        """Start, end and decoded text of the maximal well-formed spans, in whole characters of ``text``."""
        made: list[int] = []
        owner: list[int] = []
        for i, c in enumerate(text):
            try:
                code = c.encode(self.name)
            except UnicodeEncodeError:
                code = b""
            code = code if 0 < len(code) < 3 else b""
            made += code or [-1]
            owner += [i] * max(len(code), 1)
        byte = np.array(made, np.int16)
        out = []
        for s, e in zip(*utf8_spans(byte)):
            if s and owner[s - 1] == owner[s]:
                continue
            # bytes of the last character beyond the span must be plain ones
            stop = e
            while stop < len(owner) and owner[stop] == owner[e - 1]:
                stop += 1
            rest = bytes(made[e:stop])
            if all(0x20 <= b < 0x80 for b in rest):
                out.append((owner[s], owner[stop - 1] + 1, bytes(made[s:e]).decode("utf-8") + rest.decode("ascii")))
        return out


def utf8_spans(byte: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of maximal runs of well-formed multibyte UTF-8 sequences; -1 is no byte.

    The automaton's states follow the byte classes: a lead byte opens a sequence of two to
    four bytes, E0, ED, F0 and F4 narrow the byte after them.
    """
    n = len(byte)
    size = np.zeros(n, np.int8)
    size[(byte >= 0xC2) & (byte <= 0xDF)] = 2
    size[(byte >= 0xE0) & (byte <= 0xEF)] = 3
    size[(byte >= 0xF0) & (byte <= 0xF4)] = 4
    tail = (byte >= 0x80) & (byte <= 0xBF)
    ahead = np.concatenate((byte, np.full(4, -1, byte.dtype)))
    more = np.concatenate((tail, np.zeros(4, bool)))
    good = np.zeros(n, bool)
    for length in (2, 3, 4):
        fit = size == length
        for k in range(1, length):
            fit &= more[k : k + n]
        good |= fit
    second = ahead[1 : 1 + n]
    good &= ~((byte == 0xE0) & (second < 0xA0) | (byte == 0xED) & (second > 0x9F) | (byte == 0xF0) & (second < 0x90) | (byte == 0xF4) & (second > 0x8F))
    start = np.flatnonzero(good)
    if not len(start):
        return start, start
    end = start + size[start]
    first = np.ones(len(start), bool)
    first[1:] = start[1:] != end[:-1]
    last = np.ones(len(start), bool)
    last[:-1] = first[1:]
    return start[first], end[last]


def _script(char: str) -> str:
    return unicodedata.name(char, "").split(" ")[0] if char.isalpha() else ""


def _natural(text: str, start: int, end: int, fixed: str) -> bool:
    """Whether the span reads as it stands: letters of one script that go on beside it,
    or a decoded text that no one would write."""
    if any(unicodedata.category(c) in ("Cn", "Co", "Cs") or c < " " for c in fixed):
        return True
    scripts = {_script(c) for c in text[start:end]}
    if scripts == {"LATIN"} and len(fixed) == 1 and not (fixed < "\u0250" or "\u2010" <= fixed < "\u2300"):
        # two accented letters in a row, which make no Latin letter and no sign
        return True
    if "" in scripts or len(scripts) != 1 or scripts == {"LATIN"} and len(text) > end and fixed.isalpha() is False:
        return False
    around = {_script(c) for c in (text[start - 1 : start] + text[end : end + 1])} - {""}
    return scripts != {"LATIN"} and around == scripts


class Repair:
    """Detects and repairs garbled words; picklable, and fast on words seen before."""

    def __init__(self, known: dict[str, int], least: int = 2, rounds: int = 3):
        self.known, self.least, self.rounds = known, least, rounds
        self.folded: dict[str, int] = {}
        for w, n in known.items():
            self.folded[w.lower()] = self.folded.get(w.lower(), 0) + n
        self.codecs = [Codec(c) for c in WRONG]
        self.doubles = [DoubleCodec(c) for c in DOUBLE]
        self.single = [(_back(w), t) for w, t in SINGLE]
        self.seen: dict[str, tuple[str, tuple[str, ...]]] = {}
        self.joint: dict[tuple[str, ...], int | None] = {}
        self.common = self._common()

    def _common(self) -> set[tuple[str, str]]:
        """Pairs of encodings under which several known words, alike but for their characters
        beyond ASCII, turn into commoner ones; the pair that has more words wins over its reverse."""
        alike: dict[tuple[str, str], set[str]] = {}
        for word, n in self.known.items():
            if not any(c.isascii() and c.isalnum() for c in word):
                continue
            for (back, true), pair in zip(self.single, SINGLE):
                new = self._read(word, back, true)
                if new is not None and new != word and self.known.get(new, 0) > n:
                    alike.setdefault(pair, set()).add(word)
        return {(w, t) for (w, t), words in alike.items() if len(words) >= SEVERAL and len(words) > len(alike.get((t, w), ()))}

    @staticmethod
    def _read(word: str, back: dict[int, int], true: str) -> str | None:
        """The word with its characters beyond ASCII read in the other encoding."""
        out = []
        for c in word:
            if ord(c) < 0x80:
                out.append(c)
            elif (b := back.get(ord(c))) is None:
                return None
            else:
                out.append(bytes([b]).decode(true, "replace"))
        return "".join(out)

    def count(self, word: str) -> int:
        return self.known.get(re.sub(r"[0-9]+", "9", word), 0)

    def fold(self, word: str) -> int:
        return self.folded.get(re.sub(r"[0-9]+", "9", word).lower(), 0)

    def readings(self, text: str) -> dict[str, int]:
        """The text with the spans of each legacy encoding decoded, and how many characters they held."""
        points = np.fromiter(map(ord, text), np.int64, len(text))
        points = np.where(points < 0x10000, points, 0xFFFF)
        found: dict[str, int] = {}
        for codec in self.codecs:
            if codec.leads.isdisjoint(text) or codec.tails.isdisjoint(text):
                continue
            byte = codec.table[points]
            out, at, gain = [], 0, 0
            for s, e in zip(*utf8_spans(byte)):
                fixed = bytes(byte[s:e].astype(np.uint8)).decode("utf-8")
                if _natural(text, s, e, fixed) or codec.name in CAREFUL and text[s:e].isalpha() and not re.search("[A-Za-z]", text):
                    continue
                out += [text[at:s], fixed]
                at, gain = e, gain + int(e - s)
            if gain:
                found.setdefault("".join([*out, text[at:]]), gain)
        if any(c >= "\u2e80" for c in text):
            for double in self.doubles:
                out, at, gain = [], 0, 0
                for s, e, fixed in double.spans(text):
                    if not self._foreign(text, s, e, fixed):
                        continue
                    out += [text[at:s], fixed]
                    at, gain = e, gain + 2 * (e - s)
                if gain:
                    found.setdefault("".join([*out, text[at:]]), gain)
        return found

    def _foreign(self, text: str, start: int, end: int, fixed: str) -> bool:
        """Whether wide characters stand where Latin letters and signs belong: in a word that has
        plain letters or digits beside them and goes on in no wide script, or where the corpus
        knows what they turn into."""
        if not all(c.isascii() or "\xa0" <= c < "\u0250" or "\u2010" <= c < "\u2300" for c in fixed):
            return False
        around = text[start - 1 : start] + text[end : end + 1]
        if any(c >= "\u2e80" for c in around):
            return False
        beside = any(c.isascii() and c.isalnum() for c in text[:start] + text[end:]) or any(c.isascii() and c.isalnum() for c in fixed)
        return beside or self.count(text[:start] + fixed + text[end:]) >= self.least

    def multibyte(self, text: str) -> str | None:
        """What the text was before one or more wrong readings; None if it has no span.

        The reading that the corpus knows best wins; without a known one, each round takes
        the encoding with the longest spans, and earlier encodings win ties.
        """
        known: list[tuple[int, int, str]] = []
        tried, level = {text}, [text]
        for depth in range(self.rounds):
            level = [r for t in level for r in self.readings(t)]
            level = [r for r in dict.fromkeys(level) if r not in tried]
            tried |= set(level)
            known += [(n, -depth, r) for r in level if (n := self.fold(r) if r == r.lower() else self.count(r)) >= self.least]
        if known:
            return max(known)[2]
        now = text
        for _ in range(self.rounds):
            if not (found := self.readings(now)):
                break
            now = max(found, key=found.get)
        return now if now != text else None

    def lowered(self, text: str) -> str | None:
        """As ``multibyte``, for garbled text that was put in lower case afterwards."""
        lifted = "".join(c.upper() if ord(c) > 0x7F and len(c.upper()) == 1 else c for c in text)
        if lifted == text:
            return None
        fixed = self.multibyte(lifted)
        return None if fixed is None else fixed.lower()

    def remapped(self, word: str) -> str | None:
        """A reading in another single-byte encoding that the corpus knows far better."""
        have, best = self.count(word), None
        anchored = any(c.isascii() and c.isalnum() for c in word)
        for (back, true), pair in zip(self.single, SINGLE):
            new = self._read(word, back, true)
            if new is None or new == word or (n := self.count(new)) < self.least:
                continue
            far = n >= RARER * max(have, 0.05)
            if (far or anchored and pair in self.common and n > have) and (best is None or n > best[0]):
                best = (n, new)
        return best and best[1]

    def together(self, words: tuple[str, ...]) -> int | None:
        """Which pair of encodings explains all words of a record: the corpus must know every
        reading no worse than the word as it is, and all together better."""
        if (hit := self.joint.get(words, -1)) != -1:
            return hit
        best: tuple[int, int] | None = None
        have = [self.count(w) for w in words]
        for i, (back, true) in enumerate(self.single):
            read = [self._read(w, back, true) for w in words]
            counts = [self.count(new) if new is not None and new != w else 0 for w, new in zip(words, read)]
            if all(n >= max(self.least, h) for n, h in zip(counts, have)) and sum(counts) > sum(have) and (best is None or sum(counts) > best[0]):
                best = (sum(counts), i)
        if len(self.joint) > 200_000:
            self.joint.clear()
        self.joint[words] = hit = best and best[1]
        return hit

    def shifted(self, text: str) -> str | None:
        """UTF-7 shifts undone where they hold whole characters beyond ASCII."""
        whole = text

        def undo(m: re.Match) -> str:
            code = m.group(1)
            bits = len(code) * 6 % 16
            if bits >= 6:
                return m.group()
            try:
                raw = base64.b64decode(code + "=" * (-len(code) % 4))
                got = raw[: len(raw) // 2 * 2].decode("utf-16-be")
            except (ValueError, UnicodeDecodeError):
                return m.group()
            if base64.b64encode(raw[: len(raw) // 2 * 2]).rstrip(b"=").decode() != code or not got:
                return m.group()
            if any(ord(c) < 0x80 or ord(c) > 0x2FFF or unicodedata.category(c) in ("Cn", "Co", "Cc") for c in got):
                return m.group()
            closed = m.group().endswith("-")
            return got if closed or self.count(text[: m.start()].rpartition(" ")[2] + got + text[m.end() :].partition(" ")[0]) else m.group()

        # closed shifts first: the words around the others are then as they were
        fixed = text
        for pattern in (r"\+([A-Za-z0-9+/]{3,})-", r"\+([A-Za-z0-9+/]{3,})"):
            text = fixed
            fixed = re.sub(pattern, undo, text)
        return fixed if fixed != whole else None

    def word(self, word: str) -> tuple[str, tuple[str, ...]]:
        """The restored word and the kinds of damage found in it."""
        if (hit := self.seen.get(word)) is not None:
            return hit
        now, kinds = word, []
        if not word.isascii():
            fixed, lowered = self.multibyte(word), self.lowered(word) if word == word.lower() else None
            have = RARER * self.count(word)
            # the lower-case reading needs the corpus on its side, or a word that isn't known and has no other;
            # two letters may well be a word
            if lowered is not None and (self.fold(lowered) > max(have, self.fold(fixed) if fixed else 0) or fixed is None and not have and not (len(word) == 2 and word.isalpha())):
                fixed = lowered
            if fixed is not None:
                now, kinds = fixed, ["multibyte"]
        if not kinds and not now.isascii() and (fixed := self.remapped(now)) is not None:
            now, kinds = fixed, ["single_byte"]
        if "+" in now and (fixed := self.shifted(now)) is not None:
            now = fixed
            kinds.append("utf7")
        if REPLACED in now:
            kinds.append("lost")
        if len(self.seen) > 200_000:
            self.seen.clear()
        self.seen[word] = hit = (now, tuple(dict.fromkeys(kinds)))
        return hit

    def text(self, text: str) -> tuple[str, list[str]]:
        if text.isascii() and "+" not in text:
            return text, []
        kinds: dict[str, None] = {}
        parts = re.split(r"([ \t\r\n]+)", text)
        bare: dict[int, str] = {}  # words without multibyte damage
        for i in range(0, len(parts), 2):
            if parts[i] and (not parts[i].isascii() or "+" in parts[i]):
                now, found = self.word(parts[i])
                if not parts[i].isascii() and found in ((), ("single_byte",)):
                    bare[i] = parts[i]
                parts[i] = now
                kinds |= dict.fromkeys(found)
        words = tuple(dict.fromkeys(re.sub(r"[0-9]+", "9", w) for w in bare.values()))
        if len(words) > 1 and (pair := self.together(words)) is not None:
            for i, w in bare.items():
                parts[i] = self._read(w, *self.single[pair])
            kinds["single_byte"] = None
        return "".join(parts), list(kinds)


def known_words(df: DataFrame, text: str, share: float = KNOWN_SHARE) -> dict[str, int]:
    """Counts of the words beyond ASCII (digits as one 9) with at least ``share`` of all of them.

    Counted over distinct texts, so that copies don't count; no more than 1 / share words can
    have such a share, which bounds what comes to the driver.
    """
    words = df.where(F.col(text).rlike(r"[^\x00-\x7f]")).select(text).distinct().select(F.explode(F.split(text, r"[ \t\r\n]+")).alias("w"))
    counts = words.where(F.col("w").rlike(r"[^\x00-\x7f]")).groupBy(F.regexp_replace("w", "[0-9]+", "9").alias("w")).agg(F.count("*").alias("n"))
    with scratch_tables(df.sparkSession) as keep:
        counts = keep(counts, "word-counts")  # used twice
        total = counts.agg(F.sum("n").alias("n")).first().n or 0
        kept = counts.where((F.col("n") >= 2) & (F.col("n") >= total * share))
        return {r.w: r.n for r in collect_bounded(kept, int(1 / share) + 1, "known words")}


def repair_encoding(df: DataFrame, key: str, text: str, share: float = KNOWN_SHARE) -> DataFrame:
    """Rows whose ``text`` is garbled: key, ``text``, ``restored``, ``kinds`` and whether it is ``complete``.

    ``kinds`` are ``multibyte``, ``single_byte``, ``utf7`` and ``lost`` (replacement marks,
    which leave the text incomplete). Null, empty and plain texts give no rows; texts are
    taken whole; a row that occurs again comes out again; an empty table gives none.
    """
    spark = df.sparkSession
    tool = spark.sparkContext.broadcast(known_words(df, text, share))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        repair = Repair(tool.value)
        for frame in frames:
            rows = []
            for k, t in zip(frame["__fw_key"], frame["__fw_text"]):
                fixed, kinds = repair.text(t)
                if kinds:
                    rows.append((k, t, fixed, sorted(kinds), "lost" not in kinds))
            yield pd.DataFrame(rows, columns=["__fw_key", text, "restored", "kinds", "complete"])

    touched = F.col(text).rlike(r"[^\x00-\x7f]|\+[A-Za-z0-9+/]{3}")
    rows = df.where(touched).select(F.col(key).alias("__fw_key"), F.col(text).alias("__fw_text"))
    kind = df.schema[key].dataType.simpleString()
    out = rows.mapInPandas(run, f"__fw_key {kind}, `{text}` string, restored string, kinds array<string>, complete boolean")
    return out.withColumnRenamed("__fw_key", key)
