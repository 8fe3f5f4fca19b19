"""A vectorised structural index over many JSON texts at once.

The texts of a batch are laid end to end in one byte buffer. Bitmaps mark quotes that
are not escaped, prefix sums of them tell strings from structure, prefix sums of the
brackets outside strings give the nesting depth, and a stable sort by depth gives every
token its container. No text is parsed one by one.
"""

from __future__ import annotations

import json
import re

import numpy as np

OBJ, OBJ_END, ARR, ARR_END, COMMA, COLON, STRING, SCALAR = range(8)
_KIND = np.full(256, -1, np.int8)
for _char, _kind in zip(b"{}[],:", (OBJ, OBJ_END, ARR, ARR_END, COMMA, COLON)):
    _KIND[_char] = _kind
_SPACE = np.zeros(256, bool)
_SPACE[list(b" \t\n\r")] = True
_ESCAPE = np.zeros(256, bool)
_ESCAPE[list(b'"\\/bfnrtu')] = True
_HEX = np.zeros(256, bool)
_HEX[list(b"0123456789abcdefABCDEF")] = True
_LITERAL = re.compile(rb"true|false|null|-?(0|[1-9][0-9]*)(\.[0-9]+)?([eE][+-]?[0-9]+)?")


def _followers() -> tuple[np.ndarray, np.ndarray]:
    """Which token may follow which, inside an object and inside an array."""
    value, done = (OBJ, ARR, STRING, SCALAR), (OBJ_END, ARR_END, STRING, SCALAR)
    in_obj, in_arr = np.zeros((8, 8), bool), np.zeros((8, 8), bool)
    in_obj[OBJ, [STRING, OBJ_END]] = in_obj[COMMA, STRING] = in_obj[STRING, COLON] = True
    in_obj[COLON, value] = True
    in_arr[ARR, [*value, ARR_END]] = True
    in_arr[COMMA, value] = True
    for table, end in ((in_obj, OBJ_END), (in_arr, ARR_END)):
        table[np.ix_(done, (COMMA, end))] = True
    return in_obj, in_arr


_IN_OBJ, _IN_ARR = _followers()


def _last_where(mark: np.ndarray) -> np.ndarray:
    """For each place the last place so far with a mark, or -1."""
    return np.maximum.accumulate(np.where(mark, np.arange(len(mark)), -1))


class StructuralIndex:
    """Tokens of all ``texts`` (bytes, UTF-8) in order.

    ``kind doc start end`` of each token; ``parent`` is the token that opens its container
    (-1 at the root), ``key`` the string that names a value in an object (-1 elsewhere),
    ``close`` the token that closes a bracket, and ``ok`` says of each text whether it is
    one well-formed JSON object or array.
    """

    def __init__(self, texts: list[bytes]):
        self.n_docs = len(texts)
        self.raw = b"\x00".join(texts) + b"\x00"
        buf = self.buf = np.frombuffer(self.raw, np.uint8)
        sizes = np.fromiter((len(t) + 1 for t in texts), np.int64, len(texts))
        begin = np.concatenate(([0], np.cumsum(sizes)[:-1])) if len(texts) else np.zeros(0, np.int64)
        bad = np.zeros(self.n_docs, bool)
        if not self.n_docs:
            buf = self.buf = np.zeros(0, np.uint8)

        # quotes: a backslash run of odd length escapes the byte after it
        place = np.arange(len(buf))
        slash = buf == 0x5C
        run = place - _last_where(~slash)
        after = np.zeros(len(buf), bool)
        after[1:] = slash[:-1] & (run[:-1] % 2 == 1)
        quote = (buf == 0x22) & ~(after & ~slash)
        opened = np.cumsum(quote)
        doc_of_byte = np.repeat(np.arange(self.n_docs), sizes)
        before = np.concatenate(([0], opened))[begin] if self.n_docs else begin
        inside = ((opened - before[doc_of_byte]) % 2).astype(bool)  # the opening quote counts, the closing doesn't
        open_quote, close_quote = quote & inside, quote & ~inside
        body = inside & ~quote

        # strings must hold no control characters and only known escapes; none may stay open
        ends = begin + sizes - 1
        bad |= inside[ends] if self.n_docs else bad
        bad[doc_of_byte[body & (buf < 0x20) & (place != np.repeat(ends, sizes))]] = True
        escaped = np.flatnonzero(after & body | after & quote)
        escaped = escaped[~(slash[escaped] & (run[escaped] % 2 == 1))] if len(escaped) else escaped
        bad[doc_of_byte[escaped[~_ESCAPE[buf[escaped]]]]] = True
        unicode_ = escaped[buf[escaped] == 0x75]
        for k in range(1, 5):
            at = np.minimum(unicode_ + k, len(buf) - 1)
            bad[doc_of_byte[unicode_[~_HEX[buf[at]]]]] = True

        # tokens: structure, strings and runs of other bytes outside strings
        outside = ~inside & ~quote
        kind = np.where(outside, _KIND[buf], -1)
        other = outside & (kind < 0) & ~_SPACE[buf] & (place != np.repeat(ends, sizes) if self.n_docs else outside)
        first = other.copy()
        first[1:] &= ~other[:-1]
        last = other.copy()
        last[:-1] &= ~other[1:]
        kind[open_quote], kind[first] = STRING, SCALAR
        token = np.flatnonzero(kind >= 0)
        self.kind, self.doc, self.start = kind[token], doc_of_byte[token], token
        self.end = token + 1
        strings, scalars = np.flatnonzero(self.kind == STRING), np.flatnonzero(self.kind == SCALAR)
        closing = np.flatnonzero(close_quote)
        closed = np.searchsorted(closing, self.start[strings])
        self.end[strings] = np.where(closed < len(closing), closing[np.minimum(closed, max(len(closing) - 1, 0))] + 1 if len(closing) else 0, len(buf))
        self.end[scalars] = np.flatnonzero(last) + 1
        self._containers(bad)
        known: dict[bytes, bool] = {}
        for t in scalars:
            text = self.raw[self.start[t] : self.end[t]]
            good = known.get(text)
            if good is None:
                good = known[text] = _LITERAL.fullmatch(text) is not None
            if not good:
                bad[self.doc[t]] = True
        self.ok = ~bad

    def _containers(self, bad: np.ndarray) -> None:
        kind, doc, n = self.kind, self.doc, len(self.kind)
        opens, closes = (kind == OBJ) | (kind == ARR), (kind == OBJ_END) | (kind == ARR_END)
        step = opens.astype(np.int64) - closes
        total = np.cumsum(step)
        new_doc = np.ones(n, bool)
        new_doc[1:] = doc[1:] != doc[:-1]
        heads = np.flatnonzero(new_doc)
        base = np.repeat((total - step)[heads], np.diff(np.concatenate((heads, [n]))))
        depth = total - base  # after the token
        level = depth + closes  # of the container that a bracket opens or closes, or that holds the token
        bad[doc[depth < 0]] = True
        tails = np.concatenate((heads[1:], [n]))[: len(heads)] - 1
        bad[doc[tails[depth[tails] != 0]]] = True
        bad[doc[heads[~opens[heads]]]] = True
        seen = np.zeros(len(bad), bool)
        seen[doc] = True
        bad |= ~seen
        ended = (depth <= 0) & ~np.isin(np.arange(n), tails)
        bad[doc[ended]] = True

        # the last opener of the same level: its own bracket for a closer, the container for the rest
        order = np.lexsort((np.arange(n), level, doc))
        group = np.ones(n, bool)
        group[1:] = (doc[order][1:] != doc[order][:-1]) | (level[order][1:] != level[order][:-1])
        head = np.maximum.accumulate(np.where(group, np.arange(n), 0)) if n else order
        opener = _last_where(opens[order])
        owner = np.full(n, -1)
        owner[order] = np.where(opener >= head, order[np.maximum(opener, 0)], -1)
        pair = np.flatnonzero(closes & (owner >= 0))
        self.close = np.full(n, -1)
        self.close[owner[pair]] = pair
        bad[doc[pair[kind[pair] != kind[owner[pair]] + 1]]] = True
        bad[doc[closes & (owner < 0)]] = True

        # an opener's own container is the one that was open before it
        self.parent = owner.copy()
        inner = np.concatenate(([-1], np.where(opens, np.arange(n), -1)))[:-1]  # token before, if it opens
        self.parent[closes] = -1
        self.parent[opens] = self._enclosing(np.flatnonzero(opens), owner, depth, order, doc, inner)

        # grammar of neighbours: their container is the one open after the first
        around = np.where(opens, np.arange(n), np.where(closes, np.where(owner >= 0, self.parent[np.maximum(owner, 0)], -1), owner))
        in_obj = (around >= 0) & (kind[np.maximum(around, 0)] == OBJ)
        ok = np.where(in_obj[:-1], _IN_OBJ[kind[:-1], kind[1:]], _IN_ARR[kind[:-1], kind[1:]]) | new_doc[1:]
        bad[doc[:-1][~ok]] = True
        before = np.concatenate(([COMMA], kind[:-1])) if n else kind
        held = (self.parent >= 0) & (kind[np.maximum(self.parent, 0)] == OBJ)
        self.is_key = (kind == STRING) & held & ((before == OBJ) | (before == COMMA)) & ~new_doc
        wrong = self.is_key[:-1] != (kind[1:] == COLON)
        bad[doc[:-1][wrong & (kind[:-1] == STRING) & ~new_doc[1:]]] = True
        value = held & ~self.is_key & (opens | (kind == STRING) | (kind == SCALAR))
        self.key = np.where(value, np.arange(n) - 2, -1)
        self.opens, self.value = opens, (opens | (kind == SCALAR) | (kind == STRING)) & ~self.is_key

    @staticmethod
    def _enclosing(at: np.ndarray, owner: np.ndarray, depth: np.ndarray, order: np.ndarray, doc: np.ndarray, inner: np.ndarray) -> np.ndarray:
        """Container of each opener: the last opener one level up, before it in its text."""
        if not len(at):
            return at
        lead = depth[at]
        rank = np.lexsort((at, lead, doc[at]))
        keys = doc[at][rank] * (lead.max() + 2) + lead[rank]  # sorted, and within equal keys by place
        wide = len(owner) + 1
        found = np.searchsorted(keys * wide + at[rank], (doc[at] * (lead.max() + 2) + lead - 1) * wide + at) - 1
        parent = at[rank][np.maximum(found, 0)]
        right = (found >= 0) & (doc[parent] == doc[at]) & (depth[parent] == lead - 1)
        return np.where(right, parent, -1)

    def text(self, token: int) -> str | None:
        """A string's characters, a scalar's own text; null is None."""
        raw = self.raw[self.start[token] : self.end[token]]
        if raw[:1] == b'"':
            return json.loads(raw) if b"\\" in raw else raw[1:-1].decode("utf-8", "replace")
        return None if raw == b"null" else raw.decode("utf-8", "replace")

    def named(self, name: str) -> np.ndarray:
        """Whether each token is a value under the key ``name``."""
        want = json.dumps(name, ensure_ascii=False).encode()
        keys = np.flatnonzero(self.is_key)
        match = self.end[keys] - self.start[keys] == len(want)
        keys_fit = keys[match]
        same = np.ones(len(keys_fit), bool)
        for i, b in enumerate(want):
            same &= self.buf[self.start[keys_fit] + i] == b
        hit = np.zeros(len(self.kind), bool)
        hit[keys_fit[same]] = True
        # a key written with escapes
        slow = keys[~match]
        slow = slow[[b"\\" in self.raw[self.start[k] : self.end[k]] for k in slow]] if len(slow) and b"\\u" in self.raw else slow[:0]
        for k in slow:
            if self.ok[self.doc[k]] and self.text(k) == name:
                hit[k] = True
        return (self.key >= 0) & hit[np.maximum(self.key, 0)]
