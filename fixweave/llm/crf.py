"""A linear-chain conditional random field in numpy: training and batched Viterbi decoding."""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np

OFFSETS = (-3, -2, -1, 0, 1, 2, 3)
NEVER = -1e4


class Chain:
    """Features of a token and of those around it score its label; labels score their successor.

    ``features(token)`` gives the names of a token's features. Weights hold for a feature at
    an offset, so a token's scores are a sum of one table row per offset and unique token.
    """

    def __init__(self, labels: Sequence[str], features: Callable[[str], list[str]]):
        self.labels, self.features = list(labels), features
        n = len(self.labels)
        self.step = np.zeros((n, n))
        self.first = np.zeros(n)
        for j, b in enumerate(self.labels):
            if b.startswith("I-"):
                self.first[j] = NEVER
                for i, a in enumerate(self.labels):
                    if a[2:] != b[2:]:
                        self.step[i, j] = NEVER
        self.allowed = self.step > NEVER / 2
        self.column: dict[str, int] = {}
        self.weight = np.zeros((len(OFFSETS), 0, n))

    # scores

    def _matrix(self, tokens: Sequence[str], grow: bool = False) -> tuple[np.ndarray, np.ndarray]:
        rows, columns = [], []
        for i, t in enumerate(tokens):
            for f in self.features(t):
                k = self.column.setdefault(f, len(self.column)) if grow else self.column.get(f)
                if k is not None:
                    rows.append(i)
                    columns.append(k)
        return np.array(rows, np.int64), np.array(columns, np.int64)

    def token_scores(self, tokens: Sequence[str]) -> np.ndarray:
        """Scores (offset, token, label) of unique tokens; the last row stands for no token."""
        rows, columns = self._matrix(tokens)
        out = np.zeros((len(OFFSETS), len(tokens) + 1, len(self.labels)))
        for o in range(len(OFFSETS)):
            for k in range(len(self.labels)):
                out[o, :-1, k] = np.bincount(rows, self.weight[o, columns, k], len(tokens))
        return out

    @staticmethod
    def emissions(scores: np.ndarray, padded: np.ndarray) -> np.ndarray:
        """Scores (sequence, place, label) of sequences of token numbers padded with -1."""
        wide = np.pad(padded, ((0, 0), (3, 3)), constant_values=-1)
        width = padded.shape[1]
        return sum(scores[i, wide[:, 3 + o : 3 + o + width]] for i, o in enumerate(OFFSETS))

    # training

    def fit(self, sequences: Sequence[Sequence[str]], tags: Sequence[Sequence[str]], rounds: int = 60, decay: float = 0.7) -> Chain:
        """Maximum penalised likelihood over all sequences, by L-BFGS."""
        unique = sorted({t for s in sequences for t in s})
        at = {t: i for i, t in enumerate(unique)}
        label = {x: i for i, x in enumerate(self.labels)}
        rows, columns = self._matrix(unique, grow=True)
        m, n = len(self.column), len(self.labels)
        design = np.zeros((len(unique), m), np.float32)
        design[rows, columns] = 1.0
        width = max(map(len, sequences))
        order = sorted(range(len(sequences)), key=lambda i: -len(sequences[i]))
        padded = np.full((len(sequences), width), -1)
        gold = np.zeros((len(sequences), width), np.int64)
        for r, i in enumerate(order):
            padded[r, : len(sequences[i])] = [at[t] for t in sequences[i]]
            gold[r, : len(tags[i])] = [label[x] for x in tags[i]]
        there = padded >= 0
        # all real places in a row, by place and then by sequence: no work is done for padding
        alive = there.sum(axis=0)
        begin = np.concatenate(([0], np.cumsum(alive)))
        flat = np.concatenate([padded[: alive[t], t] for t in range(width)])
        truth = np.concatenate([gold[: alive[t], t] for t in range(width)])
        place = np.zeros(padded.shape, np.int64)
        for t in range(width):
            place[: alive[t], t] = begin[t] + np.arange(alive[t])
        wide = np.pad(padded, ((0, 0), (3, 3)), constant_values=-1)
        near = [np.concatenate([wide[: alive[t], 3 + o + t] for t in range(width)]) for o in OFFSETS]
        one = np.eye(n, dtype=np.float32)[truth]
        pair = np.zeros((n, n))
        for t in range(1, width):
            pair += one[begin[t - 1] : begin[t - 1] + alive[t]].T @ one[begin[t] : begin[t + 1]]
        sizes = (len(OFFSETS) * m * n, n * n, n)
        gathers = [np.argsort(x, kind="stable") for x in near]

        def spread(gap: np.ndarray, i: int) -> np.ndarray:
            """Sums of the rows of ``gap`` by the token at offset ``i``."""
            rank = gathers[i]
            keys = near[i][rank]
            heads = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
            out = np.zeros((len(unique) + 1, n), np.float32)
            out[keys[heads]] = np.add.reduceat(gap[rank], heads, axis=0)
            return out[:-1]  # no token counts in the last row

        def value(x: np.ndarray) -> tuple[float, np.ndarray]:
            weight = x[: sizes[0]].reshape(len(OFFSETS), m, n)
            step = np.where(self.allowed, x[sizes[0] : sizes[0] + sizes[1]].reshape(n, n), NEVER)
            first = np.where(self.first > NEVER / 2, x[sizes[0] + sizes[1] :], NEVER)
            emission = np.zeros((len(flat), n), np.float32)
            for i in range(len(OFFSETS)):
                score = np.zeros((len(unique) + 1, n), np.float32)
                score[:-1] = design @ weight[i].astype(np.float32)
                emission += score[near[i]]
            unary, pairs, normal = self._marginals(emission, begin, alive, step, first)
            gap = one - unary
            grad = np.empty_like(x)
            held = grad[: sizes[0]].reshape(len(OFFSETS), m, n)
            for i in range(len(OFFSETS)):
                held[i] = design.T @ spread(gap, i)
            grad[sizes[0] : sizes[0] + sizes[1]] = ((pair - pairs) * self.allowed).ravel()
            grad[sizes[0] + sizes[1] :] = gap[: alive[0]].sum(axis=0)
            like = float((emission * one).sum(dtype=np.float64)) + float((step * pair).sum()) + float((first * one[: alive[0]].sum(axis=0)).sum()) - normal
            return decay / 2 * float(x @ x) - like, decay * x - grad

        x = lbfgs(value, np.zeros(sum(sizes)), rounds)
        self.weight = x[: sizes[0]].reshape(len(OFFSETS), m, n)
        self.step = np.where(self.allowed, x[sizes[0] : sizes[0] + sizes[1]].reshape(n, n), NEVER)
        self.first = np.where(self.first > NEVER / 2, x[sizes[0] + sizes[1] :], NEVER)
        return self

    @staticmethod
    def _marginals(emission: np.ndarray, begin: np.ndarray, alive: np.ndarray, step: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
        """Label probabilities of each place, expected label pairs and the log of the normalisers,
        by the forward-backward recursion with scaled probabilities. Places lie one after the
        other, and of each the sequences that reach it, longest first."""
        top = emission.max(axis=1, keepdims=True)
        local = np.exp(emission - top).astype(np.float64)
        go, width = np.exp(step), len(alive)
        ahead = np.empty_like(local)
        normal = float(top.sum(dtype=np.float64))
        now = local[: alive[0]] * np.exp(first)
        for t in range(width):
            if t:
                now = (ahead[begin[t - 1] : begin[t - 1] + alive[t]] @ go) * local[begin[t] : begin[t + 1]]
            scale = now.sum(axis=1, keepdims=True)
            normal += float(np.log(scale).sum())
            ahead[begin[t] : begin[t + 1]] = now / scale
        back = np.ones_like(local)
        pairs = np.zeros_like(go)
        for t in range(width - 1, 0, -1):
            onward = local[begin[t] : begin[t + 1]] * back[begin[t] : begin[t + 1]]
            grown = onward @ go.T
            before = ahead[begin[t - 1] : begin[t - 1] + alive[t]]
            pairs += ((before / (before * grown).sum(axis=1, keepdims=True)).T @ onward) * go
            back[begin[t - 1] : begin[t - 1] + alive[t]] = grown / grown.sum(axis=1, keepdims=True)
        unary = ahead * back
        return (unary / unary.sum(axis=1, keepdims=True)).astype(np.float32), pairs, normal

    # decoding

    def decode(self, numbers: Sequence[np.ndarray], scores: np.ndarray, together: int = 256) -> list[np.ndarray]:
        """The best labels of each sequence of token numbers, by Viterbi over batches of like length."""
        out: list[np.ndarray] = [np.zeros(0, np.int64)] * len(numbers)
        order = sorted((i for i in range(len(numbers)) if len(numbers[i])), key=lambda i: -len(numbers[i]))
        start = 0
        while start < len(order):
            # the padded block stays within a few million places however long a text is
            width = len(numbers[order[start]])
            block = order[start : start + max(1, min(together, 400_000 // width))]
            start += len(block)
            padded = np.full((len(block), width), -1)
            for r, i in enumerate(block):
                padded[r, : len(numbers[i])] = numbers[i]
            emission = self.emissions(scores, padded)
            alive = (padded >= 0).sum(axis=0)
            best = emission[:, 0] + self.first
            came = np.zeros((len(block), width, len(self.labels)), np.int8)
            for t in range(1, width):
                a = alive[t]
                total = best[:a, :, None] + self.step
                came[:a, t] = total.argmax(axis=1)
                best[:a] = total.max(axis=1) + emission[:a, t]
            now = best.argmax(axis=1)
            path = np.zeros((len(block), width), np.int64)
            length = (padded >= 0).sum(axis=1)
            rows = np.arange(len(block))
            for t in range(width - 1, -1, -1):
                inside = t < length
                path[:, t] = np.where(inside, now, 0)
                now = np.where(inside & (t > 0), came[rows, t, now], now)
            for r, i in enumerate(block):
                out[i] = path[r, : len(numbers[i])]
        return out


def lbfgs(value: Callable[[np.ndarray], tuple[float, np.ndarray]], x: np.ndarray, rounds: int, memory: int = 8) -> np.ndarray:
    """Minimises ``value`` (which gives the gradient too) with a limited-memory quasi-Newton method."""
    f, g = value(x)
    past: list[tuple[np.ndarray, np.ndarray, float]] = []
    for _ in range(rounds):
        q, alphas = g.copy(), []
        for s, y, rho in reversed(past):
            alphas.append(rho * (s @ q))
            q -= alphas[-1] * y
        if past:
            s, y, _ = past[-1]
            q *= (s @ y) / (y @ y)
        else:
            q /= max(float(np.abs(g).sum()), 1e-12)
        for (s, y, rho), alpha in zip(past, reversed(alphas)):
            q += (alpha - rho * (y @ q)) * s
        slope, length = float(g @ q), 1.0
        while True:
            new = x - length * q
            nf, ng = value(new)
            if nf <= f - 1e-4 * length * slope or length < 1e-6:
                break
            length /= 2
        s, y = new - x, ng - g
        done = abs(f - nf) < 1e-6 * max(1.0, abs(f))
        x, f, g = new, nf, ng
        if float(s @ y) > 1e-10:
            past = [*past, (s, y, 1.0 / float(s @ y))][-memory:]
        if done:
            break
    return x
