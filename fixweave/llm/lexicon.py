"""A vocabulary trie and its intersection with Levenshtein automata."""

from __future__ import annotations


class Trie:
    """Words by their letters; each node maps a letter to the next node, "" to the word's count."""

    def __init__(self, counts: dict[str, int]):
        self.root: dict = {}
        for word, n in counts.items():
            node = self.root
            for letter in word:
                node = node.setdefault(letter, {})
            node[""] = n

    def within(self, word: str, most: int) -> dict[str, int]:
        """Every word at most ``most`` edits away, with its distance.

        The automaton's state after a prefix is its row of edit distances, cut off above
        ``most``; trie and automaton advance together, and a branch ends where the row has
        no live entry, so that nothing within reach is missed and no other word is visited.
        """
        found: dict[str, int] = {}
        cap = most + 1
        start = [min(i, cap) for i in range(len(word) + 1)]
        stack = [(self.root, "", start)]
        while stack:
            node, prefix, row = stack.pop()
            if "" in node and row[-1] <= most:
                found[prefix] = row[-1]
            for letter, child in node.items():
                if not letter:
                    continue
                previous = row[0] + 1
                state = [previous if previous < cap else cap]
                live = previous <= most
                for i, own in enumerate(word, 1):
                    best = row[i - 1] if own == letter else min(row[i - 1], row[i], state[-1]) + 1
                    best = best if best < cap else cap
                    state.append(best)
                    live = live or best <= most
                if live:
                    stack.append((child, prefix + letter, state))
        return found
