"""Rules as a table of words: all of them are sought in one pass over a text.

The words of all rules make one automaton: a trie whose nodes also know where to go on when the next
letter doesn't fit, the longest suffix that is a node, too. It is built once for each task. A rule
matches where any of its words is part of the lower-cased text, be it within other words.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

Rules = Sequence[tuple[str, Sequence[str]]]


class Automaton:
    """Nodes by number: where each letter leads, where to go on without one, and the rules that end there."""

    def __init__(self, rules: Rules):
        self.steps: list[dict[str, int]] = [{}]
        self.rules: list[frozenset[int]] = [frozenset()]
        for k, (_, words) in enumerate(rules):
            for word in words:
                at = 0
                for c in word:
                    if c not in self.steps[at]:
                        self.steps[at][c] = len(self.steps)
                        self.steps.append({})
                        self.rules.append(frozenset())
                    at = self.steps[at][c]
                self.rules[at] |= {k}
        self.back = [0] * len(self.steps)
        todo = deque(self.steps[0].values())
        while todo:  # by depth, so that shorter suffixes are known
            node = todo.popleft()
            for c, child in self.steps[node].items():
                at = self.back[node]
                while at and c not in self.steps[at]:
                    at = self.back[at]
                self.back[child] = self.steps[at].get(c, 0)
                self.rules[child] |= self.rules[self.back[child]]
                todo.append(child)

    def matched(self, text: str) -> set[int]:
        """The numbers of all rules that match."""
        at, found = 0, set(self.rules[0])
        steps, back, rules = self.steps, self.back, self.rules
        for c in text:
            while at and c not in steps[at]:
                at = back[at]
            at = steps[at].get(c, 0)
            if rules[at]:
                found |= rules[at]
        return found


def matched(c: Column, rules: Rules) -> Column:
    """The names of the rules that match, in the order of the table; none for a null text but those
    with an empty word."""
    names = [name for name, _ in rules]

    @F.pandas_udf("array<string>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        automaton = Automaton(rules)
        for batch in batches:
            yield pd.Series([[names[k] for k in sorted(automaton.matched(t or ""))] for t in batch], dtype=object)

    return run(F.lower(c))


def first_of(names: Column, kinds: Sequence[str], default: str) -> Column:
    """The first of the kinds that is among the names of rules that match."""
    return F.coalesce(*(F.when(F.array_contains(names, k), F.lit(k)) for k in kinds), F.lit(default))
