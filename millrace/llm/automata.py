"""Probabilistic automata inferred from examples by merging compatible states of their prefix tree."""

from __future__ import annotations

import math
from dataclasses import dataclass

FLOOR = 1e-4  # probability of a symbol never seen in a state


@dataclass(frozen=True)
class Automaton:
    """``steps[state][symbol]`` is the next state and the step's log-probability in bits; ``ends[state]`` that of stopping."""

    steps: list[dict[str, tuple[int, float]]]
    ends: list[float]

    def bits(self, word: str) -> float:
        """Mean log-probability per symbol, the stop included; behind an unseen symbol the walk goes on from the start."""
        state, total, missing = 0, 0.0, math.log2(FLOOR)
        for symbol in word:
            step = self.steps[state].get(symbol)
            state, cost = step if step else (0, missing)
            total += cost
        return (total + self.ends[state]) / (len(word) + 1)


class _Tree:
    """Prefix tree with counts; states are numbers."""

    def __init__(self, words: list[str]):
        self.arrived, self.stopped = [0], [0]
        self.next: list[dict[str, int]] = [{}]
        self.uses: list[dict[str, int]] = [{}]
        for word in words:
            at = 0
            self.arrived[0] += 1
            for symbol in word:
                to = self.next[at].get(symbol)
                if to is None:
                    to = self.next[at][symbol] = len(self.next)
                    self.next.append({})
                    self.uses.append({})
                    self.arrived.append(0)
                    self.stopped.append(0)
                self.uses[at][symbol] = self.uses[at].get(symbol, 0) + 1
                self.arrived[to] += 1
                at = to
            self.stopped[at] += 1

    def agree(self, a: int, b: int, spread: float) -> bool:
        """Hoeffding's test for every symbol and for stopping, and so on for what follows in the tree below ``b``."""
        todo = [(a, b)]
        while todo:
            a, b = todo.pop()
            n, m = self.arrived[a], self.arrived[b]
            if not n or not m:
                continue
            most = spread * (1 / math.sqrt(n) + 1 / math.sqrt(m))
            if abs(self.stopped[a] / n - self.stopped[b] / m) > most:
                return False
            for symbol in self.uses[a].keys() | self.uses[b].keys():
                if abs(self.uses[a].get(symbol, 0) / n - self.uses[b].get(symbol, 0) / m) > most:
                    return False
            todo += [(self.next[a][s], self.next[b][s]) for s in self.next[b] if s in self.next[a]]
        return True

    def fold(self, into: int, tree: int) -> None:
        """Add the counts of the tree below ``tree`` to the automaton from ``into`` on."""
        todo = [(into, tree)]
        while todo:
            a, b = todo.pop()
            self.arrived[a] += self.arrived[b]
            self.stopped[a] += self.stopped[b]
            for symbol, to in self.next[b].items():
                self.uses[a][symbol] = self.uses[a].get(symbol, 0) + self.uses[b][symbol]
                if symbol in self.next[a]:
                    todo.append((self.next[a][symbol], to))
                else:
                    self.next[a][symbol] = to


def infer(words: list[str], alpha: float = 0.05) -> Automaton:
    """Merge states that are statistically compatible at level ``alpha``, from the root outwards.

    Settled states are visited in order; each state next to them is merged into the first settled state it agrees with, or is
    settled itself.
    """
    tree = _Tree(sorted(words))
    spread = math.sqrt(0.5 * math.log(2 / alpha))
    settled, waiting = [0], [(0, s) for s in sorted(tree.next[0])]
    known = {0}
    while waiting:
        at, symbol = waiting.pop(0)
        state = tree.next[at][symbol]
        if state in known:
            continue
        for other in settled:
            if tree.agree(other, state, spread):
                tree.next[at][symbol] = other
                tree.fold(other, state)
                # folding can bring new followers to any settled state
                waiting = [(s, c) for s in settled for c in sorted(tree.next[s]) if tree.next[s][c] not in known]
                break
        else:
            settled.append(state)
            known.add(state)
            waiting += [(state, c) for c in sorted(tree.next[state])]
    number = {s: i for i, s in enumerate(settled)}
    steps, ends = [], []
    for s in settled:
        n = tree.arrived[s]
        steps.append({c: (number[to], math.log2(max(FLOOR, tree.uses[s][c] / n))) for c, to in tree.next[s].items()})
        ends.append(math.log2(max(FLOOR, tree.stopped[s] / n)))
    return Automaton(steps, ends)
