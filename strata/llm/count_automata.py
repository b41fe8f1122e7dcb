"""Weighted acyclic automata over words: the count of a phrase is the sum of the weights along its path.

An automaton is built incrementally from sorted phrases. Weights stand as near to the start as they can (an arc carries what
all phrases through it share), so states with equal futures are merged as they are finished. Union walks the states of
several automata side by side and adds their weights; composition walks an acceptor and an automaton side by side.
"""

from __future__ import annotations

import struct
from collections.abc import Iterable, Iterator

import numpy as np

Phrase = tuple[bytes, ...]
#: The final weight of a state at which no phrase ends.
NONE = -1


class Automaton:
    """States are numbers; state s has a final weight and arcs (word -> weight, target) in order of words."""

    def __init__(self, final: list[int], arcs: list[dict[bytes, tuple[int, int]]], start: int):
        self.final, self.arcs, self.start = final, arcs, start

    def items(self) -> Iterator[tuple[Phrase, int]]:
        """Phrases with their weights, in order."""
        final, arcs = self.final, self.arcs

        def walk(state: int, path: Phrase, weight: int) -> Iterator[tuple[Phrase, int]]:
            if final[state] != NONE:
                yield path, weight + final[state]
            for word, (out, target) in arcs[state].items():
                if arcs[target]:
                    yield from walk(target, (*path, word), weight + out)
                else:
                    yield (*path, word), weight + out + final[target]

        yield from walk(self.start, (), 0)

    def get(self, phrase: Phrase) -> int | None:
        """The weight of a phrase; None if it isn't there."""
        state, weight = self.start, 0
        for word in phrase:
            arc = self.arcs[state].get(word)
            if arc is None:
                return None
            weight, state = weight + arc[0], arc[1]
        return None if self.final[state] == NONE else weight + self.final[state]

    def dump(self) -> bytes:
        words = sorted({w for arcs in self.arcs for w in arcs})
        place = {w: i for i, w in enumerate(words)}
        flat = [arc for arcs in self.arcs for arc in arcs.values()]
        label = np.array([place[w] for arcs in self.arcs for w in arcs], "<u4")
        out, target = np.array([o for o, _ in flat], "<i8"), np.array([t for _, t in flat], "<u4")
        parts = [np.array([len(w) for w in words], "<u4"), label, out, target, np.array([len(a) for a in self.arcs], "<u4"), np.array(self.final, "<i8")]
        return struct.pack("<4q", len(words), len(flat), len(self.arcs), self.start) + b"".join(p.tobytes() for p in parts) + b"".join(words)

    @classmethod
    def load(cls, data: bytes) -> Automaton:
        n_words, n_arcs, n_states, start = struct.unpack_from("<4q", data)
        at, parts = 32, []
        for n, t in ((n_words, "<u4"), (n_arcs, "<u4"), (n_arcs, "<i8"), (n_arcs, "<u4"), (n_states, "<u4"), (n_states, "<i8")):
            parts.append(np.frombuffer(data, t, n, at).tolist())
            at += n * int(t[2])
        sizes, label, out, target, degree, final = parts
        words = []
        for n in sizes:
            words.append(data[at : at + n])
            at += n
        arcs, i = [], 0
        for d in degree:
            arcs.append({words[label[j]]: (out[j], target[j]) for j in range(i, i + d)})
            i += d
        return cls(final, arcs, start)


class Builder:
    """Takes phrases in strictly ascending order; each state is merged with an equal one as soon as it can't change."""

    def __init__(self):
        self.final: list[int] = []
        self.arcs: list[dict[bytes, tuple[int, int]]] = []
        self.known: dict[tuple, int] = {}
        self.last: Phrase | None = None
        #: The states along the last phrase: [final weight, finished arcs, weight of the open arc].
        self.path: list[list] = [[NONE, {}, 0]]

    def finish(self, depth: int) -> None:
        """The states of the last phrase below depth are done."""
        path, last = self.path, self.last
        while len(path) > depth + 1:
            final, arcs, _ = path.pop()
            into = path[-1]
            into[1][last[len(path) - 1]] = (into[2], self.state(final, arcs))

    def state(self, final: int, arcs: dict[bytes, tuple[int, int]]) -> int:
        seen = (final, tuple(arcs.items())) if arcs else final
        if (n := self.known.get(seen)) is None:
            n = self.known[seen] = len(self.final)
            self.final.append(final)
            self.arcs.append(arcs)
        return n

    def add(self, phrase: Phrase, weight: int, ends: bool = False) -> None:
        """ends: no phrase that follows has this one as its beginning, so its last state is done at once."""
        last, path, same = self.last, self.path, 0
        if last is not None:
            if phrase <= last:
                raise ValueError("phrases must come in ascending order, each once")
            for a, b in zip(phrase, last, strict=False):
                if a != b:
                    break
                same += 1
            if len(path) > same + 1:
                self.finish(same)
            for depth in range(same):  # what the shared arcs carry beyond this phrase's weight moves on
                node = path[depth]
                more = node[2] - weight
                if more > 0:
                    node[2], below = weight, path[depth + 1]
                    if below[0] != NONE:
                        below[0] += more
                    for word, (out, target) in below[1].items():
                        below[1][word] = (out + more, target)
                    below[2] += more
                weight -= node[2]
        for _ in range(len(phrase) - same - ends):
            path[-1][2], weight = weight, 0
            path.append([NONE, {}, 0])
        if ends:
            path[-1][1][phrase[-1]] = (weight, self.state(0, {}))
        else:
            path[-1][0] = weight
        self.last = phrase

    def done(self) -> Automaton:
        self.finish(0)
        return Automaton(self.final, self.arcs, self.state(self.path[0][0], self.path[0][1]))


def build(items: Iterable[tuple[Phrase, int]]) -> Automaton:
    """The automaton of phrases in ascending order."""
    builder, phrase, weight = Builder(), None, 0
    for following, n in items:
        if phrase is not None:
            builder.add(phrase, weight, following[: len(phrase)] != phrase)
        phrase, weight = following, n
    if phrase is not None:
        builder.add(phrase, weight, len(phrase) > 0)
    return builder.done()


def union(automata: list[Automaton]) -> Iterator[tuple[Phrase, int]]:
    """The phrases of all, in order, with their weights summed: states are walked side by side."""
    def walk(states: list[tuple[Automaton, int, int]], path: Phrase) -> Iterator[tuple[Phrase, int]]:
        if path:
            ends = [weight + a.final[s] for a, s, weight in states if a.final[s] != NONE]
            if ends:
                yield path, sum(ends)
        if len(states) == 1:
            a, state, weight = states[0]
            for word, (out, target) in a.arcs[state].items():
                yield from walk([(a, target, weight + out)], (*path, word))
            return
        onward: dict[bytes, list] = {}
        for a, state, weight in states:
            for word, (out, target) in a.arcs[state].items():
                onward.setdefault(word, []).append((a, target, weight + out))
        for word in sorted(onward):
            yield from walk(onward[word], (*path, word))

    yield from walk([(a, a.start, 0) for a in automata], ())


def compose(acceptor: Automaton, counts: Automaton) -> Iterator[tuple[Phrase, int]]:
    """The phrases that both have, in order, with the weight of counts."""
    def walk(a: int, c: int, path: Phrase, weight: int) -> Iterator[tuple[Phrase, int]]:
        if acceptor.final[a] != NONE and counts.final[c] != NONE:
            yield path, weight + counts.final[c]
        there = counts.arcs[c]
        for word, (_, target) in acceptor.arcs[a].items():
            if word in there:
                out, onward = there[word]
                yield from walk(target, onward, (*path, word), weight + out)

    yield from walk(acceptor.start, counts.start, (), 0)
