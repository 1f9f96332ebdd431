"""Weighted finite-state transducers over the tropical semiring: composition and shortest paths.

A machine has a start state, arcs that read one symbol, and silent arcs that read none. Every arc writes any number of
symbols and has a weight; weights add up along a path, and of all paths that read an input the one of least weight
counts. Arcs are functions of a state, so a machine may be open-ended: its states come to be as an input asks for them.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Hashable, Iterable, Iterator
from dataclasses import dataclass

#: What an arc writes, its weight, the state that it leads to.
Arc = tuple[tuple, float, Hashable]


@dataclass(frozen=True)
class Machine:
    start: Hashable
    read: Callable[[Hashable, Hashable], Iterable[Arc]]
    silent: Callable[[Hashable], Iterable[Arc]] = lambda state: ()
    final: Callable[[Hashable], bool] = lambda state: True


def compose(first: Machine, second: Machine) -> Machine:
    """A machine that does what second does with what first writes; made state by state, as an input asks for it."""

    def through(state: Hashable, symbols: tuple) -> Iterator[Arc]:
        """All paths of the second machine that read the symbols, silent arcs before each of them included."""
        if not symbols:
            yield (), 0.0, state
            return
        for out, weight, there in [((), 0.0, state), *second.silent(state)]:
            for more, w, end in second.read(there, symbols[0]):
                for rest, x, last in through(end, symbols[1:]):
                    yield out + more + rest, weight + w + x, last

    def paired(arcs: Iterable[Arc], other: Hashable) -> Iterator[Arc]:
        for written, weight, there in arcs:
            for out, w, last in through(other, written):
                yield out, weight + w, (there, last)

    def silent(state: tuple) -> Iterator[Arc]:
        yield from paired(first.silent(state[0]), state[1])
        for out, weight, there in second.silent(state[1]):
            yield out, weight, (state[0], there)

    return Machine((first.start, second.start), lambda state, symbol: paired(first.read(state[0], symbol), state[1]), silent, lambda state: first.final(state[0]) and second.final(state[1]))


def shortest(machine: Machine, symbols: Iterable[Hashable]) -> tuple | None:
    """What the path of least weight writes that reads the symbols; None if no path of finite weight does."""
    front: dict[Hashable, tuple[float, tuple]] = {machine.start: (0.0, ())}

    def relax(found: dict, state: Hashable, weight: float, path: tuple) -> bool:
        if weight < found.get(state, (math.inf,))[0]:
            found[state] = (weight, path)
            return True
        return False

    def closed(found: dict) -> dict:
        """With all states that silent arcs lead to; these form no circle."""
        agenda = list(found)
        while agenda:
            state = agenda.pop()
            weight, path = found[state]
            agenda += [there for out, w, there in machine.silent(state) if relax(found, there, weight + w, (path, out))]
        return found

    for symbol in symbols:
        after: dict[Hashable, tuple[float, tuple]] = {}
        for state, (weight, path) in closed(front).items():
            for out, w, there in machine.read(state, symbol):
                relax(after, there, weight + w, (path, out))
        front = after
    ends = [held for state, held in closed(front).items() if machine.final(state)]
    if not ends:
        return None
    parts, path = [], min(ends, key=lambda held: held[0])[1]
    while path:
        path, out = path
        parts.append(out)
    return tuple(x for out in reversed(parts) for x in out)
