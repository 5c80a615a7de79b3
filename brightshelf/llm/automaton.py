"""Many byte regexes as one deterministic automaton: subset construction, then minimisation.

Patterns are Python byte regexes of literals, sets, groups, branches and greedy repeats. They
match anywhere, or only where the byte before is no letter, digit or underscore (`bounded`).
"""

from __future__ import annotations

import re._constants as c
import re._parser as parser
from dataclasses import dataclass

import numpy as np

WORD_BYTES = frozenset(b"0123456789abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ_")
ALL_BYTES = frozenset(range(256))


@dataclass
class Automaton:
    classes: bytes  # byte -> class, a table for bytes.translate
    moves: np.ndarray  # state x class -> state; state 0 is the start
    accepts: list[tuple[int, ...]]  # per state: rules of which a match has just ended

    def rows(self) -> list[list]:
        """Each state as a list of the next states' lists, with its accepted rules in the last place."""
        rows: list[list] = [[] for _ in self.accepts]
        for row, to, accepted in zip(rows, self.moves.tolist(), self.accepts):
            row.extend(rows[t] for t in to)
            row.append(accepted)
        return rows


def scan(text: bytes, automaton: Automaton, start: list) -> dict[int, int]:
    """Rules that match somewhere in the text, each with the end of its first match; one pass over the bytes."""
    found: dict[int, int] = {}
    row, last = start, len(start) - 1
    for at, byte in enumerate(text.translate(automaton.classes)):
        row = row[byte]
        if row[last]:
            for rule in row[last]:
                found.setdefault(rule, at + 1)
    return found


class _Nfa:
    def __init__(self):
        self.edges: list[list[tuple[frozenset, int]]] = []
        self.empty: list[list[int]] = []

    def state(self) -> int:
        self.edges.append([])
        self.empty.append([])
        return len(self.edges) - 1

    def add(self, items, at: int, fold: bool) -> int:
        """Append the parsed items after state `at`; gives the state behind them."""
        for op, arg in items:
            if op in (c.LITERAL, c.NOT_LITERAL, c.IN, c.ANY):
                to = self.state()
                self.edges[at].append((_members(op, arg, fold), to))
                at = to
            elif op is c.BRANCH:
                to = self.state()
                for branch in arg[1]:
                    begin = self.state()
                    self.empty[at].append(begin)
                    self.empty[self.add(branch, begin, fold)].append(to)
                at = to
            elif op is c.SUBPATTERN:
                at = self.add(arg[3], at, fold or bool(arg[1] & c.SRE_FLAG_IGNORECASE))
            elif op is c.MAX_REPEAT:
                least, most, body = arg
                for _ in range(least):
                    at = self.add(body, at, fold)
                if most is c.MAXREPEAT:
                    loop = self.state()
                    self.empty[at].append(loop)
                    self.empty[self.add(body, loop, fold)].append(loop)
                    at = loop
                else:
                    to = self.state()
                    for _ in range(most - least):
                        self.empty[at].append(to)
                        at = self.add(body, at, fold)
                    self.empty[at].append(to)
                    at = to
            else:
                raise ValueError(f"{op} cannot be part of the automaton")
        return at

    def closure(self, states) -> frozenset:
        seen, stack = set(states), list(states)
        while stack:
            for to in self.empty[stack.pop()]:
                if to not in seen:
                    seen.add(to)
                    stack.append(to)
        return frozenset(seen)


def _members(op, arg, fold: bool) -> frozenset:
    if op is c.ANY:
        return ALL_BYTES - {10}
    if op in (c.LITERAL, c.NOT_LITERAL):
        items, negate = [(c.LITERAL, arg)], op is c.NOT_LITERAL
    else:
        items, negate = list(arg), bool(arg) and arg[0][0] is c.NEGATE
    found: set[int] = set()
    for kind, value in items:
        if kind is c.LITERAL:
            found.add(value)
        elif kind is c.RANGE:
            found.update(range(value[0], value[1] + 1))
        elif kind is not c.NEGATE:
            raise ValueError(f"{kind} cannot be part of the automaton")
    if fold:
        found |= {b ^ 0x20 for b in found if 0x41 <= b & ~0x20 <= 0x5A}
    return frozenset(ALL_BYTES - found if negate else found)


def compile_rules(patterns: list[tuple[bytes, bool]]) -> Automaton:
    """One automaton for (pattern, bounded) rules; rule numbers are positions in the list."""
    nfa = _Nfa()
    outside, inside = nfa.state(), nfa.state()
    for at in (outside, inside):
        nfa.edges[at] += [(ALL_BYTES - WORD_BYTES, outside), (WORD_BYTES, inside)]
    final: dict[int, int] = {}
    for rule, (pattern, bounded) in enumerate(patterns):
        begin = nfa.state()
        for at in (outside,) if bounded else (outside, inside):
            nfa.empty[at].append(begin)
        parsed = parser.parse(pattern)
        final[nfa.add(parsed, begin, bool(parsed.state.flags & c.SRE_FLAG_IGNORECASE))] = rule

    # Bytes that every edge treats alike share a class.
    sets = sorted({members for edges in nfa.edges for members, _ in edges}, key=sorted)
    flags = np.array([[b in s for s in sets] for b in range(256)])
    _, sample, byte_class = np.unique(flags, axis=0, return_index=True, return_inverse=True)
    byte_class = byte_class.reshape(-1)
    of_class = [[(int(b) in members, to) for b in sample] for edges in nfa.edges for members, to in edges]
    steps: list[list[list[int]]] = []
    k = 0
    for edges in nfa.edges:
        own = of_class[k : k + len(edges)]
        k += len(edges)
        steps.append([[e[j][1] for e in own if e[j][0]] for j in range(len(sample))])
    closed = [nfa.closure([s]) for s in range(len(nfa.edges))]
    useful = [bool(nfa.edges[s]) or s in final for s in range(len(nfa.edges))]

    def merged(states) -> frozenset:
        return frozenset(s for t in states for s in closed[t] if useful[s])

    start = merged([outside])
    number, order, moves = {start: 0}, [start], []
    for subset in order:
        row = []
        for j in range(len(sample)):
            to = merged({t for s in subset for t in steps[s][j]})
            if to not in number:
                number[to] = len(order)
                order.append(to)
            row.append(number[to])
        moves.append(row)
    accepts = [tuple(sorted(final[s] for s in subset if s in final)) for subset in order]
    return _minimised(byte_class, np.array(moves), accepts)


def _minimised(byte_class: np.ndarray, moves: np.ndarray, accepts: list[tuple[int, ...]]) -> Automaton:
    """Merge states that accept the same rules now and after every byte (partition refinement)."""
    kinds = {a: i for i, a in enumerate(dict.fromkeys(accepts))}
    group = np.array([kinds[a] for a in accepts])
    while True:
        signature = np.column_stack([group, group[moves]])
        _, refined = np.unique(signature, axis=0, return_inverse=True)
        refined = refined.reshape(-1)
        if refined.max() == group.max():
            break
        group = refined
    count = group.max() + 1
    first = np.full(count, len(group))
    np.minimum.at(first, group, np.arange(len(group)))
    order = np.argsort(first)  # the start's group comes first
    rank = np.empty(count, np.int64)
    rank[order] = np.arange(count)
    chosen = first[order]
    return Automaton(bytes(byte_class.astype(np.uint8)), rank[group[moves[chosen]]], [accepts[i] for i in chosen])
