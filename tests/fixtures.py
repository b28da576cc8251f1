"""Seeded tables for the rule tests: graphs, families, and a closure to hold results against."""

import random


def graph(nodes, edges, seed=0):
    """``edges`` distinct edges between the nodes 1..``nodes``."""
    draw = random.Random(seed)
    out = set()
    while len(out) < edges:
        out.add((draw.randint(1, nodes), draw.randint(1, nodes)))
    return sorted(out)


def core_and_rest(core, rest, seed=0):
    """A cycle over 1..``core`` that is all that 1 reaches, and a dense graph over the ``rest`` nodes after it."""
    ring = [(k, k % core + 1) for k in range(1, core + 1)]
    return ring + [(a + core, b + core) for a, b in graph(rest, 3 * rest, seed)]


def family(depth, children):
    """(child, parent) of a tree whose root is 0; each person above ``depth`` has ``children`` children."""
    out, row, last = [], [0], 0
    for _ in range(depth):
        row = [(last := last + 1, p) for p in row for _ in range(children)]
        out += row
        row = [c for c, _ in row]
    return out


def blocked(nodes, share, seed=0):
    """(node,) of some of 1..``nodes``."""
    draw = random.Random(seed)
    return [(k,) for k in range(1, nodes + 1) if draw.random() < share]


def closure(edges):
    after = {}
    for a, b in edges:
        after.setdefault(a, set()).add(b)
    out = set()
    for a in after:
        todo, seen = list(after[a]), set(after[a])
        while todo:
            for b in after.get(todo.pop(), ()):
                if b not in seen:
                    seen.add(b)
                    todo.append(b)
        out |= {(a, b) for b in seen}
    return out
