"""Gadgets by their definition: an agent walks, sets of states are kept, languages are told apart by refinement.

A gadget is (number of locations, edges (s, a, b, t)), begun in state 0. It shares no code with the kernel: no automata over
locations, no codes, no minimal forms but the partition of the sets of states that traversals reach.
"""

from __future__ import annotations


def form(n, edges):
    """The least listing of the gadget's behaviour over all rotations of its locations."""
    return min(_listing(n, [(s, (a + r) % n, (b + r) % n, t) for s, a, b, t in edges]) for r in range(n))


def _listing(n, edges):
    """Which traversals are possible after which, states numbered by discovery; standing still is always possible."""
    step = {}
    for s, a, b, t in edges:
        step.setdefault((s, a, b), set()).add(t)

    def after(states):
        out = {}
        for a in range(n):
            for b in range(n):
                to = {t for s in states for t in step.get((s, a, b), ())} | (set(states) if a == b else set())
                if to:
                    out[a, b] = frozenset(to)
        return out

    moves, todo = {}, [frozenset({0})]
    while todo:
        x = todo.pop()
        if x not in moves:
            moves[x] = after(x)
            todo += moves[x].values()
    part = dict.fromkeys(moves, 0)
    while True:
        keys = {x: tuple(sorted((ab, part[y]) for ab, y in m.items())) for x, m in moves.items()}
        names = {k: i for i, k in enumerate(sorted(set(keys.values())))}
        new = {x: names[keys[x]] for x in moves}
        if len(set(new.values())) == len(set(part.values())):
            break
        part = new
    one = {part[x]: {ab: part[y] for ab, y in m.items()} for x, m in moves.items()}
    number, order, out = {part[frozenset({0})]: 0}, [part[frozenset({0})]], []
    for k in order:
        for (a, b), to in sorted(one[k].items()):
            if to not in number:
                number[to] = len(number)
                order.append(to)
            if a != b or to != k:
                out.append((number[k], a, b, number[to]))
    return tuple(out)


def walks(edges, pairs):
    """All traversals of an agent that may go on from the second of a pair when it leaves at the first."""
    have, more = set(edges), True
    while more:
        new = {(s, a, c, u) for s, a, b, t in have for x, y in pairs if x == b for t2, y2, c, u in have if t2 == t and y2 == y} - have
        have, more = have | new, bool(new)
    return have


def trimmed(n, edges):
    """Without locations that no traversal uses, where behaviour is concerned; None if fewer than two are left."""
    shape = _listing(n, edges)
    used = sorted({x for _, a, b, _ in shape for x in (a, b)})
    if len(used) < 2:
        return None
    return len(used), {(s, used.index(a), used.index(b), t) for s, a, b, t in shape}


def close(g):
    n, edges = g
    made = n, walks(edges, [(a, a) for a in range(n)])
    return made if form(*made) != form(*g) else None


def mirror(g):
    n, edges = g
    made = n, {(s, n - 1 - a, n - 1 - b, t) for s, a, b, t in edges}
    return made if form(*made) != form(*g) else None


def connect_at(g, p):
    n, edges = g
    q = (p + 1) % n
    keep = [x for x in range(n) if x not in (p, q)]
    states = {s for e in edges for s in (e[0], e[3])}
    # Who leaves at one of the two goes on from the other, and may also stand still there.
    stay = {(s, x, x, s) for s in states for x in (p, q)}
    have = walks(set(edges) | stay, [(p, q), (q, p)])
    return trimmed(len(keep), {(s, keep.index(a), keep.index(b), t) for s, a, b, t in have if a in keep and b in keep})


def connect(g):
    return [m for p in range(g[0]) if g[0] >= 4 and (m := connect_at(g, p))]


def combine(l, r, most):
    (nl, le), (nr, re) = l, r
    n = nl + nr
    if n > most:
        return []
    ls, rs = ({s for e in es for s in (e[0], e[3])} | {0} for es in (le, re))
    pair = lambda x, y: x * (max(rs) + 1) + y
    out = []
    for splice in range(nl):
        for turn in range(nr):
            left = [a if a < splice else a + nr for a in range(nl)]
            right = [splice + (a - turn) % nr for a in range(nr)]
            both = {(pair(s, y), left[a], left[b], pair(t, y)) for s, a, b, t in le for y in rs} | {(pair(x, s), right[a], right[b], pair(x, t)) for s, a, b, t in re for x in ls}
            for p in ((splice - 1) % n, splice + nr - 1):
                if m := connect_at((n, both), p):
                    out.append(m)
    return out


def search(sources, most, stop):
    """Form to generation, by the phases of the search."""
    seen = {form(*g): 0 for g in sources}
    now, rights = {form(*g): g for g in sources}, None
    front = {}

    def fresh(made, generation):
        out = {}
        for g in made:
            f = form(*g)
            if f not in seen:
                seen[f] = generation
                out[f] = g
        return out

    for generation in range(stop + 1):
        if generation:
            now = fresh([m for l in front.values() for r in rights.values() for m in combine(l, r, most)], generation)
        front = {}
        while now:
            closed = {f: c for f, g in now.items() if (c := close(g))}
            now = {f: g for f, g in now.items() if f not in closed} | fresh(closed.values(), generation)
            now |= fresh([m for g in now.values() if (m := mirror(g))], generation)
            rights = now if rights is None else rights
            front |= now
            now = fresh([m for g in now.values() for m in connect(g)], generation)
        if not front:
            break
    return seen
