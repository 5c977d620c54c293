"""Exact search on a connected core, with rows of the adjacency matrix as
integers: sets are machine words, a subproblem is copied as a list of references.

A subproblem is ``(rows, dirty, cost, log, packs)``: ``rows[v]`` is the set of
neighbours of v (0 once v is decided or alone), ``dirty`` are vertices whose
rules are to be tried, ``log`` is a linked list of undo entries as in
``kernels.undo``, and ``packs`` are packing constraints ``(vertices, most)``: at
most so many of these may still be taken. All is plain data, so what a search
leaves open can go on elsewhere.
"""

from __future__ import annotations

import time

from covergrid.operators import kernels as K

Packs = tuple[tuple[int, int], ...]
State = tuple[list[int], int, int, tuple | None, Packs]


def encode(g: K.Graph) -> tuple[list[int], list[int]]:
    """(ids in order of degree, rows): vertex v of the rows is ``ids[v]``."""
    ids = sorted(g, key=lambda x: (len(g[x]), x))
    at = {v: i for i, v in enumerate(ids)}
    return ids, [sum(1 << at[w] for w in g[v]) for v in ids]


def start(rows: list[int]) -> State:
    return list(rows), (1 << len(rows)) - 1, 0, None, ()


def _members(m: int) -> list[int]:
    out = []
    while m:
        b = m & -m
        out.append(b.bit_length() - 1)
        m ^= b
    return out


def _unconfined(rows: list[int], v: int) -> bool:
    s, closed = 1 << v, 1 << v | rows[v]
    border = rows[v]
    while True:
        best, m = None, border
        while m:
            b = m & -m
            m ^= b
            near = rows[b.bit_length() - 1]
            inside = near & s
            if not inside & (inside - 1):  # one neighbour in s
                rest = near & ~closed
                if not rest:
                    return True
                if not rest & (rest - 1):
                    best = rest
                    break
        if best is None:
            return False
        w = best.bit_length() - 1
        s |= best
        closed |= best | rows[w]
        border = (border | rows[w]) & ~s


def reduce(state: State, limit: int) -> State | None:
    """Rules to a fixpoint; None if the cost reaches ``limit`` or a packing
    constraint is broken. The test for unconfined vertices is the dearest, so it
    is for the vertices that are dirty at first only. ``state`` is used up."""
    rows, dirty, cost, log, packs = state
    slow = dirty
    while dirty or slow:
        if cost >= limit:
            return None
        took = fold = 0
        if dirty:
            b = dirty & -dirty
            dirty ^= b
            v = b.bit_length() - 1
            n = rows[v]
            if not n:
                continue
            d = n.bit_count()
            if d == 1:
                took = n
            elif d == 2:
                low = n & -n
                x = low.bit_length() - 1
                if rows[x] & n:
                    took = n
                else:
                    y = n.bit_length() - 1
                    far = (rows[x] | rows[y]) & ~b
                    gone = ~(n | b)
                    for w in _members(far):
                        rows[w] = rows[w] & gone | b
                    rows[x] = rows[y] = 0
                    rows[v] = far
                    log = (("fold", (v, x, y)), log)
                    cost += 1
                    dirty |= far | b
                    fold = n | b
            else:
                closed, m = n | b, n
                while m:
                    u = m & -m
                    m ^= u
                    if not closed & ~(rows[u.bit_length() - 1] | u):
                        took = u
                        dirty |= b
                        break
                else:
                    if d == 3:
                        x = (n & -n).bit_length() - 1
                        rest = n & (n - 1)
                        y, z = (rest & -rest).bit_length() - 1, n.bit_length() - 1
                        xy, xz, yz = rows[x] >> y & 1, rows[x] >> z & 1, rows[y] >> z & 1
                        if xy + xz + yz == 1:  # an edge p q and a single s
                            p, q, s = (x, y, z) if xy else (x, z, y) if xz else (y, z, x)
                            far = rows[s] & ~b
                            gone = ~(b | 1 << s)
                            both = 1 << p | 1 << q
                            for w in _members(far):
                                rows[w] = rows[w] & gone | both
                            rows[v] = rows[s] = 0
                            rows[p] = rows[p] & gone | far
                            rows[q] = rows[q] & gone | far
                            log = (("pair", (v, (p, q), s)), log)
                            cost += 1
                            dirty |= far | both
                            fold = n | b
                        elif not xy + xz + yz and rows[x].bit_count() + rows[y].bit_count() + rows[z].bit_count() <= 10:
                            rows[v] = 0
                            ends = (x, y, z)
                            far3 = [rows[w] & ~b for w in ends]
                            more = (far3[1] | 1 << y, far3[2] | 1 << x | 1 << z, far3[0] | 1 << y)
                            for w in ends:
                                rows[w] &= ~b
                            for w, add in zip(ends, more):
                                rows[w] |= add & ~(1 << w)
                                for k in _members(add):
                                    rows[k] |= 1 << w
                                    rows[k] &= ~(1 << k)
                            log = (("three", (v, x, y, z)), log)
                            dirty |= n | far3[0] | far3[1] | far3[2]
                            fold = n | b
        else:
            b = slow & -slow
            slow ^= b
            if rows[b.bit_length() - 1] and _unconfined(rows, b.bit_length() - 1):
                took = b
        if fold and packs:
            packs = tuple(p for p in packs if not p[0] & fold)
        while took:
            u = took & -took
            took ^= u
            i = u.bit_length() - 1
            near = rows[i]
            rows[i] = 0
            for w in _members(near):
                rows[w] &= ~u
            dirty |= near
            log = (("take", (i,)), log)
            cost += 1
            if packs:
                kept = []
                for m, most in packs:
                    if m & u:
                        m, most = m ^ u, most - 1
                        if most < 0:
                            return None
                        if not most:  # the others must stay out: their neighbours go in
                            out = _members(m)
                            border = 0
                            for w in out:
                                border |= rows[w]
                            if border & m:
                                return None
                            took |= border & ~u
                            continue
                    kept.append((m, most))
                packs = tuple(kept)
    return rows, 0, cost, log, packs


def clique_bound(rows: list[int], live: int, stop: int) -> int:
    """Sum of sizes less one over a greedy partition into cliques; ends once it
    reaches ``stop``."""
    order = sorted(_members(live), key=lambda v: rows[v].bit_count())
    member, cliques, bound, seen = {}, [], 0, 0
    for v in order:
        near, best, size = rows[v], -1, 0
        m = near & seen
        while m:
            b = m & -m
            c = member[b.bit_length() - 1]
            clique = cliques[c]
            m &= ~clique
            if not clique & ~near and clique.bit_count() > size:
                best, size = c, clique.bit_count()
        seen |= 1 << v
        if best < 0:
            member[v] = len(cliques)
            cliques.append(1 << v)
        else:
            member[v] = best
            cliques[best] |= 1 << v
            bound += 1
            if bound >= stop:
                return bound
    return bound


def _parts(rows: list[int], live: int) -> list[int]:
    out = []
    while live:
        part = edge = live & -live
        while edge:
            near = 0
            for v in _members(edge):
                near |= rows[v]
            edge = near & ~part
            part |= edge
        out.append(part)
        live &= ~part
    return out


def _drop(rows: list[int], gone: int) -> tuple[list[int], int]:
    """Rows without the vertices ``gone``, and the vertices that lost a neighbour."""
    rows, touched = list(rows), 0
    for v in _members(gone):
        touched |= rows[v]
        rows[v] = 0
    touched &= ~gone
    for w in _members(touched):
        rows[w] &= ~gone
    return rows, touched


def entries(log: tuple | None) -> list:
    out = []
    while log is not None:
        out.append(log[0])
        log = log[1]
    return out[::-1]


def search(stack: list[State], limit: int, nodes: int, deadline: float | None = None) -> tuple[set[int] | None, int, list[State], int]:
    """(best cover, its size, open subproblems, nodes used): the best cover of
    fewer than ``limit`` vertices in the subproblems, None if none was found.
    Without open subproblems there is none better. At least one node is searched.

    Branches on a vertex of most neighbours, of those one whose neighbours have
    the fewest edges among them: either it is taken, or its neighbours. A solution that takes it and all but one of its neighbours is no
    better than one that takes the neighbours, so at most all but two of them may
    be taken beside it; solutions that break that are never all of the best ones,
    whatever rules are applied later.
    """
    best, used = None, 0
    stack = list(stack)
    while stack and (not used or used < nodes and (deadline is None or time.monotonic() < deadline)):
        used += 1
        state = reduce(stack.pop(), limit)
        if state is None or state[2] >= limit:
            continue
        rows, _, cost, log, packs = state
        live = sum(1 << v for v, n in enumerate(rows) if n)
        if not live:
            best, limit = K.undo(entries(log), set()), cost
            continue
        if cost + clique_bound(rows, live, limit - cost) >= limit:
            continue
        parts = _parts(rows, live)
        if len(parts) > 1:
            done = _solve_parts(rows, parts, limit - cost, nodes - used, deadline)
            if done is None:
                continue
            cover, left, n = done
            used += n
            if left:
                stack.append(state)
                return best, limit, stack, used
            found = K.undo(entries(log), cover)
            best, limit = found, cost + len(cover)
            continue
        most = max(n.bit_count() for n in rows)
        v, least = -1, 1 << 60
        for w, n in enumerate(rows):
            if n.bit_count() == most:
                inner = sum((rows[x] & n).bit_count() for x in _members(n))
                if inner < least:
                    v, least = w, inner
        near = rows[v]
        rest, touched = _drop(rows, near | 1 << v)
        out_log = (("take", tuple(_members(near))), log)
        out_packs = _after(packs, near)
        if out_packs is not None:
            stack.append((rest, touched, cost + most, out_log, out_packs))
        took = 1 << v
        rest, touched = _drop(rows, took)
        in_packs = _after(packs, took)
        if in_packs is not None:
            own = _after(((near, most - 2),), took & near)
            stack.append((rest, touched, cost + took.bit_count(), (("take", tuple(_members(took))), log), (*in_packs, *own) if own else in_packs))
    return best, limit, stack, used


def _after(packs: Packs, took: int) -> Packs | None:
    """Constraints after vertices are taken; None if one is broken. One that
    allows no more is left to the next taking."""
    out = []
    for m, most in packs:
        hit = (m & took).bit_count()
        if most - hit < 0:
            return None
        out.append((m & ~took, most - hit))
    return tuple(out)


def _solve_parts(rows: list[int], parts: list[int], limit: int, nodes: int, deadline: float | None) -> tuple[set[int], bool, int] | None:
    """Cover of separate parts of fewer than ``limit`` vertices together (None
    if there is none), whether work was left, and the nodes used."""
    least = [clique_bound(rows, p, limit) for p in parts]
    room, cover, used = limit - sum(least), set(), 0  # above its bound each part may take room - 1 more
    for bound, part in sorted(zip(least, parts), key=lambda x: x[1].bit_count()):
        if room <= 0:
            return None
        own = [n if part >> v & 1 else 0 for v, n in enumerate(rows)]
        best, size, left, n = search([(own, 0, 0, None, ())], bound + room, max(nodes - used, 1), deadline)
        used += n
        if left:
            return set(), True, used
        if best is None:
            return None
        cover |= best
        room -= size - bound
    return (cover, False, used) if room > 0 else None
