"""Sequential kernels for one connected component: rules with exact undo,
bounds, heuristics and branch and bound, on plain Python sets.

A graph is ``dict[int, set[int]]`` without isolated vertices. Rules change it in
place and append an undo entry to a log; ``undo`` turns a cover of the reduced
graph into one of the graph before. Ties go to the smallest id, randomness is
seeded, and nothing recurses on depth: stacks are explicit.
"""

from __future__ import annotations

import random
import time
from collections import deque
from collections.abc import Iterable

Graph = dict[int, set[int]]


def build(edges: Iterable[tuple[int, int]]) -> Graph:
    g: Graph = {}
    for u, v in edges:
        if u != v:
            g.setdefault(u, set()).add(v)
            g.setdefault(v, set()).add(u)
    return g


def copy(g: Graph) -> Graph:
    return {v: set(n) for v, n in g.items()}


def n_edges(g: Graph) -> int:
    return sum(map(len, g.values())) // 2


def drop(g: Graph, v: int) -> None:
    """Delete a vertex, and vertices that lose their last edge."""
    for w in g.pop(v, ()):
        g[w].discard(v)
        if not g[w]:
            del g[w]


def join(g: Graph, u: int, v: int) -> None:
    if u != v:
        g.setdefault(u, set()).add(v)
        g.setdefault(v, set()).add(u)


def is_cover(g: Graph, cover: set[int]) -> bool:
    return all(v in cover or n <= cover for v, n in g.items())


# --- rules -------------------------------------------------------------------
# Each returns how much the optimum fell, or None if it doesn't apply. A log
# entry is (kind, data); "take" adds its vertices, the others are conditional.


def rule_degree_one(g: Graph, log: list) -> int | None:
    took = []
    queue = deque(sorted(v for v, n in g.items() if len(n) == 1))
    while queue:
        v = queue.popleft()
        if v not in g or len(g[v]) != 1:
            continue
        (w,) = g[v]
        if len(g[w]) == 1:
            w = min(v, w)
        near = list(g[w])
        drop(g, w)
        took.append(w)
        queue.extend(x for x in near if x in g and len(g[x]) == 1)
    if took:
        log.append(("take", took))
    return len(took) or None


def rule_degree_two(g: Graph, log: list, fold: bool = True) -> int | None:
    total, queue = 0, deque(sorted(v for v, n in g.items() if len(n) == 2))
    while queue:
        v = queue.popleft()
        if len(g.get(v, ())) != 2:
            continue
        a, b = sorted(g[v])
        near = (g[a] | g[b]) - {v, a, b}
        if b in g[a]:
            drop(g, a)
            drop(g, b)
            log.append(("take", [a, b]))
            total += 2
        elif fold:
            for x in (v, a, b):
                drop(g, x)
            for x in near:
                join(g, v, x)
            log.append(("fold", (v, a, b)))
            total += 1
            queue.append(v)
        else:
            continue
        queue.extend(sorted(x for x in near if len(g.get(x, ())) == 2))
    return total or None


def rule_high_degree(g: Graph, k: int, log: list) -> int | None:
    """Vertices of degree above the budget; the budget shrinks with each."""
    took = []
    while g and k > 0:
        v = min(g, key=lambda x: (-len(g[x]), x))
        if len(g[v]) <= k:
            break
        drop(g, v)
        took.append(v)
        k -= 1
    if took:
        log.append(("take", took))
    return len(took) or None


def buss_excludes(n: int, m: int, max_degree: int, k: int) -> bool:
    """No cover of size k: more vertices or edges than k vertices of degree at
    most k can touch (valid once no degree exceeds k)."""
    return max_degree <= k and (n > k * k + k or m > k * k)


def rule_domination(g: Graph, log: list) -> int | None:
    took = []
    for v in sorted(g, key=lambda x: (len(g[x]), x)):
        for u in sorted(g.get(v, ())):
            if len(g[u]) >= len(g[v]) and g[v] - {u} <= g[u]:
                drop(g, u)
                took.append(u)
                break
    if took:
        log.append(("take", took))
    return len(took) or None


def is_unconfined(g: Graph, v: int) -> bool:
    s, closed = {v}, {v} | g[v]
    border = set(g[v])  # N(S)
    while True:
        best = None
        for u in sorted(border):
            if len(g[u] & s) == 1:
                rest = g[u] - closed
                if best is None or len(rest) < len(best):
                    best = rest
                    if not rest:
                        return True
        if best is None or len(best) != 1:
            return False
        (w,) = best
        s.add(w)
        closed |= {w} | g[w]
        border = (border | g[w]) - s


def rule_unconfined(g: Graph, log: list) -> int | None:
    took = []
    for v in sorted(g):
        if v in g and is_unconfined(g, v):
            drop(g, v)
            took.append(v)
    if took:
        log.append(("take", took))
    return len(took) or None


def hopcroft_karp(g: Graph, before: dict[int, int] | None = None) -> tuple[dict[int, int], dict[int, int]]:
    """Maximum matching of the bipartite double cover: left to right and back.
    It starts from what is left of the matching ``before`` of a larger graph, so
    that after a deletion only the vertices set free are augmented again."""
    left = {u: w for u, w in before.items() if u in g and w in g[u]} if before else {}
    right = {w: u for u, w in left.items()}
    for u in sorted(g.keys() - left.keys()):  # greedy start
        for w in sorted(g[u]):
            if w not in right:
                left[u], right[w] = w, u
                break
    while True:
        dist = {u: 0 for u in g if u not in left}
        queue, found = deque(sorted(dist)), False
        while queue:
            u = queue.popleft()
            for w in g[u]:
                x = right.get(w)
                if x is None:
                    found = True
                elif x not in dist:
                    dist[x] = dist[u] + 1
                    queue.append(x)
        if not found:
            return left, right
        for root in sorted(u for u in g if u not in left):
            path, iters = [root], {root: iter(sorted(g[root]))}
            via: list[int] = []
            while path:
                u = path[-1]
                for w in iters[u]:
                    x = right.get(w)
                    if x is None:
                        via.append(w)
                        for a, b in zip(path, via):
                            left[a], right[b] = b, a
                        path = []
                        break
                    if dist.get(x) == dist.get(u, -9) + 1 and x not in iters:
                        via.append(w)
                        path.append(x)
                        iters[x] = iter(sorted(g[x]))
                        break
                else:
                    dist.pop(u, None)
                    path.pop()
                    if via:
                        via.pop()


def half_integral(g: Graph) -> tuple[set[int], set[int]]:
    """Vertices of value one and of value zero in a smallest cover in halves,
    from a minimum cover of the double cover."""
    left, right = hopcroft_karp(g)
    reach_l, reach_r = {u for u in g if u not in left}, set()
    queue = deque(reach_l)
    while queue:
        u = queue.popleft()
        for w in g[u]:
            if w not in reach_r:
                reach_r.add(w)
                x = right.get(w)
                if x is not None and x not in reach_l:
                    reach_l.add(x)
                    queue.append(x)
    return reach_r - reach_l, reach_l - reach_r


def rule_lp(g: Graph, log: list) -> int | None:
    """Vertices of value one are taken, of value zero left out."""
    one = sorted(half_integral(g)[0])
    if not one:
        return None
    for v in one:
        drop(g, v)
    log.append(("take", one))
    return len(one)


def residual_components(g: Graph) -> list[list[int]]:
    """Strongly connected components, in topological order from sinks, of the
    residual graph of a maximum matching of the double cover: left vertex u
    leads to the left partner of each neighbour. Tarjan's search on an explicit
    stack."""
    _, right = hopcroft_karp(g)
    out: list[list[int]] = []
    index: dict[int, int] = {}
    low: dict[int, int] = {}
    open_: list[int] = []
    inside: set[int] = set()
    for root in sorted(g):
        if root in index:
            continue
        work = [(root, iter(sorted(g[root])))]
        index[root] = low[root] = len(index)
        open_.append(root)
        inside.add(root)
        while work:
            u, near = work[-1]
            for w in near:
                x = right.get(w)
                if x is None:
                    continue
                if x not in index:
                    index[x] = low[x] = len(index)
                    open_.append(x)
                    inside.add(x)
                    work.append((x, iter(sorted(g[x]))))
                    break
                if x in inside:
                    low[u] = min(low[u], index[x])
            else:
                work.pop()
                if work:
                    low[work[-1][0]] = min(low[work[-1][0]], low[u])
                if low[u] == index[u]:
                    part = []
                    while not part or part[-1] != u:
                        part.append(open_.pop())
                        inside.discard(part[-1])
                    out.append(sorted(part))
    return out


def _inner(g: Graph, near: list[int]) -> list[tuple[int, int]]:
    return [(a, b) for i, a in enumerate(near) for b in near[i + 1 :] if b in g[a]]


def rule_degree_three(g: Graph, log: list, kinds: tuple[str, ...] = ("dominated", "edge", "independent")) -> int | None:
    """Vertices of degree three: neighbours that form a triangle or a path
    (``dominated``), one edge and a single (``edge``), or no edge. One vertex
    at a time."""
    for v in sorted(x for x, n in g.items() if len(n) == 3):
        if len(g.get(v, ())) != 3:
            continue
        near = sorted(g[v])
        inner = _inner(g, near)
        if len(inner) >= 2 and "dominated" in kinds:
            took = near if len(inner) == 3 else [x for x in near if sum(x in p for p in inner) == 2]
            for x in took:
                drop(g, x)
            log.append(("take", took))
            return len(took)
        if len(inner) == 1 and "edge" in kinds:
            p, q = inner[0]
            (s,) = set(near) - {p, q}
            far = g[s] - {v}
            drop(g, v)
            drop(g, s)
            for x in far:
                join(g, p, x)
                join(g, q, x)
            log.append(("pair", (v, (p, q), s)))
            return 1
        if not inner and "independent" in kinds:
            a, b, c = near
            na, nb, nc = (g[x] - {v} for x in near)
            drop(g, v)
            join(g, a, b)
            join(g, b, c)
            for x, far in ((a, nb), (b, nc), (c, na)):
                for y in far:
                    join(g, x, y)
            log.append(("three", (v, a, b, c)))
            return 0
    return None


def rule_degree_four(g: Graph, log: list, kinds: tuple[str, ...] = ("dominated", "cliques")) -> int | None:
    """Vertices of degree four: a neighbour next to the other three is taken;
    neighbours that are two cliques (triangle and single, or a 4-cycle) shrink.
    One vertex at a time."""
    for v in sorted(x for x, n in g.items() if len(n) == 4):
        if len(g.get(v, ())) != 4:
            continue
        near = sorted(g[v])
        inner = _inner(g, near)
        deg = {x: sum(x in p for p in inner) for x in near}
        took = [x for x in near if deg[x] == 3]
        if took and "dominated" in kinds:
            for x in took:
                drop(g, x)
            log.append(("take", took))
            return len(took)
        if took or "cliques" not in kinds:
            continue
        if len(inner) == 3 and 0 in deg.values():
            (s,) = [x for x in near if deg[x] == 0]
            c1 = tuple(x for x in near if x != s)
            pairs = [(x, s) for x in c1]
            second = [s]
        elif len(inner) == 4 and set(deg.values()) == {2}:
            a = near[0]
            b = min(g[a] & set(near))
            second = [x for x in near if x not in (a, b)]
            c1 = (a, b)
            pairs = [(x, y) for x in c1 for y in second if y not in g[x]]
        else:
            continue
        far = {s: g[s] - {v} - set(second) for s in second}
        for x in (v, *second):
            drop(g, x)
        for x, s in pairs:
            for y in far[s]:
                join(g, x, y)
        log.append(("cliques", (v, c1, tuple(second), tuple(pairs))))
        return len(second)
    return None


def undo(log: list, cover: set[int]) -> set[int]:
    """Cover of the graph before the log's reductions."""
    cover = set(cover)
    for kind, data in reversed(log):
        if kind == "take":
            cover.update(data)
        elif kind == "fold":
            v, a, b = data
            if v in cover:
                cover.discard(v)
                cover.update((a, b))
            else:
                cover.add(v)
        elif kind == "pair":
            v, (p, q), s = data
            cover.add(s if p in cover and q in cover else v)
        elif kind == "three":
            v, a, b, c = data
            have = [x in cover for x in (a, b, c)]
            if sum(have) == 2:
                cover.discard(a if not have[2] else b if not have[0] else c)
                cover.add(v)
            elif sum(have) == 1:
                cover.difference_update((a, b, c))
                cover.add(v)
        elif kind == "cliques":
            v, c1, second, pairs = data
            out = [x for x in c1 if x not in cover]
            if not out:
                cover.update(second)
            else:  # the second clique but the one that the free vertex frees
                free = {s for x, s in pairs if x in out}
                cover.add(v)
                cover.update(s for s in second if s not in free)
    return cover


def rule_degree_three_dominated(g: Graph, log: list) -> int | None:
    return rule_degree_three(g, log, ("dominated",))


def rule_degree_three_edge(g: Graph, log: list) -> int | None:
    return rule_degree_three(g, log, ("edge",))


def rule_degree_three_independent(g: Graph, log: list) -> int | None:
    return rule_degree_three(g, log, ("independent",))


def rule_degree_four_dominated(g: Graph, log: list) -> int | None:
    return rule_degree_four(g, log, ("dominated",))


def rule_degree_four_cliques(g: Graph, log: list) -> int | None:
    return rule_degree_four(g, log, ("cliques",))


#: Rules by name, in the order they are tried, cheapest first. R0 (isolated
#: vertices) is implicit; R3 and R4 need a budget and belong to ``decide``.
RULES = {
    "R1": rule_degree_one, "R2": rule_degree_two, "R10": rule_degree_three_dominated, "R9": rule_degree_three_edge, "R8": rule_degree_three_independent,
    "R11": rule_degree_four_cliques, "R12": rule_degree_four_dominated, "R5": rule_domination, "R6": rule_unconfined, "R7": rule_lp,
}
CHEAP = ("R1", "R2", "R10", "R9", "R12", "R5")
HEAVY = ("R6", "R7")
#: Rules that may add edges without lowering the optimum much, so they are
#: applied a bounded number of times.
GROWING = ("R8", "R11")


def reduce(g: Graph, log: list, heavy: bool = True, growing: bool = False, rules: Iterable[str] | None = None) -> int:
    """Rules to a fixpoint, first applicable rule first; returns the decrease.
    ``rules`` names them; else the cheap ones, with the ``heavy`` (unconfined,
    half-integral) and the ``growing`` ones if asked for."""
    order = tuple(rules) if rules is not None else CHEAP + (HEAVY if heavy else ()) + (GROWING if growing else ())
    total, left = 0, 2 * len(g)
    while g:
        for name in order:
            if name in GROWING:
                left -= 1
                if left < 0:
                    continue
            dec = RULES[name](g, log)
            if dec is not None:
                total += dec
                break
        else:
            break
    return total


# --- bounds ------------------------------------------------------------------


def lp_bound(g: Graph, before: dict[int, int] | None = None) -> int:
    """Half the maximum matching of the double cover, rounded up. ``before``, a
    matching of a larger graph, is brought up to date in place."""
    left = hopcroft_karp(g, before)[0]
    if before is not None:
        before.clear()
        before.update(left)
    return (len(left) + 1) // 2


def clique_bound(g: Graph, stop: int | None = None) -> int:
    """Sum of sizes less one over a greedy partition into cliques, in ascending
    degree; ends early once it exceeds ``stop``."""
    member: dict[int, int] = {}
    cliques: list[set[int]] = []
    bound = 0
    for v in sorted(g, key=lambda x: (len(g[x]), x)):
        seen: dict[int, int] = {}
        for w in g[v]:
            c = member.get(w)
            if c is not None:
                seen[c] = seen.get(c, 0) + 1
        fit = [c for c, n in seen.items() if n == len(cliques[c])]
        if fit:
            c = min(fit, key=lambda x: (-len(cliques[x]), x))
            cliques[c].add(v)
            member[v] = c
            bound += 1
            if stop is not None and bound > stop:
                return bound
        else:
            member[v] = len(cliques)
            cliques.append({v})
    return bound


def cycle_bound(g: Graph) -> int:
    """Sum of half lengths, rounded up, of vertex-disjoint cycles found by
    depth-first search, and of one per edge of a matching in what is left."""
    left = copy(g)
    bound = 0
    at: dict[int, int] = {}  # place on the path, -1 for what was left without a cycle and can't be in one
    for root in sorted(g):
        if root not in left or root in at:
            continue
        at[root] = 0
        path, iters = [root], [iter(sorted(left[root]))]
        while path:
            for w in iters[-1]:
                if w not in left:  # went with a cycle
                    continue
                if w in at:
                    if at[w] >= 0 and len(path) - at[w] > 2:
                        first = at[w]
                        bound += (len(path) - first + 1) // 2
                        for v in path[first:]:
                            drop(left, v)
                        del path[first:], iters[first:]
                        break
                    continue
                at[w] = len(path)
                path.append(w)
                iters.append(iter(sorted(left[w])))
                break
            else:
                at[path.pop()] = -1
                iters.pop()
    used: set[int] = set()
    for v in sorted(left, key=lambda x: (len(left[x]), x)):
        w = next((w for w in sorted(left[v]) if w not in used), None) if v not in used else None
        if w is not None:
            used.update((v, w))
            bound += 1
    return bound


def lower_bound(g: Graph, stop: int | None = None, before: dict[int, int] | None = None) -> int:
    b = clique_bound(g, stop)
    return b if stop is not None and b > stop else max(b, lp_bound(g, before))


# --- heuristics --------------------------------------------------------------


def greedy_max(g: Graph, seed: int | None = None, among: int = 11, reduced: bool = False) -> set[int]:
    """Take a vertex of maximum degree until no edge is left; with a seed, a
    random one of the first ``among`` vertices of that degree."""
    g, log, rng = copy(g), [], random.Random(seed)
    if reduced:
        reduce(g, log, heavy=False)
    buckets: dict[int, set[int]] = {}
    for v, n in g.items():
        buckets.setdefault(len(n), set()).add(v)
    cover: set[int] = set()
    top = max(buckets, default=0)
    while top:
        here = buckets.get(top)
        if not here:
            top -= 1
            continue
        v = min(here) if seed is None else rng.choice(sorted(here)[:among])
        here.discard(v)
        cover.add(v)
        for w in g.pop(v):
            d = len(g[w])
            buckets[d].discard(w)
            g[w].discard(v)
            if d > 1:
                buckets.setdefault(d - 1, set()).add(w)
            else:
                del g[w]
    return undo(log, cover)


def prune(g: Graph, cover: set[int]) -> set[int]:
    """Drop vertices whose neighbours are all in the cover."""
    cover = set(cover)
    for v in sorted(cover, key=lambda x: (len(g.get(x, ())), x)):
        if g.get(v, set()) <= cover:
            cover.discard(v)
    return cover


def greedy_min(g: Graph) -> set[int]:
    """Take all neighbours of a vertex of minimum degree."""
    g, cover = copy(g), set()
    buckets: dict[int, set[int]] = {}
    for v, n in g.items():
        buckets.setdefault(len(n), set()).add(v)
    while g:
        d = min(k for k, b in buckets.items() if b)
        v = min(buckets[d])
        for w in list(g[v]):
            if w not in g:
                continue
            cover.add(w)
            buckets[len(g[w])].discard(w)
            for x in g.pop(w):
                k = len(g[x])
                buckets[k].discard(x)
                g[x].discard(w)
                if k > 1:
                    buckets.setdefault(k - 1, set()).add(x)
                else:
                    del g[x]
    return cover


def best_of(g: Graph, tries: int, seed: int = 0, seconds: float | None = None) -> set[int]:
    """Smallest of the plain, the reduced and ``tries`` randomised greedy
    covers, every second of which starts from a reduced graph; no new try after
    ``seconds``."""
    deadline = None if seconds is None else time.monotonic() + seconds
    best = min((prune(g, c) for c in (greedy_max(g), greedy_max(g, reduced=True), greedy_min(g))), key=len)
    for i in range(tries):
        if deadline is not None and time.monotonic() > deadline:
            break
        c = prune(g, greedy_max(g, seed * 100_003 + i, reduced=bool(i % 2)))
        if len(c) < len(best):
            best = c
    return best


def local_search(g: Graph, cover: set[int], steps: int, seed: int = 0, seconds: float | None = None) -> set[int]:
    """Local search with gain, loss and age: while all is covered, remember the
    cover and drop the vertex of least loss; else exchange the vertex of least
    loss for the end of greater gain of a random uncovered edge."""
    rng, best, cur = random.Random(seed), set(cover), set(cover)
    loss = {v: sum(w not in cur for w in n) for v, n in g.items()}  # in: edges only it covers; out: uncovered edges it would cover
    age = dict.fromkeys(g, 0)
    open_: dict[tuple[int, int], int] = {}  # uncovered edges and their places
    order: list[tuple[int, int]] = []
    deadline = None if seconds is None else time.monotonic() + seconds

    def flag(u: int, v: int, bare: bool) -> None:
        e = (u, v) if u < v else (v, u)
        if bare:
            open_[e] = len(order)
            order.append(e)
        else:
            i, last = open_.pop(e), order.pop()
            if last != e:
                order[i], open_[last] = last, i

    def flip(v: int, into: bool) -> None:
        (cur.add if into else cur.discard)(v)
        for w in g[v]:
            loss[w] += -1 if into else 1
            if w not in cur:
                flag(v, w, not into)

    for step in range(1, steps + 1):
        if deadline is not None and not step % 256 and time.monotonic() > deadline:
            break
        while not order and cur:
            if len(cur) < len(best) or is_cover(g, cur) and len(cur) <= len(best):
                best = set(cur)
            v = min(cur, key=lambda x: (loss[x], age[x], x))
            flip(v, False)
            age[v] = step
        if not order or not cur:
            break
        pool = cur if len(cur) <= 50 else rng.sample(sorted(cur), 50)
        v = min(pool, key=lambda x: (loss[x], age[x], x))
        flip(v, False)
        age[v] = step
        a, b = order[rng.randrange(len(order))]
        u = max((a, b), key=lambda x: (loss[x], -age[x], -x))
        flip(u, True)
        age[u] = step
    return best


# --- exact search ------------------------------------------------------------


def split(g: Graph) -> list[Graph]:
    """Connected components."""
    left, out = set(g), []
    while left:
        root = left.pop()
        part, queue = {root}, [root]
        while queue:
            for w in g[queue.pop()]:
                if w in left:
                    left.discard(w)
                    part.add(w)
                    queue.append(w)
        out.append({v: g[v] for v in part})
    return out


class Packing:
    """After branching on "v in the cover", not all neighbours of v need be in
    it too: some optimal cover has at most deg(v) - 1 of them, else v could be
    left out. A subproblem that takes them all is no better than its sibling."""

    def __init__(self, limits: tuple = ()):
        self.limits = limits  # ((neighbours, at most), ...)

    def after(self, v: int, near: set[int]) -> "Packing":
        return Packing((*self.limits, frozenset(near)))

    def allows(self, cover: set[int]) -> bool:
        return not any(near <= cover for near in self.limits)


def branch_and_bound(g: Graph, best: set[int] | None = None, nodes: int = 200_000, seconds: float | None = None, heavy_every: int = 10, taken: int = 0) -> tuple[set[int], bool, int]:
    """Minimum cover of a graph: ``(cover, proven, nodes used)``.

    Depth-first with an explicit stack: reduce, bound, branch on a vertex of
    maximum degree (take it, or take its neighbours). Starts from ``best`` or a
    greedy cover, and always returns a valid cover. Independent components of a
    subproblem are solved apart.
    """
    best = set(best) if best is not None else best_of(g, 3)
    deadline = None if seconds is None else time.monotonic() + seconds
    used, proven = 0, True
    stack: list[tuple[Graph, list, int, int, dict]] = [(copy(g), [], 0, 0, {})]  # graph, log, cost, depth, matching
    while stack:
        h, log, cost, depth, match = stack.pop()
        if used >= nodes or (deadline is not None and time.monotonic() > deadline):
            proven = False
            break
        used += 1
        cost += reduce(h, log, heavy=depth % heavy_every == 0)
        if cost >= len(best):
            continue
        if not h:
            best = undo(log, set())
            continue
        if cost + lower_bound(h, len(best) - cost - 1, match) >= len(best):
            continue
        parts = split(h)
        if len(parts) > 1:
            cover: set[int] = set()
            for part in sorted(parts, key=len):
                c, ok, n = branch_and_bound(part, None, nodes - used, None if deadline is None else max(0.0, deadline - time.monotonic()), heavy_every)
                cover |= c
                used += n
                proven &= ok
            cover = undo(log, cover)
            if len(cover) < len(best):
                best = cover
            continue
        v = min(h, key=lambda x: (-len(h[x]), x))
        near = sorted(h[v])
        without, with_ = copy(h), h
        for x in near:
            drop(without, x)
        drop(with_, v)
        stack.append((without, [*log, ("take", near)], cost + len(near), depth + 1, dict(match)))
        stack.append((with_, [*log, ("take", [v])], cost + 1, depth + 1, match))
    return best, proven, used


def decide(g: Graph, k: int, nodes: int = 200_000) -> set[int] | None:
    """A cover of at most ``k`` vertices, or None: search with budget, high
    degree and Buss cuts. Raises if the node budget runs out."""
    stack: list[tuple[Graph, list, int]] = [(copy(g), [], k)]
    used = 0
    while stack:
        h, log, left = stack.pop()
        used += 1
        if used > nodes:
            raise RuntimeError("out of nodes")
        while h and left >= 0:
            dec = rule_high_degree(h, left, log)
            dec = reduce(h, log, heavy=False) if dec is None else dec
            left -= dec
            if not dec:
                break
        if left < 0:
            continue
        if not h:
            return undo(log, set())
        if buss_excludes(len(h), n_edges(h), max(map(len, h.values())), left) or lower_bound(h, left) > left:
            continue
        v = min(h, key=lambda x: (-len(h[x]), x))
        near = sorted(h[v])
        if len(near) <= left:
            without = copy(h)
            for x in near:
                drop(without, x)
            stack.append((without, [*log, ("take", near)], left - len(near)))
        drop(h, v)
        stack.append((h, [*log, ("take", [v])], left - 1))
    return None


def smallest(g: Graph, nodes: int = 200_000) -> set[int]:
    """Minimum cover by raising the budget from the lower bound."""
    k = lower_bound(g)
    while (c := decide(g, k, nodes)) is None:
        k += 1
    return c


def vertex_branching(g: Graph, k: int, packing: bool = True) -> set[int] | None:
    """A cover of at most ``k`` vertices, or None: branching on a vertex of
    maximum degree without reduction rules, with packing constraints."""
    stack: list[tuple[Graph, frozenset[int], Packing]] = [(copy(g), frozenset(), Packing())]
    while stack:
        h, cover, limits = stack.pop()
        if len(cover) > k or (packing and not limits.allows(cover)):
            continue
        if not h:
            return set(cover)
        if len(cover) + clique_bound(h, k - len(cover)) > k:
            continue
        v = min(h, key=lambda x: (-len(h[x]), x))
        near = set(h[v])
        without = copy(h)
        for x in near:
            drop(without, x)
        drop(h, v)
        stack += [(without, cover | near, limits), (h, cover | {v}, limits.after(v, near))]
    return None


def edge_branching(g: Graph, k: int) -> set[int] | None:
    """Two-way branching on the ends of an edge, without rules; for tests."""
    stack: list[tuple[Graph, set[int]]] = [(copy(g), set())]
    while stack:
        h, cover = stack.pop()
        if not h:
            return cover
        if len(cover) >= k:
            continue
        u = min(h)
        for x in (min(h[u]), u):
            rest = copy(h)
            drop(rest, x)
            stack.append((rest, cover | {x}))
    return None


def frontier(g: Graph, width: int) -> list[tuple[list[int], list[tuple[int, int]]]]:
    """Split a search into about ``width`` subproblems that together hold an
    optimal solution: (vertices taken, edges left), breadth first."""
    out: list[tuple[list[int], Graph]] = [([], copy(g))]
    while len(out) < width:
        i = max(range(len(out)), key=lambda j: (n_edges(out[j][1]), -j))
        taken, h = out[i]
        if not h:
            break
        del out[i]
        v = min(h, key=lambda x: (-len(h[x]), x))
        near = sorted(h[v])
        without = copy(h)
        for x in near:
            drop(without, x)
        drop(h, v)
        out += [([*taken, v], h), ([*taken, *near], without)]
    return [(t, [(u, v) for u, n in h.items() for v in n if u < v]) for t, h in out]


#: Searches by name, each of a graph for its minimum cover.
SEARCHES = {
    "edges": lambda g: _least(g, lambda k: edge_branching(g, k)),
    "vertices": lambda g: _least(g, lambda k: vertex_branching(g, k, packing=False)),
    "packing": lambda g: _least(g, lambda k: vertex_branching(g, k)),
    "budget": smallest,
    "bounded": lambda g: branch_and_bound(g)[0],
}


def _least(g: Graph, within) -> set[int]:
    """By raising the budget from the half-integral bound."""
    k = lp_bound(g)
    while (c := within(k)) is None:
        k += 1
    return c
