"""Numpy algorithms on one graph, for tasks that hold a whole instance. Vertices are 0 to n - 1."""

from __future__ import annotations

from collections import deque

import numpy as np

#: Arcs that level_counts() looks at in one step.
PIECE = 1 << 18


class Graph:
    """Simple undirected graph; neighbours ascend.

    With size, a vertex stands for as many vertices that have the same neighbours and aren't linked with each other (see
    quotient()); degree counts those it stands for."""

    def __init__(self, n: int, u, v, size=None):
        u, v = np.asarray(u, dtype=np.int64), np.asarray(v, dtype=np.int64)
        keep = u != v
        pairs = np.unique(np.minimum(u, v)[keep] * max(n, 1) + np.maximum(u, v)[keep])
        self.n, self.u, self.v = n, pairs // max(n, 1), pairs % max(n, 1)
        src, dst = np.concatenate([self.u, self.v]), np.concatenate([self.v, self.u])
        order = np.lexsort((dst, src))
        self.dst, self.at = dst[order], np.searchsorted(src[order], np.arange(n + 1))
        self.size = np.ones(n, dtype=np.int64) if size is None else np.asarray(size, dtype=np.int64)
        self.total = int(self.size.sum())
        self.degree = np.diff(self.at) if size is None else np.diff(np.concatenate([[0], np.cumsum(self.size[self.dst])])[self.at])

    def near(self, x: int) -> np.ndarray:
        return self.dst[self.at[x] : self.at[x + 1]]

    def slots(self, xs: np.ndarray) -> np.ndarray:
        """Places in dst of the neighbours of xs, one vertex after the other."""
        count = self.at[xs + 1] - self.at[xs]
        return np.arange(count.sum()) + np.repeat(self.at[xs] - np.cumsum(count) + count, count)

    def around(self, xs: np.ndarray) -> np.ndarray:
        """Neighbours of xs, ascending."""
        hit = self.dst[self.slots(np.asarray(xs, dtype=np.int64))]
        if len(hit) < self.n // 8:
            return np.unique(hit)
        mark = np.zeros(self.n, dtype=bool)
        mark[hit] = True
        return np.flatnonzero(mark)

    def levels(self, root: int) -> np.ndarray:
        """Distance from root, -1 where there is no path."""
        d = np.full(self.n, -1, dtype=np.int64)
        d[root], front, k = 0, np.array([root]), 0
        while len(front):
            k += 1
            new = self.around(front)
            front = new[d[new] < 0]
            d[front] = k
        return d

    def level_counts(self, roots: np.ndarray) -> list[tuple[int, int, int]]:
        return level_counts(self.dst, self.at, self.size, roots)

    def quotient(self) -> tuple[Graph, np.ndarray]:
        """The graph of classes of vertices with the same neighbours, and each vertex's class; a class is named by its
        smallest vertex's rank. Vertices without neighbours stay alone."""
        kinds, of, first = {}, np.empty(self.n, dtype=np.int64), []
        for x in range(self.n):
            own = self.near(x)
            of[x] = kinds.setdefault(own.tobytes() if len(own) else x, len(first))
            if of[x] == len(first):
                first.append(x)
        keep = np.zeros(self.n, dtype=bool)
        keep[first] = True
        both = keep[self.u] & keep[self.v]
        return Graph(len(first), of[self.u[both]], of[self.v[both]], np.bincount(of, self.size, len(first)).astype(np.int64)), of

    def parts(self) -> list[np.ndarray]:
        """Components by size (largest first), then smallest vertex."""
        seen, out = np.zeros(self.n, dtype=bool), []
        for x in range(self.n):
            if not seen[x]:
                own = np.flatnonzero(self.levels(x) >= 0)
                seen[own] = True
                out.append(own)
        return sorted(out, key=lambda p: (-len(p), p[0]))

    def bandwidth(self, label: np.ndarray) -> int:
        return int(np.abs(label[self.u] - label[self.v]).max(initial=0))

    def critical(self, label: np.ndarray) -> int:
        d = np.abs(label[self.u] - label[self.v])
        return int((d == d.max(initial=0)).sum())


def arcs(names: np.ndarray, parts: list) -> tuple[np.ndarray, np.ndarray]:
    """dst, at of Graph, with each vertex's neighbours in any order, from pairs of arrays (u, v) of distinct edges u <> v
    between names, which ascend.

    Beside dst, of four bytes a number, it takes what one of the parts does."""
    degree = np.zeros(len(names), dtype=np.int64)
    for part in parts:
        for x in part:
            np.add.at(degree, np.searchsorted(names, x), 1)
    at = np.concatenate([[0], np.cumsum(degree)])
    dst, free = np.empty(at[-1], dtype=np.int32), at[:-1].copy()
    for part in parts:
        u, v = (np.searchsorted(names, x) for x in part)
        src, to = np.concatenate([u, v]), np.concatenate([v, u])
        order = np.argsort(src, kind="stable")
        src = src[order]
        dst[free[src] + np.arange(len(src)) - np.searchsorted(src, src)] = to[order]
        np.add.at(free, src, 1)
    return dst, at


def level_counts(dst: np.ndarray, at: np.ndarray, size: np.ndarray, roots: np.ndarray) -> list[tuple[int, int, int]]:
    """(place in roots, distance, vertices at it) for one vertex of each root; 64 roots at a time, a bit each.

    dst, at and size are those of Graph. Neighbours are looked at PIECE arcs at a time."""
    out, n, degree = [], len(size), np.diff(at)
    linked = np.flatnonzero(degree)
    first = at[linked]
    cuts = np.unique(np.append(np.searchsorted(first, np.arange(0, len(dst), PIECE)), len(linked)))
    pieces = [(linked[i:j], first[i:j] - first[i], slice(first[i], at[linked[j - 1] + 1])) for i, j in zip(cuts[:-1], cuts[1:], strict=True)]
    for begin in range(0, len(roots), 64):
        own = np.asarray(roots[begin : begin + 64])
        every = ~np.uint64(0) >> np.uint64(64 - len(own))
        seen = np.zeros(n, dtype="<u8")
        np.bitwise_or.at(seen, own, np.uint64(1) << np.arange(len(own), dtype="<u8"))
        new, d, twins = seen.copy(), 0, np.where(degree[own] > 0, size[own] - 1, 0)
        front = np.unique(own)
        while len(front):
            count = np.zeros(len(own), dtype=np.int64) if d else np.ones(len(own), dtype=np.int64)
            for k in range(0, len(front) if d else 0, PIECE // 64):
                some = front[k : k + PIECE // 64]
                bits = np.unpackbits(new[some].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")[:, : len(own)]
                count += size[some] @ bits
            count = count + twins if d == 2 else count
            out += [(begin + k, d, int(c)) for k, c in enumerate(count) if c]
            reach, few = np.zeros(n, dtype="<u8"), degree[front]
            if 16 * few.sum() < len(dst):
                slots = np.arange(few.sum()) + np.repeat(at[front] - np.cumsum(few) + few, few)
                np.bitwise_or.at(reach, dst[slots], np.repeat(new[front], few))
            else:
                for xs, starts, part in pieces:
                    if (seen[xs] != every).any():
                        reach[xs] = np.bitwise_or.reduceat(new[dst[part]], starts)
            new = reach & ~seen
            seen |= new
            front = np.flatnonzero(new)
            d += 1
        if d <= 2:  # nothing but twins at a distance of 2
            out += [(begin + k, 2, int(c)) for k, c in enumerate(twins) if c]
    return out


def george_liu(g: Graph, start: int) -> int:
    """A vertex of the last level, of smallest degree, as long as eccentricity grows."""
    d = g.levels(start)
    while True:
        last = np.flatnonzero(d == d.max())
        new = int(last[np.lexsort((last, g.degree[last]))[0]])
        e = g.levels(new)
        if e.max() <= d.max():
            return start
        start, d = new, e


def gps_pair(g: Graph, part: np.ndarray) -> tuple[int, int]:
    """First endpoint: from the vertex of smallest degree, by ascending degree to greater eccentricity; second: the
    vertex of its last level whose level structure is narrowest."""
    q, of = g.quotient()
    counts: dict[int, dict[int, int]] = {}
    own = np.unique(of[part])
    for k, d, c in q.level_counts(own):
        counts.setdefault(int(own[k]), {})[d] = c
    ecc = {x: max(c) for x, c in counts.items()}
    order = part[np.lexsort((part, g.degree[part]))]
    deepest = np.array([ecc[int(x)] for x in of[order]])
    at = 0
    while len(better := np.flatnonzero(deepest > deepest[at])):
        at = int(better[0])
    v = int(order[at])
    d = g.levels(v)
    last = np.flatnonzero(d == d.max())
    width = np.array([max(counts[int(x)].values()) for x in of[last]])
    return v, int(last[np.lexsort((last, width))[0]])


def cuthill_mckee(g: Graph, start: int | None = None) -> np.ndarray:
    """Order of all vertices; components by size, each from `start` or a pseudo-peripheral vertex."""
    order, seen = [], np.zeros(g.n, dtype=bool)
    parts = g.parts()
    if start is not None:
        parts.sort(key=lambda p: start not in p)
    for part in parts:
        root = start if start is not None and start in part else george_liu(g, int(part[np.lexsort((part, g.degree[part]))[0]]))
        queue = deque([root])
        seen[root] = True
        while queue:
            x = queue.popleft()
            order.append(x)
            new = g.near(x)[~seen[g.near(x)]]
            seen[new] = True
            queue.extend(new[np.lexsort((new, g.degree[new]))].tolist())
    return np.array(order, dtype=np.int64)


def labels_of(order: np.ndarray) -> np.ndarray:
    label = np.zeros(len(order), dtype=np.int64)
    label[order] = np.arange(1, len(order) + 1)
    return label


def dependencies(g: Graph, s: int) -> np.ndarray:
    """For one vertex of s as source: on how many paths, by shares, a vertex of each class lies; 0 for s."""
    sigma, dist, steps = np.zeros(g.n), np.full(g.n, -1, dtype=np.int64), []
    sigma[s], dist[s], front = 1, 0, np.array([s])
    while len(front):
        slots = g.slots(front)
        src, dst = np.repeat(front, g.at[front + 1] - g.at[front]), g.dst[slots]
        fits = dist[dst] < 0
        src, dst = src[fits], dst[fits]
        mult = g.size[src] if len(steps) else np.ones(len(src))
        steps.append((src, dst))
        came = np.bincount(dst, mult * sigma[src], g.n)
        front = np.flatnonzero(came > 0) if len(dst) * 8 > g.n else np.unique(dst)
        sigma[front], dist[front] = came[front], len(steps)
    due = np.zeros(g.n)
    if g.size[s] > 1:  # the other vertices of s end two edges away, and no path goes on from there
        due[g.near(s)] += (g.size[s] - 1) / max(1, g.degree[s])
    for src, dst in reversed(steps):
        due += np.bincount(src, g.size[dst] * sigma[src] / sigma[dst] * (1 + due[dst]), g.n)
    due[s] = 0
    return due


def betweenness(g: Graph, sources=None, normalised: bool = True) -> np.ndarray:
    """From all vertices one source a class counts for all of them."""
    scale, out, n = 1.0, np.zeros(g.n), g.total
    if sources is not None:
        sources = list(sources)
        scale = n / max(1, len(sources))
        for s in sources:
            out += dependencies(g, s)
    else:
        q, of = g.quotient()
        every = np.zeros(q.n)
        for s in range(q.n):
            every += q.size[s] * dependencies(q, s)
        out = every[of]
    return out * scale / ((n - 1) * (n - 2)) if normalised and n > 2 else out * scale / 2


def _flow(g: Graph, x: np.ndarray) -> np.ndarray:
    return np.bincount(g.u, x[g.v], g.n) + np.bincount(g.v, x[g.u], g.n)


def _settled(g: Graph, x: np.ndarray, step, rounds: int = 1000, tol: float = 1e-6) -> np.ndarray:
    for _ in range(rounds):
        old, x = x, step(x)
        if np.abs(x - old).sum() < g.n * tol or x.max(initial=0) > 1e100:
            break
    return x


def eigenvector(g: Graph) -> np.ndarray:
    """By powers of A + I, which doesn't swing on bipartite graphs."""

    def step(x):
        x = _flow(g, x) + x
        return x / np.linalg.norm(x)

    return _settled(g, np.full(g.n, 1 / np.sqrt(max(1, g.n))), step) if g.n else np.zeros(0)


def katz(g: Graph, alpha: float = 0.005, beta: float = 1.0) -> np.ndarray:
    """Of unit length; where the sum diverges, its direction, which is the first eigenvector's."""
    x = _settled(g, np.zeros(g.n), lambda x: alpha * _flow(g, x) + beta)
    return x / max(np.linalg.norm(x), 1e-300)


def pagerank(g: Graph, alpha: float = 0.85) -> np.ndarray:
    return _settled(g, np.full(g.n, 1 / max(1, g.n)), lambda x: alpha * _flow(g, x / np.maximum(g.degree, 1)) + (1 - alpha) / g.n)


def _class_laplacian(g: Graph) -> np.ndarray:
    """The Laplacian on vectors that are constant on classes, in the basis of unit vectors. On those that sum to 0 in one
    class and are 0 elsewhere the Laplacian is the class's degree."""
    lap = np.zeros((g.n, g.n))
    lap[g.u, g.v] = lap[g.v, g.u] = -np.sqrt(g.size[g.u] * g.size[g.v])
    np.fill_diagonal(lap, g.degree)
    return lap


def current_flow_betweenness(g: Graph) -> np.ndarray:
    """For a connected graph, by the pseudo-inverse of its Laplacian.

    The flow through an edge from s to t is |p(s) - p(t)| with p the edge's difference of potentials, so the sum over all
    pairs comes from p in order. p is the same for all vertices of a class, the edge's own ends excepted."""
    q, of = g.quotient()
    lap, n = _class_laplacian(q), q.total
    if len(q.parts()) == 1:
        null = np.sqrt(q.size / n)
        inv = np.linalg.inv(lap + np.outer(null, null)) - np.outer(null, null)
    else:
        inv = np.linalg.pinv(lap)
    del lap
    inv /= np.sqrt(np.outer(q.size, q.size))
    out = np.zeros(q.n)
    for u, v in zip(q.u, q.v, strict=True):
        # one vertex of u, one of v, then the others by class
        p = np.concatenate([[0, 0], inv[u] - inv[v]])
        p[2 + u] -= 1 / (q.degree[u] * q.size[u])
        p[2 + v] += 1 / (q.degree[v] * q.size[v])
        p[:2] = p[2 + u] + 1 / q.degree[u], p[2 + v] - 1 / q.degree[v]
        many = np.concatenate([[1, 1], q.size])
        many[2 + u] -= 1
        many[2 + v] -= 1
        order = np.argsort(p)
        w = many[order]
        before = np.cumsum(w) - w
        pairs = (p[order] * w * (2 * before + w - n)).sum()
        out[u] += q.size[v] * (pairs - (many * np.abs(p - p[0])).sum()) / 2
        out[v] += q.size[u] * (pairs - (many * np.abs(p - p[1])).sum()) / 2
    return (out * 2 / ((n - 1) * (n - 2)) if n > 2 else out)[of]


def percolation(g: Graph, state=None) -> np.ndarray:
    """With states of 1 unless given: each path's source counts by its share of all others' state."""
    if state is None:
        return betweenness(g, normalised=False) * 2 / max(1, g.total - 1) / max(1, g.total - 2)
    state = np.asarray(state, dtype=float)
    out, rest = np.zeros(g.n), state.sum() - state
    for s in np.flatnonzero(state):
        out += state[s] * dependencies(g, s)
    return np.where(rest > 0, out / np.where(rest > 0, rest, 1), 0) / max(1, g.n - 2)


def algebraic_connectivity(g: Graph) -> float:
    if g.n < 2 or len(g.parts()) > 1:
        return 0.0
    q, _ = g.quotient()
    return float(min([np.linalg.eigvalsh(_class_laplacian(q))[1], *q.degree[q.size > 1]]))


def eigenvector_dense(g: Graph) -> np.ndarray:
    a = np.zeros((g.n, g.n))
    a[g.u, g.v] = a[g.v, g.u] = 1
    return np.abs(np.linalg.eigh(a)[1][:, -1])


def _max_flow(near: list[dict[int, int]], s: int, t: int, most: int) -> int:
    rest, flow = [dict(x) for x in near], 0
    while flow < most:
        prev, queue = {s: s}, deque([s])
        while queue and t not in prev:
            x = queue.popleft()
            for y, c in rest[x].items():
                if c > 0 and y not in prev:
                    prev[y] = x
                    queue.append(y)
        if t not in prev:
            break
        path, y = [], t
        while y != s:
            path.append((prev[y], y))
            y = prev[y]
        more = min(most - flow, *(rest[x][y] for x, y in path))
        for x, y in path:
            rest[x][y] -= more
            rest[y][x] = rest[y].get(x, 0) + more
        flow += more
    return flow


def _apart(q: Graph, s: int, t: int) -> tuple[Graph, int, int]:
    """q with one vertex of s and one of t (another, if s is t) in classes of their own, and their numbers.

    A flow between them, averaged over all exchanges of vertices within the classes, is a flow between the classes of the
    same value, so classes with the capacities of all their edges or vertices have the same maximum."""
    size, of, ends = q.size.copy(), np.arange(q.n), []
    for x in (s, t):
        if q.size[x] > 1:
            size[x] -= 1
            size, of, x = np.append(size, 1), np.append(of, x), len(of)
        ends.append(x)
    if len(of) == q.n:
        return q, s, t
    u, v = [q.u], [q.v]
    for x in range(q.n, len(of)):
        own = np.flatnonzero(np.isin(of, q.near(of[x])))
        u.append(own)
        v.append(np.full(len(own), x))
    return Graph(len(of), np.concatenate(u), np.concatenate(v), size), *ends


def edge_connectivity(g: Graph) -> int:
    if g.n < 2 or len(g.parts()) > 1:
        return 0
    q, _ = g.quotient()
    best = int(q.degree.min())
    for t in range(q.n):
        if t or q.size[0] > 1:
            own, a, b = _apart(q, 0, t)
            near = [{int(y): int(own.size[x] * own.size[y]) for y in own.near(x)} for x in range(own.n)]
            best = min(best, _max_flow(near, a, b, best))
    return best


def node_connectivity(g: Graph) -> int:
    """Vertices split in two; a vertex of smallest degree against all it isn't linked with, then its neighbours' pairs."""
    if g.n < 2 or len(g.parts()) > 1:
        return 0
    q, _ = g.quotient()
    v, best = int(q.degree.argmin()), int(min(q.degree.min(), q.total - 1))
    linked = set(q.near(v).tolist())

    def cut(s: int, t: int) -> int:
        own, a, b = _apart(q, s, t)
        near = [{own.n + x: int(own.size[x])} for x in range(own.n)] + [{int(y): q.total for y in own.near(x)} for x in range(own.n)]
        return min(best, _max_flow(near, own.n + a, b, best))

    for t in range(q.n):
        if t not in linked and (t != v or q.size[v] > 1):
            best = cut(v, t)
    own = sorted(linked)
    for i, x in enumerate(own):
        beside = set(q.near(x).tolist())
        for y in own[: i + 1]:
            if y not in beside and (x != y or q.size[x] > 1):
                best = cut(x, y)
    return best


def _extremes(g: Graph, label: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Least and greatest label of each vertex's neighbours; out of any reach where it has none."""
    own, low, high = np.flatnonzero(g.degree), np.full(g.n, 4 * g.n), np.full(g.n, -4 * g.n)
    if len(own):
        low[own], high[own] = np.minimum.reduceat(label[g.dst], g.at[own]), np.maximum.reduceat(label[g.dst], g.at[own])
    return low, high


def hill_climb(g: Graph, label: np.ndarray) -> np.ndarray:
    """Swaps of an end of a critical edge with vertices nearer to the middle of its neighbours, while (bandwidth,
    critical edges) falls; ends where no such swap is left that lowers it.

    All partners are judged at once. Labels differ, so a vertex has two critical edges at most, to its neighbours' least
    and greatest label; an edge between the swapped vertices keeps its length."""
    label = label.copy()
    if not len(g.u):
        return label
    low, high = _extremes(g, label)
    while True:
        d = np.abs(label[g.u] - label[g.v])
        width, better = d.max(), False
        for x in np.unique(np.concatenate([g.u[d == width], g.v[d == width]])):
            now = label[x]
            mid = (high[x] + low[x]) // 2
            other = np.flatnonzero(np.abs(mid - label) < abs(mid - now))
            other = other[np.argsort(np.abs(mid - label[other]), kind="stable")]
            there, lo, hi = label[other], low[other], high[other]
            tie = np.isin(other, g.near(x)) & (np.abs(there - now) == width)
            before = (now - low[x] == width) * 1 + (high[x] - now == width) + (there - lo == width) + (hi - there == width) - 2 * tie
            after = (there - low[x] == width) * 1 + (high[x] - there == width) + (now - lo == width) + (hi - now == width)
            fits = (there - low[x] <= width) & (high[x] - there <= width) & (now - lo <= width) & (hi - now <= width)
            good = other[fits & (after < before)]
            if len(good):
                label[[x, good[0]]] = label[[good[0], x]]
                low, high = _extremes(g, label)
                better = True
                width = np.abs(label[g.u] - label[g.v]).max()
        if not better:
            return label


def shake_swaps(g: Graph, label: np.ndarray, k: int, rng) -> np.ndarray:
    """k swaps of a vertex on a long edge with the vertex, among labels between its far neighbour's extremes, whose
    neighbours fit it best."""
    label = label.copy()
    reach = np.array([np.abs(label[g.near(x)] - label[x]).max(initial=0) for x in range(g.n)])
    top = np.argsort(-reach, kind="stable")[: max(k, 1)]
    for _ in range(k):
        x = int(rng.choice(top))
        if not g.degree[x]:
            continue
        far = g.near(x)[np.abs(label[g.near(x)] - label[x]).argmax()]
        lo, hi = label[g.near(far)].min(), label[g.near(far)].max()
        among = np.flatnonzero((label >= lo) & (label <= hi) & (g.degree > 0) & (np.arange(g.n) != x))
        if len(among):
            low, high = _extremes(g, label)
            w = among[np.maximum(high[among] - label[x], label[x] - low[among]).argmin()]
            label[[x, w]] = label[[w, x]]
    return label


def shake_rotations(g: Graph, label: np.ndarray, k: int, rng) -> np.ndarray:
    order = np.argsort(label)
    for _ in range(k):
        length = int(rng.integers(2, max(3, min(20, g.bandwidth(label)) + 1)))
        begin = int(rng.integers(0, max(1, g.n - length + 1)))
        order[begin : begin + length] = np.roll(order[begin : begin + length], -1)
    return labels_of(order)


def vns(g: Graph, label: np.ndarray, k_min: int, k_max: int, k_step: int, alpha: int, seed: int) -> np.ndarray:
    """Variable neighbourhood search: shake, climb, move if better by (bandwidth, critical edges) or, at the same, far
    enough; ends when every k from k_min to k_max was tried in turn without a better one.

    The reference also goes back to k_min after a move to labels that are no better, which need not end."""
    rng = np.random.default_rng(seed)
    now, k = hill_climb(g, label), k_min
    while k <= k_max:
        tried = hill_climb(g, shake_swaps(g, now, k, rng) if k <= 100 else shake_rotations(g, now, (k - k_min) // k_step, rng))
        a, b = (g.bandwidth(tried), g.critical(tried)), (g.bandwidth(now), g.critical(now))
        if a < b or (a == b and (tried != now).sum() > alpha):
            now = tried
        k = k_min if a < b else k + k_step
    return now if g.bandwidth(now) < g.bandwidth(label) else label


def level_order(g: Graph, centrality: np.ndarray, alpha: float, rng, root: int | None = None, pick=None) -> np.ndarray:
    """Breadth-first order; at each level `pick(size, left)` or the one centrality decides, candidates above the
    threshold come first in random order, the others wait for the next level."""
    left = np.ones(g.n, dtype=bool)
    order, front = [], []
    tables = centrality if centrality.ndim == 2 else centrality[None]
    while left.any():
        if not len(front):
            free = np.flatnonzero(left)
            front = [root] if root is not None and left[root] else [int(rng.choice(free))]
        which = pick(len(front), left.sum() / g.n) if pick else 0
        c = tables[which][front]
        limit = c.max() + alpha * (c.min() - c.max())
        chosen = rng.permutation(np.asarray(front)[c <= limit])
        left[chosen] = False
        order += chosen.tolist()
        front, reach = np.asarray(front), g.around(chosen)
        front = np.union1d(front[left[front]], reach[left[reach]])
    return np.array(order)


class TabularAgent:
    """Epsilon-greedy Q-learning with random tie-break."""

    def __init__(self, actions: int, lr: float = 0.1, gamma: float = 0.9, eps: float = 1.0, decay: float = 0.995, least: float = 0.01, seed: int = 0):
        self.q, self.actions, self.lr, self.gamma, self.eps, self.decay, self.least = {}, actions, lr, gamma, eps, decay, least
        self.rng = np.random.default_rng(seed)

    def row(self, state) -> np.ndarray:
        return self.q.setdefault(state, np.zeros(self.actions))

    def choose(self, state) -> int:
        if self.rng.random() < self.eps:
            return int(self.rng.integers(self.actions))
        row = self.row(state)
        return int(self.rng.choice(np.flatnonzero(row == row.max())))

    def learn(self, state, action: int, reward: float, after, done: bool) -> None:
        target = reward + (0 if done else self.gamma * self.row(after).max())
        self.row(state)[action] += self.lr * (target - self.row(state)[action])

    def end_episode(self) -> None:
        self.eps = max(self.least, self.eps * self.decay)


class NetworkAgent(TabularAgent):
    """The same with a 4-128-128-A network by Adam in place of the table."""

    def __init__(self, actions: int, hidden: int = 128, **how):
        super().__init__(actions, **({"lr": 1e-3} | how))
        sizes = [4, hidden, hidden, actions]
        self.p = [w for a, b in zip(sizes, sizes[1:], strict=False) for w in (self.rng.uniform(-1, 1, (a, b)) / np.sqrt(a), np.zeros(b))]
        self.m, self.s, self.t = [0 * w for w in self.p], [0 * w for w in self.p], 0

    def _forward(self, x):
        a = np.maximum(x @ self.p[0] + self.p[1], 0)
        b = np.maximum(a @ self.p[2] + self.p[3], 0)
        return a, b, b @ self.p[4] + self.p[5]

    def row(self, state) -> np.ndarray:
        return self._forward(np.asarray(state, dtype=float))[2]

    def learn(self, state, action, reward, after, done) -> None:
        x = np.asarray(state, dtype=float)
        a, b, q = self._forward(x)
        g = np.zeros(self.actions)
        g[action] = 2 * (q[action] - reward - (0 if done else self.gamma * self.row(after).max())) / self.actions
        gb = (self.p[4] @ g) * (b > 0)
        ga = (self.p[2] @ gb) * (a > 0)
        self.t += 1
        for k, d in enumerate((np.outer(x, ga), ga, np.outer(a, gb), gb, np.outer(b, g), g)):
            self.m[k], self.s[k] = 0.9 * self.m[k] + 0.1 * d, 0.999 * self.s[k] + 0.001 * d * d
            self.p[k] = self.p[k] - self.lr * (self.m[k] / (1 - 0.9**self.t)) / (np.sqrt(self.s[k] / (1 - 0.999**self.t)) + 1e-8)
