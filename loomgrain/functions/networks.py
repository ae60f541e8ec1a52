"""Order-dependent work on one graph: plain lists of coordinates and edges, called inside Spark tasks.

A graph is (xy, pairs): coordinates by node number, and pairs of node numbers in their order of insertion.
"""

from __future__ import annotations

import heapq
import math
from collections import defaultdict

import numpy as np

Points, Pairs = list[tuple[float, float]], list[tuple[int, int]]


class Links:
    """Neighbours by node, each node's in order of insertion."""

    def __init__(self, n: int, pairs: Pairs):
        self.near: list[dict[int, None]] = [{} for _ in range(n)]
        for a, b in pairs:
            self.join(a, b)

    def join(self, a: int, b: int) -> None:
        if a != b:
            self.near[a][b] = None
            self.near[b][a] = None

    def part(self, a: int, b: int) -> None:
        self.near[a].pop(b, None)
        self.near[b].pop(a, None)

    def degree(self, a: int) -> int:
        return len(self.near[a])

    def move(self, a: int, b: int) -> None:
        """All edges of a become edges of b."""
        for c in list(self.near[a]):
            self.part(a, c)
            if c != b:
                self.join(b, c)

    def pairs(self) -> Pairs:
        return [(a, b) for a in range(len(self.near)) for b in self.near[a] if a < b]


def keep_nodes(xy: Points, links: Links, keep: list[int]) -> tuple[Points, Pairs]:
    new = {v: i for i, v in enumerate(keep)}
    return [xy[v] for v in keep], [(new[a], new[b]) for a, b in links.pairs() if a in new and b in new]


def merge_near(xy: Points, pairs: Pairs, within: float) -> tuple[Points, Pairs]:
    """Rounds of: find all pairs closer than `within`, by the larger then the smaller number; of each, the node with more
    edges gives them to the other; drop what has no edges (or keep one node if none has). Until a round finds no pair."""
    while True:
        close = _close(xy, within)
        links = Links(len(xy), pairs)
        for a, b in close:
            if links.degree(a) > links.degree(b):
                links.move(a, b)
            elif links.degree(a) + links.degree(b):
                links.move(b, a)
        keep = [v for v in range(len(xy)) if links.degree(v)] or list(range(min(1, len(xy))))
        none = not any(links.near)
        xy, pairs = keep_nodes(xy, links, keep)
        if not close or none:
            return xy, pairs


def _close(xy: Points, within: float) -> list[tuple[int, int]]:
    """(larger, smaller) numbers of points closer than `within`, found by grid cells, in order."""
    if within <= 0:
        return []
    cells = defaultdict(list)
    out = []
    for i, (y, x) in enumerate(xy):
        cy, cx = math.floor(y / within), math.floor(x / within)
        for dy in (-1, 0, 1):
            for dx in (-1, 0, 1):
                out += [(i, j) for j in cells[cy + dy, cx + dx] if (xy[j][0] - y) ** 2 + (xy[j][1] - x) ** 2 < within * within]
        cells[cy, cx].append(i)
    return sorted(out)


def components(n: int, pairs: Pairs) -> list[list[int]]:
    links, seen, out = Links(n, pairs), [False] * n, []
    for start in range(n):
        if not seen[start]:
            seen[start], part = True, [start]
            for v in part:
                for w in links.near[v]:
                    if not seen[w]:
                        seen[w] = True
                        part.append(w)
            out.append(sorted(part))
    return out


def clean(xy: Points, pairs: Pairs, within: float) -> tuple[Points, Pairs]:
    links = Links(len(xy), pairs)
    xy, pairs = keep_nodes(xy, links, [v for v in range(len(xy)) if links.degree(v)])
    if not xy:
        return [], []
    xy, pairs = merge_near(xy, pairs, within)
    links = Links(len(xy), pairs)
    keep = []
    for part in components(len(xy), pairs):
        degrees = [links.degree(v) for v in part]
        if sum(d > 1 for d in degrees) >= 2 and sum(d == 1 for d in degrees) >= 2:
            keep += part
    return keep_nodes(xy, links, [v for v in sorted(keep) if links.degree(v)])


def contract(n: int, pairs: Pairs) -> tuple[list[int], Links]:
    """(numbers of the nodes left, links): edges between nodes of degree up to 2, not both 1, are contracted into their
    lower-degree end until none is left."""
    links, alive = Links(n, pairs), set(range(n))
    while True:
        todo = []
        for a, b in links.pairs():
            da, db = links.degree(a), links.degree(b)
            if max(da, db) <= 2 and da + db > 2:
                todo.append((a, b) if da <= db else (b, a))
        if not todo:
            return sorted(alive), links
        for a, b in todo:
            if a in alive and b in alive and b in links.near[a]:
                links.move(b, a)
                alive.discard(b)


def simplify(xy: Points, pairs: Pairs) -> tuple[Points, Pairs]:
    """The graph after contract()."""
    left, links = contract(len(xy), pairs)
    return keep_nodes(xy, links, left)


def fibres_of(xy: Points, pairs: Pairs, angle: float = 70.0, least: int = 4) -> list[list[int]]:
    """Paths grown straight ahead from nodes of low degree; a path of at least `least` nodes retires all its nodes as starts."""
    links = Links(len(xy), pairs)
    limit = 1 + math.cos(math.radians(180 - angle))
    retired, out = set(), []
    for start in sorted(range(len(xy)), key=links.degree):
        if start in retired or not links.near[start]:
            continue
        first = sorted(links.near[start], key=links.degree)[-1]
        path = [start, first]
        while True:
            end = path[-1]
            dy, dx = xy[start][0] - xy[end][0], xy[start][1] - xy[end][1]
            norm = math.hypot(dy, dx)
            best = None
            for v in links.near[end]:
                if v in path:
                    continue
                ey, ex = xy[v][0] - xy[end][0], xy[v][1] - xy[end][1]
                far = math.hypot(ey, ex)
                turn = 1 + (dy * ey + dx * ex) / (norm * far) if norm and far else 1.0
                if turn <= limit and (best is None or turn < best[0]):
                    best = (turn, v)
            if best is None:
                break
            path.append(best[1])
        if len(path) >= least:
            retired.update(path)
            out.append(path)
    return out


def networks_with_fibres(xy: Points, pairs: Pairs, angle: float = 70.0, least: int = 4) -> list[tuple[list[int], Pairs, list[list[int]]]]:
    """(nodes, edges, fibres) of each component that has any fibre, components by node count ascending."""
    parts = components(len(xy), pairs)
    of = {v: k for k, part in enumerate(parts) for v in part}
    edges: list[Pairs] = [[] for _ in parts]
    for a, b in pairs:
        edges[of[a]].append((a, b))
    found = []
    for part, own in zip(parts, edges, strict=True):
        new = {v: i for i, v in enumerate(part)}
        fibres = fibres_of([xy[v] for v in part], [(new[a], new[b]) for a, b in own], angle, least)
        if fibres:
            found.append((part, own, [[part[i] for i in f] for f in fibres]))
    return sorted(found, key=lambda t: len(t[0]))


def spectrum(n: int, e: np.ndarray, r: np.ndarray, dense: int = 2000) -> tuple[float | None, float | None]:
    """(largest adjacency eigenvalue, second-smallest eigenvalue of the r-weighted Laplacian); null below two nodes."""
    if n < 2:
        return (0.0 if n else None), None
    if n <= dense:
        a, w = np.zeros((n, n)), np.zeros((n, n))
        a[e[:, 0], e[:, 1]] = a[e[:, 1], e[:, 0]] = 1
        w[e[:, 0], e[:, 1]] = w[e[:, 1], e[:, 0]] = r
        return float(np.linalg.eigvalsh(a)[-1]), float(np.linalg.eigvalsh(np.diag(w.sum(0)) - w)[1])

    ones: list[dict[int, float]] = [{} for _ in range(n)]
    weights: list[dict[int, float]] = [{} for _ in range(n)]
    for a, b, x in zip(e[:, 0].tolist(), e[:, 1].tolist(), np.asarray(r, float).tolist(), strict=True):
        ones[a][b] = ones[b][a] = 1.0
        if a != b and x > 0:
            weights[a][b] = weights[b][a] = x
        elif a != b:
            weights[a].pop(b, None)
            weights[b].pop(a, None)
    whole = len(components(n, [(a, b) for a in range(n) for b in weights[a] if a < b])) == 1
    return _largest(ones), (_fiedler(weights) if whole else 0.0)


class _Factor:
    """The Laplacian of a connected graph, or with diag diag - near, nodes eliminated by fewest neighbours first.

    With diag, elimination only tells whether the matrix is positive definite: it is if all pivots are positive.
    """

    def __init__(self, near: list[dict[int, float]], diag: list[float] | None = None):
        near = [{j: x for j, x in row.items() if j != i} for i, row in enumerate(near)]
        heap = [(len(row), i) for i, row in enumerate(near)]
        heapq.heapify(heap)
        gone, self.steps, self.positive = [False] * len(near), [], True
        diag, laplacian = list(diag or ()), diag is None
        while heap:
            k, v = heapq.heappop(heap)
            if gone[v] or k != len(near[v]):
                continue
            gone[v] = True
            row = list(near[v].items())
            pivot = sum(x for _, x in row) if laplacian else diag[v]  # sums of positive weights lose no digits
            if pivot <= 0 and not laplacian:
                self.positive = False
                return
            self.steps.append((v, pivot, row))
            for i, (a, x) in enumerate(row):
                del near[a][v]
                if not laplacian:
                    diag[a] -= x * x / pivot
                for b, y in row[i + 1 :]:
                    near[a][b] = near[b][a] = near[a].get(b, 0.0) + x * y / pivot
            for a, _ in row:
                heapq.heappush(heap, (len(near[a]), a))
    def solve(self, b: np.ndarray) -> np.ndarray:
        """The solution of mean 0; b has mean 0."""
        x = b.tolist()
        for v, pivot, row in self.steps[:-1]:
            share = x[v] / pivot
            for a, w in row:
                x[a] += w * share
        x[self.steps[-1][0]] = 0.0
        for v, pivot, row in reversed(self.steps[:-1]):
            x[v] = (x[v] + sum(w * x[a] for a, w in row)) / pivot
        out = np.array(x)
        return out - out.mean()


def _largest(near: list[dict[int, float]], tol: float = 1e-10) -> float:
    """Largest adjacency eigenvalue, enclosed: a Rayleigh quotient is below it, c above if c - near is positive definite."""
    n = len(near)
    a, b = np.array([(i, j) for i, row in enumerate(near) for j in row]).T
    v = np.ones(n)
    for _ in range(2000):  # only a good start
        v = np.bincount(a, v[b], n) + v
        v /= np.linalg.norm(v)
    low = float(v @ np.bincount(a, v[b], n))
    width, high = tol * low, math.inf
    while high - low > 1.01 * tol * low:
        c = low + width if high == math.inf else (low + high) / 2
        if _Factor(near, [c - (i in row) for i, row in enumerate(near)]).positive:
            high = c
        else:
            low, width = c, 16 * width
    return low


def _fiedler(near: list[dict[int, float]], tol: float = 1e-10) -> float:
    """Second-smallest Laplacian eigenvalue of a connected graph: Lanczos on the inverse until the residual is below tol."""
    n, factor = len(near), _Factor(near)
    q = np.random.default_rng(0).standard_normal(n)
    q -= q.mean()
    basis, alpha, beta = [q / np.linalg.norm(q)], [], []
    while True:
        z = factor.solve(basis[-1])
        alpha.append(float(z @ basis[-1]))
        for _ in range(2):
            z -= z.mean()
            for u in basis:
                z -= (z @ u) * u
        rest = float(np.linalg.norm(z))
        values, vectors = np.linalg.eigh(np.diag(alpha) + np.diag(beta, 1) + np.diag(beta, -1))
        if rest * abs(vectors[-1, -1]) <= tol * values[-1] or len(alpha) == n - 1:
            return float(1 / values[-1])
        beta.append(rest)
        basis.append(z / rest)


# ---------------------------------------------------------------- tracing


def thin(points: Points, weights: list[float], thresh: float) -> list[int]:
    """Numbers of the points left: of each pair i < j within sqrt(2) * thresh, i goes if its weight isn't smaller, else j."""
    gone = set()
    for i in range(len(points)):
        for j in range(i + 1, len(points)):
            d = math.dist(points[i], points[j])
            if 0 < d <= math.sqrt(2) * thresh + 1e-12:
                gone.add(i if weights[i] >= weights[j] else j)
    return [i for i in range(len(points)) if i not in gone]


def on_ring(img: np.ndarray, y: int, x: int, half: int, least: float) -> list[tuple[int, int]]:
    """Places on the square ring around (y, x) where the ring's values peak at `least` or more, thinned, row-major.

    Only the window around the ring is looked at, so the cost doesn't depend on the image.
    """
    from loomgrain.functions.kernels import local_maxima

    y0, x0 = max(0, y - half - 1), max(0, x - half - 1)
    win = img[y0 : y + half + 2, x0 : x + half + 2]
    far = np.maximum(np.abs(np.arange(y0, y0 + win.shape[0]) - y)[:, None], np.abs(np.arange(x0, x0 + win.shape[1]) - x)[None])
    ring = np.where(far == half, win, 0.0)
    peak = local_maxima(ring) & (win >= least) & (far == half)
    pts = [(int(a) + y0, int(b) + x0) for a, b in np.argwhere(peak)]
    return [pts[i] for i in thin(pts, [float(img[p]) for p in pts], 1)]


def nuclei(img: np.ndarray, least: float, thresh: float) -> list[tuple[int, int]]:
    from loomgrain.functions.kernels import local_maxima

    pts = [(int(a), int(b)) for a, b in np.argwhere(local_maxima(img) & (img >= least))]
    return [pts[i] for i in thin(pts, [float(img[p]) for p in pts], thresh)]


class Tracer:
    """Grows a network of nodes and edges over a distance image, tip by tip."""

    def __init__(self, img: np.ndarray, nuc_thresh: float = 2, lmp_thresh: float = 0.15, angle: float = 70, r_thresh: float = 8):
        self.img, self.nuc_thresh, self.lmp_thresh, self.r_thresh = img, nuc_thresh, lmp_thresh, r_thresh
        self.limit = 1 + math.cos(math.radians(180 - angle))
        self.xy: list[tuple[int, int]] = []
        self.links = Links(0, [])
        self.nucleus: dict[int, int] = {}
        self.direction: dict[int, tuple[float, float]] = {}
        self.tips: list[int] = []

    def node(self, place: tuple[int, int]) -> int:
        self.xy.append(place)
        self.links.near.append({})
        return len(self.xy) - 1

    def seed(self, places: list[tuple[int, int]]) -> None:
        for p in places:
            self.node(p)
        for k, (y, x) in enumerate(places):
            for p in on_ring(self.img, y, x, int(self.r_thresh // 2), self.lmp_thresh):
                v = self.node(p)
                self.links.join(k, v)
                r = math.dist(p, (y, x))
                self.nucleus[v], self.direction[v] = k, ((p[0] - y) / r, (p[1] - x) / r)
                self.tips.append(v)

    def grow(self, tip: int, before: list[tuple[int, int]]) -> None:
        """One step of one tip; `before` are all nodes' places when the sweep began."""
        y, x = self.xy[tip]
        prior = next(iter(self.links.near[tip]))
        dy, dx = self.direction[tip]
        kept = []
        for p in on_ring(self.img, y, x, 2, self.lmp_thresh):
            r = math.dist(p, (y, x))
            if abs((dy * (y - p[0]) + dx * (x - p[1])) / r + 1) <= self.limit:
                kept.append((r, p))
        if not kept:
            self.tips.remove(tip)
            if math.dist((y, x), self.xy[prior]) <= self.r_thresh / 10:
                self.links.move(tip, prior)
            return
        met = sorted({i for i, q in enumerate(before) for _, p in kept if math.dist(p, q) <= 1})
        met = [i for i in met if i not in self.links.near[tip] and i != tip]
        if met:
            self.links.move(tip, met[0])
            self.tips.remove(tip)
            return
        far = max(kept, key=lambda t: t[0])[1]
        root = self.xy[self.nucleus[tip]]
        away = math.dist(far, root)
        heading = ((far[0] - root[0]) / away, (far[1] - root[1]) / away) if away else (dy, dx)
        if math.dist(far, self.xy[prior]) >= self.r_thresh:
            v = self.node(far)
            self.links.join(tip, v)
            self.nucleus[v], self.direction[v] = self.nucleus[tip], heading
            self.tips[self.tips.index(tip)] = v
        else:
            self.xy[tip] = far
            self.direction[tip] = heading

    def run(self) -> tuple[Points, Pairs]:
        self.seed(nuclei(self.img, self.nuc_thresh, self.r_thresh))
        seen = set()
        while self.tips:  # every sweep moves each tip on or retires it
            before = list(self.xy)
            for tip in list(self.tips):
                self.grow(tip, before)
            state = (len(self.xy), tuple((t, self.xy[t], self.direction[t]) for t in self.tips))
            if state in seen:  # tips that go round in circles would do so for ever
                break
            seen.add(state)
        return [(float(y), float(x)) for y, x in self.xy], self.links.pairs()
