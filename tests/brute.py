"""Direct numpy forms of the clustering operators, for small inputs."""

import numpy as np


def knn(x, k):
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(-1))
    np.fill_diagonal(d, np.inf)
    return np.argsort(np.round(d, 9), axis=1, kind="stable")[:, :k]


def hdbscan(x, min_size, min_samples):
    """Labels of the all-pairs algorithm; merges at equal distance count as one."""
    n = len(x)
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(-1))
    core = np.sort(d, axis=1)[:, min(min_samples, n - 1)]
    m = np.maximum(np.maximum(d, core[:, None]), core[None])
    np.fill_diagonal(m, np.inf)
    inside, dist, src, edges = np.zeros(n, bool), m[0].copy(), np.zeros(n, int), []
    inside[0] = True
    for _ in range(n - 1):
        j = np.where(inside, np.inf, dist).argmin()
        edges.append((dist[j], src[j], j))
        inside[j] = True
        nearer = (m[j] < dist) & ~inside
        dist[nearer], src[nearer] = m[j][nearer], j
    parent, children = list(range(2 * n - 1)), {}
    size, level = {i: 1 for i in range(n)}, {}

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for made, (w, a, b) in enumerate(sorted(edges), start=n):
        a, b = find(a), find(b)
        parent[a] = parent[b] = made
        children[made], level[made], size[made] = (a, b), w, size[a] + size[b]

    def points(c):
        stack, out = [c], []
        while stack:
            c = stack.pop()
            if c < n:
                out.append(c)
            else:
                stack.extend(children[c])
        return out

    clusters, stack = [{"birth": 0.0, "points": [], "kids": []}], [(2 * n - 2, 0)]
    while stack:
        c, owner = stack.pop()
        if c < n:
            continue
        density, parts, rest = 1 / max(level[c], 1e-12), [], list(children[c])
        while rest:
            part = rest.pop()
            if part >= n and level[part] == level[c]:
                rest.extend(children[part])
            else:
                parts.append(part)
        big = [p for p in parts if size[p] >= min_size]
        for part in parts:
            if part not in big:
                clusters[owner]["points"] += [(p, density) for p in points(part)]
            elif len(big) == 1:
                stack.append((part, owner))
            else:
                clusters.append({"birth": density, "points": [], "kids": []})
                clusters[owner]["kids"].append((len(clusters) - 1, size[part], density))
                stack.append((part, len(clusters) - 1))
    mass = [
        sum(v - c["birth"] for _, v in c["points"]) + sum(s * (v - c["birth"]) for _, s, v in c["kids"])
        for c in clusters
    ]
    chosen = {}
    for i in range(len(clusters) - 1, 0, -1):
        below = sum(mass[k] for k, _, _ in clusters[i]["kids"])
        chosen[i] = not (clusters[i]["kids"] and below > mass[i])
        mass[i] = max(mass[i], below)
    labels = np.full(n, -1)

    def mark(i, current):
        current = i if current < 0 and chosen.get(i) else current
        for p, _ in clusters[i]["points"]:
            labels[p] = current
        for k, _, _ in clusters[i]["kids"]:
            mark(k, current)

    mark(0, -1)
    return labels


def same_partition(a, b):
    names = {}
    for x, y in zip(a, b):
        if (x < 0) != (y < 0) or names.setdefault(int(x), int(y)) != int(y):
            return False
    return len(set(names.values())) == len(names)


def dendrogram(basins: list, merges: list[tuple]) -> tuple[np.ndarray, np.ndarray]:
    """Parents and joining distances of the tree over births."""
    n = len(basins)
    index = {b: i for i, b in enumerate(basins)}
    parent = np.full(max(2 * n - 1, 0), -1, dtype=np.int64)
    top = np.full(len(parent), np.inf)
    holder = np.arange(len(parent))

    def find(i: int) -> int:
        while holder[i] != i:
            holder[i] = holder[holder[i]]
            i = holder[i]
        return i

    for made, (w, a, b) in enumerate(sorted(merges), start=n):
        for child in (find(index[a]), find(index[b])):
            parent[child], top[child], holder[child] = made, w, made
    return parent, top


def select_clusters(
    parent: np.ndarray, top: np.ndarray, direct: np.ndarray, density: np.ndarray, densest: np.ndarray, first: list
) -> tuple[np.ndarray, np.ndarray]:
    """Excess-of-mass selection: topic label and highest density per cluster. The root is never
    selected. ``direct`` points leave each cluster themselves, with a ``density`` sum and a
    ``densest`` one; ``first`` is the smallest of them. Topics count from 0 by falling size, then
    by the smallest point."""
    n = len(parent)
    size, peak = direct.astype(np.float64).copy(), densest.copy()
    mass = density.copy()
    first = list(first)
    kept = np.zeros(n)
    chosen = np.zeros(n, dtype=bool)
    below = np.zeros(n)
    for c in range(n):  # children come before their parents
        top_density = 0.0 if np.isinf(top[c]) else 1.0 / max(top[c], 1e-12)
        own = mass[c] - size[c] * top_density
        is_root = parent[c] < 0
        if not is_root and own >= below[c]:
            chosen[c], kept[c] = True, own
        else:
            kept[c] = below[c]
        if not is_root:
            p = parent[c]
            below[p] += kept[c]
            mass[p] += size[c] * top_density
            size[p] += size[c]
            peak[p] = max(peak[p], peak[c])
            first[p] = min((x for x in (first[p], first[c]) if x is not None), default=None)
    owner = np.full(n, -1, dtype=np.int64)
    for c in range(n - 1, -1, -1):  # parents before children: the highest selected one wins
        above = owner[parent[c]] if parent[c] >= 0 else -1
        owner[c] = above if above >= 0 else (c if chosen[c] else -1)
    # A cluster born at the very distance at which it merges holds no points and gets no topic.
    winners = sorted({int(o) for o in owner if o >= 0 and size[o] > 0}, key=lambda c: (-size[c], first[c]))
    topic = {c: i for i, c in enumerate(winners)}
    label = np.array([topic.get(o, -1) for o in owner], dtype=np.int64)
    max_lambda = np.array([peak[o] if o >= 0 else 0.0 for o in owner])
    return label, max_lambda
