"""The hierarchy from a dense distance matrix, top down: what the distributed fit is held against.

Definitions follow Campello, Moulavi, Zimek, Sander (TKDD 2015) and McInnes & Healy (2017).
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


def mutual_reachability(x, min_samples):
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(-1))
    core = np.sort(d, axis=1)[:, min(min_samples, len(x) - 1)]
    return np.maximum(np.maximum(d, core[:, None]), core[None]), core


def kruskal(reach):
    """Tree edges (lo, hi, w) in the order of (w, lo, hi)."""
    n = len(reach)
    lo, hi = np.triu_indices(n, 1)
    order = np.lexsort((hi, lo, reach[lo, hi]))
    comp, out = list(range(n)), []

    def find(v):
        while comp[v] != v:
            v = comp[v]
        return v

    for e in order:
        a, b = find(lo[e]), find(hi[e])
        if a != b:
            comp[max(a, b)] = min(a, b)
            out.append((lo[e], hi[e], reach[lo[e], hi[e]]))
    return np.array(out, float).reshape(-1, 3)


def single_linkage(edges: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Merge rows (left, right, distance, size) from MST edges sorted by (weight, a, b)."""
    n = len(weight)
    order = np.lexsort((edges[:, 1], edges[:, 0], edges[:, 2])) if len(edges) else np.zeros(0, int)
    parent = np.arange(2 * n - 1)
    size = np.concatenate([weight.astype(float), np.zeros(n - 1)])

    def find(x):
        root = x
        while parent[root] != root:
            root = parent[root]
        while parent[x] != root:
            parent[x], x = root, parent[x]
        return root

    out = np.zeros((n - 1, 4))
    nxt = n
    for k, e in enumerate(order):
        a, b, w = int(edges[e, 0]), int(edges[e, 1]), edges[e, 2]
        ra, rb = find(a), find(b)
        out[k] = (ra, rb, w, size[ra] + size[rb])
        size[nxt] = size[ra] + size[rb]
        parent[ra] = parent[rb] = nxt
        nxt += 1
    return out


@dataclass
class CondensedTree:
    parent: np.ndarray
    child: np.ndarray
    lam: np.ndarray
    child_size: np.ndarray
    n_items: int

    @property
    def root(self) -> int:
        return self.n_items


def condense(hier: np.ndarray, weight: np.ndarray, min_cluster_size: float) -> CondensedTree:
    n = len(weight)
    if n == 1:
        return CondensedTree(np.array([1]), np.array([0]), np.array([np.inf]), np.array([weight[0]]), 1)
    root = 2 * n - 2
    size = np.concatenate([weight.astype(float), hier[:, 3]])
    relabel = {root: n}
    next_label = n + 1
    rows: list[tuple[int, int, float, float]] = []

    def leaves(node: int) -> list[int]:
        out, stack = [], [node]
        while stack:
            x = stack.pop()
            if x < n:
                out.append(x)
            else:
                l, r = int(hier[x - n, 0]), int(hier[x - n, 1])
                stack += [r, l]
        return out

    queue = [root]
    head = 0
    while head < len(queue):
        node = queue[head]
        head += 1
        if node < n:
            continue
        left, right, dist = int(hier[node - n, 0]), int(hier[node - n, 1]), hier[node - n, 2]
        lam = 1.0 / dist if dist > 0 else np.inf
        lc, rc = size[left], size[right]
        me = relabel[node]
        if lc >= min_cluster_size and rc >= min_cluster_size:
            for ch, cs in ((left, lc), (right, rc)):
                relabel[ch] = next_label
                next_label += 1
                rows.append((me, relabel[ch], lam, cs))
                queue.append(ch)
        elif lc < min_cluster_size and rc < min_cluster_size:
            for ch in (left, right):
                for leaf in leaves(ch):
                    rows.append((me, leaf, lam, weight[leaf]))
        else:
            small, big = (left, right) if lc < min_cluster_size else (right, left)
            for leaf in leaves(small):
                rows.append((me, leaf, lam, weight[leaf]))
            if big < n:
                rows.append((me, big, lam, weight[big]))
            else:
                relabel[big] = me
                queue.append(big)
    a = np.array(rows, dtype=float)
    return CondensedTree(a[:, 0].astype(np.int64), a[:, 1].astype(np.int64), a[:, 2], a[:, 3], n)


@dataclass
class Selection:
    selected: list[int]
    birth: dict[int, float]
    cluster_parent: dict[int, int]
    item_node: np.ndarray          # condensed parent of each item
    item_lambda: np.ndarray        # fall-out lambda of each item
    item_cluster_node: np.ndarray  # selected node containing each item, or -1
    deaths_direct: dict[int, float]
    deaths_subtree: dict[int, float]


def select_eom(tree: CondensedTree, *, allow_single_cluster: bool = False, method: str = "eom") -> Selection:
    n = tree.n_items
    is_cl_row = tree.child >= n
    nodes = sorted(set(tree.parent.tolist()) | set(tree.child[is_cl_row].tolist()))
    birth = {tree.root: 0.0}
    cluster_parent: dict[int, int] = {}
    for p, c, l in zip(tree.parent[is_cl_row], tree.child[is_cl_row], tree.lam[is_cl_row]):
        birth[int(c)] = float(l)
        cluster_parent[int(c)] = int(p)
    stability = {c: 0.0 for c in nodes}
    deaths_direct = {c: 0.0 for c in nodes}
    for p, l, s in zip(tree.parent, tree.lam, tree.child_size):
        lam = l if np.isfinite(l) else 0.0
        stability[int(p)] += (lam - birth[int(p)]) * s
        deaths_direct[int(p)] = max(deaths_direct[int(p)], l)
    children: dict[int, list[int]] = {c: [] for c in nodes}
    for c, p in cluster_parent.items():
        children[p].append(c)
    order = sorted(nodes, reverse=True)
    if not allow_single_cluster:
        order = [c for c in order if c != tree.root]
    is_cluster = {c: True for c in order}
    if method == "leaf":
        for c in order:
            is_cluster[c] = not children[c]
    else:
        for c in order:
            sub = sum(stability[ch] for ch in children[c])
            if sub > stability[c]:
                is_cluster[c] = False
                stability[c] = sub
            else:
                stack = list(children[c])
                while stack:
                    x = stack.pop()
                    is_cluster[x] = False
                    stack += children[x]
    selected = sorted(c for c, v in is_cluster.items() if v)
    sel = set(selected)
    deaths_subtree = dict(deaths_direct)
    for c in sorted(nodes, reverse=True):
        if c in cluster_parent:
            p = cluster_parent[c]
            deaths_subtree[p] = max(deaths_subtree[p], deaths_subtree[c])
    # nearest selected ancestor (or self) of every node
    anc: dict[int, int] = {}
    for c in sorted(nodes):
        if c in sel:
            anc[c] = c
        elif c in cluster_parent:
            anc[c] = anc.get(cluster_parent[c], -1)
        else:
            anc[c] = -1
    pts = tree.child < n
    item_node = np.full(n, tree.root, dtype=np.int64)
    item_lambda = np.zeros(n)
    item_node[tree.child[pts]] = tree.parent[pts]
    item_lambda[tree.child[pts]] = tree.lam[pts]
    item_cluster = np.array([anc.get(int(x), -1) for x in item_node], dtype=np.int64)
    return Selection(selected, birth, cluster_parent, item_node, item_lambda, item_cluster, deaths_direct, deaths_subtree)


def item_scores(sel: Selection) -> tuple[np.ndarray, np.ndarray]:
    """Training membership probability (I7) and GLOSH outlier score (I8) per item."""
    n = len(sel.item_node)
    prob = np.zeros(n)
    glosh = np.zeros(n)
    for i in range(n):
        lam = sel.item_lambda[i]
        c = sel.item_cluster_node[i]
        if c >= 0:
            mx = sel.deaths_direct[c]
            prob[i] = 1.0 if (mx == 0 or not np.isfinite(lam)) else min(lam, mx) / mx
        mxs = sel.deaths_subtree[int(sel.item_node[i])]
        glosh[i] = 0.0 if (mxs == 0 or not np.isfinite(lam) or not np.isfinite(mxs)) else (mxs - lam) / mxs
    return prob, glosh


def fit(x, mcs, ms, method="eom", allow_single_cluster=False):
    """(cluster of each row numbered by smallest row, membership, outlier score)."""
    reach, _ = mutual_reachability(x, ms)
    weight = np.ones(len(x))
    tree = condense(single_linkage(kruskal(reach), weight), weight, mcs)
    sel = select_eom(tree, allow_single_cluster=allow_single_cluster, method=method)
    prob, glosh = item_scores(sel)
    first = {}
    for i, c in enumerate(sel.item_cluster_node):
        if c >= 0:
            first.setdefault(c, len(first))
    return np.array([first.get(c, -1) for c in sel.item_cluster_node]), prob, glosh
