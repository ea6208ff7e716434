"""The condensed tree of a spanning tree, from the bottom up over sorted edges (I4-I8), for many fits at once.

Edges are cut into runs by range of (grp, weight, ids); a run of all groups is one step, each group's
part of it one bounded task.  A task joins components in the order of weight and knows of each only a
short state: size, and either its members (fewer than ``min_cluster_size``) or its open cluster's sums.
From the state follows all that the top-down definition gives:

* two components below the size that reach it together open a cluster, their rows fall out of it at 1 / w;
* a small one that meets a large one falls out of the large one's cluster at 1 / w;
* two large ones close both clusters, whose stability and best selection below are then known, and
  open their parent.

So the result doesn't depend on where runs are cut, and no task or driver ever holds a group's tree.
"""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quorum.session import stored

#: edges of a run
RUN = 200_000

_OUT = "kind string, grp long, a long, b long, x array<double>, members array<long>"
_STATE = ["size", "s", "rows", "direct", "below", "kids", "has_kids"]


class _Part:
    """A component: its size and, below the least cluster size, its members, else its open cluster's sums."""

    __slots__ = ("size", "members", "cluster", "s", "rows", "direct", "below", "kids", "has_kids")

    def __init__(self, size=1.0, members=None, cluster=None, s=0.0, rows=0.0, direct=0.0, below=0.0, kids=0.0, has_kids=0.0):
        self.size, self.members, self.cluster = size, members, cluster
        self.s, self.rows, self.direct, self.below, self.kids, self.has_kids = s, rows, direct, below, kids, has_kids

    def add(self, lam: float, size: float) -> None:
        """Rows or a child of that size leave the cluster at ``lam``; an infinite one counts 0 in the stability."""
        self.s += (lam if math.isfinite(lam) else 0.0) * size
        self.rows += size
        self.direct, self.below = max(self.direct, lam), max(self.below, lam)

    def close(self, birth: float, leaf: bool) -> tuple[float, float]:
        """(1.0 if the cluster is to be selected unless one above is, best stability of it or what is below)."""
        stability = self.s - birth * self.rows
        if leaf:
            return float(not self.has_kids), stability
        return (0.0, self.kids) if self.kids > stability else (1.0, stability)


def _joined(least: int | dict[int, int], leaf: bool, step: int):
    def run(key, edges: pd.DataFrame, states: pd.DataFrame) -> pd.DataFrame:
        grp, out = int(key[0]), []
        mcs = least if isinstance(least, int) else least[grp]
        if len(edges) == 0:
            return pd.DataFrame({"kind": [], "grp": [], "a": [], "b": [], "x": [], "members": []})
        edges = edges.sort_values(["w", "lo", "hi"])
        parts = {}
        for r in states.itertuples():
            parts[r.comp] = _Part(members=list(r.members) if r.members is not None else None, cluster=None if r.cluster < 0 else r.cluster,
                                  **{c: getattr(r, c) for c in _STATE})
        to: dict[int, int] = {}

        def root(c: int) -> int:
            top = c
            while top in to:
                top = to[top]
            while c != top:
                to[c], c = top, to[c]
            return top

        def fall(part: _Part, members: list[int], lam: float) -> None:
            for m in members:
                out.append(("fall", m, part.cluster, [lam], None))
            part.add(lam, float(len(members)))

        def closed(part: _Part, parent: int, birth: float) -> float:
            flag, best = part.close(birth, leaf)
            out.append(("cluster", part.cluster, parent, [birth, part.size, part.direct, part.below, flag, best], None))
            return best

        total = float(edges["n"].iloc[0])
        for place, (a, b, w) in enumerate(zip(edges["ca"].to_numpy(), edges["cb"].to_numpy(), edges["w"].to_numpy(), strict=True)):
            a, b = sorted((root(int(a)), root(int(b))))
            lam = 1.0 / w if w > 0 else math.inf
            one, two = (parts.pop(c, None) or _Part(members=[c]) for c in (a, b))
            size, number = one.size + two.size, (step << 32) + place
            if one.cluster is not None and two.cluster is not None:
                new = _Part(size, cluster=number)
                for part in (one, two):
                    new.kids += closed(part, number, lam)
                    new.add(lam, part.size)
                    new.below = max(new.below, part.below)
                new.has_kids = 1.0
            elif one.cluster is None and two.cluster is None:
                new = _Part(size, members=one.members + two.members)
                if size >= mcs or size == total:
                    new.cluster = number
                    fall(new, new.members, lam)
                    new.members = None
            else:
                new, small = (one, two) if one.cluster is not None else (two, one)
                fall(new, small.members, lam)
                new.size = size
            to[b], parts[a] = a, new
            if size == total:
                closed(new, -1, 0.0)
        for c in list(to):
            out.append(("map", c, root(c), None, None))
        for c, p in parts.items():
            out.append(("state", c, -1 if p.cluster is None else p.cluster, [getattr(p, f) for f in _STATE], p.members))
        kinds, a, b, x, members = zip(*out, strict=True)
        return pd.DataFrame({"kind": kinds, "grp": grp, "a": a, "b": b, "x": x, "members": members})

    return run


def condense(tree: DataFrame, rows: DataFrame, min_cluster_size: int | dict[int, int], *, method: str = "eom", run: int = RUN) -> tuple[DataFrame, DataFrame]:
    """From the tree edges (grp, lo, hi, w) and the rows (grp, id):

    ((grp, id, node, lam): the condensed cluster that each row falls out of and when,
    (grp, node, parent, birth, size, direct, below, flag, root): every condensed cluster).
    """
    if (min_cluster_size if isinstance(min_cluster_size, int) else min(min_cluster_size.values())) < 2:
        raise ValueError("min_cluster_size must be 2 or more")
    sizes = rows.groupBy("grp").agg(F.count(F.lit(1)).alias("n"))
    edges = tree.join(F.broadcast(sizes), "grp")
    runs = max(1, -(-rows.count() // run))
    cut = edges.repartitionByRange(runs, "grp", "w", "lo", "hi").withColumn("part", F.spark_partition_id())
    cut = stored(cut, "runs")
    first = cut.groupBy("grp").agg(F.min("part").alias("first"))
    edges = cut.join(F.broadcast(first), "grp").select(
        "grp", "lo", "hi", "w", "n", (F.col("part") - F.col("first")).alias("step"), F.col("lo").alias("ca"), F.col("hi").alias("cb"))
    steps = (cut.join(F.broadcast(first), "grp").agg(F.max(F.col("part") - F.col("first"))).head()[0] or 0) + 1
    states = cut.sparkSession.createDataFrame(
        [], "grp long, comp long, cluster long, members array<long>, " + ", ".join(f"{c} double" for c in _STATE))
    falls, clusters = [], []
    for step in range(steps):
        batch = edges.where(F.col("step") == step)
        touched = batch.select("grp", F.explode(F.array("ca", "cb")).alias("comp")).distinct()
        known = states.join(touched, ["grp", "comp"], "left_semi")
        out = batch.groupBy("grp").cogroup(known.groupBy("grp")).applyInPandas(_joined(min_cluster_size, method == "leaf", step), _OUT)
        out = stored(out, f"step-{step}")
        falls.append(out.where("kind = 'fall'"))
        clusters.append(out.where("kind = 'cluster'"))
        if step + 1 < steps:
            new = out.where("kind = 'state'").select(
                "grp", F.col("a").alias("comp"), F.col("b").alias("cluster"), "members", *[F.col("x")[i].alias(c) for i, c in enumerate(_STATE)])
            states = stored(states.join(touched, ["grp", "comp"], "left_anti").unionByName(new), f"states-{step}")
            moved = out.where("kind = 'map'").select("grp", F.col("a").alias("c"), F.col("b").alias("to"))
            edges = edges.where(F.col("step") > step)
            for side in ("ca", "cb"):
                edges = edges.join(moved.withColumnRenamed("c", side), ["grp", side], "left").withColumn(side, F.coalesce("to", side)).drop("to")
            edges = stored(edges, f"edges-{step}")
    alone = rows.join(F.broadcast(sizes.where("n = 1")), "grp").select("grp", "id")  # a group of one row has no edge
    inf, zero = F.lit(float("inf")), F.lit(0).cast("long")
    items = alone.select("grp", "id", zero.alias("node"), inf.alias("lam"))
    for f in falls:
        items = items.union(f.select("grp", "a", "b", F.col("x")[0]))
    nodes = alone.select("grp", zero.alias("node"), F.lit(-1).cast("long").alias("parent"), F.lit(0.0).alias("birth"), F.lit(1.0).alias("size"),
                         inf.alias("direct"), inf.alias("below"), F.lit(0.0).alias("flag"))
    for c in clusters:
        nodes = nodes.union(c.select("grp", "a", "b", *[F.col("x")[i] for i in range(5)]))
    return items, nodes.withColumn("root", F.col("parent") < 0)


def select(nodes: DataFrame, *, allow_single_cluster: bool = False) -> DataFrame:
    """Add ``top``: the highest flagged cluster on the way up, itself included, or null; the root only if allowed."""
    flagged = (F.col("flag") > 0) & (F.lit(allow_single_cluster) | ~F.col("root"))
    known = nodes.select("grp", "node", F.when(F.col("parent") >= 0, F.col("parent")).alias("up"), F.when(flagged, F.col("node")).alias("top"))
    number = 0
    while True:  # pointers double their reach
        known = stored(known, f"tops-{number}")
        if known.where("up IS NOT NULL").isEmpty():
            return nodes.join(known.select("grp", "node", "top"), ["grp", "node"])
        for _ in range(2):
            above = known.select("grp", F.col("node").alias("up"), F.col("up").alias("further"), F.col("top").alias("higher"))
            known = known.join(above, ["grp", "up"], "left").select("grp", "node", F.col("further").alias("up"), F.coalesce("higher", "top").alias("top"))
        number += 1
