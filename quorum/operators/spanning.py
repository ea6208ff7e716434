"""Spanning trees of mutual reachability by rounds of joins (I1-I3), for many fits at once.

Rows are (grp, id, vec); a group is one fit.  Every component takes its lightest outgoing edge; the
edges taken are tree edges, and the components that they join become one.  Edges come from the k-NN
lists first.  A row's list rules out every lighter edge beyond ``bound`` = max(core, distance of the
list's end), so a component's lightest listed edge is its lightest edge if no member's bound is as
low.  Where it isn't, the list is widened: the members concerned look for their nearest row outside
the component, which becomes a listed edge and their new bound.  Edges are ordered by (weight,
smaller id, larger id), so the tree is unique whatever the partitions, blocks or k.  Of the edges
between two components only the first is kept, so the lists shrink with the components.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quorum.operators.nearest import ByDistance, Rows, cheapest_partner, group_sizes, k_nearest
from quorum.session import stored

#: neighbours listed for each row at least
LISTED = 12


def by_group(value: int | dict[int, int]) -> Column:
    """A setting that is the same for all groups, or one for each."""
    if isinstance(value, int):
        return F.lit(value)
    return F.element_at(F.create_map(*[F.lit(x) for pair in value.items() for x in pair]), F.col("grp").cast("int"))


def with_core(rows: DataFrame, min_samples: int | dict[int, int], listed: int = LISTED, **kw) -> tuple[DataFrame, DataFrame]:
    """((grp, id, vec, core, bound), (grp, a, b, w, distance) of the lists, b in the list of a)."""
    k = max(listed, *([min_samples] if isinstance(min_samples, int) else min_samples.values()))
    near = stored(k_nearest(rows, k, **kw), "near")
    ends = near.groupBy("grp", "id").agg(
        F.max(F.when(F.col("rank") <= by_group(min_samples), F.col("distance"))).alias("core"),
        F.when(F.count(F.lit(1)) >= k, F.max("distance")).otherwise(F.lit(float("inf"))).alias("end"))
    pts = rows.join(ends, ["grp", "id"], "left").select(
        "grp", "id", "vec", F.coalesce("core", F.lit(0.0)).alias("core"),
        F.greatest(F.coalesce("core", F.lit(0.0)), F.coalesce("end", F.lit(float("inf")))).alias("bound"))
    pts = stored(pts, "points")
    core = pts.select("grp", F.col("id").alias("nbr"), F.col("core").alias("core_b"))
    listed_edges = near.join(pts.select("grp", "id", "core"), ["grp", "id"]).join(core, ["grp", "nbr"]).select(
        "grp", F.col("id").alias("a"), F.col("nbr").alias("b"), F.greatest("distance", "core", "core_b").alias("w"), "distance")
    return pts, listed_edges


def both_ways(edges: DataFrame) -> DataFrame:
    return edges.union(edges.select("grp", F.col("b").alias("a"), F.col("a").alias("b"), *edges.columns[3:]))


def _reach(d: np.ndarray, qx: np.ndarray, rx: np.ndarray) -> np.ndarray:
    w = np.maximum(np.maximum(d, qx[..., 0]), rx[..., 0])
    w[qx[..., 1] == rx[..., 1]] = np.inf
    return w


#: Mutual reachability to rows of other components; numbers are (core, component).
outside = ByDistance(_reach)


def _lightest(links: DataFrame) -> DataFrame:
    """(grp, comp, best): each component's first link (w, lo, hi, other)."""
    ways = [links.select("grp", F.col(own).alias("comp"), "w", "lo", "hi", F.col(other).alias("other")) for own, other in (("ca", "cb"), ("cb", "ca"))]
    return ways[0].union(ways[1]).groupBy("grp", "comp").agg(F.min(F.struct("w", "lo", "hi", "other")).alias("best"))


def _linked(edges: DataFrame) -> DataFrame:
    """(grp, ca, cb, w, lo, hi): the first edge between two components, ca < cb; only that one can be a tree edge."""
    pair = F.least("ca", "cb").alias("ca"), F.greatest("ca", "cb").alias("cb")
    first = edges.where("ca <> cb").select("grp", *pair, F.struct("w", "lo", "hi").alias("e")).groupBy("grp", "ca", "cb").agg(F.min("e").alias("e"))
    return first.select("grp", "ca", "cb", "e.*")


def spanning_tree(pts: DataFrame, edges: DataFrame, **kw) -> DataFrame:
    """(grp, lo, hi, w): the tree edges of every group, from what ``with_core`` gives."""
    vectors = pts.select("grp", "id", "vec").where("id IS NOT NULL")  # never moved: rounds carry the state alone
    sizes = {g: (n, w + 2) for g, (n, w) in group_sizes(vectors, "vec").items()}
    state = pts.where("id IS NOT NULL").select("grp", "id", "core", "bound", F.col("id").alias("comp"))
    lo, hi = F.least("a", "b"), F.greatest("a", "b")
    links = stored(_linked(edges.select("grp", lo.alias("ca"), hi.alias("cb"), "w", lo.alias("lo"), hi.alias("hi"))), "links-0")
    tree, number = [], 0
    while True:
        number += 1
        several = state.groupBy("grp").agg(F.min("comp").alias("x"), F.max("comp").alias("y")).where("x <> y").select("grp")
        open_ = state.join(F.broadcast(several), "grp", "left_semi")
        asks = open_.join(_lightest(links), ["grp", "comp"], "left").where("best IS NULL OR bound <= best.w")
        ask = stored(asks.select("grp", "id"), f"asking-{number}")
        asking = {r["grp"] for r in ask.select("grp").distinct().collect()}
        if asking:
            refs = Rows(vectors, state.select("grp", "id", F.array("core", F.col("comp").cast("double")).alias("x")))
            wide = cheapest_partner(refs, outside, ask, sizes={g: s for g, s in sizes.items() if g in asking}, **kw)
            wide = stored(wide, f"wider-{number}")
            at = lambda name, comp: state.select("grp", F.col("id").alias(name), F.col("comp").alias(comp)).distinct()
            new = wide.join(at("id", "ca"), ["grp", "id"]).join(at("nbr", "cb"), ["grp", "nbr"])
            links = links.union(new.select("grp", "ca", "cb", F.col("cost").alias("w"), F.least("id", "nbr").alias("lo"), F.greatest("id", "nbr").alias("hi")))
            seen = ask.select("grp", "id").join(wide, ["grp", "id"], "left").groupBy("grp", "id").agg(F.coalesce(F.min("cost"), F.lit(float("inf"))).alias("now"))
            state = state.join(seen, ["grp", "id"], "left").withColumn("bound", F.coalesce("now", "bound")).drop("now")
        picks = stored(_lightest(links).select("grp", "comp", "best.*"), f"picks-{number}")
        if picks.isEmpty():
            break
        tree.append(picks.select("grp", "lo", "hi", "w").distinct())
        to = _roots(picks, number)
        moved = state.join(to, ["grp", "comp"], "left").withColumn("comp", F.coalesce("to", "comp"))
        state = stored(moved.select("grp", "id", "core", "bound", "comp"), f"components-{number}")
        for side in ("ca", "cb"):  # every component that has a link has moved
            links = links.join(to.select("grp", F.col("comp").alias(side), "to"), ["grp", side]).withColumn(side, F.col("to")).drop("to")
        links = stored(_linked(links), f"links-{number}")
    empty = pts.select("grp", F.col("id").alias("lo"), F.col("id").alias("hi"), F.lit(0.0).alias("w")).limit(0)
    return reduce(DataFrame.union, tree, empty)


def _roots(picks: DataFrame, number: int) -> DataFrame:
    """(grp, comp, to): each component points to the one its edge leads to; of two that point to each other the smaller is a root."""
    back = picks.select("grp", F.col("comp").alias("other"), F.col("other").alias("theirs"))
    own = picks.join(back, ["grp", "other"], "left")
    root = F.when((F.col("theirs") == F.col("comp")) & (F.col("comp") < F.col("other")), F.col("comp")).otherwise(F.col("other"))
    to = own.select("grp", "comp", root.alias("to"))
    step = 0
    while True:
        step += 1
        for _ in range(3):  # each time a pointer reaches twice as far
            ahead = to.select("grp", F.col("comp").alias("to"), F.col("to").alias("next"))
            to = to.select("grp", "comp", "to").join(ahead, ["grp", "to"]).select("grp", "comp", F.col("next").alias("to"), F.col("to").alias("was"))
        to = stored(to, f"roots-{number}-{step}")
        if to.where("to <> was").isEmpty():
            return to.drop("was")
