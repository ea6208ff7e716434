"""Near-duplicate documents: SuperMinHash signatures, banding, exact verification, union-find.

1. One pass over the texts gives each document its shingle count, a 128-bit name of its shingle set
   and one number for each band of its SuperMinHash signature.  Documents with equal sets are one
   class from here on, so thousands of copies cost one row.
2. Classes that share a band are tied to the smallest class of that bucket; the components of these
   ties hold every candidate pair without a row for any pair.
3. The sets of classes in such a component are brought together and compared exactly.  A component
   with more shingles than ``GROUP`` or more work than ``WORK`` is cut into blocks by hash, and each
   pair of blocks is one task.  A task returns links that join what is linked (a forest), never all its pairs.
4. The components of the links are the groups.

Large groups of texts that all differ cost (blocks)^2 / 2 tasks; nothing is left out.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quorum.llm.common import components, stage_table, texts, with_row_key
from quorum.llm.shingles import mix, shingle_sets, text_blocks

#: length of a signature
SLOTS = 160
#: chance of missing a pair that lies just at the threshold
MISS = 0.002
#: shingles of one block of a candidate component
GROUP = 400_000
#: entries of inverted lists that a pair of blocks reads at most, twice this number
WORK = 100_000_000

_STEP, _SALT = 0x9E3779B97F4A7C15, np.uint64(0xA24BAED4963EE407)


def band_shape(percent: int, slots: int = SLOTS, miss: float = MISS) -> tuple[int, int]:
    """(bands, rows in each): the longest rows that miss a pair at the threshold no more often than ``miss``."""
    t = percent / 100
    rows = max(r for r in range(1, slots + 1) if r == 1 or (1 - t**r) ** (slots // r) <= miss)
    return slots // rows, rows


def superminhash(elements: np.ndarray, owner: np.ndarray, n: int, slots: int = SLOTS) -> np.ndarray:
    """Signatures (n, slots) of n sets; ``owner`` is the set of each element.

    Round j gives each element the value j + u in the j-th place of its own random permutation of
    the slots; a slot keeps the smallest value.  A set whose slots all lie below j + 1 can't change
    any more and leaves (the early stop).  A place is traced back through the swaps of the rounds
    before, so that no permutation is stored.
    """
    best = np.full(n * slots, np.inf)
    swaps: list[np.ndarray] = []
    for j in range(slots):
        if not len(elements):
            break
        draw = mix(elements + np.uint64((2 * j + 1) * _STEP & 0xFFFFFFFFFFFFFFFF))
        value = j + (draw >> np.uint64(11)).astype(np.float64) * 2.0**-53
        swap = (j + (mix(draw ^ _SALT) % np.uint64(slots - j)).astype(np.int64)).astype(np.int16)
        place = swap.copy()
        for i in range(j - 1, -1, -1):
            place[swaps[i] == place] = i
        np.minimum.at(best, owner * slots + place, value)
        swaps.append(swap)
        sets = np.unique(owner)
        open_ = np.zeros(n, bool)
        open_[sets] = best.reshape(n, slots)[sets].max(axis=1) >= j + 1
        stay = open_[owner]
        if not stay.all():
            elements, owner = elements[stay], owner[stay]
            swaps = [s[stay] for s in swaps]
    return best.reshape(n, slots)


def band_numbers(signatures: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """One int64 for each band, the band's place mixed in."""
    cells = signatures[:, : bands * rows].copy().view(np.uint64).reshape(len(signatures), bands, rows)
    out = np.broadcast_to(mix(np.arange(1, bands + 1, dtype=np.uint64) * np.uint64(_STEP)), cells.shape[:2])
    for i in range(rows):
        out = mix(out + cells[:, :, i])
    return out.view(np.int64)


def _sign(k: int, slots: int, bands: int, rows: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, data, offsets in text_blocks(batch.column(2)):
                sets = shingle_sets(data, offsets, k)
                sizes = np.array([len(s) for s in sets], np.int64)
                owner = np.repeat(np.arange(len(sets)), sizes)
                numbers = band_numbers(superminhash(np.concatenate(sets), owner, len(sets), slots), bands, rows)
                numbers = numbers[sizes > 0]
                ends = np.concatenate([[0], np.cumsum(np.where(sizes > 0, bands, 0))]).astype(np.int32)
                names = [hashlib.blake2b(s.tobytes(), digest_size=16).digest() for s in sets]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(a, b - a), batch.column(1).slice(a, b - a), pa.array(sizes), pa.array(names, pa.binary()),
                     pa.ListArray.from_arrays(pa.array(ends), pa.array(numbers.ravel()))],
                    ["doc_id", "h", "n_shingles", "set_name", "bands"])

    return run


def _sets(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, data, offsets in text_blocks(batch.column(3)):
                made = [s.tobytes() for s in shingle_sets(data, offsets, k)]
                kept = [batch.column(i).slice(a, b - a) for i in range(3)]
                yield pa.RecordBatch.from_arrays([*kept, pa.array(made, pa.binary())], ["class", "comp", "blocks", "set"])

    return run


def link_forest(sets: list[np.ndarray], side: np.ndarray, percent: int) -> list[tuple[int, int]]:
    """Links (i, j) with 100 * common >= percent * union that join all that such links join.

    Between members of different ``side`` only, if there are two sides.  For each member the common
    counts with all later ones are read from inverted lists; links within a part found already are left out.
    """
    sizes = np.array([len(s) for s in sets])
    flat, owner = np.concatenate(sets), np.repeat(np.arange(len(sets)), sizes)
    order = np.argsort(flat, kind="stable")
    values, members = flat[order], owner[order]
    fresh = np.flatnonzero(np.concatenate([[True], values[1:] != values[:-1]]))
    run_end = np.repeat(np.append(fresh[1:], len(values)), np.diff(np.append(fresh, len(values))))
    where = np.empty(len(order), np.int64)
    where[order] = np.arange(len(order))
    at = np.concatenate([[0], np.cumsum(sizes)])
    parent = list(range(len(sets)))

    def root(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    two, links = len(np.unique(side)) > 1, []
    for x in range(len(sets) - 1):
        own = where[at[x] : at[x + 1]]  # members of a list are in order, so later members come after
        lengths = run_end[own] - own - 1
        total = int(lengths.sum())
        if not total:
            continue
        starts = np.repeat(own + 1 - np.concatenate([[0], np.cumsum(lengths)[:-1]]), lengths)
        common = np.bincount(members[starts + np.arange(total)], minlength=len(sets))
        linked = 100 * common >= percent * (sizes[x] + sizes - common)
        linked[: x + 1] = False
        if two:
            linked &= side != side[x]
        for y in np.flatnonzero(linked).tolist():
            p, q = root(x), root(y)
            if p != q:
                parent[max(p, q)] = min(p, q)
                links.append((x, y))
    return links


def _verify(percent: int):
    def run(key, frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.drop_duplicates("class").sort_values("class")
        sets = [np.frombuffer(s, np.uint64) for s in frame["set"]]
        links = link_forest(sets, frame["block"].to_numpy(), percent)
        ids = frame["class"].to_numpy()
        return pd.DataFrame({"a": [ids[x] for x, _ in links], "b": [ids[y] for _, y in links]}, dtype="int64")

    return run


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 5, percent: int = 80,
                    slots: int = SLOTS, group: int = GROUP) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_shingles, component_id, kept, h (hash of the text).

    ``component_id`` is the smallest doc_id that links reach, the document's own included.  A null or
    empty text, or one without words, has no shingles and is linked with nothing.  Rows that repeat
    a doc_id are linked by their sets like any others; of rows with the smallest doc_id of their
    component one is kept.  A null doc_id is larger than any other; alone it gives component null and
    is kept.  An empty table gives no rows; other columns of ``docs`` aren't read.
    """
    bands, rows = band_shape(percent, slots)
    whole = with_row_key(texts(docs, id_col, text_col))
    signed = whole.select("doc_id", "h", "text").mapInArrow(
        _sign(k, slots, bands, rows), "doc_id long, h long, n_shingles long, set_name binary, bands array<long>")
    signed = stage_table(signed.withColumn("row", F.monotonically_increasing_id()), "signed")

    some = signed.where("n_shingles > 0")
    classes = stage_table(some.groupBy("set_name").agg(F.min("row").alias("class")), "classes")
    ones = some.join(classes.select(F.col("class").alias("row")), "row", "left_semi")
    spread = ones.select(F.col("row").alias("class"), F.explode("bands").alias("band"))
    heads = spread.groupBy("band").agg(F.min("class").alias("head"), F.count(F.lit(1)).alias("size")).where("size > 1").select("band", "head")
    # a class is tied once, to its least head, and its other heads to that one; heads repeat, so few such ties are left
    own = spread.join(heads, "band").groupBy("class").agg(F.min("head").alias("low"), F.collect_set("head").alias("heads"))
    own = stage_table(own, "heads")
    others = own.select(F.explode("heads").alias("a"), F.col("low").alias("b")).where("a <> b").distinct()
    ties = own.select(F.col("class").alias("a"), F.col("low").alias("b")).where("a <> b").union(others)
    candidates = components(ties).select(F.col("node").alias("class"), F.col("root").alias("comp"))

    # the sets of candidate classes only, made again from their texts
    facts = ones.select(F.col("row").alias("class"), "doc_id", "h", "n_shingles")
    members = candidates.join(facts, "class")
    # comparing c sets of s shingles in all reads at most c s entries of inverted lists
    work = F.sqrt(F.sum("n_shingles") * F.count(F.lit(1)).cast("double") / WORK)
    sizes = members.groupBy("comp").agg(F.ceil(F.greatest(F.sum("n_shingles") / group, work)).cast("int").alias("blocks"))
    members = members.join(sizes, "comp").select("class", "comp", "blocks", F.col("doc_id").alias("id"), F.col("h").alias("hh"))
    match = whole["doc_id"].eqNullSafe(members["id"]) & (whole["h"] == members["hh"])
    found = whole.join(members, match).select("class", "comp", "blocks", "text")
    found = found.mapInArrow(_sets(k), "class long, comp long, blocks int, set binary")
    block = F.pmod(F.xxhash64("class"), F.col("blocks")).cast("int")
    found = found.withColumn("block", block).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    found = found.select("class", "comp", "set", "block", F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high"))
    links = stage_table(found.groupBy("comp", "low", "high").applyInPandas(_verify(percent), "a long, b long"), "verified")
    groups = components(links).select(F.col("node").alias("class"), F.col("root").alias("group"))

    named = classes.join(groups, "class", "left").select("set_name", F.coalesce("group", "class").alias("group"))
    labelled = signed.drop("bands").join(named, "set_name", "left").withColumn("group", F.coalesce("group", "row"))
    labelled = stage_table(labelled.select("row", "doc_id", "h", "n_shingles", "group"), "labelled")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id"), F.col("row"))).alias("first")
    heads = labelled.groupBy("group").agg(first)
    return labelled.join(heads, "group").select(
        "doc_id", "n_shingles", F.col("first.doc_id").alias("component_id"), (F.col("row") == F.col("first.row")).alias("kept"), "h")


def drop_near_copies(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """``docs`` with one document of each group; all columns stay.  Repeated rows (same doc_id and text) are one row afterwards."""
    kept = near_duplicates(docs, k=k, percent=percent).where("kept").select("doc_id", "h")
    key = F.xxhash64(F.coalesce(F.col("text"), F.lit("")))
    rows = docs.withColumn("_key", key).dropDuplicates(["doc_id", "_key"])
    match = rows["doc_id"].eqNullSafe(kept["doc_id"]) & (rows["_key"] == kept["h"])
    return rows.join(kept, match, "left_semi").drop("_key")


def op10_minhash(spark, sf_dir: str) -> DataFrame:
    """The query of contract 10 over the whole table ``documents``: 3-word shingles, 85 %."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return near_duplicates(docs, k=3, percent=85).drop("h")


ORACLE = r"""
WITH RECURSIVE t AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
    ELSE [w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] FOR i IN range(1, len(w) - 1)] END) AS sh FROM t),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
c AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS shared FROM s a JOIN s b ON a.sh = b.sh AND a.doc_id <> b.doc_id GROUP BY 1, 2),
l AS (SELECT x, y FROM c JOIN n nx ON nx.doc_id = x JOIN n ny ON ny.doc_id = y WHERE 100 * shared >= 85 * (nx.n + ny.n - shared)),
r AS (SELECT doc_id AS x, doc_id AS y FROM t UNION SELECT r.x, l.y FROM r JOIN l ON l.x = r.y),
m AS (SELECT x AS doc_id, min(y) AS component_id FROM r GROUP BY x)
SELECT doc_id, coalesce(n.n, 0) AS n_shingles, component_id, doc_id = component_id AS kept FROM m LEFT JOIN n USING (doc_id)
"""
