"""Cross-tokenizer alignment: which tokens of two tokenizers cover the same bytes.

Both tokenizers read the same bytes, so each token is a byte range.  Per batch, keyed by the place in all its
documents, ``pandas.merge_asof`` finds for each token start the other side's covering token; the union of both
directions is every overlap, because of two overlapping ranges the later start lies in the other.
Places where both sides end a token cut the document into groups.

How often an id pair is linked in the whole corpus is counted in a first pass (partial counts per
task before the exchange).  A second pass reads the texts again instead of keeping some hundred
bytes of links for each hundred bytes of text.  Its links meet the counts in two exact ways: the
most frequent pairs, at most ``SENT`` of them, are sent to every task as sorted arrays; links of
the other pairs leave as (row, pair, how often) and are joined.

Both tokenizers cut a text where a space follows something that isn't white, so the units between
such spaces are encoded once per worker and remembered.  A text's first space begins its first unit.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quorum.llm.bpe import PATTERN, byte_letters
from quorum.llm.common import stage_table, texts
from quorum.llm.packing import tokenizer_text
from quorum.llm.word_ids import slices

#: units that a worker remembers; beyond that it starts anew
REMEMBERED = 700_000
#: pairs that are sent to all tasks at most (24 bytes each); the others are joined
SENT = 500_000
#: distinct pairs that a task of the counting pass holds before it hands them on
HELD = 1_000_000
#: characters of one slice of a batch
SLICE = 1 << 20
#: Fixed value: what stands for a space in the pieces of side B.
SPACE_MARK = "▁"
#: id pairs are one number: A's id in the upper bits
SHIFT = 32

#: not at a text's start: side B's own space joins the one that stands there
_UNIT = re.compile(r"(?<=\S) (?=[^ ])")
#: white space before a space, for which a plain split at spaces wouldn't do
_SPACED = tuple(c + " " for c in " \t\n\x0b\x0c\r\x1c\x1d\x1e\x1f")
_WIDE_SPACED = re.compile("[\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000] ")
_BYTE = re.compile(r"<0x([0-9A-F]{2})>")


def _units(text: str) -> list[str]:
    """The text cut at ``_UNIT``; where each space stands alone, a plain split is the same."""
    if text[:1] == " " or text[-1:] == " " or any(x in text for x in _SPACED) or not text.isascii() and _WIDE_SPACED.search(text):
        return _UNIT.split(text)
    return text.split(" ")


class _Index(dict):
    """Unit -> place; an unknown unit gets the next place and is noted."""

    def __init__(self):
        super().__init__()
        self.new: list[str] = []

    def __missing__(self, unit: str) -> int:
        place = self[unit] = len(self)
        self.new.append(unit)
        return place


class Side:
    """A tokenizer, the bytes of its ids, and the ids of the units that the worker has met."""

    def __init__(self, encode, pieces: list[bytes], units: bool):
        self.encode, self.units = encode, units
        self.length = np.array([len(p) for p in pieces], np.int64)
        self.begin = np.concatenate([[0], np.cumsum(self.length)])[:-1]
        self.bytes = np.frombuffer(b"".join(pieces), np.uint8)
        self.names = np.array([str(i) for i in range(len(pieces))], object)
        self.forget()

    def forget(self) -> None:
        self.flat, self.ends = np.empty(0, np.int64), np.zeros(1, np.int64)

    def whole(self, docs: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the texts in one array, and how many each has."""
        found = self.encode(docs)
        counts = np.fromiter(map(len, found), np.int64, len(found))
        return np.fromiter(chain.from_iterable(found), np.int64, counts.sum()), counts

    def learn(self, units: list[str]) -> None:
        ids, counts = self.whole(units)
        self.flat = np.concatenate([self.flat, ids])
        self.ends = np.concatenate([self.ends, self.ends[-1] + np.cumsum(counts)])

    def gather(self, place: np.ndarray, upto: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """As ``whole``, of texts whose units are ``place``; ``upto`` is where each text's units end."""
        begin, counts = self.ends[place], self.ends[place + 1] - self.ends[place]
        ends = np.concatenate([[0], np.cumsum(counts)])
        ids = self.flat[np.repeat(begin - ends[:-1], counts) + np.arange(ends[-1])]
        return ids, np.diff(ends[upto])

    def joined(self, ids: np.ndarray) -> np.ndarray:
        """The bytes of the ids one after the other."""
        n = self.length[ids]
        upto = np.concatenate([[0], np.cumsum(n)])
        return self.bytes[np.repeat(self.begin[ids] - upto[:-1], n) + np.arange(upto[-1])]


def byte_side(definition: str) -> Side:
    """Side A: byte-level BPE of a space and the text; strings of special tokens are plain text."""
    import tiktoken

    known = json.loads(definition)
    special = {t["content"] for t in known["added_tokens"]}
    back = {c: i for i, c in enumerate(byte_letters())}
    vocab = {t: i for t, i in known["model"]["vocab"].items() if t not in special}
    ranks = {bytes(back[c] for c in t): i for t, i in vocab.items()}
    pieces = [b""] * (max([*vocab.values(), *(t["id"] for t in known["added_tokens"])]) + 1)
    for piece, i in ranks.items():
        pieces[i] = piece
    encoding = tiktoken.Encoding("a", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    return Side(lambda docs: [encoding.encode_ordinary(" " + d) for d in docs], pieces, True)


def piece_side(model: bytes) -> Side:
    """Side B: pieces with byte fallback, which put the space before the text themselves."""
    import sentencepiece

    processor = sentencepiece.SentencePieceProcessor(model_proto=model)
    names = [processor.id_to_piece(i) for i in range(processor.get_piece_size())]
    pieces = []
    for name in names:
        code = _BYTE.fullmatch(name)
        pieces.append(bytes([int(code[1], 16)]) if code else name.replace(SPACE_MARK, " ").encode())
    # a piece that goes on beyond a space would make a unit's ids depend on its neighbours
    crossing = any(SPACE_MARK in name.lstrip(SPACE_MARK) for name in names)
    return Side(lambda docs: processor.encode(docs, num_threads=1), pieces, not crossing)


class Sides(tuple):
    """Both sides, and the units that they know."""

    def __new__(cls, a: Side, b: Side):
        self = super().__new__(cls, (a, b))
        self.index = _Index()
        return self

    def encode(self, docs: list[str]) -> list[tuple[np.ndarray, np.ndarray]]:
        """For each side all ids of the texts in one array, and how many each text has."""
        if len(self.index) > REMEMBERED:
            self.index = _Index()
            for side in self:
                side.forget()
        get, places = self.index.__getitem__, []
        for text in docs:
            units = _units(text)
            places.append(np.fromiter(map(get, units), np.int64, len(units)))
        new, self.index.new = self.index.new, []
        place, upto = np.concatenate(places), np.cumsum([0, *map(len, places)])
        for side in self:
            if new and side.units:
                side.learn(new)
        return [side.gather(place, upto) if side.units else side.whole(docs) for side in self]


_sides: dict[int, Sides] = {}


def _both(definitions: tuple[str, bytes]) -> Sides:
    key = hash(definitions)
    if key not in _sides:
        _sides.clear()
        _sides[key] = Sides(byte_side(definitions[0]), piece_side(definitions[1]))
    return _sides[key]


class Aligned:
    """The tokens, links and groups of some documents; documents without tokens have counts of 0."""

    def __init__(self, sides: Sides, docs: list[str]):
        found = sides.encode([d or "" for d in docs])
        keep = self._whole(sides, docs, found)
        self.ids, self.counts = [], []
        for ids, counts in found:
            self.ids.append(ids if keep.all() else ids[np.repeat(keep, counts)])
            self.counts.append(np.where(keep, counts, 0))
        self.doc = [np.repeat(np.arange(len(docs)), n) for n in self.counts]
        self.end = [np.cumsum(s.length[i]) for s, i in zip(sides, self.ids, strict=True)]  # both sides have the same bytes
        self.start = [e - s.length[i] for e, s, i in zip(self.end, sides, self.ids, strict=True)]
        self._link()
        self._group()

    @staticmethod
    def _whole(sides, docs, found) -> np.ndarray:
        """Which documents' bytes both sides give back."""
        lines = [b" " + d.encode() if d else b"" for d in docs]
        length = np.array([len(x) for x in lines], np.int64)
        keep = length > 0
        for side, (ids, counts) in zip(sides, found, strict=True):
            upto = np.concatenate([[0], np.cumsum(side.length[ids])])[np.concatenate([[0], np.cumsum(counts)])]
            keep &= np.diff(upto) == length
            got = side.joined(ids)
            if keep.all() and len(got) == length.sum():
                if np.array_equal(got, np.frombuffer(b"".join(lines), np.uint8)):
                    continue
            for k in np.flatnonzero(keep):
                keep[k] = got[upto[k] : upto[k + 1]].tobytes() == lines[k]
        return keep

    def _link(self) -> None:
        """Every overlap as (place in A, place in B), by A's place and then B's."""
        # starts ascend through all documents, and each document begins a token on both sides: the start is its key too
        a, b = (pd.DataFrame({"start": s, name: np.arange(len(s))}) for s, name in zip(self.start, "ab", strict=True))
        one = pd.merge_asof(a, b, on="start")
        # a B token that begins with an A token is found in the first direction already
        two = pd.merge_asof(b, a, on="start")
        at_a, at_b = two["a"].to_numpy(np.int64), two["b"].to_numpy(np.int64)
        new = self.start[0][at_a] < self.start[1][at_b]
        left = np.concatenate([one["a"].to_numpy(np.int64), at_a[new]])
        right = np.concatenate([one["b"].to_numpy(np.int64), at_b[new]])
        # an overlap begins at the later start; in that order both places ascend, and both runs are in order already
        order = np.argsort(np.concatenate([self.start[0], self.start[1][new]]), kind="stable")
        self.left, self.right = left[order], right[order]
        self.pair = (self.ids[0][self.left] << SHIFT) | self.ids[1][self.right]
        self.n_links = np.bincount(self.doc[0][self.left], minlength=len(self.counts[0]))

    def _group(self) -> None:
        """For each token the number of its group in all documents, and how many groups a document has."""
        total = max((int(e[-1]) for e in self.end if len(e)), default=0)
        ends = np.zeros((2, total + 1), bool)
        for marks, e in zip(ends, self.end, strict=True):
            marks[e] = True
        self.closes = [ends[1 - side][e] for side, e in enumerate(self.end)]
        self.group = [np.cumsum(c) - c for c in self.closes]
        self.n_groups = np.bincount(self.doc[0][self.closes[0]], minlength=len(self.counts[0]))

    def group_texts(self, sides: Sides) -> list[str]:
        """a1,a2|b1;a3|b2,b3 of each document."""
        parts = np.empty(2 * (len(self.ids[0]) + len(self.ids[1])), object)
        # a token's place: all tokens of earlier groups, A's of the own group before B's
        upto = [np.concatenate([[0], np.cumsum(np.bincount(g))]) for g in self.group]
        n_a, n_b = upto[0][self.group[1] + 1], upto[1][self.group[0]]
        place = [np.arange(len(n_b)) + n_b, np.arange(len(n_a)) + n_a]
        for side, where, ids, closes, mark in zip(sides, place, self.ids, self.closes, "|;", strict=True):
            parts[2 * where] = side.names[ids]
            parts[2 * where + 1] = np.where(closes, mark, ",")
        upto = 2 * np.cumsum([0, *(self.counts[0] + self.counts[1]).tolist()])
        flat = parts.tolist()
        return ["".join(flat[a : b - 1]) if b > a else "" for a, b in zip(upto[:-1].tolist(), upto[1:].tolist(), strict=True)]


# ------------------------------------------------------------------ jobs

def _shared(docs: DataFrame, a_path: str | None, b_path: str | None):
    """Both tokenizer files, a few MB at most, sent with the tasks."""
    if b_path is None:
        import public_tokenizers

        b_path = public_tokenizers.path("piece_bpe_32k.model")
    with open(b_path, "rb") as f:
        model = f.read()
    return docs.sparkSession.sparkContext.broadcast((tokenizer_text(a_path, "byte_bpe_50k.json"), model))


def _count(shared):
    def handed(keys, counts):
        key, at = np.unique(np.concatenate(keys), return_inverse=True)
        return key, np.bincount(at, np.concatenate(counts), len(key)).astype(np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sides, keys, counts, held = _both(shared.value), [], [], 0
        for batch in batches:
            docs = batch.column(0).to_pylist()
            for a, b in slices(docs, SLICE):
                key, n = np.unique(Aligned(sides, docs[a:b]).pair, return_counts=True)
                keys.append(key)
                counts.append(n)
                held += len(key)
                if held > 2 * HELD:
                    key, n = handed(keys, counts)
                    if len(key) > HELD:
                        yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(n)], ["pair", "n"])
                        key, n = key[:0], n[:0]
                    keys, counts, held = [key], [n], len(key)
        if held:
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in handed(keys, counts)], ["pair", "n"])

    return run


def pair_counts(docs: DataFrame, text_col: str = "text", a_path: str | None = None, b_path: str | None = None) -> DataFrame:
    """(a_id, b_id, n, best): links of each id pair in all texts, and whether no pair with this b_id has more."""
    shared = _shared(docs, a_path, b_path)
    written = docs.select(F.col(text_col).alias("text")).where("text <> ''")
    pairs = written.mapInArrow(_count(shared), "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n"))
    low = F.col("pair").bitwiseAND((1 << SHIFT) - 1)
    pairs = pairs.select(F.shiftright("pair", SHIFT).alias("a_id"), low.alias("b_id"), "n")
    # at most one row for each id of side A in a window
    return pairs.withColumn("best", F.col("n") == F.max("n").over(Window.partitionBy("b_id")))


def _frequent(pairs: DataFrame, sent: int) -> DataFrame:
    """The most frequent pairs, whole powers of two of counts together, at most ``sent`` rows."""
    kinds = pairs.groupBy(F.floor(F.log2("n")).cast("int").alias("power")).agg(F.count(F.lit(1)).alias("rows")).collect()
    least, total = 62, 0
    for power, rows in sorted(map(tuple, kinds), reverse=True):
        total += rows
        if total > sent:
            break
        least = power
    return pairs.where(F.col("n") >= (1 << least))


def _documents(shared, sent):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sides = _both(shared.value)
        keys, numbers, best = sent.value
        for batch in batches:
            docs = batch.column(1).to_pylist()
            for a, b in slices(docs, SLICE):
                found = Aligned(sides, docs[a:b])
                at = np.minimum(np.searchsorted(keys, found.pair), max(0, len(keys) - 1))
                known = keys[at] == found.pair if len(keys) else np.zeros(len(found.pair), bool)
                doc = found.doc[0][found.left]
                upto = np.concatenate([[0], np.cumsum(found.n_links)])
                values, tops = np.zeros(len(doc), np.int64), np.zeros(len(doc), bool)
                values[known], tops[known] = numbers[at[known]], best[at[known]]
                sums, n_best = (np.diff(np.concatenate([[0], np.cumsum(x)])[upto]) for x in (values, tops))
                rest, n = np.unique(np.stack([doc[~known], found.pair[~known]], 1), axis=0, return_counts=True)
                cuts = np.searchsorted(rest[:, 0], np.arange(b - a + 1))
                hashes = [hashlib.sha256(t.encode()).hexdigest() if t else "" for t in found.group_texts(sides)]
                offsets = pa.array(cuts, pa.int32())
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(a, b - a), *(pa.array(x, pa.int64()) for x in (*found.counts, found.n_groups, found.n_links, n_best, sums)),
                     pa.array(hashes), pa.ListArray.from_arrays(offsets, pa.array(rest[:, 1], pa.int64())), pa.ListArray.from_arrays(offsets, pa.array(n, pa.int64()))],
                    ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256", "rest", "times"])

    return run


def link_report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", a_path: str | None = None, b_path: str | None = None,
                sent: int = SENT) -> DataFrame:
    """The columns of contract 13, one row per row of ``docs``.

    Null and empty texts, and those that a side doesn't give back byte for byte, have zeros.
    Repeated rows and null ids are rows like any others; an empty table gives none; other columns
    aren't read.
    """
    pairs = stage_table(pair_counts(docs, text_col, a_path, b_path), "pair-counts")
    top = _frequent(pairs, sent).select(
        (F.shiftleft("a_id", SHIFT).bitwiseOR(F.col("b_id"))).alias("pair"), "n", "best").toPandas().sort_values("pair")
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast((top["pair"].to_numpy(np.int64), top["n"].to_numpy(np.int64), top["best"].to_numpy(bool)))
    counts = ["n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum"]
    schema = f"doc_id long, {', '.join(c + ' long' for c in counts)}, groups_sha256 string, rest array<long>, times array<long>"
    made = texts(docs, id_col, text_col).mapInArrow(_documents(_shared(docs, a_path, b_path), shared), schema)
    made = stage_table(made.withColumn("row", F.monotonically_increasing_id()), "documents")
    rest = made.select("row", F.explode(F.arrays_zip("rest", "times")).alias("x")).select("row", F.col("x.rest").alias("pair"), F.col("x.times").alias("times"))
    rest = rest.select("row", "times", F.shiftright("pair", SHIFT).alias("a_id"), F.col("pair").bitwiseAND((1 << SHIFT) - 1).alias("b_id"))
    rest = rest.join(pairs, ["a_id", "b_id"]).groupBy("row").agg(
        F.sum(F.col("times") * F.col("n")).alias("more"), F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("more_best"))
    whole = made.drop("rest", "times").join(rest, "row", "left")
    return whole.select("doc_id", "n_a", "n_b", "n_groups", "n_links", (F.col("n_best") + F.coalesce("more_best", F.lit(0))).alias("n_best"),
                        (F.col("count_sum") + F.coalesce("more", F.lit(0))).alias("count_sum"), "groups_sha256")


def _tables(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sides = _both(shared.value)
        for batch in batches:
            docs = batch.column(1).to_pylist()
            for a, b in slices(docs, SLICE):
                found = Aligned(sides, docs[a:b])
                upto = [np.concatenate([[0], np.cumsum(n)]) for n in found.counts]
                links = np.concatenate([[0], np.cumsum(found.n_links)])
                first = np.concatenate([[0], np.cumsum(found.n_groups)])[:-1]
                rows = []
                for k in range(b - a):
                    (i, j), (m, n), (p, q) = upto[0][k : k + 2], upto[1][k : k + 2], links[k : k + 2]
                    rows.append((found.ids[0][i:j], found.ids[1][m:n], found.group[0][i:j] - first[k], found.group[1][m:n] - first[k],
                                 found.left[p:q] - i, found.right[p:q] - m))
                columns = [pa.array([x.tolist() for x in c], pa.list_(pa.int64())) for c in zip(*rows, strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), *columns], ["doc_id", "a_ids", "b_ids", "a_group", "b_group", "link_a", "link_b"])

    return run


def align(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", a_path: str | None = None, b_path: str | None = None) -> DataFrame:
    """(doc_id, a_ids, b_ids, a_group, b_group, link_a, link_b): tokens of both sides, each token's group, and the
    places of the tokens of each link.  In one pass, without an exchange; cases as in ``link_report``."""
    schema = "doc_id long, " + ", ".join(f"{c} array<long>" for c in ("a_ids", "b_ids", "a_group", "b_group", "link_a", "link_b"))
    return texts(docs, id_col, text_col).mapInArrow(_tables(_shared(docs, a_path, b_path)), schema)


def op13_alignment(spark, sf_dir: str) -> DataFrame:
    """The query of contract 13 over the whole table ``documents``."""
    return link_report(spark.read.parquet(f"{sf_dir}/documents.parquet"))
