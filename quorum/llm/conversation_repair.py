"""Conversation structure repair: the cheapest edits that make roles alternate, by grammar-compressed dynamic programming.

A row of a conversation is one of nine symbols: its role's initial and whether it may stay.  A
symbol is a min-plus transfer matrix over the four states of the wanted pattern ``(s?(ua)+)?``:
cheapest cost and its audit, the letters of the edits, from each state to each.  Conversations
repeat the same runs of symbols, so Re-Pair rules are made over all of them, the most frequent
neighbours first; a rule's matrix is the product of the two it joins, made once per worker and
shared by all conversations.  A conversation is then a short row of symbols, folded from the left;
its audit is a rope of the rules' audits.

Two audits over the same rows are never a proper prefix of each other (they hold the same number of
row letters, and a matrix ends with a row's letter), so of equal costs the ASCII-least audit of a
product is made of the least ones of its factors.

No task holds a conversation's rows: rows are sorted by range, so a conversation of any length lies
in several tasks; a task cuts what it has of a conversation into blocks of at most ``BLOCK`` symbols.
The fold and the last pass over the texts read blocks and rows in order, as a stream.  What a task
keeps of one conversation is its audit and one rope link for each rule.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quorum.llm.common import read_table, stage_table

#: symbols of a block
BLOCK = 4096
#: Re-Pair: at most so many passes over the blocks, each of which makes at most so many rules
ROUNDS, RULES = 6, 256
#: rows for each task at least, where there are more tasks than shuffle partitions
ROWS_A_TASK = 500_000

#: Costs of the edits, and what an undeleted truncated row adds.
REROLE, DELETE, INSERT, LEFT_TRUNCATED = 1, 2, 5, 5
#: Neighbouring initials that may follow each other, and the marks that end a text.
LEGAL, ENDS = ("su", "ua", "au"), ".!?"

#: states: nothing yet, after s, after u, after a
START, AFTER_S, AFTER_U, AFTER_A = range(4)
ACCEPT = (START, AFTER_A)
#: a row to delete; the others are an initial (x: any other), in capitals if truncated
GONE = "-"
_FIRST_RULE = 0x10000

Matrix = list[list[tuple[int, str] | None]]


# ------------------------------------------------------------------ matrices

def inserts() -> Matrix:
    """The cheapest inserted rows from each state to each; user and assistant rows alternate."""
    out: Matrix = [[None] * 4 for _ in range(4)]
    for i in range(4):
        at, letters = i, ""
        while out[i][at] is None:
            out[i][at] = (INSERT * len(letters), letters)
            at, letters = AFTER_A if at == AFTER_U else AFTER_U, letters + "I"
    return out


def edits(symbol: str) -> Matrix:
    """What one row's edits cost from each state to each."""
    out: Matrix = [[None] * 4 for _ in range(4)]
    for i in range(4):
        out[i][i] = (DELETE, "D")
        if symbol == GONE:
            continue
        more = LEFT_TRUNCATED if symbol.isupper() else 0
        following = AFTER_A if i == AFTER_U else AFTER_U
        out[i][following] = (REROLE + more, "R")
        own = {"s": AFTER_S if i == START else None, "u": following if i != AFTER_U else None, "a": AFTER_A if i == AFTER_U else None}
        kept = own.get(symbol.lower())
        if kept is not None:
            out[i][kept] = (more, "K")
    return out


def product(left: Matrix, right: Matrix) -> Matrix:
    out: Matrix = [[None] * 4 for _ in range(4)]
    for i in range(4):
        for j in range(4):
            found = [(a[0] + b[0], a[1], b[1]) for a, b in zip(left[i], (row[j] for row in right), strict=True) if a and b]
            if found:
                cost, one, two = min(found)
                out[i][j] = (cost, one + two)
    return out


class Grammar:
    """Rules over symbols and the matrix of each; a rule is the two symbols that its character replaces."""

    def __init__(self, rules: list[str]):
        self.rules = rules
        before = inserts()
        self.matrices = {s: product(before, edits(s)) for s in (GONE, *"suaxSUAX")}
        for k, pair in enumerate(rules):  # bottom-up: a rule's symbols are older than the rule
            self.matrices[chr(_FIRST_RULE + k)] = product(self.matrices[pair[0]], self.matrices[pair[1]])
        self.last = inserts()

    def compress(self, sequences: list[str]) -> list[str]:
        text = "\n".join(sequences)
        for k, pair in enumerate(self.rules):
            text = text.replace(pair, chr(_FIRST_RULE + k))
        return text.split("\n") if sequences else []

    def start(self) -> list:
        """The fold's state before the first row: for each state cost, rank among the audits, rope."""
        return [(0, 0, None), None, None, None]

    def step(self, known: list, compressed: str) -> list:
        for symbol in compressed:
            matrix, new = self.matrices[symbol], [None] * 4
            for j in range(4):
                found = [(v[0] + m[j][0], v[1], m[j][1], k) for k, (v, m) in enumerate(zip(known, matrix, strict=True)) if v and m[j]]
                if found:
                    new[j] = min(found)
            order = sorted({(x[1], x[2]) for x in new if x})
            known = [x and (x[0], order.index((x[1], x[2])), (known[x[3]][2], x[2])) for x in new]
        return known

    def finish(self, known: list) -> tuple[int, str]:
        found = [(v[0] + self.last[i][j][0], v[1], self.last[i][j][1], i) for i, v in enumerate(known) if v for j in ACCEPT if self.last[i][j]]
        cost, _, tail, i = min(found)
        parts, rope = [tail], known[i][2]
        while rope is not None:
            rope, part = rope
            parts.append(part)
        return cost, "".join(reversed(parts))


_grammars: dict[tuple[str, ...], Grammar] = {}


def _grammar(rules: list[str]) -> Grammar:
    """The worker's grammar: its matrices are made once and serve every task."""
    key = tuple(rules)
    if key not in _grammars:
        _grammars.clear()
        _grammars[key] = Grammar(rules)
    return _grammars[key]


# ------------------------------------------------------------------ rows, symbols, blocks

def damaged(rows: DataFrame) -> DataFrame:
    """The rows (conv_id, turn, role, text) after the damage of contract 12."""
    said = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    code = F.pmod(F.crc32(F.concat(said("conv_id"), F.lit(":"), said("turn")).cast("binary")), F.lit(20))
    text = F.when(F.col("code") == 1, "").when(F.col("code") == 2, F.translate("text", ENDS, "")).otherwise(F.col("text"))
    role = F.when(F.col("code") == 4, "user").otherwise(F.col("role"))
    left = rows.select("conv_id", "turn", said("role").alias("role"), said("text").alias("text"), code.alias("code")).where("code <> 0")
    left = left.select("conv_id", "turn", role.alias("role"), text.alias("text"), F.when(F.col("code") == 3, 2).otherwise(1).alias("copies"))
    return left.withColumn("copy", F.explode(F.sequence(F.lit(1), "copies"))).drop("copy", "copies")


def undamaged(rows: DataFrame) -> DataFrame:
    """The rows as they are; null roles and texts are one space."""
    return rows.select("conv_id", "turn", *(F.coalesce(F.col(c).cast("string"), F.lit(" ")).alias(c) for c in ("role", "text")))


def _tasks(spark, rows: int) -> int:
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-rows // ROWS_A_TASK))


def _keys(rows: DataFrame) -> DataFrame:
    """Add h, g: two hashes that stand for (role, text)."""
    return rows.withColumn("h", F.xxhash64("role", "text")).withColumn("g", F.xxhash64("text", "role"))


def _symbols(rows: DataFrame) -> DataFrame:
    """Equal rows of a turn in one row: conv_id, turn, h, g, initial, fault, copies; in no order."""
    blank = ~F.col("text").rlike(r"[^\x20\x09-\x0D]")
    ended = F.col("text").rlike(rf"[{ENDS}][\x20\x09-\x0D]*\z")
    slim = _keys(rows).select("conv_id", "turn", "h", "g", F.substring("role", 1, 1).alias("initial"),
                              F.when(blank, "blank").when(~ended, "truncated").alias("fault"))
    turns = slim.groupBy("conv_id", "turn", "h", "g").agg(
        F.first("initial").alias("initial"), F.first("fault").alias("fault"), F.count(F.lit(1)).alias("copies"))
    turns = stage_table(turns, "turns")
    first = turns.groupBy("conv_id", "h", "g").agg(F.min(F.struct(F.col("turn").isNotNull().alias("known"), "turn")).alias("first"))
    first = first.select(F.col("conv_id").alias("c"), F.col("h").alias("h1"), F.col("g").alias("g1"), F.col("first.turn").alias("since"))
    both = turns.join(first, F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("h") == F.col("h1")) & (F.col("g") == F.col("g1")))
    again = ~F.col("turn").eqNullSafe(F.col("since"))
    return both.select("conv_id", "turn", "h", "g", "initial", "copies",
                       F.when(F.col("fault") == "blank", "blank").when(again, "duplicate").otherwise(F.col("fault")).alias("fault"))


def _block_fields(conv: T.DataType, turn: T.DataType) -> T.StructType:
    longs = ["turns", "blank", "duplicate", "truncated", "illegal"]
    return T.StructType([T.StructField("conv_id", conv), T.StructField("part", T.LongType()), T.StructField("seq", T.StringType()),
                         T.StructField("head", T.StringType()), T.StructField("tail", T.StringType()),
                         T.StructField("least", turn), T.StructField("most", turn),
                         *(T.StructField(c, T.LongType()) for c in longs)])


class _Block:
    def __init__(self, conv, part: int):
        self.conv, self.part, self.symbols, self.head, self.before = conv, part, [], None, None
        self.least = self.most = None
        self.turns = self.illegal = 0
        self.faults = {"blank": 0, "duplicate": 0, "truncated": 0}

    def add(self, turn, initial: str, fault: str | None) -> None:
        if self.head is None:
            self.head = initial
        if self.before is not None and self.before + initial not in LEGAL:
            self.illegal += 1
        self.before = initial
        if turn is not None and turn != self.most:
            self.turns += 1
            self.least = turn if self.least is None else self.least
            self.most = turn
        if fault:
            self.faults[fault] += 1
        symbol = initial if initial in ("s", "u", "a") else "x"
        self.symbols.append(GONE if fault in ("blank", "duplicate") else symbol.upper() if fault else symbol)

    def row(self) -> tuple:
        return (self.conv, self.part, "".join(self.symbols), self.head, self.before, self.least, self.most, self.turns,
                *self.faults.values(), self.illegal)


def _rows(batch: pa.RecordBatch, size: int = 2048) -> Iterator[tuple]:
    for a in range(0, batch.num_rows, size):
        yield from zip(*(c.to_pylist() for c in batch.slice(a, size).columns), strict=True)


def _batches(rows: Iterator[tuple], schema: pa.Schema, size: int = 2048, letters: int = 1 << 22) -> Iterator[pa.RecordBatch]:
    """Batches of at most ``size`` rows that end early at ``letters`` characters."""
    held, total = [], 0

    def batch():
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held, strict=True), schema, strict=True)], schema=schema)

    for row in rows:
        held.append(row)
        total += sum(len(x) for x in row if isinstance(x, str))
        if len(held) >= size or total >= letters:
            yield batch()
            held, total = [], 0
    if held:
        yield batch()


def _cut(schema: pa.Schema, size: int):
    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        part, block = TaskContext.get().partitionId() << 40, None
        for batch in batches:
            for conv, turn, initial, fault, copies in _rows(batch):
                for k in range(copies):
                    if block is None or block.conv != conv or len(block.symbols) >= size:
                        if block is not None:
                            yield block.row()
                        part += 1
                        block = _Block(conv, part)
                    # a repeat of a row is a duplicate, unless it's blank, which counts first
                    block.add(turn, initial, fault if k == 0 or fault == "blank" else "duplicate")
        if block is not None:
            yield block.row()

    return lambda batches: _batches(blocks(batches), schema)


def _blocks(symbols: DataFrame, size: int) -> DataFrame:
    """conv_id, part (ascending in a conversation), its symbols and counts; one row for each block."""
    from pyspark.sql.pandas.types import to_arrow_schema

    fields = _block_fields(symbols.schema["conv_id"].dataType, symbols.schema["turn"].dataType)
    symbols = stage_table(symbols, "symbols")
    order = ["conv_id", "turn", "h", "g"]
    dealt = symbols.repartitionByRange(_tasks(symbols.sparkSession, symbols.count()), *order).sortWithinPartitions(*order)
    cut = dealt.select("conv_id", "turn", "initial", "fault", "copies").mapInArrow(_cut(to_arrow_schema(fields), size), fields)
    return stage_table(cut, "blocks")


# ------------------------------------------------------------------ rules

def _pairs(rules: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grammar = Grammar(rules)
        for batch in batches:
            short = grammar.compress(batch.column(0).to_pylist())
            counts = np.repeat(np.array(batch.column(1).to_pylist(), np.float64), [len(s) + 1 for s in short])
            codes = np.frombuffer(("\n".join(short) + "\n").encode("utf-32-le"), np.uint32).astype(np.int64)
            inside = (codes[:-1] != 10) & (codes[1:] != 10)
            key, at = np.unique((codes[:-1] << 32 | codes[1:])[inside], return_inverse=True)
            n = np.bincount(at, counts[:-1][inside], len(key))
            yield pa.RecordBatch.from_arrays([pa.array(key, pa.int64()), pa.array(n.astype(np.int64))], ["pair", "n"])

    return run


def make_rules(blocks: DataFrame, rounds: int = ROUNDS, rules: int = RULES) -> list[str]:
    """Re-Pair over all blocks, in rounds: each makes rules of the most frequent neighbours there then are.

    The number of rules is bounded by the parameters and decides only how short the rows of symbols
    become, never a result.  A rule of round n stands for at most 2**n symbols.
    """
    kinds = stage_table(blocks.groupBy("seq").agg(F.count(F.lit(1)).alias("n")), "kinds")
    found: list[str] = []
    for _ in range(rounds):
        pairs = kinds.mapInArrow(_pairs(found), "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n"))
        top = pairs.where("n > 1").orderBy(F.desc("n"), "pair").limit(rules).collect()
        if not top:
            break
        found += [chr(r["pair"] >> 32) + chr(r["pair"] & 0xFFFFFFFF) for r in top]
    return found


# ------------------------------------------------------------------ the fold

def _fold(shared, schema: pa.Schema):
    def conversations(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        grammar, conv, known = _grammar(shared.value), None, None

        def result():
            cost, audit = grammar.finish(known)
            span = 0 if least is None else int(most) - int(least) + 1 - turns
            return (conv, span, *counts, cost, audit)

        for batch in batches:
            rows = list(_rows(batch))
            for short, row in zip(grammar.compress([r[1] for r in rows]), rows, strict=True):
                own, _, head, tail, low, high, n, *found = row
                if known is None or own != conv:
                    if known is not None:
                        yield result()
                    conv, known, before = own, grammar.start(), None
                    least = most = None
                    turns, counts = 0, [0, 0, 0, 0]
                if before is not None and before + head not in LEGAL:
                    counts[3] += 1
                turns += n - (n > 0 and low == most)
                least = low if least is None else least
                most = most if high is None else high
                counts = [a + b for a, b in zip(counts, found, strict=True)]
                known, before = grammar.step(known, short), tail
        if known is not None:
            yield result()

    return lambda batches: _batches(conversations(batches), schema)


def audits(rows: DataFrame, rounds: int = ROUNDS, rules: int = RULES, block: int = BLOCK) -> DataFrame:
    """conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit of each conversation that has rows."""
    from pyspark.sql.pandas.types import to_arrow_schema

    blocks = _blocks(_symbols(rows), block)
    shared = rows.sparkSession.sparkContext.broadcast(make_rules(blocks, rounds, rules))
    fields = T.StructType([blocks.schema["conv_id"], *(T.StructField(c, T.LongType()) for c in (
        "gaps", "blank", "duplicate", "truncated", "illegal", "cost")), T.StructField("audit", T.StringType())])
    ordered = blocks.repartition(_tasks(rows.sparkSession, blocks.count()), "conv_id").sortWithinPartitions("conv_id", "part")
    columns = ["conv_id", "seq", "head", "tail", "least", "most", "turns", "blank", "duplicate", "truncated", "illegal"]
    return ordered.select(*columns).mapInArrow(_fold(shared, to_arrow_schema(fields)), fields)


# ------------------------------------------------------------------ the repaired rows

def _with_rows(found: DataFrame, rows: DataFrame) -> DataFrame:
    """Each conversation's audit, then its rows in order, in one task; read there as a stream."""
    none = lambda c, t: F.lit(None).cast(t).alias(c)
    texts = _keys(rows).select("conv_id", F.lit(1).alias("kind"), "turn", "h", "g", "role", "text", none("audit", "string"))
    audit = found.select("conv_id", F.lit(0).alias("kind"), none("turn", rows.schema["turn"].dataType), none("h", "long"), none("g", "long"),
                         none("role", "string"), none("text", "string"), "audit")
    order = ["conv_id", "kind", "turn", "h", "g"]
    return texts.unionByName(audit).repartition("conv_id").sortWithinPartitions(*order).select("conv_id", "kind", "role", "text", "audit")


def _edited(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """(conv_id, letter, role, text) of each edit in order; a conversation begins with (conv_id, "", None, None)."""
    conv, audit, at, state = None, "", 0, START

    def inserted():
        nonlocal at, state
        while at < len(audit) and audit[at] == "I":
            state = AFTER_A if state == AFTER_U else AFTER_U
            at += 1
            yield conv, "I", "assistant" if state == AFTER_A else "user", ""

    for batch in batches:
        for own, kind, role, text, letters in _rows(batch, 256):
            if kind == 0:
                yield from inserted()
                conv, audit, at, state = own, letters, 0, START
                yield conv, "", None, None
                continue
            yield from inserted()
            letter = audit[at]
            at += 1
            if letter == "K":
                state = {"s": AFTER_S, "u": AFTER_U, "a": AFTER_A}[role[0]]
            elif letter == "R":
                state = AFTER_A if state == AFTER_U else AFTER_U
                role = "assistant" if state == AFTER_A else "user"
            yield conv, letter, role, text
    yield from inserted()


def _hashes(schema: pa.Schema):
    def digests(batches):
        conv = digest = None
        for own, letter, role, text in _edited(batches):
            if letter == "":
                if digest is not None:
                    yield conv, digest.hexdigest()
                conv, digest, first = own, hashlib.sha256(), True
            elif letter != "D":
                digest.update(f"{'' if first else chr(10)}{role}:{text}".encode())
                first = False
        if digest is not None:
            yield conv, digest.hexdigest()

    return lambda batches: _batches(digests(batches), schema)


def _places(schema: pa.Schema):
    def rows(batches):
        for conv, letter, role, text in _edited(batches):
            if letter == "":
                place = 0
                continue
            stays = letter != "D"
            yield conv, place if stays else None, letter, role, text
            place += stays

    return lambda batches: _batches(rows(batches), schema)


def repair(rows: DataFrame) -> DataFrame:
    """(conv_id, place, edit, role, text): the repaired conversations, and the deleted rows without a place.

    ``rows`` has conv_id, turn, role, text; other columns aren't read.  Null roles and texts are one
    space, null turns come first, a null conv_id is a conversation of its own.  Rows of one turn are
    ordered by hashes of role and text; repeated rows are duplicates.  An empty table gives none.
    """
    from pyspark.sql.pandas.types import to_arrow_schema

    own = undamaged(rows)
    fields = T.StructType([own.schema["conv_id"], T.StructField("place", T.LongType()), T.StructField("edit", T.StringType()),
                           T.StructField("role", T.StringType()), T.StructField("text", T.StringType())])
    return _with_rows(stage_table(audits(own), "audits"), own).mapInArrow(_places(to_arrow_schema(fields)), fields)


def repair_report(rows: DataFrame, before: DataFrame, block: int = BLOCK) -> DataFrame:
    """The columns of contract 12 for every conversation of ``before``; ``rows`` is what is left of it.

    A conversation without rows has zeros, an empty audit and the hash of the empty text.
    """
    from pyspark.sql.pandas.types import to_arrow_schema

    found = stage_table(audits(rows, block=block), "audits")
    fields = T.StructType([rows.schema["conv_id"], T.StructField("repaired_sha256", T.StringType())])
    hashes = _with_rows(found, rows).mapInArrow(_hashes(to_arrow_schema(fields)), fields)
    ids = before.select("conv_id").distinct()
    key = lambda df, name: df.withColumnRenamed("conv_id", name)
    all_ids = ids.join(key(found, "c"), F.col("conv_id").eqNullSafe(F.col("c")), "left").join(
        key(hashes, "d"), F.col("conv_id").eqNullSafe(F.col("d")), "left")
    counts = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]
    return all_ids.select("conv_id", *(F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in counts),
                          F.coalesce("audit", F.lit("")).alias("audit"),
                          F.coalesce("repaired_sha256", F.lit(hashlib.sha256(b"").hexdigest())).alias("repaired_sha256"))


def op12_conversation_repair(spark, sf_dir: str) -> DataFrame:
    """The query of contract 12 over the whole table ``conversations``.

    Rows of one turn, where there are any, are taken in the order of hashes of (role, text).
    """
    rows = read_table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    return repair_report(damaged(rows), rows)
