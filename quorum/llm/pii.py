"""Personal data by patterns, and terms that reveal it by corpus co-occurrence; DataFrame functions only.

Base spans (e-mail, IP, card, phone) come from patterns.  Positions are running sums over the exploded
gaps and matches of a text, so no Python is needed and the work is linear in them.  Each valid match
is a protected entity.

A term in a document that holds an entity may reveal it.  With document frequencies over the whole
corpus, PMI(term; entity) = log2(N n_te / ((n_t + ``SMOOTH``) n_e)) is how much of the entity's
information content IC(entity) = log2(N / n_e) the term gives away; n_te counts the documents that
hold both, wherever they stand.  The smoothing is one document more with the term than were seen, so
what stands once isn't taken for certain.  Where the share PMI / IC reaches ``DISCLOSURE``, the
term is a span of kind ``term`` wherever it stands, outside base spans, in a document with that entity.
Rare entities, of one document too, are judged alike.  Sanitising replaces base spans by their kind
and generalises terms: to NUMBER, NAME (with a capital) or TERM.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quorum.llm.common import stage_table, texts, with_row_key

#: Kinds in the contract's order.  The patterns are the contract's, written so that a
#: search doesn't go back: a match begins where a run of its characters begins or at the last match's
#: end, and repetitions are possessive where what follows can't begin with the repeated characters.
KINDS = ["email", "ip", "card", "phone"]
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: a text without a match of this has no match of the pattern
SIGNS = {"email": "@", "ip": r"[0-9]\.[0-9]", "card": "[0-9][\\x20-]?[0-9]", "phone": r"\+[0-9]"}
PART = r"0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2})"

TERM = r"[\p{L}\p{N}]+"

SMOOTH = 1
DISCLOSURE = 0.9
#: code points of a block in which a text is cut up to replace spans
BLOCK = 4096


def _luhn(digits: Column) -> Column:
    """Whether the digits pass Luhn's test: from the right every second digit doubled, 9 off above 9."""
    each = F.reverse(F.filter(F.split(digits, ""), lambda c: c != ""))
    def value(c: Column, i: Column) -> Column:
        d = c.cast("int")
        return F.when(i % 2 == 0, d).when(d > 4, 2 * d - 9).otherwise(2 * d)
    return F.aggregate(F.transform(each, value), F.lit(0), lambda a, x: a + x) % 10 == 0


def _valid(kind: str, match: Column) -> Column:
    digits = F.regexp_replace(match, "[^0-9]", "")
    if kind == "ip":
        return match.rlike(rf"^{PART}\.{PART}\.{PART}\.{PART}$")
    if kind == "card":
        return F.length(digits).between(12, 19) & F.when(F.length(digits) <= 19, _luhn(digits)).otherwise(F.lit(False))
    if kind == "phone":
        return F.length(digits).between(9, 15)
    return F.lit(True)


def _entity(kind: str, match: Column) -> Column:
    """One name for the ways to write the same entity."""
    bare = F.lower(match) if kind == "email" else match if kind == "ip" else F.regexp_replace(match, "[^0-9]", "")
    return F.concat(F.lit(f"{kind}:"), bare)


_SPAN = "array<struct<start:int,order:int,end:int,kind:string,entity:string>>"
_PIECES = "array<struct<gap:int,match:string>>"


def _pieces(text: Column, pattern: str) -> Column:
    """The matches of ``pattern`` in order, each with the length of the gap before it."""
    return F.arrays_zip(F.transform(F.split(text, pattern), F.length).alias("gap"), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("match"))


def _positions(rows: DataFrame, pieces: str, by: list[str]) -> DataFrame:
    """``by``, start, end and match of every piece: running sums over the exploded pieces, linear in their number."""
    each = rows.select(*by, F.posexplode(pieces).alias("i", "p")).select(*by, "i", "p.gap", "p.match").where("match is not null")
    width = F.length("match")
    end = F.sum(F.col("gap") + width).over(Window.partitionBy(*by).orderBy("i")).cast("int")
    return each.select(*by, (end - width).alias("start"), end.alias("end"), "match")


def _valid_pieces(kind: str, text: Column) -> Column:
    """The pieces of one kind if any match is valid, else none."""
    pattern = PATTERNS[kind]
    some = F.exists(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), lambda m: _valid(kind, m))
    return F.when(text.rlike(SIGNS[kind]) & some, _pieces(text, pattern).cast(_PIECES)).otherwise(F.array().cast(_PIECES))


def _written(spans: Column) -> Column:
    """kind:start:end by start, then kind, comma-joined."""
    return F.array_join(F.transform(F.array_sort(spans), lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def _words(text: Column) -> Column:
    return F.array_distinct(F.transform(F.regexp_extract_all(text, F.lit(TERM), F.lit(0)), F.lower))


def _base_spans(rows: DataFrame) -> DataFrame:
    """(row, start, order, end, kind, entity): the valid base spans of all texts."""
    found = [_positions(rows.where(F.size(kind) > 0), kind, ["row"]).where(_valid(kind, F.col("match"))).select(
        "row", "start", F.lit(i).alias("order"), "end", F.lit(kind).alias("kind"), _entity(kind, F.col("match")).alias("entity")) for i, kind in enumerate(KINDS)]
    return reduce(DataFrame.unionByName, found)


def _class(rows: DataFrame, name: str, *extra: Column) -> DataFrame:
    """One row per ``name`` with its number of rows ``n`` and a fingerprint ``f`` of the set of its rows.

    Entities, and terms, that stand in the same documents have the same counts with everything else, so
    one pair stands for all of them: a document of 100 000 addresses is one class, not 100 000.
    """
    marks = [F.bit_xor(F.xxhash64(F.lit(seed), "row")) for seed in (1, 2)]
    return rows.groupBy(name).agg(F.count(F.lit(1)).alias("n"), *[m.alias(f"m{i}") for i, m in enumerate(marks)], *extra)


def disclosing_terms(held: DataFrame, words: DataFrame, frequency: DataFrame, total: float, disclosure: float = DISCLOSURE) -> DataFrame:
    """(row, term): the terms of each document that disclose an entity of the same document.

    ``held`` has distinct (row, entity), ``words`` distinct (row, term) of the same documents, ``frequency``
    (term, n_t) over the whole corpus.  As n_te is at most n_t and n_e, only terms in at most
    N^(1 - d) n_e^d documents can reach the share d; the others go before any pair is made.
    """
    entity = _class(held, "entity").where(F.col("n") < total).select(
        "entity", F.col("n").alias("n_e"), F.xxhash64("n", "m0", "m1").alias("ec"))
    held = stage_table(held.join(entity, "entity").select("row", "n_e", "ec").distinct(), "entity-classes")
    bound = F.pow(F.lit(total), F.lit(1 - disclosure)) * F.pow(F.max("n_e"), F.lit(disclosure))
    rare = words.join(held.groupBy("row").agg(bound.alias("bound")), "row").join(frequency, "term").where("n_t <= bound + 1e-9")
    rare = stage_table(rare.select("row", "term", "n_t"), "rare-terms")
    kinds = _class(rare, "term", F.first("n_t").alias("n_t")).select("term", "n_t", F.xxhash64("n_t", "n", "m0", "m1").alias("tc"))
    member = stage_table(rare.select("row", "term").join(kinds, "term"), "term-classes")
    pairs = member.select("row", "n_t", "tc").distinct().join(held, "row")
    both = pairs.groupBy("tc", "ec").agg(F.count(F.lit(1)).alias("n_te"), F.first("n_t").alias("n_t"), F.first("n_e").alias("n_e"))
    ic = F.log2(F.lit(total) / F.col("n_e"))
    pmi = F.log2(F.lit(total) * F.col("n_te") / ((F.col("n_t") + SMOOTH) * F.col("n_e")))
    told = both.where(pmi >= disclosure * ic).select("tc", "ec")
    return member.join(pairs.select("row", "tc", "ec").join(told, ["tc", "ec"]).select("row", "tc").distinct(), ["row", "tc"]).select("row", "term")


def spans_long(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", disclosure: float = DISCLOSURE) -> tuple[DataFrame, DataFrame]:
    """(row, doc_id, h) of each row of ``docs``, and (row, start, order, end, kind, entity) of all spans, base and terms.

    Null text is empty and has no spans.  Repeated rows count as documents of their own.  An empty
    table gives no rows; other columns of ``docs`` aren't read.
    """
    whole = with_row_key(texts(docs, id_col, text_col))
    rows = whole.select("doc_id", "h", "text", *(_valid_pieces(k, F.col("text")).alias(k) for k in KINDS))
    some = reduce(lambda a, b: a | b, [F.size(k) > 0 for k in KINDS])
    rows = stage_table(rows.select("doc_id", "h", *KINDS, F.when(some, F.col("text")).alias("text")).withColumn("row", F.monotonically_increasing_id()), "matches")
    base = stage_table(_base_spans(rows), "base")
    hold = rows.where("text is not null").select("row", "text")
    words = hold.select("row", F.explode(_words(F.col("text"))).alias("term"))
    # document frequencies over the whole corpus: partial counts go out before the exchange
    frequency = whole.select(F.explode(_words(F.col("text"))).alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("n_t"))
    total = float(rows.count())
    told = stage_table(disclosing_terms(base.select("row", "entity").distinct(), words, frequency, max(total, 1.0), disclosure), "told")
    # where the terms stand: all words of the documents concerned, with positions
    places = _positions(hold.join(told.select("row").distinct(), "row").withColumn("pieces", _pieces(F.col("text"), TERM)), "pieces", ["row"])
    places = places.withColumn("term", F.lower("match")).join(told, ["row", "term"])
    ends = base.select("row", "start", "end").withColumn("base", F.lit(True))
    mixed = places.select("row", "start", "end", "match", F.lit(False).alias("base")).unionByName(ends, allowMissingColumns=True)
    # a word that overlaps a base span isn't a term: the furthest base end before it, the nearest base start after
    ahead = Window.partitionBy("row").orderBy("start", F.col("base").desc())
    behind = Window.partitionBy("row").orderBy(F.col("start").desc(), "base")
    mixed = mixed.withColumn("before", F.max(F.when(F.col("base"), F.col("end"))).over(ahead.rowsBetween(Window.unboundedPreceding, 0)))
    mixed = mixed.withColumn("after", F.min(F.when(F.col("base"), F.col("start"))).over(behind.rowsBetween(Window.unboundedPreceding, 0)))
    free = ~F.col("base") & (F.coalesce("before", F.lit(0)) <= F.col("start")) & (F.coalesce("after", F.col("end")) >= F.col("end"))
    terms = mixed.where(free).select("row", "start", F.lit(len(KINDS)).alias("order"), "end", F.lit("term").alias("kind"), F.col("match").alias("entity"))
    return rows.select("row", "doc_id", "h"), stage_table(base.unionByName(terms), "spans")


def spans_table(docs: DataFrame, **options) -> DataFrame:
    """(row, doc_id, h, base, terms): the base spans and the disclosing terms' spans of each row of ``docs``."""
    rows, spans = spans_long(docs, **options)
    span = F.struct("start", "order", "end", "kind", "entity")
    lists = spans.groupBy("row").agg(*(F.array_sort(F.collect_list(F.when(which, span))).alias(name)
                                       for name, which in (("base", F.col("kind") != "term"), ("terms", F.col("kind") == "term"))))
    rows = rows.join(lists, "row", "left")
    return rows.select("row", "doc_id", "h", *(F.coalesce(c, F.array().cast(_SPAN)).alias(c) for c in ("base", "terms")))


def _of(kind: str):
    return lambda span: span["kind"] == kind


def find_private(docs: DataFrame, **options) -> DataFrame:
    """doc_id, counts of the base kinds, n_term, base_sha256 and spans, one row per row of ``docs``."""
    found = spans_table(docs, **options)
    counts = [F.size(F.filter("base", _of(k))).cast("long").alias(f"n_{k}") for k in KINDS]
    return found.select(
        "doc_id", *counts, F.sha2(_written(F.col("base")), 256).alias("base_sha256"),
        _written(F.concat("base", "terms")).alias("spans"), F.size("terms").cast("long").alias("n_term"))


def _cut(blocks: Column, begin: Column, end: Column) -> Column:
    """Code points ``begin`` to ``end`` of a text in blocks of ``BLOCK``: only the blocks between are read."""
    first = F.floor(begin / BLOCK).cast("int")
    n = F.greatest(F.lit(0), F.ceil(end / BLOCK).cast("int") - first)
    return F.substring(F.array_join(F.slice(blocks, first + 1, n), ""), begin - first * BLOCK + 1, end - begin)


def _replaced(text: Column, tags: Column, last: Column) -> Column:
    """The text with its spans replaced: the gap before each tag, the tag, and what follows the last span."""
    blocks = F.regexp_extract_all(text, F.lit(rf"(?s).{{1,{BLOCK}}}"), F.lit(0))

    def written(cut: Column) -> Column:
        return F.concat(F.array_join(F.transform(tags, lambda s: F.concat(_cut(cut, s["begin"], s["start"]), s["tag"])), ""), _cut(cut, last, F.length(text)))

    # a variable of an outer function: an expression inside the inner one would be worked out again for each span
    return F.element_at(F.transform(F.array(blocks), written), 1)


def sanitise(docs: DataFrame) -> DataFrame:
    """``docs`` with personal data and disclosing terms replaced in ``text``; ``n_chars``, if there is one, follows the text.

    A run of overlapping spans becomes the tag of its first.  Texts without spans, null texts and all other
    columns stay as they are.  Only rows with spans come out of the search; rows that repeat (doc_id, text)
    have the same spans and are joined once.
    """
    rows, spans = spans_long(docs)
    at = Window.partitionBy("row").orderBy("start", "order", "end")
    begin = F.coalesce(F.max("end").over(at.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    general = F.when(F.col("entity").rlike("^[0-9]+$"), "NUMBER").when(F.col("entity").rlike(r"^\p{Lu}"), "NAME").otherwise("TERM")
    tag = F.concat(F.lit("<"), F.when(F.col("kind") == "term", general).otherwise(F.upper("kind")), F.lit(">"))
    spans = spans.withColumn("begin", begin).withColumn("tag", tag)
    fresh = F.when(F.col("start") >= F.col("begin"), F.struct("start", "begin", "tag"))
    spans = spans.groupBy("row").agg(F.array_sort(F.collect_list(fresh)).alias("_tags"), F.max("end").alias("_last"))
    spans = spans.join(rows, "row").groupBy(F.col("doc_id").alias("_id"), "h").agg(F.first(F.struct("_tags", "_last")).alias("_spans"))
    out = docs.withColumn("_key", F.xxhash64(F.coalesce(F.col("text"), F.lit(""))))
    out = out.join(spans, out["doc_id"].eqNullSafe(spans["_id"]) & (out["_key"] == spans["h"]), "left")
    text = F.when(F.col("_spans").isNull(), F.col("text")).otherwise(_replaced(F.col("text"), F.col("_spans._tags"), F.col("_spans._last")))
    out = out.withColumn("_new", text)
    length = F.when(F.col("_spans").isNull(), F.col("n_chars")).otherwise(F.length("_new")) if "n_chars" in docs.columns else None
    return out.select(*(F.col("_new").alias(c) if c == "text" else length.cast(dict(docs.dtypes)[c]).alias(c) if c == "n_chars" else F.col(c) for c in docs.columns))


def op1_pii(spark, sf_dir: str) -> DataFrame:
    """The query of contract 1 over the whole table ``documents``."""
    return find_private(spark.read.parquet(f"{sf_dir}/documents.parquet"))
