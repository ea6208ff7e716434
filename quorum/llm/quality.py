"""Quality rules by distribution divergence, in DataFrame functions only.

A document's histograms of character classes and of frequent words are compared to those of its
stated language by Jensen-Shannon distance (base 2).  Every value of ``lang`` has a reference: the mean
of the histograms of its documents of ``COMPARED_WORDS`` words or more, in whole parts so that the sum
doesn't depend on the order of rows.  Its frequent words are the ``FREQUENT`` with the largest mean share
in those documents, which are counted in full.  Short documents, and those without a language or whose language has no reference,
are judged by the base rules alone.

The references are a table of a row per language, made by two passes that exchange counts only; the
verdict takes another pass, to which that table is joined.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quorum.llm.common import WHITE, stage_table

#: Frequent function words of four languages, for made-up prose; the rules count their own from the corpus.
COMMON = {
    "en": "the of and to in a is that it for on was with as be by".split(),
    "fr": "de la le et les des en un une du que est pour dans qui par".split(),
    "de": "der die und in den von zu das mit sich des auf für ist im dem".split(),
    "es": "de la que el en y a los se del las un por con no una".split(),
}
#: frequent words of each language
FREQUENT = 20
#: what can be one: a letter, and no characters but letters, marks, digits, apostrophes and hyphens
PLAIN = r"^[\p{L}\p{M}\p{N}'\x{2019}-]*\p{L}[\p{L}\p{M}\p{N}'\x{2019}-]*$"
#: the most frequent characters, small letters and white space; the others are a small part of a text
USUAL = r"[a-z\x20\x09-\x0D]++"
#: character classes in the order in which they are taken out of the others; small letters are what ``USUAL`` takes, symbols are left
PEELED = {"stop": "[.,;:!?]++", "upper": "[A-Z]++", "digit": "[0-9]++", "beyond": r"[^\x00-\x7F]++"}
#: the classes of a histogram after small letters and white space
CLASSES = ("upper", "digit", "stop", "symbol", "beyond")

MIN_WORDS = 50
REPEATED_PERCENT = 50
#: a document with fewer words isn't compared to the references
COMPARED_WORDS = 100
CHARACTER_LIMIT = 0.22
WORD_LIMIT = 0.28
#: where that limit was set, a text without any frequent word lay so far (sf0.1); the limit grows with that distance
WORDLESS = 0.324
_PARTS = 1_000_000
_WORD_PARTS = 1_000_000_000


def _left(text: Column, pattern: str) -> Column:
    return F.length(F.regexp_replace(text, pattern, "")).cast("long")


def _fixed(rows: DataFrame, keep: list[str], made: list[Column]) -> DataFrame:
    """The columns ``keep`` and the new ones, which are computed once: no later step is merged into an explode."""
    return rows.select(*keep, F.explode(F.array(F.struct(*made))).alias("_made")).select(*keep, "_made.*")


def _texts(docs: DataFrame, id_col: str, text_col: str, lang_col: str, keep: list[Column]) -> DataFrame:
    """``keep``, doc_id, lang, text, words."""
    rows = docs.select(*keep, F.col(id_col).alias("doc_id"), F.col(lang_col).alias("lang"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    bare = F.btrim("text", F.lit(" \t\n\x0b\x0c\r"))
    words = F.when(bare == "", F.array().cast("array<string>")).otherwise(F.split(bare, WHITE))
    return _fixed(rows, rows.columns, [words.alias("words")])


def _unusual(rows: DataFrame) -> DataFrame:
    """``rows`` with ``unusual``, the text without its ``USUAL`` characters, and what is left of that after each class of ``PEELED``: the only search through a whole text."""
    rows, rest = rows.withColumn("unusual", F.regexp_replace("text", USUAL, "")), "unusual"
    for c, pattern in PEELED.items():
        rows, rest = rows.withColumn(f"after_{c}", F.regexp_replace(rest, pattern, "")), f"after_{c}"
    return rows.withColumnRenamed(rest, "symbols")


def _histogram() -> list[Column]:
    """n_words, word_chars, n_chars, n_unusual and the counts of character classes."""
    size = lambda c: F.length(c).cast("long")
    rests = ["unusual", *(f"after_{c}" for c in list(PEELED)[:-1]), "symbols"]
    taken = [(size(x) - size(y)).alias(f"c_{c}") for c, x, y in zip(PEELED, rests[:-1], rests[1:], strict=True)]
    return [F.size("words").cast("long").alias("n_words"), size(F.array_join("words", "")).alias("word_chars"), size("text").alias("n_chars"),
            size("unusual").alias("n_unusual"), *taken, size("symbols").alias("c_symbol")]


def _character_counts() -> Column:
    return F.array(F.col("word_chars") - F.col("n_unusual"), F.col("n_chars") - F.col("word_chars"), *(F.col(f"c_{c}") for c in CLASSES))


def _word_counts() -> Column:
    """How often each place of the reference's words stands in ``common``, and the other words."""
    found = [F.size("common") - F.size(F.array_remove("common", F.lit(i + 1).cast("long"))) for i in range(FREQUENT)]
    return F.array(*(c.cast("long") for c in found), F.col("n_words") - F.size("common"))


def _repeated(words: Column) -> Column:
    """Words in 3-word windows that are found twice or more, by the windows' 64-bit hashes."""
    hashes = F.transform(words, lambda w: F.xxhash64(w))
    windows = F.transform(F.array(hashes), lambda h: F.transform(
        F.slice(h, F.lit(1), F.size(h) - 2), lambda x, i: F.xxhash64(x, F.get(h, i + 1), F.get(h, i + 2))))[0]

    def covered(ordered: Column) -> Column:
        def twin(x: Column, k: Column) -> Column:
            return ((k > 0) & (F.get(ordered, k - 1)["v"] == x["v"])) | (F.get(ordered, k + 1)["v"].eqNullSafe(x["v"]))

        starts = F.sort_array(F.transform(F.filter(ordered, twin), lambda x: x["i"]))
        return F.aggregate(
            starts, F.struct(F.lit(0).alias("n"), F.lit(-3).alias("last")),
            lambda acc, s: F.struct((acc["n"] + F.least(F.lit(3), s - acc["last"])).alias("n"), s.alias("last")), lambda acc: acc["n"])

    def count(w: Column) -> Column:
        pairs = F.transform(w, lambda x, i: F.struct(x.alias("v"), i.alias("i")))
        return F.when(F.size(F.array_distinct(w)) == F.size(w), F.lit(0)).otherwise(
            F.transform(F.array(F.sort_array(pairs)), covered)[0])

    return F.when(F.size(words) < 4, F.lit(0)).otherwise(F.transform(F.array(windows), count)[0]).cast("long")


def _distance(counts: Column, reference: Column) -> Column:
    """Jensen-Shannon distance of a histogram to a reference given as an array of shares."""
    def part(x: Column, m: Column) -> Column:
        return F.when(x > 0, x * F.log2(x / m)).otherwise(F.lit(0.0))

    def both(p: Column, q: Column) -> Column:
        return F.when(p + q > 0, (part(p, (p + q) / 2) + part(q, (p + q) / 2)) / 2).otherwise(F.lit(0.0))

    total = F.aggregate(counts, F.lit(0).cast("long"), lambda a, x: a + x)
    shares = F.transform(F.array(total), lambda n: F.transform(counts, lambda x: x / n))[0]
    return F.sqrt(F.greatest(F.lit(0.0), F.aggregate(F.zip_with(shares, reference, both), F.lit(0.0), lambda a, x: a + x)))


def references(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """(lang, own_words, own_chars, own_shares, own_limit): per language its frequent words, the mean shares of character classes and of those words and the rest, and the limit of the latter's distance."""
    rows = _texts(docs.where(F.col(lang_col).isNotNull()), id_col, text_col, lang_col, []).where(F.size("words") >= COMPARED_WORDS)
    counted = _fixed(_unusual(rows), ["lang"], _histogram())
    counted = _fixed(counted, ["lang"], [F.transform(_character_counts(), lambda x: F.floor(x * _PARTS / F.col("n_chars"))).alias("parts")])
    chars = counted.groupBy("lang").agg(F.count(F.lit(1)).alias("n"), *(F.sum(F.col("parts")[i]).alias(f"c{i}") for i in range(len(CLASSES) + 2)))
    whole = F.aggregate(F.array(*(f"c{i}" for i in range(len(CLASSES) + 2))), F.lit(0).cast("long"), lambda a, x: a + x)
    chars = chars.select("lang", "n", F.array(*(F.col(f"c{i}") / whole for i in range(len(CLASSES) + 2))).alias("own_chars"))
    # a word's mean share: each time it stands it adds its document's 1 / n_words
    each = rows.select("lang", F.floor(F.lit(_WORD_PARTS) / F.size("words")).alias("part"), F.explode("words").alias("word"))
    each = each.groupBy("lang", F.lower("word").alias("word")).agg(F.sum("part").alias("part")).where(F.col("word").rlike(PLAIN))
    first = Window.partitionBy("lang").orderBy(F.desc("part"), "word")
    often = each.withColumn("place", F.row_number().over(first)).where(F.col("place") <= FREQUENT)
    often = often.groupBy("lang").agg(F.array_sort(F.collect_list(F.struct("place", "word", "part"))).alias("often"))
    share = F.transform("often", lambda w: w["part"] / (F.col("n") * float(_WORD_PARTS)))
    known = chars.join(often, "lang", "left").withColumn("often", F.coalesce("often", F.array().cast("array<struct<place:int,word:string,part:bigint>>")))
    known = known.withColumn("shares", F.concat(share, F.array_repeat(F.lit(0.0), F.lit(FREQUENT) - F.size("often"))))
    rest = F.greatest(F.lit(0.0), 1 - F.aggregate("shares", F.lit(0.0), lambda a, x: a + x))
    known = known.select("lang", F.col("often.word").alias("own_words"), "own_chars", F.concat("shares", F.array(rest)).alias("own_shares"))
    wordless = _distance(F.array(*[F.lit(0).cast("long")] * FREQUENT, F.lit(1).cast("long")), F.col("own_shares"))
    return known.withColumn("own_limit", F.greatest(F.lit(WORD_LIMIT), WORD_LIMIT / WORDLESS * wordless))


def quality_rules(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", keep: list[str] | None = None) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
    kept, character_distance, word_distance (null if the document isn't compared), after the columns ``keep``.

    A null text counts as one without words, which fails the base rules.  A document whose language is
    null, or has no document of ``COMPARED_WORDS`` words, is judged by the base rules alone.  An empty
    table gives no rows.
    """
    keep = keep or []
    known = stage_table(references(docs, id_col, text_col, lang_col), "references")
    names = [f"kept_{i}" for i in range(len(keep))]
    rows = _texts(docs, id_col, text_col, lang_col, [F.col(c).alias(n) for c, n in zip(keep, names, strict=True)])
    rows = rows.join(known.withColumnRenamed("lang", "_lang"), (F.col("lang") == F.col("_lang")) & (F.size("words") >= COMPARED_WORDS), "left")
    lines = F.filter(F.split("text", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    doubled = F.transform(F.array(lines), lambda x: F.size(x) - F.size(F.array_distinct(x)))[0]
    own = ["own_words", "own_chars", "own_shares", "own_limit"]
    longest = F.coalesce(F.array_max(F.transform("own_words", F.length)), F.lit(0))
    short = F.transform(F.array(longest), lambda n: F.filter("words", lambda w: F.length(w) <= n))[0]
    places = F.filter(F.transform(short, lambda w: F.array_position(F.col("own_words"), F.lower(w))), lambda x: x > 0)
    common = F.when(F.col("own_words").isNull(), F.array().cast("array<bigint>")).otherwise(places)
    rows = _fixed(_unusual(rows), [*names, "doc_id", *own], [
        *_histogram(), common.alias("common"), _left(F.col("symbols"), r"[^#*$%&|<>]++").alias("n_symbols"),
        doubled.cast("long").alias("n_dup_lines"), _repeated(F.col("words")).alias("n_repeat_words")])
    rows = _fixed(rows, [*names, "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", *own], [
        _character_counts().alias("chars"), _word_counts().alias("counts")])
    compared = F.col("own_words").isNotNull()
    far_chars = F.when(compared, _distance(F.col("chars"), F.col("own_chars")))
    far_words = F.when(compared, _distance(F.col("counts"), F.col("own_shares")))
    rows = _fixed(rows, [*names, "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"], [
        F.struct(far_chars.alias("chars"), far_words.alias("words"), F.col("own_limit").alias("limit")).alias("nearest")])
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > REPEATED_PERCENT * F.col("n_words"))
    far = (F.col("nearest.chars") > CHARACTER_LIMIT) | (F.col("nearest.words") > F.col("nearest.limit"))
    rows = _fixed(rows, [*names, "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "nearest"], [
        failed.alias("base_failed"), (~failed & ~F.coalesce(far, F.lit(False))).alias("kept")])
    return rows.select(
        *(F.col(n).alias(c) for n, c in zip(names, keep, strict=True)), "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        "base_failed", "kept", F.round("nearest.chars", 4).alias("character_distance"), F.round("nearest.words", 4).alias("word_distance"))


def keep_good(docs: DataFrame) -> DataFrame:
    """``docs`` without the documents that :func:`quality_rules` rejects; the columns of ``docs`` stay as they are."""
    judged = quality_rules(docs, keep=docs.columns)
    n = len(docs.columns)
    named = judged.toDF(*docs.columns, *(f"_q{i}" for i in range(len(judged.columns) - n)))
    return named.where(f"_q{judged.columns[n:].index('kept')}").select(*docs.columns)


def op7_quality(spark, sf_dir: str) -> DataFrame:
    """The query of contract 7 over the whole table ``documents``."""
    return quality_rules(spark.read.parquet(f"{sf_dir}/documents.parquet"))
