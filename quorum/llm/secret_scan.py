"""Secrets by patterns, and by what it costs to guess the values that stand where credentials stand.

Base spans (assign, access, hex) come from patterns.  The method looks at every value in a credential
context (``password is ...``, ``"pwd": "..."``, ``Bearer ...``, ``://user:...@``): dynamic programming finds
its cheapest segmentation into words, dates, repeats, keyboard walks and brute-force spans, as an
attacker would guess it.  A value of at least ``STRONG`` decimal digits of guesses is a span of kind
``guess``; placeholders and other cheap values aren't.

A word costs what a guesser pays who knows the corpus: N / n guesses for a word that makes n of the N
words of all texts, credential values left out, so that a secret never makes itself a word.

One pass over the texts gives base spans, candidate values and word counts (partial counts per task).
Values are then judged once each, whatever number of documents holds them: their substrings meet the
word counts in a join, and a value is scored with the words that were found in it.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quorum.llm.common import stage_table, texts
from quorum.llm.word_ids import slices

#: Kinds in the contract's order, the method's last; the contract's patterns.
KINDS = ["assign", "access", "hex", "guess"]
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ASSIGN_LEAST = 6
#: [0-9a-f]+ of 24 or more and AKIA[A-Z0-9]+ of 20 or more: runs take all they can, so a short one has no long one inside
ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
HEX = re.compile(r"[0-9a-f]{24,}")

#: decimal digits of guesses from which a value counts as a secret
STRONG = 9.0
#: letters of a dictionary word
WORD_LEAST, WORD_MOST = 3, 20
#: distinct chunks that a task counts before it hands them on
HELD = 500_000

_NAME = r"(?:pass(?:word|wd|phrase|code)|pwd|secret|token|api[_-]?key|(?:access|private|secret|signing)[_-]?key|credentials?|auth(?:orization)?)"
_VALUE = r"""(?:"(?P<d{0}>[^"\n]+)"|'(?P<s{0}>[^'\n]+)'|(?P<b{0}>[^\s"'<>]+))"""
#: where credentials stand: a name and a value, a bearer token, the password of an address
CONTEXT = re.compile(
    rf"""{_NAME}["']?(?:\x20*(?::=|=>|[:=])\x20*|\x20+is:?\x20+){_VALUE.format(1)}"""
    rf"""|\bbearer\x20+(?P<t>[^\s"'<>]+)"""
    r"""|://[^\s/:@"'<>]+:(?P<u>[^\s/@"'<>]+)@""", re.IGNORECASE | re.ASCII)
_HINT = re.compile(r"pass(?:word|wd|phrase|code)|pwd|secret|token|api[_-]?key|[es]s[_-]?key|private[_-]?key|signing[_-]?key|secret[_-]?key|credential|auth|bearer|://", re.IGNORECASE | re.ASCII)
_GROUPS = ("d1", "s1", "b1", "t", "u")
#: what ends a sentence or closes a bracket isn't part of a bare value
_TRAIL = ".,;:!?)]}"


# ------------------------------------------------------------------ one text

def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the valid base spans, in order; kind as its place in ``KINDS``."""
    out = []
    if ":" in text or "=" in text:
        out += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= ASSIGN_LEAST]
    if "AKIA" in text:
        out += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text)]
    out += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(out)


def candidates(text: str) -> list[tuple[int, int]]:
    """(start, end) of the values in credential contexts."""
    if not _HINT.search(text):
        return []
    out = []
    for m in CONTEXT.finditer(text):
        group = next(g for g in _GROUPS if m[g] is not None)
        start, end = m.span(group)
        if group in ("b1", "t"):
            end = start + len(m[group].rstrip(_TRAIL))
        if end > start:
            out.append((start, end))
    return out


def written(spans) -> str:
    """kind:start:end, comma-joined."""
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)


# ------------------------------------------------------------------ guess cost

#: What guessers try first, in this order; letters that other characters stand for; the rows of the keyboard.
FIRST = ["password", "admin", "user", "test", "welcome", "letmein", "login", "master", "secret", "changeme", "default", "guest", "root",
         "example", "sample", "dummy", "placeholder", "your", "here", "key", "token", "api", "value", "string", "none", "null", "true",
         "false", "required", "optional", "undefined", "monkey", "dragon", "iloveyou", "sunshine", "princess", "football", "qwerty"]
LEET = {"@": "a", "4": "a", "3": "e", "1": "i", "!": "i", "0": "o", "$": "s", "5": "s", "7": "t"}
KEYBOARD = ["1234567890-=", "qwertyuiop[]", "asdfghjkl;'", "zxcvbnm,./"]
SHIFTED = dict(zip('!@#$%^&*()_+{}:"<>?', "1234567890-=[];',./", strict=True))

#: Fixed value: each segment costs the choice among the five kinds.
KIND_CHOICE = math.log10(5)
_SYMBOLS = {"digit": 10, "lower": 26, "upper": 26, "joint": 4, "other": 33}
_JOINTS = "-_. "
_YEARS, _DAYS, _SEPARATORS = 200, 366, 4
_RANK = {w: k + 1 for k, w in enumerate(FIRST)}


def _place() -> dict[str, tuple[float, int]]:
    """Where each key lies; each row stands half a key to the right of the one above."""
    return {c: (x + 0.5 * y, y) for y, row in enumerate(KEYBOARD) for x, c in enumerate(row)}


_KEYS = _place()


def plain(value: str) -> str:
    """Small letters, with the letters that other characters stand for; as long as ``value``."""
    low = "".join(c.lower() if len(c.lower()) == 1 else c for c in value)
    return "".join(LEET.get(c, c) for c in low)


def substrings(value: str) -> set[str]:
    """What could be a word in ``value``: mostly letters, begins and ends with one."""
    low, out = plain(value), set()
    letters = [a.isalpha() for a in value]
    upto = [0]
    for flag in letters:
        upto.append(upto[-1] + flag)
    for i in range(len(value)):
        if not letters[i]:
            continue
        for j in range(i + 1, min(len(value), i + WORD_MOST) + 1):
            if not low[j - 1].isalpha():
                break
            if j - i >= WORD_LEAST and 3 * (upto[j] - upto[i]) >= 2 * (j - i):
                out.add(low[i:j])
    return out


def _spelling(part: str) -> float:
    """Guesses for capitals and stand-in characters of a word."""
    capitals, n = sum(c.isupper() for c in part), sum(c.isalpha() for c in part)
    odd = len(part) - n
    if capitals in (0, n):
        cost = 0.3 if capitals else 0.0
    elif capitals == 1 and part[0].isupper():
        cost = 0.3
    else:
        cost = math.log10(sum(math.comb(n, k) for k in range(1, min(capitals, n - capitals) + 1)) + 1)
    return cost + 0.3 * odd


def word_cost(part: str, words: dict[str, int], total: int) -> float | None:
    """Of one word as it is written; None if it isn't one."""
    if not WORD_LEAST <= len(part) <= WORD_MOST or not part[0].isalpha():
        return None
    low = plain(part)
    found = []
    if low in _RANK:
        found.append(math.log10(1 + _RANK[low]))
    if words.get(low) and 3 * sum(c.isalpha() for c in part) >= 2 * len(part):
        found.append(math.log10(max(total, words[low]) / words[low]))
    return min(found) + _spelling(part) if found else None


_YEAR = re.compile(r"(?:19|20)[0-9]{2}")
_DATE = re.compile(r"(?:(?P<y>(?:19|20)[0-9]{2})(?P<p>[-/. ]?)(?P<m>[0-9]{1,2})(?P=p)(?P<d>[0-9]{1,2})"
                   r"|(?P<a>[0-9]{1,2})(?P<q>[-/. ]?)(?P<b>[0-9]{1,2})(?P=q)(?P<z>(?:(?:19|20)?[0-9]{2})))", re.ASCII)


def date_cost(part: str) -> float | None:
    if not 4 <= len(part) <= 10:
        return None
    if _YEAR.fullmatch(part):
        return math.log10(_YEARS)
    m = _DATE.fullmatch(part)
    if not m:
        return None
    one, two = (int(m["m"]), int(m["d"])) if m["y"] else (int(m["a"]), int(m["b"]))
    if not (1 <= one <= 12 and 1 <= two <= 31 or 1 <= two <= 12 and 1 <= one <= 31):
        return None
    return math.log10(_YEARS * _DAYS) + (math.log10(_SEPARATORS) if m["p"] or m["q"] else 0.0)


@lru_cache(1 << 16)
def _brute(c: str) -> float:
    kind = "digit" if c.isdigit() else "lower" if c.islower() else "upper" if c.isupper() else "joint" if c in _JOINTS else "other"
    return math.log10(_SYMBOLS[kind])


@lru_cache(1 << 16)
def _step(a: str, b: str) -> tuple | None:
    """The direction of a walk from one key to the next: a neighbour on the keyboard, or the next letter or digit."""
    if a.isascii() and b.isascii() and a.isalnum() and b.isalnum() and abs(ord(a) - ord(b)) == 1:
        return ("order", ord(b) - ord(a))
    x, y = _KEYS.get(SHIFTED.get(a, a.lower())), _KEYS.get(SHIFTED.get(b, b.lower()))
    if x and y and abs(x[0] - y[0]) <= 1 and abs(x[1] - y[1]) <= 1 and x != y:
        return ("key", x[0] - y[0], x[1] - y[1])
    return None


@lru_cache(1 << 16)
def walk_cost(n: int, turns: int) -> float:
    """Of a walk over n keys: where it begins, how long it is, where it turns."""
    return math.log10(47) + math.log10(n) + (turns + 1) * math.log10(6)


def repeat_cost(unit: str, times: int) -> float:
    return sum(map(_brute, unit)) + math.log10(times)


#: longest unit whose repeats are one segment; repeats and walks begin among so many last places, or where they can begin first
UNIT, NEAR = 8, 12
_LOGS = [0.0, *map(math.log10, range(1, NEAR + 1))]


def guess_cost(value: str, words: dict[str, int], total: int) -> tuple[float, list[tuple[str, int, int]]]:
    """(decimal digits of guesses, segments (kind, start, end)) of the cheapest segmentation.

    ``best[j]`` is the cheapest cost of the first j characters, ``brute[j]`` of those that end in an
    open brute-force span.  Each kind of segment that ends at j begins at a bounded number of places,
    so the time is linear in the value.
    """
    n, low = len(value), plain(value)
    best, back = [0.0] + [math.inf] * n, [None] * (n + 1)
    brute, brute_from = [math.inf] * (n + 1), [0] * (n + 1)
    upto = [0.0]
    for c in value:
        upto.append(upto[-1] + _brute(c))
    walk_from, turns, last, date_from = 0, [0] * n, None, 0
    run, logs = [0] * (UNIT + 1), _LOGS

    def offer(i: int, j: int, kind: str, cost: float) -> None:
        if best[i] + KIND_CHOICE + cost < best[j]:
            best[j], back[j] = best[i] + KIND_CHOICE + cost, (kind, i)

    for j in range(1, n + 1):
        c = value[j - 1]
        fresh = best[j - 1] + KIND_CHOICE
        brute[j], brute_from[j] = min((brute[j - 1], brute_from[j - 1]), (fresh, j - 1))
        brute[j] += upto[j] - upto[j - 1]
        best[j], back[j] = brute[j], ("brute", brute_from[j])
        if low[j - 1].isalpha():
            for i in range(max(0, j - WORD_MOST), j - WORD_LEAST + 1):
                part = low[i:j]
                if part in words or part in _RANK:
                    cost = word_cost(value[i:j], words, total)
                    if cost is not None:
                        offer(i, j, "word", cost)
        if not c.isdigit():
            date_from = date_from if c in "-/. " else j
        else:
            for i in range(max(date_from, j - 10), j - 3):
                cost = date_cost(value[i:j])
                if cost is not None:
                    offer(i, j, "date", cost)
        for p in range(1, min(UNIT, j - 1) + 1):
            if c != value[j - 1 - p]:
                run[p] = 0
                continue
            run[p] += 1
            times = run[p] // p + 1
            if times >= 2:
                # whole units that end here; any of the last ones, or the first of all, may begin the segment
                unit = upto[j] - upto[j - p] + KIND_CHOICE
                for k in range(2 if p > 1 else 3, min(times, NEAR) + 1):
                    if best[j - p * k] + unit + logs[k] < best[j]:
                        best[j], back[j] = best[j - p * k] + unit + logs[k], ("repeat", j - p * k)
                if times > NEAR:
                    offer(j - p * times, j, "repeat", unit - KIND_CHOICE + math.log10(times))
        step = _step(value[j - 2], c) if j > 1 else None
        if step is None:
            walk_from, last = j - 1, None
        else:
            turns[j - 1] = turns[j - 2] + (last is not None and step != last) if j - 2 > walk_from else 0
            last = step
            for i in {walk_from, *range(max(walk_from, j - NEAR), j - 2)}:
                if j - i >= 3:
                    offer(i, j, "walk", walk_cost(j - i, turns[j - 1] - turns[i + 1]))
    segments, j = [], n
    while j:
        kind, i = back[j]
        segments.append((kind, i, j))
        j = i
    return best[n], segments[::-1]


# ------------------------------------------------------------------ jobs

_SCAN = ("kind int, doc_id long, n_assign long, n_access long, n_hex long, base string, "
         "found array<struct<start:long,end:long,value:string>>, word string, n long")
_NAMES = ["kind", "doc_id", "n_assign", "n_access", "n_hex", "base", "found", "word", "n"]
_FOUND = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("value", pa.string())]))


def _words(counts: Counter) -> Counter:
    """Counts of the words among the chunks: letters only, but for marks around them; small letters."""
    out = Counter()
    for chunk, n in counts.items():
        word = chunk.strip(".,;:!?()[]{}\"'*#$%&<>|-_/").lower()
        if WORD_LEAST <= len(word) <= WORD_MOST and word.isalpha():
            out[word] += n
    return out


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    chunks = Counter()

    def counted() -> pa.RecordBatch:
        words = _words(chunks)
        chunks.clear()
        none = [pa.nulls(len(words), t) for t in (*[pa.int64()] * 4, pa.string(), _FOUND)]
        return pa.RecordBatch.from_arrays([pa.array([1] * len(words), pa.int32()), *none, pa.array(list(words), pa.string()),
                                           pa.array(list(words.values()), pa.int64())], _NAMES)

    for batch in batches:
        docs = batch.column(1).to_pylist()
        for a, b in slices(docs):
            counts, base, found = [], [], []
            for text in docs[a:b]:
                spans, values = base_spans(text), candidates(text)
                counts.append([sum(s[1] == k for s in spans) for k in range(3)])
                base.append(written(spans))
                found.append([{"start": i, "end": j, "value": text[i:j]} for i, j in values])
                if values or spans:  # what may be a secret isn't a word
                    ends = [0]
                    for i, j in sorted([(s[0], s[2]) for s in spans] + values):
                        ends += [max(i, ends[-1]), max(j, ends[-1])]
                    ends.append(len(text))
                    for i, j in zip(ends[::2], ends[1::2], strict=True):
                        chunks.update(text[i:j].split())
                else:
                    chunks.update(text.split())
            n = b - a
            yield pa.RecordBatch.from_arrays(
                [pa.array([0] * n, pa.int32()), batch.column(0).slice(a, n), *(pa.array(c, pa.int64()) for c in zip(*counts, strict=True)),
                 pa.array(base), pa.array(found, _FOUND), pa.nulls(n, pa.string()), pa.nulls(n, pa.int64())], _NAMES)
            if len(chunks) > HELD:
                yield counted()
    if chunks:
        yield counted()


def _candidates_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for key, value in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            parts = sorted(substrings(value))
            for a in range(0, len(parts), 10_000):
                some = parts[a : a + 10_000]
                yield pa.RecordBatch.from_arrays([pa.array([key] * len(some)), pa.array(some)], ["value_id", "word"])


def _score(total: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, costs, parts = [], [], []
            for key, value, words in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                cost, segments = guess_cost(value, {w["word"]: w["n"] for w in words or []}, total)
                ids.append(key)
                costs.append(cost)
                parts.append(",".join(f"{k}:{i}:{j}" for k, i, j in segments))
            yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(costs, pa.float64()), pa.array(parts, pa.string())], ["value_id", "digits", "segments"])

    return run


def _judged(scan: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(documents with a row number, values with their cost)."""
    docs = scan.where("kind = 0").select("row", "doc_id", "n_assign", "n_access", "n_hex", "base", "found")
    values = docs.select(F.explode("found.value").alias("value")).withColumn("value_id", F.sha2("value", 256))
    values = stage_table(values.groupBy("value_id").agg(F.first("value").alias("value")), "values")
    words = stage_table(scan.where("kind = 1").groupBy("word").agg(F.sum("n").alias("n")), "words")
    total = words.agg(F.coalesce(F.sum("n"), F.lit(0))).head()[0]
    inside = values.select("value_id", "value").mapInArrow(_candidates_of, "value_id string, word string")
    known = inside.join(words, "word").groupBy("value_id").agg(F.collect_list(F.struct("word", "n")).alias("words"))
    scored = values.join(known, "value_id", "left").select("value_id", "value", "words")
    return docs, stage_table(scored.mapInArrow(_score(total), "value_id string, digits double, segments string"), "costs")


def _scanned(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    made = texts(docs, id_col, text_col).mapInArrow(_scan, _SCAN)
    return stage_table(made.withColumn("row", F.monotonically_increasing_id()), "scan")


def _with_costs(docs: DataFrame, costs: DataFrame) -> DataFrame:
    """row, start, end, digits, segments of every candidate value; a value in many rows is a skewed key, which AQE splits."""
    each = docs.select("row", F.explode("found").alias("x")).select("row", "x.start", "x.end", F.sha2("x.value", 256).alias("value_id"))
    return each.join(costs, "value_id").drop("value_id")


def guess_costs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, start, end, digits, segments): each value in a credential context, what it costs to guess, and its parts."""
    own, costs = _judged(_scanned(docs, id_col, text_col))
    return own.select("row", "doc_id").join(_with_costs(own, costs), "row").drop("row")


def find_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", strong: float = STRONG) -> DataFrame:
    """The columns of contract 11, one row per row of ``docs``.

    Null text is empty.  Repeated rows and null ids are rows like any others; an empty table gives
    none; other columns aren't read.
    """
    own, costs = _judged(_scanned(docs, id_col, text_col))
    order = len(KINDS) - 1
    strong_ones = _with_costs(own, costs).where(F.col("digits") >= strong).groupBy("row").agg(
        F.collect_list(F.struct("start", F.lit(order).cast("long").alias("kind"), "end")).alias("more"))
    part = lambda s, k: F.split_part(s, F.lit(":"), F.lit(k))
    number = {k: n for n, k in enumerate(KINDS)}
    kind = lambda s: F.element_at(F.create_map(*[F.lit(x) for p in number.items() for x in p]), part(s, 1))
    base = F.transform(F.filter(F.split("base", ","), lambda s: s != ""), lambda s: F.struct(
        part(s, 2).cast("long").alias("start"), kind(s).cast("long").alias("kind"), part(s, 3).cast("long").alias("end")))
    both = F.array_sort(F.concat(base, "more"))
    names = F.array(*map(F.lit, KINDS))
    spans = F.array_join(F.transform(both, lambda s: F.concat_ws(":", F.element_at(names, (s["kind"] + 1).cast("int")), s["start"], s["end"])), ",")
    return own.join(strong_ones, "row", "left").select(
        "doc_id", "n_assign", "n_access", "n_hex", F.sha2("base", 256).alias("base_sha256"),
        F.when(F.col("more").isNull(), F.col("base")).otherwise(spans).alias("spans"))


def base_digest(text: str) -> str:
    return hashlib.sha256(written(base_spans(text)).encode()).hexdigest()


def op11_secret_scan(spark, sf_dir: str) -> DataFrame:
    """The query of contract 11 over the whole table ``documents``."""
    return find_secrets(spark.read.parquet(f"{sf_dir}/documents.parquet"))
