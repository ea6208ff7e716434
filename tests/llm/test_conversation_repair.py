"""Conversation repair against a plain search over all edits."""

import hashlib
import random
import re
import zlib

import pytest

from quorum.llm import conversation_repair as cr

SF = "/root/testdata/sf0.01"
SCHEMA = "conv_id long, turn int, role string, text string"


def damaged(rows):
    out = []
    for conv, turn, role, text in rows:
        role, text = " " if role is None else role, " " if text is None else text
        code = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        if code == 1:
            text = ""
        if code == 2:
            text = re.sub("[.!?]", "", text)
        if code == 4:
            role = "user"
        out += [(conv, turn, role, text)] * {0: 0, 3: 2}.get(code, 1)
    return out


def faults(rows):
    seen, out = set(), []
    for _, _, role, text in rows:
        body = text.rstrip("\x20\x09\x0a\x0b\x0c\x0d")
        out.append("blank" if not body.strip("\x20\x09\x0a\x0b\x0c\x0d") else "duplicate" if (role, text) in seen
                   else "truncated" if body[-1] not in ".!?" else None)
        seen.add((role, text))
    return out


def cheapest(rows, found):
    """All cheapest audits by plain dynamic programming over (row, state): (cost, audit, lines)."""
    def after(state, c):
        return {("0", "s"): "s", ("0", "u"): "u", ("s", "u"): "u", ("u", "a"): "a", ("a", "u"): "u"}.get((state, c))

    full = {"u": "user", "a": "assistant"}
    best = {"0": (0, "", ())}

    def insert(best):
        for _ in range(4):
            for state, (cost, audit, lines) in list(best.items()):
                for c in "ua":
                    to = after(state, c)
                    new = (cost + 5, audit + "I", (*lines, full[c] + ":"))
                    if to and (to not in best or new[:2] < best[to][:2]):
                        best[to] = new
        return best

    for (_, _, role, text), fault in zip(rows, found, strict=True):
        best, new = insert(best), {}

        def offer(to, entry, new=new):
            if to and (to not in new or entry[:2] < new[to][:2]):
                new[to] = entry

        for state, (cost, audit, lines) in best.items():
            offer(state, (cost + 2, audit + "D", lines))
            if fault in ("blank", "duplicate"):
                continue
            more = 5 if fault else 0
            offer(after(state, role[:1]), (cost + more, audit + "K", (*lines, f"{role}:{text}")))
            for c in "ua":
                offer(after(state, c), (cost + more + 1, audit + "R", (*lines, f"{full[c]}:{text}")))
        best = new
    best = insert(best)
    return min(best[s] for s in ("0", "a") if s in best)


def brute(rows, key, order):
    out = {}
    for conv in dict.fromkeys(r[0] for r in rows):
        own = [r for r in key(rows) if r[0] == conv]
        own.sort(key=order)
        found = faults(own)
        turns = [r[1] for r in own if r[1] is not None]
        initials = [r[2][:1] for r in own]
        cost, audit, lines = cheapest(own, found)
        out[conv] = (max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0, found.count("blank"), found.count("duplicate"),
                     found.count("truncated"), sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:], strict=False)),
                     cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest())
    return out


def some_rows(n_conv=160, seed=1):
    random.seed(seed)
    texts = ["Yes.", "No!", "well", "Why?", "", " ", None, "\t\n", "so. ", "Grün", "and\n", "ok.\x85"]
    roles = ["user", "assistant", "user", "assistant", "system", "tool", "", None, "sys", "User"]
    rows = []
    for conv in [None, *range(n_conv)]:
        turns = random.sample(range(30), random.randint(1, 12))
        if random.random() < 0.2:
            turns.append(None)
        rows += [(conv, t, random.choice(roles), random.choice(texts) or random.choice(texts)) for t in turns]
    return rows


def result(df):
    names = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")
    return {r["conv_id"]: tuple(r[c] for c in names) for r in df.collect()}


ORDER = lambda r: (r[1] is not None, r[1] or 0)


@pytest.mark.parametrize("block", [4096, 3])
def test_report_equals_a_plain_search(spark, block):
    rows = some_rows()
    df = spark.createDataFrame(rows, SCHEMA).repartition(5)
    assert result(cr.repair_report(cr.damaged(df), df, block)) == brute(rows, damaged, ORDER)


def test_rules_change_no_result(spark):
    rows = some_rows(60, seed=3)
    df = spark.createDataFrame(rows, SCHEMA)
    one = {r["conv_id"]: r["audit"] for r in cr.audits(cr.damaged(df), rounds=0).collect()}
    two = {r["conv_id"]: r["audit"] for r in cr.audits(cr.damaged(df), rounds=5, rules=8).collect()}
    assert one == two and len(one) > 50


def test_rules_shorten_common_runs():
    grammar = cr.Grammar(["ua", chr(0x10000) * 2])
    assert grammar.compress(["suauaua", "uaua"]) == ["s" + chr(0x10001) + chr(0x10000), chr(0x10001)]
    for seq in ("suauaua", "uUa-xx", "aaSu"):
        by_rules = grammar.finish(grammar.step(grammar.start(), grammar.compress([seq])[0]))
        assert by_rules == cr.Grammar([]).finish(cr.Grammar([]).step(grammar.start(), seq))


def test_repeated_rows_and_one_long_conversation(spark):
    """One conversation holds nearly all rows, one row repeats often; blocks and tasks cut it."""
    rows = [(7, t, "user" if t % 3 else "assistant", f"Text {t % 700}" + "." * (t % 5 > 0)) for t in range(2000)]
    rows += [(7, 5, "user", "Again.")] * 900 + [(8, 0, "user", "Hi."), (8, 1, "assistant", "Hi.")]
    df = spark.createDataFrame(rows, SCHEMA).repartition(6)
    got = result(cr.repair_report(df, df, block=50))
    own = [r for r in rows if r[0] == 7]
    hashes = {(r["role"], r["text"]): (r["h"], r["g"]) for r in cr._keys(df).collect()}
    own.sort(key=lambda r: (r[1], *hashes[r[2:]]))
    cost, audit, lines = cheapest(own, faults(own))
    assert got[7][5:] == (cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest())
    assert got[8][5:7] == (0, "KK")


def test_repair_gives_rows(spark):
    rows = [(1, 0, "assistant", "Hello."), (1, 1, "assistant", "Who?"), (1, 2, "user", "")]
    df = spark.createDataFrame([(*r, 5, "x") for r in rows], SCHEMA + ", h long, copies string")
    got = sorted(((r["place"], r["edit"], r["role"], r["text"]) for r in cr.repair(df).collect()), key=str)
    assert got == [(0, "R", "user", "Hello."), (1, "K", "assistant", "Who?"), (None, "D", "user", "")]


def test_empty_table_and_conversation_without_rows(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert cr.repair_report(cr.damaged(none), none).count() == 0 and cr.repair(none).count() == 0
    gone = next(c for c in range(100) if zlib.crc32(f"{c}:0".encode()) % 20 == 0)
    df = spark.createDataFrame([(gone, 0, "user", "Hi.")], SCHEMA)
    assert result(cr.repair_report(cr.damaged(df), df)) == {gone: (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())}


def test_query_on_a_whole_table(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert result(cr.op12_conversation_repair(spark, SF)) == brute(rows, damaged, ORDER)
