"""Personal data against brute force, on long texts and on many entities in one text."""

import math
import random
import re
import time
from collections import defaultdict

from quorum.llm import pii

SCHEMA = "doc_id long, text string, n_chars long"
BASE = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(d):
    return sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(reversed(d))) % 10 == 0


def base_spans(text):
    out = []
    for order, (kind, pattern) in enumerate(BASE.items()):
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m[0])
            if kind == "ip" and max(map(int, m[0].split("."))) > 255 or kind == "card" and not (12 <= len(digits) <= 19 and luhn(digits)) or (
                    kind == "phone" and not 9 <= len(digits) <= 15):
                continue
            name = m[0].lower() if kind == "email" else m[0] if kind == "ip" else digits
            out.append((m.start(), order, m.end(), kind, f"{kind}:{name}"))
    return sorted(out)


def words(text):
    return [(m.start(), m.end(), m[0]) for m in re.finditer(r"[^\W_]+", text)]


def brute(texts):
    """Base and term spans of each text; pairs of all terms and entities are counted one by one."""
    bases = [base_spans(t) for t in texts]
    n_e, n_t, n_te = defaultdict(int), defaultdict(int), defaultdict(int)
    sets = []
    for text, spans in zip(texts, bases, strict=True):
        terms, entities = {w.lower() for _, _, w in words(text)}, {s[4] for s in spans}
        sets.append((terms, entities))
        for t in terms:
            n_t[t] += 1
            for e in entities:
                n_te[t, e] += 1
        for e in entities:
            n_e[e] += 1
    n = len(texts)

    def tells(t, e):
        return n_e[e] < n and math.log2(n * n_te[t, e] / ((n_t[t] + pii.SMOOTH) * n_e[e])) >= pii.DISCLOSURE * math.log2(n / n_e[e])

    out = []
    for text, spans, (_, entities) in zip(texts, bases, sets, strict=True):
        terms = [(a, len(BASE), b, "term", w) for a, b, w in words(text)
                 if not any(a < s[2] and s[0] < b for s in spans) and any(tells(w.lower(), e) for e in entities)]
        out.append(sorted(spans + terms))
    return out


def cleaned(text, spans):
    out, at = "", 0
    for start, _, end, kind, entity in spans:
        if start >= at:
            tag = kind.upper() if kind != "term" else "NUMBER" if entity.isdecimal() else "NAME" if entity[0].isupper() else "TERM"
            out += text[at:start] + f"<{tag}>"
        at = max(at, end)
    return out + text[at:]


def test_spans_and_texts_against_brute_force(spark):
    rng = random.Random(11)
    people = [(f"Name{c}", f"{c}.x@mail{i % 3}.org", f"10.0.{i}.7", f"+1 (234) 555-{1000 + i}") for i, c in enumerate("abcdefghijkl")]
    common = [f"word{i}" for i in range(30)]
    texts = []
    for i in range(400):
        parts = [rng.choice(common) for _ in range(rng.randrange(5, 40))]
        if i % 4 == 0:
            who = rng.randrange(len(people))
            name, *ids = people[who]
            parts += [name, ids[who % 3] if who < 9 else rng.choice(ids), rng.choice(["", "77", "Éva", "𝒳yz"]), name.lower() + "_q"]
            rng.shuffle(parts)
        texts.append(" ".join(parts))
    texts += [texts[0]] * 3 + ["", "4111 1111 1111 1111 a@b.c +49 30 1234567 1.2.3.4@x.y", "x" * 9000 + " é lone@host.net " + "y" * 9000 + " Solo"]
    rows = [(i, t, len(t)) for i, t in enumerate(texts)] + [(len(texts), None, None)]
    docs = spark.createDataFrame(rows, SCHEMA).repartition(4)
    want = brute([*texts, ""])
    got = {r.doc_id: r for r in pii.find_private(docs).collect()}
    assert len(got) == len(rows) and sum(s[3] == "term" for w in want for s in w) > 50
    for i, spans in enumerate(want):
        assert got[i].spans == ",".join(f"{k}:{a}:{b}" for a, _, b, k, _ in spans), i
        assert got[i].n_term == sum(s[3] == "term" for s in spans)
    clean = {r.doc_id: r for r in pii.sanitise(docs).collect()}
    for i, spans in enumerate(want[:-1]):
        assert clean[i].text == cleaned(texts[i], spans) and clean[i].n_chars == len(clean[i].text)
    assert clean[len(texts)].text is None and any("<NAME>" in c.text for c in clean.values() if c.text)


def test_a_text_of_100_000_addresses_ends_in_seconds(spark):
    text = " ".join(f"user{i}@host{i % 7}.org" for i in range(100_000))
    docs = spark.createDataFrame([(0, text, None), (1, text + " again", None), *[(i, "plain words", None) for i in range(2, 40)]], SCHEMA)
    begin = time.time()
    got = {r.doc_id: r.n_email for r in pii.find_private(docs).collect()}
    assert got[0] == got[1] == 100_000 and got[2] == 0
    clean = {r.doc_id: r.text for r in pii.sanitise(docs).collect()}
    assert clean[0] == " ".join(["<EMAIL>"] * 100_000) and clean[5] == "plain words"
    assert time.time() - begin < 120
