"""The text operators against brute force, on small tables with the awkward cases."""

import hashlib
import json
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from quorum.llm import attention, bpe, exact_dedup, html_extract, id_files, lm, minhash, packing, pii, quality, sharding
from quorum.llm.packing import tokenizer_text

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def prose(rng, n):
    common = quality.COMMON["en"]
    return " ".join(rng.choice(common) if rng.random() < 0.4 else "".join(rng.choice(["an", "thor", "re", "ing"]) for _ in range(3)) for _ in range(n))


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(3)
    base = [prose(rng, n) for n in (60, 200, 400, 120)]
    texts = [*base, base[0], base[0].replace(" ", "\n\t"), base[1] + " end", None, "", "  \n ", "one", "one two", "x" * 6000, (base[2] + "\n") * 3,
             "mail a.b@c.de or +1 (234) 555-7788, 10.0.0.1 999.1.1.1 or 4111 1111 1111 1111 é@x.y", " ".join([base[3]] * 40), "''s 'll naïve 日本 <|endoftext|> \x1c\x85 z"]
    out = [(i, t, "en", "src0", "clash") for i, t in enumerate(texts)]
    return [*out, (0, base[0], "en", "src0", "clash"), (None, base[2], None, None, None), (40, prose(rng, 90), "xx", None, None),
            (41, "no\xa0break thin\u2009space x\x85y ideo\u3000graphic Dr.\u202fX", None, None, None)]


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, size string").repartition(3)


def empty(docs):
    return docs.where("false")


def test_exact_dedup(docs, rows):
    got = exact_dedup.exact_dedup(docs, block=7).collect()
    norm = lambda t: re.sub(r"[\x20\x09-\x0D]+", " ", t or "")
    groups = {}
    for r in rows:
        groups.setdefault(hashlib.sha256(norm(r[1]).encode()).hexdigest(), []).append(r[0])
    assert len(got) == len(rows) and sum(g.kept for g in got) == len(groups)
    for g in got:
        ids = groups[g.text_sha256]
        assert g.group_size == len(ids) and g.keep_id == min((i for i in ids if i is not None), default=None)
    assert exact_dedup.exact_dedup(empty(docs)).count() == 0
    assert exact_dedup.drop_copies(docs).columns == docs.columns and exact_dedup.drop_copies(docs).count() == len(groups)


def brute_sets(text, k):
    w = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} or ({tuple(w)} if w else set())


@pytest.mark.parametrize("group", [400_000, 50])
def test_near_duplicates(spark, docs, rows, group):
    rng, words = random.Random(5), [f"w{i}" for i in range(300)]
    more = []
    for i in range(30):  # a chain of edits
        words[rng.randrange(300)] = f"e{i}"
        more.append((100 + i, " ".join(words), None, None, None))
    got = {(r.doc_id, r.h): r for r in minhash.near_duplicates(docs.union(spark.createDataFrame(more, docs.schema)), k=3, percent=85, group=group).collect()}
    every = rows + more
    sets = [brute_sets(r[1], 3) for r in every]
    comp = list(range(len(every)))
    for i in range(len(every)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= 85 * (len(sets[i]) + len(sets[j]) - both):
                comp = [comp[j] if c == comp[i] else c for c in comp]
    for r, c, s in zip(every, comp, sets, strict=True):
        g = next(v for (d, _), v in got.items() if d == r[0] and v.n_shingles == len(s))
        ids = [e[0] for e, x in zip(every, comp, strict=True) if x == c and e[0] is not None]
        assert g.component_id == min(ids, default=None)
    assert minhash.near_duplicates(empty(docs)).count() == 0


def test_superminhash_estimates_similarity():
    rng = np.random.default_rng(0)
    a = rng.integers(0, 1 << 62, 1000).astype(np.uint64)
    b = np.concatenate([a[:800], rng.integers(0, 1 << 62, 200).astype(np.uint64)])
    sig = minhash.superminhash(np.concatenate([a, b, a[:1]]), np.repeat([0, 1, 2], [1000, 1000, 1]), 3, 512)
    assert abs((sig[0] == sig[1]).mean() - 800 / 1200) < 0.06
    assert sorted(np.floor(sig[2])) == list(range(512))  # one element visits each slot once


def test_private_data(spark, docs, rows):
    got = {(r.doc_id, r.base_sha256): r for r in pii.find_private(docs).collect()}
    hit = next(r for (d, _), r in got.items() if d == 14)
    text = rows[14][1]
    spans = [s.split(":") for s in hit.spans.split(",")]
    assert [(k, text[int(a) : int(b)]) for k, a, b in spans] == [
        ("email", "a.b@c.de"), ("phone", "+1 (234) 555-7788"), ("ip", "10.0.0.1"), ("card", "4111 1111 1111 1111")]
    assert (hit.n_email, hit.n_ip, hit.n_card, hit.n_phone) == (1, 1, 1, 1)
    assert sum(1 for r in got.values() if r.spans) == 1 and pii.find_private(empty(docs)).count() == 0
    # a nickname that stands only near one address reveals it; a common word doesn't
    told = [(i, f"the quiet Zorblax wrote to {'zed@corp.org'} again the day" if i < 4 else f"the plain day number {i} again", None, None, None) for i in range(40)]
    table = spark.createDataFrame(told, docs.schema)
    found = {r.doc_id: r for r in pii.find_private(table).collect()}
    assert "term:10:17" in found[0].spans and not re.search(r"term:0:3\b", found[0].spans) and not found[9].spans
    clean = {r.doc_id: r.text for r in pii.sanitise(table).collect()}
    assert clean[0].startswith("the <TERM> <NAME>") and "<EMAIL>" in clean[0] and clean[9] == told[9][1]


def test_quality(docs, rows):
    got = {(r.doc_id, r.n_words, r.word_chars): r for r in quality.quality_rules(docs).collect()}
    for r in rows:
        t = r[1] or ""
        w = WORD.findall(t)
        c = Counter(zip(w, w[1:], w[2:], strict=False))
        twice = {j for i in range(len(w) - 2) if c[tuple(w[i : i + 3])] > 1 for j in (i, i + 1, i + 2)}
        lines = [x for x in t.split("\n") if WORD.search(x)]
        g = got[r[0], len(w), sum(map(len, w))]
        assert (g.n_symbols, g.n_dup_lines, g.n_repeat_words) == (len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(twice))
        assert g.base_failed == (len(w) < 50 or 100 * len(twice) > 50 * len(w)) and not (g.base_failed and g.kept)
    assert got[1, 200, sum(map(len, WORD.findall(rows[1][1])))].kept
    assert quality.quality_rules(empty(docs)).count() == 0
    kept = quality.keep_good(docs)
    assert kept.columns == docs.columns and kept.count() == sum(1 for r in rows if got[r[0], len(WORD.findall(r[1] or "")), sum(map(len, WORD.findall(r[1] or "")))].kept)


def test_quality_judges_each_document_by_its_own_language(spark):
    rng = random.Random(8)
    words = {"it": "il di che e la per un non del si".split(), "ru": "и в не на что с по как это он".split(), "code": "if for return self def in not and".split()}
    def text(lang, n=150):
        parts = "ла но ри" if lang == "ru" else "zi po ra"
        return " ".join(rng.choice(words[lang]) if rng.random() < 0.4 else "".join(rng.choice(parts.split()) for _ in range(3)) + str(rng.randrange(99)) for _ in range(n))
    table = [(100 * k + i, text(lang), lang) for k, lang in enumerate(words) for i in range(12)]
    table += [(1000, text("ru"), None), (1001, text("it"), "ru"), (1002, text("it", 60), "xx"), (1003, prose(rng, 150), "en")]
    got = {r.doc_id: r for r in quality.quality_rules(spark.createDataFrame(table, "doc_id long, text string, lang string")).collect()}
    assert len(got) == len(table) and all(got[i].kept for i, _, _ in table if i != 1001)
    assert not got[1001].kept and got[1000].word_distance is None and got[1002].word_distance is None and got[0].word_distance is not None


def tokenizer(name):
    import public_tokenizers
    from tokenizers import Tokenizer

    return Tokenizer.from_file(public_tokenizers.path(name))


def test_quality_counts_each_class_and_repeats_in_one_reduced_text(spark):
    texts = ["Ab1, c.D;é 日\t#x*_\x01?  Z9", "plain words only", "A.B.C!", "", "a b c a b c d a b c", "x " * 40, "no repeat in these few words", "1 2 1 2 1 2"]
    df = spark.createDataFrame([(i, t, "en") for i, t in enumerate(texts)], "doc_id long, text string, lang string")
    made = quality._unusual(quality._texts(df, "doc_id", "text", "lang", [])).select("doc_id", *quality._histogram(), quality._repeated(quality.F.col("words")).alias("rep"))
    made = {r["doc_id"]: (list(r["chars"]), r["rep"]) for r in made.select("doc_id", "rep", quality._character_counts().alias("chars")).collect()}
    for i, t in enumerate(texts):
        white = sum(c in " \t\n\x0b\x0c\r" for c in t)
        known = [sum("A" <= c <= "Z" for c in t), sum("0" <= c <= "9" for c in t), sum(c in ".,;:!?" for c in t)]
        beyond, small = sum(c > "\x7f" for c in t), sum("a" <= c <= "z" for c in t)
        w = WORD.findall(t)
        windows = Counter(zip(w, w[1:], w[2:], strict=False))
        covered = {k + j for k in range(len(w) - 2) if windows[tuple(w[k : k + 3])] > 1 for j in range(3)}
        assert made[i] == ([small, white, *known, len(t) - white - small - sum(known) - beyond, beyond], len(covered))


def test_bpe_equals_the_library(docs, rows):
    t = tokenizer("byte_bpe_50k.json")
    rng = random.Random(2)
    model = bpe.ByteBpe(packing.tokenizer_text(None, "byte_bpe_50k.json"))
    odd = ["aaaa" * 40, " \n\n x", "it's  we'll\t\tgo", "<|endoftext|>a <|endoftext|>", "\x00", *(r[1] or "" for r in rows)]
    odd += ["".join(chr(rng.choice([rng.randrange(32, 127), rng.randrange(0x2000), rng.randrange(0x1F600, 0x1F640), 32])) for _ in range(30)) for _ in range(60)]
    for text, (n, ids, back) in zip(odd, model.digests(odd), strict=True):
        want = t.encode(text, add_special_tokens=False).ids
        assert model.encode(text) == want and n == len(want)
        assert ids == hashlib.sha256(",".join(map(str, want)).encode()).hexdigest()
        assert back == hashlib.sha256(t.decode(want, skip_special_tokens=False).encode()).hexdigest()
    assert bpe.round_trip(docs).count() == len(rows) and bpe.round_trip(empty(docs)).count() == 0
    back = bpe.decode(bpe.encode(docs)).collect()
    assert Counter((r.doc_id, r.text) for r in back) == Counter((r[0], r[1] or "") for r in rows)


def encoded(rows):
    t = tokenizer("word_bpe_49k.json")
    return [np.array([*t.encode(r[1] or "", add_special_tokens=False).ids, 2], "<u4") for r in rows]


def test_id_files(spark, docs, rows, tmp_path):
    path = f"file://{tmp_path}/ids"
    id_files.write_ids(docs, path)
    got = id_files.read_ids(spark, path).collect()
    want = Counter((r[0], e.tobytes()) for r, e in zip(rows, encoded(rows), strict=True))
    assert Counter((g.doc_id, bytes(g.ids)) for g in got) == want
    at = 0
    for g in sorted(got, key=lambda g: g.start):
        assert g.start == at
        at += len(g.ids) // 4
    assert [g.doc_id for g in sorted(got, key=lambda g: g.start)] == sorted((r[0] for r in rows), key=lambda d: (d is not None, d))
    assert bytes(id_files.read_document(spark, path, 3).collect()[0].ids) == encoded(rows)[3].tobytes()
    id_files.write_ids(empty(docs), f"{path}-none")
    assert id_files.digests(spark, f"{path}-none").count() == 0


def test_chunks_of_later_batches_get_the_librarys_ids():
    """Places follow the order in which chunks are met, over batches and after the cache is emptied."""
    import public_tokenizers
    from tokenizers import Tokenizer

    from quorum.llm import word_ids

    cache = word_ids.ChunkCache(packing.tokenizer_text(None))
    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    for texts in (["The cat, sat. . ! Straße?", "", "the CAT"], ["a cat; 12:30 ! naïve", "The mat"], ["new words only", "a cat"]):
        ids, begins = cache.encode(texts)
        for text, i, j in zip(texts, begins[:-1], begins[1:], strict=True):
            assert ids[i:j].tolist() == library.encode(text, add_special_tokens=False).ids
        assert list(cache.index.values()) == list(range(len(cache.index)))
    cache._forget()
    assert cache.encode(["The cat"])[0].tolist() == library.encode("The cat", add_special_tokens=False).ids


def test_signatures_work_on_bounded_runs_of_bytes():
    import tracemalloc

    import pyarrow as pa

    from quorum.llm import shingles

    rng = random.Random(5)
    texts = ["".join(rng.choice("abcdefg ") for _ in range(4000)) for _ in range(1000)]
    batch = pa.RecordBatch.from_arrays([pa.array(range(1000)), pa.array(range(1000)), pa.array(texts)], ["doc_id", "h", "text"])
    bands, length = minhash.band_shape(80)
    shingles._powers = (np.ones(1, np.uint64), np.ones(1, np.uint64))
    tracemalloc.start()
    out = list(minhash._sign(5, minhash.SLOTS, bands, length)(iter([batch])))
    peak = tracemalloc.get_traced_memory()[1] / 2**20
    tracemalloc.stop()
    assert sum(b.num_rows for b in out) == 1000 and peak < 120


def test_packing(docs, rows):
    got = packing.pack(docs, length=256, group=8).collect()
    want = Counter((r[0], len(e), zlib.crc32(e[s : s + 256].tobytes()), s) for r, e in zip(rows, encoded(rows), strict=True) for s in range(0, len(e), 256))
    assert Counter((g.doc_id, g.doc_tokens, g.ids_crc32, g.start) for g in got) == want
    by = {}
    for g in got:
        by.setdefault(g.sequence_id, []).append((g.offset, g.length))
    assert sorted(by) == list(range(len(by)))
    for pieces in by.values():
        at = 0
        for offset, n in sorted(pieces):
            assert offset == at
            at += n
        assert at <= 256
    assert packing.pack(empty(docs)).count() == 0


def test_best_fit_decreasing():
    rng = np.random.default_rng(1)
    sizes = np.sort(rng.integers(1, 101, 500))[::-1]
    window, offset, n = packing.best_fit_decreasing(sizes, 100)
    room, want = [], []
    for s in sizes:  # the tightest window by looking at all
        fit = [(r, -i) for i, r in enumerate(room) if r >= s]
        if not fit:
            room.append(100)
            fit = [(100, -(len(room) - 1))]
        r, i = min(fit)
        room[-i] -= s
        want.append(r)
    assert [100 - o for o in offset] == want and n == len(room)


def test_sharding(spark, docs, rows):
    table = spark.createDataFrame([(i // 3 if i % 50 else None, i * 37 % 101 if i % 7 else None, i, "x") for i in range(3000)], "doc_id long, size long, n long, slot string")
    got = sharding.shard(table, "doc_id", "size", shards=7, part=4000).collect()
    assert sorted(g.n for g in got) == list(range(3000))
    total = Counter()
    slots = {}
    for g in got:
        total[g.shard] += g.size or 0
        slots.setdefault(g.shard, []).append((g.slot, -1 if g.doc_id is None else g.doc_id))
    assert sorted(total) == list(range(7)) and max(total.values()) - min(total.values()) <= 2 * 101
    last = -1
    for s in range(7):
        own = sorted(slots[s])
        assert [x for x, _ in own] == list(range(len(own))) and [d for _, d in own] == sorted(d for _, d in own) and own[0][1] >= last
        last = own[-1][1]
    hot = spark.range(1000).selectExpr("1L as doc_id", "10L as size")
    assert sorted(Counter(r.shard for r in sharding.shard(hot, "doc_id", "size", shards=4).collect()).values()) == [250] * 4
    assert sharding.shard(table.where("false"), "doc_id", "size").count() == 0


def test_lm(docs, rows):
    got = lm.score_texts(docs).collect()
    learns = [not lm.held_out(r[0]) for r in rows]
    words = [[*(r[1] or "").encode().lower().split(), b""] for r in rows]
    c = Counter(w for ws, yes in zip(words, learns, strict=True) if yes for w in ws)
    total, distinct = sum(c.values()), len(c)
    want = Counter((r[0], not yes, len(ws), sum(c[w] > 0 for w in ws), total, round(sum(math.log10((c[w] + 1) / (total + distinct + 1)) for w in ws), 6))
                   for r, ws, yes in zip(rows, words, learns, strict=True))
    assert Counter((g.doc_id, g.held_out, g.n_tokens, g.n_known, g.train_tokens, round(g.base_score, 6)) for g in got) == want
    assert all(g.score < 0 and math.isfinite(g.score) for g in got)
    assert lm.score_texts(empty(docs)).count() == 0


def test_lm_learns_from_all_training_documents(monkeypatch):
    from types import SimpleNamespace

    import pyarrow as pa

    from quorum.llm import attention as A

    classes = lm.Classes(np.arange(2000, 0, -1))
    ids = list(range(200))
    rows = [np.arange(i % 7 + 1, dtype="<u4").tobytes() for i in ids]  # many equal texts
    batch = pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(rows, pa.binary())], ["doc_id", "ids"])
    got = [x for b in lm._follow(SimpleNamespace(value=classes))(iter([batch])) for x in b.to_pylist() if x["round"] is not None]
    learns = [r for d, r in zip(ids, rows, strict=True) if not lm.held_out(d)]
    assert Counter(len(x["classes"]) // 2 - 1 for x in got) == Counter(len(r) // 4 for r in learns)  # and an end each
    assert len({x["round"] for x in got if len(x["classes"]) == 4}) > 1  # copies don't share a round
    # slices leave no window out
    monkeypatch.setattr(lm, "SLICE", 100)
    prior = np.log(np.full((A.CLASSES, A.CLASSES), 1 / A.CLASSES, np.float32))
    texts = pa.RecordBatch.from_arrays([pa.array([x["classes"] for x in got], pa.binary())], ["classes"])
    made = list(lm._train(SimpleNamespace(value=(prior, A.Attention(prior).flat)), 0)(iter([texts])))
    assert len(made) == 1 and made[0].column(0).to_pylist() == [len(learns)]


def test_attention_scores_each_token_once_and_sums_to_one():
    from quorum.llm import attention as A

    begins = np.array([0, 1, 1, 60, 200])
    at, wanted = A.windows(begins)
    assert Counter(at[wanted].tolist()) == Counter(range(200))
    rng = np.random.default_rng(0)
    model = A.Attention(np.log(rng.dirichlet(np.ones(A.CLASSES), A.CLASSES)))
    x = np.repeat(rng.integers(0, A.CLASSES, (1, A.WINDOW)), A.CLASSES, axis=0)
    goal = np.broadcast_to(np.arange(A.CLASSES)[:, None], x.shape)
    last = np.zeros(x.shape, bool)
    last[:, 9] = True
    assert abs(np.exp(model.score(x, goal, last)).sum() - 1) < 1e-4
    g = model.gradient(x[:2], goal[:2], last[:2])
    i = int(np.argmax(np.abs(g)))
    step = 1e-2
    losses = []
    for sign in (1, -1):
        moved = model.flat.copy()
        moved[i] += sign * step
        losses.append(-A.Attention(model.group_prior.repeat(A.MEMBERS, 1) + model.member_prior.transpose(1, 0, 2).reshape(A.CLASSES, -1), moved).score(x[:2], goal[:2], last[:2]).mean())
    assert abs((losses[0] - losses[1]) / (2 * step) - g[i]) < 0.05 * abs(g[i]) + 1e-4


def test_html(spark):
    page = ("<html><head><title>t</title><script>var a='<p>x</p>';</script></head><body><nav><a>menu</a></nav><div class='ad'>buy</div><article><h1>A &amp; B</h1>"
            "<p>one <b>two<br><p>th<i>r</i>ee<!-- no --> <aside>side</aside><form>f</form><div class=\"comments\">hi</div></article><footer>f</footer></body></html>")
    plain = "<body><div>Same top</div><div><p>{}</p></div><p>Same end</p></body>"
    table = [(1, "http://a.b/1", page), (2, None, None), (3, "http://a.b/2", ""), *((10 + i, "https://U@Host.org:80/%d" % i, plain.format(f"text {i}")) for i in range(5)), (1, "http://a.b/1", page)]
    got = {r.page_id: r for r in html_extract.extract(spark.createDataFrame(table, "page_id long, url string, html string")).collect()}
    assert got[1].text == "A & B one two three" and got[1].n_chars == len(got[1].text)
    assert got[2].text == "" and got[3].text == "" and got[12].text == "text 2"
    assert html_extract.extract(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_html_template_inside_articles_and_classes_of_holders(spark):
    def text(pages):
        table = [(i, f"http://a.b/{i:03}", p) for i, p in enumerate(pages)]
        found = {r.page_id: r.text for r in html_extract.extract(spark.createDataFrame(table, "page_id long, url string, html string")).collect()}
        return [found[i] for i in range(len(pages))]

    article = "<body><article><h1>Head {0}</h1><p>Send us <a>your story</a></p><p><b>Note:</b> text {0}</p><div class='x9'>Read more in our app</div></article></body>"
    assert text([article.format(i) for i in range(5)]) == [f"Head {i} Note: text {i}" for i in range(5)]
    # the article's sole text stays though it is constant
    assert text([f"<!-- {i} --><body><article><h1>Gone</h1></article></body>" for i in range(5)]) == ["Gone"] * 5
    # a word of a class doesn't hide the whole page or what holds the article; it hides what doesn't
    held = "<p>long text of a page</p><div class='share'>share it</div>"
    assert text([f"<body class='post has-sidebar'><article>{held}</article></body>", f"<body><div class='main-with-nav'><article>{held}</article></div></body>",
                 f"<form><div class='main-with-nav'>{held}</div></form>", f"<article class='post has-sidebar'>{held}</article>",
                 f"<main>{held}</main><div class='sidebar'><article>teaser</article></div>", f"<p>{held}</p><div class='main-nav'>Home News About</div>"]) == ["long text of a page"] * 6


def test_html_no_single_page_decides_the_template(spark):
    plain = ["", "<p>start</p>", *(f"<div><div class='box{i}'><p>text {i}</p>{'<p>more %d</p>' % i * (i % 3)}</div></div><ul><li>Home<li>News</ul><section>Mind the gap</section>" for i in range(6))]
    # the notice stands after another number of paragraphs on each page, and not on the first
    plain += [f"<article>{'<p>say %d</p>' % i * (i % 4)}<p>Join us</p><p>end {i}</p></article>" for i in range(6, 14)]
    table = [(i, f"http://a.b/{i:03}", p) for i, p in enumerate(plain)]
    got = {r.page_id: r.text for r in html_extract.extract(spark.createDataFrame(table, "page_id long, url string, html string")).collect()}
    assert [got[i] for i in range(2)] == ["", "start"]
    assert [got[2 + i] for i in range(6)] == [" ".join([f"text {i}", *[f"more {i}"] * (i % 3)]) for i in range(6)]
    assert [got[2 + i] for i in range(6, 14)] == [" ".join([*[f"say {i}"] * (i % 4), f"end {i}"]) for i in range(6, 14)]


def test_json_is_not_needed_for_merges():
    known = json.loads(packing.tokenizer_text(None, "byte_bpe_50k.json"))
    assert len({a + b for a, b in (m.split(" ") if isinstance(m, str) else m for m in known["model"]["merges"])}) == len(known["model"]["merges"])  # one merge for each product


def test_counted_words_leave_in_bounded_batches(monkeypatch):
    monkeypatch.setattr(lm, "RUN", 500)
    monkeypatch.setattr(lm, "ROWS", 2)
    monkeypatch.setattr(lm, "REMEMBERED", 1000)
    docs = [(i, " ".join(f"{'Ab'[j % 2]}{i}x{j}" for j in range(700))) for i in range(8)] + [(8, None), (9, "a a A")]
    batch = pa.RecordBatch.from_arrays([pa.array([d for d, _ in docs], pa.int64()), pa.array([t or "" for _, t in docs])], ["doc_id", "text"])
    shared = type("Shared", (), {"value": tokenizer_text(None)})
    out = list(lm._encode(shared)(iter([batch])))
    words, rows = Counter(), []
    for part in out:
        counted = [(w, n) for w, n in zip(part.column(0).to_pylist(), part.column(1).to_pylist()) if w is not None and w[:1] != b" "]
        assert len(counted) <= 500
        for w, n in counted:
            words[w] += n
        rows += [d for d, t in zip(part.column(2).to_pylist(), part.column(3).to_pylist()) if t is not None]
    learns = [t or "" for d, t in docs if not lm.held_out(d)]
    want = Counter(w for t in learns for w in t.lower().encode().split())
    want[b""] = len(learns)
    assert words == want and sorted(rows) == list(range(10))
    cache = lm.chunk_cache(shared.value)
    assert len(cache.index) <= 2400 and cache.forgotten > 1


def test_gradient_equals_differences_of_the_loss():
    rng = np.random.default_rng(2)
    model = attention.Attention(np.log(rng.dirichlet(np.ones(attention.CLASSES), attention.CLASSES) + 1e-6))
    model.flat[:] = rng.normal(size=len(model.flat)) * 0.2
    begins = np.array([0, 30, 31, 90])
    tokens = rng.integers(0, attention.CLASSES, 90)
    before = np.concatenate([[5], tokens[:-1]])
    at, wanted = attention.windows(begins)
    args = before[at], tokens[at], wanted
    g = model.gradient(*args)
    for _ in range(12):
        way = rng.normal(size=len(g)).astype(np.float32) * 1e-3
        start = model.flat.copy()
        model.flat[:] = start + way
        up = -model.score(*args).mean()
        model.flat[:] = start - way
        down = -model.score(*args).mean()
        model.flat[:] = start
        assert np.isclose((up - down) / 2, g @ way, rtol=0.05, atol=2e-4)


def test_texts_come_in_small_batches(spark, docs, monkeypatch):
    """Packing and the language model run their Python steps on bounded batches; the session's own bound holds again afterwards."""
    from quorum.llm import common

    name, seen = "spark.sql.execution.arrow.maxRecordsPerBatch", {}
    own, stage_table = spark.conf.get(name), common.stage_table
    for module in (packing, lm):
        monkeypatch.setattr(module, "stage_table", lambda df, to: seen.setdefault(to, spark.conf.get(name)) and stage_table(df, to))
    packing.pack(docs)
    lm.score_texts(docs)
    assert {seen[to] for to in ("tokens", "encoded", "followed", "scored")} == {str(common.BATCH_ROWS)}
    assert spark.conf.get(name) == own

    def sizes(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows])], ["n"])

    rows = spark.range(0, 2500, 1, 1).mapInArrow(sizes, "n long")
    with common.small_batches(spark, 700):
        assert [r.n for r in rows.collect()] == [700, 700, 700, 400]
    assert spark.conf.get(name) == own
