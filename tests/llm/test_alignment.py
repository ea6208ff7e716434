"""Cross-tokenizer alignment against the libraries and a plain loop over all token pairs."""

import hashlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest

from quorum.llm import alignment as al
from quorum.llm.bpe import byte_letters

SF = "/root/testdata/sf0.001"
TEXTS = [
    "The quick brown fox, jumps!", "", None, " ", "  two  spaces ", "tab\tand \t lines\n\n  end \n", "Größe straße 東京 😀 e\u0301",
    "<|endoftext|> and <s> </s>", "▁mark a▁b", "a" * 300, "x \x1c y\u00a0z \u3000w", "nul\x00 here", "same words", "same words", "1234567890 12", "\ufb01 \u2126 ½",
    "\r\nline\r\n", "trailing ", "don't we'll I'm", "a  b   c    d", "\u200bzero width\ufeff",
]


def libraries():
    from sentencepiece import SentencePieceProcessor
    from tokenizers import Tokenizer

    a = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    a.encode_special_tokens = True
    back = {c: i for i, c in enumerate(byte_letters())}
    b = SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))

    def one(text):
        x = a.encode(" " + text, add_special_tokens=False).ids
        return x, [bytes(back[c] for c in a.id_to_token(i)) for i in x]

    def two(text):
        x = b.encode(text)
        pieces = [b.id_to_piece(i) for i in x]
        return x, [bytes([int(p[3:5], 16)]) if len(p) == 6 and p.startswith("<0x") else p.replace("\u2581", " ").encode() for p in pieces]

    return one, two


def spans(pieces):
    out, at = [], 0
    for p in pieces:
        out.append((at, at + len(p)))
        at += len(p)
    return out


def brute(texts):
    one, two = libraries()
    docs, counts = [], Counter()
    for text in texts:
        (a, pa), (b, pb) = (one(text), two(text)) if text else (([], []), ([], []))
        if not text or b"".join(pa) != (" " + text).encode() or b"".join(pb) != (" " + text).encode():
            docs.append(([], [], [], []))
            continue
        sa, sb = spans(pa), spans(pb)
        links = [(i, j) for i, x in enumerate(sa) for j, y in enumerate(sb) if x[0] < y[1] and y[0] < x[1]]
        cuts = sorted({e for _, e in sa} & {e for _, e in sb})
        groups, low = [], 0
        for cut in cuts:
            groups.append(([i for i, s in zip(a, sa, strict=True) if low < s[1] <= cut], [j for j, s in zip(b, sb, strict=True) if low < s[1] <= cut]))
            low = cut
        docs.append((a, b, links, groups))
        counts.update((a[i], b[j]) for i, j in links)
    top = Counter()
    for (_, j), n in counts.items():
        top[j] = max(top[j], n)
    rows = []
    for a, b, links, groups in docs:
        own = [(a[i], b[j]) for i, j in links]
        text = ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in groups)
        rows.append((len(a), len(b), len(groups), len(links), sum(counts[p] == top[p[1]] for p in own), sum(counts[p] for p in own),
                     hashlib.sha256(text.encode()).hexdigest() if text else ""))
    return rows


NAMES = ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")


@pytest.mark.parametrize("sent", [al.SENT, 40, 0])
def test_report_equals_a_plain_loop(spark, sent):
    df = spark.createDataFrame([(i, t, 1, "x") for i, t in enumerate(TEXTS)], "doc_id long, text string, row long, pair string").repartition(3)
    got = {r["doc_id"]: tuple(r[c] for c in NAMES) for r in al.link_report(df, sent=sent).collect()}
    assert got == dict(enumerate(brute(TEXTS)))
    assert sum(r[0] == 0 for r in got.values()) < 8


EDGES = [" b", " \x0b", " \n", "  b", " a b  c ", "\tb", "\n b", " \u0301x", " \x85K*", " ▁a", "▁ ▁", "\u00a0 b \u3000 c", " 8 ", "b "]


def test_texts_that_begin_with_white_space(spark):
    """Side B's own space and a text's first one are encoded together."""
    df = spark.createDataFrame(list(enumerate(EDGES)), "doc_id long, text string").repartition(3)
    got = {r["doc_id"]: tuple(r[c] for c in NAMES) for r in al.link_report(df).collect()}
    assert got == dict(enumerate(brute(EDGES)))
    assert all(got[i][0] > 0 for i in (0, 1, 2, 3, 4, 7))


def test_units_equal_whole_texts(spark):
    """Encoding by units gives the libraries' ids of the whole text."""
    texts = [r["text"] or "" for r in spark.read.parquet(f"{SF}/documents.parquet").select("text").collect()] + [t or "" for t in TEXTS]
    one, two = libraries()
    with open(public_tokenizers.path("byte_bpe_50k.json"), encoding="utf-8") as f, open(public_tokenizers.path("piece_bpe_32k.model"), "rb") as g:
        sides = al.Sides(al.byte_side(f.read()), al.piece_side(g.read()))
    assert all(side.units for side in sides)
    for (ids, counts), whole in zip(sides.encode(texts), (one, two), strict=True):
        at = 0
        for text, n in zip(texts, counts.tolist(), strict=True):
            assert text == "" or ids[at : at + n].tolist() == whole(text)[0], repr(text[:80])
            at += n


def test_align_gives_tokens_links_and_groups(spark):
    row = al.align(spark.createDataFrame([(1, "strange words")], "doc_id long, text string")).collect()[0]
    one, two = libraries()
    (a, pa), (b, pb) = one("strange words"), two("strange words")
    assert (row["a_ids"], row["b_ids"]) == (a, b)
    sa, sb = spans(pa), spans(pb)
    assert list(zip(row["link_a"], row["link_b"], strict=True)) == [(i, j) for i, x in enumerate(sa) for j, y in enumerate(sb) if x[0] < y[1] and y[0] < x[1]]
    assert row["a_group"][0] == 0 and row["a_group"][-1] == row["b_group"][-1]


def test_query_on_the_small_table(spark):
    rows = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    few = [r for r in rows if len(r["text"] or "") < 3000]
    got = {r["doc_id"]: tuple(r[c] for c in NAMES) for r in al.op13_alignment(spark, SF).collect()}
    assert len(got) == len(rows)
    df = spark.createDataFrame([(r["doc_id"], r["text"]) for r in few], "doc_id long, text string")
    own = {r["doc_id"]: tuple(r[c] for c in NAMES) for r in al.link_report(df).collect()}
    assert own == {r["doc_id"]: x for r, x in zip(few, brute([r["text"] for r in few]), strict=True)}
    assert all(got[i][:4] == own[i][:4] for i in own)


def test_empty_table_null_ids_and_repeated_rows(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert al.link_report(none).count() == 0 and al.align(none).count() == 0
    df = spark.createDataFrame([(None, "one two"), (5, "one two"), (5, "one two"), (6, None)], "doc_id long, text string")
    got = sorted((tuple(r) for r in al.link_report(df).collect()), key=str)
    assert len(got) == 4 and got[0][1:] == got[1][1:] and got[0][6] == 3 * got[0][4]


def test_units_of_a_plain_split_and_links_by_place_alone():
    """Units are those of the pattern whatever white space stands where; links by the start alone stay in their documents."""
    import itertools

    for parts in itertools.product([" ", "a", "\n", "\u00a0", "\u3000", "\x1f", "é"], repeat=4):
        assert al._units("".join(parts)) == al._UNIT.split("".join(parts))

    class Pieces:
        length = np.array([1, 2, 3])

    class Twice(al.Aligned):
        _whole = staticmethod(lambda sides, docs, found: np.array([True, False, True, True]))

    class Both(tuple):
        def encode(self, docs):
            return [(np.array([0, 1, 1, 2]), np.array([2, 0, 1, 1])), (np.array([2, 1, 1, 0]), np.array([1, 0, 1, 2]))]

    found = Twice(Both((Pieces, Pieces)), ["abc", None, "ab", "abc"])
    assert list(zip(found.left.tolist(), found.right.tolist(), strict=True)) == [(0, 0), (1, 0), (2, 1), (3, 2), (3, 3)]
    assert found.n_links.tolist() == [2, 0, 1, 2] and found.n_groups.tolist() == [1, 0, 1, 1]
    assert [g.tolist() for g in found.group] == [[0, 0, 1, 2], [0, 1, 2, 2]]
