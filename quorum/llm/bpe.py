"""Byte-level BPE in numpy: many words merge at once.

A batch's new words lie in one flat array of symbols.  In a round each word's neighbouring pairs are
looked up by binary search over the sorted pair keys, the word's lowest rank is found, and all its
places of that rank merge, from the left where they overlap.  Every token is the product of one
merge, so a merge never makes a pair of lower rank, and merging all places at once equals merging
one after the other.  Words that have no pair left leave the array.

Decoding gathers the bytes of the ids from one flat array.  Each worker remembers the words it has
encoded.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from quorum.llm.common import texts
from quorum.llm.packing import tokenizer_text
from quorum.llm.word_ids import slices

#: Fixed value: the pattern that cuts a text into words; white space as Unicode has it.
_SPACE = "".join(map(chr, [*range(0x09, 0x0E), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]))
PATTERN = rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{_SPACE}\p{{L}}\p{{N}}]+|[{_SPACE}]+(?![^{_SPACE}])|[{_SPACE}]+"

#: distinct words that a worker remembers; beyond that it starts anew
REMEMBERED = 250_000


def byte_letters() -> list[str]:
    """The letter that stands for each byte in the vocabulary: printable bytes for themselves, the others from U+0100 on."""
    printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    other = iter(range(256, 512))
    return [chr(b) if b in printable else chr(next(other)) for b in range(256)]


class ByteBpe:
    def __init__(self, definition: str):
        known = json.loads(definition)
        vocab = known["model"]["vocab"]
        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in known["model"]["merges"]]
        letters = byte_letters()
        self.size = max([*vocab.values(), *(t["id"] for t in known["added_tokens"])]) + 1
        self.byte_id = np.array([vocab[c] for c in letters], np.int64)
        keys = np.array([vocab[a] * self.size + vocab[b] for a, b in merges], np.int64)
        order = np.argsort(keys)
        self.keys, self.rank = keys[order], order
        self.made = np.array([vocab[a + b] for a, b in merges], np.int64)[order]
        back = {c: i for i, c in enumerate(letters)}
        pieces = [b""] * self.size
        for token, i in vocab.items():
            pieces[i] = bytes(back[c] for c in token)
        self.special = {t["content"]: t["id"] for t in known["added_tokens"]}
        for content, i in self.special.items():
            pieces[i] = content.encode()
        self.bytes = np.frombuffer(b"".join(pieces), np.uint8)
        self.begin = np.cumsum([0, *map(len, pieces)])
        contents = sorted(self.special, key=len, reverse=True)
        self.apart = regex.compile("(" + "|".join(map(regex.escape, contents)) + ")") if contents else None
        self.word = regex.compile(PATTERN)
        self.forget()

    def forget(self) -> None:
        self.index: dict[str, int] = {}
        self.counts, self.written, self.decoded = np.empty(0, np.int64), [], []

    def merge(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all words, number of ids of each word)."""
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        symbol, word = self.byte_id[np.frombuffer(b"".join(words), np.uint8)], np.repeat(np.arange(len(words)), lengths)
        none, done = len(self.keys), []
        while len(symbol):
            key = symbol[:-1] * self.size + symbol[1:]
            at = np.searchsorted(self.keys, key)
            at[at == none] = 0
            rank = np.full(len(symbol), none)
            hit = (self.keys[at] == key) & (word[1:] == word[:-1])
            rank[:-1][hit] = self.rank[at[hit]]
            first = np.flatnonzero(np.concatenate([[True], word[1:] != word[:-1]]))
            sizes = np.diff(np.append(first, len(word)))
            low = np.repeat(np.minimum.reduceat(rank, first), sizes)
            left = low < none
            if not left.all():
                done.append((word[~left], symbol[~left]))
                keep = np.flatnonzero(left)
                symbol, word, rank, low = symbol[keep], word[keep], rank[keep], low[keep]
                at = np.append(at, 0)[keep]
                if not len(symbol):
                    break
            else:
                at = np.append(at, 0)
            merges = rank == low
            if (merges[1:] & merges[:-1]).any():  # runs of one symbol: every second place
                places = np.flatnonzero(merges)
                run = np.concatenate([[0], np.flatnonzero(np.diff(places) > 1) + 1])
                nth = np.arange(len(places)) - np.repeat(run, np.diff(np.append(run, len(places))))
                # a run may cross from word to word only through a word's last symbol, which never merges
                merges[places[nth % 2 == 1]] = False
            places = np.flatnonzero(merges)
            symbol = symbol.copy()
            symbol[places] = self.made[at[places]]
            stay = np.ones(len(symbol), bool)
            stay[places + 1] = False
            symbol, word = symbol[stay], word[stay]
        if not done:
            return np.empty(0, np.int64), np.zeros(len(words), np.int64)
        word, symbol = np.concatenate([w for w, _ in done]), np.concatenate([s for _, s in done])
        order = np.argsort(word, kind="stable")
        return symbol[order], np.bincount(word, minlength=len(words))

    def decode(self, ids: np.ndarray, counts: np.ndarray) -> list[bytes]:
        """The bytes of each run of ids."""
        begin, length = self.begin[ids], self.begin[ids + 1] - self.begin[ids]
        upto = np.concatenate([[0], np.cumsum(length)])
        data = self.bytes[np.repeat(begin - upto[:-1], length) + np.arange(upto[-1])].tobytes()
        cuts = upto[np.concatenate([[0], np.cumsum(counts)])].tolist()
        return [data[a:b] for a, b in zip(cuts[:-1], cuts[1:], strict=True)]

    def _learn(self, new: list[str]) -> None:
        ids, counts = self.merge([w.encode() for w in new])
        self.decoded += self.decode(ids, counts)
        listed, at = ids.tolist(), 0
        for n in counts.tolist():
            self.written.append(",".join(map(str, listed[at : at + n])))
            at += n
        self.counts = np.concatenate([self.counts, counts])

    def _places(self, text: str) -> list[int]:
        """Each word's place in what the worker remembers; special tokens are words of their own."""
        index, out = self.index, []
        for i, part in enumerate(self.apart.split(text) if self.apart and self.apart.search(text) else [text]):
            words = ["\0" + part] if i % 2 else self.word.findall(part)  # no word of a text is longer than this one and begins so
            for w in words:
                place = index.get(w)
                if place is None:
                    place = index[w] = len(index)
                    self._new.append(w)
                out.append(place)
        return out

    def digests(self, texts: list[str]) -> list[tuple[int, str, str]]:
        """(number of ids, hash of the ids in decimals, hash of what they decode to) of each text."""
        if len(self.index) > REMEMBERED:
            self.forget()
        self._new: list[str] = []
        places = [self._places(t) for t in texts]
        plain = [w for w in self._new if not (w[0] == "\0" and w[1:] in self.special)]
        if len(plain) == len(self._new):
            self._learn(plain) if plain else None
        else:
            for w in self._new:
                if w[0] == "\0" and w[1:] in self.special:
                    i = self.special[w[1:]]
                    self.decoded += self.decode(np.array([i]), np.array([1]))
                    self.written.append(str(i))
                    self.counts = np.append(self.counts, 1)
                else:
                    self._learn([w])
        out, written, decoded = [], self.written, self.decoded
        for own in places:
            ids = ",".join([written[p] for p in own])
            data = b"".join([decoded[p] for p in own]).decode("utf-8", "replace").encode()
            out.append((int(self.counts[own].sum()) if own else 0, hashlib.sha256(ids.encode()).hexdigest(), hashlib.sha256(data).hexdigest()))
        return out

    def encode(self, text: str) -> list[int]:
        """The ids of one text."""
        self._new = []
        parts = self.apart.split(text) if self.apart else [text]
        out: list[int] = []
        for i, part in enumerate(parts):
            out += [self.special[part]] if i % 2 else self.merge([w.encode() for w in self.word.findall(part)])[0].tolist()
        return out


_models: dict[int, ByteBpe] = {}


def _model(definition: str) -> ByteBpe:
    key = hash(definition)
    if key not in _models:
        _models.clear()
        _models[key] = ByteBpe(definition)
    return _models[key]


def _digests(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = _model(shared.value)
        for batch in batches:
            docs = batch.column(1).to_pylist()
            for a, b in slices(docs):
                n, ids, text = zip(*model.digests(docs[a:b]), strict=True)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(a, b - a), pa.array(n, pa.int64()), pa.array(ids), pa.array(text)], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return run


def _ids(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = _model(shared.value)
        for batch in batches:
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([model.encode(t) for t in batch.column(1).to_pylist()], pa.list_(pa.int64()))], ["doc_id", "ids"])

    return run


def _texts(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = _model(shared.value)
        for batch in batches:
            rows = [np.array(x or [], np.int64) for x in batch.column(1).to_pylist()]
            data = model.decode(np.concatenate(rows), np.array([len(r) for r in rows]))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([d.decode("utf-8", "replace") for d in data])], ["doc_id", "text"])

    return run


def encode(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokenizer_path: str | None = None) -> DataFrame:
    """(doc_id, ids) of every row; null text gives no ids."""
    shared = docs.sparkSession.sparkContext.broadcast(tokenizer_text(tokenizer_path, "byte_bpe_50k.json"))
    return texts(docs, id_col, text_col).mapInArrow(_ids(shared), "doc_id long, ids array<long>")


def decode(ids: DataFrame, tokenizer_path: str | None = None) -> DataFrame:
    """(doc_id, text) of every row (doc_id, ids); null ids give an empty text."""
    shared = ids.sparkSession.sparkContext.broadcast(tokenizer_text(tokenizer_path, "byte_bpe_50k.json"))
    return ids.select("doc_id", "ids").mapInArrow(_texts(shared), "doc_id long, text string")


def round_trip(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokenizer_path: str | None = None) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256, one row per row of ``docs``, in one pass and without an exchange.

    Null text is empty.  Repeated rows and null ids are rows like any others; an empty table gives
    none; other columns aren't read.
    """
    shared = docs.sparkSession.sparkContext.broadcast(tokenizer_text(tokenizer_path, "byte_bpe_50k.json"))
    return texts(docs, id_col, text_col).mapInArrow(_digests(shared), "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def op4_bpe(spark, sf_dir: str) -> DataFrame:
    """The query of contract 4 over the whole table ``documents``."""
    return round_trip(spark.read.parquet(f"{sf_dir}/documents.parquet"))
