"""Token ids of whole texts by a tokenizer whose tokens never cross white space.

The tokenizers library encodes each distinct chunk of text between white space once per worker; a
text's ids are then gathered from one flat array.  That equals encoding the whole text when the
normaliser and the pre-tokenizer both treat white space as a border, as ``word_bpe_49k.json`` does.
"""

from __future__ import annotations

import json
import os
import re
from collections import defaultdict
from itertools import count, islice

import numpy as np

#: distinct chunks that a worker remembers; beyond that it starts anew
REMEMBERED = 700_000

_CHUNK = re.compile(r"[^\x20\x09-\x0D]+")
#: str.split() cuts at these too
_UNSAFE = re.compile("[\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]")
_caches: dict[int, ChunkCache] = {}


#: a mark at the end of a word is a token of its own
_TAILS = ".,:;!?"
#: stands for the mark of a chunk that isn't a plain word; -1: a plain word without a mark
_NOT_PLAIN = -2
#: letters below this, but one, have one small letter each and are never composed with others
_SIMPLE_END, _NOT_SIMPLE = "\u0180", "\u0130"


def _plain(word: str) -> bool:
    """Letters only, and such that its small letters are one token run: encoded once for all spellings."""
    return word.isalpha() and (word.isascii() or (max(word) < _SIMPLE_END and _NOT_SIMPLE not in word))


class _Index(defaultdict):
    """Chunk -> place; an unknown chunk gets the next place and is noted: keys stay in the order of their places."""

    def __init__(self):
        super().__init__(count().__next__)
        self.noted = 0

    def new(self) -> list[str]:
        """The chunks that were met since the last call."""
        new = list(islice(self, self.noted, None))
        self.noted = len(self)
        return new


def _gather(flat: np.ndarray, begin: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The runs [begin, begin + length) of ``flat`` one after the other, and where each begins in the result."""
    upto = np.concatenate([[0], np.cumsum(length)])
    return flat[np.repeat(begin - upto[:-1], length) + np.arange(upto[-1])], upto


class ChunkCache:
    def __init__(self, definition: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(definition)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        alone = {t: self.tokenizer.encode(t, add_special_tokens=False).ids for t in _TAILS}
        self.tails = {t: ids[0] for t, ids in alone.items() if len(ids) == 1}
        suffix = json.loads(definition)["model"].get("end_of_word_suffix")
        vocab = self.tokenizer.get_vocab(with_added_tokens=False)
        #: which ids end a word; none if the tokenizer doesn't mark the end
        self.closes = np.zeros(1 + max(vocab.values(), default=0), bool)
        self.closes[[i for token, i in vocab.items() if suffix and token.endswith(suffix)]] = True
        self.forgotten, self.remembered = 0, None
        self._forget()

    def _forget(self) -> None:
        self.forgotten += 1
        self.index, self.chunks, self.flat, self.ends = _Index(), [], np.empty(0, np.uint32), np.zeros(1, np.int64)
        self.words, self.word_flat = _Index(), np.empty(0, np.uint32)
        self.word_begin, self.word_length = np.empty(0, np.int64), np.empty(0, np.int64)

    def _encoded(self, some: list[str], plain: bool) -> tuple[np.ndarray, np.ndarray]:
        """(ids, ids of each word) of words joined by spaces."""
        joined = " ".join(some)
        if plain:  # a plain word has one closing id; this way the library needn't track offsets
            ids = np.array(self.tokenizer.encode_batch_fast([joined], add_special_tokens=False)[0].ids, np.uint32)
            closing = np.flatnonzero(self.closes[ids])
            if len(closing) == len(some) and closing[-1] == len(ids) - 1:
                return ids, np.diff(closing, prepend=-1)
        encoding = self.tokenizer.encode(joined, add_special_tokens=False)
        begins = np.cumsum([0, *(len(c) + 1 for c in some)])[:-1]
        at = np.array([s for s, _ in encoding.offsets], np.int64)
        return np.array(encoding.ids, np.uint32), np.bincount(np.searchsorted(begins, at, "right") - 1, minlength=len(some))

    def _learn_words(self, simple: np.ndarray) -> None:
        """Encode the new words, joined by spaces; a token belongs to the word in which it begins.  ``simple``: which of them are plain."""
        new = self.words.new()
        ids, length, total = [self.word_flat], np.zeros(len(new), np.int64), len(self.word_flat)
        begin = np.zeros(len(new), np.int64)
        for plain in (True, False):
            places = np.flatnonzero(simple == plain)
            for a in range(0, len(places), 2000):
                own = places[a : a + 2000]
                found, counts = self._encoded([new[i] for i in own.tolist()], plain)
                ids.append(found)
                length[own] = counts
                begin[own] = total + np.cumsum(counts) - counts
                total += len(found)
        self.word_flat = np.concatenate(ids)
        self.word_begin = np.concatenate([self.word_begin, begin])
        self.word_length = np.concatenate([self.word_length, length])

    def _learn(self) -> None:
        """Ids of the new chunks: plain words in small letters are encoded once for all their spellings."""
        new = self.index.new()
        self.chunks += new
        get_tail, get_word = self.tails.get, self.words.__getitem__
        places, tails = [], []
        for chunk in new:
            tail = get_tail(chunk[-1], -1)
            word = chunk[:-1] if tail >= 0 else chunk
            if word.isalpha() and (word.isascii() or _plain(word)):
                word = word.lower()
            else:
                word, tail = chunk, _NOT_PLAIN
            places.append(get_word(word))
            tails.append(tail)
        place, tail = np.array(places, np.int64), np.array(tails, np.int64)
        simple = np.zeros(len(self.words), bool)  # small letters of a plain word are plain, other chunks are words as they are
        simple[place] = tail != _NOT_PLAIN
        self._learn_words(simple[self.words.noted :])
        begin, length = self.word_begin[place], self.word_length[place]
        more = length + (tail >= 0)
        ids = np.empty(more.sum(), np.uint32)
        ends = np.cumsum(more)
        mark = np.zeros(len(ids), bool)
        mark[ends[tail >= 0] - 1] = True
        ids[mark] = tail[tail >= 0]
        ids[~mark] = _gather(self.word_flat, begin, length)[0]
        self.flat = np.concatenate([self.flat, ids])
        self.ends = np.concatenate([self.ends, self.ends[-1] + ends])

    def places(self, texts: list[str]) -> list[np.ndarray]:
        """The place in ``chunks`` of each chunk of each text."""
        if len(self.index) > (self.remembered or REMEMBERED):
            self._forget()
        get, places = self.index.__getitem__, []
        for text in texts:
            chunks = _CHUNK.findall(text) if _UNSAFE.search(text) else text.split()
            places.append(np.fromiter(map(get, chunks), np.int64, len(chunks)))
        if len(self.index) > self.index.noted:
            self._learn()
        return places

    def gather(self, places: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the texts in one array, and where each text's ids begin (one more entry than texts)."""
        place = np.concatenate(places) if places else np.empty(0, np.int64)
        begin = self.ends[place]
        ids, upto = _gather(self.flat, begin, self.ends[place + 1] - begin)
        return ids, upto[np.cumsum([0, *map(len, places)])]

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        return self.gather(self.places(texts))


def chunk_cache(definition: str, remembered: int | None = None) -> ChunkCache:
    """The worker's cache for this tokenizer file's content; it lives as long as the worker, or until ``drop_caches``."""
    key = hash(definition)
    if key not in _caches:
        _caches.clear()
        _caches[key] = ChunkCache(definition)
    _caches[key].remembered = remembered
    return _caches[key]


def drop_caches() -> None:
    """For tasks that encode nothing and may follow on the same worker."""
    _caches.clear()


def slices(texts: list[str], size: int = 1 << 22):
    """(a, b): runs of texts of about ``size`` characters; a longer text is alone."""
    a, total = 0, 0
    for i, text in enumerate(texts):
        if i > a and total + len(text) > size:
            yield a, i
            a, total = i, 0
        total += len(text)
    if a < len(texts):
        yield a, len(texts)
