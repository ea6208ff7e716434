import public_tokenizers

from quorum.llm import word_ids


def test_plainness_of_a_word_is_judged_once(monkeypatch):
    """Spellings and marks of a word share its ids; ASCII words need no further judgement."""
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    with open(path) as f:
        cache = word_ids.ChunkCache(f.read())
    judged, plain = [], word_ids._plain
    monkeypatch.setattr(word_ids, "_plain", lambda w: judged.append(w) or plain(w))
    docs = ["Word word, WORD. other?", "", "Größe größe. ÅNGSTRÖM, İstanbul Ÿ ÿ", "a1 a1. don't x.y ... ,", "word other 東京 Σας ΣΑΣ é", "new Word,"]
    whole = Tokenizer.from_file(path)
    for some in (docs[:3], docs[3:], docs):
        ids, begins = cache.encode(some)
        for text, i, j in zip(some, begins[:-1], begins[1:], strict=True):
            assert ids[i:j].tolist() == whole.encode(text, add_special_tokens=False).ids
    assert judged and not any(w.isascii() for w in judged)
