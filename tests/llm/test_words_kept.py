"""Words that come again are encoded once, though a worker forgets the rest."""

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

from tidemark.llm import tokens

PATH = public_tokenizers.path("word_bpe_49k.json")


def test_words_that_come_again(monkeypatch):
    monkeypatch.setattr(tokens, "_KEEP", 100)
    encoded = []
    encode = tokens.WordTokens._encode_word
    monkeypatch.setattr(tokens.WordTokens, "_encode_word", lambda self, word: encoded.append(word) or encode(self, word))
    words, whole = tokens.WordTokens(PATH, 2), Tokenizer.from_file(PATH)
    common = ["often", "words", "ünd", "don't"]
    for k in range(8):
        texts = [" ".join(common + [f"x{k}y{i}" for i in range(70)]), "", " ".join(common)]
        raw = [t.encode() for t in texts]
        ids, ends = words(np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0, *map(len, raw)]))
        want = [whole.encode(t, add_special_tokens=False).ids + [2] for t in texts]
        assert [x.tolist() for x in np.split(ids, ends[:-1])] == want
    assert all(encoded.count(w) == 1 for w in common)
    assert len(words._words) + len(words._words_before) < 8 * 70
