"""Tokens of whole texts with a public word-level BPE vocabulary.

The tokenizer treats white-space separated words one by one, so a block of
texts is cut into words with array operations, each distinct word is encoded
once, and the words' ids are gathered back into documents.  Words are told
apart by a 64-bit hash and kept between blocks of a task.
"""

from __future__ import annotations

import re
from array import array

import numpy as np
from tokenizers import Tokenizer

from tidemark.llm import textops

#: Distinct words, and pieces of words, after which a worker begins another table; it keeps the one before, for words that come again.
_KEEP = 150_000
_PLAIN = re.compile("[!-~À-ÖØ-öø-ÿ]+")
#: Fixed value: the word pattern that the vocabulary file names, for the characters of _PLAIN.
_PIECES = re.compile("'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿ]+|[0-9]|[^a-z0-9ß-öø-ÿ]+")


def _byte_letters() -> list[str]:
    """Byte-level letters: printable bytes stand for themselves, the others follow from 256 up."""
    shown = {*range(ord("!"), ord("~") + 1), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    spare = iter(range(256, 512))
    return [chr(b) if b in shown else chr(next(spare)) for b in range(256)]


class WordTokens:
    """Ids by document: ``ids, ends = WordTokens(path, end_id)(data, at)``."""

    def __init__(self, path: str, end_id: int):
        self._all = Tokenizer.from_file(path)
        self._letters = _byte_letters()
        self._end_id = end_id
        self._words: dict[int, bytes] = {}
        self._pieces: dict[str, bytes] = {}
        self._words_before: dict[int, bytes] = {}
        self._pieces_before: dict[str, bytes] = {}

    def _encode_word(self, word: str) -> bytes:
        """A word's ids as 16-bit numbers."""
        if not _PLAIN.fullmatch(word):
            return array("H", self._all.encode(word, add_special_tokens=False).ids).tobytes()
        out = b""
        for piece in _PIECES.findall(word.lower()):
            ids = self._pieces.get(piece)
            if ids is None:
                ids = self._pieces_before.get(piece)
                if ids is None:
                    shown = piece if piece.isascii() else "".join(self._letters[b] for b in piece.encode())
                    ids = array("H", [t.id for t in self._all.model.tokenize(shown)]).tobytes()
                self._pieces[piece] = ids
            out += ids
        return out

    def __call__(self, data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all rows of a block, each row closed by the end id, and the rows' ends among them."""
        if len(self._words) > _KEEP:
            self._words, self._words_before = {}, self._words
        if len(self._pieces) > _KEEP:
            self._pieces, self._pieces_before = {}, self._pieces
        raw = data.tobytes()
        # the strings of special tokens count only as they are written, so such rows go through the library whole
        special = [r for r in range(len(at) - 1) if b"<|" in raw[at[r] : at[r + 1]]] if b"<|" in raw else []
        low = textops.ascii_lower(data)
        start, end, first = textops.words(low, at)
        hashed = textops.span_hash(textops.prefix_hash(low), start, end)
        distinct, example, back = np.unique(hashed, return_index=True, return_inverse=True)
        text = low.tobytes()
        known = [array("H", [self._end_id]).tobytes()]
        for h, w in zip(distinct.tolist(), example.tolist(), strict=True):
            ids = self._words.get(h)
            if ids is None:
                ids = self._words_before.get(h)
                if ids is None:
                    ids = self._encode_word(text[start[w] : end[w]].decode())
                self._words[h] = ids
            known.append(ids)
        size = np.fromiter(map(len, known), np.int64, len(known)) // 2
        begin = np.cumsum(size) - size
        pool = np.frombuffer(b"".join(known), np.uint16)
        slots = np.insert(back.astype(np.int64) + 1, first[1:], 0)
        count = size[slots]
        ends = np.cumsum(count)
        ids = pool[np.arange(ends[-1] if len(ends) else 0) + np.repeat(begin[slots] - ends + count, count)]
        row_end = ends[first[1:] + np.arange(len(at) - 1)]
        if special:
            rows = np.split(ids, row_end[:-1])
            for r in special:
                own = self._all.encode(raw[at[r] : at[r + 1]].decode(), add_special_tokens=False).ids
                rows[r] = np.asarray([*own, self._end_id], np.uint16)
            ids, row_end = np.concatenate(rows), np.cumsum([len(x) for x in rows])
        return ids, row_end
