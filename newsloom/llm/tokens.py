"""Token ids of many texts at a time with a public tokenizer that drops white space.

Texts are cut at ASCII blanks and words become dictionary codes, both on Arrow arrays. Only
words not met before go to the tokenizer; the ids of a text are gathered from those of its
words. This needs a tokenizer for which blanks only separate, such as one with word ends.
"""

from __future__ import annotations

import string
import unicodedata
from array import array

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from tokenizers import Tokenizer

#: Words remembered by a task. More only cost time again, as all is forgotten then.
REMEMBERED = 600_000
#: UTF-8 bytes of text handled at a time.
CHUNK_BYTES = 4 << 20


def _byte_letters() -> list[str]:
    """The printable stand-in of every byte in byte-level vocabularies: itself where it is
    printable, else the next free character from 256 on."""
    letters, free = [], 256
    for b in range(256):
        if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255:
            letters.append(chr(b))
        else:
            letters.append(chr(free))
            free += 1
    return letters


class WordEncoder:
    def __init__(self, description: str):
        self.tokenizer = Tokenizer.from_str(description)
        self.model = self.tokenizer.model
        self.letters = _byte_letters()
        self.known: dict[str, bytes] = {}  # word -> its ids, 4 bytes each

    def _plain(self, word: str) -> bool:
        """Letters whose lower case and normal form hold no surprise."""
        return word.isalpha() and (
            word.isascii() or (max(word) < "ɐ" and "İ" not in word and unicodedata.is_normalized("NFC", word))
        )

    def _letters_only(self, word: str) -> list[int]:
        word = word.lower()
        if not word.isascii():
            word = "".join(map(self.letters.__getitem__, word.encode("utf-8")))
        return [t.id for t in self.model.tokenize(word)]

    def _new(self, word: str) -> bytes:
        core = word.rstrip(string.punctuation)
        tail = word[len(core) :]
        if self._plain(core) and "'" not in tail:
            ids = self._letters_only(core)
            if tail:
                return array("I", ids).tobytes() + self.of_word(tail)
        else:
            ids = self.tokenizer.encode(word, add_special_tokens=False).ids
        return array("I", ids).tobytes()

    def of_word(self, word: str) -> bytes:
        ids = self.known.get(word)
        if ids is None:
            ids = self.known[word] = self._new(word)
        return ids

    def of_words(self, words: list[str]) -> list[bytes]:
        """Ids of distinct words. Words of ASCII letters, which are most of the new ones, take a
        short way of their own."""
        if len(self.known) >= REMEMBERED:
            self.known.clear()
        known, tokenize, marks = self.known, self.model.tokenize, string.punctuation
        out = []
        for word in words:
            ids = known.get(word)
            if ids is None:
                core = word if word.isalpha() else word.rstrip(marks)
                if core.isascii() and core.isalpha() and "'" not in word:
                    ids = array("I", [t.id for t in tokenize(core.lower())]).tobytes()
                    if len(core) < len(word):
                        ids += self.of_word(word[len(core) :])
                else:
                    ids = self._new(word)
                known[word] = ids
            out.append(ids)
        return out

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(ids of all texts, where each text's ids begin and, last, end, smallest word hash
        of each text). A null text is empty; no words have the largest hash."""
        lists = pc.ascii_split_whitespace(pc.ascii_trim_whitespace(pc.fill_null(texts, "")))
        coded = lists.flatten().dictionary_encode()
        words = coded.dictionary.to_pylist()
        codes = coded.indices.to_numpy()
        bounds = lists.offsets.to_numpy() - lists.offsets[0].as_py()
        ids = self.of_words(words)
        # places fit 32 bits, as a chunk has far fewer ids
        each = np.fromiter(map(len, ids), np.int32, len(ids)) // 4
        flat = np.frombuffer(b"".join(ids), np.uint32)
        begins = np.cumsum(each, dtype=np.int32) - each
        lengths = each[codes]
        ends = np.cumsum(lengths, dtype=np.int32)
        places = np.repeat(begins[codes] - (ends - lengths), lengths)
        places += np.arange(len(places), dtype=np.int32)
        hashes = np.fromiter(
            (xxhash.xxh64_intdigest(w) if w else (1 << 64) - 1 for w in words), np.uint64, len(words)
        )
        least = np.minimum.reduceat(hashes[codes], bounds[:-1]) if len(texts) else hashes[:0]
        return flat[places], np.concatenate(([0], ends))[bounds], least


def chunks(batch: pa.RecordBatch, text: int) -> list[pa.RecordBatch]:
    """Slices of a batch of at most CHUNK_BYTES of text, or one row."""
    sizes = pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False)
    number = (np.cumsum(sizes) - 1) // CHUNK_BYTES
    cuts = np.flatnonzero(np.diff(number, prepend=-1 if len(number) else 0)).tolist() + [batch.num_rows]
    if cuts[0]:
        cuts = [0, *cuts]
    return [batch.slice(a, b - a) for a, b in zip(cuts, cuts[1:]) if b > a]
