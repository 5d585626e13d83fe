"""Token ids of whole texts by a byte-level BPE of the ``tokenizers`` library.

A byte-level BPE cuts a text into pieces (words with the blank before them, numbers, marks, blanks)
and encodes each on its own.  The distinct words of a batch of texts are found first; each is cut into
pieces and encoded once by the library's model, pieces and words being kept up to a number of bytes, and
the ids of the texts are gathered from those of their words.  Before that, texts that hold one of the
tokenizer's added tokens (such as ``<|endoftext|>``), which have ids of their own, are split at them, as
the library does.
"""

from __future__ import annotations

import re
import struct

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from tokenizers import Tokenizer

#: Bytes (about) of the pieces, and of the words, that a worker keeps with their ids.
CACHE_BYTES = 32 << 20
#: A blank between white space and white space (or the end) belongs to a run of blanks, of which
#: only the last is cut off by the pattern; texts that have one are not cut at blanks.
_RUN = re.compile(r"\s (?:\s|$)")
_SPACE = r"[\s\x0b\x1c-\x1f\x85\p{Z}]"
_RUNS = rf"{_SPACE} (?:{_SPACE}|$)|  "


def _byte_letters() -> dict[int, str]:
    """The printable letter that stands for each byte in the vocabulary: the byte itself if it is a
    visible Latin-1 character, otherwise the next letter from 256."""
    visible = {*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)}
    hidden = [b for b in range(256) if b not in visible]
    return {b: chr(b) for b in visible} | {b: chr(256 + i) for i, b in enumerate(hidden)}


class _Kept(dict):
    """A dictionary that makes missing values and keeps the first ``CACHE_BYTES`` of them."""

    def __init__(self, make):
        super().__init__()
        self._make = make
        self._left = CACHE_BYTES

    def __missing__(self, key):
        out = self._make(key)
        if self._left > 0:
            self[key] = out
            self._left -= 200 + len(key) + len(out)
        return out


class Encoder:
    """``ids(text)``: the bytes of the ids as little-endian unsigned 32-bit integers."""

    _made: dict[str, Encoder] = {}

    def __init__(self, path: str):
        import public_tokenizers

        self._tokenizer = Tokenizer.from_file(path)
        self._model = self._tokenizer.model
        self._cut = regex.compile(public_tokenizers.PATTERN)
        self._letters = _byte_letters()
        self._blank = self._letters[ord(" ")]
        self._pieces = _Kept(self._piece)
        self._words = _Kept(lambda word: self._cut_up(" " + word))
        added = self._tokenizer.get_added_tokens_decoder()
        self._added = {t.content: np.array([i], dtype="<u4").tobytes() for i, t in added.items()}
        # the longest first, as the library finds them
        names = sorted(self._added, key=len, reverse=True)
        self._at_added = re.compile("|".join(map(re.escape, names))) if names else None
        #: Whether added tokens are literal: they take no blanks beside them and need no border.
        self._literal = not any(t.lstrip or t.rstrip or t.single_word or t.normalized for t in added.values())

    @classmethod
    def of(cls, path: str) -> Encoder:
        """One encoder for each file and worker."""
        if path not in cls._made:
            cls._made[path] = cls(path)
        return cls._made[path]

    def _piece(self, piece: str) -> bytes:
        if piece.isascii() and piece[1:].isalnum() and (piece[0] == " " or piece[0].isalnum()):
            letters = piece.replace(" ", self._blank)  # what is visible stands for itself
        else:
            letters = piece.encode().decode("latin-1").translate(self._letters)
        ids = [t.id for t in self._model.tokenize(letters)]
        return struct.pack(f"<{len(ids)}I", *ids)

    def _cut_up(self, text: str) -> bytes:
        pieces = self._pieces
        return b"".join([pieces[p] for p in self._cut.findall(text)])

    def _word(self, word: str) -> bytes:
        """The ids of a word behind a blank.  Letters are one piece, and so is one mark behind them."""
        if word.isalpha():
            return self._pieces[" " + word]
        if word[:-1].isalpha() and word[-1] in ".,;:!?":
            return self._pieces[" " + word[:-1]] + self._pieces[word[-1]]
        return self._words[word]

    def batch(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts laid end to end, and the number of each text's.  Null is the empty text."""
        texts = pc.fill_null(texts.cast(pa.string()), "")
        odd = pc.match_substring_regex(texts, _RUNS)
        for name in self._added:
            odd = pc.or_(odd, pc.match_substring(texts, name))
        alone = np.flatnonzero(np.asarray(odd))
        words = pc.split_pattern(pc.if_else(odd, "", texts), " ")
        flat = words.flatten().dictionary_encode()
        vocab = flat.dictionary.to_pylist()
        codes = np.array(flat.indices, dtype=np.int64)
        offsets = np.asarray(words.offsets, dtype=np.int64) - words.offsets[0].as_py()
        # a text's first word has no blank before it; texts that are not cut count as one word
        used = np.ones(len(codes), dtype=bool)
        used[offsets[:-1]] = False
        needed = np.bincount(codes[used], minlength=len(vocab)) > 0
        known = [self._word(w) if x else b"" for w, x in zip(vocab, needed.tolist(), strict=True)]
        firsts = [self._cut_up(vocab[c]) for c in codes[offsets[:-1]].tolist()]
        for i in alone.tolist():
            firsts[i] = self.ids(texts[i].as_py())
        codes[offsets[:-1]] = len(known) + np.arange(len(firsts))
        known += firsts
        sizes = np.fromiter(map(len, known), np.int64, len(known)) // 4
        store = np.frombuffer(b"".join(known), dtype="<u4")
        starts = np.cumsum(sizes) - sizes
        each = sizes[codes]
        ends = np.cumsum(each)
        at = np.repeat(starts[codes] - (ends - each), each)
        at += np.arange(len(at))
        return store[at], np.diff(np.concatenate([[0], ends])[offsets])

    def ids(self, text: str) -> bytes:
        if self._at_added is None or not self._at_added.search(text):
            return self._span(text)
        if not self._literal:
            return np.array(self._tokenizer.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()
        out, at = [], 0
        for found in self._at_added.finditer(text):
            out += [self._span(text[at:found.start()]), self._added[found.group()]]
            at = found.end()
        return b"".join([*out, self._span(text[at:])])

    def _span(self, text: str) -> bytes:
        if "  " in text or _RUN.search(text):
            return self._cut_up(text)
        words = text.split(" ")
        return self._cut_up(words[0]) + b"".join(map(self._word, words[1:]))


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")
