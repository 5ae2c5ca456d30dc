"""Token ids of whole texts by the tokenizers library, with the words of a task encoded once.

A text is cut before single spaces, where both vocabularies used here start a new unit whatever stands around, and the
ids of each piece are kept in a bounded cache. The result is that of encoding the whole text at once; the tests compare
the two on texts with all kinds of white space, marks and scripts.
"""

from __future__ import annotations

import json
import re
from array import array
from collections.abc import Iterator
from functools import cache
from itertools import pairwise

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Pieces kept per generation and worker; two generations are alive, about 200 bytes a piece.
GENERATION = 250_000

# Beyond these characters, composition, lower-casing or the classes of letters and white space may differ from what is assumed here.
_USUAL = "\\n !-~\xa1-\xb1\xb4-\xb8\xba\xbb\xbf-\u012f\u0131-\u024f"
_UNUSUAL = re.compile(f"[^{_USUAL}]")
# Texts in which some space or line break does not stand alone between other characters, or with unusual characters.
_ODD = f"[^{_USUAL}]|[ \\n][ \\n]|^ | $"
_WORD_AND_MARKS = re.compile(r"([^\W\d_]+)([^\w\s']+)")
_SURE_CUT = re.compile(r"(?<=\S) (?=\S)")
# Marks the first piece of a text, which no space precedes.
_FIRST = "\0"
#: Bytes of text whose pieces are looked up together.
SLICE_BYTES = 8 << 20


def _byte_letters() -> dict[int, str]:
    """The letter that stands for each byte in byte-level vocabularies: itself if printable, else the next free one from 256."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in printable]
    return {b: chr(b) for b in printable} | {b: chr(256 + i) for i, b in enumerate(others)}


class _Pieces(dict):
    """Ids of pieces; a missing one is looked up in the older generation, then encoded."""

    def __init__(self, encode, limit: int):
        super().__init__()
        self.encode, self.limit, self.older = encode, limit, {}

    def __missing__(self, piece: str) -> bytes:
        ids = self.older.get(piece)
        if ids is None:
            ids = self.encode(piece)
        self[piece] = ids
        return ids

    def trim(self) -> None:
        if len(self) > self.limit:
            self.older = dict(self)
            self.clear()


class TextEncoder:
    """Whole texts to little-endian ids, of 2 bytes if the vocabulary allows, else 4."""

    def __init__(self, path: str, generation: int = GENERATION, slice_bytes: int = SLICE_BYTES):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True  # their strings in a text are ordinary text
        with open(path, encoding="utf-8") as file:
            kind = json.load(file)
        before = kind["pre_tokenizer"] or {}
        byte_level = before.get("type") == "ByteLevel" and before.get("use_regex") and not before.get("add_prefix_space") and not kind["normalizer"]
        split = json.dumps(before)
        drops_space = '"Removed"' in split and r"[\\p{L}]+" in split
        self.mode = "kept" if byte_level else "dropped" if drops_space else "whole"
        self.dtype = np.dtype("<u2" if self.tokenizer.get_vocab_size(with_added_tokens=True) <= 1 << 16 else "<u4")
        self.code = "H" if self.dtype.itemsize == 2 else "I"
        self.slice_bytes = slice_bytes
        self.letters = _byte_letters()
        self.space = self.letters[32]
        self.newline = self._whole("\n")
        self.marks: dict[str, bytes] = {}
        self.pieces = _Pieces(self._kept if self.mode == "kept" else self._dropped, generation)

    def pack(self, ids) -> bytes:
        return array(self.code, ids).tobytes()

    def _whole(self, text: str) -> bytes:
        return self.pack(self.tokenizer.encode(text, add_special_tokens=False).ids)

    def _model(self, unit: str) -> bytes:
        """Ids of one unit of bytes' letters, as the library's own steps before the model would hand it on."""
        return self.pack([t.id for t in self.tokenizer.model.tokenize(unit)])

    def _byte_text(self, word: str) -> str:
        return word if word.isascii() else word.encode().decode("latin-1").translate(self.letters)

    def _marks(self, marks: str) -> bytes:
        ids = self.marks.get(marks)
        if ids is None:
            if len(self.marks) > 10_000:
                self.marks.clear()
            ids = self.marks[marks] = self._whole(marks)
        return ids

    def _kept(self, piece: str) -> bytes:
        """A piece that a space precedes; or one that starts with a line break, or is the first of its text; or, after a space, one of an odd text."""
        mark = piece[:1]
        if mark == " ":
            return self._whole(piece)
        if mark in ("\n", _FIRST):
            before, word, real = mark, piece[1:], ""
        else:
            before, word, real = "", piece, " "
        lead = self.newline if mark == "\n" else b""
        if not word:
            return lead
        if word.isalpha():
            return lead + self._model((self.space if real else "") + self._byte_text(word))
        both = _WORD_AND_MARKS.fullmatch(word)
        if both:
            return self.pieces[before + both[1]] + self._marks(both[2])
        return lead + self._whole(real + word)

    def _dropped(self, piece: str) -> bytes:
        if not piece:
            return b""
        if not _UNUSUAL.search(piece):
            if piece.isalpha():
                return self._model(self._byte_text(piece.lower()))
            both = _WORD_AND_MARKS.fullmatch(piece)
            if both:
                return self.pieces[both[1]] + self._marks(both[2])
        return self._whole(piece)

    def _slow(self, text: str) -> np.ndarray:
        """An odd text: pieces are cut only where one space stands between other characters."""
        if self.mode == "whole":
            return np.frombuffer(self._whole(text), self.dtype)
        first, *rest = _SURE_CUT.split(text)
        return np.frombuffer(self._whole(first) + b"".join([self.pieces[" " + piece] for piece in rest]), self.dtype)

    def encode_all(self, texts: pa.Array) -> Iterator[np.ndarray]:
        """The ids of each text of a string column; none for NULL.

        The pieces of several MB of text are told apart by Arrow, so that each different one is looked up once.
        """
        texts = pc.fill_null(texts, "")
        upto = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False))
        begin = 0
        while begin < len(texts):
            done = upto[begin - 1] if begin else 0
            end = max(begin + 1, int(np.searchsorted(upto, done + self.slice_bytes, "right")))
            yield from self._slice(texts.slice(begin, end - begin))
            begin = end

    def _slice(self, texts: pa.Array) -> Iterator[np.ndarray]:
        self.pieces.trim()
        if self.mode == "whole":
            yield from map(self._slow, texts.to_pylist())
            return
        if self.mode == "dropped":
            odd: list[int] = []
            cut = pc.replace_substring(texts, "\n", " ")
        else:
            strange = pc.match_substring_regex(texts, _ODD)
            odd = np.flatnonzero(strange.to_numpy(zero_copy_only=False)).tolist()
            usual = pc.if_else(strange, "", texts) if odd else texts
            cut = pc.binary_join_element_wise(_FIRST, pc.replace_substring(usual, "\n", " \n"), "")
        words = pc.split_pattern(cut, " ")
        coded = words.flatten().dictionary_encode()
        at = coded.indices.to_numpy(zero_copy_only=False)
        found = [self.pieces[piece] for piece in coded.dictionary.to_pylist()]
        lengths = np.fromiter(map(len, found), np.int64, len(found)) // self.dtype.itemsize
        ids = np.frombuffer(b"".join(found), self.dtype)
        starts = np.cumsum(lengths) - lengths
        each = lengths[at]
        ends = np.cumsum(each)
        place = np.repeat((starts[at] - (ends - each)).astype(np.int32), each)
        place += np.arange(len(place), dtype=np.int32)
        flat = ids[place]
        offsets = words.offsets.to_numpy() - words.offsets[0].as_py()
        edges = np.concatenate([[0], ends])[offsets].tolist()
        strange_at = set(odd)
        for i, (a, b) in enumerate(pairwise(edges)):
            yield self._slow(texts[i].as_py()) if i in strange_at else flat[a:b]

    def encode(self, text: str | None) -> np.ndarray:
        """The ids of one text; none for NULL."""
        return next(self.encode_all(pa.array([text], pa.string())))


@cache
def encoder(path: str, generation: int = GENERATION, slice_bytes: int = SLICE_BYTES) -> TextEncoder:
    """One encoder per file and worker process; its cache serves all tasks of the worker."""
    return TextEncoder(path, generation, slice_bytes)


def default_path(name: str) -> str:
    """Path of a public vocabulary file on this machine."""
    import public_tokenizers

    return public_tokenizers.path(name)


def cut_points(n: int, length: int) -> list[tuple[int, int]]:
    """(start, end) of the pieces of ``n`` ids: full pieces of ``length``, the remainder first."""
    first = n % length
    edges = [0, *range(first or length, n + 1, length)]
    return list(pairwise(edges)) if n else [(0, 0)]
