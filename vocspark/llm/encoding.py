"""Encoding with public tokenizers: whole texts, each distinct pre-token encoded once per worker.

Texts of common Latin characters are cut before each run of spaces, where both vocabularies'
split patterns always cut, and each such unit is looked up; any other text (other scripts,
control characters, special strings) is given whole to the library. Tests hold both ways
against the library.

Many texts are cut side by side: their units are one Arrow array over the texts' own bytes, so that only the
distinct ones of some megabytes become Python strings.
"""

from __future__ import annotations

import os
import re
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex

BYTE_VOCABULARY = "byte_bpe_50k.json"
WORD_VOCABULARY = "word_bpe_49k.json"

# The split patterns stated in the two vocabulary files.
BYTE_PATTERN = (
    r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")
WORD_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"

_UNCOMMON = re.compile("[^\t\n\r\x20-\x7e¡-ɏ‐-‧]|<\\|")
_UNCOMMON_RE2 = r"[^\t\n\r\x20-\x7e\x{a1}-\x{24f}\x{2010}-\x{2027}]|<\|"
# a letter after marks could belong to one of the patterns' endings ('s), so marks end the unit
_WORD_AND_MARKS = r"^(?P<word> ?[A-Za-z]+)(?P<marks>[!-/:-@\[-`{-~]*)$"
_UNIT = re.compile(r"\s*\S+|\s+")
_REMEMBERED = 1 << 20
_BYTES_AT_ONCE = 1 << 23

# the letters that byte-level vocabularies write for bytes: printable ones stand for themselves,
# all others count up from 256
_PRINTABLE = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
_BYTE_LETTERS = {
    b: 256 + i for i, b in enumerate(b for b in range(256) if b not in _PRINTABLE)}


class PieceEncoder:
    """Ids of texts, by remembered pieces."""

    def __init__(self, vocabulary: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import public_tokenizers
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(public_tokenizers.path(vocabulary))
        self.model = self.library.model
        self.lower = vocabulary == WORD_VOCABULARY
        self.pattern = regex.compile(WORD_PATTERN if self.lower else BYTE_PATTERN)
        # units met before and, in the same order, their ids
        self.units, self.coded = pa.array([], pa.string()), pa.array([], pa.list_(pa.uint32()))

    def whole(self, text: str) -> list[int]:
        return self.library.encode(text, add_special_tokens=False).ids

    def pieces(self, text: str) -> list[str] | None:
        """The pre-tokens of `text`, or None where the library has to see it whole."""
        if _UNCOMMON.search(text):
            return None
        return self.pattern.findall(text.lower() if self.lower else text)

    def ids(self, text: str | None) -> np.ndarray:
        text = text or ""
        if _UNCOMMON.search(text):
            return np.array(self.whole(text), np.uint32)
        return np.array([i for u in _UNIT.findall(text) for i in self._coded(u)], np.uint32)

    def all_ids(self, texts: pa.Array) -> Iterator[np.ndarray]:
        """`ids` of every text, in order."""
        texts = texts.cast(pa.string()).fill_null("")
        ends = np.cumsum(pc.binary_length(texts).to_numpy(), dtype=np.int64)
        start = 0
        while start < len(texts):
            before = ends[start - 1] if start else 0
            stop = max(start + 1, int(np.searchsorted(ends, before + _BYTES_AT_ONCE, "right")))
            yield from self._side_by_side(texts.slice(start, stop - start))
            start = stop

    def _side_by_side(self, texts: pa.StringArray) -> Iterator[np.ndarray]:
        uncommon = pc.match_substring_regex(texts, _UNCOMMON_RE2)
        common = pc.if_else(uncommon, "", texts)
        size = pc.binary_length(common).to_numpy().astype(np.int64)
        stops = np.cumsum(size)
        units, firsts = _cut(common, stops - size)
        numbered = units.dictionary_encode()
        ids = self._looked_up(numbered.dictionary).take(numbered.indices)
        flat = ids.flatten().to_numpy()
        reached = ids.offsets.to_numpy()
        # a text's units are those that start in it
        first, last = (reached[np.searchsorted(firsts, at)].tolist() for at in (stops - size, stops))
        whole = uncommon.to_numpy(zero_copy_only=False).tolist()
        for i, (a, b) in enumerate(zip(first, last)):
            yield np.array(self.whole(texts[i].as_py()), np.uint32) if whole[i] else flat[a:b]

    def _looked_up(self, units: pa.StringArray) -> pa.ListArray:
        """Ids of distinct units: those not met before are coded and remembered."""
        place = pc.index_in(units, self.units)
        fresh = units.filter(place.is_null())
        if len(fresh):
            self.units = pa.concat_arrays([self.units, fresh])
            self.coded = pa.concat_arrays([self.coded, self._all_coded(fresh)])
            at = place.fill_null(-1).to_numpy().copy()
            at[at < 0] = np.arange(len(self.units) - len(fresh), len(self.units))
            place = pa.array(at)
        found = self.coded.take(place)
        if len(self.units) > _REMEMBERED:
            self.units, self.coded = units, found
        return found

    def _all_coded(self, units: pa.StringArray) -> pa.ListArray:
        """`_coded` of each unit; a word before marks is coded once, whatever marks follow it."""
        parts = pc.extract_regex(units, _WORD_AND_MARKS)
        plain = parts.is_valid().to_numpy(zero_copy_only=False)
        words, marks = (pc.struct_field(parts, name).filter(plain).dictionary_encode() for name in ("word", "marks"))
        if self.lower:
            letters = pc.ascii_lower(pc.ascii_trim_whitespace(words.dictionary))
        else:
            letters = pc.replace_substring(words.dictionary, " ", "\u0120")
        texts = letters.to_pylist() + marks.dictionary.to_pylist()
        # a unit is its word and its marks; any other one is coded by itself, and has an empty second part
        others = [self._coded(u) for u in units.filter(~plain).to_pylist()]
        ids = _lists([[t.id for t in self.model.tokenize(x)] for x in texts] + others + [[]])
        first = np.empty(2 * len(units), np.int64).reshape(-1, 2)
        first[plain, 0] = words.indices.to_numpy()
        first[plain, 1] = marks.indices.to_numpy().astype(np.int64) + len(letters)
        first[~plain, 0] = len(texts) + np.arange(len(others))
        first[~plain, 1] = len(ids) - 1
        halves = ids.take(pa.array(first.ravel()))
        return pa.ListArray.from_arrays(pa.array(halves.offsets.to_numpy()[::2]), halves.flatten())

    def _coded(self, unit: str) -> list[int]:
        """Ids of a unit's pre-tokens from the library's merge model."""
        # the word vocabulary drops spaces and lower-cases; no pre-token of it spans a space
        pieces = self.pattern.findall(unit.lower() if self.lower else unit)
        mapped = (p.encode().decode("latin-1").translate(_BYTE_LETTERS) for p in pieces)
        return [t.id for p in mapped for t in self.model.tokenize(p)]


def _lists(lists: list[list[int]]) -> pa.ListArray:
    ends = np.cumsum([0, *map(len, lists)], dtype=np.int32)
    return pa.ListArray.from_arrays(ends, np.fromiter(chain.from_iterable(lists), np.uint32, int(ends[-1])))


def _cut(texts: pa.StringArray, starts: np.ndarray) -> tuple[pa.StringArray, np.ndarray]:
    """The texts' units side by side, and the byte at which each starts; `starts` are those of the texts."""
    offsets = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset:texts.offset + len(texts) + 1]
    held = texts.buffers()[2]
    data = np.frombuffer(held, np.uint8)[offsets[0]:offsets[-1]] if held else np.empty(0, np.uint8)
    # common texts have no other bytes up to 32 than their spaces, tabs and line ends
    space = data <= 32
    begins = space.copy()
    begins[1:] &= ~space[:-1]
    begins[starts[starts < len(data)]] = True
    firsts = np.flatnonzero(begins)
    bounds = np.append(firsts, len(data)).astype(np.int32)
    return pa.StringArray.from_buffers(len(firsts), pa.py_buffer(bounds), pa.py_buffer(data)), firsts


@lru_cache(maxsize=1)
def worker_encoder(vocabulary: str) -> PieceEncoder:
    """The worker's encoder: it serves task after task and remembers what it met in earlier ones."""
    return PieceEncoder(vocabulary)
