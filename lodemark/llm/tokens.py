"""Units of text that a byte-level BPE encodes apart from each other, and a cached encoder for them.

The split pattern of the rank files starts a new match at every plain space that stands between two
characters that are not white space: nothing before it can reach over it (a white-space run of one that
is followed by other text matches neither white-space branch first), and the match after it begins with
it. Cutting there leaves all ids as they are. Everything else stays together in one unit.
"""

from __future__ import annotations

import re
from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from .common import Numbered, ragged_take

_CUT = re.compile(r"(?<=\S) (?=\S)")
#: A text where every plain space is such a place splits at each of them.
_ODD = r"^\s|\s$|\s\s"
#: White space that RE2's class lacks, and the separators that only some engines count.
_WIDE = r"[\x0b\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"


def units_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """Codes of the units of each text, offsets (one more than texts) and the units (few stand there twice).

    Concatenated, the units of a text are the text.
    """
    texts = pc.fill_null(texts, "")
    odd = pc.or_(pc.match_substring_regex(texts, _ODD), pc.match_substring_regex(texts, _WIDE)).to_numpy(zero_copy_only=False)
    plain = pc.split_pattern(pc.if_else(pa.array(~odd), texts, ""), " ")
    flat, offsets = plain.flatten(), plain.offsets.to_numpy().astype(np.int64)
    offsets = offsets - offsets[0]
    first = np.zeros(len(flat), bool)
    first[offsets[:-1]] = True
    coded = flat.dictionary_encode()
    codes = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    base = coded.dictionary
    # First units have no space: their codes are the even ones, the others' the odd ones.
    codes = 2 * codes + ~first
    there = np.bincount(codes, minlength=2 * len(base)) > 0
    used, codes = np.flatnonzero(there), (np.cumsum(there) - 1)[codes]
    spaced = pc.binary_join_element_wise(pa.array(np.where(used & 1, " ", ""), pa.string()), base.take(pa.array(used >> 1)), "")
    if not odd.any():
        return codes, offsets, spaced
    parts, sizes, own = [codes[i:j] for i, j in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)], np.diff(offsets), []
    where: dict[str, int] = {}
    for k in np.flatnonzero(odd).tolist():
        text = texts[k].as_py()
        cuts = [m.start() for m in _CUT.finditer(text)]
        own = [text[i:j] for i, j in zip([0, *cuts], [*cuts, len(text)], strict=True)]
        parts[k] = np.fromiter((where.setdefault(u, len(spaced) + len(where)) for u in own), np.int64, len(own))
        sizes[k] = len(own)
    return np.concatenate(parts), np.concatenate([[0], np.cumsum(sizes)]), pa.concat_arrays([spaced, pa.array(list(where), pa.string())])


#: A unit of letters and marks is at most five matches of the pattern, each encoded by itself.
_L, _P = "[A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff]+", "[.,!?;:&%$#*|()]+"
_SIMPLE = re.compile(f"( ?{_L})(?:({_P})(?:(\n)({_L})({_P})?)?)?")


def matches_of(unit: str) -> list[str]:
    """The unit's matches of the split pattern, where that is plain to see; else the unit."""
    if unit[1:].isalpha():
        return [unit]
    if unit[-1:] in ".," and unit[1:-1].isalpha() and max(unit) < "\u0250" and (unit[0] == " " or unit[0].isalpha()):
        return [unit[:-1], unit[-1]]
    m = _SIMPLE.fullmatch(unit)
    return [g for g in m.groups() if g] if m else [unit]


class _Ids(Numbered):
    """Ids of strings, as flat arrays."""

    def __init__(self):
        super().__init__()
        self.flat, self.ends = np.zeros(0, np.uint32), np.zeros(1, np.int64)

    def nbytes(self) -> int:
        return self.known.nbytes + self.flat.nbytes + self.ends.nbytes

    def learn(self, strings: pa.Array, flat: np.ndarray, sizes: np.ndarray) -> None:
        self.add(strings)
        self.flat = np.concatenate([self.flat, flat])
        self.ends = np.concatenate([self.ends, self.ends[-1] + np.cumsum(sizes)])

    def of(self, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of the strings of these numbers, and how many each has."""
        sizes = self.ends[which + 1] - self.ends[which]
        return self.flat[ragged_take(self.ends[which], sizes)], sizes


class UnitEncoder:
    """Encodes texts by their distinct units, and those by their distinct matches. The ids of units and of
    matches are kept between calls while they fill at most `most` bytes each."""

    def __init__(self, encode: Callable[[list[str]], list[list[int]]], most: int = 32 << 20):
        self.encode, self.most = encode, most
        self.units, self.matches = _Ids(), _Ids()

    def _learn(self, units: pa.Array) -> None:
        parts = [matches_of(u) for u in units.to_pylist()]
        ends = np.concatenate([[0], np.cumsum(np.fromiter(map(len, parts), np.int64, len(parts)))])
        coded = pa.array([p for own in parts for p in own], pa.string()).dictionary_encode()
        del parts
        pieces, codes = coded.dictionary, coded.indices.to_numpy(zero_copy_only=False)
        if self.matches.nbytes() > self.most:
            self.matches = _Ids()
        which, fresh = self.matches.find(pieces)
        got = self.encode(fresh.to_pylist())
        sizes = np.fromiter(map(len, got), np.int64, len(got))
        self.matches.learn(fresh, np.concatenate([np.zeros(0, np.uint32), *(np.asarray(g, np.uint32) for g in got)]), sizes)
        flat, sizes = self.matches.of(which)
        starts = np.concatenate([[0], np.cumsum(sizes)])
        each = sizes[codes]
        self.units.learn(units, flat[ragged_take(starts[codes], each)], np.diff(np.concatenate([[0], np.cumsum(each)])[ends]))

    def __call__(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids, and offsets of each text in them."""
        codes, offsets, units = units_of(texts)
        if self.units.nbytes() > self.most:
            self.units = _Ids()
        which, fresh = self.units.find(units)
        self._learn(fresh)
        by_unit, sizes = self.units.of(which)
        starts = np.concatenate([[0], np.cumsum(sizes)])
        each = sizes[codes]
        return by_unit[ragged_take(starts[codes], each)], np.concatenate([[0], np.cumsum(each)])[offsets]


def joined(encode: Callable[[list[str]], list[list[int]]], newline: int, size: int = 256, batch: int = 16) -> Callable[[list[str]], list[np.ndarray]]:
    """An encoder of many short strings at once, for libraries that are slow to call: strings without inner
    white space are joined by line breaks, which the pattern keeps to themselves, and their ids cut there.
    The library gets `batch` joined strings a call: it holds much more than the ids of what it encodes."""

    def in_batches(strings: list[str]):
        for i in range(0, len(strings), batch):
            yield from encode(strings[i : i + batch])

    def run(strings: list[str]) -> list[np.ndarray]:
        plain = [k for k, s in enumerate(strings) if s[-1:].strip() and len(s.split()) == 1 and (s[0] == " " or s[0].strip()) and "\n" not in s]
        out: list = [None] * len(strings)
        groups = [plain[i : i + size] for i in range(0, len(plain), size)]
        for group, ids in zip(groups, in_batches(["\n".join(strings[k] for k in g) for g in groups]), strict=True):
            ids = np.asarray(ids, np.uint32)
            cuts = np.flatnonzero(ids == newline)
            for k, i, j in zip(group, [0, *(cuts + 1).tolist()], [*cuts.tolist(), len(ids)], strict=True):
                out[k] = ids[i:j]
        rest = [k for k, x in enumerate(out) if x is None]
        for k, ids in zip(rest, in_batches([strings[k] for k in rest]), strict=True):
            out[k] = np.asarray(ids, np.uint32)
        return out

    return run
