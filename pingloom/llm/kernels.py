"""Vectorised text kernels used inside Arrow tasks.

All functions take the raw Arrow layout of a string column: one ``uint8`` buffer with the
concatenated UTF-8 texts and an ``int64`` offset array (document ``i`` is
``data[offs[i]:offs[i + 1]]``). They work on slices of a few MB, so the memory of a task
does not depend on the batch size Spark picks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Bytes of text handled at once (a longer document is handled alone).
SLICE_BYTES = 1 << 20

_rng = np.random.Generator(np.random.PCG64(20240131))
_BYTE = _rng.integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_PLACES = 64
_AT = _rng.integers(0, 1 << 64, _PLACES * 256, dtype=np.uint64)
_R = np.uint64(0x9E3779B97F4A7C15)
_R_INV = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
SPACE = np.zeros(256, dtype=bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_pow: dict[str, np.ndarray] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    x = x ^ (x >> np.uint64(31))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(29)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(32)
    return x


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_pow.get("r", ())) < n:
        size = 1 << max(16, int(n - 1).bit_length())
        for name, base in (("r", _R), ("i", _R_INV)):
            a = np.full(size, base, dtype=np.uint64)
            a[0] = 1
            _pow[name] = np.cumprod(a, dtype=np.uint64)
    return _pow["r"][:n], _pow["i"][:n]


class Sums:
    """Prefix sums of a polynomial over a token array: the hash of any range in O(1)."""

    def __init__(self, tokens: np.ndarray):
        power, self.inverse = _powers(len(tokens) + 1)
        self.pre = np.zeros(len(tokens) + 1, dtype=np.uint64)
        np.cumsum(tokens * power[:-1], out=self.pre[1:])

    def ranges(self, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
        """Mixed hash of tokens[start:stop] for each pair; equal ranges hash alike."""
        x = (self.pre[stop] - self.pre[start]) * self.inverse[start]
        return mix(x + (stop - start).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))

    def fixed(self, width: int) -> np.ndarray:
        """Mixed hash of every window of ``width`` tokens."""
        n = len(self.pre) - width
        return mix((self.pre[width:] - self.pre[:n]) * self.inverse[:n])


def byte_tokens(data: np.ndarray) -> np.ndarray:
    return _BYTE[data]


def slices(column: pa.Array, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets from 0) for runs of rows of about ``limit`` bytes. Null: empty."""
    if pa.types.is_string_view(column.type):
        column = column.cast(pa.string())
    n = len(column)
    if not n:
        return
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, values = column.buffers()
    offs = np.frombuffer(offsets, dtype=np.int64 if wide else np.int32)[column.offset : column.offset + n + 1].astype(np.int64)
    data = np.frombuffer(values, dtype=np.uint8) if values is not None else np.zeros(0, np.uint8)
    if column.null_count:  # a null's bytes, if there are any, are left out
        dead = np.asarray(column.is_null())
        if (np.diff(offs)[dead] > 0).any():
            column = column.fill_null("")
            yield from slices(column, limit)
            return
    at = 0
    while at < n:
        end = int(np.searchsorted(offs, offs[at] + limit, "right")) - 1
        end = min(n, max(at + 1, end))
        yield at, end, data[offs[at] : offs[end]], offs[at : end + 1] - offs[at]
        at = end


def lowered(data: np.ndarray) -> np.ndarray:
    """A-Z to lower case, nothing else."""
    return _LOWER[data]


def words(data: np.ndarray, offs: np.ndarray, between: np.ndarray = SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end bytes of every word, and the index of each document's first word (n + 1).

    ``between`` marks the bytes that separate words; the default gives words ``[^\\x20\\x09-\\x0D]+``.
    """
    n = len(data)
    word = ~between[data]
    before = np.zeros(n, dtype=bool)
    before[1:] = word[:-1]
    after = np.zeros(n, dtype=bool)
    after[:-1] = word[1:]
    first, last = offs[:-1], offs[1:] - 1
    some = offs[1:] > first
    before[first[some]] = False
    after[last[some]] = False
    start = np.flatnonzero(word & ~before)
    end = np.flatnonzero(word & ~after) + 1
    return start, end, np.searchsorted(start, offs)


def word_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hash of the bytes start..end of each word (ascending, disjoint): each byte is mixed with its place before they are summed.

    A polynomial modulo 2^64 would give some pairs of long words (Thue-Morse sequences) the same sum.
    """
    if not len(start):
        return np.zeros(0, np.uint64)
    first = int(start[0])
    place = np.arange(first, len(data)) - np.repeat(start, np.diff(np.append(start, len(data))))
    spot = (np.minimum(place, _PLACES - 1) << 8) | data[first:]
    value = _AT[spot]
    far = np.flatnonzero(place >= _PLACES - 1)
    if len(far):
        value[far] = mix(_BYTE[data[first + far]] + place[far].astype(np.uint64) * _R)
    total = np.zeros(len(value) + 1, dtype=np.uint64)
    np.cumsum(value, out=total[1:])
    return mix(total[end - first] - total[start - first] + (end - start).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def sliding_argmin(values: np.ndarray, width: int) -> np.ndarray:
    """Position of the smallest of each ``width`` neighbours; the leftmost among (40-bit) ties."""
    n = len(values) - width + 1
    if n <= 0:
        return np.zeros(0, dtype=np.int64)
    if len(values) >= 1 << 24:  # the position no longer fits beside the hash: two passes
        low = np.lib.stride_tricks.sliding_window_view(values >> np.uint64(24), width)
        return np.concatenate([low[a : a + 65536].argmin(axis=1) + np.arange(a, min(n, a + 65536)) for a in range(0, n, 65536)])
    least = (values & ~np.uint64((1 << 24) - 1)) | np.arange(len(values), dtype=np.uint64)
    step = 1
    while step * 2 <= width:
        least = np.minimum(least[:-step], least[step:])
        step *= 2
    if step < width:
        least = np.minimum(least[: len(least) - (width - step)], least[width - step :])
    return (least[:n] & np.uint64((1 << 24) - 1)).astype(np.int64)


def anchors(tokens: np.ndarray, offs: np.ndarray, window: int, gram: int) -> dict[str, np.ndarray]:
    """Cut the windows of each document into runs that share their smallest gram.

    Every window of ``window`` tokens picks the smallest hash among its grams, so equal windows pick the same
    gram at the same place. Gives one entry for each run: ``gram`` (hash of the anchor), ``doc`` (index), ``lo``
    (first window start within the document), ``span`` (number of windows), ``off`` (anchor - lo) and ``at`` (the
    anchor's place among ``tokens``).
    """
    n = len(tokens)
    none = {k: np.zeros(0, np.uint64 if k == "gram" else np.int64) for k in ("gram", "doc", "lo", "span", "off", "at")}
    if n < window:
        return none
    grams = Sums(tokens).fixed(gram)
    pick = sliding_argmin(grams, window - gram + 1)
    lens = np.diff(offs)
    starts = np.arange(n - window + 1)
    ok = np.repeat(offs[1:], lens)[: n - window + 1] - starts >= window
    starts, pick = starts[ok], pick[ok]
    if not len(starts):
        return none
    new = np.ones(len(starts), dtype=bool)
    new[1:] = (pick[1:] != pick[:-1]) | (starts[1:] != starts[:-1] + 1)
    at = np.flatnonzero(new)
    lo, anchor = starts[at], pick[at]
    span = np.diff(np.append(at, len(starts)))
    doc = np.searchsorted(offs, lo, "right") - 1
    return {"gram": grams[anchor], "doc": doc, "lo": lo - offs[doc], "span": span, "off": anchor - lo, "at": anchor}



class Words:
    """The words of some texts, and what tells them apart: a hash of all bytes, and the first eight bytes as they are."""

    def __init__(self, data: np.ndarray, offs: np.ndarray, between: np.ndarray = SPACE):
        self.data = data
        self.start, self.end, self.at = words(data, offs, between)
        self.hash = word_hashes(data, self.start, self.end)
        padded = np.concatenate([data, np.zeros(8, np.uint8)])
        eight = np.ndarray(len(data) + 1, "<u8", padded.data, 0, (1,)) if len(data) else np.zeros(1, "<u8")
        self.first = eight[self.start] & _FIRST[np.minimum(self.end - self.start, 8)]

    def doc(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.at) - 1), np.diff(self.at))

    def take(self, which: np.ndarray) -> pa.Array:
        """The bytes of some of the words."""
        size = self.end[which] - self.start[which]
        ends = np.zeros(len(which) + 1, dtype=np.int64)
        np.cumsum(size, out=ends[1:])
        spot = np.arange(ends[-1]) + np.repeat(self.start[which] - ends[:-1], size)
        return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(which), [None, pa.py_buffer(ends), pa.py_buffer(self.data[spot])])


_FIRST = np.array([(1 << (8 * k)) - 1 for k in range(9)], dtype=np.uint64)


class Vocabulary:
    """A list of distinct words that ``find`` looks up: words of up to eight bytes exactly, longer ones by 64 bits of hash and eight bytes."""

    def __init__(self, listed: list[bytes]):
        size = np.array([len(w) for w in listed], dtype=np.int64)
        offs = np.concatenate([[0], np.cumsum(size)])
        found = Words(np.frombuffer(b"".join(listed), np.uint8), offs, np.zeros(256, bool))
        self.order = np.argsort(found.hash)
        self.hash, self.first = found.hash[self.order], found.first[self.order]

    def find(self, seen: Words) -> np.ndarray:
        """The place in the list of each word seen, or -1."""
        if not len(self.hash):
            return np.full(len(seen.hash), -1, np.int64)
        spot = np.minimum(np.searchsorted(self.hash, seen.hash), len(self.hash) - 1)
        return np.where((self.hash[spot] == seen.hash) & (self.first[spot] == seen.first), self.order[spot], -1)
