"""Vectorised words and word hashes of whole texts, straight from Arrow's UTF-8 buffers."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Bytes that are looked at together; a row longer than this is cut only between its words.
PIECE = 1 << 19

_rng = np.random.default_rng(20240229)
_BYTE = _rng.integers(1, 1 << 63, 256, dtype=np.uint64) | np.uint64(1)
_BASE = int(_rng.integers(1 << 62, 1 << 63)) | 1
_COMBINE = _rng.integers(1, 1 << 63, 64, dtype=np.uint64) | np.uint64(1)
_power: list[np.ndarray] = []


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2**64."""
    if not _power or len(_power[0]) < n:
        n = max(n, PIECE + 1)
        out = []
        for b in (_BASE, pow(_BASE, -1, 1 << 64)):
            x = np.full(n, b, np.uint64)
            x[0] = 1
            out.append(np.multiply.accumulate(x))
        _power[:] = out
    return _power[0], _power[1]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit values."""
    with np.errstate(over="ignore"):
        x = x ^ (x >> np.uint64(30))
        x = x * np.uint64(0xBF58476D1CE4E5B9)
        x ^= x >> np.uint64(27)
        x *= np.uint64(0x94D049BB133111EB)
        x ^= x >> np.uint64(31)
    return x


class Words:
    """What counts as part of a word, byte by byte, and whether A-Z are read as a-z."""

    def __init__(self, part: np.ndarray, fold: bool) -> None:
        self.part, self.byte = part, _BYTE.copy()
        if fold:
            self.byte[65:91] = self.byte[97:123]

    def blocks(self, texts: pa.Array, most: int = 1 << 20) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
        """(first row, row after the last, words of each row, 64-bit hashes of all words) for runs of rows.

        A null text has no words. Rows are grouped to about `most` bytes; every text is read whole.
        """
        n = len(texts)
        if not n:
            return
        if texts.null_count:
            texts = texts.fill_null("")
        wide = pa.types.is_large_string(texts.type)
        offs = np.frombuffer(texts.buffers()[1], np.int64 if wide else np.int32)[texts.offset : texts.offset + n + 1].astype(np.int64)
        data = np.frombuffer(texts.buffers()[2], np.uint8) if texts.buffers()[2] is not None and texts.buffers()[2].size else np.zeros(0, np.uint8)
        row = 0
        while row < n:
            end = max(row + 1, int(np.searchsorted(offs, offs[row] + most, "right")) - 1)
            starts, hashes = self._scan(data, offs[row : end + 1])
            counts = np.diff(np.searchsorted(starts, offs[row : end + 1]))
            yield row, end, counts, hashes
            row = end
        pa.default_memory_pool().release_unused()

    def _scan(self, data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        lo, hi = int(offs[0]), int(offs[-1])
        starts, hashes = [np.zeros(0, np.int64)], [np.zeros(0, np.uint64)]
        while lo < hi:
            cut = min(hi, lo + PIECE)
            if cut < hi:
                at = int(np.searchsorted(offs, cut, "right")) - 1
                if offs[at] > lo:
                    cut = int(offs[at])
                else:  # inside one text: back to a byte between words, or on to the next one
                    while cut > lo and self.part[data[cut - 1]]:
                        cut -= 1
                    if cut == lo:
                        cut = min(hi, lo + PIECE)
                        while cut < offs[at + 1] and self.part[data[cut]]:
                            cut += 1
            s, h = self._piece(data[lo:cut], offs[(offs > lo) & (offs < cut)] - lo)
            starts.append(s + lo)
            hashes.append(h)
            lo = cut
        return np.concatenate(starts), np.concatenate(hashes)

    def _piece(self, buf: np.ndarray, breaks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        inside = self.part[buf]
        first = inside.copy()
        first[1:] &= ~inside[:-1]
        first[breaks] = inside[breaks]
        starts = np.flatnonzero(first)
        last = inside.copy()
        last[:-1] &= ~inside[1:]
        last[breaks - 1] = inside[breaks - 1]
        ends = np.flatnonzero(last) + 1
        up, down = _powers(len(buf) + 1)
        total = np.zeros(len(buf) + 1, np.uint64)
        np.cumsum(self.byte[buf] * up[: len(buf)], out=total[1:])
        raw = (total[ends] - total[starts]) * down[starts]
        return starts, mix(raw + (ends - starts).astype(np.uint64) * _COMBINE[63])


_space = np.zeros(256, bool)
_space[[0x20, *range(0x09, 0x0E)]] = True
#: Words [^\x20\x09-\x0D]+, as they are and with A-Z lower-cased.
PLAIN = Words(~_space, fold=False)
FOLDED = Words(~_space, fold=True)
_letter = np.zeros(256, bool)
_letter[0x30:0x3A] = _letter[0x41:0x5B] = _letter[0x61:0x7B] = _letter[0x80:] = True
#: Words [^\x00-\x2F\x3A-\x60\x7B-\x7F]+ of the text with A-Z lower-cased.
ALNUM = Words(_letter, fold=True)


def word_hash(words: list[str], kind: Words) -> np.ndarray:
    """Hashes of single words, as blocks() gives them."""
    return np.concatenate([np.zeros(0, np.uint64), *(h for _, _, _, h in kind.blocks(pa.array([" ".join(words)], pa.string())))])


def grams(h: np.ndarray, n: int) -> np.ndarray:
    """Hashes of every n consecutive words (one run of words), in order."""
    k = len(h) - n + 1
    if k <= 0:
        return np.zeros(0, np.uint64)
    out = h[:k] * _COMBINE[0]
    for j in range(1, n):
        out += h[j : j + k] * _COMBINE[j]
    return mix(out + np.uint64(int(_COMBINE[62]) * n % 2**64))


def sequence_hash(h: np.ndarray, counts: np.ndarray, salt: int = 0) -> np.ndarray:
    """A 64-bit hash of each row's whole word sequence."""
    ends = np.cumsum(counts)
    starts = ends - counts
    place = np.arange(len(h), dtype=np.uint64) - np.repeat(starts, counts).astype(np.uint64)
    total = np.zeros(len(h) + 1, np.uint64)
    np.cumsum(mix(h + mix(place * _COMBINE[60] + np.uint64(salt))), out=total[1:])
    return mix(total[ends] - total[starts] + counts.astype(np.uint64) * _COMBINE[61])


def row_shingles(h: np.ndarray, counts: np.ndarray, n: int) -> Iterator[np.ndarray]:
    """Each row's distinct n-word shingles, sorted; with fewer words the whole sequence as one; none without words."""
    every = grams(h, n)
    at = 0
    for c in counts.tolist():
        if c >= n:
            yield np.unique(every[at : at + c - n + 1])
        elif c:
            yield grams(h[at : at + c], c) ^ np.uint64(0x5851F42D4C957F2D)
        else:
            yield h[:0]
        at += c
