"""Words and their 64-bit hashes, in batches of whole texts (helpers that run inside tasks)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

#: Texts are taken in runs of about this many bytes, so that arrays stay in cache.
CHUNK_BYTES = 1 << 19
_U = np.uint64
_BASES = (_U(0x9E3779B97F4A7C15), _U(0xD6E8FEB86659FD93))
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
#: A random 64-bit value for each byte, 0 for white space: a word's hash is a polynomial in these.
_BYTE = np.random.default_rng(20).integers(1, 2**64, 256, dtype=_U)
_BYTE[_SPACE] = 0


def _powers(n: int) -> np.ndarray:
    out = np.full(n, 0xA24BAED4963EE407, dtype=_U)
    out[0] = 1
    return np.multiply.accumulate(out)


_POWERS = _powers(4096)


class Texts:
    """The texts of an Arrow binary column as one byte array; a null counts as empty."""

    def __init__(self, column) -> None:
        import pyarrow as pa

        if column.null_count:
            column = column.fill_null(b"")
        if not pa.types.is_large_binary(column.type):
            column = column.cast(pa.large_binary())
        offsets = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset : column.offset + len(column) + 1]
        data = column.buffers()[2]
        raw = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
        self.bytes = raw[offsets[0] : offsets[-1]]
        self.offsets = offsets - offsets[0]

    def runs(self, size: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
        """Runs ``[a, b)`` of texts of about ``size`` bytes; a longer text is a run of its own."""
        a, last = 0, len(self.offsets) - 1
        while a < last:
            b = max(a + 1, int(np.searchsorted(self.offsets, self.offsets[a] + size, side="right")) - 1)
            yield a, min(b, last)
            a = b

    def words(self, a: int, b: int) -> Words:
        lo, hi = self.offsets[a], self.offsets[b]
        return Words(self.bytes[lo:hi], self.offsets[a : b + 1] - lo)


class Words:
    """All words of some texts end to end: 64-bit hashes, the text of each, its place there, and the words left from it on."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray) -> None:
        n, texts = len(data), len(offsets) - 1
        space = _SPACE[data]
        first = ~space
        first[1:] &= space[:-1]
        heads = self.heads = offsets[:-1][offsets[:-1] < n]
        first[heads] = ~space[heads]
        begin = self.begin = np.flatnonzero(first)
        self.data, self.space = data, space
        if not len(begin):
            self.hashes = np.zeros(0, dtype=_U)
            self.owner = self.place = self.left = np.zeros(0, dtype=np.int64)
            self.counts = np.zeros(texts, dtype=np.int64)
            return
        inside = np.arange(begin[0], n) - np.repeat(begin, np.diff(np.append(begin, n)))
        longest = int(inside.max()) + 1
        powers = _POWERS if longest <= len(_POWERS) else _powers(longest)
        value = _BYTE[data[begin[0] :]]
        value *= powers[inside]
        self.hashes = mixed(np.add.reduceat(value, begin - begin[0]))
        self.owner = np.searchsorted(offsets, begin, side="right") - 1
        self.counts = np.bincount(self.owner, minlength=texts)
        ends = np.cumsum(self.counts)
        at = np.arange(len(begin))
        self.place = at - (ends - self.counts)[self.owner]
        self.left = ends[self.owner] - at

    def ends(self) -> np.ndarray:
        """Where each word ends among the bytes."""
        stop = np.append(self.space[1:], True)
        stop[self.heads[1:] - 1] = True
        return np.flatnonzero(stop & ~self.space) + 1

    def joined(self, which: np.ndarray) -> bytes:
        """The bytes of the words ``which``, joined by line feeds."""
        begin, end = self.begin[which], self.ends()[which]
        out = np.full(int((end - begin + 1).sum()), 0x0A, dtype=np.uint8)
        at = ranges(begin, end - begin)
        out[np.arange(len(at)) + np.repeat(np.arange(len(which)), end - begin)] = self.data[at]
        return out[:-1].tobytes()


def ranges(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """``starts[i], starts[i] + 1, ...`` of each length, end to end."""
    return np.arange(int(lengths.sum())) + np.repeat(starts - np.cumsum(lengths) + lengths, lengths)


def chunks(texts: list[bytes | None]) -> Iterator[tuple[int, int]]:
    """Runs ``[a, b)`` of about CHUNK_BYTES; a longer text is a run of its own."""
    start = held = 0
    for i, text in enumerate(texts):
        size = len(text) if text else 0
        if held and held + size > CHUNK_BYTES:
            yield start, i
            start, held = i, 0
        held += size
    if start < len(texts):
        yield start, len(texts)


def split_words(text: bytes | None) -> list[bytes]:
    """Words ``[^\\x20\\x09-\\x0D]+``: what ``bytes.split`` gives; none for null."""
    return text.split() if text else []


def mixed(h: np.ndarray) -> np.ndarray:
    """Finaliser that spreads polynomial sums over all 64 bits."""
    h = h ^ (h >> _U(32))
    h = h * _U(0xD6E8FEB86659FD93)
    h ^= h >> _U(32)
    h *= _U(0xD6E8FEB86659FD93)
    h ^= h >> _U(32)
    return h


def window_hashes(words: np.ndarray, size: int, base: int = 0) -> np.ndarray:
    """Hash of each run of ``size`` consecutive word hashes (one array over all texts of a chunk)."""
    n = len(words) - size + 1
    if n <= 0:
        return np.empty(0, dtype=_U)
    total = words[:n].copy()
    for j in range(1, size):
        total *= _BASES[base]
        total += words[j : j + n]
    return mixed(total)
