"""Vectorised word and shingle hashing over UTF-8 bytes.

Everything here works on a block of documents at once. A block is bounded by its
bytes and by its rows, so a worker's memory follows neither the batch nor the number
of short texts in it; a text longer than the bound is a block of its own, and costs
about 25 bytes a byte.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Bytes of text that one block holds, unless a single document is longer, and rows that it holds at most.
BLOCK_BYTES, BLOCK_ROWS = 250_000, 4_096
#: Bytes that are hashed at a time, and rows whose n-grams are counted at a time.
WINDOW, COUNT_ROWS = 1 << 20, 256
_BASE = 0x9E3779B97F4A7C15
_BASE_INVERSE = pow(_BASE, -1, 1 << 64)
_POWERS: dict[str, np.ndarray] = {}


def byte_class(outside: list[tuple[int, int]]) -> np.ndarray:
    """A table that is True for bytes of words; ``outside`` lists byte ranges that separate words."""
    table = np.ones(256, dtype=bool)
    for low, high in outside:
        table[low : high + 1] = False
    return table


#: Words of letters, digits and everything beyond ASCII (for text in lower case).
ALNUM = byte_class([(0x00, 0x2F), (0x3A, 0x60), (0x7B, 0x7F)])
#: Words between ASCII white space.
SPACED = byte_class([(0x20, 0x20), (0x09, 0x0D)])


def mix(x: np.ndarray) -> np.ndarray:
    """Finalise 64-bit values so that every input bit reaches every output bit."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    have = _POWERS.get("up")
    if have is None or len(have) < n:
        size = 1 << max(12, int(n - 1).bit_length())
        for key, base in (("up", _BASE), ("down", _BASE_INVERSE)):
            steps = np.full(size, base, dtype=np.uint64)
            steps[0] = 1
            _POWERS[key] = np.cumprod(steps, dtype=np.uint64)
    return _POWERS["up"][:n], _POWERS["down"]


class Block:
    """Words of some documents.

    ``starts`` and ``ends`` are byte places in ``data``; ``first`` has the number
    of the first word of each document and, at its end, the number of all words.
    """

    def __init__(self, docs: list[bytes], table: np.ndarray):
        self.data = b" ".join(docs) + b" "
        buf = np.frombuffer(self.data, dtype=np.uint8)
        size = np.fromiter(map(len, docs), dtype=np.int64, count=len(docs))
        begin = np.cumsum(size + 1) - size - 1
        inside = table[buf].view(np.int8)
        edge = np.diff(inside, prepend=np.int8(0))
        self.starts, self.ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        self.first = np.append(np.searchsorted(self.starts, begin), len(self.starts))
        self.counts = np.diff(self.first)
        self._buf = buf

    def __len__(self) -> int:
        return len(self.counts)

    def hashes(self) -> np.ndarray:
        """A 64-bit hash of each word's bytes."""
        return span_hashes(self._buf, self.starts, self.ends)

    def words(self, doc: int) -> list[bytes]:
        a, b = self.first[doc], self.first[doc + 1]
        return [self.data[s:e] for s, e in zip(self.starts[a:b].tolist(), self.ends[a:b].tolist())]


def fold(words: np.ndarray, n: int) -> np.ndarray:
    """Hashes of each run of ``n`` words."""
    m = len(words) - n + 1
    out = np.full(max(m, 0), 0x2545F4914F6CDD1D * n % (1 << 64), dtype=np.uint64)
    for k in range(n):
        out = mix(out * np.uint64(0x9FB21C651E98DF25) + words[k : k + max(m, 0)])
    return out


def shingle_sets(block: Block, n: int) -> list[np.ndarray]:
    """The sorted distinct n-word shingles of each document, as 64-bit hashes.

    A document of fewer words has its whole sequence as its one shingle; one
    without words has none.
    """
    word = block.hashes()
    runs = fold(word, n)
    out = []
    for k in range(len(block)):
        a, b = int(block.first[k]), int(block.first[k + 1])
        if b - a >= n:
            out.append(np.unique(runs[a : b - n + 1]))
        else:
            out.append(fold(word[a:b], b - a) if b > a else np.empty(0, dtype=np.uint64))
    return out


def _long_span(buf: np.ndarray, start: int, end: int, up: np.ndarray) -> int:
    """The sum over a span longer than a window, window by window."""
    total = 0
    for k in range(start, end, WINDOW):
        piece = buf[k : min(end, k + WINDOW)].astype(np.uint64) + np.uint64(1)
        total += int((piece * up[: len(piece)]).sum(dtype=np.uint64)) * pow(_BASE, k - start, 1 << 64)
    return total % (1 << 64)


def span_hashes(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of the bytes of each span of ``buf``; ``starts`` ascend. Prefix sums cover a window at a time."""
    span = np.empty(len(starts), dtype=np.uint64)
    up, down = _powers(min(len(buf), 2 * WINDOW))
    for k in np.flatnonzero(ends - starts > WINDOW).tolist():
        span[k] = _long_span(buf, int(starts[k]), int(ends[k]), up)
    low = 0
    while low < len(starts):
        begin = int(starts[low])
        high = int(np.searchsorted(starts, begin + WINDOW))
        at = low + np.flatnonzero(ends[low:high] - starts[low:high] <= WINDOW)
        if len(at):
            piece = buf[begin : int(ends[at].max())].astype(np.uint64)
            total = np.zeros(len(piece) + 1, dtype=np.uint64)
            np.cumsum((piece + np.uint64(1)) * up[: len(piece)], out=total[1:])
            span[at] = (total[ends[at] - begin] - total[starts[at] - begin]) * down[starts[at] - begin]
        low = high
    return mix(span ^ (ends - starts).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def blocks(texts: pa.Array, bound: int = BLOCK_BYTES, lower: bool = True, rows: int = BLOCK_ROWS) -> Iterator[tuple[int, list[bytes]]]:
    """Runs of rows as (first row, whole texts in UTF-8, A-Z in lower case if ``lower``; null as empty)."""
    held, size, at = [], 0, 0
    for k in range(len(texts)):
        value = texts[k].as_buffer()
        raw = value.to_pybytes() if value is not None else b""
        if lower:
            raw = raw.lower()
        if held and (size + len(raw) > bound or len(held) >= rows):
            yield at, held
            held, size, at = [], 0, k
        held.append(raw)
        size += len(raw)
    if held:
        yield at, held


def gram_counts(docs: list[bytes], orders: tuple[int, ...], bits: int) -> np.ndarray:
    """Counts of hashed byte n-grams: one row a document, 2**bits columns. No n-gram crosses documents.

    The callers give at most COUNT_ROWS documents at a time, as the table has a row for each;
    bytes are counted a window at a time.
    """
    out = np.zeros(len(docs) << bits, dtype=np.int64)
    joined = b"".join(docs)
    size = np.fromiter(map(len, docs), dtype=np.int64, count=len(docs))
    ends = np.cumsum(size)
    for begin in range(0, len(joined), WINDOW):
        buf = np.frombuffer(joined, dtype=np.uint8, count=min(len(joined) - begin, WINDOW + max(orders) - 1), offset=begin).astype(np.uint32)
        stop = begin + len(buf)
        owner = np.repeat(np.arange(len(docs), dtype=np.int64), np.clip(ends, begin, stop) - np.clip(ends - size, begin, stop))
        for n in orders:
            m = min(len(buf) - n + 1, WINDOW)
            if m <= 0:
                continue
            h = np.full(m, 0x811C9DC5 + n, dtype=np.uint32)
            for k in range(n):
                h = (h ^ buf[k : k + m]) * np.uint32(0x9E3779B1)
                h ^= h >> np.uint32(15)
            own = owner[:m]
            inside = own == owner[n - 1 : n - 1 + m]
            out += np.bincount((own << bits)[inside] + (h[inside] >> np.uint32(32 - bits)), minlength=len(out))
    return out.reshape(len(docs), 1 << bits)
