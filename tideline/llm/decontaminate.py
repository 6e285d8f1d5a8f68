"""Benchmark items inside documents, by size-partitioned MinHash containment.

Items are partitioned by the number of their shingles. An item's signature is its k
least shingles by hash (a bottom-k MinHash), a few more than an item of the asked
containment may lack. A partition's documents are signed by their shingles up to the
largest hash that its items have signed with, so both signatures are samples by
one threshold and their meeting estimates the containment, however long the document.
An item with an estimate below (k - lacked) / k cannot be contained, so no item is
missed. Partitions whose items are too large for a document are skipped. Candidates
are verified by exact containment of the whole shingle set, words compared.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tideline.llm import kernel

#: Bytes of item texts that one pass over the documents carries to the executors.
ITEM_BYTES = 32 << 20
#: Shingles in a signature beyond those that a contained item may lack.
SPARE = 4


@dataclass
class _Item:
    row: int
    n: int
    words: list[bytes]
    hashes: np.ndarray
    first: np.ndarray = field(repr=False)


@dataclass
class _Part:
    """Items of one range of sizes: their signatures as (hash, item) in order of hash, and the estimate that each asks for."""

    least: int
    limit: np.uint64
    hashes: np.ndarray
    owner: np.ndarray


def _least(share: float, size: int) -> int:
    return math.ceil(share * size - 1e-9)


class Index:
    """Signatures of a bounded set of items: (times, text) each."""

    def __init__(self, items: list[tuple[int, bytes]], n: int, share: float):
        self.n, self.share, self.items = n, share, []
        self.times = [times for times, _ in items]
        block = kernel.Block([raw for _, raw in items], kernel.ALNUM)
        word = block.hashes()
        for k in range(len(items)):
            a, b = int(block.first[k]), int(block.first[k + 1])
            if b > a:
                length = min(n, b - a)
                hashes, first = np.unique(kernel.fold(word[a:b], length), return_index=True)
                self.items.append(_Item(k, length, block.words(k), hashes, first))
        self.lengths = sorted({x.n for x in self.items})
        self.votes = np.zeros(len(self.items), dtype=np.int64)
        self.parts: dict[int, list[_Part]] = {}
        for length in self.lengths:
            own = [(k, x) for k, x in enumerate(self.items) if x.n == length]
            self.parts[length] = [self._part([(k, x) for k, x in own if len(x.hashes).bit_length() == size]) for size in sorted({len(x.hashes).bit_length() for _, x in own})]
        self.filter = {length: self._bits(np.concatenate([p.hashes for p in parts])) for length, parts in self.parts.items()}

    def _part(self, own: list[tuple[int, _Item]]) -> _Part:
        pairs = []
        for k, x in own:
            lacked = len(x.hashes) - _least(self.share, len(x.hashes))
            signature = x.hashes[: lacked + SPARE]
            self.votes[k] = len(signature) - lacked
            pairs += [(int(h), k) for h in signature]
        pairs.sort()
        hashes = np.array([h for h, _ in pairs], dtype=np.uint64)
        return _Part(_least(self.share, min(len(x.hashes) for _, x in own)), hashes[-1], hashes, np.array([k for _, k in pairs]))

    @staticmethod
    def _bits(hashes: np.ndarray) -> np.ndarray:
        bits = np.zeros(1 << 20, dtype=bool)
        bits[hashes >> np.uint64(44)] = True
        return bits

    def search(self, block: kernel.Block) -> list[list[tuple[int, int, int]]]:
        """For each document, (item, item's shingles, shared ones) of all that it contains."""
        out: list[list[tuple[int, int, int]]] = [[] for _ in range(len(block))]
        if not self.items:
            return out
        word = block.hashes()
        for length in self.lengths:
            runs = kernel.fold(word, length)
            near = np.flatnonzero(self.filter[length][runs >> np.uint64(44)])
            if not len(near):
                continue
            doc = np.searchsorted(block.first, near, side="right") - 1
            inside = near + length <= block.first[doc + 1]
            near, doc = near[inside], doc[inside]
            seen: dict[int, tuple[np.ndarray, np.ndarray]] = {}
            for part in self.parts[length]:
                for d, k in self._candidates(part, block.counts[doc] - length + 1, runs[near], doc):
                    a, b = int(block.first[d]), int(block.first[d + 1])
                    if d not in seen:
                        seen = {d: np.unique(runs[a : b - length + 1], return_index=True)}
                    item = self.items[k]
                    shared = self._verify(block, a, *seen[d], item)
                    if shared >= _least(self.share, len(item.hashes)):
                        out[d].append((item.row, len(item.hashes), shared))
        return out

    def _candidates(self, part: _Part, size: np.ndarray, h: np.ndarray, doc: np.ndarray) -> list[tuple[int, int]]:
        """(document, item) whose signatures meet often enough, in order of document."""
        signed = (size >= part.least) & (h <= part.limit)
        h, doc = h[signed], doc[signed]
        order = np.lexsort((h, doc))
        h, doc = h[order], doc[order]
        once = np.append(True, (h[1:] != h[:-1]) | (doc[1:] != doc[:-1]))[: len(h)]
        h, doc = h[once], doc[once]
        low, high = np.searchsorted(part.hashes, h, "left"), np.searchsorted(part.hashes, h, "right")
        many = high - low
        at = np.repeat(low - (np.cumsum(many) - many), many) + np.arange(many.sum())
        pair, met = np.unique(np.repeat(doc, many) * len(self.items) + part.owner[at], return_counts=True)
        good = pair[met >= self.votes[pair % len(self.items)]]
        return [divmod(x, len(self.items)) for x in good.tolist()]

    @staticmethod
    def _verify(block: kernel.Block, start: int, hashes: np.ndarray, first: np.ndarray, item: _Item) -> int:
        at = np.minimum(np.searchsorted(hashes, item.hashes), len(hashes) - 1)
        shared = 0
        for k in np.flatnonzero(hashes[at] == item.hashes).tolist():
            p, q = start + int(first[at[k]]), int(item.first[k])
            shared += all(block.data[block.starts[p + j] : block.ends[p + j]] == item.words[q + j] for j in range(item.n))
        return shared


def _passes(items: DataFrame, id_col: str, text_col: str, n: int, share: float, bound: int) -> Iterator[tuple[pa.Array, Index]]:
    """Ids and indexes of all items, each over at most about ``bound`` bytes of their texts; equal items go once."""
    distinct = items.groupBy(F.col(id_col).alias("id"), F.col(text_col).alias("text")).agg(F.count("*").alias("times"))
    total = distinct.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    groups = max(1, math.ceil(2 * total / bound)) if total > bound else 1
    for g in range(groups):
        part = distinct if groups == 1 else distinct.where(F.pmod(F.xxhash64("id", "text"), F.lit(groups)) == g)
        rows = part.toArrow()
        texts = [(text or "").encode().lower() for text in rows["text"].to_pylist()]
        yield rows["id"].combine_chunks(), Index(list(zip(rows["times"].to_pylist(), texts)), n, share)


def find_items(docs: DataFrame, items: DataFrame, n: int = 5, share: float = 0.8, id_col: str = "doc_id", text_col: str = "text", item_id: str = "item_id", item_text: str = "text", item_bytes: int = ITEM_BYTES) -> DataFrame:
    """All (document, item) with at least ``share`` of the item's n-word shingles in the document.

    Words are runs of letters, digits and other characters beyond ASCII, A-Z in lower
    case. An item of fewer words is one shingle of them all. Returns doc_id, item_id
    (both as they came, of any type), n_item, n_shared and containment. Null, empty or
    wordless texts and items match nothing; repeated documents and items give repeated
    rows; empty tables give none. Other columns are not read. Items travel to the
    executors in passes of bounded size, so a benchmark of any size is searched whole;
    documents are never shuffled, and a very long one takes about 60 bytes a word.
    """
    kind, item_kind = dict(docs.dtypes)[id_col], dict(items.dtypes)[item_id]
    source = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    out = None
    for keys, index in _passes(items, item_id, item_text, n, share, item_bytes):

        def search(batches: Iterator[pa.RecordBatch], index: Index = index, keys: pa.Array = keys) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for at, raw in kernel.blocks(batch.column(1)):
                    found = index.search(kernel.Block(raw, kernel.ALNUM))
                    rows = [(at + k, *x) for k, own in enumerate(found) for x in own for _ in range(index.times[x[0]])]
                    if rows:
                        row, key, size, shared = map(list, zip(*rows))
                        yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(row)), keys.take(pa.array(key)), pa.array(size, pa.int64()), pa.array(shared, pa.int64()), pa.array([s / q for s, q in zip(shared, size)])], names=["doc_id", "item_id", "n_item", "n_shared", "containment"])

        part = source.mapInArrow(search, f"doc_id {kind}, item_id {item_kind}, n_item long, n_shared long, containment double")
        out = part if out is None else out.unionByName(part)
    return out


def drop_contaminated(docs: DataFrame, items: DataFrame, n: int = 5, share: float = 0.8, text_col: str = "text", item_id: str = "item_id", item_text: str = "text", item_bytes: int = ITEM_BYTES) -> DataFrame:
    """``docs`` without the rows that contain a benchmark item; all columns stay, whatever their names.

    Null, empty and wordless texts contain none and stay; repeated rows share their lot. No shuffle.
    """
    out = docs
    for _, index in _passes(items, item_id, item_text, n, share, item_bytes):

        def keep(batches: Iterator[pa.RecordBatch], index: Index = index) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                # handed back block by block: the JVM takes a batch that it reads whole
                for at, raw in kernel.blocks(batch.column(batch.schema.get_field_index(text_col))):
                    clean = [not own for own in index.search(kernel.Block(raw, kernel.ALNUM))]
                    yield batch.slice(at, len(raw)).filter(pa.array(clean, pa.bool_()))

        out = out.mapInArrow(keep, docs.schema)
    return out
