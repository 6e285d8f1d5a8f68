"""Exact n-gram Jaccard self-join with set-relation skipping.

1. Counts of hashed shingles over all documents give a global order, rare first.
   The counters have a fixed size, whatever the corpus; any order is correct, a
   better one only skips more.
2. Equal sets become one node. A node is indexed under its prefix, the shingles
   that a linked partner cannot all lack, apart for each class of sizes; a set close
   above a class's upper end is in that class too. Two nodes of one list may link only if
   their sizes and their parity bitmaps allow it (bits in which those differ are at
   most the shingles in which the sets differ); a list hands on a spanning forest of
   such pairs, never all of them, and a list beyond a bound a star. Connected
   components of the forests are the regions: every link lies inside one.
3. A region's sets meet once, in one task if they are few. Index lists are cut into
   blocks by position in the order, and blocks that cannot reach the overlap are
   skipped. The overlaps of a set are derived from those of a highly similar set
   just answered, by the lists of the shingles in which the two differ.
4. A region beyond the bound of a task is cut into blocks of sets, and each pair of
   blocks is a task of its own; components of what they find join the answers.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tideline.llm import kernel
from tideline.llm.cluster import components, durable, free_name, hot_keys, lookup

#: Hashed counters, and the slices in which tasks hand them on.
COUNTER_BITS, SLICES = 22, 64
#: Bits of the filter by which the second reading of texts passes over sets without partners.
FILTER_BITS = 24
#: Sizes of a class grow by this factor; its parity bitmaps have at least so many bits.
CLASS, PARITY = 1.5, 256
#: Nodes of a list that are compared by size and bitmap; a longer list becomes a star.
LIST = 4096
#: Shingles of all sets that meet in one task.
TASK_SHINGLES = 1 << 21
#: Positions in a block of an index list.
POSITIONS = 8
#: Rows of sets that become Python objects together.
READ_ROWS = 256


def need(a: int, b: int, percent: int) -> int:
    """Least intersection of linked sets of sizes a and b."""
    return -(-percent * (a + b) // (100 + percent))


def prefix(size: int, percent: int) -> int:
    """Of any linked partner, one shingle is among so many first ones."""
    return size - -(-percent * size // 100) + 1 if size else 0


def size_class(size: int) -> int:
    return int(math.log(size) / math.log(CLASS) + 1e-9)


def classes(size: int, percent: int) -> list[int]:
    """The class of a size, and the one below where that may hold a linked set."""
    own = size_class(size)
    return [own, own - 1] if own and size_class(-(-percent * size // 100)) < own else [own]


def parity(items: np.ndarray, percent: int) -> bytes:
    """A bitmap of the parities of hash buckets. One of half the width is the exclusive or of its halves."""
    most = CLASS ** (size_class(len(items)) + 1) * (0.5 if percent >= 85 else 1.0)
    width = max(PARITY, 1 << math.ceil(math.log2(most)))
    return np.packbits(np.bincount((items >> np.uint64(12) & np.uint64(width - 1)).astype(np.int64), minlength=width) & 1).tobytes()


def fold_parity(bits: bytes, width: int) -> bytes:
    """The bitmap at ``width`` bytes."""
    while len(bits) > width:
        half = len(bits) // 2
        bits = (int.from_bytes(bits[:half], "big") ^ int.from_bytes(bits[half:], "big")).to_bytes(half, "big")
    return bits


def _counters(docs: DataFrame, n: int) -> np.ndarray:
    """Documents by hashed shingle: a table of fixed size, summed over all rows in two levels."""
    shift, width = np.uint64(64 - COUNTER_BITS), (1 << COUNTER_BITS) // SLICES

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(1 << COUNTER_BITS, dtype=np.uint32)
        for batch in batches:
            for _, raw in kernel.blocks(batch.column(0)):
                for s in kernel.shingle_sets(kernel.Block(raw, kernel.SPACED), n):
                    np.add.at(total, s >> shift, np.uint32(1))
        task = TaskContext.get().partitionId()
        packed = [zlib.compress(total[k * width : (k + 1) * width].astype(np.int64).tobytes(), 1) for k in range(SLICES)]
        yield pa.RecordBatch.from_arrays([pa.array(range(SLICES), pa.int32()), pa.array([task] * SLICES, pa.int32()), pa.array(packed, pa.binary())], names=["slice", "task", "counts"])

    def add(key: tuple, parts: pa.Table) -> pa.Table:
        total = np.zeros(width, dtype=np.int64)
        for value in parts.column("counts"):
            total += np.frombuffer(zlib.decompress(value.as_py()), dtype=np.int64)
        return pa.table({"slice": pa.array([key[0].as_py()], pa.int32()), "task": pa.array([0], pa.int32()), "counts": pa.array([zlib.compress(total.tobytes(), 1)], pa.binary())})

    kind = "slice int, task int, counts binary"
    parts = docs.select("text").mapInArrow(count, kind)
    some = parts.groupBy("slice", F.expr("task % 64").alias("g")).applyInArrow(add, kind)
    out = np.zeros((SLICES, width), dtype=np.int64)
    for row in some.groupBy("slice").applyInArrow(add, kind).collect():
        out[row["slice"]] = np.frombuffer(zlib.decompress(row["counts"]), dtype=np.int64)
    return np.minimum(out.reshape(-1), np.iinfo(np.uint32).max).astype(np.uint32)


def _sign(docs: DataFrame, n: int, percent: int, counts: np.ndarray) -> DataFrame:
    """doc_id, row, twin, size, sig (of the whole set; null if empty), parity bitmap, prefix (in the global order)."""
    shared = docs.sparkSession.sparkContext.broadcast(counts)
    shift = np.uint64(64 - COUNTER_BITS)

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weight = shared.value
        for batch in batches:
            for at, raw in kernel.blocks(batch.column(3)):
                size, sig, odd, own, first = [], [], [], [], []
                for s in kernel.shingle_sets(kernel.Block(raw, kernel.SPACED), n):
                    size.append(len(s))
                    sig.append(blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None)
                    odd.append(parity(s, percent) if len(s) else None)
                    own.append(classes(len(s), percent) if len(s) else [])
                    k = prefix(len(s), percent)
                    w = weight[s >> shift]
                    if k < len(s) // 2:  # the k rarest, without ordering the rest
                        near = np.flatnonzero(w <= np.partition(w, k)[k]) if k else np.empty(0, dtype=np.int64)
                        order = near[np.lexsort((s[near], w[near]))][:k]
                    else:
                        order = np.lexsort((s, w))[:k]
                    first.append(s[order].view(np.int64))
                offsets = np.cumsum([0, *map(len, first)])
                lists = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(np.concatenate(first), pa.int64()))
                rows = len(raw)
                yield pa.RecordBatch.from_arrays([*[batch.column(c).slice(at, rows) for c in range(3)], pa.array(size, pa.int64()), pa.array(sig, pa.binary()), pa.array(odd, pa.binary()), pa.array(own, pa.list_(pa.int32())), lists], names=["doc_id", "row", "twin", "size", "sig", "parity", "classes", "prefix"])

    kind = dict(docs.dtypes)["doc_id"]
    return docs.select("doc_id", "row", "twin", "text").mapInArrow(sign, f"doc_id {kind}, row long, twin long, size long, sig binary, parity binary, classes array<int>, prefix array<long>")


def _forest(shared: DataFrame, percent: int) -> DataFrame:
    """Edges (a, b) that keep the nodes of each list together that sizes and bitmaps allow to link."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, []
        out: set[tuple[int, int]] = set()

        def close() -> None:
            held.sort(key=lambda x: x[1])
            if len(held) <= 16:
                root = list(range(len(held)))
                width = min((len(x[2]) for x in held), default=0)
                bits = [int.from_bytes(fold_parity(x[2], width), "big") for x in held]
                for y in range(1, len(held)):
                    row, b, odd = held[y][0], held[y][1], bits[y]
                    for x in range(y - 1, -1, -1):
                        other, a, seen = held[x][0], held[x][1], bits[x]
                        if 100 * a < percent * b:
                            break
                        if root[x] != root[y] and (odd ^ seen).bit_count() <= a + b - 2 * need(a, b, percent):
                            out.add((other, row))
                            old, new = root[y], root[x]
                            root[:] = [new if r == old else r for r in root]
                return
            size = np.array([x[1] for x in held])
            width = min(len(x[2]) for x in held)
            odd = np.frombuffer(b"".join(fold_parity(x[2], width) for x in held), dtype=np.uint64).reshape(len(held), -1)
            root = np.arange(len(held))
            for y in range(1, len(held)):
                low = int(np.searchsorted(size, -(-percent * int(size[y]) // 100)))
                if low >= y:
                    continue
                both = size[low:y] + size[y]
                near = np.bitwise_count(odd[low:y] ^ odd[y]).sum(axis=1, dtype=np.int64) <= both - 2 * -(-percent * both // (100 + percent))
                for r in np.unique(root[low:y][near]).tolist():
                    x = low + int(np.flatnonzero(near & (root[low:y] == r))[0])
                    out.add((held[x][0], held[y][0]))
                    root[root == root[y]] = r

        def edges() -> pa.RecordBatch:
            a, b = zip(*out)
            out.clear()
            return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

        for batch in batches:
            for token, row, size, odd in zip(*[batch.column(k).to_pylist() for k in range(4)]):
                if token != now:
                    close()
                    now = token
                    held.clear()
                    if len(out) >= 100_000:
                        yield edges()
                held.append((row, size, odd))
        close()
        if out:
            yield edges()

    dealt = shared.select("token", "row", "size", "parity").repartition("token").sortWithinPartitions("token")
    return dealt.mapInArrow(run, "a long, b long")


def _sets(docs: DataFrame, wanted: DataFrame, n: int) -> DataFrame:
    """row, sig and set of the wanted rows, by a second reading of the texts.

    A bit table of fixed size stands for the wanted rows, so that other texts are not
    cut into shingles again; the caller's join drops what passes it by chance.
    """
    words = 1 << (FILTER_BITS - 6)
    bits = wanted.groupBy(F.expr(f"shiftrightunsigned(row, 6) & {words - 1}L").alias("w")).agg(F.expr("bit_or(shiftleft(1L, cast(row & 63 as int)))").alias("bits")).collect()
    table = np.zeros(words, dtype=np.uint64)
    for r in bits:
        table[r.w] = r.bits & 0xFFFFFFFFFFFFFFFF
    shared = docs.sparkSession.sparkContext.broadcast(table)

    def again(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            row = batch.column(0).to_numpy().view(np.uint64)
            word = shared.value[(row >> np.uint64(6)) & np.uint64(words - 1)]
            batch = batch.filter(pa.array((word >> (row & np.uint64(63))) & np.uint64(1) == 1))
            for at, raw in kernel.blocks(batch.column(1)):
                sets = kernel.shingle_sets(kernel.Block(raw, kernel.SPACED), n)
                sig = [blake2b(s.tobytes(), digest_size=16).digest() for s in sets]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, len(raw)), pa.array(sig, pa.binary()), pa.array([s.tobytes() for s in sets], pa.binary())], names=["row", "sig", "items"])

    return docs.select("row", "text").mapInArrow(again, "row long, sig binary, items binary")


class Region:
    """Answers for sets that meet in one task; ``side`` limits links to those between two sides."""

    def __init__(self, sets: list[np.ndarray], percent: int, side: list[int] | None = None):
        order = sorted(range(len(sets)), key=lambda k: len(sets[k]))
        self.order, self.percent = order, percent
        self.side = None if side is None else np.array([side[k] for k in order])
        self.sets = [sets[k] for k in order]
        self.size = np.array([len(s) for s in self.sets], dtype=np.int64)

    def links(self) -> Iterator[tuple[int, np.ndarray]]:
        """For each set, the sets that it links with and that are not larger or stand before it; numbered as given."""
        back = np.array(self.order, dtype=np.int64)
        for x, found in self._pairs() if len(self.sets) <= 4 else self._indexed():
            if self.side is not None:
                found = found[self.side[found] != self.side[x]]
            if len(found):
                yield int(back[x]), back[found]

    def _pairs(self) -> Iterator[tuple[int, np.ndarray]]:
        for x in range(1, len(self.sets)):
            a = len(self.sets[x])
            yield x, np.array([y for y in range(x) if len(self.sets[y]) * 100 >= self.percent * a and len(np.intersect1d(self.sets[x], self.sets[y], assume_unique=True)) >= need(a, len(self.sets[y]), self.percent)], dtype=np.int64)

    def _indexed(self) -> Iterator[tuple[int, np.ndarray]]:
        sets, size, percent = self.sets, self.size, self.percent
        flat = np.concatenate(sets)
        # a region has fewer sets and shingles than 2**31, as it fits one task
        owner = np.repeat(np.arange(len(sets), dtype=np.int32), size)
        _, token = np.unique(flat, return_inverse=True)
        del flat
        often = np.bincount(token)
        # in this region, the rarest shingle is number 0
        number = np.empty(len(often), dtype=np.int32)
        number[np.argsort(often, kind="stable")] = np.arange(len(often), dtype=np.int32)
        token = number[token]
        begin = np.concatenate(([0], np.cumsum(size)))
        # sets stand one after another, so each is ordered in its own place
        for low, high in zip(begin[:-1].tolist(), begin[1:].tolist()):
            token[low:high].sort()
        position = np.arange(len(token)) - begin[owner]
        ordered = [token[begin[k] : begin[k + 1]] for k in range(len(sets))]
        # whole lists, for overlaps
        by_token = np.argsort(token, kind="stable")
        listed, at = owner[by_token], np.searchsorted(token[by_token], np.arange(len(often) + 1, dtype=np.int32))
        # lists of prefixes, in blocks of positions, each ordered by size
        length = np.array([prefix(int(s), percent) for s in size])
        early = np.flatnonzero(position < length[owner])
        early = early[np.lexsort((owner[early], position[early] // POSITIONS, token[early]))]
        blocks: dict[int, list[tuple[int, np.ndarray]]] = {}
        key = token[early].astype(np.int64) * (1 << 32) + position[early] // POSITIONS
        cut = np.flatnonzero(np.diff(key, prepend=-1))
        for low, high in zip(cut.tolist(), [*cut[1:].tolist(), len(early)]):
            blocks.setdefault(int(token[early[low]]), []).append((int(position[early[low]]) // POSITIONS * POSITIONS, owner[early[low:high]]))
        bound = np.searchsorted(size, -(-percent * size // 100))
        last, overlap = -1, np.zeros(len(sets), dtype=np.int64)

        def lists(tokens: np.ndarray) -> np.ndarray:
            parts = [listed[at[t] : at[t + 1]] for t in tokens.tolist()]
            return np.bincount(np.concatenate(parts), minlength=len(sets)) if parts else np.zeros(len(sets), dtype=np.int64)

        for x in range(len(sets)):
            a, low = int(size[x]), int(bound[x])
            hit = np.zeros(len(sets), dtype=bool)
            floor = need(a, int(size[low]), percent)
            for i, t in enumerate(ordered[x][: length[x]].tolist()):
                if a - i < floor:
                    break
                for j, own in blocks.get(t, ()):
                    # of the block, no set has its shingle before j, and none here is larger than x
                    if a - j < floor:
                        break
                    hit[own[np.searchsorted(own, low) : np.searchsorted(own, x)]] = True
            found = np.flatnonzero(hit[:x])
            if not len(found):
                continue
            if last >= 0:
                plus, minus = np.setdiff1d(ordered[x], ordered[last], True), np.setdiff1d(ordered[last], ordered[x], True)
            if last >= 0 and len(plus) + len(minus) < a // 2:
                overlap = overlap + lists(plus) - lists(minus)
            else:
                overlap = lists(ordered[x])
            last = x
            yield x, found[overlap[found] * (100 + percent) >= percent * (a + size[found])]


def _answers(rows: Iterator[tuple[bytes, bytes, np.ndarray, int, int]], percent: int) -> Iterator[tuple[bytes, bytes, int]]:
    """From (key, sig, set, copies, side) in order of key: sig, least sig linked through this key, linked documents."""
    held: dict[bytes, tuple[np.ndarray, int, int]] = {}
    now = None

    def done() -> Iterator[tuple[bytes, bytes, int]]:
        sigs = list(held)
        sides = [held[s][2] for s in sigs]
        parent = list(range(len(sigs)))
        count = [0] * len(sigs)

        def root(k: int) -> int:
            while parent[k] != k:
                parent[k] = parent[parent[k]]
                k = parent[k]
            return k

        for x, found in Region([held[s][0] for s in sigs], percent, sides if any(sides) else None).links():
            for y in found.tolist():
                count[x] += held[sigs[y]][1]
                count[y] += held[sigs[x]][1]
                p, q = root(x), root(y)
                if p != q:
                    parent[p] = q
        least: dict[int, bytes] = {}
        for k, s in enumerate(sigs):
            r = root(k)
            least[r] = min(least.get(r, s), s)
        for k, s in enumerate(sigs):
            if count[k]:
                yield s, least[root(k)], count[k]

    for key, sig, items, copies, side in rows:
        if key != now:
            yield from done()
            held, now = {}, key
        held.setdefault(sig, (items, copies, side))
    yield from done()


def _meet(rows: DataFrame, percent: int) -> DataFrame:
    """rows: region, sig, items, copies, side; a region's rows meet in one task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def each() -> Iterator[tuple[bytes, bytes, np.ndarray, int, int]]:
            for batch in batches:
                for at in range(0, len(batch), READ_ROWS):
                    for r in batch.slice(at, READ_ROWS).to_pylist():
                        yield r["region"], r["sig"], np.frombuffer(r["items"], dtype=np.uint64), r["copies"], r["side"]

        out: list[tuple[bytes, bytes, int]] = []
        for x in _answers(each(), percent):
            out.append(x)
            if len(out) >= 10_000:
                yield _batch(out)
                out = []
        if out:
            yield _batch(out)

    def _batch(out: list[tuple[bytes, bytes, int]]) -> pa.RecordBatch:
        sig, root, links = map(list, zip(*out))
        return pa.RecordBatch.from_arrays([pa.array(sig, pa.binary()), pa.array(root, pa.binary()), pa.array(links, pa.int64())], names=["sig", "root", "links"])

    dealt = rows.select("region", "sig", "items", "copies", "side").repartition("region").sortWithinPartitions("region")
    return dealt.mapInArrow(run, "sig binary, root binary, links long")


def join_components(docs: DataFrame, n: int = 3, percent: int = 90, id_col: str = "doc_id", text_col: str = "text", task_shingles: int = TASK_SHINGLES, list_bound: int = LIST, with_root: bool = False) -> DataFrame:
    """Every document with the component of its links: 100 * intersection >= percent * union.

    Words stand between ASCII white space, A-Z in lower case; a document's set is its
    distinct n-word shingles, or its whole sequence if that is shorter. Returns doc_id,
    row (a hash of id and text), n_shingles, component_id (the least id reachable, its
    own included) and n_links (other rows linked, copies included). Null, empty and
    wordless texts have no shingles, no links and their own id. Copies and repeated
    rows link like others. A null id is passed over where a component has another.
    An empty table gives no rows; other columns are not read. A very long text is one
    set like others, at about 60 bytes a word. component_id does not tell components
    apart (ids may be null or stand on several texts); ``with_root`` adds root, which
    does (the least set of each, null without words), twin (another hash of id and text)
    and keep: least id, row and twin of the component.
    """
    base = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).withColumn("row", F.xxhash64("doc_id", "text")).withColumn("twin", F.xxhash64(F.lit(1), "text", "doc_id"))
    # read twice, here and for the result: signing a text again costs less than keeping every prefix
    signed = _sign(base, n, percent, _counters(base, n))
    nodes = durable(signed.where("sig is not null").groupBy("sig").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row", "twin")).alias("least"), F.min("row").alias("row"), F.count("*").alias("copies"), F.first("size").alias("size"), F.first("parity").alias("parity"), F.first("classes").alias("classes"), F.first("prefix").alias("prefix")))
    # a row hash is the node's name here: should two agree, their regions merge, which is harmless
    posted = nodes.select("row", "classes", F.explode("prefix").alias("t")).select("row", F.explode("classes").alias("c"), "t").select("row", F.xxhash64("t", "c").alias("token"))
    lists = posted.groupBy("token").agg(F.min("row").alias("star"), F.count("*").alias("k")).where("k > 1")
    shared = durable(posted.join(lists, "token"))
    few = _forest(shared.where(F.col("k") <= list_bound).join(nodes.select("row", "size", "parity"), "row"), percent)
    stars = few.unionByName(shared.where((F.col("k") > list_bound) & (F.col("row") != F.col("star"))).select(F.col("row").alias("a"), F.col("star").alias("b")))
    regions = components(stars).select(F.col("node").alias("row"), F.col("root").alias("region"))
    wanted = durable(regions.join(nodes.select("sig", "row", "copies", "size"), "row"))
    total = wanted.groupBy("region").agg(F.sum("size").alias("total"))
    sized = wanted.join(total, "region")
    cut = sized.withColumn("parts", F.when(F.col("total") > task_shingles, F.ceil(2 * F.col("total") / F.lit(task_shingles))).otherwise(F.lit(1)).cast("int"))
    rows = _sets(base, wanted, n).join(cut.drop("size", "total"), ["row", "sig"])
    few = rows.where("parts = 1").withColumn("side", F.lit(0))
    found = _meet(few, percent)
    if not cut.where("parts > 1").isEmpty():
        # block b of a region meets every other block once; pairs (b, b) hold links inside b
        part = rows.where("parts > 1").withColumn("p", F.expr("cast(pmod(xxhash64(sig), parts) as int)"))
        pairs = part.withColumn("q", F.explode(F.expr("sequence(0, parts - 1)")))
        pairs = pairs.withColumn("side", F.when(F.col("p") == F.col("q"), 0).otherwise(F.when(F.col("p") < F.col("q"), 1).otherwise(2)))
        pairs = pairs.withColumn("region", F.concat(F.col("region").cast("string").cast("binary"), F.lit("/").cast("binary"), F.least("p", "q").cast("string").cast("binary"), F.lit("/").cast("binary"), F.greatest("p", "q").cast("string").cast("binary")))
        found = found.unionByName(_meet(pairs, percent))
        found = durable(found)
        roots = components(found.select(F.col("sig").alias("a"), F.col("root").alias("b"))).select(F.col("node").alias("sig"), "root")
        links = found.groupBy("sig").agg(F.sum("links").alias("links"))
        found = links.join(roots, "sig", "left").select("sig", F.coalesce("root", "sig").alias("root"), "links")
    joined = nodes.join(found, "sig", "left").withColumn("root", F.coalesce("root", "sig"))
    # a set alone is its own root, and knows its answer
    first = joined.where("links is not null").groupBy("root").agg(F.min("least").alias("keep"))
    together = joined.where("links is not null").join(first, "root")
    by_sig = together.unionByName(joined.where("links is null").withColumn("keep", F.col("least")))
    by_sig = durable(by_sig.select("sig", "root", "keep", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links")))
    # many copies of one text share a sig, and texts without words have none
    out = lookup(signed.select("doc_id", "row", "twin", "size", "sig"), by_sig, "sig", hot_keys(nodes, "sig", "copies"), F.col("row"))
    return out.select("doc_id", "row", *["twin", "root", "keep"] * with_root, F.col("size").alias("n_shingles"), F.when(F.col("sig").isNull(), F.col("doc_id")).otherwise(F.col("keep.doc_id")).alias("component_id"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"))


def one_of_each(docs: DataFrame, n: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text", task_shingles: int = TASK_SHINGLES) -> DataFrame:
    """``docs`` with one row of each component: the least id, of equal ids one. All columns stay.

    Texts without words are linked with nothing and all stay. Of rows that are equal in id
    and text the one of least hash over all columns (but maps) stays. An empty table gives none.
    """
    joined = join_components(docs, n, percent, id_col, text_col, task_shingles, with_root=True)
    key, twin, stay = (free_name(docs, name) for name in ("_row", "_twin", "_stay"))
    stays = (F.col("row") == F.col("keep.row")) & (F.col("twin") == F.col("keep.twin"))
    marks = joined.where("n_links > 0").groupBy(F.col("row").alias(key), F.col("twin").alias(twin)).agg(F.max(stays.cast("int")).alias(stay))
    keyed = docs.withColumn(key, F.xxhash64(id_col, text_col)).withColumn(twin, F.xxhash64(F.lit(1), text_col, id_col))
    rows = keyed.join(marks, [key, twin], "left").where(F.coalesce(stay, F.lit(2)) > 0)
    # equal rows of a linked text share the keys: one of them stays
    plain = [f"`{c}`" for c, kind in docs.dtypes if "map<" not in kind]
    whole = rows.where(F.col(stay) == 1).groupBy(key, twin).agg(F.min_by(F.struct(*[F.col(f"`{c}`") for c in docs.columns]), F.xxhash64(*plain)).alias(stay))
    return rows.where(F.col(stay).isNull()).select(*[F.col(f"`{c}`") for c in docs.columns]).unionByName(whole.select(f"{stay}.*"))
