"""Near-duplicates by an LSH forest of MinHash signatures.

1. A document's set of shingles has TREES times DEPTH minima, DEPTH for each tree. Equal
   sets become one node.
2. A tree sorts the nodes by their minima. Nodes that agree on the first few are a run;
   runs beyond ``run`` nodes go one minimum deeper, and so on, so that each region of the
   order has the depth that it needs. A run that is as long at full depth agrees on a
   whole row of minima, and is tied together by a star.
3. Within a run, in signature order, a node meets those of longest common prefix first.
   Two are candidates if their sizes and parity bitmaps allow a link, which no linked
   pair fails; a run hands on a spanning forest of them, never all pairs.
4. Components of the candidates of all trees are the regions. In a region, links are
   confirmed on full sets, by index lists; a region beyond the bound of a task is cut
   into pairs of blocks. So a link is lost only if no tree keeps its two ends together:
   at the threshold of 85 % and three minima that happens once in 8 * 10^9 pairs, at five
   once in 10^6, at the full eight once in 2,000; denser links save most of those.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tideline.llm import kernel
from tideline.llm.cluster import components, durable, hot_keys, lookup
from tideline.llm.ngram_join import TASK_SHINGLES, _meet, _sets, fold_parity, need, parity

#: Trees, minima of a tree, and minima that nodes of a run share at least.
TREES, DEPTH, BASE = 24, 8, 3
#: Nodes of a run that are compared; a longer run goes deeper.
RUN = 1024
#: Shingles that are hashed at a time.
_STEP = 1024
_RANDOM = np.random.default_rng(20_031)
_FACTOR = _RANDOM.integers(0, 1 << 32, TREES * DEPTH, dtype=np.uint32) | np.uint32(1)
_SHIFT = _RANDOM.integers(0, 1 << 32, TREES * DEPTH, dtype=np.uint32)


def minima(items: np.ndarray) -> np.ndarray:
    """The least image of the 64-bit ``items`` under each of the maps."""
    x = (items >> np.uint64(32)).astype(np.uint32)
    out = np.full(TREES * DEPTH, np.iinfo(np.uint32).max, dtype=np.uint32)
    for k in range(0, len(x), _STEP):
        np.minimum(out, (x[None, k : k + _STEP] * _FACTOR[:, None] + _SHIFT[:, None]).min(axis=1), out=out)
    return out


def _sign(docs: DataFrame, n: int, percent: int) -> DataFrame:
    """doc_id, row, size, sig (null without words), parity bitmap and minima of every document."""

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, raw in kernel.blocks(batch.column(2)):
                sets = kernel.shingle_sets(kernel.Block(raw, kernel.SPACED), n)
                sig = [blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None for s in sets]
                odd = [parity(s, percent) if len(s) else None for s in sets]
                low = [minima(s).astype(">u4").tobytes() if len(s) else None for s in sets]
                yield pa.RecordBatch.from_arrays([*[batch.column(c).slice(at, len(raw)) for c in range(2)], pa.array(map(len, sets), pa.int64()), pa.array(sig, pa.binary()), pa.array(odd, pa.binary()), pa.array(low, pa.binary())], names=["doc_id", "row", "size", "sig", "parity", "minima"])

    kind = dict(docs.dtypes)["doc_id"]
    return docs.select("doc_id", "row", "text").mapInArrow(sign, f"doc_id {kind}, row long, size long, sig binary, parity binary, minima binary")


def _runs(nodes: DataFrame, depth: int) -> DataFrame:
    """row, tree, token (of the first ``depth`` minima of the tree) and above (of one less) for every node and tree."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 4096):
                part = batch.slice(at, 4096)
                low = np.frombuffer(b"".join(part.column(1).to_pylist()), dtype=">u4").reshape(-1, TREES, DEPTH)
                token = np.broadcast_to(np.arange(1, TREES + 1, dtype=np.uint64) << np.uint64(40), low.shape[:2])
                for k in range(depth):
                    above, token = token, kernel.mix(token * np.uint64(0x9FB21C651E98DF25) + low[:, :, k].astype(np.uint64))
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(part.column(0).to_numpy(), TREES)), pa.array(np.tile(np.arange(TREES, dtype=np.int32), len(low))), pa.array(token.reshape(-1).view(np.int64)), pa.array(above.reshape(-1).view(np.int64))], names=["row", "tree", "token", "above"])

    return nodes.select("row", "minima").mapInArrow(run, "row long, tree int, token long, above long")


def _candidates(runs: DataFrame, percent: int) -> DataFrame:
    """Edges (a, b): a spanning forest of the pairs of each run that sizes and bitmaps allow, longest common prefix first."""

    def forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, []
        out: set[tuple[int, int]] = set()

        def pair() -> None:
            (p, a, odd, _), (q, b, bits, _) = held
            width = min(len(odd), len(bits))
            apart = (int.from_bytes(fold_parity(odd, width), "big") ^ int.from_bytes(fold_parity(bits, width), "big")).bit_count()
            if 100 * min(a, b) >= percent * max(a, b) and apart <= a + b - 2 * need(a, b, percent):
                out.add((min(p, q), max(p, q)))

        def close() -> None:
            if len(held) == 2:
                pair()
            if len(held) <= 2:
                return
            row, size = [x[0] for x in held], np.array([x[1] for x in held])
            width = min(len(x[2]) for x in held)
            odd = np.frombuffer(b"".join(fold_parity(x[2], width) for x in held), dtype=np.uint64).reshape(len(held), -1)
            root = np.arange(len(held))
            for y in range(1, len(held)):
                both = size[:y] + size[y]
                near = np.bitwise_count(odd[:y] ^ odd[y]).sum(axis=1, dtype=np.int64) <= both - 2 * -(-percent * both // (100 + percent))
                near &= (100 * np.minimum(size[:y], size[y]) >= percent * np.maximum(size[:y], size[y]))
                # in signature order the last one shares the longest prefix
                at = np.flatnonzero(near)[::-1]
                roots, first = np.unique(root[at], return_index=True)
                for r, k in zip(roots.tolist(), at[first].tolist()):
                    out.add((min(row[k], row[y]), max(row[k], row[y])))
                    root[root == r] = root[y]

        def edges() -> pa.RecordBatch:
            a, b = zip(*out)
            out.clear()
            return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

        for batch in batches:
            for token, row, size, odd, key in zip(*[batch.column(k).to_pylist() for k in range(5)]):
                if token != now:
                    close()
                    now = token
                    held.clear()
                    if len(out) >= 100_000:
                        yield edges()
                held.append((row, size, odd, key))
        close()
        if out:
            yield edges()

    dealt = runs.select("token", "row", "size", "parity", "key").repartition("token").sortWithinPartitions("token", "key")
    return dealt.mapInArrow(forest, "a long, b long")


def near_duplicates(docs: DataFrame, n: int = 5, percent: int = 85, id_col: str = "doc_id", text_col: str = "text", run: int = RUN, task_shingles: int = TASK_SHINGLES) -> DataFrame:
    """Every document with the component of its links: 100 * intersection >= percent * union.

    Words stand between ASCII white space, A-Z in lower case; a document's set is its
    distinct n-word shingles, or its whole sequence if that is shorter. Returns doc_id,
    n_shingles, component_id (the least id reachable, its own included) and kept (the id
    is the component's). Null, empty and wordless texts have no shingles, no links and
    their own id. Copies and repeated rows link like others, and all rows of a kept id
    are kept. A null id is passed over where a component has another, and is kept where
    it has none. An empty table gives no rows; other columns are not read. A very long
    text is one set like others, at about 60 bytes a word. ``percent`` should not be far
    below 85: the trees are made for that.
    """
    base = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).withColumn("row", F.xxhash64("doc_id", "text"))
    signed = durable(_sign(base, n, percent))
    nodes = durable(signed.where("sig is not null").groupBy("sig").agg(F.min("doc_id").alias("least"), F.min("row").alias("row"), F.count("*").alias("copies"), F.first("size").alias("size"), F.first("parity").alias("parity"), F.first("minima").alias("minima")))
    posted, found = _runs(nodes, BASE), []
    for depth in range(BASE, DEPTH + 1):
        counts = posted.groupBy("token").agg(F.count("*").alias("k"), F.min("row").alias("star")).where("k > 1")
        shared = durable(posted.join(counts, "token").select("row", "tree", "token", "k", "star"))
        found.append(shared)
        long = shared.where(F.col("k") > run).select(F.col("token").alias("above")).distinct()
        if depth == DEPTH or long.isEmpty():
            break
        posted = _runs(nodes, depth + 1).join(long, "above", "left_semi")
    runs, stars = None, found[-1].where(F.col("k") > run).where("row <> star").select(F.col("row").alias("a"), F.col("star").alias("b"))
    for shared in found:
        few = shared.where(F.col("k") <= run)
        runs = few if runs is None else runs.unionByName(few)
    width = 4 * DEPTH
    keyed = runs.join(nodes.select("row", "size", "parity", "minima"), "row").withColumn("key", F.expr(f"substring(minima, tree * {width} + 1, {width})"))
    edges = _candidates(keyed, percent).unionByName(stars)
    regions = components(edges).select(F.col("node").alias("row"), F.col("root").alias("region"))
    wanted = durable(regions.join(nodes.select("sig", "row", "copies", "size"), "row"))
    total = wanted.groupBy("region").agg(F.sum("size").alias("total"))
    parts = F.when(F.col("total") > task_shingles, F.ceil(2 * F.col("total") / F.lit(task_shingles))).otherwise(F.lit(1)).cast("int")
    cut = wanted.join(total, "region").withColumn("parts", parts).drop("size", "total")
    rows = _sets(base, wanted, n).join(cut, ["row", "sig"])
    links = _meet(rows.where("parts = 1").withColumn("side", F.lit(0)), percent)
    if not cut.where("parts > 1").isEmpty():
        # block p of a region meets every block q once; pairs (p, p) hold links inside p
        part = rows.where("parts > 1").withColumn("p", F.expr("cast(pmod(xxhash64(sig), parts) as int)")).withColumn("q", F.explode(F.expr("sequence(0, parts - 1)")))
        part = part.withColumn("side", F.expr("case when p = q then 0 when p < q then 1 else 2 end"))
        part = part.withColumn("region", F.concat_ws("/", "region", F.least("p", "q"), F.greatest("p", "q")).cast("binary"))
        links = durable(links.unionByName(_meet(part, percent)))
        roots = components(links.select(F.col("sig").alias("a"), F.col("root").alias("b")))
        links = roots.select(F.col("node").alias("sig"), "root")
    joined = durable(nodes.select("sig", "least").join(links.select("sig", "root"), "sig"))
    first = joined.groupBy("root").agg(F.min("least").alias("component_id"))
    by_sig = joined.join(first, "root").select("sig", "component_id")
    # a node without links has the least id of its copies
    alone = nodes.join(joined, "sig", "left_anti").select("sig", F.col("least").alias("component_id"))
    # many copies of one text share a sig, and texts without words have none
    out = lookup(signed.select("doc_id", "row", "size", "sig"), durable(by_sig.unionByName(alone)), "sig", hot_keys(nodes, "sig", "copies"), F.col("row"))
    component = F.when(F.col("sig").isNull(), F.col("doc_id")).otherwise(F.col("component_id"))
    return out.select("doc_id", F.col("size").alias("n_shingles"), component.alias("component_id"), F.col("doc_id").eqNullSafe(component).alias("kept"))
