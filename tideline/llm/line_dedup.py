"""Removal of globally repeated multi-line chunks with content-defined bounds.

A text is cut into lines, and a line into display lines: sentences, or so many
words where no sentence ends. A chunk is a shortest run of adjacent display lines
that reaches both minima, from each display line on and back from each, so chunks
overlap and every repeated run of display lines that reaches the minima is a union
of repeated chunks. Chunks depend on their own content only: an insertion changes
none that it does not touch.

One pass counts chunk hashes; the repeated ones fill a bit table, whose size follows
their number up to a bound (beyond it the table only lets more through). A second pass
brings 128-bit digests (BLAKE2b) of the chunks that the table lets through, and equality
of these decides. A chunk in a great share of all texts is dealt over many tasks.
"""

from __future__ import annotations

from collections.abc import Collection, Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tideline.llm import kernel
from tideline.llm.cluster import HOT, durable, free_name

#: Words after which a sentence is cut into another display line.
WRAP = 16
#: A chunk has at least so many display lines, blank ones not counted, and so many words.
MIN_LINES, MIN_WORDS = 2, 16
#: Bits of the table of repeated chunk hashes: sixteen a hash, between these powers of two.
LEAST_BITS, MOST_BITS = 16, 28

#: For ``bytes.translate``: 1 for white space, for the ends of sentences and for newlines.
_SPACE, _STOP, _NEWLINE = (bytes(k in own for k in range(256)) for own in (b"\t\n\v\f\r ", b".!?", b"\n"))


def _marks(data: bytes, table: bytes) -> np.ndarray:
    return np.frombuffer(data.translate(table), dtype=np.bool_)


class Chunks:
    """Chunks of some texts: ``start`` and ``end`` are byte places in ``data``, ``doc`` the text's number, ``place`` the chunk's number in it.

    Chunks overlap: each is the run of display lines ``a`` to ``b``, from its first word to its
    last; ``open`` and ``shut`` are the bounds of display lines with the space around them.
    """

    def __init__(self, docs: list[bytes], min_lines: int = MIN_LINES, min_words: int = MIN_WORDS):
        self.data = b"\n".join(docs) + b"\n"
        n = len(self.data)
        size = np.fromiter(map(len, docs), dtype=np.int64, count=len(docs)) + 1
        begin = np.cumsum(size) - size
        space, newline = _marks(self.data, _SPACE), _marks(self.data, _NEWLINE)
        cut = np.append(True, newline[:-1])
        cut[2:] |= _marks(self.data, _STOP)[:-2] & (np.frombuffer(self.data, dtype=np.uint8)[1:-1] == 32)
        words = np.flatnonzero(~space & np.append(True, space[:-1]))
        # everything ascends, so places among words give counts, and no order is sought
        first = np.searchsorted(words, np.flatnonzero(cut))
        counts = np.diff(np.append(first, len(words)))
        nth = np.arange(len(words)) - np.repeat(first, counts)
        cut[words[(nth > 0) & (nth % WRAP == 0)]] = True
        start = np.flatnonzero(cut)
        first = np.searchsorted(words, start)
        counts = np.diff(np.append(first, len(words)))
        # blank display lines belong to the one before them; those that begin a text to its first one
        start, word = start[counts > 0], np.append(first[counts > 0], len(words))
        heads = np.searchsorted(start, np.append(begin, n))
        doc = np.repeat(np.arange(len(docs)), np.diff(heads))
        head = np.append(True, doc[1:] != doc[:-1])[: len(start)]
        self.open = np.where(head, begin[doc], start)
        self.shut = np.append(self.open[1:], 0)[: len(start)]
        tail = np.append(head[1:], True)[: len(start)]
        self.shut[tail] = (begin + size)[doc[tail]]
        word_ends = np.flatnonzero(~space & np.append(space[1:], True)) + 1
        # the shortest run that reaches both minima, from each display line on and back from each
        at = np.arange(len(start))
        low, high = heads[doc], heads[doc + 1] - 1
        on = np.maximum(np.searchsorted(word, word[:-1] + min_words) - 1, at + min_lines - 1)
        back = np.minimum(np.searchsorted(word, word[1:] - min_words, side="right") - 1, at - min_lines + 1)
        ahead, behind = on <= high, back >= low
        behind[behind] = on[back[behind]] != at[behind]
        # in order of both bounds: of one first line, the run on from it is the shortest
        a, b = at[ahead], at[behind]
        ons, backs = np.cumsum(ahead), np.cumsum(np.bincount(back[b], minlength=len(start)))
        order = np.append(ons[a] - 1 + np.append(0, backs)[a], ons[back[b]] + np.arange(len(b)))
        runs = np.empty((2, len(order)), dtype=np.int64)
        runs[0, order], runs[1, order] = np.append(a, back[b]), np.append(on[a], b)
        # a text without such a run is one chunk that never goes
        owner = doc[runs[0]]
        own = np.bincount(owner, minlength=len(docs))
        bare = own == 0
        self.first = np.append(0, np.cumsum(own + bare))
        self.doc = np.repeat(np.arange(len(docs)), own + bare)
        self.fit = ~bare[self.doc]
        self.a, self.b, self.start, self.end = np.zeros((4, len(self.doc)), dtype=np.int64)
        self.a[self.fit], self.b[self.fit] = runs
        self.start[self.fit], self.end[self.fit] = words[word[runs[0]]], word_ends[word[runs[1] + 1] - 1]
        self.start[~self.fit], self.end[~self.fit] = begin[bare], (begin + size)[bare]
        self.place = np.arange(len(self.doc)) - self.first[self.doc]
        self.text = np.append(begin, n)

    def hashes(self) -> np.ndarray:
        """A 64-bit hash of each chunk's bytes."""
        return kernel.span_hashes(np.frombuffer(self.data, dtype=np.uint8), self.start, self.end)

    def without(self, doc: int, gone: Collection[int]) -> bytes:
        """The text of ``doc`` without the chunks of these places; a line that has lost its end keeps its newline."""
        at, kept = int(self.text[doc]), []
        chunks = self.first[doc] + np.sort(np.fromiter(gone, dtype=np.int64, count=len(gone)))
        # both bounds of chunks ascend, so runs that meet are neighbours
        a, b = self.a[chunks], self.b[chunks]
        apart = np.flatnonzero(a[1:] > b[:-1] + 1)
        for start, end in zip(self.open[np.append(a[:1], a[apart + 1])].tolist(), self.shut[np.append(b[apart], b[-1:])].tolist()):
            if start > at:
                kept.append(self.data[at:start])
                if self.data[start - 1] != 10 and self.data.find(b"\n", start, end) >= 0:
                    kept.append(b"\n")
            at = end
        kept.append(self.data[at : int(self.text[doc + 1])])
        return b"".join(kept).removesuffix(b"\n")


def _repeats(base: DataFrame, min_lines: int, min_words: int) -> DataFrame:
    """(row, twin, gone): the places of the chunks to remove from each text that has any."""

    def hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, raw in kernel.blocks(batch.column(0), lower=False):
                c = Chunks(raw, min_lines, min_words)
                yield pa.RecordBatch.from_arrays([pa.array(c.hashes()[c.fit].view(np.int64))], names=["h"])

    often = durable(base.select("text").mapInArrow(hashes, "h long").groupBy("h").agg(F.count("*").alias("k")).where("k > 1"))
    number, total = often.agg(F.count("*"), F.sum("k")).first()
    words = 1 << (min(MOST_BITS, max(LEAST_BITS, (16 * number).bit_length())) - 6)
    # fewer than HOT hashes, each of more than one in HOT of the chunks that repeat
    hot = np.sort(np.array([r.h for r in often.where(F.col("k") * HOT > F.lit(total or 0)).select("h").collect()], dtype=np.int64).view(np.uint64))
    bits = often.groupBy(F.expr(f"shiftrightunsigned(h, 6) & {words - 1}L").alias("w")).agg(F.expr("bit_or(shiftleft(1L, cast(h & 63 as int)))").alias("bits")).toArrow()
    table = np.zeros(words, dtype=np.uint64)
    table[bits["w"].to_numpy()] = bits["bits"].to_numpy().view(np.uint64)
    shared = base.sparkSession.sparkContext.broadcast(table)

    def chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, raw in kernel.blocks(batch.column(3), lower=False):
                c = Chunks(raw, min_lines, min_words)
                found = np.flatnonzero(c.fit)
                h = c.hashes()[found]
                let = (shared.value[(h >> np.uint64(6)) & np.uint64(words - 1)] >> (h & np.uint64(63))) & np.uint64(1) == 1
                found, h = found[let], h[let]
                body = b"".join(blake2b(c.data[i:j], digest_size=16).digest() for i, j in zip(c.start[found].tolist(), c.end[found].tolist()))
                x, y = np.frombuffer(body, dtype=np.int64).reshape(-1, 2).T
                # a chunk that a text repeats in itself is one row, with its later places
                order = np.lexsort((c.place[found], y, x, c.doc[found]))
                doc, x, y, place = c.doc[found][order], x[order], y[order], c.place[found][order]
                new = np.append(True, (doc[1:] != doc[:-1]) | (x[1:] != x[:-1]) | (y[1:] != y[:-1]))[: len(order)]
                firsts = np.flatnonzero(new)
                more = pa.ListArray.from_arrays(pa.array(np.append(firsts - np.arange(len(firsts)), len(order) - len(firsts)), pa.int32()), pa.array(place[~new], pa.int64()))
                rows = pa.array(at + doc[new])
                row = batch.column(1).take(rows)
                salt = np.where(np.isin(h[order][new], hot), 1 + (row.to_numpy() & 0xFFFF), 0)
                yield pa.RecordBatch.from_arrays([batch.column(0).take(rows), row, batch.column(2).take(rows), pa.array(place[new], pa.int64()), more, pa.array(x[new]), pa.array(y[new]), pa.array(salt, pa.int64())], names=["id", "row", "twin", "place", "more", "x", "y", "salt"])

    kind = dict(base.dtypes)["id"]
    # all that follows reads one shuffle, so it takes all its columns and the same rows
    found = base.select("id", "row", "twin", "text").mapInArrow(chunks, f"id {kind}, row long, twin long, place long, more array<long>, x long, y long, salt long").where("row is not null and twin is not null and x is not null and y is not null and salt is not null").repartition("x", "y", "salt")
    least, number = F.min(F.struct("id", "row", "twin", "place")), F.sum(F.size("more") + 1)
    same = Window.partitionBy("x", "y", "salt")
    told = found.select("*", least.over(same).alias("keep"), number.over(same).alias("k"))
    if len(hot):
        # a row for each hot hash, or a few where hashes meet; a condition on salt itself would be asked before the shuffle, which would then be another one
        part = found.groupBy("x", "y", "salt").agg(least.alias("keep"), number.alias("k"), F.max("salt").alias("dealt")).where("dealt > 0")
        whole = part.groupBy("x", "y").agg(F.min("keep").alias("first"), F.sum("k").alias("all"))
        told = told.join(F.broadcast(whole), ["x", "y"], "left").withColumns({"keep": F.coalesce("first", "keep"), "k": F.coalesce("all", "k")})
    gone = told.where("k > 1").select("row", "twin", F.when(F.expr("id <=> keep.id and row = keep.row and twin = keep.twin and place = keep.place"), F.col("more")).otherwise(F.array_append("more", F.col("place"))).alias("gone"))
    return gone.where(F.size("gone") > 0).groupBy("row", "twin").agg(F.flatten(F.collect_list("gone")).alias("gone"))


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_lines: int = MIN_LINES, min_words: int = MIN_WORDS) -> DataFrame:
    """``docs`` with every repeated chunk removed from all places but its first.

    First is the least (id, row hash, place); a null id comes first. A chunk has at
    least ``min_lines`` display lines and ``min_words`` words, and chunks overlap. All
    columns stay; the columns _chunks and _removed count chunks (a text too short for
    one counts as one that stays), and the text column holds what is
    left: '' where all was repeated, null where it was null. Texts without a repeated
    chunk come back byte for byte. Rows that are equal in id and text are one place
    and keep the same. An empty table gives no rows. A very long text is cut whole in
    one task, at about 60 bytes a byte. Where ``docs`` has _chunks or _removed, the two added columns,
    which are last, have one more underscore.
    """
    key, twin, lost, n_chunks, n_removed = (free_name(docs, name) for name in ("_row", "_twin", "_gone", "_chunks", "_removed"))
    # two hashes of 64 bits, since one would let two of ten thousand million rows meet
    keyed = docs.withColumn(key, F.xxhash64(id_col, text_col)).withColumn(twin, F.xxhash64(F.lit(1), text_col, id_col))
    base = keyed.select(F.col(id_col).alias("id"), F.col(key).alias("row"), F.col(twin).alias("twin"), F.col(text_col).alias("text"))
    marked = keyed.join(_repeats(base, min_lines, min_words).select(F.col("row").alias(key), F.col("twin").alias(twin), F.col("gone").alias(lost)), [key, twin], "left")

    def rebuild(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names = batch.schema.names
            texts, gone = batch.column(names.index(text_col)), batch.column(names.index(lost))
            lost_here = gone.value_lengths().fill_null(0).to_numpy()
            # handed back block by block: the JVM takes a batch that it reads whole
            for at, raw in kernel.blocks(texts, lower=False):
                out, counts, removed = [], [], []
                c = Chunks(raw, min_lines, min_words)
                for k in range(len(raw)):
                    places = np.unique(gone[at + k].values.to_numpy()) if lost_here[at + k] else ()
                    counts.append(int(c.first[k + 1] - c.first[k]) if raw[k] else 0)
                    removed.append(len(places))
                    if len(places):
                        out.append(c.without(k, places).decode())
                own = batch.slice(at, len(raw))
                changed = pc.replace_with_mask(own.column(names.index(text_col)), pa.array([n > 0 for n in removed], pa.bool_()), pa.array(out, texts.type))
                columns = [changed if name == text_col else own.column(name) for name in names if name != lost]
                yield pa.RecordBatch.from_arrays([*columns, pa.array(counts, pa.int64()), pa.array(removed, pa.int64())], names=[*[x for x in names if x != lost], n_chunks, n_removed])

    order = [*docs.columns, lost]
    schema = ", ".join(f"`{name}` {kind}" for name, kind in docs.dtypes)
    return marked.select(*[F.col(f"`{c}`") for c in order]).mapInArrow(rebuild, f"{schema}, {n_chunks} long, {n_removed} long")
