"""Alignment of two tokenizers, each distinct segment once.

1. Texts are cut before white space wherever neither vocabulary can merge across: the
   byte-level pattern starts a pre-token there, or no token of A holds a byte of a word
   before that white space; and no piece of B holds a character of a word before it.
   A vocabulary that fails for a character is not cut before it.
2. Blocks of texts number their own distinct segments. The blocks' segments are dealt by
   segment, so all blocks that hold one meet where it is tokenised and aligned, once:
   tokens of both, and which of them ends at each link. Alignments go back to the blocks
   that asked, packed by block.
3. A block takes links of overlapping tokens and groups between common ends from these,
   composes its documents from numbers, and counts the documents of each linked pair.
   Counts of all blocks are summed by pair and go back to the blocks that hold the pair,
   which sum them over their documents' links.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
import zlib
from array import array
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tideline.llm.bpe import byte_letters
from tideline.llm.cluster import durable, forget

#: Characters of texts in a block (unless one text is longer), and rows that it holds at most.
BLOCK, ROWS = 8_000_000, 65_536
#: Segments of a block in a row of the table that keeps them.
LISTED = 16_384
#: Characters beyond which a text's segments are taken one at a time, and segments that are tokenised, or groups that are named, at a time.
LONG, BATCH = 1_000_000, 4096
#: Segments of blocks that a task packs together.
PACKED = 150_000
#: White space that may be cut before.
SPACES = " \t\n\r"


class Tokenizers:
    """Two tokenizers, read by the driver; what travels is the bytes of their files."""

    def __init__(self, path_a: str, path_b: str):
        from sentencepiece import sentencepiece_model_pb2

        with open(path_a, encoding="utf-8") as f:
            self.spec = f.read()
        with open(path_b, "rb") as f:
            model = sentencepiece_model_pb2.ModelProto.FromString(f.read())
        spec, letters = json.loads(self.spec), byte_letters()
        vocab = spec["model"]["vocab"]
        plain = {i: bytes(letters[c] for c in token) for token, i in vocab.items() if all(c in letters for c in token)}
        self.a = [plain.get(k, b"") for k in range(max(vocab.values()) + 1)]
        kinds = sentencepiece_model_pb2.ModelProto.SentencePiece
        self.b = [bytes([int(p.piece[1:-1], 16)]) if p.type == kinds.BYTE else p.piece.replace("▁", " ").encode() for p in model.pieces]
        # segments hold the space that the model would add
        model.normalizer_spec.add_dummy_prefix = False
        self.model = model.SerializeToString()
        pre = spec.get("pre_tokenizer") or {}
        by_pattern = pre.get("type") == "ByteLevel" and pre.get("use_regex", True)
        inside = lambda tokens, c: any(re.search(rb"[^ \t\n\r]" + re.escape(c.encode()), t) for t in tokens)
        self.cut = "".join(c for c in SPACES if (by_pattern or not inside(self.a, c)) and not inside(self.b, c))

    def load(self) -> Aligner:
        return Aligner(self)


class Splitter:
    """Cuts texts into segments before runs of the white space in ``cut``."""

    def __init__(self, cut: str):
        self.cut = cut
        # white space of other kinds stays inside a segment, with what follows it
        other = rf"[^\S{re.escape(cut)}]"
        self.other, self.plain = re.compile(other), re.compile(r"\s*\S+|\s+")
        self.mixed = re.compile(rf"\s*(?:\S+(?:{other}\s*)?)+|\s+")

    def segments(self, text: str) -> Iterator[str]:
        if not self.cut:
            return iter([text])
        pattern = self.mixed if self.other.search(text) else self.plain
        return iter(pattern.findall(text)) if len(text) <= LONG else (m.group() for m in pattern.finditer(text))


class Aligner:
    """Tokenises and aligns segments."""

    def __init__(self, tokenizers: Tokenizers):
        # a task has one core
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        import sentencepiece
        from tokenizers import Tokenizer

        self.one = Tokenizer.from_str(tokenizers.spec)
        self.one.no_truncation()
        self.one.no_padding()
        # strings of special tokens are plain text
        self.one.encode_special_tokens = True
        self.two = sentencepiece.SentencePieceProcessor(model_proto=tokenizers.model)
        self.a, self.b = tokenizers.a, tokenizers.b

    def encode(self, segments: list[str]) -> tuple[list[list[int]], list[list[int]]]:
        return [x.ids for x in self.one.encode_batch(segments, add_special_tokens=False)], self.two.encode(segments, num_threads=1)

    def align(self, segment: str, a: list[int], b: list[int]) -> bytes:
        """What ends where each link ends: 1 for a token of A, 2 of B, 3 for both and so for a group; nothing if either loses bytes."""
        one, two = [self.a[i] for i in a], [self.b[i] for i in b]
        raw = segment.encode()
        if b"".join(one) != raw or b"".join(two) != raw:
            return b""
        steps = bytearray()
        i = j = 0
        end_a, end_b = len(one[0]), len(two[0])
        while True:
            if end_a == end_b:
                steps.append(3)
                i, j = i + 1, j + 1
                if i == len(a):
                    return bytes(steps)
                end_a, end_b = end_a + len(one[i]), end_b + len(two[j])
            elif end_a < end_b:
                steps.append(1)
                i += 1
                end_a += len(one[i])
            else:
                steps.append(2)
                j += 1
                end_b += len(two[j])


class Numbers(dict):
    """Numbers what it is asked for, from 0."""

    def __missing__(self, key: str) -> int:
        n = self[key] = len(self)
        return n


def squeeze(x: np.ndarray) -> bytes:
    """Whole numbers as bytes, plane by plane: the high bytes of small numbers cost next to nothing."""
    return zlib.compress(np.ascontiguousarray(x.astype(np.uint32)).view(np.uint8).reshape(-1, 4).T.tobytes(), 1)


def unsqueeze(raw: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(zlib.decompress(raw), dtype=np.uint8).reshape(4, -1).T).view(np.uint32).reshape(-1)


def spread(begin: np.ndarray, n: np.ndarray) -> np.ndarray:
    """The places of runs one after another, n of them from each begin."""
    return np.repeat(begin - np.cumsum(n) + n, n) + np.arange(n.sum())


def _blocks(docs: DataFrame, cut: str) -> DataFrame:
    """block, ids (of its rows), sizes and codes (segments of its rows by number); then rows of block, first (number) and segments (distinct)."""
    kind = dict(docs.dtypes)["doc_id"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, n = TaskContext.get().partitionId(), 0
        split = Splitter(cut)
        ids, sizes, codes, numbers, held = [], [], [], Numbers(), 0

        def row(own: pa.Array, sizes: bytes | None, codes: bytes | None, first: int | None, segments: list[str] | None) -> pa.RecordBatch:
            return pa.RecordBatch.from_pydict({
                "block": pa.array([task << 32 | n], pa.int64()),
                "ids": own,
                "sizes": pa.array([sizes], pa.binary()),
                "codes": pa.array([codes], pa.binary()),
                "first": pa.array([first], pa.int32()),
                "segments": pa.array([segments], pa.list_(pa.string())),
            })

        def ready() -> Iterator[pa.RecordBatch]:
            nonlocal n, held, numbers
            own = pa.concat_arrays(ids)
            own = pa.ListArray.from_arrays(pa.array([0, len(own)], pa.int32()), own)
            yield row(own, squeeze(np.array(sizes)), squeeze(np.concatenate(codes)), None, None)
            for x in (ids, sizes, codes):
                x.clear()
            segments = iter(numbers)
            for first in range(0, len(numbers), LISTED):
                yield row(pa.nulls(1, own.type), None, None, first, list(islice(segments, LISTED)))
            n, held, numbers = n + 1, 0, Numbers()

        for batch in batches:
            for k, value in enumerate(batch.column(1)):
                text = value.as_py()
                if sizes and (held + len(text or "") > BLOCK or len(sizes) >= ROWS):
                    yield from ready()
                ids.append(batch.column(0).slice(k, 1))
                own = np.fromiter(map(numbers.__getitem__, split.segments(" " + text)), dtype=np.uint32) if text else np.empty(0, dtype=np.uint32)
                sizes.append(len(own))
                codes.append(own)
                held += len(text or "")
        if sizes:
            yield from ready()

    return docs.select("doc_id", "text").mapInArrow(run, f"block long, ids array<{kind}>, sizes binary, codes binary, first int, segments array<string>")


def _aligned(held: DataFrame, tokenizers: Tokenizers) -> DataFrame:
    """Of (home, pos, segment): each distinct segment aligned once, and sent to its homes packed: home, numbers, ids, ends.

    numbers: steps of pos, tokens of A and of B and links (all 0 if a tokenizer loses bytes), one
    row each. ids: the segments' tokens of A, then of B. ends: what ends at each link.
    """
    shared = held.sparkSession.sparkContext.broadcast(tokenizers)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner = shared.value.load()
        homes, rows, size = [], [], 0
        # of the segments aligned so far: numbers of tokens of A and B and of links; these, flat
        facts, flat = array("q"), (array("I"), array("I"), array("B"))
        last = None

        def align(segments: list[str]) -> None:
            for at in range(0, len(segments), BATCH):
                part = segments[at : at + BATCH]
                for segment, a, b in zip(part, *aligner.encode(part)):
                    ends = aligner.align(segment, a, b)
                    for known, own in zip(flat, (a, b, ends) if ends else ((), (), ())):
                        known.extend(own)
                        facts.append(len(own))

        def packed() -> Iterator[pa.RecordBatch]:
            nonlocal size, facts, flat
            if not rows:
                return
            home, (pos, which) = np.concatenate(homes), np.concatenate(rows, axis=1)
            order = np.lexsort((pos, home))
            home, pos, which = home[order], pos[order], which[order]
            known, every = np.array(facts).reshape(-1, 3), [np.array(x) for x in flat]
            begin = np.cumsum(known, axis=0) - known
            cuts = np.flatnonzero(np.diff(home, prepend=home[0] - 1))
            for low, high in zip(cuts.tolist(), [*cuts[1:].tolist(), len(home)]):
                own = which[low:high]
                a, b, ends = (x[spread(begin[own, k], known[own, k])] for k, x in enumerate(every))
                yield pa.RecordBatch.from_arrays([
                    pa.array([int(home[low])], pa.int64()),
                    pa.array([squeeze(np.concatenate([np.diff(pos[low:high], prepend=0), known[own].T.ravel()]))], pa.binary()),
                    pa.array([squeeze(np.concatenate([a, b]))], pa.binary()),
                    pa.array([zlib.compress(ends.tobytes(), 1)], pa.binary()),
                ], names=["home", "numbers", "ids", "ends"])
            homes.clear()
            rows.clear()
            size, facts, flat = 0, array("q"), (array("I"), array("I"), array("B"))

        for batch in batches:
            coded = batch.column(2).dictionary_encode()
            found, which = coded.dictionary.to_pylist(), coded.indices.to_numpy()
            if size + len(which) > PACKED:
                yield from packed()
                last = None
            # rows are sorted by segment, so the first may be the one before
            base = len(facts) // 3 - (found[0] == last)
            align(found[found[0] == last :])
            homes.append(batch.column(0).to_numpy())
            rows.append(np.stack([batch.column(1).to_numpy().astype(np.int64), which + base]))
            size += len(which)
            last = found[-1]
        yield from packed()

    dealt = held.repartition("segment").sortWithinPartitions("segment")
    return dealt.mapInArrow(run, "home long, numbers binary, ids binary, ends binary")


def _named(one: np.ndarray, two: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[str]]:
    """Of tokens of A and B and what ends at each link: the distinct pairs (A id << 32 | B id), each link's number in them, each group's in the names of all."""
    at_a, at_b = (np.cumsum(x, dtype=np.int32) - x for x in (ends & 1, ends >> 1))
    links = one[at_a].astype(np.int64)
    links <<= 32
    links |= two[at_b]
    pairs, number = np.unique(links), np.empty(len(links), dtype=np.int32)
    # in pieces: an inverse of all at once takes several times what the links take
    for at in range(0, len(links), LONG):
        number[at : at + LONG] = np.searchsorted(pairs, links[at : at + LONG])
    del links
    last = np.flatnonzero(ends == 3)
    first = np.concatenate(([0], last[:-1] + 1)) if len(last) else last
    # a group of one link is named as its pair is
    code, names = number[last], [f"{p >> 32}|{p & 0xFFFFFFFF}" for p in pairs.tolist()]
    more = Numbers()
    longer = np.flatnonzero(first < last)
    for at in range(0, len(longer), BATCH):
        part = longer[at : at + BATCH]
        for k, a, b, c, d in zip(part.tolist(), *(x[y[part]].tolist() for x in (at_a, at_b) for y in (first, last))):
            text = ",".join(map(str, one[a : b + 1].tolist())) + "|" + ",".join(map(str, two[c : d + 1].tolist()))
            code[k] = len(pairs) + more[text]
    names.extend(more)
    return pairs, number, code, names


def _composed(blocks: DataFrame, aligned: DataFrame, kind: str, with_groups: bool) -> DataFrame:
    """One row a block: what its documents are made of, the pairs that they hold and by how many documents each.

    sums has tokens of A and of B, groups and links of every document; documents' pairs are
    places in ``pairs`` (spots, ``held`` of them a document) with their numbers (times).
    """

    def run(block: pa.Table, parts: pa.Table) -> pa.Table:
        facts, one, two, ends = [np.zeros((4, 0), dtype=np.int64)], [], [], [np.zeros(0, dtype=np.uint8)]
        for numbers, tokens, links in zip(*[parts.column(c).to_pylist() for c in ("numbers", "ids", "ends")]):
            own, tokens = unsqueeze(numbers).astype(np.int64).reshape(4, -1), unsqueeze(tokens)
            own[0] = np.cumsum(own[0])
            facts.append(own)
            cut = own[1].sum()
            one.append(tokens[:cut])
            two.append(tokens[cut:])
            ends.append(np.frombuffer(zlib.decompress(links), dtype=np.uint8))
        facts, ends = np.concatenate(facts, axis=1), np.concatenate(ends)
        pairs, number, code, names = _named(*(np.concatenate(x) if x else np.zeros(0, dtype=np.uint32) for x in (one, two)), ends)
        order = np.argsort(facts[0])
        n = facts[3]
        after = np.concatenate(([0], np.cumsum(ends == 3)))
        last = np.cumsum(n)
        start, group = (last - n)[order], after[last - n][order]
        each = np.stack([facts[1], facts[2], after[last] - after[last - n], n])[:, order]
        del facts, one, two, ends, after
        total = np.zeros(len(pairs), dtype=np.int64)
        ids = block.column("ids").combine_chunks()
        sizes, codes = (unsqueeze(block.column(c)[0].as_py()) for c in ("sizes", "codes"))
        ends = np.cumsum(sizes.astype(np.int64))
        sums = np.zeros((4, len(sizes)), dtype=np.int64)
        digest, text = [""] * len(sizes), [""] * len(sizes)
        held, spots, times = np.zeros(len(sizes), dtype=np.int64), [], []
        for k, (end, size) in enumerate(zip(ends.tolist(), sizes.tolist())):
            own, often = np.unique(codes[end - size : end], return_counts=True)
            if not size or not each[2, own].all():
                continue
            sums[:, k] = each[:, own] @ often
            whole, pieces = hashlib.sha256(), []
            for at in range(end - size, end, LONG):
                own_codes = codes[at : min(end, at + LONG)]
                piece = ";".join([names[g] for g in code[spread(group[own_codes], each[2, own_codes])].tolist()])
                whole.update(piece.encode() if at == end - size else b";" + piece.encode())
                pieces.append(piece)
            digest[k] = whole.hexdigest()
            if with_groups:
                text[k] = ";".join(pieces)
            n = each[3, own]
            spot, at = np.unique(number[spread(start[own], n)], return_inverse=True)
            total[spot] += 1
            held[k] = len(spot)
            spots.append(spot)
            times.append(np.bincount(at, np.repeat(often, n)).astype(np.uint32))
        used = np.flatnonzero(total)
        place = np.zeros(len(pairs), dtype=np.int32)
        place[used] = np.arange(len(used))
        # differences of ascending places are small
        spots = np.concatenate([np.diff(place[s], prepend=0) for s in spots]) if spots else np.zeros(0)
        row = {
            "home": block.column("block"),
            "ids": ids,
            "sums": pa.array([sums.tobytes()], pa.binary()),
            "digests": pa.array([digest], pa.list_(pa.string())),
            "texts": pa.array([text if with_groups else []], pa.list_(pa.string())),
            "held": pa.array([squeeze(held)], pa.binary()),
            "spots": pa.array([squeeze(spots)], pa.binary()),
            "times": pa.array([squeeze(np.concatenate(times) if times else np.zeros(0))], pa.binary()),
            "pairs": pa.array([pairs[used]], pa.list_(pa.int64())),
            "counts": pa.array([total[used]], pa.list_(pa.int64())),
        }
        return pa.table(row)

    left = blocks.where("codes is not null").select("block", "ids", "sizes", "codes").groupBy("block")
    return left.cogroup(aligned.groupBy("home")).applyInArrow(run, f"home long, ids array<{kind}>, sums binary, digests array<string>, texts array<string>, held binary, spots binary, times binary, pairs array<long>, counts array<long>")


def _finished(composed: DataFrame, ranked: DataFrame, kind: str, with_groups: bool) -> DataFrame:
    """The documents of every block; ranked: block, place, count and best of each of its pairs."""

    def run(block: pa.Table, parts: pa.Table) -> pa.Table:
        ids = block.column("ids").combine_chunks().flatten()
        sums = np.frombuffer(block.column("sums")[0].as_py(), dtype=np.int64).reshape(4, -1)
        held, step, times = (unsqueeze(block.column(c)[0].as_py()).astype(np.int64) for c in ("held", "spots", "times"))
        place = parts.column("place").to_numpy()
        facts = np.zeros((2, len(place)), dtype=np.int64)
        facts[:, place] = [parts.column("best").to_numpy(), parts.column("count").to_numpy()]
        first = np.cumsum(held) - held
        # ascending places again: running sums that start anew with every document
        run_ = np.cumsum(step)
        before = np.concatenate(([0], run_))[first]
        spot = run_ - np.repeat(before, held)
        every = np.concatenate((np.zeros((2, 1), dtype=np.int64), np.cumsum(facts[:, spot] * times, axis=1)), axis=1)
        best, count = every[:, first + held] - every[:, first]
        columns = {"doc_id": ids} | {c: pa.array(v) for c, v in zip(("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum"), (*sums, best, count))}
        columns["groups_sha256"] = block.column("digests").combine_chunks().flatten()
        return pa.table(columns | ({"groups": block.column("texts").combine_chunks().flatten()} if with_groups else {}))

    left = composed.select("home", "ids", "sums", "digests", "texts", "held", "spots", "times").groupBy("home")
    return left.cogroup(ranked.groupBy("block")).applyInArrow(run, f"doc_id {kind}, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string{', groups string' if with_groups else ''}")


def align_tokenizers(docs: DataFrame, path_a: str, path_b: str, id_col: str = "doc_id", text_col: str = "text", with_groups: bool = True) -> DataFrame:
    """Align the tokens that two tokenizers make of every whole text, behind one space.

    path_a: a byte-level BPE file of the tokenizers library. path_b: a sentencepiece
    model that adds a space itself. Strings of special tokens are plain text. Returns
    doc_id, n_a, n_b, n_groups, n_links (pairs of tokens whose bytes overlap), n_best
    (links whose pair is held by as many documents as any of its A id, ties included),
    count_sum (those documents, over all links), groups_sha256 and, unless left out,
    groups (``a1,a2|b1;a3|b2,b3``). Null and empty texts, and texts that either
    tokenizer does not give back byte by byte, have zeros and empty strings and count
    for no pair. Repeated rows are documents of their own. Other columns are not read;
    an empty table gives no rows. A long text is a block of its own: about 30 bytes for
    each of its words and what its distinct segments take; one long word is one segment.
    """
    tokenizers = Tokenizers(path_a, path_b)
    kind = dict(docs.dtypes)[id_col]
    blocks = durable(_blocks(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")), tokenizers.cut))
    held = blocks.select(F.col("block").alias("home"), "first", F.posexplode("segments").alias("at", "segment")).select("home", (F.col("first") + F.col("at")).alias("pos"), "segment")
    composed = durable(_composed(blocks, _aligned(held, tokenizers), kind, with_groups))
    forget(blocks)
    pairs = composed.select(F.col("home").alias("block"), F.posexplode(F.arrays_zip("pairs", "counts")).alias("place", "_p")).select("block", "place", F.col("_p.pairs").alias("pair"), F.col("_p.counts").alias("n"))
    first = F.expr("shiftright(pair, 32)")
    counts = durable(pairs.groupBy("pair").agg(F.sum("n").alias("count")).withColumn("a", first))
    best = counts.groupBy("a").agg(F.max("count").alias("most"))
    ranked = counts.join(best, "a").select("pair", "count", (F.col("count") == F.col("most")).cast("long").alias("best"))
    # a block has a pair once, so no pair is a hot key
    return _finished(composed, pairs.select("block", "place", "pair").join(ranked, "pair").select("block", "place", "count", "best"), kind, with_groups)
