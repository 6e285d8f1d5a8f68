"""Byte-level BPE with forced boundaries.

A merge joins two tokens into a longer one, so two bytes that stand side by side
in no token of the vocabulary are never merged into one: the cut between them is
certain. Pre-tokens are cut there, the fragments are encoded independently and
their ids concatenated. Texts are taken in runs; the distinct pre-tokens of a run
that are not remembered are merged side by side, a merge of each fragment at a time.
"""

from __future__ import annotations

import codecs
import hashlib
import heapq
import itertools
import json
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Fixed value: the public pre-token pattern of byte-level BPE.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Pre-tokens in each of the two generations that a worker remembers (about 80 MB).
REMEMBERED = 100_000
#: Characters of the texts whose pre-tokens are looked up together, unless one text has more.
TOGETHER = 200_000
#: Bytes of a fragment beyond which it is merged by a heap of its own.
WIDE = 48
#: Characters of a text beyond which its pre-tokens are taken so many at a time.
LONG, PIECE = 1_000_000, 100_000


#: Above each rank and merged id.
NEVER = (1 << 63) - 1


def byte_letters() -> dict[str, int]:
    """The printable letter of each byte, inverted: visible Latin-1 stands for itself, the rest follows from U+0100."""
    shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(hidden)}


class Vocabulary:
    """What a tokenizer file says: bytes of each id, ranks of merges and certain cuts."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        letters = byte_letters()
        raw = lambda token: bytes(letters[c] for c in token)
        vocab = spec["model"]["vocab"]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.bytes = {i: raw(token) for token, i in vocab.items() if token not in self.special}
        self.bytes |= {i: token.encode() for token, i in self.special.items()}
        self.single = [0] * 256
        for i, b in self.bytes.items():
            if len(b) == 1:
                self.single[b[0]] = i
        #: pair of ids as one number -> rank and merged id as one number
        self.merges: dict[int, int] = {}
        for rank, merge in enumerate(spec["model"]["merges"]):
            a, b = merge if isinstance(merge, list) else merge.split(" ")
            self.merges.setdefault(vocab[a] << 32 | vocab[b], rank << 32 | vocab[a + b])
        inside = bytearray(1 << 16)
        for token, i in vocab.items():
            b = self.bytes[i]
            for x, y in zip(b, b[1:]):
                inside[x << 8 | y] = 1
        self.inside = bytes(inside)
        # the merges once more, for many pairs at a time
        self.pairs, self.merged = np.array(sorted(self.merges.items()), dtype=np.int64).reshape(-1, 2).T.copy()

    def fragments(self, raw: bytes) -> list[bytes]:
        """``raw`` cut between bytes that no token holds side by side."""
        inside, start, out = self.inside, 0, []
        for k in range(1, len(raw)):
            if not inside[raw[k - 1] << 8 | raw[k]]:
                out.append(raw[start:k])
                start = k
        out.append(raw[start:])
        return out

    def merge(self, raw: bytes) -> list[int]:
        """Ids of one fragment: the merge of least rank first, leftmost among equals."""
        ids = [self.single[b] for b in raw]
        return self._few(ids) if len(ids) <= WIDE else self._many(ids)

    def _ranks(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """What ``merges`` has for each pair, else NEVER."""
        if not len(self.pairs):
            return np.full(len(a), NEVER)
        pair = a << 32 | b
        at = np.minimum(np.searchsorted(self.pairs, pair), len(self.pairs) - 1)
        return np.where(self.pairs[at] == pair, self.merged[at], NEVER)

    def encode(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all words (none is empty) on end, and how many each has: ``merge`` of their fragments, side by side."""
        size = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
        begin = np.cumsum(size) - size
        data = b"".join(words)
        buf = np.frombuffer(data, dtype=np.uint8).astype(np.int64)
        cut = np.append(True, np.frombuffer(self.inside, dtype=np.uint8)[buf[:-1] << 8 | buf[1:]] == 0)[: len(buf)]
        cut[begin] = True
        first = np.flatnonzero(cut)
        length = np.diff(np.append(first, len(buf)))
        # an id stands where its bytes begin
        out = np.full(len(buf), -1, dtype=np.int64)
        for k in np.flatnonzero(length > WIDE).tolist():
            ids = self.merge(data[first[k] : first[k] + length[k]])
            out[first[k] : first[k] + len(ids)] = ids
        place = np.flatnonzero(np.repeat(length <= WIDE, length))
        ids, own = np.array(self.single, dtype=np.int64)[buf[place]], np.repeat(np.arange(len(first)), length)[place]
        # the rank of each id with the next one of its fragment
        rank = np.full(len(ids), NEVER)
        near = np.flatnonzero(own[:-1] == own[1:])
        rank[near] = self._ranks(ids[near], ids[near + 1])
        while len(ids):
            head = np.flatnonzero(np.append(True, own[1:] != own[:-1]))
            best = np.repeat(np.minimum.reduceat(rank, head), np.diff(np.append(head, len(ids))))
            done = best == NEVER
            out[place[done]] = ids[done]
            at = np.flatnonzero((rank == best) & ~done)
            at = at[np.append(True, own[at[1:]] != own[at[:-1]])[: len(at)]]
            ids[at] = rank[at] & 0xFFFFFFFF
            stay = ~done
            stay[at + 1] = False
            moved = np.cumsum(stay) - 1
            at, ids, place, own, rank = moved[at], ids[stay], place[stay], own[stay], rank[stay]
            rank[at] = NEVER
            for left in (at[at > 0] - 1, at[at < len(ids) - 1]):
                left = left[own[left] == own[left + 1]]
                rank[left] = self._ranks(ids[left], ids[left + 1])
        there = out >= 0
        return out[there], np.add.reduceat(there, begin, dtype=np.int64) if len(words) else size

    def _few(self, ids: list[int]) -> list[int]:
        get, never = self.merges.get, NEVER
        ranks = [get(a << 32 | b, never) for a, b in zip(ids, ids[1:])]
        while ranks and (best := min(ranks)) != never:
            k = ranks.index(best)
            ids[k : k + 2] = [best & 0xFFFFFFFF]
            del ranks[k]
            if k:
                ranks[k - 1] = get(ids[k - 1] << 32 | ids[k], never)
            if k < len(ranks):
                ranks[k] = get(ids[k] << 32 | ids[k + 1], never)
        return ids

    def _many(self, ids: list[int]) -> list[int]:
        n = len(ids)
        after, before, live = list(range(1, n + 1)), list(range(-1, n - 1)), [True] * n
        heap: list[tuple[int, int, int, int]] = []

        def offer(k: int) -> None:
            if k >= 0 and after[k] < n and (m := self.merges.get(ids[k] << 32 | ids[after[k]])) is not None:
                heapq.heappush(heap, (m, k, ids[k], ids[after[k]]))

        for k in range(n - 1):
            offer(k)
        while heap:
            m, k, a, b = heapq.heappop(heap)
            if not live[k] or ids[k] != a or after[k] >= n or ids[after[k]] != b:
                continue
            gone = after[k]
            ids[k], live[gone], after[k] = m & 0xFFFFFFFF, False, after[gone]
            if after[k] < n:
                before[after[k]] = k
            offer(before[k])
            offer(k)
        return [i for i, x in zip(ids, live) if x]


class Codec:
    """Encodes and decodes texts; remembers two generations of a bounded number of pre-tokens."""

    def __init__(self, vocabulary: Vocabulary, remembered: int = REMEMBERED):
        import regex

        self.vocabulary, self.remembered = vocabulary, remembered
        #: pre-token to its ids in decimal, and to the bytes that they decode to; before them the generation before
        self.memo: dict[str, str] = {}
        self.back: dict[str, bytes] = {}
        self.old: tuple[dict[str, str], dict[str, bytes]] = ({}, {})
        self.split, self.each = regex.compile(PATTERN).findall, regex.compile(PATTERN).finditer
        self.part = regex.compile("(" + "|".join(map(regex.escape, sorted(vocabulary.special, key=len, reverse=True))) + ")") if vocabulary.special else None

    def learn(self, lists: Iterable[list[str]]) -> None:
        """Encode the pre-tokens that are not remembered, and decode their ids."""
        if len(self.memo) > self.remembered:
            self.old, self.memo, self.back = (self.memo, self.back), {}, {}
        memo, back, v, missing = self.memo, self.back, self.vocabulary, []
        for token in set().union(*lists).difference(memo):
            if token in self.old[0]:
                memo[token], back[token] = self.old[0][token], self.old[1][token]
            elif token in v.special:
                memo[token], back[token] = str(v.special[token]), v.bytes[v.special[token]]
            else:
                missing.append(token)
        ids, counts = v.encode([token.encode() for token in missing])
        ids, at = ids.tolist(), 0
        text, raw = list(map(str, ids)), list(map(v.bytes.__getitem__, ids))
        for token, end in zip(missing, np.cumsum(counts).tolist()):
            memo[token], back[token] = ",".join(text[at:end]), b"".join(raw[at:end])
            at = end

    def pretokens(self, text: str) -> list[str]:
        if self.part is None or not any(s in text for s in self.vocabulary.special):
            return self.split(text)
        return [t for k, piece in enumerate(self.part.split(text)) if piece for t in ([piece] if k % 2 else self.split(piece))]

    def pieces(self, text: str) -> Iterator[list[str]]:
        """The pre-tokens of a text, those of a long one in several lists."""
        if len(text) <= LONG:
            yield self.pretokens(text)
            return
        for k, part in enumerate(self.part.split(text) if self.part else [text]):
            tokens = iter([part] if part else []) if k % 2 else (m.group() for m in self.each(part))
            while piece := list(itertools.islice(tokens, PIECE)):
                yield piece

    def digests(self, text: str, kept: list[str] | None = None) -> tuple[int, str, str]:
        """Number of ids and SHA-256 of the ids and of the decoded text; ``kept`` gets the ids if given."""

        def learnt() -> Iterator[list[str]]:
            for tokens in self.pieces(text):
                self.learn([tokens])
                yield tokens

        return self._digests(learnt(), kept)

    def all_digests(self, texts: Iterable[str], kept: list[str] | None = None) -> Iterator[tuple[int, str, str]]:
        """``digests`` of each text; what short ones bring is looked up together."""
        held: list[list[str]] = []
        size = 0
        for text in texts:
            if held and (len(text) > LONG or size + len(text) > TOGETHER):
                self.learn(held)
                yield from (self._digests([tokens], kept) for tokens in held)
                held, size = [], 0
            if len(text) > LONG:
                yield self.digests(text, kept)
            else:
                held.append(self.pretokens(text))
                size += len(text)
        self.learn(held)
        yield from (self._digests([tokens], kept) for tokens in held)

    def _digests(self, pieces: Iterable[list[str]], kept: list[str] | None) -> tuple[int, str, str]:
        n, one, two = 0, hashlib.sha256(), hashlib.sha256()
        decode = codecs.getincrementaldecoder("utf-8")("replace").decode
        whole = []
        for tokens in pieces:
            ids = ",".join(map(self.memo.__getitem__, tokens))
            if ids:
                one.update(("," + ids if n else ids).encode())
                n += ids.count(",") + 1
                if kept is not None:
                    whole.append(ids)
            two.update(decode(b"".join(map(self.back.__getitem__, tokens))).encode())
        two.update(decode(b"", True).encode())
        if kept is not None:
            kept.append(",".join(whole))
        return n, one.hexdigest(), two.hexdigest()


def encode_decode(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = True) -> DataFrame:
    """Encode every whole text and decode the ids again.

    path: a byte-level BPE file of the tokenizers library, read by the driver; its
    tables (about 50,000 entries) travel with the task. Strings of added tokens in a
    text become those tokens, as in the library. Returns doc_id, n_tokens, ids
    (decimal, comma-joined; left out unless with_ids), ids_sha256 and decoded_sha256.
    A null text is an empty one: no tokens. Repeated rows are encoded alike; other
    columns are not read; an empty table gives no rows. Of merges of equal rank the
    leftmost comes first, as in the library. A long text is encoded piece by piece and
    its pre-tokens are forgotten like those of others. No shuffle.
    """
    shared = docs.sparkSession.sparkContext.broadcast(Vocabulary(path))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = Codec(shared.value)
        for batch in batches:
            n, text, one, two = [], [], [], []
            for count, ids, back in codec.all_digests((value.as_py() or "" for value in batch.column(1)), text if with_ids else None):
                n.append(count)
                one.append(ids)
                two.append(back)
            columns = {"doc_id": batch.column(0), "n_tokens": pa.array(n, pa.int64())} | ({"ids": pa.array(text, pa.string())} if with_ids else {}) | {"ids_sha256": pa.array(one, pa.string()), "decoded_sha256": pa.array(two, pa.string())}
            yield pa.RecordBatch.from_pydict(columns)

    kind = dict(docs.dtypes)[id_col]
    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, f"doc_id {kind}, n_tokens long, {'ids string, ' if with_ids else ''}ids_sha256 string, decoded_sha256 string")
