"""Quality scores by nearest-neighbour voting in a latent-semantic space.

Terms are hashed byte trigrams and a few marks of a text's shape, weighted by
log(1 + count) and by idf over all documents. A bounded sample of labelled texts
gives the latent space (its leading singular vectors) and the voters. Every
document's cosine to every voter is computed, block by block, and the nearest
voters vote with their similarity as weight.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tideline.llm import kernel
from tideline.llm.cluster import free_name

BITS = 12
#: Labelled rows of each label that are fitted on, at most about so many.
VOTERS = 2000
#: The rarer label has at least one in so many of that number, if it has as many rows; its votes are weighted back.
RARER = 8
DIMENSIONS = 64
NEIGHBOURS = 15
#: A vote's weight is similarity to this power.
SHARPNESS = 8
#: Bytes of text in a block, and rows that it holds at most (of COUNT_ROWS).
BLOCK, ROWS = 1 << 18, 64
#: Terms of shape: shares of capitals, symbols and digits, words that repeat the one before, distinct
#: words, word length, length; ten steps each, a value between two steps counts towards both.
SHAPES, STEPS = 7, 10
#: Weight of each shape term against all n-grams of the text together.
SHAPE_WEIGHT = 0.4
TERMS = (1 << BITS) + SHAPES * STEPS

_UPPER = np.zeros(256, dtype=bool)
_UPPER[65:91] = True
_SYMBOL = np.zeros(256, dtype=bool)
_SYMBOL[[*range(33, 44), 47, *range(58, 63), 64, *range(91, 97), *range(123, 127)]] = True
_DIGIT = np.zeros(256, dtype=bool)
_DIGIT[48:58] = True


def terms(docs: list[bytes]) -> np.ndarray:
    """log(1 + count) of every term; an empty text has none."""
    grams = np.log1p(kernel.gram_counts(docs, (3,), BITS).astype(np.float32))
    shape = np.zeros((len(docs), SHAPES * STEPS), dtype=np.float32)
    weight = np.sqrt((grams**2).sum(axis=1))
    for k, raw in enumerate(docs):
        if not raw:
            continue
        buf = np.frombuffer(raw, dtype=np.uint8)
        words = raw.split()
        marks = (
            np.sqrt(_UPPER[buf].mean()),
            np.sqrt(_SYMBOL[buf].mean()),
            np.sqrt(_DIGIT[buf].mean()),
            np.sqrt(sum(map(bytes.__eq__, words, words[1:])) / max(1, len(words))),
            len(set(words)) / max(1, len(words)),
            min(1.0, len(raw) / max(1, len(words)) / 20),
            min(1.0, np.log1p(len(words)) / 12),
        )
        for j, x in enumerate(marks):
            low = min(STEPS - 2, int(x * (STEPS - 1)))
            part = x * (STEPS - 1) - low
            shape[k, j * STEPS + low] += SHAPE_WEIGHT * weight[k] * (1 - part)
            shape[k, j * STEPS + low + 1] += SHAPE_WEIGHT * weight[k] * part
    return np.hstack([grams, shape])


@dataclass
class Model:
    idf: np.ndarray
    axes: np.ndarray
    voters: np.ndarray
    labels: np.ndarray
    prior: float
    #: What a vote of each voter stands for; 1 each if not given.
    stands: np.ndarray | None = None

    def vectors(self, docs: list[bytes]) -> np.ndarray:
        return _unit(_unit(terms(docs) * self.idf) @ self.axes)

    def scores(self, docs: list[bytes]) -> np.ndarray:
        if not len(self.voters):
            return np.full(len(docs), self.prior)
        cosine = self.vectors(docs) @ self.voters.T
        k = min(NEIGHBOURS, cosine.shape[1])
        near = np.argpartition(-cosine, k - 1, axis=1)[:, :k]
        best = np.take_along_axis(cosine, near, axis=1)
        weight = np.maximum(best, 0).astype(np.float64) ** SHARPNESS
        stands = np.ones(len(self.labels)) if self.stands is None else self.stands
        marked = stands * self.labels
        stood, votes = stands[near], marked[near]
        # voters as near as the last one share the places that are left to them
        last = best.min(axis=1, keepdims=True)
        tied = np.flatnonzero((cosine == last).sum(axis=1) > (best == last).sum(axis=1))
        for r in tied.tolist():
            places, here = best[r] == last[r], cosine[r] == last[r]
            stood[r][places], votes[r][places] = stands[here].mean(), marked[here].mean()
        total = (weight * stood).sum(axis=1)
        vote = (weight * votes).sum(axis=1)
        return np.clip(np.where(total > 1e-12, vote / np.maximum(total, 1e-12), self.prior), 0.0, 1.0)


def _unit(x: np.ndarray) -> np.ndarray:
    length = np.sqrt((x**2).sum(axis=1, keepdims=True))
    return (x / np.where(length > 0, length, 1)).astype(np.float32)


def _axes(x: np.ndarray, dimensions: int) -> np.ndarray:
    """Leading right singular vectors, by subspace iteration from a fixed start."""
    dimensions = min(dimensions, *x.shape)
    q = np.random.default_rng(7).standard_normal((x.shape[1], dimensions + 8)).astype(np.float32)
    for _ in range(4):
        q, _ = np.linalg.qr(x.T @ (x @ q))
    _, _, v = np.linalg.svd(x @ q, full_matrices=False)
    return (q @ v.T)[:, :dimensions].astype(np.float32)


def document_frequency(texts: DataFrame) -> tuple[np.ndarray, int]:
    """Documents that have each term, and all documents."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, rows = np.zeros(TERMS, dtype=np.int64), 0
        for batch in batches:
            for _, raw in kernel.blocks(batch.column(0), BLOCK, lower=False, rows=ROWS):
                seen += (terms(raw) > 0).sum(axis=0)
                rows += len(raw)
        yield pa.RecordBatch.from_arrays([pa.array(range(TERMS + 1), pa.int32()), pa.array(np.append(seen, rows))], names=["term", "n"])

    out = np.zeros(TERMS + 1, dtype=np.int64)
    for r in texts.mapInArrow(count, "term int, n long").groupBy("term").agg(F.sum("n").alias("n")).collect():
        out[r.term] = r.n
    return out[:-1], int(out[-1])


def fit(docs: DataFrame, labelled: DataFrame, id_col: str, text_col: str, voters: int = VOTERS) -> Model:
    """labelled: id and label (0 or 1), an id once. At most about ``voters`` ids of each label are fitted on, chosen by a hash of the id.

    Labels keep their proportions, but a label far rarer than the other keeps an eighth of
    ``voters`` (or all its ids), and each of its votes stands for as much less.

    An id on several rows of ``docs`` lends one text, the one of least hash.
    """
    seen, rows = document_frequency(docs.select(text_col))
    idf = (np.log((1 + rows) / (1 + seen)) + 1).astype(np.float32)
    counts = {r.label: r["count"] for r in labelled.groupBy("label").count().collect()}
    total = sum(counts.values())
    if not total:
        return Model(idf, np.zeros((TERMS, 1), np.float32), np.zeros((0, 1), np.float32), np.zeros(0), 0.5)
    prior = counts.get(1, 0) / total
    # the same share of each label keeps the labels' proportions in the vote
    common = min(1.0, voters / max(counts.values()))
    share = {label: min(1.0, max(common, voters / RARER / n)) for label, n in counts.items()}
    bound = F.coalesce(*[F.when(F.col("label") == label, F.lit(math.ceil(s * (1 << 62)))) for label, s in share.items()])
    picked = labelled.where(F.pmod(F.xxhash64("_id"), F.lit(1 << 62)) < bound)
    # at most about twice `voters` narrow rows, by the share above
    found = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text")).join(F.broadcast(picked), "_id")
    chosen = found.groupBy("_id", "label").agg(F.min_by("_text", F.xxhash64("_text")).alias("_text"))

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, raw in kernel.blocks(batch.column(0), BLOCK, lower=False, rows=ROWS):
                x = _unit(terms(raw) * idf)
                index = [np.flatnonzero(r) for r in x]
                yield pa.RecordBatch.from_arrays([batch.column(1).slice(at, len(raw)), batch.column(2).slice(at, len(raw)), pa.array([i.astype(np.uint16).tobytes() for i in index], pa.binary()), pa.array([r[i].astype(np.float16).tobytes() for r, i in zip(x, index)], pa.binary())], names=["id", "label", "at", "x"])

    kind = dict(docs.dtypes)[id_col]
    found = chosen.select("_text", "_id", "label").mapInArrow(features, f"id {kind}, label int, at binary, x binary").collect()
    found.sort(key=lambda r: (r.id, r.at))
    x = np.zeros((len(found), TERMS), dtype=np.float32)
    for k, r in enumerate(found):
        x[k, np.frombuffer(r["at"], np.uint16)] = np.frombuffer(r["x"], np.float16)
    if not len(x):
        return Model(idf, np.zeros((TERMS, 1), np.float32), np.zeros((0, 1), np.float32), np.zeros(0), prior)
    axes = _axes(x, DIMENSIONS)
    return Model(idf, axes, _unit(x @ axes), np.array([float(r.label) for r in found]), prior, np.array([common / share[r.label] for r in found]))


def labels_for_fit(labels: DataFrame, id_col: str, label_col: str) -> DataFrame:
    """One label an id (the commoner, 1 if even) of rows whose crc32(id as text) mod 5 is not 0."""
    known = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull() & (F.crc32(F.col(id_col).cast("string").cast("binary")) % 5 != 0))
    return known.groupBy(F.col(id_col).alias("_id")).agg((F.avg(F.col(label_col).cast("double")) >= 0.5).cast("int").alias("label"))


def score_quality(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", threshold: float = 0.3, voters: int = VOTERS) -> DataFrame:
    """``docs`` with _score (0 to 1, higher: label 1 likelier) and _predicted (1 if score >= threshold).

    Whole texts only are scored from; rows whose crc32(id as text) mod 5 is 0 are never
    learnt from. Null and empty texts, and texts like no voter, get the share of
    label 1 among the labelled rows (0.5 where there are none). Equal texts get
    equal scores, repeated rows each; of voters equally near, beyond the last place, each
    has an equal part in it. All columns stay. An empty table gives no rows. No shuffle
    carries documents but for the sampled ones; a text of any length takes 50 KB beside
    its own bytes, for at most ROWS texts at a time. Where ``docs`` has
    _score or _predicted, the two added columns, which are last, have one more underscore.
    """
    scored, predicted = free_name(docs, "_score"), free_name(docs, "_predicted")
    model = docs.sparkSession.sparkContext.broadcast(fit(docs, labels_for_fit(labels, id_col, label_col), id_col, text_col, voters))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            # handed back block by block: the JVM takes a batch that it reads whole
            for at, raw in kernel.blocks(batch.column(batch.schema.get_field_index(text_col)), BLOCK, lower=False, rows=ROWS):
                s = np.round(model.value.scores(raw), 6)
                yield pa.RecordBatch.from_arrays([*batch.slice(at, len(raw)).columns, pa.array(s, pa.float64()), pa.array((s >= threshold).astype(np.int32))], names=[*batch.schema.names, scored, predicted])

    schema = ", ".join(f"`{name}` {kind}" for name, kind in docs.dtypes)
    return docs.mapInArrow(score, f"{schema}, {scored} double, {predicted} int")
