"""Language identification by error-correcting output codes.

Each language has a codeword of bits. For each bit, a binary classifier over hashed
byte n-grams tells the languages with a 1 from those with a 0: its weights are log
ratios of the two sides' mean n-gram shares, counted over all training texts.
Decoding takes the codeword of least loss; a bit's loss is logistic in its margin
and weighted by how well its classifier separates the languages it was made from.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tideline.llm import kernel

BITS, ORDERS = 13, (2, 3, 4)
#: Mean log ratios times this are the margins that losses see.
SCALE = 12.0
#: Below this lead of the nearest codeword over the next, a text is ambiguous.
LEAD = 0.2
BLOCK = 1 << 20
_LETTERS = bytes(b if b >= 128 or 97 <= b <= 122 or b == 39 else 32 for b in range(256))


def prepare(text: str | None) -> bytes:
    """Lower case between spaces, with ASCII signs and digits as spaces."""
    return b" " + b" ".join((text or "").lower().encode().translate(_LETTERS).split()) + b" "


def codewords(n: int) -> np.ndarray:
    """One row of +1 and -1 a language: all splits of up to 6, else the best of fixed random ones."""
    if n <= 1:
        return np.ones((n, 1))
    if n <= 6:
        # the first language is always 1, so no split comes twice
        splits = np.array([[1, *[1 if s >> k & 1 else -1 for k in range(n - 1)]] for s in range(2 ** (n - 1) - 1)])
        return splits.T.astype(float)
    rng, best, least = np.random.default_rng(11), None, -1
    width = 10 * int(np.ceil(np.log2(n)))
    for _ in range(100):
        code = rng.choice([-1.0, 1.0], size=(n, width))
        code[:, np.abs(code.sum(axis=0)) == n] = np.where(np.arange(n) % 2, 1.0, -1.0)[:, None]
        apart = (width - code @ code.T) / 2 + width * np.eye(n)
        if apart.min() > least:
            best, least = code, apart.min()
    return best


@dataclass
class Model:
    langs: list[str]
    code: np.ndarray
    weights: np.ndarray
    trust: np.ndarray

    def decode(self, docs: list[bytes]) -> tuple[list[str], np.ndarray, np.ndarray]:
        """Language, score and lead of prepared texts."""
        counts = kernel.gram_counts(docs, ORDERS, BITS).astype(np.float32)
        share = counts / np.maximum(counts.sum(axis=1, keepdims=True), 1)
        margin = SCALE * (share @ self.weights)
        loss = np.logaddexp(0, -margin[:, None, :] * self.code[None, :, :]) @ self.trust
        order = np.argsort(loss, axis=1, kind="stable")
        near = np.exp(loss.min(axis=1, keepdims=True) - loss)
        score = 1 / near.sum(axis=1)
        best = order[:, 0]
        lead = np.take_along_axis(loss, order[:, 1:2], axis=1)[:, 0] - loss[np.arange(len(docs)), best] if len(self.langs) > 1 else np.full(len(docs), np.inf)
        return [self.langs[k] for k in best], score, lead


def _counts(training: DataFrame) -> dict[str, np.ndarray]:
    """N-gram counts of each language over all training rows; tables of fixed size, summed in two levels."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[str, np.ndarray] = {}
        for batch in batches:
            langs, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            held: list[int] = []
            size = 0
            for k in range(len(langs) + 1):
                if k == len(langs) or size > BLOCK or len(held) >= kernel.COUNT_ROWS:
                    if held:
                        table = kernel.gram_counts([prepare(texts[j]) for j in held], ORDERS, BITS)
                        own = np.array([langs[j] for j in held])
                        for lang in set(own.tolist()):
                            total[lang] = total.get(lang, 0) + table[own == lang].sum(axis=0)
                    held, size = [], 0
                if k < len(langs):
                    held.append(k)
                    size += len(texts[k] or "")
        task = TaskContext.get().partitionId()
        langs = sorted(total)
        yield pa.RecordBatch.from_arrays([pa.array(langs, pa.string()), pa.array([task] * len(langs), pa.int32()), pa.array([zlib.compress(total[x].astype(np.int64).tobytes(), 1) for x in langs], pa.binary())], names=["lang", "task", "counts"])

    def add(key: tuple, parts: pa.Table) -> pa.Table:
        total = sum(np.frombuffer(zlib.decompress(x.as_py()), dtype=np.int64) for x in parts.column("counts"))
        return pa.table({"lang": pa.array([key[0].as_py()], pa.string()), "task": pa.array([0], pa.int32()), "counts": pa.array([zlib.compress(total.tobytes(), 1)], pa.binary())})

    kind = "lang string, task int, counts binary"
    some = training.select("lang", "text").mapInArrow(count, kind).groupBy("lang", F.expr("task % 64").alias("g")).applyInArrow(add, kind)
    rows = some.groupBy("lang").applyInArrow(add, kind).collect()
    return {r["lang"]: np.frombuffer(zlib.decompress(r["counts"]), dtype=np.int64) for r in rows}


def fit(training: DataFrame) -> Model | None:
    """training: lang and text, without nulls in lang. None if there is nothing to learn."""
    counts = {lang: n for lang, n in _counts(training).items() if n.sum()}
    if not counts:
        return None
    langs = sorted(counts)
    share = np.array([(counts[x] + 0.5) / (counts[x].sum() + 0.5 * (1 << BITS)) for x in langs])
    code = codewords(len(langs))
    if len(langs) == 1:
        return Model(langs, code, np.zeros((1 << BITS, 1), np.float32), np.ones(1))
    side = lambda sign: (code == sign).astype(float).T @ share / (code == sign).sum(axis=0)[:, None]
    weights = np.log(side(1)) - np.log(side(-1))
    # centre each classifier between its two sides, then trust it by the smaller of the languages' margins
    margin = share @ weights.T
    middle = np.array([(margin[code[:, b] == 1, b].min() + margin[code[:, b] == -1, b].max()) / 2 for b in range(code.shape[1])])
    weights = weights - middle[:, None]
    margin = (margin - middle) * code
    trust = np.maximum(margin.min(axis=0), 1e-3)
    return Model(langs, code, weights.T.astype(np.float32), trust / trust.sum() * code.shape[1])


def identify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """The language of every whole text.

    Learns from text and lang of rows with a lang and crc32(id as text) mod 3 not 1; a
    prediction sees the text only. Returns doc_id, held_out, lang_pred, score (0 to
    1, of the nearest codeword among all) and ambiguous (its lead is small). Null texts
    and texts without a letter are ``und`` with score 0, and so is every text if no
    row has a lang. Equal texts, and languages of equal loss, get equal answers (the
    first language by name); repeated rows count each time. A null id is never held
    out. Other columns are not read. An empty table gives no rows. Counting takes 64 KB
    a text for at most COUNT_ROWS texts at a time, however long they are.
    """
    base = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang"))
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1, F.lit(False))
    base = base.withColumn("held_out", held)
    shared = docs.sparkSession.sparkContext.broadcast(fit(base.where("lang is not null and not held_out")))

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import regex

        letter, model = regex.compile(r"\p{L}"), shared.value
        for batch in batches:
            texts = batch.column(2).to_pylist()
            known = [k for k, t in enumerate(texts) if t and model is not None and letter.search(t)]
            lang, score, doubt = ["und"] * len(texts), np.zeros(len(texts)), np.ones(len(texts), dtype=bool)
            held: list[int] = []
            size = 0
            for k in [*known, -1]:
                if held and (k < 0 or size > BLOCK or len(held) >= kernel.COUNT_ROWS):
                    found, s, lead = model.decode([prepare(texts[j]) for j in held])
                    score[held], doubt[held] = np.round(s, 6), lead < LEAD
                    for j, x in zip(held, found):
                        lang[j] = x
                    held, size = [], 0
                held.append(k)
                size += len(texts[k]) if k >= 0 else 0
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(lang, pa.string()), pa.array(score), pa.array(doubt)], names=["doc_id", "held_out", "lang_pred", "score", "ambiguous"])

    kind = dict(docs.dtypes)[id_col]
    return base.select("doc_id", "held_out", "text").mapInArrow(predict, f"doc_id {kind}, held_out boolean, lang_pred string, score double, ambiguous boolean")
