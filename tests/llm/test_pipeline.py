"""The pipeline's stages, each against what its operator says on the stage's own input."""

from collections import Counter

import corpus_pipeline as C
from pyspark.sql import functions as F

from tideline.llm import bpe, decontaminate, line_dedup, ngram_join, quality, queries


def test_stages(spark, sf, tmp_path):
    assert 4 <= len(C.STAGES) <= 5 and C.ORACLE_SQL is None
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns = docs.columns
    for k, (name, stage) in enumerate(C.STAGES):
        path = str(tmp_path / str(k))
        stage(spark, docs, sf).write.parquet(path)
        out = spark.read.parquet(path)
        ids = sorted(r.doc_id for r in out.select("doc_id").collect())
        before = {r.doc_id: r.text for r in docs.collect()}
        if name == "quality":
            assert ids == sorted(r.doc_id for r in quality.score_quality(docs, spark.read.parquet(f"{sf}/labels.parquet")).where("_predicted = 1").collect())
        elif name == "line_dedup":
            want = {r.doc_id: r for r in line_dedup.dedup_lines(docs).collect()}
            assert ids == sorted(d for d, r in want.items() if not (r._removed and not r.text.strip()))
            assert all(r.text == want[r.doc_id].text and r.n_chars == len(r.text) for r in out.collect())
        elif name == "near_duplicates":
            groups = {r.doc_id: r for r in ngram_join.join_components(docs, 5, 80).collect()}
            assert ids == sorted(d for d, r in groups.items() if not r.n_links or r.component_id == d)
        elif name == "decontamination":
            hit = {r.doc_id for r in decontaminate.find_items(docs, spark.read.parquet(f"{sf}/benchmark.parquet")).collect()}
            assert ids == sorted(set(before) - hit)
        else:
            codec = bpe.Codec(bpe.Vocabulary(queries.byte_bpe_path()))
            assert {r.doc_id: r.n_tokens for r in out.collect()} == {d: codec.digests(t or "")[0] for d, t in before.items()}
        assert k == len(C.STAGES) - 1 or out.columns == columns
        docs = out


def test_run(spark, sf):
    assert C.run(spark, sf).count() > 0


def test_first_stages_keep_columns_with_clashing_names(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").limit(60)
    docs = docs.unionByName(docs.withColumn("doc_id", docs.doc_id + 10**6))
    names = ["_row", "_gone", "_stay", "_score", "_predicted", "_chunks", "_removed"]
    clash = docs.select("*", *[(docs.doc_id + k).alias(n) for k, n in enumerate(names)])
    for _, stage in C.STAGES[:3]:
        want = {r.doc_id: tuple(r) for r in stage(spark, docs, sf).collect()}
        out = stage(spark, clash, sf)
        assert out.columns == clash.columns
        got = out.collect()
        assert {r.doc_id: tuple(r)[: len(docs.columns)] for r in got} == want
        assert all(r[n] == r.doc_id + k for r in got for k, n in enumerate(names))


def test_stages_meet_odd_rows(spark, sf):
    """Nulls in any column, empty and very long texts, ties, repeated rows, clashing names and empty tables."""
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    words = " ".join(f"w{k}" for k in range(60))
    long = "A sentence of eight words stands right here. " * 30_000
    odd = [(None, None, None, None, None), (None, "no id at all", None, None, 12), (901, None, "en", "a", 0), (902, "", "en", "a", 0), (903, " \n\t", "xx", "b", 3)]
    odd += [(904, "x", "en", "a", 1), (904, "x", "en", "a", 1), (904, "x", "en", None, 7), (905, long, "en", "a", len(long)), (906, words, "en", "a", 9), (907, words, "en", "a", 9), (907, words, "de", "a", 9)]
    rows = docs.limit(40).unionByName(spark.createDataFrame(odd, docs.schema))
    clash = rows.select("*", *[F.coalesce("doc_id", F.lit(-1)).alias(n) for n in ("_row", "_twin", "_gone", "_stay", "_score", "_predicted", "_salt", "_hot", "root", "id", "row", "label", "chunks")])
    before = Counter(r.doc_id for r in clash.collect())
    for name, stage in C.STAGES:
        assert stage(spark, clash.limit(0), sf).count() == 0
        out = stage(spark, clash, sf)
        got = out.collect()
        ids = Counter(r.doc_id for r in got)
        assert ids <= before
        if name == "encoding":
            assert ids == before and {r.n_tokens for r in got if r.doc_id in (901, 902)} == {0}
            continue
        assert out.dtypes == clash.dtypes
        assert all(r[c] == (-1 if r.doc_id is None else r.doc_id) for r in got for c in clash.columns[5:])
        if name == "near_duplicates":
            # wordless texts all stay, of each group of copies one row
            assert (ids[901], ids[902], ids[903], ids[904], ids[906], ids[907]) == (1, 1, 1, 1, 1, 0) and ids[None] == 2
        elif name == "line_dedup":
            # repeated rows are one place and keep the same
            kept = {r.text for r in got if r.doc_id == 905}
            # 907 is a copy of 906, of which nothing is left
            assert len(kept) == 1 and len(kept.pop()) < len(long) and ids + Counter({907: 2}) == before
            assert {(r.doc_id, r.text) for r in got if r.doc_id in (901, 902, 904)} == {(901, None), (902, ""), (904, "x")}
        elif name == "decontamination":
            assert all(ids[k] == before[k] for k in (None, 901, 902, 903, 904, 905, 906, 907))
        else:
            assert len({(r.text, r.doc_id) for r in got if r.doc_id == 904}) == (ids[904] > 0) and ids[904] in (0, 3)


def test_memory_of_a_worker_follows_blocks_not_batches():
    """12 MB of texts that come as one batch: the most that a worker took after each of the first four stages, in KB."""
    code = """
import random, re, tempfile
import pyarrow as pa
import corpus_pipeline as C
from pyspark.sql import SparkSession
start = lambda: SparkSession.builder.master("local[1]").config("spark.sql.shuffle.partitions", "2").config("spark.ui.enabled", "false").getOrCreate()
spark = start()
def texts(batches):
    rng = random.Random(1)
    words = ["".join(rng.choices("abcdefghijklmnop", k=6)) for _ in range(20_000)]
    for batch in batches:
        ids = batch.column(0).to_pylist()
        yield pa.RecordBatch.from_pydict({"doc_id": ids, "text": [". ".join(" ".join(rng.choices(words, k=19)) for _ in range(9)) for _ in ids]})
path = tempfile.mkdtemp()
spark.range(0, 9_900, 1, 1).mapInArrow(texts, "doc_id long, text string").write.parquet(path + "/documents.parquet")
spark.range(0, 9_900, 1, 1).selectExpr("id doc_id", "1 quality").write.parquet(path + "/labels.parquet")
spark.createDataFrame([(1, "none of them holds these six words")], "item_id long, text string").write.parquet(path + "/benchmark.parquet")
for name, stage in C.STAGES[:4]:
    spark.stop()
    spark = start()
    stage(spark, spark.read.parquet(path + "/documents.parquet"), path).write.format("noop").mode("overwrite").save()
    most = lambda batches: (pa.RecordBatch.from_pydict({"kb": [int(re.search("VmHWM:\\\\s+(\\\\d+)", open("/proc/self/status").read())[1])]}) for _ in batches)
    print(spark.range(0, 1, 1, 1).mapInArrow(most, "kb long").first()[0])
"""
    import subprocess
    import sys

    out = subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, check=True, cwd=__file__.rsplit("/tests/", 1)[0])
    most = dict(zip((name for name, _ in C.STAGES), map(int, out.stdout.split())))
    assert most.keys() == {"quality", "line_dedup", "near_duplicates", "decontamination"}, most
    assert most["quality"] < 155_000 and most["line_dedup"] < 165_000 and most["near_duplicates"] < 190_000 and most["decontamination"] < 155_000, most
