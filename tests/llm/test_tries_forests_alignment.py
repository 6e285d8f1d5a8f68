"""The prefix trie, the MinHash forest and the alignment of tokenizers against brute force, on odd rows too."""

import hashlib
import random
import zlib
from collections import Counter, defaultdict

import duckdb
import pytest

from tideline.llm import align, cluster, minhash_forest, prefix_trie, queries

SPACE = " \t\n\x0b\x0c\r"
LONG = "lorem ipsum dolor " * 20_000


def spaced(text):
    out, word = [], ""
    for c in text:
        if c in SPACE:
            out += [word] * bool(word)
            word = ""
        else:
            word += c
    return out + [word] * bool(word)


# the prefix trie


def plain_trie(rows, every):
    turns = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            role, text = role or "", text or ""
            digest = hashlib.sha256(f"{len(role.encode())}:{role}{text}".encode()).digest()
            turns[conv].append((turn is not None, turn or 0, digest, role, text))
    own = {c: [(x[3], x[4]) for x in sorted(v)] for c, v in turns.items()}
    built = {}
    for c, v in own.items():
        h = zlib.crc32(str(c).encode()) % 4 if every else 0
        donor = c - int(abs(c) % every * (1 if c >= 0 else -1)) if every else c
        built[c] = own.get(donor, [])[:h] + v[h:]
    members = defaultdict(set)
    for c, v in built.items():
        for d in range(len(v) + 1):
            members[tuple(v[:d])].add(c)
    children, below = Counter(), defaultdict(lambda: [0, 0])
    for p in members:
        if p:
            children[p[:-1]] += 1
    for p, m in members.items():
        saved = (len(m) - 1) * len(spaced(p[-1][1])) if p else 0
        for d in range(len(p) + 1):
            below[p[:d]][0] += not children[p]
            below[p[:d]][1] += saved
    out = set()
    for p, m in members.items():
        ends = ",".join(str(c) for c in sorted(m) if len(built[c]) == len(p))
        out.add((min(m), len(p), min(members[p[:-1]]) if p else None, len(m), children[p], *below[p], hashlib.sha256(ends.encode()).hexdigest()))
    return out


def trie_rows(df):
    return {(r.conv_id, r.depth, r.parent_conv_id, r.n_convs, r.n_children, r.n_leaves, r.saved_tokens, r.ends_sha256) for r in df.collect()}


def test_trie_matches_a_plain_loop(spark, monkeypatch):
    every = 20
    monkeypatch.setattr(prefix_trie, "NAMED", 5)
    monkeypatch.setattr(prefix_trie, "CHUNK", 3)
    monkeypatch.setattr(prefix_trie, "COPIES", 2)
    rng = random.Random(7)
    rows = [(c, t, rng.choice(["user", "assistant"]), rng.choice(["a", "b c", "", " d\te "])) for c in range(-25, 120) for t in range(rng.choice([0, 1, 2, 3, 5, 9])) if c % 7]
    rows += [(c, t, "user", f"same {t}") for c in range(200, 240) for t in range(4)]
    rows += [(300, t, "user", str(t % 3)) for t in range(37)] + [(301, t, "user", str(t % 3)) for t in range(40)]
    # ties, repeated rows, nulls in every column, a very long text and a conversation of one huge turn repeated
    rows += [(400, 1, "user", "x"), (400, 1, "user", "w"), (400, 1, "user", "x"), (400, None, None, "first"), (401, 0, None, None), (401, 0, "", ""), (None, 0, "user", "lost"), (402, 0, "user", LONG), (403, 0, "user", LONG), (404, 0, "é", "中 😀")] + [(405, 3, "user", "again")] * 9
    df = spark.createDataFrame([(*r, 0, 0) for r in rows], "conv_id long, turn long, role string, text string, conv int, depth int")
    got = prefix_trie.conversation_trie(df, every=every)
    want = plain_trie(rows, every)
    found = trie_rows(got)
    assert found == want and got.count() == len(want)


def test_long_conversations_are_numbered_by_ranges(spark, monkeypatch):
    monkeypatch.setattr(cluster, "HOT", 4)
    rows = [(1, 1000 - t, "user", f"t{t}") for t in range(600)] + [(c, t, "user", f"{c}") for c in range(2, 80) for t in range(3)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = prefix_trie.number_turns(df).where("conv = 1").orderBy("pos").collect()
    assert [r.pos for r in got] == list(range(600))
    assert [bytes(r.digest) for r in got] == [hashlib.sha256(f"4:usert{t}".encode()).digest() for t in range(599, -1, -1)]
    assert trie_rows(prefix_trie.conversation_trie(df)) == plain_trie(rows, 0)


def test_trie_of_nothing(spark):
    df = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert prefix_trie.conversation_trie(df, every=20).count() == 0
    only = spark.createDataFrame([(20, 0, "user", "one two"), (21, 0, "user", "three")], df.schema)
    assert trie_rows(prefix_trie.conversation_trie(only, every=20)) == plain_trie([tuple(r) for r in only.collect()], 20)


# the MinHash forest


def sets_of(texts, n=5):
    out = []
    for t in texts:
        w = spaced((t or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")))
        out.append({tuple(w[k : k + n]) for k in range(len(w) - n + 1)} if len(w) >= n else {tuple(w)} if w else set())
    return out


def plain_components(ids, sets, percent):
    root = list(range(len(ids)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    holders = defaultdict(list)
    for k, s in enumerate(sets):
        for g in s:
            holders[g].append(k)
    shared = Counter((a, b) for v in holders.values() for i, b in enumerate(v) for a in v[:i])
    for (a, b), n in shared.items():
        if 100 * n >= percent * (len(sets[a]) + len(sets[b]) - n):
            root[find(a)] = find(b)
    least = {}
    for k, i in enumerate(ids):
        r = find(k)
        least[r] = i if least.get(r) is None else least[r] if i is None else min(least[r], i)
    return [(i, len(sets[k]), least[find(k)] if sets[k] else i) for k, i in enumerate(ids)]


def mutated(rng, words, rate):
    return [f"m{rng.randrange(10**9)}" if rng.random() < rate else w for w in words]


def near_texts(seed=3):
    """Groups whose pairs lie on both sides of the threshold, short texts, copies, and passages that many share."""
    rng = random.Random(seed)
    passage = [f"p{k}" for k in range(60)]
    texts = []
    for g in range(60):
        base = [f"w{rng.randrange(10**6)}" for _ in range(rng.choice([3, 8, 40, 200, 400]))]
        texts += [" ".join(mutated(rng, base, rate)) for rate in (0, 0.005, 0.01, 0.015, 0.02, 0.03) for _ in range(2)]
        texts.append(" ".join([*base, *passage]))
    return texts


@pytest.mark.parametrize("run, shingles", [(minhash_forest.RUN, minhash_forest.TASK_SHINGLES), (4, 3000)])
def test_forest_matches_brute_force(spark, run, shingles):
    texts = near_texts()
    texts += ["Copy of MANY words here now"] * 30 + ["copy of many\twords  here now", "copy of many words here"]
    rows = [(k * 3 % 1999, t, 0, 0, 0) for k, t in enumerate(texts)]
    rows += [(5000, None, 0, 0, 0), (5001, "", 0, 0, 0), (5002, " \n", 0, 0, 0), (5003, "x", 0, 0, 0), (5004, "X", 0, 0, 0), (5004, "x", 0, 0, 0), (None, "x", 0, 0, 0), (None, "no id and no copy of this", 0, 0, 0), (5005, LONG, 0, 0, 0), (5006, LONG + "tail", 0, 0, 0)]
    df = spark.createDataFrame(rows, "doc_id long, text string, row int, size int, minima int")
    got = [(r.doc_id, r.n_shingles, r.component_id, r.kept) for r in minhash_forest.near_duplicates(df, run=run, task_shingles=shingles).collect()]
    want = [(*x, x[0] == x[2]) for x in plain_components([r[0] for r in rows], sets_of([r[1] for r in rows]), 85)]
    assert Counter(got) == Counter(want)


def test_forest_of_nothing(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert minhash_forest.near_duplicates(df).count() == 0
    assert minhash_forest.near_duplicates(spark.createDataFrame([(1, None), (2, "")], df.schema)).count() == 2


def test_minima_estimate_similarity_and_trees_are_apart():
    rng = random.Random(5)
    met = []
    for _ in range(300):
        both = [rng.randrange(1 << 64) for _ in range(170)]
        import numpy as np

        a, b = (np.array(sorted({*both, *(rng.randrange(1 << 64) for _ in range(15))}), dtype=np.uint64) for _ in range(2))
        low = (minhash_forest.minima(a) == minhash_forest.minima(b)).reshape(minhash_forest.TREES, minhash_forest.DEPTH)
        met.append([low.mean(), low[:, : minhash_forest.BASE].all(axis=1).sum()])
    share, trees = zip(*met)
    assert sum(share) / 300 == pytest.approx(0.85, abs=0.01)
    # at 0.85 a tree keeps two together in 61 %; none of 24 would, once in 8 * 10^9
    assert sum(trees) / 300 == pytest.approx(24 * 0.85**3, rel=0.05) and min(trees) >= 4


def test_a_run_keeps_together_what_links_and_hands_on_a_forest(spark, monkeypatch):
    """One list of 2,000 nodes: as many edges as a forest has, not pairs."""
    rng = random.Random(9)
    base = [f"w{k}" for k in range(120)]
    rows = [(k, " ".join(mutated(rng, base, 0.004))) for k in range(2000)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(8)
    seen = []
    inner = minhash_forest._candidates
    monkeypatch.setattr(minhash_forest, "_candidates", lambda runs, percent: seen.append(inner(runs, percent)) or seen[-1])
    got = [(r.doc_id, r.n_shingles, r.component_id) for r in minhash_forest.near_duplicates(df, run=500).collect()]
    assert Counter(got) == Counter(plain_components([k for k, _ in rows], sets_of([t for _, t in rows]), 85))
    assert seen[0].count() < 24 * len(rows)


# the alignment


@pytest.fixture(scope="module")
def libraries():
    import sentencepiece
    from tokenizers import Tokenizer

    one = Tokenizer.from_file(queries.byte_bpe_path())
    one.encode_special_tokens = True
    two = sentencepiece.SentencePieceProcessor(model_file=queries.piece_bpe_path())
    spell = align.byte_letters()
    bytes_a = lambda i: bytes(spell[c] for c in one.id_to_token(i))
    bytes_b = lambda i: bytes([int(two.id_to_piece(i)[3:-1], 16)]) if two.is_byte(i) else two.id_to_piece(i).replace("▁", " ").encode()
    return one, two, bytes_a, bytes_b


def plain_alignment(libraries, texts):
    one, two, bytes_a, bytes_b = libraries
    held, docs = [], Counter()
    for text in texts:
        a = one.encode(" " + text, add_special_tokens=False).ids if text else []
        b = two.encode(text) if text else []
        raw = (" " + (text or "")).encode()
        at_a, at_b, spot = [], [], 0
        for i in a:
            at_a.append((spot, spot := spot + len(bytes_a(i))))
        spot = 0
        for i in b:
            at_b.append((spot, spot := spot + len(bytes_b(i))))
        if not text or b"".join(map(bytes_a, a)) != raw or b"".join(map(bytes_b, b)) != raw:
            held.append(None)
            continue
        links, j = [], 0
        for (s, e), x in zip(at_a, a):
            while at_b[j][1] <= s:
                j += 1
            k = j
            while k < len(b) and at_b[k][0] < e:
                links.append((x, b[k]))
                k += 1
        groups, i, j = [], 0, 0
        cuts = {e for _, e in at_a} & {e for _, e in at_b}
        for cut in sorted(cuts):
            p, q = i, j
            while p < len(a) and at_a[p][1] <= cut:
                p += 1
            while q < len(b) and at_b[q][1] <= cut:
                q += 1
            groups.append(",".join(map(str, a[i:p])) + "|" + ",".join(map(str, b[j:q])))
            i, j = p, q
        held.append((len(a), len(b), groups, links))
        docs.update(set(links))
    best = Counter()
    for (x, _), n in docs.items():
        best[x] = max(best[x], n)
    zeros = (0, 0, 0, 0, 0, 0, "")
    return [zeros if h is None else (h[0], h[1], len(h[2]), len(h[3]), sum(docs[p] == best[p[0]] for p in h[3]), sum(docs[p] for p in h[3]), hashlib.sha256(";".join(h[2]).encode()).hexdigest()) for h in held]


ODD = ["", None, " ", "  a  b ", "\n\n", "a\n\n b\t\tc \r\n d", "<|endoftext|> and </s> <s>", "a▁b", "x\x00y", "tab\tx\x0bv\x0cf", "nb sp     em　 z", "a.\x1c b\x1d\x1e c", "\u0085 next\u0085 line", "中文 字符 😀 👩‍👩‍👧 é", "it's we'll I'd 'quoted' don't", "12345 3.14 1,000", "a" * 3000, "ﬁ ﬂ ﷺ", "﻿bom", "  lead", "trail  ", "a b c", "🏳️‍🌈 x"]


def aligned_rows(df):
    return Counter((r.doc_id, r.n_a, r.n_b, r.n_groups, r.n_links, r.n_best, r.count_sum, r.groups_sha256) for r in df.collect())


@pytest.mark.parametrize("block", [align.BLOCK, 500])
def test_alignment_matches_the_libraries(spark, sf, libraries, block, monkeypatch):
    monkeypatch.setattr(align, "BLOCK", block)
    rng = random.Random(11)
    texts = [r.text for r in spark.read.parquet(f"{sf}/documents.parquet").select("text").orderBy("doc_id").collect()][:120]
    texts += ODD + ["".join(rng.choice("ab \n\t.'é中 ▁1\x1c") for _ in range(40)) for _ in range(150)] + ["again and again"] * 5 + [LONG[:100_000]]
    rows = [(k, t, 1, 1) for k, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "doc_id long, text string, block int, segment int").repartition(3)
    got = align.align_tokenizers(df, queries.byte_bpe_path(), queries.piece_bpe_path(), with_groups=True)
    want = plain_alignment(libraries, texts)
    assert aligned_rows(got) == Counter((k, *w) for k, w in enumerate(want))
    for r in got.where("n_a > 0").limit(20).collect():
        assert hashlib.sha256(r.groups.encode()).hexdigest() == r.groups_sha256


def test_segments_are_cut_only_where_nothing_merges_across(libraries):
    one, two, _, _ = libraries
    t = align.Tokenizers(queries.byte_bpe_path(), queries.piece_bpe_path())
    assert t.cut == " \t\n"  # a piece of B holds a character before a carriage return
    aligner, split = t.load(), align.Splitter(t.cut)
    rng = random.Random(2)
    for text in [x for x in ODD if x] + ["".join(rng.choice("aB \n\t\r.'é  \x1c\u00859") for _ in range(60)) for _ in range(400)]:
        segments = list(split.segments(" " + text))
        assert "".join(segments) == " " + text
        a, b = aligner.encode(segments)
        assert [i for s in a for i in s] == one.encode(" " + text, add_special_tokens=False).ids
        assert [i for s in b for i in s] == two.encode(text)
    assert list(align.Splitter("").segments("a b")) == ["a b"]


def test_a_vocabulary_that_merges_across_is_not_cut(tmp_path):
    from sentencepiece import sentencepiece_model_pb2

    with open(queries.piece_bpe_path(), "rb") as f:
        model = sentencepiece_model_pb2.ModelProto.FromString(f.read())
    model.pieces[31_000].piece = "e▁"
    changed = tmp_path / "changed.model"
    changed.write_bytes(model.SerializeToString())
    assert " " not in align.Tokenizers(queries.byte_bpe_path(), str(changed)).cut


def test_alignment_of_nothing(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert align.align_tokenizers(df, queries.byte_bpe_path(), queries.piece_bpe_path()).count() == 0
    only = spark.createDataFrame([(1, None), (2, "")], df.schema)
    assert aligned_rows(align.align_tokenizers(only, queries.byte_bpe_path(), queries.piece_bpe_path())) == Counter({(1, 0, 0, 0, 0, 0, 0, ""): 1, (2, 0, 0, 0, 0, 0, 0, ""): 1})


def test_a_blocks_segments_lie_in_small_rows(spark, sf, libraries, monkeypatch):
    monkeypatch.setattr(align, "LISTED", 7)
    monkeypatch.setattr(align, "PACKED", 50)
    rows = [(k, r.text) for k, r in enumerate(spark.read.parquet(f"{sf}/documents.parquet").select("text").limit(30).collect())] + [(-1, None), (-2, "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    cut = align.Tokenizers(queries.byte_bpe_path(), queries.piece_bpe_path()).cut
    split = align.Splitter(cut)
    held = align._blocks(df, cut).collect()
    assert sum(r.codes is not None for r in held) == 1 and max(len(r.segments or "") for r in held) == 7
    listed = [s for r in sorted((r for r in held if r.segments), key=lambda r: r.first) for s in r.segments]
    assert listed == list(dict.fromkeys(s for _, t in rows if t for s in split.segments(" " + t)))
    assert aligned_rows(align.align_tokenizers(df, queries.byte_bpe_path(), queries.piece_bpe_path())) == Counter((i, *w) for (i, _), w in zip(rows, plain_alignment(libraries, [t for _, t in rows])))


def test_memory_of_a_block_of_rare_words():
    """16 million characters of 450,000 words: the most that a worker took, in KB."""
    code = """
import random, re
import pyarrow as pa
from pyspark.sql import SparkSession
from tideline.llm import align, queries
spark = SparkSession.builder.master("local[1]").config("spark.sql.shuffle.partitions", "2").config("spark.ui.enabled", "false").getOrCreate()
def texts(batches):
    rng = random.Random(1)
    words = ["".join(rng.choices("abcdefghijklmnop0123456789", k=8)) for _ in range(450_000)]
    for batch in batches:
        for k in batch.column(0).to_pylist():
            yield pa.RecordBatch.from_pydict({"doc_id": [k], "text": [" ".join(words[k * 5_000 % 450_000 :][:5_000])]})
docs = spark.range(0, 360, 1, 1).mapInArrow(texts, "doc_id long, text string")
path = __import__("tempfile").mkdtemp()
docs.write.parquet(path + "/docs")
spark.stop()
spark = SparkSession.builder.master("local[1]").config("spark.sql.shuffle.partitions", "2").config("spark.ui.enabled", "false").getOrCreate()
align.align_tokenizers(spark.read.parquet(path + "/docs"), queries.byte_bpe_path(), queries.piece_bpe_path(), with_groups=False).write.format("noop").mode("overwrite").save()
most = lambda batches: (pa.RecordBatch.from_pydict({"kb": [int(re.search("VmHWM:\\s+(\\d+)", open("/proc/self/status").read())[1])]}) for _ in batches)
print(spark.range(0, 1, 1, 1).mapInArrow(most, "kb long").first()[0])
"""
    import subprocess
    import sys

    out = subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, check=True, cwd=__file__.rsplit("/tests/", 1)[0])
    assert int(out.stdout.split()[-1]) < 400_000


# the registered queries


@pytest.mark.parametrize("name", ["op11_prefix_trie", "op12_minhash_forest"])
def test_queries_match_sql(spark, sf, name):
    df = queries.queries()[name](spark, sf)
    columns = sorted(df.columns)
    c = duckdb.connect()
    for t in ("documents", "conversations"):
        c.execute(f"create view {t} as select * from '{sf}/{t}.parquet'")
    found = c.execute(queries.oracle_sql()[name])
    at = [d[0] for d in found.description]
    assert Counter(tuple(r[k] for k in columns) for r in df.collect()) == Counter(tuple(r[at.index(k)] for k in columns) for r in found.fetchall())


def test_alignment_query_matches_the_libraries(spark, sf, libraries):
    rows = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()
    got = aligned_rows(queries.queries()["op13_segment_align"](spark, sf))
    assert got == Counter((r.doc_id, *w) for r, w in zip(rows, plain_alignment(libraries, [r.text for r in rows])))
