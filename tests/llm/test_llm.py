"""Operators of tideline.llm against brute force, exact round trips and held-out accuracy.

Each operator also meets nulls, empty and very long texts, ties, repeated rows, empty
tables and extra columns with clashing names.
"""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from tideline.llm import ann, bpe, decontaminate, kernel, lang_id, license_scan, line_dedup, ngram_join, quality, queries, shard, url_filter

ALNUM = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
SPACED = re.compile(rb"[^\x20\x09-\x0D]+")
LONG = "lorem ipsum dolor " * 40_000
ODD = [(None, "no id"), (901, None), (902, ""), (903, " \n\t"), (904, "x"), (904, "x"), (905, "é ß 中 😀"), (906, LONG), (907, "CC BY"), (908, "cc\x00by all. RIGHTS reserved")]


@pytest.fixture(scope="module")
def docs(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet")


@pytest.fixture(scope="module")
def odd(spark):
    rows = [(k, t, "en", None, 0, 7, 8, 9) for k, t in ODD]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, _row int, labels int, score int")


def rows_of(df, key="doc_id"):
    return {r[key]: r for r in df.collect()}


def words(text, pattern):
    return pattern.findall((text or "").encode().lower())


# the kernel


def test_block_words_and_shingles():
    rng = random.Random(1)
    texts = ["".join(rng.choice("aB1é \n\t.,中") for _ in range(rng.randrange(60))) for _ in range(300)] + ["", " "]
    for pattern, table in ((ALNUM, kernel.ALNUM), (SPACED, kernel.SPACED)):
        block = kernel.Block([t.encode().lower() for t in texts], table)
        h = block.hashes()
        assert [block.words(k) for k in range(len(texts))] == [words(t, pattern) for t in texts]
        flat = [w for t in texts for w in words(t, pattern)]
        assert len(set(zip(flat, h.tolist()))) == len(set(flat)) == len(set(h.tolist()))
        for t, s in zip(texts, kernel.shingle_sets(block, 3)):
            w = words(t, pattern)
            assert len(s) == (len({tuple(w[i : i + 3]) for i in range(len(w) - 2)}) if len(w) >= 3 else bool(w))


def test_memory_follows_neither_short_texts_nor_one_long_one():
    code = """
import resource, numpy as np
from tideline.llm import kernel, lang_id, line_dedup, quality
import pyarrow as pa
short = pa.array(["two words"] * 10_000)
m = lang_id.Model(["a", "b"], lang_id.codewords(2), np.ones((1 << lang_id.BITS, 1), np.float32), np.ones(1))
q = quality.Model(np.ones(quality.TERMS, np.float32), np.ones((quality.TERMS, 8), np.float32), np.ones((4000, 8), np.float32), np.ones(4000), 0.5)
for _, raw in kernel.blocks(short, rows=kernel.COUNT_ROWS):
    m.decode(raw); q.scores(raw)
long = [b"lorem ipsum dolor sit. " * 2_200_000]
kernel.shingle_sets(kernel.Block(long, kernel.SPACED), 5)
m.decode(long)
print(resource.getrusage(resource.RUSAGE_SELF).ru_maxrss)
"""
    import subprocess
    import sys

    out = subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, check=True, cwd=__file__.rsplit("/tests/", 1)[0])
    assert int(out.stdout) < 1_000_000


def test_lookup_of_hot_keys_equals_a_left_join(spark):
    from tideline.llm.cluster import components, hot_keys, lookup

    rows = [(k, "hot" if k % 3 == 0 else None if k % 3 == 1 else f"k{k % 50}") for k in range(3000)] + [(9000, "absent")] * 900
    df = spark.createDataFrame(rows, "n int, key string")
    table = spark.createDataFrame([("hot", 1, None)] + [(f"k{k}", k, "x") for k in range(40)], "key string, a int, b string")
    hot = hot_keys(df.groupBy("key").count(), "key", share=10)
    assert {r.key for r in hot.collect()} == {"hot", "absent"}
    out = lookup(df, table, "key", hot, F.col("n"))
    assert out.columns == ["n", "key", "a", "b"]
    assert sorted(map(str, out.collect())) == sorted(map(str, df.join(table, "key", "left").select("n", "key", "a", "b").collect()))
    star = spark.createDataFrame([(5, 1000 + k) for k in range(300)] + [(1, 5), (7, 8), (8, 8)], "a long, b long")
    assert {r.root for r in components(star).collect()} == {1, 7} and components(star).count() == 304


# 1 licences


def brute_base(text):
    w = words(text, ALNUM)
    places = [(i, label) for phrase, label in license_scan.BASE for p in [phrase.encode().split()] for i in range(len(w) - len(p) + 1) if w[i : i + len(p)] == p]
    return len(w), len(places), min((i for i, _ in places), default=None), max((i for i, _ in places), default=None), ",".join(sorted({x for _, x in places}))


def test_licenses_equal_brute_force(spark, docs, odd):
    for df in (docs, odd):
        for r in license_scan.scan_licenses(df).join(df.select("doc_id", "text").distinct(), "doc_id").collect():
            assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == brute_base(r.text)
            assert 0 <= r.score <= 1 and set(filter(None, r.base_labels.split(","))) <= set(r.labels.split(","))
    assert license_scan.scan_licenses(odd).count() == len(ODD)
    assert license_scan.scan_licenses(docs.limit(0)).count() == 0


def brute_notices(text):
    """Labels, score and places by trying every start of every template."""
    w, labels, best, places = words(text, ALNUM), set(), 0.0, []
    for label, phrase, keys, base in [(x, p, (p,), True) for p, x in license_scan.BASE] + [(*n, False) for n in license_scan.NOTICES]:
        t = phrase.encode().split()
        slack = 0 if base else license_scan.SLACK
        at, low = [], 0
        for k in keys:
            k = k.encode().split()
            low = next(i for i in range(low, len(t)) if t[i : i + len(k)] == k)
            at.append((low, k))
        for start in range(-len(t), len(w)):
            stands = lambda i, k: i >= 0 and w[i : i + len(k)] == k
            if not stands(start + at[0][0], at[0][1]) or not all(any(stands(start + i + j, k) for j in range(-slack, slack + 1)) for i, k in at[1:]):
                continue
            n = sum(x in w[max(0, start + i - slack) : max(0, start + i + slack + 1)] for i, x in enumerate(t))
            if n >= (1 if base else license_scan.SHARE) * len(t) - 1e-9:
                labels.add(label)
                places.append((label, start))
                best = max(best, n / len(t))
    return ",".join(sorted(labels)), best, sorted(set(places))


def test_notices_equal_brute_force(spark, docs):
    rng = random.Random(12)
    notices = [n for _, n, _ in license_scan.NOTICES]
    texts = []
    for k in range(400):
        w = " ".join(rng.choice(notices) for _ in range(rng.randrange(1, 3))).split()
        for _ in range(rng.randrange(0, 7)):
            p = rng.randrange(len(w))
            w[p : p + rng.randrange(2)] = rng.choice(([], ["zz"], ["the"], [rng.choice(w)]))
        texts.append(" ".join(w[rng.randrange(4) :]))
    df = docs.select("doc_id", "text").unionByName(spark.createDataFrame([(10_000 + k, t) for k, t in enumerate(texts)], "doc_id long, text string"))
    got = rows_of(license_scan.scan_licenses(df))
    seen = 0
    for r in df.collect():
        labels, score, places = brute_notices(r.text)
        g = got[r.doc_id]
        assert (g.labels, g.score) == (labels, pytest.approx(score))
        assert sorted({(p.label, p.word) for p in g.places}) == places
        seen += bool(labels)
    assert seen > 200


def test_license_templates_need_their_key_phrases(spark):
    mit = "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"
    texts = [mit, "-- " + mit.upper() + " x", mit.replace("free of charge", "for a fee"), mit.replace("obtaining", "getting"), "cc by " * 3, "Licensed under CC BY-NC 4.0."]
    texts += [mit.replace("any person", "any individual person"), "Licensed under Apache License, Version 2.0", "you can redistribute it under the terms of the GNU General Public License version 3", "free of charge " * 40 + "granted permission hereby is"]
    got = rows_of(license_scan.scan_licenses(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")))
    assert [got[k].labels for k in range(len(texts))] == ["mit", "mit", "", "mit", "cc-by", "cc-by,cc-by-nc-4.0", "mit", "apache-2.0", "gpl,gpl-3.0", ""]
    assert got[4].n_base == 3 and got[3].score < 1 and got[6].score == 1


# 2 languages


def test_language_held_out_accuracy(spark, sf):
    df = spark.read.parquet(f"{sf.replace('0.001', '0.01')}/documents.parquet")
    r = lang_id.identify(df).join(df.select("doc_id", "lang"), "doc_id").where("held_out and lang is not null").collect()
    assert all((zlib.crc32(str(x.doc_id).encode()) % 3 == 1) for x in r)
    assert sum(x.lang == x.lang_pred for x in r) / len(r) > 0.98


def test_language_odd_rows(spark, docs, odd):
    both = docs.select("doc_id", "text", "lang").unionByName(odd.select("doc_id", "text", F.lit(None).cast("string").alias("lang")))
    got = lang_id.identify(both).where("doc_id > 900 or doc_id is null").collect()
    assert len(got) == len(ODD)
    assert {r.doc_id for r in got if r.lang_pred == "und"} == {901, 902, 903}
    assert {r.lang_pred for r in lang_id.identify(odd.withColumn("lang", F.lit(None).cast("string"))).collect()} == {"und"}
    assert lang_id.identify(docs.limit(0)).count() == 0


def test_bit_classifiers_and_decoding_equal_a_plain_loop(docs):
    train = docs.where("lang is not null and text is not null").select("lang", "text").limit(60)
    m = lang_id.fit(train)

    def grams(text):
        raw, out = lang_id.prepare(text), Counter()
        for n in lang_id.ORDERS:
            for i in range(len(raw) - n + 1):
                h = 0x811C9DC5 + n
                for b in raw[i : i + n]:
                    h = (h ^ b) * 0x9E3779B1 & 0xFFFFFFFF
                    h ^= h >> 15
                out[h >> (32 - lang_id.BITS)] += 1
        return out

    rows = [(r.lang, r.text, grams(r.text)) for r in train.collect()]
    total = {lang: sum((g for x, _, g in rows if x == lang), Counter()) for lang in m.langs}
    share = {x: np.array([(total[x][k] + 0.5) / (sum(total[x].values()) + 0.5 * 2**lang_id.BITS) for k in range(2**lang_id.BITS)]) for x in m.langs}
    trust = []
    for b in range(m.code.shape[1]):
        up, down = ([share[x] for x, c in zip(m.langs, m.code[:, b]) if c == s] for s in (1, -1))
        w = np.log(np.mean(up, axis=0)) - np.log(np.mean(down, axis=0))
        w -= (min(x @ w for x in up) + max(x @ w for x in down)) / 2
        assert np.allclose(m.weights[:, b], w, atol=1e-5)
        trust.append(max(1e-3, min([x @ w for x in up] + [-(x @ w) for x in down])))
    assert np.allclose(m.trust, np.array(trust) / sum(trust) * len(trust))
    got = m.decode([lang_id.prepare(t) for _, t, _ in rows])
    for (_, _, g), lang, score in zip(rows, got[0], got[1]):
        loss = []
        for code in m.code:
            margins = [lang_id.SCALE * sum(n * float(m.weights[k, b]) for k, n in g.items()) / sum(g.values()) for b in range(len(trust))]
            loss.append(sum(t * np.log1p(np.exp(-x * c)) for t, x, c in zip(m.trust, margins, code)))
        assert m.langs[int(np.argmin(loss))] == lang
        assert score == pytest.approx(1 / sum(np.exp(min(loss) - x) for x in loss), abs=1e-3)


@pytest.mark.parametrize("n", [1, 2, 4, 7, 20])
def test_codewords_differ(n):
    code = lang_id.codewords(n)
    assert len({tuple(r) for r in code}) == n
    if n > 1:
        assert all(-n < c.sum() < n for c in code.T)


# 3 decontamination


def brute_items(docs, items, n=5, share=0.8):
    def sets(t, n):
        w = words(t, ALNUM)
        return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)}

    out = []
    for i, t in items:
        w = words(t, ALNUM)
        if w:
            s = sets(t, min(n, len(w)))
            out += [(d, i, len(s), k) for d, x in docs if 10 * (k := len(s & sets(x, min(n, len(w))))) >= 10 * share * len(s) - 1e-9]
    return sorted(out, key=str)


def test_contamination_equals_brute_force(spark, docs, odd, sf):
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    items += [(70, None), (71, ""), (72, "lorem IPSUM"), (73, "x"), (74, "lorem ipsum dolor lorem ipsum dolor lorem")]
    b = spark.createDataFrame(items, "item_id long, text string")
    text = items[0][1].split()
    more = [(800, " ".join(["aa"] * 500 + text + ["bb"] * 500)), (801, " ".join(text[: len(text) // 2])), (802, " ".join(text[:-2] + ["zz", "zz"]))]
    df = docs.select("doc_id", "text").unionByName(odd.select("doc_id", "text")).unionByName(spark.createDataFrame(more, "doc_id long, text string"))
    want = brute_items([(r.doc_id, r.text) for r in df.collect()], items)
    for bound in (decontaminate.ITEM_BYTES, 1500):
        got = sorted([(r.doc_id, r.item_id, r.n_item, r.n_shared) for r in decontaminate.find_items(df, b, item_bytes=bound).collect()], key=str)
        assert got == want
    kept = decontaminate.drop_contaminated(df, b, item_bytes=1500)
    assert kept.columns == df.columns and kept.count() == df.count() - sum(c for k, c in Counter(r.doc_id for r in df.collect()).items() if k in {w[0] for w in want})
    assert decontaminate.find_items(df, b.limit(0)).count() == 0 and decontaminate.find_items(df.limit(0), b).count() == 0


# 4 urls


def brute_rule(url):
    if url is None or "://" not in url:
        return "", "", None, None
    rest = url.split("://", 1)[1]
    host = re.match(r"[^/?#]*", rest).group()
    path = re.match(r"[^?#]*", rest[len(host) :], re.S).group()
    host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in host)
    best = (None, None)
    for what, rule in url_filter.RULES:
        name, _, p = rule.partition("/")
        if (host == name or host.endswith("." + name)) and path.startswith("/" + p) and len(rule) > len(best[0] or ""):
            best = (rule, what)
    return host, path, *best


def test_urls(spark, sf):
    urls = ["http://A.Example.ORG/es/1?x", "https://example.org", "https://example.org/", "http://org/x", "http://xorg/y", "http://a.com/de/#z", "HTTP://B.com/DE/", "none", None, "a://b://c/d", "x:///p", "http://\nh/é?q", "http://example.org/en/19"]
    odd = spark.createDataFrame([(1000 + k, u, None, k) for k, u in enumerate(urls)] + [(1000, urls[0], "<a href='http://spam.com/de/'>", 1)], "page_id long, url string, html string, host int")
    pages = spark.read.parquet(f"{sf}/pages.parquet")
    for df in (pages, odd):
        for r in url_filter.judge_urls(df).join(df.select("page_id", "url").distinct(), "page_id").collect():
            host, path, rule, verdict = brute_rule(r.url)
            assert (r.host, r.path, r.rule) == (host, path, rule)
            assert r.verdict == verdict if rule else r.verdict in ("allow", "block")
    assert url_filter.judge_urls(odd).count() == len(urls) + 1
    assert url_filter.judge_urls(pages.limit(0)).count() == 0


def test_distrust_follows_links_backwards(spark):
    link = '<a href="{}">'
    rows = [(1, "http://bad.com/de/x", ""), (2, "http://farm.net/a", link.format("http://bad.com/de/x")), (3, "http://good.org/a", link.format("http://friend.net/") * 3), (4, "http://friend.net/a", link.format("/local")), (5, "http://alone.net/", None)]
    got = rows_of(url_filter.judge_urls(spark.createDataFrame(rows, "page_id long, url string, html string")), "page_id")
    assert [got[k].verdict for k in range(1, 6)] == ["block", "block", "allow", "allow", "allow"]
    assert got[2].distrust > 0 == got[2].trust and got[4].trust > 0 == got[4].distrust


def test_links_without_a_scheme_are_edges(spark):
    html = """<a href="//Bad.com/de/x"><a HREF=//bad.com?u=http://other.org/><a href='http://bad.com/?v=//w.org'><a href="/local//x"><a href="x//y"><a href="///z"><a href="//farm.net/own">"""
    pages = spark.createDataFrame([(1, "http://farm.net/a", html), (2, "https://bad.com/de/", None)], "page_id long, url string, html string")
    assert [tuple(r) for r in url_filter.host_edges(pages).collect()] == [("farm.net", "bad.com", 3.0)]
    assert [rows_of(url_filter.judge_urls(pages), "page_id")[k].verdict for k in (1, 2)] == ["block", "block"]


def test_distrust_goes_the_whole_way(spark):
    rows = [(k, f"http://h{k}.net/", f"<a href='http://h{k + 1}.net/'>") for k in range(25)] + [(25, "http://h25.net/", "<a href='http://bad.com/de/'>"), (26, "http://bad.com/de/", None)]
    rows += [(100 + k, f"http://x{k}.com/de/", None) for k in range(2000)]
    got = rows_of(url_filter.judge_urls(spark.createDataFrame(rows, "page_id long, url string, html string")), "page_id")
    assert {r.verdict for r in got.values()} == {"block"}
    assert all(got[k].distrust == pytest.approx(0.15 * 0.85 ** (26 - k)) for k in range(26))


def test_whole_verdicts_equal_brute_force(spark):
    rng = random.Random(21)
    hosts = [f"h{k}.net" for k in range(30)] + ["a.com", "b.com", "good.org", "example.org", "hub.net"]
    rows = []
    for k in range(300):
        host = "hub.net" if k % 3 == 0 else rng.choice(hosts)
        path = rng.choice(["/de/x", "/fr/", "/es/", "/en/1", "/"])
        # links lead on in the list but for one pair of hosts, so rounds are few
        on = hosts[hosts.index(host) + 1 :] + (["h28.net"] if host == "h29.net" else [])
        links = [f'<a href="{rng.choice(("http:", "", "HTTPS:"))}//{rng.choice(on).upper()}{rng.choice(("/", "", "?q"))}">' for _ in range(rng.randrange(4)) if on]
        rows.append((k, f"http://{host}{path}", "".join(links)))
    edges, parsed = Counter(), {}
    for k, url, html in rows:
        parsed[k] = brute_rule(url)
        for to in re.findall(r'href="[^"]*?//([^"/?#]*)', html):
            if to.lower() != parsed[k][0]:
                edges[parsed[k][0], to.lower()] += 1

    def spread(seeds, edges):
        out = Counter()
        for (a, _), n in edges.items():
            out[a] += n
        now = {h: 0.15 * n for h, n in seeds.items()}
        for _ in range(200):
            then = Counter({h: 0.15 * n for h, n in seeds.items()})
            for (a, b), n in edges.items():
                then[b] += 0.85 * now.get(a, 0) * n / out[a]
            now = dict(then)
        return now

    trust = spread(Counter(p[0] for p in parsed.values() if p[3] == "allow"), edges)
    distrust = spread(Counter(p[0] for p in parsed.values() if p[3] == "block"), Counter({(b, a): n for (a, b), n in edges.items()}))
    got = rows_of(url_filter.judge_urls(spark.createDataFrame(rows, "page_id long, url string, html string")), "page_id")
    seen = Counter()
    for k, (host, path, rule, verdict) in parsed.items():
        t, d = trust.get(host, 0), distrust.get(host, 0)
        want = verdict or ("block" if d > 0 and d >= url_filter.THRESHOLD * (t + d) else "allow")
        assert (got[k].host, got[k].path, got[k].rule, got[k].verdict) == (host, path, rule, want)
        assert (got[k].trust, got[k].distrust) == (pytest.approx(t, rel=1e-3), pytest.approx(d, rel=1e-3))
        seen[rule is None, want] += 1
    assert len(seen) == 4 or seen[True, "block"] + seen[True, "allow"] > 20


def test_propagation_equals_numpy(spark):
    rng = np.random.default_rng(4)
    edges = [(f"h{a}", f"h{b}", float(w)) for a, b, w in {(int(a), int(b)): (int(a), int(b), w) for a, b, w in zip(rng.integers(0, 12, 40), rng.integers(0, 12, 40), rng.integers(1, 5, 40)) if a != b}.values()]
    seeds = [("h0", 3.0), ("h5", 1.0)]
    got = {r.host: r.score for r in url_filter.propagate(spark.createDataFrame(seeds, "host string, mass double"), spark.createDataFrame(edges, "src string, dst string, weight double"), rounds=8).collect()}
    m = np.zeros((12, 12))
    for a, b, w in edges:
        m[int(a[1:]), int(b[1:])] = w
    m = m / np.maximum(m.sum(axis=1, keepdims=True), 1e-9)
    s = np.zeros(12)
    s[0], s[5] = 3, 1
    x = 0.15 * s
    for _ in range(8):
        x = 0.15 * s + 0.85 * x @ m
    assert all(abs(got.get(f"h{k}", 0) - x[k]) < 1e-9 for k in range(12))


# 5 BPE


def test_bpe_equals_the_library(spark, docs, odd):
    from tokenizers import Tokenizer

    path = queries.byte_bpe_path()
    tok = Tokenizer.from_file(path)
    rng = random.Random(2)
    parts = ["a", "é", " ", "\n", "\x1c", "\x85", "中", "😀", "<|endoftext|>", "'ll", "1²", "ab" * 40, "zq" * 60, "!!", "\u200b", "\u3000"]
    fuzz = [(5000 + k, "".join(rng.choice(parts) for _ in range(rng.randrange(12)))) for k in range(400)]
    df = docs.select("doc_id", "text").unionByName(odd.select("doc_id", "text")).unionByName(spark.createDataFrame(fuzz, "doc_id long, text string"))
    texts = [(r.doc_id, r.text or "") for r in df.collect()]
    want = []
    for (k, t), e in zip(texts, tok.encode_batch([t for _, t in texts], add_special_tokens=False)):
        ids = ",".join(map(str, e.ids))
        want.append((k, len(e.ids), hashlib.sha256(ids.encode()).hexdigest(), hashlib.sha256(tok.decode(e.ids, skip_special_tokens=False).encode()).hexdigest()))
    got = [(r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in bpe.encode_decode(df, path).collect()]
    assert sorted(got, key=str) == sorted(want, key=str)


def test_long_texts_are_encoded_piece_by_piece(docs, monkeypatch):
    path = queries.byte_bpe_path()
    v = bpe.Vocabulary(path)
    texts = [r.text for r in docs.limit(60).collect() if r.text] + ["中é😀 a<|endoftext|>b  c\n\n d" * 9, ""]
    want = [bpe.Codec(v).digests(t, kept) for kept in [[]] for t in texts]
    monkeypatch.setattr(bpe, "LONG", 40)
    monkeypatch.setattr(bpe, "PIECE", 3)
    codec, kept = bpe.Codec(v, remembered=20), []
    assert [codec.digests(t, kept) for t in texts] == want
    assert [k.count(",") + 1 if k else 0 for k in kept] == [n for n, _, _ in want] and len(codec.memo) <= 40


def test_pretokens_of_a_run_are_merged_side_by_side(docs, monkeypatch):
    v = bpe.Vocabulary(queries.byte_bpe_path())
    rng = random.Random(4)
    parts = ["a", "é", " ", "\n", "中", "😀", "<|endoftext|>", "'ll", "1²", "ab" * 40, "aaaaaaaa", "ing", "----", "  "]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randrange(14))) for _ in range(300)] + ["-" * 300, "a" * 48, "a" * 49, ""]
    texts += [r.text or "" for r in docs.limit(60).collect()]
    words = [w.encode() for w in sorted({w for t in texts for w in bpe.Codec(v).pretokens(t)} - set(v.special))]
    want = [[i for part in v.fragments(w) for i in v.merge(part)] for w in words]
    ids, counts = v.encode(words)
    assert ids.tolist() == sum(want, []) and counts.tolist() == list(map(len, want))
    assert [len(x) for x in v.encode([])] == [0, 0]
    one = [bpe.Codec(v).digests(t) for t in texts]
    # none but wide fragments come alone; runs of texts, long ones among them, change nothing
    merge = bpe.Vocabulary.merge
    monkeypatch.setattr(bpe.Vocabulary, "merge", lambda self, raw: merge(self, raw) if len(raw) > bpe.WIDE else pytest.fail("merged alone"))
    for together, long in ((10, 10**6), (300, 40), (10**6, 40)):
        monkeypatch.setattr(bpe, "TOGETHER", together)
        monkeypatch.setattr(bpe, "LONG", long)
        monkeypatch.setattr(bpe, "PIECE", 7)
        assert list(bpe.Codec(v, remembered=30).all_digests(texts)) == one
    assert [bpe.Codec(v).digests(t) for t in texts] == one


def test_operators_pass_over_clashing_columns_and_empty_tables(spark, docs):
    plain = docs.select("doc_id", "text").limit(30)
    clash = plain.select("*", *[F.lit(k).alias(n) for k, n in enumerate(("ids", "n_tokens", "item_id", "containment", "size", "shard", "_h", "_draws", "_region", "_rack", "_bucket", "labels", "n_words", "lang", "held_out", "host"))])
    items = spark.createDataFrame([("a", docs.first().text, 1), (None, "lorem ipsum", 2), ("a", docs.first().text, 1)], "item_id string, text string, doc_id int")
    calls = [lambda d: bpe.encode_decode(d, queries.byte_bpe_path()), lambda d: decontaminate.find_items(d, items), shard.hash_tree_shards, license_scan.scan_licenses]
    for call in calls:
        assert sorted(map(str, call(clash).collect())) == sorted(map(str, call(plain).collect()))
        assert call(clash.limit(0)).count() == 0
    found = decontaminate.find_items(plain, items).collect()
    assert len(found) == 2 and {r.item_id for r in found} == {"a"}
    big = spark.createDataFrame([(2**53 + 1, docs.first().text), (None, "x")], "item_id long, text string")
    assert {r.item_id for r in decontaminate.find_items(plain, big).collect()} >= {2**53 + 1}


def test_bpe_fragments_rejoin():
    v = bpe.Vocabulary(queries.byte_bpe_path())
    raw = "naïve zqxj\x00\x01ÿþ🦊".encode()
    parts = v.fragments(raw)
    assert b"".join(parts) == raw and len(parts) > 1
    assert [i for p in parts for i in v.merge(p)] == v.merge(raw) == v._many([v.single[b] for b in raw])


# 6 line dedup


def test_line_chunks_are_whole_and_shift_resistant():
    rng = random.Random(3)
    sentence = lambda: " ".join("w%d" % rng.randrange(5000) for _ in range(rng.randrange(3, 25))) + rng.choice(". ! ?".split())
    passage = "\n".join(" ".join(sentence() for _ in range(rng.randrange(1, 9))) for _ in range(12))
    texts = [passage, sentence() + "\n" + passage, " ".join(sentence() for _ in range(5)) + "\n" + passage + "\n" + sentence()]
    c = line_dedup.Chunks([t.encode() for t in texts])
    for k, t in enumerate(texts):
        assert c.without(k, set()) == t.encode()
    bodies = [{c.data[c.start[j] : c.end[j]] for j in np.flatnonzero(c.fit & (c.doc == k)).tolist()} for k in range(3)]
    assert bodies[0] <= bodies[1] and bodies[0] <= bodies[2] and len(bodies[0]) > 3


def brute_dedup(rows):
    first, out = {}, {}
    keyed = sorted({(r.doc_id is not None, r.doc_id or 0, r._row, r.text) for r in rows if r.text is not None})
    for known, k, h, text in keyed:
        c = line_dedup.Chunks([text.encode()])
        gone = set()
        for j in np.flatnonzero(c.fit).tolist():
            body = c.data[c.start[j] : c.end[j]]
            if first.setdefault(body, (known, k, h, int(c.place[j]))) != (known, k, h, int(c.place[j])):
                gone.add(int(c.place[j]))
        out[(k if known else None, text)] = (c.without(0, gone).decode(), len(gone))
    return out


def test_line_dedup_equals_brute_force(spark, sf, odd):
    df = spark.read.parquet(f"{sf.replace('0.001', '0.01')}/documents.parquet")
    twice = odd.select(*df.columns).unionByName(df)
    clash = twice.withColumn("gone", F.lit(1)).withColumn("row", F.lit(2))
    want = brute_dedup(clash.withColumn("_row", F.xxhash64("doc_id", "text")).collect())
    got = line_dedup.dedup_lines(clash)
    assert got.columns == [*clash.columns, "_chunks", "_removed"]
    key = got.select("*").withColumn("_k", F.xxhash64("doc_id")).collect()
    source = defaultdict(list)
    for r in clash.collect():
        source[r.doc_id].append(r.text)
    assert len(key) == clash.count()
    removed = 0
    for r in key:
        options = [want[(r.doc_id, t)] for t in source[r.doc_id] if t is not None] + [(None, 0)] * (None in source[r.doc_id])
        assert (r.text, r._removed) in options
        removed += r._removed
    assert removed > 20
    assert line_dedup.dedup_lines(df.limit(0)).count() == 0


def brute_passages(texts, least_lines=2, least_words=16):
    """Display lines that stay in texts of sentences (none of more than 16 words): one goes if a run of enough of them through it stood before."""
    cut = [[x for line in t.split("\n") for x in re.split(r"(?<=[.!?]) ", line) if x.strip()] for t in texts]
    seen, out = set(), []
    for lines in cut:
        gone = set()
        for i in range(len(lines)):
            for j in range(i + least_lines, min(len(lines), i + 20) + 1):
                run = tuple(lines[i:j])
                if sum(len(x.split()) for x in run) >= least_words:
                    if run in seen:
                        gone |= set(range(i, j))
                    seen.add(run)
        out.append([x for k, x in enumerate(lines) if k not in gone])
    return out


def remaining(spark, texts):
    got = rows_of(line_dedup.dedup_lines(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")))
    return [re.findall(r"[^.!?\n]*[.!?]", got[k].text.replace("\n", " ")) for k in range(len(texts))]


def test_passages_of_short_lines_go_whole(spark):
    rng = random.Random(9)
    sentence = lambda n: " ".join("w%d" % rng.randrange(10**6) for _ in range(n)) + "."
    passage = "\n".join(sentence(rng.randrange(3, 6)) + " " + sentence(rng.randrange(4, 7)) for _ in range(20))
    texts = [f"{sentence(9)} {sentence(8)}\n{passage}\n{sentence(7)} {sentence(7)}" for _ in range(6)]
    texts += [f"{sentence(9)} {sentence(8)}\n{sentence(3)[:-1]}! Oh yes. No no.\n{sentence(9)} {sentence(8)}" for _ in range(3)]
    want = brute_passages(texts)
    assert len(want[0]) == 44 and len(want[5]) == 4 and len(want[7]) == 7
    assert [[x.strip() for x in r] for r in remaining(spark, texts)] == want


def test_passages_in_mid_paragraph_and_in_plain_lines_go_whole(spark):
    rng = random.Random(10)
    sentence = lambda n: " ".join("w%d" % rng.randrange(10**6) for _ in range(n)) + "."
    some = lambda: [sentence(rng.randrange(5, 12)) for _ in range(rng.randrange(1, 4))]
    texts, planted = [], []
    for k in range(60):
        passage = [sentence(rng.randrange(5, 12))]
        while sum(len(x.split()) for x in passage) < 50 + 100 * k // 60:
            passage.append(sentence(rng.randrange(5, 12)))
        planted.append(passage)
        for _ in range(2):
            texts.append((" ", "\n", "\n\n")[k % 3].join([*some(), *passage, *some()]) + "\n" + " ".join(some()))
    texts += ["A b. C d. E f.", "A b. C d. E f.", "a " * 20 + "b.\n\n", "a " * 20 + "b."]
    out = line_dedup.dedup_lines(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    got = {r.doc_id: r.text for r in out}
    for k, passage in enumerate(planted):
        assert got[2 * k] == texts[2 * k]
        assert not any(x in got[2 * k + 1] for x in passage)
    want = brute_passages(texts[:-2])
    assert [[x.strip() for x in r] for r in remaining(spark, texts)][:-2] == want
    assert got[1] == texts[1].replace(" ".join(planted[0]) + " ", "") and got[121] == texts[121]


def test_a_line_that_loses_its_end_keeps_its_newline(spark):
    p = "One two three four five six seven eight. Nine ten eleven twelve thirteen fourteen fifteen sixteen."
    texts = [p, f"Start here. {p}\nThen more.", f"Start again. {p}", f"\n\n{p}\n\n"]
    got = rows_of(line_dedup.dedup_lines(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")))
    assert [got[k].text for k in range(4)] == [p, "Start here. \nThen more.", "Start again. ", ""]


def test_chunks_that_repeat_much_are_cut_in_two_passes_only(spark):
    p = "One two three four five six seven eight. Nine ten eleven twelve thirteen fourteen fifteen sixteen."
    df = line_dedup.dedup_lines(spark.createDataFrame([(k, f"Start {k}. {p}") for k in range(40)] + [(99, None)], "doc_id long, text string"))
    assert sorted((r.doc_id, r.text, r._removed) for r in df.collect() if r.doc_id) == [(k, f"Start {k}. ", 1) for k in range(1, 40)] + [(99, None, 0)]
    # the first pass is written; the second one is in this plan, once, though the hot chunks are gathered beside the others
    plan = df._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
    assert plan.count("MapInArrow chunks(") == 1 and plan.count("MapInArrow rebuild(") == 1 and "BroadcastHashJoin" in plan


def test_chunks_are_the_shortest_runs():
    rng = random.Random(12)
    parts = ["a", "bb", ". ", " ", "\n", "! ", "?", "\t", "é ", ".", " c ", " d e f g h ", "\r\n", "\0", "\x0b"]
    for _ in range(300):
        texts = ["".join(rng.choice(parts) for _ in range(rng.choice([0, 1, 5, 30, 120]))).encode() for _ in range(rng.randrange(1, 6))]
        least_lines, least_words = rng.choice([1, 2, 3]), rng.choice([1, 4, 16])
        c = line_dedup.Chunks(texts, least_lines, least_words)
        for k, t in enumerate(texts):
            lines = []
            for line in re.split(rb"(?<=[.!?]) |(?<=\n)", t):
                w = SPACED.findall(line)
                lines += [w[i : i + line_dedup.WRAP] for i in range(0, len(w), line_dedup.WRAP)]
            full = lambda i, j, lines=lines: i >= 0 and j < len(lines) and j - i + 1 >= least_lines and sum(map(len, lines[i : j + 1])) >= least_words
            runs = [(i, j) for i in range(len(lines)) for j in range(i, len(lines)) if full(i, j) and (i == j or not full(i, j - 1) or not full(i + 1, j))]
            at = np.arange(c.first[k], c.first[k + 1])
            assert [SPACED.findall(c.data[c.start[x] : c.end[x]]) for x in at[c.fit[at]]] == [sum(lines[i : j + 1], []) for i, j in runs]
            assert len(at) == max(1, len(runs)) and (c.doc[at] == k).all() and c.place[at].tolist() == list(range(len(at)))


# 7 neighbours


def brute_nearest(ids, x, k=10):
    out = {}
    for q in np.flatnonzero(ids % 100 == 0):
        d = np.sqrt(((x - x[q]) ** 2).sum(axis=1))
        order = [j for j in np.lexsort((ids, d)) if ids[j] != ids[q]][:k]
        out[int(ids[q])] = [(int(ids[j]), d[j]) for j in order]
    return out


def test_neighbours_recall_and_order(spark, sf):
    df = spark.read.parquet(f"{sf.replace('0.001', '0.1')}/embeddings.parquet")
    p = df.toPandas()
    want = brute_nearest(p.vec_id.to_numpy(), np.stack(p.embedding.to_numpy()).astype(float))
    for options, least in (({}, 1.0), ({"open_rows": 1200, "task_rows": 200}, 0.9)):
        got = defaultdict(list)
        for r in ann.nearest_neighbours(df, df.where("vec_id % 100 = 0"), **options).orderBy("query_id", "rank").collect():
            got[r.query_id].append((r.rank, r.vec_id, r.score))
        assert set(got) == set(want)
        hit = 0
        for q, found in got.items():
            assert [r for r, _, _ in found] == list(range(1, 11)) and [(s, v) for _, v, s in found] == sorted((s, v) for _, v, s in found)
            hit += len({v for _, v, _ in found} & {v for v, _ in want[q]})
        assert hit / (10 * len(want)) >= least


def test_neighbours_odd_vectors(spark):
    inf, nan = float("inf"), float("nan")
    rows = [(0, [1.0, 2.0]), (1, [1.0, 2.0]), (2, None), (3, [0.0, 0.0]), (4, [nan, 1.0]), (5, [inf, 1.0]), (6, [1.0, None]), (7, []), (8, [1.0]), (100, [4.0, 6.0]), (None, [1.0, 1.0])] + [(k, [1.0, 2.0]) for k in range(9, 60)] + [(0, [1.0, 2.0])]
    df = spark.createDataFrame([(*r, 1, 2) for r in rows], "vec_id long, embedding array<double>, cell int, rank int")
    got = defaultdict(list)
    for r in ann.nearest_neighbours(df, df.where("vec_id % 100 = 0")).orderBy("query_id", "rank").collect():
        got[r.query_id].append((r.vec_id, r.score))
    assert got == {0: [(v, 0.0) for v in (1, *range(9, 18))], 100: [(v, 5.0) for v in (0, 1, *range(9, 17))]}
    more = spark.createDataFrame([(k, [float(k), 1.0, 2.0], 1, 2) for k in range(200, 206)], df.schema)
    got = ann.nearest_neighbours(df.unionByName(more), more.where("vec_id = 200")).orderBy("rank").collect()
    assert [(r.vec_id, r.score) for r in got] == [(200 + k, float(k)) for k in range(1, 6)]
    assert ann.nearest_neighbours(df.limit(0), df).count() == 0


def test_heap_walk_is_in_order():
    rng = np.random.default_rng(5)
    a, b = rng.random(6), rng.random(7)
    codes = rng.permutation(42)[:30]
    index = ann.Cells.of(codes, np.ones(30, dtype=int), 6, 7)
    cells = index.walk(a, b, 30)
    total = [a[index.codes[c] // 7] + b[index.codes[c] % 7] for c in cells]
    assert sorted(cells) == list(range(30)) and total == sorted(total)
    assert index.walk(a, b, 12) == cells[:12] and index.walk(a, b, 99) == cells


# 8 shards


def test_shards(spark, docs, odd):
    df = docs.select("doc_id", "text").unionByName(odd.select("doc_id", "text"))
    got = shard.hash_tree_shards(df, digits=2).collect()
    assert len(got) == df.count() and {r.law for r in got} == {"key"}
    by = defaultdict(list)
    for r in got:
        by[r.shard].append(r.slot)
        assert r.grown_shard in (r.shard, 24) and 0 <= r.shard < 24
    assert all(sorted(s) == list(range(len(s))) for s in by.values())
    assert {(r.doc_id, r.size, r.text_crc32) for r in got} == {(r.doc_id, len((r.text or "").encode()) + 8, zlib.crc32((r.text or "").encode())) for r in df.collect()}
    assert shard.hash_tree_shards(df.limit(0)).count() == 0


def test_tree_equals_a_descent_by_hand(spark):
    tree = shard.Tree((((((4, 1.0), (1, 2.0)), ((0, 1.0),)), (((7, 0.5), (2, 0.0), (5, 1.5)),))))

    def least(key, names, weights):
        u = [(int(hashlib.md5(f"{key}/{n}".encode()).hexdigest()[:12], 16) + 1) / 16**12 for n in names]
        draws = [-np.log(x) / w if w else np.inf for x, w in zip(u, weights)]
        return int(np.argmin(draws))

    def descend(t, key):
        total = lambda x: sum(map(total, x)) if isinstance(x[0], tuple) else x[1]
        r = least(key, range(len(t.racks)), [total(x) for x in t.racks])
        k = least(key, [f"{r}.{j}" for j in range(len(t.racks[r]))], [total(x) for x in t.racks[r]])
        return t.racks[r][k][least(key, [f"{r}.{k}.{j}" for j in range(len(t.racks[r][k]))], [w for _, w in t.racks[r][k]])][0]

    keys = spark.range(3000).withColumn("_rack", F.lit(1)).withColumn("region", F.lit(2))
    out = shard.assign(keys, "id", {"a": tree, "b": tree.grown(2.0)}).withColumn("c", shard.grown_shard(F.col("id"), tree, F.col("a"), 2.0))
    assert out.columns == [*keys.columns, "a", "b", "c"]
    for r in out.collect():
        assert (r.a, r.b) == (descend(tree, r.id), descend(tree.grown(2.0), r.id)) and r.c == r.b and r.b in (r.a, 8)
    with pytest.raises(ValueError):
        shard.Tree.of(2, weights={0: 0.0, 1: 0.0})


def test_weights_move_rows_only_into_or_out_of_changed_subtrees(spark):
    keys = spark.range(20_000).withColumnRenamed("id", "doc_id")
    before = shard.Tree.of(24)
    region, rack = (lambda k: k // 12), (lambda k: k // 4)
    for weights in ({3: 3.0}, {4: 0.0, 5: 0.0, 6: 0.0, 7: 0.0}, {8: 2.0, 9: 0.0}):
        after = shard.Tree.of(24, weights=weights)
        r = shard.assign(keys, "doc_id", {"a": before, "b": after}).groupBy("a", "b").count().collect()
        moved = [(x.a, x.b) for x in r if x.a != x.b]
        assert moved and {x.b for x in r if weights.get(x.b) == 0.0} == set()
        for a, b in moved:
            # the first level at which the two part chose otherwise, so one of the two nodes there has changed
            nodes = [f(k) for f in (region, rack, int) for k in (a, b) if region(a) != region(b) or (f is not region and rack(a) != rack(b)) or f is int]
            changed = {n for k in weights for n in (region(k), rack(k), k)}
            level = region if region(a) != region(b) else rack if rack(a) != rack(b) else int
            assert {level(a), level(b)} & {level(k) for k in weights} and nodes and changed
        total = sum(weights.get(k, 1.0) for k in range(24))
        for k, w in weights.items():
            assert abs(sum(x["count"] for x in r if x.b == k) / 20_000 - w / total) < 0.02


def test_slots_of_one_id_are_dealt_over_buckets(spark):
    df = spark.range(4000).select(F.lit(None).cast("long").alias("doc_id"), F.col("id").cast("string").alias("text"))
    got = shard.hash_tree_shards(df, digits=1)
    assert sorted(r.slot for r in got.collect()) == list(range(4000)) and got.select("shard").distinct().count() == 1


def test_equal_rows_are_made_again_by_many_tasks(spark, monkeypatch):
    monkeypatch.setattr(shard, "PIECE", 16)
    copies = spark.range(1000).select(F.lit(5).cast("long").alias("doc_id"), F.lit("same").alias("text"))
    others = spark.range(300).select(F.col("id").alias("doc_id"), F.col("id").cast("string").alias("text"))
    got = shard.hash_tree_shards(copies.unionByName(others), digits=1)
    rows = got.withColumn("task", F.spark_partition_id()).collect()
    by = defaultdict(list)
    for r in rows:
        by[r.shard].append(r.slot)
    assert len(rows) == 1300 and all(sorted(s) == list(range(len(s))) for s in by.values())
    same = [r for r in rows if (r.doc_id, r.text_crc32) == (5, zlib.crc32(b"same"))]
    at = sorted(r.slot for r in same)
    assert at == list(range(at[0], at[0] + 1000)) and len({r.task for r in same}) > 1


# 9 joins


def brute_join(rows, n, p):
    def shingles(t):
        w = words(t, SPACED)
        return frozenset(tuple(w[i : i + n]) for i in range(len(w) - n + 1)) if len(w) >= n else frozenset([tuple(w)]) if w else frozenset()

    sets = [shingles(t) for _, t in rows]
    parent, links, lists = list(range(len(rows))), [0] * len(rows), defaultdict(list)

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, s in enumerate(sets):
        seen = Counter()
        for token in s:
            seen.update(lists[token])
            lists[token].append(i)
        for j, k in seen.items():
            if 100 * k >= p * (len(s) + len(sets[j]) - k):
                parent[root(i)] = root(j)
                links[i] += 1
                links[j] += 1
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[root(i)] = min(least.get(root(i), d), d)
    return sorted([(d, len(sets[i]), least.get(root(i)), links[i]) for i, (d, _) in enumerate(rows)], key=str)


@pytest.fixture(scope="module")
def near_copies(spark, docs, odd):
    rng = random.Random(6)
    rows = [(r.doc_id, r.text) for r in docs.collect()] + ODD
    for size, base_id in ((120, 2000), (40, 3000), (700, 4000)):
        base = [rng.choice("abcdefgh") + str(rng.randrange(200)) for _ in range(size)]
        for k in range(70):
            w = list(base)
            for _ in range(rng.randrange(0, max(2, size // 25))):
                w[rng.randrange(len(w))] = "z%d" % rng.randrange(10**6)
            rows.append((base_id + k, " ".join(w)))
    return rows


@pytest.mark.parametrize(("n", "p", "options"), [(3, 90, {}), (5, 80, {"list_bound": 3}), (3, 90, {"task_shingles": 3000})])
def test_join_equals_brute_force(spark, near_copies, n, p, options):
    df = spark.createDataFrame([(*r, 1, b"x") for r in near_copies], "doc_id long, text string, size int, sig binary")
    got = sorted([(r.doc_id, r.n_shingles, r.component_id, r.n_links) for r in ngram_join.join_components(df, n, p, **options).collect()], key=str)
    assert got == brute_join(near_copies, n, p)


def test_one_of_each(spark, near_copies):
    df = spark.createDataFrame(near_copies, "doc_id long, text string")
    want = brute_join(near_copies, 5, 80)
    kept = ngram_join.one_of_each(df)
    assert kept.columns == df.columns
    ids = Counter(r.doc_id for r in kept.collect())
    alone = [d for d, n, _, k in want if not k]
    groups = {c for _, _, c, k in want if k}
    assert ids == Counter(alone) + Counter(groups)
    assert ngram_join.join_components(df.limit(0)).count() == 0


def test_one_of_each_tells_components_apart_without_ids(spark):
    a, b, c, d, e = ([f"{x}{k}" for k in range(40)] for x in "abcde")
    near = lambda w: " ".join([*w[:-1], "zz"])
    rows = [(None, " ".join(a)), (None, near(a)), (None, " ".join(b)), (None, " ".join(b)), (7, " ".join(c)), (8, near(c)), (7, " ".join(d)), (9, near(d)), (None, " ".join(e)), (5, near(e))]
    kept = ngram_join.one_of_each(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert Counter((r.doc_id, r.text.split()[0]) for r in kept) == Counter([(None, "a0"), (None, "b0"), (7, "c0"), (7, "d0"), (5, "e0")])


# 10 quality


def test_quality_held_out_accuracy(spark, sf):
    big = sf.replace("0.001", "0.01")
    r = queries.op10_quality(spark, big).join(spark.read.parquet(f"{big}/labels.parquet"), "doc_id").where("held_out").collect()
    assert sum(x.predicted == x.quality for x in r) / len(r) > 0.95
    assert all(x.predicted == 1 for x in r if x.quality == 1)
    assert all(x.predicted == int(x.score >= 0.3) and 0 <= x.score <= 1 for x in r)


def test_quality_odd_rows(spark, docs, odd, sf):
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    mess = labels.select("doc_id", "quality").unionByName(spark.createDataFrame([(None, 1), (1, None), (2, 0), (2, 1)], "doc_id long, quality int"))
    out = quality.score_quality(odd, mess)
    assert out.columns == [*odd.columns, "_score", "_predicted"] and out.count() == len(ODD)
    got = quality.score_quality(docs, labels.limit(0)).select("_score").distinct().collect()
    assert [r._score for r in got] == [0.5]
    assert quality.score_quality(docs.limit(0), labels).count() == 0


def test_fit_equals_brute_force(spark, docs, sf):
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    known = quality.labels_for_fit(labels, "doc_id", "quality")
    twice = docs.unionByName(docs)
    m = quality.fit(twice, known, "doc_id", "text")
    text = {r.doc_id: (r.text or "").encode() for r in docs.collect()}
    want = {r.doc_id: r.quality for r in labels.collect() if r.quality is not None and zlib.crc32(str(r.doc_id).encode()) % 5 and r.doc_id in text}
    ids = sorted(want)
    # an id lends one text, however often it comes
    assert m.labels.tolist() == [float(want[k]) for k in ids]
    t = [(quality.terms([x]) > 0)[0] for x in text.values()]
    assert np.allclose(m.idf, np.log((1 + 2 * len(t)) / (1 + 2 * np.sum(t, axis=0))) + 1, atol=1e-5)
    x = quality._unit(np.concatenate([quality.terms([text[k]]) for k in ids]) * m.idf)
    singular = np.linalg.svd(x, compute_uv=False)
    kept = np.linalg.svd(x @ m.axes, compute_uv=False)
    assert np.allclose(kept[:20], singular[:20], rtol=0.02)
    few = quality.fit(docs, known, "doc_id", "text", voters=5)
    assert 0 < len(few.labels) < 40
    assert quality.fit(docs, known.limit(0), "doc_id", "text").prior == 0.5


def test_a_rare_label_keeps_voters_that_stand_for_less(spark):
    text = lambda k: f"rare kind {k} of words" if k % 500 == 0 else f"common sort {k * 7919 % 1013} here {k}"
    docs = spark.createDataFrame([(k, text(k)) for k in range(6000)], "doc_id long, text string")
    known = spark.createDataFrame([(k, int(k % 500 == 0)) for k in range(6000)], "_id long, label int")
    m = quality.fit(docs, known, "doc_id", "text", voters=40)
    # 12 rows of label 1 among 5,988: a common share would leave a twelfth of one
    assert 0 < (m.labels == 1).sum() <= 12 and (m.labels == 0).sum() > (m.labels == 1).sum()
    share = 40 / 5988
    assert set(np.round(m.stands[m.labels == 1], 9)) == {round(share / min(1, 5 / 12), 9)} and set(m.stands[m.labels == 0]) == {1.0}
    near, far = m.scores([b"rare kind 1500 of words", b"common sort 88 here 4"])
    assert near > far


def test_stands_weigh_votes():
    one = np.ones((4, 1), np.float32)
    m = quality.Model(np.ones(quality.TERMS, np.float32), np.ones((quality.TERMS, 1), np.float32), one, np.array([1.0, 0.0, 0.0, 0.0]), 0.5, np.array([0.5, 1.0, 1.0, 1.0]))
    assert m.scores([b"some text"])[0] == pytest.approx(0.5 / 3.5)


def test_tied_voters_share_the_last_place():
    m = quality.Model(np.ones(quality.TERMS, np.float32), np.eye(quality.TERMS, 1, dtype=np.float32), np.ones((20, 1), np.float32), np.array([1.0] * 5 + [0.0] * 15), 0.5)
    m.axes[:] = 1
    assert m.scores([b"some text"])[0] == pytest.approx(0.25)


def test_votes_equal_brute_force():
    rng = np.random.default_rng(8)
    docs = [" ".join(f"{rng.choice(['ab', 'cd', 'xyz'])}{rng.integers(9)}" for _ in range(30)).encode() for _ in range(40)]
    axes = quality._axes(quality._unit(quality.terms(docs)), 8)
    m = quality.Model(np.ones(quality.TERMS, np.float32), axes, np.zeros((0, 0)), (rng.random(40) > 0.4).astype(float), 0.5)
    m.voters = m.vectors(docs)
    got = m.scores(docs)
    for k, v in enumerate(m.voters):
        cos = m.voters @ v
        near = np.argsort(-cos, kind="stable")[: quality.NEIGHBOURS]
        w = np.maximum(cos[near], 0).astype(float) ** quality.SHARPNESS
        assert got[k] == pytest.approx((w * m.labels[near]).sum() / w.sum(), abs=1e-4)
    assert quality.Model(m.idf, axes, m.voters, m.labels, 0.5).scores([b""])[0] == 0.5
