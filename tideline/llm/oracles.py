"""SQL for DuckDB of the queries here that SQL can express over whole tables."""

from __future__ import annotations

from tideline.llm import license_scan
from tideline.llm.shard import Tree
from tideline.llm.url_filter import LOWER, UPPER

_LOWERED = f"translate(coalesce(text, ''), '{UPPER}', '{LOWER}')"
_ALNUM = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_SPACED = r"[^\x20\x09-\x0D]+"

DECONTAMINATE = f"""
with b as (select item_id, regexp_extract_all({_LOWERED}, '{_ALNUM}') w from benchmark),
i as (select item_id, n, len(s) q, unnest(s) g from (
 select item_id, least(5, len(w)) n, list_distinct(list_transform(range(len(w) - least(5, len(w)) + 1), lambda k: array_to_string(w[k + 1 : k + least(5, len(w))], ' '))) s from b where len(w) > 0)),
d as (select doc_id, regexp_extract_all({_LOWERED}, '{_ALNUM}') w from documents),
s as (select doc_id, n, unnest(list_distinct(list_transform(range(greatest(len(w) - n + 1, 0)), lambda k: array_to_string(w[k + 1 : k + n], ' ')))) g from d, (select distinct n from i))
select doc_id, item_id, cast(q as bigint) n_item, count(*) n_shared, count(*) / cast(q as double) containment
from s join i using (n, g) group by doc_id, item_id, q having count(*) >= ceil(0.8 * q - 1e-9)
"""

_TREE = Tree.of(24)
_DRAW = "-ln((('0x' || substr(md5(key || '/' || {name}), 1, 12))::bigint + 1)::double / 281474976710656.0::double) / {weight}"
_LEAST = "list_position({draws}, list_min({draws})) - 1"
_REGION, _RACK, _SHARD = (_DRAW.format(name=name, weight=weight) for name, weight in (("k", "regions[k + 1]"), ("region || '.' || k", "racks[region + 1][k + 1]"), ("region || '.' || rack || '.' || k", "shards[region + 1][rack + 1][k + 1]")))
SHARDS = f"""
with t as (select list_transform(range(256), lambda i: list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, z: case when c & 1 = 1 then xor(c >> 1, 3988292384) else c >> 1 end)) crc,
 {[sum(w for rack in region for _, w in rack) for region in _TREE.racks] + [1.0]}::double[] regions, {[[sum(w for _, w in rack) for rack in region] for region in _TREE.racks]}::double[][] racks, {[[[w for _, w in rack] for rack in region] for region in _TREE.racks]}::double[][][] shards, {[[[k for k, _ in rack] for rack in region] for region in _TREE.racks]} numbers),
d as (select t.*, doc_id, cast(doc_id as varchar) key, cast(octet_length(encode(coalesce(text, ''))) + 8 as bigint) size,
  cast(xor(list_reduce(list_concat([4294967295::bigint], list_transform(regexp_extract_all(hex(encode(coalesce(text, ''))), '..'), lambda x: ('0x' || x)::bigint)), lambda c, b: xor(c >> 8, crc[xor(c & 255, b) + 1])), 4294967295) as bigint) text_crc32 from documents, t),
a as (select *, list_transform(range(len(regions)), lambda k: {_REGION}) r from d),
b as (select *, {_LEAST.format(draws="r[:len(r) - 1]")} region, {_LEAST.format(draws="r")} = len(r) - 1 new from a),
c as (select *, list_transform(range(len(racks[region + 1])), lambda k: {_RACK}) r2 from b),
e as (select *, {_LEAST.format(draws="r2")} rack from c),
f as (select *, list_transform(range(len(shards[region + 1][rack + 1])), lambda k: {_SHARD}) r3 from e),
p as (select doc_id, size, text_crc32, cast(numbers[region + 1][rack + 1][{_LEAST.format(draws="r3")} + 1] as int) shard, new from f)
select doc_id, size, text_crc32, 'key' law, shard, row_number() over (partition by shard order by md5(cast(doc_id as varchar) || '/' || cast(text_crc32 as varchar)), doc_id, text_crc32, size) - 1 slot, case when new then cast(24 as int) else shard end grown_shard from p
"""

#: The exact answer, which op7 gives on tables of up to OPEN ** 2 rows, as a query opens all of them.
NEIGHBOURS = """
with v as (select vec_id, embedding::double[] e from embeddings where vec_id is not null and len(embedding) > 0
  and len(list_filter(embedding, lambda x: coalesce(isnan(x) or isinf(x), true))) = 0 and len(list_filter(embedding, lambda x: x <> 0)) > 0),
d as (select q.vec_id query_id, v.vec_id, sqrt(list_reduce(list_transform(range(1, len(q.e) + 1), lambda k: (v.e[k] - q.e[k]) * (v.e[k] - q.e[k])), lambda a, b: a + b)) score
  from v q join v on q.vec_id % 100 = 0 and v.vec_id <> q.vec_id and len(v.e) = len(q.e))
select query_id, cast(row_number() over (partition by query_id order by score, vec_id) as int) rank, vec_id, score from d qualify rank <= 10
"""

JACCARD = f"""
with recursive d as (select doc_id, regexp_extract_all({_LOWERED}, '{_SPACED}') w from documents),
s as (select doc_id, case when len(w) = 0 then []::varchar[] else list_distinct(list_transform(range(greatest(len(w) - 2, 1)), lambda k: array_to_string(w[k + 1 : k + 3], ' '))) end g from d),
e as (select doc_id, len(g) n, unnest(g) x from s),
c as (select a.doc_id p, b.doc_id q, a.n m, b.n n, count(*) k from e a join e b on a.x = b.x and a.doc_id < b.doc_id group by all),
l as (select p, q from c where 100 * k >= 90 * (m + n - k) union all select q, p from c where 100 * k >= 90 * (m + n - k)),
r(doc_id, other) as (select p, q from l union select r.doc_id, l.q from r join l on l.p = r.other)
select s.doc_id, cast(len(s.g) as bigint) n_shingles, least(s.doc_id, coalesce((select min(other) from r where r.doc_id = s.doc_id), s.doc_id)) component_id, (select count(*) from l where l.p = s.doc_id) n_links from s
"""


NEAR = f"""
with recursive d as (select doc_id, regexp_extract_all({_LOWERED}, '{_SPACED}') w from documents),
s as (select doc_id, case when len(w) = 0 then []::varchar[] else list_distinct(list_transform(range(greatest(len(w) - 4, 1)), lambda k: array_to_string(w[k + 1 : k + 5], ' '))) end g from d),
e as (select doc_id, len(g) n, unnest(g) x from s),
c as (select a.doc_id p, b.doc_id q, a.n m, b.n n, count(*) k from e a join e b on a.x = b.x and a.doc_id < b.doc_id group by all),
l as (select p, q from c where 100 * k >= 85 * (m + n - k) union all select q, p from c where 100 * k >= 85 * (m + n - k)),
r(doc_id, other) as (select p, q from l union select r.doc_id, l.q from r join l on l.p = r.other),
f as (select s.doc_id, cast(len(s.g) as bigint) n_shingles, least(s.doc_id, coalesce((select min(other) from r where r.doc_id = s.doc_id), s.doc_id)) component_id from s)
select *, doc_id = component_id kept from f
"""

_CRC = "xor(list_reduce(list_concat([4294967295::bigint], list_transform(regexp_extract_all(hex(encode(cast(c as varchar))), '..'), lambda x: ('0x' || x)::bigint)), lambda r, b: xor(r >> 8, crc[xor(r & 255, b) + 1])), 4294967295)"
TRIE = f"""
with k as (select list_transform(range(256), lambda i: list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, z: case when c & 1 = 1 then xor(c >> 1, 3988292384) else c >> 1 end)) crc),
o as (select conv_id c, turn, coalesce(role, '') role, coalesce(text, '') text, sha256(octet_length(encode(coalesce(role, '')))::varchar || ':' || coalesce(role, '') || coalesce(text, '')) g from conversations where conv_id is not null),
t as (select c, list({{'g': g, 'w': len(regexp_extract_all(text, '{_SPACED}'))}} order by turn nulls first, g) l from o group by c),
h as (select t.*, cast({_CRC} % 4 as bigint) h from t, k),
r as (select h.c, list_concat(coalesce(d.l, [])[:h.h], h.l[h.h + 1:]) l from h left join t d on d.c = h.c - h.c % 20),
p as (select c, len(l) n, unnest(range(len(l) + 1)) depth, l from r),
m as (select c, n, depth, list_transform(l[:depth], lambda x: x.g) path, case when depth > 0 then l[depth].w else 0 end w from p),
v as (select path, depth, min(c) conv_id, count(*) n_convs, any_value(w) w, sha256(coalesce(string_agg(c::varchar, ',' order by c) filter (n = depth), '')) ends_sha256 from m group by path, depth),
u as (select v.path, v.conv_id, a.conv_id parent_conv_id, v.depth, v.n_convs, v.ends_sha256, (v.n_convs - 1) * v.w own, (select count(*) from v y where y.depth = v.depth + 1 and y.path[:v.depth] = v.path) n_children from v left join v a on v.depth > 0 and a.path = v.path[:v.depth - 1]),
s as (select path[:e] top, n_children, own from (select *, unnest(range(depth + 1)) e from u)),
z as (select top, count(*) filter (n_children = 0) n_leaves, cast(sum(own) as bigint) saved_tokens from s group by top)
select conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256 from u join z on z.top = u.path
"""


def _notices() -> str:
    """(t, label, base, words, slack, least, first, phrase, others) of every template; others are its key phrases after the first."""
    rows = []
    for t, x in enumerate(license_scan.templates()):
        text = lambda words: str([w.decode() for w in words])
        (at, phrase), *others = x.keys
        more = "[" + ", ".join(f"{{'o': {k}, 'w': {text(p)}}}" for k, p in others) + "]::struct(o int, w varchar[])[]"
        rows.append(f"({t}, '{x.label}', {str(x.base).lower()}, {text(x.words)}, {x.slack}, {x.least}, {at}, {text(phrase)}, {more})")
    return "(values " + ", ".join(rows) + ") t(t, label, base, words, slack, least, k0, phrase, others)"


LICENSES = f"""
with d as (select doc_id, regexp_extract_all({_LOWERED}, '{_ALNUM}') w from documents),
t as (select *, len(words) n from {_notices()}),
e as (select doc_id, unnest(w) word, unnest(range(len(w))) + 1 pos from d),
c as (select e.doc_id, t.*, e.pos - t.k0 start from e join t on e.word = t.phrase[1]),
s as (select c.*, len(list_filter(range(n), lambda k: list_contains(d.w[greatest(1, start + k - slack) : greatest(0, start + k + slack)], words[k + 1]))) near
 from c join d using (doc_id) where d.w[start + c.k0 : start + c.k0 + len(phrase) - 1] = phrase
  and len(list_filter(others, lambda y: len(list_filter(range(start + y.o - slack, start + y.o + slack + 1), lambda q: q >= 1 and d.w[greatest(1, q) : greatest(0, q + len(y.w) - 1)] = y.w)) = 0)) = 0),
m as (select doc_id, label, base, start - 1 place, near / n::double share from s where near >= least)
select d.doc_id, cast(len(d.w) as bigint) n_words, count(*) filter (m.base) n_base, cast(min(place) filter (m.base) as bigint) first_word, cast(max(place) filter (m.base) as bigint) last_word,
 coalesce(array_to_string(list_sort(list(distinct label) filter (m.base)), ','), '') base_labels, coalesce(array_to_string(list_sort(list(distinct label) filter (label is not null)), ','), '') labels, coalesce(max(share), 0) score
from d left join m using (doc_id) group by d.doc_id, len(d.w)
"""
