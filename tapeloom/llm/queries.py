"""The registered queries of the training-data operators, with production parameters over whole tables, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tapeloom.llm import bloomlm, decontamination, lexical, neardup, packing, pii, quality, search, sharding, tokens, toxicity, turns, warc
from tapeloom.llm.common import is_held_out, table

#: Small enough for the test tables to have many shards.
SHARD_BYTES = 256 << 10


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = search.integer_vectors(table(spark, sf_dir, "embeddings"))
    found = search.search(vectors, F.col("id") % 50 == 0, k=5)
    return found.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def op2_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = pii.detect(docs, base_col="base")
    count = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    digest = F.sha2(pii.spans_text(F.col("base")).cast("binary"), 256)
    return found.select("doc_id", *map(count, pii.KINDS), digest.alias("base_sha256"), pii.spans_text(F.col("pii")).alias("spans"))


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    held = is_held_out("doc_id", 5, 0)
    scored = quality.score_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), ~held)
    return scored.select("doc_id", held.alias("held_out"), "score", "predicted")


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.count_tokens(table(spark, sf_dir, "documents"), tokenizer_path())


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    held = is_held_out("doc_id", 4, 2)
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = toxicity.score_toxicity(docs, table(spark, sf_dir, "labels"), ~held)
    return scored.select("doc_id", held.alias("held_out"), "score", "predicted")


def op6_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.deduplicate(table(spark, sf_dir, "documents"), size=2, num=80, den=100)


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = decontamination.decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), window=10)
    digest = F.sha2(F.array_join("items", ",").cast("binary"), 256)
    return out.select("doc_id", "n_words", "n_hit", "n_items", digest.alias("items_sha256"), "contaminated")


def op8_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard(table(spark, sf_dir, "documents"), SHARD_BYTES)


def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = warc.archive(table(spark, sf_dir, "pages"))
    back = warc.read_archive(spark, path, ["record_id", "record_type", "payload_digest", "payload_bytes", "refers_to"], verify=True)
    return back.select(warc.page_id_of("record_id").alias("page_id"), "payload_bytes", "payload_digest", "record_type", warc.page_id_of("refers_to").alias("refers_to"))


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), tokenizer_path(), size=4096, end_id=2).drop("ids")


def op11_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 best documents of every benchmark item."""
    return lexical.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), k=20)


def op12_lm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Log10 probabilities of all documents, learned from those not held out."""
    held = is_held_out("doc_id", 5, 1)
    scored = bloomlm.score_texts(table(spark, sf_dir, "documents"), ~held)
    return scored.select("doc_id", held.alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op13_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations, damaged by rule and repaired."""
    rows = table(spark, sf_dir, "conversations")
    return turns.repair(turns.damage(rows), rows)


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict:
    return {f.__name__: f for f in (op1_exact_topk, op2_pii, op3_quality, op4_token_counts, op5_toxicity, op6_near_duplicates, op7_decontamination, op8_sharding, op9_warc, op10_packing, op11_lexical_search, op12_lm_scores, op13_conversation_repair, pipeline)}


_OP1 = """
with v as (
  select row_number() over () as r, vec_id, list_transform(embedding, lambda x: cast(floor(256 * cast(x as double)) as bigint)) as e
  from embeddings
  where vec_id is not null and embedding is not null
    and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
scored as (
  select q.r, q.vec_id as query_id, c.vec_id,
         cast(coalesce(list_sum(list_transform(list_zip(q.e, c.e), lambda p: p[1] * p[2])), 0) as bigint) as score
  from v q join v c on c.r <> q.r and len(c.e) = len(q.e)
  where q.vec_id % 50 = 0)
select query_id, cast(rank as integer) as rank, vec_id, score
from (select *, row_number() over (partition by r order by score desc, vec_id) as rank from scored) s
where rank <= 5
"""

_OP6 = r"""
with recursive w as (
  select doc_id, list_filter(regexp_split_to_array(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') as w
  from documents),
s as (
  select doc_id, list_distinct(case when len(w) = 0 then [] when len(w) = 1 then [w[1]]
    else list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]) end) as s from w),
sets as (select min(doc_id) as rep, list_sort(s) as s, len(s) as n from s group by list_sort(s), len(s)),
tok as (select rep, n, unnest(s) as t from sets where n > 0),
-- the rarest tokens of a set suffice to find every set that shares 80 % with it
freq as (select t, count(*) as f from tok group by t having count(*) > 1),
ranked as (select tok.rep, tok.n, tok.t, row_number() over (partition by rep order by f, tok.t) as r, count(*) over (partition by rep) as m from tok join freq using (t)),
prefix as (select rep, n, t from ranked where r <= m - (n * 4 + 4) // 5 + 1),
cand as (select distinct a.rep as a, b.rep as b from prefix a join prefix b on a.t = b.t and a.rep < b.rep and 5 * least(a.n, b.n) >= 4 * greatest(a.n, b.n)),
links as (
  select a, b from (select c.a, c.b, len(list_intersect(x.s, y.s)) as i, x.n as n, y.n as k
    from cand c join sets x on x.rep = c.a join sets y on y.rep = c.b) p
  where 100 * i >= 80 * (n + k - i)),
both_ways as (select a, b from links union all select b, a from links),
reach as (select rep as a, rep as b from sets where n > 0 union select r.a, l.b from reach r join both_ways l on l.a = r.b),
comp as (select a as rep, min(b) as c from reach group by a)
select s.doc_id, cast(len(s.s) as bigint) as n_shingles,
       coalesce(comp.c, s.doc_id) as component_id, coalesce(comp.c, s.doc_id) = s.doc_id as kept
from s left join sets on len(s.s) > 0 and sets.s = list_sort(s.s) left join comp on comp.rep = sets.rep
"""

_OP7 = r"""
with w as (
  select doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') as w from documents),
i as (
  select item_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') as w from benchmark),
iw as (select item_id, unnest(list_transform(range(1, greatest(len(w) - 9, 1) + 1), lambda s: array_to_string(w[s:s + 9], ' '))) as x, least(len(w), 10) as n from i where len(w) > 0),
sizes as (select distinct n from iw),
dw as (select doc_id, n, s, array_to_string(w[s:s + n - 1], ' ') as x
  from (select doc_id, w, n, unnest(range(1, len(w) - n + 2)) as s from w, sizes where len(w) >= n) t),
hit as (select dw.doc_id, dw.s, dw.n, iw.item_id from dw join iw on dw.x = iw.x and dw.n = iw.n),
words as (select doc_id, count(distinct p) as n_hit from (select doc_id, unnest(range(s, s + n)) as p from hit) t group by doc_id),
items as (select doc_id, count(*) as n_items, string_agg(item_id, ',' order by item_id) as l from (select distinct doc_id, cast(item_id as varchar) as item_id from hit) t group by doc_id)
select w.doc_id, cast(len(w.w) as bigint) as n_words, cast(coalesce(n_hit, 0) as bigint) as n_hit,
       cast(coalesce(n_items, 0) as bigint) as n_items, sha256(coalesce(l, '')) as items_sha256, coalesce(n_hit, 0) > 0 as contaminated
from w left join words using (doc_id) left join items using (doc_id)
"""

_BITS = "array_to_string(list_transform(range(1, 4), lambda k: lpad(bin(cast('0x' || substr(md5({0}), 1 + 12 * (k - 1), 12) as bigint)), 48, '0'))[1:2], '')"
_OP8 = f"""
with d as (
  select doc_id, cast(octet_length(encode(coalesce(text, ''))) as bigint) as n_bytes,
         {_BITS.format("coalesce(cast(doc_id as varchar), '')")} || {_BITS.format("coalesce(cast(doc_id as varchar), '') || chr(10) || coalesce(text, '')")} as bits
  from documents),
levels as (select unnest(range(0, 65)) as k),
sums as (select k, substr(bits, 1, k) as shard, sum(n_bytes) as b, count(*) as n from d, levels group by 1, 2),
leaf as (select d.doc_id, d.bits, d.n_bytes, min(s.k) as depth from d join sums s on s.shard = substr(d.bits, 1, s.k) and (s.b <= {SHARD_BYTES} or s.n = 1) group by all)
select doc_id, n_bytes, l_shard as shard, cast(depth as integer) as depth, cast(s.b as bigint) as shard_bytes, s.n as shard_docs, s.b <= {SHARD_BYTES} as fits
from (select *, substr(bits, 1, depth) as l_shard from leaf) l join sums s on s.k = l.depth and s.shard = l.l_shard
"""

_OP9 = """
with p as (select page_id, octet_length(encode(coalesce(html, ''))) as n, sha1(coalesce(html, '')) as h from pages),
t as (select h, max(page_id) as top from p group by h),
b as (select p.*, t.top from p join t using (h))
select page_id, cast(n as bigint) as payload_bytes,
  array_to_string(list_transform(range(0, 8), lambda i: array_to_string(list_transform([15, 10, 5, 0],
    lambda s: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + ((cast('0x' || substr(h, 5 * i + 1, 5) as bigint) >> s) & 31), 1)), '')), '') as payload_digest,
  case when page_id = top then 'response' else 'revisit' end as record_type,
  case when page_id = top then null else top end as refers_to
from b
"""


_WORDS11 = r"list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+'), lambda x: x <> '')"
_OP11 = f"""
with d as (select row_number() over () as r, doc_id, {_WORDS11} as w from documents),
i as (select row_number() over () as i, item_id, {_WORDS11} as w from benchmark),
whole as (select count(*) as n, cast(sum(len(w)) as bigint) as l from d where len(w) > 0),
asked as (select i, item_id, t, count(*) as k from (select i, item_id, unnest(w) as t from i) x group by all),
held as (select r, doc_id, n, t, count(*) as tf from (select r, doc_id, len(w) as n, unnest(w) as t from d) x where t in (select t from asked) group by all),
weight as (select t, cast(floor(1000 * ln(cast(2 * n + 2 as double) / (2 * df + 1))) as bigint) as w from (select t, count(*) as df from held group by t) f, whole),
scored as (
  select i, item_id, r, doc_id, cast(sum(k * weight.w * ((1000000000 * tf) // (1000 * tf + 12 * (75 + (25 * held.n * whole.n) // whole.l)))) as bigint) as score
  from asked join held using (t) join weight using (t), whole group by all)
select item_id, cast(rank as integer) as rank, doc_id, score
from (select *, row_number() over (partition by i order by score desc, doc_id nulls last) as rank from scored where score > 0) s
where rank <= 20
"""

_STATES = "(values (0, 'u', 0), (1, 'u', 2), (2, 'a', 1), (3, 'u', 0)) g(state, want, closing)"  # nothing, after s, after u, after a
_OP13 = r"""
with recursive crc(i, c, k) as (select i, i, 0 from range(256) t(i) union all select i, case when c & 1 = 1 then xor(c >> 1, 3988292384) else c >> 1 end, k + 1 from crc where k < 8),
codes as (select list(c order by i) as tab from crc where k = 8),
src as (select row_number() over () as r, conv_id, turn, coalesce(role, ' ') as role, coalesce(text, ' ') as text,
  coalesce(cast(conv_id as varchar), ' ') || ':' || coalesce(cast(turn as varchar), ' ') as key from conversations),
kinds as (select src.*, xor(list_reduce(list_concat([4294967295], list_transform(string_split(key, ''), lambda x: cast(ascii(x) as bigint))),
  lambda h, x: xor(h >> 8, tab[(xor(h, x) & 255) + 1])), 4294967295) % 20 as kind from src, codes),
hurt as (select r * 2 + copy as r, conv_id, turn, case when kind = 4 then 'user' else role end as role,
  case when kind = 1 then '' when kind = 2 then regexp_replace(text, '[.!?]', '', 'g') else text end as text
  from kinds, range(2) t(copy) where kind <> 0 and (copy = 0 or kind = 3)),
placed as (select *, row_number() over (partition by conv_id order by turn nulls first, r) as i,
  row_number() over (partition by conv_id, role, text order by turn nulls first, r) > 1 as again from hurt),
flagged as (select *, case when not regexp_matches(text, '[^\x20\x09-\x0D]') then 'b' when again then 'd'
  when not regexp_matches(text, '[.!?][\x20\x09-\x0D]*\z') then 't' else '-' end as f from placed),
convs as (select row_number() over () as c, conv_id from (select distinct conv_id from conversations) x),
t as (select convs.c, f.i, substr(f.role, 1, 1) as ini, f.role, f.text, f.f in ('b', 'd') as bad, case when f.f = 't' then 3 else 0 end as extra
  from flagged f join convs on f.conv_id is not distinct from convs.conv_id),
ways(c, i, state, way) as (
  select c, 0, 0, {'cost': 0, 'audit': '', 'made': ''} from convs
  union all
  select c, i, state, min(way) from (
    select w.c, t.i, o.state, {'cost': w.way.cost + o.cost, 'audit': w.way.audit || o.edits, 'made': w.way.made || o.made} as way
    from ways w join t on t.c = w.c and t.i = w.i + 1 join """ + _STATES + r""" on g.state = w.state,
    lateral (
      select w.state as state, 4 as cost, 'D' as edits, '' as made
      union all select case g.want when 'u' then 2 else 3 end, t.extra, 'K', t.role || ':' || t.text || chr(10) where not t.bad and t.ini = g.want
      union all select 1, t.extra, 'K', t.role || ':' || t.text || chr(10) where not t.bad and t.ini = 's' and w.state = 0
      union all select case g.want when 'u' then 2 else 3 end, 3 + t.extra, 'R', case g.want when 'u' then 'user:' else 'assistant:' end || t.text || chr(10) where not t.bad and t.ini <> g.want
      union all select case g.want when 'u' then 3 else 2 end, 3 + t.extra, 'IK', case g.want when 'u' then 'user:' else 'assistant:' end || chr(10) || t.role || ':' || t.text || chr(10)
        where not t.bad and t.ini in ('u', 'a') and t.ini <> g.want
      union all select case g.want when 'u' then 3 else 2 end, 6 + t.extra, 'IR', case g.want when 'u' then 'user:' || chr(10) || 'assistant:' else 'assistant:' || chr(10) || 'user:' end || t.text || chr(10)
        where not t.bad and t.ini not in ('u', 'a')
      union all select case g.want when 'u' then 2 else 3 end, 7, 'ID', case g.want when 'u' then 'user:' else 'assistant:' end || chr(10)) o) x
  group by c, i, state),
ends as (select w.c, min({'cost': w.way.cost + 3 * g.closing, 'audit': w.way.audit || repeat('I', g.closing),
    'made': w.way.made || case g.closing when 2 then 'user:' || chr(10) || 'assistant:' || chr(10) when 1 then 'assistant:' || chr(10) else '' end}) as way
  from ways w join (select c, count(*) as n from t group by c) k on k.c = w.c and k.n = w.i join """ + _STATES + r""" on g.state = w.state group by w.c),
near as (select conv_id, substr(role, 1, 1) as x, lag(substr(role, 1, 1)) over (partition by conv_id order by i) as y, i from flagged),
bad as (select conv_id, count(*) as illegal from near where i > 1 and coalesce(y, '') || coalesce(x, '') not in ('su', 'ua', 'au') group by conv_id),
sums as (select conv_id, max(turn) - min(turn) + 1 - count(distinct turn) as gaps, count(*) filter (f = 'b') as b, count(*) filter (f = 'd') as d, count(*) filter (f = 't') as t from flagged group by conv_id)
select convs.conv_id, cast(coalesce(gaps, 0) as bigint) as gaps, coalesce(b, 0) as blank, coalesce(d, 0) as duplicate, coalesce(sums.t, 0) as truncated,
  coalesce(illegal, 0) as illegal, cast(coalesce(e.way.cost, 0) as bigint) as cost, coalesce(e.way.audit, '') as audit,
  sha256(coalesce(substr(e.way.made, 1, greatest(length(e.way.made) - 1, 0)), '')) as repaired_sha256
from convs left join sums on sums.conv_id is not distinct from convs.conv_id left join bad on bad.conv_id is not distinct from convs.conv_id left join ends e on e.c = convs.c
"""


def oracle_sql() -> dict[str, str]:
    return {"op11_lexical_search": _OP11, "op13_conversation_repair": _OP13, "op1_exact_topk": _OP1, "op6_near_duplicates": _OP6, "op7_decontamination": _OP7, "op8_sharding": _OP8, "op9_warc": _OP9}
