"""Registered queries of the corpus operators, each over its whole table, and their DuckDB equivalents."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import corpus_pipeline
import public_tokenizers

from lexmill.llm import bytebpe, conversations, decontaminate, language, mixing, negatives, piececount, projections, quality, secrets, shards, simhash, tokenfile
from lexmill.session import table


def op1_entropy_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_digest(table(spark, sf_dir, "documents"))


def op2_language_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = language.held_out_fold(table(spark, sf_dir, "documents"))
    taught = docs.where(F.crc32(F.col("doc_id").cast("string")) % 3 != 1).select("doc_id", "text", "lang")
    return language.predict(docs, language.train(taught), ("doc_id", "held_out"))


def op3_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = secrets.train(secrets.random_samples(spark).unionAll(secrets.ordinary_samples(docs)))
    return secrets.scan(docs, model)


def op4_histogram_sort(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return shards.shard_digest(docs, 40)


def op5_piece_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return piececount.count_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


def op6_token_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    file = tokenfile.write_token_file(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
    return tokenfile.read_token_file(file)


def op7_collision_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return projections.near_vectors(table(spark, sf_dir, "embeddings"))


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.simhash_groups(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op9_decision_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    judged = quality.judge(docs, table(spark, sf_dir, "labels"))
    counts = [F.col(f"_q.{c}").alias(c) for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")]
    return judged.select("doc_id", *counts, F.col("_base_failed").alias("base_failed"), F.col("_kept").alias("kept"), F.col("_rule").alias("rule"))


def op10_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bytebpe.encode_digests(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


def op11_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contamination_report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return negatives.hard_negatives(vectors.select("vec_id", "embedding", label.alias("label")), F.col("vec_id") % 50 == 0)


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.col("conv_id").cast("long")
    return conversations.conversation_trie(table(spark, sf_dir, "conversations"), c - c % 5, F.crc32(c.cast("string")) % 9)


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus_pipeline.run(spark, sf_dir)


#: All pairs of usable vectors of a label, then the smallest vec_id along links.
OP7_SQL = """
with recursive v as (select vec_id, label, list_transform(embedding, lambda x: cast(x as double)) as e from embeddings where label is not null and embedding is not null),
u as (select * from v where len(e) > 0 and len(list_filter(e, lambda x: x is null or not isfinite(x))) = 0 and len(list_filter(e, lambda x: x <> 0)) > 0),
l as (select a.vec_id as a, b.vec_id as b from u a join u b on a.label = b.label and a.vec_id <> b.vec_id and len(a.e) = len(b.e) where list_cosine_similarity(a.e, b.e) >= 0.93),
r(node, c) as (select vec_id, vec_id from embeddings union select l.b, r.c from r join l on l.a = r.node and r.c < l.b)
select e.vec_id, (select count(*) from l where l.a = e.vec_id) as n_links, (select min(c) from r where r.node = e.vec_id) as component_id,
(select min(c) from r where r.node = e.vec_id) = e.vec_id as kept from embeddings e
"""

#: Every window of every text against the windows of the items; the words of the windows that occur are hit.
OP11_SQL = r"""
with low as (select 'd' as kind, doc_id as id, translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as t from documents
union all select 'b', item_id, translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') from benchmark),
w as (select kind, id, coalesce(regexp_extract_all(t, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) as ws from low),
starts as (select id, ws, unnest(case when len(ws) >= 10 then range(1, len(ws) - 8) when len(ws) > 0 then [1] else [] end) as i from w where kind = 'b'),
grams as (select distinct id as item_id, ws[i : i + 9] as g, len(ws[i : i + 9]) as k from starts),
sizes as (select distinct k from grams),
probes as (select w.id, i, k, ws[i : i + k - 1] as g from w, sizes, lateral (select unnest(range(1, greatest(len(ws) - k, 0) + 2)) as i) where kind = 'd' and len(ws) >= k),
met as (select p.id, p.i, p.k, grams.item_id from probes p join grams on grams.g = p.g and grams.k = p.k),
hit as (select id, count(distinct place) as n_hit from (select id, unnest(range(i, i + k)) as place from met) group by id),
items as (select id, count(*) as n_items, string_agg(item, ',' order by item) as names from (select distinct id, cast(item_id as varchar) as item from met) group by id)
select w.id as doc_id, cast(len(ws) as bigint) as n_words, coalesce(n_hit, 0) as n_hit, coalesce(n_items, 0) as n_items, sha256(coalesce(names, '')) as items_sha256, n_hit is not null as contaminated
from w left join hit on hit.id = w.id left join items on items.id = w.id where kind = 'd'
"""

#: The scores of all anchors with all rows, in full.
OP12_SQL = """
with v as (select vec_id, case when vec_id % 7 = 0 then (label + 1) % 10 else label end as label, list_transform(embedding, lambda x: floor(256 * cast(x as double))) as q
  from embeddings where label is not null and embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
s as (select a.vec_id as anchor_id, b.vec_id as id, a.label = b.label as same, cast(list_inner_product(a.q, b.q) as bigint) as score from v a join v b on a.vec_id <> b.vec_id where a.vec_id % 50 = 0),
p as (select * from (select *, row_number() over (partition by anchor_id order by score desc, id) as k from s where same) where k <= 5),
n as (select p.anchor_id, p.id as positive_id, row_number() over (partition by p.anchor_id, p.id order by s.score desc, s.id) as rank, s.id as negative_id, p.score as positive_score, s.score as negative_score
  from p join s on s.anchor_id = p.anchor_id and not s.same and 50 * p.score <= 100 * s.score and 100 * s.score <= 95 * p.score)
select anchor_id, positive_id, cast(rank as int) as rank, negative_id, positive_score, negative_score from n where rank <= 3
"""

#: Nodes are prefixes as lists; every node meets its ancestors. The crc32 goes bit by bit.
OP13_SQL = """
with t as (select conv_id, row_number() over (partition by conv_id order by turn nulls first, role, text) as pos, coalesce(role, '') as role, coalesce(text, '') as text from conversations where conv_id is not null),
h as (select distinct conv_id, conv_id - conv_id % 5 as source,
  xor(list_reduce(list_concat([cast(4294967295 as bigint)], list_transform(string_split(cast(conv_id as varchar), ''), lambda x: cast(ascii(x) as bigint))),
    lambda c, b: list_reduce([xor(c, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda x, z: xor(x >> 1, (x & 1) * 3988292384))), 4294967295) % 9 as h from t),
rebuilt as (select h.conv_id, pos, role, text from h join t on t.conv_id = h.source and pos <= h union all select h.conv_id, pos, role, text from h join t on t.conv_id = h.conv_id and pos > h),
c as (select h.conv_id, coalesce(list({'r': role, 't': text} order by pos) filter (where pos is not null), []) as turns from h left join rebuilt r on r.conv_id = h.conv_id group by h.conv_id),
p as (select conv_id, turns, unnest(range(0, len(turns) + 1)) as depth from c),
m as (select conv_id, depth, turns[1 : depth] as path, len(turns) = depth as ends from p),
n as (select path, depth, min(conv_id) as conv_id, count(*) as n_convs, coalesce(string_agg(cast(conv_id as varchar), ',' order by conv_id) filter (where ends), '') as ends from m group by path, depth),
k as (select path[1 : depth - 1] as path, depth - 1 as depth, count(*) as n_children from n where depth > 0 group by all),
f as (select n.*, coalesce(n_children, 0) as n_children, case when depth = 0 then 0 else (n_convs - 1) * strlen(path[depth].t) end as own from n left join k using (path, depth)),
a as (select path[1 : d] as path, d as depth, own, n_children = 0 as leaf from (select *, unnest(range(0, depth + 1)) as d from f)),
s as (select path, depth, sum(own) as saved, count(*) filter (where leaf) as n_leaves from a group by path, depth)
select f.conv_id, cast(f.depth as bigint) as depth, up.conv_id as parent_conv_id, f.n_convs, f.n_children, s.n_leaves, cast(s.saved as bigint) as saved_tokens, sha256(f.ends) as ends_sha256
from f join s using (path, depth) left join n up on up.depth = f.depth - 1 and up.path = f.path[1 : f.depth - 1]
"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_entropy_mix": op1_entropy_mix,
        "op2_language_centroids": op2_language_centroids,
        "op3_secrets": op3_secrets,
        "op4_histogram_sort": op4_histogram_sort,
        "op5_piece_counts": op5_piece_counts,
        "op6_token_file": op6_token_file,
        "op7_collision_counts": op7_collision_counts,
        "op8_simhash": op8_simhash,
        "op9_decision_list": op9_decision_list,
        "op10_byte_bpe": op10_byte_bpe,
        "op11_decontaminate": op11_decontaminate,
        "op12_hard_negatives": op12_hard_negatives,
        "op13_prefix_trie": op13_prefix_trie,
        "pipeline": pipeline,
    }


def oracle_sql() -> dict[str, str]:
    found = {"op7_collision_counts": OP7_SQL, "op11_decontaminate": OP11_SQL, "op12_hard_negatives": OP12_SQL, "op13_prefix_trie": OP13_SQL, "pipeline": corpus_pipeline.ORACLE_SQL}
    return {k: v for k, v in found.items() if v}
