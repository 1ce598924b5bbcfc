"""Queries over the tables of texts, by name, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession


def _table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def op1_compact_windows(spark: SparkSession, folder: str) -> DataFrame:
    from facetflow.llm.passages import repeated_passages

    return repeated_passages(_table(spark, folder, "documents"))


def op2_adaptive_dimension_scan(spark: SparkSession, folder: str) -> DataFrame:
    from pyspark.sql import functions as F

    from facetflow.llm.ann import nearest

    return nearest(_table(spark, folder, "embeddings"), F.col("id") % 100 == 0)


def op3_decision_list(spark: SparkSession, folder: str) -> DataFrame:
    from facetflow.llm.rules import BASE, quality

    found, _ = quality(_table(spark, folder, "documents"), _table(spark, folder, "labels"))
    return found.select("doc_id", *BASE, "base_failed", "kept", "rule")


def op4_deleted_interpolation(spark: SparkSession, folder: str) -> DataFrame:
    from facetflow.llm.ngram import score

    return score(_table(spark, folder, "documents"))


def op5_vector_bin_packing(spark: SparkSession, folder: str) -> DataFrame:
    import public_tokenizers

    from facetflow.llm.packing import pack

    return pack(_table(spark, folder, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op6_tensored_minhash(spark: SparkSession, folder: str) -> DataFrame:
    from facetflow.llm.neardup import near_duplicates

    return near_duplicates(_table(spark, folder, "documents"))


def op7_merge_replay_bpe(spark: SparkSession, folder: str) -> DataFrame:
    import public_tokenizers

    from facetflow.llm.bpe import encode_documents

    return encode_documents(_table(spark, folder, "documents"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


def op8_stratified_interleaving(spark: SparkSession, folder: str) -> DataFrame:
    from facetflow.llm.sharding import shard_digest

    return shard_digest(_table(spark, folder, "documents"))


def op9_noisy_channel_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    from facetflow.llm.toxicity import learn, score

    documents = _table(spark, folder, "documents")
    return score(documents, learn(documents, _table(spark, folder, "labels")))


def op10_quotation_linking(spark: SparkSession, folder: str) -> DataFrame:
    from facetflow.llm.quotes import formatted, linked_messages, reply_ordered

    return formatted(reply_ordered(linked_messages(_table(spark, folder, "conversations"))))


def op11_cover_tree(spark: SparkSession, folder: str) -> DataFrame:
    from facetflow.llm.covertree import near_duplicates

    return near_duplicates(_table(spark, folder, "embeddings"))


def op12_radix_tries(spark: SparkSession, folder: str) -> DataFrame:
    from facetflow.llm.tries import divergence

    return divergence(_table(spark, folder, "documents"))


def op13_radix_selection(spark: SparkSession, folder: str) -> DataFrame:
    from pyspark.sql import functions as F

    from facetflow.llm.negatives import mine

    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return mine(_table(spark, folder, "embeddings"), F.col("id") % 50 == 0, label=label)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = [f for k, f in globals().items() if k.startswith("op") and k[2].isdigit()]
    return {f.__name__: f for f in found}


#: Links by a plain join of each label, components by following them.
OP11_SQL = """
with recursive v as (
  select vec_id as id, label, list_transform(embedding, lambda x: x::double) as x from embeddings
  where label is not null and len(embedding) > 0 and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0 and len(list_filter(embedding, lambda x: x <> 0)) > 0
), links as (
  select a.id as a, b.id as b from v a join v b on a.label = b.label and a.id <> b.id and list_cosine_similarity(a.x, b.x) >= 0.93
), reach(id, other) as (
  select vec_id, vec_id from embeddings union select r.id, l.b from reach r join links l on l.a = r.other
)
select e.vec_id, (select count(*) from links l where l.a = e.vec_id) as n_links, c.component_id, c.component_id = e.vec_id as kept
from embeddings e join (select id, min(other) as component_id from reach group by id) c on c.id = e.vec_id
"""

#: A row a term, and every kept term for every group.
OP12_SQL = r"""
with d as (
  select row_number() over () as row_id, coalesce(lang, '') as lang, coalesce(source, '') as source,
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as text from documents
), t as (
  select row_id, lang, source, unnest(regexp_extract_all(text, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) as term from d
), kept as (
  select lang, term from t group by lang, term having count(distinct row_id) >= 30
), c as (
  select lang, source, term, count(*) as n from t semi join kept using (lang, term) group by all
), g as (
  select distinct lang, source from d
), every as (
  select g.lang, g.source, kept.term, coalesce(c.n, 0) as n from g join kept on g.lang = kept.lang left join c on c.lang = g.lang and c.source = g.source and c.term = kept.term
), v as (
  select lang, count(*) as v from kept group by lang
), l as (
  select lang, term, 1 + (1000000000::hugeint * (sum(n) + 5)) // (sum(sum(n)) over (partition by lang) + 5 * v) as q from every join v using (lang) group by lang, term, v
), p as (
  select lang, source, term, n, 1 + (1000000000::hugeint * (n + 5)) // (sum(n) over (partition by lang, source) + 5 * v) as p from every join v using (lang)
), pairs as (
  select a.lang, a.source, b.source as item, coalesce(s.value, 0) as value
  from g a join g b on a.lang = b.lang and a.source <> b.source
    left join (select x.lang, x.source, y.source as other, sum(abs(x.p - y.p)) as value from p x join p y on x.lang = y.lang and x.term = y.term and x.source <> y.source group by all) s
    on s.lang = a.lang and s.source = a.source and s.other = b.source
), parts as (
  select lang, source, 'pair' as part, item, value from pairs
  union all select p.lang, p.source, 'term', p.term, p.p - l.q from p join l using (lang, term) where p.n > 0 and p.p > l.q
)
select lang, source, part, item, value::bigint as value, (row_number() over (partition by lang, source, part order by value desc, item))::int as rank
from parts qualify part = 'pair' or rank <= 50
"""

#: Rows whose vectors take part, and all windows by plain joins and ranks.
OP13_SQL = """
with v as (
  select vec_id as id, case when vec_id % 7 = 0 then (label + 1) % 10 else label end as label, list_transform(embedding, lambda x: floor(256 * x::double)) as q
  from embeddings where vec_id is not null and label is not null and len(embedding) > 0 and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0
), s as (
  select a.id as anchor, b.id, a.label = b.label as same, list_inner_product(a.q, b.q)::bigint as score
  from v a join v b on a.id % 50 = 0 and a.id <> b.id
), p as (
  select anchor, id, score from s where same qualify row_number() over (partition by anchor order by score desc, id) <= 5
)
select p.anchor as anchor_id, p.id as positive_id, (row_number() over (partition by p.anchor, p.id order by s.score desc, s.id))::int as rank,
  s.id as negative_id, p.score as positive_score, s.score as negative_score
from p join s on p.anchor = s.anchor and not s.same and 50 * p.score <= 100 * s.score and 100 * s.score <= 95 * p.score
qualify row_number() over (partition by p.anchor, p.id order by s.score desc, s.id) <= 3
"""


def oracle_sql() -> dict[str, str]:
    return {"op11_cover_tree": OP11_SQL, "op12_radix_tries": OP12_SQL, "op13_radix_selection": OP13_SQL}
