"""Registered queries of this folder, each next to its SQL twin where SQL can say it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from runsift.llm import (collocations, decontaminate, hard_negatives, language, mixing, near_text, near_vectors, pii,
                         quality, repeats, secrets, suffix_tree, toxicity)


def _table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def op1_language_id(spark: SparkSession, folder: str) -> DataFrame:
    return language.identify(_table(spark, folder, "pages"), _table(spark, folder, "documents"))


def op2_minhash_near_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return near_text.near_duplicates(_table(spark, folder, "documents"), width=2)


def op3_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    docs, labels = _table(spark, folder, "documents"), _table(spark, folder, "labels")
    scored = toxicity.score(docs.select("doc_id", "text"), toxicity.fit_from_tables(docs, labels))
    return scored.select("doc_id", toxicity.held_out().alias("held_out"), "score",
                         (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op4_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    found = decontaminate.scan(_table(spark, folder, "documents").select("doc_id", "text"),
                               _table(spark, folder, "benchmark"))
    n_hit = F.aggregate("hit_spans", F.lit(0).cast("long"), lambda a, s: a + s["end"] - s["start"])
    return found.select(
        "doc_id", "n_words", n_hit.alias("n_hit"), F.size("hit_items").cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", "hit_items"), 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"))


def op5_quality(spark: SparkSession, folder: str) -> DataFrame:
    docs, labels = _table(spark, folder, "documents"), _table(spark, folder, "labels")
    scored = quality.score(docs.select("doc_id", "text"), labels)
    return scored.select("doc_id", toxicity.held_out().alias("held_out"), "score",
                         (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op6_suffix_repeats(spark: SparkSession, folder: str) -> DataFrame:
    return repeats.repeats(_table(spark, folder, "documents").select("doc_id", "text"))


def op7_pii(spark: SparkSession, folder: str) -> DataFrame:
    return pii.find(_table(spark, folder, "documents").select("doc_id", "text"))


def op8_source_mixing(spark: SparkSession, folder: str) -> DataFrame:
    docs, labels = _table(spark, folder, "documents"), _table(spark, folder, "labels")
    return mixing.mix(docs.select("doc_id", "source", "text"), labels, with_text=False)


def op9_secrets(spark: SparkSession, folder: str) -> DataFrame:
    return secrets.scan(_table(spark, folder, "documents").select("doc_id", "text")).drop("text")


def op10_near_vectors(spark: SparkSession, folder: str) -> DataFrame:
    return near_vectors.near_vectors(_table(spark, folder, "embeddings"))


def op11_collocations(spark: SparkSession, folder: str) -> DataFrame:
    return collocations.collocations(_table(spark, folder, "documents")).select(
        F.col("group").alias("lang"), "rank", "phrase", "a", "l", "r", "n", "score")


def op12_hard_negatives(spark: SparkSession, folder: str) -> DataFrame:
    rows = _table(spark, folder, "embeddings")
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives.mine(rows.withColumn("label", label), F.col("key") % 100 == 0)


def op13_suffix_tree_scores(spark: SparkSession, folder: str) -> DataFrame:
    return suffix_tree.score(_table(spark, folder, "documents"))


COLLOCATIONS_SQL = r"""
with pieces as (
  select coalesce(lang, 'und') as lang, unnest(string_split_regex(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) as piece
  from documents),
w as (select lang, list_filter(string_split_regex(piece, '[\x20\x09]+'), lambda x: x <> '') as ws from pieces),
grams as (
  select lang, size, array_to_string(ws[i:i + size - 1], ' ') as gram, count(*) as f
  from (select lang, ws, size, unnest(range(1, len(ws) - size + 2)) as i
        from w, (values (1), (2), (3)) as sizes(size))
  group by all),
totals as (select lang, sum(f)::bigint as n from grams where size = 1 group by lang),
kept as (
  select * from grams as g where size > 1 and f >= 10 and not exists (
    select 1 from grams as h where h.lang = g.lang and h.size = 3 and g.size = 2 and h.f >= 10 and 100 * h.f >= 50 * g.f
      and (h.gram[1:len(g.gram) + 1] = g.gram || ' ' or h.gram[-len(g.gram) - 1:] = ' ' || g.gram))),
cuts as (
  select k.lang, k.gram as phrase, k.f as a, l.f as l, r.f as r, c.k,
         1000000::hugeint * k.f * k.f // (l.f::hugeint * r.f) as score
  from kept as k join (values (1), (2)) as c(k) on c.k < k.size
  join grams as l on l.lang = k.lang and l.gram = array_to_string(string_split(k.gram, ' ')[1:c.k], ' ')
  join grams as r on r.lang = k.lang and r.gram = array_to_string(string_split(k.gram, ' ')[c.k + 1:], ' ')),
lowest as (
  select * from cuts qualify row_number() over (partition by lang, phrase order by score, k) = 1),
ranked as (
  select *, row_number() over (partition by lang order by score desc, a desc, phrase) as rank from lowest)
select lang, rank::bigint as rank, phrase, a::bigint as a, l::bigint as l, r::bigint as r, n, score::bigint as score
from ranked join totals using (lang) where rank <= 2000
"""

HARD_NEGATIVES_SQL = """
with v as (
  select vec_id, case when vec_id % 7 = 0 then (label + 1) % 10 else label end as label,
         list_transform(embedding, lambda x: floor(256 * x::double)) as ints
  from embeddings
  where label is not null and embedding is not null
    and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
s as (
  select a.vec_id as anchor_id, a.label = b.label as same, b.vec_id as other_id,
         list_dot_product(a.ints, b.ints)::bigint as score
  from v a join v b on a.vec_id % 100 = 0 and a.vec_id <> b.vec_id),
p as (
  select anchor_id, other_id as positive_id, score as positive_score from s where same
  qualify row_number() over (partition by anchor_id order by score desc, other_id) <= 5),
n as (
  select p.anchor_id, positive_id, positive_score, other_id as negative_id, score as negative_score,
         row_number() over (partition by p.anchor_id, positive_id order by score desc, other_id) as r
  from p join s on s.anchor_id = p.anchor_id and not same
   and 30 * positive_score <= 100 * score and 100 * score <= 90 * positive_score)
select anchor_id, positive_id, r::int as rank, negative_id, positive_score, negative_score from n where r <= 10
"""

QUERIES = {f.__name__: f for f in (
    op1_language_id, op2_minhash_near_dedup, op3_toxicity, op4_decontamination, op5_quality, op6_suffix_repeats, op7_pii, op8_source_mixing, op9_secrets,
    op10_near_vectors, op11_collocations, op12_hard_negatives, op13_suffix_tree_scores)}
ORACLES: dict[str, str] = {"op11_collocations": COLLOCATIONS_SQL, "op12_hard_negatives": HARD_NEGATIVES_SQL}
