"""The registered queries of the subpackage: each applies one operator to a whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import alignment, bwt, decontaminate, filter_audit, htmltext, hyperminhash, langid, mixing, secrets, simhash, suffix_trees, toxicity, winnow
from .common import read


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_components(read(spark, sf_dir, "documents", "doc_id", "text"), shingle=4, radius=4)
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def op2_winnowing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return winnow.compare_edits(read(spark, sf_dir, "documents", "doc_id", "text"))


def op3_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.scan(read(spark, sf_dir, "documents", "doc_id", "text"))
    base = F.filter("spans", lambda s: s["kind_order"] < len(secrets.BASE))
    counts = [F.size(F.array_remove(F.transform("spans", lambda s: s["kind"] == F.lit(r.kind)), False)).cast("long").alias(f"n_{r.kind}") for r in secrets.BASE]
    return found.select("doc_id", *counts, F.sha2(secrets.span_string(base), 256).alias("base_sha256"), secrets.span_string(F.col("spans")).alias("spans"))


def op4_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    model = langid.train(read(spark, sf_dir, "documents", "text", "lang"))
    found = langid.identify_pages(read(spark, sf_dir, "pages", "page_id", "url", "html"), model)
    return found.select(F.col("key").alias("page_id"), "host", "declared", "text_lang", "lang", "confidence")


def op5_suffix_array(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bwt.remove_repeated_bytes(read(spark, sf_dir, "documents", "doc_id", "text")).drop("spans")


def op6_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return htmltext.extract(read(spark, sf_dir, "pages", "page_id", "html")).select("page_id", F.char_length("text").cast("long").alias("n_chars"), "text")


def op7_substring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_trees.remove_repeated_words(read(spark, sf_dir, "documents", "doc_id", "text")).drop("spans")


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents", "doc_id", "text")
    model = toxicity.train(docs, read(spark, sf_dir, "labels", "doc_id", "toxic"))
    found = toxicity.score(docs, model)
    return found.select("doc_id", (~toxicity.training_rows()).alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"), F.to_json("spans").alias("spans"))


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.find(read(spark, sf_dir, "documents", "doc_id", "text"), read(spark, sf_dir, "benchmark", "item_id", "text"), size=10, slop=1)
    items = F.array_sort(F.array_distinct(F.flatten(F.transform("hits", lambda h: h["items"]))))
    n_hit = decontaminate.covered(F.col("hits"))
    return found.select(
        "doc_id", "n_words", n_hit.alias("n_hit"), F.size(items).cast("long").alias("n_items"), F.sha2(F.array_join(items, ","), 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"),
        F.size("near").cast("long").alias("n_near"),
    )


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(read(spark, sf_dir, "documents", "doc_id", "text", "source"))


def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.audit(read(spark, sf_dir, "documents", "doc_id", "text", "source"), read(spark, sf_dir, "labels", "doc_id", "quality", "toxic"))


def op12_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment.alignments(read(spark, sf_dir, "documents", "doc_id", "text"))


def op13_hyperminhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hyperminhash.near_components(read(spark, sf_dir, "documents", "doc_id", "text"), shingle=5, percent=85)


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES = {
    f.__name__: f
    for f in (
        op1_simhash, op2_winnowing, op3_secrets, op4_language, op5_suffix_array, op6_html, op7_substring, op8_toxicity, op9_decontamination, op10_mixing, op11_filter_audit,
        op12_alignment, op13_hyperminhash, pipeline,
    )
}
_AUDIT_SQL = """
with base as (
  select doc_id, coalesce(source, '') as part, coalesce(text, '') as t, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') as w from documents
), first as (select t, min(doc_id) as first_id from base group by t
), failed as (
  select b.doc_id, part, case when len(w) < 200 then 1 else 0 end + case when 100 * len(list_distinct(w)) < 50 * len(w) then 2 else 0 end
    + case when 100 * length(regexp_replace(b.t, '[^A-Z]', '', 'g')) > 2 * length(b.t) then 4 else 0 end
    + case when regexp_matches(b.t, '[#$%&*|]') then 8 else 0 end + case when b.doc_id > first_id then 16 else 0 end as mask
  from base b join first f on b.t = f.t
), known as (select doc_id, max(case when quality = 1 then 1 else 0 end) as good, max(case when toxic = 1 then 1 else 0 end) as toxic from labels group by doc_id
), m as (
  select part, mask, count(*) as n, sum(coalesce(good, 0)) as good, sum(coalesce(toxic, 0)) as toxic,
    (mask & 1) + (mask >> 1 & 1) + (mask >> 2 & 1) + (mask >> 3 & 1) + (mask >> 4 & 1) as fails
  from failed left join known using (doc_id) group by part, mask
), f(letter, bit) as (values ('A', 1), ('B', 2), ('C', 4), ('D', 8), ('E', 16)
), orders as (
  select a.letter || b.letter || c.letter || d.letter || e.letter as filter_order, a.bit as b1, b.bit as b2, c.bit as b3, d.bit as b4, e.bit as b5
  from f a, f b, f c, f d, f e where a.bit + b.bit + c.bit + d.bit + e.bit = 31 and (a.bit | b.bit | c.bit | d.bit | e.bit) = 31
), steps as (
  select filter_order, 1 as step, b1 as bit, 0 as prior from orders union all select filter_order, 2, b2, b1 from orders union all select filter_order, 3, b3, b1 + b2 from orders
  union all select filter_order, 4, b4, b1 + b2 + b3 from orders union all select filter_order, 5, b5, b1 + b2 + b3 + b4 from orders
)
select part, filter_order, cast(step as integer) as step,
  cast(sum(case when mask & (prior | bit) = 0 then n else 0 end) as bigint) as kept, cast(sum(case when mask & bit <> 0 and mask & prior = 0 then n else 0 end) as bigint) as removed,
  cast(sum(case when mask & bit <> 0 and mask & prior <> 0 then n else 0 end) as bigint) as redundant, cast(sum(case when mask = bit then n else 0 end) as bigint) as unique_fails,
  cast(sum(case when mask & bit <> 0 and mask & prior = 0 then good else 0 end) as bigint) as good_lost,
  cast(sum(case when mask & bit <> 0 and mask & prior = 0 then toxic else 0 end) as bigint) as toxic_lost,
  cast(sum(case when mask & bit <> 0 then n * 120 // fails else 0 end) as bigint) as shapley
from m, steps group by part, filter_order, step
"""
#: Of the others, the brute-force versions in tests/llm stand for SQL: hashes, regular expressions with positions,
#: fixpoints, tokenizers and models.
ORACLE_SQL: dict[str, str] = {"op11_filter_audit": _AUDIT_SQL}
