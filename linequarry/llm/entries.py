"""Registered queries of this subpackage: name -> callable, and SQL where SQL can express one."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontaminate, html_layout, langid, lm_score, minhash, mixing, passages, toxicity, url_rules, vectors


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def remainder(n: int, id_col: str = "doc_id"):
    """crc32(id as text) mod n; -1 for a null id."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % n, F.lit(-1))


def op1_passage_chaining(spark, sf_dir):
    return passages.repeated_passages(table(spark, sf_dir, "documents"))


def op2_toxicity(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    model = toxicity.train(docs, table(spark, sf_dir, "labels"), learn_from=remainder(3) != 1)
    held_out = (remainder(3) == 1).alias("held_out")
    return toxicity.scores(docs, model).select("doc_id", held_out, "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))


def op3_minhash(spark, sf_dir):
    return minhash.near_duplicates(table(spark, sf_dir, "documents"), width=2, percent=80)


URL_RULES = [("org/", "allow"), ("example.org/es/", "block"), ("example.org/en/1", "block"), ("com/fr/", "allow"), ("com/de/", "block")]


def op4_url_reputation(spark, sf_dir):
    """Labels of the documents table stand for page outcomes: bad = low quality or toxic, by equal id."""
    labels = table(spark, sf_dir, "labels")
    bad = F.when((F.col("quality") == 0) | (F.col("toxic") == 1), 1).otherwise(0).alias("bad")
    out = url_rules.judge_urls(table(spark, sf_dir, "pages"), labels.select(F.col("doc_id").alias("page_id"), bad), URL_RULES)
    return out.withColumns({c: F.round(c, 6) for c in ("bad_rate", "bad_low")})


def op5_gru_lm(spark, sf_dir):
    out = lm_score.score_documents(table(spark, sf_dir, "documents"), learn_from=remainder(7) != 2)
    return out.withColumn("held_out", remainder(7) == 2).select("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op6_html_layout(spark, sf_dir):
    return html_layout.extract(table(spark, sf_dir, "pages"))


def op7_collision_counting(spark, sf_dir):
    return vectors.near_vectors(table(spark, sf_dir, "embeddings"), limit=0.95)


def op8_containment(spark, sf_dir):
    return decontaminate.contained_items(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op9_langid(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    model = langid.train(docs, learn_from=remainder(5) != 0)
    return langid.predict(docs, model).select("doc_id", (remainder(5) == 0).alias("held_out"), "lang_pred", "score")


MIX = {"budget": 1.0, "max_epochs": 2.0, "block_tokens": 100_000, "slice_rows": 2000, "seed": 1}


def op10_temperature_mix(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    return mixing.plan(docs, **MIX).drop("text")


QUERIES = {
    "op1_passage_chaining": op1_passage_chaining,
    "op2_toxicity": op2_toxicity,
    "op3_minhash": op3_minhash,
    "op4_url_reputation": op4_url_reputation,
    "op5_gru_lm": op5_gru_lm,
    "op6_html_layout": op6_html_layout,
    "op7_collision_counting": op7_collision_counting,
    "op8_containment": op8_containment,
    "op9_langid": op9_langid,
    "op10_temperature_mix": op10_temperature_mix,
}
ORACLE_SQL = {
    "op7_collision_counting": vectors.ORACLE,
    "op10_temperature_mix": mixing.oracle(**MIX),
    "op4_url_reputation": url_rules.oracle(URL_RULES, 0.25, 1.0),
    "op8_containment": decontaminate.ORACLE,
}
