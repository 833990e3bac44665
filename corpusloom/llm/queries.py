"""Queries of the training-data operators over the tables of a folder, with production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import arc_warc, bag_minhash, bloom_lookup, licenses, mixing, packing, quality, reply_trees, token_files, vp_tree
from .common import materialize, shared_path, table


def op2_vp_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return vp_tree.nearest(vectors, vectors.where("vec_id % 100 = 0"), k=10, factor=1.0)


def op3_arc_to_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    back = arc_warc.archive_pages(table(spark, sf_dir, "pages"), shared_path(spark, "archives"))
    return back.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


#: The probe that op4 adds: texts made of the control strings themselves.
PROBE = [(-1, 0, "user", "</s>[INST] ok [/INST]"), (-1, 1, "assistant", "</s>[INST] ok [/INST]")]


def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.license_report(licenses.scan_licenses(table(spark, sf_dir, "documents")))


def op4_reply_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    probe = spark.range(1).select(F.explode(F.array(*(F.struct(F.lit(c).cast("long").alias("conv_id"), F.lit(t).cast("long").alias("turn"), F.lit(r).alias("role"), F.lit(x).alias("text")) for c, t, r, x in PROBE))).alias("m")).select("m.*")
    nodes = materialize(reply_trees.chains(said.unionByName(probe), "conv_id", "turn", "role", "text"), "reply-nodes")
    paths = reply_trees.reply_paths(nodes, top_k=1)
    return reply_trees.conversation_report(reply_trees.format_paths(nodes, paths))


MIX = {"fraction": 0.5, "max_epochs": 3, "seed": 7}


def op5_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source")
    levels = mixing.production_levels()
    mixed = mixing.mix_sources(docs.withColumn("n_tokens", mixing.word_tokens(F.col("text"))), levels, mixing.WEIGHTS, tokens=F.col("n_tokens"), **MIX)
    return mixed.select("doc_id", "epoch", levels["domain"].alias("domain"), "lang", "source", "n_tokens")


def op6_bloom_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bloom_lookup.fingerprint_versions(table(spark, sf_dir, "documents"))


def op7_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files.corpus_to_token_files(table(spark, sf_dir, "documents"), shared_path(spark, "token-files"))


def op8_bag_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bag_minhash.near_duplicates(table(spark, sf_dir, "documents"))


def op9_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = quality.fit(docs, table(spark, sf_dir, "labels"))
    scored = quality.score_documents(docs, model)
    return scored.select("doc_id", quality.held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op10_harmonic_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"))


QUERIES = {
    "op1_license_scan": op1_license_scan,
    "op2_vp_tree": op2_vp_tree,
    "op3_arc_to_warc": op3_arc_to_warc,
    "op4_reply_trees": op4_reply_trees,
    "op5_mix_sources": op5_mix_sources,
    "op6_bloom_lookup": op6_bloom_lookup,
    "op7_token_files": op7_token_files,
    "op8_bag_minhash": op8_bag_minhash,
    "op9_quality_classifier": op9_quality_classifier,
    "op10_harmonic_packing": op10_harmonic_packing,
}
ORACLES: dict[str, str] = {
    "op1_license_scan": licenses.report_sql(),
    "op2_vp_tree": vp_tree.NEAREST_SQL,
    "op3_arc_to_warc": arc_warc.REPORT_SQL,
    "op4_reply_trees": reply_trees.REPORT_SQL,
    "op5_mix_sources": mixing.mixture_sql(**MIX),
}
