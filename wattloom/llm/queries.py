"""The registered queries of the training-data operators and their SQL.  Each takes (spark, sf_dir)."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wattloom.llm import embed_dedup, quality, token_files
from wattloom.llm.common import stored, table
from wattloom.llm.fingerprints import likeness, near_counts, with_next
from wattloom.llm.mixing import mix, targets_by_weight, word_count
from wattloom.llm.neardup import hex16, near_duplicates
from wattloom.llm.oracle import SQL as SQL
from wattloom.llm.packing import pack
from wattloom.llm.secret_scan import BASE, joined, scan
from wattloom.llm.sharding import interleave
from wattloom.llm.substring_dedup import remove_repeats
from wattloom.llm.token_alignment import align_documents
from wattloom.llm.url_filter import judge
from wattloom.llm.vector_codes import encode


def op1_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = scan(table(spark, sf_dir, "documents").select("doc_id", "text"), "text", "spans")
    kinds = [r.kind for r in BASE]
    of = lambda *k: F.filter("spans", lambda s: s["kind"].isin(*k))
    counts = [F.size(of(k)).cast("long").alias(f"n_{k}") for k in kinds]
    return d.select("doc_id", *counts, F.sha2(joined(of(*kinds)).cast("binary"), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"))


def op2_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.coalesce(F.col("text"), F.lit(""))
    d = table(spark, sf_dir, "documents").select("doc_id", "source", (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"))
    out = interleave(d, "source", shards=16, key=["doc_id", "size", "text_crc32"])
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "source")


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = pack(d, "text", "doc_id", tokenizer=public_tokenizers.path("word_bpe_49k.json"), end_id=1, length=2048)
    return out.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")


def op4_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """near_docs: for every document whose id is divisible by 20, the other documents within 3 bits."""
    d = stored(with_next(table(spark, sf_dir, "documents").select("doc_id", "text"), "text", "doc_id"), "op4")
    asked = F.col("doc_id") % 20 == 0
    near = stored(near_counts(d.select("fp"), d.where(asked).select("fp")).select(F.col("fp").alias("fp2"), "near"), "op4-near")  # so that AQE can split a fingerprint that many share
    out = d.join(near, asked & (F.col("fp") == F.col("fp2")), "left")
    return out.select(
        "doc_id", "n_chars", "edited_sha256", hex16("fp").alias("fingerprint"), hex16("fp_edited").alias("edited_fingerprint"),
        likeness("fp", "fp_edited").alias("near_edited"), likeness("fp", "fp_next").alias("near_next"), (F.col("near") - 1).alias("near_docs"),
    )


#: The listed URL rules (verdict, host, path).
URL_RULES = [("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"), ("block", "net", "/es/"), ("block", "net", "/fr/")]


def op5_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = judge(table(spark, sf_dir, "pages").select("page_id", "url"), "url", URL_RULES)
    return out.select("page_id", "host", "path", "rule", "verdict", F.concat_ws(" ", "mined.antecedent").alias("mined"))


#: A document with a score from here on is taken as good.
GOOD = 0.7


def quality_scores(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """docs with score and predicted; labels of held-out documents aren't learned from."""
    learn = lambda d: d.where(~quality.held_out("doc_id"))
    model = quality.train(learn(docs.select("doc_id", "text")), learn(labels.select("doc_id", "quality")))
    return quality.score(docs, model, "text", "score").withColumn("predicted", (F.col("score") >= GOOD).cast("int"))


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = quality_scores(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "labels"))
    return out.select("doc_id", quality.held_out("doc_id").alias("held_out"), "score", "predicted")


def op7_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select("doc_id", "text")
    return near_duplicates(d, "text", "doc_id", words=3).select("doc_id", hex16("fp").alias("fingerprint"), "component_id")


#: Weights that the sources get in turn, by code point.
WEIGHTS = [1, 2, 3]


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select("doc_id", "source", word_count("text").alias("size"))
    sizes = {r["source"]: int(r["n"]) for r in d.groupBy("source").agg(F.sum("size").alias("n")).collect()}  # one row a source
    targets = targets_by_weight(sizes, WEIGHTS)
    out = mix(d.withColumn("members", F.array("source")), "members", "size", targets, key=["doc_id"])
    kind = "t_source string, source_size bigint, target double"
    named = F.broadcast(spark.createDataFrame([(s, sizes[s], targets[s]) for s in sizes], kind))
    return out.join(named, F.col("source").eqNullSafe(F.col("t_source")), "left").select("doc_id", "size", "source_size", "target", "taken", "source")


def op9_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select("doc_id", "text")
    files = token_files.write(d, "text", "doc_id", tokenizer=public_tokenizers.path("byte_bpe_50k.json"), end_id=0)
    return token_files.read(files, "doc_id").select("doc_id", "start", "n_tokens", "ids_crc32")


def op10_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embed_dedup.near_duplicates(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"), "embedding", "vec_id", 0.9)


def op11_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"), "text", "doc_id")


def op12_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode(table(spark, sf_dir, "embeddings").select("vec_id", "embedding", "label"), "embedding", "vec_id", "label")


def op13_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    paths = (public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))
    return align_documents(table(spark, sf_dir, "documents").select("doc_id", "text"), "text", "doc_id", paths=paths)


QUERIES = {
    "op1_secret_scans": op1_secret_scans,
    "op2_sharding": op2_sharding,
    "op3_packing": op3_packing,
    "op4_fingerprints": op4_fingerprints,
    "op5_url_filter": op5_url_filter,
    "op6_quality": op6_quality,
    "op7_simhash_near_dedup": op7_simhash_near_dedup,
    "op8_mixing": op8_mixing,
    "op9_token_files": op9_token_files,
    "op10_embedding_near_dedup": op10_embedding_near_dedup,
    "op11_substring_dedup": op11_substring_dedup,
    "op12_vector_codes": op12_vector_codes,
    "op13_token_alignment": op13_token_alignment,
}
