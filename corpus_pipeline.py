"""From raw documents to packed training sequences: five stages, each over all that the one before kept."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wattloom.llm.common import P, ship, stored, table
from wattloom.llm.mixing import mix, targets_by_weight, word_count
from wattloom.llm.packing import pack
from wattloom.llm.queries import WEIGHTS, quality_scores
from wattloom.llm.secret_scan import redacted, scan
from wattloom.llm.shingle_dedup import near_copies

#: The columns of documents, which every stage but the last returns.
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents that the quality classifier rejects.  Its unlabelled texts are this stage's input."""
    ship(spark)
    return quality_scores(docs.select(COLUMNS), table(spark, sf_dir, "labels")).where("predicted = 1").select(COLUMNS)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one row of each component of texts at a similarity of 0.8 of their 5-word shingles: the one with
    the least doc_id (null last), by a hash of its columns and then its place where more rows have that id."""
    ship(spark)
    rows = stored(docs.select(*COLUMNS, F.monotonically_increasing_id().alias(f"{P}row")), "rows")
    found = near_copies(rows, "text", f"{P}row").withColumnRenamed(f"{P}row", f"{P}row2")
    order = F.struct(F.col("doc_id").isNull(), "doc_id", F.xxhash64("text", "lang", "source", "n_chars"), f"{P}row")
    d = rows.select(f"{P}row", order.alias("o")).join(found, F.col(f"{P}row") == F.col(f"{P}row2"))
    kept = d.groupBy("root").agg(F.min("o").alias("o")).select(F.col(f"o.{P}row").alias(f"{P}kept"))
    spare = found.join(kept, F.col(f"{P}row2") == F.col(f"{P}kept"), "left_anti").select(f"{P}row2")  # fewer than the rows that stay
    return rows.join(spare, F.col(f"{P}row") == F.col(f"{P}row2"), "left_anti").select(COLUMNS)


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces the secrets in every text by a mark; documents without any stay as they are."""
    ship(spark)
    found = scan(docs.select(COLUMNS), "text", "spans")
    clean = redacted(F.col("text"), F.col("spans"))
    return found.select("doc_id", clean.alias("text"), "lang", "source", F.when(F.size("spans") > 0, F.char_length(clean).cast("long")).otherwise(F.col("n_chars")).alias("n_chars"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each row as often as the mixture uses it: not at all, or up to three times.  Rows go by a number of their own,
    so that rows that repeat a doc_id, or have none, are used as often as the mixture says and no oftener."""
    ship(spark)
    rows = docs.select(*COLUMNS, word_count("text").alias("size"), F.xxhash64("text").alias(f"{P}t"), F.monotonically_increasing_id().alias(f"{P}row"))
    rows = stored(rows, "mixing-rows")
    sizes = {r["source"]: int(r["n"]) for r in rows.groupBy("source").agg(F.sum("size").alias("n")).collect()}  # one row a source
    small = rows.select("doc_id", f"{P}t", F.array("source").alias("members"), "size", f"{P}row")
    used = mix(small, "members", "size", targets_by_weight(sizes, WEIGHTS), key=["doc_id", f"{P}t"]).where("uses > 0")
    used = used.select(F.col(f"{P}row").alias(f"{P}row2"), "uses")
    return rows.join(used, F.col(f"{P}row") == F.col(f"{P}row2")).withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("uses")))).select(COLUMNS)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mixture as pieces of sequences of 2048 ids."""
    ship(spark)
    out = pack(docs.select("doc_id", "text"), "text", "doc_id", tokenizer=public_tokenizers.path("word_bpe_49k.json"), end_id=1, length=2048)
    return out.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")


STAGES = [
    ("quality classifier", keep_good),
    ("near duplicates", drop_near_duplicates),
    ("secret scan", redact_secrets),
    ("mixing", mix_sources),
    ("packing", pack_sequences),
]

#: The first stage learns a model, which SQL can't express; tests hold the near-duplicate stage against brute force and the others' operators
#: against theirs, not run() as a whole.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; what lies between two stages is written and read again."""
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = stored(docs, "pipeline-" + name.replace(" ", "-"))
    return docs
