"""Five stages from raw documents to token ids; each reads what the one before has written.

Every stage but the last returns the columns of documents (doc_id, text, lang, source, n_chars), and each stage's
decisions hold for the next: documents without a recognisable language go and `lang` is the predicted one; of each
class of near-duplicates the document with the least doc_id stays; bytes of repeated strings are cut from
`text` (what is left of a character that a cut splits goes too) and `n_chars` follows; documents that
overlap a benchmark text go; the rest is encoded.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import bpe, decontaminate, language, minhash, suffix
from tessera.llm.common import table, workspace

TOKENIZER = "byte_bpe_50k.json"
COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents whose text is null or has no letter; `lang` becomes the predicted language.

    Where no document is labelled, nothing can be learned: all texts with a letter stay as they are."""
    texts = language.sample(docs.where(~language.held_out()))
    if not texts:
        return docs.select(*COLUMNS).where(F.col("text").rlike(r"\p{L}"))
    found = language.identify(docs.select(*COLUMNS), texts).where("lang_pred <> 'und'")
    return found.withColumn("lang", F.col("lang_pred")).select(*COLUMNS)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document with the least doc_id of each class, once; a document is a pair of doc_id and text, ids come before none."""
    docs = docs.select(*COLUMNS)
    h1, h2 = F.xxhash64("text"), F.xxhash64(F.lit(1), "text")
    texts = docs.groupBy("doc_id").agg(F.min(h1).alias("lo"), F.max(h1).alias("hi"), F.min(h2).alias("lo2"), F.max(h2).alias("hi2"))
    if texts.where("doc_id IS NULL OR lo <> hi OR lo2 <> hi2").isEmpty():  # a doc_id says which document it is
        keep = minhash.classes(docs.select("doc_id", "text")).where("doc_id = class_id").select("doc_id").distinct()
        return docs.join(keep, "doc_id", "left_semi").dropDuplicates(["doc_id"])
    keyed = docs.withColumn("_k", F.xxhash64(F.lit(2), "doc_id", "text"))
    found = minhash.classes(keyed.select(F.col("_k").alias("doc_id"), "text")).distinct().withColumnRenamed("doc_id", "_k")
    each = keyed.select("_k", "doc_id", h1.alias("_1"), h2.alias("_2")).distinct().join(found, "_k")
    least = each.groupBy("class_id").agg(F.min(F.struct(F.isnull("doc_id").alias("none"), "doc_id", "_1", "_2", "_k")).alias("d"))
    keep = least.select("d._k", "d._1", "d._2")
    kept = keyed.withColumns({"_1": h1, "_2": h2}).join(keep, ["_k", "_1", "_2"], "left_semi")
    return kept.dropDuplicates(["_k", "_1", "_2"]).select(*COLUMNS)


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cuts the bytes of strings that also start earlier; a document of which nothing is left stays, empty."""
    cut = suffix.dedup(docs, carry=("lang", "source"), text=True)
    return cut.withColumnRenamed("kept", "text").withColumn("n_chars", F.char_length("text").cast("long")).select(*COLUMNS)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that overlap a text of `benchmark`."""
    return decontaminate.without(docs.select(*COLUMNS), table(spark, sf_dir, "benchmark"))


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, lang, source, n_tokens, ids (array<int>) and the SHA-256 of what they decode to."""
    done = bpe.round_trip(docs.select("doc_id", "lang", "source", "text"), public_tokenizers.path(TOKENIZER))
    return done.select("doc_id", "lang", "source", F.size("ids").cast("long").alias("n_tokens"), "ids", F.sha2("decoded", 256).alias("decoded_sha256"))


STAGES = [
    ("language ID", language_id),
    ("MinHash near-dedup", near_dedup),
    ("suffix-array dedup", substring_dedup),
    ("benchmark decontamination", decontamination),
    ("BPE encoding and decoding", encoding),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on `documents`, each written to the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        out = stage(spark, docs, sf_dir)
        if k == len(STAGES) - 1:
            return out
        at = workspace(spark, f"stage{k}")
        out.write.parquet(at)
        docs = spark.read.schema(out.schema).parquet(at)


#: Cross parsing, sketches and byte-pair merges are not SQL; tests/llm/test_pipeline.py has a brute-force version.
ORACLE_SQL = None
