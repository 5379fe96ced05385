"""The corpus pipeline: toxic documents go, one of each group of near copies stays, repeated passages go, sources
are mixed to their target weights, and what is left is encoded.

Each stage takes the documents that its predecessor kept and returns the columns of documents; the last returns
token ids. The driver of a pipeline may write and read them between stages, as ``run`` does.

Defined results of every stage: a null text counts as empty and is kept as long as the stage's rule keeps it (it has
no toxic terms, no near copy, no passage, and size 0, so the mix takes nothing of it); null ids and repeated rows stay
rows of their own, except that one of each group of near copies stays (ties: the smallest id, then text); very long
texts are taken whole; empty tables go through empty; columns other than those of documents are left out.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pingloom.llm import bpe, jaccard, mixing, substring, toxicity
from pingloom.llm.common import dropped, keyed, stored
from pingloom.llm.queries import tokenizer_path

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
#: The methods have no SQL form; tests compare the stages with brute force.
ORACLE_SQL = None


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the factorization machine does not call toxic (score below 0.3)."""
    docs = docs.select(*COLUMNS)
    model = toxicity.learn(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return toxicity.score(docs, model).filter("predicted = 0").select(*COLUMNS)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each group linked by Jaccard similarity 0.8 or more of 5-word shingles."""
    docs, row = keyed(docs.select(*COLUMNS))
    found = jaccard.jaccard_components(docs.select(F.col(row).alias("doc_id"), "text"), n=5, percent=80)
    return docs.join(found.filter("doc_id = component_id").select(F.col("doc_id").alias(row)), row, "left_semi").select(*COLUMNS)


def drop_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without words of 20-word windows that also start earlier; texts that lose nothing stay as they are."""
    out = substring.substring_dedup(docs, with_text=True, carry=("lang", "source"))
    return out.select("doc_id", F.col("kept_text").alias("text"), "lang", "source", F.length("kept_text").cast("long").alias("n_chars"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them, in the schedule's order: whole copies, then the first words of the part that is left."""
    docs, row = keyed(docs.select(*COLUMNS))
    taken = mixing.mix(docs.select(F.col(row).alias("doc_id"), "source", "text")).filter("taken > 0").select(F.col("doc_id").alias(row), "size", "taken", "slot", "cycle")
    out = docs.join(taken, row).withColumn("copy", F.explode(F.expr("sequence(0L, (taken - 1) div size)")))
    part = F.expr("cast(least(size, taken - copy * size) as int)")
    text = F.when(part == F.col("size"), F.col("text")).otherwise(F.array_join(F.slice(F.array_remove(F.split("text", mixing.WORD_GAP, -1), ""), 1, part), " "))
    out = out.withColumn("text", text).withColumn("place", F.col("slot") + F.col("copy") * F.col("cycle")).orderBy("place", "doc_id", row, "copy")
    return out.select("doc_id", "text", "lang", "source", F.length("text").cast("long").alias("n_chars"))


def encode_texts(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each text."""
    return bpe.encode(docs, tokenizer_path(), carry=("source",))


STAGES = [
    ("toxicity", drop_toxic),
    ("ngram_jaccard_join", drop_near_copies),
    ("substring_dedup", drop_repeated_passages),
    ("mixing", mix_sources),
    ("bpe", encode_texts),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages; what a stage has read is deleted once its own result is stored (the last one's input stays for the reader)."""
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = stored(docs)
            if before is not None:
                dropped(before)
            before = docs
    return docs
