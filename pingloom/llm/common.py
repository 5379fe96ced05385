"""What the operators share: row ids and their way back to doc_id."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.storage import dropped, shared_dir, stored

__all__ = ["dropped", "keyed", "shared_dir", "stored", "with_doc_id", "with_rid"]


def with_rid(docs: DataFrame, carry: tuple[str, ...] = ()) -> tuple[DataFrame, DataFrame | None]:
    """``rid, text`` (and the columns of ``carry``) and, where ids had to be made, ``rid, doc_id``.

    rid is a unique long in the order of documents. Unique non-negative ids are used as they are (one scan of
    the id column finds out). Otherwise rows are numbered in the order (doc_id with null first, text): every row
    stays a document of its own, rows that share an id are ordered by text, and a wholly equal row counts as later
    than its twin. ``with_doc_id`` puts doc_id back.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), *carry)
    odd = docs.groupBy("doc_id").count().filter("count > 1 or doc_id is null or doc_id < 0").limit(1)
    if not odd.count():
        return docs.select(F.coalesce("doc_id", F.lit(-1)).alias("rid"), "text", *carry), None
    ids = stored(docs.orderBy(F.col("doc_id").asc_nulls_first(), F.col("text").asc_nulls_first()).withColumn("rid", F.monotonically_increasing_id()))
    return ids.select("rid", "text", *carry), ids.select("rid", "doc_id")


def with_doc_id(out: DataFrame, ids: DataFrame | None) -> DataFrame:
    """The result by rid with doc_id in its place."""
    if ids is None:
        return out.withColumnRenamed("rid", "doc_id")
    return ids.join(out, "rid").drop("rid")


def keyed(docs: DataFrame) -> tuple[DataFrame, str]:
    """``docs`` with a column (its name comes back) that is unique for each row, for joining an operator's result to its rows."""
    name = "_row"
    while name in docs.columns:
        name += "_"
    odd = docs.groupBy("doc_id").count().filter("count > 1 or doc_id is null or doc_id < 0").limit(1)
    if not odd.count():
        return docs.withColumn(name, F.coalesce(F.col("doc_id").cast("long"), F.lit(-1))), name
    return stored(docs.orderBy(F.col("doc_id").asc_nulls_first(), F.col("text").asc_nulls_first()).withColumn(name, F.monotonically_increasing_id())), name
