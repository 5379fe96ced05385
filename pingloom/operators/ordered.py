"""Ordered scans: what a row needs of the rows before it, for keys of any size.

Rows are sorted by (key, order) into ranges of like size and stored; a key that holds all rows is spread over all
ranges. Each range is scanned by itself, a row for each range (and key in it) is carried on, and both are combined.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.storage import stored


def laid_out(df: DataFrame, keys: list[str], order: list) -> DataFrame:
    """``df`` in ranges of (keys, order): ``_part`` numbers the range, ``_at`` orders all rows. The order should tell rows apart."""
    at = F.monotonically_increasing_id()
    return stored(df.orderBy(*keys, *order).withColumn("_at", at).withColumn("_part", F.shiftrightunsigned("_at", 33)))


def _same(a: str, b: str, keys: list[str]) -> Column:
    out = F.lit(True)
    for k in keys:
        out = out & F.col(f"{a}.{k}").eqNullSafe(F.col(f"{b}.{k}"))
    return out


def with_previous(rows: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """Laid-out rows with ``prev_`` columns of the row before of the same key; null for a key's first row."""
    now = F.struct(*keys, *columns)
    ends = rows.groupBy("_part").agg(F.max_by(now, "_at").alias("_end"))
    ends = ends.select("_part", F.lag("_end").over(W.orderBy("_part")).alias("_before"))  # a row for each range
    out = rows.withColumn("_p", F.lag(now).over(W.partitionBy("_part").orderBy("_at"))).join(ends, "_part")
    out = out.withColumn("_p", F.coalesce("_p", "_before"))
    same = F.col("_p").isNotNull()
    for k in keys:
        same = same & F.col(f"_p.{k}").eqNullSafe(F.col(k))
    return out.withColumns({f"prev_{c}": F.when(same, F.col(f"_p.{c}")) for c in columns}).drop("_p", "_before")


def with_running(rows: DataFrame, keys: list[str], sums: dict[str, Column] | None = None, highs: dict[str, Column] | None = None) -> DataFrame:
    """Laid-out rows with running sums (this row included) and highest values so far (this row left out; null at first) within the key."""
    named = {**{n: (F.sum, c, 0) for n, c in (sums or {}).items()}, **{n: (F.max, c, -1) for n, c in (highs or {}).items()}}
    inside = W.partitionBy("_part", *keys).orderBy("_at")
    carried = W.partitionBy(*keys).orderBy("_part").rowsBetween(W.unboundedPreceding, -1)  # a row for each range that the key reaches
    per = rows.groupBy("_part", *keys).agg(*[f(c).alias(n) for n, (f, c, _) in named.items()])
    per = per.withColumns({f"_c_{n}": f(n).over(carried) for n, (f, _, _) in named.items()}).drop(*named)
    own = rows.withColumns({n: f(c).over(inside.rowsBetween(W.unboundedPreceding, upto)) for n, (f, c, upto) in named.items()})
    out = own.alias("a").join(per.alias("b"), F.expr("a._part = b._part") & _same("a", "b", keys))  # a key may be null
    both = {n: F.coalesce(F.col(n), F.lit(0)) + F.coalesce(F.col(f"_c_{n}"), F.lit(0)) if f is F.sum else F.greatest(n, f"_c_{n}") for n, (f, _, _) in named.items()}
    return out.select(*[F.col(f"a.{c}") for c in rows.columns], *[x.alias(n) for n, x in both.items()])


def chains(df: DataFrame, keys: list[str], order: list, columns: list[str], linked: Column) -> DataFrame:
    """``df`` with ``chain`` (from 1 within the key): a row that is not ``linked`` to the one before opens a chain.

    ``linked`` may name columns and, as ``prev_``, those of ``columns`` of the row before.
    """
    rows = with_previous(laid_out(df, keys, order), keys, columns).withColumn("_new", F.when(F.coalesce(linked, F.lit(False)), 0).otherwise(1))
    return with_running(rows, keys, sums={"chain": F.col("_new")}).drop("_at", "_part", "_new")


def numbered(df: DataFrame, order: list, name: str = "number") -> DataFrame:
    """``df`` with ``name``: 1, 2, 3 ... over all rows in the order."""
    rows = laid_out(df, [], order)
    parts = rows.groupBy("_part").agg(F.count(F.lit(1)).alias("_rows"))
    parts = parts.select("_part", (F.sum("_rows").over(W.orderBy("_part")) - F.col("_rows")).alias("_before"))  # a row for each range
    return rows.join(parts, "_part").withColumn(name, F.col("_before") + F.col("_at").bitwiseAND(F.lit((1 << 33) - 1)) + 1).drop("_part", "_at", "_before")


def ranked(df: DataFrame, keys: list[str], order: list, name: str = "rank") -> DataFrame:
    """``df`` with ``name``: 1, 2, 3 ... within the key in the order; a key may hold all rows."""
    return with_running(laid_out(df, keys, order), keys, sums={name: F.lit(1)}).drop("_part", "_at")


#: Items of a digest, and levels of digests of digests: 4096 ** 3 items for each key.
FAN, LEVELS = 4096, 3


def digest_tree(df: DataFrame, keys: list[str], order: list, item: Column, fan: int = FAN) -> DataFrame:
    """``keys, n, digest``: SHA-256 over each key's items in the order, as a tree: of ``fan`` items each, then of ``fan`` digests each, and so on.

    No group is larger than ``fan``, however many items a key has. The comma joins items.
    """
    at = ranked(df.withColumn("_item", item), keys, order, "_n").select(*keys, (F.col("_n") - 1).alias("_n"), "_item", F.lit(1).cast("long").alias("_size"))
    for _ in range(LEVELS):
        parts = at.groupBy(*keys, F.expr(f"_n div {fan}").alias("_n"))
        at = parts.agg(F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(F.col("_n"), "_item"))), lambda x: x["_item"]), ","), 256).alias("_item"), F.sum("_size").alias("_size"))
    return at.select(*keys, F.col("_size").alias("n"), F.col("_item").alias("digest"))
