"""Connected components of a table of links, by alternating large-star and small-star steps.

Every step is a combinable minimum for each node and an equi-join; steps end in tables in the shared folder, so
lineage stays short and nothing is gathered in one place. The minima are a table of their own, so both sides of the
join come from plain exchanges, and Spark can split the links of a node that has very many.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.storage import stored


def _step(edges: DataFrame, large: bool) -> DataFrame:
    """``edges`` (a > b). Large: neighbours above a node move to its smallest; small: those below it and itself do."""
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))) if large else edges
    least = stored(both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m")))
    moved = both.join(least, "a")
    if large:
        out = moved.filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:
        out = moved.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.select("a", F.col("m").alias("b")))
    return out.filter("a > b").distinct()


def components(edges: DataFrame) -> DataFrame:
    """``node, component`` for every node of ``edges`` (comparable columns a and b): the smallest node reachable."""
    e = stored(edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    mark = lambda d: tuple(d.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
    before = mark(e)
    while before[0]:
        e = stored(_step(_step(e, True), False))
        now = mark(e)
        if now == before:
            break
        before = now
    # all links now lead from a node to the smallest of its component
    return e.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(e.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())


def components_with_offsets(edges: DataFrame) -> DataFrame:
    """``node, component, ping_offset`` from links (later, earlier, k): earlier lies k rows behind later on one axis.

    Nodes hang below smaller neighbours in a forest that is halved again and again: a node's parent becomes its
    parent's parent, and the way there the sum of both ways. Roots then hang below the smallest root that a link leads
    to, and the halving goes on, so a chain of n frames takes about log n rounds of two tables. A component with a link
    that disagrees is left out as a whole; the first frame of the others is at 0.
    """
    both = stored(edges.select(F.col("later").alias("a"), F.col("earlier").alias("b"), "k").unionByName(edges.select(F.col("earlier").alias("a"), F.col("later").alias("b"), (-F.col("k")).alias("k"))))
    # ``way``: where a node lies on the axis of its root, as earlier lies k behind later
    tree = stored(both.select(F.col("a").alias("node")).distinct().select("node", F.col("node").alias("root"), F.lit(0).cast("bigint").alias("way")))
    while True:
        x = tree.select(F.col("node").alias("a"), F.col("root").alias("ra"), F.col("way").alias("wa"))
        y = tree.select(F.col("node").alias("b"), F.col("root").alias("rb"), F.col("way").alias("wb"))
        # a link between two trees hangs the larger root below the smaller one
        hang = both.join(x, "a").join(y, "b").filter("rb < ra").groupBy(F.col("ra").alias("node")).agg(F.min(F.struct(F.col("rb").alias("root"), (F.col("wb") - F.col("k") - F.col("wa")).alias("way"))).alias("h"))
        hang = stored(hang.select("node", "h.root", "h.way"))
        if hang.isEmpty():
            break
        jump = hang
        while True:  # roots that hang below others: halve their chains
            up = jump.select(F.col("node").alias("root"), F.col("root").alias("r2"), F.col("way").alias("w2"))
            far = jump.join(up, "root", "left")
            if far.filter("r2 is not null").isEmpty():
                break
            jump = stored(far.select("node", F.coalesce("r2", "root").alias("root"), (F.col("way") + F.coalesce("w2", F.lit(0))).alias("way")))
        up = jump.select(F.col("node").alias("root"), F.col("root").alias("r2"), F.col("way").alias("w2"))
        tree = stored(tree.join(up, "root", "left").select("node", F.coalesce("r2", "root").alias("root"), (F.col("way") + F.coalesce("w2", F.lit(0))).alias("way")))
    at = tree.select("node", F.col("root").alias("component"), F.col("way").alias("at"))
    a, b = at.select(F.col("node").alias("later"), F.col("at").alias("x"), "component"), at.select(F.col("node").alias("earlier"), F.col("at").alias("y"))
    wrong = edges.join(a, "later").join(b, "earlier").filter("y - x <> k").select("component").distinct()
    at = at.join(wrong, "component", "left_anti")
    base = at.groupBy("component").agg(F.min("at").alias("base"))
    return at.join(base, "component").select("node", "component", (F.col("at") - F.col("base")).alias("ping_offset"))


def mask_components(pixels: DataFrame, least: int) -> DataFrame:
    """8-connected parts of the foreground: ``pixels`` (image_id, row_idx, col_idx, sample) from ``least`` up.

    Runs within a row are found by gaps and islands; runs of neighbouring rows that touch, corners included, are
    linked. Gives image_id, label, box (x, y, w, h), area and fill.
    """
    from pyspark.sql import Window as W

    on = pixels.filter(F.col("sample") >= least)
    w = W.partitionBy("image_id", "row_idx").orderBy("col_idx")
    runs = on.withColumn("g", F.col("col_idx") - F.row_number().over(w)).groupBy("image_id", "row_idx", "g").agg(F.min("col_idx").alias("x1"), F.max("col_idx").alias("x2"))
    runs = stored(runs.select("image_id", "row_idx", "x1", "x2", F.struct("image_id", "row_idx", "x1").alias("node")))
    a, b = runs.alias("a"), runs.alias("b")
    touch = a.join(b, F.expr("a.image_id = b.image_id and a.row_idx + 1 = b.row_idx and a.x1 <= b.x2 + 1 and b.x1 <= a.x2 + 1")).select(F.col("a.node").alias("a"), F.col("b.node").alias("b"))
    label = runs.join(components(touch), "node", "left").withColumn("label", F.coalesce("component", "node"))
    out = label.groupBy("image_id", "label").agg(F.min("x1").alias("x"), F.min("row_idx").alias("y"), (F.max("x2") - F.min("x1") + 1).alias("w"), (F.max("row_idx") - F.min("row_idx") + 1).alias("h"), F.sum(F.col("x2") - F.col("x1") + 1).alias("area"))
    out = out.withColumn("label", F.concat_ws("/", "label.image_id", "label.row_idx", "label.x1"))
    return out.withColumn("fill", F.round(F.col("area") / (F.col("w") * F.col("h")), 9)).withColumn("large", F.col("area") >= 256)
