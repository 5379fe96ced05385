"""Aggregations over survey tables."""

from __future__ import annotations

import math
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.storage import stored
from .ordered import laid_out, numbered, with_previous, with_running


def exact_quantiles(df: DataFrame, keys: list[str], value: str, points: dict[str, float], most: int = 10_000, bins: int = 1024) -> DataFrame:
    """``keys``, ``n``, ``low``, ``high`` and a column for each of ``points`` (name: share): quantiles by linear interpolation; nulls are left out.

    Ranks are found by narrowing: a histogram of ``bins`` ranges between the least and the greatest value names the
    range that holds a wanted rank, which is divided again until it holds ``most`` values or a single one. Only these
    are put in order. Counts are combined in tasks before they are shuffled, so no group holds a key's values.
    """
    rows = df.select(*keys, F.col(value).cast("double").alias("_x")).filter("_x is not null")
    x, lo, hi = F.col("_x"), F.col("_lo"), F.col("_hi")
    total = stored(rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.min(x).alias("low"), F.max(x).alias("high")))
    place = lambda p: F.lit(p) * (F.col("n") - 1)
    ranks = F.array_distinct(F.concat(*[F.array(F.floor(place(p)), F.ceil(place(p))) for p in points.values()]))
    wanted = stored(total.select(*keys, F.explode(ranks).alias("_rank"), F.lit(0).cast("long").alias("_before"), F.col("n").alias("_n"), F.col("low").alias("_lo"), F.col("high").alias("_hi")))
    done = wanted.limit(0)
    same = [*keys, "_lo", "_hi"]

    def within(ranges: DataFrame) -> DataFrame:
        """Rows with the range that holds them; the ranges of a key are as many as its points."""
        found = rows.alias("r").join(ranges.alias("w"), _equal("r", "w", keys)) if keys else rows.crossJoin(F.broadcast(ranges))
        return found.filter((x >= lo) & (x <= hi)).select(*[F.col(f"w.{k}" if keys else k) for k in keys], "_lo", "_hi", "_x")

    while True:
        open_ = (hi > lo) & (F.col("_n") > most)
        done, wanted = done.unionByName(wanted.filter(~open_)), stored(wanted.filter(open_))
        if wanted.isEmpty():
            break
        cell = F.least(F.lit(bins - 1), F.floor((x - lo) / (hi - lo) * bins))
        cells = within(wanted.select(*same).distinct()).groupBy(*same, cell.alias("_cell")).agg(F.count(F.lit(1)).alias("_m"), F.min(x).alias("_l"), F.max(x).alias("_h"))
        upto = F.sum("_m").over(W.partitionBy(*same).orderBy("_cell")) - F.col("_m")  # as many rows as bins
        cells = cells.withColumn("_skip", upto)
        met = wanted.alias("a").join(cells.alias("b"), _equal("a", "b", same)).filter("_rank >= _before + _skip and _rank < _before + _skip + _m")
        wanted = stored(met.select(*[F.col(f"a.{k}") for k in keys], "_rank", (F.col("_before") + F.col("_skip")).alias("_before"), F.col("_m").alias("_n"), F.col("_l").alias("_lo"), F.col("_h").alias("_hi")))
    one = done.filter(hi == lo).select(*keys, "_rank", lo.alias("_v"))
    few = done.filter(hi > lo)
    place_in = F.row_number().over(W.partitionBy(*same).orderBy("_x")) - 1  # ``most`` rows at most
    sorted_ = within(few.select(*same).distinct()).withColumn("_place", place_in)
    some = few.alias("a").join(sorted_.alias("b"), _equal("a", "b", same)).filter("_rank = _before + _place").select(*[F.col(f"a.{k}") for k in keys], "_rank", F.col("_x").alias("_v"))
    values = one.unionByName(some).groupBy(*keys).agg(F.map_from_entries(F.collect_list(F.struct("_rank", "_v"))).alias("_at"))  # two for each point
    out = total.alias("t").join(values.alias("v"), _equal("t", "v", keys)) if keys else total.crossJoin(values)
    at = lambda f, p: F.element_at("_at", f(place(p)))
    between = {name: at(F.floor, p) + (at(F.ceil, p) - at(F.floor, p)) * (place(p) - F.floor(place(p))) for name, p in points.items()}
    return out.select(*[F.col(f"t.{k}" if keys else k) for k in keys], "n", "low", "high", *[c.alias(name) for name, c in between.items()])


def _equal(a: str, b: str, keys: list[str]) -> Column:
    out = F.lit(True)
    for k in keys:
        out = out & F.col(f"{a}.{k}").eqNullSafe(F.col(f"{b}.{k}"))
    return out


def quantile_summary(df: DataFrame, key: str | None, value: str) -> DataFrame:
    """Minimum, quantiles by linear interpolation and maximum; nulls without values."""
    points = {"p10": 0.1, "p25": 0.25, "median": 0.5, "p75": 0.75, "p90": 0.9}
    keys = [key] if key else []
    found = exact_quantiles(df, keys, value, points)
    every = df.select(*keys).distinct() if key else df.sparkSession.range(1).select()
    out = every.alias("e").join(found.alias("f"), _equal("e", "f", keys), "left")
    return out.select(*[F.col(f"e.{k}") for k in keys], F.col("low").alias("min"), *[F.round(n, 9).alias(n) for n in points], F.col("high").alias("max"))


def average_precision(df: DataFrame, score: str, label: str, key: str) -> DataFrame:
    """Area under precision-recall by score (ties by id): the sum over positives of precision, over their number; null without positives.

    Ranks and hits are running sums of an ordered scan, so any number of equal scores is spread over the tasks.
    """
    rows = laid_out(df.select(score, label, key), [], [F.col(score).desc(), key])
    rows = with_running(rows, [], sums={"rank": F.lit(1), "hits": F.col(label)})
    return rows.agg((F.sum(F.when(F.col(label) == 1, F.col("hits") / F.col("rank"))) / F.sum(label)).alias("average_precision"), F.count("*").alias("n"), F.sum(label).alias("positives"))


def cluster_bootstrap(units: DataFrame, b: int, seed: int, alpha: float = 0.05) -> DataFrame:
    """Percentile interval of sum(num) / sum(den), groups drawn with replacement ``b`` times.

    Draw ``slot`` of replicate ``r`` is md5(seed:r:slot) modulo the number of groups. Draws without a denominator
    count as undefined and take no part.
    """
    g = stored(units.groupBy("grp").agg(F.sum("num").alias("num"), F.sum("den").alias("den")))
    keys = numbered(g, ["grp"], "i").withColumn("i", F.col("i") - 1)
    size = g.count()
    slots = units.sparkSession.range(b * size).select(F.expr(f"id div {max(1, size)}").alias("r"), F.expr(f"id % {max(1, size)}").alias("slot"))
    draw = F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("r").cast("string"), F.col("slot").cast("string")).cast("binary")), 1, 8), 16, 10).cast("bigint") % size
    reps = slots.withColumn("i", draw).join(keys, "i").groupBy("r").agg(F.sum("num").alias("num"), F.sum("den").alias("den"))
    rates = reps.withColumn("rate", F.expr("try_divide(num, den)"))
    rates = stored(rates)
    ranked = numbered(rates.filter("rate is not null"), ["rate", "r"], "k").withColumn("k", F.col("k") - 1)
    count = rates.agg(F.count("rate").alias("draws"), F.count_if(F.col("rate").isNull()).alias("undefined_draws"))
    low, high = F.floor(alpha / 2 * (F.col("draws") - 1)), F.ceil((1 - alpha / 2) * (F.col("draws") - 1))
    ci = ranked.crossJoin(F.broadcast(count)).groupBy("draws", "undefined_draws").agg(F.max(F.when(F.col("k") == low, F.col("rate"))).alias("ci_low"), F.max(F.when(F.col("k") == high, F.col("rate"))).alias("ci_high"))
    total = g.agg(F.expr("try_divide(sum(num), sum(den))").alias("point"), F.count("*").alias("n_groups"))
    return total.crossJoin(ci)


#: ln k! - ln(sqrt(2 pi k) (k / e)^k) for small k; above, its series is exact to a double's digits.
_STIRLING = [0.0, *[math.lgamma(k + 1) - (k + 0.5) * math.log(k) + k - 0.5 * math.log(2 * math.pi) for k in range(1, 17)]]


def _stirling_rest(k: Column) -> Column:
    k2 = k * k
    series = (1 / 12 - (1 / 360 - (1 / 1260 - (1 / 1680 - 1 / 1188 / k2) / k2) / k2) / k2) / k
    return F.when(k <= 16, F.element_at(F.array(*map(F.lit, _STIRLING)), k.cast("int") + 1)).otherwise(series)


def _let(value: Column, body) -> Column:
    """``body`` of a value that is computed once, however often the body names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def incomplete_beta(a: Column, b: Column, x: Column, steps: Column) -> Column:
    """I_x(a, b) for whole a, b >= 1 and 0 < x < 1: a continued fraction of ``steps`` terms on the side where it converges.

    Its factor is a binomial probability in saddle-point form, which does not cancel for large counts.
    """

    def side(a: Column, b: Column, x: Column) -> Column:
        n = a + b
        apart = lambda k, at: k * F.log(k / at) + at - k
        log_p = _stirling_rest(n) - _stirling_rest(a) - _stirling_rest(b) - apart(a, n * x) - apart(b, n * (1 - x))
        front = F.exp(log_p) * F.sqrt(n / (2 * math.pi * a * b)) * b / n
        tiny = lambda v: F.when(F.abs(v) < 1e-300, F.lit(1e-300)).otherwise(v)

        def term(s: Column, m: Column) -> Column:
            m = m.cast("double")
            even = m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m))
            odd = -(a + m) * (n + m) * x / ((a + 2 * m) * (a + 2 * m + 1))
            half = lambda d, c, h, f: (1 / tiny(1 + f * d), tiny(1 + f / c), h)

            def second(t: Column) -> Column:
                d, c, h = half(t["d"], t["c"], t["h"], odd)
                return _let(F.struct(d.alias("d"), c.alias("c"), h.alias("h")), lambda u: F.struct(u["d"], u["c"], (u["h"] * u["d"] * u["c"]).alias("h")))

            d, c, h = half(s["d"], s["c"], s["h"], even)
            return _let(_let(F.struct(d.alias("d"), c.alias("c"), h.alias("h")), lambda u: F.struct(u["d"], u["c"], (u["h"] * u["d"] * u["c"]).alias("h"))), second)

        d0 = 1 / tiny(1 - n * x / (a + 1))
        start = F.struct(d0.alias("d"), F.lit(1.0).alias("c"), d0.alias("h"))
        return front * F.aggregate(F.sequence(F.lit(1), steps), start, term, lambda s: s["h"])

    low = x < (a + 1) / (a + b + 2)
    return F.when(low, side(a, b, x)).otherwise(1 - side(b, a, 1 - x))


def clopper_pearson(df: DataFrame, k: str, n: str, alpha: float = 0.05, steps: int = 50) -> DataFrame:
    """Exact binomial interval of each row: the two tails are inverted by bisection; nulls for n = 0.

    A tail is an incomplete beta function, whose continued fraction needs about sqrt(n) terms, so a row costs
    ``steps`` times that, in column expressions.
    """
    some, count = F.col(n) > 0, F.col(k).cast("double")
    rest = F.col(n).cast("double") - count
    terms = (F.lit(40) + F.ceil(4 * F.sqrt(F.col(n).cast("double")))).cast("int")

    def bisect(a: Column, b: Column, tail: float) -> Column:
        """x with I_x(a, b) = tail."""
        start = F.struct(F.lit(0.0).alias("lo"), F.lit(1.0).alias("hi"))

        def step(s: Column, _: Column) -> Column:
            middle = (s["lo"] + s["hi"]) / 2
            up = _let(middle, lambda x: F.struct(x.alias("x"), (incomplete_beta(a, b, x, terms) < tail).alias("up")))
            return _let(up, lambda u: F.struct(F.when(u["up"], u["x"]).otherwise(s["lo"]).alias("lo"), F.when(u["up"], s["hi"]).otherwise(u["x"]).alias("hi")))

        return F.aggregate(F.sequence(F.lit(1), F.lit(steps)), start, step, lambda s: (s["lo"] + s["hi"]) / 2)

    low = F.when(count == 0, F.lit(0.0)).otherwise(bisect(count, rest + 1, alpha / 2))
    high = F.when(rest == 0, F.lit(1.0)).otherwise(bisect(count + 1, rest, 1 - alpha / 2))
    return df.withColumn("cp_low", F.when(some, low)).withColumn("cp_high", F.when(some, high))


def _pooled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Blocks (chunk, lo, hi, s, n) in order: neighbours of a chunk whose means fall are pooled."""
    chunk, stack = None, []
    for b in batches:
        for c, lo, hi, s, n in zip(*(b.column(i).to_pylist() for i in range(5)), strict=True):
            if c != chunk and stack:
                yield pa.RecordBatch.from_arrays([pa.array(v) for v in zip(*stack, strict=True)], names=["lo", "hi", "s", "n"])
                stack = []
            chunk = c
            while stack and stack[-1][2] * n >= s * stack[-1][3]:
                lo, s, n = stack[-1][0], s + stack[-1][2], n + stack[-1][3]
                stack.pop()
            stack.append((lo, hi, s, n))
    if stack:
        yield pa.RecordBatch.from_arrays([pa.array(v) for v in zip(*stack, strict=True)], names=["lo", "hi", "s", "n"])


def isotonic_blocks(df: DataFrame, score: str, label: str, chunk: int = 50_000) -> DataFrame:
    """Isotonic regression of whole-numbered labels: ``lo, hi, fitted`` of each block of scores, rising.

    Adjacent violators can be pooled in any order. Blocks are numbered and pooled inside chunks of ``chunk``
    neighbours, whose borders shift by half a chunk from round to round, until no two neighbours violate.
    """
    g = df.filter(F.col(score).isNotNull()).groupBy(F.col(score).cast("double").alias("lo")).agg(F.sum(label).cast("long").alias("s"), F.count(F.lit(1)).alias("n"))
    blocks, shift = stored(g.select("lo", F.col("lo").alias("hi"), "s", "n")), 0
    while True:
        rows = numbered(blocks, ["lo"]).select(F.expr(f"(number + {shift}) div {chunk}").alias("chunk"), "lo", "hi", "s", "n")
        rows = rows.repartitionByRange("chunk").sortWithinPartitions("chunk", "lo")
        blocks = stored(rows.mapInArrow(_pooled, "lo double, hi double, s long, n long"))
        before = with_previous(laid_out(blocks, [], ["lo"]), [], ["s", "n"])
        if before.filter("prev_s * n >= s * prev_n").isEmpty():
            return blocks.select("lo", "hi", (F.col("s") / F.col("n")).alias("fitted"))
        shift = chunk // 2 - shift


def isotonic_lookup(scores: DataFrame, blocks: DataFrame, score: str) -> DataFrame:
    """``scores`` with ``fitted``: the value of the first block whose upper end is at or above the score, else of the last block.

    An as-of join: blocks and scores are scanned together from the top, each score takes the block seen last.
    """
    down = blocks.select(F.col("hi").alias("_y"), F.lit(0).alias("_kind"), F.struct((-F.col("hi")).alias("k"), "fitted").alias("_block"))
    none = F.lit(None).cast(down.schema["_block"].dataType)
    both = down.withColumn("_row", F.lit(None).cast(scores.select(F.struct("*")).schema[0].dataType))
    both = both.unionByName(scores.select(F.col(score).cast("double").alias("_y"), F.lit(1).alias("_kind"), none.alias("_block"), F.struct("*").alias("_row")))
    rows = with_running(laid_out(both, [], [F.col("_y").desc_nulls_last(), "_kind"]), [], highs={"_met": F.col("_block")}).filter("_kind = 1")
    top = blocks.agg(F.max_by("fitted", "hi").alias("_top"))
    out = rows.crossJoin(F.broadcast(top))  # one row
    return out.select("_row.*", F.when(F.col("_y").isNotNull(), F.coalesce("_met.fitted", "_top")).alias("fitted"))
