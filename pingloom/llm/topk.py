"""Exact top-k by inner product: an impact-ordered index, read score-at-a-time until a proof.

Vectors become integers floor(256 * x). The index is built once and stored: a row for each tile of vectors of like
norm, which holds the vectors and, for each dimension, its postings (places of vectors) in segments of descending
quantised impact |x|. For a query the segments of all dimensions are ordered by the impact that they can have on
its score, |query component| * upper end of the level, and are added in that order. What the unseen postings of a
vector can still add is bounded twice: by the sum of the impacts that its quantised components leave, and by
Cauchy-Schwarz over the unseen parts of both vectors. The best so far are rescored now and then, which gives a proven
lower bound of the k-th score. Scoring stops once the proof leaves few possible members; those alone are rescored.

Queries visit tiles in two rounds: one tile each, which gives a lower bound of their k-th score; then the tiles
whose largest norm times the query's own norm reaches that bound. Blocks of queries meet tiles by an equi-join; the
index is neither copied for blocks nor sent to all tasks.

Defined results: vectors that are null or hold null, NaN or infinite components, and rows without an id, take
no part; rows that share an id are one vector (the smallest); missing components of shorter vectors count as
0; ties go to the smaller id; an empty table gives an empty result; other columns, whatever their names, are left out.
Components beyond 2^31 / 256 in size are outside the range of the index and fail.
"""

from __future__ import annotations

import io
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import stored

#: Vectors in a tile, queries in a block, levels of impact.
TILE = 8192
BLOCK = 256
LEVELS = 16
#: A query stops in a tile once one in so many of its vectors is possible; postings are checked after each such share.
POSSIBLE, STEPS = 12, 20
#: Times k vectors of the best scores so far that are rescored at each check, for a proven bound of the k-th score.
PROBES = 2


def _dump(**arrays: np.ndarray) -> bytes:
    out = io.BytesIO()
    np.savez(out, **arrays)
    return out.getvalue()


def _load(raw: bytes) -> dict[str, np.ndarray]:
    with np.load(io.BytesIO(raw)) as f:
        return {k: f[k] for k in f.files}


def _matrix(lists: pa.Array) -> np.ndarray:
    """Rows of integers, shorter ones filled up with 0."""
    size = np.asarray(lists.value_lengths()).astype(np.int64)
    out = np.zeros((len(size), int(size.max(initial=0))), dtype=np.int64)
    row = np.repeat(np.arange(len(size)), size)
    out[row, np.arange(len(row)) - np.repeat(np.cumsum(size) - size, size)] = np.asarray(lists.flatten())
    return out


def build_tile(ids: np.ndarray, x: np.ndarray, levels: int = LEVELS) -> dict[str, np.ndarray]:
    """The index of some vectors: their ids and values, and the postings of each (dimension, level), highest level first."""
    n, width = x.shape
    size = np.abs(x)
    upper = np.unique(np.quantile(size, np.linspace(0, 1, levels + 1)[1:], method="higher")).astype(np.int64) if size.size else np.zeros(1, np.int64)
    level = np.searchsorted(upper, size)
    # posting lists: dimension by dimension, then levels from the top
    key = np.arange(width)[None, :] * len(upper) + (len(upper) - 1 - level)
    order = np.argsort(key.ravel(), kind="stable")
    cut = np.searchsorted(key.ravel()[order], np.arange(width * len(upper) + 1))
    return {"ids": ids, "x": x.astype(np.int32), "ends": upper[level].astype(np.float32), "upper": upper[::-1].copy(), "posting": (order // max(1, width)).astype(np.uint16 if n <= 1 << 16 else np.int64), "cut": cut}


def read_tile(tile: dict[str, np.ndarray], q_ids: np.ndarray, q: np.ndarray, known: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """(query id, id, score) of the k best of each query in a tile, its own id and scores below ``known`` left out, and postings read."""
    ids, x, upper, posting, cut = tile["ids"], tile["x"].astype(np.int64), tile["upper"], tile["posting"].astype(np.int64), tile["cut"]
    width, levels = max(q.shape[1], x.shape[1]), len(upper)
    q = np.pad(q, ((0, 0), (0, width - q.shape[1])))
    x = np.pad(x, ((0, 0), (0, width - x.shape[1])))
    dims = (len(cut) - 1) // levels
    value = x[posting, np.repeat(np.arange(dims), np.diff(cut[::levels]))].astype(float) if dims else np.zeros(0)
    square, n = value * value, len(ids)
    energy = (x.astype(float) ** 2).sum(1)
    most = np.abs(q[:, :dims]).astype(float) @ tile["ends"].T.astype(float)  # what each vector's quantised impacts can give
    out, read = [], 0
    for i in range(len(q)):
        qi = q[i]
        impact = (np.abs(qi[:dims])[:, None] * upper[None, :]).ravel()
        order = np.argsort(-impact, kind="stable")
        order = order[impact[order] > 0]
        size = cut[order + 1] - cut[order]
        ends = np.cumsum(size)
        own = ids == q_ids[i]
        # the score so far, and what is left of the vectors' and of the query's squares
        score, left, asked, rest = np.zeros(n), energy.copy(), np.full(n, float((qi.astype(float) ** 2).sum())), most[i].copy()
        slack = 1e-9 * energy * asked + 1e-6
        least, possible, at = float(known[i]), ~own, 0
        probed, top = np.zeros(n, bool), np.zeros(0, np.int64)
        for step in range(1, STEPS + 1):
            end = int(np.searchsorted(ends, ends[-1] * step / STEPS)) + 1 if len(ends) else 0
            part = order[at:end]
            if len(part):
                spot = np.concatenate([posting[cut[s] : cut[s + 1]] for s in part.tolist()])
                d = np.repeat(qi[part // levels].astype(float), size[at:end])
                score += np.bincount(spot, weights=np.concatenate([value[cut[s] : cut[s + 1]] for s in part.tolist()]) * d, minlength=n)
                left -= np.bincount(spot, weights=np.concatenate([square[cut[s] : cut[s + 1]] for s in part.tolist()]), minlength=n)
                asked -= np.bincount(spot, weights=d * d, minlength=n)
                rest -= np.bincount(spot, weights=np.repeat(impact[part].astype(float), size[at:end]), minlength=n)
            at = end
            if at >= len(order):
                possible = ~own
                break
            if 4 * step < STEPS:
                continue
            bound = np.minimum(np.sqrt(np.maximum(left, 0) * np.maximum(asked, 0) + slack), rest + 1e-6 * most[i] + 1e-6)
            if n > PROBES * k:
                best = np.argpartition(-np.where(own | probed, -np.inf, score), PROBES * k)[: PROBES * k]
                best = best[~(own | probed)[best]]  # each vector counts once
                probed[best] = True
                top = np.sort(np.concatenate([top, x[best] @ qi]))[-k:]
                read += len(best) * dims
                if len(top) == k:
                    least = max(least, float(top[0]))
            possible = ~own & (score + bound >= least)
            if possible.sum() * POSSIBLE <= n:
                break
        read += int(ends[at - 1]) if at else 0
        where = np.flatnonzero(possible)
        if at < len(order):
            read += len(where) * dims
        exact = x[where] @ qi
        where, exact = where[exact >= least], exact[exact >= least]
        top = np.lexsort((ids[where], -exact))[:k]
        out.append((np.full(len(top), q_ids[i], np.int64), ids[where[top]], exact[top]))
    found = [np.concatenate(c).astype(np.int64) for c in zip(*out, strict=True)] if out else [np.zeros(0, np.int64)] * 3
    return (*found, read)


def build_index(vectors: DataFrame, tile: int = TILE) -> DataFrame:
    """``tile, n, norm, index``: vectors (id, x) in the order of their norms, in tiles of at most ``tile``."""
    total = vectors.count()
    # neighbours by norm share a tile; equal norms are spread by id
    order = vectors.withColumn("norm2", F.aggregate("x", F.lit(0.0), lambda z, v: z + v.cast("double") * v)).repartitionByRange(max(1, -(-total // tile)), "norm2", "id").sortWithinPartitions("norm2", "id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0

        def out(rows: pa.Table) -> pa.RecordBatch:
            rows = rows.combine_chunks()
            ids, x = np.asarray(rows["id"]), _matrix(rows["x"].combine_chunks())
            norm = float(np.sqrt((x.astype(float) ** 2).sum(1).max(initial=0)))
            if np.abs(x).max(initial=0) >= 1 << 31:
                raise ValueError("a component is outside the range of the index")
            return pa.RecordBatch.from_arrays([pa.array([int(ids[0])]), pa.array([len(ids)], pa.int64()), pa.array([norm]), pa.array([_dump(**build_tile(ids, x))], pa.binary())], names=["tile", "n", "norm", "index"])

        for b in batches:
            held.append(b.select(["id", "x"]))
            n += b.num_rows
            while n >= tile:
                rows = pa.Table.from_batches(held)
                yield out(rows.slice(0, tile))
                held, n = rows.slice(tile).to_batches(), n - tile
        if n:
            yield out(pa.Table.from_batches(held))

    return stored(order.mapInArrow(run, "tile long, n long, norm double, index binary"))


def _visit(pairs: DataFrame, k: int) -> DataFrame:
    """``query_id, vec_id, score`` from rows (index, asked): a tile and a block of queries with what is known of each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for index, asked in zip(b.column("index"), b.column("asked"), strict=True):
                rows = asked.values
                got = read_tile(_load(index.as_py()), np.asarray(rows.field("id")), _matrix(rows.field("x")), np.asarray(rows.field("known")), k)
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in got[:3]], names=["query_id", "vec_id", "score"])

    return pairs.select("index", "asked").mapInArrow(run, "query_id long, vec_id long, score long")


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 5, tile: int = TILE, query_tile: int = BLOCK, key: str = "vec_id", column: str = "embedding") -> DataFrame:
    """The k largest inner products of each query against all ``vectors`` but its own id: query_id, rank, vec_id, score."""

    def whole(df: DataFrame) -> DataFrame:
        x = df.select(F.col(key).cast("long").alias("id"), F.col(column).cast("array<double>").alias("x")).filter("id is not null and x is not null and not exists(x, v -> v is null or isnan(v) or abs(v) = double('infinity'))")
        return x.select("id", F.transform("x", lambda v: F.floor(v * 256)).alias("x")).groupBy("id").agg(F.min("x").alias("x"))

    index = build_index(whole(vectors), tile)
    asked = stored(whole(queries).withColumn("norm", F.sqrt(F.aggregate("x", F.lit(0.0), lambda z, v: z + v.cast("double") * v))))
    tiles = index.select("tile", "norm", F.row_number().over(W.orderBy("tile")).alias("place"))  # a row for each tile
    n, blocks = index.count(), max(1, -(-asked.count() // query_tile))
    first = F.pmod(F.xxhash64("id"), F.lit(max(1, n))) + 1

    def met(rows: DataFrame) -> DataFrame:
        """Queries (id, x, known, tile) in blocks, beside their tiles."""
        share = F.pmod(F.xxhash64("id", F.lit(1)), F.lit(blocks))
        packed = rows.withColumn("block", share).groupBy("tile", "block").agg(F.collect_list(F.struct("id", "x", "known")).alias("asked"))
        return packed.join(index.select("tile", "index"), "tile")

    begin = asked.select("id", "x", F.lit(float("-inf")).alias("known"), first.alias("place")).join(tiles.select("place", "tile"), "place").drop("place")
    near = stored(_visit(met(begin), k))
    best = W.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    known = near.withColumn("r", F.row_number().over(best)).filter(F.col("r") == k).select(F.col("query_id").alias("id"), F.col("score").cast("double").alias("least"))
    left = asked.join(known, "id", "left").select("id", "x", "norm", F.coalesce("least", F.lit(float("-inf"))).alias("known"), first.alias("first"))
    bound = F.col("t.norm") * F.col("q.norm") * (1 + 1e-9) + 1
    # each query against the tiles that its bound does not rule out: tiles by place, so an equi-join on it
    left = left.withColumn("place", F.explode(F.sequence(F.lit(1), F.lit(max(1, n))))).alias("q").join(tiles.alias("t"), "place").filter((F.col("place") != F.col("q.first")) & (bound >= F.col("q.known")))
    rest = _visit(met(left.select("q.id", "q.x", "q.known", "t.tile")), k)
    found = near.unionByName(rest)
    return found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
