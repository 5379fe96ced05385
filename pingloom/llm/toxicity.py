"""Toxicity: a factorization machine over hashed terms.

score = sigmoid(w0 + sum of w[i] + sum over pairs of <v[i], v[j]>) over the hashed terms present in a text; the
pair part is computed as half of (sum v)^2 - sum v^2. Pairs of terms get weights of their own, which additive
weights miss. Terms are runs of letters and digits (bytes from 0x80 count as letters), A-Z lower-cased, and
their first five bytes, so that inflected forms share a weight.

Which terms get weights: those whose chi-square with the label is large, and those of pairs whose chi-square is,
beyond what both terms say alone. Both choices and the fit see ``FIT_ROWS`` labelled rows at most; scores cover all.
Counts of terms on these rows are made by Spark; of the rows themselves only the chosen terms come to the driver.

Defined results: null and empty texts have no terms and get the score of the bias; a null doc_id counts as
the empty id; of several labels of an id the larger counts; repeated rows each keep their row; a very long text is
scored whole, slice by slice of terms (about 60 bytes of memory a byte); ties of chi-square go to the smaller bucket;
without labels of both classes every score is the share of label 1 (0 where there is none); an empty table gives an
empty result; ``score`` keeps other columns but replaces score, held_out and predicted.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kernels
from .common import stored

#: Labelled rows that the machine is fitted on at most (taken by hash of the id).
FIT_ROWS = 20_000
BUCKETS = 1 << 20
#: Buckets with the largest chi-square on the fitted rows that get weights; buckets that most rows of label 1 hold,
#: whose pairs are tested as well; and buckets added for the sake of their pairs at most.
TERMS, PAIRED, ADDED = 2048, 2048, 1024
FACTORS = 8
STEM = 5
_BETWEEN = np.ones(256, dtype=bool)
_BETWEEN[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = False


def _terms(column: pa.Array):
    """(number of rows, row of each term, bucket of each term), a slice of rows at a time."""
    for first, end, data, offs in kernels.slices(column):
        data = kernels.lowered(data)
        start, stop, at = kernels.words(data, offs, _BETWEEN)
        row = np.repeat(np.arange(end - first), np.diff(at))
        long = stop - start > STEM
        sums = kernels.Sums(kernels.byte_tokens(data))
        whole, stem = sums.ranges(start, stop), sums.ranges(start[long], start[long] + STEM) ^ np.uint64(0x5851F42D4C957F2D)
        yield end - first, np.concatenate([row, row[long]]), (np.concatenate([whole, stem]) % np.uint64(BUCKETS)).astype(np.int64)


def _present(batches):
    """Distinct buckets of each document, as lists."""
    for batch in batches:
        for n, row, bucket in _terms(batch.column("text")):
            both = np.unique(row * BUCKETS + bucket)
            offs = np.searchsorted(both, np.arange(n + 1) * BUCKETS)
            yield offs, (both % BUCKETS).astype(np.int32)


def _paired(seen: np.ndarray, hit: np.ndarray, n: int, paired: int = PAIRED) -> np.ndarray:
    """Buckets whose pairs are tested: those that most rows of label 1 hold, but not most rows."""
    some = np.argsort(-np.where((seen >= 4) & (seen <= n / 2), hit, 0.0), kind="stable")[:paired]
    return np.sort(some[hit[some] >= 4])


def _single(seen: np.ndarray, hit: np.ndarray, n: int, pos: int, terms: int = TERMS) -> np.ndarray:
    """Buckets of large chi-square."""
    expect = seen * pos / n
    chi = np.where(seen >= 4, (hit - expect) ** 2 / np.maximum(expect * (1 - pos / n) * (1 - seen / n + 1e-9), 1e-9), 0.0)
    ids = np.argsort(-chi, kind="stable")[:terms]
    return ids[chi[ids] > 6.0]


def _pair_terms(row: np.ndarray, buckets: np.ndarray, labels: np.ndarray, seen: np.ndarray, hit: np.ndarray, added: int = ADDED) -> np.ndarray:
    """Buckets of the pairs that tell the labels apart best, though each bucket alone may say nothing."""
    n, pos = len(labels), labels.sum()
    some = _paired(seen, hit, n)
    where = np.full(BUCKETS, -1, dtype=np.int32)
    where[some] = np.arange(len(some))
    both, toxic = np.zeros((len(some), len(some)), np.float32), np.zeros((len(some), len(some)), np.float32)
    at = where[buckets]
    row, at = row[at >= 0], at[at >= 0]
    begin = np.searchsorted(row, np.arange(0, n + 2048, 2048))
    for k in range(len(begin) - 1):  # 2,048 rows at a time
        x = np.zeros((2048, len(some)), np.float32)
        x[row[begin[k] : begin[k + 1]] - 2048 * k, at[begin[k] : begin[k + 1]]] = 1
        y = x[: n - 2048 * k][labels[2048 * k : 2048 * (k + 1)] > 0]
        both += x.T @ x
        toxic += y.T @ y
    expect = both * (pos / n)
    chi = np.where(both >= 8, (toxic - expect) ** 2 / np.maximum(expect * (1 - pos / n), 1e-9), 0)
    best = np.maximum(seen[some], 1) * (pos / n)
    alone = (hit[some] - best) ** 2 / np.maximum(best * (1 - pos / n), 1e-9)
    chi = np.where(chi > 2 * np.maximum(alone[:, None], alone[None, :]) + 20, chi, 0)  # more than both say alone
    np.fill_diagonal(chi, 0)
    worth = chi.max(axis=1, initial=0)
    order = np.argsort(-worth, kind="stable")[:added]
    return some[order[worth[order] > 0]]


def fit_machine(offs: np.ndarray, buckets: np.ndarray, labels: np.ndarray, terms: int = TERMS, factors: int = FACTORS, epochs: int = 40, seed: int = 7, counts: tuple[np.ndarray, np.ndarray] | None = None) -> dict:
    """Weights from documents given as distinct buckets (``buckets[offs[i]:offs[i + 1]]``) and labels 0 or 1.

    ``counts``: rows and rows of label 1 that hold each bucket. With them the documents need list only the buckets of
    ``_single`` and ``_paired``.
    """
    n, pos = len(labels), int(labels.sum())
    if not n or pos in (0, n):
        p = pos / n if n else 0.0
        return {"w0": float(np.log((p + 1e-9) / (1 - p + 1e-9))), "ids": np.zeros(0, np.int64), "w": np.zeros(0), "v": np.zeros((0, factors))}
    row = np.repeat(np.arange(n, dtype=np.int32), np.diff(offs))
    seen, hit = counts or (np.bincount(buckets, minlength=BUCKETS).astype(float), np.bincount(buckets, weights=labels[row], minlength=BUCKETS))
    ids = np.union1d(_single(seen, hit, n, pos, terms), _pair_terms(row, buckets, labels, seen, hit))
    where = np.full(BUCKETS, -1, dtype=np.int64)
    where[ids] = np.arange(len(ids))
    at = where[buckets]
    row, at = row[at >= 0], at[at >= 0]
    begin = np.searchsorted(row, np.arange(n + 1))
    rng = np.random.default_rng(seed)
    w0, w = float(np.log(pos / (n - pos))), np.zeros(len(ids))
    v = rng.normal(0, 0.02, (len(ids), factors))
    g0, gw, gv = 1e-2, np.full(len(ids), 1e-2), np.full(v.shape, 1e-2)
    for _ in range(epochs):
        order = rng.permutation(n)
        for part in np.array_split(order, max(1, n // 128)):
            counts = begin[part + 1] - begin[part]
            local = np.repeat(np.arange(len(part)), counts)
            pick = at[np.repeat(begin[part] - np.concatenate([[0], np.cumsum(counts)[:-1]]), counts) + np.arange(counts.sum())]
            total = np.zeros((len(part), factors))
            square = np.zeros(len(part))
            np.add.at(total, local, v[pick])
            np.add.at(square, local, (v[pick] ** 2).sum(1))
            z = w0 + np.bincount(local, weights=w[pick], minlength=len(part)) + 0.5 * ((total**2).sum(1) - square)
            err = 1 / (1 + np.exp(-np.clip(z, -30, 30))) - labels[part]
            d0 = err.mean()
            g0 += d0 * d0
            w0 -= 0.2 * d0 / np.sqrt(g0)
            dw = np.bincount(pick, weights=err[local], minlength=len(ids)) / len(part) + 1e-6 * w
            gw += dw * dw
            w -= 0.4 * dw / np.sqrt(gw)
            dv = np.zeros_like(v)
            np.add.at(dv, pick, err[local, None] * (total[local] - v[pick]))
            dv = dv / len(part) + 1e-5 * v
            gv += dv * dv
            v -= 0.05 * dv / np.sqrt(gv)
    return {"w0": w0, "ids": ids, "w": w, "v": v}


def _scores(model: dict, column: pa.Array) -> np.ndarray:
    where = np.full(BUCKETS, -1, dtype=np.int32)
    where[model["ids"]] = np.arange(len(model["ids"]))
    out = [np.zeros(0)]
    for n, row, bucket in _terms(column):
        at = where[bucket]
        row, at = row[at >= 0], at[at >= 0]
        both = np.unique(row * (len(model["w"]) + 1) + at)
        row, at = both // (len(model["w"]) + 1), both % (len(model["w"]) + 1)
        z = model["w0"] + np.bincount(row, weights=model["w"][at], minlength=n)
        for f in range(model["v"].shape[1]):
            x = model["v"][at, f]
            z += 0.5 * (np.bincount(row, weights=x, minlength=n) ** 2 - np.bincount(row, weights=x * x, minlength=n))
        out.append(1 / (1 + np.exp(-np.clip(z, -30, 30))))
    return np.concatenate(out)


def held_out_id(remainder: int, modulus: int):
    return (F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))) % modulus) == remainder


def learn(docs: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS) -> dict:
    """Fit on labelled rows outside the held-out quarter, ``fit_rows`` at most by hash of the id."""
    labels = labels.filter("doc_id is not null and toxic in (0, 1)").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("toxic").alias("toxic"))
    some = labels.filter(~held_out_id(2, 4)).orderBy(F.xxhash64("doc_id"), "doc_id").limit(fit_rows)
    some = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(some), "doc_id")  # at most fit_rows rows

    def run(batches):
        for b in batches:
            at = 0
            for offs, ids in _present([b]):
                n = len(offs) - 1
                part = b.slice(at, n)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("toxic").cast(pa.int32()), pa.ListArray.from_arrays(pa.array(offs, pa.int32()), pa.array(ids))], ["doc_id", "toxic", "ids"])
                at += n

    rows = stored(some.select("doc_id", "text", "toxic").mapInArrow(run, "doc_id long, toxic int, ids array<int>").withColumn("k", F.struct(F.xxhash64("doc_id").alias("a"), F.col("doc_id").alias("b"), F.xxhash64("ids").alias("c"))))
    # an id may stand in many rows of documents: the rows are limited too, by their keys
    if rows.count() > fit_rows:
        last = rows.select("k").orderBy("k").limit(fit_rows).agg(F.max("k").alias("k"))
        rows = stored(rows.join(F.broadcast(last.withColumnRenamed("k", "most")), F.col("k") <= F.col("most")).drop("most"))
    # counts of buckets are summed in tasks; the driver sees them, and of the rows the buckets that may get weights only
    each = rows.select("toxic", F.explode("ids").alias("bucket")).groupBy("bucket").agg(F.count(F.lit(1)).alias("seen"), F.sum("toxic").alias("hit")).filter("seen >= 4").toArrow()
    seen, hit = np.zeros(BUCKETS), np.zeros(BUCKETS)
    if each.num_rows:
        bucket = np.asarray(each["bucket"].combine_chunks())
        seen[bucket], hit[bucket] = np.asarray(each["seen"].combine_chunks()), np.asarray(each["hit"].combine_chunks())
    total = rows.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("toxic"), F.lit(0)).alias("pos")).first()
    wanted = np.union1d(_single(seen, hit, total.n, total.pos), _paired(seen, hit, total.n)) if 0 < total.pos < total.n else np.zeros(0, np.int64)
    sent = docs.sparkSession.sparkContext.broadcast(wanted)

    def chosen(batches):
        keep = np.zeros(BUCKETS, bool)
        keep[sent.value] = True
        for b in batches:
            lists = b.column("ids")
            ids, size = np.asarray(lists.flatten()), np.asarray(lists.value_lengths()).astype(np.int64)
            hold = keep[ids]
            upto = np.concatenate([[0], np.cumsum(hold)])[np.concatenate([[0], np.cumsum(size)])]
            yield pa.RecordBatch.from_arrays([b.column("k"), b.column("toxic"), pa.ListArray.from_arrays(pa.array(upto, pa.int32()), pa.array(ids[hold], pa.int32()))], ["k", "toxic", "ids"])

    got = rows.select("k", "toxic", "ids").mapInArrow(chosen, f"k {rows.schema['k'].dataType.simpleString()}, toxic int, ids array<int>").orderBy("k").select("toxic", "ids").toArrow().combine_chunks()
    sent.unpersist()
    lists = got["ids"].combine_chunks() if got.num_rows else pa.array([], pa.list_(pa.int32()))
    lens = np.asarray(lists.value_lengths()).astype(np.int64) if got.num_rows else np.zeros(0, np.int64)
    return fit_machine(np.concatenate([[0], np.cumsum(lens)]), np.asarray(lists.flatten()), np.asarray(got["toxic"]).astype(float), counts=(seen, hit))


def score(docs: DataFrame, model: dict, threshold: float = 0.3) -> DataFrame:
    """All columns of ``docs`` (those of the same names are replaced) with score, held_out and predicted."""
    docs = docs.drop("score", "held_out", "predicted")
    names = docs.columns
    schema = docs.schema

    def run(batches):
        for b in batches:
            text = b.column(names.index("text"))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(_scores(model, text))], names=[*names, "score"])

    out = docs.mapInArrow(run, type(schema)([*schema.fields]).add("score", "double"))
    return out.withColumn("held_out", held_out_id(2, 4)).withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def toxicity(docs: DataFrame, labels: DataFrame, threshold: float = 0.3) -> DataFrame:
    """One row for each document: doc_id, held_out, score, predicted."""
    model = learn(docs, labels)
    return score(docs.select("doc_id", "text"), model, threshold).select("doc_id", "held_out", "score", "predicted")
