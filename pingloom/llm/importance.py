"""Target-distribution importance resampling with a head-tail vocabulary.

Features are runs of one to three consecutive words; each falls into the bucket of its CRC-32. How much more often the
target texts hit a bucket than the corpus gives the bucket's gain, and a document's weight is the sum over its
features. Documents are drawn without replacement by weight plus Gumbel noise from a hash of the id.

The CRC of a feature continues the CRC state of what stands before, so states can be kept. The head of the
vocabulary (the most frequent words, and pairs of them) is found by counting, and sent to all tasks: each word with its
exact CRC state, each pair with its state and its bucket. Words of the tail get their CRC directly from their bytes,
and pairs and triples beyond the head continue the states (by one linear map for a word's length).
Head and tail give the same exact CRC; which words are in the head decides only how fast. The buckets of each document
are computed once and stored (two bytes a feature); bucket totals are exact counts over all of them, summed in tasks
before they are shuffled, and the weights read the stored buckets.

Defined results: null, empty and wordless texts have no features, weight 0, and are never drawn as long as
``least_words`` is above 0; a null id hashes as an empty one and comes first among ties; repeated rows are documents
of their own (ties of wholly equal rows are broken arbitrarily, their rows being equal); a very long text is handled
whole, about 250 bytes of memory for each of its words; an empty table of documents gives an empty result, an empty
target has no features; other columns, whatever their names, are left out.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.ordered import numbered
from . import kernels
from .common import dropped, stored

BUCKETS = 10_000
#: The head at most: words, their bytes, and pairs of them. They bound what is sent to the tasks.
HEAD_WORDS, WORD_BYTES, HEAD_PAIRS = 1 << 16, 64, 1 << 18
#: Pairs that a task counts before it passes them on; it leaves out those it has met once only (and words once in a slice).
CHUNK = 1 << 20
#: What separates words: all of ASCII but digits and (after lower-casing) letters.
BETWEEN = np.arange(256) < 128
BETWEEN[[*range(48, 58), *range(97, 123)]] = False


class Head(NamedTuple):
    """Frequent words, their CRC states by place; frequent pairs (place << 16 | place, ascending), their states and buckets."""

    words: kernels.Vocabulary
    state: np.ndarray
    pair: np.ndarray
    pair_state: np.ndarray
    pair_bucket: np.ndarray


NO_HEAD = Head(kernels.Vocabulary([]), np.zeros(0, np.uint32), np.zeros(0, np.int64), np.zeros(0, np.uint32), np.zeros(0, np.int64))


def _zero_byte(x: np.ndarray) -> np.ndarray:
    """The CRC register after one zero byte more."""
    for _ in range(8):
        x = (x >> np.uint32(1)) ^ np.where(x & np.uint32(1), np.uint32(0xEDB88320), np.uint32(0))
    return x


def _tables() -> tuple[np.ndarray, list[np.ndarray]]:
    """Maps of a register's four bytes over 0 to 63 zero bytes, and over 64, 128, 256, ... of them."""
    table = np.arange(256, dtype=np.uint32)[None, :] << (8 * np.arange(4, dtype=np.uint32))[:, None]
    low = [table]
    for _ in range(64):
        low.append(_zero_byte(low[-1]))
    high = [low.pop()]
    for _ in range(34):
        high.append(_apply(high[-1], high[-1]))
    return np.stack(low), high


def _apply(table: np.ndarray, x: np.ndarray) -> np.ndarray:
    byte = np.uint32(255)
    return table[0][x & byte] ^ table[1][(x >> np.uint32(8)) & byte] ^ table[2][(x >> np.uint32(16)) & byte] ^ table[3][x >> np.uint32(24)]


_LOW, _HIGH = _tables()


def continued(state: np.ndarray, crc: np.ndarray, size: np.ndarray) -> np.ndarray:
    """CRC of A + B from those of A (``state``) and B (``crc``) and the bytes of B."""
    byte, low = np.uint32(255), size & 63
    out = _LOW[low, 0, state & byte] ^ _LOW[low, 1, (state >> np.uint32(8)) & byte] ^ _LOW[low, 2, (state >> np.uint32(16)) & byte] ^ _LOW[low, 3, state >> np.uint32(24)]
    for k in range(6, int(size.max(initial=0)).bit_length()):
        some = np.flatnonzero((size >> k) & 1)
        out[some] = _apply(_HIGH[k - 6], out[some])
    return out ^ crc


def direct(seen: kernels.Words, which: np.ndarray) -> np.ndarray:
    """CRC of some of the words, from their bytes: the CRC of as many zeros, and what each byte changes in it at its distance from the end."""
    start, end = seen.start[which], seen.end[which]
    size = end - start
    out = np.zeros(len(which), np.uint32)
    short = np.flatnonzero(size <= 64)
    if len(short):
        upto = np.cumsum(size[short])
        away = np.repeat(upto, size[short]) - 1 - np.arange(upto[-1])
        byte = seen.data[np.repeat(end[short], size[short]) - 1 - away]
        out[short] = np.bitwise_xor.reduceat(_BYTE[away, byte], upto - size[short]) ^ _ZEROS[size[short]]
    for i in np.flatnonzero(size > 64).tolist():
        out[i] = zlib.crc32(seen.data[start[i] : end[i]])
    return out


_BYTE = np.concatenate([_LOW[1:, 0], _HIGH[0][None, 0]])
_ZEROS = np.array([zlib.crc32(bytes(n)) for n in range(65)], np.uint32)
_SPACE = np.array([zlib.crc32(b" ")], np.uint32)


def _seen(b: pa.RecordBatch) -> Iterator[tuple[int, int, kernels.Words]]:
    for first, end, data, offs in kernels.slices(b.column("text")):
        yield first, end, kernels.Words(kernels.lowered(data), offs, BETWEEN)


def features(head: Head, seen: kernels.Words) -> list[tuple[np.ndarray, np.ndarray]]:
    """(place of the first word, bucket) of the runs of one, two and three words; no run crosses documents."""
    place, doc = head.words.find(seen), seen.doc()
    tail = np.flatnonzero(place < 0)
    one = np.zeros(len(place), np.uint32)
    one[place >= 0] = head.state[place[place >= 0]]
    one[tail] = direct(seen, tail)
    size = seen.end - seen.start + 1
    after = continued(np.repeat(_SPACE, len(one)), one, size - 1)  # of " " + word
    two = np.flatnonzero(doc[1:] == doc[:-1])
    key = np.where((place[two] >= 0) & (place[two + 1] >= 0), (place[two] << 16) | place[two + 1], -1)
    hit, spot = np.zeros(len(two), bool), np.zeros(len(two), np.int64)
    if len(head.pair):
        spot = np.minimum(np.searchsorted(head.pair, key), len(head.pair) - 1)
        hit = head.pair[spot] == key
    pairs, bucket = np.zeros(len(doc), np.uint32), np.zeros(len(two), np.int64)
    tail = two[~hit]
    pairs[two[hit]] = head.pair_state[spot[hit]]
    pairs[tail] = continued(one[tail], after[tail + 1], size[tail + 1])
    bucket[hit], bucket[~hit] = head.pair_bucket[spot[hit]], _bucket(pairs[tail])
    three = np.flatnonzero(doc[2:] == doc[:-2])
    return [(np.arange(len(one)), _bucket(one)), (two, bucket), (three, _bucket(continued(pairs[three], after[three + 2], size[three + 2])))]


def _bucket(crc: np.ndarray) -> np.ndarray:
    return (crc % np.uint32(BUCKETS)).astype(np.int64)


def _above(counts: DataFrame, most: int) -> DataFrame:
    """Rows of the highest counts, ``most`` at most: whole levels of the count, so that no task orders or holds them all."""
    level = F.floor(8 * F.log2(F.col("n")))
    per = sorted(counts.groupBy(level.alias("level")).agg(F.count(F.lit(1)).alias("rows")).collect(), key=lambda r: -r.level)  # a few hundred levels
    kept, least = 0, None
    for r in per:
        kept += r.rows
        if kept > most:
            break
        least = r.level
    return counts.limit(0) if least is None else counts.filter(level >= least)


def _word_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for _, _, seen in _seen(b):
            _, which, n = np.unique(seen.hash, return_index=True, return_counts=True)
            keep = (n > 1) & ((seen.end - seen.start)[which] <= WORD_BYTES)
            yield pa.RecordBatch.from_arrays([seen.take(which[keep]).cast(pa.binary()), pa.array(n[keep])], names=["word", "n"])


def _pair_counts(head):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def out() -> pa.RecordBatch:
            key, n = np.unique(np.concatenate(held), return_counts=True)
            return pa.RecordBatch.from_arrays([pa.array(key[n > 1]), pa.array(n[n > 1])], names=["pair", "n"])

        for b in batches:
            for _, _, seen in _seen(b):
                place, doc = head.value.words.find(seen), seen.doc()
                held.append(((place[:-1] << 16) | place[1:])[(place[:-1] >= 0) & (place[1:] >= 0) & (doc[1:] == doc[:-1])])
                size += len(held[-1])
                if size >= CHUNK:
                    yield out()
                    held, size = [], 0
        if size:
            yield out()

    return run


def learn_head(texts: DataFrame, most_words: int = HEAD_WORDS, most_pairs: int = HEAD_PAIRS) -> Head:
    """The frequent words and pairs of ``texts`` (text); bounded by the two numbers."""
    spark = texts.sparkSession
    counts = stored(texts.mapInArrow(_word_counts, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n")))
    words = sorted(_above(counts, min(most_words, HEAD_WORDS)).select("word").toArrow()["word"].to_pylist())
    dropped(counts)
    head = NO_HEAD._replace(words=kernels.Vocabulary(words), state=np.array([zlib.crc32(w) for w in words], np.uint32))
    sent = spark.sparkContext.broadcast(head)
    counts = stored(texts.mapInArrow(_pair_counts(sent), "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n")))
    pair = np.sort(np.asarray(_above(counts, most_pairs).select("pair").toArrow()["pair"].combine_chunks()).astype(np.int64))
    dropped(counts)
    sent.unpersist()
    size = np.array([len(w) for w in words], np.int64)
    second = pair & 0xFFFF
    after = continued(np.repeat(_SPACE, len(pair)), head.state[second], size[second])
    pair_state = continued(head.state[pair >> 16], after, size[second] + 1)
    return head._replace(pair=pair, pair_state=pair_state, pair_bucket=_bucket(pair_state))


def bucketed(docs: DataFrame, head) -> DataFrame:
    """``doc_id, n_words, buckets`` of each document: the buckets of its words, pairs and triples."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for first, end, seen in _seen(b):
                count, doc = np.diff(seen.at), seen.doc()
                offs = np.concatenate([[0], np.cumsum(count + np.maximum(0, count - 1) + np.maximum(0, count - 2))])
                out, begin = np.zeros(offs[-1], np.int16), offs[:-1].copy()
                for k, (place, bucket) in enumerate(features(head.value, seen)):
                    out[begin[doc[place]] + place - seen.at[doc[place]]] = bucket
                    begin += np.maximum(0, count - k)
                yield pa.RecordBatch.from_arrays([b.column("doc_id").slice(first, end - first), pa.array(count), pa.ListArray.from_arrays(pa.array(offs.astype(np.int32)), pa.array(out))], names=["doc_id", "n_words", "buckets"])

    return docs.mapInArrow(run, "doc_id long, n_words long, buckets array<smallint>")


def _buckets(b: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    lists = b.column("buckets")
    return np.asarray(lists.flatten()), np.concatenate([[0], np.cumsum(np.asarray(lists.value_lengths()).astype(np.int64))])


def bucket_totals(rows: DataFrame) -> DataFrame:
    """``bucket, n``: how often the features fall into each bucket (those that some do)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(BUCKETS, np.int64)
        for b in batches:
            total += np.bincount(_buckets(b)[0], minlength=BUCKETS)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], names=["bucket", "n"])

    return rows.select("buckets").mapInArrow(run, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n"))


def bucket_gains(corpus: DataFrame, target: DataFrame) -> np.ndarray:
    """floor(1000 ln(target share / corpus share)) of each bucket, one added to each count; ``BUCKETS`` rows at most come to the driver."""
    every = corpus.sparkSession.range(BUCKETS).select(F.col("id").alias("bucket"))
    s, t = corpus.select("bucket", F.col("n").alias("s")), target.select("bucket", F.col("n").alias("t"))
    rows = every.join(s, "bucket", "left").join(t, "bucket", "left").select("bucket", F.coalesce("s", F.lit(0)).alias("s"), F.coalesce("t", F.lit(0)).alias("t"))
    total = rows.crossJoin(F.broadcast(rows.agg(F.sum("s").alias("all_s"), F.sum("t").alias("all_t"))))  # one row
    gain = F.floor(1000 * F.ln(((F.col("t") + 1).cast("double") * (F.col("all_s") + BUCKETS)) / ((F.col("s") + 1).cast("double") * (F.col("all_t") + BUCKETS))))
    return np.array([r.gain for r in total.select("bucket", gain.alias("gain")).orderBy("bucket").collect()], np.int64)


def weigh(rows: DataFrame, gains: np.ndarray) -> DataFrame:
    """``doc_id, n_words, n_features, weight`` of each document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            bucket, offs = _buckets(b)
            total = np.concatenate([[0], np.cumsum(gains[bucket])])
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("n_words"), pa.array(np.diff(offs)), pa.array(total[offs[1:]] - total[offs[:-1]])], names=["doc_id", "n_words", "n_features", "weight"])

    return rows.mapInArrow(run, "doc_id long, n_words long, n_features long, weight long")


def resample(docs: DataFrame, target: DataFrame, percent: int = 5, least_words: int = 20, seed: str = "42") -> DataFrame:
    """One row for each document: doc_id, n_features, weight, score, rank.

    Of the documents with ``least_words`` words or more, the ``percent`` of a hundred with the highest scores are
    drawn; rank counts them from 1, and is null for the others.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    target = target.select(F.lit(0).cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    head = docs.sparkSession.sparkContext.broadcast(learn_head(docs.select("text")))
    rows = stored(bucketed(docs, head))
    gains = bucket_gains(bucket_totals(rows), bucket_totals(bucketed(target, head)))
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))).cast("binary"), 256), 1, 8), 16, 10).cast("double")
    noise = F.floor(-1000 * F.ln(-F.ln((h + 0.5) / 4294967296)))
    out = stored(weigh(rows, gains).withColumn("score", F.col("weight") + noise))
    dropped(rows)
    able = out.filter(F.col("n_words") >= least_words)
    drawn = percent * able.count() // 100
    ranked = numbered(able, [F.col("score").desc(), F.col("doc_id").asc_nulls_first(), "weight", "n_features"])
    ranked = ranked.withColumn("rank", F.when(F.col("number") <= drawn, F.col("number")))
    rest = out.filter(F.col("n_words") < least_words).withColumn("rank", F.lit(None).cast("long"))
    columns = ("doc_id", "n_features", "weight", "score", "rank")
    return ranked.select(*columns).unionByName(rest.select(*columns))
