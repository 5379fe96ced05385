"""Ranked lexical search: many items ranked over all documents, with their common subexpressions evaluated once.

An item's score of a document is a sum over its terms, so items that share terms share partial sums. For each block of
items the shared term sets are mined: terms that stand equally often in the same items become one set, and the two
sets that most items hold together are joined, again and again, while two items still share a pair. The sets form a
directed graph of sums, each of two smaller ones. Every task walks its documents once: it computes the accumulators of
the mined sets for a few hundred documents at a time, each once, adds them up along the graph to the items' scores,
and keeps the best documents of each item. Only these leave the task, so no accumulator is shuffled.

Corpus statistics (documents, terms, and documents for each term of a block) are exact counts over all documents.
Items come in blocks of bounded size to the driver, which plans them; each block reads the documents twice.

Defined results: documents and items without terms (null, empty, blank) match nothing and give no rows; null ids are
kept, and come first among ties; repeated rows, of documents or of items, are ranked each on its own; a very long text
is handled whole, about 150 bytes of memory for each of its words; empty tables give an empty result; other columns,
whatever their names, are left out.
"""

from __future__ import annotations

import heapq
from collections import defaultdict
from collections.abc import Iterator
from itertools import combinations
from math import floor, log
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import kernels
from .common import keyed, stored
from .importance import BETWEEN

#: Distinct terms of the items of a block (about; an item is never cut), and sets of one item among which pairs are sought.
BLOCK_TERMS, SOUGHT = 1 << 16, 128
#: Accumulators that a task holds at once, and found rows before it drops all but the best.
CELLS, FOUND = 1 << 21, 1 << 18


class Plan(NamedTuple):
    """A block of items: its terms; where each term is added (entries ``at[t]`` to ``at[t + 1]``: set, factor); sums of
    two sets, level by level (first set of the level, left, right); and the sets that each item adds up."""

    terms: kernels.Vocabulary
    at: np.ndarray
    leaf: np.ndarray
    factor: np.ndarray
    levels: list[tuple[int, np.ndarray, np.ndarray]]
    items: np.ndarray
    parts: np.ndarray
    begin: np.ndarray
    sets: int


def mine(items: list[dict]) -> tuple[list[set], list[tuple[int, int]], list[set[int]]]:
    """Sets of elements that always occur together, sums of two sets (numbered on from those), and the sets of each item.

    ``items``: the elements of each, as keys. An item's sets hold each of its elements once.
    """
    holders: dict = defaultdict(list)
    for i, elements in enumerate(items):
        for e in sorted(elements):
            holders[e].append(i)
    alike: dict[tuple, set] = defaultdict(set)
    for e, own in holders.items():
        alike[tuple(own)].add(e)
    leaves, parts, where = [], [set() for _ in items], []
    for own, elements in sorted(alike.items(), key=lambda x: (-len(x[0]), x[0])):
        for i in own:
            parts[i].add(len(leaves))
        leaves.append(elements)
        where.append(set(own))
    count: dict[tuple[int, int], int] = defaultdict(int)
    for own in parts:
        shared = sorted(n for n in own if len(where[n]) > 1)  # frequent ones first
        for a in range(0, len(shared), SOUGHT):
            for pair in combinations(shared[a : a + SOUGHT], 2):
                count[pair] += 1
    heap = [(-n, pair) for pair, n in count.items() if n > 1]
    heapq.heapify(heap)
    sums = []
    while heap:
        n, (a, b) = heapq.heappop(heap)
        both = where[a] & where[b]
        if len(both) < 2:
            continue
        if len(both) < -n:  # some of its items have taken another pair since
            heapq.heappush(heap, (-len(both), (a, b)))
            continue
        new = len(leaves) + len(sums)
        sums.append((a, b))
        where.append(both)
        where[a], where[b] = where[a] - both, where[b] - both
        near: dict[int, int] = defaultdict(int)
        for i in both:
            parts[i] -= {a, b}
            if len(parts[i]) <= SOUGHT:
                for x in parts[i]:
                    near[x] += 1
            parts[i].add(new)
        for x, n in near.items():
            if n > 1:
                heapq.heappush(heap, (-n, (x, new)))
    return leaves, sums, parts


def plan_block(items: list[dict[bytes, int]], terms: list[bytes], weights: list[int]) -> Plan:
    """``items``: how often each has its terms; ``terms`` ascending, with their weights."""
    place = {t: i for i, t in enumerate(terms)}
    leaves, sums, parts = mine([{(place[t], n): 1 for t, n in item.items()} for item in items])
    # sets in order of depth, so that a level is one range of accumulators
    depth = [0] * len(leaves)
    for a, b in sums:
        depth.append(1 + max(depth[a], depth[b]))
    order = sorted(range(len(depth)), key=lambda n: (depth[n], n))
    number = np.empty(len(order), np.int64)
    number[order] = np.arange(len(order))
    levels = []
    for d in range(1, max(depth, default=0) + 1):
        level = [n for n in order if depth[n] == d]
        left, right = zip(*(sums[n - len(leaves)] for n in level), strict=True)
        levels.append((int(number[level[0]]), number[list(left)], number[list(right)]))
    added = sorted((t, int(number[k]), n * weights[t]) for k, leaf in enumerate(leaves) for t, n in leaf)
    some = [i for i, own in enumerate(parts) if own]
    size = [len(parts[i]) for i in some]
    return Plan(
        kernels.Vocabulary(terms),
        np.searchsorted(np.array([t for t, _, _ in added], np.int64), np.arange(len(terms) + 1)),
        np.array([k for _, k, _ in added], np.int64),
        np.array([f for _, _, f in added], np.int64),
        levels,
        np.array(some, np.int64),
        np.array([number[n] for i in some for n in sorted(parts[i])], np.int64),
        np.concatenate([[0], np.cumsum(size)])[:-1].astype(np.int64),
        len(depth),
    )


def accumulate(plan: Plan, doc: np.ndarray, term: np.ndarray, impact: np.ndarray, n_docs: int) -> np.ndarray:
    """Scores of all items (rows, as in ``plan.items``) and documents (columns) from postings (doc, term, impact)."""
    acc = np.zeros(plan.sets * n_docs, np.int64)
    times = plan.at[term + 1] - plan.at[term]
    entry = np.arange(times.sum()) + np.repeat(plan.at[term] - np.cumsum(times) + times, times)
    np.add.at(acc, plan.leaf[entry] * n_docs + np.repeat(doc, times), plan.factor[entry] * np.repeat(impact, times))
    acc = acc.reshape(plan.sets, n_docs)
    for first, left, right in plan.levels:
        np.add(acc[left], acc[right], out=acc[first : first + len(left)])
    return np.add.reduceat(acc[plan.parts], plan.begin, axis=0)


class Best:
    """The ``k`` best documents of each item so far: highest score, then null id, then smallest id."""

    def __init__(self, items: int, k: int):
        self.k, self.least, self.held, self.size = k, np.ones(items, np.int64), [], 0

    def add(self, scores: np.ndarray, ids: np.ndarray, known: np.ndarray) -> None:
        item, doc = np.nonzero(scores >= self.least[:, None])
        self.held.append((item, scores[item, doc], ids[doc], known[doc]))
        self.size += len(item)
        if self.size > FOUND:
            self.prune()

    def prune(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        if not self.held:
            return (np.zeros(0, np.int64),) * 3 + (np.zeros(0, bool),)
        item, score, ids, known = (np.concatenate(c) for c in zip(*self.held, strict=True))
        order = np.lexsort((ids, known, -score, item))
        item = item[order]
        rank = np.arange(len(item)) - np.searchsorted(item, item)
        keep = order[rank < self.k]
        last = rank == self.k - 1
        self.least[item[last]] = score[order[last]]
        item = item[rank < self.k]
        self.held, self.size = [(item, score[keep], ids[keep], known[keep])], 0
        return self.held[0]


def _postings(plan: Plan, seen: kernels.Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(doc, term, times) for the plan's terms, by doc."""
    term, doc = plan.terms.find(seen), seen.doc()
    n = max(1, len(plan.at) - 1)
    key, times = np.unique(doc[term >= 0] * n + term[term >= 0], return_counts=True)
    return key // n, key % n, times


def _lowered(b: pa.RecordBatch) -> Iterator[tuple[int, int, kernels.Words]]:
    for first, end, data, offs in kernels.slices(b.column("text")):
        yield first, end, kernels.Words(kernels.lowered(data), offs, BETWEEN)


def corpus_counts(docs: DataFrame, terms: list[bytes]) -> tuple[int, int, list[int]]:
    """Documents with terms, all their terms, and how many documents hold each of ``terms``; a row for each of these comes to the driver."""
    listed = docs.sparkSession.sparkContext.broadcast(kernels.Vocabulary(terms))
    n = len(terms)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(n + 2, np.int64)
        for b in batches:
            for _, _, seen in _lowered(b):
                term = listed.value.find(seen)
                key = np.unique(seen.doc()[term >= 0] * n + term[term >= 0]) if n else np.zeros(0, np.int64)
                total[:n] += np.bincount(key % max(1, n), minlength=n)
                total[n] += (np.diff(seen.at) > 0).sum()
                total[n + 1] += len(seen.hash)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], names=["what", "n"])

    rows = docs.select("text").mapInArrow(run, "what long, n long").groupBy("what").agg(F.sum("n").alias("n")).collect()
    found = {r.what: r.n for r in rows}
    listed.unpersist()
    return found.get(n, 0), found.get(n + 1, 0), [found.get(i, 0) for i in range(n)]


def _tempered(n: np.ndarray, docs: int, terms: int) -> np.ndarray:
    """What a document's length adds to its terms' counts: 100 - 25 + 25 n N div L."""
    if int(n.max(initial=0)) * 25 * docs < 1 << 63:
        return 75 + 25 * n * docs // terms
    return np.array([75 + 25 * x * docs // terms for x in n.tolist()], np.int64)


def best_documents(docs: DataFrame, plan: Plan, n_docs: int, n_terms: int, k: int) -> DataFrame:
    """``item, doc_id, score``: of each task the ``k`` best documents of each item (by its place in the block)."""
    sent = docs.sparkSession.sparkContext.broadcast(plan)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        plan = sent.value
        best, step = Best(len(plan.items), k), max(1, CELLS // max(1, plan.sets))
        for b in batches:
            ids, known = np.asarray(b.column("doc_id").fill_null(0)), np.asarray(b.column("doc_id").is_valid())
            for first, end, seen in _lowered(b):
                doc, term, times = _postings(plan, seen)
                m = _tempered(np.diff(seen.at), n_docs, n_terms)
                impact = 1_000_000_000 * times // (1000 * times + 12 * m[doc])
                for a in range(0, end - first, step):
                    z = min(a + step, end - first)
                    own = slice(*np.searchsorted(doc, [a, z]))
                    best.add(accumulate(plan, doc[own] - a, term[own], impact[own], z - a), ids[first + a : first + z], known[first + a : first + z])
        item, score, found, known = best.prune()
        yield pa.RecordBatch.from_arrays([pa.array(plan.items[item]), pa.array(found, mask=~known), pa.array(score)], names=["item", "doc_id", "score"])

    return docs.mapInArrow(run, "item long, doc_id long, score long")


def _item_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for first, end, seen in _lowered(b):
            words, at = seen.take(np.arange(len(seen.hash))).cast(pa.binary()), seen.at
            for i in range(first, end):
                counts = words.slice(at[i - first], at[i - first + 1] - at[i - first]).value_counts()
                names = [pa.array([v], t) for v, t in (([x["values"].as_py() for x in counts], pa.list_(pa.binary())), ([x["counts"].as_py() for x in counts], pa.list_(pa.int64())))]
                yield pa.RecordBatch.from_arrays([b.column("row").slice(i, 1), b.column("item_id").slice(i, 1), *names], names=["row", "item_id", "terms", "times"])


def rank_documents(docs: DataFrame, items: DataFrame, k: int = 20, block_terms: int = BLOCK_TERMS) -> DataFrame:
    """The ``k`` best documents (doc_id, text) of each item (item_id, text): item_id, rank, doc_id, score."""
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    asked, row = keyed(items.select(F.col("item_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")))
    asked = stored(asked.select(F.col(row).alias("row"), F.col("doc_id").alias("item_id"), "text").mapInArrow(_item_terms, "row long, item_id long, terms array<binary>, times array<long>").filter("size(terms) > 0"))
    blocks = -(-(asked.agg(F.sum(F.size("terms"))).first()[0] or 0) // block_terms)
    found = None
    for block in range(blocks):
        rows = asked.filter(F.pmod(F.xxhash64("row"), F.lit(blocks)) == block).orderBy("row").collect()  # about block_terms terms
        if not rows:
            continue
        own = [{bytes(t): n for t, n in zip(r.terms, r.times, strict=True)} for r in rows]
        terms = sorted(set().union(*own))
        n_docs, n_terms, held = corpus_counts(docs, terms)
        if not n_terms:
            break
        plan = plan_block(own, terms, [floor(1000 * log((2 * n_docs + 2) / (2 * n + 1))) for n in held])
        some = best_documents(docs, plan, n_docs, n_terms, k)
        names = spark.createDataFrame([(i, r.row, r.item_id) for i, r in enumerate(rows)], "item long, row long, item_id long")
        some = stored(some.join(F.broadcast(names), "item").drop("item"))  # as many names as the block has items
        found = some if found is None else found.unionByName(some)
    if found is None:
        return spark.createDataFrame([], "item_id long, rank int, doc_id long, score long")
    best = W.partitionBy("row").orderBy(F.col("score").desc(), F.col("doc_id").asc_nulls_first())
    return found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k).select("item_id", "rank", "doc_id", "score")
