"""N-gram Jaccard join: size-banded tiles with hashed bitmap signatures.

A document's set holds the hashes of its distinct word n-grams. Equal sets are one node. Candidates come from an
exact filter. All sets are put in one order: frequent n-grams (by counts over the whole corpus) last, then by hash.
Two linked sets of sizes a and b differ in few elements, so among their first common elements two must stand side
by side in both, and within the first 2 * (1 - t) * a + 2 of each set (``prefix_keys``). Such neighbouring pairs are
join keys: a passage or a phrase that unlike documents share is frequent and comes last, and one n-gram in common
makes no key.

Nodes that share keys, directly or through others, form blocks. A block is compared in tiles: a small block is
one tile; a large one is cut by size band and hash into tiles of bounded size, and tiles of the same or
neighbouring bands meet. In a tile each set has a bitmap; elements that differ set at least as many bits apart,
so counting the bits of the exclusive-or bounds the overlap from above. Pairs that pass, and whose sets are not
connected yet, are intersected exactly as sorted arrays.

Defined results: null, empty and blank texts have an empty set and link with nothing; a text shorter than n
words has its whole sequence as its one n-gram; a very long text is one set (about 60 bytes of memory for each of its
words); repeated rows are documents of their own with equal sets (and share the smaller id as component); an empty
table gives an empty result; other columns, whatever their names, are left out.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.components import components
from . import kernels
from .common import stored, with_doc_id, with_rid

#: Sets in a tile at most (about).
TILE = 2048
TILE_ELEMENTS = 4_000_000
#: n-grams that a task counts at once, and times that a chunk and the corpus show a frequent one at least.
CHUNK, IN_CHUNK, FREQUENT = 1 << 22, 3, 32
MOST_FREQUENT = 1_000_000


def sets(data: np.ndarray, offs: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct n-gram hashes of each document in ascending order, end to end, and offsets."""
    data = kernels.lowered(data)
    start, end, at = kernels.words(data, offs)
    sums = kernels.Sums(kernels.word_hashes(data, start, end))
    count = np.diff(at)
    grams = np.where(count >= n, count - n + 1, np.minimum(count, 1))
    doc = np.repeat(np.arange(len(grams)), grams)
    first = at[:-1][doc] + np.arange(len(doc)) - np.repeat(np.cumsum(grams) - grams, grams)
    h = sums.ranges(first, np.minimum(first + n, at[1:][doc]))
    order = np.lexsort((h, doc))
    doc, h = doc[order], h[order]
    new = np.ones(len(h), dtype=bool)
    new[1:] = (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])
    doc, h = doc[new], h[new]
    return h, np.searchsorted(doc, np.arange(len(offs)))


def node_ids(h: np.ndarray, at: np.ndarray) -> np.ndarray:
    """A hash of each set (order plays no part)."""
    total = np.zeros(len(h) + 1, np.uint64)
    np.cumsum(kernels.mix(h), out=total[1:])
    size = np.diff(at).astype(np.uint64)
    return kernels.mix(total[at[1:]] - total[at[:-1]] + size * np.uint64(0x9E3779B97F4A7C15)).view(np.int64)


def bands(percent: int, largest: int) -> list[int]:
    """Lower ends of size bands up to the largest size; a linked pair lies in one band or in two neighbours."""
    edges = [1]
    while edges[-1] <= largest:
        edges.append(edges[-1] * 100 // percent + 1)
    return edges


def frequent_grams(docs: DataFrame, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(hashes in ascending order, level) of the ``MOST_FREQUENT`` n-grams that most different sets hold.

    Tasks count theirs and leave out those that a chunk shows less than ``IN_CHUNK`` times. The counts only decide
    the order of elements; any order gives the same links.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size, seen = [], 0, set()

        def out():
            h, count = np.unique(np.concatenate(held), return_counts=True)
            return pa.RecordBatch.from_arrays([pa.array(h[count >= IN_CHUNK].view(np.int64)), pa.array(count[count >= IN_CHUNK])], names=["h", "n"])

        for b in batches:
            for _, _, data, offs in kernels.slices(b.column("text")):
                h, at = sets(data, offs, n)
                fresh = _fresh(node_ids(h, at), seen)
                held.append(h[np.repeat(fresh, np.diff(at))])
                size += len(held[-1])
                if size >= CHUNK:
                    yield out()
                    held, size = [], 0
                    seen.clear()
        if size:
            yield out()

    rows = docs.select("text").mapInArrow(run, "h long, n long").groupBy("h").agg(F.sum("n").alias("n")).filter(F.col("n") >= FREQUENT)
    rows = rows.orderBy(F.col("n").desc(), "h").limit(MOST_FREQUENT).toArrow()
    h, count = np.asarray(rows["h"].combine_chunks()).astype(np.int64).view(np.uint64), np.asarray(rows["n"].combine_chunks()).astype(np.int64)
    order = np.argsort(h)
    return h[order], np.ceil(np.log2(count[order] + 1)).astype(np.int64)


def _fresh(node: np.ndarray, seen: set) -> np.ndarray:
    """Marks sets that ``seen`` did not hold yet."""
    out = np.zeros(len(node), dtype=bool)
    for i, x in enumerate(node.tolist()):
        if x not in seen:
            seen.add(x)
            out[i] = True
    return out


def prefix_keys(h: np.ndarray, at: np.ndarray, percent: int, frequent: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """(index of the set, key): sets of which two link share a key, unless they are equal.

    Sets of sizes a, b with o common elements have d = a + b - 2 o others. The first d + 2 common elements in the
    order are cut into d + 1 stretches at most by the others, so two of them are neighbours in both sets; they stand
    within the first d + 2 + (a - o) elements of the one of size a. With o >= t (a + b) / (1 + t) that is largest for
    b = t a: 2 (1 - t) a + 2. Below t = 0.75 common elements may be too few for that; there the keys are single
    elements of the first (1 - t) a + 1.
    """
    size = np.diff(at)
    doc = np.repeat(np.arange(len(size)), size)
    spot = np.minimum(np.searchsorted(frequent[0], h), max(0, len(frequent[0]) - 1))
    if len(frequent[0]):
        hit = frequent[0][spot] == h
        if hit.any():
            h = h[np.argsort(doc * 64 + np.where(hit, frequent[1][spot], 0), kind="stable")]
    rank = np.arange(len(h)) - at[:-1][doc]
    links = size * (100 - percent) >= percent  # smaller sets link with equal ones only
    if percent >= 75:
        first = np.minimum(size, 2 * size * (100 - percent) // 100 + 2) - 1
        use = np.flatnonzero(links[doc] & (rank < first[doc]))
        key = kernels.mix(h[use] + kernels.mix(h[np.minimum(use + 1, len(h) - 1)] * np.uint64(0x9E3779B97F4A7C15)))
    else:
        use = np.flatnonzero(links[doc] & (rank < (size - -(-size * percent // 100) + 1)[doc]))
        key = kernels.mix(h[use])
    return doc[use], key.view(np.int64)


def _nodes(n: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for first, end, data, offs in kernels.slices(b.column("text")):
                h, at = sets(data, offs, n)
                yield pa.RecordBatch.from_arrays([b.column("rid").slice(first, end - first), pa.array(np.diff(at)), pa.array(node_ids(h, at))], names=["rid", "n_shingles", "node"])

    return run


def _keys(n: int, percent: int, frequent: tuple[np.ndarray, np.ndarray]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = set()
        for b in batches:
            for _, _, data, offs in kernels.slices(b.column("text")):
                h, at = sets(data, offs, n)
                node = node_ids(h, at)
                size = np.diff(at)
                keep = _fresh(node, seen) & (size > 0)  # a set that this task has met before has sent its keys
                h = h[np.repeat(keep, size)]
                owner, key = prefix_keys(h, np.concatenate([[0], np.cumsum(size[keep])]), percent, frequent)
                yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(node[keep][owner])], names=["key", "node"])

    return run


def _stars(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows in order of (key, node): links from each further node of a key to its first."""
    last = None  # key and its first node
    for b in batches:
        if not b.num_rows:
            continue
        key, node = np.asarray(b.column("key")), np.asarray(b.column("node"))
        new = np.ones(len(key), dtype=bool)
        new[1:] = key[1:] != key[:-1]
        head = np.where(new, np.arange(len(key)), 0)
        first = node[np.maximum.accumulate(head)]
        if last is not None and key[0] == last[0]:
            run = int(np.flatnonzero(new)[1]) if new.sum() > 1 else len(key)
            first[:run] = last[1]
        last = (key[-1], first[-1])
        pairs = np.stack([node, first], 1)[node != first]
        if len(pairs):
            pairs = np.unique(pairs, axis=0)
            yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], names=["a", "b"])


def compare(ids: np.ndarray, side: np.ndarray, members: list[np.ndarray], percent: int) -> list[tuple[int, int]]:
    """Links that connect the sets of a tile (or of two: side 0 against side 1) as far as pairs of them are linked."""
    size = np.array([len(m) for m in members])
    order = np.lexsort((ids, size))
    ids, side, size = ids[order], side[order], size[order]
    members = [members[i] for i in order]
    bits = 1 << max(8, min(15, int(size.max()).bit_length() + 1))
    maps = np.zeros((len(ids), bits // 64), dtype=np.uint64)
    for i, m in enumerate(members):
        spot = (m >> np.uint64(20)) & np.uint64(bits - 1)
        np.bitwise_or.at(maps[i], (spot >> np.uint64(6)).astype(np.int64), np.uint64(1) << (spot & np.uint64(63)))
    two = side.min() != side.max()
    group = np.arange(len(ids))
    links = []
    for i in range(len(ids) - 1):
        end = int(np.searchsorted(size, size[i] * 100 // percent, "right"))
        js = np.arange(i + 1, end)
        js = js[group[js] != group[i]]
        if two:
            js = js[side[js] != side[i]]
        if not len(js):
            continue
        apart = np.bitwise_count(maps[js] ^ maps[i]).sum(1, dtype=np.int64)
        both = size[js] + size[i]
        most = (both - apart) // 2
        for j in js[100 * most >= percent * (both - most)].tolist():
            if group[j] == group[i]:
                continue
            a, b = members[i], members[j]
            at = np.minimum(np.searchsorted(b, a), len(b) - 1)
            common = int((b[at] == a).sum())
            if 100 * common >= percent * (len(a) + len(b) - common):
                links.append((int(ids[i]), int(ids[j])))
                group[group == group[j]] = group[i]
    return links


def _linked(n: int, percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pair, held = None, []

        def out():
            ids, side = np.array([x[0] for x in held], dtype=np.int64), np.array([x[1] for x in held])
            links = compare(ids, side, [x[2] for x in held], percent) if len(held) > 1 else []
            return pa.RecordBatch.from_arrays([pa.array([x[0] for x in links], pa.int64()), pa.array([x[1] for x in links], pa.int64())], names=["a", "b"])

        for b in batches:
            pairs, node, side = b.column("pair").to_pylist(), np.asarray(b.column("node")), np.asarray(b.column("side"))
            for first, end, data, offs in kernels.slices(b.column("text")):
                h, at = sets(data, offs, n)
                for i in range(first, end):
                    if pairs[i] != pair and held:
                        yield out()
                        held = []
                    pair = pairs[i]
                    held.append((node[i], side[i], h[at[i - first] : at[i - first + 1]].copy()))
        if held:
            yield out()

    return run


def _tiles(nodes: DataFrame, percent: int) -> DataFrame:
    """``rid, pair, side, node``: the pairs of tiles that each of ``nodes`` (rid, node, n_shingles, block) takes part in."""
    edges = bands(percent, nodes.agg(F.max("n_shingles")).first()[0] or 1)
    edges = F.array(*[F.lit(int(e)) for e in edges[1:]])  # grows with the logarithm of the largest size
    tiles = F.ceil(F.greatest(F.count(F.lit(1)) / TILE, F.sum("n_shingles") / TILE_ELEMENTS))
    n = nodes.join(nodes.groupBy("block").agg(tiles.alias("need")), "block")
    small = n.filter("need = 1").select("rid", F.xxhash64("block").alias("pair"), F.lit(0).alias("side"), "node")
    n = stored(n.filter("need > 1").withColumn("band", F.size(F.filter(edges, lambda e: e <= F.col("n_shingles")))).select("rid", "node", "n_shingles", "block", "band"))
    per = n.groupBy("block", "band").agg(tiles.alias("tiles"))
    n = n.join(per, ["block", "band"]).select("rid", "node", "block", "band", F.pmod(F.xxhash64("node"), "tiles").alias("tile"))
    t = per.select("block", "band", F.explode(F.expr("sequence(0L, tiles - 1)")).alias("tile"))
    a = t.select("block", F.col("band").alias("band_a"), F.col("tile").alias("tile_a"), F.explode(F.array("band", F.col("band") + 1)).alias("band_b"))
    met = a.join(t.select("block", F.col("band").alias("band_b"), F.col("tile").alias("tile_b")), ["block", "band_b"]).filter("band_a < band_b or tile_a <= tile_b")
    met = met.withColumn("pair", F.xxhash64("block", "band_a", "tile_a", "band_b", "tile_b"))
    left = n.join(met.select("block", F.col("band_a").alias("band"), F.col("tile_a").alias("tile"), "pair"), ["block", "band", "tile"]).select("rid", "pair", F.lit(0).alias("side"), "node")
    right = n.join(met.filter("band_a < band_b or tile_a < tile_b").select("block", F.col("band_b").alias("band"), F.col("tile_b").alias("tile"), "pair"), ["block", "band", "tile"]).select("rid", "pair", F.lit(1).alias("side"), "node")
    return small.unionByName(left).unionByName(right)


def jaccard_components(docs: DataFrame, n: int = 5, percent: int = 80) -> DataFrame:
    """One row for each document: doc_id, n_shingles, component_id (smallest doc_id reachable by links, itself included).

    Two documents link when 100 * intersection >= ``percent`` * union of their sets of word ``n``-grams.
    """
    docs, ids = with_rid(docs)
    own = stored(docs.mapInArrow(_nodes(n), "rid long, n_shingles long, node long"))
    keys = docs.mapInArrow(_keys(n, percent, frequent_grams(docs, n)), "key long, node long").repartition("key").sortWithinPartitions("key", "node")
    blocks = components(keys.mapInArrow(_stars, "a long, b long"))
    nodes = own.filter("n_shingles > 0").groupBy("node").agg(F.min("rid").alias("rid"), F.max("n_shingles").alias("n_shingles"))
    asked = stored(blocks.select("node", F.col("component").alias("block")).join(nodes, "node"))
    texts = docs.join(_tiles(asked, percent).select("rid", "pair", "side", "node"), "rid").select("pair", "side", "node", "text")
    links = texts.repartition("pair").sortWithinPartitions("pair").mapInArrow(_linked(n, percent), "a long, b long")
    groups = components(links)
    first = groups.join(asked.select("node", "rid"), "node")
    group_of = first.select("node", "component").join(first.groupBy("component").agg(F.min("rid").alias("least")), "component").select("node", "least")
    least = nodes.select("node", "rid").join(group_of, "node", "left").select("node", F.coalesce("least", "rid").alias("least"))
    out = own.filter("n_shingles > 0").join(least, "node").select("rid", "n_shingles", F.col("least").alias("component"))
    out = out.unionByName(own.filter("n_shingles = 0").select("rid", "n_shingles", F.col("rid").alias("component")))
    if ids is None:
        return out.select(F.col("rid").alias("doc_id"), "n_shingles", F.col("component").alias("component_id"))
    heads = ids.select(F.col("rid").alias("component"), F.col("doc_id").alias("component_id"))
    return with_doc_id(out, ids).join(heads, "component").select("doc_id", "n_shingles", "component_id")
