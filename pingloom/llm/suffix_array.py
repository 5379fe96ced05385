"""Suffix-array dedup: a distributed merge sort of suffixes that exchanges front-coded runs.

``repeats`` leaves out suffixes that cannot repeat; it decides nothing else. Tasks sort the others into runs, drop
those that equal an earlier one of the run, cut the runs at common splitters and front-code them: for each suffix
the number of bytes shared with the one before and the rest. The task of a range merges its runs with a loser tree
whose players carry the prefix that they are known to share with the last winner: a comparison starts behind it
and never reads known bytes again. The merged order with its common prefixes is the (sparse) suffix array with its
LCP array, from which equal windows follow.

Balance: splitters are quantiles of a sample that grows with the number of ranges. Beyond ``MOST_RANGES`` ranges,
each is cut into slices by hash of what equal windows share, so no group grows with the corpus and the driver
holds at most ``SAMPLED`` heads a range. Hot grams, by exact count, are cut into single windows.

Defined results: a null text is empty; an empty text has no window; a very long text is cut into runs piece by piece
(about 16 bytes of memory a byte); of equal texts the one with the smallest id keeps its bytes; repeated rows are
documents of their own, where a row that equals another in id and text counts as the later one for one of the two;
an empty table gives an empty result; other columns, whatever their names, are left out.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import repeats
from .common import stored, with_doc_id, with_rid

PLAN = repeats.Plan("bytes", 100, 24)
#: Entries in a range of the merge (about), ranges at most, and heads sampled for each range.
RANGE = 100_000
MOST_RANGES = 4096
SAMPLED = 32


def front_code(e: dict, lcp: np.ndarray) -> bytes:
    """A sorted run: prefix lengths, the rest of each suffix, and what belongs to it."""
    depth = e["depth"].astype(np.int64)
    rest = e["suffix"][(np.arange(e["suffix"].shape[1]) >= lcp[:, None]) & (np.arange(e["suffix"].shape[1]) < depth[:, None])].tobytes()
    body = {k: v for k, v in e.items() if k != "suffix"} | {"lcp": lcp.astype(np.uint8), "rest": rest}
    return repeats.pack(body)


class Run:
    """Reads a front-coded run suffix by suffix."""

    def __init__(self, blob: bytes):
        self.body = repeats.unpack(blob)
        self.lcp, self.depth = self.body["lcp"].tolist(), self.body["depth"].tolist()
        self.rest = self.body.pop("rest")
        self.at = self.i = 0
        self.size = len(self.lcp)
        self.text = b""

    def step(self) -> bool:
        """Move to the next suffix; False at the end."""
        if self.i == self.size:
            return False
        shared, depth = self.lcp[self.i], self.depth[self.i]
        self.text = self.text[:shared] + self.rest[self.at : self.at + depth - shared]
        self.at += depth - shared
        self.i += 1
        return True


def _beats(a: list, b: list) -> bool:
    """Whether player a comes before player b. A player: [known prefix with the last winner, text, number, run].

    More shared with the last winner comes first. With equally much, bytes are compared behind the known prefix,
    and the loser's known prefix becomes what it shares with this winner.
    """
    if a[1] is None or b[1] is None:
        return b[1] is None
    if a[0] != b[0]:
        return a[0] > b[0]
    known, x, y = a[0], a[1], b[1]
    n = min(len(x), len(y))
    p, q = x[known:n], y[known:n]
    if p == q:
        shared, first = n, (len(x), a[2]) < (len(y), b[2])
    else:
        k = n - known
        shared = known + k - ((int.from_bytes(p) ^ int.from_bytes(q)).bit_length() + 7) // 8
        first = p < q
    (b if first else a)[0] = shared
    return first


def merge(blobs: list[bytes]) -> tuple[dict, np.ndarray]:
    """Entries of all runs in order (without the suffix bytes), with the prefix that each shares with the one before."""
    runs = [Run(b) for b in blobs]
    size = 1
    while size < len(runs):
        size *= 2
    players = [[0, r.text if r.step() else None, i, r] for i, r in enumerate(runs)] + [[0, None, i, None] for i in range(len(runs), size)]
    # tree[n] holds the loser of the match at node n; the winner goes up
    tree: list = [None] * size

    def play(node: int) -> list:
        if node >= size:
            return players[node - size]
        a, b = play(2 * node), play(2 * node + 1)
        first = _beats(a, b)
        tree[node] = b if first else a
        return a if first else b

    top = play(1)
    lcps, which, item = [], [], []
    beats = _beats
    while top[1] is not None:
        run = top[3]
        lcps.append(top[0])
        which.append(top[2])
        item.append(run.i - 1)
        if run.step():
            top[0], top[1] = run.lcp[run.i - 1], run.text
        else:
            top[1] = None
        node = (size + top[2]) >> 1
        while node:
            other = tree[node]
            if other[1] is not None and not beats(top, other):
                tree[node], top = top, other
            node >>= 1
    start = np.cumsum([0] + [r.size for r in runs])[np.array(which, dtype=np.int64)] + np.array(item, dtype=np.int64) if which else np.zeros(0, np.int64)
    bodies = repeats.joined([{k: r.body[k] for k in ("depth", "before", "rid", "pos", "low", "high")} for r in runs])
    return repeats.taken(bodies, start), np.array(lcps, dtype=np.int64)


def _sorted_runs(splitters: list[bytes], slices: int, hot: np.ndarray):
    cuts = np.array(splitters, dtype=f"S{PLAN.window}")
    parts = (len(cuts) + 1) * slices

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in repeats.entries(PLAN, batches, hot):
            for e in repeats.split_hot(PLAN, whole):
                e, gone = repeats.collapse(repeats.taken(e, repeats.in_order(e)))
                # equal stretches must meet: a suffix goes by the bytes that every stretch shares
                head = repeats.heads(PLAN, e)
                part = np.searchsorted(cuts, head, "right") * slices
                if slices > 1:
                    part += (repeats.hashed(head) % np.uint64(slices)).astype(np.int64)
                    order = np.argsort(part, kind="stable")
                    e, part = repeats.taken(e, order), part[order]
                lcp = repeats.common_prefix(PLAN, e)
                begin = np.flatnonzero(np.append(True, part[1:] != part[:-1])) if len(part) else np.zeros(0, np.int64)
                rows = []
                for a, z in zip(begin, np.append(begin[1:], len(part)), strict=True):
                    own = lcp[a:z].copy()
                    own[0] = 0
                    rows.append((int(part[a]), front_code(repeats.taken(e, slice(a, z)), own), b""))
                if len(gone[0]):
                    rows.append((int(gone[0][0]) % parts, b"", repeats.pack(gone)))
                yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.binary()), pa.array([r[2] for r in rows], pa.binary())], names=["part", "run", "gone"])

    return run


def _merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows in order of part: a range's runs are merged once all are there."""
    part, blobs = None, []

    def out():
        e, lcp = merge(blobs)
        return repeats.spans([repeats.repeated(PLAN, e, lcp)])

    for b in batches:
        for p, blob, gone in zip(b.column("part").to_pylist(), b.column("run").to_pylist(), b.column("gone").to_pylist(), strict=True):
            if p != part and blobs:
                yield out()
                blobs = []
            part = p
            if gone:
                yield repeats.spans([repeats.unpack(gone)])
            if blob:
                blobs.append(blob)
    if blobs:
        yield out()


def _splitters(docs: DataFrame, runs: DataFrame, hot: np.ndarray, size: int, most: int) -> tuple[list[bytes], int]:
    """Quantiles of sampled heads, and slices of a range; both only balance the merge."""
    total = runs.filter(F.col("kind") == repeats.EDGE).count()
    ranges = min(most, -(-total // size))
    if ranges < 2:
        return [], 1
    sample = sorted(repeats.sample_entries(docs, runs, PLAN, SAMPLED * ranges / total, hot))
    upto = np.cumsum([w for _, w in sample])
    if not len(upto):
        return [], 1
    at = np.searchsorted(upto, upto[-1] * np.arange(1, ranges) / ranges)
    return sorted({sample[i][0] for i in at.tolist()}), -(-total // (size * ranges))


def _kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        out = []
        for text, found in zip(b.column("text").cast(pa.binary()), repeats.doc_spans(b), strict=True):
            raw = text.as_py() or b""
            if found is None:
                out.append((len(raw), 0, 0, hashlib.sha256(raw).hexdigest(), []))
                continue
            mask = repeats.covered(len(raw), PLAN.window, *found)
            edge = np.diff(np.concatenate([[0], mask.astype(np.int8), [0]]))
            begin, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
            out.append((len(raw), int(mask.sum()), len(begin), hashlib.sha256(np.frombuffer(raw, np.uint8)[~mask].tobytes()).hexdigest(), np.stack([begin, end], 1).tolist()))
        cols = list(zip(*out, strict=True)) if out else [[]] * 5
        yield pa.RecordBatch.from_arrays(
            [b.column("rid"), pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.int64()), pa.array(cols[3], pa.string()), pa.array(cols[4], pa.list_(pa.list_(pa.int64())))],
            names=["rid", "n_bytes", "n_removed", "n_spans", "kept_sha256", "spans"],
        )


def suffix_dedup(docs: DataFrame, size: int = RANGE, most: int = MOST_RANGES, limit: int = repeats.HOT) -> DataFrame:
    """One row for each document: doc_id, n_bytes, n_removed, n_spans, kept_sha256, spans (removed [begin, end) bytes).

    ``size`` entries a range of the merge, ``most`` ranges, ``limit`` runs of a gram that is not hot: they shape the work only.
    """
    docs, ids = with_rid(docs)
    runs = stored(repeats.find_runs(docs, PLAN, limit))
    hot = repeats.hot_grams(runs)
    sorted_runs = repeats.with_edges(docs, runs).mapInArrow(_sorted_runs(*_splitters(docs, runs, hot, size, most), hot), "part long, run binary, gone binary")
    found = sorted_runs.repartition("part").sortWithinPartitions("part").mapInArrow(_merged, repeats.SPANS)
    out = repeats.with_spans(docs, found).mapInArrow(_kept, "rid long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, spans array<array<long>>")
    return with_doc_id(out, ids)
