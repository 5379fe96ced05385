"""Substring dedup: prefix-partitioned suffix trees over words.

``repeats`` leaves out suffixes that cannot repeat; it decides nothing else. The others, 20 words deep, are dealt
into groups by prefixes of varying length: by their first word; where that begins too many (by exact count), by
the words of the gram that equal windows share; where the gram is hot, as single windows by all their words. So a
group fits a task's memory at any size of the corpus; its suffixes, sorted, with their common prefixes give the
suffix tree of the group, whose internal nodes are built bottom up. The leaves below a node of depth d share d
words: nodes deep enough give the repeats.

Defined results: a null text has no words; documents of fewer words than the window keep all; a very long text is cut
into runs piece by piece (about 30 bytes of memory a byte); of equal texts the one with the smallest id keeps its
words; repeated rows are documents of their own, where a row that equals another in id and text counts as the later
one for one of the two; an empty table gives an empty result; other columns are left out unless named in ``carry``,
where names of result columns are refused.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kernels, repeats
from .common import stored, with_doc_id, with_rid

PLAN = repeats.Plan("words", 20, 6)
#: Entries in a group (about), and heavy first words that are sent to all tasks at most.
GROUP = 100_000
#: Single windows of hot grams that a task sorts at once.
SINGLES = 75_000
MOST_HEAVY = 1_000_000


def _first_codes(e: dict) -> np.ndarray:
    """The first word of each suffix as a number."""
    head = np.zeros((len(e["depth"]), 8), np.uint8)
    head[:, 2:] = e["suffix"][:, : PLAN.width]
    return head.view(">u8").ravel().astype(np.uint64)


def _heavy_words(runs: DataFrame, size: int) -> np.ndarray:
    """Codes of words that begin more suffixes than half a group holds: the most frequent ``MOST_HEAVY`` at most."""
    count = runs.filter(F.col("kind") == repeats.EDGE).groupBy("first").count().filter(F.col("count") > size // 2)
    rows = count.orderBy(F.col("count").desc(), "first").limit(MOST_HEAVY).select("first").toArrow()
    return np.unique(np.asarray(rows["first"].combine_chunks()).astype(np.int64).view(np.uint64) >> np.uint64(16))


def _dealt(heavy: np.ndarray, groups: int, hot: np.ndarray):
    def key(e: dict) -> np.ndarray:
        first = _first_codes(e)
        if e["single"]:
            return repeats.hashed(repeats.heads(PLAN, e))
        return np.where(np.isin(first, heavy), repeats.hashed(repeats.heads(PLAN, e)), kernels.mix(first))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in repeats.entries(PLAN, batches, hot):
            if whole["hot"].any():  # runs of one gram come together, so that their equal windows collapse
                whole = repeats.taken(whole, np.argsort(_first_codes(whole), kind="stable"))
            for e in repeats.split_hot(PLAN, whole, SINGLES):
                e, gone = repeats.collapse(repeats.taken(e, repeats.in_order(e)))
                part = (key(e) % np.uint64(groups)).astype(np.int64)
                order = np.argsort(part, kind="stable")
                part = part[order]
                begin = np.flatnonzero(np.append(True, part[1:] != part[:-1])) if len(part) else np.zeros(0, np.int64)
                rows = [(int(part[a]), repeats.pack(repeats.taken(e, order[a:z])), b"") for a, z in zip(begin.tolist(), np.append(begin[1:], len(part)).tolist(), strict=True)]
                if len(gone[0]):
                    rows.append((int(gone[0][0]) % groups, b"", repeats.pack(gone)))
                yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.binary()), pa.array([r[2] for r in rows], pa.binary())], names=["part", "entries", "gone"])

    return run


def internal_nodes(lcp: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(left, right, depth, parent's depth) of the suffix tree's internal nodes of depth ``least`` or more.

    Leaves are the sorted suffixes, ``lcp[i]`` what leaf i shares with leaf i - 1. A node is the widest range of
    leaves that share its depth; depths of parents below ``least`` read ``least`` - 1.
    """
    out, stack = [], []  # open nodes: (left, depth)
    floor = least - 1
    deep = np.flatnonzero(lcp >= least)
    last = -2
    for i, d in zip(deep.tolist(), lcp[deep].tolist(), strict=True):
        if i != last + 1:
            while stack:
                left, depth = stack.pop()
                out.append((left, last, depth, stack[-1][1] if stack else floor))
        left = i - 1
        while stack and stack[-1][1] > d:
            left, depth = stack.pop()
            out.append((left, i - 1, depth, max(d, stack[-1][1] if stack else floor)))
        if not stack or stack[-1][1] < d:
            stack.append((left, d))
        last = i
    while stack:
        left, depth = stack.pop()
        out.append((left, last, depth, stack[-1][1] if stack else floor))
    return tuple(np.array(c, dtype=np.int64) for c in zip(*out, strict=True)) if out else (np.zeros(0, np.int64),) * 4


def _by_nodes(lcp: np.ndarray, least: int, known: dict) -> np.ndarray:
    """Stretches of leaves that share ``least`` words: the node on each leaf's path where that depth is passed."""
    if known.get("of") is not lcp:
        known.update(of=lcp, nodes=internal_nodes(lcp, PLAN.gram))
    left, right, depth, above = known["nodes"]
    out = -1 - np.arange(len(lcp))  # a leaf of its own
    pick = np.flatnonzero((depth >= least) & (above < least))
    for k in pick.tolist():
        out[left[k] : right[k] + 1] = k
    return out


def _searched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    part, held = None, []
    unpack = repeats.unpack

    def out():
        e = repeats.joined([{k: v for k, v in unpack(x).items() if k != "single"} for x in held])
        e = repeats.taken(e, repeats.in_order(e))
        known: dict = {}
        return repeats.spans([repeats.repeated(PLAN, e, repeats.common_prefix(PLAN, e), lambda lcp, least: _by_nodes(lcp, least, known))])

    for b in batches:
        for p, blob, gone in zip(*(b.column(c).to_pylist() for c in ("part", "entries", "gone")), strict=True):
            if p != part and held:
                yield out()
                held = []
            part = p
            if gone:
                yield repeats.spans([unpack(gone)])
            if blob:
                held.append(blob)
    if held:
        yield out()


def _kept(with_text: bool, carry: tuple[str, ...]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for text, found in zip(b.column("text").cast(pa.binary()), repeats.doc_spans(b), strict=True):
                raw = text.as_py() or b""
                words = raw.split()  # bytes split at \x20 and \x09-\x0D only
                kept = words if found is None else list(compress(words, (~repeats.covered(len(words), PLAN.window, *found)).tolist()))
                whole = b" ".join(kept)
                kept_text = None if not with_text else (raw if len(kept) == len(words) else whole).decode("utf-8")
                out.append((len(words), len(words) - len(kept), hashlib.sha256(whole).hexdigest(), kept_text))
            cols = list(zip(*out, strict=True)) if out else [[]] * 4
            added = [pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.string()), *([pa.array(cols[3], pa.string())] if with_text else [])]
            yield pa.RecordBatch.from_arrays([b.column("rid"), *(b.column(c) for c in carry), *added], names=["rid", *carry, "n_words", "n_removed", "kept_sha256", *(["kept_text"] if with_text else [])])

    return run


def substring_dedup(docs: DataFrame, with_text: bool = False, carry: tuple[str, ...] = (), size: int = GROUP, limit: int = repeats.HOT) -> DataFrame:
    """One row for each document: doc_id, n_words, n_removed, kept_sha256, and the columns of ``carry``.

    ``size`` entries a group and ``limit`` runs of a gram that is not hot shape the work only.

    With ``with_text`` also kept_text: the kept words joined by spaces, or the text as it is if no word goes.
    """
    if clash := {"rid", "doc_id", "text", "spans", "n_words", "n_removed", "kept_sha256", "kept_text"} & set(carry):
        raise ValueError(f"carried columns have names of the result: {sorted(clash)}")
    docs, ids = with_rid(docs, carry)
    runs = stored(repeats.find_runs(docs, PLAN, limit))
    hot, total = repeats.hot_grams(runs), runs.filter(F.col("kind") == repeats.EDGE).count()
    dealt = repeats.with_edges(docs, runs).mapInArrow(_dealt(_heavy_words(runs, size), max(1, -(-total // size)), hot), "part long, entries binary, gone binary")
    found = dealt.repartition("part").sortWithinPartitions("part").mapInArrow(_searched, repeats.SPANS)
    carried = "".join(f"`{c}` {docs.schema[c].dataType.simpleString()}, " for c in carry)
    out = repeats.with_spans(docs, found).mapInArrow(_kept(with_text, carry), f"rid long, {carried}n_words long, n_removed long, kept_sha256 string" + ", kept_text string" * with_text)
    return with_doc_id(out, ids)
