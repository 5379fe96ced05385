"""Exact search for windows of tokens that also start earlier, as Spark jobs. Used for bytes and for words.

A window is ``window`` consecutive tokens of one document. The suffixes of a corpus are too many to exchange all,
so those that cannot repeat are left out, and nothing else is decided here:

1. Each window picks its smallest gram (``kernels.anchors``). Neighbouring windows with the same pick form a run;
   equal windows pick the same gram at the same place. A run whose gram stands nowhere else repeats nothing.
   Grams are counted exactly over the corpus: a task sends the first run of each gram with the number of its own,
   so a gram costs a row for each task, not for each copy.
2. Every run of a gram that occurs twice or more is one *entry*: the suffix that starts at the gram, ``window``
   tokens deep, and the tokens before it. Entries whose gram is hot (a count above ``HOT``) are cut into single
   windows, which spread by what they hold.
3. Entries are brought together by the order of their suffixes (by the caller's method). Suffixes that share
   enough, with equal tokens before them, hold equal windows: the earliest stays.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kernels

#: Runs that a task counts at once, and entries that it sorts at once.
CHUNK = 1 << 20
ENTRIES = 150_000
#: Runs of a gram from which it counts as hot, and hot grams (or heavy prefixes) that are sent to all tasks at most.
HOT = 25_000
MOST_HOT = 1_000_000
#: Tokens of one document whose windows are cut into runs at once.
PIECE = 1 << 20
EDGE, GRAM = 1, 2


@dataclass(frozen=True)
class Plan:
    """What a token is (``bytes``, or ``words`` coded as 6 bytes of their hash) and how windows are cut."""

    unit: str
    window: int
    gram: int

    @property
    def step(self) -> int:
        """Places that a run's gram can take in a window, so windows of an entry at most."""
        return self.window - self.gram + 1

    @property
    def width(self) -> int:
        return 1 if self.unit == "bytes" else 6

    def tokens(self, data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Hashed tokens and each document's first token (n + 1)."""
        if self.unit == "bytes":
            return kernels.byte_tokens(data), offs
        start, end, at = kernels.words(data, offs)
        return kernels.word_hashes(data, start, end), at

    def codes(self, data: np.ndarray, tokens: np.ndarray) -> np.ndarray:
        if self.unit == "bytes":
            return data[:, None]
        return np.ascontiguousarray(tokens.astype(">u8").view(np.uint8).reshape(-1, 8)[:, :6])


def _batch(**columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c) for c in columns.values()], names=list(columns))


def _counted(parts: list[dict]) -> pa.RecordBatch:
    """Runs of a chunk: the first of each gram with their number ``n``; later ones, surely in question, with 0, spread by document."""
    a = {k: np.concatenate([p[k] for p in parts]) for k in parts[0]}
    order = np.argsort(a["gram"], kind="stable")
    a = {k: v[order] for k, v in a.items()}
    at = np.flatnonzero(np.append(True, a["gram"][1:] != a["gram"][:-1]))
    n = np.zeros(len(order), dtype=np.int64)
    n[at] = np.diff(np.append(at, len(order)))
    gram = np.where(n > 0, a["gram"], kernels.mix(a["rid"].astype(np.uint64) + np.uint64(1)))
    return _batch(gram=gram.view(np.int64), first=a["first"].view(np.int64), rid=a["rid"], lo=a["lo"].astype(np.int32), code=(a["span"] | (a["off"] << 16)).astype(np.int32), n=n.astype(np.int32))


def _anchored(plan: Plan, tokens: np.ndarray, at: np.ndarray) -> Iterator[dict]:
    """Runs of some documents; a long one is cut into pieces that overlap by a window less one token."""
    if len(tokens) <= 2 * PIECE:
        yield kernels.anchors(tokens, at, plan.window, plan.gram)
        return
    for d in range(len(at) - 1):
        for a in range(int(at[d]), int(at[d + 1]), PIECE):
            z = min(int(at[d + 1]), a + PIECE + plan.window - 1)
            runs = kernels.anchors(tokens[a:z], np.array([0, z - a]), plan.window, plan.gram)
            yield runs | {"doc": runs["doc"] + d, "lo": runs["lo"] + (a - int(at[d])), "at": runs["at"] + a}


def _runs(plan: Plan):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for b in batches:
            rid = np.asarray(b.column("rid"))
            for first, end, data, offs in kernels.slices(b.column("text")):
                tokens, at = plan.tokens(data, offs)
                for a in _anchored(plan, tokens, at):
                    a["rid"] = rid[first:end][a.pop("doc")]
                    spot = a.pop("at")
                    a["first"] = tokens[spot] if plan.unit == "words" else np.zeros(len(spot), np.uint64)
                    held.append(a)
                    n += len(spot)
                    if n >= CHUNK:
                        yield _counted(held)
                        held, n = [], 0
        if n:
            yield _counted(held)

    return run


def _judge(batches: Iterator[pa.RecordBatch], limit: int) -> Iterator[pa.RecordBatch]:
    """Rows in order of gram: the runs of grams that occur twice or more, and a row for each gram of more than ``limit``."""
    gram, total, wait = None, 0, None  # the gram that is still open, its count, its only run so far
    names = ("rid", "lo", "code", "first")

    def out(rows, kind, n=None):
        cols = dict(zip(names, (np.concatenate(c) for c in zip(*rows, strict=True)), strict=True))
        return _batch(rid=cols["rid"], lo=cols["lo"], code=cols["code"], first=cols["first"], kind=np.full(len(cols["rid"]), kind, np.int8), n=np.zeros(len(cols["rid"]), np.int64) if n is None else n)

    def hot(grams, counts):
        z = np.zeros(len(grams), np.int32)
        return out([(grams, z, z, grams)], GRAM, counts)

    for b in batches:
        n = np.asarray(b.column("n")).astype(np.int64)
        cols = [np.asarray(b.column(c)) for c in names]
        if (sure := n == 0).any():
            yield out([tuple(c[sure] for c in cols)], EDGE)
        ask = ~sure
        g, n, cols = np.asarray(b.column("gram"))[ask], n[ask], [c[ask] for c in cols]
        if not len(g):
            continue
        at = np.flatnonzero(np.append(True, g[1:] != g[:-1]))
        totals = np.add.reduceat(n, at)
        rows = []
        if gram is not None and g[0] == gram:
            totals[0] += total
            if wait is not None:
                rows.append(wait)
        elif gram is not None and total > limit:
            yield hot(np.array([gram]), np.array([total]))
        keep = np.repeat(totals >= 2, np.diff(np.append(at, len(g))))
        rows.append(tuple(c[keep] for c in cols))
        yield out(rows, EDGE)
        closed = totals[:-1] > limit
        if closed.any():
            yield hot(g[at[:-1]][closed], totals[:-1][closed])
        gram, total = g[-1], int(totals[-1])
        wait = tuple(c[-1:] for c in cols) if total < 2 else None
    if gram is not None and total > limit:
        yield hot(np.array([gram]), np.array([total]))


def find_runs(docs: DataFrame, plan: Plan, limit: int = HOT) -> DataFrame:
    """``rid, lo, code, first, kind, n``: runs in question (EDGE; ``first``: their gram's first word), and hot grams (GRAM; rid, n)."""
    rows = docs.select("rid", "text").mapInArrow(_runs(plan), "gram long, first long, rid long, lo int, code int, n int")
    return rows.repartition("gram").sortWithinPartitions("gram").mapInArrow(lambda batches: _judge(batches, limit), "rid long, lo int, code int, first long, kind byte, n long")


def hot_grams(runs: DataFrame) -> np.ndarray:
    """Hashes of hot grams in ascending order: the ``MOST_HOT`` largest at most, so what all tasks get is bounded."""
    rows = runs.filter(F.col("kind") == GRAM).orderBy(F.col("n").desc(), "rid").limit(MOST_HOT).select("rid").toArrow()
    return np.sort(np.asarray(rows["rid"].combine_chunks()).astype(np.int64).view(np.uint64))


def with_edges(docs: DataFrame, runs: DataFrame) -> DataFrame:
    """``rid, text, edges``: documents that have runs in question, with these."""
    edges = runs.filter(F.col("kind") == EDGE).groupBy("rid").agg(F.collect_list(F.struct("lo", "code")).alias("edges"))
    return docs.select("rid", "text").join(edges, "rid")


def entries(plan: Plan, batches: Iterator[pa.RecordBatch], hot: np.ndarray) -> Iterator[dict]:
    """Entries of documents with their runs in question, ``ENTRIES`` or a few more at a time.

    ``suffix`` (n, window * width) zero-padded bytes, ``depth`` tokens in it, ``before`` (n, (step - 1) * width)
    the tokens before it, nearest first, ``rid``, ``pos`` (token where the suffix starts), ``low`` and ``high``:
    the windows in question start low..high tokens before pos; ``hot``: whether the gram is.
    """
    q, w, u = plan.step, plan.window, plan.width
    held, n = [], 0
    for b in batches:
        rid, edges = np.asarray(b.column("rid")), b.column("edges")
        cut = np.asarray(edges.offsets).astype(np.int64)
        flat = edges.values
        los, codes = np.asarray(flat.field("lo")).astype(np.int64), np.asarray(flat.field("code")).astype(np.int64)
        for first, end, data, offs in kernels.slices(b.column("text")):
            tokens, at = plan.tokens(data, offs)
            code = plan.codes(data, tokens)
            a, z = cut[first], cut[end]
            d = np.repeat(np.arange(end - first), np.diff(cut[first : end + 1]))
            lo, span, off = los[a:z], codes[a:z] & 0xFFFF, codes[a:z] >> 16
            pos, low, high = lo + off, off - span + 1, off
            begin, stop = at[d] + pos, at[d + 1]
            depth = np.minimum(stop - begin, w)
            grams = kernels.Sums(tokens).fixed(plan.gram) if len(hot) else None
            for s in range(0, len(pos), 1 << 14):
                e = slice(s, s + (1 << 14))
                idx = begin[e, None] + np.arange(w)
                inside = idx < stop[e, None]
                suffix = np.where(inside[:, :, None], code[np.minimum(idx, len(code) - 1)], 0).reshape(len(idx), w * u)
                idx = begin[e, None] - 1 - np.arange(q - 1)
                inside = np.arange(q - 1) < high[e, None]
                before = np.where(inside[:, :, None], code[np.maximum(idx, 0)], 0).reshape(len(idx), (q - 1) * u)
                is_hot = np.isin(grams[begin[e]], hot) if grams is not None else np.zeros(len(idx), bool)
                held.append({"suffix": suffix.astype(np.uint8), "depth": depth[e].astype(np.uint8), "before": before.astype(np.uint8), "rid": rid[first:end][d[e]], "pos": pos[e].astype(np.int32), "low": low[e].astype(np.uint8), "high": high[e].astype(np.uint8), "hot": is_hot})
                n += len(idx)
                if n >= ENTRIES:
                    held, n = [joined(held)], 0
                    yield held.pop()  # not held on while it is worked on
    if held:
        held = [joined(held)]
        yield held.pop()


def heads(plan: Plan, e: dict) -> np.ndarray:
    """What equal windows share of their suffixes, as fixed-width bytes: the gram, or a hot gram's single window as a whole."""
    head = e["suffix"].copy()
    if not e["single"]:
        head[:, plan.gram * plan.width :] = 0
    return np.ascontiguousarray(head).view(f"S{head.shape[1]}").ravel()


def hashed(fixed: np.ndarray) -> np.ndarray:
    """Hashes of fixed-width byte strings, ``PIECE`` bytes or less at a time: the sums take some 40 bytes a byte."""
    n, out = fixed.dtype.itemsize, np.zeros(len(fixed), np.uint64)
    rows = max(1, PIECE // n)
    for a in range(0, len(fixed), rows):
        some = np.ascontiguousarray(fixed[a : a + rows])
        at = np.arange(len(some)) * n
        out[a : a + rows] = kernels.Sums(kernels.byte_tokens(some.view(np.uint8).ravel())).ranges(at, at + n)
    return out


def split_hot(plan: Plan, e: dict, most: int = 2 * ENTRIES) -> Iterator[dict]:
    """Entries with those of hot grams cut into single windows, ``most`` at a time; ``single`` tells which.

    Very many suffixes share a gram where one passage stands in very many documents. Windows that start before it
    begin with what stands there, and those that end behind it differ in their end; those inside it are equal and
    collapse in the task.
    """
    q, w, u = plan.step, plan.window, plan.width
    is_hot = e.pop("hot")
    if not is_hot.all():
        yield (taken(e, ~is_hot) if is_hot.any() else e) | {"single": False}
    if not is_hot.any():
        return
    e = taken(e, is_hot)
    for a in range(0, len(e["depth"]), max(1, most // q)):
        part, out = taken(e, slice(a, a + max(1, most // q))), []
        for o in range(q):
            x = taken(part, (part["low"] <= o) & (o <= part["high"]))
            n = len(x["depth"])
            before = x["before"].reshape(n, q - 1, u)[:, :o][:, ::-1].reshape(n, o * u)
            out.append({"suffix": np.concatenate([before, x["suffix"][:, : (w - o) * u]], axis=1), "depth": np.full(n, w, np.uint8), "before": np.zeros_like(x["before"]), "rid": x["rid"], "pos": x["pos"] - np.int32(o), "low": np.zeros(n, np.uint8), "high": np.zeros(n, np.uint8)})
        out = [joined(out) | {"single": True}]
        yield out.pop()


def sample_entries(docs: DataFrame, runs: DataFrame, plan: Plan, share: float, hot: np.ndarray) -> list[tuple[bytes, int]]:
    """(head, weight) of about a ``share`` of the runs in question, by hash; they only balance ranges."""
    picked = (F.col("kind") == EDGE) & (F.pmod(F.xxhash64("rid", "lo"), F.lit(1 << 30)) < int(share * (1 << 30)) + 1)
    some = runs.filter(picked).groupBy("rid").agg(F.collect_list(F.struct("lo", "code")).alias("edges"))
    text = docs.select("rid", "text").join(some, "rid")

    def run(batches):
        for whole in entries(plan, batches, hot):
            for e in split_hot(plan, whole):
                every = 8 if e["single"] else 1
                head = heads(plan, e)[::every]
                yield pa.RecordBatch.from_arrays([pa.array(head.tolist(), pa.binary()), pa.array(np.full(len(head), every, np.int32))], names=["head", "weight"])

    return [(bytes(r[0]), r[1]) for r in text.mapInArrow(run, "head binary, weight int").collect()]


def pack(x) -> bytes:
    return zstandard.ZstdCompressor(level=3).compress(pickle.dumps(x, protocol=5))


def unpack(x: bytes):
    return pickle.loads(zstandard.ZstdDecompressor().decompress(x))


def joined(parts: list[dict]) -> dict:
    return {k: np.concatenate([p[k] for p in parts]) for k in parts[0]}


def taken(e: dict, at: np.ndarray) -> dict:
    """Some of the entries; what is said of all of them stays."""
    return {k: v[at] if isinstance(v, np.ndarray) else v for k, v in e.items()}


def in_order(e: dict) -> np.ndarray:
    """Order by suffix (a shorter one before those it begins), then by the rest of the entry."""
    key = np.concatenate([e["suffix"], e["depth"][:, None], e["before"], e["low"][:, None], e["high"][:, None] + 1], axis=1)
    key = np.ascontiguousarray(key).view(f"S{key.shape[1]}").ravel()
    order = np.lexsort((e["pos"], e["rid"]))
    return order[np.argsort(key[order], kind="stable")]


def common_prefix(plan: Plan, e: dict) -> np.ndarray:
    """Tokens that each suffix shares with the one before it (first: 0); ``e`` is in order."""
    n = len(e["depth"])
    out = np.zeros(n, dtype=np.int64)
    for a in range(1, n, 1 << 14):
        z = min(n, a + (1 << 14))
        differ = e["suffix"][a:z] != e["suffix"][a - 1 : z - 1]
        out[a:z] = np.where(differ.any(axis=1), differ.argmax(axis=1), differ.shape[1]) // plan.width
    if n:
        out[1:] = np.minimum(out[1:], np.minimum(e["depth"][1:], e["depth"][:-1]))
    return out


def collapse(e: dict) -> tuple[dict, list[np.ndarray]]:
    """Entries in order without later ones that equal an earlier one, and (rid, first window, windows) of those left out."""
    same = np.ones(len(e["depth"]), dtype=bool)
    for k in ("suffix", "depth", "before", "low", "high"):
        x = e[k].reshape(len(same), -1)
        same[1:] &= (x[1:] == x[:-1]).all(axis=1)
    same[:1] = False
    return taken(e, ~same), _windows(taken(e, same))


def stretches(lcp: np.ndarray, least: int) -> np.ndarray:
    """Number of the stretch of neighbours that share ``least`` tokens, for each entry."""
    return np.cumsum(lcp < least)


def _rolled(plan: Plan, e: dict, h: np.ndarray, o: int) -> np.ndarray:
    """``h``, the hash of the nearest o - 1 tokens before each suffix, carried on by the next one."""
    for k in range((o - 1) * plan.width, o * plan.width):
        h = kernels.mix(h + e["before"][:, k] + np.uint64(0x9E3779B97F4A7C15))
    return h


def _whole(plan: Plan, e: dict, lcp: np.ndarray, stretches) -> tuple[np.ndarray, np.ndarray]:
    """Marks entries that equal an earlier one as a whole, and the order's prefixes without them."""
    before = np.ascontiguousarray(e["before"]).view(f"S{e['before'].shape[1]}").ravel()
    stretch = stretches(lcp, plan.window)
    shared = np.ones(len(lcp), dtype=bool)
    shared[1:] = stretch[1:] != stretch[:-1]
    shared = ~shared
    shared[:-1] |= shared[1:]
    some = np.flatnonzero(shared)
    later = np.zeros(len(lcp), dtype=bool)
    if len(some):
        _, text = np.unique(before[some], return_inverse=True)
        key = (text.astype(np.int64) << 16) | (e["low"][some].astype(np.int64) << 8) | e["high"][some]
        order = np.lexsort((e["pos"][some], e["rid"][some], key, stretch[some]))
        same = (stretch[some][order][1:] == stretch[some][order][:-1]) & (key[order][1:] == key[order][:-1])
        later[some[order[1:][same]]] = True
    kept = np.flatnonzero(~later)
    return later, np.minimum.reduceat(lcp[: kept[-1] + 1], np.append(0, kept[:-1] + 1)) if len(kept) else lcp[:0]


def repeated(plan: Plan, e: dict, lcp: np.ndarray, stretches=stretches) -> list[np.ndarray]:
    """(rid, first window, windows) of windows with an earlier equal one among the entries, which are in order with ``lcp``."""
    w = plan.window
    if not len(lcp):
        return [np.zeros(0, np.int64)] * 3
    later, lcp = _whole(plan, e, lcp, stretches)
    gone, e = taken(e, later), taken(e, ~later)
    found = []
    h = np.zeros(len(lcp), np.uint64)
    for o in range(int(e["high"].max(initial=0)) + 1):
        if o:
            h = _rolled(plan, e, h, o)
        near = lcp >= w - o
        near[:-1] |= near[1:]
        has = near & (e["low"] <= o) & (o <= e["high"])
        if np.count_nonzero(has) < 2:
            continue
        stretch, tail = stretches(lcp, w - o)[has], h[has]
        rid, start = e["rid"][has], e["pos"][has].astype(np.int64) - o
        order = np.lexsort((start, rid, tail, stretch))
        same = (stretch[order][1:] == stretch[order][:-1]) & (tail[order][1:] == tail[order][:-1])
        at = order[1:][same]
        found.append((rid[at], start[at]))
    rid, start = (np.concatenate(c) for c in zip(*found, strict=True)) if found else (np.zeros(0, np.int64),) * 2
    order = np.lexsort((start, rid))
    rid, start = rid[order], start[order]
    new = np.ones(len(rid), dtype=bool)
    new[1:] = (rid[1:] != rid[:-1]) | (start[1:] != start[:-1] + 1)
    at = np.flatnonzero(new)
    ends = _windows(gone)
    return [np.concatenate(c) for c in zip([rid[at], start[at], np.diff(np.append(at, len(rid)))], ends, strict=True)]


def _windows(e: dict) -> list[np.ndarray]:
    """(rid, first window, windows) of entries."""
    return [e["rid"], e["pos"].astype(np.int64) - e["high"], e["high"].astype(np.int64) - e["low"] + 1]


def spans(parts: list[list[np.ndarray]]) -> pa.RecordBatch:
    rid, lo, n = (np.concatenate(c).astype(np.int64) for c in zip(*parts, strict=True)) if parts else (np.zeros(0, np.int64),) * 3
    return _batch(rid=rid, lo=lo.astype(np.int32), n=n.astype(np.int32))


SPANS = "rid long, lo int, n int"


def with_spans(docs: DataFrame, found: DataFrame) -> DataFrame:
    """All documents, with the runs of window starts that repeat as ``spans`` (null: none)."""
    return docs.join(found.groupBy("rid").agg(F.collect_list(F.struct("lo", "n")).alias("spans")), "rid", "left")


def covered(length: int, window: int, lo: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Mask of the tokens that repeated windows cover."""
    edge = np.zeros(length + 1, dtype=np.int32)
    np.add.at(edge, lo, 1)
    np.add.at(edge, lo + n - 1 + window, -1)
    return np.cumsum(edge[:-1]) > 0


def doc_spans(b: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray] | None]:
    col = b.column("spans")
    at, valid = np.asarray(col.offsets).astype(np.int64), np.asarray(col.is_valid())
    lo, n = (np.asarray(col.values.field(k)).astype(np.int64) for k in ("lo", "n"))
    for i in range(len(col)):
        yield (lo[at[i] : at[i + 1]], n[at[i] : at[i + 1]]) if valid[i] and at[i + 1] > at[i] else None
