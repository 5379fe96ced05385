"""LM scoring: Brown class-based n-grams.

P(text) is the product over its tokens of P(class | class before) * P(token | its class). Exchange clustering moves
words between classes while the likelihood of the class bigrams grows; every word of the training documents is an item.
The number of classes grows with the cube root of the number of words. It goes in three steps:

1. The ``ITEMS`` most frequent words, one by one, beside items of word ends (the last two bytes).
2. The ``COMMON`` most frequent words, in rounds over all training texts: half of them (by hash) move at once to their
   best class. Their classes are sent along, a table of fixed size; all other words have the class of their end as yet.
   A round that lowers the likelihood is undone.
3. Every other word, from its common neighbours over all training texts: it moves to its best class; words seen less
   than ``SURE`` times for a clear gain only.

Class transitions and emissions come from counts over all training documents with the final classes of all words:
transitions with 0.1 added to each count, emissions add-one smoothed within each class. A word that was never seen takes
the class of its end and has the mass of one occurrence in it.

Counts of words are exact and cover every training document: tasks count their words by hash, the counts are
summed by key. The counts and classes of the ``COMMON`` most frequent words are sent along, a table of fixed size. Those
of all other words come back by an equi-join with the distinct words of each chunk of encoded texts; chunks then meet
their answers, and the class of each token is stored once, for the counts of transitions and for the scores.

Defined results: null, empty and blank texts hold the end token only; a null doc_id counts as the empty id in
the split; ties between classes go to the smaller number; a very long text is handled slice by slice (about 60 bytes
of memory a byte) and is a chunk with its distinct words; repeated rows each keep their row; with no training document every count is 0; an empty table gives an
empty result; other columns are left out.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kernels
from .common import dropped, stored

#: Frequent words that are clustered first, items of word ends, least number of classes, and words whose counts are sent along.
ITEMS, ENDS, CLASSES, COMMON = 512, 127, 32, 32_768
#: Sweeps over the first items, rounds over the common words.
SWEEPS, ROUNDS = 12, 4
#: Blocks of items in which tasks send their counts.
BUCKETS = 256
#: Occurrences from which any gain moves a word, and the gain (in nats) that a rarer one must have.
SURE, MARGIN = 3, 6.0
_END = np.uint64(0x0123456789ABCDEF)
_FLUSH = 1 << 21
#: Tokens of a chunk of encoded texts, about, and what it gets back for a word.
CHUNK = 1 << 21
_ANSWER = np.dtype([("word", np.int64), ("n", np.int64), ("g", np.int16)])


def train_row(modulus: int = 7, held_out: int = 2):
    return (F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))) % modulus) != held_out


def _tokens(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]]:
    """(first row, end row, token hashes with an end after each document, word-end group of each token, offsets)."""
    for first, end, data, offs in kernels.slices(column):
        data = kernels.lowered(data)
        start, stop, at = kernels.words(data, offs)
        h = kernels.word_hashes(data, start, stop)
        tail = data[stop - 1].astype(np.int64) + 256 * np.where(stop - start > 1, data[np.maximum(stop - 2, 0)], 0).astype(np.int64)
        group = (tail * 40503 >> 4) % ENDS if len(tail) else tail
        places = at[1:]  # an end goes in behind each document's last word
        yield first, end, np.insert(h, places, _END), np.insert(group, places, ENDS), at + np.arange(len(at))


def _sums(parts: list[tuple]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    h, g, n = (np.concatenate(c) for c in zip(*parts, strict=True))
    order = np.argsort(h, kind="stable")
    h, g, n = h[order], g[order], n[order]
    at = np.flatnonzero(np.append(True, h[1:] != h[:-1]))
    return h[at], g[at], np.add.reduceat(n, at)


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held, size = [], 0

    def out():
        h, g, n = _sums(held)
        return pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(g.astype(np.int16)), pa.array(n)], names=["word", "tail", "n"])

    for b in batches:
        for _, _, h, g, _ in _tokens(b.column("text")):
            if len(h):
                held.append(_sums([(h, g, np.ones(len(h), np.int64))]))
                size += len(held[-1][0])
            if size >= _FLUSH:
                held = [_sums(held)]
                size = len(held[0][0])
                if size >= _FLUSH // 2:
                    yield out()
                    held, size = [], 0
    if held:
        yield out()


def word_counts(docs: DataFrame) -> DataFrame:
    """``word`` (hash), ``tail`` (group of its last two bytes) and ``n`` over all texts, ends included."""
    rows = docs.select("text").mapInArrow(_counted, "word long, tail short, n long")
    return rows.groupBy("word").agg(F.min("tail").alias("tail"), F.sum("n").alias("n"))


def _items(words: np.ndarray, own: np.ndarray, tails: np.ndarray) -> np.ndarray:
    """Item of each token: its place among ``own`` (sorted hashes), else the item of its word end; the end token is last."""
    at = np.minimum(np.searchsorted(own, words), max(0, len(own) - 1))
    out = len(own) + tails.astype(np.int64)
    if len(own):
        hit = own[at] == words
        out[hit] = at[hit]
    out[words == _END] = len(own) + ENDS
    return out


def _encoded(common: np.ndarray):
    """The tokens of each slice of texts as packed arrays, so that nothing later need read and hash words again.

    ``code`` (16 bits a token): the place among the common words, else ``len(common)`` + the group of the word's end.
    ``rare``: hashes of the tokens that are not common, in their order. ``rids`` and ``at``: the documents and where each
    begins. ``train`` tells slices of training documents from others; ``part`` numbers the chunks of a task.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, size = 0, 0
        for whole in batches:
            for train in (True, False):
                b = whole.filter(whole.column("train") if train else pc.invert(whole.column("train")))
                rid = np.asarray(b.column("rid"))
                for first, end, h, g, at in _tokens(b.column("text")):
                    spot, hit = _found(common, h)
                    code = np.where(hit, spot, len(common) + g.astype(np.int64)).astype(np.uint16)
                    row = {"part": part, "train": train, "rids": _packed(rid[first:end]), "at": _packed(at), "code": _packed(code), "rare": _packed(h[~hit])}
                    yield pa.RecordBatch.from_pylist([row], _ENCODED)
                    size += len(h)
                    if size >= CHUNK:
                        part, size = part + 1, 0

    return run


_ENCODED = pa.schema([("part", pa.int64()), ("train", pa.bool_()), *((c, pa.binary()) for c in ("rids", "at", "code", "rare"))])


def encoded(docs: DataFrame, common: np.ndarray) -> DataFrame:
    """Encoded slices of documents (rid, text, train) with the number of their ``chunk``, stored."""
    out = docs.select("rid", "text", "train").mapInArrow(_encoded(common), "part long, train boolean, rids binary, at binary, code binary, rare binary")
    return stored(out.withColumn("chunk", F.shiftleft(F.spark_partition_id().cast("long"), 24) + F.col("part")).drop("part"))


def _codes(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray | None]]:
    """(codes, hashes of the rare tokens, where they are read) of each slice."""
    for b in batches:
        rare = b.column("rare") if "rare" in b.schema.names else [None] * b.num_rows
        for code, r in zip(b.column("code"), rare, strict=True):
            yield _opened(code.as_py(), np.uint16).astype(np.int64), None if r is None else _opened(r.as_py(), np.int64)


def _bigrams(item_of: np.ndarray, kinds: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = np.zeros(kinds * kinds, dtype=np.int64)
        for code, _ in _codes(batches):
            item = item_of[code]
            before = np.append(kinds - 1, item[:-1])  # every document ends in the end token, which so begins the next
            table += np.bincount(before * kinds + item, minlength=len(table))
        code = np.flatnonzero(table)
        yield pa.RecordBatch.from_arrays([pa.array(code), pa.array(table[code])], names=["code", "n"])

    return run


def exchange(table: np.ndarray, classes: int = CLASSES, sweeps: int = SWEEPS) -> np.ndarray:
    """Classes of items from their bigram counts; the last item keeps a class of its own.

    Items start in classes by frequency; each in turn moves to the class where the sum of n log n over class
    bigrams less that over the margins is largest, until a sweep moves none.
    """
    kinds = len(table)
    table = table.astype(float)
    total = table.sum(0) + table.sum(1)
    order = np.argsort(-total, kind="stable")
    of = np.zeros(kinds, dtype=np.int64)
    of[order] = np.arange(kinds) % (classes - 1)
    of[kinds - 1] = classes - 1
    f = lambda x: x * np.log(np.maximum(x, 1e-300))
    hot = np.eye(classes)
    grid = hot[of].T @ table @ hot[of]
    out, into = grid.sum(1), grid.sum(0)
    for _ in range(sweeps):
        moved = 0
        for i in order.tolist():
            if i == kinds - 1 or not total[i]:
                continue
            g, self_n = of[i], table[i, i]
            row = np.bincount(of, weights=table[i], minlength=classes)
            col = np.bincount(of, weights=table[:, i], minlength=classes)
            row[g] -= self_n
            col[g] -= self_n
            # without the item
            grid[g] -= row
            grid[:, g] -= col
            grid[g, g] -= self_n
            n_out, n_in = row.sum() + self_n, col.sum() + self_n
            out[g] -= n_out
            into[g] -= n_in
            gain = (f(grid + row) - f(grid)).sum(1) + (f(grid + col[:, None]) - f(grid)).sum(0)
            d = np.diag(grid)  # the diagonal takes both parts and the item's own pair
            gain += f(d + row + col + self_n) - f(d) - (f(d + row) - f(d)) - (f(d + col) - f(d))
            gain -= f(out + n_out) - f(out) + f(into + n_in) - f(into)
            gain[classes - 1] = -np.inf
            best = int(np.argmax(gain))
            if gain[best] <= gain[g] + 1e-9:
                best = int(g)
            moved += best != g
            of[i] = best
            grid[best] += row
            grid[:, best] += col
            grid[best, best] += self_n
            out[best] += n_out
            into[best] += n_in
        if not moved:
            break
    return of


def _found(table: np.ndarray, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Place of each word in a sorted table, and whether it is there."""
    if not len(table):
        return np.zeros(len(words), np.int64), np.zeros(len(words), bool)
    at = np.minimum(np.searchsorted(table, words), len(table) - 1)
    return at, table[at] == words


def _f(x: np.ndarray) -> np.ndarray:
    return x * np.log(np.maximum(x, 1e-300))


def best_classes(own: np.ndarray, row: np.ndarray, col: np.ndarray, alone: np.ndarray, grid: np.ndarray, rare: np.ndarray | None = None) -> np.ndarray:
    """The class that each item would move to, all others as they are: the rule of ``exchange`` for many items.

    ``own``: class of each item; ``row``, ``col``: its counts by class behind and before it, without ``alone``, its pairs
    with itself. The last class takes none.
    """
    every, classes = np.arange(len(own)), len(grid)
    out, into = grid.sum(1), grid.sum(0)
    gain = np.zeros((len(own), classes))
    stay = np.zeros(len(own))
    for counts, table, across in ((row, grid, col), (col, grid.T, row)):
        i, c = np.nonzero(counts)
        if not len(i):
            continue
        m = counts[i, c]
        at_home = c == own[i]
        part = np.empty((len(i), classes))
        once = (m == 1) & ~at_home  # most counts of rare words: looked up
        if once.any():
            part[once] = (_f(table + 1) - _f(table)).T[c[once]]
        k = np.flatnonzero(~once)
        base = table[:, c[k]].T
        # what stands between class j and the item's own class loses the item's part
        base = np.where(at_home[k][:, None], base - across[i[k]], base)
        part[k] = _f(base + m[k][:, None]) - _f(base)
        cut = np.flatnonzero(np.append(True, i[1:] != i[:-1]))
        gain[i[cut]] += np.add.reduceat(part, cut, axis=0)
        # the same for the class it is in, from which it is taken
        here = table[own[i], c]
        stay += np.bincount(i, weights=np.where(at_home, 0.0, _f(here) - _f(here - m)), minlength=len(own))
    i, c = np.nonzero((row > 0) | (col > 0))
    d, r, q = grid[c, c], row[i, c], col[i, c]
    gain[i, c] += _f(d + r + q) - _f(d + r) - _f(d + q) + _f(d)
    i = np.flatnonzero(alone > 0)
    d = np.diag(grid)[None, :] + row[i] + col[i]
    gain[i] += _f(d + alone[i][:, None]) - _f(d)
    n_out, n_in = row.sum(1) + alone, col.sum(1) + alone
    for n, margin in ((n_out, out), (n_in, into)):
        kinds, of = np.unique(n, return_inverse=True)
        gain -= (_f(margin[None, :] + kinds[:, None]) - _f(margin))[of]
    # the class it is in
    home = grid[own, own]
    stay += _f(home) - _f(home - row[every, own] - col[every, own] - alone)
    stay -= _f(out[own]) - _f(out[own] - n_out) + _f(into[own]) - _f(into[own] - n_in)
    if rare is not None:  # many move at once: an empty class would look best to each of them
        gain[:, out + into == 0] = -np.inf
    gain[every, own] = stay
    gain[:, -1] = -np.inf
    best = gain.argmax(1)
    # a word seen once or twice fits many a class by chance: it leaves its own for a clear gain only
    return np.where(gain[every, best] > stay + np.where(n_out < SURE if rare is None else rare, MARGIN, 1e-9), best, own)


def _class_of(model: dict) -> np.ndarray:
    """Class of each code: common words have their own, others that of their end."""
    return np.concatenate([model["g"], model["ends"]]).astype(np.int64)


def _tally(rows: Iterator[np.ndarray], fields: list[str]) -> Iterator[pa.RecordBatch]:
    """Rows of int64 columns counted in chunks: the columns and ``n``."""
    held, size = [], 0

    def out():
        x = np.concatenate(held)
        key = x[:, 0].astype(np.uint64)
        for k in range(1, x.shape[1]):
            key = kernels.mix(key + np.uint64(k)) + x[:, k].astype(np.uint64)
        order = np.argsort(key)  # equal rows stand together; should two rows share a key, they may be counted in parts
        x = x[order]
        at = np.flatnonzero(np.append(True, (x[1:] != x[:-1]).any(axis=1)))
        n = np.diff(np.append(at, len(x)))
        return pa.RecordBatch.from_arrays([*(pa.array(np.ascontiguousarray(x[at, k])) for k in range(x.shape[1])), pa.array(n)], names=[*fields, "n"])

    for x in rows:
        if len(x):
            held.append(x)
            size += len(x)
        if size >= _FLUSH:
            yield out()
            held, size = [], 0
    if size:
        yield out()


def _contexts(model: dict):
    """Counts of what is behind and before each common word, as a table of the task cut into ``BUCKETS`` blocks of items.

    A row of the table: counts by class behind, by class before, and by its class beside itself. Items are the common
    words by place; what is behind the other words counts for the item ``len(common)`` + class.
    """
    classes, common = model["classes"], len(model["common"])
    width, items, of = 3 * classes, common + classes, _class_of(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = np.zeros(items * width, np.int32)
        for code, _ in _codes(batches):
            cls = of[code]
            hit = code < common
            item = np.where(hit, code, common + cls)
            # a class's own row needs no pairs of equal words apart: only common words move
            same = np.append(False, (code[1:] == code[:-1]) & hit[1:])
            # every document ends in the end token, which so begins the next
            before, ahead = np.append(classes - 1, cls[:-1]), np.append(common + classes - 1, item[:-1])
            k, j = np.flatnonzero(hit & ~same), np.flatnonzero(~same)
            np.add.at(table, np.concatenate([item[k] * width + classes + before[k], ahead[j] * width + cls[j]]), np.int32(1))
            k = np.flatnonzero(same)
            np.add.at(table, item[k] * width + 2 * classes + cls[k], np.int32(1))
        size = -(-items // BUCKETS) * width
        blocks = [table[a : a + size] for a in range(0, len(table), size)]
        rows = [(k, _packed(x)) for k, x in enumerate(blocks) if x.any()]
        yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.binary())], names=["bucket", "block"])

    return run


def _packed(x: np.ndarray) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(x.tobytes())


def _opened(x: bytes, kind) -> np.ndarray:
    return np.frombuffer(zstandard.ZstdDecompressor().decompress(x), kind)


def _summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Blocks in order of bucket: one for each, summed."""
    bucket, total = None, None

    def out():
        return pa.RecordBatch.from_arrays([pa.array([bucket], pa.int32()), pa.array([_packed(total)], pa.binary())], names=["bucket", "block"])

    for b in batches:
        for k, x in zip(b.column("bucket").to_pylist(), b.column("block"), strict=True):
            if k != bucket:
                if total is not None:
                    yield out()
                bucket, total = k, 0
            total = total + _opened(x.as_py(), np.int32).astype(np.int64)
    if total is not None:
        yield out()


def _rare_contexts(model: dict):
    """Counts of (item, code) of all but the common words, by hash; codes as the columns of ``_contexts``.

    Only neighbours of known class tell something: common words and the end.
    """
    classes, common, of = model["classes"], len(model["common"]), _class_of(model)

    def codes(batches):
        for code, rare in _codes(batches):
            hit, cls = code < common, of[code]
            item, before = np.zeros(len(code), np.int64), np.append(classes - 1, cls[:-1])
            item[~hit] = rare
            k = np.flatnonzero(~hit & np.append(True, hit[:-1]))
            yield np.stack([item[k], classes + before[k]], 1)
            k = np.flatnonzero(~hit[:-1] & hit[1:])
            yield np.stack([item[k], cls[k + 1]], 1)

    def run(batches):
        for b in _tally(codes(batches), ["item", "code"]):
            yield pa.RecordBatch.from_arrays([b.column("item"), b.column("code").cast(pa.int32()), b.column("n")], names=["item", "code", "n"])

    return run


def _moves(grid: np.ndarray):
    classes = len(grid)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first in range(0, batch.num_rows, 512):
                b = batch.slice(first, 512)
                item, own, lists, rare = np.asarray(b.column("item")), np.asarray(b.column("g")).astype(np.int64), b.column("seen"), np.asarray(b.column("occurs")) < SURE
                i = np.repeat(np.arange(len(item)), np.asarray(lists.value_lengths()))
                seen = lists.flatten()
                table = np.zeros((len(item), 3 * classes))
                table[i, np.asarray(seen.field("code"))] = np.asarray(seen.field("n"))
                new = best_classes(own, table[:, :classes], table[:, classes : 2 * classes], table[:, 2 * classes :].sum(1), grid, rare)
                moved = np.flatnonzero(new != own)
                yield pa.RecordBatch.from_arrays([pa.array(item[moved]), pa.array(new[moved].astype(np.int32))], names=["item", "to"])

    return run


def _likelihood(grid: np.ndarray) -> float:
    return float(_f(grid).sum() - _f(grid.sum(0)).sum() - _f(grid.sum(1)).sum())


def _cells(seen: DataFrame, model: dict) -> np.ndarray:
    """Class bigrams from the counts of what is behind each item."""
    classes, g = model["classes"], np.append(model["g"], np.arange(model["classes"]))
    size = -(-len(g) // BUCKETS)

    def run(batches):  # summed by class in the task: at most the square of the classes a task
        part = np.zeros((classes, classes), np.int64)
        for b in batches:
            for k, x in zip(b.column("bucket").to_pylist(), b.column("block"), strict=True):
                table = _opened(x.as_py(), np.int64).reshape(-1, 3 * classes)
                np.add.at(part, g[k * size : k * size + len(table)], table[:, :classes] + table[:, 2 * classes :])
        i, j = np.nonzero(part)
        yield pa.RecordBatch.from_arrays([pa.array(i), pa.array(j), pa.array(part[i, j])], names=["i", "j", "n"])

    grid = np.zeros((classes, classes))
    for r in seen.mapInArrow(run, "i long, j long, n long").groupBy("i", "j").agg(F.sum("n").alias("n")).collect():
        grid[r.i, r.j] = r.n
    return grid


def cluster_common(coded: DataFrame, model: dict, rounds: int = ROUNDS) -> tuple[dict, np.ndarray]:
    """``model`` with the classes ``g`` of the common words after rounds of exchange, and the class bigrams."""
    best, classes, size = None, model["classes"], -(-(len(model["common"]) + model["classes"]) // BUCKETS)
    for k in range(rounds + 1):
        seen = stored(coded.select("code").mapInArrow(_contexts(model), "bucket int, block binary").repartition("bucket").sortWithinPartitions("bucket").mapInArrow(_summed, "bucket int, block binary"))
        grid = _cells(seen, model)
        if best and _likelihood(grid) < _likelihood(best[1]):
            return best  # the last round made it worse
        best = model, grid
        if k == rounds:
            return best
        g = model["g"]

        def moved(batches, g=g, grid=grid, k=k):
            for b in batches:
                for bucket, x in zip(b.column("bucket").to_pylist(), b.column("block"), strict=True):
                    table = _opened(x.as_py(), np.int64).reshape(-1, 3 * classes).astype(float)
                    item = np.arange(bucket * size, bucket * size + len(table))
                    item = item[item < len(g)]
                    item = item[(kernels.mix(item.astype(np.uint64)) % np.uint64(2) == np.uint64(k % 2)) & (g[item] != classes - 1)]
                    for a in range(0, len(item), 512):
                        i = item[a : a + 512]
                        t = table[i - bucket * size]
                        new = best_classes(g[i], t[:, :classes], t[:, classes : 2 * classes], t[:, 2 * classes :].sum(1), grid)
                        at = np.flatnonzero(new != g[i])
                        yield pa.RecordBatch.from_arrays([pa.array(i[at]), pa.array(new[at].astype(np.int32))], names=["item", "to"])

        moves = seen.mapInArrow(moved, "item long, to int").toArrow()  # a row for each common word at most
        dropped(seen)
        g = g.copy()
        g[np.asarray(moves["item"].combine_chunks())] = np.asarray(moves["to"].combine_chunks())
        model = model | {"g": g}
    return best


def _asked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The distinct words of each chunk that are not common."""
    chunk, held = None, []

    def out():
        word = np.unique(np.concatenate(held))
        return pa.RecordBatch.from_arrays([pa.array(np.full(len(word), chunk)), pa.array(word)], names=["chunk", "word"])

    for b in batches:
        for k, rare in zip(b.column("chunk").to_pylist(), b.column("rare"), strict=True):
            if k != chunk and held:
                yield out()
                held = []
            chunk = k
            held.append(np.unique(_opened(rare.as_py(), np.int64)))
    if held:
        yield out()


def _answered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (chunk, word, n, g) packed by chunk."""
    held, size = [], 0

    def out():
        chunk, word, n, g = (np.concatenate(c) for c in zip(*held, strict=True))
        order = np.argsort(chunk, kind="stable")
        rows = np.empty(len(order), _ANSWER)
        rows["word"], rows["n"], rows["g"] = word[order], n[order], g[order]
        chunk = chunk[order]
        at = np.flatnonzero(np.append(True, chunk[1:] != chunk[:-1]))
        blobs = [_packed(rows[a:z]) for a, z in zip(at.tolist(), np.append(at[1:], len(rows)).tolist(), strict=True)]
        return pa.RecordBatch.from_arrays([pa.array(chunk[at]), pa.array(blobs, pa.binary())], names=["chunk", "answer"])

    for b in batches:
        if b.num_rows:
            held.append(tuple(np.asarray(b.column(c)) for c in ("chunk", "word", "n", "g")))
            size += b.num_rows
        if size >= _FLUSH:
            yield out()
            held, size = [], 0
    if held:
        yield out()


def _classed(model: dict):
    """Slices in order of chunk, behind the chunk's answers: the class of each token, and sums of each document.

    ``logs``: the sum of log10(count + 1); ``known``: tokens that are known.
    """
    common, common_n, of = len(model["common"]), model["common_n"], _class_of(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunk, held, known = None, [], None
        for b in batches:
            for k, row in zip(b.column("chunk").to_pylist(), range(b.num_rows), strict=True):
                if k != chunk:
                    chunk, held, known = k, [], None
                get = lambda c, kind, b=b, row=row: _opened(b.column(c)[row].as_py(), kind)
                if b.column("answer")[row].is_valid:
                    held.append(get("answer", _ANSWER))
                    continue
                if known is None:
                    known = np.concatenate(held) if held else np.zeros(0, _ANSWER)
                    known = known[np.argsort(known["word"], kind="stable")]
                    word, n, g = (np.ascontiguousarray(known[c]) for c in ("word", "n", "g"))
                    held = []
                code, rare, at = get("code", np.uint16).astype(np.int64), get("rare", np.int64), get("at", np.int64)
                cls, hit, count = of[code], code < common, np.zeros(len(code), np.int64)
                count[hit] = common_n[code[hit]]
                spot, met = _found(word, rare)
                ask = np.flatnonzero(~hit)[met]
                cls[ask], count[ask] = g[spot[met]], n[spot[met]]
                packed = [get("rids", np.int64), at, cls.astype(np.uint16), np.add.reduceat(np.log10(count + 1.0), at[:-1]), np.add.reduceat((count > 0).astype(np.int64), at[:-1])]
                yield pa.RecordBatch.from_arrays([pa.array([b.column("train")[row].as_py()]), *(pa.array([_packed(x)], pa.binary()) for x in packed)], names=["train", "rids", "at", "cls", "logs", "known"])

    return run


def classed(coded: DataFrame, words: DataFrame, model: dict) -> DataFrame:
    """Slices with the class of each token, stored; ``words``: word, n, g of all but the common words."""
    answers = coded.select("chunk", "rare").mapInArrow(_asked, "chunk long, word long").join(words, "word").select("chunk", "word", "n", F.col("g").cast("short").alias("g"))
    answers = answers.mapInArrow(_answered, "chunk long, answer binary")
    both = coded.withColumn("answer", F.lit(None).cast("binary")).unionByName(answers, allowMissingColumns=True)
    both = both.repartition("chunk").sortWithinPartitions("chunk", F.col("answer").isNull())
    return stored(both.mapInArrow(_classed(model), "train boolean, rids binary, at binary, cls binary, logs binary, known binary"))


def _steps(b: pa.RecordBatch, row: int, classes: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(class before, class, where each document begins) of a slice; before a document stands the end."""
    at, cls = _opened(b.column("at")[row].as_py(), np.int64), _opened(b.column("cls")[row].as_py(), np.uint16).astype(np.int64)
    before = np.append(classes - 1, cls[:-1])
    before[at[:-1]] = classes - 1
    return before, cls, at


def _transitions(classes: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = np.zeros(classes * classes, np.int64)
        for b in batches:
            for row in range(b.num_rows):
                before, cls, _ = _steps(b, row, classes)
                table += np.bincount(before * classes + cls, minlength=len(table))
        code = np.flatnonzero(table)
        yield pa.RecordBatch.from_arrays([pa.array(code), pa.array(table[code])], names=["code", "n"])

    return run


def _scored(step: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for row in range(b.num_rows):
                before, cls, at = _steps(b, row, len(step))
                rid, logs, known = (_opened(b.column(c)[row].as_py(), t) for c, t in (("rids", np.int64), ("logs", float), ("known", np.int64)))
                path = np.add.reduceat(step[before, cls], at[:-1])
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in (rid, np.diff(at), known, logs, path)], names=["rid", "n_tokens", "n_known", "logs", "path"])

    return run


def fit(train: DataFrame, counts: DataFrame) -> dict:
    """Classes of all words and smoothed tables of training documents."""
    return _fitted(train.select(F.lit(0).cast("long").alias("rid"), "text", F.lit(True).alias("train")), counts)[0]


def _fitted(docs: DataFrame, counts: DataFrame, last: bool = False) -> tuple[dict, DataFrame]:
    """The model of the documents marked ``train``, and all documents in slices with the class of each token.

    The driver holds the common words, the first items and the class bigrams. ``last``: nobody needs the counts any more.
    """
    spark = docs.sparkSession
    total = counts.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.count(F.lit(1)).alias("v")).first()
    classes = max(CLASSES, math.ceil(total["v"] ** (1 / 3)))
    top = counts.orderBy(F.col("n").desc(), "word").limit(COMMON).toArrow()
    words, n, tails = np.asarray(top["word"].combine_chunks()).astype(np.int64).view(np.uint64), np.asarray(top["n"].combine_chunks()).astype(np.int64), np.asarray(top["tail"].combine_chunks()).astype(np.int64)
    own = np.sort(words[np.argsort(-n, kind="stable")][: ITEMS + 1])
    own = own[own != _END][:ITEMS]
    order = np.argsort(words)
    common, common_n, tails = words[order], n[order], tails[order]
    coded = encoded(docs, common)
    train = coded.filter("train")
    kinds = len(own) + ENDS + 1
    item_of = np.concatenate([_items(common, own, tails), len(own) + np.arange(ENDS + 1)])
    table = np.zeros(kinds * kinds)
    for r in train.select("code").mapInArrow(_bigrams(item_of, kinds), "code long, n long").groupBy("code").agg(F.sum("n").alias("n")).collect():
        table[r.code] = r.n
    of = exchange(table.reshape(kinds, kinds), classes)
    ends = of[len(own) :]
    # first classes: those of the first items; rare words that of their end; others all over, or all would move alike
    at, first = _found(own, common)
    g = np.where(common_n < SURE, ends[tails], (kernels.mix(common) % np.uint64(classes - 1)).astype(np.int64))
    g = np.where(first, of[at] if len(own) else 0, g)
    g[common == _END] = classes - 1
    model, grid = cluster_common(train, {"common": common, "g": g.astype(np.int64), "ends": ends, "classes": classes})
    # every other word by its neighbours
    ends_of = lambda tail: F.element_at(F.array(*[F.lit(int(x)) for x in ends]), tail.cast("int") + 1)
    near = spark.createDataFrame(pa.table({"word": pa.array(common.view(np.int64)), "near": pa.array(model["g"].astype(np.int32))}))
    every = counts.join(F.broadcast(near), "word", "left").withColumn("g", F.coalesce("near", ends_of(F.col("tail"))).cast("int"))
    rest = train.select("code", "rare").mapInArrow(_rare_contexts(model), "item long, code int, n long").repartition("item").groupBy("item", "code").agg(F.sum("n").alias("n"))
    rest = rest.groupBy(F.col("item").alias("word")).agg(F.collect_list(F.struct("code", "n")).alias("seen")).join(every.filter("near is null").select("word", "g", F.col("n").alias("occurs")), "word")
    moved = rest.select(F.col("word").alias("item"), "g", "occurs", "seen").mapInArrow(_moves(grid), "item long, to int").withColumnRenamed("item", "word")
    every = stored(every.join(moved, "word", "left").select("word", "n", "near", F.coalesce("to", "g").alias("g")))
    if last:
        dropped(counts)
    # class bigrams of all neighbours, with the classes that the words have now
    slices = classed(coded, every.filter("near is null").select("word", "n", "g"), model | {"common_n": common_n})
    dropped(coded)  # nothing that follows is computed from it
    grid = np.zeros(classes * classes)
    for r in slices.filter("train").select("at", "cls").mapInArrow(_transitions(classes), "code long, n long").groupBy("code").agg(F.sum("n").alias("n")).collect():
        grid[r.code] = r.n  # a row for each pair of classes at most
    grid = grid.reshape(classes, classes)
    step = np.log10((grid + 0.1) / (grid.sum(1, keepdims=True) + 0.1 * classes))
    # tokens and distinct words of each class
    mass, kinds_in = np.zeros(classes), np.zeros(classes)
    for r in every.groupBy("g").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("v")).collect():
        mass[r.g], kinds_in[r.g] = r.n, r.v
    # log10 P(token | class) is log10(count + 1) less the class's denominator, which joins the transition into it
    step = step - np.log10(mass + kinds_in + 1.0)[None, :]
    fitted = {
        "own": common, "common": common, "common_n": common_n, "class_of": np.concatenate([model["g"], ends]).astype(np.int64), "step": step, "n": int(total["n"]), "v": int(total["v"]),
        "words": every.select("word", F.col("n").alias("c"), F.col("g").alias("of")),
    }
    return fitted, slices


def score_corpus(docs: DataFrame) -> DataFrame:
    """One row for each document: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, perplexity."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    odd = docs.groupBy("doc_id").count().filter("count > 1 or doc_id is null or doc_id < 0").limit(1).count()
    docs = stored(docs.withColumn("rid", F.monotonically_increasing_id())) if odd else docs.withColumn("rid", F.coalesce("doc_id", F.lit(-1)))
    counts = stored(word_counts(docs.filter(train_row())))
    model, slices = _fitted(docs.select("rid", "text", train_row().alias("train")), counts, last=True)
    out = slices.drop("train").mapInArrow(_scored(model["step"]), "rid long, n_tokens long, n_known long, logs double, path double")
    out = out.select(
        "rid", "n_tokens", "n_known", F.lit(model["n"]).cast("long").alias("train_tokens"),
        (F.col("logs") - F.col("n_tokens") * F.log10(F.lit(float(model["n"] + model["v"] + 1)))).alias("base_score"), (F.col("logs") + F.col("path")).alias("score"),
    )
    out = out.withColumn("perplexity", F.pow(F.lit(10.0), -F.col("score") / F.col("n_tokens")))
    out = docs.select("rid", "doc_id").join(out, "rid").drop("rid") if odd else out.withColumnRenamed("rid", "doc_id")
    return out.select("doc_id", (~train_row()).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score", "perplexity")
