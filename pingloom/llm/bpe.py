"""BPE encoding and decoding by per-prefix dynamic programming.

For every prefix of a piece the encoding ends in one token only. Walking the piece with an automaton that
reports all vocabulary tokens ending at a byte (longest first), the last token of a prefix is the one that is
compatible with the last token of the prefix before it. Two tokens are compatible if merging their joint bytes
gives just these two; this is tested once for each pair. Back-pointers from the end give the ids.

Texts are cut as byte-level BPE files ask for: added tokens first, then the pre-tokenizer's pattern. Decoding
joins the bytes of the ids and reads them as UTF-8.

Defined results: a null text is empty and has no ids; repeated rows each keep their row; other columns are left
out unless they are named.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Pre-tokenizer pattern of byte-level BPE (a fixed value). \\s: the Unicode property White_Space.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\p{White_Space}\p{L}\p{N}]+|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+"
#: Pieces and pairs that a task remembers.
PIECES, PAIRS = 300_000, 1_000_000


def _byte_of() -> dict[str, int]:
    """Byte-level files write bytes as visible characters: visible Latin-1 ones as themselves, the rest from U+0100 on."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    out = {chr(b): b for b in shown}
    return out | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in set(shown))}


def load_tokenizer(path: str) -> dict:
    """Token bytes, merges by pair of ids, and added tokens of a byte-level BPE file of the tokenizers library."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    byte_of, vocab = _byte_of(), spec["model"]["vocab"]
    raw = {i: bytes(byte_of[c] for c in t) for t, i in vocab.items()}
    merges = {}
    for rank, pair in enumerate(spec["model"]["merges"]):
        a, b = pair.split(" ") if isinstance(pair, str) else pair
        merges[vocab[a], vocab[b]] = (rank, vocab[a + b])
    added = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
    return {"raw": raw | {i: t.encode() for t, i in added.items()}, "plain": sorted(vocab.values()), "merges": merges, "added": added}


class Encoder:
    def __init__(self, model: dict):
        import ahocorasick
        import regex

        self.raw, self.merges, self.added = model["raw"], model["merges"], model["added"]
        self.byte = {self.raw[i]: i for i in model["plain"] if len(self.raw[i]) == 1}
        self.cut = regex.compile(PATTERN).findall
        self.special = regex.compile("(" + "|".join(regex.escape(t) for t in sorted(self.added, key=len, reverse=True)) + ")") if self.added else None
        self.matches = ahocorasick.Automaton()
        for i in model["plain"]:
            if len(self.raw[i]) == 1 or self.merged([self.byte[self.raw[i][k : k + 1]] for k in range(len(self.raw[i]))]) == [i]:
                self.matches.add_word(self.raw[i].decode("latin-1"), (len(self.raw[i]), i))
        self.matches.make_automaton()
        self.pieces: dict[str, str] = {}
        self.pairs: dict[int, bool] = {}

    def merged(self, ids: list[int]) -> list[int]:
        """All merges applied, the lowest rank first; used for single tokens and pairs only."""
        merges = self.merges
        while len(ids) > 1:
            best = min((m[0], k, m[1]) if (m := merges.get((ids[k], ids[k + 1]))) else (1 << 60, k, 0) for k in range(len(ids) - 1))
            if best[0] == 1 << 60:
                break
            ids = [*ids[: best[1]], best[2], *ids[best[1] + 2 :]]
        return ids

    def compatible(self, a: int, b: int) -> bool:
        key = a << 32 | b
        got = self.pairs.get(key)
        if got is None:
            if len(self.pairs) >= PAIRS:
                self.pairs.clear()
            both = self.raw[a] + self.raw[b]
            got = self.pairs[key] = self.merged([self.byte[both[k : k + 1]] for k in range(len(both))]) == [a, b]
        return got

    def piece(self, raw: bytes) -> list[int]:
        n = len(raw)
        last, size = [-1] * (n + 1), [0] * (n + 1)
        compatible = self.compatible
        for end, (length, token) in self.matches.iter(raw.decode("latin-1")):
            end += 1
            if last[end] < 0 and (length == end or compatible(last[end - length], token)):
                last[end], size[end] = token, length
        ids = []
        while n:
            ids.append(last[n])
            n -= size[n]
        return ids[::-1]

    def joined(self, text: str) -> str:
        """The ids of a text in decimal, joined by commas."""
        out = []
        for part in self.special.split(text) if self.special else [text]:
            if part in self.added:
                out.append(str(self.added[part]))
                continue
            pieces = self.cut(part)
            known = self.pieces
            for p in pieces:
                ids = known.get(p)
                if ids is None:
                    if len(known) >= PIECES:
                        known.clear()
                    ids = known[p] = ",".join(map(str, self.piece(p.encode())))
                out.append(ids)
        return ",".join(out)

    def decode(self, ids: list[int]) -> str:
        return b"".join(map(self.raw.__getitem__, ids)).decode("utf-8", "replace")


_made: dict[str, Encoder] = {}


def _encoder(model, key: str) -> Encoder:
    """One for each worker process."""
    if key not in _made:
        _made.clear()
        _made[key] = Encoder(model.value)
    return _made[key]


def _run(model, key: str, names: list[str], with_ids: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(model, key)
        for b in batches:
            for at in range(0, b.num_rows, 500):  # ids of a few documents at a time
                part = b.slice(at, 500)
                counts, ids_out, digests, decoded = [], [], [], []
                for text in part.column("text").to_pylist():
                    line = encoder.joined(text or "")
                    ids = list(map(int, line.split(","))) if line else []
                    counts.append(len(ids))
                    digests.append(hashlib.sha256(line.encode()).hexdigest())
                    decoded.append(hashlib.sha256(encoder.decode(ids).encode()).hexdigest())
                    ids_out.append(ids if with_ids else None)
                cols = [pa.array(counts, pa.int64()), pa.array(digests, pa.string()), pa.array(decoded, pa.string()), *([pa.array(ids_out, pa.list_(pa.int32()))] if with_ids else [])]
                yield pa.RecordBatch.from_arrays([*(part.column(n) for n in names), *cols], names=[*names, "n_tokens", "ids_sha256", "decoded_sha256", *(["ids"] if with_ids else [])])

    return run


def encode(docs: DataFrame, path: str, carry: tuple[str, ...] = (), with_ids: bool = True) -> DataFrame:
    """doc_id, the columns of ``carry``, n_tokens, ids_sha256 (of the decimal ids joined by commas), decoded_sha256 and, with ``with_ids``, ids.

    ``path`` names a byte-level BPE file of the tokenizers library.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), *carry, F.col("text").cast("string").alias("text"))
    model = docs.sparkSession.sparkContext.broadcast(load_tokenizer(path))  # a vocabulary file: fixed size
    carried = "".join(f"`{c}` {docs.schema[c].dataType.simpleString()}, " for c in carry)
    return docs.mapInArrow(_run(model, path, ["doc_id", *carry], with_ids), f"doc_id long, {carried}n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * with_ids)


def decode(encoded: DataFrame, path: str, ids: str = "ids") -> DataFrame:
    """All columns of ``encoded`` and the text of its ids as ``decoded`` (null ids: null)."""
    encoded = encoded.drop("decoded")
    model = encoded.sparkSession.sparkContext.broadcast(load_tokenizer(path))
    names = encoded.columns

    def run(batches):
        raw = model.value["raw"]
        for b in batches:
            texts = [None if x is None else b"".join(map(raw.__getitem__, x)).decode("utf-8", "replace") for x in b.column(names.index(ids)).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(texts, pa.string())], names=[*names, "decoded"])

    return encoded.mapInArrow(run, type(encoded.schema)([*encoded.schema.fields]).add("decoded", "string"))
