"""What a task holds at once, and that bounds of it change no result."""

import tracemalloc

import numpy as np
import pyarrow as pa

from pingloom.llm import brown_lm, kernels, repeats, substring


def test_heads_are_hashed_in_pieces():
    plan = substring.PLAN
    rows = np.random.default_rng(3).integers(1, 256, (60_000, plan.window * plan.width), dtype=np.uint8)
    rows[50_000] = rows[5]
    fixed = rows.view(f"S{rows.shape[1]}").ravel()
    tracemalloc.start()
    got = repeats.hashed(fixed)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 100 << 20  # 7.2 MB of heads took over 170 MB in one piece
    few = rows[49_990:50_010]
    at = np.arange(len(few)) * few.shape[1]
    assert (got[49_990:50_010] == kernels.Sums(kernels.byte_tokens(few.ravel())).ranges(at, at + few.shape[1])).all()
    assert got[50_000] == got[5] and len(np.unique(got)) == len(got) - 1
    assert len(repeats.hashed(fixed[:0])) == 0


def test_hot_windows_come_in_bounded_parts():
    plan, n = substring.PLAN, 1000
    rng = np.random.default_rng(4)
    one = lambda: {
        "suffix": rng.integers(1, 256, (n, plan.window * plan.width), dtype=np.uint8), "depth": np.full(n, plan.window, np.uint8), "before": rng.integers(1, 256, (n, (plan.step - 1) * plan.width), dtype=np.uint8),
        "rid": np.arange(n), "pos": np.full(n, 50, np.int32), "low": np.zeros(n, np.uint8), "high": np.full(n, plan.step - 1, np.uint8), "hot": np.ones(n, bool),
    }
    parts = list(repeats.split_hot(plan, one(), 600))
    assert max(len(p["depth"]) for p in parts) <= 600
    assert sorted((r, q) for p in parts for r, q in zip(p["rid"].tolist(), p["pos"].tolist(), strict=True)) == [(r, q) for r in range(n) for q in range(50 - plan.step + 1, 51)]


def test_chunks_meet_their_answers(monkeypatch):
    """Rare words are asked for once a chunk; each token gets its class and count, wherever chunks end."""
    docs = ["a b zz b", "", "zz yy a", None, "q q new"]
    hashes = lambda t: kernels.word_hashes(np.frombuffer(t, np.uint8), *kernels.words(np.frombuffer(t, np.uint8), np.array([0, len(t)]))[:2])
    word = {w: hashes(w.encode())[0] for w in ("a", "b", "zz", "yy", "q", "new")}
    common = np.sort(np.array([word["a"], word["b"], brown_lm._END], np.uint64))
    classes = {word["a"]: 1, word["b"]: 2, brown_lm._END: 9}
    model = {"common": common, "common_n": np.array([50, 60, 70]), "g": np.array([classes[h] for h in common]), "ends": np.append(np.full(brown_lm.ENDS, 5), 9), "classes": 10}
    known = {word["zz"]: (7, 3), word["yy"]: (8, 4), word["q"]: (6, 6)}  # the last word is not known
    batch = pa.RecordBatch.from_arrays([pa.array([10, 11, 12, 13, 14]), pa.array(docs), pa.array([True, True, False, True, False])], names=["rid", "text", "train"])
    for size in (1, 1 << 21):
        monkeypatch.setattr(brown_lm, "CHUNK", size)
        coded = [b.rename_columns(["chunk", *b.schema.names[1:]]) for b in brown_lm._encoded(common)([batch])]
        asked = list(brown_lm._asked(coded))
        assert sum(b.num_rows for b in asked) == len({(b["chunk"][0].as_py(), w) for b in asked for w in b["word"].to_pylist()})
        rows = [(k, w, *known[w]) for b in asked for k, w in zip(b["chunk"].to_pylist(), np.asarray(b["word"]).view(np.uint64), strict=True) if w in known]
        found = pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows]), pa.array(np.array([r[1] for r in rows], np.uint64).view(np.int64)), pa.array([r[2] for r in rows]), pa.array([r[3] for r in rows], pa.int16())], names=["chunk", "word", "n", "g"])
        answers = {k: a for b in brown_lm._answered([found]) for k, a in zip(b["chunk"].to_pylist(), b["answer"].to_pylist(), strict=True)}
        schema = pa.schema([*coded[0].schema, pa.field("answer", pa.binary())])
        lines = [r | {"answer": None} for b in coded for r in b.to_pylist()]
        lines += [dict.fromkeys(schema.names) | {"chunk": k, "answer": a} for k, a in answers.items()]
        lines.sort(key=lambda r: (r["chunk"], r["answer"] is None))
        step = np.random.default_rng(1).random((10, 10))
        out = [r for b in brown_lm._scored(step)(brown_lm._classed(model)([pa.RecordBatch.from_pylist(lines, schema)])) for r in b.to_pylist()]
        assert sorted(r["rid"] for r in out) == [10, 11, 12, 13, 14]
        for r in out:
            seen = [word[w] for w in (docs[r["rid"] - 10] or "").split()] + [brown_lm._END]
            n = [dict(zip(common, model["common_n"])).get(h, known.get(h, (0, 0))[0]) for h in seen]
            cls = [9, *(classes.get(h, known.get(h, (0, 5))[1]) for h in seen)]
            assert (r["n_tokens"], r["n_known"]) == (len(seen), sum(x > 0 for x in n))
            assert abs(r["logs"] - np.log10(np.array(n) + 1.0).sum()) < 1e-9 and abs(r["path"] - sum(step[a, b] for a, b in zip(cls, cls[1:]))) < 1e-9
