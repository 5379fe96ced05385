"""The pipeline's stages on the smallest tables, each against a brute-force version of its own input."""

import os

import pytest

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="the given tables are not here")


def test_stages(spark):
    import corpus_pipeline as P
    from pingloom.llm.common import stored
    from test_llm_operators import brute_components, windows_removed

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    kept = [docs]
    for name, stage in P.STAGES:
        kept.append(stored(stage(spark, kept[-1], SF)))
        if name != "bpe":
            assert kept[-1].columns == P.COLUMNS
    whole, clean, unique, cut, mixed, ids = [[r.asDict() for r in d.collect()] for d in kept]
    by_id = {r["doc_id"]: r for r in whole}
    toxic = {r.doc_id for r in spark.read.parquet(f"{SF}/labels.parquet").filter("toxic = 1").collect()}
    assert len(clean) >= 0.8 * len(whole) and all(by_id[r["doc_id"]] == r for r in clean)
    assert len(toxic & {r["doc_id"] for r in clean}) <= len(toxic & set(by_id))
    order = sorted(clean, key=lambda r: r["doc_id"])
    want = brute_components([r["text"] for r in order], 5, 80)
    assert {r["doc_id"] for r in unique} == {order[i]["doc_id"] for i, (_, c) in want.items() if c == i}
    order = sorted(unique, key=lambda r: r["doc_id"])
    masks = windows_removed([(r["doc_id"], (r["text"] or "").encode().split()) for r in order], 20)
    cut_by_id = {r["doc_id"]: r for r in cut}
    for r in order:
        words = (r["text"] or "").encode().split()
        left = b" ".join(w for w, m in zip(words, masks[r["doc_id"]], strict=True) if not m).decode()
        assert cut_by_id[r["doc_id"]]["text"] == (left if masks[r["doc_id"]].any() else r["text"] or "")
        assert cut_by_id[r["doc_id"]]["n_chars"] == len(cut_by_id[r["doc_id"]]["text"])
    size = {r["doc_id"]: len(r["text"].encode().split()) for r in cut}
    taken = {}
    for r in mixed:
        n = len(r["text"].encode().split())
        taken[r["doc_id"]] = taken.get(r["doc_id"], 0) + n
        assert r["text"].encode().split() == cut_by_id[r["doc_id"]]["text"].encode().split()[:n]
    assert all(0 < taken[i] <= 3 * size[i] for i in taken)
    assert abs(sum(taken.values()) - sum(size.values())) <= len({r["source"] for r in cut})
    public = pytest.importorskip("public_tokenizers")
    lib = pytest.importorskip("tokenizers").Tokenizer.from_file(public.path("byte_bpe_50k.json"))
    assert sorted((r["doc_id"], r["ids"]) for r in ids) == sorted((r["doc_id"], lib.encode(r["text"], add_special_tokens=False).ids) for r in mixed)


def test_stages_take_an_empty_table(spark):
    import corpus_pipeline as P

    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(0)
    for _, stage in P.STAGES:
        docs = stage(spark, docs, SF)
    assert docs.count() == 0


def test_run_takes_nulls_repeated_rows_and_clashing_names(spark, tmp_path):
    import corpus_pipeline as P

    prose = [" ".join(f"w{(i * 7 + k * k) % 97}x{i}" for k in range(60)) for i in range(6)]
    rows = [(1, prose[0]), (1, prose[0]), (2, None), (None, prose[1]), (None, prose[2]), (3, ""), (4, prose[3]), (5, prose[3]), (6, prose[4] + " " + prose[5]), (7, prose[5] + " tail"), (8, "one")]
    schema = "doc_id long, text string, lang string, source string, n_chars long, score string, size string, rid string, ids string, slot string"
    spark.createDataFrame([(i, t, "en", None if i == 8 else "s", 1, *["x"] * 5) for i, t in rows], schema).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    out = P.run(spark, str(tmp_path)).collect()
    # copies and near copies stay once, whatever their ids; texts without words take no place in the mix
    assert {r.doc_id for r in out} <= {1, 4, 5, 6, 7, 8, None} and sum(r.doc_id in (4, 5) for r in out) >= 1 and not {4, 5} <= {r.doc_id for r in out}
    assert sum(r.doc_id is None for r in out) >= 2 and all(r.n_tokens > 0 for r in out)
