"""Importance resampling, ranked search and license scans against brute force: nulls, empties, ties, repeated rows, clashing names."""

import glob
import hashlib
import math
import os
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from pingloom.llm import importance, kernels, lexical, licenses, queries

SF = "/root/testdata/sf0.001"
LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
VOCABULARY = "Alpha beta GAMMA delta ny øre Sigma tau 7 rho phi 42 kappa mu nu xi pi Ünder çok".split() + ["long" * 20, "x" * 9, "y" * 8]


def words(text):
    return WORD.findall((text or "").translate(LOW))


def prose(rng, n):
    return "".join(rng.choice(VOCABULARY) + rng.choice([" ", " ", ", ", ".\n", "\x00", "_"]) for _ in range(n))


def texts(seed, n=60):
    rng = random.Random(seed)
    out = [prose(rng, rng.randint(0, 60)) for _ in range(n)]
    return out + [None, "", " .\n-", "É" * 50, "ÀÉ Straße ⁠words", out[0], out[0], "z" * 5000 + " " + "z" * 5000, prose(rng, 5000)]


def frame(spark, rows, key="doc_id"):
    """With columns whose names clash with those of results and of inner steps."""
    schema = f"{key} long, text string, score string, rank string, words string, h string, w string, label string, n_words string, row string"
    return spark.createDataFrame([(i, t, *["x"] * 8) for i, t in rows], schema).repartition(4)


def empty(spark, key="doc_id"):
    return frame(spark, [(1, "a")], key).limit(0)


# ---- 11: importance resampling


def test_states_and_direct_crcs_equal_the_checksum_of_the_bytes():
    rng = random.Random(1)
    data = [bytes(rng.randrange(1, 256) for _ in range(n)) for n in [*range(1, 140), 1000, 70_000]]
    joined = np.frombuffer(b"".join(data), np.uint8)
    seen = kernels.Words(joined, np.concatenate([[0], np.cumsum([len(x) for x in data])]), np.zeros(256, bool))
    assert importance.direct(seen, np.arange(len(data))).tolist() == [zlib.crc32(x) for x in data]
    state, crc, size = np.array([zlib.crc32(x) for x in data[:-1]], np.uint32), np.array([zlib.crc32(x) for x in data[1:]], np.uint32), np.array([len(x) for x in data[1:]])
    assert importance.continued(state, crc, size).tolist() == [zlib.crc32(a + b) for a, b in zip(data, data[1:])]


def resampled(docs, target, percent=5, least=20):
    def buckets(text):
        w = words(text)
        return len(w), [zlib.crc32(" ".join(w[i : i + k]).encode()) % 10_000 for k in (1, 2, 3) for i in range(len(w) - k + 1)]

    d = [(i, *buckets(t)) for i, t in docs]
    s, t = Counter(b for _, _, f in d for b in f), Counter(b for x in target for b in buckets(x)[1])
    all_s, all_t = sum(s.values()), sum(t.values())
    gain = [math.floor(1000 * math.log((t[b] + 1) * (all_s + 10_000) / ((s[b] + 1) * (all_t + 10_000)))) for b in range(10_000)]
    rows = []
    for i, n, f in d:
        h = int(hashlib.sha256(f"42:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        weight = sum(gain[b] for b in f)
        rows.append((i, n, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))))
    able = sorted((r for r in rows if r[1] >= least), key=lambda r: (-r[4], r[0] is not None, r[0] or 0, r[3], r[2]))
    rank = {id(r): k for k, r in enumerate(able[: percent * len(able) // 100], 1)}
    return sorted(((r[0], *r[2:], rank.get(id(r))) for r in rows), key=str)


@pytest.mark.parametrize("seed", [1, 2])
def test_resampling(spark, seed):
    rng = random.Random(seed)
    docs = [(rng.choice([i, i, i, None, 5]), t) for i, t in enumerate(texts(seed, 150))]
    target = [prose(rng, 30) for _ in range(5)] + [None, ""]
    got = importance.resample(frame(spark, docs), frame(spark, list(enumerate(target)), "item_id")).collect()
    assert sorted((tuple(r) for r in got), key=str) == resampled(docs, target)
    assert sum(r.rank is not None for r in got) > 0


def test_the_head_changes_no_bucket(spark):
    docs = frame(spark, list(enumerate(texts(3))))
    target = frame(spark, [(0, "alpha beta"), (1, "mu nu xi")], "item_id")
    whole = importance.learn_head(docs.select("text"))
    assert len(whole.state) >= 15 and len(whole.pair) >= 15
    send = spark.sparkContext.broadcast
    few = importance.learn_head(docs.select("text"), most_words=8, most_pairs=4)
    assert len(few.state) <= 8 and len(few.pair) <= 4
    rows = [sorted(importance.bucketed(docs.select("doc_id", "text"), send(h)).collect(), key=str) for h in (whole, few, importance.NO_HEAD)]
    assert rows[0] == rows[1] == rows[2]
    assert [sorted(importance.bucket_totals(importance.bucketed(target.select(F.lit(1).cast("long").alias("doc_id"), "text"), send(h))).collect()) for h in (whole, few)][0]


def test_resampling_of_empty_tables(spark):
    some = frame(spark, [(i, "one two three " * 10) for i in range(40)])
    assert importance.resample(empty(spark), some).collect() == []
    got = importance.resample(some, empty(spark)).collect()
    assert len(got) == 40 and sorted(r.rank for r in got if r.rank) == [1, 2]


# ---- 12: ranked search


def ranked(docs, items, k=20):
    d = [(i, Counter(words(t))) for i, t in docs]
    n = [sum(c.values()) for _, c in d]
    count, total = sum(x > 0 for x in n), sum(n)
    df = Counter(t for _, c in d for t in c)
    out = []
    for item, text in items:
        found = []
        for (i, c), size in zip(d, n):
            m = 100 - 25 + 25 * size * count // total if total else 0
            score = sum(math.floor(1000 * math.log((2 * count + 2) / (2 * df[t] + 1))) * (1_000_000_000 * c[t] // (1000 * c[t] + 12 * m)) for t in words(text) if t in c)
            if score > 0:
                found.append((score, i))
        found.sort(key=lambda x: (-x[0], x[1] is not None, x[1] or 0))
        out += [(item, r, i, score) for r, (score, i) in enumerate(found[:k], 1)]
    return sorted(out, key=str)


@pytest.mark.parametrize("block_terms", [1 << 16, 20])
def test_ranked_search(spark, block_terms):
    rng = random.Random(7)
    docs = [(rng.choice([i, i, i, None]), t) for i, t in enumerate(texts(7, 90))]
    items = [(rng.choice([i, i, None, 3]), prose(rng, rng.randint(1, 25))) for i in range(25)]
    items += [(99, None), (98, ""), (97, "absent unknown"), (96, items[0][1]), (96, items[0][1]), (95, "ALPHA alpha Alpha beta")]
    got = lexical.rank_documents(frame(spark, docs), frame(spark, items, "item_id"), k=7, block_terms=block_terms)
    assert sorted((tuple(r) for r in got.collect()), key=str) == ranked(docs, items, 7)


def test_ties_go_to_smaller_ids_and_stay_exact_beyond_a_pruned_buffer(spark, monkeypatch):
    docs = [(i, "alpha beta" if i % 3 else "alpha gamma") for i in range(400)] + [(None, "alpha beta")]
    got = lexical.rank_documents(frame(spark, docs), frame(spark, [(1, "beta"), (2, "gamma alpha alpha")], "item_id"), k=5)
    assert sorted((tuple(r) for r in got.collect()), key=str) == ranked(docs, [(1, "beta"), (2, "gamma alpha alpha")], 5)
    monkeypatch.setattr(lexical, "FOUND", 10)
    rng = np.random.default_rng(1)
    best, every = lexical.Best(3, 4), []
    for _ in range(40):
        scores, ids = rng.integers(0, 6, (3, 9)), rng.integers(0, 99, 9)
        best.add(scores, ids, np.ones(9, bool))
        every += [(i, -scores[i, j], ids[j]) for i in range(3) for j in range(9) if scores[i, j] > 0]
    item, score, ids, _ = best.prune()
    assert sorted(zip(item, -score, ids)) == sorted(x for i in range(3) for x in sorted(e for e in every if e[0] == i)[:4])


def test_shared_sets_are_summed_once_and_cover_each_item():
    rng = random.Random(2)
    topics = [set(rng.sample(range(300), 12)) for _ in range(6)]
    items = [{x: 1 for x in set().union(*rng.sample(topics, 2), rng.sample(range(300, 900), 5))} for _ in range(60)]
    leaves, sums, parts = lexical.mine(items)
    whole = [set(x) for x in leaves]
    for a, b in sums:
        assert not whole[a] & whole[b]
        whole.append(whole[a] | whole[b])
    for item, own in zip(items, parts):
        assert sum(len(whole[n]) for n in own) == len(item) and set().union(*(whole[n] for n in own)) == set(item)
    adds = len(sums) + sum(len(own) - 1 for own in parts) + sum(len(x) - 1 for x in leaves)
    assert adds < 0.5 * sum(len(item) - 1 for item in items)
    assert lexical.mine([]) == ([], [], []) and lexical.mine([{}]) == ([], [], [set()])


def test_search_of_empty_tables(spark):
    some = frame(spark, [(1, "alpha beta")])
    items = frame(spark, [(1, "alpha")], "item_id")
    assert lexical.rank_documents(empty(spark), items).collect() == []
    assert lexical.rank_documents(some, empty(spark, "item_id")).collect() == []
    assert lexical.rank_documents(some, frame(spark, [(1, None)], "item_id")).collect() == []


# ---- 13: license scans


def places(text):
    w, out = words(text), []
    for label, phrase in licenses.PHRASES:
        p = phrase.split()
        out += [(i, label) for i in range(len(w) - len(p) + 1) if w[i : i + len(p)] == p]
    return len(w), sorted(out)


def licensed(seed):
    rng = random.Random(seed)
    lines = ["Released under the MIT License.", "Licensed under the Apache License, Version 2.0.", "CC BY-NC 4.0", "under the mit licence", "apache license version 3", "cc by nc cc by nc", "Under\nThe_MIT - license!"]
    out = [f"{prose(rng, rng.randint(0, 30))} {' '.join(rng.sample(lines, rng.randint(0, 3)))} {prose(rng, rng.randint(0, 9))}" for _ in range(40)]
    return out + texts(seed, 10) + ["cc by nc", "by nc cc", "cc by", "cc by nc " * 300]


@pytest.mark.parametrize("sent", [licenses.SENT, 0])
def test_base_places(spark, monkeypatch, sent):
    monkeypatch.setattr(licenses, "SENT", sent)
    rng = random.Random(5)
    docs = [(rng.choice([i, i, None, 4]), t) for i, t in enumerate(licensed(5))]
    got = licenses.scan_licenses(frame(spark, docs)).collect()
    want = []
    for i, t in docs:
        n, found = places(t)
        want.append((i, n, len(found), found[0][0] if found else None, found[-1][0] if found else None, ",".join(sorted({x for _, x in found}))))
    assert sorted((tuple(r)[:6] for r in got), key=str) == sorted(want, key=str)
    assert all(0 <= r.score <= 1 and set(filter(None, r.base_labels.split(","))) <= set(r.labels.split(",")) for r in got)


def test_notices_survive_small_changes_and_the_better_of_overlapping_ones_stays(spark):
    mit, apache, gpl = (next(t for label, t in licenses.NOTICES if label == x) for x in ("mit", "apache-2", "gpl"))
    by, by_nc = (next(t for label, t in licenses.NOTICES if label == x) for x in ("cc-by", "cc-by-nc"))
    changed = mit.split()
    changed[20:22] = ["quite", "other", "longer", "words"]
    del changed[35]
    docs = {
        1: f"intro {mit} end", 2: " ".join(changed), 3: f"{mit} and {apache} and {mit}", 4: gpl, 5: f"This work is {by_nc}.", 6: f"This work is {by}.", 7: " ".join(mit.split()[:20]),
        8: "Permission is hereby granted to walk on the grass", 9: "This work is licensed under the GNU General Public License, version 3.",
    }
    got = {r.doc_id: r for r in licenses.scan_licenses(frame(spark, list(docs.items()))).collect()}
    assert {i: r.labels for i, r in got.items()} == {1: "mit", 2: "mit", 3: "apache-2,mit", 4: "gpl", 5: "cc-by-nc", 6: "cc-by", 7: "", 8: "", 9: "gpl"}
    assert got[1].score == 1 and 0.6 <= got[2].score < 1 and 0 < got[7].score < 0.6 and all(r.n_base == 0 for r in got.values())
    n = len(words(mit))
    assert [(s.label, s.first_word, s.last_word) for s in got[1].spans] == [("mit", 1, n)]
    assert [s.label for s in got[3].spans] == ["mit", "apache-2", "mit"]
    assert licenses.scan_licenses(empty(spark)).collect() == []


def test_license_scan_is_native(spark):
    plan = licenses.scan_licenses(frame(spark, [(1, "a")]))._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


# ---- as registered


@pytest.mark.skipif(not os.path.isdir(SF), reason="the given tables are not here")
def test_registered_queries(spark):
    import duckdb

    c = duckdb.connect()
    for f in glob.glob(f"{SF}/*.parquet"):
        c.execute(f"CREATE VIEW {os.path.basename(f).split('.')[0]} AS SELECT * FROM '{f}'")
    for name in ("op12_lexical_search", "op13_license_scan"):
        df = queries.queries()[name](spark, SF)
        cur = c.execute(queries.oracle_sql()[name])
        order = [d[0] for d in cur.description]
        assert sorted(order) == sorted(df.columns)
        assert sorted(map(str, (tuple(r) for r in df.select(*order).collect()))) == sorted(map(str, cur.fetchall()))
    docs = [(r.doc_id, r.text) for r in queries.table(spark, SF, "documents").collect()]
    target = [r.text for r in queries.table(spark, SF, "benchmark").collect()]
    assert sorted((tuple(r) for r in queries.op11_importance(spark, SF).collect()), key=str) == resampled(docs, target)
