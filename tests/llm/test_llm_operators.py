"""The ten operators against brute force on small fixtures: nulls, empties, ties, repeated rows, clashing names."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from pingloom.llm import bpe, brown_lm, jaccard, kernels, mixing, quality_rules, repeats, substring, suffix_array, topk, toxicity, url_filter

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
WORDS = "alpha beta gamma delta ny øre sigma tau rho phi kappa mu nu xi pi one two three four five".split()


def prose(rng, n):
    return " ".join(rng.choice(WORDS) + rng.choice(["", "", ".", ",\n", "é"]) for _ in range(n))


def corpus(seed=1, n=40, shared=6):
    """Documents with copies, near copies, shared passages, blanks, nulls, periodic and long texts."""
    rng = random.Random(seed)
    passages = [prose(rng, 40) for _ in range(shared)]
    out = []
    for _ in range(n):
        kind = rng.random()
        text = prose(rng, rng.randint(1, 120))
        if kind < 0.4:
            text = f"{text} {rng.choice(passages)} {prose(rng, rng.randint(0, 30))}"
        elif kind < 0.5 and out:
            text = rng.choice(out)
        elif kind < 0.65 and out and (w := (rng.choice(out) or "").split(" ")):
            w[rng.randrange(len(w))] = "changed"
            text = " ".join(w)
        out.append(text)
    out += [None, "", " \n\t", "a" * 400, "ab " * 150, "one two", "\x00" * 150, "é" * 130 + "\x00" * 120, prose(rng, 4000)]
    return out


def frame(spark, texts, ids=None):
    ids = ids or list(range(len(texts)))
    return spark.createDataFrame([(i, t, "en", f"s{k % 3}", -1) for k, (i, t) in enumerate(zip(ids, texts, strict=True))], DOCS).repartition(5)


def windows_removed(docs, size):
    """{key: mask} by a set of all windows seen so far, documents in order."""
    seen, out = set(), {}
    for key, tokens in docs:
        mask = np.zeros(len(tokens), bool)
        for s in range(len(tokens) - size + 1):
            w = tokens[s : s + size] if isinstance(tokens, bytes) else tuple(tokens[s : s + size])
            if w in seen:
                mask[s : s + size] = True
            seen.add(w)
        out[key] = mask
    return out


# ---- kernels


def test_words_and_hashes_follow_the_documents():
    texts = ["a b", "", "b a\x0bccc", " x", "x\x1fy \xa0z"]
    raw = [t.encode() for t in texts]
    data = np.frombuffer(b"".join(raw), np.uint8)
    offs = np.concatenate([[0], np.cumsum([len(r) for r in raw])])
    start, end, at = kernels.words(data, offs)
    got = [[bytes(data[s:e]) for s, e in zip(start[at[i] : at[i + 1]], end[at[i] : at[i + 1]], strict=True)] for i in range(len(raw))]
    assert got == [r.split() for r in raw]
    h = kernels.word_hashes(data, start, end)
    flat = [w for d in got for w in d]
    assert all((h[i] == h[j]) == (flat[i] == flat[j]) for i in range(len(flat)) for j in range(len(flat)))


def test_anchor_runs_cut_all_windows_and_equal_windows_share_the_gram():
    rng = np.random.default_rng(5)
    tokens = kernels.mix(rng.integers(0, 6, 600).astype(np.uint64))
    offs = np.array([0, 5, 300, 300, 600])
    a = kernels.anchors(tokens, offs, 12, 4)
    starts = Counter()
    gram_of = {}
    for d, lo, span, g in zip(a["doc"], a["lo"], a["span"], a["gram"], strict=True):
        for s in range(lo, lo + span):
            starts[d, s] += 1
            gram_of.setdefault(tuple(tokens[offs[d] + s : offs[d] + s + 12]), set()).add(g)
    assert starts == Counter((d, s) for d in range(4) for s in range(offs[d + 1] - offs[d] - 11) if offs[d + 1] - offs[d] >= 12)
    assert all(len(g) == 1 for g in gram_of.values())


def test_sliding_argmin_of_long_arrays(monkeypatch):
    x = kernels.mix(np.arange(500, dtype=np.uint64) % 37)
    fast = kernels.sliding_argmin(x, 9)
    want = [i + int((x[i : i + 9] >> np.uint64(24)).argmin()) for i in range(492)]
    assert fast.tolist() == want


# ---- 1 and 8: repeats


def check_bytes(docs, rows):
    want = windows_removed(docs, 100)
    by_id = {k: t for k, t in docs}
    for r in rows:
        mask, raw = want[r.doc_id], by_id[r.doc_id]
        kept = bytes(np.frombuffer(raw, np.uint8)[~mask])
        spans = int((np.diff(np.concatenate([[0], mask.astype(int), [0]])) == 1).sum())
        assert (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) == (len(raw), int(mask.sum()), spans, hashlib.sha256(kept).hexdigest()), r.doc_id
        assert sum(b - a for a, b in r.spans) == r.n_removed


@pytest.mark.parametrize("seed", [1, 2])
def test_suffix_dedup(spark, seed):
    texts = corpus(seed)
    rows = suffix_array.suffix_dedup(frame(spark, texts)).collect()
    assert len(rows) == len(texts)
    check_bytes([(i, (t or "").encode()) for i, t in enumerate(texts)], rows)


def test_suffix_dedup_with_many_ranges(spark):
    texts = corpus(3, 60, 3)
    check_bytes([(i, (t or "").encode()) for i, t in enumerate(texts)], suffix_array.suffix_dedup(frame(spark, texts), size=40).collect())


@pytest.mark.parametrize("plan", [suffix_array.PLAN, substring.PLAN])
def test_pieces_of_a_long_document_hold_all_its_windows(plan, monkeypatch):
    tokens = kernels.mix(np.random.default_rng(3).integers(0, 9, 2500).astype(np.uint64))
    at = np.array([0, 2000, 2010, 2500])

    def windows():
        out = {}
        for runs in repeats._anchored(plan, tokens, at):
            for gram, doc, lo, span, off in zip(*(runs[k].tolist() for k in ("gram", "doc", "lo", "span", "off")), strict=True):
                for w in range(lo, lo + span):
                    assert (doc, w) not in out
                    out[doc, w] = gram, lo + off
        return out

    whole = windows()
    assert len(whole) == sum(max(0, n - plan.window + 1) for n in np.diff(at))
    monkeypatch.setattr(repeats, "PIECE", 300)
    assert windows() == whole


def test_merge_of_front_coded_runs_is_a_sort():
    rng = random.Random(4)
    runs, strings = [], []
    for _ in range(5):
        own = sorted((bytes(rng.choice(b"ab\x00") for _ in range(rng.randint(1, 100))) for _ in range(60)), key=lambda s: (s.ljust(100, b"\0"), len(s)))
        e = {"suffix": np.array([list(s.ljust(100, b"\0")) for s in own], np.uint8), "depth": np.array([len(s) for s in own], np.uint8), "before": np.zeros((60, 15), np.uint8), "rid": np.arange(60) + len(strings), "pos": np.zeros(60, np.int32), "low": np.zeros(60, np.uint8), "high": np.zeros(60, np.uint8)}
        runs.append(suffix_array.front_code(e, repeats.common_prefix(suffix_array.PLAN, e)))
        strings += own
    e, lcp = suffix_array.merge(runs)
    got = [strings[i] for i in e["rid"]]
    assert got == sorted(strings, key=lambda s: (s.ljust(100, b"\0"), len(s)))
    for i in range(1, len(got)):
        n = next((k for k, (x, y) in enumerate(zip(got[i - 1], got[i], strict=False)) if x != y), min(len(got[i - 1]), len(got[i])))
        assert lcp[i] == n


@pytest.mark.parametrize("seed", [1, 2])
def test_substring_dedup(spark, seed):
    texts = corpus(seed, 60)
    docs = [(i, (t or "").encode().split()) for i, t in enumerate(texts)]
    want = windows_removed(docs, 20)
    rows = substring.substring_dedup(frame(spark, texts), with_text=True, carry=("source",), size=50 if seed == 2 else substring.GROUP).collect()
    assert len(rows) == len(texts)
    for r in rows:
        words, mask = docs[r.doc_id][1], want[r.doc_id]
        kept = b" ".join(w for w, m in zip(words, mask, strict=True) if not m)
        assert (r.n_words, r.n_removed, r.kept_sha256) == (len(words), int(mask.sum()), hashlib.sha256(kept).hexdigest()), r.doc_id
        assert r.kept_text == (kept.decode() if r.n_removed else texts[r.doc_id] or "") and r.source == f"s{r.doc_id % 3}"


@pytest.mark.parametrize("unit", ["bytes", "words"])
def test_a_hot_passage_is_spread(spark, unit, monkeypatch):
    """One passage in most documents, each with other words before it: its first suffixes share all they hold."""
    rng = random.Random(21)
    passage = " ".join(f"p{i}" for i in range(60))
    texts = [f"{prose(rng, rng.randint(3, 30))} {passage} {prose(rng, rng.randint(3, 30))}" for _ in range(80)]
    seen = []
    real = repeats.hot_grams
    monkeypatch.setattr(repeats, "hot_grams", lambda *a: seen.append(real(*a)) or seen[-1])
    if unit == "bytes":
        check_bytes([(i, t.encode()) for i, t in enumerate(texts)], suffix_array.suffix_dedup(frame(spark, texts), size=20, most=4, limit=8).collect())
    else:
        docs = [(i, t.encode().split()) for i, t in enumerate(texts)]
        want = windows_removed(docs, 20)
        for r in substring.substring_dedup(frame(spark, texts), size=10, limit=8).collect():
            kept = b" ".join(w for w, m in zip(docs[r.doc_id][1], want[r.doc_id], strict=True) if not m)
            assert r.kept_sha256 == hashlib.sha256(kept).hexdigest()
    assert len(seen[0]) > 0


def test_repeats_with_null_and_shared_ids(spark):
    text = " ".join(f"w{i}" for i in range(40))
    texts, ids = [text, text, text, "short", None], [7, 7, None, 7, None]
    rows = substring.substring_dedup(frame(spark, texts, ids)).collect()
    # the null id comes first and keeps its words; both others lose all
    assert sorted((r.doc_id or -1, r.n_words, r.n_removed) for r in rows) == [(-1, 0, 0), (-1, 40, 0), (7, 1, 0), (7, 40, 40), (7, 40, 40)]
    rows = suffix_array.suffix_dedup(frame(spark, texts, ids)).collect()
    assert sorted((r.n_bytes, r.n_removed) for r in rows) == [(0, 0), (5, 0), (len(text), 0), (len(text), len(text)), (len(text), len(text))]


@pytest.mark.parametrize("run", [lambda d: suffix_array.suffix_dedup(d), lambda d: substring.substring_dedup(d), lambda d: jaccard.jaccard_components(d), lambda d: mixing.mix(d), lambda d: brown_lm.score_corpus(d)])
def test_empty_table(spark, run):
    assert run(spark.createDataFrame([], DOCS)).count() == 0


# ---- 2: toxicity


def toxic_corpus(spark, n=400):
    rng = random.Random(9)
    rows, labels = [], []
    for i in range(n):
        group, insult = rng.random() < 0.5, rng.random() < 0.5  # toxic: the pair, not either word
        words = prose(rng, 30).split() + ["they"] * group + ["rotten"] * insult
        rng.shuffle(words)
        rows.append((i, " ".join(words), "en", "s", 1))
        labels.append((i, int(group and insult)))
    return spark.createDataFrame([*rows, (n, None, "en", "s", 1), (n + 1, "", "en", "s", 1), (None, "x", "en", "s", 1)], DOCS), spark.createDataFrame([*labels, (None, 1), (5, None)], "doc_id long, toxic int")


def test_toxicity_learns_a_pair(spark):
    docs, labels = toxic_corpus(spark)
    rows = toxicity.toxicity(docs, labels).collect()
    truth = {r.doc_id: r.toxic for r in labels.collect() if r.toxic is not None}
    held = [(truth[r.doc_id], r.predicted) for r in rows if r.held_out and r.doc_id in truth]
    assert len(held) > 60 and sum(a == b for a, b in held) / len(held) > 0.95
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in rows) and len(rows) == 403
    assert all(r.held_out == (zlib.crc32(str(r.doc_id if r.doc_id is not None else "").encode()) % 4 == 2) for r in rows)


def test_toxicity_without_two_classes(spark):
    docs, labels = toxic_corpus(spark, 8)
    assert {round(r.score, 6) for r in toxicity.toxicity(docs, labels.filter("toxic = 0")).collect()} == {0.0}


# ---- 3: quality rules


def test_text_stats(spark):
    texts = [*corpus(5, 30), "a b c a b c\na b c\na b c\n \n#x $ %& <>|*", "x y x y x y", "x x x", "d d d d"]
    word = re.compile("[^\x20\x09-\x0d]+")
    for r in quality_rules.text_stats(frame(spark, texts)).collect():
        t = texts[r.doc_id] or ""
        w = word.findall(t)
        grams = Counter(zip(w, w[1:], w[2:], strict=False))
        cover = {k for i in range(len(w) - 2) if grams[tuple(w[i : i + 3])] > 1 for k in (i, i + 1, i + 2)}
        lines = [x for x in t.split("\n") if word.search(x)]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == (len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)), len(cover)), t[:80]


def test_decision_list_finds_a_conjunction():
    rng = random.Random(2)
    rows = []
    for _ in range(900):
        f = [rng.random() for _ in quality_rules.FEATURES]
        rows.append((0 if f[2] > 0.7 and f[4] <= 0.4 else 1, *f))
    rules = quality_rules.learn_decision_list(rows)
    assert rules and {t[0] for t in rules[0]} >= {"symbol_share", "repeat_share"}
    hold = lambda f: any(all((f[quality_rules.FEATURES.index(n)] <= c) if op == "<=" else (f[quality_rules.FEATURES.index(n)] > c) for n, op, c in rule) for rule in rules)
    assert sum((y == 0) == hold(f) for y, *f in rows) / len(rows) > 0.95
    assert quality_rules.learn_decision_list([]) == [] and quality_rules.learn_decision_list([(1, *[0.0] * 10)] * 9) == []


def test_quality_rules_keep_what_passes(spark):
    rng = random.Random(3)
    docs = frame(spark, [prose(rng, 80), "x", None])
    rows = {r.doc_id: r for r in quality_rules.quality_rules(docs, spark.createDataFrame([], "doc_id long, quality int")).collect()}
    assert rows[0].kept and not rows[1].kept and rows[1].base_failed and not rows[2].kept


def test_quality_verdicts_follow_the_learned_rules(spark):
    rng = random.Random(13)
    texts, labels = [], []
    for i in range(240):
        bad = i % 3 == 0
        words = prose(rng, rng.randint(60, 120)).split()
        if bad:
            words = [w + rng.choice(["#", "$$", "|"]) if rng.random() < 0.6 else w for w in words]
        texts.append(" ".join(words))
        labels.append((i, 0 if bad and rng.random() < 0.95 else 1))
    docs, marked = frame(spark, texts + [None, ""]), spark.createDataFrame(labels, "doc_id long, quality int")
    rules = quality_rules.fit_rules(docs, marked)
    assert rules and all(name in quality_rules.FEATURES for rule in rules for name, _, _ in rule)
    stats = {r.doc_id: r for r in quality_rules.text_stats(docs.select("doc_id", "text")).collect()}
    hold = lambda r, rule: all(r[name] <= cut if op == "<=" else r[name] > cut for name, op, cut in rule)
    got = quality_rules.quality_rules(docs, marked).collect()
    assert len(got) == 242
    for r in got:
        want = 0 if any(hold(stats[r.doc_id], rule) for rule in rules) else 1
        assert r.verdict == want and r.kept == (not r.base_failed and want == 1), r.doc_id
    caught = sum(r.verdict == 0 for r in got if r.doc_id < 240 and labels[r.doc_id][1] == 0)
    assert caught >= 0.8 * sum(q == 0 for _, q in labels)
    # a bound on the rows changes the sample, not the form; copies of an id count as rows
    assert quality_rules.fit_rules(docs.unionByName(docs), marked, fit_rows=50) is not None


def test_other_empty_tables_and_clashing_names(spark):
    none = spark.createDataFrame([], "doc_id long, quality int")
    assert quality_rules.quality_rules(spark.createDataFrame([], DOCS), none).count() == 0
    vectors = spark.createDataFrame([(0, [1.0, 2.0], "x", "y"), (1, [0.5, 1.0], "x", "y"), (2, [3.0, 0.0], "x", "y")], "vec_id long, embedding array<float>, score string, rank string")
    assert topk.top_k(vectors.limit(0), vectors.limit(0)).count() == 0
    assert topk.top_k(vectors, vectors.limit(0)).count() == 0
    assert [(r.rank, r.vec_id) for r in topk.top_k(vectors, vectors.filter("vec_id = 0"), k=2).orderBy("rank").collect()] == [(1, 2), (2, 1)]
    pages = spark.createDataFrame([(1, "http://A.net/x", "h", "p")], "page_id long, url string, host string, verdict string")
    rules = spark.createDataFrame(url_filter.RULES, "host string, path string, verdict string")
    assert [tuple(r) for r in url_filter.filter_urls(pages, rules).collect()] == [(1, "a.net", "/x", "net/", "block")]
    assert url_filter.filter_urls(pages.limit(0), rules).count() == 0
    assert [r.verdict for r in url_filter.filter_urls(pages, rules.limit(0)).collect()] == ["allow"]


# ---- 4: mixing


def test_mixing_meets_targets(spark):
    rng = random.Random(8)
    rows = [(i, prose(rng, rng.randint(0, 900)) if i % 11 else None, "en", rng.choice(["big"] * 6 + ["mid", "mid", "tiny", None]), 1) for i in range(150)]
    d = spark.createDataFrame(rows, DOCS)
    got = mixing.mix(d.repartition(6)).collect()
    again = mixing.mix(d.repartition(3)).collect()
    key = lambda r: (r.doc_id, r.size, r.source_size, r.target, r.taken)
    assert sorted(map(key, got)) == sorted(map(key, again)) and len(got) == 150
    source = {r[0]: r[3] for r in rows}
    size = {i: len((t or "").encode().split()) for i, t, *_ in rows}
    names = sorted({s for s in source.values() if s is not None}) + [None]
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(names)}
    total = {s: sum(size[i] for i in size if source[i] == s) for s in names}
    target, open_ = {}, set(names)
    while True:  # share by weight; what is above its cap stops there
        rest = sum(total.values()) - sum(target.values())
        share = {s: rest * weight[s] / sum(weight[x] for x in open_) for s in open_}
        over = {s for s in open_ if share[s] > 3 * total[s]}
        if not over:
            target |= share
            break
        target |= {s: 3.0 * total[s] for s in over}
        open_ -= over
    for r in got:
        s = source[r.doc_id]
        assert r.size == size[r.doc_id] and r.source_size == total[s] and r.target == pytest.approx(target[s], abs=1e-5) and 0 <= r.taken <= 3 * r.size
    for s in names:
        assert sum(r.taken for r in got if source[r.doc_id] == s) == round(target[s])


def test_schedule_spreads_sources_evenly(spark):
    t = spark.createDataFrame([("a", 900_000, 500_000.0), ("b", 90_000, 200_000.0)], "source string, source_size long, target double")
    rows = sorted(mixing.schedule(t).collect(), key=lambda r: r.slot)
    ranks = {s: [r["rank"] for r in rows if r.source == s] for s in "ab"}
    assert all(sorted(v) == list(range(len(v))) for v in ranks.values())
    for upto in (50, 200, len(rows)):
        n = sum(r.source == "a" for r in rows[:upto])
        assert abs(n - upto * len(ranks["a"]) / len(rows)) < 4


# ---- 5: Jaccard join


def brute_components(texts, n, percent):
    sets = {}
    for i, t in enumerate(texts):
        w = (t or "").encode().lower().split()
        sets[i] = {tuple(w[k : k + n]) for k in range(len(w) - n + 1)} if len(w) >= n else ({tuple(w)} if w else set())
    at = {i: i for i in sets}
    for i in sets:
        for j in range(i):
            m = len(sets[i] & sets[j])
            if m and 100 * m >= percent * len(sets[i] | sets[j]) and at[i] != at[j]:
                a, b = sorted((at[i], at[j]))
                at = {k: a if v == b else v for k, v in at.items()}
    return {i: (len(sets[i]), at[i]) for i in sets}


@pytest.mark.parametrize("n,percent", [(4, 85), (5, 80)])
def test_jaccard_components(spark, n, percent, monkeypatch):
    if n == 5:  # large blocks, cut into small tiles
        monkeypatch.setattr(jaccard, "TILE", 4)
    rng = random.Random(11)
    base = prose(rng, 150).split()
    texts = corpus(6, 50) + ["one two three", "ONE two three", "one two", "x"]
    for _ in range(25):
        w = list(base)
        for _ in range(rng.randint(0, 5)):
            w[rng.randrange(len(w))] = f"v{rng.randrange(9)}"
        texts.append(" ".join(w[: rng.randint(120, 150)]))
    want = brute_components(texts, n, percent)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.jaccard_components(frame(spark, texts), n, percent).collect()}
    assert got == want


@pytest.mark.parametrize("percent", [60, 75, 80, 85, 95])
def test_prefix_keys_lose_no_link(percent):
    rng = np.random.default_rng(3)
    for size in (1, 2, 7, 12, 40, 130, 400):
        for _ in range(30):
            a = np.unique(rng.integers(0, 1 << 63, size, dtype=np.uint64))
            b = a.copy()
            for _ in range(int(rng.integers(0, max(1, size // 6)))):
                b[rng.integers(len(b))] = rng.integers(0, 1 << 63, dtype=np.uint64)
            b = np.unique(b[: len(b) - int(rng.integers(0, max(1, size // 9)))]) if size > 2 else np.unique(b)
            inter = len(np.intersect1d(a, b))
            if 100 * inter < percent * (len(a) + len(b) - inter) or np.array_equal(a, b):
                continue
            some = np.sort(rng.choice(np.union1d(a, b), len(a) // 2, replace=False))
            keys = [set(jaccard.prefix_keys(x, np.array([0, len(x)]), percent, (some, rng.integers(1, 9, len(some)) * 0 + 5))[1].tolist()) for x in (a, b)]
            assert keys[0] & keys[1]


def test_half_a_passage_in_common_makes_no_candidates(spark):
    passage = " ".join(f"p{i}" for i in range(30))
    docs = spark.range(4000).selectExpr("id as doc_id", f"concat('{passage} ', array_join(transform(sequence(0, 29), i -> concat('w', cast(pmod(xxhash64(id, i), 1000000) as string))), ' ')) as text").repartition(2)
    rid, _ = jaccard.with_rid(docs)
    frequent = jaccard.frequent_grams(rid, 4)
    keys = rid.mapInArrow(jaccard._keys(4, 85, frequent), "key long, node long")
    assert len(frequent[0]) == 27 and keys.groupBy("key").count().filter("count > 1").count() == 0


def thue_morse(n, a, b):
    s, other = a, {a: b, b: a}
    while len(s) < n:
        s += "".join(other[c] for c in s)
    return s


def test_long_words_of_equal_polynomial_hash(spark):
    x, y = thue_morse(2048, "a", "b"), thue_morse(2048, "b", "a")
    head = " ".join(f"w{i}" for i in range(15))
    texts = [f"{head} {x} {head}", f"{head} {y} {head}", f"{head} {x} {head} z", f"{x} k", f"{y} k"]
    docs = [(i, t.encode().split()) for i, t in enumerate(texts)]
    want = windows_removed(docs, 20)
    for r in substring.substring_dedup(frame(spark, texts)).collect():
        assert r.n_removed == sum(want[r.doc_id])
    of = {r.doc_id: r.component_id for r in jaccard.jaccard_components(frame(spark, texts), n=1, percent=95).collect()}
    assert of[3] == 3 and of[4] == 4 and of[1] == 1
    data = np.frombuffer(f"{x} {y}".encode(), np.uint8)
    start, end, _ = kernels.words(data, np.array([0, len(data)]))
    assert len(set(kernels.word_hashes(data, start, end).tolist())) == 2


def test_equal_sets_have_one_id_wherever_they_stand():
    for texts in (["zz ab cd ef", "ab cd ef"], ["ab cd ef", "zz", "ab cd ef"]):
        (_, _, data, offs), = kernels.slices(pa.array(texts))
        nodes = jaccard.node_ids(*jaccard.sets(data, offs, 2))
        (_, _, one, at), = kernels.slices(pa.array(["ab cd ef"]))
        assert nodes[-1] == jaccard.node_ids(*jaccard.sets(one, at, 2))[0]


def test_jaccard_with_shared_ids(spark):
    rows = jaccard.jaccard_components(frame(spark, ["a b c d e f g", "a b c d e f g", "z"], [4, 4, None])).collect()
    assert sorted((r.doc_id or -1, r.component_id or -1) for r in rows) == [(-1, -1), (4, 4), (4, 4)]


# ---- 6: class-based language model


def test_brown_scores(spark):
    texts = corpus(12, 60)
    rows = brown_lm.score_corpus(frame(spark, texts)).collect()
    docs = {i: [*(t or "").encode().lower().split(), None] for i, t in enumerate(texts)}
    held = lambda i: zlib.crc32(str(i).encode()) % 7 == 2
    c = Counter(w for i in docs if not held(i) for w in docs[i])
    n, v = sum(c.values()), len(c)
    for r in rows:
        w = docs[r.doc_id]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held(r.doc_id), len(w), sum(c[x] > 0 for x in w), n)
        assert r.base_score == pytest.approx(sum(math.log10((c[x] + 1) / (n + v + 1)) for x in w))
        assert r.score < 0 and r.perplexity == pytest.approx(10 ** (-r.score / r.n_tokens))
    total = lambda f, h: sum(getattr(r, f) for r in rows if r.held_out == h)
    assert total("score", False) > total("base_score", False)


def test_brown_probabilities_sum_to_one(spark):
    texts = corpus(13, 40)
    docs = frame(spark, texts)
    train = docs.filter(brown_lm.train_row())
    counts = brown_lm.word_counts(train)
    model = brown_lm.fit(train, counts)
    rows = counts.collect()
    for before in range(3):
        seen = np.array([r.word for r in rows], dtype=np.int64).view(np.uint64)
        cls = model["class_of"][brown_lm._items(seen, model["own"], np.array([r.tail for r in rows]))]
        p = 10 ** model["step"][before, cls] * (np.array([r.n for r in rows]) + 1)
        unseen = (10 ** model["step"][before]).sum()  # the mass of one occurrence in each class
        assert p.sum() + unseen == pytest.approx(1.0, abs=1e-6)


def test_exchange_raises_the_likelihood():
    rng = np.random.default_rng(1)
    kinds, true = 41, np.arange(41) % 4
    rate = rng.random((4, 4)) ** 4
    table = rng.poisson(60 * rate[true][:, true])

    def gain(of):
        hot = np.eye(of.max() + 1)[of]
        grid = hot.T @ table @ hot
        f = lambda x: (x * np.log(np.maximum(x, 1e-300))).sum()
        return f(grid) - f(grid.sum(0)) - f(grid.sum(1))

    start = np.arange(kinds) % 5
    got = brown_lm.exchange(table, classes=6)
    assert gain(got) > gain(start) and gain(got) >= gain(np.append(true[:-1], 4)) - 1e-6


def test_every_word_is_clustered_by_its_neighbours(spark, monkeypatch):
    """Words of two kinds take turns; their ends say nothing, and most are neither frequent nor sent along."""
    monkeypatch.setattr(brown_lm, "ITEMS", 20)
    monkeypatch.setattr(brown_lm, "COMMON", 60)
    rng = random.Random(3)
    left, right = ([f"{kind}{i}{'abc'[i % 3]}zz" for i in range(150)] for kind in "lr")
    texts = [" ".join(rng.choice((left, right)[k % 2][: 10 if rng.random() < 0.5 else None]) for k in range(60)) for _ in range(300)]
    docs = frame(spark, texts)
    train = docs.filter(brown_lm.train_row())
    counts = brown_lm.word_counts(train)
    model = brown_lm.fit(train, counts)
    of = {r.word: r.of for r in model["words"].collect()}
    kinds = []
    for side in (left, right):
        raw = " ".join(side).encode()
        data = np.frombuffer(raw, np.uint8)
        start, end, _ = kernels.words(data, np.array([0, len(raw)]))
        kinds.append(Counter(of[int(h)] for h in kernels.word_hashes(data, start, end).view(np.int64)))
    assert sum(max(kinds[0][g], kinds[1][g]) for g in kinds[0] | kinds[1]) > 0.95 * 300
    # the score is the path through the classes, whether words were sent along or looked up
    row = next(r for r in brown_lm.score_corpus(docs).collect() if r.doc_id == 0)
    raw = texts[0].encode()
    data = np.frombuffer(raw, np.uint8)
    start, end, _ = kernels.words(data, np.array([0, len(raw)]))
    c = {r.word: r.n for r in counts.collect()}
    hashes = [*kernels.word_hashes(data, start, end).view(np.int64).tolist(), int(np.array([brown_lm._END]).view(np.int64)[0])]
    cls = [len(model["step"]) - 1, *(of[h] for h in hashes)]
    assert row.score == pytest.approx(sum(math.log10(c[h] + 1) for h in hashes) + sum(model["step"][a, b] for a, b in zip(cls, cls[1:])))


def test_best_classes_follow_exchange():
    rng = np.random.default_rng(2)
    kinds, classes = 30, 5
    table, of = rng.poisson(3, (kinds, kinds)).astype(float), np.append(np.arange(kinds - 1) % (classes - 1), classes - 1)

    def likelihood(of):
        hot = np.eye(classes)[of]
        return brown_lm._likelihood(hot.T @ table @ hot)

    hot = np.eye(classes)[of]
    alone = np.diag(table)
    row, col = (table @ hot)[:-1], (table.T @ hot)[:-1]
    row[np.arange(kinds - 1), of[:-1]] -= alone[:-1]
    col[np.arange(kinds - 1), of[:-1]] -= alone[:-1]
    got = brown_lm.best_classes(of[:-1], row, col, alone[:-1], hot.T @ table @ hot)
    for i in range(kinds - 1):
        to = [likelihood(np.where(np.arange(kinds) == i, g, of)) for g in range(classes - 1)]
        assert to[got[i]] == pytest.approx(max(to), abs=1e-6)


# ---- 7: BPE


def test_bpe_equals_the_library(spark):
    public = pytest.importorskip("public_tokenizers")
    tokenizers = pytest.importorskip("tokenizers")
    path = public.path("byte_bpe_50k.json")
    lib = tokenizers.Tokenizer.from_file(path)
    rng = random.Random(1)
    texts = corpus(14, 30) + ["<|endoftext|>a <|endoftext|>", "I'll don't 12³½ x", "日本語 テスト\u200b", "  a   b \n\n", "a" * 3000]
    texts += ["".join(rng.choice(" \n\t.'abcdestlmreéü1290-\u3000\xa0🙂\x85") for _ in range(rng.randint(1, 60))) for _ in range(200)]
    rows = {r.doc_id: r for r in bpe.encode(frame(spark, texts), path).collect()}
    for i, t in enumerate(texts):
        ids = lib.encode(t or "", add_special_tokens=False).ids
        assert rows[i].ids == ids and rows[i].n_tokens == len(ids)
        assert rows[i].ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert rows[i].decoded_sha256 == hashlib.sha256(lib.decode(ids, skip_special_tokens=False).encode()).hexdigest()
    back = bpe.decode(bpe.encode(frame(spark, texts), path), path).collect()
    assert all(r.decoded == (texts[r.doc_id] or "") for r in back)


# ---- 9: top-k


def test_top_k(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(0, 0.2, (130, 12)).astype(np.float32)
    x[40:60] = x[40]  # ties
    rows = [(i, [float(v) for v in r]) for i, r in enumerate(x)] + [(200, None), (201, [float("nan")] * 12), (202, [None] * 12), (203, [0.5] * 5), (None, [1.0] * 12), (3, [float(v) for v in x[3]])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = topk.top_k(df, df.filter("vec_id % 50 = 0"), k=5, tile=30, query_tile=2).collect()
    ids = {i: np.pad(np.floor(256 * np.array(r, dtype=np.float32).astype(float)).astype(int), (0, 12 - len(r))) for i, r in rows if i is not None and r is not None and all(v is not None and math.isfinite(v) for v in r)}
    want = []
    for q in (i for i in ids if i % 50 == 0):
        best = sorted(((-int(ids[q] @ ids[c]), c) for c in ids if c != q))[:5]
        want += [(q, k + 1, c, -s) for k, (s, c) in enumerate(best)]
    assert sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in got) == sorted(want)


# ---- 10: URL filters


def test_url_filter(spark):
    urls = ["http://a.net/x", "https://EXAMPLE.net/en/1?q", "http://www.example.com/de/", "http://example.com", "x.org/fr/a", None, "", "ftp://b.org/fr/z#y", "http://org/fr/", "http://netx/", "http://a.net?/", "http://.net/", "http://x.example.net/EN/", "a://b://c.net/d"]
    pages = spark.createDataFrame([(i, u, "h") for i, u in enumerate([*urls, urls[0]])] + [(0, urls[0], "h")], "page_id long, url string, html string")
    rules = spark.createDataFrame(url_filter.RULES, "host string, path string, verdict string")
    rows = url_filter.filter_urls(pages, rules).collect()
    assert len(rows) == len(urls) + 2
    for r in rows:
        u = [*urls, urls[0]][r.page_id] or ""
        rest = u.split("://", 1)[1] if "://" in u else ""
        host = re.match("[^/?#]*", rest)[0]
        path = re.match("[^?#]*", rest[len(host) :])[0]
        host = "".join(c.lower() if "A" <= c <= "Z" else c for c in host)
        fit = [(len(h + p), h + p, v) for h, p, v in url_filter.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
        rule, verdict = max(fit)[1:] if fit else (None, "allow")
        assert (r.host, r.path, r.rule, r.verdict) == (host, path, rule, verdict), u
    assert {r.verdict for r in url_filter.filter_urls(pages, rules.limit(0), default="block").collect()} == {"block"}


def test_index_reads_less_than_half_and_stops():
    import duckdb

    rows = duckdb.sql("SELECT vec_id, embedding FROM '/root/testdata/sf0.1/embeddings.parquet' WHERE vec_id IS NOT NULL").fetchall()
    rows = [r for r in rows if r[1] is not None and len(r[1]) == 64]
    ids, x = np.array([r[0] for r in rows]), np.floor(np.array([r[1] for r in rows], float) * 256).astype(np.int64)
    asked = np.flatnonzero(ids % 50 == 0)
    q, vec, score, read = topk.read_tile(topk.build_tile(ids, x), ids[asked], x[asked], np.full(len(asked), -np.inf), 5)
    assert read < 0.5 * len(asked) * x.size
    for i in asked[:20]:
        exact = x @ x[i]
        want = [int(k) for k in np.lexsort((ids, -exact)) if ids[k] != ids[i]][:5]
        mine = q == ids[i]
        assert vec[mine].tolist() == ids[want].tolist() and score[mine].tolist() == exact[want].tolist()


def test_machine_learns_a_pair_that_no_term_shows():
    rng, rows = np.random.default_rng(0), []
    for _ in range(2000):
        a, b = rng.integers(0, 2, 2)
        words = [f"f{rng.integers(0, 300)}" for _ in range(20)] + [("alpha", "gamma")[a], ("delta", "kappa")[b]]
        rows.append((float(a != b), " ".join(words)))
    text = pa.array([r[1] for r in rows])
    (offs, ids), = list(toxicity._present([pa.RecordBatch.from_arrays([text], names=["text"])]))
    model = toxicity.fit_machine(offs.astype(np.int64), ids, np.array([r[0] for r in rows]))
    got = toxicity._scores(model, text)
    assert ((got >= 0.5) == np.array([r[0] for r in rows], bool)).mean() > 0.97
    # the pair part, summed pair by pair
    place = {int(k): i for i, k in enumerate(model["ids"])}
    for i in range(20):
        at = [place[k] for k in ids[offs[i] : offs[i + 1]].tolist() if k in place]
        z = model["w0"] + sum(model["w"][k] for k in at) + sum(model["v"][j] @ model["v"][k] for n, j in enumerate(at) for k in at[n + 1 :])
        assert got[i] == pytest.approx(1 / (1 + math.exp(-z)))


def test_mix_follows_the_points_of_the_schedule(spark):
    rng = random.Random(5)
    rows = [(i, prose(rng, 300), "abc"[i % 3]) for i in range(90)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = {r.doc_id: r for r in mixing.mix(docs, block=100).collect()}
    targets = mixing.source_targets(spark.createDataFrame([(s, sum(300 for r in rows if r[2] == s)) for s in "abc"], "source string, size long"))
    slots = {(r.source, r.rank): r.slot for r in mixing.schedule(targets, 100).collect()}
    cum, need = [], []
    for s in "abc":
        need.append(sum(1 for k in slots if k[0] == s))
        cum.append(sum(need))
    for (source, _), slot in slots.items():  # each slot's point lies in its source's share
        if slot < cum[-1]:
            u, i = slot * mixing.PHI % 1, "abc".index(source)
            assert (cum[i] - need[i]) / cum[-1] <= u < cum[i] / cum[-1]
    first = {s: min(got[r[0]].slot for r in rows if r[2] == s and got[r[0]].taken) for s in "abc"}
    assert first == {s: slots[s, 0] for s in "abc"}


def test_clashing_names_and_repeated_rows(spark):
    rng = random.Random(8)
    rows = [(i // 2, prose(rng, 60) if i % 4 else "same text " * 30, "s", 1, "x", 0.5) for i in range(12)] + [(None, None, None, None, None, None)] * 2
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, rid int, node string, score double")
    assert suffix_array.suffix_dedup(docs).count() == 14 and substring.substring_dedup(docs).count() == 14 and jaccard.jaccard_components(docs).count() == 14
    assert mixing.mix(docs).count() == 14 and brown_lm.score_corpus(docs).count() == 14
    labels = spark.createDataFrame([(0, 1, 0), (1, 0, 1)], "doc_id long, quality int, toxic int")
    assert toxicity.toxicity(docs, labels).count() == 14 and quality_rules.quality_rules(docs, labels).count() == 14
    with pytest.raises(ValueError):
        substring.substring_dedup(docs.withColumnRenamed("node", "n_words"), carry=("n_words",))
    with pytest.raises(ValueError):
        quality_rules.text_stats(docs.withColumnRenamed("node", "_w"))
