"""Quality rules: a learned decision list over native text statistics.

Statistics are DataFrame expressions. The list is learned by sequential covering: each rule grows as a
conjunction of thresholds by information gain on two thirds of the labelled sample, is pruned on the last
third, and stays if it is precise there. The result is an ordered chain of Spark ``when`` expressions.

Defined results: a null or empty text has no words and fails the base rule; without labels of both classes
the list is empty and keeps what passes the base rule; of several labels of an id the smaller counts; conditions
of equal gain are tried in the order of ``FEATURES``; a very long text is one row (its words and windows are arrays);
repeated rows each keep their row; an empty table gives an empty result; other columns are left out, and
``text_stats`` refuses columns that have the names of its statistics.
"""

from __future__ import annotations

from math import log2

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WORD_GAP = "[\\x20\\x09-\\x0D]+"
SYMBOLS = "#*$%&|<>"
#: Labelled rows that the list is fitted on (a sample by hash of the id; all other statistics cover every row).
FIT_ROWS = 6000
FEATURES = ("n_words", "chars_per_word", "symbol_share", "dup_line_share", "repeat_share", "distinct_share", "upper_share", "digit_share", "punct_share", "words_per_line")


def text_stats(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words and a few shares (``FEATURES``)."""
    made = {"n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "_t", "_w", "_l", "_g", "_s", "_lines", "_distinct", "_upper", "_digit", "_punct", *FEATURES}
    if clash := made & set(docs.columns):
        raise ValueError(f"columns have names of statistics: {sorted(clash)}")
    # A projection for each step: the arrays are computed once and read by later expressions.
    a = docs.withColumn("_t", F.coalesce(F.col(text).cast("string"), F.lit("")))
    a = a.withColumn("_w", F.array_remove(F.split("_t", WORD_GAP, -1), "")).withColumn("_l", F.filter(F.split("_t", "\n", -1), lambda x: x.rlike("[^\\x20\\x09-\\x0D]")))
    a = a.withColumn("n_words", F.size("_w").cast("long"))
    # 3-word windows as (hash, start), sorted: equal windows stand side by side
    a = a.withColumn(
        "_g",
        F.expr("CASE WHEN n_words < 4 THEN array() ELSE sort_array(transform(sequence(0, cast(n_words as int) - 3), i -> struct(xxhash64(_w[i], _w[i+1], _w[i+2]) as h, i as i))) END"),
    )
    a = a.withColumn("_s", F.expr("sort_array(filter(transform(_g, (x, k) -> CASE WHEN (k > 0 AND _g[k-1].h = x.h) OR (k < size(_g) - 1 AND _g[k+1].h = x.h) THEN x.i END), x -> x is not null))"))
    a = a.withColumn("n_repeat_words", F.expr("aggregate(_s, struct(0L as n, -9 as p), (z, x) -> struct(z.n + least(3, x - z.p) as n, x as p), z -> z.n)"))
    chars = lambda keep: F.length(F.regexp_replace("_t", keep, "")).cast("long")
    a = a.withColumns(
        {
            "word_chars": F.length(F.translate("_t", " \t\n\x0b\f\r", "")).cast("long"),
            "n_symbols": (F.length("_t") - F.length(F.translate("_t", SYMBOLS, ""))).cast("long"),
            "n_dup_lines": (F.size("_l") - F.size(F.array_distinct("_l"))).cast("long"),
            "_lines": F.size("_l"),
            "_distinct": F.size(F.array_distinct("_w")),
            "_upper": F.length("_t") - F.length(F.translate("_t", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "")),
            "_digit": F.length("_t") - F.length(F.translate("_t", "0123456789", "")),
            "_punct": F.length("_t") - F.length(F.translate("_t", ".,;:!?()[]{}\"'/\\-_=+@^~`", "")),
        }
    )
    share = lambda n, d: F.round(F.col(n) / F.greatest(F.col(d), F.lit(1)), 6)
    return a.withColumns(
        {
            "chars_per_word": share("word_chars", "n_words"),
            "symbol_share": share("n_symbols", "word_chars"),
            "dup_line_share": share("n_dup_lines", "_lines"),
            "repeat_share": share("n_repeat_words", "n_words"),
            "distinct_share": share("_distinct", "n_words"),
            "upper_share": share("_upper", "word_chars"),
            "digit_share": share("_digit", "word_chars"),
            "punct_share": share("_punct", "word_chars"),
            "words_per_line": share("n_words", "_lines"),
        }
    ).drop("_t", "_w", "_l", "_g", "_s", "_lines", "_distinct", "_upper", "_digit", "_punct")


def learn_decision_list(rows: list[tuple], max_rules: int = 12, max_terms: int = 4, min_precision: float = 0.7) -> list[list[tuple[str, str, float]]]:
    """Rules for class 0, in order; a rule is a list of (feature, ``<=`` or ``>``, threshold).

    ``rows``: (label, *FEATURES). Sets of rows are integers with a bit for each row, so a condition costs a
    bitwise and.
    """
    if not rows or len({r[0] for r in rows}) < 2:
        return []
    n = len(rows)
    bad = sum(1 << i for i in range(n) if rows[i][0] == 0)
    prune = sum(1 << i for i in range(n) if i % 3 == 2)
    grow_all = ((1 << n) - 1) & ~prune
    terms = []
    for k, name in enumerate(FEATURES, 1):
        values = sorted({float(r[k]) for r in rows})
        cuts = values if len(values) <= 48 else sorted({values[len(values) * j // 48] for j in range(48)})
        for cut in cuts[:-1] if len(cuts) > 1 else cuts:
            low = sum(1 << i for i in range(n) if float(rows[i][k]) <= cut)
            terms += [((name, "<=", cut), low), ((name, ">", cut), ((1 << n) - 1) & ~low)]
    left, rules = (1 << n) - 1, []
    count = lambda s: ((s & bad).bit_count(), (s & ~bad).bit_count())
    while len(rules) < max_rules:
        cover, rule = left & grow_all, []
        p0, n0 = count(cover)
        if p0 < 5:
            break
        while n0 and len(rule) < max_terms:  # grow by the gain of FOIL
            best = None
            for term, rows_in in terms:
                p, m = count(cover & rows_in)
                if p >= 3 and (gain := p * (log2(p / (p + m)) - log2(p0 / (p0 + n0)))) > 1e-9 and (best is None or gain > best[0]):
                    best = (gain, term, rows_in, p, m)
            if best is None:
                break
            rule.append((best[1], best[2]))
            cover &= best[2]
            p0, n0 = best[3], best[4]
        while len(rule) > 1:  # prune the last term while the held-back third does not get worse
            worth = []
            for end in (len(rule), len(rule) - 1):
                s = left & prune
                for _, rows_in in rule[:end]:
                    s &= rows_in
                p, m = count(s)
                worth.append((p - m) / (p + m) if p + m else -1)
            if worth[1] < worth[0]:
                break
            rule.pop()
        covered = left
        for _, rows_in in rule:
            covered &= rows_in
        p, m = count(covered & prune)
        all_p, all_m = count(covered)
        if not rule or not all_p or all_p / (all_p + all_m) < min_precision or (p + m and p / (p + m) < min_precision):
            break
        rules.append([t for t, _ in rule])
        left &= ~covered
    return rules


def decision_expression(rules: list[list[tuple[str, str, float]]]) -> Column:
    """The list as a chain of ``when``: 0 from the first rule that holds, 1 if none does."""
    out = None
    for rule in rules:
        hold = F.lit(True)
        for name, op, cut in rule:
            hold = hold & ((F.col(name) <= cut) if op == "<=" else (F.col(name) > cut))
        out = (F if out is None else out).when(hold, F.lit(0))
    return F.lit(1) if out is None else out.otherwise(F.lit(1))


def fit_rules(docs: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS) -> list[list[tuple[str, str, float]]]:
    """Learn from ``fit_rows`` labelled rows of documents at most, taken by hash of id and text; learning holds just those rows."""
    labels = labels.filter("doc_id is not null and quality in (0, 1)").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.min("quality").alias("quality"))
    some = labels.orderBy(F.xxhash64("doc_id"), "doc_id").limit(fit_rows)
    some = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(some), "doc_id")  # at most fit_rows rows
    # an id may stand in many rows: their statistics are computed where they are, and the numbers of ``fit_rows`` rows ordered and taken
    stats = text_stats(some.withColumn("key", F.xxhash64("doc_id", "text"))).select("quality", *FEATURES, "doc_id", "key")
    rows = stats.orderBy("key", "doc_id", *FEATURES, "quality").limit(fit_rows).drop("key").collect()
    return learn_decision_list([tuple(r)[:-1] for r in sorted(rows, key=lambda r: (r.doc_id, tuple(r)))])


def quality_rules(docs: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS) -> DataFrame:
    """One row for each document: doc_id, n_words, the four base statistics, base_failed, verdict (0 or 1), kept."""
    rules = fit_rules(docs, labels, fit_rows)
    out = text_stats(docs.select("doc_id", "text")).withColumn("base_failed", (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words")))
    out = out.withColumn("verdict", decision_expression(rules))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "verdict", (~F.col("base_failed") & (F.col("verdict") == 1)).alias("kept"))
