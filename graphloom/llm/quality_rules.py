"""Quality rules with risk-controlled thresholds, in DataFrame functions only.

Metrics come from one projection of the text. Each rule rejects a document
when its metric lies beyond a cutoff. For every stratum and rule the cutoffs
of a grid are tested on labelled good documents in a fixed sequence, from the
mildest to the strictest: a cutoff is certified when the exact binomial test
(the Clopper-Pearson bound) shows that it, and all milder ones, reject less than
ALPHA of the good ones. Testing stops at the first failure, so one level serves
a whole sequence; it is corrected for all strata and rules (Bonferroni). The
strictest certified cutoff is applied; where none is certified a rule rejects
nothing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.llm.common import WHITE, words_of
from graphloom.plans.scratch import Scratch

SYMBOLS = "#*$%&|<>"
MIN_WORDS, WINDOW = 10, 5
#: False rejections allowed to each rule, and the error level shared by all tests.
ALPHA, DELTA = 0.02, 0.05
#: rule -> (metric, cutoffs from the mildest to the strictest); a document fails when metric > cutoff.
RULES = {
    "symbols": ("n_symbols / n_words", (1.0, 0.8, 0.6, 0.4, 0.3, 0.2, 0.1, 0.05)),
    "lines": ("n_dup_lines / n_words", (0.1, 0.08, 0.06, 0.04, 0.02, 0.01, 0.005)),
    "repeats": ("n_repeat_words / n_words", (0.18, 0.16, 0.14, 0.12, 0.1, 0.08, 0.06, 0.04)),
    "long_words": ("word_chars / n_words", (14.0, 12.0, 10.0, 9.0, 8.0, 7.5, 7.0, 6.5)),
}


def metrics(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """(id, keep..., n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words), one row for each of docs.

    Null and empty texts count nothing. Windows are found by their 64-bit
    hashes, sorted within the document's own row: no shuffle, and time in
    proportion to n log n for very long texts.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    df = docs.select(F.col(id_col).alias("_id"), *[F.col(c).alias(f"_k_{c}") for c in keep], text.alias("_t"), words_of(F.col(text_col)).alias("_w"))
    lines = F.filter(F.split("_t", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    df = df.select(
        "_id", *[f"_k_{c}" for c in keep],
        F.size("_w").alias("_n"),
        F.length(F.translate("_t", WHITE, "")).cast("long").alias("word_chars"),
        (F.length("_t") - F.length(F.translate("_t", SYMBOLS, ""))).cast("long").alias("n_symbols"),
        lines.alias("_l"),
        F.transform("_w", lambda w: F.xxhash64(w)).alias("_h"),
    )
    window = lambda i: F.xxhash64(*[F.get("_h", i + j) for j in range(WINDOW)])
    none = F.array().cast("array<bigint>")
    df = df.withColumn("_win", F.when(F.col("_n") >= WINDOW, F.transform(F.sequence(F.lit(0), F.col("_n") - WINDOW), window)).otherwise(none))
    df = df.withColumn("_dup", F.size("_win") > F.size(F.array_distinct("_win")))
    marked = F.sort_array(F.transform("_win", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    df = df.withColumn("_s", F.when(F.col("_dup"), marked))
    twice = F.filter(F.transform("_s", lambda x, i: F.when((F.get("_s", i - 1)["h"] == x["h"]) | (F.get("_s", i + 1)["h"] == x["h"]), x["i"])), lambda i: i.isNotNull())
    df = df.withColumn("_at", F.sort_array(twice))
    covered = F.aggregate(F.transform("_at", lambda x, i: F.least(F.lit(WINDOW), F.coalesce(F.get("_at", i + 1) - x, F.lit(WINDOW)))), F.lit(0).cast("long"), lambda s, x: s + x)
    return df.select(
        F.col("_id").alias(id_col), *[F.col(f"_k_{c}").alias(c) for c in keep],
        F.col("_n").cast("long").alias("n_words"), "word_chars", "n_symbols",
        (F.size("_l") - F.size(F.array_distinct("_l"))).cast("long").alias("n_dup_lines"),
        F.when(F.col("_dup"), covered).otherwise(F.lit(0)).cast("long").alias("n_repeat_words"),
    )


def base_failed() -> Column:
    return (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))


def log_binomial_cdf(k: Column, n: Column, p: float) -> Column:
    """log P(Bin(n, p) <= k), by adding terms in logarithms from 0 to k."""
    step = F.log(F.lit(p / (1 - p)))

    def add(s, i):
        term = s["term"] + F.log((n - i + 1) / i) + step
        top = F.greatest(s["total"], term)
        return F.struct(term.alias("term"), (top + F.log(F.exp(s["total"] - top) + F.exp(term - top))).alias("total"))

    first = n * F.log(F.lit(1 - p))
    some = F.filter(F.sequence(F.lit(0).cast("long"), k), lambda i: i > 0)
    return F.aggregate(some, F.struct(first.alias("term"), first.alias("total")), add)["total"]


def certified(good: DataFrame, rules: dict = RULES, alpha: float = ALPHA, delta: float = DELTA) -> DataFrame:
    """(stratum, rule -> cutoff as one column a rule) from good(stratum, metrics...); null where none is certified.

    Only counts by stratum leave the tasks: one row for each stratum.
    """
    tests = [(r, c) for r, (_, cuts) in rules.items() for c in cuts]
    fails = lambda r, c: F.expr(f"try_divide(cast({rules[r][0].split(' / ')[0]} as double), {rules[r][0].split(' / ')[1]})") > c
    counts = good.groupBy("stratum").agg(F.count("*").alias("n"), *[F.count_if(fails(r, c)).alias(f"k{i}") for i, (r, c) in enumerate(tests)])
    strata = counts.agg(F.count("*")).first()[0]
    level = F.log(F.lit(delta / max(1, strata * len(rules))))
    # k beyond n * alpha can't pass; its sum is not needed
    passes = lambda i: F.when(F.col(f"k{i}") <= alpha * F.col("n"), log_binomial_cdf(F.col(f"k{i}"), F.col("n"), alpha) <= level).otherwise(False)
    # a stricter cutoff rejects what a milder one does and more, so one that passes has all milder ones passed
    pick = {r: F.least(*[F.when(passes(i), F.lit(c)) for i, (q, c) in enumerate(tests) if q == r]) for r in rules}
    return counts.select("stratum", *[v.alias(f"cut_{r}") for r, v in pick.items()])


def judge(docs: DataFrame, labels: DataFrame, scratch: Scratch, stratum: str = "lang", rules: dict = RULES) -> DataFrame:
    """Metrics, base_failed and kept for every row of docs.

    labels(doc_id, quality): documents marked 1 are the good ones; a document
    marked more than once counts if all its marks are 1. Strata come from the
    column ``stratum`` (null is a stratum). Null and empty texts fail the base;
    null ids are judged like others, repeated rows alike. Other columns of docs
    are ignored; an empty table gives none.
    """
    name = F.coalesce(F.col(stratum), F.lit("\x00"))
    # narrow, written once: the texts are read and cut a single time
    df = scratch.save(metrics(docs, keep=(stratum,)).withColumn("_stratum", name))
    good_ids = labels.filter("quality is not null").groupBy("doc_id").agg(F.min("quality").alias("_q")).filter("_q = 1").select("doc_id")
    good = df.join(good_ids, "doc_id", "left_semi").filter(~base_failed()).withColumn("stratum", F.col("_stratum"))
    cuts = certified(good, rules).withColumnRenamed("stratum", "_s")
    df = df.join(scratch.save(cuts), F.col("_stratum") == F.col("_s"), "left")  # one row a stratum
    failed = F.lit(False)
    for r, (metric, _) in rules.items():
        a, b = metric.split(" / ")
        failed = failed | F.coalesce(F.expr(f"try_divide(cast({a} as double), {b})") > F.col(f"cut_{r}"), F.lit(False))
    return df.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", base_failed().alias("base_failed"), (~base_failed() & ~failed).alias("kept"))


def oracle() -> str:
    """Metrics, certified cutoffs and verdicts in DuckDB SQL over `documents` and `labels`."""
    cls = r"[^\x20\x09-\x0D]"
    tests = ", ".join(f"('{r}', {c})" for r, (_, cuts) in RULES.items() for c in cuts)
    value = "CASE rule " + " ".join(f"WHEN '{r}' THEN {m.replace(' / ', ' / nullif(')}, 0)" for r, (m, _) in RULES.items()) + " END"
    return f"""
WITH d AS (SELECT row_number() OVER () rid, doc_id, coalesce(lang, chr(1)) lang, coalesce(text, '') t FROM documents),
w AS (SELECT rid, doc_id, lang, t, regexp_extract_all(t, '{cls}+') ws, list_filter(string_split(t, chr(10)), lambda l: regexp_matches(l, '{cls}')) ls FROM d),
g AS (SELECT rid, ws[i:i + 4] win, i FROM (SELECT rid, ws, unnest(range(1, len(ws) - {WINDOW} + 2)) i FROM w WHERE len(ws) >= {WINDOW})),
rep AS (SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, win) c FROM g) WHERE c > 1),
cov AS (SELECT rid, CAST(sum(least({WINDOW}, coalesce(nx - i, {WINDOW}))) AS BIGINT) n FROM (SELECT rid, i, lead(i) OVER (PARTITION BY rid ORDER BY i) nx FROM rep) GROUP BY rid),
m AS (SELECT doc_id, lang, CAST(len(ws) AS BIGINT) n_words, CAST(length(regexp_replace(t, '[\x20\x09-\x0D]+', '', 'g')) AS BIGINT) word_chars,
  CAST(length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS BIGINT) n_symbols, CAST(len(ls) - len(list_distinct(ls)) AS BIGINT) n_dup_lines, coalesce(cov.n, 0) n_repeat_words FROM w LEFT JOIN cov USING (rid)),
b AS (SELECT *, n_words < {MIN_WORDS} OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM m),
tests(rule, cut) AS (VALUES {tests}),
good AS (SELECT b.* FROM b SEMI JOIN (SELECT doc_id FROM labels WHERE quality IS NOT NULL GROUP BY doc_id HAVING min(quality) = 1) q USING (doc_id) WHERE NOT base_failed),
k AS (SELECT lang, rule, cut, count(*) n, count(*) FILTER (WHERE {value} > cut) k FROM good, tests GROUP BY ALL),
p AS (SELECT *, list_transform(range(0, k + 1), lambda i: lgamma(n + 1) - lgamma(i + 1) - lgamma(n - i + 1) + i * ln({ALPHA}) + (n - i) * ln(1 - {ALPHA})) lp FROM k),
cuts AS (SELECT lang, rule, min(cut) cut FROM p WHERE k <= {ALPHA} * n AND list_max(lp) + ln(list_sum(list_transform(lp, lambda x: exp(x - list_max(lp))))) <= ln({DELTA} / ((SELECT count(DISTINCT lang) FROM good) * {len(RULES)})) GROUP BY lang, rule),
bad AS (SELECT DISTINCT b.doc_id FROM b JOIN cuts USING (lang) WHERE {value} > cut)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND doc_id NOT IN (SELECT doc_id FROM bad) AS kept FROM b"""
