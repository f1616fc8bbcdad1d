"""Quality rules whose cut-offs come with a guarantee on wrongly rejected documents.

Each rule is a statistic of the whole text that grows as quality falls, with a fixed list of cut-offs from
lenient to strict. A stratum (the language) takes a cut-off only when a labelled holdout certifies it: of n
documents labelled good, k are above the cut-off, and P(Bin(n, p) <= k) is at most the error level for the
highest allowed rate p. This is the exact (Clopper-Pearson) upper bound on the rate, read as a test. The
error level is divided by the number of (stratum, rule) pairs tested (Bonferroni), a list of cut-offs is tested in
order and ends at its first failure (fixed sequence, no further correction), and the allowed rate is divided
among the rules, so that with probability 1 - `error` no stratum loses more than `rate` of its good documents
to the method. Among certified cut-offs the one with the greatest gain is taken: documents labelled bad
that it rejects, less `COST` for each one labelled good; the most lenient on a tie. Without a gain the rule does not apply there.

Edge cases: a null, empty or wordless text has zero words and fails the base rule (fewer than 50). A null stratum is a
stratum of its own. Strata without labels reject nothing beyond the base rules. Labels with null doc_id or quality are
left out; several labels of one document count as good when one of them is. Repeated rows are judged (and counted) each.
Empty tables give an empty result. Columns other than those named are not read, and `filtered` returns them unchanged.
"""

from __future__ import annotations

from math import exp, lgamma, log, log1p

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from watchfold.llm.registry import query, table
from watchfold.session import Scratch

SPACES, SYMBOLS = " \t\n\x0b\x0c\r", "#*$%&|<>"
MIN_WORDS = 50
#: Highest share of good documents that all rules together may reject in a stratum, and the chance that this fails.
RATE, ERROR = 0.02, 0.05
#: A good document that is rejected weighs as much as so many bad ones that are not.
COST = 10
#: rule: (factor, measure, per measure, cut-offs from lenient to strict)
RULES: dict[str, tuple[float, str, str, list[float]]] = {
    "symbols": (100.0, "n_symbols", "word_chars", [50, 40, 30, 25, 20, 15, 12, 10, 8, 6, 5]),
    "dup_lines": (100.0, "n_dup_lines", "n_lines", [90, 80, 70, 60, 50, 40, 30, 25, 20]),
    "repeats": (100.0, "n_repeat_words", "n_words", [48, 45, 40, 35, 30, 25, 20]),
    "long_words": (1.0, "word_chars", "n_words", [30, 25, 20, 16, 14, 12, 11, 10]),
}
MEASURES = "n_words long, word_chars long, n_symbols long, n_lines long, n_dup_lines long, n_repeat_words long"


def measures(text: str | None) -> tuple[int, int, int, int, int, int]:
    """Counts over one whole text, in the order of MEASURES."""
    if not text:
        return 0, 0, 0, 0, 0, 0
    words = text.encode("utf-8", "surrogatepass").split()  # bytes.split knows ASCII spaces only
    n_chars = len(text) - sum(map(text.count, SPACES))
    lines = [x for x in text.split("\n") if x.strip(SPACES)]
    n, seen, again = len(words), set(), set()
    windows = list(zip(words, words[1:], words[2:]))
    if len(set(windows)) < len(windows):
        for w in windows:
            (again if w in seen else seen).add(w)
    repeated, covered = 0, 0
    if again:
        for at, w in enumerate(windows):
            if w in again:
                repeated += at + 3 - max(covered, at)
                covered = at + 3
    return n, n_chars, sum(map(text.count, SYMBOLS)), len(lines), len(lines) - len(set(lines)), repeated


def _measure_array(texts: pa.Array) -> pa.Array:
    rows = np.array([measures(t.as_py()) for t in texts], dtype=np.int64).reshape(-1, 6)  # one text at a time in Python
    return pa.StructArray.from_arrays([pa.array(c) for c in rows.T.copy()], [c.split()[0] for c in MEASURES.split(", ")])


def measured(docs: DataFrame, text: str = "text") -> DataFrame:
    """`docs` with a column `__m` of the measures of `text`."""
    return docs.withColumn("__m", F.arrow_udf(_measure_array, MEASURES)(F.col(text).cast("string")))


def binomial_cdf(k: int, n: int, p: float) -> float:
    """P(Bin(n, p) <= k), summed from k down until terms no longer count; 1 from the mean on (an upper bound)."""
    if k >= n * p:
        return 1.0
    term = exp(lgamma(n + 1) - lgamma(k + 1) - lgamma(n - k + 1) + k * log(p) + (n - k) * log1p(-p))
    total = term
    while k > 0 and term > total * 1e-17:
        term *= k * (1 - p) / ((n - k + 1) * p)
        total += term
        k -= 1
    return min(1.0, total)


def _cdf_series(k: pd.Series, n: pd.Series, p: pd.Series) -> pd.Series:
    return pd.Series([binomial_cdf(*x) for x in zip(k, n, p)], dtype="float64")


def _statistic(rule: str) -> Column:
    factor, part, whole, _ = RULES[rule]
    return F.coalesce(F.try_divide(F.lit(factor) * F.col(f"__m.{part}"), F.col(f"__m.{whole}").cast("double")), F.lit(0.0))


def certified_cutoffs(rows: DataFrame, labels: DataFrame, rate: float = RATE, error: float = ERROR) -> DataFrame:
    """(stratum, a column for each rule): the chosen cut-offs, null where a rule does not apply.

    rows: doc_id, stratum, __m. Strata where no rule applies have no row.
    """
    truth = (labels.where("doc_id IS NOT NULL AND quality IS NOT NULL").groupBy("doc_id").agg(F.max(F.col("quality").cast("int")).alias("good"))
             .withColumnRenamed("doc_id", "__labelled"))
    counted = rows.join(truth, rows["doc_id"] == truth["__labelled"]).select("stratum", "good", *[_statistic(r).alias(r) for r in RULES])
    sums = [F.sum("good").alias("n")]
    for r, (*_, cuts) in RULES.items():
        for c, cut in enumerate(cuts):
            sums += [F.count_if((F.col(r) > cut) & (F.col("good") == g)).alias(f"{r}_{c}_{g}") for g in (0, 1)]
    by_stratum = counted.groupBy("stratum").agg(*sums)
    tests = F.array(*[F.struct(F.lit(r).alias("rule"), F.lit(c).alias("step"), F.lit(float(cut)).alias("cut"), F.col(f"{r}_{c}_1").alias("k"), F.col(f"{r}_{c}_0").alias("bad"))
                      for r, (*_, cuts) in RULES.items() for c, cut in enumerate(cuts)])
    strata = by_stratum.agg(F.count(F.lit(1)).alias("strata"))
    each = by_stratum.select("stratum", "n", F.explode(tests).alias("t")).select("stratum", "n", "t.*").crossJoin(F.broadcast(strata))  # one row
    level = F.lit(error / len(RULES)) / F.col("strata")
    passed = F.pandas_udf(_cdf_series, "double")(F.col("k"), F.col("n"), F.lit(rate / len(RULES))) <= level
    upto = W.partitionBy("stratum", "rule").orderBy("step")
    sound = each.withColumn("passed", passed).withColumn("certified", F.min("passed").over(upto)).withColumn("gain", F.col("bad") - COST * F.col("k")).where("certified AND gain > 0")
    best = sound.groupBy("stratum", "rule").agg(F.max(F.struct("gain", (-F.col("step")).alias("lenient"), "cut"))["cut"].alias("cut"))
    chosen = best.groupBy("stratum").agg(*[F.max(F.when(F.col("rule") == r, F.col("cut"))).alias(r) for r in RULES])
    return chosen


def judged(rows: DataFrame, cutoffs: DataFrame) -> DataFrame:
    """`rows` (with stratum and __m) plus base_failed and kept. A cut-off table below Spark's broadcast limit is broadcast."""
    base = (F.col("__m.n_words") < MIN_WORDS) | (100 * F.col("__m.n_repeat_words") > 50 * F.col("__m.n_words"))
    cuts = cutoffs.select(F.col("stratum").alias("__stratum"), *[F.col(r).alias(f"__{r}") for r in RULES])
    above = [F.coalesce(_statistic(r) > F.col(f"__{r}"), F.lit(False)) for r in RULES]
    worst = above[0]
    for a in above[1:]:
        worst = worst | a
    met = rows.join(cuts, F.col("stratum").eqNullSafe(F.col("__stratum")), "left")
    return met.withColumn("base_failed", base).withColumn("kept", ~F.col("base_failed") & ~worst).drop("__stratum", *[f"__{r}" for r in RULES])


def decisions(docs: DataFrame, labels: DataFrame, stratum: str = "lang", rate: float = RATE, error: float = ERROR) -> DataFrame:
    """(doc_id, stratum, __m, base_failed, kept) for every row."""
    scratch = Scratch(docs.sparkSession, "quality")
    rows = scratch.table(measured(docs.select("doc_id", F.col(stratum).alias("stratum"), "text")).drop("text"))
    return judged(rows, scratch.table(certified_cutoffs(rows, labels, rate, error)))


def filtered(docs: DataFrame, labels: DataFrame, stratum: str = "lang", rate: float = RATE, error: float = ERROR) -> DataFrame:
    """The rows of `docs` that are kept, all columns as they are."""
    scratch = Scratch(docs.sparkSession, "quality")
    rows = measured(docs.select("doc_id", F.col(stratum).alias("stratum"), "text")).drop("text")
    cutoffs = scratch.table(certified_cutoffs(rows, labels, rate, error))
    whole = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("__row"), F.col(stratum).alias("stratum"))
    return judged(measured(whole, "__row.text"), cutoffs).where("kept").select("__row.*")


def quality_sql(rate: float = RATE, error: float = ERROR) -> str:
    """Measures, exact binomial tests, choice of cut-offs and verdict in DuckDB SQL."""
    cuts = ", ".join(f"('{r}', {k}, {float(c)})" for r, (*_, cs) in RULES.items() for k, c in enumerate(cs))
    stats = ", ".join(f"coalesce({factor}::double * {a} / nullif({b}, 0)::double, 0) AS {r}" for r, (factor, a, b, _) in RULES.items())
    value = "CASE rule " + " ".join(f"WHEN '{r}' THEN {r}" for r in RULES) + " END"
    p = rate / len(RULES)
    return f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, lang, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^ \\t-\\r]+') AS w FROM documents),
win AS (SELECT rid, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS x FROM (SELECT rid, w, unnest(range(1, len(w) - 1)) AS i FROM d)),
cov AS (SELECT rid, count(DISTINCT i + k) AS n FROM (SELECT *, count(*) OVER (PARTITION BY rid, x) AS c FROM win), range(0, 3) r(k) WHERE c > 1 GROUP BY 1),
lines AS (SELECT rid, count(*) AS n, count(*) - count(DISTINCT l) AS dup FROM (SELECT rid, unnest(string_split(t, chr(10))) AS l FROM d) WHERE regexp_matches(l, '[^ \\t-\\r]') GROUP BY 1),
m AS (SELECT d.rid, doc_id, lang, len(w)::bigint AS n_words, coalesce(list_sum(list_transform(w, lambda x: length(x))), 0)::bigint AS word_chars,
    len(regexp_extract_all(t, '[#*$%&|<>]'))::bigint AS n_symbols, coalesce(lines.n, 0)::bigint AS n_lines, coalesce(lines.dup, 0)::bigint AS n_dup_lines, coalesce(cov.n, 0)::bigint AS n_repeat_words
    FROM d LEFT JOIN lines ON lines.rid = d.rid LEFT JOIN cov ON cov.rid = d.rid),
s AS (SELECT *, {stats}, n_words < {MIN_WORDS} OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM m),
truth AS (SELECT doc_id, max(quality) AS good FROM labels WHERE doc_id IS NOT NULL AND quality IS NOT NULL GROUP BY 1),
lab AS (SELECT s.*, good FROM s JOIN truth ON s.doc_id = truth.doc_id),
strata AS (SELECT count(*) AS strata FROM (SELECT DISTINCT lang FROM lab)),
cuts(rule, step, cut) AS (VALUES {cuts}),
tests AS (SELECT lang, rule, step, cut, sum(good) AS n, count(*) FILTER ({value} > cut AND good = 1) AS k, count(*) FILTER ({value} > cut AND good = 0) AS bad FROM lab, cuts GROUP BY ALL),
cdf AS (SELECT *, CASE WHEN k >= n * {p!r}::double THEN 1 ELSE list_sum(list_transform(range(0, k + 1), lambda i: exp(lgamma(n + 1) - lgamma(i + 1) - lgamma(n - i + 1) + i * ln({p!r}::double) + (n - i) * ln(1 - {p!r}::double)))) END AS tail FROM tests),
certified AS (SELECT *, bool_and(tail <= {error / len(RULES)!r}::double / strata) OVER (PARTITION BY lang, rule ORDER BY step) AS certified FROM cdf, strata),
chosen AS (SELECT lang, rule, arg_max(cut, (bad - {COST} * k, -step)) AS cut FROM certified WHERE certified AND bad - {COST} * k > 0 GROUP BY 1, 2),
hit AS (SELECT DISTINCT rid FROM s JOIN chosen ON s.lang IS NOT DISTINCT FROM chosen.lang WHERE {value} > cut)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND hit.rid IS NULL AS kept FROM s LEFT JOIN hit ON hit.rid = s.rid"""


@query("op6_quality", quality_sql())
def op6_quality(spark, sf_dir):
    found = decisions(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    counts = [F.col(f"__m.{c}") for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")]
    return found.select("doc_id", *counts, "base_failed", "kept")
