"""Naive-Bayes pair scoring: four observed factors, one hidden cause."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from watchfold.functions.columns import evaluate_once
from watchfold.operators.assess import lookup

# Expert prior, conditional tables (state, given related, given unrelated) and threshold.
PRIOR = 0.2
THRESHOLD = 0.5
CANDIDATE_WINDOW_US = 120 * 60 * 1_000_000
TABLES = {
    "TimeGap": [("LE_5_MIN", 0.45, 0.04), ("LE_15_MIN", 0.30, 0.08), ("LE_60_MIN", 0.20, 0.38), ("GT_60_MIN", 0.05, 0.50)],
    "Topology": [("SAME_SERVER", 0.25, 0.04), ("SAME_RACK", 0.15, 0.04), ("SAME_ZONE", 0.40, 0.25), ("DEPENDENCY", 0.15, 0.17), ("UNRELATED", 0.05, 0.50)],
    "DomainMechanism": [("KNOWN", 0.65, 0.30), ("POSSIBLE", 0.28, 0.40), ("UNLIKELY", 0.07, 0.30)],
    "EvidenceStrength": [("BOTH_STRONG", 0.55, 0.20), ("MIXED", 0.35, 0.40), ("BOTH_WEAK", 0.10, 0.40)],
}
FACTORS = list(TABLES)
# Domain pairs by mechanism class (alphabetical inside a pair).
KNOWN = ["ENVIRONMENTAL|MAINTENANCE", "CYBERSECURITY|PHYSICAL_SECURITY", "PHYSICAL_SECURITY|SAFETY"]
POSSIBLE = ["MAINTENANCE|SAFETY", "ENVIRONMENTAL|SAFETY", "ENVIRONMENTAL|PHYSICAL_SECURITY", "MAINTENANCE|PHYSICAL_SECURITY"]
UNLIKELY = ["CYBERSECURITY|ENVIRONMENTAL", "CYBERSECURITY|MAINTENANCE", "CYBERSECURITY|SAFETY"]
# Declared infrastructure dependency (provider zone, provider domains, dependent zones).
DEPENDENCIES = [("ZONE-C", ["ENVIRONMENTAL", "MAINTENANCE"], ["ZONE-A", "ZONE-B"])]
# Evidence strength limits.
STRONG_PROBABILITY, STRONG_CONFIDENCE = 0.70, 0.75
# Spread of the sensitivity noise.
SENSITIVITY_SIGMA = 0.3


def time_gap(seconds: Column) -> Column:
    return (F.when(seconds <= 300, "LE_5_MIN").when(seconds <= 900, "LE_15_MIN").when(seconds <= 3600, "LE_60_MIN").otherwise("GT_60_MIN"))


def depends(zone_a: Column, domain_a: Column, zone_b: Column) -> Column:
    rules = [(zone_a == p) & domain_a.isin(*ds) & zone_b.isin(*zs) for p, ds, zs in DEPENDENCIES]
    return F.coalesce(reduce(lambda a, b: a | b, rules), F.lit(False))


def dependency_pairs(events: DataFrame, rules: DataFrame) -> DataFrame:
    """Zones that depend on each event through a rule table (provider_zone, provider_domains, dependent_zones).

    The rule table is reference data; it joins by provider zone, so no side is broadcast by force."""
    r = rules.select("provider_zone", F.explode("provider_domains").alias("domain"), "dependent_zones")
    r = r.select(F.col("provider_zone").alias("zone_id"), "domain", F.explode("dependent_zones").alias("dependent_zone"))
    return events.join(r, ["zone_id", "domain"])


def topology(l: str, r: str) -> Column:
    same = lambda c: F.coalesce((F.col(f"{l}_{c}") == F.col(f"{r}_{c}")) & (F.col(f"{l}_{c}") != ""), F.lit(False))
    either = depends(F.col(f"{l}_zone_id"), F.col(f"{l}_domain"), F.col(f"{r}_zone_id")) | \
        depends(F.col(f"{r}_zone_id"), F.col(f"{r}_domain"), F.col(f"{l}_zone_id"))
    return (F.when(same("server_id"), "SAME_SERVER").when(same("rack_id"), "SAME_RACK").when(same("zone_id"), "SAME_ZONE")
            .when(either, "DEPENDENCY").otherwise("UNRELATED"))


def mechanism(a: Column, b: Column) -> Column:
    pair = F.concat_ws("|", F.least(a, b), F.greatest(a, b))
    return F.when(pair.isin(*KNOWN), "KNOWN").when(pair.isin(*POSSIBLE), "POSSIBLE").when(pair.isin(*UNLIKELY), "UNLIKELY")


def strong(p: str) -> Column:
    c = lambda n: F.col(f"{p}_{n}")
    yes = (F.when(c("domain") == "CYBERSECURITY", c("state").isin("EXPLICIT_SECURITY_EVENT", "HIGH_CONFIDENCE_ANOMALY"))
           .when(c("domain") == "MAINTENANCE", c("failure_probability") >= STRONG_PROBABILITY)
           .when(c("domain") == "ENVIRONMENTAL", c("state").isin("SMOKE_DETECTED", "WATER_LEAK_DETECTED") | (c("source_class") == "ENVIRONMENTAL_SENSOR"))
           .when(c("domain") == "PHYSICAL_SECURITY", c("authorization") == "UNAUTHORIZED")
           .when(c("domain") == "SAFETY", c("confidence") >= STRONG_CONFIDENCE))
    return F.coalesce(yes, F.lit(False))


def strength_observable(p: str) -> Column:
    c = lambda n: F.col(f"{p}_{n}")
    return (F.when(c("domain") == "SAFETY", c("confidence").isNotNull())
            .when(c("domain") == "MAINTENANCE", c("failure_probability").isNotNull())
            .when(c("domain") == "ENVIRONMENTAL", c("source_class").isNotNull() | c("state").isin("SMOKE_DETECTED", "WATER_LEAK_DETECTED"))
            .otherwise(F.lit(True)))


def evidence_strength(l: str, r: str) -> Column:
    n = strong(l).cast("int") + strong(r).cast("int")
    return F.when(n == 2, "BOTH_STRONG").when(n == 1, "MIXED").otherwise("BOTH_WEAK")


def factors(pairs: DataFrame, l: str = "left", r: str = "right") -> DataFrame:
    return evaluate_once(pairs, {
        "TimeGap": time_gap(F.col("time_difference_seconds")), "Topology": topology(l, r),
        "DomainMechanism": mechanism(F.col(f"{l}_domain"), F.col(f"{r}_domain")), "EvidenceStrength": evidence_strength(l, r)})


def likelihood(factor: str, related: bool) -> Column:
    """Table value of the observed state; 1 when the factor is missing (left out of the product)."""
    return F.coalesce(lookup({s: (y if related else n) for s, y, n in TABLES[factor]}, F.col(factor)), F.lit(1.0))


def posterior(use: list[str] = FACTORS, prior: float = PRIOR) -> Column:
    yes = reduce(lambda a, b: a * b, [likelihood(f, True) for f in use], F.lit(prior))
    no = reduce(lambda a, b: a * b, [likelihood(f, False) for f in use], F.lit(1 - prior))
    return yes / (yes + no)


def contributions() -> Column:
    """Observed factors with likelihood ratio and direction, strongest first."""
    def item(f, place):
        ratio = F.round(lookup({s: y / n for s, y, n in TABLES[f]}, F.col(f)), 3)
        return F.when(F.col(f).isNotNull(), F.struct(
            (-F.abs(F.log(ratio))).alias("order"), F.lit(place).alias("place"), F.lit(f).alias("factor"), F.col(f).alias("observed"), ratio.alias("likelihood_ratio"),
            F.when(ratio > 1, "SUPPORTS").when(ratio < 1, "OPPOSES").otherwise("NEUTRAL").alias("direction")))
    items = F.array_sort(F.array_compact(F.array(*[item(f, i) for i, f in enumerate(FACTORS)])))
    return F.transform(items, lambda x: F.struct(x["factor"].alias("factor"), x["observed"].alias("observed"),
                                                 x["likelihood_ratio"].alias("likelihood_ratio"), x["direction"].alias("direction")))


def score(pairs: DataFrame, use: list[str] = FACTORS) -> DataFrame:
    p = F.col("__posterior")
    return evaluate_once(pairs, {"__posterior": posterior(use)}).withColumns({"probability_related": F.round(p, 4), "correlated": p >= THRESHOLD}).drop("__posterior")


def score_live(pairs: DataFrame) -> DataFrame:
    """Closest-time pairs: strength is left out when either side cannot show it; pairs with an event that is not abnormal are NOT_SCORED."""
    seen = strength_observable("left") & strength_observable("right")
    f = factors(pairs).withColumn("EvidenceStrength", F.when(seen, F.col("EvidenceStrength")))
    p = posterior()
    ok = F.col("left_abnormal") & F.col("right_abnormal")
    return f.withColumns({
        "status": F.when(ok, "RESEARCH_ESTIMATE").otherwise("NOT_SCORED"),
        "probability_related": F.when(ok, F.round(p, 3)), "model_says_related": F.when(ok, p >= THRESHOLD),
        "marginalized": F.when(ok & ~seen, "EvidenceStrength")})


def crisp() -> Column:
    """Baseline rule on a candidate pair: same zone and at most fifteen minutes."""
    return F.coalesce((F.col("left_zone_id") == F.col("right_zone_id")) & (F.col("left_zone_id") != ""), F.lit(False)) & \
        (F.col("time_difference_seconds") <= 900)


def f1(tp: Column, fp: Column, fn: Column) -> Column:
    return F.when(2 * tp + fp + fn > 0, 2 * tp / (2 * tp + fp + fn)).otherwise(F.lit(0.0))


def confusion(flag: Column, truth: Column) -> list[Column]:
    return [F.count_if(flag & truth).alias("tp"), F.count_if(flag & ~truth).alias("fp"), F.count_if(~flag & truth).alias("fn")]


def factor_table(pairs: DataFrame) -> DataFrame:
    """Pairs collapsed to factor combination and truth: at most 360 rows whatever the number of pairs."""
    return pairs.groupBy(*FACTORS, "truth").agg(F.count(F.lit(1)).alias("pairs"))


def _weighted_f1(flag: Column) -> list[Column]:
    n = F.col("pairs")
    tp, fp, fn = (F.sum(F.when(c, n).otherwise(0)) for c in (flag & F.col("truth"), flag & ~F.col("truth"), ~flag & F.col("truth")))
    return [tp.alias("tp"), fp.alias("fp"), fn.alias("fn"), f1(tp, fp, fn).alias("f1")]


def ablation(pairs: DataFrame) -> DataFrame:
    """F1 with each factor left out, from one pass over the collapsed table."""
    variants = F.array(*[F.struct(F.lit(f).alias("dropped_factor"), (posterior([x for x in FACTORS if x != f]) >= THRESHOLD).alias("flag")) for f in FACTORS])
    return (factor_table(pairs).select("truth", "pairs", F.inline(variants)).groupBy("dropped_factor")
            .agg(*_weighted_f1(F.col("flag"))))


def uniform(*parts: Column) -> Column:
    """Reproducible number in (0, 1) from a key."""
    return (F.conv(F.substring(F.md5(F.concat_ws("|", *parts)), 1, 8), 16, 10).cast("double") + 0.5) / 4294967296.0


def sensitivity(pairs: DataFrame, draws: int = 200, seed: int = 7, sigma: float = SENSITIVITY_SIGMA) -> DataFrame:
    """F1 under log-normal noise on the prior and every table entry, renormalised, per draw.

    Works on the collapsed table: draws x at most 360 rows."""
    spark = pairs.sparkSession
    rows = [("Prior", "Yes", "-", PRIOR), ("Prior", "No", "-", 1 - PRIOR)]
    for f, states in TABLES.items():
        rows += [(f, "Yes", s, y) for s, y, _ in states] + [(f, "No", s, n) for s, _, n in states]
    base = spark.createDataFrame(rows, "factor string, side string, state string, p double")
    noisy = base.crossJoin(spark.range(draws).withColumnRenamed("id", "draw"))
    key = [F.lit(seed), F.col("draw"), F.col("factor"), F.col("side"), F.col("state")]
    normal = F.sqrt(-2 * F.ln(uniform(*key, F.lit("a")))) * F.cos(2 * F.pi() * uniform(*key, F.lit("b")))
    noisy = noisy.withColumn("w", F.col("p") * F.exp(F.lit(sigma) * normal))
    group = F.when(F.col("factor") == "Prior", F.lit("Prior")).otherwise(F.concat_ws("/", "factor", "side"))
    totals = noisy.withColumn("g", group).groupBy("draw", "g").agg(F.sum("w").alias("t"))
    table = noisy.withColumn("g", group).join(totals, ["draw", "g"]).select("draw", "factor", "side", "state", (F.col("w") / F.col("t")).alias("q"))
    wide = table.groupBy("draw").agg(F.map_from_entries(F.collect_list(F.struct(F.concat_ws("/", "factor", "side", "state"), "q"))).alias("q"))
    def side_product(side):
        parts = [F.coalesce(F.col("q")[F.concat_ws("/", F.lit(f), F.lit(side), F.col(f))], F.lit(1.0)) for f in FACTORS]
        return reduce(lambda a, b: a * b, parts, F.col("q")[F.lit(f"Prior/{side}/-")])
    joined = factor_table(pairs).crossJoin(wide)
    flag = side_product("Yes") / (side_product("Yes") + side_product("No")) >= THRESHOLD
    return joined.withColumn("flag", flag).groupBy("draw").agg(*_weighted_f1(F.col("flag")))
