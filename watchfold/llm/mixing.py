"""Mixing sources to target weights along a curriculum.

Targets: every source asks for its weight's share of all words and stops at `MAX_EPOCHS` times its own size; the excess is
shared again by weight among the others until no source is above. Sources in code-point order, null last, weigh 1, 2, 3, repeating.

Curriculum: a source's sampling weight changes over training time t in [0, 1]. Its schedule is piecewise linear; the integral up to t,
divided by the integral up to 1, is the share of its target that has been asked for by t. A source's documents
stand in a fixed order (by hash of doc_id), one pass after another; the copy whose words are centred on the cumulative
demand c gets the training position t at which the schedule's integral reaches c. Copies centred beyond the target are not taken, so a
source's taken words differ from its target by at most half a document, which may be a long one. The source's document whose
size is nearest to what is missing (or too much) is therefore taken once more (or less) where that brings the source
nearer. Whole documents only are taken. Copies are then range-sorted by position.

Running sums: documents of a source are cut into ranges of the hash, about `RANGE_DOCS` documents each; sums per range are cumulated,
then documents inside a range. No window holds more than a range of a source or one row for each range.

Edge cases: a null or wordless text has size 0 and is taken once, at the position of its place. A null source is a source of its own. Repeated
rows are documents of their own (ordered among themselves by the text's hash, then arbitrarily but alike, being equal). Null
doc_ids are documents. An empty table gives an empty result. Other columns are not read; `mixed` returns all columns.
"""

from __future__ import annotations

from math import ceil

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from watchfold.llm.registry import query, table
from watchfold.session import Scratch

WEIGHTS = (1, 2, 3)
MAX_EPOCHS = 3
RANGE_DOCS = 4096
#: Schedules by weight class: (time, relative weight) knots, linear between them. Light sources fade out, heavy ones come in late.
SCHEDULES = (((0.0, 1.5), (1.0, 0.5)), ((0.0, 1.0), (1.0, 1.0)), ((0.0, 0.5), (0.5, 1.0), (1.0, 1.5)))
HASH_SPAN = 1 << 48


def sizes(text: Column) -> Column:
    """Number of words; null: 0."""
    return F.coalesce(F.regexp_count(text.cast("string"), F.lit("[^\\x20\\x09-\\x0D]+")), F.lit(0)).cast("long")


def _order(doc_id: Column) -> Column:
    """48 bits of the MD5 of doc_id: the fixed order of documents, the same in any engine."""
    return F.conv(F.substr(F.md5(F.coalesce(doc_id.cast("string"), F.lit(""))), F.lit(1), F.lit(12)), 16, 10).cast("long")


def source_places(totals: DataFrame, scratch: Scratch) -> DataFrame:
    """`totals` (one row per source) plus place, from 0 in code-point order, null last, without a one-task sort."""
    dealt = scratch.table(totals.repartitionByRange(F.col("source").isNull(), F.col("source")).withColumn("__part", F.spark_partition_id()))
    before = W.orderBy("__part").rowsBetween(W.unboundedPreceding, -1)
    parts = dealt.groupBy("__part").agg(F.count(F.lit(1)).alias("__n")).select("__part", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__before"))  # one row per partition
    inside = F.row_number().over(W.partitionBy("__part").orderBy(F.col("source").isNull(), "source"))
    return dealt.withColumn("__in", inside).join(parts, "__part").select(*totals.columns, (F.col("__before") + F.col("__in") - 1).alias("place"))


def targets(totals: DataFrame, weights=WEIGHTS, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """(source, source_size, n_docs, place, target) from (source, source_size, n_docs).

    Each round is a one-row sum over the sources; rounds end when no further source is above its limit.
    """
    scratch = Scratch(totals.sparkSession, "targets")
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), (F.col("place") % len(weights) + 1).cast("int"))
    rows = scratch.table(source_places(totals, scratch).withColumn("weight", weight).withColumn("limit", max_epochs * F.col("source_size")))
    whole = rows.agg(F.sum("source_size")).first()[0] or 0
    rate, capped = -1.0, F.lit(False)
    while True:
        free, held = rows.agg(F.sum(F.when(~capped, F.col("weight"))), F.coalesce(F.sum(F.when(capped, F.col("limit"))), F.lit(0))).first()
        new = (whole - held) / free if free else rate
        if new == rate:
            break
        rate, capped = new, F.col("weight") * F.lit(float(new)) >= F.col("limit")
    return rows.select("source", "source_size", "n_docs", "place", F.when(capped, F.col("limit").cast("double")).otherwise(F.col("weight") * F.lit(float(rate))).alias("target"))


def _segments(knots) -> list[tuple[float, float, float, float, float]]:
    """(integral before, integral after, start time, weight at start, slope) of each piece, integrals as shares of the whole."""
    areas = [(t1 - t0) * (w0 + w1) / 2 for (t0, w0), (t1, w1) in zip(knots, knots[1:])]
    out, done = [], 0.0
    for ((t0, w0), (t1, w1)), area in zip(zip(knots, knots[1:]), areas):
        out.append((done / sum(areas), (done + area) / sum(areas), t0, w0 / sum(areas), (w1 - w0) / (t1 - t0) / sum(areas)))
        done += area
    return out


def inverted(share: Column, knots) -> Column:
    """Time at which the schedule's integral reaches `share` of its whole."""
    out = None
    for low, high, t0, w0, slope in reversed(_segments(knots)):
        more = share - F.lit(low)
        # a piece that starts at weight 0 has 0 / 0 at its start, which is t0
        here = F.lit(t0) + (more / F.lit(w0) if slope == 0 else F.coalesce(F.try_divide(2 * more, F.lit(w0) + F.sqrt(F.lit(w0 * w0) + F.lit(2 * slope) * more)), F.lit(0.0)))
        out = here if out is None else F.when(share <= F.lit(high), here).otherwise(out)
    return out


def placed(docs: DataFrame, schedules=SCHEDULES, weights=WEIGHTS, max_epochs: int = MAX_EPOCHS) -> tuple[DataFrame, Scratch]:
    """One row for each document: doc_id, source, size, source_size, target, copies, and positions of its copies."""
    scratch = Scratch(docs.sparkSession, "mixing")
    light = docs.select("doc_id", F.col("source").cast("string").alias("source"), sizes(F.col("text")).alias("size"), _order(F.col("doc_id")).alias("h"),
                        F.xxhash64(F.col("text").cast("string")).alias("tie"), F.monotonically_increasing_id().alias("uid"))
    rows = scratch.table(light)
    totals = rows.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("n_docs"))
    aims = scratch.table(targets(totals, weights, max_epochs))
    met = rows.join(aims.withColumnRenamed("source", "__source"), F.col("source").eqNullSafe(F.col("__source"))).drop("__source")
    ranges = F.ceil(F.col("n_docs") / RANGE_DOCS)
    cut = met.withColumn("range", F.floor(F.col("h") / HASH_SPAN * ranges).cast("long"))
    before = W.partitionBy("place").orderBy("range").rowsBetween(W.unboundedPreceding, -1)
    sums = cut.groupBy("place", "range").agg(F.sum("size").alias("__sum")).select("place", "range", F.coalesce(F.sum("__sum").over(before), F.lit(0)).alias("__before"))
    inside = W.partitionBy("place", "range").orderBy("h", "doc_id", "size", "tie").rowsBetween(W.unboundedPreceding, -1)
    start = F.coalesce(F.sum("size").over(inside), F.lit(0)) + F.col("__before")
    ordered = cut.join(sums, ["place", "range"]).withColumn("start", start).drop("__before")
    # the copy of pass p is centred on (p * source_size + start + size / 2)
    centres = F.transform(F.sequence(F.lit(0), F.lit(max_epochs - 1)), lambda p: p * F.col("source_size") + F.col("start") + F.col("size") / 2)
    passes = F.when(F.col("size") > 0, F.size(F.filter(centres, lambda c: c <= F.col("target")))).otherwise(1)
    first = scratch.table(ordered.withColumn("passes", passes))
    off = scratch.table(first.groupBy("place").agg((F.max("target") - F.sum(F.col("size") * F.col("passes"))).alias("off")))
    gap = F.abs(F.col("size") - F.abs("off"))
    may = (F.col("size") > 0) & (gap < F.abs("off")) & F.when(F.col("off") > 0, F.col("passes") < max_epochs).otherwise(F.col("passes") > 0)
    nearest = F.min(F.struct(gap.alias("gap"), F.col("h"), F.col("uid"), F.signum("off").cast("int").alias("step")))
    # first within a hundredth of a source, so that a source with very many documents is not one task's
    near = first.join(off, "place").where(may).groupBy("place", F.pmod(F.xxhash64("uid"), F.lit(100)).alias("part")).agg(nearest.alias("n"))
    fix = scratch.table(near.groupBy("place").agg(F.min("n").alias("n")).select("place", F.col("n.uid").alias("__uid"), F.col("n.step").alias("__step")))
    final = first.join(fix.withColumnRenamed("place", "__place"), (F.col("place") == F.col("__place")) & (F.col("uid") == F.col("__uid")), "left")
    counted = final.withColumn("copies", F.col("passes") + F.coalesce("__step", F.lit(0)))
    share = lambda c: F.least(F.lit(1.0), F.coalesce(F.try_divide(c, F.col("target")), F.lit(0.0)))
    timed = lambda knots: F.transform(F.slice(centres, F.lit(1), F.col("copies")), lambda c: inverted(share(c), knots))
    kind = F.col("place") % len(schedules)
    times = None
    for k, knots in enumerate(schedules):
        own = timed(knots)
        times = F.when(kind == k, own) if times is None else times.when(kind == k, own)
    return counted.select("doc_id", "source", "size", "source_size", "target", "tie", "copies", times.alias("positions")), scratch


def mixed(docs: DataFrame, schedules=SCHEDULES, weights=WEIGHTS, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """The copies that the mix takes, all columns of `docs`, range-sorted by training position.

    Documents meet their positions by doc_id, source and text hash; repeated rows share theirs in turn.
    """
    found, scratch = placed(docs, schedules, weights, max_epochs)
    keys = ["__id", "__source", "__tie"]
    times = found.select(F.col("doc_id").alias("__id"), F.col("source").alias("__source"), F.col("tie").alias("__tie"), "positions")
    nth = lambda df: df.withColumn("__nth", F.row_number().over(W.partitionBy(*keys).orderBy(F.lit(0))))
    tagged = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("__row"), F.col("doc_id").alias("__id"), F.col("source").cast("string").alias("__source"),
                         F.xxhash64(F.col("text").cast("string")).alias("__tie"))
    right = nth(times).select(*[F.col(k).alias(f"{k}r") for k in keys], F.col("__nth").alias("__nthr"), "positions")
    both = nth(tagged).join(right, [F.col(k).eqNullSafe(F.col(f"{k}r")) for k in keys] + [F.col("__nth") == F.col("__nthr")])
    copies = both.select("__row", F.explode("positions").alias("__position"))
    return copies.repartitionByRange(F.col("__position")).sortWithinPartitions("__position").select("__row.*")


def mixing_sql() -> str:
    """The whole mix in DuckDB SQL: water-filling by sorted limits, running sums, the one correction and the first position."""
    time = "CASE place % 3"
    for k, knots in enumerate(SCHEDULES):
        here = ""
        for low, high, t0, w0, slope in _segments(knots):
            more = f"(share - {low!r}::double)"
            at = f"{t0!r}::double + " + (f"{more} / {w0!r}::double" if slope == 0 else f"2 * {more} / ({w0!r}::double + sqrt({w0 * w0!r}::double + {2 * slope!r}::double * {more}))")
            here += f" WHEN share <= {high!r}::double THEN {at}"
        time += f" WHEN {k} THEN CASE{here} END"
    time += " END"
    return f"""
WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^ \\t-\\r]+'))::bigint AS size,
    ('0x' || substr(md5(coalesce(cast(doc_id AS varchar), '')), 1, 12))::bigint AS h FROM documents),
s AS (SELECT source, sum(size)::bigint AS source_size, row_number() OVER (ORDER BY encode(source) NULLS LAST) - 1 AS place FROM d GROUP BY source),
w AS (SELECT *, place % 3 + 1 AS weight, {MAX_EPOCHS} * source_size AS cap FROM s),
o AS (SELECT *, sum(cap) OVER u - cap AS held, sum(weight) OVER () - (sum(weight) OVER u - weight) AS free, sum(source_size) OVER () AS whole, row_number() OVER u AS nth
    FROM w WINDOW u AS (ORDER BY cap / weight, place)),
r AS (SELECT arg_min((whole - held)::double / free, nth) FILTER (WHERE weight * ((whole - held)::double / free) < cap) AS rate FROM o),
a AS (SELECT w.*, CASE WHEN weight * rate >= cap OR rate IS NULL THEN cap::double ELSE weight * rate END AS target FROM w, r),
c AS (SELECT d.doc_id, d.size, d.h, a.source_size, a.target, a.place,
    sum(d.size) OVER (PARTITION BY a.place ORDER BY d.h, d.doc_id) - d.size + d.size / 2.0::double AS centre FROM d JOIN a ON d.source IS NOT DISTINCT FROM a.source),
p AS (SELECT *, CASE WHEN size > 0 THEN len(list_filter(range({MAX_EPOCHS}), lambda k: k * source_size + centre <= target)) ELSE 1 END AS passes FROM c),
f AS (SELECT *, target - sum(size * passes) OVER (PARTITION BY place) AS gone FROM p),
g AS (SELECT *, row_number() OVER (PARTITION BY place ORDER BY abs(size - abs(gone)), h) AS nth FROM f
    WHERE size > 0 AND abs(size - abs(gone)) < abs(gone) AND CASE WHEN gone > 0 THEN passes < {MAX_EPOCHS} ELSE passes > 0 END),
t AS (SELECT f.*, f.passes + coalesce(CASE WHEN g.gone > 0 THEN 1 ELSE -1 END * (g.nth // g.nth), 0) AS copies,
    CASE WHEN f.target > 0 THEN least(1.0::double, f.centre / f.target) ELSE 0.0::double END AS share
    FROM f LEFT JOIN g ON g.nth = 1 AND f.place = g.place AND f.doc_id = g.doc_id)
SELECT doc_id, size, source_size, target, (size * copies)::bigint AS taken, CASE WHEN copies > 0 THEN {time} END AS first_position FROM t"""


@query("op2_mixing", mixing_sql())
def op2_mixing(spark, sf_dir):
    found, _ = placed(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).cast("long").alias("taken"), F.get("positions", F.lit(0)).alias("first_position"))
