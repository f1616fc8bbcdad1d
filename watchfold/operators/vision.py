"""Image detections: spatial association, compliance policy, class balance."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from watchfold.operators import ranks

# Required items and the classes that may belong to a person.
REQUIRED = ["helmet", "safety-vest"]
MINIMUM_CONTAINMENT, CENTRE_BONUS, FACE_CONTAINMENT = 0.50, 0.05, 0.80
CELL = 64.0


def area(x1, y1, x2, y2) -> Column:
    return F.greatest(x2 - x1, F.lit(0.0)) * F.greatest(y2 - y1, F.lit(0.0))


def index_people(detections: DataFrame, person: str = "person") -> DataFrame:
    """People of each image numbered from 0 by (x1, y1)."""
    p = ranks.positions(detections.where(F.col("class_name") == person), ["image_id"], ["x1", "y1", "detection_id"], "person_index")
    return p.select("image_id", "person_index", *[F.col(c).alias(f"p{c}") for c in ("x1", "y1", "x2", "y2")])


def overlapping(items: DataFrame, people: DataFrame, cell: float = CELL) -> DataFrame:
    """Item x person rows whose boxes touch. Both sides are cut into grid cells; a pair is kept only
    in the cell of the lower corner of its overlap, so it appears once and a crowded image spreads."""
    def grid(df, p):
        axis = lambda lo, hi: F.sequence(F.floor(F.col(lo) / cell), F.floor(F.greatest(F.col(lo), F.col(hi)) / cell))
        return df.withColumn("cx", F.explode(axis(f"{p}x1", f"{p}x2"))).withColumn("cy", F.explode(axis(f"{p}y1", f"{p}y2")))
    j = grid(items, "").join(grid(people, "p"), ["image_id", "cx", "cy"])
    corner = lambda a, b: F.floor(F.greatest(a, b) / cell)
    return j.where((corner("x1", "px1") == F.col("cx")) & (corner("y1", "py1") == F.col("cy")) & (F.col("x1") <= F.col("px2")) & (F.col("px1") <= F.col("x2"))
                   & (F.col("y1") <= F.col("py2")) & (F.col("py1") <= F.col("y2"))).drop("cx", "cy")


def containment() -> Column:
    """Share of the item box inside the person box; 0 for an item without area."""
    c = F.col
    inter = area(F.greatest(c("x1"), c("px1")), F.greatest(c("y1"), c("py1")), F.least(c("x2"), c("px2")), F.least(c("y2"), c("py2")))
    own = area(c("x1"), c("y1"), c("x2"), c("y2"))
    return F.when(own > 0, inter / own).otherwise(F.lit(0.0))


def associate_items(detections: DataFrame, associable: list[str], minimum: float = MINIMUM_CONTAINMENT) -> DataFrame:
    """Every item with its person, or the reason it has none. Best score wins, then the lowest person index."""
    items = detections.where(F.col("class_name") != "person")
    wanted = items.where(F.col("class_name").isin(*associable)).select("image_id", "detection_id", "x1", "y1", "x2", "y2")
    cx, cy = (F.col("x1") + F.col("x2")) / 2, (F.col("y1") + F.col("y2")) / 2
    inside = cx.between(F.col("px1"), F.col("px2")) & cy.between(F.col("py1"), F.col("py2"))
    scored = overlapping(wanted, index_people(detections)).withColumn("containment", containment()).where(F.col("containment") >= minimum) \
        .withColumn("score", F.col("containment") + F.when(inside, CENTRE_BONUS).otherwise(0.0))
    best = scored.groupBy("image_id", "detection_id").agg(
        F.min_by(F.struct("person_index", "containment", "score"), F.struct(-F.col("score"), "person_index")).alias("b"))
    return items.join(best, ["image_id", "detection_id"], "left").select(
        "image_id", "detection_id", "class_name", F.col("b.person_index").alias("person_index"), F.col("b.containment").alias("containment"), F.col("b.score").alias("score"),
        F.when(~F.col("class_name").isin(*associable), "CLASS_NOT_ASSOCIABLE").when(F.col("b").isNull(), "NO_PERSON_MATCH").alias("unassigned_reason"))


def person_compliance(detections: DataFrame, associated: DataFrame, required: list[str] = REQUIRED) -> DataFrame:
    """Per person: required classes found and missing, COMPLIANT when none is missing."""
    seen = associated.where("person_index IS NOT NULL").groupBy("image_id", "person_index").agg(F.array_sort(F.collect_set("class_name")).alias("classes"))
    p = index_people(detections).select("image_id", "person_index").join(seen, ["image_id", "person_index"], "left")
    have = F.coalesce("classes", F.array().cast("array<string>"))
    need = F.array(*[F.lit(r) for r in required])
    return p.select("image_id", "person_index", have.alias("classes"), F.array_except(need, have).alias("missing"),
                    F.when(F.size(F.array_except(need, have)) == 0, "COMPLIANT").otherwise("NON_COMPLIANT").alias("status"))


def image_compliance(detections: DataFrame, people: DataFrame) -> DataFrame:
    g = people.groupBy("image_id").agg(F.count(F.lit(1)).alias("person_count"), F.bool_and(F.col("status") == "COMPLIANT").alias("all_ok"))
    return detections.select("image_id").distinct().join(g, "image_id", "left").select(
        "image_id", F.coalesce("person_count", F.lit(0)).alias("person_count"),
        F.when(F.col("person_count").isNull(), "NO_PERSON").when(F.col("all_ok"), "COMPLIANT").otherwise("NON_COMPLIANT").alias("overall_status"))


def unique_face_match(faces: DataFrame, detections: DataFrame, minimum: float = FACE_CONTAINMENT) -> DataFrame:
    """Faces (image_id, detection_id, box, same_bytes, recognized, has_box) held by exactly one person box."""
    usable = faces.where("same_bytes AND recognized AND has_box").select("image_id", "detection_id", "x1", "y1", "x2", "y2")
    hits = overlapping(usable, index_people(detections)).withColumn("containment", containment()).where(F.col("containment") >= minimum)
    g = hits.groupBy("image_id", "detection_id").agg(F.count(F.lit(1)).alias("n"), F.min("person_index").alias("person_index"), F.min("containment").alias("containment"))
    j = faces.join(g, ["image_id", "detection_id"], "left")
    reason = (F.when(~F.col("same_bytes"), "DIFFERENT_SOURCE_IMAGES").when(~F.col("recognized"), "FACE_NOT_RECOGNIZED").when(~F.col("has_box"), "FACE_GEOMETRY_UNAVAILABLE")
              .when(F.col("n") == 1, "UNIQUE_FACE_CONTAINMENT_IN_DETECTED_PERSON").otherwise("FACE_PERSON_OVERLAP_NOT_UNIQUE"))
    usable_row = F.col("same_bytes") & F.col("recognized") & F.col("has_box")
    one = usable_row & (F.col("n") == 1)
    return j.select("image_id", "detection_id", F.when(~usable_row, "NOT_EVALUATED").when(F.col("n") == 1, "MATCH_CANDIDATE").when(F.col("n") > 1, "AMBIGUOUS").otherwise("NO_MATCH").alias("status"),
                    F.when(one, F.col("person_index")).alias("person_index"), F.when(one, F.bround("containment", 4)).alias("containment"), reason.alias("reason"))


def class_counts(detections: DataFrame, by: list[str]) -> DataFrame:
    return detections.groupBy(*by, "class_name").agg(F.count_distinct("image_id").alias("images"), F.count(F.lit(1)).alias("objects"))


def balanced_split(detections: DataFrame, parts: int = 2) -> DataFrame:
    """Images stratified by their rarest class and dealt out in turn inside each stratum.

    The turn is a dense position from range counts, so one stratum may hold most images."""
    counts = class_counts(detections, [])
    rare = (detections.select("image_id", "class_name").distinct().join(counts, "class_name").groupBy("image_id")
            .agg(F.min_by("class_name", F.struct("images", "class_name")).alias("stratum")))
    h = rare.withColumn("__h", F.md5(F.col("image_id").cast("string"))).withColumn("__r", F.substring("__h", 1, 2))
    before = W.partitionBy("stratum").orderBy("__r").rowsBetween(W.unboundedPreceding, -1)
    off = h.groupBy("stratum", "__r").agg(F.count(F.lit(1)).alias("__n")).select("stratum", "__r", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__b"))
    pos = F.row_number().over(W.partitionBy("stratum", "__r").orderBy("__h")) - 1 + F.col("__b")
    return h.join(off, ["stratum", "__r"]).select("image_id", "stratum", (pos % parts).alias("part"))
