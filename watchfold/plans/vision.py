"""Detection and vector queries."""

from __future__ import annotations

from pyspark.sql import Window as W, functions as F

from watchfold.operators import metrics as M, vectors as X, vision as V
from watchfold.plans.auth import r6
from watchfold.plans.registry import query
from watchfold.sources.tables import load

ASSOCIABLE = ["helmet", "safety-vest", "gloves"]


def detections(spark, sf):
    """One box per order line; the first two lines of an order are people."""
    g = load(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("image_id"), F.col("l_linenumber").alias("detection_id")).agg(
        F.min("l_quantity").alias("x1"), F.min(F.col("l_partkey") % 50).cast("double").alias("y1"), F.min(F.col("l_suppkey") % 10).alias("sk"), F.min("l_discount").alias("disc"), F.min("l_tax").alias("tax"))
    person = F.col("detection_id") <= 2
    size = F.when(person, 40.0).otherwise(5.0 + F.col("sk"))
    return g.withColumns({"x2": F.col("x1") + size, "y2": F.col("y1") + size,
                          "class_name": F.when(person, "person").when(F.col("sk") < 4, "helmet").when(F.col("sk") < 7, "safety-vest").when(F.col("sk") < 8, "gloves").otherwise("ladder")})


DET = """WITH det0 AS (SELECT l_orderkey AS image_id, l_linenumber AS detection_id, min(l_quantity) AS x1, min(l_partkey % 50)::DOUBLE AS y1, min(l_suppkey % 10) AS sk, min(l_discount) AS disc, min(l_tax) AS tax FROM lineitem GROUP BY 1, 2),
det AS (SELECT *, x1 + CASE WHEN detection_id <= 2 THEN 40 ELSE 5 + sk END AS x2, y1 + CASE WHEN detection_id <= 2 THEN 40 ELSE 5 + sk END AS y2,
 CASE WHEN detection_id <= 2 THEN 'person' WHEN sk < 4 THEN 'helmet' WHEN sk < 7 THEN 'safety-vest' WHEN sk < 8 THEN 'gloves' ELSE 'ladder' END AS class_name FROM det0),
ppl AS (SELECT image_id, row_number() OVER (PARTITION BY image_id ORDER BY x1, y1, detection_id) - 1 AS pi, x1, y1, x2, y2 FROM det WHERE class_name = 'person'),
cand AS (SELECT i.image_id, i.detection_id, i.class_name, p.pi, greatest(least(i.x2, p.x2) - greatest(i.x1, p.x1), 0) * greatest(least(i.y2, p.y2) - greatest(i.y1, p.y1), 0) / ((i.x2 - i.x1) * (i.y2 - i.y1)) AS c,
  CASE WHEN (i.x1 + i.x2) / 2 BETWEEN p.x1 AND p.x2 AND (i.y1 + i.y2) / 2 BETWEEN p.y1 AND p.y2 THEN 0.05::DOUBLE ELSE 0 END AS bonus FROM det i JOIN ppl p USING (image_id) WHERE i.class_name <> 'person'),
bst AS (SELECT image_id, detection_id, arg_min({'p': pi, 'c': c, 's': c + bonus}, {'s': -(c + bonus), 'p': pi}) AS b FROM cand WHERE class_name IN ('helmet','safety-vest','gloves') AND c >= 0.5 GROUP BY 1, 2),
asc_ AS (SELECT d.image_id, d.detection_id, d.class_name, b.p AS person_index, b.c AS containment, b.s AS score, CASE WHEN class_name NOT IN ('helmet','safety-vest','gloves') THEN 'CLASS_NOT_ASSOCIABLE' WHEN b IS NULL THEN 'NO_PERSON_MATCH' END AS unassigned_reason
 FROM det d LEFT JOIN bst USING (image_id, detection_id) WHERE d.class_name <> 'person'),
cls AS (SELECT p.image_id, p.pi AS person_index, list_sort(list(DISTINCT a.class_name) FILTER (a.class_name IS NOT NULL)) AS classes FROM ppl p LEFT JOIN asc_ a ON a.image_id = p.image_id AND a.person_index = p.pi GROUP BY 1, 2),
comp AS (SELECT image_id, person_index, coalesce(array_to_string(classes, ','), '') AS classes, concat_ws(',', CASE WHEN NOT coalesce(list_contains(classes, 'helmet'), false) THEN 'helmet' END, CASE WHEN NOT coalesce(list_contains(classes, 'safety-vest'), false) THEN 'safety-vest' END) AS missing FROM cls)"""


@query("ppe_association", DET + " SELECT image_id, detection_id, class_name, person_index, round(containment, 6) AS containment, round(score, 6) AS score, unassigned_reason FROM asc_")
def ppe_association(spark, sf):
    return V.associate_items(detections(spark, sf), ASSOCIABLE).withColumns({c: F.round(c, 6) for c in ("containment", "score")})


def people(spark, sf):
    d = detections(spark, sf)
    return V.person_compliance(d, V.associate_items(d, ASSOCIABLE))


@query("person_compliance", DET + " SELECT image_id, person_index, classes, missing, CASE WHEN missing = '' THEN 'COMPLIANT' ELSE 'NON_COMPLIANT' END AS status FROM comp")
def person_compliance(spark, sf):
    return people(spark, sf).withColumns({c: F.array_join(c, ",") for c in ("classes", "missing")})


@query("image_compliance", DET + """ SELECT i.image_id, count(comp.image_id) AS person_count, CASE WHEN count(comp.image_id) = 0 THEN 'NO_PERSON' WHEN bool_and(missing = '') THEN 'COMPLIANT' ELSE 'NON_COMPLIANT' END AS overall_status FROM (SELECT DISTINCT image_id FROM det) i LEFT JOIN comp USING (image_id) GROUP BY 1""")
def image_compliance(spark, sf):
    return V.image_compliance(detections(spark, sf), people(spark, sf))


@query("face_person_match", DET + """, fc AS (SELECT image_id, detection_id, x1, y1, x2, y2, tax > 0.01 AS sb, disc > 0.02 AS rec, sk <> 9 AS hb FROM det WHERE detection_id = 3),
 h AS (SELECT f.image_id, f.detection_id, count(*) AS n, min(pi) AS pi, min(c) AS c FROM fc f JOIN cand ON cand.image_id = f.image_id AND cand.detection_id = f.detection_id WHERE sb AND rec AND hb AND c >= 0.8 GROUP BY 1, 2)
 SELECT fc.image_id, fc.detection_id, CASE WHEN NOT (sb AND rec AND hb) THEN 'NOT_EVALUATED' WHEN n = 1 THEN 'MATCH_CANDIDATE' WHEN n > 1 THEN 'AMBIGUOUS' ELSE 'NO_MATCH' END AS status, CASE WHEN n = 1 THEN pi END AS person_index, CASE WHEN n = 1 THEN round_even(c, 4) END AS containment,
 CASE WHEN NOT sb THEN 'DIFFERENT_SOURCE_IMAGES' WHEN NOT rec THEN 'FACE_NOT_RECOGNIZED' WHEN NOT hb THEN 'FACE_GEOMETRY_UNAVAILABLE' WHEN n = 1 THEN 'UNIQUE_FACE_CONTAINMENT_IN_DETECTED_PERSON' ELSE 'FACE_PERSON_OVERLAP_NOT_UNIQUE' END AS reason FROM fc LEFT JOIN h USING (image_id, detection_id)""")
def face_person_match(spark, sf):
    d = detections(spark, sf)
    faces = d.where("detection_id = 3").select("image_id", "detection_id", "x1", "y1", "x2", "y2", (F.col("tax") > 0.01).alias("same_bytes"), (F.col("disc") > 0.02).alias("recognized"), (F.col("sk") != 9).alias("has_box"))
    return V.unique_face_match(faces, d)


@query("class_counts", DET + " SELECT CASE WHEN disc > 0.05 THEN 'train' ELSE 'test' END AS split, class_name, count(DISTINCT image_id) AS images, count(*) AS objects FROM det GROUP BY 1, 2")
def class_counts(spark, sf):
    return V.class_counts(detections(spark, sf).withColumn("split", F.when(F.col("disc") > 0.05, "train").otherwise("test")), ["split"])


@query("class_balanced_split", DET + """, cc AS (SELECT class_name, count(DISTINCT image_id) AS images FROM det GROUP BY 1), st AS (SELECT image_id, arg_min(class_name, {'n': images, 'c': class_name}) AS stratum FROM (SELECT DISTINCT image_id, class_name FROM det) JOIN cc USING (class_name) GROUP BY 1)
 SELECT image_id, stratum, (row_number() OVER (PARTITION BY stratum ORDER BY md5(CAST(image_id AS VARCHAR))) - 1) % 2 AS part FROM st""")
def class_balanced_split(spark, sf):
    return V.balanced_split(detections(spark, sf))


# ---- vectors ---------------------------------------------------------------------------

def items(spark, sf):
    e = load(spark, sf, "embeddings")
    bit = lambda m: F.expr(f"shiftleft(1L, cast(pmod({m}, 5) as int))")
    return e.select(F.col("vec_id").alias("item_id"), F.col("label").alias("document_id"), (bit("label").bitwiseOR(bit("label + 1"))).alias("mask"), F.col("embedding").alias("vec"))


def one_per_label(spark, sf):
    return load(spark, sf, "embeddings").groupBy("label").agg(F.min("vec_id").alias("vec_id"), F.min_by("embedding", "vec_id").alias("vec"))


def questions(spark, sf):
    return one_per_label(spark, sf).select(F.col("vec_id").alias("query_id"), F.expr("shiftleft(1L, cast(pmod(label, 5) as int))").alias("mask"), "vec")


VEC = """WITH one AS (SELECT label, min(vec_id) AS vec_id, arg_min(embedding, vec_id) AS vec FROM embeddings GROUP BY 1),
sim AS (SELECT o.vec_id AS query_id, o.label AS qlabel, e.vec_id AS item_id, e.label AS document_id, list_cosine_similarity(o.vec::DOUBLE[], e.embedding::DOUBLE[]) AS score FROM one o, embeddings e WHERE e.label % 5 = o.label % 5 OR (e.label + 1) % 5 = o.label % 5),
rw AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, item_id) AS rawrank, row_number() OVER (PARTITION BY query_id, document_id ORDER BY score DESC, item_id) AS turn FROM sim)"""


def _ranked(cap):
    order = f"(turn > {cap})::INT, score DESC, item_id" if cap else "score DESC, item_id"
    return VEC + f", rk AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY {order}) AS rank FROM rw)"


def _retrieval(name, ranking, cap):
    @query(name, _ranked(cap) + " SELECT query_id, rank, item_id, document_id, round(score, 6) AS score FROM rk WHERE rank <= 5")
    def run(spark, sf):
        return X.retrieve(questions(spark, sf), items(spark, sf), 5, ranking).withColumn("score", F.round("score", 6))
    return run


for _name, _ranking, _cap in (("retrieval_raw", "raw", None), ("retrieval_diverse", "diverse", 1), ("retrieval_controlled", "controlled", 2)):
    _retrieval(_name, _ranking, _cap)


@query("retrieval_with_abstention", _ranked(2) + ", bs AS (SELECT query_id, max(score) AS b FROM sim WHERE item_id <> query_id GROUP BY 1) SELECT query_id, rank, item_id, round(score, 6) AS score FROM (SELECT s.*, row_number() OVER (PARTITION BY query_id ORDER BY (t2 > 2)::INT, score DESC, item_id) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id, document_id ORDER BY score DESC, item_id) AS t2 FROM sim WHERE item_id <> query_id) s) JOIN bs USING (query_id) WHERE rank <= 5 AND b >= 0.35")
def retrieval_with_abstention(spark, sf):
    """Questions never answer themselves: one more candidate is asked for and the own row dropped."""
    c = X.cosine_candidates(questions(spark, sf), items(spark, sf), 6, 3).where("item_id <> query_id")
    c = c.withColumn("turn", F.row_number().over(W.partitionBy("query_id", "document_id").orderBy(F.desc("score"), "item_id")))
    c = c.withColumn("rank", F.row_number().over(W.partitionBy("query_id").orderBy((F.col("turn") > 2).cast("int"), F.desc("score"), "item_id"))).withColumn("b", F.max("score").over(W.partitionBy("query_id")))
    return c.where("rank <= 5 AND b >= 0.35").select("query_id", "rank", "item_id", F.round("score", 6).alias("score"))


@query("nearest_enrolled", """WITH one AS (SELECT label, min(vec_id) AS vec_id, arg_min(embedding, vec_id) AS vec FROM embeddings GROUP BY 1), d AS (SELECT e.vec_id AS query_id, o.label, o.vec_id, list_cosine_similarity(o.vec::DOUBLE[], e.embedding::DOUBLE[]) AS s FROM embeddings e, one o),
 b AS (SELECT query_id, arg_max(label, {'s': s, 'v': -vec_id}) AS nearest_owner, 1 - greatest(-1, least(1, max(s))) AS distance FROM d GROUP BY 1) SELECT query_id, nearest_owner, round(distance, 6) AS distance, CASE WHEN distance <= 0.7 THEN 'RECOGNIZED' ELSE 'UNKNOWN' END AS recognition_status, CASE WHEN distance <= 0.7 THEN CAST(nearest_owner AS VARCHAR) ELSE 'UNKNOWN' END AS person_id FROM b""")
def nearest_enrolled(spark, sf):
    enrolled = one_per_label(spark, sf).select(F.col("vec_id").alias("item_id"), F.col("label").alias("document_id"), "vec")
    q = load(spark, sf, "embeddings").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vec"))
    return X.nearest_enrolled(q, enrolled, 0.7).withColumn("distance", F.round("distance", 6))


@query("retrieval_metrics", _ranked(2) + """, t AS (SELECT * FROM rk WHERE rank <= 5), exq AS (SELECT DISTINCT vec_id AS query_id, label AS document_id FROM one UNION SELECT vec_id, (label + 5) % 10 FROM one),
 dd AS (SELECT query_id, document_id, min(rank) AS rank FROM t GROUP BY 1, 2), g AS (SELECT query_id, count(*) AS docs, count(*) FILTER (x) AS hits, min(rank) FILTER (x) AS fr FROM (SELECT dd.*, EXISTS (SELECT 1 FROM exq e WHERE e.query_id = dd.query_id AND e.document_id = dd.document_id) AS x FROM dd) GROUP BY 1), w AS (SELECT query_id, count(DISTINCT document_id) AS wanted FROM exq GROUP BY 1)
 SELECT w.query_id, (coalesce(hits, 0) > 0)::INT AS hit, round(coalesce(hits, 0) / wanted::DOUBLE, 6) AS recall, round(coalesce(hits / nullif(docs, 0)::DOUBLE, 0), 6) AS precision, round(coalesce(1.0::DOUBLE / fr, 0), 6) AS reciprocal_rank FROM w LEFT JOIN g USING (query_id)""")
def retrieval_metrics(spark, sf):
    o = one_per_label(spark, sf)
    expected = o.select(F.col("vec_id").alias("query_id"), F.explode(F.array(F.col("label"), (F.col("label") + 5) % 10)).alias("document_id"))
    ranked = X.retrieve(questions(spark, sf), items(spark, sf), 5, "controlled")
    return M.retrieval_metrics(ranked, expected, 5).select("query_id", "hit", *r6("recall", "precision", "reciprocal_rank"))
