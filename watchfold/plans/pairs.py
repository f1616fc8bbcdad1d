"""Pair correlation queries: generic and dedicated matchers, Bayesian scores."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, functions as F

from watchfold.operators import assess, bayes, pairs as P
from watchfold.operators.bandjoin import band_join, side
from watchfold.plans import bindings as B
from watchfold.plans.registry import query
from watchfold.session import materialize
from watchfold.sources.tables import load

ABN_SQL = "(" + "state IN ('" + "','".join(assess.ABNORMAL_STATES) + "') OR state IN ('UNKNOWN_PERSON','UNAUTHORIZED'))"
DOMAIN_SQL = "CASE kind " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in assess.DOMAIN_OF_KIND.items()) + " END"
COMPAT_SQL = "a.kind < b.kind AND NOT ((a.kind, b.kind) IN (('environment','maintenance'),('face','ppe'),('face','ssh')))"
NODES = "WITH RECURSIVE " + B.NODES_SQL + f", el AS (SELECT * FROM nodes WHERE {ABN_SQL})"
GENERIC_CTE = f""", generic AS (SELECT a.zone_id, a.kind AS left_kind, a.id AS left_id, b.kind AS right_kind, b.id AS right_id,
 CASE WHEN a.server_id = b.server_id THEN 'SERVER' ELSE 'ZONE' END AS scope, abs(a.us - b.us) / 1e6::DOUBLE AS dt,
 'PAIR-' || upper(substr(sha256(a.zone_id || '|' || a.kind || ':' || a.id || '|' || b.kind || ':' || b.id), 1, 20)) AS source_id
 FROM el a JOIN el b ON a.zone_id = b.zone_id AND {COMPAT_SQL} AND abs(a.us - b.us) <= 900000000)"""
OP_CTE = """, opc AS (SELECT m.zone_id, m.id AS left_id, e.id AS right_id, abs(m.us - e.us) / 1e6::DOUBLE AS dt, 'OP-' || m.id || '-' || e.id AS source_id
 FROM nodes m JOIN el e ON m.kind = 'maintenance' AND m.state = 'AT_RISK' AND e.kind = 'environment' AND m.zone_id = e.zone_id AND abs(m.us - e.us) <= 900000000),
opn AS (SELECT *, row_number() OVER (ORDER BY dt, source_id) AS n FROM opc),
opg(n, used) AS (SELECT 0::BIGINT, []::VARCHAR[] UNION ALL SELECT o.n, CASE WHEN list_contains(g.used, 'l' || o.left_id) OR list_contains(g.used, 'r' || o.right_id) THEN g.used ELSE list_concat(g.used, ['l' || o.left_id, 'r' || o.right_id, 'n' || o.n]) END
 FROM opg g JOIN opn o ON o.n = g.n + 1),
op AS (SELECT opn.* FROM opn, (SELECT used FROM opg ORDER BY n DESC LIMIT 1) f WHERE list_contains(f.used, 'n' || opn.n))"""
IMG_CTE = """, obs AS (SELECT *, 'C' || (user_id // 2) AS camera_id, us + k * 1000000 AS received_us, 'H' || k AS source_sha256 FROM nodes WHERE kind IN ('ppe','face')),
imc AS (SELECT p.zone_id, p.camera_id, p.id AS left_id, f.id AS right_id, CASE WHEN p.source_sha256 = f.source_sha256 THEN 0 ELSE 1 END AS not_same_source, abs(p.us - f.us) / 1e6::DOUBLE AS dt,
 abs(p.received_us - f.received_us) / 1e6::DOUBLE AS gap, -greatest(p.received_us, f.received_us) AS newest FROM obs p JOIN obs f ON p.kind = 'ppe' AND f.kind = 'face' AND p.zone_id = f.zone_id AND p.camera_id = f.camera_id AND abs(p.us - f.us) <= 900000000),
imn AS (SELECT *, row_number() OVER (ORDER BY not_same_source, dt, gap, newest, left_id, right_id) AS n FROM imc),
img(n, used) AS (SELECT 0::BIGINT, []::VARCHAR[] UNION ALL SELECT o.n, CASE WHEN list_contains(g.used, 'l' || o.left_id) OR list_contains(g.used, 'r' || o.right_id) THEN g.used ELSE list_concat(g.used, ['l' || o.left_id, 'r' || o.right_id, 'n' || o.n]) END
 FROM img g JOIN imn o ON o.n = g.n + 1),
im AS (SELECT imn.* FROM imn, (SELECT used FROM img ORDER BY n DESC LIMIT 1) f WHERE list_contains(f.used, 'n' || imn.n))"""
FS_CTE = """, lg AS (SELECT zone_id, id, state, epoch_us(CASE WHEN k >= 90 THEN ts + INTERVAL 2 MINUTE WHEN k < 5 THEN NULL WHEN k < 10 THEN NULL ELSE ts END) AS us FROM nodes WHERE kind = 'ssh' AND state <> 'NO_ANOMALY_EVIDENCE'),
fsc AS (SELECT f.zone_id, f.id AS left_id, l.id AS right_id, abs(f.us - l.us) / 1e6::DOUBLE AS dt, 'FACE-SSH-' || f.id || '-' || l.id AS source_id FROM nodes f JOIN lg l ON f.kind = 'face' AND f.zone_id = l.zone_id AND l.us IS NOT NULL AND abs(f.us - l.us) <= 900000000)"""
EDGES_SQL = NODES + GENERIC_CTE + OP_CTE + IMG_CTE + FS_CTE + """, edges AS (
 SELECT zone_id, left_kind, left_id, right_kind, right_id, scope, dt, source_id, 'REASONING_CONTEXT' AS type FROM generic
 UNION ALL SELECT zone_id, 'maintenance', left_id, 'environment', right_id, 'ZONE', dt, source_id, 'OPERATIONAL' FROM op
 UNION ALL SELECT zone_id, 'ppe', left_id, 'face', right_id, 'ZONE', dt, 'PHYSICAL-' || left_id || '-' || right_id, 'PHYSICAL_IMAGE' FROM im
 UNION ALL SELECT zone_id, 'face', left_id, 'ssh', right_id, 'ZONE', dt, source_id, 'FACE_SSH_CONTEXT' FROM fsc)"""


def written_nodes(spark, sf):
    """The nodes, written once: the matchers and the review read them a dozen times, and a filter on a computed column would parse the events again.

    They lie in folders by kind, since a matcher reads one or two of the five kinds."""
    return materialize(B.nodes(spark, sf).select("zone_id", "kind", "id", "server_id", "rack_id", "state", "ts", "k", "user_id"), "nodes", "kind")


def live_nodes(spark, sf, nodes=None):
    return (B.nodes(spark, sf) if nodes is None else nodes).withColumn("times", F.array("ts"))


def observations(spark, sf, nodes=None):
    n = (B.nodes(spark, sf) if nodes is None else nodes).where("kind IN ('ppe', 'face')")
    us = F.unix_micros("ts")
    return n.select("kind", "id", "zone_id", F.concat(F.lit("C"), F.expr("user_id div 2")).alias("camera_id"), us.alias("us"),
                    (us + F.col("k") * 1_000_000).alias("received_us"), F.concat(F.lit("H"), "k").alias("source_sha256"), "state")


def ssh_logs(spark, sf, nodes=None):
    n = (B.nodes(spark, sf) if nodes is None else nodes).where("kind = 'ssh'")
    return n.select("zone_id", "id", "state", F.when(F.col("k") < 5, F.expr("ts - INTERVAL 10 YEARS")).otherwise(F.col("ts")).alias("log_ts"),
                    F.expr("CASE WHEN k >= 90 THEN ts + INTERVAL 2 MINUTES END").alias("declared_ts"), F.col("k").between(5, 9).alias("timestamp_uncertain"))


def image_matches(spark, sf, nodes=None):
    return P.image_pairs(observations(spark, sf, nodes)).withColumn("source_id", F.concat(F.lit("PHYSICAL-"), "left_id", F.lit("-"), "right_id"))


def face_ssh(spark, sf, nodes=None):
    n = B.nodes(spark, sf) if nodes is None else nodes
    return P.face_ssh_candidates(n.where("kind = 'face'"), ssh_logs(spark, sf, nodes))


def one_to_one_matchers(spark, sf, n):
    """The two matchers over the nodes `n` that pick pairs, each as a function that returns its edges."""
    return [lambda: P.as_edges(P.operational_pairs(n), "OPERATIONAL", "maintenance", "environment"),
            lambda: P.as_edges(image_matches(spark, sf, n), "PHYSICAL_IMAGE", "ppe", "face")]


def face_ssh_links(spark, sf, n):
    return P.face_ssh_links(n.where("kind = 'face'"), ssh_logs(spark, sf, n))


def dedicated_edges(spark, sf, n):
    contexts = P.as_edges(face_ssh(spark, sf, n), "FACE_SSH_CONTEXT", "face", "ssh")
    return reduce(DataFrame.unionByName, [edges() for edges in one_to_one_matchers(spark, sf, n)], contexts)


def all_edges(spark, sf):
    """Union of the generic rule and the three dedicated matchers."""
    n = live_nodes(spark, sf, written_nodes(spark, sf))
    return P.generic_pairs(n).unionByName(dedicated_edges(spark, sf, n))


def dt6(df):
    return df.withColumn("time_difference_seconds", F.round("time_difference_seconds", 6))


@query("abnormal_events", NODES + f" SELECT kind, id, {ABN_SQL} AS abnormal, (state IN ('" + "','".join(assess.ABNORMAL_STATES) + f"') OR (kind = 'face' AND (state = 'UNKNOWN_PERSON' OR CASE WHEN state = 'UNAUTHORIZED' THEN true ELSE false END))) AS scenario_abnormal FROM nodes")
def abnormal_events(spark, sf):
    n = B.nodes(spark, sf)
    auth = F.when((F.col("kind") == "face") & (F.col("state") == "UNAUTHORIZED"), "UNAUTHORIZED")
    return n.select("kind", "id", assess.detector_abnormal(F.col("state")).alias("abnormal"),
                    assess.is_abnormal(assess.domain_of(F.col("kind")), F.col("state"), auth).alias("scenario_abnormal"))


@query("evidence_independence", NODES + " SELECT id, CASE WHEN kind <> 'environment' THEN 'PRIMARY' WHEN source_class = 'ENVIRONMENTAL_SENSOR' THEN 'INDEPENDENT' WHEN source_class = 'HARDWARE_TELEMETRY' THEN 'RELATED_SOURCE' ELSE 'UNKNOWN' END AS independence FROM nodes")
def evidence_independence(spark, sf):
    return B.nodes(spark, sf).select("id", assess.evidence_independence(assess.domain_of(F.col("kind")), F.col("source_class")).alias("independence"))


def scenario_events(spark, sf):
    n = B.nodes(spark, sf)
    return n.select(F.date_format("ts", "yyyyMMdd").alias("scenario_id"), "zone_id", "id", assess.domain_of(F.col("kind")).alias("domain"), "state",
                    "server_id", "rack_id", F.unix_micros("ts").alias("us"), assess.detector_abnormal(F.col("state")).alias("abnormal"))


@query("cross_domain_pairs", NODES + f""", ev AS (SELECT strftime(ts, '%Y%m%d') AS scenario_id, *, {DOMAIN_SQL} AS domain FROM el)
 SELECT a.scenario_id, a.zone_id, a.id AS left_id, b.id AS right_id, a.domain AS left_domain, b.domain AS right_domain, CASE WHEN a.server_id = b.server_id THEN 'SERVER' WHEN a.rack_id = b.rack_id THEN 'RACK' ELSE 'ZONE' END AS scope,
 CASE WHEN a.server_id = b.server_id THEN a.server_id WHEN a.rack_id = b.rack_id THEN a.rack_id ELSE a.zone_id END AS shared_entity, round(abs(a.us - b.us) / 1e6::DOUBLE, 6) AS time_difference_seconds
 FROM ev a JOIN ev b ON a.scenario_id = b.scenario_id AND a.zone_id = b.zone_id AND a.id < b.id AND a.domain <> b.domain AND abs(a.us - b.us) <= 900000000""")
def cross_domain_pairs(spark, sf):
    return dt6(P.cross_domain_pairs(scenario_events(spark, sf)))


@query("generic_pairs", NODES + GENERIC_CTE + " SELECT zone_id, left_kind, left_id, right_kind, right_id, scope, round(dt, 6) AS time_difference_seconds, source_id FROM generic")
def generic_pairs(spark, sf):
    return dt6(P.generic_pairs(live_nodes(spark, sf))).drop("type")


@query("operational_pairs", NODES + OP_CTE + " SELECT zone_id, left_id, right_id, round(dt, 6) AS time_difference_seconds, source_id FROM op")
def operational_pairs(spark, sf):
    return dt6(P.operational_pairs(live_nodes(spark, sf)))


@query("image_pairs", NODES + IMG_CTE + " SELECT zone_id, camera_id, left_id, right_id, not_same_source, round(dt, 6) AS time_difference_seconds, round(gap, 6) AS receipt_difference_seconds FROM im")
def image_pairs(spark, sf):
    return dt6(image_matches(spark, sf)).withColumn("receipt_difference_seconds", F.round("receipt_difference_seconds", 6)).drop("newest_first", "source_id")


@query("face_ssh_candidates", NODES + FS_CTE + " SELECT zone_id, left_id, right_id, round(dt, 6) AS time_difference_seconds, source_id FROM fsc")
def face_ssh_candidates(spark, sf):
    return dt6(face_ssh(spark, sf))


@query("all_correlation_edges", EDGES_SQL + " SELECT zone_id, left_kind, left_id, right_kind, right_id, scope, round(dt, 6) AS time_difference_seconds, source_id, type FROM edges")
def all_correlation_edges(spark, sf):
    return dt6(all_edges(spark, sf))


@query("latest_pair_feed", EDGES_SQL + " SELECT zone_id, source_id, type, round(dt, 6) AS time_difference_seconds FROM edges ORDER BY zone_id, dt, source_id LIMIT 200")
def latest_pair_feed(spark, sf):
    return dt6(all_edges(spark, sf).orderBy("zone_id", "time_difference_seconds", "source_id").limit(200)).select(
        "zone_id", "source_id", "type", "time_difference_seconds")


@query("pairs_of_published_events", NODES + GENERIC_CTE + " SELECT source_id, left_id, right_id FROM generic g WHERE EXISTS (SELECT 1 FROM nodes n WHERE n.state IN ('EXPLICIT_SECURITY_EVENT','SMOKE_DETECTED') AND ((n.kind = g.left_kind AND n.id = g.left_id) OR (n.kind = g.right_kind AND n.id = g.right_id)))")
def pairs_of_published_events(spark, sf):
    published = B.nodes(spark, sf).where("state IN ('EXPLICIT_SECURITY_EVENT', 'SMOKE_DETECTED')").select("kind", "id")
    return P.containing(P.generic_pairs(live_nodes(spark, sf)), published).select("source_id", "left_id", "right_id")


CLEARED_SQL = ", " + B.VERDICTS_SQL + """, latest AS (SELECT kind, evidence_id AS id, arg_max({'v': verdict, 'c': corrected_status}, {'t': recorded_at, 'v': verdict}) AS v FROM verdicts GROUP BY 1, 2),
lv AS (SELECT kind, id, v.v AS verdict, CASE WHEN v.v = 'OVERRIDDEN' THEN v.c END AS effective_status, CASE WHEN v.v = 'OVERRIDDEN' THEN v.c NOT IN ('NO_ANOMALY_EVIDENCE','NORMAL','COMPLIANT','AUTHORIZED','NO_PERSON','NO_FACE','NO_ANOMALY') END AS human_abnormal FROM latest)"""


@query("pairs_without_cleared", NODES + GENERIC_CTE + CLEARED_SQL + """ SELECT source_id, left_id, right_id FROM generic g WHERE NOT EXISTS (SELECT 1 FROM lv WHERE human_abnormal = false AND ((lv.kind = left_kind AND lv.id = left_id) OR (lv.kind = right_kind AND lv.id = right_id)))""")
def pairs_without_cleared(spark, sf):
    from watchfold.operators.severity import latest_verdicts
    cleared = latest_verdicts(B.verdicts(spark, sf)).where("human_abnormal = false").select("kind", "id")
    return P.without_cleared(P.generic_pairs(live_nodes(spark, sf)), cleared).select("source_id", "left_id", "right_id")


# ---- Bayesian scores --------------------------------------------------------------

def model_events(spark, sf):
    """Labelled scenario events: three declared zones, incidents as zone and half hour of strong values."""
    n = B.nodes(spark, sf)
    domain = assess.domain_of(F.col("kind"))
    unauthorized = (F.col("kind") == "face") & (F.col("state") == "UNAUTHORIZED")
    return n.select(
        F.col("zone_id").alias("scenario_id"), F.element_at(F.array(F.lit("ZONE-A"), F.lit("ZONE-B"), F.lit("ZONE-C")), (F.col("user_id") % 3 + 1).cast("int")).alias("zone_id"),
        "id", domain.alias("domain"), F.when(unauthorized, "RECOGNIZED").otherwise(F.col("state")).alias("state"), F.when(unauthorized, "UNAUTHORIZED").alias("authorization"),
        "server_id", "rack_id", "failure_probability", "confidence", "source_class", F.unix_micros("ts").alias("us"),
        F.when(F.col("value") >= 40, F.concat_ws("|", "zone_id", F.floor(F.unix_seconds("ts") / 1800))).alias("incident"))


def candidates(spark, sf):
    """Abnormal cross-domain pairs of one scenario within the candidate window; labels never reach the factors."""
    ev = model_events(spark, sf)
    ev = ev.where(assess.is_abnormal(F.col("domain"), F.col("state"), F.col("authorization")))
    keys = ["scenario_id"]
    both = band_join(side(ev, "left", keys), side(ev, "right", keys), keys, "left_us", "right_us", bayes.CANDIDATE_WINDOW_US)
    both = both.where((F.col("left_id") < F.col("right_id")) & (F.col("left_domain") != F.col("right_domain")))
    both = both.withColumn("time_difference_seconds", F.abs(F.col("left_us") - F.col("right_us")) / 1e6) \
               .withColumn("truth", F.coalesce(F.col("left_incident") == F.col("right_incident"), F.lit(False)))
    return bayes.factors(both).withColumn("crisp", bayes.crisp())


def _case(f, side_no):
    return "CASE " + f + " " + " ".join(f"WHEN '{row[0]}' THEN {row[side_no]}::DOUBLE" for row in bayes.TABLES[f]) + " ELSE 1.0::DOUBLE END"


def post_sql(use=bayes.FACTORS):
    yes = "0.2::DOUBLE * " + " * ".join(_case(f, 1) for f in use)
    no = "0.8::DOUBLE * " + " * ".join(_case(f, 2) for f in use)
    return f"(({yes}) / (({yes}) + ({no})))"


def strong_sql(p):
    return f"""coalesce(CASE {p}.domain WHEN 'CYBERSECURITY' THEN {p}.state IN ('EXPLICIT_SECURITY_EVENT','HIGH_CONFIDENCE_ANOMALY') WHEN 'MAINTENANCE' THEN {p}.failure_probability >= 0.7
  WHEN 'ENVIRONMENTAL' THEN {p}.state IN ('SMOKE_DETECTED','WATER_LEAK_DETECTED') OR coalesce({p}.source_class = 'ENVIRONMENTAL_SENSOR', false) WHEN 'PHYSICAL_SECURITY' THEN coalesce({p}.auth = 'UNAUTHORIZED', false) WHEN 'SAFETY' THEN {p}.confidence >= 0.75 END, false)::INT"""


CAND_SQL = NODES + f""", mev AS (SELECT zone_id AS scenario_id, ['ZONE-A','ZONE-B','ZONE-C'][user_id % 3 + 1] AS zone, id, {DOMAIN_SQL} AS domain,
  CASE WHEN kind='face' AND state='UNAUTHORIZED' THEN 'RECOGNIZED' ELSE state END AS state, CASE WHEN kind='face' AND state='UNAUTHORIZED' THEN 'UNAUTHORIZED' END AS auth,
  server_id, rack_id, failure_probability, confidence, source_class, us, CASE WHEN value >= 40 THEN zone_id || '|' || (CAST(floor(us / 1e6) AS BIGINT) // 1800) END AS incident FROM el),
prs AS (SELECT a.scenario_id, a.id AS left_id, b.id AS right_id, abs(a.us - b.us) / 1e6::DOUBLE AS dt, coalesce(a.incident = b.incident, false) AS truth,
  CASE WHEN abs(a.us - b.us) <= 300000000 THEN 'LE_5_MIN' WHEN abs(a.us - b.us) <= 900000000 THEN 'LE_15_MIN' WHEN abs(a.us - b.us) <= 3600000000 THEN 'LE_60_MIN' ELSE 'GT_60_MIN' END AS TimeGap,
  CASE WHEN a.server_id = b.server_id THEN 'SAME_SERVER' WHEN a.rack_id = b.rack_id THEN 'SAME_RACK' WHEN a.zone = b.zone THEN 'SAME_ZONE'
   WHEN (a.zone = 'ZONE-C' AND a.domain IN ('ENVIRONMENTAL','MAINTENANCE')) OR (b.zone = 'ZONE-C' AND b.domain IN ('ENVIRONMENTAL','MAINTENANCE')) THEN 'DEPENDENCY' ELSE 'UNRELATED' END AS Topology,
  CASE WHEN least(a.domain, b.domain) || '|' || greatest(a.domain, b.domain) IN ('{"','".join(bayes.KNOWN)}') THEN 'KNOWN' WHEN least(a.domain, b.domain) || '|' || greatest(a.domain, b.domain) IN ('{"','".join(bayes.POSSIBLE)}') THEN 'POSSIBLE' ELSE 'UNLIKELY' END AS DomainMechanism,
  CASE {strong_sql('a')} + {strong_sql('b')} WHEN 2 THEN 'BOTH_STRONG' WHEN 1 THEN 'MIXED' ELSE 'BOTH_WEAK' END AS EvidenceStrength,
  a.zone = b.zone AND abs(a.us - b.us) <= 900000000 AS crisp
 FROM mev a JOIN mev b ON a.scenario_id = b.scenario_id AND a.id < b.id AND a.domain <> b.domain AND abs(a.us - b.us) <= 7200000000),
sc AS (SELECT *, {post_sql()} AS p FROM prs)"""


@query("pair_factors", CAND_SQL + " SELECT left_id, right_id, TimeGap, Topology, DomainMechanism, EvidenceStrength, truth, crisp FROM prs")
def pair_factors(spark, sf):
    return candidates(spark, sf).select("left_id", "right_id", *bayes.FACTORS, "truth", "crisp")


@query("bayesian_pair_scores", CAND_SQL + " SELECT left_id, right_id, round(p, 4) AS probability_related, p >= 0.5 AS correlated FROM sc")
def bayesian_pair_scores(spark, sf):
    return bayes.score(candidates(spark, sf)).select("left_id", "right_id", "probability_related", "correlated")


def _ratio(f):
    return "CASE " + f + " " + " ".join(f"WHEN '{s}' THEN {round(y / n, 3)}::DOUBLE" for s, y, n in bayes.TABLES[f]) + " END"


@query("pair_contributions", CAND_SQL + ", c AS (" + " UNION ALL ".join(
    f"SELECT left_id, right_id, {i} AS place, '{f}' AS factor, {f} AS observed, {_ratio(f)} AS r FROM prs" for i, f in enumerate(bayes.FACTORS)) +
    """) SELECT left_id, right_id, string_agg(factor || '=' || observed || ':' || CASE WHEN r > 1 THEN 'SUPPORTS' WHEN r < 1 THEN 'OPPOSES' ELSE 'NEUTRAL' END, ';' ORDER BY -abs(ln(r)), place) AS contributions FROM c GROUP BY 1, 2""")
def pair_contributions(spark, sf):
    c = candidates(spark, sf).withColumn("c", bayes.contributions())
    text = F.array_join(F.transform("c", lambda x: F.concat(x["factor"], F.lit("="), x["observed"], F.lit(":"), x["direction"])), ";")
    return c.select("left_id", "right_id", text.alias("contributions"))


@query("live_pair_scores", NODES + GENERIC_CTE + f""", nx AS (SELECT *, {DOMAIN_SQL} AS domain, CASE WHEN kind='face' AND state='UNAUTHORIZED' THEN 'UNAUTHORIZED' END AS auth,
  CASE kind WHEN 'ppe' THEN confidence IS NOT NULL WHEN 'maintenance' THEN failure_probability IS NOT NULL WHEN 'environment' THEN source_class IS NOT NULL OR state IN ('SMOKE_DETECTED','WATER_LEAK_DETECTED') ELSE true END AS seen FROM nodes),
 lp AS (SELECT g.source_id, g.dt, a.state AS ls, b.state AS rs, 
  CASE WHEN g.dt <= 300 THEN 'LE_5_MIN' WHEN g.dt <= 900 THEN 'LE_15_MIN' END AS TimeGap, CASE WHEN a.server_id = b.server_id THEN 'SAME_SERVER' WHEN a.rack_id = b.rack_id THEN 'SAME_RACK' ELSE 'SAME_ZONE' END AS Topology,
  CASE WHEN least(a.domain, b.domain) || '|' || greatest(a.domain, b.domain) IN ('{"','".join(bayes.KNOWN)}') THEN 'KNOWN' WHEN least(a.domain, b.domain) || '|' || greatest(a.domain, b.domain) IN ('{"','".join(bayes.POSSIBLE)}') THEN 'POSSIBLE' ELSE 'UNLIKELY' END AS DomainMechanism,
  CASE WHEN a.seen AND b.seen THEN CASE {strong_sql('a')} + {strong_sql('b')} WHEN 2 THEN 'BOTH_STRONG' WHEN 1 THEN 'MIXED' ELSE 'BOTH_WEAK' END END AS EvidenceStrength
  FROM generic g JOIN nx a ON a.kind = g.left_kind AND a.id = g.left_id JOIN nx b ON b.kind = g.right_kind AND b.id = g.right_id)
 SELECT source_id, 'RESEARCH_ESTIMATE' AS status, round({post_sql()}, 3) AS probability_related, {post_sql()} >= 0.5 AS model_says_related, CASE WHEN EvidenceStrength IS NULL THEN 'EvidenceStrength' END AS marginalized FROM lp""")
def live_pair_scores(spark, sf):
    n = model_nodes(spark, sf)
    edges = P.generic_pairs(live_nodes(spark, sf)).select("source_id", "left_kind", "left_id", "right_kind", "right_id", "time_difference_seconds")
    for end in ("left", "right"):
        edges = edges.join(n.select(*[F.col(c).alias(f"{end}_{c}") for c in n.columns]), [f"{end}_kind", f"{end}_id"])
    return bayes.score_live(edges).select("source_id", "status", "probability_related", "model_says_related", "marginalized")


def model_nodes(spark, sf):
    n = B.nodes(spark, sf)
    unauthorized = (F.col("kind") == "face") & (F.col("state") == "UNAUTHORIZED")
    domain = assess.domain_of(F.col("kind"))
    return n.select("kind", "id", "zone_id", "server_id", "rack_id", domain.alias("domain"), F.when(unauthorized, "RECOGNIZED").otherwise(F.col("state")).alias("state"),
                    F.when(unauthorized, "UNAUTHORIZED").alias("authorization"), "failure_probability", "confidence", "source_class",
                    assess.detector_abnormal(F.col("state")).alias("abnormal"))


F1_SQL = "CASE WHEN 2 * tp + fp + fn > 0 THEN 2 * tp / (2 * tp + fp + fn)::DOUBLE ELSE 0.0 END"


@query("factor_ablation", CAND_SQL + ", ab AS (" + " UNION ALL ".join(
    f"SELECT '{f}' AS dropped_factor, truth, {post_sql([x for x in bayes.FACTORS if x != f])} >= 0.5 AS flag FROM prs" for f in bayes.FACTORS) +
    f"), cf AS (SELECT dropped_factor, count(*) FILTER (flag AND truth) AS tp, count(*) FILTER (flag AND NOT truth) AS fp, count(*) FILTER (NOT flag AND truth) AS fn FROM ab GROUP BY 1) SELECT *, round({F1_SQL}, 6) AS f1 FROM cf")
def factor_ablation(spark, sf):
    return bayes.ablation(candidates(spark, sf)).withColumn("f1", F.round("f1", 6))


def _sens_sql(draws, seed):
    rows = ["('Prior','Yes','-',0.2)", "('Prior','No','-',0.8)"]
    for f, states in bayes.TABLES.items():
        rows += [f"('{f}','Yes','{s}',{y})" for s, y, _ in states] + [f"('{f}','No','{s}',{n})" for s, _, n in states]
    u = lambda x: f"((CAST('0x' || substr(md5({seed} || '|' || draw || '|' || factor || '|' || side || '|' || state || '|{x}'), 1, 8) AS BIGINT) + 0.5::DOUBLE) / 4294967296.0::DOUBLE)"
    joins = "".join(f" JOIN tbl y{i} ON y{i}.draw = d.draw AND y{i}.factor = '{f}' AND y{i}.side = 'Yes' AND y{i}.state = c.{f} JOIN tbl n{i} ON n{i}.draw = d.draw AND n{i}.factor = '{f}' AND n{i}.side = 'No' AND n{i}.state = c.{f}"
                    for i, f in enumerate(bayes.FACTORS))
    yes = "py.q * " + " * ".join(f"y{i}.q" for i in range(4))
    no = "pn.q * " + " * ".join(f"n{i}.q" for i in range(4))
    return f""", base(factor, side, state, p) AS (VALUES {','.join(rows)}), draws AS (SELECT range AS draw FROM range(0, {draws})),
noisy AS (SELECT draw, factor, side, state, p::DOUBLE * exp({bayes.SENSITIVITY_SIGMA} * sqrt(-2 * ln({u('a')})) * cos(2 * pi() * {u('b')})) AS w, CASE WHEN factor = 'Prior' THEN 'Prior' ELSE factor || '/' || side END AS g FROM base, draws),
tbl AS (SELECT draw, factor, side, state, w / sum(w) OVER (PARTITION BY draw, g) AS q FROM noisy),
combo AS (SELECT TimeGap, Topology, DomainMechanism, EvidenceStrength, truth, count(*) AS pairs FROM prs GROUP BY ALL),
fl AS (SELECT d.draw, c.truth, c.pairs, ({yes}) / ({yes} + {no}) >= 0.5 AS flag FROM combo c CROSS JOIN draws d JOIN tbl py ON py.draw = d.draw AND py.factor = 'Prior' AND py.side = 'Yes' JOIN tbl pn ON pn.draw = d.draw AND pn.factor = 'Prior' AND pn.side = 'No'{joins}),
cf AS (SELECT draw, CAST(coalesce(sum(pairs) FILTER (flag AND truth), 0) AS BIGINT) AS tp, CAST(coalesce(sum(pairs) FILTER (flag AND NOT truth), 0) AS BIGINT) AS fp, CAST(coalesce(sum(pairs) FILTER (NOT flag AND truth), 0) AS BIGINT) AS fn FROM fl GROUP BY 1)
SELECT *, round({F1_SQL}, 6) AS f1 FROM cf"""


@query("table_sensitivity", CAND_SQL + _sens_sql(200, 7))
def table_sensitivity(spark, sf):
    return bayes.sensitivity(candidates(spark, sf), 200, 7).withColumn("f1", F.round("f1", 6))


# ---- near duplicates ------------------------------------------------------------------

@query("near_duplicate_hashes", """WITH h AS (SELECT vec_id, label, list_sum(list_transform(range(0, 63), lambda i: CASE WHEN embedding[(i // 4) * 4 + 1]::DOUBLE + embedding[(i // 4) * 4 + 2]::DOUBLE + embedding[(i // 4) * 4 + 3]::DOUBLE + embedding[(i // 4) * 4 + 4]::DOUBLE > 0 THEN (1::BIGINT << i::BIGINT) ELSE 0 END))::BIGINT AS ph FROM embeddings),
 l AS (SELECT vec_id AS id, ph FROM h WHERE label < 5), r AS (SELECT vec_id AS id, ph FROM h WHERE label >= 5),
 p AS (SELECT l.id, bit_count(xor(l.ph, r.ph)) AS distance, r.id AS rid FROM l, r WHERE bit_count(xor(l.ph, r.ph)) <= 6)
 SELECT id, min(distance)::INT AS distance, arg_min(rid, distance * 1000000 + rid) AS nearest_id FROM p GROUP BY 1""")
def near_duplicate_hashes(spark, sf):
    """Two collections by label. The hash is a coarse one of all 64 dimensions: the sign of the sum of each four neighbours, in four bits
    (no two of the given vectors are near in single signs)."""
    four = lambda i: sum((F.col("embedding")[4 * (i // 4) + k].cast("double") for k in range(1, 4)), F.col("embedding")[4 * (i // 4)].cast("double"))
    bit = lambda i: F.when(four(i) > 0, F.lit(1 << i)).otherwise(F.lit(0)).cast("long")
    h = load(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), "label", sum((bit(i) for i in range(1, 63)), bit(0)).alias("phash"))
    return P.near_duplicates(h.where("label < 5"), h.where("label >= 5"), 6)
