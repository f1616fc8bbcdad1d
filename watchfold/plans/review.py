"""Human review queries: verdict overlays, audit chains, lifecycle, idempotent stores."""

from __future__ import annotations

from pyspark.sql import functions as F

from watchfold.operators import audit as A, severity as S
from watchfold.plans import bindings as B
from watchfold.plans.pairs import CLEARED_SQL, NODES
from watchfold.plans.registry import query
from watchfold.session import materialize
from watchfold.sources import upsert as U
from watchfold.sources.tables import load

FIELDS = ["conv_id", "turn", "role", "text"]
NUMBERS = {"conv_id", "turn"}


@query("latest_verdicts", NODES + CLEARED_SQL + " SELECT kind, id, verdict, effective_status, human_abnormal FROM lv")
def latest_verdicts(spark, sf):
    return S.latest_verdicts(B.verdicts(spark, sf)).select("kind", "id", "verdict", "effective_status", "human_abnormal")


def turns(spark, sf):
    """One chain per conversation; duplicate turns of the raw table are reduced to one record."""
    c = load(spark, sf, "conversations").groupBy("conv_id", "turn").agg(F.min_by(F.struct("role", "text"), F.struct("role", "text")).alias("r"))
    return c.select("conv_id", "turn", "r.role", "r.text")


ESC = """'"' || array_to_string(list_transform(string_split(t, ''), lambda c: CASE WHEN c = '"' THEN '\\"' WHEN c = '\\' THEN '\\\\' WHEN c = chr(10) THEN '\\n' WHEN c = chr(13) THEN '\\r' WHEN c = chr(9) THEN '\\t' WHEN unicode(c) BETWEEN 32 AND 126 THEN c
 WHEN unicode(c) < 65536 THEN '\\u' || lpad(lower(to_hex(unicode(c))), 4, '0') ELSE '\\u' || lower(to_hex(55296 + (unicode(c) - 65536) // 1024)) || '\\u' || lower(to_hex(56320 + (unicode(c) - 65536) % 1024)) END), '') || '"'"""
CHAIN = f"""WITH RECURSIVE tr0 AS (SELECT conv_id, turn, min({{'role': role, 'text': text}}) AS r FROM conversations GROUP BY 1, 2), tr AS (SELECT conv_id, turn, r.role AS role, r.text AS t FROM tr0), tx AS (SELECT conv_id, turn, role, {ESC} AS q FROM tr),
ch(conv_id, turn, previous_hash, entry_hash) AS (SELECT conv_id, turn, 'GENESIS', sha256('{{"conv_id":' || conv_id || ',"previous_hash":"GENESIS","role":"' || role || '","text":' || q || ',"turn":' || turn || '}}') FROM tx WHERE turn = (SELECT min(turn) FROM tx x WHERE x.conv_id = tx.conv_id)
 UNION ALL SELECT n.conv_id, n.turn, c.entry_hash, sha256('{{"conv_id":' || n.conv_id || ',"previous_hash":"' || c.entry_hash || '","role":"' || n.role || '","text":' || n.q || ',"turn":' || n.turn || '}}') FROM ch c JOIN tx n ON n.conv_id = c.conv_id AND n.turn = c.turn + 1)"""


def sealed(spark, sf):
    return materialize(A.seal(turns(spark, sf), "conv_id", "turn", FIELDS), "chain")


@query("sealed_chains", CHAIN + " SELECT conv_id, turn, previous_hash, entry_hash FROM ch")
def sealed_chains(spark, sf):
    return sealed(spark, sf).select("conv_id", "turn", "previous_hash", "entry_hash")


@query("verified_chains", CHAIN + """, ta AS (SELECT conv_id, min(turn) FILTER (role = 'system') AS edited, count(*) AS records, arg_max(entry_hash, turn) AS head FROM ch JOIN tx USING (conv_id, turn) GROUP BY 1)
 SELECT conv_id, CASE WHEN edited IS NULL THEN 'PASS' ELSE 'FAILED' END AS status, records, edited AS failed_position, CASE WHEN edited IS NOT NULL THEN 'ENTRY_HASH_MISMATCH' END AS reason, CASE WHEN edited IS NULL THEN head END AS head_hash FROM ta""")
def verified_chains(spark, sf):
    """System turns are edited after sealing; their chains must fail there, all others pass."""
    edited = sealed(spark, sf).withColumn("text", F.when(F.col("role") == "system", F.concat("text", F.lit("!"))).otherwise(F.col("text")))
    return A.verify(edited, "conv_id", "turn", FIELDS, NUMBERS)


@query("audit_checkpoints", CHAIN + """, sn AS (SELECT conv_id, count(*) AS length, max(turn) AS last FROM ch GROUP BY 1), lr AS (SELECT conv_id, turn, role FROM tx)
 SELECT sn.conv_id, CASE WHEN lr.role = 'assistant' THEN 'RECORDS_MISSING' ELSE 'PASS' END AS status FROM sn JOIN lr ON lr.conv_id = sn.conv_id AND lr.turn = sn.last""")
def audit_checkpoints(spark, sf):
    """Chains that lost their last record after the checkpoint (those ending with an assistant turn) are found."""
    s = sealed(spark, sf)
    last = s.groupBy("conv_id").agg(F.max("turn").alias("turn"))
    lost = s.join(last, ["conv_id", "turn"], "left_semi").where("role = 'assistant'").select("conv_id", "turn")
    return A.verify_checkpoint(s.join(lost, ["conv_id", "turn"], "left_anti"), A.snapshot(s, "conv_id", "turn"), "conv_id", "turn")


LIFE = """WITH tr0 AS (SELECT conv_id, turn, min({'role': role, 'text': text}) AS r FROM conversations GROUP BY 1, 2), last AS (SELECT conv_id, arg_max({'to': CASE r.role WHEN 'system' THEN 'REOPENED' WHEN 'user' THEN 'IN_REVIEW' ELSE 'RESOLVED' END, 'sig': CAST(length(r.text) % 2 AS VARCHAR), 'a': r.role}, turn) AS t FROM tr0 WHERE turn > 0 GROUP BY 1)"""


def transitions(spark, sf):
    state = F.when(F.col("role") == "system", "REOPENED").when(F.col("role") == "user", "IN_REVIEW").otherwise("RESOLVED")
    return turns(spark, sf).where("turn > 0").select(F.col("conv_id").alias("subject_id"), F.col("turn").alias("position"), state.alias("to_state"), (F.length("text") % 2).cast("string").alias("evidence_signature"),
                                                     F.col("role").alias("assignee"), F.lit("NO_FINDING").alias("resolution"))


@query("lifecycle_states", LIFE + """, s AS (SELECT DISTINCT conv_id FROM tr0), j AS (SELECT s.conv_id, t, CASE WHEN t IS NULL THEN 'OPEN' WHEN t.to = 'RESOLVED' AND t.sig <> '0' THEN 'REOPENED_EVIDENCE_CHANGED' ELSE t.to END AS state FROM s LEFT JOIN last USING (conv_id))
 SELECT conv_id AS subject_id, state, t.a AS assignee, CASE WHEN state = 'RESOLVED' THEN 'NO_FINDING' END AS resolution FROM j""")
def lifecycle_states(spark, sf):
    sig = load(spark, sf, "conversations").select(F.col("conv_id").alias("subject_id")).distinct().withColumn("current_signature", F.lit("0"))
    return A.lifecycle_state(transitions(spark, sf), sig)


@query("reevaluation_needed", NODES + CLEARED_SQL + """, di AS (SELECT 'Z' || user_id AS subject_id, kind, id FROM nodes WHERE value >= 25), ch AS (SELECT subject_id, di.kind || ':' || di.id AS ref, coalesce(human_abnormal, true) <> true AS changed FROM di LEFT JOIN lv ON lv.kind = di.kind AND lv.id = di.id)
 SELECT subject_id, bool_or(changed) AS reevaluation_required, coalesce(string_agg(DISTINCT CASE WHEN changed THEN ref END, ',' ORDER BY CASE WHEN changed THEN ref END), '') AS changed_inputs FROM ch GROUP BY 1""")
def reevaluation_needed(spark, sf):
    inputs = B.nodes(spark, sf).where("value >= 25").select(F.concat(F.lit("Z"), "user_id").alias("subject_id"), "kind", "id", F.lit(True).alias("used_abnormal"))
    return A.reevaluation_needed(inputs, S.latest_verdicts(B.verdicts(spark, sf)))


# ---- idempotent stores --------------------------------------------------------------

@query("correlation_store_upsert", """SELECT o_custkey AS correlation_id, arg_max(o_totalprice, {'d': o_orderdate, 'k': o_orderkey}) AS score, strftime(min(o_orderdate), '%Y-%m-%d') AS created_at, strftime(max(o_orderdate), '%Y-%m-%d') AS updated_at FROM orders GROUP BY 1""")
def correlation_store_upsert(spark, sf):
    """Two overlapping batches and a full replay of the second leave one row per key, created_at from the first write."""
    from watchfold.session import scratch_path
    o = load(spark, sf, "orders").select(F.col("o_custkey").alias("correlation_id"), F.col("o_totalprice").alias("score"), F.to_date("o_orderdate").alias("created_at"), F.to_date("o_orderdate").alias("updated_at"), F.col("o_orderkey").alias("seq"))
    path = scratch_path(spark, "store")
    first, second = o.where("updated_at < '1998-01-01'"), o.where("updated_at >= '1997-06-01'")
    for batch in (first, second, second):
        U.upsert_parquet(spark, path, batch, ["correlation_id"], F.struct("updated_at", "seq"), ["created_at"])
    d = lambda c: F.date_format(c, "yyyy-MM-dd").alias(c)
    return spark.read.parquet(path).select("correlation_id", "score", d("created_at"), d("updated_at"))


@query("publish_insert_or_ignore", """WITH ex AS (SELECT user_id, event_type, min(event_id) AS event_id FROM events WHERE value >= 100 GROUP BY 1, 2), inc AS (SELECT user_id, event_type, min(event_id) AS event_id FROM events WHERE value < 100 GROUP BY 1, 2)
 SELECT * FROM ex UNION ALL SELECT * FROM inc WHERE NOT EXISTS (SELECT 1 FROM ex WHERE ex.user_id = inc.user_id AND ex.event_type = inc.event_type)""")
def publish_insert_or_ignore(spark, sf):
    e = load(spark, sf, "events").select("user_id", "event_type", "event_id", "value")
    empty = e.where("value >= 100").groupBy("user_id", "event_type").agg(F.min("event_id").alias("event_id"))
    fresh = U.insert_or_ignore(empty, e.where("value < 100").select("user_id", "event_type", "event_id"), ["user_id", "event_type"], F.col("event_id"))
    return empty.unionByName(fresh)


@query("save_decision_replace", "SELECT user_id AS event_id, arg_max(event_type, {'t': ts, 'e': event_id}) AS decision FROM events GROUP BY 1")
def save_decision_replace(spark, sf):
    e = load(spark, sf, "events")
    rows = e.select(F.col("user_id").alias("event_id"), F.col("event_type").alias("decision"), F.col("ts").alias("t"), F.col("event_id").alias("e"))
    return U.merge_latest(None, rows, ["event_id"], F.struct("t", "e")).select("event_id", "decision")
