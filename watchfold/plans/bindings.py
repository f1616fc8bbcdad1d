"""Views of the given tables in the shapes the operators expect.

Each view is written twice, for Spark and for the SQL check, and always covers
the whole source table. Counts of entities, zones and servers grow with the data.
Views that also feed streams take the table loader as an argument.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession, functions as F

from watchfold.functions.columns import evaluate_once
from watchfold.sources.tables import load

# Orders dealt to one task, on average.
DAYS_A_TASK = 250_000


def k_value():
    """Number inside `props`. A function, because columns need a session and imports must not."""
    return F.get_json_object("props", "$.k").cast("int")


K_SQL = "CAST(json_extract_string(props, '$.k') AS INT)"


def auth_events(spark: SparkSession, sf: str, load=load) -> DataFrame:
    """Authentication events: ten users share one source address."""
    entity = F.expr("user_id div 10")
    return load(spark, sf, "events").select(
        F.col("event_id").alias("line_number"),
        F.col("ts").alias("timestamp"),
        F.concat_ws(".", F.lit("10"), F.expr("(user_id div 10) div 65536 % 256"),
                    F.expr("(user_id div 10) div 256 % 256"), entity % 256).alias("source_ip"),
        F.expr("""CASE event_type WHEN 'error' THEN 'failed_login' WHEN 'signup' THEN 'successful_login'
                  WHEN 'click' THEN 'invalid_user' WHEN 'view' THEN 'disconnect' ELSE 'breakin_warning' END""").alias("event_type"),
        F.when(k_value() % 4 == 0, F.lit("root")).otherwise(F.concat(F.lit("u"), k_value() % 20)).alias("username"),
        (1 + k_value() % 3).cast("long").alias("event_count"),
        k_value().alias("k"), "value", "user_id",
    )


AUTH_SQL = f"""auth AS (
 SELECT event_id AS line_number, ts AS "timestamp",
  '10.' || ((user_id // 10) // 65536 % 256) || '.' || ((user_id // 10) // 256 % 256) || '.' || ((user_id // 10) % 256) AS source_ip,
  CASE event_type WHEN 'error' THEN 'failed_login' WHEN 'signup' THEN 'successful_login' WHEN 'click' THEN 'invalid_user'
   WHEN 'view' THEN 'disconnect' ELSE 'breakin_warning' END AS event_type,
  CASE WHEN {K_SQL} % 4 = 0 THEN 'root' ELSE 'u' || ({K_SQL} % 20) END AS username,
  CAST(1 + {K_SQL} % 3 AS BIGINT) AS event_count, {K_SQL} AS k, value, user_id
 FROM events)"""

# One row per (entity, day): the behavioural features every detector query starts from.
AUTH_FEATURES_SQL = AUTH_SQL + """, feat0 AS (
 SELECT source_ip, date_trunc('day', "timestamp") AS w,
  coalesce(sum(event_count) FILTER (event_type='failed_login'),0)::BIGINT AS failed_login_count,
  coalesce(sum(event_count) FILTER (event_type='successful_login'),0)::BIGINT AS successful_login_count,
  coalesce(sum(event_count) FILTER (event_type='invalid_user'),0)::BIGINT AS invalid_user_count,
  count(DISTINCT CASE WHEN event_type IN ('failed_login','successful_login') THEN username END)::BIGINT AS unique_users,
  coalesce(sum(event_count) FILTER (event_type IN ('failed_login','successful_login') AND lower(username)='root'),0)::BIGINT AS root_attempt_count,
  coalesce(sum(event_count) FILTER (event_type='breakin_warning'),0)::BIGINT AS breakin_warning_count,
  coalesce(sum(event_count) FILTER (event_type='disconnect'),0)::BIGINT AS disconnect_count,
  coalesce(sum(event_count) FILTER (event_type='no_identification'),0)::BIGINT AS no_identification_count,
  min("timestamp") FILTER (event_type='failed_login') AS first_fail,
  max("timestamp") FILTER (event_type='successful_login') AS last_ok
 FROM auth GROUP BY 1, 2),
feat AS (SELECT source_ip, CAST(epoch(w) AS BIGINT) AS window_start_s, failed_login_count, successful_login_count, invalid_user_count,
  unique_users,
  CASE WHEN failed_login_count + successful_login_count > 0 THEN failed_login_count / (failed_login_count + successful_login_count)::DOUBLE ELSE 0.0 END AS failure_ratio,
  (failed_login_count + successful_login_count) / 1440.0::DOUBLE AS attempt_rate,
  root_attempt_count, breakin_warning_count, disconnect_count, no_identification_count,
  CASE WHEN last_ok > first_fail THEN 1 ELSE 0 END AS success_after_failures,
  CASE WHEN failed_login_count > 0 THEN root_attempt_count / failed_login_count::DOUBLE ELSE 0.0 END AS root_attempt_ratio
 FROM feat0)"""

LINE_EXPR = """concat(date_format(ts, 'MMM'), ' ', lpad(cast(day(ts) as string), 2, ' '), ' ', date_format(ts, 'HH:mm:ss'),
 ' host', user_id % 7, CASE WHEN value > 200 THEN ' cron[1]: ' ELSE concat(' sshd[', 1000 + event_id % 30000, ']: ') END, {msg})"""
LINE_EXPR_SQL = """strftime(ts, '%b') || ' ' || lpad(CAST(day(ts) AS VARCHAR), 2, ' ') || ' ' || strftime(ts, '%H:%M:%S')
 || ' host' || (user_id % 7) || CASE WHEN value > 200 THEN ' cron[1]: ' ELSE ' sshd[' || (1000 + event_id % 30000) || ']: ' END || {msg}"""

# Message forms; {ip}, {port}, {user} and {n} are filled per dialect.
_MESSAGES = [
    ("error", 5, 0, "message repeated {n} times: [ Failed password for {user} from {ip} port {port} ssh2]"),
    ("error", 5, 1, "Failed password for invalid user {user} x from {ip} port {port} ssh2"),
    ("error", 5, 2, "message repeated {n} times: [ Failed password for invalid user {user} from {ip} port {port} ssh2]"),
    ("error", 5, 3, "message repeated {n} times: [ something else]"),
    ("error", 5, 4, "Failed password for {user} from {ip} port {port} ssh2"),
    ("signup", 2, 0, "Accepted password for {user} from {ip} port {port} ssh2"),
    ("signup", 2, 1, "Accepted publickey for {user} from {ip} port {port} ssh2"),
    ("click", 4, 0, "Invalid user {user} from {ip}"),
    ("click", 4, 1, "pam_unix(sshd:auth): authentication failure; logname= uid=0 euid=0 tty=ssh ruser= rhost={ip}  user={user}"),
    ("click", 4, 2, "pam_unix(sshd:auth): authentication failure; logname= uid=0 tty=ssh ruser= rhost=host{port}.example.org"),
    ("click", 4, 3, "Invalid user {user} y from {ip}"),
    ("view", 4, 0, "Received disconnect from {ip}: 11: Bye Bye [preauth]"),
    ("view", 4, 1, "Connection closed by {ip} [preauth]"),
    ("view", 4, 2, "Did not receive identification string from {ip}"),
    ("view", 4, 3, "PAM {n} more authentication failures; logname= uid=0 ruser= rhost={ip}  user={user}"),
    ("purchase", 4, 0, "reverse mapping checking getaddrinfo for a.example [{ip}] failed - POSSIBLE BREAK-IN ATTEMPT!"),
    ("purchase", 4, 1, "Disconnecting: Too many authentication failures for {user} [preauth]"),
    ("purchase", 4, 2, "PAM service(sshd) ignoring max retries; 6 > 3"),
    ("purchase", 4, 3, "Server listening on port 22."),
]


def _message_case(spark: bool) -> str:
    parts = {
        "ip": "source_ip", "user": "username",
        "port": "(1024 + user_id)" if spark else "(1024 + user_id)",
        "n": "(2 + k % 4)",
    }
    arms = []
    for kind, mod, rem, text in _MESSAGES:
        pieces, rest = [], text
        while rest:
            start = rest.find("{")
            if start < 0:
                pieces.append("'" + rest + "'")
                break
            if start:
                pieces.append("'" + rest[:start] + "'")
            end = rest.index("}")
            pieces.append(parts[rest[start + 1:end]])
            rest = rest[end + 1:]
        body = f"concat({', '.join(pieces)})" if spark else " || ".join(pieces)
        arms.append(f"WHEN raw_type = '{kind}' AND k % {mod} = {rem} THEN {body}")
    return "CASE " + " ".join(arms) + " END"


def auth_log(spark: SparkSession, sf: str) -> DataFrame:
    """The same events as raw OpenSSH lines (some of another program, which must not parse)."""
    base = auth_events(spark, sf)
    raw = {"failed_login": "error", "successful_login": "signup", "invalid_user": "click",
           "disconnect": "view", "breakin_warning": "purchase"}
    mapping = F.create_map(*[F.lit(x) for kv in raw.items() for x in kv])
    raw_events = (base.withColumn("raw_type", mapping[F.col("event_type")])
                  .withColumnsRenamed({"timestamp": "ts", "line_number": "event_id"}))
    return (evaluate_once(raw_events, {"value_text": F.expr(LINE_EXPR.format(msg=_message_case(True)))})
            .select(F.col("event_id").alias("line_number"), F.col("value_text").alias("value")))


AUTH_LOG_SQL = AUTH_SQL + f""", raw AS (SELECT line_number AS event_id, "timestamp" AS ts, source_ip, username, k, value, user_id,
  CASE event_type WHEN 'failed_login' THEN 'error' WHEN 'successful_login' THEN 'signup' WHEN 'invalid_user' THEN 'click'
   WHEN 'disconnect' THEN 'view' ELSE 'purchase' END AS raw_type FROM auth),
log AS (SELECT event_id AS line_number, {LINE_EXPR_SQL.format(msg='(' + _message_case(False) + ')')} AS line FROM raw)"""


def nodes(spark: SparkSession, sf: str, load=load) -> DataFrame:
    """Live evidence nodes of five kinds; ten users form a zone, three a rack, each user is a server."""
    return load(spark, sf, "events").withColumn("k", k_value()).select(
        F.expr("""CASE event_type WHEN 'error' THEN 'ssh' WHEN 'signup' THEN 'face' WHEN 'click' THEN 'ppe'
                  WHEN 'view' THEN 'maintenance' ELSE 'environment' END""").alias("kind"),
        F.lpad(F.col("event_id").cast("string"), 12, "0").alias("id"),
        F.concat(F.lit("Z"), F.expr("user_id div 10")).alias("zone_id"),
        F.when(F.col("k") >= 20, F.concat(F.lit("S"), F.col("user_id"))).alias("server_id"),
        F.when(F.col("k") >= 20, F.concat(F.lit("R"), F.expr("user_id div 3"))).alias("rack_id"),
        F.expr("""CASE event_type
          WHEN 'error' THEN CASE WHEN value >= 120 THEN 'EXPLICIT_SECURITY_EVENT' WHEN value >= 60 THEN 'HIGH_CONFIDENCE_ANOMALY'
             WHEN value >= 25 THEN 'ANOMALY_CANDIDATE' ELSE 'NO_ANOMALY_EVIDENCE' END
          WHEN 'signup' THEN CASE WHEN value >= 60 THEN 'UNKNOWN_PERSON' WHEN value >= 25 THEN 'UNAUTHORIZED' ELSE 'RECOGNIZED' END
          WHEN 'click' THEN CASE WHEN value >= 25 THEN 'PPE_NON_COMPLIANT' ELSE 'COMPLIANT' END
          WHEN 'view' THEN CASE WHEN value >= 25 THEN 'AT_RISK' ELSE 'NORMAL' END
          ELSE CASE WHEN value >= 120 THEN 'SMOKE_DETECTED' WHEN value >= 60 THEN 'HIGH_TEMPERATURE' WHEN value >= 25 THEN 'LOW_HUMIDITY'
             ELSE 'NORMAL' END END""").alias("state"),
        F.col("ts"),
        F.when((F.col("event_type") == "view") & (F.col("k") >= 10), F.col("k") / 100.0).alias("failure_probability"),
        F.when((F.col("event_type") == "click") & (F.col("k") >= 30), F.col("k") / 100.0).alias("confidence"),
        F.when(F.col("event_type") == "purchase",
               F.expr("CASE WHEN k >= 50 THEN 'ENVIRONMENTAL_SENSOR' WHEN k >= 20 THEN 'HARDWARE_TELEMETRY' END")).alias("source_class"),
        "k", "user_id", "value",
    )


NODES_SQL = f"""nodes AS (SELECT
 CASE event_type WHEN 'error' THEN 'ssh' WHEN 'signup' THEN 'face' WHEN 'click' THEN 'ppe' WHEN 'view' THEN 'maintenance' ELSE 'environment' END AS kind,
 lpad(CAST(event_id AS VARCHAR), 12, '0') AS id, 'Z' || (user_id // 10) AS zone_id,
 CASE WHEN {K_SQL} >= 20 THEN 'S' || user_id END AS server_id, CASE WHEN {K_SQL} >= 20 THEN 'R' || (user_id // 3) END AS rack_id,
 CASE event_type
   WHEN 'error' THEN CASE WHEN value >= 120 THEN 'EXPLICIT_SECURITY_EVENT' WHEN value >= 60 THEN 'HIGH_CONFIDENCE_ANOMALY' WHEN value >= 25 THEN 'ANOMALY_CANDIDATE' ELSE 'NO_ANOMALY_EVIDENCE' END
   WHEN 'signup' THEN CASE WHEN value >= 60 THEN 'UNKNOWN_PERSON' WHEN value >= 25 THEN 'UNAUTHORIZED' ELSE 'RECOGNIZED' END
   WHEN 'click' THEN CASE WHEN value >= 25 THEN 'PPE_NON_COMPLIANT' ELSE 'COMPLIANT' END
   WHEN 'view' THEN CASE WHEN value >= 25 THEN 'AT_RISK' ELSE 'NORMAL' END
   ELSE CASE WHEN value >= 120 THEN 'SMOKE_DETECTED' WHEN value >= 60 THEN 'HIGH_TEMPERATURE' WHEN value >= 25 THEN 'LOW_HUMIDITY' ELSE 'NORMAL' END END AS state,
 ts, epoch_us(ts) AS us,
 CASE WHEN event_type = 'view' AND {K_SQL} >= 10 THEN {K_SQL} / 100.0::DOUBLE END AS failure_probability,
 CASE WHEN event_type = 'click' AND {K_SQL} >= 30 THEN {K_SQL} / 100.0::DOUBLE END AS confidence,
 CASE WHEN event_type = 'purchase' THEN CASE WHEN {K_SQL} >= 50 THEN 'ENVIRONMENTAL_SENSOR' WHEN {K_SQL} >= 20 THEN 'HARDWARE_TELEMETRY' END END AS source_class,
 {K_SQL} AS k, user_id, value
 FROM events)"""


def verdicts(spark: SparkSession, sf: str, base: DataFrame | None = None) -> DataFrame:
    """Human verdicts on nodes (`base`, if already at hand): several per node are possible, many nodes have none.

    Both verdicts of a node come from one pass. A filter on them would be merged into the scan and parse `props` once a comparison,
    so those without a verdict are dropped inside the array instead."""
    base = nodes(spark, sf) if base is None else base
    mapped = base.withColumns({
        "cleared": F.expr("""CASE kind WHEN 'ssh' THEN 'NO_ANOMALY_EVIDENCE' WHEN 'face' THEN 'AUTHORIZED' WHEN 'ppe' THEN 'COMPLIANT' ELSE 'NORMAL' END"""),
        "raised": F.expr("""CASE kind WHEN 'ssh' THEN 'ANOMALOUS' WHEN 'face' THEN 'UNAUTHORIZED' WHEN 'ppe' THEN 'NON_COMPLIANT'
                            WHEN 'maintenance' THEN 'AT_RISK' ELSE 'HIGH_TEMPERATURE' END"""),
    })
    one = F.struct(F.col("ts").alias("recorded_at"),
                   F.expr("""CASE WHEN k < 12 THEN 'OVERRIDDEN' WHEN k < 24 THEN 'CONFIRMED' WHEN k < 36 THEN 'INCONCLUSIVE'
                             WHEN k < 42 THEN 'OVERRIDDEN' END""").alias("verdict"),
                   F.expr("CASE WHEN k < 12 THEN cleared WHEN k >= 36 AND k < 42 THEN raised END").alias("corrected_status"))
    two = F.struct(F.expr("ts + INTERVAL 1 HOUR").alias("recorded_at"),
                   F.expr("CASE WHEN k < 4 THEN 'CONFIRMED' WHEN k >= 20 AND k < 24 THEN 'OVERRIDDEN' END").alias("verdict"),
                   F.expr("CASE WHEN k >= 20 AND k < 24 THEN cleared END").alias("corrected_status"))
    return mapped.select("kind", F.col("id").alias("evidence_id"), F.inline(F.filter(F.array(one, two), lambda v: v["verdict"].isNotNull())))


VERDICTS_SQL = """vmap AS (SELECT *, CASE kind WHEN 'ssh' THEN 'NO_ANOMALY_EVIDENCE' WHEN 'face' THEN 'AUTHORIZED' WHEN 'ppe' THEN 'COMPLIANT' ELSE 'NORMAL' END AS cleared,
  CASE kind WHEN 'ssh' THEN 'ANOMALOUS' WHEN 'face' THEN 'UNAUTHORIZED' WHEN 'ppe' THEN 'NON_COMPLIANT' WHEN 'maintenance' THEN 'AT_RISK' ELSE 'HIGH_TEMPERATURE' END AS raised FROM nodes),
verdicts AS (SELECT * FROM (
 SELECT kind, id AS evidence_id, ts AS recorded_at,
  CASE WHEN k < 12 THEN 'OVERRIDDEN' WHEN k < 24 THEN 'CONFIRMED' WHEN k < 36 THEN 'INCONCLUSIVE' WHEN k < 42 THEN 'OVERRIDDEN' END AS verdict,
  CASE WHEN k < 12 THEN cleared WHEN k >= 36 AND k < 42 THEN raised END AS corrected_status FROM vmap
 UNION ALL
 SELECT kind, id, ts + INTERVAL 1 HOUR, CASE WHEN k < 4 THEN 'CONFIRMED' WHEN k >= 20 AND k < 24 THEN 'OVERRIDDEN' END,
  CASE WHEN k >= 20 AND k < 24 THEN cleared END FROM vmap) WHERE verdict IS NOT NULL)"""


def entity_days(spark: SparkSession, sf: str) -> DataFrame:
    """Drive-days: one row per customer and order date (largest order key wins).

    Customers are dealt over partitions whose number grows with the orders, so a task's memory does not; picks, registry and labels
    by customer need no other shuffle. Each column is picked by itself (ties cannot differ, the order key is the key of the table):
    numbers have buffers of fixed width, which are hashed in place of sorted, and a column that is not read is not picked."""
    orders = load(spark, sf, "orders")
    parts = max(spark.sparkContext.defaultParallelism, math.ceil(orders.count() / DAYS_A_TASK))
    failure = F.when((F.col("o_orderpriority") == "1-URGENT") & (F.col("o_totalprice") > 450000), 1).otherwise(0)
    of = lambda c, name: F.max_by(c, "o_orderkey").alias(name)
    picked = orders.repartition(parts, "o_custkey").groupBy("o_custkey", "o_orderdate").agg(
        of(failure, "failure"), of("o_totalprice", "o_totalprice"), of("o_orderpriority", "o_orderpriority"), of("o_orderstatus", "o_orderstatus"))
    return picked.select(
        F.col("o_custkey").alias("serial_number"),
        F.to_date("o_orderdate").alias("date"),
        F.concat(F.lit("M"), F.col("o_orderstatus")).alias("model"),
        F.coalesce("failure", F.lit(0)).alias("failure"),
        F.when(F.col("o_totalprice") >= 25000, F.col("o_totalprice")).alias("value"),
        F.concat(F.year("o_orderdate"), F.lit("H"), F.when(F.month("o_orderdate") <= 6, 1).otherwise(2)).alias("period"),
        F.col("o_orderpriority").alias("priority"),
    )


ENTITY_DAYS_SQL = """picked AS (SELECT o_custkey, o_orderdate, arg_max({'p': o_totalprice, 'pr': o_orderpriority, 's': o_orderstatus}, o_orderkey) AS o
  FROM orders GROUP BY 1, 2),
days AS (SELECT o_custkey AS serial_number, CAST(o_orderdate AS DATE) AS date, 'M' || o.s AS model,
  CASE WHEN o.pr = '1-URGENT' AND o.p > 450000 THEN 1 ELSE 0 END AS failure, CASE WHEN o.p >= 25000 THEN o.p END AS value,
  year(o_orderdate) || 'H' || CASE WHEN month(o_orderdate) <= 6 THEN 1 ELSE 2 END AS period, o.pr AS priority FROM picked)"""


def scored(spark: SparkSession, sf: str) -> DataFrame:
    """Scored rows with heavy score ties: one row per line item."""
    return load(spark, sf, "lineitem").select(
        F.col("l_suppkey").alias("serial_number"), F.to_date("l_shipdate").alias("date"),
        F.when(F.col("l_returnflag") == "R", 1).otherwise(0).alias("y"),
        F.round(F.col("l_discount") * 10, 1).alias("probability"),
        F.col("l_linestatus").alias("model"),
        F.date_add(F.to_date("l_shipdate"), F.col("l_linenumber")).alias("failure_date"),
        F.col("l_quantity").alias("quantity"),
        F.col("l_orderkey").alias("query_id"), F.col("l_linenumber").alias("position"), F.col("l_partkey").alias("document"),
    )


SCORED_SQL = """scored AS (SELECT l_suppkey AS serial_number, CAST(l_shipdate AS DATE) AS date, CASE WHEN l_returnflag='R' THEN 1 ELSE 0 END AS y,
  round(l_discount * 10, 1) AS probability, l_linestatus AS model, CAST(l_shipdate AS DATE) + l_linenumber AS failure_date, l_quantity AS quantity,
  l_orderkey AS query_id, l_linenumber AS position, l_partkey AS document FROM lineitem)"""
