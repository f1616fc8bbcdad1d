"""Entity x time-window behavioural features and log summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

FEATURES = ["failed_login_count", "successful_login_count", "invalid_user_count", "unique_users", "failure_ratio", "attempt_rate",
            "root_attempt_count", "breakin_warning_count", "disconnect_count", "no_identification_count",
            "success_after_failures", "root_attempt_ratio"]
SKETCH_BITS = 12


def ratio(num: Column, den: Column) -> Column:
    """num / den, 0.0 when the denominator is not positive."""
    return F.when(den > 0, num / den).otherwise(F.lit(0.0))


def assign_windows(events: DataFrame, duration: str = "5 minutes", ts: str = "timestamp", entity: str = "source_ip") -> DataFrame:
    """Rows with an entity, in epoch-aligned windows."""
    w = F.window(ts, duration)
    return events.where(F.col(entity).isNotNull()).withColumn("window", w)


def entity_window_features(events: DataFrame, duration: str = "5 minutes", minutes: float = 5.0,
                           entity: str = "source_ip", exact_distinct: bool = True) -> DataFrame:
    """Twelve behavioural features per entity and window.

    Partial aggregation runs before the shuffle, so a hot entity costs one row per
    task and window. `exact_distinct=False` is the form a stream may use: distinct users are
    a sketch of at most 2^SKETCH_BITS bytes for each key, with a standard error of 1.04 / 2^(SKETCH_BITS / 2)
    (1.6 %) for many users and no error in practice below a few hundred.
    """
    t, n = F.col("event_type"), F.col("event_count")
    of = lambda *kinds: F.coalesce(F.sum(F.when(t.isin(*kinds), n)), F.lit(0)).cast("long")
    attempt = t.isin("failed_login", "successful_login")
    name = F.when(attempt, F.col("username"))
    users = F.count_distinct(name) if exact_distinct else F.coalesce(F.hll_sketch_estimate(F.hll_sketch_agg(name, F.lit(SKETCH_BITS))), F.lit(0))
    base = assign_windows(events, duration, entity=entity).groupBy(entity, "window").agg(
        of("failed_login").alias("failed_login_count"),
        of("successful_login").alias("successful_login_count"),
        of("invalid_user").alias("invalid_user_count"),
        users.cast("long").alias("unique_users"),
        F.coalesce(F.sum(F.when(attempt & (F.lower("username") == "root"), n)), F.lit(0)).cast("long").alias("root_attempt_count"),
        of("breakin_warning").alias("breakin_warning_count"),
        of("disconnect").alias("disconnect_count"),
        of("no_identification").alias("no_identification_count"),
        F.min(F.when(t == "failed_login", F.col("timestamp"))).alias("first_failure"),
        F.max(F.when(t == "successful_login", F.col("timestamp"))).alias("last_success"),
    )
    total = F.col("failed_login_count") + F.col("successful_login_count")
    return base.select(
        entity, F.col("window.start").alias("window_start"), F.col("window.end").alias("window_end"),
        "failed_login_count", "successful_login_count", "invalid_user_count", "unique_users",
        ratio(F.col("failed_login_count"), total).alias("failure_ratio"),
        (total / F.lit(float(minutes))).alias("attempt_rate"),
        "root_attempt_count", "breakin_warning_count", "disconnect_count", "no_identification_count",
        F.coalesce((F.col("last_success") > F.col("first_failure")).cast("int"), F.lit(0)).alias("success_after_failures"),
        ratio(F.col("root_attempt_count"), F.col("failed_login_count")).alias("root_attempt_ratio"),
    )


def event_distribution(events: DataFrame, kind: str = "event_type", count: str | None = "event_count") -> DataFrame:
    kind_col = F.coalesce(F.col(kind), F.lit("<missing>")).alias(kind)
    occurrences = F.sum(count) if count else F.count(F.lit(1))
    return events.groupBy(kind_col).agg(F.count(F.lit(1)).alias("rows"), occurrences.alias("occurrences"))


# ---- honeypot sessions ------------------------------------------------------

# Event names of the honeypot data set.
LOGIN, CONNECT, DISCONNECT, COMMAND = "SSH login", "SSH connect", "SSH disconnect", "exec_command"


def with_login_flags(events: DataFrame, username: Column) -> DataFrame:
    t = F.col("event_type")
    return events.withColumn("username", username).withColumns({
        "is_login": t == LOGIN, "is_connect": t == CONNECT, "is_disconnect": t == DISCONNECT, "is_command": t == COMMAND,
    }).withColumn("is_root_login", F.col("is_login") & (F.lower(F.coalesce("username", F.lit(""))) == "root"))


def _kind_counts() -> dict[str, Column]:
    return {c: F.count_if(F.col(f"is_{c}")) for c in ("connect", "login", "disconnect", "command")}


def honeypot_windows(flagged: DataFrame, duration: str = "5 minutes") -> DataFrame:
    counts = _kind_counts()
    g = flagged.where(F.col("ip").isNotNull()).groupBy(F.col("ip").alias("source_ip"), F.window("timestamp", duration).alias("w")).agg(
        F.count(F.lit(1)).alias("event_count"),
        *[c.alias(f"{n}_count") for n, c in counts.items()],
        F.count_distinct("session_id").alias("unique_sessions"),
        F.count_distinct(F.when(F.col("is_login"), F.col("username"))).alias("unique_login_users"),
        F.count_if("is_root_login").alias("root_login_count"))
    return g.select("source_ip", F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), "event_count",
                    *[f"{n}_count" for n in counts], "unique_sessions", "unique_login_users", "root_login_count",
                    ratio(F.col("root_login_count"), F.col("login_count")).alias("root_login_ratio"),
                    (F.col("login_count") > 0).cast("int").alias("has_login"),
                    (F.col("command_count") > 0).cast("int").alias("has_command"))


def username_summary(flagged: DataFrame) -> DataFrame:
    return (flagged.where("is_login AND username IS NOT NULL").groupBy("username")
            .agg(F.count(F.lit(1)).alias("login_events"), F.count_distinct("ip").alias("unique_ips"),
                 F.count_distinct("session_id").alias("unique_sessions"))
            .orderBy(F.desc("login_events"), "username"))


def ip_summary(flagged: DataFrame) -> DataFrame:
    counts = _kind_counts()
    return flagged.where(F.col("ip").isNotNull()).groupBy(F.col("ip").alias("source_ip")).agg(
        F.min("timestamp").alias("first_seen"), F.max("timestamp").alias("last_seen"),
        F.count(F.lit(1)).alias("total_events"), *[c.alias(f"{n}_events") for n, c in counts.items()],
        F.count_distinct("session_id").alias("unique_sessions"),
        F.count_distinct(F.when(F.col("is_login"), F.col("username"))).alias("unique_login_users"),
        F.count_if("is_root_login").alias("root_login_events"),
    ).withColumn("active_minutes", (F.unix_micros("last_seen") - F.unix_micros("first_seen")) / 60e6)


def concentration(summary: DataFrame, sizes: tuple[int, ...] = (1, 10, 100)) -> DataFrame:
    """Share of all events held by the n busiest sources. Only max(n) rows are ranked."""
    top = summary.orderBy(F.desc("total_events"), "source_ip").limit(max(sizes))
    ranked = top.withColumn("place", F.row_number().over(W.orderBy(F.desc("total_events"), "source_ip")))
    held = ranked.agg(*[F.sum(F.when(F.col("place") <= n, F.col("total_events"))).alias(f"n{n}") for n in sizes])
    total = summary.agg(F.sum("total_events").alias("total"))
    pairs = F.array(*[F.struct(F.lit(n).alias("top_n"), F.col(f"n{n}").alias("held")) for n in sizes])
    return (held.crossJoin(total).select(F.explode(pairs).alias("p"), "total")
            .select("p.top_n", F.col("p.held").alias("events"), (F.col("p.held") / F.col("total") * 100).alias("share_pct")))


def session_summary(flagged: DataFrame) -> DataFrame:
    """Per session: first non-null address by time, span, counts, sorted user names, any root login."""
    counts = _kind_counts()
    return flagged.where(F.col("session_id").isNotNull()).groupBy("session_id").agg(
        F.min_by("ip", F.when(F.col("ip").isNotNull(), F.struct("timestamp", "ip"))).alias("source_ip"),
        F.min("timestamp").alias("first_seen"), F.max("timestamp").alias("last_seen"),
        F.count(F.lit(1)).alias("event_count"), *[c.alias(f"{n}_events") for n, c in counts.items()],
        F.array_join(F.array_sort(F.collect_set(F.when(F.col("is_login"), F.col("username")))), ", ").alias("usernames"),
        F.max(F.col("is_root_login").cast("int")).alias("has_root_login"),
    ).withColumn("duration_seconds", (F.unix_micros("last_seen") - F.unix_micros("first_seen")) / 1e6)
