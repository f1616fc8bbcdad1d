"""OpenSSH line parsing with native expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from watchfold.functions.columns import evaluate_once

# Line patterns and marker texts of the OpenSSH syslog format.
BASE = r"^(\w{3})\s+(\d{1,2})\s+(\d{2}:\d{2}:\d{2})\s+(\S+)\s+sshd\[(\d+)\]:\s+(.*)$"
FAILED_INVALID = r"Failed password for invalid user (.+?) from (\d{1,3}(?:\.\d{1,3}){3}) port (\d+)"
FAILED = r"Failed password for (\S+) from (\d{1,3}(?:\.\d{1,3}){3}) port (\d+)"
ACCEPTED = r"Accepted \S+ for (\S+) from (\d{1,3}(?:\.\d{1,3}){3}) port (\d+)"
INVALID_USER = r"Invalid user (.+?) from (\d{1,3}(?:\.\d{1,3}){3})"
REPEATED = r"message repeated (\d+) times:\s*\[\s*(.*)\s*\]"
IPV4 = r"(\d{1,3}(?:\.\d{1,3}){3})"
USER_FIELD = r"\buser=(\S+)"
RHOST_FIELD = r"\brhost=(\S+)"
FAILURES_FOR = r"failures for (\S+)"
PAM_MORE = r"PAM (\d+) more authentication failures"
HONEYPOT_USER = r"(?i)username:\s*(.*?),\s*password:"
MARKERS = [
    ("POSSIBLE BREAK-IN ATTEMPT", "breakin_warning"),
    ("Too many authentication failures", "too_many_auth_failures"),
    ("Connection closed by", "connection_closed"),
    ("Received disconnect from", "disconnect"),
    ("Did not receive identification string from", "no_identification"),
    ("PAM service(sshd) ignoring max retries", "max_retries_exceeded"),
]
EVENT_TYPES = ["failed_login", "repeated_message", "successful_login", "invalid_user", "auth_failure", "breakin_warning",
               "too_many_auth_failures", "pam_more_failures", "connection_closed", "disconnect", "no_identification",
               "max_retries_exceeded", "other"]


def capture(text: Column, pattern: str, group: int = 1) -> Column:
    """Regex group, or null when the pattern does not occur."""
    return F.nullif(F.regexp_extract(text, pattern, group), F.lit(""))


def first_ipv4(text: Column) -> Column:
    return capture(text, IPV4)


def rhost(text: Column) -> Column:
    return capture(text, RHOST_FIELD)


def honeypot_username(message: Column) -> Column:
    """Name in a honeypot login message; trimmed, blank becomes null."""
    return F.nullif(F.trim(F.regexp_extract(message, HONEYPOT_USER, 1)), F.lit(""))


def parse_lines(lines: DataFrame, value: str = "value", year: int = 2000) -> DataFrame:
    """Raw lines to typed events. Lines of other shapes are dropped; count them with `parse_report`.

    All work is regex expressions in one projection chain, so a log scan of any
    size is a map-only stage.
    """
    carried = [c for c in lines.columns if c != value]
    # One regex run per line: the groups are joined by a control character and split again.
    marked = F.regexp_replace(F.trim(F.col(value)), BASE, "$1\u0001$2\u0001$3\u0001$4\u0001$5\u0001$6")
    part = lambda i: F.col("parts")[i]
    base = evaluate_once(lines.select(*carried, F.col(value)), {"parts": F.split(marked, "\u0001")}).where(F.size("parts") == 6)
    base = base.select(*carried, F.try_to_timestamp(F.concat_ws(" ", F.lit(year), part(0), part(1), part(2)), F.lit("yyyy MMM d HH:mm:ss")).alias("timestamp"),
                       part(3).alias("hostname"), part(4).cast("int").alias("pid"), part(5).alias("message"))
    again = F.col("message").contains("message repeated")
    base = evaluate_once(base, {"repeats": F.when(again, capture(F.col("message"), REPEATED).cast("int"))})
    base = evaluate_once(base, {"body": F.when(F.col("repeats").isNotNull(), F.regexp_extract("message", REPEATED, 2))
                                         .otherwise(F.col("message"))})

    body, message, single = F.col("body"), F.col("message"), F.col("repeats").isNull()
    # The literal tests keep most lines away from the regexes they cannot match.
    failed, has = body.contains("Failed password for "), body.contains
    kind = (F.when(failed & body.rlike(FAILED_INVALID), "failed_invalid")
            .when(failed & body.rlike(FAILED), "failed")
            .when(~single, "repeated_message")
            .when(has("Accepted ") & body.rlike(ACCEPTED), "successful_login")
            .when(has("Invalid user ") & body.rlike(INVALID_USER), "invalid_user")
            .when(F.lower(body).contains("authentication failure"), "auth_failure"))
    for text, name in MARKERS[:2]:
        kind = kind.when(body.contains(text), name)
    kind = kind.when(has(" more authentication failures") & body.rlike(PAM_MORE), "pam_more_failures")
    for text, name in MARKERS[2:]:
        kind = kind.when(body.contains(text), name)
    typed = evaluate_once(base, {"kind": kind.otherwise("other")})

    k = F.col("kind")
    user = (F.when(k == "failed_invalid", F.regexp_extract(body, FAILED_INVALID, 1))
            .when(k == "failed", F.regexp_extract(body, FAILED, 1))
            .when(k == "successful_login", F.regexp_extract(body, ACCEPTED, 1))
            .when(k == "invalid_user", F.regexp_extract(body, INVALID_USER, 1))
            .when(k.isin("auth_failure", "pam_more_failures"), capture(message, USER_FIELD))
            .when(k == "too_many_auth_failures", capture(message, FAILURES_FOR)))
    ip = (F.when(k == "failed_invalid", F.regexp_extract(body, FAILED_INVALID, 2))
          .when(k == "failed", F.regexp_extract(body, FAILED, 2))
          .when(k == "successful_login", F.regexp_extract(body, ACCEPTED, 2))
          .when(k == "invalid_user", F.regexp_extract(body, INVALID_USER, 2))
          .when(k == "auth_failure", F.coalesce(first_ipv4(rhost(message)), first_ipv4(message)))
          .when(k.isin("breakin_warning", "too_many_auth_failures", "pam_more_failures", "connection_closed", "disconnect",
                       "no_identification"), first_ipv4(message)))
    port = (F.when(k == "failed_invalid", F.regexp_extract(body, FAILED_INVALID, 3))
            .when(k == "failed", F.regexp_extract(body, FAILED, 3))
            .when(k == "successful_login", F.regexp_extract(body, ACCEPTED, 3)))
    return typed.select(
        *carried, "timestamp", "hostname", "pid",
        F.when(k.isin("failed_invalid", "failed"), "failed_login").otherwise(k).alias("event_type"),
        user.alias("username"), ip.alias("source_ip"), port.cast("int").alias("source_port"),
        k.isin("failed_invalid", "invalid_user").alias("invalid_user"),
        (k == "successful_login").alias("success"),
        F.coalesce(F.col("repeats"), F.when(k == "pam_more_failures", F.regexp_extract(message, PAM_MORE, 1).cast("int")),
                   F.lit(1)).alias("event_count"),
        "message",
    )


def parse_report(lines: DataFrame, value: str = "value", by: list[str] | None = None) -> DataFrame:
    """Total, parsed and unparsed lines."""
    ok = F.trim(F.col(value)).rlike(BASE)
    return lines.groupBy(*(by or [])).agg(
        F.count(F.lit(1)).alias("total_lines"), F.count_if(ok).alias("parsed_lines"), F.count_if(~ok).alias("unparsed_lines"))
