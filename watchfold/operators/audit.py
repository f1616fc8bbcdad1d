"""Hash-chained audit records, checkpoints, verdict overlays and lifecycle state."""

from __future__ import annotations

import hashlib
import json

from pyspark.sql import Column, DataFrame, functions as F

from watchfold.functions.jsontext import canonical

GENESIS = "GENESIS"
# Allowed lifecycle transitions (action -> from states) and their targets.
ALLOWED = {"START_REVIEW": ["OPEN", "REOPENED", "REOPENED_EVIDENCE_CHANGED"], "RESOLVE": ["IN_REVIEW"], "REOPEN": ["RESOLVED"]}
TARGET = {"START_REVIEW": "IN_REVIEW", "RESOLVE": "RESOLVED", "REOPEN": "REOPENED"}
MIN_RATIONALE = 15


def seal(records: DataFrame, chain: str, position: str, fields: list[str]) -> DataFrame:
    """Append hashes: entry_hash = SHA-256 of the canonical record with the previous hash.

    A chain is sequential by definition. Records are partitioned by chain, sorted, and
    streamed with one hash carried along, so a long chain costs time but no memory."""
    base = records.select(chain, position, *[f for f in fields if f not in (chain, position)])
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in base.schema.fields) + ", previous_hash string, entry_hash string"

    def run(batches):
        current, previous = None, GENESIS
        for b in batches:
            before, entry = [], []
            for row in b.to_dict("records"):
                if row[chain] != current:
                    current, previous = row[chain], GENESIS
                body = {f: (None if row[f] is None or row[f] != row[f] else row[f]) for f in fields} | {"previous_hash": previous}
                before.append(previous)
                previous = hashlib.sha256(json.dumps(body, sort_keys=True, separators=(",", ":")).encode()).hexdigest()
                entry.append(previous)
            yield b.assign(previous_hash=before, entry_hash=entry)

    return (base.repartition(chain).sortWithinPartitions(chain, position).mapInPandas(run, schema))


def verify(records: DataFrame, chain: str, position: str, fields: list[str], numbers: set[str] = frozenset()) -> DataFrame:
    """Status per chain. Every record is checked on its own against the record before it (an equi
    join on the position), so one long chain spreads over all tasks."""
    previous = records.select(chain, (F.col(position) + 1).alias(position), F.col("entry_hash").alias("__expected"))
    j = records.join(previous, [chain, position], "left")
    body = canonical({f: F.col(f) for f in fields} | {"previous_hash": F.col("previous_hash")}, set(numbers))
    reason = (F.when(F.col("previous_hash") != F.coalesce("__expected", F.lit(GENESIS)), "PREVIOUS_HASH_MISMATCH")
              .when(F.col("entry_hash") != F.sha2(body, 256), "ENTRY_HASH_MISMATCH"))
    g = j.withColumn("reason", reason).groupBy(chain).agg(
        F.count(F.lit(1)).alias("records"), F.min(F.when(F.col("reason").isNotNull(), F.struct(position, "reason"))).alias("bad"),
        F.max_by("entry_hash", position).alias("head"))
    ok = F.col("bad").isNull()
    return g.select(chain, F.when(ok, "PASS").otherwise("FAILED").alias("status"), "records", F.col(f"bad.{position}").alias("failed_position"), F.col("bad.reason").alias("reason"),
                    F.when(ok, F.col("head")).alias("head_hash"))


def snapshot(records: DataFrame, chain: str, position: str) -> DataFrame:
    """Checkpoint row per chain: length and head hash."""
    return records.groupBy(chain).agg(F.count(F.lit(1)).alias("length"), F.max_by("entry_hash", position).alias("head_hash"))


def verify_checkpoint(records: DataFrame, checkpoint: DataFrame, chain: str, position: str) -> DataFrame:
    """The record at the saved length must carry the saved hash (positions count from 0)."""
    at = checkpoint.select(chain, (F.col("length") - 1).alias(position), F.col("head_hash").alias("saved"))
    j = at.join(records.select(chain, position, "entry_hash"), [chain, position], "left")
    return j.select(chain, F.when(F.col("entry_hash").isNull(), "RECORDS_MISSING").when(F.col("entry_hash") != F.col("saved"), "HASH_MISMATCH").otherwise("PASS").alias("status"))


def lifecycle_state(transitions: DataFrame, signatures: DataFrame) -> DataFrame:
    """Current state per subject; RESOLVED with changed evidence is REOPENED_EVIDENCE_CHANGED, no record is OPEN."""
    last = transitions.groupBy("subject_id").agg(F.max_by(F.struct("to_state", "evidence_signature", "assignee", "resolution"), "position").alias("t"))
    j = signatures.join(last, "subject_id", "left")
    state = F.when(F.col("t").isNull(), "OPEN").when((F.col("t.to_state") == "RESOLVED") & (F.col("t.evidence_signature") != F.col("current_signature")), "REOPENED_EVIDENCE_CHANGED") \
             .otherwise(F.col("t.to_state"))
    return j.select("subject_id", state.alias("state"), F.col("t.assignee").alias("assignee"), F.when(state == "RESOLVED", F.col("t.resolution")).alias("resolution"))


def reevaluation_needed(decision_inputs: DataFrame, latest: DataFrame) -> DataFrame:
    """Decisions with an input whose abnormal flag differs from the one used (subject_id, kind, id, used_abnormal)."""
    now = F.coalesce("human_abnormal", F.lit(True))
    j = decision_inputs.join(latest.select("kind", "id", "human_abnormal"), ["kind", "id"], "left").withColumn("changed", now != F.col("used_abnormal"))
    return j.groupBy("subject_id").agg(F.bool_or("changed").alias("reevaluation_required"),
                                       F.array_join(F.array_sort(F.collect_set(F.when(F.col("changed"), F.concat_ws(":", "kind", "id")))), ",").alias("changed_inputs"))
