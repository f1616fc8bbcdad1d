"""The common event envelope: adapters, validation, flattening, allow-lists."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F, types as T

from watchfold.functions.jsonwalk import drop_keys, let
from watchfold.operators.assess import ABNORMAL_STATES, DRIVE_THRESHOLD, lookup

# Vocabulary of the envelope.
SCHEMA_VERSION = "1.0"
DOMAINS = ["CYBERSECURITY", "PHYSICAL_SECURITY", "SAFETY", "MAINTENANCE", "ENVIRONMENTAL"]
SOURCE_TYPES = ["REAL_DATASET", "PUBLIC_DATASET", "SYNTHETIC", "CONTROLLED_TEST", "LIVE"]
MAPPING_TYPES = ["NONE", "SYNTHETIC_TOPOLOGY", "SYNTHETIC_SCENARIO"]
ROOT = {"event_id", "schema_version", "timestamp", "window", "domain", "event_type", "source", "entities", "location", "assessment", "evidence", "provenance"}
ROOT_REQUIRED = ["event_id", "schema_version", "timestamp", "domain", "event_type", "source", "entities", "location", "assessment", "evidence", "provenance"]
NESTED = {  # object: (required keys, other allowed keys)
    "window": (["start", "end"], []),
    "source": (["component", "component_version"], ["model_name"]),
    "entities": ([], ["person_id", "source_ip", "asset_id", "server_id", "camera_id", "sensor_id", "equipment_id"]),
    "location": ([], ["data_center_id", "zone_id", "rack_id", "access_point_id"]),
    "assessment": (["state", "confidence"], ["score", "anomaly_detected"]),
    "provenance": (["source_type", "synthetic_mapping", "mapping_type", "original_timestamp", "scenario_id"], ["dataset_name", "original_event_id"]),
}
# Detector status to envelope state.
PPE_STATES = {"COMPLIANT": "PPE_COMPLIANT", "NON_COMPLIANT": "PPE_NON_COMPLIANT", "NO_PERSON": "NO_PERSON_DETECTED"}
FACE_STATES = {"RECOGNIZED": "RECOGNIZED_PERSON", "UNKNOWN": "UNKNOWN_PERSON", "NO_FACE": "NO_FACE_DETECTED", "MULTIPLE_FACES": "MULTIPLE_FACES_DETECTED"}
EVENT_TYPES = {"CYBERSECURITY": "SSH_BEHAVIOR_ASSESSMENT", "MAINTENANCE": "STORAGE_FAILURE_RISK_ASSESSMENT", "ENVIRONMENTAL": "ENVIRONMENTAL_CONDITION_ASSESSMENT",
               "PHYSICAL_SECURITY": "FACE_RECOGNITION_ASSESSMENT", "SAFETY": "PPE_COMPLIANCE_ASSESSMENT"}
# Keys that never reach audit storage.
DENIED_KEYS = {"facial_area", "landmarks", "embedding", "embeddings", "face_embedding", "image", "image_bytes", "image_base64", "image_path", "thumbnail",
               "rationale", "reviewer", "evaluated_by", "created_by", "owner", "password", "api_key", "token", "authorization_header", "raw_log", "raw_lines"}


def iso(ts: Column) -> Column:
    """UTC ISO-8601 text with a Z."""
    return F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss'Z'")


def normalize_time(text: Column, naive: str = "reject") -> Column:
    """Timestamp of ISO text. Text without an offset gives null (`reject`) or counts as UTC (`utc`)."""
    ts = F.try_to_timestamp(text)
    if naive == "utc":
        return ts
    return F.when(text.rlike(r"(Z|[+-]\d{2}:?\d{2})$"), ts)


def _text(**cols: Column | str | None) -> Column:
    make = lambda v: v if isinstance(v, Column) else F.lit(v).cast("string")
    return F.struct(*[make(v).alias(k) for k, v in cols.items()])


def adapt(df: DataFrame, domain: str, *, event_id: Column, ts: Column, state: Column, evidence: Column, anomaly: Column, confidence: Column | None = None,
          score: Column | None = None, window: tuple[Column, Column] | None = None, entities: dict[str, Column] | None = None, zone: Column | None = None) -> DataFrame:
    """One domain's assessments as envelopes. Confidence may be text or number and is kept in two columns."""
    ids = {k: (entities or {}).get(k) for k in NESTED["entities"][1]}
    start, end = window or (F.lit(None).cast("timestamp"), F.lit(None).cast("timestamp"))
    conf = confidence if confidence is not None else F.lit(None).cast("string")
    is_text = dict(df.select(conf.alias("c")).dtypes)["c"] == "string"
    return df.select(
        event_id.cast("string").alias("event_id"), F.lit(SCHEMA_VERSION).alias("schema_version"), iso(ts).alias("timestamp"),
        F.when(start.isNotNull(), F.struct(iso(start).alias("start"), iso(end).alias("end"))).alias("window"),
        F.lit(domain).alias("domain"), F.lit(EVENT_TYPES[domain]).alias("event_type"),
        _text(component=domain.lower() + "_detector", component_version="1.0", model_name=None).alias("source"),
        _text(**ids).alias("entities"), _text(data_center_id=None, zone_id=zone, rack_id=None, access_point_id=None).alias("location"),
        F.struct(state.alias("state"), (conf if is_text else F.lit(None).cast("string")).alias("confidence_label"),
                 (F.lit(None) if is_text else conf).cast("double").alias("confidence_num"),
                 (score if score is not None else F.lit(None)).cast("double").alias("score"), anomaly.alias("anomaly_detected")).alias("assessment"),
        F.to_json(evidence).alias("evidence"),
        F.struct(F.lit("PUBLIC_DATASET").alias("source_type"), F.lit(False).alias("synthetic_mapping"), F.lit("NONE").alias("mapping_type"), iso(ts).alias("original_timestamp"),
                 F.lit(None).cast("string").alias("scenario_id"), F.lit(None).cast("string").alias("dataset_name"), event_id.cast("string").alias("original_event_id")).alias("provenance"))


def maintenance_conflict(state: Column, probability: Column, threshold: float = DRIVE_THRESHOLD) -> Column:
    """True when the state contradicts the probability."""
    return (state == "AT_RISK") != (probability >= threshold)


def flatten(events: DataFrame) -> DataFrame:
    """Envelope to one flat property row."""
    return events.select(
        "event_id", "schema_version", "timestamp", F.col("window.start").alias("window_start"), F.col("window.end").alias("window_end"), "domain", "event_type",
        F.col("source.component").alias("component"), *[F.col(f"entities.{c}").alias(c) for c in NESTED["entities"][1]],
        F.col("location.zone_id").alias("zone_id"), F.col("assessment.state").alias("state"), F.col("assessment.confidence_label").alias("confidence_label"),
        F.col("assessment.confidence_num").alias("confidence_num"), F.col("assessment.score").alias("score"), F.col("assessment.anomaly_detected").alias("anomaly_detected"),
        F.col("provenance.source_type").alias("source_type"), F.col("provenance.mapping_type").alias("mapping_type"),
        F.col("provenance.original_event_id").alias("original_event_id"), F.col("provenance.scenario_id").alias("scenario_id"), "evidence")


# JSON type of each key (N number, S string, B boolean, O object; ? also null).
TYPES = {
    "event_id": "S", "schema_version": "S", "timestamp": "S", "window": "O?", "domain": "S", "event_type": "S", "source": "O", "entities": "O", "location": "O", "assessment": "O", "evidence": "O", "provenance": "O",
    "window.start": "S", "window.end": "S", "source.component": "S", "source.component_version": "S", "source.model_name": "S?",
    **{f"entities.{k}": "S?" for k in NESTED["entities"][1]}, **{f"location.{k}": "S?" for k in NESTED["location"][1]},
    "assessment.state": "S", "assessment.confidence": "SN?", "assessment.score": "N?", "assessment.anomaly_detected": "B?",
    "provenance.source_type": "S", "provenance.dataset_name": "S?", "provenance.original_event_id": "S?", "provenance.synthetic_mapping": "B", "provenance.mapping_type": "S?",
    "provenance.original_timestamp": "S?", "provenance.scenario_id": "S?",
}
_KINDS = {"S": "STRING", "N": "BIGINT|DOUBLE|FLOAT|DECIMAL.*", "B": "BOOLEAN", "O": "OBJECT.*", "?": "VOID"}


def _types_ok(kind: Column, allowed: str) -> Column:
    return F.regexp_like(kind, F.lit("^(" + "|".join(_KINDS[c] for c in allowed) + ")$"))


def envelope_errors(text: Column) -> Column:
    """All contract errors of a JSON envelope, each with its path: missing, null or mistyped keys, unknown keys, values outside their lists.

    The text is parsed into a variant once, and what several checks read is bound once: nested in every check, the parse would run some 200 times a row."""
    found = lambda t, whole: let(_keys(t), lambda keys: F.array_compact(_errors(t, whole, keys)))
    return let(text, lambda t: let(F.try_parse_json(t), lambda whole: found(t, whole)))


def _keys(text: Column) -> Column:
    return F.coalesce(F.json_object_keys(text), F.array().cast("array<string>"))


def _errors(text: Column, whole: Column, keys: Column) -> Column:
    """The outcomes of all checks in order, null for each that passes. whole: the text as a variant; keys: those of its root."""
    at = lambda path: F.get_json_object(text, "$." + path)
    unknown = lambda present, allowed: F.size(F.array_except(present, F.array(*[F.lit(k) for k in allowed]))) > 0

    def typed(path):
        # Null where the key is absent, VOID where it holds a JSON null.
        error = lambda kind: F.when(~_types_ok(kind, TYPES[path]), F.when(kind == "VOID", f"{path}: null").otherwise(f"{path}: wrong type"))
        return let(F.schema_of_variant(F.try_variant_get(whole, "$." + path, "variant")), error)

    def nested(name, required, allowed):
        """Missing and unknown keys of one object, as a list."""
        missing = lambda sub: [F.when(sub.isNotNull() & ~F.array_contains(sub, k), f"{name}.{k}: required") for k in required]
        extra = lambda sub: F.when(unknown(F.coalesce(sub, F.array().cast("array<string>")), required + allowed), f"{name}: unexpected key")
        return let(F.json_object_keys(at(name)), lambda sub: F.array(*missing(sub), extra(sub)))

    is_object = F.coalesce(F.schema_of_variant(whole).startswith("OBJECT"), F.lit(False))
    errors = [F.when(~is_object, "$: not an object")]
    errors += [F.when(~F.array_contains(keys, k), f"{k}: required") for k in ROOT_REQUIRED]
    errors.append(F.when(unknown(keys, sorted(ROOT)), "$: unexpected key"))
    errors += [typed(k) for k in TYPES if "." not in k]
    errors.append(F.when(at("event_id") == "", "event_id: empty"))
    errors.append(F.when(at("event_type") == "", "event_type: empty"))
    errors.append(F.when(at("schema_version") != SCHEMA_VERSION, "schema_version: not 1.0"))
    errors.append(F.when(~at("domain").isin(*DOMAINS), "domain: not in enum"))
    errors.append(let(at("timestamp"), lambda t: F.when(t.isNotNull() & F.try_to_timestamp(t).isNull(), "timestamp: not a date-time")))
    parts = [F.array(*errors)]
    for name, (required, allowed) in NESTED.items():
        parts += [nested(name, required, allowed), F.array(*[typed(f"{name}.{k}") for k in required + allowed])]
    parts.append(F.array(F.when(~at("provenance.source_type").isin(*SOURCE_TYPES), "provenance.source_type: not in enum"),
                         F.when(~at("provenance.mapping_type").isin(*MAPPING_TYPES), "provenance.mapping_type: not in enum")))
    return F.concat(*parts)


def minimize(text: Column, denied: set[str] = frozenset(DENIED_KEYS)) -> Column:
    """JSON text without the denied keys at any depth; all else stays byte for byte, declared or not. Invalid JSON gives null."""
    return drop_keys(text, sorted(denied))


def project_evidence(text: Column, allowed: T.StructType, list_caps: dict[str, int] | None = None) -> Column:
    """JSON text cut to the allow-listed fields; named lists keep their first elements (a display contract)."""
    parsed = F.from_json(text, allowed)
    fields = [(F.slice(parsed[f.name], 1, list_caps[f.name]) if list_caps and f.name in list_caps else parsed[f.name]).alias(f.name) for f in allowed.fields]
    return F.to_json(F.struct(*fields))
