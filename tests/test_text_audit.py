"""Text cleaning and chunking, masking, audit chains, stores and ingestion."""

import hashlib
import hmac
import json
import random
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from watchfold.functions import ids, jsontext
from watchfold.operators import audit as A, envelope as E, text as X, vectors as V
from watchfold.sources import topology as G, upsert as U
from watchfold.streaming import ingest


def test_canonical_json_matches_python(spark):
    values = ["plain", 'q"\\', "a\nb\tc\r", "é ü ñ", "emoji 😀 end", "\x01\x7f", "", None, "  "]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "n int, s string")
    got = [r.j for r in df.orderBy("n").select(jsontext.canonical({"z": F.col("s"), "a": F.col("n")}, {"a"}).alias("j")).collect()]
    assert got == [json.dumps({"z": v, "a": i}, sort_keys=True, separators=(",", ":")) for i, v in enumerate(values)]


@pytest.mark.parametrize("key", [b"k", b"x" * 100])
def test_hmac_and_pseudonyms(spark, key):
    df = spark.createDataFrame([("ann",), ("é",), ("UNKNOWN",)], "v string")
    got = df.select(ids.hmac_sha256(key, F.col("v")).alias("h"), ids.pseudonym(key, "USER", F.col("v")).alias("p")).collect()
    assert [r.h for r in got[:2]] == [hmac.new(key, v.encode(), hashlib.sha256).hexdigest() for v in ("ann", "é")]
    assert got[0].p == "USER-" + hmac.new(key, b"USER:ann", hashlib.sha256).hexdigest()[:10].upper() and got[2].p == "UNKNOWN"


def test_masking_is_reversible_and_longest_first(spark):
    t = "from 11.2.3.4 and 1.2.3.4 by P1234, not 1.2.3"
    df = spark.createDataFrame([(t,)], "text string")
    masked = df.select(ids.mask_text(b"k", F.col("text")).alias("m")).first().m
    assert "1.2.3.4" not in masked and "P1234" not in masked and masked.endswith("not 1.2.3")
    for r in ids.token_table(b"k", df, "text").collect():
        masked = masked.replace(r.token, r.original)
    assert masked == t


def test_repeated_lines_need_a_fifth_of_the_records(spark):
    rows = [("d", i, f"Site  manual v1\nbody line number {i}\r\nshort") for i in range(10)] + [("d", 10, "Rare header here"), ("d", 11, "Rare header here"), ("small", 1, "Site manual v1"), ("small", 2, "Site manual v1")]
    df = spark.createDataFrame(rows, "document_id string, record_id long, text string")
    rep = X.repeated_lines(df)
    assert [(r.document_id, r.line) for r in rep.collect()] == [("d", "Site manual v1")]
    got = {r.record_id: (r.text, r.removed_lines) for r in X.remove_repeated_lines(df, rep).where("document_id = 'd'").collect()}
    assert got[3] == ("body line number 3\nshort", 1) and got[10] == ("Rare header here", 0)


def test_cleaning_expressions(spark):
    df = spark.createDataFrame([("well-\n known a-b 12-\n3 â€™x\x00y  z \n\n\n\n end",)], "t string")
    r = df.select(X.hyphen_breaks(F.col("t")).alias("n"), X.dehyphenate(F.col("t")).alias("d"), X.repair_mojibake(F.col("t")).alias("m"), X.mojibake_count(F.col("t")).alias("c"), X.normalize_whitespace(F.col("t")).alias("w")).first()
    assert r.n == 1 and r.d.startswith("wellknown a-b 12-\n3") and r.c == 1 and "'x" in r.m
    assert r.w == "well-\nknown a-b 12-\n3 â€™x y z\n\nend"


def test_section_trim_and_controls(spark):
    pages = [("d", 1, "intro"), ("d", 2, "tail § 1910.134 Old text"), ("d", 3, "see § 1910.134 and more § 1910.135 Head protection. A"), ("d", 4, "B § 1910.135\n"), ("d", 5, "C § 1910.136 Foot wear"), ("d", 6, "D"), ("e", 1, "no headings")]
    df = spark.createDataFrame(pages, "document_id string, page int, text string")
    got = {(r.document_id, r.page): r.text for r in X.trim_to_section(df, "135").collect()}
    assert got == {("d", 3): "§ 1910.135 Head protection. A", ("d", 4): "B § 1910.135\n", ("d", 5): "C ", ("e", 1): "no headings"}
    ctl = spark.createDataFrame([("n", 1, "x\nPE-2 ACCESS a\n"), ("n", 2, "b\n  PE-3 CONTROL c\n"), ("n", 3, "d\nPE-6 MONITOR e")], "document_id string, page int, text string")
    out = {r.page: r.text.strip() for r in X.trim_to_section(ctl, "3", X.CONTROL_HEADING, stop_at_any=True).collect()}
    assert out == {2: "PE-3 CONTROL c", 3: "d"}


def brute_chunks(doc, units, target, maximum, overlap, minimum):
    """Straight re-reading of the chunk rules, for small inputs."""
    n = lambda t: len(t.split())
    chunks, cur = [], []
    def emit():
        nonlocal cur
        body = "\n\n".join(cur)
        chunks.append([f"{doc}:chunk:{len(chunks):05d}:{hashlib.sha256((doc + chr(10) + body).encode()).hexdigest()[:16]}", body])
        keep, w = [], 0
        for t in cur[::-1]:
            if n(t) > overlap or (keep and w + n(t) > overlap) or w >= overlap:
                break
            keep, w = [t] + keep, w + n(t)
        cur = keep
    for t in units:
        if cur and sum(map(n, cur)) + n(t) > target:
            emit()
        cur = cur + [t]
        if sum(map(n, cur)) >= maximum:
            emit()
    if cur:
        emit()
    if len(chunks) > 1 and n(chunks[-1][1]) < minimum and n(chunks[-2][1]) + n(chunks[-1][1]) <= maximum:
        chunks[-2][1] += "\n\n" + chunks.pop()[1]
    return [tuple(c) for c in chunks]


@pytest.mark.parametrize("seed", range(4))
def test_chunks_equal_the_sequential_fold(spark, seed):
    rng = random.Random(seed)
    docs = {f"doc{d}": [[" ".join(f"w{rng.randrange(99)}" for _ in range(rng.choice([1, 3, 8, 25, 60]))) for _ in range(rng.randrange(1, 9))] for _ in range(rng.randrange(1, 4))] for d in range(5)}
    rows = [(d, i, f"{d}-r{i}", i + 1, "\n\n".join(paras)) for d, recs in docs.items() for i, paras in enumerate(recs)]
    df = spark.createDataFrame(rows, "document_id string, record_order int, record_id string, page int, text string")
    limits = dict(target=40, maximum=50, overlap=10, minimum=12)
    got = X.chunk(df.repartition(3), **limits).orderBy("document_id", "chunk_index").collect()
    for d, recs in docs.items():
        units = [" ".join(p.split()[i:i + 50]) for r in recs for p in r for i in range(0, len(p.split()), 50)]
        assert [(c.chunk_id, c.text) for c in got if c.document_id == d] == brute_chunks(d, units, **limits)
    assert all(c.word_count == len(c.text.split()) and c.pages == sorted(c.pages) for c in got)


def test_retrieval_policies_match_a_full_ranking(spark):
    rng = np.random.default_rng(1)
    items = [(i, int(d), 1, [float(x) for x in rng.normal(size=6)]) for i, d in enumerate(rng.choice([0, 0, 0, 1, 2], 60))]
    queries = [(q, 1 if q else 2, [float(x) for x in rng.normal(size=6)]) for q in range(4)]
    g = spark.createDataFrame(items, "item_id long, document_id int, mask long, vec array<double>")
    qd = spark.createDataFrame(queries, "query_id long, mask long, vec array<double>")
    unit = lambda v: np.array(v) / np.linalg.norm(v)
    for ranking, cap in (("raw", None), ("diverse", 1), ("controlled", 2)):
        got = {}
        for r in V.retrieve(qd, g, 5, ranking, block_rows=13).collect():
            got.setdefault(r.query_id, {})[r.rank] = r.item_id
        assert 0 not in got  # no shared domain bit
        for q, _, vec in queries[1:]:
            order = sorted(items, key=lambda it: -float(unit(it[3]) @ unit(vec)))
            seen, first, later = {}, [], []
            for it in order:
                seen[it[1]] = seen.get(it[1], 0) + 1
                (first if cap is None or seen[it[1]] <= cap else later).append(it[0])
            assert [got[q][k] for k in range(1, 6)] == (first + later)[:5]


def chain(spark):
    rows = [(c, i, f"é {c} {i}", None if i == 2 else "x") for c in (1, 2) for i in range(5)]
    return A.seal(spark.createDataFrame(rows, "chain long, position long, text string, note string"), "chain", "position", ["chain", "position", "text", "note"])


def test_chain_verification_finds_edits_and_gaps(spark):
    s = spark.createDataFrame(chain(spark).collect(), "chain long, position long, text string, note string, previous_hash string, entry_hash string")
    check = lambda df: {r.chain: (r.status, r.failed_position, r.reason) for r in A.verify(df, "chain", "position", ["chain", "position", "text", "note"], {"chain", "position"}).collect()}
    assert check(s) == {1: ("PASS", None, None), 2: ("PASS", None, None)}
    edited = s.withColumn("text", F.when((F.col("chain") == 1) & (F.col("position") == 3), "!").otherwise(F.col("text")))
    assert check(edited)[1] == ("FAILED", 3, "ENTRY_HASH_MISMATCH")
    assert check(s.where("NOT (chain = 2 AND position = 1)"))[2] == ("FAILED", 2, "PREVIOUS_HASH_MISMATCH")
    cut = s.where("NOT (chain = 2 AND position = 4)")
    assert check(cut)[2][0] == "PASS"  # a lost tail needs the checkpoint
    saved = A.snapshot(s, "chain", "position")
    assert {r.chain: r.status for r in A.verify_checkpoint(cut, saved, "chain", "position").collect()} == {1: "PASS", 2: "RECORDS_MISSING"}


def test_envelope_errors_name_their_paths(spark):
    good = {"event_id": "1", "schema_version": "1.0", "timestamp": "2024-01-01T00:00:00Z", "window": None, "domain": "SAFETY", "event_type": "x", "source": {"component": "c", "component_version": "1"}, "entities": {},
            "location": {}, "assessment": {"state": "s", "confidence": 0.5}, "evidence": {"any": 1}, "provenance": {"source_type": "LIVE", "synthetic_mapping": False, "mapping_type": None, "original_timestamp": None, "scenario_id": None}}
    bad = json.loads(json.dumps(good))
    del bad["domain"], bad["assessment"]["confidence"]
    bad["pet"], bad["window"] = 1, {"start": "x"}
    df = spark.createDataFrame([(json.dumps(good),), (json.dumps(bad),), ("[]",)], "t string")
    got = [list(r.e) for r in df.select(E.envelope_errors(F.col("t")).alias("e")).collect()]
    assert got[0] == [] and got[1] == ["domain: required", "$: unexpected key", "window.end: required", "assessment.confidence: required"] and got[2][0] == "$: not an object"


def test_topology_tree(spark, tmp_path):
    tree = {"data_center": {"data_center_id": "DC", "zones": [{"zone_id": "A", "criticality": "HIGH", "cameras": [{"camera_id": "C1", "monitors": ["A", "D"]}], "racks": [{"rack_id": "R", "servers": [{"server_id": "S1", "criticality": "LOW"}]}]}, {"zone_id": "B", "equipment": [{"equipment_id": "E1"}]}]},
            "people": [{"person_id": "P1", "role": "x", "authorized_zones": ["A"]}]}
    (tmp_path / "t.json").write_text(json.dumps(tree, indent=1))
    d = G.flatten_tree(G.read_tree(spark, str(tmp_path / "t.json")))
    assert {(r.src, r.rel, r.dst) for r in d["edges"].collect()} == {("A", "PART_OF", "DC"), ("B", "PART_OF", "DC"), ("R", "LOCATED_IN", "A"), ("S1", "LOCATED_IN", "R"), ("E1", "LOCATED_IN", "B"), ("C1", "MONITORS", "A"), ("C1", "MONITORS", "D"), ("P1", "AUTHORIZED_FOR", "A")}


def test_upsert_replay_and_first_write_columns(spark, tmp_path):
    path = str(tmp_path / "store")
    batch = lambda rows: spark.createDataFrame(rows, "id long, v string, created_at int, version int")
    for rows in ([(1, "a", 10, 1), (2, "b", 10, 1)], [(1, "c", 20, 2), (3, "d", 20, 2)], [(1, "c", 30, 2)]):
        U.upsert_parquet(spark, path, batch(rows), ["id"], F.col("version"), ["created_at"])
    assert {(r.id, r.v, r.created_at) for r in spark.read.parquet(path).collect()} == {(1, "c", 10), (2, "b", 10), (3, "d", 20)}


def test_file_ledger(spark, tmp_path):
    box, ledger = tmp_path / "in", str(tmp_path / "ledger")
    box.mkdir()
    (box / "a.csv").write_text("1"), (box / "b.csv").write_text("bad"), (box / "big.csv").write_text("x" * 50), (box / "note.txt").write_text("no")
    handle = lambda f: f.select("path", "content_sha256", F.when(F.col("content").cast("string") != "bad", "COMPLETE").otherwise("FAILED").alias("status"))
    scan = lambda: sorted((r.path[-7:], r.status) for r in ingest.scan_once(spark, str(box), "*.csv", "k", ledger, handle, 10, 0).collect())
    time.sleep(1.1)
    assert scan() == [("big.csv", "TOO_LARGE"), ("n/a.csv", "COMPLETE"), ("n/b.csv", "FAILED")]
    assert len(scan()) == 4  # only the failed file is tried again
    (box / "b.csv").write_text("now")
    time.sleep(1.1)
    assert ("n/b.csv", "COMPLETE") in scan() and len(scan()) == 5


def test_envelope_nulls_and_types_are_errors(spark):
    bad = {"event_id": None, "schema_version": None, "timestamp": None, "window": 3, "domain": None, "event_type": None, "source": 5, "entities": {"server_id": 7}, "location": [], "assessment": None, "evidence": {},
           "provenance": {"source_type": None, "synthetic_mapping": "x", "mapping_type": None, "original_timestamp": None, "scenario_id": None}}
    row = spark.createDataFrame([(json.dumps(bad),)], "t string").select(E.envelope_errors(F.col("t")).alias("e")).first()
    assert set(row.e) == {"event_id: null", "schema_version: null", "timestamp: null", "window: wrong type", "domain: null", "event_type: null", "source: wrong type", "entities.server_id: wrong type",
                          "location: wrong type", "assessment: null", "provenance.source_type: null", "provenance.synthetic_mapping: wrong type"}


def test_minimize_keeps_undeclared_keys_at_any_depth(spark):
    texts = ['{"a":1,"keep_me":2,"token":"x","deep":[{"token":1,"other":{"kept":[1.5,null,"é"]}}]}', "[]", "broken", None]
    rows = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "k int, t string").select("k", E.minimize(F.col("t")).alias("m")).orderBy("k").collect()
    assert [r.m for r in rows] == ['{"a":1,"keep_me":2,"deep":[{"other":{"kept":[1.5,null,"é"]}}]}', "[]", None, None]


def clustered(rnd, n, centres, noise):
    return [(centres[k % len(centres)] + rnd.normal(size=centres.shape[1]) * noise).tolist() for k in range(n)]


@pytest.mark.parametrize("cap, keep", [(None, 3), (1, 4), (2, 5), (2, 40)])
def test_pruned_search_finds_what_all_pairs_find(spark, cap, keep):
    rnd = np.random.default_rng(12)
    centres = rnd.normal(size=(9, 12))
    vectors = clustered(rnd, 300, centres, 0.2) + [[0.0] * 12, centres[0].tolist(), centres[0].tolist()]
    gallery = [(i, i % 17, 1 << i % 2, v) for i, v in enumerate(vectors)]
    queries = [(1000 + i, 1 + i % 3, v) for i, v in enumerate(clustered(rnd, 30, centres, 0.4) + [[0.0] * 12, rnd.normal(size=12).tolist()])]
    g = spark.createDataFrame(gallery, "item_id long, document_id long, mask long, vec array<double>")
    q = spark.createDataFrame(queries, "query_id long, mask long, vec array<double>")
    ranking = {None: "raw", 1: "diverse", 2: "controlled"}[cap]
    key = lambda rows: [(r.query_id, r.rank, r.item_id, round(r.score, 9)) for r in rows.orderBy("query_id", "rank").collect()]
    assert key(V.retrieve(q, g, keep, ranking, block_rows=20)) == key(V.retrieve(q, g, keep, ranking, block_rows=10_000))


def test_pruned_search_scores_few_pairs_of_clustered_vectors(spark, monkeypatch):
    rnd = np.random.default_rng(3)
    centres = rnd.normal(size=(40, 16))
    g = spark.createDataFrame([(i, i, v) for i, v in enumerate(clustered(rnd, 4000, centres, 0.05))], "item_id long, document_id long, vec array<double>")
    q = spark.createDataFrame([(i, v) for i, v in enumerate(clustered(rnd, 200, centres, 0.05))], "query_id long, vec array<double>")
    met = []
    original = V._scored

    def counted(queries, gallery, *rest):
        sizes = gallery.groupBy("cell", "part").count()
        met.append(queries.join(sizes, ["cell", "part"]).agg(F.sum("count")).first()[0] or 0)
        return original(queries, gallery, *rest)

    monkeypatch.setattr(V, "_scored", counted)
    assert V.nearest_enrolled(q, g, 0.3, block_rows=50).count() == 200
    assert sum(met) < 0.1 * 4000 * 200
