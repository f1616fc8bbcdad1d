"""Band joins, greedy matching, components, severity and scores against brute force."""

import hashlib
import itertools
import random
from datetime import date, datetime, timedelta, timezone

import numpy as np
import pytest
from pyspark.sql import functions as F

from watchfold.operators import bandjoin, bayes, graph, matching, pairs as P, severity as S

KINDS = ["ssh", "face", "ppe", "maintenance", "environment"]
STATE = {"ssh": "ANOMALY_CANDIDATE", "face": "UNKNOWN_PERSON", "ppe": "PPE_NON_COMPLIANT", "maintenance": "AT_RISK", "environment": "SMOKE_DETECTED"}
T0 = datetime(2024, 1, 1, tzinfo=timezone.utc)


def random_nodes(spark, n=200, zones=2, span=20_000, seed=0, hot=False):
    rng = np.random.default_rng(seed)
    rows = []
    for i in range(n):
        kind = KINDS[rng.integers(0, 5)]
        zone = "Z0" if hot else f"Z{rng.integers(0, zones)}"
        base = int(rng.integers(0, 300 if hot else span))
        times = [T0 + timedelta(seconds=base + 1000 * j) for j in range(int(rng.integers(1, 3)))]
        rows.append((kind, f"{i:04d}", zone, f"S{i % 7}" if i % 3 else None, STATE[kind], times))
    return rows, spark.createDataFrame(rows, "kind string, id string, zone_id string, server_id string, state string, times array<timestamp>")


def brute_pairs(rows):
    out = {}
    for a, b in itertools.combinations(sorted(rows), 2):
        if a[0] == b[0] or a[2] != b[2] or tuple(sorted((a[0], b[0]))) in P.SPECIALIZED:
            continue
        d = min(abs((x - y).total_seconds()) for x in a[5] for y in b[5])
        if d <= 900:
            out[(a[0], a[1], b[0], b[1])] = (d, "SERVER" if a[3] and a[3] == b[3] else "ZONE", a[2])
    return out


def test_generic_pairs(spark):
    rows, df = random_nodes(spark)
    want = brute_pairs(rows)
    got = {(r.left_kind, r.left_id, r.right_kind, r.right_id): (r.time_difference_seconds, r.scope, r.zone_id, r.source_id) for r in P.generic_pairs(df).collect()}
    assert {k: v[:3] for k, v in got.items()} == want and want
    k, v = next(iter(got.items()))
    text = f"{v[2]}|{k[0]}:{k[1]}|{k[2]}:{k[3]}"
    assert v[3] == "PAIR-" + hashlib.sha256(text.encode()).hexdigest()[:20].upper()


def test_window_is_inclusive(spark):
    mk = lambda k, i, s: (k, i, "Z", None, STATE[k], [T0 + timedelta(seconds=s)])
    df = spark.createDataFrame([mk("ssh", "a", 0), mk("ppe", "b", 900), mk("maintenance", "c", 901)], "kind string, id string, zone_id string, server_id string, state string, times array<timestamp>")
    assert {(r.left_id, r.right_id) for r in P.generic_pairs(df).collect()} == {("b", "a"), ("c", "b")}


def test_salted_cells_give_the_same_pairs(spark):
    rows, df = random_nodes(spark, 150, hot=True)
    one = P.instants(df.select("zone_id", "kind", "id", "times"))
    l, r = bandjoin.side(one, "left", ["zone_id"]), bandjoin.side(one, "right", ["zone_id"])
    plain = bandjoin.band_join(l, r, ["zone_id"], "left_us", "right_us", P.WINDOW_US).collect()
    salted = bandjoin.band_join(l, r, ["zone_id"], "left_us", "right_us", P.WINDOW_US, max_cell_rows=7).collect()
    key = lambda x: (x.left_id, x.left_us, x.right_id, x.right_us)
    assert sorted(map(key, plain)) == sorted(map(key, salted)) and len(plain) > 1000


def union_find(edges):
    parent = {}
    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x
    for a, b in edges:
        ra, rb = find(a), find(b)
        parent[max(ra, rb)] = min(ra, rb)
    return {x: find(x) for x in parent}


@pytest.mark.parametrize("hot", [False, True])
def test_spanning_links_have_the_components_of_all_pairs(spark, hot):
    rows, df = random_nodes(spark, 160, seed=5, hot=hot)
    full = union_find([(f"{v[2]}|{k[0]}:{k[1]}", f"{v[2]}|{k[2]}:{k[3]}") for k, v in brute_pairs(rows).items()])
    links = P.spanning_links(df)
    assert links.groupBy("left_kind", "left_id").count().agg(F.max("count")).first()[0] <= 30
    got = {f"{r.zone_id}|{r.kind}:{r.id}": f"{r.component.zone_id}|{r.component.kind}:{r.component.id}" for r in graph.group_members(links).collect()}
    assert got == full


@pytest.mark.parametrize("edges", [
    [(f"n{i:03d}", f"n{i + 1:03d}") for i in range(60)], [("hub", f"x{i}") for i in range(40)], [("a", "b"), ("c", "d"), ("d", "e"), ("b", "a")],
])
def test_components_of_chain_star_and_islands(spark, edges):
    got = {r.node: r.component for r in graph.connected_components(spark.createDataFrame(edges, "src string, dst string")).collect()}
    assert got == union_find(edges)


def test_group_ids_do_not_depend_on_order_and_need_three_members(spark):
    e = [("Z1", "ssh", "1", "ppe", "2"), ("Z1", "ppe", "2", "maintenance", "3"), ("Z2", "ssh", "1", "ppe", "2"), ("Z3", "ssh", "9", "ppe", "8")]
    df = spark.createDataFrame(e, "zone_id string, left_kind string, left_id string, right_kind string, right_id string")
    g = graph.with_group_ids(graph.group_members(df)).collect()
    h = [int(hashlib.sha256(f'["{kind}","{i}"]'.encode()).hexdigest()[:15], 16) for kind, i in [("ssh", 1), ("ppe", 2), ("maintenance", 3)]]
    want = "GROUP-" + hashlib.sha256(f"Z1|3|{sum(h)}|{h[0] ^ h[1] ^ h[2]}".encode()).hexdigest()[:20].upper()
    assert {r.group_id for r in g} == {want} and len(g) == 3
    again = graph.with_group_ids(graph.group_members(df.orderBy(F.desc("left_id")).repartition(3))).collect()
    assert {r.group_id for r in again} == {want}


def test_groups_keep_any_character(spark):
    odd = [("Z|1", "s:h", "a|b"), ("Z|1", "p|e", "line\nfeed"), ("Z|1", "m", "x:y"), ("Z", "1|s:h", "a|b"), ("Z", "k", "v")]
    e = [(odd[0], odd[1]), (odd[1], odd[2]), (odd[3], odd[4])]
    df = spark.createDataFrame([(a[0], a[1], a[2], b[1], b[2]) for a, b in e], "zone_id string, left_kind string, left_id string, right_kind string, right_id string")
    got = {(r.zone_id, r.kind, r.id): r.component for r in graph.group_members(df).collect()}
    assert set(got) == set(odd) and len({tuple(c) for c in got.values()}) == 2
    assert {(r.zone_id, r.kind, r.id) for r in graph.with_group_ids(graph.group_members(df)).collect()} == set(odd[:3])


def test_more_than_a_hundred_face_log_candidates(spark):
    from datetime import datetime, timedelta

    at = datetime(2024, 1, 1)
    faces = spark.createDataFrame([(f"Z{k % 3}", f"f{k}", at + timedelta(seconds=k)) for k in range(45)], "zone_id string, id string, ts timestamp")
    logs = spark.createDataFrame([(f"Z{k % 3}", f"l{k}", "FAILED", at, None, False) for k in range(30)],
                                 "zone_id string, id string, state string, log_ts timestamp, declared_ts timestamp, timestamp_uncertain boolean")
    assert P.face_ssh_candidates(faces, logs).count() == 3 * 15 * 10


def sequential(rows):
    used, out = set(), set()
    for l, r, d in sorted(rows, key=lambda x: (x[2], x[0], x[1])):
        if ("l", l) not in used and ("r", r) not in used:
            used |= {("l", l), ("r", r)}
            out.add((l, r))
    return out


@pytest.mark.parametrize("seed", [0, 1])
def test_greedy_matching_equals_the_sequential_scan(spark, seed):
    rng = np.random.default_rng(seed)
    rows = list({(f"m{rng.integers(0, 25)}", f"e{rng.integers(0, 25)}"): 0 for _ in range(120)})
    rows = [(l, r, float(rng.integers(0, 12))) for l, r in rows]
    got = {(r.l, r.r) for r in matching.greedy_one_to_one(spark.createDataFrame(rows, "l string, r string, d double"), "l", "r", ["d"]).collect()}
    assert got == sequential(rows)


def test_greedy_matching_of_a_long_chain_and_of_nothing(spark):
    chain = []
    for i in range(6):
        chain += [(f"m{i}", f"e{i}", 20.0 - 2 * i), (f"m{i + 1}", f"e{i}", 19.0 - 2 * i)]
    df = spark.createDataFrame(chain, "l string, r string, d double")
    assert {(r.l, r.r) for r in matching.greedy_one_to_one(df, "l", "r", ["d"]).collect()} == sequential(chain)
    assert matching.greedy_one_to_one(df.where("d < 0"), "l", "r", ["d"]).count() == 0


def test_long_chain_takes_few_jobs(spark):
    chain = []
    for i in range(500):
        chain += [(f"m{i:04d}", f"e{i:04d}", 2.0 * i), (f"m{i + 1:04d}", f"e{i:04d}", 2.0 * i + 1)]
    chain += [(f"x{i % 7}", f"y{i % 11}", float(i * 37 % 101)) for i in range(77)]
    df = spark.createDataFrame(chain, "l string, r string, d double")
    tracker = spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup("chain", "chain")
    try:
        got = {(r.l, r.r) for r in matching.greedy_one_to_one(df, "l", "r", ["d"]).collect()}
        jobs = len(tracker.getJobIdsForGroup("chain"))
    finally:
        spark.sparkContext.setJobGroup("", "")
    assert got == sequential(chain) and jobs < 150


def test_uncertain_or_old_log_times_are_not_used(spark):
    f = spark.createDataFrame([("Z", "f1", T0)], "zone_id string, id string, ts timestamp")
    old = datetime(2000, 1, 1, tzinfo=timezone.utc)
    rows = [("Z", "ok", "X", T0, None, False), ("Z", "unsure", "X", T0, None, True), ("Z", "old", "X", old, None, False), ("Z", "declared", "X", old, T0, True), ("Z", "quiet", "NO_ANOMALY_EVIDENCE", T0, None, False)]
    l = spark.createDataFrame(rows, "zone_id string, id string, state string, log_ts timestamp, declared_ts timestamp, timestamp_uncertain boolean")
    assert sorted(r.right_id for r in P.face_ssh_candidates(f, l).collect()) == ["declared", "ok"]


def test_near_duplicates_match_brute_force(spark):
    rng = np.random.default_rng(8)
    base = [int(x) for x in rng.integers(-2 ** 62, 2 ** 62, 40)]
    flip = lambda h, n: int(np.bitwise_xor(np.int64(h), np.int64(sum(1 << int(b) for b in rng.choice(62, n, replace=False)))))
    left = [(i, flip(h, int(rng.integers(0, 12)))) for i, h in enumerate(base)]
    right = [(100 + i, h) for i, h in enumerate(base)]
    mk = lambda rows: spark.createDataFrame(rows, "id long, phash long")
    got = {r.id: r.distance for r in P.near_duplicates(mk(left), mk(right)).collect()}
    ham = lambda a, b: bin((a ^ b) & (2 ** 64 - 1)).count("1")
    want = {i: min(ham(h, g) for _, g in right) for i, h in left}
    assert got == {i: d for i, d in want.items() if d <= 6} and got


def test_finer_hash_blocks_give_far_fewer_candidates_and_lose_none(spark):
    rng = np.random.default_rng(4)
    base = [int(x) for x in rng.integers(-2 ** 63, 2 ** 63 - 1, 3000)]
    # differing bits spread over as many blocks as they can reach, and the sign bit among them
    spread = [h ^ sum(1 << b for b in (0, 7, 14, 21, 28, 35)) for h in base[:20]] + [int(np.int64(h) ^ np.int64(-2 ** 63)) for h in base[20:40]]
    mk = lambda rows: spark.createDataFrame(list(enumerate(rows)) + [(10 ** 6, None)], "id long, phash long")
    left, right = mk(spread + [int(x) for x in rng.integers(-2 ** 63, 2 ** 63 - 1, 3000)]), mk(base)
    n = {b: P.hash_candidates(left, right, 6, "phash", b).select("left_hash", "right_hash").distinct().count() for b in (8, 10)}
    assert n[10] >= 40 and (n[10] - 40) * 20 < n[8] - 40
    found = {b: sorted(P.near_duplicates(left, right, 6, "phash", b).collect()) for b in (8, 10)}
    assert found[8] == found[10] and {r.id: (r.distance, r.nearest_id) for r in found[10]} == {k: (6 if k < 20 else 1, k) for k in range(40)}
    assert P.near_duplicates(left.limit(0), right).count() == 0


def test_posterior_by_hand_and_with_a_missing_factor(spark):
    df = spark.createDataFrame([("LE_5_MIN", "SAME_ZONE", "KNOWN", "BOTH_STRONG"), ("GT_60_MIN", "UNRELATED", "UNLIKELY", None)], "TimeGap string, Topology string, DomainMechanism string, EvidenceStrength string")
    a, b = [r.p for r in df.select(bayes.posterior().alias("p")).collect()]
    yes, no = 0.2 * .45 * .40 * .65 * .55, 0.8 * .04 * .25 * .30 * .20
    assert abs(a - yes / (yes + no)) < 1e-12
    yes, no = 0.2 * .05 * .05 * .07, 0.8 * .50 * .50 * .30
    assert abs(b - yes / (yes + no)) < 1e-12
    for rows in bayes.TABLES.values():
        assert abs(sum(r[1] for r in rows) - 1) < 1e-9 and abs(sum(r[2] for r in rows) - 1) < 1e-9


def test_group_severity_rises_one_level_on_linkage_only(spark):
    def group(gid, *members):
        return [(gid, d, s, a, srv, None, minute * 60_000_000) for d, s, a, srv, minute in members]
    rows = (group("linked", ("MAINTENANCE", "AT_RISK", None, None, 0), ("ENVIRONMENTAL", "SMOKE_DETECTED", None, None, 10))
            + group("slow", ("MAINTENANCE", "AT_RISK", None, None, 0), ("ENVIRONMENTAL", "SMOKE_DETECTED", None, None, 11))
            + group("top", ("CYBERSECURITY", "ANOMALOUS", None, "s", 0), ("PHYSICAL_SECURITY", "RECOGNIZED", "UNAUTHORIZED", None, 1))
            + group("calm", ("SAFETY", "COMPLIANT", None, None, 0)))
    df = spark.createDataFrame(rows, "group_id string, domain string, state string, authorization string, server_id string, rack_id string, us long")
    got = {r.group_id: (r.base_severity, r.severity, r.escalated) for r in S.decide_groups(df).collect()}
    assert got == {"linked": ("LOW", "MEDIUM", True), "slow": ("LOW", "LOW", False), "top": ("MEDIUM", "HIGH", True)}


def test_latest_verdict_wins(spark):
    t = lambda h: T0 + timedelta(hours=h)
    v = spark.createDataFrame([("ssh", "1", t(0), "OVERRIDDEN", "NO_ANOMALY_EVIDENCE"), ("ssh", "1", t(1), "CONFIRMED", None), ("ppe", "2", t(0), "INCONCLUSIVE", None), ("ppe", "2", t(2), "OVERRIDDEN", "COMPLIANT")],
                              "kind string, evidence_id string, recorded_at timestamp, verdict string, corrected_status string")
    got = {r.id: (r.verdict, r.human_abnormal) for r in S.latest_verdicts(v).collect()}
    assert got == {"1": ("CONFIRMED", None), "2": ("OVERRIDDEN", False)}


def test_tightest_times(spark):
    t = lambda m: T0 + timedelta(minutes=m)
    m = spark.createDataFrame([("g", "a", "1", [t(0), t(50)]), ("g", "b", "2", [t(52)]), ("g", "c", "3", [t(10), t(49)])], "group_id string, kind string, id string, times array<timestamp>")
    got = {r.id: (r.chosen_us - int(t(0).timestamp() * 1e6)) // 60_000_000 for r in S.tightest_times(m).collect()}
    assert got == {"1": 50, "2": 52, "3": 49}


def brute_tightest(rows):
    groups = {}
    for g, _, i, times in rows:
        groups.setdefault(g, []).append((i, sorted(set(times))))
    out = {}
    for g, members in groups.items():
        answer = lambda a: {i: min(times, key=lambda t: (abs(t - a), t)) for i, times in members}
        spread = lambda a: max(answer(a).values()) - min(answer(a).values())
        anchor = min({t for _, times in members for t in times}, key=lambda a: (spread(a), a))
        out |= {(g, i): (t, spread(anchor)) for i, t in answer(anchor).items()}
    return out


def test_tightest_times_against_every_anchor(spark):
    rnd = random.Random(8)
    rows = [(f"g{g}", "k", f"{i}", [rnd.randint(0, 60) for _ in range(rnd.randint(1, 5))]) for g in range(25) for i in range(rnd.randint(1, 9))]
    rows += [("big", "k", f"{i}", [rnd.randint(0, 10_000) for _ in range(rnd.randint(1, 4))]) for i in range(120)]
    m = spark.createDataFrame(rows, "group_id string, kind string, id string, m array<int>")
    m = m.select("group_id", "kind", "id", F.transform("m", lambda x: F.timestamp_seconds(x)).alias("times"))
    got = {(r.group_id, r.id): (r.chosen_us // 1_000_000, r.spread_seconds) for r in S.tightest_times(m).collect()}
    assert got == brute_tightest(rows)


def test_tightest_times_grow_with_times_not_with_their_square(spark):
    members = spark.range(20_000).select(F.lit("g").alias("group_id"), F.lit("k").alias("kind"), F.col("id").cast("string").alias("id"),
                                         F.array(F.timestamp_seconds(F.col("id") * 7), F.timestamp_seconds(F.col("id") * 7 + 100_000)).alias("times"))
    found = S.tightest_times(members).agg(F.count(F.lit(1)), F.min("spread_seconds"), F.max("spread_seconds")).first()
    # 20,000 members times 40,000 anchors would be 8e8 rows
    assert found[0] == 20_000 and found[1] == found[2] <= 100_000


def test_period_bounds_and_places_by_score(spark):
    from watchfold.operators import assess, drives as D

    day = date.fromisoformat
    rows = [("p1", day("2020-01-01"), "NORMAL", 0, None), ("p1", day("2020-03-31"), "AT_RISK", 1, 7), ("p2", day("2020-04-01"), "CENSORED", 1, None), ("p2", day("2020-07-01"), "AT_RISK", 1, 8),
            ("p2", day("2020-06-30"), "NORMAL", None, None), ("p9", day("1999-01-01"), "NORMAL", 0, None)]
    labelled = spark.createDataFrame(rows, "period string, date date, label_state string, target int, days_until_failure int")
    bounds = spark.createDataFrame([("p1", day("2020-01-01"), day("2020-03-31")), ("p2", day("2020-04-01"), day("2020-06-30")), ("p3", day("2020-07-01"), day("2020-09-30"))], "period string, start_date date, end_date date")
    got = {r.period: r for r in D.period_integrity(labelled, bounds, 7).collect()}
    assert {p: r.status for p, r in got.items()} == {"p1": "PASS", "p2": "FAIL", "p3": "FAIL"} and got["p3"].rows == 0 and got["p3"].first_date is None
    assert (got["p2"].rows_out_of_bounds, got["p2"].unlabelled_with_target, got["p2"].positive_outside_horizon, got["p2"].normal_with_other_target) == (1, 1, 1, 1)
    scores = [("a", 3.0), ("a", 5.0), ("a", 5.0), ("a", 1.0), ("b", 2.0), ("b", None), (None, 4.0)]
    placed = assess.placed_by_score(spark.createDataFrame(scores, "g string, s double"), "g", "s")
    assert sorted(((r.g, r.s, r.place) for r in placed.collect()), key=str) == sorted(
        [("a", 3.0, 3), ("a", 5.0, 1), ("a", 5.0, 1), ("a", 1.0, 4), ("b", 2.0, 1), ("b", None, None), (None, 4.0, None)], key=str)
    assert assess.placed_by_score(spark.createDataFrame([], "g string, s double"), "g", "s").count() == 0
