"""Drive labels, ordered-series windows, exact ranks and sampling against brute force."""

from datetime import date, timedelta

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from watchfold.operators import drives as D, metrics as M, ranks


def days(spark, n=60, drives=3, seed=1):
    rng = np.random.default_rng(seed)
    rows = []
    for s in range(drives):
        d = date(2024, 1, 1)
        for i in range(n):
            d += timedelta(days=int(rng.integers(1, 3)))
            rows.append((s, d, float(np.round(rng.normal(40, 5), 2)) if rng.random() > 0.1 else None))
    return rows, spark.createDataFrame(rows, "serial_number long, date date, value double")


def test_label_precedence(spark):
    obs = [("a", date(2024, 1, d), "m", int(d in (10, 12))) for d in range(1, 15)] + [("b", date(2024, 1, d), "m", 0) for d in (1, 20, 24, 25)] + [("c", date(2024, 1, 28), "m", 0), ("c", date(2024, 1, 30), "m", 1)]
    df = spark.createDataFrame(obs, "serial_number string, date date, model string, failure int")
    got = {(r.serial_number, r.date.day): (r.label_state, r.target) for r in D.label_drive_days(df, D.failure_registry(df), "2024-01-31").collect()}
    assert got[("a", 2)] == ("NORMAL", 0) and got[("a", 3)] == ("AT_RISK", 1) and got[("a", 9)] == ("AT_RISK", 1)
    assert got[("a", 10)] == ("FAILURE_DAY", None) and got[("a", 12)] == ("POST_FAILURE", None)
    assert got[("b", 24)] == ("NORMAL", 0) and got[("b", 25)] == ("CENSORED", None)
    assert got[("c", 28)] == ("AT_RISK", 1)  # failure inside the censored zone still counts


def expected_features(rows):
    p = pd.DataFrame(rows, columns=["serial_number", "date", "value"]).sort_values(["serial_number", "date"])
    g = p.groupby("serial_number")["value"]
    p["d1"], p["d7"] = p["value"] - g.shift(1), p["value"] - g.shift(7)
    roll = g.rolling(7, min_periods=2)
    p["mean"], p["range"] = roll.mean().reset_index(level=0, drop=True), (roll.max() - roll.min()).reset_index(level=0, drop=True)
    return {(r.serial_number, r.date): r for r in p.itertuples()}


def close(a, b):
    return (a is None or np.isnan(a)) if b is None or np.isnan(b) else abs(a - b) < 1e-9


def test_temporal_features_with_and_without_a_hot_key(spark):
    rows, df = days(spark)
    want = expected_features(rows)
    for limit in (10_000, 11):  # 11 rows per block forces the block path
        got = D.temporal_features(df, ["value"], "value", ["value"], max_rows=limit).collect()
        assert len(got) == len(rows)
        for r in got:
            w = want[(r.serial_number, r.date)]
            assert close(r.value_delta_1, w.d1) and close(r.value_delta_7, w.d7) and close(r.value_7obs_mean, w.mean) and close(r.value_7obs_range, w.range)


def test_sequences_need_consecutive_days(spark):
    rows = [(1, date(2024, 1, d), float(d), 0) for d in range(1, 32)] + [(2, date(2024, 1, d), 1.0, 0) for d in range(1, 31) if d != 15] + [(3, date(2024, 1, d), 1.0, 0 if d < 30 else None) for d in range(1, 31)]
    df = spark.createDataFrame(rows, "serial_number long, date date, value double, target int")
    for limit in (10_000, 32):
        got = D.sequences(df, ["value"], 30, max_rows=limit).orderBy("date").collect()
        assert [(r.serial_number, r.date.day) for r in got] == [(1, 30), (1, 31)]
        assert [x[0] for x in got[1].sequence] == [float(d) for d in range(2, 32)]


def test_percentiles_match_numpy(spark):
    rng = np.random.default_rng(2)
    data = [(int(g), float(v)) for g in range(3) for v in np.round(rng.normal(0, 2, 501 + g), 1)] + [(9, 4.0)] * 300 + [(9, None)]
    got = {r.g: r for r in ranks.percentiles(spark.createDataFrame(data, "g int, v double"), ["g"], "v", {"a": .25, "b": .5, "c": .995}, ranges=7).collect()}
    for g in (0, 1, 2, 9):
        v = np.array([x for k, x in data if k == g and x is not None])
        assert got[g].n == len(v)
        assert np.allclose([got[g].a, got[g].b, got[g].c], np.quantile(v, [.25, .5, .995]))


def test_downsampling_is_exact_and_repeatable(spark):
    rows = [(i, date(2024, 1, 1), f"P{i % 3}", 1 if i % 50 == 0 else 0) for i in range(3000)]
    df = spark.createDataFrame(rows, "serial_number long, date date, period string, target int")
    a = sorted(D.downsample_negatives(df, 7).select("serial_number").toPandas()["serial_number"])
    b = sorted(D.downsample_negatives(df.repartition(5), 7).select("serial_number").toPandas()["serial_number"])
    assert a == b and len(a) == 60 + 420 and len(set(a)) == len(a)


def test_golden_confusion_ratios(spark):
    cells = spark.createDataFrame([(1, 1, 1445), (1, 0, 41281), (0, 1, 2840), (0, 0, 17018481)], "p int, y int, n long")
    # The counts are published per cell; shrink by expanding only the ratio-defining cells.
    df = cells.where("p = 1 OR y = 1").select("p", "y", F.explode(F.sequence(F.lit(1), F.col("n"))))
    m = M.binary_metrics(df, "y", ["p"]).first()
    assert (m.tp, m.fp, m.fn) == (1445, 41281, 2840)
    assert round(m.precision, 5) == 0.03382 and round(m.recall, 5) == 0.33722 and round(m.f1, 5) == 0.06147


def test_ranking_metrics_match_brute_force(spark):
    rng = np.random.default_rng(3)
    rows = [(float(np.round(rng.random(), 1)), int(rng.random() < 0.3)) for _ in range(400)]
    m = M.ranking_metrics(spark.createDataFrame(rows, "s double, y int"), "s", "y").first()
    pos, neg = [s for s, y in rows if y], [s for s, y in rows if not y]
    assert abs(m.roc_auc - np.mean([1.0 if p > n else 0.5 if p == n else 0.0 for p in pos for n in neg])) < 1e-12


def test_operating_curve_matches_per_threshold_evaluation(spark):
    rng = np.random.default_rng(4)
    rows = [(int(rng.integers(0, 40)), date(2024, 1, 1) + timedelta(days=int(rng.integers(0, 30))), int(rng.random() < 0.1), float(np.round(rng.random(), 2))) for _ in range(900)]
    rows = [(s, d, y, p, d + timedelta(days=1 + s % 7)) for s, d, y, p in rows]
    p = pd.DataFrame(rows, columns=["serial_number", "date", "y", "probability", "failure_date"])
    for r in M.operating_curve(spark.createDataFrame(p), [0.05, 0.45, 0.9]).collect():
        hit = p[p.probability >= r.threshold]
        assert r.alerts == len(hit) and r.drives_flagged == hit.serial_number.nunique()
        first = hit[hit.y == 1].sort_values("date").groupby("serial_number").first()
        lead = (pd.to_datetime(first.failure_date) - pd.to_datetime(first.date)).dt.days
        assert r.failed_drives_caught == len(first) and abs(r.mean_lead_days - lead.mean()) < 1e-9 and r.median_lead_days == lead.median()


def test_abstention_tie_goes_to_the_higher_threshold(spark):
    df = spark.createDataFrame([(0.2, 0), (0.4, 0), (0.6, 1), (0.9, 1)], "s double, y int")
    assert M.abstention_threshold(df, "s", "y").first().threshold == 0.6


def test_positions_of_a_long_group(spark):
    rng = np.random.default_rng(6)
    rows = [(int(g), float(x), i) for i, (g, x) in enumerate(zip(rng.integers(0, 2, 300), np.round(rng.random(300), 1)))]
    df = spark.createDataFrame(rows, "g int, x double, i long")
    for limit in (1000, 20):
        got = {r.i: r.p for r in ranks.positions(df, ["g"], ["x", "i"], "p", limit, 5).collect()}
        for g in (0, 1):
            order = sorted((x, i) for k, x, i in rows if k == g)
            assert all(got[i] == n for n, (_, i) in enumerate(order))
