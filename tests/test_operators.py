"""Hand-computed cases and properties of the rating, series, timetable, kernel and source operators."""

import json
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.functions import numeric as num
from tidemark.operators import asof, catches, exact, kernels, monitor, ratings, series, timetable
from tidemark.plans import series as series_plan
from tidemark.sources import lines, sinks


def one(spark, **cols):
    return spark.range(1).select(*[c.alias(n) for n, c in cols.items()]).first()


def test_numeric(spark):
    r = one(
        spark, a=num.sat_int(F.lit(-3.7)), b=num.sat_int(F.lit(float("nan"))), c=num.sat_int(F.lit(1e20)), d=num.int_div(F.lit(-350), 200), e=num.bucket(F.lit(-350), 200),
        f=num.ratio_or_one(F.lit(3.0), F.lit(-2.0)), g=num.ratio_or_one(F.lit(3.0), F.lit(2.0)), h=num.sign_power(F.lit(-2.0), 2.0, 3.0, 1.0), i=num.int_div(F.lit(3), 0))
    assert tuple(r) == (-3, 0, 2**31 - 1, -1, -200, 1.0, 1.5, -11.0, None)


def test_delta_v1_matches_the_fold(spark):
    rng = random.Random(1)
    rows = [(rng.random() < 0.5, rng.choice([0, 100, 900, 1600, 5000]), rng.choice([None, 0, 1500, 4000]), rng.randrange(4000), rng.random() < 0.7, rng.random() < 0.3, rng.random() < 0.3) for _ in range(300)]
    df = spark.createDataFrame(rows, "w boolean, s long, o long, m long, k boolean, q boolean, t boolean")
    got = df.select("*", ratings.delta_v1(*[F.col(c) for c in "wsomkqt"]).alias("d")).collect()
    assert all(r.d == exact._delta(r.w, r.s, r.o, r.m, r.k, r.q, r.t) for r in got)


def test_mode_names(spark):
    df = spark.createDataFrame([("newbie_low_teir",), ("x_low_teir_a",), ("high_teir_b",), ("ranked",), ("",)], "m string")
    c, s = ratings.mode_names(F.col("m"))
    assert [tuple(r) for r in df.select(c, s).collect()] == [("newbie_common", "newbie"), ("low_teir_common", "low_teir_a"), ("high_teir_common", "high_teir_b"), ("lobbie_common", "lobbie"), ("lobbie_common", "lobbie")]


def test_exact_folds_start_states():
    import pandas as pd

    seats = [(1, u, 5, 100 * u, u < 6, False, False, "faction_1" if u < 6 else "faction_2", 5500) for u in range(1, 11)]
    pdf = pd.DataFrame(seats, columns=["session_id", "user_id", "at", "score", "won", "quit", "top20", "faction", "total_score"])
    board = {3: [700, 3, 900], 4: [800, 5, 1000], 5: [1500, 9, 9000]}
    out = exact.fold_v1(pdf, board).set_index("user_id")
    assert out.mmr[1] == 100 and out.battles[1] == 1  # first battle: the raw score
    assert out.mmr[3] == (900 + 300) // 4 and out.mmr[4] == (1000 + 400) // 6
    assert out.mmr[5] == max(1500 + out.delta[5], 0) and (out.mmr >= 0).all()
    v2 = exact.fold_v2(pdf, {})
    assert (v2.mmr == v2.delta.clip(lower=0)).all()


def test_v2_exact_equals_snapshot_for_one_session(spark, sf):
    from tidemark.plans import ratings as q

    seats, board, modes = q._seats(spark, sf), q._board(spark, sf), q._modes(spark, sf)
    first = ratings.gate(seats, modes).orderBy("session_id").select("session_id").limit(1)
    s = seats.join(first, "session_id", "left_semi").persist()
    a = {r.user_id: r.delta for r in exact.rate_exact(s, board, modes, "v2").collect()}
    b = {r.user_id: r.delta for r in ratings.v2_snapshot(s, board, modes).collect()}
    assert a == b and a


def test_components(spark):
    rng = random.Random(7)
    edges = [(s, rng.randrange(60)) for s in range(40) for _ in range(2)] + [(100 + i, 1000 + i + d) for i in range(50) for d in (0, 1)]  # and a long chain
    parent = {}

    def root(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for s, u in edges:
        parent[root(("s", s))] = root(("u", u))
    got = {r.session_id: r.component for r in exact.components(spark.createDataFrame(edges, "session_id long, user_id long"), "session_id", "user_id").collect()}
    least = {}
    for s, u in edges:
        r = root(("u", u))
        least[r] = min(least.get(r, u), u)
    assert got == {s: least[root(("s", s))] for s, _ in edges}
    assert exact.components(spark.createDataFrame([], "session_id long, user_id long"), "session_id", "user_id").count() == 0


def test_parts_by_hubs(spark):
    rng = random.Random(3)
    # Stars around three hubs, two of them linked by a shared user only, pairs beside them that reach a hub's user, and loners.
    edges = [(s, 900 + s % 3) for s in range(60)] + [(s, 10 * (s % 3) + rng.randrange(8)) for s in range(60)] + [(0, 777), (1, 777)]
    edges += [(100, 2), (100, 600), (101, 600), (101, 601), (200, 700), (200, 701), (201, 701)]
    parent = {}

    def root(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for s, u in edges:
        parent[root(("s", s))] = root(("u", u))
    least = {}
    for _, u in edges:
        r = root(("u", u))
        least[r] = min(least.get(r, u), u)
    df = spark.createDataFrame(edges, "session_id long, user_id long")
    for hubs in (0, 1, 3, 60):
        s, u = exact.parts(df, "session_id", "user_id", hubs)
        assert sorted(map(tuple, s.collect())) == sorted({(x, least[root(("s", x))]) for x, _ in edges})
        assert sorted(map(tuple, u.collect())) == sorted({(x, least[root(("u", x))]) for _, x in edges})


def test_v2_streams_groups_of_any_size(spark, sf):
    from tidemark.plans import ratings as q

    seats, board, modes = q._seats(spark, sf), q._board(spark, sf), q._modes(spark, sf)
    state = {r.user_id: [r.mmr, r.battles, r.battle_score] for r in board.collect()}
    want = exact.fold_v2(exact._stream(seats, modes).toPandas(), state)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 7)  # sessions go on over the ends of batches
    try:
        got = exact.rate_exact(seats, board, modes, "v2", most_rows=3).toPandas()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    key = ["session_id", "user_id"]
    assert len(got) > 100 and (got.sort_values(key).to_numpy() == want.sort_values(key)[got.columns].to_numpy()).all()


def test_v2_by_components_equals_one_fold(spark, sf):
    from tidemark.plans import ratings as q

    seats, board, modes = q._seats(spark, sf), q._board(spark, sf), q._modes(spark, sf)
    got = exact.rate_exact(seats, board, modes, "v2").toPandas().sort_values(["session_id", "user_id"]).reset_index(drop=True)
    state = {r.user_id: [r.mmr, r.battles, r.battle_score] for r in board.collect()}
    want = exact.fold_v2(exact._stream(seats, modes).toPandas(), state).sort_values(["session_id", "user_id"]).reset_index(drop=True)
    assert len(got) == len(want) > 100 and (got.to_numpy() == want[got.columns].to_numpy()).all()


def test_v2_slices_cover_all_sessions(spark, sf, monkeypatch):
    from tidemark.plans import ratings as q

    start, week = 1_356_998_400_000, 7 * 86_400_000
    times = [(1, start - 1), (2, start), (2, start + week), (3, start + 60 * week + 5), (4, None)]
    rows = spark.createDataFrame(times, "session_id long, commit_time long").coalesce(1)
    edges = [start + k * week for k in (-1, 0, 1, 60, 61)]
    monkeypatch.setattr(q, "_seats", lambda s, d: rows)
    monkeypatch.setattr(exact, "rate_slices", lambda seats, board, modes, variant, edges: edges)
    assert q.v2_slices(spark, sf) == edges


def test_islands_brute_force(spark):
    rng = random.Random(4)
    rows = [(i, rng.choice([None, 1, 2])) for i in range(0, 900, 3)]
    got = sorted(tuple(r) for r in ratings.session_islands(spark.createDataFrame(rows, "o long, v long"), "o", "v", chunk=50).collect())
    want = []
    for o, v in rows:
        if want and want[-1][2] == v:
            want[-1] = (want[-1][0], o, v, want[-1][3] + 1)
        else:
            want.append((o, o, v, 1))
    assert got == want


def py_dtw(a, b, w=None):
    c = np.full((len(a), len(b)), np.inf)
    for i in range(len(a)):
        for j in range(len(b)) if w is None else range(max(0, i - w), min(len(b), i + w)):
            prev = 0 if not i and not j else min(c[i - 1, j] if i else np.inf, c[i, j - 1] if j else np.inf, c[i - 1, j - 1] if i and j else np.inf)
            c[i, j] = (a[i] - b[j]) ** 2 + prev
    return math.sqrt(c[-1, -1])


def test_dtw(spark):
    rng = np.random.default_rng(0)
    rows = [(rng.random(rng.integers(1, 9)).tolist(), rng.random(rng.integers(1, 9)).tolist()) for _ in range(30)]
    df = spark.createDataFrame(rows, "a array<double>, b array<double>")
    got = df.select("a", "b", series.dtw(F.col("a"), F.col("b")).alias("d"), series.dtw(F.col("a"), F.col("b"), 2).alias("w"), series.euclid(F.col("a"), F.col("b")).alias("e")).collect()
    for r in got:
        assert r.d == pytest.approx(py_dtw(r.a, r.b)) and (r.w == pytest.approx(py_dtw(r.a, r.b, 2)) or math.isinf(r.w))
        assert len(r.a) != len(r.b) or r.d <= r.e + 1e-9
    assert spark.createDataFrame([([], [1.0])], df.schema).select(series.dtw(F.col("a"), F.col("b"))).first()[0] is None
    x = np.array([[1.0, 2, 3], [3, 3, 3]])
    assert series.dtw_table(x[0], x, None)[0, -1, -1] == 0 and series.warp_path(series.dtw_table(x[0], x, None)[0]) == [(0, 0), (1, 1), (2, 2)]


def test_euclid_sparse_moves_no_pairs(spark):
    rng = random.Random(2)
    value = lambda: rng.choice([None, float("inf"), 1.5, *[rng.random() * 9 for _ in range(9)]])
    rows = [(i, x, value()) for i in range(60) for x in range(12 if i % 2 else 40) if rng.random() < (0.9 if i % 3 else 0.2)] + [(99, 7, None)]
    by = {}
    for i, x, y in rows:
        by.setdefault(i, {})[x] = y
    want = {}
    for a in (i for i in by if i % 7 == 0 or i == 99):
        for b in by:
            both = by[a].keys() & by[b].keys()
            terms = [(by[a][x] - by[b][x]) ** 2 for x in both if None not in (by[a][x], by[b][x])]
            if both:
                want[a, b] = math.sqrt(sum(terms)) if terms else None
    p = series.spread(series.pack(spark.createDataFrame(rows, "id long, x long, y double")))
    df = series.search(p, p.where("id % 7 = 0 or id = 99"), series.sparse_kernel(cells=100), block=8)
    got = {(r.id1, r.id2): r.distance for r in df.collect()}
    assert got.keys() == want.keys() and None in want.values()
    assert all(got[k] == pytest.approx(w, nan_ok=True) if w is not None else got[k] is None for k, w in want.items())
    assert "Exchange" not in df._jdf.queryExecution().executedPlan().toString()
    assert series.euclid_sparse(p, p.where("id < 0")).count() == 0


def test_dtw_search_equals_the_column_and_runs_in_arrow(spark):
    rng = np.random.default_rng(5)
    rows = [(i, rng.random(rng.choice([1, 3, 6, 7])).tolist()) for i in range(40)]
    rows += [(40, [None, None]), (41, []), (42, None), (43, [float("nan"), 1.0, float("inf")]), (44, [1e200, 2.0, 0.5])]
    df = series.spread(spark.createDataFrame(rows, "id long, v array<double>"))
    pairs = series.against_all(df, df.where("id % 4 = 0 or id > 39"))
    for window in (None, 0, 2, 3):
        want = {(r.id1, r.id2): r.d for r in pairs.select("id1", "id2", series.dtw(F.col("a"), F.col("b"), window).alias("d")).collect()}
        want |= {k: None for k in want if 40 in k}  # a null place leaves no distance; the column reads it as 0
        out = series.search(df, df.where("id % 4 = 0 or id > 39"), series.dtw_kernel(window, cells=7), block=10)
        got = {(r.id1, r.id2): r.distance for r in out.collect()}
        assert got.keys() == want.keys() and len(got) == 15 * 45
        assert all((got[k] is None) == (w is None) and (w is None or got[k] == w or math.isnan(got[k]) and math.isnan(w)) for k, w in want.items())
    plan = series.dtw_search(df, df.where("id = 0"), 3)._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" in plan and "aggregate(" not in plan


def test_dtw_banded_asks_every_series(spark, tmp_path):
    """No id here is a fiftieth one; each is asked all the same, and ids 7 and 8 (zeros only) have rows without distance."""
    duckdb = pytest.importorskip("duckdb")
    rng = random.Random(6)
    ids = [1, 7, 8, 49, 51, 99, 101, None]
    rows = [(u, f"2024-01-0{k % 5 + 1} {rng.randrange(24):02d}:00:00", 0.0 if u in (7, 8) else rng.random() * 9) for u in ids for k in range(9)]
    spark.createDataFrame(rows, "user_id long, ts string, value double").withColumn("ts", F.to_timestamp("ts")).write.parquet(f"{tmp_path}/events.parquet")
    got = {(r.id1, r.id2): r.distance for r in series_plan.dtw_banded(spark, str(tmp_path)).collect()}
    v = {u: np.zeros(24) for u in ids if u}
    for u, t, y in rows:
        if u:
            v[u][int(t[11:13])] += y
    norm = {u: 2 * x / (3 * math.sqrt((x * x).mean())) if x.any() else None for u, x in v.items()}
    assert got.keys() == {(a, b) for a in norm for b in norm} and len(got) == 49
    assert all((d is None) == (norm[a] is None or norm[b] is None) and (d is None or d == pytest.approx(py_dtw(norm[a], norm[b], 3), abs=1e-4)) for (a, b), d in got.items())
    duck = duckdb.connect()
    duck.execute(f"create view events as select * from '{tmp_path}/events.parquet/*.parquet'")
    want = {(a, b): d for a, b, d in duck.execute(series_plan.ORACLE["dtw_banded"]).fetchall()}
    assert got == want
    x = np.concatenate([np.random.default_rng(8).random(2000) * 30, np.arange(2000) / 2e4, np.nextafter(np.arange(2000) / 2e4, 9), [np.inf, 1e305, 5e15 + 0.5]])
    assert series.half_up(x, 4).tolist() == duck.execute("select list_transform(?::double[], lambda v: round(v, 4))", [x.tolist()]).fetchone()[0]
    assert np.isnan(series.half_up(np.array([np.nan]), 4)).all()


def test_kmeans(spark):
    rng = np.random.default_rng(1)
    rows = [(i, (np.ones(6) * (i % 3) * 5 + rng.normal(0, 0.1, 6)).tolist()) for i in range(90)]
    df = spark.createDataFrame(rows, "id long, v array<double>")
    for cfg in (series.ClusterConfig(metric="Euclidean", iterations=5), series.ClusterConfig(metric="DtwWindowed", window=2, iterations=2, barycenter_iterations=1)):
        c, a = series.fit(df, 3, cfg)
        got = a.toPandas()
        assert all(got[got.id % 3 == k].cluster.nunique() == 1 for k in range(3)) and got.cluster.nunique() == 3
    t = series.temporal_clusters(df, series.ClusterConfig(metric="Euclidean", iterations=5, min_cluster=5, good_sigma=0.5, bad_sigma=0.9))
    assert t.count() == 90 and t.select("id").distinct().count() == 90
    assert series.duplicates({0: np.zeros(3), 1: np.zeros(3) + 0.01, 2: np.ones(3)}, 0.1, series.ClusterConfig(metric="Euclidean")) == {0: 1}


def plain_fit(data, k, seed):
    """k-means of {id: v} without Spark: centroids and {id: (cluster, distance)}."""
    v = np.array([data[i] for i in sorted(data)])
    c = v[np.random.default_rng(100 * seed + k).choice(len(v), k, replace=False)]
    for _ in range(4):
        near = np.linalg.norm(v[:, None] - c[None], axis=2).argmin(1)
        c = np.stack([v[near == i].mean(0) for i in np.unique(near)])
    d = np.linalg.norm(v[:, None] - c[None], axis=2)
    return c, {i: (int(n), float(x)) for i, n, x in zip(sorted(data), d.argmin(1), d.min(1))}


def fold_clusters(data, cfg):
    """The refinement driver in plain Python: {id: cluster}, outlines -1."""
    def near(c, i, gone):
        return min(((np.linalg.norm(c[i] - c[j]), j) for j in c if j != i and j not in gone), default=(np.inf, -1))

    def merge(clusters):
        gone = {}
        for i in sorted(clusters):
            d, j = near({k: v[0] for k, v in clusters.items()}, i, gone)
            if d < cfg.cluster_distance:
                gone[i] = j
        for i, j in gone.items():
            clusters[j][3].update(clusters[i][3])
            clusters[i][3].clear()
        return {k: v for k, v in clusters.items() if k not in gone}

    def run(ids, seed, base):
        fits = [plain_fit({i: data[i] for i in ids}, k, seed) for k in range(cfg.k_min, cfg.k_max + 1)]
        best = min(fits, key=lambda f: np.mean([d for _, d in f[1].values()]))
        clusters = {}
        for n, c in enumerate(best[0]):
            own = {i: d for i, (k, d) in best[1].items() if k == n}
            score, sigma = (np.mean(list(own.values())), np.std(list(own.values()))) if own else (0, 0)
            kind = "Outline" if sigma > cfg.bad_sigma or len(own) < cfg.min_cluster else "Good" if sigma < cfg.good_sigma else "Reclust"
            clusters[base + n] = (c, kind, sigma, {i: abs(d - score) for i, d in own.items()})
        return merge(clusters)

    good, out = {}, set()

    def act(clusters, deeper):
        for n, (c, kind, sigma, dev) in clusters.items():
            if kind == "Outline":
                out.update(dev)
            elif kind == "Reclust" and deeper:
                act(run(sorted(dev), cfg.seed + n + 1, (n + 1) * 100), False)
            else:
                out.update(i for i, d in dev.items() if d > 3 * sigma)
                good[n] = (c, kind, sigma, {i: d for i, d in dev.items() if d <= 3 * sigma})

    act(run(sorted(data), cfg.seed, 0), True)
    return {i: n for n, v in merge(good).items() for i in v[3]} | dict.fromkeys(out, -1)


CLUSTER_CASES = {
    # k_max, cluster_distance, good_sigma, bad_sigma, spread of the wide group
    "good_outliers": (3, 0.1, 0.5, 0.9, 0.1),
    "merge_in_run": (5, 1.5, 0.3, 2.0, 1.0),
    "medium": (5, 0.3, 0.12, 2.0, 1.0),
}


@pytest.mark.parametrize("case", CLUSTER_CASES)
def test_temporal_clusters_equals_the_fold(spark, monkeypatch, case):
    k_max, near, good, bad, wide = CLUSTER_CASES[case]
    rng = np.random.default_rng(5)
    data = {i: (np.ones(6) * (i % 3) * 5 + rng.normal(0, wide if i % 3 == 2 else 0.1, 6)).tolist() for i in range(120)}
    data |= {200: [0.8] * 6, 201: [4.2] * 6}
    cfg = series.ClusterConfig(metric="Euclidean", k_min=2, k_max=k_max, min_cluster=5, cluster_distance=near, good_sigma=good, bad_sigma=bad)

    def fit(rows, k, cfg):
        data = {r.id: r.v for r in rows.select("id", "v").collect()}
        c, a = plain_fit(data, k, cfg.seed)
        return c, spark.createDataFrame([(i, data[i], *x) for i, x in a.items()], "id long, v array<double>, cluster int, distance double").coalesce(1)

    monkeypatch.setattr(series, "fit", fit)
    got = series.temporal_clusters(spark.createDataFrame(list(data.items()), "id long, v array<double>"), cfg).collect()
    assert len(got) == len(data) and all((r.cluster == -1) == (r["class"] == "Outline") for r in got)
    assert {r.id: r.cluster for r in got} == fold_clusters(data, cfg)
    if case == "good_outliers":
        assert {r.id for r in got if r.cluster == -1} >= {200, 201}


def test_asof(spark):
    rng = random.Random(6)
    ev = [(rng.randrange(3000), rng.choice("123")) for _ in range(60)]
    pr = [(i, rng.randrange(3200)) for i in range(200)] + [(900, 0)]
    got = asof.last_before(spark.createDataFrame(pr, "id long, t long"), "t", spark.createDataFrame(ev, "t long, code string"), "t", "code", F.lit("1"), chunk=100)
    want = {i: max([(a, c) for a, c in ev if a < t], default=(0, "1"))[1] for i, t in pr}
    assert {r.id: r.code for r in got.collect()} == want


def test_validate(spark):
    stats = spark.createDataFrame([("p", 100, 1000, 1), ("p", 200, 4000, 2)], "name string, long long, total long, n long")
    rows = spark.createDataFrame([(1, "p", 50, 5), (2, "p", 100, 1049), (3, "p", 100, 1051), (4, "p", 150, 1), (5, "p", 300, 3000), (6, "q", 5, 5), (7, "p", None, 5)], "catch_id long, name string, long long, mass long")
    got = {r.catch_id: (r.lm_mark, r.lm_err) for r in catches.validate(rows, stats, "name", "long", "mass", "lm").collect()}
    assert got == {1: ("NotEnoughData", None), 2: ("FullAccuracy", 49.0), 3: ("FullyNotSure", 51.0), 4: ("NotEnoughData", None), 5: ("FullAccuracy", 0.0), 6: ("NotEnoughData", None), 7: (None, None)}


def lev(a, b):
    d = list(range(len(b) + 1))
    for i, x in enumerate(a):
        p, d[0] = d[0], i + 1
        for j, y in enumerate(b):
            p, d[j + 1] = d[j + 1], min(d[j + 1] + 1, d[j] + 1, p + (x != y))
    return d[-1]


def test_fuzzy(spark):
    rng = random.Random(8)
    for _ in range(40):
        text = "".join(rng.choice("abcд\n") for _ in range(rng.randrange(12)))
        tags = ["abc", "ca", "дab"]
        flat = text.replace("\n", " ")
        want = [min((lev(t, flat[i : i + len(t)]) for i in range(len(flat) - len(t) + 1)), default=-1) for t in tags]
        assert catches.window_distances(text, tags).tolist() == want
    df = spark.createDataFrame([(1, 0, "a silver pearch today"), (1, 1, "silver perch!"), (2, 0, "xx"), (3, 0, None)], "k long, n int, t string")
    config = {"silver perch": (["silver", "perch"], ["perch"]), "stone dace": (["stone", "dace"], ["dace"])}
    assert {r.k: (r.entity, r.score) for r in catches.best_entity(df, "k", "n", "t", config).collect()} == {1: ("silver perch", 0.0)}


def test_numbers(spark):
    r = one(spark, n=catches.numbers(F.lit("a 5 -5 +7 1.5 .5 007 99999999999999999999")))
    assert r.n == [5, 7, 7]
    assert one(spark, t=catches.file_time(F.lit("x/20250704_205001.png"))).t == 1751655001000


def test_timetable(spark):
    with pytest.raises(Exception, match="not a time"):
        spark.range(1).select(timetable.parse_hms(F.lit("1:70:0"))).collect()
    from tidemark.plans import timetable as q

    s = q.timetable_shifts(spark, "").toPandas()
    assert len(s) == 6155 and not s.duplicated(["side", "time_s"]).any()
    for _, g in s.sort_values(["day", "shift_id", "seq"]).groupby(["day", "shift_id"]):
        gaps = g.time_s.diff().dropna()
        assert ((gaps >= 3360) & (gaps <= 3420)).all() and (g.side != g.side.shift()).all()
    duties = q.timetable_roster(spark, "").toPandas()
    runs = duties[duties.kind == "Run"]
    assert not runs.duplicated(["day", "shift_id"]).any()


def test_monitor(spark):
    df = spark.createDataFrame([(1, 7, 10, 1, 5, 9), (1, 8, 20, 1, 6, 9), (2, 8, 30, 2, 7, 9), (4, 7, 11, 1, 8, 9), (4, 7, 11, 1, 8, 9)], "tick long, pid long, memory long, cpu long, cpu_time long, virtual long")
    got = {(r.tick, r.pid): (r.memory, r.cpu_time, r.was_in_time) for r in monitor.process_samples(df).collect()}
    assert got == {(1, 7): (10, 5, True), (1, 8): (20, 6, True), (2, 7): (0, 5, False), (2, 8): (30, 7, True), (4, 7): (11, 8, True), (4, 8): (0, 7, False)}


def test_kernels():
    rng = np.random.default_rng(3)
    x, k = rng.random((2, 6, 7)), rng.random((2, 3, 2))
    brute = np.array([[sum(x[c, i + a, j + b] * k[c, a, b] for c in range(2) for a in range(3) for b in range(2)) for j in range(6)] for i in range(4)])
    assert np.allclose(kernels.correlate(x, k), brute)
    full = np.zeros((8, 8))
    for c in range(2):
        for a in range(3):
            for b in range(2):
                full[a : a + 6, b : b + 7] += x[c] * k[c, a, b]
    assert np.allclose(kernels.fft_convolve(x, k), full[:6, :7])
    layer = kernels.ConvLayer(2, 3, (3, 3), pad=1)
    assert layer.predict(x).shape == (3, 6, 7) and layer.weight_count() == 54 and layer.gradients(x, np.ones((3, 6, 7))).shape == (3, 2, 3, 3)
    assert layer.output_size(6, 7) == (5, 6)
    for c in (1, 2, 3, 4):
        img = rng.integers(0, 256, (5, 9, c)).astype(np.uint8)
        assert (kernels.png_decode(kernels.png_encode(img)) == img).all()
    img = rng.integers(0, 256, (6, 6, 3)).astype(np.uint8)
    assert np.abs(kernels.resize_lanczos(img, 6, 6).astype(int) - img).max() <= 1  # bytes are truncated
    assert kernels.white_count(np.full((2, 2, 3), 255, np.uint8)) == 4 and kernels.white_count(np.full((2, 2, 3), 255, np.uint8), mode="bytes") == 10
    assert (kernels.quantise(np.array([15, 16], np.uint8)) == [8, 16]).all()
    white = np.zeros(900, int)
    white[300:400] = 20
    assert kernels.segments(white, 243, 40) and kernels.segments(np.zeros(900, int), 243, 40) == []


def test_image_pipeline(spark):
    img = np.full((4, 4, 3), 200, np.uint8)
    df = spark.createDataFrame([(1, bytearray(kernels.png_encode(img))), (2, bytearray(b"no image")), (3, None)], "id long, data binary")
    got = {r.id: r for r in kernels.images(df, "data", ["id"], kernels.binarise).collect()}
    assert got[1].width == 4 and (kernels.png_decode(bytes(got[1].png)) == 0).all() and got[2].png is None and got[3].png is None
    assert [r.text for r in kernels.text_provider(df, "data", "id", lambda b: str(len(b))).orderBy("id").collect()][1:] == ["8", None]


def test_sources_and_sinks(spark, tmp_path):
    kv = one(spark, m=lines.kv_entries(F.lit('{"a":1,"b":x:y,"a": 2,c}'))).m
    assert kv == {"a": " 2"}
    assert one(spark, h=lines.hex_id(F.lit("ffffffffffffffff")), z=lines.hex_id(F.lit("zz"))).h == 2**64 - 1
    p = tmp_path / "s.json"
    p.write_text(json.dumps([{"id": "1", "hour": "0", "time": 2.5}, {"id": 1, "hour": 1, "time": "3"}, {"id": "1", "hour": "0", "time": 4}]))
    assert {(r.id, r.x, r.y) for r in lines.series_json(spark, str(p), "hour", "time", "id").collect()} == {(1, 0, 4.0), (1, 1, 3.0)}
    assert lines.parse_ron('[(id: "a", direction: Right, depth: [(1, "0:0:0", "1:0:0")], place: Depot("x")), /* c */ ()]') == [
        {"id": "a", "direction": "Right", "depth": [[1, "0:0:0", "1:0:0"]], "place": ("Depot", ["x"])}, []]
    assert lines.parse_hms("168:00:09") == 168 * 3600 + 9
    df = spark.createDataFrame([(1, None, True), (2, 5, False)], "user_id long, mmr long, won boolean")
    assert sorted(r[0] for r in df.select(sinks.kv_text(["user_id", "mmr"], ("won",))).collect()) == ["user_id:1,won:1", "user_id:2,mmr:5"]
    sinks.write_kv(df, ["user_id", "mmr"], str(tmp_path / "kv"))
    assert {r.user_id: r.mmr for r in lines.leaderboard_lines(lines.read_lines(spark, str(tmp_path / "kv")), "value").collect()} == {1: 0, 2: 5}
    day = lambda v: spark.createDataFrame(v, "v long, day string")
    sinks.upsert_days(day([(1, "a"), (2, "b")]), "day", str(tmp_path / "u"))
    sinks.upsert_days(day([(3, "b")]), "day", str(tmp_path / "u"))
    assert sorted(tuple(r) for r in spark.read.parquet(str(tmp_path / "u")).select("v", "day").collect()) == [(1, "a"), (3, "b")]
    stats = spark.createDataFrame([("p", 5, 10, 2)], "name string, key long, total long, n long")
    text = sinks.bucket_json(stats).first()["json"]
    assert [tuple(r) for r in lines.bucket_json(spark, text).collect()] == [(5, 10, 2)]
    c = spark.createDataFrame([("p", "m", "1_2", "t", 5)], "name string, map_name string, point string, test string, mass long")
    sinks.add_catches(c, str(tmp_path / "db"))
    assert spark.read.parquet(str(tmp_path / "db/maps")).where("map_name = 'm'").count() == 1
    sinks.write_csv(spark.createDataFrame([(1, float("nan"))], "a long, b double"), str(tmp_path / "csv"))
    assert spark.read.csv(str(tmp_path / "csv"), header=True, sep=";").first()["b"] is None
    (tmp_path / "log.csv").write_text("timestamp;key\n5;1\n5;1\n6;2\n")
    assert lines.control_csv(spark, str(tmp_path / "log.csv")).count() == 2
    (tmp_path / "c.json").write_text(json.dumps({"fishes": {"x": {"tags": ["b", "a"]}}, "exp_types": {"y": {"tags": ["q"]}}}))
    assert lines.read_config(str(tmp_path / "c.json"))["tags"] == ["a", "b"]
    sinks.write_config({"a": 1}, str(tmp_path / "o.json"))
    (tmp_path / "d").mkdir()
    (tmp_path / "d/a.json").write_text("1")
    (tmp_path / "d/b.txt").write_text("1")
    assert [r.stem for r in lines.list_files(spark, str(tmp_path / "d"), "json").collect()] == ["a"]
