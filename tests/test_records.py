"""Text formats, folders, images, process samples, streams and whole runs on small written inputs."""

import json
import os
import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark import pipelines
from tidemark.operators import kernels, monitor, series
from tidemark.sources import lines, logs, processes, records, sinks
from tidemark.streaming import jobs


def text(spark, rows):
    return spark.createDataFrame([(i, r) for i, r in enumerate(rows)], "n long, line string")


def test_row_scans(spark):
    got = records.stored_rows(text(spark, ["user_id:1,session_id:2,commit_time:3,faction:f,victories:1,early_quit:0", "user_id:1,session_id:2,commit_time:3", "user_id:x,session_id:2,commit_time:3,faction:f", "", None])).collect()
    assert [(r.user_id, r.team, r.battle_score, r.victories, r.early_quit, r.faction) for r in got] == [(1, 0, 0, True, False, "f")]
    team = records.user_team(text(spark, ['{"user_id":1,"session_id":2,"team":1,"victory":false}', '{"user_id":1,"session_id":2,"team":2}', '{"user_id":1,"session_id":3,"team":4}', '{"user_id":5,"session_id":3,"team":1,"victory":false}', "x"]), "n").collect()
    assert {(r.user_id, r.session_id): (r.team, r.victory) for r in team} == {(1, 2): (2, False), (5, 3): (1, True)}  # the key alone means victory
    fac = records.user_faction(text(spark, ['{"user_id":1,"session_id":"ff","mode":"a"}', '{"user_id":1,"session_id":"ff"}', '{"user_id":2,"session_id":"zz"}', '{"mode":"q"}']), "n").collect()
    assert [(r.user_id, int(r.session_id), r["mode"]) for r in fac] == [(1, 255, "mixed")]
    cls = records.session_classes(text(spark, ["session_id:7,team_1:false,team_2:true,team_1_v:false", "team_1:true", "session_id:8,team_1:true,team_1_v:true"])).collect()
    assert sorted(tuple(r) for r in cls) == [(7, "team_2_unbalanced", "team_2_win"), (8, "team_1_unbalanced", "team_1_win")]
    pay = records.payments(text(spark, ['{"user_id":1,"revenue":2.5,"player_type":true}', '{"user_id":2,"player_type":"TRUE"}', '{"revenue":1}', "no json", None])).collect()
    assert sorted(tuple(r) for r in pay) == [(1, 2.5, True), (2, 0.0, True)]
    assert records.counters(text(spark, ["user_id:1,faction:f,battles:3", "user_id:1,faction:f"])).count() == 1
    spread = spark.createDataFrame([(200, 1, 2), (-200, 0, 1)], "bucket long, wins long, total long")
    assert records.spread_lines(spread, "b").first()[0] == 'b__top_3_disbalance_spread:{"-200":[0.0,0,1],"200":[0.5,1,2],};'


def test_map_logs(spark, tmp_path):
    cols = "name string, test string, timestamp string, mass long, long long, exp long, exp_l long, exp_happy long, exp_prem long, exp_sum long, exp_drink long, device string, exp_real long, map string, point string"
    row = lambda n, t, m, p: (n, "t", t, 5, 6, None, 1, 1, 1, 9, None, "d", 1, m, p)
    stats = spark.createDataFrame([("a", 5, 9, 1)], "name string, mass long, total long, n long")
    first = logs.ingest(spark.createDataFrame([row("a", "20130110_030000", "lake", "1_2"), row("b", "20130110_010000", "lake", "1_3")], cols), stats, str(tmp_path))
    assert {(r.name, r.total, r.n) for r in first.collect()} == {("a", 18, 2), ("b", 9, 1)}
    logs.ingest(spark.createDataFrame([row("c", "20130111_030000", "sea", "1_2"), row("d", "unreadable", "sea", "9_9")], cols), stats, str(tmp_path))
    assert sorted(n for n in os.listdir(tmp_path / "maps") if "=" in n) == ["map=lake", "map=sea"]
    assert logs.read_maps(spark, str(tmp_path)).count() == 4
    assert [r.name for r in logs.read_maps(spark, str(tmp_path), ["lake"], 1_357_776_000_000).collect()] == ["a"]
    assert "map=sea" not in logs.read_maps(spark, str(tmp_path), ["lake"])._jdf.queryExecution().executedPlan().toString() and logs.read_maps(spark, str(tmp_path), []).count() == 0


def test_small_formats(spark, tmp_path):
    v = [{"id": "a b", "n": 3, "deep": [1, 2.5], "on": True, "at": ("Depot", ["x"])}, []]
    assert lines.parse_ron(sinks.to_ron(v)) == [{"id": "a b", "n": 3, "deep": [1, 2.5], "on": True, "at": ("Depot", ["x"])}, []]
    duties = spark.createDataFrame([(0, "d", 1, 0, "Run", 4), (0, "d", 1, 1, "Depot", None), (1, "d", 2, 0, "ServiceA", None)], "day int, depot string, train int, seq int, kind string, shift_id long")
    sinks.write_duties(duties, str(tmp_path / "duties"))
    back = {r["day"]: lines.parse_ron(r["value"]) for r in spark.read.text(str(tmp_path / "duties")).where("value like '%seq: 0%'").collect()}
    assert back[0] == {"depot": "d", "train": 1, "seq": 0, "kind": "Run", "shift": 4} and back[1]["kind"] == "ServiceA"
    wide = sinks.result_rows(duties, lines.CATCH_SCHEMA + ", seq bigint")
    assert len(wide.columns) == 21 and wide.columns[0] == "mark" and wide.where("seq = 1 and mark is null").count() == 1
    (tmp_path / "r.json").write_text("[1, 2.5]")
    assert lines.read_regression(str(tmp_path / "r.json")) == [1.0, 2.5]
    e = lines.key_events(spark.createDataFrame([("5;1",), ("6;q",), ("x;1",), ("7",), (None,)], "value string"), ["1", "2"]).collect()
    assert [tuple(r) for r in e] == [(5, "1")]
    assert monitor.tick_rows(spark.createDataFrame([(1, 2, 3, 4, 5, 6)], "tick long, pid long, memory long, cpu long, cpu_time long, virtual_memory long")).first()[0] == "1;2;3;4;5;6"


def encode(img, filters, interlace=False, depth=8):
    """A PNG with chosen row filters, or interlaced, written by the definition."""
    h, w, c = img.shape
    chunk = lambda k, b: struct.pack(">I", len(b)) + k + b + struct.pack(">I", zlib.crc32(k + b))

    def rows(a):
        out, up = b"", np.zeros(a.shape[1] * c, int)
        for y in range(len(a)):
            line, f = a[y].reshape(-1).astype(int), filters[y % len(filters)]
            left, corner = np.r_[np.zeros(c, int), line[:-c]], np.r_[np.zeros(c, int), up[:-c]]
            p = left + up - corner
            d = [abs(p - v) for v in (left, up, corner)]
            paeth = np.where((d[0] <= d[1]) & (d[0] <= d[2]), left, np.where(d[1] <= d[2], up, corner))
            guess = [0, left, up, (left + up) // 2, paeth][f]
            out += bytes([f]) + ((line - guess) % 256).astype(np.uint8).tobytes()
            up = line
        return out

    parts = [img[y0::dy, x0::dx] for y0, x0, dy, dx in kernels.ADAM7] if interlace else [img]
    data = b"".join(rows(p) for p in parts if p.size)
    color = {1: 0, 2: 4, 3: 2, 4: 6}[c]
    extra = chunk(b"gAMA", struct.pack(">I", 45455)) + chunk(b"pHYs", struct.pack(">IIB", 2835, 2835, 1)) + chunk(b"cHRM", struct.pack(">8I", *[31270] * 8))
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, color, 0, 0, int(interlace))) + extra + chunk(b"IDAT", zlib.compress(data)) + chunk(b"IEND", b"")


def test_png_filters_and_interlacing():
    rng = np.random.default_rng(1)
    for c in (1, 2, 3, 4):
        for h, w in ((7, 11), (1, 1), (9, 2), (16, 16)):
            img = rng.integers(0, 256, (h, w, c)).astype(np.uint8)
            for filters in ([0], [1], [2], [3], [4], [4, 1, 3, 0, 2]):
                for interlace in (False, True):
                    assert (kernels.png_decode(encode(img, filters, interlace)) == img).all()
    meta = kernels.png_meta(encode(img, [0], True))
    assert meta["gamma"] == 0.45455 and meta["pixels_per_metre"] == (2835, 2835) and meta["interlace"] == 1 and len(meta["chroma"]) == 8


def test_matrix_columns_and_layers(spark, tmp_path):
    rng = np.random.default_rng(2)
    x, g = rng.random((7, 8)), rng.random((3, 2))
    for stride, pad in (((1, 1), (0, 0)), ((2, 3), (1, 2))):
        brute = np.zeros((3, 4))
        for m in range(3):
            for n in range(4):
                for h in range(3):
                    for w in range(2):
                        i, j = h * stride[0] + m - pad[0], w * stride[1] + n - pad[1]
                        if 0 <= i < 7 and 0 <= j < 8:
                            brute[m, n] += g[h, w] * x[i, j]
        assert np.allclose(kernels.kernel_gradient(x, g, (3, 4), stride, pad), brute)
    ms = [rng.random((4, 5)).tolist(), None, rng.random((3, 3)).tolist(), [[1.0, 2.0], [3.0]], [], rng.random((4, 5)).tolist()]
    df = spark.createDataFrame(list(enumerate(ms)), "id int, m array<array<double>>")
    got = {r.id: r.o for r in df.select("id", kernels.convolve(F.col("m"), np.ones((2, 2))).alias("o")).collect()}
    for i, m in enumerate(ms):
        if i in (0, 2, 5):
            assert np.allclose(got[i], kernels.correlate(np.array(m)[None], np.ones((1, 2, 2))))
        else:
            assert got[i] is None
    layer = kernels.ConvLayer(2, 3, (3, 3), pad=1)
    layer.save(str(tmp_path / "layer.json"))
    again = kernels.ConvLayer.read(str(tmp_path / "layer.json"))
    assert (again.weights == layer.weights).all() and again.kernel == (3, 3) and again.pad == 1


def test_series_arguments(spark):
    rows = [(i, [float(i), float(i % 3)]) for i in range(12)]
    v = spark.createDataFrame(rows, "id long, v array<double>")
    c = np.array([[0.0, 0.0], [8.0, 1.0]])
    taxi = series.ClusterConfig(metric=lambda centroid, x: np.abs(x - centroid).sum(1))
    got = {r.id: (r.cluster, r.distance) for r in series.assign(v, c, taxi).collect()}
    for i in range(12):
        far = [abs(i - x) + abs(i % 3 - y) for x, y in c]
        assert got[i] == (int(np.argmin(far)), min(far))
    pairs = series.against_all(v, v.where("id % 5 = 0"), block=2).select("id1", "id2").collect()
    assert sorted(tuple(p) for p in pairs) == [(q, i) for q in (0, 5, 10) for i in range(12)]
    assert series.against_all(v, v.limit(0)).count() == 0
    stats = spark.createDataFrame([(1, 1.0, 0.1), (2, 9.0, 0.8), (3, 5.0, 0.1)], "cluster int, arpu double, au_rate double")
    # Shares below 15 % from either end: by cluster number 1 and 2 are low, 3 is high; by falling arpu 2 comes first.
    assert {r.cluster: r.grp for r in series.share_groups(stats, key=F.col("cluster")).collect()} == {1: 20, 2: 20, 3: 80}
    assert {r.cluster: r.grp for r in series.share_groups(stats, key=-F.col("arpu")).collect()} == {2: 20, 3: 80, 1: 80}


def test_processes(spark):
    me = [r for r in processes.sample() if r[0] == os.getpid()]
    assert me and me[0][2] > 0
    spark.dataSource.register(processes.ProcessSource)
    got = spark.read.format("processes").option("name", "python").load()
    assert got.where(F.col("memory") > 0).count() > 0 and got.columns[:3] == ["tick", "pid", "name"]


def test_closed_on_change(spark, tmp_path):
    src, out, ck = (str(tmp_path / n) for n in ("in", "out", "ck"))
    schema = "feed string, row_id long, session_id long, battle_score long"
    put = lambda rows: spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(src)
    run = lambda: jobs.run_once(jobs.closed_on_change(jobs.stream_table(spark, src, schema)), out, ck)
    put([("a", 1, 5, 1), ("a", 2, 5, None), ("a", 3, 6, 1), ("b", 1, 5, 9), ("a", 4, None, 3)])
    run()
    put([("a", 5, 6, 2), ("a", 6, 5, 4), ("b", 2, 5, 1)])
    run()
    got = sorted(tuple(r) for r in spark.read.parquet(out).collect())
    assert got == [("a", 5, 1, 2, 2, 1), ("a", 6, 3, 5, 2, 3)]  # the last session of either feed stays open


def test_monitor_csv(spark, tmp_path):
    schema = "tick long, pid long, memory long, cpu long, cpu_time long, virtual long"
    spark.createDataFrame([(1, 7, 10, 1, 5, 9), (1, 8, 20, 1, 6, 9), (2, 8, 30, 2, 7, 9)], schema).coalesce(1).write.parquet(str(tmp_path / "in"))
    jobs.monitor_csv(jobs.stream_table(spark, str(tmp_path / "in"), schema), str(tmp_path / "out"), str(tmp_path / "ck")).awaitTermination()
    assert spark.read.csv(str(tmp_path / "out/samples"), sep=";").count() == 3
    assert sorted((r[0], r[1], r[4], r[5]) for r in spark.read.csv(str(tmp_path / "out/totals"), sep=";").collect()) == [("1", "30", "2", "2"), ("2", "30", "2", "1")]


def test_rate_sessions(spark, tmp_path):
    put = lambda n, rows: (tmp_path / n).write_text("\n".join(json.dumps(r, separators=(",", ":")) if isinstance(r, dict) else r for r in rows))
    big = "ffffffffffffff01"  # a session beyond the largest signed number
    battles = [{"user_id": u, "session_id": s, "commit_time": 1_357_000_000_000 + k, "battle_score": 100 * u, "early_quit": int(u == 3), "team_score_top_20_percent": 0, "faction": "faction_1" if u <= 5 else "none"} for k, s in enumerate(("1a", big)) for u in range(1, 11)]
    put("data", battles)
    put("team", [{"user_id": u, "session_id": s, "team": 1 + (u > 5), **({"victory": True} if u <= 5 else {})} for s in (0x1A, int(big, 16) - 2**64) for u in range(1, 11)])
    put("mode", ['{"session_id":26,"mode":"ranked"}', f'{{"session_id":{int(big, 16) - 2**64},"mode":"low_teir_x"}}'])
    put("faction", [{"user_id": u, "session_id": s, "mode": "faction_2"} for s in ("1a", big) for u in range(6, 11)])
    put("board", [f"user_id:{u},mmr:{1000 + 100 * u},battles:9,battle_score:9000" for u in range(1, 9)])
    paths = pipelines.RatingPaths(*(str(tmp_path / n) for n in ("data", "team", "mode", "faction", "board")))
    for variant in ("v1", "v2"):
        log = pipelines.rate_sessions(spark, paths, variant).toPandas()
        assert len(log) == 20 and set(log.battles[log.user_id <= 8]) == {10, 11} and log.session_id.nunique() == 2 and (log.mmr >= 0).all()
    assert pipelines.rate_sessions(spark, pipelines.RatingPaths(*(str(tmp_path / n) for n in ("data", "team", "mode", "faction"))), "v2").count() == 20
    assert pipelines.rate_sessions(spark, paths, "v2", [1_356_000_000_000, 1_358_000_000_000]).count() == 10


def test_catch_pipeline(spark):
    t = spark.createDataFrame([("20130110_120000.png", "caught\na river perch! 500 30\n 9000 30"), ("20130110_120500.png", "caught\nnothing here 5 6"), ("bad.png", "x\nriver perch 1")], "name string, text string")
    config = {"river perch": (["river", "perch"], ["perch"]), "stone carp": (["stone", "carp"], ["carp"])}
    devices = spark.createDataFrame([(1_357_800_000_000, "2"), (1_357_900_000_000, "3")], "t long, code string")
    mul = spark.createDataFrame([("1", 1.0, 0.0), ("2", 1.8, 0.25)], "device string, rig_mul double, light_mul double")
    stats = spark.createDataFrame([("river perch", 20, 200, 1), ("river perch", 28, 400, 1)], "name string, long long, total long, n long")
    got = {r.file: r for r in pipelines.catch_pipeline(t, config, devices, mul, stats, "t1", "lake", "1_2").collect()}
    assert set(got) == {"20130110_120000.png"}  # no species in one text, no line with a length in the other
    r = got["20130110_120000.png"]
    assert (r["name"], r.mass, r.long, r.map, r.device, r.rig_mul) == ("river perch", 500, 30, "lake", "2", 1.8)
    plain = pipelines.catch_pipeline(t, config, devices, mul, stats, "t1", "lake", "1_2", use_device=False)
    assert plain.where("device is null").count() == len(got)


def test_missing_vectors_and_matrices(spark):
    """Null and empty values: no cluster for a series without values, null for a matrix without rows."""
    v = spark.createDataFrame([(1, [1.0, 2.0]), (2, None), (3, []), (4, [0.0, 0.0])], "id long, v array<double>")
    got = series.assign(v, np.array([[0.0, 0.0], [1.0, 1.0]]), series.ClusterConfig(metric="Euclidean")).collect()
    assert sorted((r.id, r.cluster) for r in got) == [(1, 1), (4, 0)]
    for cfg in (series.ClusterConfig(k_max=3, iterations=2), series.ClusterConfig(metric="Euclidean", barycenter_iterations=1, iterations=2)):
        assert series.temporal_clusters(v.limit(0), cfg).count() == 0
    m = spark.createDataFrame([(1, [[1.0, 2.0]]), (2, None), (3, [])], "id long, m array<array<double>>")
    r = {x.id: (x.p, x.s) for x in m.select("id", kernels.pad_edge(F.col("m"), 1, 1).alias("p"), kernels.resize_nearest(F.col("m"), 1, 2).alias("s")).collect()}
    assert r[1] == ([[1.0, 1.0, 2.0, 2.0]] * 3, [[1.0]] * 2) and r[2] == r[3] == (None, None)
