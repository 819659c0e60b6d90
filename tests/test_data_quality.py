"""Rejects, orphans, features and spikes against brute force and on odd tables."""

import random
import re

import pytest
from pyspark.sql import functions as F

from tidemark.operators import features, orphans, rejects, spikes
from tidemark.operators.seats import last_seats


# --- rejected lines ---------------------------------------------------------------------------------

def fields_of(line):
    """Independent reader of the quoted format: list of fields or None."""
    line = line.removeprefix("﻿")
    line = line[:-1] if line.endswith("\r") else line
    out, i = [], 0
    while True:
        if line[i : i + 1] == '"':
            m = re.compile(r'"((?:[^"]|"")*)"').match(line, i)
            if not m or line[m.end() : m.end() + 1] not in ("", ";"):
                return None
            out.append(m[1].replace('""', '"'))
            i = m.end()
        else:
            end = line.find(";", i)
            end = len(line) if end < 0 else end
            if '"' in line[i:end]:
                return None
            out.append(line[i:end].strip(" \t"))
            i = end
        if i >= len(line):
            return out
        i += 1


def battle_ok(line):
    f = fields_of(line) if line is not None else None
    if f is None or len(f) != 10:
        return False
    number = lambda x, lo, hi: bool(re.fullmatch("[0-9]+", x)) and lo <= int(x) <= hi
    return (
        number(f[0], 1, 2**63 - 1) and bool(re.fullmatch("[0-9a-fA-F]{1,16}", f[1])) and number(f[2], 1262304000000, 1735689599999) and number(f[3], 1, 2)
        and (f[4] == "" or number(f[4], 0, 2**32 - 1)) and all(x in ("", "0", "1") for x in f[5:8]) and f[8] != ""
    )


GOOD = '13700835;100068684a1a;1357180411384;2;864;0;1;1;faction_1;'
ODD = [
    None, "", " ", ";;;;;;;;;", GOOD, "﻿" + GOOD, GOOD + "\r", GOOD + "\r\r", GOOD + '"a;b"', GOOD + '"say ""x"""', GOOD + '"open', GOOD + 'a"b', GOOD + '"x" ', GOOD + ' "x"',
    GOOD + '"first\nsecond"', GOOD + "\x01\x02", GOOD + '"\x01;\x02"', GOOD + "x;y", GOOD.replace("864", ""), GOOD.replace("864", "4294967296"), GOOD.replace("864", "-1"),
    GOOD.replace("864", "٣"), GOOD.replace(";2;", ";3;"), GOOD.replace("100068684a1a", "0" * 17), GOOD.replace("100068684a1a", "ffffffffffffffff"), GOOD.replace("faction_1", '""'),
    GOOD.replace("faction_1", " "), GOOD.replace("13700835", "0"), GOOD.replace("13700835", "9223372036854775808"), GOOD.replace("13700835", "000009223372036854775807"),
    GOOD.replace("13700835", '" 13700835"'), GOOD.replace("13700835", '"13700835"'), GOOD + '"' + 'q""' * 50_000 + '"', GOOD + "z" * 200_000, GOOD.replace("1357180411384", "1735689600000"),
    GOOD.replace("100068684a1a", "f" * 30), GOOD.replace("100068684a1a", "f" * 16),
    GOOD + "x\r", GOOD + '"x"\r', '"' + GOOD, '""' + GOOD,
]


def test_battle_lines_brute_force(spark):
    rng = random.Random(5)
    alphabet = ['"', ";", " ", "\r", "1", "a", '""', '";"', "\t"]
    lines = list(ODD)
    for _ in range(400):
        s = list(GOOD)
        for _ in range(rng.randint(1, 3)):
            s.insert(rng.randrange(len(s) + 1), rng.choice(alphabet))
        lines.append("".join(s))
    df = spark.createDataFrame(list(enumerate(lines)), "line_id long, line string")
    good, bad = rejects.split_records(df, rejects.BATTLE_FORMAT)
    got = {r[0] for r in bad.select("line_id").collect()}
    assert got == {i for i, x in enumerate(lines) if not battle_ok(x)}
    kept = {r["line_id"]: r for r in good.collect()}
    assert set(kept) == set(range(len(lines))) - got
    assert kept[4]["session_id"] == int("100068684a1a", 16) and kept[4]["team"] == 2 and kept[4]["victories"] is False and kept[4]["remark"] == ""
    assert kept[8]["remark"] == "a;b" and kept[9]["remark"] == 'say "x"' and kept[15]["remark"] == "\x01\x02" and kept[16]["remark"] == "\x01;\x02"
    assert all(r["reasons"] for r in bad.collect())


def test_leaderboard_lines(spark):
    good = ["user_id:1", "{user_id:1,mmr:5}", ' { "user_id" : "7" , mmr : 003 } \r', "mmr:4294967295,user_id:9", "user_id:9223372036854775807,last_session:9223372036854775807"]
    bad = [None, "", "{}", "user_id:1,", "user_id:0", "mmr:1", "user_id:1,mmr:1,mmr:1", "user_id:1,what:2", "{user_id:1", "user_id:1}", "user_id:1,mmr:a", "user_id:1,mmr:4294967296", "user_id:1:2", 'user_id:1,"mmr:5', "user_id:1,mmr:", 'user_id:" 1"']
    df = spark.createDataFrame(list(enumerate(good + bad)), "line_id long, line string")
    rec, rej = rejects.split_records(df, rejects.LEADERBOARD_FORMAT)
    assert sorted(r[0] for r in rej.select("line_id").collect()) == list(range(len(good), len(good + bad)))
    r = {x["line_id"]: x for x in rec.collect()}
    assert r[2]["user_id"] == 7 and r[2]["mmr"] == 3 and r[2]["battles"] is None


def test_reject_edges(spark):
    schema = "line_id long, line string, reasons string, _v int, _c int"
    df = spark.createDataFrame([(None, GOOD, "x", 1, 2), (None, "bad", "x", 1, 2), (3, GOOD, "x", 1, 2), (3, GOOD, "x", 1, 2), (4, "bad", None, None, None)], schema)
    good, bad = rejects.split_records(df, rejects.BATTLE_FORMAT)
    assert good.count() == 3 and bad.count() == 2
    empty = rejects.split_records(df.limit(0), rejects.BATTLE_FORMAT)
    assert empty[0].count() == 0 and empty[1].count() == 0


# --- orphans -----------------------------------------------------------------------------------------

@pytest.mark.parametrize("small, hot", [(0, 64), (0, 4000), (10_000, 64)])
def test_orphans_brute_force(spark, small, hot):
    rng = random.Random(3)
    life = lambda: (rng.choice([None, 0, *range(0, 10**9, 10**8)]), rng.choice([None, *range(10**8, 12 * 10**8, 10**8)]))
    parents = [(rng.choice([None, *range(40)]), *life()) for _ in range(150)] + [(7, 5, 6)] * 3 + [(7, a * 10**6, a * 10**6 + 5 * 10**5) for a in range(1, 1200)]
    kinds = [(rng.choice([None, "a", "b", "c"]), *life()) for _ in range(8)]
    refs = [(i, rng.choice([None, 7, 7, 7, *range(60)]), rng.choice([None, rng.randrange(12 * 10**8), 5, 6]), rng.choice([None, "a", "b", "zz"])) for i in range(3000)]
    p = spark.createDataFrame(parents, "key long, start long, end long").withColumn("id", F.lit("clash"))
    q = spark.createDataFrame(kinds, "kind string, start long, end long").withColumn("f", F.lit("clash"))
    r = spark.createDataFrame(refs, "row_id long, key long, at long, kind string").withColumn("start", F.lit("clash")).withColumn("n", F.lit(1))
    links = [orphans.Link("key", F.col("key"), p, F.col("key"), "start", "end"), orphans.Link("kind", F.col("kind"), q, F.col("kind"), "start", "end")]
    got = sorted(tuple(x) for x in orphans.orphans(r, "row_id", "at", links, small=small, hot=hot, chunks=5).collect())
    alive = lambda rows, k, t: any(a == k and s is not None and s <= t and (e is None or t < e) for a, s, e in rows)
    want = [(i, n) for i, k, t, x in refs for n, v, rows in (("key", k, parents), ("kind", x, kinds)) if v is not None and (t is None or not alive(rows, v, t))]
    assert got == sorted(want)


def test_orphans_empty(spark):
    p = spark.createDataFrame([], "key long, start long, end long")
    r = spark.createDataFrame([(1, 5, 9), (2, None, 9)], "row_id long, key long, at long")
    f = lambda a, b, small: sorted(x[0] for x in orphans.orphans(a, "row_id", "at", [orphans.Link("key", F.col("key"), b, F.col("key"), "start", "end")], small=small).collect())
    for small in (-1, 10):
        assert f(r, p, small) == [1] and f(r.limit(0), p, small) == []


def test_bloom_has_no_false_negative(spark):
    keys = spark.range(3000).select((F.col("id") * 17).alias("k"))
    other = spark.range(3000).select((F.col("id") * 17 + 3).alias("k"))
    # 2.7 bits a key, as 100 million keys have at the largest size: most orphans are still proven.
    for most, positive in ((1 << 28, 0.05), (1 << 13, 0.4)):
        bits, hashes = orphans.bloom_size(3000, most_bits=most)
        w = orphans.bloom_words(keys, bits, hashes)
        assert keys.where(~orphans.might_contain(w, F.col("k"), bits, hashes)).count() == 0
        assert other.where(orphans.might_contain(w, F.col("k"), bits, hashes)).count() < positive * 3000
    assert orphans.bloom_size(10**8) == (1 << 28, 2)


# --- features ----------------------------------------------------------------------------------------

def test_features(spark):
    rows = [(1, "a", 10, 5, True), (1, "a", 30, None, None), (1, "b", 20, 1, False), (2, None, 5, 1, True), (None, "a", 5, 1, True), (3, "zz", 1, 1, True), (1, "a", 30, 2, True)]
    df = spark.createDataFrame(rows, "user long, kind string, at long, score long, flag boolean").withColumn("battles", F.lit("clash"))
    long = features.feature_long(df.drop("battles"), "user", "kind", "at", {"score": F.col("score"), "quit": F.col("flag").cast("long")}, 100)
    wide = features.feature_table(long, "user", "kind", ["a", "b"], ["battles", "since", "score", "quit"])
    got = {r["user"]: r.asDict() for r in wide.collect()}
    assert set(got) == {1, 2, 3}
    assert got[1] == {"user": 1, "a_battles": 3, "a_since": 70, "a_score": 7, "a_quit": 2, "b_battles": 1, "b_since": 80, "b_score": 1, "b_quit": 0}
    assert got[2]["a_battles"] == 0 and got[2]["a_since"] is None and got[3]["b_score"] == 0
    assert features.feature_table(long.limit(0), "user", "kind", ["a"], ["battles"]).count() == 0
    with pytest.raises(ValueError):
        features.feature_table(long, "user", "kind", ["a", "a"], ["battles"])


def test_many_kinds(spark):
    """Lists beyond what one table can have as columns: tables by range of kinds, or one map column."""
    rows = [(u, f"k{i}", i) for u in range(4) for i in range(u, 30, u + 1)] + [(9, None, 1), (None, "k1", 1)]
    long = spark.createDataFrame(rows, "user long, kind string, battles long").withColumn("since", F.col("battles") + 1)
    kinds = [f"k{i}" for i in range(30)]
    whole = features.feature_table(long, "user", "kind", kinds, ["battles", "since"]).toPandas().set_index("user").sort_index()
    parts = [t.toPandas().set_index("user").sort_index() for t in features.feature_tables(long, "user", "kind", kinds, ["battles", "since"], most=14)]
    assert len(parts) == 5 and all(len(p) == 5 and len(p.columns) <= 14 for p in parts)
    joined = parts[0].join(parts[1:])
    assert list(joined.columns) == list(whole.columns) and joined.equals(whole)
    maps = {r.user: r.features for r in features.feature_maps(long, "user", "kind", ["battles", "since"]).collect()}
    assert set(maps) == {0, 1, 2, 3, 9} and maps[9] == {} and all(maps[u][k].battles == whole.loc[u, f"{k}_battles"] for u in range(4) for k in maps[u]) and len(maps[0]) == 30
    assert features.feature_maps(long.limit(0), "user", "kind", ["battles"]).count() == 0


def test_features_match_the_long_form(spark, sf):
    from tidemark.plans import data_quality as q

    kinds = q.mission_list(spark, sf)
    wide = q.p4_features(spark, sf).toPandas().set_index("user_id")
    long = q.p4_features_long(spark, sf).toPandas()
    assert len(wide.columns) == 5 * len(kinds)
    for m in q.METRICS:
        w = wide[[f"{k}_{m}" for k in kinds]].to_numpy()
        assert float(sum(x for x in w.ravel() if x == x and x is not None)) == float(long[m].sum())
    for r in long.sample(200, random_state=1).itertuples():
        assert wide.loc[r.user_id, f"{r.mission}_since"] == r.since and wide.loc[r.user_id, f"{r.mission}_battles"] == r.battles


def test_last_seat_wins(spark):
    rows = [(1, 5, 9, 1, 1, 10, True, None, None, "2020-01-01"), (2, 5, 9, 1, 1, 20, False, None, None, "2020-01-02"), (3, 5, 9, 1, 1, 30, None, None, None, "2020-01-02"), (4, None, 9, 1, 1, 1, None, None, None, None)]
    df = spark.createDataFrame(rows, "row_id long, user_id long, session_id long, commit_time long, team int, battle_score long, victories boolean, early_quit boolean, team_score_top_20_percent boolean, ingest_time string")
    assert [r["battle_score"] for r in last_seats(df, ["battle_score"]).collect()] == [30]


# --- spikes ------------------------------------------------------------------------------------------

def catch_table(spark, rows):
    return spark.createDataFrame(rows, "catch_id long, name string, ts timestamp_ntz, mass long, long long, exp_sum long")


def test_spikes(spark):
    import datetime as dt

    rng, t0, rows = random.Random(1), dt.datetime(2013, 1, 1), []
    for i in range(600):
        long = int(200 + rng.random() * 500)
        mass = max(1, int(1e-5 * long**3 * rng.uniform(0.8, 1.25)))
        rows.append([i, rng.choice(["Perch", " perch ", "PERCH"]), t0 + dt.timedelta(minutes=37 * i), mass, long, max(1, int(9 * mass**0.75 * rng.uniform(0.7, 1.5)))])
    want = set()

    def put(i, col, v):
        rows[i][{"mass": 3, "long": 4, "exp_sum": 5}[col]] = v
        want.add((i, col))

    put(10, "mass", 0), put(11, "long", -4), put(12, "exp_sum", 0)
    put(50, "mass", rows[50][3] * 6), put(60, "mass", max(1, rows[60][3] // 8)), put(70, "long", rows[70][4] * 5), put(80, "exp_sum", rows[80][5] * 7), put(90, "exp_sum", max(1, rows[90][5] // 9))
    value = rows[200][4]
    for i in range(200, 206):  # exactly six equal values, across a day's border
        put(i, "long", value)
    for i in range(300, 305):  # five are not enough
        rows[i][4] = rows[300][4]
        rows[i][3] = int(1e-5 * rows[300][4] ** 3) + i - 300
        rows[i][5] = int(9 * rows[i][3] ** 0.75) + i - 300
    rows += [list(rows[50]), [900, None, t0, 0, 0, 0], [901, "lonely", t0, 5, 5, None], [902, "lonely", t0, None, None, None], [903, "lonely", t0, 0, 3, 3]]
    want.add((903, "mass"))
    df = catch_table(spark, [tuple(r) for r in rows]).withColumn("src", F.lit("clash")).withColumn("field", F.lit(1)).withColumn("id", F.lit(None))
    got = {(r[0], r[1]) for r in spikes.implausible(df, "catch_id", "name", "ts", ("long", "mass", "exp_sum")).collect()}
    assert got == want
    assert spikes.implausible(df.limit(0), "catch_id", "name", "ts", ("long", "mass", "exp_sum")).count() == 0


def test_stuck_runs_brute_force(spark):
    import datetime as dt

    rng, rows = random.Random(2), []
    for i in range(3000):
        rows.append((i, rng.choice("ab"), dt.datetime(2013, 1, 1) + dt.timedelta(minutes=rng.randrange(60 * 24 * 9)), *(rng.choice([1, 1, 1, 1, 1, 2, None]) for _ in range(3))))
    for i in range(40):  # frozen for days, with a day of nulls between
        rows.append((5000 + i, "cold", dt.datetime(2013, 1, 1) + dt.timedelta(hours=7 * i), None if 10 <= i < 15 else 7, 3 if i else 4, i))
    df = spark.createDataFrame(rows, "id long, src string, at timestamp_ntz, x0 long, x1 long, x2 long")
    got = {r.id: (r.n0, r.n1, r.n2) for r in spikes.run_lengths(df.withColumn("extra", F.lit(1))).collect()}
    assert len(got) == len(rows)
    for f in range(3):
        for src in ("a", "b", "cold"):
            mine = [r for r in sorted((x for x in rows if x[1] == src), key=lambda x: (x[2], x[0]))]
            assert all(got[r[0]][f] == 0 for r in mine if r[3 + f] is None)
            run = []
            for r in [*(x for x in mine if x[3 + f] is not None), None]:
                if run and (r is None or r[3 + f] != run[-1][3 + f]):
                    assert {got[x[0]][f] for x in run} == {len(run)}
                    run = []
                run.append(r)
    assert spikes.run_lengths(df.limit(0)).count() == 0


def test_tail_of_known_shape():
    import numpy as np

    rng = np.random.default_rng(0)
    x = rng.exponential(1.0, 200_000)
    u, rate, half, shape, n = spikes.tail_fit(x, np.ones(len(x)), 0.8, 1e-4)
    assert abs(shape) < 0.1 and abs(spikes.tail_level(u, rate, half, shape, 1e-4) - np.log(1e4)) < 0.8
    flat = rng.uniform(0, 1, 50_000)  # a bounded tail stays inside its bound
    wild = np.r_[flat, rng.uniform(3, 9, 600)]  # and wild readings do not stretch it
    for v in (flat, wild):
        assert 0.97 < spikes.tail_level(*spikes.tail_fit(v, np.ones(len(v)), 0.8, 1e-4)[:4], 1e-4) < 1.1
    assert spikes.tail_fit(np.zeros(0), np.zeros(0), 0.8, 1e-4)[4] == 0 and spikes.tail_fit(np.ones(9), np.ones(9), 0.8, 1e-4)[4] == 0


def test_cutoffs_follow_the_source(spark):
    """The fit alone sets the cutoff: a source that scatters more gets a wider one, and what lies beyond is a spike at any factor."""
    import datetime as dt

    import numpy as np

    rng, t0, rows = np.random.default_rng(3), dt.datetime(2013, 1, 1), []
    for s, (name, sigma) in enumerate((("calm", 0.05), ("rough", 0.3))):
        for i in range(4000):
            long = int(300 + 500 * rng.random())
            mass = 1e-5 * long**3 * np.exp(rng.normal(0, sigma))
            rows.append((s * 10_000 + i, name, t0 + dt.timedelta(minutes=7 * i), int(mass), long, int(9 * mass**0.75)))
    for s in (0, 10_000):
        r = rows[s // 10_000 * 4000 + 100]
        expect = 1e-5 * r[4] ** 3
        rows.append((s + 9000, r[1], t0, int(expect * 1.8), r[4], int(9 * expect**0.75)))
    df = spark.createDataFrame(rows, "catch_id long, name string, ts timestamp_ntz, mass long, long long, exp_sum long")
    clean = spikes.clean_readings(df, "catch_id", "name", "ts", ("long", "mass", "exp_sum"))
    cut = {r.src: np.exp(r.cut1) for r in spikes.source_curves(clean, spikes.SpikeRules()).collect()}
    assert 1.15 < cut["calm"] < 1.4 and 2.2 < cut["rough"] < 5
    caught = {(r.id, r.field) for r in spikes.judged(clean, names=("long", "mass", "exp_sum")).where("rule = 'spike'").collect()}
    assert (9000, "mass") in caught and (19_000, "mass") not in caught
    assert (9000, "mass") not in {tuple(r) for r in spikes.implausible(df, "catch_id", "name", "ts", ("long", "mass", "exp_sum")).collect()}
