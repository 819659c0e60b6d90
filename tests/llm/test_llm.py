"""Ranking, distinct counts, leakage, mixing and splitting against brute force and on odd tables."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.llm import distinct, leakage, mixing, ranking, ranks, splitting, tokens
from tidemark.llm.words import words

SMALL = ranking.RankRules(iterations=40, block_seats=60, part_items=7)
TINY = ranking.RankRules(iterations=6, block_seats=5, part_items=4, steady=0.0)  # every contest is larger than a block


# --- ranking -----------------------------------------------------------------------------------------

def seat_rows(seed=1, sessions=60, users=25):
    rng, rows = random.Random(seed), []
    for s in range(sessions):
        who = rng.sample(range(users), 6)
        strong = sum(who[:3]) < sum(who[3:])
        for i, u in enumerate(who):
            rows.append((s, u, 1 + i // 3, (i < 3) == strong))
    return rows


def dense_sinkhorn(rows, users, alpha=1.0, iterations=40):
    a = np.zeros((users, users))
    for s in {r[0] for r in rows}:
        win = [r[1] for r in rows if r[0] == s and r[3]]
        lose = [r[1] for r in rows if r[0] == s and not r[3]]
        for i in win:
            for j in lose:
                a[i, j] += 1 / np.sqrt(len(win) * len(lose))
    a += alpha / users
    o, d = np.ones(users), np.ones(users)
    for _ in range(iterations):
        last, o = o, a @ (1 / d)
        d = a.T @ (1 / o)
        if np.abs(np.log(o / last)).max() < 1e-6:
            break
    s = o / d
    return s / np.exp(np.log(s).mean())


@pytest.mark.parametrize("rules", [ranking.RankRules(iterations=40), SMALL, TINY])
def test_ranking_brute_force(spark, rules):
    rows = seat_rows()
    df = spark.createDataFrame(rows, "session long, item long, team int, won boolean").withColumn("w", F.lit("clash")).withColumn("rank", F.lit(0))
    items = spark.createDataFrame([(i,) for i in [*range(25), 3, None]], "item long")
    got = ranking.rank_items(ranking.contests(df, "session", "item", "team", "won"), items, rules).orderBy("item").toPandas()
    want = dense_sinkhorn(rows, 25, iterations=rules.iterations)
    assert np.allclose(got.strength, want, rtol=1e-6)
    assert sorted(got["rank"]) == list(range(1, 26)) and list(got.sort_values("rank").item) == list(np.lexsort((np.arange(25), -want)))
    assert got.wins.sum() == got.losses.sum() == 180 and set(got.converged) == {rules.iterations == 40}


def test_contests(spark):
    rows = [(1, 1, 1, True), (1, 2, 2, False), (2, 1, 1, True), (2, 3, 1, True), (3, 1, 1, True), (3, 2, 2, True), (4, 4, 1, None), (4, 5, 2, True), (4, 6, 3, True), (None, 1, 1, True), (5, None, 1, True)]
    df = spark.createDataFrame(rows, "session long, item long, team int, won boolean")
    got = sorted((r.session, r.item, r.won) for r in ranking.contests(df, "session", "item", "team", "won").collect())
    assert got == [(1, 1, True), (1, 2, False), (4, 4, False), (4, 5, True)]  # one-sided, undecided and null sessions give nothing
    none = ranking.rank_items(ranking.contests(df.limit(0), "session", "item", "team", "won"), df.select("item").limit(0))
    assert none.count() == 0
    alone = ranking.rank_items(ranking.contests(df.limit(0), "session", "item", "team", "won"), df.select("item")).collect()
    assert len(alone) == 6 and all(r.strength == pytest.approx(1.0) for r in alone)


def test_ranking_mixes_large_and_small_contests(spark):
    rng, rows = random.Random(4), seat_rows(3, 30, 40)
    for i in range(40):  # one contest of all
        rows.append((900, i, 1 + i % 2, i % 2 == 0))
    got = ranking.rank_items(ranking.contests(spark.createDataFrame(rows, "session long, item long, team int, won boolean"), "session", "item", "team", "won"),
                             spark.range(43).withColumnRenamed("id", "item"), ranking.RankRules(iterations=4, block_seats=30, part_items=10, steady=0.0)).orderBy("item").toPandas()
    want = dense_sinkhorn(rows, 43, iterations=4)
    assert np.allclose(got.strength, want, rtol=1e-6) and not got.converged.any()
    assert got.wins.sum() == got.losses.sum() == 30 * 3 + 20 and list(got.wins[40:]) == [0, 0, 0]
    assert spark.conf.get("spark.sql.adaptive.enabled") == "true"  # the session's settings are put back


def test_number_rows(spark):
    df = spark.range(1000).select((F.col("id") * 37 % 101).alias("a"), "id")
    got = ranks.number_rows(df, ["a", "id"], "n").orderBy("n").collect()
    assert [r.n for r in got] == list(range(1, 1001)) and [(r.a, r.id) for r in got] == sorted((r.a, r.id) for r in got)


# --- distinct counts -----------------------------------------------------------------------------------

def test_distinct_within_bounds(spark):
    df = spark.range(60_000).select((F.col("id") % 20_011).alias("u"), (F.col("id") % 3).alias("day"), F.when(F.col("id") % 7 == 0, None).otherwise("f").alias("fac"))
    df = df.unionByName(df.limit(500)).withColumn("bucket", F.lit("clash"))
    got = distinct.group_counts(df, ("day", F.col("day")), ("fac", F.col("fac")), {"u": F.col("u")}).toPandas()
    assert set(got.level) == {"day", "fac", "day,fac"} and len(got) == 3 + 2 + 6
    exact = df.groupBy("day").agg(F.countDistinct("u").alias("n")).toPandas().set_index("day").n
    for r in got[got.level == "day"].itertuples():
        n = exact[r.day]
        assert abs(r.estimate - n) <= 3.5 * r.std_error and r.lower <= r.estimate <= r.upper and r.std_error < 0.03 * n
    tiny = spark.createDataFrame([(1, None, None), (1, None, 5), (1, None, 5)], "day long, fac string, u long")
    small = distinct.group_counts(tiny, ("day", F.col("day")), ("fac", F.col("fac")), {"u": F.col("u")})
    assert [r.estimate for r in small.collect()] == [1, 1, 1] and distinct.distinct_counts(tiny.limit(0), ("day", F.col("day")), ("fac", F.col("fac")), {"u": F.col("u")}).count() == 0


def test_counts_come_with_their_matrices(spark):
    """The rows of two days add up to the same figures as both days counted together."""
    df = spark.range(20_000).select((F.col("id") % 7001).alias("u"), F.pmod(F.hash("id"), F.lit(4)).alias("day"), F.when(F.col("id") % 5 > 0, "f").alias("fac"))
    count = lambda d: distinct.distinct_counts(d, ("day", F.col("day")), ("fac", F.col("fac")), {"u": F.col("u")})
    got = count(df)
    assert got.columns == ["level", "day", "fac", "field", "bucket", "bits", "estimate", "std_error", "lower", "upper"]
    group = ["level", "day", "fac", "field"]
    assert got.select(*group, "estimate").distinct().count() == got.select(*group).distinct().count() == 4 + 2 + 8 and got.select(*group, "bucket").distinct().count() == got.count()
    both = distinct.estimate(distinct.merge(got.where("level = 'day' and day < 2"), []), []).first()
    direct = distinct.group_counts(df.where("day < 2").withColumn("day", F.lit(0)), ("day", F.col("day")), ("fac", F.col("fac")), {"u": F.col("u")}).where("level = 'day'").first()
    assert (both.estimate, both.lower, both.upper) == (direct.estimate, direct.lower, direct.upper)
    assert count(df.limit(0)).count() == 0


def test_error_bound_holds_over_many_draws():
    rng, hit, rel = np.random.default_rng(0), 0, []
    for n in [50, 500, 5_000, 200_000] * 25:
        bucket, rank = rng.integers(0, 2048, n), rng.geometric(0.5, n) - 1
        m = np.zeros((2048, distinct.RANKS + 1), bool)
        m[bucket, np.minimum(rank, distinct.RANKS)] = True
        est, se = distinct.likeliest(m.sum(0)[None].astype(float), 2048)
        hit += abs(est[0] - n) <= 2.576 * se[0] + 0.5
        rel.append(abs(est[0] / n - 1))
    assert hit >= 95 and max(rel) < 0.08


def test_sketches_merge(spark):
    df = spark.range(9000).select((F.col("id") % 4000).alias("u"), (F.col("id") % 5).alias("day"))
    parts = distinct.sketch_rows(df, {"day": F.col("day")}, {"u": F.col("u")})
    whole = distinct.sketch_rows(df, {}, {"u": F.col("u")})
    f = lambda x: sorted((r.field, r.bucket, r.bits) for r in x.collect())
    assert f(distinct.merge(parts, [])) == f(whole)


# --- leakage --------------------------------------------------------------------------------------------

def naive(doc, item, stretch=20, per=6):
    """Is there an item stretch of at least 20 words within its edits of some document stretch? All pairs, exact."""
    n, m = len(item), len(doc)
    for a in range(n - stretch + 1):
        row = [0] * (m + 1)  # edits of item[a:b] against the best document stretch that ends at j
        for b in range(a + 1, n + 1):
            nxt = [b - a]
            for j in range(1, m + 1):
                nxt.append(min(row[j] + 1, nxt[j - 1] + 1, row[j - 1] + (doc[j - 1] != item[b - 1])))
            row = nxt
            if b - a >= stretch and min(row) <= (b - a) // per:
                return True
    return False


def corrupt(ws, edits, rng):
    ws = list(ws)
    for _ in range(min(edits, len(ws))):
        i = rng.randrange(max(1, len(ws)))
        k = rng.choice("sdi")
        ws[i : i + 1] = {"s": ["zzz"], "d": [], "i": ["qqq", *ws[i : i + 1]]}[k]
    return ws


def test_leaks_brute_force(spark):
    rng = random.Random(11)
    vocabulary = [f"w{i}" for i in range(60)]
    items = [(i, [rng.choice(vocabulary) for _ in range(rng.randrange(20, 45))]) for i in range(25)]
    docs = []
    for k in range(160):
        ws = items[rng.randrange(25)][1]
        a = rng.randrange(len(ws))
        b = min(len(ws), a + rng.randrange(10, 32))
        body = corrupt(ws[a:b], rng.randrange(6), rng)
        pad = lambda: [rng.choice(vocabulary) for _ in range(rng.randrange(25))]
        docs.append((k, " ".join(pad() + body + pad())))
    want = {(k, i) for k, t in docs for i, ws in items if naive([x.decode() for x in words(t)], ws)}
    idf = spark.createDataFrame([(i, " ".join(w)) for i, w in items], "item_id long, text string").withColumn("doc_id", F.lit("clash"))
    ddf = spark.createDataFrame([*docs, docs[0], (None, "x"), (900, None), (901, "")], "doc_id long, text string").withColumn("item_id", F.lit("clash"))
    for rules in (leakage.LeakRules(), leakage.LeakRules(block_words=200)):
        got = {(r.doc_id, r.item_id) for r in leakage.find_leaks(ddf, "doc_id", "text", idf, "item_id", "text", rules).collect()}
        assert got <= want and len(got & want) >= 0.98 * len(want) and len(want) > 25
    assert leakage.find_leaks(ddf.limit(0), "doc_id", "text", idf, "item_id", "text").count() == 0
    assert leakage.find_leaks(ddf, "doc_id", "text", idf.limit(0), "item_id", "text").count() == 0


PASSAGE = "The copper cohort hauled the private series around the convoy of lower lock while our float measured a duplicate trophy beside 58 rusty bridges at 9:15 and the Übersicht über Größen followed"
DISGUISES = {
    "plain": lambda t: t, "upper": str.upper, "lines": lambda t: t.replace(" ", "\n"), "crlf": lambda t: t.replace(" ", "\r\n> "), "dots": lambda t: t.replace(" ", " ... "),
    "html": lambda t: "<p>" + t.replace(" ", "&nbsp;").replace("copper", "<b>copper</b>").replace("o", "&#111;") + "</p>", "json": lambda t: '{"":"' + t.replace(" ", "\\n").replace("ü", "\\u00fc") + '"}',
    "wide": lambda t: "".join(chr(ord(c) + 0xFEE0) if "!" <= c <= "~" else c for c in t), "zero": lambda t: "​".join(t), "soft": lambda t: t.replace("o", "o­"), "marks": lambda t: "".join(c + "́" if c in "aeou" else c for c in t),
    "cyrillic": lambda t: t.translate(str.maketrans("aeopcx", "аеорсх")), "hyphen": lambda t: t.replace("private", "pri-\nvate").replace("duplicate", "dupli-\r\n> cate"), "md": lambda t: t.replace(" ", "** **"), "bom": lambda t: "﻿" + t.replace(" ", " "),
    "math": lambda t: "".join(chr(0x1D41A + ord(c) - 97) if "a" <= c <= "z" else c for c in t),
}


@pytest.mark.parametrize("name", sorted(DISGUISES))
def test_disguises(name):
    assert words(DISGUISES[name](PASSAGE)) == words(PASSAGE)


def test_long_text_and_threshold():
    rng = random.Random(2)
    item = [f"i{k}" for k in range(40)]
    index = leakage.Index([(7, [w.encode() for w in item])], leakage.LeakRules())
    noise = " ".join(f"n{rng.randrange(999)}" for _ in range(120_000))
    assert leakage.leaks(index, [noise + " " + " ".join(item[5:25]) + " " + noise]) == [(0, 7)]
    assert leakage.leaks(index, [" ".join(item[5:22])]) == [(0, 7)]  # 17 words are 20 with three left out
    assert leakage.leaks(index, [" ".join(item[5:21])]) == []  # 16 are not enough
    assert leakage.leaks(index, [" ".join(item[:10]), " ".join(item[10:20])]) == []  # two documents do not add up
    assert leakage.leaks(index, [" ".join(item[20:] + item[:20][::-1])]) == [(0, 7)]


def test_no_edited_stretch_is_lost_before_verification():
    """Bursts of L // 6 words left out, added or changed at every place of a stretch: promising() keeps what verify() accepts."""
    rules = leakage.LeakRules()
    for size in (24, 30, 31, 32, 33, 40):
        item, burst = [b"w%d" % i for i in range(size)], size // rules.per_edit
        index = leakage.Index([(1, item)], rules)
        q0 = rules.reach
        for kind in ("left out", "added", "changed"):
            for at in range(1, size - burst):
                own = np.r_[np.arange(at), np.arange(at if kind == "added" else at + burst, size)]
                gap = 0 if kind == "left out" else burst
                p = 100 + own + np.where(own >= at, {"left out": -burst, "added": burst, "changed": 0}[kind], 0)
                doc = np.full(300 + size + gap, leakage.DOC_PAD, np.int32)
                doc[100 : 100 + size + burst] = 0
                doc[p] = index.seq[q0 + own]
                good = leakage.verify(doc, index.seq, p, q0 + own, rules)
                kept = leakage.promising(doc, index.seq, p, q0 + own, rules)
                assert good.any() and kept[good].all(), (size, kind, at)


def test_recall_of_edited_stretches():
    rng, found, total = random.Random(3), 0, 0
    vocabulary = [f"v{k}" for k in range(900)]
    items = [(k, [rng.choice(vocabulary).encode() for _ in range(60)]) for k in range(100)]
    index = leakage.Index(items, leakage.LeakRules())
    for k, ws in items:
        for _ in range(3):
            a = rng.randrange(40)
            body = ws[a : a + 20]
            for i in rng.sample(range(20), 3):
                body[i] = b"zzz"
            text = b" ".join([b"x"] * 30 + body + [b"y"] * 30).decode()
            total += 1
            found += (0, k) in leakage.leaks(index, [text])
    assert found >= 0.97 * total


# --- mixing -----------------------------------------------------------------------------------------------

def sized(spark):
    rng = random.Random(1)
    rows = [(i, s, rng.randrange(1, 400)) for i, s in enumerate(["big"] * 700 + ["mid"] * 200 + ["tiny"] * 12 + ["other"] * 30)]
    return spark.createDataFrame(rows, "doc_id long, source string, tokens long").withColumn("copy", F.lit("clash"))


def test_mixture(spark):
    t = spark.createDataFrame([("big", 0.5, 1), ("mid", 0.3, 2), ("tiny", 0.2, 4), ("absent", 0.0, 3)], "source string, target_share double, max_repeats int").withColumn("tokens", F.lit(1))
    m, s = mixing.mix(sized(spark), t)
    rows = m.orderBy("position").toPandas()
    assert list(rows.position) == list(range(1, len(rows) + 1)) and rows.time.is_monotonic_increasing and not rows.duplicated(["doc_id", "copy"]).any()
    share = {r.source: r for r in s.collect()}
    for k, w in {"big": 0.5, "mid": 0.3, "tiny": 0.2}.items():
        assert abs(share[k].share - w) < 400 / rows.tokens.sum() + 0.01 and share[k].most_repeats <= share[k].max_repeats
    assert "other" not in set(rows.source)
    # The curriculum: each source's tokens up to time t follow its integrated schedule.
    plan = {p["source"]: p for p in mixing.plan_mix([(r.source, r.available_tokens) for r in s.collect()], [(r.source, r.target_share, r.max_repeats) for r in s.collect()], mixing.MixRules())}
    for k in ("big", "mid"):
        half = rows[(rows.source == k) & (rows.time <= 0.5)].tokens.sum()
        assert half == pytest.approx(plan[k]["want"] * (0.5 - plan[k]["tilt"] / 4), rel=0.03)
    for t_ in (0.0, 0.3, 1.0):
        assert sum(p["share"] * (1 + p["tilt"] * (2 * t_ - 1)) for p in plan.values()) == pytest.approx(1.0)


def test_mixture_caps_and_edges(spark):
    t = spark.createDataFrame([("big", 0.5, 1), ("tiny", 0.5, 2), ("none", 0.1, 2)], "source string, target_share double, max_repeats int")
    s = {r.source: r for r in mixing.mix(sized(spark), t, mixing.MixRules(budget=50_000))[1].collect()}
    assert s["tiny"].most_repeats == 2 and s["tiny"].tokens == 2 * s["tiny"].available_tokens and s["none"].share == 0
    empty = mixing.mix(sized(spark).limit(0), t)
    assert empty[0].count() == 0 and empty[1].count() == 3
    docs = spark.createDataFrame([(1, "hello world", " Big "), (2, None, "big"), (3, "", "big"), (None, "x", "big"), (4, "x", None), (5, "a b", "ti-ny")], "doc_id long, text string, source string")
    assert sorted((r.doc_id, r.source) for r in mixing.sizes(docs, "doc_id", "text", "source").collect()) == [(1, "big"), (5, "ti_ny")]


def test_default_budget_with_absent_sources(spark):
    cols = "source string, target_share double, max_repeats int"
    live = [("big", 0.5, 1), ("tiny", 0.3, 2)]
    t = spark.createDataFrame([*live, ("none", 0.2, 2)], cols)
    s = {r.source: r for r in mixing.mix(sized(spark), t)[1].collect()}
    assert s["none"].share == 0 and s["none"].tokens == 0 and s["big"].tokens > 0 and s["tiny"].tokens == 2 * s["tiny"].available_tokens
    for repeats in (0, None):
        plan = {p["source"]: p for p in mixing.plan_mix([("big", 900), ("tiny", 30)], [("big", 0.5, 1), ("tiny", 0.5, repeats)], mixing.MixRules())}
        assert plan["big"]["want"] == 900 and plan["tiny"]["want"] == 0 and plan["tiny"]["passes"] == 0


# --- tokens and splitting -----------------------------------------------------------------------------------

def test_encode_in_parts():
    text = "the ferry rescued 12 boats. " * 9000
    assert tokens.encode(text) == tokens.encoding().encode_ordinary(text)


def naive_merge(grade, n, cap):
    """Agglomeration from single tokens, without atoms or heap."""
    cuts = list(range(1, n))
    dead = set()
    while True:
        edges = [0, *cuts, n]
        cand = [(grade[edges[i]], edges[i + 1] - edges[i - 1], edges[i - 1], edges[i]) for i in range(1, len(edges) - 1) if edges[i] not in dead]
        if not cand:
            return cuts
        g, size, _, c = min(cand)
        if size <= cap:
            cuts.remove(c)
        else:
            dead.add(c)


def test_agglomeration_equals_the_naive_one():
    """Also from atoms, as long as no run of forbidden boundaries (a character of several tokens) exceeds a piece."""
    rng = random.Random(9)
    for _ in range(1500):
        n, cap = rng.randrange(2, 70), rng.randrange(5, 20)
        grade = [0] + [rng.choice([-1, 0, 0, 1, 1, 1, 2, 3, 4, 5]) for _ in range(n)]
        for i in range(3, n + 1):
            if grade[i - 3 : i] == [-1] * 3:
                grade[i] = max(grade[i], 0)
        grade = np.array(grade)
        want = naive_merge(grade.tolist(), n, cap)
        assert splitting.agglomerate(list(range(1, n)), grade, n, cap) == want
        assert splitting.agglomerate(splitting.atoms(grade, n, cap), grade, n, cap) == want


def test_pieces_that_grow_alone_are_merged_anew():
    """Where a piece needs more tokens alone than inside the text, the same merging runs again with less room."""
    text = "".join(random.Random(5).choice(["ab", "é", "字", " ", "👍", "x1", "\n"]) for _ in range(4000))
    for limit, overlap in ((16, 3), (24, 0), (40, 12)):
        pieces = splitting.split_text(text, splitting.SplitRules(limit, overlap))
        assert all(p[3] <= limit for p in pieces) and "".join(text[p[1] : p[2]] for p in pieces) == text


def test_recall_of_repetitions():
    r = leakage.recall_of(leakage.LeakRules(), trials=500)
    assert (np.diff(r) >= 0).all() and r[0] > 0.6 and r[-1] > 0.998
    need = leakage.repetitions_for(leakage.LeakRules(target_recall=0.9))
    assert need <= leakage.repetitions_for(leakage.LeakRules()) <= 16 and leakage.recall_of(leakage.LeakRules(repetitions=0, target_recall=0.9))[need - 1] >= 0.9
    assert leakage.repetitions_for(leakage.LeakRules(repetitions=3)) == 3


TEXTS = [
    "word " * 3000, "A sentence here. Another one, with a clause; and more! " * 200, "абв где. " * 900, "没有空格的文本。" * 500, "x" * 9000, "line\r\n" * 1500, "\n\n".join(["para " * 40] * 40),
    "👨‍👩‍👧" * 700, " " * 5000, "\x00\x07​" * 1500, "a\n\n\n b.\f" * 800, "short", "", None,
]


@pytest.mark.parametrize("limit,overlap", [(128, 16), (64, 0), (512, 64)])
def test_pieces(spark, limit, overlap):
    df = spark.createDataFrame(list(enumerate(TEXTS)) + [(0, TEXTS[0])], "k long, t string").withColumn("doc_id", F.lit("clash")).withColumn("piece", F.lit(1))
    rules = splitting.SplitRules(limit, overlap)
    got = splitting.split_documents(df.where("t is null or k > 0 or true").dropDuplicates(["k"]), "k", "t", rules).toPandas()
    for k, t in enumerate(TEXTS):
        g = got[got.doc_id == k].sort_values("piece")
        if not t or len(tokens.encode(t)) <= limit:
            assert g.empty
            continue
        assert list(g.piece) == list(range(1, len(g) + 1)) and (g.pieces == len(g)).all() and (g.tokens <= limit).all()
        assert "".join(t[a:b] for a, b in zip(g.own_start_char, g.end_char)) == t
        assert all(t[r.start_char : r.end_char] == r.text for r in g.itertuples())
        assert g.start_char.iloc[0] == 0 and (overlap == 0 or (g.start_char.iloc[1:] < g.own_start_char.iloc[1:]).all() or k in (7, 9))
    s = got[got.doc_id == 1].sort_values("piece")
    assert (s.boundary.iloc[:-1] == "sentence").all()
    assert splitting.split_documents(df.limit(0), "k", "t", rules).count() == 0


def test_split_rules():
    with pytest.raises(ValueError):
        splitting.SplitRules(10, 9)
