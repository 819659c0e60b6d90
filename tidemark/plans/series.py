"""Time-series queries with their SQL counterparts."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from tidemark.operators import series as S
from tidemark.session import table

QUERIES, ORACLE = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f
    return add


HOURS = "with h as (select user_id id, hour(ts)::bigint x, sum(value) y from events where user_id is not null group by 1, 2)"
FILLED = HOURS + ", g as (select id, x, coalesce(y, 0) y from (select distinct id from h) cross join (select unnest(range(24)) x) left join h using (id, x))"


def _hours(s, d):
    e = table(s, d, "events").where("user_id is not null")
    return e.groupBy(F.col("user_id").alias("id"), F.hour("ts").cast("long").alias("x")).agg(F.sum("value").alias("y"))


def _filled(s, d):
    return S.fill(_hours(s, d), 24)


def _vectors(s, d):
    return table(s, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").cast("array<double>").alias("v"), "label")


#: Fixed centroids of the assignment queries: 8 waves of different speed over 64 places.
def _centroids(n: int = 8, size: int = 64) -> np.ndarray:
    return np.array([[((i * 7 + j * (i + 1)) % 11 - 5) / 40 for j in range(size)] for i in range(n)])


CENTROID_SQL = "c as (select i cluster, list_transform(range(64), lambda j: ((i * 7 + j * (i + 1)) % 11 - 5) / 40) c from (select unnest(range(8)) i))"
ASSIGN_SQL = "with " + CENTROID_SQL + """, e as (select vec_id id, embedding::double[] v from embeddings),
d as (select id, cluster, sqrt(list_sum(list_transform(range(1, 65), lambda j: (v[j] - c[j]) * (v[j] - c[j])))) dist from e cross join c),
a as (select id, arg_min(cluster, row(dist, cluster)) cluster, min(dist) distance from d group by 1)
"""
EUCLID = S.ClusterConfig(metric="Euclidean")


def _assigned(s, d):
    return S.assign(_vectors(s, d), _centroids(), EUCLID)


@query(FILLED + " select id, x, round(y, 4) y from g")
def series_gapfill(s, d):
    return _filled(s, d).select("id", F.posexplode("v").alias("x", "y")).select("id", F.col("x").cast("long").alias("x"), F.round("y", 4).alias("y"))


@query(FILLED + ", r as (select id, sqrt(avg(y * y)) q from g group by 1) select id, x, round(case when q > 0 then 2 * y / (3 * q) end, 4) y from g join r using (id)")
def series_normalise(s, d):
    return _filled(s, d).select("id", F.posexplode(S.normalise(F.col("v"))).alias("x", "y")).select("id", F.col("x").cast("long").alias("x"), F.round("y", 4).alias("y"))


@query(HOURS + " select x id, id x, round(y, 4) y from h")
def series_transpose(s, d):
    return S.transpose(_hours(s, d)).withColumn("y", F.round("y", 4))


@query("""select a.vec_id id1, b.vec_id id2, round(sqrt(list_sum(list_transform(range(1, 65), lambda j: (a.embedding[j]::double - b.embedding[j]::double) * (a.embedding[j]::double - b.embedding[j]::double)))), 4) distance
from embeddings a join embeddings b on a.vec_id % 50 = 0""")
def euclid_dense(s, d):
    v = _vectors(s, d)
    return S.against_all(v, v.where("id % 50 = 0")).select("id1", "id2", F.round(S.euclid(F.col("a"), F.col("b")), 4).alias("distance"))


@query(HOURS + " select a.id id1, b.id id2, round(sqrt(sum((a.y - b.y) * (a.y - b.y))), 3) distance from h a join h b on a.id % 50 = 0 and a.x = b.x group by 1, 2")
def euclid_sparse(s, d):
    h = S.spread(S.pack(_hours(s, d)))
    return S.euclid_sparse(h, h.where("id % 50 = 0")).withColumn("distance", F.round("distance", 3))


def _normalised(s, d):
    """Normalised hourly series; one of zeros only has no normal form (null places), and no distance."""
    return _filled(s, d).select("id", S.normalise(F.col("v")).alias("v"))


def _dtw_sql(window: int | None, asked: str = "true") -> str:
    """Cost table row by row, each row place by place, as nested folds over lists."""
    inside = "true" if window is None else f"j >= i - {window} and j < i + {window}"
    cell = f"case when {inside} then (a[i + 1] - b[j + 1]) * (a[i + 1] - b[j + 1]) + case when i = 0 and j = 0 then 0 else least(prev[j + 1], case when j > 0 then prev[j] else 'inf'::double end, case when j > 0 then acc[j] else 'inf'::double end) end else 'inf'::double end"
    row = f"list_reduce(range(24), lambda acc, j: acc || [{cell}], []::double[])"
    return FILLED + f""", r as (select id, sqrt(avg(y * y)) q from g group by 1), v as (select id, list(case when q > 0 then 2 * y / (3 * q) end order by x) v, q from g join r using (id) group by id, q),
p as (select a.id id1, a.v a, b.id id2, b.v b, a.q > 0 and b.q > 0 ok from v a join v b on {asked})
select id1, id2, case when ok then round(sqrt((list_reduce(range(24), lambda prev, i: {row}, list_transform(range(24), lambda k: 'inf'::double)))[24]), 4) end distance from p"""


@query(_dtw_sql(None, "a.id % 50 = 0"))
def dtw_full(s, d):
    v = S.spread(_normalised(s, d))
    return S.dtw_search(v, v.where("id % 50 = 0")).withColumn("distance", F.round("distance", 4))


@query(_dtw_sql(3))
def dtw_banded(s, d):
    """Every series against every series."""
    v = S.spread(_normalised(s, d))
    return S.dtw_search(v, v, 3, digits=4)


@query(ASSIGN_SQL + "select id, cluster::int cluster, round(distance, 4) distance from a")
def kmeans_assign(s, d):
    return _assigned(s, d).select("id", "cluster", F.round("distance", 4).alias("distance"))


@query(ASSIGN_SQL + ", x as (select cluster, unnest(v) y, generate_subscripts(v, 1) - 1 x from a join e using (id)) select cluster::int cluster, x::int x, round(avg(y), 5) mean, count(*) n from x group by 1, 2")
def kmeans_update(s, d):
    return S.means(_assigned(s, d)).withColumn("mean", F.round("mean", 5))


@query(ASSIGN_SQL + "select id, round(distance, 4) weight from a")
def kmeans_seed_weights(s, d):
    return S.seed_weights(_vectors(s, d), _centroids(), EUCLID).withColumn("weight", F.round("weight", 4))


@query()
def dba_step(s, d):
    cfg = S.ClusterConfig(metric="DtwWindowed", window=3)
    v = _filled(s, d).select("id", S.normalise(F.col("v")).alias("v")).where(~F.exists("v", lambda x: x.isNull()))
    c = np.array([[1.0] * 24, [0.5] * 12 + [1.2] * 12])
    return S.barycenter_step(S.assign(v, c, cfg), c, cfg)


@query()
def temporal_clusters(s, d):
    cfg = S.ClusterConfig(metric="DtwWindowed", window=2, k_min=2, k_max=3, iterations=4, min_cluster=5, good_sigma=0.2, bad_sigma=0.9)
    v = _filled(s, d).select("id", S.normalise(F.col("v")).alias("v")).where(~F.exists("v", lambda x: x.isNull()))
    return S.temporal_clusters(v, cfg)


QUALITY = ", q as (select cluster, count(*) n, avg(distance) score, stddev_pop(distance) sigma from a group by 1)"


@query(ASSIGN_SQL + QUALITY + " select cluster::int cluster, n, round(score, 4) score, round(sigma, 4) sigma, case when sigma > 0.18 or n < 50 then 'Outline' when sigma < 0.05 then 'Good' else 'Reclust' end \"class\" from q")
def cluster_quality(s, d):
    return S.quality(_assigned(s, d), S.ClusterConfig()).withColumns({"score": F.round("score", 4), "sigma": F.round("sigma", 4)})


@query(ASSIGN_SQL + QUALITY + " select id, (case when abs(distance - score) > 3 * sigma then cluster + 66600 else cluster end)::int cluster, round(distance, 4) distance, round(abs(distance - score), 4) dev, abs(distance - score) > 3 * sigma outlier from a join q using (cluster)")
def sigma_outliers(s, d):
    a = _assigned(s, d)
    return S.sigma_outliers(a, S.quality(a, EUCLID)).withColumns({"distance": F.round("distance", 4), "dev": F.round("dev", 4)})


REVENUE = ASSIGN_SQL.replace("\n", " ") + """, m as (select id, label cluster from (select vec_id id, label from embeddings)),
p as (select c_custkey id, greatest(c_acctbal, 0) revenue, c_mktsegment = 'BUILDING' special from customer),
g as (select cluster, count(*) au, sum(coalesce(revenue, 0)) revenue, count(*) filter (where revenue > 0) pu, sum(case when special then revenue else 0 end) sr, count(*) filter (where special) sc from m left join p using (id) group by 1),
st as (select cluster, au, round(revenue, 2) revenue, pu, round(sr, 2) special_revenue, sc special_count, round(au / sum(au) over (), 5) au_rate, round(pu / au, 5) pu_rate, round(revenue / au, 3) arpu, round(case when pu > 0 then revenue / pu end, 3) arppu,
  round(sc / au, 5) special_rate, round(case when sc > 0 then sr / sc end, 3) special_arpu, round(case when au > sc then (revenue - sr) / (au - sc) end, 3) other_arpu, revenue / au raw_arpu, au / sum(au) over () raw_rate from g)
"""


def _revenue(s, d):
    m = table(s, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("label").alias("cluster"))
    p = table(s, d, "customer").select(F.col("c_custkey").alias("id"), F.greatest(F.col("c_acctbal"), F.lit(0.0)).alias("revenue"), (F.col("c_mktsegment") == "BUILDING").alias("special"))
    return S.cluster_revenue(m, p)


@query(REVENUE + "select * exclude (raw_arpu, raw_rate) from st")
def cluster_revenue(s, d):
    n = {"revenue": 2, "special_revenue": 2, "au_rate": 5, "pu_rate": 5, "special_rate": 5, "arpu": 3, "arppu": 3, "special_arpu": 3, "other_arpu": 3}
    return _revenue(s, d).withColumns({c: F.round(c, k) for c, k in n.items()})


@query(REVENUE + """, z as (select cluster, arpu, au_rate, coalesce(sum(raw_rate) over (order by floor(raw_arpu * 1000), cluster rows between unbounded preceding and 1 preceding), 0) lo,
  coalesce(sum(raw_rate) over (order by floor(raw_arpu * 1000) desc, cluster desc rows between unbounded preceding and 1 preceding), 0) hi from st)
select cluster, arpu, au_rate, case when lo <= 0.15 then 20 when hi <= 0.15 then 80 else 50 end grp from z""")
def share_groups(s, d):
    return S.share_groups(_revenue(s, d)).withColumns({"arpu": F.round("arpu", 3), "au_rate": F.round("au_rate", 5)})


@query(ASSIGN_SQL + """, m as (select cluster, x, avg(y) y from (select cluster, unnest(v) y, generate_subscripts(v, 1) x from a join e using (id)) group by 1, 2),
n as (select p.cluster, q.cluster peer, sqrt(sum((p.y - q.y) * (p.y - q.y))) dist from m p join m q on p.x = q.x and p.cluster <> q.cluster group by 1, 2)
select cluster::int cluster, (arg_min(peer, row(dist, peer)))::int peer, round(min(dist), 4) distance from n group by 1""")
def nearest_peers(s, d):
    """The nearest other centroid of every cluster."""
    found = S.nearest_peers(S.collect_centroids(S.means(_assigned(s, d))), EUCLID)
    return s.createDataFrame(found, "cluster int, peer int, distance double").withColumn("distance", F.round("distance", 4))


@query("with recursive " + ASSIGN_SQL.removeprefix("with ") + """, m as (select cluster, x, avg(y) y from (select cluster, unnest(v) y, generate_subscripts(v, 1) x from a join e using (id)) group by 1, 2),
n as (select p.cluster, q.cluster peer, sqrt(sum((p.y - q.y) * (p.y - q.y))) dist from m p join m q on p.x = q.x and p.cluster <> q.cluster group by 1, 2),
r as (select 0::bigint i, []::bigint[] gone, []::bigint[] home union all
  select i + 1, case when o.d < 0.5 then gone || [i] else gone end, case when o.d < 0.5 then home || [o.p] else home end
  from r, lateral (select min(dist) d, arg_min(peer, row(dist, peer)) p from n where n.cluster = r.i and not list_contains(r.gone, n.peer)) o where i < 8)
select unnest(gone)::int cluster, unnest(home)::int merged_into from r where i = 8""")
def cluster_dups(s, d):
    """Near-equal centroids of the assignment and the peer they merge into."""
    gone = S.duplicates(S.collect_centroids(S.means(_assigned(s, d))), 0.5, EUCLID)
    return s.createDataFrame([(int(a), int(b)) for a, b in gone.items()], "cluster int, merged_into int")
