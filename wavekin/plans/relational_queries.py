"""Queries of the evaluation operators over measurements derived from ``events`` and the star schema."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators import learning as L
from ..operators import relational as R
from .fixtures import r6, r6_sql, table

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


M = "m AS (SELECT event_id AS run, event_type AS dataset, 'm' || CAST(user_id % 4 AS VARCHAR) AS method, CAST([9, 18, 36][event_id % 3 + 1] AS INTEGER) AS cores, round(value, 3) AS query_time, round(abs(value) + 1, 3) AS distance, round((abs(value) + 1) * (1 + event_id % 5), 3) AS approx FROM events)"


def metrics(spark, d) -> DataFrame:
    e = table(spark, d, "events")
    return e.select(
        F.col("event_id").alias("run"), F.col("event_type").alias("dataset"), F.concat(F.lit("m"), (F.col("user_id") % 4).cast("string")).alias("method"),
        F.array(F.lit(9), F.lit(18), F.lit(36))[(F.col("event_id") % 3).cast("int")].alias("cores"), F.round("value", 3).alias("query_time"),
        F.round(F.abs("value") + 1, 3).alias("distance"), F.round((F.abs("value") + 1) * (1 + F.col("event_id") % 5), 3).alias("approx"),
    )


MEANS = f"{M}, g AS (SELECT dataset, method, avg(query_time) AS t FROM m GROUP BY ALL)"


def means(spark, d) -> DataFrame:
    return metrics(spark, d).groupBy("dataset", "method").agg(F.avg("query_time").alias("t"))


def _logs(spark, d) -> DataFrame:
    from ..sources.matrix import shared_folder

    folder = f"{shared_folder(spark)}/logs-{uuid.uuid4().hex}"
    m = metrics(spark, d)
    for variant in ("m0", "m1", "m2", "m3"):
        m.where(F.col("method") == variant).select("run", "query_time").write.option("header", True).csv(f"{folder}/ASTRO/36/{variant}")
    return R.read_logs(spark, folder, "run long, query_time double")


@query(f"WITH {M} SELECT run, {r6_sql('query_time')} AS query_time FROM m")
def rel_csv_scan(spark, d):
    return _logs(spark, d).select("run", r6(F.col("query_time")).alias("query_time"))


@query(f"WITH {M} SELECT '36' AS dataset, count(*) AS n FROM m")
def rel_path_columns(spark, d):
    return _logs(spark, d).groupBy("dataset").agg(F.count("*").alias("n"))


@query(f"WITH {M} SELECT run, method FROM (SELECT *, row_number() OVER (PARTITION BY method ORDER BY run DESC) AS n FROM m) WHERE n > 1")
def rel_drop_last(spark, d):
    return R.drop_last(metrics(spark, d), ["method"], "run").select("run", "method")


@query(f"WITH {M} SELECT run, {r6_sql('query_time / 1000')} AS seconds, 'ours' AS engine FROM m")
def rel_derived(spark, d):
    return metrics(spark, d).select("run", r6(F.col("query_time") / 1000).alias("seconds"), F.lit("ours").alias("engine"))


@query(f"WITH {M} SELECT run AS id, dataset AS data FROM m")
def rel_rename(spark, d):
    return metrics(spark, d).select("run", "dataset").withColumnsRenamed({"run": "id", "dataset": "data"})


@query(f"WITH {M} SELECT run, CASE method WHEN 'm0' THEN 'tree' WHEN 'm1' THEN 'scan' ELSE method END AS method, regexp_replace(dataset, '[aeiou]', '_', 'g') AS short FROM m")
def rel_map_values(spark, d):
    return metrics(spark, d).replace({"m0": "tree", "m1": "scan"}, subset=["method"]).select("run", "method", F.regexp_replace("dataset", "[aeiou]", "_").alias("short"))


@query(f"WITH {M} SELECT run FROM m WHERE method IN ('m0', 'm2') AND cores >= 18 AND query_time > 10")
def rel_filter(spark, d):
    return metrics(spark, d).where(F.col("method").isin("m0", "m2") & (F.col("cores") >= 18) & (F.col("query_time") > 10)).select("run")


@query(f"WITH {M} SELECT run, dataset, CAST(NULL AS VARCHAR) AS method FROM m WHERE cores = 9 UNION ALL SELECT run, NULL, method FROM m WHERE cores = 36")
def rel_union(spark, d):
    m = metrics(spark, d)
    return m.where("cores = 9").select("run", "dataset").unionByName(m.where("cores = 36").select("run", "method"), allowMissingColumns=True)


@query(f"WITH {M} SELECT dataset, method, {r6_sql('avg(query_time)')} AS mean, {r6_sql('sum(query_time)')} AS total, min(query_time) AS low, max(query_time) AS high, {r6_sql('median(query_time)')} AS mid FROM m GROUP BY ALL")
def rel_group(spark, d):
    t = F.col("query_time")
    m, seg = metrics(spark, d), F.struct("dataset", "method").alias("seg")
    got = m.groupBy(seg).agg(r6(F.avg(t)).alias("mean"), r6(F.sum(t)).alias("total"), F.min(t).alias("low"), F.max(t).alias("high"))
    return got.join(L.percentiles(m.select(seg, t.alias("x")), {"mid": 0.5}), "seg").select("seg.dataset", "seg.method", "mean", "total", "low", "high", r6(F.col("mid")).alias("mid"))


@query(f"WITH {M}, g AS (SELECT dataset, cores, avg(distance) AS t FROM m GROUP BY ALL), f AS (SELECT *, first_value(t) OVER (PARTITION BY dataset ORDER BY cores) AS t0 FROM g) SELECT dataset, cores, {r6_sql('t / t0')} AS ratio, {r6_sql('t0 / t')} AS speedup FROM f")
def rel_normalise_by_first(spark, d):
    g = metrics(spark, d).groupBy("dataset", "cores").agg(F.avg("distance").alias("t"))
    return R.relative_to_first(g, ["dataset"], "cores", "t").select("dataset", "cores", r6(F.col("ratio")).alias("ratio"), r6(F.col("speedup")).alias("speedup"))


@query(f"WITH {M} SELECT dataset, {', '.join(r6_sql(f'avg(CASE WHEN method = {chr(39)}m{i}{chr(39)} THEN query_time END)') + f' AS m{i}' for i in range(4))} FROM m GROUP BY dataset")
def rel_pivot_mean(spark, d):
    return R.pivot(metrics(spark, d), ["dataset"], "method", ["m0", "m1", "m2", "m3"], r6(F.avg("query_time")))


@query(f"WITH {M} SELECT dataset, {', '.join(r6_sql(f'median(CASE WHEN cores = {i} THEN query_time END)') + f' AS c{i}' for i in (9, 18, 36))} FROM m GROUP BY dataset")
def rel_pivot_median(spark, d):
    mid = L.percentiles(metrics(spark, d).select(F.struct("dataset", "cores").alias("seg"), F.col("query_time").alias("x")), {"mid": 0.5})
    p = R.pivot(mid.select("seg.dataset", "seg.cores", "mid"), ["dataset"], "cores", [9, 18, 36], r6(F.first("mid")))
    return p.withColumnsRenamed({"9": "c9", "18": "c18", "36": "c36"})


@query("SELECT c.c_custkey, n.n_name, o.n_orders FROM customer c JOIN nation n ON n.n_nationkey = c.c_nationkey LEFT JOIN (SELECT o_custkey, count(*) AS n_orders FROM orders GROUP BY o_custkey) o ON o.o_custkey = c.c_custkey")
def rel_join(spark, d):
    orders = table(spark, d, "orders").groupBy("o_custkey").agg(F.count("*").alias("n_orders"))
    c = table(spark, d, "customer")
    return c.join(table(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).join(orders, F.col("o_custkey") == F.col("c_custkey"), "left").select("c_custkey", "n_name", "n_orders")


@query(f"WITH {M} SELECT run, method, query_time, row_number() OVER (ORDER BY query_time DESC, method, run) AS place FROM m ORDER BY query_time DESC, method, run LIMIT 50")
def rel_sort(spark, d):
    top = metrics(spark, d).orderBy(F.desc("query_time"), "method", "run").limit(50).select("run", "method", "query_time")
    place = F.row_number().over(Window.orderBy(F.desc("query_time"), "method", "run"))
    return top.withColumn("place", place.cast("long"))


@query(f"WITH {M} SELECT DISTINCT dataset, cores FROM m")
def rel_distinct(spark, d):
    return metrics(spark, d).select("dataset", "cores").distinct()


@query(f"WITH {M} SELECT dataset, {r6_sql('corr(distance, approx)')} AS r FROM m GROUP BY dataset")
def rel_corr(spark, d):
    return metrics(spark, d).groupBy("dataset").agg(r6(F.corr("distance", "approx")).alias("r"))


@query(f"WITH {M} SELECT run, coalesce(CASE WHEN cores = 9 THEN query_time END, 0.0) AS query_time FROM m")
def rel_fill(spark, d):
    return metrics(spark, d).select("run", F.when(F.col("cores") == 9, F.col("query_time")).alias("query_time")).fillna(0.0)


@query(f"WITH {M} SELECT method, {r6_sql('avg((distance + 1e-8) / (approx + 1e-8))')} AS quality, {r6_sql('count(*) / sum(distance)')} AS rows_per_second FROM m GROUP BY method")
def rel_ratios(spark, d):
    return metrics(spark, d).groupBy("method").agg(r6(F.avg(R.approximation(F.col("distance"), F.col("approx")))).alias("quality"), r6(F.count("*") / F.sum("distance")).alias("rows_per_second"))


@query(f"WITH {MEANS}, q AS (SELECT dataset, method, round(t) AS t FROM g), r AS (SELECT method, rank() OVER (PARTITION BY dataset ORDER BY t) + (count(*) OVER (PARTITION BY dataset, t) - 1) / 2.0 AS r FROM q) SELECT method, {r6_sql('avg(r)')} AS avg_rank FROM r GROUP BY method")
def rel_average_rank(spark, d):
    q = means(spark, d).withColumn("t", F.round("t"))
    return R.average_rank(q, "dataset", "method", "t").withColumn("avg_rank", r6(F.col("avg_rank")))


@query(f"WITH {M} SELECT dataset, printf('%.2f', avg(distance) + 1e-9) || 's' AS shown FROM m GROUP BY dataset")
def rel_format(spark, d):
    return metrics(spark, d).groupBy("dataset").agg(F.concat(F.format_string("%.2f", F.avg("distance") + 1e-9), F.lit("s")).alias("shown"))


@query(f"WITH {M} SELECT method, {r6_sql('quantile_cont(query_time, 0.25)')} AS q1, {r6_sql('quantile_cont(query_time, 0.5)')} AS q2, {r6_sql('quantile_cont(query_time, 0.75)')} AS q3, {r6_sql('avg(query_time)')} AS mean, {r6_sql('avg(query_time) - 1.96 * stddev_samp(query_time) / sqrt(count(query_time))')} AS low, {r6_sql('avg(query_time) + 1.96 * stddev_samp(query_time) / sqrt(count(query_time))')} AS high FROM m GROUP BY method")
def rel_box(spark, d):
    b = R.box(metrics(spark, d), ["method"], "query_time")
    return b.select("method", *[r6(F.col(c)).alias(c) for c in ("q1", "q2", "q3", "mean", "low", "high")])


@query(f"WITH {M}, b AS (SELECT CASE WHEN query_time < 0 THEN 0 WHEN query_time >= 100 THEN 11 ELSE CAST(floor(query_time / 10) AS BIGINT) + 1 END AS bin FROM m) SELECT CAST(bin AS BIGINT) AS bin, count(*) AS n, {r6_sql('count(*) / CAST((SELECT count(*) FROM m) AS DOUBLE) * 10 / 100.0')} AS density FROM b GROUP BY bin")
def rel_histogram(spark, d):
    return R.histogram(metrics(spark, d), "query_time", 0.0, 100.0, 10).withColumn("density", r6(F.col("density")))


@query(f"WITH {M}, a AS (SELECT run // 10 AS k, min(query_time) AS v FROM m WHERE cores = 9 GROUP BY k), b AS (SELECT run // 10 AS k, min(query_time) AS v FROM m WHERE method = 'm1' GROUP BY k) SELECT coalesce(a.k, b.k) AS k, a.v AS \"left\", b.v AS \"right\", {r6_sql('a.v - b.v')} AS difference FROM a FULL JOIN b ON a.k = b.k")
def rel_compare_runs(spark, d):
    m = metrics(spark, d).withColumn("k", F.floor(F.col("run") / 10))
    a = m.where("cores = 9").groupBy("k").agg(F.min("query_time").alias("v"))
    b = m.where("method = 'm1'").groupBy("k").agg(F.min("query_time").alias("v"))
    return R.compare_runs(a, b, "k", "v").withColumn("difference", r6(F.col("difference")))
