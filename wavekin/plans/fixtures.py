"""Series cut from the relational tables, as DataFrames and as DuckDB common table expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import arrays as A

N, STRIDE = 64, 5
#: Windows of a walk that are cut from one block of steps; events of a part of the walk, at least and at most.
WINDOWS, SMALL_EVENTS, PART_EVENTS = 200, 10_000, 250_000
#: Segments that 64 values cannot be cut into evenly.
ODD_W = 24


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def r6(x: Column) -> Column:
    """Rounded to 6 decimals, without a negative zero."""
    return F.round(x, 6) + F.lit(0.0)


def exploded(df: DataFrame, ids: list[str], v: Column, names=("pos", "val")) -> DataFrame:
    """One row for each element: ids, position from 0, value rounded."""
    out = df.select(*ids, F.posexplode(v).alias(*names))
    return out.select(*ids, F.col(names[0]).cast("long").alias(names[0]), r6(F.col(names[1]).cast("double")).alias(names[1]))


def embeddings(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("series_id"), "label", A.doubles(F.col("embedding")).alias("values"))


def running_sum(df: DataFrame, order: str, value: str, block: int = 4096) -> DataFrame:
    """(i, x): place in the order from 0 and sum up to it, by blocks of the order column, so no task sees all rows."""
    keyed = df.select(F.floor(F.col(order) / block).alias("b"), F.col(order).alias("o"), F.col(value).alias("y"))
    # one row for each block
    before = Window.orderBy("b").rowsBetween(Window.unboundedPreceding, -1)
    base = keyed.groupBy("b").agg(F.sum("y").alias("y"), F.count("*").alias("n")).select("b", F.coalesce(F.sum("y").over(before), F.lit(0)).alias("y0"), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("n0"))
    inside = Window.partitionBy("b").orderBy("o")
    rows = keyed.select("b", (F.row_number().over(inside) - 1).alias("i"), F.sum("y").over(inside.rowsBetween(Window.unboundedPreceding, 0)).alias("x"))
    return rows.join(base, "b").select((F.col("i") + F.col("n0")).alias("i"), (F.col("x") + F.col("y0")).alias("x"))


def walk(spark, sf_dir) -> DataFrame:
    """Windows of 64 over the running sum of centred event values, in thousandths so that sums are exact."""
    events = table(spark, sf_dir, "events").select("event_id", F.round(F.col("value") * 1000).cast("long").alias("k"))
    centre = events.agg(F.floor(F.sum("k") / F.count("*")).alias("m"))
    steps = running_sum(events.crossJoin(F.broadcast(centre)).withColumn("d", F.col("k") - F.col("m")), "event_id", "d")
    spread = steps.select("i", "x", F.explode(blocks_of(F.col("i"))).alias("b"))
    cut = spread.repartition(walk_parts(events), "b").groupBy("b").agg(F.array_sort(F.collect_list(F.struct("i", "x"))).alias("s"))
    at = cut.select("b", "s", F.explode(F.sequence(F.lit(0), F.lit(WINDOWS - 1))).alias("w"))
    # the slice first: what stands before it would be done for every window
    values = F.transform(F.slice("s", F.col("w") * STRIDE + 1, N), lambda s: s["x"] / 1000.0)
    windows = at.select((F.col("b") * WINDOWS + F.col("w")).alias("series_id"), values.alias("values"))
    # kept, as a query reads its series several times; a session's later queries find it again
    return windows.where(F.size("values") == N).persist()


def blocks_of(i: Column) -> Column:
    """The blocks whose windows a step is in: one, or two near a border. A block's windows are cut from its steps and the few after it."""
    width = WINDOWS * STRIDE
    block = F.floor(i / width)
    return F.when((i % width < N - STRIDE) & (block > 0), F.array(block - 1, block)).otherwise(F.array(block))


def walk_parts(events: DataFrame) -> int:
    """Parts of the series: few of a small table, two a core of a larger one, and of at most PART_EVENTS events."""
    rows = events.count()
    return max(1, min(-(-rows // SMALL_EVENTS), max(2 * events.sparkSession.sparkContext.defaultParallelism, -(-rows // PART_EVENTS))))


def users(spark, sf_dir) -> DataFrame:
    """All values of each user in order of time; series of different lengths."""
    e = table(spark, sf_dir, "events").groupBy("user_id").agg(F.array_sort(F.collect_list(F.struct("ts", "event_id", "value"))).alias("s"))
    return e.select(F.col("user_id").alias("series_id"), F.col("s.value").alias("values"))


def odd(spark, sf_dir) -> DataFrame:
    """Series whose length the ODD_W segments do not divide."""
    return embeddings(spark, sf_dir).select("series_id", "values")


def daily(spark, sf_dir) -> DataFrame:
    """Cents of extended price by day of each supplier, in order of the days."""
    days = table(spark, sf_dir, "lineitem").groupBy("l_suppkey", F.to_date("l_shipdate").alias("d")).agg(F.sum(F.round(F.col("l_extendedprice") * 100).cast("long")).alias("x"))
    return days.groupBy(F.col("l_suppkey").alias("series_id")).agg(F.array_sort(F.collect_list(F.struct("d", "x"))).alias("s")).select("series_id", F.transform("s", lambda s: s["x"].cast("double")).alias("values"))


#: The stated query set of all searches: every id divisible by 100.
EVERY = 100


def queries_of(series: DataFrame) -> DataFrame:
    return series.where(F.col("series_id") % EVERY == 0).select(F.col("series_id").alias("q_id"), "values")


# DuckDB, each a common table expression with (series_id, v)
EMB = "emb AS (SELECT vec_id AS series_id, label, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS v FROM embeddings)"
WALK = f"""walk_k AS (SELECT event_id, CAST(round(value * 1000) AS BIGINT) AS k FROM events),
walk_s AS (SELECT row_number() OVER (ORDER BY event_id) - 1 AS i, sum(k - (SELECT CAST(floor(sum(k) / count(*)) AS BIGINT) FROM walk_k)) OVER (ORDER BY event_id ROWS UNBOUNDED PRECEDING) AS x FROM walk_k),
walk AS (SELECT w AS series_id, list(CAST(x AS DOUBLE) / 1000.0 ORDER BY i) AS v FROM (SELECT i, x, unnest(range(CAST(greatest(0, ceil((i - {N - 1}) / {STRIDE}.0)) AS BIGINT), CAST(i // {STRIDE} + 1 AS BIGINT))) AS w FROM walk_s) GROUP BY w HAVING count(*) = {N})"""
USERS = "users AS (SELECT user_id AS series_id, list(value ORDER BY ts, event_id) AS v FROM events GROUP BY user_id)"
ODD = EMB + ", odd AS (SELECT series_id, v FROM emb)"
DAILY = "daily AS (SELECT l_suppkey AS series_id, list(CAST(x AS DOUBLE) ORDER BY d) AS v FROM (SELECT l_suppkey, CAST(l_shipdate AS DATE) AS d, sum(CAST(round(l_extendedprice * 100) AS BIGINT)) AS x FROM lineitem GROUP BY ALL) GROUP BY l_suppkey)"


def zn(src: str, to: str = "zn") -> str:
    return f"{to} AS (SELECT series_id, list_transform(v, lambda x: (x - mu) / CASE WHEN sd < 1e-8 THEN 1.0 ELSE sd END) AS v FROM (SELECT series_id, v, list_avg(v) AS mu, list_stddev_pop(v) AS sd FROM {src}))"


def paa_sql(src: str, w: int, m: int, to: str = "paa") -> str:
    return f"{to} AS (SELECT series_id, list_transform(range({w}), lambda i: list_avg(v[i * {m} + 1:(i + 1) * {m}])) AS p FROM {src})"


def r6_sql(x: str) -> str:
    return f"round({x}, 6) + 0.0"


def explode_sql(ctes: str, src: str, expr: str, ids="series_id", names=("pos", "val")) -> str:
    return f"WITH {ctes} SELECT {ids}, CAST({names[0]} AS BIGINT) AS {names[0]}, {r6_sql('CAST(val_ AS DOUBLE)')} AS {names[1]} FROM (SELECT {ids}, unnest(range(len(x_))) AS {names[0]}, unnest(x_) AS val_ FROM (SELECT {ids}, {expr} AS x_ FROM {src}))"


def l2_sql(a: str, b: str, n: int) -> str:
    return f"list_sum(list_transform(range(1, {n + 1}), lambda i_: ({a}[i_] - {b}[i_]) * ({a}[i_] - {b}[i_])))"


def list_literal(values) -> str:
    return "[" + ", ".join("CAST('%s' AS DOUBLE)" % ("Infinity" if x == float("inf") else "-Infinity" if x == float("-inf") else repr(float(x))) for x in values) + "]"
