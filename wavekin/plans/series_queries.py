"""Queries of the series operators, each with its DuckDB equivalent where there is one."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..config import SeriesConfig
from ..functions import arrays as A
from ..functions import distances as D
from ..functions.kernels import WordBounds, dtw
from ..operators import index as I
from ..operators import learning as L
from ..operators import search as S
from . import fixtures as X

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add




def V():  # noqa: N802  columns need a session, which there is none of at import
    return F.col("values")


BP16, BP256 = A.breakpoints(16), A.breakpoints(256)
KS = list(range(8))


# sources ------------------------------------------------------------------------------------

@query(X.explode_sql(X.EMB, "(SELECT * FROM emb WHERE series_id < 50)", "v"))
def src_matrix_head(spark, d):
    return X.exploded(X.embeddings(spark, d).where("series_id < 50"), ["series_id"], V())


@query(f"WITH {X.EMB} SELECT series_id AS label, CAST(unnest(range(len(v))) AS BIGINT) AS pos, round(unnest(v), 6) + 0.0 AS val FROM emb")
def src_text_parse(spark, d):
    """The table as labelled text files and back; the id stands where the label does."""
    from ..sources.matrix import shared_folder
    from ..sources.text import read_labelled

    path = f"{shared_folder(spark)}/text-{uuid.uuid4().hex}"
    X.embeddings(spark, d).select(F.concat_ws(" ", F.col("series_id").cast("string"), F.array_join(F.transform("values", lambda x: x.cast("string")), "  "))).write.text(path)
    return X.exploded(read_labelled(spark, path), ["label"], V()).withColumn("label", F.col("label").cast("long"))


@query("SELECT CAST(label AS BIGINT) AS label, count(*) AS n, min(vec_id) AS first_id FROM embeddings GROUP BY label")
def src_labels(spark, d):
    """Class ids written as a file of their own and joined by row with the series."""
    from ..sources.matrix import read_labels, shared_folder, write_matrix

    e = X.embeddings(spark, d)
    path = f"{shared_folder(spark)}/labels-{uuid.uuid4().hex}"
    write_matrix(e.select("series_id", F.array(F.col("label").cast("double")).alias("values")), path, "int64")
    return e.select("series_id").join(read_labels(spark, path), "series_id").groupBy("label").agg(F.count("*").alias("n"), F.min("series_id").alias("first_id"))


def _binary(spark, d, dtype):
    """A binary matrix written by our sink to a shared folder and read back by our source."""
    from ..sources.matrix import read_matrix, shared_folder, write_matrix

    scale = 1.0 if dtype == "float32" else 100.0
    v = F.transform(V(), lambda x: F.round(F.abs(x) * scale) if dtype == "uint8" else x)
    path = f"{shared_folder(spark)}/matrix-{uuid.uuid4().hex}"
    write_matrix(X.embeddings(spark, d).select("series_id", v.alias("values")), path, dtype)
    return read_matrix(spark, path, 64, dtype)


@query(X.explode_sql(X.EMB, "emb", "v"))
def src_binary_float32(spark, d):
    return X.exploded(_binary(spark, d, "float32"), ["series_id"], V())


@query(X.explode_sql(X.EMB, "emb", "list_transform(v, lambda x: round(abs(x) * 100.0))"))
def src_binary_uint8(spark, d):
    return X.exploded(_binary(spark, d, "uint8"), ["series_id"], V())


# projections --------------------------------------------------------------------------------

@query(f"WITH {X.USERS} SELECT series_id, {X.r6_sql('list_avg(v)')} AS mean, {X.r6_sql('list_stddev_pop(v)')} AS sd FROM users")
def prj_mean_std(spark, d):
    m = X.users(spark, d).select("series_id", A.moments(V()).alias("m"))
    return m.select("series_id", X.r6(F.col("m.mean")).alias("mean"), X.r6(F.col("m.sd")).alias("sd"))


@query(X.explode_sql(f"{X.USERS}, {X.zn('users')}", "zn", "v"))
def prj_znorm(spark, d):
    return X.exploded(X.users(spark, d), ["series_id"], A.znorm(V()))


_VARIANTS = {"centre": "CASE WHEN sd <= 1e-4 THEN x - mu ELSE (x - mu) / sd END", "epsilon": "(x - mu) / (sd + 1e-8)", "flipped": "(mu - x) / sd", "zero": "(x - mu) / sd"}


@query(" UNION ALL ".join(f"SELECT series_id, '{k}' AS variant, pos, val FROM (" + X.explode_sql(X.USERS + ", m AS (SELECT *, list_avg(v) AS mu, list_stddev_pop(v) AS sd FROM users)", "m", f"list_transform(v, lambda x: {e})") + ")" for k, e in _VARIANTS.items()))
def prj_znorm_variants(spark, d):
    u = X.users(spark, d)
    out = None
    for k in _VARIANTS:
        one = X.exploded(u, ["series_id"], A.znorm(V(), k)).withColumn("variant", F.lit(k)).select("series_id", "variant", "pos", "val")
        out = one if out is None else out.unionByName(one)
    return out


@query(X.explode_sql(f"{X.EMB}, {X.paa_sql('emb', 16, 4)}", "paa", "p", names=("seg", "val")))
def prj_paa(spark, d):
    return X.exploded(X.embeddings(spark, d), ["series_id"], A.paa(V(), 16, 64), ("seg", "val"))


_UNEVEN = "[" + ", ".join(f"list_avg(v[{a + 1}:{a + c}])" for a, c in A.uneven_bounds(64, X.ODD_W)) + "]"


@query(X.explode_sql(X.ODD, "odd", _UNEVEN, names=("seg", "val")))
def prj_paa_uneven(spark, d):
    return X.exploded(X.odd(spark, d), ["series_id"], A.paa_uneven(V(), X.ODD_W, 64), ("seg", "val"))


@query(X.explode_sql(f"{X.ODD}, p AS (SELECT series_id, {_UNEVEN} AS p FROM odd)", "p", "flatten([" + ", ".join(f"list_transform(range({c}), lambda i: p[{i + 1}])" for i, (_, c) in enumerate(A.uneven_bounds(64, X.ODD_W))) + "])"))
def prj_paa_expand(spark, d):
    p = X.odd(spark, d).select("series_id", A.paa_uneven(V(), X.ODD_W, 64).alias("p"))
    return X.exploded(p, ["series_id"], A.paa_expand(F.col("p"), X.ODD_W, 64))


@query(f"WITH {X.EMB}, {X.zn('emb')}, x AS (SELECT unnest(v) AS x FROM zn), b AS (SELECT CAST(unnest(range(15)) AS BIGINT) AS pos, unnest({X.list_literal(BP16)}) AS edge), s AS (SELECT CAST(len(list_filter({X.list_literal(BP16)}, lambda b: b < x)) AS BIGINT) AS s, count(*) AS n FROM x GROUP BY 1) SELECT pos, round(edge, 6) + 0.0 AS val, CAST(coalesce(sum(CASE WHEN s <= pos THEN n END), 0) AS BIGINT) AS below FROM b, s GROUP BY pos, edge")
def prj_breakpoints(spark, d):
    """The breakpoints, and how many z-normalised values do not exceed each."""
    found = X.embeddings(spark, d).select(F.explode(A.znorm(V())).alias("x")).groupBy(A.symbol(F.col("x"), A.literal_array(BP16)).cast("long").alias("s")).agg(F.count("*").alias("n"))
    # one row a breakpoint and a symbol
    edges = X.exploded(spark.range(1).select(A.literal_array(BP16).alias("b")), [], F.col("b"))
    return edges.join(F.broadcast(found), F.col("s") <= F.col("pos"), "left").groupBy("pos", "val").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("below"))


def _word_sql(src: str, bp, op: str) -> str:
    """CTEs zn, paa, word over a source of 64 values."""
    return f"{X.zn(src)}, {X.paa_sql('zn', 16, 4)}, word AS (SELECT series_id, p, list_transform(p, lambda x: CAST(len(list_filter({X.list_literal(bp)}, lambda b: b {op} x)) AS BIGINT)) AS s FROM paa)"


_SYMBOLS = ("seg", "sym")


def _symbols(df: DataFrame, word) -> DataFrame:
    return df.select("series_id", F.posexplode(word).alias("seg", "sym")).select("series_id", F.col("seg").cast("long").alias("seg"), F.col("sym").cast("long").alias("sym"))


def _symbol_sql(ctes: str, src: str = "word", expr: str = "s") -> str:
    return f"WITH {ctes} SELECT series_id, CAST(unnest(range(len({expr}))) AS BIGINT) AS seg, CAST(unnest({expr}) AS BIGINT) AS sym FROM {src}"


@query(_symbol_sql(f"{X.EMB}, {_word_sql('emb', BP256, '<')}"))
def prj_sax_word(spark, d):
    return _symbols(X.embeddings(spark, d), A.sax_word(A.paa(A.znorm(V()), 16, 64), 256))


@query(_symbol_sql(f"{X.EMB}, {_word_sql('emb', BP16, '<=')}"))
def prj_sax_word_right(spark, d):
    return _symbols(X.embeddings(spark, d), A.sax_word(A.paa(A.znorm(V()), 16, 64), 16, "right"))


def _dft_sql(src: str, ks, to: str = "dft") -> str:
    """CTE with lists re and im in the order of ks, rounded to 6 decimals."""
    k = "[" + ", ".join(str(x) for x in ks) + "]"
    part = lambda f: f"round(list_sum(list_transform(range(64), lambda j: v[j + 1] * {f}(2 * pi() * k * j / 64))) / 8.0, 6) + 0.0"
    return f"{to} AS (SELECT series_id, list_transform({k}, lambda k: {part('cos')}) AS re, list_transform({k}, lambda k: CASE WHEN k = 0 THEN 0.0 ELSE {part('sin')} END) AS im FROM {src})"


def _coefficients(series: DataFrame, ks) -> DataFrame:
    c = L.coefficient_values(series, 64, ks)
    return c.select("series_id", F.col("k").cast("long").alias("k"), X.r6(F.col("re")).alias("re"), X.r6(F.col("im")).alias("im"))


def _dft_rows(ctes: str, ks) -> str:
    return f"WITH {ctes} SELECT series_id, CAST(unnest([{', '.join(map(str, ks))}]) AS BIGINT) AS k, unnest(re) AS re, unnest(im) AS im FROM dft"


@query(_dft_rows(f"{X.EMB}, {_dft_sql('emb', KS)}", KS))
def prj_dft(spark, d):
    return _coefficients(X.embeddings(spark, d), KS)


@query(_dft_rows(f"{X.WALK}, {X.zn('walk')}, {_dft_sql('zn', KS[1:])}", KS[1:]))
def prj_dft_norm_skip_dc(spark, d):
    return _coefficients(X.walk(spark, d).select("series_id", A.znorm(V()).alias("values")), KS[1:])


_FLAT = "flat AS (SELECT series_id, CAST(unnest(range(16)) AS BIGINT) AS seg, unnest(flatten(list_transform(range(1, 9), lambda i: [re[i], im[i]]))) AS x FROM dft)"
_RANKED = "ranked AS (SELECT seg, x, row_number() OVER (PARTITION BY seg ORDER BY x) - 1 AS at, count(*) OVER (PARTITION BY seg) AS n FROM flat)"
_ED = _RANKED + ", edges AS (SELECT r.seg, b.bin, r.x AS edge FROM ranked r, (SELECT unnest(range(255)) AS bin) b WHERE r.at = (b.bin + 1) * r.n // 256)"
_EW = "edges AS (SELECT seg, bin, a + (bin + 1) * (b - a) / 256 AS edge FROM (SELECT seg, min(x) AS a, max(x) AS b FROM flat GROUP BY seg), (SELECT unnest(range(255)) AS bin))"
_SFA_SYMBOLS = "SELECT f.series_id, f.seg, CAST(count(e.edge) AS BIGINT) AS sym FROM flat f LEFT JOIN edges e ON e.seg = f.seg AND e.edge <= f.x GROUP BY ALL"


def _sfa(spark, d, binning: str, candidates: int = 0):
    c = SeriesConfig(n=64, summarization="sfa", binning=binning, candidates=candidates, sample=(1 << 40, "hash"))
    z = I.SeriesIndex.prepare(X.walk(spark, d), c)
    model = L.learn(z, c)
    return _symbols(I.SeriesIndex.summarise(z, c, model), F.col("word"))


@query(f"WITH {X.WALK}, {X.zn('walk')}, {_dft_sql('zn', KS)}, {_FLAT}, {_ED} {_SFA_SYMBOLS}")
def prj_sfa_word_ed(spark, d):
    return _sfa(spark, d, "equi-depth")


@query(f"WITH {X.WALK}, {X.zn('walk')}, {_dft_sql('zn', KS)}, {_FLAT}, {_EW} {_SFA_SYMBOLS}")
def prj_sfa_word_ew(spark, d):
    return _sfa(spark, d, "equi-width")


_CHOSEN = """spread AS (SELECT series_id, CAST(unnest(range(16)) AS BIGINT) AS k, unnest(re) AS a, unnest(im) AS b FROM dft),
chosen AS (SELECT k, row_number() OVER (ORDER BY k) - 1 AS i FROM (SELECT k FROM spread GROUP BY k ORDER BY round(var_pop(a) + var_pop(b), 9) DESC, k LIMIT 8)),
flat AS (SELECT series_id, 2 * i AS seg, a AS x FROM spread JOIN chosen USING (k) UNION ALL SELECT series_id, 2 * i + 1, b FROM spread JOIN chosen USING (k))"""


@query(f"WITH {X.WALK}, {X.zn('walk')}, {_dft_sql('zn', range(16))}, {_CHOSEN}, {_ED} {_SFA_SYMBOLS}")
def prj_sfa_word_var(spark, d):
    return _sfa(spark, d, "equi-depth", 32)


_WORDS = f"{X.EMB}, {_word_sql('emb', BP256, '<')}"
_ROOT = "list_reduce(list_prepend(CAST(0 AS BIGINT), s), lambda a, x: a * 2 + (x >> 7))"


def _words(spark, d):
    return X.embeddings(spark, d).select("series_id", A.sax_word(A.paa(A.znorm(V()), 16, 64), 256).alias("word"))


@query(f"WITH {_WORDS} SELECT series_id, CAST({_ROOT} AS BIGINT) AS root_key FROM word")
def prj_root_key(spark, d):
    return _words(spark, d).select("series_id", A.root_key(F.col("word"), 8).alias("root_key"))


@query(f"WITH {_WORDS} SELECT series_id, array_to_string(list_transform(range(1, 17), lambda i: CAST(s[i] >> (8 - (i - 1) % 8 - 1) AS VARCHAR) || '.' || CAST((i - 1) % 8 + 1 AS VARCHAR)), '_') AS label FROM word")
def prj_leaf_label(spark, d):
    cards = F.array(*[F.lit(i % 8 + 1) for i in range(16)])
    return _words(spark, d).select("series_id", A.leaf_label(F.col("word"), cards, 8).alias("label"))


@query(f"WITH {_WORDS} SELECT series_id, CAST(unnest(range(16)) AS BIGINT) AS seg, CAST(unnest(list_transform(s, lambda x: (x >> 5) << 5)) AS BIGINT) AS lo, CAST(unnest(list_transform(s, lambda x: ((x >> 5) << 5) + 31)) AS BIGINT) AS hi FROM word")
def prj_symbol_region(spark, d):
    r = A.region(F.col("word"), F.array_repeat(F.lit(3), 16), 8)
    return _words(spark, d).select("series_id", F.posexplode(r).alias("seg", "r")).select("series_id", F.col("seg").cast("long").alias("seg"), F.col("r.lo").cast("long").alias("lo"), F.col("r.hi").cast("long").alias("hi"))


@query(f"WITH {_WORDS} SELECT series_id, array_to_string(list_transform(s, lambda x: lpad(bin(x), 8, '0')), '') AS bits, array_to_string(list_transform(s, lambda x: lpad(lower(hex(x)), 2, '0')), '') AS packed FROM word")
def prj_word_bits(spark, d):
    return _words(spark, d).select("series_id", A.packed_bits(F.col("word"), 8).alias("bits"), A.packed_hex(F.col("word")).alias("packed"))


_ENV = lambda f, v, n, r: f"list_transform(range(1, {n + 1}), lambda i: list_{f}({v}[greatest(i - {r}, 1):least(i + {r}, {n})]))"


@query(f"WITH {X.EMB} SELECT series_id, CAST(unnest(range(64)) AS BIGINT) AS pos, round(unnest({_ENV('min', 'v', 64, 2)}), 6) + 0.0 AS lo, round(unnest({_ENV('max', 'v', 64, 2)}), 6) + 0.0 AS hi FROM emb")
def prj_envelope(spark, d):
    e = X.embeddings(spark, d).select("series_id", F.posexplode(A.envelope(V(), 2)).alias("pos", "e"))
    return e.select("series_id", F.col("pos").cast("long").alias("pos"), X.r6(F.col("e.lo")).alias("lo"), X.r6(F.col("e.hi")).alias("hi"))


_INVERSE = "list_transform(range(64), lambda j: list_sum(list_transform(range(8), lambda k: (re[k + 1] * cos(2 * pi() * k * j / 64) + im[k + 1] * sin(2 * pi() * k * j / 64)) * CASE WHEN k = 0 THEN 1 ELSE 2 END / 8.0)))"


@query(X.explode_sql(f"{X.WALK}, {X.zn('walk')}, {_dft_sql('zn', KS).replace(', 6) + 0.0', ', 15) + 0.0')}", "dft", _INVERSE))
def prj_reconstruct(spark, d):
    z = X.walk(spark, d).select("series_id", A.znorm(V()).alias("z"))
    c = z.select("series_id", A.dft(F.col("z"), 64, KS).alias("c"))
    return X.exploded(c, ["series_id"], A.inverse_dft(F.col("c"), 64, KS))


_BAND_SQL = f"""WITH {X.WALK}, {X.zn('walk')}, {_dft_sql('zn', KS)}, {_FLAT}, {_EW},
sym AS ({_SFA_SYMBOLS}),
ends AS (SELECT s.series_id, s.seg, coalesce(a.edge, f.a) AS lo, coalesce(b.edge, f.b) AS hi FROM sym s JOIN (SELECT seg, min(edge) AS a, max(edge) AS b FROM edges GROUP BY seg) f ON f.seg = s.seg LEFT JOIN edges a ON a.seg = s.seg AND a.bin = s.sym - 1 LEFT JOIN edges b ON b.seg = s.seg AND b.bin = s.sym),
side AS (SELECT series_id, list(lo ORDER BY seg) AS l, list(hi ORDER BY seg) AS h FROM ends GROUP BY series_id)
SELECT series_id, CAST(unnest(range(64)) AS BIGINT) AS pos, round(unnest(list_transform(range(64), lambda j: list_sum(list_transform(range(8), lambda k: (l[2 * k + 1] * cos(2 * pi() * k * j / 64) + l[2 * k + 2] * sin(2 * pi() * k * j / 64)) * CASE WHEN k = 0 THEN 1 ELSE 2 END / 8.0)))), 5) + 0.0 AS lower, round(unnest(list_transform(range(64), lambda j: list_sum(list_transform(range(8), lambda k: (h[2 * k + 1] * cos(2 * pi() * k * j / 64) + h[2 * k + 2] * sin(2 * pi() * k * j / 64)) * CASE WHEN k = 0 THEN 1 ELSE 2 END / 8.0)))), 5) + 0.0 AS upper FROM side"""


@query(_BAND_SQL)
def prj_sfa_band(spark, d):
    """The series of the lower and of the upper ends of a word's bins."""
    c = SeriesConfig(n=64, summarization="sfa", binning="equi-width", sample=(1 << 40, "hash"))
    z = I.SeriesIndex.prepare(X.walk(spark, d), c)
    model = L.learn(z, c)
    words = I.SeriesIndex.summarise(z, c, model)
    band = words.select("series_id", A.sfa_ends(F.col("word"), model.bins).alias("e"))
    sides = [A.inverse_dft(F.transform("e", lambda e: e[side]), 64, model.coefficients).alias(name) for side, name in (("lo", "lower"), ("hi", "upper"))]
    both = band.select("series_id", F.posexplode(F.arrays_zip(*sides)).alias("pos", "x"))
    return both.select("series_id", F.col("pos").cast("long").alias("pos"), *[(F.round(F.col("x")[n], 5) + 0.0).alias(n) for n in ("lower", "upper")])


@query(f"WITH {X.USERS}, z AS (SELECT series_id, list_transform(v, lambda x: x - list_avg(v)) AS v FROM users) SELECT series_id, {X.r6_sql('len(list_filter(range(1, len(v)), lambda i: sign(v[i]) <> sign(v[i + 1]))) / CAST(len(v) AS DOUBLE)')} AS freq FROM z")
def prj_zero_cross(spark, d):
    z = X.users(spark, d).withColumn("m", A.mean(V())).select("series_id", F.transform(V(), lambda x: x - F.col("m")).alias("values"))
    return z.select("series_id", X.r6(A.zero_crossings(V())).alias("freq"))


@query(f"WITH {X.DAILY}, c AS (SELECT series_id, v, unnest(range(len(v) // 16)) AS window_no FROM daily) SELECT series_id, CAST(window_no AS BIGINT) AS window_no, CAST(unnest(range(16)) AS BIGINT) AS pos, round(unnest(v[window_no * 16 + 1:window_no * 16 + 16]), 6) + 0.0 AS val FROM c")
def prj_segments(spark, d):
    w = X.daily(spark, d).select("series_id", F.posexplode(A.windows(V(), 16)).alias("window_no", "values")).withColumn("window_no", F.col("window_no").cast("long"))
    return X.exploded(w, ["series_id", "window_no"], V())


@query(X.explode_sql(f"{X.DAILY}", "(SELECT series_id, v, series_id % 40 AS spot FROM daily)", "v[greatest(spot - 8, 0) + 1:least(spot + 24, len(v))]"))
def prj_event_window(spark, d):
    at = (F.col("series_id") % 40).cast("int")
    return X.exploded(X.daily(spark, d), ["series_id"], A.event_window(V(), at, 8, 24))


@query(X.explode_sql(X.EMB, "emb", "list_transform(v, lambda x, i: CASE WHEN i % 7 = 1 OR i % 11 = 1 THEN 0.0 ELSE x END)"))
def prj_nan_clean(spark, d):
    """Every 7th value made NaN and every 11th null, then cleaned."""
    spoilt = F.transform(V(), lambda x, i: F.when(i % 11 == 0, F.lit(None)).when(i % 7 == 0, F.lit(float("nan"))).otherwise(x))
    return X.exploded(X.embeddings(spark, d).select("series_id", spoilt.alias("values")), ["series_id"], A.nan_to_zero(V()))


@query()
def prj_noise(spark, d):
    return X.exploded(X.users(spark, d), ["series_id"], A.add_noise(V(), 0.5, 7))


@query()
def prj_random_walk(spark, d):
    """A walk for each id of the table."""
    return X.exploded(X.embeddings(spark, d).select("series_id"), ["series_id"], A.random_walk(F.col("series_id"), 32, 3))


# distances and bounds -----------------------------------------------------------------------

def _measured(pairs: DataFrame) -> DataFrame:
    return pairs.select("q_id", "series_id", *[X.r6(F.col(c)).alias(c) for c in pairs.columns[2:]])


_PLAIN = {"values": 64, "q": 64}


_EMB_PAIRS = f"{X.EMB}, pairs AS (SELECT q.series_id AS q_id, x.series_id, x.v AS v, q.v AS q FROM emb x, emb q WHERE q.series_id % 100 = 0 AND x.series_id <> q.series_id)"


@query(f"WITH {_EMB_PAIRS} SELECT q_id, series_id, {X.r6_sql(X.l2_sql('v', 'q', 64))} AS dist FROM pairs")
def dst_l2sq(spark, d):
    e = X.embeddings(spark, d)
    return _measured(S.all_pairs(e.select("series_id", "values"), X.queries_of(e).withColumnRenamed("values", "q"), _PLAIN, S.l2_kernel, {"dist": D.l2sq(V(), F.col("q"))}))


@query(f"WITH {X.EMB}, {X.zn('emb')}, pairs AS (SELECT q.series_id AS q_id, x.series_id, x.v AS v, q.v AS q FROM zn x, zn q WHERE q.series_id % 100 = 0 AND x.series_id <> q.series_id) SELECT q_id, series_id, {X.r6_sql('2 * 64 * (1 - list_sum(list_transform(range(1, 65), lambda i: v[i] * q[i])) / 64.0)')} AS dist FROM pairs")
def dst_dot(spark, d):
    e = X.embeddings(spark, d).select("series_id", A.znorm(V()).alias("values"))
    return _measured(S.all_pairs(e, X.queries_of(e).withColumnRenamed("values", "q"), _PLAIN, S.dot_kernel, {"dist": D.dot_form(V(), F.col("q"))}))


_EMB_PAIRS_DTW = _EMB_PAIRS + ", start AS (SELECT q_id, series_id, q AS a, v AS b FROM pairs)"


def _dtw_sql(r: int, n: int = 64) -> str:
    """Rows of each pair's matrix one after another, each as the 2r + 1 cells of its band; cells outside are infinite."""
    cells = range(2 * r + 1)
    steps = []
    for k in cells:
        ways = [f"c{k}"] + ([f"c{k + 1}"] if k < 2 * r else []) + ([f"n{k - 1}"] if k else [])
        way = f"least({', '.join(ways)})" if len(ways) > 1 else ways[0]
        steps.append(f"CASE WHEN i + 1 + {k - r} BETWEEN 0 AND {n - 1} THEN (a[i + 2] - b[i + 2 + {k - r}]) * (a[i + 2] - b[i + 2 + {k - r}]) + {way} ELSE CAST('Infinity' AS DOUBLE) END AS n{k}")
    first = ", ".join(("CAST(0 AS DOUBLE)" if k == r else "CAST('Infinity' AS DOUBLE)") + f" AS c{k}" for k in cells)
    return f"""WITH RECURSIVE {_EMB_PAIRS_DTW},
band AS (SELECT q_id, series_id, a, b, CAST(-1 AS BIGINT) AS i, {first} FROM start
UNION ALL SELECT q_id, series_id, a, b, i_, {', '.join(f'n{k}' for k in cells)} FROM (SELECT q_id, series_id, a, b, i + 1 AS i_, {', '.join(steps)} FROM band WHERE i < {n - 1}))
SELECT q_id, series_id, round(c{r}, 6) + 0.0 AS dist FROM band WHERE i = {n - 1}"""


def _dtw(spark, d, r):
    e = X.embeddings(spark, d)
    return S.dtw_brute_force(e, X.queries_of(e), r).select("q_id", "series_id", X.r6(F.col("dist")).alias("dist"))


@query(_dtw_sql(2))
def dst_dtw(spark, d):
    return _dtw(spark, d, 2)


@query(f"WITH {_EMB_PAIRS} SELECT q_id, series_id, {X.r6_sql(X.l2_sql('v', 'q', 64))} AS dist FROM pairs")
def dst_dtw_r0(spark, d):
    return _dtw(spark, d, 0)


_KEOGH = "list_sum(list_transform(range(1, 65), lambda i: CASE WHEN v[i] > hi[i] THEN (v[i] - hi[i]) * (v[i] - hi[i]) WHEN v[i] < lo[i] THEN (v[i] - lo[i]) * (v[i] - lo[i]) ELSE 0.0 END))"


@query(f"WITH {_EMB_PAIRS}, e AS (SELECT *, {_ENV('min', 'q', 64, 2)} AS lo, {_ENV('max', 'q', 64, 2)} AS hi FROM pairs) SELECT q_id, series_id, {X.r6_sql(_KEOGH)} AS lb FROM e")
def dst_lb_keogh(spark, d):
    s = X.embeddings(spark, d)
    q = X.queries_of(s).select("q_id", A.envelope(V(), 2).alias("e")).select("q_id", *[F.transform("e", lambda e: e[side]).alias(side) for side in ("lo", "hi")])  # noqa: B023
    return _measured(S.all_pairs(s.select("series_id", "values"), q, {"values": 64, "lo": 64, "hi": 64}, S.keogh_kernel, {"lb": D.lb_keogh(V(), F.arrays_zip("lo", "hi"))}))


def _bounds(w: int, bits: int = 8) -> WordBounds:
    return WordBounds(SeriesConfig(n=64, w=w, bits=bits))


_GAP = "CASE WHEN x < l THEN (l - x) * (l - x) WHEN x > h THEN (x - h) * (x - h) ELSE 0.0 END"


def _lb_sql(bp, w: int, m: int, v: str = "p", s: str = "s") -> str:
    e = X.list_literal([float("-inf"), *bp, float("inf")])
    gap = "CASE WHEN {p}[i] < e[{s}[i] + 1] THEN (e[{s}[i] + 1] - {p}[i]) * (e[{s}[i] + 1] - {p}[i]) WHEN {p}[i] > e[{s}[i] + 2] THEN ({p}[i] - e[{s}[i] + 2]) * ({p}[i] - e[{s}[i] + 2]) ELSE 0.0 END".format(p=v, s=s)
    return f"{m} * list_sum(list_transform(range(1, {w + 1}), lambda i: {gap.replace('e[', '(' + e + ')[')}))"


@query(f"WITH {_WORDS}, pairs AS (SELECT q.series_id AS q_id, x.series_id, q.p AS p, x.s AS s FROM word x, word q WHERE q.series_id % 100 = 0 AND x.series_id <> q.series_id) SELECT q_id, series_id, {X.r6_sql(_lb_sql(BP256, 16, 4))} AS lb FROM pairs")
def lbd_sax_record(spark, d):
    z = S.spread(X.embeddings(spark, d)).select("series_id", A.paa(A.znorm(V()), 16, 64).alias("p"))
    q = z.where(F.col("series_id") % X.EVERY == 0).select(F.col("series_id").alias("q_id"), F.col("p").alias("q"))
    w = z.select("series_id", A.sax_word(F.col("p"), 256).alias("word"))
    return _measured(S.all_pairs(w, q, {"word": 16, "q": 16}, S.word_kernel(_bounds(16)), {"lb": D.lb_sax(F.col("q"), F.col("word"), 256, 4)}))


_NODE_GAP = "CASE WHEN p[i] < e[(s[i] >> 5) + 1] THEN (e[(s[i] >> 5) + 1] - p[i]) * (e[(s[i] >> 5) + 1] - p[i]) WHEN p[i] > e[(s[i] >> 5) + 2] THEN (p[i] - e[(s[i] >> 5) + 2]) * (p[i] - e[(s[i] >> 5) + 2]) ELSE 0.0 END".replace("e[", "(" + X.list_literal([float("-inf"), *A.breakpoints(8), float("inf")]) + ")[")


@query(f"WITH {_WORDS}, pairs AS (SELECT q.series_id AS q_id, x.series_id, q.p AS p, x.s AS s FROM word x, word q WHERE q.series_id % 100 = 0 AND x.series_id <> q.series_id) SELECT q_id, series_id, {X.r6_sql(f'4 * list_sum(list_transform(range(1, 17), lambda i: {_NODE_GAP}))')} AS lb FROM pairs")
def lbd_sax_node(spark, d):
    """The same at 3 bits a segment: the word's region at reduced cardinality."""
    z = S.spread(X.embeddings(spark, d)).select("series_id", A.paa(A.znorm(V()), 16, 64).alias("p"))
    q = z.where(F.col("series_id") % X.EVERY == 0).select(F.col("series_id").alias("q_id"), F.col("p").alias("q"))
    w = z.select("series_id", A.region(A.sax_word(F.col("p"), 256), F.array_repeat(F.lit(3), 16), 8).alias("r")).select("series_id", F.col("r.lo").alias("low"), F.col("r.hi").alias("high"))
    return _measured(S.all_pairs(w, q, {"low": 16, "high": 16, "q": 16}, S.word_kernel(_bounds(16), lo="low", hi="high"), {"lb": D.lb_sax_region(F.col("q"), F.col("low"), F.col("high"), 256, 4)}))


@query(f"WITH {X.ODD}, {X.zn('odd')}, {X.paa_sql('zn', X.ODD_W, 2)}, word AS (SELECT series_id, p, list_transform(p, lambda x: CAST(len(list_filter({X.list_literal(BP256)}, lambda b: b < x)) AS BIGINT)) AS s FROM paa), pairs AS (SELECT q.series_id AS q_id, x.series_id, q.p AS p, x.s AS s, zq.v AS a, zx.v AS b FROM word x, word q, zn zq, zn zx WHERE q.series_id % 100 = 0 AND x.series_id <> q.series_id AND zq.series_id = q.series_id AND zx.series_id = x.series_id) SELECT q_id, series_id, {X.r6_sql(_lb_sql(BP256, X.ODD_W, 2))} AS lb, {X.r6_sql(X.l2_sql('a', 'b', 64))} AS dist FROM pairs")
def lbd_sax_odd(spark, d):
    """64 values in 24 segments of 2: the bound counts 2 values a segment, so it holds."""
    z = S.spread(X.odd(spark, d)).select("series_id", A.znorm(V()).alias("values")).withColumn("p", A.paa(V(), X.ODD_W, 64))
    q = z.where(F.col("series_id") % X.EVERY == 0).select(F.col("series_id").alias("q_id"), F.col("p").alias("q"), F.col("values").alias("qv"))
    bound = S.word_kernel(_bounds(X.ODD_W))

    def both(rows, queries):
        lb, dist = bound(rows, queries), S.l2_kernel(rows, {"q": queries["qv"]})
        return lambda j: lb(j) + dist(j)

    w = z.select("series_id", "values", A.sax_word(F.col("p"), 256).alias("word"))
    return _measured(S.all_pairs(w, q, {"values": 64, "qv": 64, "word": X.ODD_W, "q": X.ODD_W}, both, {"lb": D.lb_sax(F.col("q"), F.col("word"), 256, 2), "dist": D.l2sq(V(), F.col("qv"))}))


_WALK_Q = "q.series_id % 100 = 0"


def _sfa_index(spark, d, **more):
    return I.SeriesIndex.build(X.walk(spark, d), SeriesConfig(n=64, summarization="sfa", leaf_size=100, sample=(1 << 40, "hash"), **more))


def _sax_index(spark, d, **more):
    return I.SeriesIndex.build(X.walk(spark, d), SeriesConfig(n=64, **({"leaf_size": 100} | more)))


@query(f"""WITH {X.WALK}, {X.zn('walk')}, {_dft_sql('zn', KS)}, {_FLAT}, {_ED},
sym AS ({_SFA_SYMBOLS}),
reg AS (SELECT s.series_id, s.seg, coalesce(a.edge, CAST('-Infinity' AS DOUBLE)) AS lo, coalesce(b.edge, CAST('Infinity' AS DOUBLE)) AS hi FROM sym s LEFT JOIN edges a ON a.seg = s.seg AND a.bin = s.sym - 1 LEFT JOIN edges b ON b.seg = s.seg AND b.bin = s.sym),
gaps AS (SELECT q.series_id AS q_id, r.series_id, greatest(CASE WHEN q.x < r.lo THEN r.lo - q.x WHEN q.x > r.hi THEN q.x - r.hi ELSE 0.0 END - 1e-6, 0.0) AS g, CASE WHEN r.seg < 2 THEN 1.0 ELSE 2.0 END AS wt FROM reg r JOIN flat q ON q.seg = r.seg WHERE q.series_id % 100 = 0 AND q.series_id <> r.series_id)
SELECT q_id, series_id, round(sum(wt * g * g), 3) + 0.0 AS lb FROM gaps GROUP BY ALL""")
def lbd_sfa_record(spark, d):
    """Rounded to 3 decimals: the reference side starts from coefficients of 6 decimals."""
    index = _sfa_index(spark, d)
    q = S.prepare_queries(index, X.queries_of(X.walk(spark, d)))
    q = q.select("q_id", F.transform("q_vector", lambda x: F.round(x, 6)).alias("q"))
    both = S.all_pairs(index.rows.select("series_id", "word"), q, {"word": 16, "q": 16}, S.word_kernel(WordBounds(index.config, index.model)), {"lb": S.record_bound(index, F.col("q"), F.col("word"))})
    return both.select("q_id", "series_id", (F.round("lb", 3) + 0.0).alias("lb"))


@query(f"""WITH {_EMB_PAIRS}, {X.paa_sql('emb', 4, 16)}, word AS (SELECT series_id, list_transform(p, lambda x: CAST(len(list_filter({X.list_literal(BP16)}, lambda b: b < x)) AS BIGINT)) AS s FROM paa),
env AS (SELECT series_id AS q_id, {_ENV('min', 'v', 64, 2)} AS lo, {_ENV('max', 'v', 64, 2)} AS hi FROM emb WHERE series_id % 100 = 0),
pe AS (SELECT q_id, list_transform(range(4), lambda i: list_avg(lo[i * 16 + 1:i * 16 + 16])) AS l, list_transform(range(4), lambda i: list_avg(hi[i * 16 + 1:i * 16 + 16])) AS u FROM env)
SELECT q_id, series_id, {X.r6_sql('16 * list_sum(list_transform(range(1, 5), lambda i: CASE WHEN e[s[i] + 1] > u[i] THEN (e[s[i] + 1] - u[i]) * (e[s[i] + 1] - u[i]) WHEN e[s[i] + 2] < l[i] THEN (l[i] - e[s[i] + 2]) * (l[i] - e[s[i] + 2]) ELSE 0.0 END))'.replace('e[', '(' + X.list_literal([float('-inf'), *BP16, float('inf')]) + ')['))} AS lb FROM pe, word WHERE series_id <> q_id""")
def lbd_dtw(spark, d):
    s = X.embeddings(spark, d)
    env = X.queries_of(s).select("q_id", A.envelope(V(), 2).alias("e"))
    q = env.select("q_id", A.paa(F.transform("e", lambda e: e["lo"]), 4, 64).alias("l"), A.paa(F.transform("e", lambda e: e["hi"]), 4, 64).alias("u"))
    w = s.select("series_id", A.sax_word(A.paa(V(), 4, 64), 16).alias("word"))
    return _measured(S.all_pairs(w, q, {"word": 4, "l": 4, "u": 4}, S.word_kernel(_bounds(4, 4), "l", "u"), {"lb": D.lb_sax_dtw(F.col("l"), F.col("u"), F.col("word"), 16, 16)}))


# A tree that never splits has its roots as leaves, which SQL can name: w = 4, one leaf for each root key.
_ROOTS = f"""{X.WALK}, {X.zn('walk')}, {X.paa_sql('zn', 4, 16)}, word AS (SELECT series_id, p, list_transform(p, lambda x: CAST(len(list_filter({X.list_literal(BP16)}, lambda b: b < x)) AS BIGINT)) AS s FROM paa),
rooted AS (SELECT w.series_id, w.p, w.s, z.v, list_reduce(list_prepend(CAST(0 AS BIGINT), w.s), lambda a, x: a * 2 + (x >> 3)) AS root_key FROM word w JOIN zn z USING (series_id)),
q AS (SELECT series_id AS q_id, p AS qp, v AS qv, root_key FROM rooted q WHERE {_WALK_Q.replace('q.', '')})"""


def _root_index(spark, d):
    return I.SeriesIndex.build(X.walk(spark, d), SeriesConfig(n=64, w=4, bits=4, leaf_size=1 << 40))


_LB4 = _lb_sql(BP16, 4, 16, "qp", "s")


@query(f"WITH {_ROOTS} SELECT q_id, r.root_key, {X.r6_sql('min(' + _LB4 + ')')} AS lb FROM rooted r, q GROUP BY q_id, r.root_key")
def lbd_leaf_tight(spark, d):
    """The smallest record bound of each leaf."""
    index = _root_index(spark, d)
    q = S.prepare_queries(index, X.queries_of(X.walk(spark, d)))
    return S.tight_bounds(index, q).select("q_id", "root_key", X.r6(F.col("lb")).alias("lb"))


@query(f"""WITH {_ROOTS}, spread AS (SELECT root_key, unnest(range(1, 65)) AS i, unnest(v) AS x FROM rooted), side AS (SELECT root_key, i, min(x) AS l, max(x) AS u FROM spread GROUP BY ALL),
qs AS (SELECT q_id, unnest(range(1, 65)) AS i, unnest(qv) AS x FROM q)
SELECT q_id, root_key, round(sum(CASE WHEN x < l THEN (l - x) * (l - x) WHEN x > u THEN (x - u) * (x - u) ELSE 0.0 END), 6) + 0.0 AS lb FROM side JOIN qs USING (i) GROUP BY ALL""")
def lbd_wedge(spark, d):
    index = _root_index(spark, d)
    q = S.prepare_queries(index, X.queries_of(X.walk(spark, d))).select("q_id", "q")
    both = index.wedges().join(index.leaves.select("leaf_id", "root_key"), "leaf_id").crossJoin(F.broadcast(q))
    return both.select("q_id", "root_key", X.r6(D.lb_wedge(F.col("q"), F.col("lower"), F.col("upper"))).alias("lb"))


# learning -----------------------------------------------------------------------------------

_ZW = f"{X.WALK}, {X.zn('walk')}, {_dft_sql('zn', range(16))}"


def _walk_values(spark, d, ks=range(16)):
    return L.coefficient_values(X.walk(spark, d).select("series_id", A.znorm(V()).alias("values")), 64, list(ks))


@query(f"WITH {_ZW}, c AS (SELECT unnest(range(16)) AS k, unnest(re) AS a, unnest(im) AS b FROM dft) SELECT CAST(k AS BIGINT) AS k, {X.r6_sql('var_pop(a) + var_pop(b)')} AS variance FROM c GROUP BY k")
def agg_coeff_variance(spark, d):
    return L.coefficient_variance(_walk_values(spark, d)).select(F.col("k").cast("long").alias("k"), X.r6(F.col("variance")).alias("variance"))


def _edges(df):
    # edges lie on a grid with ties at the 6th decimal; the shift avoids them
    return df.select(F.col("seg").cast("long").alias("seg"), F.col("bin").cast("long").alias("bin"), X.r6(F.col("edge") + 1e-8).alias("edge"))


_EDGE_SQL = "SELECT CAST(seg AS BIGINT) AS seg, CAST(bin AS BIGINT) AS bin, round(edge + 1e-8, 6) + 0.0 AS edge FROM edges"
_F8 = f"{X.WALK}, {X.zn('walk')}, {_dft_sql('zn', KS)}, {_FLAT}"


@query(f"WITH {_F8}, {_ED} {_EDGE_SQL}")
def agg_bins_ed(spark, d):
    return _edges(L.equi_depth(L.positions(_walk_values(spark, d, KS), KS), 256))


@query(f"WITH {_F8}, {_EW} {_EDGE_SQL}")
def agg_bins_ew(spark, d):
    return _edges(L.equi_width(L.positions(_walk_values(spark, d, KS), KS), 256))


@query(f"WITH {X.WALK}, {X.zn('walk')}, {_dft_sql('zn', KS)}, flat AS (SELECT seg, round(x, 2) AS x FROM (SELECT CAST(unnest(range(16)) AS BIGINT) AS seg, unnest(flatten(list_transform(range(1, 9), lambda i: [re[i], im[i]]))) AS x FROM dft)), {_ED.replace('256', '8').replace('range(255)', 'range(7)')} {_EDGE_SQL}")
def agg_bins_rounded(spark, d):
    """Bins of values rounded to 2 decimals, alphabet 8."""
    flat = L.positions(_walk_values(spark, d, KS), KS).select("seg", F.round("x", 2).alias("x"))
    return _edges(L.equi_depth(flat, 8))


@query("SELECT 'first' AS kind, count(*) AS n, CAST(sum(vec_id) AS BIGINT) AS ids FROM embeddings WHERE vec_id < 100 UNION ALL SELECT 'stride', count(*), CAST(sum(vec_id) AS BIGINT) FROM embeddings WHERE vec_id % greatest(1, (SELECT count(*) FROM embeddings) // 100) = 0 UNION ALL SELECT 'hash', count(*), CAST(sum(vec_id) AS BIGINT) FROM embeddings WHERE ((vec_id % 4294967296) * (2654435761 % 2147483647)) % 4294967296 / 4294967296.0 < 100.0 / (SELECT count(*) FROM embeddings)")
def agg_samples(spark, d):
    e = X.embeddings(spark, d).select("series_id")
    out = None
    for kind in ("first", "stride", "hash"):
        one = L.sample(e, 100, kind).agg(F.count("*").alias("n"), F.sum("series_id").alias("ids")).select(F.lit(kind).alias("kind"), "n", "ids")
        out = one if out is None else out.unionByName(one)
    return out


@query()
def agg_tree_stats(spark, d):
    return _sax_index(spark, d).tree_stats()


@query(f"WITH {_ROOTS} SELECT count(*) AS records, count(DISTINCT root_key) AS leaves, count(DISTINCT root_key) AS roots, count(*) * 4 AS word_bytes, count(*) * 64 * 8 AS data_bytes FROM rooted")
def agg_memory_info(spark, d):
    return _root_index(spark, d).info()


_WALK_W = f"{X.WALK}, {_word_sql('walk', BP256, '<')}, both_ AS (SELECT w.series_id, w.p, w.s, z.v FROM word w JOIN zn z USING (series_id)), q AS (SELECT series_id AS q_id, p AS qp, v AS qv FROM both_ WHERE {_WALK_Q.replace('q.', '')})"
_LB16 = _lb_sql(BP256, 16, 4, "qp", "s")
_ALL = f"al AS (SELECT q_id, series_id, {_LB16} AS lb, {X.l2_sql('v', 'qv', 64)} AS d FROM both_, q WHERE series_id <> q_id)"


@query(f"WITH {_WALK_W}, {_ALL} SELECT q_id, {X.r6_sql('avg(sqrt(lb / d))')} AS tlb, {X.r6_sql('max(lb - d)')} <= 0.000000001 AS holds FROM al WHERE d > 0 GROUP BY q_id")
def agg_tlb(spark, d):
    got = S.tightness(_sax_index(spark, d), X.queries_of(X.walk(spark, d)))
    return got.select("q_id", X.r6(F.col("tightness")).alias("tlb"), F.col("bounds_hold").alias("holds"))


@query(f"WITH {_WALK_W}, {_ALL}, best AS (SELECT q_id, min(d) AS kth FROM al GROUP BY q_id) SELECT q_id, count(*) AS rows, CAST(sum(CASE WHEN lb > kth THEN 1 ELSE 0 END) AS BIGINT) AS pruned, {X.r6_sql('avg(CASE WHEN lb > kth THEN 1.0 ELSE 0.0 END)')} AS pruning_power FROM al JOIN best USING (q_id) GROUP BY q_id")
def agg_pruning_power(spark, d):
    got = S.pruning(_sax_index(spark, d), X.queries_of(X.walk(spark, d)))
    return got.select("q_id", "rows", "pruned", X.r6(F.col("pruning_power")).alias("pruning_power"))


@query(f"WITH {_WALK_W}, {_ALL}, best AS (SELECT q_id, min(d) AS kth FROM al GROUP BY q_id), c AS (SELECT q_id, count(*) AS lb_calculations, CAST(sum(CASE WHEN lb <= kth * (1 + 1e-9) + 1e-9 THEN 1 ELSE 0 END) AS BIGINT) AS distance_calculations FROM al JOIN best USING (q_id) GROUP BY q_id) SELECT 'queries' AS what, CAST(count(*) AS DOUBLE) AS value FROM c UNION ALL SELECT 'avg lb calculations', {X.r6_sql('avg(lb_calculations)')} FROM c UNION ALL SELECT 'avg distance calculations', {X.r6_sql('avg(distance_calculations)')} FROM c")
def agg_query_stats(spark, d):
    """Grand averages over the queries of a scan with a known best distance."""
    per = S.pruning(_sax_index(spark, d), X.queries_of(X.walk(spark, d))).select(F.col("rows").alias("lb"), F.col("needed").alias("dist"))
    all_ = per.agg(F.count("*").cast("double").alias("queries"), X.r6(F.avg("lb")).alias("a"), X.r6(F.avg("dist")).alias("b"))
    return all_.select(F.explode(F.create_map(F.lit("queries"), "queries", F.lit("avg lb calculations"), "a", F.lit("avg distance calculations"), "b")).alias("what", "value"))


@query(f"WITH {X.WALK}, {_word_sql('walk', BP256, '<')}, seg AS (SELECT unnest(range(16)) AS seg) SELECT CAST(seg AS BIGINT) AS seg, count(DISTINCT array_to_string(list_transform(range(1, 17), lambda i: CAST(CASE WHEN i = seg + 1 THEN s[i] >> 1 ELSE s[i] END AS VARCHAR)), '.')) AS pages FROM word, seg GROUP BY seg")
def agg_word_coarsen_step(spark, d):
    w = X.walk(spark, d).select(A.sax_word(A.paa(A.znorm(V()), 16, 64), 256).alias("word"))
    return I.coarsen_step(w, 16).select(F.col("seg").cast("long").alias("seg"), "pages")


def _coarsen_sql(rounds: int) -> str:
    """CTEs b1, b2 ... (seg, pages), each round's best segment, over word."""
    out = ["s0 AS (SELECT DISTINCT s FROM word)", "seg AS (SELECT unnest(range(16)) AS seg)"]
    for r in range(1, rounds + 1):
        cut = "list_transform(range(1, 17), lambda i: CASE WHEN i = seg + 1 THEN s[i] >> 1 ELSE s[i] END)"
        out.append(f"b{r} AS (SELECT seg, count(DISTINCT array_to_string(list_transform({cut}, lambda x: CAST(x AS VARCHAR)), '.')) AS pages FROM s{r - 1}, seg GROUP BY seg ORDER BY pages, seg LIMIT 1)")
        out.append(f"s{r} AS (SELECT DISTINCT {cut} AS s FROM s{r - 1}, b{r})")
    return ", ".join(out)


@query(f"""WITH {X.WALK}, {_word_sql('walk', BP256, '<')}, {_coarsen_sql(3)}, best AS (SELECT 1 AS round, seg, pages FROM b1 UNION ALL SELECT 2, seg, pages FROM b2 UNION ALL SELECT 3, seg, pages FROM b3)
SELECT CAST(round AS BIGINT) AS round, CAST(seg AS BIGINT) AS seg, pages, CAST((SELECT count(*) FROM s3) AS BIGINT) AS laid_out, (SELECT count(*) FROM word) AS rows FROM best""")
def agg_word_coarsen(spark, d):
    """Three rounds of dropping the bit that leaves the fewest different words, and the pages and rows of the layout by what is left."""
    w = X.walk(spark, d).select(A.sax_word(A.paa(A.znorm(V()), 16, 64), 256).alias("word"))
    found = I.coarsen_rounds(w, 16, lambda pages, rounds: rounds == 3)
    dropped = [sum(seg == i for seg, _ in found) for i in range(16)]
    pages = I.lay_out(w, dropped, 8).agg(F.count_distinct("page_key").alias("laid_out"), F.count("*").alias("rows"))
    table = spark.createDataFrame([(i + 1, seg, pages_) for i, (seg, pages_) in enumerate(found)], "round long, seg long, pages long")
    return table.join(F.broadcast(pages), how="cross")


# index --------------------------------------------------------------------------------------

@query(f"WITH {X.WALK}, {_word_sql('walk', BP256, '<')} SELECT root_key, count(*) AS n FROM (SELECT CAST({_ROOT} AS BIGINT) AS root_key FROM word) GROUP BY root_key")
def idx_root_counts(spark, d):
    return _sax_index(spark, d).rows.groupBy("root_key").agg(F.count("*").alias("n"))


def _leaf_check(index) -> DataFrame:
    """Rows in the tree, and leaves over the size that hold more than one word."""
    words = index.rows.groupBy("leaf_id").agg(F.count("*").alias("n"), F.count_distinct(A.packed_hex(F.col("word"))).alias("words"))
    return words.agg(F.sum("n").alias("rows"), F.sum(((F.col("n") > index.config.leaf_size) & (F.col("words") > 1)).cast("long")).alias("too_large"))


_LEAF_SQL = f"WITH {X.WALK} SELECT count(*) AS rows, CAST(0 AS BIGINT) AS too_large FROM walk"


@query(_LEAF_SQL)
def idx_leaf_sizes(spark, d):
    return _leaf_check(_sax_index(spark, d, leaf_size=20))


def _first_splits(spark, d, rule: str) -> DataFrame:
    """(root_key, seg, parted): by which segment each root over the leaf size is split first, and that all its leaves are parted there."""
    index = _sax_index(spark, d, leaf_size=20, split=rule)
    words = index.rows.select("root_key", F.lit("").alias("node"), F.array_repeat(F.lit(1), 16).alias("used"), F.lit(0).alias("depth"), "word", F.lit(1).alias("count"))
    big = index.rows.groupBy("root_key").agg(F.count("*").alias("n")).where("n > 20").select("root_key")
    first = I.node_splits(words.join(big, "root_key", "left_semi"), index.config).select("root_key", "seg")
    held = index.leaves.join(first, "root_key").groupBy("root_key", "seg").agg(F.min(F.expr("cardinality[seg]")).alias("bits"))
    return held.select("root_key", F.col("seg").cast("long").alias("seg"), (F.col("bits") > 1).alias("parted"))


def _split_sql(score: str) -> str:
    return f"""WITH {X.WALK}, {_word_sql('walk', BP256, '<')}, r AS (SELECT CAST({_ROOT} AS BIGINT) AS root_key, s FROM word), f AS (SELECT root_key, CAST(unnest(range(16)) AS BIGINT) AS seg, unnest(s) AS x FROM r),
g AS (SELECT root_key, seg, count(*) AS n, CAST(sum(x) AS HUGEINT) AS a, CAST(sum(x * x) AS HUGEINT) AS b, min(x) AS lo, CAST(min(x) >> 7 << 7 AS DOUBLE) + 64 AS cut FROM f GROUP BY root_key, seg HAVING count(*) > 20 AND min(x) <> max(x)),
m AS (SELECT *, CAST(a AS DOUBLE) / n AS mean, greatest(CAST(b AS DOUBLE) / n - CAST(a AS DOUBLE) / n * (CAST(a AS DOUBLE) / n), 0.0) AS var FROM g)
SELECT root_key, seg, TRUE AS parted FROM (SELECT *, row_number() OVER (PARTITION BY root_key ORDER BY {score} DESC, seg) AS nth FROM m) WHERE nth = 1"""


@query(_split_sql("n * b - a * a"))
def idx_split_variance(spark, d):
    return _first_splits(spark, d, "variance")


@query(_split_sql("-seg"))
def idx_split_round_robin(spark, d):
    return _first_splits(spark, d, "round-robin")


@query(_split_sql("CASE WHEN mean - 3 * sqrt(var) < cut AND cut < mean + 3 * sqrt(var) THEN 1e6 ELSE 0.0 END - abs(mean - cut)"))
def idx_split_informed(spark, d):
    return _first_splits(spark, d, "informed")


@query(f"WITH {X.EMB}, {_word_sql('emb', BP256, '<')}, k AS (SELECT series_id, array_to_string(list_transform(s, lambda x: lpad(lower(hex(x)), 2, '0')), '') AS word_key FROM word) SELECT series_id, word_key, row_number() OVER (ORDER BY word_key DESC, series_id) AS nth FROM k")
def idx_sorted_load(spark, d):
    rows = I.sorted_load(_words(spark, d)).withColumn("part", F.spark_partition_id())
    inside = F.row_number().over(Window.partitionBy("part").orderBy(F.desc("word_key"), "series_id"))
    # one row for each range
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    base = rows.groupBy("part").count().select("part", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("base"))
    return rows.withColumn("r", inside).join(base, "part").select("series_id", "word_key", (F.col("r") + F.col("base")).alias("nth"))


@query(f"WITH {X.WALK} SELECT 'before' AS what, count(*) AS n FROM walk WHERE series_id % 2 = 0 UNION ALL SELECT 'after', count(*) FROM walk UNION ALL SELECT 'leaves', count(*) FROM walk")
def idx_append(spark, d):
    w = X.walk(spark, d)
    c = SeriesConfig(n=64, leaf_size=100)
    half = I.SeriesIndex.build(w.where("series_id % 2 = 0"), c)
    whole = half.append(w.where("series_id % 2 = 1"))
    count = lambda df, what: df.select(F.lit(what).alias("what"), "n")
    return count(half.rows.agg(F.count("*").alias("n")), "before").unionByName(count(whole.rows.agg(F.count("*").alias("n")), "after")).unionByName(count(whole.leaves.agg(F.sum("n_rows").alias("n")), "leaves"))


# The rule 'cyclic' splits by the bits of all segments in turn, so a leaf is the shortest prefix of the interleaved bits
# that at most leaf_size rows share, or one word only: SQL can name it, whatever the order in which the rows came.
_W8 = f"{X.WALK}, {X.zn('walk')}, {X.paa_sql('zn', 8, 8)}, word AS (SELECT series_id, list_transform(p, lambda x: CAST(len(list_filter({X.list_literal(A.breakpoints(16))}, lambda b: b < x)) AS BIGINT)) AS s FROM paa)"


def _cyclic_sql(size: int) -> str:
    """CTE placed (series_id, n, cell) over word: the leaf's prefix length and its label."""
    return f"""keyed AS (SELECT series_id, s, array_to_string(list_transform(range(32), lambda k: CAST((s[k % 8 + 1] >> (3 - k // 8)) & 1 AS VARCHAR)), '') AS bits FROM word),
pre AS (SELECT series_id, bits, s, CAST(unnest(range(8, 33)) AS BIGINT) AS n FROM keyed),
shared AS (SELECT n, substr(bits, 1, n) AS p, count(*) AS c, count(DISTINCT bits) AS words FROM pre GROUP BY 1, 2),
own AS (SELECT series_id, any_value(s) AS s, min(pre.n) AS n FROM pre JOIN shared ON shared.n = pre.n AND p = substr(bits, 1, pre.n) WHERE c <= {size} OR words = 1 GROUP BY series_id),
placed AS (SELECT series_id, n, s, array_to_string(list_transform(range(8), lambda i: CAST(s[i + 1] >> (4 - c[i + 1]) AS VARCHAR) || '.' || CAST(c[i + 1] AS VARCHAR)), '_') AS leaf_id FROM (SELECT *, list_transform(range(8), lambda i: 1 + (n - 8) // 8 + CASE WHEN i < (n - 8) % 8 THEN 1 ELSE 0 END) AS c FROM own))"""


_CYCLIC = {"w": 8, "bits": 4, "split": "cyclic"}


def _leaf_rows(index) -> DataFrame:
    """The table of leaves next to what its rows really hold."""
    held = index.rows.groupBy("leaf_id").agg(F.count("*").alias("held"))
    return index.leaves.join(held, "leaf_id", "full").select("leaf_id", (F.col("depth") + 8).cast("long").alias("bits"), F.col("n_rows").alias("n"), "held")


_CYCLIC_LEAVES = "SELECT leaf_id, any_value(n) AS bits, count(*) AS n, count(*) AS held FROM placed GROUP BY leaf_id"


@query(f"WITH {_W8}, {_cyclic_sql(20)} {_CYCLIC_LEAVES}")
def idx_append_split(spark, d):
    """A quarter of the series is built, the others are appended in three steps; leaves that outgrow their size are split each time."""
    w = X.walk(spark, d)
    index = I.SeriesIndex.build(w.where("series_id % 4 = 0"), SeriesConfig(n=64, leaf_size=20, **_CYCLIC))
    for step in (1, 2, 3):
        index = index.append(w.where(F.col("series_id") % 4 == step))
    return _leaf_rows(index)


@query(f"WITH {_W8}, {_cyclic_sql(20)} SELECT 'appended' AS what, * FROM ({_CYCLIC_LEAVES}) UNION ALL SELECT 'saved', * FROM ({_CYCLIC_LEAVES})")
def idx_append_stored(spark, d):
    """The same on a stored index, changed where it lies: as read again after the appends, and as a compact copy."""
    from ..sources.matrix import shared_folder

    path = f"{shared_folder(spark)}/index-{uuid.uuid4().hex}"
    w = X.walk(spark, d)
    index = I.SeriesIndex.build(w.where("series_id % 4 = 0"), SeriesConfig(n=64, leaf_size=20, **_CYCLIC), path=f"{path}/grown")
    for step in (1, 2, 3):
        index = index.append(w.where(F.col("series_id") % 4 == step))
    index.save(f"{path}/copy")
    copy = I.SeriesIndex.load(spark, f"{path}/copy")
    named = lambda what, i: _leaf_rows(i).select(F.lit(what).alias("what"), "*")
    return named("appended", I.SeriesIndex.load(spark, f"{path}/grown")).unionByName(named("saved", copy))


@query(f"""WITH {_W8}, {_cyclic_sql(20)}, leaf AS (SELECT list_transform(s, lambda x: x >> 3) AS root, leaf_id, any_value(n) - 8 AS depth, count(*) AS n FROM placed GROUP BY ALL), deep AS (SELECT root FROM leaf GROUP BY root HAVING max(depth) > 0)
SELECT count(DISTINCT root) AS subtrees, {X.r6_sql('avg(depth)')} AS avg_depth, {X.r6_sql('avg(n)')} AS avg_leaf_size FROM leaf JOIN deep USING (root)""")
def agg_tree_stats_cyclic(spark, d):
    """Depth and size of leaves below split roots, of a tree that SQL can name."""
    got = I.SeriesIndex.build(X.walk(spark, d), SeriesConfig(n=64, leaf_size=20, **_CYCLIC)).tree_stats()
    return got.select("subtrees", X.r6(F.col("avg_depth")).alias("avg_depth"), X.r6(F.col("avg_leaf_size")).alias("avg_leaf_size"))


@query(f"WITH {_W8}, {_cyclic_sql(20)} {_CYCLIC_LEAVES}")
def idx_bulk_load(spark, d):
    """Leaves cut from the words in the order of their interleaved bits."""
    return _leaf_rows(I.SeriesIndex.build(X.walk(spark, d), SeriesConfig(n=64, leaf_size=20, **_CYCLIC), bulk=True))


@query(f"WITH {_ROOTS} SELECT '\"root_' || root_key || '\" -> \"' || array_to_string(list_transform(first(s), lambda x: CAST(x >> 3 AS VARCHAR) || '.1'), '_') || '\" [label=\"' || count(*) || '\"];' AS line FROM rooted GROUP BY root_key")
def idx_dot(spark, d):
    return _root_index(spark, d).dot()


# searches -----------------------------------------------------------------------------------

def _found(df: DataFrame, rank: bool = False) -> DataFrame:
    return df.select("q_id", *([F.col("rank").cast("long").alias("rank")] if rank else []), "series_id", X.r6(F.col("dist")).alias("dist"))


def _ranked(k: int, rank: bool, ctes: str = f"{X.WALK}, {X.zn('walk')}", q: str = _WALK_Q, src: str = "zn") -> str:
    return f"WITH {ctes}, al AS (SELECT q.series_id AS q_id, x.series_id, {X.l2_sql('x.v', 'q.v', 64)} AS d FROM {src} x, {src} q WHERE {q} AND x.series_id <> q.series_id), r AS (SELECT *, row_number() OVER (PARTITION BY q_id ORDER BY d, series_id) AS rank FROM al) SELECT q_id, {'rank, ' if rank else ''}series_id, round(d, 6) + 0.0 AS dist FROM r WHERE rank <= {k}"


_OWN = f"own AS (SELECT q_id, series_id, {X.l2_sql('v', 'qv', 64)} AS d FROM q JOIN rooted r USING (root_key) WHERE series_id <> q_id), ro AS (SELECT *, row_number() OVER (PARTITION BY q_id ORDER BY d, series_id) AS rank FROM own)"


@query(f"WITH {_ROOTS}, {_OWN} SELECT q.q_id, ro.series_id, round(ro.d, 6) + 0.0 AS dist FROM q LEFT JOIN ro ON ro.q_id = q.q_id AND ro.rank = 1")
def qry_approx_1nn(spark, d):
    return _found(S.approximate(_root_index(spark, d), X.queries_of(X.walk(spark, d))))


@query(f"WITH {_ROOTS}, {_OWN} SELECT q.q_id, ro.rank, ro.series_id, round(ro.d, 6) + 0.0 AS dist FROM q LEFT JOIN ro ON ro.q_id = q.q_id AND ro.rank <= 5")
def qry_approx_topk(spark, d):
    return _found(S.approximate(_root_index(spark, d), X.queries_of(X.walk(spark, d)), 5), True)


@query(SQL["qry_approx_1nn"])
def qry_approx_sibling(spark, d):
    """With all leaves of the query's root, the answer does not depend on how the root was split."""
    index = I.SeriesIndex.build(X.walk(spark, d), SeriesConfig(n=64, w=4, bits=4, leaf_size=20))
    return _found(S.approximate(index, X.queries_of(X.walk(spark, d)), siblings=True))


_LEAVES4 = f"""edge AS (SELECT root_key, array_to_string(list_transform(first(s), lambda x: CAST(x >> 3 AS VARCHAR) || '.1'), '_') AS label, [{', '.join(f'min(s[{i}])' for i in range(1, 5))}] AS lo, [{', '.join(f'max(s[{i}])' for i in range(1, 5))}] AS hi FROM rooted GROUP BY root_key),
lbs AS (SELECT q_id, edge.root_key, label, 16 * list_sum(list_transform(range(1, 5), lambda i: CASE WHEN qp[i] < e[lo[i] + 1] THEN (e[lo[i] + 1] - qp[i]) * (e[lo[i] + 1] - qp[i]) WHEN qp[i] > e[hi[i] + 2] THEN (qp[i] - e[hi[i] + 2]) * (qp[i] - e[hi[i] + 2]) ELSE 0.0 END)) AS lb FROM edge, q),
near AS (SELECT q_id, root_key FROM (SELECT *, row_number() OVER (PARTITION BY q_id ORDER BY lb, label) AS nth FROM lbs) WHERE nth <= 3)""".replace("e[", "(" + X.list_literal([float("-inf"), *BP16, float("inf")]) + ")[")


@query(f"WITH {_ROOTS}, {_LEAVES4} SELECT q.q_id, {X.r6_sql('min(' + X.l2_sql('v', 'qv', 64) + ')')} AS bsf FROM q JOIN near ON near.q_id = q.q_id JOIN rooted r ON r.root_key = near.root_key WHERE r.series_id <> q.q_id GROUP BY q.q_id")
def qry_refine_leaves(spark, d):
    """The best distance after the three most promising leaves, which need not be the nearest."""
    got = S.refine(_root_index(spark, d), X.queries_of(X.walk(spark, d)), min_leaves=3)
    return got.select("q_id", X.r6(F.col("bsf")).alias("bsf"))


@query(_ranked(1, False))
def qry_exact_1nn_tree_sax(spark, d):
    return _found(S.knn(_sax_index(spark, d), X.queries_of(X.walk(spark, d))))


@query(_ranked(5, True))
def qry_knn_bulk_loaded(spark, d):
    index = I.SeriesIndex.build(X.walk(spark, d), SeriesConfig(n=64, leaf_size=100, **_CYCLIC), bulk=True)
    return _found(S.knn(index, X.queries_of(X.walk(spark, d)), 5), True)


@query(_ranked(5, True))
def qry_knn_appended(spark, d):
    w = X.walk(spark, d)
    index = I.SeriesIndex.build(w.where("series_id % 3 = 0"), SeriesConfig(n=64, leaf_size=50)).append(w.where("series_id % 3 <> 0"))
    return _found(S.knn(index, X.queries_of(w), 5), True)


@query(_ranked(1, False))
def qry_exact_1nn_tree_sfa(spark, d):
    return _found(S.knn(_sfa_index(spark, d), X.queries_of(X.walk(spark, d))))


@query(_ranked(1, False))
def qry_exact_1nn_scan(spark, d):
    return _found(S.knn(_sax_index(spark, d), X.queries_of(X.walk(spark, d)), strategy="scan"))


@query(_ranked(1, False))
def qry_exact_1nn_best_first(spark, d):
    """Leaves opened in rounds, by their bounds, until the next bound exceeds the best distance."""
    return _found(S.best_first(_sax_index(spark, d), X.queries_of(X.walk(spark, d)))[0])


@query(_ranked(5, True))
def qry_knn_best_first(spark, d):
    return _found(S.best_first(_sax_index(spark, d, leaf_size=20), X.queries_of(X.walk(spark, d)), 5, first=4)[0], True)


@query(f"""WITH {_ROOTS}, {_LEAVES4.rsplit('near AS', 1)[0].rstrip().rstrip(',')}, ordered AS (SELECT q_id, root_key, lb, row_number() OVER (PARTITION BY q_id ORDER BY lb, label) AS nth FROM lbs),
inside AS (SELECT q.q_id, r.root_key, count(*) AS held, min(CASE WHEN r.series_id <> q.q_id THEN {X.l2_sql('v', 'qv', 64)} END) AS d FROM q, rooted r GROUP BY ALL),
rounds_ AS (SELECT *, CAST(floor(log2(nth)) AS INT) AS rnd FROM ordered JOIN inside USING (q_id, root_key)),
best AS (SELECT g.q_id, g.rnd, min(CASE WHEN r.nth < (1 << g.rnd) THEN r.d END) AS bsf FROM (SELECT DISTINCT q_id, rnd FROM rounds_) g JOIN rounds_ r USING (q_id) GROUP BY ALL),
opened AS (SELECT r.q_id, r.rnd, count(*) AS n, sum(held) AS held FROM rounds_ r JOIN best USING (q_id, rnd) WHERE bsf IS NULL OR lb <= bsf * (1 + 1e-9) + 1e-9 GROUP BY ALL),
total AS (SELECT count(*) AS leaves FROM edge)
SELECT q_id, count(*) AS rounds, (count(*) + CASE WHEN max_by(n, rnd) = (1 << max(rnd)) THEN 1 ELSE 0 END) * max(leaves) AS leaves_bounded, CAST(sum(n) AS BIGINT) AS leaves_opened, CAST(sum(held) AS BIGINT) AS record_bounds FROM opened, total GROUP BY q_id""")
def agg_search_stats(spark, d):
    """What the best-first search did for each query, counted while it ran; on a tree of roots, which SQL can follow."""
    stats = S.best_first(_root_index(spark, d), X.queries_of(X.walk(spark, d)))[1]
    return stats.select("q_id", "rounds", "leaves_bounded", "leaves_opened", "record_bounds")


@query(_ranked(1, False))
def qry_fixed_bsf(spark, d):
    """A second pass that starts from the known answer."""
    index, q = _sax_index(spark, d), X.queries_of(X.walk(spark, d))
    known = S.knn(index, q).select("q_id", F.col("dist").alias("bsf"))
    return _found(S.knn(index, q, bsf=known))


_EMB_RANKED = (f"{X.EMB}", "q.series_id % 100 = 0", "emb")


@query(_ranked(1, False, *_EMB_RANKED))
def qry_exact_1nn_batch(spark, d):
    e = X.embeddings(spark, d)
    index = I.SeriesIndex.build(e.select("series_id", "values"), SeriesConfig(n=64, z_normalize=False))
    return _found(S.knn(index, X.queries_of(e), strategy="scan"))


@query(_ranked(5, True))
def qry_knn_tree_sax(spark, d):
    return _found(S.knn(_sax_index(spark, d), X.queries_of(X.walk(spark, d)), 5), True)


@query(_ranked(5, True))
def qry_knn_tree_sfa(spark, d):
    return _found(S.knn(_sfa_index(spark, d, candidates=32), X.queries_of(X.walk(spark, d)), 5), True)


@query(_ranked(5, True))
def qry_knn_scan(spark, d):
    return _found(S.knn(_sfa_index(spark, d, binning="equi-width"), X.queries_of(X.walk(spark, d)), 5, strategy="scan"), True)


@query(_ranked(5, True, *_EMB_RANKED))
def qry_knn_bruteforce(spark, d):
    e = X.embeddings(spark, d)
    return _found(S.brute_force(e, X.queries_of(e), 5), True)


@query(f"WITH nn AS ({_ranked(9, True, *_EMB_RANKED)}), l AS (SELECT q_id, rank, label, count(*) OVER (PARTITION BY q_id, label ORDER BY rank ROWS UNBOUNDED PRECEDING) AS votes FROM nn JOIN embeddings e ON e.vec_id = nn.series_id), w AS (SELECT *, row_number() OVER (PARTITION BY q_id ORDER BY votes DESC, rank) AS o FROM l) SELECT q_id, CAST(label AS BIGINT) AS label, votes FROM w WHERE o = 1")
def qry_knn_classify(spark, d):
    e = X.embeddings(spark, d)
    got = S.vote(S.brute_force(e, X.queries_of(e), 9), e.select("series_id", "label"))
    return got.select("q_id", F.col("label").cast("long").alias("label"), "votes")


def _dtw_best(sql: str) -> str:
    head, tail = sql.rsplit("\nSELECT", 1)
    return f"{head}, al AS (SELECT{tail}) SELECT q_id, series_id, dist FROM (SELECT *, row_number() OVER (PARTITION BY q_id ORDER BY dist, series_id) AS o FROM al) WHERE o = 1"


def _dtw_index(spark, d):
    return I.SeriesIndex.build(X.embeddings(spark, d), SeriesConfig(n=64, w=8, bits=8, leaf_size=20, z_normalize=False))


@query(_dtw_best(_dtw_sql(2)))
def qry_dtw_1nn_scan(spark, d):
    return _found(S.dtw_nearest(_dtw_index(spark, d), X.queries_of(X.embeddings(spark, d)), 2, strategy="scan"))


@query(_dtw_best(_dtw_sql(2)))
def qry_dtw_1nn_tree(spark, d):
    return _found(S.dtw_nearest(_dtw_index(spark, d), X.queries_of(X.embeddings(spark, d)), 2, strategy="tree"))


@query(f"WITH nn AS ({_ranked(1, True, *_EMB_RANKED)}) SELECT q_id, nn.series_id, CAST(unnest(range(64)) AS BIGINT) AS pos, round(unnest(list_transform(e.embedding, lambda x: CAST(x AS DOUBLE))), 6) + 0.0 AS val FROM nn JOIN embeddings e ON e.vec_id = nn.series_id")
def qry_answer_values(spark, d):
    e = X.embeddings(spark, d)
    got = S.answer_values(S.brute_force(e, X.queries_of(e), 1), e.select("series_id", "values"))
    return X.exploded(got, ["q_id", "series_id"], V())


@query(f"WITH {X.WALK} SELECT series_id AS q_id, TRUE AS same_answer, TRUE AS bounds_hold FROM walk q WHERE {_WALK_Q}")
def qry_sanity(spark, d):
    return S.sanity(_sfa_index(spark, d), X.queries_of(X.walk(spark, d))).select("q_id", "same_answer", "bounds_hold")


@query(f"WITH {_WALK_W}, {_ALL}, r AS (SELECT *, row_number() OVER (PARTITION BY q_id ORDER BY d, series_id) AS rank FROM al WHERE lb <= 2.0) SELECT q_id, rank, series_id, round(d, 6) + 0.0 AS dist FROM r WHERE rank <= 3 AND d IS NOT NULL")
def qry_max_lb(spark, d):
    return _found(S.knn(_sax_index(spark, d), X.queries_of(X.walk(spark, d)), 3, max_lb=2.0), True)


@query(f"WITH {_WALK_W}, {_ALL} SELECT q_id, series_id, round(d, 6) + 0.0 AS dist FROM al WHERE d <= 4.0")
def qry_range(spark, d):
    return _found(S.within(_sax_index(spark, d), X.queries_of(X.walk(spark, d)), 4.0))


@query(f"WITH {_ROOTS}, {_OWN}, tru AS ({_ranked(5, True).replace('WITH ' + X.WALK + ', ' + X.zn('walk') + ', ', 'WITH ')}) SELECT t.q_id, round(count(ro.series_id) / CAST(count(*) AS DOUBLE), 6) + 0.0 AS recall FROM tru t LEFT JOIN ro ON ro.q_id = t.q_id AND ro.series_id = t.series_id AND ro.rank <= 5 GROUP BY t.q_id")
def qry_recall_at_k(spark, d):
    index, q = _root_index(spark, d), X.queries_of(X.walk(spark, d))
    got = S.recall(S.approximate(index, q, 5), S.knn(index, q, 5))
    return got.select("q_id", X.r6(F.col("recall")).alias("recall"))


@query(_ranked(5, True, *_EMB_RANKED))
def str_knn_available_now(spark, d):
    """Queries arrive as a stream and meet the static series; equal to the batch search."""
    from ..sources.matrix import shared_folder
    from ..streaming.continuous import run_available

    e = X.embeddings(spark, d)
    folder = f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}"
    X.queries_of(e).repartition(4).write.parquet(f"{folder}/in")
    return _found(run_available(spark, f"{folder}/in", f"{folder}/out", e.select("series_id", "values"), 5), True)


_LATENCY = "series_id % 97"


@query(f"""WITH nn AS ({_ranked(5, True, *_EMB_RANKED)}), a AS (SELECT q_id, CAST((rank + q_id // 100) % 4 AS BIGINT) AS step, {_LATENCY} AS latency FROM nn)
SELECT s.step, count(DISTINCT q_id) AS queries, count(*) AS answers, round(avg(latency), 6) + 0.0 AS avg_latency FROM (SELECT DISTINCT step FROM a) s JOIN a ON a.step <= s.step GROUP BY s.step""")
def str_running_history(spark, d):
    """Answers arrive in four steps, a query's in several of them; the state tells the totals after each step."""
    from ..sources.matrix import shared_folder
    from ..streaming.continuous import running_history

    e, folder = X.embeddings(spark, d), f"{shared_folder(spark)}/history-{uuid.uuid4().hex}"
    found = S.brute_force(e, X.queries_of(e), 5).select("q_id", ((F.col("rank") + F.floor(F.col("q_id") / 100)) % 4).cast("long").alias("step"), F.expr(_LATENCY).alias("latency"))
    found.write.parquet(f"{folder}/all")
    for step in range(4):
        spark.read.parquet(f"{folder}/all").where(F.col("step") == step).coalesce(1).write.mode("append").parquet(f"{folder}/in")
        stream = spark.readStream.schema("q_id long, step long, latency long").parquet(f"{folder}/in")
        running_history(stream, f"{folder}/out", f"{folder}/mark", availableNow=True).awaitTermination()
    return spark.read.parquet(f"{folder}/out").select("step", "queries", "answers", X.r6(F.col("avg_latency")).alias("avg_latency")).distinct()


@query(_ranked(5, True, *_EMB_RANKED))
def qry_knn_sql_table_function(spark, d):
    """A table function over a stored index, called by a lateral join; the query's own series is left out afterwards."""
    from ..functions.search_sql import register_knn
    from ..sources.matrix import shared_folder

    e, path = X.embeddings(spark, d), f"{shared_folder(spark)}/index-{uuid.uuid4().hex}"
    I.SeriesIndex.build(e.select("series_id", "values"), SeriesConfig(n=64, w=8, leaf_size=20, z_normalize=False), path=path)
    register_knn(spark, path)
    view = f"asked_{uuid.uuid4().hex}"
    S.spread(X.queries_of(e)).createOrReplaceTempView(view)
    return spark.sql(f"""SELECT q_id, rank, series_id, round(dist, 6) + 0D AS dist FROM (
        SELECT q.q_id, CAST(row_number() OVER (PARTITION BY q.q_id ORDER BY n.rank) AS BIGINT) AS rank, n.series_id, n.dist
        FROM {view} q, LATERAL knn(q.values, 6) n WHERE n.series_id <> q.q_id) WHERE rank <= 5""")


@query(f"WITH nn AS ({_ranked(3, True)}) SELECT what, q_id, rank, series_id, dist, TRUE AS fewer_parts FROM nn, (SELECT unnest(['loaded', 'completed']) AS what)")
def src_stored_index(spark, d):
    """An index written, loaded and searched, and one saved without its values and completed again; the seed of a search must read fewer parts than there are."""
    from ..sources.matrix import shared_folder

    path, w = f"{shared_folder(spark)}/index-{uuid.uuid4().hex}", X.walk(spark, d)
    config, asked = SeriesConfig(n=64, leaf_size=50), X.queries_of(w)
    I.SeriesIndex.build(w, config, path=f"{path}/whole", part_rows=300).save(f"{path}/bare", covering=False, part_rows=300)
    index, bare = I.SeriesIndex.load(spark, f"{path}/whole"), I.SeriesIndex.load(spark, f"{path}/bare").complete(w)
    one = next(S.query_blocks(S.prepare_queries(index, asked.where(F.col("q_id") == 0))))
    files = S._rows_of(index, S.near_leaves(index, S._measure(index, one), 1)).select(F.input_file_name().alias("f")).distinct().count()
    fewer = files < index.rows.select("part").distinct().count()
    named = lambda what, i: _found(S.knn(i, asked, 3), True).select(F.lit(what).alias("what"), "*", F.lit(fewer).alias("fewer_parts"))
    return named("loaded", index).unionByName(named("completed", bare))
