"""A series index as tables: rows with words and leaves, and the leaves' symbol ranges.

The tree exists only as leaf labels. Splitting works on distinct words with counts, so
it is small beside the data, and no task holds more than ``WORDS_IN_TASK`` of them.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Iterator
from dataclasses import asdict, dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import SeriesConfig
from ..functions import arrays as A
from ..functions.kernels import summarise
from ..sources.matrix import shared_folder
from . import tree as T
from .learning import SfaModel, learn


def remove(spark: SparkSession, path: str) -> None:
    """Delete a staged table that no later plan reads."""
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


#: Different words of a node that one task splits; larger nodes are split one level at a time by Spark.
WORDS_IN_TASK = 1_000_000
#: Rows of a leaf map that is broadcast, at most; larger ones are joined by a shuffle.
BROADCAST_WORDS = 500_000
#: Rows of a part of a stored index.
PART_ROWS = 1_000_000


def best_segment(total: int, sums: np.ndarray, squares: np.ndarray, low: np.ndarray, high: np.ndarray, used: np.ndarray, bits: int, rule: str, depth: int) -> int | None:
    """The segment to split next, from the symbols' weighted sums and ends, or None if no split can part the words.

    'variance': the segment of largest symbol variance, in whole numbers; 'informed': among
    segments whose next bit parts mean +- 3 sd most evenly; 'round-robin': depth modulo w, or the next one
    that parts the words; 'cyclic': depth modulo w, whether it parts the words or not, so that a tree
    does not depend on the order in which its rows came. Ties go to the first segment.
    """
    open_ = (used < bits) & (low != high)
    if not open_.any():
        return None
    if rule == "cyclic":
        return depth % len(used)
    if rule == "round-robin":
        order = [(depth + i) % len(used) for i in range(len(used))]
        return next(i for i in order if open_[i])
    if rule == "informed":
        mean = sums / total
        sd = np.sqrt(np.maximum(squares / total - mean * mean, 0.0))
        rest = bits - used
        cut = (low >> rest << rest) + (1 << np.maximum(rest - 1, 0))
        inside = (mean - 3 * sd < cut) & (cut < mean + 3 * sd)
        score = np.where(inside, 1e6, 0) - np.abs(mean - cut)
        return int(np.argmax(np.where(open_, score, -np.inf)))
    score = [int(total) * int(b) - int(a) ** 2 if o else -1 for a, b, o in zip(sums, squares, open_, strict=True)]
    return score.index(max(score))


def choose_segment(words: np.ndarray, counts: np.ndarray, used: np.ndarray, bits: int, rule: str, depth: int) -> int | None:
    """``best_segment`` of a node's words with counts."""
    return best_segment(*_sums(words, counts), used, bits, rule, depth)


def _sums(words: np.ndarray, counts: np.ndarray) -> tuple:
    return counts.sum(), counts @ words, counts @ (words * words), words.min(axis=0), words.max(axis=0)


def split_paths(words: np.ndarray, counts: np.ndarray, bits: int, leaf_size: int, rule: str = "variance", used: np.ndarray | None = None, depth: int = 0, path: str = "") -> list[tuple[np.ndarray, np.ndarray, int, str]]:
    """(rows, bits used by segment, depth, path) of the leaves of one node. A leaf over the size holds one word only."""
    todo = [(np.arange(len(words)), np.ones(words.shape[1], dtype=np.int64) if used is None else used, depth, path)]
    out = []
    while todo:
        rows, used, depth, path = todo.pop()
        seg = choose_segment(words[rows], counts[rows], used, bits, rule, depth) if counts[rows].sum() > leaf_size else None
        if seg is None:
            out.append((rows, used, depth, path))
            continue
        bit = (words[rows, seg] >> (bits - used[seg] - 1)) & 1
        deeper = used.copy()
        deeper[seg] += 1
        todo += [(rows[bit == b], deeper, depth + 1, f"{path}/{seg}.{b}") for b in (0, 1) if (bit == b).any()]
    return out


def split_words(*args, **more) -> list[tuple[np.ndarray, np.ndarray, int]]:
    """``split_paths`` without the paths."""
    return [leaf[:3] for leaf in split_paths(*args, **more)]


def node_splits(nodes: DataFrame, config: SeriesConfig) -> DataFrame:
    """(root_key, node, seg): the segment by which each node of (root_key, node, used, depth, word, count) is to be split; nodes that nothing parts are left out.

    One aggregation over all words, however many a node has.
    """
    sums = []
    for i in range(config.w):
        x = F.col("word")[i].cast("long")
        sums += [F.sum(x * F.col("count")).alias(f"a{i}"), F.sum(x * x * F.col("count")).alias(f"b{i}"), F.min(x).alias(f"l{i}"), F.max(x).alias(f"h{i}")]
    stats = nodes.groupBy("root_key", "node").agg(F.first("used").alias("used"), F.first("depth").alias("depth"), F.sum("count").alias("total"), *sums)
    of = lambda c: F.array(*[f"{c}{i}" for i in range(config.w)]).alias(c)
    stats = stats.select("root_key", "node", "used", "depth", "total", *[of(c) for c in "ablh"])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            chosen = []
            for r in pdf.itertuples():
                chosen.append(best_segment(r.total, np.array(r.a), np.array(r.b), np.array(r.l), np.array(r.h), np.array(r.used, dtype=np.int64), config.bits, config.split, r.depth))
            yield pdf.assign(seg=pd.array(chosen, dtype="Int32"))[["root_key", "node", "seg"]]

    return stats.mapInPandas(run, "root_key long, node string, seg int").where("seg is not null")


def _split_large(nodes: DataFrame, config: SeriesConfig, limit: int) -> DataFrame:
    """nodes, with those of more than ``limit`` words split level by level until none is left that a split can part.

    Each level is written to the shared folder, which keeps the plan short.
    """
    spark, schema, held = nodes.sparkSession, nodes.schema, None
    while True:
        sizes = nodes.groupBy("root_key", "node").agg(F.count("*").alias("words"), F.sum("count").alias("rows"))
        large = sizes.where((F.col("words") > limit) & (F.col("rows") > config.leaf_size)).select("root_key", "node")
        chosen = node_splits(nodes.join(large, ["root_key", "node"], "left_semi"), config).persist()
        if not chosen.count():
            chosen.unpersist()
            return nodes
        bit = F.expr(f"shiftright(cast(word[seg] as int), cast({config.bits} - used[seg] - 1 as int)) & 1")
        deeper = F.transform("used", lambda u, i: F.when(i == F.col("seg"), u + 1).otherwise(u))
        parted = F.col("seg").isNotNull()
        split = nodes.join(chosen, ["root_key", "node"], "left").select(
            "root_key", F.when(parted, F.concat_ws("/", "node", F.concat_ws(".", "seg", bit))).otherwise(F.col("node")).alias("node"),
            F.when(parted, deeper).otherwise(F.col("used")).alias("used"), F.when(parted, F.col("depth") + 1).otherwise(F.col("depth")).alias("depth"), "word_key", "word", "count",
        )
        path = f"{shared_folder(spark)}/nodes-{uuid.uuid4().hex}"
        split.write.parquet(path)
        chosen.unpersist()
        if held is not None:
            remove(spark, held)
        nodes, held = spark.read.schema(schema).parquet(path), path


_LEAF = "word_key string, leaf_id string, cardinality array<int>, depth int, path string"


def leaf_of_words(words: DataFrame, config: SeriesConfig, limit: int = WORDS_IN_TASK) -> DataFrame:
    """(word_key, leaf_id, cardinality, depth, path) for distinct (root_key, word_key, word, count).

    Roots that fit a leaf are leaves as they are, without Python. The words of the others
    are sorted by root and split in passing, many roots a task; nodes of more than ``limit``
    words are parted beforehand.
    """
    ones = F.array_repeat(F.lit(1), config.w)
    big = words.groupBy("root_key").agg(F.sum("count").alias("rows")).where(F.col("rows") > config.leaf_size)
    small = words.join(big, "root_key", "left_anti").select("word_key", A.leaf_label(F.col("word"), ones, config.bits).alias("leaf_id"), ones.alias("cardinality"), F.lit(0).alias("depth"), F.lit("").alias("path"))
    nodes = words.join(big, "root_key", "left_semi").select("root_key", F.lit("").alias("node"), ones.alias("used"), F.lit(0).alias("depth"), "word_key", "word", "count")
    return small.unionByName(split_nodes(nodes, config, limit))


def split_nodes(nodes: DataFrame, config: SeriesConfig, limit: int = WORDS_IN_TASK) -> DataFrame:
    """The same for the words of nodes (root_key, node, used, depth, word_key, word, count), from the bits that each node has used on."""
    sizes = nodes.groupBy("root_key", "node").agg(F.count("*").alias("n"))
    if (sizes.agg(F.max("n")).first()[0] or 0) > limit:
        nodes = _split_large(nodes, config, limit)

    def leaves(node: pd.DataFrame) -> pd.DataFrame:
        matrix = np.stack(node["word"].to_numpy()).astype(np.int64)
        leaf, cards, depths, paths = [""] * len(node), [None] * len(node), [0] * len(node), [""] * len(node)
        first = node.iloc[0]
        for rows, used, depth, path in split_paths(matrix, node["count"].to_numpy(), config.bits, config.leaf_size, config.split, np.array(first["used"], dtype=np.int64), int(first["depth"]), first["node"]):
            label = T.label_of(matrix[rows[0]], used, config.bits)
            for r in rows:
                leaf[r], cards[r], depths[r], paths[r] = label, used, depth, path
        return pd.DataFrame({"word_key": node["word_key"].to_numpy(), "leaf_id": leaf, "cardinality": cards, "depth": depths, "path": paths})

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: pd.DataFrame | None = None
        for pdf in batches:
            pdf = pdf if held is None else pd.concat([held, pdf], ignore_index=True)
            if not len(pdf):
                continue
            last = (pdf["root_key"] == pdf["root_key"].iloc[-1]) & (pdf["node"] == pdf["node"].iloc[-1])
            for _, node in pdf[~last].groupby(["root_key", "node"], sort=False):
                yield leaves(node)
            held = pdf[last]
        if held is not None and len(held):
            yield leaves(held)

    by_node = nodes.repartition("root_key", "node").sortWithinPartitions("root_key", "node")
    return by_node.mapInPandas(run, _LEAF)


def _versions(spark: SparkSession, path: str) -> int:
    """The number of the last finished append to a stored index."""
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    store = folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    names = [f.getPath().getName() for f in store.listStatus(folder)]
    done = [int(n.split("-")[1]) for n in names if n.startswith("commit-") and store.exists(spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/{n}/_SUCCESS"))]
    return max(done, default=0)


def leaves_folder(spark: SparkSession, path: str) -> str:
    """Where a stored index has its present table of leaves."""
    version = _versions(spark, path)
    return f"{path}/leaves-{version}" if version else f"{path}/leaves"


@dataclass
class SeriesIndex:
    """config and model, rows (series_id, values, vector, word, root_key, leaf_id), leaves (leaf_id, root_key, n_rows, depth, cardinality, path, lo, hi).

    A stored index has a path; its rows have a part and its leaves the parts in which their rows lie.
    """

    config: SeriesConfig
    model: SfaModel | None
    rows: DataFrame
    leaves: DataFrame
    path: str | None = None
    #: Tables that an append without a path has written to the shared folder.
    staged: tuple[str, ...] = ()

    @staticmethod
    def prepare(series: DataFrame, config: SeriesConfig, id_col: str = "series_id") -> DataFrame:
        """(id, values): doubles, z-normalised if so configured; series of another length or with nulls are left out."""
        v = A.doubles(F.col("values"))
        ok = (F.size("values") == config.n) & ~F.exists("values", lambda x: x.isNull() | F.isnan(x))
        return series.where(ok).select(id_col, (A.znorm(v) if config.z_normalize else v).alias("values"))

    @staticmethod
    def summarise(prepared: DataFrame, config: SeriesConfig, model: SfaModel | None) -> DataFrame:
        """Adds vector, word and root_key."""
        return summarise(prepared, config, model).withColumn("root_key", A.root_key(F.col("word"), config.bits))

    @classmethod
    def build(cls, series: DataFrame, config: SeriesConfig, *, path: str | None = None, model: SfaModel | None = None, bulk: bool = False, part_rows: int | None = None) -> SeriesIndex:
        """Build over (series_id, values). With ``path`` its tables are written there and read back, in parts of ``part_rows`` rows, else they are persisted (see ``release``).

        With ``bulk`` leaves are cut from the words in the order of their interleaved bits instead of splitting from the roots; for the rule 'cyclic', with the same result.
        """
        prepared = cls.prepare(series, config)
        if config.summarization == "sfa" and model is None:
            model = learn(prepared, config)
        worded = cls.summarise(prepared, config, model).withColumn("word_key", A.packed_hex(F.col("word")))
        held = f"{path}/words-{uuid.uuid4().hex[:8]}"
        if path is None:
            worded = worded.persist()
        else:
            worded.write.parquet(held)
            worded = series.sparkSession.read.schema(worded.schema).parquet(held)
        words = worded.groupBy("root_key", "word_key").agg(F.first("word").alias("word"), F.count("*").alias("count")).persist()
        leaf = T.leaf_of_sorted(words, config, WORDS_IN_TASK) if bulk else leaf_of_words(words, config)
        rows = worded.join(F.broadcast(leaf) if words.count() <= BROADCAST_WORDS else leaf, "word_key").drop("word_key")
        if path is None:
            # the rows of a leaf lie together, those of a large one in several partitions
            rows = rows.repartitionByRange("leaf_id", "series_id").sortWithinPartitions("leaf_id").persist()
            index = cls(config, model, rows.drop("cardinality", "depth", "path"), cls._leaves(rows, config).persist())
            index.leaves.count()
            worded.unpersist()
        else:
            cls._write_rows(rows, path, size=part_rows)
            rows = cls._read_rows(series.sparkSession, path)
            cls._leaves(rows, config).write.mode("overwrite").parquet(f"{path}/leaves")
            remove(series.sparkSession, held)
            index = cls(config, model, rows.drop("cardinality", "depth", "path"), series.sparkSession.read.parquet(f"{path}/leaves"), path)
            index._write_settings(path)
        words.unpersist()
        return index

    def release(self) -> None:
        """Give back what ``build`` without a path holds in the executors, and what ``append`` to it has written. The index it was appended to is released on its own, and not before."""
        self.rows.unpersist()
        self.leaves.unpersist()
        for path in self.staged:
            remove(self.rows.sparkSession, path)

    @staticmethod
    def _write_rows(rows: DataFrame, path: str, first: int = 0, size: int | None = None) -> None:
        """Rows in folders part=first, first + 1 ... by ranges of leaves, so that searches read only the parts of the leaves they open.

        A leaf of very many rows spreads over several parts.
        """
        parts = max(1, math.ceil(rows.count() / (size or PART_ROWS)))
        ranged = rows.drop("part").repartitionByRange(parts, "leaf_id", "series_id").sortWithinPartitions("leaf_id", "series_id")
        ranged.withColumn("part", F.spark_partition_id() + first).write.mode("append" if first else "overwrite").partitionBy("part").parquet(f"{path}/rows")

    @staticmethod
    def _read_rows(spark: SparkSession, path: str) -> DataFrame:
        return spark.read.parquet(f"{path}/rows")

    @staticmethod
    def _leaves(rows: DataFrame, config: SeriesConfig) -> DataFrame:
        ends = [f(F.col("word")[i]).alias(f"{name}{i}") for i in range(config.w) for name, f in (("l", F.min), ("h", F.max))]
        parts = [F.array_sort(F.collect_set("part")).alias("parts")] if "part" in rows.columns else []
        named = [F.first(c).alias(c) for c in ("root_key", "depth", "cardinality", "path")]
        got = rows.groupBy("leaf_id").agg(F.count("*").alias("n_rows"), *named, *parts, *ends)
        side = lambda c: F.array(*[f"{c[0]}{i}" for i in range(config.w)]).alias(c)
        return got.select("leaf_id", "root_key", "n_rows", "depth", "cardinality", "path", side("lo"), side("hi"), *(["parts"] if parts else []))

    def _merged(self, leaves: DataFrame) -> DataFrame:
        """Leaves whose rows came at different times, as one row each."""
        w = range(self.config.w)
        ends = [f(F.col(c)[i]).alias(f"{c[0]}{i}") for i in w for c, f in (("lo", F.min), ("hi", F.max))]
        parts = [F.array_sort(F.array_distinct(F.flatten(F.collect_list("parts")))).alias("parts")] if "parts" in leaves.columns else []
        got = leaves.groupBy("leaf_id").agg(F.sum("n_rows").alias("n_rows"), *[F.first(c).alias(c) for c in ("root_key", "depth", "cardinality", "path")], *parts, *ends)
        side = lambda c: F.array(*[f"{c[0]}{i}" for i in w]).alias(c)
        return got.select(leaves.columns[:6] + [side("lo"), side("hi")] + leaves.columns[8:])

    def _write_settings(self, path: str) -> None:
        spark = self.rows.sparkSession
        text = [(str(asdict(self.config)), self.model.to_json() if self.model else "")]
        spark.createDataFrame(text, "config string, model string").coalesce(1).write.mode("overwrite").json(f"{path}/settings")

    def save(self, path: str, covering: bool = True, part_rows: int | None = None) -> None:
        """Write settings, model, rows (``part_rows`` a part) and leaves; without ``covering`` the rows have no raw values (see ``complete``)."""
        known = self.leaves.select("leaf_id", "cardinality", "depth", "path")
        rows = (self.rows if covering else self.rows.drop("values", "vector")).join(known, "leaf_id")
        self._write_rows(rows, path, size=part_rows)
        self._leaves(self._read_rows(rows.sparkSession, path), self.config).write.mode("overwrite").parquet(f"{path}/leaves")
        self._write_settings(path)

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> SeriesIndex:
        import ast

        held = spark.read.schema("config string, model string").json(f"{path}/settings").first()
        settings = ast.literal_eval(held["config"])
        settings["sample"] = tuple(settings["sample"])
        model = SfaModel.from_json(held["model"]) if held["model"] else None
        version = _versions(spark, path)
        leaves = spark.read.parquet(leaves_folder(spark, path))
        # parts of an append that did not finish are in no leaf
        parts = sorted(r["part"] for r in leaves.select(F.explode("parts").alias("part")).distinct().collect())
        starts = [p for i, p in enumerate(parts) if not i or parts[i - 1] != p - 1]
        ends = [p for i, p in enumerate(parts) if i + 1 == len(parts) or parts[i + 1] != p + 1]
        live = F.lit(False)
        for lo, hi in zip(starts, ends, strict=True):
            live |= F.col("part").between(lo, hi)
        rows = cls._read_rows(spark, path).drop("cardinality", "depth", "path").where(live)
        if version:
            # rows of leaves that were split later are dead where they lay
            dead = spark.read.parquet(*[f"{path}/dead-{v}" for v in range(1, version + 1)])
            rows = rows.join(F.broadcast(dead) if dead.count() <= BROADCAST_WORDS else dead, ["leaf_id", "part"], "left_anti")
        return cls(SeriesConfig(**settings), model, rows, leaves, path)

    def complete(self, series: DataFrame) -> SeriesIndex:
        """An index saved without raw values, with them again: ``series`` is what it was built over."""
        fresh = self.summarise(self.prepare(series, self.config), self.config, self.model).select("series_id", "values", "vector")
        # searches go by runs of a leaf's rows
        rows = self.rows.drop("values", "vector").join(fresh, "series_id").repartitionByRange("leaf_id", "series_id").sortWithinPartitions("leaf_id")
        return SeriesIndex(self.config, self.model, rows, self.leaves, self.path)

    # searches as methods; their arguments are those of the functions in ``search``
    def nn(self, queries: DataFrame, **more) -> DataFrame:
        return self.knn(queries, 1, **more)

    def knn(self, queries: DataFrame, k: int = 1, **more) -> DataFrame:
        from .search import knn

        return knn(self, queries, k, **more)

    def approx(self, queries: DataFrame, k: int = 1, **more) -> DataFrame:
        from .search import approximate

        return approximate(self, queries, k, **more)

    def classify(self, queries: DataFrame, labels: DataFrame, k: int = 1, **more) -> DataFrame:
        """(q_id, label, votes) from (series_id, label)."""
        from .search import vote

        return vote(self.knn(queries, k, **more), labels)

    def leaf_for(self, worded: DataFrame) -> DataFrame:
        """Adds leaf_id (null where the word's place in the tree is empty) to rows with word and root_key."""
        keyed = worded.withColumn("word_key", A.packed_hex(F.col("word")))
        words = keyed.groupBy("root_key", "word_key").agg(F.first("word").alias("word"))
        return keyed.join(T.place(words, self.leaves, self.config).select("word_key", "leaf_id"), "word_key").drop("word_key")

    def append(self, series: DataFrame) -> SeriesIndex:
        """Rows added with the existing model. Leaves that outgrow their size are split on from the bits they use; all others keep their rows as they are.

        A stored index is changed where it lies: the new and the moved rows are written as further
        parts, with the new table of leaves and the leaves whose old rows are dead, and count once the last of
        these writes is finished; other handles of it see the state they were loaded with. ``save`` writes a compact
        copy. What is added to an index without a path lies in the shared folder (see ``release``). A series whose id is there already is added as another row.
        """
        spark, config = series.sparkSession, self.config
        folder = f"{self.path or shared_folder(spark)}/append-{uuid.uuid4().hex}"

        def written(df: DataFrame, name: str) -> DataFrame:
            """``df`` as a table of its own, which keeps plans short however many appends there are."""
            df.write.parquet(f"{folder}/{name}")
            return spark.read.schema(df.schema).parquet(f"{folder}/{name}")

        new = written(self.summarise(self.prepare(series, config), config, self.model).withColumn("word_key", A.packed_hex(F.col("word"))), "new")
        counted = new.groupBy("root_key", "word_key").agg(F.first("word").alias("word"), F.count("*").alias("count"))
        full_label = A.leaf_label(F.col("word"), F.col("cardinality"), config.bits)
        placed = written(T.place(counted, self.leaves, config).join(counted.drop("root_key"), "word_key").withColumn("leaf_id", F.coalesce("leaf_id", full_label)), "placed")
        place = ["leaf_id", "root_key", "path", "cardinality", "depth"]
        added = placed.groupBy("leaf_id").agg(F.sum("count").alias("added"), *[F.first(c).alias(c) for c in place[1:]])
        over = written(added.join(self.leaves.select("leaf_id", "n_rows"), "leaf_id", "left").where(F.col("added") + F.coalesce("n_rows", F.lit(0)) > config.leaf_size).select(place), "over")
        few = F.broadcast(over) if over.count() <= BROADCAST_WORDS else over
        # words of the leaves that are too large now, old and new
        old = self.rows.join(few.select("leaf_id"), "leaf_id", "left_semi").withColumn("word_key", A.packed_hex(F.col("word")))
        known = old.groupBy("leaf_id", "word_key").agg(F.first("word").alias("word"), F.count("*").alias("count"))
        both = known.unionByName(placed.join(few.select("leaf_id"), "leaf_id", "left_semi").select(known.columns))
        words = both.groupBy("leaf_id", "word_key").agg(F.first("word").alias("word"), F.sum("count").alias("count")).join(few, "leaf_id")
        nodes = written(words.select("root_key", F.col("path").alias("node"), F.col("cardinality").alias("used"), "depth", "word_key", "word", "count"), "nodes")
        parted = written(split_nodes(nodes, config), "parted")
        columns = [c for c in self.rows.columns if c != "part"]
        stay = placed.join(few.select("leaf_id"), "leaf_id", "left_anti").select(parted.columns)
        arrived = new.join(stay.unionByName(parted), "word_key").select(*columns, "cardinality", "depth", "path")
        moved = old.drop("leaf_id").join(parted, "word_key").select(*columns, "cardinality", "depth", "path")
        fresh, kept = moved.unionByName(arrived), self.leaves.join(few.select("leaf_id"), "leaf_id", "left_anti")
        if self.path is None:
            fresh = written(fresh.repartitionByRange("leaf_id", "series_id").sortWithinPartitions("leaf_id"), "rows")
            leaves = written(self._merged(kept.unionByName(self._leaves(fresh, config))), "leaves")
            rows = self.rows.join(few.select("leaf_id"), "leaf_id", "left_anti").select(columns).unionByName(fresh.select(columns))
            for name in ("new", "placed", "nodes", "parted"):
                remove(spark, f"{folder}/{name}")
            return SeriesIndex(config, self.model, rows, leaves, staged=(*self.staged, folder))
        version = _versions(spark, self.path) + 1
        first = 1 + self._read_rows(spark, self.path).agg(F.max("part")).first()[0]
        self._write_rows(fresh, self.path, first)
        arrived = self._read_rows(spark, self.path).where(F.col("part") >= first)
        self._merged(kept.unionByName(self._leaves(arrived, config))).write.mode("overwrite").parquet(f"{self.path}/leaves-{version}")
        dead = self.leaves.join(few.select("leaf_id"), "leaf_id", "left_semi").select("leaf_id", F.explode("parts").alias("part"))
        dead.write.mode("overwrite").parquet(f"{self.path}/dead-{version}")
        spark.createDataFrame([(version,)], "version int").coalesce(1).write.mode("overwrite").json(f"{self.path}/commit-{version}")
        remove(spark, folder)
        return self.load(spark, self.path)

    def tree_stats(self) -> DataFrame:
        """(subtrees, avg_depth, avg_leaf_size) of roots that were split; null averages if none was."""
        split = self.leaves.groupBy("root_key").agg(F.max("depth").alias("deep")).where("deep > 0").select("root_key")
        inner = self.leaves.join(split, "root_key")
        return inner.agg(F.count_distinct("root_key").alias("subtrees"), F.avg("depth").alias("avg_depth"), F.avg("n_rows").alias("avg_leaf_size"))

    def info(self) -> DataFrame:
        """(records, leaves, roots, word_bytes, data_bytes)."""
        got = self.leaves.agg(F.sum("n_rows").alias("records"), F.count("*").alias("leaves"), F.count_distinct("root_key").alias("roots"))
        return got.select("records", "leaves", "roots", (F.col("records") * self.config.w).alias("word_bytes"), (F.col("records") * self.config.n * 8).alias("data_bytes"))

    def dot(self) -> DataFrame:
        """(line): the leaves below their roots in Graphviz form."""
        edge = F.format_string('"root_%s" -> "%s" [label="%d"];', F.col("root_key").cast("string"), F.col("leaf_id"), F.col("n_rows"))
        return self.leaves.select(edge.alias("line"))

    def wedges(self) -> DataFrame:
        """(leaf_id, lower, upper): pointwise smallest and largest values of each leaf's series."""
        spread = self.rows.select("leaf_id", F.posexplode("values").alias("pos", "x")).groupBy("leaf_id", "pos").agg(F.min("x").alias("l"), F.max("x").alias("u"))
        sides = spread.groupBy("leaf_id").agg(F.array_sort(F.collect_list(F.struct("pos", "l", "u"))).alias("s"))
        return sides.select("leaf_id", F.col("s.l").alias("lower"), F.col("s.u").alias("upper"))


def sorted_load(worded: DataFrame) -> DataFrame:
    """Rows in descending order of their packed word, spread over ranges of it."""
    return worded.withColumn("word_key", A.packed_hex(F.col("word"))).repartitionByRange(F.desc("word_key")).sortWithinPartitions(F.desc("word_key"), "series_id")


def coarsen_step(words: DataFrame, w: int) -> DataFrame:
    """(seg, pages): different words left if one low bit of a segment is dropped. ``words`` has an array column word."""
    cut = lambda i: F.transform("word", lambda s, j: F.when(j == i, F.shiftright(s.cast("int"), 1)).otherwise(s.cast("int")))
    each = words.select(F.explode(F.array(*[F.struct(F.lit(i).alias("seg"), F.array_join(cut(i), ".").alias("word")) for i in range(w)])).alias("x")).select("x.*")
    return each.distinct().groupBy("seg").agg(F.count("*").alias("pages"))


def _dropped(word, drop: list[int]):
    """A word without the given number of low bits of each segment."""
    return F.transform(word, lambda s, j: F.call_function("shiftright", s.cast("int"), F.element_at(F.array(*[F.lit(d) for d in drop]), j + 1)))


def coarsen_rounds(words: DataFrame, w: int, stop) -> list[tuple[int, int]]:
    """(seg, pages) of each round: the segment whose low bit costs most different words, and how many are left; ties to the first.

    All w candidates of a round are counted in one pass over the different words. Rounds go
    on until ``stop(pages, rounds)``; ``pages`` is None before the first.
    """
    different = words.select("word").distinct().persist()
    drop, out = [0] * w, []
    try:
        while not stop(out[-1][1] if out else None, len(out)):
            best = coarsen_step(different.select(_dropped("word", drop).alias("word")).distinct(), w).orderBy("pages", "seg").first()
            if best is None:
                break
            drop[best["seg"]] += 1
            out.append((best["seg"], best["pages"]))
    finally:
        different.unpersist()
    return out


def coarsen(words: DataFrame, w: int, row_bytes: int, page: int = 4096, utilisation: float = 1.2) -> list[int]:
    """Bits to drop from each segment, found greedily, until words share pages well enough."""
    rows, first = words.count(), words.select("word").distinct().count()

    def stop(pages: int | None, rounds: int) -> bool:
        now = first if pages is None else pages
        return now <= 1 or rounds > 8 * w or rows * row_bytes / now / page >= utilisation

    dropped = [0] * w
    for seg, _ in coarsen_rounds(words, w, stop):
        dropped[seg] += 1
    return dropped


def lay_out(worded: DataFrame, dropped: list[int], parts: int) -> DataFrame:
    """Rows with page_key, the coarsened word, sorted by it over ``parts`` ranges: the rows of a page lie together."""
    return worded.withColumn("page_key", F.array_join(F.transform(_dropped("word", dropped), lambda s: F.lpad(F.hex(s), 2, "0")), "")).repartitionByRange(parts, "page_key").sortWithinPartitions("page_key")
