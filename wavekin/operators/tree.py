"""Places of words in the split tree, and the bottom-up way to its leaves.

A leaf's path names the splits above it, one ``/segment.bit`` each. The inner nodes are the
proper prefixes of the paths, so the table of leaves is the whole tree.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import SeriesConfig
from ..functions import arrays as A

#: Leaves whose tree is broadcast, at most; more meet the words in a shuffle by root.
BROADCAST_LEAVES = 50_000
#: Parts over which the words of a root are spread in that shuffle.
SALTS = 8


def label_of(word: np.ndarray, used: np.ndarray, bits: int) -> str:
    return "_".join(f"{s >> (bits - c)}.{c}" for s, c in zip(word.tolist(), used.tolist(), strict=True))


class Tree:
    """Inner nodes (root_key, path) -> segment, and leaves (root_key, path) -> leaf_id."""

    def __init__(self, leaves: Iterable[tuple[int, str, str]]):
        self.segment: dict[tuple[int, str], int] = {}
        self.leaf: dict[tuple[int, str], str] = {}
        for root, path, leaf in leaves:
            self.leaf[root, path] = leaf
            at = ""
            for step in path.split("/")[1:]:
                self.segment[root, at] = int(step.split(".", 1)[0])
                at = f"{at}/{step}"

    def descend(self, root: int, words: np.ndarray, bits: int) -> Iterator[tuple[np.ndarray, str, np.ndarray, int]]:
        """(rows of ``words``, path, bits used by segment, depth) of the places where words of one root end, leaves or empty ones."""
        todo = [("", np.arange(len(words)), np.ones(words.shape[1], dtype=np.int64), 0)]
        while todo:
            path, rows, used, depth = todo.pop()
            seg = self.segment.get((root, path))
            if seg is None:
                yield rows, path, used, depth
                continue
            bit = (words[rows, seg] >> (bits - used[seg] - 1)) & 1
            deeper = used.copy()
            deeper[seg] += 1
            todo += [(f"{path}/{seg}.{b}", rows[bit == b], deeper, depth + 1) for b in (0, 1) if (bit == b).any()]


_PLACED = "root_key long, word_key string, leaf_id string, path string, cardinality array<int>, depth int"


def _place(tree: Tree, root: int, pdf: pd.DataFrame, bits: int) -> Iterator[pd.DataFrame]:
    words, keys = np.stack(pdf["word"].to_numpy()).astype(np.int64), pdf["word_key"].to_numpy()
    for rows, path, used, depth in tree.descend(root, words, bits):
        n = len(rows)
        yield pd.DataFrame({"root_key": root, "word_key": keys[rows], "leaf_id": [tree.leaf.get((root, path))] * n, "path": path, "cardinality": [used] * n, "depth": depth})


def place(words: DataFrame, leaves: DataFrame, config: SeriesConfig) -> DataFrame:
    """(root_key, word_key, leaf_id, path, cardinality, depth) of different words (root_key, word_key, word): the leaf each falls in, or leaf_id null and the empty place's path."""
    words, named = words.select("root_key", "word_key", "word"), leaves.select("root_key", "path", "leaf_id")
    if leaves.count() <= BROADCAST_LEAVES:
        held = words.sparkSession.sparkContext.broadcast([(r["root_key"], r["path"], r["leaf_id"]) for r in named.collect()])

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            tree = None
            for pdf in batches:
                tree = tree or Tree(held.value)
                for root, part in pdf.groupby("root_key"):
                    yield from _place(tree, int(root), part, config.bits)

        return words.mapInPandas(run, _PLACED)

    none = lambda kind, name: F.lit(None).cast(kind).alias(name)
    tree_rows = named.select("root_key", none("string", "word_key"), none("array<short>", "word"), "path", "leaf_id", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    salt = F.pmod(F.xxhash64("word_key"), F.lit(SALTS)).cast("int").alias("salt")
    both = tree_rows.unionByName(words.select("root_key", "word_key", F.col("word").cast("array<short>").alias("word"), none("string", "path"), none("string", "leaf_id"), salt))
    # a root's leaves come first, then its words, which pass by
    sorted_ = both.repartition("root_key", "salt").sortWithinPartitions("root_key", "salt", F.col("word_key").isNotNull())

    def stream(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known, at, tree = [], None, None
        for pdf in batches:
            for key, part in pdf.groupby(["root_key", "salt"], sort=False):
                if key != at:
                    known, at, tree = [], key, None
                own = part["word_key"].isna()
                known += list(part.loc[own, ["root_key", "path", "leaf_id"]].itertuples(index=False, name=None))
                asked = part[~own]
                if len(asked):
                    tree = tree or Tree(known)
                    yield from _place(tree, int(key[0]), asked, config.bits)

    return sorted_.mapInPandas(stream, _PLACED)


def interleaved(config: SeriesConfig):
    """Column of a word's bits as text: the first bits of all segments, then the second ones, and so on."""
    w, top = config.w, config.bits - 1
    return F.array_join(F.transform(F.sequence(F.lit(0), F.lit(w * config.bits - 1)), lambda k: (F.call_function("shiftright", F.element_at("word", (k % w + 1).cast("int")).cast("int"), (F.lit(top) - F.floor(k / w)).cast("int")).bitwiseAND(1)).cast("string")), "")


def cut_sorted(keys: np.ndarray, counts: np.ndarray, start: int, leaf_size: int) -> list[tuple[int, int, int]]:
    """(first, end, prefix length) of the leaves of one node's sorted keys (rows of bits) that share their first ``start`` bits.

    A leaf is a shortest prefix whose words have at most ``leaf_size`` rows, or a single word.
    """
    total = np.concatenate([[0], np.cumsum(counts)])
    todo, out = [(0, len(keys), start)], []
    while todo:
        lo, hi, length = todo.pop()
        if total[hi] - total[lo] <= leaf_size or hi - lo == 1:
            out.append((lo, hi, length))
            continue
        # the bits of one place are 0s, then 1s
        mid = lo + int(np.searchsorted(keys[lo:hi, length], 1))
        todo += [(a, b, length + 1) for a, b in ((lo, mid), (mid, hi)) if a < b]
    return out


def leaf_of_sorted(words: DataFrame, config: SeriesConfig, limit: int) -> DataFrame:
    """(word_key, leaf_id, cardinality, depth, path) of distinct (root_key, word_key, word, count), cut from the words in key order.

    For the rule 'cyclic', whose splits follow the interleaved bits: a leaf is a range of
    the sorted words. Ranges of tasks begin and end at nodes of at most ``limit`` words; larger nodes
    are made smaller by counting words by one more bit at a time.
    """
    if config.split != "cyclic":
        raise ValueError("a sorted load needs the split rule 'cyclic'")
    w, bits, size = config.w, config.bits, config.leaf_size
    keyed = words.withColumn("key", interleaved(config))
    node, length, large = F.substring("key", 1, w), w, None
    while length < w * bits:
        here = keyed if large is None else keyed.where(F.substring("key", 1, length - 1).isin(large))
        counted = here.groupBy(F.substring("key", 1, length).alias("p")).agg(F.count("*").alias("n"), F.sum("count").alias("rows"))
        large = [r["p"] for r in counted.where((F.col("n") > limit) & (F.col("rows") > size)).collect()]
        if not large:
            break
        node = F.when(F.substring("key", 1, length).isin(large), F.substring("key", 1, length + 1)).otherwise(node)
        length += 1

    def leaves(part: pd.DataFrame) -> pd.DataFrame:
        matrix = np.stack(part["word"].to_numpy()).astype(np.int64)
        keys = np.frombuffer("".join(part["key"]).encode(), dtype=np.uint8).reshape(len(part), -1) - 48
        leaf, cards, depths, paths = [None] * len(part), [None] * len(part), np.zeros(len(part), dtype=np.int32), [None] * len(part)
        for lo, hi, n in cut_sorted(keys, part["count"].to_numpy(), len(part["node"].iloc[0]), size):
            used = np.array([1 + (n - w) // w + (i < (n - w) % w) for i in range(w)])
            path = "".join(f"/{k % w}.{keys[lo, k]}" for k in range(w, n))
            leaf[lo:hi], cards[lo:hi], paths[lo:hi] = [label_of(matrix[lo], used, bits)] * (hi - lo), [used] * (hi - lo), [path] * (hi - lo)
            depths[lo:hi] = n - w
        return pd.DataFrame({"word_key": part["word_key"].to_numpy(), "leaf_id": leaf, "cardinality": cards, "depth": depths, "path": paths})

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = None
        for pdf in batches:
            pdf = pdf if held is None else pd.concat([held, pdf], ignore_index=True)
            if not len(pdf):
                continue
            last = pdf["node"] == pdf["node"].iloc[-1]
            for _, part in pdf[~last].groupby("node", sort=False):
                yield leaves(part)
            held = pdf[last]
        if held is not None and len(held):
            yield leaves(held)

    ranges = keyed.withColumn("node", node).repartitionByRange("node").sortWithinPartitions("key")
    return ranges.select("node", "key", "word_key", "word", "count").mapInPandas(run, "word_key string, leaf_id string, cardinality array<int>, depth int, path string")
