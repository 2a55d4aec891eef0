"""URL filters: host and path rules first, then gradient-boosted trees on lexical features."""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower, release, table

# Fixed values of the contract: (rule, verdict).
RULES = (("org/", "allow"), ("example.org/es/", "block"), ("example.org/en/1", "block"), ("com/fr/", "allow"), ("com/de/", "block"))

_PARTS = r"(?s)^.*?://([^/?#]*)([^?#]*)"
_SHAPE = re.compile(r"(?s)^.*?://([^/?#]*)([^?#]*)(\?[^#]*)?(#.*)?")

#: Parts of the labelled urls; the first is held back from the trees.
FOLDS = 5

FEATURES = ("length", "host_length", "path_length", "depth", "labels", "digit_ratio", "host_digits", "entropy", "host_entropy", "parameters", "query_length", "fragment", "hyphens", "longest_label", "suffix_rate", "suffix_seen")


def host_of(url: Column) -> Column:
    return ascii_lower(F.coalesce(F.regexp_extract(url, _PARTS, 1), F.lit("")))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, _PARTS, 2), F.lit(""))


def rule_of(host: Column, path: Column, rules) -> Column:
    """The longest rule that fits, or null: its host or a subdomain, and a path that starts with its path."""
    out = F.lit(None).cast("string")
    for rule, _ in sorted(rules, key=lambda r: len(r[0])):
        at = rule.index("/")
        fits = ((host == rule[:at]) | host.endswith("." + rule[:at])) & path.startswith(rule[at:])
        out = F.when(fits, F.lit(rule)).otherwise(out)
    return out


def _entropy(text: str) -> float:
    n = len(text)
    return -sum(c / n * math.log2(c / n) for c in map(text.count, set(text))) if n else 0.0


def _suffix(host: str) -> str:
    return ".".join(host.split(".")[-2:])


def _suffix_rates(urls: list[str], y: np.ndarray, mean: float) -> dict[str, tuple[float, float]]:
    """Smoothed block rate and log count of each host suffix; of '' the mean."""
    groups: dict[str, list[float]] = {}
    for u, v in zip(urls, y, strict=True):
        m = _SHAPE.match(u)
        groups.setdefault(_suffix(m[1].lower() if m else ""), []).append(v)
    return {s: ((sum(v) + 10 * mean) / (len(v) + 10), math.log1p(len(v))) for s, v in groups.items() if s} | {"": (mean, 0.0)}


def lexical(url: str, suffixes: dict[str, tuple[float, float]]) -> list[float]:
    """The features of one url, in the order of FEATURES. ``suffixes``: smoothed block rate and log count of host suffixes."""
    m = _SHAPE.match(url)
    host, path, query, fragment = (m[1].lower(), m[2], m[3] or "", m[4] or "") if m else ("", "", "", "")
    n = len(url)
    rate, seen = suffixes.get(_suffix(host), suffixes[""])
    return [
        n, len(host), len(path), path.count("/"), host.count(".") + 1,
        sum(map(str.isdigit, url)) / n if n else 0.0, sum(map(str.isdigit, host)), _entropy(url), _entropy(host),
        query.count("&") + 1 if len(query) > 1 else 0, len(query), len(fragment), url.count("-"),
        max(map(len, host.split("."))), rate, seen,
    ]


class UrlModel:
    """Boosted regression trees on binned features, logistic loss, in numpy.

    ``fit`` takes urls and 0/1 labels (1: block). With no labels, labels of one kind, or labels that the
    urls do not tell, the model is that constant rate (0 without labels).
    """

    def __init__(self, trees: int = 40, depth: int = 4, rate: float = 0.2, bins: int = 48, least: int = 20, seed: int = 3):
        self.trees, self.depth, self.rate, self.bins, self.least, self.seed = trees, depth, rate, bins, least, seed
        self.base, self.forest, self.suffixes = -20.0, [], {"": (0.5, 0.0)}

    def fit(self, urls: list[str], labels: list[int]) -> UrlModel:
        """A suffix's rate in a row's features comes from other rows only. A fifth of the rows is held
        back: trees are kept up to the round of least loss there, and none are
        if that is not clearly less than the loss of the constant rate."""
        y = np.asarray(labels, dtype=np.float64)
        if not len(y):
            return self
        mean = float(y.mean())
        self.base = math.log((mean + 1e-9) / (1 - mean + 1e-9))
        self.suffixes = _suffix_rates(urls, y, mean)
        if not 0 < mean < 1:
            return self
        fold = np.random.default_rng(self.seed).permutation(len(y)) % FOLDS
        x = np.empty((len(y), len(FEATURES)))
        for f in range(FOLDS):
            known = _suffix_rates([u for u, g in zip(urls, fold, strict=True) if g != f], y[fold != f], mean)
            for i in np.flatnonzero(fold == f):
                x[i] = lexical(urls[i], known)
        held = fold == 0
        if held.all() or not held.any():
            return self
        edges = [np.unique(np.quantile(x[~held, j], np.linspace(0, 1, self.bins + 1)[1:-1])) for j in range(x.shape[1])]
        binned = np.stack([np.searchsorted(e, x[~held, j], side="left") for j, e in enumerate(edges)], axis=1)
        score, forest = np.full(len(y), self.base), []
        loss = lambda: np.logaddexp(0, np.where(y[held] > 0, -score[held], score[held]))
        constant = loss()
        losses = []
        for _ in range(self.trees):
            p = 1 / (1 + np.exp(-score[~held]))
            tree = self._grow(binned, y[~held] - p, p * (1 - p), edges)
            forest.append(tree)
            score += self._apply(tree, x)
            losses.append(loss())
        best = int(np.argmin([v.mean() for v in losses]))
        gain = constant - losses[best]
        if gain.mean() > 2 * gain.std() / math.sqrt(len(gain)):
            self.forest = forest[: best + 1]
        return self

    def _grow(self, binned, gradient, hessian, edges):
        """Level by level; arrays of (feature, threshold, leaf value) by heap position."""
        size = 2 ** (self.depth + 1)
        feature, threshold, value = np.full(size, -1), np.zeros(size), np.zeros(size)
        node = np.ones(len(gradient), dtype=np.int64)
        for at in range(1, size):
            rows = np.flatnonzero(node == at)
            if not len(rows):
                continue
            g, h = gradient[rows], hessian[rows]
            value[at] = self.rate * g.sum() / (h.sum() + 1.0)
            if at >= size // 2 or len(rows) < 2 * self.least:
                continue
            best = (1e-6, -1, 0)
            for j, e in enumerate(edges):
                if len(e):
                    b = binned[rows, j]
                    n, sg, sh = (np.cumsum(np.bincount(b, w, len(e) + 1))[:-1] for w in (None, g, h))
                    gain = sg**2 / (sh + 1) + (g.sum() - sg) ** 2 / (h.sum() - sh + 1) - g.sum() ** 2 / (h.sum() + 1)
                    gain[(n < self.least) | (len(rows) - n < self.least)] = -1
                    k = int(np.argmax(gain))
                    if gain[k] > best[0]:
                        best = (float(gain[k]), j, k)
            if best[1] >= 0:
                feature[at], threshold[at] = best[1], edges[best[1]][best[2]]
                node[rows] = 2 * at + (binned[rows, best[1]] > best[2])
        return feature, threshold, value

    def _apply(self, tree, x):
        feature, threshold, value = tree
        at = np.ones(len(x), dtype=np.int64)
        for _ in range(self.depth):
            f = feature[at]
            inner = f >= 0
            right = x[np.arange(len(x)), np.maximum(f, 0)] > threshold[at]
            at = np.where(inner, 2 * at + right, at)
        return value[at]

    def score(self, urls: list[str]) -> np.ndarray:
        """Probability of block."""
        total = np.full(len(urls), self.base)
        if self.forest and urls:
            x = np.array([lexical(u, self.suffixes) for u in urls], dtype=np.float64)
            for tree in self.forest:
                total += self._apply(tree, x)
        return 1 / (1 + np.exp(-total))


def train(labelled: DataFrame, *, max_rows: int = 20_000) -> UrlModel:
    """Fit on (url, blocked): the ``max_rows`` rows of smallest url hash, a bounded sample of the labelled urls."""
    rows = labelled.where("url is not null and blocked is not null").select("url", F.col("blocked").cast("int").alias("blocked"))
    sample = rows.orderBy(F.xxhash64("url"), "url", "blocked").limit(max_rows).collect()
    return UrlModel().fit([r["url"] for r in sample], [r["blocked"] for r in sample])


def judge_urls(pages: DataFrame, model: UrlModel, rules=RULES, *, id_col: str = "page_id", url_col: str = "url", threshold: float = 0.5) -> DataFrame:
    """Judge every url by the rules, and where none fits by the model.

    Returns (page_id, host, path, rule or null, verdict, score): score is the model's probability of
    block, verdict the rule's or else block at ``threshold`` and above. A null url or
    one without :// has an empty host and path and is judged as the empty or given
    string by the model. Repeated rows and ids are judged one by one. Other columns of the
    input are ignored. An empty table gives no rows.
    """
    url = F.col("_url")
    rows = pages.select(F.col(id_col).alias("page_id"), F.coalesce(F.col(url_col).cast("string"), F.lit("")).alias("_url"))
    rows = rows.select("page_id", "_url", host_of(url).alias("host"), path_of(url).alias("path"))

    @F.pandas_udf("double")
    def score(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for part in parts:
            yield pd.Series(model.score(part.tolist()))
        release()

    rows = rows.select("page_id", "host", "path", rule_of(F.col("host"), F.col("path"), rules).alias("rule"), score(url).alias("score"))
    verdict = F.when(F.col("score") >= threshold, F.lit("block")).otherwise(F.lit("allow"))
    for rule, says in rules:
        verdict = F.when(F.col("rule") == rule, F.lit(says)).otherwise(verdict)
    return rows.select("page_id", "host", "path", "rule", verdict.alias("verdict"), "score")


def op1_url_filter(spark, sf_dir: str) -> DataFrame:
    """Pages are labelled through the document whose id their url carries: block low quality or toxic ones."""
    pages = table(spark, sf_dir, "pages")
    labels = table(spark, sf_dir, "labels").groupBy("doc_id").agg(F.max(((F.col("quality") == 0) | (F.col("toxic") == 1)).cast("int")).alias("blocked"))
    labelled = pages.select("url", F.regexp_extract("url", r"://[^/?#]*/[^?#]*?([0-9]+)", 1).try_cast("long").alias("doc_id")).join(labels, "doc_id")
    return judge_urls(pages, train(labelled))
