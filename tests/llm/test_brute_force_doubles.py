"""Independent second computations of what SQL cannot say."""

import hashlib
import math

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from wavekin.llm import common, mixing, pii, secrets, urls


def test_hosts_paths_and_rules_of_all_pages(spark, small):
    def parts(url):
        if url is None or "://" not in url:
            return "", ""
        rest = url.split("://", 1)[1]
        cut = min([i for i in (rest.find(c) for c in "/?#") if i >= 0], default=len(rest))
        host, tail = rest[:cut], rest[cut:]
        end = min([i for i in (tail.find(c) for c in "?#") if i >= 0], default=len(tail))
        return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in host), tail[:end]

    pages = spark.read.parquet(f"{small}/pages.parquet")
    got = {r["page_id"]: r for r in urls.op1_url_filter(spark, small).collect()}
    rows = pages.select("page_id", "url").collect()
    assert len(got) == len(rows)
    for page, url in rows:
        host, path = parts(url)
        fits = [(rule, says) for rule, says in urls.RULES if (host == rule.split("/")[0] or host.endswith("." + rule.split("/")[0])) and path.startswith(rule[rule.index("/"):])]
        rule, says = max(fits, key=lambda r: len(r[0]), default=(None, None))
        r = got[page]
        assert (r["host"], r["path"], r["rule"]) == (host, path, rule)
        assert r["verdict"] == (says or ("block" if r["score"] >= 0.5 else "allow"))


def test_urls_of_edge_cases(spark):
    rows = [(1, None), (1, None), (2, ""), (3, "http://" + "a" * 50_000 + ".org/x" * 1000), (4, "HTTP://É.Example.ORG/es/"), (None, "https://b.com/fr/?q#f")]
    table = spark.createDataFrame([(*r, "x", 1, 0.5) for r in rows], "page_id long, url string, host string, path long, score double")
    got = urls.judge_urls(table, urls.UrlModel()).collect()
    assert len(got) == len(rows) and [r["rule"] for r in got if r["page_id"] == 4] == ["example.org/es/"]
    assert urls.judge_urls(table.limit(0), urls.UrlModel()).count() == 0


def test_labels_that_urls_do_not_tell_leave_the_base_rate():
    rng = np.random.default_rng(5)
    links = [f"https://site{rng.integers(20)}.example/{rng.integers(1e6)}" for _ in range(900)]
    labels = (rng.random(900) < 0.25).astype(int).tolist()
    model = urls.UrlModel().fit(links, labels)
    assert (model.score(links) < 0.5).mean() > 0.97
    told = urls.UrlModel().fit([u + ("?id=1&x=2" if v else "") for u, v in zip(links, labels, strict=True)], labels)
    assert ((told.score([u + "?id=1&x=2" for u in links[:50]]) > 0.5).all()) and (told.score(links[:50]) < 0.5).all()


def test_multipliers_solve_the_dual(spark):
    rng = np.random.default_rng(6)
    sizes = {s: np.sort(rng.integers(1, 400, size=n)) for s, n in enumerate((40, 300, 7, 90))}
    goals = {0: 0.4, 1: 1.0, 2: 2.9, 3: 1.7}
    hist = spark.createDataFrame([(s, int(v), int(n)) for s, x in sizes.items() for v, n in zip(*np.unique(x, return_counts=True), strict=True)], "sid int, size long, n long")
    facts = pd.DataFrame([(s, str(s), int(x.sum()), goals[s] * float(x.sum()), float(x.mean())) for s, x in sizes.items()], columns=["sid", "source", "total", "target", "mean"])
    got = mixing._solve(hist, facts, 3, 1e-10, 60)
    for s, x in sizes.items():
        words = lambda lam, x=x: (x * np.minimum(3, np.exp(lam * x / x.mean()))).sum()
        low, high = -50.0, 50.0
        for _ in range(200):
            mid = (low + high) / 2
            low, high = (mid, high) if words(mid) < goals[s] * x.sum() else (low, mid)
        assert math.isclose(got[s], low, rel_tol=1e-5, abs_tol=1e-6)


def test_taken_words_come_near_the_target(spark, small):
    """Within the shortest document's size, or a hundredth of the target in sources of ten documents, whose whole copies reach few sums."""
    sources = spark.read.parquet(f"{small}/documents.parquet").select("doc_id", F.coalesce("source", F.lit("none")).alias("source"))
    rows = mixing.op5_mix(spark, small).join(sources, "doc_id").toPandas()
    for _, part in rows[rows["size"] > 0].groupby("source"):
        assert abs(part["taken"].sum() - part["target"].iloc[0]) <= max(part["size"].min() + 1, 0.01 * part["target"].iloc[0])


def test_feistel_permutes_as_in_python(spark):
    def permuted(a, b, size_a, size_b, key, tag):
        digest = lambda i, half: int(hashlib.sha256(f"{key}|{tag}|{i}|{half}".encode()).hexdigest()[:15], 16)
        for i in range(2 * pii.ROUNDS):
            if i % 2 == 0:
                a = (a + digest(i, b) % size_a) % size_a
            else:
                b = (b + digest(i, a) % size_b) % size_b
        return a, b

    pairs = spark.range(7).select(F.col("id").alias("a")).crossJoin(spark.range(11).select(F.col("id").alias("b")))
    got = {(r["a"], r["b"]): (r["p"]["a"], r["p"]["b"]) for r in pairs.select("a", "b", pii.feistel(F.col("a"), F.col("b"), 7, 11, "k", "t").alias("p")).collect()}
    assert len(set(got.values())) == 77
    assert got == {(a, b): permuted(a, b, 7, 11, "k", "t") for a in range(7) for b in range(11)}


def test_many_candidates_in_one_text(spark):
    rng = np.random.default_rng(7)
    letters = list("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789")
    words = ["".join(rng.choice(letters, 33)) for _ in range(700)]
    row = secrets.scan_secrets(spark.createDataFrame([(1, " ".join(words))], "doc_id long, text string")).first()
    spans = [tuple(map(int, s.split(":")[1:])) for s in row["spans"].split(",") if s.startswith("entropy")]
    assert len(spans) >= 690 and all(a // 34 == (b - 1) // 34 and b - a >= 20 for a, b in spans)


def test_what_is_staged_in_passing_is_deleted(spark):
    import os

    with common.passing(spark) as keep:
        a = common.stage(spark.range(3), "a")
        with common.passing(spark) as keep_inner:
            common.stage(spark.range(4), "b")
            b = keep_inner(common.stage(spark.range(5), "b"))
        c = keep(common.stage(a.union(b), "c"))
    assert c.count() == 8
    assert [os.path.exists(t.staged_path) for t in (a, b, c)] == [False, False, True]
