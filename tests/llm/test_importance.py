"""Importance resampling against a second computation without Spark, word by word."""

import hashlib
import math
import re
import zlib
from collections import Counter

import pyarrow as pa
import pytest

from wavekin.llm import importance

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def features(text):
    words = WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    return len(words), [zlib.crc32(" ".join(words[i : i + n]).encode()) % 10000 for n in (1, 2, 3) for i in range(len(words) - n + 1)]


def brute_force(docs, target, percent=5, least=20):
    """(doc_id, n_features, weight, score, rank) of (doc_id, text) rows."""
    s, t = (Counter(b for _, text in rows for b in features(text)[1]) for rows in (docs, target))
    s_all, t_all = sum(s.values()), sum(t.values())
    gain = [math.floor(1000 * math.log((t[b] + 1.0) * (s_all + 10000.0) / ((s[b] + 1.0) * (t_all + 10000.0)))) for b in range(10000)]
    rows = []
    for doc_id, text in docs:
        n, found = features(text)
        h = int(hashlib.sha256(f"42:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
        weight = sum(gain[b] for b in found)
        rows.append([doc_id, len(found), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None, n])
    long_ = sorted((r for r in rows if r[5] >= least), key=lambda r: (-r[3], r[0] is None, r[0] or 0, -r[1]))
    for i, r in enumerate(long_[: len(long_) * percent // 100]):
        r[4] = i + 1
    return sorted((tuple(r[:5]) for r in rows), key=repr)


def collected(df):
    return sorted((tuple(r) for r in df.select("doc_id", "n_features", "weight", "score", "rank").collect()), key=repr)


def test_all_documents_equal_brute_force(spark, small):
    docs, target = (spark.read.parquet(f"{small}/{t}.parquet") for t in ("documents", "benchmark"))
    want = brute_force([tuple(r) for r in docs.select("doc_id", "text").collect()], [(None, r["text"]) for r in target.select("text").collect()])
    assert collected(importance.op13_importance_resampling(spark, small)) == want


@pytest.mark.parametrize("percent", [5, 50, 100])
def test_edge_cases_ties_and_repeated_rows(spark, edge_docs, percent):
    rows = [(r["doc_id"], r["text"]) for r in edge_docs.select("doc_id", "text").collect()]
    same = " ".join(f"v{i}" for i in range(25))
    more = [(d, same) for d in (30, 31, 31, 31, None, None, -5, 2**62, -(2**62))]
    docs = edge_docs.select("doc_id", "text", "size", "score" if "score" in edge_docs.columns else "node").unionByName(
        spark.createDataFrame([(d, t, 1, 2) for d, t in more], "doc_id long, text string, size long, node long"))
    target = spark.createDataFrame([("x", None, 1), ("y", "", 2), ("z", "v1 v2 V3 quick brown", 3)], "item_id string, text string, weight int")
    got = collected(importance.resample(docs, target, percent=percent, least_words=5))
    assert got == brute_force(rows + more, [(None, None), (None, ""), (None, "v1 v2 V3 quick brown")], percent, 5)


def test_empty_tables(spark, edge_docs, no_docs):
    target = spark.createDataFrame([("z", "a b c")], "item_id string, text string")
    assert importance.resample(no_docs, target).count() == 0
    got = importance.resample(edge_docs, target.limit(0)).collect()
    assert len(got) == edge_docs.count() and all(r["weight"] == 0 for r in got if r["n_features"] == 0)


def test_buckets_of_joined_words_equal_crc32():
    texts = ["", None, "a", "É è 日本 x" + "y" * 700 + " Z9 " + "q" * 300, " one  two\nthree-four "]
    found = importance.Features(pa.array(texts, pa.string()))
    for i, text in enumerate(texts):
        mine = sorted(int(b) for o, bs in zip(found.owner, found.buckets, strict=True) for b in bs[o == i])
        assert mine == sorted(features(text)[1])


def test_kth_key_parts_rows_by_the_whole_key(spark):
    rows = [(i % 7 * 10**15, (i * 37) % 50 - 25, i % 3) for i in range(400)]
    df = spark.createDataFrame(rows, "score long, doc_id long, n_features long").persist()
    ordered = sorted(rows, key=lambda r: (-r[0], r[1], -r[2]))
    for k in (1, 57, 200, 400):
        before, same, left, equal = importance.kth_key(df, k)
        assert sorted(map(tuple, df.where(same).collect())) == [ordered[k - 1]] * equal
        assert df.where(before).count() + left == k
