"""Proximity matches end to end, for every size of the dictionary."""

import hashlib

import numpy as np
import pytest

from wavekin.llm import decontam


def brute_near(docs, items, span, window=decontam.WINDOW):
    """doc_id -> n_near of (doc_id, text) and (item, text) rows."""
    texts = [(i, decontam.words_of(t)) for i, t in docs]
    frequency = {}
    for _, words in texts:
        for w in words:
            frequency[w] = frequency.get(w, 0) + 1
    found = decontam.phrases([(i, decontam.words_of(t)) for i, t in items], window)
    out = {}
    for doc, words in texts:
        at = {}
        for p, w in enumerate(words):
            at.setdefault(w, []).append(p)
        near = set()
        for phrase, owners in found.items():
            (_, first, _), *rest = sorted((frequency.get(w, 0), w, o) for o, w in enumerate(phrase))[:3]
            if any(all(any(abs(x - p) < span for x in at.get(w, ())) for _, w, _ in rest) for p in at.get(first, ())):
                near |= owners
        out[doc] = len(near)
    return out


@pytest.mark.parametrize("vocabulary", [3, 1_000_000])
def test_foreign_words_inside_phrases(spark, vocabulary):
    phrase = [f"w{i}" for i in range(10)]
    texts = [" ".join([*phrase[:5], "zz", *phrase[5:]]), " ".join(reversed(phrase)), " ".join(phrase), " zz ".join(phrase), (" zz" * 30).join(phrase), "w0", None]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    bench = spark.createDataFrame([("a", " ".join(phrase), 1, "x")], "item_id string, text string, doc_id long, n_near string")
    got = {r["doc_id"]: r for r in decontam.decontaminate(docs, bench, vocabulary=vocabulary, span=20).collect()}
    assert [got[i]["n_near"] for i in range(7)] == [1, 1, 1, 1, 0, 0, 0] == list(brute_near(list(enumerate(texts)), [("a", " ".join(phrase))], 20).values())
    assert [got[i]["n_hit"] for i in range(7)] == [0, 0, 10, 0, 0, 0, 0]


@pytest.mark.parametrize("span", [4, 9, 20])
def test_near_items_end_to_end(spark, span, monkeypatch):
    rng = np.random.default_rng(12)
    draw = lambda n: " ".join(f"w{int(x)}" for x in rng.zipf(1.2, size=n) % 90)
    items = [(str(i), draw(int(rng.integers(1, 30)))) for i in range(25)]
    docs = [(i, draw(int(rng.integers(0, 120)))) for i in range(60)]
    for i, (_, text) in enumerate(items):
        words = text.split()
        for p in sorted(rng.choice(len(words) + 1, size=3), reverse=True):
            words.insert(int(p), "foreign")
        docs.append((100 + i, draw(8) + " " + " ".join(words) + " " + draw(8)))
    docs += [(200 + i, docs[i % 60][1]) for i in range(30)]
    d, b = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id string, text string")
    want = brute_near(docs, items, span)
    rows = [sorted(map(tuple, decontam.decontaminate(d, b, vocabulary=v, span=span).collect())) for v in (3, 1_000_000)]
    monkeypatch.setattr(decontam, "TRIPLES", 0)
    rows.append(sorted(map(tuple, decontam.decontaminate(d, b, span=span).collect())))
    assert rows[0] == rows[1] == rows[2]
    got = {r[0]: r[-1] for r in rows[0]}
    assert got == want and 0 < sum(v > 0 for v in want.values()) < len(docs)


def test_query_counts_near_items_of_all_documents(spark, small):
    docs, bench = (spark.read.parquet(f"{small}/{t}.parquet") for t in ("documents", "benchmark"))
    want = brute_near([tuple(r) for r in docs.select("doc_id", "text").collect()], [tuple(r) for r in bench.select("item_id", "text").collect()], decontam.SPAN)
    got = decontam.op6_decontaminate(spark, small).collect()
    assert {r["doc_id"]: r["n_near"] for r in got} == want
    assert {r["items_sha256"] for r in got if not r["n_items"]} <= {hashlib.sha256(b"").hexdigest()}


def test_postings_near_a_first_term():
    terms, positions = np.array([0, 1, 2, 1, 0, 1]), np.array([0, 3, 5, 9, 30, 31])
    first, rare = np.array([False, False, True]), np.array([False, True, True])
    assert decontam.near_first(terms, positions, first, rare, 4).tolist() == [False, True, True, False, False, False]
    assert decontam.near_first(terms, positions, first, rare, 5).tolist() == [False, True, True, True, False, False]
    assert not decontam.near_first(terms[:2], positions[:2], first, rare, 5).any()
    triples = np.array([[2, 1, -1]])
    assert decontam.in_triples(terms, positions, triples, 4).tolist() == [False, True, True, False, False, False]
    assert decontam.in_triples(terms, positions, np.array([[2, 1, 0]]), 5).tolist() == [False] * 6
    assert decontam.in_triples(terms, positions, np.array([[0, -1, -1], [2, 1, 0]]), 6).tolist() == [True, True, True, True, True, False]
    assert decontam.in_runs(np.array([0, 0, 0, 1]), np.array([1, 2, 4, 5]), np.array([2, 3])).tolist() == [True, True, True, False]
