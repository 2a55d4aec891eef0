"""Language identification: averaged hashed subword embeddings, a linear softmax, calibrated rejection."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import release, remove, small_batches, stage, table

BUCKETS, DIM = 1 << 16, 16
#: Lengths in bytes of the subwords. A blank may begin or end one, so they tell a word's ends from its inside.
LENGTHS = (1, 2, 3, 4, 5)
#: Bytes of text taken at a time.
PIECE = 1 << 18
#: Share of the sample kept from training, for temperature and rejection.
CALIBRATION = 0.25
#: Share of calibration texts that rejection may cost.
REJECTED = 0.002
#: Languages whose counts are broadcast, at most.
BROADCAST_LANGS = 100_000
#: Length classes, powers of 2 of subwords.
SIZES = 24
#: Calibration texts that a floor needs; it lies FLOOR_REACH times as far below their median as the FLOOR_SHARE least typical of them begin.
LEAST_FLOOR, FLOOR_SHARE, FLOOR_REACH = 20, 0.05, 9.0
#: Subwords up to which a text counts as short where calibration has too few of its length.
SHORT = 64

_U = np.uint32
_BLANK = bytes(b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
#: Letters and, among others, numerals such as fractions; which of the two is asked of each.
_WORDY = re.compile(r"[^\W\d_]")
_TERMS = (np.arange(1, 6, dtype=_U) * _U(0x9E3779B1)) | _U(1)


def _pieces(texts: list[str]) -> Iterator[tuple[bytes, np.ndarray]]:
    """(bytes, text number of each byte), about PIECE bytes at a time; long texts are spread over several."""
    parts, owners, size = [b"  "], [(0, 2)], 2
    for i, text in enumerate(texts):
        raw = text.lower().encode("utf-8", "surrogatepass").translate(_BLANK)
        for lo in range(0, len(raw), PIECE):
            part = raw[lo : lo + PIECE] + b"  "
            parts.append(part)
            owners.append((i, len(part)))
            size += len(part)
            if size >= PIECE:
                yield b"".join(parts), np.repeat(*np.array(owners).T)
                parts, owners, size = [b"  "], [(i, 2)], 2
    yield b"".join(parts), np.repeat(*np.array(owners).T)


def subwords(texts: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(bucket, text number) of all subwords of the texts, in several arrays."""
    for blob, owner in _pieces(texts):
        data = np.frombuffer(blob, np.uint8)
        blank = data == 32
        for n in LENGTHS:
            m = len(data) - n + 1
            if m <= 0:
                continue
            bad = blank[:m] & blank[n - 1 :]
            code = np.full(m, n * 0x85EBCA6B & 0xFFFFFFFF, dtype=_U)
            for j in range(n):
                code = (code ^ data[j : j + m]) * _TERMS[j]
                code ^= code >> _U(15)
                if 0 < j < n - 1:
                    bad |= blank[j : j + m]
            keep = ~bad
            # a subword that begins with the blank before a text is that text's
            yield (code[keep] & _U(BUCKETS - 1)).astype(np.int64), owner[n - 1 :][keep]


def has_letter(text: str | None) -> bool:
    """Whether a text has a character of the Unicode category L."""
    return bool(text) and any(m.group().isalpha() for m in _WORDY.finditer(text))


class LanguageModel:
    """Learned language values, a table of logits by bucket, a temperature and what rejection needs.

    The mean of a text's subword embeddings times the softmax weights equals the mean
    of the rows of one table, so a prediction is a lookup and a sum. A text is rejected whose
    probability lies below ``threshold``, or whose subwords are so rare in the language
    found that ``floors``, by language and length, are not reached: a softmax is sure of
    itself far from all that it has seen, the frequencies are not.
    """

    def __init__(self, langs: list[str], logits: np.ndarray, bias: np.ndarray, temperature: float = 1.0, threshold: float = 0.0):
        self.langs, self.logits, self.bias, self.temperature, self.threshold = langs, logits, bias, temperature, threshold
        #: log of the share that a bucket has of a language's subwords, and the least mean of it by language and length.
        self.typical = np.zeros((BUCKETS, len(langs)), dtype=np.float32)
        self.floors = np.full((len(langs), SIZES), -np.inf)

    def raw(self, texts: list[str]) -> np.ndarray:
        return self._means(texts)[0]

    def _means(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(logits, mean log share in each language, subwords) of each text."""
        raw, typical, count = np.zeros((len(texts), len(self.langs))), np.zeros((len(texts), len(self.langs))), np.zeros(len(texts))
        for bucket, owner in subwords(texts):
            count += np.bincount(owner, minlength=len(texts))
            for table_, total in ((self.logits, raw), (self.typical, typical)):
                for c in range(len(self.langs)):
                    total[:, c] += np.bincount(owner, table_[bucket, c], minlength=len(texts))
        size = np.maximum(count, 1)[:, None]
        return raw / size + self.bias, typical / size, count

    def predict(self, texts: list[str | None]) -> pd.DataFrame:
        """lang_pred, score, accepted of each text."""
        if not self.langs:
            return pd.DataFrame({"lang_pred": ["und"] * len(texts), "score": 0.0, "accepted": False})
        raw, typical, count = self._means([t or "" for t in texts])
        p = _softmax(raw / self.temperature)
        best, row = p.argmax(axis=1), np.arange(len(p))
        known = np.array([has_letter(t) for t in texts], dtype=bool)
        score = np.where(known, p[row, best], 0.0)
        accepted = known & (score >= self.threshold) & (typical[row, best] >= self.floors[best, size_class(count)])
        return pd.DataFrame({"lang_pred": np.where(known, np.array(self.langs, dtype=object)[best], "und"), "score": score, "accepted": accepted})


def size_class(count: np.ndarray) -> np.ndarray:
    """Lengths in subwords by powers of 2."""
    return np.minimum(np.log2(np.maximum(count, 1)).astype(int), SIZES - 1)


def _softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def fit(texts: list[str], labels: list[str], **more) -> LanguageModel:
    """``fit_bags`` from texts."""
    return fit_bags(_bags(texts), labels, **more)


def fit_bags(bags: list[tuple[np.ndarray, np.ndarray, int]], labels: list[str], *, epochs: int = 8, batch: int = 16, rate: float = 40.0, seed: int = 7) -> LanguageModel:
    """Train by stochastic gradient descent on (bucket, share, subwords) of each text; a fixed share of the texts calibrates."""
    langs = sorted(set(labels))
    if not langs:
        return LanguageModel([], np.zeros((BUCKETS, 0)), np.zeros(0))
    y = np.array([langs.index(v) for v in labels])
    rng = np.random.default_rng(seed)
    if len(langs) == 1:
        return LanguageModel(langs, np.zeros((BUCKETS, 1)), np.zeros(1))
    held = rng.random(len(y)) < CALIBRATION if len(y) >= 40 else np.zeros(len(y), bool)
    emb = rng.normal(0, 0.1, (BUCKETS, DIM)).astype(np.float32)
    weight = rng.normal(0, 0.1, (len(langs), DIM)).astype(np.float32)
    bias = np.zeros(len(langs), dtype=np.float32)
    train = np.flatnonzero(~held)
    steps = epochs * -(-len(train) // batch)
    step = 0
    for _ in range(epochs):
        for rows in np.array_split(rng.permutation(train), max(1, -(-len(train) // batch))):
            pace = 1 - step / steps
            step += 1
            # a bag has each bucket once, so its rows of the table are read and changed without sums over repeats
            used = [r for r in rows if len(bags[r][0])]
            if not used:
                continue
            shares = [bags[r][1].astype(np.float32) for r in used]
            hidden = np.stack([share @ emb[bags[r][0]] for r, share in zip(used, shares, strict=True)])
            error = _softmax(hidden @ weight.T + bias)
            error[np.arange(len(used)), y[used]] -= 1
            back = (error @ weight).astype(np.float32) * np.float32(rate * pace / len(rows))
            weight -= (0.5 * pace / len(rows)) * (error.T @ hidden)
            bias -= 0.1 * pace * error.sum(axis=0) / len(rows)
            for r, share, change in zip(used, shares, back, strict=True):
                emb[bags[r][0]] -= share[:, None] * change
    model = LanguageModel(langs, (emb @ weight.T).astype(np.float32), bias.astype(float))
    _calibrate(model, bags, y, held)
    return model


def _calibrate(model: LanguageModel, bags: list, y: np.ndarray, held: np.ndarray) -> None:
    """Temperature, threshold and floors from the texts held back."""
    rows = np.flatnonzero(held)
    if len(rows) < 10:
        return
    # one table of singles, turned into logarithms where it lies
    model.typical = np.full((BUCKETS, len(model.langs)), 0.01, dtype=np.float32)
    for r in np.flatnonzero(~held):
        model.typical[bags[r][0], y[r]] += (bags[r][1] * bags[r][2]).astype(np.float32)
    whole = np.log(model.typical.sum(axis=0, dtype=float)).astype(np.float32)
    np.log(model.typical, out=model.typical)
    model.typical -= whole
    mean = lambda table: np.stack([bags[r][1] @ table[bags[r][0]] if len(bags[r][0]) else np.zeros(table.shape[1]) for r in rows])
    raw = mean(model.logits) + model.bias
    fits = lambda t: -np.log(np.maximum(_softmax(raw / t)[np.arange(len(rows)), y[rows]], 1e-12)).mean()
    model.temperature = float(min(np.geomspace(0.02, 5, 60), key=fits))
    best = np.sort(_softmax(raw / model.temperature).max(axis=1))
    # at most REJECTED of the calibration texts lie below, and never a text that is more likely than all else
    model.threshold = float(min(best[int(REJECTED * len(best))], 0.5))
    typical, size = mean(model.typical), size_class(np.array([bags[r][2] for r in rows]))
    for c in range(len(model.langs)):
        own, other = typical[y[rows] == c, c], typical[y[rows] != c, c]
        if not len(own) or not len(other):
            continue
        # half way to texts of other languages, farther for the few subwords of short texts
        half = (np.median(own) - np.median(other)) / 2
        model.floors[c] = np.median(own) - np.abs(half) * np.maximum(1, np.sqrt(SHORT / 2.0 ** np.arange(SIZES)))
        for s in range(SIZES):
            # shorter texts vary more: where few are as long, they stand for longer ones, never the other way round
            for reach in range(1, SIZES):
                own = typical[(y[rows] == c) & (size >= s - reach) & (size <= s + 1), c]
                if len(own) >= LEAST_FLOOR:
                    mid = np.median(own)
                    model.floors[c, s] = mid - FLOOR_REACH * (mid - np.quantile(own, FLOOR_SHARE))
                    break


def _bags(texts: list[str]) -> list[tuple[np.ndarray, np.ndarray, int]]:
    """(bucket, share of the text's subwords, subwords) of each text."""
    out = []
    for text in texts:
        all_ = np.concatenate([b for b, _ in subwords([text])])
        ids, n = np.unique(all_, return_counts=True)
        # the sample's bags lie in the driver's memory: two bytes hold a bucket
        out.append((ids.astype(np.uint16), (n / max(1, n.sum())).astype(np.float32), int(n.sum())))
    return out


def fold(doc_id: Column) -> Column:
    """crc32 of the id's text, modulo 4; null for a null id."""
    return F.crc32(doc_id.cast("string")) % 4


def train(docs: DataFrame, *, max_per_lang: int = 1000, max_rows: int = 20_000) -> LanguageModel:
    """Learn from (doc_id, text, lang) where text and lang are not null and the id's fold is not 2.

    The sample is bounded: about ``max_per_lang`` documents of smallest id hash for each
    language, fewer where there are so many languages that they would be more than ``max_rows``
    (at least one of each is likely); all languages count. Whole texts are
    turned into bags of at most BUCKETS subwords by the executors, so the driver holds no text.
    """
    rows = docs.where("text is not null and lang is not null").where(fold(F.col("doc_id")) != 2).select("doc_id", "text", "lang", F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)).alias("h"))
    counts = rows.groupBy("lang").count()
    langs = counts.count()
    each = min(max_per_lang, max(1, max_rows // max(1, langs)))
    # one row a language; texts are shuffled only where there are very many
    sample = rows.join(F.broadcast(counts) if langs <= BROADCAST_LANGS else counts, "lang").where(F.col("h") < F.least(F.lit(1.0), F.lit(each) / F.col("count")) * (1 << 30) + 1)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            bags = _bags(pdf["text"].tolist())
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "lang": pdf["lang"], "buckets": [b.astype(np.int32) for b, _, _ in bags], "shares": [s for _, s, _ in bags], "n": [n for _, _, n in bags]})
        release()

    small_batches(docs.sparkSession)
    got = sample.select("doc_id", "lang", "text").mapInPandas(run, "doc_id long, lang string, buckets array<int>, shares array<float>, n long")
    # all tasks make bags at once; the driver then takes them partition by partition
    got = stage(got, "bags")
    held = [(r["doc_id"], r["lang"], np.array(r["buckets"], dtype=np.uint16), np.array(r["shares"], dtype=np.float32), r["n"]) for r in got.toLocalIterator(prefetchPartitions=True)]
    remove(docs.sparkSession, got.staged_path)
    held.sort(key=lambda r: (r[0], r[1], r[4], r[2].tobytes()))
    model = fit_bags([r[2:] for r in held], [r[1] for r in held])
    del held
    release()
    return model


def predict(docs: DataFrame, model: LanguageModel, text: Column, to: str = "language") -> DataFrame:
    """``docs`` with a struct column (lang_pred, score, accepted)."""
    small_batches(docs.sparkSession)
    held = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("lang_pred string, score double, accepted boolean")
    def run(parts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for part in parts:
            yield held.value.predict(part.tolist())
        release()

    return docs.withColumn(to, run(text))


def identify(docs: DataFrame, *, model: LanguageModel | None = None) -> DataFrame:
    """Predict the language of every whole text from its text alone.

    Returns (doc_id, held_out, lang_pred, score, accepted). A null text, or one without a letter, is 'und' with
    score 0 and not accepted; so is every text if there is nothing to learn from.
    Other texts get a learned language, its calibrated probability, and are accepted
    if that and the calibrated floors are reached. Rows are judged one by one; a null doc_id
    is in no fold: not learned from, not held out. Other columns of the input are
    ignored. An empty table gives no rows.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"))
    model = model or train(rows)
    out = predict(rows.select("doc_id", "text"), model, F.col("text"))
    return out.select("doc_id", F.coalesce(fold(F.col("doc_id")) == 2, F.lit(False)).alias("held_out"), "language.lang_pred", "language.score", "language.accepted")


def op3_language_id(spark, sf_dir: str) -> DataFrame:
    return identify(table(spark, sf_dir, "documents"))
