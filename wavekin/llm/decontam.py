"""Benchmark decontamination over a distributed positional inverted index.

The index stores, for every word of the benchmark, where the training texts have it:
postings (term, text, position). A phrase is found by intersecting the lists of its
terms, shifted by their offsets, starting at the rarest. Equal texts share one entry.

A posting enters the lists only where it can be part of a match. An occurrence of a phrase is a
run of benchmark words at least as long as the phrase, so the runs shorter than the
shortest phrase with that term give no exact match. A proximity match is made of postings of a
phrase's three rarest terms around one of the rarest, so of the other postings those that have no such
company are left out. This loses nothing and makes the lists follow the benchmark's traces in the
corpus, not the corpus.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import passing, release, small_batches, stage, table, text_parts

WINDOW = 10
#: Different benchmark words whose dictionary goes to the driver and the tasks, at most; beyond it the words of all documents are joined with them by a shuffle.
VOCABULARY = 1_000_000
#: Bytes of these words, at most.
VOCABULARY_BYTES = 32 << 20
#: Different triples of rarest terms that go to the tasks, at most; of more only the single terms do.
TRIPLES = 1_000_000
#: Rows of a side that is broadcast, at most.
BROADCAST_ROWS = 300_000
#: Words within which a proximity match must lie.
SPAN = 20

_FOLD = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def words_of(text: str | None) -> list[bytes]:
    """The contract's words as UTF-8: runs of ASCII letters, digits and non-ASCII characters, A-Z lower-cased."""
    return (text or "").encode("utf-8", "surrogatepass").translate(_FOLD).split()


def words_in(texts: pa.Array) -> tuple[np.ndarray, list[bytes], np.ndarray]:
    """(number of each word, the different words, the text of each word) of ``words_of`` over an array of texts."""
    texts = pa.concat_arrays([pc.fill_null(texts, "").cast(pa.string())])
    _, offsets, raw = texts.buffers()
    # words are runs of bytes that the table does not turn into spaces; it keeps lengths, so offsets stay
    folded = (raw.to_pybytes() if raw else b"").translate(_FOLD)
    lists = pc.ascii_split_whitespace(pa.Array.from_buffers(pa.string(), len(texts), [None, offsets, pa.py_buffer(folded)], offset=texts.offset))
    flat, owner = lists.flatten(), np.repeat(np.arange(len(texts)), pc.list_value_length(lists).to_numpy(zero_copy_only=False))
    some = pc.greater(pc.binary_length(flat), 0)
    coded = flat.filter(some).dictionary_encode()
    return coded.indices.to_numpy(), coded.dictionary.cast(pa.binary()).to_pylist(), owner[some.to_numpy(zero_copy_only=False)]


def phrases(items: list[tuple[str, list[bytes]]], window: int = WINDOW) -> dict[tuple[bytes, ...], set[str]]:
    """Every window of consecutive words -> items that have it. An item of fewer words is one window."""
    out: dict[tuple[bytes, ...], set[str]] = {}
    for item, words in items:
        for i in range(max(1, len(words) - window + 1) if words else 0):
            out.setdefault(tuple(words[i : i + window]), set()).add(item)
    return out


def benchmark_phrases(benchmark: DataFrame, window: int = WINDOW) -> tuple[DataFrame, DataFrame]:
    """((phrase, offset, word, length), (phrase, item)), both staged: the different windows of all items, and which items have them.

    A phrase goes by a 128-bit digest of its words. Windows are cut by the executors.
    """
    rows = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item"), F.col("text").cast("string").alias("text")).where("text is not null")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for item, text in zip(pdf["item"], pdf["text"], strict=True):
                words = words_of(text)
                count = max(1, len(words) - window + 1) if words else 0
                for lo in range(0, count, 4096):
                    cut = [words[i : i + window] for i in range(lo, min(count, lo + 4096))]
                    yield pd.DataFrame({"phrase": [hashlib.blake2b(b" ".join(w), digest_size=16).digest() for w in cut], "item": item, "words": [[x.decode() for x in w] for w in cut]})

    windows = stage(rows.mapInPandas(run, "phrase binary, item string, words array<string>"), "windows")
    different = windows.groupBy("phrase").agg(F.first("words").alias("words"))
    terms = different.select("phrase", F.size("words").alias("length"), F.posexplode("words").alias("offset", "word"))
    return stage(terms.select("phrase", "offset", "word", "length"), "phrases"), stage(windows.select("phrase", "item").distinct(), "owners")


_ROWS = "doc_id long, text_key string, n_words long, terms array<int>, positions array<int>"


def _keyed(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", "text", F.md5(F.coalesce("text", F.lit(""))).alias("text_key"))


def in_runs(terms: np.ndarray, positions: np.ndarray, shortest: np.ndarray) -> np.ndarray:
    """Which postings of a text lie in a run of consecutive positions that is at least as long as their term's shortest phrase."""
    if not len(terms):
        return np.zeros(0, dtype=bool)
    edge = np.flatnonzero(np.diff(positions, prepend=-2) != 1)
    length = np.diff(edge, append=len(positions))
    return np.repeat(length, length) >= shortest[terms]


def near_first(terms: np.ndarray, positions: np.ndarray, first: np.ndarray, rare: np.ndarray, span: int) -> np.ndarray:
    """Which postings have a ``rare`` term and lie less than ``span`` words from a posting of a ``first`` term."""
    at = positions[first[terms]]
    if not len(at):
        return np.zeros(len(terms), dtype=bool)
    place = np.searchsorted(at, positions)
    before = positions - at[np.maximum(place - 1, 0)]
    after = at[np.minimum(place, len(at) - 1)] - positions
    # a neighbour that is missing on one side is the one of the other, whose distance is then negative
    gap = np.minimum(np.where(before >= 0, before, span), np.where(after >= 0, after, span))
    return rare[terms] & (gap < span)


def build_index(docs: DataFrame, terms: dict[bytes, tuple[int, int]], whole: bool = False) -> DataFrame:
    """(doc_id, text_key, n_words, terms, positions) of every document, staged.

    ``terms`` maps a word to (its number, the shortest run of known words it counts in); with ``whole`` postings in shorter runs are kept as well.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shortest = np.zeros(len(terms) + 1, dtype=np.int64)
        for number, least in terms.values():
            shortest[number] = least
        number_of = {w: n for w, (n, _) in terms.items()}
        for batch in batches:
            for part in text_parts(batch, "text"):
                code, words, owner = words_in(part.column("text"))
                n = part.num_rows
                sizes = np.bincount(owner, minlength=n).astype(np.int64)
                place = np.arange(len(owner)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
                ids = np.fromiter((number_of.get(w, -1) for w in words), dtype=np.int32, count=len(words))[code] if words else np.zeros(0, dtype=np.int32)
                at = np.flatnonzero(ids >= 0)
                if not whole:
                    at = at[in_runs(ids[at], place[at] + _apart(owner[at], sizes, 1), shortest)]
                ends = pa.array(np.concatenate([[0], np.cumsum(np.bincount(owner[at], minlength=n))]).astype(np.int32))
                lists = [pa.ListArray.from_arrays(ends, pa.array(x.astype(np.int32))) for x in (ids[at], place[at])]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("text_key"), pa.array(sizes), *lists], ["doc_id", "text_key", "n_words", "terms", "positions"])
        release()

    return stage(_keyed(docs).mapInArrow(run, _ROWS), "postings")


def _apart(owner: np.ndarray, sizes: np.ndarray, gap: int) -> np.ndarray:
    """What to add to the positions of texts of these sizes to have them one after another, ``gap`` positions apart."""
    return (np.cumsum(sizes + gap) - sizes - gap)[owner]


def term_counts(index: DataFrame, count: int) -> np.ndarray:
    """Postings of each of ``count`` terms in all rows; tasks add up their own rows first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.zeros(count, dtype=np.int64)
        for batch in batches:
            held += np.bincount(batch.column("terms").flatten().to_numpy(), minlength=count)
        some = np.flatnonzero(held)
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array(held[some])], ["term", "n"])

    out = np.zeros(count, dtype=np.int64)
    got = index.select("terms").mapInArrow(run, "term int, n long").groupBy("term").agg(F.sum("n").alias("n")).toArrow()
    out[got["term"].to_numpy()] = got["n"].to_numpy()
    return out


def in_triples(terms: np.ndarray, positions: np.ndarray, triples: np.ndarray, span: int) -> np.ndarray:
    """Which postings of a text take part in a proximity match: ``triples`` has rows of three terms, -1 for none, sorted by the first, the one that the others are near to."""
    keep = np.zeros(len(terms), dtype=bool)
    low, high = np.searchsorted(triples[:, 0], terms, "left"), np.searchsorted(triples[:, 0], terms, "right")
    begun = np.flatnonzero(high > low)
    if not len(begun):
        return keep
    dense = np.full(int(positions[-1]) + 2 * span, -2, dtype=np.int64)
    dense[positions + span - 1] = np.arange(len(terms))
    # every first posting with each of its triples
    many = (high - low)[begun]
    posting = np.repeat(begun, many)
    triple = np.repeat(low[begun] - np.cumsum(many) + many, many) + np.arange(len(posting))
    for lo in range(0, len(posting), 1 << 16):
        at, three = posting[lo : lo + (1 << 16)], triples[triple[lo : lo + (1 << 16)]]
        around = dense[positions[at][:, None] + np.arange(2 * span - 1)]
        known = np.where(around >= 0, terms[np.maximum(around, 0)], -2)
        hits = [known == three[:, i : i + 1] for i in (1, 2)]
        match = np.logical_and.reduce([h.any(axis=1) | (three[:, i] < 0) for i, h in zip((1, 2), hits, strict=True)])
        keep[at[match]] = True
        for h in hits:
            keep[around[match][h[match]]] = True
    return keep


def useful_postings(index: DataFrame, shortest: np.ndarray, triples: np.ndarray, span: int) -> DataFrame:
    """``index`` with the postings of long enough runs and those that a proximity match of ``triples`` needs."""
    first, rare = np.zeros(len(shortest), dtype=bool), np.zeros(len(shortest), dtype=bool)
    first[triples[:, 0]], rare[triples[triples >= 0]] = True, True
    held = index.sparkSession.sparkContext.broadcast((shortest, first, rare, triples if len(triples) <= TRIPLES else None))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        least, some, more, known = held.value
        for batch in batches:
            if not batch.num_rows:
                continue
            terms, positions = batch.column("terms"), batch.column("positions")
            t, p, count = terms.flatten().to_numpy(), positions.flatten().to_numpy(), terms.value_lengths().to_numpy()
            owner = np.repeat(np.arange(batch.num_rows), count)
            sizes = np.zeros(batch.num_rows, dtype=np.int64)
            np.maximum.at(sizes, owner, p + 1)
            far = p + _apart(owner, sizes, 2 * span)
            keep = in_runs(t, far, least) | (near_first(t, far, some, more, span) if known is None else in_triples(t, far, known, span))
            ends = pa.array(np.concatenate([[0], np.cumsum(np.bincount(owner[keep], minlength=batch.num_rows))]).astype(np.int32))
            lists = [pa.ListArray.from_arrays(ends, pa.array(x[keep])) for x in (t, p)]
            yield pa.RecordBatch.from_arrays([batch.column("text_key"), *lists], ["text_key", "terms", "positions"])

    out = index.where(F.size("terms") > 0).select("text_key", "terms", "positions").mapInArrow(run, "text_key string, terms array<int>, positions array<int>")
    return out.where(F.size("terms") > 0)


def build_large_index(docs: DataFrame, terms: DataFrame) -> DataFrame:
    """The same for more ``terms`` (word, term) than a task should hold, with all postings: the words of each text are joined with them."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            texts = [words_of(t) for t in pdf["text"]]
            yield pd.DataFrame({"doc_id": pdf["doc_id"].astype("Int64"), "text_key": pdf["text_key"], "n_words": [len(w) for w in texts], "words": [[x.decode() for x in w] for w in texts]})
        release()

    words = stage(_keyed(docs).mapInPandas(run, "doc_id long, text_key string, n_words long, words array<string>"), "words")
    spread = words.dropDuplicates(["text_key"]).select("text_key", F.posexplode("words").alias("pos", "word"))
    found = spread.join(terms.select("word", "term"), "word").groupBy("text_key").agg(F.array_sort(F.collect_list(F.struct("pos", "term"))).alias("p"))
    rows = words.select("doc_id", "text_key", "n_words").join(found, "text_key", "left")
    none = lambda kind: F.array().cast(f"array<{kind}>")
    return stage(rows.select("doc_id", "text_key", "n_words", F.coalesce(F.col("p.term"), none("long")).alias("terms"), F.coalesce(F.col("p.pos"), none("int")).alias("positions")), "postings")


def _lists(index: DataFrame) -> DataFrame:
    """(term, text_key, pos): the inverted lists, each text once."""
    one = index.where(F.size("terms") > 0).groupBy("text_key").agg(F.first("terms").alias("terms"), F.first("positions").alias("positions"))
    return one.select("text_key", F.explode(F.arrays_zip("terms", "positions")).alias("p")).select(F.col("p.terms").alias("term"), "text_key", F.col("p.positions").alias("pos"))


def _small(df: DataFrame) -> DataFrame:
    """A staged table, to be broadcast where it has few rows."""
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def ranked_terms(lists: DataFrame, phrase_terms: DataFrame, frequency: DataFrame | None = None) -> DataFrame:
    """phrase_terms (phrase, offset, term, length[, word]) with rank, staged: 1 for the term of a phrase with the shortest list, or by ``frequency`` (term, f); ties to the smaller word, or term."""
    if frequency is None:
        frequency = lists.groupBy("term").agg(F.count("*").alias("f"))
    by_rarity = Window.partitionBy("phrase").orderBy(F.coalesce("f", F.lit(0)), "word" if "word" in phrase_terms.columns else "term", "offset")
    # a phrase has as many rows as the window has words
    return stage(phrase_terms.join(frequency, "term", "left").withColumn("rank", F.row_number().over(by_rarity)), "ranked")


def exact_matches(lists: DataFrame, ranked: DataFrame) -> DataFrame:
    """(phrase, text_key, start, length): every occurrence of every phrase.

    ``lists`` has (term, text_key, pos), ``ranked`` (phrase, offset, term, length, rank). The list of each phrase's rarest term gives candidate
    starts; the lists of its second and third rarest cut them; all others confirm.
    """
    starts = None
    for lowest, highest in ((1, 1), (2, 2), (3, 3), (4, 1 << 30)):
        terms = ranked.where(F.col("rank").between(lowest, highest)).select("phrase", "offset", "term", "length")
        if starts is None:
            # few phrases are broadcast, so that a frequent term's list stays spread over tasks
            starts = lists.join(_small(terms), "term").select("phrase", "text_key", (F.col("pos") - F.col("offset")).alias("start"), "length").where("start >= 0")
        elif highest == lowest:
            # phrases too short for this rank pass
            open_ = starts.join(terms.select("phrase", "offset", "term"), "phrase", "left")
            here = lists.select("term", "text_key", "pos", F.lit(1).alias("hit"))
            probe = open_.withColumn("pos", F.col("start") + F.col("offset"))
            starts = probe.join(here, ["term", "text_key", "pos"], "left").where("hit = 1 or term is null").select("phrase", "text_key", "start", "length")
        else:
            starts = stage(starts, "starts")
            probe = starts.join(terms.select("phrase", "offset", "term"), "phrase").withColumn("pos", F.col("start") + F.col("offset"))
            confirmed = probe.join(lists, ["term", "text_key", "pos"]).groupBy("phrase", "text_key", "start", "length").agg(F.count("*").alias("n"))
            starts = confirmed.where(F.col("n") == F.col("length") - 3).drop("n").unionByName(starts.where("length <= 3"))
    return starts


def near_matches(lists: DataFrame, ranked: DataFrame, span: int = SPAN) -> DataFrame:
    """(phrase, text_key): texts in which the three rarest terms of a phrase (fewer, if it has fewer) lie less than ``span`` words from the rarest, in any order.

    A word that stands twice in a phrase counts as two of its terms. Each posting of the rarest term asks
    for the others in its own and the neighbouring stretches of ``span`` words, so no pair of
    far positions is made.
    """
    block = lambda pos: F.floor(F.col(pos) / span)
    rarest = ranked.where("rank = 1").select("phrase", "term", "length")
    near = lists.join(_small(rarest), "term").select("phrase", "text_key", F.col("pos").alias("at"), "length", F.col("term").alias("t1"))
    here = lists.select("term", "text_key", "pos", block("pos").alias("block"))
    for rank in (2, 3):
        term = ranked.where(F.col("rank") == rank).select("phrase", "term")
        open_ = near.join(_small(term), "phrase", "left")
        probe = open_.withColumn("block", F.explode(F.array(*[block("at") + i for i in (-1, 0, 1)])))
        close = F.abs(F.col("pos") - F.col("at")) < span
        found = probe.where("term is not null").join(here, ["term", "text_key", "block"]).where(close)
        kept = found.select(near.columns).distinct()
        near = kept.unionByName(near.where(F.col("length") < rank).select(near.columns))
    return near.select("phrase", "text_key").distinct()


def proximity_matches(index: DataFrame, phrase_terms: DataFrame, span: int, least: int = 2) -> DataFrame:
    """(phrase, text_key, block, n): stretches of ``span`` words that hold at least ``least`` different words of a phrase, in any order.

    Stretches start at multiples of half a span, so each set of words within half a
    span lies wholly in one of them. The index must hold all postings (shortest run 1).
    """
    half = max(1, span // 2)
    lists = _lists(index).join(phrase_terms.select("phrase", "term").distinct(), "term")
    blocks = lists.withColumn("block", F.explode(F.array(F.floor(F.col("pos") / half), F.floor(F.col("pos") / half) - 1))).where("block >= 0")
    return blocks.groupBy("phrase", "text_key", "block").agg(F.count_distinct("term").alias("n")).where(F.col("n") >= least)


def decontaminate(docs: DataFrame, benchmark: DataFrame, *, window: int = WINDOW, vocabulary: int = VOCABULARY, span: int | None = None) -> DataFrame:
    """Mark the words of every document that lie in an occurrence of a benchmark window.

    Returns (doc_id, n_words, n_hit, n_items, items_sha256, contaminated), and with ``span`` n_near: the items of a
    window whose three rarest words (by their occurrences in all documents) lie within ``span`` words of the rarest, exact match or
    not; they decide nothing. Null texts, and texts without words, have
    0 words and no hits; benchmark items that are null or have no words match nothing;
    an item whose id is null counts as the item ''. Items with equal windows all count.
    Rows that repeat a doc_id are judged by their own text each. Other columns of both tables are ignored.
    With an empty benchmark nothing is hit; empty documents give no rows.

    Documents are read once. Windows stay with Spark; the driver holds at most ``vocabulary``
    different benchmark words of 32 MB, and none where there are more; the result is the same.
    """
    spark = docs.sparkSession
    small_batches(spark)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    with passing(spark) as keep:
        phrase_words, owners = benchmark_phrases(benchmark, window)
        least = phrase_words.groupBy("word").agg(F.min("length").alias("least"))
        count, size = least.agg(F.count("*"), F.sum(F.octet_length("word"))).first()
        if count <= vocabulary and (size or 0) <= VOCABULARY_BYTES:
            few = sorted(map(tuple, least.collect()))
            terms = spark.createDataFrame(pa.table({"word": pa.array([w for w, _ in few], pa.string()), "term": pa.array(range(len(few)), pa.int32())}), "word string, term int")
            index = keep(build_index(docs, {w.encode(): (n, shortest) for n, (w, shortest) in enumerate(few)}, whole=span is not None))
        else:
            few = None
            terms = stage(least.select("word", F.monotonically_increasing_id().alias("term")), "terms")
            index = keep(build_large_index(docs, terms))
        phrase_terms = phrase_words.join(_small(terms.select("word", "term")), "word").select("phrase", "offset", "word", "term", "length")
        if few is None or span is None:
            lists = stage(_lists(index), "lists")
            counts = index.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count("*").alias("f"))
            ranked = ranked_terms(lists, phrase_terms, None if span is None else counts)
        else:
            counts = pa.table({"term": pa.array(range(len(few)), pa.int32()), "f": term_counts(index, len(few))})
            ranked = ranked_terms(index, phrase_terms, spark.createDataFrame(counts, "term int, f long"))
            by_rank = lambda r: F.coalesce(F.max(F.when(F.col("rank") == r, F.col("term"))), F.lit(-1)).alias(f"t{r}")
            rarest = ranked.where("rank <= 3").groupBy("phrase").agg(*[by_rank(r) for r in (1, 2, 3)]).select("t1", "t2", "t3").distinct().toArrow()
            triples = np.stack([c.to_numpy() for c in rarest.columns], axis=1).astype(np.int64) if rarest.num_rows else np.zeros((0, 3), dtype=np.int64)
            triples = triples[np.lexsort(triples.T[::-1])]
            lists = stage(_lists(useful_postings(index, np.array([shortest for _, shortest in few], dtype=np.int64), triples, span)), "lists")
        named = lambda found, *more: found.join(_small(owners), "phrase").select("text_key", "item", *more)
        hits = keep(stage(named(exact_matches(lists, ranked), "start", "length").distinct(), "hits"))
        if span is not None:
            near = keep(stage(named(near_matches(lists, ranked, span)).groupBy("text_key").agg(F.count_distinct("item").alias("n_near")), "near"))
    spots = hits.select("text_key", "start", (F.col("start") + F.col("length")).alias("end")).distinct()
    before = Window.partitionBy("text_key").orderBy("start", "end").rowsBetween(Window.unboundedPreceding, -1)
    fresh = F.col("end") - F.greatest("start", F.coalesce(F.max("end").over(before), F.lit(0)))
    per_text = spots.select("text_key", F.greatest(fresh, F.lit(0)).alias("n")).groupBy("text_key").agg(F.sum("n").alias("n_hit"))
    names = hits.groupBy("text_key").agg(F.array_sort(F.collect_set("item")).alias("items"))
    per_text = per_text.join(names, "text_key").select("text_key", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"))
    judged = index.select("doc_id", "text_key", "n_words").join(per_text, "text_key", "left")
    if span is not None:
        judged = judged.join(near, "text_key", "left")
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    return judged.select(
        "doc_id",
        "n_words",
        zero("n_hit"),
        zero("n_items"),
        F.coalesce("items_sha256", F.sha2(F.lit(""), 256)).alias("items_sha256"),
        (F.coalesce("n_hit", F.lit(0)) > 0).alias("contaminated"),
        *([zero("n_near")] if span is not None else []),
    )


def op6_decontaminate(spark, sf_dir: str) -> DataFrame:
    return decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), span=SPAN)
