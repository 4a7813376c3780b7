"""Substring dedup with super-k-mers (operator 5).

A window is ``window`` consecutive words of one document.  Its minimiser is the least
hash of the ``gram``-word runs inside it; equal windows have equal minimisers.
Consecutive windows that share a minimiser form a super-k-mer, which travels as one
packed string to the minimiser's bucket.  There, windows are sorted, and of each run of
equal windows the least document is known: in all larger ones the window is a repeat.

What travels: first only (minimiser, document, start, length).  Super-k-mers whose
minimiser occurs in one document hold no repeat and stay behind; the others are packed.
Documents with equal word sequences are one class before that: the least stands for
all, and the others are repeats throughout.  A bucket of more than ``hot`` words (a passage in
very many documents, or one word over and over) is not given to one task: its windows travel
one by one as 128-bit digests, and Spark's partial aggregation finds the least document.
Rows of one minimiser or digest meet their least in joins whose sides are shuffles of their
own, so that Spark can split the partition of a frequent one.

Defined results: null text has no words; texts shorter than a window are kept whole;
windows of one document are no repeats of each other; rows with a null key are kept
whole; repeated rows give repeated results (keys are otherwise taken to be unique); an empty
table gives no rows; other columns stay, but for those named as the new ones.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from xxhash import xxh3_128_digest

from palimpsest.cluster import cut, map_arrow, unused
from palimpsest.llm.words import grams, hashes

GRAM = 8
#: Words of a bucket's super-k-mers that one task sorts.
HOT = 250_000


def runs(h: np.ndarray, window: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Minimiser, first window and number of windows of each super-k-mer of a document's word hashes."""
    n = len(h) - window + 1
    if n <= 0:
        return h[:0], np.empty(0, np.int64), np.empty(0, np.int64)
    low = np.lib.stride_tricks.sliding_window_view(grams(h, gram), window - gram + 1).min(axis=1)
    start = np.concatenate([[0], np.flatnonzero(low[1:] != low[:-1]) + 1])
    return low[start], start, np.diff(np.append(start, n))


def _split(text: str | None) -> list[bytes]:
    return (text or "").encode().split()


def scanned(docs: DataFrame, window: int, gram: int) -> DataFrame:
    """Rows (id, n_words, digest, kmers) of rows (id, text)."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        words = [_split(t) for t in batch.column(1).to_pylist()]
        found = [runs(hashes(w), window, gram) for w in words]
        ends = np.concatenate([[0], np.cumsum([len(x[0]) for x in found])]).astype(np.int32)
        joined = [np.concatenate([np.empty(0, kind), *[x[i] for x in found]]) for i, kind in enumerate((np.uint64, np.int64, np.int64))]
        kmers = pa.StructArray.from_arrays([pa.array(joined[0].view(np.int64)), pa.array(joined[1].astype(np.int32)), pa.array(joined[2].astype(np.int32))], ["mini", "start", "n"])
        return pa.RecordBatch.from_arrays(
            [
                batch.column(0),
                pa.array([len(w) for w in words], pa.int64()),
                pa.array([xxh3_128_digest(b" ".join(w)) for w in words], pa.binary()),
                pa.ListArray.from_arrays(pa.array(ends), kmers),
            ],
            names=["id", "n_words", "digest", "kmers"],
        )

    kind = docs.schema["id"].dataType.simpleString()
    return map_arrow(docs, run, f"id {kind}, n_words long, digest binary, kmers array<struct<mini: long, start: int, n: int>>")


def packed(asked: DataFrame, window: int) -> DataFrame:
    """Rows (mini, id, start, words) with the packed super-k-mers, of rows (id, text, kmers)."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        out: tuple[list, list, list, list] = ([], [], [], [])
        for i, text, kmers in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
            words = _split(text)
            for k in kmers:
                for column, value in zip(out, (k["mini"], i, k["start"], b" ".join(words[k["start"] : k["start"] + k["n"] + window - 1])), strict=True):
                    column.append(value)
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, (pa.int64(), pa.int64(), pa.int32(), pa.binary()), strict=True)], names=["mini", "id", "start", "words"])

    return map_arrow(asked.select("id", "text", "kmers"), run, "mini long, id long, start int, words binary", rows=256)


def unpacked(asked: DataFrame, window: int) -> DataFrame:
    """Rows (digest, id, start) of each window, for hot buckets."""

    def run(batch: pa.RecordBatch) -> list[pa.RecordBatch]:
        out = []
        for i, text, kmers in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
            words = _split(text)
            at = [s for k in kmers for s in range(k["start"], k["start"] + k["n"])]
            digests = [xxh3_128_digest(b" ".join(words[s : s + window])) for s in at]
            out.append(pa.RecordBatch.from_arrays([pa.array(digests, pa.binary()), pa.array([i] * len(at), pa.int64()), pa.array(at, pa.int32())], names=["digest", "id", "start"]))
        return out

    return map_arrow(asked.select("id", "text", "kmers"), run, "digest binary, id long, start int", rows=256)


def windows(words: bytes, window: int) -> list[bytes]:
    """The windows of a packed super-k-mer."""
    space = np.flatnonzero(np.frombuffer(words, np.uint8) == 32).tolist()
    starts, ends = [0, *[s + 1 for s in space]], [*space, len(words)]
    return [words[a:b] for a, b in zip(starts, ends[window - 1 :])]


def bucket(rows: list[tuple[int, int, bytes]], window: int) -> list[tuple[int, int, int]]:
    """Word ranges (id, first, end) that repeat, of the super-k-mers (id, start, words) of one minimiser."""
    same: dict[bytes, list[tuple[int, int]]] = {}
    for i, start, words in rows:
        same.setdefault(words, []).append((i, start))
    owners = list(same.values())
    cut_up = [windows(w, window) for w in same]
    least = [min(o)[0] for o in owners]
    if len(same) == 1:
        low = [[least[0]] * len(cut_up[0])]
    else:
        flat = [w for ws in cut_up for w in ws]
        owner = [k for k, ws in enumerate(cut_up) for _ in ws]
        lows, at = [0] * len(flat), 0
        order = sorted(range(len(flat)), key=flat.__getitem__)
        while at < len(order):
            end = at
            while end < len(order) and flat[order[end]] == flat[order[at]]:
                end += 1
            first = min(least[owner[k]] for k in order[at:end])
            for k in order[at:end]:
                lows[k] = first
            at = end
        pieces = iter(lows)
        low = [[next(pieces) for _ in ws] for ws in cut_up]
    out = []
    for lows, rows_of in zip(low, owners, strict=True):
        for i, start in rows_of:
            since = None
            for k, first in enumerate([*lows, i]):
                if first < i:
                    since = k if since is None else since
                elif since is not None:
                    out.append((i, start + since, start + k - 1 + window))
                    since = None
    return out


def sorted_buckets(rows: DataFrame, window: int) -> DataFrame:
    """Rows (id, first, end) of the repeats, from packed super-k-mers; no bucket is larger than what a task may hold."""
    from palimpsest.cluster import ship

    ship(rows.sparkSession)

    def run(batches):
        mini, held = None, []
        out: list[tuple[int, int, int]] = []

        def table() -> pa.RecordBatch:
            columns = list(zip(*out)) or [(), (), ()]
            return pa.RecordBatch.from_arrays([pa.array(columns[0], pa.int64()), pa.array(columns[1], pa.int32()), pa.array(columns[2], pa.int32())], names=["id", "first", "end"])

        for batch in batches:
            for m, i, start, words in zip(*(batch.column(k).to_pylist() for k in range(4)), strict=True):
                if m != mini and held:
                    out += bucket(held, window)
                    held = []
                mini = m
                held.append((i, start, words))
            if len(out) > 20_000:
                yield table()
                out.clear()
        if held:
            out += bucket(held, window)
        yield table()

    return rows.repartition("mini").sortWithinPartitions("mini").mapInArrow(run, "id long, first int, end int")


def repeats(docs: DataFrame, window: int, gram: int, hot: int) -> DataFrame:
    """Rows (id, ranges) of the word ranges that repeat, of rows (id, text) without null ids."""
    rows = cut(scanned(docs, window, gram))
    heads = rows.groupBy("digest").agg(F.min("id").alias("rep")).select(F.substring("digest", 1, 16).alias("d"), "rep")
    copies = rows.where(F.col("n_words") >= window).select("digest", "id", "n_words").join(heads, F.col("digest") == F.col("d")).where("id > rep")
    kmers = rows.join(heads.select("rep"), F.col("id") == F.col("rep"), "left_semi").select("id", F.explode("kmers").alias("k")).select("k.mini", "id", "k.start", "k.n")
    shared = kmers.groupBy("mini").agg(F.min("mini").alias("m"), F.min("id").alias("lo"), F.max("id").alias("hi"), F.sum(F.col("n") + (window - 1)).alias("words")).where("lo < hi").select("m", (F.col("words") > hot).alias("hot"))
    asks = cut(kmers.join(shared, F.col("mini") == F.col("m")).groupBy("id", "hot").agg(F.collect_list(F.struct("mini", "start", "n")).alias("kmers")))
    found = sorted_buckets(packed(docs.join(asks.where("NOT hot"), "id"), window), window)
    single = unpacked(docs.join(asks.where("hot"), "id"), window)
    first = single.groupBy("digest").agg(F.min("id").alias("lo")).select(F.substring("digest", 1, 16).alias("d"), "lo")
    single = single.join(first, F.col("digest") == F.col("d")).where("id > lo").select("id", F.col("start").alias("first"), (F.col("start") + window).alias("end"))
    whole = copies.select("id", F.lit(0).alias("first"), F.col("n_words").cast("int").alias("end"))
    return found.union(single).union(whole).groupBy("id").agg(F.collect_list(F.struct("first", "end")).alias("ranges"))


def remove_repeats(docs: DataFrame, key: str = "doc_id", text: str = "text", window: int = 50, gram: int = GRAM, hot: int = HOT) -> DataFrame:
    """The rows with n_words, n_removed and kept_text (kept words, joined by one space), instead of columns of these names."""
    new = ("n_words", "n_removed", "kept_text")
    other = [c for c in docs.columns if c not in new]
    rows = docs.select(*other)
    known = rows.where(F.col(key).isNotNull())
    found = repeats(known.select(F.col(key).cast("long").alias("id"), F.col(text).alias("text")), window, gram, hot)
    ranges = unused("ranges", other)
    known = known.join(found.select(F.col("id").alias(key), F.col("ranges").alias(ranges)), key, "left").select(*other, ranges)
    rows = known.union(rows.where(F.col(key).isNull()).withColumn(ranges, F.lit(None).cast("array<struct<first: int, end: int>>")))
    at = other.index(text)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        n_words, n_removed, kept = [], [], []
        for t, ranges in zip(batch.column(at).to_pylist(), batch.column(len(other)).to_pylist(), strict=True):
            words = _split(t)
            n = len(words)
            if ranges:
                gone = np.zeros(n, bool)
                for r in ranges:
                    gone[r["first"] : r["end"]] = True
                words = [words[i] for i in np.flatnonzero(~gone).tolist()]
            n_words.append(n)
            n_removed.append(n - len(words))
            kept.append(b" ".join(words).decode())
        return pa.RecordBatch.from_arrays([*batch.columns[: len(other)], pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(kept, pa.string())], names=[*other, *new])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[:-1])
    return map_arrow(rows, run, f"{fields}, n_words long, n_removed long, kept_text string", rows=512)
