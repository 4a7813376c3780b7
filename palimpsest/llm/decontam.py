"""Benchmark decontamination with a prefix-filtered containment join (operator 6).

Every ``window`` consecutive words of a benchmark item (all words of a shorter item) are
a shingle set that a document must contain whole, in order.  Containment needs all of a
window's words, so one necessary prefix word is enough to find it: its rarest, by the
counts of benchmark words over all documents.  A document word that is some window's
prefix word gives candidates; where the window would start and end must lie within the
document (positional and length bounds), and then the item-sized word window is compared
exactly.

The windows are broadcast while they hold at most ``bound`` bytes; beyond that,
documents' words are joined with the prefix words in a shuffle.  Both give equal results.

Defined results: null and empty texts have no words; items without words, or with null
ids, occur nowhere; repeated items count once; repeated documents give a row each; an empty
table gives no rows, and an empty benchmark no hits; other columns stay, but for those named
as the new ones; texts of any length are searched whole.
"""

from __future__ import annotations

from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from palimpsest.cluster import cut, map_arrow, unused
from palimpsest.llm.words import LETTERS

#: Bytes of windows and words that are broadcast.
BOUND = 32 << 20


def split(text: str | None) -> list[bytes]:
    """Runs of 0-9, a-z (A-Z lowered) and non-ASCII characters."""
    return (text or "").encode().translate(LETTERS).split()


def item_windows(bench: DataFrame, item: str, text: str, window: int) -> DataFrame:
    """Distinct rows (window, items): the joined words, and the ids of the items that hold them."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        ids, out = [], []
        for i, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            words = split(t)
            found = {b" ".join(words[k : k + window]) for k in range(max(1, len(words) - window + 1))} if words else ()
            ids += [i] * len(found)
            out += found
        return pa.RecordBatch.from_arrays([pa.array(ids, batch.column(0).type), pa.array(out, pa.binary())], names=["item", "window"])

    rows = map_arrow(bench.where(F.col(item).isNotNull()).select(F.col(item).alias("item"), text), run, T.StructType([T.StructField("item", bench.schema[item].dataType), T.StructField("window", T.BinaryType())]))
    return rows.groupBy("window").agg(F.collect_set("item").alias("items"))


def word_counts(docs: DataFrame, text: str, words: set[bytes] | None) -> DataFrame:
    """Rows (word, n) over all documents; of the given words only, if any are given."""
    given = None if words is None else docs.sparkSession.sparkContext.broadcast(words)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        counts: Counter = Counter()
        for t in batch.column(0).to_pylist():
            counts.update(split(t))
        if given is not None:
            counts = Counter({w: n for w, n in counts.items() if w in given.value})
        return pa.RecordBatch.from_arrays([pa.array(list(counts), pa.binary()), pa.array(list(counts.values()), pa.int64())], names=["word", "n"])

    return map_arrow(docs.select(text), run, "word binary, n long", rows=4096, size=16 << 20).groupBy("word").agg(F.sum("n").alias("n"))


class Index:
    """Windows by their prefix word, place of that word and length."""

    def __init__(self, rows: list[tuple[bytes, int, bytes, list]]):
        self.by: dict = defaultdict(lambda: defaultdict(dict))
        for word, place, window, items in rows:
            self.by[word][place, window.count(b" ") + 1][window] = items
        self.by = {w: [(p, n, d) for (p, n), d in x.items()] for w, x in self.by.items()}

    def hits(self, words: list[bytes]) -> tuple[int, set]:
        """Words within occurrences, and the items whose windows occur."""
        by, items, spans = self.by, set(), []
        for at in [i for i, w in enumerate(words) if w in by]:
            for place, n, windows in by[words[at]]:
                start = at - place
                if start >= 0 and start + n <= len(words) and (found := windows.get(b" ".join(words[start : start + n]))):
                    items.update(found)
                    spans.append((start, start + n))
        if not spans:
            return 0, items
        hit = np.zeros(len(words), bool)
        for a, b in spans:
            hit[a:b] = True
        return int(hit.sum()), items


def _out(columns: list[pa.Array], names: list[str], found: list[tuple[int, int, set]], kind: pa.DataType) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [*columns, pa.array([f[0] for f in found], pa.int64()), pa.array([f[1] for f in found], pa.int64()), pa.array([sorted(f[2]) for f in found], pa.list_(kind))],
        names=[*names, "n_words", "n_hit", "items"],
    )


def contamination(docs: DataFrame, bench: DataFrame, text: str = "text", item: str = "item_id", bench_text: str = "text", window: int = 10, bound: int = BOUND) -> DataFrame:
    """The documents with n_words, n_hit (words within a window's occurrence) and items (those whose windows occur), instead of columns of these names."""
    docs = docs.select(*[c for c in docs.columns if c not in ("n_words", "n_hit", "items")])
    windows = cut(item_windows(bench, item, bench_text, window))
    size = windows.agg(F.sum(F.octet_length("window") + 8 * F.size("items"))).first()[0] or 0
    small = size <= bound
    words = windows.select(F.posexplode(F.split(F.col("window").cast("string"), " ")).alias("place", "word"), "window", "items").withColumn("word", F.col("word").cast("binary"))
    vocabulary = {bytes(r.word) for r in words.select("word").distinct().toLocalIterator()} if small else None
    counts = word_counts(docs, text, vocabulary)
    # at a window's rarest word, the least by bytes of those; at its first place
    rare = Window.partitionBy("window").orderBy(F.coalesce("n", F.lit(0)), "word", "place")
    prefix = words.join(F.broadcast(counts) if small else counts, "word", "left").withColumn("r", F.row_number().over(rare)).where("r = 1").select("word", "place", "window", "items")
    fields = T.StructType([*docs.schema.fields, *(T.StructField(n, T.LongType()) for n in ("n_words", "n_hit")), T.StructField("items", T.ArrayType(bench.schema[item].dataType))])
    at, names, kind = docs.columns.index(text), docs.columns, _arrow(bench.schema[item].dataType)

    if small:
        rows = [(bytes(r.word), r.place, bytes(r.window), r["items"]) for r in prefix.collect()]
        index = docs.sparkSession.sparkContext.broadcast(Index(rows))

        def run(batch: pa.RecordBatch) -> pa.RecordBatch:
            given = [split(t) for t in batch.column(at).to_pylist()]
            found = [(len(w), *index.value.hits(w)) for w in given]
            return _out(batch.columns, names, found, kind)

        return map_arrow(docs, run, fields)

    prefix = cut(prefix)
    key, held = unused("key", names), unused("held", names)
    keyed = docs.withColumn(key, F.xxhash64(text))

    def tokens(batch: pa.RecordBatch) -> pa.RecordBatch:
        keys, out = [], []
        for k, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            found = set(split(t))
            keys += [k] * len(found)
            out += found
        return pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(out, pa.binary())], names=["k", "word"])

    seen = map_arrow(keyed.where(F.col(text).isNotNull()).select(key, text), tokens, "k long, word binary").distinct()
    candidates = seen.join(prefix, "word").groupBy("k").agg(F.max("k").alias("of"), F.collect_list(F.struct("word", "place", "window", "items")).alias(held)).select("of", held)
    # both sides are shuffles of their own, so that Spark can split the partition of a text with very many copies
    of = unused("of", [*names, key, held])
    joined = keyed.join(candidates.withColumnRenamed("of", of), F.col(key) == F.col(of), "left").select(*names, held)

    def verify(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = []
        for t, rows in zip(batch.column(at).to_pylist(), batch.column(len(names)).to_pylist(), strict=True):
            given = split(t)
            found.append((len(given), *Index([(r["word"], r["place"], r["window"], r["items"]) for r in rows or ()]).hits(given)))
        return _out(batch.columns[: len(names)], names, found, kind)

    return map_arrow(joined, verify, fields)


def _arrow(kind: T.DataType) -> pa.DataType:
    from pyspark.sql.pandas.types import to_arrow_type

    return to_arrow_type(kind)
