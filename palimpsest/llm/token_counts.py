"""Edit-aware token counts (operator 3).

A document's state is its text and a segment tree whose leaves are its pre-tokens; every
node holds the characters and tokens below it.  ``trees`` makes the states of documents, to be
kept as a table: the text and the leaves' characters and tokens, from which the inner sums are
added up without any encoding.  ``edited`` applies edits to stored states and gives the new ones.

An edit finds its leaves by descending.  The region to split and encode anew goes from the
nearest border before the touched leaves to the nearest one after them, the boundary context: a
border is a leaf that starts with a lone white-space character between two others, with
untouched characters around, for no pre-token of the pattern crosses such a place and no
look-ahead sees over it.  The sums above the region's leaves are updated; where the region has
more leaves than before, the sums are added up anew, still without encoding any other leaf.

Defined results: null text is empty; edits beyond the end append; null edits and null
inserts are none and empty; a text without such borders is one region; repeated rows are
states of their own; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from palimpsest.cluster import broadcast_once, map_arrow, unused

#: Pre-tokens whose counts a worker keeps (emptied beyond that, which costs time, never results).
KEPT = 300_000


class Coder:
    """Splits texts into pre-tokens and counts their tokens by a .tiktoken file's ranks."""

    def __init__(self, data: bytes, pattern: str):
        import regex
        import tiktoken

        from palimpsest.llm.bpe import parse_ranks

        self.split = regex.compile(pattern).findall
        self.encode = tiktoken.Encoding("given", pat_str=pattern, mergeable_ranks=parse_ranks(data), special_tokens={}).encode_ordinary
        self.known: dict[str, int] = {}

    def counts(self, words: list[str]) -> list[int]:
        missing = set(words).difference(self.known)
        if missing:
            if len(self.known) + len(missing) > KEPT:
                self.known = {}
                missing = set(words)
            self.known.update((w, len(self.encode(w))) for w in missing)
        return list(map(self.known.__getitem__, words))


def _heap(values: np.ndarray) -> np.ndarray:
    """The values as the last level of a heap-ordered tree of sums."""
    size = 1 << max(0, len(values) - 1).bit_length()
    out = np.zeros(2 * size, np.int64)
    out[size : size + len(values)] = values
    while size > 1:
        size //= 2
        out[size : 2 * size] = out[2 * size : 4 * size].reshape(-1, 2).sum(axis=1)
    return out


class TokenTree:
    """A text and the tree over its pre-tokens; ``encoded`` counts the characters that were split and encoded."""

    def __init__(self, coder: Coder, text: str, chars: np.ndarray | None = None, counts: np.ndarray | None = None):
        self.coder, self.text, self.encoded = coder, text, 0
        if chars is None or counts is None:
            chars, counts = self._leaves(text)
        self._build(chars, counts)

    def _leaves(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        self.encoded += len(text)
        words = self.coder.split(text)
        return np.fromiter(map(len, words), np.int64, len(words)), np.array(self.coder.counts(words), np.int64)

    def _build(self, chars: np.ndarray, counts: np.ndarray) -> None:
        self.chars, self.sums = _heap(chars), _heap(counts)
        self.size = len(self.chars) // 2

    @property
    def tokens(self) -> int:
        return int(self.sums[1])

    @property
    def length(self) -> int:
        return int(self.chars[1])

    def state(self) -> tuple[np.ndarray, np.ndarray]:
        """Characters and tokens of the leaves, without empty ones."""
        chars, counts = self.chars[self.size :], self.sums[self.size :]
        return chars[chars > 0], counts[chars > 0]

    def find(self, at: int) -> tuple[int, int]:
        """The leaf that holds a character (at the end: the last one) and where the leaf starts."""
        if at >= self.length:
            filled = np.flatnonzero(self.chars[self.size :])
            last = int(filled[-1]) if len(filled) else 0
            return last, self.length - int(self.chars[self.size + last])
        i, start = 1, 0
        while i < self.size:
            i *= 2
            if at - start >= self.chars[i]:
                start += int(self.chars[i])
                i += 1
        return i - self.size, start

    def _border(self, at: int) -> bool:
        t = self.text[at - 1 : at + 2]
        return len(t) == 3 and not t[0].isspace() and t[1].isspace() and not t[2].isspace()

    def edit(self, at: int, drop: int, insert: str) -> None:
        """Replaces ``drop`` characters from ``at`` on."""
        at = max(0, min(at, self.length))
        drop = max(0, min(drop, self.length - at))
        low, begin = self.find(at)
        high, end = self.find(at + drop) if drop else (low, begin)
        end += int(self.chars[self.size + high])
        # a border before the first touched leaf, and one after an untouched character behind the last
        while low > 0:
            low -= 1
            size = int(self.chars[self.size + low])
            begin -= size
            if size and begin and begin < at - 1 and self._border(begin):
                break
        high += 1
        while high < self.size and not (end > at + drop and self._border(end)):
            end += int(self.chars[self.size + high])
            high += 1
        fresh = self.text[begin:at] + insert + self.text[at + drop : end]
        chars, counts = self._leaves(fresh)
        self.text = self.text[:begin] + fresh + self.text[end:]
        if len(chars) > high - low:
            parts = [(self.chars, chars), (self.sums, counts)]
            rows = [np.concatenate([old[self.size : self.size + low], new, old[self.size + high :]]) for old, new in parts]
            self._build(rows[0][rows[0] > 0], rows[1][rows[0] > 0])
            return
        for heap, new in ((self.chars, chars), (self.sums, counts)):
            a, b = self.size + low, self.size + high
            heap[a:b] = 0
            heap[a : a + len(new)] = new
            while a > 1:
                a, b = a // 2, (b - 1) // 2 + 1
                heap[a:b] = heap[2 * a : 2 * b].reshape(-1, 2).sum(axis=1)


_CODERS: dict[str, Coder] = {}


def coder(data: bytes, pattern: str) -> Coder:
    """A worker's coder; it makes it once."""
    key = hashlib.sha256(data + pattern.encode()).hexdigest()
    if key not in _CODERS:
        _CODERS[key] = Coder(data, pattern)
    return _CODERS[key]


def _ranks(df: DataFrame, path: str):
    with open(path, "rb") as f:
        return broadcast_once(df.sparkSession, f.read())


def _lists(rows: list[np.ndarray]) -> pa.ListArray:
    ends = np.concatenate([[0], np.cumsum([len(r) for r in rows])]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([np.empty(0, np.int64), *rows]).astype(np.int32)))


STATE = [T.StructField("chars", T.ArrayType(T.IntegerType())), T.StructField("counts", T.ArrayType(T.IntegerType()))]


def trees(docs: DataFrame, ranks_path: str, pattern: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Rows (key, text, chars, counts): the states of documents."""
    ranks = _ranks(docs, ranks_path)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        one = coder(ranks.value, pattern)
        texts = [t or "" for t in batch.column(1).to_pylist()]
        words = [one.split(t) for t in texts]
        chars = [np.fromiter(map(len, w), np.int64, len(w)) for w in words]
        counts = [np.array(one.counts(w), np.int64) for w in words]
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string()), _lists(chars), _lists(counts)], names=[key, "text", "chars", "counts"])

    return map_arrow(docs.select(key, text), run, T.StructType([docs.schema[key], T.StructField("text", T.StringType()), *STATE]), rows=512, size=2 << 20)


def with_edits(states: DataFrame, edits: DataFrame, key: str = "doc_id") -> DataFrame:
    """Adds each document's edits, in order of seq, of rows (key, seq, at, drop, insert), as a column ``edits``."""
    given = unused("given", states.columns)
    lists = edits.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("seq", "at", "drop", "insert"))).alias(given))
    one = F.transform(given, lambda e: F.struct(e["at"].cast("long").alias("at"), e["drop"].cast("long").alias("drop"), e["insert"].alias("insert")))
    return states.join(lists, key, "left").withColumn("edits", one).drop(given)


def edited(states: DataFrame, ranks_path: str, pattern: str, key: str = "doc_id", edits: str = "edits") -> DataFrame:
    """Rows (key, text, chars, counts, n_tokens, n_tokens_after, encoded_chars): the states after a column of edits (array of at, drop, insert), tokens before and after, and the characters that the edits had encoded."""
    ranks = _ranks(states, ranks_path)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        one = coder(ranks.value, pattern)
        out: list[tuple] = []
        leaves: tuple[list, list] = ([], [])
        lists = [(c.offsets.to_numpy(), c.values.to_numpy(zero_copy_only=False)) for c in (batch.column(2), batch.column(3))]
        for k, (t, todo) in enumerate(zip(batch.column(1).to_pylist(), batch.column(4).to_pylist(), strict=True)):
            tree = TokenTree(one, t or "", *(values[ends[k] : ends[k + 1]] for ends, values in lists))
            before = tree.tokens
            for e in todo or ():
                if e is not None:
                    tree.edit(e["at"] or 0, e["drop"] or 0, e["insert"] or "")
            for kept, column in zip(leaves, tree.state(), strict=True):
                kept.append(column)
            out.append((tree.text, before, tree.tokens, tree.encoded))
        texts, *numbers = ([r[k] for r in out] for k in range(4))
        return pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array(texts, pa.string()), _lists(leaves[0]), _lists(leaves[1]), *(pa.array(n, pa.int64()) for n in numbers)],
            names=[key, "text", "chars", "counts", "n_tokens", "n_tokens_after", "encoded_chars"],
        )

    fields = [states.schema[key], T.StructField("text", T.StringType()), *STATE, *(T.StructField(n, T.LongType()) for n in ("n_tokens", "n_tokens_after", "encoded_chars"))]
    return map_arrow(states.select(key, "text", "chars", "counts", edits), run, T.StructType(fields), rows=512, size=4 << 20)
