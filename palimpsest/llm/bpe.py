"""Byte-level BPE encoding and decoding (operator 9).

Method: recursive DuckDB queries, one embedded database per Python worker.
Every distinct pre-token becomes token-position rows ``(w, pos, tok)``; each
recursion step joins neighbouring rows with the merge table and contracts the
leftmost pair of least rank of each word, until no row pair joins any more.
Decoding joins token-position rows with the vocabulary and aggregates the
token bytes in position order.

Texts are cut into chunks before each lone white-space character between two
others.  No pre-token of the pattern crosses such a place and no look-ahead
sees over it, so a chunk always encodes the same way; a batch therefore
encodes each distinct chunk once, and a task keeps the ids of the words it has
met (emptied beyond ``KEPT_WORDS`` words, which costs time, never results).

A long word (a sequence, a minified file, a text without spaces) is cut into pieces, which
are encoded apart; then neighbours are joined, half as many pieces each time.  Tokens are the
encoding of a text exactly if each two neighbours are that of their own text: the first
contraction over a border between two of them would also be made there.  So a window of tokens
around the seam is encoded anew, until its outermost tokens stay as they were, for then all
pairs are ones that were right before, or are inside the window.  Memory and time are
proportional to the word's length.

Defined results: null text is the empty text, it has no tokens; repeated rows
are encoded each; further columns are kept by ``encode`` and ``decode``, but for one
named as the new one; an empty table gives no rows; ids of any size below 2**31.
"""

from __future__ import annotations

import base64
import gc
import hashlib
import re

import duckdb
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from palimpsest.cluster import broadcast_once, map_arrow

#: Words whose ids a task keeps; rows over all steps that one recursive query may make, about; longest word of the leftmost-only query (keys hold positions in 6 bits).
KEPT_WORDS = 400_000
BATCH_ROWS = 2_000_000
LONG_WORD = 63
#: Bytes of a piece of a long word; tokens on each side of a seam that are encoded anew at first; ids that one query decodes.
PIECE = 32
REACH = 4
DECODED = 500_000
#: Memory that a worker's database may take; it never writes to a disk.
MEMORY = "700MB"

# Chunk borders; Python's white space contains the pattern's.
BORDER = re.compile(r"(?<=\S)(?=\s\S)")

SHORT = """
WITH RECURSIVE s AS (
    SELECT w, pos, tok, 0 AS it FROM init
    UNION ALL
    (
        WITH pairs AS MATERIALIZED (
            SELECT p.w, p.pos, p.tok, p.it, m.rank, (m.rank * 64 + p.npos) * 64 + p.pos AS key
            FROM (
                SELECT *, lead(pos) OVER o AS npos, CASE WHEN lead(w) OVER o = w THEN lead(tok) OVER o END AS nxt
                FROM s WINDOW o AS (ORDER BY w * 64 + pos)
            ) p LEFT JOIN merges m ON m.pair = p.tok * 4294967296::BIGINT + p.nxt
        ),
        best AS (SELECT w, min(key) AS key FROM pairs WHERE key IS NOT NULL GROUP BY w)
        SELECT p.w, p.pos, CASE WHEN p.pos = best.key % 64 THEN p.rank ELSE p.tok END, p.it + 1
        FROM pairs p JOIN best ON best.w = p.w
        WHERE p.pos <> (best.key // 64) % 64
    )
)
"""

# For windows of long words: all occurrences of the least rank at once, every second one of
# those that overlap.  A rank marked risky can make a pair of lower rank, which
# must come before its further occurrences, so only the leftmost is contracted.
LONG = """
WITH RECURSIVE s AS (
    SELECT w, pos, tok, 0 AS it FROM init
    UNION ALL
    SELECT w, pos, CASE WHEN take THEN rank ELSE tok END, it + 1
    FROM (
        SELECT *, lag(take, 1, false) OVER (PARTITION BY w ORDER BY pos) AS gone
        FROM (
            SELECT *, hit AND (CASE WHEN risky THEN nth = 1 ELSE (nth - min(nth) OVER (PARTITION BY w, hit, place - nth)) % 2 = 0 END) AS take
            FROM (
                SELECT *, rank IS NOT DISTINCT FROM best AS hit,
                    row_number() OVER (PARTITION BY w, rank IS NOT DISTINCT FROM best ORDER BY pos) AS nth
                FROM (
                    SELECT *, min(rank) OVER (PARTITION BY w) AS best
                    FROM (
                        SELECT p.w, p.pos, p.tok, p.it, p.place, m.rank, m.risky
                        FROM (SELECT *, lead(tok) OVER (PARTITION BY w ORDER BY pos) AS nxt,
                                row_number() OVER (PARTITION BY w ORDER BY pos) AS place FROM s) p
                        LEFT JOIN merges m ON m.pair = p.tok * 4294967296::BIGINT + p.nxt
                    )
                )
                WHERE best IS NOT NULL
            )
        )
    )
    WHERE NOT gone
)
"""

# A word's last step holds its tokens.
LAST = """
SELECT s.w, s.tok FROM s JOIN (SELECT w, max(it) AS it FROM s GROUP BY w) z ON z.w = s.w AND z.it = s.it
ORDER BY s.w, s.pos
"""

DECODE = "SELECT list(v.bytes ORDER BY t.pos) AS parts FROM toks t JOIN vocab v ON v.id = t.tok"


def parse_ranks(data: bytes) -> dict[bytes, int]:
    """The ranks of a .tiktoken file."""
    return {base64.b64decode(a): int(b) for a, b in (line.split() for line in data.splitlines() if line)}


def merge_table(ranks: dict[bytes, int]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Pairs of ids (as one number), the rank of their union, and whether that token can make a pair of lower rank."""
    left, right, rank = [], [], []
    for token, k in ranks.items():
        for i in range(1, len(token)):
            a = ranks.get(token[:i])
            if a is not None and (b := ranks.get(token[i:])) is not None:
                left.append(a)
                right.append(b)
                rank.append(k)
    a, b, k = (np.array(x, dtype=np.int64) for x in (left, right, rank))
    risky = np.union1d(a[k < a], b[k < b])
    return (a << 32) + b, k, np.isin(k, risky)


class Codec:
    """Encoder and decoder of one worker."""

    def __init__(self, data: bytes, pattern: str):
        import regex

        self.ranks = parse_ranks(data)
        self.words = regex.compile(pattern).findall
        self.bytes = {k: token for token, k in self.ranks.items()}
        self.known: dict[str, bytes] = {}
        self.first = np.array([self.ranks[bytes([i])] for i in range(256)], dtype=np.int32)
        self.db = duckdb.connect(config={"threads": 1, "memory_limit": MEMORY, "temp_directory": "", "preserve_insertion_order": "false"})
        pair, rank, risky = merge_table(self.ranks)
        self._put("merges", pair=pair, rank=rank.astype(np.int32), risky=risky)
        self._put("vocab", id=np.array(list(self.ranks.values()), np.int32), bytes=list(self.ranks))

    def _put(self, name: str, **columns) -> None:
        self.db.register("given", pa.table(columns))
        self.db.execute(f"CREATE OR REPLACE TEMP TABLE {name} AS SELECT * FROM given")
        self.db.unregister("given")

    def _merge(self, words: list[bytes], query: str) -> list[bytes]:
        sizes = np.fromiter(map(len, words), np.int32, len(words))
        ends = np.cumsum(sizes)
        self._put(
            "init",
            w=np.repeat(np.arange(len(words), dtype=np.int32), sizes),
            pos=(np.arange(ends[-1]) - np.repeat(ends - sizes, sizes)).astype(np.int32),
            tok=self.first[np.frombuffer(b"".join(words), np.uint8)],
        )
        found = self.db.execute(query + LAST).fetchnumpy()
        ids = np.asarray(found["tok"]).astype("<u4").tobytes()
        ends = np.cumsum(np.bincount(found["w"], minlength=len(words))) * 4
        return [ids[a:b] for a, b in zip([0, *ends.tolist()], ends.tolist())]

    def encode_words(self, words: list[bytes]) -> list[bytes]:
        """The ids of each word, as little-endian unsigned 32-bit integers."""
        out: list = [None] * len(words)
        todo: dict[bool, list[int]] = {False: [], True: []}
        for i, w in enumerate(words):
            if (k := self.ranks.get(w)) is not None:
                out[i] = k.to_bytes(4, "little")
            else:
                todo[len(w) > LONG_WORD].append(i)
        for rows, encoded in ((todo[False], self._apart), (todo[True], self._stitched)):
            for i, ids in zip(rows, encoded([words[i] for i in rows]), strict=True):
                out[i] = ids
        return out

    def _apart(self, words: list[bytes]) -> list[bytes]:
        """The ids of words, in queries of a bounded number of rows."""
        out: list = [None] * len(words)
        for long in (False, True):
            # in order of length, so that few batches take many steps
            rows = sorted((i for i, w in enumerate(words) if (len(w) > LONG_WORD) == long), key=lambda i: len(words[i]))
            for batch in _parts(rows, [len(words[i]) * (len(words[i]) // 2 + 1) for i in rows], BATCH_ROWS):
                for i, ids in zip(batch, self._merge([words[i] for i in batch], LONG if long else SHORT), strict=True):
                    out[i] = ids
        return out

    def _stitched(self, words: list[bytes]) -> list[bytes]:
        """The ids of long words, from those of pieces."""
        pieces = [[w[k : k + PIECE] for k in range(0, len(w), PIECE)] for w in words]
        ids = iter(self._apart([p for ps in pieces for p in ps]))
        parts = [[_numbers(next(ids)) for _ in ps] for ps in pieces]
        while any(len(p) > 1 for p in parts):
            joined = iter(self._joined([(p[k], p[k + 1]) for p in parts for k in range(0, len(p) - 1, 2)]))
            parts = [[next(joined) if k + 1 < len(p) else p[k] for k in range(0, len(p), 2)] for p in parts]
        return [np.array(p[0], "<u4").tobytes() for p in parts]

    def _joined(self, pairs: list[tuple[list[int], list[int]]]) -> list[list[int]]:
        """The ids of two texts' concatenation, from the ids of both."""
        out: list = [None] * len(pairs)
        todo, reach = list(range(len(pairs))), REACH
        while todo:
            windows = [(pairs[i][0][-reach:], pairs[i][1][:reach]) for i in todo]
            again = []
            for i, (a, b), ids in zip(todo, windows, self._apart([b"".join([self.bytes[t] for t in a + b]) for a, b in windows]), strict=True):
                (left, right), new = pairs[i], _numbers(ids)
                if (len(a) == len(left) or new[0] == a[0]) and (len(b) == len(right) or new[-1] == b[-1]):
                    out[i] = left[: len(left) - len(a)] + new + right[len(b) :]
                else:
                    again.append(i)
            todo, reach = again, 2 * reach
        return out

    def encode(self, texts: list[str]) -> list[bytes]:
        """The ids of each text, as little-endian unsigned 32-bit integers."""
        usual = [bool(t) and " ".join(t.split()) == t.replace("\n", " ") for t in texts]
        # where only lone spaces and line feeds are, string methods cut; the space is put back once for each distinct chunk
        cut = [t.replace("\n", " \n").split(" ") if u else BORDER.split(t) for t, u in zip(texts, usual, strict=True)]
        after = set().union(*(cs[1:] for cs, u in zip(cut, usual, strict=True) if u))
        whole = {cs[0] for cs in cut}.union(*(cs for cs, u in zip(cut, usual, strict=True) if not u))
        words = self.words
        split = {c: [" " + c] if c.isascii() and c.isalpha() else words(c if c[0] == "\n" else " " + c) for c in after}
        split_whole = {c: words(c) for c in whole}
        if len(self.known) > KEPT_WORDS:
            self.known.clear()
        known = self.known
        missing = list(set().union(*split.values(), *split_whole.values()).difference(known))
        if missing:
            known.update(zip(missing, self.encode_words([w.encode() for w in missing]), strict=True))
        ids, ids_whole = ({c: known[ws[0]] if len(ws) == 1 else b"".join([known[w] for w in ws]) for c, ws in x.items()} for x in (split, split_whole))
        return [
            b"".join([ids_whole[cs[0]], *[ids[c] for c in cs[1:]]]) if u else b"".join([ids_whole[c] for c in cs])
            for cs, u in zip(cut, usual, strict=True)
        ]

    def forget(self) -> None:
        """Frees the words and the tables that a task has left."""
        self.known = {}
        for name in ("init", "toks"):
            self.db.execute(f"DROP TABLE IF EXISTS {name}")

    def decode(self, ids: list[bytes]) -> list[bytes]:
        """The bytes of each text's ids."""
        out = []
        for batch in _parts(ids, [len(i) // 4 for i in ids], DECODED):
            toks = np.frombuffer(b"".join(batch), "<u4")
            if not len(toks):
                out += [b""] * len(batch)
                continue
            self._put("toks", pos=np.arange(len(toks)), tok=toks.astype(np.int32))
            parts = self.db.sql(DECODE).to_arrow_table()["parts"].combine_chunks().flatten()
            if len(parts) != len(toks):
                raise ValueError("an id is not in the vocabulary")
            offsets = np.frombuffer(parts.buffers()[1], np.int32)[parts.offset :]
            data = memoryview(parts.buffers()[2])
            ends = offsets[np.cumsum([len(i) // 4 for i in batch])].tolist()
            out += [bytes(data[a:b]) for a, b in zip([int(offsets[0]), *ends], ends)]
        return out


def _numbers(ids: bytes) -> list[int]:
    return np.frombuffer(ids, "<u4").tolist()


def _parts(rows: list, sizes: list[int], most: int):
    """The rows in runs of at most so much, or of one row."""
    batch, total = [], 0
    for row, size in zip(rows, sizes, strict=True):
        if batch and total + size > most:
            yield batch
            batch, total = [], 0
        batch.append(row)
        total += size
    if batch:
        yield batch


_CODECS: dict[str, Codec] = {}


def codec(data: bytes, pattern: str) -> Codec:
    """This worker's codec; tasks that run one after another in a worker share it."""
    key = hashlib.sha256(data + pattern.encode()).hexdigest()
    if key not in _CODECS:
        _CODECS[key] = Codec(data, pattern)
    return _CODECS[key]


def _file(path: str) -> bytes:
    with open(path, "rb") as f:
        return f.read()


def _add(schema: T.StructType, **fields: T.DataType) -> T.StructType:
    return T.StructType([f for f in schema.fields if f.name not in fields] + [T.StructField(k, v) for k, v in fields.items()])


def _with(batch: pa.RecordBatch, **columns) -> pa.RecordBatch:
    names = [n for n in batch.schema.names if n not in columns]
    return pa.RecordBatch.from_arrays([batch.column(batch.schema.get_field_index(n)) for n in names] + list(columns.values()), names=names + list(columns))


def encode(df: DataFrame, ranks_path: str, pattern: str, text: str = "text", out: str = "ids") -> DataFrame:
    """Adds the ids of the text, as array<int>.  A column already named ``out`` is replaced."""
    ranks = broadcast_once(df.sparkSession, _file(ranks_path))

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        ids = codec(ranks.value, pattern).encode([t or "" for t in batch.column(batch.schema.get_field_index(text)).to_pylist()])
        rows = [np.frombuffer(i, "<i4") for i in ids]
        offsets = np.concatenate([[0], np.cumsum([len(r) for r in rows])]).astype(np.int32)
        return _with(batch, **{out: pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate([np.empty(0, "<i4"), *rows])))})

    return map_arrow(df, run, _add(df.schema, **{out: T.ArrayType(T.IntegerType())}), rows=256)


def decode(df: DataFrame, ranks_path: str, pattern: str, ids: str = "ids", out: str = "decoded") -> DataFrame:
    """Adds the bytes that the ids stand for; null ids give no bytes."""
    ranks = broadcast_once(df.sparkSession, _file(ranks_path))

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        rows = batch.column(batch.schema.get_field_index(ids)).to_pylist()
        data = codec(ranks.value, pattern).decode([np.array(r or [], "<u4").tobytes() for r in rows])
        return _with(batch, **{out: pa.array(data, pa.binary())})

    return map_arrow(df, run, _add(df.schema, **{out: T.BinaryType()}), rows=256)


def digests(df: DataFrame, ranks_path: str, pattern: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Encodes and decodes each text; returns the key, the number of tokens and the SHA-256 of the ids and of the decoded bytes."""
    ranks = broadcast_once(df.sparkSession, _file(ranks_path))

    def start():
        c = codec(ranks.value, pattern)
        gc.disable()  # the many words that it keeps are in no cycles, but each collection would visit them

        def run(batch: pa.RecordBatch) -> pa.RecordBatch:
            ids = c.encode([t or "" for t in batch.column(1).to_pylist()])
            return pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    pa.array([len(i) // 4 for i in ids], pa.int64()),
                    pa.array([hashlib.sha256(i).hexdigest() for i in ids]),
                    pa.array([hashlib.sha256(d).hexdigest() for d in c.decode(ids)]),
                ],
                names=[key, "n_tokens", "ids_sha256", "decoded_sha256"],
            )

        def close() -> None:
            c.forget()
            gc.enable()

        run.close = close
        return run

    schema = T.StructType([df.schema[key], T.StructField("n_tokens", T.LongType()), T.StructField("ids_sha256", T.StringType()), T.StructField("decoded_sha256", T.StringType())])
    return map_arrow(df.select(key, text), start, schema, rows=4096, size=6 << 20, task=True)
