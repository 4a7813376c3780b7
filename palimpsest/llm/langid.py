"""Language identification with hashed subword embeddings (operator 8).

A text's bytes are lowered and all but letters become spaces; every run of 2 to 4 bytes
without an inner space is hashed to a row of an embedding table, the rows are averaged,
and a linear softmax gives the languages.  The model is trained by stochastic gradient
descent in numpy on a bounded sample of labelled rows; a part of the sample is held
back to fit the temperature of the softmax and the score below which a text is rejected.
The average and the linear layer are both linear, so prediction looks up the layer's
product with the table: one row of a few floats for each n-gram of the whole text.

Defined results: null texts and texts without letters are ``und`` with score 0 and are
rejected; without any labelled row all texts are ``und``; equal texts get equal results;
ties go to the first language in string order; repeated rows are rows each; an empty table
gives no rows; other columns stay, but for those named as the new ones.  Texts of any length
are read whole, in blocks; a text of more than ``LONGEST`` bytes is not trained on.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from palimpsest.cluster import map_arrow

#: Labelled rows used for training at most (the least by a hash of their key), and the bytes of such a row at most.
SAMPLE = 3000
LONGEST = 1 << 16
#: Bytes whose n-grams are looked up at once.
BLOCK = 1 << 22
SIZES = (2, 3, 4)
BUCKETS = 1 << 16
DIM = 16
#: Steps of the descent: passes over the sample, or a least number where the sample is small.
EPOCHS = 5
STEPS = 12_000
UNKNOWN = "und"
#: The threshold is so far below this quantile of the scores of correctly predicted held-back texts, within bounds.
REJECTED = 0.001
MARGIN = 0.7
LEAST, MOST = 0.3, 0.45

LETTER = re.compile(r"[^\W\d_]")
SPACED = bytes(c if 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
FACTORS = np.array([0x9E3779B1, 0x85EBCA6B, 0xC2B2AE35, 0x27D4EB2F], np.uint32)


def blocks(texts: list[str]):
    """Hashes of the n-grams of all texts, and the text that each belongs to; n-grams that begin within a block of the joined bytes at a time."""
    data = [b" " + t.lower().encode().translate(SPACED) + b" " for t in texts]
    ends = np.cumsum(np.fromiter(map(len, data), np.int64, len(data)))
    every = np.frombuffer(b"".join(data), np.uint8)
    for begin in range(0, len(every), BLOCK):
        b = every[begin : begin + BLOCK + max(SIZES) - 1]
        low, high = np.searchsorted(ends, [begin, begin + len(b) - 1], "right")
        edges = np.clip(ends[low : high + 1] - begin, 0, len(b))
        owner = np.repeat(np.arange(low, high + 1, dtype=np.int32), np.diff(np.append(0, edges)))
        space = b == 32
        wide = b.astype(np.uint32)
        hashes, owners = [], []
        for n in SIZES:
            m = min(max(len(b) - n + 1, 0), BLOCK)
            h = np.full(m, n, np.uint32)
            fine = owner[:m] == owner[n - 1 : n - 1 + m]
            for i in range(n):
                h = h * FACTORS[i] + wide[i : m + i]
                if 0 < i < n - 1:
                    fine &= ~space[i : m + i]
            fine &= ~(space[:m] & space[n - 1 : n - 1 + m])
            h ^= h >> np.uint32(15)
            h *= FACTORS[1]
            hashes.append((h >> np.uint32(16))[fine] % BUCKETS)
            owners.append(owner[:m][fine])
        yield np.concatenate(hashes), np.concatenate(owners)


def ngrams(text: str) -> np.ndarray:
    return np.concatenate([h for h, _ in blocks([text])])


class Model:
    """table: for each bucket the languages' logits; an n-gram's share of its text's."""

    def __init__(self, langs: list[str], table: np.ndarray, bias: np.ndarray, temperature: float, threshold: float):
        self.langs, self.table, self.bias, self.temperature, self.threshold = langs, table, bias, temperature, threshold

    def logits(self, texts: list[str]) -> np.ndarray:
        n, sums = np.zeros(len(texts)), np.zeros((len(texts), len(self.langs)))
        for h, owner in blocks(texts):
            n += np.bincount(owner, minlength=len(texts))
            for k in range(len(self.langs)):
                sums[:, k] += np.bincount(owner, self.table[:, k][h], minlength=len(texts))
        return sums / np.maximum(n, 1)[:, None] + self.bias

    def predict(self, texts: list[str | None]) -> tuple[list[str], list[float], list[bool]]:
        """Language, score and whether the text is rejected."""
        lang, score = [UNKNOWN] * len(texts), [0.0] * len(texts)
        rows = [i for i, t in enumerate(texts) if t and LETTER.search(t)] if self.langs else []
        if rows:
            p = softmax(self.logits([texts[i] for i in rows]) / self.temperature)
            for i, k, s in zip(rows, p.argmax(axis=1).tolist(), p.max(axis=1).tolist(), strict=True):
                lang[i], score[i] = self.langs[k], s
        return lang, score, [x == UNKNOWN or s < self.threshold for x, s in zip(lang, score, strict=True)]


def softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def train(texts: list[str], labels: list[str], seed: int = 7) -> Model:
    """Fits the model; every fifth text is held back for the temperature and the threshold."""
    langs = sorted(set(labels))
    if not langs:
        return Model([], np.zeros((BUCKETS, 0), np.float32), np.zeros(0), 1.0, 1.0)
    rng = np.random.default_rng(seed)
    y = np.array([langs.index(x) for x in labels])
    bags = []
    for t in texts:
        ids, n = np.unique(ngrams(t), return_counts=True)
        bags.append((ids, (n / n.sum()).astype(np.float32)) if len(ids) else None)
    order = [i for i in rng.permutation(len(texts)) if bags[i]]
    held, fit = order[::5], [i for k, i in enumerate(order) if k % 5] or order
    table = rng.uniform(-1 / DIM, 1 / DIM, (BUCKETS, DIM)).astype(np.float32)
    layer, bias = np.zeros((DIM, len(langs)), np.float32), np.zeros(len(langs), np.float32)
    steps = max(EPOCHS * len(fit), STEPS) if fit else 0
    for step in range(steps):
        ids, share = bags[i := fit[rng.integers(len(fit))]]
        rate = np.float32(0.5 * (1 - step / steps))
        hidden = share @ table[ids]
        error = softmax((hidden @ layer + bias)[None])[0]
        error[y[i]] -= 1
        back = layer @ error
        layer -= rate * np.outer(hidden, error)
        bias -= rate * error
        table[ids] -= (rate * 20 * share)[:, None] * back
    model = Model(langs, table @ layer, bias, 1.0, LEAST)
    if held:
        z, t = model.logits([texts[i] for i in held]), y[held]

        def loss(temperature: float) -> float:
            return -np.log(softmax(z / temperature)[np.arange(len(t)), t] + 1e-12).mean()

        model.temperature = min(np.geomspace(0.05, 20, 60).tolist(), key=loss)
        p = softmax(z / model.temperature)
        right = p.max(axis=1)[p.argmax(axis=1) == t]
        if len(right):
            model.threshold = float(np.clip(MARGIN * np.quantile(right, REJECTED), LEAST, MOST))
    return model


def held_out(key: str) -> Column:
    """Whether a row is never trained on: crc32 of its key as text, mod 4, is 2."""
    return F.coalesce(F.crc32(F.col(key).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def learn(docs: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang", sample: int = SAMPLE, longest: int = LONGEST) -> Model:
    """Trains on at most ``sample`` labelled rows of at most ``longest`` bytes that aren't held out."""
    rows = docs.where(F.col(lang).isNotNull() & (F.octet_length(text) <= longest) & ~held_out(key)).select(F.col(text).alias("text"), F.col(lang).alias("lang"), F.xxhash64(F.col(key).cast("string")).alias("h"))
    # the key only deals rows out; it is no input of the model
    last = rows.select("h").orderBy("h").limit(sample).agg(F.max("h")).first()[0]
    found = rows.where(F.col("h") <= last).orderBy("h", "text", "lang").limit(sample).collect() if last is not None else []
    found = [r for r in found if LETTER.search(r.text)]
    return train([r.text for r in found], [r.lang for r in found])


def identify(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """The rows with lang_pred, score and rejected, instead of columns of these names."""
    docs = docs.select(*[c for c in docs.columns if c not in ("lang_pred", "score", "rejected")])
    at, names = docs.columns.index(text), docs.columns
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        lang, score, rejected = shared.value.predict(batch.column(at).to_pylist())
        return pa.RecordBatch.from_arrays([*batch.columns, pa.array(lang, pa.string()), pa.array(score, pa.float64()), pa.array(rejected, pa.bool_())], names=[*names, "lang_pred", "score", "rejected"])

    return map_arrow(docs, run, T.StructType([*docs.schema.fields, T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("rejected", T.BooleanType())]), rows=1024, size=1 << 19)
