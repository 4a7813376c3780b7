"""N-gram Jaccard join with PartEnum signatures (operator 10).

A document's set holds its distinct shingles.  Equal sets are one class first, so
thousands of copies are one row.  Sizes are cut into bands such that two sets that
link lie in the same or neighbouring bands.  A set has signatures for its own band and
for the next one, where its larger partners are.  For a band, the feature domain is split
into parts.  From ``PAIRS_FROM`` percent on, a part has three sub-parts and its signatures
are the three pairs of them, of which one stays whole while at most one element of the part
differs; below, a part is its own signature, which stays whole while no element differs.

A set that differs from any partner in at most k elements leaves out its small signatures,
and still no link is lost: it takes the largest size m such that more of its parts than the
differing elements can break hold signatures of m elements or more, and gives all signatures
of at least m.  Of two linked sets, that with the larger m has an unbroken part, whose
signature has m elements or more, so the other one gives it too.  A set without such an m
(a part may be empty) gives all signatures of any element and also its prefix, the least
elements by hash of which linked sets must share one; two such sets meet there.  This holds
for every similarity and size, with no probability left.  (k = 0: the set is its own
signature, which is the class.)

A task gives a signature once and ties its further sets to the first, so a signature of very
many sets is a few rows.  Classes that share signatures form candidate groups (components of
these ties).  Only there are sets compared, exactly: in a task, elements of one set only count
for nothing; elements with the same sets, and then sets with the same elements, are counted
once with their weight; and the intersections of a block of sets with all others are sums over
elements, as matrix products where elements are frequent.  Pairs are never listed.  A group of
more than ``block`` elements or ``SETS`` sets is cut into cells by band and hash; each pair of
cells of equal or neighbouring bands is one task, and no pair of rows is ever shuffled.

Defined results: null and empty texts have the empty set and link with nothing;
equal texts link; repeated rows give repeated results (keys are otherwise taken to
be unique); a null key is in no component; other columns don't matter.
"""

from __future__ import annotations

import bisect
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from xxhash import xxh3_128_digest

from palimpsest.cluster import cut, map_arrow
from palimpsest.operators.graph import components
from palimpsest.llm.words import mix, shingles

#: Below this similarity the parts aren't divided.
PAIRS_FROM = 85
#: Elements and sets that a task compares with each other.
BLOCK = 2_000_000
SETS = 60_000
#: Counts of pairs that a task holds at once; nanoseconds of a count in a matrix product and one by one.
COUNTS = 4_000_000
DENSE, SPARSE = 0.05, 8.0


class Bands:
    """Bands of set sizes for links where 100 * |A and B| >= percent * |A or B|."""

    def __init__(self, percent: int):
        self.percent, self.low = percent, [1]

    def of(self, size: int) -> int:
        while self.low[-1] <= size:
            self.low.append(self.low[-1] * 100 // self.percent + 1)
        return bisect.bisect_right(self.low, size) - 1

    def parts(self, band: int) -> int:
        """Parts of a band's feature domain: more than the elements can break in which two linked sets differ, and some to choose from."""
        most = 2 * (self.low[band] * 100 // self.percent) * (100 - self.percent) // (100 + self.percent)
        return (most + 2) // 2 + 6 * (most >= 24) if self.percent >= PAIRS_FROM else most * 3 // 2 + 3


def signatures(h: np.ndarray, bands: Bands) -> np.ndarray:
    """Signatures of a set, for its own band and the next one, and its prefix where that is needed."""
    size, percent = len(h), bands.percent
    own, out = bands.of(size), []
    bands.of(bands.low[own + 1])
    m, needy = mix(h), False
    spread, at_random = m >> np.uint64(20), mix(m)
    pairs = percent >= PAIRS_FROM
    for band in (own, own + 1):
        partner = min(size * 100 // percent, bands.low[band] * 100 // percent)
        k = (100 - percent) * (size + partner) // (100 + percent)
        if partner < bands.low[band] or not k:
            continue
        n = bands.parts(band)
        subs = 3 * n if pairs else n
        at = (spread % np.uint64(subs)).astype(np.int64)
        sums = np.zeros(subs, np.uint64)
        np.add.at(sums, at, at_random)
        counts = np.bincount(at, minlength=subs)
        sums = mix(sums + np.arange(subs, dtype=np.uint64)) + (np.uint64(band) << np.uint64(40))
        if pairs:
            sums, counts = sums.reshape(-1, 3), counts.reshape(-1, 3)
            whole, broken = counts.sum(axis=1) - counts.max(axis=1), k // 2
        else:
            whole, broken = counts, k
        least = int(np.sort(whole)[n - 1 - broken]) if broken < n else 0
        needy |= not least
        if pairs:
            for a, b in ((0, 1), (0, 2), (1, 2)):
                some = counts[:, a] + counts[:, b] >= max(least, 1)
                out.append(mix(mix(sums[some, a]) ^ sums[some, b] + np.uint64(a * 3 + b)))
        else:
            out.append(mix(sums[counts >= max(least, 1)]))
    if needy:
        out.append(np.sort(at_random)[: size - -(-size * percent // 100) + 1])
    return np.concatenate(out) if out else h[:0]


def classes(docs: DataFrame, key: str, text: str, n: int, percent: int) -> DataFrame:
    """Rows (id, size, band, digest, node) of the texts; node is half of the set's digest, null for the empty set."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        sets = [shingles(t, n) for t in batch.column(1).to_pylist()]
        digests = [xxh3_128_digest(h.tobytes()) if len(h) else None for h in sets]
        bands = Bands(percent)
        return pa.RecordBatch.from_arrays(
            [
                batch.column(0),
                pa.array([len(h) for h in sets], pa.int64()),
                pa.array([bands.of(len(h)) if len(h) else None for h in sets], pa.int32()),
                pa.array(digests, pa.binary()),
                pa.array([None if d is None else int.from_bytes(d[:8], "little", signed=True) for d in digests], pa.int64()),
            ],
            names=["id", "size", "band", "digest", "node"],
        )

    return map_arrow(docs.select(F.col(key).alias("id"), text), run, f"id {docs.schema[key].dataType.simpleString()}, size long, band int, digest binary, node long")


#: Sets that a task remembers, so that copies in one task give their signatures once; signatures that it holds to tie those that are equal.
SEEN = 1_000_000
HELD = 400_000


def _ties(sig: np.ndarray, node: np.ndarray, head: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of rows in order of sig: whether a row is the first of its sig, and the distinct pairs of a later row's node with the first one's."""
    later = np.flatnonzero(~head)
    a, b = node[later], node[np.maximum.accumulate(np.where(head, np.arange(len(sig)), 0))[later]]
    if not len(a):
        return head, a, b
    order = np.lexsort((b, a))
    a, b = a[order], b[order]
    new = np.append(True, (a[1:] != a[:-1]) | (b[1:] != b[:-1])) & (a != b)
    return head, a[new], b[new]


def _rows(sig: np.ndarray, node: np.ndarray, to: np.ndarray | None) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(sig), pa.array(node), pa.nulls(len(sig), pa.int64()) if to is None else pa.array(to)], names=["sig", "node", "to"])


def signed(docs: DataFrame, text: str, n: int, percent: int) -> DataFrame:
    """Rows (sig, node, null) and, for a sig that a task had before, rows (any number, node, to) with the node that had it."""

    def start():
        seen: set[int] = set()
        nodes: list[int] = []
        sigs: list[np.ndarray] = []
        held = [0]

        def flush() -> list[pa.RecordBatch]:
            sig = np.concatenate([np.empty(0, np.uint64), *sigs]).view(np.int64)
            node = np.repeat(np.array(nodes, np.int64), [len(s) for s in sigs])
            sigs.clear()
            nodes.clear()
            held[0] = 0
            order = np.argsort(sig)
            sig, node = sig[order], node[order]
            head, a, b = _ties(sig, node, np.append(True, sig[1:] != sig[:-1])[: len(sig)])
            return [_rows(sig[head], node[head], None), _rows(mix(a.view(np.uint64)).view(np.int64), a, b)]

        def run(batch: pa.RecordBatch) -> list[pa.RecordBatch]:
            bands = Bands(percent)
            for t in batch.column(0).to_pylist():
                h = shingles(t, n)
                node = int.from_bytes(xxh3_128_digest(h.tobytes())[:8], "little", signed=True)
                if len(h) and node not in seen:
                    if len(seen) < SEEN:
                        seen.add(node)
                    sigs.append(signatures(h, bands))
                    nodes.append(node)
                    held[0] += len(sigs[-1])
            return flush() if held[0] > HELD else []

        run.rest = flush
        return run

    return map_arrow(docs.select(text), start, "sig long, node long, to long", task=True)


def ties(dealt: DataFrame) -> DataFrame:
    """Rows (a, b) that tie all nodes of a sig together, of what signed() gives."""

    def start():
        last: list[int | None] = [None, None]

        def run(batch: pa.RecordBatch) -> pa.RecordBatch:
            to = batch.column(2)
            known = batch.filter(to.is_valid())
            fresh = batch.filter(to.is_null())
            sig, node = (fresh.column(k).to_numpy(zero_copy_only=False) for k in (0, 1))
            if last[0] is not None and len(sig):
                sig, node = np.append(last[0], sig), np.append(last[1], node)
            a = b = np.empty(0, np.int64)
            if len(sig):
                head, a, b = _ties(sig, node, np.append(True, sig[1:] != sig[:-1]))
                last[:] = int(sig[-1]), int(node[np.flatnonzero(head)[-1]])
            return pa.RecordBatch.from_arrays([pa.concat_arrays([pa.array(x), known.column(k)]) for x, k in ((a, 1), (b, 2))], names=["a", "b"])

        return run

    return map_arrow(dealt.repartition("sig").sortWithinPartitions("sig"), start, "a long, b long", rows=1 << 20, size=32 << 20, task=True)


def _grouped(keys: np.ndarray, values: np.ndarray, n: int) -> np.ndarray:
    """Sums of 64-bit values by key, for keys below n."""
    out = np.zeros(n, np.uint64)
    np.add.at(out, keys, values)
    return out


def linked(sets: list[np.ndarray], percent: int, copies: np.ndarray, side: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """For each set the first one of those that links lead to (itself, without any), and the copies of the other sets that it links with.

    side: 0 or 1; only sets of different sides are compared then."""
    n = len(sets)
    group, links = np.arange(n), np.zeros(n, np.int64)
    if n < 2:
        return group, links
    sizes = np.array([len(s) for s in sets], np.int64)
    owner = np.repeat(np.arange(n), sizes)
    _, ids, counts = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    # elements of two sets or more; those with the same sets are one, of their number's weight
    owner, ids = owner[counts[ids] > 1], ids[counts[ids] > 1]
    salt = mix(np.arange(1, n + 1, dtype=np.uint64))
    by_element = _grouped(ids, salt[owner], len(counts))
    _, lead, column, number = np.unique(by_element[counts > 1], return_index=True, return_inverse=True, return_counts=True)
    columns = np.full(len(counts), -1)
    columns[np.flatnonzero(counts > 1)[lead]] = np.arange(len(lead))
    shared = np.bincount(owner, minlength=n)
    # sets of equal size with the same of these elements are one class
    by_set = _grouped(owner, mix(by_element[ids]), n) + mix(sizes.astype(np.uint64) * np.uint64(2) + (0 if side is None else side.astype(np.uint64)))
    _, first, cls, members = np.unique(by_set, return_index=True, return_inverse=True, return_counts=True)
    sides = np.zeros(n, np.int64) if side is None else side
    order = np.lexsort((sizes[first], sides[first]))
    place = np.empty_like(order)
    place[order] = np.arange(len(order))
    first, members, cls = first[order], members[order], place[cls]
    total = np.bincount(cls, copies, len(first)).astype(np.int64)
    size, r = sizes[first], len(first)
    kept = (columns[ids] >= 0) & (first[cls[owner]] == owner)
    row, col = cls[owner[kept]], columns[ids[kept]]
    by_row = np.lexsort((col, row))
    row, col = row[by_row], col[by_row]
    row_at = np.searchsorted(row, np.arange(r + 1))
    by_col = np.lexsort((row, col))
    post = row[by_col]
    col_at = np.searchsorted(col[by_col], np.arange(len(number) + 1))
    weight = number.astype(np.float32)

    root, found = np.arange(r), np.zeros(r, np.int64)
    inner = shared[first]
    own = (members > 1) & (100 * inner >= percent * (2 * size - inner)) & (side is None)
    any_link = own.copy()
    left = r if side is None else int((sides[first] == 0).sum())
    at = 0
    while at < left:
        begin = at if side is None else left
        width = r - begin
        end = min(left, at + max(1, min(512, COUNTS // max(width, 1))))
        # partners lie between these, as classes of a side are in order of size
        if side is None:
            stop = int(np.searchsorted(size, size[end - 1] * 100 // percent, "right"))
        else:
            begin += int(np.searchsorted(size[left:], -(-size[at] * percent // 100)))
            stop = left + int(np.searchsorted(size[left:], size[end - 1] * 100 // percent, "right"))
        width = stop - begin
        if width > 0:
            both = _intersections(row[row_at[at] : row_at[end]] - at, col[row_at[at] : row_at[end]], end - at, begin, stop, post, col_at, weight)
            hit = both * np.float32(100 + percent) >= np.add.outer(size[at:end], size[begin:stop]).astype(np.float32) * np.float32(percent)
            hit &= both > 0
            if side is None:
                hit[:, : end - at] = np.triu(hit[:, : end - at], 1)
            ahead = hit @ total[begin:stop].astype(np.float64)
            found[at:end] += ahead.astype(np.int64)
            found[begin:stop] += (total[at:end].astype(np.float64) @ hit).astype(np.int64)
            any_link[begin:stop] |= hit.any(axis=0)
            for i in np.flatnonzero(ahead).tolist():
                any_link[at + i] = True
                labels = root[begin:stop][hit[i]]
                if (labels != root[at + i]).any():
                    labels = np.unique(np.append(labels, root[at + i]))
                    root[np.isin(root, labels)] = labels[0]
        at = end
    links[:] = found[cls] + np.where(own[cls], total[cls] - copies, 0)
    tied = any_link[cls]
    lowest = np.full(r, n)
    np.minimum.at(lowest, root[cls[tied]], np.flatnonzero(tied))
    group[tied] = lowest[root[cls[tied]]]
    return group, links


def _intersections(row: np.ndarray, col: np.ndarray, n: int, begin: int, stop: int, post: np.ndarray, col_at: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Weights of the elements (row, col) of n classes that the classes from begin to stop hold too, of the lists of classes in post."""
    width = stop - begin
    out = np.zeros((n, width), np.float32)
    used, where, times = np.unique(col, return_inverse=True, return_counts=True)
    held = np.concatenate([np.empty(0, np.int64), *[post[col_at[c] : col_at[c + 1]] for c in used.tolist()]])
    lengths = col_at[used + 1] - col_at[used]
    within = (held >= begin) & (held < stop)
    lengths = np.add.reduceat(np.append(within, False).astype(np.int64), np.cumsum(lengths) - lengths) if len(used) else lengths
    held = held[within] - begin
    starts = np.cumsum(lengths) - lengths
    dense = times * lengths * SPARSE > n * width * DENSE + width
    for part in np.array_split(np.flatnonzero(dense), max(1, -(-int(dense.sum()) // 256))):
        if not len(part):
            continue
        number = np.full(len(used), -1)
        number[part] = np.arange(len(part))
        x, y = np.zeros((n, len(part)), np.float32), np.zeros((len(part), width), np.float32)
        mine = number[where] >= 0
        x[row[mine], number[where[mine]]] = weight[col[mine]]
        for k, p in enumerate(part.tolist()):
            y[k, held[starts[p] : starts[p] + lengths[p]]] = 1
        out += x @ y
    light = np.flatnonzero(~dense[where]) if len(where) else where
    many = lengths[where[light]]
    flat = out.reshape(-1)
    for part in np.array_split(light, max(1, -(-int(many.sum()) // COUNTS))):
        many = lengths[where[part]]
        if many.sum():
            step = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
            to = np.repeat(row[part] * width, many) + held[np.repeat(starts[where[part]], many) + step]
            np.add.at(flat, to, np.repeat(weight[col[part]], many))
    return out


def compared(groups: DataFrame, n: int, percent: int) -> DataFrame:
    """Rows (a, b) that tie the linked ids of each group together, and (a, null, links) with each id's number of links by class, from rows (task, two, side, id, copies, text)."""

    def run(pdf):
        import pandas as pd

        pdf = pdf.drop_duplicates("id")
        two = bool(pdf["two"].iloc[0])
        ids = pdf["id"].to_numpy()
        group, links = linked([shingles(t, n) for t in pdf["text"]], percent, pdf["copies"].to_numpy(), (pdf["side"] != pdf["side"].min()).to_numpy(np.int64) if two else None)
        tied, some = np.flatnonzero(group != np.arange(len(ids))), np.flatnonzero(links)
        b = np.concatenate([ids[group[tied]], np.zeros(len(some), np.int64)])
        return pd.DataFrame(
            {
                "a": pd.array(np.concatenate([ids[tied], ids[some]]), "Int64"),
                "b": pd.arrays.IntegerArray(b, np.arange(len(b)) >= len(tied)),
                "links": pd.array(np.concatenate([np.zeros(len(tied), np.int64), links[some]]), "Int64"),
            }
        )

    return groups.groupBy("task").applyInPandas(run, "a long, b long, links long")


def jaccard_components(docs: DataFrame, key: str = "doc_id", text: str = "text", n: int = 3, percent: int = 90, block: int = BLOCK, most: int = SETS) -> DataFrame:
    """Rows (key, n_shingles, component_id, n_links): the component's smallest key, and the number of other rows that a row links with.

    The key is an integer; rows whose key is null come back with null component and links."""
    rows = cut(classes(docs, key, text, n, percent))
    cls = rows.where("digest IS NOT NULL AND id IS NOT NULL").groupBy("digest", "node").agg(F.min("id").alias("rep"), F.count("*").alias("copies"), F.max("size").alias("size"), F.max("band").alias("band"))
    member = components(ties(signed(docs, text, n, percent))).join(cls, "node").select("rep", "component", "copies", "size", "band")
    # cells of each band of the large groups, and of the bands next to it; one row a group and band
    order = Window.partitionBy("component").orderBy("band")
    parts = member.groupBy("component", "band").agg(F.greatest(F.sum("size") / block, F.count("*") / F.lit(float(most))).alias("part")).withColumn("total", F.sum("part").over(Window.partitionBy("component")))
    parts = parts.withColumn("cells", F.when(F.col("total") <= 1, 0).otherwise(F.ceil(F.col("part") * 2)).cast("int"))
    near = lambda f, step: F.when(f("band").over(order) == F.col("band") + step, f("cells").over(order)).otherwise(0)
    parts = parts.withColumns({"below": near(F.lag, -1), "above": near(F.lead, 1)}).drop("part", "total")
    member = member.join(parts, ["component", "band"]).withColumn("cell", F.pmod(F.xxhash64("rep"), F.greatest("cells", F.lit(1))).cast("int"))
    numbers = lambda c: F.filter(F.sequence(F.lit(0), F.greatest(c, F.lit(1)) - 1), lambda j: j < c)
    task = lambda two, side, *name: F.struct(F.concat_ws("/", *[x.cast("string") for x in name]).alias("task"), two.alias("two"), side.alias("side"))
    comp, band, cell = F.col("component"), F.col("band"), F.col("cell")
    alone = F.array(task(F.lit(False), F.lit(0), comp))
    tasks = F.concat(
        F.transform(numbers(F.col("cells")), lambda j: task(j != cell, cell, comp, band, F.least(cell, j), F.greatest(cell, j))),
        F.transform(numbers(F.col("above")), lambda j: task(F.lit(True), F.lit(0), comp, band, cell, F.lit("up"), j)),
        F.transform(numbers(F.col("below")), lambda j: task(F.lit(True), F.lit(1), comp, band - 1, j, F.lit("up"), cell)),
    )
    member = member.select(F.col("rep").alias("id"), "copies", F.explode(F.when(F.col("cells") == 0, alone).otherwise(tasks)).alias("t")).select("id", "copies", "t.*")
    texts = docs.select(F.col(key).alias("id"), F.col(text).alias("text"))
    found = cut(compared(texts.join(member, "id"), n, percent))
    comp = components(found.where("b IS NOT NULL")).select(F.col("node").alias("rep"), "component")
    links = found.where("b IS NULL").groupBy(F.col("a").alias("rep")).agg(F.sum("links").alias("links"))
    named = cls.join(comp, "rep", "left").join(links, "rep", "left").select("digest", F.coalesce("component", "rep").alias("component_id"), (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"))
    out = rows.drop("band").join(named, "digest", "left")
    alone = F.col("digest").isNull() | F.col("id").isNull()
    return out.select(
        F.col("id").alias(key), F.col("size").alias("n_shingles"),
        F.when(alone, F.col("id")).otherwise(F.col("component_id")).alias("component_id"),
        F.when(alone, F.lit(0)).otherwise(F.col("n_links")).alias("n_links"),
    )
