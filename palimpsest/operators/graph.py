"""Connected components of an edge table, without collecting it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palimpsest.cluster import cut

#: Rounds that any graph of 2**ROUNDS nodes needs at most, by a wide margin.
ROUNDS = 60


def smallest(edges: DataFrame, what: Column) -> DataFrame:
    """Rows (node, m) for each a; node is an aggregate, so a join by it deals these few rows anew and the edges stand alone on their side."""
    return edges.groupBy("a").agg(F.min("a").alias("node"), what.alias("m")).select("node", "m")


def components(edges: DataFrame) -> DataFrame:
    """Rows (node, component) of the nodes that have edges (a, b); component is the smallest node reachable.

    Each round hangs every node's larger neighbours on the smallest one (large star), then its smaller ones
    (small star), until nothing changes: all edges then lead to the smallest node of their component.  Rounds
    grow with the logarithm of the size; each is written to the checkpoint folder.  Least neighbours are found
    with partial aggregation, and both sides of each join are shuffles of their own, so that Spark can split the
    partition of a hub.  Null ends and loops count for nothing."""
    now = cut(edges.select("a", "b").where("a <> b").distinct())
    for _ in range(ROUNDS):
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = smallest(both, F.least("a", F.min("b")))
        large = both.where("b > a").join(least, F.col("a") == F.col("node")).select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        # now a > b in each row
        ends = F.explode(F.array(F.struct("a", F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b"))))
        now = cut(large.join(smallest(large, F.min("b")), F.col("a") == F.col("node")).select(ends.alias("e")).select("e.*").where("a <> b").distinct())
        # done when it is a forest of stars: no end b is an a, and each a has one b
        twice = now.groupBy("a").agg(F.count("*").alias("n")).where("n > 1").select("a")
        inner = now.select("b").join(now.select(F.col("a").alias("b")), "b", "left_semi")
        if not twice.union(inner).limit(1).count():
            break
    else:
        raise RuntimeError("components did not converge")
    roots = now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(roots)


def shared_key_components(df: DataFrame, node: str, key: str) -> DataFrame:
    """Components of nodes that share a key: each is tied to the least of its key, so a key of many nodes makes as many edges."""
    pairs = df.select(F.col(node).alias("a"), F.col(key).alias("k")).where("a IS NOT NULL AND k IS NOT NULL").distinct()
    least = pairs.groupBy("k").agg(F.min("k").alias("key"), F.min("a").alias("b")).select("key", "b")
    edges = pairs.join(least, F.col("k") == F.col("key")).select("a", "b")
    found = components(edges).withColumnRenamed("node", node)
    return df.select(node).distinct().join(found, node, "left").select(node, F.coalesce("component", node).alias("component"))


def page_rank(edges: DataFrame, seeds: DataFrame, rounds: int = 10, damping: float = 0.85) -> DataFrame:
    """Personalised rank (node, rank) of a graph of edges (a, b), restarting at the nodes of ``seeds`` in equal parts."""
    out = edges.groupBy("a").agg(F.count("*").alias("degree"))
    links = cut(edges.join(out, "a"))
    n = seeds.agg(F.count("*").alias("n"))
    start = cut(seeds.select("node").crossJoin(F.broadcast(n)).select("node", (1.0 / F.col("n")).alias("part")))
    rank = start.withColumnRenamed("part", "rank")
    for _ in range(rounds):
        sent = links.join(rank, F.col("a") == F.col("node")).groupBy(F.col("b").alias("node")).agg((damping * F.sum(F.col("rank") / F.col("degree"))).alias("rank"))
        rank = cut(sent.unionByName(start.select("node", ((1 - damping) * F.col("part")).alias("rank"))).groupBy("node").agg(F.sum("rank").alias("rank")))
    return rank
