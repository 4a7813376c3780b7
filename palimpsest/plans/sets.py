"""Set, split, sample, budget and graph queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.operators import graph, sets
from palimpsest.plans.registry import query, table


@query("WITH u AS (SELECT s_suppkey AS id, lower(trim(n_name)) AS k, n_name AS title, 0 AS source_rank FROM supplier JOIN nation ON s_nationkey = n_nationkey UNION ALL SELECT c_custkey, lower(trim(n_name)), n_name, 1 FROM customer JOIN nation ON c_nationkey = n_nationkey), r AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY source_rank, id) AS rn FROM u) SELECT id, title, source_rank FROM r WHERE rn = 1")
def combined_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two sources in order of priority; equal titles count once."""
    nation = table(spark, sf_dir, "nation")
    s = table(spark, sf_dir, "supplier").join(nation, F.col("s_nationkey") == F.col("n_nationkey")).select(F.col("s_suppkey").alias("id"), F.col("n_name").alias("title"))
    c = table(spark, sf_dir, "customer").join(nation, F.col("c_nationkey") == F.col("n_nationkey")).select(F.col("c_custkey").alias("id"), F.col("n_name").alias("title"))
    return sets.first_wins([s, c], F.lower(F.trim("title")), "id")


CASCADE = """WITH a AS (SELECT s_nationkey % 5 AS q, s_suppkey AS id, CASE WHEN s_suppkey % 9 = 0 THEN ' ' ELSE ' Part' || s_suppkey % 4 END AS title FROM supplier),
b AS (SELECT c_nationkey % 5 AS q, c_custkey AS id, 'PART' || c_custkey % 30 AS title FROM customer),
a1 AS (SELECT *, lower(trim(title)) AS k, row_number() OVER (PARTITION BY q ORDER BY id) AS i FROM a), a2 AS (SELECT *, row_number() OVER (PARTITION BY q, k ORDER BY i) AS r FROM a1 WHERE i <= 9 AND k <> ''),
a3 AS (SELECT q, id, title, k, 0 AS source_rank, row_number() OVER (PARTITION BY q ORDER BY i) AS place FROM a2 WHERE r = 1), a4 AS (SELECT * FROM a3 WHERE place <= 7), had AS (SELECT q, count(*) AS h FROM a4 GROUP BY q),
b1 AS (SELECT b.*, lower(trim(title)) AS k, row_number() OVER (PARTITION BY q ORDER BY id) AS i FROM b), b2 AS (SELECT b1.*, coalesce(h, 0) AS h FROM b1 LEFT JOIN had USING (q)),
b3 AS (SELECT *, row_number() OVER (PARTITION BY q, k ORDER BY i) AS r FROM b2 WHERE h < 7 AND i <= 9 - h AND k <> '' AND NOT EXISTS (SELECT 1 FROM a4 WHERE a4.q = b2.q AND a4.k = b2.k)),
b4 AS (SELECT q, id, title, 1 AS source_rank, h + row_number() OVER (PARTITION BY q ORDER BY i) AS place FROM b3 WHERE r = 1)
SELECT q, id, title, source_rank, place::INT AS place FROM a4 UNION ALL SELECT q, id, title, source_rank, place::INT FROM b4 WHERE place <= 7"""


@query(CASCADE)
def cascaded_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Seven results for each of five queries, from two sources one after the other."""
    a = table(spark, sf_dir, "supplier").select((F.col("s_nationkey") % 5).alias("q"), F.col("s_suppkey").alias("id"), F.when(F.col("s_suppkey") % 9 == 0, " ").otherwise(F.concat(F.lit(" Part"), F.col("s_suppkey") % 4)).alias("title"))
    b = table(spark, sf_dir, "customer").select((F.col("c_nationkey") % 5).alias("q"), F.col("c_custkey").alias("id"), F.concat(F.lit("PART"), F.col("c_custkey") % 30).alias("title"))
    return sets.cascade([a, b], "q", F.lower(F.trim("title")), "id", 7)


@query("SELECT doc_id, lang FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def resume_remaining(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a resumed run has still to do."""
    return sets.unseen(table(spark, sf_dir, "documents").select("doc_id", "lang"), table(spark, sf_dir, "labels"), "doc_id")


SPLIT = """WITH c AS (SELECT source, count(*) AS n FROM documents GROUP BY 1), r AS (SELECT *, sum(n) OVER (ORDER BY n, source) AS so_far, floor(sum(n) OVER () * 0.1::DOUBLE) AS wanted FROM c),
s AS (SELECT source, n, CASE WHEN so_far - n < wanted THEN 'eval' ELSE 'train' END AS split FROM r)
"""


@query(SPLIT + "SELECT * FROM s")
def assign_splits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sets.splits(table(spark, sf_dir, "documents"), "source")


@query(SPLIT + "SELECT sha256(string_agg(source || chr(9) || split || chr(10), '' ORDER BY source || chr(9) || split || chr(10))) AS sha256, count(*) AS n_groups, 0::BIGINT AS n_mixed FROM s")
def split_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sets.manifest(sets.splits(table(spark, sf_dir, "documents"), "source"), "source")


@query(SPLIT + "SELECT split, lang, count(*) AS n FROM documents JOIN s USING (source) GROUP BY 1, 2")
def route_by_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of each split, by the manifest."""
    docs = table(spark, sf_dir, "documents")
    return docs.join(sets.splits(docs, "source").select("source", "split"), "source").groupBy("split", "lang").agg(F.count("*").alias("n"))


@query("WITH r AS (SELECT doc_id, lang, row_number() OVER (PARTITION BY lang ORDER BY md5(doc_id::VARCHAR || ':42'), doc_id) AS place FROM documents) SELECT doc_id, lang, place::INT AS place FROM r WHERE place <= 10")
def seeded_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ten documents of each language by a seeded order."""
    return sets.sample_per(table(spark, sf_dir, "documents").select("doc_id", "lang"), "lang", "doc_id", 10)


@query("WITH r AS (SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS place FROM documents) SELECT doc_id, source, place::INT AS place FROM r ORDER BY place, source LIMIT 50")
def round_robin(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sources in turn, fifty rows in all."""
    return sets.interleaved(table(spark, sf_dir, "documents").select("doc_id", "source"), "source", "doc_id", 50)


@query("WITH r AS (SELECT doc_id, source, n_chars, coalesce(sum(n_chars) OVER (PARTITION BY source ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS before FROM documents) SELECT * FROM r WHERE before < 5000")
def filler_until_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sets.until_budget(table(spark, sf_dir, "documents").select("doc_id", "source", "n_chars"), "source", "doc_id", "n_chars", 5000)


@query("""WITH RECURSIVE i AS (SELECT conv_id, turn, length(text) AS s, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS k FROM conversations),
f AS (SELECT conv_id, 0::BIGINT AS k, []::BIGINT[] AS taken, 0::BIGINT AS used FROM (SELECT DISTINCT conv_id FROM i)
  UNION ALL SELECT f.conv_id, i.k, CASE WHEN f.used + i.s <= 1000 THEN list_append(f.taken, i.turn) ELSE f.taken END, CASE WHEN f.used + i.s <= 1000 THEN f.used + i.s ELSE f.used END FROM f JOIN i ON i.conv_id = f.conv_id AND i.k = f.k + 1)
SELECT conv_id, max_by(taken, k) AS taken, max_by(used, k) AS used FROM f GROUP BY 1""")
def greedy_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Messages of a conversation that fit a budget, too large ones skipped."""
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.length("text").alias("size"))
    return sets.packed(rows, "conv_id", "turn", "size", 1000)


@query("""WITH RECURSIVE w AS (SELECT conv_id, turn, length(text) AS score, list_sort(list_distinct(list_filter(list_transform(regexp_split_to_array(trim(lower(text)), '\\s+'), lambda x: regexp_replace(x, '^[^a-z0-9]+|[^a-z0-9]+$', '', 'g')), lambda x: length(x) > 3))) AS words FROM conversations),
r AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY score DESC NULLS FIRST, turn) AS i FROM w),
k(conv_id, i, kept) AS (SELECT DISTINCT conv_id, 0::BIGINT, []::STRUCT(turn BIGINT, words VARCHAR[])[] FROM r UNION ALL
  SELECT k.conv_id, r.i, CASE WHEN len(coalesce(r.words, [])) = 0 OR len(kept) >= 5 OR len(list_filter(kept, lambda y: len(list_intersect(y.words, r.words)) > 0.7::DOUBLE * least(len(y.words), len(r.words)))) > 0 THEN kept ELSE list_append(kept, {'turn': r.turn::BIGINT, 'words': r.words}) END
  FROM k JOIN r ON r.conv_id = k.conv_id AND r.i = k.i + 1)
SELECT conv_id, unnest(list_transform(kept, lambda y: y.turn)) AS turn FROM (SELECT conv_id, max_by(kept, i) AS kept FROM k GROUP BY conv_id)""")
def question_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Greedy: of a conversation's messages those that overlap little with longer ones, five at most."""
    c = table(spark, sf_dir, "conversations")
    rows = c.select("conv_id", "turn", F.length("text").alias("score"), sets.word_set(F.col("text")).alias("words"))
    return sets.greedy_dedup(rows, "conv_id", "turn", "score", "words")


@query("""WITH RECURSIVE e AS (SELECT DISTINCT a.o_custkey AS a, b.o_custkey AS b FROM (SELECT DISTINCT o_custkey, date_trunc('day', o_orderdate) AS d, floor(o_totalprice / 50000) AS p FROM orders) a JOIN (SELECT DISTINCT o_custkey, date_trunc('day', o_orderdate) AS d, floor(o_totalprice / 50000) AS p FROM orders) b USING (d, p)),
r(n, m) AS (SELECT DISTINCT a, a FROM e UNION SELECT e.a, r.m FROM r JOIN e ON e.b = r.n WHERE r.m < e.a) SELECT n AS cust, min(m) AS component FROM r GROUP BY n""")
def fact_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Connected components of customers that share a day and a price class (as facts share a hunk)."""
    o = table(spark, sf_dir, "orders")
    key = F.concat_ws("/", F.date_trunc("day", "o_orderdate").cast("string"), F.floor(F.col("o_totalprice") / 50000).cast("string"))
    return graph.shared_key_components(o.select(F.col("o_custkey").alias("cust"), key.alias("key")), "cust", "key")


def _rounds(n: int) -> str:
    step = ", r{b} AS (SELECT node, sum(x) AS rank FROM (SELECT b AS node, 0.85::DOUBLE * sum(rank / degree) AS x FROM r{a} JOIN e ON a = node JOIN o USING (a) GROUP BY b UNION ALL SELECT node, (1 - 0.85::DOUBLE) * part FROM s) GROUP BY node)"
    return "".join(step.format(a=k, b=k + 1) for k in range(n)) + f" SELECT node, round(rank, 9) AS rank FROM r{n}"


@query("WITH li AS (SELECT DISTINCT 'p' || l_partkey AS a, 's' || l_suppkey AS b FROM lineitem), e AS (SELECT * FROM li UNION ALL SELECT b, a FROM li), o AS (SELECT a, count(*) AS degree FROM e GROUP BY a), s AS (SELECT 'p' || p_partkey AS node, 1::DOUBLE / count(*) OVER () AS part FROM part WHERE p_size = 1), r0 AS (SELECT node, part AS rank FROM s)" + _rounds(5))
def personalised_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rank of parts and suppliers from the parts of size 1, over their orders."""
    li = table(spark, sf_dir, "lineitem").select(F.concat(F.lit("p"), F.col("l_partkey")).alias("a"), F.concat(F.lit("s"), F.col("l_suppkey")).alias("b")).distinct()
    edges = li.unionByName(li.select(F.col("b").alias("a"), F.col("a").alias("b")))
    seeds = table(spark, sf_dir, "part").where("p_size = 1").select(F.concat(F.lit("p"), F.col("p_partkey")).alias("node"))
    return graph.page_rank(edges, seeds, 5).select("node", F.round("rank", 9).alias("rank"))


@query("WITH d AS (SELECT source, lang, count(*) AS n FROM documents GROUP BY ROLLUP (source, lang)) SELECT coalesce(source, 'all') AS source, coalesce(lang, 'all') AS lang, n FROM d")
def view_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Detail and totals."""
    d = table(spark, sf_dir, "documents").rollup("source", "lang").agg(F.count("*").alias("n"))
    return d.select(F.coalesce("source", F.lit("all")).alias("source"), F.coalesce("lang", F.lit("all")).alias("lang"), "n")
