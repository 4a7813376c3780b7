"""Queries over instances: orders and their lines, documents by source, stated fixtures."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.operators import instances as I  # noqa: E741
from palimpsest.plans.registry import query, table
from palimpsest.plans.text import TERMS


@query("SELECT * FROM (VALUES (1, 2, 1, 'a b')) t(id, n_supporting, n_distractors, text)")
def multi_hop_adapter(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = [(1, ["T", "U", "V"], [["a", "b"], ["c"], ["d"]], ["T", "V"]), (2, ["T", "U"], [["a"], ["c"]], ["U"])]
    df = I.multi_hop(spark.createDataFrame(rows, "id int, titles array<string>, sentences array<array<string>>, facts array<string>"))
    return df.select("id", F.size("supporting").alias("n_supporting"), F.size("distractors").alias("n_distractors"), F.get("supporting", F.lit(0))["text"].alias("text"))


@query("SELECT * FROM (VALUES (1, 0, 'Who is A?', 'X', 'A'), (1, 1, 'where is b', 'Y', 'B')) t(id, hop, question, answer, title)")
def decomposition_adapter(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = [(1, [(0, "A", "x"), (1, "B", "y")], [("Who is A?", "X", 0), ("where is b", "Y", None)])]
    return I.decomposed(spark.createDataFrame(rows, "id int, paragraphs array<struct<idx: int, title: string, text: string>>, steps array<struct<question: string, answer: string, idx: int>>"))


@query("WITH r AS (SELECT l_orderkey AS id, bool_or(l_returnflag = 'R') AS resolved, sum(l_quantity)::BIGINT AS tokens FROM lineitem GROUP BY 1), b AS (SELECT o_orderkey AS id, o_orderstatus = 'F' AS br, o_shippriority AS bt FROM (SELECT *, o_custkey AS o_shippriority FROM orders WHERE o_orderstatus <> 'P')) SELECT id, CASE WHEN resolved AND coalesce(br, false) THEN 'both' WHEN resolved THEN 'capability_win' WHEN coalesce(br, false) THEN 'regression' ELSE 'neither' END AS outcome, (tokens / nullif(bt, 0))::DOUBLE AS token_ratio FROM r LEFT JOIN b USING (id)")
def baseline_comparison(spark: SparkSession, sf_dir: str) -> DataFrame:
    runs = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("id")).agg(F.bool_or(F.col("l_returnflag") == "R").alias("resolved"), F.sum("l_quantity").cast("long").alias("tokens"))
    base = table(spark, sf_dir, "orders").where("o_orderstatus <> 'P'").select(F.col("o_orderkey").alias("id"), (F.col("o_orderstatus") == "F").alias("resolved"), F.col("o_custkey").alias("tokens"))
    return I.compared(runs, base, "id")


@query(f"""WITH c AS (SELECT item_id, list_distinct({TERMS.format(t='text')}) AS w FROM benchmark), x AS (SELECT item_id, unnest(w) AS word FROM c), r AS (SELECT word FROM x GROUP BY 1 HAVING count(*) > 1),
p AS (SELECT DISTINCT a.item_id AS a, b.item_id AS b FROM x a JOIN r USING (word) JOIN x b ON a.word = b.word AND a.item_id <> b.item_id), s AS (SELECT a, b, len(list_intersect(u.w, v.w)) AS shared FROM p JOIN c u ON u.item_id = a JOIN c v ON v.item_id = b),
o AS (SELECT *, row_number() OVER (PARTITION BY a ORDER BY shared DESC, b) AS rank FROM s) SELECT a AS item_id, b AS other, shared::INT AS shared, rank::INT AS rank FROM o WHERE rank <= 3""")
def cross_instance_distractors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each item the three that share the most words with it."""
    return I.similar_instances(table(spark, sf_dir, "benchmark"), "item_id", "text", 3, 20)


@query("""WITH RECURSIVE i AS (SELECT conv_id, turn, length(text) AS s, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS k FROM conversations),
f AS (SELECT conv_id, 0::BIGINT AS k, NULL::BIGINT AS turn, 0 AS bin, 0::BIGINT AS used FROM (SELECT DISTINCT conv_id FROM i)
 UNION ALL SELECT f.conv_id, i.k, i.turn, CASE WHEN used > 0 AND used + s > 600 AND bin < 2 THEN bin + 1 ELSE bin END, CASE WHEN used > 0 AND used + s > 600 AND bin < 2 THEN s ELSE used + s END FROM f JOIN i ON i.conv_id = f.conv_id AND i.k = f.k + 1)
SELECT conv_id, turn, bin FROM f WHERE k > 0""")
def ingest_bins(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Messages in at most three bins of 600 characters; the last takes the rest."""
    return I.binned(table(spark, sf_dir, "conversations").select("conv_id", "turn", F.length("text").alias("s")), "conv_id", "turn", "s", 600, 3)


@query("WITH w AS (SELECT s_suppkey, 'k' AS kind, 4 AS n FROM supplier), p AS (SELECT 'k' AS kind, r_name AS item FROM region), r AS (SELECT s_suppkey, n, item, row_number() OVER (PARTITION BY s_suppkey ORDER BY md5(s_suppkey || '/' || item || ':42'), item) AS r, count(*) OVER (PARTITION BY s_suppkey) AS size FROM w JOIN p USING (kind)) SELECT s_suppkey, 'DP' || r AS name, item FROM r WHERE r <= n")
def distractor_pool(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Four of five regions for each supplier, in a seeded order."""
    pool = table(spark, sf_dir, "region").select(F.lit("k").alias("kind"), F.col("r_name").alias("item"))
    return I.padded_sample(pool, table(spark, sf_dir, "supplier").select("s_suppkey", F.lit("k").alias("kind"), F.lit(4).alias("n")), "s_suppkey")


@query(r"SELECT doc_id, md5(regexp_replace(regexp_replace(regexp_replace(text, '(?i)\blicensed\b', 'TERMS_OF', 'g'), '(?i)\blicense\b', 'LICENCE', 'g'), '(?i)\bcopyright\b', 'Rights', 'g')) AS digest FROM documents")
def dictionary_replace(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three words of whole documents, whatever their case."""
    rows = I.substituted(table(spark, sf_dir, "documents").select("doc_id", "text"), "text", {"license": "LICENCE", "Licensed": "TERMS_OF", "copyright": "Rights"})
    return rows.select("doc_id", F.md5("text").alias("digest"))


@query("SELECT conv_id AS conv, turn AS pos, CASE WHEN count(*) OVER (PARTITION BY conv_id) - (row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1) <= 2 THEN md5(text) END AS screen FROM conversations")
def recent_screens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return I.recent_screens(table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("conv"), F.col("turn").alias("pos"), F.md5("text").alias("screen")), 2)


@query("SELECT * FROM (VALUES (1, 2, 0.5::DOUBLE, true), (2, 1, 1.0, false), (3, 0, 0.0, false)) t(inst, n_files, concentration, passed)")
def memory_distribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = [(1, ["fact number one", "fact number two"], [("a", "x fact number one"), ("b", "fact number two y")]), (2, ["fact number one", "short"], [("a", "fact number one short"), ("b", "short")]), (3, [], [])]
    return I.placed_facts(spark.createDataFrame(rows, "inst int, facts array<string>, files array<struct<name: string, content: string>>"))


@query("SELECT l_shipmode AS strategy, (count(*) FILTER (ok) / count(*))::DOUBLE AS recall, coalesce((count(*) FILTER (ok AND c) / nullif(count(*) FILTER (c), 0))::DOUBLE, 0) AS critical_recall, coalesce((count(*) FILTER (ok AND e) / nullif(count(*) FILTER (e), 0))::DOUBLE, 0) AS external_recall, round(avg((score >= 0.5)::INT), 9) AS qa_accuracy FROM (SELECT l_returnflag || l_linestatus AS l_shipmode, l_quantity > 25 AS ok, l_linenumber = 1 AS c, l_tax > 0.04 AS e, (l_partkey % 10) / 10.0 AS score FROM lineitem) GROUP BY 1")
def memory_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem").select(F.concat("l_returnflag", "l_linestatus").alias("strategy"), (F.col("l_quantity") > 25).alias("recalled"), (F.col("l_linenumber") == 1).alias("critical"), (F.col("l_tax") > 0.04).alias("external"), (F.col("l_partkey") % 10 / 10.0).alias("score"))
    return I.scores(li, "strategy").withColumn("qa_accuracy", F.round("qa_accuracy", 9))


@query("SELECT '| ' || r_name || ' | ' || count(*) || ' |' AS line FROM region JOIN nation ON n_regionkey = r_regionkey GROUP BY r_name")
def markdown_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = table(spark, sf_dir, "nation").join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey")).groupBy("r_name").agg(F.count("*").alias("n"))
    return I.markdown(n, ["r_name", "n"])


@query("SELECT * FROM (VALUES (1, 'f', 'a.py', 1, 'return f(g(1))'), (1, 'g', 'a.py', 1, 'return f(g(1))'), (1, 'f', 'b.py', 0, 'f()')) t(inst, name, path, line, text)")
def repo_callers(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = spark.createDataFrame([(1, "a.py", "def f(x):\n    return f(g(1))"), (1, "b.py", "f()")], "inst int, path string, content string")
    return I.callers(files, spark.createDataFrame([(1, "f"), (1, "g")], "inst int, name string"))


#: Each conversation as an instance: hops are its user rows, distractors its assistant rows.
INSTANCE = """WITH t AS (SELECT conv_id, turn, role, coalesce(text, '') AS text, row_number() OVER (PARTITION BY conv_id, role ORDER BY turn) - 1 AS i FROM conversations),
h AS (SELECT conv_id, i, 't' || turn AS title, text, 'a' || turn AS answer, count(*) OVER (PARTITION BY conv_id) AS n FROM t WHERE role = 'user'),
d AS (SELECT conv_id, h.i, 0 AS o, -1 AS j, h.title, h.text FROM h WHERE text <> '' UNION ALL
  SELECT t.conv_id, t.i % n, 1, t.i, 'Distractor ' || t.i, t.text FROM t JOIN (SELECT DISTINCT conv_id, n FROM h) USING (conv_id) WHERE role = 'assistant'),
f AS (SELECT conv_id, i, coalesce(string_agg('--- ' || title || ' ---' || chr(10) || d.text, chr(10) || chr(10) ORDER BY o, j), '') AS file, sum(len(regexp_extract_all(d.text, '[^ \\t\\n\\x0b\\f\\r]+'))) AS tokens FROM (SELECT DISTINCT conv_id, i FROM h) x LEFT JOIN d USING (conv_id, i) GROUP BY conv_id, i)
"""


def conversation_instances(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").withColumn("text", F.coalesce("text", F.lit("")))
    turn = F.col("turn").cast("string")
    hop = F.struct("turn", F.lit("").alias("question"), F.concat(F.lit("a"), turn).alias("answer"), F.concat(F.lit("t"), turn).alias("title"), "text")
    other = F.struct("turn", F.lit(None).cast("string").alias("title"), "text")
    lists = rows.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.when(F.col("role") == "user", hop))).alias("hops"), F.array_sort(F.collect_list(F.when(F.col("role") == "assistant", other))).alias("distractors"))
    return lists.select("conv_id", F.lit("the answer").alias("answer"), F.transform("hops", lambda h: h.dropFields("turn")).alias("hops"), F.transform("distractors", lambda d: d.dropFields("turn")).alias("distractors"))


@query(INSTANCE + "SELECT conv_id, max(n)::INT AS n_turns, string_agg('F' || h.i + 1, ',' ORDER BY h.i) FILTER (h.i < n - 1) AS required, md5(string_agg(file, '|' ORDER BY h.i)) AS files, sum(tokens)::INT AS tokens FROM h JOIN f USING (conv_id, i) GROUP BY conv_id HAVING max(n) > 1")
def structural_instances(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Instances that no model made: turns, files, and the facts that need memory if each turn sees itself only."""
    rows = I.structural(conversation_instances(spark, sf_dir))
    return rows.select("conv_id", F.size("turns").alias("n_turns"), F.concat_ws(",", "required").alias("required"), F.md5(F.concat_ws("|", "files")).alias("files"), "tokens")


@query(INSTANCE + "SELECT conv_id, string_agg(title || ': ' || answer, '|' ORDER BY i) AS retained, string_agg(i + 1 || '=' || answer, '|' ORDER BY i) FILTER (i < n - 1) AS answers, string_agg('F' || i + 1 || ':' || i || '-' || i + 1, '|' ORDER BY i) FILTER (i < n - 1) AS bridges, 'x' AS noise FROM h GROUP BY conv_id HAVING max(n) > 1")
def instance_rubrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the structural instances' answers are judged by."""
    rows = I.structural(conversation_instances(spark, sf_dir))
    claims = F.expr("array(named_struct('contradicted_claim', '', 'wrong_claim', 'x'), named_struct('contradicted_claim', null, 'wrong_claim', null))")
    r = rows.select("conv_id", I.rubric(F.col("answer"), F.col("facts"), claims).alias("r"))
    joined = lambda c, f: F.concat_ws("|", F.transform(c, f))
    return r.select(
        "conv_id", F.concat_ws("|", "r.retention_facts").alias("retained"), joined("r.per_hop_answers", lambda x: F.concat_ws("=", x["hop"].cast("string"), x["answer"])).alias("answers"),
        joined("r.bridge_dependencies", lambda x: F.concat(x["fact_id"], F.lit(":"), x["from_hop"].cast("string"), F.lit("-"), x["to_hop"].cast("string"))).alias("bridges"), F.concat_ws("|", "r.noise_contradictions").alias("noise"),
    )
