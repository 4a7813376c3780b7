"""Source and sink queries: JSON lines made of table rows and read again."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.cluster import shared_folder
from palimpsest.plans.registry import query, table
from palimpsest.sources import readers, sinks


@query("WITH s AS (SELECT CASE WHEN role = 'system' THEN 'bad_json' WHEN turn = 0 THEN 'bad_schema' WHEN turn = 2 THEN 'empty_action' ELSE 'ok' END AS status FROM conversations) SELECT status, count(*) AS n FROM s GROUP BY 1")
def jsonl_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines by status; system messages are cut off, first turns lack the action, third ones have a blank one."""
    action = F.when(F.col("turn") == 0, None).when(F.col("turn") == 2, " ").otherwise(F.col("role"))
    line = F.to_json(F.struct("conv_id", "turn", action.alias("action")))
    lines = table(spark, sf_dir, "conversations").select(F.when(F.col("role") == "system", F.lit('{"conv_id": 1, ')).otherwise(line).alias("value"))
    return readers.parsed(lines, "conv_id long, turn long, action string", ["conv_id", "action"], "action").groupBy("status").agg(F.count("*").alias("n"))


@query("SELECT coalesce(a.o_orderkey, b.l_orderkey) AS id, coalesce(a.o_orderpriority, b.mode) AS mode, a.o_totalprice AS price, b.n FROM (SELECT * FROM orders WHERE o_orderstatus <> 'P') a FULL JOIN (SELECT l_orderkey, max(l_returnflag) AS mode, count(*) AS n FROM lineitem GROUP BY 1) b ON a.o_orderkey = b.l_orderkey")
def merged_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Full outer merge by key; the first part's fields win."""
    a = table(spark, sf_dir, "orders").where("o_orderstatus <> 'P'").select(F.col("o_orderkey").alias("id"), F.col("o_orderpriority").alias("mode"), F.col("o_totalprice").alias("price"))
    b = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("id")).agg(F.max("l_returnflag").alias("mode"), F.count("*").alias("n"))
    return readers.merged([a, b], "id")


@query("SELECT * FROM (VALUES ('a', true), ('b', false), ('c', false), ('d', true)) t(id, resolved)")
def resolved_reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = [(["a", "d"], ["b"], ["c", "a"]), (None, ["d"], [])]
    return readers.resolved(spark.createDataFrame(rows, "resolved_ids array<string>, unresolved_ids array<string>, error_ids array<string>"))


@query("WITH u AS (SELECT doc_id, quality AS v, 0 AS r FROM labels UNION ALL SELECT doc_id, (n_chars % 2)::INT, 1 FROM documents) SELECT doc_id, min_by(v, r) AS quality, min(r) AS authority FROM u GROUP BY 1")
def resolved_by_authority(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A document's quality by label, else by rule."""
    rule = table(spark, sf_dir, "documents").select("doc_id", (F.col("n_chars") % 2).cast("int").alias("quality"))
    return readers.by_authority([table(spark, sf_dir, "labels"), rule], "doc_id", "quality")


@query("SELECT item_id, text FROM benchmark")
def inverted_abstracts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts taken apart into words and places, and put together again."""
    words = table(spark, sf_dir, "benchmark").select("item_id", F.posexplode(F.split("text", " ")).alias("p", "w"))
    index = words.groupBy("item_id", "w").agg(F.collect_list("p").alias("ps")).groupBy("item_id").agg(F.map_from_entries(F.collect_list(F.struct("w", "ps"))).alias("m"))
    return index.select("item_id", readers.from_inverted(F.col("m")).alias("text"))


@query("SELECT item_id::VARCHAR AS ident, text AS title, 'PART & <b>: ' || text || ' end' AS abstract, CASE WHEN item_id % 3 > 0 THEN (2000 + item_id % 20)::INT END AS year FROM benchmark")
def xml_articles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items written as XML with entities, labels and nested tags, and read again."""
    escaped = F.replace(F.replace(F.col("text"), F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;"))
    year = F.when(F.col("item_id") % 3 > 0, F.concat(F.lit("<PubDate><Year>"), 2000 + F.col("item_id") % 20, F.lit("</Year></PubDate>"))).otherwise(F.lit("<Year>1</Year>"))
    xml = F.concat(F.lit("<Set><PubmedArticle><PMID>"), "item_id", F.lit("</PMID><ArticleTitle>"), escaped, F.lit("<i>left out</i> too</ArticleTitle>"), F.lit("<A><AbstractText Label='PART &amp; &lt;b&gt;'>"), escaped, F.lit("</AbstractText><AbstractText>end</AbstractText></A>"), year, F.lit("</PubmedArticle></Set>"))
    return readers.articles(table(spark, sf_dir, "benchmark").select(xml.alias("xml")), "xml")


@query("SELECT doc_id // 60 AS report, doc_id::VARCHAR AS id, quality = 1 AS resolved FROM labels")
def report_shapes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reports of sixty labels, in three shapes in turn."""
    rows = table(spark, sf_dir, "labels").select(F.floor(F.col("doc_id") / 60).alias("report"), F.col("doc_id").cast("string").alias("id"), F.col("quality").alias("q"))
    shape = F.col("report") % 3
    of = lambda k, c: F.when(shape == k, c)
    reports = rows.groupBy("report").agg(F.collect_list(F.when(F.col("q") == 1, F.col("id"))).alias("a"), F.collect_list("id").alias("b"), F.collect_list(F.struct(F.col("id").alias("instance_id"), (F.col("q") * 1.0).cast("double").alias("reward"))).alias("c"), F.collect_list(F.struct(F.col("id").alias("instance_id"), (F.col("q") == 1).alias("resolved"))).alias("d"))
    reports = reports.select("report", of(0, F.col("a")).alias("resolved_ids"), of(0, F.col("b")).alias("completed_ids"), F.lit(None).cast("array<string>").alias("unresolved_ids"), of(1, F.col("c")).alias("instance_results"), of(2, F.col("d")).alias("results"))
    return readers.resolved_set(reports)


@query("""WITH e AS (SELECT (doc_id % 500)::VARCHAR AS id, doc_id // 500 AS place, (CASE WHEN doc_id % 7 = 0 THEN 0 WHEN quality = 1 THEN 1 ELSE 2 END) AS step FROM labels)
SELECT id, coalesce(arg_max(step = 1, place * 3 + step) FILTER (step > 0), false) AS resolved FROM e GROUP BY id""")
def latest_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reports one after the other over the same ids: a later one holds, unresolved after resolved, and errors only where nothing else is said."""
    rows = table(spark, sf_dir, "labels").select((F.col("doc_id") % 500).cast("string").alias("id"), F.floor(F.col("doc_id") / 500).alias("place"), F.col("quality").alias("q"), (F.col("doc_id") % 7 == 0).alias("error"))
    each = lambda c: F.collect_list(F.when(c, F.col("id")))
    reports = rows.groupBy("place").agg(each(~F.col("error") & (F.col("q") == 1)).alias("a"), each(~F.col("error") & (F.col("q") != 1)).alias("unresolved_ids"), each(F.col("error")).alias("error_ids"), F.collect_list(F.when(~F.col("error"), F.struct(F.col("id").alias("instance_id"), F.col("q").cast("double").alias("reward")))).alias("r"))
    # each fourth report without errors is in the old shape
    old = (F.col("place") % 4 == 3) & (F.size("error_ids") == 0)
    return readers.latest_resolved(reports.select("place", F.when(~old, F.col("a")).alias("resolved_ids"), "unresolved_ids", "error_ids", F.when(old, F.col("r")).alias("results")))


@query("SELECT doc_id AS id, quality = 1 AS resolved, 1 AS authority FROM labels WHERE doc_id % 3 = 1")
def resolved_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    """No report is given, so the newest of the found ones holds; a run's own rewards come last."""
    rows = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("id"), (F.col("quality") == 1).alias("resolved"), F.col("quality").cast("double").alias("reward"), (F.col("doc_id") % 3).alias("k"))
    files = rows.select(F.when(F.col("k") == 0, "a_reeval.json").when(F.col("k") == 1, "b_reeval.json").otherwise("summary_reeval.json").alias("name"), F.col("k").alias("changed"), "id", "resolved")
    return readers.first_source([rows.where("false").select("id", "resolved"), readers.newest_report(files), readers.graded(rows)])


@query("SELECT doc_id, lang, source, 1 AS label, 1.0::DOUBLE AS weight FROM documents")
def json_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows written as JSON lines, with a field of another table by key, and read again with defaults."""
    docs = table(spark, sf_dir, "documents")
    folder = shared_folder(spark, "json")
    sinks.write_jsonl(docs.select("doc_id", "lang"), folder, docs.select("doc_id", "source"), "doc_id")
    return sinks.read_examples(spark, folder, "doc_id long, lang string, source string, label int, weight double")


@query("SELECT conv_id, count(*) AS n, md5(string_agg(role || chr(9) || text, chr(10) ORDER BY turn)) AS digest FROM conversations GROUP BY 1")
def concise_episodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines "role: content" as messages."""
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.concat_ws(": ", "role", "text").alias("line"))
    out = sinks.concise(rows, "conv_id", "turn", "line")
    joined = F.concat_ws("\n", F.transform("messages", lambda m: F.concat_ws("\t", m["role"], m["content"])))
    return out.select("conv_id", F.size("messages").cast("long").alias("n"), F.md5(joined).alias("digest"))


@query("SELECT coalesce(CASE WHEN l.quality = 1 THEN 'train' WHEN l.quality = 0 THEN 'eval' END, 'unknown') AS split, count(*) AS n FROM documents d LEFT JOIN labels l USING (doc_id) GROUP BY 1")
def routed_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    manifest = table(spark, sf_dir, "labels").select("doc_id", F.when(F.col("quality") == 1, "train").when(F.col("quality") == 0, "eval").alias("split"))
    return sinks.route(table(spark, sf_dir, "documents"), manifest, "doc_id").groupBy("split").agg(F.count("*").alias("n"))
