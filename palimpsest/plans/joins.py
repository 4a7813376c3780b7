"""Join queries: orders of a customer stand for the steps of a run, events of a user for a trajectory."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.operators import pairs as P
from palimpsest.plans.context import messages, steps
from palimpsest.plans.registry import query, table

RUNS = """WITH b AS (SELECT o_orderkey AS id, o_orderstatus = 'F' AS resolved, (o_orderkey % 5) * 100 AS tokens, o_custkey AS est FROM orders),
m AS (SELECT l_orderkey AS id, CASE WHEN count(*) > 3 THEN true WHEN count(*) < 2 THEN NULL ELSE false END AS resolved, sum(l_linenumber)::BIGINT AS tokens, count(*) AS est FROM lineitem GROUP BY 1),
p AS (SELECT id, coalesce(b.resolved, false) AS base_resolved, coalesce(nullif(b.tokens, 0), b.est) AS base_tokens, coalesce(m.resolved, false) AS memory_resolved, coalesce(nullif(m.tokens, 0), m.est) AS memory_tokens FROM b JOIN m USING (id)),
o AS (SELECT *, CASE WHEN base_resolved AND memory_resolved THEN 'both_pass' WHEN base_resolved THEN 'memory_hurt' WHEN memory_resolved THEN 'memory_helped' ELSE 'both_fail' END AS outcome FROM p)
"""


def paired(spark: SparkSession, sf_dir: str) -> DataFrame:
    base = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), (F.col("o_orderstatus") == "F").alias("resolved"), (F.col("o_orderkey") % 5 * 100).alias("tokens"), F.col("o_custkey").alias("est_tokens"))
    n = F.count("*")
    other = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("id")).agg(F.when(n > 3, True).when(n < 2, None).otherwise(False).alias("resolved"), F.sum("l_linenumber").alias("tokens"), n.alias("est_tokens"))
    return P.paired_labels(base, other, "id")


@query(RUNS + "SELECT * FROM o")
def paired_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return paired(spark, sf_dir)


@query(RUNS + "SELECT outcome, count(*) AS n, count(*) / sum(count(*)) OVER () AS share, round(avg(memory_tokens / nullif(base_tokens, 0)), 6) AS token_ratio FROM o GROUP BY outcome")
def label_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = paired(spark, sf_dir)
    out = rows.groupBy("outcome").agg(F.count("*").alias("n"), F.round(F.avg(F.try_divide("memory_tokens", "base_tokens")), 6).alias("token_ratio"))
    total = rows.agg(F.count("*").alias("total"))
    return out.crossJoin(F.broadcast(total)).select("outcome", "n", (F.col("n") / F.col("total")).alias("share"), "token_ratio")


@query(RUNS + ", r AS (SELECT *, CASE WHEN memory_resolved THEN 1 + 0.5 * ((base_tokens - memory_tokens)::DOUBLE / nullif(base_tokens, 0)) ELSE 0 END AS x FROM o) SELECT id, x::DOUBLE AS reward FROM r")
def token_reward(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Resolution plus a share of the tokens saved."""
    saved = F.try_divide(F.col("base_tokens") - F.col("memory_tokens"), F.col("base_tokens"))
    return paired(spark, sf_dir).select("id", F.when(F.col("memory_resolved"), 1 + 0.5 * saved).otherwise(0.0).alias("reward"))


REWARD = """WITH s AS (SELECT user_id AS id, row_number() OVER (PARTITION BY user_id, event_id % 2 ORDER BY ts, event_id) AS step, event_type || ' ' || props AS action, value AS reward, event_id % 2 AS side FROM events),
j AS (SELECT b.id, b.step, substr(b.action, 1, 2000) AS action, m.reward - b.reward AS delta FROM s b JOIN s m ON b.id = m.id AND b.step = m.step AND b.side = 0 AND m.side = 1 WHERE m.reward IS NOT NULL AND b.reward IS NOT NULL AND trim(b.action) <> '')
"""


def sides(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    from pyspark.sql import Window

    e = table(spark, sf_dir, "events").withColumn("side", F.col("event_id") % 2)
    step = F.row_number().over(Window.partitionBy("user_id", "side").orderBy("ts", "event_id"))
    rows = e.select(F.col("user_id").alias("id"), step.alias("step"), F.concat_ws(" ", "event_type", "props").alias("action"), F.col("value").alias("reward"), "side")
    return rows.where("side = 0").drop("side"), rows.where("side = 1").drop("side")


@query(REWARD + "SELECT id, step, action, delta, delta >= 0 AS safe FROM j")
def memory_gain_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs by step where an equal reward is safe."""
    return P.reward_pairs(*sides(spark, sf_dir), "id")


@query(REWARD + "SELECT id, step, action, delta, delta >= 0 AS safe FROM j WHERE abs(delta) >= 1e-9")
def strategy_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs by step where an equal reward says nothing."""
    return P.reward_pairs(*sides(spark, sf_dir), "id", keep_zero=False)


@query("WITH s AS (SELECT user_id AS id, event_type, row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id) - 1 AS k, event_id FROM events WHERE event_type IN ('click', 'view')) SELECT a.id, a.k, a.event_id AS left_value, b.event_id AS right_value FROM s a JOIN s b ON a.id = b.id AND a.k = b.k AND a.event_type = 'click' AND b.event_type = 'view'")
def positional_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The k-th click of a user with the k-th view."""
    e = table(spark, sf_dir, "events").withColumnRenamed("user_id", "id")
    return P.positional(e.where("event_type = 'click'"), e.where("event_type = 'view'"), ["id"], "event_id", "event_id")


@query("WITH s AS (SELECT user_id, event_type, event_id, event_id % 2 AS side, row_number() OVER (PARTITION BY user_id, event_type, event_id % 2 ORDER BY event_id) AS nth FROM events) SELECT a.user_id, a.event_type, a.event_id AS old_id, b.event_id AS new_id FROM s a JOIN s b USING (user_id, event_type, nth) WHERE a.side = 0 AND b.side = 1")
def occurrence_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The n-th element of a kind in the old tree is the n-th in the new one."""
    e = table(spark, sf_dir, "events").select("user_id", "event_type", "event_id")
    return P.occurrences(e.where("event_id % 2 = 0"), e.where("event_id % 2 = 1"), ["event_type"], "event_id", "event_id", ["user_id"])


@query("WITH s AS (SELECT user_id, event_id, event_id % 2 AS side, row_number() OVER (PARTITION BY user_id, event_id % 2 ORDER BY event_id DESC) AS back FROM events) SELECT a.user_id, a.back::INT AS back, a.event_id AS left_value, b.event_id AS right_value FROM s a JOIN s b USING (user_id, back) WHERE a.side = 0 AND b.side = 1 AND back <= 5")
def tail_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select("user_id", "event_id")
    return P.tail_aligned(e.where("event_id % 2 = 0"), e.where("event_id % 2 = 1"), "user_id", "event_id", "event_id", 5)


@query("WITH q AS (SELECT event_id, user_id, ts FROM events WHERE event_type = 'purchase'), f AS (SELECT user_id, ts, value, event_id AS fid FROM events WHERE event_type = 'error'), j AS (SELECT q.event_id, q.user_id, q.ts, f.value, f.fid, f.ts AS fts FROM q LEFT JOIN f ON q.user_id = f.user_id AND f.ts <= q.ts) SELECT event_id, user_id, ts, max_by(value, (fts, fid)) AS latest, count(fid) AS n_before FROM j GROUP BY ALL")
def latest_summary_as_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The value of the last error at or before each purchase, and how many there were."""
    e = table(spark, sf_dir, "events")
    return P.as_of(e.where("event_type = 'purchase'").select("event_id", "user_id", "ts"), e.where("event_type = 'error'"), "user_id", "ts", "value", "event_id")


@query("""WITH t AS (SELECT DISTINCT conv_id, turn FROM conversations), f AS (SELECT conv_id, turn, count(*) AS facts FROM conversations WHERE role = 'user' GROUP BY 1, 2)
SELECT t.conv_id, t.turn, coalesce(any_value(g.facts), 0)::BIGINT AS facts, coalesce(sum(f.facts) FILTER (f.turn > t.turn - 3), 0)::BIGINT AS visible, coalesce(sum(f.facts) FILTER (f.turn <= t.turn - 3), 0)::BIGINT AS evicted
FROM t LEFT JOIN f ON f.conv_id = t.conv_id AND f.turn <= t.turn LEFT JOIN f g ON g.conv_id = t.conv_id AND g.turn = t.turn GROUP BY 1, 2""")
def visible_and_evicted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Facts (here: user messages) inside the last three turns, and those gone before."""
    rows = table(spark, sf_dir, "conversations")
    return P.windows_of_facts(rows.where("role = 'user'"), rows, "conv_id", 3)


@query("""WITH i AS (SELECT user_id, epoch_us(ts) // 1000000 AS start, epoch_us(ts) // 1000000 + 600 AS end_ FROM events), r AS (SELECT *, max(end_) OVER (PARTITION BY user_id ORDER BY start, end_ ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM i),
g AS (SELECT *, sum(CASE WHEN reach IS NULL OR start > reach + 300 THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY start, end_) AS island FROM r) SELECT user_id, min(start) AS start, max(end_) AS "end", count(*) AS n FROM g GROUP BY user_id, island""")
def merged_intervals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Intervals of ten minutes from each event, merged where five minutes or less lie between."""
    at = F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / 1000000)
    e = table(spark, sf_dir, "events").select("user_id", at.alias("start"), (at + 600).alias("end"))
    return P.merged_intervals(e, "user_id", 300)


@query("""WITH c AS (SELECT c_nationkey, c_mktsegment, CASE WHEN c_acctbal > 5000 THEN 'PASS' ELSE 'FAIL' END AS cell FROM customer), d AS (SELECT c_nationkey, c_mktsegment, max(cell) AS cell FROM c GROUP BY 1, 2)
SELECT c_nationkey, coalesce(max(cell) FILTER (c_mktsegment = 'BUILDING'), 'FAIL') AS building, coalesce(max(cell) FILTER (c_mktsegment = 'MACHINERY'), 'FAIL') AS machinery FROM d GROUP BY 1""")
def strategy_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Instance by strategy, FAIL also where nothing is."""
    c = table(spark, sf_dir, "customer").withColumn("cell", F.when(F.col("c_acctbal") > 5000, "PASS").otherwise("FAIL"))
    out = c.groupBy("c_nationkey").pivot("c_mktsegment", ["BUILDING", "MACHINERY"]).agg(F.max("cell"))
    return out.na.fill("FAIL").withColumnsRenamed({"BUILDING": "building", "MACHINERY": "machinery"})


@query("SELECT n_name AS strategy, round(avg(c_acctbal) FILTER (c_mktsegment = 'BUILDING'), 6) AS building, round(avg(c_acctbal) FILTER (c_mktsegment = 'FURNITURE'), 6) AS furniture, round(sum(coalesce(CASE WHEN c_acctbal > 0 THEN c_acctbal END, 0)) / count(*), 6) AS mean_missing_zero FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY 1")
def score_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean scores by strategy and stratum, and a mean where what is missing counts as 0."""
    c = table(spark, sf_dir, "customer").join(table(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    mean = lambda s: F.round(F.avg(F.when(F.col("c_mktsegment") == s, F.col("c_acctbal"))), 6)
    return c.groupBy(F.col("n_name").alias("strategy")).agg(mean("BUILDING").alias("building"), mean("FURNITURE").alias("furniture"), F.round(F.sum(F.when(F.col("c_acctbal") > 0, F.col("c_acctbal")).otherwise(0.0)) / F.count("*"), 6).alias("mean_missing_zero"))


@query("WITH e AS (SELECT user_id AS conv, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS pos, value, event_type FROM events), g AS (SELECT *, last_value(CASE WHEN event_type = 'view' THEN value END IGNORE NULLS) OVER w AS seen, last_value(CASE WHEN event_type = 'view' THEN pos END IGNORE NULLS) OVER w AS at_pos FROM e WINDOW w AS (PARTITION BY conv ORDER BY pos)) SELECT conv, pos, seen + 2 * (pos - at_pos) AS resolved FROM g")
def nearest_earlier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The nearest earlier positive count plus twice the gap."""
    from pyspark.sql import Window

    w = Window.partitionBy("conv").orderBy("pos")
    last = F.last(F.when(F.col("event_type") == "view", F.struct("value", "pos")), True).over(w)
    return steps(spark, sf_dir).withColumn("l", last).select("conv", "pos", (F.col("l.value") + 2 * (F.col("pos") - F.col("l.pos"))).alias("resolved"))


@query("WITH m AS (SELECT conv_id AS conv, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS pos, role FROM conversations), s AS (SELECT conv, min(pos) AS cut FROM m WHERE role = 'assistant' AND pos > 2 GROUP BY 1) SELECT m.conv, count(*) AS n, min(cut) AS step FROM m JOIN s USING (conv) WHERE pos < cut GROUP BY 1")
def messages_before_step(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The prefix of each conversation before an assistant's step."""
    m = messages(spark, sf_dir)
    cut = m.where("role = 'assistant' AND pos > 2").groupBy("conv").agg(F.min("pos").alias("cut"))
    return m.join(cut, "conv").where("pos < cut").groupBy("conv").agg(F.count("*").alias("n"), F.min("cut").alias("step"))


@query("""WITH c AS (SELECT conv_id, turn, role, coalesce(text, '') AS text FROM conversations),
f AS (SELECT conv_id, turn AS fact, list_filter(list_distinct(regexp_extract_all(regexp_replace(text, '[^\\x00-\\x7F]', ' ', 'g'), '\\b[A-Za-z_][A-Za-z0-9_.]{4,}\\b')), lambda w: contains(w, '_') OR contains(w, '.') OR (regexp_matches(w, '^[A-Z]') AND regexp_matches(w, '[a-z]'))) AS names FROM c WHERE role = 'user'),
d AS (SELECT conv_id, 't' || turn AS path, string_split(replace(text, ' ', chr(10)), chr(10)) AS lines FROM c WHERE role = 'assistant'),
m AS (SELECT conv_id, fact, path, len(lines) AS n, unnest(list_filter(range(0, len(lines)), lambda i: len(list_filter(names, lambda w: contains(lines[i + 1], w))) > 0)) AS i FROM f JOIN d USING (conv_id)),
r AS (SELECT conv_id, fact, path, greatest(0, i - 5) AS s, least(n, i + 35) AS e FROM m),
g AS (SELECT *, CASE WHEN s <= max(e) OVER (PARTITION BY conv_id, fact, path ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) + 3 THEN 0 ELSE 1 END AS fresh FROM r),
k AS (SELECT *, sum(fresh) OVER (PARTITION BY conv_id, fact, path ORDER BY s, e) AS island FROM g), u AS (SELECT conv_id, fact, path, min(s) AS s, max(e) AS e FROM k GROUP BY conv_id, fact, path, island),
v AS (SELECT *, row_number() OVER (PARTITION BY conv_id, fact, path ORDER BY s) AS a FROM u), w AS (SELECT *, row_number() OVER (PARTITION BY conv_id, fact ORDER BY path, s) AS b FROM v WHERE a <= 2)
SELECT conv_id, fact, path, s::INT AS "start", e::INT AS "end", md5(array_to_string(list_transform(range(s, e), lambda i: lpad((i + 1)::VARCHAR, 4, ' ') || ' | ' || lines[i + 1]), chr(10))) AS digest FROM w JOIN d USING (conv_id, path) WHERE b <= 3""")
def fact_snippets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """User rows (without letters beyond ASCII, at whose borders the engines differ) as facts, assistant rows as files of one word a line: the
    parts around words that look like code names."""
    c = table(spark, sf_dir, "conversations").withColumn("text", F.coalesce("text", F.lit("")))
    facts = c.where("role = 'user'").select("conv_id", F.col("turn").alias("fact"), F.regexp_replace("text", r"[^\x00-\x7F]", " ").alias("content"))
    files = c.where("role = 'assistant'").select("conv_id", F.concat(F.lit("t"), F.col("turn").cast("string")).alias("path"), F.replace("text", F.lit(" "), F.lit("\n")).alias("content"))
    return P.snippets(facts, files, "conv_id", "fact").select("conv_id", "fact", "path", "start", "end", F.md5("snippet").alias("digest"))
