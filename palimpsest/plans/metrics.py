"""Metric queries: labels joined with documents, with a deterministic score."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.operators import metrics as M
from palimpsest.plans.registry import query, table

BASE = """WITH scored AS (
  SELECT d.doc_id AS id, d.lang, d.source, l.quality = 1 AS label, l.toxic, (d.n_chars % 97) / 96.0::DOUBLE AS p, d.n_chars
  FROM labels l JOIN documents d USING (doc_id))
"""
COUNTS = """count(*) AS n, count(*) FILTER (NOT label AND p < {t}) AS tp, count(*) FILTER (label AND p < {t}) AS fp,
  count(*) FILTER (label AND p >= {t}) AS tn, count(*) FILTER (NOT label AND p >= {t}) AS fn"""
RATIOS = """coalesce(tp / nullif(tp + fp, 0), 0)::DOUBLE AS harmful_precision, coalesce(tp / nullif(tp + fn, 0), 0)::DOUBLE AS harmful_recall,
  coalesce(tn / nullif(tn + fn, 0), 0)::DOUBLE AS safe_precision, coalesce(tn / nullif(tn + fp, 0), 0)::DOUBLE AS safe_recall"""
F1S = """round(coalesce(2 * harmful_precision * harmful_recall / nullif(harmful_precision + harmful_recall, 0), 0), 9) AS harmful_f1,
  round(coalesce(2 * safe_precision * safe_recall / nullif(safe_precision + safe_recall, 0), 0), 9) AS safe_f1"""
AUC = """steps AS (SELECT {by} p, count(*) FILTER (label) AS pos, count(*) FILTER (NOT label) AS neg FROM scored GROUP BY ALL),
 curve AS (SELECT *, sum(pos) OVER ({part} ORDER BY p DESC) AS ctp FROM steps),
 auc AS (SELECT {by} CASE WHEN min(greatest(p, 1 - p)) < max(greatest(p, 1 - p)) THEN CASE WHEN sum(pos) * sum(neg) > 0 THEN round(sum(neg * (2 * ctp - pos) / 2) / (sum(pos) * sum(neg)), 9) ELSE 0.5 END END AS auroc FROM curve GROUP BY ALL)"""
ECE = """ranked AS (SELECT {by} greatest(p, 1 - p) AS conf, ((p >= 0.5) = label)::INT AS ok, count(*) OVER ({part}) AS cnt,
   row_number() OVER ({part} ORDER BY greatest(p, 1 - p), id) AS rn FROM scored),
 bins AS (SELECT {by} cnt, (rn - 1) // greatest(1, cnt // 15) AS bin, abs(sum(conf) - sum(ok)) AS gap FROM ranked GROUP BY ALL),
 ece AS (SELECT {by} round(sum(gap) / any_value(cnt), 9) AS ece FROM bins GROUP BY ALL)"""


def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", "source", "n_chars")
    rows = table(spark, sf_dir, "labels").join(docs, "doc_id")
    return rows.select(F.col("doc_id").alias("id"), "lang", "source", (F.col("quality") == 1).alias("label"), "toxic", (F.col("n_chars") % 97 / 96.0).alias("p"), "n_chars")


def rounded(df: DataFrame, *names: str) -> DataFrame:
    return df.withColumns({n: F.round(n, 9) for n in names})


@query(BASE + f", c AS (SELECT {COUNTS.format(t=0.5)} FROM scored), r AS (SELECT *, ((tp + tn) / n)::DOUBLE AS accuracy, {RATIOS} FROM c), " + AUC.format(by="", part="") + ", " + ECE.format(by="", part="") + f" SELECT r.*, {F1S}, auroc, ece FROM r, auc, ece")
def report_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Confusion, F1, area and calibration error over all rows."""
    df = scored(spark, sf_dir)
    out = M.confusion(df).crossJoin(F.broadcast(M.auroc(df))).crossJoin(F.broadcast(M.calibration_error(df)))
    return rounded(out, "harmful_f1", "safe_f1", "auroc", "ece")


@query(BASE + f", c AS (SELECT lang, {COUNTS.format(t=0.5)} FROM scored GROUP BY lang), r AS (SELECT *, ((tp + tn) / n)::DOUBLE AS accuracy, {RATIOS} FROM c), " + AUC.format(by="lang,", part="PARTITION BY lang") + ", " + ECE.format(by="lang,", part="PARTITION BY lang") + f" SELECT r.*, {F1S}, auroc, ece FROM r LEFT JOIN auc USING (lang) LEFT JOIN ece USING (lang)")
def report_metrics_by_lang(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = scored(spark, sf_dir)
    out = M.confusion(df, ["lang"]).join(M.auroc(df, ["lang"]), "lang", "left").join(M.calibration_error(df, ["lang"]), "lang", "left")
    return rounded(out, "harmful_f1", "safe_f1", "auroc", "ece")


@query(BASE + f", c AS (SELECT coalesce(lang, '') AS lang, coalesce(source, '') AS source, toxic, grouping(lang) AS g1, grouping(source) AS g2, {COUNTS.format(t=0.5)} FROM scored GROUP BY GROUPING SETS ((lang), (source), (toxic))) SELECT CASE WHEN g1 = 0 THEN 'lang' WHEN g2 = 0 THEN 'source' ELSE 'toxic' END AS kind, CASE WHEN g1 = 0 THEN lang WHEN g2 = 0 THEN source ELSE toxic::VARCHAR END AS slice, n, tp, fp, tn, fn FROM c")
def breakdown_grouping_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three breakdowns in one pass."""
    low = F.col("p") < 0.5
    label = F.col("label")
    sets = scored(spark, sf_dir).groupingSets([["lang"], ["source"], ["toxic"]], "lang", "source", "toxic").agg(
        F.grouping("lang").alias("g1"), F.grouping("source").alias("g2"), F.count("*").alias("n"), F.count_if(~label & low).alias("tp"), F.count_if(label & low).alias("fp"), F.count_if(label & ~low).alias("tn"), F.count_if(~label & ~low).alias("fn")
    )
    kind = F.when(F.col("g1") == 0, "lang").when(F.col("g2") == 0, "source").otherwise("toxic")
    name = F.when(F.col("g1") == 0, F.coalesce("lang", F.lit(""))).when(F.col("g2") == 0, F.coalesce("source", F.lit(""))).otherwise(F.col("toxic").cast("string"))
    return sets.select(kind.alias("kind"), name.alias("slice"), "n", "tp", "fp", "tn", "fn")


@query(BASE + ", c AS (SELECT lang, count(*) AS n, count(*) FILTER (p >= 0.88 OR p <= 1.0 - 0.88::DOUBLE) AS n_covered, count(*) FILTER ((p >= 0.88 OR p <= 1.0 - 0.88::DOUBLE) AND (p >= 0.5) = label) AS k FROM scored GROUP BY lang) SELECT lang, n, n_covered, n_covered / n AS coverage, k / nullif(n_covered, 0) AS accuracy_at FROM c")
def coverage_at_threshold(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.coverage(scored(spark, sf_dir), 0.88, ["lang"])


SWEEP = BASE + f""", grid AS (SELECT k / 20.0::DOUBLE AS threshold FROM range(21) t(k)),
 c AS (SELECT {{by}} threshold, count(*) FILTER (NOT label AND p < threshold) AS tp, count(*) FILTER (label AND p < threshold) AS fp,
   count(*) FILTER (label AND p >= threshold) AS tn, count(*) FILTER (NOT label AND p >= threshold) AS fn FROM scored, grid GROUP BY ALL),
 s AS (SELECT *, {F1S} FROM (SELECT *, {RATIOS} FROM c))"""


@query(SWEEP.format(by="") + " SELECT * FROM s")
def threshold_sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(M.sweep(scored(spark, sf_dir)), "harmful_f1", "safe_f1")


@query(SWEEP.format(by="") + " SELECT threshold, safe_f1, harmful_f1 FROM s WHERE harmful_f1 >= 0.1 AND safe_precision >= 0.2 ORDER BY safe_f1 DESC, threshold LIMIT 1")
def best_shared_threshold(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The constrained arg-max over the sweep."""
    return M.best_threshold(rounded(M.sweep(scored(spark, sf_dir)), "harmful_f1", "safe_f1"), least_harmful_f1=0.1, least_precision=0.2)


@query(SWEEP.format(by="lang,") + ", b AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY safe_f1 DESC, threshold) AS rn FROM s) SELECT lang, threshold, safe_f1, harmful_f1, threshold - 0.5 AS delta, max(threshold) OVER () - min(threshold) OVER () AS spread FROM b WHERE rn = 1")
def best_threshold_by_lang(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Thresholds of each language, their distance to the shared one and their spread."""
    best = M.best_threshold(rounded(M.sweep(scored(spark, sf_dir), by=["lang"]), "harmful_f1", "safe_f1"), ["lang"])
    spread = best.agg((F.max("threshold") - F.min("threshold")).alias("spread"))
    return best.withColumn("delta", F.col("threshold") - 0.5).crossJoin(F.broadcast(spread))


@query(BASE + ", e AS (SELECT source, avg(p) AS p, min_by(label, id) AS label FROM scored GROUP BY source), r AS (SELECT *, rank() OVER (ORDER BY p) + (count(*) OVER (PARTITION BY p) - 1) / 2 AS rk FROM e) SELECT count(*) AS n, count(*) FILTER ((p >= 0.5) = label) AS n_right, CASE WHEN min(greatest(p, 1 - p)) < max(greatest(p, 1 - p)) THEN CASE WHEN count(*) FILTER (label) * count(*) FILTER (NOT label) = 0 THEN 0.5 ELSE round((sum(rk) FILTER (label) - count(*) FILTER (label) * (count(*) FILTER (label) + 1) / 2) / (count(*) FILTER (label) * count(*) FILTER (NOT label)), 9) END END AS auroc FROM r")
def episode_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean score by episode (here: source), first label, and the rank-sum area with tied ranks averaged."""
    e = scored(spark, sf_dir).groupBy("source").agg(F.avg("p").alias("p"), F.min_by("label", "id").alias("label"))
    out = e.agg(F.count("*").alias("n"), F.count_if((F.col("p") >= 0.5) == F.col("label")).alias("n_right"))
    return rounded(out.crossJoin(F.broadcast(M.auroc(e))), "auroc")


@query(BASE + ", r AS (SELECT n_chars, row_number() OVER (ORDER BY n_chars, id) AS rn, count(*) OVER () AS n FROM scored) SELECT max(n) AS n, max(n_chars) FILTER (rn = round_even(0.5 * (n - 1), 0) + 1) AS p50, max(n_chars) FILTER (rn = round_even(0.95 * (n - 1), 0) + 1) AS p95, max(n_chars) AS max FROM r")
def truncation_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nearest-rank percentiles of lengths."""
    return M.nearest_rank(scored(spark, sf_dir), "n_chars", {"p50": 0.5, "p95": 0.95}, "id")


@query("WITH c AS (SELECT quality AS label, count(*) AS n FROM labels WHERE quality IS NOT NULL GROUP BY 1) SELECT label, n, CASE WHEN count(*) OVER () < 2 THEN 1.0 ELSE greatest(0.1, least(10.0, sum(n) OVER () / (2 * n))) END::DOUBLE AS weight FROM c")
def class_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.class_weights(table(spark, sf_dir, "labels").withColumnRenamed("quality", "label"))


@query(BASE + ", d AS (SELECT ((p >= 0.5) = label)::INT AS ok, rep, ('0x' || substr(md5(id::VARCHAR || ':' || rep::VARCHAR || ':42'), 1, 8))::BIGINT / 4294967296.0::DOUBLE AS u FROM scored, range(50) r(rep)), t AS (SELECT rep, ok, (u >= 0.36787944117144233::DOUBLE)::INT + (u >= 0.7357588823428847::DOUBLE)::INT + (u >= 0.9196986029286058::DOUBLE)::INT + (u >= 0.9810118431238462::DOUBLE)::INT + (u >= 0.9963401531726563::DOUBLE)::INT + (u >= 0.9994058151824183::DOUBLE)::INT AS times FROM d) SELECT rep::INT AS rep, sum(times)::BIGINT AS n, (sum(times * ok) / nullif(sum(times), 0))::DOUBLE AS accuracy FROM t GROUP BY rep")
def bootstrap_replicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Accuracy in 50 seeded replicates."""
    return M.bootstrap_accuracy(scored(spark, sf_dir), 50)


LOW = (1.0 - 0.95) / 2.0
DRAWN = BASE + """, u AS (SELECT id, label, p, rep, ('0x' || substr(md5(id::VARCHAR || ':' || rep::VARCHAR || ':42'), 1, 8))::BIGINT / 4294967296.0::DOUBLE AS u FROM scored, range(1000) r(rep)),
 d AS (SELECT rep, label, p, (u >= 0.36787944117144233::DOUBLE)::INT + (u >= 0.7357588823428847::DOUBLE)::INT + (u >= 0.9196986029286058::DOUBLE)::INT + (u >= 0.9810118431238462::DOUBLE)::INT
   + (u >= 0.9963401531726563::DOUBLE)::INT + (u >= 0.9994058151824183::DOUBLE)::INT AS w FROM u)"""
BOUNDS = f"""s AS (SELECT metric, count(v) AS n, list_sort(list(v) FILTER (v IS NOT NULL)) AS s FROM v GROUP BY metric)
 SELECT metric, n::INT AS defined, CASE WHEN n >= 100 THEN round(s[greatest(0, trunc('{LOW!r}'::DOUBLE * n)::INT) + 1], 9) END AS lower,
   CASE WHEN n >= 100 THEN round(s[greatest(0, least(n - 1, trunc('{1.0 - LOW!r}'::DOUBLE * n)::INT - 1))::INT + 1], 9) END AS upper FROM s"""


@query(DRAWN + """, c AS (SELECT rep, sum(w) AS n, coalesce(sum(w) FILTER (NOT label AND p < 0.5), 0) AS tp, coalesce(sum(w) FILTER (label AND p < 0.5), 0) AS fp,
   coalesce(sum(w) FILTER (label AND p >= 0.5), 0) AS tn, coalesce(sum(w) FILTER (NOT label AND p >= 0.5), 0) AS fn FROM d GROUP BY rep HAVING sum(w) > 0),
 q AS (SELECT *, coalesce(tp / nullif(tp + fp, 0), 0)::DOUBLE AS a, coalesce(tp / nullif(tp + fn, 0), 0)::DOUBLE AS b FROM c),
 v AS (SELECT 'accuracy' AS metric, ((tp + tn) / n)::DOUBLE AS v FROM q UNION ALL SELECT 'harmful_f1', coalesce(2 * a * b / nullif(a + b, 0), 0) FROM q), """ + BOUNDS)
def bootstrap_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """95 percent intervals of accuracy and F1 over 1000 replicates."""
    return rounded(M.bootstrap_interval(scored(spark, sf_dir), M.confusion, ["accuracy", "harmful_f1"]), "lower", "upper")


@query(DRAWN + """, g AS (SELECT rep, p, coalesce(sum(w) FILTER (label), 0) AS pos, coalesce(sum(w) FILTER (NOT label), 0) AS neg FROM d WHERE w > 0 GROUP BY ALL),
 h AS (SELECT *, sum(pos) OVER (PARTITION BY rep ORDER BY p DESC) AS ctp FROM g),
 v AS (SELECT 'auroc' AS metric, CASE WHEN sum(pos) * sum(neg) > 0 AND count(*) > 1 THEN (sum(neg * (2 * ctp - pos) / 2) / (sum(pos) * sum(neg)))::DOUBLE END AS v FROM h GROUP BY rep), """ + BOUNDS)
def bootstrap_bounds_auroc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same for the area under the curve."""
    return rounded(M.bootstrap_interval(scored(spark, sf_dir), lambda df, by: M.auroc(df, by, None), ["auroc"]), "lower", "upper")


@query("SELECT o_orderpriority AS arm, count(*) AS n, sum(CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END)::BIGINT AS resolved, (count(*) FILTER (o_orderstatus = 'F') / count(*))::DOUBLE AS resolve_rate, min(o_totalprice) AS lo, max(o_totalprice) AS hi, round(avg(o_totalprice) FILTER (o_totalprice > 0), 4) AS mean_over, count(DISTINCT o_custkey) AS instances FROM orders GROUP BY 1")
def arm_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts, rates and conditional means by arm."""
    return table(spark, sf_dir, "orders").groupBy(F.col("o_orderpriority").alias("arm")).agg(
        F.count("*").alias("n"), F.count_if(F.col("o_orderstatus") == "F").alias("resolved"), (F.count_if(F.col("o_orderstatus") == "F") / F.count("*")).alias("resolve_rate"),
        F.min("o_totalprice").alias("lo"), F.max("o_totalprice").alias("hi"), F.round(F.avg(F.when(F.col("o_totalprice") > 0, F.col("o_totalprice"))), 4).alias("mean_over"), F.countDistinct("o_custkey").alias("instances"),
    )
