"""Metrics of scored rows: a boolean ``label`` (true: safe) and a score ``p`` that the row is safe.

Harmful is the positive class of ``harmful_*``; empty denominators give 0, and areas and errors are null where
they are undefined."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palimpsest.operators.ranking import row_numbers, running


def ratio(a: Column, b: Column) -> Column:
    """a / b, 0 where b is 0."""
    return F.when(b == 0, F.lit(0.0)).otherwise(a / b)


def f1(p: Column, r: Column) -> Column:
    return F.when(p + r == 0, F.lit(0.0)).otherwise(2 * p * r / (p + r))


def confusion(df: DataFrame, by: list[str] | None = None, cut: float | Column = 0.5) -> DataFrame:
    """Counts, accuracy, and precision, recall and F1 of both classes."""
    safe = F.col("p") >= cut
    n = lambda c: F.count_if(F.coalesce(c, F.lit(False)))
    out = df.groupBy(*(by or [])).agg(
        F.count("*").alias("n"), n(~F.col("label") & ~safe).alias("tp"), n(F.col("label") & ~safe).alias("fp"),
        n(F.col("label") & safe).alias("tn"), n(~F.col("label") & safe).alias("fn"),
    )
    tp, fp, tn, fn = (F.col(c) for c in ("tp", "fp", "tn", "fn"))
    out = out.withColumns(
        {
            "accuracy": ratio(tp + tn, F.col("n")), "harmful_precision": ratio(tp, tp + fp), "harmful_recall": ratio(tp, tp + fn),
            "safe_precision": ratio(tn, tn + fn), "safe_recall": ratio(tn, tn + fp),
        }
    )
    return out.withColumns({"harmful_f1": f1(F.col("harmful_precision"), F.col("harmful_recall")), "safe_f1": f1(F.col("safe_precision"), F.col("safe_recall"))})


def auroc(df: DataFrame, by: list[str] | None = None, one_class: float | None = 0.5) -> DataFrame:
    """Area under the curve by the trapezoid rule over distinct scores; null where all confidences (p or 1 - p, whichever is larger) are equal, else ``one_class`` where there is one class only."""
    by = by or []
    steps = df.groupBy(*by, "p").agg(F.count_if("label").alias("pos"), F.count_if(~F.col("label")).alias("neg"))
    steps = running(steps, [F.col("p").desc()], {"tp": F.col("pos"), "fp": F.col("neg")}, by)
    area = F.sum(F.col("neg") * (2 * F.col("tp") - F.col("pos")) / 2)
    out = steps.groupBy(*by).agg(area.alias("area"), F.sum("pos").alias("positives"), F.sum("neg").alias("negatives"), F.min(F.greatest("p", 1 - F.col("p"))).alias("least"), F.max(F.greatest("p", 1 - F.col("p"))).alias("most"))
    whole = F.col("positives") * F.col("negatives")
    return out.select(*by, F.when(F.col("least") < F.col("most"), F.when(whole > 0, F.col("area") / whole).otherwise(F.lit(one_class).cast("double"))).alias("auroc"))


def calibration_error(df: DataFrame, by: list[str] | None = None, bins: int = 15, key: str = "id") -> DataFrame:
    """Expected calibration error over bins of max(1, n div bins) rows each, in order of confidence; ties by key."""
    by = by or []
    rows = df.select(*by, key, F.greatest("p", 1 - F.col("p")).alias("conf"), ((F.col("p") >= 0.5) == F.col("label")).cast("int").alias("right"))
    sizes = rows.groupBy(*by).agg(F.count("*").alias("n"))
    rows = row_numbers(rows, [F.col("conf"), F.col(key)], by=by)
    rows = rows.join(sizes, by) if by else rows.crossJoin(F.broadcast(sizes))
    binned = rows.groupBy(*by, "n", F.floor((F.col("rn") - 1) / F.greatest(F.lit(1), F.floor(F.col("n") / bins))).alias("bin")).agg(F.abs(F.sum("conf") - F.sum("right")).alias("gap"))
    return binned.groupBy(*by).agg((F.sum("gap") / F.first("n")).alias("ece"))


def coverage(df: DataFrame, threshold: float, by: list[str] | None = None) -> DataFrame:
    """Share of rows with p >= t or p <= 1 - t (null scores aren't), and accuracy among them (null if there are none)."""
    covered = F.coalesce((F.col("p") >= threshold) | (F.col("p") <= 1.0 - threshold), F.lit(False))
    right = (F.col("p") >= 0.5) == F.col("label")
    out = df.groupBy(*(by or [])).agg(F.count("*").alias("n"), F.count_if(covered).alias("n_covered"), F.count_if(covered & right).alias("n_right"))
    return out.select(*(by or []), "n", "n_covered", (F.col("n_covered") / F.col("n")).alias("coverage"), F.when(F.col("n_covered") > 0, F.col("n_right") / F.col("n_covered")).alias("accuracy_at"))


def sweep(df: DataFrame, steps: int = 20, by: list[str] | None = None) -> DataFrame:
    """Confusion at the thresholds 0/steps to steps/steps.

    Scores are first counted between thresholds, so the table is read once and only counts meet the grid."""
    by = by or []
    # rows of place k are safe at the thresholds 0 to k
    place = F.when(F.col("p") >= 1, steps).when(F.col("p") < 0, -1).otherwise(F.floor(F.col("p") * steps))
    counts = df.where("p IS NOT NULL").groupBy(*by, place.cast("int").alias("place")).agg(F.count_if("label").alias("safe"), F.count_if(~F.col("label")).alias("harmful"))
    grid = counts.groupBy(*by).agg(F.collect_list(F.struct("place", "safe", "harmful")).alias("c")).select(*by, "c", F.explode(F.sequence(F.lit(0), F.lit(steps))).alias("k"))
    total = lambda kind, above: F.aggregate("c", F.lit(0).cast("long"), lambda a, x: a + F.when((x["place"] >= F.col("k")) == F.lit(above), x[kind]).otherwise(0))
    out = grid.select(*by, (F.col("k") / steps).alias("threshold"), total("harmful", False).alias("tp"), total("safe", False).alias("fp"), total("safe", True).alias("tn"), total("harmful", True).alias("fn"))
    tp, fp, tn, fn = (F.col(c) for c in ("tp", "fp", "tn", "fn"))
    out = out.withColumns({"harmful_precision": ratio(tp, tp + fp), "harmful_recall": ratio(tp, tp + fn), "safe_precision": ratio(tn, tn + fn), "safe_recall": ratio(tn, tn + fp)})
    return out.withColumns({"harmful_f1": f1(F.col("harmful_precision"), F.col("harmful_recall")), "safe_f1": f1(F.col("safe_precision"), F.col("safe_recall"))})


def best_threshold(swept: DataFrame, by: list[str] | None = None, least_harmful_f1: float = 0.0, least_precision: float = 0.0) -> DataFrame:
    """The threshold of the largest safe F1 among those that hold both floors; the first of equal ones."""
    fine = (F.col("harmful_f1") >= least_harmful_f1) & (F.col("safe_precision") >= least_precision)
    best = F.max_by(F.struct("threshold", "safe_f1", "harmful_f1"), F.struct("safe_f1", -F.col("threshold")))
    return swept.where(fine).groupBy(*(by or [])).agg(best.alias("b")).select(*(by or []), "b.*")


def nearest_rank(df: DataFrame, value: str, shares: dict[str, float], key: str) -> DataFrame:
    """The values at places round(share * (n - 1)) (half to even) in order, and count and maximum."""
    n = df.where(F.col(value).isNotNull())
    rows = row_numbers(n.select(value, key), [F.col(value), F.col(key)]).crossJoin(F.broadcast(n.agg(F.count("*").alias("n"))))
    pick = [F.max(F.when(F.col("rn") == F.bround(s * (F.col("n") - 1)) + 1, F.col(value))).alias(name) for name, s in shares.items()]
    return rows.agg(F.max("n").alias("n"), *pick, F.max(value).alias("max"))


def class_weights(df: DataFrame, label: str = "label", cap: float = 10.0) -> DataFrame:
    """n / (2 * n of the class), between 1/cap and cap; 1 where there is one class only."""
    per = df.where(F.col(label).isNotNull()).groupBy(label).agg(F.count("*").alias("n"))
    total = per.agg(F.sum("n").alias("total"), F.count("*").alias("classes"))
    w = F.greatest(F.lit(1 / cap), F.least(F.lit(cap), F.col("total") / (2 * F.col("n"))))
    return per.crossJoin(F.broadcast(total)).select(label, "n", F.when(F.col("classes") < 2, F.lit(1.0)).otherwise(w).alias("weight"))


def poisson_draws(df: DataFrame, replicates: int, key: str, seed: int) -> DataFrame:
    """Each row for each replicate (``rep``), with ``times``: a Poisson(1) draw by md5 of (row, replicate, seed)."""
    unit = F.conv(F.substring(F.md5(F.concat_ws(":", F.col(key).cast("string"), F.col("rep").cast("string"), F.lit(str(seed)))), 1, 8), 16, 10).cast("long") / F.lit(4294967296.0)
    # cumulative shares of Poisson(1) for 0, 1, 2, ...
    steps = [0.36787944117144233, 0.7357588823428847, 0.9196986029286058, 0.9810118431238462, 0.9963401531726563, 0.9994058151824183]
    times = sum((F.when(unit >= s, 1).otherwise(0) for s in steps), F.lit(0))
    return df.withColumn("rep", F.explode(F.sequence(F.lit(0), F.lit(replicates - 1)))).withColumn("times", times)


def bootstrap_accuracy(df: DataFrame, replicates: int, key: str = "id", seed: int = 42) -> DataFrame:
    """Accuracy in each replicate, where a row counts as often as a Poisson(1) draw by md5 of (row, replicate, seed) says.

    The draws need no row of another, so replicates are sums in one pass; ``bootstrap_interval`` gives bounds."""
    rows = poisson_draws(df.select(key, ((F.col("p") >= 0.5) == F.col("label")).cast("int").alias("right")), replicates, key, seed)
    return rows.groupBy("rep").agg(F.sum("times").alias("n"), F.sum(F.col("times") * F.col("right")).alias("n_right")).select("rep", "n", F.try_divide("n_right", "n").alias("accuracy"))


def bootstrap_interval(df: DataFrame, metric: Callable[[DataFrame, list[str]], DataFrame], names: list[str], replicates: int = 1000, ci: float = 0.95, key: str = "id", seed: int = 42) -> DataFrame:
    """Rows (metric, defined, lower, upper): percentile bounds of columns of a metric over seeded replicates.

    ``metric`` is called once, as ``confusion`` and ``auroc`` are, with the rows drawn and ["rep"].  Bounds are values at sorted places,
    null where fewer than max(20, replicates div 10) replicates have a value.  One value a replicate is all that is gathered."""
    low = (1.0 - ci) / 2.0
    drawn = poisson_draws(df.select(key, "label", "p"), replicates, key, seed).where("times > 0")
    drawn = drawn.select("rep", key, "label", "p", F.explode(F.array_repeat(F.lit(1), F.col("times")))).drop("col")
    values = metric(drawn, ["rep"]).select(F.explode(F.array(*[F.struct(F.lit(n).alias("metric"), F.col(n).cast("double").alias("v")) for n in names])).alias("x"))
    n = F.size("s")
    at = lambda place: F.get("s", F.greatest(F.lit(0), F.least(n - 1, place)))
    out = values.groupBy("x.metric").agg(F.sort_array(F.collect_list("x.v")).alias("s"))
    bound = lambda place: F.when(n >= max(20, replicates // 10), at(place))
    return out.select("metric", n.alias("defined"), bound((F.lit(low) * n).cast("int")).alias("lower"), bound((F.lit(1.0 - low) * n).cast("int") - 1).alias("upper"))
