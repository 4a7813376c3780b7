"""URL rules indexed by their rarest literal token (operator 2), in DataFrame functions only.

A rule is a host and a path prefix.  Its tokens are the host's labels and the path's
complete segments; whatever url the rule fits has all of them among its own tokens.
Each rule is indexed under the token that the fewest urls have; a url's tokens fetch
candidate rules, and only those run their regular expression.  Each distinct url is
judged once.  The index is broadcast by Spark only below its own measured threshold.

Defined results: null urls and urls without ``://`` have empty host and path and fit no rule;
where no rule fits, ``rule`` is null and the verdict is the default; of fitting rules the
longest wins (then the later in string order, and block before allow); a rule without
any token is under the empty token, which every url has; repeated urls are judged alike; an
empty table gives no rows and no rules give the default; other columns stay, but for those
named as the new ones; a url of any length is judged whole.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palimpsest.cluster import unused

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def lower_ascii(c: Column) -> Column:
    return F.translate(c, UPPER, LOWER)


def host_path(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lowered) and path of a url."""
    at = F.instr(url, F.lit("://"))
    rest = F.when(at > 0, F.substr(url, at + 3)).otherwise(F.lit(""))
    rest = F.coalesce(rest, F.lit(""))
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    path = F.regexp_extract(F.substr(rest, F.length(host) + 1), r"^[^?#]*", 0)
    return lower_ascii(host), path


def tokens(host: Column, path: Column) -> Column:
    """Labels of the host and segments of the path, and the empty token."""
    return F.array_distinct(F.concat(F.split(host, r"\."), F.split(lower_ascii(path), "/"), F.array(F.lit(""))))


def rule_tokens(host: Column, path: Column) -> Column:
    """Tokens that any fitting url has: all labels, and path segments that end within the rule."""
    segments = F.split(lower_ascii(path), "/")
    whole = F.slice(segments, 1, F.size(segments) - 1)
    return F.array_distinct(F.concat(F.split(host, r"\."), whole, F.array(F.lit(""))))


def judge(pages: DataFrame, rules: DataFrame, url: str = "url", default: str = "allow") -> DataFrame:
    """The pages with host, path, rule and verdict, instead of columns of these names; rules are rows (host, path, verdict)."""
    pages = pages.select(*[c for c in pages.columns if c not in ("host", "path", "rule", "verdict")])
    host, path = host_path(F.col(url))
    urls = pages.select(F.col(url).alias("url")).where("url IS NOT NULL").distinct().select("url", host.alias("host"), path.alias("path"))
    rules = rules.select(
        F.concat("host", "path").alias("rule"), "verdict", rule_tokens(F.col("host"), F.col("path")).alias("tokens"),
        F.concat(F.lit(r"(?s)^(?:[^/]*\.)?\Q"), "host", F.lit(r"\E\Q"), "path", F.lit(r"\E")).alias("pattern"),
    )
    wanted = rules.select(F.explode("tokens").alias("token")).distinct()
    asked = urls.select("url", "host", "path", F.explode(tokens(F.col("host"), F.col("path"))).alias("token"))
    counts = asked.join(wanted, "token").groupBy("token").agg(F.count("*").alias("n"))
    # the rarest token of each rule; the empty one has all urls
    listed = rules.select("rule", "verdict", "pattern", F.explode("tokens").alias("token")).join(counts, "token", "left")
    index = listed.groupBy("rule", "verdict", "pattern").agg(F.min_by("token", F.struct(F.coalesce("n", F.lit(0)), "token")).alias("token"))
    fits = asked.join(index, "token").where(F.regexp_like(F.concat("host", "path"), F.col("pattern")))
    best = fits.groupBy("url").agg(F.max_by(F.struct("rule", "verdict"), F.struct(F.length("rule"), "rule", "verdict")).alias("best"))
    judged, fit = unused("judged", pages.columns), unused("fit", pages.columns)
    rows = pages.join(best.select(F.col("url").alias(judged), F.col("best").alias(fit)), F.col(url) == F.col(judged), "left")
    return rows.select(*pages.columns, host.alias("host"), path.alias("path"), F.col(fit)["rule"].alias("rule"), F.coalesce(F.col(fit)["verdict"], F.lit(default)).alias("verdict"))
