"""Queries of whole evaluations: rows read from files, contexts made by strategies, scores of an injected scorer, reports."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.cluster import shared_folder
from palimpsest.operators import context as C
from palimpsest.operators import metrics as M
from palimpsest.operators import perturb as P
from palimpsest.operators import registry as G
from palimpsest.operators import sets
from palimpsest.plans.context import BASE, messages
from palimpsest.plans.metrics import COUNTS, F1S, RATIOS, rounded
from palimpsest.plans.registry import query, table
from palimpsest.sources import readers, sinks
from palimpsest.streaming import windows as S


def by_length(texts: pd.Series) -> pd.Series:
    """What stands for a model's score: a function of the text's length."""
    return (texts.str.len() % 97) / 96.0


@query(f"WITH scored AS (SELECT quality = 1 AS label, (length(text) % 97) / 96.0::DOUBLE AS p FROM labels JOIN documents USING (doc_id) WHERE text <> ''), c AS (SELECT {COUNTS.format(t=0.5)} FROM scored), r AS (SELECT *, ((tp + tn) / n)::DOUBLE AS accuracy, {RATIOS} FROM c) SELECT r.*, {F1S} FROM r")
def evaluated_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labelled texts written as JSON lines (half of them as prompt, half as input), read, scored by an injected function, and reported."""
    rows = table(spark, sf_dir, "labels").join(table(spark, sf_dir, "documents").select("doc_id", "text"), "doc_id")
    odd = F.col("doc_id") % 2 == 1
    folder = shared_folder(spark, "evaluated")
    sinks.write_jsonl(rows.select(F.col("quality").cast("string").alias("label"), F.when(odd, F.col("text")).alias("prompt"), F.when(~odd, F.col("text")).alias("input")), folder)
    read = readers.prompts(readers.read_jsonl(spark, folder, "label string, prompt string, input string", ["label"], strict=True))
    scored = G.with_scores(read, by_length, "prompt", "p").select((F.col("label") == 1).alias("label"), "p")
    return rounded(M.confusion(scored), "harmful_f1", "safe_f1")


STRATEGIES = {"masking": [lambda df: C.masked(df, 1, 2)], "pass_through": [C.pass_through], "both": [C.pass_through, lambda df: C.masked(df, 1, 2)]}
RUN = BASE + f""", k AS (SELECT *, role IN ('user', 'tool') AND pos >= 1 AND back > 2 AND NOT regexp_matches(content, '{C.ERRORS}') AS gone FROM p),
v AS (SELECT 'pass_through' AS strategy, conv, pos, role, content, content AS given FROM k UNION ALL SELECT s, conv, pos, role, CASE WHEN gone THEN '<MASKED>' ELSE content END, content FROM k, (VALUES ('masking'), ('both')) t(s)),
b AS (SELECT strategy, conv, substr(string_agg('[' || upper(role) || ']' || chr(10) || content, chr(10) || chr(10) ORDER BY pos), 1, 24000) AS prompt, (sum(length(content) // 4) / nullif(sum(length(given) // 4), 0))::DOUBLE AS kept, bool_or(content <> given) AS compacted FROM v GROUP BY strategy, conv),
e AS (SELECT strategy, conv, (length(prompt) % 97) / 96.0::DOUBLE AS score, kept, compacted FROM b)
"""


def runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each conversation by each strategy: the memory's context as a prompt, scored, and the share of tokens that is left."""
    rows = messages(spark, sf_dir)
    before = rows.groupBy("conv").agg(F.sum(C.tokens(F.col("content"))).alias("before"), F.md5(F.concat_ws("\n", F.transform(F.array_sort(F.collect_list(F.struct("pos", "content"))), lambda m: m["content"]))).alias("was"))
    out = None
    for name, stages in STRATEGIES.items():
        seen = G.pipeline(rows, stages)
        after = seen.groupBy("conv").agg(F.sum(C.tokens(F.col("content"))).alias("after"), F.md5(F.concat_ws("\n", F.transform(F.array_sort(F.collect_list(F.struct("pos", "content"))), lambda m: m["content"]))).alias("now"))
        one = G.with_scores(P.rendered(seen), by_length, "prompt", "score").join(after, "conv").join(before, "conv")
        one = one.select(F.lit(name).alias("strategy"), "conv", "score", F.try_divide("after", "before").alias("kept"), (F.col("was") != F.col("now")).alias("compacted"))
        out = one if out is None else out.unionByName(one)
    return out


@query(RUN + "SELECT * FROM e")
def memory_then_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return runs(spark, sf_dir)


@query(RUN + "SELECT coalesce(strategy, 'all') AS strategy, coalesce((conv % 3)::VARCHAR, 'all') AS stratum, count(*) AS n, round(avg(CASE WHEN conv % 7 = 0 THEN 0 ELSE score END), 6) AS score FROM e WHERE conv IS NOT NULL GROUP BY CUBE (strategy, conv % 3)")
def strategy_benchmark(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean scores by strategy and stratum with margins; a run that failed counts as 0."""
    rows = runs(spark, sf_dir).where("conv IS NOT NULL").withColumn("score", F.when(F.col("conv") % 7 == 0, None).otherwise(F.col("score")))
    out = rows.withColumn("stratum", (F.col("conv") % 3).cast("string")).cube("strategy", "stratum").agg(F.count("*").alias("n"), F.round(F.avg(F.coalesce("score", F.lit(0.0))), 6).alias("score"))
    return out.select(F.coalesce("strategy", F.lit("all")).alias("strategy"), F.coalesce("stratum", F.lit("all")).alias("stratum"), "n", "score")


@query("""WITH d AS (SELECT conv_id AS inst, turn AS pos, CASE WHEN role = 'user' THEN 'fact' ELSE 'distractor' END AS kind, turn // 2 AS t, 'e' || turn % 3 AS entity FROM conversations),
x AS (SELECT *, row_number() OVER (PARTITION BY inst ORDER BY pos) AS r, count(*) OVER (PARTITION BY inst) AS n FROM d WHERE kind = 'distractor'), l AS (SELECT inst, max(pos) AS last FROM d GROUP BY inst),
a AS (SELECT * FROM d UNION ALL SELECT inst, last + r, kind, t, entity FROM x JOIN l USING (inst) WHERE r <= floor(n * 0.5::DOUBLE)),
f AS (SELECT *, max(t) OVER (PARTITION BY inst) AS top, max((kind = 'fact')::INT) OVER (PARTITION BY inst, entity) AS about FROM a)
SELECT inst, pos, kind, CASE WHEN kind = 'distractor' AND about = 1 THEN least(t + 1, top) ELSE t END AS turn FROM f""")
def hardened_instances(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations as instances, through the transforms of a preset: more distractors, and those about a fact's entity a turn later."""
    c = table(spark, sf_dir, "conversations")
    docs = c.select(F.col("conv_id").alias("inst"), F.col("turn").alias("pos"), F.when(F.col("role") == "user", "fact").otherwise("distractor").alias("kind"), F.floor(F.col("turn") / 2).alias("turn"), F.concat(F.lit("e"), F.col("turn") % 3).alias("entity"))
    return G.harden(docs, "hard").select("inst", "pos", "kind", "turn")


@query("SELECT DISTINCT source AS slug FROM documents WHERE source IS NOT NULL")
def appended_topics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two batches of topics appended to one table; only those that aren't there yet are written."""
    docs, folder = table(spark, sf_dir, "documents").where("source IS NOT NULL").select(F.col("source").alias("slug"), "doc_id"), shared_folder(spark, "topics")
    sinks.append_new(docs.where("doc_id % 3 = 0").select("slug"), docs.where("false"), "slug", folder)
    there = spark.read.schema("slug string").json(folder)
    sinks.append_new(docs.select("slug"), there, "slug", folder)
    return spark.read.schema("slug string").json(folder)


@query("WITH u AS (SELECT s_suppkey AS id, n_name AS title, 1 AS source_rank FROM supplier JOIN nation ON s_nationkey = n_nationkey UNION ALL SELECT c_custkey, n_name, 0 FROM customer JOIN nation ON c_nationkey = n_nationkey), r AS (SELECT *, row_number() OVER (PARTITION BY title ORDER BY source_rank, id) AS rn FROM u) SELECT id, title, source_rank FROM r WHERE rn = 1")
def planned_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sources in the order of a stated plan, the first one's rows of equal titles."""
    nation = table(spark, sf_dir, "nation")
    s = table(spark, sf_dir, "supplier").join(nation, F.col("s_nationkey") == F.col("n_nationkey")).select(F.col("s_suppkey").alias("id"), F.col("n_name").alias("title"))
    c = table(spark, sf_dir, "customer").join(nation, F.col("c_nationkey") == F.col("n_nationkey")).select(F.col("c_custkey").alias("id"), F.col("n_name").alias("title"))
    return sets.first_wins(readers.source_plan("customers + suppliers", {"suppliers": s, "customers": c}), F.col("title"), "id")


def notes(key: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
    """What stands for a model that keeps notes: the first 15,000 characters of all that was said."""
    n, chars = state.get if state.exists else (0, 0)
    out = []
    for pos, content in sorted((int(p), c) for batch in batches for p, c in zip(batch["pos"], batch["content"], strict=True)):
        chars = min(15_000, chars + len(content) + (n > 0))
        n += 1
        out.append((key[0], pos, n, chars))
    state.update((n, chars))
    yield pd.DataFrame(out, columns=["conv", "pos", "n_seen", "note_chars"])


@query(BASE + "SELECT conv, pos, pos + 1 AS n_seen, least(15000, sum(length(content)) OVER (PARTITION BY conv ORDER BY pos) + pos)::BIGINT AS note_chars FROM p")
def stream_folded_notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Injected code that folds each conversation, as a stream with state."""
    return S.finished(S.folded(S.replayed(messages(spark, sf_dir), "messages"), notes, "conv long, pos long, n_seen long, note_chars long", "n long, chars long"), "folded")
