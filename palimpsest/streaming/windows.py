"""Structured Streaming forms of the context operators; on the same input they give what the batch forms give."""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palimpsest.cluster import shared_folder, ship


def replayed(df: DataFrame, name: str, order: list[str] | None = None) -> DataFrame:
    """A stream that reads what is written of a table."""
    spark, path = df.sparkSession, shared_folder(df.sparkSession, name)
    df.write.parquet(path)
    return spark.readStream.schema(df.schema).parquet(path)


def finished(stream: DataFrame, name: str, mode: str = "append") -> DataFrame:
    """Runs a stream over what there is and returns its output, written to a shared folder."""
    spark = stream.sparkSession
    out, state = shared_folder(spark, f"{name}-out"), shared_folder(spark, f"{name}-state")
    if mode == "append":
        run = stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", state).outputMode(mode).trigger(availableNow=True).start()
    else:
        put = lambda batch, _: batch.write.mode("overwrite").parquet(out)
        run = stream.writeStream.foreachBatch(put).option("checkpointLocation", state).outputMode(mode).trigger(availableNow=True).start()
    run.awaitTermination()
    return spark.read.schema(stream.schema).parquet(out)


def sessions(events: DataFrame, key: str, at: str, gap: str, late: str) -> DataFrame:
    """Sessions of a key with pauses below ``gap``; rows more than ``late`` behind are left out."""
    w = F.session_window(at, gap)
    return events.withWatermark(at, late).groupBy(key, w).agg(F.count("*").alias("n"), F.sum("value").alias("value")).select(key, F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "n", "value")


def tumbling(events: DataFrame, at: str, width: str, late: str, by: str) -> DataFrame:
    w = F.window(at, width)
    return events.withWatermark(at, late).groupBy(w, by).agg(F.count("*").alias("n")).select(F.col("window.start").alias("start"), by, "n")


def rolling_summary(messages: DataFrame, window: int, keep_first: int, size: int = 200, cap: int = 1000) -> DataFrame:
    """For each message (conv, pos, role, content), in order of pos within a batch: what the agent sees then, as (conv, pos, n_seen, summary_chars).

    The state of a conversation is its count, the messages still in the window and the summary of those that left;
    it doesn't grow with the conversation, as the summary is capped."""
    ship(messages.sparkSession)

    def step(key, batches, state) -> Iterator:
        import pandas as pd

        n, held, summary = state.get if state.exists else (0, [], "")
        held, out = list(held), []
        rows = pd.concat(list(batches)).sort_values("pos")
        for pos, role, content in zip(rows["pos"], rows["role"], rows["content"], strict=True):
            if n >= keep_first:
                held.append(f"{role}: {(content or '')[:size]}")
                if len(held) > window:
                    summary = (summary + "\n" + held.pop(0) if summary else held.pop(0))[:cap]
            n += 1
            out.append((key[0], pos, min(n, keep_first) + len(held) + bool(summary), len(summary)))
        state.update((n, held, summary))
        yield pd.DataFrame(out, columns=["conv", "pos", "n_seen", "summary_chars"])

    return messages.groupBy("conv").applyInPandasWithState(step, "conv long, pos long, n_seen long, summary_chars long", "n long, held array<string>, summary string", "append", "NoTimeout")


def folded(messages: DataFrame, step: Callable, schema: str, state: str) -> DataFrame:
    """A fold of one's own over each conversation's messages, with injected code (key, batches, state)."""
    ship(messages.sparkSession)
    return messages.groupBy("conv").applyInPandasWithState(step, schema, state, "append", "NoTimeout")
