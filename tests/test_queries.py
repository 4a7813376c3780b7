"""Every registered query of the library against its SQL."""

import pytest
from oracle import database, spark_rows, sql_rows

from palimpsest.plans import catalog


@pytest.fixture(scope="module")
def db(sf):
    return database(sf)


@pytest.mark.parametrize("name", sorted(catalog.SQL))
def test_equals_sql(spark, sf, db, name):
    assert spark_rows(catalog.QUERIES[name](spark, sf)) == sql_rows(db, catalog.SQL[name])


def test_question_dedup(spark, sf):
    import re

    def words(t):
        return {w for x in (t or "").lower().split() if len(w := re.sub(r"^[^a-z0-9]+|[^a-z0-9]+$", "", x)) > 3}

    rows, want = {}, set()
    for r in spark.read.parquet(f"{sf}/conversations.parquet").collect():
        rows.setdefault(r.conv_id, []).append((-len(r.text), r.turn, words(r.text)))
    for conv, found in rows.items():
        kept = []
        for _, turn, w in sorted(found, key=lambda x: x[:2]):
            if w and len(kept) < 5 and not any(len(w & o) > 0.7 * min(len(w), len(o)) for _, o in kept):
                kept.append((turn, w))
        want |= {(conv, t) for t, _ in kept}
    assert {(r.conv_id, r.turn) for r in catalog.QUERIES["question_dedup"](spark, sf).collect()} == want


def test_personalised_rank(spark):
    from palimpsest.operators.graph import page_rank

    edges = [("a", "b"), ("b", "a"), ("b", "c"), ("c", "a")]
    got = {r.node: r["rank"] for r in page_rank(spark.createDataFrame(edges, "a string, b string"), spark.createDataFrame([("a",)], "node string"), 4).collect()}
    rank = {"a": 1.0}
    for _ in range(4):
        new = {"a": 0.15}
        for a, b in edges:
            if a in rank:
                new[b] = new.get(b, 0) + 0.85 * rank[a] / sum(x == a for x, _ in edges)
        rank = new
    assert got == pytest.approx(rank)
