"""The registered queries against their SQL, and the pipeline against a plain version."""

import hashlib
import re
import sys
from pathlib import Path

import pytest
from pyspark.sql import functions as F

sys.path[:0] = [str(Path(__file__).resolve().parents[1]), str(Path(__file__).resolve().parents[2])]

from oracle import database, spark_rows, sql_rows  # noqa: E402

from palimpsest.llm import langid, queries  # noqa: E402


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_equals_sql(spark, sf, name):
    assert spark_rows(queries.QUERIES[name](spark, sf)) == sql_rows(database(sf), queries.SQL[name])


@pytest.mark.parametrize("name", sorted(set(queries.QUERIES) - set(queries.SQL)))
def test_one_row_a_document(spark, sf, name):
    assert queries.QUERIES[name](spark, sf).select("doc_id").distinct().count() == 200


def test_pipeline(spark, sf):
    import corpus_pipeline

    docs = spark.read.parquet(f"{sf}/documents.parquet")
    kept = {r.doc_id: r.text for r in langid.identify(docs, langid.learn(docs)).where("NOT rejected").collect()}
    low = str.maketrans({chr(65 + i): chr(97 + i) for i in range(26)})
    words = lambda t: re.findall(r"[^\x20\x09-\x0D]+", t or "")
    sets = {i: {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if (w := words((t or "").translate(low))) else set() for i, t in kept.items()}
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in sets:
        for j in sets:
            if j < i and sets[i] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    kept = {i: t for i, t in kept.items() if find(i) == i}
    first, left = {}, {}
    for i in sorted(kept):
        w = words(kept[i])
        for k in range(len(w) - 49):
            first.setdefault(tuple(w[k : k + 50]), i)
    for i, t in kept.items():
        w = words(t)
        gone = {p for k in range(len(w) - 49) if first[tuple(w[k : k + 50])] < i for p in range(k, k + 50)}
        if not gone:
            left[i] = t
        elif len(gone) < len(w):
            left[i] = " ".join(x for p, x in enumerate(w) if p not in gone)
    split = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate(low))
    windows = set()
    for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect():
        w = split(r.text)
        windows |= {tuple(w[k : k + 10]) for k in range(max(1, len(w) - 9))} if w else set()
    lengths = {len(x) for x in windows}
    clean = {i: t for i, t in left.items() if not any(tuple(w[k : k + n]) in windows for w in [split(t)] for n in lengths for k in range(len(w) - n + 1))}
    got = {r.doc_id: r.decoded_sha256 for r in corpus_pipeline.run(spark, sf).collect()}
    assert got == {i: hashlib.sha256((t or "").encode()).hexdigest() for i, t in clean.items()}
    assert 100 < len(got) < 200


def test_stages_on_odd_rows(spark, sf, tmp_path):
    """Nulls in all columns, repeated rows, an extra column, and an empty table, through every stage."""
    import corpus_pipeline

    docs = spark.read.parquet(f"{sf}/documents.parquet")
    item = spark.read.parquet(f"{sf}/benchmark.parquet").first().text
    (long,) = [r.text for r in docs.where("lang IS NOT NULL").orderBy(F.desc("n_chars")).limit(1).collect()]
    words = long.split()
    one = " ".join(words[:90])
    odd = [(None, one, None, None, None), (900_001, one, "x", "s", 1), (900_001, one, "x", "s", 1), (900_002, one, None, None, None), (900_003, None, None, None, None), (900_004, "", "x", "s", 0), (900_005, item, "x", "s", 9)]
    more = spark.createDataFrame(odd, "doc_id long, text string, lang string, source string, n_chars long")
    rows = docs.unionByName(more).withColumn("key", F.lit("extra"))
    ids = lambda df: sorted(r.doc_id or -1 for r in df.select("doc_id").collect() if r.doc_id is None or r.doc_id > 900_000)
    stages = dict(corpus_pipeline.STAGES)
    assert ids(stages["language_id"](spark, rows, sf)) == [-1, 900_001, 900_001, 900_002, 900_005]
    assert ids(stages["near_duplicates"](spark, rows, sf)) == [-1, 900_001, 900_001, 900_003, 900_004, 900_005]
    assert 900_005 not in ids(stages["decontamination"](spark, rows, sf)) and {-1, 900_003, 900_004} <= set(ids(stages["decontamination"](spark, rows, sf)))
    assert -1 in ids(stages["substring_dedup"](spark, rows, sf))
    tokens = {r.doc_id: r.n_tokens for r in stages["tokens"](spark, more, sf).collect()}
    assert tokens[900_003] == tokens[900_004] == 0 < tokens[900_005]
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, rows.where("false"), sf)
        assert out.count() == 0, name
        assert out.columns == corpus_pipeline.COLUMNS or name == "tokens"


def test_pipeline_goes_on_after_a_failure(spark, sf, tmp_path, monkeypatch):
    import corpus_pipeline

    folder, ran = str(tmp_path / "run"), []
    docs = spark.read.parquet(f"{sf}/documents.parquet").limit(40)

    def stage(name, fails=False):
        def one(spark, rows, sf_dir):
            ran.append(name)
            if fails:
                raise RuntimeError("lost")
            return docs if name == "a" else rows

        return name, one

    monkeypatch.setattr(corpus_pipeline, "STAGES", [stage("a"), stage("b"), stage("c", True), stage("d")])
    with pytest.raises(RuntimeError, match="lost"):
        corpus_pipeline.run(spark, sf, folder)
    monkeypatch.setattr(corpus_pipeline, "STAGES", [stage("a"), stage("b"), stage("c"), stage("d")])
    assert corpus_pipeline.run(spark, sf, folder).count() == 40
    assert ran == ["a", "b", "c", "c", "d"]
    assert [p.name for p in sorted((tmp_path / "run").iterdir())] == ["2_c"]
