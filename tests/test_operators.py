"""Operators on small stated inputs."""

import random

import pytest
from pyspark.sql import functions as F

from palimpsest.operators import context, graph, instances, metrics, pairs, ranking, registry, retrieval, sets
from palimpsest.sources import readers, sinks


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def scored(spark):
    return spark.createDataFrame([(1, True, 0.95), (2, True, 0.80), (3, True, 0.60), (4, False, 0.10), (5, False, 0.30)], "id long, label boolean, p double")


def test_metrics_of_a_perfect_scorer(spark):
    df = scored(spark)
    assert metrics.auroc(df).first().auroc == 1.0
    assert metrics.confusion(df).first().accuracy == 1.0
    assert metrics.calibration_error(df).first().ece == pytest.approx(0.21)
    c = metrics.coverage(df, 0.88).first()
    assert (c.n, c.n_covered, c.coverage, c.accuracy_at) == (5, 2, 0.4, 1.0)


def test_metrics_where_undefined(spark):
    one = spark.createDataFrame([(1, True, 0.5)], "id long, label boolean, p double")
    assert metrics.auroc(one).first().auroc is None
    one_class = spark.createDataFrame([(1, True, 0.9), (2, True, 0.7)], "id int, label boolean, p double")
    assert metrics.auroc(one_class).first().auroc == 0.5 and metrics.auroc(one_class, one_class=None).first().auroc is None
    mirrored = spark.createDataFrame([(1, True, 0.75), (2, False, 0.25)], "id int, label boolean, p double")
    assert metrics.auroc(mirrored).first().auroc is None
    assert metrics.coverage(one, 0.88).first().accuracy_at is None
    empty = scored(spark).where("false")
    assert metrics.confusion(empty).first().accuracy == 0.0
    assert metrics.auroc(empty).collect()[:1] in ([], [(None,)])


def test_running_totals_over_ranges(spark):
    values = list(range(500)) * 2
    random.Random(1).shuffle(values)
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "id long, v long")
    got = {r.id: (r.rn, r.total) for r in ranking.running(df, [F.col("v"), F.col("id")], {"rn": F.lit(1), "total": F.col("v")}).collect()}
    total = 0
    for n, (v, i) in enumerate(sorted((v, i) for i, v in enumerate(values)), 1):
        total += v
        assert got[i] == (n, total)


def test_components(spark):
    rng = random.Random(3)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(200)] + [(i, i + 1) for i in range(400, 460)]
    root = {}

    def find(x):
        root.setdefault(x, x)
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    got = dict(rows(graph.components(spark.createDataFrame([*edges, (7, 7), (None, 1)], "a long, b long"))))
    assert got == {x: find(x) for x in got}
    assert {x for e in edges if e[0] != e[1] for x in e} == set(got)
    assert rows(graph.components(spark.createDataFrame([], "a long, b long"))) == []


def conversation(spark, *said):
    return spark.createDataFrame([(1, i, role, text) for i, (role, text) in enumerate(said)], "conv long, pos long, role string, content string")


def test_second_user_is_pinned_when_the_first_is_in_the_head(spark):
    df = conversation(spark, ("user", "a"), ("assistant", "b"), ("user", "c"), ("assistant", "d"), ("assistant", "e"))
    assert [(r.pos, r.part) for r in context.classed(df, 1, 1).orderBy("pos").collect()] == [(0, 0), (1, 1), (2, 0), (3, 1), (4, 2)]


def test_naive_tail_repeats_the_head_of_a_short_conversation(spark):
    df = conversation(spark, ("user", "x" * 40), ("assistant", "y" * 40))
    assert [r.pos for r in context.naive_summary(df, 5, 1, 5).orderBy("ord").collect()] == [0, 0, 1]


def test_masking_keeps_errors(spark):
    df = conversation(spark, ("user", "q"), ("tool", "fine"), ("tool", "it FAILED"), ("user", "z"))
    assert [r.content for r in context.masked(df, 1, 1).orderBy("pos").collect()] == ["q", "<MASKED>", "it FAILED", "z"]


def test_as_of_ties_and_gaps(spark):
    q = spark.createDataFrame([(1, "a", 5), (2, "a", 1), (3, "b", 9)], "id long, k string, t long")
    f = spark.createDataFrame([("a", 5, 0.5, 1), ("a", 2, 0.2, 2), ("a", 6, 0.6, 3)], "k string, t long, v double, i long")
    assert rows(pairs.as_of(q, f, "k", "t", "v", "i").select("id", "latest", "n_before").fillna(-1.0)) == [(1, 0.5, 2), (2, -1.0, 0), (3, -1.0, 0)]


def test_splits_overshoot_and_small_tables(spark):
    df = spark.createDataFrame([(g,) for g, n in (("a", 1), ("b", 3), ("c", 26)) for _ in range(n)], "g string")
    assert rows(sets.splits(df, "g").select("g", "split")) == [("a", "eval"), ("b", "eval"), ("c", "train")]
    assert rows(sets.splits(df.where("g <> 'c'"), "g").select("split").distinct()) == [("train",)]


def test_bm25_against_the_formula(spark):
    import math

    docs = {1: "red blue blue", 2: "green red", 3: "yellow sun and sky"}
    got = {r.doc: r["score"] for r in retrieval.bm25(retrieval.chunks(spark.createDataFrame(list(docs.items()), "doc long, text string"), "doc", "text"), spark.createDataFrame([(1, "blue red red")], "q long, text string"), "doc", "q", "text", 5).collect()}
    lists = {k: t.split() for k, t in docs.items()}
    mean, n = sum(map(len, lists.values())) / 3, 3
    raw = {w: math.log(n - d + 0.5) - math.log(d + 0.5) for w in {w for x in lists.values() for w in x} for d in [sum(w in x for x in lists.values())]}
    idf = {w: v if v >= 0 else 0.25 * sum(raw.values()) / len(raw) for w, v in raw.items()}
    want = {}
    for k, x in lists.items():
        want[k] = sum(idf.get(w, 0) * x.count(w) * 2.5 / (x.count(w) + 1.5 * (0.25 + 0.75 * len(x) / mean)) for w in ["blue", "red", "red"])
    assert got == pytest.approx({k: v for k, v in want.items() if v > 0}, abs=1e-6)


def test_substituted_by_longest_name_first(spark):
    df = spark.createDataFrame([(1, "ALICE met bob jones and annlee"), (2, None)], "id int, text string")
    got = instances.substituted(df, "text", {"alice": "Bob", "Bob": "Carl", "bob jones": "Ann Lee", "ann": "Zoe"})
    assert [r.text for r in got.orderBy("id").collect()] == ["Bob met Ann Lee and annlee", None]


def test_paper_ids(spark):
    from palimpsest.functions import text as X

    given = [(1, "10.1/X", "2101.1", "s", "7", "u", "t"), (2, "", "2101.1v3", "s", "7", "u", "t"), (3, None, None, "s", "7", "u", "t"), (4, None, None, "s", None, "u", "t"), (5, None, None, None, None, None, "Eine  Überschrift!"), (6, None, None, None, None, None, None)]
    df = spark.createDataFrame(given, "id int, doi string, arxiv string, source string, ident string, url string, title string")
    got = [r.paper for r in df.orderBy("id").select(X.paper_id(*[F.col(c) for c in ("doi", "arxiv", "source", "ident", "url", "title")]).alias("paper")).collect()]
    assert got[:4] == ["doi:10.1/x", "arxiv:2101.1", "s:7", "url:u"] and got[4].startswith("title:") and got[5] == "unknown"


def test_cosine_in_blocks(spark):
    rng = random.Random(3)
    df = spark.createDataFrame([(k, [rng.uniform(-1, 1) for _ in range(6)]) for k in range(90)], "vec_id long, embedding array<float>")
    asked = df.where("vec_id % 5 = 0")
    assert rows(retrieval.cosine(df, asked, "vec_id", "embedding", 4, block=400)) == rows(retrieval.cosine(df, asked, "vec_id", "embedding", 4))


def test_registry(spark):
    assert "passthrough" in registry.strategies()
    assert registry.strategy("PassThrough") is context.pass_through
    with pytest.raises(ValueError, match="sliding_window_summary"):
        registry.strategy("nothing")
    df = conversation(spark, *[("user", f"m{i}") for i in range(8)])
    out = registry.pipeline(df, [lambda d: context.sliding_window(d, 4), lambda d: context.sliding_window(d, 2)])
    assert [r.content for r in out.orderBy("pos").collect()][-2:] == ["m6", "m7"]
    assert rows(registry.with_scores(df.limit(1), lambda s: s.str.len().astype(float), "content", "n").select("n")) == [(2.0,)]


def test_transforms(spark):
    docs = spark.createDataFrame([(1, 0, "fact", 0, "e"), (1, 1, "distractor", 0, "e"), (1, 2, "distractor", 1, "x")], "inst long, pos long, kind string, turn long, entity string")
    assert rows(registry.harden(docs, "hard").select("pos", "turn")) == [(0, 0), (1, 1), (2, 1), (3, 1)]


def test_json_lines_round_trip(spark, tmp_path):
    p = tmp_path / "run" / "a.jsonl"
    p.parent.mkdir()
    p.write_text('{"id": "a", "action": "ls"}\nnot json\n{"action": "x"}\n{"id": "b", "action": " "}\n')
    got = readers.read_jsonl(spark, str(p), "id string, action string", ["id"], "action")
    assert rows(got.select("status", "folder")) == [("bad_json", "run"), ("bad_schema", "run"), ("empty_action", "run"), ("ok", "run")]
    with pytest.raises(Exception, match="bad_json in"):
        readers.read_jsonl(spark, str(p), "id string, action string", ["id"], strict=True).collect()
    sinks.append_new(got.where("status = 'ok'").select("id", "action"), spark.createDataFrame([("z",)], "id string"), "id", str(tmp_path / "out"))
    assert rows(sinks.read_examples(spark, str(tmp_path / "out"), "id string, label int, weight double").select("id", "label", "weight")) == [("a", 1, 1.0)]
    sinks.write_routed(got.where("id IS NOT NULL").select("id"), spark.createDataFrame([("a", "train")], "id string, split string"), "id", str(tmp_path / "routed"))
    assert sorted(x.name for x in (tmp_path / "routed").iterdir() if x.is_dir()) == ["split=train", "split=unknown"]


def test_prompts(spark):
    df = spark.createDataFrame([("p", "i", "1"), (None, "i", "0"), (None, None, "1")], "prompt string, input string, label string")
    assert rows(readers.prompts(df)) == [("i", 0), ("p", 1)]
    with pytest.raises(Exception, match="no label"):
        readers.prompts(spark.createDataFrame([("p", "i", None)], "prompt string, input string, label string")).collect()


def test_sources_by_spec(spark):
    assert [d.count() for d in readers.source_plan("b + a", {"a": spark.range(1), "b": spark.range(2)})] == [2, 1]
    with pytest.raises(ValueError):
        readers.source_plan("c", {"a": spark.range(1)})


def test_similar_instances_compare_common_words_too(spark):
    rng = random.Random(5)
    texts = {i: " ".join({f"common{int(rng.paretovariate(0.5)) % 30:02d}" for _ in range(rng.randrange(1, 9))} | {f"scarce{rng.randrange(200):03d}"}) for i in range(120)}
    sets = {i: set(t.split()) for i, t in texts.items()}
    want = []
    for i, w in sets.items():
        near = sorted((-len(w & o), j) for j, o in sets.items() if j != i and w & o)[:3]
        want += [(i, j, -n, rank) for rank, (n, j) in enumerate(near, 1)]
    df = spark.createDataFrame(list(texts.items()), "id long, text string")
    for most in (2, 5, 1000):
        assert rows(instances.similar_instances(df, "id", "text", 3, most)) == sorted(want)


def test_full_text_asks_for_all_words(spark):
    docs = spark.createDataFrame([(1, "one two three four"), (2, "one two three four five six"), (3, "six"), (4, "seven eight"), (5, "nine nine one"), (6, None)], "id long, text string")
    asked = spark.createDataFrame([("a", "one two three four five"), ("b", "one two three four five seven"), ("c", "six seven"), ("d", "nine six seven")], "q string, t string")
    got = {}
    for r in retrieval.full_text(docs, asked, "id", "text", "q", "t", 2).orderBy("q", "rank").collect():
        got.setdefault(r.q, []).append((r.id, r.found, r.mode))
    # a's fifth word is in one document only; b has no document with all words; c is too short for any of them
    assert got == {"a": [(2, 5, "and")], "b": [(2, 5, "or"), (1, 4, "or")], "d": [(5, 1, "or"), (4, 1, "or")]}


def test_registered_search_uses_whole_items(spark, sf):
    from palimpsest.plans import catalog

    texts = {r.item_id: set(r.text.lower().split()) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()}
    got = catalog.QUERIES["full_text_search"](spark, sf).collect()
    assert {r.item_id for r in got} == set(texts)
    assert all(r.found == len(texts[r.item_id]) for r in got if r["mode"] == "and")
    assert max(r["rank"] for r in got) == 5 and max(r.found for r in got) > 4


def test_bootstrap_bounds_are_sorted_places_and_null_if_mostly_undefined(spark):
    df = spark.createDataFrame([(i, i % 3 > 0, (i * 37 % 20) / 19) for i in range(40)], "id long, label boolean, p double")
    each = sorted(r.accuracy for r in metrics.bootstrap_accuracy(df, 1000).collect())
    got = metrics.bootstrap_interval(df, metrics.confusion, ["accuracy", "harmful_f1"]).orderBy("metric").collect()
    low = (1.0 - 0.95) / 2.0
    assert (got[0].metric, got[0].defined, got[0].lower, got[0].upper) == ("accuracy", 1000, each[int(low * 1000)], each[int((1.0 - low) * 1000) - 1])
    assert got[1].metric == "harmful_f1" and 0 < got[1].lower < got[1].upper < 1
    area = metrics.auroc(df).first().auroc
    assert metrics.bootstrap_interval(df, metrics.auroc, ["auroc"]).where(F.col("lower").between(0, area) & F.col("upper").between(area, 1)).count() == 1
    one_class = metrics.bootstrap_interval(df.where("label"), lambda d, by: metrics.auroc(d, by, None), ["auroc"]).first()
    assert (one_class.defined, one_class.lower, one_class.upper) == (0, None, None)


def test_components_of_a_hub(spark):
    from palimpsest.operators.graph import components

    edges = spark.range(1, 5000).selectExpr("id a", "0L b").unionByName(spark.range(5000, 5100).selectExpr("id a", "id + 1 b"))
    got = {r.node: r.component for r in components(edges).collect()}
    assert got == {**dict.fromkeys(range(5000), 0), **dict.fromkeys(range(5000, 5101), 5000)}


def test_checkpoint_folder(spark, monkeypatch):
    from palimpsest import cluster

    assert cluster.checkpoint_dir(spark) == cluster.checkpoint_dir(spark)

    class Context:
        master = "spark://host:7077"
        _jsc = type("J", (), {"sc": staticmethod(lambda: type("S", (), {"getCheckpointDir": staticmethod(lambda: type("O", (), {"isDefined": staticmethod(lambda: False)}))}))})

    class Session:
        sparkContext = Context
        conf = type("C", (), {"get": staticmethod(lambda name, default: default)})

    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        cluster.checkpoint_dir(Session)


def test_match_terms_by_brute_force(spark):
    docs = {1: "red blue green", 2: "blue RED", 3: "yellow", 4: "", 5: None}
    asked = {10: "red blue", 11: "red yellow blue", 12: "red black", 13: "none of these"}
    got = {(r.q, r.doc): (r.found, r["mode"]) for r in retrieval.match_terms(spark.createDataFrame(list(docs.items()), "doc long, text string"), spark.createDataFrame(list(asked.items()), "q long, ask string"), "doc", "text", "q", "ask").collect()}
    want = {}
    for q, a in asked.items():
        terms = set(a.split())
        found = {d: len(terms & set((t or "").lower().split())) for d, t in docs.items()}
        strict = [d for d, n in found.items() if n == len(terms)]
        want |= {(q, d): (found[d], "and") for d in strict} if strict else {(q, d): (n, "or") for d, n in found.items() if n and len(terms) >= 3}
    assert got == want


def test_manifest_of_many_groups(spark):
    import hashlib

    rows = [(f"g{k * 37 % 5000}", "eval" if k % 10 == 0 else "train") for k in range(5000)] + [("g1", "other")]
    got = sets.manifest(spark.createDataFrame(rows, "source string, split string").repartition(7), "source").first()
    split = {}
    for g, s in rows:
        split[g] = min(split.get(g, s), s)
    lines = sorted(f"{g}\t{s}\n" for g, s in split.items())
    assert (got.sha256, got.n_groups, got.n_mixed) == (hashlib.sha256("".join(lines).encode()).hexdigest(), 5000, 1)


def test_actions_and_prompts_are_cut(spark):
    from palimpsest.operators import pairs as P
    from palimpsest.operators import perturb

    base = spark.createDataFrame([(1, 1, "x" * 3000, 1.0), (1, 2, "y", 1.0)], "id long, step long, action string, reward double")
    other = spark.createDataFrame([(1, 1, "z", 2.0), (1, 2, "z", 1.0 + 1e-12)], "id long, step long, action string, reward double")
    assert [len(r.action) for r in P.reward_pairs(base, other, "id").orderBy("step").collect()] == [2000, 1]
    assert P.reward_pairs(base, other, "id", keep_zero=False).count() == 1
    out = perturb.rendered(conversation(spark, ("user", "w" * 30_000))).first()
    assert len(out.prompt) == 24_000 and out.truncated


def test_structural_window(spark):
    hops = [(f"q{k}", f"a{k}", f"t{k}", "some text") for k in range(4)]
    df = spark.createDataFrame([(1, "x", hops, [(None, "d0"), ("n", "d1")])], "id int, answer string, hops array<struct<question: string, answer: string, title: string, text: string>>, distractors array<struct<title: string, text: string>>")
    out = instances.structural(df).first()
    assert out.required == ["F1", "F2", "F3"] and out.files[0] == "--- t0 ---\nsome text\n\n--- Distractor 0 ---\nd0" and out.tokens == 10
    assert instances.structural(df, window=2).count() == 0
