"""Text queries over documents, pages, conversations and stated fixtures."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.functions import text as X
from palimpsest.plans.registry import query, table

WORDS = "list_filter(string_split(trim(regexp_replace({t}, '\\s+', ' ', 'g')), ' '), lambda w: w <> '')"
TERMS = "list_filter(list_transform(" + WORDS.format(t="lower({t})") + ", lambda w: regexp_replace(w, '^[^a-z0-9]+|[^a-z0-9]+$', '', 'g')), lambda w: length(w) > 4)"


@query(f"SELECT doc_id, length(text) // 4 AS chars_div_4, (len({WORDS.format(t='text')}) * 4) // 3 AS words_4_3, array_to_string(({WORDS.format(t='text')})[1:10], ' ') AS head FROM documents")
def token_estimates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", X.chars_div_4(F.col("text")).alias("chars_div_4"), X.words_4_3(F.col("text")).alias("words_4_3"), X.first_words(F.col("text"), 10).alias("head"))


@query("SELECT page_id, regexp_replace(html, '<[^>]+>', '', 'g') AS text, regexp_replace(regexp_replace(regexp_replace(url, '[?#].*$', ''), '^[A-Za-z][A-Za-z0-9+.-]*://[^/]*', ''), '/+$', '') AS path, regexp_extract(html, '<title>([^<]*)</title>', 1) AS title FROM pages")
def page_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", X.strip_tags(F.col("html")).alias("text"), X.url_path(F.col("url")).alias("path"), F.regexp_extract("html", "<title>([^<]*)</title>", 1).alias("title"))


@query(r"""SELECT item_id, trim(regexp_replace(regexp_replace(regexp_replace(text, '[^\p{L}\p{N}_\s]', ' ', 'g'), '\b(AND|OR|NOT|NEAR)\b', ' ', 'g'), '\s+', ' ', 'g')) AS fts, regexp_replace(lower(trim(text)), '\s+', ' ', 'g') AS normal,
  substr(sha1(trim(regexp_replace(regexp_replace(translate(lower(text), '""" + X.MARKED + "', '" + X.PLAIN + r"""'), '[^\p{L}\p{N}_\s]', '', 'g'), '\s+', ' ', 'g'))), 1, 16) AS title_hash FROM benchmark""")
def query_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = F.col("text")
    return table(spark, sf_dir, "benchmark").select("item_id", X.full_text_query(t).alias("fts"), X.normal(t).alias("normal"), X.title_hash(t).alias("title_hash"))


@query(f"WITH c AS (SELECT conv_id, string_agg(text, ' ' ORDER BY turn) FILTER (role = 'assistant') AS said, min_by(text, turn) AS first FROM conversations GROUP BY 1), q AS (SELECT conv_id, coalesce(said, '') AS said, {TERMS.format(t='first')} AS terms FROM c) SELECT conv_id, CASE WHEN len(terms) = 0 THEN 0.0 ELSE len(list_filter(terms, lambda t: contains(lower(said), t))) / len(terms) END::DOUBLE AS recall FROM q")
def keyword_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Share of the first message's terms that the assistant mentions."""
    c = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.when(F.col("role") == "assistant", F.struct("turn", "text")))).alias("t"), F.min_by("text", "turn").alias("first"))
    said = F.concat_ws(" ", F.transform("t", lambda x: x["text"]))
    return c.select("conv_id", X.recall(X.terms(F.col("first")), said).alias("recall"))


@query(
    f"SELECT doc_id, regexp_replace(regexp_replace(regexp_replace(text, '{X.PATHS}', '<REDACTED_PATH>', 'g'), '{X.ERRORS}', '<REDACTED_ERROR>', 'g'), '{X.FUNCTIONS}', '<REDACTED_FUNC>', 'g') AS redacted, "
    f"regexp_replace(regexp_replace(regexp_replace(text, '{X.PATHS}', '___', 'g'), '{X.ERRORS}', '___', 'g'), '{X.LINES}', '', 'g') AS without FROM documents"
)
def redaction(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = F.col("text")
    return table(spark, sf_dir, "documents").select("doc_id", X.redacted(t).alias("redacted"), X.without_attributes(t).alias("without"))


PATCH = "--- a/x.py\n+++ b/x.py\n@@ -1,2 +1,3 @@ def f\n line\n-old()\n+new()\n+more\n--- a/y.py\n+++ b/y.py\n@@ -5 +6 @@\n+z"
BACK = "+++ b/x.py\n--- a/x.py\n@@ -1,3 +1,2 @@ def f\n line\n+old()\n-new()\n-more\n+++ b/y.py\n--- a/y.py\n@@ -6 +5 @@\n-z"


def quoted(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


@query(f"SELECT 1 AS id, 3 AS added, 1 AS removed, 4 AS changed, 2 AS hunks, ['x.py', 'y.py'] AS files, {quoted(BACK)} AS back UNION ALL SELECT 2, 0, 0, 0, 0, [], ''")
def patches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A stated diff, and null: counts and the diff that takes it back."""
    rows = spark.createDataFrame([(1, PATCH), (2, None)], "id int, patch string")
    return rows.select("id", X.patch_counts(F.col("patch")).alias("p"), X.reversed_patch(F.col("patch")).alias("back")).select("id", "p.*", "back")


CASES = [
    (1, "ls -la", "ls   -LA", False), (2, "git status", "git status --short", False), (3, "cat a.py\nmore", "cat a.py\nother", False),
    (4, "grep x a", "grep x b", False), (5, "pytest -q", "rm -rf build", True), (6, "", "ls", False),
]


@query("SELECT * FROM (VALUES " + ", ".join(f"({i}, {str(d).lower()})" for i, _, _, d in CASES) + ") t(id, differ)")
def action_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.createDataFrame([c[:3] for c in CASES], "id int, a string, b string")
    return rows.select("id", X.actions_differ(F.col("a"), F.col("b")).alias("differ"))


@query("SELECT * FROM (VALUES (1, 'answer', 'ls -a', '{\"a\": 1}'), (2, 'x', 'plain', NULL), (3, '', '<think>open', NULL)) t(id, said, command, json)")
def responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Thinking taken out, commands and JSON taken from fences."""
    rows = [(1, "<think>a\nb</think> answer", "so:\n```bash\nls -a\n```", "x ```json\n{\"a\": 1}\n``` y"), (2, "x<think>", "plain", "none"), (3, "<think>open", "<think>open", None)]
    df = spark.createDataFrame(rows, "id int, s string, c string, j string")
    return df.select("id", X.strip_thinking(F.col("s")).alias("said"), X.fenced_command(F.col("c")).alias("command"), X.fenced_json(F.col("j")).alias("json"))


@query(f"""WITH t AS (SELECT doc_id, substr(text, 1, 40) AS title FROM documents) SELECT doc_id, CASE doc_id % 6 WHEN 0 THEN 'doi:10.1/x' || doc_id WHEN 1 THEN 'arxiv:2101.' || doc_id WHEN 2 THEN 's:' || doc_id WHEN 3 THEN 'url:http://x/' || doc_id
ELSE CASE WHEN trim(title) <> '' THEN 'title:' || substr(sha1(trim(regexp_replace(regexp_replace(translate(lower(title), '{X.MARKED}', '{X.PLAIN}'), '[^\\p{{L}}\\p{{N}}_\\s]', '', 'g'), '\\s+', ' ', 'g'))), 1, 16) ELSE 'unknown' END END AS paper FROM t""")
def paper_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that have a doi, an arXiv number with a version, a source's id, a url, or the beginning of their text as a title only."""
    k, ident = F.col("doc_id") % 6, F.col("doc_id").cast("string")
    doi = F.when(k == 0, F.concat(F.lit(" 10.1/X"), ident)).otherwise("")
    arxiv = F.when(k == 1, F.concat(F.lit("2101."), ident, F.lit("v3")))
    return table(spark, sf_dir, "documents").select("doc_id", X.paper_id(doi, arxiv, F.lit("s"), F.when(k == 2, ident), F.when(k == 3, F.concat(F.lit("http://x/"), ident)), F.substring("text", 1, 40)).alias("paper"))


@query("SELECT * FROM (VALUES (1, ['a', 'b']), (2, ['a', 'b']), (3, [])) t(id, tests)")
def test_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = spark.createDataFrame([(1, '["a", "b"]'), (2, " a  b "), (3, "")], "id int, t string")
    return df.select("id", X.test_list(F.col("t")).alias("tests"))


@query("WITH e AS (SELECT event_id, string_split(regexp_replace(props, '[^0-9]', '', 'g'), '') AS d FROM events) SELECT event_id, CASE WHEN list_contains(d, '7') THEN list_position(d, '7') - 1 ELSE -1 END AS place FROM e")
def subsequence_place(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where the digits of an event's properties hold a 7."""
    d = F.filter(F.split(F.regexp_replace("props", "[^0-9]", ""), ""), lambda x: x != "")
    return table(spark, sf_dir, "events").select("event_id", X.find_sub(d, F.array(F.lit("7"))).alias("place"))


TREE = "[1] link 'Home'\n[2] button 'Go'\n[3] button 'Go'"
NEWER = "[4] link 'Home'\n[7] button 'Go'\n[9] button 'Stop'\n[8] button 'Go'"


@query("SELECT * FROM (VALUES ('1', '4', 'link'), ('2', '7', 'button'), ('3', '8', 'button')) t(old_id, new_id, role)")
def element_translation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of an accessibility tree in a newer one: the n-th of equal role and name."""
    from palimpsest.operators.pairs import occurrences

    trees = spark.createDataFrame([(1, TREE, NEWER)], "id int, old string, new string")
    side = lambda c: trees.select("id", F.posexplode(X.elements(F.col(c))).alias("pos", "e")).select("id", "pos", F.col("e.id").alias("ident"), "e.role", "e.name")
    return occurrences(side("old"), side("new"), ["role", "name"], "pos", "ident", ["id"]).select("old_id", "new_id", "role")


@query("SELECT * FROM (VALUES (1, 'rc=0|ran in Xs at 0xADDR pid=N', false), (2, 'rc=?|x y', true), (3, 'rc=?|', true)) t(id, seen, differ)")
def observation_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Observations without what changes from run to run, and whether two differ."""
    rows = [(1, "<returncode>0</returncode>\n<output>\nran in 1.5s at 0xFF\n pid=42\n</output>", "<returncode>0</returncode><output>ran in 2.25s at 0xA  pid=7</output>"), (2, " x\n\ny ", "x z"), (3, "", "")]
    df = spark.createDataFrame(rows, "id int, a string, b string")
    return df.select("id", X.plain_observation(F.col("a")).alias("seen"), X.observations_differ(F.col("a"), F.col("b")).alias("differ"))


@query("SELECT * FROM (VALUES (1, 'naive', 32000, 'hard'), (2, 'plain', 500, 'easy'), (3, 'x_both_', NULL, 'medium'), (4, 'a', 7, 'medium')) t(id, strategy, tokens, difficulty)")
def run_settings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Strategies of run names, presets of token targets, difficulty in a long context."""
    from palimpsest.operators.quality import difficulty_in_context

    rows = [(1, "t_both_naive_phase1_v2", " 32K ", "medium", 200_000), (2, "plain", "500", "easy", 200_000), (3, "x_both_", "many", "medium", 100_000), (4, "r_both_a_T2_b_v1", "7", "medium", None)]
    df = spark.createDataFrame(rows, "id int, run string, target string, given string, n long")
    return df.select("id", X.strategy_of_run(F.col("run")).alias("strategy"), X.target_tokens(F.col("target"), {"32k": 32_000}).alias("tokens"), difficulty_in_context(F.col("given"), F.coalesce("n", F.lit(0))).alias("difficulty"))


@query("SELECT * FROM (VALUES (1, 1.5::DOUBLE), (2, 0.5), (3, 0.0)) t(id, recall)")
def note_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Facts in notes; the last one lifts the first row above 1."""
    rows = [
        (1, "Paris hosts museum rivers tower", [("the museum, Paris!", "tower"), ("rivers", None)]), (2, "alpha beta", [("alpha", None), ("gamma delta", "")]), (3, "x", []),
    ]
    df = spark.createDataFrame(rows, "id int, notes string, facts array<struct<content: string, intermediate: string>>")
    return df.select("id", X.note_recall(F.col("notes"), F.col("facts")).alias("recall"))


@query("SELECT * FROM (VALUES (1, 'go' || chr(10) || 'f(a=1, b=2)', true, false, 'ab' || chr(10) || '... [2 characters dropped]')) t(id, action, url, same, file)")
def recorded_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Actions with sorted arguments, observations by axis, capped files."""
    row = [(1, " go ", [("f", {"b": "2", "a": "1"})], ("http://h/p?q", "T", "x  y"), ("https://g/p/", "t", "x z"), [("n", "abcd")])]
    kind = "id int, c string, calls array<struct<name: string, arguments: map<string, string>>>, a struct<url: string, title: string, tree: string>, b struct<url: string, title: string, tree: string>, f array<struct<name: string, content: string>>"
    df = spark.createDataFrame(row, kind).withColumn("e", X.observations_equal(F.col("a"), F.col("b")))
    return df.select("id", X.action_text(F.col("c"), F.col("calls")).alias("action"), "e.url", F.col("e.all").alias("same"), F.get(X.capped_files(F.col("f"), 2), F.lit(0))["content"].alias("file"))
