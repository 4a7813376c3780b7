"""Column functions over texts: counts, cleaning, identifiers, patches, actions, redaction and keys."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def space_words(c: Column) -> Column:
    """Words between white space."""
    return F.filter(F.split(F.trim(F.regexp_replace(c, r"\s+", " ")), " "), lambda w: w != "")


def chars_div_4(c: Column) -> Column:
    return F.floor(F.length(c) / 4).cast("long")


def words_4_3(c: Column) -> Column:
    return F.floor(F.size(space_words(c)) * 4 / 3).cast("long")


def first_words(c: Column, n: int) -> Column:
    return F.concat_ws(" ", F.slice(space_words(c), 1, n))


def strip_tags(c: Column) -> Column:
    return F.regexp_replace(c, "<[^>]+>", "")


def strip_thinking(c: Column) -> Column:
    """Without think blocks, and without what follows one that stays open."""
    return F.trim(F.regexp_replace(F.regexp_replace(c, r"(?s)<think>.*?</think>\s*", ""), r"(?s)<think>.*\z", ""))


def full_text_query(c: Column) -> Column:
    """Word characters only, no operators, single spaces."""
    plain = F.regexp_replace(c, r"[^\p{L}\p{N}_\s]", " ")
    return F.trim(F.regexp_replace(F.regexp_replace(plain, r"\b(AND|OR|NOT|NEAR)\b", " "), r"\s+", " "))


def normal(c: Column) -> Column:
    return F.regexp_replace(F.lower(F.trim(c)), r"\s+", " ")


#: Letters with marks, and the letters without.
MARKED = "àáâãäåçèéêëìíîïñòóôõöùúûüýÿ"
PLAIN = "aaaaaaceeeeiiiinooooouuuuyy"


def title_key(c: Column) -> Column:
    """Lower-cased, without marks and punctuation, single spaces."""
    low = F.translate(F.lower(c), MARKED, PLAIN)
    return F.trim(F.regexp_replace(F.regexp_replace(low, r"[^\p{L}\p{N}_\s]", ""), r"\s+", " "))


def title_hash(c: Column) -> Column:
    return F.substring(F.sha1(title_key(c)), 1, 16)


def paper_id(doi: Column, arxiv: Column, source: Column, ident: Column, url: Column, title: Column) -> Column:
    """The first key there is: doi, arXiv number without its version, source and id, url, hash of the title."""
    given = lambda c: F.nullif(F.trim(c), F.lit(""))
    tag = lambda name, c: F.concat(F.lit(f"{name}:"), c)
    return F.coalesce(
        tag("doi", F.lower(given(doi))), tag("arxiv", F.regexp_replace(given(arxiv), r"v\d+$", "")), F.concat(source, F.lit(":"), given(ident)),
        tag("url", given(url)), F.when(given(title).isNotNull(), tag("title", title_hash(title))), F.lit("unknown"),
    )


def url_path(c: Column) -> Column:
    """The path of a url, without query, fragment and slashes at the end."""
    bare = F.regexp_replace(F.regexp_replace(c, r"[?#].*$", ""), r"^[A-Za-z][A-Za-z0-9+.-]*://[^/]*", "")
    return F.regexp_replace(bare, "/+$", "")


def identifiers(c: Column, least: int = 4) -> Column:
    """Distinct identifiers (letters, digits, _ and .) of so many characters at least, in order."""
    return F.array_distinct(F.regexp_extract_all(c, F.lit(f"([A-Za-z_][A-Za-z0-9_.]{{{least - 1},}})"), 1))


def terms(c: Column, longer: int = 4) -> Column:
    """Lower-cased words without punctuation around them, longer than so many characters; not distinct."""
    words = F.transform(space_words(F.lower(c)), lambda w: F.regexp_replace(w, r"^[^a-z0-9]+|[^a-z0-9]+$", ""))
    return F.filter(words, lambda w: F.length(w) > longer)


def recall(words: Column, text: Column) -> Column:
    """Share of terms that are substrings of a text; 0 if there are none."""
    found = F.filter(words, lambda w: F.contains(F.lower(text), w))
    return F.when(F.size(words) == 0, F.lit(0.0)).otherwise(F.size(found) / F.size(words))


def lines(c: Column) -> Column:
    return F.split(F.coalesce(c, F.lit("")), "\n")


def patch_counts(c: Column) -> Column:
    """Lines added, removed and changed, hunks and files of a unified diff."""
    added = F.size(F.filter(lines(c), lambda x: F.startswith(x, F.lit("+")) & ~F.startswith(x, F.lit("+++"))))
    removed = F.size(F.filter(lines(c), lambda x: F.startswith(x, F.lit("-")) & ~F.startswith(x, F.lit("---"))))
    return F.struct(added.alias("added"), removed.alias("removed"), (added + removed).alias("changed"), hunks(c).alias("hunks"), patch_files(c).alias("files"))


def hunks(c: Column) -> Column:
    return F.size(F.filter(lines(c), lambda x: F.regexp_like(x, F.lit(r"^@@\s"))))


def patch_files(c: Column) -> Column:
    """Distinct files of a diff, in order."""
    heads = F.transform(lines(c), lambda x: F.regexp_extract(x, r"^(?:\+\+\+ b|--- a)/(\S+)", 1))
    return F.array_distinct(F.filter(heads, lambda x: x != ""))


def reversed_patch(c: Column) -> Column:
    """The diff that takes a diff back."""
    hunk = r"^@@ -(\S+) \+(\S+) @@(.*)$"

    def one(x: Column) -> Column:
        rest = F.substr(x, F.lit(2))
        return (
            F.when(F.startswith(x, F.lit("--- a/")), F.concat(F.lit("+++ b/"), F.substr(x, F.lit(7)))).when(F.startswith(x, F.lit("+++ b/")), F.concat(F.lit("--- a/"), F.substr(x, F.lit(7))))
            .when(F.regexp_like(x, F.lit(hunk)), F.regexp_replace(x, hunk, "@@ -$2 +$1 @@$3"))
            .when(F.startswith(x, F.lit("+")), F.concat(F.lit("-"), rest)).when(F.startswith(x, F.lit("-")), F.concat(F.lit("+"), rest)).otherwise(x)
        )

    return F.concat_ws("\n", F.transform(lines(c), one))


def fenced_command(c: Column) -> Column:
    """The first fenced shell block, or the whole text."""
    found = F.regexp_extract(c, r"(?s)```(?:bash|sh)?\n\s*(.*?)\s*```", 1)
    return F.when(found != "", found).otherwise(F.trim(c))


def fenced_json(c: Column) -> Column:
    """The JSON object of a text, fenced or bare; null if there is none."""
    fenced = F.regexp_extract(c, r"(?s)```(?:json)?\s*(\{.*?\})\s*```", 1)
    bare = F.regexp_extract(c, r"(?s)(\{.*\})", 1)
    return F.nullif(F.when(fenced != "", fenced).otherwise(bare), F.lit(""))


def actions_differ(a: Column, b: Column) -> Column:
    """Whether two actions differ: not if one is blank, they are equal, one holds the other, or first lines or first two words agree."""
    x, y = normal(a), normal(b)
    first = lambda c: F.trim(F.substring_index(F.trim(F.lower(c)), "\n", 1))
    two = lambda c: F.slice(F.split(c, " "), 1, 2)
    same = (x == y) | F.contains(x, y) | F.contains(y, x) | (first(a) == first(b)) | ((F.size(two(x)) == 2) & (two(x) == two(y)))
    return ~((x == "") | (y == "") | same)


def plain_observation(c: Column, most: int = 2000) -> Column:
    """The return code, and the output without times, addresses, process numbers and repeated space, cut."""
    code = F.nullif(F.regexp_extract(c, r"<returncode>(\d+)</returncode>", 1), F.lit(""))
    out = F.when(F.regexp_like(c, F.lit(r"(?s)<output>.*?</output>")), F.regexp_extract(c, r"(?s)<output>(.*?)</output>", 1)).otherwise(c)
    out = F.regexp_replace(out, r"^\s+|\s+$", "")
    for pattern, to in ((r"\d+\.\d+s", "Xs"), (r"0x[0-9a-fA-F]+", "0xADDR"), (r"pid=\d+", "pid=N"), (r"\s+", " ")):
        out = F.regexp_replace(out, pattern, to)
    return F.concat(F.lit("rc="), F.coalesce(code, F.lit("?")), F.lit("|"), F.substring(out, 1, most))


def observations_differ(a: Column, b: Column) -> Column:
    """Whether two observations differ in code or output; yes if one is empty."""
    empty = (F.coalesce(a, F.lit("")) == "") | (F.coalesce(b, F.lit("")) == "")
    return empty | (plain_observation(a) != plain_observation(b))


# What redaction looks for.
PATHS = r"/(?:testbed|home|opt|usr|tmp)[\w/\-\.]+\.(?:py|js|ts|json|yaml|yml|cfg|ini|txt|md|rst)"
ERRORS = r"(?:Error|Exception|Traceback|FAILED|AssertionError|TypeError|ValueError|KeyError|AttributeError|ImportError)[^\n]{0,200}"
FUNCTIONS = r"(?:def |class |function )\w+"
LINES = r"(?:line |:)\d+"


def redacted(c: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(c, PATHS, "<REDACTED_PATH>"), ERRORS, "<REDACTED_ERROR>"), FUNCTIONS, "<REDACTED_FUNC>")


def without_attributes(c: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(c, PATHS, "___"), ERRORS, "___"), LINES, "")


def source_model(c: Column) -> Column:
    """The family before the first underscore."""
    head = F.lower(F.substring_index(c, "_", 1))
    return F.when(F.startswith(head, F.lit("haiku")), "haiku").when(F.startswith(head, F.lit("gpt")), "gptoss").when(F.startswith(head, F.lit("sonnet")), "sonnet").otherwise(head)


def test_list(c: Column) -> Column:
    """A JSON array or words between white space."""
    return F.when(F.startswith(F.trim(c), F.lit("[")), F.from_json(c, "array<string>")).otherwise(space_words(c))


def find_sub(whole: Column, part: Column) -> Column:
    """First place (from 0) at which an array holds another; -1 if it doesn't."""
    n = F.size(part)
    at = F.filter(F.sequence(F.lit(0), F.greatest(F.size(whole) - n, F.lit(0))), lambda i: F.slice(whole, i + 1, n) == part)
    return F.when(n == 0, 0).when(F.size(whole) < n, -1).otherwise(F.coalesce(F.get(at, F.lit(0)), F.lit(-1)))


def elements(c: Column) -> Column:
    """Array of (id, role, name) of an accessibility tree's lines."""
    pattern = F.lit(r"\[(\d+)\] (\w+) '([^']*)'")
    return F.arrays_zip(*[F.regexp_extract_all(c, pattern, i).alias(n) for i, n in ((1, "id"), (2, "role"), (3, "name"))])


#: Where a run's name stops to be its strategy's, in order.
CUTS = ("_HP_", "_T2_", "_T3_", "_phase", "_v")


def strategy_of_run(c: Column) -> Column:
    """What follows _both_, up to the first of the cuts that is there."""
    tail = F.when(F.contains(c, F.lit("_both_")), F.regexp_extract(c, "(?s)_both_(.*)$", 1))
    cases = None
    for cut in CUTS:
        at = F.instr(tail, F.lit(cut))
        cases = (F if cases is None else cases).when(at > 1, F.substr(tail, F.lit(1), at - 1))
    return F.coalesce(F.nullif(cases.otherwise(tail), F.lit("")), c)


def target_tokens(c: Column, presets: dict[str, int]) -> Column:
    """A preset's number or a number; null for anything else."""
    named = F.create_map(*[F.lit(x) for kv in presets.items() for x in kv]) if presets else F.lit(None)
    return F.coalesce(F.try_element_at(named, F.lower(F.trim(c))), F.trim(c).try_cast("int"))


def capped_files(files: Column, most: int = 8000) -> Column:
    """Array of (name, content): contents cut, with a note of how many characters went."""
    note = lambda n: F.concat(F.lit("\n... ["), n.cast("string"), F.lit(" characters dropped]"))
    return F.transform(files, lambda f: F.struct(f["name"].alias("name"), F.when(F.length(f["content"]) > most, F.concat(F.substring(f["content"], 1, most), note(F.length(f["content"]) - most))).otherwise(f["content"]).alias("content")))


def note_recall(notes: Column, facts: Column) -> Column:
    """Facts (content, intermediate) that notes hold, over their number: one for .4 of a fact's words of more than four characters, one for its
    intermediate answer; only the second kind is capped at the number of facts, so a later fact can lift the ratio above 1."""
    low = F.lower(notes)
    n = F.size(facts)
    bare = lambda w: F.regexp_replace(w, "^[.,!?\"'()]+|[.,!?\"'()]+$", "")

    def step(a: Column, f: Column) -> Column:
        every = F.filter(F.split(F.lower(f["content"]), r"\s+"), lambda w: w != "")
        long = F.filter(F.transform(every, bare), lambda w: F.length(w) > 4)
        words = F.when(F.size(long) > 0, long).otherwise(every)
        found = F.size(F.filter(words, lambda w: F.contains(low, w)))
        first = a + F.when((F.size(words) > 0) & (found >= 0.4 * F.size(words)), 1).otherwise(0)
        said = F.coalesce(f["intermediate"], F.lit(""))
        return F.when((said != "") & F.contains(low, F.lower(said)), F.least(first + 1, n)).otherwise(first)

    return F.when(n == 0, F.lit(0.0)).otherwise(F.aggregate(facts, F.lit(0), step) / n)


def action_text(content: Column, calls: Column) -> Column:
    """An action as its content and its calls (name, arguments map) with sorted keys."""
    ordered = F.transform(calls, lambda c: F.concat(c["name"], F.lit("("), F.concat_ws(", ", F.transform(F.array_sort(F.map_entries(c["arguments"])), lambda e: F.concat(e["key"], F.lit("="), e["value"]))), F.lit(")")))
    return F.concat_ws("\n", F.nullif(F.trim(content), F.lit("")), F.concat_ws("\n", ordered))


def observations_equal(recorded: Column, live: Column) -> Column:
    """Equality by axis (url, title, tree) of two observations, and of all."""
    url = url_path(recorded["url"]).eqNullSafe(url_path(live["url"]))
    title = normal(recorded["title"]).eqNullSafe(normal(live["title"]))
    tree = normal(recorded["tree"]).eqNullSafe(normal(live["tree"]))
    return F.struct(url.alias("url"), title.alias("title"), tree.alias("tree"), (url & title & tree).alias("all"))
