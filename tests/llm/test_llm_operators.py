"""The training-data operators on odd rows: nulls, empty and very long texts, ties, repeated rows, empty tables, clashing columns."""

import base64
import hashlib
import random
import re
import zlib

import pytest
from pyspark.sql import functions as F

from palimpsest.llm import bpe, chat, decontam, gif, langid, partenum, queries, substring, token_counts, url_filter, warc

LOW = str.maketrans({chr(65 + i): chr(97 + i) for i in range(26)})
RNG = random.Random(5)
VOCABULARY = ["".join(RNG.choice("abcdefgh") for _ in range(RNG.randint(1, 7))) for _ in range(400)]


def prose(n, rng):
    return " ".join(rng.choice(VOCABULARY) for _ in range(n))


def corpus():
    """(doc_id, text) with copies, near copies, shared passages and odd texts."""
    rng = random.Random(11)
    base, passage = prose(180, rng), prose(70, rng)
    texts = [prose(rng.randint(1, 200), rng) for _ in range(30)]
    texts += [base, base, base.upper(), base + " tail", " ".join(base.split()[:-1])]
    for k in range(12):
        words = base.split()
        for _ in range(k % 4 + 1):
            words[rng.randrange(len(words))] = "changed%d" % rng.randrange(999)
        texts.append(" ".join(words))
    texts += [f"{prose(20, rng)} {passage}\n{prose(15, rng)}" for _ in range(6)]
    texts += ["", None, " \t\n", "one", "One", "two words", "two  words", "x", "é ü", "word " * 400, "a\u00a0b c", prose(4000, rng), "z" * 20_000, "日本語 テキスト"]
    return list(enumerate(texts))


@pytest.fixture(scope="module")
def docs(spark):
    rows = corpus()
    clash = "doc_id long, text string, lang string, n_words long, size long, ids string, media string, score string, path string, edits string"
    return spark.createDataFrame([(i, t, "xy"[i % 2], 1, 2, "3", "4", "5", "6", "7") for i, t in rows], clash).repartition(3)


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def by_id(df, key="doc_id"):
    return {r[key]: r for r in df.collect()}


@pytest.mark.parametrize("hot", [substring.HOT, 150])
def test_substring(docs, hot):
    got = by_id(substring.remove_repeats(docs, hot=hot))
    lists = {i: words(t) for i, t in corpus()}
    first = {}
    for i, w in sorted(lists.items()):
        for k in range(len(w) - 49):
            first.setdefault(tuple(w[k : k + 50]), i)
    for i, w in lists.items():
        gone = {p for k in range(len(w) - 49) if first[tuple(w[k : k + 50])] < i for p in range(k, k + 50)}
        assert (got[i].n_words, got[i].n_removed, got[i].kept_text) == (len(w), len(gone), " ".join(x for p, x in enumerate(w) if p not in gone))
    assert len(got) == len(lists)


def test_substring_null_keys_and_repeated_rows(spark):
    t = " ".join(map(str, range(60)))
    df = spark.createDataFrame([(None, t), (1, t), (1, t), (2, t)], "doc_id long, text string")
    assert sorted((r.doc_id or 0, r.n_removed) for r in substring.remove_repeats(df).collect()) == [(0, 0), (1, 0), (1, 0), (2, 60)]


@pytest.mark.parametrize(("n", "percent", "block"), [(3, 90, partenum.BLOCK), (5, 80, partenum.BLOCK), (3, 90, 400), (2, 50, 2000)])
def test_jaccard(docs, n, percent, block):
    got = by_id(partenum.jaccard_components(docs, n=n, percent=percent, block=block))
    sets = {}
    for i, t in corpus():
        w = words((t or "").translate(LOW))
        sets[i] = {tuple(w[k : k + n]) for k in range(max(1, len(w) - n + 1))} if w else set()
    root, links = {i: i for i in sets}, dict.fromkeys(sets, 0)

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in sets:
        for j in range(i):
            if sets[i] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j]):
                links[i] += 1
                links[j] += 1
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    assert {i: (r.n_shingles, r.component_id, r.n_links) for i, r in got.items()} == {i: (len(s), find(i), links[i]) for i, s in sets.items()}


@pytest.mark.parametrize("bound", [decontam.BOUND, 50])
def test_decontamination(spark, docs, bound):
    rows = dict(corpus())
    items = [(0, " ".join(rows[30].split()[20:45])), (1, "one"), (2, None), (3, ""), (4, "Two, WORDS!"), (5, rows[3]), (5, rows[3]), (None, "x"), (6, "日本語 テキスト"), (7, "word " * 12)]
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = by_id(decontam.contamination(docs, bench, bound=bound))
    split = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate(LOW))
    windows = {}
    for i, t in items:
        w = split(t)
        for k in range(max(1, len(w) - 9) if w and i is not None else 0):
            windows.setdefault(tuple(w[k : k + 10]), set()).add(i)
    for i, t in rows.items():
        w, hit, found = split(t), set(), set()
        for n in {len(x) for x in windows}:
            for k in range(len(w) - n + 1):
                if owners := windows.get(tuple(w[k : k + n])):
                    found |= owners
                    hit |= set(range(k, k + n))
        assert (got[i].n_words, got[i].n_hit, sorted(got[i]["items"])) == (len(w), len(hit), sorted(found)), t
    assert all(r.n_hit == 0 for r in decontam.contamination(docs, bench.where("false"), bound=bound).collect())


def tiktoken_encode(text):
    import tiktoken

    path, pattern = queries.tokenizer()
    with open(path, "rb") as f:
        ranks = bpe.parse_ranks(f.read())
    return tiktoken.Encoding("test", pat_str=pattern, mergeable_ranks=ranks, special_tokens={}).encode_ordinary(text)


ODD = ["a  b", " lead", "trail ", "\n\nx\n y", "it's we'll 'S", "x\u2003y\u00a0z", "\x1c a\x1cb", "1234567 89", "ab" * 300, "aaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaa", "€" * 100, "😀 ok\r\n\tfine", "<|endoftext|>", "a\nb", "x\n"]


def test_bpe_as_the_library(spark, docs):
    import numpy as np

    rows = corpus() + list(enumerate(ODD, 1000))
    df = docs.select("doc_id", "text", "ids").unionByName(spark.createDataFrame(list(enumerate(ODD, 1000)), "doc_id long, text string").withColumn("ids", F.lit("")))
    got = by_id(bpe.digests(df, *queries.tokenizer()))
    back = by_id(bpe.decode(bpe.encode(df, *queries.tokenizer()), *queries.tokenizer()))
    for i, t in rows:
        want = tiktoken_encode(t or "")
        assert back[i].ids == want and bytes(back[i].decoded) == (t or "").encode(), t
        assert got[i].n_tokens == len(want)
        assert got[i].ids_sha256 == hashlib.sha256(np.array(want, "<u4").tobytes()).hexdigest()
        assert got[i].decoded_sha256 == hashlib.sha256((t or "").encode()).hexdigest()
    assert bpe.digests(docs.where("false"), *queries.tokenizer()).count() == 0


def test_bpe_rejects_unknown_ids(spark):
    with pytest.raises(Exception, match="not in the vocabulary"):
        bpe.decode(spark.createDataFrame([([999_999],)], "ids array<int>"), *queries.tokenizer()).collect()


def token_coder():
    path, pattern = queries.tokenizer()
    with open(path, "rb") as f:
        return token_counts.coder(f.read(), pattern)


def test_token_tree_against_full_counts():
    coder = token_coder()
    rng = random.Random(2)
    for start in ["", "x", prose(300, rng), "no-spaces" * 200, " \n ".join(ODD), prose(2000, rng).replace("a ", "a\n")]:
        tree, text = token_counts.TokenTree(coder, start), start
        for k in range(80):
            at, drop = rng.randint(0, len(text) + 3), rng.choice([0, 0, 1, 5, 60, 400])
            insert = rng.choice(["", " ", "\n", "x", " word", "'ll", "12", prose(30, rng), " a b ", "\n\n", "\u00a0"])
            tree.edit(at, drop, insert)
            text = text[:at] + insert + text[at + drop :]
            words = coder.split(text)
            chars, counts = tree.state()
            assert (tree.text, tree.length, tree.tokens) == (text, len(text), sum(coder.counts(words)))
            assert (chars.tolist(), counts.tolist()) == ([len(w) for w in words], coder.counts(words))
            if k % 9 == 0:
                tree = token_counts.TokenTree(coder, tree.text, chars, counts)
                assert tree.encoded == 0
    tree = token_counts.TokenTree(coder, prose(50_000, rng))
    tree.encoded = 0
    tree.edit(100_000, 10, "changed here")
    assert tree.encoded < 100


def test_token_counts_with_an_edit_table(spark, docs, tmp_path):
    """Two batches of edits, one after the other, on states that were stored in between."""
    edits = spark.createDataFrame([(0, 2, 0, 1, "b"), (0, 1, 0, 0, "a "), (999, 1, 0, 0, "z"), (1, 1, 5, 10**9, None)], "doc_id long, seq long, at long, drop long, insert string")
    token_counts.trees(docs, *queries.tokenizer()).write.parquet(str(tmp_path / "0"))
    token_counts.edited(token_counts.with_edits(spark.read.parquet(str(tmp_path / "0")), edits), *queries.tokenizer()).write.parquet(str(tmp_path / "1"))
    more = F.expr("array(named_struct('at', 3L, 'drop', 0L, 'insert', '!'), null)")
    got = by_id(token_counts.edited(spark.read.parquet(str(tmp_path / "1")).withColumn("edits", more), *queries.tokenizer()))
    middle = by_id(spark.read.parquet(str(tmp_path / "1")))
    rows = dict(corpus())
    want = {i: t or "" for i, t in rows.items()}
    want[0] = "b" + ("a " + want[0])[1:]
    want[1] = want[1][:5]
    assert len(got) == len(rows)
    for i, t in want.items():
        assert (middle[i].text, middle[i].n_tokens, middle[i].n_tokens_after) == (t, len(tiktoken_encode(rows[i] or "")), len(tiktoken_encode(t)))
        last = t[:3] + "!" + t[3:]
        assert (got[i].text, got[i].n_tokens, got[i].n_tokens_after, sum(got[i].counts)) == (last, len(tiktoken_encode(t)), *[len(tiktoken_encode(last))] * 2)
    assert token_counts.edited(token_counts.trees(docs.where("false"), *queries.tokenizer()).withColumn("edits", more), *queries.tokenizer()).count() == 0


def test_token_counts_query_by_brute_force(spark, sf):
    got = by_id(queries.op3_token_counts(spark, sf))
    for r in spark.read.parquet(f"{sf}/documents.parquet").collect():
        text = t = r.text or ""
        for at, drop, insert in ((len(t) // 3, 0, " some words put in"), (len(t) // 2, 12, "'ll be\n\n  replaced 2024"), (len(t) * 2 // 3, 40, "")):
            text = text[:at] + insert + text[at + drop :]
        row = got[r.doc_id]
        assert (row.n_tokens, row.n_tokens_after, row.n_chars_after, row.text_after_sha256) == (len(tiktoken_encode(t)), len(tiktoken_encode(text)), len(text), hashlib.sha256(text.encode()).hexdigest())


def test_gif_round_trip(docs):
    got = by_id(gif.document_media(docs))
    for i, t in corpus():
        b = (t or "").encode()
        p = b + bytes(-len(b) % 64 or (0 if b else 64))
        assert (got[i].n_bytes, got[i].payload_bytes, got[i].payload_sha256, got[i].tail_crc32) == (len(b), len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-64:])), t
    assert got[30].media_sha256 == got[31].media_sha256 and got[30].feature == got[31].feature


def compressed(samples, least, clears=True, first=True):
    """A plain LZW encoder, with codes that widen; clears: also when the table is full; first: also at the start."""
    clear, stop = 1 << least, (1 << least) + 1
    bits, have, out = 0, 0, bytearray()
    table, width, now = {bytes([i]): i for i in range(clear)}, least + 1, b""

    def put(code):
        nonlocal bits, have
        bits |= code << have
        have += width
        while have >= 8:
            out.append(bits & 255)
            bits >>= 8
            have -= 8

    if first:
        put(clear)
    for s in samples:
        if now + bytes([s]) in table:
            now += bytes([s])
            continue
        put(table[now])
        if len(table) + 2 < 4096:
            table[now + bytes([s])] = len(table) + 2
            if len(table) + 2 > 1 << width:
                width += 1
        elif clears:
            put(clear)
            table, width = {bytes([i]): i for i in range(clear)}, least + 1
        now = bytes([s])
    put(table[now])
    put(stop)
    if have:
        out.append(bits & 255)
    return bytes(out)


@pytest.mark.parametrize("least", [2, 4, 8])
def test_lzw_of_widening_codes(least):
    import numpy as np

    rng = random.Random(least)
    samples = bytes(rng.choice([0, 1, 1, (1 << least) - 1]) if k % 50 else rng.randrange(1 << least) for k in range(30_000))
    assert gif.lzw(compressed(samples, least), least, len(samples)).tobytes() == samples
    short = np.frombuffer(samples, np.uint8)[: gif.ROWS * gif.WIDTH]
    codes = gif.codes_of([short, short[:1], short[:77]])
    assert [gif.lzw(gif.packed(c), 8, len(s)).tobytes() for c, s in zip(codes, (short, short[:1], short[:77]), strict=True)] == [bytes(short), bytes(short[:1]), bytes(short[:77])]
    assert gif.packed(codes[0]) == compressed(bytes(short), 8)
    frame = gif.Frame(0, 0, 1, 1, None, np.frombuffer(samples, np.uint8).reshape(100, 300), gif.GREY)
    assert gif.parse(gif.encode([frame], 300, 100))[2][0].pixels.tobytes() == samples


def test_lzw_without_a_clear_code_and_beyond_a_full_table():
    """A stream whose table is full goes on with 12-bit codes, and a stream needn't begin with a clear code."""
    rng = random.Random(3)
    samples = bytes(rng.randrange(256) for _ in range(9_000))
    assert gif.lzw(compressed(samples, 8, clears=False), 8, len(samples)).tobytes() == samples
    assert gif.lzw(compressed(b"\1\2\1\2\1\2\1", 8, first=False), 8, 7).tobytes() == b"\1\2\1\2\1\2\1"
    for bad, why in ((b"", "end early"), (compressed(samples, 8)[:100], "end early"), (b"\x00\xff\xff", "bad code|end early")):
        with pytest.raises(ValueError, match=why):
            gif.lzw(bad, 8, 9_000)


#: A published ten by ten picture of three colours: its LZW data, minimum code size 2.
PICTURE = bytes.fromhex("8c2d99872a1cdc33a00275ec95faa8de608c04914c01")


def test_lzw_of_a_known_picture():
    got = gif.lzw(PICTURE, 2, 100).reshape(10, 10)
    assert ["".join(map(str, r)) for r in got.tolist()] == ["1111122222"] * 3 + ["1110000222"] * 2 + ["2220000111"] * 2 + ["2222211111"] * 3


def test_gif_disposal_and_transparency():
    import numpy as np

    palette = np.zeros((256, 3), np.uint8)
    palette[1:4] = [[255, 0, 0], [0, 255, 0], [0, 0, 255]]
    full = np.full((2, 2), 1, np.uint8)
    dot = np.array([[2]], np.uint8)
    seen_through = np.array([[0, 3], [3, 0]], np.uint8)
    frames = [gif.Frame(0, 0, 5, 1, None, full, palette), gif.Frame(1, 1, 7, 3, None, dot, palette), gif.Frame(0, 0, 9, 2, 0, seen_through, palette), gif.Frame(0, 0, 1, 0, None, dot, palette)]
    width, height, stored = gif.parse(gif.encode(frames, 2, 2))
    assert [(f.delay, f.disposal, f.transparent) for f in stored] == [(5, 1, None), (7, 3, None), (9, 2, 0), (1, 0, None)]
    red, green, blue, black = (255, 0, 0), (0, 255, 0), (0, 0, 255), (0, 0, 0)
    seen = [[tuple(p) for p in c.reshape(-1, 3).tolist()] for c in gif.shown(width, height, stored)]
    assert seen == [[red] * 4, [red, red, red, green], [red, blue, blue, red], [green, black, black, black]]


def test_gif_of_bad_media(spark):
    (good,) = gif.of_samples([bytes(64)])
    huge = good[:6] + b"\xff\xff\xff\xff" + good[10:]
    got = gif.read(spark.createDataFrame([(0, b"no"), (1, good[:-20]), (2, None), (3, good), (4, huge), (3, good)], "id int, media binary")).orderBy("id").collect()
    assert [r.error for r in got] == ["file ends early", "file ends early", None, None, None, "canvas too large"] and got[3].samples == bytes(64)
    (tall,) = gif.of_samples([bytes(64 * (gif.ROWS + 1))])
    assert len(gif.parse(tall)[2]) == 2
    text = (prose(9000, random.Random(1))).encode()
    text += bytes(-len(text) % 64)
    assert len(gif.of_samples([text])[0]) < 0.8 * len(text)


def test_language_id_on_odd_rows(spark, docs):
    model = langid.learn(docs)
    got = by_id(langid.identify(docs, model))
    for i, t in corpus():
        assert (got[i].lang_pred == "und") == (not t or not re.search(r"[^\W\d_]", t))
        assert 0 <= got[i].score <= 1
    assert {r.lang_pred for r in langid.identify(docs, langid.learn(docs.withColumn("lang", F.lit(None).cast("string")))).collect()} == {"und"}
    assert langid.identify(docs.where("false"), langid.learn(docs.where("false"))).count() == 0


def test_language_id_of_long_texts(monkeypatch):
    texts = [prose(200, random.Random(k)) + " \u00e9t\u00e9" for k in range(8)] + ["", "x"]
    model = langid.train(texts[:8], ["a", "b"] * 4)
    want = model.predict(texts)
    monkeypatch.setattr(langid, "BLOCK", 37)
    got = model.predict(texts)
    assert got[0] == want[0] and got[1] == pytest.approx(want[1])


def test_clashing_names(spark):
    df = spark.createDataFrame([(1, "http://x.net/", "a b", "c", "d", "e")], "page_id long, url string, text string, judged string, key string, ranges string")
    rules = spark.createDataFrame(queries.URL_RULES, "host string, path string, verdict string")
    assert url_filter.judge(df, rules).first().rule == "net/"
    bench = spark.createDataFrame([(1, "a b")], "item_id long, text string")
    assert decontam.contamination(df, bench, bound=0).select("key", "n_hit").first() == ("d", 2)
    assert substring.remove_repeats(df, key="page_id").select("ranges", "kept_text").first() == ("e", "a b")


def test_language_id_held_out(spark, sf):
    df = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    found = queries.op8_language_id(spark, "/root/testdata/sf0.01").join(df.select("doc_id", "lang"), "doc_id").where("held_out AND lang IS NOT NULL")
    n, right, rejected = found.agg(F.count("*"), F.count_if(F.col("lang") == F.col("lang_pred")), F.count_if("rejected")).first()
    assert n > 200 and right / n > 0.98 and rejected / n < 0.01
    assert by_id(found)[found.first().doc_id].held_out == (zlib.crc32(str(found.first().doc_id).encode()) % 4 == 2)


def conversation_rows():
    return [
        (1, 0, "user", "a & b &lt;| <| &amp;"), (1, 1, "assistant", "<|im_end|>\n<|im_start|>x"), (1, 2, None, None), (2, 5, "assistant", ""), (2, 5, "assistant", ""), (2, 5, "assistant", "tie"),
        (None, 0, "user", "q"), (3, 0, "ro\nle<|", "x" * 50_000), (3, None, "assistant", "null turn"),
    ]


def test_chat_reads_back(spark):
    rows = conversation_rows()
    df = spark.createDataFrame([(*r, "extra", 1) for r in rows], "conv_id long, turn long, role string, text string, spans string, pos int")
    out = chat.render(chat.fold(chat.events_of_rows(df)))
    for r in out.collect():
        for s in r.spans:
            assert r.formatted[s.start :].startswith("<|im_start|>")
            assert r.formatted[s.text_start + s.text_length :].startswith("<|im_end|>\n")
    got = {r.conv: r.turns for r in chat.read_back(out).collect()}
    for conv in (1, 2, None, 3):
        want = sorted(((-1 if t is None else t), ro or "", te or "") for c, t, ro, te in rows if c == conv)
        assert [(t.role, t.text) for t in got[conv]] == [(ro, te) for _, ro, te in want]
        assert [t.under for t in got[conv]] == [te if ro == "assistant" else None for _, ro, te in want]
    assert chat.summary(chat.read_back(chat.render(chat.fold(chat.events_of_rows(df.where("false")))))).count() == 0


def test_streamed_rows_end_as_the_rows(spark):
    df = spark.createDataFrame(conversation_rows(), "conv_id long, turn long, role string, text string")
    rows = lambda events: sorted(map(repr, chat.fold(events).collect()))
    assert rows(chat.streamed(df)) == rows(chat.events_of_rows(df))
    assert set(r.kind for r in chat.streamed(df).collect()) == {"open", "delta", "edit", "regenerate"}


def plain_fold(log):
    """The messages of one conversation's events (msg, seq, kind, role, text)."""
    messages = {}
    for msg, seq, kind, role, text in sorted(log, key=lambda e: e[1]):
        m = messages.setdefault(msg, {"first": seq, "role": "", "text": "", "gone": False, "back": False})
        if kind == "open":
            m["role"] = role or ""
        if kind == "regenerate":
            for o in messages.values():
                o["back"] |= m["first"] < o["first"]
        m["text"] = (m["text"] if kind in ("open", "delta") else "") + ((text or "") if kind not in ("regenerate", "delete") else "")
        m["gone"] = kind == "delete"
    return [(m["role"], m["text"]) for m in sorted(messages.values(), key=lambda m: m["first"]) if not m["gone"] and not m["back"]]


def test_random_logs_against_a_plain_fold(spark):
    rng, logs = random.Random(8), {}
    for conv in range(60):
        seen, log = 0, []
        for seq in range(rng.randint(1, 25)):
            if not seen or rng.random() < 0.3:
                seen += 1
                log.append((seen, seq, "open", rng.choice(["user", "assistant", None]), rng.choice(["", None, "hi ", "x"])))
            else:
                kind = rng.choice(["delta"] * 5 + ["edit", "regenerate", "delete"])
                log.append((rng.randint(1, seen), seq, kind, None, f"t{seq} " if kind in ("delta", "edit") else None))
        logs[conv] = log
    rows = [(conv, *e) for conv, log in logs.items() for e in log]
    rng.shuffle(rows)
    found = {}
    for r in sorted(chat.fold(spark.createDataFrame(rows, "conv long, msg long, seq long, kind string, role string, text string")).collect(), key=lambda r: (r.conv, r.pos)):
        found.setdefault(r.conv, []).append((r.role, r.text))
    for conv, log in logs.items():
        assert found.get(conv, []) == plain_fold(log), log


def test_chat_events_fold(spark):
    log = [
        (1, 1, 1, "open", "user", "hel"), (1, 1, 2, "delta", None, "lo"), (1, 2, 3, "open", "assistant", "bad"), (1, 2, 4, "delta", None, " answer"), (1, 3, 5, "open", "user", "why?"),
        (1, 2, 6, "regenerate", None, None), (1, 2, 7, "delta", None, "good"), (1, 4, 8, "open", "user", "typo"), (1, 4, 9, "edit", None, "fixed"), (1, 4, 10, "delta", None, "!"),
        (2, 1, 1, "open", "user", "gone"), (2, 1, 2, "delete", None, None), (2, 2, 3, "open", "assistant", None),
    ]
    events = spark.createDataFrame(log, "conv long, msg long, seq long, kind string, role string, text string")
    got = sorted((r.conv, r.pos, r.role, r.text) for r in chat.fold(events).collect())
    assert got == [(1, 1, "user", "hello"), (1, 2, "assistant", "good"), (1, 3, "user", "fixed!"), (2, 1, "assistant", "")]


def test_urls(spark):
    urls = [None, "", "nothing", "http://", "HTTP://A.Example.NET/en/x?q#f", "http://net", "http://net/", "http://xnet/a", "http://example.com/de", "http://example.com/de/1", "http://WWW.example.com/DE/1", "a://b.org/fr/", "a://b.org?x/fr/", "x://example.net/en/", "x://example.net/enx", "://net/é", "http://example.net:80/en/", "http://net/\nx", "x://example.net/en/"]
    df = spark.createDataFrame([(i, u, "p", "h", 9) for i, u in enumerate(urls)], "page_id long, url string, path string, rule string, best int")
    rules = spark.createDataFrame(queries.URL_RULES, "host string, path string, verdict string")
    got = by_id(url_filter.judge(df, rules), "page_id")
    assert len(got) == len(urls)
    for i, u in enumerate(urls):
        host = path = ""
        if u and "://" in u:
            rest = u.split("://", 1)[1]
            host = re.match(r"[^/?#]*", rest)[0]
            path = re.match(r"[^?#]*", rest[len(host) :])[0]
            host = host.translate(LOW)
        fits = [(len(h + p), h + p, v) for h, p, v in queries.URL_RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
        _, rule, verdict = max(fits) if fits else (0, None, "allow")
        assert (got[i].host, got[i].path, got[i].rule, got[i].verdict, got[i].best) == (host, path, rule, verdict, 9), u
    assert url_filter.judge(df, rules.where("false")).where("verdict <> 'allow'").count() == 0
    assert url_filter.judge(df.where("false"), rules).count() == 0


def test_archive(spark, tmp_path):
    rows = [(1, "http://a/", "same"), (5, "http://b/\r\nX: y", "same"), (3, None, "same"), (2, "u", None), (4, "u", ""), (6, "u", "é" * 50_000), (6, "u", "é" * 50_000)]
    df = spark.createDataFrame([(*r, "x") for r in rows], "page_id long, url string, html string, id string")
    folder = str(tmp_path / "a")
    warc.write_archive(df, folder, "page_id", "url", "html")
    got = sorted((tuple(r)[:5] for r in warc.read_summary(spark, folder, "page_id").collect()), key=lambda r: r[0])
    want = []
    for i, _, t in sorted(rows, key=lambda r: r[0]):
        b, top = (t or "").encode(), max(j for j, _, s in rows if (s or "") == (t or ""))
        want.append((i, len(b), base64.b32encode(hashlib.sha1(b).digest()).decode(), "response" if i == top else "revisit", None if i == top else top))
    assert got == want
    records = {(r.record_id, r.record_type): bytes(r.record) for r in warc.read_records(spark, folder).collect()}
    assert records["5", "response"] == b"\r\n".join([b"WARC/1.1", b"WARC-Type: response", b"WARC-Record-ID: <urn:record:5>", b"WARC-Date: 1970-01-01T00:00:00Z", b"WARC-Target-URI: http://b/X: y", b"WARC-Payload-Digest: sha1:" + want[4][2].encode(), b"Content-Length: 4", b"", b"same", b"", b""])
    assert b"WARC-Refers-To: <urn:record:5>" in records["1", "revisit"] and records["1", "revisit"].endswith(b"Content-Length: 0\r\n\r\n\r\n\r\n")
    assert spark.read.parquet(f"{folder}/payloads").count() == 3
    warc.write_archive(df, str(tmp_path / "b"), "page_id", "url", "html", least=5)
    assert {r.record_type for r in warc.read_summary(spark, str(tmp_path / "b"), "page_id").where("payload_bytes < 5").collect()} == {"response"}
    warc.write_archive(df.where("false"), str(tmp_path / "c"), "page_id", "url", "html")
    assert warc.read_summary(spark, str(tmp_path / "c"), "page_id").count() == 0


def test_archive_notices_damage(spark, tmp_path):
    folder = str(tmp_path / "a")
    warc.write_archive(spark.createDataFrame([(1, "u", "text")], "page_id long, url string, html string"), folder, "page_id", "url", "html")
    spark.createDataFrame([(hashlib.sha256(b"text").hexdigest(), b"other")], "key string, body binary").write.mode("overwrite").parquet(f"{folder}/payloads")
    with pytest.raises(Exception, match="payload is damaged"):
        warc.read_summary(spark, folder, "page_id").collect()


def random_pair(rng, percent, size):
    """Two sets of about this size exactly at the threshold."""
    import numpy as np

    a, b = size, rng.randint(size, size * 100 // percent)
    both = -(-percent * (a + b) // (100 + percent))
    pool = np.array([rng.getrandbits(64) for _ in range(a + b - both)], np.uint64)
    return np.sort(pool[:a]), np.sort(np.concatenate([pool[:both], pool[a:]])), both


@pytest.mark.parametrize("percent", [50, 55, 60, 70, 80, 85, 90, 95])
def test_linked_sets_share_a_signature(percent):
    import numpy as np

    rng, bands, pairs = random.Random(percent), partenum.Bands(percent), 0
    for size, times in ((1, 20), (2, 20), (7, 100), (20, 200), (50, 300), (70, 200), (120, 100), (300, 60), (700, 20), (1500, 10)):
        for _ in range(times):
            a, b, both = random_pair(rng, percent, size)
            if both <= len(a) and not np.array_equal(a, b):
                pairs += 1
                assert len(np.intersect1d(partenum.signatures(a, bands), partenum.signatures(b, bands))), (size, len(b))
    assert pairs > 600


@pytest.mark.parametrize(("counts", "sparse"), [(partenum.COUNTS, partenum.SPARSE), (9, 0.0), (9, 1e9)])
def test_linked_against_all_pairs(monkeypatch, counts, sparse):
    import numpy as np

    monkeypatch.setattr(partenum, "COUNTS", counts)
    monkeypatch.setattr(partenum, "SPARSE", sparse)
    rng = random.Random(4)
    for trial in range(60):
        percent, n, base = rng.choice([50, 80, 90]), rng.randint(0, 40), [rng.getrandbits(64) for _ in range(rng.choice([8, 30, 120]))]
        sets = [np.array(sorted({x for x in base if rng.random() < rng.choice([0.5, 0.97, 1])} | {rng.getrandbits(64) for _ in range(rng.randint(0, 2))} or {1}), np.uint64) for _ in range(n)]
        copies, side = np.array([rng.randint(1, 3) for _ in sets]), np.array([rng.randint(0, 1) for _ in sets]) if trial % 2 else None
        links, root = [0] * n, list(range(n))
        for i in range(n):
            for j in range(i):
                both = len(np.intersect1d(sets[i], sets[j]))
                if (side is None or side[i] != side[j]) and 100 * both >= percent * (len(sets[i]) + len(sets[j]) - both):
                    links[i], links[j] = links[i] + copies[j], links[j] + copies[i]
                    root = [min(root[i], root[j]) if x in (root[i], root[j]) else x for x in root]
        group, found = partenum.linked(sets, percent, copies, side)
        assert (group.tolist(), found.tolist()) == (root, links)


def test_jaccard_of_a_large_template(spark):
    """Texts of 23 words that differ in the last one or two all link or not by the shared shingles; every pair counts, and none is listed."""
    start = " ".join(f"w{k}" for k in range(22))
    df = spark.range(20_000).selectExpr("id doc_id", f"concat('{start} x', cast(id % 19000 as string)) text")
    got = partenum.jaccard_components(df, n=3, percent=90, most=4000).agg(F.min("component_id"), F.max("component_id"), F.min("n_links"), F.max("n_links")).first()
    assert tuple(got) == (0, 0, 19_999, 19_999)


@pytest.mark.parametrize(
    ("alphabet", "n"),
    [("abcdefghijklmnopqrstuvwxyz", 200_000), ("".join(map(chr, range(0x4E00, 0x9FA5))), 100_000), ("0123456789", 100_000), ("ACGT", 100_000), ("=_-+", 50_000), ("aé日", 20_000), ("ab", 700), ("z", 30_001)],
)
def test_bpe_of_long_words(alphabet, n):
    import time

    import numpy as np

    path, pattern = queries.tokenizer()
    with open(path, "rb") as f:
        codec = bpe.Codec(f.read(), pattern)
    rng, begun = random.Random(n), time.time()
    texts = ["".join(rng.choice(alphabet) for _ in range(n)), (alphabet * (n // len(alphabet) + 1))[:n]]
    got = codec.encode(texts)
    assert time.time() - begun < 60
    for t, ids in zip(texts, got, strict=True):
        assert np.frombuffer(ids, "<u4").tolist() == tiktoken_encode(t)


def test_bpe_with_ids_above_16_bits(tmp_path):
    import numpy as np
    import tiktoken

    ranks = {bytes([k]): 70_000 + k for k in range(256)} | {b"ab": 100_000, b"cab": 100_001, b"abab": 200_000, b" c": 200_001}
    data = b"\n".join(base64.b64encode(t) + b" %d" % k for t, k in ranks.items())
    codec = bpe.Codec(data, queries.tokenizer()[1])
    library = tiktoken.Encoding("test", pat_str=queries.tokenizer()[1], mergeable_ranks=ranks, special_tokens={})
    for t in ["ababab cabab", "cab" * 40, "", "ab" * 101]:
        assert np.frombuffer(codec.encode([t])[0], "<u4").tolist() == library.encode_ordinary(t)
        assert codec.decode(codec.encode([t])) == [t.encode()]


def test_bpe_leaves_the_collector_on(spark, docs):
    import gc

    bpe.digests(docs, *queries.tokenizer()).count()
    assert set(docs.mapInPandas(lambda frames: (__import__("pandas").DataFrame({"on": [gc.isenabled()]}) for _ in frames), "on boolean").toPandas()["on"]) == {True}
