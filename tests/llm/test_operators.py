"""Every operator on awkward rows: nulls, empty and long texts, repeated rows, empty tables, clashing column names."""

from __future__ import annotations

import html
import itertools
import random
import re
import zlib

import numpy as np
import public_tokenizers
import pytest
import xxhash
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from cartwarden.llm import common, decontaminate, html_text, line_chunks, packing, quality_fm, simhash, suffixes, token_files, tokens, url_rules, vector_graph
from cartwarden.llm import queries as Q
from cartwarden.llm.components import components

BPE = public_tokenizers.path("byte_bpe_50k.json")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
random.seed(4)
VOCABULARY = ["".join(random.choices("abcdefghij", k=random.randint(2, 7))) for _ in range(3000)]


def prose(n: int, seed: int) -> str:
    return " ".join(random.Random(seed).choices(VOCABULARY, k=n))


AWKWARD = [
    (1, "", "en", "s", 0), (2, None, None, None, None), (None, "a text without an id", "en", "s", 20), (3, prose(40_000, 1), "en", "s", None),
    (4, "one\ntwo\nthree", "en", "s", 13), (4, "one\ntwo\nthree", "en", "s", 13), (5, "one\ntwo\nthree", "fr", "s", 13), (6, "   \n\n\t", "en", "s", 6), (7, "é日本 <|endoftext|>  x", "en", "s", 5),
]


@pytest.fixture(scope="module")
def docs(spark):
    # extra columns with names that the operators give their results
    clash = ["score", "predicted", "removed_lines", "fingerprint", "component", "row", "rank", "class", "offset", "sequence_id", "spans", "hash", "at", "start"]
    return spark.createDataFrame(AWKWARD, SCHEMA).withColumns({c: F.lit("x") for c in clash})


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


# op 1


def test_main_text_leaves_the_rest_out():
    page = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var a="<p>no</p>"</script></head><body>
    <header><h1>Site</h1></header><nav><ul><li><a href=/>Home</a></li></ul></nav><div class="cookie-notice">We use cookies, sorry.</div>
    <div id="main"><h2>Title &amp; more</h2><p>First,  with\n white   space. And <b>bold</b> words, of course.<p>Second &eacute; paragraph, which ends here.</div>
    <aside>Read next.</aside><form>Name <input name=a></form><div class="comments"><p>Nice one, thanks a lot for it.</p></div><footer>(c)</footer></body></html>"""
    assert html_text.main_text(page) == "Title & more First, with white space. And bold words, of course. Second é paragraph, which ends here."


@pytest.mark.parametrize("page,text", [(None, ""), ("", ""), ("<p>", ""), ("plain", "plain"), ("<article></article>", ""), ("<article>a<br>b</article>", "a b"), ("<p>1 &lt; 2", "1 < 2"), ("<nav>only this</nav>", "")])
def test_main_text_of_odd_pages(page, text):
    assert html_text.main_text(page) == text


def test_pages_of_divs_keep_all_of_the_article():
    long, short = "A sentence, with words. " * 40, "A short one, as well."
    page = f"<body><div><h2>Heading</h2><p>{long}</p><p>{short}</p></div></body>"
    assert html_text.main_text(page) == " ".join(f"Heading {long} {short}".split())
    page = f"<body><div><p>{short * 3}</p><div><p>{long}</p><p>{long}</p></div></div></body>"
    assert html_text.main_text(page) == " ".join(f"{short * 3} {long} {long}".split())


BODY = "<h1>A title</h1><p>First, some words of it. And more.</p><p>Yes.</p><p>Second, with words too, as it goes on here.</p>"
TEXT = "A title First, some words of it. And more. Yes. Second, with words too, as it goes on here."


@pytest.mark.parametrize("page", [
    '<body class="page-with-sidebar"><div id="wrap" class="no-sidebar has-comments"><article>{}</article></div><footer>(c) us, all of us.</footer></body>',
    '<div class="blog-post share"><div>{}</div></div>', "<form action=/x><nav><a href=/>Home</a></nav><main>{}</main></form>", "<form><div>{}</div><input></form>",
    '<div class="comments"><article class="comment-body"><p>I like it a lot, thanks.</p></article></div><article>{}</article>',
    '<article>{}<div>Advertisement</div><p class="cta">Sign up for our newsletter</p><div class="related"><p>Read on, please.</p></div></article>',
    "<div>" * 100_000 + "<article>{}</article>", "<b>" * 50_000 + "{}" + "</i>" * 50_000,
])
def test_wrappers_keep_their_article(page):
    assert html_text.main_text(page.format(BODY)) == TEXT


def test_pages_without_an_article_of_their_own():
    for page in ('<div class="cookie-notice">We use cookies, sorry.</div>', "<footer><p>All rights reserved.</p><p>Yes, all.</p></footer>", "<form>Name <input></form>"):
        assert html_text.main_text(page) == ""


def test_pages_of_the_tables_equal_their_article(spark):
    rows = common.table(spark, "/root/testdata/sf0.01", "pages").collect()
    for r in rows:  # these pages are flat: the article's markup says what its text is
        inner = re.search(r"<article>(.*?)</article>", r.html, re.S)[1]
        blocks = re.split(r"</?(?:p|h1|li|ul|div|br)[^>]*>", inner)
        there = " ".join(" ".join(html.unescape(re.sub(r"<[^>]+>", "", b)).split()) for b in blocks).split()
        assert html_text.main_text(r.html).split() == there, r.page_id


def test_extract_keeps_every_row(spark):
    pages = spark.createDataFrame([(1, "u", None, "x"), (1, "u", None, "x"), (None, None, "<p>a b</p>", "x")], "page_id long, url string, html string, text string")
    got = html_text.extract_text(pages).collect()
    assert sorted((r.text, r.n_chars) for r in got) == [("", 0), ("", 0), ("a b", 3)]
    assert html_text.extract_text(pages.limit(0)).count() == 0


# op 2 and op 7


def test_encoder_equals_the_library():
    encode, tokenizer = tokens.Encoder(BPE).encode, Tokenizer.from_file(BPE)
    rng = random.Random(11)
    odd = ["  ", "\n", " \n", "'s", "'ll", "don't", "<|endoftext|>", "\u0085", "\u00a0", "\u3000", "\u200b", "\U0003329e", "²", "ª", "日本", "Zé", "é ", "…"]

    def any_character():
        kind = rng.random()
        if kind < 0.3:
            return rng.choice(" abXY019.,'!_-\n")
        if kind < 0.5:
            return rng.choice(odd)
        if kind < 0.8:
            return chr(rng.randrange(0x180))
        code = rng.randrange(0x3000 if kind < 0.9 else 0x110000)
        return chr(code) if not 0xD800 <= code < 0xE000 else "x"

    texts = ["".join(any_character() for _ in range(rng.randrange(14))) for _ in range(20_000)]
    for text in texts:
        assert np.frombuffer(encode(text), "<u4").tolist() == tokenizer.encode(text, add_special_tokens=False).ids, repr(text)
    small = tokens.Encoder(BPE)
    small.pieces.left = small.words.left = 4000  # memos that are full at once
    for text in texts[:2000]:
        assert small.encode(text) == encode(text)
    assert small.pieces.left >= 0 and small.words.left >= 0


def expected_ids(text, end):
    return np.array([*Tokenizer.from_file(BPE).encode(text or "", add_special_tokens=False).ids, end], "<u4")


def test_packing_covers_every_id_once(docs, none):
    got = packing.pack_documents(docs, BPE).collect()
    by_sequence: dict = {}
    for r in got:
        by_sequence.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for pieces in by_sequence.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= 2048
    assert sorted(by_sequence) == list(range(len(by_sequence)))
    for doc_id, text, *_ in AWKWARD:
        ids = expected_ids(text, 1)
        mine = sorted({(r.start, r.length, r.ids_crc32) for r in got if r.doc_id == doc_id and r.doc_tokens == len(ids)})
        assert sum(length for _, length, _ in mine) == len(ids)
        assert all(zlib.crc32(ids[s : s + n].tobytes()) == c for s, n, c in mine)
    assert packing.pack_documents(none, BPE).count() == 0


def test_patterns_hold_the_demand():
    rng = np.random.default_rng(3)
    sizes = np.unique(rng.integers(1, 129, 60))
    demand = rng.integers(1, 200, len(sizes))
    plan = packing.whole_patterns(sizes, demand, 128, 1000)
    assert (sum(times * pattern for pattern, times in plan) == demand).all()
    assert all((pattern * sizes).sum() <= 128 for pattern, _ in plan)
    assert sum(times for _, times in plan) <= 1.05 * (sizes * demand).sum() / 128 + 1


def test_token_files_round_trip(spark, docs, none):
    root = common.scratch(spark, "test-tokens")
    token_files.write_token_files(docs, root, BPE)
    keys = token_files.document_keys(docs)
    got = token_files.read_token_files(spark, root, keys).collect()
    there = sorted(((-1 if d is None else d), expected_ids(t, 2).tobytes()) for d, t, *_ in AWKWARD)
    assert sorted(((-1 if r.doc_id is None else r.doc_id), bytes(r.ids)) for r in got) == there
    start = 0
    for r in sorted(got, key=lambda r: r.start):
        assert r.start == start
        start += r.n_tokens
    assert [r.doc_id for r in sorted(got, key=lambda r: r.start)][0] is None
    absent = spark.createDataFrame([(99, 0), (4, 2)], "doc_id long, ordinal long")
    assert token_files.look_up(spark, root, absent).count() == 0
    empty = common.scratch(spark, "test-tokens")
    token_files.write_token_files(none, empty, BPE)
    assert token_files.read_token_files(spark, empty, token_files.document_keys(none)).count() == 0


def test_perfect_hash_is_minimal():
    rng = np.random.default_rng(1)
    h, g = (rng.integers(0, 2**63, 1500).astype(np.uint64) for _ in range(2))
    pilots, slots = token_files.build_hash(h, g)
    assert sorted(slots.tolist()) == list(range(1500))
    assert (token_files.find_slots(pilots, 1500, h, g) == slots).all()


# op 3


def brute_vectors(rows, threshold=0.93):
    ids = {i for i, v, label in rows if i is not None}
    good = [(i, np.array(v) / max(map(abs, v)) / np.linalg.norm(np.array(v) / max(map(abs, v))), label) for i, v, label in rows if v and i is not None and label is not None and None not in v and np.isfinite(v).all() and any(v)]
    links = {i: set() for i in ids}
    for i, v, a in good:
        for j, w, b in good:
            if i != j and a == b and len(v) == len(w) and v @ w >= threshold:
                links[i].add(j)
    least = {}
    for i in ids:
        seen, todo = {i}, [i]
        while todo:
            for j in links[todo.pop()] - seen:
                seen.add(j)
                todo.append(j)
        least[i] = min(seen)
    return {i: (len(links[i]), least[i]) for i in ids}


def test_vectors_equal_brute_force(spark):
    rng = np.random.default_rng(5)
    base = rng.normal(size=(60, 8))
    rows = [(i, (base[i % 60] + rng.normal(scale=0.08 * (i % 3), size=8)).tolist(), i % 2) for i in range(300)]
    rows += [(1000 + i, base[0].tolist(), 0) for i in range(20)]
    rows += [(2000, None, 0), (2001, [0.0] * 8, 0), (2002, [float("nan")] * 8, 0), (2003, [1.0] * 8, None), (2004, [None] + [1.0] * 7, 0), (2005, [], 0), (2006, [1.0] * 4, 0), (None, [1.0] * 8, 0), (2007, [1e300] * 8, 0), (2008, [1.0] * 8, 0), (2008, [1.0] * 8, 0)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").withColumn("links", F.lit("x")).repartition(3)
    graph = vector_graph.Graph(shard_rows=40)  # several clusters and splits
    result = vector_graph.near_vectors(frame, graph)
    got = result.collect()
    assert len(got) == len(rows)
    there = brute_vectors(rows)
    wrong = [r for r in got if r.vec_id is not None and (r.n_links, r.component_id) != there[r.vec_id]]
    assert len(wrong) <= 0.02 * len(rows)
    assert all(r.kept == (r.vec_id is not None and r.vec_id == r.component_id) for r in got)
    found, real = vector_graph.audit_recall(frame, result, graph, every=10)
    assert found >= 0.9 * real > 0
    assert vector_graph.near_vectors(frame.limit(0)).count() == 0


# op 4


def test_quality_on_held_out_rows(spark):
    scored = Q.op4_quality_fm(spark, "/root/testdata/sf0.01").join(common.table(spark, "/root/testdata/sf0.01", "labels"), "doc_id").where("held_out").collect()
    assert len(scored) > 50
    assert np.mean([r.predicted == r.quality for r in scored]) >= 0.93
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in scored)


def test_quality_of_odd_rows(spark, docs, none):
    labels = spark.createDataFrame([(4, 1, 0), (5, 0, 0), (5, 0, 0), (3, None, 0), (None, 1, 0)], "doc_id long, quality int, toxic int")
    model = quality_fm.fit(docs, labels)
    got = quality_fm.score_quality(docs, model).collect()
    assert len(got) == len(AWKWARD) and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7) for r in got)
    assert quality_fm.score_quality(none, quality_fm.fit(none, labels)).count() == 0


def test_pairwise_identity():
    rng = np.random.default_rng(2)
    w, v = rng.normal(size=quality_fm.FEATURES), rng.normal(size=(quality_fm.FEATURES, 3))
    k = len(quality_fm.STATISTICS)
    model = quality_fm.Model(0.3, w * 0.01, v * 0.05, np.zeros(k), np.ones(k))
    buckets, values, statistics = quality_fm.features("some words, some more words")
    at, x = np.concatenate([buckets, np.arange(quality_fm.BUCKETS, quality_fm.FEATURES)]), np.concatenate([values, np.clip(statistics, -4, 4)])
    y = 0.3 + sum(model.w[a] * b for a, b in zip(at, x)) + sum(model.v[at[i]] @ model.v[at[j]] * x[i] * x[j] for i in range(len(at)) for j in range(i))
    assert model.score(buckets, values, statistics) == pytest.approx(1 / (1 + np.exp(-y)))


# op 5


def test_leaks_are_found_and_clean_documents_left(spark, docs, none):
    item = prose(40, 77)
    edited = item.split()
    edited[5], edited[20] = "changed", "altered"
    del edited[30]
    rows = [(10, prose(300, 5) + " " + item + " " + prose(300, 6)), (11, prose(100, 7) + " " + " ".join(edited)), (12, prose(600, 8)), (13, item.upper()), (None, item), (14, " ".join(item.split()[:8]) + prose(50, 9))]
    frame = spark.createDataFrame(rows, "doc_id long, text string").unionByName(docs.select("doc_id", "text")).withColumn("score", F.lit("x"))
    benchmark = spark.createDataFrame([(1, item), (1, item), (2, None), (3, ""), (4, prose(30, 99))], "item_id long, text string")
    got = {(r.doc_id, r.item_id): r for r in decontaminate.contaminated(frame, benchmark).collect()}
    assert set(got) == {(10, 1), (11, 1), (13, 1), (None, 1)}
    assert got[10, 1].score == 1 and (got[10, 1].start_word, got[10, 1].end_word) == (300, 340)
    assert 0.7 < got[11, 1].score < 1
    assert decontaminate.contaminated(none, benchmark).count() == 0
    assert decontaminate.contaminated(frame, benchmark.limit(0)).count() == 0
    assert decontaminate.contaminated(frame, benchmark, decontaminate.Alignment(block_words=10)).count() == 4


def test_alignment_is_one_python_step(spark, docs):
    benchmark = spark.createDataFrame([(1, prose(40, 77))], "item_id long, text string")
    plan = decontaminate.contaminated(docs, benchmark)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("MapInPandas") == 1  # a second in the same task would be a second worker


def test_edited_and_half_items_are_found(spark):
    item = prose(40, 77).split()
    sixth = " ".join(f"changed{i}" if i % 6 == 5 else w for i, w in enumerate(item))
    half = " ".join(item[:20])
    around = lambda text, i: prose(100, 800 + i) + " " + text + " " + prose(100, 900 + i)
    benchmark = spark.createDataFrame([(1, " ".join(item))], "item_id long, text string")
    for text, copies, score in ((sixth, 0, (34 - 3) / 40), (sixth, 3, (34 - 3) / 40), (half, 0, 0.5)):  # the other n-grams in no document, and verbatim elsewhere
        rows = [(1, around(text, 1)), (2, prose(300, 3)), (3, around(" ".join(item[:8]), 4)), *((10 + i, around(" ".join(item), 10 + i)) for i in range(copies))]
        found = decontaminate.contaminated(spark.createDataFrame(rows, "doc_id long, text string"), benchmark)
        assert {r.doc_id: r.score for r in found.collect()} == {1: score, **{10 + i: 1.0 for i in range(copies)}}


def test_windows_of_a_text_that_repeats_an_item_are_bounded(spark):
    item = prose(40, 78)
    benchmark = spark.createDataFrame([(1, item)], "item_id long, text string")
    rule = decontaminate.Alignment()
    block = decontaminate.make_block([(1, decontaminate.words_of(item))], rule.gram)
    text = " ".join([item] * 2000)
    ids = np.array([block.vocabulary[w] for w in decontaminate.words_of(text)], np.int32)
    found = decontaminate.windows_of(ids, block, rule)
    span = decontaminate.longest_span(block.items[0], rule)
    assert max(e - s for _, s, e in found) <= 4 * span and all(b[1] <= a[2] - span for a, b in itertools.pairwise(found))
    rows = [(1, text), (2, " ".join([item.replace(" ", " x ", 12), *[" ".join(item.split()[:4])] * 300, item]))]
    got = {r.doc_id: (r.score, r.end_word - r.start_word) for r in decontaminate.contaminated(spark.createDataFrame(rows, "doc_id long, text string"), benchmark).collect()}
    assert got == {1: (1.0, 40), 2: (1.0, 40)}


def test_string_labels_of_vectors(spark):
    rows = [(1, [1.0, 0.0], "a"), (2, [1.0, 0.1], "a"), (3, [1.0, 0.0], "b"), (4, [1.0, 0.0], None)]
    got = vector_graph.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<float>, label string")).collect()
    assert {r.vec_id: (r.n_links, r.component_id) for r in got} == {1: (1, 1), 2: (1, 1), 3: (0, 3), 4: (0, 4)}


def plain_alignment(a, b):
    best, table = 0.0, [[0.0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i in range(1, len(a) + 1):
        for j in range(1, len(b) + 1):
            table[i][j] = max(0, table[i - 1][j - 1] + (1 if a[i - 1] == b[j - 1] else -0.5), table[i - 1][j] - 0.5, table[i][j - 1] - 0.5)
            best = max(best, table[i][j])
    return best


def test_alignment_equals_the_plain_one():
    rng = np.random.default_rng(8)
    item, windows = rng.integers(1, 5, 12), rng.integers(1, 6, (30, 20))
    score, _ = decontaminate.align(item, windows, decontaminate.Alignment())
    assert score.tolist() == [plain_alignment(item.tolist(), w.tolist()) for w in windows]


# op 6


def test_passages_equal_brute_force(spark, docs, none):
    shared, longer = prose(60, 31), prose(200, 32)
    rows = [(i, prose(100 + 7 * i, 200 + i) + " " + (shared if i % 2 else longer) + " " + prose(50 + i, 300 + i)) for i in range(20, 32)]
    rows += [(50, prose(400, 50)), (51, prose(49, 32)), (52, "same " * 500)]
    frame = spark.createDataFrame(rows, "doc_id long, text string").unionByName(docs.select("doc_id", "text")).withColumn("hash", F.lit("x"))
    got: dict = {}
    for r in suffixes.repeated_passages(frame).collect():
        got.setdefault(r.doc_id, set()).update(range(r.start_word, r.end_word))
    for i in range(20, 32):
        assert got.pop(i) == set(range(100 + 7 * i, 100 + 7 * i + (60 if i % 2 else 200)))
    assert not got
    assert suffixes.repeated_passages(none).count() == 0


def test_passages_that_end_in_a_frequent_phrase(spark):
    own = lambda p, i: zlib.crc32(f"{p}.{i}".encode())
    rows = []
    for p in range(6):  # 49 words that 60 documents hold, two of them after the same nine words
        phrase = prose(49, 40 + p)
        rows += [(100 * p + i, prose(60, 1000 + 100 * p + i) + f" l{p}.{i} {phrase} {own(p, i)} " + prose(60, 2000 + 100 * p + i)) for i in range(60)]
        rows += [(1000 + 2 * p + j, prose(59, 3000 + 2 * p + j) + f" L{p}.{j} " + prose(9, 4000 + p) + f" {phrase} {own(p, 60 + j)} " + prose(60, 5000 + 2 * p + j)) for j in (0, 1)]
    got = {r.doc_id: (r.start_word, r.end_word) for r in suffixes.repeated_passages(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1000 + i: (60, 118) for i in range(12)}


@pytest.mark.parametrize("frequent", [20, 1 << 16])
def test_passages_equal_all_runs(spark, frequent):
    """Against every run of words of every text: self-repeats, repeated ids, copies, chance overlaps, frequent suffixes in salts."""
    rule = suffixes.Passages(min_words=12, gram=3, window=6, frequent=frequent)
    rng, parts = random.Random(8), [prose(n, 7000 + n) for n in (9, 11, 12, 13, 20, 33, 50)]
    rows = []
    for i in range(300):
        pieces = [rng.choice(parts) if rng.random() < 0.4 else prose(rng.randint(1, 15), 8000 + 10 * i + j) for j in range(rng.randint(0, 8))]
        rows.append((i // 2 if i < 40 else i, " ".join(pieces)))
    alone = prose(30, 99)
    rows += [(900, f"{alone} x {alone}"), (901, "a b " * 60), (902, "a b " * 70), (903, rows[50][1]), (50, rows[50][1])]
    holders: dict = {}
    for row in set(rows):
        words = row[1].split()
        for at in range(len(words) - 11):
            holders.setdefault(tuple(words[at : at + 12]), set()).add(row)
    expected = set()
    for row in set(rows):
        words = row[1].split()
        held = sorted({k for at in range(len(words) - 11) if len(holders[tuple(words[at : at + 12])]) > 1 for k in range(at, at + 12)})
        starts = [k for k in held if k - 1 not in held]
        ends = [k + 1 for k in held if k + 1 not in held]
        # touching spans are one, as their words are
        expected |= {(row, s, e) for s, e in zip(starts, ends, strict=True)}
    got = [(r.doc_id, r.start_word, r.end_word) for r in suffixes.repeated_passages(spark.createDataFrame(rows, "doc_id long, text string"), rule).collect()]
    assert sorted(got) == sorted((row[0], s, e) for row, s, e in expected) and any(doc == 901 for doc, *_ in got) and all(doc != 900 for doc, *_ in got)


# op 8


def test_line_chunks_of_odd_rows(spark, docs, none):
    block = "\n".join(prose(8, 400 + i) for i in range(12))
    rows = [(i, prose(9, 500 + i) + "\n" + block + "\n" + prose(9, 600 + i), "en", "s", 1) for i in range(100, 104)]
    frame = docs.unionByName(spark.createDataFrame(rows, SCHEMA), allowMissingColumns=True)
    got = {(r.doc_id, r.lang): r for r in line_chunks.dedup_lines(frame).collect()}
    assert line_chunks.dedup_lines(frame).count() == frame.count()
    assert got[100, "en"].removed_lines == 0 and all(got[i, "en"].removed_lines >= 6 for i in (101, 102, 103))
    assert all(rows[i - 100][1].split("\n")[0] in got[i, "en"].text for i in range(100, 104))
    assert got[2, None].text is None and got[1, "en"].text == "" and got[6, "en"].text == "   \n\n\t"
    assert got[4, "en"].text == "one\ntwo\nthree"  # its own copy doesn't count against it
    assert got[5, "fr"].text == "" and got[5, "fr"].removed_lines == 3
    assert line_chunks.dedup_lines(none).count() == 0


def test_short_repeated_blocks_are_found(spark):
    found = {}
    for k in (2, 3, 4, 6, 10):
        rows = []
        for i in range(150):
            block = "\n".join(prose(6, 100_000 * k + 20 * i + j) for j in range(k))
            rows += [(2 * i + c, "\n".join([prose(6, 7_000_000 + 10 * i + c), prose(6, 8_000_000 + 10 * i + c), block, prose(6, 9_000_000 + 10 * i + c), "end"])) for c in (0, 1)]
        clash = spark.createDataFrame(rows, "doc_id long, text string").withColumns({c: F.lit("x") for c in ("__row_key", "__spans", "__gone", "__kept", "__lines", "c0", "row_key")})
        got = line_chunks.dedup_lines(clash).groupBy(F.col("doc_id") % 2).agg(F.sum("removed_lines").alias("n"), F.sum(F.col("removed_lines").cast("boolean").cast("int")).alias("some")).collect()
        assert {r[0]: r.n for r in got}[0] == 0  # the first occurrence stays
        found[k] = tuple(round(x / 150, 2) for x in ({r[0]: r.n for r in got}[1] / k, {r[0]: r.some for r in got}[1]))
    assert all(found[k][0] >= least for k, least in {2: 0.4, 3: 0.55, 4: 0.65, 6: 0.7, 10: 0.8}.items()), found


# op 9


def test_listed_rules(spark):
    urls = {
        "https://www.example.com/en/1": ("www.example.com/en/", "allow"), "http://m.example.com/en/x?y": ("example.com/en/", "block"), "http://M.Example.COM/de/": ("com/", "allow"),
        "http://a.net/es/1": ("net/es/", "block"), "http://a.net/en": (None, "allow"), "no scheme": (None, "allow"), None: (None, "allow"), "": (None, "allow"), "x://notexample.com": (None, "allow"), "x://notexample.com/": ("com/", "allow"),
    }
    pages = spark.createDataFrame([(i, u) for i, u in enumerate(urls)] + [(0, next(iter(urls)))], "page_id long, url string").withColumn("host", F.lit("x"))
    labelled = spark.createDataFrame([], "url string, blocked boolean")
    got = url_rules.judge_urls(pages, labelled).collect()
    assert len(got) == len(urls) + 1
    for r in got:
        assert (r.rule, r.verdict) == list(urls.values())[r.page_id]
    assert {(r.host, r.path) for r in got if r.page_id == 1} == {("m.example.com", "/en/x")}
    assert url_rules.judge_urls(pages.limit(0), labelled).count() == 0


def test_mined_rules_block(spark):
    labelled = spark.createDataFrame([(f"http://bad{i % 3}.spam.org/p/{i}", True) for i in range(60)] + [(f"http://good{i % 3}.fine.org/p/{i}", False) for i in range(90)] + [(None, None), (None, True)], "url string, blocked boolean")
    pages = spark.createDataFrame([(1, "http://bad1.spam.org/p/7"), (2, "http://good1.fine.org/p/8"), (3, "http://new.spam.org/")], "page_id long, url string")
    got = {r.page_id: r for r in url_rules.judge_urls(pages, labelled).collect()}
    assert (got[1].verdict, got[2].verdict, got[3].verdict) == ("block", "allow", "block")
    assert got[1].mined_rule and got[2].mined_rule is None


def test_mined_rules_equal_brute_force(spark):
    rng = random.Random(3)
    rows = [(sorted(rng.sample(["a", "b", "c", "d", "e"], rng.randrange(1, 5))) + [f"z{i}" for i in range(30)], None) for _ in range(400)]
    rows = [(tokens, rng.random() < (0.9 if {"a", "b"} <= set(tokens) else 0.7 if "c" in tokens else 0.1)) for tokens, _ in rows]  # 30 tokens always together
    mining = url_rules.RuleMining(min_support=0.02, min_confidence=0.6, min_lift=1.1)
    got = {r.rule_id: round(r.confidence, 9) for r in url_rules.mine_rules(spark.createDataFrame(rows, "tokens array<string>, blocked boolean"), mining).collect()}
    share, there = np.mean([b for _, b in rows]), {}
    for size in (1, 2, 3):
        for antecedent in itertools.combinations(["a", "b", "c", "d", "e", "z9"], size):  # the longest, then the last, stands for the 30
            held = [b for tokens, b in rows if set(antecedent) <= set(tokens)]
            if held and sum(held) >= 0.02 * len(rows) and np.mean(held) >= 0.6 and np.mean(held) >= 1.1 * share:
                there[antecedent] = np.mean(held)
    there = {a: c for a, c in there.items() if not any(set(o) < set(a) and there[o] >= c for o in there)}
    got = {tuple(r.split(" ")): c for r, c in got.items()}
    swapped = {tuple(sorted("z9" if t.startswith("z") else t for t in a)): c for a, c in got.items()}
    assert swapped == {a: round(float(c), 9) for a, c in there.items()}


@pytest.mark.parametrize("hot", [0, 512])
def test_tokens_that_part_outside_the_labels_and_hot_sets(spark, monkeypatch, hot):
    """A rule fires on any of the tokens that always came together in the labels; ids of sets with spaces stay apart; hot sets equal others."""
    monkeypatch.setattr(url_rules, "HOT", hot)
    labelled = [(f"http://bad.org/casino-promo/{i}", True) for i in range(20)] + [(f"http://good{i % 4}.com/a/{i}", False) for i in range(40)]
    urls = ["http://bad.org/other/5", "http://new.de/casino-promo/3", "http://good1.com/a/7", "http://x.de/y"] + [f"http://bad.org/casino-promo/{i}" for i in range(200)] + ["http://z.de/a b/c", "http://z.de/a/path=b/c", "http://z.de/a\\ b", None]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    got = {r.page_id: r.verdict for r in url_rules.judge_urls(pages, spark.createDataFrame(labelled, "url string, blocked boolean")).collect()}
    assert got == {i: "block" if u and ("bad.org" in u or "casino-promo" in u) else "allow" for i, u in enumerate(urls)}


def test_joined_tokens_are_told_apart(spark):
    sets = [["a b"], ["a", "b"], ["a\\", "b"], ["a\\ b"], ["a\\\\ b"], ["a\\\\", "b"], [""], []]
    df = spark.createDataFrame([(s,) for s in sets], "tokens array<string>")
    assert df.select(url_rules.joined(F.col("tokens")).alias("j")).where("j <> ''").distinct().count() == len(sets) - 2


# op 10


def slow_fingerprint(text, words=3):
    parts = (text or "").encode().translate(bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")).split()
    shingles = [b" ".join(parts[i : i + words]) for i in range(max(1, len(parts) - words + 1))] if parts else []
    h = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_simhash_groups_equal_brute_force(spark, docs, none):
    rows = [(100 + i, prose(12, i % 25) + " Tail" * (i % 2)) for i in range(80)] + [(300 + i, prose(900, 3) + f" w{i}") for i in range(12)]
    frame = spark.createDataFrame(rows, "doc_id long, text string").unionByName(docs.where("length(text) < 1000 or text is null").select("doc_id", "text")).withColumn("fingerprint", F.lit("x"))
    texts = [(r.doc_id, slow_fingerprint(r.text)) for r in frame.collect()]
    got = {(r.doc_id, r.fingerprint & (2**64 - 1)): r.component_id for r in simhash.near_dup_groups(frame).collect()}
    for doc_id, print_ in texts:
        reached, todo = {print_}, [print_]
        while todo:
            p = todo.pop()
            for q in {q for _, q in texts} - reached:
                if bin(p ^ q).count("1") <= 2:
                    reached.add(q)
                    todo.append(q)
        assert got[doc_id, print_] == min((d for d, q in texts if q in reached and d is not None), default=None)
    again = {(r.doc_id, r.fingerprint & (2**64 - 1)): r.component_id for r in simhash.near_dup_groups(frame, route_rows=2).collect()}
    assert again == got  # routes that are split find the same
    assert simhash.near_dup_groups(none).count() == 0


def test_tree_finds_all_within_the_radius():
    rng = np.random.default_rng(1)
    base = rng.integers(-(2**63), 2**63 - 1, 200)
    points = np.unique(np.concatenate([base, base ^ (1 << rng.integers(0, 62, 200)), base[:50] ^ (1 << rng.integers(0, 62, 50)) ^ 1]))
    distance = simhash.popcount((points[:, None] ^ points[None, :]).ravel()).reshape(len(points), -1)
    for radius in (0, 2, 7):
        q, p = simhash.BKTree(points).search(points, radius)
        assert set(zip(q.tolist(), p.tolist())) == set(map(tuple, np.argwhere(distance <= radius).tolist()))


def test_one_of_each_group_of_near_copies_stays(spark, docs, none):
    text = prose(400, 700).split()
    copies = [(i, " ".join([*text[: 30 * (i - 500)], "other", *text[30 * (i - 500) + 1 :]]), "en", "s", 1) for i in range(500, 510)]
    frame = docs.unionByName(spark.createDataFrame([*copies, (600, prose(400, 701), "en", "s", 1)], SCHEMA), allowMissingColumns=True)
    kept = simhash.drop_near_dups(frame)
    ids = sorted(-1 if r.doc_id is None else r.doc_id for r in kept.collect())
    assert ids == [-1, 1, 3, 4, 7, 500, 600]  # empty, null and blank texts are copies of each other
    assert kept.columns == frame.columns
    assert simhash.drop_near_dups(none).count() == 0


def test_components_of_chains_and_hubs(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 160)] + [(7, 7)]
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(41)}, **{i: 100 for i in range(100, 160)}}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_a_repeated_line_keeps_near_copies_together(spark):
    rows = []
    for i in range(0, 24, 2):
        text, line = prose(300, 7000 + i), prose(10, 8000 + i)
        rows += [(i, text + " " + line), (i + 1, text + (" " + line) * 40)]
    kept = simhash.drop_near_dups(spark.createDataFrame(rows, "doc_id long, text string"))
    assert sorted(r.doc_id for r in kept.collect()) == list(range(0, 24, 2))


def brute_copies(rows, similarity=0.8):
    """The doc_ids that stay, by comparing the shingle sets of all pairs."""
    sets = {}
    for i, text in rows:
        w = text.lower().split()
        sets[i] = {" ".join(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()
    ids, root = sorted(sets), {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for x, i in enumerate(ids):
        for j in ids[:x]:
            both = len(sets[i] & sets[j])
            if both >= similarity * (len(sets[i]) + len(sets[j]) - both) and find(i) != find(j):
                root[max(find(i), find(j))] = min(find(i), find(j))
    return {i for i in ids if find(i) == i}


@pytest.mark.parametrize("group_rows", [8, 1024])
def test_near_copies_equal_brute_force(spark, group_rows):
    rng, rows = random.Random(5), []
    phrase = prose(30, 900)  # whose shingles are the minima of many unlike texts
    for i in range(60):
        rows.append((len(rows), phrase + " " + prose(rng.randrange(10, 60), 1000 + i)))
    for family in range(6):  # large groups, each member changed at random places
        base = prose(rng.randrange(40, 300), 2000 + family).split()
        for m in range(40 if family < 2 else 6):
            words = list(base)
            for _ in range(rng.randrange(1, max(2, len(base) // 22))):
                words[rng.randrange(len(words))] = f"x{rng.random()}"
            rows.append((len(rows), " ".join(words)))
    frame = spark.createDataFrame(rows, "doc_id long, text string").withColumns({c: F.lit("x") for c in ("row", "__row", "point", "c0", "route")}).repartition(3)
    kept = simhash.drop_near_dups(frame, group_rows=group_rows)
    assert kept.columns == frame.columns
    got, there = {r.doc_id for r in kept.collect()}, brute_copies(rows)
    assert there <= got and len(got - there) <= 0.02 * len(rows)  # a link may lie beyond the radius or share no minimum


def test_a_family_of_near_copies_meets_in_few_groups(spark, monkeypatch):
    rng, rows, seen = random.Random(9), [], {}
    base = prose(150, 3000).split()
    for i in range(60):  # some near the base, most of them near to a few others only
        words = list(base)
        for _ in range(rng.randrange(1, 7)):
            words[rng.randrange(len(words))] = f"x{rng.random()}"
        rows.append((i, " ".join(words)))
    monkeypatch.setattr(simhash, "written", lambda df, name: seen.setdefault(name, common.written(df, name)))
    kept = simhash.drop_near_dups(spark.createDataFrame(rows, "doc_id long, text string"), group_rows=16)
    assert {r.doc_id for r in kept.collect()} == brute_copies(rows)
    blocks = -(-60 * 5 // (4 * 8))
    assert seen["copies-dealt"].agg(F.sum(F.size("routes"))).first()[0] <= 60 * simhash.ROUTES * blocks  # not once more for each other minimum


# pipeline


def test_pipeline_runs_stage_by_stage(spark):
    import corpus_pipeline

    sf = "/root/testdata/sf0.001"
    docs = common.table(spark, sf, "documents")
    counts, columns = [docs.count()], docs.columns
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = common.written(stage(spark, docs, sf), name)
        assert docs.columns == columns
        counts.append(docs.count())
    assert counts[0] > counts[1] == counts[2] >= counts[3] >= counts[4] > 0
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, sf)
    assert packed.select("doc_id").distinct().count() == docs.count()


def test_decontamination_keeps_clean_rows_that_share_an_id(spark, tmp_path):
    import corpus_pipeline

    passage = " ".join(f"word{i}" for i in range(60))
    spark.createDataFrame([(1, passage)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    rows = [(1, f"before {passage} after"), (1, "a clean text of the same id"), (2, "clean"), (None, passage), (None, "clean without an id"), (3, None), (4, ""), (2, "clean")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("item_id", F.lit("clash"))
    kept = corpus_pipeline.benchmark(spark, docs, str(tmp_path))
    assert kept.columns == docs.columns
    expected = [(1, "a clean text of the same id"), (2, "clean"), (2, "clean"), (3, None), (4, ""), (None, "clean without an id")]
    order = lambda r: (r[0] is None, r[0] or 0, r[1] or "")
    assert sorted(((r.doc_id, r.text) for r in kept.collect()), key=order) == sorted(expected, key=order)
    assert corpus_pipeline.benchmark(spark, docs.limit(0), str(tmp_path)).count() == 0
