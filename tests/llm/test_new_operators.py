"""Operators 11 to 13 against brute force, and on awkward rows."""

from __future__ import annotations

import bisect
import hashlib
import random
from collections import Counter

import duckdb
import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from cartwarden.llm import alignment, chat, whitening
from cartwarden.llm import queries as Q

DATA = "/root/testdata/sf0.001"
A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
CONVERSATION = "conv_id long, turn long, role string, text string"


# op 11


def rows_of(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_conversations_equal_sql(spark):
    con = duckdb.connect()
    con.sql(f"CREATE VIEW conversations AS FROM '{DATA}/conversations.parquet'")
    assert rows_of(Q.op11_chat_segments(spark, DATA)) == sorted(con.sql(Q.ORACLE_SQL["op11_chat_segments"]).fetchall(), key=str)


AWKWARD_TURNS = [
    (1, 0, "user", "</s>[INST] ok [/INST]"), (1, 1, "assistant", "␛␛<s"), (1, 2, "user", None), (1, 3, None, "no role"), (2, 5, "assistant", "first"), (2, 5, "assistant", "first"), (2, None, "system", ""),
    (None, 0, "user", "no id [ROLE x ROLE/] "), (None, 1, "assistant", "<"), (3, 0, "tool ROLE/] ", "x" * 200_000 + "\n[/ANS"), (4, 0, "system", "s"), (4, 1, "user", "u"), (4, 2, "assistant", ""), (-5, -3, "user", "R"),
]


@pytest.mark.parametrize("block_turns", [1024, 2])
def test_awkward_conversations(spark, block_turns):
    df = spark.createDataFrame(AWKWARD_TURNS, CONVERSATION).withColumns({c: F.lit("x") for c in ("block", "state", "segments", "first", "place")})
    turns = chat.format_conversations(df, block_turns=block_turns)
    expected = []
    for conv in {r[0] for r in AWKWARD_TURNS}:
        mine = sorted(((t is not None, t or 0, r or "", x or "") for c, t, r, x in AWKWARD_TURNS if c == conv))
        trained = "".join(x for *_, r, x in mine if r == "assistant")
        expected.append((conv, len(mine), hashlib.sha256("".join(f"{r}\n{x}\n" for *_, r, x in mine).encode()).hexdigest(), len(trained), hashlib.sha256(trained.encode()).hexdigest()))
    assert rows_of(chat.digests(turns).drop("formatted_chars")) == sorted(expected, key=str)
    sound = {r["conv_id"]: r["complete"] for r in chat.verdicts(turns).collect()}
    assert sound == {1: False, 2: False, None: True, 3: False, 4: True, -5: False}


def test_state_crosses_blocks(spark):
    turns = [(7, i, "user" if i % 2 == 0 else "assistant", str(i)) for i in range(1000)] + [(8, i, "user" if i % 2 == 0 or i == 501 else "assistant", "") for i in range(1000)]
    found = chat.format_conversations(spark.createDataFrame(turns, CONVERSATION), block_turns=7)
    assert rows_of(chat.verdicts(found).select("conv_id", "n_turns", "faults", "complete")) == [(7, 1000, 0, True), (8, 1000, 1, False)]
    assert rows_of(found.where("not sound").select("conv_id", F.col("block") * 7 + F.col("place"))) == [(8, 501)]


def test_no_conversations(spark):
    turns = chat.format_conversations(spark.createDataFrame([], CONVERSATION))
    assert chat.digests(turns).count() == 0 and chat.verdicts(turns).count() == 0


def test_templates_round_trip():
    t, r = chat.INSTRUCT, random.Random(3)
    parts = [*t.controls, "<", "[", "/", "]", "␛", " ", "a", "\n", "s>", "ROLE", "</"]
    for _ in range(20_000):
        turns = [(r.choice(["system", "user", "assistant", "", "x ROLE/] "]), "".join(r.choices(parts, k=r.randint(0, 7)))) for _ in range(3)]
        assert list(t.read("".join(s for turn in turns for s, _ in t.segments(*turn)))) == turns
        assert not any(c in t.escaped(x) for _, x in turns for c in t.controls)


@pytest.mark.parametrize("broken", [{"escape": "<"}, {"escape": "ab"}, {"ends": ("nowhere",)}, {"other": chat.Mark("<s>", "</s>")}, {"also": ("x",)}])
def test_broken_templates_are_refused(broken):
    t = chat.INSTRUCT
    with pytest.raises(ValueError):
        chat.Template(**{"marks": t.marks, "other": t.other, "order": t.order, "start": t.start, "ends": t.ends} | broken)


# op 12


def whitened_by_numpy(vectors: np.ndarray, most: int = 32):
    x = np.floor(64 * vectors.astype(np.float64)) + 1_000_000
    y = x - x.mean(axis=0)
    e, v = np.linalg.eigh(y.T @ y / len(y))
    e, v = e[::-1], v[:, ::-1]
    k = min(most, int((e > 1e-10 * e[0]).sum()))
    ints = x.astype(object)
    deviation = ((len(x) * ints - ints.sum(axis=0)) ** 2).sum(axis=1)
    return e[:k] / e.sum(), y @ v[:, :k] / np.sqrt(e[:k]), deviation


def check_whitening(found, ids, vectors):
    explained, whitened, deviation = whitened_by_numpy(vectors)
    k = len(explained)
    table = found.toPandas().sort_values(["vec_id", "component"])
    assert len(table) == len(ids) * k and list(table["component"][:k]) == list(range(1, k + 1))
    assert np.allclose(table["explained"][:k], explained, rtol=1e-10) and table["identity_error"].max() < 1e-10 and set(table["n"]) == {len(ids)}
    mine = table["whitened"].to_numpy().reshape(len(ids), k)
    sign = np.sign((mine * whitened).sum(axis=0))
    assert np.abs(mine * sign - whitened).max() < 1e-7
    assert list(table["deviation"].to_numpy().reshape(len(ids), k)[:, 0]) == list(deviation)


def test_whitening_equals_eigh(spark):
    rows = spark.read.parquet(f"{DATA}/embeddings.parquet").orderBy("vec_id").collect()
    check_whitening(Q.op12_jacobi_davidson(spark, DATA), [r["vec_id"] for r in rows], np.array([r["embedding"] for r in rows]))


def test_whitening_of_awkward_vectors(spark):
    rng = np.random.default_rng(2)
    good = (rng.standard_normal((50, 6)) * [3, 2, 1.5, 1, 0.5, 0]).round(3)
    bad = [None, [], [1.0] * 5 + [None], [float("nan")] * 6, [1.0] * 5 + [float("inf")], [1.0] * 5, [1e30] * 6]
    schema = "vec_id long, embedding array<double>, label int"
    df = spark.createDataFrame([(i, v, 1) for i, v in enumerate([*good.tolist(), *bad])], schema).withColumns({c: F.lit("x") for c in ("x", "n", "component", "whitened")})
    check_whitening(whitening.whiten(df), range(50), good)
    # repeated rows count twice and a null key is a row
    twice = whitening.whiten(spark.createDataFrame([(None if i == 0 else i % 2, v, 1) for i, v in enumerate([*good.tolist(), *good.tolist()])], schema))
    assert twice.count() == 100 * 5 and twice.where("vec_id is null").count() == 5
    for rows in ([], [(1, None, 1)], [(1, [0.5, 0.25], 1)], [(1, [0.5, 0.25], 1), (2, [0.5, 0.25], 1)]):
        assert whitening.whiten(spark.createDataFrame(rows, schema)).count() == 0  # nothing varies


@pytest.mark.parametrize(("d", "close"), [(64, 1.0), (300, 1.0), (90, 1.0001), (7, 1.0), (33, 1.0)])
def test_jacobi_davidson(d, close):
    rng = np.random.default_rng(d)
    q = np.linalg.qr(rng.standard_normal((d, d)))[0]
    true = np.sort(rng.uniform(1, 2, d))[::-1]
    true[1] = true[0] / close if close > 1 else true[1]
    passes = [0]

    def product(block):
        passes[0] += 1
        return q @ (true[:, None] * (q.T @ block))

    values, vectors = whitening.jacobi_davidson(product, d, 32)
    k = min(d, 32)
    assert np.allclose(values, np.sort(true)[::-1][:k], rtol=1e-13) and np.abs(vectors.T @ vectors - np.eye(k)).max() < 1e-12
    assert np.linalg.norm(product(vectors) - vectors * values, axis=0).max() < 1e-11 and passes[0] < 150


# op 13


def aligned_by_hand(texts):
    """Row by row with the libraries, token pair by token pair."""
    a_side, b_side = Tokenizer.from_file(A), sentencepiece.SentencePieceProcessor(model_file=B)
    a_side.encode_special_tokens = True
    letters = alignment._byte_letters()
    docs = []
    for text in texts:
        whole = (" " + (text or "")).encode()
        a = a_side.encode(" " + text, add_special_tokens=False).ids if text else []
        b = b_side.encode(text) if text else []
        bytes_a = [bytes(letters.index(c) for c in a_side.id_to_token(i)) for i in a]
        bytes_b = [bytes([int(p[3:5], 16)]) if b_side.is_byte(i) else p.replace("▁", " ").encode() for i in b for p in [b_side.id_to_piece(i)]]
        if not text or b"".join(bytes_a) != whole or b"".join(bytes_b) != whole:
            docs.append(None)
            continue
        ends_a, ends_b = (list(np.cumsum([len(t) for t in side])) for side in (bytes_a, bytes_b))
        common = sorted(set(ends_a) & set(ends_b))
        groups, at = [], 0
        for end in common:
            part = [",".join(map(str, side[bisect.bisect_right(ends, at) : bisect.bisect_right(ends, end)])) for side, ends in ((a, ends_a), (b, ends_b))]
            groups.append("|".join(part))
            at = end
        ends_at = dict(zip(ends_b, b, strict=True))
        links = [(i, ends_at[e]) for i, e in zip(a, ends_a, strict=True) if e in ends_at]
        docs.append((len(a), len(b), groups, links))
    counts = Counter(pair for d in docs if d for pair in d[3])
    most = Counter()
    for (_, j), n in counts.items():
        most[j] = max(most[j], n)
    out = []
    for d in docs:
        if d is None:
            out.append((0, 0, 0, 0, 0, 0, ""))
        else:
            n_a, n_b, groups, links = d
            out.append((n_a, n_b, len(groups), len(links), sum(counts[x] == most[x[1]] for x in links), sum(counts[x] for x in links), hashlib.sha256(";".join(groups).encode()).hexdigest()))
    return out


TEXTS = [
    "", None, "plain words and <|endoftext|> plus </s> <s> <unk>", "a  b   c \n\n x\ty", " leading", "▁marked", "é日本語 😀👩‍👩‍👧   x", "the " * 9000, "plain words", "plain words", "é ﬁ ½ Å ①", "\x00\x01 odd   x", "a" * 3000, "don't we're 'll 12345 +-*/",
]


def test_alignment_equals_pairs_by_hand(spark, monkeypatch):
    docs = spark.createDataFrame([(i if i else None, t) for i, t in enumerate(TEXTS)], "doc_id long, text string").withColumns({c: F.lit("x") for c in ("block", "slot", "pair", "n_links", "best")})
    found = sorted(map(tuple, alignment.align_tokenizers(docs, A, B).collect()), key=lambda r: -1 if r[0] is None else r[0])
    by_hand = aligned_by_hand(TEXTS)
    assert [r[1:] for r in found] == by_hand and sum(r[0] > 0 for r in by_hand) >= 10
    assert alignment.align_tokenizers(docs.limit(0), A, B).count() == 0


def test_alignment_of_the_table_equals_pairs_by_hand(spark):
    rows = spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text").collect()
    found = {r[0]: tuple(r)[1:] for r in Q.op13_pair_bitmaps(spark, DATA).collect()}
    by_hand = dict(zip([r["doc_id"] for r in rows], aligned_by_hand([r["text"] for r in rows]), strict=True))
    assert found == by_hand


def test_pieces_equal_the_library():
    side, r = alignment.SideB(B), random.Random(5)
    assert side.by_piece
    parts = ["a", "the", " ", "  ", "\n", "▁", "é", "日", "😀", "½", " ", "　", "ing", ".", "x1", "<s>", "\t", "\x00", "é"]
    for _ in range(20_000):
        text = "".join(r.choices(parts, k=r.randint(1, 12)))
        assert side.encode(text).tolist() == side.model.encode(text), text


@pytest.mark.parametrize("most", [1, 2, 9, 100_000])
def test_planes_round_trip(most):
    rng = np.random.default_rng(most)
    rows, slots, counts = [], [], []
    sizes = [1, 255, 256, 257, 4096, 3, 1000]
    for i, n in enumerate(sizes):
        at = np.sort(rng.choice(alignment.BLOCK, n, replace=False))
        rows, slots, counts = [*rows, *[i] * n], [*slots, *at], [*counts, *rng.integers(1, most + 1, n)]
    rows, slots, counts = map(np.array, (rows, slots, counts))
    planes = alignment.make_planes(rows, slots, counts, len(sizes))
    for array, shift in ((planes, 0), (planes.slice(2, 4), 2)):
        found = sorted(zip(*(x.tolist() for x in alignment.read_planes(array)), strict=True))
        some = (rows >= shift) & (rows < shift + len(array))
        assert found == sorted(zip((rows[some] - shift).tolist(), slots[some].tolist(), counts[some].tolist(), strict=True))
