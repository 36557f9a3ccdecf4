"""Benchmark decontamination: n-gram seeds find passages, Smith-Waterman alignment scores them.

The benchmark comes in blocks of a bounded number of words; each block is set against all documents. A task finds the
n-grams of the block in each document; every one is a seed, since an edited copy may hold only an item's frequent ones.
The windows around them are aligned with the item word by word, but for those that hold too few of the item's words
for any alignment to reach the least score.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_WORD = re.compile(r"\w+")


@dataclass(frozen=True)
class Alignment:
    """n-gram length of seeds; scores of a matching word, another word and a gap; least score as a share of the item's
    words, and least score of a short item; words of a benchmark block."""

    gram: int = 4
    match: float = 1.0
    other: float = -0.5
    gap: float = -0.5
    least_share: float = 0.5
    least_words: int = 6
    block_words: int = 1 << 18


def words_of(text: str | None) -> list[str]:
    """Lower-cased runs of letters, digits and underscores."""
    return _WORD.findall((text or "").lower())


@dataclass(frozen=True)
class Block:
    """Items of the benchmark as word ids (from 1; 0 is any word that no item has) and their n-gram codes."""

    ids: list
    items: list[np.ndarray]
    vocabulary: dict[str, int]
    codes: np.ndarray  # sorted n-gram codes; below, for each its item and its place in it
    code_item: np.ndarray
    code_place: np.ndarray
    gram: int


def gram_codes(words: np.ndarray, gram: int) -> np.ndarray:
    """A 64-bit code of each n-gram of word ids; 0 where a word is of no item."""
    n = len(words) - gram + 1
    if n < 1:
        return np.empty(0, np.uint64)
    code, known = np.zeros(n, np.uint64), np.ones(n, bool)
    for i in range(gram):
        part = words[i : i + n]
        code = (code + part.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
        code ^= code >> np.uint64(29)
        known &= part > 0
    return np.where(known, code | np.uint64(1), np.uint64(0))


def make_block(rows: list[tuple], gram: int) -> Block:
    """rows (item_id, words). An item of fewer than ``gram`` words is sought whole, by its own shorter n-gram."""
    vocabulary: dict[str, int] = {}
    items = [np.array([vocabulary.setdefault(w, len(vocabulary) + 1) for w in words], np.int32) for _, words in rows]
    codes, owner, place = [], [], []
    for i, item in enumerate(items):
        found = gram_codes(item, min(gram, len(item)))
        codes.append(found)
        owner.append(np.full(len(found), i))
        place.append(np.arange(len(found)))
    code = np.concatenate([np.empty(0, np.uint64), *codes])
    own, at = (np.concatenate([np.empty(0, np.int64), *x]) for x in (owner, place))
    order = np.argsort(code, kind="stable")
    return Block([i for i, _ in rows], items, vocabulary, code[order], own[order], at[order], gram)


def windows_of(words: np.ndarray, block: Block, rule: Alignment) -> list[tuple[int, int, int]]:
    """(item, start, end) of the places in a document that n-grams point to.

    A window reaches half an item beyond where the whole item would lie; those of an item that overlap are joined, and
    joined ones are cut into bands that overlap by the longest span an alignment of the least score can have, so
    that each alignment lies whole in a band and no window grows with the text.
    """
    lengths = sorted({min(block.gram, len(i)) for i in block.items if len(i)})
    at, entry = [], []
    for gram in lengths:
        codes = gram_codes(words, gram)
        low, high = np.searchsorted(block.codes, codes, "left"), np.searchsorted(block.codes, codes, "right")
        hit = np.flatnonzero((high > low) & (codes > 0))
        if len(hit):
            many = (high - low)[hit]
            step = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
            at.append(np.repeat(hit, many))
            entry.append(np.repeat(low[hit], many) + step)
    if not at:
        return []
    position, entries = np.concatenate(at), np.concatenate(entry)
    item, place = block.code_item[entries], block.code_place[entries]
    size = np.array([len(i) for i in block.items])[item]
    start = np.maximum(position - place - size // 2 - 4, 0)
    end = np.minimum(position - place + size + size // 2 + 4, len(words))
    order = np.lexsort((start, item))
    out, i = [], 0
    while i < len(order):
        k = order[i]
        s, e = start[k], end[k]
        i += 1
        while i < len(order) and item[order[i]] == item[k] and start[order[i]] <= e:
            e = max(e, end[order[i]])
            i += 1
        own, s, e = int(item[k]), int(s), int(e)
        span = longest_span(block.items[own], rule)
        while e - s > 4 * span:
            out.append((own, s, s + 4 * span))
            s += 3 * span
        out.append((own, s, e))
    return out


def least_score(item: np.ndarray, rule: Alignment) -> float:
    return max(rule.least_share * len(item), min(rule.least_words, len(item)))


def longest_span(item: np.ndarray, rule: Alignment) -> int:
    """Words of a text that an alignment of the least score can reach over: the item's, and what gaps may cost."""
    return len(item) + int((rule.match * len(item) - least_score(item, rule)) / -rule.gap) + 1


def _parts(sizes: np.ndarray) -> Iterator[np.ndarray]:
    """Places of windows in parts of at most 256 windows and about 2^21 words, padded to the longest; short ones first."""
    order = np.argsort(sizes, kind="stable")
    at = 0
    while at < len(order):
        end = at + 1
        while end < len(order) and end - at < 256 and (end - at + 1) * int(sizes[order[end]]) <= 1 << 21:
            end += 1
        yield order[at:end]
        at = end


def align(item: np.ndarray, windows: np.ndarray, rule: Alignment) -> tuple[np.ndarray, np.ndarray]:
    """(score, end) of the best local alignment of an item with each row of windows (word ids, -1 beyond the end).

    Smith-Waterman with a linear gap, a row of the matrix at a time for all windows: a gap along the row is a running
    maximum of the score plus what the distance costs.
    """
    n, m = windows.shape
    before = np.zeros((n, m + 1))
    best, end = np.zeros(n), np.zeros(n, np.int64)
    slope = -rule.gap * np.arange(m + 1)
    for word in item:
        now = np.zeros((n, m + 1))
        diagonal = before[:, :-1] + np.where(windows == word, rule.match, rule.other)
        now[:, 1:] = np.maximum(np.maximum(diagonal, before[:, 1:] + rule.gap), 0)
        now = np.maximum.accumulate(now + slope, axis=1) - slope
        top = now.argmax(axis=1)
        value = now[np.arange(n), top]
        better = value > best
        best, end = np.where(better, value, best), np.where(better, top, end)
        before = now
    return best, end


def contaminated(docs: DataFrame, benchmark: DataFrame, rule: Alignment = Alignment()) -> DataFrame:
    """(doc_id, item_id, score, start_word, end_word): the benchmark items that docs(doc_id, text) hold.

    score is the best local alignment's share of the item's words (1: whole and unchanged); rows have least_share at
    least, and least_words words at least or all of a shorter item. The words from start_word up to end_word align.
    Rows that repeat a doc_id or an item_id count as one, by their best alignment. Null and empty texts on either side
    align with nothing; an empty table gives no rows. Other columns are not looked at.
    """
    out, rows, size = None, [], 0
    for row in benchmark.select("item_id", "text").toLocalIterator():  # a block at a time on the driver
        words = words_of(row["text"])
        if words:
            rows.append((row["item_id"], words))
            size += len(words)
        if size >= rule.block_words:
            found = _against_all(docs, make_block(rows, rule.gram), rule)
            out, rows, size = found if out is None else out.union(found), [], 0
    if rows or out is None:
        found = _against_all(docs, make_block(rows, rule.gram), rule)
        out = found if out is None else out.union(found)
    return (
        out.groupBy("doc_id", "item_id")
        .agg(F.max(F.struct("score", F.negative("start_word").alias("before"), "end_word")).alias("best"))
        .select("doc_id", "item_id", "best.score", F.negative("best.before").alias("start_word"), "best.end_word")
    )


def _against_all(docs: DataFrame, block: Block, rule: Alignment) -> DataFrame:
    shared = docs.sparkSession.sparkContext.broadcast(block)  # of bounded size: block_words

    def find(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = shared.value
        known = held.vocabulary.get
        for batch in batches:
            rows = []
            for doc_id, text in zip(batch["doc_id"], batch["text"], strict=True):
                words = np.array([known(w, 0) for w in words_of(text)], np.int32)
                for item, start, end in windows_of(words, held, rule):
                    own, window = held.items[item], words[start:end]
                    if rule.match * np.isin(own, window).sum() >= least_score(own, rule):  # no alignment has more matches
                        rows.append((doc_id, item, start, window))
            yield pd.DataFrame(rows, columns=["doc_id", "item", "start", "words"])

    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = shared.value
        for batch in batches:
            rows = []
            for item, group in batch.groupby("item"):
                words = held.items[item]
                least = least_score(words, rule)
                for places in _parts(group["words"].map(len).to_numpy()):
                    part = group.iloc[places]
                    sizes = np.array([len(w) for w in part["words"]])
                    windows = np.full((len(part), sizes.max()), -1, np.int32)
                    for i, w in enumerate(part["words"]):
                        windows[i, : len(w)] = w
                    best, end = align(words, windows, rule)
                    keep = np.flatnonzero(best >= least)
                    if not len(keep):
                        continue
                    # the same from the end backwards gives where the alignment starts
                    back = np.full((len(keep), int(end[keep].max())), -1, np.int32)
                    for i, k in enumerate(keep):
                        back[i, : end[k]] = windows[k, : end[k]][::-1]
                    _, length = align(words[::-1], back, rule)
                    for i, k in enumerate(keep):
                        start = int(part["start"].iloc[k])
                        rows.append((part["doc_id"].iloc[k], item, float(best[k] / len(words)), start + int(end[k] - length[i]), start + int(end[k])))
            yield pd.DataFrame(rows, columns=["doc_id", "item", "score", "start_word", "end_word"])

    # one Python step: two in a row hold two workers for each core, which are kept and each remember words in later stages.
    # doc_id as text, since pandas would make floats of longs among nulls
    aligned = (
        docs.where(F.col("text").isNotNull())
        .select(F.col("doc_id").cast("string").alias("doc_id"), "text")
        .mapInPandas(lambda batches: score(find(batches)), "doc_id string, item int, score double, start_word int, end_word int")
    )
    names = docs.sparkSession.createDataFrame([(i, item_id) for i, item_id in enumerate(block.ids)], "item int, item_id long")
    return aligned.join(F.broadcast(names), "item").select(F.col("doc_id").cast("long").alias("doc_id"), "item_id", "score", "start_word", "end_word")
