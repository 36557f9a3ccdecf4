"""Repeated passages by a sparse suffix array.

Only suffixes that start at minimisers are kept: in every ``window`` neighbouring word n-grams the one of least hash.
A passage of min_words words therefore holds a kept suffix within its first ``window`` words, and its next ``reach``
= min_words - window + 1 words lie in the passage. Around kept suffixes whose first ``reach`` words occur in another
document, each run of min_words words whose first window has that suffix as its minimiser is hashed; the runs that another document has make up the passages, whichever
documents they are shared with.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import written

_BASE = np.uint64(0x9E3779B97F4A7C15)
_BACK = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
#: Of the second hash of a run.
_BASE2 = np.uint64(0xC2B2AE3D27D4EB4F)
_BACK2 = np.uint64(pow(0xC2B2AE3D27D4EB4F, -1, 1 << 64))


@dataclass(frozen=True)
class Passages:
    """Least words of a repeated passage; n-gram and window of the minimisers (gram <= reach). Runs of a suffix that
    stands at over ``frequent`` places are dealt to salts of about as many."""

    min_words: int = 50
    gram: int = 8
    window: int = 24
    frequent: int = 1 << 16

    @property
    def reach(self) -> int:
        return self.min_words - self.window + 1


def _powers(base: np.uint64, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[:1] = 1
    return np.cumprod(out, dtype=np.uint64)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(29))


def _sums(each: np.ndarray, base: np.uint64, back: np.uint64) -> tuple[np.ndarray, np.ndarray]:
    """Running sums of word hashes times powers of the base, and the powers of its inverse."""
    n = len(each)
    return np.concatenate([np.zeros(1, np.uint64), np.cumsum(each * _powers(base, n), dtype=np.uint64)]), _powers(back, n)


def minimisers(words: list[str], rule: Passages) -> tuple[np.ndarray, np.ndarray]:
    """(positions, hashes of the ``reach`` words from there) of the kept suffixes of a whole text."""
    n = len(words)
    if n < rule.reach:
        return np.empty(0, np.int64), np.empty(0, np.uint64)
    digest = xxhash.xxh64_intdigest
    each = np.array([digest(w.encode("utf-8", "surrogatepass")) for w in words], np.uint64)
    sums, back = _sums(each, _BASE, _BACK)

    def grams(k: int) -> np.ndarray:
        return _mixed((sums[k:] - sums[:-k]) * back[: n - k + 1])

    gram = grams(rule.gram)
    if len(gram) <= rule.window:
        at = np.array([len(gram) - 1 - int(np.argmin(gram[::-1]))])
    else:  # of equal ones the last, so that a run of one word isn't kept at every place
        views = np.lib.stride_tricks.sliding_window_view(gram, rule.window)[:, ::-1]
        at = np.unique(np.arange(len(views)) + rule.window - 1 - views.argmin(axis=1))
    at = at[at <= n - rule.reach]
    return at, grams(rule.reach)[at]


def _row() -> Column:
    """A key for a doc_id (nulls included) and a text; rows that repeat both are one document."""
    return F.xxhash64(F.col("doc_id"), F.col("text"))


def _kept(rule: Passages):
    def find(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows, at, hashes = [np.empty(0, np.int64)], [np.empty(0, np.int32)], [np.empty(0, np.int64)]
            for row, text in zip(batch["row"], batch["text"], strict=True):
                where, code = minimisers(text.split(), rule)
                rows.append(np.full(len(where), row, np.int64))
                at.append(where.astype(np.int32))
                hashes.append(code.view(np.int64))
            yield pd.DataFrame({"row": np.concatenate(rows), "at": np.concatenate(at), "hash": np.concatenate(hashes)})

    return find


_RUN = "row long, at int, hash long, check int, salt int"


def run_hashes(words: list[str], places: np.ndarray, rule: Passages) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(starts, hashes, second hashes, suffixes) of the runs of min_words words whose own suffix is at one of the places.

    The own suffix of a run is the minimiser of its first window, a matter of its words alone; so a run whose own suffix
    no other document has is in no other document.
    """
    starts = np.unique((places[:, None] - np.arange(rule.window)).ravel())
    starts = starts[(starts >= 0) & (starts <= len(words) - rule.min_words)]
    first, second = (np.array([xxhash.xxh64_intdigest(w.encode("utf-8", "surrogatepass"), seed) for w in words], np.uint64) for seed in (0, 1))
    sums, back = _sums(first, _BASE, _BACK)
    gram = _mixed((sums[rule.gram :] - sums[: -rule.gram]) * back[: len(sums) - rule.gram])
    own = [np.empty(0, np.int64)]
    for i in range(0, len(starts), 1 << 16):
        part = starts[i : i + (1 << 16)]
        own.append(part + rule.window - 1 - gram[part[:, None] + np.arange(rule.window - 1, -1, -1)].argmin(axis=1))
    suffix = np.concatenate(own)
    held = np.isin(suffix, places)
    starts, suffix = starts[held], suffix[held]
    code = _mixed((sums[starts + rule.min_words] - sums[starts]) * back[starts]).view(np.int64)
    sums, back = _sums(second, _BASE2, _BACK2)
    check = (_mixed((sums[starts + rule.min_words] - sums[starts]) * back[starts]) >> np.uint64(32)).astype(np.uint32).view(np.int32)
    return starts, code, check, suffix


def _runs(rule: Passages):
    def find(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for row, text, codes in zip(batch["row"], batch["text"], batch["places"], strict=True):
                codes = np.sort(np.asarray(codes, np.int64))
                places, salts = codes >> 32, codes & 0xFFFFFFFF
                at, code, check, suffix = run_hashes(text.split(), places, rule)
                many = salts[np.searchsorted(places, suffix)]
                salt = np.where(many > 1, 1 + (row + at) % many, 0).astype(np.int32)
                for i in range(0, len(at), 1 << 18):
                    part = slice(i, i + (1 << 18))
                    yield pd.DataFrame({"row": np.full(len(at[part]), row, np.int64), "at": at[part].astype(np.int32), "hash": code[part], "check": check[part], "salt": salt[part]})

    return find


def _shared_runs(runs: DataFrame) -> DataFrame:
    """(row, at) of the runs that another row has, by one shuffle: a group is a run's places, or a salt of them.

    Salted runs that are alone in their salt are looked for in the others by what each salt holds.
    """
    equal = W.partitionBy("hash", "check", "salt")
    seen = runs.withColumns({"low": F.min("row").over(equal), "high": F.max("row").over(equal), "top": F.max("salt").over(equal)})
    salted = F.col("top") > 0
    marked = written(
        seen.where((F.col("low") != F.col("high")) | salted)
        .select("row", "at", "low", "high", *(F.when(salted, F.col(c)).alias(c) for c in ("hash", "check")))
        .withColumns({c: F.when(F.col("hash").isNotNull(), F.col(c)) for c in ("low", "high")}),
        "suffix-runs",
    )
    held = marked.where("hash is not null").groupBy("hash", "check").agg(F.min("low").alias("least"), F.max("high").alias("most")).where("least <> most").select("hash", "check")
    across = marked.where("low = high").join(held, ["hash", "check"], "left_semi")
    return marked.where("hash is null or low <> high").select("row", "at").unionByName(across.select("row", "at"))


def repeated_passages(docs: DataFrame, rule: Passages = Passages()) -> DataFrame:
    """(doc_id, start_word, end_word, n_words): the passages of min_words words or more that occur in another document.

    docs has (doc_id, text). Words are what white space separates; places count from 0 and end_word is the first word
    after. Overlapping and touching spans of a document are one. A span is made of all its runs of min_words words that
    another document has, equal by hashes of 64 and 32 bits over the words (so unlike runs pass for equal once in 2^96).
    Null and short texts have no passages; rows that repeat doc_id and text are one document and don't repeat each
    other. Other columns are not looked at.
    """
    texts = docs.where(F.col("text").isNotNull()).select(_row().alias("row"), F.col("doc_id").cast("long").alias("doc_id"), "text")
    kept = written(texts.select("row", "text").mapInPandas(_kept(rule), "row long, at int, hash long"), "suffixes")
    salts = F.ceil(F.col("n") / rule.frequent).alias("salts")
    shared = kept.groupBy("hash").agg(F.min("row").alias("low"), F.max("row").alias("high"), F.count("*").alias("n")).where("low <> high").select("hash", salts)
    places = kept.join(shared, "hash").groupBy("row").agg(F.collect_set(F.shiftleft(F.col("at").cast("long"), 32) + F.col("salts")).alias("places"))
    held = texts.select("row", "text").join(places.hint("merge"), "row").dropDuplicates(["row"])
    runs = _shared_runs(held.mapInPandas(_runs(rule), _RUN))
    spans = runs.select("row", F.col("at").alias("start"), (F.col("at") + rule.min_words).alias("end"))
    # within a document: at most as many rows as it has words
    own = W.partitionBy("row").orderBy("start", "end")
    before = F.max("end").over(own.rowsBetween(W.unboundedPreceding, -1))
    island = F.sum("opens").over(own.rowsBetween(W.unboundedPreceding, 0))
    found = (
        spans.withColumn("opens", F.when(before >= F.col("start"), 0).otherwise(1))
        .withColumn("island", island)
        .groupBy("row", "island")
        .agg(F.min("start").alias("start_word"), F.max("end").alias("end_word"))
    )
    named = texts.select("row", "doc_id").dropDuplicates(["row"])
    return found.join(named, "row").select("doc_id", "start_word", "end_word", (F.col("end_word") - F.col("start_word")).alias("n_words"))
