"""Packing of token sequences as a cutting-stock problem solved by column generation.

Documents are cut into pieces of the capacity and one remainder. The histogram of piece lengths, in classes of a few
tokens, is the demand of a cutting-stock problem whose patterns say how many pieces of each class share a sequence. A
linear program over the patterns found so far gives each class a price; a knapsack dynamic program finds the pattern
that earns most at those prices, until none earns more than a sequence costs. Rounded down, the patterns hold nearly
all pieces; the rest, fewer than patterns times pieces, is placed first-fit. Pieces are then ranked within their class
and each rank is assigned its sequence by counting, so that no step sees more than a histogram on the driver.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .common import written
from .tokens import encoder


@dataclass(frozen=True)
class Packing:
    """capacity of a sequence; width of a length class in tokens; bounds of the linear program's rounds."""

    capacity: int = 2048
    width: int = 16
    rounds: int = 1000
    rank_rows: int = 4096


def token_pieces(docs: DataFrame, tokenizer: str, end_id: int, capacity: int, keep_ids: bool = False) -> DataFrame:
    """(doc_id, start, length, ids_crc32, doc_tokens[, ids]) for docs(doc_id, text): pieces of at most capacity ids.

    Each document's ids, with the end id, are cut from the front into pieces of the capacity; the remainder comes last.
    Null texts count as empty: one piece with the end id. keep_ids adds the ids as little-endian 32-bit bytes.
    """
    schema = "doc_id string, start long, length long, ids_crc32 long, doc_tokens long" + ", ids binary" * keep_ids

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encode, end = encoder(tokenizer).encode, np.array([end_id], "<u4").tobytes()
        for batch in batches:
            rows = []
            for doc_id, text in zip(batch["doc_id"], batch["text"], strict=True):
                ids = encode(text) + end
                n = len(ids) // 4
                for start in range(0, n, capacity):
                    piece = ids[4 * start : 4 * (start + capacity)]
                    rows.append((doc_id, start, len(piece) // 4, zlib.crc32(piece), n, *([piece] * keep_ids)))
            yield pd.DataFrame(rows, columns=["doc_id", "start", "length", "ids_crc32", "doc_tokens", *["ids"] * keep_ids])

    # as text, since pandas would make floats of longs among nulls
    pieces = docs.select(F.col("doc_id").cast("string").alias("doc_id"), "text").mapInPandas(cut, schema)
    return pieces.withColumn("doc_id", F.col("doc_id").cast("long"))


def best_pattern(prices: np.ndarray, sizes: np.ndarray, room: int) -> tuple[float, np.ndarray]:
    """The unbounded knapsack: (value, counts) of the dearest pieces that fit in the room, by dynamic programming."""
    value, last = np.zeros(room + 1), np.full(room + 1, -1)
    useful = np.flatnonzero(prices > 1e-12)
    size, price = sizes[useful], prices[useful]
    order = np.argsort(size)
    size, price, useful = size[order], price[order], useful[order]
    for c in range(1, room + 1):
        value[c] = value[c - 1]
        k = np.searchsorted(size, c, "right")
        if k:
            got = value[c - size[:k]] + price[:k]
            i = int(np.argmax(got))
            if got[i] > value[c] + 1e-15:
                value[c], last[c] = got[i], i
    counts, c = np.zeros(len(sizes), np.int64), room
    while c > 0:
        if last[c] < 0:
            c -= 1
        else:
            counts[useful[last[c]]] += 1
            c -= size[last[c]]
    return float(value[room]), counts


def solve_patterns(sizes: np.ndarray, demand: np.ndarray, room: int, rounds: int) -> tuple[np.ndarray, np.ndarray]:
    """(patterns, amounts): the linear program min sum x, sum x_p pattern_p = demand, x >= 0, by the simplex method.

    Starts from a pattern of its own for each size; each round prices the classes by the basis, lets the knapsack find
    the entering pattern and pivots. Prices are smoothed towards size / room, which no pattern can beat, so that full
    patterns come early; where the smoothed prices find nothing, the basis prices decide. Ends when no pattern is worth
    more than one sequence, or after the rounds.
    """
    m = len(sizes)
    each = room // sizes
    basis = np.diag(each.astype(np.float64))
    inverse, x = np.diag(1.0 / each), demand / each
    for turn in range(rounds):
        prices = inverse.sum(axis=0)  # of cost 1 for each pattern
        if prices @ demand <= (sizes / room) @ demand * (1 + 5e-4):
            break  # hardly more sequences than the tokens alone need
        for smooth in (0.8, 0.4, 0.0):
            _, counts = best_pattern(np.maximum(smooth * sizes / room + (1 - smooth) * prices, 0), sizes, room)
            if found := counts @ prices > 1 + 1e-7:
                break
        if not found:
            break
        direction = inverse @ counts
        up = direction > 1e-9
        if not up.any():
            break
        ratio = np.where(up, np.maximum(x, 0) / np.where(up, direction, 1), np.inf)
        leaves = int(np.argmin(ratio))
        step = ratio[leaves]
        x = x - step * direction
        x[leaves] = step
        basis[:, leaves] = counts
        row = inverse[leaves] / direction[leaves]
        inverse -= np.outer(direction, row)
        inverse[leaves] = row
        if turn % 200 == 199:
            # a Newton step takes the rounding errors of the updates out; einsum, since threaded LAPACK can stall beside a busy JVM
            left = 2 * np.eye(m) - np.einsum("ij,jk->ik", basis, inverse)
            inverse = np.einsum("ij,jk->ik", inverse, left)
            x = np.maximum(inverse @ demand, 0)
    return basis.T.astype(np.int64), np.maximum(x, 0)


def whole_patterns(sizes: np.ndarray, demand: np.ndarray, room: int, rounds: int) -> list[tuple[np.ndarray, int]]:
    """(pattern, times) that hold the demand exactly: the rounded-down program, then first-fit of the largest."""
    out: list[tuple[np.ndarray, int]] = []
    left = demand.copy()
    if len(sizes):
        patterns, amounts = solve_patterns(sizes, demand.astype(np.float64), room, rounds)
        for pattern, amount in sorted(zip(patterns, amounts, strict=True), key=lambda p: -p[1]):
            used = pattern > 0
            times = min(int(amount + 1e-6), int((left[used] // pattern[used]).min())) if used.any() else 0
            if times:
                out.append((pattern, times))
                left = left - times * pattern
    while left.sum():  # the rest, one sequence a turn: each takes the largest that still fits
        pattern, space = np.zeros_like(left), room
        for i in np.argsort(-sizes):
            n = min(int(left[i]), int(space // sizes[i]))
            pattern[i], space = n, space - n * int(sizes[i])
        used = pattern > 0
        times = int((left[used] // pattern[used]).min())
        out.append((pattern, times))
        left = left - times * pattern
    return out


def ranked(rows: DataFrame, by: str, order: list[str], rank_rows: int) -> DataFrame:
    """rows with rank long: 0, 1, ... within each value of ``by``, whatever one value's share of the rows.

    Rows are dealt by a hash of the ordering columns to buckets of about rank_rows; a window numbers each bucket, and
    the buckets' sizes, summed up within each value, are added. rows must be a written table.
    """
    buckets = max(1, rows.count() // rank_rows + 1)
    dealt = rows.withColumn("bucket", F.pmod(F.xxhash64(*order), F.lit(buckets)))
    sizes = dealt.groupBy(by, "bucket").agg(F.count("*").alias("size"))
    # as many rows as buckets at most for each value
    before = sizes.withColumn("base", F.sum("size").over(W.partitionBy(by).orderBy("bucket").rowsBetween(W.unboundedPreceding, -1)))
    inside = dealt.withColumn("place", F.row_number().over(W.partitionBy(by, "bucket").orderBy(*order)) - 1)
    return (
        inside.join(before.select(by, "bucket", F.coalesce("base", F.lit(0)).alias("base")), [by, "bucket"])
        .withColumn("rank", F.col("base") + F.col("place"))
        .drop("base", "place", "bucket")
    )


def pack(pieces: DataFrame, packing: Packing = Packing()) -> DataFrame:
    """pieces(doc_id, start, length, ...), each of 1 to capacity tokens, with sequence_id and offset long.

    Pieces of a sequence lie one behind the other from offset 0, longer classes first; sequence_ids are distinct and
    gapless. All columns pass through but of those two names. Rows that agree in all that orders them (doc_id, start,
    length) may swap places. No pieces, no rows. pieces must be a written table: it is read several times.
    """
    spark = pieces.sparkSession
    room = packing.capacity // packing.width
    rows = pieces.select(*[c for c in pieces.columns if c not in ("sequence_id", "offset")]).withColumn(
        "class", F.ceil(F.col("length") / packing.width).cast("int")
    )
    # at most capacity / width rows
    histogram = {r["class"]: r["n"] for r in rows.groupBy("class").agg(F.count("*").alias("n")).collect()}
    sizes = np.array(sorted(histogram), np.int64)
    demand = np.array([histogram[s] for s in sizes.tolist()], np.int64)
    plan, first = [], 0
    given: dict[int, int] = {}
    for pattern, times in whole_patterns(sizes, demand, room, packing.rounds):
        for i in np.flatnonzero(pattern):
            size, each = int(sizes[i]), int(pattern[i])
            start = given.get(size, 0)
            given[size] = start + each * times
            plan.append((size, start, each * times, each, first))
        first += times
    # a row for each pattern and class in it: bounded by the classes, not by the documents
    slots = spark.createDataFrame(plan, "class int, slot_start long, slot_count long, each long, first_sequence long")
    by_class = slots.groupBy("class").agg(F.array_sort(F.collect_list(F.struct("slot_start", "slot_count", "each", "first_sequence"))).alias("slots"))
    order = ["doc_id", "start", "length"]
    numbered = ranked(rows, "class", order, packing.rank_rows)
    mine = F.filter("slots", lambda s: (s["slot_start"] <= F.col("rank")) & (F.col("rank") < s["slot_start"] + s["slot_count"]))[0]
    placed = numbered.join(F.broadcast(by_class), "class").withColumn("slot", mine).withColumn(
        "sequence_id", F.col("slot.first_sequence") + F.floor((F.col("rank") - F.col("slot.slot_start")) / F.col("slot.each"))
    )
    behind = W.partitionBy("sequence_id").orderBy(F.desc("class"), "rank").rowsBetween(W.unboundedPreceding, -1)  # a sequence has capacity rows at most
    return placed.withColumn("offset", F.coalesce(F.sum("length").over(behind), F.lit(0))).select(
        *[c for c in pieces.columns if c not in ("sequence_id", "offset")], "sequence_id", "offset"
    )


def pack_documents(docs: DataFrame, tokenizer: str, end_id: int = 1, packing: Packing = Packing()) -> DataFrame:
    """Every id of docs(doc_id, text) in exactly one piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    Null texts count as empty; rows that repeat a doc_id are cut and packed each.
    """
    return pack(written(token_pieces(docs, tokenizer, end_id, packing.capacity), "token-pieces"), packing)
