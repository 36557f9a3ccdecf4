"""SimHash fingerprints and near-dup groups by BK-trees.

A BK-tree holds fingerprints; a node's children are keyed by their Hamming distance to it, and a search within radius
r follows from a node at distance d only the edges d - r to d + r. One tree over all fingerprints can't be broadcast
when fingerprints grow with the corpus, so they are dealt to shard trees by a route: fingerprints within r bits agree
on one of r + 1 blocks of bits, hence a tree for each block value finds every link, and each tree travels to the task
of its shard alone.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import pandas_udf

from .common import row_key, written
from .components import components, forest

#: The seed of the shingle hash, and the parameters of the contract.
SEED, WORDS, RADIUS = 42, 3, 2
_LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")
#: Shingles that are turned into bits at once.
_BLOCK = 1 << 16


def shingle_hashes(text: str | None, words: int) -> np.ndarray:
    """XXH64 of each word shingle of the A-Z lower-cased text, repeats included; one of fewer words if that is all."""
    parts = (text or "").encode("utf-8", "surrogatepass").translate(_LOWER).split()
    if not parts:
        return np.empty(0, np.uint64)
    shingles = [b" ".join(parts)] if len(parts) < words else map(b" ".join, zip(*(parts[i:] for i in range(words)), strict=False))
    digest = xxhash.xxh64_intdigest
    return np.array([digest(s, SEED) for s in shingles], np.uint64)


def fingerprint(hashes: np.ndarray) -> int:
    """The bits that are set in over half the hashes; zero without any."""
    counts = np.zeros(64, np.int64)
    for at in range(0, len(hashes), _BLOCK):
        block = hashes[at : at + _BLOCK]
        counts += np.unpackbits(block.view(np.uint8).reshape(len(block), 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bits = (2 * counts > len(hashes)).astype(np.uint8)
    return int(np.packbits(bits, bitorder="little").view(np.int64)[0])


def fingerprint_udf(words: int = WORDS):
    @pandas_udf("long")
    def simhash(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in texts:
            yield pd.Series([fingerprint(shingle_hashes(text, words)) for text in batch], dtype="int64")

    return simhash


def popcount(x: np.ndarray) -> np.ndarray:
    return np.bitwise_count(x.view(np.uint64)).astype(np.int64)


class BKTree:
    """A BK-tree over distinct int64 fingerprints, built and searched a level at a time over arrays.

    Nodes are numbered in the order they enter; edge codes parent * 65 + distance are sorted, so that a child is found
    by binary search.
    """

    def __init__(self, points: np.ndarray):
        self.points = points
        parent = np.full(len(points), -1)
        key = np.zeros(len(points), np.int64)
        rest, group = np.arange(1, len(points)), np.zeros(max(len(points) - 1, 0), np.int64)
        while len(rest):  # group: the node that each point has come to
            distance = popcount(points[rest] ^ points[group])
            code = group * 65 + distance
            _, first, inverse = np.unique(code, return_index=True, return_inverse=True)
            node = rest[first]
            parent[node], key[node] = group[first], distance[first]
            stays = np.ones(len(rest), bool)
            stays[first] = False
            rest, group = rest[stays], node[inverse[stays]]
        children = np.arange(1, len(points))
        codes = parent[1:] * 65 + key[1:]
        order = np.argsort(codes, kind="stable")
        self.codes, self.child = codes[order], children[order]

    def search(self, queries: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
        """(query index, point index) of all pairs within the radius."""
        at, node = np.arange(len(queries)), np.zeros(len(queries), np.int64)
        found: list[tuple[np.ndarray, np.ndarray]] = []
        while len(at) and len(self.points):
            distance = popcount(queries[at] ^ self.points[node])
            near = distance <= radius
            found.append((at[near], node[near]))
            low = np.searchsorted(self.codes, node * 65 + np.maximum(distance - radius, 0), "left")
            high = np.searchsorted(self.codes, node * 65 + np.minimum(distance + radius, 64), "right")
            many = high - low
            step = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
            at, node = np.repeat(at, many), self.child[np.repeat(low, many) + step]
        return (np.concatenate([f[0] for f in found]), np.concatenate([f[1] for f in found])) if found else (at, node)


#: Queries that search a tree at once.
_QUERIES = 1024


def tree_links(points: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """A forest (a, b) that joins the points as all their links within the radius would."""
    tree = BKTree(points)
    a, b = np.empty(0, np.int64), np.empty(0, np.int64)
    for at in range(0, len(points), _QUERIES):
        query, point = tree.search(points[at : at + _QUERIES], radius)
        other = query + at != point
        a, b = forest(np.concatenate([a, points[query[other] + at]]), np.concatenate([b, points[point[other]]]))
    return a, b


def shard_links(radius: int):
    """For a shard's rows (route, fingerprint): a tree for each route value, and its links."""

    def find(shard: pd.DataFrame) -> pd.DataFrame:
        routes, points = shard["route"].to_numpy(), shard["fingerprint"].to_numpy()
        order = np.lexsort((points, routes))
        routes, points = routes[order], points[order]
        edge = np.flatnonzero(np.r_[True, routes[1:] != routes[:-1], True])
        found = [tree_links(points[s:e], radius) for s, e in zip(edge[:-1], edge[1:], strict=True) if e - s > 1]
        none = np.empty(0, np.int64)  # not [], which would make floats of the fingerprints
        return pd.DataFrame({"a": np.concatenate([none, *(f[0] for f in found)]), "b": np.concatenate([none, *(f[1] for f in found)])})

    return find


def _blocks(bits, low: int, high: int, parts: int) -> list:
    """The bits low..high of a long column as ``parts`` blocks."""
    edges = np.linspace(low, high, parts + 1).astype(int).tolist()
    return [F.shiftrightunsigned(bits, s).bitwiseAND(F.lit((1 << (e - s)) - 1)) for s, e in zip(edges[:-1], edges[1:], strict=True)]


def block_routes(radius: int):
    """The r + 1 blocks of a fingerprint column, as structs of a long and the fingerprint's other bits: two within r bits share at least one."""
    edges = np.linspace(0, 64, radius + 2).astype(int).tolist()
    out = []
    for i, (low, high, block) in enumerate(zip(edges[:-1], edges[1:], _blocks(F.col("fingerprint"), 0, 64, radius + 1), strict=True)):
        below = F.col("fingerprint").bitwiseAND(F.lit((1 << low) - 1))
        above = F.shiftleft(F.shiftrightunsigned("fingerprint", high), low) if high < 64 else F.lit(0).cast("long")
        out.append(F.struct(F.xxhash64(F.lit(i), block).alias("route"), below.bitwiseOR(above).alias("others"), F.lit(64 - high + low).alias("width")))
    return F.array(*out)


#: A route of more fingerprints than this is split by blocks of its other bits.
ROUTE_ROWS = 4096


def fingerprint_links(distinct: DataFrame, radius: int, shard_rows: int = 4096, route_rows: int = ROUTE_ROWS) -> DataFrame:
    """Links (a, b) between distinct(fingerprint long) that join what all links within the radius would join.

    Routes that one fingerprint alone has are left out. A route of over route_rows fingerprints is split once more: of
    those that agree on its block, two within the radius also agree on one of r + 1 blocks of the other bits. Routes
    are dealt to shards of about shard_rows.
    """
    routed = written(distinct.select("fingerprint", F.explode_outer(block_routes(radius)).alias("r")).select("fingerprint", "r.*"), "simhash-routes")
    counts = written(routed.groupBy("route").agg(F.count("*").alias("n")).where("n > 1"), "simhash-route-counts")
    met = routed.join(counts, "route")
    width = 64 - 64 // (radius + 1) - 1  # no more bits than every route has besides its block
    finer = F.array(*[F.xxhash64("route", F.lit(i), b) for i, b in enumerate(_blocks(F.col("others"), 0, width, radius + 1))])
    split = met.where(F.col("n") > route_rows).select("fingerprint", F.explode(finer).alias("route"))
    met = written(met.where(F.col("n") <= route_rows).select("fingerprint", "route").union(split), "simhash-shared")
    shards = max(1, met.count() // shard_rows + 1)
    return (
        met.withColumn("shard", F.pmod("route", F.lit(shards)))
        .repartition(shards, "shard")  # a stated count: Spark doesn't merge these into a few tasks
        .groupBy("shard")
        .applyInPandas(shard_links(radius), "a long, b long")
    )


def near_dup_groups(docs: DataFrame, words: int = WORDS, radius: int = RADIUS, route_rows: int = ROUTE_ROWS) -> DataFrame:
    """docs(doc_id, text) -> (doc_id, fingerprint long, component_id) for every row.

    component_id is the least doc_id of the documents reachable over links of at most ``radius`` differing bits, null
    doc_ids aside (a group of nothing else has none). Null and empty texts have fingerprint zero and link like any
    other; equal fingerprints are one point, so copies cost nothing. Other columns are not looked at.
    """
    marked = written(docs.select("doc_id", fingerprint_udf(words)("text").alias("fingerprint")), "simhash-fingerprints")
    points = marked.groupBy("fingerprint").agg(F.min("doc_id").alias("least"))
    points = written(points, "simhash-points")
    tied = components(fingerprint_links(points.select("fingerprint"), radius, route_rows=route_rows), "simhash-components")
    joined = points.join(tied, points["fingerprint"] == tied["node"], "left").select(
        "fingerprint", "least", F.coalesce("component", "fingerprint").alias("component")
    )
    joined = written(joined, "simhash-joined")
    least = joined.groupBy("component").agg(F.min("least").alias("component_id"))
    named = joined.join(least, "component").select("fingerprint", "component_id")
    return marked.join(named, "fingerprint").select("doc_id", "fingerprint", "component_id")


# Near copies by word shingles: equal blocks of bits would need a radius that no longer prunes, so shard trees are
# routed by shared shingle minima instead, and what a tree finds is verified on the shingles themselves.

#: Minima by which documents are routed (two of Jaccard similarity 0.8 share none of them once in 600), and minima in all.
ROUTES, MINIMA = 4, 12
#: Differing bits within which a tree is searched for documents of similarity 0.8: over three deviations above the ten expected.
WIDE_RADIUS = 24
#: Most documents of a route that are compared in one group; larger routes are split.
GROUP_ROWS = 1024
#: Queries that search a tree at once within the wide radius, which reaches most of the tree.
_WIDE_QUERIES = 128
_MIX = np.array([pow(0x9E3779B97F4A7C15, i + 1, 1 << 64) for i in range(MINIMA)], np.uint64)


def minima(hashes: np.ndarray) -> list[int]:
    """The least of the hashes under MINIMA mixings; nothing for an empty text."""
    out = []
    for i in range(MINIMA if len(hashes) else 0):
        x = (hashes ^ (hashes >> np.uint64(31))) * _MIX[i]
        out.append(int((x ^ (x >> np.uint64(33))).min().view(np.int64)))
    return out


def shingle_set(text: str | None, words: int) -> np.ndarray:
    """The distinct shingle hashes, sorted."""
    return np.unique(shingle_hashes(text, words))


_SIGNED = T.StructType([
    T.StructField("fingerprint", T.LongType()),
    T.StructField("minima", T.ArrayType(T.LongType())),
    T.StructField("point", T.StringType()),
])


def signed_udf(words: int):
    """fingerprint, minima, and point: 128 bits of hash of the set of shingles, which equal sets share."""

    @pandas_udf(_SIGNED)
    def signed(texts: pd.Series) -> pd.DataFrame:
        rows = []
        for text in texts:
            hashes = shingle_set(text, words)  # repeats don't count: all three follow from the set
            rows.append((fingerprint(hashes), minima(hashes), hashlib.blake2b(hashes.tobytes(), digest_size=16).hexdigest()))
        return pd.DataFrame(rows, columns=["fingerprint", "minima", "point"])

    return signed


def shingles_udf(words: int):
    """The sorted distinct shingles by the low halves of their hashes, which tell them apart within a pair."""

    @pandas_udf("array<int>")
    def shingles(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in texts:
            yield pd.Series([np.unique(shingle_hashes(text, words).astype(np.uint32).view(np.int32)) for text in batch], dtype=object)

    return shingles


def _verified(similarity: float, radius: int):
    """For a shard's rows (route, point, fingerprint, shingles): links of points whose shingle sets are similar enough."""

    def find(shard: pd.DataFrame) -> pd.DataFrame:
        out: list[tuple[str, str]] = []
        for _, group in shard.groupby("route"):
            if len(group) < 2:
                continue
            points, sets = group["point"].to_numpy(), [np.asarray(s) for s in group["shingles"]]
            prints, at = np.unique(group["fingerprint"].to_numpy(), return_inverse=True)
            order, starts = np.argsort(at, kind="stable"), np.cumsum(np.bincount(at)) - np.bincount(at)
            holders = np.split(order, starts[1:])
            sizes = np.array([len(v) for v in sets])
            _, codes = np.unique(np.concatenate(sets), return_inverse=True)
            ends = np.cumsum(sizes)
            listed = np.argsort(codes, kind="stable")  # who holds each shingle, shingle by shingle
            holder = np.repeat(np.arange(len(sets)), sizes)[listed]
            low = np.concatenate([[0], np.cumsum(np.bincount(codes))])
            root = np.arange(len(points))

            def join(i: int, others: np.ndarray, ends=ends, sizes=sizes, codes=codes, low=low, holder=holder, root=root, points=points) -> None:
                """Links i to those of the others that are similar enough and not joined to it yet; one count serves them all."""
                others = others[root[others] != root[i]]
                if not len(others):
                    return
                own = codes[ends[i] - sizes[i] : ends[i]]
                many = low[own + 1] - low[own]
                step = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
                both = np.bincount(holder[np.repeat(low[own], many) + step], minlength=len(sizes))[others]
                for j in others[both >= similarity * (sizes[i] + sizes[others] - both)]:
                    if root[i] != root[j]:
                        out.append((points[i], points[j]))
                        root[root == max(root[i], root[j])] = min(root[i], root[j])

            for held in holders:
                for k in range(1, len(held)):
                    join(held[k], held[:k])
            tree = BKTree(prints)
            for first in range(0, len(prints), _WIDE_QUERIES):
                query, near = tree.search(prints[first : first + _WIDE_QUERIES], radius)
                query += first
                keep = near > query
                query, near = query[keep], near[keep]
                by = np.argsort(query, kind="stable")
                query, near = query[by], near[by]
                cut = np.flatnonzero(np.r_[True, query[1:] != query[:-1], True]) if len(query) else np.zeros(1, np.int64)
                for s, e in zip(cut[:-1], cut[1:], strict=True):
                    others = np.concatenate([holders[p] for p in near[s:e]])
                    for i in holders[query[s]]:
                        join(i, others)
        return pd.DataFrame(out, columns=["a", "b"])

    return find


def _shared(routed: DataFrame, name: str) -> DataFrame:
    """The rows of the routes that two points have at least, with the route's number of points n."""
    counts = routed.groupBy("route").agg(F.count("*").alias("n")).where("n > 1")
    return written(routed.join(counts, "route"), name)


def _against_pivots(now: DataFrame, sets: DataFrame, similarity: float, group_rows: int) -> tuple[DataFrame, DataFrame]:
    """(rows that remain to be compared, links): one round for routes of over group_rows points.

    Every point of such a route is compared with the route's least point, its pivot, row by row, so no group meets in
    a task. Jaccard distance obeys the triangle inequality: a point linked to the pivot can link to one that isn't only
    if their distances to the pivot differ by no more than the distance of a link. Points linked to the pivot that are
    farther than that from all others leave the route, the pivot always.
    """
    hot = now.where(F.col("n") > group_rows)
    pivots = hot.groupBy("route").agg(F.min("point").alias("pivot"))
    placed = written(hot.join(pivots, "route"), "copies-pivots")
    there = sets.select(F.col("point").alias("pivot"), F.col("shingles").alias("pivot_shingles"))
    both = F.size(F.array_intersect("shingles", "pivot_shingles"))
    compared = written(
        placed.select("point", "pivot").distinct().join(sets, "point").join(there, "pivot")
        .select("point", "pivot", (both / (F.size("shingles") + F.size("pivot_shingles") - both)).alias("alike")),
        "copies-compared",
    )
    rows = placed.join(compared, ["point", "pivot"])
    nearest = rows.where(F.col("alike") < similarity).groupBy("route").agg(F.max("alike").alias("nearest"))
    stays = (F.col("alike") < similarity) | (F.col("alike") <= F.col("nearest") + (1 - similarity) + 1e-9)
    left = rows.join(nearest, "route").where(stays).select("route", "point", "fingerprint")
    counts = left.groupBy("route").agg(F.count("*").alias("n")).where("n > 1")
    remain = now.where(F.col("n") <= group_rows).select(*now.columns).unionByName(left.join(counts, "route").select(*now.columns))
    return written(remain, "copies-remain"), compared.where((F.col("alike") >= similarity) & (F.col("point") != F.col("pivot"))).select(F.col("point").alias("a"), F.col("pivot").alias("b"))


def near_copy_links(docs: DataFrame, points: DataFrame, words: int, similarity: float, radius: int, group_rows: int) -> DataFrame:
    """Links (a, b) of points that join what all links of the similarity between points with a shared minimum would join.

    A route (a minimum) of over group_rows points is split by each other minimum: two of similarity 0.8 that share one
    share none of the other eleven once in 10^7. Where the parts hold as many pairs as the route, as in a large group of
    near copies, whose parts are nearly the same points eleven times, the route stays whole. Points of what is still too
    large are compared with pivots for some rounds; what then remains of too large a route is cut into blocks, and each
    two blocks are one group. No group has many more than group_rows points.
    """
    least = points.select("point", "fingerprint", "minima", F.posexplode(F.slice("minima", 1, ROUTES)).alias("i", "least"))
    routed = _shared(least.select("point", "fingerprint", "minima", "i", F.xxhash64("i", "least").alias("route")), "copies-routes")
    finer = (
        routed.where(F.col("n") > group_rows)
        .select("point", "fingerprint", "route", "i", F.col("n").alias("whole"), F.posexplode("minima").alias("k", "other")).where("i <> k")
        .select("point", "fingerprint", "route", "whole", F.xxhash64("route", "k", "other").alias("part"))
    )
    parts = written(finer.groupBy("route", "whole", "part").agg(F.count("*").alias("n")), "copies-parts")
    dense = parts.groupBy("route").agg((F.sum(F.col("n") * F.col("n")) >= F.max("whole") * F.max("whole")).alias("dense"))
    dense = written(dense, "copies-dense")
    columns = ["route", "point", "fingerprint", "n"]
    split = finer.join(dense.where("not dense"), "route", "left_semi").drop("route").join(parts.where("n > 1").select("part", "n"), "part").withColumnRenamed("part", "route")
    now = routed.where(F.col("n") <= group_rows).select(*columns).unionByName(routed.join(dense.where("dense"), "route", "left_semi").select(*columns)).unionByName(split.select(*columns))
    now = written(now, "copies-met")
    first = points.select("point", F.col("first.row").alias("__row"))
    texts = docs.select(row_key().alias("__row"), "text")

    def sets_of(rows: DataFrame) -> DataFrame:
        wanted = first.join(rows.select("point").distinct(), "point", "left_semi")
        return texts.join(wanted.hint("merge"), "__row").dropDuplicates(["point"]).select("point", shingles_udf(words)("text").alias("shingles"))

    links, sets, before = [], None, None
    for _ in range(8):
        hot = now.where(F.col("n") > group_rows)
        rows = hot.count()
        if not rows or before is not None and rows > 0.75 * before:
            break
        before = rows
        sets = written(sets_of(hot), "copies-sets") if sets is None else sets
        now, found = _against_pivots(now, sets, similarity, group_rows)
        links.append(found)
    half = group_rows // 2
    blocks = F.when(F.col("n") > group_rows, F.ceil(F.col("n") * 1.25 / half)).otherwise(1).cast("int")
    dealt = (
        now.withColumn("blocks", blocks).withColumn("own", F.pmod(F.xxhash64("point"), F.col("blocks")).cast("int"))
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        .where((F.col("blocks") == 1) | (F.col("own") != F.col("other")))  # a block is in the groups with the others
        .select("point", "fingerprint", F.when(F.col("blocks") == 1, F.col("route")).otherwise(F.xxhash64("route", F.least("own", "other"), F.greatest("own", "other"))).alias("route"))
    )
    dealt = written(dealt.groupBy("point", "fingerprint").agg(F.collect_set("route").alias("routes")), "copies-dealt")
    shards = (dealt.agg(F.sum(F.size("routes"))).first()[0] or 0) // 512 + 1  # rows, not points: one may have many routes
    grouped = (
        sets_of(dealt).join(dealt.hint("merge"), "point")
        .select("point", "fingerprint", "shingles", F.explode("routes").alias("route"))
        .withColumn("shard", F.pmod("route", F.lit(shards)))
        .repartition(shards, "shard")
        .groupBy("shard")
        .applyInPandas(_verified(similarity, radius), "a string, b string")
    )
    for found in links:
        grouped = grouped.union(found)
    return grouped


def drop_near_dups(docs: DataFrame, words: int = 5, similarity: float = 0.8, radius: int = WIDE_RADIUS, group_rows: int = GROUP_ROWS) -> DataFrame:
    """The rows of docs(doc_id, text, ...) that stay: one document, of least (doc_id, row), of each group of near copies.

    Two documents are near copies if their sets of word shingles have a Jaccard similarity of ``similarity`` or more; a
    group is what such links reach. Documents meet in a shard tree by a shared minimum of their shingles, and within
    ``radius`` bits of fingerprint their sets are compared. Null and empty texts are copies of each other; of rows
    that repeat doc_id and text one stays. All columns pass through, whatever their names.
    """
    names = [f"c{i}" for i in range(len(docs.columns))]
    plain = docs.toDF(*names).withColumns({c: F.col(names[docs.columns.index(c)]) for c in ("doc_id", "text")})
    marked = written(plain.select("doc_id", row_key().alias("row"), signed_udf(words)("text").alias("s")).select("doc_id", "row", "s.*"), "copies-marked")
    points = written(
        marked.groupBy("point").agg(F.min(F.struct("doc_id", "row")).alias("first"), F.first("fingerprint").alias("fingerprint"), F.first("minima").alias("minima")),
        "copies-points",
    )
    tied = components(near_copy_links(plain.select("doc_id", "text"), points, words, similarity, radius, group_rows), "copies-components")
    grouped = points.join(tied, points["point"] == tied["node"], "left").select(F.coalesce("component", "point").alias("component"), "first")
    stays = written(grouped.groupBy("component").agg(F.min("first").alias("first")).select(F.col("first.row").alias("row")), "copies-kept")
    kept = plain.withColumn("row", row_key()).join(stays.hint("merge"), "row", "left_semi").dropDuplicates(["row"])
    return kept.select(*[F.col(n).alias(c) for n, c in zip(names, docs.columns, strict=True)])
