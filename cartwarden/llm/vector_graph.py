"""Embedding near-dup by a flat graph with robustly pruned edges.

Vectors of a label are dealt to cluster shards, each to its nearest and its second cluster. Every shard builds a
neighbour graph whose edges are pruned robustly (an edge goes where a kept neighbour is clearly nearer to its end);
the adjacency lists of a vector from both shards are united. Each vector then searches the shards of its nearest
clusters: a greedy search from the shard's medoids, and from itself where it is a member, expands its range to all
neighbours within the threshold. Cosines are verified in double precision. Only counts and a forest of links leave a task.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import written
from .components import components, forest


@dataclass(frozen=True)
class Graph:
    """threshold: least cosine of a link. shard_rows: vectors a cluster should have; a cluster of over four times as
    many is dealt to splits, all of which are searched. sample and centroids bound what the clusters are fitted on and
    how many there are in all; the rest of the fields are the graph's degree, candidates, slack, beam and probes."""

    threshold: float = 0.93
    shard_rows: int = 1024
    sample: int = 20_000
    centroids: int = 2048
    labels: int = 256
    degree: int = 24
    candidates: int = 48
    far: int = 8
    slack: float = 1.2
    beam: int = 16
    medoids: int = 16
    probes: int = 3


def sound() -> Column:
    """Whether a vector can link: label and vec_id not null, components present and finite, not all zero."""
    v = F.col("vector")
    return (
        F.col("label").isNotNull() & F.col("vec_id").isNotNull() & v.isNotNull()
        & F.coalesce(F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))), F.lit(False))
        & F.exists(v, lambda x: x != 0)
    )


def unit(vectors) -> np.ndarray:
    found = np.array(list(vectors), np.float64)
    found /= np.abs(found).max(axis=1, keepdims=True)  # so that squares neither overflow nor vanish
    return found / np.sqrt(np.einsum("ij,ij->i", found, found))[:, None]


def cluster(points: np.ndarray, k: int, turns: int = 6) -> np.ndarray:
    """k centroids of unit vectors by spherical k-means, from every (n / k)-th point."""
    centres = points[(np.arange(k) * len(points)) // k].copy()
    for _ in range(turns):
        own = (points @ centres.T).argmax(axis=1)
        sums = np.zeros_like(centres)
        np.add.at(sums, own, points)
        norms = np.linalg.norm(sums, axis=1, keepdims=True)
        centres = np.where(norms > 1e-12, sums / np.maximum(norms, 1e-12), centres)
    return centres


def build_graph(x: np.ndarray, graph: Graph) -> np.ndarray:
    """Adjacency of unit vectors, padded with -1: nearest candidates and some far ones, robustly pruned, both ways."""
    n = len(x)
    k = min(graph.candidates, n - 1)
    if k < 1:
        return np.full((n, 1), -1)
    rng = np.random.default_rng(n)
    near = np.empty((n, k), np.int64)
    cosine = np.empty((n, k))
    out = np.full((n, graph.degree + graph.far), -1)
    for at in range(0, n, 256):
        rows = np.arange(at, min(at + 256, n))
        sims = x[rows] @ x.T
        sims[np.arange(len(rows)), rows] = -np.inf
        best = np.argpartition(-sims, k - 1, axis=1)[:, :k]
        value = np.take_along_axis(sims, best, axis=1)
        order = np.argsort(-value, axis=1)
        near[rows], cosine[rows] = np.take_along_axis(best, order, axis=1), np.take_along_axis(value, order, axis=1)
        alive = np.ones((len(rows), k), bool)
        each = np.arange(len(rows))
        for r in range(min(graph.degree, k)):
            has = alive.any(axis=1)
            if not has.any():
                break
            pick = alive.argmax(axis=1)
            chosen = near[rows, pick]
            out[rows, r] = np.where(has, chosen, -1)
            alive[each, pick] = False
            between = np.einsum("ikd,id->ik", x[near[rows]], x[chosen])
            alive &= ~(graph.slack * (1 - between) <= (1 - cosine[rows]))
    out[:, graph.degree :] = rng.integers(0, n, (n, graph.far))
    # edges back, a degree's worth each
    source, end = np.repeat(np.arange(n), out.shape[1]), out.ravel()
    used = (end >= 0) & (end != source)
    source, end = source[used], end[used]
    order = np.argsort(end, kind="stable")
    source, end = source[order], end[order]
    first = np.searchsorted(end, np.arange(n))
    place = np.arange(len(end)) - first[end]
    back = np.full((n, out.shape[1]), -1)
    fits = place < out.shape[1]
    back[end[fits], place[fits]] = source[fits]
    return np.concatenate([out, back], axis=1)


def spread(x: np.ndarray, many: int) -> np.ndarray:
    """The medoid, then the vectors farthest from those chosen."""
    chosen = [int((x @ x.mean(axis=0)).argmax())]
    nearest = x @ x[chosen[0]]
    for _ in range(min(many, len(x)) - 1):
        chosen.append(int(nearest.argmin()))
        nearest = np.maximum(nearest, x @ x[chosen[-1]])
    return np.array(chosen)


def search(x: np.ndarray, edges: np.ndarray, queries: np.ndarray, own: np.ndarray, graph: Graph) -> tuple[np.ndarray, np.ndarray]:
    """(query, node) pairs of cosine >= threshold that a greedy search with range expansion finds; own: the query's node or -1."""
    n, m = len(x), len(queries)
    starts = spread(x, graph.medoids)
    seen = np.zeros((m, n), bool)
    found_q, found_n = [], []

    def visit(q: np.ndarray, node: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """New (query, node, cosine) of these pairs; marks them and keeps those in range."""
        fresh = (node >= 0) & ~seen[q, node]
        code = np.unique(q[fresh] * n + node[fresh])
        q, node = code // n, code % n
        seen[q, node] = True
        cosine = np.empty(len(q))
        for at in range(0, len(q), 1 << 15):
            part = slice(at, at + (1 << 15))
            cosine[part] = np.einsum("ij,ij->i", queries[q[part]], x[node[part]])
        near = cosine >= graph.threshold
        found_q.append(q[near])
        found_n.append(node[near])
        return q, node, cosine

    def merged(beam: np.ndarray, value: np.ndarray, done: np.ndarray, q, node, cosine):
        """The beams with new nodes: the best of each query."""
        place = np.arange(len(q)) - np.searchsorted(q, q)
        wide = int(place.max()) + 1 if len(q) else 0
        more, worth = np.full((m, wide), -1), np.full((m, wide), -np.inf)
        more[q, place], worth[q, place] = node, cosine
        beam, value = np.concatenate([beam, more], axis=1), np.concatenate([value, worth], axis=1)
        done = np.concatenate([done, np.zeros((m, wide), bool)], axis=1)
        best = np.argsort(-value, axis=1, kind="stable")[:, : graph.beam]
        return np.take_along_axis(beam, best, 1), np.take_along_axis(value, best, 1), np.take_along_axis(done, best, 1)

    everyone = np.arange(m)
    entry = np.concatenate([np.tile(starts, (m, 1)), own[:, None]], axis=1)
    state = merged(np.full((m, 0), -1), np.full((m, 0), -np.inf), np.zeros((m, 0), bool), *visit(np.repeat(everyone, entry.shape[1]), entry.ravel()))
    while True:
        beam, value, done = state
        todo = ~done & (beam >= 0)
        active = np.flatnonzero(todo.any(axis=1))
        if not len(active):
            break
        pick = todo[active].argmax(axis=1)
        node = beam[active, pick]
        done[active, pick] = True
        after = edges[node]
        state = merged(beam, value, done, *visit(np.repeat(active, after.shape[1]), after.ravel()))
    frontier_q, frontier_n = np.concatenate(found_q), np.concatenate(found_n)
    while len(frontier_q):
        next_q, next_n = [], []
        for at in range(0, len(frontier_q), 4096):
            after = edges[frontier_n[at : at + 4096]]
            q, node, cosine = visit(np.repeat(frontier_q[at : at + 4096], after.shape[1]), after.ravel())
            next_q.append(q[cosine >= graph.threshold])
            next_n.append(node[cosine >= graph.threshold])
        frontier_q, frontier_n = np.concatenate(next_q), np.concatenate(next_n)
    return np.concatenate(found_q), np.concatenate(found_n)


def _centroids(points: DataFrame, graph: Graph) -> dict[tuple, np.ndarray]:
    """Clusters of the labels that need more than one, fitted on a bounded sample (least hashes of the ids)."""
    large = (
        points.groupBy("label", "size").agg(F.count("*").alias("n")).where(F.col("n") > graph.shard_rows)
        .orderBy(F.desc("n"), "label", "size").limit(graph.labels).collect()
    )
    total = sum(r["n"] for r in large)
    if not large:
        return {}
    rows = points.select("label", "size", "id", "vector").orderBy(F.xxhash64("id")).limit(graph.sample).collect()
    out = {}
    for r in large:
        own = [s["vector"] for s in sorted(rows, key=lambda s: s["id"]) if (s["label"], s["size"]) == (r["label"], r["size"])]
        k = min(-(-r["n"] // graph.shard_rows), max(1, graph.centroids * r["n"] // total), max(1, len(own) // 8))
        if k > 1:
            out[r["label"], r["size"]] = cluster(unit(own), k)
    return out


def _cells(centres: dict, probes: int):
    def near(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            cells = np.empty(len(batch), object)
            for key, at in batch.reset_index(drop=True).groupby(["label", "size"]).indices.items():
                found = centres.get((key[0], int(key[1])))
                if found is None:
                    for i in at:
                        cells[i] = [0]
                else:
                    sims = unit(batch["vector"].iloc[at]) @ found.T
                    for i, best in zip(at, np.argsort(-sims, axis=1)[:, :probes], strict=True):
                        cells[i] = best.tolist()
            yield batch[["id", "label", "size", "copies", "vector"]].assign(cells=cells)

    return near


def _built(graph: Graph):
    def build(rows: pd.DataFrame) -> pd.DataFrame:
        ids = rows["id"].to_numpy()
        edges = build_graph(unit(rows["vector"]), graph)
        return pd.DataFrame({"id": ids, "next": [np.unique(ids[e[e >= 0]]) for e in edges]})

    return build


def _searched(graph: Graph):
    def find(rows: pd.DataFrame) -> pd.DataFrame:
        members = rows[rows["member"]].sort_values("id")
        none = pd.DataFrame({"id": np.empty(0, np.int64), "other": np.empty(0, np.int64), "links": np.empty(0, np.int64)})
        if not len(members):
            return none
        ids, x = members["id"].to_numpy(), unit(members["vector"])
        home, copies = members["home"].to_numpy(bool), members["copies"].to_numpy()
        lists = [np.asarray(v if v is not None else [], np.int64) for v in members["next"]]
        edges = np.full((len(ids), max(max(map(len, lists)), 1)), -1)
        for i, after in enumerate(lists):  # edges to members of other shards aren't followed here
            at = np.searchsorted(ids, after)
            at = at[(at < len(ids)) & (ids[np.minimum(at, len(ids) - 1)] == after)]
            edges[i, : len(at)] = at
        queries = rows["id"].to_numpy()
        own = np.searchsorted(ids, queries)
        own = np.where((own < len(ids)) & (ids[np.minimum(own, len(ids) - 1)] == queries), own, -1)
        out = [none]
        a, b = np.empty(0, np.int64), np.empty(0, np.int64)
        for at in range(0, len(queries), 256):
            part = slice(at, at + 256)
            q, node = search(x, edges, unit(rows["vector"].iloc[part]), own[part], graph)
            keep = home[node] & (ids[node] != queries[part][q])  # each neighbour counts in its own shard alone
            q, node = q[keep], node[keep]
            links = np.bincount(q, copies[node], len(queries[part])).astype(np.int64)
            some = links > 0
            out.append(pd.DataFrame({"id": queries[part][some], "other": -1, "links": links[some]}))
            a, b = forest(np.concatenate([a, queries[part][q]]), np.concatenate([b, ids[node]]))
        out.append(pd.DataFrame({"id": a, "other": b, "links": 0}))
        return pd.concat(out)

    return find


def near_vectors(vectors: DataFrame, graph: Graph = Graph()) -> DataFrame:
    """vectors(vec_id, embedding, label) -> (vec_id, n_links, component_id, kept) for every row.

    Two vectors link if their labels are equal and their cosine is the threshold at least. Equal vectors of a label
    are one point of the graph, so copies link without a search. Vectors that can't link (see ``sound``), and rows
    with a null vec_id, have no links and are their own component. Rows that repeat vec_id, label and embedding are
    one vector and have the same result each. Labels of any type that casts to text will do. Vectors of different lengths don't link. Other columns are not looked at.
    """
    rows = vectors.select("vec_id", F.col("label").cast("string").alias("label"), F.col("embedding").cast("array<double>").alias("vector"))
    usable = rows.where(sound()).distinct()
    points = written(
        usable.groupBy("label", "vector").agg(F.min("vec_id").alias("id"), F.count_distinct("vec_id").alias("copies")).withColumn("size", F.size("vector")),
        "vector-points",
    )
    centres = _centroids(points, graph)  # bounded by graph.centroids
    placed = written(
        points.select("id", "label", "size", "copies", "vector").mapInPandas(_cells(centres, graph.probes), "id long, label string, size int, copies long, vector array<double>, cells array<int>"),
        "vector-cells",
    )
    splits = placed.groupBy("label", "size", F.col("cells")[0].alias("cell")).agg(F.count("*").alias("n")).select(
        "label", "size", "cell", F.when(F.col("n") > 4 * graph.shard_rows, F.ceil(F.col("n") / (2 * graph.shard_rows))).otherwise(1).cast("int").alias("splits")
    )
    spots = written(
        placed.select("*", F.posexplode("cells").alias("near", "cell"))
        .drop("cells")
        .join(splits, ["label", "size", "cell"], "left")
        .withColumn("splits", F.coalesce("splits", F.lit(1)))
        .withColumn("own", F.pmod(F.xxhash64("id"), F.col("splits")).cast("int"))
        .withColumn("split", F.explode(F.sequence(F.lit(0), F.col("splits") - 1)))
        .withColumn("member", (F.col("near") < 2) & (F.col("split") == F.col("own")))
        .withColumn("home", (F.col("near") == 0) & F.col("member"))
        .select("label", "size", "cell", "split", "id", "copies", "vector", "member", "home"),
        "vector-spots",
    )
    shard = ["label", "size", "cell", "split"]
    adjacency = (
        spots.where("member").groupBy(*shard).applyInPandas(_built(graph), "id long, next array<long>")
        .groupBy("id").agg(F.array_distinct(F.flatten(F.collect_list("next"))).alias("next"))  # two shards' lists at most
    )
    found = written(
        spots.join(written(adjacency, "vector-adjacency"), "id", "left").groupBy(*shard).applyInPandas(_searched(graph), "id long, other long, links long"),
        "vector-links",
    )
    tied = components(found.where("other >= 0 or links = 0").select(F.col("id").alias("a"), F.col("other").alias("b")), "vector-components")
    links = found.where("links > 0").groupBy("id").agg(F.sum("links").alias("links"))
    result = (
        points.select("label", "vector", "id", "copies")
        .join(links, "id", "left")
        .join(tied.withColumnRenamed("node", "id"), "id", "left")
        .select("label", "vector", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("links"), F.coalesce("component", "id").alias("component"))
    )
    can = sound()
    return (
        rows.withColumn("can", can)
        .join(result.withColumn("can", F.lit(True)), ["label", "vector", "can"], "left")
        .select(
            "vec_id",
            F.coalesce("links", F.lit(0)).cast("long").alias("n_links"),
            F.coalesce("component", "vec_id").alias("component_id"),
        )
        .withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))
    )


def audit_recall(vectors: DataFrame, result: DataFrame, graph: Graph = Graph(), every: int = 100, block: int = 1000) -> tuple[int, int]:
    """(links found, links there) of the vectors whose vec_id is divisible by ``every``, by brute force against all rows.

    The queries are brought in blocks; each block is set against every vector, a task counting its own.
    """
    rows = vectors.select("vec_id", "label", F.col("embedding").cast("array<double>").alias("vector")).where(sound()).distinct()
    chosen, there = [], 0
    ask = rows.where(F.col("vec_id") % every == 0)

    def count(queries: list) -> int:
        by_key: dict[tuple, list] = {}
        for q in queries:
            by_key.setdefault((q["label"], len(q["vector"])), []).append(q)
        asked = {k: (np.array([q["vec_id"] for q in qs]), unit(q["vector"] for q in qs)) for k, qs in by_key.items()}

        def near(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                n = 0
                for key, own in batch.groupby([batch["label"], batch["vector"].map(len)]):
                    if key in asked:
                        ids, x = asked[key]
                        n += int(((unit(own["vector"]) @ x.T >= graph.threshold) & (own["vec_id"].to_numpy()[:, None] != ids)).sum())
                yield pd.DataFrame({"n": [n]})

        return rows.mapInPandas(near, "n long").agg(F.sum("n")).first()[0] or 0

    for row in ask.toLocalIterator():
        chosen.append(row)
        if len(chosen) == block:
            there, chosen = there + count(chosen), []
    if chosen:
        there += count(chosen)
    found = result.where(F.col("vec_id") % every == 0).agg(F.sum("n_links")).first()[0] or 0
    return found, there
