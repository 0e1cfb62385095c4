"""Approximate nearest neighbours by largest inner product: a hierarchical navigable small-world graph for each shard.

Equal vectors are one node, which keeps the smallest ids of its copies: as many as a result can hold, so none that could be
found is lost. For inner products of vectors of any norm a coordinate is added that gives all nodes the same norm, and a query
a 0 there: the order stays the same, and nearness among nodes becomes a metric. Nodes are dealt to cells around centroids,
which are fitted to a bounded sample; a cell is a shard, or several if it is large. A shard's graph is stored as flat arrays of
neighbours, level by level. A query goes to the shards of the cells nearest to it, in blocks, as many cells as the sample says
hold its neighbours; the shards' best nodes are merged. So both a node and a query cost the same however many there are, until
the number of centroids reaches its bound.
"""

from __future__ import annotations

import heapq
import io
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import bounded_sample, by_key, saved, table

#: Nodes of a cell as aimed at; and of a shard on average at most (as dealt by a hash), which is what a task builds and holds;
#: centroids at most. A larger cell is several shards, all of which are searched.
CELL_NODES, SHARD_NODES, MOST_CELLS = 16_384, 65_536, 1024
#: Where a query would be searched in more cells than this, as vectors have few clusters, cells grow up to SHARD_NODES: then
#: the shards searched don't become more with the vectors, and a search costs little more in a larger graph.
MOST_SEARCHED = 8
#: Vectors that centroids are fitted to at most, those of them whose neighbours among the sample are looked for in cells, how
#: many neighbours, and the share of these that the cells searched must hold.
SAMPLE, ASKED, LOOKED_FOR, HELD = 20_000, 400, 20, 0.99
#: Links of a node on each upper level (twice as many on the lowest), nearest nodes that they are chosen among, and breadth of
#: the search on the lowest level and above.
LINKS, NEAREST, SEARCH_BREADTH, ENTRIES = 16, 128, 192, 8
#: Query vectors that are searched together in one group, and vectors or results that are broadcast at most.
BLOCK, BROADCAST_VECTORS = 4096, 10_000


class Graph:
    """A graph over the rows of points, all of one norm; nearness is the inner product."""

    def __init__(self, points: np.ndarray, neighbours: list[np.ndarray] | None = None, levels: np.ndarray | None = None, entry: int = 0):
        self.points = points
        self.levels = levels if levels is not None else self._draw_levels(len(points))
        self.entry = entry
        if neighbours is None:
            top = int(self.levels.max(initial=0))
            self.neighbours = [np.full((len(points), LINKS * 2), -1, np.int32) for level in range(top + 1)]
            self._build()
        else:
            self.neighbours = neighbours

    @staticmethod
    def _draw_levels(n: int) -> np.ndarray:
        draws = np.random.default_rng(n).random(n)
        return np.minimum((-np.log(np.maximum(draws, 1e-12)) / math.log(LINKS)).astype(np.int32), 12)

    def search_level(self, query: np.ndarray, starts: list[int], breadth: int, level: int) -> list[tuple[float, int]]:
        """The nearest nodes found, best first, as (value, node)."""
        points, links = self.points, self.neighbours[level]
        seen = np.zeros(len(points), bool)
        seen[starts] = True
        kept = list(zip((points[starts] @ query).tolist(), starts, strict=True))
        open_ = [(-v, x) for v, x in kept]
        heapq.heapify(open_)
        heapq.heapify(kept)
        while open_:
            value, node = heapq.heappop(open_)
            if len(kept) >= breadth and -value < kept[0][0]:
                break
            near = links[node]
            near = near[near >= 0]
            near = near[~seen[near]]
            if not len(near):
                continue
            seen[near] = True
            values = points[near] @ query
            if len(kept) >= breadth:
                better = values > kept[0][0]
                near, values = near[better], values[better]
            for v, x in zip(values.tolist(), near.tolist(), strict=True):
                if len(kept) < breadth:
                    heapq.heappush(kept, (v, x))
                    heapq.heappush(open_, (-v, x))
                elif v > kept[0][0]:
                    heapq.heapreplace(kept, (v, x))
                    heapq.heappush(open_, (-v, x))
        return sorted(kept, reverse=True)

    def _build(self) -> None:
        for level, links in enumerate(self.neighbours):
            nodes = np.flatnonzero(self.levels >= level)
            if len(nodes) > 1:
                self._link(nodes, links)
        self.entry = int(self.levels.argmax()) if len(self.levels) else 0

    def _link(self, nodes: np.ndarray, links: np.ndarray) -> None:
        """Links the nodes of a level: each to LINKS of the nearest ones, those first that are nearer to it than to any taken
        before, then back. All pairs of a shard's nodes are compared, in blocks: a shard has few enough."""
        points = self.points[nodes]
        n, most = len(nodes), min(NEAREST, len(nodes) - 1)
        for at in range(0, n, 256):
            rows = np.arange(at, min(at + 256, n))
            values = points[rows] @ points.T
            values[np.arange(len(rows)), rows] = -np.inf
            near = np.argpartition(values, n - most, axis=1)[:, n - most :] if most < n else np.tile(np.arange(n), (len(rows), 1))
            near = np.take_along_axis(near, np.argsort(-np.take_along_axis(values, near, 1), axis=1, kind="stable"), 1)
            values = np.take_along_axis(values, near, 1)
            among = np.einsum("bid,bjd->bij", points[near], points[near], optimize=True)
            taken = np.zeros(near.shape, bool)
            for k in range(most):
                hidden = ((among[:, k, :k] >= values[:, k, None]) & taken[:, :k]).any(1)
                taken[:, k] = ~hidden & (taken.sum(1) < LINKS)
            order = np.argsort(~taken, axis=1, kind="stable")[:, :LINKS]  # those taken, then the nearest of the rest
            links[nodes[rows], : order.shape[1]] = nodes[np.take_along_axis(near, order, 1)]
        # Back links where there is room, the nearest first.
        width = min(LINKS, most)
        start, end = np.repeat(nodes, width), links[nodes, :width].ravel()
        value = np.einsum("ij,ij->i", self.points[start], self.points[end])
        known = {(a, b) for a, b in zip(start.tolist(), end.tolist(), strict=True)}
        room = (links >= 0).sum(1)
        for k in np.argsort(-value, kind="stable").tolist():
            a, b = int(start[k]), int(end[k])
            if room[b] < links.shape[1] and (b, a) not in known:
                links[b, room[b]] = a
                room[b] += 1

    def search(self, query: np.ndarray, breadth: int) -> list[int]:
        starts = [self.entry]
        for level in range(len(self.neighbours) - 1, 0, -1):
            starts = [x for _, x in self.search_level(query, starts, ENTRIES, level)]
        return [x for _, x in self.search_level(query, starts, breadth, 0)]


def _packed(graph: Graph, vectors: np.ndarray, members: np.ndarray, first: np.ndarray) -> bytes:
    out = io.BytesIO()
    levels = {f"level{i}": x for i, x in enumerate(graph.neighbours)}
    np.savez(out, vectors=vectors, members=members, first=first, levels=graph.levels, entry=np.array(graph.entry), **levels)
    return out.getvalue()


def _augmented(vectors: np.ndarray, square: float) -> np.ndarray:
    """vectors with a coordinate more, after which all have the same norm, the root of ``square``."""
    return np.hstack([vectors, np.sqrt(np.maximum(square - (vectors * vectors).sum(1), 0.0))[:, None]]).astype(np.float32)


def _build_shard(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
    """One shard: its graph and vectors as one value."""
    rows = rows.sort_values("node")
    vectors = np.array(rows["vector"].tolist(), dtype=float)
    sizes = rows["ids"].map(len).to_numpy()
    members, first = np.concatenate(rows["ids"].tolist()).astype(np.int64), np.concatenate(([0], np.cumsum(sizes)))
    graph = Graph(_augmented(vectors, float((vectors * vectors).sum(1).max())))
    return pd.DataFrame({"shard": [key[0]], "graph": [_packed(graph, vectors, members, first)]})


def cells_of(sample: np.ndarray, square: float, count: int) -> tuple[np.ndarray, int]:
    """Centroids for so many nodes, fitted to a sample of them, and how many cells a query is to be searched in.

    The latter is the least number of cells, nearest to the query first, that hold HELD of the nearest vectors of the sample.
    """
    nodes = CELL_NODES
    while True:
        centroids, searched = _cells(sample, square, -(-count // nodes))
        if searched <= MOST_SEARCHED or nodes >= SHARD_NODES:
            return centroids, searched
        nodes *= 2


def _cells(sample: np.ndarray, square: float, aimed: int) -> tuple[np.ndarray, int]:
    points = _augmented(sample, square)
    k = max(1, min(MOST_CELLS, len(points) // 4, aimed))
    draw = np.random.default_rng(k)
    centroids = points[draw.choice(len(points), k, replace=False)]
    for _ in range(8 if k > 1 else 0):
        own = nearest_cells(points, centroids, 1)[:, 0]
        sums = np.stack([np.bincount(own, points[:, d], k) for d in range(points.shape[1])], 1)
        counts = np.bincount(own, minlength=k)
        centroids = np.where(counts[:, None] > 0, sums / np.maximum(counts, 1)[:, None], centroids).astype(np.float32)
    if k == 1:
        return centroids, 1
    own = nearest_cells(points, centroids, 1)[:, 0]
    asked = draw.choice(len(points), min(ASKED, len(points)), replace=False)
    queries = _asking(sample[asked])
    values = queries @ points.T
    values[np.arange(len(asked)), asked] = -np.inf
    near = np.argsort(-values, axis=1)[:, :LOOKED_FOR]
    place = np.argsort(nearest_cells(queries, centroids, k), axis=1)  # of each cell in the query's order
    return centroids, int(np.quantile(np.take_along_axis(place, own[near], 1), HELD, method="higher")) + 1


def _asking(vectors: np.ndarray) -> np.ndarray:
    return np.hstack([vectors, np.zeros((len(vectors), 1))]).astype(np.float32)


def nearest_cells(points: np.ndarray, centroids: np.ndarray, most: int) -> np.ndarray:
    """The nearest centroids of each point, nearest first."""
    far = (centroids * centroids).sum(1)[None, :] - 2 * points @ centroids.T
    return np.argsort(far, axis=1, kind="stable")[:, :most]


def _searcher(k: int, breadth: int):
    def search(index: pd.DataFrame, queries: pd.DataFrame) -> pd.DataFrame:
        out: dict[str, list] = {"query_node": [], "vec_id": [], "score": []}
        if len(index) and len(queries):
            with np.load(io.BytesIO(index["graph"].iloc[0])) as f:
                a = {n: f[n] for n in f.files}
            vectors, members, first = a["vectors"], a["members"], a["first"]
            graph = Graph(_augmented(vectors, float((vectors * vectors).sum(1).max())), [a[f"level{i}"] for i in range(len(a) - 5)], a["levels"], int(a["entry"]))
            for node, vector in zip(queries["node"].tolist(), queries["vector"].tolist(), strict=True):
                query = np.asarray(vector, dtype=float)
                found = graph.search(np.append(query, 0.0).astype(np.float32), breadth)
                scores = vectors[found] @ query
                best: list[tuple[float, int]] = []
                for s, x in zip(scores.tolist(), found, strict=True):
                    best += [(-s, i) for i in members[first[x] : first[x + 1]].tolist()]
                for s, i in heapq.nsmallest(k, best):
                    out["query_node"].append(node)
                    out["vec_id"].append(i)
                    out["score"].append(-s)
        return pd.DataFrame(out).astype({"query_node": "int64", "vec_id": "int64", "score": "float64"})

    return search


def _fitted(nodes: DataFrame) -> dict[int, tuple[np.ndarray, int, float]]:
    """Centroids, cells to search and largest squared norm, by the length of vectors."""
    sums = nodes.select("dim", F.aggregate("vector", F.lit(0.0), lambda s, x: s + x * x).alias("square")).groupBy("dim").agg(F.max("square").alias("square"), F.count("*").alias("n")).collect()  # a row for each length
    longest = max((r["dim"] for r in sums), default=1)
    sample: dict[int, list] = {}
    for r in bounded_sample(nodes, min(SAMPLE, max(100, (1 << 23) // longest)), "node").select("dim", "vector").collect():
        sample.setdefault(r["dim"], []).append(r["vector"])
    out = {}
    for r in sums:
        some = np.array(sample.get(r["dim"], [[0.0] * r["dim"]]), float)
        out[r["dim"]] = (*cells_of(some, r["square"], r["n"]), r["square"])
    return out


def nearest(rows: DataFrame, is_query: str, k: int = 20, breadth: int = SEARCH_BREADTH) -> DataFrame:
    """The k nearest of all rows (vec_id, embedding) but itself to each row for which the SQL condition is_query holds:
    query_id, rank (from 1), vec_id, score.

    Nearest has the largest inner product; of equal ones the smaller vec_id comes first. Vectors that are null, zero or hold
    null or non-finite components take no part, and vectors of other lengths aren't candidates. An empty table gives an
    empty result. A vec_id that repeats stands for one row if its vectors are equal. Other columns are left out.
    """
    whole = F.col("vector").isNotNull() & F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("vector", lambda x: x != 0)
    # x + 0.0 makes -0.0 and 0.0 one value, as they are in every product
    vectors = rows.select(F.col("vec_id").cast("long").alias("vec_id"), F.transform(F.col("embedding").cast("array<double>"), lambda x: x + F.lit(0.0)).alias("vector"), F.expr(is_query).alias("asks")).where(whole)
    vectors = vectors.dropDuplicates(["vec_id", "vector"])
    # The smallest ids of equal vectors; Spark keeps k + 1 of a key in each task before it shuffles them.
    first = vectors.withColumn("_n", F.row_number().over(Window.partitionBy("vector").orderBy("vec_id"))).where(F.col("_n") <= k + 1)
    nodes = saved(first.groupBy("vector").agg(F.array_sort(F.collect_list("vec_id")).alias("ids")).select(F.element_at("ids", 1).alias("node"), "vector", "ids", F.size("vector").alias("dim")), "nodes")
    fitted = _fitted(nodes)
    shared = rows.sparkSession.sparkContext.broadcast(fitted)
    number = {}
    for dim in sorted(fitted):
        number[dim] = sum(len(fitted[d][0]) for d in number)  # of a length's first cell

    def placed(most: bool):
        """The nearest cell of each node; of a query as many as are searched."""

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                batch["cells"] = None
                for dim, part in batch.groupby("dim"):
                    centroids, probes, square = shared.value[dim]
                    vectors = np.array(part["vector"].tolist(), dtype=float)
                    found = nearest_cells(_asking(vectors) if most else _augmented(vectors, square), centroids, probes if most else 1)
                    batch.loc[part.index, "cells"] = pd.Series(list(found + number[dim]), index=part.index)
                yield batch

        return run

    in_cells = saved(nodes.mapInPandas(placed(False), "node long, vector array<double>, ids array<long>, dim int, cells array<int>").select("node", "vector", "ids", F.col("cells")[0].alias("cell")), "cells")
    sizes = in_cells.groupBy("cell").count().orderBy("cell").collect()  # a row for each cell
    parts, total = {}, 0
    for r in sizes:
        parts[r["cell"]] = (total, -(-r["count"] // SHARD_NODES))
        total += parts[r["cell"]][1]
    shards = F.broadcast(rows.sparkSession.createDataFrame([(c, a, n) for c, (a, n) in parts.items()], "cell int, first int, parts int"))
    keyed = in_cells.join(shards, "cell").withColumn("shard", F.col("first") + F.pmod(F.xxhash64("node"), F.col("parts")).cast("int"))
    # Ranges of shards, so that each is a task's whole work.
    index = saved(keyed.select("shard", "node", "vector", "ids").repartitionByRange(max(1, total), "shard").groupBy("shard").applyInPandas(_build_shard, "shard int, graph binary"), "graphs")
    # A vector that very many queries have doesn't meet them in one task.
    asks = vectors.where("asks").select("vec_id", "vector")
    asked = saved(asks.groupBy("vector").agg(F.count("*").alias("copies")).join(nodes, "vector"), "asked")
    asking = saved(by_key(asks, asked.select("vector", "node", "copies"), ["vector"], BROADCAST_VECTORS).select(F.col("vec_id").alias("query_id"), "node"), "queries")
    distinct = asked.select("node", "vector", "ids", "dim").mapInPandas(placed(True), "node long, vector array<double>, ids array<long>, dim int, cells array<int>")
    probing = distinct.select("node", "vector", F.explode("cells").alias("cell")).join(shards, "cell")
    questions = saved(probing.select("node", "vector", F.explode(F.sequence(F.col("first"), F.col("first") + F.col("parts") - 1)).alias("shard")), "questions")
    blocks = questions.groupBy("shard").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"))  # a row for each shard
    copies = index.join(F.broadcast(blocks), "shard").select("shard", "graph", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"))
    dealt = questions.join(F.broadcast(blocks), "shard").withColumn("block", F.pmod(F.xxhash64("node", F.lit(1)), F.col("blocks")).cast("int")).drop("blocks")
    found = copies.groupBy("shard", "block").cogroup(dealt.groupBy("shard", "block")).applyInPandas(_searcher(k + 1, breadth), "query_node long, vec_id long, score double")
    order = Window.partitionBy("query_node").orderBy(F.desc("score"), "vec_id")
    merged = found.withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= k + 1).select("query_node", F.struct("_n", "vec_id", "score").alias("one"))
    lists = merged.groupBy("query_node").agg(F.array_sort(F.collect_list("one")).alias("found"))  # k + 1 of each
    lists = saved(lists.join(asked.select(F.col("node").alias("query_node"), "copies"), "query_node").withColumnRenamed("query_node", "node"), "lists")
    own = by_key(asking, lists, ["node"], BROADCAST_VECTORS).select("query_id", F.filter("found", lambda x: x["vec_id"] != F.col("query_id")).alias("found"))
    return own.select("query_id", F.posexplode(F.slice("found", 1, k))).select("query_id", (F.col("pos") + 1).cast("int").alias("rank"), F.col("col.vec_id").alias("vec_id"), F.col("col.score").alias("score"))


def op4_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 nearest of all embeddings to every twentieth one."""
    return nearest(table(spark, sf_dir, "embeddings"), "vec_id % 20 = 0")
