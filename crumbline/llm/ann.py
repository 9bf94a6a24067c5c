"""Operator 1: approximate nearest neighbours through balanced posting lists."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import stored, table
from .vectors import cosines, matrix, unit, usable

#: Neighbours to return; vectors that a posting list should have; most lists; vectors that the centroids are fitted on, at most, and
#: numbers in them (a bounded sample); Lloyd rounds.
K, LIST, MOST_LISTS, SAMPLE, SAMPLE_NUMBERS, ROUNDS, SEED = 5, 256, 8192, 32_768, 1 << 22, 6, 5
#: Links of a centroid in the graph; candidates that a search keeps at first.
DEGREE, BEAM = 24, 128
#: A vector goes to further lists whose centroid is at most so much farther than the nearest, to so many.
CLOSURE, REPLICAS = 1.10, 6
#: A query reads every list whose centroid is at most so much farther than its nearest, where so much is what finds this share of the
#: neighbours of so many vectors of the sample.
#: A query reads so many vectors in any case.
RECALL, ASKED, READ_LEAST = 0.95, 512, 512
#: Vectors, and queries, of a list that one task compares.
BLOCK = 1024


@dataclass
class Index:
    """Centroids (unit vectors), and of each the positions of its neighbours in the graph, at most MOST_LISTS rows; and the ratio of
    distances up to which lists are read."""

    centroids: np.ndarray
    graph: np.ndarray
    prune: float = 1.0

    def nearest(self, x: np.ndarray, beam: int = BEAM) -> tuple[np.ndarray, np.ndarray]:
        """Of each unit vector the positions of up to beam near centroids, nearest first, and their distances.

        A best-first walk on the graph for all vectors at once: each step opens the nearest centroid that isn't open yet, and
        ends when all that are kept are.
        """
        n, k = len(x), len(self.centroids)
        beam = min(beam, k)
        starts = np.arange(0, k, max(1, k // 32))[:32]
        seen = np.zeros((n, k), bool)
        seen[:, starts] = True
        at = np.full((n, beam), -1)
        dist = np.full((n, beam), np.inf)
        opened = np.ones((n, beam), bool)
        m = min(beam, len(starts))
        d = _distances(x, self.centroids[starts])
        pick = np.argsort(d, axis=1, kind="stable")[:, :m]
        at[:, :m], dist[:, :m], opened[:, :m] = starts[pick], np.take_along_axis(d, pick, axis=1), False
        active = np.arange(n)
        while len(active):
            waiting = ~opened[active]
            some = waiting.any(axis=1)
            active = active[some]
            if not len(active):
                break
            first = waiting[some].argmax(axis=1)
            opened[active, first] = True
            near = self.graph[at[active, first]]
            fresh = ~seen[active[:, None], near]
            seen[active[:, None], near] = True
            d = np.sqrt(np.maximum(0, 2 - 2 * np.einsum("nd,ngd->ng", x[active], self.centroids[near])))
            d[~fresh] = np.inf
            every = np.concatenate([dist[active], d], axis=1)
            pick = np.argsort(every, axis=1, kind="stable")[:, :beam]
            dist[active] = np.take_along_axis(every, pick, axis=1)
            at[active] = np.take_along_axis(np.concatenate([at[active], near], axis=1), pick, axis=1)
            opened[active] = np.take_along_axis(np.concatenate([opened[active], ~fresh], axis=1), pick, axis=1)
        return at, dist


    def placed(self, x: np.ndarray) -> np.ndarray:
        """The lists of each unit vector, -1 where there are fewer: the nearest and, near a boundary, others that are not much farther away and
        whose centroid is not nearer to one already chosen than to the vector."""
        at, dist = self.nearest(x, 16)
        out, total = np.where(np.arange(at.shape[1]) == 0, at, -1), np.ones(len(x), int)
        for j in range(1, at.shape[1]):
            c = self.centroids[at[:, j]]
            fits = (dist[:, j] <= CLOSURE * dist[:, 0] + 1e-12) & (total < REPLICAS) & (at[:, j] >= 0)
            for i in range(j):
                apart = np.sqrt(np.maximum(0, 2 - 2 * (c * self.centroids[at[:, i]]).sum(axis=1)))
                fits &= (out[:, i] < 0) | (apart >= dist[:, j])
            out[fits, j] = at[fits, j]
            total += fits
        return out

    def lists(self, x: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(row of x, list) of all lists within the ratio of each unit vector, and of further ones, nearest first, until READ_LEAST vectors are
        read. A search keeps more and more centroids until the last one is beyond both, or none is left: no number of lists limits it."""
        rows, found = [np.zeros(0, int)], [np.zeros(0, int)]
        waiting, beam = np.arange(len(x)), BEAM
        while len(waiting):
            at, dist = self.nearest(x[waiting], beam)
            held = np.where(at >= 0, sizes[at], 0)
            use = (at >= 0) & ((dist <= self.prune * dist[:, :1] + 1e-9) | (np.cumsum(held, axis=1) - held < READ_LEAST))
            ends = ~use[:, -1] | (beam >= len(self.centroids))
            i, j = np.nonzero(use & ends[:, None])
            rows.append(waiting[i]), found.append(at[i, j])
            waiting, beam = waiting[~ends], 2 * beam
        return np.concatenate(rows), np.concatenate(found)


def _distances(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(0, 2 - 2 * x @ y.T))


def fit(sample: np.ndarray, lists: int) -> Index:
    """Balanced k-means on unit vectors: lists that are already large repel, so that none grows far beyond the mean. Then the graph:
    the nearest centroids of each, and some at random that keep it connected."""
    rng = np.random.default_rng(SEED)
    lists = max(1, min(lists, len(sample)))
    centroids = sample[rng.choice(len(sample), lists, replace=False)]
    load = np.full(lists, len(sample) / lists)
    for _ in range(ROUNDS):
        own = np.concatenate([(_distances(part, centroids) + 0.05 * (load * lists / len(sample))[None]).argmin(axis=1) for part in np.array_split(sample, max(1, len(sample) * lists // 8_000_000 + 1))])
        counts = np.bincount(own, minlength=lists)
        load = 0.5 * load + 0.5 * counts
        sums = np.zeros_like(centroids)
        np.add.at(sums, own, sample)
        empty = (counts == 0) | ~(np.abs(sums).max(axis=1) > 1e-9)
        sums[empty] = sample[rng.choice(len(sample), int(empty.sum()))]
        centroids = unit(sums)
    near = min(DEGREE, lists)
    graph = np.concatenate([np.argsort(_distances(part, centroids), axis=1, kind="stable")[:, :near] for part in np.array_split(centroids, max(1, lists * lists // 8_000_000 + 1))])
    graph = np.concatenate([graph, rng.integers(0, lists, (lists, 8))], axis=1)
    return calibrated(Index(centroids, graph), sample, rng)


def calibrated(index: Index, sample: np.ndarray, rng: np.random.Generator) -> Index:
    """Sets the ratio of distances from vectors of the sample and their exact neighbours there: those of a whole table are nearer and so in
    nearer lists."""
    asks = sample[rng.choice(len(sample), min(ASKED, len(sample)), replace=False)]
    dist = _distances(asks, index.centroids)
    near = np.concatenate([np.argpartition(-(part @ sample.T), min(K, len(sample) - 1), axis=1)[:, : K + 1] for part in np.array_split(asks, max(1, len(asks) // 64))])
    own = index.placed(sample[near.reshape(-1)])
    needed = np.where(own >= 0, np.take_along_axis(np.repeat(dist, near.shape[1], axis=0), np.maximum(own, 0), axis=1), np.inf).min(axis=1)
    ratio = needed / np.maximum(np.repeat(dist.min(axis=1), near.shape[1]), 1e-9)
    itself = (sample[near.reshape(-1)] * np.repeat(asks, near.shape[1], axis=0)).sum(axis=1) > 1 - 1e-12
    index.prune = float(max(1.0, np.quantile(ratio[~itself], RECALL))) if (~itself).any() else 1.0
    return index


def postings(nodes: DataFrame, index) -> DataFrame:
    """(list, node, least, v): every vector in the lists that Index.placed gives."""
    kind = nodes.schema["v"].dataType.simpleString()

    def run(pdfs: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in pdfs:
            for i in range(0, len(pdf), 1024):
                part = pdf.iloc[i : i + 1024]
                for a in index.value.placed(unit(matrix(part["v"]))).T:
                    k = a >= 0
                    yield pd.DataFrame({"list": a[k], "node": part["node"].to_numpy()[k], "least": part["least"].to_numpy()[k], "v": part["v"].to_numpy()[k]})

    return nodes.select("node", "least", "v").mapInPandas(run, f"list long, node long, least long, v {kind}")


def nearest(rows: DataFrame, is_query, k: int = K) -> DataFrame:
    """(query_id, rank, vec_id, score): of each row of rows(vec_id, embedding) for which is_query holds, the k nearest others found, by
    cosine, ties to the smaller id; all others if there are fewer.

    Vectors that are null, zero or hold nulls or non-finite numbers, and rows with a null id, take no part. Vectors with different
    numbers of components are indexed apart. Equal vectors are indexed once; of their ids the k + 1 smallest are enough for any
    result. Repeated rows of one id and vector count once. An id with several vectors asks with each of them, and is found once, by the
    nearest; its own vectors are not its neighbours.
    """
    kind = rows.schema["embedding"].dataType
    kind = kind if isinstance(kind, T.ArrayType) and isinstance(kind.elementType, T.FloatType) else T.ArrayType(T.DoubleType())
    own = rows.select(F.col("vec_id").cast("long"), F.col("embedding").cast(kind).alias("v"), is_query.alias("asks")).where(usable(F.col("v")) & F.col("vec_id").isNotNull())
    own = own.withColumn("node", F.xxhash64(F.transform("v", lambda x: x + F.lit(0.0)).cast(kind)))
    nodes = own.groupBy("node").agg(F.first("v").alias("v"), F.min("vec_id").alias("least"), F.max("asks").alias("asks")).withColumn("size", F.size("v"))
    nodes = stored(nodes, "ann-nodes")
    found = None
    for size in [r["size"] for r in nodes.groupBy("size").count().collect()]:
        part = _searched(nodes.where(F.col("size") == size), size, k)
        found = part if found is None else found.union(part)
    if found is None:
        found = nodes.sparkSession.createDataFrame([], "asked long, node long, score double")
    ids = own.select("vec_id", "node").distinct()
    few = ids.withColumn("nth", F.row_number().over(Window.partitionBy("node").orderBy("vec_id"))).where(F.col("nth") <= k + 1)
    asking = own.where("asks").select(F.col("vec_id").alias("query_id"), F.col("node").alias("asked")).distinct()
    pairs = asking.join(found, "asked").join(few.select("node", "vec_id"), "node").where(F.col("query_id") != F.col("vec_id"))
    pairs = pairs.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id"))
    return pairs.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _searched(nodes: DataFrame, size: int, k: int) -> DataFrame:
    """(asked, node, score): the k + 1 nearest distinct vectors found of each that asks; itself is one."""
    spark, total = nodes.sparkSession, nodes.count()
    sample = nodes.select("node", "v").orderBy("node").limit(max(1, min(SAMPLE, SAMPLE_NUMBERS // size))).select("v").toArrow().column("v").combine_chunks()
    sample = unit(sample.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, size))
    index = spark.sparkContext.broadcast(fit(sample, min(MOST_LISTS, -(-total // LIST))))
    indexed = stored(postings(nodes, index), "ann-lists")
    sizes = np.zeros(len(index.value.centroids), np.int64)
    for r in indexed.groupBy("list").agg(F.count("*").alias("n")).collect():  # at most MOST_LISTS rows
        sizes[r["list"]] = r["n"]

    def ask(pdfs: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in pdfs:
            for i in range(0, len(pdf), 512):
                part = pdf.iloc[i : i + 512]
                q, a = index.value.lists(unit(matrix(part["v"])), sizes)
                yield pd.DataFrame({"list": a, "asked": part["node"].to_numpy()[q]})

    asked = stored(nodes.where("asks").select("node", "v").mapInPandas(ask, "list long, asked long"), "ann-asked")
    # At most MOST_LISTS rows: in how many blocks a list's vectors and the queries that read it are dealt.
    count = lambda df, name: df.groupBy("list").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias(name))
    dealt = F.broadcast(stored(count(indexed, "blocks").join(count(asked, "q_blocks"), "list"), "ann-dealt"))
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    placed = indexed.join(dealt, "list").withColumn("block", F.pmod(F.xxhash64("node", "list"), F.col("blocks")).cast("int")).withColumn("q_block", every("q_blocks"))
    queries = asked.join(dealt, "list").withColumn("q_block", F.pmod(F.xxhash64("asked", "list"), F.col("q_blocks")).cast("int")).withColumn("block", every("blocks"))
    queries = queries.join(nodes.where("asks").select(F.col("node").alias("asked"), "v"), "asked").select("list", "block", "q_block", "asked", "v")
    placed = placed.select("list", "block", "q_block", "node", "least", "v")

    def compare(queries: pd.DataFrame, own: pd.DataFrame) -> pd.DataFrame:
        if not len(queries) or not len(own):
            return pd.DataFrame({"asked": [], "node": [], "least": [], "score": []}).astype({"asked": "int64", "node": "int64", "least": "int64", "score": "float64"})
        q, x = matrix(queries["v"]), matrix(own["v"])
        near = unit(q) @ unit(x).T
        least = -np.partition(-near, min(k + 1, near.shape[1]) - 1, axis=1)[:, min(k + 1, near.shape[1]) - 1]
        i, j = np.nonzero(near >= least[:, None] - 1e-9)
        out = pd.DataFrame({"asked": queries["asked"].to_numpy()[i], "node": own["node"].to_numpy()[j], "least": own["least"].to_numpy()[j], "score": cosines(q[i], x[j])})
        return out.sort_values(["asked", "score", "least"], ascending=[True, False, True]).groupby("asked").head(k + 1)

    by = ["list", "block", "q_block"]
    hits = queries.groupBy(*by).cogroup(placed.groupBy(*by)).applyInPandas(compare, "asked long, node long, least long, score double")
    hits = hits.groupBy("asked", "node").agg(F.max("score").alias("score"), F.min("least").alias("least"))
    rank = F.row_number().over(Window.partitionBy("asked").orderBy(F.col("score").desc(), "least"))
    return hits.withColumn("rank", rank).where(F.col("rank") <= k + 1).select("asked", "node", "score")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"), F.col("vec_id") % 50 == 0)
