"""Operator 5: near-duplicate embeddings by cross-polytope hashing."""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from itertools import product

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import stored, table
from .components import components
from .vectors import cosines, matrix, unit, usable

#: Least cosine of a link; share of pairs at that cosine that may share no key; keys a vector is put under in a table (its own and the
#: next likely ones); keys there should be for each vector of the largest label; vectors of a block when a bucket's pairs are
#: compared, and of a tile of such a block; rows of one group of blocks, about.
LEAST, MISSED, PROBES, SPARE, BLOCK, TILE, CELL, SEED = 0.98, 1e-4, 4, 16, 2048, 512, 20_000, 11


def rotated(x: np.ndarray, signs: np.ndarray) -> np.ndarray:
    """Pseudo-random rotations of the rows: three times random signs and a fast Hadamard transform. The width is a power of two."""
    for s in signs:
        x = x * s
        h = 1
        while h < x.shape[1]:
            y = x.reshape(len(x), -1, 2, h)
            x = np.stack([y[:, :, 0] + y[:, :, 1], y[:, :, 0] - y[:, :, 1]], axis=2).reshape(len(x), -1)
            h *= 2
        x = x / np.sqrt(x.shape[1])
    return x


def codes(x: np.ndarray, tables: int, hashes: int, probes: int = PROBES, seed: int = SEED) -> np.ndarray:
    """(vectors, tables, probes): keys of unit vectors. A hash is the nearest of the 2 d signed axes after a rotation; further probes
    replace it, in one or more hashes of the key, by the second nearest, those first that lose least."""
    width = 1 << max(1, (x.shape[1] - 1).bit_length())
    x = np.pad(x, ((0, 0), (0, width - x.shape[1])))
    rng = np.random.default_rng(seed)
    out = np.zeros((len(x), tables, probes), np.int64)
    swaps = np.array(sorted(product((0, 1), repeat=hashes), key=sum))
    for t in range(tables):
        best, loss = np.zeros((len(x), hashes, 2), np.int64), np.zeros((len(x), hashes))
        for k in range(hashes):
            y = rotated(x, rng.choice([-1.0, 1.0], (3, width)))
            near = np.argpartition(-np.abs(y), 1, axis=1)[:, :2]
            size = np.take_along_axis(y, near, axis=1)
            order = np.argsort(-np.abs(size), axis=1, kind="stable")
            near, size = np.take_along_axis(near, order, axis=1), np.take_along_axis(size, order, axis=1)
            best[:, k] = 2 * near + (size < 0)
            loss[:, k] = np.abs(size[:, 0]) - np.abs(size[:, 1])
        cost = loss @ swaps.T.astype(np.float64)
        for p, pick in enumerate(np.argsort(cost, axis=1, kind="stable")[:, :probes].T):
            key = np.zeros(len(x), np.int64)
            for k in range(hashes):
                key = key * (2 * width) + np.take_along_axis(best[:, k], swaps[pick][:, k : k + 1], axis=1)[:, 0]
            out[:, t, p] = key
    return out


def hashes_for(vectors: int, dimensions: int) -> int:
    """Hashes of a key, so that a table has SPARE keys for each of so many vectors and random ones rarely meet: it grows with their logarithm."""
    width = 1 << max(1, (dimensions - 1).bit_length())
    return max(2, int(np.ceil(np.log(SPARE * max(2, vectors)) / np.log(2 * width))))


@lru_cache
def tables_for(dimensions: int, hashes: int, least: float = LEAST) -> int:
    """Tables that leave a share of MISSED of pairs at the least cosine without a common key, by the rate at which 1,000 random such pairs meet."""
    rng = np.random.default_rng(SEED)
    a, b = rng.normal(size=(2, 1000, dimensions))
    a = unit(a)
    b = unit(b - (a * b).sum(axis=1, keepdims=True) * a) if dimensions > 1 else a
    x, y = codes(a, 4, hashes, seed=SEED + 1), codes(unit(least * a + np.sqrt(1 - least * least) * b), 4, hashes, seed=SEED + 1)
    meet = min(0.999, (x[:, :, :, None] == y[:, :, None, :]).any(axis=(2, 3)).mean())
    return max(2, int(np.ceil(np.log(MISSED) / np.log(1 - meet))))


def _mixed(h: np.ndarray) -> np.ndarray:
    h = h.astype(np.uint64)
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def with_keys(nodes: DataFrame, most: int, least: float) -> DataFrame:
    """nodes(node, lab, n, v, ...) with keys: those of every table, as one number with label, table and number of components in it."""

    def run(pdfs: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in pdfs:
            for size, own in pdf.groupby(pdf["v"].map(len)):
                hashes = hashes_for(most, size)
                for i in range(0, len(own), 2048):
                    part = own.iloc[i : i + 2048]
                    c = codes(unit(matrix(part["v"])), tables_for(size, hashes, least), hashes)
                    apart = _mixed(part["lab"].to_numpy().view(np.uint64) + np.uint64(size))[:, None] + np.arange(1, c.shape[1] + 1, dtype=np.uint64)
                    keys = _mixed(_mixed(c) ^ _mixed(apart)[:, :, None]).view(np.int64).reshape(len(part), -1)
                    yield part.assign(keys=list(keys))

    return nodes.mapInPandas(run, T.StructType([*nodes.schema.fields, T.StructField("keys", T.ArrayType(T.LongType()))]))


def shared(keyed: DataFrame) -> DataFrame:
    """(bucket, node, keys, m): vectors under the keys that they must be compared under; m vectors have the key. keys has all of those of the
    vector, those that most vectors have first.

    A key that only one vector has goes. So does one whose vectors all have another, more common key in front: all their pairs meet
    there too. Near copies of one vector share almost all keys, and most of those go this way. Only numbers travel.
    """
    rows = keyed.select("node", F.explode("keys").alias("bucket"))
    sizes = stored(rows.groupBy("bucket").agg(F.count("*").alias("m")).where("m > 1"), "embed-sizes")
    rows = rows.join(sizes, "bucket")
    ordered = lambda c: F.array_sort(F.collect_list(F.struct((-F.col("m")).alias("less"), "bucket"))).alias(c)
    by_node = stored(rows.groupBy("node").agg(ordered("own")), "embed-shared")
    each = by_node.select("node", F.element_at("own", 1)["bucket"].alias("first"), F.explode("own").alias("k")).select("node", "first", "k.bucket", (-F.col("k.less")).alias("m"))
    spare = each.groupBy("bucket").agg(F.min("first").alias("lo"), F.max("first").alias("hi")).where("lo = hi and lo <> bucket").select("bucket")
    kept = each.join(spare, "bucket", "left_anti")
    by_node = stored(kept.groupBy("node").agg(ordered("own")), "embed-kept")
    return by_node.select("node", F.transform("own", lambda k: k["bucket"]).alias("keys"), F.explode("own").alias("k")).select("k.bucket", "node", "keys", (-F.col("k.less")).alias("m"))


def linked(x: np.ndarray, keys: np.ndarray, bucket: int, left: np.ndarray, right: np.ndarray, least: float) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of positions, one in left and one in right (each pair once if they are the same), with a cosine of least or more, that do not meet
    under a key before bucket. Rows of keys end in numbers below 0 that no other row has."""
    i, j = np.nonzero(unit(x[left]) @ unit(x[right]).T >= least - 1e-9)
    i, j = left[i], right[j]
    if left is right:
        i, j = i[i < j], j[i < j]
    keep = cosines(x[i], x[j]) >= least
    i, j = i[keep], j[keep]
    for p in range(keys.shape[1]):
        if not len(i):
            break
        at = keys[i, p]
        undecided = ~(keys[i, :p] == bucket).any(axis=1)
        met = undecided & (at != bucket) & (keys[j] == at[:, None]).any(axis=1)
        i, j = i[~met], j[~met]
    return i, j


def compared(rows: DataFrame, least: float) -> DataFrame:
    """(node, links, other): links a vector has within a pair of blocks, by copies of the partner, and a node that it is connected to.

    A bucket of more than BLOCK vectors is cut into blocks by a hash; a task compares two blocks, tile by tile. A pair that meets under
    several keys counts once, under the first, without bringing pairs together.
    """
    placed = rows.withColumn("blocks", F.ceil(F.col("m") / BLOCK).cast("int")).withColumn("own", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    paired = placed.withColumn("with", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    paired = paired.select("bucket", F.least("own", "with").alias("lo"), F.greatest("own", "with").alias("hi"), "own", "node", "n", "keys", "v")
    # A vector stands in as many pairs of blocks as its bucket has blocks: that many rows are dealt, and a group holds about CELL of them.
    cells = max(1, int((placed.agg(F.sum("blocks")).first()[0] or 0) // CELL))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        out = []
        pdf = pdf.sort_values(["bucket", "lo", "hi", "node"], ignore_index=True)
        ids = pdf[["bucket", "lo", "hi"]].to_numpy()
        cuts = np.flatnonzero(np.r_[True, (ids[1:] != ids[:-1]).any(axis=1), True])
        for a, b in zip(cuts[:-1], cuts[1:]):
            if b - a < 2:
                continue
            own = pdf.iloc[a:b]
            x, side, (bucket, lo, hi) = matrix(own["v"]), own["own"].to_numpy(), ids[a]
            wide = own["keys"].map(len).max()
            keys = np.stack([np.r_[k, np.full(wide - len(k), -1)] for k in own["keys"]])
            keys = np.where(np.arange(wide) < own["keys"].map(len).to_numpy()[:, None], keys, -(2 + np.arange(len(own)))[:, None])
            node, n = own["node"].to_numpy(), own["n"].to_numpy()
            links, root = np.zeros(len(own)), np.arange(len(own))
            left = np.flatnonzero(side == lo)
            right = left if lo == hi else np.flatnonzero(side == hi)
            tiles = lambda at: [at[i : i + TILE] for i in range(0, len(at), TILE)]
            lefts = tiles(left)
            for t, p in enumerate(lefts):
                for q in lefts[t:] if lo == hi else tiles(right):
                    i, j = linked(x, keys, bucket, p, p if q is p else q, least)
                    links += np.bincount(i, n[j], len(own)) + np.bincount(j, n[i], len(own))
                    while len(i):
                        low = np.minimum(root[i], root[j])
                        new = root.copy()
                        np.minimum.at(new, root[i], low)
                        np.minimum.at(new, root[j], low)
                        new = new[new]
                        if (new == root).all():
                            break
                        root = new
            has = np.flatnonzero(links)
            out.append(pd.DataFrame({"node": node[has], "links": links[has].astype(np.int64), "other": node[root[has]]}))
        return pd.concat(out) if out else pd.DataFrame({"node": [], "links": [], "other": []}).astype("int64")

    cell = F.pmod(F.xxhash64("bucket", "lo", "hi"), F.lit(cells)).alias("cell")
    return paired.groupBy(cell).applyInPandas(run, "node long, links long, other long")


def near_duplicates(rows: DataFrame, least: float = LEAST) -> DataFrame:
    """(vec_id, n_links, component_id, kept), one row for each row of rows(vec_id, embedding, label).

    Rows are compared only within a label, of whatever type; those with a null label, and vectors that are null, zero or hold nulls or
    non-finite numbers, link with nothing and are components of their own. Vectors with different numbers of components
    don't link. Equal vectors of a label are compared once and count as links of one another. Repeated rows get a row each and are linked.
    """
    kind = rows.schema["embedding"].dataType
    kind = kind if isinstance(kind, T.ArrayType) and isinstance(kind.elementType, T.FloatType) else T.ArrayType(T.DoubleType())
    own = rows.select(F.col("vec_id").cast("long"), F.col("embedding").cast(kind).alias("v"), "label")
    own = own.withColumn("takes_part", usable(F.col("v")) & F.col("label").isNotNull())
    v = F.transform("v", lambda x: x + F.lit(0.0)).cast(kind)  # -0.0 and 0.0 are one number
    own = own.withColumn("node", F.when(F.col("takes_part"), F.xxhash64("label", v)))
    nodes = own.where("takes_part").groupBy("node", F.xxhash64("label").alias("lab")).agg(F.first("v").alias("v"), F.count("*").alias("n"), F.min("vec_id").alias("least"))
    nodes = stored(nodes, "embed-nodes")
    most = nodes.groupBy("lab").agg(F.count("*").alias("n")).agg(F.max("n")).first()[0] or 0
    keyed = stored(with_keys(nodes.select("node", "lab", "v"), most, least).select("node", "keys"), "embed-keys")
    together = shared(keyed).join(nodes.select("node", "n", "v"), "node")
    found = stored(compared(stored(together, "embed-together"), least), "embed-links")
    linked_ = found.groupBy("node").agg(F.sum("links").alias("links"))
    names = components(found, "node", "other").withColumnRenamed("node", "node_c")
    joined = nodes.join(linked_, "node", "left").join(names, F.col("node") == F.col("node_c"), "left")
    joined = joined.select("node", "least", (F.col("n") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), F.coalesce("component", "node").alias("component"))
    firsts = joined.groupBy("component").agg(F.min("least").alias("component_id"))
    named = joined.join(firsts, "component").select(F.col("node").alias("node_"), "n_links", "component_id")
    out = own.select("vec_id", "node").join(named, F.col("node") == F.col("node_"), "left")
    # A row that takes no part is its own component.
    out = out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.when(F.col("node").isNull(), F.col("vec_id")).otherwise(F.col("component_id")).alias("component_id"))
    return out.withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "embeddings"))


#: Every pair of a label is compared here.
ORACLE = """
WITH v AS (
  SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0
), p AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
  WHERE list_dot_product(a.e, b.e) / (sqrt(list_dot_product(a.e, a.e)) * sqrt(list_dot_product(b.e, b.e))) >= 0.98e0
), r AS (
  WITH RECURSIVE w(a, b) AS (SELECT a, b FROM p UNION SELECT w.a, p.b FROM w JOIN p ON w.b = p.a) SELECT a, min(b) AS least FROM w GROUP BY a
), n AS (SELECT a, count(*) AS n FROM p GROUP BY a)
SELECT e.vec_id, coalesce(n.n, 0)::BIGINT AS n_links, least(e.vec_id, coalesce(r.least, e.vec_id)) AS component_id, e.vec_id = least(e.vec_id, coalesce(r.least, e.vec_id)) AS kept
FROM embeddings e LEFT JOIN n ON n.a = e.vec_id LEFT JOIN r ON r.a = e.vec_id
"""
