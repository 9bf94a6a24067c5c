"""Near-duplicates of texts by the Jaccard similarity of their word shingles, for the pipeline: operator 4's fingerprints and probes, min-wise keys for
pairs whose fingerprints lie further apart, verified pairs."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored, words
from .components import components
from .embed_dedup import shared
from .simhash import fingerprint, links, text_key

#: Words of a shingle; least similarity of near-duplicates.
SHINGLE, SIMILAR = 5, 0.8
#: Keys of a text, and minima that make a key. A pair of similarity s shares none with a chance of (1 - s**ROWS)**KEYS: 3e-5 at 0.8.
KEYS, ROWS = 20, 4
#: Texts of a block when the pairs of a bucket are compared.
BLOCK = 256
_rng = np.random.default_rng(42)
_XOR, _ODD = _rng.integers(0, 1 << 63, KEYS * ROWS, np.uint64), _rng.integers(0, 1 << 63, KEYS * ROWS, np.uint64) * np.uint64(2) + np.uint64(1)
_MIX = np.uint64(0x9E3779B97F4A7C15)


def shingles(text: str | None) -> np.ndarray:
    """Sorted 64-bit hashes of the different shingles of a text; of fewer words than a shingle has, the one of all words."""
    # bytes.lower() changes A-Z only, as in simhash.py.
    w = [x.lower() for x in words(text)]
    if not w:
        return np.zeros(0, np.uint64)
    h = np.fromiter((xxhash.xxh64_intdigest(x, 42) for x in w), np.uint64, len(w))
    size = min(SHINGLE, len(w))
    out = np.full(len(w) - size + 1, size, np.uint64)
    for i in range(size):
        out = (out ^ h[i : i + len(out)]) * _MIX
        out ^= out >> np.uint64(32)
    return np.unique(out)


def keys(own: np.ndarray) -> list[int]:
    """The KEYS signed keys of a text's shingles. Texts without words share theirs."""
    least = np.full(KEYS * ROWS, np.iinfo(np.uint64).max, np.uint64)
    for i in range(0, len(own), 4096):
        np.minimum(least, ((own[None, i : i + 4096] ^ _XOR[:, None]) * _ODD[:, None]).min(axis=1), out=least)
    return [xxhash.xxh64_intdigest(least[k * ROWS : (k + 1) * ROWS].tobytes(), k) - (1 << 63) for k in range(KEYS)]


def alike(a: np.ndarray, b: np.ndarray) -> bool:
    """Whether two sorted sets of shingles have a Jaccard similarity of SIMILAR at least; empty ones are equal."""
    if min(len(a), len(b)) < SIMILAR * max(len(a), len(b)):
        return False
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both >= SIMILAR * (len(a) + len(b) - both)


def _keyed(docs: DataFrame) -> DataFrame:
    """(doc_id, node, keys, fp) of every row; node stands for the text, fp is its SimHash by the same shingles."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = pa.array([keys(shingles(t.as_py())) for t in b.column(2)], pa.list_(pa.int64()))
            prints = pa.array([fingerprint(t.as_py(), SHINGLE) for t in b.column(2)], pa.int64())
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), found, prints], ["doc_id", "node", "keys", "fp"])

    return docs.select(F.col("doc_id").cast("long"), text_key(F.col("text")), F.col("text").cast("string")).mapInArrow(run, "doc_id long, node long, keys array<long>, fp long")


def _near_prints(nodes: DataFrame) -> DataFrame:
    """(a, b): texts that operator 4 links: those of one fingerprint with the smallest of them, and the smallest ones of fingerprints that its probes link."""
    heads = stored(nodes.groupBy("fp").agg(F.min("node").alias("head")), "shingle-prints-of")
    same = nodes.join(heads, "fp").where("node <> head").select(F.col("node").alias("a"), F.col("head").alias("b"))
    of = lambda c, name: heads.select(F.col("fp").alias(c), F.col("head").alias(name))
    near = links(heads.select("fp")).join(of("fp", "a"), "fp").join(of("other", "b"), "other").select("a", "b")
    return stored(same.union(near), "shingle-near-prints")


def _leaders(rows: DataFrame) -> DataFrame:
    """(a, b): texts and the smallest node of a bucket that they are in."""
    heads = rows.groupBy("bucket").agg(F.min("node").alias("b"), F.count("*").alias("n")).where("n > 1").select("bucket", "b")
    return rows.join(heads, "bucket").where("node <> b").select(F.col("node").alias("a"), "b")


def _verified(candidates: DataFrame, texts: DataFrame) -> DataFrame:
    """(a, b): the candidates that are alike, by their whole sets of shingles."""
    pairs = stored(candidates.distinct(), "shingle-pairs")
    texts_of = lambda c: texts.select(F.col("node").alias(c), F.col("text").alias(f"text_{c}"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, own = None, np.zeros(0, np.uint64)
        for b in batches:
            kept = []
            for i, (node, x, y) in enumerate(zip(b.column(1).to_pylist(), b.column(2), b.column(3))):
                if node != last:
                    last, own = node, shingles(y.as_py())
                if alike(shingles(x.as_py()), own):
                    kept.append(i)
            yield b.select(["a", "b"]).take(pa.array(kept, pa.int64()))

    both = pairs.join(texts_of("a"), "a").join(texts_of("b"), "b").select("a", "b", "text_a", "text_b")
    return stored(both.mapInArrow(run, "a long, b long"), "shingle-links")


def _across(rows: DataFrame, found: DataFrame, texts: DataFrame) -> DataFrame:
    """(a, b): links between components that share a bucket. All pairs of such a bucket that lie in different components are
    compared, block by block, so that no task has more than two blocks and no pair is a row unless it links."""
    of = rows.join(found.select("node", "component"), "node", "left").withColumn("component", F.coalesce("component", "node"))
    of = stored(of, "shingle-members")
    mixed = of.groupBy("bucket").agg(F.min("component").alias("lo"), F.max("component").alias("hi"), F.count("*").alias("n")).where("lo <> hi")
    mixed = mixed.select("bucket", F.ceil(F.col("n") / BLOCK).cast("int").alias("blocks"))
    dealt = of.join(mixed, "bucket").withColumn("own", F.pmod(F.xxhash64("node", F.lit(1)), F.col("blocks")).cast("int"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    dealt = dealt.withColumn("i", F.least("own", "other")).withColumn("j", F.greatest("own", "other"))
    dealt = dealt.join(texts, "node").select("bucket", "i", "j", "own", "node", "component", "text")

    def run(key, pdf):
        own = [shingles(t) for t in pdf["text"]]
        node, component, block = (pdf[c].to_numpy() for c in ("node", "component", "own"))
        root: dict[int, int] = {}

        def find(x: int) -> int:
            while root.get(x, x) != x:
                x = root[x]
            return x

        out = []
        left, right = np.flatnonzero(block == key[1]), np.flatnonzero(block == key[2])
        for x in left:
            for y in right if key[1] != key[2] else right[right > x]:
                p, q = find(component[x]), find(component[y])
                if p != q and alike(own[x], own[y]):
                    root[max(p, q)] = min(p, q)
                    out.append((node[x], node[y]))
        return type(pdf)(out, columns=["a", "b"]).astype("int64")

    return stored(dealt.groupBy("bucket", "i", "j").applyInPandas(run, "a long, b long"), "shingle-links")


def grouped(docs: DataFrame) -> DataFrame:
    """(doc_id, node, component), one row for each row of docs(doc_id, text): node stands for the text, component for the texts that
    are connected by a Jaccard similarity of SIMILAR at least.

    Null and wordless texts are linked. Equal texts are one node. Texts whose fingerprints operator 4 links are compared, and each text with the smallest of
    every bucket; what then is still in different components of a bucket is compared pair by pair.
    """
    prints = stored(_keyed(docs), "shingle-prints")
    nodes = stored(prints.groupBy("node").agg(F.any_value("keys").alias("keys"), F.any_value("fp").alias("fp")), "shingle-nodes")
    near = _near_prints(nodes.select("node", "fp"))
    # Near copies share most of their keys; one of them is enough where all who have the others have it.
    rows = stored(shared(nodes.select("node", "keys")).select("bucket", "node"), "shingle-shared")
    wanted = rows.select("node").union(near.select("a")).union(near.select("b")).distinct()
    texts = docs.select(text_key(F.col("text")).alias("node"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    texts = stored(texts.join(wanted, "node", "left_semi").groupBy("node").agg(F.any_value("text").alias("text")), "shingle-texts")
    first = _verified(near.union(_leaders(rows)), texts)
    more = _across(rows, components(first, "a", "b"), texts)
    found = components(first.union(more), "a", "b")
    return prints.select("doc_id", "node").join(found, "node", "left").select("doc_id", "node", F.coalesce("component", "node").alias("component"))


def near_duplicates(docs: DataFrame) -> DataFrame:
    """(doc_id, component_id), one row for each row of docs(doc_id, text): component_id is the smallest doc_id of the row's group, null
    where all those are null."""
    found = stored(grouped(docs), "shingle-groups")
    firsts = found.groupBy("component").agg(F.min("doc_id").alias("component_id"))
    return found.join(firsts, "component").select("doc_id", "component_id")
