"""Operator 4: SimHash near-duplicates by the generalised pigeonhole principle."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import stored, table
from .components import components

#: Most bits in which the fingerprints of near-duplicates differ; words of a shingle; seed of its hash; parts the bits are dealt into.
BITS_APART, SHINGLE, SEED, PARTS = 3, 3, 42, 4
#: A bucket of at most so many fingerprints is compared in one task; larger ones are split further, see links().
BUCKET = 1024
#: Pairs that are compared in the time that storing one more key takes, about.
KEY_COST = 100
#: Rows that one group of buckets has, about.
CELL = 20_000


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """The SimHash of a text as a signed long. Null, empty and wordless texts have 0."""
    # bytes.lower() changes A-Z only; bytes.split() cuts at the six ASCII white-space characters.
    w = text.encode("utf-8").lower().split() if text else []
    if not w:
        return 0
    grams = [b" ".join(g) for g in zip(*(w[i:] for i in range(shingle)))] if len(w) >= shingle else [b" ".join(w)]
    hashes = np.fromiter((xxhash.xxh64_intdigest(g, SEED) for g in grams), np.uint64, len(grams))
    counts = np.zeros(64, np.int64)
    for i in range(0, len(hashes), 1 << 16):  # a long text needs no more memory than a short one here
        counts += np.unpackbits(hashes[i : i + (1 << 16)].astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * counts > len(hashes)).view(">u8")[0].astype(np.uint64).view(np.int64))


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, fp) of every row of docs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([fingerprint(t.as_py()) for t in b.column(1)], pa.int64())], ["doc_id", "fp"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, fp long")


def correlated_parts(nodes: DataFrame, parts: int = PARTS) -> list[list[int]]:
    """The 64 bits in parts of equal width, correlated bits together. Bit 0 is the highest.

    Counts of every pair of bits come from all fingerprints, as sums of 64 x 64 numbers per task.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        both = np.zeros((64, 64))
        for b in batches:
            x = np.unpackbits(b.column(0).to_numpy(zero_copy_only=False).astype(">i8").view(np.uint8).reshape(-1, 8), axis=1).astype(np.float64)
            both += x.T @ x
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(4096)), pa.array(both.reshape(-1))], ["at", "n"])

    rows = nodes.select("fp").mapInArrow(run, "at long, n double").groupBy("at").agg(F.sum("n").alias("n")).collect()
    both = np.zeros(4096)
    for r in rows:
        both[r["at"]] = r["n"]
    both = both.reshape(64, 64)
    n, p = max(1.0, nodes.count()), np.diag(both) / max(1.0, nodes.count())
    sd = np.sqrt(np.maximum(p * (1 - p), 1e-9))
    corr = np.abs(both / n - np.outer(p, p)) / np.outer(sd, sd)
    left, out = list(range(64)), []
    for _ in range(parts):
        part = [left.pop(0)]
        while len(part) < 64 // parts:
            best = max(left, key=lambda b: (corr[b, part].sum(), -b))
            left.remove(best)
            part.append(best)
        out.append(sorted(part))
    return out


def values(fp: np.ndarray, parts: list[list[int]]) -> np.ndarray:
    """The bits of each part as one number; fp are signed longs."""
    bits = np.unpackbits(fp.astype(">i8").view(np.uint8).reshape(-1, 8), axis=1)
    return np.stack([bits[:, p].astype(np.int64) @ (1 << np.arange(len(p) - 1, -1, -1, dtype=np.int64)) for p in parts], axis=1)


def _values_of(nodes: DataFrame, parts: list[list[int]]) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            v = values(b.column(0).to_numpy(zero_copy_only=False), parts)
            yield pa.RecordBatch.from_arrays([pa.array(np.tile(np.arange(len(parts)), len(v))), pa.array(v.reshape(-1))], ["part", "value"])

    return nodes.select("fp").mapInArrow(run, "part long, value long")


def allocate(counts: list[np.ndarray], apart: int = BITS_APART) -> list[int]:
    """Thresholds t of the parts, -1 for an unused part, with sum(t + 1) = apart + 1, for fewest estimated candidates.

    Two fingerprints at most apart bits from one another then differ in at most t bits of some part: else they would differ in
    sum(t + 1) > apart bits. counts: of each part, fingerprints by value. Candidates of a part at t are the pairs of values at
    distance t or less, exactly counted by a Walsh-Hadamard transform; the split is found by dynamic programming.
    """
    costs = []
    for c in counts:
        width = len(c).bit_length() - 1
        spectrum = c.astype(np.float64).copy()
        h = 1
        while h < len(c):
            s = spectrum.reshape(-1, 2, h)
            spectrum = np.stack([s[:, 0] + s[:, 1], s[:, 0] - s[:, 1]], axis=1).reshape(-1)
            h *= 2
        # Characters of the balls: the Krawtchouk sums of the distances up to t, by weight.
        weight = np.array([int(i).bit_count() for i in range(len(c))])
        cost, ball = [0.0], np.zeros(width + 1)
        for t in range(apart + 1):
            kraw = np.zeros(width + 1)
            for j in range(t + 1):
                kraw += [(-1) ** j * _choose(w, j) * _choose(width - w, t - j) for w in range(width + 1)]
            ball = ball + kraw
            # The cost also has the keys that each fingerprint is stored under.
            keys = KEY_COST * sum(_choose(width, j) for j in range(t + 1)) * float(c.sum())
            cost.append(float((spectrum**2 * ball[weight]).sum() / len(c)) + keys)
        costs.append(cost)
    best: dict[int, tuple[float, list[int]]] = {0: (0.0, [])}
    for cost in costs:
        best = {
            total: min((best[total - k][0] + cost[k], [*best[total - k][1], k - 1]) for k in range(apart + 2) if total - k in best)
            for total in range(apart + 2)
            if any(total - k in best for k in range(apart + 2))
        }
    return best[apart + 1][1]


def _choose(n: int, k: int) -> float:
    out = 1.0
    for i in range(k):
        out = out * (n - i) / (i + 1)
    return out if 0 <= k <= n else 0.0


def keyed(nodes: DataFrame, parts: list[list[int]], t: list[int]) -> DataFrame:
    """(bucket, fp): each fingerprint under its value of every used part and under all values within the part's threshold."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fp = b.column(0).to_numpy(zero_copy_only=False)
            v = values(fp, parts)
            for i, part in enumerate(parts):
                for flips in range(t[i] + 1):
                    for bits in combinations(range(len(part)), flips):
                        key = (v[:, i] ^ sum(1 << x for x in bits)) + (i << 32)
                        yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(fp)], ["bucket", "fp"])

    return nodes.select("fp").mapInArrow(run, "bucket long, fp long")


def linked_within(bucket: np.ndarray, fp: np.ndarray, apart: int = BITS_APART) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (member, smaller root) that connect the fingerprints of each bucket just as all pairs at most apart bits from one another do."""
    order = np.lexsort((fp, bucket))
    bucket, fp = bucket[order], fp[order]
    bits, root = fp.view(np.uint64), np.arange(len(fp))
    left, right = [], []
    at, step = np.arange(len(fp)), 0

    def hook() -> None:
        nonlocal root, left, right
        if left:
            a, b = np.concatenate(left), np.concatenate(right)
            while True:
                lo = np.minimum(root[a], root[b])
                new = root.copy()
                np.minimum.at(new, root[a], lo)
                np.minimum.at(new, root[b], lo)
                new = new[new]
                new = np.minimum(new, new[root])
                if (new == root).all():
                    break
                root = new
            left, right = [], []

    while len(at):
        step += 1
        at = at[at + step < len(fp)]
        at = at[bucket[at] == bucket[at + step]]
        near = at[np.bitwise_count(bits[at] ^ bits[at + step]) <= apart]
        if len(near):
            left.append(near)
            right.append(near + step)
            if sum(map(len, left)) > 1_000_000:
                hook()
    hook()
    own = np.flatnonzero(root != np.arange(len(fp)))
    return fp[own], fp[root[own]]


def _compared(rows: DataFrame, sizes: DataFrame, apart: int) -> DataFrame:
    """(fp, other) from buckets of at most BUCKET rows. Buckets share tasks: a group holds about CELL rows."""
    cells = max(1, int((sizes.agg(F.sum("n")).first()[0] or 0) // CELL))

    def run(pdf):
        a, b = linked_within(pdf["bucket"].to_numpy(), pdf["fp"].to_numpy(), apart)
        return type(pdf)({"fp": a, "other": b})

    small = rows.join(sizes.where((F.col("n") > 1) & (F.col("n") <= BUCKET)).select("bucket"), "bucket")
    return small.groupBy(F.pmod(F.xxhash64("bucket"), F.lit(cells)).alias("cell")).applyInPandas(run, "fp long, other long")


def links(nodes: DataFrame, apart: int = BITS_APART) -> DataFrame:
    """(fp, other): edges that connect distinct fingerprints just as all pairs at most apart bits from one another do.

    Buckets of more than BUCKET fingerprints are dealt anew by the bits outside their part, by the same principle. What is still
    in a larger bucket after that is linked through shared neighbours: a fingerprint goes to all values up to one bit away and to
    all two bits away; at each value that one of the nearer kind reaches, it is linked to all others. Two fingerprints
    three bits apart or less meet like that, no others do, and the rows grow with the fingerprints, not with their pairs.
    """
    assert apart == 3, "the last step is made for three bits"
    parts = correlated_parts(nodes)
    counted = _values_of(nodes, parts).groupBy("part", "value").agg(F.count("*").alias("n")).collect()  # at most 4 x 65,536 rows
    counts = [np.zeros(1 << len(p)) for p in parts]
    for r in counted:
        counts[r["part"]][r["value"]] = r["n"]
    t = allocate(counts, apart)
    rows = stored(keyed(nodes, parts, t), "simhash-keys")
    sizes = stored(rows.groupBy("bucket").agg(F.count("*").alias("n")), "simhash-sizes")
    found = _compared(rows, sizes, apart)
    if sizes.where(F.col("n") > BUCKET).limit(1).count():
        large = rows.join(sizes.where(F.col("n") > BUCKET).select("bucket"), "bucket")

        def deal(pdfs):
            for pdf in pdfs:
                part, fp = (pdf["bucket"].to_numpy() >> 32) & 0xFF, pdf["fp"].to_numpy()
                for i in np.unique(part):
                    rest = [b for j, p in enumerate(parts) if j != i for b in p]
                    # With threshold t the pair may differ in the part as well; the other bits differ in 3 or less in any case.
                    v, own = values(fp[part == i], [rest[k::4] for k in range(4)]), pdf["bucket"].to_numpy()[part == i]
                    for k in range(4):
                        yield type(pdf)({"outer": own, "inner": v[:, k] * 4 + k, "fp": fp[part == i]})

        again = large.mapInPandas(deal, "outer long, inner long, fp long").select(F.xxhash64("outer", "inner").alias("bucket"), "fp")
        again = stored(again, "simhash-keys")
        sizes = stored(again.groupBy("bucket").agg(F.count("*").alias("n")), "simhash-sizes")
        found = found.union(_compared(again, sizes, apart))
        if sizes.where(F.col("n") > BUCKET).limit(1).count():
            found = found.union(_through_neighbours(again.join(sizes.where(F.col("n") > BUCKET).select("bucket"), "bucket").select("fp").distinct()))
    return stored(found.distinct(), "simhash-links")


def _through_neighbours(nodes: DataFrame) -> DataFrame:
    masks = [0, *(1 << i for i in range(64)), *((1 << i) | (1 << j) for i, j in combinations(range(64), 2))]
    near = np.array([m if m < 1 << 63 else m - (1 << 64) for m in masks], np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fp = b.column(0).to_numpy(zero_copy_only=False)
            for i in range(0, len(fp), 64):
                f = fp[i : i + 64]
                yield pa.RecordBatch.from_arrays(
                    [pa.array((f[:, None] ^ near[None]).reshape(-1)), pa.array(np.repeat(f, len(near))), pa.array(np.tile(np.arange(len(near)) < 65, len(f)))], ["at", "fp", "close"]
                )

    rows = nodes.select("fp").mapInArrow(run, "at long, fp long, close boolean")
    hubs = rows.groupBy("at").agg(F.min(F.when(F.col("close"), F.col("fp"))).alias("other"), F.count("*").alias("n")).where("n > 1 and other is not null")
    return rows.join(hubs, "at").where("fp <> other").select("fp", "other").distinct()


def _grouped(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(doc_id, fp) of every row of docs(doc_id, text), and (fp, component) of every fingerprint: the smallest one that links reach."""
    prints = stored(fingerprints(docs), "simhash-prints")
    nodes = stored(prints.select("fp").distinct(), "simhash-nodes")
    found = components(links(nodes), "fp", "other")
    return prints, nodes.join(found, nodes.fp == found.node, "left").select("fp", F.coalesce("component", "fp").alias("component"))


def near_duplicates(docs: DataFrame) -> DataFrame:
    """(doc_id, fp, component_id), one row for each row of docs(doc_id, text).

    component_id is the smallest doc_id that links reach, null where all those are null. Null and wordless texts share
    fingerprint 0 and so are linked. Repeated rows get a row each. Copies meet in one fingerprint before anything is compared.
    """
    prints, groups = _grouped(docs)
    least = prints.groupBy("fp").agg(F.min("doc_id").alias("least"))
    joined = groups.join(least, "fp")
    firsts = joined.groupBy("component").agg(F.min("least").alias("component_id"))
    named = joined.join(firsts, "component").select(F.col("fp").alias("fp_"), "component_id")
    return prints.join(named, prints.fp == named.fp_).select("doc_id", "fp", "component_id")


def keep_first(docs: DataFrame, grouped: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """docs with one row of each group of near-duplicates: that with the smallest id (null ids last), of rows of one id the one whose
    text has the smallest hash.

    grouped gives (doc_id, node, component) of each row of docs(doc_id, text), where node stands for the text (text_key()). Rows are told
    apart by id and text, so different texts under one id are judged on their own, and so are rows without an id.
    """
    found = grouped(docs.select("doc_id", "text"))
    id_, order = F.col("doc_id").cast("long"), F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "node")
    first = found.groupBy("component").agg(F.min(order).alias("first")).select("first.*").withColumnsRenamed({"doc_id": "first_id", "node": "first_node"})
    own = docs.select(F.struct("*").alias("doc"), id_.alias("id"), text_key(F.col("text")).alias("node"))
    kept = own.join(first, (F.col("node") == F.col("first_node")) & F.col("id").eqNullSafe(F.col("first_id")), "left_semi")
    # Rows of one id and text are the same document.
    nth = F.row_number().over(Window.partitionBy("node", "id").orderBy(F.lit(1)))
    return kept.withColumn("nth", nth).where("nth = 1").select("doc.*")


def text_key(text: Column) -> Column:
    """Stands for a text; null and empty ones share theirs."""
    return F.xxhash64(F.coalesce(text.cast("string"), F.lit("")))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
