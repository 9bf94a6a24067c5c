"""Operator 6: removing repeated passages with a compacted de Bruijn graph."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import stored, table, words

#: Words of a window; words of an anchor; consecutive anchors' starts of which the one with the least hash is taken.
#: 2 SPREAD + ANCHOR - 1 <= WINDOW makes every window hold two neighbouring anchors, and so an edge, whatever stands around it.
WINDOW, ANCHOR, SPREAD = 35, 8, 14
_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
#: Stands for the edge after a text's last one, and for no path.
NO_NEXT = 0
#: Bits of a source coordinate that tell the place in the text; the others tell the text.
PLACE_BITS = 24


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


class Hashed:
    """Hashes of any run of a text's words, each from two differences of running sums."""

    def __init__(self, w: list[bytes]) -> None:
        h = np.fromiter(map(xxhash.xxh3_64_intdigest, w), np.uint64, len(w))
        with np.errstate(over="ignore"):
            power = np.full(len(w) + 1, _BASE)
            power[0] = 1
            self.power_back = power.copy()
            self.power_back[1:] = _INVERSE
            power, self.power_back = np.cumprod(power, dtype=np.uint64), np.cumprod(self.power_back, dtype=np.uint64)
            self.sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(h * power[:-1], dtype=np.uint64)])
            self.sums2 = None
            self.h, self.power = h, power

    def runs(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return _mix((self.sums[end] - self.sums[start]) * self.power_back[start])

    def verifying(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """A second, independent hash of the same runs."""
        if self.sums2 is None:
            self.sums2 = np.concatenate([np.zeros(1, np.uint64), np.cumsum(_mix(self.h ^ _BASE) * self.power[:-1], dtype=np.uint64)])
        return _mix((self.sums2[end] - self.sums2[start]) * self.power_back[start] + np.uint64(1))


def edges(x: Hashed) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash, start and end (exclusive) of the edges of a text: each reaches from the start of an anchor to the end of the next.

    An anchor is a run of ANCHOR words that has the least hash among SPREAD consecutive ones (of equals the first). Which ones
    are anchors inside a window, between two that its own words make so, does not depend on words outside.
    """
    n = len(x.h) - ANCHOR + 1
    if n < SPREAD:
        none = np.zeros(0, np.int64)
        return none.view(np.uint64), none, none
    start = np.arange(n)
    a = x.runs(start, start + ANCHOR)
    at = np.unique(np.lib.stride_tricks.sliding_window_view(a, SPREAD).argmin(axis=1) + np.arange(n - SPREAD + 1))
    begin, end = at[:-1], at[1:] + ANCHOR
    return x.runs(begin, end), begin, end


def graph_edges(docs: DataFrame) -> DataFrame:
    """(edge, next, doc_key, at): every edge of every text, the edge after it, and its source coordinate: the leading bits of doc_key, then its place among the text's edges."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keys = b.column(0).to_numpy(zero_copy_only=False)
            for i in range(0, b.num_rows, 256):
                e, following, key, at = [], [], [], []
                for k, text in zip(keys[i : i + 256], b.column(1).slice(i, 256)):
                    w = words(text.as_py())
                    if len(w) >= WINDOW:
                        own = edges(Hashed(w))[0].view(np.int64)
                        e.append(own)
                        following.append(np.append(own[1:], NO_NEXT))
                        key.append(np.full(len(own), k))
                        at.append((k >> PLACE_BITS << PLACE_BITS) + np.arange(len(own)) % (1 << PLACE_BITS))
                if e:
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in (e, following, key, at)], ["edge", "next", "doc_key", "at"])

    return docs.where("text is not null").select("doc_key", "text").mapInArrow(run, "edge long, next long, doc_key long, at long")


def compacted(found: DataFrame) -> DataFrame:
    """(edge, path) of each edge that stands in the texts twice or more; path is the first edge of its nonbranching path.

    An edge goes on to the next if that one always follows and stands just as often: then it has one way in, too, and every
    occurrence of one edge of a path is part of an occurrence of the whole path. So the first source coordinates of a path's
    edges are neighbours, and a path is a run of neighbours in one source. Coordinates that clash split a path, never join two.
    """
    n = F.count("*").alias("n")
    counted = found.groupBy("edge").agg(n, F.min("next").alias("lo"), F.max("next").alias("hi"), F.min("at").alias("at")).where("n > 1")
    source = Window.partitionBy(F.shiftright("at", PLACE_BITS)).orderBy("at", "edge")
    before = lambda c: F.lag(c).over(source)
    goes_on = (before("lo") == F.col("edge")) & (before("hi") == F.col("edge")) & (before("n") == F.col("n")) & (F.col("edge") != NO_NEXT)
    heads = counted.withColumn("head", F.when(goes_on, None).otherwise(F.col("edge")))
    return heads.select("edge", F.last("head", ignorenulls=True).over(source.rowsBetween(Window.unboundedPreceding, 0)).alias("path"))


def _spans(known: dict[int, int], e: np.ndarray, begin: np.ndarray, end: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts of the windows that hold a repeated edge but don't lie on one path, then starts and ends (exclusive) of paths of WINDOW words or more.

    known: the path of each repeated edge.
    """
    own = e.view(np.int64)
    path = np.fromiter((known.get(x, NO_NEXT) for x in own.tolist()), np.int64, len(own))
    repeated = path != NO_NEXT
    goes_on = np.append(repeated[:-1] & (path[:-1] == path[1:]) & (own[1:] != path[1:]), False)[: len(own)]
    first, last = repeated & ~np.append(False, goes_on[:-1])[: len(own)], repeated & ~goes_on
    begins, ends = begin[first], end[last]
    begins, ends = begins[ends - begins >= WINDOW], ends[ends - begins >= WINDOW]
    some, on_path = (np.zeros(n - WINDOW + 2, np.int64) for _ in range(2))
    lo, hi = np.maximum(0, end[repeated] - WINDOW), np.minimum(n - WINDOW, begin[repeated])
    np.add.at(some, lo[lo <= hi], 1)
    np.add.at(some, hi[lo <= hi] + 1, -1)
    np.add.at(on_path, begins, 1)
    np.add.at(on_path, ends - WINDOW + 1, -1)
    return np.flatnonzero((np.cumsum(some)[:-1] > 0) & (np.cumsum(on_path)[:-1] == 0)), begins, ends


def _kept(w: list[bytes], begins: np.ndarray, ends: np.ndarray) -> list[bytes]:
    """The words that no span covers."""
    mark = np.zeros(len(w) + 1, np.int64)
    np.add.at(mark, begins, 1)
    np.add.at(mark, ends, -1)
    return [x for x, k in zip(w, (np.cumsum(mark)[:-1] == 0).tolist()) if k]


_SPANS = "doc_id long, doc_key long, n_words long, n_removed long, kept_sha256 string, text string, at array<int>, until array<int>, h1 array<long>, h2 array<long>"
_RESULT = "doc_id long, n_words long, n_removed long, kept_sha256 string, kept_text string"


def _batch(rows: list[tuple], schema: str) -> pa.RecordBatch:
    kinds = {"long": pa.int64(), "string": pa.string(), "array<int>": pa.list_(pa.int32()), "array<long>": pa.list_(pa.int64())}
    names, types = zip(*(c.split(" ") for c in schema.split(", ")))
    return pa.RecordBatch.from_arrays([pa.array(c, kinds[t]) for c, t in zip(zip(*rows), types)], list(names))


def _result(w: list[bytes], spans: list[tuple[int, int]]) -> tuple[int, str, str]:
    """How many words the spans cover, the SHA-256 of the others, and the others."""
    kept = _kept(w, *np.array(spans, np.int64).reshape(-1, 2).T) if spans else w
    joined = b" ".join(kept)
    return len(w) - len(kept), hashlib.sha256(joined).hexdigest(), joined.decode("utf-8")


def _candidates(batches: Iterator[pa.RecordBatch], with_text: bool) -> Iterator[pa.RecordBatch]:
    """Per row the spans that may be repeated, with two hashes of their words, and the text; the result where it doesn't depend on them.
    The first of equal texts gives its spans for others, the copies give none."""
    none = np.zeros(0, np.int64)
    for b in batches:
        for i in range(0, b.num_rows, 64):
            out = []
            for doc_id, key, text, known, paths, copied, counts in zip(*(c.to_pylist() for c in b.slice(i, 64).columns)):
                w = words(text)
                at = until = h1 = h2 = none
                if len(w) >= WINDOW and known and counts:
                    x = Hashed(w)
                    windows, begins, ends = _spans(dict(zip(known, paths)), *edges(x), len(w))
                    at, until = np.concatenate([windows, begins]), np.concatenate([windows + WINDOW, ends])
                    h1, h2 = x.runs(at, until).view(np.int64), x.verifying(at, until).view(np.int64)
                if len(at) and not copied:
                    out.append((doc_id, key, len(w), None, None, text, at, until, h1, h2))
                else:
                    removed, sha, kept = _result(w, [(0, len(w))] if copied and len(w) >= WINDOW else [])
                    out.append((doc_id, key, len(w), removed, sha, kept if with_text else None, none, none, h1, h2))
            yield _batch(out, _SPANS)


def _finished(batches: Iterator[pa.RecordBatch], with_text: bool) -> Iterator[pa.RecordBatch]:
    """The results of the other rows; known are the first hashes of spans that are repeated."""
    for b in batches:
        for i in range(0, b.num_rows, 64):
            out = []
            for doc_id, text, at, until, h1, known in zip(*(c.to_pylist() for c in b.slice(i, 64).columns)):
                w, known = words(text), set(known or ())
                removed, sha, kept = _result(w, [(a, z) for a, z, h in zip(at, until, h1) if h in known])
                out.append((doc_id, len(w), removed, sha, kept if with_text else None))
            yield _batch(out, _RESULT)


def without_repeats(docs: DataFrame, with_text: bool = False) -> DataFrame:
    """(doc_id, n_words, n_removed, kept_sha256 and, if asked for, kept_text) of each row of docs(doc_id, text).

    1. Every text gives the edges of a de Bruijn graph over anchors, each with its source coordinate. Edges are counted.
    2. Repeated edges are compacted to nonbranching paths.
    3. Paths come back to the texts by a join: each stands there with its first and last word. A path of WINDOW words or more is
       one span; every other window that holds a repeated edge (at branches and ends of paths) is a span, too.
    4. Spans are verified: two hashes, 128 bits, of the words at their coordinates must be those of a span elsewhere.
    Every window that is repeated holds a repeated edge, so it lies on a path or is a span itself: nothing is missed.
    Equal texts are told by two hashes; one of them gives spans to step 4, and all their windows are repeated.
    A null text has no words. Null ids and repeated rows get a row each. Texts below WINDOW words lose nothing.
    """
    own = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).withColumn("doc_key", F.xxhash64("text"))
    found = graph_edges(own)
    # Stored, so that the join below reads both sides straight from their shuffles and Spark can split the rows of a very common edge.
    paths = stored(compacted(found), "substring-paths")
    hits = found.select("edge", "doc_key").join(paths, "edge").groupBy("doc_key").agg(F.collect_set(F.struct("edge", "path")).alias("hits"))
    copies = own.select("doc_key", "doc_id", F.md5("text").alias("m")).groupBy("doc_key").agg(F.count("*").alias("n"), F.min("doc_id").alias("first"), F.min("m").alias("lo"), F.max("m").alias("hi"))
    copies = copies.where("n > 1").select("doc_key", "first", (F.col("lo") == F.col("hi")).alias("same"))
    copied = F.coalesce("same", F.lit(False))
    joined = own.join(hits, "doc_key", "left").join(copies, "doc_key", "left")
    joined = joined.select("doc_id", "doc_key", "text", F.col("hits.edge").alias("edges"), F.col("hits.path").alias("paths"), copied.alias("copied"), (~copied | F.col("doc_id").eqNullSafe(F.col("first"))).alias("counts"))
    done = stored(joined.mapInArrow(partial(_candidates, with_text=with_text), _SPANS), "substring-texts")
    span = done.select("doc_key", F.explode(F.arrays_zip("h1", "h2")).alias("w")).select("doc_key", "w.h1", "w.h2")
    again = stored(span.groupBy("h1", "h2").agg(F.count("*").alias("n")).where("n > 1").select("h1", "h2"), "substring-spans")
    known = span.join(again, ["h1", "h2"]).groupBy("doc_key").agg(F.collect_set("h1").alias("known"))
    waiting = done.where("n_removed is null").join(known, "doc_key", "left").select("doc_id", "text", "at", "until", "h1", "known")
    settled = done.where("n_removed is not null").select("doc_id", "n_words", "n_removed", "kept_sha256", F.col("text").alias("kept_text"))
    out = settled.union(waiting.mapInArrow(partial(_finished, with_text=with_text), _RESULT))
    return out if with_text else out.drop("kept_text")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return without_repeats(table(spark, sf_dir, "documents"))
