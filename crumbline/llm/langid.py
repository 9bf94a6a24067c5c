"""Operator 9: language identification by interpolated Kneser-Ney character models."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import table

#: Longest character n-gram; documents of a language that the models are fitted on and that calibrate, about (bounded samples of
#: labelled rows; of fewer documents a fifth calibrates); documents below which a language is calibrated by halves; words whose scores a task keeps.
ORDER, SAMPLE, CALIBRATE, FEW_TEXTS, WORDS_KEPT = 4, 500, 2000, 50, 200_000
#: Characters from which on a text counts as long in the calibration; the share of texts labelled with a language that may be rejected:
#: each language's limit is the quantile of its calibration texts that leaves so many above.
#: With too few of them to measure that, texts up to FEW deviations above the typical one are accepted.
LONG, FALSE_REJECTIONS, FEW = 500, 0.005, 8.0
#: Runs of letters (and of the few other signs that count as part of words).
LETTERS = re.compile(r"[^\W\d_]+")
#: Marks of a word's start and end; the chance of a character that no text had.
START, STOP, UNSEEN = 1, 2, 1e-6
_MIX = np.uint64(0x9E3779B97F4A7C15)


def words(text: str | None) -> list[str]:
    """Lower-case words that have a letter."""
    if not text:
        return []
    found = LETTERS.findall(text.lower())
    return found if text.isascii() else [w for w in found if w.isalpha() or any(map(str.isalpha, w))]


def coded(many: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Characters of the words with ORDER - 1 start marks before and a stop mark after each, and where each word begins."""
    lengths = np.fromiter(map(len, many), np.int64, len(many))
    chars = np.frombuffer("".join(many).encode("utf-32-le"), "<u4").astype(np.uint64)
    starts = np.concatenate([[0], np.cumsum(lengths + ORDER)])[:-1]
    out = np.full(int((lengths + ORDER).sum()), START, np.uint64)
    at = np.repeat(starts + ORDER - 1 - np.concatenate([[0], np.cumsum(lengths)])[:-1], lengths) + np.arange(len(chars))
    out[at] = chars
    out[starts + ORDER - 1 + lengths] = STOP
    return out, starts


def grams(chars: np.ndarray, at: np.ndarray, n: int) -> np.ndarray:
    """Hashes of the n-grams that end at the positions at; of none: 0."""
    h = np.zeros(len(at), np.uint64)
    for i in range(n - 1, -1, -1):
        h = (h + chars[at - i] + np.uint64(1)) * _MIX
        h ^= h >> np.uint64(29)
    return h


@dataclass
class Model:
    """Of each order n (index n - 1): sorted hashes of n-grams with their discounted chances by language, and sorted hashes of
    contexts with the share left for the lower order. A context that a language never had leaves all of it."""

    languages: list[str]
    keys: list[np.ndarray]
    chances: list[np.ndarray]
    contexts: list[np.ndarray]
    rests: list[np.ndarray]
    typical: np.ndarray  # mean cross-entropy of each language's own texts
    spread: np.ndarray  # standard deviation of long texts' cross-entropies, from the median of the absolute deviations
    noise: np.ndarray  # what a single character adds to it: a text of n characters has noise / sqrt(n)
    most: np.ndarray  # deviations above the typical one that accepted texts have at most
    sharpness: float

    def deviation(self, j: int, n: np.ndarray | float) -> np.ndarray | float:
        """Standard deviation of the cross-entropy of texts of n characters in language j."""
        return np.sqrt(self.spread[j] ** 2 + self.noise[j] ** 2 / n)

    def log_chance(self, chars: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Natural logarithms, by position and language, of the interpolated chance of the character there."""
        p = np.full((len(at), len(self.languages)), UNSEEN)
        for n in range(1, ORDER + 1):
            p = p * _found(self.contexts[n - 1], self.rests[n - 1], grams(chars, at - 1, n - 1), 1.0)
            p += _found(self.keys[n - 1], self.chances[n - 1], grams(chars, at, n), 0.0)
        return np.log(p)

    def word_scores(self, many: list[str]) -> np.ndarray:
        """By word: sums of log chances by language, and the number of characters with the stop mark."""
        chars, starts = coded(many)
        ends = np.concatenate([starts[1:], [len(chars)]])
        real = np.ones(len(chars), bool)
        for i in range(ORDER - 1):
            real[starts + i] = False
        at = np.flatnonzero(real)
        sizes = ends - starts - (ORDER - 1)
        first = np.concatenate([[0], np.cumsum(sizes)])[:-1]
        return np.concatenate([np.add.reduceat(self.log_chance(chars, at), first, axis=0), sizes[:, None]], axis=1)


def _found(keys: np.ndarray, rows: np.ndarray, wanted: np.ndarray, missing: float) -> np.ndarray:
    if not len(keys):
        return np.full((len(wanted), rows.shape[1]), missing)
    i = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    out = rows[i]
    out[keys[i] != wanted] = missing
    return out


def _table(keys: np.ndarray, columns: list[tuple[np.ndarray, np.ndarray]], missing: float) -> tuple[np.ndarray, np.ndarray]:
    rows = np.full((len(keys), len(columns)), missing)
    for j, (k, v) in enumerate(columns):
        rows[np.searchsorted(keys, k), j] = v
    return keys, rows


def fit(counts: dict[str, tuple[list[str], np.ndarray]]) -> Model:
    """Interpolated Kneser-Ney: the highest order counts n-grams, lower ones the different characters before them; the discount is
    n1 / (n1 + 2 n2). counts: of each language its words and how often each came."""
    languages = sorted(counts)
    chances: list[list] = [[] for _ in range(ORDER)]
    rests: list[list] = [[] for _ in range(ORDER)]
    for lang in languages:
        many, often = counts[lang]
        chars, starts = coded(many)
        weight = np.repeat(often, np.diff(np.concatenate([starts, [len(chars)]])))
        real = np.ones(len(chars), bool)
        for i in range(ORDER - 1):
            real[starts + i] = False
        at = np.flatnonzero(real)
        longer = None
        for n in range(ORDER, 0, -1):
            key, first, which = np.unique(grams(chars, at, n), return_index=True, return_inverse=True)
            if n == ORDER:
                c = np.bincount(which, weight[at])
            else:
                c = np.bincount(which[longer], minlength=len(key)).astype(float)
            longer = first
            context, of = np.unique(grams(chars, at[first] - 1, n - 1), return_inverse=True)
            n1, n2 = (c == 1).sum(), (c == 2).sum()
            d = min(0.95, max(0.05, n1 / max(1, n1 + 2 * n2)))
            total = np.bincount(of, c)
            chances[n - 1].append((key, np.maximum(c - d, 0) / total[of]))
            rests[n - 1].append((context, 1 - np.bincount(of, np.maximum(c - d, 0)) / total))
    made = [_table(np.unique(np.concatenate([k for k, _ in x])), x, 0.0) for x in chances]
    left = [_table(np.unique(np.concatenate([k for k, _ in x])), x, 1.0) for x in rests]
    blank = np.zeros(len(languages))
    return Model(languages, [k for k, _ in made], [v for _, v in made], [k for k, _ in left], [v for _, v in left], blank, blank + 1, blank + 1, blank + np.inf, 1.0)


def calibrate(model: Model, texts: list[tuple[str, np.ndarray]]) -> Model:
    """Sets, from (language, sums of log chances and characters) of texts that the models were not fitted on, what cross-entropy is
    typical and when a text is rejected, and the sharpness for which the scores have the least log loss."""
    own = np.array([model.languages.index(l) for l, _ in texts], np.int64)
    sums = np.array([s for _, s in texts]).reshape(len(texts), len(model.languages) + 1)
    entropy, n = -sums[:, :-1] / sums[:, -1:], sums[:, -1]
    for j in range(len(model.languages)):
        mine = (own == j) & (entropy.argmin(axis=1) == j)
        if mine.sum() >= 5:
            e, k = entropy[mine, j], n[mine]
            model.typical[j] = np.median(e[k >= np.median(k)])
            away = e - model.typical[j]
            long = k >= LONG if (k >= LONG).sum() >= 5 else np.ones(len(k), bool)
            model.spread[j] = max(0.02, 1.4826 * np.median(np.abs(away[long])))
            model.noise[j] = max(1.0, 1.4826 * np.median(np.abs(away[~long]) * np.sqrt(k[~long]))) if (~long).any() else 2.0
            model.most[j] = limit(away / model.deviation(j, k))
    known = np.isfinite(model.most)
    for j in np.flatnonzero(~known) if known.any() else []:  # too few texts: as lenient as the most lenient of the others
        model.typical[j], model.spread[j], model.noise[j], model.most[j] = (x[known].max() for x in (model.typical, model.spread, model.noise, model.most))
    if len(texts):
        loss = {}
        for sharp in (0.25, 0.5, 1.0, 2.0, 4.0, 8.0, 16.0, 32.0):
            p = posterior(entropy, n, sharp)
            loss[sharp] = -np.log(np.maximum(p[np.arange(len(own)), own], 1e-4)).mean()
        model.sharpness = min(loss, key=lambda s: (round(loss[s], 6), s))
    return model


def limit(deviations: np.ndarray, rate: float = FALSE_REJECTIONS) -> float:
    """What a share of rate of further texts like these exceeds: the order statistic that says so whatever their distribution is. Of too few texts
    for the rate: an exponential tail as heavy as their upper half, and FEW at least."""
    x = np.sort(deviations)
    rank = int(np.ceil((len(x) + 1) * (1 - rate)))
    if rank <= len(x):
        return float(x[rank - 1])
    middle = float(np.median(x))
    scale = float(np.median(np.maximum(x[x >= middle] - middle, 0))) / np.log(2)
    return max(FEW, middle + scale * float(np.log(0.5 / rate)))


def posterior(entropy: np.ndarray, n: np.ndarray, sharpness: float) -> np.ndarray:
    """Chances of the languages from length-normalised cross-entropies; long texts are surer, but not in proportion."""
    x = -entropy * (sharpness * np.sqrt(n))[:, None]
    x = np.exp(x - x.max(axis=1, keepdims=True))
    return x / x.sum(axis=1, keepdims=True)


def learned(docs: DataFrame) -> Model | None:
    """Fits the models on about SAMPLE documents of each language in docs(doc_id, text, lang), chosen by a hash of the id, and calibrates
    them on about CALIBRATE others; whole texts. A language of under FEW_TEXTS documents is fitted on all of them and calibrated by models
    of one half on the other half. The driver gets the counts of the sample's words and three numbers or so per text."""
    usable = docs.where("lang is not null and text is not null").select("doc_id", "text", "lang")
    n = {r["lang"]: r["n"] for r in usable.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    if not n:
        return None
    draw = F.pmod(F.xxhash64(F.lit("langid"), "doc_id"), F.lit(1 << 20)) / float(1 << 20)
    fits, tells, small = F.lit(False), F.lit(False), F.lit(False)
    for lang, rows in n.items():
        own = F.col("lang") == lang
        if rows < FEW_TEXTS:
            small = small | own
            continue
        share = min(0.8, SAMPLE / rows)
        fits = fits | (own & (draw < share))
        tells = tells | (own & (draw >= share) & (draw < share + CALIBRATE / rows))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lang, text in zip(b.column(0).to_pylist(), b.column(1)):
                w, c = np.unique(np.array(words(text.as_py()), dtype=object), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(w)), pa.array(w.tolist(), pa.string()), pa.array(c.tolist(), pa.int64())], ["lang", "w", "c"])

    def fitted(which) -> Model | None:
        counts: dict[str, tuple[list[str], list[int]]] = {}
        found = usable.where(which).select("lang", "text").mapInArrow(run, "lang string, w string, c long").groupBy("lang", "w").agg(F.sum("c").alias("c"))
        for r in found.orderBy("lang", "w").collect():
            own = counts.setdefault(r["lang"], ([], []))
            own[0].append(r["w"]), own[1].append(r["c"])
        return fit({lang: (w, np.array(c, float)) for lang, (w, c) in counts.items()}) if counts else None

    def told(by: Model, which) -> list[tuple[str, np.ndarray]]:
        """Sums of texts by a model that was not fitted on them, in the order of the final model's languages; one that by lacks is far off."""
        out = []
        for r in entropies(usable.where(which & F.col("lang").isin(*by.languages)), by).where("sums is not null").collect():
            at = {lang: s for lang, s in zip(by.languages, r["sums"])}
            out.append((r["lang"], np.array([at.get(lang, -1e6 * r["sums"][-1]) for lang in model.languages] + [r["sums"][-1]])))
        return out

    model = fitted(fits | small)
    if model is None:
        return None
    texts = told(model, tells)
    if min(n.values()) < FEW_TEXTS:
        # Languages of few texts are fitted on all of them, and calibrated on each half by models of the other half.
        half = F.pmod(F.xxhash64(F.lit("half"), "doc_id"), F.lit(2))
        for i in (0, 1):
            other = fitted(fits | (small & (half == i)))
            texts += told(other, small & (half != i)) if other else []
    return calibrate(model, sorted(texts, key=lambda t: (t[0], t[1].tolist())))


def entropies(docs: DataFrame, model: Model) -> DataFrame:
    """(lang, sums) of docs(lang, text): sums of log chances by language and the number of characters; null without letters."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(sent.value)
        for b in batches:
            for i in range(0, b.num_rows, 64):
                part = b.slice(i, 64)
                sums = scorer.sums([words(t.as_py()) for t in part.column(1)])
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([None if s is None else s.tolist() for s in sums], pa.list_(pa.float64()))], ["lang", "sums"])

    return docs.select("lang", "text").mapInArrow(run, "lang string, sums array<double>")


class Scorer:
    """Sums of log chances of texts. Words are scored once and kept, up to WORDS_KEPT of them."""

    def __init__(self, model: Model) -> None:
        self.model, self.width = model, len(model.languages) + 1
        self.clear()

    def clear(self) -> None:
        self.known: dict[str, int] = {}
        self.rows = np.zeros((1 << 12, self.width))

    def sums(self, texts: list[list[str]]) -> list[np.ndarray | None]:
        if len(self.known) > WORDS_KEPT:
            self.clear()
        new = list({w for own in texts for w in own if w not in self.known})
        if new:
            at = len(self.known)
            while at + len(new) > len(self.rows):
                self.rows = np.concatenate([self.rows, np.zeros_like(self.rows)])
            for i in range(0, len(new), 20_000):
                part = new[i : i + 20_000]
                self.rows[at + i : at + i + len(part)] = self.model.word_scores(part)
            self.known.update(zip(new, range(at, at + len(new))))
        return [self.rows[np.fromiter(map(self.known.__getitem__, own), np.int64, len(own))].sum(axis=0) if own else None for own in texts]


def identified(docs: DataFrame, model: Model | None) -> DataFrame:
    """(doc, language): the whole row of docs as a struct, so that no column can clash, and a struct language(lang_pred, score, accepted).

    lang_pred has the lowest length-normalised cross-entropy (ties: first by name); und, score 0, not accepted, where the text is
    null or has no letter, or where nothing was learned. accepted is false where that cross-entropy is further above
    the typical one of the language than calibrate() allows for texts of that length.
    """
    spark = docs.sparkSession
    sent = spark.sparkContext.broadcast(model)  # the n-grams of SAMPLE documents for each language
    source = docs.select(F.struct("*").alias("doc"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = sent.value
        scorer = Scorer(own) if own else None
        for b in batches:
            for i in range(0, b.num_rows, 64):
                part = b.slice(i, 64)
                texts = [words(t.as_py()) if own else [] for t in part.column(0).field("text")]
                lang, score, accepted = [], [], []
                for s in scorer.sums(texts) if own else [None] * part.num_rows:
                    if s is None:
                        lang.append("und"), score.append(0.0), accepted.append(False)
                        continue
                    entropy, n = -s[:-1] / s[-1], s[-1]
                    j = int(entropy.argmin())
                    lang.append(own.languages[j])
                    score.append(float(posterior(entropy[None], np.array([n]), own.sharpness)[0, j]))
                    accepted.append(bool(entropy[j] - own.typical[j] <= own.most[j] * own.deviation(j, n)))
                found = pa.StructArray.from_arrays([pa.array(lang, pa.string()), pa.array(score, pa.float64()), pa.array(accepted, pa.bool_())], ["lang_pred", "score", "accepted"])
                yield pa.RecordBatch.from_arrays([part.column(0), found], ["doc", "language"])

    kind = T.StructType([source.schema["doc"], T.StructField("language", T.StructType([T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("accepted", T.BooleanType())]))])
    return source.mapInArrow(run, kind)


def may_learn() -> F.Column:
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 != 1, F.lit(True))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = identified(docs.select("doc_id", "text"), learned(docs.where(may_learn())))
    return found.select("doc.doc_id", "language").select("doc_id", (~may_learn()).alias("held_out"), "language.lang_pred", "language.score", "language.accepted")
