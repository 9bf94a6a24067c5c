"""Fits the trees of pii.py and writes pii_model.json: python -m crumbline.llm.pii_train DOCUMENTS

Sentences by templates and sentences as people write them (WRITTEN) are labelled; of the texts in DOCUMENTS that hold no base span every candidate
counts as wrong. Trees are fitted on two thirds of the templates and of the documents; the thresholds, one per kind, are calibrated on WRITTEN
and on the other third of the documents and templates.
"""

from __future__ import annotations

import json
import sys

import numpy as np
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from . import pii
from .common import asset

#: Sentences; trees and their depth; learning rate; least share of the candidates above the threshold that are right, on held-out ones.
SENTENCES, TREES, DEPTH, RATE, PRECISION, SEED = 6000, 40, 3, 0.3, 0.99, 3


def sentences(rng: np.random.Generator, n: int) -> list[tuple[str, int]]:
    """(text, 1 if it holds personal data in a form that the base patterns miss)."""
    pick = lambda *a: a[rng.integers(len(a))]
    num = lambda k: "".join(map(str, rng.integers(0, 10, k)))
    name = lambda: pick("anna", "j.smith", "maria.lopez", "tom", "k_weber", "info", "li.wei", "paul-b")
    site = lambda: pick("example", "mail", "post", "uni-x", "web", "acme")
    end = lambda: pick("com", "org", "net", "de", "fr", "es")

    def card() -> str:
        d = [int(x) for x in num(15)]
        total = sum(x if i % 2 else (2 * x - 9 * (2 * x > 9)) for i, x in enumerate(d))
        s = "".join(map(str, d)) + str(-total % 10)
        return pick(".", "_", "/").join(s[i : i + 4] for i in range(0, 16, 4))

    def phone() -> str:
        return pick(f"({num(3)}) {num(3)}-{num(4)}", f"{num(3)}-{num(3)}-{num(4)}", f"{num(3)}.{num(3)}.{num(4)}", f"0{num(3)} {num(3)} {num(4)}", f"0{num(2)}/{num(4)}/{num(4)}")

    good = [
        lambda: f"{pick('Call me', 'My phone is', 'Tel.', 'Dial', 'mobile:', 'Fax')} {phone()} {pick('today', 'please', 'now')}",
        lambda: f"{pick('write', 'my mail is', 'contact', 'reach me:', '')} {name()} {pick('[at]', '(at)', ' at ')} {site()} {pick('[dot]', '(dot)', ' dot ')} {end()}",
        lambda: f"{pick('contact', 'mail', 'ask', 'write to', 'reach')} {name()} at {site()}.{end()} {pick('for details', 'today', 'about it', '')}",
        lambda: f"{pick('card', 'my visa', 'credit card no', 'payment by card')} {card()}",
        lambda: f"{pick('server', 'login from', 'host', 'IP')} {pick('[.]', '(.)').join(str(x) for x in rng.integers(0, 256, 4))}",
        lambda: f"{pick('server', 'IP', 'from')} {':'.join(f'{x:x}' for x in rng.integers(0, 65536, 8))}",
    ]
    bad = [
        lambda: f"{pick('order', 'invoice', 'ref', 'ticket', 'part', 'code', 'version', 'isbn', 'total')} {pick(phone(), f'{num(4)}-{num(2)}-{num(2)}', f'{num(3)} {num(3)} {num(3)}')}",
        lambda: f"{pick('the sum was', 'rows', 'between', 'we counted', 'on')} {pick(f'{num(2)} {num(3)} {num(3)}', f'{num(4)}-{num(2)}-{num(2)}', f'{num(2)}.{num(2)}.{num(4)}', f'{num(3)} {num(4)} {num(2)}')} {pick('units', 'of them', 'pages')}",
        lambda: f"{pick('look', 'we meet', 'arrive', 'stay')} at {pick('noon', 'home', 'school', 'work')}. {pick('Then', 'We', 'It', 'They')} go",
        lambda: f"{pick('we', 'they', 'I')} {pick('were', 'stood', 'sat')} at {pick('dinner', 'sea', 'lunch')}. {pick('Then', 'Now', 'But')}",
        lambda: f"{pick('they met', 'he stayed', 'she looked', 'we arrived', 'it ended')} at {pick('noon', 'home', 'him', 'sea', 'work', 'peace')}.{pick('Then', 'It', 'They', 'We', 'And', 'He')} {pick('left', 'slept', 'went on')}",
        lambda: f"{pick('on', 'since', 'until', 'born', 'between')} {pick(f'20{num(2)}-0{rng.integers(1, 10)}-1{num(1)} 20{num(2)}', f'19{num(2)} 20{num(2)} 20{num(2)}', f'1{num(1)}.0{rng.integers(1, 10)}.20{num(2)}', f'19{num(2)} 1{num(1)} 0{num(1)}')} {pick('it rained', 'in Lyon', 'was quiet')}",
        lambda: f"{pick('rows', 'row', 'the numbers', 'temperatures', 'at', 'pages', 'ratio', 'coordinates')} {pick(' ', '-', '.', '/').join(num(pick(2, 3)) for _ in range(pick(3, 4, 5)))} {pick('were read', 'again', 'and more')}",
        lambda: f"{pick('serial', 'order', 'invoice', 'lot', 'part no.')} {pick('.', '_', '/').join(num(4) for _ in range(4))}",
        lambda: f"{pick('MAC', 'key', 'id')} {':'.join(num(2) for _ in range(8))} {pick('is taken', 'was lost')}",
        lambda: f"{pick('item', 'model', 'code')} {'.'.join(num(4) for _ in range(4))}",
    ]
    return [(pick(*good)(), 1) if rng.random() < 0.5 else (pick(*bad)(), 0) for _ in range(n)]


#: Sentences of no template. What stands between double angle brackets is personal data in a form that the base patterns miss.
WRITTEN = [
    "mail me: <<anna at example dot com>> before Friday", "You can contact <<sales at acme.com>> for a quote.", "Questions? <<k.weber (at) uni-bonn (dot) de>>", "the list owner is <<tom[at]gnu[dot]org>>, ask him",
    "Send it to <<billing at shop dot co dot uk>>, not to me", "schreib an <<jana{at}posteo{dot}de>> bitte", "contact: <<press AT museum DOT org>>", "He signed as <<j_doe at mail.example.net>> and left.",
    "Give us a call on <<020 7946 0018>> after six", "My cell is <<415-555-0133>>, leave a message", "Tel. <<(030) 901 820>> in der Verwaltung", "fax <<0221/9988/7766>>", "phone <<503.555.0199>> or drop by", "ring me, <<07700 900 123>>",
    "card <<4539.1488.0343.6467>> was declined", "my visa <<4716_2210_5188_5662>> expires in May", "pay with <<5425/2334/3010/9903>> please",
    "the host <<10[.]0[.]12[.]7>> sent spam", "blocked <<203(.)0(.)113(.)9>> at the firewall", "server <<fe80:0:0:0:2aa:ff:fe9a:4ca2>> is down", "login from <<2001:db8:0:1:1:1:1:1>> at noon",
    "on 2024-01-02 2024 was still young", "We met at noon. Then it rained.", "she looked at him.They left", "born 1984 12 03 in Lyon", "between 1999 2004 and 2010 2014 sales fell", "ISBN 978 3 16 148410 0 is out of print",
    "version 10.4.1 2023 replaced 9.8.7 2022", "invoice 2023/0042/1177 is open", "see pages 112-115-120 and 130", "the score was 21 19 21 17", "order 4400.1200.9000.1111 shipped", "part no. 1234_5678_9012_3456", "at 12.30 15.45 18.00 20.15 trains leave",
    "chapter 10 20 30 40 of the index", "He stayed at home.It was late", "a look at page dot matrix printing", "row 100 200 300 400 500", "12.05.2019 14.05.2019 are taken", "arrive at platform 9.Bring tickets", "total 120 500 300 units", "meet at the dot com office",
    "coordinates 48 51 24 north", "ratio 16/09/2024 to 17/09/2024", "temperatures 21 23 25 22 20", "looking at www.example.org pages", "they were at peace.And quiet", "at version 2.x we stopped", "MAC 00:1A:2B:3C:4D:5E:6F:70 is taken", "serial 1111/2222/3333/4444",
]


def labelled(marked: str) -> tuple[str, list[tuple[int, int]]]:
    """The text without the brackets, and (start, end) of what stood between them."""
    text, spans = "", []
    for i, part in enumerate(marked.replace(">>", "<<").split("<<")):
        if i % 2:
            spans.append((len(text), len(text) + len(part)))
        text += part
    return text, spans


def boosted(x: np.ndarray, y: np.ndarray) -> tuple[list, float, np.ndarray]:
    """Gradient boosting for log loss with exact splits; the trees, the prior and the margins of x."""
    prior = float(np.log(y.mean() / (1 - y.mean())))
    margin, trees = np.full(len(y), prior), []
    for _ in range(TREES):
        p = 1 / (1 + np.exp(-margin))
        tree, value = _grown(x, y - p, p * (1 - p), np.arange(len(y)), DEPTH)
        margin = margin + value
        trees.append(tree)
    return trees, prior, margin


def _grown(x: np.ndarray, g: np.ndarray, h: np.ndarray, rows: np.ndarray, depth: int):
    out, best = np.zeros(len(g)), None
    score = lambda r: g[r].sum() ** 2 / (h[r].sum() + 1)
    if depth:
        for j in range(x.shape[1]):
            for cut in np.unique(x[rows, j])[:-1]:
                left, right = rows[x[rows, j] <= cut], rows[x[rows, j] > cut]
                gain = score(left) + score(right) - score(rows)
                if gain > 1e-6 and (best is None or gain > best[0] + 1e-12):
                    best = gain, j, float(cut), left, right
    if best is None:
        leaf = round(float(RATE * g[rows].sum() / (h[rows].sum() + 1)), 5)
        out[rows] = leaf
        return leaf, out
    _, j, cut, left, right = best
    a, va = _grown(x, g, h, left, depth - 1)
    b, vb = _grown(x, g, h, right, depth - 1)
    return [pii.FEATURES[j], cut, a, b], va + vb


def value(trees: list, prior: float, row: dict) -> float:
    total = prior
    for t in trees:
        while isinstance(t, list):
            t = t[2] if row[t[0]] <= t[1] else t[3]
        total += t
    return total


def threshold(scores: np.ndarray, y: np.ndarray) -> float:
    """Halfway between the lowest score above which at least PRECISION of the candidates are right and the best one below that; infinite without right ones."""
    order = np.argsort(-scores, kind="stable")
    right = np.cumsum(y[order]) / np.arange(1, len(order) + 1)
    last = [i for i in range(len(order)) if right[i] >= PRECISION and (i + 1 == len(order) or scores[order[i + 1]] < scores[order[i]])]
    if not last:
        return 1e9
    below = float(scores[order[last[-1] + 1]]) if last[-1] + 1 < len(order) else float(scores[order[last[-1]]]) - 0.2
    return round((float(scores[order[last[-1]]]) + below) / 2, 4)


def train(spark: SparkSession, documents: str) -> dict:
    rng = np.random.default_rng(SEED)
    rows = [(i, t, y) for i, (t, y) in enumerate(sentences(rng, SENTENCES))]
    made = spark.createDataFrame(rows, "i long, text string, y int").withColumn("c", F.explode(pii.candidates(F.col("text")))).select("i", "c.x", "y", F.lit(0).alias("start")).orderBy("i", "x").collect()
    texts = [labelled(w) for w in WRITTEN]
    own = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(texts)], "i long, text string").withColumn("c", F.explode(pii.candidates(F.col("text"))))
    own = [(r["x"], float(any(r["start"] < b and a < r["end"] for a, b in texts[r["i"]][1]))) for r in own.select("i", "c.x", "c.start", "c.end").orderBy("i", "start").collect()]
    docs = spark.read.parquet(documents).where("text is not null").select(F.col("doc_id").alias("i"), "text").where(F.size(pii.base_spans(F.col("text"))) == 0)
    wrong = docs.withColumn("c", F.explode(pii.candidates(F.col("text")))).select("i", "c.x", "c.start").orderBy("i", "start").collect()
    as_x = lambda xs: np.array([[x[k] for k in pii.FEATURES] for x in xs]).reshape(-1, len(pii.FEATURES))
    x = as_x([r["x"] for r in made] + [r["x"] for r in wrong])
    y = np.array([float(r["y"]) for r in made] + [0.0] * len(wrong))
    fits = np.array([r["i"] % 3 != 0 for r in made] + [r["i"] % 3 != 0 for r in wrong])
    trees, prior, _ = boosted(x[fits], y[fits])
    held_x, held_y = np.vstack([x[~fits], as_x([a for a, _ in own])]), np.concatenate([y[~fits], [b for _, b in own]])
    held = np.array([value(trees, prior, dict(zip(pii.FEATURES, r))) for r in held_x])
    kinds = held_x[:, pii.FEATURES.index("kind_no")]
    # Sentences that people write weigh as much as all others of their kind.
    said = np.concatenate([np.zeros(int((~fits).sum()), bool), np.ones(len(own), bool)])
    limits = {k: max(threshold(held[(kinds == i) & who], held_y[(kinds == i) & who]) for who in (said, ~said)) for i, k in enumerate(pii.KINDS)}
    recall = {k: round(float((held[(kinds == i) & (held_y > 0)] >= limits[k]).mean()), 3) for i, k in enumerate(pii.KINDS)}
    return {"prior": round(prior, 5), "thresholds": limits, "held_out": {"precision": PRECISION, "recall": recall, "candidates": len(held), "from_documents": len(wrong)}, "trees": trees}


if __name__ == "__main__":
    session = SparkSession.builder.master("local[4]").getOrCreate()
    made = train(session, sys.argv[1])
    with open(asset("pii_model.json"), "w") as f:
        json.dump(made, f, indent=0)
        f.write("\n")
    print(made["held_out"], made["thresholds"])
