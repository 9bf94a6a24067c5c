import random
from itertools import combinations

import corpus_pipeline as P
from crumbline.llm import shingle_dedup
from tests.llm.test_near_duplicates import closure
from tests.twins import DATA


def grams(text):
    w = (text or "").lower().split()
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} or ({tuple(w)} if w else set())


def alike(a, b):
    return a == b or 5 * len(a & b) >= 4 * len(a | b)


def brute(rows):
    own = {i: grams(t) for i, t in rows}
    return closure(own, [(a, b) for a, b in combinations(own, 2) if alike(own[a], own[b])])


def changed(w, places):
    return [f"x{i}" if i in places else x for i, x in enumerate(w)]


def made(seed=9):
    rng = random.Random(seed)
    texts = [None, "", " \n", "one two", "ONE two"]
    for _ in range(20):
        w = [f"w{rng.randrange(400)}" for _ in range(rng.randrange(60, 200))]
        texts.append(" ".join(w))
        for _ in range(5):
            texts.append(" ".join(changed(w, rng.sample(range(len(w)), rng.randrange(1, 6)))))
    return list(enumerate(texts))


def test_stage_finds_what_brute_force_finds(spark):
    rows = made()
    want = brute(rows)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r.doc_id: r.component_id for r in shingle_dedup.near_duplicates(df).collect()} == want
    assert {r.doc_id for r in P.near_duplicates(spark, df, DATA).collect()} == set(want.values())


def test_chains_and_blocks(spark, monkeypatch):
    """Neighbours in a chain that the leader of a bucket isn't like are found, also when a bucket has several blocks."""
    monkeypatch.setattr(shingle_dedup, "BLOCK", 3)
    rng = random.Random(3)
    rows = []
    for c in range(3):
        w = [f"c{c}w{i}" for i in range(100)]
        for step in range(12):
            rows.append((len(rows), " ".join(w)))
            w = changed(w, {(step * 7) % 100}) if step % 4 else changed(w, set(rng.sample(range(100), 2)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r.doc_id: r.component_id for r in shingle_dedup.near_duplicates(df).collect()} == brute(rows)


def test_fingerprints_of_operator_4_find_pairs_by_themselves(spark, monkeypatch):
    """Without any min-wise key texts are still linked whose fingerprints are three bits apart or less, if they are alike, and no others."""
    from crumbline.llm import shingle_dedup, simhash

    base = [f"w{i}" for i in range(400)]
    changed = lambda i: " ".join(w if n != i else "other" for n, w in enumerate(base))
    apart = lambda t: (simhash.fingerprint(t, 5) ^ simhash.fingerprint(" ".join(base), 5)).bit_count()
    close = next(changed(i) for i in range(400) if 0 < apart(changed(i)) <= 3)
    docs = spark.createDataFrame([(1, " ".join(base)), (2, close), (3, "quite another text of a few words"), (4, None), (5, "")], "doc_id long, text string")
    monkeypatch.setattr(shingle_dedup, "shared", lambda nodes: nodes.selectExpr("0L bucket", "node").where("false"))
    got = {r.doc_id: r.component_id for r in shingle_dedup.near_duplicates(docs).collect()}
    assert got == {1: 1, 2: 1, 3: 3, 4: 4, 5: 4}
