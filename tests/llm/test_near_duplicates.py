import random
from itertools import combinations

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
import xxhash

from crumbline.llm import ann, components, embed_dedup, registry, shingle_dedup, simhash
from tests.twins import DATA, assert_twin


def closure(nodes, links):
    root = {n: n for n in nodes}

    def find(n):
        while root[n] != n:
            n = root[n]
        return n

    for a, b in links:
        x, y = sorted((find(a), find(b)))
        root[y] = x
    return {n: find(n) for n in nodes}


@pytest.mark.parametrize("edges", [[(1, 2), (2, 3), (9, 8)], [(i, i + 1) for i in range(60)], [(0, i) for i in range(1, 80)], [(5, 5)], []])
def test_components(spark, edges):
    df = spark.createDataFrame(edges, "a long, b long")
    got = {r.node: r.component for r in components.components(df, "a", "b").collect()}
    linked = {x for a, b in edges if a != b for x in (a, b)}
    assert got == {n: c for n, c in closure(linked, [e for e in edges if e[0] != e[1]]).items()}


def brute_fingerprint(text):
    w = [x for x in "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").replace("\t", " ").replace("\n", " ").split(" ") if x]
    grams = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] or ([" ".join(w)] if w else [])
    h = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if h and 2 * sum(x >> b & 1 for x in h) > len(h))


def brute(rows):
    fp = {i: brute_fingerprint(t) for i, t in rows}
    return fp, closure(fp, [(a, b) for a, b in combinations(fp, 2) if (fp[a] ^ fp[b]).bit_count() <= 3])


def made_documents(n=260, seed=4):
    rng = random.Random(seed)
    vocabulary = [f"W{i}" for i in range(300)]
    texts = [None, "", " \t\n", "one", "one Two", "ONE two"]
    for _ in range(n // 8):
        w = rng.choices(vocabulary, k=rng.randrange(5, 120))
        texts.append(" ".join(w))
        for _ in range(rng.randrange(0, 6)):
            v = list(w)
            v[rng.randrange(len(v))] = rng.choice(vocabulary)
            texts.append(" ".join(v))
    return list(enumerate(texts))


def test_simhash_equals_brute_force(spark):
    rows = made_documents()
    fp, want = brute(rows)
    got = simhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r.doc_id: (r.fp % (1 << 64), r.component_id) for r in got} == {i: (fp[i], want[i]) for i, _ in rows}


def test_simhash_large_buckets(spark, monkeypatch):
    """Small limits send the same fingerprints through the second deal and the shared neighbours."""
    monkeypatch.setattr(simhash, "BUCKET", 2)
    rng = random.Random(5)
    centre = [rng.getrandbits(64) for _ in range(4)]
    prints = {c ^ sum(1 << b for b in rng.sample(range(64), rng.randrange(0, 5))) for c in centre for _ in range(40)}
    signed = [x - (1 << 64) if x >> 63 else x for x in prints]
    links = simhash.links(spark.createDataFrame([(x,) for x in signed], "fp long")).collect()
    want = closure(signed, [(a, b) for a, b in combinations(signed, 2) if ((a ^ b) % (1 << 64)).bit_count() <= 3])
    assert closure(signed, [(r.fp, r.other) for r in links]) == want
    assert all(((r.fp ^ r.other) % (1 << 64)).bit_count() <= 3 or want[r.fp] == want[r.other] for r in links)


def test_thresholds_cover_all_pairs():
    rng = np.random.default_rng(6)
    t = simhash.allocate([rng.integers(0, 5, 1 << w).astype(float) for w in (6, 6, 5, 7)])
    assert sum(x + 1 for x in t) == 4
    skewed = np.zeros(64)
    skewed[0] = 1e6
    assert simhash.allocate([skewed, np.full(64, 1e6 / 64), np.full(64, 1e6 / 64), np.full(64, 1e6 / 64)])[0] == -1


def test_simhash_edges(spark):
    kind = "doc_id long, text string, component_id string, fp int"
    assert simhash.near_duplicates(spark.createDataFrame([], kind)).count() == 0
    df = spark.createDataFrame([(5, "a b c d", "x", 1), (5, "a b c d", "x", 1), (None, "a b c d", "x", 1), (2, "other words entirely here", None, None), (9, "z" * 300_000, "x", 1)], kind)
    assert sorted((str(r.doc_id), str(r.component_id)) for r in simhash.near_duplicates(df).collect()) == [("2", "2"), ("5", "5"), ("5", "5"), ("9", "9"), ("None", "5")]
    kept = simhash.keep_first(df, shingle_dedup.grouped)
    assert kept.columns == df.columns
    assert sorted(str(r.doc_id) for r in kept.collect()) == ["2", "5", "9"]
    assert simhash.keep_first(df.limit(0), shingle_dedup.grouped).count() == 0


def test_different_texts_under_one_id_stay(spark):
    rows = [(5, "one text about something"), (5, "quite another text of other words"), (None, "a third one"), (None, "a third one"), (6, "one text about something"), (5, "one text about something")]
    kept = simhash.keep_first(spark.createDataFrame(rows, "doc_id long, text string"), shingle_dedup.grouped).collect()
    assert sorted((str(r.doc_id), r.text) for r in kept) == [("5", "one text about something"), ("5", "quite another text of other words"), ("None", "a third one")]


def vectors(seed=7, n=120, d=24):
    rng = np.random.default_rng(seed)
    rows = []
    for i in range(n):
        v = rng.normal(size=d)
        rows.append((v, int(rng.integers(0, 3))))
        for _ in range(int(rng.integers(0, 4))):
            rows.append((v + rng.normal(size=d) * rng.choice([0, 0.1, 0.14, 0.2]), rows[-1][1]))
    return [(i, [float(np.float32(y)) for y in v], label) for i, (v, label) in enumerate(rows)]


ODD = [(1000, None, 1), (1001, [0.0] * 24, 1), (1002, [float("nan")] + [1.0] * 23, 1), (1003, [None] + [1.0] * 23, 1), (1004, [1.0] * 24, None), (1005, [1.0] * 24, None), (1006, [float("inf")] * 24, 1), (1007, [1.0, 2.0], 1), (1008, [1.0, 2.0], 1)]
VECTORS = "vec_id long, embedding array<float>, label int"


def test_embedding_links_equal_brute_force(spark):
    rows = vectors()
    got = {r.vec_id: r for r in embed_dedup.near_duplicates(spark.createDataFrame(rows + ODD, VECTORS)).collect()}
    x = np.array([v for _, v, _ in rows])
    x /= np.sqrt((x * x).sum(axis=1, keepdims=True))
    cos = x @ x.T
    links = [(a, b) for a, b in combinations(range(len(rows)), 2) if cos[a, b] >= 0.98 and rows[a][2] == rows[b][2]]
    want = closure(range(len(rows)), links)
    for i, _, _ in rows:
        assert (got[i].n_links, got[i].component_id, got[i].kept) == (sum(i in p for p in links), want[i], want[i] == i)
    for i, *_ in ODD[:7]:
        assert (got[i].n_links, got[i].component_id, got[i].kept) == (0, i, True)
    assert (got[1007].n_links, got[1008].component_id) == (1, 1007)


def test_embedding_blocks_count_each_link_once(spark, monkeypatch):
    monkeypatch.setattr(embed_dedup, "BLOCK", 5)
    rng = np.random.default_rng(8)
    centre = rng.normal(size=16)
    rows = [(i, (centre + rng.normal(size=16) * 0.02).tolist(), 1) for i in range(60)]
    got = embed_dedup.near_duplicates(spark.createDataFrame(rows, VECTORS)).collect()
    assert {(r.n_links, r.component_id) for r in got} == {(59, 0)}
    assert embed_dedup.near_duplicates(spark.createDataFrame([], VECTORS)).count() == 0


@pytest.mark.parametrize("d", [16, 64, 300])
def test_planted_pairs_at_the_least_cosine_are_found(spark, d):
    """Production constants: of pairs just above 0.98 one in 10,000 may be missed, and text labels are labels."""
    rng = np.random.default_rng(d)
    a, b = rng.normal(size=(2, 1200, d))
    a = embed_dedup.unit(a)
    b = embed_dedup.unit(b - (a * b).sum(axis=1, keepdims=True) * a)
    c = 0.9803 * a + np.sqrt(1 - 0.9803**2) * b
    rows = [(i, v.tolist(), f"l{i % 2}") for i, v in enumerate(a)] + [(i + 5000, v.tolist(), f"l{i % 2}") for i, v in enumerate(c)]
    got = embed_dedup.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label string")).collect()
    assert sum(r.n_links for r in got) / 2 >= 1199
    assert all(r.component_id == r.vec_id % 5000 for r in got if r.n_links)


def test_embedding_query_equals_sql(spark):
    assert_twin(spark, embed_dedup.query, embed_dedup.ORACLE)


def exact_nearest(rows, asks, k=5):
    ids, x = np.array([r[0] for r in rows]), np.array([r[1] for r in rows], float)
    x = x / np.sqrt((x * x).sum(axis=1, keepdims=True))
    out = {}
    for i in np.flatnonzero(asks(ids)):
        s = x @ x[i]
        order = [j for j in np.lexsort((ids, -np.round(s, 12))) if ids[j] != ids[i]][:k]
        out[int(ids[i])] = [(int(ids[j]), s[j]) for j in order]
    return out


def test_nearest_with_graph_and_pruning(spark, monkeypatch):
    monkeypatch.setattr(ann, "LIST", 8)
    monkeypatch.setattr(ann, "BLOCK", 16)
    monkeypatch.setattr(ann, "BEAM", 24)
    monkeypatch.setattr(ann, "RECALL", 0.98)
    rows = vectors(9, 1200, 16)
    got = ann.nearest(spark.createDataFrame(rows + ODD, VECTORS), ann.F.col("vec_id") % 50 == 0).collect()
    want = exact_nearest(rows, lambda i: i % 50 == 0)
    by_query = {q: [(r.vec_id, r.score) for r in sorted(got, key=lambda r: r["rank"]) if r.query_id == q] for q in want}
    hits = [len({i for i, _ in by_query[q]} & {i for i, _ in want[q]}) / 5 for q in want]
    assert np.mean(hits) >= 0.9
    exact = {(q, i): s for q, row in want.items() for i, s in row}
    assert all(abs(s - exact[q, i]) < 1e-12 for q, row in by_query.items() for i, s in row if (q, i) in exact)
    assert all(len(row) == 5 for row in by_query.values())


@pytest.mark.parametrize("kind", ["clusters", "noise"])
def test_recall_with_production_constants(spark, kind, tmp_path):
    """More than 256 lists, so the graph is walked in earnest."""
    rng = np.random.default_rng(12)
    n, d = 70_000, 12 if kind == "noise" else 32
    x = rng.normal(size=(n, d)) + (0 if kind == "noise" else 3 * rng.normal(size=(500, d))[rng.integers(0, 500, n)])
    x = x.astype(np.float32)
    pq.write_table(pa.table({"vec_id": np.arange(n), "embedding": pa.FixedSizeListArray.from_arrays(x.reshape(-1), d).cast(pa.list_(pa.float32()))}), tmp_path / "v.parquet", row_group_size=10_000)
    df = spark.read.parquet(str(tmp_path / "v.parquet")).repartition(8)
    got = ann.nearest(df, ann.F.col("vec_id") % 200 == 0).toPandas()
    y = x.astype(float)
    y /= np.sqrt((y * y).sum(axis=1, keepdims=True))
    s = y[::200] @ y.T
    s[np.arange(len(s)), np.arange(0, n, 200)] = -2
    want = {int(q): set(np.argsort(-row)[:5].tolist()) for q, row in zip(np.arange(0, n, 200), s)}
    found = got.groupby("query_id")["vec_id"].agg(set).to_dict()
    assert np.mean([len(found[q] & w) / 5 for q, w in want.items()]) >= 0.9


def test_one_id_with_several_vectors(spark):
    rows = [(0, [1.0, 0.0], 1), (0, [0.0, 1.0], 1), (1, [1.0, 0.1], 1), (1, [0.1, 1.0], 1), (2, [1.0, 1.0], 1)]
    got = ann.nearest(spark.createDataFrame(rows, VECTORS), ann.F.col("vec_id") == 0).collect()
    assert [(r["rank"], r.vec_id) for r in sorted(got, key=lambda r: r["rank"])] == [(1, 1), (2, 2)]


def test_nearest_few_rows_ties_and_copies(spark):
    rows = [(0, [1.0, 0.0], 1), (1, [1.0, 0.0], 1), (2, [1.0, 0.0], 1), (3, [0.0, 1.0], 1), (50, [1.0, 0.0], 1), (4, [0.0, 0.0], 1), (None, [1.0, 0.0], 1), (3, [0.0, 1.0], 1)]
    got = ann.nearest(spark.createDataFrame(rows, VECTORS), ann.F.col("vec_id") % 50 == 0).collect()
    assert [(r["rank"], r.vec_id, r.score) for r in sorted(got, key=lambda r: (r.query_id, r["rank"])) if r.query_id == 0] == [(1, 1, 1.0), (2, 2, 1.0), (3, 50, 1.0), (4, 3, 0.0)]
    assert ann.nearest(spark.createDataFrame([], VECTORS), ann.F.lit(True)).count() == 0


def test_every_query_is_registered():
    assert sorted(int(n.split("_")[0][2:]) for n in registry.QUERIES) == list(range(1, 14))
    assert DATA
