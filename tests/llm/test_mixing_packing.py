import random
import zlib
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from crumbline.llm import mixing, packing
from tests.twins import DATA, assert_twin

KIND = "doc_id long, text string, source string, size int, mix string"


@pytest.fixture(scope="module")
def docs(spark):
    rng = random.Random(1)
    rows = [(i, " ".join(["w"] * int(rng.paretovariate(0.8))), rng.choice(["a", "a", "a", "b", "c", None]), 1, "x") for i in range(3000)]
    return spark.createDataFrame([*rows, (None, None, "a", 1, "x"), (7, "", "d", 1, "x"), (8, "again", "e", 1, "x"), (8, "again", "e", 1, "x")], KIND)


def sized(docs):
    return docs.select(F.col("doc_id").alias("doc"), "source", F.col("doc_id").alias("id"), mixing.n_words(F.col("text")).alias("size"))


def test_mix_equals_sql(spark):
    assert_twin(spark, mixing.query, mixing.ORACLE)


def test_targets_stop_at_twice_the_size(spark):
    t = {r.source: r for r in mixing.targets(spark.createDataFrame([("a", 10, 1), ("b", 1000, 1), ("c", 10, 1), (None, 500, 1)], "source string, source_size long, source_docs long")).collect()}
    total = 1.5 * 1520
    assert sum(r.target for r in t.values()) == pytest.approx(total)
    assert t["a"].target == 20 and t["c"].target == 20
    assert t[None].target == pytest.approx(1000)  # weight 5 again: the fourth source; it stops as well
    assert t["b"].target == pytest.approx(total - 1040)


def test_targets_share_everything_by_weight(spark):
    rng = random.Random(3)
    rows = [(f"s{i:02}", rng.choice([0, 5, 100, 1000, 30_000]), 1) for i in range(25)]
    t = [r.target for r in sorted(mixing.targets(spark.createDataFrame(rows, "source string, source_size long, source_docs long")).collect(), key=lambda r: r.source)]
    assert sum(t) == pytest.approx(1.5 * sum(n for _, n, _ in rows))
    level = {round(x / (5, 2, 1)[i % 3], 6) for i, (x, r) in enumerate(zip(t, rows)) if x < 2 * r[1]}
    assert len(level) == 1  # those below twice their size have one ratio of target to weight, and the others a lower one
    assert all(x / (5, 2, 1)[i % 3] <= min(level) for i, x in enumerate(t))


def test_mix_meets_targets_and_reruns_agree(docs):
    rows = mixing.mixed(sized(docs)).select("doc", "mix.*").collect()
    assert len(rows) == 3004
    again = sorted(map(str, mixing.mixed(sized(docs.repartition(7))).select("doc", "mix.*").collect()))
    assert sorted(map(str, rows)) == again
    taken, most, goal = defaultdict(int), defaultdict(int), {}
    for r in rows:
        assert 0 <= r.copies <= 2
        taken[r.source_size] += r.copies * r["size"]
        most[r.source_size] = max(most[r.source_size], r["size"])
        goal[r.source_size] = r.target
    for s in taken:
        assert abs(taken[s] - goal[s]) <= 2 * most[s] + 1


def test_mix_documents_keeps_columns(docs):
    out = mixing.mix_documents(docs)
    assert out.columns == docs.columns
    assert out.count() == mixing.mixed(sized(docs)).agg(F.sum("mix.copies")).first()[0]
    assert mixing.mix_documents(docs.limit(0)).count() == 0


def test_encoder_equals_tokenizer():
    e = packing.Encoder()
    odd = ["It's <|endoftext|> o'clock 'start x'sss!'s \x1c a\x85b 12²³¼ É́ é İI ſß ŉ ΣΑΣ x­-y", "x" * 5000 + " <|startoftext|>!", "日本語 한국어 ﬁ ½ a_b ~~ ¡hola! «x» ÀÉÎ 'RE don'T", "", None, " \t\n"]
    for text in odd * 2:
        want = [*e.tokenizer.encode(text or "", add_special_tokens=False).ids, packing.END]
        assert np.frombuffer(e.encode(text), "<u4").tolist() == want


def test_pieces_cover_documents_without_gaps(spark):
    rng = random.Random(2)
    texts = [None, "", *(" ".join(rng.choices(["alpha", "beta", "gamma,", "Ünö", "x1"], k=int(rng.paretovariate(0.5)) % 9000)) for _ in range(300)), "same text", "same text"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    rows = packing.packed(docs, with_ids=True).collect()
    by_doc, by_seq = defaultdict(list), defaultdict(list)
    for r in rows:
        by_doc[r.doc_id].append(r)
        by_seq[r.sequence_id].append(r)
        assert zlib.crc32(r.ids) == r.ids_crc32 and len(r.ids) == 4 * r.length and r.length > 0
    e = packing.Encoder()
    assert len(by_doc) == len(texts)
    for i, text in enumerate(texts):
        own = sorted(by_doc[i], key=lambda r: r.start)
        assert b"".join(bytes(r.ids) for r in own) == e.encode(text)
        assert [r.start for r in own] == [sum(x.length for x in own[:k]) for k in range(len(own))]
        assert {r.doc_tokens for r in own} == {len(e.encode(text)) // 4}
    padding = 0
    for own in by_seq.values():
        own.sort(key=lambda r: r.offset)
        assert [r.offset for r in own] == [sum(x.length for x in own[:k]) for k in range(len(own))]
        fill = sum(r.length for r in own)
        assert fill <= packing.CAPACITY
        padding += 0 if fill & (fill - 1) == 0 else packing.CAPACITY - fill
    assert padding == 0
    assert packing.packed(docs.limit(0)).count() == 0


def test_placement_minimises_squares():
    p = packing.Packer(0)
    rng = random.Random(3)
    for i in range(400):
        s = rng.randrange(1, 4096)
        counts = np.maximum(p.level, 0)
        best = {0: 2 * counts[s] + 1}
        for h in range(1, packing.CAPACITY - s + 1):
            if counts[h]:
                best[h] = 1 - 2 * counts[h] + (0 if h + s == packing.CAPACITY else 2 * counts[h + s] + 1)
        before = (counts**2).sum()
        p.place((i, 0, b"\0" * 4 * s, s), s)
        assert (np.maximum(p.level, 0) ** 2).sum() - before == min(best.values())


def test_few_open_sequences(monkeypatch):
    """With a small limit sequences close one at a time; nothing is lost or cut more than it must be."""
    monkeypatch.setattr(packing, "OPEN_MOST", 5)
    p, rng, total = packing.Packer(0), random.Random(4), 0
    for i in range(300):
        s = rng.randrange(1, 9000)
        total += s
        p.add(i, bytes(4 * s))
        assert p.n_open < 5 and p.n_open == sum(map(len, p.open.values())) == int(np.maximum(p.level[: packing.CAPACITY], 0).sum())
    p.finish()
    assert sum(r[2] for r in p.done) == total and p.n_open == 0


def test_rows_of_sf(spark):
    assert packing.query(spark, DATA).select("doc_id").distinct().count() == 200


def test_encoder_and_pieces_are_bounded(spark, monkeypatch):
    """Kept words stay few, words that come again mean the same, and closed sequences are handed on by their bytes."""
    from crumbline.llm import packing

    text = [" ".join(f"word{i + j}," for j in range(50)) for i in range(200)]
    want = [packing.Encoder().encode(t) for t in text]
    monkeypatch.setattr(packing, "WORDS_KEPT", 100)
    small = packing.Encoder()
    assert [small.encode(t) for t in text] == want and len(small.words) + len(small.older) <= 300
    p = packing.Packer(0)
    for i in range(400):
        p.add(i, b"\x05\x00\x00\x00" * 4096)
    assert p.held == 400 * 4096 * 4 > packing.BYTES_DONE
    packing._rows(p, True)
    assert p.held == 0 and p.done == []
