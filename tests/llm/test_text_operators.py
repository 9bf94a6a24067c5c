import datetime as dt
import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from crumbline.llm import chat, langid, pii, substrings, urlfilter
from tests.twins import DATA, assert_twin, connection

# ---------------------------------------------------------------- language --


@pytest.fixture(scope="module")
def model_and_docs(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    return langid.learned(docs.where(langid.may_learn())), docs


def test_language_of_held_out_documents(spark, model_and_docs):
    model, docs = model_and_docs
    rows = langid.identified(docs.where(~langid.may_learn()), model).select("doc.lang", "language.*").collect()
    assert len(rows) > 40
    assert sum(r["lang"] == r.lang_pred for r in rows) / len(rows) >= 0.97
    assert all(0 <= r.score <= 1 for r in rows)
    assert sum(r.accepted for r in rows) / len(rows) >= 0.97


def test_language_query(spark):
    rows = langid.query(spark, DATA).collect()
    assert len(rows) == 200
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in rows)


def test_language_edges(spark, model_and_docs):
    model, _ = model_and_docs
    texts = [None, "", "12 34 !!", "²", "the", "the " * 60_000, "xqzj kvvw zzxq qqkj xxzv wqkz jjqx vvkz" * 40, "日本語"]
    df = spark.createDataFrame([(i, t, "en", "x") for i, t in enumerate(texts)] + [(None, "the of and", None, None)], "doc_id long, text string, language string, score string")
    rows = langid.identified(df, model).collect()
    assert [r.doc.language for r in rows if r.doc.doc_id is not None] == ["en"] * len(texts)  # columns stay, whatever their names
    got = {r.doc.doc_id: r.language for r in rows}
    assert [got[i].lang_pred for i in range(4)] == ["und"] * 4 and not got[0].accepted
    assert got[4].lang_pred == "en" and got[5].lang_pred == "en"
    assert not got[6].accepted
    assert got[7].lang_pred in model.languages
    assert langid.identified(df.limit(0), model).count() == 0
    assert {r.language.lang_pred for r in langid.identified(df, None).collect()} == {"und"}
    assert langid.learned(df.where("false").withColumn("lang", F.lit("x"))) is None


@pytest.mark.parametrize("left_out", ["de", "en", "es", "fr"])
def test_language_left_out_is_rejected(spark, left_out):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    model = langid.learned(docs.where(langid.may_learn() & (F.col("lang") != left_out)))
    rows = langid.identified(docs.where(~langid.may_learn()), model).select("doc.lang", "language.accepted").collect()
    foreign, own = [r.accepted for r in rows if r["lang"] == left_out], [r.accepted for r in rows if r["lang"] != left_out]
    assert len(foreign) > 20 and sum(foreign) / len(foreign) <= 0.06
    assert sum(own) / len(own) >= 0.97


@pytest.mark.parametrize("length", [400, 2000, 10_000])
def test_odd_texts_are_rejected(spark, length):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    model = langid.learned(docs.where(langid.may_learn()))
    rng = random.Random(length)
    letters = " ".join("".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=rng.randrange(2, 9))) for _ in range(length // 6))
    code = "\n".join(f"for (int {rng.choice('ijkxyz')}{k} = 0; ptr->buf[{k}] != NULL; ++idx) {{ printf(fmt, argv[{k}]); }}" for k in range(length // 80))
    polish = "wszyscy ludzie rodzą się wolni i równi pod względem swej godności i swych praw są oni obdarzeni rozumem i sumieniem " * (length // 115)
    rows = langid.identified(spark.createDataFrame([(i, t) for i, t in enumerate([letters, code, polish])], "doc_id long, text string"), model).collect()
    assert [r.language.accepted for r in rows] == [False] * 3


@pytest.mark.parametrize("n", [1, 5, 20, 49])
def test_languages_of_few_texts_are_calibrated_on_texts_left_out(spark, n, monkeypatch):
    docs = spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text", "lang")
    rng = random.Random(n)
    words_ = ["".join(rng.choices(["ka", "lo", "mi", "tun", "ye", "ruk", "zha"], k=rng.randrange(1, 4))) for _ in range(300)]
    text = lambda: " ".join(rng.choices(words_, k=120))
    few = spark.createDataFrame([(10_000 + i, text(), "xx") for i in range(n)], docs.schema)
    told, whole = [], langid.calibrate
    monkeypatch.setattr(langid, "calibrate", lambda model, texts: told.extend(texts) or whole(model, texts))
    model = langid.learned(docs.union(few))
    own = np.array([-s[model.languages.index("xx")] / s[-1] for lang, s in told if lang == "xx"])
    assert len(own) == (n if n > 1 else 0)  # each text once, by the model of the other half
    if n > 1:
        fitted_on = langid.entropies(few, model).collect()
        seen = np.array([-r.sums[model.languages.index("xx")] / r.sums[-1] for r in fitted_on])
        assert np.median(own) > np.median(seen)
    rows = langid.identified(spark.createDataFrame([(20_000 + i, text(), None) for i in range(40)], docs.schema), model).select("language.*").collect()
    assert np.isfinite(model.most).all()
    if n >= 5:
        assert sum(r.lang_pred == "xx" for r in rows) == 40 and sum(r.accepted for r in rows) >= 36


def test_limit_leaves_the_stated_share():
    rng = langid.np.random.default_rng(1)
    over = [(rng.standard_t(3, 5000) > langid.limit(rng.standard_t(3, n), 0.01)).mean() for n in (150, 400, 2000) for _ in range(40)]
    assert 0.002 < langid.np.mean(over) < 0.015
    assert langid.limit(langid.np.zeros(5)) > 0


def brute_kneser_ney(words, order, context, char):
    """Interpolated Kneser-Ney by its definition, on strings: raw counts at the top, numbers of different left neighbours below."""
    padded = Counter()
    for w, c in words.items():
        padded["\1" * (langid.ORDER - 1) + w + "\2"] += c

    def counts(n):
        out = Counter()
        for w, c in padded.items():
            for i in range(langid.ORDER - 1, len(w)):
                out[w[i - n + 1 : i + 1]] += c
        if n == langid.ORDER:
            return out
        return Counter(g[1:] for g in counts(n + 1))

    def chance(n, ctx, ch):
        if n == 0:
            return langid.UNSEEN
        c = counts(n)
        n1, n2 = (sum(v == k for v in c.values()) for k in (1, 2))
        d = min(0.95, max(0.05, n1 / max(1, n1 + 2 * n2)))
        here = ctx[len(ctx) - n + 1 :] if n > 1 else ""
        total = sum(v for g, v in c.items() if g[:-1] == here)
        lower = chance(n - 1, ctx, ch)
        if not total:
            return lower
        rest = 1 - sum(max(v - d, 0) for g, v in c.items() if g[:-1] == here) / total
        return max(c[here + ch] - d, 0) / total + rest * lower

    return chance(order, context, char)


def test_kneser_ney_equals_brute_force():
    rng = random.Random(4)
    corpora = {lang: Counter("".join(rng.choices(a, k=rng.randrange(1, 6))) for _ in range(60)) for lang, a in (("x", "abc"), ("y", "bcd"))}
    model = langid.fit({lang: (list(w), langid.np.array(list(w.values()), float)) for lang, w in corpora.items()})
    for word in ("abc", "bcdb", "zz", "c"):
        chars, _ = langid.coded([word])
        text = "".join(map(chr, chars))
        for at in range(langid.ORDER - 1, len(chars)):
            got = model.log_chance(chars, langid.np.array([at]))[0]
            for j, lang in enumerate(model.languages):
                want = brute_kneser_ney(corpora[lang], langid.ORDER, text[at - langid.ORDER + 1 : at], text[at])
                assert got[j] == pytest.approx(langid.np.log(want), abs=1e-9)


def test_kneser_ney_sums_to_one():
    model = langid.fit({"a": (["abab", "abba", "b"], langid.np.array([3.0, 1.0, 2.0])), "b": (["zz"], langid.np.array([1.0]))})
    chars, _ = langid.coded(["ab"])
    for at in (3, 4, 5):
        total = 0.0
        for c in (ord("a"), ord("b"), langid.STOP):
            changed = chars.copy()
            changed[at] = c
            total += langid.np.exp(model.log_chance(changed, langid.np.array([at]))[0, 0])
        assert 0.99 < total < 1  # some is left for characters that no text had


# --------------------------------------------------------------------- PII --


def brute_spans(t):
    out = [(m.start(), 0, m.end()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)]
    out += [(m.start(), 1, m.end()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t) if all(int(x) <= 255 for x in m[0].split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t):
        d = [int(c) for c in reversed(re.sub("[^0-9]", "", m[0]))]
        if 12 <= len(d) <= 19 and sum(x if i % 2 == 0 else 2 * x - 9 * (2 * x > 9) for i, x in enumerate(d)) % 10 == 0:
            out.append((m.start(), 2, m.end()))
    out += [(m.start(), 3, m.end()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t) if 9 <= len(re.sub("[^0-9]", "", m[0])) <= 15]
    return sorted(out)


def pii_texts():
    rng = random.Random(11)
    parts = ["a@b.com", "a@b.com_x@d.org", "@d.org", "a.b%c+d@x-y.co.uk..", "1.2.3.4.5.6.7.8", "300.1.1.1", "001.002.003.255", "4111 1111 1111 1111", "4111-1111-1111-1112", "4111111111111111", "+49 (30) 1234-567", "+1", "+1 555 123 4567 ", "ü", "😀", ".", " ", "-", "x@y", "12345678901234567890", "call (555) 123-4567", "jo [at] mail [dot] org"]
    return [None, "", *("".join(rng.choice(parts) + rng.choice(["", " ", ",", "é"]) for _ in range(rng.randrange(1, 12))) for _ in range(400)), "a" * 60_000, "1" * 60_000, "a@" + "b." * 9_000 + "c", "9 " * 30_000, " ".join(["x@y.zz"] * 1500)]


def test_base_spans_equal_brute_force(spark):
    texts = pii_texts()
    rows = pii.with_spans(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)).select("doc.doc_id", "base", "spans").collect()
    for r in rows:
        base = [(s.start, s.kind_no, s.end) for s in r.base]
        assert base == brute_spans(texts[r.doc_id] or "")
        spans = [(s.start, s.kind_no, s.end) for s in r.spans]
        assert spans == sorted(spans) and set(base) <= set(spans)
        added = sorted(set(spans) - set(base))
        assert all(e <= b or s >= c for s, _, e in added for b, _, c in base)
        assert all(a[2] <= b[0] for a, b in zip(added, added[1:]))


def test_added_spans(spark):
    good = ["call me at (555) 123-4567 now", "write jane [at] mail [dot] org", "card 4111.1111.1111.1111", "server 10[.]0[.]0[.]1"]
    bad = ["order 555-123-4567", "we were at home. Then we left", "rows 10 200 300 of them"]
    rows = pii.with_spans(spark.createDataFrame(list(enumerate(good + bad)), "doc_id long, text string")).select("doc.doc_id", F.size("spans").alias("n")).collect()
    assert {r.doc_id: r.n for r in rows} == {i: int(i < len(good)) for i in range(len(good + bad))}


def test_redaction(spark):
    df = spark.createDataFrame([(1, "mail a@b.com or +49 30 1234567!", 9, "p"), (2, None, None, None), (3, "clean", 5, "")], "doc_id long, text string, n_chars long, spans string")
    out = pii.redacted(df)
    assert out.schema == df.schema
    assert {r.doc_id: (r.text, r.n_chars, r.spans) for r in out.collect()} == {1: ("mail [EMAIL] or [PHONE]!", 24, "p"), 2: (None, None, None), 3: ("clean", 5, "")}
    assert pii.redacted(df.limit(0)).count() == 0


def test_pii_query(spark):
    texts = dict(connection().execute("select doc_id, text from documents").fetchall())
    for r in pii.query(spark, DATA).collect():
        b = brute_spans(texts[r.doc_id] or "")
        assert r.base_sha256 == hashlib.sha256(",".join(f"{pii.KINDS[k]}:{s}:{e}" for s, k, e in b).encode()).hexdigest()
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(k == i for _, k, _ in b) for i in range(4)]


def test_model_file_is_what_training_gives(spark):
    from crumbline.llm import pii_train

    made = pii_train.train(spark, "/root/testdata/sf0.01/documents.parquet")  # no candidate there or in sf0.1 is wrong
    assert made["thresholds"] == pii.model()["thresholds"]
    assert min(made["held_out"]["recall"].values()) >= 0.85


#: Written for this test alone; what stands between double angle brackets is to be found.
UNSEEN = [
    "For the minutes please ask <<ruth.adler at stadtarchiv dot ch>>.", "Bids go to <<tenders at harbour.org>> by noon.", "the maintainer (<<p_novak [at] opensuse [dot] org>>) agreed", "Contact <<studio at lumen.co>> for prints.",
    "write <<me at somewhere dot net>> if lost", "Call <<604-555-0177>> for the keys.", "His mobile is <<0171 555 0199 22>> these days", "dial <<(212) 555-0143>> and wait", "phone: <<01.55.50.01.23>>",
    "debit card <<6011.0009.9013.9424>> stolen", "visa <<4000_0000_0000_0002>> was charged", "server <<172[.]16[.]254[.]1>> answered", "host <<2001:0db8:85a3:0000:0000:8a2e:0370:7334>> is up",
    "He was at ease. Then the bell rang.", "they sat at dinner.Nobody spoke", "look at fig. 3 and at tab. 4", "On 2019-11-05 2019 ended early for us", "from 1914 1918 to 1939 1945", "pages 12 14 16 18 and 20", "lots 10/20/30/40 sold", "code 2222.3333.4444.5555",
    "the 24 12 2020 edition", "we won 25 23 25 20", "at 7.30 we eat", "she works at night.So does he", "ticket 112-224-336", "isbn 0 19 852663 6", "at the dot on the map", "erstwh. At ththbleth. Thlyerlyaten", "onwhin. At erouingre. Tion",
]


def test_added_spans_of_sentences_never_trained_on(spark):
    from crumbline.llm.pii_train import WRITTEN, labelled

    assert not set(UNSEEN) & set(WRITTEN)
    told = dict(enumerate(labelled(u) for u in UNSEEN))
    rows = pii.with_spans(spark.createDataFrame([(i, t) for i, (t, _) in told.items()], "doc_id long, text string")).select("doc.doc_id", "spans").collect()
    added = [(r.doc_id, s.start, s.end) for r in rows for s in r.spans]
    right = [(i, a, b) for i, a, b in added if any(a < e and s < b for s, e in told[i][1])]
    assert len(right) >= 0.95 * len(added) and len({i for i, _, _ in right}) >= 10


def test_no_span_is_added_to_prose(spark):
    """The documents of sf0.1 hold personal data in base forms only."""
    r = pii.with_spans(spark.read.parquet("/root/testdata/sf0.1/documents.parquet")).agg(F.sum(F.size("base")).alias("b"), F.sum(F.size("spans")).alias("s")).first()
    assert r.b == r.s > 600


def test_very_many_matches_in_one_text(spark):
    n = 20_000
    parts = [f"10.0.{i % 250}.7 and call 555-{i % 900 + 100}-{i % 9000 + 1000}" for i in range(n)]
    run_on = " ".join(parts)  # a number and the 10 after it have twelve digits: the base pattern takes those that pass the check sum for cards
    base = pii.with_spans(spark.createDataFrame([(1, run_on)], "doc_id long, text string")).select("base").first().base
    assert [(s.start, s.kind_no, s.end) for s in base] == brute_spans(run_on) and len(base) > n
    text = ", ".join(parts)
    df = spark.createDataFrame([(1, text)], "doc_id long, text string")
    began = dt.datetime.now()
    r = pii.with_spans(df).select("base", "spans").first()
    assert len(r.base) == n and len(r.spans) == 2 * n
    assert [text[s.start : s.end] for s in r.base[:: n // 4]] == [f"10.0.{i % 250}.7" for i in range(0, n, n // 4)]
    assert pii.redacted(df).first().text == ", ".join(["[IP] and call [PHONE]"] * n)
    assert (dt.datetime.now() - began).seconds < 60


# --------------------------------------------------------------------- URLs --

DAY = dt.datetime(2024, 1, 1)
ENTRIES = "list string, key string, allows boolean, adds boolean, at timestamp"


def at(n):
    return DAY + dt.timedelta(n)


def test_url_query_equals_sql(spark):
    assert_twin(spark, urlfilter.query, urlfilter.ORACLE)


def test_entries_count_while_active(spark):
    entries = [("a", "bad.com", False, True, at(10)), ("a", "Bad.com", False, False, at(20)), ("a", "bad.com", False, True, at(30)), ("a", "bad.com", False, True, at(31)), ("w", "ok.bad.com", True, True, at(0)), ("p", "x.org/private", False, True, at(0)), ("n", None, False, True, at(0))]
    urls = [("http://www.BAD.com:80/a?b", n) for n in (9, 10, 19, 20, 29, 30, 99)] + [("https://u:p@ok.bad.com./", 12), ("http://x.org/private/1", 5), ("http://x.org/privately", 5), (None, 5), ("no url", 5), ("http://notbad.com", 15)]
    df = spark.createDataFrame([(i, u, at(n), "v") for i, (u, n) in enumerate(urls)] + [(99, "http://bad.com", None, "v"), (0, urls[0][0], at(10), "v")], "page_id long, url string, fetched_at timestamp, verdict string")
    e = spark.createDataFrame(entries, ENTRIES)
    rows = urlfilter.judged(df, e).select("doc.page_id", "verdict.*").collect()
    assert len(rows) == len(urls) + 2
    got = {r.page_id: r for r in rows if r.page_id != 0}
    assert [got[i].blocked for i in range(1, 13)] == [True, True, False, False, True, True, False, True, False, False, False, False]
    assert (got[7].active, got[7].by, got[7].host) == (2, "ok.bad.com", "ok.bad.com")
    assert not got[99].blocked and sorted(r.blocked for r in rows if r.page_id == 0) == [False, True]
    assert urlfilter.passed(df, e).columns == df.columns
    assert urlfilter.judged(df.limit(0), e.limit(0)).count() == 0
    assert urlfilter.judged(df, e.limit(0)).where("verdict.blocked").count() == 0


# --------------------------------------------------------------- substrings --


def removed(texts):
    w = [[x for x in re.split(r"[\x20\x09-\x0D]+", t or "") if x] for t in texts]
    n = Counter(tuple(x[i : i + 35]) for x in w for i in range(len(x) - 34))
    out = []
    for x in w:
        gone = set()
        for i in range(len(x) - 34):
            if n[tuple(x[i : i + 35])] > 1:
                gone.update(range(i, i + 35))
        out.append((len(x), len(gone), hashlib.sha256(" ".join(y for i, y in enumerate(x) if i not in gone).encode()).hexdigest()))
    return out


def passages(seed):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(400)]
    shared = [rng.choices(words, k=k) for k in (34, 35, 36, 50, 120, 400)]
    texts = [None, "", "short text"]
    for _ in range(120):
        t = []
        for _ in range(rng.randrange(1, 5)):
            s = rng.choice(shared)
            cut = rng.randrange(0, len(s) // 2)
            t += rng.choices(words, k=rng.randrange(0, 40)) + s[cut : cut + rng.randrange(20, 200)]
        texts.append(" ".join(t))
    near = rng.choices(words, k=200)
    for _ in range(30):
        v = list(near)
        v[rng.randrange(200)] = "changed"
        texts.append("\n".join(v))
    return [*texts, texts[5], texts[5], "a b c " * 60, "a b c " * 60, "x " * 90, " ".join(["glued"] * 50), "one two " * 20_000]


@pytest.mark.parametrize("seed", [1, 2])
def test_substrings_equal_brute_force(spark, seed):
    texts = passages(seed)
    df = spark.createDataFrame([(i, t, "k") for i, t in enumerate(texts)], "doc_id long, text string, edges string").repartition(5)
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in substrings.without_repeats(df).collect()}
    assert got == dict(enumerate(removed(texts)))


def test_substrings_edges(spark):
    kind = "doc_id long, text string"
    long = " ".join(f"t{i}" for i in range(60))
    rows = [(1, long), (1, long), (None, long), (2, None), (3, "a " + long)]
    got = substrings.without_repeats(spark.createDataFrame(rows, kind), with_text=True).collect()
    assert sorted((str(r.doc_id), r.n_removed, r.kept_text) for r in got) == [("1", 60, ""), ("1", 60, ""), ("2", 0, ""), ("3", 60, "a"), ("None", 60, "")]
    assert substrings.without_repeats(spark.createDataFrame([], kind)).count() == 0


def test_paths_are_compacted_and_spans_hashed(spark):
    """A text of 300 words, whole in two others and its middle in a third, is a path before the middle, in it, and after it."""
    w = [f"c{i}" for i in range(300)]
    texts = ["a " * 50 + " ".join(w) + " b", " ".join(w) + " c d", "e f " + " ".join(w[100:200]) + " g"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_key long, text string")
    rows = substrings.compacted(substrings.graph_edges(docs.withColumn("doc_key", F.xxhash64("text")))).collect()
    path = {r.edge: r.path for r in rows}
    edge = substrings.edges(substrings.Hashed([x.encode() for x in w]))[0].view(np.int64).tolist()
    own = [path[e] for e in edge if e in path]
    assert len(own) == len(edge) and 3 <= len(set(own)) <= 5
    assert all(a == b or b == e for a, b, e in zip(own, own[1:], edge[1:]))  # a path changes only where one begins
    got = {r.doc_id: r.n_removed for r in substrings.without_repeats(docs.withColumnRenamed("doc_key", "doc_id")).collect()}
    assert got == {0: removed(texts)[0][1], 1: 300, 2: 100}


def test_clashing_source_coordinates_split_paths_only(spark, monkeypatch):
    monkeypatch.setattr(substrings, "PLACE_BITS", 2)
    texts = passages(5)
    got = substrings.without_repeats(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    assert {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in got} == dict(enumerate(removed(texts)))


def test_every_window_holds_an_edge():
    rng = random.Random(3)
    for k in (1, 2, 3, 1000):
        w = [str(rng.randrange(k)).encode() for _ in range(500)]
        x = substrings.Hashed(w)
        _, begin, end = substrings.edges(x)
        assert all(((begin >= s) & (end <= s + 35)).any() for s in range(len(w) - 34))
        own = substrings.edges(substrings.Hashed(w[100:135]))[0]
        assert set(own.tolist()) <= set(substrings.edges(x)[0].tolist())


# --------------------------------------------------------------------- chat --


def test_chat_query_equals_sql(spark):
    assert_twin(spark, chat.query, chat.ORACLE)


def test_reply_trees(spark):
    #        1 -> 2 -> 4        scores: the branch over 3 is best
    #          -> 3 -> 5, 6
    rows = [(1, 1, None, 0.0, "user", "q"), (1, 2, 1, 1.0, "assistant", "a"), (1, 3, 1, 3.0, "assistant", "b"), (1, 4, 2, 1.0, "user", "c"), (1, 5, 3, 0.0, "user", "d"), (1, 6, 3, None, "user", None), (2, 1, 9, 1.0, None, "alone"), (3, 1, 2, 0.0, "user", "x"), (3, 2, 1, 0.0, "user", "y"), (3, 3, 2, 0.0, "user", "hangs on a cycle")]
    rows += [(4, i, i - 1 if i else None, 0.0, "user", str(i)) for i in range(150)]
    df = spark.createDataFrame(rows, "tree long, node long, parent long, score double, role string, text string")
    got = {(r.tree, r["rank"]): [t.text for t in r.turns] for r in chat.conversations(df).collect()}
    assert got == {(1, 1): ["q", "b", "d"], (1, 2): ["q", "b", ""], (1, 3): ["q", "a", "c"], (2, 1): ["alone"], (4, 1): [str(i) for i in range(150)]}
    assert chat.conversations(df, most=1).count() == 3
    assert chat.conversations(df.limit(0)).count() == 0


def test_chat_round_trip(spark):
    odd = ["", None, "<|im_end|>", "\\", "\\\\", "a\\<|b", "<\\|", "<", "\\n", "line\nbreak", "<|im_start|>assistant\nhi<|im_end|>\n", "😀 <|", "\\|", "x" * 100_000]
    rows = [(1, i, ["user", "assistant", "sys\ntem", "\\v", None][i % 5], t) for i, t in enumerate(odd * 3)]
    rows += [(None, 1, "user", "null id"), (2, None, "user", "first"), (2, 0, "assistant", "second"), (2, 0, "assistant", "second")]
    made = chat.conversations(chat.linear(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")))
    got = {r.conv_id: r for r in chat.digests(made).collect()}
    want = [(r or "", t or "") for _, _, r, t in rows[: len(odd) * 3]]
    assert got[1].n_turns == len(want)
    assert got[1].turns_sha256 == hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in want).encode()).hexdigest()
    loss = "".join(t for r, t in want if r == "assistant")
    assert (got[1].loss_chars, got[1].loss_sha256) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())
    assert got[2].n_turns == 3 and got[None].n_turns == 1
    formatted = made.where("tree = 1").first().formatted
    assert formatted.count(chat.OPEN) == len(want) == formatted.count(chat.CLOSE)
