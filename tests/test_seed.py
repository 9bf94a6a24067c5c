"""Seed tables against what the sheets say, and lineage against loops."""

import datetime as dt
import hashlib
import random

import pytest

from crumbline.operators import seed as S

DAY = dt.date(2026, 5, 8)


def test_item_tables(spark):
    rows = [
        ("Tuna  Roll", "tuna rl|Tuna Roll ", 8.0, DAY, None, None), ("Tuna Roll", None, 9.0, DAY + dt.timedelta(9), None, None), ("Tuna Roll", None, None, DAY + dt.timedelta(9), "", None),
        ("Spicy Tuna", "sp. tuna|", None, DAY, " TUNA roll", DAY + dt.timedelta(2)), ("Eel", "", 7.0, DAY, None, None),
    ]
    got = {k: sorted(map(tuple, v.collect()), key=str) for k, v in S.items(spark.createDataFrame(rows, "name string, variants string, price double, since date, parent string, parent_since date")).items()}
    assert [r[0] for r in got["items"]] == ["eel", "spicy tuna", "tuna roll"]
    assert got["aliases"] == [("Tuna Roll", "tuna roll"), ("sp. tuna", "spicy tuna"), ("tuna rl", "tuna roll")]
    assert sorted(got["attributes"], key=lambda r: r[:2]) == [("eel", DAY, 7.0, None), ("spicy tuna", DAY, None, None), ("tuna roll", DAY, 8.0, DAY + dt.timedelta(8)), ("tuna roll", DAY + dt.timedelta(9), 9.0, None)]
    assert got["lineage"] == [("tuna roll", "spicy tuna", DAY + dt.timedelta(2))]


def test_entries_leave_blanks_out(spark):
    sheet = spark.createDataFrame([("s!r1", DAY, " sp. tuna ", 3.0, None, 0.0, None), ("s!r2", DAY, "Eel  Roll", None, None, None, 2.0), ("s!r3", DAY, "x", None, None, None, None)], "ref string, d date, raw_name string, made double, refill double, waste double, sold double")
    got = {r.source_ref: r for r in S.entries(sheet, spark.createDataFrame([("sp. tuna", "spicy tuna")], "raw_name string, item_key string")).collect()}
    assert {k: (r.item_key, r.quantity) for k, r in got.items()} == {"s!r1:made": ("spicy tuna", 3.0), "s!r1:waste": ("spicy tuna", 0.0), "s!r2:afternoon_count": ("eel roll", 2.0)}
    assert got["s!r1:made"].value_hash == hashlib.sha256(b"2026-05-08|spicy tuna|made|3.0").hexdigest()[:16]


@pytest.mark.parametrize("seed", range(3))
def test_ancestors_equal_loops(spark, seed):
    r = random.Random(seed)
    edges = [(f"i{r.randrange(30)}", f"i{r.randrange(30)}") for _ in range(30)] + [(f"c{i}", f"c{i + 1}") for i in range(20)] + [("l1", "l2"), ("l2", "l1"), ("s", "s")]
    parents = {}
    for p, c in edges:
        parents.setdefault(c, set()).add(p)
    want = {}
    for item in parents:
        seen, level, steps = {}, {item}, 0
        while level:
            steps += 1
            level = {p for x in level for p in parents.get(x, ()) if p not in seen and p != item}
            seen |= dict.fromkeys(level, steps)
        want |= {(item, p): n for p, n in seen.items()}
    df = spark.createDataFrame(edges, "parent_key string, child_key string")
    got = {(x.child_key, x.ancestor_key): x.steps for x in S.ancestors(df).collect()}
    assert got == want
    top = {x.item_key: x.root_key for x in S.roots(df).collect()}
    assert top["c20"] == "c0" and "l1" not in top
    assert S.ancestors(df.limit(0)).count() == 0
