"""Loads that die half-way, loads that come again, and tables that must only grow."""

import os

import pytest

from crumbline.sources import loads as L

ITEM, ENTRY = L.Table(("item",), replaces=True), L.Table(("ref", "hash"))


def sent(spark, items, entries):
    return {"items": (spark.createDataFrame(items, "item string, name string"), ITEM), "entries": (spark.createDataFrame(entries, "ref string, hash string, quantity double"), ENTRY)}


def state(spark, folder):
    items, entries = L.read(spark, folder, "items", ITEM), L.read(spark, folder, "entries", ENTRY)
    return (None if items is None else {r["item"]: r.name for r in items.collect()}, None if entries is None else sorted((r.ref, r.hash, r.quantity) for r in entries.collect()))


FIRST = ([("a", "A"), ("b", None)], [("r1", "x", 1.0), ("r2", "y", 2.0), ("r2", "y", 2.0)])
SECOND = ([("a", "A new"), ("b", None), ("c", "C")], [("r2", "y", 9.0), ("r2", "z", 3.0)])


def test_loads_upsert_dimensions_and_take_facts_once(spark, tmp_path):
    f = str(tmp_path)
    assert state(spark, f) == (None, None)
    assert L.load(spark, f, "b1", "one.csv", sent(spark, *FIRST)) == [("items", 2, 2), ("entries", 3, 2)]
    assert L.load(spark, f, "b1", "one.csv", sent(spark, *FIRST)) == []
    assert L.load(spark, f, "b2", "two.csv", sent(spark, *SECOND)) == [("items", 3, 2), ("entries", 2, 1)]
    assert state(spark, f) == ({"a": "A new", "b": None, "c": "C"}, [("r1", "x", 1.0), ("r2", "y", 2.0), ("r2", "z", 3.0)])
    audit = {(r.batch, r.table): (r.seq, r.sent, r.taken) for r in L.batches(spark, f).collect()}
    assert audit == {("b1", "items"): (1, 2, 2), ("b1", "entries"): (1, 3, 2), ("b2", "items"): (2, 3, 2), ("b2", "entries"): (2, 2, 1)}
    assert L.load(spark, f, "b3", "one.csv", sent(spark, FIRST[0][1:], FIRST[1])) == [("items", 1, 0), ("entries", 3, 0)]


@pytest.mark.parametrize("dies_at", range(6))
def test_a_load_that_dies_is_invisible_and_can_be_repeated(spark, tmp_path, monkeypatch, dies_at):
    f, calls = str(tmp_path), []
    L.load(spark, f, "b1", "one.csv", sent(spark, *FIRST))
    before, whole = state(spark, f), {n: getattr(L, n) for n in ("moved", "deleted")}

    def counted(name):
        def run(*a):
            if len(calls) == dies_at:
                calls.append("died")
                raise OSError("killed")
            calls.append(name)
            return whole[name](*a)

        return run

    for n in whole:
        monkeypatch.setattr(L, n, counted(n))
    with pytest.raises(OSError, match="killed"):
        L.load(spark, f, "b2", "two.csv", sent(spark, *SECOND))
    for n, g in whole.items():
        monkeypatch.setattr(L, n, g)
    assert state(spark, f) == before
    L.load(spark, f, "b2", "two.csv", sent(spark, *SECOND))
    assert state(spark, f) == ({"a": "A new", "b": None, "c": "C"}, [("r1", "x", 1.0), ("r2", "y", 2.0), ("r2", "z", 3.0)])
    assert [r.batch for r in L.batches(spark, f).where("table = 'items'").orderBy("seq").collect()] == ["b1", "b2"]


def test_state_is_replaced_as_a_whole(spark, tmp_path):
    path = str(tmp_path / "state.json")
    for text in ('{"a": 1}', '{"a": "größer"}'):
        L.write_state(spark, text, path)
        assert open(path, encoding="utf-8").read() == text
    assert not os.path.exists(path + ".new")


def test_a_rewritten_row_is_refused(spark, tmp_path):
    table, record = str(tmp_path / "t"), str(tmp_path / "record")
    spark.createDataFrame([(1, "a"), (2, "b")], "id long, v string").coalesce(1).write.parquet(table)
    assert L.audited(spark, table, record) == 1
    spark.createDataFrame([(3, "c")], "id long, v string").coalesce(1).write.mode("append").parquet(table)
    assert L.audited(spark, table, record) == 2
    old = sorted(p for p in os.listdir(table) if p.endswith(".parquet"))
    spark.createDataFrame([(1, "A"), (2, "b")], "id long, v string").coalesce(1).write.parquet(str(tmp_path / "other"))
    changed = next(p for p in os.listdir(tmp_path / "other") if p.endswith(".parquet"))
    kept = open(f"{table}/{old[0]}", "rb").read()
    os.remove(f"{table}/.{old[0]}.crc")  # the local file system's own check would speak first
    os.replace(tmp_path / "other" / changed, f"{table}/{old[0]}")
    for _ in range(2):  # the record stays, so it is found again
        with pytest.raises(ValueError, match="rewritten"):
            L.audited(spark, table, record)
    open(f"{table}/{old[0]}", "wb").write(kept)
    assert L.audited(spark, table, record) == 2
    os.remove(f"{table}/{old[1]}")
    with pytest.raises(ValueError, match="removed"):
        L.audited(spark, table, record)
