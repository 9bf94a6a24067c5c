"""The mutation log as a stream: kinds, restarts, ties, late and repeated files; sessions and joins of streams."""

import datetime as dt
import json
import os
import random

import pytest
from pyspark.sql import functions as F

from crumbline.streaming import replay as R

T0 = dt.datetime(2026, 1, 5, 8)
KINDS = {
    "entries": R.Kind("item long, quantity double", many=True),
    "confirm": R.Kind("date date, what string", ("date", "what")),
    "settings": R.Kind("name string, value string, theme string", ("name",), own=("theme",)),
}


def mutation(i, kind, payload, minute):
    return {"mutation_id": f"m{i:04d}", "kind": kind, "payload": payload if isinstance(payload, str) else json.dumps(payload), "received_at": (T0 + dt.timedelta(minutes=minute)).isoformat()}


def made_up(seed=1, n=120):
    r = random.Random(seed)
    out = []
    for i in range(n):
        minute = r.randrange(20)  # many ties
        out.append(r.choice([
            lambda: mutation(i, "entries", [{"item": r.randrange(5), "quantity": r.randrange(9)} for _ in range(r.randrange(3))], minute),
            lambda: mutation(i, "confirm", {"date": f"2026-01-0{r.randrange(1, 4)}", "what": r.choice(["production", "waste"])}, minute),
            lambda: mutation(i, "settings", {"name": r.choice("abc"), "value": str(i), "theme": "dark"}, minute),
            lambda: mutation(i, r.choice(["unknown", "settings", "entries"]), r.choice(["{broken", "[1", "null"]), minute),
            lambda: mutation(i, "settings", {"value": "no key"}, minute),
        ])())
    return out


def plain(log):
    """Replay in loops: (entries, confirm, settings, rejected ids)."""
    entries, confirm, settings, bad = [], {}, {}, set()
    for m in {m["mutation_id"]: m for m in log}.values():
        order = (m["received_at"], m["mutation_id"])
        try:
            p = json.loads(m["payload"])
        except json.JSONDecodeError:
            p = None
        if m["kind"] == "entries" and isinstance(p, list):
            entries += [(m["mutation_id"], e["item"], float(e["quantity"])) for e in p]
        elif m["kind"] == "confirm" and p:
            confirm[p["date"], p["what"]] = max(confirm.get((p["date"], p["what"]), order), order)
        elif m["kind"] == "settings" and p and "name" in p:
            settings[p["name"]] = max(settings.get(p["name"], (order, "")), (order, p["value"]))
        else:
            bad.add(m["mutation_id"])
    return sorted(entries), {k: v[1] for k, v in confirm.items()}, {k: v[1] for k, v in settings.items()}, bad


def files(folder, log, parts, seed=0):
    """The log dealt over files, out of order, a third of the mutations sent twice."""
    r = random.Random(seed)
    sent = log + r.sample(log, len(log) // 3)
    r.shuffle(sent)
    folder.mkdir(exist_ok=True)
    for i in range(parts):
        (folder / f"{seed}-{i}.json").write_text("\n".join(json.dumps(m) for m in sent[i::parts]), "utf-8")


def state(spark, folder):
    get = lambda k: R.table(spark, folder, k, KINDS.get(k)).collect()
    return (
        sorted((r.mutation_id, r["item"], r.quantity) for r in get("entries")), {(str(r.date), r.what): r.mutation_id for r in get("confirm")},
        {r.name: r.value for r in get("settings")}, {r.mutation_id for r in get("rejected")},
    )


def test_replay_equals_loops(spark, tmp_path):
    log = made_up()
    files(tmp_path / "in", log, 3)
    R.replay(R.read(spark, str(tmp_path / "in")), str(tmp_path / "out"), str(tmp_path / "cp"), KINDS).awaitTermination()
    assert state(spark, str(tmp_path / "out")) == plain(log)
    assert "theme" not in R.table(spark, str(tmp_path / "out"), "settings", KINDS["settings"]).columns
    R.compacted(spark, str(tmp_path / "out"), "settings", KINDS["settings"], str(tmp_path / "whole"))
    assert {r.name: r.value for r in spark.read.parquet(str(tmp_path / "whole")).collect()} == plain(log)[2]


@pytest.mark.parametrize("fails_on", ["confirm", "rejected"])
def test_a_killed_run_is_resumed_with_each_mutation_once(spark, tmp_path, fails_on, monkeypatch):
    """The second batch dies between two of its tables, or after all but the last; the run that follows does it again."""
    from pyspark.sql.readwriter import DataFrameWriter

    log, out = made_up(2), str(tmp_path / "out")
    files(tmp_path / "in", log[:90], 3, seed=5)
    whole, calls = DataFrameWriter.parquet, []

    def dies(self, path, *a, **k):
        calls.append(path)
        if f"/{fails_on}/batch=1" in path:
            raise OSError("killed")
        return whole(self, path, *a, **k)

    monkeypatch.setattr(DataFrameWriter, "parquet", dies)
    run = lambda: R.replay(R.read(spark, str(tmp_path / "in")), out, str(tmp_path / "cp"), KINDS).awaitTermination()
    with pytest.raises(Exception, match="killed"):
        run()
    assert any("batch=1" in c for c in calls)
    monkeypatch.setattr(DataFrameWriter, "parquet", whole)
    run()
    assert state(spark, out) == plain(log[:90])
    files(tmp_path / "in", log, 2, seed=6)  # more arrives, what is known with it
    run()
    assert state(spark, out) == plain(log)


def test_a_batch_reads_nothing_that_was_stored(spark, tmp_path):
    log = made_up(3, 60)
    files(tmp_path / "in", log, 4)
    q = R.replay(R.read(spark, str(tmp_path / "in")), str(tmp_path / "out"), str(tmp_path / "cp"), KINDS)
    q.awaitTermination()
    sent = [p["numInputRows"] for p in q.recentProgress if p["numInputRows"]]
    assert sum(sent) == len(log) + len(log) // 3 and max(sent) <= 21  # a fourth of what was sent each, however much is stored


def test_pages_end_among_ties(spark):
    rows = [(f"m{i:03d}", T0 + dt.timedelta(minutes=i // 25)) for i in range(60)]
    log = spark.createDataFrame(random.Random(1).sample(rows, 60), "mutation_id string, received_at timestamp")
    seen, cursor = [], None
    while got := R.page(log, cursor, 7).collect():
        seen += [r.mutation_id for r in got]
        cursor = (got[-1].received_at, got[-1].mutation_id)
    assert seen == [i for i, _ in rows]


def test_latest_values_are_state_of_the_stream(spark, tmp_path):
    r = random.Random(9)
    log = [mutation(i, "entries", {"item": r.randrange(4), "quantity": r.randrange(50)}, r.randrange(30)) for i in range(80)]
    files(tmp_path / "in", log, 5, seed=3)
    stream = R.read(spark, str(tmp_path / "in")).select("mutation_id", "received_at", F.from_json("payload", "item long, quantity double").alias("p")).select("mutation_id", "received_at", "p.*")
    for _ in range(2):  # the second run finds nothing new
        R.latest_values(stream, str(tmp_path / "out"), str(tmp_path / "cp"), ("item",), F.col("quantity")).awaitTermination()
    got = {x["item"]: x.value for x in R.last(spark.read.parquet(str(tmp_path / "out")).drop("batch"), ("item",)).collect()}
    want = {}
    for m in sorted(log, key=lambda m: (m["received_at"], m["mutation_id"])):
        p = json.loads(m["payload"])
        want[p["item"]] = float(p["quantity"])
    assert got == want


def streamed(spark, folder, rows):
    """Files of (user, at), one per list."""
    folder.mkdir()
    for i, part in enumerate(rows):
        (folder / f"{i}.json").write_text("\n".join(json.dumps({"user": u, "at": (T0 + dt.timedelta(minutes=m)).isoformat()}) for u, m in part), "utf-8")
        os.utime(folder / f"{i}.json", (1_700_000_000 + i, 1_700_000_000 + i))  # files come in this order
    return spark.readStream.schema("user string, at timestamp").option("maxFilesPerTrigger", 1).json(str(folder))


def drained(spark, df, tmp_path, name):
    df.writeStream.format("parquet").option("path", str(tmp_path / name)).option("checkpointLocation", str(tmp_path / f"{name}-cp")).trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(str(tmp_path / name))


def test_sessions_join_late_events_and_leave_out_later_ones(spark, tmp_path):
    # b's event at 12 comes two files late, within the delay, and joins two visits into one; a's at 1 comes after the watermark has passed it by (that of the batch before counts).
    stream = streamed(spark, tmp_path / "in", [[("a", 0), ("b", 5)], [("b", 19), ("a", 30)], [("b", 12)], [("a", 500)], [("c", 600)], [("a", 1), ("c", 900)]])
    got = drained(spark, R.sessions(stream, "at", "user", "10 minutes", "60 minutes"), tmp_path, "out").collect()
    minute = lambda t: int((t - T0).total_seconds() // 60)
    assert sorted((r.user, minute(r.start), minute(r.end), r.n) for r in got) == [("a", 0, 10, 1), ("a", 30, 40, 1), ("a", 500, 510, 1), ("b", 5, 29, 3), ("c", 600, 610, 1)]
    batch = spark.createDataFrame([(u, T0 + dt.timedelta(minutes=m)) for u, m in [("b", 5), ("b", 19), ("b", 12)]], "user string, at timestamp")
    assert R.sessions(batch, "at", "user", "10 minutes", "0 minutes").first().n == 3


def test_streams_join_within_an_interval(spark, tmp_path):
    a = streamed(spark, tmp_path / "a", [[("x", 0), ("y", 3)], [("x", 40)]])
    b = streamed(spark, tmp_path / "b", [[("y", 90)], [("x", 9), ("x", 11), ("y", 2)]])
    got = drained(spark, R.followed(a, b, "user", "at", "10 MINUTES", "2 hours"), tmp_path, "out").collect()
    assert [(r["first"].user, r["first"]["at"], r["then"]["at"]) for r in got] == [("x", T0, T0 + dt.timedelta(minutes=9))]
