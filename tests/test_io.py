import datetime as dt
import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from crumbline.functions import scalars as S
from crumbline.operators import etl as E
from crumbline.operators import health
from crumbline.operators.asof import in_force
from crumbline.operators.economics import with_economics
from crumbline.operators.checkloss import censored_quantile_fit, quantile_fit
from crumbline.operators.fitted import poisson_fit
from crumbline.operators.observations import derived
from crumbline.sources import files
from crumbline.streaming import mutations as M


def test_log_is_read_with_blanks_as_nulls(spark, tmp_path):
    (tmp_path / "log.csv").write_text("business_date,item_key,quantity_made,quantity_wasted\n2026-01-05,a,3,1\n2026-01-05,b,2,\n2026-01-05,c,,1\nbad,d,None,x\n")
    rows = {r["item"]: (r.made, r.wasted) for r in files.read_log(spark, str(tmp_path / "log.csv")).collect()}
    assert rows == {"a": (3.0, 1.0), "b": (2.0, None)}


def test_lines_state_and_appends(spark, tmp_path):
    (tmp_path / "order.txt").write_text("# all\na # first\n\n b\n")
    assert [r.line for r in files.read_lines(spark, str(tmp_path / "order.txt")).collect()] == ["a", "b"]
    assert files.read_state(spark, str(tmp_path / "none.json"), "a int").count() == 0
    (tmp_path / "state.json").write_text('{"a": 1}\n{broken\n')
    assert files.read_state(spark, str(tmp_path / "state.json"), "a int").count() == 1
    df = spark.createDataFrame([("1", "2")], "x string, y string")
    files.append_known(df, str(tmp_path / "csv"), ["x", "y", "z"])
    with pytest.raises(ValueError, match="unknown"):
        files.append_known(df, str(tmp_path / "csv"), ["x"])
    for _ in range(2):
        files.append_new(df, str(tmp_path / "new"), ["x"])
    assert spark.read.parquet(str(tmp_path / "new")).count() == 1


def test_days_are_replaced_whole(spark, tmp_path):
    path, kind = str(tmp_path / "days"), "d date, item string, made long"
    a, b = dt.date(2026, 1, 5), dt.date(2026, 1, 6)
    files.replace_days(spark.createDataFrame([(a, "x", 1), (a, "y", 1), (b, "x", 1)], kind), path)
    files.replace_days(spark.createDataFrame([(a, "x", 9)], kind), path)
    assert sorted((r.d, r["item"], r.made) for r in spark.read.parquet(path).collect()) == [(a, "x", 9), (b, "x", 1)]


def test_in_force(spark):
    facts = spark.createDataFrame([("a", dt.date(2026, 1, d), d) for d in (1, 5, 9)], "k string, d date, n int")
    changes = spark.createDataFrame([("a", dt.date(2026, 1, 5), 2.0), ("a", dt.date(2026, 1, 8), 3.0), ("b", dt.date(2026, 1, 1), 9.0)], "k string, since date, v double")
    assert {r.n: r.v for r in in_force(facts, changes, ["k"], "d", "since", ["v"]).collect()} == {1: None, 5: 2.0, 9: 3.0}


def test_stream_replays_change_nothing(spark, tmp_path):
    row = lambda i, q, at: {"mutation_id": i, "kind": "entry", "business_date": "2026-01-05", "item_id": 1, "entry_type": "made", "quantity": q, "received_at": at}
    (tmp_path / "in").mkdir()
    (tmp_path / "in/1.json").write_text(json.dumps(row("a", 1, "2026-01-05T10:00:00")) + "\n" + json.dumps(row("b", 5, "2026-01-05T12:00:00")))
    run = lambda: M.apply(M.read(spark, str(tmp_path / "in")), str(tmp_path / "store"), str(tmp_path / "cp")).awaitTermination()
    run()
    (tmp_path / "in/2.json").write_text(json.dumps(row("a", 1, "2026-01-05T10:00:00")) + "\n" + json.dumps(row("c", 7, "2026-01-05T11:00:00")))
    run()
    stored = spark.read.parquet(str(tmp_path / "store"))
    assert stored.count() == 3
    assert [r.quantity for r in M.latest(stored).collect()] == [5.0]


def test_parse_qty(spark):
    values = ["4 [out by 12pm]", "", None, "none", " -2.5 ", "7"]
    rows = spark.createDataFrame([(v,) for v in values], "v string").select(S.parse_qty(F.col("v")).alias("q")).collect()
    assert [(r.q.qty, r.q.note, r.q.problem) for r in rows] == [
        (4.0, "out by 12pm", "number with text"), (None, None, None), (None, None, None), (None, "none", "no number"), (-2.5, None, None), (7.0, None, None),
    ]


def least_check_loss(x, y, tau):
    """The line of least check loss. Some line of least loss goes through two points: from a point, take the best line through it and
    any other, and go on from that one."""
    i, least, best = int(abs(y - y.mean()).argmin()), np.inf, None
    while True:
        others = np.flatnonzero(x != x[i])
        slopes = (y[others] - y[i]) / (x[others] - x[i])
        r = y[None] - (y[i] - slopes * x[i])[:, None] - slopes[:, None] * x[None]
        loss = np.maximum(tau * r, (tau - 1) * r).sum(axis=1)
        j = int(loss.argmin())
        if loss[j] >= least - 1e-9:
            return best
        least, best, i = loss[j], np.array([y[i] - slopes[j] * x[i], slopes[j]]), others[j]


def test_fits_recover_planted_coefficients():
    rng = np.random.default_rng(0)
    x = rng.uniform(-1, 1, 1200)
    demand = 10 + 3 * x + rng.normal(0, 3, 1200)
    for tau in (0.5, 0.7, 0.9):
        assert quantile_fit(x[:, None], demand, tau) == pytest.approx(least_check_loss(x, demand, tau), abs=1e-6)
    many = np.random.default_rng(1)
    x_many = many.uniform(-1, 1, 20_000)  # a slope's standard error is 0.05 here; of the 1200 rows above it is 0.19
    assert quantile_fit(x_many[:, None], 10 + 3 * x_many + many.normal(0, 3, 20_000), 0.5) == pytest.approx([10, 3], abs=0.25)
    seen = np.minimum(demand, 12)
    naive, (better, _, _) = quantile_fit(x[:, None], seen, 0.7), censored_quantile_fit(x[:, None], seen, np.full(1200, 12.0), 0.7)
    assert better[0] >= naive[0] - 1e-6
    y = rng.poisson(np.exp(1 + 0.5 * x))
    beta, ok = poisson_fit(x[:, None], np.minimum(y, 4), y >= 4)
    assert ok
    assert beta == pytest.approx([1, 0.5], abs=0.1)


def test_workbook_cells(spark, tmp_path):
    import zipfile

    from crumbline.sources import sheets

    main = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
    with zipfile.ZipFile(tmp_path / "book.xlsx", "w") as z:
        z.writestr("xl/workbook.xml", f'<workbook {main}><sheets><sheet name="May 8"/><sheet name="Notes"/></sheets></workbook>')
        z.writestr("xl/sharedStrings.xml", f"<sst {main}><si><t>Items</t></si></sst>")
        z.writestr("xl/worksheets/sheet1.xml", f'<worksheet {main}><sheetData><row><c r="B5" t="s"><v>0</v></c><c r="AA6"><v>4</v></c></row></sheetData></worksheet>')
        z.writestr("xl/worksheets/sheet2.xml", f'<worksheet {main}><sheetData><row><c r="A1" t="inlineStr"><is><t>x</t></is></c></row></sheetData></worksheet>')
    cells = sheets.read_cells(spark, str(tmp_path / "book.xlsx"))
    assert sorted((r.sheet, r.r, r.c, r.v) for r in cells.collect()) == [("May 8", 5, 2, "Items"), ("May 8", 6, 27, "4"), ("Notes", 1, 1, "x")]
    assert {r.d for r in sheets.dated_sheets(cells, 2026).collect()} == {dt.date(2026, 5, 8)}


def test_jobs_record_failures(spark, tmp_path):
    from crumbline.operators import jobs

    ledger, ran = str(tmp_path / "ledger"), []

    def fails():
        raise RuntimeError("no file")

    done = jobs.chain(spark, ledger, [("ingest", fails), ("retrain", lambda: ran.append("retrain")), ("prep", lambda: spark.range(3))])
    assert done == {"ingest": False, "prep": True} and not ran
    rows = {r.job: (r.last_ok is not None, r.last_error) for r in jobs.status(spark.read.parquet(ledger)).collect()}
    assert rows == {"ingest": (False, "no file"), "prep": (True, None)}


def test_economics_from_files(spark, tmp_path):
    for name, text in {"p": "item_key,price\na,9.5\nb,\nc,4", "r": "item_key,ingredient,qty_per_unit\na,flour,2\na,salt,1\na,gold,1\nb,flour,1", "i": "ingredient,pack_cost,pack_qty\nflour,10,5\nsalt,1,10\nnone,1,0"}.items():
        (tmp_path / name).write_text(text)
    got = {r["item"]: (r.price, r.cost) for r in files.read_economics(spark, *(str(tmp_path / n) for n in "pri")).collect()}
    assert got == {"a": (9.5, pytest.approx(4.1)), "b": (None, 2.0), "c": (4.0, None)}


def test_audited_append(spark, tmp_path):
    df = spark.createDataFrame([(1, "x"), (2, "y"), (2, "y")], "id long, v string")
    args = (str(tmp_path / "t"), str(tmp_path / "audit"), ["id"])
    assert files.audited_append(df, *args, "b1") == 2
    assert files.audited_append(df, *args, "b1") == 0
    assert files.audited_append(df.union(spark.createDataFrame([(3, "z")], df.schema)), *args, "b2") == 1
    assert sorted((r.batch, r.sent, r.new) for r in spark.read.parquet(args[1]).collect()) == [("b1", 2, 0), ("b1", 2, 2), ("b2", 3, 1)]
    assert spark.read.parquet(args[0]).count() == 3


def test_markdown_round_trip(spark):
    df = spark.createDataFrame([("b", 2), ("a", None), ("c", 3)], "item string, quantity int")
    lines = files.as_markdown(df, ["item", "quantity"], ["item"])
    assert [r.line for r in lines.orderBy("line_no").collect()] == ["| item | quantity |", "|---|---|", "| a | - |", "| b | 2 |", "| c | 3 |"]
    assert [(r["item"], r.quantity) for r in files.from_markdown(lines, ["item", "quantity"]).orderBy("line_no").collect()] == [("a", "-"), ("b", "2"), ("c", "3")]


def test_predictions_and_scores(spark, tmp_path):
    p = spark.createDataFrame([("a", 3.0)], "item string, plan double").selectExpr("date'2026-01-05' as d", "item", "plan", "plan as point", "1d as lo", "4d as hi")
    files.write_once(p, str(tmp_path / "p"))
    assert [r.plan for r in files.read_predictions(spark, str(tmp_path / "p")).collect()] == [3.0]
    assert files.read_predictions(spark, str(tmp_path / "none")).count() == 0
    rows = p.selectExpr("'m' as policy", "d", "item", "plan as q", "2d as demand", "1d as waste_cost", "0d as stockout_cost", "false as unidentified")
    files.write_scored(rows, str(tmp_path / "s"))
    assert spark.read.option("header", True).csv(str(tmp_path / "s")).count() == 1


def test_health_and_notifiers(spark):
    at = dt.datetime(2026, 1, 10, 12)
    old = at - dt.timedelta(hours=31)
    rows = [("fine", at, None, at, None, 0, 0.0, True), ("never", None, at, at, None, 0, 0.0, True), ("late", old, None, at, None, 1, 11.0, True), ("none", at, None, None, at, 2, None, False)]
    df = spark.createDataFrame(rows, "name string, ingest_ok timestamp, ingest_error timestamp, retrain_ok timestamp, retrain_error timestamp, gap int, score_pct double, has_model boolean")
    df = df.selectExpr("*", "timestamp'2026-01-10 12:00:00' as at", "date'2026-01-10' as expected_day", "date_sub(date'2026-01-10', gap) as latest_day")
    got = health.assessed(df)
    assert {r.name: (r.worst, [f.code for f in r.findings]) for r in got.collect()} == {
        "fine": (0, []), "never": (3, ["ingest-never", "ingest-error"]), "late": (2, ["score-worse", "data-gap", "ingest-stale"]), "none": (2, ["data-gap", "no-model", "retrain-error"]),
    }
    texts = got.where("worst > 0").select(F.col("name").alias("code"), health.alert_text(F.col("name"), F.col("findings")).alias("text"))

    def send(text):
        if text.startswith("late"):
            raise OSError("no line")
        return "failed" in text

    assert {r.code: r.sent for r in health.notify(texts, send).collect()} == {"never": True, "late": False, "none": False}


def test_fits_decide_as_exact_ones_do(spark):
    """Weekly decisions of one item against fits from scratch on the same earlier rows."""
    from crumbline.operators import fitted

    rng = np.random.default_rng(3)
    days = [dt.date(2025, 1, 1) + dt.timedelta(n) for n in range(420)]
    demand = {i: rng.poisson([b + 2 * (x.isoweekday() == 6) for x in days]) for i, b in (("a", 4), ("b", 9))}
    rows = [(x, i, 6 if i == "a" else 12, int(max(0, (6 if i == "a" else 12) - q[n]))) for i, q in demand.items() for n, x in enumerate(days)]
    o = derived(spark.createDataFrame([(x, i, m, 0, w) for x, i, m, w in rows], "d date, item string, made long, refill long, wasted long"))
    o = with_economics(o, spark.createDataFrame([("a", 10.0, 3.0), ("b", 8.0, 2.0)], "item string, price double, cost double"))
    f = fitted.features(o).toPandas().sort_values(["item", "d"])
    got = {(r.d, r["item"]): r for r in fitted.fitted_decisions(o, fitted.item_poisson).collect()}
    for item in ("a", "b"):
        own = f[f["item"] == item].reset_index(drop=True)
        first = next(i for i, x in enumerate(own["d"]) if x.toordinal() // 7 == own["d"].iloc[300].toordinal() // 7)
        beta, ok = poisson_fit(own[fitted.COLUMNS].to_numpy(float)[:first], own["sold"].to_numpy(float)[:first], own["censored"].to_numpy(bool)[:first])
        rate = np.exp(np.r_[1, own[fitted.COLUMNS].iloc[300].to_numpy(float)] @ beta)
        row = got[own["d"].iloc[300], item]
        assert ok and row.modelled and row.q == fitted.poisson_quantile(rate, own["cr"].iloc[300])
        assert not got[own["d"].iloc[20], item].modelled
    made = [r for r in fitted.fitted_decisions(o, fitted.item_quantiles).collect() if r.modelled]
    assert len(made) > 100


def test_transcripts(spark, tmp_path):
    (tmp_path / "a.txt").write_text("# a sheet\nITEMS\nplain roll\nDAY old\nEND\nDAY 2026-01-05 7 2 5 31.5  # Monday\n4/2\n3/.\nDAY 2026-01-06 5 0 5 9\n5/. ./.\n", "utf-8")
    (tmp_path / "b.txt").write_text("ITEMS\nx\nEND\n1/1\nDAY 2026-01-07 9 1 9 1\n3/1 2/0\n", "utf-8")
    (tmp_path / "c.txt").write_text("")
    cells = E.transcript(files.read_transcripts(spark, str(tmp_path)))
    rows = {(r.d.day if r.d else None, r["item"]): (r.made, r.wasted, r.sold, r.censored) for r in E.transcript_rows(cells).collect()}
    assert rows == {(5, "plain roll"): (4, 2, 2, False), (5, "DAY old"): (3, 0, 3, True), (6, "plain roll"): (5, None, None, False), (7, "x"): (3, 1, 2, False), (None, "x"): (1, 1, 0, False)}
    said = sorted((r.d.day if r.d else 0, r.problem) for r in E.transcript_problems(cells).collect())
    assert said == [(0, "cells without a day"), (7, "made does not add up"), (7, "more cells than items"), (7, "sold is not made less waste")]
    assert {r.revenue for r in cells.collect() if r.d and r.d.day == 5} == {31.5}
