"""Profiles of workbooks against plain loops."""

import random
import zipfile

import pytest

from crumbline import plans
from crumbline.operators import workbook as W
from crumbline.sources import sheets

from .twins import DATA

CELLS = "book string, sheet string, r int, c int, kind string, v string, f string"


def formulas(spark, *cells):
    """cells as (sheet, "B2", formula)."""
    return spark.createDataFrame([("b", s, int(a[1:]), ord(a[0]) - 64, "blank", None, f) for s, a, f in cells], CELLS)


def test_references_of_every_form(spark):
    f = "=B2+$C$3:D1*'May 8''s'!A1-Totals!B2:B4+AB12&\"A9\"\"B9\"+LOG10(E5)+A:C+other!2:3+my_A1+Q1.x"
    got = {tuple(x)[4:] for x in W.references(formulas(spark, ("s", "A1", f))).collect()}
    assert got == {
        ("s", 2, 2, 2, 2), ("s", 1, 3, 3, 4), ("May 8's", 1, 1, 1, 1), ("Totals", 2, 2, 4, 2), ("s", 12, 28, 12, 28), ("s", 5, 5, 5, 5),
        ("s", 1, 1, W.ROWS, 3), ("other", 2, 1, 3, W.COLUMNS),
    }


def test_letters_and_numbers(spark):
    def name(n):
        out = ""
        while n:
            n, rest = divmod(n - 1, 26)
            out = chr(65 + rest) + out
        return out

    n = spark.range(1, 16385)
    got = n.select("id", W.letters(n.id).alias("a"), W.number(W.letters(n.id)).alias("n")).collect()
    assert all(x.a == name(x.id) and x.n == x.id for x in got)


def loops(edges):
    """cell -> smallest cell of its circle, by walking from every cell."""
    to = {}
    for a, b in edges:
        to.setdefault(a, set()).add(b)

    def reach(a):
        seen, todo = set(), list(to.get(a, ()))
        while todo:
            x = todo.pop()
            if x not in seen:
                seen.add(x)
                todo += to.get(x, ())
        return seen

    far = {a: reach(a) for a in to}
    return {a: min(b for b in far[a] if a in far.get(b, ())) for a in to if a in far[a]}


@pytest.mark.parametrize("seed", range(4))
def test_circles_equal_loops(spark, seed):
    r = random.Random(seed)
    n = (12, 25, 40, 60)[seed]
    edges = [(r.randrange(n), r.randrange(n)) for _ in range((30, 28, 44, 70)[seed])]
    edges += [(1000 + i, 1001 + i) for i in range(40)] + [(2000 + i, 2000 + (i + 1) % 30) for i in range(30)] + [(2005, 2006), (3000, 3001), (3001, 3000), (3001, 2000), (4000, 4000)]
    got = {x.cell: x.circle for x in W.circles(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == loops(edges)


@pytest.mark.parametrize("seed", range(4))
def test_circles_of_sheets_equal_loops(spark, seed, monkeypatch):
    """Cells that read cells and ranges of their own and other sheets, in batches smaller than a sheet; some sheets go the way of joins for what their ranges span."""
    monkeypatch.setattr(W, "SPANNED", (10**6, 40, 10**6, 60)[seed])
    r = random.Random(seed)
    at = lambda: f"{r.choice('ABCD')}{r.randrange(1, 12)}"
    cells = []
    for book in ("b", "b2"):
        for s in range(30):
            for _ in range(r.randrange(1, 16)):
                f = f"={at()}" + r.choice(["", f"+{at()}", f"+SUM({at()}:{at()})"]) + ("" if seed < 2 or r.random() < 0.8 else f"+s{r.randrange(s % 7, 30)}!{at()}")
                cells.append((book, f"s{s}", r.randrange(1, 12), r.randrange(1, 5), "blank", None, f))
    cells += [("b", "ring", i, 1, "blank", None, f"=A{i % 300 + 1}") for i in range(1, 301)] + [("b", "one", 1, 1, "blank", None, "=A1"), ("b", "column", 5, 5, "blank", None, "=SUM(A:C)+1:4+E5:F9")]
    df = spark.createDataFrame(cells, CELLS)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        got = {tuple(x.cell): tuple(x.circle) for x in W.cell_circles(df).collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    want = loops([(tuple(x.a), tuple(x.b)) for x in W.dependencies(df).collect()])
    assert got == want and len({x[1] for x in want}) > 10


@pytest.mark.parametrize("seed", range(3))
def test_reads_are_counted_as_dependencies_are(spark, seed):
    """Ranges that overlap, whole columns and rows, other sheets with and without formulas, cells given twice with the same and with another formula."""
    r = random.Random(seed)
    at = lambda: f"{r.choice(('', '$'))}{r.choice('ABCDE')}{r.choice(('', '$'))}{r.randrange(1, 14)}"
    ref = lambda: r.choice(["", "", "", "s1!", "'s2'!", "s3!", "plain!", "nowhere!"]) + r.choice([at(), at(), f"{at()}:{at()}", "A:B", "C:XFD", "2:9"])
    cells = [
        (book, f"s{r.randrange(6)}", r.randrange(1, 14), r.randrange(1, 6), "blank", None, "=" + "+".join(["1", *(ref() for _ in range(r.randrange(4)))])) for book in ("b", "b2") for _ in range(150)
    ]
    cells += r.sample(cells, 20) + [("b", "plain", 1, 1, "number", "1", None)]
    df = spark.createDataFrame(cells, CELLS)
    edges = W.dependencies(df).collect()
    want = {}
    for e in edges:
        want[e.a.book, e.a.sheet] = want.get((e.a.book, e.a.sheet), 0) + 1
    assert len(edges) > 1000 and any(e.a.sheet != e.b.sheet for e in edges)
    long = "sheet in ('s1', 's4', 'plain')"
    for got in (W.reads(df, 3), W.reads(df.where(f"not {long}"), None, df.where(long))):
        assert {(x.book, x.sheet): x.reads for x in got.collect()} == want


def test_reads_of_all_rows_above_are_counted_without_edges(spark):
    n = 50_000
    cells = spark.range(1, n + 1).selectExpr("'b' as book", "'s' as sheet", "int(id) as r", "1 as c", "'blank' as kind", "cast(null as string) as v", "concat('=SUM(A$1:A', id, ')+A1') as f")
    assert [tuple(x) for x in W.reads(cells).collect()] == [("b", "s", n * (n + 1) // 2)]
    unnamed = spark.createDataFrame([("b", None, 1, 1, "blank", None, "=A1+A2"), ("b", None, 2, 1, "blank", None, "=s!A1+1")], CELLS)
    for got in (W.reads(unnamed.union(cells.where("r < 3"))), W.reads(cells.where("r < 3"), None, unnamed)):
        assert {tuple(x) for x in got.collect()} == {("b", None, 3), ("b", "s", 3)}


def test_profile_shuffles_cells_by_sheet_only(spark):
    """Lines are dealt by book and sheet, and Spark knows: what is shuffled for the sake of a group are totals, sums of reads and names of sheets that are read."""
    plan = plans.QUERIES["src21_workbook_profile"](spark, DATA)._jdf.queryExecution().executedPlan().toString()
    assert len([x for x in plan.splitlines() if "ENSURE_REQUIREMENTS" in x and "Totals" not in x]) <= 2 and "SortMergeJoin" not in plan


def test_sheets_that_stand_alone_need_no_rounds(spark, monkeypatch):
    monkeypatch.setattr(W, "circles", None)
    cells = formulas(spark, ("s", "A1", "=A2"), ("s", "A2", "=A1+B1"), ("s", "B1", "=1"), ("t", "A1", "=s!A1"), ("u", "C1", "=SUM(C1:C3)+t!A1"), ("u", "C2", "=C3"))
    assert {(x.cell.sheet, x.cell.r, x.cell.c, x.circle.r) for x in W.cell_circles(cells.where("sheet <> 'u' or c = 3 and r > 1")).collect()} == {("s", 1, 1, 1), ("s", 2, 1, 1)}


def test_nothing_to_read(spark):
    none = formulas(spark, ("s", "A1", "=1+2")).limit(0)
    for f in (W.census, W.extents, W.shapes, W.references, W.dependencies):
        assert f(none).count() == 0
    assert W.circles(W.dependencies(none)).count() == 0 and W.cell_circles(none).count() == 0


def test_ranges_find_formulas_over_sheets_and_blocks(spark):
    cells = formulas(
        spark, ("s", "A1", "=SUM(B1:C3000)"), ("s", "B2", "=1"), ("s", "C1500", "=t!A1"), ("s", "C3001", "=2"), ("t", "A1", "=s!A1"), ("t", "B1", "=SUM(A:A)+s!2:2+nowhere!A1"), ("s", "B2", "=1")
    )
    edges = {((a.sheet, a.r, a.c), (b.sheet, b.r, b.c)) for a, b in W.dependencies(cells).collect()}
    assert edges == {
        (("s", 1, 1), ("s", 2, 2)), (("s", 1, 1), ("s", 1500, 3)), (("s", 1500, 3), ("t", 1, 1)), (("t", 1, 1), ("s", 1, 1)), (("t", 1, 2), ("t", 1, 1)), (("t", 1, 2), ("s", 2, 2)),
    }
    assert {(x.cell.sheet, x.cell.r) for x in W.circles(W.dependencies(cells)).collect()} == {("s", 1), ("s", 1500), ("t", 1)}


def test_parts_of_a_file(spark, tmp_path):
    main = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
    rows = (
        '<row r="1"><c r="A1" t="s"><v>0</v></c><c r="B1" s="1"><v>45000</v></c><c r="C1" t="b"><v>1</v></c></row>'
        '<row r="2" hidden="1"><c r="A2"><v>4</v></c><c r="B2"><f t="shared" ref="B2:B3" si="0">A2*$A$2+May!A2&amp;"A2"</f><v>16</v></c></row>'
        '<row r="3"><c r="A3" t="inlineStr"><is><t>  </t></is></c><c r="B3"><f t="shared" si="0"/></c><c r="C3" s="2"/></row><row r="6"><c r="A6" t="e"><v>#REF!</v></c></row>'
    )
    with zipfile.ZipFile(tmp_path / "book.xlsx", "w") as z:
        z.writestr("xl/workbook.xml", f'<workbook {main}><sheets><sheet name="May"/><sheet name="Old" state="hidden"/></sheets></workbook>')
        z.writestr("xl/sharedStrings.xml", f"<sst {main}><si><t>It</t><t>ems</t></si></sst>")
        z.writestr("xl/styles.xml", f'<styleSheet {main}><numFmts><numFmt numFmtId="170" formatCode="yyyy-mm-dd"/></numFmts><cellXfs><xf numFmtId="0"/><xf numFmtId="170"/><xf numFmtId="2"/></cellXfs></styleSheet>')
        z.writestr("xl/worksheets/sheet1.xml", f'<worksheet {main}><cols><col min="4" max="5" hidden="1"/></cols><sheetData>{rows}</sheetData><mergeCells><mergeCell ref="A1:B1"/></mergeCells></worksheet>')
        z.writestr("xl/worksheets/sheet2.xml", f"<worksheet {main}><sheetData/></worksheet>")
    parts = sheets.read_parts(spark, str(tmp_path / "book.xlsx")).cache()
    other = {(x.sheet, x.part, x.ref, x.r, x.c, x.v) for x in parts.where("part <> 'cell'").collect()}
    assert other == {
        ("May", "sheet", None, None, None, "visible"), ("Old", "sheet", None, None, None, "hidden"), ("May", "merged", "A1:B1", None, None, None),
        ("May", "hidden column", None, None, 4, None), ("May", "hidden column", None, None, 5, None), ("May", "hidden row", None, 2, None, None),
    }
    cells = parts.where("part = 'cell'").withColumnRenamed("path", "book")
    assert {(x.ref, x.kind, x.v, x.f) for x in cells.collect()} == {
        ("A1", "text", "Items", None), ("B1", "date", "45000", None), ("C1", "bool", "1", None), ("A2", "number", "4", None), ("B2", "number", "16", '=A2*$A$2+May!A2&"A2"'),
        ("A3", "text", "  ", None), ("B3", "blank", None, '=A3*$A$2+May!A3&"A2"'), ("A6", "error", "#REF!", None),
    }
    assert [tuple(x)[2:] for x in W.extents(cells).collect()] == [(6, 3, 2, 2, 2)]
    assert [(x.n, x.example, x.sheets) for x in W.shapes(cells).collect()] == [(2, "B2", [])]
    assert {(x.c, x.kind, x.n) for x in W.census(cells).collect() if x.place == 1} == {(1, "text", 2), (2, "formula", 2), (3, "bool", 1)}
