"""What workbooks hold: kinds of values, extents, shapes of formulas, which cells formulas read, and formulas that read themselves in a circle.

All take cells(book, sheet, r, c, kind, v, f): one row per filled cell, rows and columns from 1, kind as sources.sheets.read_parts has it, f the formula with its equals
sign or null. A cell given twice counts twice in a census and once in a circle; without cells every result is empty."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from crumbline.functions.scalars import formula_shape, sheet_references
from crumbline.operators.seed import ancestors
from crumbline.shared import removed, written

#: Rows of a block in which ranges look for cells, and the extent of a sheet (fixed by the file format).
BLOCK, ROWS, COLUMNS = 1024, 1_048_576, 16_384
#: Cells that the ranges of a sheet may span, all together, for the sheet's circles to be found in one task.
SPANNED = 100_000
NAME = r"(?:'(?:[^']|'')+'|[A-Za-z0-9_.]+)!"
#: B2, $B$2:C9, A:C, 2:9, each with or without a sheet; not LOG10( and not a part of a longer name.
RANGE = rf"(?<![A-Za-z0-9_.$!'])(?:{NAME})?(?:\$?[A-Z]{{1,3}}\$?\d+(?::\$?[A-Z]{{1,3}}\$?\d+)?|\$?[A-Z]{{1,3}}:\$?[A-Z]{{1,3}}|\$?\d+:\$?\d+)(?![A-Za-z0-9_.(!])"


def letters(c: Column) -> Column:
    """The letters of a column: 1 is A, 27 is AA."""
    c = c.cast("int")
    one, rest = (c - 1) % 26, F.floor((c - 1) / 26).cast("int")
    two, three = (rest - 1) % 26, F.floor((rest - 1) / 26).cast("int")
    sign = lambda x: F.char(65 + x)
    return F.concat(F.when(three > 0, sign((three - 1) % 26)).otherwise(""), F.when(rest > 0, sign(two)).otherwise(""), sign(one))


def number(name: Column) -> Column:
    """The column that letters stand for; 0 for none."""
    return F.aggregate(F.filter(F.split(name, ""), lambda x: x != ""), F.lit(0), lambda n, x: n * 26 + F.ascii(x) - 64)


def census(cells: DataFrame) -> DataFrame:
    """(book, sheet, c, kind, n, place): how many cells of a column are of each kind, the most frequent first."""
    kind = F.when(F.col("f").isNotNull(), "formula").otherwise(F.col("kind"))
    g = cells.groupBy("book", "sheet", "c", kind.alias("kind")).agg(F.count("*").alias("n"))
    return g.withColumn("place", F.row_number().over(Window.partitionBy("book", "sheet", "c").orderBy(F.col("n").desc(), "kind")))


def extents(cells: DataFrame) -> DataFrame:
    """(book, sheet, last_row, last_col, blank_rows, width, ragged) of each sheet: rows up to the last filled one that hold nothing, the last used column that most rows
    have (ties: the smaller), and how many rows have another. Text of white space only fills nothing."""
    full = cells.where("f is not null or trim(v) <> ''")
    rows = full.groupBy("book", "sheet", "r").agg(F.max("c").alias("width"))
    widths = rows.groupBy("book", "sheet", "width").agg(F.count("*").alias("n"), F.max("r").alias("r"))
    most = F.max(F.struct("n", (-F.col("width")).alias("w")))
    g = widths.groupBy("book", "sheet").agg(F.max("r").alias("last_row"), F.max("width").alias("last_col"), F.sum("n").alias("used"), most.alias("m"))
    return g.select("book", "sheet", "last_row", "last_col", (F.col("last_row") - F.col("used")).alias("blank_rows"), (-F.col("m.w")).alias("width"), (F.col("used") - F.col("m.n")).alias("ragged"))


def shapes(cells: DataFrame) -> DataFrame:
    """(book, sheet, shape, n, example, sheets): formulas that are alike but for references and numbers, the first cell of each by row and column, and the other sheets
    that it names."""
    g = cells.where("f is not null").groupBy("book", "sheet", formula_shape(F.col("f")).alias("shape")).agg(F.count("*").alias("n"), F.min(F.struct("r", "c", "f")).alias("x"))
    return g.select("book", "sheet", "shape", "n", F.concat(letters(F.col("x.c")), F.col("x.r").cast("string")).alias("example"), sheet_references(F.col("x.f")).alias("sheets"))


def _references(cells: DataFrame, itself: bool) -> DataFrame:
    """references() with place: false, or true for a row that stands for the formula's own cell if itself is asked for, so that both come from one pass."""
    bare = F.when(F.contains("f", F.lit('"')), F.regexp_replace("f", r'"(?:[^"]|"")*"', '""')).otherwise(F.col("f"))
    found = F.array_distinct(F.regexp_extract_all(bare, F.lit(RANGE), F.lit(0)))
    x = cells.where("f is not null").select("book", "sheet", "r", "c", F.explode(F.concat(F.array(F.lit("")), found) if itself else found).alias("x"))
    x = x.withColumn("named", F.when(F.contains("x", F.lit("!")), F.regexp_extract("x", f"^{NAME}", 0)).otherwise(""))
    name = F.replace(F.regexp_replace("named", "^'|'?!$", ""), F.lit("''"), F.lit("'"))
    ends = F.split(F.replace(F.substr("x", F.length("named") + 1), F.lit("$")), ":")
    place = F.col("x") == ""
    x = x.select("book", "sheet", "r", "c", F.when(F.col("named") == "", F.col("sheet")).otherwise(name).alias("to_sheet"), F.when(~place, ends).alias("e"), place.alias("place"))
    a, b = F.col("e")[0], F.element_at("e", -1)
    # An end is up to three letters and a row number, or one of them.
    abc = lambda e: F.rtrim(e, F.lit("0123456789"))
    row = lambda e: F.nullif(F.substr(e, F.length(abc(e)) + 1), F.lit("")).try_cast("int")
    sign = lambda e, n: F.ascii(F.substr(abc(e), F.lit(n), F.lit(1))) - 64
    column = lambda e: F.when(F.length(abc(e)) == 1, sign(e, 1)).when(F.length(abc(e)) == 2, 26 * sign(e, 1) + sign(e, 2)).when(F.length(abc(e)) == 3, 676 * sign(e, 1) + 26 * sign(e, 2) + sign(e, 3))
    low, high = lambda p, q: F.coalesce(F.least(p, q), F.lit(1)), lambda p, q, end: F.coalesce(F.greatest(p, q), F.lit(end))
    x = x.select("book", "sheet", "r", "c", "to_sheet", "place", row(a).alias("ra"), row(b).alias("rb"), column(a).alias("ca"), column(b).alias("cb"))
    return x.select("book", "sheet", "r", "c", "to_sheet", low("ra", "rb").alias("r1"), low("ca", "cb").alias("c1"), high("ra", "rb", ROWS).alias("r2"), high("ca", "cb", COLUMNS).alias("c2"), "place")


def references(cells: DataFrame) -> DataFrame:
    """(book, sheet, r, c, to_sheet, r1, c1, r2, c2): the ranges that formulas read, a row each, corners in order. Quoted texts hold no ranges; whole columns and rows reach
    to the end of the sheet; names and other workbooks aren't followed."""
    return _references(cells, False).drop("place")


def reads(cells: DataFrame, n: int | None = None, long: DataFrame | None = None) -> DataFrame:
    """(book, sheet, reads): how many dependencies() begin in a sheet, counted without being made; sheets without any are left out, and one without a name is one, too. What a range reads
    is the number of formulas in a column down to its last row less those above its first one, so running counts by column answer all ranges, and a running sum over all rows above
    stays linear. What a formula reads of one column is cut into runs that don't meet, so that nothing counts twice. Only ranges on other sheets travel if cells lie by book and sheet in n
    partitions (as many as the session has, if not given); if they don't, all do, once. A sheet's formulas and what reads it meet in one task. long: the cells of further sheets, few
    and long ones that lie anywhere; their formulas travel only if something reads the sheet."""
    n = n or int(cells.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ends, at = ["r1", "c1", "r2", "c2"], [F.col("r").alias("at_r"), F.col("c").alias("at_c")]
    named = lambda df: df.where(F.contains("f", F.lit("!")))
    other = references(named(cells)).where("not (sheet <=> to_sheet)")
    if long is not None:
        other = other.union(references(long))
    other = other.select("book", F.col("to_sheet").alias("sheet"), F.struct("sheet").alias("reader"), *at, F.lit(False).alias("place"), *ends)
    if long is not None:
        same = lambda a, b: a["book"].eqNullSafe(b["book"]) & a["sheet"].eqNullSafe(b["sheet"])
        sheets = F.broadcast(long.select("book", "sheet").distinct())
        read = F.broadcast(other.join(sheets, same(other, sheets), "left_semi").select("book", "sheet").distinct())
        filled = long.where("f is not null and r is not null and c is not null")
        filled = filled.join(read, same(filled, read), "left_semi")
        other = other.union(filled.select("book", "sheet", F.lit(None).cast("struct<sheet:string>"), *at, F.lit(True), "r", "c", "r", "c"))
    own = _references(cells, True).where("sheet <=> to_sheet and not (place and (r is null or c is null))")
    own = own.select("book", "sheet", F.lit(None).cast("struct<sheet:string>").alias("reader"), *at, "place", *[F.when(F.col("place"), F.col(e[0])).otherwise(F.col(e)).alias(e) for e in ends])
    x = own.union(other.repartition(n, "book", "sheet"))
    used = lambda f: f(F.when(F.col("place"), F.col("c1"))).over(Window.partitionBy("book", "sheet"))
    x = x.withColumns({"first_c": used(F.min), "last_c": used(F.max)}).withColumns({"c1": F.greatest("c1", "first_c"), "c2": F.least("c2", "last_c")}).where("first_c is not null and c1 <= c2")
    x = x.withColumn("c", F.explode(F.sequence("c1", "c2")))
    earlier = Window.partitionBy("book", "sheet", "c", "place", "reader", "at_r", "at_c").orderBy("r1").rowsBetween(Window.unboundedPreceding, -1)
    x = x.withColumn("r1", F.greatest("r1", F.max("r2").over(earlier) + 1)).where("r1 <= r2")
    one = lambda r, place, sign: F.struct(r.alias("r"), F.lit(place).alias("place"), F.lit(sign).alias("sign"))
    ends = F.when(F.col("place"), F.array(one(F.col("r1"), 1, 0))).otherwise(F.array(one(F.col("r1") - 1, 0, -1), one(F.col("r2"), 0, 1)))
    x = x.select("book", "sheet", "reader", "c", F.explode(ends).alias("x")).select("book", "sheet", "reader", "c", "x.*")
    x = x.withColumn("above", F.sum("place").over(Window.partitionBy("book", "sheet", "c").orderBy("r"))).where("sign <> 0")
    return x.groupBy("book", F.when(F.col("reader").isNull(), F.col("sheet")).otherwise(F.col("reader.sheet")).alias("sheet")).agg(F.sum(F.col("sign") * F.col("above")).alias("reads")).where("reads > 0")


def dependencies(cells: DataFrame) -> DataFrame:
    """(a, b), each once: the formula in cell a reads the formula in cell b; cells are (book, sheet, r, c). Ranges are clipped to where the sheet has formulas, then look for
    cells by column and block of rows, so a range joins the cells near it only. Cells that very many formulas read make long keys on the ranges' side, which
    adaptive execution splits; a block holds 1,024 cells at most. A running sum over all rows above has a square of edges, as its formulas say."""
    at = cells.where("f is not null").select("book", "sheet", "r", "c").distinct()
    used = at.groupBy("book", F.col("sheet").alias("to_sheet")).agg(*[f(x).alias(n + x) for x in ("r", "c") for n, f in (("first_", F.min), ("last_", F.max))])
    x = references(cells).join(used, ["book", "to_sheet"])
    x = x.withColumns({"r1": F.greatest("r1", "first_r"), "r2": F.least("r2", "last_r"), "c1": F.greatest("c1", "first_c"), "c2": F.least("c2", "last_c")}).where("r1 <= r2 and c1 <= c2")
    block = lambda r: F.floor(F.col(r) / BLOCK)
    x = x.withColumn("to_c", F.explode(F.sequence("c1", "c2"))).withColumn("block", F.explode(F.sequence(block("r1"), block("r2"))))
    to = at.select("book", F.col("sheet").alias("to_sheet"), F.col("r").alias("to_r"), F.col("c").alias("to_c"), block("r").alias("block"))
    hit = x.join(to, ["book", "to_sheet", "to_c", "block"]).where("to_r between r1 and r2")
    cell = lambda sheet, r, c: F.struct("book", F.col(sheet).alias("sheet"), F.col(r).alias("r"), F.col(c).alias("c"))
    return hit.select(cell("sheet", "r", "c").alias("a"), cell("to_sheet", "to_r", "to_c").alias("b")).distinct()


def circles(edges: DataFrame) -> DataFrame:
    """(cell, circle): every cell that reads itself, directly or over others, by edges(a, b); cells that read each other share a circle, named by the smallest of them.

    Rounds of joins: cells that read nothing of the rest or that nothing of it reads go; of cells that read one cell only some (no two neighbours, by a hash) are left out,
    and who read them reads on. A chain of n cells so ends in about log n rounds. What can't be made smaller, cells that read two or more
    of each other throughout, is solved by its closure, quadratic in such a knot. Then cells left out come back, last ones first: one belongs to the circle of what
    it read if somebody of that circle read it. Graphs without chains take as many rounds as half their longest path."""
    e = written(edges.select("a", "b").where("a is not null and b is not null").distinct(), "reads")
    own, steps, turn, size = [], [], 0, e.count()
    while size:
        own.append(written(e.where("a = b").select(F.col("a").alias("cell")), "own"))
        rest = e.where("a <> b")
        rest = written(rest.join(rest.select(F.col("b").alias("a")).distinct(), "a", "left_semi").join(rest.select(F.col("a").alias("b")).distinct(), "b", "left_semi"), "trimmed")
        single = rest.groupBy("a").agg(F.count("*").alias("n"), F.min("b").alias("b")).where("n = 1")
        head = single.where(F.xxhash64("a", F.lit(turn)) % 2 == 0).select(F.col("a").alias("v"), F.col("b").alias("u"))
        gone = head.join(head.select(F.col("v").alias("u")), "u", "left_anti")
        step = written(rest.join(gone, F.col("b") == F.col("v")).select("v", "u", F.col("a").alias("w")), "left_out")
        left = step.select("v").distinct()
        stay = rest.join(left.select(F.col("v").alias("a")), "a", "left_anti").join(left.select(F.col("v").alias("b")), "b", "left_anti")
        new = written(stay.select("a", "b").union(step.select(F.col("w").alias("a"), F.col("u").alias("b"))).distinct(), "reads")
        before, size = size, new.count()
        over = size == before and single.isEmpty()
        steps.append(step)
        removed(e)
        removed(rest)
        e, turn = new, turn + 1
        if over:
            break
    up = ancestors(e.select(F.col("a").alias("child_key"), F.col("b").alias("parent_key")))
    both = up.join(up.select(F.col("child_key").alias("ancestor_key"), F.col("ancestor_key").alias("child_key")), ["child_key", "ancestor_key"])
    found = both.groupBy(F.col("child_key").alias("cell")).agg(F.least("child_key", F.min("ancestor_key")).alias("circle"))
    if own:  # cells that read themselves, in the edges of some round
        alone = reduce(DataFrame.union, own).distinct()
        found = found.union(alone.join(found, "cell", "left_anti").select("cell", F.col("cell").alias("circle")))
    found = written(found, "circles")
    removed(up)
    for step in reversed(steps):
        u, w = found.select(F.col("cell").alias("u"), F.col("circle").alias("at_u")), found.select(F.col("cell").alias("w"), F.col("circle").alias("at_w"))
        back = step.join(u, "u").join(w, "w", "left").where("w = u or at_w = at_u").select(F.col("v").alias("cell"), F.col("at_u").alias("circle")).distinct()
        new = written(found.join(back.select("cell"), "cell", "left_anti").union(back), "circles")
        removed(found)
        found = new
    for table in (e, *own, *steps):
        removed(table)
    return found.join(found.groupBy("circle").agg(F.min("cell").alias("first")), "circle").select("cell", F.col("first").alias("circle"))


def _strong(a: np.ndarray, b: np.ndarray) -> dict[int, int]:
    """Of edges from a to b every node of a circle, with a node that stands for the circle (Tarjan's algorithm, without recursion)."""
    for _ in range(8):  # what nothing reads or what reads nothing goes, a layer a round
        keep = np.isin(a, b) & np.isin(b, a)
        if keep.all():
            break
        a, b = a[keep], b[keep]
    out: dict[int, list[int]] = {}
    for x, y in zip(a.tolist(), b.tolist()):
        out.setdefault(x, []).append(y)
    index, low, path, found = {}, {}, [], {}
    done = set()
    for root in out:
        work = [] if root in index else [(root, iter(out[root]))]
        if work:
            index[root] = low[root] = len(index)
            path.append(root)
        while work:
            x, more = work[-1]
            for y in more:
                if y not in index:
                    index[y] = low[y] = len(index)
                    path.append(y)
                    work.append((y, iter(out.get(y, ()))))
                    break
                if y not in done:
                    low[x] = min(low[x], index[y])
            else:
                work.pop()
                if work:
                    low[work[-1][0]] = min(low[work[-1][0]], low[x])
                if low[x] == index[x]:
                    members = [path.pop()]
                    while members[-1] != x:
                        members.append(path.pop())
                    done.update(members)
                    if len(members) > 1 or x in out.get(x, ()):
                        found.update(dict.fromkeys(members, x))
    return found


def _within(t: pa.Table) -> pa.RecordBatch:
    """The cells in circles of whole sheets, from what their formulas read in their own sheet."""
    new = _new(t)
    sheet, first = np.cumsum(new) - 1, np.flatnonzero(new)
    r, c, r1, c1, r2, c2 = (t[n].to_numpy().astype(np.int64) for n in ("r", "c", "r1", "c1", "r2", "c2"))
    key = lambda s, c, r: (s << 46) | (c << 31) | r
    cells, at = np.unique(key(sheet, c, r), return_index=True)
    # A range meets the formulas of one column in a run of cells; columns without formulas on either side are cut off.
    c1, c2 = np.maximum(c1, np.minimum.reduceat(c, first)[sheet]), np.minimum(c2, np.maximum.reduceat(c, first)[sheet])
    each = lambda n: (np.repeat(np.arange(len(n)), n), np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n))
    of, nth = each(np.maximum(c2 - c1 + 1, 0))
    low = np.searchsorted(cells, key(sheet[of], c1[of] + nth, r1[of]))
    high = np.searchsorted(cells, key(sheet[of], c1[of] + nth, r2[of]), side="right")
    run, nth = each(high - low)
    found = _strong(np.searchsorted(cells, key(sheet, c, r)[of[run]]), low[run] + nth)
    own = np.array(sorted(found), dtype=np.int64)
    circle = np.array([found[x] for x in own.tolist()], dtype=np.int64)
    place = (r[at[own]] << 15) | c[at[own]]
    least = np.full(len(cells), np.iinfo(np.int64).max)
    np.minimum.at(least, circle, place)
    rows = t.select(["book", "sheet"]).take(pa.array(at[own])).combine_chunks()
    columns = [rows[n].combine_chunks() if rows.num_rows else pa.array([], pa.string()) for n in ("book", "sheet")]
    return pa.RecordBatch.from_arrays([*columns, *(pa.array(v) for v in (r[at[own]], c[at[own]], least[circle] >> 15, least[circle] & 32767))], names=["book", "sheet", "r", "c", "first_r", "first_c"])


def _new(t: pa.Table) -> np.ndarray:
    """Which rows begin a sheet."""
    differs = [pc.not_equal(t[n].slice(1), t[n].slice(0, t.num_rows - 1)) for n in ("book", "sheet")]
    return np.r_[True, pc.or_(*differs).to_numpy()].astype(bool)


def _by_sheets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """_within() of rows sorted by book and sheet, as soon as sheets are whole."""
    held = None
    for batch in batches:
        for start in range(0, batch.num_rows, 1 << 16):
            part = pa.Table.from_batches([batch.slice(start, 1 << 16)])
            held = part if held is None else pa.concat_tables([held, part])
            last = int(np.flatnonzero(_new(held))[-1])
            if last:
                yield _within(held.slice(0, last))
                held = held.slice(last)
    if held is not None and held.num_rows:
        yield _within(held)


def cell_circles(cells: DataFrame) -> DataFrame:
    """circles(dependencies(cells)), with most of the work where the cells are. A circle lies in one sheet, or all its sheets read another one and are read by another one. Sheets of
    which that can't be said have only circles of their own: what their formulas read in their own sheet meets in one task (sorted by sheet, a batch at a time). Other sheets,
    and those whose ranges span more than SPANNED cells, go the way of circles(). A reference is written once and shuffled once."""
    kinds = {f.name: f.dataType for f in cells.schema}
    refs = written(references(cells.where("book is not null and r is not null and c is not null")), "references")
    other, same = refs.where("sheet <> to_sheet"), refs.where("sheet = to_sheet")
    reads = other.select("book", F.col("sheet").alias("to_sheet")).distinct()
    linked = other.select("book", "to_sheet").join(reads, ["book", "to_sheet"]).distinct().withColumnRenamed("to_sheet", "sheet")
    spans = (F.col("r2") - F.col("r1") + 1).cast("long") * (F.col("c2") - F.col("c1") + 1)
    wide = same.groupBy("book", "sheet").agg(F.sum(spans).alias("n")).where(F.col("n") > SPANNED).select("book", "sheet")
    rest = written(linked.union(wide).distinct(), "linked")
    # A partition takes about a million references, so that sorting them needs no disk.
    n = max(int(cells.sparkSession.conf.get("spark.sql.shuffle.partitions")), same.count() >> 20)
    own = same.select("book", "sheet", "r", "c", "r1", "c1", "r2", "c2").join(rest, ["book", "sheet"], "left_anti").repartition(n, "book", "sheet").sortWithinPartitions("book", "sheet")
    found = own.mapInArrow(_by_sheets, "book string, sheet string, r long, c long, first_r long, first_c long")
    cell = lambda r, c: F.struct("book", "sheet", F.col(r).cast(kinds["r"]).alias("r"), F.col(c).cast(kinds["c"]).alias("c"))
    found = found.select(cell("r", "c").alias("cell"), cell("first_r", "first_c").alias("circle"))
    return found if rest.isEmpty() else found.union(circles(dependencies(cells.join(rest, ["book", "sheet"], "left_semi"))))
