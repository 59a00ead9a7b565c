"""Raw tables (arrays of rows of cells) to self-describing text rows, as Column expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from docweft.functions import text as T

# When a detected grid counts as data, and what stands in for missing labels.
ROW_LABEL = "Item"
MIN_ROWS, MIN_COLS, MIN_FILL = 2, 2, 0.4
TABULAR_DENSITY = 0.18


def clean(rows: Column) -> Column:
    """Cells squeezed, null cells empty, rows without any filled cell dropped."""
    cells = F.transform(rows, lambda r: F.transform(r, T.clean_cell))
    return F.filter(cells, lambda r: F.exists(r, lambda c: F.length(c) > 0))


def is_real_table(rows: Column) -> Column:
    filled = F.aggregate(rows, F.lit(0), lambda a, r: a + F.size(F.filter(r, lambda c: F.length(c) > 0)))
    total = F.aggregate(rows, F.lit(0), lambda a, r: a + F.size(r))
    width = F.aggregate(rows, F.lit(0), lambda a, r: F.greatest(a, F.size(r)))
    return (F.size(rows) >= MIN_ROWS) & (width >= MIN_COLS) & (filled / F.greatest(F.lit(1), total) >= F.lit(MIN_FILL))


def _roles(rows: Column) -> Column:
    """Per row: ``h`` header (blank stub, less than half of its values are data), ``d`` other row with values, ``-`` no values."""

    def role(r: Column) -> Column:
        later = F.filter(F.slice(r, 2, F.greatest(F.lit(1), F.size(r))), lambda c: F.length(c) > 0)
        data = F.size(F.filter(later, T.is_data_value))
        blank_stub = F.length(F.coalesce(F.get(r, F.lit(0)), F.lit(""))) == 0
        return F.when(F.size(later) == 0, F.lit("-")).when(blank_stub & (data * 2 < F.size(later)), F.lit("h")).otherwise(F.lit("d"))

    return F.array_join(F.transform(rows, role), "")


def header_span(rows: Column) -> Column:
    """``struct(start, stop)``, from 0, stop exclusive: the first header row up to the first other row with values after it.

    Rows without values do not end the stack.  Without a blank-stub header, the first row with three filled
    cells is the header; without that either, null.
    """
    roles = _roles(rows)
    first = F.instr(roles, F.lit("h"))
    after = F.instr(F.substring(roles, first, F.length(roles)), F.lit("d"))
    stop = F.when(after > 0, first + after - 2).otherwise(F.size(rows))
    wide = F.array_position(F.transform(rows, lambda r: F.size(F.filter(r, lambda c: F.length(c) > 0)) >= 3), F.lit(True)).cast("int")
    return (F.when(first > 0, F.struct((first - 1).cast("int").alias("start"), stop.cast("int").alias("stop")))
            .when(wide > 0, F.struct((wide - 1).alias("start"), wide.alias("stop"))))


def merge_headers(rows: Column, span: Column) -> Column:
    """One name per column: the filled header cells from top to bottom, joined by blanks."""
    stack = F.slice(rows, span["start"] + 1, span["stop"] - span["start"])
    width = F.aggregate(stack, F.lit(0), lambda a, r: F.greatest(a, F.size(r)))
    col = lambda i: F.array_join(F.filter(F.transform(stack, lambda r: F.trim(F.coalesce(F.get(r, i), F.lit("")))), lambda c: F.length(c) > 0), " ")
    return F.when(width > 0, F.transform(F.sequence(F.lit(0), width - 1), col)).otherwise(F.array().cast("array<string>"))


def _body(rows: Column, span: Column) -> Column:
    n = F.size(rows) - span["stop"]
    return clean(F.when(n > 0, F.slice(rows, span["stop"] + 1, F.greatest(n, F.lit(0)))).otherwise(F.array().cast("array<array<string>>")))


def _once(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is made once: named in a lambda it would be made again for each element."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def serialise(rows: Column) -> Column:
    """``row label | header: value | header: value`` per data row, joined by line breaks; empty without a header."""

    def line(r: Column, heads: Column) -> Column:
        label = F.coalesce(F.nullif(F.coalesce(F.get(r, F.lit(0)), F.lit("")), F.lit("")), F.lit(ROW_LABEL))
        pairs = F.filter(F.transform(heads, lambda h, i: F.when((i > 0) & (F.length(F.coalesce(F.get(r, i), F.lit(""))) > 0), F.concat(h, F.lit(": "), F.get(r, i)))), lambda x: x.isNotNull())
        return _once(pairs, lambda p: F.when(F.size(p) > 0, F.concat(label, F.lit(" | "), F.array_join(p, " | "))))

    def text(rows: Column, span: Column) -> Column:
        heads = F.transform(merge_headers(rows, span), lambda h, i: F.when(F.length(h) > 0, h).when(i == 0, F.lit(ROW_LABEL)).otherwise(F.concat(F.lit("col"), i.cast("string"))))
        lines = _once(heads, lambda h: F.filter(F.transform(_body(rows, span), lambda r: line(r, h)), lambda x: x.isNotNull()))
        return F.when(span.isNull(), F.lit("")).otherwise(F.array_join(lines, "\n"))

    return _once(rows, lambda t: _once(header_span(t), lambda s: text(t, s)))


def render_pipes(rows: Column) -> Column:
    """The table with pipes, for people to read."""
    span = header_span(rows)
    heads = F.transform(merge_headers(rows, span), lambda h, i: F.when(F.length(h) > 0, h).otherwise(F.concat(F.lit("col"), i.cast("string"))))
    bar = lambda cells: F.concat(F.lit("| "), F.array_join(cells, " | "), F.lit(" |"))
    rule = F.concat(F.lit("|"), F.array_join(F.transform(heads, lambda h: F.lit("---")), "|"), F.lit("|"))
    body = F.transform(_body(rows, span), lambda r: bar(F.transform(heads, lambda h, i: F.coalesce(F.get(r, i), F.lit("")))))
    return F.when(span.isNull(), F.lit("")).otherwise(F.array_join(F.concat(F.array(bar(heads), rule), body), "\n"))


def page_blocks(tables, prose, page: str = "page"):
    """A page's blocks in reading order: its tables from the top, then its prose."""
    cols = [page, "kind", "top", "text"]
    return tables.select(*cols).unionByName(prose.select(*cols)).orderBy(page, (F.col("kind") == "prose").cast("int"), "top")


def outside_boxes(chars, boxes, page: str = "page"):
    """Characters whose centre lies in no table box of their page: a range anti-join within a page."""
    b = boxes.select(F.col(page).alias("__p"), "x0", "x1", "top", "bottom")
    inside = (F.col(page) == F.col("__p")) & F.col("cx").between(F.col("x0"), F.col("x1")) & F.col("cy").between(F.col("top"), F.col("bottom"))
    return chars.join(b, inside, "left_anti")
