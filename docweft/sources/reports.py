"""Reports for people: small aggregates rendered as Markdown on the driver."""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import DataFrame

#: A report is for reading; more rows than this are an error, not a cut.
MAX_ROWS = 10_000


def markdown_table(df: DataFrame, order: list[str] | None = None) -> str:
    """All rows of a small DataFrame as a Markdown table."""
    rows = (df.orderBy(*order) if order else df).take(MAX_ROWS + 1)
    if len(rows) > MAX_ROWS:
        raise ValueError(f"more than {MAX_ROWS} rows are no report")
    cell = lambda x: "" if x is None else str(x).replace("|", "/").replace("\n", " ")
    lines = ["| " + " | ".join(df.columns) + " |", "|" + "---|" * len(df.columns)]
    return "\n".join(lines + ["| " + " | ".join(map(cell, r)) + " |" for r in rows])


def write_report(path: str, title: str, sections: dict[str, DataFrame | str]) -> None:
    """A file with one section per table or text, replaced as a whole."""
    parts = [f"# {title}"]
    for name, body in sections.items():
        parts.append(f"## {name}\n\n" + (body if isinstance(body, str) else markdown_table(body)))
    tmp = Path(path + ".tmp")
    tmp.write_text("\n\n".join(parts) + "\n", encoding="utf-8")
    tmp.replace(path)
