"""Reports of small summaries as Markdown and JSON."""

from __future__ import annotations

import json
import os

from pyspark.sql import DataFrame

MOST_ROWS = 1000


def percent(x: float | None) -> str:
    return "n/a" if x is None else f"{x:.1%}"


def number(x: float | None, digits: int = 2) -> str:
    return "n/a" if x is None else f"{x:.{digits}f}"


def rows_of(summary: DataFrame) -> list[dict]:
    """The rows of a summary, which must be small."""
    rows = [r.asDict(recursive=True) for r in summary.limit(MOST_ROWS + 1).collect()]
    if len(rows) > MOST_ROWS:
        raise ValueError("a report takes a summary, not a table")
    return rows


def markdown(title: str, rows: list[dict], shares: tuple[str, ...] = ()) -> str:
    if not rows:
        return f"## {title}\n\nNo rows.\n"
    names = list(rows[0])
    show = lambda k, v: percent(v) if k in shares else "n/a" if v is None else str(v)
    lines = [f"| {' | '.join(names)} |", f"|{'|'.join('-' for _ in names)}|", *[f"| {' | '.join(show(k, r[k]) for k in names)} |" for r in rows]]
    return f"## {title}\n\n" + "\n".join(lines) + "\n"


def write(folder: str, title: str, summary: DataFrame, config: dict | None = None, shares: tuple[str, ...] = ()) -> None:
    """report.json and report.md in a folder of the driver."""
    rows = rows_of(summary)
    os.makedirs(folder, exist_ok=True)
    with open(os.path.join(folder, "report.json"), "w", encoding="utf8") as f:
        json.dump({"title": title, "config": config or {}, "rows": rows}, f, ensure_ascii=False, indent=1, default=str)
    with open(os.path.join(folder, "report.md"), "w", encoding="utf8") as f:
        f.write(markdown(title, rows, shares))


def gate(value: float, least: float) -> int:
    """An exit code: 1 below the least value."""
    return int(value < least)
