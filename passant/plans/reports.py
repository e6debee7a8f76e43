"""Markdown tables of small results."""

from __future__ import annotations

import json
from collections.abc import Sequence
from pathlib import Path

from pyspark.sql import DataFrame

MOST_ROWS = 10_000


def ci(mean: float, lo: float, hi: float) -> str:
    return f"{mean:+.2f} [{lo:+.2f}, {hi:+.2f}]"


def p_value(p: float) -> str:
    return "<0.001" if p < 0.001 else f"{p:.3f}"


def table(rows: Sequence[dict], columns: Sequence[str] | None = None) -> str:
    columns = columns or list(rows[0]) if rows else list(columns or [])
    show = lambda v: f"{v:.3f}" if isinstance(v, float) else str(v)
    lines = ["| " + " | ".join(columns) + " |", "|" + "---|" * len(columns)]
    return "\n".join([*lines, *("| " + " | ".join(show(r[c]) for c in columns) + " |" for r in rows)])


def write(df: DataFrame, out: str) -> None:
    """A small result as .json and .md siblings; a result that isn't small is refused."""
    rows = [r.asDict(recursive=True) for r in df.limit(MOST_ROWS + 1).collect()]
    if len(rows) > MOST_ROWS:
        raise ValueError("too many rows for a report")
    Path(f"{out}.json").write_text(json.dumps(rows, indent=1, default=str))
    Path(f"{out}.md").write_text(table(rows, df.columns) + "\n")
