"""Reports as text and JSON, for people: rules are few, and only they come to the driver."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame

from .mine import ordered


def percent(holds: int, of: int) -> str:
    return f"{100 * holds / of:.0f}%" if of else "-"


def rules_text(rules: DataFrame, most: int = 200) -> str:
    lines = []
    for r in ordered(rules).limit(most).collect():
        lines.append(f"[{r['status']}] {r['operator']}: {r['text']} ({r['holds']}/{r['of']}, {percent(r['holds'], r['of'])}) {r['evidence']}" + (f" — {r['reason']}" if r["reason"] else ""))
    return "\n".join(lines)


def table_text(df: DataFrame, most: int = 100) -> str:
    """Any small result, a line a row."""
    rows = df.limit(most).collect()
    return "\n".join(["\t".join(df.columns), *("\t".join("-" if v is None else str(v) for v in r) for r in rows)])


def as_json(df: DataFrame, most: int = 10_000) -> str:
    return json.dumps([json.loads(x) for x in df.limit(most).toJSON().collect()], indent=1, sort_keys=True)
