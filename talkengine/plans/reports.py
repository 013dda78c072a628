"""Reports of small result tables: numbers, Markdown, manifests. Rows come to the driver, at most ``ROWS`` of a table."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame

ROWS = 1000


def number(v, digits: int = 3) -> str:
    """n/a for null, whole numbers with separators, others with ``digits`` places."""
    if v is None:
        return "n/a"
    if isinstance(v, bool):
        return "yes" if v else "no"
    if isinstance(v, int):
        return f"{v:,}"
    return f"{v:.{digits}f}" if isinstance(v, float) else str(v)


def markdown(df: DataFrame, title: str, digits: int = 3) -> str:
    """A heading and the table; what is beyond ``ROWS`` rows is told, not shown."""
    rows = df.limit(ROWS + 1).collect()
    head = [f"## {title}", "", "| " + " | ".join(df.columns) + " |", "|" + " --- |" * len(df.columns)]
    body = ["| " + " | ".join(number(v, digits).replace("|", "\\|").replace("\n", " ") for v in r) + " |" for r in rows[:ROWS]]
    return "\n".join([*head, *body, *([f"(more than {ROWS} rows)"] if len(rows) > ROWS else [])]) + "\n"


def gates(values: dict[str, float | None], targets: dict[str, float]) -> list[tuple[str, float | None, float, bool]]:
    """(name, value, target, met) of the values that have a target; a missing value is not met."""
    return [(k, values.get(k), t, values.get(k) is not None and values[k] >= t) for k, t in sorted(targets.items())]


def manifest(folders: list[dict], dollars: float, cost: float) -> str:
    """The state of a bulk run as JSON: per folder (folder, rows, science, calls, done) and the sums."""
    calls = sum(f["calls"] for f in folders)
    body = {
        "folders": folders, "n_folders_done": sum(f["done"] for f in folders), "n_rows": sum(f["rows"] for f in folders), "n_science": sum(f["science"] for f in folders),
        "calls": calls, "dollars": round(calls * cost, 4), "dollar_cap": dollars, "cap_reached": calls * cost >= dollars - cost,
    }
    return json.dumps(body, indent=1, sort_keys=True)


def write_text(spark, path: str, text: str) -> None:
    """A small text file on the file system of the path, replaced if it is there."""
    hadoop = spark._jvm.org.apache.hadoop.fs
    p = hadoop.Path(path)
    out = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(p, True)
    out.write(bytearray(text.encode()))
    out.close()
