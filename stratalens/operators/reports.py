"""Grouped reports and text sinks: top lists, markdown, diagrams, JSON, templates."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def top(rows: DataFrame, by: list[str], k: int, value: Column | None = None) -> DataFrame:
    """The k largest groups: by, n; ties in the order of the group."""
    n = F.count(F.lit(1)) if value is None else F.sum(value)
    return rows.groupBy(*by).agg(n.alias("n")).orderBy(F.desc("n"), *by).limit(k)


def grouped(rows: DataFrame, group: str, item: str, most: int) -> DataFrame:
    """group, n, and its first `most` items in order."""
    w = Window.partitionBy(group).orderBy(item)
    first = rows.withColumn("__r", F.row_number().over(w)).withColumn("__i", F.when(F.col("__r") <= most, F.col(item)))
    return first.groupBy(group).agg(F.count(F.lit(1)).alias("n"), F.sort_array(F.collect_list("__i")).alias("items"))


def diagram(edges: DataFrame, direction: str = "LR") -> DataFrame:
    """One text: a flow chart of the edges (src, dst), sorted. For graphs that one reads as a picture."""
    arrows = F.concat_ws("\n", F.sort_array(F.collect_set(F.concat(F.lit("    "), "src", F.lit(" --> "), "dst"))))
    return edges.agg(F.concat(F.lit(f"graph {direction}\n"), arrows).alias("text"))


def markdown(rows: DataFrame, title: str, group: str, line: Column) -> DataFrame:
    """A section of each group: group, text."""
    body = F.array_join(F.sort_array(F.collect_list(F.concat(F.lit("- "), line))), "\n")
    return rows.groupBy(group).agg(body.alias("b")).select(group, F.concat(F.lit(f"## {title}: "), F.col(group).cast("string"), F.lit("\n\n"), "b").alias("text"))


_BLOCK = re.compile(r"\{%\s*(if|for)\s+(.+?)\s*%\}(.*?)\{%\s*end\1\s*%\}", re.S)
_NAME = re.compile(r"\{\{\s*([\w.]+)\s*\}\}")


def _render(template: str, values: dict) -> str:
    def block(m: re.Match) -> str:
        kind, head, body = m.groups()
        if kind == "if":
            return _render(body, values) if values.get(head.strip()) else ""
        name, _, source = head.partition(" in ")
        return "".join(_render(body, {**values, name.strip(): v}) for v in values.get(source.strip()) or [])

    while _BLOCK.search(template):
        template = _BLOCK.sub(block, template)
    return _NAME.sub(lambda m: str(values.get(m[1], "")), template)


def rendered(rows: DataFrame, key: str, template: str) -> DataFrame:
    """Templates with variables, if and for over the columns of each row: key, text."""
    columns = rows.columns

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            values = frame.to_dict("records")
            yield pd.DataFrame({key: frame[key], "text": [_render(template, {c: (list(v[c]) if hasattr(v[c], "tolist") else v[c]) for c in columns}) for v in values]})

    return rows.mapInPandas(run, f"{key} {dict(rows.dtypes)[key]}, text string")


def write(rows: DataFrame, path: str, kind: str = "parquet", by: list[str] | None = None, mode: str = "overwrite") -> None:
    """Sink to Parquet, JSON lines, CSV or text, partitioned by columns."""
    writer = rows.write.mode(mode)
    (writer.partitionBy(*by) if by else writer).format(kind).save(path)


def tree(files: DataFrame, most: int = 10) -> DataFrame:
    """Listing of each folder: folder, its first `most` files in order, and how many there are."""
    folder = F.regexp_extract("path", r"^(.*)/[^/]+$", 1)
    return grouped(files.select(folder.alias("folder"), F.regexp_extract("path", r"([^/]+)$", 1).alias("file")), "folder", "file", most)
