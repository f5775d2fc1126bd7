"""Writing results."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_jsonl(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def replace_table(df: DataFrame, path: str, version: str) -> str:
    """Write a new version of a table beside the old ones; readers move on once it is whole."""
    target = f"{path}/version={version}"
    df.write.mode("errorifexists").parquet(target)
    return target


def conversation_markdown(turns: DataFrame, *, conv: str, turn: str, role: str, text: str) -> DataFrame:
    """conv, markdown: a heading and its text for each turn, in order."""
    part = F.concat(F.lit("## "), F.initcap(role), F.lit("\n\n"), F.col(text))
    lines = F.transform(F.array_sort(F.collect_list(F.struct(turn, part.alias("p")))), lambda x: x["p"])
    return turns.groupBy(conv).agg(F.array_join(lines, "\n\n").alias("markdown"))


def conversation_json(turns: DataFrame, *, conv: str, turn: str, role: str, text: str) -> DataFrame:
    rows = F.array_sort(F.collect_list(F.struct(turn, F.col(role).alias("role"), F.col(text).alias("content"))))
    return turns.groupBy(conv).agg(F.to_json(F.transform(rows, lambda x: F.struct(x["role"].alias("role"), x["content"].alias("content")))).alias("json"))


def prometheus(metrics: DataFrame) -> DataFrame:
    """line: name{labels} value, from name, labels (map), value; labels sorted by key."""
    pairs = F.transform(F.array_sort(F.map_entries("labels")), lambda e: F.concat(e["key"], F.lit('="'), e["value"], F.lit('"')))
    return metrics.select(F.concat("name", F.when(F.size("labels") > 0, F.concat(F.lit("{"), F.array_join(pairs, ","), F.lit("}"))).otherwise(""), F.lit(" "), F.col("value").cast("string")).alias("line"))
