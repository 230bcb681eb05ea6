"""Writers: partitioned tables, Markdown reports, JSON state, RSS."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from eventloom.functions.text import escape_html


def overwrite_partitions(df: DataFrame, path: str, by: list[str]) -> None:
    """Write a table, replacing only the partitions that ``df`` has rows for."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*by).parquet(path)


def report_markdown(picks: DataFrame, date: str, title: str = "Daily report") -> DataFrame:
    """(date, content) from picks (module, rank_no, title, description, url): one Markdown text."""
    entry = F.concat(F.lit("### "), F.col("rank_no").cast("string"), F.lit(". "), F.col("title"), F.lit("\n\n"), F.coalesce("description", F.lit("")), F.lit("\n\n"), F.coalesce(F.concat(F.lit("<"), F.col("url"), F.lit(">")), F.lit("")))
    per = picks.groupBy("module").agg(F.array_sort(F.collect_list(F.struct("rank_no", entry.alias("t")))).alias("e"))
    block = per.select("module", F.concat(F.lit("## "), F.col("module"), F.lit("\n\n"), F.array_join(F.transform("e", lambda x: x["t"]), "\n\n")).alias("block"))
    whole = block.agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("module", "block"))), lambda x: x["block"]), "\n\n").alias("body"))
    return whole.select(F.lit(date).alias("date"), F.concat(F.lit(f"# {title} {date}\n\n"), F.col("body")).alias("content"))


def write_report(report: DataFrame, folder: str) -> None:
    """Archive reports (date, content) as text in folders by date."""
    report.select("date", F.col("content").alias("value")).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("date").text(folder)


def rss(items: DataFrame, title: str, link: str, order: Column, most: int = 30) -> DataFrame:
    """(value): one RSS document from items (title, link, published_at, description), the newest ``most``."""
    part = lambda name, c: F.concat(F.lit(f"<{name}>"), escape_html(c), F.lit(f"</{name}>"))
    item = F.concat(F.lit("<item>"), part("title", F.col("title")), part("link", F.col("link")), part("pubDate", F.col("published_at").cast("string")), part("description", F.substring(F.coalesce("description", F.lit("")), 1, 300)), F.lit("</item>"))
    newest = items.orderBy(order).limit(most).select(F.col("published_at").cast("string").alias("p"), item.alias("x"))
    body = newest.agg(F.array_join(F.transform(F.reverse(F.array_sort(F.collect_list(F.struct("p", "x")))), lambda s: s["x"]), "").alias("b"))
    head = f'<?xml version="1.0" encoding="UTF-8"?><rss version="2.0"><channel><title>{title}</title><link>{link}</link>'
    return body.select(F.concat(F.lit(head), F.col("b"), F.lit("</channel></rss>")).alias("value"))


def trace(df: DataFrame, column: str, stage: str, tool: str, detail: Column, at: Column) -> DataFrame:
    """``df`` with one more entry in its lineage column."""
    entry = F.struct(F.lit(stage).alias("stage"), at.cast("string").alias("timestamp"), F.lit(tool).alias("tool"), detail.cast("string").alias("detail"))
    kind = "array<struct<stage:string,timestamp:string,tool:string,detail:string>>"
    before = F.col(column) if column in df.columns else F.array()
    return df.withColumn(column, F.array_append(F.coalesce(before.cast(kind), F.array().cast(kind)), entry))
