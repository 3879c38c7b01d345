"""Records out of pages and run logs, and the plain file sinks."""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

NEXT_DATA = r'(?s)<script[^>]*\bid="__NEXT_DATA__"[^>]*>(.*?)</script>'


def embedded_json(html: Column) -> Column:
    """The JSON text of a page's data script; null if it has none."""
    return F.nullif(F.trim(F.regexp_extract(html, NEXT_DATA, 1)), F.lit(""))


#: A string with its escapes (to the end where it isn't closed) or a brace.
TOKEN = re.compile(r'"(?:[^"\\]|\\.)*+("?)|[{}]', re.S)


def balanced(text: str | None, begin: str) -> str | None:
    """The object that begins right after the first match of the pattern and blanks, up to its own closing brace; braces in strings don't count. Null if there is none or it doesn't close. One pass."""
    found = re.search(begin, text) if text else None
    start = re.compile(r"\s*").match(text, found.end()).end() if found else 0
    if not found or text[start : start + 1] != "{":
        return None
    depth = 0
    for token in TOKEN.finditer(text, start):
        if token.group() == "{":
            depth += 1
        elif token.group() == "}":
            depth -= 1
            if not depth:
                return text[start : token.end()]
    return None


def balanced_json(html: Column, begin: str = r"window\.PAGE_MODEL\s*=") -> Column:
    """The text of a page's object by ``balanced``, in Arrow batches: nested braces are beyond regular expressions."""

    @F.arrow_udf("string")
    def read(pages: pa.Array) -> pa.Array:
        return pa.array([balanced(t, begin) for t in pages.to_pylist()], pa.string())

    return read(html)


def embedded_listings(pages: DataFrame, path: str, schema: str, html: str = "html") -> DataFrame:
    """A row for each record of the array at ``path`` (like ``$.props.pageProps.results``), with the page's other columns.

    ``schema`` is a record's in DDL; the record is the column ``record``. Pages without script, path
    or array give no row; a record that doesn't fit is null in the fields that don't.
    """
    found = F.from_json(F.get_json_object(embedded_json(F.col(html)), path), f"array<struct<{schema}>>")
    others = [c for c in pages.columns if c != html]
    return pages.select(*others, F.explode(found).alias("record"))


def log_stats(spark: SparkSession, path: str) -> DataFrame:
    """Per log file the counters ``item_scraped_count`` and ``finish_reason``, and the number of lines with ERROR."""
    lines = spark.read.text(path).select(F.col("_metadata.file_name").alias("log"), "value")
    count = F.regexp_extract("value", r"'item_scraped_count':\s*(\d+)", 1)
    reason = F.regexp_extract("value", r"'finish_reason':\s*'([^']*)'", 1)
    return lines.groupBy("log").agg(
        F.max(F.nullif(count, F.lit("")).cast("long")).alias("items"), F.max(F.nullif(reason, F.lit(""))).alias("reason"), F.count_if(F.contains("value", F.lit("ERROR"))).alias("errors")
    )


def append_json_lines(df: DataFrame, folder: str, by: tuple[str, ...] = ("area", "source")) -> None:
    """Appends one JSON object a line, a folder per value of ``by``; a task's commit stands for a file lock."""
    df.write.partitionBy(*by).mode("append").json(folder)


def write_csv(df: DataFrame, folder: str) -> None:
    """Replaces the folder with CSV files that have a header."""
    df.write.mode("overwrite").option("header", True).csv(folder)
