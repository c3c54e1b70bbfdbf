"""CSV files whose headers differ in order, wording or encoding.

One pass of Spark's text reader over all lines finds each file's header and encoding. The driver
sees the distinct headers alone and says at which place each wanted column stands in them; that
table of places, joined to the files, turns one further scan of the lines into columns, whatever
the number of headers. All access to storage goes through Spark, so any path that Spark can scan
can be read.
"""

from __future__ import annotations

import csv
import dataclasses
import re
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# What follows this mark in a line is a comment, and a byte order mark.
COMMENT = "\\"
BYTE_ORDER_MARK = "﻿"
# How column names are compared. The stray letter comes before a degree sign
# that was read in the wrong encoding; the signs count as blanks.
STRAY, DEGREE_SIGNS, BLANK_SIGNS = "â", "[°º]", r"[()./,%]"


@dataclasses.dataclass
class Layout:
    """A header line that files share."""

    header: str
    columns: list[str]

    def position(self, *tokens: str, without: Sequence[str] = ()) -> int | None:
        """First column whose normal form contains all tokens and none of ``without``."""
        for i, column in enumerate(self.columns):
            normal = normal_header(column)
            if all(t in normal for t in tokens) and not any(t in normal for t in without):
                return i
        return None


def normal_header(text: str) -> str:
    """Lower case, degree signs as ``deg``, punctuation and runs of blanks as one blank."""
    text = re.sub(DEGREE_SIGNS, "deg", text.lower().replace(STRAY, ""))
    return " ".join(re.sub(BLANK_SIGNS, " ", text).split())


def _decoded(line: Column, encoding: Column) -> Column:
    latin = F.decode(line.cast("binary"), "ISO-8859-1")
    return F.when(encoding == "UTF-8", F.ltrim(line, F.lit(BYTE_ORDER_MARK))).otherwise(latin)


def _content(line: Column, comment: str | None) -> Column:
    return F.substring_index(line, comment, 1) if comment else line


def _below(spark: SparkSession, folder: str, pattern: str, wanted: Column | None, kind: str) -> DataFrame:
    """A scan of the files below a folder; ``wanted``, a condition on ``_metadata``, leaves out whole files."""
    files = spark.read.format(kind).option("pathGlobFilter", pattern).option("recursiveFileLookup", True).load(folder)
    return files if wanted is None else files.where(wanted)


def csv_files(spark: SparkSession, folder: str, pattern: str = "*.csv") -> DataFrame:
    """(path, file_name, parent) of the files below a folder, listed by Spark.

    Files of zero bytes are not listed: a scan has no split for them.
    """
    listed = _below(spark, folder, pattern, None, "binaryFile").select(F.col("_metadata.file_path").alias("path"))
    return listed.select("path", file_name().alias("file_name"), parent_folder().alias("parent"))


def file_name(path: Column | str = "path") -> Column:
    return F.element_at(F.split(path, "/"), -1)


def parent_folder(path: Column | str = "path") -> Column:
    parts = F.split(path, "/")
    return F.get(parts, F.size(parts) - 2)


def heads(spark: SparkSession, folder: str, pattern: str = "*.csv", wanted: Column | None = None) -> DataFrame:
    """(path, header, encoding, line) of each file below a folder that is ``wanted``, by its ``_metadata``.

    The header is the first line with more than a comment, wherever it stands; it is null
    in a file without one, and ``line`` counts its place from 1. A file is UTF-8 if all its
    lines are, else Latin-1. One aggregate per file, combined before the shuffle.
    """
    value = F.col("value")
    place = F.struct(F.col("_metadata.file_block_start").alias("block"), F.col("at"), value.alias("value"))
    lines = _below(spark, folder, pattern, wanted, "text").select("value", "_metadata", F.monotonically_increasing_id().alias("at"))
    bare = F.trim(F.ltrim(F.substring_index(value, COMMENT, 1), F.lit(BYTE_ORDER_MARK)))
    found = lines.groupBy(F.col("_metadata.file_path").alias("path")).agg(
        F.min(F.when(bare != "", place)).alias("first"),
        F.min(place).alias("begin"),
        F.every(F.is_valid_utf8(value)).alias("valid"),
    )
    encoding = F.when(F.col("valid"), "UTF-8").otherwise("ISO-8859-1")
    header = F.trim(_content(_decoded(F.col("first.value"), encoding), COMMENT))
    # places count on within a block; a header beyond the first block is far down anyway
    return found.select("path", header.alias("header"), encoding.alias("encoding"), (F.col("first.at") - F.col("begin.at") + 1).alias("line"))


def layouts(found: DataFrame) -> list[Layout]:
    """The distinct headers of the files in ``found``."""
    headers = [r["header"] for r in found.select("header").where("header IS NOT NULL").distinct().collect()]
    return [Layout(header, [c.strip() for c in next(csv.reader([header]))]) for header in sorted(headers)]


def read_columns(
    spark: SparkSession,
    folder: str,
    found: DataFrame,
    places: Mapping[str, Mapping[str, int | None]],
    pattern: str = "*.csv",
    wanted: Column | None = None,
    comment: str | None = None,
) -> DataFrame:
    """Columns as text, and ``file_path``, of the files in ``found`` whose header is in ``places``; all in one scan.

    ``places`` gives for each header where each column stands, the same columns for all; a column without a place
    is null. Blank lines and lines that repeat their file's header are no rows. With ``comment`` a line ends where
    the mark stands. The lines meet a table with a row for each file, which Spark broadcasts if it is small.
    """
    names = list(next(iter(places.values())))
    width = 1 + max(at for place in places.values() for at in place.values() if at is not None)
    at = {n: f"__at_{i}" for i, n in enumerate(names)}
    by_header = spark.createDataFrame(
        [(header, *[place[n] for n in names]) for header, place in places.items()],
        ", ".join(["header string", *[f"{c} int" for c in at.values()]]),
    )
    files = found.select("path", "header", "encoding").join(by_header, "header")
    lines = _below(spark, folder, pattern, wanted, "text").select("value", F.col("_metadata.file_path").alias("path"))
    line = _content(_decoded(F.col("value"), F.col("encoding")), comment)
    cells = F.from_csv("line", ", ".join(f"c{i} string" for i in range(width)))
    rows = lines.join(files, "path").withColumn("line", line).withColumn("__row", cells)
    rows = rows.withColumn("__cells", F.array(*[F.col(f"__row.c{i}") for i in range(width)]))
    # a generator, not a filter: a later condition that fails on bad values could otherwise be tried first, on header lines
    is_row = (F.trim("line") != "") & (F.trim("line") != F.col("header"))
    chosen = F.struct(*[F.get("__cells", F.col(c)).alias(n) for n, c in at.items()], F.col("path").alias("file_path"))
    return rows.select(F.inline(F.when(is_row, F.array(chosen))))
