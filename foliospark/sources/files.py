"""Files by format, and JSON lines with line numbers and errors."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def suffix(path: Column) -> Column:
    """The lower-case suffix of a file name with its dot; empty where there is none."""
    return F.lower(F.regexp_extract(path, r"(\.[^./\\]+)$", 1))


def stem(path: Column) -> Column:
    return F.regexp_replace(F.regexp_extract(path, r"([^/\\]+)$", 1), r"\.[^.]*$", "")


def dispatch(files: DataFrame) -> DataFrame:
    """Adds ``sha256``, ``fmt`` and ``reader`` (jats, pages, or none) to files (path, content)."""
    s = suffix(F.col("path"))
    reader = F.when(s == ".xml", "jats").when(s == ".pdf", "pages").otherwise("none")
    return files.withColumns({"sha256": F.sha2("content", 256), "fmt": F.when(s == ".xml", "jats").when(s == ".pdf", "pdf").otherwise(s), "reader": reader})


def read_files(spark: SparkSession, folder: str, pattern: str = "*") -> DataFrame:
    """(path, content) of the files in ``folder`` whose names fit ``pattern``."""
    return spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(folder).select("path", "content")


def pairs_by_stem(left: DataFrame, right: DataFrame) -> DataFrame:
    """Files of two frames with the same name apart from the suffix: (stem, left_path, right_path)."""
    a = left.select(stem(F.col("path")).alias("stem"), F.col("path").alias("left_path"))
    b = right.select(stem(F.col("path")).alias("stem"), F.col("path").alias("right_path"))
    return a.join(b, "stem")


def parse_lines(lines: DataFrame, schema: T.StructType, required: list[str]) -> tuple[DataFrame, DataFrame]:
    """(records, errors) of JSON lines (file, line_no, value).

    Blank lines are skipped but counted. An error has a code: not_json, not_an_object, unknown_key,
    missing_key. Keys of the schema that aren't required may be missing and are null then.
    """
    d = lines.where(F.regexp_replace("value", r"[\s  -    　]+", "") != "")
    known = F.array(*[F.lit(f.name) for f in schema])
    # The parser stops behind the first value: what follows it shows when the line stands in an array and in an object.
    alone = F.try_parse_json(F.concat(F.lit('{"v":'), "value", F.lit("}"))).isNotNull() & (F.json_array_length(F.concat(F.lit("["), "value", F.lit("]"))) == 1)
    parsed = F.when(alone, F.try_parse_json(F.col("value")))
    keys = F.json_object_keys("value")
    code = (
        F.when(parsed.isNull(), "not_json")
        .when(keys.isNull(), "not_an_object")
        .when(F.size(F.array_except(keys, known)) > 0, "unknown_key")
        .when(F.size(F.array_except(F.array(*map(F.lit, required)), keys)) > 0, "missing_key")
    )
    d = d.withColumn("code", code)
    ok = d.where("code IS NULL").select("file", "line_no", F.from_json("value", schema).alias("r")).select("file", "line_no", "r.*")
    return ok, d.where("code IS NOT NULL").select("file", "line_no", "code")


def read_json_lines(spark: SparkSession, path: str) -> DataFrame:
    """(file, line_no, value) of text files, each read whole, so lines are numbered from 1 in file order.

    Lines end with a line feed only. A missing path gives no rows.
    """
    missing = not re.match(r"\w+:", path) and not _exists(spark, path)
    if missing:
        return spark.createDataFrame([], "file string, line_no int, value string")
    texts = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("file"), "value")
    rows = texts.select("file", F.posexplode(F.split("value", "\n")).alias("n", "value"))
    return rows.select("file", (F.col("n") + 1).alias("line_no"), "value")


def _exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def to_json_lines(df: DataFrame, columns: list[str]) -> DataFrame:
    """(value): each row as a JSON object with all ``columns`` in order, nulls included."""
    return df.select(F.to_json(F.struct(*columns), {"ignoreNullFields": "false"}).alias("value"))


def write_json_lines(df: DataFrame, path: str, columns: list[str], mode: str = "overwrite", source: str | None = None) -> None:
    """Writes rows as JSON lines; refuses to write over the path that the rows came from."""
    if source is not None and source.rstrip("/") == path.rstrip("/"):
        raise ValueError("the output is the input")
    to_json_lines(df, columns).write.mode(mode).text(path)
