"""Fixed-width and simple comma-separated text, with codecs for the columns."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from skeinworks.functions.scalars import CODECS
from skeinworks.operators.rows import ROW
from skeinworks.session import quoted

_PLACE = "__place"


def _lines(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path)


def read_fixed_width(spark: SparkSession, path: str, columns: Sequence[tuple[str, int, int, str]], *, bytes_: bool = True) -> DataFrame:
    """Fixed-width records, one per line.

    ``columns``: (name, start, end, type name), half-open.  Offsets are bytes as stored,
    or characters with ``bytes_=False``.  Cells are trimmed, then read by the type's
    codec.  Only the columns a query uses are cut out.
    """
    line = F.col("value").cast("binary") if bytes_ else F.col("value")

    def cell(start: int, end: int) -> Column:
        part = F.substring(line, start + 1, end - start)
        return F.trim(F.decode(part, "UTF-8") if bytes_ else part)

    return _lines(spark, path).select(*[CODECS[t].text(cell(a, b)).alias(n) for n, a, b, t in columns])


def read_csv_lines(spark: SparkSession, path: str, types: dict[str, str] | None = None) -> DataFrame:
    """Lines split at commas, with a header in every file and without quoting.

    Blanks around a comma go; commas beyond the last column stay in the last field.
    Columns are text unless ``types`` names another.  The first line of each file is its
    header, and only that; a file with another header than the rest is an error, as is
    a folder without any line.  Blank lines are none.
    """
    types = types or {}
    head = _lines(spark, path).where(F.col("_metadata.file_block_start") == 0).limit(1).first()
    if head is None:
        raise ValueError("an empty file has no header")
    names = [n.strip() for n in head[0].split(",")]
    # Spark's own reader takes the header off each file and compares it; a line is one cell to it.
    whole = T.StructType([T.StructField(head[0], T.StringType())])
    lines = spark.read.schema(whole).csv(path, header=True, enforceSchema=False, sep="\uffff", quote="", escape="").toDF("value")
    cells = F.split("value", r"\s*,\s*", len(names))
    return lines.select(*[CODECS[types.get(n, "IoString")].text(F.trim(F.get(cells, F.lit(i)))).alias(n) for i, n in enumerate(names)])


def csv_cell(c: Column, kind: str) -> Column:
    """A cell as the writer has it: zero and false are empty, true is 1, null is "null"."""
    if kind == "boolean":
        return F.coalesce(F.when(c, F.lit("1")).otherwise(F.when(~c, F.lit(""))), F.lit("null"))
    if kind in ("tinyint", "smallint", "int", "bigint", "float", "double") or kind.startswith("decimal"):
        return F.coalesce(F.when(c == 0, F.lit("")).otherwise(c.cast("string")), F.lit("null"))
    return F.coalesce(c.cast("string"), F.lit("null"))


def write_csv_lines(df: DataFrame, path: str, *, single_file: bool = False) -> None:
    """Comma-separated lines with a header in every file, in row order where there is one.

    An empty table becomes a file with the header alone.
    """
    columns = [(n, k) for n, k in df.dtypes if n != ROW]
    rows = df.orderBy(ROW) if ROW in df.columns else df
    line = F.concat_ws(",", *[csv_cell(quoted(n), k) for n, k in columns])
    out = rows.select(line.alias("value"))
    if single_file:
        out = out.coalesce(1)
    header = ",".join(n for n, _ in columns)
    # A line is one cell to Spark's writer, which puts the header first.
    out.toDF(header).write.mode("overwrite").csv(path, header=True, sep="\uffff", quote="", escape="", emptyValue="", ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False)


def file_digests(spark: SparkSession, path: str) -> DataFrame:
    """(``path``, ``sha256``) of every file; made where the files are read."""
    return spark.read.format("binaryFile").load(path).select("path", F.sha2("content", 256).alias("sha256"))


def xpath_list(text: Column, path: str) -> Column:
    """The texts an XPath finds in a well-formed document."""
    return F.xpath(text, F.lit(path))


def row_text(df: DataFrame) -> Column:
    """A row as JSON text, nested cells included."""
    return F.to_json(F.struct(*[quoted(c) for c in df.columns]))
