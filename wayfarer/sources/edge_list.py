"""Edge lists in text: a directed edge on each line, ``from to [weight]``.

Tokens are parted by runs of tabs, commas and spaces. Lines that start with # or % are comments. A
line with too few tokens, a blank one too, is an error (strict) or skipped. Self-loops are dropped before
anything is counted. Lines need no order; the order of a vertex's neighbours is that of its lines, in files by path.
A line with a token that is no number, or with a negative id, is an error (strict) or skipped as well. Lines beyond the tokens needed
are ignored. No line gives no edge.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SEPARATORS = "[\t, ]+"
COMMENT = "^[#%]"


def tokens(line: Column) -> Column:
    return F.filter(F.split(line, SEPARATORS), lambda t: t != "")


def parse_lines(lines: DataFrame, weighted: bool = False, strict: bool = True, line: str = "value", order: str | Column | None = None) -> DataFrame:
    """src, dst, weight (null if not weighted) and ord (order of lines) of lines in a text column."""
    need = 3 if weighted else 2
    ord_ = F.monotonically_increasing_id() if order is None else F.col(order) if isinstance(order, str) else order
    # Comments have no tokens, so that nothing of them is ever cast, whatever order the optimizer filters in.
    parsed = lines.select(F.col(line).alias("line"), ord_.alias("ord")).withColumn("t", F.when(~F.col("line").rlike(COMMENT), tokens(F.col("line"))))
    if strict:
        bad = F.raise_error(F.concat(F.lit("edge list: bad line: "), F.col("line")))
        parsed = parsed.withColumn("t", F.when(F.col("t").isNull() | (F.size("t") >= need), F.col("t")).otherwise(bad.cast("array<string>"))).filter("t is not null")
        number, real = (lambda c: c.cast("long")), (lambda c: c.cast("double"))
    else:
        parsed = parsed.filter(F.size("t") >= need)
        number, real = (lambda c: c.try_cast("long")), (lambda c: c.try_cast("double"))
    out = parsed.select(number(F.get("t", F.lit(0))).alias("src"), number(F.get("t", F.lit(1))).alias("dst"), (real(F.get("t", F.lit(2))) if weighted else F.lit(None).cast("double")).alias("weight"), "ord")
    if strict:
        negative = F.raise_error(F.concat(F.lit("edge list: negative id: "), F.least("src", "dst").cast("string"))).cast("long")
        out = out.withColumn("src", F.when((F.col("src") < 0) | (F.col("dst") < 0), negative).otherwise(F.col("src")))
    else:
        out = out.filter("src >= 0 and dst >= 0" + (" and weight is not null" if weighted else ""))
    return out.filter("src <> dst")


def read_edge_list(spark: SparkSession, path: str, weighted: bool = False, strict: bool = True) -> DataFrame:
    """Scan a text file or folder; splits are read in parallel.

    ord is (file path, start of the split, number that grows within the split), so neighbours keep the order of
    lines whatever split Spark reads first.
    """
    place = F.struct(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("start"), F.monotonically_increasing_id().alias("line"))
    return parse_lines(spark.read.text(path).select("value", place.alias("place")), weighted, strict, order="place")


def write_edge_list(edges: DataFrame, path: str, weighted: bool = False) -> None:
    """Write src, dst [, weight] as tab-separated lines, in order of src and, where there is one, pos."""
    columns = ["src", "dst"] + ["weight"] * weighted
    ordered = edges.orderBy("src", *(["pos"] if "pos" in edges.columns else []))
    ordered.select(F.concat_ws("\t", *[F.col(c).cast("string") for c in columns]).alias("value")).write.mode("overwrite").text(path)
