"""Delimited payment files as all-text DataFrames."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

# Cell texts read as null.
NULL_TEXTS = (
    "", " ", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN",
    "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null",
)

POSITION = "__position"


def _quotes() -> Column:
    return (F.length("value") - F.length(F.replace("value", F.lit('"'), F.lit("")))).cast("long")


def has_broken_lines(spark: SparkSession, path: str) -> bool:
    """Whether some quoted cell goes on in the next line, so that lines hold odd numbers of quotes."""
    return not spark.read.text(path).filter(_quotes() % 2 == 1).isEmpty()


def records(spark: SparkSession, path: str) -> DataFrame:
    """(block, row, value): the records of one file, each split read by a task of its own.

    A line starts a record if an even number of quotes stands before it. That
    number is summed per split first; a scan over these sums, one row per split,
    gives the state in which each split starts, and a sum within the split the
    state of each line. Only lines of records that go over several lines are
    shuffled, to the split and line where their record starts.
    """
    lines = spark.read.option("lineSep", "\n").text(path).select(
        F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("row"), "value"
    )
    lines = lines.withColumn("quotes", _quotes())
    earlier = Window.orderBy("block").rowsBetween(Window.unboundedPreceding, -1)  # one row per split
    before = F.coalesce(F.sum("quotes").over(earlier), F.lit(0)).alias("before")
    splits = F.broadcast(lines.groupBy("block").agg(F.sum("quotes").alias("quotes")).select("block", before))
    upto = Window.partitionBy("block").orderBy("row").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    state = F.col("before") + F.sum("quotes").over(upto)
    placed = lines.join(splits, "block").withColumn("after", state % 2).withColumn("inside", (state - F.col("quotes")) % 2 == 1)
    starts = F.when(~F.col("inside"), F.col("row"))
    placed = placed.withColumn("start", F.last(starts, ignorenulls=True).over(upto))
    single = placed.filter(~F.col("inside") & (F.col("after") == 0)).select("block", "row", "value")
    broken = placed.filter(F.col("inside") | (F.col("after") == 1))
    # Lines at the head of a split go on with the last record that started in an earlier one.
    ends = broken.groupBy("block").agg(F.max("start").alias("start")).select("block", F.struct("block", "start").alias("own"), "start")
    last = F.last(F.when(F.col("start").isNotNull(), F.col("own")), ignorenulls=True).over(earlier).alias("carried")
    owned = broken.join(F.broadcast(ends.select("block", last)), "block")
    owner = F.when(F.col("start").isNotNull(), F.struct("block", "start")).otherwise(F.col("carried"))
    parts = F.array_sort(F.collect_list(F.struct("block", "row", "value"))).alias("parts")
    joined = owned.groupBy(owner.alias("owner")).agg(parts)  # the lines of one record
    text = F.array_join(F.transform("parts", lambda p: p["value"]), "\n")
    return single.unionByName(joined.select("owner.block", F.col("owner.start").alias("row"), text.alias("value")))


def read_delimited(spark: SparkSession, path: str, separator: str = ",") -> DataFrame:
    """Read one file with a header, every cell as text, plus its position in the file.

    A quote inside a quoted cell is doubled. A file is read in as many splits as
    its size asks for; where quoted cells hold line ends, its records are put
    together from lines first (they end with a line feed then, after a carriage
    return or not). Splits of a file are ordered by their start, and rows within a
    split by the generated id, so ``__position`` sorts like the lines do.
    """
    broken = has_broken_lines(spark, path)
    quoting = {"sep": separator, "quote": '"', "escape": '"', "multiLine": broken}
    raw = spark.read.csv(path, header=True, inferSchema=False, **quoting)
    position = F.struct(F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("row"))
    if broken:
        names = [f"c{i}" for i in range(len(raw.columns))]
        text = F.regexp_replace("value", r"\r$", "")
        rows = records(spark, path).filter(F.btrim(text) != "").select("block", "row", text.alias("value"))
        head = rows.orderBy("block", "row").limit(1).select(F.struct("block", "row").alias("head"))
        options = {k: str(v).lower() if isinstance(v, bool) else v for k, v in quoting.items()}
        parsed = F.from_csv("value", ", ".join(f"{n} string" for n in names), options)
        rows = rows.join(F.broadcast(head), F.struct("block", "row") != F.col("head"))
        raw = rows.select(parsed.alias("cells"), "block", "row").select(
            *(F.col(f"cells.{n}").alias(c) for n, c in zip(names, raw.columns)), F.struct("block", "row").alias(POSITION)
        )
        position = F.col(POSITION)
    cells = [
        F.when(~F.col(f"`{c}`").isin(*NULL_TEXTS), F.col(f"`{c}`")).alias(c.strip()) for c in raw.columns if c != POSITION
    ]
    return raw.select(*cells, position.alias(POSITION))


def source_columns(df: DataFrame) -> list[str]:
    return [c for c in df.columns if c != POSITION]


def write_by_rail(extract: DataFrame, path: str, rail: str = "rail", stage: str = "stage") -> None:
    """Split a combined extract into one folder per rail and stage."""
    extract.write.mode("overwrite").partitionBy(rail, stage).option("header", True).csv(path)


def unmapped_columns(columns: Sequence[str], mapped: Sequence[str]) -> list[str]:
    known = set(mapped)
    return [c for c in columns if c not in known]
