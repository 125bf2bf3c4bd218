"""Mixing of sources to target weights by capped water-filling.

Every source wants its weight's share of the words to take. A source may be
repeated ``max_epochs`` times at most, so those whose share is above that are
clamped and the excess is dealt to the others by weight, again and again until
none is above. The repetitions that remain are whole ones of every document and
a fraction of the source, for which documents are drawn in a seeded order until
the target is met; of the last one drawn, only a fraction is taken.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from railwatch.functions.joins import join_small
from railwatch.functions.ranks import running_totals
from railwatch.llm.common import WORD_PATTERN, id_order
from railwatch.session import stored

WEIGHTS = (3, 1, 2)
SHARE_OF_ALL = 1.5
MAX_EPOCHS = 2.0
SEED = 20_240_101


def word_count(text: str = "text") -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD_PATTERN)), F.lit(0)).cast("long")


def _weighted(sources: DataFrame, weights: tuple[float, ...]) -> DataFrame:
    """Give sources their weights in turn, in the order of their names, null last.

    Ranges of names are counted before they are numbered, so no task sorts them
    all. Names compare by their UTF-8 bytes, which is the order of code points.
    """
    order = [F.col("source").isNull(), F.col("source")]
    ranges = stored(sources.repartitionByRange(*order).withColumn("range", F.spark_partition_id()), "ranges")
    before = Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    counts = ranges.groupBy("range").agg(F.count(F.lit(1)).alias("n"))  # one row per task
    counts = counts.select("range", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    place = F.row_number().over(Window.partitionBy("range").orderBy(*order)) - 1 + F.col("before")
    turns = F.array(*(F.lit(float(w)) for w in weights))
    turn = (F.pmod(place, F.lit(len(weights))) + 1).cast("int")
    return join_small(ranges, counts, ["range"]).withColumn("weight", F.element_at(turns, turn))


def targets(sizes: DataFrame, weights: tuple[float, ...], share: float, max_epochs: float) -> DataFrame:
    """source, source_size, target: one row per source of ``sizes(source, size)``."""
    sources = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    sources = stored(_weighted(sources, weights).select("source", "source_size", "weight"), "sources")
    budget = share * float(sources.agg(F.coalesce(F.sum("source_size"), F.lit(0))).first()[0])
    cap = F.col("source_size") * F.lit(float(max_epochs))
    level, clamped = 0.0, -1
    while True:
        above = F.col("weight") * F.lit(level) >= cap
        state = sources.agg(
            F.count(F.when(above, 1)).alias("clamped"),
            F.coalesce(F.sum(F.when(above, cap)), F.lit(0.0)).alias("used"),
            F.coalesce(F.sum(F.when(~above, F.col("weight"))), F.lit(0.0)).alias("open"),
        ).first()
        if state.clamped == clamped or not state.open:
            break
        clamped, level = state.clamped, (budget - state.used) / state.open
    return sources.withColumn("target", F.least(F.col("weight") * F.lit(level), cap)).select("source", "source_size", "target")


def row_mark(columns: list[str]) -> Column:
    """A hash of all columns of a row, nulls included: rows with equal marks are repeated rows."""
    return F.xxhash64(*(c for name in columns for c in (F.col(name), F.col(name).isNull())))


def sized(docs: DataFrame, seed: int = SEED) -> DataFrame:
    """doc_id, source, size and a seeded place in the drawing order, for every row.

    ``shares`` also asks for a ``number`` that tells rows apart.
    """
    place = F.xxhash64(F.lit(seed), id_order(), "source", "text")
    return docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.col("source").cast("string").alias("source"),
        word_count().alias("size"),
        place.alias("place"),
        id_order().alias("row"),
        row_mark(docs.columns).alias("mark"),
    )


def _groups(rows: DataFrame) -> DataFrame:
    """A name for each source that is never null."""
    return rows.withColumn("group", F.coalesce(F.concat(F.lit("="), F.col("source")), F.lit("-")))


def shares(
    rows: DataFrame,
    weights: tuple[float, ...] = WEIGHTS,
    share: float = SHARE_OF_ALL,
    max_epochs: float = MAX_EPOCHS,
) -> DataFrame:
    """``rows`` of ``sized`` with source_size, target, and the words taken of every document."""
    wanted = _groups(targets(rows, weights, share, max_epochs)).drop("source")
    whole = F.floor(F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0))
    wanted = wanted.withColumn("whole", whole)
    wanted = wanted.withColumn("rest", F.round(F.col("target") - whole * F.col("source_size")).cast("long"))
    # Places are spread evenly, so their leading bits cut every source into even parts.
    levels = {
        "coarse": F.shiftright("place", 52),
        "fine": F.shiftright("place", 40),
    }
    drawn = running_totals(_groups(rows), ["group"], levels, ["place", "number"], {"upto": F.col("size")})
    joined = join_small(drawn, wanted, ["group"])
    extra = F.greatest(F.lit(0), F.least(F.col("size"), F.col("rest") - F.col("upto") + F.col("size")))
    return joined.withColumn("taken", F.col("whole") * F.col("size") + extra).drop("group", "whole", "rest", "upto")


def mix(docs: DataFrame, **settings) -> DataFrame:
    """One row per document: doc_id, size, source_size, target, taken.

    Sizes are numbers of words, 0 for a null text. A null source is a source of
    its own and comes last. Documents without words take nothing. Rows are drawn
    by a hash of the seed, id, source and text, so reruns agree; repeated rows
    are drawn each, null ids too. Other columns are ignored.
    """
    rows = stored(sized(docs).withColumn("number", F.monotonically_increasing_id()), "sizes")
    return shares(rows, **settings).select("doc_id", "size", "source_size", "target", "taken")


def repeated(docs: DataFrame, **settings) -> DataFrame:
    """Every row of the documents, with all its columns, as often as the mix takes it; fractions round to the nearest."""
    rows = stored(sized(docs).withColumn("number", F.monotonically_increasing_id()), "sizes")
    copies = F.when(F.col("size") > 0, F.round(F.col("taken") / F.col("size"))).otherwise(0).cast("long")
    taken = shares(rows, **settings).withColumn("copies", copies).groupBy(F.col("row").alias("_row"), F.col("mark").alias("_mark"))
    # Rows are equal if all their columns are. Equal rows are drawn each but can't be told apart, so they share their copies out evenly.
    taken = taken.agg(F.sum("copies").alias("_copies"), F.count(F.lit(1)).alias("_rows"))
    keyed = docs.select("*", id_order().alias("_row"), row_mark(docs.columns).alias("_mark")).join(taken, ["_row", "_mark"])
    nth = F.row_number().over(Window.partitionBy("_row", "_mark").orderBy("_row"))
    own = F.expr("_copies div _rows") + (F.col("_nth") <= F.col("_copies") % F.col("_rows")).cast("int")
    counted = keyed.withColumn("_nth", nth).withColumn("_own", own).filter("_own > 0")
    return counted.withColumn("_copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("_own")))).select(*docs.columns)
