"""Connected components of a link table by alternating stars."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from railwatch.session import stored

# Rows of a round for one task; with few rows, many tasks would leave little but empty blocks and small files.
TASK_ROWS = 50_000


def _large_star(links: DataFrame, group: Sequence[str]) -> DataFrame:
    """Tie every larger neighbour of a node to the smallest node around it; one row for each link."""
    turned = links.select(*group, F.col("to").alias("node"), F.col("node").alias("to"))
    both = links.unionByName(turned)
    least = both.groupBy(*group, "node").agg(F.least(F.min("to"), F.col("node")).alias("least"))
    tied = both.filter("to > node").join(least, [*group, "node"])
    return tied.select(*group, F.col("to").alias("node"), F.col("least").alias("to"))


def _small_star(links: DataFrame, group: Sequence[str], tasks: int) -> DataFrame:
    """Tie a node and its smaller neighbours to the smallest of them."""
    down = links.select(*group, F.greatest("node", "to").alias("node"), F.least("node", "to").alias("to")).coalesce(tasks)
    least = down.groupBy(*group, "node").agg(F.min("to").alias("least"))
    moved = down.join(least, [*group, "node"]).filter("to <> least")
    moved = moved.select(*group, F.col("to").alias("node"), F.col("least").alias("to"))
    return moved.unionByName(least.select(*group, "node", F.col("least").alias("to"))).coalesce(tasks).distinct()


def _stars(links: DataFrame, group: Sequence[str], tasks: int) -> bool:
    """Whether every node is tied to one other, which is tied to none: no round would change that."""
    ends = links.select(*group, "node", F.lit(1).alias("ties"), F.lit(False).alias("tied_to"))
    ends = ends.unionByName(links.select(*group, F.col("to").alias("node"), F.lit(0).alias("ties"), F.lit(True).alias("tied_to")))
    ends = ends.coalesce(tasks).groupBy(*group, "node").agg(F.sum("ties").alias("ties"), F.max("tied_to").alias("tied_to"))
    odd = (F.col("ties") > 1) | ((F.col("ties") > 0) & F.col("tied_to"))
    return ends.agg(F.coalesce(F.max(odd), F.lit(False))).first()[0] is False


def roots(links: DataFrame, group: Sequence[str] = ()) -> DataFrame:
    """(group, node, root) for every node of ``links(group, node, to)`` that is not its component's smallest.

    Each round is written to the shared folder, so the plan stays short; the
    rounds grow with the logarithm of the longest chain.
    """
    links = stored(links.select(*group, "node", "to").filter("node <> to").distinct(), "links")
    tasks = max(1, -(-links.count() // TASK_ROWS))  # no round adds links
    over = False
    while not over:
        links = stored(_small_star(_large_star(links, group), group, tasks).coalesce(tasks), "links")
        over = _stars(links, group, tasks)
    return links.withColumnRenamed("to", "root")
