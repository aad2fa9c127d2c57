"""Global order within keys of any size: running numbers and values at given ranks.

Rows are dealt to parts by ranges of (key, order) and sorted within a part, so a key may lie in many parts, of which each is one task's work. A row's number is its place in its part, less the place at which its key begins there, plus the key's
rows in the parts before. For that only counts by key and part are grouped; no window's partition grows with a key but by the number of its parts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarryline.sources.tables import stored


def numbered(rows: DataFrame, key: list[str], order: list[str], parts: int | None = None) -> DataFrame:
    """The rows in a struct `row`, and `index`: their number from 0 within their key, in ascending order (nulls first). Rows that tie in all of order get the numbers between them in some order.

    parts: as many as shuffle partitions if not given. The sorted rows are written once, so that places stay what they are.
    """
    parts = parts or int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    own = rows.select(F.struct(*[F.col(f"`{c}`") for c in rows.columns]).alias("row"), F.struct(*[F.col(f"`{c}`") for c in key]).alias("key"), F.struct(*[F.col(f"`{c}`") for c in order]).alias("by"))
    sorted_ = stored(own.repartitionByRange(parts, "key", "by").sortWithinPartitions("key", "by").select("row", "key", F.monotonically_increasing_id().alias("place")), "ordered")
    # Spark's number holds the part in its upper and the place in its lower 33 bits
    placed = sorted_.select("row", "key", F.shiftright("place", 33).alias("part"), F.col("place").bitwiseAND((1 << 33) - 1).alias("place"))
    runs = placed.groupBy("key", "part").agg(F.min("place").alias("first"), F.count(F.lit(1)).alias("n"))
    before = (F.sum("n").over(Window.partitionBy("key").orderBy("part")) - F.col("n") - F.col("first")).alias("shift")
    shifts = runs.select(F.col("key").alias("of"), F.col("part").alias("in_part"), before)
    return placed.join(shifts, (F.col("part") == F.col("in_part")) & F.col("key").eqNullSafe(F.col("of"))).select("row", (F.col("place") + F.col("shift")).alias("index"))


def at_shares(values: DataFrame, shares: dict[str, float]) -> DataFrame:
    """Per label the values at place floor(n * share) in ascending order, not interpolated: values (label, value); null values don't count."""
    own = numbered(values.where("value IS NOT NULL").select("label", "value"), ["label"], ["value"]).select("row.*", "index")
    sizes = values.where("value IS NOT NULL").groupBy(F.col("label").alias("of")).agg(F.count(F.lit(1)).alias("n"))
    place = lambda p: F.floor(F.col("n") * p)
    wanted: Column = F.lit(False)
    for p in shares.values():
        wanted = wanted | (F.col("index") == place(p))
    found = own.join(sizes, F.col("label").eqNullSafe(F.col("of"))).where(wanted)
    return found.groupBy("label").agg(*[F.max(F.when(F.col("index") == place(p), F.col("value"))).alias(name) for name, p in shares.items()])
