"""Ordered computations within keys, in blocks.

A window over a key runs in one task, however many rows the key has.  Here each
key's rows are cut into blocks of the order column; a window looks at one block,
and what it needs from before comes from one summary row per block.  A key with
a third of all rows is then spread over as many tasks as it has blocks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Order positions per block, for orders that count rows.
WIDTH = 1 << 20
#: Rows that a block should have where its width follows the data.
ROWS = 1 << 18


def spread(df: DataFrame, order: str, rows: int = ROWS) -> float:
    """A width that gives blocks of about so many rows, for orders with gaps (timestamps, hashes): from one pass over the column."""
    least, most, n = df.agg(F.min(order), F.max(order), F.count("*")).first()
    return max(1.0, float(most - least + 1) * rows / n) if n and least is not None else 1.0


def numbered(df: DataFrame, keys: list[str], block: Column, order: list, out: str) -> DataFrame:
    """df with ``out``: 1, 2, ... within the keys (of all rows, without keys) by ``block``, then by ``order``.

    Blocks are counted first, so only the rows of one block of a key meet in a task.
    """
    df = df.withColumn("_block", block)
    counts = df.groupBy(*keys, "_block").agg(F.count("*").alias("_n"))
    before = Window.partitionBy(*keys).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")
    inside = Window.partitionBy(*keys, "_block").orderBy(*order)
    return _joined(df.withColumn(out, F.row_number().over(inside)), counts, keys).withColumn(out, F.col("_before") + F.col(out)).drop("_block", "_before")


def _blocks(df: DataFrame, order: str, width: float | None) -> DataFrame:
    width = spread(df, order) if width is None else width
    return df.withColumn("_block", F.floor(F.col(order) / F.lit(width)))


def _joined(df: DataFrame, blocks: DataFrame, keys: list[str]) -> DataFrame:
    on = [df[c].eqNullSafe(blocks[c]) for c in [*keys, "_block"]]
    condition = on[0]
    for x in on[1:]:
        condition &= x
    return df.join(blocks, condition, "left").drop(*[blocks[c] for c in [*keys, "_block"]])


def previous(df: DataFrame, keys: list[str], order: str, columns: list[str], out: str, width: float | None = WIDTH) -> DataFrame:
    """df with ``out``: a struct of ``columns`` of the row before, null for the first row of a key.

    ``order`` must be unique within the keys, else which of equals comes first is open.
    A width of None follows the data.
    """
    df = _blocks(df, order, width)
    row = F.struct(*columns)
    last = df.groupBy(*keys, "_block").agg(F.max_by(row, order).alias("_last"))
    last = last.withColumn("_before", F.lag("_last").over(Window.partitionBy(*keys).orderBy("_block"))).drop("_last")
    inside = Window.partitionBy(*keys, "_block").orderBy(order)
    return _joined(df.withColumn(out, F.lag(row).over(inside)), last, keys).withColumn(out, F.coalesce(out, "_before")).drop("_block", "_before")


def running(df: DataFrame, keys: list[str], order: str, value: Column, out: str, how: str = "max", inclusive: bool = False, width: float | None = WIDTH) -> DataFrame:
    """df with ``out``: max or sum of value over the key's earlier rows (and this one, if ``inclusive``)."""
    agg, join = {"max": (F.max, lambda a, b: F.greatest(a, b)), "sum": (F.sum, lambda a, b: F.coalesce(a + b, a, b))}[how]
    df = _blocks(df.withColumn("_value", value), order, width)
    whole = df.groupBy(*keys, "_block").agg(agg("_value").alias("_whole"))
    before = Window.partitionBy(*keys).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    whole = whole.withColumn("_before", agg("_whole").over(before)).drop("_whole")
    inside = Window.partitionBy(*keys, "_block").orderBy(order).rowsBetween(Window.unboundedPreceding, 0 if inclusive else -1)
    return _joined(df.withColumn(out, agg("_value").over(inside)), whole, keys).withColumn(out, join(F.col("_before"), F.col(out))).drop("_block", "_before", "_value")
