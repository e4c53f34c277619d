"""Running values over long ordered groups without one task per group.

A plain ``Window.partitionBy(key).orderBy(...)`` sorts a whole key in one
task.  One document, client or day may hold a third of all rows, so the
running helpers here cut each key into blocks along the order column: a first
aggregate gives one total per (key, block), a window over those few totals
gives what each block carries in, and the per-row window only runs inside a
block.  The block must not decrease along the order.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

LINES_PER_BLOCK = 20_000
# Short rows that one task sorts or counts by hash; a fixed number of partitions
# would give it a share of the input instead.
ROWS_PER_TASK = 500_000


def task_parts(stored: DataFrame) -> int | None:
    """Partitions that hold about ``ROWS_PER_TASK`` rows of ``stored`` or fewer each; None where one does.

    The count reads no more than file footers if ``stored`` is a table as it lies.
    """
    n = stored.count()
    return None if n <= ROWS_PER_TASK else max(stored.sparkSession.sparkContext.defaultParallelism, -(-n // ROWS_PER_TASK))


def dealt(df: DataFrame, parts: int | None, *keys: str) -> DataFrame:
    """Rows dealt out by ``keys``; without ``parts`` small partitions may be joined."""
    return df.repartition(parts, *keys) if parts else df.repartition(*keys)


def line_block(col: str = "line_no", size: int = LINES_PER_BLOCK) -> Column:
    return F.floor(F.col(col) / F.lit(size))


def running(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    block: Column,
    measures: dict[str, tuple[str, Column, bool]],
    reverse: bool = False,
    parts: int | None = None,
) -> DataFrame:
    """Add running measures over ``order`` within ``keys``.

    ``measures`` maps an output name to ``(kind, value, inclusive)`` where kind
    is ``sum``, ``max`` or ``last`` (last non-null) and ``inclusive`` says
    whether the current row counts.  ``reverse`` walks from the end.  Sums and
    maxima of numbers combine by hash ahead of the shuffle, so the maximum of a
    line number is a cheaper "last marked line" than ``last``.  ``parts`` is the
    number of partitions the rows are sorted in.
    """
    keys, order = list(keys), list(order)
    base = df.withColumn("__block", block)
    for name, (_, value, _) in measures.items():
        base = base.withColumn(f"__v_{name}", value)

    position = F.struct(*order)
    pick = F.min_by if reverse else F.max_by
    totals = []
    for name, (kind, _, _) in measures.items():
        value = F.col(f"__v_{name}")
        if kind == "sum":
            total = F.sum(value)
        elif kind == "max":
            total = F.max(value)
        elif kind == "last":
            total = pick(value, F.when(value.isNotNull(), position))
        else:
            raise ValueError(f"unknown running measure {kind!r}")
        totals.append(total.alias(f"__t_{name}"))
    direction = F.desc if reverse else F.asc
    carried = Window.partitionBy(*keys).orderBy(direction("__block")).rowsBetween(Window.unboundedPreceding, -1)
    carry = base.groupBy(*keys, "__block").agg(*totals)
    carry = carry.select(
        *keys,
        "__block",
        *[_over(kind, F.col(f"__t_{name}"), carried).alias(f"__c_{name}") for name, (kind, _, _) in measures.items()],
    )

    # The window stands ahead of the join: its order holds for the join as well, so rows are sorted once.
    within = Window.partitionBy(*keys, "__block").orderBy(*[direction(c) for c in order])
    inside = []
    for name, (kind, _, inclusive) in measures.items():
        frame = within.rowsBetween(Window.unboundedPreceding, 0 if inclusive else -1)
        inside.append(_over(kind, F.col(f"__v_{name}"), frame).alias(f"__h_{name}"))
    rows = dealt(base, parts, *keys, "__block") if parts else base
    out = rows.select(*df.columns, "__block", *inside).join(carry, keys + ["__block"])
    columns = []
    for name, (kind, _, _) in measures.items():
        here, before = F.col(f"__h_{name}"), F.col(f"__c_{name}")
        if kind == "sum":
            value = F.coalesce(here, F.lit(0)) + F.coalesce(before, F.lit(0))
        elif kind == "max":
            value = F.greatest(here, before)
        else:
            value = F.coalesce(here, before)
        columns.append(value.alias(name))
    return out.select(*df.columns, *columns)


def neighbours(df: DataFrame, keys: Sequence[str], order: str, block: Column, values: dict[str, tuple[str, str]]) -> DataFrame:
    """Add values of the row before or after in ``order`` within ``keys``, null at the ends.

    ``values`` maps an output name to ``("previous" or "next", column)``; the
    columns are never null.  All of them come from one pass over the rows, cut
    into blocks as in ``running``: only the edge rows of a block look at others.
    """
    keys = list(keys)
    base = df.withColumn("__block", block)
    edges = {name: (F.max_by if side == "previous" else F.min_by)(F.col(c), F.col(order)).alias(f"__e_{name}") for name, (side, c) in values.items()}
    blocks = Window.partitionBy(*keys).orderBy("__block")
    within = Window.partitionBy(*keys, "__block").orderBy(order)
    step = lambda side, c, window: (F.lag if side == "previous" else F.lead)(c).over(window)
    carry = base.groupBy(*keys, "__block").agg(*edges.values())
    carry = carry.select(*keys, "__block", *[step(side, f"__e_{name}", blocks).alias(f"__c_{name}") for name, (side, _) in values.items()])
    inside = [step(side, c, within).alias(f"__h_{name}") for name, (side, c) in values.items()]
    out = base.select(*df.columns, "__block", *inside).join(carry, keys + ["__block"])
    return out.select(*df.columns, *[F.coalesce(f"__h_{name}", f"__c_{name}").alias(name) for name in values])


def _over(kind: str, value: Column, window) -> Column:
    if kind == "sum":
        return F.sum(value).over(window)
    if kind == "max":
        return F.max(value).over(window)
    return F.last(value, ignorenulls=True).over(window)


def numbered(df: DataFrame, keys: Sequence[str], order: Sequence[str], block: Column, name: str, parts: int | None = None) -> DataFrame:
    """Row number within ``keys`` over ``order``, from 1."""
    return running(df, keys, order, block, {name: ("sum", F.lit(1).cast("bigint"), True)}, parts=parts)
