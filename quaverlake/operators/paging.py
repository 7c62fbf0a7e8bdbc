"""Pages by the last key of the page before: rows beyond a key are found by a condition, so no page sorts or skips those of earlier pages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: An order is columns with whether they fall.
Order = list[tuple[Column, bool]]


def beyond(order: Order, after: tuple) -> Column:
    """Whether a row stands after the key `after`, one value for each column of the order. Nulls come first where values rise and last where they fall, as Spark sorts them."""
    out = F.lit(False)
    for (column, falls), value in reversed(list(zip(order, after, strict=True))):
        value = F.lit(value)
        later = (F.coalesce(column < value, F.lit(False)) | column.isNull() & value.isNotNull()) if falls else (F.coalesce(column > value, F.lit(False)) | column.isNotNull() & value.isNull())
        out = later | column.eqNullSafe(value) & out
    return out


def page_after(rows: DataFrame, order: Order, after: tuple | None, limit: int) -> DataFrame:
    """The first `limit` rows beyond `after`, or of all rows. The order should end with a key that no two rows share."""
    rows = rows if after is None else rows.where(beyond(order, after))
    return rows.orderBy(*[c.desc() if falls else c.asc() for c, falls in order]).limit(limit)
