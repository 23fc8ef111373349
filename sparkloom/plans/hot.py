"""Joins back from a grouped table that stay even when one group holds a large part of the rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

#: Groups of at least this many rows are joined by broadcast; there are at most rows / HOT_ROWS of them.
HOT_ROWS = 200_000
#: Beyond this many hot groups the broadcast is given up (about 50 MB); AQE then splits the partitions.
HOT_GROUPS = 500_000


def join_groups(rows: DataFrame, groups: DataFrame, keys: list[str], size: str, how: str = "inner") -> DataFrame:
    """rows JOIN groups ON keys (inner or left). groups: materialised, one row per key, with the number of rows in column ``size``. The result is the same either way."""
    hot = groups.where(F.col(size) >= HOT_ROWS)
    n = hot.limit(HOT_GROUPS + 1).count()
    if n == 0 or n > HOT_GROUPS:
        return rows.join(groups, keys, how)
    cold = groups.where(F.col(size) < HOT_ROWS)
    few = F.broadcast(hot.select(*keys))
    return rows.join(F.broadcast(hot), keys).unionByName(rows.join(few, keys, "left_anti").join(cold, keys, how))
