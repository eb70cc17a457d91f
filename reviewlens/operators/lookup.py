"""Join with a per-key table when a few keys may hold most of the rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Upper bound on the rows broadcast from a table too large to be broadcast whole.
FREQUENT_KEYS = 10_000
# A measured table up to this many bytes is broadcast whole.
BROADCAST_BYTES = 64 << 20
_ROW_BYTES = 64  # fixed-width columns and hash-table overhead per row


def attach_by_key(
    left: DataFrame, table: DataFrame, key: str, weight: str, broadcast_bytes: int = BROADCAST_BYTES
) -> DataFrame:
    """Inner join of ``left`` with ``table`` (one row per text key) that no hot key can stall.

    The table is measured. A small one is broadcast. Of a larger one only the keys holding more
    than 1/FREQUENT_KEYS of the total ``weight`` (at least proportional to the rows of ``left``
    per key) are broadcast: there are fewer than FREQUENT_KEYS of them, and their rows are never
    shuffled. All other keys are shuffled, and each is at most that fraction of the rows. Both
    halves together are the whole join.
    """
    row_bytes = F.octet_length(F.col(key).cast("string")) + _ROW_BYTES
    measured = table.agg(F.sum(row_bytes).alias("bytes"), F.sum(weight).alias("weight")).collect()[0]
    if (measured["bytes"] or 0) <= broadcast_bytes:
        return left.join(F.broadcast(table), key)
    frequent = F.col(weight) * FREQUENT_KEYS > F.lit(measured["weight"])
    hot = F.broadcast(table.filter(frequent))
    hot_keys = F.broadcast(table.filter(frequent).select(key))
    rare = table.filter(~frequent)
    return left.join(hot, key).unionByName(left.join(hot_keys, key, "left_anti").join(rare, key))
