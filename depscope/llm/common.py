"""What several of these operators share: words, free column names and ranks over many tasks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from depscope.scratch import materialize

# The six white-space characters \x20 and \x09-\x0D, and the pattern that splits at them.
SPACES = " \t\n\x0b\f\r"
SPLIT = r"[ \t-\r]+"


def words_of(text: Column) -> Column:
    """The words `[^\\x20\\x09-\\x0D]+` of a text; null and blank texts have none."""
    trimmed = F.btrim(F.coalesce(text, F.lit("")), F.lit(SPACES))
    return F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, SPLIT))


def fresh(df: DataFrame, *names: str) -> list[str]:
    """The names, each lengthened by underscores until the frame has no such column."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def ranked(df: DataFrame, groups: list[str], order: list[str], label: str, rank: str = "rank") -> DataFrame:
    """Add the row's number from 0 within its group, in the given order.

    No task sees a whole group: rows are dealt by ranges of (groups, order), sorted and
    written; the count of each (task, group) then gives where its rows begin. That table
    has at most one row per task and one per group more, so it may be broadcast as long as
    the number of groups is bounded by a setting (shards, buckets). `order` should tell
    rows apart; rows that are equal in it are numbered in any order.
    """
    part, at, first, count, start = fresh(df, "_part", "_at", "_first", "_count", "_start")
    keys = [F.col(c) for c in (*groups, *order)]
    dealt = (
        df.repartitionByRange(*keys).sortWithinPartitions(*keys)
        .withColumn(part, F.spark_partition_id())
        .withColumn(at, F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)))
    )
    stored = materialize(dealt, label)
    pieces = stored.groupBy(part, *groups).agg(F.min(at).alias(first), F.count(F.lit(1)).alias(count))
    before = F.sum(count).over(Window.partitionBy(*groups).orderBy(part).rowsBetween(Window.unboundedPreceding, -1))
    pieces = pieces.withColumn(start, F.coalesce(before, F.lit(0)) - F.col(first)).drop(first, count)
    # Names of their own on the small side: both sides stem from one table.
    own = {name: f"{start}{i}" for i, name in enumerate((part, *groups))}
    pieces = pieces.select(*[F.col(name).alias(other) for name, other in own.items()], start)
    same = F.lit(True)
    for name, other in own.items():
        same &= F.col(name).eqNullSafe(F.col(other))
    return stored.join(F.broadcast(pieces), same).select(*df.columns, (F.col(at) + F.col(start)).alias(rank))
