"""Keyed upsert and what guards it."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from millrace import schemas

_HERE, _NO_KEY, _OWN = "__here", "__no_key", "__own"

#: Values that a NULL key may take to spread its rows over the tasks; rows are marked, so that none of them matches.
_SPREAD = 30_000


def _any_null(keys: Sequence[str]) -> Column:
    return reduce(Column.__or__, [F.col(k).isNull() for k in keys])


def _placed(key: str, kind: T.DataType, columns: Sequence[str], unknown: Column) -> Column:
    """The key that decides the task of a row: of a row whose key holds a NULL any value, other types keep theirs."""
    spread = F.pmod(F.xxhash64(*columns), F.lit(_SPREAD)).cast("int")
    if isinstance(kind, T.DateType):
        spread = F.date_add(F.lit("1970-01-01").cast("date"), spread)
    elif not isinstance(kind, (T.StringType, T.IntegerType, T.LongType)):
        return F.col(key)
    return F.when(unknown, spread.cast(kind)).otherwise(F.col(key))


def upsert(
    target: DataFrame,
    source: DataFrame,
    keys: Sequence[str],
    kept: Sequence[str] = (),
    strict: bool = False,
) -> DataFrame:
    """The target after merging ``source`` into it, with the columns of ``target``.

    Matched rows take every source column, NULLs included, except the keys and ``kept``. Source rows without
    a match are inserted; target rows without one stay. Keys compare with ``=``: a NULL key never matches, so
    such source rows are inserted on every run. A second source row for one key would make an update depend
    on chance, so the job fails when it meets a match; without one both rows are inserted. With ``strict``
    it fails on any second row for a key.

    Each side is shuffled once, a target stored in buckets by the key not at all: the numbering that finds second rows uses
    the clustering and order of the join. The source is read once: its rows with a NULL key go through the join, marked
    so that they match nothing and spread over the tasks. Those of the target pass by the join, so where it can hold
    NULL keys the target is read twice, once for each part.
    The result reads the target: write it to another place than the one the target is read from.
    """
    columns = target.columns
    feed = source.select(*[c for c in columns if c in source.columns])
    given = [c for c in feed.columns if c not in keys]
    first = keys[0]
    hashed = [c for c in feed.columns if not isinstance(feed.schema[c].dataType, (T.MapType, T.VariantType))]
    src = feed.withColumns({_NO_KEY: _any_null(keys), _OWN: F.when(_any_null(keys), F.col(first))})
    src = src.withColumn(first, _placed(first, feed.schema[first].dataType, hashed, F.col(_NO_KEY)))
    src = src.withColumn(_HERE, F.row_number().over(Window.partitionBy(*keys).orderBy(*keys, _NO_KEY)))  # marked rows count last
    src = src.select(*[F.col(c).alias(f"s_{c}") for c in (*keys, *given, _HERE, _NO_KEY, _OWN)])
    tgt = target.where(~_any_null(keys)).withColumn(_HERE, F.lit(True))
    tgt = tgt.select(*[F.col(c).alias(f"t_{c}") for c in (*columns, _HERE)])

    match = reduce(Column.__and__, [F.col(f"t_{k}") == F.col(f"s_{k}") for k in keys])
    no_key = F.col("s_" + _NO_KEY)
    joined = tgt.join(src, match & ~no_key, "full_outer")
    in_source, in_target = F.col("s_" + _HERE).isNotNull(), F.col("t_" + _HERE).isNotNull()
    clash = ~no_key & (F.col("s_" + _HERE) > 1) & (F.lit(strict) | in_target)
    shown = F.to_json(F.struct(*[F.col(f"s_{k}").alias(k) for k in keys]))
    refuse = F.raise_error(F.concat(F.lit("more than one source row for key "), shown))

    def merged(c: str) -> Column:
        kind = target.schema[c].dataType
        if c in keys:
            given_key = F.when(no_key, F.col("s_" + _OWN)).otherwise(F.col(f"s_{c}")) if c == first else F.col(f"s_{c}")
            value = F.when(in_target, F.col(f"t_{c}")).otherwise(given_key)
            value = F.when(clash, refuse.cast(kind)).otherwise(value) if c == first else value
        elif c not in given:
            value = F.col(f"t_{c}")
        elif c in kept:
            value = F.when(in_target, F.col(f"t_{c}")).otherwise(F.col(f"s_{c}"))
        else:
            value = F.when(in_source, F.col(f"s_{c}")).otherwise(F.col(f"t_{c}"))
        return value.cast(kind).alias(c)

    kept_rows = target.where(_any_null(keys)).select(*[F.col(c).cast(target.schema[c].dataType).alias(c) for c in columns])
    return joined.select(*[merged(c) for c in columns]).unionByName(kept_rows)


def upsert_curated(target: DataFrame, source: DataFrame, table: str) -> DataFrame:
    """``upsert`` with the key and the kept columns of a curated table."""
    return upsert(
        schemas.conform(target, table),
        schemas.conform(source, table),
        schemas.KEYS[table],
        schemas.KEPT_ON_UPDATE.get(table, ()),
    )


def clashing_keys(source: DataFrame, keys: Sequence[str], sample: int = 10) -> list:
    """Up to ``sample`` keys with several source rows, to look at when ``upsert`` refused one."""
    counted = source.where(~_any_null(keys)).groupBy(*keys).agg(F.count("*").alias("rows"))
    return counted.where("rows > 1").limit(sample).collect()
