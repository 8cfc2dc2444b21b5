"""Ordered per-entity sequences that stay balanced when one entity is huge.

A window partitioned by entity puts a whole entity into one task, and adaptive
execution does not split window partitions.  ``EntitySequence`` finds *heavy*
entities (more than ``hot_rows`` events) with one aggregation over the
entity column, or takes a list from the caller.  Without any, the plan is the
plain window.  Rows of heavy entities are range-partitioned by entity and the
full order key, so the splitters come from a sample of the key itself, and
sorted; each run of ``rows_per_bucket`` sorted rows of a partition becomes a
bucket: windows run on ``(entity, bucket)``.  There are as many partitions as
the rows ask for at the default bucket, however small the buckets are.  The
few facts that cross a bucket border (rows before it, the entity's first row,
the first rows after it, entity totals) come from a table with one row for
each bucket.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..schema import ORDER_COLUMNS, TIE_COLUMNS
from ..session import default_parallelism, stored

DEFAULT_HOT_ROWS = 2_000_000
DEFAULT_ROWS_PER_BUCKET = 500_000
#: Range partitions of heavy entities for each core, where buckets are smaller.
PARTITIONS_PER_CORE = 2
#: Heavy entities that are told apart by a list of literals; more by a join.
LISTED_ENTITIES = 1_000


def heavy_counts(df: DataFrame, entity: str = "entity", hot_rows: int = DEFAULT_HOT_ROWS) -> DataFrame:
    """(entity, rows) of entities with more than ``hot_rows`` rows, exactly: one
    aggregation over the entity column, in which a hot entity is one row for
    each task.  At most one row for each ``hot_rows`` rows comes out."""
    counts = df.where(F.col(entity).isNotNull()).groupBy(entity).agg(F.count(F.lit(1)).alias("rows"))
    return counts.where(F.col("rows") > hot_rows)


def heavy_entities(df: DataFrame, entity: str = "entity", hot_rows: int = DEFAULT_HOT_ROWS) -> list[tuple[str, int]]:
    """The same as a list, which ends one past ``LISTED_ENTITIES``."""
    return [tuple(r) for r in heavy_counts(df, entity, hot_rows).limit(LISTED_ENTITIES + 1).collect()]


class EntitySequence:
    """Row index, size, first row and look-ahead within each entity."""

    def __init__(
        self,
        df: DataFrame,
        entity: str = "entity",
        order: list[str] | None = None,
        time_col: str = "time",
        hot_rows: int | None = DEFAULT_HOT_ROWS,
        rows_per_bucket: int = DEFAULT_ROWS_PER_BUCKET,
        heavy: list[tuple[str, int]] | None = None,
    ):
        self.entity = entity
        self.order = list(order or [*ORDER_COLUMNS, *(c for c in TIE_COLUMNS if c in df.columns)])
        self.time_col = time_col
        self.plain, self.buckets = df, None
        given = heavy is not None or hot_rows is None
        if not given:
            heavy = heavy_entities(df, entity, hot_rows)
        if heavy:
            if given or len(heavy) <= LISTED_ENTITIES:
                is_heavy = F.coalesce(F.col(entity).isin([e for e, _ in heavy]), F.lit(False))
                hot, self.plain = df.where(is_heavy), df.where(~is_heavy)
                rows, entities = sum(n for _, n in heavy), len(heavy)
            else:  # a table of known size, which the planner broadcasts if it is small
                found = stored(heavy_counts(df, entity, hot_rows))
                rows, entities = found.agg(F.sum("rows"), F.count("*")).first()
                keys = found.select(F.col(entity).alias("_heavy"))
                hot = df.join(keys, F.col(entity) == F.col("_heavy"), "left_semi")
                self.plain = df.join(keys, F.col(entity) == F.col("_heavy"), "left_anti")
            buckets = math.ceil(rows / rows_per_bucket) + entities
            few = max(math.ceil(rows / DEFAULT_ROWS_PER_BUCKET) + entities, PARTITIONS_PER_CORE * default_parallelism(df.sparkSession))
            hot = hot.repartitionByRange(min(buckets, few), F.col(entity), *self._order())
            if buckets > few:  # rows numbered in their order, the partition in the upper bits
                hot = hot.sortWithinPartitions(F.col(entity), *self._order())
                place = F.floor(F.monotonically_increasing_id() / rows_per_bucket)
            else:
                place = F.spark_partition_id()
            # stored, so that every use sees the same buckets
            self.buckets = stored(hot.withColumn("_b", place.cast("long")))

    def _order(self) -> list[Column]:
        return [F.col(c).asc_nulls_last() if c == self.time_col else F.col(c).asc_nulls_first() for c in self.order]

    def _windowed(self, df: DataFrame, keys: list[str], first: list[str], ahead: dict[str, int], counts: dict[str, Column]) -> DataFrame:
        w = Window.partitionBy(*keys).orderBy(*self._order())
        whole = Window.partitionBy(*keys)
        cols: dict[str, Column] = {"e": (F.row_number().over(w) - 1).cast("long"), "n": F.count(F.lit(1)).over(whole)}
        for c in first:
            cols[f"first_{c}"] = F.first(F.col(c)).over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow))
        for c, k in ahead.items():
            for j in range(1, k + 1):
                cols[f"next{j}_{c}"] = F.lead(F.col(c), j).over(w)
        for name, cond in counts.items():
            cols[name] = F.sum(F.when(cond, 1).otherwise(0)).over(whole).cast("long")
        return df.withColumns(cols)

    def annotate(
        self,
        first: list[str] | tuple = (),
        ahead: dict[str, int] | None = None,
        counts: dict[str, Column] | None = None,
    ) -> DataFrame:
        """Add ``e`` (0-based index), ``n`` (entity size), ``first_<c>``,
        ``next<j>_<c>`` (value j rows ahead) and entity-level conditional counts."""
        first, ahead, counts = list(first), dict(ahead or {}), dict(counts or {})
        plain = self._windowed(self.plain, [self.entity], first, ahead, counts)
        if self.buckets is None:
            return plain
        x = self._windowed(self.buckets, [self.entity, "_b"], first, ahead, counts)
        # both sides are partitioned by (entity, bucket): only the table moves
        x = x.join(self._bucket_table(first, ahead, counts), [self.entity, "_b"])
        out = {"e": F.col("e") + F.col("_before"), "n": F.col("_n")}
        for c in first:
            out[f"first_{c}"] = F.col("_first")[c]
        for c, k in ahead.items():
            for j in range(1, k + 1):
                beyond = F.get(F.col("_after"), (F.col("e") + j - F.col("n")).cast("int"))[c]
                out[f"next{j}_{c}"] = F.when(F.col("e") + j >= F.col("n"), beyond).otherwise(F.col(f"next{j}_{c}"))
        for name in counts:
            out[name] = F.col(f"_all_{name}")
        return plain.unionByName(x.withColumns(out).select(*plain.columns))

    def _bucket_table(self, first: list[str], ahead: dict[str, int], counts: dict[str, Column]) -> DataFrame:
        """One row for each bucket: rows before it, and for its entity the
        total, the first row, and the first rows after the bucket."""
        ent, k = self.entity, max(ahead.values(), default=0)
        values = F.struct(*[F.col(c) for c in dict.fromkeys([*first, *ahead, self.order[0]])])
        by_bucket = Window.partitionBy(ent, "_b").orderBy(*self._order())
        # the first rows by row number, so that equal order keys all count
        heads = (
            self.buckets.withColumn("_rn", F.row_number().over(by_bucket))
            .where(F.col("_rn") <= max(k, 1))
            .groupBy(ent, "_b")
            .agg(F.sort_array(F.collect_list(F.struct("_rn", values.alias("v")))).alias("_heads"))
        )
        sizes = self.buckets.groupBy(ent, "_b").agg(
            F.count(F.lit(1)).alias("_c"), *[F.sum(F.when(cond, 1).otherwise(0)).cast("long").alias(f"_c_{n}") for n, cond in counts.items()]
        )
        table = sizes.join(heads, [ent, "_b"]).withColumn("_heads", F.transform("_heads", lambda h: h["v"]))
        in_order = Window.partitionBy(ent).orderBy("_b")
        whole = Window.partitionBy(ent)
        # every bucket has a row, so the next k buckets hold the next k rows
        after = [F.coalesce(F.lead("_heads", j).over(in_order), F.slice("_heads", 1, 0)) for j in range(1, k + 1)]
        return table.select(
            ent,
            "_b",
            F.coalesce(F.sum("_c").over(in_order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"),
            F.sum("_c").over(whole).alias("_n"),
            F.first("_heads").over(in_order.rowsBetween(Window.unboundedPreceding, Window.currentRow))[0].alias("_first"),
            (F.concat(*after) if after else F.slice("_heads", 1, 0)).alias("_after"),
            *[F.sum(f"_c_{n}").over(whole).alias(f"_all_{n}") for n in counts],
        )
