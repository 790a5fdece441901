"""The lazy frame: relational operators over a Spark DataFrame. Nothing runs before collect or a write."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.functions import as_column
from lodestone.plans import explained
from lodestone.types import DFSchema

# fixed values: names of join types
JOINS = {"inner": "inner", "left": "left_outer", "right": "right_outer", "full": "full_outer", "semi": "left_semi", "anti": "left_anti"}


@dataclass(frozen=True)
class Partitioning:
    """How repartition deals rows out: by the hash of columns, in turn, or in no order that could be relied on."""

    n: int
    columns: tuple = ()
    ordered: bool = True

    @staticmethod
    def hash(n: int, *columns) -> Partitioning:
        if not columns:
            raise ValueError("hash partitioning needs a column")
        return Partitioning(n, columns)

    @staticmethod
    def round_robin(n: int) -> Partitioning:
        return Partitioning(n)

    @staticmethod
    def unknown(n: int) -> Partitioning:
        return Partitioning(n, (), False)


class EngineFrame:
    """A query that is yet to run."""

    def __init__(self, df: DataFrame):
        self.df = df

    def select_columns(self, *names: str) -> EngineFrame:
        return EngineFrame(self.df.select(*names))

    def select(self, *columns: Column) -> EngineFrame:
        return EngineFrame(self.df.select(*columns))

    def filter(self, *conditions) -> EngineFrame:
        """All of the conditions hold."""
        df = self.df
        for c in conditions:
            df = df.filter(as_column(c))
        return EngineFrame(df)

    def aggregate(self, groups, aggregates) -> EngineFrame:
        """Without groups: one row over all."""
        listed = lambda x: list(x) if isinstance(x, (list, tuple)) else [x]
        return EngineFrame(self.df.groupBy(*listed(groups)).agg(*listed(aggregates)))

    def sort(self, *columns) -> EngineFrame:
        return EngineFrame(self.df.orderBy(*columns))

    def limit(self, n: int) -> EngineFrame:
        return EngineFrame(self.df.limit(n))

    def join(self, right: EngineFrame, left_cols: list[str], right_cols: list[str], join_type: str = "inner") -> EngineFrame:
        """Equality of columns, pair by pair; the planner picks the strategy by size."""
        if join_type not in JOINS:
            raise ValueError(f"no join type is named {join_type!r}; there are {', '.join(JOINS)}")
        if len(left_cols) != len(right_cols) or not left_cols:
            raise ValueError("a join needs as many columns on the left as on the right, one at least")
        pairs = [self.df[a] == right.df[b] for a, b in zip(left_cols, right_cols, strict=True)]
        on = pairs[0]
        for p in pairs[1:]:
            on = on & p
        return EngineFrame(self.df.join(right.df, on, JOINS[join_type]))

    def not_in(self, column: str, other: EngineFrame, other_column: str) -> EngineFrame:
        """Rows whose column is NOT IN the other's, nulls as SQL has them: a null there leaves nothing, a null here stays only if the other is empty.

        The keys are joined as distinct values, and what nulls decide is one row of counts; Spark's own plan for NOT IN would broadcast the other side at any size."""
        keys = other.df.select(F.col(other_column).alias("_key"))
        counted = lambda c: keys.agg(F.count(c)).scalar()
        kept = self.df.join(keys.where("_key IS NOT NULL").distinct(), self.df[column] == F.col("_key"), "left_anti")
        nulls, rows = counted(F.when(F.col("_key").isNull(), 1)), counted(F.lit(1))
        return EngineFrame(kept.where((nulls == 0) & (self.df[column].isNotNull() | (rows == 0))))

    def repartition(self, to: Partitioning) -> EngineFrame:
        if not to.ordered and to.n < self.df.rdd.getNumPartitions():
            return EngineFrame(self.df.coalesce(to.n))  # nothing need move where partitions may be put together
        return EngineFrame(self.df.repartition(to.n, *to.columns))

    def merge(self) -> EngineFrame:
        """All rows in one partition, after the work on them was done in as many as before: for small results only."""
        return EngineFrame(self.df.repartition(1))

    def schema(self, qualifier: str | None = None) -> DFSchema:
        """Qualified fields; Spark's own schema is that of ``df``."""
        return DFSchema.of(self.df.schema, qualifier)

    def to_logical_plan(self) -> str:
        return explained(self.df)["logical"]

    def explain(self, verbose: bool = False) -> EngineFrame:
        """(plan_type, plan): the physical plan, with verbose the logical ones too."""
        plans = explained(self.df)
        kinds = ("parsed", "logical", "physical") if verbose else ("physical",)
        return EngineFrame(self.df.sparkSession.createDataFrame([(k, plans[k]) for k in kinds], "plan_type string, plan string"))

    def collect(self) -> list[pa.RecordBatch]:
        return self.df.toArrow().to_batches()

    def stream(self, rows: int = 10_000) -> Iterator[pa.RecordBatch]:
        """The result batch by batch; the driver holds one partition at a time."""
        schema, held = pa.schema(self.df.limit(0).toArrow().schema), []
        for row in self.df.toLocalIterator(prefetchPartitions=True):
            held.append(row.asDict())
            if len(held) == rows:
                yield pa.RecordBatch.from_pylist(held, schema)
                held = []
        if held:
            yield pa.RecordBatch.from_pylist(held, schema)
