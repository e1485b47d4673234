"""Stored dotted suffixes of names: callers and callees by ranges of a sorted table.

`x ILIKE '%.' || name` holds if what follows some dot of x matches the name. So every value of
the column is stored once for each such tail, and once for its whole self, sorted by the tail in
lower case and cut into ranges; references themselves are stored once, each task's sorted by the
value. A name without wildcards is then an equality: one range's folder, in it the row groups of
the tail, and of each file of references the row groups of the values found. A name with `_` or
`%`, which LIKE takes for wildcards, reads the ranges of what stands before the first of them.
What is read is checked by the condition itself.
"""

from __future__ import annotations

import re

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from srcatlas.operators.lookup import REF, named

COLUMNS = "project string, file string, name string, kind string, line_start int, line_end int, caller string"
SCHEMA = "tail string, size int, value string, part int"
#: So many values found are named to the scan of references, which skips row groups without them.
NAMED = 1000


class SuffixIndex:
    """References by the dotted tails of one column: `name` for callers, `caller` for callees."""

    def __init__(self, spark: SparkSession, path: str, column: str = "name") -> None:
        self.spark, self.path, self.column = spark, path.rstrip("/"), column

    def build(self, refs: DataFrame) -> None:
        """Write all references; those without a value in the column match nothing and are left out."""
        kept = refs.select(*REF).filter(F.col(self.column).isNotNull())
        kept.sortWithinPartitions(self.column).write.mode("overwrite").parquet(f"{self.path}/refs")
        values = self._refs().select(F.col(self.column).alias("value")).distinct().withColumn("__parts", F.split(F.lower("value"), r"\."))
        tails = F.transform(F.sequence(F.lit(1), F.size("__parts")), lambda i: F.array_join(F.slice("__parts", i, F.size("__parts")), "."))
        spread = values.select(F.explode(tails).alias("tail"), "value").withColumn("size", F.length("tail"))
        ranged = spread.repartitionByRange("tail", "value").withColumn("part", F.spark_partition_id()).sortWithinPartitions("part", "tail", "value")
        names = [c.split()[0] for c in SCHEMA.split(", ")]
        ranged.select(*names).write.mode("overwrite").partitionBy("part").parquet(f"{self.path}/tails")
        bounds = self.spark.read.schema(SCHEMA).parquet(f"{self.path}/tails").groupBy("part").agg(F.min("tail").alias("low"), F.max("tail").alias("high"))
        bounds.coalesce(1).write.mode("overwrite").parquet(f"{self.path}/bounds")

    def _refs(self) -> DataFrame:
        return self.spark.read.schema(COLUMNS).parquet(f"{self.path}/refs")

    def find(self, name: str) -> DataFrame:
        """References whose column is the name, or a dotted name that ends in it by the rules of LIKE."""
        low = name.lower()
        prefix = re.split("[%_]", low)[0]
        literal = prefix == low
        try:
            bounds = self.spark.read.parquet(f"{self.path}/bounds").collect()  # one row for each range
        except AnalysisException:  # nothing has been written
            bounds = []
        held = [b.part for b in bounds if (b.low <= low <= b.high if literal else b.low[: len(prefix)] <= prefix <= b.high[: len(prefix)])]
        if not held:
            return self.spark.createDataFrame([], COLUMNS)
        tail = F.col("tail") == low if literal else F.col("tail").startswith(prefix)
        if not literal and "%" not in low:
            tail = tail & (F.col("size") == len(low))
        found = self.spark.read.schema(SCHEMA).parquet(f"{self.path}/tails").filter(F.col("part").isin(held) & tail & named(F.col("value"), name)).select("value")
        # With `%` several tails of one value may match.
        found = found.distinct() if "%" in low else found
        refs, some = self._refs(), [r.value for r in found.limit(NAMED + 1).collect()]
        if some and len(some) <= NAMED:
            refs = refs.filter(F.col(self.column).isin(some))
        return found.join(refs, F.col("value") == F.col(self.column)).select(*REF)
