"""Connected components by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from srcatlas.llm._store import discard, materialize


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """Edges (a long, b long) to (id long, root long), root being the least id of the component.

    Only ids on an edge between different ids appear; null ends are ignored. Each
    round re-hangs a node's larger neighbours (large star), then its smaller ones
    (small star), below their least; both keep every component connected and the
    number of edges from growing. Rounds end when the edges no longer change, and
    each is written to the shared folder. No edge reaches the driver, only a sum.
    The result reads the last round's table, which `discard` deletes.
    """
    now = materialize(edges.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges")
    before = None
    for _ in range(max_rounds):
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m"))
        large = both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        small = large.groupBy("u").agg(F.min("v").alias("m"))
        down = large.join(small, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v")
        then, now = now, materialize(down.unionByName(small.select("u", F.col("m").alias("v"))).distinct(), "edges")
        discard(then)
        state = now.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.xxhash64("u", "v").cast("decimal(20,0)")), F.lit(0))).first()
        if state == before or not state[0]:
            break
        before = state
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    roots = now.select(F.col("u").alias("id"), F.col("v").alias("root"))
    out = roots.unionByName(roots.select(F.col("root").alias("id"), "root").distinct())
    out._scratch = now._scratch
    return out
