"""Connected components as DataFrame plans."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weft.plans.scratch import cut


def components(edges: DataFrame, a: str = "a", b: str = "b", most_rounds: int = 60) -> DataFrame:
    """(id, label): the least id of the component of every id that an edge names.

    Alternates large-star and small-star steps (Kiveris et al., SoCC 2014)
    until every id hangs on its component's least one. A step groups edges
    by id; no component is ever gathered in one place. Edges that repeat, run
    either way, lead from an id to itself, or have a null end are allowed;
    a null end names nothing. Raises RuntimeError beyond ``most_rounds``.
    """
    both = cut(edges.where(F.col(a).isNotNull() & F.col(b).isNotNull()).select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct())
    named = both.select("u").union(both.select("v")).distinct()
    e = both.where("u <> v")
    seen = None
    for _ in range(most_rounds):
        twice = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = twice.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
        large = twice.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        down = large.groupBy("u").agg(F.min("v").alias("m"))
        step = large.join(down, "u")
        e = cut(step.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(step.select("u", F.col("m").alias("v"))).distinct())
        now = e.agg(F.count("*"), F.coalesce(F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")), F.lit(0))).first()
        if seen is not None and tuple(now) == tuple(seen):
            return named.join(e.select("u", F.col("v").alias("label")), named["u"] == e["u"], "left").select(named["u"].alias("id"), F.coalesce("label", named["u"]).alias("label"))
        seen = now
    raise RuntimeError(f"components didn't settle in {most_rounds} rounds")
