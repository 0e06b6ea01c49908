"""Scoring and auditing of candidate formulas."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gridobs.operators.stats import huber


def score_equations(df: DataFrame, equations: dict[str, tuple[str, int]], y: str, weight: str | None = None, delta: float = 0.5) -> DataFrame:
    """``equation, complexity, r2, rmse, loss`` of every formula (a SQL expression over the columns), all in one pass."""
    t = F.col(y)
    aggs = []
    for i, (formula, _) in enumerate(equations.values()):
        p = F.expr(formula)
        ok = p.isNotNull() & t.isNotNull()
        obs = F.when(ok, t)
        loss = huber(t, p, delta) * (F.col(weight) if weight else F.lit(1.0))
        aggs += [(F.lit(1.0) - F.try_divide(F.sum((t - p) * (t - p)), F.var_pop(obs) * F.count(obs))).alias(f"a{i}"), F.sqrt(F.avg((t - p) * (t - p))).alias(f"b{i}"), F.avg(loss).alias(f"c{i}")]
    rows = [F.struct(F.lit(name).alias("equation"), F.lit(c).alias("complexity"), F.col(f"a{i}").alias("r2"), F.col(f"b{i}").alias("rmse"), F.col(f"c{i}").alias("loss")) for i, (name, (_, c)) in enumerate(equations.items())]
    return df.agg(*aggs).select(F.explode(F.array(*rows)).alias("r")).select("r.*")


def best_equations(scored: DataFrame, n: int = 3, low: int = 5, high: int = 15) -> DataFrame:
    """The smallest losses among complexities from ``low`` to ``high``, or among all if there are none."""
    inside = F.col("complexity").between(low, high)
    any_inside = F.max(inside).over(Window.partitionBy(F.lit(0)))  # a row per formula
    return scored.withColumn("_any", any_inside).where(inside | ~F.col("_any")).drop("_any").orderBy("loss", "complexity", "equation").limit(n)


def audit_equations(df: DataFrame, denominators: Sequence[str] = ("WS_eff", "BLH_eff"), features: Sequence[str] = ("tropomi_no2", "WS_eff", "BLH_eff", "doy_sin", "doy_cos"), column: str = "equation") -> DataFrame:
    """Add per variable ``<v>_below`` (it stands in a denominator), ``has_feature`` and ``valid`` (both)."""
    e = F.col(column)
    below = {f"{v}_below": e.rlike(rf"/\s*{v}|/\s*\(.*?{v}.*?\)") for v in denominators}
    some = F.lit(False)
    for f in features:
        some = some | e.contains(f)
    any_below = F.lit(False)
    for c in below.values():
        any_below = any_below | c
    return df.withColumns(below | {"has_feature": some, "valid": any_below & some})
