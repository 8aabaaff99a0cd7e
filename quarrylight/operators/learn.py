"""A learned pointwise reranker: weighted ridge regression from sums of products.

The normal equations need only sums over the training rows, which Spark adds up
in one pass; the small system they make (one row and column a feature) is
solved by elimination. So the fit is exact, the same in any partitioning, and
can be checked in SQL.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarrylight.functions import fixed_values as V
from quarrylight.operators import evaluate as E

FEATURES = ("text_rank", "text_overlap", "intent", "page_quality", "confidence", "leg")
HUMAN_WEIGHT, RIDGE = 5.0, 0.01
#: How much a leg counts: found with all terms, with some, or not at all.
LEGS = {"exact": 1.0, "expanded": 0.5}


def with_features(rows: DataFrame) -> DataFrame:
    """Numeric features, a missing one as 0; the target is a third of the grade, human grades weigh five times."""
    leg = F.lit(0.0)
    for name, value in LEGS.items():
        leg = F.when(F.col("leg") == name, value).otherwise(leg)
    base = rows.withColumn("leg", leg)
    for name in FEATURES[:-1]:
        base = base.withColumn(name, F.coalesce(F.col(name).cast("double"), F.lit(0.0)))
    weight = F.when(F.col("reason") == V.HUMAN_REASON, HUMAN_WEIGHT).otherwise(1.0)
    return base.withColumn("target", F.col("relevance") / 3.0).withColumn("weight", weight)


def normal_equations(train: DataFrame, ridge: float = RIDGE) -> list[list[float]]:
    """The matrix of weighted sums of products of features and a constant, with the sums with the target as last column.

    ``ridge`` times the sum of weights is added to the diagonal, but not for the constant. One row reaches the driver.
    """
    columns: list[Column] = [F.lit(1.0), *[F.col(f) for f in FEATURES]]
    n = len(columns)
    sums = {(i, j): F.sum(F.col("weight") * columns[i] * columns[j]) for i in range(n) for j in range(i, n)}
    sums |= {(i, n): F.sum(F.col("weight") * columns[i] * F.col("target")) for i in range(n)}
    row = train.agg(*[F.coalesce(x, F.lit(0.0)).alias(f"s{i}_{j}") for (i, j), x in sums.items()]).first()
    matrix = [[float(row[f"s{min(i, j)}_{max(i, j)}"]) for j in range(n + 1)] for i in range(n)]
    for i in range(1, n):
        matrix[i][i] += ridge * matrix[0][0]
    return matrix


def solve(matrix: list[list[float]]) -> list[float]:
    """The solution of a symmetric positive system, by elimination on the diagonal; all 0 where there is no training row."""
    rows = [list(r) for r in matrix]
    if rows[0][0] == 0:
        return [0.0] * len(rows)
    for k in range(len(rows)):
        pivot = rows[k]
        for i, row in enumerate(rows):
            if i != k:
                rows[i] = [x - row[k] * p / pivot[k] for x, p in zip(row, pivot, strict=True)]
        rows[k] = [p / pivot[k] for p in pivot]
    return [r[-1] for r in rows]


def predicted(weights: list[float]) -> Column:
    out = F.lit(weights[0])
    for name, w in zip(FEATURES, weights[1:], strict=True):
        out = out + F.lit(w) * F.col(name)
    return F.round(out, 6)


def fit_and_evaluate(rows: DataFrame, k: int = 10) -> DataFrame:
    """(split, queries, baseline and model nDCG@k and MRR)."""
    ready = with_features(rows)
    weights = solve(normal_equations(ready.where("split = 'train'")))
    scored = ready.select("query_id", "split", "candidate_no", "baseline_rank", "relevance", predicted(weights).alias("score"))
    splits = scored.select("query_id", "split").distinct()
    orders = {
        "baseline": [F.asc_nulls_last("baseline_rank"), F.asc("candidate_no")],
        "model": [F.desc("score"), F.asc("candidate_no")],
    }
    out = splits.groupBy("split").agg(F.count("*").alias("queries"))
    for name, order in orders.items():
        w = Window.partitionBy("query_id").orderBy(*order)
        ranked = scored.withColumn("rank", F.row_number().over(w).cast("long"))
        per = E.ndcg_at_k(ranked, k).join(E.reciprocal_rank(ranked), "query_id").join(splits, "query_id")
        means = per.groupBy("split").agg(
            F.round(F.avg("ndcg"), 6).alias(f"{name}_ndcg"), F.round(F.avg("reciprocal_rank"), 6).alias(f"{name}_mrr")
        )
        out = out.join(means, "split")
    return out.withColumn("ndcg_delta", F.round(F.col("model_ndcg") - F.col("baseline_ndcg"), 6))
