"""Coverage of one catalogue by another: the best match of every row, and the share without one."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from grantlake.operators.ingest import THRESHOLD, name_classes, name_members, similar_classes


def best_matches(left: DataFrame, right: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(right_id, left_id, score): for each right row (id, name, org) the left row most like it, the first of equals.

    Only a likeness from the threshold on is a match; other rows get no left_id and score 0. Rows of one
    name and organization are one class, named by its least id, so copies are compared once. A row with
    neither a name nor an organization matches nothing.
    """
    name, org = F.col("name"), F.col("org")
    found = similar_classes(name_classes(left, "id", name, org), name_classes(right, "id", name, org), threshold)
    best = found.groupBy("b").agg(F.max_by(F.struct("a", "score"), F.struct("score", -F.col("a"))).alias("_m"))
    members = name_members(right, "id", name, org).withColumnsRenamed({"id": "right_id", "rep": "b"})
    return members.join(best, "b", "left").select("right_id", F.col("_m.a").alias("left_id"), F.coalesce("_m.score", F.lit(0.0)).alias("score"))


def report(matches: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """One row: totals, equal ones, candidates to check by hand, rows only on the right and their share."""
    return matches.agg(
        F.count("*").alias("total"), F.count_if(F.col("score") >= 1).alias("matched"),
        F.count_if((F.col("score") >= threshold) & (F.col("score") < 1)).alias("manual_review"),
        F.count_if(F.col("score") < threshold).alias("only_right"),
        F.coalesce(F.try_divide(F.count_if(F.col("score") < threshold), F.count("*")), F.lit(0.0)).alias("gap_rate"),
    )
