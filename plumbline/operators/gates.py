"""Decisions over a table of metrics: variant, readout, eval_split, eval_scope, pr_auc, roc_auc and its interval's ends."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Which variants are compared, and by how much one must be better.
SPHERE = (("Sphere-Static", "Raw-Static"), ("Sphere-Traj-MeanPool", "Raw-Traj-MeanPool"))
TRAJECTORY = (("Sphere-Traj-MeanPool", "Sphere-Static"), ("Raw-Traj-MeanPool", "Raw-Static"))
ORDERED, SHUFFLED = "Sphere-Traj-LSTM-v0", "Sphere-Traj-Shuffled-LSTM"


def pooled_test(metrics: DataFrame) -> DataFrame:
    return metrics.where("eval_split = 'test' and eval_scope = 'pooled'")


def compared(metrics: DataFrame, pairs: tuple[tuple[str, str], ...]) -> DataFrame:
    """Per pair and readout: how much better the first variant is."""
    spark = metrics.sparkSession
    rows = pooled_test(metrics)
    a = rows.select(F.col("variant"), "readout", F.col("pr_auc").alias("pr_a"), F.col("roc_auc").alias("roc_a"))
    b = rows.select(F.col("variant").alias("baseline"), "readout", F.col("pr_auc").alias("pr_b"), F.col("roc_auc").alias("roc_b"))
    wanted = spark.createDataFrame(list(pairs), "variant string, baseline string")
    out = wanted.join(a, "variant").join(b, ["baseline", "readout"])
    return out.select("variant", "baseline", "readout", (F.col("pr_a") - F.col("pr_b")).alias("pr_delta"), (F.col("roc_a") - F.col("roc_b")).alias("roc_delta"))


def pair_gate(metrics: DataFrame, pairs: tuple[tuple[str, str], ...], *, min_pr: float = 0.01, max_roc_drop: float) -> DataFrame:
    """``status``: pass if the pairs succeed in more than one readout, mixed in one, fail if all got worse in both measures, else mixed."""
    rows = compared(metrics, pairs)
    won = (F.col("pr_delta") >= min_pr) & (F.col("roc_delta") >= -max_roc_drop)
    worse = (F.col("pr_delta") < 0) & (F.col("roc_delta") < 0)
    out = rows.agg(F.count("*").alias("total_comparisons"), F.count_if(won).alias("successes"), F.count_distinct(F.when(won, F.col("readout"))).alias("readouts"), F.count_if(worse).alias("worse"))
    lost = (F.col("total_comparisons") > 0) & (F.col("worse") == F.col("total_comparisons"))
    status = F.when(F.col("readouts") > 1, "pass").when(F.col("readouts") == 1, "mixed").when(lost, "fail").otherwise("mixed")
    return out.select(status.alias("status"), "successes", "total_comparisons")


def order_gate(metrics: DataFrame, readouts: tuple[str, ...]) -> DataFrame:
    """Whether the order of layers carries signal: all readouts must agree; a missing one makes it mixed."""
    rows = pooled_test(metrics)
    side = lambda v, s: rows.where(F.col("variant") == v).select("readout", *[F.col(c).alias(f"{s}_{c}") for c in ("pr_auc", "roc_auc", "pr_auc_ci_low", "pr_auc_ci_high")])
    both = side(ORDERED, "o").join(side(SHUFFLED, "s"), "readout")
    apart = (F.col("o_pr_auc_ci_low") > F.col("s_pr_auc_ci_high")) | (F.col("s_pr_auc_ci_low") > F.col("o_pr_auc_ci_high"))
    pr, roc = F.col("o_pr_auc") - F.col("s_pr_auc"), F.col("o_roc_auc") - F.col("s_roc_auc")
    evidence = F.when((pr >= 0.01) & (roc >= 0.005) & apart, "supports_order").when((pr < 0) & (roc < 0) & apart, "against_order").otherwise("mixed")
    out = both.withColumn("evidence", evidence).agg(F.count("*").alias("total_comparisons"), F.count_if(F.col("evidence") == "supports_order").alias("for"), F.count_if(F.col("evidence") == "against_order").alias("against"))
    n = len(readouts)
    status = F.when(F.col("total_comparisons") < n, "mixed").when(F.col("for") == n, "pass").when(F.col("against") == n, "fail").otherwise("mixed")
    return out.select(status.alias("status"), "total_comparisons")


def norm_gate(metrics: DataFrame) -> DataFrame:
    """Strong if the best norm-only variant reaches nine tenths of the best other one."""
    is_norm, pr = F.startswith(F.col("variant"), F.lit("Norm-")), F.when(~F.isnan("pr_auc"), F.col("pr_auc"))
    out = pooled_test(metrics).agg(F.max(F.when(is_norm, pr)).alias("best_norm_pr_auc"), F.max(F.when(~is_norm, pr)).alias("best_non_norm_pr_auc"))
    strong = F.coalesce(F.col("best_norm_pr_auc") >= 0.9 * F.col("best_non_norm_pr_auc"), F.lit(False))
    return out.select(F.when(strong, "strong").otherwise("weak").alias("status"), "best_norm_pr_auc", "best_non_norm_pr_auc")


def overall(sphere: str, trajectory: str) -> str:
    if sphere == trajectory == "pass":
        return "pass"
    return "mixed_positive" if {sphere, trajectory} == {"pass", "mixed"} else "fail"


def model_gates(metrics: DataFrame) -> DataFrame:
    """One row: the two pair gates, the norm gate, and the decision."""
    s = pair_gate(metrics, SPHERE, max_roc_drop=0.02).select(F.col("status").alias("sphere"))
    t = pair_gate(metrics, TRAJECTORY, max_roc_drop=0.05).select(F.col("status").alias("trajectory"))
    n = norm_gate(metrics).select(F.col("status").alias("norm"))
    both = s.crossJoin(t).crossJoin(n)  # one row each
    decided = F.when((F.col("sphere") == "pass") & (F.col("trajectory") == "pass"), "pass").when((F.col("sphere") == "pass") & (F.col("trajectory") == "mixed") | (F.col("sphere") == "mixed") & (F.col("trajectory") == "pass"), "mixed_positive").otherwise("fail")
    return both.withColumn("overall_decision", decided)


def decision(rows: DataFrame, column: str = "overall_decision") -> DataFrame:
    """Of several models: pass if any passes, else mixed_positive if any is, else fail; also without rows."""
    out = rows.agg(F.bool_or(F.col(column) == "pass").alias("p"), F.bool_or(F.col(column) == "mixed_positive").alias("m"))
    return out.select(F.when(F.col("p"), "pass").when(F.col("m"), "mixed_positive").otherwise("fail").alias("decision"))
