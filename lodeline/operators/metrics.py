"""Accuracy of groupings and templates against a truth. Both inputs are keyed by dataset and line_no."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

KEY = ["dataset", "line_no"]


def _require_same_lines(truth: DataFrame, predicted: DataFrame) -> None:
    """ValueError naming some datasets of which the inputs have different numbers of lines; one job, whatever the number of datasets."""
    both = truth.select("dataset", F.lit(1).alias("more")).unionByName(predicted.select("dataset", F.lit(-1).alias("more")))
    other = both.groupBy("dataset").agg(F.sum("more").alias("more")).where("more <> 0").limit(5).collect()
    if other:
        raise ValueError("truth and prediction have different numbers of lines: " + ", ".join(f"{r.dataset} has {abs(r.more)} {'more' if r.more > 0 else 'fewer'} in the truth" for r in other))


def grouping_accuracy(truth: DataFrame, predicted: DataFrame, strict: bool = True) -> DataFrame:
    """dataset, GA: the share of lines whose predicted cluster has the same lines as a true one. An empty input has no row.

    A predicted cluster is right if its lines, the lines of a true cluster, and the lines of both together are equally many: three counts,
    no set is collected. strict: ValueError if the inputs have different numbers of lines.
    """
    if strict:
        _require_same_lines(truth, predicted)
    both = truth.select(*KEY, F.col("cluster_id").alias("t")).join(predicted.select(*KEY, F.col("cluster_id").alias("p")), KEY)
    pair = both.groupBy("dataset", "t", "p").agg(F.count("*").alias("n"))
    of_t = pair.groupBy("dataset", "t").agg(F.sum("n").alias("n_t"))
    of_p = pair.groupBy("dataset", "p").agg(F.sum("n").alias("n_p"))
    right = (F.col("n") == F.col("n_t")) & (F.col("n") == F.col("n_p"))
    return pair.join(of_t, ["dataset", "t"]).join(of_p, ["dataset", "p"]).groupBy("dataset").agg((F.sum(F.when(right, F.col("n")).otherwise(0)) / F.sum("n")).alias("GA"))


def parsing_accuracy(truth: DataFrame, predicted: DataFrame, strict: bool = True) -> DataFrame:
    """dataset, PA: the share of lines whose template equals the true one."""
    if strict:
        _require_same_lines(truth, predicted)
    both = truth.select(*KEY, F.col("template").alias("t")).join(predicted.select(*KEY, F.col("template").alias("p")), KEY)
    return both.groupBy("dataset").agg(F.avg((F.col("t") == F.col("p")).cast("double")).alias("PA"))


def rounded(x: Column) -> Column:
    return F.round(x, 4)


def scores(truth: DataFrame, predicted: DataFrame, method: str, strict: bool = True) -> DataFrame:
    """dataset, method, GA, PA, rounded to four places."""
    both = grouping_accuracy(truth, predicted, strict).join(parsing_accuracy(truth, predicted, False), "dataset")
    return both.select("dataset", F.lit(method).alias("method"), rounded(F.col("GA")).alias("GA"), rounded(F.col("PA")).alias("PA"))


def with_macro_average(rows: DataFrame) -> DataFrame:
    """rows and, if there are any, MacroAvg: the plain mean of the rounded values of each method."""
    mean = rows.groupBy("method").agg(rounded(F.avg("GA")).alias("GA"), rounded(F.avg("PA")).alias("PA"))
    return rows.unionByName(mean.select(F.lit("MacroAvg").alias("dataset"), "method", "GA", "PA"))


def first_appearance_ids(rows: DataFrame, value: str, order: str = "line_no") -> DataFrame:
    """rows with cluster_id: values of a dataset numbered from 0 in the order of their first row."""
    from .clustering import numbered

    first = rows.groupBy("dataset", value).agg(F.min(order).alias("first_line"))
    return rows.join(numbered(first).drop("first_line"), ["dataset", value])


def truth_or_fallback(corpus: DataFrame, truth: DataFrame, fallback: DataFrame) -> DataFrame:
    """truth for datasets where it has as many lines as the corpus, fallback for the others; with a column from_file."""
    n = corpus.groupBy("dataset").agg(F.count("*").alias("n"))
    m = truth.groupBy("dataset").agg(F.count("*").alias("m"))
    usable = n.join(m, "dataset").where("n = m").select("dataset")
    columns = [*KEY, "cluster_id", "template"]
    return truth.join(usable, "dataset", "left_semi").select(*columns, F.lit(True).alias("from_file")).unionByName(fallback.join(usable, "dataset", "left_anti").select(*columns, F.lit(False).alias("from_file")))
