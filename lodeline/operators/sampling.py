"""Diverse samples by entropy: lines in the order of falling entropy, each unlike all taken before."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import text
from ..functions.tables import keep

LEAST_UNLIKE, WAVE = 0.8, 64


def scored(lines: DataFrame) -> DataFrame:
    """lines with tokens (normalised) and entropy (rounded, so that equal distributions tie)."""
    found = lines.withColumn("tokens", text.sampling_tokens(F.col("line")))
    return found.withColumn("entropy", F.round(text.entropy(F.col("tokens")), 12))


def candidates(lines: DataFrame) -> DataFrame:
    """scored lines, of those with one token set in a dataset only the first in rank: the others could not be taken after it."""
    same = F.array_join(F.array_sort(F.array_distinct("tokens")), " ")
    best = scored(lines).groupBy("dataset", same.alias("__set")).agg(F.min(F.struct((-F.col("entropy")).alias("fall"), "line_no", "line", "tokens")).alias("x"))
    return best.select("dataset", F.col("x.line_no").alias("line_no"), F.col("x.line").alias("line"), F.col("x.tokens").alias("tokens"), (-F.col("x.fall")).alias("entropy"))


def _picks(waves: pa.Table, state: pa.Table, k: int, least: float) -> pa.Table:
    """The next lines of a dataset: those of its wave, in their order, that are unlike all taken before; and its state, a row with a null line_no."""
    waves = waves.sort_by("place")
    before = state.to_pylist()[0]
    sets = [set(x) for x in before["taken"]]
    out: list[dict] = []
    last = before["last_entropy"], before["last_line"]
    for row in waves.to_pylist():
        if len(sets) == k:
            break
        own = set(row["tokens"])
        last = row["entropy"], row["line_no"]
        if all((len(own & s) / len(own | s) if own | s else 1.0) < least for s in sets):
            out.append({"dataset": before["dataset"], "rank": len(sets), "line_no": row["line_no"], "line": row["line"]})
            sets.append(own)
    done = not waves.num_rows or len(sets) == k
    out.append({"dataset": before["dataset"], "taken": [sorted(s) for s in sets], "last_entropy": last[0], "last_line": last[1], "done": done})
    return pa.Table.from_pylist(out, _WAVE)


_WAVE = pa.schema([("dataset", pa.string()), ("rank", pa.int64()), ("line_no", pa.int64()), ("line", pa.string()), ("taken", pa.list_(pa.list_(pa.string()))), ("last_entropy", pa.float64()), ("last_line", pa.int64()), ("done", pa.bool_())])


def entropy_greedy_sample(lines: DataFrame, k: int, dataset: str | None = None, least: float = LEAST_UNLIKE) -> DataFrame:
    """rank, dataset, line_no, line: up to k lines of each dataset in the order of selection; all lines in order if there are no more than k.

    Lines are scored once. Then waves of a few times k ranked candidates of each dataset, those not like a line taken before, meet their dataset's state in a
    task, which takes the next lines; a dataset with k lines, or without candidates, is done. All datasets go through a wave in one job; what was
    taken is a table, and the driver holds a number for each wave.
    """
    spark = lines.sparkSession
    if k <= 0:
        return spark.createDataFrame([], "rank long, dataset string, line_no long, line string")
    if dataset is not None:
        lines = lines.where(F.col("dataset") == dataset)
    counts = keep(lines.groupBy("dataset").agg(F.count("*").alias("n")), "counts")
    rank = F.row_number().over(W.partitionBy("dataset").orderBy("line_no")).cast("long") - 1
    in_few = lines.join(counts.where(F.col("n") <= k).select("dataset"), "dataset", "left_semi")
    out = in_few.select(rank.alias("rank"), "dataset", "line_no", "line")
    many = counts.where(F.col("n") > k).select("dataset")
    none = [F.array().cast("array<array<string>>").alias("taken"), F.lit(None).cast("double").alias("last_entropy"), F.lit(None).cast("long").alias("last_line"), F.lit(False).alias("done")]
    state = keep(many.select("dataset", *none), "state")
    if not state.limit(1).count():
        return out
    ranked = keep(candidates(lines.join(many, "dataset", "left_semi")), "candidates")
    by_rank = W.partitionBy("dataset").orderBy(F.desc("entropy"), "line_no")
    behind = F.col("last_entropy").isNull() | (F.col("entropy") < F.col("last_entropy")) | ((F.col("entropy") == F.col("last_entropy")) & (F.col("line_no") > F.col("last_line")))
    unlike = F.forall("taken", lambda s: text.jaccard(F.col("tokens"), s) < least)
    while state.where("NOT done").limit(1).count():
        rest = ranked.join(state.where("NOT done"), "dataset").where(behind & unlike).select("dataset", "line_no", "line", "tokens", "entropy")
        wave = rest.withColumn("place", F.row_number().over(by_rank)).where(F.col("place") <= max(WAVE, 4 * k))
        fields = "dataset string, rank long, line_no long, line string, taken array<array<string>>, last_entropy double, last_line long, done boolean"
        step = keep(wave.groupBy("dataset").cogroup(state.where("NOT done").groupBy("dataset")).applyInArrow(lambda w, s: _picks(w, s, k, least), fields), "wave")
        out = out.unionByName(step.where("line_no IS NOT NULL").select("rank", "dataset", "line_no", "line"))
        state = step.where("line_no IS NULL").select("dataset", "taken", "last_entropy", "last_line", "done")
    return out
