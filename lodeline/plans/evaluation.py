"""Batch plans over several datasets: synthesis, parsing, truth, scores and timing."""

from __future__ import annotations

import time
from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.patterns import Mask, canonical_masks, usable, validate_patterns
from ..operators import clustering, metrics
from ..operators.synthesis import MaskProvider, synth_masks, synth_masks_by_dataset
from ..sources import lines as sources
from ..sources import sinks


@dataclass(frozen=True)
class Settings:
    k: int = 50
    mode: str = "offline"
    strict: bool = False
    method: str = "lodeline"
    depth: int = clustering.DEPTH
    threshold: float = clustering.THRESHOLD
    most: int = clustering.MOST


def masks_by_dataset(lines: DataFrame, settings: Settings = Settings(), provider: MaskProvider | None = None) -> dict[str, list[Mask]]:
    if settings.mode == "offline":
        found = synth_masks_by_dataset(lines, settings.k)
        for own in found.values():
            validate_patterns([m.pattern for m in own], settings.strict)
        return found
    names = sorted(r[0] for r in lines.select("dataset").distinct().collect())
    return {n: synth_masks(lines.where(F.col("dataset") == n), settings.k, settings.mode, settings.strict, provider) for n in names}


def parse_all(lines: DataFrame, masks: dict[str, Sequence[Mask]], settings: Settings = Settings()) -> DataFrame:
    """Every dataset parsed with its masks, as one plan; datasets with the same masks share it."""
    spark, groups = lines.sparkSession, {}
    for name, own in masks.items():
        groups.setdefault(tuple(own), []).append(name)
    parts = [clustering.parse(lines.where(F.col("dataset").isin(names)), usable(spark, own), settings.depth, settings.threshold, settings.most) for own, names in groups.items()]
    return reduce(DataFrame.unionByName, parts)


def canonical_truth(lines: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """What parsing with the canonical masks gives, as a truth."""
    return clustering.parse(lines, canonical_masks(), settings.depth, settings.threshold, settings.most).select("dataset", "line_no", "cluster_id", "template")


def evaluate(lines: DataFrame, truth: DataFrame | None = None, settings: Settings = Settings(), masks: dict[str, Sequence[Mask]] | None = None) -> DataFrame:
    """dataset, method, GA, PA for each dataset and their plain mean. Datasets without a truth of their length are held against the canonical one."""
    parsed = parse_all(lines, masks or masks_by_dataset(lines, settings), settings)
    expected = canonical_truth(lines, settings)
    if truth is not None:
        expected = metrics.truth_or_fallback(lines, truth, expected)
    return metrics.with_macro_average(metrics.scores(expected, parsed, settings.method))


def write_demo(spark: SparkSession, root: str) -> str:
    """The demo corpus under root, with its truth by the canonical masks and its manifest; its name."""
    lines = sources.demo_lines(spark)
    return sinks.write_datasets(lines, root, canonical_truth(lines))[0]


def timing(lines: DataFrame, masks: Sequence[Mask], n: int, settings: Settings = Settings()) -> DataFrame:
    """dataset, seconds, n_logs: wall time of parsing the first n lines of each dataset, one after the other."""
    spark, rows, own = lines.sparkSession, [], usable(lines.sparkSession, masks)
    for (name,) in sorted(lines.select("dataset").distinct().collect()):
        part = lines.where((F.col("dataset") == name) & (F.col("line_no") < n))
        began = time.perf_counter()
        count = clustering.parse(part, own, settings.depth, settings.threshold, settings.most).count()
        rows.append((name, time.perf_counter() - began, count))
    return spark.createDataFrame(rows, "dataset string, seconds double, n_logs long")
