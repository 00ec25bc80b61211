"""Values of a template's slots in a line, their shapes, and training examples made of both."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import text
from ..functions.patterns import CLASSES, WHOLE, WILDCARD
from .sampling import entropy_greedy_sample

# Shapes of slot values, in the order they are tried, and the pattern each stands for.
SHAPES = [
    (WHOLE["TIMESTAMP"], CLASSES["TIMESTAMP"]),
    (r"\d{6}", r"\d{6}"),
    (r"\d{6}\s+\d{6}", r"\d{6}\s+\d{6}"),
    (WHOLE["UUID"], CLASSES["UUID"]),
    (WHOLE["IPV4"], CLASSES["IPV4"]),
    (WHOLE["HEX"], CLASSES["HEX"]),
    (r"/[A-Za-z0-9_./\-]+", r"(?<!\S)/[A-Za-z0-9_./\-]+"),
    (WHOLE["LOGLEVEL"], CLASSES["LOGLEVEL"]),
    (WHOLE["NUMBER"], r"-?\d+(?:\.\d+)?"),
    (r"blk_-?\d+", r"blk_-?\d+"),
    (r"[A-Za-z_][\w.\-:/]*\d[\w.\-:/]*", r"[\w.\-:/]+"),
]
OTHER = r"[^\s]+"
INSTRUCTION = "Write a list of Python regular expressions, one for each kind of variable part of this log line."


def prompt(line: Column, output: Column | None = None, instruction: str = INSTRUCTION) -> Column:
    """What a model is asked for a line, and with an output the whole training example: three headed parts."""
    parts = [F.lit("### Instruction:"), F.lit(instruction), F.lit(""), F.lit("### Input:"), line, F.lit(""), F.lit("### Output:"), F.lit("") if output is None else output]
    return F.concat_ws("\n", *parts)


def template_pattern(template: Column) -> Column:
    """A pattern with a group for each slot; each takes as little as it can, and at least one character."""
    literal = F.transform(F.split(template, r"<\*>"), lambda part: F.concat(F.lit("\\Q"), F.replace(part, F.lit("\\E"), F.lit("\\E\\\\E\\Q")), F.lit("\\E")))
    return F.concat(F.lit(r"(?Ud)^\s*"), F.array_join(literal, "(.+?)"), F.lit(r"\s*$"))


def slot_values(line: Column, template: Column) -> Column:
    """The values of the template's slots in the line; null if it doesn't match, also up to white space at both ends."""
    pattern = template_pattern(template)
    n = F.size(F.split(template, r"<\*>")) - 1
    values = F.transform(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), lambda i: F.call_function("regexp_extract", line, pattern, i))
    return F.when(F.rlike(line, pattern), F.when(n > 0, values).otherwise(F.array().cast("array<string>")))


def value_pattern(value: Column) -> Column:
    out = F.lit(OTHER)
    for shape, pattern in reversed(SHAPES):
        out = F.when(value.rlike(f"(?U)^(?:{shape})$"), F.lit(pattern)).otherwise(out)
    return out


def raw_literal(pattern: Column) -> Column:
    """The pattern as a Python literal: raw, or escaped where a raw one can't hold it."""
    escaped = F.replace(F.replace(pattern, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"'))
    odd = F.contains(pattern, F.lit('"')) | F.endswith(pattern, F.lit("\\"))
    return F.when(odd, F.concat(F.lit('"'), escaped, F.lit('"'))).otherwise(F.concat(F.lit('r"'), pattern, F.lit('"')))


def literal_list(patterns: Column) -> Column:
    return F.concat(F.lit("[\n    "), F.array_join(F.transform(patterns, raw_literal), ",\n    "), F.lit(",\n]"))


def aligned(lines: DataFrame) -> DataFrame:
    """lines (dataset, line_no, line, template) with values, those that don't align left out."""
    return lines.withColumn("values", slot_values(F.col("line"), F.col("template"))).where("values is not null")


def training_examples(lines: DataFrame, max_per_dataset: int | None = None, entropy_k: int | None = None) -> DataFrame:
    """dataset, line_no, instruction, input, output: the patterns of each line's values, each once, as a Python list.

    entropy_k: only a sample by entropy of each dataset; max_per_dataset: the first so many lines of those that align.
    """
    if entropy_k is not None:
        kept = entropy_greedy_sample(lines.select("dataset", "line_no", "line"), entropy_k)
        lines = lines.join(kept.select("dataset", "line_no"), ["dataset", "line_no"], "left_semi")
    patterns = F.array_distinct(F.transform("values", lambda v: value_pattern(text.strip(v))))
    out = aligned(lines).select("dataset", "line_no", F.lit(INSTRUCTION).alias("instruction"), F.col("line").alias("input"), literal_list(patterns).alias("output"))
    if max_per_dataset is not None:
        rank = F.row_number().over(W.partitionBy("dataset").orderBy("line_no"))
        out = out.withColumn("__rank", rank).where(F.col("__rank") <= max_per_dataset).drop("__rank")
    return out
