"""The row-wise functions of log lines as SQL functions, so that queries in SQL need no Python: mask_line, line_tokens, bucket_key, normalise_line and
scrub_line. They are temporary functions of a session whose bodies are SQL expressions, which Catalyst inlines like any other."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import SparkSession

from .patterns import WILDCARD, Mask
from .text import DIGITS, HEX_RUN, NUMBER_RUN, SCRUBBED, SPACE


def _q(x: str) -> str:
    return "'" + x.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _replaced(column: str, pairs: Sequence[tuple[str, str]]) -> str:
    for pattern, by in pairs:
        column = f"regexp_replace({column}, {_q(pattern)}, {_q(by)})"
    return column


def register(spark: SparkSession, masks: Sequence[Mask], depth: int = 5) -> list[str]:
    """Make the functions in the session, with these masks (usable ones) and this depth of bucket keys; their names. Registered again, they are replaced.

    mask_line(line): the line after all masks. line_tokens(line): the tokens of the masked line, one empty token for a blank one. bucket_key(line): the
    first `depth` of them, variable ones as wildcards. normalise_line(line): hex-like runs and numbers replaced. scrub_line(line): paths, addresses and
    host names replaced. A null line gives null.
    """
    tokens = f"filter(split(mask_line(line), {_q(SPACE + '+')}), x -> x <> '')"
    variable = f"(startswith(t, '<VAR:') AND endswith(t, '>')) OR rlike(t, {_q(f'(?U)^{DIGITS}+$')})"
    bodies = {
        "mask_line": ("STRING", _replaced("line", [(m.java, m.placeholder) for m in masks])),
        "line_tokens": ("ARRAY<STRING>", f"CASE WHEN size({tokens}) = 0 THEN array('') ELSE {tokens} END"),
        "bucket_key": ("STRING", f"array_join(transform(slice(line_tokens(line), 1, {depth}), t -> CASE WHEN {variable} THEN '{WILDCARD}' ELSE t END), ' ')"),
        "normalise_line": ("STRING", _replaced("line", [HEX_RUN, NUMBER_RUN])),
        "scrub_line": ("STRING", _replaced("line", SCRUBBED)),
    }
    for name, (kind, body) in bodies.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}(line STRING) RETURNS {kind} RETURN {body}")
    return list(bodies)
