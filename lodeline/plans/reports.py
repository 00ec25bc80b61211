"""LaTeX tables of results."""

from __future__ import annotations

from pathlib import Path

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.lines import read_metrics

# Caption, label and file names of each table.
TABLES = {
    "accuracy": ("Table I: Grouping and Parsing Accuracy", "tab:ga_pa", "table_I.tex", "table_I_ga_pa.csv"),
    "timing": ("Table II: Timing Benchmark", "tab:timing", "table_II.tex", "table_II_timing.csv"),
}


def cell(value: Column) -> Column:
    """A number with three decimals; other text as it is."""

    @F.pandas_udf("string")
    def three(x: pd.Series) -> pd.Series:  # the JVM rounds the shortest decimal form of a double, not its value
        return x.map(lambda v: None if pd.isna(v) else f"{v:.3f}")

    return F.coalesce(three(value.try_cast("double")), value)


def body_rows(rows: DataFrame, order: str) -> DataFrame:
    """row: the table's body lines, ordered by `order`."""
    names = [c for c in rows.columns if c != order]
    cells = F.concat_ws(" & ", *(cell(F.col(c).cast("string")) for c in names))
    return rows.select(F.col(order), F.concat(cells, F.lit(" \\\\")).alias("row"))


def latex(headers: list[str], body: list[str], caption: str, label: str) -> str:
    tabular = [f"\\begin{{tabular}}{{{'c' * len(headers)}}}", " & ".join(headers) + r" \\", r"\hline", *body, r"\end{tabular}"]
    return "\n".join([f"% {caption}", r"\begin{table}[ht]", r"\centering", *tabular, f"\\caption{{{caption}}}", f"\\label{{{label}}}", r"\end{table}", ""])


def build_tables(spark: SparkSession, csv_paths: list[str], output_dir: str) -> list[str]:
    """Tables of metrics files (small): accuracy where there are GA and PA, timing where there are seconds; later files overwrite."""
    out, written = Path(output_dir), []
    out.mkdir(parents=True, exist_ok=True)
    for path in csv_paths:
        rows = read_metrics(spark, path)
        headers = rows.columns
        body = [r.row for r in body_rows(rows.withColumn("__at", F.monotonically_increasing_id()), "__at").orderBy("__at").collect()]
        for kind, shown in (("accuracy", {"GA", "PA"} <= set(headers)), ("timing", "seconds" in headers)):
            if shown and body:
                caption, label, tex, copy = TABLES[kind]
                (out / tex).write_text(latex(headers, body, caption, label))
                rows.toPandas().to_csv(out / copy, index=False)
                written.append(tex)
    return written
