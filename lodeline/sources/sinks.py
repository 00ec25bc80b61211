"""Writers of results."""

from __future__ import annotations

import json
import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions import tables, text
from ..functions.patterns import Mask
from .lines import manifest


def write_parsed_csv(parsed: DataFrame, path: str) -> None:
    """log, template of each line in order, every field quoted. Files are in range order of line_no."""
    rows = parsed.orderBy("dataset", "line_no").selectExpr("line AS log", "template")
    rows.write.mode("overwrite").option("quoteAll", True).option("escape", '"').csv(path, header=True)


def write_csv(rows: DataFrame, path: str) -> None:
    """A small result as one file with a header."""
    rows.coalesce(1).write.mode("overwrite").csv(path, header=True)


def write_masks(spark: SparkSession, masks: Sequence[Mask], path: str) -> int:
    """A mask bundle as a JSON list; the number of masks."""
    body = json.dumps([m.as_dict() for m in masks], indent=2)
    spark.createDataFrame([(body,)], "value string").coalesce(1).write.mode("overwrite").text(path)
    return len(masks)


def write_jsonl(rows: DataFrame, path: str) -> int:
    """Rows as JSON lines; their number, counted as they are written."""
    seen = Observation()
    rows.observe(seen, F.count(F.lit(1)).alias("n")).write.mode("overwrite").json(path)
    return seen.get["n"]


def write_lines(lines: DataFrame, path: str) -> None:
    """Lines in order, by dataset."""
    lines.select("dataset", "line_no", "line").repartition("dataset").sortWithinPartitions("dataset", "line_no").select("dataset", "line").write.mode("overwrite").partitionBy("dataset").text(path)


def _by_dataset(rows: DataFrame, root: str, file: str, kind: str, order: str, columns: Sequence[str]) -> list[str]:
    """Write the columns of rows (dataset, ...) in one job, a folder of part files in the given order for each dataset, and name these root/<dataset>/file;
    the datasets. Rows are sorted by the very column that parts the folders, so the writer keeps their order."""
    at = f"{root}/_{uuid.uuid4().hex}"
    owned = rows.withColumn("__owner", F.hex("dataset")).repartitionByRange("__owner", order).sortWithinPartitions("__owner", order)
    return _named(owned.select("__owner", *columns), root, file, kind, at)


def _named(owned: DataFrame, root: str, file: str, kind: str, at: str) -> list[str]:
    spark = owned.sparkSession
    owned.write.partitionBy("__owner").format(kind).save(at)
    found = [bytes.fromhex(n.removeprefix("__owner=")).decode() for n in tables.names(spark, at) if n.startswith("__owner=")]
    for name in found:
        tables.delete(spark, f"{root}/{name}/{file}")
        tables.rename(spark, f"{at}/__owner={name.encode().hex().upper()}", f"{root}/{name}/{file}")
    tables.delete(spark, at)
    return sorted(found)


def write_datasets(lines: DataFrame, root: str, truth: DataFrame | None = None, whole_truth: bool = False) -> list[str]:
    """root/<dataset>/raw.log (a folder of part files in the order of line_no), templates.jsonl (with a truth: dataset, line_no, cluster_id, template; an
    entry on each line) and manifest.json for each dataset, as corpus() and ground_truth() read them; the names.

    whole_truth: templates.json, an object with the list of all entries, in place of templates.jsonl, for readers that want this form; a dataset's truth is
    then one file that one task writes entry by entry, with a line break before each. No task holds a dataset.

    A fixed number of jobs for any number of datasets: each file is written for all of them at once, cut into ranges of dataset and line_no, and
    its folders are then named. Names of datasets are folder names.
    """
    about = manifest(lines, truth)
    names = _by_dataset(lines, root, "raw.log", "text", "line_no", ["line"])
    _by_dataset(about.withColumn("dataset", F.col("name")), root, "manifest.json", "json", "name", about.columns)
    if truth is not None and whole_truth:
        each = W.partitionBy("__owner").orderBy("line_no", "cluster_id", "template")
        head = F.when(F.row_number().over(each) == 1, '{"entries":[').otherwise(",")
        tail = F.when(F.lead(F.lit(1)).over(each).isNull(), "]}").otherwise("")
        value = F.concat(head, F.to_json(F.struct("cluster_id", "template")), tail)
        _named(truth.withColumn("__owner", F.hex("dataset")).select("__owner", value.alias("value")), root, "templates.json", "text", f"{root}/_{uuid.uuid4().hex}")
    elif truth is not None:
        _by_dataset(truth, root, "templates.jsonl", "json", "line_no", ["cluster_id", "template"])
    return names


def show(rows: DataFrame, n: int = 20) -> None:
    """The first rows on standard output, whole."""
    rows.show(n, truncate=False)


def show_stream(rows: DataFrame, n: int = 20) -> StreamingQuery:
    """The rows of each micro-batch of a stream on standard output, whole, the first n of each."""
    return rows.writeStream.format("console").option("truncate", False).option("numRows", n).start()


def scrub_files(spark: SparkSession, source: str, path: str) -> None:
    """Text files with paths, mail addresses and host names replaced."""
    rows = spark.read.text(source)
    rows.select(text.scrub(rows.value).alias("value")).write.mode("overwrite").text(path)
