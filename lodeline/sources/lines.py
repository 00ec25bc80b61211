"""Log sources as DataFrames with an explicit line number."""

from __future__ import annotations

import hashlib
from collections.abc import Mapping, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions import text
from ..functions.patterns import Mask, validate_patterns
from ..functions.tables import dealt, runs
from ..functions.tables import names as folder_names
from ..operators.metrics import first_appearance_ids

DEMO = "DemoTiny"


# The lines of the demo corpus.
DEMO_LINES = """\
2024-01-01 00:00:00 INFO Worker-1 Completed task 42 in 0.5s
2024-01-01 00:00:01 INFO Worker-2 Completed task 43 in 0.7s
2024-01-01 00:00:02 INFO Worker-3 Completed task 44 in 0.9s
2024-01-01 00:00:03 WARN Worker-1 Retrying task 45 attempt 1
2024-01-01 00:00:04 WARN Worker-2 Retrying task 46 attempt 2
2024-01-01 00:00:05 ERROR Worker-3 Failed task 47 with code 500
2024-01-01 00:00:06 ERROR Worker-1 Failed task 48 with code 503
2024-01-01 00:00:07 INFO Connection from 192.168.1.10 established
2024-01-01 00:00:08 INFO Connection from 192.168.1.11 established
2024-01-01 00:00:09 INFO Connection from 10.0.0.5 established
2024-01-01 00:00:10 DEBUG Memory pointer 0xDEADBEEF freed
2024-01-01 00:00:11 DEBUG Memory pointer 0xCAFEBABE freed
2024-01-01 00:00:12 INFO File /var/log/app.log rotated successfully
2024-01-01 00:00:13 INFO File /var/log/system.log rotated successfully
"""


def demo_lines(spark: SparkSession) -> DataFrame:
    """A corpus of 14 lines that shows every class of variables."""
    return spark.createDataFrame([(DEMO, n, line) for n, line in enumerate(DEMO_LINES.splitlines())], "dataset string, line_no long, line string")


def lines_of(texts: DataFrame, key: str, text_col: str = "text", dataset: str = "all") -> DataFrame:
    """Nonblank lines of a table of texts; line_no orders them by the key (a number below 2^31) and the place in the text."""
    at = texts.select(F.col(key).alias("k"), F.posexplode(text.split_lines(F.col(text_col))).alias("n", "line"))
    return at.where(~text.is_blank(F.col("line"))).select(F.lit(dataset).alias("dataset"), (F.col("k") * F.lit(1 << 32) + F.col("n")).alias("line_no"), "line")


def numbered_lines(raw: DataFrame, breaks: str, keep_blank: bool) -> DataFrame:
    """owner, line_no, line of raw (owner, path, block, place, value): physical lines of files that are read in splits of any size.

    A value between two newlines may hold more line breaks, those of the pattern `breaks`. Lines are counted in each split; a split's numbers start after those of the splits and
    files of the same owner before it. No task sees more than a split.
    """
    ends = F.regexp_replace("value", r"\r\z", "")
    pieces = F.split(ends, breaks)
    found = raw.withColumn("pieces", pieces if keep_blank else F.filter(pieces, lambda x: ~text.is_blank(x))).withColumn("n", F.size("pieces"))
    split = W.partitionBy("owner", "path", "block")
    within = F.sum("n").over(split.orderBy("place").rowsBetween(W.unboundedPreceding, 0)) - F.col("n")
    sizes = found.groupBy("owner", "path", "block").agg(F.sum("n").alias("m"))
    before = F.coalesce(F.sum("m").over(W.partitionBy("owner").orderBy("path", "block").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    placed = found.withColumn("within", within).join(sizes.select("owner", "path", "block", before.alias("before")), ["owner", "path", "block"])
    return placed.select("owner", (F.col("before") + F.col("within")).alias("start"), F.posexplode("pieces").alias("i", "line")).select("owner", (F.col("start") + F.col("i")).alias("line_no"), "line")


def _raw(spark: SparkSession, paths: str | Sequence[str], owner: Column, recursive: bool = False) -> DataFrame:
    """Values between newlines with their file, split and place in it. The ids that Spark gives to a partition's rows rise with the place in a split."""
    read = spark.read.option("recursiveFileLookup", recursive).option("lineSep", "\n").text(paths)
    return read.select("value", F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("place")).select(owner.alias("owner"), "*")


def _folder(file: str) -> Column:
    """The folder in which the file (a pattern), or the folder of that name, of the column path lies; paths are addresses with escapes."""
    return F.url_decode(F.replace(F.regexp_extract("path", rf"([^/]+)/{file}(?:/[^/]*)?$", 1), F.lit("+"), F.lit("%2B")))


def corpus(spark: SparkSession, root: str, names: Sequence[str] | None = None) -> DataFrame:
    """Lines of root/<dataset>/raw.log, a file or a folder of part files in order, for all datasets or those named; blank lines are dropped and do
    not count. Files of any size are read in splits."""
    paths = [f"{root}/{n}/raw.log" for n in names] if names else f"{root}/*/raw.log"
    owner = _folder(r"raw\.log")
    return numbered_lines(_raw(spark, paths, owner), text.LINE_BREAK, keep_blank=False).select(F.col("owner").alias("dataset"), "line_no", "line")


def records(spark: SparkSession, root: str) -> DataFrame:
    """One record for each line of all files under root, blank ones too: record_id, source, line_no, ts, format_hint, text.

    Lines end at \\n, \\r\\n or \\r. Ids are hashes of source and line number, so they are the same on every run. Files are read in splits.
    """
    return _records(_raw(spark, root, F.col("path"), recursive=True))


def _records(raw: DataFrame) -> DataFrame:
    at = numbered_lines(raw, r"\r", keep_blank=True).select(F.col("owner").alias("source"), "line_no", "line")
    hint = F.lower(F.regexp_extract(F.element_at(F.split("source", "/"), -1), r"(?<=.)(\.[^.]+)$", 1))
    record_id = F.sha2(F.concat_ws(":", "source", F.col("line_no").cast("string")), 256)
    return at.select(record_id.alias("record_id"), "source", "line_no", F.lit(None).cast("timestamp").alias("ts"), hint.alias("format_hint"), text.strip(F.col("line")).alias("text"))


def stream_records(spark: SparkSession, root: str, path: str, checkpoint: str, files_per_batch: int | None = None) -> StreamingQuery:
    """A stream over the growing tree root that appends to the Parquet table path what records() gives for each new file; every file is read once, whole
    and in splits, and numbered from its own first line. Start it with the same checkpoint to go on with the files added since.

    The query takes what is there and ends; a micro-batch that runs again replaces what it wrote.
    """
    read = spark.readStream.option("recursiveFileLookup", True).option("lineSep", "\n")
    if files_per_batch:
        read = read.option("maxFilesPerTrigger", files_per_batch)
    found = read.text(root).select("value", F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("block"))

    def append(batch: DataFrame, number: int) -> None:
        raw = batch.select(F.col("path").alias("owner"), "value", "path", "block", F.monotonically_increasing_id().alias("place"))
        _records(raw).write.mode("overwrite").parquet(f"{path}/batch={number}")

    return found.writeStream.foreachBatch(append).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def described(found: DataFrame) -> DataFrame:
    """records with their short description: id, source, and the first 50 characters."""
    return found.select("*", F.concat(F.lit("["), "record_id", F.lit("] "), "source", F.lit(" | "), F.substring("text", 1, 50)).alias("description"))


def ground_truth(spark: SparkSession, root: str, names: Sequence[str] | None = None) -> DataFrame:
    """dataset, line_no, cluster_id, template from root/<dataset>/templates.json: a list of entries, or an object with them; or from
    root/<dataset>/templates.jsonl, a file or a folder of part files with an entry on each line, which are read in splits."""
    spread = _found(spark, root, names, "templates.jsonl")
    whole = _found(spark, root, names, "templates.json")
    parts = []
    if spread:
        owner = _folder(r"templates\.jsonl")
        at = numbered_lines(_raw(spark, spread, owner), r"\r", keep_blank=False).withColumn("e", F.from_json("line", "cluster_id bigint, template string"))
        parts.append(at.select(F.col("owner").alias("dataset"), "line_no", "e.cluster_id", "e.template"))
    if whole or not spread:
        parts.append(_whole_truth(spark, whole or [f"{root}/{n}/templates.json" for n in names or ["*"]]))
    return parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])


def _found(spark: SparkSession, root: str, names: Sequence[str] | None, file: str) -> list[str]:
    """The paths root/<dataset>/file that are there, by the folders' listing."""
    return [f"{root}/{n}/{file}" for n in (names or folder_names(spark, root)) if file in folder_names(spark, f"{root}/{n}")]


def _whole_truth(spark: SparkSession, paths: Sequence[str]) -> DataFrame:
    raw = spark.read.text(paths, wholetext=True).select(F.col("_metadata.file_path").alias("path"), "value").select(_folder(r"templates\.json").alias("dataset"), "value")
    entry = "array<struct<cluster_id:bigint,template:string>>"
    listed = F.rlike("value", F.lit(r"^\s*\["))
    entries = F.when(listed, F.from_json("value", entry)).otherwise(F.from_json("value", f"struct<entries:{entry}>")["entries"])
    return raw.select("dataset", F.posexplode(entries).alias("line_no", "e")).select("dataset", F.col("line_no").cast("long"), "e.cluster_id", "e.template")


def csv_records(spark: SparkSession, paths: str | Sequence[str], columns: Sequence[str]) -> DataFrame:
    """path, n, and the named columns (strings) of the records of CSV files, without their headers; n counts a file's records from 0.

    Files are read in splits of any size, also where quoted fields hold line breaks: a record begins on a line with an even number of quotes before it in
    its file, which is a sum over the splits before, and within the split. All files have the header of the first, else the plan fails.
    """
    names = spark.read.option("header", True).csv(paths).columns
    raw = _raw(spark, paths, F.lit("")).drop("owner")
    quotes = F.length("value") - F.length(F.replace("value", F.lit('"')))
    at = W.partitionBy("path", "block").orderBy("place")
    counted = raw.withColumn("q", quotes).withColumn("before", F.sum("q").over(at.rowsBetween(W.unboundedPreceding, 0)) - F.col("q"))
    splits = raw.groupBy("path", "block").agg(F.sum(quotes).alias("q"))
    earlier = F.coalesce(F.sum("q").over(W.partitionBy("path").orderBy("block").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    lines = counted.drop("q").join(splits.select("path", "block", earlier.alias("earlier")), ["path", "block"])
    begins = lines.withColumn("begins", ((F.col("earlier") + F.col("before")) % 2 == 0).cast("long")).withColumn("record", F.sum("begins").over(at))
    starts = begins.groupBy("path", "block").agg(F.sum("begins").alias("m"))
    first = F.coalesce(F.sum("m").over(W.partitionBy("path").orderBy("block").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    placed = begins.join(starts.select("path", "block", first.alias("first")), ["path", "block"]).withColumn("n", F.col("first") + F.col("record") - 2)
    parts = F.transform(F.array_sort(F.collect_list(F.struct("block", "place", "value"))), lambda x: x["value"])
    whole = placed.groupBy("path", "n").agg(F.regexp_replace(F.array_join(parts, "\n"), r"\r\z", "").alias("record")).where("record <> ''")
    fields = F.from_csv("record", F.lit(", ".join(f"c{i} string" for i in range(len(names)))), {"escape": '"', "multiLine": "true", "maxCharsPerColumn": "-1"})
    parsed = whole.select("path", "n", fields.alias("f"))
    is_header = F.col("n") == -1
    as_expected = F.array(*(F.col(f"f.c{i}") for i in range(len(names)))) == F.array(*map(F.lit, names))
    checked = parsed.where(F.when(~is_header, True).when(as_expected, False).otherwise(F.raise_error(F.concat(F.lit("another header in "), "path")).cast("boolean")))
    return checked.select("path", "n", *(F.col(f"f.c{names.index(c)}").alias(c) for c in columns))


def structured(spark: SparkSession, path: str | Sequence[str], dataset: str) -> DataFrame:
    """dataset, line_no, line, template, cluster_id from CSV files with Content and EventTemplate; rows without Content are left out.

    line_no: the number of the record over all files in the order of their names. cluster_id: number of the template in the order of first appearance.
    """
    rows = csv_records(spark, path, ["Content", "EventTemplate"])
    files = rows.groupBy("path").agg((F.max("n") + 1).alias("m"))
    before = F.coalesce(F.sum("m").over(W.orderBy("path").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))  # a row for each file
    placed = rows.join(files.select("path", before.alias("before")), "path").where("Content <> ''")
    found = placed.select(F.lit(dataset).alias("dataset"), (F.col("before") + F.col("n")).alias("line_no"), F.col("Content").alias("line"), F.coalesce("EventTemplate", F.lit("")).alias("template"))
    return first_appearance_ids(found, "template")


def read_masks(spark: SparkSession, path: str, strict: bool = False) -> list[Mask]:
    """Masks from a JSON list; strict: every entry has exactly label, pattern and justification. Patterns are validated."""
    import json

    entries: list[Mapping[str, str]] = json.loads("\n".join(r.value for r in spark.read.text(path, wholetext=True).collect()))
    masks = [Mask.of(e, strict) for e in entries]
    validate_patterns([m.pattern for m in masks])
    return masks


def read_jsonl(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).json(path)


def read_metrics(spark: SparkSession, path: str) -> DataFrame:
    """A CSV with a header, all columns strings."""
    return spark.read.csv(path, header=True)


def manifest(lines: DataFrame, templates: DataFrame | None = None) -> DataFrame:
    """name, logs, [templates,] checksum for each dataset: SHA-256 of its lines in order, joined by newlines.

    A task for each dataset reads its sorted lines and hashes them as they come, as a hash is sequential by definition; it holds none of them.
    """
    ordered = dealt(lines.select("dataset", "line_no", "line"), ["dataset"]).sortWithinPartitions("dataset", "line_no", "line")

    def run(batches):
        at, n, hashed, said = None, 0, None, False

        def row():
            return pa.RecordBatch.from_pydict({"dataset": pa.array(at, pa.string()), "logs": pa.array([n], pa.int64()), "checksum": [hashed.hexdigest()]})

        for batch in batches:
            for start, end, key in runs(batch, ["dataset"]):
                if [*key] != at:
                    if at:
                        yield row()
                    at, n, hashed, said = [*key], 0, hashlib.sha256(), False
                n += end - start
                found = batch.column("line").slice(start, end - start).drop_null().to_pylist()
                if found:
                    hashed.update(("\n" * said + "\n".join(found)).encode())
                    said = True
        if at:
            yield row()

    out = ordered.mapInArrow(run, "dataset string, logs long, checksum string")
    if templates is not None:
        out = out.join(templates.groupBy("dataset").agg(F.countDistinct("template").alias("templates")), "dataset", "left")
    return out.withColumnRenamed("dataset", "name")
