import random

import pytest
from lodeline import queries
from lodeline.functions.patterns import canonical_masks
from lodeline.operators import clustering, online
from lodeline.sources import lines as sources
from lodeline.sources import sinks
from lodeline.sources.lines import demo_lines
from lodeline.streaming import templates
from pyspark.sql import functions as F


@pytest.fixture(params=[10_000, 40])
def chunks(spark, request):
    """Rows of an Arrow chunk: with 40, a key's rows of a micro-batch come in many."""
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(request.param))
    yield request.param
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)


def feed(rows, path, cuts):
    """rows as files, one for each range of line_no, shuffled within it."""
    for i, (low, high) in enumerate(zip([-1, *cuts], [*cuts, 1 << 40], strict=True)):
        rows.where(f"line_no > {low} AND line_no <= {high}").orderBy("line").coalesce(1).write.parquet(f"{path}/{i}")


def drained(spark, frame, tmp_path):
    query = frame.writeStream.format("parquet").option("checkpointLocation", f"{tmp_path}/state").option("path", f"{tmp_path}/out").trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.parquet(f"{tmp_path}/out")


def stream(spark, schema, path):
    return spark.readStream.schema(schema).option("recursiveFileLookup", True).option("maxFilesPerTrigger", 1).parquet(path)


def lines_of(spark, n, seed, column="dataset"):
    rng = random.Random(seed)
    rows = [(rng.choice("xy"), i, " ".join(rng.choice(["a", "b", "1", "22", "7", "x.y"]) for _ in range(rng.randint(1, 5)))) for i in range(n)]
    return spark.createDataFrame(rows, f"{column} string, line_no long, line string")


def test_streams_like_batches(spark, tmp_path, chunks):
    """Three micro-batches, the last of them after a restart from the checkpoint; ids given twice are those of the batch."""
    lines = lines_of(spark, 900, 3)
    run = lambda: drained(spark, templates.parse_stream(stream(spark, lines.schema, f"{tmp_path}/in"), canonical_masks()[:1], depth=2), tmp_path)
    feed(lines.where("line_no < 600"), f"{tmp_path}/in", [299])
    known = templates.dense_ids(run()).cache()
    assert known.count() > 3
    lines.where("line_no >= 600").orderBy("line").coalesce(1).write.parquet(f"{tmp_path}/in/late")
    got = run()
    ids = templates.dense_ids(got, known)
    batch = {(r.dataset, r.line_no): (r.cluster_id, r.template) for r in clustering.parse(lines, canonical_masks()[:1], depth=2).collect()}
    rows = got.join(ids, ["dataset", "cluster"]).collect()
    assert len(rows) == 900 and all(batch[r.dataset, r.line_no][0] == r.cluster_id for r in rows)
    last = {}
    for r in sorted(rows, key=lambda r: r.line_no):
        last[r.dataset, r.cluster_id] = r.template
    assert {(d, i): t for (d, _), (i, t) in batch.items()} == last


def test_demo_stream(spark, tmp_path):
    lines = demo_lines(spark)
    feed(lines, f"{tmp_path}/in", [6])
    got = drained(spark, templates.parse_stream(stream(spark, lines.schema, f"{tmp_path}/in"), canonical_masks()), tmp_path).collect()
    batch = {r.line_no: r.cluster_id for r in clustering.parse(lines, canonical_masks()).collect()}
    assert len(got) == 14 and len({(batch[r.line_no], r.cluster) for r in got}) == 6


def test_online_stream(spark, tmp_path, chunks):
    lines = lines_of(spark, 600, 8, "source")
    feed(lines, f"{tmp_path}/in", [250])
    run = lambda: drained(spark, templates.online_stream(stream(spark, lines.schema, f"{tmp_path}/in")), tmp_path)
    run()
    more = lines.selectExpr("source", "line_no + 600 AS line_no", "line")
    more.coalesce(1).write.parquet(f"{tmp_path}/in/late")
    got = {(r.source, r.line_no): (r.group_id, r.size, r.template) for r in run().collect()}
    expected = {(r.source, r.line_no): (r.group_id, r.size, " ".join(r.template)) for r in online.online_parse(lines.unionByName(more)).collect()}
    assert got == expected and len(got) == 1200


def test_micro_batches_follow_the_line_numbers(spark):
    """Also where the file of the first ones takes longest to write."""
    rows = spark.range(200).selectExpr("id AS line_no", "if(id < 100, repeat(uuid(), 50000), 'x') AS line")
    found = queries._streamed(spark, rows, "order", lambda s: s.select("line_no", F.current_timestamp().alias("at")), 2)
    times = [r.line_no for r in found.orderBy("at", "line_no").select("line_no").collect()]
    assert times == list(range(200)) and found.select("at").distinct().count() == 2


def test_records_of_a_growing_tree(spark, tmp_path):
    root, before = tmp_path / "in", spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "2048")
    try:
        for i, names in enumerate((("a.log", "sub/b.TXT"), ("c", "sub/deep/d.log"), ())):
            for name in names:
                (root / name).parent.mkdir(parents=True, exist_ok=True)
                (root / name).write_bytes("".join(f"{name} {j}\r\n\n" if j % 3 else f"{j}\rx{'y' * (j % 40)}\n" for j in range(400)).encode())
            sources.stream_records(spark, str(root), f"{tmp_path}/out", f"{tmp_path}/state", 1).awaitTermination()
            got = sorted(map(tuple, spark.read.parquet(f"{tmp_path}/out").drop("batch").collect()))
            assert got == sorted(map(tuple, sources.records(spark, str(root)).collect())) and len({r[1] for r in got}) == 2 * min(i + 1, 2)
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_console(spark, tmp_path):
    """The console is the JVM's, so only what the query says of itself is looked at."""
    lines = demo_lines(spark)
    feed(lines, f"{tmp_path}/in", [])
    query = sinks.show_stream(stream(spark, lines.schema, f"{tmp_path}/in").select("line"), 3)
    query.processAllAvailable()
    done = query.recentProgress
    query.stop()
    assert sum(p["numInputRows"] for p in done) == 14 and "Console" in done[-1]["sink"]["description"]
