import hashlib
import json
import logging

import pytest
from lodeline import cli, logs
from lodeline.functions.tables import shared_dir
from lodeline.operators import sampling, synthesis
from lodeline.plans import evaluation
from lodeline.sources import lines as sources
from lodeline.sources import sinks


def test_files_in_splits(spark, tmp_path):
    """Small splits, several files of a dataset, every kind of line break: numbers are those of a plain reader."""
    (tmp_path / "A").mkdir()
    (tmp_path / "A/raw.log").write_bytes("\n".join(f"line {i}\x0bpart\x85{'x' * (i % 50)}\r" if i % 5 else " " for i in range(3000)).encode())
    (tmp_path / "B/raw.log").mkdir(parents=True)
    for i in range(3):
        (tmp_path / f"B/raw.log/part-{i}.txt").write_text("".join(f"{i} {j}\n" for j in range(40)))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    try:
        got = {(r.dataset, r.line_no): r.line for r in sources.corpus(spark, str(tmp_path)).collect()}
        plain = [x for x in (tmp_path / "A/raw.log").read_bytes().decode().splitlines() if x.strip()]
        assert got == {("A", i): x for i, x in enumerate(plain)} | {("B", 40 * i + j): f"{i} {j}" for i in range(3) for j in range(40)}
        (tmp_path / "r").mkdir()
        (tmp_path / "r/x.TXT").write_bytes(b"a\r\r\nb\rc \n\n d" * 900)
        with open(tmp_path / "r/x.TXT", encoding="utf-8") as f:
            plain = [x.strip() for x in f]
        rows = sorted(sources.records(spark, str(tmp_path / "r")).collect(), key=lambda r: r.line_no)
        assert [r.text for r in rows] == plain and [r.line_no for r in rows] == list(range(len(plain)))
        assert {r.format_hint for r in rows} == {".txt"} and len({r.record_id for r in rows}) == len(rows)
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_datasets_written_and_read(spark, tmp_path):
    assert evaluation.write_demo(spark, str(tmp_path)) == sources.DEMO
    lines, truth = sources.corpus(spark, str(tmp_path)), sources.ground_truth(spark, str(tmp_path))
    assert sorted(map(tuple, lines.collect())) == sorted(map(tuple, sources.demo_lines(spark).collect()))
    assert [r.cluster_id for r in truth.orderBy("line_no").collect()] == [0, 0, 0, 1, 1, 2, 2, 3, 3, 3, 4, 4, 5, 5]
    about = spark.read.json(f"{tmp_path}/{sources.DEMO}/manifest.json").first()
    assert (about.name, about.logs, about.templates) == (sources.DEMO, 14, 6)


def test_small_formats(spark, tmp_path, capsys):
    rows = spark.createDataFrame([(1, "é"), (2, 'q"')], "a long, b string")
    assert sinks.write_jsonl(rows, f"{tmp_path}/j") == 2
    assert sorted(map(tuple, sources.read_jsonl(spark, f"{tmp_path}/j", "a long, b string").collect())) == [(1, "é"), (2, 'q"')]
    (tmp_path / "blank.jsonl").write_text('{"a": 1}\n\n{"a": 2}\n')
    assert [r.a for r in sources.read_jsonl(spark, f"{tmp_path}/blank.jsonl", "a long").where("a IS NOT NULL").collect()] == [1, 2]
    (tmp_path / "raw.txt").write_text("see /home/x/y, a.b@c.de hostname=h1, ok\n\n")
    sinks.scrub_files(spark, f"{tmp_path}/raw.txt", f"{tmp_path}/clean")
    assert [r.value for r in spark.read.text(f"{tmp_path}/clean").collect()][0] == "see /anon/path, anon@example.com hostname=anon, ok"
    sinks.show(rows)
    assert "é" in capsys.readouterr().out


def test_structured_csv_in_splits(spark, tmp_path):
    """Several files in small splits, quoted line breaks, quotes and commas, blank contents, both line ends: ids of a plain reader."""
    import csv
    import random

    rng, expected, ids = random.Random(4), [], {}
    n = 0
    for f in range(3):
        with open(tmp_path / f"{f}.csv", "w", newline="", encoding="utf-8") as out:
            writer = csv.writer(out, lineterminator="\r\n" if f == 1 else "\n", quoting=csv.QUOTE_MINIMAL)
            writer.writerow(["LineId", "Content", "EventTemplate"])
            for i in range(700):
                content = "" if rng.random() < 0.1 else "".join(rng.choice(["word ", '"', ",", "\n", '\n"x"\n', "é", "long" * 20]) for _ in range(rng.randint(1, 6))).strip() or "x"
                template = f"T{rng.randrange(40)}"
                writer.writerow([i, content, template])
                if content:
                    expected.append((n, content, template, ids.setdefault(template, len(ids))))
                n += 1
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "3000")
    try:
        got = sources.structured(spark, str(tmp_path), "d")
        assert sorted((r.line_no, r.line, r.template, r.cluster_id) for r in got.collect()) == expected
        (tmp_path / "3.csv").write_text("Content,LineId,EventTemplate\na,1,b\n")
        with pytest.raises(Exception, match="another header"):
            sources.structured(spark, str(tmp_path), "d").collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_many_datasets_in_few_jobs(spark, tmp_path):
    """As many jobs for three hundred datasets as for two, and what is read back is what was written."""

    def jobs(n):
        rows = [(f"ä {d}=%", i, f"{d} line {i}") for d in range(n) for i in range(1 + d % 4)]
        lines = spark.createDataFrame(rows, "dataset string, line_no long, line string").repartition(3)
        truth = lines.selectExpr("dataset", "line_no", "line_no % 2 AS cluster_id", "concat('t ', line) AS template")
        spark.sparkContext.setJobGroup(f"write {n}", "")
        names = sinks.write_datasets(lines, f"{tmp_path}/{n}", truth)
        found = len(spark.sparkContext.statusTracker().getJobIdsForGroup(f"write {n}"))
        spark.sparkContext.setJobGroup("", "")
        assert names == sorted({r[0] for r in rows})
        assert sorted(map(tuple, sources.corpus(spark, f"{tmp_path}/{n}").collect())) == sorted(rows)
        back = sources.ground_truth(spark, f"{tmp_path}/{n}").select("dataset", "line_no", "cluster_id", "template").collect()
        assert sorted(map(tuple, back)) == sorted((d, i, i % 2, f"t {x}") for d, i, x in rows)
        return found

    assert jobs(2) == jobs(300)


def test_truth_as_one_value(spark, tmp_path):
    """Entries in the order of lines, with quotes, line breaks and nulls in templates."""
    rows = [(d, i, i % 3, None if i == 4 else f'{d} "{i}"\n<*>') for d in ("a b", "é") for i in range(7)]
    truth = spark.createDataFrame(rows, "dataset string, line_no long, cluster_id long, template string").repartition(3)
    sinks.write_datasets(truth.selectExpr("dataset", "line_no", "'x' AS line"), str(tmp_path), truth, whole_truth=True)
    assert len(list((tmp_path / "é/templates.json").glob("part-*"))) == 1 and not (tmp_path / "é/templates.jsonl").exists()
    back = sources.ground_truth(spark, str(tmp_path)).select("dataset", "line_no", "cluster_id", "template").collect()
    assert sorted(map(tuple, back), key=lambda r: r[:2]) == rows


def test_counts_are_taken_while_writing(spark, tmp_path):
    scans = spark.sparkContext.accumulator(0)
    rows = spark.createDataFrame([(i,) for i in range(50)], "a long").rdd.map(lambda r: (scans.add(1), r)[1]).toDF("a long")
    assert sinks.write_jsonl(rows, f"{tmp_path}/j") == 50 and scans.value == 50


def test_command_line(spark, tmp_path, capsys):
    run = lambda *args: cli.main([str(a) for a in args])
    data = ["--root", tmp_path / "d", "--dataset", sources.DEMO]
    assert run("demo", tmp_path / "d") == 0 and run("synth", *data, "--out", tmp_path / "m") == 0
    masks = tmp_path / "m" / sources.DEMO
    assert run("parse", *data, "--masks", masks, "--out", tmp_path / "p", "--show", 2) == 0 and run("eval", *data, "--truth", "--out", tmp_path / "e") == 0
    assert {r.GA for r in spark.read.csv(f"{tmp_path}/e", header=True).collect()} == {"1.0"}
    assert spark.read.csv(f"{tmp_path}/p", header=True, escape='"').count() == 14
    assert run("time", *data, "--masks", masks, "--out", tmp_path / "t", "--n", 5) == 0 and spark.read.csv(f"{tmp_path}/t", header=True).first().n_logs == "5"
    assert run("examples", *data, "--out", tmp_path / "x", "--max", 3) == 0 and spark.read.json(f"{tmp_path}/x").count() == 3
    assert run("table", next((tmp_path / "e").glob("*.csv")), "--out", tmp_path / "tables") == 0
    (tmp_path / "s.txt").write_text("/a/b")
    assert run("scrub", tmp_path / "s.txt", "--out", tmp_path / "clean") == 0
    assert "Completed" in capsys.readouterr().out and json.loads(next(masks.glob("part*")).read_text().replace("\n", ""))[0]["label"] == "TIMESTAMP"


def test_messages_go_to_a_file(tmp_path):
    root, before, level = logging.getLogger(), list(logging.getLogger().handlers), logging.getLogger().level
    path = logs.to_file(str(tmp_path / "l"), "run")
    logging.getLogger("x").debug("kept")
    for handler in [h for h in root.handlers if h not in before]:
        handler.close()
        root.removeHandler(handler)
    root.setLevel(level)
    assert "DEBUG x: kept" in path.read_text()


def test_samples_of_many_datasets(spark):
    rows = [(f"d{n}", i, f"w{i * (n + 1) % 23} {'x' * (i % 9)} v{i % 7} {i % 5}z") for n in range(6) for i in range(3 + 30 * n)]
    lines = spark.createDataFrame(rows, "dataset string, line_no long, line string")
    every = sorted(map(tuple, sampling.entropy_greedy_sample(lines, 8).collect()))
    each = sorted(tuple(r) for n in range(6) for r in sampling.entropy_greedy_sample(lines.where(f"dataset = 'd{n}'"), 8).collect())
    assert every == each and len({r[1] for r in every}) == 6
    masks = synthesis.synth_masks_by_dataset(lines, 8)
    assert masks == {f"d{n}": synthesis.synth_masks(lines.where(f"dataset = 'd{n}'"), 8) for n in range(6)}
    assert [m.label for m in synthesis.synthesize_offline(lines, require_core=False)] == []


def test_shared_folder(spark):
    class Session:
        def __init__(self, **conf):
            self.conf = conf

    assert shared_dir(Session(**{"spark.checkpoint.dir": "hdfs://x/c/", "spark.master": "yarn"})) == "hdfs://x/c"
    with pytest.raises(ValueError, match="checkpoint"):
        shared_dir(Session(**{"spark.master": "yarn"}))


def test_no_value_holds_a_dataset(spark, tmp_path):
    """Neither a dataset's lines nor its truth are one value on the way to its files; the checksum and the file are those of such a value."""
    rows = [(d, i, None if i == 7 else f"{d} ü {i * 7 % 50}", i % 3, f"t {i % 3}") for d in "xy" for i in range(50)]
    frame = spark.createDataFrame(rows, "dataset string, line_no long, line string, cluster_id long, template string").repartition(5)
    about = sources.manifest(frame)
    assert "collect_list" not in about._jdf.queryExecution().toString()
    wanted = {d: hashlib.sha256("\n".join(r[2] for r in rows if r[0] == d and r[2]).encode()).hexdigest() for d in "xy"}
    assert {r.name: (r.logs, r.checksum) for r in about.collect()} == {d: (50, h) for d, h in wanted.items()}
    sinks.write_datasets(frame.select("dataset", "line_no", "line").where("line IS NOT NULL"), str(tmp_path), frame.select("dataset", "line_no", "cluster_id", "template"), whole_truth=True)
    written = (next((tmp_path / "x/templates.json").glob("part-*"))).read_text()
    assert json.loads(written) == {"entries": [{"cluster_id": i % 3, "template": f"t {i % 3}"} for i in range(50)]} and max(map(len, written.splitlines())) < 60
