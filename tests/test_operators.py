import ast
import json

import pytest
from pyspark.sql import functions as F

from lodeline.functions.patterns import CLASSES, Mask
from lodeline.operators import alignment, metrics, online, sampling, synthesis
from lodeline.plans import evaluation, reports
from lodeline.queries import queries
from lodeline.sources import lines as sources
from lodeline.sources import sinks


def frame(spark, lines, dataset="d"):
    return spark.createDataFrame([(dataset, i, x) for i, x in enumerate(lines)], "dataset string, line_no long, line string")


def clusters(spark, ids, dataset="d"):
    return spark.createDataFrame([(dataset, i, x, x) for i, x in enumerate(ids)], "dataset string, line_no long, cluster_id string, template string")


def sampled(spark, lines, k):
    return [r.line_no for r in sampling.entropy_greedy_sample(frame(spark, lines), k).orderBy("rank").collect()]


def test_sampling(spark):
    alike = ["door 7 opened by badge k-113"] * 5 + ["TRACE gc pause 0x2F00 took /proc/self 12 ticks"]
    assert sorted(sampled(spark, alike, 2)) == [0, 5]
    assert sampled(spark, ["up up up", "tar pitch resin wax"], 1) == [1]
    assert sampled(spark, ["x", "x", "y"], 3) == [0, 1, 2]
    assert sampled(spark, ["x"], 0) == []


def test_sampling_like_plain(spark):
    import math
    import random
    import re
    from collections import Counter

    rng = random.Random(5)
    lines = [" ".join(rng.choice("abcdefgh") for _ in range(rng.randint(1, 7))) for _ in range(200)]
    tokens = [re.findall(r"[A-Za-z0-9_./:%@#-]+", x) for x in lines]
    bits = [round(-sum(n / len(t) * math.log2(n / len(t)) for n in Counter(t).values()), 12) for t in tokens]
    chosen = []
    for i in sorted(range(len(lines)), key=lambda i: (-bits[i], i)):
        own = set(tokens[i])
        if len(chosen) < 30 and all(len(own & set(tokens[j])) / len(own | set(tokens[j])) < 0.8 for j in chosen):
            chosen.append(i)
    assert sampled(spark, lines, 30) == chosen


def test_accuracy(spark):
    ga = lambda t, p: metrics.grouping_accuracy(clusters(spark, t), clusters(spark, p)).first().GA
    assert ga("aaabb", "xxyyy") == 0.0 and ga("aabbc", "xxyyz") == 1.0 and ga("aaaa", "xxyy") == 0.0 and ga("aabb", "xxyz") == 0.5
    assert metrics.parsing_accuracy(clusters(spark, ["foo", "bar"]), clusters(spark, ["foo", "baz"])).first().PA == 0.5
    with pytest.raises(ValueError):
        metrics.grouping_accuracy(clusters(spark, "ab"), clusters(spark, "a"))
    rows = metrics.with_macro_average(metrics.scores(clusters(spark, "ab"), clusters(spark, "ab"), "m"))
    assert {r.dataset for r in rows.collect()} == {"d", "MacroAvg"}
    assert metrics.with_macro_average(rows.where("1 = 0")).count() == 0


def test_synthesis(spark):
    shown = ["pointer 0xAB", "id 123e4567-e89b-12d3-a456-426614174000", "file /var/x", "mail a.b@c.de", "see https://x.y/z"]
    labels = [m.label for m in synthesis.synth_masks(frame(spark, shown))]
    assert labels == ["TIMESTAMP", "LOGLEVEL", "NUMBER", "IPV4", "EMAIL", "HEX", "PATH", "URL", "UUID"]
    for bad in ({"sample_size": 0}, {"mode": "x"}, {"mode": "provider"}):
        with pytest.raises(ValueError):
            synthesis.synth_masks(frame(spark, shown), **bad)
    with pytest.raises(ValueError):
        synthesis.synth_masks(frame(spark, shown).where("1 = 0"))


def test_model_answers():
    assert synthesis.read_pattern_list('text [r"\\d+", "a"] more') == ["\\d+", "a"]
    assert synthesis.read_pattern_list('r"\\d+", and r"b" [oops') == ["\\d+", "b"]
    assert synthesis.read_pattern_list("r'a\"b' or r\"c'd\"") == ['a"b', "c'd"] and synthesis.read_pattern_list("nothing") == []
    labels = {p: synthesis.label_of(p, 3) for p in [*CLASSES.values(), r"\S+", "cat", r"\d+\.\d+", r"(?P<h>0x[a-f0-9]+)"]}
    assert list(labels.values()) == [*CLASSES, "VAR3", "VAR3", "VAR3", "VAR3"][: len(CLASSES)] + ["VAR3", "VAR3", "VAR3", "HEX"]
    masks = synthesis.masks_of_patterns(["", r"\d+", r"\d+", "(", "0x[0-9a-f]+", "zz"])
    assert [(m.label, m.pattern) for m in masks] == [("NUMBER", r"\d+"), ("HEX", "0x[0-9a-f]+"), ("VAR5", "zz")]
    calls = []
    got = synthesis.provided(["l"], lambda line, attempt: calls.append(attempt) or ("" if attempt == 0 else r'[r"blk_\d+"]'))
    assert calls == [0, 1] and [m.label for m in got] == ["BLK", "TIMESTAMP", "LOGLEVEL", "NUMBER", "IPV4"]


def test_provider_on_executors(spark):
    """Answers of a provider that is called in tasks give the masks that provided() makes of each dataset's lines."""

    def answer(line, attempt):
        if line.startswith("late") and attempt == 0:
            return "nothing yet"
        return {"a": r'[r"\d+", r"x-\d+"]', "b": r"""r'(' and r'\d+' or r"blk_\d+" """, "c": "no idea"}.get(line[-1], r'["0x[0-9a-f]+", "", "zz"]')

    lines = {"one": ["1 a", "late b", "c", "2 a"], "two": ["late c", "q"], "none": ["c"]}
    rows = spark.createDataFrame([(d, i, x) for d, own in lines.items() for i, x in enumerate(own)], "dataset string, line_no long, line string").repartition(4)
    answers = synthesis.answered(rows, answer)
    assert {(r.dataset, r.line_no): r.attempt for r in answers.collect()} == {(d, i): int(x.startswith("late") or answer(x, 1) == "no idea") for d, own in lines.items() for i, x in enumerate(own)}
    got = {}
    for r in synthesis.provider_masks(answers).orderBy("dataset", "ord").collect():
        got.setdefault(r.dataset, []).append((r.label, r.pattern))
    assert got == {d: [(m.label, m.pattern) for m in synthesis.provided(own, answer)] for d, own in lines.items()}
    assert synthesis.provider_masks(answers.where("dataset = 'x'")).count() == 0


def test_alignment(spark):
    rows = [("Node 1 drops block blk_271828182845 now", "Node <*> drops block <*> now"), ("x", "y <*>"), (" a ", "a"), ("q.$^\\E z", "q.$^\\E <*>")]
    got = spark.createDataFrame(rows, "line string, template string").select(alignment.slot_values(F.col("line"), F.col("template")).alias("v")).collect()
    assert [r.v for r in got] == [["1", "blk_271828182845"], None, [], ["z"]]
    values = {"081109": r"\d{6}", "081109 203518": r"\d{6}\s+\d{6}", "blk_-7": r"blk_-?\d+", "a1": r"[\w.\-:/]+", "abc": r"[^\s]+", "10.0.0.1:80": CLASSES["IPV4"]}
    got = spark.createDataFrame([(v,) for v in values], "v string").select("v", alignment.value_pattern(F.col("v")).alias("p")).collect()
    assert {r.v: r.p for r in got} == values


def test_training_examples(spark):
    lines = frame(spark, [f"Responder {i} for block blk_{i} ending" for i in range(3)] + ["other"]).withColumn("template", F.lit("Responder <*> for block <*> ending"))
    rows = alignment.training_examples(lines, max_per_dataset=2).orderBy("line_no").collect()
    assert [r.line_no for r in rows] == [0, 1]
    assert eval(rows[0].output) == [r"-?\d+(?:\.\d+)?", r"blk_-?\d+"]
    assert alignment.training_examples(lines.where("line_no < 3"), entropy_k=1).count() == 1


def test_literals_of_whole_pages(spark, tmp_path):
    pages = ["a" * 300 + '"', "b" * 300 + "\\", "c" * 119 + "\\" + "d", "", 'e"']
    spark.createDataFrame(list(enumerate(pages)), "page_id long, html string").write.parquet(f"{tmp_path}/pages.parquet")
    got = {r.page_id: (r.literal, r.list) for r in queries()["raw_literals"](spark, str(tmp_path)).collect()}
    assert {i: ast.literal_eval(x) for i, (x, _) in got.items()} == dict(enumerate(pages))
    assert {i: ast.literal_eval(x) for i, (_, x) in got.items()} == {i: ["a\\", p] for i, p in enumerate(pages)}
    assert [got[i][0][0] for i in range(5)] == ['"', '"', "r", "r", '"']


def test_online(spark):
    lines = ["a b c", "a x c", "d b c", "", "d q r"]
    rows = online.online_parse(frame(spark, lines).withColumnRenamed("dataset", "source")).orderBy("line_no").collect()
    assert [(r.line_no, r.size, " ".join(r.template)) for r in rows] == [(0, 2, "a b c"), (1, 3, "a <*> c"), (2, 4, "<*> <*> c"), (4, 5, "<*> <*> <*>")]
    assert len({r.group_id for r in rows}) == 1
    logs = ["2026-04-13 10:15:23.123 T temp", "2026-04-13 10:15:23.100 T temp", "2026-04-13 10:15:23.123 T TEMP"]
    assert {(r.prefix, r.n_lines) for r in online.prefix_groups(frame(spark, logs)).collect()} == {(".12", 2), (".10", 1)}


def test_files(spark, tmp_path):
    for name, body in (("A", "x 1\n\ny 2\r\n"), ("B", "z\x0bw")):
        (tmp_path / name).mkdir()
        (tmp_path / name / "raw.log").write_bytes(body.encode())
        entries = [{"cluster_id": i, "template": t} for i, t in enumerate(("x <*>", "y <*>"))]
        (tmp_path / name / "templates.json").write_text(json.dumps({"entries": entries} if name == "A" else entries[:1]))
    lines = sources.corpus(spark, str(tmp_path))
    assert sorted(map(tuple, lines.collect())) == [("A", 0, "x 1"), ("A", 1, "y 2"), ("B", 0, "z"), ("B", 1, "w")]
    truth = sources.ground_truth(spark, str(tmp_path))
    assert sorted(map(tuple, truth.collect())) == [("A", 0, 0, "x <*>"), ("A", 1, 1, "y <*>"), ("B", 0, 0, "x <*>")]
    rows = evaluation.evaluate(lines, truth, evaluation.Settings(k=5))
    assert {r.dataset: r.GA for r in rows.collect()} == {"A": 1.0, "B": 1.0, "MacroAvg": 1.0}
    made = sources.manifest(lines, truth).where("name = 'A'").first()
    import hashlib

    assert (made.logs, made.templates, made.checksum) == (2, 2, hashlib.sha256(b"x 1\ny 2").hexdigest())
    found = sorted((r.text, r.format_hint) for r in sources.records(spark, str(tmp_path / "A")).where("format_hint = '.log'").collect())
    assert found == [("", ".log"), ("x 1", ".log"), ("y 2", ".log")]
    assert sinks.write_masks(spark, [Mask("A", "a")], str(tmp_path / "m")) == 1
    assert sources.read_masks(spark, str(tmp_path / "m"), strict=True) == [Mask("A", "a")]
    sinks.write_parsed_csv(lines.withColumn("template", F.lit('a "q"')), str(tmp_path / "p"))
    back = spark.read.csv(str(tmp_path / "p"), header=True, escape='"').collect()
    assert {tuple(r) for r in back} == {(x, 'a "q"') for x in ("x 1", "y 2", "z", "w")}
    (tmp_path / "s.csv").write_text('Content,EventTemplate\n"a ""1""",T1\n,T9\nb,T2\nc,T1\n')
    assert [(r.line, r.cluster_id) for r in sources.structured(spark, str(tmp_path / "s.csv"), "s").orderBy("line_no").collect()] == [('a "1"', 0), ("b", 1), ("c", 0)]


def test_tables(spark, tmp_path):
    (tmp_path / "m.csv").write_text("dataset,method,GA,PA\nd,x,0.3505,1\n")
    (tmp_path / "t.csv").write_text("dataset,seconds,n_logs\nd,1.23456,10\n")
    assert reports.build_tables(spark, [str(tmp_path / "m.csv"), str(tmp_path / "t.csv")], str(tmp_path / "out")) == ["table_I.tex", "table_II.tex"]
    assert r"d & x & 0.350 & 1.000 \\" in (tmp_path / "out/table_I.tex").read_text()
    assert r"d & 1.235 & 10.000 \\" in (tmp_path / "out/table_II.tex").read_text()


def test_timing(spark):
    row = evaluation.timing(frame(spark, ["a 1", "a 2", "b"]), [Mask("N", r"\d+")], 2).first()
    assert row.n_logs == 2 and row.seconds > 0


class PlainGroups:
    """The online parser of one source, every group looked at."""

    def __init__(self, threshold):
        self.threshold, self.groups, self.cache = threshold, [], {}

    def add(self, tokens):
        key, at, best = (tokens[0], len(tokens)), None, 0.0
        if key in self.cache:
            at = self.cache[key]
        else:
            for i, template in enumerate(self.groups):
                share = sum(a in (b, "<*>") for a, b in zip(template, tokens, strict=False)) / len(template)
                if share > best:
                    best, at = share, i
            if best <= self.threshold:
                at = len(self.groups)
                self.groups.append(tokens)
        self.cache[key] = at
        self.groups[at] = [a if a == b else "<*>" for a, b in zip(self.groups[at], tokens, strict=False)]
        return at, self.groups[at]


@pytest.mark.parametrize("threshold", [0.6, 0.3, 0.9])
def test_online_index_like_plain_scan(threshold):
    import random

    rng = random.Random(int(threshold * 10))
    own, expected = online.Groups("s", threshold), PlainGroups(threshold)
    for n in range(3000):
        tokens = [rng.choice(["<*>", *"abcdefgh"]) if rng.random() < 0.7 else f"v{rng.randrange(400)}" for _ in range(rng.randint(1, 9))]
        at = own.add(n, tokens)
        assert (at, own.template(at)) == expected.add(tokens)
    again = online.Groups("s", threshold, [(i, own.template(n), own.sizes[n]) for n, i in enumerate(own.ids)], own.cache)
    for n in range(300):
        tokens = [rng.choice("abcdefgh") for _ in range(rng.randint(1, 9))]
        at = again.add(n, tokens)
        assert (at, again.template(at)) == expected.add(tokens)


def test_online_with_many_groups():
    """Ten thousand groups: a record that isn't cached costs little more than one of a small state."""
    import time

    state, took = online.Groups("s", 0.6), []
    for part in range(2):
        began = time.perf_counter()
        for n in range(5000):
            i = part * 5000 + n
            state.add(i, [f"k{i}", f"a{i}", f"b{i}", f"c{i}", "same", "same"])
        took.append(time.perf_counter() - began)
    assert len(state.ids) == 10_000 and took[1] < 30
