from pyspark.sql import functions as F

from lodeline.functions import text
from lodeline.functions.patterns import Mask, canonical_masks, usable, validate_patterns

import pytest


def one(spark, column, **values):
    row = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} {'array<string>' if isinstance(v, list) else 'string'}" for k, v in values.items()))
    return row.select(column.alias("x")).first().x


def test_tokens(spark):
    assert one(spark, text.tokens(F.col("s")), s="  a  b\tc\n") == ["a", "b", "c"]
    assert one(spark, text.tokens(F.col("s")), s=" \t ") == []
    assert one(spark, text.tokens(F.col("s")), s="a\x1cb\xa0c") == ["a", "b", "c"]


def test_lines(spark):
    assert one(spark, text.split_lines(F.col("s")), s="a\r\nb\n\nc\x0bd e\n") == "a\r\nb\n\nc\x0bd e\n".splitlines()


def test_classes(spark):
    expected = {"2024-01-01T00:00:00": "TIMESTAMP", "192.168.1.10": "IPV4", "0xDEADBEEF": "HEX", "INFO": "LOGLEVEL", "/var/log/app.log": "PATH", "3.1415": "NUMBER", "hello": None}
    got = spark.createDataFrame([(k,) for k in expected], "t string").select("t", text.classify(F.col("t")).alias("c")).collect()
    assert {r.t: r.c for r in got} == expected
    assert one(spark, text.mask_tokens(F.col("a")), a=["INFO", "x", "7"]) == ["<LOGLEVEL>", "x", "<NUMBER>"]


def test_mask_order_matters(spark):
    line = "from 10.251.73.220:50010 ok"
    offline = [m for m in canonical_masks() if m.label == "NUMBER"] + canonical_masks()
    assert one(spark, text.apply_masks(F.col("s"), canonical_masks()), s=line) == "from <VAR:IPV4> ok"
    assert one(spark, text.apply_masks(F.col("s"), offline), s=line) == "from <VAR:IPV4>:<VAR:NUMBER> ok"


def test_unicode_masks(spark):
    assert one(spark, text.apply_masks(F.col("s"), canonical_masks()), s="é5 ٣ ² 7") == "é5 <VAR:NUMBER> ² <VAR:NUMBER>"


def test_group_names_and_bad_masks(spark):
    masks = usable(spark, [Mask("A", r"(?P<x>\d+)"), {"label": "B", "pattern": r"(?P<x>[a-z]+)"}, Mask("C", "(")])
    assert [m.label for m in masks] == ["A", "B"]
    assert one(spark, text.apply_masks(F.col("s"), masks[:1]), s="foo 42") == "foo <VAR:A>"
    with pytest.raises(ValueError):
        validate_patterns(["("])
    with pytest.raises(ValueError):
        validate_patterns(["a.*"], strict=True)
    with pytest.raises(TypeError):
        Mask.of({"label": "A", "pattern": "a"}, strict=True)
    assert Mask("ab-1 c", "x").placeholder == "<VAR:AB1C>" and Mask("é", "x").placeholder == "<VAR:VAR>"


def test_bucket_key(spark):
    key = text.bucket_key(F.col("a"), 3)
    assert one(spark, key, a=["<VAR:A>x<VAR:B>", "12", "-5", "z"]) == "<*> <*> -5"
    assert one(spark, text.wildcards(F.col("s")), s="a<VAR:X1>b <VAR:Y>") == "a<*>b <*>"


def test_pairs(spark):
    assert one(spark, text.merge_tokens(F.col("a"), F.col("b")), a=["x", "y", "z"], b=["x", "q"]) == ["x", "<*>"]
    assert one(spark, text.pair_template(F.col("a"), F.col("b")), a=["x"], b=["y"]) == []
    assert one(spark, text.jaccard(F.col("a"), F.col("b")), a=[], b=[]) == 1.0
    assert one(spark, text.similarity(F.col("a"), F.col("b")), a=["x", "<*>", "z", "w"], b=["x", "q"]) == 0.5


def test_scrub_and_time(spark):
    assert one(spark, text.scrub(F.col("s")), s="at /home/me/x by a.b@c.de hostname=h1,x") == "at /anon/path by anon@example.com hostname=anon,x"
    assert one(spark, text.after_time(F.col("s")), s="2026-04-13 10:15:23.123 [INFO]") == ".123 [INFO]"
    assert one(spark, text.after_time(F.col("s")), s="none") == "none"


def test_masks_are_tried_where_they_can_match(spark):
    """Masks behind their tests give what they give alone, also over other scripts' digits and placeholders of earlier masks."""
    import random

    from lodeline.functions.patterns import CLASSES, EXTRA, holds

    masks = [Mask(c, p) for c, p in {**CLASSES, **EXTRA}.items()] + [Mask("OWN", "q+"), Mask("A2031", r"zz")]
    assert all(holds(m) != ((), False) for m in masks if m.label not in ("LOGLEVEL", "OWN", "A2031")) and holds(masks[-1]) == ((), False)
    rng = random.Random(3)
    bits = ["2031-05-06 07:08:09", "10.0.0.1:80", "٣٤", "0xFF", " /a/b", "7.5", "a.b@c.de", "https://x.y/z", "aa:bb:cc:dd:ee:ff", "qq", "zz", "INFO", "é", " ", "-", ":", "1f0c94ab-12cd-34ef-56ab-7890abcdef12", "x", "<VAR:"]
    lines = spark.createDataFrame([("".join(rng.choice(bits) for _ in range(rng.randint(0, 7))),) for _ in range(500)], "line string")
    for order in (masks, masks[::-1]):
        alone = F.col("line")
        for m in order:
            alone = F.regexp_replace(alone, m.java, m.placeholder)
        rows = lines.select(text.apply_masks(F.col("line"), order).alias("masked"), alone.alias("alone"))
        assert rows.where("masked <> alone").count() == 0 and rows.where("masked LIKE '%<VAR:N%'").count() > 50


def test_sql_functions(spark):
    """The functions in SQL give what the expressions give; a line may be blank or null."""
    from lodeline.functions import sql
    from lodeline.operators import clustering

    lines = ["at 10.0.0.1:80 it's \\d+ 'quoted' 0xFF", "a  7\tb", "", "  ", "/home/x by a.b@c.de hostname=h", None, "é5 ٣"]
    rows = spark.createDataFrame([("d", i, x) for i, x in enumerate(lines)], "dataset string, line_no long, line string")
    rows.createOrReplaceTempView("own_lines")
    for masks, depth in ((canonical_masks(), 5), ([Mask("Q", r"it's|\\\\d")], 1)):
        assert sql.register(spark, masks, depth)[0] == "mask_line"
        got = spark.sql("SELECT line_no, mask_line(line), line_tokens(line), bucket_key(line), normalise_line(line), scrub_line(line) FROM own_lines WHERE line IS NOT NULL").collect()
        keyed = clustering.bucketed(rows, masks, depth).select("line_no", text.apply_masks(F.col("line"), masks), F.split("masked", " "), "key", text.normalise(F.col("line")), text.scrub(F.col("line"))).where("line IS NOT NULL")
        assert sorted(map(tuple, got)) == sorted(map(tuple, keyed.collect()))
    assert spark.sql("SELECT mask_line(NULL) AS x").first().x is None
