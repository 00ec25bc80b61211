"""Queries of the log operators over the driver's tables, and the DuckDB SQL that gives the same rows.

Log lines come from the lines of `documents`, from `events` (one line each) and from `conversations`.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .functions import sql, text
from .functions.patterns import CLASSES, CORE, EXTRA, Mask, canonical_masks, usable
from .functions.tables import keep, names, rename, shared_dir
from .operators import alignment, clustering, metrics, online, sampling, synthesis
from .plans import evaluation, reports
from .sources import lines as sources
from .sources import sinks
from .streaming import templates

_LINE_TABLES = {"documents": ("doc_id", "text"), "pages": ("page_id", "url")}
LEVELS = ("INFO", "WARN", "ERROR", "DEBUG")
OFFLINE = [Mask(c, CLASSES.get(c) or EXTRA[c]) for c in (*CORE, "HEX", "PATH")]
EVENT_TEMPLATE = "<*> <*> <*> user <*> value <*>"


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _doc_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sources.lines_of(_table(spark, sf_dir, "documents"), "doc_id", dataset="documents")


def _event_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """`ts LEVEL type user N value X` for each event; the level follows the event's number."""
    e = _table(spark, sf_dir, "events")
    level = F.element_at(F.array(*map(F.lit, LEVELS)), (F.col("event_id") % 4 + 1).cast("int"))
    parts = [F.date_format("ts", "yyyy-MM-dd HH:mm:ss"), level, F.col("event_type"), F.lit("user"), F.col("user_id").cast("string"), F.lit("value"), F.col("value").cast("decimal(12,2)").cast("string")]
    return e.select(F.lit("events").alias("dataset"), F.col("event_id").alias("line_no"), F.concat_ws(" ", *parts).alias("line"))


def _talk_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns of each conversation as a dataset."""
    t = _table(spark, sf_dir, "conversations").where("trim(text) <> ''")
    return t.select(F.col("conv_id").cast("string").alias("dataset"), F.col("turn").alias("line_no"), F.col("text").alias("line"))


def _event_truth(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Event lines grouped by type as their truth, and by level as a prediction of it."""
    e = _event_lines(spark, sf_dir)
    part = lambda i: F.element_at(F.split("line", " "), i)
    return e.select("line_no", F.concat(F.lit("u"), (part(6).cast("long") % 10).cast("string")).alias("dataset"), part(4).alias("kind"), F.when(part(3) == "WARN", "ERROR").otherwise(part(3)).alias("level"))


def lines_split(spark, sf_dir):
    return _doc_lines(spark, sf_dir).select("line_no", "line")


def tokenize(spark, sf_dir):
    return _doc_lines(spark, sf_dir).select("line_no", F.posexplode(text.tokens(F.col("line"))).alias("pos", "token")).select("line_no", F.col("pos").cast("long"), "token")


def token_stats(spark, sf_dir):
    """Tokens are counted in their lines first, mostly before the shuffle, since a line's tokens are in one task."""
    found = _doc_lines(spark, sf_dir).select("line_no", F.explode(text.tokens(F.col("line"))).alias("token"))
    return found.groupBy("token", "line_no").agg(F.count("*").alias("n")).groupBy("token").agg(F.sum("n").alias("n"), F.count("*").alias("n_lines"))


def mask_canonical(spark, sf_dir):
    return _doc_lines(spark, sf_dir).select("line_no", text.apply_masks(F.col("line"), canonical_masks()).alias("masked"))


def mask_offline(spark, sf_dir):
    return _event_lines(spark, sf_dir).select("line_no", text.apply_masks(F.col("line"), OFFLINE).alias("masked"))


def bucket_keys(spark, sf_dir):
    keyed = clustering.bucketed(_doc_lines(spark, sf_dir), canonical_masks())
    return keyed.groupBy("key", F.col("n_tokens").cast("long").alias("n_tokens")).agg(F.count("*").alias("n_lines"))


def sql_functions(spark, sf_dir):
    """Masked documents' lines, their buckets and what is normalised and scrubbed in them, in SQL."""
    sql.register(spark, canonical_masks())
    spark.read.parquet(f"{sf_dir}/documents.parquet").createOrReplaceTempView("lodeline_documents")
    return spark.sql(r"""
        WITH l AS (SELECT doc_id * 4294967296 + n AS line_no, line FROM (SELECT doc_id, posexplode(split(text, '\n')) AS (n, line) FROM lodeline_documents) WHERE rlike(line, r'[^\s\x1c-\x1f]'))
        SELECT line_no, mask_line(line) AS masked, bucket_key(line) AS key, CAST(size(line_tokens(line)) AS BIGINT) AS n_tokens, normalise_line(line) AS normal, scrub_line(line) AS scrubbed FROM l""")


def template_mine_events(spark, sf_dir):
    return clustering.clusters(_event_lines(spark, sf_dir), OFFLINE).select("cluster_id", "template", "template_typed", F.col("size").alias("n_lines"))


def cluster_sizes(spark, sf_dir):
    return clustering.clusters(_event_lines(spark, sf_dir), canonical_masks()).select("cluster_id", "first_line", "size")


def num_clusters(spark, sf_dir):
    return clustering.clusters(_event_lines(spark, sf_dir), canonical_masks()).groupBy("dataset").agg(F.countDistinct("cluster_id").alias("n_clusters"))


def drain_parse_events(spark, sf_dir):
    return clustering.parse(_event_lines(spark, sf_dir), OFFLINE).select("line_no", "cluster_id", "template")


def typed_templates(spark, sf_dir):
    return clustering.parse(_event_lines(spark, sf_dir), canonical_masks()).groupBy("template_typed").agg(F.count("*").alias("n_lines"))


def drain_parse_documents(spark, sf_dir):
    return clustering.parse(_doc_lines(spark, sf_dir), OFFLINE).select("line_no", "cluster_id", "template")


def drain_slow_path(spark, sf_dir):
    """Order lines of digits alone: one bucket without a common token, parsed line by line."""
    o = _table(spark, sf_dir, "orders")
    digits = [(F.col("o_orderkey") % m).cast("string") for m in (7, 5, 3, 11, 2)]
    rows = o.select((F.col("o_custkey") % 40).cast("string").alias("dataset"), F.col("o_orderkey").alias("line_no"), F.concat_ws(" ", *digits).alias("line"))
    return clustering.parse(rows, []).select("dataset", "line_no", "cluster_id", "template")


def blank_lines(spark, sf_dir):
    """Texts of the turns and their lines, blank ones too, with a mask that doesn't compile between the others."""
    t = _table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("k"), F.posexplode(F.split(F.concat("text", F.lit("\n\n \n"), "text"), "\n")).alias("n", "line"), "turn")
    rows = t.select(F.lit("turns").alias("dataset"), (F.col("k") * 4096 + F.col("turn") * 64 + F.col("n")).alias("line_no"), "line")
    masks = usable(spark, [OFFLINE[0], Mask("BAD", r"\d+("), *OFFLINE[1:], Mask("WORSE", "[a")])
    return clustering.parse(rows, masks).select("line_no", "cluster_id", "template")


def overflowing_bucket(spark, sf_dir):
    """Lines of eight numbers that are seldom alike, in forty datasets: buckets with more than a hundred unlike lines each."""
    o = _table(spark, sf_dir, "orders")
    parts = [(F.col("o_orderkey") * p % 997).cast("string") for p in (1, 7, 31, 101, 211, 307, 401, 503)]
    rows = o.select((F.col("o_orderkey") % 40).cast("string").alias("dataset"), F.col("o_orderkey").alias("line_no"), F.concat_ws(" ", *parts).alias("line"))
    return clustering.parse(rows, []).select("dataset", "line_no", "cluster_id", "template")


def classify_tokens(spark, sf_dir):
    found = _doc_lines(spark, sf_dir).select(F.explode(text.tokens(F.col("line"))).alias("token"))
    return found.groupBy("token").count().select("token", text.classify(F.col("token")).alias("class"))


def mask_tokens(spark, sf_dir):
    return _event_lines(spark, sf_dir).select("line_no", F.array_join(text.mask_tokens(text.tokens(F.col("line"))), " ").alias("masked"))


def normalise_lines(spark, sf_dir):
    return _doc_lines(spark, sf_dir).select("line_no", text.normalise(F.col("line")).alias("normal"), F.array_join(text.sampling_tokens(F.col("line")), " ").alias("tokens"))


def line_entropy(spark, sf_dir):
    return sampling.scored(_talk_lines(spark, sf_dir)).select("dataset", "line_no", F.round("entropy", 6).alias("entropy"))


def entropy_topk(spark, sf_dir):
    """The five lines of most entropy of each conversation."""
    rank = F.row_number().over(W.partitionBy("dataset").orderBy(F.desc(F.round("entropy", 6)), "line_no"))
    return sampling.scored(_talk_lines(spark, sf_dir)).select("dataset", rank.cast("long").alias("rank"), "line_no").where("rank <= 5")


def jaccard_pairs(spark, sf_dir):
    """Each turn and the next of its conversation."""
    found = _talk_lines(spark, sf_dir).withColumn("t", text.sampling_tokens(F.col("line")))
    after = F.lead("t").over(W.partitionBy("dataset").orderBy("line_no"))
    return found.withColumn("u", after).where("u is not null").select("dataset", "line_no", F.round(text.jaccard(F.col("t"), F.col("u")), 9).alias("jaccard"))


def entropy_greedy_sample(spark, sf_dir):
    return sampling.entropy_greedy_sample(_event_lines(spark, sf_dir), 20).select("rank", "line_no", "line")


def synth_offline_masks(spark, sf_dir):
    masks = synthesis.synthesize_offline(_doc_lines(spark, sf_dir))
    return spark.createDataFrame([(i, m.label, m.pattern) for i, m in enumerate(masks)], "ord long, label string, pattern string")


def canonical_bundle(spark, sf_dir):
    """The canonical masks, and how many lines of documents show each."""
    masks = canonical_masks()
    shown = _doc_lines(spark, sf_dir).agg(*(F.count_if(F.col("line").rlike(m.java)).alias(m.label) for m in masks))
    rows = F.array(*(F.struct(F.lit(i).cast("long").alias("ord"), F.lit(m.label).alias("label"), F.lit(m.pattern).alias("pattern"), F.col(m.label).alias("n_lines")) for i, m in enumerate(masks)))
    return shown.select(F.inline(rows))


def _truth_and_prediction(spark, sf_dir):
    rows = _event_truth(spark, sf_dir)
    truth = rows.select("dataset", "line_no", F.hash("kind").alias("cluster_id"), F.col("kind").alias("template"))
    return truth, rows.select("dataset", "line_no", F.hash("level").alias("cluster_id"), F.when(F.col("line_no") % 3 == 0, F.col("kind")).otherwise(F.col("level")).alias("template"))


def grouping_accuracy(spark, sf_dir):
    """Truth: event type. Prediction: event type, but for users ending in 3, whose lines are one group by level."""
    rows = _event_truth(spark, sf_dir)
    truth = rows.select("dataset", "line_no", F.hash("kind").alias("cluster_id"))
    mixed = F.when((F.col("kind") == "click") | (F.col("dataset") == "u3"), F.col("level")).otherwise(F.col("kind"))
    return metrics.grouping_accuracy(truth, rows.select("dataset", "line_no", F.hash(mixed).alias("cluster_id"))).select("dataset", F.round("GA", 9).alias("GA"))


def parsing_accuracy(spark, sf_dir):
    return metrics.parsing_accuracy(*_truth_and_prediction(spark, sf_dir)).select("dataset", F.round("PA", 9).alias("PA"))


def macro_avg(spark, sf_dir):
    truth, predicted = _truth_and_prediction(spark, sf_dir)
    return metrics.with_macro_average(metrics.scores(truth, predicted, "level"))


def truth_from_templates(spark, sf_dir):
    """Types of events numbered in the order in which each group of users shows them."""
    rows = _event_truth(spark, sf_dir).select("dataset", "line_no", F.col("kind").alias("template"))
    return metrics.first_appearance_ids(rows, "template").select("dataset", "line_no", "cluster_id", "template")


def length_mismatch_fallback(spark, sf_dir):
    rows = _event_truth(spark, sf_dir)
    corpus = rows.select("dataset", "line_no")
    truth = rows.where("dataset <> 'u5' OR line_no % 2 = 0").select("dataset", "line_no", F.lit(1).cast("long").alias("cluster_id"), F.col("kind").alias("template"))
    fallback = rows.select("dataset", "line_no", F.lit(0).cast("long").alias("cluster_id"), F.col("level").alias("template"))
    return metrics.truth_or_fallback(corpus, truth, fallback).groupBy("dataset", "from_file", "template").agg(F.count("*").alias("n"))


def dataset_manifest(spark, sf_dir):
    talk = _talk_lines(spark, sf_dir)
    return sources.manifest(talk, talk.select("dataset", F.lower("line").alias("template"))).select("name", "logs", "templates", "checksum")


def align_template(spark, sf_dir):
    lines = _event_lines(spark, sf_dir).withColumn("template", F.lit(EVENT_TEMPLATE))
    return alignment.aligned(lines).select("line_no", F.array_join("values", "|").alias("slots"))


def classify_values(spark, sf_dir):
    found = _doc_lines(spark, sf_dir).select(F.explode(text.tokens(F.col("line"))).alias("value")).distinct()
    return found.select("value", alignment.value_pattern(F.col("value")).alias("pattern"))


def training_examples(spark, sf_dir):
    lines = _event_lines(spark, sf_dir).withColumn("template", F.lit(EVENT_TEMPLATE))
    return alignment.training_examples(lines).select("line_no", "input", "output")


def max_per_system(spark, sf_dir):
    rows = _event_truth(spark, sf_dir).select("dataset", "line_no", F.concat_ws(" ", "kind", "level").alias("line"), F.when(F.col("level") != "INFO", F.concat("kind", F.lit(" <*>"))).otherwise("never <*>").alias("template"))
    return alignment.training_examples(rows, max_per_dataset=10).select("dataset", "line_no", "input")


def raw_literals(spark, sf_dir):
    html = _table(spark, sf_dir, "pages").select("page_id", F.col("html").alias("p"))
    return html.select("page_id", alignment.raw_literal(F.col("p")).alias("literal"), alignment.literal_list(F.array(F.lit("a\\"), F.col("p"))).alias("list"))


def _word_patterns(spark, sf_dir):
    """Patterns of the shapes of documents' words that hold digits: every run of digits as one class."""
    words = _doc_lines(spark, sf_dir).select(F.explode(text.tokens(F.col("line"))).alias("t")).where(F.col("t").rlike("^[A-Za-z0-9_./:-]*[0-9][A-Za-z0-9_./:-]*$"))
    return words.select(F.regexp_replace("t", "[0-9]+", r"\\d+").alias("pattern")).distinct()


def pattern_labels(spark, sf_dir):
    """The labels of patterns made from the words of documents, null where a mask would be named by its place."""
    return _word_patterns(spark, sf_dir).select("pattern", synthesis.judged("pattern")["label"].alias("label"))


def strict_patterns(spark, sf_dir):
    """Which patterns made from words validation takes, loosely and strictly; some are made invalid, some too wide."""
    wide = F.pmod(F.length("pattern"), F.lit(3))
    made = F.when(wide == 0, F.concat("pattern", F.lit("("))).when(wide == 1, F.concat(F.lit("x.*"), "pattern")).otherwise(F.col("pattern"))
    return _word_patterns(spark, sf_dir).select(made.alias("pattern")).select("pattern", synthesis.judged("pattern").alias("j")).select("pattern", "j.loose", "j.strict")


def read_answers(spark, sf_dir):
    """Patterns read from answers made of the turns' first words: a list among text, raw strings in both quotes, a list that isn't closed, and nothing."""
    word, kind = F.regexp_extract("line", "[A-Za-z]+", 0), F.pmod(F.col("line_no"), F.lit(4))
    forms = ['Sure: [r"{}\\d+", "a b", 3] ok', "use r'{}\\w+' or r\"x'{}\" [", '[r"{}", "open', "no pattern for {}"]
    said = F.lit(None).cast("string")
    for i, form in enumerate(forms):
        said = F.when(kind == i, F.replace(F.lit(form), F.lit("{}"), word)).otherwise(said)
    return _talk_lines(spark, sf_dir).select("dataset", "line_no", F.posexplode(synthesis.listed_patterns(said)).alias("ord", "pattern")).select("dataset", "line_no", F.col("ord").cast("long").alias("ord"), "pattern")


def _answer(line: str, attempt: int) -> str:
    """What a provider might say: nothing at first about a line of odd length, else the shape of its first lower-case word, and numbers."""
    word = re.search("[a-z]+", line)
    if attempt == 0 and len(line) % 2:
        return "I don't know"
    return f'[r"{word[0] if word else ""}\\d+", r"\\d+", "(", r"blk_-?\\d+"]'


def provider_masks(spark, sf_dir):
    """Masks of each conversation from a provider that is called on the executors."""
    return synthesis.provider_masks(synthesis.answered(_talk_lines(spark, sf_dir), _answer))


def provider_attempts(spark, sf_dir):
    """The attempt that gave each turn's answer, and how many patterns it has."""
    return synthesis.answered(_talk_lines(spark, sf_dir), _answer).select("dataset", "line_no", F.col("attempt").cast("long").alias("attempt"), F.size("patterns").cast("long").alias("n_patterns"))


def prompts(spark, sf_dir):
    """The question and the training example of each turn."""
    t = _talk_lines(spark, sf_dir)
    return t.select("dataset", "line_no", alignment.prompt(F.col("line")).alias("question"), alignment.prompt(F.col("line"), F.md5("line")).alias("example"))


def structured_csv(spark, sf_dir):
    """Events written as structured CSV files, some without Content and some with line breaks in it, read back in splits with ids by first appearance."""
    e = _event_lines(spark, sf_dir).select("line_no", F.when(F.col("line_no") % 7 == 3, "").when(F.col("line_no") % 5 == 1, F.replace("line", F.lit(" user "), F.lit('\n"user",\n'))).otherwise(F.col("line")).alias("Content"), F.element_at(F.split("line", " "), 4).alias("EventTemplate"))
    path = f"{shared_dir(spark)}/structured-{uuid.uuid4().hex}"
    e.repartitionByRange(5, "line_no").sortWithinPartitions("line_no").select("Content", "EventTemplate").write.option("escape", '"').csv(path, header=True)
    return sources.structured(spark, path, "events").select("line_no", "line", "template", "cluster_id")


def corpus_files(spark, sf_dir):
    """Documents' lines as datasets of their languages, one of them unknown, written to folders and read back with their numbers."""
    d = _table(spark, sf_dir, "documents").where("text IS NOT NULL")
    at = d.select(F.coalesce("lang", F.lit("unknown")).alias("dataset"), F.col("doc_id").alias("k"), F.posexplode(F.split("text", "\n")).alias("n", "line"))
    lines = at.select("dataset", (F.col("k") * F.lit(1 << 32) + F.col("n")).alias("line_no"), "line")
    root = f"{shared_dir(spark)}/corpus-{uuid.uuid4().hex}"
    sinks.write_datasets(lines, root)
    return sources.corpus(spark, root)


def _streamed(spark, rows: DataFrame, name: str, run: Callable[[DataFrame], DataFrame], files: int = 1) -> DataFrame:
    """What run makes of rows as a stream, one micro-batch for each of the ranges of line_no, drained into a table.

    A range's files are put before the stream once the range before is drained: files that are written together are taken by the time at which they end,
    which is in no order.
    """
    root = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    rows.repartitionByRange(files, "line_no").withColumn("__part", F.spark_partition_id()).write.partitionBy("__part").parquet(f"{root}/parts")
    for part in sorted(int(n.partition("=")[2]) for n in names(spark, f"{root}/parts") if n.startswith("__part=")):
        rename(spark, f"{root}/parts/__part={part}", f"{root}/in/{part}")
        stream = spark.readStream.schema(rows.schema).option("recursiveFileLookup", True).parquet(f"{root}/in")
        query = run(stream).writeStream.format("parquet").option("checkpointLocation", f"{root}/state").option("path", f"{root}/out").trigger(availableNow=True).start()
        query.awaitTermination()
    return spark.read.parquet(f"{root}/out")


def streamed_clusters(spark, sf_dir):
    """Event lines as a stream of two micro-batches: the cluster of each line."""
    return _streamed(spark, _event_lines(spark, sf_dir), "clusters", lambda s: templates.parse_stream(s, OFFLINE), 2).select("line_no", "cluster")


def streamed_dense_ids(spark, sf_dir):
    """Event lines as a stream of three micro-batches, with ids given after the first file's lines and again, from these, after all."""
    events = _event_lines(spark, sf_dir)
    found = _streamed(spark, events, "dense", lambda s: templates.parse_stream(s, OFFLINE), 3)
    cut = events.agg(F.max("line_no") / 3)
    early = keep(templates.dense_ids(found.join(cut.toDF("cut")).where("line_no <= cut").drop("cut")), "known")
    ids = templates.dense_ids(found, early)
    return found.join(ids.select("dataset", "cluster", "cluster_id"), ["dataset", "cluster"]).select("line_no", "cluster_id")


def streamed_records(spark, sf_dir):
    """Texts of documents in the files of a growing tree, half of which are added after a first run of the stream: a record for each of their lines."""
    root = f"{shared_dir(spark)}/records-{uuid.uuid4().hex}"
    docs = _table(spark, sf_dir, "documents").where("text IS NOT NULL").withColumn("part", F.col("doc_id") % 8)
    for part in (docs.where("part < 4"), docs.where("part >= 4")):
        part.repartition("part").sortWithinPartitions("part", "doc_id").select("part", "text").write.mode("append").partitionBy("part").text(f"{root}/in")
        sources.stream_records(spark, f"{root}/in", f"{root}/out", f"{root}/state", 3).awaitTermination()
    found = spark.read.parquet(f"{root}/out")
    return found.select(F.regexp_extract("source", r"part=(\d+)/", 1).cast("long").alias("part"), "line_no", "format_hint", "text")


def streamed_groups(spark, sf_dir):
    """The online parser on a stream of turns, in two micro-batches."""
    rows = _talk_lines(spark, sf_dir).select(F.col("dataset").alias("source"), "line_no", "line")
    return _streamed(spark, rows, "groups", templates.online_stream, 2).select("source", "line_no", "group_id", "size", "template")


def scrub(spark, sf_dir):
    docs = _doc_lines(spark, sf_dir).select("line_no", text.scrub(F.col("line")).alias("scrubbed"), F.lit("document").alias("kind"))
    urls = _table(spark, sf_dir, "pages").select(F.col("page_id").alias("line_no"), text.scrub(F.concat(F.col("url"), F.lit(" hostname=h-"), F.col("page_id"), F.lit(",x"))).alias("scrubbed"), F.lit("page").alias("kind"))
    return docs.unionByName(urls)


def ts_prefix_groups(spark, sf_dir):
    return online.prefix_groups(_event_lines(spark, sf_dir))


def ts_prefix_members(spark, sf_dir):
    return online.prefix_members(_event_lines(spark, sf_dir)).select("line_no", "line", "length", "prefix")


def cache_keys(spark, sf_dir):
    key = online.cache_key(text.tokens(F.col("line")))
    return _doc_lines(spark, sf_dir).select(key.alias("k")).groupBy("k.first_token", "k.n_tokens").agg(F.count("*").alias("n_lines"))


def pair_merge_template(spark, sf_dir):
    """Template of each event line and the next of the same user."""
    found = _event_lines(spark, sf_dir).withColumn("t", text.tokens(F.col("line"))).withColumn("user", F.element_at("t", 6))
    after = F.lead("t").over(W.partitionBy("user").orderBy("line_no"))
    return found.withColumn("u", after).where("u is not null").select("line_no", F.array_join(text.pair_template(F.col("t"), F.col("u")), " ").alias("template"))


def pair_jaccard(spark, sf_dir):
    found = _event_lines(spark, sf_dir).withColumn("t", text.tokens(F.col("line"))).withColumn("user", F.element_at("t", 6))
    after = F.lead("t").over(W.partitionBy("user").orderBy("line_no"))
    return found.withColumn("u", after).where("u is not null").select("line_no", F.round(text.jaccard(F.col("t"), F.col("u")), 9).alias("jaccard"), F.round(text.similarity(F.col("t"), F.col("u")), 9).alias("similarity"))


def online_parse(spark, sf_dir):
    records = _talk_lines(spark, sf_dir).select(F.col("dataset").alias("source"), "line_no", "line")
    return online.online_parse(records).select("source", "line_no", "group_id", "size", F.array_join("template", " ").alias("template"))


def format_report(spark, sf_dir):
    truth, predicted = _truth_and_prediction(spark, sf_dir)
    rows = metrics.scores(truth, predicted, "level")
    return reports.body_rows(rows.withColumn("at", F.col("dataset")), "at")


def record_rows(spark, sf_dir):
    """Pages' addresses as records, with their short descriptions."""
    at = _table(spark, sf_dir, "pages").select(F.sha2(F.concat_ws(":", "url", F.col("page_id").cast("string")), 256).alias("record_id"), F.col("url").alias("source"), F.col("html").alias("text"))
    return sources.described(at).select("record_id", "description")


def evaluate_events(spark, sf_dir):
    """Synthesis, parsing and scores against the canonical truth, for each group of users."""
    e = _event_lines(spark, sf_dir).withColumn("dataset", F.concat(F.lit("u"), F.element_at(F.split("line", " "), 6).cast("long") % 2))
    return evaluation.evaluate(e, settings=evaluation.Settings(k=20))


def _new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def file_records(spark, sf_dir):
    """Texts of documents in files of a tree: a record for each of their lines, blank ones too, with its short description."""
    root = _new_path(spark, "tree")
    docs = _table(spark, sf_dir, "documents").where("text IS NOT NULL").withColumn("part", F.pmod("doc_id", F.lit(64)))
    docs.repartition("part").sortWithinPartitions("part", "doc_id").select("part", "text").write.partitionBy("part").text(root)
    found = sources.described(sources.records(spark, root))
    short = F.expr("substring(description, length(record_id) + length(source) + 7)")  # after "[id] source | "
    return found.select(F.regexp_extract("source", r"part=(\d+)/", 1).cast("long").alias("part"), "line_no", "format_hint", "text", short.alias("short"))


def _users(spark, sf_dir):
    """Event lines of each group of users with the truth of their types, as datasets."""
    lines = _event_lines(spark, sf_dir).join(_event_truth(spark, sf_dir).select("line_no", "kind", F.col("dataset").alias("users")), "line_no")
    rows = lines.select(F.col("users").alias("dataset"), "line_no", "line", F.col("kind").alias("template"))
    return rows.select("dataset", "line_no", "line"), metrics.first_appearance_ids(rows.select("dataset", "line_no", "template"), "template")


def _truth_files(spark, sf_dir, whole: bool) -> DataFrame:
    root, (lines, truth) = _new_path(spark, "truth"), _users(spark, sf_dir)
    sinks.write_datasets(lines, root, truth, whole)
    return sources.corpus(spark, root).join(sources.ground_truth(spark, root), ["dataset", "line_no"]).select("dataset", "line_no", "line", "cluster_id", "template")


def truth_files(spark, sf_dir):
    """Datasets with their truths written to folders, read back, and lines joined with their templates; a truth has an entry on each line."""
    return _truth_files(spark, sf_dir, False)


def whole_truth_files(spark, sf_dir):
    """The same with each dataset's truth as one JSON value."""
    return _truth_files(spark, sf_dir, True)


def mask_files(spark, sf_dir):
    """Masks of documents written as a bundle and read back."""
    path = _new_path(spark, "masks")
    sinks.write_masks(spark, synthesis.synthesize_offline(_doc_lines(spark, sf_dir)), path)
    rows = [(i, m.label, m.pattern) for i, m in enumerate(sources.read_masks(spark, path, strict=True))]
    return spark.createDataFrame(rows, "ord long, label string, pattern string")


def parsed_csv(spark, sf_dir):
    """Parsed event lines written as CSV, every field quoted, and read back."""
    path = _new_path(spark, "parsed")
    sinks.write_parsed_csv(clustering.parse(_event_lines(spark, sf_dir), OFFLINE), path)
    return spark.read.option("escape", '"').csv(path, header=True).select("log", "template")


def jsonl_files(spark, sf_dir):
    """Training examples of events written as JSON lines and read back, with the number that the writer counted."""
    path = _new_path(spark, "examples")
    examples = alignment.training_examples(_event_lines(spark, sf_dir).withColumn("template", F.lit(EVENT_TEMPLATE)))
    n = sinks.write_jsonl(examples.select("line_no", "input", "output"), path)
    return sources.read_jsonl(spark, path, "line_no long, input string, output string").withColumn("written", F.lit(n).cast("long"))


def metric_files(spark, sf_dir):
    """Scores and their means written as CSV and read back, all columns strings."""
    path = _new_path(spark, "metrics")
    sinks.write_csv(macro_avg(spark, sf_dir), path)
    found = sources.read_metrics(spark, path)
    return found.select("dataset", "method", *(F.col(c).cast("double").alias(c) for c in ("GA", "PA")), F.lit({t for _, t in found.dtypes} == {"string"}).alias("strings"))


def scrubbed_files(spark, sf_dir):
    """Lines of documents, some with addresses and hosts in front, written as text, scrubbed file by file; how often each line is there."""
    source, path = _new_path(spark, "text"), _new_path(spark, "scrubbed")
    k = F.pmod("line_no", F.lit(5)).cast("string")
    _doc_lines(spark, sf_dir).select(F.concat(F.lit("/srv/d"), k, F.lit(" u"), k, F.lit("@x.org hostname=h"), k, F.lit(" "), "line")).write.text(source)
    sinks.scrub_files(spark, source, path)
    return spark.read.text(path).groupBy(F.col("value").alias("scrubbed")).agg(F.count("*").alias("n"))


def timing(spark, sf_dir):
    """How many lines were parsed of each half of the users, in the first half of all lines, and whether the time is there."""
    lines = _event_lines(spark, sf_dir).withColumn("dataset", F.concat(F.lit("u"), F.element_at(F.split("line", " "), 6).cast("long") % 2))
    return evaluation.timing(lines, OFFLINE, lines.count() // 2).select("dataset", "n_logs", (F.col("seconds") > 0).alias("timed"))


def synth_masks_api(spark, sf_dir):
    """Masks of events from a sample of twenty lines, through the function for users."""
    rows = [(i, m.label, m.pattern) for i, m in enumerate(synthesis.synth_masks(_event_lines(spark, sf_dir), 20))]
    return spark.createDataFrame(rows, "ord long, label string, pattern string")


def _sessions(spark, sf_dir):
    """Lines of documents parsed in two calls, the second by a miner that takes up the first one's state from its folder."""
    path, lines = _new_path(spark, "miner"), _doc_lines(spark, sf_dir)
    half = _table(spark, sf_dir, "documents").agg(F.percentile_approx("doc_id", 0.5)).first()[0] or 0
    early = F.col("line_no") < (half << 32)
    first = clustering.Miner(path=path).load_masks(OFFLINE, spark).parse(lines.where(early))
    miner = clustering.Miner.open(spark, path)
    return first.unionByName(miner.parse(lines.where(~early))), miner


def miner_sessions(spark, sf_dir):
    return _sessions(spark, sf_dir)[0].select("line_no", "cluster_id")


def miner_state(spark, sf_dir):
    """The state after both sessions: each cluster's first line and template."""
    return _sessions(spark, sf_dir)[1].state.select("cluster_id", "first_line", text.wildcards(F.col("typed")).alias("template"))


_NOT_QUERIES = {"queries", "oracle_sql"}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {n: f for n, f in globals().items() if callable(f) and getattr(f, "__module__", "") == __name__ and not n.startswith("_") and n not in _NOT_QUERIES}


def oracle_sql() -> dict[str, str]:
    from .oracle import ORACLE

    return dict(ORACLE)
