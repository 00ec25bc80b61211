"""Template mining: masked lines to clusters of equal length and prefix, and their templates.

Lines have the columns dataset, line_no and line. A line belongs to the bucket of its token count and its first `depth` tokens, with
variable tokens as wildcards; clusters never cross buckets, so buckets are parsed in parallel.

Fast path, in Catalyst expressions. Let c be the number of positions where all lines of a bucket have one token. Every line agrees with every
template of the bucket there, so if c / n_tokens reaches the threshold the bucket is one cluster, whatever the order, and its template has
the common tokens and wildcards elsewhere. Only buckets with several masked texts, told apart by 64-bit hashes, are exploded.

Slow path. The other buckets are parsed line by line in the order of line_no: a line joins the cluster with the highest similarity (the first
of equals) if that reaches the threshold; else it starts a cluster, or, when the bucket has `most` of them, joins the first. This is
sequential by definition. Lines are dealt by bucket, sorted, and read as batches; what a task holds is the templates of one bucket.

Cluster ids are dense and follow the first line of each cluster.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Mapping, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import tables, text
from ..functions.patterns import WILDCARD, Mask, usable
from ..functions.tables import dealt, keep, runs

DEPTH, THRESHOLD, MOST = 5, 0.4, 100
CELL = 1 << 20  # clusters that are numbered in one task
BUCKET = ["dataset", "n_tokens", "key"]


def bucketed(lines: DataFrame, masks: Sequence[Mask], depth: int = DEPTH) -> DataFrame:
    """lines with masked (tokens joined by a space), n_tokens and key. A blank line is one empty token."""
    found = text.tokens(text.apply_masks(F.col("line"), masks))
    found = F.when(F.size(found) == 0, F.array(F.lit(""))).otherwise(found)
    out = lines.withColumn("__tokens", found)
    return out.select("*", F.array_join("__tokens", " ").alias("masked"), F.size("__tokens").alias("n_tokens"), text.bucket_key(F.col("__tokens"), depth).alias("key")).drop("__tokens")


class Bucket:
    """The templates of one bucket, and its lines one after the other.

    Tokens of templates are numbers, so that a line meets all templates in one comparison of arrays; a token of no template has none. So
    memory is that of the templates, whatever the number of lines and the length of their tokens.
    """

    def __init__(self, threshold: float, most: int, templates: Sequence[str] = ()):
        self.threshold, self.most = threshold, most
        self.names, self.codes = [WILDCARD], {WILDCARD: 0}
        self.table: np.ndarray | None = None
        self.n = 0
        self.changed: dict[int, None] = {}  # clusters that are new or have another template than at the start
        self._text: dict[int, str] = {}
        for t in templates:
            self._found(t.split(" "))
        self.changed.clear()

    def _found(self, tokens: Sequence[str]) -> int:
        if self.table is None:
            self.table = np.zeros((4, len(tokens)), np.int64)
        if self.n == len(self.table):
            self.table = np.concatenate([self.table, np.zeros_like(self.table)])
        for i, t in enumerate(tokens):
            code = self.codes.setdefault(t, len(self.names))
            if code == len(self.names):
                self.names.append(t)
            self.table[self.n, i] = code
        self.n += 1
        self.changed[self.n - 1] = None
        return self.n - 1

    def add(self, masked: str) -> int:
        """Number of the cluster of the next line, its tokens joined by spaces."""
        tokens = masked.split(" ")
        if not self.n:
            return self._found(tokens)
        x = np.array([self.codes.get(t, -1) for t in tokens])
        own = self.table[: self.n]
        same = ((own == x) | (own == 0)).sum(1)
        at = int(same.argmax())
        if same[at] / len(tokens) < self.threshold:
            if self.n < self.most:
                return self._found(tokens)
            at = 0
        other = own[at] != x
        if own[at][other].any():
            own[at][other] = 0
            self._text.pop(at, None)
            self.changed[at] = None
        return at

    def template(self, number: int) -> str:
        if number not in self._text:
            self._text[number] = " ".join(self.names[c] for c in self.table[number])
        return self._text[number]


def _buckets(keyed: DataFrame, threshold: float) -> DataFrame:
    """A row for each bucket: first_line, size, whether the fast path holds (fast), and its typed template there; null where all lines have one masked text,
    which then is the template. Texts of a bucket are told apart by 64-bit hashes; only those of buckets with several are dealt."""
    h = F.xxhash64("masked")
    whole = keep(keyed.groupBy(*BUCKET).agg(F.min("line_no").alias("first_line"), F.count("*").alias("size"), (F.min(h) == F.max(h)).alias("single")), "whole")
    several = keep(whole.where("NOT single").select(*BUCKET), "several")  # a table of its own, so that its size is known and few are broadcast
    texts = keyed.select(*BUCKET, "masked").join(several, BUCKET, "left_semi").distinct()
    at = texts.select(*BUCKET, F.posexplode(F.split("masked", " ")).alias("pos", "token"))
    common = at.groupBy(*BUCKET, "pos").agg(F.min("token").alias("a"), F.max("token").alias("b"))
    part = F.struct("pos", F.when(F.col("a") == F.col("b"), F.col("a")).otherwise(WILDCARD).alias("t"))
    merged = common.groupBy(*BUCKET).agg(F.sum((F.col("a") == F.col("b")).cast("int")).alias("same"), F.array_sort(F.collect_list(part)).alias("parts"))
    return whole.join(merged, BUCKET, "left").select(
        *BUCKET,
        "first_line",
        "size",
        F.array_join(F.col("parts.t"), " ").alias("template_typed"),
        (F.col("single") | (F.col("same") / F.col("n_tokens") >= F.lit(float(threshold)))).alias("fast"),
    )


def _slow(keyed: DataFrame, buckets: DataFrame, threshold: float, most: int) -> DataFrame:
    """Two kinds of rows for the buckets that are not fast, with their bucket and the number of the cluster in it. Of each line: line_no and line. Of each
    cluster: first_line, size, template_typed. Line numbers may repeat; lines of one number are taken by their masked text."""
    few = keep(buckets.where(~F.col("fast")).select(*BUCKET), "few")
    rows = keyed.select(*BUCKET, "line_no", "line", "masked").join(few, BUCKET, "left_semi")
    ordered = dealt(rows, BUCKET).sortWithinPartitions(*BUCKET, "line_no", "masked")

    def run(batches):
        names = [*BUCKET, "number", "line_no", "line", "first_line", "size", "template_typed"]
        types = [pa.string(), pa.int32(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string()]
        at, bucket, first, size = None, None, [], []

        def table(n, columns):
            given = {c: [v] * n for c, v in zip(BUCKET, at, strict=True)} | columns
            return pa.RecordBatch.from_arrays([pa.array(given[c], t) if c in given else pa.nulls(n, t) for c, t in zip(names, types, strict=True)], names=names)

        def clusters():
            n = len(first)
            return table(n, {"number": range(n), "first_line": first, "size": size, "template_typed": [bucket.template(i) for i in range(n)]})

        for batch in batches:
            for start, end, key in runs(batch, BUCKET):
                if key != at:
                    if bucket:
                        yield clusters()
                    at, bucket, first, size = key, Bucket(threshold, most), [], []
                line_no, out = batch.column("line_no").slice(start, end - start), []
                for n, masked in zip(line_no.to_pylist(), batch.column("masked").slice(start, end - start), strict=True):
                    number = bucket.add(masked.as_py())
                    if number == len(first):
                        first.append(n)
                        size.append(0)
                    size[number] += 1
                    out.append(number)
                yield table(end - start, {"number": out, "line_no": line_no, "line": batch.column("line").slice(start, end - start)})
        if bucket:
            yield clusters()

    return ordered.mapInArrow(run, "dataset string, n_tokens int, key string, number long, line_no long, line string, first_line long, size long, template_typed string")


def numbered(clusters: DataFrame, most: int = CELL) -> DataFrame:
    """clusters (dataset, first_line, ...) with cluster_id: dense, from 0, by first line, and where several have the same one by their bucket and number or
    their hash, so that ids are the same whenever the plan runs.

    The first lines are cut into cells of about `most` at quantiles; ids are numbered in each cell and start after those of the cells before it,
    so no task sorts a whole dataset.
    """
    n = clusters.groupBy("dataset").agg(F.count("*").alias("n"))
    parts = max([1, *(-(-r.n // most) for r in n.select("n").distinct().collect())])
    cuts = F.percentile_approx("first_line", F.array(*(F.lit(i / parts) for i in range(1, parts))), F.lit(100 * parts)) if parts > 1 else F.array().cast("array<bigint>")
    cut = clusters.join(clusters.groupBy("dataset").agg(cuts.alias("cuts")), "dataset").withColumn("cell", F.size(F.filter("cuts", lambda c: c < F.col("first_line")))).drop("cuts")
    cells = cut.groupBy("dataset", "cell").agg(F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(W.partitionBy("dataset").orderBy("cell").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    ties = [c for c in ("n_tokens", "key", "number", "at", "cluster") if c in clusters.columns]
    rank = F.row_number().over(W.partitionBy("dataset", "cell").orderBy("first_line", *ties))
    return cut.withColumn("rank", rank).join(cells.select("dataset", "cell", before.alias("before")), ["dataset", "cell"]).withColumn("cluster_id", F.col("before") + F.col("rank") - 1).drop("cell", "rank", "before")


def _mined(lines: DataFrame, masks: Sequence[Mask], depth: int, threshold: float, most: int) -> tuple[DataFrame, DataFrame, DataFrame | None, DataFrame]:
    """Keyed lines, buckets, rows of slow buckets (None without any), and the number of each cluster: bucket, number in it (null for fast ones) and cluster_id.
    Lines are masked once; a masked text is kept where it isn't the line itself. Templates take no part in the numbering."""
    own = bucketed(lines.select("dataset", "line_no", "line"), masks, depth)
    keyed = keep(own.withColumn("masked", F.when(F.col("masked") != F.col("line"), F.col("masked"))), "keyed").withColumn("masked", F.coalesce("masked", "line"))
    buckets = keep(_buckets(keyed, threshold), "buckets")
    columns = [*BUCKET, "number", "first_line"]
    both, slow = buckets.where("fast").withColumn("number", F.lit(None).cast("long")).select(*columns), None
    if buckets.where("NOT fast").limit(1).count():
        slow = keep(_slow(keyed, buckets, threshold, most), "slow")
        both = both.unionByName(slow.where("template_typed IS NOT NULL").select(*columns))
    return keyed, buckets, slow, keep(numbered(both).select(*columns, "cluster_id"), "ids")


def clusters(lines: DataFrame, masks: Sequence[Mask], depth: int = DEPTH, threshold: float = THRESHOLD, most: int = MOST) -> DataFrame:
    """dataset, cluster_id, first_line, size, template, template_typed."""
    keyed, buckets, slow, ids = _mined(lines, masks, depth, threshold, most)
    single = keyed.join(buckets.where("fast AND template_typed IS NULL").select(*BUCKET), BUCKET, "left_semi").groupBy(*BUCKET).agg(F.min("masked").alias("text"))
    found = ids.where("number IS NULL").join(buckets.select(*BUCKET, "size", "template_typed"), BUCKET).join(single, BUCKET, "left")
    out = found.select("dataset", "cluster_id", "first_line", "size", F.coalesce("template_typed", "text").alias("template_typed"))
    if slow is not None:
        made = slow.where("template_typed IS NOT NULL").select(*BUCKET, "number", "size", "template_typed")
        out = out.unionByName(ids.where("number IS NOT NULL").join(made, [*BUCKET, "number"]).select(*out.columns))
    return out.select("dataset", "cluster_id", "first_line", "size", text.wildcards(F.col("template_typed")).alias("template"), "template_typed")


def parse(lines: DataFrame, masks: Sequence[Mask], depth: int = DEPTH, threshold: float = THRESHOLD, most: int = MOST) -> DataFrame:
    """dataset, line_no, line, cluster_id, template, template_typed for each line, with the templates as they are in the end.

    Lines are joined to clusters by bucket; those of slow buckets by bucket and number.
    """
    keyed, buckets, slow, ids = _mined(lines, masks, depth, threshold, most)
    columns = ["dataset", "line_no", "line", "cluster_id", text.wildcards(F.col("template_typed")).alias("template"), "template_typed"]
    made = ids.where("number IS NULL").select(*BUCKET, "cluster_id").join(buckets.select(*BUCKET, F.col("template_typed").alias("common")), BUCKET)
    fast = keyed.select(*BUCKET, "line_no", "line", "masked").join(made, BUCKET)
    out = fast.withColumn("template_typed", F.coalesce("common", "masked")).select(*columns)
    if slow is not None:
        which = ids.where("number IS NOT NULL").select(*BUCKET, "number", "cluster_id")
        which = which.join(slow.where("template_typed IS NOT NULL").select(*BUCKET, "number", "template_typed"), [*BUCKET, "number"])
        own = slow.where("template_typed IS NULL").select(*BUCKET, "number", "line_no", "line").join(which, [*BUCKET, "number"])
        out = out.unionByName(own.select(*columns))
    return out


_STATE = "n_tokens int, key string, at int, cluster_id long, first_line long, typed string"
_STATE_COLUMNS = _STATE.replace(",", " ").split()[::2]
OWN_BUCKET = ["n_tokens", "key"]
OPEN = 1024  # buckets that add_log() holds in memory before it writes them


class Miner:
    """Masks, parameters and the clusters so far, of one stream of lines whose dataset does not count.

    Parsing more lines takes up the clusters where they were left: the state is a table with a row for each cluster, which meets the new lines bucket by
    bucket; lines parsed before are not read again. Templates are those after the last line of the call.

    The state is a folder of numbered versions. A version counts once its commit file is there, which is written last and holds the masks and the
    counts; then older versions are deleted. open() takes up the last one in another session. A folder has one writer at a time.
    """

    def __init__(self, depth: int = DEPTH, threshold: float = THRESHOLD, most: int = MOST, path: str | None = None):
        """path: the folder of the state; a new one in the shared folder if it is None."""
        self.depth, self.threshold, self.most, self.path = depth, threshold, most, path
        self.masks: list[Mask] = []
        self.state: DataFrame | None = None
        self._next = self._lines = self._version = 0
        self._open: dict[tuple[int, str], tuple[Bucket, list[int], list[int]]] = {}
        self._spark: SparkSession | None = None

    def load_masks(self, masks: Sequence[Mask | Mapping[str, str]], spark: SparkSession | DataFrame) -> Miner:
        """New masks; what was parsed before is forgotten. spark: the session, or any DataFrame of it."""
        self._spark = spark.sparkSession if isinstance(spark, DataFrame) else spark
        if self.path is None:
            self.path = f"{tables.shared_dir(self._spark)}/miner-{uuid.uuid4().hex}"
        self._version = max([self._version, *self._versions(self._spark, self.path)])
        self.masks, self._next, self._lines = usable(self._spark, masks), 0, 0
        self._open.clear()
        self._commit(self._spark.createDataFrame([], _STATE))
        return self

    @staticmethod
    def _versions(spark: SparkSession, path: str) -> list[int]:
        return [int(n[7:-5]) for n in tables.names(spark, path) if n.startswith("commit-") and n.endswith(".json")]

    @classmethod
    def open(cls, spark: SparkSession, path: str) -> Miner:
        """The miner whose state is in the folder path, as its last committed call left it."""
        version = max(cls._versions(spark, path), default=0)
        if not version:
            raise ValueError(f"{path} holds no state")
        about = tables.read_small(spark, f"{path}/commit-{version}.json")
        out = cls(about["depth"], about["threshold"], about["most"], path)
        out._spark, out._version, out._next, out._lines = spark, version, about["next"], about["lines"]
        out.masks = [Mask.of(m) for m in about["masks"]]
        out.state = spark.read.schema(_STATE).parquet(f"{path}/v-{version}")
        return out

    def _commit(self, clusters: DataFrame) -> None:
        """The next version of the state; clusters may read the one before it."""
        version = self._version + 1
        clusters.write.mode("overwrite").parquet(f"{self.path}/v-{version}")
        about = {"depth": self.depth, "threshold": self.threshold, "most": self.most, "masks": [m.as_dict() for m in self.masks], "next": self._next, "lines": self._lines}
        tables.write_small(self._spark, f"{self.path}/commit-{version}.json", about)
        self._version, self.state = version, self._spark.read.schema(_STATE).parquet(f"{self.path}/v-{version}")
        for name in tables.names(self._spark, self.path):
            if name not in (f"v-{version}", f"commit-{version}.json"):
                tables.delete(self._spark, f"{self.path}/{name}")

    def save(self) -> None:
        """Write what add_log() has changed since the last version."""
        if self._open:
            rows = [(*key, at, ids[at], first[at], bucket.template(at)) for key, (bucket, ids, first) in self._open.items() for at in range(bucket.n)]
            fresh = self._spark.createDataFrame(rows, _STATE)
            self._commit(self.state.join(fresh.select("n_tokens", "key").distinct(), ["n_tokens", "key"], "left_anti").select(*fresh.columns).unionByName(fresh))
            self._open.clear()

    def parse(self, lines: DataFrame) -> DataFrame:
        """dataset, line_no, line, cluster_id, template, template_typed, a kept table; new ids count on from those of earlier calls. Lines are taken in the
        order of line_no.

        The fast path holds where a bucket has one cluster at most so far and its template, as one more line, leaves enough tokens in common; then no order counts
        and no task reads the bucket as a whole. Other buckets are read in order, their clusters first, by tasks that hold templates only.
        """
        self.save()
        before = self._next
        with tables.scratch(self._spark) as own:
            keyed = tables.keep(bucketed(lines.select("dataset", "line_no", "line"), self.masks, self.depth), "batch")
            buckets = tables.keep(self._met(keyed), "buckets")
            fast = buckets.where("fast").select(*OWN_BUCKET)
            slow = tables.keep(buckets.where("NOT fast").select(*OWN_BUCKET), "slow")  # a table of its own, so that its size is known and few are broadcast
            passed = tables.keep(self._passed(keyed.join(slow, OWN_BUCKET, "left_semi"), self.state.join(slow, OWN_BUCKET, "left_semi")), "passed")
            clusters = self.state.join(buckets.select(*OWN_BUCKET), OWN_BUCKET, "left_anti").select(*_STATE_COLUMNS)
            clusters = clusters.unionByName(buckets.where("fast").select(*_STATE_COLUMNS)).unionByName(passed.where("typed IS NOT NULL").select(*_STATE_COLUMNS))
            clusters = tables.keep(clusters, "clusters")
            fresh = numbered(clusters.where("cluster_id IS NULL").drop("cluster_id").withColumn("dataset", F.lit(""))).withColumn("cluster_id", F.col("cluster_id") + before)
            state = tables.keep(clusters.where("cluster_id IS NOT NULL").unionByName(fresh.drop("dataset")), "state")
            self._next, self._lines = state.count(), max(self._lines, (keyed.agg(F.max("line_no")).first()[0] or 0) + 1)
            columns = ["dataset", "line_no", "line", "cluster_id", "typed"]
            only = state.join(fast, OWN_BUCKET, "left_semi").select(*OWN_BUCKET, "cluster_id", "typed")  # one for each fast bucket
            of_slow = passed.where("typed IS NULL").select(*OWN_BUCKET, "at", "dataset", "line_no", "line").join(state.select(*OWN_BUCKET, "at", "cluster_id", "typed"), [*OWN_BUCKET, "at"])
            found = keyed.select(*OWN_BUCKET, "dataset", "line_no", "line").join(only, OWN_BUCKET).select(*columns).unionByName(of_slow.select(*columns))
            parsed = own.result(found.select("dataset", "line_no", "line", "cluster_id", text.wildcards(F.col("typed")).alias("template"), F.col("typed").alias("template_typed")), "parsed")
            self._commit(state)
        return parsed

    def _met(self, keyed: DataFrame) -> DataFrame:
        """The buckets of keyed lines, each with its only cluster as it is after them (cluster_id null for a new one) where it is fast."""
        known = self.state.groupBy(*OWN_BUCKET).agg(F.count("*").alias("known"), F.min("typed").alias("before"), F.min("cluster_id").alias("cluster_id"), F.min("first_line").alias("had"))
        texts = keyed.groupBy(*OWN_BUCKET, "masked").agg(F.min("line_no").alias("first_line"))
        whole = texts.groupBy(*OWN_BUCKET).agg(F.min("first_line").alias("first_line"), F.min("masked").alias("least"), F.max("masked").alias("greatest")).join(known, OWN_BUCKET, "left")
        single = (F.col("least") == F.col("greatest")) & F.coalesce(F.col("before") == F.col("least"), F.lit(True))
        one = F.coalesce(F.col("known"), F.lit(0)) <= 1
        several = whole.where(one & ~single)
        said = texts.join(several.select(*OWN_BUCKET), OWN_BUCKET, "left_semi").select(*OWN_BUCKET, "masked", F.lit(False).alias("template"))
        said = said.unionByName(several.where("before IS NOT NULL").select(*OWN_BUCKET, F.col("before").alias("masked"), F.lit(True).alias("template")))
        at = said.select(*OWN_BUCKET, "template", F.posexplode(F.split("masked", " ")).alias("pos", "token"))
        common = at.groupBy(*OWN_BUCKET, "pos").agg(F.min("token").alias("a"), F.max("token").alias("b"), F.max(F.col("template") & (F.col("token") == WILDCARD)).alias("open"))
        part = F.struct("pos", F.when(F.col("a") == F.col("b"), F.col("a")).otherwise(WILDCARD).alias("t"))
        merged = common.groupBy(*OWN_BUCKET).agg(F.sum((F.col("open") | (F.col("a") == F.col("b"))).cast("int")).alias("same"), F.array_sort(F.collect_list(part)).alias("parts"))
        enough = F.coalesce(F.col("same") / F.col("n_tokens") >= F.lit(float(self.threshold)), F.lit(False))
        return whole.join(merged, OWN_BUCKET, "left").select(
            *OWN_BUCKET,
            F.lit(0).alias("at"),
            "cluster_id",
            F.coalesce("had", "first_line").alias("first_line"),
            F.when(single, F.col("least")).otherwise(F.array_join(F.col("parts.t"), " ")).alias("typed"),
            (one & (single | enough)).alias("fast"),
        )

    def _passed(self, keyed: DataFrame, state: DataFrame) -> DataFrame:
        """Two kinds of rows for buckets that are read in order: of each line, with the number of its cluster, and of each cluster, with its template."""
        threshold, most = self.threshold, self.most
        known = state.select(*_STATE_COLUMNS).withColumns({"dataset": F.lit(None).cast("string"), "line_no": F.lit(None).cast("long"), "line": F.lit(None).cast("string"), "masked": F.lit(None).cast("string")})
        new = keyed.select(*OWN_BUCKET, "dataset", "line_no", "line", "masked")
        rows = dealt(known.unionByName(new, allowMissingColumns=True), OWN_BUCKET).sortWithinPartitions(*OWN_BUCKET, F.col("at").asc_nulls_last(), "line_no")
        names = [*_STATE_COLUMNS, "dataset", "line_no", "line"]
        types = [pa.int32(), pa.string(), pa.int32(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string()]

        def run(batches):
            at, templates, ids, first, bucket = None, [], [], [], None

            def table(n, columns):
                given = {"n_tokens": [at[0]] * n, "key": [at[1]] * n, **columns}
                return pa.RecordBatch.from_arrays([pa.array(given[c], t) if isinstance(given.get(c), list) else given.get(c, pa.nulls(n, t)) for c, t in zip(names, types, strict=True)], names=names)

            def clusters():
                made = bucket or Bucket(threshold, most, templates)
                return table(made.n, {"at": list(range(made.n)), "cluster_id": [*ids, *[None] * (made.n - len(ids))], "first_line": first, "typed": [made.template(i) for i in range(made.n)]})

            for batch in batches:
                for start, end, key in runs(batch, OWN_BUCKET):
                    if key != at:
                        if at:
                            yield clusters()
                        at, templates, ids, first, bucket = key, [], [], [], None
                    part = batch.slice(start, end - start)
                    k = part.num_rows - part.column("at").null_count  # clusters come first
                    templates += part.column("typed").slice(0, k).to_pylist()
                    ids += part.column("cluster_id").slice(0, k).to_pylist()
                    first += part.column("first_line").slice(0, k).to_pylist()
                    if k == part.num_rows:
                        continue
                    part = part.slice(k)
                    bucket = bucket or Bucket(threshold, most, templates)
                    numbers = []
                    for n, masked in zip(part.column("line_no").to_pylist(), part.column("masked"), strict=True):
                        numbers.append(bucket.add(masked.as_py()))
                        if numbers[-1] == len(first):
                            first.append(n)
                    yield table(part.num_rows, {"at": numbers, **{c: part.column(c) for c in ("dataset", "line_no", "line")}})
            if at:
                yield clusters()

        return rows.mapInArrow(run, f"{_STATE}, dataset string, line_no long, line string")

    def add_log(self, line: str) -> tuple[int, str]:
        """Cluster id and template of one more line, as they are after it. For many lines use parse().

        The line's bucket is read once and held in memory, up to OPEN of them; save(), parse() or a full memory write them, no line does by itself.
        """
        row = bucketed(self._spark.createDataFrame([(line,)], "line string"), self.masks, self.depth).select("masked", "n_tokens", "key").first()
        key = row.n_tokens, row.key
        if key not in self._open:
            if len(self._open) >= OPEN:
                self.save()
            known = sorted(self.state.where((F.col("n_tokens") == key[0]) & (F.col("key") == F.lit(key[1]))).select("at", "cluster_id", "first_line", "typed").collect())
            self._open[key] = Bucket(self.threshold, self.most, [r.typed for r in known]), [r.cluster_id for r in known], [r.first_line for r in known]
        bucket, ids, first = self._open[key]
        at = bucket.add(row.masked)
        if at == len(ids):
            ids.append(self._next)
            first.append(self._lines)
            self._next += 1
        self._lines += 1
        return ids[at], re.sub(text.PLACEHOLDER, WILDCARD, bucket.template(at))

    def templates(self, lines: DataFrame) -> DataFrame:
        return self.parse(lines).select("dataset", "line_no", "template")

    def n_clusters(self) -> int:
        return self._next
