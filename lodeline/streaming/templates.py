"""Template mining on streams.

Both parsers keep their state key by key in maps of the state store, of which a micro-batch writes only the entries that it changed; this needs the
RocksDB store, which the functions here set in the session. A key's rows of a micro-batch come in any number of chunks; they are put together, bounded by what a
trigger admits, and parsed in one pass in the order of line_no.

Dense global ids can't be given out by a distributed stream: a cluster is named by its bucket and its number in it, and by a hash of both.
dense_ids() gives them in a batch over the results, and continues from the ids that it gave before.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from ..functions import text
from ..functions.patterns import Mask
from ..operators.clustering import BUCKET, DEPTH, MOST, THRESHOLD, Bucket, bucketed, numbered
from ..operators.online import THRESHOLD as LEAST
from ..operators.online import Groups

_STORE = "spark.sql.streaming.stateStore.providerClass"
_ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def _prepare(spark: SparkSession) -> None:
    spark.conf.set(_STORE, _ROCKS)


def _ordered(rows: Iterator[pd.DataFrame]) -> pd.DataFrame:
    """All chunks of a key's rows of a micro-batch, in order."""
    return pd.concat(list(rows), ignore_index=True).sort_values("line_no", kind="stable")


class _Templates(StatefulProcessor):
    """Lines of one bucket. State: the template of each cluster by its number, `most` at most."""

    def __init__(self, threshold: float, most: int):
        self.threshold, self.most = threshold, most

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.kept = handle.getMapState("templates", "number int", "template string")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        part = _ordered(rows)
        bucket = Bucket(self.threshold, self.most, [t for _, t in sorted((k[0], v[0]) for k, v in self.kept.iterator())])
        numbers, now = [], []
        for masked in part["masked"]:
            numbers.append(bucket.add(masked))
            now.append(bucket.template(numbers[-1]))
        for number in bucket.changed:
            self.kept.updateValue((number,), (bucket.template(number),))
        yield pd.DataFrame({"dataset": key[0], "n_tokens": key[1], "key": key[2], "line_no": part["line_no"].to_numpy(), "number": numbers, "template": now})

    def close(self) -> None:
        pass


def parse_stream(lines: DataFrame, masks: Sequence[Mask], depth: int = DEPTH, threshold: float = THRESHOLD, most: int = MOST) -> DataFrame:
    """dataset, line_no, cluster (hash), number, template for each line, with the template as it is when the line arrives.

    Lines of a micro-batch are taken in the order of line_no, after all lines of earlier ones.
    """
    _prepare(lines.sparkSession)
    keyed = bucketed(lines, masks, depth).select(*BUCKET, "line_no", "masked")
    out = keyed.groupBy(*BUCKET).transformWithStateInPandas(_Templates(threshold, most), "dataset string, n_tokens int, key string, line_no long, number long, template string", "append", "none")
    name = F.sha1(F.concat_ws(":", "dataset", "n_tokens", "key", "number"))
    return out.select("dataset", "line_no", name.alias("cluster"), "number", text.wildcards(F.col("template")).alias("template"))


def dense_ids(results: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """dataset, cluster, cluster_id, first_line for each cluster of parse_stream() results: ids are dense from 0 in each dataset, by first line.

    known: what an earlier call gave. Its clusters keep their ids and those that are new get the ids after the highest; so the ids are those of the
    batch parser where later micro-batches have later lines.
    """
    first = results.groupBy("dataset", "cluster").agg(F.min("line_no").alias("first_line"))
    if known is None:
        return numbered(first).select("dataset", "cluster", "cluster_id", "first_line")
    fresh = numbered(first.join(known, ["dataset", "cluster"], "left_anti"))
    after = known.groupBy("dataset").agg((F.max("cluster_id") + 1).alias("after"))
    placed = fresh.join(after, "dataset", "left").withColumn("cluster_id", F.col("cluster_id") + F.coalesce("after", F.lit(0)))
    return known.select("dataset", "cluster", "cluster_id", "first_line").unionByName(placed.select("dataset", "cluster", "cluster_id", "first_line"))


class _Online(StatefulProcessor):
    """Records of one source. State: id, template and size of each group by its number, and the group of each first token and length."""

    def __init__(self, threshold: float):
        self.threshold = threshold

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.groups = handle.getMapState("groups", "number int", "id string, template string, size long")
        self.cache = handle.getMapState("cache", "first_token string, n_tokens int", "number int")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        part = _ordered(rows)
        known = sorted((k[0], tuple(v)) for k, v in self.groups.iterator())
        own = Groups(key[0], self.threshold, [(i, t.split(" "), n) for _, (i, t, n) in known], {tuple(k): v[0] for k, v in self.cache.iterator()})
        out = []
        for n, joined in zip(part["line_no"], part["joined"], strict=True):
            at = own.add(n, joined.split(" "))
            out.append((own.ids[at], own.sizes[at], " ".join(own.template(at))))
        for at in own.changed:
            self.groups.updateValue((at,), (own.ids[at], " ".join(own.template(at)), own.sizes[at]))
        for entry in own.cached:
            self.cache.updateValue(entry, (own.cache[entry],))
        ids, sizes, templates = zip(*out, strict=True)
        yield pd.DataFrame({"source": key[0], "line_no": part["line_no"].to_numpy(), "group_id": ids, "size": sizes, "template": templates})

    def close(self) -> None:
        pass


def online_stream(records: DataFrame, threshold: float = LEAST) -> DataFrame:
    """The online parser on a stream of records (source, line_no, line): source, line_no, group_id, size, template."""
    _prepare(records.sparkSession)
    rows = records.select("source", "line_no", F.array_join(text.tokens(F.col("line")), " ").alias("joined")).where("joined <> ''")
    return rows.groupBy("source").transformWithStateInPandas(_Online(threshold), "source string, line_no long, group_id string, size long, template string", "append", "none")
