"""What the corpus operators share: tables kept in the shared folder, and Arrow batches cut into small runs of documents."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.tables import keep, shared_dir  # noqa: F401

#: Stands for a null id inside the operators; it sorts before every other id.
NULL_ID = -(2**63)


def discard(df: DataFrame) -> None:
    """Delete the folder of a table made by keep() that nothing reads any more."""
    for path in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        where = df.sparkSession._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(where, True)


def id_key(column: str) -> Column:
    return F.coalesce(F.col(column), F.lit(NULL_ID))


def distinct_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """k, t, text, copies: a row for each distinct pair of id and text; k and t together are its key and its place in the order of documents.

    k is the id (NULL_ID for null), t the hash of the text where rows with this id have several texts, else 0. So rows without an id, or
    with a repeated one, are documents of their own that spread by their texts, while t costs nothing to shuffle where ids are unique.
    The ids with several texts are found first, as a kept table, whose size tells Spark how to join it; without any there is no join.
    """
    rows = docs.select(id_key(id_col).cast("long").alias("k"), F.col(text_col).alias("text"))
    h = F.xxhash64("text")
    shared = keep(rows.groupBy("k").agg(F.min(h).alias("a"), F.max(h).alias("b")).where("a <> b").select("k", F.lit(True).alias("shared")), "shared-ids")
    n = shared.limit(1).count()
    if n:
        rows = rows.join(shared, "k", "left")
    none = F.col("k").bitwiseAND(0)  # not a literal, which would be left out of the partitioning
    t = F.when(F.col("shared"), h).otherwise(none) if n else none
    return rows.select("k", t.alias("t"), "text").groupBy("k", "t").agg(F.first("text").alias("text"), F.count("*").alias("copies"))


def own_exchange(df: DataFrame, key: str) -> DataFrame:
    """df, aggregated by its long column key (never null), as a join input that is dealt out anew.

    An aggregate is already partitioned by its key, so a join on that key would use it as it is, and adaptive execution could not
    split a hot key of the other side. An expression in the key's place hides the partitioning: both inputs get an exchange of the join. As the
    expression is never null, the join adds no filter of its own below, and an exchange there can be shared with other uses of df.
    """
    return df.withColumn(key, F.coalesce(F.col(key), F.lit(NULL_ID)))


def free_name(df: DataFrame, name: str) -> str:
    """name, with underscores before it until df has no such column."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = "_" + name
    return name


def text_runs(column: pa.Array, most: int = 1 << 20, texts: int = 1 << 20):
    """Yield (first row, rows, bytes, offsets): runs of whole texts, up to `texts` of about `most` bytes, offsets from 0; a null text is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if pa.types.is_string(column.type):
        column = column.cast(pa.large_string())
    if column.null_count:
        column = column.fill_null("")
    n = len(column)
    if not n:
        return
    offsets = np.frombuffer(column.buffers()[1], np.int64, n + 1, column.offset * 8)
    data = column.buffers()[2]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    first = 0
    while first < n:
        last = max(first + 1, int(np.searchsorted(offsets, offsets[first] + most, "right")) - 1)
        last = min(last, n, first + texts)
        yield first, last - first, data[offsets[first] : offsets[last]], offsets[first : last + 1] - offsets[first]
        first = last


def ragged(column: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """Elements of an array column and the row of each."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    lengths = column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
    return column.flatten(), np.repeat(np.arange(len(lengths)), lengths)


def held_out(column: str) -> Column:
    """Whether a row is kept for testing: crc32 of its id as text, modulo 5, is 0. A null id counts as the empty text, which is."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary")) % 5 == 0
