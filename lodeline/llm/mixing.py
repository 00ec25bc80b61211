"""Mixing sources to target weights: Sainte-Lague apportionment of equal-token blocks, in DataFrame functions alone.

Targets: sources in the order of their names (code points, null last) weigh `weights`, repeating, and share `share` times all words; no
target exceeds `most` times its source's size, and what is above is shared again by weight until none is.

Apportionment: documents are dealt by a seeded hash into shards of about `shard_docs` documents of all sources. In a shard the parties are the
sources, and a source's claim is its words there times its target over its size. The shard has round(sum of claims / block) blocks. A quota is the claim
over the block size, rounded; blocks still missing go one by one to the highest quotients claim / (2 quota + 1), blocks too many come from
the lowest claim / (2 quota - 1), of equal ones to the first name and from the last: the divisor method of odd numbers, in every shard by itself.

Selection: the documents of a source in a shard, in seeded order, make a stream of words, cut in equal blocks; the source takes its quota of blocks from
the start, going around again where the quota exceeds the stream. So a document is taken whole as often as the stream goes around it, and
at most one document of each source and shard is taken in part.

Scale: the text is read once to count words; what is shuffled is a few numbers for each document, equal rows as one with their count. A
source of any size is spread over all shards; the only table in one task has a row for each source.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import id_key, keep

WEIGHTS, SHARE, MOST = (3, 1, 2), 1.5, 2.0
BLOCK, SHARD_DOCS, SEED = 8, 512, "mix-1"
_WORD = "[^\\x20\\x09-\\x0D]+"


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(_WORD)), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """sizes (source, name, source_size, ...; one row for each source) with weight and target.

    Sources stop at their cap in the order of cap / weight; the rate at which the rest is shared is that of the first source that it doesn't fill.
    """
    rank = F.row_number().over(W.orderBy(F.col("source").asc_nulls_last()))
    weight = F.element_at(F.array(*map(F.lit, weights)), ((rank - 1) % len(weights) + 1).cast("int")).cast("double")
    by_fill = W.orderBy("fill", "name")
    capped = sizes.withColumn("weight", weight).withColumn("cap", F.col("source_size") * F.lit(float(most))).withColumn("fill", F.col("cap") / F.col("weight"))
    stopped = F.coalesce(F.sum("cap").over(by_fill.rowsBetween(W.unboundedPreceding, -1)), F.lit(0.0))
    open_weight = F.sum("weight").over(by_fill.rowsBetween(0, W.unboundedFollowing))
    goal = F.lit(float(share)) * F.sum("source_size").over(W.partitionBy())
    filled = capped.withColumn("rate", (goal - stopped) / open_weight)
    rate = F.coalesce(F.min(F.when(F.col("fill") > F.col("rate"), F.struct("fill", "name", "rate"))).over(W.partitionBy())["rate"], F.lit(0.0))
    return filled.withColumn("target", F.least(F.col("cap"), rate * F.col("weight"))).drop("cap", "fill", "rate")


def apportion(parties: DataFrame, claim: str, block: int, shard: str = "shard") -> DataFrame:
    """parties (shard, name, claim, ...) with `quota`: blocks for each by Sainte-Lague, round(sum of claims / block) of them in each shard."""
    of_shard = W.partitionBy(shard)
    quota = parties.withColumn("quota", F.floor(F.col(claim) / block + 0.5))
    quota = quota.withColumn("total", F.sum(claim).over(of_shard)).withColumn("missing", F.floor(F.col("total") / block + 0.5) - F.sum("quota").over(of_shard))
    turns = F.when(F.col(claim) > 0, F.sequence(F.lit(0), F.lit(1) + F.ceil(F.abs("missing") * F.col(claim) / F.col("total")).cast("int"))).otherwise(F.array().cast("array<int>"))
    more = F.col("missing") > 0
    turn = quota.where("missing <> 0").withColumn("j", F.explode(turns)).where(more | (F.col("quota") > F.col("j")))
    quotient = F.when(more, -F.col(claim) / (2 * (F.col("quota") + F.col("j")) + 1)).otherwise(F.col(claim) / (2 * (F.col("quota") - F.col("j")) - 1))
    given = turn.withColumn("rank", F.row_number().over(of_shard.orderBy(quotient, F.when(more, F.col("name")), F.desc("name"), "j"))).where(F.col("rank") <= F.abs("missing"))
    change = given.groupBy(shard, "name").agg(F.count("*").alias("change"))
    changed = quota.join(change, [shard, "name"], "left")
    return changed.withColumn("quota", F.col("quota") + F.signum("missing").cast("long") * F.coalesce("change", F.lit(0))).drop("change", "total", "missing")


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: float = MOST, block: int = BLOCK, shard_docs: int = SHARD_DOCS, seed: str = SEED) -> DataFrame:
    """For each document: id, size (words), source_size, target (its source's), taken (words the mix takes, repeats counted), th.

    A null text has no words, and nothing is taken of it. A null source is a source of its own. Rows without an id, or with a repeated one, are
    dealt by their texts as well. Equal rows follow each other; which of them is taken in part does not matter. Empty input gives no rows. Other
    columns are not read. th is a hash of the text, which tells rows with equal ids apart.
    """
    counted = docs.select(F.col(id_col).cast("long").alias("id"), F.col(source_col).cast("string").alias("source"), word_count(F.col(text_col)).alias("size"), F.xxhash64(text_col).alias("th"), F.md5(text_col).alias("digest"))
    name = F.coalesce(F.concat(F.lit("="), F.col("source")), F.lit("-"))
    dealt_by = F.md5(F.concat_ws(":", F.lit(seed), F.col("id").cast("string"), F.col("digest")))
    alike = counted.withColumn("name", name).withColumn("u", dealt_by).groupBy("id", "name", "source", "size", "th", "u").agg(F.count("*").alias("copies"))
    sized = keep(alike, "mix-sizes")
    by_source = sized.groupBy("name", "source").agg(F.sum(F.col("size") * F.col("copies")).alias("source_size"))
    targets = keep(source_targets(by_source, weights, share, most), "mix-targets")
    shards = max(1, -(-(sized.agg(F.sum("copies")).first()[0] or 0) // shard_docs))
    dealt = sized.join(targets.select("name", "source_size", "target"), "name").withColumn("shard", F.conv(F.substring("u", 1, 12), 16, 10).cast("long") % shards)
    claims = dealt.groupBy("name", "shard").agg(F.sum(F.col("size") * F.col("copies")).alias("stream"), F.max(F.col("target") / F.greatest(F.col("source_size"), F.lit(1))).alias("rate"))
    parties = keep(claims.withColumn("claim", F.col("stream") * F.col("rate")), "mix-parties")
    quotas = apportion(parties, "claim", block).select("name", "shard", "stream", (F.col("quota") * block).alias("words"))
    order = W.partitionBy("name", "shard").orderBy("u", "id", "size", "th")
    before = F.coalesce(F.sum(F.col("size") * F.col("copies")).over(order.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    each = dealt.withColumn("before", before).withColumn("copy", F.explode(F.sequence(F.lit(0).cast("long"), F.col("copies") - 1))).withColumn("before", F.col("before") + F.col("copy") * F.col("size"))
    around = F.floor(F.col("words") / F.greatest(F.col("stream"), F.lit(1)))
    part = F.greatest(F.lit(0), F.least(F.col("size"), F.col("words") - around * F.col("stream") - F.col("before")))
    taken = F.least(F.col("size") * around + part, F.floor(F.col("size") * F.lit(most)).cast("long"))
    return each.join(quotas, ["name", "shard"]).select(F.col("id").alias(id_col), "size", "source_size", "target", taken.cast("long").alias("taken"), "th")


def mixed_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The documents of the mix, each as many times as its taken words make it whole, rounded; documents without words are left out."""
    plan = mix(docs, id_col, text_col, **options).where("size > 0")
    copies = plan.groupBy(id_key(id_col).alias("k"), "th").agg(F.round(F.sum("taken") / F.sum("size")).cast("int").alias("copies")).where("copies > 0")
    joined = docs.select(id_key(id_col).alias("k"), F.xxhash64(text_col).alias("th"), F.struct(*docs.columns).alias("row")).join(copies, ["k", "th"])
    return joined.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies")))).select("row.*")
