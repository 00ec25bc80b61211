"""Line dedup by winnowing over line hashes, in DataFrame functions alone.

Lines are the parts of a text between newlines; blank ones (nothing but spaces) take no part. Each `shingle` consecutive lines are hashed; of
every `width` consecutive hashes the least (the rightmost of equals) is a fingerprint, so each run of width + shingle - 1 lines holds one,
chosen by its lines alone: two equal runs have the same fingerprint at the same offset. A line of `long_words` words or more is also a run, and a
fingerprint, of its own, so a passage on one or two lines is found like one on many short lines.

A row is the position of a fingerprint, with the lines around it that the runs that chose it can reach. Positions are joined twice. First each meets the
first position with the same context, all the lines of its runs. What has no equal before it is the first of its context; where a fingerprint has several
contexts, their first positions meet the first with a run in common. From such a pair the match is extended to the left and to the right as far
as the lines around both agree, and it counts if it has the lines of a run. A longer match goes on with the next fingerprint, which is less than `width` lines on.
Every line of a match is deleted; neighbouring and overlapping matches join, with blank lines inside.

Scale: text is shuffled once, in the last join; all else moves hashes of lines, a row for each fingerprint. Hot lines meet only in aggregates, which
are summed before the shuffle, and in joins whose hot keys adaptive execution can split; a text's own matches are the only group that is sorted.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import id_key, keep, own_exchange

SHINGLE, WIDTH, LONG_WORDS = 1, 3, 20
_WORD = "[^\\x20\\x09-\\x0D]+"


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, width: int = WIDTH, long_words: int = LONG_WORDS) -> DataFrame:
    """Positions of fingerprints: k (the id, NULL_ID for null), th (hash of the text), at (number of a line that isn't blank, from 1), g (its hash), n
    (lines of a run), first and last (where the runs that chose it begin), around (hashes of the lines that these runs can reach) and low (the number of
    the first of these)."""
    length = shingle + width - 1
    is_long = (F.length("line") >= 2 * long_words - 1) & (F.regexp_count("line", F.lit(_WORD)) >= long_words)
    lines = (
        docs.select(id_key(id_col).alias("k"), F.xxhash64(text_col).alias("th"), F.posexplode(F.split(text_col, "\n")).alias("pos", "line"))
        .where(F.trim("line") != "")
        .select("k", "th", "pos", F.xxhash64("line").alias("h"), is_long.alias("long"))
        .repartition("k", "th")
        .dropDuplicates(["k", "th", "pos"])  # of repeated rows
    )
    order = W.partitionBy("k", "th").orderBy("pos")
    ahead = [F.col("h"), *(F.lead("h", j).over(order) for j in range(1, length))]
    gram = F.when(ahead[shingle - 1].isNotNull(), F.xxhash64(*ahead[:shingle]))
    hashed = lines.select("k", "th", "pos", "h", "long", F.row_number().over(order).alias("i"), gram.alias("g"), ahead[-1].isNotNull().alias("whole"))
    least = F.min(F.struct("g", (-F.col("i")).alias("at"))).over(order.rowsBetween(0, width - 1))
    chose = hashed.withColumn("chosen", F.when(F.col("whole"), -least["at"]))
    before = [F.when(F.lag("chosen", j).over(order) == F.col("i"), F.col("i") - j) if j else F.when(F.col("chosen") == F.col("i"), F.col("i")) for j in range(width)]
    around = F.collect_list("h").over(order.rowsBetween(1 - width, length - 1))
    seen = chose.select("*", around.alias("around"), *((F.least(*before), F.greatest(*before)) if width > 1 else (before[0], before[0])))
    seen = seen.toDF(*chose.columns, "around", "first", "last")
    of_runs = F.when(F.col("first").isNotNull(), F.struct(F.col("i").alias("at"), "g", F.lit(length).alias("n"), "first", "last", F.greatest(F.lit(1), F.col("i") - (width - 1)).alias("low"), "around"))
    alone = F.struct(F.col("i").alias("at"), F.xxhash64("h", F.lit("line")).alias("g"), F.lit(1).alias("n"), F.col("i").alias("first"), F.col("i").alias("last"), F.col("i").alias("low"), F.array("h").alias("around"))
    return seen.select("k", "th", F.inline(F.array_compact(F.array(of_runs, F.when(F.col("long") & F.lit(length > 1), alone)))))


def _agreeing(own: Column, other: Column) -> Column:
    """How many of the first elements of two arrays agree."""
    n = F.least(F.size(own), F.size(other))
    differ = F.array_position(F.zip_with(F.slice(own, F.lit(1), n), F.slice(other, F.lit(1), n), lambda x, y: x != y), True)
    return F.when(differ == 0, n).otherwise(differ - 1).cast("int")


def positions(prints: DataFrame) -> DataFrame:
    """Those of fingerprints() that have an earlier position (ref: k, th, at, low, around) with the same context, or with a run in common: at most a
    row for each fingerprint, but for the first ones of their contexts, which may meet one for each of their runs.

    Only fingerprints that stand at several places take part, and only those with several contexts in the second join.
    """
    place = F.struct("k", "th", "at")
    of = lambda x: F.struct(F.col(f"{x}.k"), F.col(f"{x}.th"), F.col(f"{x}.at"))
    spot, with_lines = F.xxhash64("k", "th", "at"), F.struct("k", "th", "at", "low", "around")
    cut = lambda start, m: F.slice("around", start - F.col("low") + 1, m)
    repeated = prints.groupBy("g").agg(F.min(spot).alias("a"), F.max(spot).alias("b")).where("a <> b").select("g")
    whole, offset = cut(F.col("first"), F.col("last") - F.col("first") + F.col("n")), F.col("at") - F.col("first")
    keyed = prints.join(own_exchange(repeated, "g"), "g").withColumn("span", F.xxhash64(whole, offset, F.col("n"))).withColumn("span2", F.hash(whole))
    keyed = keep(keyed, "prints")
    contexts = keyed.groupBy("span", "span2").agg(F.min(with_lines).alias("ref"))
    placed = keep(keyed.join(own_exchange(contexts, "span"), ["span", "span2"]).drop("span", "span2"), "placed")
    same = placed.where(place != of("ref"))
    firsts = placed.where((place == of("ref")) & (F.col("n") > 1)).drop("ref")
    several = firsts.groupBy("g").agg(F.count("*").alias("contexts")).where("contexts > 1").select("g")
    runs = firsts.join(own_exchange(several, "g"), "g").withColumn("start", F.explode(F.sequence("first", "last")))
    run = cut(F.col("start"), F.col("n"))
    runs = runs.select(*firsts.columns, F.xxhash64(run, F.col("at") - F.col("start")).alias("run"), F.hash(run).alias("run2"))
    shared = runs.groupBy("run", "run2").agg(F.min(with_lines).alias("ref"), F.count("*").alias("many")).where("many > 1").drop("many")
    part = runs.join(own_exchange(shared, "run"), ["run", "run2"]).where(place != of("ref"))
    return same.select("k", "th", "at", "n", "low", "around", "ref").unionByName(part.select("k", "th", "at", "n", "low", "around", "ref"))


def matches(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, width: int = WIDTH, long_words: int = LONG_WORDS) -> DataFrame:
    """Matches with earlier lines, one for each joined position, extended as far as the lines around both agree: k, th, lines (of a run), i and n (its lines
    that aren't blank, the first and how many), and ref (k, th, i: the earlier place)."""
    joined = positions(fingerprints(docs, id_col, text_col, shingle, width, long_words))
    own, other = F.col("around"), F.col("ref.around")
    x, y = F.col("at") - F.col("low"), F.col("ref.at") - F.col("ref.low")  # lines before the fingerprint's
    left = _agreeing(F.reverse(F.slice(own, F.lit(1), x)), F.reverse(F.slice(other, F.lit(1), y)))
    right = _agreeing(F.slice(own, x + 1, F.size(own) - x), F.slice(other, y + 1, F.size(other) - y))
    found = joined.select("k", "th", "n", "at", "ref", left.alias("left"), right.alias("right")).where(F.col("left") + F.col("right") >= F.col("n"))
    ref = F.struct(F.col("ref.k").alias("k"), F.col("ref.th").alias("th"), (F.col("ref.at") - F.col("left")).alias("i"))
    return found.select("k", "th", F.col("n").alias("lines"), (F.col("at") - F.col("left")).alias("i"), (F.col("left") + F.col("right")).alias("n"), ref.alias("ref"))


def repeated_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, width: int = WIDTH, long_words: int = LONG_WORDS) -> DataFrame:
    """Runs of lines to delete: k (the id, NULL_ID for null), th (hash of the text), runs (array of {i, n}: the first line and how many, of those that
    aren't blank, from 1)."""
    by_i = W.partitionBy("k", "th").orderBy("i", "n")
    before = F.max(F.col("i") + F.col("n")).over(by_i.rowsBetween(W.unboundedPreceding, -1))
    return (
        matches(docs, id_col, text_col, shingle, width, long_words)
        .select("k", "th", "i", "n")
        .withColumn("apart", F.when(F.col("i") <= before, 0).otherwise(1))
        .withColumn("island", F.sum("apart").over(by_i))
        .groupBy("k", "th", "island")
        .agg(F.min("i").alias("i"), (F.max(F.col("i") + F.col("n")) - F.min("i")).alias("n"))
        .groupBy("k", "th")
        .agg(F.array_sort(F.collect_list(F.struct("i", "n"))).alias("runs"))
    )


def remove_repeated_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, width: int = WIDTH, long_words: int = LONG_WORDS) -> DataFrame:
    """docs with repeated runs of lines deleted from text, and three more columns: n_lines, n_removed (lines deleted) and removed_runs.

    Deleted is every run of shingle + width - 1 lines, and every line of at least long_words words, that stands earlier in the corpus.
    A null text stays null with no lines; an empty text has one blank line. A null id sorts before all others. Equal rows are kept alike;
    rows that share an id but not the text count as two documents in the order of a hash of their texts. Other columns are kept as
    they are; columns named n_lines, n_removed or removed_runs are replaced.
    """
    docs = docs.drop("n_lines", "n_removed", "removed_runs")
    joined = docs.select(id_key(id_col).alias("k"), F.xxhash64(text_col).alias("th"), F.struct(*docs.columns).alias("row")).join(repeated_runs(docs, id_col, text_col, shingle, width, long_words), ["k", "th"], "left")
    text = F.col("row").getField(text_col)
    full = F.filter(F.transform(F.split(text, "\n"), lambda x, i: F.when(F.trim(x) != "", i)), lambda i: i.isNotNull())  # places of the lines that aren't blank
    spans = F.transform(F.array(full), lambda at: F.transform("runs", lambda r: F.struct(F.get(at, r["i"] - 1).alias("s"), F.get(at, r["i"] + r["n"] - 2).alias("e"))))
    joined = joined.withColumn("runs", F.when(F.col("runs").isNotNull(), F.get(spans, F.lit(0))))
    runs = F.col("runs")

    def between(lines, r):
        """Lines after run r - 1 and before run r."""
        begin = F.when(r == 0, F.lit(0)).otherwise(F.get(runs, r - 1)["e"] + 1)
        end = F.when(r == F.size(runs), F.size(lines)).otherwise(F.get(runs, r)["s"])
        return F.slice(lines, begin + 1, end - begin)

    kept = F.get(F.transform(F.array(F.split(text, "\n")), lambda lines: F.array_join(F.flatten(F.transform(F.sequence(F.lit(0), F.size(runs)), lambda r: between(lines, r))), "\n")), F.lit(0))
    removed = F.aggregate(runs, F.lit(0).cast("long"), lambda n, r: n + (r["e"] - r["s"] + 1).cast("long"))
    n_lines = F.when(text.isNull(), 0).otherwise(F.size(F.split(text, "\n"))).cast("long")
    columns = [F.when(runs.isNull(), text).otherwise(kept).alias(c) if c == text_col else F.col("row").getField(c).alias(c) for c in docs.columns]
    return joined.select(*columns, n_lines.alias("n_lines"), F.coalesce(removed, F.lit(0).cast("long")).alias("n_removed"), runs.alias("removed_runs"))
