"""Line dedup by a suffix array over line ids (native: DataFrame functions only).

Every document is a sequence of its normalised non-blank lines. Distributed prefix doubling sorts the
suffixes of all sequences by their first 1, 2, 4 .. lines: ranks of pairs of ranks are numbered in
range-partitioned order, so rank order is suffix order. Only suffixes whose prefix occurs twice or more go on,
which are few after the first round. A run of m lines, 2**k <= m < 2**(k + 1), is told by the ranks of its
first and its last 2**k lines; suffixes that agree in them share a longest common prefix of m lines or
more, and form an interval of the suffix array. All but the interval's first occurrence are later copies.

For each suffix m is the fewest lines with `min_words` words. Maximal repeated runs with as many words are exactly
the unions of these, so a line goes if it lies in a run of `min_words` words or more that occurs earlier.

Every round groups with map-side combine and joins by keys that Spark can split; ranks are checkpointed,
because numbering isn't repeatable.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, pick, wide_hash
from .quality import normal_line, words_of

#: A repeated run of lines goes from so many words on.
MIN_WORDS = 50


def needed_lines(counts: Column, min_words: int) -> Column:
    """For each line the fewest lines from it on with `min_words` words together; null where the text ends before."""
    zero = F.struct(F.lit(0).alias("words"), F.lit(0).alias("lines"))
    more = lambda a, n: F.when(a["words"] >= min_words, a).otherwise(F.struct((a["words"] + n).alias("words"), (a["lines"] + 1).alias("lines")))
    ahead = lambda i: F.aggregate(F.slice(counts, i + 1, F.lit(min_words)), zero, more, lambda a: F.when(a["words"] >= min_words, a["lines"]))
    return F.transform(counts, lambda _, i: ahead(i))


def told_lines(text: Column) -> Column:
    """The non-blank lines of a text: (number in the text, hash, words)."""
    every = F.transform(F.split(text, "\n"), lambda x, i: F.struct(i.alias("number"), wide_hash(normal_line(x)).alias("hash"), F.size(words_of(x)).alias("words")))
    return F.filter(every, lambda x: x["words"] > 0)


def suffixes(rows: DataFrame, min_words: int) -> DataFrame:
    """(id, text_hash, pos, number, hash, m) for each non-blank line of (id, text)."""
    lines = rows.select("id", F.xxhash64("text").alias("text_hash"), told_lines(F.col("text")).alias("lines"))
    needed = lines.withColumn("m", needed_lines(F.transform("lines", lambda x: x["words"]), min_words))
    return needed.select("id", "text_hash", F.posexplode(F.arrays_zip("lines", "m")).alias("pos", "x")).select("id", "text_hash", "pos", "x.lines.number", "x.lines.hash", "x.m")


def ranked(keys: DataFrame) -> DataFrame:
    """The distinct keys that occur twice or more, with `rank`: long integers in key order.

    Range partitions are sorted each by itself; the row ids that Spark gives rise from partition to partition.
    """
    names = keys.columns
    twice = keys.groupBy(*names).agg(F.count("*").alias("n")).where("n > 1").select(*names)
    return cut(twice.repartitionByRange(*names).sortWithinPartitions(*names).select(*names, F.monotonically_increasing_id().alias("rank")))


def shifted(active: DataFrame, by: Column) -> DataFrame:
    """The active suffixes with `rank2`, the rank `by` lines further on in the same document; inactive ones drop out."""
    there = active.select(F.col("id").alias("id2"), F.col("text_hash").alias("text_hash2"), F.col("pos").alias("pos2"), F.col("rank").alias("rank2"))
    same = F.col("id").eqNullSafe(F.col("id2")) & (F.col("text_hash") == F.col("text_hash2")) & (F.col("target") == F.col("pos2"))
    return active.withColumn("target", F.col("pos") + by).join(there, same).drop("id2", "text_hash2", "pos2", "target")


def later_copies(rows: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """(id, text_hash, pos, m): runs of m lines from pos on that occur earlier, in order of id (nulls last), text_hash, pos.

    Rows of (id, text) that agree in both are one document.
    """
    lines = cut(suffixes(rows, min_words).select("id", "text_hash", "pos", "hash.a", "hash.b", "m"))
    names = ranked(lines.select("a", "b"))
    active = cut(lines.join(names, ["a", "b"]).select("id", "text_hash", "pos", "rank", "m").dropDuplicates(["id", "text_hash", "pos"]))
    order = F.struct(F.col("id").isNull().alias("no_id"), "id", "text_hash", "pos")
    found, length = [], 1
    while True:
        due = active.where((F.col("m") >= length) & (F.col("m") < 2 * length))
        ready = due.withColumn("rank2", F.col("rank")) if length == 1 else shifted(active, F.col("m") - length).where((F.col("m") >= length) & (F.col("m") < 2 * length))
        firsts = ready.groupBy("m", "rank", "rank2").agg(F.min(order).alias("first"), F.count("*").alias("n")).where("n > 1").drop("n")
        copies = ready.join(firsts, ["m", "rank", "rank2"]).where(F.col("first") != order)
        found.append(cut(copies.select("id", "text_hash", "pos", "m")))
        if active.where(F.col("m") >= 2 * length).isEmpty():
            break
        pairs = cut(shifted(active, F.lit(length)))
        pairs = pairs.withColumnsRenamed({"rank": "left", "rank2": "right"})
        names = ranked(pairs.select("left", "right"))
        active = cut(pairs.join(names, ["left", "right"]).select("id", "text_hash", "pos", "rank", "m"))
        length *= 2
    result = found[0]
    for more in found[1:]:
        result = result.union(more)
    return result


def remove_repeats(documents: DataFrame, min_words: int = MIN_WORDS, id_column: str = "doc_id", text_column: str = "text", size_column: str = "n_chars", drop_emptied: bool = True) -> DataFrame:
    """The documents without later copies of repeated line runs, in the columns of the input.

    Blank lines stay. `size_column`, where there is one, is set anew for changed texts. Documents that lose all their
    words are dropped, unless `drop_emptied` is false. Null and empty texts stay as they are; identical rows are one document and lose the same lines.
    """
    columns = documents.columns
    rows = pick(documents, id=id_column, text=text_column).withColumn("text", F.coalesce("text", F.lit("")))
    runs = later_copies(rows, min_words)
    gone = runs.select("id", "text_hash", F.explode(F.sequence(F.col("pos"), F.col("pos") + F.col("m") - 1)).alias("pos"))
    gone = gone.groupBy(F.col("id").alias("gone_id"), F.col("text_hash").alias("gone_hash")).agg(F.collect_set("pos").alias("gone_lines"))
    text = F.coalesce(F.col(f"`{text_column}`"), F.lit(""))
    keyed = documents.select(F.struct(*(F.col(f"`{c}`") for c in columns)).alias("row"), F.col(f"`{id_column}`").alias("id"), F.xxhash64(text).alias("text_hash"))
    joined = keyed.join(gone, F.col("id").eqNullSafe(F.col("gone_id")) & (F.col("text_hash") == F.col("gone_hash")), "left")
    lines = F.split(F.col("row")[text_column], "\n")
    numbers = F.filter(F.transform(lines, lambda x, i: F.when(F.size(words_of(x)) > 0, i)), lambda i: i.isNotNull())
    joined = joined.withColumn("numbers", F.when(F.col("gone_lines").isNotNull(), numbers))
    out = F.transform("gone_lines", lambda p: F.get("numbers", p))
    rest = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), out)
    left = F.array_join(F.transform(rest, lambda i: F.get(lines, i)), "\n")
    told = joined.select("row", F.when(F.col("gone_lines").isNull(), F.col("row")[text_column]).otherwise(left).alias("left"), (F.size("numbers") == F.size("gone_lines")).alias("emptied"))
    if drop_emptied:
        told = told.where(~F.coalesce("emptied", F.lit(False)))
    value = lambda c: (
        F.col("left") if c == text_column else F.when(F.col("emptied").isNull(), F.col("row")[c]).otherwise(F.length("left")) if c == size_column else F.col("row")[c]
    )
    return told.select(*(value(c).alias(c) for c in columns))
