"""Quality rules by cross-document line frequency (native: DataFrame functions only).

Lines are normalised and hashed; for each host (the `source` of a document) the operator counts how many
distinct documents hold a line. Lines above the limit are removed, and documents of which too little
remains are rejected. Copies of one document would push all their lines over any limit, so a line only
counts as boilerplate if no single text accounts for most of its documents. Texts are told apart by the
smallest hash among the three-word windows of what they have of their own: lines that are neither above the limit nor
edits of such lines (which share one of their least window hashes with them). Texts without lines of their own,
as exact or edited copies, are told apart by the smallest hash of all their lines.

One scan reduces each text to its metrics and its lines' hashes, which are written; aggregations and joins are of
these only, and texts are never shuffled by the query (`clean` shuffles them once). Keys are only made for documents that
hold a line above the limit. A hot line or host meets partial counts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACE_CLASS, cut, let, pick

#: Rules of the base check.
MIN_WORDS, MAX_REPEATED_PERCENT = 50, 50
#: A line in more than so many documents of a host is removed ...
MAX_DOCUMENTS = 20
#: ... unless one text makes up at least this share of them.
COPY_SHARE = 0.5
#: Least window hashes kept of a line.
SKETCH = 4
#: A document is depleted if less than this share of its words remains.
MIN_REMAINING = 0.2


def words_of(text: Column) -> Column:
    """The words of a text: maximal runs of characters other than the six ASCII white-space ones."""
    return F.filter(F.split(text, f"[{SPACE_CLASS}]+"), lambda w: w != "")


def lines_of(text: Column) -> Column:
    """The \\n-split lines that hold a word."""
    return F.filter(F.split(text, "\n"), lambda x: x.rlike(f"[^{SPACE_CLASS}]"))


def normal_line(line: Column) -> Column:
    """A line for comparison: lower case, white space trimmed and folded."""
    return F.trim(F.regexp_replace(F.lower(line), f"[{SPACE_CLASS}]+", " "))


def window_hashes(words: Column) -> Column:
    """64-bit hashes of the three-word windows, in order; empty for fewer than three words."""
    last = F.size(words) - 3
    hashed = F.transform(F.sequence(F.lit(0), last), lambda i: F.xxhash64(F.get(words, i), F.get(words, i + 1), F.get(words, i + 2)))
    return F.when(last >= 0, hashed).otherwise(F.array().cast("array<bigint>"))


def repeated_words(windows: Column) -> Column:
    """Number of words inside windows that occur twice or more.

    Most texts have no repeated window, which a hash set tells. Else windows are sorted with their
    positions, those equal to a neighbour are kept, and the lengths of their union are summed: O(n log n).
    """

    def repeated(s: Column) -> Column:
        same = lambda x, i: F.coalesce(x["h"] == F.get(s, i)["h"], F.lit(False))
        return F.transform(F.filter(s, lambda x, i: same(x, i - 1) | same(x, i + 1)), lambda x: x["i"])

    with_positions = F.sort_array(F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    positions = F.sort_array(let(with_positions, repeated))
    covered = F.aggregate(
        positions,
        F.struct(F.lit(0).alias("end"), F.lit(0).alias("sum")),
        lambda a, p: F.struct((p + 3).alias("end"), (a["sum"] + p + 3 - F.greatest(p, a["end"])).alias("sum")),
        lambda a: a["sum"],
    )
    return F.when(F.size(F.array_distinct(windows)) == F.size(windows), F.lit(0)).otherwise(covered)


def told_lines(text: Column) -> Column:
    """The lines of a text that hold a word, as structs: position among all lines, hash, words, least window hashes
    in order (none for fewer than three words)."""

    def told(position: Column, normal: Column) -> Column:
        def of(words: Column) -> Column:
            sketch = F.slice(F.sort_array(F.array_distinct(window_hashes(words))), 1, SKETCH)
            return F.struct(position.alias("position"), F.xxhash64(normal).alias("line"), F.size(words).alias("n"), sketch.alias("sketch"))

        return let(F.filter(F.split(normal, " "), lambda w: w != ""), of)

    every = F.transform(F.split(text, "\n"), lambda x, i: let(normal_line(x), lambda normal: told(i, normal)))
    return F.filter(every, lambda x: x["n"] > 0)


def metrics(text: Column) -> Column:
    """The base check of a text as a struct. Words and windows are bound inside the expression, so that no
    optimizer rule can put their computation into the lambdas that go over them."""
    lines = lines_of(text)

    def told(words: Column, windows: Column) -> Column:
        n, repeats = F.size(words).cast("bigint"), repeated_words(windows).cast("bigint")
        return F.struct(
            n.alias("n_words"),
            (F.length(text) - F.regexp_count(text, F.lit(f"[{SPACE_CLASS}]"))).cast("bigint").alias("word_chars"),
            F.regexp_count(text, F.lit("[#*$%&|<>]")).cast("bigint").alias("n_symbols"),
            let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("bigint").alias("n_dup_lines"),
            repeats.alias("n_repeat_words"),
        )

    return let(words_of(text), lambda w: let(window_hashes(w), lambda x: told(w, x)))


def base_failed(told: Column) -> Column:
    return (told["n_words"] < MIN_WORDS) | (100 * told["n_repeat_words"] > MAX_REPEATED_PERCENT * told["n_words"])


def reduced(documents: DataFrame) -> DataFrame:
    """Each row of (id, source, text) as its number d, id, source, text_hash, n_words ... base_failed, lines; written to the checkpoint folder."""
    told = documents.select("id", "source", F.xxhash64("text").alias("text_hash"), metrics(F.col("text")).alias("told"), told_lines(F.col("text")).alias("lines"))
    told = told.select(F.monotonically_increasing_id().alias("d"), "id", "source", "text_hash", "told", "lines")
    return cut(told).select("d", "id", "source", "text_hash", "told.*", base_failed(F.col("told")).alias("base_failed"), "lines")


def holders_of(rows: DataFrame, max_documents: int) -> DataFrame:
    """(d, source, text_hash, lines, over): the rows of `reduced` that hold lines above the limit, and these."""
    lines = rows.select("d", "source", F.explode(F.array_distinct("lines.line")).alias("line"))
    over = lines.groupBy("source", "line").agg(F.count("*").alias("n")).where(F.col("n") > max_documents).select("source", "line")
    held = lines.join(over, ["source", "line"], "left_semi").groupBy("d").agg(F.collect_set("line").alias("over"))
    return cut(rows.select("d", "source", "text_hash", "lines").join(held, "d"))


def frequent_lines(holders: DataFrame, copy_share: float = COPY_SHARE) -> DataFrame:
    """(source, line): the lines above the limit that aren't mostly held by copies of one text."""
    mine = lambda x: F.array_contains("over", x["line"])
    rest = holders.select("d", "source", F.explode(F.filter("lines", lambda x: (F.size(x["sketch"]) > 0) & ~mine(x))).alias("x")).select("d", "source", "x.line", "x.sketch")
    # Lines that share a least window hash with one over the limit are edits of it.
    common = holders.select("source", F.explode(F.filter("lines", mine)).alias("x")).select("source", F.explode("x.sketch").alias("window")).distinct()
    edits = rest.select("source", "line", F.explode("sketch").alias("window")).distinct().join(common, ["source", "window"], "left_semi").select("source", "line").distinct()
    own = rest.join(edits, ["source", "line"], "left_anti").groupBy("d").agg(F.min(F.get("sketch", F.lit(0))).alias("own_key"))
    whole_key = F.array_min(F.transform("lines", lambda x: F.get(x["sketch"], F.lit(0))))
    keys = holders.select("d", "source", "over", F.coalesce(whole_key, "text_hash").alias("whole_key"))
    keyed = keys.join(own, "d", "left").select("source", F.coalesce("own_key", "whole_key").alias("copy_key"), F.explode("over").alias("line"))
    by_text = keyed.groupBy("source", "line", "copy_key").agg(F.count("*").alias("n"))
    by_line = by_text.groupBy("source", "line").agg(F.sum("n").alias("n"), F.max("n").alias("most"))
    return by_line.where(F.col("most") < copy_share * F.col("n")).select("source", "line")


def verdicts(rows: DataFrame, max_documents: int, min_remaining: float) -> DataFrame:
    """Rows of `reduced` without their lines, with n_removed, `gone` (positions of removed lines, null for none) and kept."""
    holders = holders_of(rows, max_documents)
    lines = holders.select("d", "source", F.explode(F.filter("lines", lambda x: F.array_contains("over", x["line"]))).alias("x")).select("d", "source", "x.position", "x.line", "x.n")
    removed = lines.join(frequent_lines(holders), ["source", "line"], "left_semi").groupBy("d").agg(F.sum("n").alias("n_removed"), F.collect_set("position").alias("gone"))
    told = rows.drop("lines").join(removed, "d", "left").withColumn("n_removed", F.coalesce("n_removed", F.lit(0)).cast("bigint"))
    return told.withColumn("kept", ~F.col("base_failed") & (F.col("n_words") - F.col("n_removed") >= min_remaining * F.col("n_words")))


def normal_input(documents: DataFrame, id_column: str, text_column: str, host_column: str) -> DataFrame:
    return pick(documents, id=id_column, source=host_column, text=text_column).withColumn("source", F.coalesce("source", F.lit(""))).withColumn("text", F.coalesce("text", F.lit("")))


def judge(documents: DataFrame, id_column: str = "doc_id", text_column: str = "text", host_column: str = "source", max_documents: int = MAX_DOCUMENTS, min_remaining: float = MIN_REMAINING) -> DataFrame:
    """One row for each document: id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
    n_removed (words in removed lines), kept.

    Null texts count as empty (base_failed), a null host as the host ''. Rows that agree in id, host and text
    get the same verdict, each its own row. Very long texts cost O(n log n). Further columns are dropped.
    """
    told = verdicts(reduced(normal_input(documents, id_column, text_column, host_column)), max_documents, min_remaining)
    return told.select(F.col("id").alias(id_column), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "n_removed", "kept")


def clean(documents: DataFrame, id_column: str = "doc_id", text_column: str = "text", host_column: str = "source", size_column: str = "n_chars", max_documents: int = MAX_DOCUMENTS, min_remaining: float = MIN_REMAINING) -> DataFrame:
    """The documents that are kept, without their removed lines, in the columns of the input.

    `size_column`, where the input has it, is set to the new number of code points. Texts that lose no line
    stay as they are. Null texts count as empty and go, null hosts are the host '', null ids are kept like others;
    rows that agree in id, host and text meet one verdict. An empty table gives an empty result. Further columns go
    along, whatever their names.
    """
    columns = documents.columns
    told = verdicts(reduced(normal_input(documents, id_column, text_column, host_column)), max_documents, min_remaining).where("kept")
    told = told.groupBy(F.col("id").alias("of_id"), F.col("source").alias("of_source"), F.col("text_hash").alias("of_hash")).agg(F.first("gone").alias("gone"))
    text = F.coalesce(F.col(f"`{text_column}`"), F.lit(""))
    keyed = documents.select(F.struct(*(F.col(f"`{c}`") for c in columns)).alias("row"), F.col(f"`{id_column}`").alias("id"), F.coalesce(F.col(f"`{host_column}`"), F.lit("")).alias("source"), F.xxhash64(text).alias("text_hash"))
    same = F.col("id").eqNullSafe(F.col("of_id")) & (F.col("source") == F.col("of_source")) & (F.col("text_hash") == F.col("of_hash"))
    joined = keyed.join(told, same)
    lines = F.split(F.col("row")[text_column], "\n")
    rest = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), F.col("gone"))
    text = F.when(F.col("gone").isNull(), F.col("row")[text_column]).otherwise(F.array_join(F.transform(rest, lambda i: F.get(lines, i)), "\n"))
    changed = joined.select("row", text.alias("new_text"))
    value = lambda c: (
        F.col("new_text") if c == text_column else F.length("new_text").cast("bigint") if c == size_column else F.col("row")[c]
    )
    return changed.select(*(value(c).alias(c) for c in columns))
