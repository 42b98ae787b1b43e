"""Document fingerprints: a canonical exact digest (native: DataFrame and SQL functions only).

A text's canonical form is its NFKC normalisation, case-folded and normalised again, with runs of white
space folded into one blank and trimmed; ICU, which Spark ships for its collations, does the Unicode work through the SQL
function `reflect`. The canonical form is hashed by xxhash to 128 bits. Texts with equal hashes form a
bucket, and inside a bucket bytes are compared: only where they differ (never seen) do members get
different ordinals. So fingerprints are equal exactly if canonical forms are.

The byte comparison is the smallest against the largest member, both aggregated with map-side combine,
so that a bucket with a third of all rows ends as one pair for each task. Only members of buckets
with two rows or more take part.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import hex_hash, let, pick, wide_hash

NORMALIZER, FOLDER = "com.ibm.icu.text.Normalizer", "com.ibm.icu.lang.UCharacter"
#: Rows of the id blocks in which neighbours are looked up, about, and how many blocks make a larger one as a power of two.
BLOCK_ROWS, FAN_BITS = 256, 10
#: Pieces of the ids' distribution by which blocks are cut.
PIECES = 32
#: The block of null ids: below all others.
NULL_BLOCK = -(1 << 62)


def canonical(text: Column) -> Column:
    """The canonical form of a text; null counts as empty. Pure ASCII takes a short cut with the same result."""
    text = F.coalesce(text, F.lit(""))
    compose = lambda x: F.reflect(F.lit(NORMALIZER), F.lit("compose"), x, F.lit(True))
    folded = compose(F.reflect(F.lit(FOLDER), F.lit("foldCase"), compose(text), F.lit(True)))
    ascii_only = F.length(text) == F.octet_length(text)
    plain = F.when(ascii_only, F.lower(text)).otherwise(folded)
    return F.regexp_replace(F.regexp_replace(plain, r"[\p{IsWhite_Space}\x1C-\x1F]+", " "), r"^ | $", "")


def bucket_ordinals(texts: DataFrame) -> DataFrame:
    """(hash, canonical_form, ordinal) for the buckets of (hash, canonical_form) whose members differ in bytes.

    Ordinals count from 1 in byte order. Normally empty: it takes a 128-bit collision.
    """
    ends = texts.groupBy("hash").agg(F.min("canonical_form").alias("least"), F.max("canonical_form").alias("most"))
    mixed = ends.where("least <> most").select("hash")
    members = texts.join(mixed, "hash", "left_semi").distinct()
    return members.withColumn("ordinal", F.row_number().over(Window.partitionBy("hash").orderBy("canonical_form")))


def named(hashed: Column, ordinal: Column) -> Column:
    """The fingerprint's text: 32 hex digits, and the ordinal where a bucket needs one."""
    return F.concat(hex_hash(hashed), F.coalesce(F.concat(F.lit("-"), ordinal.cast("string")), F.lit("")))


def fingerprint(documents: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(id, fingerprint) for each row. Null texts count as empty; ties, repeated rows and null ids are kept
    row by row; further columns of the input are dropped."""
    rows = pick(documents, id=id_column, text=text_column)
    hashed = rows.select("id", canonical(F.col("text")).alias("canonical_form")).withColumn("hash", wide_hash(F.col("canonical_form")))
    shared = hashed.groupBy("hash").agg(F.count("*").alias("n")).where("n > 1").select("hash")
    ordinals = bucket_ordinals(hashed.join(shared, "hash", "left_semi").select("hash", "canonical_form"))
    told = hashed.withColumn("digest", F.sha2("canonical_form", 256)).drop("canonical_form")
    told = told.join(ordinals.select("hash", F.sha2("canonical_form", 256).alias("digest"), "ordinal"), ["hash", "digest"], "left")
    return told.select(F.col("id").alias(id_column), named(F.col("hash"), F.col("ordinal")).alias("fingerprint"))


def likeness(left: Column, right: Column) -> Column:
    """1 for equal fingerprints, else 0: an exact digest knows no degrees."""
    return F.when(left == right, 1.0).otherwise(0.0)


def block_of(rows: DataFrame) -> Column:
    """The block of a row's id: ids in blocks of about `BLOCK_ROWS` rows each, in ascending order, however ids are spread.

    Approximate quantiles of the ids, one row of them, give a piecewise linear guess of an id's rank. It rises with the id,
    so blocks are in order whatever the quantiles are; these only make blocks even.
    """
    points = F.array(*(F.lit(k / PIECES) for k in range(PIECES + 1)))
    told = rows.select(F.col("id").cast("bigint").alias("id")).agg(F.percentile_approx("id", points, F.lit(10_000)).alias("q"), F.count("id").alias("n")).first()
    if not told["n"]:
        return F.lit(NULL_BLOCK)
    by_piece, last = told["n"] / PIECES / BLOCK_ROWS, len(told["q"])
    bounds = F.split(F.lit(",".join(repr(float(x)) for x in told["q"])), ",").cast("array<double>")  # a literal, once it is folded
    key = F.col("id").cast("double")

    def guess(table: Column, k: Column) -> Column:
        low, high = F.get(table, k - 1), F.get(table, k)
        return F.when(k == 0, 0.0).when(k == last, float(PIECES)).otherwise(k - 1 + (key - low) / (high - low)) * by_piece

    rank = let(bounds, lambda table: let(F.size(F.filter(table, lambda x: x <= key)), lambda k: guess(table, k)))
    return F.when(F.col("id").isNull(), F.lit(NULL_BLOCK)).otherwise(F.coalesce(F.floor(rank).cast("bigint"), F.lit(0)))


def with_next(rows: DataFrame) -> DataFrame:
    """(id, block, text, next_text): each row of (id, text) with the text of the next row in descending id order.

    After the last comes the first; rows with equal ids follow by text; null ids are last. Ids are cut into blocks
    of about 256 rows; neighbours inside a block come from a window over it, the head of the next block from windows
    over ever larger blocks, each of which holds at most 1024 heads. The last level has one row
    for each 2**28 rows.
    """
    # First rows are told by lag: a rank would get a limit of its own before a second exchange of the texts.
    leads = lambda over: F.lag(F.lit(1)).over(over).isNull()
    # Blocks are never null, so that no null filter makes the branches' scans differ: all share one exchange.
    order = [F.col("id").desc_nulls_last(), F.col("text")]
    within = Window.partitionBy("block").orderBy(*order)
    rows = rows.withColumn("block", block_of(rows))
    placed = rows.withColumn("next_text", F.lead("text").over(within)).withColumn("leads", leads(within))
    level = placed.where("leads").select("block", F.col("text").alias("head"))
    steps, names = [level], ["block"]
    for k in (1, 2):
        up = level.withColumn(f"up{k}", F.shiftright(names[-1], FAN_BITS))
        by = Window.partitionBy(f"up{k}").orderBy(F.col(names[-1]).desc())
        up = up.withColumn(f"after{k}", F.lead("head").over(by)).withColumn("leads", leads(by))
        steps.append(up.drop("leads", "head"))
        level = up.where("leads").select(f"up{k}", "head")
        names.append(f"up{k}")
    top = Window.orderBy(F.col("up2").desc())
    first = level.agg(F.max_by("head", "up2").alias("first"))
    ends = level.withColumn("after3", F.lead("head").over(top)).drop("head").crossJoin(F.broadcast(first))  # one row
    middle = steps[2].join(ends, "up2").select("up1", F.coalesce("after2", "after3", "first").alias("after_up1"))
    heads = steps[1].join(middle, "up1").select(F.col("block").alias("of_block"), F.coalesce("after1", "after_up1").alias("after"))
    joined = placed.join(heads.hint("merge"), F.col("block") == F.col("of_block"), "left")
    return joined.select("id", "block", "text", F.coalesce("next_text", "after").alias("next_text"))


def edited_texts(rows: DataFrame) -> DataFrame:
    """Adds `edited` to the rows of `with_next`: the last third of the code points gives way to the next text's first."""
    third = F.floor(F.length("text") / 3).cast("int")
    edited = F.concat(F.substring(F.col("text"), F.lit(1), F.length("text") - third), F.substring(F.col("next_text"), F.lit(1), third))
    return rows.withColumn("edited", edited)


def compare_edits(documents: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """For each document: id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next.

    See `with_next` for the order and for ties and nulls, `fingerprint` for the digest. One document alone is
    its own next. Texts are shuffled once, by id block; bucket members come out of the same shuffle.
    """
    rows = pick(documents, id=id_column, text=text_column).withColumn("text", F.coalesce("text", F.lit("")))
    both = edited_texts(with_next(rows))
    forms = both.select("id", "block", "text", "edited", F.array(canonical(F.col("text")), canonical(F.col("edited")), canonical(F.col("next_text"))).alias("forms"))
    form = lambda i: F.get("forms", F.lit(i))
    told = forms.select(
        "id",
        "block",
        F.length("text").cast("bigint").alias("n_chars"),
        F.sha2("edited", 256).alias("edited_sha256"),
        wide_hash(form(0)).alias("hash"),
        wide_hash(form(1)).alias("edited_hash"),
        F.sha2(form(0), 256).alias("digest"),
        F.sha2(form(1), 256).alias("edited_digest"),
        likeness(form(0), form(1)).alias("near_edited"),
        likeness(form(0), form(2)).alias("near_next"),
    )
    own = told.select("id", "block", F.posexplode(F.array("hash", "edited_hash")).alias("which", "hash"))
    shared = own.groupBy("hash").agg(F.count("*").alias("n")).where("n > 1").select("hash")
    members = own.join(shared, "hash", "left_semi").groupBy("id", "block").agg(F.collect_set("which").alias("which"))
    # The large side keeps its partitioning by block and needs no sort; ids are compared inside the block, since
    # a key of its own would deal the texts out anew.
    same = F.coalesce(F.col("id") - F.col("their_id") == 0, F.col("id").isNull() & F.col("their_id").isNull())
    by_block = lambda left, right: left.join(
        right.withColumnsRenamed({"id": "their_id", "block": "their_block"}).hint("shuffle_hash"), (F.col("block") == F.col("their_block")) & same, "left"
    ).drop("their_id", "their_block")
    chosen = by_block(both, members).where("which is not null")
    wanted = lambda i, c: F.when(F.array_contains("which", i), F.col(c))
    texts = chosen.select("id", "block", F.explode(F.array_compact(F.array(wanted(0, "text"), wanted(1, "edited")))).alias("text"))
    texts = texts.select("id", "block", canonical(F.col("text")).alias("canonical_form")).withColumn("hash", wide_hash(F.col("canonical_form")))
    ordinals = texts.join(bucket_ordinals(texts.select("hash", "canonical_form")), ["hash", "canonical_form"])
    entries = ordinals.groupBy("id", "block").agg(F.collect_set(F.struct("hash", F.sha2("canonical_form", 256).alias("digest"), "ordinal")).alias("entries"))
    found = by_block(told, entries)
    entry = lambda h, d: F.get(F.filter("entries", lambda e: (e["hash"] == F.col(h)) & (e["digest"] == F.col(d))), F.lit(0))["ordinal"]
    return found.select(
        F.col("id").alias(id_column),
        "n_chars",
        "edited_sha256",
        named(F.col("hash"), entry("hash", "digest")).alias("fingerprint"),
        named(F.col("edited_hash"), entry("edited_hash", "edited_digest")).alias("edited_fingerprint"),
        "near_edited",
        "near_next",
    )
