"""Near-duplicate documents by HyperMinHash sketches, and links confirmed on full shingle sets.

1. Each text becomes the set of its hashed word shingles and a sketch: shingles are dealt to buckets, and a
   bucket's register keeps, of its least hash, the count of leading zeros and the mantissa bits behind
   them (16 bits). Texts with equal sets form a class; only one of a class goes on.
2. Bands of four registers are keys. The number of bands makes the chance to miss a pair at the
   threshold less than `MISS`. A class's score is the number of rows that it shares band keys with; the hub of a
   bucket is its member of the highest score, and each class is compared with the best hub of its buckets.
   Linked ones get the least label that links reach.
3. What stays open are buckets whose members have several labels. All members but those of a bucket's
   most frequent label are queries, in blocks, against the members with other labels: first by sketch alone
   (size bound and collision-corrected similarity estimate), then, for those that have a partner left, on full sets.

A comparison is left out where links already connect both sides, so a block emits a spanning forest of its
links, never all of them. Hubs and query sets meet their partners in salted blocks of bounded weight.

Sets are of 64-bit hashes; two different shingles of two documents are taken as equal with a chance of 2**-64.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, pick

#: Words of a shingle; registers of a band; chance to miss a pair at the threshold.
SHINGLE, ROWS, MISS = 5, 4, 1e-7
#: Queries of a block: how many, and how many shingles they have, about.
CHUNK, WEIGHT = 400, 400_000
#: Queries of a block while only sketches are compared, and members of a hub's block.
SKETCH_CHUNK, SALT = 2000, 2000
MANTISSA_BITS = 10
#: Edges that one task joins without effort.
FEW_EDGES = 300_000
#: Standard errors that an estimate may lie below the threshold.
SLACK = 6.0

BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
CODES = np.random.default_rng(20240229).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
PLACES = np.random.default_rng(20240301).integers(1, 1 << 63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
IS_SPACE = np.zeros(256, bool)
IS_SPACE[[32, *range(9, 14)]] = True


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads all bits."""
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(32))


def word_hashes(text: bytes) -> np.ndarray:
    """A hash of each word of a UTF-8 text, A-Z lower-cased: a polynomial over random byte codes, mixed."""
    raw = LOWER[np.frombuffer(text, np.uint8)]
    inside = ~IS_SPACE[raw]
    starts = np.flatnonzero(inside & ~np.concatenate([[False], inside[:-1]]))
    if not len(starts):
        return np.zeros(0, np.uint64)
    place = np.arange(len(raw), dtype=np.int64)
    place[: starts[0]] = 0
    place[starts[0] :] -= np.repeat(starts, np.diff(np.append(starts, len(raw))))
    powers = np.cumprod(np.full(int(place.max()) + 1, BASE, np.uint64))
    return mix(np.add.reduceat(np.where(inside, CODES[raw] * powers[place], np.uint64(0)), starts))


def shingle_set(text: str | None, width: int = SHINGLE) -> np.ndarray:
    """The sorted distinct hashes of a text's shingles; with fewer words, the whole sequence as one; empty without words."""
    words = word_hashes((text or "").encode("utf-8", "surrogatepass"))
    if not len(words):
        return words
    size = min(width, len(words))
    total = sum(words[k : len(words) - size + 1 + k] * PLACES[k] for k in range(size))
    return np.unique(mix(total + np.uint64(size)))


def registers(shingles: np.ndarray, count: int) -> np.ndarray:
    """The sketch: for each bucket 16 bits, zeros + 1 in the upper six and the mantissa in the lower ten; 0 if empty."""
    least = np.full(count, np.iinfo(np.uint64).max, np.uint64)
    value = mix(shingles ^ np.uint64(0xA5A5A5A5A5A5A5A5))
    np.minimum.at(least, (shingles % np.uint64(count)).astype(np.int64), value)
    filled = least != np.iinfo(np.uint64).max
    bits = np.zeros(count, np.uint64)  # position of the leading one
    rest = least.copy()
    for step in (32, 16, 8, 4, 2, 1):
        high = rest >> np.uint64(step) > 0
        bits[high] += np.uint64(step)
        rest[high] >>= np.uint64(step)
    zeros = np.minimum(np.uint64(63) - bits, np.uint64(61))
    shift = np.where(bits >= MANTISSA_BITS, bits - np.minimum(bits, np.uint64(MANTISSA_BITS)), np.uint64(0))
    mantissa = (least >> shift) & np.uint64((1 << MANTISSA_BITS) - 1)
    return np.where(filled, (zeros + np.uint64(1)) << np.uint64(MANTISSA_BITS) | mantissa, np.uint64(0)).astype(np.uint16)


def band_count(threshold: float) -> int:
    return math.ceil(math.log(MISS) / math.log(1 - threshold**ROWS))


def plausible(sketch: np.ndarray, others: np.ndarray, threshold: float) -> np.ndarray:
    """Whether the estimates of one sketch against the rows of others allow for the threshold, with `SLACK` standard
    errors; too few buckets always do."""
    told, k = estimate(sketch, others)
    return (k < 40) | (told >= threshold - SLACK * np.sqrt(threshold * (1 - threshold) / np.maximum(k, 1)))


def estimate(sketch: np.ndarray, others: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Similarities of a sketch to others, corrected for registers that agree by chance, and the buckets they rest on.

    Two unlike minima have the same leading zeros with a chance of 1/3 and the same mantissa with one of 2**-10.
    """
    k = ((others > 0) | (sketch > 0)).sum(axis=-1)
    chance = 2.0**-MANTISSA_BITS / 3
    agree = ((others == sketch) & (sketch > 0)).sum(axis=-1) / np.maximum(k, 1)
    return np.maximum(0.0, (agree - chance) / (1 - chance)), k


def linked(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    """100 * intersection >= percent * union, on full sets."""
    if not len(a) or not len(b) or 100 * min(len(a), len(b)) < percent * max(len(a), len(b)):
        return False
    both = len(np.intersect1d(a, b, assume_unique=True))
    return 100 * both >= percent * (len(a) + len(b) - both)


def sketch_documents(width: int, count: int):
    """For mapInArrow: (id, mark, text) to (id, mark, n, digest_a, digest_b, sketch), the sketch as one long for each band."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low in range(0, batch.num_rows, 500):
                part = batch.slice(low, 500)
                n, digests, sketches = [], [], []
                for text in part.column(2):
                    s = shingle_set(text.as_py(), width)
                    n.append(len(s))
                    digests.append([int(mix(s ^ np.uint64(salt)).sum(dtype=np.uint64).astype(np.int64)) for salt in (1, 2)])
                    sketches.append(registers(s, count).view("<i8"))
                flat, bands = np.concatenate(sketches), count // ROWS
                sketch = pa.ListArray.from_arrays(pa.array(np.arange(0, len(flat) + 1, bands, dtype=np.int32)), pa.array(flat))
                a, b = zip(*digests)
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(1), pa.array(n, pa.int64()), pa.array(a, pa.int64()), pa.array(b, pa.int64()), sketch], ["id", "mark", "n", "digest_a", "digest_b", "sketch"]
                )

    return run


class Labels(dict):
    """Labels that links join, with a root for each set."""

    def root(self, x: int) -> int:
        while (up := self.get(x, x)) != x:
            self[x] = x = self.get(up, up)
        return x


def blocks_of(batches: Iterator[pa.RecordBatch], columns: int):
    """Rows of sorted batches by block, which the first three columns name. Texts leave their batch one by one."""
    rows = (r for b in batches for r in zip(*(b.column(i).to_pylist() if i < 7 else b.column(i) for i in range(columns))))
    return groupby(rows, key=lambda r: r[:3])


def sketch_rows(sketches: list[list[int]]) -> np.ndarray:
    return np.array(sketches, "<i8").view("<u2")


def open_queries(member: np.ndarray, n: int, sizes: np.ndarray, sketches: np.ndarray, band: int | None, percent: int) -> np.ndarray:
    """The queries that a member may link to: by size, by estimate, and with this band the first that both share."""
    fits = 100 * np.minimum(n, sizes) >= percent * np.maximum(n, sizes)
    if band:
        mine, theirs = member.view("<i8")[:band], sketches.view("<i8")[:, :band]
        fits &= ~((theirs == mine) & (mine != 0)).any(axis=1)
    at = np.flatnonzero(fits)
    return at[plausible(member, sketches[at], percent / 100)] if len(at) else at


def plausible_members(percent: int):
    """For mapInArrow over rows (band, key, chunk, queries first, id, label, sketch, n) sorted by these: rows (band, key, id, label, asks)
    of the queries and members that may link to a row of another label."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = (r for b in batches for r in zip(*(b.column(i).to_pylist() for i in range(8))))
        for (band, key, _), members in groupby(rows, key=lambda r: r[:3]):
            queries, found, asked = [], [], np.zeros(0, bool)
            sizes = labels = sketches = None
            for _, _, _, member, of, label, sketch, n in members:
                if not member:
                    queries.append((of, label, sketch, n))
                    continue
                if sizes is None:
                    sizes, labels, sketches = np.array([q[3] for q in queries]), np.array([q[1] for q in queries]), sketch_rows([q[2] for q in queries])
                    asked = np.zeros(len(queries), bool)
                other = np.flatnonzero(labels != label)
                other = other[open_queries(sketch_rows([sketch])[0], n, sizes[other], sketches[other], band, percent)] if len(other) else other
                if len(other):
                    asked[other] = True
                    found.append((of, label, False))
            found += [(queries[q][0], queries[q][1], True) for q in np.flatnonzero(asked).tolist()]
            of, label, asks = zip(*found) if found else ((), (), ())
            yield pa.RecordBatch.from_arrays(
                [pa.array([band] * len(of), pa.int32()), pa.array([key] * len(of), pa.int64()), pa.array(of, pa.int64()), pa.array(label, pa.int64()), pa.array(asks, pa.bool_())], ["band", "key", "id", "label", "asks"]
            )

    return run


def compare_blocks(percent: int, width: int, by_band: bool):
    """For mapInArrow over rows (band, key, chunk, member, id, label, sketch, text) sorted by these, a block's queries
    before its members: links (a, b) confirmed on full sets, a spanning forest of a block's labels."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (band, _, _), members in blocks_of(batches, 8):
            queries, found, joined, sizes = [], [], Labels(), None
            for _, _, _, member, of, label, sketch, text in members:
                if not member:
                    queries.append((of, label, shingle_set(text.as_py(), width), sketch))
                    continue
                if sizes is None:
                    sizes, sketches = np.array([len(q[2]) for q in queries]), sketch_rows([q[3] for q in queries])
                    roots = np.array([q[1] for q in queries])
                others = np.flatnonzero(roots != joined.root(label))
                if not len(others):
                    continue
                mine = shingle_set(text.as_py(), width)
                for q in others[open_queries(sketch_rows([sketch])[0], len(mine), sizes[others], sketches[others], band if by_band else None, percent)].tolist():
                    left, right = joined.root(queries[q][1]), joined.root(label)
                    if left != right and linked(queries[q][2], mine, percent):
                        joined[left] = right
                        roots[roots == left] = right
                        found.append((queries[q][0], of))
            a, b = zip(*found) if found else ((), ())
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    return run


def join_nodes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For mapInArrow over all of a few edges (a, b) in one task: (node, component) by union and find."""
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        parent.setdefault(x, x)
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for batch in batches:
        for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            low, high = sorted((root(a), root(b)))
            parent[high] = low
    yield pa.RecordBatch.from_arrays([pa.array(list(parent), pa.int64()), pa.array([root(x) for x in parent], pa.int64())], ["node", "component"])


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, component): the least node that the edges (a, b) of longs connect each node with.

    The edges are a table whose lineage is cut. Each round passes least labels along edges and then jumps to the label's own
    label; lineage is cut each round. A node with very many edges only meets partial minima and joins that Spark can split.
    Up to `FEW_EDGES` edges are joined in one task.
    """
    edges = edges.where("a <> b").select("a", "b")
    if edges.count() <= FEW_EDGES:
        return cut(edges.coalesce(1).mapInArrow(join_nodes, "node bigint, component bigint"))
    ways = F.explode(F.array(F.struct(F.col("a").alias("a"), F.col("b").alias("b")), F.struct(F.col("b").alias("a"), F.col("a").alias("b"))))
    both = cut(edges.select(ways.alias("e")).select("e.a", "e.b").distinct())
    labels = cut(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("low")).select("node", F.least("node", "low").alias("component")))
    while True:
        heard = both.join(labels, both["b"] == labels["node"]).groupBy("a").agg(F.min("component").alias("low"))
        near = labels.join(heard, labels["node"] == heard["a"], "left").select("node", F.least("component", F.coalesce("low", "component")).alias("near"), "component")
        jump = labels.select(F.col("node").alias("of"), F.col("component").alias("far"))
        step = near.join(jump, near["near"] == jump["of"], "left").select("node", F.least("near", F.coalesce("far", "near")).alias("component"), F.col("component").alias("old"))
        step = cut(step)
        labels = step.select("node", "component")
        if step.where("component <> old").isEmpty():
            return labels


def hub_pairs(grouped: DataFrame) -> DataFrame:
    """(id, hub): for each id in rows (band, key, c, id) of shared buckets the hub it is compared with, if it isn't one itself."""
    scores = grouped.groupBy("id").agg(F.sum("c").alias("score"))
    scored = cut(grouped.join(scores, "id").select("band", "key", "id", "score"))
    hubs = scored.groupBy("band", "key").agg(F.max(F.struct("score", (-F.col("id")).alias("id"))).alias("hub"))
    best = scored.join(hubs, ["band", "key"]).groupBy("id").agg(F.max("hub").alias("hub"))
    return best.select("id", (-F.col("hub.id")).alias("hub")).where("id <> hub")


def in_blocks(queries: DataFrame, members: DataFrame, kinds: list[str]) -> DataFrame:
    """Queries and members (band, key, chunk, .. kinds) sorted into their blocks, queries first."""
    columns = ["band", "key", "chunk", "member", "id", "label", "sketch", *kinds]
    both = queries.withColumn("member", F.lit(False)).select(columns).union(members.withColumn("member", F.lit(True)).select(columns))
    return both.repartition("band", "key", "chunk").sortWithinPartitions("band", "key", "chunk", "member")


def hub_links(pairs: DataFrame, texts: DataFrame, percent: int, width: int) -> DataFrame:
    """Links (a, b) of ids with their hubs. A hub with many ids has several blocks."""
    salts = pairs.groupBy("hub").agg(F.ceil(F.count("*") / SALT).cast("int").alias("salts"))
    block = [F.lit(0).alias("band"), F.col("hub").alias("key"), "chunk", "id", F.col("id").alias("label"), "sketch", "text"]
    queries = salts.join(texts, salts["hub"] == texts["id"]).withColumn("chunk", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)))
    members = pairs.join(salts, "hub").join(texts, "id").withColumn("chunk", F.pmod(F.xxhash64("id"), "salts").cast("int"))
    return in_blocks(queries.select(block), members.select(block), ["text"]).mapInArrow(compare_blocks(percent, width, False), "a bigint, b bigint")


def chunked(rows: DataFrame, count: int, weight: int) -> tuple[DataFrame, DataFrame]:
    """Queries and members, from rows (band, key, id, n, asks): each query in one of its bucket's blocks, each row as a member in all."""
    asking = rows.where("asks")
    sizes = F.greatest(F.ceil(F.count("*") / count), F.ceil(F.sum("n") / weight)).cast("int")
    chunks = asking.groupBy("band", "key").agg(sizes.alias("chunks"))
    queries = asking.join(chunks, ["band", "key"]).withColumn("chunk", F.pmod(F.xxhash64("id"), "chunks").cast("int"))
    return queries, rows.join(chunks, ["band", "key"]).withColumn("chunk", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))


def open_links(grouped: DataFrame, nodes: DataFrame, labels: DataFrame, texts: DataFrame, percent: int, width: int) -> DataFrame:
    """Links (a, b) between rows of one bucket that have different labels. nodes: id, n, sketch."""
    told = grouped.select("band", "key", "id").join(labels, "id", "left").select("band", "key", "id", F.coalesce("component", "id").alias("label"))
    told = cut(told)
    counts = told.groupBy("band", "key", "label").agg(F.count("*").alias("c"))
    main = counts.groupBy("band", "key").agg(F.max(F.struct("c", "label"))["label"].alias("main"), F.count("*").alias("labels")).where("labels > 1").drop("labels")
    open_rows = told.join(main, ["band", "key"]).join(nodes, "id").select("band", "key", "id", "label", "n", "sketch", (F.col("label") != F.col("main")).alias("asks"))
    queries, members = chunked(cut(open_rows), SKETCH_CHUNK, 1 << 40)
    flagged = in_blocks(queries, members, ["n"]).mapInArrow(plausible_members(percent), "band int, key bigint, id bigint, label bigint, asks boolean")
    flagged = flagged.groupBy("band", "key", "id", "label").agg(F.max("asks").alias("asks"))
    queries, members = chunked(cut(flagged.join(nodes, "id")), CHUNK, WEIGHT)
    text = texts.select("id", "text")
    return in_blocks(queries.join(text, "id"), members.join(text, "id"), ["text"]).mapInArrow(compare_blocks(percent, width, True), "a bigint, b bigint")


def components(documents: DataFrame, percent: int = 80, width: int = SHINGLE, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(id, n_shingles, component_id, kept) for each row.

    Documents are linked if 100 * intersection >= percent * union of their shingle sets; `component_id` is the
    least id reachable, `kept` tells whether it is the row's own. Null, empty and blank texts have no
    shingles and no links. A row with a null id links to nothing: its component is null and it is kept.
    Rows with the same id are one document: its links are those of all of them. Very long texts are sets like
    others, read one at a time. An empty table gives an empty result. Further columns are dropped.
    """
    bands = band_count(percent / 100)
    rows = pick(documents, id=id_column, text=text_column).select(F.col("id").cast("bigint").alias("id"), F.xxhash64("text").alias("mark"), "text")
    kinds = "id bigint, mark bigint, n bigint, digest_a bigint, digest_b bigint, sketch array<bigint>"
    sketched = cut(rows.mapInArrow(sketch_documents(width, bands * ROWS), kinds))
    own = ["digest_a", "digest_b", "n"]
    real = sketched.where("n > 0 and id is not null")
    classes = cut(real.groupBy(*own).agg(F.min(F.struct("id", "mark")).alias("of"), F.min("sketch").alias("sketch")).select(*own, F.col("of.id").alias("id"), F.col("of.mark").alias("mark"), "sketch"))
    keys = classes.select("id", F.posexplode("sketch").alias("band", "key")).where("key <> 0")
    buckets = keys.groupBy("band", "key").agg(F.count("*").alias("c")).where("c > 1")
    grouped = cut(keys.join(buckets, ["band", "key"]))
    nodes = classes.select("id", "mark", "n", "sketch").join(grouped.select("id").distinct(), "id")
    # A class's id may have further rows with other texts, and all its rows may be there twice.
    texts = cut(rows.join(nodes, ["id", "mark"]).dropDuplicates(["id", "mark"]).select("id", "n", "sketch", "text"))
    star = cut(hub_links(cut(hub_pairs(grouped)), texts, percent, width))
    labels = connected_components(star).withColumnRenamed("node", "id")
    links = star.union(open_links(grouped, texts.select("id", "n", "sketch"), labels, texts, percent, width))
    # Rows of one id connect their classes.
    several = real.groupBy("id").agg(F.min(F.struct(*own)).alias("x"), F.max(F.struct(*own)).alias("y")).where("x <> y").select("id")
    membership = real.join(several, "id", "left_semi").select("id", *own).join(classes.select(*own, F.col("id").alias("b")), own)
    links = links.union(membership.select(F.col("id").alias("a"), "b"))
    found = connected_components(cut(links.where("a <> b"))).withColumnsRenamed({"node": "rep", "component": "least"})
    labels = classes.select(*own, "id").join(found, F.col("id") == F.col("rep"), "left").select(*own, F.coalesce("least", "id").alias("least"))
    told = sketched.select("id", *own).join(labels, own, "left")
    component = F.when(F.col("id").isNotNull(), F.when(F.col("n") > 0, F.col("least")).otherwise(F.col("id")))
    return told.select(F.col("id").alias(id_column), F.col("n").alias("n_shingles"), component.alias("component_id"), F.coalesce(component == F.col("id"), F.lit(True)).alias("kept"))


def keep_one(documents: DataFrame, percent: int = 80, width: int = SHINGLE, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """The documents without near-duplicates: of each component the one with the least id. Columns stay as they are.

    Rows that share the kept id all stay, and so do rows with a null id.
    """
    gone = components(documents, percent, width, id_column, text_column).where("not kept").select(F.col(id_column).alias("gone_id")).distinct()
    return documents.join(gone, documents[id_column] == gone["gone_id"], "left_anti")
