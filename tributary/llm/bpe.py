"""Byte-level BPE encoding and decoding.

Encoding has three narrow steps, without a shuffle, so that a lost executor costs its tasks only:

1. texts are cut into blocks, each split by the tokenizer's pattern into its distinct words (Arrow);
2. higher-order functions fold ranked merges over each distinct word: starting from the ids of its bytes, the
   fold merges the leftmost pair of least rank until no pair has one. A word is a byte array that holds each id in as
   many bytes as ids need. Ranks come from a literal rank map, a byte array too, addressed by a hash of the pair;
3. word ids are put together again for each document (Arrow).

Folding is what costs, so words of a bounded sample of rows are folded once beforehand and broadcast with their
ids; tasks fold the words that they don't find there. The sample is a cache of bounded size and changes no result.

Decoding is native: it looks up each id's bytes in a literal array and concatenates the pieces.

The rank map is a cuckoo table of the mergeable pairs (two slots for each), so that a lookup costs one hash and
at most two comparisons; Spark's own map type would search it linearly. As one byte array of 1.5 MB it stays in a
core's cache, which makes the fold twice as fast as arrays of strings do.
"""

from __future__ import annotations

import base64
import functools
import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import let, pick
from .splitting import splitter

#: Texts are taken in blocks of about so many characters; a longer text is a block of its own.
BLOCK_CHARS = 2_000_000
#: Distinct words that a task remembers before it starts anew.
MAX_WORDS = 1_000_000
#: Rows whose words are folded beforehand, and code points looked at in each; longer words are rare and not among them.
SAMPLE_ROWS, SAMPLE_CHARS, KNOWN_CHARS = 8192, 4096, 64
class Ranks:
    """Mergeable ranks: bytes of each token to its id, and the tables that the plan carries."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.ranks, self.pattern = ranks, pattern

    @classmethod
    def read(cls, path: str, pattern: str) -> Ranks:
        """From a rank file: base64 bytes and rank in each line."""
        with open(path, "rb") as lines:
            return cls({base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}, pattern)

    @functools.cached_property
    def width(self) -> int:
        """Bytes of an id: the one of all bits set stands for none."""
        return ((max(self.ranks.values()) + 1).bit_length() + 7) // 8

    def packed(self, *ids: int) -> bytes:
        """Ids as big-endian numbers, so that their order as bytes is theirs as ids."""
        return b"".join(i.to_bytes(self.width, "big") for i in ids)

    def pairs(self) -> dict[bytes, int]:
        """Each mergeable pair of ids with the id that it makes."""
        found = {}
        for token, rank in self.ranks.items():
            for cut in range(1, len(token)):
                left, right = self.ranks.get(token[:cut]), self.ranks.get(token[cut:])
                if left is not None and right is not None:
                    found[self.packed(left, right)] = rank
        return found

    @functools.cached_property
    def table(self) -> tuple[int, bytes]:
        """The pairs in a cuckoo table: how many slots it has, a power of two, and for each its pair and the id that this makes."""
        pairs = self.pairs()
        size = 1 << max(4, (len(pairs) * 9 // 4).bit_length() - 1)
        while (table := place(pairs, size)) is None:
            size *= 2
        return size, b"".join(p + self.packed(r) if p else b"\xff" * 3 * self.width for p, r in table)


def unpacked(data: bytes, width: int) -> np.ndarray:
    """Packed ids as numbers."""
    digits = np.frombuffer(data, np.uint8).reshape(-1, width).astype(np.int32)
    return sum(digits[:, k] << 8 * (width - 1 - k) for k in range(width))


def slots(pair: bytes, size: int) -> tuple[int, int]:
    """The two slots of a pair, from Spark's xxhash64 of it."""
    h = xxhash.xxh64_intdigest(pair, 42)
    return h & (size - 1), h >> 32 & (size - 1)


def place(pairs: dict[bytes, int], size: int) -> list[tuple[bytes, int]] | None:
    table = [(b"", 0)] * size
    for item in pairs.items():
        at = slots(item[0], size)[0]
        for _ in range(500):
            item, table[at] = table[at], item
            if not item[0]:
                break
            first, second = slots(item[0], size)
            at = second if at == first else first
        else:
            return None
    return table


def fold_merges(word: Column, table: Column, size: int, width: int) -> Column:
    """A word of packed ids with ranked merges folded in, given the packed ids of its bytes.

    Each step looks up all adjacent pairs and merges the leftmost of least rank; a rank is the new id.
    """
    one = F.lit(width)

    def rank(pair: Column, h: Column) -> Column:
        def at(slot: Column) -> tuple[Column, Column]:
            start = slot.bitwiseAND(F.lit(size - 1)).cast("int") * (3 * width) + 1
            return F.startswith(F.substring(table, start, F.lit(3 * width)), pair), F.substring(table, start + 2 * width, one)

        return F.when(*at(h)).when(*at(F.shiftrightunsigned(h, 32)))

    def step(state: Column, _: Column) -> Column:
        def merge(found: Column) -> Column:
            # k: bytes before the pair, and those of its first id
            made = lambda least, k: F.concat(F.substring(state, F.lit(1), k - width), least, F.substring(state, k + width + 1, F.length(state)))
            put = lambda least: F.when(least.isNull(), state).otherwise(let(F.array_position(found, least).cast("int") * width, lambda k: made(least, k)))
            return let(F.array_min(found), put)

        starts = F.sequence(F.lit(1), F.greatest(F.length(state) - width - 1, F.lit(1)), one)
        pairs = F.transform(starts, lambda i: F.substring(state, i, F.lit(2 * width)))
        return let(let(pairs, lambda p: F.zip_with(p, F.transform(p, lambda x: F.xxhash64(x)), rank)), merge)

    return F.when(F.length(word) <= width, word).otherwise(F.aggregate(F.sequence(one, F.length(word) - width, one), word, step))


class Numbers(dict):
    """Numbers keys in the order in which they are first asked for."""

    def __missing__(self, key):
        self[key] = number = len(self)
        return number


def byte_ids(ranks: dict[bytes, int], width: int):
    """A function that gives the packed ids which a word's bytes start with: one id for each, or its own if it is a token."""
    packed = {token: rank.to_bytes(width, "big") for token, rank in ranks.items()}
    single = [packed[bytes([b])] for b in range(256)]
    return lambda raw: packed.get(raw) or b"".join(map(single.__getitem__, raw))


def folded(words: Column, ranks: Ranks) -> Column:
    """An array of words, as packed ids of their bytes, with all merges folded in."""
    size, table = ranks.table
    return let(F.lit(table), lambda t: F.transform(words, lambda w: fold_merges(w, t, size, ranks.width)))


def known_words(rows: DataFrame, ranks: Ranks, count: int) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Words of the first rows of (key, text), their ids one after another, and how many ids each has."""
    find, start = splitter(ranks.pattern), byte_ids(ranks.ranks, ranks.width)
    found: dict[str, None] = {}
    for row in rows.select(F.substring("text", 1, SAMPLE_CHARS).alias("text")).take(count):
        found |= dict.fromkeys(find(row["text"] or ""))
    words = [w for w in found if len(w) <= KNOWN_CHARS and w.encode() not in ranks.ranks]
    if not words:
        return [], np.zeros(0, np.int32), np.zeros(0, np.int64)
    parts = [(k, [start(w.encode()) for w in words[k : k + 10_000]]) for k in range(0, len(words), 10_000)]
    told = rows.sparkSession.createDataFrame(parts, "at int, words array<binary>").repartition(len(parts))
    done = [w for _, part in sorted(told.select("at", folded(F.col("words"), ranks).alias("words")).collect()) for w in part]
    return words, unpacked(b"".join(done), ranks.width), np.array([len(w) // ranks.width for w in done], np.int64)


def split_blocks(ranks: dict[bytes, int], pattern: str, width: int, block_chars: int, known: Broadcast):
    """For mapInArrow: (key, text) to one row for each block: keys, words per text, word numbers (32-bit integers), first number, byte ids of words.

    Only words that are neither known nor in an earlier block of the task are given, so that each is folded once for a
    task; numbers go on from those of the known words and from block to block until `MAX_WORDS`, then start anew. A
    word that is a token itself starts, and so ends, as that one id.
    """

    def blocks(rows: Iterator[tuple[int, str]]) -> Iterator[tuple[list, list]]:
        keys, texts, chars = [], [], 0
        for key, text in rows:
            if keys and chars + len(text) > block_chars:
                yield keys, texts
                keys, texts, chars = [], [], 0
            keys.append(key)
            texts.append(text)
            chars += len(text)
        if keys:
            yield keys, texts

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find, start, number = splitter(pattern), byte_ids(ranks, width), Numbers()
        first_new = len(known.value)
        number.update(zip(known.value, range(first_new)))
        # Texts leave their Arrow batch one by one: a batch's strings all at once would be as large as the batch again.
        rows = ((k.as_py(), t.as_py() or "") for batch in batches for k, t in zip(batch.column(0), batch.column(1)))
        for keys, texts in blocks(rows):
            if len(number) > MAX_WORDS + first_new:
                number.clear()
                number.update(zip(known.value, range(first_new)))
            before, counts, numbers = len(number), [], []
            for text in texts:
                words = find(text)
                counts.append(len(words))
                numbers.append(np.fromiter(map(number.__getitem__, words), np.int32, len(words)))
            words = [start(word.encode()) for word in itertools.islice(number, before, None)]
            one = lambda values, kind: pa.array([values], pa.list_(kind))
            yield pa.RecordBatch.from_arrays(
                [
                    one(keys, pa.int64()),
                    one(counts, pa.int32()),
                    pa.array([np.concatenate(numbers).tobytes()], pa.binary()),
                    pa.array([before], pa.int32()),
                    one(words, pa.binary()),
                ],
                ["keys", "counts", "numbers", "first", "words"],
            )

    return run


def join_blocks(width: int, known: Broadcast):
    """For mapInArrow: blocks with the ids of their new words, to (key, ids) rows of the texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, lengths = known.value
        for batch in batches:
            for r in range(batch.num_rows):
                keys, counts, words = (batch.column(i)[r].values for i in (0, 1, 4))
                numbers, first = np.frombuffer(batch.column(2)[r].as_buffer(), np.int32), batch.column(3)[r].as_py()
                lengths = np.concatenate([lengths[:first], pc.binary_length(words).to_numpy(zero_copy_only=False).astype(np.int64) // width])
                ids = np.concatenate([ids[: lengths[:first].sum()], unpacked(b"".join(words.to_pylist()), width)])
                starts = np.cumsum(lengths) - lengths
                ends = np.cumsum(counts.to_numpy())
                for low in range(0, len(ends), 64):  # a few texts at a time bound the memory
                    high = min(len(ends), low + 64)
                    begin = ends[low - 1] if low else 0
                    part = numbers[begin : ends[high - 1]]
                    n = lengths[part]
                    at = np.concatenate([[0], np.cumsum(n)])
                    flat = ids[np.repeat(starts[part] - at[:-1], n) + np.arange(at[-1])]
                    cuts = at[np.concatenate([[0], ends[low:high] - begin])].astype(np.int32)
                    yield pa.RecordBatch.from_arrays([keys[low:high], pa.ListArray.from_arrays(pa.array(cuts), pa.array(flat, pa.int32()))], ["key", "ids"])

    return run


def encode(documents: DataFrame, ranks: Ranks, id_column: str = "doc_id", text_column: str = "text", block_chars: int = BLOCK_CHARS, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """(id, ids): token ids of each text, each match of the pattern on its own, without special tokens.

    Null texts count as empty and give an empty array; null ids, ties and repeated rows are kept row by row;
    very long texts become blocks of their own; an empty table gives an empty result; further columns are dropped.
    `sample_rows`: rows whose words are folded beforehand, 0 for none; it changes no result.
    """
    rows = pick(documents, key=id_column, text=text_column).select(F.col("key").cast("bigint"), "text")
    words, ids, lengths = known_words(rows, ranks, sample_rows)
    known, known_ids = map(documents.sparkSession.sparkContext.broadcast, (words, (ids, lengths)))
    kinds = "keys array<bigint>, counts array<int>, numbers binary, first int, words array<binary>"
    blocks = rows.mapInArrow(split_blocks(ranks.ranks, ranks.pattern, ranks.width, block_chars, known), kinds)
    joined = blocks.select("keys", "counts", "numbers", "first", folded(F.col("words"), ranks).alias("words")).mapInArrow(join_blocks(ranks.width, known_ids), "key bigint, ids array<int>")
    return joined.select(F.col("key").alias(id_column), "ids")


def decode(ids: Column, ranks: Ranks) -> Column:
    """The bytes of an id array: the concatenated pieces. Unknown ids and nulls give no bytes."""
    pieces = [""] * (max(ranks.ranks.values()) + 1)
    for token, rank in ranks.ranks.items():
        pieces[rank] = token.hex()
    known = F.split(F.lit(",".join(pieces)), ",")
    return F.unhex(F.array_join(let(known, lambda p: F.transform(ids, lambda i: F.get(p, i))), ""))

