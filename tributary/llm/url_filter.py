"""URL filters by a Bloom filter cascade (native: DataFrame functions only).

A list of (host, path prefix) rules (each pair once) is compiled against the complete key universe of a corpus: every
(host suffix, path prefix) pair that occurs in its URLs. Level 1 is a Bloom filter of the listed keys,
level 2 one of the universe's keys that pass level 1 without being listed, level 3 one of the listed keys
that pass level 2, and so on until nothing passes wrongly. For keys of that universe the depth at which a
key first fails tells exactly whether it is listed, so URLs are judged in the scan, without a join.

Sizes: level 1's false-positive rate follows the ratio of listed to universe keys, so that each level
holds about as many keys as the list; the cascade has O(listed * log2(universe / listed)) bits. They travel inside
the plan: about three bytes for each rule of a list that the driver holds anyhow. Two scans make a cascade: one counts
the universe, one collects the keys that pass level 1 wrongly; deeper levels see these only.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, let, pick

@dataclass(frozen=True)
class Rule:
    """`action` (allow or block) for a host, its subdomains, and paths that start with `path`."""

    action: str
    host: str
    path: str

    @property
    def text(self) -> str:
        return self.host + self.path


@dataclass(frozen=True)
class Level:
    """One Bloom filter: `words` of 64 bits, `hashes` probes for each key."""

    words: tuple[int, ...]
    hashes: int

    def contains(self, key: Column, depth: int) -> Column:
        def probes(table: Column) -> Column:
            found = F.lit(True)
            for probe in range(self.hashes):
                bit = bit_of(key, depth, probe, 64 * len(self.words))
                found = found & (F.get(table, (bit / 64).cast("int")).bitwiseAND(single_bit(bit)) != 0)
            return found

        return let(F.split(F.lit(",".join(map(str, self.words))), ",").cast("array<bigint>"), probes)


def bit_of(key: Column, depth: int, probe: int, bits: int) -> Column:
    """The bit of a key for one probe at one level; a different salt for each keeps levels independent."""
    return F.pmod(F.xxhash64(F.lit(1000 * depth + probe), key), F.lit(bits))


def single_bit(bit: Column) -> Column:
    return F.call_function("shiftleft", F.lit(1).cast("bigint"), F.pmod(bit, F.lit(64)).cast("int"))


def url_parts(url: Column) -> tuple[Column, Column]:
    """(host, path). Host: after the first `://` up to `/`, `?`, `#` or the end, A-Z lower-cased; path: from
    there up to `?`, `#` or the end. Both are empty for a null URL or one without `://`."""
    text = F.coalesce(url, F.lit(""))
    at = F.instr(text, "://")
    rest = F.when(at > 0, F.substring(text, at + 3, F.length(text))).otherwise(F.lit(""))
    host = F.translate(F.regexp_extract(rest, r"^([^/?#]*)", 1), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return host, F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def candidate_keys(host: Column, path: Column, lengths: list[int]) -> Column:
    """Every (host suffix + path prefix) key that a rule for this URL could have, each once.

    Prefix lengths are those that occur among the rules (a bounded list), so that a URL has as many keys as
    its host has labels times that. Keys join host and path by a control character that no host holds.
    """
    labels = F.split(host, r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    prefixes = F.array(*(F.when(F.length(path) >= n, F.substring(path, 1, n)) for n in lengths))
    return F.array_distinct(F.flatten(F.transform(suffixes, lambda s: F.transform(F.array_compact(prefixes), lambda p: F.concat(s, F.lit("\x01"), p)))))


def build_level(keys: DataFrame, count: int, rate: float, depth: int) -> Level:
    """A Bloom filter of `count` keys with a false-positive rate of about `rate`.

    Bits are OR-ed on the executors into 64-bit words; only words come to the driver, never keys.
    """
    hashes = max(1, min(16, round(-math.log2(rate))))
    bits = max(64, 64 * math.ceil(count * hashes / math.log(2) / 64))
    probes = F.explode(F.array(*(bit_of(F.col("k"), depth, p, bits) for p in range(hashes))))
    words = (
        keys.select(probes.alias("bit"))
        .groupBy((F.col("bit") / 64).cast("int").alias("w"))
        .agg(F.bit_or(single_bit(F.col("bit"))).alias("v"))
        .collect()
    )
    full = [0] * (bits // 64)
    for row in words:
        full[row["w"]] = row["v"]
    return Level(tuple(full), hashes)


def build_cascade(listed: DataFrame, count: int, universe: DataFrame) -> list[Level]:
    """The levels for `count` distinct `listed` keys within `universe` (both with one column k, null-free; keys may repeat in the universe).

    The universe's size only sets level 1's rate, so an estimate does.
    """
    if not count:
        return []
    size = universe.agg(F.approx_count_distinct("k").alias("n")).first()["n"]
    levels = [build_level(listed, count, min(0.5, max(count / (math.sqrt(2) * max(size, 1)), 2.0**-16)), 0)]
    inside, outside = cut(universe.where(levels[0].contains(F.col("k"), 0)).distinct().join(listed, "k", "left_anti")), listed
    while n := inside.count():
        levels.append(build_level(inside, n, 0.5, len(levels)))
        inside, outside = outside.where(levels[-1].contains(F.col("k"), len(levels) - 1)), inside
    return levels


def is_listed(key: Column, levels: list[Level]) -> Column:
    """Exact membership of a universe key: odd levels hold listed keys, even levels their false positives."""
    answer = F.lit(len(levels) % 2 == 1)
    for depth in reversed(range(len(levels))):
        answer = F.when(levels[depth].contains(key, depth), answer).otherwise(F.lit(depth % 2 == 1))
    return answer


def judge(pages: DataFrame, rules: list[Rule], id_column: str = "page_id", url_column: str = "url", default: str = "allow") -> DataFrame:
    """Verdict for each page: id, host, path, rule (text of the longest rule that fits, else null), verdict.

    A rule fits its host and all subdomains where the path starts with the rule's path; the longest wins,
    between equally long ones the one that sorts first. Of rules that agree in host and path the last counts. Without a rule
    the verdict is `default`. Null and malformed URLs have an empty host and path and fit no rule; repeated rows are judged
    one by one; an empty table or list gives an empty or all-default result. Further columns of the input are dropped.
    """
    spark = pages.sparkSession
    host, path = url_parts(F.col("url"))
    parts = pick(pages, page=id_column, url=url_column).select("page", host.alias("host"), path.alias("path"))
    actions = {f"{r.host}\x01{r.path}": r.action for r in rules}
    result = [F.col("page").alias(id_column), "host", "path", "rule", "verdict"]
    if not actions:
        return parts.select("page", "host", "path", F.lit(None).cast("string").alias("rule"), F.lit(default).alias("verdict")).select(*result)
    keyed = parts.withColumn("keys", candidate_keys(F.col("host"), F.col("path"), sorted({len(r.path) for r in rules})))
    table = lambda keys: spark.createDataFrame([(k,) for k in keys], "k string")
    blocked = [k for k, action in actions.items() if action == "block"]
    levels = build_cascade(table(actions), len(actions), keyed.select(F.explode("keys").alias("k")))
    blocking = build_cascade(table(blocked), len(blocked), table(actions))
    order = lambda k: F.struct((-F.length(k)).alias("n"), k.alias("k"))
    found = F.filter(F.col("keys"), lambda k: is_listed(k, levels))
    best = keyed.withColumn("best", F.get(F.array_sort(F.transform(found, order)), F.lit(0))["k"])
    rule = F.translate(F.col("best"), "\x01", "")
    verdict = F.when(rule.isNull(), default).when(is_listed(F.col("best"), blocking), "block").otherwise("allow")
    return best.select("page", "host", "path", rule.alias("rule"), verdict.alias("verdict")).select(*result)
