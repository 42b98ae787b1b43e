"""Near-duplicates against all pairs on small tables."""

import random

import numpy as np
import pytest

from tributary.llm import near_dup
from tributary.llm.common import read_table

from . import brute


def shingles(text, width=5):
    words = brute.WORD.findall(brute.ascii_lower(text or ""))
    return {tuple(words[i : i + width]) for i in range(max(1, len(words) - width + 1))} if words else set()


def brute_components(rows, percent):
    """(id, text) rows with distinct ids: id -> (n, component)."""
    sets = {i: shingles(t) for i, t in rows}
    parent = {i: i for i in sets}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    where = {}
    for i, s in sets.items():
        for x in s:
            where.setdefault(x, []).append(i)
    pairs = {(i, j) for v in where.values() for i in v for j in v if i < j}
    for i, j in pairs:
        both = len(sets[i] & sets[j])
        if 100 * both >= percent * (len(sets[i]) + len(sets[j]) - both):
            a, b = sorted((root(i), root(j)))
            parent[b] = a
    return {i: (len(sets[i]), root(i)) for i in sets}


def check(frame, want):
    got = frame.collect()
    assert len(got) == len(want)
    for r in got:
        assert (r["n_shingles"], r["component_id"], r["kept"]) == (*want[r["doc_id"]], want[r["doc_id"]][1] == r["doc_id"])


@pytest.mark.parametrize("percent", [80, 85])
def test_documents(spark, sf_dir, percent):
    docs = read_table(spark, sf_dir, "documents")
    check(near_dup.components(docs, percent), brute_components([(r["doc_id"], r["text"]) for r in docs.collect()], percent))


def cloud(n, size=120, seed=5):
    """Copies of one text with zero to six edited words each, and unrelated texts between them."""
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(5))
    center = [word() for _ in range(size)]
    out = []
    for i in range(n):
        words = list(center)
        for _ in range(rng.choice([0, 1, 1, 2, 2, 3, 4, 6])):
            words[rng.randrange(size)] = word()
        out.append((i, " ".join(words) if i % 4 else " ".join(word() for _ in range(rng.randrange(1, 60)))))
    return out


@pytest.mark.parametrize("chunk", [near_dup.CHUNK, 7])
def test_cloud_of_copies_in_one_block_and_in_many(spark, chunk, monkeypatch):
    for name in ("CHUNK", "SKETCH_CHUNK", "SALT"):
        monkeypatch.setattr(near_dup, name, min(chunk, getattr(near_dup, name)))
    rows = cloud(400)
    frame = spark.createDataFrame([(i, t, "x", 1) for i, t in rows], "doc_id long, text string, sketch string, n int")
    check(near_dup.components(frame, 85), brute_components(rows, 85))


def test_blocks_emit_a_forest_and_not_all_links(spark):
    rows = cloud(300)
    star = spark.createDataFrame([(i, rows[1][0]) for i, _ in rows if i % 4 and i != 1], "id long, hub long")
    count = near_dup.band_count(0.85) * near_dup.ROWS
    sketch = lambda t: near_dup.registers(near_dup.shingle_set(t), count).view("<i8").tolist()
    texts = spark.createDataFrame([(i, sketch(t), t) for i, t in rows], "id long, sketch array<bigint>, text string")
    links = near_dup.hub_links(star, texts, 85, near_dup.SHINGLE).collect()
    assert all(r["a"] == 1 for r in links) and len({r["b"] for r in links}) == len(links) > 20


def test_odd_rows(spark):
    texts = [None, "", " \n\t", "a", "A", "a b c", "A B\nC", "a b c d", "w " * 30000, "W " * 20000, "é x y z ü", "É x y z ü"]
    rows = list(enumerate(texts, 5))
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    check(near_dup.components(frame), brute_components(rows, 80))
    twice = frame.union(frame).union(spark.createDataFrame([(None, "a b c"), (5, "a"), (6, "a b c")], frame.schema))
    got = {(r["doc_id"], r["n_shingles"]): (r["component_id"], r["kept"]) for r in near_dup.components(twice).collect()}
    assert got[None, 1] == (None, True) and got[5, 1] == (5, True) and got[8, 1] == (5, False) and got[10, 1] == (6, False)
    kept = near_dup.keep_one(twice)
    assert kept.columns == twice.columns and {r["doc_id"] for r in kept.collect()} == {None, 5, 6, 7, 12, 13, 15, 16}
    assert near_dup.components(frame.limit(0)).count() == 0


def test_estimate_follows_similarity():
    rng = np.random.default_rng(6)
    for share in (0.3, 0.6, 0.9):
        base = rng.integers(0, 1 << 63, 3000, dtype=np.uint64)
        a, b = base[:2000], np.concatenate([base[: int(2000 * share)], base[2000 : 2000 + int(2000 * (1 - share))]])
        true = share / (2 - share)
        told = [near_dup.estimate(near_dup.registers(near_dup.mix(a + np.uint64(s)), 88), near_dup.registers(near_dup.mix(b + np.uint64(s)), 88)[None])[0][0] for s in range(30)]
        assert abs(np.mean(told) - true) < 0.04
    assert near_dup.band_count(0.85) == 22


@pytest.mark.parametrize("few", [0, near_dup.FEW_EDGES])
def test_connected_components(spark, few, monkeypatch):
    monkeypatch.setattr(near_dup, "FEW_EDGES", few)
    edges = [(i, i + 1) for i in range(0, 40)] + [(100, 102), (101, 102), (7, 7)] + [(200, 200 + i) for i in range(1, 300)]
    got = {r["node"]: r["component"] for r in near_dup.connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert all(got[i] == 0 for i in range(41)) and got[101] == 100 and got[499] == 200
