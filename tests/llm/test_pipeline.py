"""Each stage of the corpus pipeline against brute force on what the stage before it kept."""

import tiktoken

import corpus_pipeline
from tributary.llm import line_dedup, mixing, quality, queries
from tributary.llm.common import read_table

from . import brute
from .test_lines_and_mix import brute_repeats
from .test_near_dup import brute_components


def test_stages(spark, sf_dir, tmp_path):
    docs = read_table(spark, sf_dir, "documents")
    columns, rows, kept = docs.columns, [docs.collect()], []
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{tmp_path}/{k}")
        docs = spark.read.parquet(f"{tmp_path}/{k}")
        assert k == 4 or docs.columns == columns
        rows.append(docs.collect())
    kept = [{r["doc_id"]: r for r in part} for part in rows]
    assert [len(part) for part in rows] == [len(part) for part in kept]
    verdicts = brute.quality([(r["doc_id"], r["source"], r["text"]) for r in rows[0]], quality.MAX_DOCUMENTS, quality.MIN_REMAINING)
    assert set(kept[1]) == {v["doc_id"] for v in verdicts if v["kept"]}
    assert {i: r["text"] for i, r in kept[2].items()} == dict(brute_repeats([(r["doc_id"], r["text"]) for r in rows[1]], line_dedup.MIN_WORDS))
    assert all(r["n_chars"] == len(r["text"]) for r in rows[2])
    found = brute_components([(r["doc_id"], r["text"]) for r in rows[2]], 80)
    assert set(kept[3]) == {i for i, (_, c) in found.items() if i == c}
    assert set(kept[4]) == {r["doc_id"] for r in mixing.schedule(spark.read.parquet(f"{tmp_path}/2")).collect() if r["in_mix"]}
    ranks = queries.multi_ranks()
    library = tiktoken.Encoding("own", pat_str=ranks.pattern, mergeable_ranks=ranks.ranks, special_tokens={})
    for r in rows[5]:
        text = kept[4][r["doc_id"]]["text"]
        assert r["ids"] == library.encode_ordinary(text) and r["n_bytes"] == len(text.encode())
    assert set(kept[5]) == set(kept[4]) and len(rows[5]) > 50


def test_odd_rows(spark):
    """Nulls, empty, long and repeated texts, clashing columns and an empty table pass all stages."""
    line = lambda n, seed: " ".join(f"w{i * seed}" for i in range(n))
    own = {1: line(80, 3), 2: line(80, 7), 3: line(30000, 11), None: line(70, 13)}
    rows = [(i, t, "en", "s", len(t)) for i, t in own.items()] + [(1, own[1], "en", "s", len(own[1])), (9, own[2], "en", "s", 1), (5, None, None, None, None), (6, "", "de", "t", 0), (7, "too short", "de", "t", 9)]
    clashing = ["row", "id", "slot", "line", "mix_id", "gone_id", "d"]
    docs = spark.createDataFrame([(*r, *["z"] * len(clashing)) for r in rows], "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"{c} string" for c in clashing))
    for frame, want in ((docs, {1, 2, 3, None}), (docs.limit(0), set())):
        for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
            columns = frame.columns
            frame = stage(spark, frame, "")
            assert k == 4 or frame.columns == columns
        assert {r["doc_id"] for r in frame.collect()} == want


def test_run(spark, sf_dir):
    assert corpus_pipeline.run(spark, sf_dir).columns == ["doc_id", "n_tokens", "ids", "n_bytes"]
