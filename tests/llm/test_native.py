"""URL filters, quality rules and fingerprints against brute force, and their defined odd cases."""

import hashlib
import random
import re

import pytest

from tributary.llm import fingerprints, quality, queries, url_filter
from tributary.llm.common import read_table

from . import brute


def rows(frame, *keys):
    return sorted((r.asDict() for r in frame.collect()), key=lambda r: [(r[k] is None, r[k]) for k in keys])


def brute_rule(url, rules):
    m = re.search(r"://([^/?#]*)([^?#]*)", url or "", re.S)
    host, path = (brute.ascii_lower(m[1]), m[2]) if m else ("", "")
    fits = [r for r in rules if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
    best = min(fits, key=lambda r: (-len(r.text), r.text), default=None)
    return host, path, best and best.text, best.action if best else "allow"


def test_url_filter_on_pages(spark, sf_dir):
    pages = read_table(spark, sf_dir, "pages")
    got = {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in queries.op10_url_filter(spark, sf_dir).collect()}
    assert got == {r["page_id"]: brute_rule(r["url"], queries.URL_RULES) for r in pages.collect()}


@pytest.mark.parametrize("most", [60, 300])
def test_url_filter_odd_rows_and_many_rules(spark, most):
    rng = random.Random(1)
    hosts = [f"h{rng.randrange(40)}.s{rng.randrange(9)}.org" for _ in range(300)]
    urls = [None, "", "x", "http://", "HTTP://A.COM", "http://a.com?x=/en/", "a://b://c/d", "http://WWW.Example.com/en/x#y", *(f"https://{h}/p{rng.randrange(5)}/q" for h in hosts)]
    urls += urls[:20]
    rules = list({(h, p): url_filter.Rule(rng.choice(["allow", "block"]), h, p) for h in ["org", "s1.org", *hosts[:most]] for p in ["/", f"/p{rng.randrange(5)}"]}.values())
    pages = spark.createDataFrame([(i, u, "x", "y") for i, u in enumerate(urls)], "page_id long, url string, keys string, rule string")
    got = rows(url_filter.judge(pages, rules), "page_id")
    assert [(r["host"], r["path"], r["rule"], r["verdict"]) for r in got] == [brute_rule(u, rules) for u in urls]
    assert url_filter.judge(pages.limit(0), rules).count() == 0
    assert {r["verdict"] for r in url_filter.judge(pages, []).collect()} == {"allow"}


def test_quality_on_documents(spark, sf_dir):
    docs = read_table(spark, sf_dir, "documents")
    want = brute.quality([(r["doc_id"], r["source"], r["text"]) for r in docs.collect()], quality.MAX_DOCUMENTS, quality.MIN_REMAINING)
    assert rows(queries.op8_quality(spark, sf_dir), "doc_id") == sorted(want, key=lambda r: r["doc_id"])


def odd_documents():
    rng = random.Random(2)
    word = lambda: "".join(rng.choice("abcdefg") for _ in range(rng.randrange(1, 6)))
    line = lambda n: " ".join(word() for _ in range(n))
    shared = line(30)
    data = [(1, None, None), (2, "s", ""), (3, "s", "\n \t\n"), (None, "s", line(60)), (4, "s", line(60)), (4, "s", line(70))]
    data += [(i, "s", f"{shared.upper()}  \n{line(5)}\n{shared}") for i in range(10, 18)]
    data += [(i, "s", f"{shared}\n{line(200)}") for i in range(20, 28)]
    copy = f"{line(40)}\n{line(40)}"
    data += [(i, "t", copy) for i in range(30, 45)] + [(30, "t", copy)] * 2
    data += [(50, "s", line(60) + "\n" + (line(3) + "\n") * 40), (51, "s", "a b c " * 40), (52, "s", line(20000))]
    return data


def test_quality_odd_rows(spark):
    data = odd_documents()
    docs = spark.createDataFrame([(*d, "x", 5) for d in data], "doc_id long, source string, text string, words string, id int")
    key = lambda r: (r["doc_id"] is None, r["doc_id"] or 0, r["n_words"])
    want = sorted(brute.quality(data, 6, 0.2), key=key)
    got = sorted((r.asDict() for r in quality.judge(docs, max_documents=6).collect()), key=key)
    assert got == want
    assert sum(r["n_removed"] > 0 for r in want) == 16 and sum(r["kept"] for r in want if r["doc_id"] and 30 <= r["doc_id"] < 45) == 17
    cleaned = quality.clean(docs, max_documents=6)
    assert cleaned.columns == docs.columns
    assert sorted(len(brute.WORD.findall(r["text"])) for r in cleaned.collect()) == sorted(r["n_words"] - r["n_removed"] for r in want if r["kept"])
    assert quality.judge(docs.limit(0)).count() == 0 and quality.clean(docs.limit(0)).count() == 0


def test_templates_go_and_copies_stay(spark):
    rng = random.Random(3)
    line = lambda n: " ".join("".join(rng.choice("abcdefgh") for _ in range(6)) for _ in range(n))
    data, removed, base = [], {}, 0
    for share in (80, 90, 95):
        for k in range(4):
            template = "\n".join(line(share // 5) for _ in range(5))
            data += [(base + i, f"{share} {k}", f"{template}\n{line(100 - share)}") for i in range(30)]
            removed |= {base + i: share for i in range(30)}
            base += 30
    for k in range(4):
        whole = [line(25) for _ in range(6)]
        for i in range(30):
            x = list(whole)
            if i % 3:
                at, words = i % 6, x[i % 6].split()
                words[rng.randrange(25)] = line(1)
                x[at] = " ".join(words)
            data.append((base + i, f"copies {k}", "\n".join(x)))
            removed[base + i] = 0
        base += 30
    docs = spark.createDataFrame(data, "doc_id long, source string, text string")
    assert {r["doc_id"]: r["n_removed"] for r in quality.judge(docs).collect()} == removed


def brute_edits(data):
    order = sorted(((i, t or "") for i, t in data), key=lambda r: (r[0] is None, -(r[0] or 0), r[1].encode()))
    out = []
    for k, (i, t) in enumerate(order):
        following = order[(k + 1) % len(order)][1]
        third = len(t) // 3
        edited = t[: len(t) - third] + following[:third]
        forms = [brute.canonical(x) for x in (t, edited, following)]
        out.append((i, len(t), hashlib.sha256(edited.encode()).hexdigest(), float(forms[0] == forms[1]), float(forms[0] == forms[2]), forms[0], forms[1]))
    return out


def check_edits(got, want):
    plain = [(r["doc_id"], r["n_chars"], r["edited_sha256"], r["near_edited"], r["near_next"]) for r in got]
    key = lambda r: (r[0] is None, r[0] or 0, r[1:])
    assert sorted(plain, key=key) == sorted((w[:5] for w in want), key=key)
    of = {w[2]: w for w in want}
    pairs = {(r["fingerprint"], of[r["edited_sha256"]][5]) for r in got} | {(r["edited_fingerprint"], of[r["edited_sha256"]][6]) for r in got}
    assert len(pairs) == len({a for a, _ in pairs}) == len({b for _, b in pairs})


def test_fingerprints_on_documents(spark, sf_dir):
    docs = [(r["doc_id"], r["text"]) for r in read_table(spark, sf_dir, "documents").collect()]
    check_edits(queries.op5_fingerprints(spark, sf_dir).collect(), brute_edits(docs))


def test_fingerprints_odd_rows(spark):
    texts = ["", None, "a", "A ", "ｆｕｌｌ ＷＩＤＴＨ text", "full width  TEXT", "e\u0301t\u00e9 \u00a0x", "\u00e9te\u0301 x", "Stra\u00dfe", "STRASSE", "x\ty\nz" * 5000, "ab", "ab"]
    ids = [1, 5, 300, 301, 70000, 70001, 10**9, 10**12, -4, -5, None, 7, 7]
    docs = spark.createDataFrame([(i, t, "q", 1) for i, t in zip(ids, texts)], "doc_id long, text string, block string, hash int")
    check_edits(fingerprints.compare_edits(docs).collect(), brute_edits(list(zip(ids, texts))))
    alone = docs.where("doc_id = 5")
    assert fingerprints.compare_edits(alone).collect()[0]["near_next"] == 1.0
    assert fingerprints.compare_edits(docs.limit(0)).count() == 0
    named = {r["doc_id"]: r["fingerprint"] for r in fingerprints.fingerprint(docs).collect()}
    assert named[1] == named[5] and named[300] == named[301] and named[70000] == named[70001] and named[10**9] == named[10**12] and named[-4] == named[-5]
    assert len(named) == 12


def test_blocks_are_even_and_in_order_however_ids_are_spread(spark):
    rng = random.Random(9)
    dense = list(range(5000))
    hashed = [rng.randrange(-(2**63), 2**63) for _ in range(5000)]
    spread = [int(1.01**k) + k for k in range(4000)]
    for ids in (dense, hashed, spread):
        rows = spark.createDataFrame([(i, str(i)) for i in ids] + [(None, "x")], "id long, text string")
        told = {r["id"]: r["block"] for r in rows.withColumn("block", fingerprints.block_of(rows)).collect()}
        blocks = [told[i] for i in sorted(ids)]
        assert blocks == sorted(blocks) and told[None] == fingerprints.NULL_BLOCK and max(map(blocks.count, set(blocks))) < 2000
        assert len(set(blocks)) >= 10
        by_id = {r["id"]: r["next_text"] for r in fingerprints.with_next(rows).collect()}
        order = sorted(ids, reverse=True) + [None]
        assert all(by_id[a] == ("x" if b is None else str(b)) for a, b in zip(order, order[1:])) and by_id[None] == str(order[0])


def test_bucket_members_that_differ_get_ordinals(spark):
    texts = spark.createDataFrame([("b", 1, 2), ("a", 1, 2), ("a", 1, 2), ("c", 3, 4)], "canonical_form string, x long, y long")
    texts = texts.selectExpr("canonical_form", "struct(x as a, y as b) as hash")
    assert sorted((r["canonical_form"], r["ordinal"]) for r in fingerprints.bucket_ordinals(texts).collect()) == [("a", 1), ("b", 2)]
