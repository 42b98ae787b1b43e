"""Line dedup and mixing against brute force."""

import hashlib
import random
from collections import Counter, defaultdict

import pytest

from tributary.llm import line_dedup, mixing, queries
from tributary.llm.common import read_table

from . import brute


def brute_repeats(docs, min_words, drop_emptied=True):
    """docs: (id, text). Per document the text without later copies, without documents that are emptied."""
    order = sorted(set((i, t or "") for i, t in docs), key=lambda d: (d[0] is None, d[0] or 0, brute.xx(d[1])))
    seen, gone = set(), defaultdict(set)
    for doc in order:
        lines = [(k, brute.normal_line(x), len(brute.WORD.findall(x))) for k, x in enumerate(doc[1].split("\n")) if brute.WORD.search(x)]
        for i in range(len(lines)):
            total, m = 0, 0
            while i + m < len(lines) and total < min_words:
                total, m = total + lines[i + m][2], m + 1
            if total < min_words:
                continue
            key = tuple(x for _, x, _ in lines[i : i + m])
            if key in seen:
                gone[doc] |= {k for k, _, _ in lines[i : i + m]}
            seen.add(key)
    out = []
    for i, t in docs:
        lines = (t or "").split("\n")
        cut = gone.get((i, t or ""), set())
        rest = [x for k, x in enumerate(lines) if k not in cut]
        if not drop_emptied or not cut or any(brute.WORD.search(x) for x in rest):
            out.append((i, "\n".join(rest) if cut else t))
    return out


def pieces():
    rng = random.Random(7)
    word = lambda: "".join(rng.choice("abcdefg") for _ in range(4))
    pool = [" ".join(word() for _ in range(rng.choice([1, 2, 3, 8, 20]))) for _ in range(40)]
    docs = []
    for i in range(120):
        start = rng.randrange(40)
        run = [pool[(start + k) % 40].upper() if rng.random() < 0.1 else pool[(start + k) % 40] for k in range(rng.randrange(1, 14))]
        own = [" ".join(word() for _ in range(9)) for _ in range(rng.randrange(0, 3))]
        parts = [*own, *run, "", *own[:1], " \t"] if rng.random() < 0.7 else own
        docs.append((i, "\n".join(parts)))
    docs += [(None, docs[3][1]), (5, docs[5][1]), (5, docs[6][1]), (200, None), (201, ""), (202, "\n\n"), (203, "x " * 80), (204, "x " * 80), (205, "\n".join(["one"] * 300)), (206, "\n".join(["one"] * 4000))]
    return docs


@pytest.mark.parametrize("min_words", [1, 12, 50])
def test_line_dedup_pieces(spark, min_words):
    docs = pieces()
    frame = spark.createDataFrame([(i, t, "s", 0, "y") for i, t in docs], "doc_id long, text string, source string, n_chars long, pos string")
    got = line_dedup.remove_repeats(frame, min_words)
    assert got.columns == frame.columns
    key = lambda r: (r[0] is None, r[0] or 0, str(r[1]))
    assert sorted(((r["doc_id"], r["text"]) for r in got.collect()), key=key) == sorted(brute_repeats(docs, min_words), key=key)
    assert line_dedup.remove_repeats(frame.limit(0), min_words).count() == 0


def test_line_dedup_on_documents(spark, sf_dir):
    docs = read_table(spark, sf_dir, "documents")
    got = {r["doc_id"]: r["text"] for r in line_dedup.remove_repeats(docs).collect()}
    want = dict(brute_repeats([(r["doc_id"], r["text"]) for r in docs.collect()], line_dedup.MIN_WORDS))
    assert got == want and len(got) < docs.count()


def test_shares_and_period_keep_every_source_within_a_block():
    rng = random.Random(8)
    for n in (1, 2, 7, 40):
        weights = {f"s{i}": rng.random() ** 3 + 0.001 for i in range(n)}
        slots = mixing.shares(weights, 512)
        assert sum(slots.values()) == 512 and min(slots.values()) >= 1
        plan = mixing.plan_period(slots)
        done = Counter()
        for now, s in enumerate(plan, 1):
            done[s] += 1
            assert all(abs(done[x] - slots[x] * now / 512) < 1 for x in slots)
        assert done == slots


def check_mix(rows, slots, block):
    length = sum(slots.values())
    assert len({r["position"] for r in rows if r["position"] is not None}) == sum(r["position"] is not None for r in rows)
    by_slot = {r["slot"]: r["source"] for r in rows if r["in_mix"]}
    done = Counter()
    for now in range(max(by_slot, default=-1) + 1):
        done[by_slot[now]] += 1
        assert all(abs(done[s] - slots[s] * (now + 1) / length) < 1 for s in slots)
    sizes = Counter((r["source"], r["block"]) for r in rows)
    last = {s: max(b for x, b in sizes if x == s) for s, _ in sizes}
    assert all(n == block or b == last[s] for (s, b), n in sizes.items())


def test_mixing_documents(spark, sf_dir):
    docs = read_table(spark, sf_dir, "documents")
    rows = mixing.schedule(docs, block=4).collect()
    counts = Counter(r["source"] for r in rows)
    assert len(rows) == docs.count() and counts == Counter(r["source"] for r in docs.collect())
    check_mix(rows, mixing.shares(mixing.tempered(counts, mixing.EXPONENT), mixing.PERIOD), 4)
    mixed = mixing.mix(docs, block=4)
    assert mixed.columns == docs.columns
    assert sorted(r["doc_id"] for r in mixed.collect()) == sorted(r["doc_id"] for r in rows if r["in_mix"])


def brute_mix(docs, block, period, exponent):
    """docs: (id, source, text). Per (id, source) its slot and place, by simulating every slot of the whole mix."""
    sources = {}
    for i, s, t in docs:
        mixed = brute.xx_long(-1 if i is None else i)
        sources.setdefault(s or "", []).append(((mixed % 64, mixed, i is not None, i or 0), i))  # 64 cells while sources are small
    period = max(period, 8 * len(sources))
    target = {s: len(rows) ** exponent for s, rows in sources.items()}
    total = sum(target.values())
    exact = {s: x / total * period for s, x in target.items()}
    share = {s: max(1, int(x)) for s, x in exact.items()}
    while sum(share.values()) != period:  # largest remainders, one slot at a time
        lack = sum(share.values()) < period
        s = min(share, key=lambda s: (share[s] - exact[s], s)) if lack else max((s for s in share if share[s] > 1), key=lambda s: (share[s] - exact[s], s))
        share[s] += 1 if lack else -1
    blocks = {s: -(-len(rows) // block) for s, rows in sources.items()}
    run, slot, out = dict.fromkeys(share, 0), 0, {}
    rows_of = {s: [i for _, i in sorted(rows)] for s, rows in sources.items()}
    while any(run[s] < blocks[s] for s in share):
        released = [s for s in share if run[s] * period // share[s] <= slot]
        s = min(released, key=lambda s: (-(-(run[s] + 1) * period // share[s]), s))
        for k, i in enumerate(rows_of[s][run[s] * block : (run[s] + 1) * block]):
            out[i, s] = (slot, slot * block + k)
        run[s], slot = run[s] + 1, slot + 1
    return out


def test_mixing_query_against_a_simulation_of_all_slots(spark, sf_dir):
    docs = [(r["doc_id"], r["source"], r["text"]) for r in read_table(spark, sf_dir, "documents").collect()]
    want = brute_mix(docs, mixing.BLOCK, mixing.PERIOD, mixing.EXPONENT)
    assert {(r["doc_id"], r["source"]): (r["slot"], r["position"]) for r in queries.op6_mixing(spark, sf_dir).collect()} == want
    small = brute_mix(docs, 2, 64, 0.5)
    got = mixing.schedule(read_table(spark, sf_dir, "documents"), block=2, period=64, exponent=0.5)
    assert {(r["doc_id"], r["source"]): (r["slot"], r["position"]) for r in got.collect()} == small


def test_line_dedup_query(spark, sf_dir):
    docs = [(r["doc_id"], r["text"]) for r in read_table(spark, sf_dir, "documents").collect()]
    left = dict(brute_repeats(docs, line_dedup.MIN_WORDS, drop_emptied=False))
    got = {r["doc_id"]: (r["n_chars_left"], r["text_sha256"]) for r in queries.op7_line_dedup(spark, sf_dir).collect()}
    assert got == {i: (len(t), hashlib.sha256(t.encode()).hexdigest()) for i, t in left.items()} and len(got) == len(docs)


def test_mixing_odd_rows(spark):
    data = [(i, "hot" if i % 3 else f"s{i % 7}", f"t{i}") for i in range(900)] + [(None, None, None)] * 9 + [(1, "hot", "t1")] * 40 + [(2, "other", "x")] * 3
    clashing = ["slot", "position", "mix_id", "row", "id", "of_id", "turn", "text_hash"]
    frame = spark.createDataFrame([(*d, *["z"] * len(clashing)) for d in data], "doc_id long, source string, text string, " + ", ".join(f"{c} string" for c in clashing))
    weights = {"hot": 3.0, "": 0.5, **{f"s{k}": 1.0 for k in range(7)}, "absent": 9.0}
    rows = mixing.schedule(frame, weights, block=5).collect()
    check_mix([r for r in rows if r["slot"] is not None], mixing.shares({k: v for k, v in weights.items() if k != "absent"}, mixing.PERIOD), 5)
    assert len(rows) == len(data) and {r["source"] for r in rows if r["slot"] is None} == {"other"}
    got = Counter((r["doc_id"], r["text"]) for r in mixing.mix(frame, weights, block=5).collect())
    told = Counter((r["doc_id"], r["source"]) for r in rows if r["in_mix"])
    assert sum(got.values()) == sum(told.values()) and got[1, "t1"] == told[1, "hot"]
    assert mixing.mix(frame, weights, block=5).columns == frame.columns and {r["mix_id"] for r in mixing.mix(frame).collect()} == {"z"}
    assert mixing.schedule(frame.limit(0)).count() == 0 and mixing.mix(frame.limit(0)).count() == 0


def test_mix_goes_on_when_a_source_runs_out(spark):
    sizes = {"hot": 3000, "large": 2000, "tiny": 3, None: 2}
    data = [(k, s, f"{s} {i}") for k, (s, i) in enumerate((s, i) for s, n in sizes.items() for i in range(n))]
    frame = spark.createDataFrame(data, "doc_id long, source string, text string")
    rows = mixing.schedule(frame, block=2, period=64).collect()
    assert all(r["in_mix"] for r in rows) and len({r["position"] for r in rows}) == len(data)
    slots = mixing.shares(mixing.tempered({s or "": n for s, n in sizes.items()}, mixing.EXPONENT), 64)
    done, share = Counter(), slots["hot"] / (slots["hot"] + slots["large"])
    for _, s in sorted({(r["slot"], r["source"]) for r in rows}):
        done[s] += 1
        if done["large"] < 1000 and done["hot"] < 1500:
            assert abs(done["hot"] - share * (done["hot"] + done["large"])) <= 2
    order = {r["doc_id"]: r["position"] for r in rows}
    got = [r["doc_id"] for r in mixing.mix(frame, block=2, period=64).collect()]
    assert got == sorted(order, key=order.get)
    twice = [r["text"] for r in mixing.mix(frame.union(frame.where("source is null")), block=2, period=64).collect()]
    assert Counter(twice) == Counter([t for *_, t in data] + ["None 0", "None 1"])
    assert not all(r["in_mix"] for r in mixing.schedule(frame, block=2, period=64, whole=False).collect())
