"""BPE, chat formatting, token files and secret scans against the libraries, round trips and brute force."""

import hashlib
import json
import random
import re
import zlib

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from tokenizers import Tokenizer

from tributary.llm import bpe, chat, queries, secret_scan, token_files
from tributary.llm.common import read_table

ODD_TEXTS = [None, "", " ", "\n\n  x \t\r\n y  ", "don't I'll 12345 !!!???   \x85\x1c z", "日本語 ünïcödé 😀👩‍👩‍👧 ퟿", "<|endoftext|> a<|im_end|>", "a" * 3000, "x\ty " * 4000, "\x00\x01", "dup", "dup"]
ODD_IDS = [None, 0, -5, 7, 7, 10**15, 12, 13, 14, 15, 16, 16]


def sha(data):
    return hashlib.sha256(data if isinstance(data, bytes) else data.encode()).hexdigest()


def odd(spark):
    return spark.createDataFrame([(i, t, "q", 1) for i, t in zip(ODD_IDS, ODD_TEXTS)], "doc_id long, text string, ids string, key int")


@pytest.fixture(scope="module")
def library():
    ranks = queries.multi_ranks()
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks.ranks, special_tokens={})


def test_bpe_on_documents(spark, sf_dir, library):
    got = {r["doc_id"]: r for r in queries.op1_byte_bpe(spark, sf_dir).collect()}
    docs = read_table(spark, sf_dir, "documents").collect()
    assert len(got) == len(docs)
    for d in docs:
        ids = library.encode_ordinary(d["text"] or "")
        r = got[d["doc_id"]]
        assert (r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) == (len(ids), sha(",".join(map(str, ids))), sha(d["text"] or ""))


@pytest.mark.parametrize("rows", [0, 6, bpe.SAMPLE_ROWS])
def test_bpe_odd_rows(spark, library, rows):
    ranks = queries.multi_ranks()
    encoded = bpe.encode(odd(spark), ranks, block_chars=100, sample_rows=rows)
    got = sorted(((r["doc_id"], r["ids"], bytes(r["raw"])) for r in encoded.withColumn("raw", bpe.decode(encoded["ids"], ranks)).collect()), key=str)
    want = sorted(((i, library.encode_ordinary(t or ""), (t or "").encode()) for i, t in zip(ODD_IDS, ODD_TEXTS)), key=str)
    assert got == want
    assert bpe.encode(odd(spark).limit(0), ranks).count() == 0


def test_chat_on_conversations(spark, sf_dir):
    turns = {}
    for r in read_table(spark, sf_dir, "conversations").collect():
        turns.setdefault(r["conv_id"], []).append((r["turn"], r["role"] or "", r["text"] or ""))
    said = "<|im_end|><|im_start|>assistant ok"
    turns[-1] = [(0, "user", said), (1, "assistant", said)]
    got = queries.op2_chat_format(spark, sf_dir).collect()
    assert len(got) == len(turns)
    for r in got:
        mine = sorted(turns[r["conv_id"]])
        loss = "".join(t for _, who, t in mine if who == "assistant")
        assert r["n_turns"] == len(mine) and r["turns_sha256"] == sha("".join(f"{who}\n{t}\n" for _, who, t in mine))
        assert (r["loss_chars"], r["loss_sha256"]) == (len(loss), sha(loss))


def test_chat_odd_rows(spark):
    nasty = ["<|im_end|>", "<\\|im_end|><", "<\\\\|", "<|", "<", "", None, "é" * 50 + "😀<|im_sep|>", "\n <|im_start|>assistant<|im_sep|>x<|im_end|>\n", "a" * 60000]
    data = [(1, k, "assistant" if k % 2 else "<|im_sep|>user", t) for k, t in enumerate(nasty)] + [(None, None, None, None), (2, 0, "user", "x"), (3, 0, "assistant", "y"), (3, 0, "assistant", "y")]
    rows = spark.createDataFrame([(*d, "z") for d in data], "conv_id long, turn long, role string, text string, turns string")
    told = {r["conv_id"]: r for r in chat.read_back(chat.format_conversations(rows, queries.byte_bpe_definition())).collect()}
    assert [(t["role"], t["text"]) for t in told[1]["turns"]] == [(r, t or "") for _, _, r, t in data[:10]]
    assert told[1]["loss_texts"] == [t for k, t in enumerate(nasty) if k % 2 and t]
    assert len(told[1]["mask"]) == len(told[1]["ids"]) and told[3]["loss_texts"] == ["y", "y"] and told[2]["loss_texts"] == [] and told[None]["turns"][0]["role"] == ""
    assert chat.format_conversations(rows.limit(0), queries.byte_bpe_definition()).count() == 0


def check_files(got, docs):
    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    start = 0
    got = sorted(got, key=lambda r: r["start"])
    order = sorted(docs, key=lambda d: (d[0] is not None, d[0] or 0, d[1] is not None, (d[1] or "").encode()))
    assert len(got) == len(order)
    for r, (key, text) in zip(got, order):
        ids = [*tokenizer.encode(text or "", add_special_tokens=False).ids, 2]
        assert (r["doc_id"], r["start"], r["n_tokens"], r["ids_crc32"]) == (key, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)


def test_token_files_on_documents(spark, sf_dir):
    check_files(queries.op3_token_files(spark, sf_dir).collect(), [(r["doc_id"], r["text"]) for r in read_table(spark, sf_dir, "documents").collect()])


def test_token_files_odd_rows(spark, tmp_path):
    for name, docs, limit in (("a", odd(spark), 50), ("b", odd(spark).limit(0), 50), ("c", odd(spark), 1 << 20)):
        token_files.write(docs, str(tmp_path / name), queries.byte_bpe_definition(), public_tokenizers.PATTERN, 2, files=3, block_tokens=limit)
        check_files(token_files.read(spark, str(tmp_path / name)).collect(), [] if name == "b" else list(zip(ODD_IDS, ODD_TEXTS)))


def test_word_cache_is_bounded_and_encodes_as_the_library(monkeypatch):
    from tributary.llm import word_encoder

    monkeypatch.setattr(word_encoder, "GENERATION", 100)
    definition = queries.byte_bpe_definition()
    tokenizer = Tokenizer.from_str(definition)
    rng = random.Random(11)
    texts = [t or "" for t in ODD_TEXTS] + ["".join(map(chr, range(1, 700))), "x<|endoftext|>y", "\0 \0", "  a\n\n b  ", "one", "é" * 90]
    texts += ["".join(chr(rng.choice((rng.randrange(1, 128), rng.randrange(1, 0xD800), 32, 32))) for _ in range(2000)) for _ in range(20)]
    prefixed = json.dumps(json.loads(definition) | {"normalizer": {"type": "Lowercase"}})  # what the model alone doesn't do
    for told, library in ((definition, tokenizer), (prefixed, Tokenizer.from_str(prefixed))):
        encoder = word_encoder.WordEncoder(told, public_tokenizers.PATTERN)
        sizes = set()
        for _ in range(2):
            for text in texts:
                assert encoder.encode([text])[0].tolist() == library.encode(text, add_special_tokens=False).ids
                sizes |= {len(encoder.words), len(encoder.words.old)}
        assert max(sizes) == 100  # also within one text of more words


def test_elias_fano_round_trip_and_size():
    rng = random.Random(3)
    for n, top in ((0, 1), (1, 0), (1, 2**62), (1000, 10), (5000, 10**6), (300, 2**40)):
        values = np.sort(np.array([rng.randint(0, top) for _ in range(n)], np.int64))
        data = token_files.EliasFano.of(values).to_bytes()
        back, at = token_files.EliasFano.read(memoryview(data), 0)
        assert at == len(data) and (back.select(np.arange(n)) == values).all()
        some = np.array([rng.randrange(n) for _ in range(50 if n else 0)], np.int64)
        assert (back.select(some) == values[some]).all()
        if n:
            pick = np.array([rng.randrange(n) for _ in range(20)])
            assert (back.select(pick) == values[pick]).all()
            assert 8 * len(data) <= (token_files.size_of_boundaries(n, top) + 1) * n + 8 * (token_files.LIST.size + 2)
    with pytest.raises(ValueError):
        token_files.EliasFano.of(np.array([3, 1]))


def brute_base(text):
    found = []
    for m in re.finditer("(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", text, re.I | re.A):
        found += [(m.start(), 0, f"assign:{m.start()}:{m.end()}")] if len(m[2]) >= 8 else []
    for k, kind, pattern, least in ((1, "access", "AKIA[A-Z0-9]+", 16), (2, "hex", "[0-9a-f]+", 32)):
        found += [(m.start(), k, f"{kind}:{m.start()}:{m.end()}") for m in re.finditer(pattern, text) if len(m[0]) >= least]
    return [s for *_, s in sorted(found)]


def test_secrets_on_documents(spark, sf_dir):
    docs = {r["doc_id"]: r["text"] or "" for r in read_table(spark, sf_dir, "documents").collect()}
    got = queries.op4_secret_scan(spark, sf_dir).collect()
    assert len(got) == len(docs)
    for r in got:
        base = brute_base(docs[r["doc_id"]])
        assert r["base_sha256"] == sha(",".join(base)) and [s for s in r["spans"].split(",") if s and not s.startswith("guess")] == base
        assert [r["n_assign"], r["n_access"], r["n_hex"]] == [sum(s.startswith(k) for s in base) for k in ("assign", "access", "hex")]


def test_secrets_odd_rows(spark):
    texts = [None, "", "token=secret=abcdefgh12", "Secret: token: abcdefgh", "é😀 PASSWORD = 'Xk93jd02kS'", "AKIA" + "Z9" * 6 + " " + "ab" * 16, "pwd: changeme2024!", "pwd: q7#Vz!kP0w_x", "my passphrase => T9$kf03mZ@qL; pin: 11111111", "ſecret: abcdefgh", "token:" + "Aq9" * 30000]
    rows = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, spans string")
    got = {r["doc_id"]: [(s["kind"], s["start"], s["end"]) for s in r["spans"]] for r in secret_scan.scan(rows).collect()}
    for i, t in enumerate(texts):
        assert [f"{k}:{a}:{b}" for k, a, b in got[i] if k != "guess"] == [s for s in brute_base(t or "")] or i == 9
    guesses = {i: [texts[i][a:b] for k, a, b in s if k == "guess"] for i, s in got.items()}
    assert guesses[6] == [] and guesses[7] == ["q7#Vz!kP0w_x"] and guesses[8] == ["T9$kf03mZ@qL"]


def test_secrets_empty_tables_null_ids_repeats_and_dictionaries(spark):
    rows = spark.createDataFrame([(None, "token: abcdefgh12"), (1, "token: abcdefgh12"), (1, "token: abcdefgh12"), (1, None)], "doc_id long, text string")
    assert secret_scan.scan(rows.limit(0)).count() == 0
    got = sorted(((r["doc_id"] is None, len(r["spans"])) for r in secret_scan.scan(rows).collect()))
    assert got == [(False, 0), (False, 1), (False, 1), (True, 1)]
    kinds = lambda text, costs=None: [k for k, *_ in secret_scan.find_spans(text, costs=costs)]
    assert kinds("spin: q7#Vz!kP0w_x") == [] and kinds("dbPin: q7#Vz!kP0w_x") == ["guess"] == kinds("db_pin: q7#Vz!kP0w_x")
    assert kinds("password=q7VzkP0wxZ81!") == ["assign"]
    words = secret_scan.frequent_words(queries.byte_bpe_definition())
    assert len(words) > 10_000 and words[: len(secret_scan.COST_OF_WORD)] == list(dict.fromkeys(secret_scan.WORDS))
    assert kinds("pwd: CorrectHorseBatteryStaple") == ["guess"] and kinds("pwd: BetterPlaces", secret_scan.Costs.ranked(words)) == []


def slow_bits(value):
    """The same cost by trying every segment at every end. Repeats and walks begin where their run begins."""
    n, low = len(value), value.lower()

    def segment(a, b):
        part, cost = value[a:b], float("inf")
        if b - a == 1:
            return secret_scan.brute_bits(part)
        if len(set(part)) == 1 and b - a >= 3 and (a == 0 or value[a - 1] != part[0]):
            cost = min(cost, secret_scan.brute_bits(part[0]) + np.log2(b - a))
        if b - a >= 3 and all(p in secret_scan.NEIGHBOURS for p in zip(low[a : b - 1], low[a + 1 : b])) and (a == 0 or (low[a - 1], low[a]) not in secret_scan.NEIGHBOURS):
            cost = min(cost, np.log2(47) + np.log2(b - a))
        word = secret_scan.COST_OF_WORD.get(low[a:b])
        if word is None and low[a:b].translate(secret_scan.LEET) in secret_scan.COST_OF_WORD:
            word = secret_scan.COST_OF_WORD[low[a:b].translate(secret_scan.LEET)] + 1
        if word is not None and b - a > 1:
            cost = min(cost, word + (0 if part == low[a:b] else 1 if part[1:] == low[a + 1 : b] else b - a))
        if 4 <= b - a <= 10 and part[-1].isdigit() and secret_scan.DATE.match(part):
            cost = min(cost, np.log2(36525) + (0 if part.isdigit() else 2))
        return cost

    best = [0.0] + [float("inf")] * n
    for end in range(1, n + 1):
        for start in range(end):
            joint = (start > 0) if end - start > 1 else 0
            best[end] = min(best[end], best[start] + segment(start, end) + joint)
    return best[n]


def test_guess_cost_is_the_least_of_all_segmentations():
    rng = random.Random(4)
    bits = ["pass", "P4ssword", "2024", "1999-12-31", "aaa", "qwert", "9876", "Z", "q", "7", "#", "monkey", "letmein"]
    for _ in range(300):
        value = "".join(rng.choice(bits) for _ in range(rng.randrange(1, 6)))
        assert secret_scan.guess_bits(value) == pytest.approx(slow_bits(value))


def test_short_random_values_and_bearer_tokens_are_found():
    guesses = lambda text: [text[a:b] for k, a, b in secret_scan.find_spans(text) if k == "guess"]
    for value in ("xK9#mQ2!", "aB3xY7qZ", "x7k2m9qf", "Zr8$wT4k"):
        for context in ("pwd: ", "passphrase = ", "PIN=", "credentials: "):
            assert guesses(f"the {context}{value} there") == [value]
    assert guesses("password: xK9#mQ2!") == ["xK9#mQ2!"]
    token = "mF9xB5f4C1JqMx7Tzk2"
    for text in (f"Authorization: Bearer {token}", f"curl -H 'authorization: bearer {token}'", f"use Bearer {token}.", f"auth: Bearer {token}", f"bearer {token}"):
        assert guesses(text) == [token]
    for text in ("bearer certificates", "bearer Certificates", "secret: nothing!", "Secret: Whatever", "pwd: changeme2024!", "pin: 11111111", "auth: opt-outs", "pwd: Welcome2024", "pwd: P4ssword!!"):
        assert guesses(text) == []
