"""Plain Python versions of what the operators compute, for small tables."""

import re
import unicodedata
from collections import Counter, defaultdict

import xxhash

WORD = re.compile("[^\x20\x09-\x0d]+")
MASK = (1 << 64) - 1


def signed(x):
    return x - (1 << 64) if x >> 63 else x


def xx(*strings):
    """Spark's xxhash64 of string columns."""
    seed = 42
    for s in strings:
        seed = xxhash.xxh64_intdigest(s.encode(), seed & MASK)
    return signed(seed)


def xx_long(x):
    """Spark's xxhash64 of one long column."""
    return signed(xxhash.xxh64_intdigest((x & MASK).to_bytes(8, "little"), 42))


def ascii_lower(s):
    return re.sub("[A-Z]", lambda m: m[0].lower(), s)


def canonical(text):
    folded = unicodedata.normalize("NFKC", unicodedata.normalize("NFKC", text).casefold())
    return " ".join(folded.split())


def base_metrics(text):
    words = WORD.findall(text)
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    often = {w for w, n in Counter(windows).items() if n > 1}
    covered = {i + k for i, w in enumerate(windows) if w in often for k in range(3)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    failed = len(words) < 50 or 100 * len(covered) > 50 * len(words)
    return {
        "n_words": len(words), "word_chars": sum(map(len, words)), "n_symbols": sum(c in "#*$%&|<>" for c in text),
        "n_dup_lines": len(lines) - len(set(lines)), "n_repeat_words": len(covered), "base_failed": failed,
    }


def normal_line(x):
    return re.sub("[\x20\x09-\x0d]+", " ", x.lower()).strip(" ")


def quality(docs, max_documents, min_remaining):
    """docs: (id, source, text); returns per row the metrics, n_removed and kept."""
    rows = [(i, s or "", t or "") for i, s, t in docs]
    seen = defaultdict(Counter)
    for _, s, t in rows:
        words = WORD.findall(t)
        key = min((xx(*words[k : k + 3]) for k in range(len(words) - 2)), default=xx(t))
        for x in {normal_line(x) for x in t.split("\n") if WORD.search(x)}:
            seen[s, x][key] += 1
    often = {k for k, c in seen.items() if sum(c.values()) > max_documents and max(c.values()) < 0.5 * sum(c.values())}
    out = []
    for i, s, t in rows:
        m = base_metrics(t)
        gone = sum(len(WORD.findall(x)) for x in t.split("\n") if (s, normal_line(x)) in often)
        out.append({"doc_id": i, **m, "n_removed": gone, "kept": not m["base_failed"] and m["n_words"] - gone >= min_remaining * m["n_words"]})
    return out
