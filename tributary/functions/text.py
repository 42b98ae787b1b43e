"""Text functions that Spark lacks, as Arrow-batched Python UDFs."""

from __future__ import annotations

import unicodedata

from pyspark.sql import SparkSession
from pyspark.sql import functions as F


def normalize(text: str | None, form: str) -> str | None:
    return None if text is None else unicodedata.normalize(form, text)


def casefold(text: str | None, form: str) -> str | None:
    return None if text is None else unicodedata.normalize(form, unicodedata.normalize(form, text).casefold())


def jaro_winkler(a: str | None, b: str | None) -> float | None:
    """Similarity from 0 to 1; a common prefix of up to four characters raises it by a tenth each of what is missing."""
    if a is None or b is None:
        return None
    if a == b:
        return 1.0
    reach = max(len(a), len(b)) // 2 - 1
    taken, matched = [False] * len(b), []
    for i, c in enumerate(a):
        for j in range(max(0, i - reach), min(len(b), i + reach + 1)):
            if not taken[j] and b[j] == c:
                taken[j] = True
                matched.append(c)
                break
    if not matched:
        return 0.0
    other = [c for j, c in enumerate(b) if taken[j]]
    swaps = sum(x != y for x, y in zip(matched, other)) / 2
    m = len(matched)
    jaro = (m / len(a) + m / len(b) + (m - swaps) / m) / 3
    prefix = next((k for k in range(min(4, len(a), len(b))) if a[k] != b[k]), min(4, len(a), len(b)))
    return jaro + prefix * 0.1 * (1 - jaro)


def register(spark: SparkSession) -> None:
    spark.udf.register("normalize_text", F.udf(normalize, "string", useArrow=True))
    spark.udf.register("casefold_text", F.udf(casefold, "string", useArrow=True))
    spark.udf.register("jaro_winkler", F.udf(lambda a, b: None if (x := jaro_winkler(a, b)) is None else round(100 * x), "double", useArrow=True))
