"""Scores, buckets and outcomes as columns, and SimHash."""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

# Outcomes by the first hint that an error's lower-cased text contains, in this order.
ERROR_HINTS = {
    "TIMEOUT": ("timed out", "timeout"),
    "ENCRYPTED": ("encrypted", "password required", "is encrypted"),
    "PASSWORD_REQUIRED": ("password", "locked"),
    "MALFORMED": ("corrupt", "malformed", "cannot", "invalid", "damaged", "bad ", "startxref", "not a zip file", "not a valid", "truncated", "eof marker", "bad xref", "missing xref"),
    "UNSUPPORTED_DEPENDENCY": ("dependency", "not installed", "unavailable", "no backend", "missing"),
    "UNSUPPORTED_FORMAT": ("no suitable extractor", "unsupported", "not supported"),
    "RESOURCE_LIMIT": ("too large", "exceeds", "limit"),
    "NO_TEXT": ("no text", "empty"),
}
RETRYABLE = ("TIMEOUT", "TRANSIENT_ERROR", "UNSUPPORTED_DEPENDENCY", "OCR_FAILED")

# Patterns of monetary amounts, matched without regard to case.
AMOUNTS = (r"\b\d{1,3}[.,]\d{3}(?:[.,]\d{2})?\s*(?:€|EUR|USD|\$)", r"€\s*\d{1,3}[.,]\d{3}", r"\b\d{4,6}\s*(?:euros?|dollars?)")


def error_outcome(error: Column) -> Column:
    """PERMANENT_ERROR if there is no error text or no hint fits."""
    low, out = F.lower(F.coalesce(error, F.lit(""))), F.lit("PERMANENT_ERROR")
    for outcome, hints in reversed(ERROR_HINTS.items()):
        found = F.lit(False)
        for h in hints:
            found = found | F.contains(low, F.lit(h))
        out = F.when(found, F.lit(outcome)).otherwise(out)
    return out


def backoff_seconds(attempts: Column) -> Column:
    """60 seconds, five times as many after each attempt, an hour at most."""
    return F.least(F.lit(3600.0), 60 * F.pow(F.lit(5.0), F.greatest(attempts, F.lit(1)) - 1)).cast("long")


def retryable(outcome: Column, attempts: Column, most: int = 3) -> Column:
    return outcome.isin(*RETRYABLE) & (attempts < most)


def amounts(text: Column) -> Column:
    """Monetary amounts, pattern by pattern."""
    return F.concat(*[F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(f"(?i)({p})"), 1) for p in AMOUNTS])


def recency(days: Column) -> Column:
    return F.exp(-days / 365)


def centrality(degree: Column) -> Column:
    return F.least(F.lit(1.0), F.log(1 + degree) / F.log(F.lit(21.0)))


def iso_week(at: Column) -> Column:
    """Year of the week and its number, as 2024-W01."""
    return F.concat(F.extract(F.lit("yearofweek"), at).cast("string"), F.lit("-W"), F.lpad(F.weekofyear(at).cast("string"), 2, "0"))


def text_score(query: str, name: Column, text: Column) -> Column:
    """1 if the name holds the query, and ten times its occurrences a word, 1 at most."""
    low = F.lower(F.coalesce(text, F.lit("")))
    found = (F.length(low) - F.length(F.replace(low, F.lit(query.lower())))) / len(query)
    words = F.size(F.regexp_extract_all(low, F.lit(r"([^\x20\x09-\x0D]+)"), 1))
    return F.when(F.contains(F.lower(name), F.lit(query.lower())), 1.0).otherwise(0.0) + F.when(words > 0, F.least(F.lit(1.0), 10 * found / words)).otherwise(0.0)


def shingles(words: Column, k: int = 4) -> Column:
    """Distinct runs of k tokens; all tokens as one run when there are fewer; empty without tokens."""
    n = F.size(words)
    runs = F.transform(F.sequence(F.lit(0), F.greatest(n - k, F.lit(0))), lambda i: F.array_join(F.slice(words, i + 1, F.lit(k)), " "))
    return F.when(n == 0, F.array().cast("array<string>")).otherwise(F.array_distinct(runs))


def simhash_of(runs) -> int:
    """64 bits, signed: a bit is set when more of the runs' 8-byte BLAKE2b digests have it than not."""
    digests = b"".join(hashlib.blake2b(r.encode("utf-8", "surrogatepass"), digest_size=8).digest() for r in runs)
    if not digests:
        return 0
    bits = np.unpackbits(np.frombuffer(digests, np.uint8).reshape(-1, 8), axis=1)
    votes = 2 * bits.sum(0, dtype=np.int64) - len(bits)
    return int(np.packbits(votes > 0).view(">i8")[0])


@F.pandas_udf(LongType())
def simhash64(runs: pd.Series) -> pd.Series:
    return pd.Series([simhash_of(x if x is not None else ()) for x in runs], dtype="int64")


def hamming(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b))


def band_keys(value: Column, bands: int = 4) -> Column:
    """The hash in equal bands, low bits first."""
    width = 64 // bands
    return F.array(*[F.shiftrightunsigned(value, width * i).bitwiseAND((1 << width) - 1) for i in range(bands)])
