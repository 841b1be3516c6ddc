"""Text functions of the news pipeline, as Column expressions; pandas only where Spark has no built-in (NFKD, FNV)."""

from __future__ import annotations

import unicodedata

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Words that carry no topic.
STOP_WORDS = (
    "the", "and", "for", "with", "from", "that", "this", "their", "there",
    "into", "over", "after", "before", "once", "again", "since", "than", "then",
    "was", "were", "are", "has", "have", "had", "its", "his", "her", "will",
    "not", "but", "all", "any", "new", "now", "out", "off", "own", "per",
    "says", "said", "say", "amid", "also", "more", "most", "some", "such",
    "who", "why", "how", "what", "when", "where", "which", "while", "you",
)
#: Query parameters that only track.
TRACKING = (
    "utm_source", "utm_medium", "utm_campaign", "utm_term", "utm_content", "utm_id",
    "fbclid", "gclid", "msclkid", "mc_cid", "mc_eid", "ref", "source", "cmpid", "s_cid",
)


@F.pandas_udf(T.StringType())
def _decomposed(text: pd.Series) -> pd.Series:
    """NFKD without combining marks."""
    return text.map(lambda s: None if s is None else "".join(c for c in unicodedata.normalize("NFKD", s) if not unicodedata.combining(c)))


def normalize_ascii(text: Column) -> Column:
    """Lower case, runs of other characters than letters and digits to one space, trimmed."""
    return F.trim(F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}]+", " "))


def normalize(text: Column) -> Column:
    """``normalize_ascii`` after taking marks off letters; only texts with other than ASCII characters leave the JVM."""
    return normalize_ascii(F.when(text.rlike(r"[^\x00-\x7F]"), _decomposed(F.when(text.rlike(r"[^\x00-\x7F]"), text))).otherwise(text))


def stem(token: Column) -> Column:
    """First suffix that leaves four characters or more: ies to y, ing, ed, es, s."""
    n = F.length(token)
    out = F.when(token.endswith("ies") & (n >= 7), F.concat(F.left(token, n - 3), F.lit("y")))
    for suffix in ("ing", "ed", "es", "s"):
        out = out.when(token.endswith(suffix) & (n >= 4 + len(suffix)), F.left(token, n - len(suffix)))
    return out.otherwise(token)


def tokens(normalized: Column) -> Column:
    """Distinct stems in order, of words of three characters or more that aren't stop words."""
    words = F.filter(F.split(normalized, " "), lambda w: (F.length(w) >= 3) & ~w.isin(*STOP_WORDS))
    return F.array_distinct(F.transform(words, stem))


def jaccard(a: Column, b: Column) -> Column:
    """Shared share of two sets; 0 if either is empty."""
    either = F.size(F.array_union(a, b))
    return F.when((F.size(a) == 0) | (F.size(b) == 0), 0.0).otherwise(F.size(F.array_intersect(a, b)) / either)


@F.pandas_udf(T.LongType())
def simhash64(tokens: pd.Series) -> pd.Series:
    """Sign of the sum of 64-bit FNV-1a bits over a token set; 0 for none."""
    shift = np.arange(64, dtype=np.uint64)

    def one(words) -> int:
        if words is None or not len(words):
            return 0
        raw = [w.encode() for w in words]
        h = np.full(len(raw), 0xCBF29CE484222325, np.uint64)
        for k in range(max(map(len, raw))):
            on = np.array([k < len(r) for r in raw])
            byte = np.array([r[k] if k < len(r) else 0 for r in raw], np.uint64)
            h = np.where(on, (h ^ byte) * np.uint64(0x100000001B3), h)
        votes = 2 * ((h[:, None] >> shift) & np.uint64(1)).astype(np.int64).sum(0) - len(raw)
        return int(((votes > 0).astype(np.uint64) << shift).sum(dtype=np.uint64).astype(np.int64))

    return tokens.map(one)


def hamming(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b))


def content_hash(title: Column, body: Column) -> Column:
    return F.sha2(normalize(F.concat_ws(" ", title, F.coalesce(body, F.lit("")))), 256)


def similarity_text(title: Column, summary: Column) -> Column:
    """Title and summary, where there is one that isn't blank."""
    return F.concat_ws(" ", title, F.when(F.trim(summary) != "", summary))


def canonical_url(url: Column) -> Column:
    """Lower-case scheme (https if none) and host without www., decoded path and query; no port, fragment, slash at the end of a
    longer path, or tracking parameters; parameters sorted. What isn't a URL comes back trimmed."""
    url = F.trim(url)
    part = lambda what: F.try_parse_url(url, F.lit(what))
    decoded = lambda c: F.try_url_decode(F.replace(F.coalesce(c, F.lit("")), F.lit("+"), F.lit("%2B")))
    host = F.regexp_replace(F.lower(F.coalesce(part("HOST"), F.lit(""))), r"^www\.", "")
    path = F.regexp_replace(decoded(part("PATH")), "(?<=.)/$", "")
    kept = F.filter(F.split(decoded(part("QUERY")), "&"), lambda p: (F.trim(p) != "") & ~F.lower(F.substring_index(p, "=", 1)).isin(*TRACKING))
    query = F.array_join(F.array_sort(kept), "&")
    built = F.concat(F.coalesce(F.lower(part("PROTOCOL")), F.lit("https")), F.lit("://"), host, path, F.when(query != "", F.concat(F.lit("?"), query)).otherwise(F.lit("")))
    return F.when(F.coalesce(part("PATH"), part("PROTOCOL")).isNotNull(), F.coalesce(built, url)).otherwise(url)


def truncate(text: Column, most: int, marker: str = "") -> Column:
    return F.when(F.length(text) > most, F.concat(F.left(text, F.lit(most)), F.lit(marker))).otherwise(text)


def extract_json(text: Column) -> Column:
    """From the first { to the last }, code fences taken off; null if there is none."""
    found = F.regexp_extract(text, r"(?s)\{.*\}", 0)
    return F.when(found != "", found)


def entity_ids(names: Column, prefix: str) -> Column:
    """Upper case, ASSET: taken off, 2-10 capitals or digits kept, distinct, prefixed."""
    clean = F.transform(names, lambda x: F.regexp_replace(F.upper(F.trim(x)), "^ASSET:", ""))
    return F.transform(F.array_distinct(F.filter(clean, lambda x: x.rlike("^[A-Z0-9]{2,10}$"))), lambda x: F.concat(F.lit(prefix), x))


def external_id(*parts: Column | str) -> Column:
    return F.concat_ws(":", *(F.lit(p) if isinstance(p, str) else p for p in parts))


def display_name(external: Column) -> Column:
    """What follows the first colon, or all of it."""
    return F.when(external.contains(":"), F.regexp_replace(external, "^[^:]*:", "")).otherwise(external)


def split_symbol(symbol: Column) -> Column:
    """struct(exchange, symbol, reason) of EXCH:SYM."""
    parts = F.split(symbol, ":", 2)
    ok = F.coalesce(symbol.rlike("^[^:]+:.+$"), F.lit(False))
    return F.struct(F.when(ok, parts[0]).alias("exchange"), F.when(ok, F.try_element_at(parts, F.lit(2))).alias("symbol"), F.when(~ok, F.lit("not EXCHANGE:SYMBOL")).alias("reason"))


def call_cost(input_tokens: Column, cached: Column, output_tokens: Column, prices: tuple[str, str, str] = ("0.15", "0.075", "0.60")) -> Column:
    """Cost of a model call at prices per million fresh input, cached input and output tokens, to 8 places half up."""
    fresh, cache, out = (F.lit(p).cast("decimal(12,6)") for p in prices)
    d = lambda c: c.cast("decimal(18,0)")
    return F.round((d(input_tokens - cached) * fresh + d(cached) * cache + d(output_tokens) * out) / F.lit(1_000_000).cast("decimal(8,0)"), 8).cast("decimal(20,8)")
