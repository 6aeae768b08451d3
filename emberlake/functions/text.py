"""Text functions as columns."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from emberlake.model import ALIASES, CONFIDENCE_CEILINGS, INTENTS, NEGATIONS


def normalised(name: Column) -> Column:
    """Lower case, trimmed, white space collapsed."""
    return F.trim(F.regexp_replace(F.lower(name), r"\s+", " "))


def literal_map(entries: dict) -> Column:
    return F.create_map(*[F.lit(x) for pair in entries.items() for x in pair])


def canonical(name: Column) -> Column:
    """The canonical name of an alias, else the normalised name."""
    flat = {alias: whole for whole, aliases in ALIASES.items() for alias in aliases}
    plain = normalised(name)
    return F.coalesce(F.try_element_at(literal_map(flat), plain), plain)


def capped_confidence(confidence: Column, source: Column) -> Column:
    """Confidence under its source's ceiling; unknown sources pass."""
    return F.least(confidence, F.coalesce(F.try_element_at(literal_map(CONFIDENCE_CEILINGS), source), confidence))


def intent_words(text: Column) -> Column:
    """The key words of intents that stand in a text, as whole words, in one pass over it. No key word hides another."""
    every = "|".join(w for words in INTENTS.values() for w in words)
    return F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit(rf"\b({every})\b"), F.lit(1)))


def intent_hits(found: Column, intent: str) -> Column:
    """How many of an intent's key words are among those found."""
    return F.size(F.array_intersect(found, F.array(*[F.lit(w) for w in INTENTS[intent]])))


def words(text: Column) -> Column:
    return F.filter(F.split(F.lower(text), r"\s+"), lambda w: w != "")


def tokens(text: Column) -> Column:
    """Search terms: runs of a-z and 0-9 of the lower-cased text."""
    return F.array_remove(F.split(F.lower(text), "[^a-z0-9]+"), "")


def keywords(event_type: Column, tool_name: Column) -> Column:
    parts = F.filter(F.split(event_type, r"\."), lambda x: x != "")
    return F.when(tool_name.isNotNull(), F.concat(parts, F.array(tool_name))).otherwise(parts)


def quote_supported(quote: Column, text: Column) -> Column:
    """Whether a quote stands in a text: as a substring, or by three fifths of its words longer than three letters."""
    plain_quote, plain_text = normalised(quote), normalised(text)
    long_words = F.array_distinct(F.filter(F.split(plain_quote, " "), lambda w: F.length(w) > 3))
    shared = F.size(F.array_intersect(long_words, F.split(plain_text, " ")))
    filled = (F.coalesce(quote, F.lit("")) != "") & (F.coalesce(text, F.lit("")) != "")
    return filled & (F.contains(plain_text, plain_quote) | ((F.size(long_words) > 0) & (shared >= 0.6 * F.size(long_words))))


def quote_window(quote: Column, text: Column, least: float = 0.6) -> Column:
    """Whether a stretch of a text as long as the quote is like it by matching blocks, in steps of a quarter of its length; for quotes that aren't supported otherwise."""
    from difflib import SequenceMatcher


    @F.pandas_udf("boolean")
    def like(quotes: pd.Series, texts: pd.Series) -> pd.Series:
        def one(q: str | None, t: str | None) -> bool:
            if not q or not t:
                return False
            n = len(q)
            starts = range(0, len(t) - n + 1, max(1, n // 4)) if n <= len(t) else [0]
            near = SequenceMatcher(None, "", q)
            for k in starts:
                near.set_seq1(t[k : k + n] if n <= len(t) else t)
                if near.real_quick_ratio() >= least and near.quick_ratio() >= least and SequenceMatcher(None, q, near.a).ratio() >= least:
                    return True
            return False

        return pd.Series([one(q, t) for q, t in zip(quotes, texts, strict=True)], dtype=bool)

    open_ones = F.when(~quote_supported(quote, text), normalised(quote))
    return like(open_ones, F.when(open_ones.isNotNull(), normalised(text)))


def inline_payload(payload_ref: Column) -> Column:
    """The JSON object that a payload reference holds itself, as text; null where it is a reference or broken."""
    return F.when(F.startswith(F.trim(payload_ref), F.lit("{")) & (F.schema_of_variant(F.try_parse_json(payload_ref)).startswith("OBJECT")), payload_ref)


def entailed(claim: Column, evidence: Column) -> Column:
    """Whether evidence supports a claim: the same polarity, and half of the claim's words longer than two letters."""
    of = lambda c: F.split(normalised(c), " ")
    negative = lambda c: F.arrays_overlap(of(c), F.array(*[F.lit(x) for x in NEGATIONS]))
    long = lambda c: F.array_distinct(F.filter(of(c), lambda w: F.length(w) > 2))
    enough = F.size(F.array_intersect(long(claim), long(evidence))) >= 0.5 * F.size(long(claim))
    filled = (F.coalesce(claim, F.lit("")) != "") & (F.coalesce(evidence, F.lit("")) != "")
    return filled & (negative(claim) == negative(evidence)) & ((F.size(long(claim)) < 2) | (F.size(long(evidence)) == 0) | enough)


def cursor(us: Column, event_id: Column) -> Column:
    """An opaque page cursor: URL-safe base 64 of time and id."""
    return F.translate(F.base64(F.encode(F.concat_ws("|", us.cast("string"), event_id), "UTF-8")), "+/", "-_")


def cursor_parts(value: Column) -> Column:
    """(us, event_id) of a cursor; nulls if it is malformed."""
    plain = F.decode(F.try_to_binary(F.translate(value, "-_", "+/"), F.lit("base64")), "UTF-8")
    return F.struct(F.split_part(plain, F.lit("|"), F.lit(1)).try_cast("long").alias("us"), F.split_part(plain, F.lit("|"), F.lit(2)).alias("event_id"))


def safe_path_parameter(value: Column) -> Column:
    """Whether a value can stand in a path: filled, short, without control, escape, traversal or invisible characters."""
    bad = F.regexp_like(value, F.lit(r"[\x00\r\n%​-‏ -‮⁠﻿]|\.\.|/|\\"))
    return F.coalesce((F.length(value) > 0) & (F.length(value) <= 256) & ~bad, F.lit(False))


#: The most characters of an error that is shown. Fixed value.
ERROR_LENGTH = 500


def redacted(text: Column) -> Column:
    """Credentials in log lines, hidden: what follows their names, and addresses of stores."""
    named = F.regexp_replace(text, r"(?i)((?:api[_-]?key|token|password|secret|authorization)\s*[=:]\s*)\S+", "$1***")
    return F.regexp_replace(named, r"(?i)\b(redis|neo4j|postgres|mysql)://\S+", "$1://***")


def shown_error(message: Column) -> Column:
    """An error as a caller may see it: without credentials, cut at ERROR_LENGTH characters."""
    plain = redacted(message)
    return F.when(F.length(plain) > ERROR_LENGTH, F.concat(F.left(plain, F.lit(ERROR_LENGTH)), F.lit("..."))).otherwise(plain)


def offset_cursor(offset: Column) -> Column:
    """An opaque cursor of a number: URL-safe base 64."""
    return F.translate(F.base64(offset.cast("string").cast("binary")), "+/", "-_")


def offset_of(cursor: Column) -> Column:
    """The number in a cursor; 0 where there is none, it is broken or negative."""
    plain = F.decode(F.try_to_binary(F.translate(cursor, "-_", "+/"), F.lit("base64")), "UTF-8")
    return F.greatest(F.lit(0), F.coalesce(plain.try_cast("long"), F.lit(0)))
