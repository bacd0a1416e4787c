"""Scalar functions as columns: geography, time, text, arrays."""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

EARTH_KM = 6371.0088


def bound(value: Column, f) -> Column:
    """f of the value, which is computed once: an expression inside a lambda is computed again for every element."""
    return F.transform(F.array(value), f)[0]


def haversine_km(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    p, q = F.radians(lat1), F.radians(lat2)
    a = F.sin((q - p) / 2) ** 2 + F.cos(p) * F.cos(q) * F.sin(F.radians(lon2 - lon1) / 2) ** 2
    return 2 * EARTH_KM * F.asin(F.sqrt(F.least(F.greatest(a, F.lit(0.0)), F.lit(1.0))))


def bearing_deg(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    p, q, d = F.radians(lat1), F.radians(lat2), F.radians(lon2 - lon1)
    return F.pmod(F.degrees(F.atan2(F.sin(d) * F.cos(q), F.cos(p) * F.sin(q) - F.sin(p) * F.cos(q) * F.cos(d))) + 360, F.lit(360.0))


def grid_km(lat1: Column, lon1: Column, lat2: Column, lon2: Column, rotation_deg: float = 29.0) -> Column:
    """Street-grid distance: the two legs along axes turned by the rotation."""
    r = math.radians(rotation_deg)
    north = F.radians(lat2 - lat1) * EARTH_KM
    east = F.radians(lon2 - lon1) * F.cos(F.radians((lat1 + lat2) / 2)) * EARTH_KM
    return F.abs(east * math.cos(r) + north * math.sin(r)) + F.abs(north * math.cos(r) - east * math.sin(r))


def time_parts(ts: Column) -> dict[str, Column]:
    minute = F.hour(ts) * 60 + F.minute(ts)
    dow = F.weekday(ts)
    work = dow < 5
    return {
        "hour": F.hour(ts), "dow": dow, "month": F.month(ts), "day_of_year": F.dayofyear(ts), "minute_of_day": minute,
        "weekend": (~work).cast("int"), "am_rush": (work & F.hour(ts).between(7, 9)).cast("int"), "pm_rush": (work & F.hour(ts).between(16, 19)).cast("int"),
        "night": ((F.hour(ts) >= 22) | (F.hour(ts) <= 5)).cast("int"),
        "sin_day": F.sin(2 * math.pi * minute / 1440), "cos_day": F.cos(2 * math.pi * minute / 1440), "sin_week": F.sin(2 * math.pi * dow / 7), "cos_week": F.cos(2 * math.pi * dow / 7),
    }


def hash_form(text: Column) -> Column:
    """Lower case, runs of what is no letter, digit, underscore or space as one space, trimmed."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}_\s]", " "), r"\s+", " "))


def shingles(text: Column, k: int) -> Column:
    """Distinct runs of k words; one of all words where there are fewer."""
    def runs(words: Column) -> Column:
        starts = F.sequence(F.lit(1), F.greatest(F.size(words) - k + 1, F.lit(1)))
        return F.array_distinct(F.transform(starts, lambda i: F.array_join(F.slice(words, i, k), " ")))

    return bound(F.split(text, " "), runs)


def class_counts(text: Column) -> dict[str, Column]:
    left = lambda pattern: F.length(text) - F.length(F.regexp_replace(text, pattern, ""))
    return {"letters": left(r"\p{L}"), "digits": left(r"\p{Nd}"), "spaces": left(r"[ \t\n\x0b\f\r]"), "chars": F.length(text)}


def normalised_tags(tags: Column) -> Column:
    """Without # and blanks at the ends, at most 32 characters, the first of those that differ in case only, none empty."""
    clean = F.filter(F.transform(tags, lambda t: F.substring(F.trim(F.regexp_replace(F.trim(t), "^#+", "")), 1, 32)), lambda t: F.length(t) > 0)
    return bound(clean, lambda c: F.filter(c, lambda t, i: F.array_position(F.transform(c, F.lower), F.lower(t)) == i + 1))


def problems(rules: Mapping[str, Column]) -> Column:
    """Names of the rules that a row breaks; a null counts as broken."""
    return F.array_compact(F.array(*[F.when(~F.coalesce(ok, F.lit(False)), F.lit(n)) for n, ok in rules.items()]))


def readability(text: Column) -> dict[str, Column]:
    """Sentences, words, syllables (runs of vowels, at least one a word) and Flesch reading ease."""
    words = F.regexp_extract_all(text, F.lit(r"\p{L}+"), F.lit(0))
    sentences = F.greatest(F.size(F.regexp_extract_all(text, F.lit(r"[.!?]+"), F.lit(0))), F.lit(1))
    vowels = F.aggregate(F.transform(words, lambda w: F.greatest(F.size(F.regexp_extract_all(F.lower(w), F.lit("[aeiouyáéíóúàèêäöü]+"), F.lit(0))), F.lit(1))), F.lit(0), lambda s, x: s + x)
    n = F.greatest(F.size(words), F.lit(1))
    return {"sentences": sentences, "words": F.size(words), "syllables": vowels, "ease": 206.835 - 1.015 * n / sentences - 84.6 * vowels / n}


def pattern_hits(text: Column, patterns: Mapping[str, str]) -> Column:
    """Array of term, count, first position and 40 characters around it, for the patterns that are in the text."""
    def of(name, p):
        at = F.regexp_instr(text, F.lit(p))
        return F.when(at > 0, F.struct(F.lit(name).alias("term"), F.size(F.regexp_extract_all(text, F.lit(p), F.lit(0))).alias("n"), at.alias("at"), F.substring(text, F.greatest(at - 20, F.lit(1)), F.lit(40)).alias("context")))
    return F.array_compact(F.array(*[of(n, p) for n, p in patterns.items()]))


def token_estimate(text: Column) -> Column:
    """About 4 characters a token in prose and 3 in code (many braces, semicolons or equals signs)."""
    marks = F.length(text) - F.length(F.translate(text, "{};=()", ""))
    return F.ceil(F.length(text) / F.when(marks * 20 > F.length(text), 3.0).otherwise(4.0)).cast("long")


def chunks(text: Column, size: int, overlap: int, least: int) -> Column:
    """Array of (at, words) windows of a text, of size words with that overlap; the last may be shorter but not under least."""
    def parts(words: Column) -> Column:
        starts = F.sequence(F.lit(0), F.greatest(F.size(words) - 1, F.lit(0)), F.lit(size - overlap))
        cut = F.transform(starts, lambda s: F.struct(s.alias("at"), F.slice(words, s + 1, size).alias("words")))
        return F.filter(cut, lambda p: F.size(p["words"]) >= least)

    return bound(F.filter(F.split(text, r"\s+"), lambda w: w != ""), parts)


def label_pairs(columns: Sequence[str]) -> Column:
    return F.concat_ws("; ", *[F.concat(F.lit(f"{c}="), F.col(c).cast("string")) for c in columns])


def sections(text: Column) -> Column:
    """Array of (title, body): what follows each line that begins with #, the first without a title called (preamble)."""
    def part(p: Column, i: Column) -> Column:
        line = F.substring_index(p, "\n", 1)
        body = F.when(i == 0, p).otherwise(F.substr(p, F.length(line) + 2))
        return F.struct(F.when(i == 0, "(preamble)").otherwise(F.btrim(line)).alias("title"), body.alias("body"))

    return F.transform(F.split(F.concat(F.lit("\n"), text), r"\n#+"), part)


def cited_chunks(key: Column, text: Column, size: int = 160, overlap: int = 24, least: int = 20) -> Column:
    """Array of (id, section, text): windows of the words of each section, named key#section#number, with the section's title before them.

    A window that only repeats the end of the one before it is left out.
    """
    def of(s: Column) -> Column:
        n = F.size(F.filter(F.split(s["body"], r"\s+"), lambda w: w != ""))
        kept = F.filter(chunks(s["body"], size, overlap, least), lambda c: (c["at"] == 0) | (c["at"] + overlap < n))
        return F.transform(kept, lambda c: F.struct(F.concat_ws("#", key.cast("string"), s["title"], (c["at"] / (size - overlap)).cast("int").cast("string")).alias("id"), s["title"].alias("section"), F.concat(s["title"], F.lit(". "), F.array_join(c["words"], " ")).alias("text")))

    return F.flatten(F.transform(sections(text), of))


def reading_grade(text: Column) -> Column:
    """Struct of sentences, words, syllables, Flesch reading ease (0 to 100) and school grade (1 or more); null without a word or sentence.

    Words are runs of ASCII letters, apostrophes and hyphens. A word has a syllable for each run of vowels, without a last e that no l precedes, and at least one.
    """
    def syllables(w: Column) -> Column:
        low = F.lower(w)
        silent = (low.endswith("e") & ~low.endswith("le")).cast("int")
        return F.greatest(F.size(F.regexp_extract_all(low, F.lit("[aeiouy]+"), F.lit(0))) - silent, F.lit(1))

    def counted(words: Column) -> Column:
        said = F.aggregate(words, F.lit(0), lambda total, w: total + syllables(w))
        ended = F.size(F.filter(F.split(text, r"[.!?]+"), lambda s: F.btrim(s, F.lit(" \t\n\x0b\x0c\r")) != ""))
        return F.struct(ended.alias("sentences"), F.size(words).alias("words"), said.alias("syllables"))

    def graded(c: Column) -> Column:
        length, weight = c["words"] / c["sentences"], c["syllables"] / c["words"]
        ease = F.greatest(F.least(206.835 - 1.015 * length - 84.6 * weight, F.lit(100.0)), F.lit(0.0))
        return F.when((c["words"] > 0) & (c["sentences"] > 0), F.struct(c["sentences"].alias("sentences"), c["words"].alias("words"), c["syllables"].alias("syllables"), ease.alias("ease"), F.greatest(0.39 * length + 11.8 * weight - 15.59, F.lit(1.0)).alias("grade")))

    return bound(bound(F.regexp_extract_all(text, F.lit(r"(?U)\b[a-zA-Z'-]+\b"), F.lit(0)), counted), graded)
