"""Text functions: number anchors in captions, features, chunking, JSON replies, identifiers."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# Phrases that state how old somebody looks, and the ages that captions state, in Russian and English.
APPARENT_AGE = (
    r"выгляд\w+\s+на\s+(\d{1,2})", r"да[лheё]\w*\s+бы\s+(?:лет\s+)?(\d{1,2})", r"на\s+вид\s+(?:лет\s+)?(\d{1,2})",
    r"максимум\s+(\d{1,2})", r"не\s+больше\s+(\d{1,2})", r"не\s+дашь?\s+(?:и\s+)?(\d{1,2})",
)
LEFT_AGE, RIGHT_AGE = r"слев[ае]\D{0,15}?(\d{1,2})", r"справ[ае]\D{0,15}?(\d{1,2})"
ORDERED_AGES = r"в\s*(\d{1,2})\b\D{0,25}?(?:и|,)\s*(?:сейчас\s*)?(?:в|мне)\s*(\d{1,2})\b"
AGE_UNIT, AGE_BARE = r"(\d{1,2})\s*(?:лет|год(?:а|ик|иков)?)(?!\s*назад)", r"(?:мне|в)\s*(?:было\s*)?(\d{1,2})\b"
YEAR, DURATION = r"\b(?:19|20)\d{2}\b", r"\b\d{1,3}\s*(?:years?|yrs?|yr|y/?o)\b(?:\s*ago)?"
CONNECTOR, AGED = r"\b(?:to|and|vs)\b|[-–—/&]", r"\b(?:aged?|at)\s+(\d{1,2})\b"
# Additions of our own: English phrases beside the Russian ones. A number of years is an age only if it says 'old'.
ENGLISH_APPARENT = (r"\blooks? (?:about |around )?(\d{1,2})\b", r"\b(\d{1,2}) years old\b", r"\bage (\d{1,2})\b")
ENGLISH_LEFT, ENGLISH_RIGHT = r"\bleft[^0-9]{0,12}(\d{1,2})\b", r"\bright[^0-9]{0,12}(\d{1,2})\b"
ENGLISH_ORDERED = r"\bin (\d{1,2})\b.*\band in (\d{1,2})\b"
YEARS_OLD = r"\b\d{1,2} years old\b"
SINGLE_AGE = f"{AGE_BARE}|{AGE_UNIT}"
EMOJI = r"[\x{1F300}-\x{1FAFF}\x{2600}-\x{27BF}]"


def slash_sequence(caption: Column, n_photos: Column) -> Column:
    """[a, b, ...] if the whole caption is one- or two-digit numbers joined by slashes, one for each photo, all from 1 to 99; else empty."""
    ages = F.transform(F.split(F.trim(caption), r"\s*/\s*"), lambda x: x.try_cast("int"))
    ok = F.trim(caption).rlike(r"^\d{1,2}(\s*/\s*\d{1,2})+$") & (n_photos >= 2) & (F.size(ages) == n_photos) & F.forall(ages, lambda a: (a >= 1) & (a <= 99))
    return F.when(ok, ages).otherwise(F.array().cast("array<int>"))


def _plain(text: Column) -> Column:
    return F.regexp_replace(F.lower(text), "ё", "е")


def _age(text: Column, pattern: str, group: int = 1) -> Column:
    """The number of the first match, if from 1 to 99; boundaries and digits as Unicode has them."""
    age = F.regexp_extract(text, "(?U)" + pattern, group).try_cast("int")
    return F.when(age.between(1, 99), age)


def _ages(found: Column) -> Column:
    return F.array_distinct(F.filter(F.transform(found, lambda x: x.try_cast("int")), lambda a: a.between(1, 99)))


def left_right(caption: Column) -> Column:
    """[left, right] if both sides are stated; else empty."""
    text = _plain(caption)
    left, right = (F.coalesce(*[_age(text, p) for p in side]) for side in ((LEFT_AGE, ENGLISH_LEFT), (RIGHT_AGE, ENGLISH_RIGHT)))
    return F.when(left.isNotNull() & right.isNotNull(), F.array(left, right)).otherwise(F.array().cast("array<int>"))


def ordered_pair(caption: Column) -> Column:
    """[first, second] of 'in X ... and in Y'; else empty."""
    text, out = _plain(caption), F.array().cast("array<int>")
    for p in (ENGLISH_ORDERED, ORDERED_AGES):
        a, b = _age(text, p), _age(text, p, 2)
        out = F.when(a.isNotNull() & b.isNotNull(), F.array(a, b)).otherwise(out)
    return out


def singles(caption: Column, pattern: str = f"{SINGLE_AGE}|{YEARS_OLD}") -> Column:
    """Distinct ages with a unit or after a word for 'I am' or 'at', in order of place; durations do not count."""
    found = F.regexp_extract_all(_plain(caption), F.lit("(?U)" + pattern), 0)
    return _ages(F.transform(found, lambda x: F.regexp_extract(x, r"(\d{1,2})", 1)))


def age_anchors(caption: Column, n_photos: Column) -> Column:
    """The first rule that finds something wins; a slash list that is not valid finds nothing at all."""
    looks = F.trim(caption).rlike(r"^\d+(\s*/\s*\d+)+$")
    rules = [left_right(caption), ordered_pair(caption), singles(caption, SINGLE_AGE), bracketed_numbers(caption), singles(caption, YEARS_OLD)]
    cascade = F.array().cast("array<int>")
    for r in reversed(rules):
        cascade = F.when(F.size(r) > 0, r).otherwise(cascade)
    return F.when(looks, slash_sequence(caption, n_photos)).otherwise(cascade)


def apparent_ages(text: Column, lo: int = 5, hi: int = 90) -> Column:
    found = F.flatten(F.array(*[F.regexp_extract_all(_plain(text), F.lit("(?U)" + p), 1) for p in (*APPARENT_AGE, *ENGLISH_APPARENT)]))
    return F.filter(_ages(found), lambda a: (a >= lo) & (a <= hi))


def chunks(text: Column, limit: int) -> Column:
    """Word-boundary chunks of at most ``limit`` characters; a longer word is cut."""
    pieces = F.flatten(F.transform(F.filter(F.split(text, r"\s+"), lambda w: w != ""), lambda w: F.regexp_extract_all(w, F.lit("(?s).{1,%d}" % limit), 0)))
    zero = F.struct(F.array().cast("array<string>").alias("done"), F.lit("").alias("open"))

    def step(s, w):
        fits = (F.length(s["open"]) == 0) | (F.length(s["open"]) + 1 + F.length(w) <= limit)
        joined = F.when(F.length(s["open"]) == 0, w).otherwise(F.concat(s["open"], F.lit(" "), w))
        return F.when(fits, F.struct(s["done"].alias("done"), joined.alias("open"))).otherwise(F.struct(F.array_append(s["done"], s["open"]).alias("done"), w.alias("open")))

    return F.aggregate(pieces, zero, step, lambda s: F.when(F.length(s["open"]) > 0, F.array_append(s["done"], s["open"])).otherwise(s["done"]))


REPLY = "array<struct<age:string,ref:string,confidence:double>>"


def reply_anchors(reply: Column) -> Column:
    """Items of the first greedy JSON array in free text: integer ages from 1 to 99, confidence clamped to 0..1 (0.6 if absent)."""
    items = F.from_json(F.regexp_extract(reply, r"(?s)\[.*\]", 0), REPLY)
    ok = F.filter(F.coalesce(items, F.array().cast(REPLY)), lambda x: x["age"].rlike(r"^\d+$") & x["age"].try_cast("int").between(1, 99))
    return F.transform(ok, lambda x: F.struct(x["age"].cast("int").alias("age"), F.lower(F.trim(x["ref"])).alias("ref"), F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(x["confidence"], F.lit(0.6)))).alias("confidence")))


def sanitise(text: Column) -> Column:
    """Identifiers, keys and machine paths masked."""
    for pattern, mark in ((r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+", "<mail>"), (r"(?:/[A-Za-z0-9._-]+){3,}", "<path>"), (r"(?<![0-9A-Za-z_])[0-9a-f]{16,}(?![0-9A-Za-z_])", "<key>"), (r"\d{4,}", "<number>")):
        text = F.regexp_replace(text, pattern, mark)
    return text


def bracketed_numbers(text: Column) -> Column:
    """Distinct ages after four-digit years and durations are struck out: all numbers if a connector or a bracket is there, else those after 'aged' or 'at'."""
    rest = F.regexp_replace(F.regexp_replace(_plain(text), "(?U)" + YEAR, " "), "(?U)" + DURATION, " ")
    every, stated = (F.regexp_extract_all(rest, F.lit("(?U)" + p), 1) for p in (r"\b(\d{1,2})\b", AGED))
    return _ages(F.when(rest.rlike("(?U)" + CONNECTOR) | rest.contains("("), every).otherwise(stated))


def first_object(text: str | None) -> str | None:
    """The first balanced JSON object: braces inside strings don't count, an opening brace that no object follows is passed over."""
    start = (text or "").find("{")
    while start >= 0:
        depth, quoted, skip = 0, False, False
        for i in range(start, len(text)):
            c = text[i]
            if skip:
                skip = False
            elif quoted:
                quoted, skip = c != '"', c == "\\"
            elif c == '"':
                quoted = True
            elif c in "{}":
                depth += 1 if c == "{" else -1
                if not depth:
                    part = text[start : i + 1]
                    try:
                        json.loads(part)
                        return part
                    except ValueError:
                        break
        start = text.find("{", start + 1)
    return None


def balanced_object(text: Column) -> Column:
    """``first_object`` as a column; matching braces is not regular, so this is Python over Arrow batches."""

    @F.pandas_udf("string")
    def find(s: pd.Series) -> pd.Series:
        return s.map(first_object, na_action="ignore")

    return find(text)
