"""Extractors of ages from captions, by name, each a DataFrame function; free-text replies go through a table function.

An extractor takes rows with ``id``, ``caption`` and ``n_photos`` (and ``reply`` for those that read one) and returns id, place (from 0), age,
reference, source and confidence, one row for each age found.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql.functions import udtf

from millrace.functions import text as T
from millrace.session import staged

EXTRACTORS: dict[str, Callable[..., DataFrame]] = {}
COLUMNS = ("id", "place", "age", "reference", "source", "confidence")


def extractor(name: str):
    def add(f):
        EXTRACTORS[name] = f
        return f

    return add


def extract(kind: str, rows: DataFrame, **options) -> DataFrame:
    """The rows of the extractor of that name; ValueError for an unknown name."""
    if kind.lower() not in EXTRACTORS:
        raise ValueError(f"unknown extractor {kind!r}, one of {', '.join(sorted(EXTRACTORS))}")
    return EXTRACTORS[kind.lower()](rows, **options).select(*COLUMNS)


@extractor("regex")
def by_rules(rows: DataFrame) -> DataFrame:
    """The rule cascade, in columns; two ages or more count for less than one."""
    # the cascade is named once only: it is long, and each mention would be worked out again
    listed = F.transform(F.array(T.age_anchors(F.col("caption"), F.col("n_photos"))), lambda x: F.transform(x, lambda a, i: F.struct(i.alias("place"), a.alias("age"), F.size(x).alias("n"))))
    each = rows.select("id", "n_photos", F.inline(F.flatten(listed)))
    sure = F.when(F.col("n") == 1, 0.6).when(F.col("n") == F.col("n_photos"), 0.85).otherwise(0.4)
    reference = F.when(F.col("n") == F.col("n_photos"), F.concat(F.lit("position_"), F.col("place"))).otherwise("unknown")
    return each.select("id", "place", "age", reference.alias("reference"), F.lit("caption_regex").alias("source"), sure.alias("confidence"))


@udtf(returnType="place int, age int, reference string, confidence double")
class ReplyAges:
    """The entries of the first JSON array of objects in a free-text reply: a caption's ages as a language model states them.

    Balanced brackets are no regular language, so this runs row by row; everything SQL can say stays in columns.
    """

    def eval(self, reply: str) -> Iterator[tuple[int, int, str, float]]:
        place = 0
        for entry in self._entries(reply or ""):
            age = str(entry.get("age"))
            if re.fullmatch(r"[0-9]{1,2}", age) and 1 <= int(age) <= 99:
                sure = entry.get("confidence")
                sure = 0.6 if isinstance(sure, bool) or not isinstance(sure, (int, float)) else min(1.0, max(0.0, float(sure)))
                yield place, int(age), str(entry.get("ref") or "unknown").strip().lower(), sure
                place += 1

    @staticmethod
    def _entries(reply: str) -> list[dict]:
        decoder = json.JSONDecoder()
        for m in re.finditer(r"\[", reply):
            try:
                got, _ = decoder.raw_decode(reply, m.start())
            except (ValueError, RecursionError):
                continue
            if isinstance(got, list) and all(isinstance(x, dict) for x in got):
                return got
        return []


@extractor("reply")
def by_reply(rows: DataFrame) -> DataFrame:
    """What the row's ``reply`` states, by a lateral call of the table function."""
    got = rows.select("id", "reply").lateralJoin(ReplyAges(F.col("reply").outer()))
    return got.select("id", "place", "age", "reference", F.lit("reply").alias("source"), "confidence")


@extractor("combined")
def by_both(rows: DataFrame, sure: float = 0.8) -> DataFrame:
    """The rules where they are sure, else the reply, else the rules after all."""
    rules, reply = staged(by_rules(rows), "rules"), by_reply(rows)
    enough = rules.where(F.col("confidence") >= sure).select("id").distinct()
    other = reply.join(enough, "id", "left_anti")
    return rules.join(other.select("id").distinct(), "id", "left_anti").unionByName(other)


@extractor("cached")
def by_cache(rows: DataFrame, cache: DataFrame, fallback: str = "regex", metrics: Observation | None = None) -> DataFrame:
    """Entries of ``cache`` (caption, n_photos, entries: array of place, age, reference, source, confidence) for equal trimmed captions and numbers of photos; on a miss the fallback's.

    ``metrics``, if given, holds hits and misses after the action that uses the result.
    """
    c = cache.select(F.trim("caption").alias("_caption"), F.col("n_photos").alias("_n"), "entries", F.lit(True).alias("_hit")).dropDuplicates(["_caption", "_n"])
    seen = rows.join(c, (F.trim(F.coalesce("caption", F.lit(""))) == F.col("_caption")) & F.col("n_photos").eqNullSafe(F.col("_n")), "left")
    if metrics is not None:
        seen = seen.observe(metrics, F.count_if(F.col("_hit")).alias("hits"), F.count_if(F.col("_hit").isNull()).alias("misses"))
    # one pass: what the cache has and what the rules find side by side, so that the counts come from the pass that writes
    if fallback != "regex":
        missed = EXTRACTORS[fallback](seen.where("_hit is null"))
        return seen.where("_hit").select("id", F.inline("entries")).select(*COLUMNS).unionByName(missed.select(*COLUMNS))
    ages = T.age_anchors(F.col("caption"), F.col("n_photos"))
    found = F.transform(ages, lambda a, i: F.struct(i.alias("place"), a.alias("age"), F.lit("unknown").alias("reference"), F.lit("caption_regex").alias("source"), F.lit(0.4).cast("double").alias("confidence")))
    return seen.select("id", F.inline(F.when(F.col("_hit"), F.col("entries")).otherwise(found))).select(*COLUMNS)
