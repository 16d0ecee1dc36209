"""URL filtering by a temporal list join.

A list is a log of dated entries (pattern, action, day): a pattern is a host or a domain that
stands for itself and all hosts below it, an action adds it or removes it.  The log becomes
validity intervals, and each capture is judged by the entries that were active on its day:
the longest active pattern that its host ends with, at a label's border, is the one that counts.

Captures are first reduced to distinct (host, day), so a host that holds a third of all
captures is judged once for each day; the verdicts, one row for each host and day, go back by
a join, broadcast if they are small and else split where a host and day are hot (AQE).  The intervals are broadcast while they are few (``BROADCAST_INTERVALS``,
counted) and joined by a shuffle beyond.

A dot at the end of a host or pattern is not part of it (``bad.org.`` is ``bad.org``); an address in
brackets is a host with its brackets and has no domains above it.

Defined results: an empty table gives no rows, an empty list blocks nothing; a capture without a URL, host or day matches nothing and is not blocked; entries
without pattern, action or day are ignored; of several actions of one pattern on one day a
removal wins; repeated rows are judged alike; extra columns of captures are kept, but that host,
entry, active_from and blocked replace columns of these names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from millrace.llm.common import staged

#: Intervals up to this number are broadcast, under 100 bytes each.
BROADCAST_INTERVALS = 200_000
HOST = r"^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?(\[[^\]/?#]*\]|[^/:?#\[\]]+)"


def host_of(url: Column) -> Column:
    host = undotted(F.regexp_extract(F.lower(url), HOST, 1))
    return F.when(host != "", host)


def undotted(host: Column) -> Column:
    return F.regexp_replace(host, r"\.+$", "")


def suffixes(host: Column) -> Column:
    """A host and the domains above it, the longest first."""
    parts = F.split(host, r"\.")
    above = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "."))
    return F.when(host.startswith("["), F.array(host)).otherwise(above)


def intervals(entries: DataFrame) -> DataFrame:
    """pattern, active_from, active_to (null: still active) of a log of (pattern, action, day)."""
    log = entries.select(undotted(F.lower("pattern")).alias("pattern"), "action", "day").where("pattern <> '' and day is not null and action in ('add', 'remove')")
    log = log.groupBy("pattern", "day").agg(F.max("action").alias("action"))  # 'remove' sorts last
    w = Window.partitionBy("pattern").orderBy("day")
    turns = log.withColumn("before", F.lag("action").over(w)).where("action <> coalesce(before, 'remove')")
    return turns.withColumn("active_to", F.lead("day").over(w)).where("action = 'add'").select("pattern", F.col("day").alias("active_from"), "active_to")


def judge(captures: DataFrame, entries: DataFrame, url: str = "url", day: str = "fetched") -> DataFrame:
    """``captures`` with host, entry (the pattern that counts), active_from and blocked."""
    spans = staged(intervals(entries), "intervals")
    small = F.broadcast(spans) if spans.count() <= BROADCAST_INTERVALS else spans
    c = captures.select(F.struct(*captures.columns).alias("capture"), host_of(F.col(url)).alias("host"), F.col(day).alias("_day"))
    asked = c.where("host is not null and _day is not null").select("host", F.col("_day").alias("_on")).distinct()
    asked = asked.select("host", "_on", F.explode(suffixes(F.col("host"))).alias("pattern"))
    hit = asked.join(small, "pattern").where("active_from <= _on and (active_to is null or _on < active_to)")
    best = hit.groupBy("host", "_on").agg(F.max_by(F.struct("pattern", "active_from"), F.length("pattern")).alias("best"))
    best = best.select(F.col("host").alias("_host"), "_on", F.col("best.pattern").alias("entry"), F.col("best.active_from").alias("active_from"))
    out = c.join(best, (F.col("host") == F.col("_host")) & (F.col("_day") == F.col("_on")), "left")
    kept = [F.col("capture")[x].alias(x) for x in captures.columns if x.lower() not in ("host", "entry", "active_from", "blocked")]
    return out.select(*kept, "host", "entry", "active_from", F.col("entry").isNotNull().alias("blocked"))


def fixture_log(pages: DataFrame) -> DataFrame:
    """A dated list for the test tables, which have none: made from the md5 of their hosts and of the domains above them."""
    hosts = pages.select(host_of(F.col("url")).alias("host")).where("host is not null").distinct()
    p = hosts.select("host").union(hosts.select(F.regexp_extract("host", r"^[^.\[]+\.(.+\..+)$", 1))).where("host <> ''").distinct().withColumnRenamed("host", "pattern")
    h = F.conv(F.substring(F.md5("pattern"), 1, 4), 16, 10).cast("int")
    start = F.to_date(F.lit("2024-01-01"))
    p = p.withColumn("h", h).where("h % 3 <> 0")
    events = F.array(
        F.struct(F.lit("add").alias("action"), F.date_add(start, F.col("h") % 200).alias("day")),
        F.struct(F.when(F.col("h") % 2 == 0, "remove").otherwise("add").alias("action"), F.date_add(start, F.col("h") % 200 + 60).alias("day")),
        F.struct(F.when(F.col("h") % 5 == 0, "add").otherwise("remove").alias("action"), F.date_add(start, F.col("h") % 200 + 110).alias("day")),
    )
    return p.select("pattern", F.inline(events))


def judged_pages(spark: SparkSession, pages: DataFrame) -> DataFrame:
    fetched = F.date_add(F.to_date(F.lit("2024-01-01")), (F.col("page_id") % 366).cast("int"))
    captures = pages.select("page_id", "url", fetched.alias("fetched"))
    return judge(captures, fixture_log(pages)).select("page_id", "host", "fetched", "entry", "active_from", "blocked")
