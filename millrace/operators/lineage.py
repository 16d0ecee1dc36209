"""Verification of manifests and what they rest on: file records, references between manifests, cycles, reach."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.session import staged

WALKS = ("reached", "cyclic", "blocked")
#: Tables of single rounds that are read as one before they are joined to one.
PIECES = 32


def verify_manifests(records: DataFrame, files: DataFrame, roots: DataFrame, max_rounds: int = 10_000) -> DataFrame:
    """manifest and status, for all manifests.

    ``records``: manifest, role (input or output), path, sha256 as recorded. ``files``: path, sha256 as observed. ``roots``: manifest,
    those that an index lists.  A manifest rests on those whose outputs are its inputs.

    * ``missing``: a recorded file is not there; else ``drifted``: one has another digest;
    * ``cyclic``: it rests on itself, by whatever way; ``blocked``: it rests on a manifest that is not verified;
    * ``unreachable``: no root rests on it (that comes before all others); else ``verified``.

    Reach and blame are passed along the references in the same rounds, over what is new; each round drops the references that
    have been walked, that lead to what is found, or that start where no walk can come any more, so that a round costs what is
    left and not all references. Cycles are what remains when manifests that rest on none, and those on which none rests, are
    taken away round by round.
    Repeated records count once; a null digest is a difference, a null path a missing file.
    """
    seen = files.select(F.col("path").alias("_path"), F.col("sha256").alias("_sha256")).groupBy("_path").agg(F.min("_sha256").alias("_sha256"), F.max("_sha256").alias("_other"))
    same = F.coalesce((F.col("sha256") == F.col("_sha256")) & (F.col("sha256") == F.col("_other")), F.lit(False))
    checked = records.join(seen, F.col("path") == F.col("_path"), "left")
    own = staged(checked.select("manifest", "role", "path", F.col("_path").isNull().alias("missing"), (F.col("_path").isNotNull() & ~same).alias("drifted")), "records")
    local = staged(own.groupBy("manifest").agg(F.max("missing").alias("missing"), F.max("drifted").alias("drifted")), "local")
    made = own.where("role = 'output' and path is not null").select("path", F.col("manifest").alias("source")).distinct()
    edges = staged(own.where("role = 'input'").select("path", "manifest").join(made, "path").select("manifest", "source").distinct(), "references")
    cyclic = staged(_cyclic(edges, max_rounds), "cyclic")
    known = roots.select("manifest").distinct().join(local.select("manifest"), "manifest", "left_semi")
    bad = local.where("missing or drifted").select("manifest").unionByName(cyclic)
    start = _walk("reached", known.select("manifest")).unionByName(_walk("blocked", bad))
    steps = _walk("reached", edges.select(F.col("manifest").alias("_from"), F.col("source").alias("_to"))).unionByName(_walk("blocked", edges.select(F.col("source").alias("_from"), F.col("manifest").alias("_to"))))
    marks = _closure(start, steps, max_rounds).unionByName(_walk("cyclic", cyclic))
    marks = marks.groupBy("manifest").agg(*[F.max(F.col("walk") == i).alias(w) for i, w in enumerate(WALKS)])
    status = F.when(~F.coalesce("reached", F.lit(False)), "unreachable").when(F.col("missing"), "missing").when(F.col("drifted"), "drifted").when(F.col("cyclic"), "cyclic").when(F.col("blocked"), "blocked").otherwise("verified")
    return local.join(marks, "manifest", "left").select("manifest", status.alias("status"))


def _walk(name: str, df: DataFrame) -> DataFrame:
    return df.select(F.lit(WALKS.index(name)).cast("byte").alias("walk"), "*")


def _closure(start: DataFrame, steps: DataFrame, max_rounds: int) -> DataFrame:
    """walk and manifest of all that is met along the steps (walk, _from, _to) of the same walk, the start (walk, manifest) included."""
    new = staged(start.distinct(), "reach")
    found, pieces, left = new, 1, steps
    to = new.select("walk", F.col("manifest").alias("_to"))
    for _ in range(max_rounds):
        # no step of ``left`` leads to what was found before ``new``, or starts there
        ways = new.select("walk", F.col("manifest").alias("_from"), F.lit(True).alias("met")).unionByName(left.select("walk", F.col("_to").alias("_from"), F.lit(False).alias("met")))
        ways = ways.groupBy("walk", "_from").agg(F.max("met").alias("met"))
        live = staged(left.join(to, ["walk", "_to"], "left_anti").join(ways, ["walk", "_from"]).select("walk", "_from", "_to", "met"), "steps")
        new = staged(live.where("met").select("walk", F.col("_to").alias("manifest")).distinct(), "reach")
        if new.isEmpty():
            return found
        found, pieces = found.unionByName(new), pieces + 1
        if pieces == PIECES:
            found, pieces = staged(found, "reach"), 1
        to, left = new.select("walk", F.col("manifest").alias("_to")), live.where("not met").drop("met")
    raise RuntimeError(f"references are deeper than {max_rounds}")


def _cyclic(edges: DataFrame, max_rounds: int) -> DataFrame:
    """Manifests on a cycle, or between two cycles: none of their references can be taken away from either end."""
    left, n = edges, edges.count()
    for _ in range(max_rounds):
        both = left.join(left.select(F.col("manifest").alias("source")).distinct(), "source", "left_semi")
        both = staged(both.join(left.select(F.col("source").alias("manifest")).distinct(), "manifest", "left_semi"), "cycles")
        m = both.count()
        if m == n:
            return both.select(F.explode(F.array("manifest", "source")).alias("manifest")).distinct()
        left, n = both, m
    raise RuntimeError(f"references are deeper than {max_rounds}")
