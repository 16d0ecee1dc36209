"""Benchmark decontamination by spaced-seed hashing, in DataFrame functions only.

Words are lower-cased runs of letters and digits.  A mask such as 1101100101 hashes the
words at its ones and ignores those at its zeros, so a passage with substituted words still
shares seeds with its original.  Seeds of all documents are joined with the benchmark's;
a hit gives an alignment, along which the words of document and item are compared one by
one.  A hit counts if some run of ``window`` aligned words (all of an item that is shorter)
has at least ``share`` of them equal.

The documents' side is never shuffled while the benchmark's seeds are few (``BROADCAST_SEEDS``,
counted): each position's words are hashed from columns beside each other and looked up at once.
Beyond that, seeds are joined by a shuffle.  Alignments alone are grouped; the words of the
documents that have any come by a second read of those documents.

No qualifying run is missed: of any ``window`` aligned words with as many substitutions as
``share`` allows, one mask still meets only equal words (``covered``; where the given masks do
not, a run of equal words that must remain is one more mask).  An item shorter than ``window``
is cut into one piece more than it may have substitutions, so one piece is left whole; such
runs are seeds of the documents only if the benchmark has items of that length.

Defined results: null or empty texts and items have no seeds; items with equal words are one
class under their smallest item_id, with ``n_items`` their number; rows that repeat a
``doc_id`` count as one document; rows with a null ``doc_id`` are documents by their text; a text of
any length is taken whole; an empty table gives no rows, an empty benchmark no hits; other columns are ignored.
"""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import staged

#: Ones are compared, zeros are not.
MASKS = ("1101100101", "11100100011", "10111101")
#: Seeds of the benchmark up to this number are broadcast, about 40 bytes each.
BROADCAST_SEEDS = 1_000_000
#: Ids of found documents up to this number are broadcast, 16 bytes each.
BROADCAST_IDS = 1_000_000
#: Positions of a document that are laid side by side at a time.
CHUNK = 8192


def word_hash_array(text: Column) -> Column:
    words = F.array_remove(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), "")
    return F.transform(F.coalesce(words, F.array().cast("array<string>")), lambda w: F.xxhash64(w))


def seeds(words: str, masks: tuple[str, ...], only=None) -> Column:
    """array<struct<seed, pos>> of all masks, or of those in ``only``, at all positions."""
    w = F.col(words)

    def one(k: int, mask: str) -> Column:
        picks = [i for i, c in enumerate(mask) if c == "1"]
        at = lambda i: F.struct(F.xxhash64(F.lit(k), *[F.get(w, i + p) for p in picks]).alias("seed"), i.alias("pos"))
        return F.when(F.size(w) >= len(mask), F.transform(F.sequence(F.lit(0), F.size(w) - len(mask)), at)).otherwise(F.array().cast("array<struct<seed:bigint,pos:int>>"))

    return F.concat(*[one(k, m) for k, m in enumerate(masks) if only is None or m in only])


def covered(masks: tuple[str, ...], size: int, changed: int) -> bool:
    """Whether every placement of ``changed`` substitutions in ``size`` words leaves some mask without one."""
    spots = [{at + i for i, c in enumerate(m) if c == "1"} for m in masks for at in range(size - len(m) + 1)]
    return all(any(s.isdisjoint(p) for s in spots) for p in combinations(range(size), changed))


def allowed(size: int, share: float) -> int:
    """Substitutions that ``size`` compared words may have."""
    return size - next(m for m in range(size + 1) if m >= size * share)


def anonymous(doc_id: Column, text_id: Column) -> Column:
    """What tells rows with a null ``doc_id`` apart: their text."""
    return F.when(doc_id.isNull(), text_id)


def documents(docs: DataFrame) -> DataFrame:
    """doc_id, text_id (a hash of the text) and the hashed words of every row."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_id"), word_hash_array(F.col("text")).alias("words"))


def positions(d: DataFrame, masks: tuple[str, ...]) -> DataFrame:
    """doc_id, text_id, seed, pos of all masks at all positions.

    The words of a position stand side by side in columns, cut from chunks of the document, so that no
    exploded row carries an array and the work grows with the length alone.
    """
    picks = [[i for i, c in enumerate(m) if c == "1"] for m in masks]
    offsets = sorted(set().union(*picks))
    bases = d.select("doc_id", "text_id", "words", F.explode(F.sequence(F.lit(0), F.greatest(F.size("words") - 1, F.lit(0)), F.lit(CHUNK))).alias("base"))
    side = F.arrays_zip(*[F.slice("words", F.col("base") + k + 1, F.lit(CHUNK)).alias(f"w{k}") for k in offsets])
    rows = bases.select("doc_id", "text_id", "base", F.posexplode(side).alias("i", "w"))
    word = lambda k: F.col("w").getField(f"w{k}")
    # a mask that leaves the document meets a null
    found = [F.when(word(p[-1]).isNotNull(), F.xxhash64(F.lit(k), *[word(x) for x in p])) for k, p in enumerate(picks)]
    return rows.select("doc_id", "text_id", (F.col("base") + F.col("i")).alias("pos"), F.explode(F.array(*found)).alias("seed")).where("seed is not null")


def verified(docs: DataFrame, benchmark: DataFrame, masks: tuple[str, ...] = MASKS, window: int = 12, share: float = 0.8) -> DataFrame:
    """``overlaps`` with a column that tells documents of a null ``doc_id`` apart."""
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), word_hash_array(F.col("text")).alias("item"))
    items = items.where(F.size("item") > 0).groupBy("item").agg(F.min("item_id").alias("item_id"), F.count(F.lit(1)).alias("n_items"))
    short = sorted(r[0] for r in items.where(F.size("item") < window).select(F.size("item")).distinct().collect())  # under ``window`` numbers
    if not covered(masks, window, allowed(window, share)):
        masks = (*masks, "1" * (window // (allowed(window, share) + 1)))
    runs = {n: {"1" * (n // k), "1" * -(-n // k)} for n in short for k in (allowed(n, share) + 1,)}
    long_masks, masks = masks, (*masks, *sorted(set().union(*runs.values()) - set(masks)))
    own = F.when(F.size("item") >= window, seeds("item", masks, long_masks))
    for n, of in runs.items():
        own = own.when(F.size("item") == n, seeds("item", masks, of))
    keys = items.select("item_id", F.inline(own).alias("seed", "at"))
    d = documents(docs)
    few = keys.count() <= BROADCAST_SEEDS
    hits = positions(d, masks).join(F.broadcast(keys) if few else keys, "seed")
    at = hits.groupBy("doc_id", "text_id", "item_id", (F.col("pos") - F.col("at")).alias("begin")).agg(F.count(F.lit(1)).alias("seeds"))
    at = staged(at, "alignments")
    # texts are read again for the documents with alignments only
    ids = staged(at.select("doc_id", "text_id").distinct(), "hit-documents")
    ids = ids.select(F.col("doc_id").alias("of"), F.col("text_id").alias("text_of"))
    same = F.col("of").eqNullSafe(F.col("doc_id")) & F.col("text_of").eqNullSafe(F.col("text_id"))
    hit = d.join(F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids, same, "left_semi").dropDuplicates(["doc_id", "text_id"])
    at = at.withColumnsRenamed({"doc_id": "of", "text_id": "text_of"}).join(F.broadcast(items) if few else items, "item_id")
    hits = at.join(hit, same).drop("of", "text_of")
    begin = F.col("begin")
    lo = F.greatest(F.lit(0), -begin)
    n = F.least(F.size("item"), F.size("words") - begin) - lo
    hits = hits.where(n > 0).select("doc_id", "text_id", "item_id", "n_items", "seeds", F.slice("words", begin + lo + 1, n).alias("x"), F.slice("item", lo + 1, n).alias("y"), F.least(F.lit(window), F.size("item")).alias("w"))
    equal = F.zip_with("x", "y", lambda a, b: (a == b).cast("int"))
    hits = hits.withColumn("equal", equal).where(F.size("equal") >= F.col("w"))
    best = F.array_max(F.transform(F.sequence(F.lit(0), F.size("equal") - F.col("w")), lambda i: F.aggregate(F.slice("equal", i + 1, F.col("w")), F.lit(0), lambda s, v: s + v)))
    hits = hits.select("doc_id", "text_id", "item_id", "n_items", "w", "seeds", best.alias("matched")).where(F.col("matched") >= F.col("w") * share)
    return hits.groupBy("doc_id", anonymous(F.col("doc_id"), F.col("text_id")).alias("anon"), "item_id").agg(F.first("n_items").alias("n_items"), F.max("matched").cast("long").alias("matched"), F.first("w").cast("long").alias("compared"), F.sum("seeds").alias("n_seeds"))


def overlaps(docs: DataFrame, benchmark: DataFrame, masks: tuple[str, ...] = MASKS, window: int = 12, share: float = 0.8) -> DataFrame:
    """doc_id, item_id, n_items, matched, compared, n_seeds for every document and item class with a verified overlap."""
    return verified(docs, benchmark, masks, window, share).drop("anon")


def clean(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """The documents without any verified overlap; rows with a null ``doc_id`` are judged by their own text."""
    found = staged(verified(docs, benchmark, **options).select("doc_id", "anon").distinct(), "contaminated")
    found = F.broadcast(found) if found.count() <= BROADCAST_IDS else found
    of, row = F.col("doc_id").cast("long"), "millrace_row"
    known = docs.select(F.struct(*docs.columns).alias(row), of.alias("doc_id"), anonymous(of, F.xxhash64("text")).alias("anon"))
    found = found.withColumnsRenamed({"doc_id": "of", "anon": "anon_of"})
    return known.join(found, F.col("of").eqNullSafe(F.col("doc_id")) & F.col("anon_of").eqNullSafe(F.col("anon")), "left_anti").select(f"{row}.*")
