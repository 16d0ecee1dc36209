"""Language identification by segmentation-marginalised unigrams.

Each language has a probability for every piece of one fixed public vocabulary.  A word's
likelihood is the sum over all ways to cut it into pieces of the product of their
probabilities, by a forward recursion; a text's is the product over its words.  The
probabilities are fitted by expectation maximisation with forward-backward counts, from
a uniform start, as Spark jobs over (language, word, count) rows.

Words are runs of letters of the lower-cased text, begun with the vocabulary's word mark, and are never cut; all lower-case
pieces of letters only, of whatever length, take part.  A character that the vocabulary lacks has one small probability, the
same for all languages.  Likelihoods of long words are kept in range by rescaling as the recursion goes.

Defined results: ``und`` with score 0 for a null text or one without a letter, and for every
text if nothing can be learned; an empty table gives no rows; a text of any length is taken whole, word by word; the score is the posterior of the predicted language under
equal priors; ties go to the language that sorts first; rows may repeat; other columns are ignored.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.llm.common import U64, mix, powers, small_batches

MARK = "▁"
UNKNOWN = 1e-9
#: Characters of words worked on at once, and steps of the recursion between two rescalings.
CHARACTERS, STEPS = 1 << 15, 16
#: Words kept with their scores by a Python worker; the cache starts anew when it is full.
CACHE_WORDS = 300_000
_NOT_LETTERS = bytes(c if chr(c).isalpha() or c >= 128 else 32 for c in range(256))


def vocabulary_pieces(path: str) -> list[str]:
    """The lower-case, letters-only pieces of a sentencepiece model, with or without the word mark."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    pieces = {model.id_to_piece(i) for i in range(model.get_piece_size())}
    fit = lambda p: p == MARK or (x := p.removeprefix(MARK)).isalpha() and x == x.lower()
    return sorted(p for p in pieces if p and fit(p))


def _character(codes: np.ndarray) -> np.ndarray:
    """A hash of each code point, all of its bits."""
    return mix(codes.astype(U64) * U64(0x9E3779B97F4A7C15) + U64(83)) | U64(1)


class Lattice:
    """Finds every piece inside a block of words at once, and sums over all ways to cut them."""

    def __init__(self, pieces: Sequence[str]):
        self.size, self.longest = len(pieces), max(map(len, pieces), default=1)
        ends = np.cumsum([len(p) for p in pieces])
        begins = np.r_[0, ends[:-1]].astype(np.int64)
        codes = np.frombuffer("".join(pieces).encode("utf-32-le"), "<u4")
        pw, ipw = powers(len(codes) + 1)
        h = np.r_[U64(0), np.cumsum(_character(codes) * pw[: len(codes)], dtype=U64)]
        keys = mix((h[ends] - h[begins]) * ipw[begins]) if len(pieces) else np.zeros(0, U64)
        # open addressing by rounds: a table of 2**18 slots for each, until every piece has a place
        self.tables = []
        left = np.arange(len(pieces))
        for r in range(64):
            if not len(left):
                break
            slot = self._slot(keys[left], r)
            table = np.full(1 << 18, -1, np.int32)
            table[slot[::-1]] = left[::-1]
            self.tables.append(table)
            left = left[table[slot] != left]
        self.keys = np.append(keys, U64(0))

    @staticmethod
    def _slot(keys: np.ndarray, r: int) -> np.ndarray:
        return ((keys * U64(2 * r + 1)) >> U64(46)).astype(np.int64)

    def find(self, keys: np.ndarray) -> np.ndarray:
        out = np.full(len(keys), self.size, np.int32)
        for r, table in enumerate(self.tables):
            got = table[self._slot(keys, r)]
            hit = (got >= 0) & (self.keys[got] == keys)
            out[hit] = got[hit]
        return out

    def pieces_of(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(piece of each length - 1, word and end, or ``size`` for none; lengths); the mark counts, words are padded to the longest."""
        lengths = np.array([len(w) for w in words]) + 1
        n, width = len(words), int(lengths.max())
        codes = np.zeros((n, width), np.uint32)
        codes[:, 1:][np.arange(1, width) < lengths[:, None]] = np.frombuffer("".join(words).encode("utf-32-le"), "<u4")
        codes[:, 0] = ord(MARK)
        pw, ipw = powers(width + 1)
        h = np.zeros((n, width + 1), U64)
        np.cumsum(_character(codes) * pw[:width], axis=1, dtype=U64, out=h[:, 1:])
        found = np.full((self.longest, n, width + 1), self.size, np.int32)
        for size in range(1, min(self.longest, width) + 1):
            found[size - 1, :, size:] = self.find(mix((h[:, size:] - h[:, :-size]) * ipw[: width + 1 - size]).ravel()).reshape(n, -1)
        return found, lengths

    def _steps(self, found: np.ndarray, prob: np.ndarray) -> np.ndarray:
        step = prob[found]
        step[0][found[0] == self.size] = UNKNOWN
        return step

    def forward(self, words: list[str], prob: np.ndarray) -> np.ndarray:
        """Logarithms of the likelihoods (words x languages). prob: (pieces + 1) x languages, the last row zero."""
        found, lengths = self.pieces_of(words)
        longest, (n, width) = self.longest, found.shape[1:]
        ahead = np.zeros((longest + width, n, prob.shape[1]))  # row e + longest - 1 is the sum over cuts of the first e characters
        ahead[longest - 1] = 1
        shift, out = np.zeros(ahead.shape[1:]), np.empty(ahead.shape[1:])
        for e in range(1, width):
            window = ahead[e - 1 : e - 1 + longest]
            ahead[e - 1 + longest] = (window[::-1] * self._steps(found[:, :, e], prob)).sum(axis=0)
            if e % STEPS == 0:
                window = ahead[e : e + longest]
                top = window.max(axis=0)
                window /= top
                shift += np.log(top)
            done = lengths == e
            if done.any():
                out[done] = np.log(ahead[e - 1 + longest][done]) + shift[done]
        return out

    def expected(self, words: list[str], prob: np.ndarray, weights: np.ndarray) -> np.ndarray:
        """The expected count of each piece in the words, over all ways to cut them. prob: of one language, the last one zero."""
        found, lengths = self.pieces_of(words)
        longest, (n, width) = self.longest, found.shape[1:]
        step = self._steps(found, prob)
        ahead, behind = np.zeros((longest + width - 1, n)), np.zeros((width + longest, n))
        up, down = np.zeros_like(ahead), np.zeros_like(behind)
        ahead[longest - 1] = 1
        for e in range(1, width):
            ahead[e - 1 + longest] = (ahead[e - 1 : e - 1 + longest][::-1] * step[:, :, e]).sum(axis=0)
            up[e - 1 + longest] = up[e - 2 + longest]
            if e % STEPS == 0:
                rows = slice(e, e + longest)
                top = ahead[rows].max(axis=0)
                ahead[rows] /= top
                up[rows] += np.log(top)
        sizes = np.arange(longest)
        padded = np.concatenate([step, np.zeros((longest, n, longest))], axis=2)
        for e in range(width - 1, -1, -1):
            behind[e] = (padded[sizes, :, e + 1 + sizes] * behind[e + 1 : e + 1 + longest]).sum(axis=0)
            down[e] = down[e + 1]
            starts = lengths == e
            behind[e][starts], down[e][starts] = 1, 0
            if (width - e) % STEPS == 0:
                rows = slice(e, e + longest)
                top = behind[rows].max(axis=0)
                top[top == 0] = 1  # the word has not begun yet, seen from its end
                behind[rows] /= top
                down[rows] += np.log(top)
        total = np.log(behind[0]) + down[0]
        ahead, up = ahead[longest - 1 :], up[longest - 1 :]
        counts = np.zeros(self.size + 1)
        for size in range(1, min(longest, width - 1) + 1):
            # rows beyond a word's end have no way on
            scale = np.exp(np.minimum(up[:-size] + down[size:width] - total, 700))
            flow = ahead[:-size] * step[size - 1, :, size:].T * behind[size:width] * scale
            counts += np.bincount(found[size - 1, :, size:].T.ravel(), weights=(flow * weights).ravel(), minlength=self.size + 1)
        counts[self.size] = 0
        return counts


@functools.lru_cache(maxsize=2)
def lattice_of(pieces: tuple[str, ...]) -> Lattice:
    """One for each worker and vocabulary, over tasks and rounds."""
    return Lattice(pieces)


def like_lengths(words: list[str]) -> Iterator[np.ndarray]:
    """Places of words of like length, so that little is padding, at most about ``CHARACTERS`` characters at a time; a longer word is alone."""
    order = np.argsort([len(w) for w in words], kind="stable")
    i = 0
    while i < len(order):
        n = max(1, CHARACTERS // (len(words[order[i]]) + 1))
        while n > 1 and (len(words[order[min(i + n, len(order)) - 1]]) + 1) * n > 2 * CHARACTERS:
            n //= 2
        yield order[i : i + n]
        i += n


def letters_only(text: str) -> str:
    """The text with a space for every character beyond ASCII that is no letter."""
    other = "" if text.isascii() else [c for c in set(text) if c > "\x7f" and not c.isalpha()]
    return text.translate({ord(c): " " for c in other}) if other else text


@dataclass(frozen=True)
class LanguageModel:
    languages: list[str]
    pieces: list[str]
    prob: np.ndarray  # (pieces + 1) x languages


class Scorer:
    def __init__(self, model: LanguageModel):
        self.model, self.lattice = model, lattice_of(tuple(model.pieces))
        self.known: dict[bytes, int] = {}
        self.rows = np.zeros((CACHE_WORDS * 2, len(model.languages)))

    def learn(self, new: list[bytes]) -> None:
        words, base = [w.decode() for w in new], len(self.known)
        if not self.model.languages:
            return
        for at in like_lengths(words):
            self.rows[base + at] = self.lattice.forward([words[k] for k in at], self.model.prob)
        self.known.update(zip(new, range(base, base + len(new)), strict=True))

    def score(self, texts: list[str | None]) -> tuple[list[str], list[float]]:
        langs, scores = [], []
        split = [letters_only((t or "").lower()).encode().translate(_NOT_LETTERS).split() for t in texts]
        for group in range(0, len(texts), 64):
            part = split[group : group + 64]
            new = list(set().union(*part) - self.known.keys())
            if len(self.known) + len(new) > CACHE_WORDS:
                self.known.clear()
                new = list(set().union(*part))
                if len(new) > len(self.rows):
                    self.rows = np.zeros((len(new), self.rows.shape[1]))
            self.learn(new)
            for ws in part:
                if not ws or not self.model.languages:
                    langs.append("und")
                    scores.append(0.0)
                    continue
                total = self.rows[np.fromiter(map(self.known.__getitem__, ws), np.int64, len(ws))].sum(axis=0, dtype=np.float64)
                best = int(total.argmax())
                langs.append(self.model.languages[best])
                scores.append(float(1 / np.exp(np.minimum(total - total[best], 0)).sum()))
        return langs, scores


def held_out(doc_id: str) -> Column:
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 4 == 2, F.lit(False))


def lowest_ids(usable: DataFrame, n: int) -> DataFrame:
    """lang and doc_id of the ``n`` rows of each language whose ids hash lowest.

    Counts of 4,096 slots of the hash tell where a language's first ``n`` rows end; only rows up to there are ranked.
    """
    rows = usable.select("lang", "doc_id", F.xxhash64("doc_id").alias("h")).withColumn("slot", F.shiftright("h", 52))
    before = F.sum("n").over(Window.partitionBy("lang").orderBy("slot")) - F.col("n")
    slots = rows.groupBy("lang", "slot").agg(F.count(F.lit(1)).alias("n")).withColumn("before", before)
    last = slots.where(F.col("before") < n).groupBy("lang").agg(F.max("slot").alias("last"))
    near = rows.join(F.broadcast(last), "lang").where("slot <= last")  # a row for each language, of which the model holds as many
    rank = F.row_number().over(Window.partitionBy("lang").orderBy("h", "doc_id"))
    return near.withColumn("rank", rank).where(F.col("rank") <= n).select("lang", "doc_id")


def fit(docs: DataFrame, vocabulary: str, max_docs: int = 1000, rounds: int = 3) -> LanguageModel:
    """Fits on at most ``max_docs`` documents of each language, those whose ids hash lowest, whole texts.

    Rows of word counts are grouped and each EM round's counts are summed by Spark; the driver holds one
    number for each piece and language.
    """
    spark = docs.sparkSession
    small_batches(spark)
    pieces = vocabulary_pieces(vocabulary)
    usable = docs.where("text is not null and lang is not null and doc_id is not null").where(~held_out("doc_id"))
    lowest = lowest_ids(usable, max_docs).collect()
    languages, ids = sorted({r["lang"] for r in lowest}), {r["doc_id"] for r in lowest}
    if not ids:
        return LanguageModel([], pieces, np.zeros((len(pieces) + 1, 0)))
    chosen = spark.createDataFrame([(i,) for i in ids], "doc_id long")
    sample = usable.join(F.broadcast(chosen), "doc_id", "left_semi")  # max_docs ids for each language
    word = F.explode(F.split(F.lower("text"), r"[^\p{L}]+")).alias("word")
    counts = sample.select("lang", word).where("word <> ''").groupBy("lang", "word").count().persist()
    prob = np.zeros((len(pieces) + 1, len(languages)))
    prob[:-1] = 1 / len(pieces)
    try:
        for _ in range(rounds):
            prob = _round(counts, pieces, languages, prob)
    finally:
        counts.unpersist()
    return LanguageModel(languages, pieces, prob)


def _round(counts: DataFrame, pieces: list[str], languages: list[str], prob: np.ndarray) -> np.ndarray:
    shared = counts.sparkSession.sparkContext.broadcast((pieces, languages, prob))

    def expect(batches):
        pieces, languages, prob = shared.value
        lattice = lattice_of(tuple(pieces))
        sums = np.zeros((len(pieces), len(languages)))
        for b in batches:
            lang, word, n = b.column("lang").to_pylist(), b.column("word").to_pylist(), b.column("count").to_numpy().astype(float)
            for k, name in enumerate(languages):
                own = [i for i, x in enumerate(lang) if x == name]
                for at in like_lengths([word[i] for i in own]):
                    part = [own[i] for i in at]
                    sums[:, k] += lattice.expected([word[i] for i in part], prob[:, k], n[part])[:-1]
        at, lang = np.nonzero(sums)
        yield pa.RecordBatch.from_arrays([pa.array(lang, pa.int32()), pa.array(at, pa.int32()), pa.array(sums[at, lang])], ["lang", "piece", "n"])

    rows = counts.select("lang", "word", "count").mapInArrow(expect, "lang int, piece int, n double").groupBy("lang", "piece").agg(F.sum("n").alias("n")).toPandas()
    out = np.full((len(pieces) + 1, len(languages)), 0.01)
    out[rows["piece"], rows["lang"]] += rows["n"]
    out[-1] = 0
    return out / out.sum(axis=0)


def identify(docs: DataFrame, model: LanguageModel) -> DataFrame:
    """doc_id, lang_pred, score for every row of ``docs`` (doc_id, text); no shuffle."""
    spark = docs.sparkSession
    small_batches(spark)
    shared = spark.sparkContext.broadcast(model)  # one number for each piece and language

    def run(batches):
        scorer = Scorer(shared.value)
        for b in batches:
            lang, score = scorer.score(b.column("text").to_pylist())
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(lang, pa.string()), pa.array(score, pa.float64())], ["doc_id", "lang_pred", "score"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, lang_pred string, score double")
