"""Token ids of whole documents in compressed files with single-document access.

One zstandard dictionary is trained on the serialized id arrays of a bounded sample of
documents (``sample_docs``); every document is then compressed on its own with that
dictionary.  The files hold blocks of documents: ids of the documents, token counts, an
offset index into the block's frames, the frames, and the SHA-256 of the dictionary,
which a reader compares before it decodes.  The container is Parquet, so Spark's writer
commits it, a lost executor's task is simply run again, and any store Spark can write to
will do.

Files are in ascending ``doc_id`` order: shard by shard (ranges of ``doc_id``), block by
block, with the shard totals in a table of their own: as many rows as files.

Defined results: null text counts as empty (one end id); a null ``doc_id`` sorts first;
rows that repeat a ``doc_id`` are all kept, ordered by the checksums of their texts; an
empty table gives empty files and no rows; other columns are ignored.  Any tokenizers JSON
file will do: those that do not drop white space are given whole texts.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm.common import U64, mix, shared_dir, small_batches, words
from millrace.operators.running import running_sums

#: Byte-level BPE writes each byte as one printable character: the printable Latin-1 ones stand for themselves, the others follow from code point 256 on.
_PRINTABLE = [*range(33, 127), *range(161, 173), *range(174, 256)]
_BYTE_CHAR = {b: b for b in _PRINTABLE} | {b: 256 + i for i, b in enumerate(b for b in range(256) if b not in _PRINTABLE)}
_ASCII_WORD = re.compile(rb"[a-z]+").fullmatch
_LATIN_WORD = re.compile("[a-zß-öø-ÿ]+").fullmatch
_SPACE = re.compile(rb"[\x20\x09-\x0D]")
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
#: Low bytes of a number that belong to a word of so many bytes.
_MASK = np.array([(1 << 8 * k) - 1 for k in range(8)] + [2**64 - 1], U64)
#: Words kept by a Python worker, under 100 MB; the table starts anew when it is full.
TABLE_WORDS = 2_000_000
_SLOT_BITS, _ROUNDS = 22, 8
#: Shards (16 bytes each) up to this number are broadcast to the reader's blocks; beyond it the join is shuffled.
BROADCAST_SHARDS = 1_000_000
#: Text encoded at once; a longer document is a block of its own.
ENCODE_BYTES = 2_000_000


def splits_at_space(tokenizer) -> bool:
    """Whether a text's ids are the ids of its parts between white space, in any case of ASCII letters, and a stop after a letter is a part.

    So it is where white space is dropped, what remains is split into runs of letters, single
    digits and runs of other characters, and text is lower-cased.  Of other tokenizers whole texts are encoded.
    """
    conf = json.loads(tokenizer.to_str())
    parts = lambda key, many: ((x := conf.get(key)) and (x[many] if x["type"] == "Sequence" else [x])) or []
    norms, pres = parts("normalizer", "normalizers"), parts("pre_tokenizer", "pretokenizers")
    plain = all(n["type"] in ("NFC", "Lowercase") or (n["type"] == "Replace" and n["pattern"] == {"Regex": r"\s+"} and n["content"] == " ") for n in norms)
    if not plain or not any(n["type"] == "Lowercase" for n in norms) or [p["type"] for p in pres] != ["Split", "ByteLevel"]:
        return False
    split, level = pres
    dropped = split["behavior"] == "Removed" and split["invert"] and split["pattern"].get("Regex", "").endswith(r"|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+")
    return bool(dropped and not level["add_prefix_space"] and not level["use_regex"] and conf.get("post_processor") is None and conf["model"]["type"] == "BPE")


class Encoder:
    """Whole texts to ids, by the tokenizer, with a table of the words met so far.

    A word of at most 16 bytes is found by its bytes as two numbers, for a block of texts at
    once; others, and words that are new, go to the tokenizer one by one.  Words of letters
    only go straight to its BPE model: for them its normalizer and splitter do nothing but lower case.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.by_word = splits_at_space(self.tokenizer)
        #: Added tokens are sought in the text as it is.
        self.added = [t.content.lower().encode() for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.marks = {c: np.array(self.whole(chr(c)), np.uint32) for c in b".,"}
        self.clear()

    def whole(self, text: str) -> list[int]:
        return self.tokenizer.encode(text, add_special_tokens=False).ids

    def word(self, chunk: bytes) -> list[int]:
        core, mark = (chunk[:-1], chunk[-1]) if chunk[-1] in self.marks else (chunk, 0)
        low = core.lower()
        if _ASCII_WORD(low):
            ids = [t.id for t in self.model.tokenize(low.decode())]
        elif core and core[-1] > 64 and _LATIN_WORD(word := core.decode().lower()):
            ids = [t.id for t in self.model.tokenize(word.encode().decode("latin-1").translate(_BYTE_CHAR))]
        else:
            return self.whole(chunk.decode())
        return ids + self.marks[mark].tolist() if mark else ids

    def clear(self) -> None:
        self.slots = np.full(1 << _SLOT_BITS, -1, np.int32)
        self.count = self.used = 0
        self.low, self.high = np.zeros(1 << 12, U64), np.zeros(1 << 12, U64)
        self.at, self.size = np.zeros(1 << 12, np.int64), np.zeros(1 << 12, np.int32)
        self.ids = np.zeros(1 << 14, np.uint32)

    def _append(self, found: list[list[int]], low=None, high=None) -> np.ndarray:
        """Rows of the table for words with these ids."""
        n, sizes = len(found), np.array([len(x) for x in found], np.int32)
        while self.count + n > len(self.at):
            self.low, self.high, self.at, self.size = (np.concatenate([x, np.zeros_like(x)]) for x in (self.low, self.high, self.at, self.size))
        total = int(sizes.sum())
        while self.used + total > len(self.ids):
            self.ids = np.concatenate([self.ids, np.zeros_like(self.ids)])
        rows = np.arange(self.count, self.count + n)
        self.at[rows] = self.used + np.cumsum(sizes) - sizes
        self.size[rows] = sizes
        self.ids[self.used : self.used + total] = np.fromiter((i for x in found for i in x), np.uint32, total)
        if low is not None:
            self.low[rows], self.high[rows] = low, high
        self.count, self.used = self.count + n, self.used + total
        return rows

    def _slot(self, h: np.ndarray, k: int) -> np.ndarray:
        return ((h * U64(2 * k + 1)) >> U64(64 - _SLOT_BITS)).astype(np.int64)

    def _find(self, low: np.ndarray, high: np.ndarray, h: np.ndarray) -> np.ndarray:
        """The row of each word, -1 for a new one."""
        out = np.full(len(low), -1, np.int64)
        left = np.arange(len(low))
        for k in range(_ROUNDS):
            got = self.slots[self._slot(h[left], k)]
            hit = (self.low[got] == low[left]) & (self.high[got] == high[left]) & (got >= 0)
            out[left[hit]] = got[hit]
            left = left[~hit & (got >= 0)]  # an empty slot ends the search
            if not len(left):
                break
        return out

    def _learn(self, low: np.ndarray, high: np.ndarray, h: np.ndarray) -> np.ndarray:
        """Rows for new words, each distinct one encoded once."""
        order = np.lexsort((high, low))
        new = np.r_[True, (low[order][1:] != low[order][:-1]) | (high[order][1:] != high[order][:-1])]
        first = order[new]
        raw = np.stack([low[first], high[first]], 1).astype("<u8").tobytes()
        rows = self._append([self.word(raw[i : i + 16].rstrip(b"\0")) for i in range(0, len(raw), 16)], low[first], high[first])
        out = np.empty(len(low), np.int64)
        out[order] = rows[np.cumsum(new) - 1]
        left, hashes = np.arange(len(rows)), h[first]
        for k in range(_ROUNDS):
            slot = self._slot(hashes[left], k)
            free = self.slots[slot] < 0
            self.slots[slot[free][::-1]] = rows[left[free]][::-1]
            left = left[self.slots[slot] != rows[left]]
            if not len(left):
                break
        return out

    def block(self, data: np.ndarray, offsets: np.ndarray, end_id: int) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts of a block, each followed by the end id; n+1 bounds)."""
        start, end, first = words(data, offsets)
        if self.count > TABLE_WORDS:
            self.clear()
        foreign = np.r_[0, np.cumsum(data >= 128, dtype=np.int32)]
        plain = foreign[end] == foreign[start]
        # a stop after an ASCII letter is a part of its own
        last, before = data[end - 1], data[np.maximum(end - 2, start)]
        before = _LOWER[before]
        marked = np.isin(last, np.fromiter(self.marks, np.uint8)) & (before >= 97) & (before <= 122)
        stop = end - marked
        size = stop - start
        easy = size <= 16
        if (data == 0).any():
            zero = np.r_[0, np.cumsum(data == 0, dtype=np.int32)]
            easy &= zero[stop] == zero[start]
        row = np.empty(len(start), np.int64)
        i = np.flatnonzero(easy)
        keys, views = [], []
        for lower in (True, False):  # eight bytes from any place on, as a number; words of ASCII alone in lower case
            wide = np.zeros(len(data) + 24, np.uint8)
            wide[: len(data)] = _LOWER[data] if lower else data
            views.append((np.flatnonzero(plain[i] == lower), np.ndarray(len(data) + 16, "<u8", wide, strides=(1,))))
        for part in (0, 8):
            key = np.zeros(len(i), U64)
            mask = _MASK[np.clip(size[i] - part, 0, 8)]
            for pick, view in views:
                key[pick] = view[start[i[pick]] + part] & mask[pick]
            keys.append(key)
        low, high = keys
        h = mix(low + mix(high))
        row[i] = self._find(low, high, h)
        new = i[row[i] < 0]
        if len(new):
            at = np.searchsorted(i, new)
            row[new] = self._learn(low[at], high[at], h[at])
        kept = self.count, self.used
        hard = np.flatnonzero(~easy)
        if len(hard):
            row[hard] = self._append([self.word(data[start[x] : stop[x]].tobytes()) for x in hard])
        count, source = self.size[row].astype(np.int64), self.at[row]
        self.count, self.used = kept
        ends = np.array([len(self.marks[c]) for c in self.marks])
        extra = np.zeros(len(row), np.int64)
        for c, n in zip(self.marks, ends, strict=True):
            extra[marked & (last == c)] = n
        doc = np.repeat(np.arange(len(first) - 1), np.diff(first))
        begin = np.cumsum(count + extra) - count - extra + doc
        out = np.empty(int((count + extra).sum()) + len(first) - 1, np.uint32)
        inside = np.arange(int(count.sum())) - np.repeat(np.cumsum(count) - count, count)
        out[np.repeat(begin, count) + inside] = self.ids[np.repeat(source, count) + inside]
        for c, ids in self.marks.items():
            at = (begin + count)[marked & (last == c)]
            for k, v in enumerate(ids):
                out[at + k] = v
        total = np.r_[0, np.cumsum(count + extra)]
        bounds = total[first] + np.arange(len(first))
        out[bounds[1:] - 1] = end_id
        return out, bounds

    def alone(self, text: bytes, end_id: int) -> np.ndarray:
        """The ids of one text that is long or holds an added token."""
        if not self.by_word or any(t in text.lower() for t in self.added):
            return np.array([*self.whole(text.decode()), end_id], np.uint32)
        out, i = [], 0
        while i < len(text):
            cut = _SPACE.search(text, i + ENCODE_BYTES)
            j = cut.start() if cut else len(text)
            out.append(self.block(np.frombuffer(text, np.uint8, j - i, i), np.array([0, j - i]), end_id)[0][:-1])
            i = j
        return np.concatenate([*out, np.array([end_id], np.uint32)])

    def texts(self, texts: list[bytes], end_id: int) -> Iterator[np.ndarray]:
        """The ids of each text, the end id last."""
        i = 0
        while i < len(texts):
            j, size = i, 0
            while j < len(texts) and (j == i or size + len(texts[j]) <= ENCODE_BYTES):
                size += len(texts[j])
                j += 1
            part, raw = texts[i:j], b"".join(texts[i:j])
            i = j
            low = raw.lower()
            if self.by_word and size <= ENCODE_BYTES and not any(t in low for t in self.added):
                ids, bounds = self.block(np.frombuffer(raw, np.uint8), np.cumsum([0, *map(len, part)]), end_id)
                yield from (ids[a:b] for a, b in zip(bounds[:-1], bounds[1:], strict=True))
            else:
                yield from (self.alone(t, end_id) for t in part)


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """One for each Python worker and tokenizer."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def id_width(path: str, end_id: int) -> int:
    """Bytes of an id: 2 if all ids of the tokenizer and the end id are below 2**16, else 4."""
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path)
    return 2 if max(end_id, *t.get_vocab(with_added_tokens=True).values()) < 1 << 16 else 4


@dataclass(frozen=True)
class TokenFiles:
    """Where the files are; ``blocks``, ``shards`` and ``dictionary`` are Parquet folders."""

    root: str

    @property
    def blocks(self) -> str:
        return f"{self.root}/blocks"

    @property
    def shards(self) -> str:
        return f"{self.root}/shards"

    @property
    def dictionary(self) -> str:
        return f"{self.root}/dictionary"


BLOCK_SCHEMA = "shard int, block int, start long, doc_ids array<bigint>, n_tokens array<int>, offsets array<int>, frames binary, width int, dict_hash string"


def train_dictionary(docs: DataFrame, tokenizer: str, width: int, end_id: int, sample_docs: int, dict_bytes: int) -> bytes:
    """A dictionary from at most ``sample_docs`` documents, those whose ids and texts hash lowest; b'' if they are too few to train on."""
    order = F.xxhash64("doc_id", "text")
    lowest = docs.select(order.alias("h")).orderBy("h").limit(sample_docs).agg(F.max("h")).first()[0]
    if lowest is None:
        return b""
    # rows that are all alike may be many; as samples they are the same
    chosen = docs.where(order <= lowest).limit(2 * sample_docs).select("text")

    def encode(batches):
        for b in batches:
            texts = b.column(0).cast(pa.binary()).to_pylist()
            found = (x.astype(f"<u{width}").tobytes() for x in encoder(tokenizer).texts(texts, end_id))
            # zstandard learns from the start of a sample only, so a long array is given as several samples
            parts = [x[i : i + 4096] for x in found for i in range(0, min(len(x), 65536), 4096)]
            yield pa.RecordBatch.from_arrays([pa.array(parts, pa.binary())], ["ids"])

    samples = [bytes(r[0]) for r in chosen.mapInArrow(encode, "ids binary").limit(4 * sample_docs).collect()]
    samples.sort()
    try:
        return zstandard.train_dictionary(dict_bytes, samples).as_bytes()
    except zstandard.ZstdError:
        return b""


def write_tokens(
    docs: DataFrame,
    tokenizer: str,
    end_id: int,
    root: str | None = None,
    sample_docs: int = 1000,
    dict_bytes: int = 64 * 1024,
    level: int = 3,
    shard_bytes: int = 32_000_000,
    docs_per_block: int = 256,
    block_bytes: int = 1 << 20,
) -> TokenFiles:
    """Encodes every whole text of ``docs`` (doc_id, text) and writes the files.

    Texts are shuffled once, to shards of about ``shard_bytes`` that are ranges of ``doc_id``
    (of text and place within one ``doc_id``, so that no id fills a shard alone), and
    each shard is encoded and packed in order by one task.  ``tokenizer`` is the path of a
    tokenizers JSON file that is present on every machine.
    """
    spark = docs.sparkSession
    small_batches(spark)
    width = id_width(tokenizer, end_id)
    files = TokenFiles(root or f"{shared_dir(spark)}/tokens-{uuid.uuid4().hex}")
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    total = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    raw = train_dictionary(docs, tokenizer, width, end_id, sample_docs, dict_bytes)
    name = hashlib.sha256(raw).hexdigest()
    spark.createDataFrame([(name, bytearray(raw), width)], "dict_hash string, dictionary binary, width int").coalesce(1).write.parquet(files.dictionary)
    shared = spark.sparkContext.broadcast(raw)  # at most dict_bytes

    def pack(batches):
        known = zstandard.ZstdCompressionDict(shared.value) if shared.value else None
        packer = zstandard.ZstdCompressor(level=level, dict_data=known, write_dict_id=False)
        shard, block, start = TaskContext.get().partitionId(), 0, 0
        ids, counts, frames, size = [], [], [], 0

        def flush():
            offsets = np.cumsum([0, *map(len, frames)])
            row = [[shard], [block], [start], [ids], [counts], [offsets], [b"".join(frames)], [width], [name]]
            types = [pa.int32(), pa.int32(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int32()), pa.list_(pa.int32()), pa.binary(), pa.int32(), pa.string()]
            return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(row, types, strict=True)], [c.split()[0] for c in BLOCK_SCHEMA.split(", ")])

        for b in batches:
            texts = b.column("text").cast(pa.binary()).to_pylist()
            for doc, x in zip(b.column("doc_id").to_pylist(), encoder(tokenizer).texts(texts, end_id), strict=True):
                ids.append(doc)
                counts.append(len(x))
                frames.append(packer.compress(x.astype(f"<u{width}").tobytes()))
                size += len(frames[-1])
                if len(ids) >= docs_per_block or size >= block_bytes:
                    yield flush()
                    block, start = block + 1, start + sum(counts)
                    ids, counts, frames, size = [], [], [], 0
        if ids:
            yield flush()

    order = [F.col("doc_id").asc_nulls_first(), F.crc32("text")]
    dealt = docs.withColumn("place", F.spark_partition_id()).repartitionByRange(max(1, -(-total // shard_bytes)), *order, "place").sortWithinPartitions(*order, "text")
    dealt.select("doc_id", "text").mapInArrow(pack, BLOCK_SCHEMA).write.option("compression", "none").parquet(files.blocks)
    totals = spark.read.schema(BLOCK_SCHEMA).parquet(files.blocks).select("shard", F.size("doc_ids").alias("n"), F.aggregate("n_tokens", F.lit(0).cast("long"), lambda a, x: a + x).alias("tokens")).groupBy("shard").agg(F.sum("n").alias("n_docs"), F.sum("tokens").alias("n_tokens"))
    # one row for each shard, summed in two levels: runs of 4,096 shards, and the runs
    running_sums(totals, [], "shard", ["n_tokens"], F.expr("shard div 4096")).withColumnRenamed("below_n_tokens", "start").write.parquet(files.shards)
    return files


def read_tokens(spark: SparkSession, files: TokenFiles, with_ids: bool = True, doc_ids: list[int] | None = None) -> DataFrame:
    """Decodes the files: doc_id, start (ids of all documents before it), n_tokens, ids_crc32 and, if wanted, ids.

    ``doc_ids`` reads single documents: a block that has none of them is skipped and only
    the wanted frames are decompressed, found by the offset index.
    """
    small_batches(spark, 8)
    raw = bytes(spark.read.parquet(files.dictionary).first()["dictionary"])
    name = hashlib.sha256(raw).hexdigest()
    shared = spark.sparkContext.broadcast(raw)
    wanted = frozenset(doc_ids) if doc_ids is not None else None
    blocks = spark.read.schema(BLOCK_SCHEMA).parquet(files.blocks)
    if wanted is not None:
        blocks = blocks.where(F.arrays_overlap("doc_ids", F.array([F.lit(i).cast("long") for i in sorted(wanted)])))
    schema = "doc_id long, shard int, at long, n_tokens long, ids_crc32 long" + ", ids array<int>" * with_ids

    def decode(batches):
        known = zstandard.ZstdCompressionDict(shared.value) if shared.value else None
        unpacker = zstandard.ZstdDecompressor(dict_data=known)
        for b in batches:
            rows: list[tuple] = []
            for r in b.to_pylist():
                if r["dict_hash"] != name:
                    raise ValueError(f"block {r['block']} of shard {r['shard']} needs dictionary {r['dict_hash']}, not {name}")
                at, frames, offsets = r["start"], memoryview(r["frames"]), r["offsets"]
                for k, (doc, n) in enumerate(zip(r["doc_ids"], r["n_tokens"], strict=True)):
                    if wanted is None or doc in wanted:
                        ids = np.frombuffer(unpacker.decompress(frames[offsets[k] : offsets[k + 1]]), f"<u{r['width']}").astype("<u4")
                        rows.append((doc, r["shard"], at, len(ids), zlib.crc32(ids.tobytes()), *([ids.astype(np.int32)] if with_ids else [])))
                    at += n
            cols = list(zip(*rows, strict=True)) if rows else [[] for _ in range(5 + with_ids)]
            types = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int32())]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], [c.split()[0] for c in schema.split(", ")])

    shards = spark.read.parquet(files.shards).select(F.col("shard").alias("of"), F.col("start").alias("base"))
    if shards.count() <= BROADCAST_SHARDS:
        shards = F.broadcast(shards)
    out = blocks.mapInArrow(decode, schema)
    cols = ["doc_id", (F.col("at") + F.col("base")).alias("start"), "n_tokens", "ids_crc32"] + ["ids"] * with_ids
    return out.join(shards, out.shard == shards.of).select(*cols)
