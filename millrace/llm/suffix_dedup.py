"""Exact removal of byte strings that an earlier document also holds, by a family of sparse suffix arrays.

Every byte covered by a ``LENGTH``-byte string that also starts in a document with a smaller
``doc_id`` is removed; strings are judged on the input and never cross documents.

Sampling.  Of each run of 31 starts of 20-byte strings the one whose hash is smallest is an
anchor (a minimizer).  Equal 50-byte strings choose the same anchors at the same places, so
only suffixes that begin at anchors are indexed, about one in sixteen, and no match is lost.

Three passes, all of them Spark shuffles of packed arrays:

1. Anchors go to tasks by hash, each with the hash of its context (the bytes that any
   50-byte string through the anchor can reach).  An anchor whose whole context an earlier
   document repeats is covered; map tasks settle that among their own documents first, so a
   passage that very many documents hold sends one anchor for each task and variant.
2. Where an anchor stands in several documents in different contexts - the edges of matches -
   the contexts themselves are fetched and go to tasks by anchor.  There each batch of
   documents, in ascending order, gets a suffix array (sorted by the 50 bytes from the anchor
   on), is merge-scanned against the family's levels for runs that agree in the anchor, in which the
   matching 50-byte strings are found, and joins the family; levels of equal size
   merge, so the family has logarithmically many.  The contexts of an anchor that has over
   ``HOT_CONTEXTS`` of them (a line under 50 bytes that very many documents hold in different
   surroundings) do not go to one task: their 50-byte strings are dealt by 128 bits of hash, in
   the same shuffle, and of equal ones a map task sends the smallest document's alone.
3. What is covered goes back to the texts, which are cut.

Defined results: null text is empty; texts under 50 bytes lose nothing; documents with a null
``doc_id`` neither lose bytes nor make others lose any; rows that repeat a ``doc_id`` are
not earlier than each other; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import zlib

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import BYTE, U64, mix, partitions, powers, prefix_hash, seeded, small_batches, staged

LENGTH, GRAM = 50, 20
SIDE = LENGTH - GRAM  # bytes of context on either side of an anchor
WINDOWS = SIDE + 1
ALL = (1 << WINDOWS) - 1
_BYTE2 = seeded(256, 23) | U64(1)
#: Bytes of text packed at once by a map task, and of text for each task of a shuffle; the packed rows number total / FLUSH_BYTES * total / TASK_BYTES.
FLUSH_BYTES, TASK_BYTES = 16_000_000, 32_000_000
#: Bytes of text hashed at once (what a cache holds), and of texts that are looked up at once.
SEGMENT, BLOCK = 1 << 17, 2_000_000
#: Contexts of one batch of the family, and of those whose 50-byte strings are sorted at once.
BATCH, SORTED = 1 << 16, 1 << 14
#: In a run of at most so many contexts each is compared with each, in a longer one their strings are sorted.
NEIGHBOURS = 8

ROWS = "part int, kind int, blob binary"
COVERED, WANTED, HOT, ANCHORS, STRING, CONTEXTS, TEXTS = range(7)
#: An anchor with more different contexts than this, about 30 MB of a family, is matched string by string, not by one task.
HOT_CONTEXTS = 1 << 14


# Packing: columns of numbers as differences, compressed together; hashes as they are.
_compress, _decompress = zstandard.ZstdCompressor(level=1).compress, zstandard.ZstdDecompressor().decompress


def pack(**cols: np.ndarray) -> bytes:
    hashes, out = [], []
    for x in cols.values():
        if x.ndim == 2 and x.shape[1] <= 8:
            hashes.append(x.tobytes())
        else:
            out.append((np.diff(x, prepend=x[:1] * 0) if x.dtype.itemsize > 1 else x).tobytes())
    n = len(next(iter(cols.values())))
    return b"".join([n.to_bytes(8, "little"), *hashes, _compress(b"".join(out))])


def unpack(blob: bytes, **types) -> dict[str, np.ndarray]:
    """types: dtype, or (dtype, width) of a matrix."""
    kinds = {name: kind if isinstance(kind, tuple) else (kind, 0) for name, kind in types.items()}
    n, at, out = int.from_bytes(blob[:8], "little"), 8, {}
    for name, (kind, width) in kinds.items():
        if 0 < width <= 8:
            out[name] = np.frombuffer(blob, kind, n * width, at).reshape(n, width)
            at += n * width
    raw, at = _decompress(memoryview(blob)[at:]), 0
    for name, (kind, width) in kinds.items():
        if name not in out:
            x = np.frombuffer(raw, kind, n * max(1, width), at)
            at += x.nbytes
            out[name] = x.reshape(n, width) if width else np.cumsum(x, dtype=x.dtype) if x.dtype.itemsize > 1 else x
    return out


def _raw(x: np.ndarray, size: int) -> np.ndarray:
    """The low ``size`` bytes of each number, as a matrix of bytes."""
    return np.ascontiguousarray(x.astype("<u8")).view(np.uint8).reshape(-1, 8)[:, :size]


def _number(x: np.ndarray) -> np.ndarray:
    out = np.zeros((len(x), 8), np.uint8)
    out[:, : x.shape[1]] = x
    return out.view("<u8").ravel()


def _batch(rows: list[tuple[int, int, bytes]]) -> pa.RecordBatch:
    part, kind, blob = zip(*rows, strict=True) if rows else ((), (), ())
    return pa.RecordBatch.from_arrays([pa.array(part, pa.int32()), pa.array(kind, pa.int32()), pa.array(blob, pa.binary())], ["part", "kind", "blob"])


def _split(part: np.ndarray, n: int):
    """(part, indices) for each part that occurs; indices keep their order."""
    order = np.argsort(part.astype(np.uint16) if n <= 1 << 16 else part, kind="stable")
    cuts = np.r_[0, np.cumsum(np.bincount(part, minlength=n))]
    for p in np.flatnonzero(np.diff(cuts)):
        yield int(p), order[cuts[p] : cuts[p + 1]]


def shard(doc: np.ndarray, n: int) -> np.ndarray:
    return (mix(doc.astype(np.int64).view(U64)) % U64(n)).astype(np.int64)


def _least(x: np.ndarray, w: int) -> np.ndarray:
    """Minima of all runs of w values."""
    s, out = 1, x
    while 2 * s <= w:
        out = np.minimum(out[:-s], out[s:])
        s *= 2
    return np.minimum(out[: len(out) - (w - s)], out[w - s :]) if s < w else out


def _spaced(texts: list[bytes]) -> tuple[bytes, np.ndarray, np.ndarray]:
    """(the texts between runs of SIDE zero bytes, start and size of each): contexts reach into the zeros, not into other texts."""
    size = np.array([len(t) for t in texts], np.int64)
    return bytes(SIDE).join([b"", *texts, b""]), SIDE + np.cumsum(size + SIDE) - size - SIDE, size


def _bytes_at(data: bytes, at: np.ndarray, width: int) -> np.ndarray:
    """The ``width`` bytes from each place on, as a matrix."""
    return np.ndarray((len(data) - width + 1,), f"V{width}", data, 0, (1,))[at].view(np.uint8).reshape(-1, width)


def _hash_rows(x: np.ndarray, seed: np.ndarray | int = 0) -> np.ndarray:
    """64 bits of hash of each row of a matrix of bytes, of a width divisible by 8."""
    acc = np.full(len(x), _ODD, U64) + np.asarray(seed, U64)
    for w in x.view("<u8").T:
        acc = (acc ^ w) * _ODD
        acc ^= acc >> U64(32)
    return mix(acc)


_ODD = seeded(1, 31)[0] | U64(1)
_ORDER, _STEP = (seeded(256, 29) >> U64(32)).astype(np.uint32) | np.uint32(1), 0x9E3779B1


def _doubled(g: np.ndarray, w: int) -> np.ndarray:
    """Polynomials of 2 w bytes from those of w bytes, modulo 2**32."""
    return g[:-w] + g[w:] * np.uint32(pow(_STEP, w, 1 << 32))


def _minimizers(pieces: list[tuple]) -> tuple[np.ndarray, ...]:
    """(text, position, hash of the anchor, hash of its context), for pieces (text, where the piece begins in it, first and end of the positions wanted, bytes)."""
    data, start, size = _spaced([x[-1] for x in pieces])
    end = start + size
    four = _doubled(_doubled(_ORDER[np.frombuffer(data, np.uint8)], 1), 2)
    rank = _doubled(_doubled(four, 4), 8)[: len(data) - GRAM + 1] + four[16:] * np.uint32(pow(_STEP, 16, 1 << 32))
    rank ^= rank >> np.uint32(15)
    rank *= np.uint32(0x2C1B3C6D)
    np.maximum(rank, np.uint32(1), out=rank)
    low = _least(rank, WINDOWS)
    low[:SIDE] = 0  # windows that leave their text have no smallest string
    for a, b in zip((end - LENGTH + 1).tolist(), (end + SIDE).tolist(), strict=True):
        low[a:b] = 0
    p = np.flatnonzero(~_least(~low, WINDOWS) == rank[SIDE : len(low)]) + SIDE
    k = np.searchsorted(start, p, "right") - 1
    text, begin, first, stop = (np.array(x, np.int64) for x in list(zip(*pieces, strict=True))[:4])
    pos = p - start[k] + begin[k]
    own = (pos >= first[k]) & (pos < stop[k])
    p, k, pos = p[own], k[own], pos[own]
    x = _bytes_at(data, p - SIDE, CONTEXT)
    lo, hi = np.minimum(p - start[k], SIDE), np.minimum(end[k] - p - GRAM, SIDE)
    return text[k], pos, _hash_rows(_anchor_words(x)), _hash_rows(x, lo * WINDOWS + hi)


def _anchor_words(x: np.ndarray) -> np.ndarray:
    """The anchors of contexts, with zeros behind to a width of 24."""
    out = np.zeros((len(x), 24), np.uint8)
    out[:, :GRAM] = x[:, SIDE : SIDE + GRAM]
    return out


def _all_minimizers(texts: list[bytes]):
    """``_minimizers`` of whole texts, by blocks of about SEGMENT bytes; longer texts are cut."""
    pieces, total = [], 0
    for k, t in enumerate(texts):
        for s in range(0, len(t) if len(t) >= LENGTH else 0, SEGMENT):
            begin = max(0, s - 2 * LENGTH)
            pieces.append((k, begin, s, s + SEGMENT, t[begin : s + SEGMENT + 2 * LENGTH]))
            total += len(pieces[-1][-1])
            if total >= SEGMENT:
                yield _minimizers(pieces)
                pieces, total = [], 0
    if pieces:
        yield _minimizers(pieces)


def anchors(text: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(position, hash of the anchor, hash of its context) for one document."""
    found = [x[1:] for x in _all_minimizers([text])]
    return tuple(np.concatenate(x) for x in zip(*found, strict=True)) if found else (np.zeros(0, np.int64), np.zeros(0, U64), np.zeros(0, U64))


def _shared(key: np.ndarray) -> np.ndarray:
    """The rows, in order, whose key another row may have too: the key's high bits are sorted with the row's number in the low ones."""
    bits = U64(max(1, len(key) - 1).bit_length())
    s = np.sort((key >> bits << bits) | np.arange(len(key), dtype=U64))
    same = s[1:] >> bits == s[:-1] >> bits
    return np.sort((s[np.r_[False, same] | np.r_[same, False]] & ((U64(1) << bits) - U64(1))).astype(np.int64)) if len(s) else np.zeros(0, np.int64)


def _groups(*keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(order by the keys, first index of each group in that order, group of each index in that order)."""
    order = np.lexsort(keys[::-1])
    new = np.ones(len(order), bool)
    if len(order):
        new[1:] = False
        for k in keys:
            new[1:] |= k[order][1:] != k[order][:-1]
    return order, np.flatnonzero(new), np.cumsum(new) - 1


def _repeated(h: np.ndarray, c: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """Which anchors have a context that a smaller document among these repeats."""
    out = np.zeros(len(h), bool)
    some = _shared((h ^ (c * _ODD)) * _ODD)
    if len(some):
        order, first, group = _groups(h[some], c[some])
        order = some[order]
        out[order] = doc[order] > np.minimum.reduceat(doc[order], first)[group]
    return out


def _by_place(doc: np.ndarray, pos: np.ndarray) -> np.ndarray:
    if len(doc) and int(doc.max()) - int(doc.min()) < 1 << 31:
        return np.argsort(((doc - doc.min()) << 32) + pos)
    return np.lexsort((pos, doc))


def _covered(cols: dict, at: np.ndarray, mask, n: int, kind: int = COVERED) -> list[tuple[int, int, bytes]]:
    """Rows that send (doc, tag, pos, mask) to the shards of their documents."""
    at, mask = (x[_by_place(cols["doc"][at], cols["pos"][at])] for x in (at, np.broadcast_to(np.asarray(mask, "<u4"), at.shape)))
    doc, tag, pos = (cols[k][at] for k in ("doc", "tag", "pos"))
    return [(p, kind, pack(doc=doc[i], tag=tag[i], pos=pos[i], mask=mask[i])) for p, i in _split(shard(doc, n), n)]


COVER_TYPES = {"doc": "<i8", "tag": "<u4", "pos": "<i4", "mask": "<u4"}
ANCHOR_TYPES = {"doc": "<i8", "tag": "<u4", "pos": "<i4", "h": ("u1", 6), "c": ("u1", 6)}
CONTEXT = GRAM + 2 * SIDE
CONTEXT_TYPES = {"doc": "<i8", "tag": "<u4", "pos": "<i4", "lo": "u1", "hi": "u1", "x": ("u1", CONTEXT)}


def _flushes(batches):
    """(doc ids, texts) of about FLUSH_BYTES each."""
    docs, texts, size = [], [], 0
    for b in batches:
        for d, t in zip(b.column("doc_id").to_pylist(), b.column("text").cast(pa.binary()).to_pylist(), strict=True):
            docs.append(d)
            texts.append(t or b"")
            size += len(texts[-1])
            if size >= FLUSH_BYTES:
                yield docs, texts
                docs, texts, size = [], [], 0
    if docs:
        yield docs, texts


def _sample(n: int):
    """Pass 1, map side: the anchors of a flush, by part; those settled here as covered."""

    def run(batches):
        for docs, texts in _flushes(batches):
            ids = np.array([0 if d is None else d for d in docs], "<i8")
            tags = np.array([zlib.crc32(t) for t in texts], "<u4")
            found = list(_all_minimizers([b"" if d is None else t for d, t in zip(docs, texts, strict=True)]))
            if not found:
                continue
            k, pos, h, c = (np.concatenate(x) for x in zip(*found, strict=True))
            found.clear()
            a = {"doc": ids[k], "tag": tags[k], "pos": pos.astype("<i4"), "h": h, "c": c}
            done = _repeated(a["h"], a["c"], a["doc"])
            # what is settled travels with the anchors, spread over the parts, and is only passed on there
            rows = _covered(a, np.flatnonzero(done), ALL, n)
            left = np.flatnonzero(~done)
            for p, i in _split((h[left] % U64(n)).astype(np.int64), n):
                i = left[i]
                rows.append((p, ANCHORS, pack(doc=a["doc"][i], tag=a["tag"][i], pos=a["pos"][i], h=_raw(h[i] >> U64(16), 6), c=_raw(c[i], 6))))
            yield _batch(rows)

    return run


def _settle(n: int, hot: int):
    """Pass 1, reduce side: covered anchors, and those whose contexts are wanted."""

    def run(batches):
        blobs: list[dict] = []
        passed: dict[int, list[dict]] = {}
        for b in batches:
            for part, kind, blob in zip(*(b.column(c).to_pylist() for c in ("part", "kind", "blob")), strict=True):
                if kind == COVERED:  # its part is its document's shard already
                    passed.setdefault(part, []).append(unpack(blob, **COVER_TYPES))
                else:
                    blobs.append(unpack(blob, **ANCHOR_TYPES))
        for part in list(passed):
            yield _batch([_as_one(part, passed.pop(part))])
        if not blobs:
            return
        a = {k: np.concatenate([x[k] for x in blobs]) for k in ANCHOR_TYPES}
        blobs.clear()
        h, c = _number(a.pop("h")), _number(a.pop("c"))
        some = _shared(h * _ODD)
        if not len(some):
            return
        order, first, group = _groups(h[some], c[some])
        order = some[order]
        done = a["doc"][order] > np.minimum.reduceat(a["doc"][order], first)[group]
        rows = _covered(a, order[done], ALL, n)
        order = order[~done]
        hs, cs, ds = h[order], c[order], a["doc"][order]
        hfirst = np.flatnonzero(np.r_[True, hs[1:] != hs[:-1]])
        sizes = np.diff(np.r_[hfirst, len(hs)])
        contexts = np.add.reduceat(np.r_[True, (hs[1:] != hs[:-1]) | (cs[1:] != cs[:-1])].astype(np.int64), hfirst)
        wanted = np.repeat((np.minimum.reduceat(ds, hfirst) != np.maximum.reduceat(ds, hfirst)) & (contexts > 1), sizes)
        many = np.repeat(contexts > hot, sizes)
        rows += _covered(a, order[wanted & ~many], 0, n, WANTED) + _covered(a, order[wanted & many], 0, n, HOT)
        yield _batch(rows)

    return run


def _as_one(part: int, blobs: list[dict]) -> tuple[int, int, bytes]:
    """What is covered in one shard, in one row."""
    return part, COVERED, pack(**{k: np.concatenate([x[k] for x in blobs]) for k in COVER_TYPES})


def _texts(n: int):
    """The texts of a flush, packed by the shard of their documents."""

    def run(batches):
        for docs, texts in _flushes(batches):
            ids = np.array([0 if d is None else d for d in docs], np.int64)
            rows = []
            for p, i in _split(shard(ids, n), n):
                part = [texts[k] for k in i]
                head = np.array([len(i), *(v for k in i for v in (docs[k] is None, ids[k], len(texts[k])))], "<i8").tobytes()
                rows.append((p, TEXTS, zstandard.ZstdCompressor(level=1).compress(head + b"".join(part))))
            yield _batch(rows)

    return run


def _open_texts(blob: bytes):
    raw = zstandard.ZstdDecompressor().decompress(blob)
    m = int(np.frombuffer(raw, "<i8", 1)[0])
    head = np.frombuffer(raw, "<i8", 3 * m, 8).reshape(m, 3)
    at = 8 + 24 * m
    for null, doc, size in head.tolist():
        yield None if null else doc, raw[at : at + size]
        at += size


class _Told:
    """The covered or wanted places of a shard's documents, found by document and tag."""

    def __init__(self, blobs: list[dict]):
        c = {k: np.concatenate([x[k] for x in blobs]) if blobs else np.zeros(0, t) for k, t in COVER_TYPES.items()}
        order = _by_place(c["doc"], c["pos"])
        self.cols = {k: v[order] for k, v in c.items()}

    def of(self, docs: list[int | None], tags: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(number of the document, position, mask) of all that is told of these documents."""
        ids, known = np.array([0 if d is None else d for d in docs], np.int64), np.array([d is not None for d in docs])
        lo = np.searchsorted(self.cols["doc"], ids, "left")
        count = np.where(known, np.searchsorted(self.cols["doc"], ids, "right") - lo, 0)
        k = np.repeat(np.arange(len(docs)), count)
        at = np.arange(len(k)) + np.repeat(lo - (np.cumsum(count) - count), count)
        own = self.cols["tag"][at] == tags[k]  # of rows that repeat a doc_id, the one with this text
        return k[own], self.cols["pos"][at[own]].astype(np.int64), self.cols["mask"][at[own]]


def _told_first(batches, *kinds: int):
    """(what is told of each kind, texts' blob): rows come sorted by kind, so all that is told stands before the texts."""
    told, seen = {k: [] for k in kinds}, None
    for b in batches:
        for kind, blob in zip(b.column("kind").to_pylist(), b.column("blob").to_pylist(), strict=True):
            if kind == TEXTS:
                if seen is None:
                    seen = [_Told(told.pop(k)) for k in kinds]
                yield seen, blob
            else:
                told[kind].append(unpack(blob, **COVER_TYPES))


def _blocks(batches, *kinds: int):
    """(what is told of each kind, ids, texts, tags) for about BLOCK bytes of texts at once."""
    docs, texts, size, told = [], [], 0, None
    for told, blob in _told_first(batches, *kinds):
        for doc, text in _open_texts(blob):
            docs.append(doc)
            texts.append(text)
            size += len(text)
        if size >= BLOCK:
            yield told, docs, texts, np.array([zlib.crc32(t) for t in texts], "<u4")
            docs, texts, size = [], [], 0
    if docs:
        yield told, docs, texts, np.array([zlib.crc32(t) for t in texts], "<u4")


STRING_TYPES = {"doc": "<i8", "tag": "<u4", "pos": "<i4", "j": "u1", "w1": ("u1", 8), "w2": ("u1", 8)}


def _string_cover(a: dict, at: np.ndarray, n: int) -> list[tuple[int, int, bytes]]:
    return _covered(a, at, np.left_shift(1, a["j"][at].astype(np.int64)), n)


def _context_rows(a: dict, n: int) -> list[tuple[int, int, bytes]]:
    """Contexts, packed by anchor."""
    part = (_hash_rows(_anchor_words(a["x"])) % U64(n)).astype(np.int64)
    return [(p, CONTEXTS, pack(**{k: a[k][i] for k in CONTEXT_TYPES})) for p, i in _split(part, n)]


def _string_rows(cols: list[dict], n: int) -> list[tuple[int, int, bytes]]:
    """Strings, packed by hash; those settled here as covered."""
    a = {k: np.concatenate([x[k] for x in cols]) for k in STRING_TYPES}
    done = _repeated(a["w1"], a["w2"], a["doc"])
    rows = _string_cover(a, np.flatnonzero(done), n)
    left = np.flatnonzero(~done)
    for p, i in _split((a["w1"][left] % U64(n)).astype(np.int64), n):
        i = left[i]
        rows.append((p, STRING, pack(doc=a["doc"][i], tag=a["tag"][i], pos=a["pos"][i], j=a["j"][i], w1=_raw(a["w1"][i], 8), w2=_raw(a["w2"][i], 8))))
    return rows


def _windows(x: np.ndarray, table: np.ndarray = BYTE) -> np.ndarray:
    """Hash of each 50-byte string through the anchors of contexts."""
    prefix = np.zeros((len(x), CONTEXT + 1), U64)
    pw, ipw = powers(CONTEXT + 1)
    np.cumsum(table[x] * pw[:CONTEXT], axis=1, out=prefix[:, 1:])
    return mix((prefix[:, LENGTH:] - prefix[:, :WINDOWS]) * ipw[:WINDOWS])


def _inside(lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """Which of those strings do not leave the document."""
    j = np.arange(WINDOWS)
    return (j >= SIDE - lo.astype(int)[:, None]) & (j <= hi.astype(int)[:, None])


def _strings(a: dict):
    """The 50-byte strings through anchors, of 2,048 contexts at once."""
    for i in range(0, len(a["pos"]), 1 << 11):
        b = {k: v[i : i + (1 << 11)] for k, v in a.items()}
        k, j = np.nonzero(_inside(b["lo"], b["hi"]))
        yield {**{name: b[name][k] for name in ("doc", "tag", "pos")}, "j": j.astype("u1"), "w1": _windows(b["x"])[k, j], "w2": _windows(b["x"], _BYTE2)[k, j]}


def _contexts(n: int):
    """Pass 2, map side: the wanted contexts, by anchor; of hot anchors the 50-byte strings, by hash."""

    def run(batches):
        cols, strings, n_cols, n_strings = [], [], 0, 0
        for told, docs, texts, tags in _blocks(batches, WANTED, HOT):
            data, start, size = _spaced(texts)
            ids, places = np.array([0 if d is None else d for d in docs], "<i8"), []
            for x in told:
                k, pos, _ = x.of(docs, tags)
                place = np.unique((k << 32) + pos)  # rows that repeat a document are told twice
                k, pos = place >> 32, place & 0xFFFFFFFF
                places.append({"doc": ids[k], "tag": tags[k], "pos": pos.astype("<i4"), "lo": np.minimum(pos, SIDE).astype("u1"), "hi": np.minimum(size[k] - pos - GRAM, SIDE).astype("u1"), "x": _bytes_at(data, start[k] + pos - SIDE, CONTEXT)} if len(k) else None)
            wanted, hot = places
            if wanted:
                cols.append(wanted)
                n_cols += len(wanted["pos"])
            for got in _strings(hot) if hot else ():
                strings.append(got)
                n_strings += len(got["pos"])
                if n_strings >= 1 << 19:
                    yield _batch(_string_rows(strings, n))
                    strings, n_strings = [], 0
            if n_cols >= 120_000:
                yield _batch(_context_rows({k: np.concatenate([x[k] for x in cols]) for k in CONTEXT_TYPES}, n))
                cols, n_cols = [], 0
        if n_cols:
            yield _batch(_context_rows({k: np.concatenate([x[k] for x in cols]) for k in CONTEXT_TYPES}, n))
        if n_strings:
            yield _batch(_string_rows(strings, n))

    return run


class Family:
    """Suffix arrays over one task's contexts: one for each level, level sizes growing geometrically.

    A level is an array of context numbers in the order of the ``LENGTH`` bytes from the anchor on.
    Two of them, both in order, are merged; in the runs of the merged array that share the anchor
    and hold something new, contexts are compared byte by byte on both sides of the anchor: each
    with each in short runs, in long ones each string with the smallest document's of the same hash.
    """

    def __init__(self, x: np.ndarray, lo: np.ndarray, hi: np.ndarray, doc: np.ndarray):
        n = len(x)
        right = np.zeros((n, 56), np.uint8)
        right[:, :LENGTH] = x[:, SIDE:]
        self.words = right.view(">u8").astype(U64)
        self.doc, self.x, self.lo, self.hi = doc, x, lo.astype(np.int64), hi.astype(np.int64)
        self.text = np.ascontiguousarray(right).view("S56").ravel()
        #: A bit for each 50-byte string through the anchor that a smaller document holds.
        self.mask = np.zeros(n, np.uint32)
        self.levels: list[np.ndarray] = []

    @property
    def found(self) -> np.ndarray:
        return (self.mask[:, None] >> np.arange(WINDOWS, dtype=np.uint32) & np.uint32(1)).astype(bool)

    def suffix_array(self, members: np.ndarray) -> np.ndarray:
        return members[np.lexsort(self.words[members].T[::-1])]

    def merge(self, level: np.ndarray, batch: np.ndarray) -> np.ndarray:
        """Two suffix arrays as one."""
        return np.insert(level, np.searchsorted(self.text[level], self.text[batch]), batch)

    def scan(self, level: np.ndarray, batch: np.ndarray) -> None:
        """Marks the strings that a smaller document of ``level`` or ``batch`` holds, where one of the two is of ``batch``."""
        merged = level if level is batch else self.merge(level, batch)
        new = np.zeros(len(self.doc), bool)
        new[batch] = True
        w = self.words[merged]
        same = (w[1:, 0] == w[:-1, 0]) & (w[1:, 1] == w[:-1, 1]) & ((w[1:, 2] >> U64(32)) == (w[:-1, 2] >> U64(32)))
        first = np.flatnonzero(np.r_[True, ~same])
        sizes = np.diff(np.r_[first, len(merged)])
        docs = self.doc[merged]
        open_ = (np.minimum.reduceat(docs, first) != np.maximum.reduceat(docs, first)) & np.logical_or.reduceat(new[merged], first)
        short = open_ & (sizes <= NEIGHBOURS)
        self._neighbours(merged, first[short], sizes[short])
        first, sizes = first[open_ & ~short], sizes[open_ & ~short]
        i, ends = 0, np.cumsum(sizes)
        while i < len(first):  # whole runs at once
            j = max(i + 1, int(np.searchsorted(ends, ends[i] - sizes[i] + SORTED, "right")))
            self._sorted(merged[_ranges(first[i:j], sizes[i:j])], np.repeat(np.arange(j - i), sizes[i:j]))
            i = j

    def _neighbours(self, merged: np.ndarray, first: np.ndarray, sizes: np.ndarray) -> None:
        """Each of a run with each."""
        for s in range(1, NEIGHBOURS):
            first, sizes = first[sizes > s], sizes[sizes > s]
            at = _ranges(first, sizes - s)
            a, b = merged[at], merged[at + s]
            for p, q in ((a, b), (b, a)):  # in each of the two a context stands at most once as p and as q
                earlier = self.doc[p] < self.doc[q]
                p, q = p[earlier], q[earlier]
                for i in range(0, len(p), 1 << 15):
                    self._compare(p[i : i + (1 << 15)], q[i : i + (1 << 15)])

    def _compare(self, p: np.ndarray, q: np.ndarray) -> None:
        """Marks the strings of ``q`` that ``p``, with the same anchor, holds: those between the ends of what the two agree in."""
        differ = self.x[p] != self.x[q]
        left, right = differ[:, SIDE - 1 :: -1], differ[:, SIDE + GRAM :]
        left, right = (np.where(v.any(axis=1), v.argmax(axis=1), SIDE) for v in (left, right))
        left, right = np.minimum(left, np.minimum(self.lo[p], self.lo[q])), np.minimum(right, np.minimum(self.hi[p], self.hi[q]))
        some = left + right >= SIDE
        left, right = left[some], right[some]
        self.mask[q[some]] |= ((np.int64(2) << right) - (np.int64(1) << (SIDE - left))).astype(np.uint32)

    def _sorted(self, rows: np.ndarray, run: np.ndarray) -> None:
        """Strings of whole runs, by their hashes.  One already found has a smaller document in the family that holds it, so it is left out."""
        k, col = np.nonzero(_inside(self.lo[rows], self.hi[rows]) & ~self.found[rows])
        if not len(k):
            return
        key = _windows(self.x[rows])[k, col] + mix(run.astype(U64))[k]
        order = np.argsort(key)
        key, row, col = key[order], rows[k[order]], col[order]
        new = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
        d = self.doc[row]
        sizes = np.diff(np.r_[new, len(key)])
        hit = d > np.repeat(np.minimum.reduceat(d, new), sizes)
        # the bytes decide: every hit is compared with the string of the smallest document
        whose = np.flatnonzero(~hit)
        of = np.repeat(whose[np.searchsorted(whose, new)], sizes)[hit]
        at = np.flatnonzero(hit)
        strings = np.lib.stride_tricks.sliding_window_view(self.x, LENGTH, axis=1)
        for i in range(0, len(at), 1 << 16):
            p, q = at[i : i + (1 << 16)], of[i : i + (1 << 16)]
            p = p[(strings[row[p], col[p]] == strings[row[q], col[q]]).all(axis=1)]
            np.bitwise_or.at(self.mask, row[p], np.uint32(1) << col[p].astype(np.uint32))

    def add(self, members: np.ndarray) -> None:
        batch = self.suffix_array(members)
        self.scan(batch, batch)
        for level in self.levels:
            self.scan(level, batch)
        self.levels.append(batch)
        while len(self.levels) > 1 and len(self.levels[-2]) <= 2 * len(self.levels[-1]):
            last = self.levels.pop()
            self.levels[-1] = self.merge(self.levels[-1], last)


def _ranges(first: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The numbers first, first + 1, ... of each range, one after the other."""
    return np.arange(int(sizes.sum())) + np.repeat(first - (np.cumsum(sizes) - sizes), sizes)


def _found(blobs: list[bytes], n: int) -> list[tuple[int, int, bytes]]:
    """What the family over a task's contexts finds."""
    a = [unpack(x, **CONTEXT_TYPES) for x in blobs]
    a = {k: np.concatenate([x[k] for x in a]) for k in CONTEXT_TYPES}
    order = np.argsort(a["doc"], kind="stable")
    a = {k: v[order] for k, v in a.items()}
    family = Family(a["x"], a["lo"], a["hi"], a["doc"])
    i = 0
    while i < len(order):  # batches end between documents
        j = int(np.searchsorted(a["doc"], a["doc"][min(i + BATCH, len(order)) - 1], side="right"))
        family.add(np.arange(i, j))
        i = j
    hit = np.flatnonzero(family.mask)
    return _covered(a, hit, family.mask[hit], n)


def _match(n: int):
    """Pass 2, reduce side: the family over a task's contexts; strings of hot anchors that a smaller document holds."""

    def run(batches):
        contexts, strings = [], []
        passed: dict[int, list[dict]] = {}
        for b in batches:
            for part, kind, blob in zip(*(b.column(c).to_pylist() for c in ("part", "kind", "blob")), strict=True):
                if kind == COVERED:  # its part is its document's shard already
                    passed.setdefault(part, []).append(unpack(blob, **COVER_TYPES))
                else:
                    (contexts if kind == CONTEXTS else strings).append(blob)
        for part in list(passed):
            yield _batch([_as_one(part, passed.pop(part))])
        if contexts:
            yield _batch(_found(contexts, n))
            contexts.clear()
        if strings:
            a = [unpack(x, **STRING_TYPES) for x in strings]
            a = {k: np.concatenate([x[k] for x in a]) for k in STRING_TYPES}
            done = _repeated(_number(a["w1"]), _number(a["w2"]), a["doc"])
            yield _batch(_string_cover(a, np.flatnonzero(done), n))

    return run


RESULT = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"


def _spans(k: np.ndarray, pos: np.ndarray, mask: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document, start, end) of the maximal removed runs.  Strings through one anchor overlap, so the first and the last bound what they cover."""
    high = np.frexp(mask.astype(float))[1] - 1
    low = np.frexp((mask & (~mask + np.uint32(1))).astype(float))[1] - 1
    start, last = np.maximum(pos - SIDE + low, 0), np.minimum(pos - SIDE + high, size[k] - LENGTH)
    some = start <= last
    # on one axis, with a byte between documents
    base = np.cumsum(size + 1) - size - 1
    k, start, end = k[some], (base[k] + start)[some], (base[k] + last)[some] + LENGTH
    order = np.argsort(start)
    k, start, end = k[order], start[order], np.maximum.accumulate(end[order])
    first = np.flatnonzero(np.r_[True, start[1:] > end[:-1]]) if len(k) else np.zeros(0, np.int64)
    k, start, end = k[first], start[first], end[np.r_[first[1:], len(end)] - 1] if len(first) else end
    return k, start - base[k], end - base[k]


def _result(with_text: bool):
    def run(batches):
        for (told,), docs, texts, tags in _blocks(batches, COVERED):
            size = np.array([len(t) for t in texts], np.int64)
            k, start, end = _spans(*told.of(docs, tags), size)
            removed, spans = (np.bincount(k, weights=w, minlength=len(docs)).astype(np.int64).tolist() for w in (end - start, None))
            start, end, kept, at = start.tolist(), end.tolist(), [], 0
            for text, n in zip(texts, spans, strict=True):
                if n:
                    cuts = zip([0, *end[at : at + n]], [*start[at : at + n], len(text)], strict=True)
                    text, at = b"".join([text[a:b] for a, b in cuts]), at + n
                kept.append(text)
            cols = [docs, size, removed, spans, [hashlib.sha256(t).hexdigest() for t in kept], *([[t.decode("utf-8", "replace") for t in kept]] if with_text else [])]
            types = [pa.int64()] * 4 + [pa.string()] * 2
            names = [c.split()[0] for c in RESULT.split(", ")] + ["kept"]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], names[: 5 + with_text])

    return run


def remove_repeats(docs: DataFrame, with_text: bool = False, hot_contexts: int = HOT_CONTEXTS) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 and, if wanted, the kept text (split characters replaced)."""
    spark = docs.sparkSession
    small_batches(spark)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    total = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = max(partitions(spark), -(-total // TASK_BYTES))
    sampled = docs.mapInArrow(_sample(n), ROWS).repartitionById(n, F.col("part"))
    settled = staged(sampled.mapInArrow(_settle(n, hot_contexts), ROWS), "settled")

    def with_texts(told: DataFrame) -> DataFrame:
        return docs.mapInArrow(_texts(n), ROWS).unionByName(told).repartitionById(n, F.col("part")).sortWithinPartitions("kind")

    wanted = with_texts(settled.where(F.col("kind").isin(WANTED, HOT)))
    contexts = wanted.mapInArrow(_contexts(n), ROWS).repartitionById(n, F.col("part"))
    matched = staged(contexts.mapInArrow(_match(n), ROWS), "matched")
    told = settled.where(F.col("kind") == COVERED).unionByName(matched)
    return with_texts(told).mapInArrow(_result(with_text), RESULT + ", kept string" * with_text)
