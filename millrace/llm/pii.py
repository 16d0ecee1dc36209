"""Personal data in texts: fixed patterns, and a linear-chain conditional random field for forms that they miss.

Tokens are runs of letters, runs of digits and single other characters.  The field's
features are word shapes only: the shapes of a token and of its two neighbours on each side,
pairs of adjacent shapes, and how many digits stand nearby.  It is trained from a small
labelled table (``labelled_table``) by maximum likelihood and decoded by Viterbi over windows of
tokens in numpy batches; neighbouring windows overlap, and only the middle of each counts.

Spans of the field are added where they touch no pattern span of any kind and hold what
their kind needs, between characters that are neither letters nor digits: an ``@`` or a spelt-out one with a dot for an e-mail address, four numbers up to 255 for an
IP address, 13 to 19 digits that pass the Luhn check for a card, 7 to 15 digits for a phone number.

Defined results: null text counts as empty and has no spans; a text of any length is taken whole; an empty table gives
no rows; rows may repeat; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm.common import small_batches

KINDS = ("email", "ip", "card", "phone")
STATES = len(KINDS) + 1  # 0: none

# Patterns, fixed values of the contract. Leftmost matches of [0-9]+ begin where no digit stands before; an e-mail address is sought around each @.
_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
_CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DIGIT = re.compile("[0-9]")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        v = int(c) * (1 + i % 2)
        total += v - 9 * (v > 9)
    return total % 10 == 0


def _digits(text: str) -> str:
    return "".join(_DIGIT.findall(text))


def _emails(text: str) -> list[tuple[int, int]]:
    out, end, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > end and text[start - 1] in _LOCAL:
            start -= 1
        m = _DOMAIN.match(text, at) if start < at else None
        if m:
            out.append((start, m.end()))
            end = m.end()
        at = text.find("@", max(at + 1, end if m else 0))
    return out


def base_spans(text: str) -> dict[str, list[tuple[int, int]]]:
    """The pattern spans of each kind; failing matches are dropped and not tried again."""
    out: dict[str, list[tuple[int, int]]] = {k: [] for k in KINDS}
    if "@" in text:
        out["email"] = _emails(text)
    if _DIGIT.search(text):
        out["ip"] = [m.span() for m in _IP.finditer(text) if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m.group().split("."))]
        out["card"] = [m.span() for m in _CARD.finditer(text) if 13 <= len(d := _digits(m.group())) <= 19 and luhn(d)]
        if "+" in text:
            out["phone"] = [m.span() for m in _PHONE.finditer(text) if 9 <= len(_digits(m.group())) <= 15]
    return out


# Shapes.
MARKS = "@.-+()_/:,[]#%"
N_BASE = 1 + 16 + 1 + 2 + 9 + len(MARKS) + 1
CODES = N_BASE * 3  # with what stands before: nothing, space, line end
_CLASS = np.full(128, 3, np.uint8)
_CLASS[[9, 11, 12, 13, 32]] = 0
_CLASS[10] = 4
_CLASS[48:58] = 2
_CLASS[65:91] = _CLASS[97:123] = 1
_MARK = np.full(128, len(MARKS), np.uint8)
_MARK[[ord(c) for c in MARKS]] = np.arange(len(MARKS))
_DIGIT_LEN = np.array([0, 0, 1, 2, 3, 4, 5, 5, 5, 6, 6, 6, 6, *[7] * 7, 8])
PAD, CONTEXT, STRIDE = 12, 12, 72


def tokens(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, shape code, number of digits) of the tokens of one text's code points."""
    low = codes < 128
    small = np.where(low, codes, 0).astype(np.uint8)
    kind = np.where(low, _CLASS[small], 1)
    begin = np.ones(len(codes), bool)
    begin[1:] = (kind[1:] != kind[:-1]) | (kind[1:] == 3)
    begin &= (kind != 0) & (kind != 4)
    start = np.flatnonzero(begin)
    if not len(start):
        return start, start, start, start
    change = np.flatnonzero(np.r_[True, (kind[1:] != kind[:-1]) | (kind[1:] == 3)])
    stops = np.r_[change[1:], len(codes)]
    end = stops[np.searchsorted(change, start)]
    k, size = kind[start], end - start
    upper = np.r_[0, np.cumsum((codes >= 65) & (codes <= 90))]
    foreign = np.r_[0, np.cumsum(~low)]
    n_upper, n_foreign = upper[end] - upper[start], foreign[end] - foreign[start]
    first_upper = (codes[start] >= 65) & (codes[start] <= 90)
    case = np.where(n_upper == 0, 0, np.where(n_upper == size, 2, np.where(first_upper & (n_upper == 1), 1, 3)))
    shape = 1 + np.where(size >= 6, 3, np.where(size >= 3, 2, size - 1)) * 4 + case
    shape = np.where(n_foreign > 0, 17, shape)
    folded = np.where((codes >= 65) & (codes <= 90), codes + 32, codes)
    nxt = np.minimum(start + 1, len(codes) - 1)
    nxt2 = np.minimum(start + 2, len(codes) - 1)
    shape = np.where((k == 1) & (size == 2) & (folded[start] == 97) & (folded[nxt] == 116), 18, shape)  # at
    shape = np.where((k == 1) & (size == 3) & (folded[start] == 100) & (folded[nxt] == 111) & (folded[nxt2] == 116), 19, shape)  # dot
    shape = np.where(k == 2, 20 + _DIGIT_LEN[np.minimum(size, 20)], shape)
    shape = np.where(k == 3, 29 + _MARK[small[start]], shape)
    gap = np.where(start == 0, 2, 0)
    before = kind[np.maximum(start - 1, 0)]
    gap = np.where(start > 0, np.where(before == 4, 2, np.where(before == 0, 1, 0)), gap)
    return start, end, (shape * 3 + gap).astype(np.int32), np.where(k == 2, size, 0)


@dataclass
class Field:
    near: np.ndarray  # 5 x CODES x STATES
    pair: np.ndarray  # 2 x CODES**2 x STATES
    dense: np.ndarray  # 16 x STATES
    step: np.ndarray  # STATES x STATES

    @staticmethod
    def zeros() -> Field:
        return Field(np.zeros((5, CODES, STATES)), np.zeros((2, CODES * CODES, STATES)), np.zeros((16, STATES)), np.zeros((STATES, STATES)))

    @staticmethod
    def index(code: np.ndarray, digits: np.ndarray):
        """What the emissions of a stream of tokens look up."""
        p = np.r_[0, 0, code, 0, 0]
        n = len(code)
        near = [p[i : i + n] for i in range(5)]
        pair = [near[1] * CODES + near[2], near[2] * CODES + near[3]]
        c = np.r_[0, np.cumsum(np.minimum(digits, 20))]
        at = np.arange(n)
        dense = np.minimum(c[np.minimum(at + 5, n)] - c[np.maximum(at - 4, 0)], 15)
        return near, pair, dense

    def emissions(self, code: np.ndarray, digits: np.ndarray) -> np.ndarray:
        near, pair, dense = self.index(code, digits)
        out = self.dense[dense]
        for i in range(5):
            out = out + self.near[i][near[i]]
        for i in range(2):
            out += self.pair[i][pair[i]]
        return out

    def decode(self, code: np.ndarray, digits: np.ndarray) -> np.ndarray:
        """The states of a stream, by Viterbi over overlapping windows, all windows at once."""
        n = len(code)
        windows = -(-n // STRIDE)
        width = STRIDE + 2 * CONTEXT
        total = windows * STRIDE + 2 * CONTEXT
        e = np.zeros((total, STATES), np.float32)
        e[CONTEXT : CONTEXT + n] = self.emissions(code, digits)
        at = np.arange(width)[:, None] + np.arange(windows) * STRIDE
        step = self.step.astype(np.float32)
        best = e[at[0]]
        back = np.zeros((width, windows, STATES), np.int8)
        for t in range(1, width):
            ways = best[:, :, None] + step
            back[t] = ways.argmax(axis=1)
            best = ways.max(axis=1) + e[at[t]]
        path = np.zeros((width, windows), np.int8)
        path[-1] = best.argmax(axis=1)
        rows = np.arange(windows)
        for t in range(width - 1, 0, -1):
            path[t - 1] = back[t, rows, path[t]]
        return path[CONTEXT:-CONTEXT].T.ravel()[:n]


def _stream(texts: list[str]):
    """The tokens of many texts as one stream, with boundary tokens between them."""
    code, digits, where = [], [], []
    at = 0
    gap = np.zeros(PAD, np.int32)
    for text in texts:
        s, e, c, d = tokens(np.frombuffer(text.encode("utf-32-le"), "<u4"))
        where.append((at, s, e))
        code += [c, gap]
        digits += [d, gap]
        at += len(c) + PAD
    return np.concatenate(code), np.concatenate(digits), where


def _valid(kind: str, text: str) -> bool:
    d = _digits(text)
    if kind == "email":
        low = text.lower()
        return ("@" in text or re.search(r"\bat\b", low) is not None) and ("." in text or re.search(r"\bdot\b", low) is not None) and any(c.isalpha() for c in text)
    if kind == "ip":
        parts = re.findall("[0-9]+", text)
        return len(parts) == 4 and all(len(p) <= 3 and int(p) <= 255 for p in parts)
    if kind == "card":
        return 13 <= len(d) <= 19 and luhn(d)
    return 7 <= len(d) <= 15


def find(texts: list[str], field: Field) -> list[tuple[dict[str, list[tuple[int, int]]], list[tuple[str, int, int]]]]:
    """For each text: the pattern spans, and all spans with the field's, ordered by kind and start."""
    base = [base_spans(t) for t in texts]
    added: list[list[tuple[str, int, int]]] = [[] for _ in texts]
    if texts:
        code, digits, where = _stream(texts)
        path = field.decode(code, digits)
        hit = np.flatnonzero(path)
        firsts = np.array([w[0] for w in where])
        begin = np.flatnonzero(np.r_[True, (np.diff(hit) != 1) | (path[hit][1:] != path[hit][:-1])]) if len(hit) else []
        for i, b in enumerate(begin):
            e = begin[i + 1] if i + 1 < len(begin) else len(hit)
            doc = int(np.searchsorted(firsts, hit[b], side="right")) - 1
            at, s, end = where[doc]
            lo, hi = hit[b] - at, hit[e - 1] - at
            if hi >= len(s):
                continue
            x, y, kind = int(s[lo]), int(end[hi]), KINDS[path[hit[b]] - 1]
            edge = texts[doc][x - 1 : x] + texts[doc][y : y + 1]
            if not any(c.isalnum() for c in edge) and _valid(kind, texts[doc][x:y]) and all(y <= p or x >= q for spans in base[doc].values() for p, q in spans):
                added[doc].append((kind, x, y))
    out = []
    for b, a in zip(base, added, strict=True):
        spans = [(k, s, e) for k in KINDS for s, e in b[k]] + a
        out.append((b, sorted(spans, key=lambda x: (KINDS.index(x[0]), x[1], x[2]))))
    return out


# Training.
def labelled_rows(n: int = 600, seed: int = 5) -> list[tuple[str, list[tuple[str, int, int]]]]:
    """Short invented texts with the spans of personal data in them, made from templates with a fixed seed."""
    rng = np.random.default_rng(seed)
    pick = lambda *x: x[int(rng.integers(len(x)))]
    num = lambda k: "".join(str(int(v)) for v in rng.integers(0, 10, k))
    octet = lambda: str(int(rng.integers(0, 256)))

    def word():
        w = "".join(pick("ar", "en", "ti", "on", "le", "s", "th", "é", "ou", "ch", "ma", "r") for _ in range(int(rng.integers(1, 5))))
        return pick(w, w, w, w, w.capitalize(), w.upper())

    def card():
        body = num(15)
        return next(body + str(c) for c in range(10) if luhn(body + str(c)))

    def phone():
        a, b, c = num(3), num(3), num(4)
        return pick(f"({a}) {b}-{c}", f"{a}-{b}-{c}", f"{a}.{b}.{c}", f"{a} {b} {c}", f"+{num(1)} {a} {b} {c}", f"+{num(2)}-{a}-{b}-{c}", f"00{num(2)} {a} {b}{c}", f"+{num(1)} ({a}) {b}-{c}")

    def email():
        u, h, d = word().lower(), word().lower(), pick("com", "org", "net", "example.com")
        return pick(f"{u}@{h}.{d}", f"{u}.{num(2)}@{h}.{d}", f"{u} [at] {h} [dot] com", f"{u} at {h} dot {d}", f"{u} (at) {h} (dot) org", f"{u} @ {h} . {d}")

    def cards():
        c = card()
        return pick(c, " ".join(c[i : i + 4] for i in range(0, 16, 4)), "-".join(c[i : i + 4] for i in range(0, 16, 4)), ".".join(c[i : i + 4] for i in range(0, 16, 4)), "/".join(c[i : i + 4] for i in range(0, 16, 4)))

    def ip():
        p = [octet() for _ in range(4)]
        return pick(".".join(p), ".".join(p), " . ".join(p), "[.]".join(p))

    def clean():
        return pick(f"{num(1)}.{num(1)}", f"20{num(2)}-0{num(1)}-1{num(1)}", f"${num(1)},{num(3)}.{num(2)}", f"{num(2)}:{num(2)}", num(int(rng.integers(1, 7))), f"v{num(1)}.{num(1)}.{num(1)}", f"{num(2)}%", f"({num(4)})", f"{word()}/{word()}", f"{word()} at {word()}", f"[{num(1)}]", f"#{num(3)}", f"{num(2)}-{num(2)}", f"{word()}_{num(6)}", word() + "***", "|", f"{num(24)}", f"{num(4)}c{num(3)}d{num(12)}f{num(5)}", *hard())

    def hard():
        """What looks like personal data and is none: hex keys, versions, times, ranges, amounts, prose with 'at' and 'dot'."""
        key = lambda k: "".join("0123456789abcdef"[int(v)] for v in rng.integers(0, 16, k))
        return key(32), key(40), f"{key(8)}-{key(4)}-{key(4)}-{key(12)}", f"{num(1)}.{num(2)}.{num(1)}-{num(4)}", f"{num(2)}:{num(2)}:{num(2)}.{num(3)}", f"{num(3)} - {num(3)}", f"{word()} at {word()}. {word().capitalize()}", f"{word()} dot {word()}", f"{word()} at the {word()} dot", f"{num(4)}/{num(2)}", f"{num(1)},{num(3)},{num(3)}", f"ISBN {num(3)}-{num(1)}-{num(2)}"

    makers = {"email": email, "ip": ip, "card": cards, "phone": phone}
    out = []
    for _ in range(n):
        text, spans = "", []
        for _ in range(int(rng.integers(1, 4))):
            text += " ".join(word() + pick("", "", "", ",", ".") for _ in range(int(rng.integers(1, 7)))) + pick(" ", " ", " ", "\n")
            kind = pick("email", "ip", "card", "phone", None, None, None)
            part = makers[kind]() if kind else clean()
            if kind:
                spans.append((kind, len(text), len(text) + len(part)))
            text += part + pick(" ", " ", ". ", ", ", "\n")
        out.append((text + word(), spans))
    return out


def labelled_table(spark: SparkSession, n: int = 600) -> DataFrame:
    return spark.createDataFrame(labelled_rows(n), "text string, spans array<struct<kind:string,start:int,end:int>>")


def train(table: DataFrame, rounds: int = 120, rate: float = 0.1, ridge: float = 1e-3, max_rows: int = 2000) -> Field:
    """Maximum likelihood by Adam on at most ``max_rows`` labelled texts, padded to one length."""
    rows = [r for r in sorted(table.limit(max_rows).collect(), key=lambda r: r["text"] or "") if r["text"]]
    field = Field.zeros()
    if not rows:
        return field
    seqs = []
    for r in rows:
        s, e, c, d = tokens(np.frombuffer(r["text"].encode("utf-32-le"), "<u4"))
        y = np.zeros(len(s), np.int64)
        for x in r["spans"] or []:
            y[(s >= x["start"]) & (e <= x["end"])] = 1 + KINDS.index(x["kind"])
        seqs.append((c, d, y))
    width = max(len(c) for c, _, _ in seqs) + 2
    code, digits, gold = (np.zeros((len(seqs), width), np.int64) for _ in range(3))
    for i, (c, d, y) in enumerate(seqs):
        code[i, : len(c)], digits[i, : len(c)], gold[i, : len(c)] = c, d, y
    near, pair, dense = Field.index(code.ravel(), digits.ravel())
    n, t = code.shape
    hot = np.zeros((n * t, STATES))
    hot[np.arange(n * t), gold.ravel()] = 1
    seen = np.zeros((STATES, STATES))
    np.add.at(seen, (gold[:, :-1].ravel(), gold[:, 1:].ravel()), 1)
    params = [field.near, field.pair, field.dense, field.step]
    m, v = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
    lse = lambda x, axis: np.log(np.exp(x - (top := x.max(axis=axis, keepdims=True))).sum(axis=axis)) + top.squeeze(axis)
    flat = np.arange(STATES)

    def scatter(index, size, g):
        return np.stack([np.bincount(index, g[:, s], size) for s in flat], 1)

    for k in range(1, rounds + 1):
        e = (field.dense[dense] + sum(field.near[i][near[i]] for i in range(5)) + sum(field.pair[i][pair[i]] for i in range(2))).reshape(n, t, STATES)
        alpha, beta = np.zeros_like(e), np.zeros_like(e)
        alpha[:, 0] = e[:, 0]
        for i in range(1, t):
            alpha[:, i] = lse(alpha[:, i - 1, :, None] + field.step, 1) + e[:, i]
        for i in range(t - 2, -1, -1):
            beta[:, i] = lse(field.step + (e[:, i + 1] + beta[:, i + 1])[:, None, :], 2)
        z = lse(alpha[:, -1], 1)
        g = hot - np.exp(alpha + beta - z[:, None, None]).reshape(-1, STATES)
        both = np.exp(alpha[:, :-1, :, None] + field.step + (e[:, 1:] + beta[:, 1:])[:, :, None, :] - z[:, None, None, None]).sum(axis=(0, 1))
        grads = [np.stack([scatter(x, CODES, g) for x in near]), np.stack([scatter(x, CODES * CODES, g) for x in pair]), scatter(dense, 16, g), seen - both]
        for p, d, a, b in zip(params, grads, m, v, strict=True):
            d = d / n - ridge * p
            a += 0.1 * (d - a)
            b += 0.01 * (d * d - b)
            p += rate * (a / (1 - 0.9**k)) / (np.sqrt(b / (1 - 0.99**k)) + 1e-8)
    return field


RESULT = "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string"


def scan(docs: DataFrame, field: Field) -> DataFrame:
    """doc_id, numbers of pattern spans by kind, their digest, and all spans as kind:start:end; no shuffle."""
    spark = docs.sparkSession
    small_batches(spark)
    shared = spark.sparkContext.broadcast(Field(*(x.astype(np.float32) for x in (field.near, field.pair, field.dense, field.step))))
    write = lambda spans: ",".join(f"{k}:{s}:{e}" for k, s, e in spans)

    def run(batches):
        for b in batches:
            texts = b.column("text").fill_null("").to_pylist()
            got, i = [], 0
            while i < len(texts):
                j, size = i, 0
                while j < len(texts) and (j == i or size + len(texts[j]) <= 500_000):
                    size += len(texts[j])
                    j += 1
                got += find(texts[i:j], shared.value)
                i = j
            base = [[(k, s, e) for k in KINDS for s, e in x[k]] for x, _ in got]
            cols = [b.column("doc_id"), *(pa.array([len(x[k]) for x, _ in got], pa.int64()) for k in KINDS)]
            cols += [pa.array([hashlib.sha256(write(x).encode()).hexdigest() for x in base], pa.string()), pa.array([write(x) for _, x in got], pa.string())]
            yield pa.RecordBatch.from_arrays(cols, [c.split()[0] for c in RESULT.split(", ")])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, RESULT)
