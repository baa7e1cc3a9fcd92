"""Personal data by a semi-Markov conditional random field over candidate segments.

Tokens that hold a digit or an at sign form runs; all others are outside for certain. Inside a run a segment is one
token outside, or up to MOST_TOKENS tokens of one type. Whole-span features (digit count, checksum, octets, shape, the
word before) score a segment; dynamic programming over the run picks boundaries and types together. Weights are
learned by gradient ascent on the log likelihood (forward and backward sums over all segmentations) from a bounded
sample of documents whose plain matches serve as labels. A segment is added when it beats reading its tokens as
outside by MARGIN; plain matches always stay.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from juryframe.llm.common import batches, prepare

KINDS = ("email", "ip", "card", "phone")
MOST_TOKENS = 6
MARGIN = 4.0
SAMPLE_DOCS = 600
ROUNDS, RATE, DECAY = 25, 0.5, 1e-3

# Fixed patterns of the plain matches.
EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
# Words that announce a kind.
CUES = {"email": {"mail", "email", "e-mail", "contact"}, "ip": {"ip", "host", "address"}, "card": {"card", "visa", "pay"}, "phone": {"tel", "phone", "call", "fax", "mobile"}}

_SIGN = re.compile(r"[0-9@]")
_TOKEN = re.compile(r"[^\x20\x09-\x0D]+")
_DIGIT = re.compile(r"[0-9]")
N_FEATURES = 16


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(map(int, reversed(digits))):
        d = d * 2 if i % 2 else d
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def _digits(s: str) -> str:
    return "".join(_DIGIT.findall(s))


def plain(text: str) -> list[tuple[int, int, int]]:
    """(kind, start, end) of the fixed patterns, by kind and start; matches that fail their test are dropped."""
    out = []
    if "@" in text:
        out += [(0, m.start(), m.end()) for m in EMAIL.finditer(text)]
    if "." in text:
        out += [(1, m.start(), m.end()) for m in IP.finditer(text) if all(len(p.lstrip("0")) <= 3 and int(p) <= 255 for p in m.group().split("."))]
    out += [(2, m.start(), m.end()) for m in CARD.finditer(text) if m.end() - m.start() >= 13 and 13 <= len(d := _digits(m.group())) <= 19 and luhn(d)]
    if "+" in text:
        out += [(3, m.start(), m.end()) for m in PHONE.finditer(text) if 9 <= len(_digits(m.group())) <= 15]
    return out


def runs(text: str) -> list[tuple[str, list[tuple[int, int]]]]:
    """(word before, bounds of the tokens) of each run of tokens with a digit or an at sign."""
    out: list = []
    last_end, seen = -1, 0
    for sign in _SIGN.finditer(text):
        at = sign.start()
        if at < seen:
            continue
        a = at
        while a > 0 and text[a - 1] not in " \t\n\v\f\r":
            a -= 1
        b = _TOKEN.match(text, a).end()
        seen = b
        if out and text[last_end:a].isspace() and a - last_end == 1:
            out[-1][1].append((a, b))
        else:
            before = text[max(0, a - 24):a].split()
            out.append((before[-1].strip(".,:;()").lower() if before else "", [(a, b)]))
        last_end = b
    return out


def trimmed(text: str, a: int, b: int) -> tuple[int, int]:
    """Bounds without quotes, brackets and stops around the span."""
    while a < b and text[a] in "\"'<>[]{},;:!?":
        a += 1
    while a < b and text[b - 1] in "\"'<>[]{},;:!?.":
        b -= 1
    return (a + 1, b) if a < b and text[a] == "(" and ")" not in text[a:b] else (a, b)


def features(text: str, a: int, b: int, tokens: int, before: str) -> np.ndarray:
    """Whole-span features of text[a:b]."""
    s = text[a:b]
    d = _digits(s)
    n, parts = len(d), s.split(".")
    numbers = not s.strip("0123456789+-(). ")
    return np.array([
        1.0, tokens > 1, "@" in s and "." in s[s.find("@"):], "@" in s, bool(EMAIL.fullmatch(s)),
        len(parts) == 4 and all(p.isascii() and p.isdigit() and len(p) < 4 and int(p) < 256 for p in parts), bool(numbers and 13 <= n <= 19), bool(numbers and 13 <= n <= 19 and luhn(d)),
        bool(numbers and 9 <= n <= 15), s[:1] == "+", bool(numbers and s[:1] == "+" and 9 <= n <= 15), n < 7, not numbers, *[before in CUES[k] for k in ("email", "card", "phone")]], float)


def segments(text: str, before: str, tokens: list[tuple[int, int]]) -> list[list[tuple[int, int, int, np.ndarray]]]:
    """For each end place j, (first token, start, end, features) of all segments that end before token j."""
    out: list[list] = [[] for _ in range(len(tokens) + 1)]
    for i in range(len(tokens)):
        for j in range(i + 1, min(len(tokens), i + MOST_TOKENS) + 1):
            a, b = trimmed(text, tokens[i][0], tokens[j - 1][1])
            if a < b:
                out[j].append((i, a, b, features(text, a, b, j - i, before if i == 0 else "")))
    return out


def _gradient(weights: np.ndarray, table: list, gold: dict[tuple[int, int], int]) -> np.ndarray:
    """Of the log likelihood of one run: gold feature sums minus expected ones."""
    n = len(table) - 1
    scores = [[weights @ f for *_, f in at] for at in table]
    forward = np.full(n + 1, -np.inf)
    forward[0] = 0.0
    for j in range(1, n + 1):
        ways = [forward[j - 1]] + [forward[i] + v for (i, *_), s in zip(table[j], scores[j]) for v in s]
        forward[j] = np.logaddexp.reduce(ways)
    backward = np.full(n + 1, -np.inf)
    backward[n] = 0.0
    for j in range(n, 0, -1):
        backward[j - 1] = np.logaddexp(backward[j - 1], backward[j])
        for (i, *_), s in zip(table[j], scores[j]):
            backward[i] = np.logaddexp(backward[i], np.logaddexp.reduce(s) + backward[j])
    out = np.zeros_like(weights)
    for j in range(1, n + 1):
        for (i, a, b, f), s in zip(table[j], scores[j]):
            out -= np.outer(np.exp(forward[i] + s + backward[j] - forward[n]), f)
            if (a, b) in gold:
                out[gold[a, b]] += f
    return out


def train(texts: list[str]) -> np.ndarray:
    """Weights (kinds x features). Runs whose plain matches do not fall on segment bounds teach nothing."""
    examples = []
    for text in texts:
        found = plain(text)
        for before, tokens in runs(text)[:50]:
            lo, hi = tokens[0][0], tokens[-1][1]
            if len(tokens) > 24:
                continue
            gold = {(a, b): k for k, a, b in found if a >= lo and b <= hi}
            table = segments(text, before, tokens)
            if set(gold) <= {(a, b) for at in table for _, a, b, _ in at}:
                examples.append((table, gold))
    weights, scale = np.zeros((len(KINDS), N_FEATURES)), np.full((len(KINDS), N_FEATURES), 1e-6)
    weights[:, 0] = -2.0
    for _ in range(ROUNDS):
        for table, gold in examples:
            step = _gradient(weights, table, gold) - DECAY * weights
            scale += step * step
            weights += RATE * step / np.sqrt(scale)
    return weights


def decode(weights: np.ndarray, text: str, before: str, tokens: list[tuple[int, int]]) -> list[tuple[int, int, int]]:
    """(kind, start, end) of the best segmentation of a run, each at least MARGIN above outside."""
    table = segments(text, before, tokens)
    best, back = [0.0], [None]
    for j in range(1, len(tokens) + 1):
        top, how = best[j - 1], None
        for i, a, b, f in table[j]:
            s = weights @ f
            k = int(s.argmax())
            if s[k] >= MARGIN and best[i] + s[k] > top:
                top, how = best[i] + s[k], (i, k, a, b)
        best.append(top)
        back.append(how)
    out, j = [], len(tokens)
    while j:
        if back[j] is None:
            j -= 1
        else:
            j, k, a, b = back[j]
            out.append((k, a, b))
    return out[::-1]


def found(weights: np.ndarray, text: str) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int]]]:
    """(plain matches, all spans): plain ones and the added that touch none of them, by kind and start."""
    if not _SIGN.search(text):
        return [], []
    base = plain(text)
    taken = sorted((a, b) for _, a, b in base)
    added = []
    for before, tokens in runs(text):
        for k, a, b in decode(weights, text, before, tokens):
            if not any(x < b and a < y for x, y in taken):
                added.append((k, a, b))
    return base, sorted(base + added)


def fit(docs: DataFrame, text: str = "text", size: int = SAMPLE_DOCS) -> np.ndarray:
    """Weights from at most `size` documents with digits or at signs, those with the least text hashes."""
    some = docs.select(F.col(text).alias("t")).where(F.col("t").rlike("[0-9@]")).distinct().orderBy(F.xxhash64("t"), "t").limit(size)
    return train([r.t for r in some.toLocalIterator()])


def _find(shared):
    schema = pa.schema([("id", pa.int64()), *[(f"n_{k}", pa.int64()) for k in KINDS], ("base", pa.string()), ("spans", pa.string())])

    def show(spans):
        return ",".join(f"{KINDS[k]}:{a}:{b}" for k, a, b in spans)

    def rows(source):
        for batch in source:
            for doc, text in zip(*(c.to_pylist() for c in batch.columns)):
                base, spans = found(shared.value, text or "")
                yield doc, *[sum(k == i for k, *_ in base) for i in range(len(KINDS))], show(base), show(spans)

    return lambda source: batches(rows(source), schema), "id long, " + ", ".join(f"n_{k} long" for k in KINDS) + ", base string, spans string"


def scan(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", weights: np.ndarray | None = None) -> DataFrame:
    """One row per document: id, counts of plain matches, base and spans as kind:start:end lists in code points.

    Null and empty texts have no spans. Null ids and repeated rows are scanned like others. Without documents to learn
    from, or without matches in them, nothing is added.
    """
    spark = prepare(docs.sparkSession)
    weights = fit(docs, text) if weights is None else weights
    run, schema = _find(spark.sparkContext.broadcast(weights))
    return docs.select(F.col(doc_id).cast("long"), F.col(text)).mapInArrow(run, schema)
