"""Fill-in-middle: documents cut in three at hashed places and put together as prefix, suffix, middle or suffix, prefix, middle.

The bytes of a chunk of texts are sorted into classes and held as one wavelet matrix. Ranks of classes combine into the
number of unit boundaries before any byte, and a bisection on those numbers locates both cuts of all texts of the chunk
at once; no text is decoded.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from juryframe.llm import words as W
from juryframe.llm.common import prepare

#: Classes of bytes: inside a character; white space; first character of a word; any other first byte of a character.
INSIDE, BLANK, START, OTHER = range(4)
LEVELS = 2


@dataclass(frozen=True)
class Rule:
    """How documents are dealt to forms; rates are percents. `unit` is "char" (code points) or "word" (with the white space after it)."""

    prefix: str = "<P>"
    suffix: str = "<S>"
    middle: str = "<M>"
    plain_percent: int = 10
    spm_percent: int = 20
    seed: int = 1
    unit: str = "char"

    def __post_init__(self) -> None:
        marks = (self.prefix, self.suffix, self.middle)
        if len(set(marks)) < 3 or any(len(set(m)) < len(m) or not m for m in marks):
            raise ValueError("the marks must differ, and no sign may stand twice in one")
        if self.unit not in ("char", "word"):
            raise ValueError(f"no unit {self.unit!r}")


class ClassMatrix:
    """Wavelet matrix of small codes that answers whole arrays of rank queries."""

    def __init__(self, codes: np.ndarray, levels: int = LEVELS):
        self.n, self.levels, now = len(codes), levels, codes
        self.words, self.before, self.zeros = [], [], []
        for level in range(levels - 1, -1, -1):
            bit = (now >> level & 1).astype(bool)
            packed = np.zeros((self.n // 64 + 1) * 8, np.uint8)
            some = np.packbits(bit, bitorder="little")
            packed[:len(some)] = some
            words = packed.view("<u8")
            self.words.append(words)
            self.before.append(np.concatenate([[0], np.cumsum(np.bitwise_count(words), dtype=np.int64)]))
            self.zeros.append(self.n - int(self.before[-1][-1]))
            now = np.concatenate([now[~bit], now[bit]])

    def ones(self, plane: int, at: np.ndarray) -> np.ndarray:
        """Ones of a plane before each place."""
        word = at >> 6
        mask = (np.uint64(1) << (at & 63).astype(np.uint64)) - np.uint64(1)
        return self.before[plane][word] + np.bitwise_count(self.words[plane][word] & mask)

    def rank(self, code: int, at: np.ndarray) -> np.ndarray:
        """How often `code` stands before each place."""
        both = np.concatenate([np.asarray(at, np.int64), [0]])  # the last follows the start of the range
        for plane, zeros in enumerate(self.zeros):
            ones = self.ones(plane, both)
            both = zeros + ones if code >> (self.levels - 1 - plane) & 1 else both - ones
        return both[:-1] - both[-1]


def classes(data: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Class of each byte of the texts data[bounds[i]:bounds[i + 1]]."""
    blank = ~W.SPACED[data]
    code = np.where((data & 0xC0) == 0x80, INSIDE, np.where(blank, BLANK, OTHER)).astype(np.uint8)
    opens = np.ones(len(data), bool)
    opens[1:] = blank[:-1]
    starts = bounds[:-1]
    opens[starts[starts < len(data)]] = True
    code[opens & (code == OTHER)] = START
    return code


def boundaries(matrix: ClassMatrix, unit: str, at: np.ndarray) -> np.ndarray:
    """Units that begin before each place: characters are all that isn't inside one; words are counted at their start."""
    return at - matrix.rank(INSIDE, at) if unit == "char" else matrix.rank(START, at)


def locate(matrix: ClassMatrix, unit: str, low: np.ndarray, high: np.ndarray, units: np.ndarray) -> np.ndarray:
    """For each text from byte `low` to `high`, the place after its first `units` units (the end if there are no more)."""
    base, low, high = boundaries(matrix, unit, low), low.copy(), high.copy()
    while (low < high).any():
        middle = (low + high + 1) >> 1
        fits = boundaries(matrix, unit, middle) - base <= units
        low, high = np.where(fits, middle, low), np.where(fits, high, middle - 1)
    return low


def dealt(doc_id: Column, seed: int) -> list[Column]:
    """The first four 8-digit groups of the hash of a document id, as numbers from 0 to 2**32 - 1. A null id hashes like an empty one."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256)
    return [F.conv(F.substring(digest, 1 + 8 * i, 8), 16, 10).cast("long") for i in range(4)]


def _cut(rule: Rule):
    schema = pa.schema([("id", pa.int64()), ("n", pa.int64()), ("form", pa.string()), ("prefix", pa.int64()), ("middle", pa.int64()), ("output", pa.string())])
    marks = [m.encode() for m in (rule.prefix, rule.suffix, rule.middle)]

    def run(source):
        for batch in source:
            ids, hashes = batch.column(0), [np.asarray(batch.column(i)) for i in range(2, 6)]
            for row, to, data, bounds in W.chunks(batch.column(1)):
                matrix = ClassMatrix(classes(data, bounds))
                low, high = bounds[:-1], bounds[1:]
                n = boundaries(matrix, rule.unit, high) - boundaries(matrix, rule.unit, low)
                h1, h2, h3, h4 = (h[row:to] for h in hashes)
                one, two = h1 % (n + 1), h2 % (n + 1)
                first, second = np.minimum(one, two), np.maximum(one, two)
                a, b = locate(matrix, rule.unit, low, high, first), locate(matrix, rule.unit, low, high, second)
                whole, spm = h3 % 100 >= 100 - rule.plain_percent, h4 % 100 < rule.spm_percent
                forms, texts = [], []
                for i, (lo, p, q, hi) in enumerate(zip(low.tolist(), a.tolist(), b.tolist(), high.tolist())):
                    text = data[lo:hi].tobytes()
                    if whole[i] or not text or any(m in text for m in marks):
                        forms.append("plain")
                        texts.append(text)
                        continue
                    before, inner, after = text[:p - lo], text[p - lo:q - lo], text[q - lo:]
                    forms.append("spm" if spm[i] else "psm")
                    order = (marks[1], after, marks[0], before) if spm[i] else (marks[0], before, marks[1], after)
                    texts.append(b"".join((*order, marks[2], inner)))
                plain = np.array([f == "plain" for f in forms], bool)
                columns = [ids.slice(row, to - row), pa.array(n), pa.array(forms, pa.string()), pa.array(first, mask=plain), pa.array(second - first, mask=plain),
                           pa.array(texts, pa.binary()).cast(pa.string())]
                yield pa.RecordBatch.from_arrays(columns, schema=schema)

    return run, "id long, n long, form string, prefix long, middle long, output string"


def transform(docs: DataFrame, rule: Rule = Rule(), *, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """id, n (units), form (plain, psm or spm), prefix and middle (units; null if plain), output, for each row.

    The cuts depend on the id alone, so reruns agree and rows that share an id and a text get equal results. A null
    text counts as empty; empty texts, texts that hold a mark, and the share `plain_percent` stay plain. An empty table
    gives no rows; columns beside the two named are ignored. Memory follows the longest text.
    """
    prepare(docs.sparkSession)
    rows = docs.select(F.col(doc_id).cast("long").alias("id"), F.coalesce(F.col(text), F.lit("")).cast("binary").alias("body"), *[h.alias(f"h{i}") for i, h in enumerate(dealt(F.col(doc_id), rule.seed))])
    return rows.mapInArrow(*_cut(rule))


def restore(output: Column, form: Column, rule: Rule = Rule()) -> Column:
    """The text that `transform` was given, from its output and form. No mark stands in a text that was cut, so each is found where it was put."""
    head = F.substring_index(output, rule.middle, 1)
    middle = F.substring_index(output, rule.middle, -1)
    after = lambda mark, part: F.substring(part, len(mark) + 1, 1 << 30)
    psm = F.concat(after(rule.prefix, F.substring_index(head, rule.suffix, 1)), middle, F.substring_index(head, rule.suffix, -1))
    spm = F.concat(F.substring_index(head, rule.prefix, -1), middle, after(rule.suffix, F.substring_index(head, rule.prefix, 1)))
    return F.when(form == "psm", psm).when(form == "spm", spm).otherwise(output)
