"""Token ids as wavelet matrices: compressed shard files with random access, counting and occurrence lookup.

Documents are dealt to shards by id range and sorted inside them. A shard is a run of files; each holds the token ids
of whole documents as bit planes from the highest bit down, every plane being the ids stably parted by the plane above,
with counts of ones before each block of BLOCK bits. Files are values of a binary column of a Parquet table, so any
store that Spark reads will do.
"""

from __future__ import annotations

import os
import struct
import zlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from juryframe.llm import words as W
from juryframe.llm.common import batches, prepare, row_key

MAGIC = b"WAVE1\n"
BLOCK = 512
FILE_TOKENS = 1 << 20
#: Pieces whose ids a worker keeps; beyond that, it starts anew.
CACHE_WORDS = 1_000_000


class WaveletMatrix:
    """Sequence of small integers held as bit planes."""

    def __init__(self, n: int, planes: list[np.ndarray], zeros: list[int], before: list[np.ndarray] | None = None):
        self.n, self.planes, self.zeros = n, planes, zeros
        self.before = before if before is not None else [np.concatenate([[0], np.cumsum(np.add.reduceat(np.bitwise_count(p).astype(np.int64), np.arange(0, len(p), BLOCK // 8)))]) if len(p) else np.zeros(1, np.int64) for p in planes]

    @classmethod
    def build(cls, values: np.ndarray, levels: int) -> WaveletMatrix:
        now, planes, zeros = values.astype(np.uint16 if levels <= 16 else np.uint32), [], []
        for level in range(levels - 1, -1, -1):
            bit = (now >> level & 1).astype(bool)
            planes.append(np.packbits(bit))
            zeros.append(int(len(bit) - bit.sum()))
            now = np.concatenate([now[~bit], now[bit]])
        return cls(len(values), planes, zeros)

    def _bit(self, level: int, i: int) -> int:
        return int(self.planes[level][i >> 3]) >> (7 - (i & 7)) & 1

    def _ones(self, level: int, i: int) -> int:
        """Ones among the first i bits of a plane."""
        block = i // BLOCK
        part = self.planes[level][block * BLOCK // 8:(i + 7) // 8]
        if i & 7 and len(part):
            part = part.copy()
            part[-1] &= 0xFF << (8 - (i & 7)) & 0xFF
        return int(self.before[level][block]) + int(np.bitwise_count(part).sum())

    def access(self, i: int) -> int:
        if not 0 <= i < self.n:
            raise IndexError(i)
        value = 0
        for level, zeros in enumerate(self.zeros):
            bit = self._bit(level, i)
            value = value << 1 | bit
            i = zeros + self._ones(level, i) if bit else i - self._ones(level, i)
        return value

    def _range(self, symbol: int, lo: int, hi: int) -> tuple[int, int]:
        for level, zeros in enumerate(self.zeros):
            a, b = self._ones(level, lo), self._ones(level, hi)
            lo, hi = (zeros + a, zeros + b) if symbol >> (len(self.zeros) - 1 - level) & 1 else (lo - a, hi - b)
        return lo, hi

    def count(self, symbol: int, lo: int = 0, hi: int | None = None) -> int:
        """Occurrences of a symbol among places lo to hi - 1."""
        if symbol < 0 or symbol >> len(self.zeros):
            return 0
        a, b = self._range(symbol, lo, self.n if hi is None else hi)
        return b - a

    def find(self, symbol: int, k: int) -> int:
        """Place of the k-th occurrence, from 0."""
        if not 0 <= k < self.count(symbol):
            raise IndexError(k)
        i = self._range(symbol, 0, self.n)[0] + k
        for level in range(len(self.zeros) - 1, -1, -1):
            one = symbol >> (len(self.zeros) - 1 - level) & 1
            i = self._select(level, one, i - self.zeros[level] if one else i)
        return i

    def _select(self, level: int, one: int, k: int) -> int:
        ones = self.before[level].astype(np.int64)
        before = ones if one else np.minimum(np.arange(len(ones)) * BLOCK, self.n) - ones
        block = int(np.searchsorted(before, k, "right")) - 1
        bits = np.unpackbits(self.planes[level][block * BLOCK // 8:(block + 1) * BLOCK // 8])[:self.n - block * BLOCK]
        return block * BLOCK + int(np.flatnonzero(bits == one)[k - int(before[block])])

    def occurrences(self, symbol: int) -> list[int]:
        return [self.find(symbol, k) for k in range(self.count(symbol))]

    def values(self) -> np.ndarray:
        """The whole sequence, from the lowest plane up."""
        now = np.zeros(self.n, np.uint32)
        for level in range(len(self.zeros) - 1, -1, -1):
            bit = np.unpackbits(self.planes[level])[:self.n].astype(bool)
            above = np.empty(self.n, np.uint32)
            above[~bit], above[bit] = now[:self.zeros[level]], now[self.zeros[level]:]
            above |= bit.astype(np.uint32) << np.uint32(len(self.zeros) - 1 - level)
            now = above
        return now


def pack(ids: list[int | None], sizes: list[int], values: np.ndarray, levels: int) -> bytes:
    """One file: magic, counts, document ids (a flag for null), document sizes, zeros of the planes, the planes, the
    ones before each block of each plane. Ids of more than `levels` bits are refused."""
    if len(values) and int(values.max()) >> levels:
        raise ValueError(f"id {int(values.max())} does not fit {levels} bit planes")
    matrix = WaveletMatrix.build(values, levels)
    head = struct.pack("<IQI", len(ids), len(values), levels)
    return b"".join([MAGIC, head, np.array([i is not None for i in ids], np.uint8).tobytes(), np.array([i or 0 for i in ids], "<i8").tobytes(),
                     np.array(sizes, "<i8").tobytes(), np.array(matrix.zeros, "<i8").tobytes(), *[p.tobytes() for p in matrix.planes],
                     *[b.astype("<u4").tobytes() for b in matrix.before]])


def unpack(body: bytes) -> tuple[list[int | None], np.ndarray, WaveletMatrix]:
    """(document ids, document sizes, the matrix) of one file."""
    if body[:len(MAGIC)] != MAGIC:
        raise ValueError("no wavelet file")
    docs, n, levels = struct.unpack_from("<IQI", body, len(MAGIC))
    at = len(MAGIC) + 16
    given = np.frombuffer(body, np.uint8, docs, at)
    ids = np.frombuffer(body, "<i8", docs, at + docs)
    sizes = np.frombuffer(body, "<i8", docs, at + 9 * docs)
    zeros = np.frombuffer(body, "<i8", levels, at + 17 * docs).tolist()
    at, width = at + 17 * docs + 8 * levels, (n + 7) // 8
    planes = [np.frombuffer(body, np.uint8, width, at + k * width) for k in range(levels)]
    at, blocks = at + levels * width, -(-n // BLOCK) + 1
    before = [np.frombuffer(body, "<u4", blocks, at + 4 * k * blocks) for k in range(levels)]
    return [i if ok else None for i, ok in zip(ids.tolist(), given.tolist())], sizes, WaveletMatrix(n, planes, zeros, before)


class Known:
    """Ids of pieces that were encoded before, by the hash of the piece; all are forgotten beyond CACHE_WORDS pieces."""

    def __init__(self) -> None:
        self.hash, self.flat = np.empty(0, np.uint64), np.empty(0, np.uint32)
        self.first = self.size = np.empty(0, np.int64)

    def absent(self, hashes: np.ndarray) -> np.ndarray:
        """Places of the hashes (sorted, distinct) that are not known."""
        if len(self.hash) > CACHE_WORDS:
            self.__init__()
        if not len(self.hash):
            return np.arange(len(hashes))
        at = np.minimum(np.searchsorted(self.hash, hashes), len(self.hash) - 1)
        return np.flatnonzero(self.hash[at] != hashes)

    def add(self, hashes: np.ndarray, ids: list[list[int]]) -> None:
        sizes = np.fromiter(map(len, ids), np.int64, len(ids))
        first = len(self.flat) + np.cumsum(sizes) - sizes
        self.flat = np.concatenate([self.flat, np.fromiter(chain.from_iterable(ids), np.uint32, int(sizes.sum()))])
        at = np.searchsorted(self.hash, hashes)
        self.hash, self.first, self.size = (np.insert(old, at, new) for old, new in ((self.hash, hashes), (self.first, first), (self.size, sizes)))

    def find(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(first place in `flat`, number of ids) of each hash; all must be known."""
        at = np.searchsorted(self.hash, hashes)
        return self.first[at], self.size[at]


#: The tokenizer a worker used last, with its pieces, by the text of its file.
_LAST: dict[str, tuple] = {}


def _tokenizer(rules: str) -> tuple:
    """(tokenizer, known pieces) of a tokenizer file; tasks that follow each other in a worker share them."""
    if rules not in _LAST:
        # a task has one core; the library's own threads only add memory
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        _LAST.clear()
        _LAST[rules] = Tokenizer.from_str(rules), Known()
    return _LAST[rules]


#: ASCII letters and digits, and signs that may stand beside them in a piece of their own.
ALNUM = np.zeros(256, bool)
ALNUM[48:58] = ALNUM[65:91] = ALNUM[97:123] = True
SIGNS = ".,;:!?*#$%&|"
SIGN = np.zeros(256, bool)
SIGN[[ord(c) for c in SIGNS]] = True


def pieces_of(tokenizer) -> tuple[bool, bool, bool, tuple[bytes, ...]]:
    """What the tokenizer does to texts: (drops white space between words, parts signs from letters, folds ASCII case,
    its added tokens).

    Where it does, equal pieces have equal ids wherever they stand, and each is encoded once. A text that may hold an
    added token, which pieces would tear apart, is encoded whole.
    """
    ids = lambda s: tokenizer.encode(s, add_special_tokens=False).ids
    drops = all(ids(f"ab{c}cd{c}") == ids("ab") + ids("cd") for c in " \t\n\v\f\r")
    parts = drops and all(ids(f"ab{c}{c}cd9{c}7") == ids("ab") + ids(c + c) + ids("cd9") + ids(c) + ids("7") for c in SIGNS)
    added = tuple(token.content.encode().lower() for token in tokenizer.get_added_tokens_decoder().values())
    return drops, parts, drops and all(ids(chr(65 + i) + "a") == ids(chr(97 + i) + "a") for i in range(26)), added


def _encoded(batch: pa.RecordBatch, column: int, tokenizer, known: Known, how: tuple) -> Iterator[tuple[int, np.ndarray]]:
    """(row, ids) of each text."""
    drops, parts, folds, added = how
    if not drops:
        for row, text in enumerate(batch.column(column).to_pylist()):
            yield row, np.array(tokenizer.encode(text.decode(), add_special_tokens=False).ids, np.uint32)
        return
    for row, to, data, bounds in W.chunks(batch.column(column)):
        found = W.scan(data, bounds, W.SPACED, W.LOWER if folds else W.SAME, (ALNUM, SIGN) if parts else None)
        distinct, at, inverse = np.unique(found.hash, return_index=True, return_inverse=True)
        missing = known.absent(distinct)
        start, end = found.start[at[missing]].tolist(), found.end[at[missing]].tolist()
        fresh: list[list[int]] = []
        for lo in range(0, len(start), 4096):
            texts = [data[a:b].tobytes().decode() for a, b in zip(start[lo:lo + 4096], end[lo:lo + 4096])]
            fresh += [e.ids for e in tokenizer.encode_batch(texts, add_special_tokens=False)]
        known.add(distinct[missing], fresh)
        first, sizes = known.find(distinct)
        per = sizes[inverse]
        ends = np.cumsum(per)
        total = int(ends[-1]) if len(ends) else 0
        ids = known.flat[np.repeat(first[inverse] - (ends - per), per) + np.arange(total)]
        edges = np.concatenate([[0], ends])[found.first]
        raw = data.tobytes().lower()
        some = any(token in raw for token in added)
        for i in range(to - row):
            lo, hi = int(bounds[i]), int(bounds[i + 1])
            if some and any(raw.find(token, lo, hi) >= 0 for token in added):
                yield row + i, np.array(tokenizer.encode(data[lo:hi].tobytes().decode(), add_special_tokens=False).ids, np.uint32)
            else:
                yield row + i, ids[edges[i]:edges[i + 1]]


def _write(shared, how: tuple, end_id: int, levels: int, file_tokens: int):
    schema = pa.schema([("shard", pa.int32()), ("file", pa.int32()), ("n_tokens", pa.int64()), ("body", pa.binary())])

    def files(source):
        from pyspark import TaskContext

        (tokenizer, known), shard, number = _tokenizer(shared.value), TaskContext.get().partitionId(), 0
        ids, sizes, held, total = [], [], [], 0
        for batch in source:
            docs = batch.column(0).to_pylist()
            for row, tokens in _encoded(batch, 1, tokenizer, known, how):
                ids.append(docs[row])
                held += [tokens, np.array([end_id], np.uint32)]
                sizes.append(len(tokens) + 1)
                total += sizes[-1]
                if total >= file_tokens:
                    yield shard, number, total, pack(ids, sizes, np.concatenate(held), levels)
                    ids, sizes, held, total, number = [], [], [], 0, number + 1
        if ids:
            yield shard, number, total, pack(ids, sizes, np.concatenate(held), levels)

    return lambda source: batches(files(source), schema, 1), "shard int, file int, n_tokens long, body binary"


def write(docs: DataFrame, vocabulary: str, path: str, *, doc_id: str = "doc_id", text: str = "text", end_id: int = 2, levels: int | None = None,
          file_tokens: int = FILE_TOKENS) -> DataFrame:
    """Token files of all documents in ascending id order, written to `path` and read back as shard, file, n_tokens, body.

    `vocabulary` is a tokenizer file of the tokenizers library, read on the driver. Null and empty texts give the end
    id alone. Null ids come first; rows that share an id stay neighbours, ordered by a hash of their text. `levels` (bits
    of an id) follows from the largest id of the vocabulary; too few given are refused when an id does not fit.
    """
    from tokenizers import Tokenizer

    spark = prepare(docs.sparkSession)
    with open(vocabulary, encoding="utf-8") as file:
        rules = file.read()
    tokenizer = Tokenizer.from_str(rules)
    shared, how = spark.sparkContext.broadcast(rules), pieces_of(tokenizer)
    levels = levels or max(1, end_id.bit_length(), max(tokenizer.get_vocab(with_added_tokens=True).values(), default=0).bit_length())
    run, schema = _write(shared, how, end_id, levels, file_tokens)
    rows = docs.select(F.col(doc_id).cast("long").alias("id"), F.coalesce(F.col(text), F.lit("")).cast("binary").alias("body"), row_key(F.col(text)).alias("key"))
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ranged = rows.repartitionByRange(parts, "id", "key").sortWithinPartitions("id", "key").select("id", "body")
    ranged.mapInArrow(run, schema).write.option("compression", "zstd").parquet(path)
    return spark.read.schema(schema).parquet(path)


def _read(source):
    schema = pa.schema([("shard", pa.int32()), ("file", pa.int32()), ("id", pa.int64()), ("at", pa.int64()), ("n_tokens", pa.int64()), ("crc", pa.int64())])

    def rows():
        for batch in source:
            for shard, file, body in zip(*(c.to_pylist() for c in batch.columns)):
                ids, sizes, matrix = unpack(body)
                values, at = matrix.values().astype("<u4"), 0
                for doc, size in zip(ids, sizes.tolist()):
                    yield shard, file, doc, at, size, zlib.crc32(values[at:at + size].tobytes())
                    at += size

    return batches(rows(), schema)


def read(files: DataFrame) -> DataFrame:
    """One row per document of the files: id, start (ids of all documents before it), n_tokens, crc32 of its ids."""
    by_shard, by_file = Window.orderBy("shard"), Window.partitionBy("shard").orderBy("file")
    before = lambda w: w.rowsBetween(Window.unboundedPreceding, -1)
    sizes = files.select("shard", "file", "n_tokens")
    shards = sizes.groupBy("shard").agg(F.sum("n_tokens").alias("n")).withColumn("base", F.coalesce(F.sum("n").over(before(by_shard)), F.lit(0))).select("shard", "base")
    base = sizes.withColumn("inner", F.coalesce(F.sum("n_tokens").over(before(by_file)), F.lit(0))).join(shards, "shard").select("shard", "file", (F.col("base") + F.col("inner")).alias("base"))
    docs = files.select("shard", "file", "body").mapInArrow(_read, "shard int, file int, id long, at long, n_tokens long, crc long")
    return docs.join(base, ["shard", "file"]).select("id", (F.col("base") + F.col("at")).alias("start"), "n_tokens", "crc")
