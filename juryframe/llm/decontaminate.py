"""Benchmark decontamination by winnowing.

Every window of `width` consecutive k-grams gives its smallest hash as a fingerprint. Two texts that share
n = k + width - 1 words share all k-grams of that span, hence pick the same smallest one: no shared span of n words can
be missed. Fingerprints of documents first pass a bit table of fixed size made from the benchmark's fingerprints, so
only those that may match are shuffled; they join the benchmark's on the hash, and each pair is extended word by word
to the longest equal run. Runs of n words or more are hits. Items shorter than n words are looked up whole: their
lengths (n - 1 at most) are the only further window sizes the documents are hashed at.

Neither side is broadcast; what is broadcast is the bit table (BITS / 8 bytes whatever the benchmark's size).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from juryframe.llm import words as W
from juryframe.llm.common import batches, prepare, row_key, wrapped

BITS = 1 << 23
WINDOW, GRAM = 13, 7
U64 = np.uint64


def _prints(found: W.Words, n: int, k: int, lengths: tuple[int, ...], table: np.ndarray | None) -> Iterator[tuple]:
    """(text, fingerprint, place, from, to): a k-gram's place and the words around it that a shared window may cover.

    Places count within the text. Without a table, whole texts of fewer than n words give one print each.
    """
    sizes = np.diff(found.first)
    text_of = np.repeat(np.arange(len(sizes)), sizes)
    last = found.first[1:][text_of]
    values = W.grams(found.hash, k)
    least = W.lowest(values, n - k + 1)
    places = np.unique(least[np.arange(len(least)) + n <= last[:len(least)]])
    yield from _rows(found, text_of, values, places, n, k, table)
    for m in lengths:
        values = W.mix(W.grams(found.hash, m) + U64(0x5851F42D4C957F2D) * U64(m))
        places = np.arange(len(values))
        places = places[places + m <= last[:len(values)]]
        if table is None:
            places = places[sizes[text_of[places]] == m]
        yield from _rows(found, text_of, values, places, m, m, table)


def _rows(found: W.Words, text_of: np.ndarray, values: np.ndarray, places: np.ndarray, n: int, k: int, table: np.ndarray | None) -> Iterator[tuple]:
    if table is not None:
        places = places[_in(table, values[places])]
    for i, v, p in zip(text_of[places].tolist(), values[places].view(np.int64).tolist(), places.tolist()):
        lo, hi = int(found.first[i]), int(found.first[i + 1])
        yield i, v, p - lo, max(0, p - lo - (n - k)), min(hi - lo, p - lo + n)


def _in(table: np.ndarray, values: np.ndarray) -> np.ndarray:
    mask = U64(BITS - 1)
    one, two = values & mask, (values >> U64(32)) & mask
    hit = (table[one >> U64(6)] >> (one & U64(63))) & (table[two >> U64(6)] >> (two & U64(63))) & U64(1)
    return hit.astype(bool)


def _item_prints(n: int, k: int):
    schema = pa.schema([("fp", pa.int64()), ("item_id", pa.string()), ("item_words", pa.string()), ("item_lead", pa.int32()), ("whole", pa.int32())])

    def rows(source):
        for batch in source:
            ids = batch.column(0).to_pylist()
            for row, to, data, bounds in W.chunks(batch.column(1)):
                found = W.scan(data, bounds, W.ALNUM, W.LOWER)
                sizes = np.diff(found.first).tolist()
                short = tuple(sorted({m for m in sizes if 0 < m < n}))
                for i, v, p, a, b in _prints(found, n, k, short, None):
                    lo = int(found.first[i])
                    yield v, ids[row + i], found.text(lo + a, lo + b, W.LOWER).decode(), p - a, sizes[i] if sizes[i] < n else 0

    return lambda source: batches(rows(source), schema), "fp long, item_id string, item_words string, item_lead int, whole int"


def _doc_prints(n: int, k: int, lengths: tuple[int, ...], shared):
    schema = pa.schema([("id", pa.string()), ("key", pa.int64()), ("n_words", pa.int64()), ("fp", pa.int64()), ("place", pa.int32()), ("words", pa.string()), ("lead", pa.int32())])

    def rows(source):
        table = np.frombuffer(shared.value, U64)
        for batch in source:
            ids, keys = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for row, to, data, bounds in W.chunks(batch.column(2)):
                found = W.scan(data, bounds, W.ALNUM, W.LOWER)
                sizes = np.diff(found.first).tolist()
                for i in range(to - row):
                    yield ids[row + i], keys[row + i], sizes[i], keys[row + i], None, None, None
                for i, v, p, a, b in _prints(found, n, k, lengths, table):
                    lo = int(found.first[i])
                    yield ids[row + i], keys[row + i], sizes[i], v, p, found.text(lo + a, lo + b, W.LOWER).decode(), p - a

    return lambda source: batches(rows(source), schema), "id string, key long, n_words long, fp long, place int, words string, lead int"


def _extend(n: int, k: int):
    """Word ranges of the document that equal a window of the item, one for each joined pair of fingerprints."""
    schema = pa.schema([("id", pa.string()), ("key", pa.int64()), ("n_words", pa.int64()), ("item_id", pa.string()), ("start", pa.int32()), ("stop", pa.int32()), ("base", pa.int64())])

    def rows(source):
        for batch in source:
            for doc, key, size, place, words, lead, item, other, other_lead, whole in zip(*(c.to_pylist() for c in batch.columns)):
                if place is None:
                    yield doc, key, size, None, None, None, 1
                    continue
                if other is None:
                    continue
                a, b = words.split(" "), other.split(" ")
                if whole:
                    if a == b:
                        yield doc, key, size, item, place, place + whole, 0
                    continue
                left = 0
                while left < min(lead, other_lead) and a[lead - left - 1] == b[other_lead - left - 1]:
                    left += 1
                right, room = 0, min(len(a) - lead, len(b) - other_lead)
                while right < room and a[lead + right] == b[other_lead + right]:
                    right += 1
                if right >= k and left + right >= n:
                    yield doc, key, size, item, place - left, place + right, 0

    return lambda source: batches(rows(source), schema), "id string, key long, n_words long, item_id string, start int, stop int, base long"


def bit_table(prints: DataFrame) -> bytes:
    """The fixed-size bit table of a `fp` column: BITS / 64 words at most reach the driver."""
    places = prints.select(F.explode(F.array(F.col("fp").bitwiseAND(BITS - 1), F.shiftrightunsigned("fp", 32).bitwiseAND(BITS - 1))).alias("bit"))
    words = places.groupBy(F.shiftright("bit", 6).cast("int").alias("at")).agg(F.bit_or(F.expr("shiftleft(1L, cast(bit & 63 AS int))")).alias("word"))
    table = np.zeros(BITS // 64, np.int64)
    for row in words.coalesce(8).toLocalIterator():
        table[row.at] = row.word
    return table.tobytes()


def contaminated_spans(docs: DataFrame, items: DataFrame, *, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id",
                       item_text: str = "text", n: int = WINDOW, k: int = GRAM) -> DataFrame:
    """Word ranges of documents that occur in benchmark items: id (as text), key, n_words, item_id, start, stop, base.

    One row with base = 1 and no range for each document row, and one with base = 0 for each range found. Words are
    runs of digits, ASCII letters in either case and non-ASCII characters. Null or empty texts have no words and no
    ranges; null items are never found. `key` is a hash of the text: rows of equal id and different text stay apart.
    """
    if not 1 <= k <= n:
        raise ValueError("a k-gram is not longer than the window")
    spark = prepare(docs.sparkSession)
    run, schema = _item_prints(n, k)
    prints = items.select(F.col(item_id).cast("string").alias("item_id"), F.col(item_text).cast("binary").alias("body")).mapInArrow(run, schema).distinct()
    short = [r.whole for r in prints.where("whole > 0").select("whole").distinct().collect()]  # n - 1 lengths at most
    shared = spark.sparkContext.broadcast(bit_table(prints))
    run, schema = _doc_prints(n, k, tuple(sorted(short)), shared)
    found = docs.select(F.col(doc_id).cast("string").alias("id"), row_key(F.col(text)).alias("key"), F.col(text).cast("binary").alias("body")).mapInArrow(run, schema)
    pairs = found.join(prints, "fp", "left").select("id", "key", "n_words", "place", "words", "lead", "item_id", "item_words", "item_lead", "whole")
    run, schema = _extend(n, k)
    return pairs.mapInArrow(run, schema)


def report(spans: DataFrame, share: tuple[int, int] = (1, 20)) -> DataFrame:
    """One row per (id, key): words, words inside any occurrence, the items found, and the verdict.

    `n_rows` tells how many document rows have this id and text. A document is contaminated when it has a hit and
    share[1] * n_hit >= share[0] * n_words. An item with a null id adds hits but no entry to `items`.
    """
    per = spans.groupBy("id", "key").agg(
        F.max("n_words").alias("n_words"), F.sum("base").alias("n_rows"), F.collect_set(F.when(F.col("start").isNotNull(), F.struct("start", "stop"))).alias("spans"),
        F.array_sort(F.collect_set("item_id")).alias("items"))
    covered = F.size(F.array_distinct(F.flatten(F.transform("spans", lambda s: F.sequence(s["start"], s["stop"] - 1))))).cast("long")
    return per.withColumn("n_hit", covered).withColumn("contaminated", (F.col("n_hit") > 0) & (F.col("n_hit") * share[1] >= F.col("n_words") * share[0]))


def decontaminate(docs: DataFrame, items: DataFrame, *, doc_id: str = "doc_id", text: str = "text", **kw) -> DataFrame:
    """Documents without the contaminated ones, all columns kept, whatever their names. Null ids and repeated rows are judged like others.

    Null and empty texts are clean; empty tables of documents or items are allowed.
    """
    bad = report(contaminated_spans(docs, items, doc_id=doc_id, text=text, **kw)).where("contaminated").select(F.col("id").alias("bad_id"), F.col("key").alias("bad_key"))
    rows = wrapped(docs, id=F.col(doc_id).cast("string"), key=row_key(F.col(text)))
    return rows.join(bad, F.col("id").eqNullSafe(F.col("bad_id")) & (F.col("key") == F.col("bad_key")), "left_anti").select("row.*")
