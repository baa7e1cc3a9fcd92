"""Best-fit packing planned on a histogram of lengths.

Tasks tokenize and cut documents and write one row per piece. The plan is made over counts: best fit, longest pieces
first, handles all pieces of one length and all open sequences of one filling at once, so its work and its size depend
on the capacity and not on the number of documents. A plan says which ranks of a length stand in which sequences. The
pieces are ranked within their length (by task and place in the task, so a length that most pieces share is never
sorted in one place) and take the slot of their rank.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from collections import defaultdict
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from juryframe.llm import tokens as K
from juryframe.llm.common import batches, cut, prepare

CAPACITY = 4096
#: A length and a rank in one key: the length stands above this many bits.
RANK_BITS = 48
#: Plan rows that may be broadcast. A plan of the usual capacity has some ten thousands, whatever the input.
MOST_RANGES = 4_000_000


@dataclass(frozen=True)
class Plan:
    """Ranges of ranks, sorted by length and first rank: `per` pieces of the range stand side by side in each sequence
    from `sequence` on, the first of them at `offset`."""

    length: np.ndarray
    first: np.ndarray
    per: np.ndarray
    sequence: np.ndarray
    offset: np.ndarray
    sequences: int

    @property
    def key(self) -> np.ndarray:
        return self.length << RANK_BITS | self.first


def best_fit(counts: dict[int, int], capacity: int = CAPACITY) -> Plan:
    """Best fit, longest first, over counts of lengths from 1 to `capacity`.

    Open sequences that hold the same are one group. A piece goes where the least room that suffices is left; further
    pieces of its length then find that same sequence the best fit, so a whole group takes as many as fit each.
    """
    rooms: list[int] = []  # distinct rooms left, ascending
    groups: dict[int, list[tuple[int, tuple]]] = defaultdict(list)  # room left -> (number of sequences, contents)

    def put(room: int, number: int, contents: tuple) -> None:
        if number:
            if not groups[room]:
                insort(rooms, room)
            groups[room].append((number, contents))

    for length in sorted(counts, reverse=True):
        left = counts[length]
        while left:
            at = bisect_left(rooms, length)
            if at == len(rooms):
                room, number, contents = capacity, -(-left // (capacity // length)), ()
            else:
                room = rooms[at]
                number, contents = groups[room].pop()
                if not groups[room]:
                    rooms.pop(at)
            fits = room // length
            full = min(number, left // fits)
            put(room - fits * length, full, (contents, length, fits))
            left -= full * fits
            if full < number and left:  # one more takes the rest
                put(room - left * length, 1, (contents, length, left))
                left, full = 0, full + 1
            put(room, number - full, contents)

    rows, used, sequence = [], dict.fromkeys(counts, 0), 0
    for room in sorted(groups):
        for number, contents in groups[room]:
            chain = []
            while contents:
                contents, length, per = contents
                chain.append((length, per))
            offset = 0
            for length, per in reversed(chain):
                rows.append((length, used[length], per, sequence, offset))
                used[length] += number * per
                offset += length * per
            sequence += number
    columns = np.array(sorted(rows), np.int64).reshape(-1, 5).T
    return Plan(*columns, sequences=sequence)


def _pieces(shared, how, end_id: int, capacity: int, keep_ids: bool):
    schema = pa.schema([("part", pa.int32()), ("local", pa.int64()), ("id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()),
                        ("length", pa.int64()), ("crc", pa.int64()), *([("ids", pa.list_(pa.int32()))] if keep_ids else [])])
    end = np.array([end_id], np.uint32)

    def rows(source):
        from pyspark import TaskContext

        (tokenizer, known), part = K._tokenizer(shared.value), TaskContext.get().partitionId()
        seen: dict[int, int] = defaultdict(int)
        for batch in source:
            docs = batch.column(0).to_pylist()
            for row, tokens in K._encoded(batch, 1, tokenizer, known, how):
                whole = np.concatenate([tokens, end]).astype("<u4")
                for piece, start in enumerate(range(0, len(whole), capacity)):
                    ids = whole[start:start + capacity]
                    local = seen[len(ids)]
                    seen[len(ids)] += 1
                    yield part, local, docs[row], piece, start, len(ids), zlib.crc32(ids.tobytes()), *([ids.astype(np.int32)] if keep_ids else [])

    names = "part int, local long, id long, piece int, start long, length long, crc long" + ", ids array<int>" * keep_ids
    return lambda source: batches(rows(source), schema, 512 if keep_ids else 4096), names


def _slots(shared):
    schema = pa.schema([("id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("crc", pa.int64()),
                        ("sequence", pa.int64()), ("offset", pa.int64())])

    def run(source):
        key, per, sequence, offset = shared.value
        for batch in source:
            length, rank = np.asarray(batch.column("length")), np.asarray(batch.column("rank"))
            at = np.searchsorted(key, length << RANK_BITS | rank, "right") - 1
            beyond = rank - (key[at] & ((1 << RANK_BITS) - 1))
            placed = [pa.array(sequence[at] + beyond // per[at]), pa.array(offset[at] + beyond % per[at] * length)]
            rest = [c for name, c in zip(batch.schema.names, batch.columns) if name == "ids"]
            out = pa.schema([*schema, pa.field("ids", pa.list_(pa.int32()))]) if rest else schema
            yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in schema.names[:5]), *placed, *(c.cast(pa.list_(pa.int32())) for c in rest)], schema=out)

    return run


def pack(docs: DataFrame, vocabulary: str, *, doc_id: str = "doc_id", text: str = "text", end_id: int = 1, capacity: int = CAPACITY,
         keep_ids: bool = False) -> DataFrame:
    """One row per piece: id, piece (from 0), start, length, crc (of its ids), sequence, offset; with `keep_ids` also ids.

    A document is its token ids and the end id; only one longer than `capacity` is cut, into pieces of that size and a
    rest. A null or empty text is the end id alone. Null and repeated ids stay rows of their own. The sequences are
    numbered from 0 without gaps and hold their pieces from offset 0 without gaps; an empty table gives no rows. Columns
    beside the two named are ignored. Tasks that run again may number pieces of equal length in another way.
    """
    from tokenizers import Tokenizer

    spark = prepare(docs.sparkSession)
    with open(vocabulary, encoding="utf-8") as file:
        rules = file.read()
    run, names = _pieces(spark.sparkContext.broadcast(rules), K.pieces_of(Tokenizer.from_str(rules)), end_id, capacity, keep_ids)
    # ranks count what a task wrote, so the pieces are written before they are counted
    made = cut(docs.select(F.col(doc_id).cast("long").alias("id"), F.coalesce(F.col(text), F.lit("")).cast("binary").alias("body")).mapInArrow(run, names))
    per_part = cut(made.groupBy("part", "length").agg(F.count("*").alias("n")))
    counts = {r["length"]: r["n"] for r in per_part.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # at most `capacity` rows
    plan = best_fit(counts, capacity)
    if len(plan.first) > MOST_RANGES:
        raise ValueError(f"a plan of {len(plan.first)} ranges for capacity {capacity}")
    shared = spark.sparkContext.broadcast((plan.key, plan.per, plan.sequence, plan.offset))
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    first = per_part.select("part", "length", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"))
    ranked = made.join(first, ["part", "length"]).withColumn("rank", F.col("first") + F.col("local"))
    wanted = ["id", "piece", "start", "length", "crc", "rank", *(["ids"] if keep_ids else [])]
    out = "id long, piece int, start long, length long, crc long, sequence long, offset long" + ", ids array<int>" * keep_ids
    return ranked.select(*wanted).mapInArrow(_slots(shared), out)


def sequences(placed: DataFrame) -> DataFrame:
    """The packed sequences of `pack(..., keep_ids=True)`: sequence, ids, pieces (id, piece, offset, length by offset)."""
    piece = F.struct("offset", "id", "piece", "length", "ids")
    held = placed.groupBy("sequence").agg(F.array_sort(F.collect_list(piece)).alias("p"))  # `capacity` ids at most
    return held.select("sequence", F.flatten("p.ids").alias("ids"),
                       F.transform("p", lambda p: F.struct(p["id"].alias("id"), p["piece"].alias("piece"), p["offset"].alias("offset"), p["length"].alias("length"))).alias("pieces"))
