"""Substring dedup by prefix-partitioned suffix trees.

Suffixes are taken at anchors: in every run of n words the smallest hash of k consecutive words. Equal runs have equal
anchors, so a run can only repeat where its anchor does, and anchors found in one document alone are dropped before
anything is sorted. The suffixes that are left, one for each run of n words, are split by a prefix of variable length: the
anchor's k words, or all n words where so many documents share the anchor that its group would not fit in memory. Each
part sorts its suffixes and reads off the deep internal nodes, those at depth n with leaves in several documents, with
the least document of each. A run is removed when its node has a smaller document than its own.

Documents are dealt to chunks; a chunk asks once for each distinct suffix with its own least document, so a passage that a
third of all documents share reaches a part once for each chunk. Word runs are compared by 64-bit hashes.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from juryframe.llm import words as W
from juryframe.llm.common import batches, cut, prepare, row_key
from juryframe.llm.decontaminate import _in, bit_table

WINDOW, GRAM = 50, 12
#: Documents of an anchor from which on suffixes are split by all their words.
MOST_SHARED = 20_000
CHUNK_WORDS = 1 << 21
U64 = np.uint64


def _anchors(found: W.Words, n: int, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first word of each run of n words inside one text, its anchor's place, hashes of all k-grams)."""
    values = W.grams(found.hash, k)
    least = W.lowest(values, n - k + 1)
    last = np.repeat(found.first[1:], np.diff(found.first))
    starts = np.flatnonzero(np.arange(len(least)) + n <= last[:len(least)])
    return starts, least[starts], values


def _list(n: int, k: int):
    schema = pa.schema([("id", pa.int64()), ("key", pa.int64()), ("n_words", pa.int64()), ("sha", pa.string()), ("h", pa.list_(pa.int64())), ("at", pa.list_(pa.int32()))])

    def rows(source):
        for batch in source:
            ids, keys = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for row, to, data, bounds in W.chunks(batch.column(2)):
                found = W.scan(data, bounds, W.SPACED)
                _, place, values = _anchors(found, n, k)
                place = np.unique(place)
                edges = np.searchsorted(place, found.first)
                hashes = values[place].view(np.int64)
                for i in range(to - row):
                    text = b" ".join(data[bounds[i]:bounds[i + 1]].tobytes().split())
                    a, b = edges[i], edges[i + 1]
                    yield ids[row + i], keys[row + i], int(found.first[i + 1] - found.first[i]), hashlib.sha256(text).hexdigest(), hashes[a:b].tolist(), (place[a:b] - found.first[i]).tolist()

    return lambda source: batches(rows(source), schema, 1024), "id long, key long, n_words long, sha string, h array<long>, at array<int>"


def _wanted(shared):
    def run(source):
        table = np.frombuffer(shared.value, U64)
        for batch in source:
            keep = _in(table, batch.column(2).to_numpy(zero_copy_only=False).view(U64))
            yield batch.filter(pa.array(keep))

    return run


def _suffixes(batch: pa.RecordBatch, n: int, k: int):
    """(row, place in the text of each suffix that may repeat, its n-word hash, its part key) for runs of texts."""
    places, wide = batch.column("at").to_pylist(), batch.column("wide").to_pylist()
    for row, to, data, bounds in W.chunks(batch.column("body")):
        found = W.scan(data, bounds, W.SPACED)
        starts, anchor, values = _anchors(found, n, k)
        open_, spread = np.zeros(len(found.hash) + 1, bool), np.zeros(len(found.hash) + 1, bool)
        for i in range(to - row):
            at = np.array(places[row + i], np.int64) + found.first[i]
            open_[at], spread[at] = True, np.array(wide[row + i], bool)
        keep = open_[anchor]
        starts, anchor = starts[keep], anchor[keep]
        full = W.grams(found.hash, n)[starts] if len(starts) else values[:0]
        yield row, to, found, starts, full, np.where(spread[anchor], full, values[anchor]) if len(starts) else full


def _chunk_suffixes(table: pa.Table, n: int, k: int):
    """Distinct suffixes of a chunk: hashes, part keys, least document of each."""
    full, part, docs = [], [], []
    for batch in table.to_batches():
        ids = batch.column("id").to_numpy()
        for row, to, found, starts, hashes, keys in _suffixes(batch, n, k):
            full.append(hashes)
            part.append(keys)
            docs.append(ids[row + np.searchsorted(found.first, starts, "right") - 1])
    full, part, docs = np.concatenate(full), np.concatenate(part), np.concatenate(docs)
    order = np.lexsort((docs, full))
    full, part, docs = full[order], part[order], docs[order]
    first = np.flatnonzero(np.concatenate([[True], full[1:] != full[:-1]])) if len(full) else np.empty(0, np.int64)
    return full[first], part[first], docs[first]


def _ask(n: int, k: int, parts: int):
    schema = pa.schema([("part", pa.int32()), ("chunk", pa.int32()), ("keys", pa.binary()), ("docs", pa.binary())])

    def run(key, table):
        full, part, docs = _chunk_suffixes(table, n, k)
        to, chunk = (W.mix(part) % U64(parts)).astype(np.int64), key[0].as_py()
        order = np.argsort(to, kind="stable")
        edges = np.searchsorted(to[order], np.arange(parts + 1))
        rows = ((p, chunk, full[at].tobytes(), docs[at].tobytes()) for p in range(parts) if len(at := order[edges[p]:edges[p + 1]]))
        return pa.Table.from_batches(batches(rows, schema, 64), schema)

    return run, "part int, chunk int, keys binary, docs binary"


def _subtree(requests):
    """Answers of one part: of the suffixes sorted by their words, those of a node with a smaller document, with that document."""
    schema = pa.schema([("chunk", pa.int32()), ("keys", pa.binary()), ("docs", pa.binary())])
    asked = [(c, np.frombuffer(k, U64), np.frombuffer(d, np.int64)) for c, k, d in zip(*(requests.column(x).to_pylist() for x in ("chunk", "keys", "docs")))]
    keys, docs = np.concatenate([k for _, k, _ in asked]), np.concatenate([d for *_, d in asked])
    order = np.lexsort((docs, keys))
    leaf = np.concatenate([[True], keys[order][1:] != keys[order][:-1]])
    least = np.empty(len(keys), np.int64)
    least[order] = docs[order][leaf][np.cumsum(leaf) - 1]

    def rows():
        at = 0
        for chunk, own, _ in asked:
            yield chunk, own.tobytes(), least[at:at + len(own)].tobytes()
            at += len(own)

    return pa.Table.from_batches(batches(rows(), schema, 16), schema)


def _remove(n: int, k: int):
    schema = pa.schema([("id", pa.int64()), ("key", pa.int64()), ("n_removed", pa.int64()), ("kept", pa.binary())])

    def run(key, left, right):
        answers = [(np.frombuffer(a, U64), np.frombuffer(b, np.int64)) for a, b in zip(right.column("keys").to_pylist(), right.column("docs").to_pylist())]
        keys = np.concatenate([a for a, _ in answers]) if answers else np.empty(0, U64)
        least = np.concatenate([b for _, b in answers]) if answers else np.empty(0, np.int64)
        order = np.argsort(keys)
        keys, least = keys[order], least[order]

        def rows():
            for batch in left.to_batches():
                ids, texts = batch.column("id").to_numpy(), batch.column("key").to_pylist()
                for row, to, found, starts, full, _ in _suffixes(batch, n, k):
                    text_of = np.searchsorted(found.first, starts, "right") - 1
                    gone = starts[least[np.searchsorted(keys, full)] < ids[row + text_of]] if len(starts) else starts
                    edge = np.zeros(len(found.hash) + n + 1, np.int32)
                    np.add.at(edge, gone, 1)
                    np.add.at(edge, gone + n, -1)
                    cover = np.cumsum(edge)[:len(found.hash)] > 0
                    for i in range(to - row):
                        lo, hi = int(found.first[i]), int(found.first[i + 1])
                        kept = np.flatnonzero(~cover[lo:hi]) + lo
                        words = b" ".join(found.data[a:b].tobytes() for a, b in zip(found.start[kept].tolist(), found.end[kept].tolist()))
                        if len(kept) < hi - lo:
                            yield int(ids[row + i]), texts[row + i], hi - lo - len(kept), words

        return pa.Table.from_batches(batches(rows(), schema, 256), schema)

    return run, "id long, key long, n_removed long, kept binary"


def repeats_removed(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", n: int = WINDOW, k: int = GRAM) -> tuple[DataFrame, DataFrame]:
    """(all, changed). `all`: id, key, n_words, sha (of all words joined by one space), one row per document.

    `changed`: id, key, n_removed, kept (the words left, joined by one space) for each text that loses words, which are
    those inside a run of n words that also starts in a document with a smaller id. Runs inside one document do not
    count, nor do documents with a null id. Words are parted by ASCII white space; null and short texts lose nothing.
    """
    if not 1 <= k <= n:
        raise ValueError("an anchor is not longer than the run")
    spark = prepare(docs.sparkSession)
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    body = docs.select(F.col(doc_id).cast("long").alias("id"), row_key(F.col(text)).alias("key"), F.col(text).cast("binary").alias("body"))
    run, schema = _list(n, k)
    rows = cut(body.mapInArrow(run, schema))
    cells = rows.where("id IS NOT NULL").select("id", "key", F.explode(F.arrays_zip("h", "at")).alias("c")).select("id", "key", "c.h", "c.at")
    shared = cells.groupBy("h").agg(F.min("id").alias("lo"), F.max("id").alias("hi"), F.count("*").alias("m")).where("lo < hi")
    met = cells.join(shared.select("h", (F.col("m") > MOST_SHARED).alias("wide")), "h")
    open_ = cut(met.groupBy("id", "key").agg(F.collect_set(F.struct("at", "wide")).alias("c")).select("id", "key", F.col("c.at").alias("at"), F.col("c.wide").alias("wide")))

    table = spark.sparkContext.broadcast(bit_table(open_.select(F.xxhash64("id", "key").alias("fp"))))
    likely = body.where("id IS NOT NULL").select("id", "key", F.xxhash64("id", "key").alias("fp"), "body").mapInArrow(_wanted(table), "id long, key long, fp long, body binary")
    words = rows.agg(F.sum("n_words")).first()[0] or 0
    chunks = max(1, -(-words // CHUNK_WORDS))
    found = cut(likely.join(open_, ["id", "key"]).select(F.pmod("fp", F.lit(chunks)).cast("int").alias("chunk"), "id", "key", "body", "at", "wide"))
    run, schema = _ask(n, k, parts)
    asked = found.groupBy("chunk").applyInArrow(run, schema)
    answers = cut(asked.groupBy("part").applyInArrow(_subtree, "chunk int, keys binary, docs binary"))
    run, schema = _remove(n, k)
    changed = found.groupBy("chunk").cogroup(answers.groupBy("chunk")).applyInArrow(run, schema).dropDuplicates(["id", "key"])
    return rows.select("id", "key", "n_words", "sha"), changed
