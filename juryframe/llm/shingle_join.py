"""N-gram Jaccard join over blocks of the document by n-gram incidence.

Equal sets are one row of the matrix. Its columns are ordered from rare to common by a fixed-size count sketch of all
n-grams, and only the leading part of a row, as long as its size demands, can be the first place where a pair meets
(prefix filter). Columns with two rows or more are the blocks. A pair is discarded as soon as a bound on its overlap,
from the sizes, from the places in the two rows, or from the summed minima of their column-group counts, falls below
what its sizes require. The survivors get their exact overlap from the full rows.

Components need no more than a spanning set of links (`similar_documents`). For them a group of near copies is not
multiplied out: first each row meets only the leader of its block and size class. Then follow rounds in which each tile
of a block that holds several components names only pairs that span them, a forest; their links merge components
before the next round. When a round finds nothing new, what is still open between components is searched whole. The
join itself (`similar_pairs`) has every similar pair of different sets and searches the blocks at once. Large blocks
are cut into tiles of bounded size: rows of the largest component of a block meet the others only.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from juryframe.llm import words as W
from juryframe.llm.common import batches, cut, prepare, wrapped
from juryframe.llm.components import components
from juryframe.llm.decontaminate import _in, bit_table

SKETCH = 1 << 18
BINS = 256
TILE = 512
#: Rounds of forests before the rest is searched whole; sooner if a round's links are fewer than this share of all pairs tried.
ROUNDS, WORTH = 6, 0.05
U64 = np.uint64


@dataclass(frozen=True)
class Similar:
    """Jaccard similarity of num / den or more over sets of `n`-word shingles."""

    n: int = 3
    num: int = 9
    den: int = 10

    def lead(self, size: int) -> int:
        return size - -(-size * self.num // self.den) + 1


def _sets(batch: pa.RecordBatch, column: int, n: int):
    """(row, sorted distinct n-gram hashes) of each text; a text of fewer words is one gram, one of none has none."""
    for row, to, data, bounds in W.chunks(batch.column(column)):
        found = W.scan(data, bounds, W.SPACED, W.LOWER)
        values = W.grams(found.hash, n)
        first = found.first.tolist()
        for i in range(to - row):
            lo, hi = first[i], first[i + 1]
            if hi - lo >= n:
                yield row + i, np.unique(values[lo:hi - n + 1])
            else:
                yield row + i, W.grams(found.hash[lo:hi], hi - lo) if hi > lo else values[:0]


def _count(n: int):
    schema = pa.schema([("at", pa.int32()), ("c", pa.int64())])

    def run(source):
        counts = np.zeros(SKETCH, np.int64)
        for batch in source:
            for _, values in _sets(batch, 0, n):
                counts[(values & U64(SKETCH - 1)).astype(np.int64)] += 1
        at = np.flatnonzero(counts)
        for k in range(0, len(at), 1 << 16):
            part = at[k:k + (1 << 16)]
            yield pa.RecordBatch.from_arrays([pa.array(part.astype(np.int32)), pa.array(counts[part])], schema=schema)

    return run


def sketch(docs: DataFrame, text: str, n: int) -> np.ndarray:
    """Documents per n-gram, by the low bits of its hash: SKETCH counters whatever the corpus."""
    counted = docs.select(F.col(text).cast("binary")).mapInArrow(_count(n), "at int, c long").groupBy("at").agg(F.sum("c").alias("c"))
    out = np.zeros(SKETCH, np.int64)
    for row in counted.coalesce(8).toLocalIterator():
        out[row.at] = row.c
    return out


def _packed(counts: np.ndarray) -> bytes:
    """Column-group counts in half a byte, one or two bytes each, as the largest needs; they stop at 65,535."""
    most = counts.max()
    if most < 16:
        return (counts[::2] | counts[1::2] << 4).astype(np.uint8).tobytes()
    return counts.astype(np.uint8).tobytes() if most < 256 else np.minimum(counts, 65535).astype("<u2").tobytes()


def _opened(column: pa.Array) -> np.ndarray:
    """The counts of each row, (rows, BINS)."""
    blobs = column.to_pylist()
    size = np.fromiter(map(len, blobs), np.int64, len(blobs))
    out = np.empty((len(blobs), BINS), np.uint16)
    for wide, kind in ((BINS // 2, np.uint8), (BINS, np.uint8), (2 * BINS, "<u2")):
        at = np.flatnonzero(size == wide)
        if len(at):
            raw = np.frombuffer(b"".join([blobs[i] for i in at.tolist()]), kind).reshape(len(at), -1)
            if wide < BINS:
                raw = np.stack([raw & 15, raw >> 4], 2).reshape(len(at), BINS)
            out[at] = raw
    return out


def _rows(like: Similar, shared):
    schema = pa.schema([("id", pa.int64()), ("n", pa.int64()), ("digest", pa.binary()), ("lead", pa.list_(pa.int64())), ("bins", pa.binary())])

    def rows(source):
        counts = np.frombuffer(shared.value, np.int64)
        for batch in source:
            ids = batch.column(0).to_pylist()
            for row, values in _sets(batch, 1, like.n):
                size = len(values)
                if not size:
                    yield ids[row], 0, None, None, None
                    continue
                digest = np.array([W.mix(values ^ U64(c)).sum(dtype=U64) for c in (0x243F6A8885A308D3, 0x13198A2E03707344)] + [U64(size)])
                order = np.lexsort((values, counts[(values & U64(SKETCH - 1)).astype(np.int64)]))[:like.lead(size)]
                yield ids[row], size, digest.tobytes(), values[order].view(np.int64).tolist(), _packed(np.bincount((values >> U64(56)).astype(np.int64), minlength=BINS))

    return lambda source: batches(rows(source), schema, 1024), "id long, n long, digest binary, lead array<long>, bins binary"


def _full(like: Similar, shared):
    schema = pa.schema([("id", pa.int64()), ("body", pa.binary())])

    def rows(source):
        table = np.frombuffer(shared.value, U64)
        for batch in source:
            ids = batch.column(0).to_pylist()
            wanted = _in(table, batch.column(1).to_numpy(zero_copy_only=False).astype(np.int64).view(U64))
            keep = np.flatnonzero(wanted)
            part = batch.take(pa.array(keep))
            for row, values in _sets(part, 2, like.n):
                if len(values):
                    yield ids[keep[row]], values.tobytes()

    return lambda source: batches(rows(source), schema, 512), "id long, body binary"


def _verify(like: Similar):
    schema = pa.schema([("x", pa.int64()), ("y", pa.int64())])

    def rows(source):
        for batch in source:
            for x, y, a, b in zip(*(c.to_pylist() for c in batch.columns)):
                one, two = np.frombuffer(a, U64), np.frombuffer(b, U64)
                both = len(np.intersect1d(one, two, assume_unique=True))
                if both * like.den >= (len(one) + len(two) - both) * like.num:
                    yield x, y

    return lambda source: batches(rows(source), schema)


def _room(like: Similar):
    """Pairs whose column-group counts leave room for the overlap that their sizes require."""
    schema = pa.schema([("x", pa.int64()), ("y", pa.int64())])

    def run(source):
        for batch in source:
            x, y, n, m = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(4))
            one, two = _opened(batch.column(4)), _opened(batch.column(5))
            room = np.minimum(one, two).sum(1, dtype=np.int64)
            keep = (room * (like.num + like.den) >= (n + m) * like.num) | (n > 65535)
            yield pa.RecordBatch.from_arrays([pa.array(x[keep]), pa.array(y[keep])], schema=schema)

    return run


def _links(docs: DataFrame, pairs: DataFrame, doc_id: str, text: str, like: Similar) -> DataFrame:
    """Those of the pairs (x, y) whose full sets are similar enough."""
    spark = docs.sparkSession
    ends = pairs.select(F.explode(F.array("x", "y")).alias("id")).distinct()
    shared = spark.sparkContext.broadcast(bit_table(ends.select(F.xxhash64("id").alias("fp"))))
    run, schema = _full(like, shared)
    full = docs.select(F.col(doc_id).alias("id"), F.xxhash64(F.col(doc_id)).alias("fp"), F.col(text).cast("binary").alias("body")).where("id IS NOT NULL").mapInArrow(run, schema)
    full = cut(full.join(ends, "id", "left_semi"))
    joined = pairs.join(full.select(F.col("id").alias("x"), F.col("body").alias("a")), "x").join(full.select(F.col("id").alias("y"), F.col("body").alias("b")), "y")
    return cut(joined.select("x", "y", "a", "b").mapInArrow(_verify(like), "x long, y long"))


def _search(like: Similar, turn: int | None = None):
    """Pairs of different components within each block (or tile pair) that all bounds leave open.

    With a `turn`, only pairs that join what no earlier pair of the tile has joined, in an order that differs by turn;
    a tile that leaves pairs out says so by one pair of nulls.
    """
    schema = pa.schema([("x", pa.int64()), ("y", pa.int64())])

    def one(ids, n, pos, comp, side, upper, split, bins):
        order = np.lexsort((ids if turn is None else W.mix(ids.view(U64) + U64(turn)), n))
        left_out, given = False, comp[order]
        ids, n, pos, comp, side, upper, bins = ids[order], n[order], pos[order], comp[order], side[order], upper[order], bins[order]
        for a in range(len(ids) - 1):
            m = n[a + 1:]
            need = -(-(n[a] + m) * like.num // (like.num + like.den))
            may = (n[a] * like.den >= m * like.num) & (comp[a + 1:] != comp[a]) & (n[a] - pos[a] >= need) & (m - pos[a + 1:] >= need)
            if split:
                may &= side[a + 1:] != side[a]
            if upper[a]:
                may &= upper[a + 1:] == 0
            if n[a] - pos[a] < -(-2 * n[a] * like.num // (like.num + like.den)):
                continue
            at = np.flatnonzero(may)
            left_out |= bool(((comp[a + 1:] == comp[a]) & (given[a + 1:] != given[a])).any())
            if len(at):
                room = np.minimum(bins[a], bins[a + 1 + at]).sum(1, dtype=np.int64)
                for k in at[(room >= need[at]) | (n[a] > 65535)].tolist():
                    b = a + 1 + k
                    if turn is not None:
                        if comp[a] == comp[b]:
                            left_out = True
                            continue
                        comp[comp == comp[b]] = comp[a]
                    p, q = int(ids[a]), int(ids[b])
                    yield (p, q) if p < q else (q, p)
        if left_out:
            yield None, None

    def rows(source):
        held: list = []

        def groups():
            for batch in source:
                part = [batch.column(i).to_numpy(zero_copy_only=False) for i in range(10)] + [_opened(batch.column(10))]
                keys = np.stack(part[:4])
                edges = np.flatnonzero((keys[:, 1:] != keys[:, :-1]).any(0)) + 1
                at = [0, *edges.tolist(), batch.num_rows]
                for lo, hi in zip(at[:-1], at[1:]):
                    piece = [c[lo:hi] for c in part]
                    if held and all(held[0][i][0] == piece[i][0] for i in range(4)):
                        held.append(piece)
                    else:
                        if held:
                            yield [np.concatenate(c) for c in zip(*held)] if len(held) > 1 else held[0]
                        held[:] = [piece]
            if held:
                yield [np.concatenate(c) for c in zip(*held)] if len(held) > 1 else held[0]

        # a row is in many blocks: a pair is named once by a task
        seen: set = set()
        for _, _, lo, hi, ids, n, pos, comp, side, upper, bins in groups():
            if len(ids) > 1:
                for pair in one(ids, n, pos, comp, side, upper, lo[0] != hi[0], bins):
                    if pair not in seen:
                        seen.add(pair)
                        yield pair
                if len(seen) > 100_000:
                    seen.clear()

    return lambda source: batches(rows(source), schema)


def _mixed(comp: DataFrame) -> DataFrame:
    """The rows of blocks (h, k) that hold several components, with the largest component (`main`) and counts of its rows and of others."""
    placed = cut(comp.select("h", "k", "upper", "id", "n", "pos", "comp"))
    counts = placed.groupBy("h", "k", "comp").agg(F.count("*").alias("c"))
    blocks = counts.groupBy("h", "k").agg(F.max_by("comp", F.struct("c", "comp")).alias("main"), F.max("c").alias("mains"), F.sum("c").alias("m"))
    return placed.join(blocks.where("mains < m"), ["h", "k"]).withColumn("upper", F.col("upper").cast("int"))


def _single_tiles(mixed: DataFrame, turn: int) -> DataFrame:
    """Each row of a mixed block in one tile, another one each turn."""
    tile = F.pmod(F.xxhash64("id", F.lit(turn)), F.ceil(F.col("m") / TILE)).cast("int")
    return mixed.withColumns({"t1": tile, "t2": tile, "side": tile})


def _tiles(mixed: DataFrame) -> DataFrame:
    """Each pair of rows of different components of a mixed block in one tile.

    Rows outside the largest component are dealt to tiles 0, 1, ..., those of the largest to the tiles after these. Two
    tiles meet unless both are of the largest component, so a row is copied as often as there are tiles of the others
    (and a row of the others once more for each tile of the largest).
    """
    rows = mixed.withColumn("others", F.ceil((F.col("m") - F.col("mains")) / TILE).cast("int")).withColumn("all", F.col("others") + F.ceil(F.col("mains") / TILE).cast("int"))
    inside = F.col("comp") == F.col("main")
    spread = lambda n: F.pmod(F.xxhash64("id"), n).cast("int")
    rows = rows.withColumn("side", F.when(inside, F.col("others") + spread(F.col("all") - F.col("others"))).otherwise(spread(F.col("others"))))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.when(inside, F.col("others")).otherwise(F.col("all")) - 1)))
    return rows.withColumns({"t1": F.least("side", "other"), "t2": F.greatest("side", "other")})


def _pairs(tiles: DataFrame, part: DataFrame, like: Similar, turn: int | None = None) -> DataFrame:
    """Pairs (x, y) that the tiles leave open; one task reads a tile whole."""
    rows = tiles.join(part.select("id", "bins"), "id").select("h", "k", "t1", "t2", "id", "n", "pos", "comp", "side", "upper", "bins")
    parts = int(tiles.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rows.repartition(parts, "h", "k", "t1", "t2").sortWithinPartitions("h", "k", "t1", "t2").mapInArrow(_search(like, turn), "x long, y long")


def _joined(docs: DataFrame, doc_id: str, text: str, like: Similar, every: bool) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(rows, links, edges): id, n, rep (least id of equal sets); pairs of reps, all similar ones if `every`, else a spanning set; edges with the same components."""
    spark = prepare(docs.sparkSession)
    counts = spark.sparkContext.broadcast(sketch(docs, text, like.n).tobytes())
    run, schema = _rows(like, counts)
    rows = cut(docs.select(F.col(doc_id).cast("long").alias("id"), F.col(text).cast("binary").alias("body")).mapInArrow(run, schema))
    classes = cut(rows.where("n > 0 AND id IS NOT NULL").groupBy("digest").agg(F.min("id").alias("rep")))
    # dealt by id, as the joins on counts need them
    owned = cut(classes.groupBy(F.col("rep").alias("id")).agg(F.collect_set("digest").alias("held")))
    reps = rows.select("digest", "id", "n", "lead", "bins").join(owned, "id").where(F.array_contains("held", F.col("digest")))
    cells = reps.select("id", "n", F.posexplode("lead").alias("pos", "h"))
    blocks = cells.groupBy("h").agg(F.count("*").alias("m")).where("m > 1")
    step = math.log(like.den / like.num)
    cells = cells.join(blocks, "h").withColumn("c", F.floor(F.log("n") / step).cast("int"))
    near = cut(cells.withColumn("k", F.explode(F.array(F.col("c"), F.col("c") - 1))).withColumn("upper", F.col("k") < F.col("c")).select("h", "k", "upper", "id", "n", "pos"))
    leader = F.min(F.when(~F.col("upper"), F.struct(F.xxhash64("id").alias("o"), "id", "n")))
    groups = near.groupBy("h", "k").agg(F.count("*").alias("m"), leader.alias("l")).where("m > 1 AND l IS NOT NULL").select("h", "k", "m", F.col("l.id").alias("l"), F.col("l.n").alias("ln"))
    near = cut(near.join(groups, ["h", "k"]))

    part = reps.select("id", "n", "bins")
    if every:
        found = cut(_pairs(_tiles(_mixed(near.withColumn("comp", F.col("id")))), part, like).distinct())
        links = _links(docs, found, doc_id, text, like)
    else:
        alike = (F.least("n", "ln") * like.den >= F.greatest("n", "ln") * like.num) & (F.col("id") != F.col("l"))
        star = near.where(alike).select(F.least("id", "l").alias("x"), F.greatest("id", "l").alias("y")).distinct()
        star = star.join(part.toDF("x", "n", "a"), "x").join(part.toDF("y", "m", "b"), "y").select("x", "y", "n", "m", "a", "b")
        tried = cut(star.mapInArrow(_room(like), "x long, y long").distinct())
        links = _links(docs, tried, doc_id, text, like)
        turn, fresh_links = 0, links
        known = links.select(F.col("x").alias("node"), F.col("y").alias("root")).limit(0)
        while turn is not None:
            last = turn == ROUNDS
            # what is known is a set of stars already, so only the new links make steps
            known = components(known.select(F.col("node").alias("x"), F.col("root").alias("y")).unionByName(fresh_links))
            # components only merge, so the blocks that hold several are among those of the round before
            near = cut(_mixed(near.join(known.withColumnRenamed("node", "id"), "id", "left").withColumn("comp", F.coalesce("root", "id"))))
            if near.isEmpty():
                fresh_links = links.limit(0)
                break
            wide = not near.where(F.col("m") > TILE).isEmpty()
            found = cut(_pairs(_tiles(near) if last else _single_tiles(near, turn), part, like, None if last else turn).distinct())
            fresh = cut(found.where("x IS NOT NULL").join(tried, ["x", "y"], "left_anti"))
            verified = _links(docs, fresh, doc_id, text, like)
            links, tried, fresh_links = links.unionByName(verified), tried.unionByName(fresh), verified
            if last or not wide and found.where("x IS NULL").isEmpty():
                turn = None  # every open pair was named
            else:
                turn = turn + 1 if verified.count() > WORTH * tried.count() else ROUNDS
        edges = known.select(F.col("node").alias("x"), F.col("root").alias("y")).unionByName(fresh_links)
    return rows.join(classes, "digest", "left").select("id", "n", "rep"), links, links if every else edges


def similar_documents(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", like: Similar = Similar()) -> tuple[DataFrame, DataFrame]:
    """(rows, links): rows are id, n (set size), component; links are pairs (x, y) of ids of different sets.

    Words are runs of anything but ASCII white space, ASCII letters in lower case. A text without words has an empty
    set, links with nothing and is its own component. Copies of a set share the component of the copy with the least
    id; `component` is the least id reachable. Rows that share an id are one node. A null id has a null component.
    Links hold one spanning set for each component, not every similar pair; `similar_pairs` has them all.
    """
    rows, links, edges = _joined(docs, doc_id, text, like, False)
    final = components(edges)
    owned = rows.withColumn("rep", F.coalesce("rep", "id"))
    owned = owned.join(final, owned["rep"] == final["node"], "left")
    return owned.select("id", "n", F.when(F.col("id").isNotNull(), F.coalesce("root", "rep")).alias("component")), links


def similar_pairs(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", like: Similar = Similar()) -> tuple[DataFrame, DataFrame]:
    """(members, links) of the whole join: links are all pairs (x, y), x < y, of keys of different sets that are similar.

    Members are id, n (set size), set (key of the document's set, null if it has no words), n_links: how many other
    documents are similar to it, those of an equal set among them. Two documents are similar if they are members of one
    set or of two linked ones. Rows equal in id and text are one document; a row without an id takes no part.
    """
    named = docs.where(F.col(doc_id).isNotNull()).select(F.col(doc_id).cast("long").alias("doc"), F.col(text).alias("body")).distinct()
    named = cut(named.select(F.xxhash64("doc", "body").alias("node"), "doc", "body"))
    rows, links, _ = _joined(named, "node", "body", like, True)
    rows = cut(rows)
    sizes = rows.where("rep IS NOT NULL").groupBy(F.col("rep").alias("set")).agg(F.count("*").alias("held"))
    ends = links.select(F.col("x").alias("set"), F.col("y").alias("other")).unionByName(links.select(F.col("y").alias("set"), F.col("x").alias("other")))
    met = ends.join(sizes.toDF("other", "met"), "other").groupBy("set").agg(F.sum("met").alias("met"))
    counts = sizes.join(met, "set", "left").select("set", (F.col("held") - 1 + F.coalesce("met", F.lit(0))).alias("n_links"))
    members = rows.join(named.select("node", "doc"), rows["id"] == named["node"]).select(F.col("doc").alias("id"), "n", F.col("rep").alias("set"))
    return members.join(counts, "set", "left").select("id", "n", "set", F.coalesce("n_links", F.lit(0)).alias("n_links")), links


def one_of_each(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", like: Similar = Similar()) -> DataFrame:
    """Documents without all but the first (least id) of each component, all columns kept; null ids all stay.

    Of rows that share the kept id all stay.
    """
    rows, _ = similar_documents(docs, doc_id=doc_id, text=text, like=like)
    gone = rows.where("component < id").select(F.col("id").alias("gone")).distinct()
    return wrapped(docs, id=F.col(doc_id).cast("long")).join(gone, F.col("id") == F.col("gone"), "left_anti").select("row.*")
