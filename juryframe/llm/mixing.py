"""Mixing sources to target weights by a low-discrepancy schedule.

Targets: each source has a weight and may give at most `repeats` times its words; the wanted total is poured over the
sources by weight, and what a full source cannot take goes to the others. Ordered by size over weight, the full
sources come first, so one running sum finds the level at which the rest stand.

Schedule: slot i has the van der Corput point of i, and the source whose share of the cumulative targets holds that
point. The r-th slot of a source takes the r-th block of `block_words` words of its shuffled documents, which are read
round again after their end. A source's count of slots strays from its share by the logarithm of the slots at most;
what is missing is added after the last slot, and what is over is left out, so each source gives its target to the
word.

Running sums over a source are cut into chunks by hash, and joins on a source are salted: no task holds a source.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from juryframe.llm.common import SPACE, cut, row_key, wrapped

WEIGHTS = (5, 2, 1)
BLOCK_WORDS = 1024
#: Chunks of a running sum are told apart by this many hex digits of the shuffle hash.
CHUNK_DIGITS = 3
SALTS, CELLS, SLOT_CHUNK, POINT_BITS = 32, 1024, 1 << 14, 48


def sizes(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", source: str = "source", seed: str = "mix") -> DataFrame:
    """One row per document: id, key, source, size in words, and the hash that shuffles it. A null text has size 0."""
    body = F.coalesce(F.col(text), F.lit(""))
    return docs.select(
        F.col(doc_id).alias("id"), row_key(F.col(text)).alias("key"), F.col(source).alias("source"),
        F.size(F.array_remove(F.split(body, SPACE), "")).cast("long").alias("size"),
        F.md5(F.concat(F.coalesce(F.col(doc_id).cast("string"), F.lit("")), F.lit(f":{seed}"))).alias("order"))


def targets(sized: DataFrame, *, weights: tuple[int, ...] = WEIGHTS, share: float = 1.5, repeats: int = 2) -> DataFrame:
    """One row per source: s (rank by code point, null last), source, source_size, weight, target.

    Windows here run over one row per source. Sources of no words get target 0; if all are full, each stands at its
    limit.
    """
    by_name, by_level = Window.orderBy(F.col("source").asc_nulls_last()), Window.orderBy("level", "s")
    per = sized.groupBy("source").agg(F.sum("size").alias("source_size")).withColumn("s", F.row_number().over(by_name) - 1)
    per = per.withColumn("weight", F.get(F.array(*map(F.lit, weights)), F.col("s") % len(weights)))
    per = per.withColumn("most", F.col("source_size") * repeats).withColumn("level", F.col("most") / F.col("weight"))
    before = by_level.rowsBetween(Window.unboundedPreceding, -1)
    everyone = Window.partitionBy(F.lit(1))
    per = per.withColumn("full", F.coalesce(F.sum("most").over(before), F.lit(0))).withColumn("open", F.sum("weight").over(by_level.rowsBetween(0, Window.unboundedFollowing)))
    per = per.withColumn("stand", (F.sum("source_size").over(everyone) * F.lit(float(share)) - F.col("full")) / F.col("open"))
    per = per.withColumn("stand", F.min(F.when(F.col("stand") * F.col("weight") <= F.col("most"), F.struct("level", "s", "stand"))).over(everyone)["stand"])
    target = F.least(F.col("most").cast("double"), F.coalesce(F.col("stand") * F.col("weight"), F.col("most").cast("double")))
    return per.select("s", "source", "source_size", "weight", target.alias("target"), F.round(target).cast("long").alias("words"))


def running(df: DataFrame, keys: list[str], chunk: str, order: list[str], value: Column, name: str) -> DataFrame:
    """`df` with the sum of `value` over all earlier rows of its keys; chunks come in the order of `chunk`."""
    df = df.withColumn("_v", value)
    inside = Window.partitionBy(*keys, chunk).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    over = Window.partitionBy(*keys).orderBy(chunk).rowsBetween(Window.unboundedPreceding, -1)
    before = df.groupBy(*keys, chunk).agg(F.sum("_v").alias("_all")).withColumn("_before", F.coalesce(F.sum("_all").over(over), F.lit(0))).drop("_all")
    inner = df.withColumn("_in", F.coalesce(F.sum("_v").over(inside), F.lit(0)))
    return inner.join(before, [*keys, chunk]).withColumn(name, F.col("_before") + F.col("_in")).drop("_v", "_in", "_before")


def streams(sized: DataFrame, goal: DataFrame) -> DataFrame:
    """`sized` with s, source_size, target, words and `start`: the words before the document in its shuffled source."""
    salted = goal.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    docs = sized.withColumn("salt", F.pmod(F.xxhash64("order"), F.lit(SALTS)).cast("int")).alias("d")
    joined = docs.join(salted.alias("g"), F.col("d.source").eqNullSafe(F.col("g.source")) & (F.col("d.salt") == F.col("g.salt")))
    joined = joined.select("d.id", "d.key", "d.size", "d.order", F.substring("d.order", 1, CHUNK_DIGITS).alias("chunk"), "g.s", "g.source_size", "g.target", "g.words")
    return running(joined, ["s"], "chunk", ["order", "id", "size", "key"], F.col("size"), "start")


def schedule(goal: DataFrame, block_words: int = BLOCK_WORDS) -> DataFrame:
    """slot, s, block: which block of which source stands in each slot. Slots run from 0; a source's blocks rise."""
    per = goal.withColumn("blocks", F.ceil(F.col("words") / block_words).cast("long"))
    total = per.agg(F.sum("blocks")).first()[0] or 0
    whole = Window.partitionBy(F.lit(1))
    edges = per.withColumn("hi", F.sum("blocks").over(Window.orderBy("s").rowsBetween(Window.unboundedPreceding, 0))).withColumn("lo", F.col("hi") - F.col("blocks"))
    edges = edges.where("blocks > 0").withColumn("all", F.sum("blocks").over(whole))
    cell = lambda c: F.floor(c * CELLS / F.col("all")).cast("int")
    cells = edges.withColumn("cell", F.explode(F.sequence(cell(F.col("lo")), F.least(cell(F.col("hi")), F.lit(CELLS - 1)))))
    point = F.conv(F.reverse(F.lpad(F.bin("slot"), POINT_BITS, "0")), 2, 10).cast("double") / float(1 << POINT_BITS)
    slots = goal.sparkSession.range(total).select(F.col("id").alias("slot")).withColumn("at", point * float(total)).withColumn("cell", F.floor(F.col("at") * CELLS / float(max(total, 1))).cast("int"))
    placed = slots.join(cells, "cell").where((F.col("at") >= F.col("lo")) & (F.col("at") < F.col("hi"))).select("slot", "s", "blocks", F.floor(F.col("slot") / SLOT_CHUNK).alias("chunk"))
    ranked = cut(running(placed, ["s"], "chunk", ["slot"], F.lit(1).cast("long"), "block").where("block < blocks").select("slot", "s", "block"))
    given = ranked.groupBy("s").agg(F.count("*").alias("given"))
    short = per.join(given, "s", "left").withColumn("given", F.coalesce("given", F.lit(0))).where("given < blocks")
    late = short.select("s", F.explode(F.sequence(F.col("given"), F.col("blocks") - 1)).alias("block"))
    return ranked.unionByName(late.select((F.lit(total) + F.col("block") * F.lit(1)).alias("slot"), "s", "block"))


def pieces(streamed: DataFrame, slots: DataFrame, *, repeats: int = 2, block_words: int = BLOCK_WORDS) -> DataFrame:
    """The mix: slot, s, block, id, key, size, start, from_word, n_words; one row per document and block it reaches into."""
    rounds = streamed.where("size > 0").withColumn("round", F.explode(F.sequence(F.lit(0), F.lit(repeats - 1))))
    rounds = rounds.withColumn("a", F.col("start") + F.col("round") * F.col("source_size")).withColumn("b", F.least(F.col("a") + F.col("size"), F.col("words"))).where("a < b")
    cut_up = rounds.withColumn("block", F.explode(F.sequence(F.floor(F.col("a") / block_words), F.floor((F.col("b") - 1) / block_words))))
    lo, hi = F.greatest(F.col("a"), F.col("block") * block_words), F.least(F.col("b"), (F.col("block") + 1) * block_words)
    parts = cut_up.select("s", "block", "id", "key", "size", "start", (lo - F.col("a")).alias("from_word"), (hi - lo).alias("n_words"))
    return parts.join(slots, ["s", "block"])


def mix(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", source: str = "source", weights: tuple[int, ...] = WEIGHTS,
        share: float = 1.5, repeats: int = 2, block_words: int = BLOCK_WORDS, seed: str = "mix") -> tuple[DataFrame, DataFrame]:
    """(streamed documents, pieces of the mix). Null sources are one source, null ids and repeated rows are rows like others.

    A document of no words takes part in no block. An empty table gives an empty mix.
    """
    sized = cut(sizes(docs, doc_id=doc_id, text=text, source=source, seed=seed))
    goal = cut(targets(sized, weights=weights, share=share, repeats=repeats))
    # each has many readers: written once, so that no plan holds their windows and joins again for each
    streamed = cut(streams(sized, goal))
    return streamed, pieces(streamed, cut(schedule(goal, block_words)), repeats=repeats, block_words=block_words)


def taken(streamed: DataFrame, parts: DataFrame) -> DataFrame:
    """One row per document: id, key, size, source_size, target, taken (words of it in the mix, repeats counted)."""
    key = ["id", "key", "s", "size", "start"]
    none = streamed.select(*key, "source_size", "target", F.lit(0).cast("long").alias("n_words"), F.lit(1).alias("base"))
    some = parts.select(*key, F.lit(None).cast("long").alias("source_size"), F.lit(None).cast("double").alias("target"), "n_words", F.lit(0).alias("base"))
    per = none.unionByName(some).groupBy(*key).agg(F.max("source_size").alias("source_size"), F.max("target").alias("target"), F.sum("n_words").alias("taken"), F.sum("base").alias("_n"))
    return per.withColumn("_row", F.explode(F.sequence(F.lit(1).cast("long"), F.col("_n")))).drop("_row", "_n")


def mixed_documents(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", source: str = "source", weights: tuple[int, ...] = WEIGHTS,
                    share: float = 1.5, repeats: int = 2, block_words: int = BLOCK_WORDS, seed: str = "mix") -> DataFrame:
    """Whole documents of the mix, all columns kept, whatever their names: one copy for each scheduled block that a document begins in.

    A document whose first word the mix takes is taken whole, so a source may exceed its target by the end of one
    document. Null and empty texts have no words, begin in no block and stay once. Null sources are one source; rows
    that share id and text are told apart by their source alone. An empty table gives none.
    """
    streamed, parts = mix(docs, doc_id=doc_id, text=text, source=source, weights=weights, share=share, repeats=repeats, block_words=block_words, seed=seed)
    key = ["id", "key", "s", "start", "size"]
    begun = parts.where("from_word = 0").select(*key, F.lit(1).alias("begins"), F.lit(0).alias("stands"))
    every = streamed.select(*key, (F.col("size") == 0).cast("int").alias("begins"), F.lit(1).alias("stands"))
    # empty documents may share all of the key: what stands more than once is shared out below
    per = every.unionByName(begun).groupBy(*key).agg(F.sum("begins").alias("begins"), F.sum("stands").alias("stands"))
    per = per.withColumn("copies", F.explode(F.sequence(F.lit(1).cast("long"), F.col("stands")))).select("id", "key", (F.col("begins") / F.col("stands")).cast("int").alias("copies"))
    held = per.groupBy(F.col("id").alias("held_id"), F.col("key").alias("held_key")).agg(F.array_sort(F.collect_list("copies")).alias("copies"))
    rows = wrapped(docs, id=F.col(doc_id), key=row_key(F.col(text)), source=F.col(source))
    rows = rows.withColumn("place", F.row_number().over(Window.partitionBy("id", "key").orderBy("source")))
    joined = rows.join(held, F.col("id").eqNullSafe(F.col("held_id")) & (F.col("key") == F.col("held_key"))).withColumn("times", F.get("copies", F.col("place") - 1))
    return joined.where("times > 0").select("row", F.explode(F.sequence(F.lit(1), F.col("times")))).select("row.*")
