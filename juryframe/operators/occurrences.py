"""Every occurrence of many quotes in texts, overlapping ones too, with code-point, byte and line places.

Each task searches whole texts for all quotes at once with one automaton. The quotes are a stated set; they go to the
tasks in blocks of bounded size, one pass a block, so neither a broadcast nor an automaton grows with the set.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from juryframe.functions import text as T

#: Characters of quotes in one block.
BLOCK_CHARS = 4_000_000
_SCHEMA = "quote string, doc string, start long, end long, byte_start long, byte_end long, line_start long, line_end long"
_BREAK = re.compile(T.LINE_BREAK_PY)


def _search(shared):
    names = [f.strip().split()[0] for f in _SCHEMA.split(",")]
    kinds = [pa.string(), pa.string(), *[pa.int64()] * 6]

    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import ahocorasick

        machine = ahocorasick.Automaton()
        for body in shared.value:
            machine.add_word(body, body)
        machine.make_automaton()
        for batch in source:
            out = []
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                found = [(end + 1 - len(body), end + 1, body) for end, body in machine.iter(text)]
                if not found:
                    continue
                # one pass over the text gives bytes before each character and the last character of each line
                points = np.frombuffer(text.encode("utf-32-le"), np.uint32)
                width = 1 + (points > 0x7F).astype(np.int64) + (points > 0x7FF) + (points > 0xFFFF)
                before = np.concatenate([[0], np.cumsum(width)])
                ends = np.array([m.end() for m in _BREAK.finditer(text)], np.int64)
                line = lambda at: int(np.searchsorted(ends, at, "right")) + 1
                out += [(body, doc, a, b, int(before[a]), int(before[b]), line(a), line(b - 1)) for a, b, body in found]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], names)

    return run


def occurrences(quotes: DataFrame, texts: DataFrame, *, quote: str = "quote", doc: str = "doc", text: str = "text", block_chars: int = BLOCK_CHARS) -> DataFrame:
    """quote, doc, start, end (code points, end exclusive), byte_start, byte_end, line_start, line_end, for each place.

    Equal quotes are one; null and empty ones occur nowhere. Null texts hold nothing. Rows that share a doc are searched
    each for itself. A CR LF is one line break.
    """
    spark = texts.sparkSession
    distinct = quotes.select(F.col(quote).alias("q")).where(F.length("q") > 0).distinct()
    blocks, held, size = [], [], 0
    for row in distinct.toLocalIterator():  # one block at a time stays on the driver beyond the broadcasts
        if held and size + len(row.q) > block_chars:
            blocks.append(spark.sparkContext.broadcast(held))
            held, size = [], 0
        held.append(row.q)
        size += len(row.q)
    if held:
        blocks.append(spark.sparkContext.broadcast(held))
    if not blocks:
        return spark.createDataFrame([], _SCHEMA)
    rows = texts.select(F.col(doc).cast("string").alias("doc"), F.col(text).alias("text")).where("text IS NOT NULL")
    return reduce(DataFrame.unionByName, [rows.mapInArrow(_search(b), _SCHEMA) for b in blocks])


def located(claims: DataFrame, found: DataFrame, *, quote: str = "quote", doc: str = "doc", start: Column | None = None, stop: Column | None = None) -> DataFrame:
    """`claims` (a quote said to stand in a doc) with status, reason and place.

    A claim without a quote is "missing". One that gives its offsets is a "candidate" if the quote stands exactly
    there. One without offsets is a candidate if the doc holds the quote once: with none or several places it is
    "rejected", for nothing is chosen among them. An empty quote is no occurrence.
    """
    given = start if start is not None else F.lit(None).cast("long")
    until = stop if stop is not None else F.lit(None).cast("long")
    row = F.struct(*[F.col(f"`{c}`") for c in claims.columns]).alias("row")
    asked = claims.select(row, F.col(quote).alias("q"), F.col(doc).cast("string").alias("d"), given.cast("long").alias("a"), until.cast("long").alias("b"))
    names = ("start", "end", "byte_start", "byte_end", "line_start", "line_end")
    whole = F.struct(*[F.col(f"found.{n}").alias(n) for n in names])
    # how often a quote stands in a doc and its only place; a place given is looked up by its own key
    place = F.struct(*names)
    per = found.groupBy(F.col("quote").alias("per_quote"), F.col("doc").alias("per_doc")).agg(F.count("*").alias("n"), F.min(place).alias("only"))
    out = asked.join(per, (F.col("q") == F.col("per_quote")) & (F.col("d") == F.col("per_doc")), "left")
    exact = found.alias("found").select(F.col("quote").alias("at_quote"), F.col("doc").alias("at_doc"), F.col("start").alias("at_start"), F.col("end").alias("at_end"), whole.alias("exact")).distinct()
    out = out.join(exact, (F.col("q") == F.col("at_quote")) & (F.col("d") == F.col("at_doc")) & (F.col("a") == F.col("at_start")) & (F.col("b") == F.col("at_end")), "left")
    offsets = F.col("a").isNotNull() | F.col("b").isNotNull()
    reason = (F.when(F.col("q").isNull(), "null value").when(F.col("q") == "", "empty value is no occurrence")
              .when(offsets & F.col("exact").isNull(), "value does not stand at the offsets")
              .when(~offsets & F.col("n").isNull(), "absent").when(~offsets & (F.col("n") > 1), "ambiguous"))
    status = F.when(F.col("q").isNull(), "missing").when(F.col("reason").isNull(), "candidate").otherwise("rejected")
    spot = F.when(F.col("status") == "candidate", F.when(offsets, F.col("exact")).otherwise(F.col("only")))
    out = out.withColumn("reason", reason).withColumn("status", status).withColumn("spot", spot)
    return out.select("row.*", "status", "reason", *[F.col(f"spot.{n}").alias(n) for n in names])
