"""Language-model scoring by deleted interpolation.

Exact counts of all words and all pairs of words, with nothing cut at any size: documents are dealt to chunks by hash;
each chunk asks once for each of its words and pairs, and the requests meet in parts by key hash, which answer with the
counts over all training documents. No count table is broadcast or collected.

Each text is its words and an end, and starts after an end. P(word | word before) is a sum of the pair estimate, the
single-word estimate and the uniform one. A word is the context of as many pairs as it has occurrences, so its own
count is also the count of its context. The weights depend on how often the context was seen (a bucket for each power
of two) and are learned by expectation-maximisation, each pair's count being held out from itself (one occurrence is
deleted from numerators and denominators). Only these weights and the totals are broadcast. Words and pairs are told
apart by 64-bit hashes.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from juryframe.llm import words as W
from juryframe.llm.common import batches, cut, prepare

CHUNK_BYTES = 12 << 20
EM_ROUNDS = 40
U64 = np.uint64
#: Stands for the end of a text among word hashes.
END = U64(0x9D39247E33776D41)
_PAIR = U64(0xD6E8FEB86659FD93)


def _held(docs: DataFrame, doc_id: str, text: str, folds: int, fold: int) -> DataFrame:
    """id, held, body: a null id counts as the text of no characters when folds are dealt."""
    out = F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")) % folds == fold
    return docs.select(F.col(doc_id).alias("id"), out.alias("held"), F.coalesce(F.col(text), F.lit("")).cast("binary").alias("body"))


def _chunked(held: DataFrame) -> DataFrame:
    size = held.agg(F.sum(F.length("body"))).first()[0] or 0
    return held.withColumn("chunk", F.pmod(F.xxhash64("id", "body"), F.lit(max(1, -(-size // CHUNK_BYTES)))).cast("int"))


def _texts(table: pa.Table) -> tuple[list, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(ids, held, sizes, words, pairs) of a chunk: each text is its words and an end; a pair ends at its word."""
    sizes, words, pairs = [], [], []
    for batch in table.to_batches():
        for row, to, data, bounds in W.chunks(batch.column("body")):
            found = W.scan(data, bounds, W.SPACED, W.LOWER)
            size = np.diff(found.first)
            word = np.full(len(found.hash) + to - row, END, U64)
            word[np.arange(len(found.hash)) + np.repeat(np.arange(to - row), size)] = found.hash
            before = np.concatenate([np.array([END], U64), word[:-1]])
            sizes.append(size + 1)
            words.append(word)
            pairs.append(W.mix(before * _PAIR + word))
    held = table.column("held").to_numpy()
    return table.column("id").to_pylist(), held.astype(bool), *(np.concatenate(x) for x in (sizes, words, pairs))


def _dealt(keys: np.ndarray, parts: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(distinct keys, place of each key among them, their order by part, where each part starts in that order)."""
    distinct, inverse = np.unique(keys, return_inverse=True)
    part = (distinct % U64(parts)).astype(np.int64)
    order = np.argsort(part, kind="stable")
    return distinct, inverse, order, np.searchsorted(part[order], np.arange(parts + 1))


def _narrow(counts: np.ndarray) -> bytes:
    """Counts in the least whole number of bytes that holds them all."""
    return counts.astype(np.min_scalar_type(int(counts.max(initial=0)))).tobytes()


def _wide(raw: bytes, n: int) -> np.ndarray:
    return np.frombuffer(raw, f"<u{len(raw) // n}").astype(np.int64) if n else np.empty(0, np.int64)


def _ask(parts: int):
    schema = pa.schema([("part", pa.int32()), ("chunk", pa.int32()), *[(n, pa.binary()) for n in ("words", "word_n", "pairs", "pair_n")]])

    def run(key, asking):
        _, held, sizes, *keys = _texts(asking)
        used = np.repeat(~held, sizes)
        chunk, kinds = key[0].as_py(), []
        for values in keys:
            distinct, inverse, order, edges = _dealt(values, parts)
            kinds.append((distinct[order], np.bincount(inverse[used], minlength=len(distinct))[order], edges))

        def rows():
            for p in range(parts):
                at = [slice(edges[p], edges[p + 1]) for _, _, edges in kinds]
                if any(s.stop > s.start for s in at):
                    yield p, chunk, *(x for (k, n, _), s in zip(kinds, at) for x in (k[s].tobytes(), _narrow(n[s])))

        return pa.Table.from_batches(batches(rows(), schema, 64), schema)

    return run, "part int, chunk int, words binary, word_n binary, pairs binary, pair_n binary"


def _answer(key, requests):
    """For each chunk the total counts of its words and pairs, in the order asked; chunk -1 has the totals of this part."""
    schema = pa.schema([("part", pa.int32()), ("chunk", pa.int32()), ("word_n", pa.binary()), ("pair_n", pa.binary()), ("tokens", pa.int64()), ("types", pa.int64())])
    part, chunks, kinds = key[0].as_py(), requests.column("chunk").to_pylist(), []
    for name in ("word", "pair"):
        keys = [np.frombuffer(k, U64) for k in requests.column(name + "s").to_pylist()]
        counts = [_wide(n, len(k)) for n, k in zip(requests.column(name + "_n").to_pylist(), keys)]
        distinct, inverse = np.unique(np.concatenate(keys), return_inverse=True)
        total = np.zeros(len(distinct), np.int64)
        np.add.at(total, inverse, np.concatenate(counts))
        kinds.append((total, inverse, np.cumsum([0, *map(len, keys)])))

    def rows():
        words = kinds[0][0]
        yield part, -1, b"", b"", int(words.sum()), int((words > 0).sum())
        for i, chunk in enumerate(chunks):
            yield part, chunk, *(_narrow(total[inverse[at[i]:at[i + 1]]]) for total, inverse, at in kinds), 0, 0

    return pa.Table.from_batches(batches(rows(), schema, 16), schema)


def _counted(left: pa.Table, right: pa.Table, parts: int):
    """(ids, held, sizes, count of each word, of the word before it, of the pair) of a chunk and its replies."""
    ids, held, sizes, *keys = _texts(left)
    replies = sorted(zip(*(right.column(n).to_pylist() for n in ("part", "word_n", "pair_n"))))
    counts = []
    for k, values in enumerate(keys, 1):
        distinct, inverse, order, edges = _dealt(values, parts)
        total = np.empty(len(distinct), np.int64)
        total[order] = np.concatenate([_wide(r[k], edges[r[0] + 1] - edges[r[0]]) for r in replies])
        if k == 1:
            ends = total[np.searchsorted(distinct, END)]
        counts.append(total[inverse])
    word, pair = counts
    return ids, held, sizes, word, np.concatenate([[ends], word[:-1]]), pair


def _bucket(context: np.ndarray) -> np.ndarray:
    return np.floor(np.log2(np.maximum(context, 1))).astype(np.int32)


def _cells(tokens: int, parts: int):
    """Training pairs by bucket of the context and half octaves of the two held-out estimates."""
    schema = pa.schema([("bucket", pa.int32()), ("q2", pa.int32()), ("q1", pa.int32()), ("n", pa.int64())])

    def run(key, left, right):
        _, held, sizes, word, before, pair = _counted(left, right, parts)
        used = np.repeat(~held, sizes)
        word, before, pair = word[used], before[used], pair[used]
        with np.errstate(divide="ignore"):
            q2, q1 = (np.where(p > 0, np.round(2 * np.log2(p)), -999).astype(np.int64) for p in ((pair - 1) / np.maximum(before - 1, 1), (word - 1) / max(tokens - 1, 1)))
        code, n = np.unique(_bucket(before).astype(np.int64) << 32 | q2 + 1000 << 16 | q1 + 1000, return_counts=True)
        columns = [(code >> 32).astype(np.int32), ((code >> 16 & 0xFFFF) - 1000).astype(np.int32), ((code & 0xFFFF) - 1000).astype(np.int32), n.astype(np.int64)]
        return pa.Table.from_arrays([pa.array(c) for c in columns], schema=schema)

    return run, "bucket int, q2 int, q1 int, n long"


def mixture(cells: list[tuple[int, int, int, int]], uniform: float, rounds: int = EM_ROUNDS) -> np.ndarray:
    """Weights (64 buckets x pair, single, uniform) by expectation-maximisation; a bucket without cells trusts no pair."""
    weights = np.tile([0.0, 0.9, 0.1], (64, 1))
    table = np.array(cells, np.float64).reshape(-1, 4)
    p = np.stack([np.where(table[:, 1] > -999, 2 ** (table[:, 1] / 2), 0), np.where(table[:, 2] > -999, 2 ** (table[:, 2] / 2), 0), np.full(len(table), uniform)], 1)
    for bucket in np.unique(table[:, 0]).astype(int):
        own = table[:, 0] == bucket
        w = np.full(3, 1 / 3)
        for _ in range(rounds):
            part = p[own] * w
            w = (part / part.sum(1, keepdims=True) * table[own, 3:]).sum(0)
            w /= w.sum()
        w = np.maximum(w, [0, 0, 1e-6])
        weights[bucket] = w / w.sum()
    return weights


def _score(shared, parts: int):
    schema = pa.schema([("id", pa.int64()), ("held_out", pa.bool_()), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("base_score", pa.float64()), ("score", pa.float64())])

    def run(key, left, right):
        tokens, types, weights = shared.value
        ids, held, sizes, word, before, pair = _counted(left, right, parts)
        base = np.log10((word + 0.5) / (tokens + 0.5 * (types + 1)))
        w = weights[_bucket(before)]
        score = np.log10(w[:, 0] * pair / np.maximum(before, 1) + w[:, 1] * word / max(tokens, 1) + w[:, 2] / (types + 1))
        edges = np.cumsum(sizes) - sizes
        known, base, score = np.add.reduceat(word > 0, edges, dtype=np.int64), np.add.reduceat(base, edges), np.add.reduceat(score, edges)
        columns = [pa.array(x, f.type) for x, f in zip((ids, held, sizes, known, base, score), schema)]
        return pa.Table.from_arrays(columns, schema=schema)

    return run, "id long, held_out boolean, n_tokens long, n_known long, base_score double, score double"


def scored(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", folds: int = 5, fold: int = 1) -> DataFrame:
    """One row per document: id, held_out, n_tokens, n_known, train_tokens, base_score, score (log10).

    The model learns from the documents whose crc32 of the id modulo `folds` is not `fold`. Tokens are words and one
    end a text; a null or empty text is an end alone. Without training documents all words are unknown and weights
    stay at their start. Repeated rows count as often as they occur.
    """
    spark = prepare(docs.sparkSession)
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    chunks = _chunked(_held(docs, doc_id, text, folds, fold))
    run, schema = _ask(parts)
    asked = chunks.groupBy("chunk").applyInArrow(run, schema)
    answers = cut(asked.groupBy("part").applyInArrow(_answer, "part int, chunk int, word_n binary, pair_n binary, tokens long, types long"))
    tokens, types = (x or 0 for x in answers.where("chunk = -1").agg(F.sum("tokens"), F.sum("types")).first())

    replies = answers.where("chunk >= 0").select("chunk", "part", "word_n", "pair_n")
    met = lambda: chunks.groupBy("chunk").cogroup(replies.groupBy("chunk"))
    cells = met().applyInArrow(*_cells(tokens, parts)).groupBy("bucket", "q2", "q1").agg(F.sum("n").alias("n")).collect()  # 64 x 128 x 128 at most
    weights = mixture(sorted((r.bucket, r.q2, r.q1, r.n) for r in cells), 1 / (types + 1))
    out = met().applyInArrow(*_score(spark.sparkContext.broadcast((tokens, types, weights)), parts))
    return out.select("id", "held_out", "n_tokens", "n_known", F.lit(tokens).cast("long").alias("train_tokens"), "base_score", "score")
