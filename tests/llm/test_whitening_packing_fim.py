"""Whitening, packing and fill-in-middle: numpy, plain best fit, exact round trips, on given rows and awkward ones."""

import bisect
import binascii
import random
import struct
from collections import Counter, defaultdict

import numpy as np
import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from juryframe.llm import fim as I, packing as B, queries, whitening as E


def tokenizer():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(queries.word_vocabulary())


# ---- whitening

def plain_whitening(vectors, k=8):
    """(deviations, whitened up to sign, explained) of equal-sized vectors by numpy."""
    x = np.floor(1024 * np.array(vectors, float)).astype(np.int64) + 100000
    n, total = len(x), x.sum(0)
    centred = x - total / n
    v = centred.T @ centred / n
    e, u = np.linalg.eigh(v)
    e, u = e[::-1][:k], u[:, ::-1][:, :k]
    deviation = [sum(int(a) ** 2 for a in r) for r in (n * x.astype(object) - total.astype(object))]
    return deviation, centred @ u / np.sqrt(e), e / np.trace(v)


def test_whitening_equals_numpy(spark, folder):
    rows = queries.QUERIES["op11_whitening"](spark, folder).collect()
    given_rows = sorted((r.vec_id, r.embedding) for r in spark.read.parquet(folder + "/embeddings.parquet").collect())
    deviation, white, explained = plain_whitening([v for _, v in given_rows])
    place = {i: k for k, (i, _) in enumerate(given_rows)}
    assert len(rows) == 8 * len(given_rows)
    sign = {}
    for r in rows:
        want = white[place[r.vec_id], r.component - 1]
        s = sign.setdefault(r.component, np.sign(want * r.whitened))
        assert r.whitened == pytest.approx(s * want, abs=1e-8)
        assert r.deviation == deviation[place[r.vec_id]] and r.n == len(given_rows)
        assert r.explained == pytest.approx(explained[r.component - 1], rel=1e-9) and r.identity_error < 1e-9


def test_whitening_of_awkward_vectors(spark):
    rng = np.random.default_rng(7)
    good = [(i, rng.normal(size=5).tolist()) for i in range(40)] + [(3, [1.0] * 5), (3, [1.0] * 5), (None, [0.5, -0.25, 0.125, 0.0, 2.0])]
    bad = [(100, None), (101, []), (102, [1.0, None, 0.0, 0.0, 0.0]), (103, [float("nan")] + [0.0] * 4), (104, [float("inf")] + [0.0] * 4), (105, [-float("inf")] * 5),
           (106, [1.0, 2.0]), (107, [1e300] * 5)]
    table = spark.createDataFrame([(*r, "x", "x", 1) for r in good + bad], "vec_id long, embedding array<double>, id string, white string, block int").repartition(7)
    out = E.whiten(table, block_bytes=3 * 40).collect()  # three rows a block
    assert Counter(r.id for r in out) == Counter({k: 5 * v for k, v in Counter(i for i, _ in good).items()})
    deviation, white, explained = plain_whitening([v for _, v in good], 5)
    got = sorted((int(r.deviation), r.component, round(abs(r.whitened), 7), round(r.explained, 9)) for r in out)
    assert got == sorted((d, c + 1, round(abs(w[c]), 7), round(explained[c], 9)) for d, w in zip(deviation, white) for c in range(5))
    assert E.whiten(table.limit(0)).collect() == [] and E.whiten(table.where("vec_id > 99 and vec_id < 106")).collect() == []


def test_whitening_without_spread(spark):
    alike = spark.createDataFrame([(i, [0.5, 0.5, 1.0]) for i in range(4)], "vec_id long, embedding array<float>")
    rows = E.whiten(alike).collect()
    assert len(rows) == 12 and all(r.whitened is None and r.explained is None and r.identity_error is None and r.deviation == 0 for r in rows)
    line = spark.createDataFrame([(i, [float(i), 2.0 * i, 7.0]) for i in range(9)], "vec_id long, embedding array<float>")
    rows = E.whiten(line).collect()
    assert all((r.whitened is None) == (r.component > 1) for r in rows) and rows[0].identity_error < 1e-9
    assert sorted(abs(round(r.whitened, 6)) for r in rows if r.component == 1)[-1] == pytest.approx(4 / np.sqrt(60 / 9), abs=1e-6)


def test_large_sums_stay_exact(spark):
    table = spark.createDataFrame([(i, [1e6 + i, -3e6 + i * i]) for i in range(30)], "vec_id long, embedding array<double>")
    deviation, _, _ = plain_whitening([[1e6 + i, -3e6 + i * i] for i in range(30)], 2)
    assert {r.id: int(r.deviation) for r in E.whiten(table).collect()} == dict(enumerate(deviation))


# ---- packing

def plain_best_fit(lengths, capacity):
    """Sequences that best fit, longest first, opens when it handles one piece at a time."""
    rooms = []
    for length in sorted(lengths, reverse=True):
        at = bisect.bisect_left(rooms, length)
        room = rooms.pop(at) if at < len(rooms) else capacity
        bisect.insort(rooms, room - length)
    return len(rooms)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(1, 50), max_size=120), st.integers(50, 70))
def test_plan_over_counts_equals_plain_best_fit(lengths, capacity):
    plan = B.best_fit(dict(Counter(lengths)), capacity)
    assert plan.sequences == plain_best_fit(lengths, capacity)
    held = defaultdict(list)
    for length, n in Counter(lengths).items():
        for rank in range(n):
            at = int(np.searchsorted(plan.key, length << B.RANK_BITS | rank, "right")) - 1
            beyond = rank - int(plan.first[at])
            assert plan.length[at] == length and beyond >= 0
            held[int(plan.sequence[at]) + beyond // int(plan.per[at])].append((int(plan.offset[at]) + beyond % int(plan.per[at]) * length, length))
    for parts in held.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= capacity
    assert sorted(held) == list(range(plan.sequences))


def check_packing(rows, texts, capacity=4096, end=1):
    coder, want = tokenizer(), Counter()
    lengths = []
    for i, text in texts:
        ids = coder.encode(text or "", add_special_tokens=False).ids + [end]
        for piece, start in enumerate(range(0, len(ids), capacity)):
            part = ids[start:start + capacity]
            lengths.append(len(part))
            want[i, piece, start, len(part), binascii.crc32(struct.pack(f"<{len(part)}I", *part))] += 1
    assert Counter((r[0], r.piece, r.start, r.length, r[4]) for r in rows) == want
    held = defaultdict(list)
    for r in rows:
        held[r[5]].append((r.offset, r.length))
    for parts in held.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= capacity
    assert len(held) == plain_best_fit(lengths, capacity)


def test_packing_of_documents(spark, folder):
    texts = [(r.doc_id, r.text) for r in spark.read.parquet(folder + "/documents.parquet").collect()]
    check_packing(queries.QUERIES["op12_packing"](spark, folder).collect(), texts)


def test_packing_of_awkward_documents(spark):
    long = " ".join(f"w{i % 97} x{i}" for i in range(9000))
    texts = [(1, None), (2, ""), (None, "a b"), (None, None), (3, long), (3, long), (4, "same text"), (4, "same text"), (5, "<|endoftext|> end <|STARTOFTEXT|>"), (6, "é" * 5000)]
    table = spark.createDataFrame([(*t, "x", 1, 2) for t in texts], "doc_id long, text string, id string, part int, local int").repartition(3)
    for capacity in (4096, 64):
        placed = B.pack(table, queries.word_vocabulary(), capacity=capacity, keep_ids=True)
        rows = placed.collect()
        check_packing(rows, texts, capacity)
        for s in B.sequences(placed).collect():
            assert len(s.ids) <= capacity and sum(p.length for p in s.pieces) == len(s.ids)
    assert B.pack(table.limit(0), queries.word_vocabulary()).collect() == []


def test_sequences_hold_the_ids_of_their_pieces(spark):
    texts = [(i, " ".join(f"t{j}" for j in range(i * 7 % 40))) for i in range(60)]
    table = spark.createDataFrame(texts, "doc_id long, text string")
    coder = tokenizer()
    encoded = {i: coder.encode(t, add_special_tokens=False).ids + [1] for i, t in texts}
    seen = []
    for s in B.sequences(B.pack(table, queries.word_vocabulary(), capacity=128, keep_ids=True)).collect():
        assert s.ids == [x for p in s.pieces for x in encoded[p.id][p.piece * 128:p.piece * 128 + p.length]]
        seen += [(p.id, p.piece) for p in s.pieces]
    assert sorted(seen) == sorted((i, k) for i, ids in encoded.items() for k in range(-(-len(ids) // 128)))


# ---- fill in middle

ODD = ["", "a", "é", "漢字 かな", "𝒳y𝒵 é\n\tx", "has <P> mark", "<S>", "x<M", "<<<>>>P", " lead and trail ", "\n\n", "<P", "word " * 500, "á combining", "S><S P><P M><M"]


def test_classes_and_ranks():
    rng = random.Random(5)
    texts = [t.encode() for t in ODD] * 3
    data, bounds = np.frombuffer(b"".join(texts), np.uint8), np.cumsum([0, *map(len, texts)])
    codes = I.classes(data, bounds)
    matrix = I.ClassMatrix(codes)
    at = np.array([0, len(codes), *(rng.randrange(len(codes) + 1) for _ in range(300))])
    for code in range(4):
        assert matrix.rank(code, at).tolist() == [int((codes[:i] == code).sum()) for i in at]
    n = I.boundaries(matrix, "char", bounds[1:]) - I.boundaries(matrix, "char", bounds[:-1])
    assert n.tolist() == [len(t.decode()) for t in texts]
    for share in (0.0, 0.3, 1.0):
        units = (n * share).astype(np.int64)
        ends = I.locate(matrix, "char", bounds[:-1], bounds[1:], units)
        assert [data[a:b].tobytes().decode() for a, b in zip(bounds, ends)] == [t.decode()[:u] for t, u in zip(texts, units)]


@pytest.mark.parametrize("rule", [I.Rule(), I.Rule(plain_percent=0, spm_percent=50, unit="word"), I.Rule("[pre]", "[suf]", "[mid]", 0, 50, 9)])
def test_fill_in_middle_restores_awkward_texts(spark, rule):
    texts = [(i, t) for i, t in enumerate(ODD * 6)] + [(None, None), (7, None), (7, "twice"), (7, "twice"), (None, "no id")]
    table = spark.createDataFrame([(*t, "x", "x", 3) for t in texts], "doc_id long, text string, form string, output string, n int").repartition(3)
    out = I.transform(table, rule)
    rows = out.select("*", I.restore(F.col("output"), F.col("form"), rule).alias("again")).collect()
    assert Counter((r.id, r.again) for r in rows) == Counter((i, t or "") for i, t in texts)
    marks = (rule.prefix, rule.suffix, rule.middle)
    for r in rows:
        plain = not r.again or any(m in r.again for m in marks)
        assert r.form == "plain" if plain else True
        assert (r.prefix is None) == (r.form == "plain") and r.n == (len(r.again) if rule.unit == "char" else len(r.again.split()))
        if r.form == "plain":
            assert r.output == r.again
        elif rule.unit == "char":
            a, b = r.prefix, r.prefix + r.middle
            p, m, s = r.again[:a], r.again[a:b], r.again[b:]
            assert r.output == (rule.prefix + p + rule.suffix + s + rule.middle + m if r.form == "psm" else rule.suffix + s + rule.prefix + p + rule.middle + m)
    if not rule.plain_percent:
        assert {r.form for r in rows} == {"plain", "psm", "spm"}
    assert I.transform(table.limit(0), rule).collect() == []


def test_a_mark_with_a_repeated_sign_is_refused():
    for bad in (dict(prefix="<<P"), dict(prefix="<S>"), dict(middle=""), dict(unit="line")):
        with pytest.raises(ValueError):
            I.Rule(**bad)
