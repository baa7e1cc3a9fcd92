"""Groups of near copies that each change another word; clashing column values; a pipeline on awkward rows."""

import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

import corpus_pipeline
from juryframe.llm import decontaminate as D, mixing as M, quality as Q, shingle_join as J, tokens as K

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def loose(n, words=70, seed=3):
    """Copies of one text of which each changes one word at a random place."""
    rng = random.Random(seed)
    base = [f"w{i}" for i in range(words)]
    texts = []
    for i in range(n):
        copy = list(base)
        copy[rng.randrange(words)] = f"changed{i}"
        texts.append((i, " ".join(copy)))
    return texts


def plain_components(texts, like):
    sets = {}
    for i, text in texts:
        w = WORD.findall(text.lower())
        sets[i] = {tuple(w[k:k + like.n]) for k in range(max(1, len(w) - like.n + 1))} if w else set()
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for a in ids:
        for b in ids:
            if a < b and find(a) != find(b):
                both = len(sets[a] & sets[b])
                if both and both * like.den >= (len(sets[a]) + len(sets[b]) - both) * like.num:
                    x, y = sorted((find(a), find(b)))
                    root[y] = x
    return {i: find(i) for i in ids}


def test_loose_groups_stay_linear(spark, monkeypatch):
    like, joined = J.Similar(n=5, num=8, den=10), {}
    plain = J._links
    for n in (200, 400):
        seen = []
        monkeypatch.setattr(J, "_links", lambda docs, pairs, *rest: (seen.append(pairs.count()), plain(docs, pairs, *rest))[1])
        texts = loose(n)
        rows, _ = J.similar_documents(spark.createDataFrame(texts, "doc_id long, text string"), like=like)
        assert {r.id: r.component for r in rows.collect()} == plain_components(texts, like)
        joined[n] = sum(seen)
    assert joined[200] <= 4 * 200 and joined[400] <= 2.5 * joined[200]


@pytest.mark.parametrize("seed", range(1))
def test_components_of_mixed_groups(spark, monkeypatch, seed):
    """Small tiles and few rounds: what the forests leave is searched whole."""
    monkeypatch.setattr(J, "TILE", 16)
    monkeypatch.setattr(J, "ROUNDS", 2)
    rng, like, texts = random.Random(seed), J.Similar(n=3, num=9, den=10), []
    for g in range(4):
        base = [f"g{g % 2}w{i}" for i in range(60)]
        for k in range(40):
            copy = list(base)
            for _ in range(rng.randrange(1, 4)):
                copy[rng.randrange(60)] = f"x{rng.randrange(30)}"
            texts.append((len(texts), " ".join(copy)))
    rows, links = J.similar_documents(spark.createDataFrame(texts, "doc_id long, text string"), like=like)
    assert {r.id: r.component for r in rows.collect()} == plain_components(texts, like)


CLASH = ["_id", "_key", "_n", "_c", "_i", "_q", "_copies", "kept", "char_distance", "row", "id", "key", "copies", "place", "gone", "bad_id", "held_key", "times", "s"]


def clashing(spark):
    texts = [(1, "one two three four " * 20, "en", "web"), (2, None, None, None), (None, "no id here", "de", "web"), (3, "", "en", "books"), (1, "one two three four " * 20, "en", "web"),
             (4, " ".join(f"word{i}" for i in range(80)) + ".", "en", "web")]
    rows = [(*t, *[f"{c}{i}" for c in CLASH]) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, " + ", ".join(f"`{c}` string" for c in CLASH))


def test_clashing_columns_keep_their_values(spark):
    docs = clashing(spark)
    given = {tuple(r) for r in docs.collect()}
    items = spark.createDataFrame([("b", "no id here"), (None, None)], "item_id string, text string")
    for out in (Q.keep(docs, bounds=Q.Bounds(min_words=0)), D.decontaminate(docs, items), M.mixed_documents(docs, repeats=2), J.one_of_each(docs)):
        assert out.columns == docs.columns
        rows = [tuple(r) for r in out.collect()]
        assert rows and set(rows) <= given
    assert {r["_id"] for r in D.decontaminate(docs, items).collect()} == {f"_id{i}" for i in (0, 1, 3, 4, 5)}
    assert all(f(docs.limit(0)).collect() == [] for f in (Q.keep, lambda d: D.decontaminate(d, items), M.mixed_documents, J.one_of_each))


def test_the_mixing_stage_follows_the_schedule(spark, monkeypatch):
    docs = spark.createDataFrame([(i, "w " * (i % 50 + 1), ("a", "b", None)[i % 3]) for i in range(300)], "doc_id long, text string, source string")
    size = {r.doc_id: len(r.text.split()) for r in docs.collect()}
    out = Counter(r.source for r in M.mixed_documents(docs, block_words=64).select("source", "doc_id").collect())
    words = Counter()
    for r in M.mixed_documents(docs, block_words=64).collect():
        words[r.source] += size[r.doc_id]
    goal = {r.source: r.target for r in M.targets(M.sizes(docs)).collect()}
    assert set(out) == set(goal) and all(goal[s] <= words[s] + 1 <= goal[s] + 51 for s in goal)
    whole = M.schedule
    monkeypatch.setattr(M, "schedule", lambda goal, block_words: whole(goal, block_words).where("block % 2 = 0"))
    assert sum(Counter(r.source for r in M.mixed_documents(docs, block_words=64).collect()).values()) < sum(out.values())


@pytest.mark.parametrize("name,stage", corpus_pipeline.STAGES)
def test_stages_on_awkward_rows(spark, tmp_path, name, stage):
    spark.createDataFrame([("b", "no id here"), (None, None)], "item_id string, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = clashing(spark)
    for table in (docs, docs.limit(0)):
        out = stage(spark, table, str(tmp_path))
        assert len(out.collect()) <= 2 * docs.count() and (out.columns == docs.columns or name.startswith("token"))


def test_ids_beyond_the_planes_are_refused():
    import numpy as np

    with pytest.raises(ValueError):
        K.pack([1], [2], np.array([70000, 1], np.uint32), 16)
    ids, sizes, matrix = K.unpack(K.pack([1], [3], np.array([70000, 1, 70000], np.uint32), 17))
    assert matrix.values().tolist() == [70000, 1, 70000] and matrix.count(70000) == 2 and matrix.find(70000, 1) == 2


def test_added_tokens_stay_whole(spark):
    import binascii
    import struct

    from juryframe.llm import queries
    from tokenizers import Tokenizer

    coder = Tokenizer.from_file(queries.word_vocabulary())
    texts = [(i, t) for i, t in enumerate(["<|endoftext|> a", "x<|startoftext|>y", "<|ENDOFTEXT|>", "plain a", "<|endof text|>", "<|endoftext|>"])]
    got = queries.token_rows(spark, spark.createDataFrame(texts, "doc_id long, text string")).collect()
    for r in got:
        ids = coder.encode(texts[r.doc_id][1], add_special_tokens=False).ids + [2]
        assert (r.n_tokens, r.ids_crc32) == (len(ids), binascii.crc32(struct.pack(f"<{len(ids)}I", *ids)))


def test_group_counts_keep_their_values_in_few_bytes():
    rng = np.random.default_rng(3)
    rows = [rng.integers(0, most, J.BINS) for most in (2, 16, 17, 256, 257, 70_000, 16)]
    blobs = [J._packed(r) for r in rows]
    assert len(blobs[0]) == len(blobs[1]) == J.BINS // 2 and max(map(len, blobs)) == 2 * J.BINS
    assert np.array_equal(J._opened(pa.array(blobs)), np.minimum(rows, 65535))


def test_the_mixing_plan_holds_its_windows_once(spark, capsys):
    docs = spark.createDataFrame([(i, f"word{i} " * (i % 7), "ab"[i % 2]) for i in range(50)], "doc_id long, text string, source string")
    M.mixed_documents(docs).explain()
    assert capsys.readouterr().out.count("- Window [") <= 2
