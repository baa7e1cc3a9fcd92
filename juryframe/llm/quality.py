"""Quality rules: distribution divergence from language references, with plain guards.

Each document gives two histograms: its characters by class, and its words by the common words of its language (one bin
more holds all other words). The references of a language are the summed histograms of all its documents. A document is
rejected when the Jensen-Shannon distance (square root of the divergence in bits, 0 to 1) of either histogram from its
reference is above a bound; below a minimum length that says nothing, so short documents pass these two rules. The
plain guards reject very short and repetitive texts.

Everything is DataFrame functions; nothing is shuffled but the reference sums, one row for each known language.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from juryframe.llm.common import cut, let, word_array, wrapped

# Common words of each language, commonest first.
COMMON = {
    "en": "the of and to in is that with for on as by".split(),
    "de": "der die und in zu den das nicht von sie ist des".split(),
    "fr": "de la le et les des en un une que est pour".split(),
    "es": "de la que el en y a los se del las un".split(),
}
BINS = max(map(len, COMMON.values()))
# Signs of the character classes; letters as a Java regular expression.
SYMBOLS, STOPS, LETTERS = "#*$%&|<>", ".,", r"[\p{Ll}\p{Lo}\p{Lm}]+"
CHAR_BINS = 5
OTHER = "other"


@dataclass(frozen=True)
class Bounds:
    """Limits of the rules."""

    min_words: int = 50
    max_repeat_percent: int = 50
    guard_chars_words: int = 50
    guard_common_words: int = 100
    max_char_distance: float = 0.3
    max_word_distance: float = 0.25


def _language(lang: Column) -> Column:
    return F.when(lang.isin(list(COMMON)), lang).otherwise(OTHER)


def repeated_words(w: Column) -> Column:
    """Words of an array inside three-word windows that occur twice or more, the first occurrence included.

    Windows are compared by 64-bit hash. Sorted hashes show the repeated ones side by side; where these are few, each
    window looks itself up among them, else (hash, place) pairs are sorted.
    """
    def places(h: Column, twice: Column) -> Column:
        few = F.filter(F.transform(h, lambda x, i: F.when(F.array_contains(twice, x), i).otherwise(-1)), lambda i: i >= 0)
        many = let(F.array_sort(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i")))), lambda s: F.flatten(F.transform(
            F.filter(F.transform(F.slice(s, 1, F.size(s) - 1), lambda x, i: F.struct(x.alias("a"), F.get(s, i + 1).alias("b"))), lambda p: p["a"]["h"] == p["b"]["h"]),
            lambda p: F.array(p["a"]["i"], p["b"]["i"]))))
        return F.when(F.size(twice) <= 32, few).otherwise(many)

    def covered(h: Column) -> Column:
        twice = let(F.sort_array(h), lambda s: F.array_distinct(F.filter(F.slice(s, 1, F.size(s) - 1), lambda x, i: x == F.get(s, i + 1))))
        found = let(twice, lambda t: places(h, t))
        return F.size(F.array_distinct(F.flatten(F.transform(found, lambda i: F.array(i, i + 1, i + 2)))))

    n = F.greatest(F.size(w) - 2, F.lit(0))
    hashes = F.transform(F.slice(w, 1, n), lambda x, i: F.xxhash64(x, F.get(w, i + 1), F.get(w, i + 2)))
    return let(hashes, lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0)).otherwise(covered(h))).cast("long")


def _less(body: Column, signs: str) -> Column:
    for sign in signs:
        body = F.replace(body, F.lit(sign), F.lit(""))
    return F.length(body)


def _common(w: Column, known: Column) -> Column:
    """Counts of the known words, in their order, and of all others; null without known words."""
    def counts(f: Column) -> Column:
        by_word = F.transform(F.sequence(F.lit(1), F.lit(BINS)), lambda k: F.size(F.filter(f, lambda p: p == k)).cast("long"))
        return F.concat(by_word, F.array((F.size(w) - F.size(f)).cast("long")))

    found = F.transform(F.filter(w, lambda x: F.array_contains(known, x)), lambda x: F.array_position(known, x))
    return F.when(known.isNotNull(), let(found, counts))


def measures(docs: DataFrame, *, text: str = "text", lang: str = "lang") -> DataFrame:
    """`docs` with `_q`: n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, language, char and word histograms.

    Characters fall into lower-case letters, symbols, full stops and commas, white space, and all others. A null text
    is empty and measures 0 throughout. An unknown or null language shares the bin "other", which has no word
    histogram. Each row is measured alone, so repeated rows get equal results.
    """
    body, language = F.coalesce(F.col(text), F.lit("")), _language(F.col(lang))
    known = F.lit(None).cast("array<string>")
    for name, common in COMMON.items():
        known = F.when(language == name, F.array(*map(F.lit, common))).otherwise(known)

    def all_of(t: Column) -> Column:
        total = F.length(t)
        lines = F.filter(F.split(t, "\n"), lambda line: line.rlike(r"[^\x20\x09-\x0D]"))
        return let(word_array(t), lambda w: let(known, lambda k: F.struct(
            F.size(w).alias("n_words"), F.length(F.array_join(w, "")).alias("word_chars"), (total - _less(t, SYMBOLS)).alias("n_symbols"),
            let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).alias("n_dup_lines"),
            repeated_words(w).alias("n_repeat_words"), total.alias("total"),
            (total - F.length(F.regexp_replace(t, LETTERS, ""))).alias("letters"), (total - _less(t, STOPS)).alias("stops"), _common(w, k).alias("common"))))

    whole = let(body, all_of)
    return docs.withColumn("_q", let(whole, lambda q: F.struct(
        *[q[c].cast("long").alias(c) for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")], language.alias("language"),
        F.transform(F.array(q["letters"], q["n_symbols"], q["stops"], q["total"] - q["word_chars"], q["word_chars"] - q["letters"] - q["n_symbols"] - q["stops"]), lambda x: x.cast("long")).alias("chars"),
        q["common"].alias("common"))))


def references(measured: DataFrame) -> dict[str, dict[str, list[int]]]:
    """Summed histograms over all documents of each known language and of the rest: at most len(COMMON) + 1 rows."""
    n_chars, n_common = CHAR_BINS, BINS + 1
    rows = measured.groupBy(F.col("_q.language").alias("language")).agg(
        *[F.sum(F.get(F.col("_q.chars"), F.lit(i))).alias(f"c{i}") for i in range(n_chars)],
        *[F.sum(F.get(F.col("_q.common"), F.lit(i))).alias(f"w{i}") for i in range(n_common)]).collect()
    return {r.language: {"chars": [r[f"c{i}"] or 0 for i in range(n_chars)], "common": [r[f"w{i}"] or 0 for i in range(n_common)]} for r in rows}


def distance(counts: Column, reference: list[int]) -> Column:
    """Jensen-Shannon distance of a histogram from a fixed one; null when either is empty."""
    whole = float(sum(reference))
    if not whole:
        return F.lit(None).cast("double")
    p = [v / whole for v in reference]

    def divergence(c: Column) -> Column:
        total = F.aggregate(c, F.lit(0).cast("long"), lambda a, x: a + x).cast("double")
        part = F.lit(0.0)
        for i, share in enumerate(p):
            q = F.get(c, F.lit(i)) / total
            middle = (q + share) / 2
            part = part + F.when(q > 0, q * F.log2(q / middle)).otherwise(0.0)
            if share:
                part = part + share * F.log2(F.lit(share) / middle)
        return F.when(total > 0, F.sqrt(F.greatest(part / 2, F.lit(0.0))))

    return let(counts, divergence)


def verdict(measured: DataFrame, reference: dict[str, dict[str, list[int]]], bounds: Bounds = Bounds()) -> DataFrame:
    """`measured` with base_failed, char_distance, word_distance and kept."""
    q = F.col("_q")
    far = {"chars": F.lit(None).cast("double"), "common": F.lit(None).cast("double")}
    for language, known in reference.items():
        for name in far:
            far[name] = F.when(q["language"] == language, distance(q[name], known[name])).otherwise(far[name])
    failed = (q["n_words"] < bounds.min_words) | (q["n_repeat_words"] * 100 > q["n_words"] * bounds.max_repeat_percent)
    out = measured.withColumns({"base_failed": failed, "char_distance": far["chars"], "word_distance": far["common"]})
    strange = ((q["n_words"] >= bounds.guard_chars_words) & (F.coalesce("char_distance", F.lit(0.0)) > bounds.max_char_distance)) | (
        (q["n_words"] >= bounds.guard_common_words) & (F.coalesce("word_distance", F.lit(0.0)) > bounds.max_word_distance))
    return out.withColumn("kept", ~F.col("base_failed") & ~strange)


def keep(docs: DataFrame, *, text: str = "text", lang: str = "lang", bounds: Bounds = Bounds()) -> DataFrame:
    """Documents that pass the rules, all columns kept, whatever their names.

    One pass measures each text and writes rows and measures to the shared folder; references and verdicts read these.
    Null and empty texts have no words and fail the base rule; repeated rows are judged alike; an empty table stays empty.
    """
    measured = cut(measures(wrapped(docs, text=F.col(text), lang=F.col(lang))).select("row", "_q"))
    return verdict(measured, references(measured), bounds).where("kept").select("row.*")
