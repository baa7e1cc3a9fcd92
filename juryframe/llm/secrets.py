"""Secret scans by a trigram inverted index.

From each rule's regular expression follows a Boolean query: an OR of trigram sets, one of which every match must hold
in full. The index lists, for each trigram of any rule, the documents whose lower-cased text has it. Intersecting the
postings gives each rule's candidates, and only these are searched with the expression. A rule with no mandatory
trigram searches every text.

All of it is DataFrame functions. The expressions are parsed once on the driver, a few hundred bytes.
"""

from __future__ import annotations

import re._constants as C
import re._parser as parser
from collections.abc import Iterable
from dataclasses import dataclass
from itertools import product

from pyspark.sql import Column, DataFrame, functions as F

from juryframe.llm.common import cut, let, row_key


@dataclass(frozen=True)
class Rule:
    """A kind of secret: its expression, and the least length of one group. `base` rules are the fixed ones."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 0
    base: bool = False


# Fixed patterns. Expressions hold for Java, RE2 and Python alike.
RULES = (
    Rule("assign", r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 12, True),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 18, True),
    Rule("hex", r"[0-9a-f]{16,}", 0, 16, True),
    Rule("github", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
    Rule("private_key", r"-----BEGIN [A-Z ]*PRIVATE KEY-----"),
)
MOST_STRINGS = 64

Query = frozenset[frozenset[str]]
ANY: Query = frozenset([frozenset()])


def _least(sets: Iterable[frozenset[str]]) -> Query:
    """The sets that hold no other of them: the rest follow from these."""
    sets = set(sets)
    return frozenset(s for s in sets if not any(o < s for o in sets))


def _both(a: Query, b: Query) -> Query:
    out = _least(x | y for x, y in product(a, b))
    return out if len(out) <= MOST_STRINGS else a


def _trigrams(strings: set[str]) -> Query:
    return _least(frozenset(s[i:i + 3] for i in range(len(s) - 2)) for s in strings)


def _strings(part: tuple) -> set[str] | None:
    """All strings a part can match, in lower case, if they are few; else None."""
    op, value = part
    if op is C.LITERAL:
        return {chr(value).lower()}
    if op is C.IN:
        found: set[str] = set()
        for kind, item in value:
            if kind is not C.LITERAL:
                return None
            found.add(chr(item).lower())
        return found
    if op is C.SUBPATTERN:
        return _joined(value[-1])
    if op is C.BRANCH:
        ways = [_joined(way) for way in value[1]]
        return None if None in ways else set().union(*ways)
    if op is C.MAX_REPEAT and value[1] <= 8:
        inner = _joined(value[2])
        if inner is None:
            return None
        out: set[str] = set()
        for n in range(value[0], value[1] + 1):
            out |= {"".join(x) for x in product(inner, repeat=n)}
            if len(out) > MOST_STRINGS:
                return None
        return out
    return None


def _joined(parts: Iterable[tuple]) -> set[str] | None:
    out = {""}
    for part in parts:
        more = _strings(part)
        if more is None or len(out) * len(more) > MOST_STRINGS:
            return None
        out = {a + b for a, b in product(out, more)}
    return out


def _within(part: tuple) -> Query:
    """What a part that is no short list of strings demands."""
    op, value = part
    if op is C.SUBPATTERN:
        return _of(value[-1])
    if op is C.BRANCH:
        return _least(s for way in value[1] for s in _of(way))
    if op is C.MAX_REPEAT and value[0] > 0:
        return _of(value[2])
    return ANY


def _of(parts: Iterable[tuple]) -> Query:
    query, run = ANY, {""}
    for part in parts:
        more = _strings(part)
        if more is not None and len(run) * len(more) <= MOST_STRINGS:
            run = {a + b for a, b in product(run, more)}
            continue
        query = _both(_both(query, _trigrams(run)), _within(part))
        run = {""}
    return _both(query, _trigrams(run))


def trigram_query(pattern: str) -> Query:
    """Trigram sets of which a text that matches holds at least one in full; ANY if nothing is mandatory."""
    return _of(parser.parse(pattern))


def index(docs: DataFrame, trigrams: list[str], *, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Postings: trigram, id, key, for each of the trigrams and each document whose lower-cased text has it."""
    found = let(F.lower(F.col(text)), lambda t: F.filter(F.array(*map(F.lit, trigrams)), lambda g: F.contains(t, g)))
    return docs.where(F.col(text).isNotNull()).select(F.col(doc_id).alias("id"), row_key(F.col(text)).alias("key"), F.explode(found).alias("trigram"))


def candidates(postings: DataFrame, queries: dict[str, Query]) -> DataFrame:
    """id, key, rules: the rules whose query the document's postings meet. Documents that meet none are absent."""
    def meets(have: Column, query: Query) -> Column:
        ways = [F.size(F.array_except(F.array(*map(F.lit, sorted(way))), have)) == 0 for way in sorted(query, key=sorted)]
        out = ways[0]
        for way in ways[1:]:
            out = out | way
        return out

    have = postings.groupBy("id", "key").agg(F.collect_set("trigram").alias("have"))
    rules = F.array_compact(F.array(*[F.when(meets(F.col("have"), q), F.lit(kind)) for kind, q in queries.items()]))
    return have.select("id", "key", rules.alias("rules")).where(F.size("rules") > 0)


def _spans(text: Column, rule: Rule, order: int) -> Column:
    """Matches of a rule that are long enough, leftmost and apart: start, order, kind, stop in code points."""
    none = F.array().cast("array<struct<start:int,order:int,kind:string,stop:int>>")
    whole, part = F.regexp_extract_all(text, F.lit(rule.pattern), 0), F.regexp_extract_all(text, F.lit(rule.pattern), rule.group)
    between = F.transform(F.split(text, rule.pattern, -1), F.length)
    matched = F.arrays_zip(F.transform(whole, F.length).alias("m"), F.transform(part, F.length).alias("g"), F.slice(between, 1, F.size(whole)).alias("b"))
    add = lambda xs, f: F.aggregate(xs, F.lit(0), lambda a, x: a + f(x))
    placed = let(matched, lambda z: F.transform(z, lambda x, i: let(
        add(F.slice(z, 1, i), lambda y: y["m"] + y["b"]) + x["b"], lambda at: F.struct(
            at.alias("start"), F.lit(order).alias("order"), F.lit(rule.kind).alias("kind"), (at + x["m"]).alias("stop"), x["g"].alias("size")))))
    kept = F.transform(F.filter(placed, lambda s: s["size"] >= rule.least), lambda s: F.struct(s["start"], s["order"], s["kind"], s["stop"]))
    return F.when(text.rlike(rule.pattern), kept).otherwise(none)


def scan(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """One row per document: id, spans (start, order, kind, stop), by start and then in the order of the rules.

    Null and empty texts have no spans. Null ids and repeated rows are scanned like others.
    """
    queries = {r.kind: trigram_query(r.pattern) for r in rules}
    indexed = {kind: q for kind, q in queries.items() if q != ANY and frozenset() not in q}
    trigrams = sorted({g for q in indexed.values() for way in q for g in way})
    body = docs.select(F.col(doc_id).alias("id"), row_key(F.col(text)).alias("key"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    if trigrams:
        found = cut(candidates(index(docs, trigrams, doc_id=doc_id, text=text), indexed))
        found = found.select(F.col("id").alias("_id"), F.col("key").alias("_key"), "rules")
        body = body.join(found, F.col("id").eqNullSafe(F.col("_id")) & (F.col("key") == F.col("_key")), "left")
    else:
        body = body.withColumn("rules", F.lit(None).cast("array<string>"))
    none = F.array().cast("array<struct<start:int,order:int,kind:string,stop:int>>")
    per = [_spans(F.col("text"), r, i) if r.kind not in indexed else F.when(F.array_contains("rules", r.kind), _spans(F.col("text"), r, i)).otherwise(none) for i, r in enumerate(rules)]
    return body.select("id", F.array_sort(F.concat(*per)).alias("spans"))


def listed(spans: Column) -> Column:
    """kind:start:stop of each span, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["stop"].cast("string"))), ",")
