"""SQL fragments shared by the oracles. They are written for RE2 and share no code with the operators."""

from __future__ import annotations

B = r"\x09-\x0d\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
BREAK = r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x{85}\x{2028}\x{2029}]"
W = r"\p{L}\p{N}_"
M = "\ue000"  # marks word borders, so a pattern may use its neighbours twice


def strip(x: str) -> str:
    return f"regexp_replace({x}, '^[{B}]+|[{B}]+$', '', 'g')"


def nonblank(x: str) -> str:
    return f"coalesce(regexp_matches({x}, '[^{B}]'), false)"


def lines(x: str) -> str:
    s = f"string_split_regex({x}, '{BREAK}')"
    return f"(CASE WHEN ({s})[-1] = '' THEN ({s})[1:len({s}) - 1] ELSE {s} END)"


def doc_lines(extra: str = "", source: str = "documents") -> str:
    """Sub-query doc_id, line, text [, extra]."""
    more = f", {extra}" if extra else ""
    return (f"(SELECT doc_id{more}, i AS line, l[i] AS text FROM (SELECT doc_id{more}, l, unnest(generate_series(1, len(l))) AS i "
            f"FROM (SELECT doc_id{more}, {lines('text')} AS l FROM {source})))")


def signature(x: str) -> str:
    edge = lambda p: f"(^|[^{W}])({p})($|[^{W}])"
    h = "[0-9a-fA-F]"
    steps = (
        (f"{h}{{8}}-{M}{h}{{4}}-{M}{h}{{4}}-{M}{h}{{4}}-{M}{h}{{12}}", "<uuid>"),
        (rf"\p{{Nd}}{{4}}-{M}\p{{Nd}}{{2}}-{M}\p{{Nd}}{{2}}(?:(?:[Tt]| {M})\p{{Nd}}{{2}}:{M}\p{{Nd}}{{2}}:{M}\p{{Nd}}{{2}}"
         rf"(?:\.{M}\p{{Nd}}+)?(?:[Zz]|[+-]{M}\p{{Nd}}{{2}}(?::{M})?\p{{Nd}}{{2}})?)?", "<ts>"),
        (r"(?:0[xX])?[\p{Nd}a-fA-F]{8,}", "<hex>"),
        (rf"(?:[-+]{M})?\p{{Nd}}+(?:\.{M}\p{{Nd}}+)?(?:[eE](?:[-+]{M})?\p{{Nd}}+)?", "<n>"),
    )
    out = f"regexp_replace({strip(x)}, '([^{W}])', '\\1{M}', 'g')"
    for pattern, mark in steps:
        out = f"regexp_replace({out}, '{edge(pattern)}', '\\1{mark}\\3', 'g')"
    return f"replace({out}, '{M}', '')"


def json_string(x: str) -> str:
    out = f"replace(replace({x}, '\\', '\\\\'), '\"', '\\\"')"
    for code, mark in ((8, "b"), (9, "t"), (10, "n"), (12, "f"), (13, "r")):
        out = f"replace({out}, chr({code}), '\\{mark}')"
    for code in range(1, 32):
        if code not in (8, 9, 10, 12, 13):
            out = f"replace({out}, chr({code}), '\\u{code:04x}')"
    return f"('\"' || {out} || '\"')"


def capped(x: str, cap: int) -> str:
    """Search the marker length by trying every digit count."""
    cases = " ".join(
        f"WHEN length({x}) - ({cap} - {20 + d}) BETWEEN {10 ** (d - 1)} AND {10 ** d - 1} THEN left({x}, {cap - 20 - d}) || "
        f"chr(10) || '…[truncated ' || (length({x}) - ({cap} - {20 + d})) || ' chars]'" for d in range(1, 9))
    return f"(CASE WHEN length({x}) <= {cap} THEN {x} {cases} END)"


#: Which of the five events on a document the two attempts of each judge take.
JUDGES = {"a": (0, 1), "b": (2, 3), "c": (3, 4), "p": (4, 0)}


def judged(states: str, judge: str = "a", faults: bool = True, head: str = "pos", own: str | None = None) -> str:
    """Rows of the results that the event table holds for a sub-query (id, pos, state_sha256), for the standard rubric.

    `head` is the document whose event tells how the delivery went, `own` (the same, if not given) the one whose event answers.
    """

    def attempt(n: int) -> str:
        at = JUDGES[judge][n - 1]
        return (f"SELECT st.id, st.pos, st.state_sha256, {n} AS attempt, d.k IS NULL AS gone, d.k, d.user_id, d.event_type, o.value, o.k AS ok, o.user_id AS ou "
                f"FROM st LEFT JOIN ev d ON d.event_id = 5 * st.{head} + {at} LEFT JOIN ev o ON o.event_id = 5 * st.{own or head} + {at}")

    lost = "(gone OR k % 53 = 2)" if faults else "gone"
    err = ("CASE WHEN event_type = 'error' THEN 'transport failure' WHEN event_type = 'purchase' AND k % 5 = 0 THEN 'max_tokens_exceeded: 40000 tokens' END"
           if faults else "NULL")
    broken = "k % 41 = 3" if faults else "false"
    blank = "user_id % 23 = 7" if faults else "false"
    nomodel = "user_id % 29 = 5" if faults else "false"
    return f"""(
  WITH st AS ({states}),
  ev AS (SELECT event_id, user_id, event_type, value, json_extract_string(props, '$.k')::BIGINT AS k FROM events),
  raw AS ({attempt(1)} UNION ALL {attempt(2)}),
  tall AS (SELECT *, least(floor(value * 100)::BIGINT, 10000) AS v0, (ok * 97 + ou * 31) % 101 * 100 AS q0 FROM raw),
  item AS (
    SELECT id, pos, state_sha256, attempt, {lost} AS lost, {err} AS err, {broken} AS broken, k, user_id, user_id AS r, ou * 67 % 10001 AS s,
      v0, (10000 - v0) * ok // 100 AS v1, q0, (10000 - q0) * (ou % 101) // 100 AS q1, ok % 7 <> 0 AS qd FROM tall),
  two AS (
    SELECT *, 10000 - v0 - v1 AS v2, 10000 - q0 - q1 AS q2,
      (NOT lost AND err IS NULL AND NOT broken) AS good,
      (NOT lost AND coalesce(err LIKE 'max_tokens%', false)) AS big FROM item),
  pick AS (
    SELECT t.* FROM two t JOIN two f ON f.id = t.id AND f.attempt = 1
    WHERE t.attempt = CASE WHEN f.good OR f.big THEN 1 ELSE 2 END),
  done AS (
    SELECT *, CASE WHEN lost THEN 'no result delivered' WHEN big THEN 'oversize: max_tokens_exceeded; shrink or split this state (' || err || ')'
      WHEN err IS NOT NULL THEN err WHEN broken THEN 'invalid judge answer' END AS error FROM pick)
  SELECT id, pos, attempt, state_sha256, error,
    CASE WHEN NOT lost THEN CASE WHEN r % 10 = 0 THEN 'stub-b' ELSE 'stub-a' END END AS selected_model,
    CASE WHEN NOT lost THEN 'stub-a' END AS primary_model,
    CASE WHEN NOT lost THEN r % 10 = 0 END AS fallback,
    CASE WHEN NOT lost AND NOT ({nomodel}) THEN CASE WHEN r % 10 = 0 THEN 'stub-b' ELSE 'stub-a' END END AS model,
    CASE WHEN NOT lost AND NOT ({blank}) THEN ['hit', 'partial', 'miss'][r % 3 + 1] END AS cache,
    CASE WHEN NOT lost THEN 3 END AS questions, CASE WHEN NOT lost THEN [3, 1, 0][r % 3 + 1] END AS cached_questions,
    (lost OR {blank}) AS provenance_unknown,
    CASE WHEN error IS NULL THEN CASE WHEN v0 >= v1 AND v0 >= v2 THEN 'keep' WHEN v1 >= v2 THEN 'revise' ELSE 'drop' END END AS verdict,
    CASE WHEN error IS NULL THEN v0 / 10000 END AS "verdict.keep", CASE WHEN error IS NULL THEN v1 / 10000 END AS "verdict.revise",
    CASE WHEN error IS NULL THEN v2 / 10000 END AS "verdict.drop", CASE WHEN error IS NULL THEN greatest(v0, v1, v2) / 10000 END AS "verdict.conf",
    CASE WHEN error IS NULL THEN s / 10000 END AS safe,
    CASE WHEN error IS NULL THEN (q1 + 2 * q2) / 10000 END AS quality, CASE WHEN error IS NULL THEN greatest(q0, q1, q2) / 10000 END AS "quality.conf",
    CASE WHEN error IS NULL AND qd THEN [q0 / 10000, q1 / 10000, q2 / 10000] END AS "quality.dist"
  FROM done)"""


def doc_states(where: str = "true", text: str = "text") -> str:
    """id, pos, state_sha256 of every document state."""
    return (f"SELECT CAST(doc_id AS VARCHAR) AS id, doc_id AS pos, sha256({json_string(text)}) AS state_sha256 "
            f"FROM documents WHERE {nonblank(text)} AND {where}")
