"""Text columns: lines, signatures, capping, emptiness, elision, Markdown cells."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# Fixed character sets, written for Java regular expressions.
BLANK = r"\x09-\x0d\x1c-\x20\x85\xa0\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
LINE_BREAK = r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85\x{2028}\x{2029}]"
LINE_BREAK_PY = r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85\u2028\u2029]"
WORD = r"\p{L}\p{N}_"
_BEFORE, _AFTER = rf"(?<![{WORD}])", rf"(?![{WORD}])"

# Fixed signature patterns, in the order they are applied.
SIGNATURE_STEPS = (
    (rf"(?i){_BEFORE}[0-9a-f]{{8}}-[0-9a-f]{{4}}-[0-9a-f]{{4}}-[0-9a-f]{{4}}-[0-9a-f]{{12}}{_AFTER}", "<uuid>"),
    (rf"{_BEFORE}\p{{Nd}}{{4}}-\p{{Nd}}{{2}}-\p{{Nd}}{{2}}"
     rf"(?:[Tt ]\p{{Nd}}{{2}}:\p{{Nd}}{{2}}:\p{{Nd}}{{2}}(?:\.\p{{Nd}}+)?(?:[Zz]|[+-]\p{{Nd}}{{2}}:?\p{{Nd}}{{2}})?)?"
     rf"{_AFTER}", "<ts>"),
    (rf"(?i){_BEFORE}(?:0x)?[\p{{Nd}}a-f]{{8,}}{_AFTER}", "<hex>"),
    (rf"{_BEFORE}[-+]?\p{{Nd}}+(?:\.\p{{Nd}}+)?(?:[eE][-+]?\p{{Nd}}+)?{_AFTER}", "<n>"),
)

# Fixed elision markers: name, pattern.
ELISION_MARKERS = (
    ("[… N ln elided", r"\[(?:…|\.\.\.)\s*\d+\s*ln elided"),
    ("re-read needed ranges", r"re-read needed ranges"),
    ("… N more", r"(?:…|\.\.\.)\s*\d+ more\b"),
    ("[Some lines truncated to", r"\[Some lines truncated to"),
    ("Use artifact://", r"Use artifact://"),
)


def tail(array: Column, start: Column) -> Column:
    """Elements from `start` (1-based) to the end."""
    return F.slice(array, start, F.greatest(F.size(array) - start + 1, F.lit(0)))


def strip(col: Column) -> Column:
    """Unicode-aware strip of both ends."""
    return F.regexp_replace(col, rf"^[{BLANK}]+|[{BLANK}]+$", "")


def nonblank(col: Column) -> Column:
    """True when the text holds a character that is not white space. Null is blank."""
    return F.coalesce(col.rlike(rf"[^{BLANK}]"), F.lit(False))


def lines(col: Column) -> Column:
    """Array of lines without their breaks; a final break adds no empty line; empty text has no lines."""
    parts = F.split(col, LINE_BREAK, -1)
    n = F.size(parts)
    return F.when(F.element_at(parts, -1) == "", F.slice(parts, 1, n - 1)).otherwise(parts)


def signature(col: Column) -> Column:
    """Stripped text with ids, times, hex runs and numbers replaced by place holders."""
    out = strip(col)
    for pattern, mark in SIGNATURE_STEPS:
        out = F.regexp_replace(out, pattern, F.lit(mark))
    return out


def signature_id(sig: Column) -> Column:
    return F.substring(F.sha1(sig), 1, 10)


def _digits(number: Column) -> Column:
    return F.length(number.cast("string"))


def capped(col: Column, cap: int) -> Column:
    """Text of at most `cap` characters. A cut text ends in a marker counted inside the cap.

    The marker names how many characters were cut, and its own length moves that number. One step after the
    first guess the digit count is stable, so two arithmetic steps replace a loop.
    """
    if cap <= 0:
        raise ValueError("cap must be positive")
    frame = len("\n…[truncated  chars]")
    over = F.length(col) - cap
    first = over + frame + _digits(over)
    cut = over + frame + _digits(first)
    kept = F.lit(cap) - frame - _digits(first)
    short = F.concat(F.left(col, kept), F.lit("\n…[truncated "), cut.cast("string"), F.lit(" chars]"))
    safe = F.when(kept < 0, F.raise_error(F.lit("the cap is smaller than its marker"))).otherwise(short)
    return F.when(over > 0, safe).otherwise(col)


def was_capped(col: Column, cap: int) -> Column:
    return F.coalesce((F.length(col) > cap).cast("int"), F.lit(0))


def elision(col: Column) -> Column:
    """struct(marker, line) of the first marker found, in the fixed order; null when the text is whole."""
    found = F.lit(None).cast("struct<marker:string,line:int>")
    for name, pattern in reversed(ELISION_MARKERS):
        head = F.element_at(F.split(col, pattern, 2), 1)
        line = (F.length(head) - F.length(F.replace(head, F.lit("\n"), F.lit(""))) + 1).cast("int")
        found = F.when(col.rlike(pattern), F.struct(F.lit(name).alias("marker"), line.alias("line"))).otherwise(found)
    return found


def table_cells(line: Column) -> Column:
    r"""Cells of one Markdown table row. `\|` is a literal pipe; one leading and one trailing pipe are frames."""
    body = strip(line)
    body = F.regexp_replace(body, r"^\|", "")
    body = F.when(F.regexp_replace(body, r"\\\|", "").endswith("|"), F.regexp_replace(body, r"\|$", "")).otherwise(body)
    cells = F.split(body, r"(?<!\\)\|", -1)
    return F.transform(cells, lambda cell: strip(F.replace(cell, F.lit("\\|"), F.lit("|"))))


def markdown_cell(text: Column) -> Column:
    r"""Escape `\` and `|`, and put line breaks to spaces; null is empty."""
    out = F.coalesce(text, F.lit(""))
    for old, new in (("\\", "\\\\"), ("|", "\\|"), ("\r", " "), ("\n", " ")):
        out = F.replace(out, F.lit(old), F.lit(new))
    return out


def fence_for(text: Column) -> Column:
    """A back-tick fence longer than any run inside `text`, and at least three long."""
    runs = F.transform(F.regexp_extract_all(text, F.lit("(`+)"), 1), F.length)
    longest = F.coalesce(F.array_max(runs), F.lit(0))
    return F.repeat(F.lit("`"), F.greatest(F.lit(3), longest + 1))
