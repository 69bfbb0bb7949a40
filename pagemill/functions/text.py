"""Scalar column expressions (JVM-side, codegen'd).  No Python UDFs here."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# ---------------------------------------------------------------------------
# Fixed values
# ---------------------------------------------------------------------------
# Python's str.split() whitespace: \t \n \v \f \r, \x1c-\x1f, space, U+0085, U+00A0,
# U+1680, U+2000-U+200A, U+2028, U+2029, U+202F, U+205F, U+3000.  Written with
# \x{..} escapes, which both Java regex and RE2 read the same way.
PY_WS_CLASS = (
    r"[\x{09}-\x{0d}\x{1c}-\x{20}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}"
    r"\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
)
SENTENCE_SPLIT = "[.!?]+"
SIZE_UNITS = ("B", "KB", "MB", "GB", "TB")
# Simplified reading ease: 206.835 - 1.015 * words per sentence, clamped to [0, 100].
READING_EASE_BASE = 206.835
READING_EASE_PER_WORD = 1.015
# ---------------------------------------------------------------------------


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def normalize_ws(c) -> Column:
    """``" ".join(s.split())`` with Python's whitespace set."""
    return F.trim(F.regexp_replace(_c(c), PY_WS_CLASS + "+", " "))


def py_strip(c) -> Column:
    """``s.strip()`` with Python's whitespace set."""
    return F.regexp_replace(_c(c), f"^{PY_WS_CLASS}+|{PY_WS_CLASS}+$", "")


def word_count(c) -> Column:
    """``len(s.split())``; null counts as empty.

    One split on whitespace runs (no normalised copy): the pieces are the
    words plus one empty piece for leading and one for trailing whitespace.
    """
    s = F.coalesce(_c(c), F.lit(""))
    pieces = F.size(F.split(s, PY_WS_CLASS + "+", -1))
    lead = F.when(F.substring(s, 1, 1).rlike(PY_WS_CLASS), 1).otherwise(0)
    trail = F.when(F.substring(s, -1, 1).rlike(PY_WS_CLASS), 1).otherwise(0)
    return F.when(s == "", F.lit(0)).otherwise(pieces - lead - trail)


def sentence_count(c) -> Column:
    """``len(re.split(r"[.!?]+", s))`` = matches + 1 (an empty string gives 1)."""
    return (F.regexp_count(F.coalesce(_c(c), F.lit("")), F.lit(SENTENCE_SPLIT)) + 1).cast("int")


def readability(c) -> Column:
    """Simplified reading ease, clamped to [0, 100]."""
    words = word_count(c).cast("double")
    sentences = F.greatest(sentence_count(c), F.lit(1)).cast("double")
    score = F.lit(READING_EASE_BASE) - F.lit(READING_EASE_PER_WORD) * (words / sentences)
    return F.greatest(F.lit(0.0), F.least(F.lit(100.0), score))


def truthy(c, kind: str = "string") -> Column:
    """Python truthiness of a value: null, "", 0, [] and {} are false.

    ``kind``: string | array | map | number | struct.  A version string "0"
    counts as false, like the integer version 0 it stands for.
    """
    c = _c(c)
    if kind == "string":
        return c.isNotNull() & (c != "")
    if kind == "version":
        return c.isNotNull() & (c != "") & (c != "0")
    if kind == "array":
        return c.isNotNull() & (F.size(c) > 0)
    if kind == "map":
        return c.isNotNull() & (F.size(c) > 0)
    if kind == "number":
        return c.isNotNull() & (c != 0)
    return c.isNotNull()


def path_suffix(name) -> Column:
    """``pathlib.Path(name).suffix.lower()``: the last dot-part, or '' when
    the only dot leads the name or ends it."""
    return F.lower(F.regexp_extract(_c(name), r"(?s)^.+(\.[^.]+)$", 1))


def readable_size(size) -> Column:
    """Bytes as ``"%.2f UNIT"`` in 1024 steps, exactly as Python prints
    ``size / 1024.0 ** k`` (round half to even on the exact binary value,
    which is exact here because the divisor is a power of two).

    Done in exact decimal arithmetic: q = round_half_even(size * 100 / 1024**k),
    printed as ``q // 100 "." q % 100``.  Null sizes give ``"0 B"``.
    """
    d = "decimal(38,0)"
    s = _c(size).cast(d)
    scaled = s * F.lit(100).cast(d)
    out = None
    for k, unit in enumerate(SIZE_UNITS):
        div = F.lit(1024 ** k).cast(d)
        rem = F.pmod(scaled, div)
        q = ((scaled - rem) / div).cast(d)
        up = (rem * 2 > div) | ((rem * 2 == div) & (F.pmod(q, F.lit(2).cast(d)) == 1))
        q = F.when(up, q + 1).otherwise(q)
        hundred = F.lit(100).cast(d)
        txt = F.concat(
            ((q - F.pmod(q, hundred)) / hundred).cast(d).cast("string"),
            F.lit("."),
            F.lpad(F.pmod(q, hundred).cast("int").cast("string"), 2, "0"),
            F.lit(" " + unit),
        )
        if unit == "TB":
            out = out.otherwise(txt)
        else:
            cond = s < F.lit(1024 ** (k + 1)).cast(d)
            out = F.when(cond, txt) if out is None else out.when(cond, txt)
    return F.when(s.isNull(), F.lit("0 B")).otherwise(out)


def iso_timestamp(c, strict: bool = False) -> Column:
    """ISO-8601 text to an instant; bad or empty text gives null unless
    ``strict`` (then the query fails, like the source tool)."""
    c = F.nullif(_c(c), F.lit(""))
    return c.cast("timestamp") if strict else F.try_to_timestamp(c)


def iso_format(ts) -> Column:
    """Instant as ``yyyy-MM-ddTHH:mm:ss`` (UTC session)."""
    return F.date_format(_c(ts), "yyyy-MM-dd'T'HH:mm:ss")


def epoch_second(ts) -> Column:
    """Whole epoch seconds of a timestamp (NTZ read as UTC)."""
    return F.unix_seconds(_c(ts).cast("timestamp"))
