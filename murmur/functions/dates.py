"""Date and time expressions on TIMESTAMP_NTZ (no time-zone conversion anywhere).

Parsing keeps the first pattern of a list that parses, per row.  A text is
tried only with the patterns of its own shape (where its digits, letters and
separators stand), two at most for the lists used here; ``try_to_timestamp``
returns null instead of failing under ANSI mode.
"""

from __future__ import annotations

import re
import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from murmur.constants import DATE_FORMATS, DATETIME_FORMATS


def truncate_to_second(c: Column) -> Column:
    frac_micros = ((F.date_part(F.lit("SECOND"), c) * 1000000).cast("bigint")) % 1000000
    return F.timestamp_add("MICROSECOND", -frac_micros, c)


def truncate_to_hour(c: Column) -> Column:
    s = truncate_to_second(c)
    return F.timestamp_add("SECOND", -(F.minute(s) * 60 + F.second(s)), s)


def _two_digit_year_fix(ts: Column, fmt: str) -> Column:
    """Two-digit years map to 2000-2099 in Spark; years above 2068 belong to the
    previous century under the C library convention (69-99 -> 1969-1999)."""
    if "yyyy" in fmt or "yy" not in fmt:
        return ts
    return F.when(F.year(ts) > 2068, F.timestamp_add("YEAR", F.lit(-100), ts)).otherwise(ts)


def text_shape(text: Column) -> Column:
    """Digits and letters of a text as classes: 0 for a run of one or two digits, 4 for four, a for letters.

    Runs of other lengths give shapes that no pattern has.
    """
    digits, letters = string.digits, string.ascii_letters
    shape = F.translate(text, digits + letters, "0" * len(digits) + "a" * len(letters))
    for run, name in (("0000", "4"), ("00", "0"), ("aaa", "a"), ("aa", "a")):
        shape = F.replace(shape, F.lit(run), F.lit(name))
    return shape


def pattern_shape(pattern: str) -> str:
    """The shape of the texts that a datetime pattern can parse."""
    field = {"yyyy": "4", "yy": "0", "M": "0", "MMM": "a", "d": "0", "H": "0", "h": "0", "mm": "0", "ss": "0", "a": "a"}
    out = ""
    for m in re.finditer(r"'[^']*'|([A-Za-z])\1*|[^A-Za-z']", pattern):
        token = m.group(0)
        out += "a" if token[0] == "'" else field[token] if token[0].isalpha() else token
    return out


def _parse(text: Column, pattern: str) -> Column:
    return _two_digit_year_fix(F.try_to_timestamp(text, F.lit(pattern)).cast("timestamp_ntz"), pattern)


def parse_by_shape(text: Column, shape: Column, patterns: list[str]) -> Column:
    """First pattern that parses ``text`` (trimmed), of those with its ``shape``, as TIMESTAMP_NTZ; null if none does."""
    by_shape: dict[str, list[str]] = {}
    for p in patterns:
        by_shape.setdefault(pattern_shape(p), []).append(p)
    out = None
    for key, fitting in by_shape.items():
        tries = F.coalesce(*[_parse(text, p) for p in fitting])
        out = F.when(shape == key, tries) if out is None else out.when(shape == key, tries)
    return out


def parse_columns(df: DataFrame, parsed: dict[str, tuple[str, list[str]]]) -> DataFrame:
    """``df`` plus each key of ``parsed``: the column named first in its value, parsed by the patterns after it.

    Shapes and parsed values are computed once a row: the values leave a
    generator, so that filters and projections above read them as columns.
    """
    names = list(dict.fromkeys(c for c, _ in parsed.values()))
    texts = {c: (f"_text_{i}", f"_shape_{i}") for i, c in enumerate(names)}
    held = df.withColumns({texts[c][0]: F.trim(F.col(c).cast("string")) for c in names})
    held = held.withColumns({texts[c][1]: text_shape(F.col(texts[c][0])) for c in names})
    values = F.struct(*[parse_by_shape(F.col(texts[c][0]), F.col(texts[c][1]), p).alias(f"_parsed_{i}")
                        for i, (c, p) in enumerate(parsed.values())])
    out = held.select(*df.columns, F.inline(F.array(values)))
    return out.withColumns({name: F.col(f"_parsed_{i}") for i, name in enumerate(parsed)}).drop(
        *[f"_parsed_{i}" for i in range(len(parsed))])


def parse_datetime_multi(c: Column, formats: list[str] = DATETIME_FORMATS) -> Column:
    """``c`` parsed by the first pattern that fits, as an expression (``parse_columns`` parses once for many uses)."""
    text = F.trim(c.cast("string"))
    return parse_by_shape(text, text_shape(text), formats)


def parse_date_multi(c: Column, formats: list[str] = DATE_FORMATS) -> Column:
    return F.to_date(parse_datetime_multi(c, formats))
