"""Regular expressions and term-matching expressions for complaint text.

Patterns are written with explicit character classes so that Spark (Java
regex) and DuckDB (RE2) give the same result, and both match the usual
Unicode meaning: whitespace is the Unicode white-space set, a word character
is a letter, a number or '_'.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# ---------------------------------------------------------------------------
# FIXED VALUES: character classes and cleaning patterns
# ---------------------------------------------------------------------------
# White space = the 29 characters Python's str.isspace() accepts.  Spelled out
# for RE2 (DuckDB); for Java the Unicode White_Space property plus the four
# information separators is the same set and is tested in one step per character.
WS_CHARS_SQL = (r"\t\n\x{0B}\f\r \x{1C}-\x{1F}\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}"
                r"\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}")
WS_CHARS_JAVA = r"\p{IsWhite_Space}\x{1C}-\x{1F}"
WS_LITERAL = ("\t\n\x0b\x0c\r \x1c\x1d\x1e\x1f\x85\xa0\u1680" + "".join(chr(c) for c in range(0x2000, 0x200B))
              + "\u2028\u2029\u202f\u205f\u3000")


def patterns(ws_chars: str) -> dict[str, str]:
    ws, not_ws = f"[{ws_chars}]", f"[^{ws_chars}]"
    return {
        "WS": ws,
        "NOT_WS": not_ws,
        "URL": f"https?://{not_ws}+|www\\.{not_ws}+",
        "EMAIL": f"{not_ws}+@{not_ws}+",
        # the same matches as EMAIL for a backtracking engine: a match is always
        # a whole white-space-delimited run holding an '@' with a character on
        # each side, so the search is anchored at run starts (linear, not quadratic)
        "EMAIL_ANCHORED": f"(?<!{not_ws})(?={not_ws}+@{not_ws}){not_ws}+",
        "SPECIAL": f"[^a-zA-Z0-9{ws_chars}.,!?]",
        "NON_WORD": f"[^\\p{{L}}\\p{{N}}_{ws_chars}]",
    }


SQL_PATTERNS = patterns(WS_CHARS_SQL)
JAVA_PATTERNS = patterns(WS_CHARS_JAVA)
WS = JAVA_PATTERNS["WS"]
URL_PATTERN = JAVA_PATTERNS["URL"]
EMAIL_PATTERN_ANCHORED = JAVA_PATTERNS["EMAIL_ANCHORED"]
SPECIAL_PATTERN = JAVA_PATTERNS["SPECIAL"]
NON_WORD_PATTERN = JAVA_PATTERNS["NON_WORD"]


def strip_ws(c: Column) -> Column:
    """Remove white space at both ends (one linear pass, no regex)."""
    return F.trim(c, F.lit(WS_LITERAL))


def squeeze_spaces(c: Column) -> Column:
    """Collapse white-space runs to one space and strip the ends."""
    return F.regexp_replace(strip_ws(c), f"{WS}+", " ")


def words(c: Column) -> Column:
    """Split on white space (no empty tokens for leading / trailing space)."""
    s = strip_ws(c)
    return F.when(s == "", F.array().cast("array<string>")).otherwise(F.split(s, f"{WS}+"))


def count_contained(text_lower: Column, terms: list[str]) -> Column:
    """Number of ``terms`` that occur as substrings of ``text_lower`` (each counted once).

    ``contains`` scans bytes; ``instr`` would walk characters to compute a
    position it does not need (several times slower on long texts).
    """
    out = F.lit(0)
    for t in terms:
        out = out + F.when(text_lower.contains(t), 1).otherwise(0)
    return out


def any_contained(text_lower: Column, terms: list[str]) -> Column:
    cond = F.lit(False)
    for t in terms:
        cond = cond | text_lower.contains(t)
    return cond


def whole_word_count(text_lower: Column, terms: list[str]) -> Column:
    """Like ``count_contained`` but a term must stand as whole words."""
    out = F.lit(0)
    for t in terms:
        pat = f"(^|[^\\p{{L}}\\p{{N}}_]){t}([^\\p{{L}}\\p{{N}}_]|$)"
        out = out + F.when(F.regexp_like(text_lower, F.lit(pat)), 1).otherwise(0)
    return out


def sql_regex(p: str) -> str:
    """A pattern as a SQL string literal (quotes doubled)."""
    return "'" + p.replace("'", "''") + "'"
