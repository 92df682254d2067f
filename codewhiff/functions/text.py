"""Text functions with ECMAScript semantics, as built-in Spark expressions.

Patterns are written once, in the common subset of regular expressions, and rendered for an engine: ``\\s`` is ECMAScript's
white space, ``.`` stops at its four line terminators, ``$`` is only the very end, and ``\\b`` is an ASCII word boundary.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: ECMAScript white space, as the inside of a character class that Java and RE2 both read.
SPACES = r"\t-\r \x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}"
_ANY = r"[^\n\r\x{2028}\x{2029}]"
_JAVA_EDGE = r"(?:(?<=\w)(?!\w)|(?<!\w)(?=\w))"

EMPTY = "array<struct<ord:int,line:int,column:int,message:string,snippet:string>>"


def render(pattern: str, ignore_case: bool = False, engine: str = "java") -> str:
    """``pattern`` for Spark (``java``) or DuckDB (``re2``)."""
    out, i, inside = ["(?i)"] if ignore_case else [], 0, False
    while i < len(pattern):
        c = pattern[i]
        if c == "\\":
            two = pattern[i : i + 2]
            i += 2
            if two == r"\s":
                out.append(SPACES if inside else f"[{SPACES}]")
            elif two == r"\S" and not inside:
                out.append(f"[^{SPACES}]")
            elif two == r"\b" and engine == "java":
                out.append(_JAVA_EDGE)
            else:
                out.append(two)
            continue
        if c == "[" and not inside:
            inside = True
        elif c == "]" and inside:
            inside = False
        elif c == "." and not inside:
            c = _ANY
        elif c == "$" and not inside:
            c = r"\z"
        elif c == "[":
            c = r"\["  # Java reads a bare one inside a class as a nested class
        out.append(c)
        i += 1
    return "".join(out)


def matches(text: Column, pattern: str, ignore_case: bool = False) -> Column:
    return text.rlike(render(pattern, ignore_case))


def position(text: Column, pattern: str, ignore_case: bool = False) -> Column:
    """The leftmost match, from 1 on in UTF-16 units; 0 if there is none."""
    return F.regexp_instr(text, F.lit(render(pattern, ignore_case)))


def strip(text: Column) -> Column:
    """Without white space at either end."""
    return F.regexp_replace(text, render(r"^\s+|\s+$"), "")


def blank(text: Column) -> Column:
    return ~matches(text, r"\S")


def lines_of(content: Column) -> Column:
    """Lines end at LF alone: CR stays, and a last LF gives an empty last line."""
    return F.split(content, "\n", -1)


def extension(path: Column) -> Column:
    """The part after the last dot of the file's name; none for a name whose only dot is its first character."""
    return F.regexp_extract(path, r"(?:^|/)[^/]+\.([^./]*)\z", 1)


def unquoted(text: Column) -> Column:
    """A line without escaped characters and string contents; an open string takes the rest of the line."""
    return F.regexp_replace(F.regexp_replace(text, r"(?s)\\.", ""), r"""(?s)"[^"]*(?:"|\z)|'[^']*(?:'|\z)|`[^`]*(?:`|\z)""", "")


def count_of(text: Column, char: str) -> Column:
    return F.length(text) - F.length(F.replace(text, F.lit(char), F.lit("")))


def braces(text: Column) -> Column:
    """Opening less closing braces, outside strings."""
    bare = F.regexp_replace(unquoted(text), r"[^{}]+", "")
    delta = 2 * F.length(F.replace(bare, F.lit("}"), F.lit(""))) - F.length(bare)
    return F.when(text.contains("{") | text.contains("}"), delta).otherwise(0)


def raw_braces(text: Column) -> Column:
    """Opening less closing braces, wherever they stand."""
    return count_of(text, "{") - count_of(text, "}")


def indent(text: Column) -> Column:
    """Characters before the first one that isn't white space; -1 if there is none."""
    return position(text, r"\S") - 1
