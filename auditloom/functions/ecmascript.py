"""ECMAScript text semantics as Spark columns: patterns, trimming and UTF-16 lengths."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space and line ends, as they stand inside a character class.
WHITE = r"\t\n\x0B\f\r \u00A0\u1680\u2000-\u200A\u2028\u2029\u202F\u205F\u3000\uFEFF"


def java_pattern(pattern: str, ignore_case: bool = False) -> str:
    """A pattern that Java matches as ECMAScript does: white space and ``.`` spelt out, class syntax escaped, ``$`` at the very end only."""
    out, inside, i = [], False, 0
    while i < len(pattern):
        c = pattern[i]
        if c == "\\" and i + 1 < len(pattern):
            pair = pattern[i : i + 2]
            i += 2
            if inside and pattern.startswith(r"[\s\S]", i - 3):
                out[-1] = r"[\x{0}-\x{10FFFF}"
                i += 2
            elif pair == r"\s":
                out.append(WHITE if inside else f"[{WHITE}]")
            elif pair == r"\S":
                out.append(f"[^{WHITE}]")  # inside a class: a union, as Java has it
            else:
                out.append(pair)
            continue
        if inside:
            if c == "]":
                inside = False
            elif c == "[" or (c == "&" and pattern.startswith("&&", i)):
                out.append("\\")
        elif c == "[":
            inside = True
        elif c == ".":
            c = r"[^\n\r\u2028\u2029]"
        elif c == "$":
            c = r"\z"
        out.append(c)
        i += 1
    return ("(?i)" if ignore_case else "") + "".join(out)


def trim(text: Column) -> Column:
    """Without white space and line ends at both ends."""
    return F.regexp_replace(F.regexp_replace(text, f"^[{WHITE}]+", ""), rf"[{WHITE}]+\z", "")


def utf16_length(text: Column) -> Column:
    """Length in UTF-16 units."""
    return (F.octet_length(F.encode(text, "UTF-16BE")) / 2).cast("long")


def basename(path: Column) -> Column:
    return F.regexp_replace(path, r"^[\s\S]*/", "")


def extension(path: Column) -> Column:
    """Lower-case extension without its dot; '' for dot files and names without one."""
    return F.lower(F.regexp_extract(basename(path), r"^.+\.([^.]*)\z", 1))


def half_up(x: Column) -> Column:
    return F.floor(x + 0.5)
