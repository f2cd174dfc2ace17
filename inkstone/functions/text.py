"""Text as Spark expressions: strips, splits, lengths, URL keys. Nothing here leaves the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: What counts as white space at the ends of a string.
WHITESPACE = "".join(map(chr, [*range(9, 14), *range(28, 33), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]))
#: Marks that end a half-line, and all marks that don't count towards a line's length.
SPLIT_MARKS = "，。！？；：、"
PUNCTUATION = "，。！？；：、（）《》〈〉“”‘’〔〕【】—…·,.!?;:()[]\"' "


def strip(c: Column) -> Column:
    """Without white space (of any script) at both ends."""
    return F.btrim(c, F.lit(WHITESPACE))


def is_blank(c: Column) -> Column:
    return strip(c) == ""


def unix_newlines(c: Column) -> Column:
    return F.regexp_replace(c, "\r\n?", "\n")


def without_punctuation(c: Column, marks: str = PUNCTUATION) -> Column:
    return F.translate(c, marks, "")


def sublines(line: Column, marks: str = SPLIT_MARKS) -> Column:
    """Non-blank pieces of a line between the marks, stripped."""
    return F.filter(F.transform(F.split(line, f"[{marks}]"), strip), lambda x: x != "")


def poem_sublines(paragraphs: Column, marks: str = SPLIT_MARKS) -> Column:
    """Sublines of all elements in order; null elements have none."""
    return F.flatten(F.transform(F.filter(paragraphs, lambda x: x.isNotNull()), lambda x: sublines(x, marks)))


def has_lines(paragraphs: Column) -> Column:
    """False for a null and for an empty list."""
    return F.coalesce(F.size(paragraphs), F.lit(0)) > 0


def poem_text(paragraphs: Column) -> Column:
    """Elements joined by line feeds (null elements left out); null for a null or empty list."""
    return F.when(has_lines(paragraphs), F.array_join(paragraphs, "\n"))


def poems(text: Column) -> Column:
    """Pieces of a corpus between blank lines, in order, blank ones dropped; three line feeds leave one at the front of a piece."""
    return F.filter(F.split(strip(unix_newlines(text)), "\n\n"), lambda p: ~is_blank(p))


def lines(text: Column) -> Column:
    """Non-blank lines of a piece of text."""
    return F.filter(F.split(text, "\n"), lambda x: ~is_blank(x))


def characters(text: Column) -> Column:
    """Code points, also beyond the basic plane."""
    return F.split(text, "")


def utf8_size(text: Column) -> Column:
    return F.octet_length(text)


def escape_newlines(text: Column) -> Column:
    return F.replace(text, F.lit("\n"), F.lit("\\n"))


def quoted(text: Column) -> Column:
    """A text in quotes with its unprintable characters escaped, as Python shows a string."""
    mark = F.when(F.contains(text, F.lit("'")) & ~F.contains(text, F.lit('"')), '"').otherwise("'")

    def shown(c: Column) -> Column:
        code = F.lower(F.hex(F.ascii(c)))
        odd = F.when(F.ascii(c) < 256, F.concat(F.lit("\\x"), F.lpad(code, 2, "0"))).when(F.ascii(c) < 65536, F.concat(F.lit("\\u"), F.lpad(code, 4, "0"))).otherwise(F.concat(F.lit("\\U"), F.lpad(code, 8, "0")))
        plain = F.when(c == "\\", "\\\\").when(c == "\n", "\\n").when(c == "\r", "\\r").when(c == "\t", "\\t").when((c == "'") & (mark == "'"), "\\'")
        return plain.when(c.rlike(r"^[\p{C}\p{Z}]$") & (c != " "), odd).otherwise(c)

    return F.concat(mark, F.array_join(F.transform(characters(text), shown), ""), mark)


def url_component(text: Column) -> Column:
    """Percent encoding that leaves letters, digits and - _ . ! ~ * ' ( ) as they are."""
    out = F.url_encode(text)
    for coded, plain in (("+", "%20"), ("%7E", "~"), ("%21", "!"), ("%27", "'"), ("%28", "("), ("%29", ")")):
        out = F.replace(out, F.lit(coded), F.lit(plain))
    return out


def query_key(author: Column, title: Column) -> Column:
    """Key of a search for author and title; nulls count as empty."""
    return url_component(F.concat_ws(" ", F.coalesce(author, F.lit("")), F.coalesce(title, F.lit(""))))


def padded(text: Column, width: int) -> Column:
    """Blanks before a text up to a width; longer texts stay whole."""
    return F.concat(F.repeat(F.lit(" "), F.greatest(F.lit(width) - F.length(text), F.lit(0))), text)
