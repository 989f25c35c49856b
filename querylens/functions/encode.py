"""Escaping rules of the three export formats, and quoted-field splitting."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from querylens.functions.coerce import once, trim, trimmed

# Two private-use characters stand for already decoded escapes while the rest is decoded.
_BACKSLASH_MARK = "\ue000"
_QUOTE_MARK = "\ue001"


def tsv_field(col: Column, data_type: str = "string") -> Column:
    """Text of one exported field: NULL is ``\\N``, control characters and backslashes are escaped."""
    if data_type.startswith("timestamp"):
        text = F.date_format(col, "yyyy-MM-dd HH:mm:ss.SSSSSS")
    else:
        text = col.cast("string")
    for raw, escaped in (("\\", "\\\\"), ("\n", "\\n"), ("\r", "\\r"), ("\t", "\\t")):
        text = F.replace(text, F.lit(raw), F.lit(escaped))
    return F.coalesce(text, F.lit("\\N"))


def unescape_export(col: Column) -> Column:
    """Decode ``\\n \\r \\t \\\\``; any other escape stays as it is."""
    out = F.replace(col, F.lit("\\\\"), F.lit(_BACKSLASH_MARK))
    for escaped, raw in (("\\n", "\n"), ("\\r", "\r"), ("\\t", "\t")):
        out = F.replace(out, F.lit(escaped), F.lit(raw))
    return F.replace(out, F.lit(_BACKSLASH_MARK), F.lit("\\"))


def decoded_export(text: Column) -> Column:
    """Text of a trimmed field: blank, ``\\N`` and ``null`` mean NULL."""
    is_null = text.isin("", "\\N") | (F.lower(text) == "null")
    return F.when(~is_null, F.when(F.contains(text, F.lit("\\")), unescape_export(text)).otherwise(text))


#: What makes an exported field a text, one step after the other.
EXPORT_STEPS = (trimmed, decoded_export)


def export_text(field: Column) -> Column:
    return once(trim(field), decoded_export)


# Escapes inside a dumped string literal.
DUMP_ESCAPES = {"0": "\0", "b": "\b", "n": "\n", "r": "\r", "t": "\t", "Z": "\x1a"}


def decode_dump_string(body: Column) -> Column:
    """Inside of a quoted dump literal to text; an unknown escape stands for its own character."""
    out = F.replace(body, F.lit("\\\\"), F.lit(_BACKSLASH_MARK))
    out = F.replace(out, F.lit("\\'"), F.lit(_QUOTE_MARK))
    out = F.replace(out, F.lit("''"), F.lit("'"))
    for letter, raw in DUMP_ESCAPES.items():
        out = F.replace(out, F.lit("\\" + letter), F.lit(raw))
    out = F.regexp_replace(out, r"(?s)\\(.)", "$1")
    out = F.replace(out, F.lit(_QUOTE_MARK), F.lit("'"))
    return F.replace(out, F.lit(_BACKSLASH_MARK), F.lit("\\"))


def split_quoted(line: Column, delimiter: str) -> Column:
    """Fields of a delimited line; NULL when a quote is left open.

    A field is quoted only when it starts with ``"``; ``""`` inside stands for one quote, and text
    after the closing quote belongs to the field.
    """
    d = "\\t" if delimiter == "\t" else delimiter
    token = rf'{d}("(?:[^"]+|"")*+"[^{d}]*|[^{d}"][^{d}]*|)'
    led = F.concat(F.lit(delimiter), line)
    quoted = r'(?s)^"((?:[^"]+|"")*+)"(.*)\z'

    def plain(field: Column) -> Column:
        between = F.substr(field, F.lit(2), F.length(field) - 2)
        # most quoted fields end with their second quote
        only_two = F.endswith(field, F.lit('"')) & (F.octet_length(field) > 1) & ~F.contains(between, F.lit('"'))
        inner = F.replace(F.regexp_extract(field, quoted, 1), F.lit('""'), F.lit('"'))
        return (
            F.when(~F.startswith(field, F.lit('"')), field)
            .when(only_two, between)
            .otherwise(F.concat(inner, F.regexp_extract(field, quoted, 2)))
        )

    def whole(fields: Column) -> Column:
        complete = F.length(F.array_join(fields, delimiter)) == F.length(line)
        return F.when(complete, F.transform(fields, plain))

    tokens = once(F.regexp_extract_all(led, F.lit(token), 1), whole)
    return F.when(F.contains(line, F.lit('"')), tokens).otherwise(F.split(line, d))

