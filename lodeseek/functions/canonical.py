"""Text forms that must be equal byte for byte wherever they are made: JSON in two escape modes, and full case folding."""

from __future__ import annotations

import json
import sys

from pyspark.sql import Column
from pyspark.sql import functions as F

ANY = r"(?s)."


def _unit(number: Column) -> Column:
    return F.concat(F.lit("\\u"), F.lower(F.lpad(F.hex(number), 4, "0")))


def json_string(text: Column, ascii_only: bool = False) -> Column:
    """The text as a JSON string: control characters as their short or four-digit escapes, and with ascii_only all from DEL on as \\uXXXX, in pairs of surrogates beyond 16 bits. Null is null."""
    short = {'"': '\\"', "\\": "\\\\", "\n": "\\n", "\r": "\\r", "\t": "\\t", "\b": "\\b", "\f": "\\f"}

    def escaped(c: Column) -> Column:
        at = F.ascii(c)  # the code point
        out = F.lit(None).cast("string")
        for char, mark in short.items():
            out = F.coalesce(out, F.when(c == char, F.lit(mark)))
        out = F.coalesce(out, F.when(at < 32, _unit(at)))
        if ascii_only:
            above = at - 0x10000
            pair = F.concat(_unit(F.shiftright(above, 10) + 0xD800), _unit(above % 1024 + 0xDC00))
            out = F.coalesce(out, F.when(at > 0xFFFF, pair), F.when(at > 126, _unit(at)))
        return F.coalesce(out, c)

    special = '[\\x00-\\x1f"\\\\' + ("\\x{7f}-\\x{10FFFF}]" if ascii_only else "]")
    whole = F.when(text.rlike(special), F.array_join(F.transform(F.regexp_extract_all(text, F.lit(ANY), F.lit(0)), escaped), "")).otherwise(text)
    return F.concat(F.lit('"'), whole, F.lit('"'))


def json_array(*values: Column | str | int | float | bool | None, ascii_only: bool = False) -> Column:
    """A compact JSON array of string columns and plain settings; null columns are null in it."""
    parts = []
    for v in values:
        if isinstance(v, Column):
            parts.append(F.coalesce(json_string(v, ascii_only), F.lit("null")))
        else:
            parts.append(F.lit(json.dumps(v, ensure_ascii=ascii_only, separators=(",", ":"))))
    return F.concat(F.lit("["), F.concat_ws(",", *parts), F.lit("]"))


def _folds() -> dict[str, str]:
    """Characters whose full case folding is not their lower case, by Python's own tables."""
    return {c: c.casefold() for c in map(chr, range(128, sys.maxunicode + 1)) if c.casefold() != c.lower()}


FOLDS = json.dumps(_folds(), ensure_ascii=False)


def folded(text: Column) -> Column:
    """The text in full case folding: ß as ss, final sigma as sigma; for ASCII, its lower case."""
    table = F.from_json(F.lit(FOLDS), "map<string,string>")
    chars = F.transform(F.regexp_extract_all(text, F.lit(ANY), F.lit(0)), lambda c: F.coalesce(F.element_at(table, c), F.lower(c)))
    return F.when(text.rlike("[^\\x00-\\x7f]"), F.array_join(chars, "")).otherwise(F.lower(text))
