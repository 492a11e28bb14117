"""Text functions as column expressions; nothing leaves the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space that is stripped from texts (Unicode, with the information separators and no-break spaces).
SPACE = r"[\t\n\x0B\f\r\x1C-\x1F \x85\xA0\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"
#: Digits of page numbers: decimal digits of any script, super- and subscripts and circled digits.
DIGIT = r"[\p{Nd}²³¹⁰⁴-⁹₀-₉①-⑨]"
NO_ORDINAL = 999_999


def stripped(text: Column) -> Column:
    return F.regexp_replace(text, f"^{SPACE}+|{SPACE}+$", "")


def is_blank(text: Column) -> Column:
    return F.coalesce(stripped(text) == "", F.lit(True))


def is_page_number(text: Column) -> Column:
    """At most three digits and nothing else, white space aside; null is none."""
    return F.coalesce(text.rlike(f"^{SPACE}*{DIGIT}{{1,3}}{SPACE}*$"), F.lit(False))  # settled within the first characters of a text


def ordinal(identifier: Column) -> Column:
    """The number behind the first ``ch`` of an id and before the next; ids without one come last."""
    return F.coalesce(stripped(F.get(F.split(identifier, "ch"), F.lit(1))).try_cast("bigint"), F.lit(NO_ORDINAL).cast("bigint"))


def first_line(text: Column) -> Column:
    return stripped(F.get(F.split(text, "\n"), F.lit(0)))


def level_of(attributes: Column) -> Column:
    """``level`` of a JSON object as an integer: numbers are truncated, numeric strings read, all else is null."""
    item = F.try_variant_get(F.try_parse_json(attributes), "$.level", "variant")
    return F.transform(F.array(item), _level)[0]  # the text is parsed once


def _level(item: Column) -> Column:
    text = stripped(F.try_variant_get(item, "$", "string"))
    digits = F.when(text.rlike(r"^[+-]?[0-9]+$"), text.try_cast("int"))
    return F.when(F.schema_of_variant(item) == "STRING", digits).otherwise(F.try_variant_get(item, "$", "int"))


def joined(items: Column, by: Column, text: str = "text") -> Column:
    """Aggregate: ``text`` of the structs ``items`` joined by line feeds in the order of ``by``."""
    ordered = F.array_sort(F.collect_list(F.struct(by.alias("o"), items.alias(text))))
    return F.array_join(F.transform(ordered, lambda x: x[text]), "\n")
