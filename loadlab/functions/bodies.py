"""JSON bodies and query templates."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from loadlab import fixed_values as fixed


def canonical_json(body: Column) -> Column:
    """The body re-encoded with keys sorted at every level; NULL unless it is one
    JSON object (or the literal ``null``, which decodes to an empty object slot).

    The parser stops after the first value, so the body is parsed as the element
    of an array and as the member of an object: text after the value cannot be
    valid in both.
    """
    trimmed = F.btrim(body, F.lit(" \t\r\n"))
    element = F.try_parse_json(F.concat(F.lit("["), body, F.lit("]")))
    member = F.try_parse_json(F.concat(F.lit('{"":'), body, F.lit("}")))
    return F.when(
        (trimmed.startswith("{") | (trimmed == "null")) & member.isNotNull(), F.btrim(F.to_json(element), F.lit("[]"))
    )


def has_placeholder(template: str) -> bool:
    return fixed.TERM_PLACEHOLDER in template


def fill_template(template: str, term: Column) -> Column:
    """The template with its first placeholder replaced by the term as it is."""
    before, mark, after = template.partition(fixed.TERM_PLACEHOLDER)
    return F.concat(F.lit(before), term, F.lit(after)) if mark else F.lit(template)
