"""Generated text: fences, JSON answers, stop markers, citations."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quarry.functions.text import before, strip

FENCE = "```"
#: Where an answer ends, in the order in which they are looked for.
STOP_MARKERS = ["<END_ANSWER>", "\n---", "\n[S2]", "\n[S3]", "\n[S4]"]
CITATION = "[S1]"


def without_fences(text: Column) -> Column:
    """Strip; take off a leading fence, with or without its json tag, and a trailing one, stripping after each."""
    tagged, n = FENCE + "json", len(FENCE)
    whole = strip(text)
    body = (
        F.when(F.startswith(whole, F.lit(tagged)), strip(F.substring(whole, F.lit(len(tagged) + 1), F.length(whole))))
        .when(F.startswith(whole, F.lit(FENCE)), strip(F.substring(whole, F.lit(n + 1), F.length(whole))))
        .otherwise(whole)
    )
    return F.when(F.endswith(body, F.lit(FENCE)), strip(F.substring(body, F.lit(1), F.length(body) - n))).otherwise(body)


def json_field(text: Column, field: str) -> Column:
    """A string field of a JSON object, stripped; empty if it is absent; null if the JSON, the object or the type is wrong.

    The text is parsed inside an array that must get one element, so trailing text is an error.
    Duplicate keys and NaN are errors too.
    """
    parsed = F.try_parse_json(F.concat(F.lit("["), text, F.lit("]")))
    one = F.size(F.try_variant_get(parsed, "$", "array<variant>")) == 1
    is_object = F.schema_of_variant(F.try_variant_get(parsed, "$[0]", "variant")).startswith("OBJECT")
    value = F.try_variant_get(parsed, f"$[0].{field}", "variant")
    kind = F.schema_of_variant(value)
    found = F.when(value.isNull(), F.lit("")).when(kind == "STRING", strip(F.try_variant_get(parsed, f"$[0].{field}", "string")))
    return F.when(one & is_object, found)


def truncated(answer: Column) -> Column:
    out = answer
    for marker in STOP_MARKERS:
        out = before(out, marker)
    return strip(out)


def cited(answer: Column) -> Column:
    """The answer with a citation of the first source, if it has none."""
    whole = strip(answer)
    return F.when(F.contains(whole, F.lit(CITATION)), whole).otherwise(F.concat(whole, F.lit(" " + CITATION)))
