"""Values of text tables as typed columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def typed(value: Column, kind: str | None, strict: bool = False) -> Column:
    """Blank strings and enums are null, otherwise untrimmed; numbers that aren't numbers are null, or
    an error if strict (a blank double never is); booleans are true, false or null; other kinds stay text."""
    blank = F.coalesce(value, F.lit("")) == ""
    if kind in ("string", "enum"):
        return F.when(~blank, value)
    if kind == "double":
        return F.when(~(blank | value.isin("null", "Null")), value.cast("double") if strict else value.try_cast("double"))
    if kind in ("long", "int"):
        return value.cast("long") if strict else F.when(~blank, value.try_cast("long"))
    if kind == "boolean":
        return F.when(F.lower(value) == "true", True).when(F.lower(value) == "false", False)
    return value


def array_parse(value: Column) -> Column:
    """``[a,b]`` as an array: brackets and quotes go at the ends only; what is inside stays as it is."""
    return F.when(value.startswith("[") & value.endswith("]"), F.split(F.regexp_replace(value, r"^[\[\]']+|[\[\]']+$", ""), ","))


def array_elements(value: Column) -> Column:
    """The clean form: elements trimmed of blanks and quotes."""
    return F.transform(array_parse(value), lambda x: F.regexp_replace(x, r"^[\s'\"]+|[\s'\"]+$", ""))


def default_fill(payload: Column, field: str, kind: str, default: object) -> Column:
    """The field of a variant: the default where the key is absent, null where it is null."""
    found = F.variant_get(payload, f"$['{field}']", "variant")
    return F.when(found.isNull(), F.lit(default).cast(kind)).otherwise(F.try_variant_get(payload, f"$['{field}']", kind))
