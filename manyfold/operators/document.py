"""JSON documents held as text: typed lookup and containment, in the JVM."""

from __future__ import annotations

import json
from collections.abc import Callable
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F


def _path(path: tuple[str, ...]) -> str:
    return "$" + "".join("['" + p.replace("'", "\\'") + "']" for p in path)


def lookup(doc: Column, path: tuple[str, ...], kind: str) -> Column:
    """The scalar at a path of object keys as kind (bool, int, float, text); null where there is none, or it is an
    object, an array, or a scalar of another kind (numbers of both kinds go together)."""
    raw = F.get_json_object(doc, _path(path))
    variant = F.try_parse_json(doc)
    name = F.upper(F.schema_of_variant(F.try_variant_get(variant, _path(path), "variant")))
    if kind == "text":
        return F.when(name == "STRING", raw)
    if kind == "bool":
        return F.when(name == "BOOLEAN", raw == "true")
    number = name.rlike("^(BIGINT|DOUBLE|FLOAT|DECIMAL.*)$")
    return F.when(number, raw.try_cast("double") if kind == "float" else raw.try_cast("long"))


def contains(doc: Column, wanted: Any) -> Column:
    """Whether a document has all of wanted: objects by key, arrays each element in some element, 1 = 1.0. The literal
    is compiled to conditions on the parsed document; without a document: false."""
    return F.coalesce(_has(F.try_parse_json(doc), wanted, 0), F.lit(False))


def _has(v: Column, wanted: Any, depth: int) -> Column:
    kind = F.upper(F.schema_of_variant(v))
    if isinstance(wanted, dict):
        out = kind.startswith("OBJECT")
        for key, inner in wanted.items():
            out = out & F.coalesce(_has(F.try_variant_get(v, _path((key,)), "variant"), inner, depth + 1), F.lit(False))
        return out
    if isinstance(wanted, list):
        items = F.try_variant_get(v, "$", "array<variant>")
        out = kind.startswith("ARRAY")
        for inner in wanted:
            out = out & F.coalesce(F.exists(items, _element_has(inner, depth + 1)), F.lit(False))
        return out
    if wanted is None:
        return kind == "VOID"
    if isinstance(wanted, bool):
        return (kind == "BOOLEAN") & (F.try_variant_get(v, "$", "boolean") == wanted)
    if isinstance(wanted, (int, float)):
        return kind.rlike("^(BIGINT|DOUBLE|FLOAT|DECIMAL.*)$") & (F.try_variant_get(v, "$", "double") == float(wanted))
    return (kind == "STRING") & (F.try_variant_get(v, "$", "string") == str(wanted))


def _element_has(wanted: Any, depth: int) -> Callable[[Column], Column]:
    return lambda x: F.coalesce(_has(x, wanted, depth), F.lit(False))


def parsed(text: str) -> Any:
    return json.loads(text)
