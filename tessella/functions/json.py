"""Access to JSON text by simple paths: ``$``, ``.key`` and ``[n]``."""

from __future__ import annotations

import json
import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from tessella.errors import GeneralError

_STEP = re.compile(r"\.([^.\[\]*'\"]+)|\[(\d+)\]")


def check_path(path: str) -> str:
    """The path in a form that Spark reads alike; anything else than keys and indexes is refused."""
    if not path.startswith("$"):
        raise GeneralError(f"JSON path must begin with '$': {path!r}")
    at, out = 1, "$"
    while at < len(path):
        step = _STEP.match(path, at)
        if step is None:
            raise GeneralError(f"malformed JSON path {path!r}")
        out += f"['{step[1]}']" if step[1] is not None else f"[{step[2]}]"
        at = step.end()
    return out


def valid(text: str) -> bool:
    """Is a text JSON?"""
    try:
        json.loads(text)
    except (ValueError, TypeError):
        return False
    return True


def _variant(doc: Column, path: str) -> Column:
    return F.try_variant_get(F.try_parse_json(doc), check_path(path), "variant")


def kind(doc: Column, path: str = "$") -> Column:
    """null, true, false, integer, real, text, array or object; NULL where the path leads nowhere."""
    node = _variant(doc, path)
    shape = F.schema_of_variant(node)
    plain = F.when(shape == "BOOLEAN", F.when(F.try_variant_get(node, "$", "boolean"), "true").otherwise("false"))
    plain = plain.when(shape.isin("TINYINT", "SMALLINT", "INT", "BIGINT"), "integer").when(shape == "STRING", "text")
    plain = plain.when(shape.startswith("ARRAY"), "array").when(shape.startswith("OBJECT"), "object").otherwise("real")  # whole numbers beyond 64 bits too
    return F.when(node.isNull(), F.lit(None).cast("string")).when(F.is_variant_null(node), "null").otherwise(plain)


def extract(doc: Column, path: str = "$") -> Column:
    """The node's text: scalars plain, objects and arrays as JSON; NULL for JSON null or where the path leads nowhere."""
    node = _variant(doc, path)
    shape = F.schema_of_variant(node)
    scalar = F.try_variant_get(node, "$", "string")
    whole = shape.startswith("ARRAY") | shape.startswith("OBJECT")
    text = F.when(whole, F.get_json_object(doc, check_path(path)))
    # a number that is whole but written as real keeps a plain form, like other text of reals
    return F.when(node.isNull() | F.is_variant_null(node), F.lit(None).cast("string")).otherwise(F.coalesce(text, scalar))


def array_length(doc: Column, path: str = "$") -> Column:
    """Elements of an array; an error for any other node, NULL where the path leads nowhere."""
    node = _variant(doc, path)
    is_array = F.schema_of_variant(node).startswith("ARRAY")
    wrong = F.raise_error(F.lit("json_array_length: not an array")).cast("bigint")
    return F.when(node.isNull(), F.lit(None).cast("bigint")).when(is_array, F.json_array_length(F.get_json_object(doc, check_path(path))).cast("bigint")).otherwise(wrong)


def object_keys(doc: Column, path: str = "$") -> Column:
    """Keys of an object, in order, as the text of a JSON array; an error for any other node."""
    node = _variant(doc, path)
    is_object = F.schema_of_variant(node).startswith("OBJECT")
    wrong = F.raise_error(F.lit("json_object_keys: not an object")).cast("string")
    return F.when(node.isNull(), F.lit(None).cast("string")).when(is_object, F.to_json(F.json_object_keys(F.get_json_object(doc, check_path(path))))).otherwise(wrong)
