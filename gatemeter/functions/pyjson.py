"""JSON text as the gateway's Python writes it: keys in their order, ``", "`` and ``": "``, ASCII escapes.

A parsed VARIANT sorts the keys of its objects and drops number spellings, so
text that must be kept is cut out as raw JSON (string-typed fields of a
``from_json`` schema keep it) and composed with the builders below;
:func:`python_json` then gives it the serialiser's form, one Arrow batch at a time.
"""

from __future__ import annotations

import json

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def json_text(value: Column) -> Column:
    """JSON text of a string, number, boolean or struct; ``null`` for null."""
    listed = F.to_json(F.array(value), {"ignoreNullFields": "false"})
    return F.substr(listed, F.lit(2), F.char_length(listed) - 2)


def python_string(value: Column) -> Column:
    """A string as Python's serialiser writes it, without leaving the JVM; ``null`` for null.

    Most strings need nothing; in the others every character but printable ASCII is escaped one by one.
    """
    named = {'"': '\\"', "\\": "\\\\", "\n": "\\n", "\r": "\\r", "\t": "\\t", "\b": "\\b", "\f": "\\f"}

    def escaped(c: Column) -> Column:
        units = F.regexp_replace(F.lower(F.hex(F.encode(c, "UTF-16BE"))), "(.{4})", r"\\u$1")
        out = F.when(c.rlike('^[ !#-\\[\\]-~]\\z'), c)
        for char, text in named.items():
            out = out.when(c == char, F.lit(text))
        return out.otherwise(units)

    plain = value.rlike('^[ !#-\\[\\]-~]*\\z')
    chars = F.regexp_extract_all(value, F.lit("(?s)."), 0)
    text = F.when(plain, value).otherwise(F.array_join(F.transform(chars, escaped), ""))
    return F.when(value.isNull(), F.lit("null")).otherwise(F.concat(F.lit('"'), text, F.lit('"')))


def json_object(**fields: Column) -> Column:
    """An object of raw JSON texts; a field whose text is null is left out."""
    parts = [F.concat(F.lit(f'"{k}":'), v) for k, v in fields.items()]
    return F.concat(F.lit("{"), F.concat_ws(",", *parts), F.lit("}"))


def json_list(items: Column) -> Column:
    """A list of raw JSON texts."""
    return F.concat(F.lit("["), F.array_join(items, ","), F.lit("]"))


def _dumps(text: str | None) -> str | None:
    if text is None:
        return None
    try:
        return json.dumps(json.loads(text))
    except ValueError:
        return None


@F.pandas_udf(T.StringType())
def python_json(text: pd.Series) -> pd.Series:
    """The text parsed and written by Python's serialiser; null when it is not JSON."""
    return text.map(_dumps)


@F.arrow_udf(T.ArrayType(T.ArrayType(T.StringType())))
def python_json_lists(texts: pa.Array, row: pa.Array) -> pa.Array:
    """:func:`python_json` of every text of a list of lists.

    ``row`` is the text that the lists were cut from.  It is not read: with it a
    batch, bounded by its bytes, weighs what the rows do that wait for the answer.
    """
    kind = pa.list_(pa.list_(pa.string()))
    if texts.null_count == len(texts):
        return pa.nulls(len(texts), kind)
    return pa.array([None if lists is None else [
        None if inner is None else [_dumps(t) for t in inner] for inner in lists] for lists in texts.to_pylist()], kind)
