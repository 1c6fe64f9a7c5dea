"""JSON payload columns: scalars, JSON text, strict strings, repair, embeddings."""

from __future__ import annotations

import pyarrow as pa
import voxcart
from pyspark import cloudpickle
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.util import PythonEvalType

from voxcart.functions.repair import repair_json
from voxcart.functions.text import trim_set, trim_space

# Send the task code along with the task, so executors need no installed package.
cloudpickle.register_pickle_by_value(voxcart)


def node(text: Column, path: str) -> Column:
    """The node at ``path`` as a variant; NULL for bad JSON or a missing node."""
    return F.try_variant_get(F.try_parse_json(text), path, "variant")


def is_container(document: Column, path: str) -> Column:
    """True if the node at ``path`` of a variant is an object or an array."""
    return (
        F.try_variant_get(document, path, "array<variant>").isNotNull()
        | F.try_variant_get(document, path, "map<string,variant>").isNotNull()
    )


def unless_container(found: Column, document: Column, path: str) -> Column:
    """``found``, the text at ``path``, or NULL if that node is no scalar.

    Only text that looks like a container is checked against the variant, which
    tells a real array from a string such as ``"[1]"``.
    """
    suspect = F.left(found, F.lit(1)).isin("[", "{")
    return F.when(~(suspect & is_container(document, path)), found)


def scalar(text: Column, path: str) -> Column:
    """Scalar at ``path`` as text, numbers as written; NULL for other nodes."""
    return unless_container(F.get_json_object(text, path), F.try_parse_json(text), path)


def json_text(text: Column, path: str) -> Column:
    """JSON text of the node at ``path``: strings keep their quotes."""
    return F.to_json(node(text, path))


def strict_string(document: Column, path: str) -> Column:
    """Value at ``path`` of a variant if it is a JSON string, else NULL."""
    found = F.try_variant_get(document, path, "variant")
    return F.when(
        F.schema_of_variant(found) == F.lit("STRING"),
        F.try_variant_get(document, path, "string"),
    )


def _repair(texts: pa.Array) -> pa.Array:
    return pa.array([repair_json(text) for text in texts.to_pylist()], pa.string())


def repaired(text: Column) -> Column:
    """Model output as a variant, whatever damage ``functions.repair`` knows.

    Whole JSON, and an object with text or a code fence around it, is read where it is; only
    what is damaged goes through the automaton, one text at a time.
    """
    whole = F.try_parse_json(trim_space(text))
    inside = F.try_parse_json(F.regexp_extract(text, r"(?s)(\{.*\})", 1))
    fix = F.arrow_udf(_repair, "string", PythonEvalType.SQL_SCALAR_ARROW_UDF)
    damaged = F.when(whole.isNull() & inside.isNull(), text)
    return F.coalesce(whole, inside, F.try_parse_json(fix(damaged)))


def unwrap(document: Column) -> Column:
    """Variant payload that may be JSON inside a JSON string: parse the inside."""
    inner = F.try_variant_get(document, "$", "string")
    is_text = F.to_json(document).startswith('"')
    return F.when(is_text, F.try_parse_json(inner)).otherwise(document)


def flat_vector_text(text: Column) -> Column:
    """``[[1, 2]]``, ``[1, 2]`` and ``1, 2`` all become ``[1, 2]``; NULL stays NULL."""
    return F.concat(F.lit("["), trim_set(text, "[]"), F.lit("]"))


def vector(text: Column) -> Column:
    """Embedding text in any of those forms as ``array<double>``."""
    return F.from_json(flat_vector_text(text), "array<double>")
