"""Leaves of nested records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import ArrayType, DataType, MapType, StructType


def json_leaf(schema: DataType, path: str, root: Column | None = None) -> Column:
    """The value at a dotted path; a list on the way stands for its first element.

    A step the schema does not know gives NULL.
    """
    at = root
    for step in path.split("."):
        if isinstance(schema, ArrayType):
            at, schema = F.get(at, 0), schema.elementType
        if not isinstance(schema, StructType) or step not in schema.fieldNames():
            return F.lit(None).cast("string")
        at = F.col(f"`{step}`") if at is None else at.getField(step)
        schema = schema[step].dataType
    return at


def _as_text(c: Column, kind: DataType) -> Column:
    return F.to_json(c) if isinstance(kind, (StructType, MapType, ArrayType)) else c.cast("string")


def flatten_default(df: DataFrame) -> DataFrame:
    """Lists as comma-separated text, structs as JSON text, other columns unchanged."""
    out = []
    for field in df.schema:
        c = F.col(f"`{field.name}`")
        if isinstance(field.dataType, ArrayType):
            element = field.dataType.elementType
            c = F.array_join(F.transform(c, lambda v: F.coalesce(_as_text(v, element), F.lit("None"))), ", ")
        elif isinstance(field.dataType, (StructType, MapType)):
            c = F.to_json(c)
        out.append(c.alias(field.name))
    return df.select(*out)
