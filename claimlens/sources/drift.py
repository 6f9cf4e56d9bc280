"""S3: documents whose schema is inferred, compared with a contract.

A published document is read with the schema that its content has, at any
depth. ``schema_drift`` lists where that differs from what readers expect:
missing, extra and retyped field paths. ``conform`` gives the document the
expected shape wherever that loses nothing, so that a report with an extra field,
or whole numbers where decimals were, can be read, and one with a missing
or retyped field reads as NULL there.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

DRIFT = "path string, kind string, expected string, found string"

#: types that a reader may take for the expected one: every value of the first is one of the second
_WIDER = {("bigint", "double"), ("int", "double"), ("int", "bigint"), ("smallint", "int"), ("smallint", "bigint"), ("smallint", "double"), ("float", "double"),
          ("date", "string"), ("timestamp", "string")}


def infer_document(spark: SparkSession, path: str) -> DataFrame:
    """A (multi-line) JSON document, or a folder of them, with the schema found in it."""
    return spark.read.option("multiLine", True).option("mode", "FAILFAST").json(path)


def _fits(found: T.DataType, expected: T.DataType) -> bool:
    a, b = found.simpleString(), expected.simpleString()
    return a == b or (a, b) in _WIDER or isinstance(found, T.NullType)


def _drift(found: T.DataType, expected: T.DataType, path: str) -> Iterator[tuple[str, str, str | None, str | None]]:
    if isinstance(found, T.StructType) and isinstance(expected, T.StructType):
        prefix = f"{path}." if path else ""
        for f in expected.fields:
            if f.name not in found.names:
                yield prefix + f.name, "missing", f.dataType.simpleString(), None
            else:
                yield from _drift(found[f.name].dataType, f.dataType, prefix + f.name)
        for f in found.fields:
            if f.name not in expected.names:
                yield prefix + f.name, "extra", None, f.dataType.simpleString()
    elif isinstance(found, T.ArrayType) and isinstance(expected, T.ArrayType):
        yield from _drift(found.elementType, expected.elementType, f"{path}[]")
    elif isinstance(found, T.MapType) and isinstance(expected, T.MapType):
        yield from _drift(found.keyType, expected.keyType, f"{path}{{key}}")
        yield from _drift(found.valueType, expected.valueType, f"{path}{{}}")
    elif not _fits(found, expected):
        yield path, "retyped", expected.simpleString(), found.simpleString()


def schema_drift(spark: SparkSession, found: T.StructType, expected: T.StructType) -> DataFrame:
    """(path, kind, expected, found) for every difference; ``[]`` is an array's
    element. A whole number where a decimal is expected is no difference."""
    return spark.createDataFrame(list(_drift(found, expected, "")), DRIFT)


def _conformed(value: Column, found: T.DataType, expected: T.DataType) -> Column:
    if isinstance(found, T.StructType) and isinstance(expected, T.StructType):
        fields = [(_conformed(value[f.name], found[f.name].dataType, f.dataType) if f.name in found.names else F.lit(None).cast(f.dataType)).alias(f.name) for f in expected.fields]
        return F.when(value.isNotNull(), F.struct(*fields))
    if isinstance(found, T.ArrayType) and isinstance(expected, T.ArrayType):
        return F.transform(value, lambda x: _conformed(x, found.elementType, expected.elementType))
    return value.cast(expected) if _fits(found, expected) else F.lit(None).cast(expected)


def conform(df: DataFrame, expected: T.StructType) -> DataFrame:
    """df in the expected shape: fields in order, extra ones left out, missing
    and retyped ones NULL, narrower numbers widened."""
    return df.select(*[(_conformed(F.col(f"`{f.name}`"), df.schema[f.name].dataType, f.dataType) if f.name in df.columns else F.lit(None).cast(f.dataType)).alias(f.name)
                       for f in expected.fields])


def unnest(df: DataFrame, column: str) -> DataFrame:
    """One row per element of an array column, its structs taken apart at any
    depth into plain columns; nested fields whose name is taken get the name of
    their struct in front. Arrays inside stay as they are."""
    rows = df.select(F.explode(F.col(f"`{column}`")).alias("_e"))

    def leaves(value: Column, kind: T.DataType, name: str) -> Iterator[tuple[str, str, Column]]:
        if isinstance(kind, T.StructType):
            for f in kind.fields:
                for leaf, where, c in leaves(value[f.name], f.dataType, f.name):
                    yield leaf, where or name, c
        else:
            yield name, "", value

    out, taken = [], set()
    for leaf, where, c in leaves(F.col("_e"), rows.schema["_e"].dataType, column):
        label = leaf if leaf not in taken else f"{where}_{leaf}"
        taken.add(label)
        out.append(c.alias(label))
    return rows.select(*out)
