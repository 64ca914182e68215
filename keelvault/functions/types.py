"""SQL type names: which Spark type they mean, and to which family of ghost values they belong."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DataType, MapType, StringType, StructField, StructType, VariantType

#: Names of other databases' types and the Spark type each stands for.
SPARK_TYPES = {
    "VARCHAR": "string", "VARCHAR2": "string", "NVARCHAR": "string", "CHAR": "string", "NCHAR": "string", "TEXT": "string", "STRING": "string",
    "NUMBER": "decimal(38,0)", "NUMERIC": "decimal(38,0)", "DECIMAL": "decimal(38,0)",
    "INT": "int", "INTEGER": "int", "BIGINT": "bigint", "SMALLINT": "smallint", "TINYINT": "tinyint", "BYTEINT": "tinyint",
    "FLOAT": "double", "DOUBLE": "double", "DOUBLE PRECISION": "double", "REAL": "float",
    "BOOLEAN": "boolean", "BOOL": "boolean", "DATE": "date", "BINARY": "binary", "VARBINARY": "binary",
    "TIMESTAMP": "timestamp", "TIMESTAMP_TZ": "timestamp", "TIMESTAMP_LTZ": "timestamp", "TIMESTAMPTZ": "timestamp",
    "TIMESTAMP_NTZ": "timestamp_ntz", "DATETIME": "timestamp_ntz", "DATETIME2": "timestamp_ntz",
}
#: Words in a type's name that put it into a family; they are looked for anywhere in the name, so CHAR also
#: stands for longer names that hold it, and INT likewise.
STRING_WORDS = ("CHAR", "TEXT", "STRING")
NUMBER_WORDS = ("INT", "FLOAT", "DOUBLE", "DECIMAL", "NUMERIC", "NUMBER", "REAL")
TIME_WORDS = ("TIMESTAMP", "DATETIME")


def spark_type(name: str) -> str:
    """The Spark type of a SQL type name; string for one that nobody knows."""
    bare, _, rest = name.strip().upper().partition("(")
    bare = bare.strip()
    if rest and SPARK_TYPES.get(bare) == "decimal(38,0)" and (m := re.fullmatch(r"\s*(\d+)\s*(?:,\s*(\d+)\s*)?\)", rest)):
        return f"decimal({m[1]},{m[2] or 0})"
    if bare in SPARK_TYPES:
        return SPARK_TYPES[bare]
    try:
        return DataType.fromDDL(name).simpleString()
    except Exception:  # the parser's errors have no common type
        return StringType().simpleString()


def family(name: str) -> str:
    """time, date, string, number, boolean or other; a substring decides, so INTERVAL and POINT are numbers."""
    upper = name.strip().upper()
    if any(w in upper for w in TIME_WORDS):
        return "time"
    if upper == "DATE":
        return "date"
    if any(w in upper for w in STRING_WORDS):
        return "string"
    if any(w in upper for w in NUMBER_WORDS):
        return "number"
    return "boolean" if upper == "BOOLEAN" else "other"


def _has_order(kind: DataType) -> bool:
    if isinstance(kind, StructType):
        return all(_has_order(f.dataType) for f in kind.fields)
    return _has_order(kind.elementType) if isinstance(kind, ArrayType) else not isinstance(kind, (MapType, VariantType))


def sortable(field: StructField) -> Column:
    """The column, or its JSON where its type (a map, or what holds one) has no order."""
    column = F.col(f"`{field.name.replace('`', '``')}`")
    return column if _has_order(field.dataType) else F.to_json(F.struct(column))
