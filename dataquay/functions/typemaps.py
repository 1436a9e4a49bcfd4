"""Type names of other systems, and Spark schemas, as logical types."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Type names that keep their name, and those that change it.
SAME_NAME = ("DECIMAL", "FLOAT", "DOUBLE", "DATE", "TIME", "DATETIME", "LONG", "TIMESTAMP")
MYSQL_NAMES = {
    "TINY": "INTEGER", "SHORT": "INTEGER", "INT24": "INTEGER", "YEAR": "INTEGER",
    "BIT": "INTEGER", "LONGLONG": "LONG", "NEWDATE": "DATETIME", "NEWDECIMAL": "DECIMAL",
}
HIVE_NAMES = {
    "TINYINT": "INTEGER", "SMALLINT": "INTEGER", "INT": "INTEGER", "INTEGER": "INTEGER",
    "BOOLEAN": "INTEGER", "BIGINT": "LONG",
}


def _mapped(name: Column, names: dict[str, str]) -> Column:
    groups: dict[str, list[str]] = {}
    for source, logical in names.items():
        groups.setdefault(logical, []).append(source)
    result = F.when(name.isin(*SAME_NAME), name)
    for logical, sources in groups.items():
        result = result.when(name.isin(*sources), logical)
    return result.otherwise("CHARACTER")


def mysql_type(name: Column) -> Column:
    """Logical type of a MySQL column type; unknown names are CHARACTER."""
    return _mapped(name, MYSQL_NAMES)


def hive_type(name: Column) -> Column:
    """Logical type of a Hive column type; the ``_TYPE`` suffix does not count."""
    return _mapped(F.upper(F.replace(name, F.lit("_TYPE"), F.lit(""))), HIVE_NAMES)


def logical_type(dtype: T.DataType) -> str:
    """Logical type of a Spark type; types without one are an error."""
    if isinstance(dtype, (T.CharType, T.VarcharType)):
        return "CHARACTER"
    names = {
        T.StringType: "CHARACTER",
        T.BooleanType: "INTEGER",
        T.ByteType: "INTEGER",
        T.ShortType: "INTEGER",
        T.IntegerType: "INTEGER",
        T.LongType: "LONG",
        T.DoubleType: "DOUBLE",
        T.FloatType: "FLOAT",
        T.TimestampType: "DATETIME",
        T.TimestampNTZType: "DATETIME",
        T.DateType: "DATE",
        T.BinaryType: "BINARY",
        T.DecimalType: "DECIMAL",
        T.ArrayType: "VECTOR",
    }
    try:
        return names[type(dtype)]
    except KeyError:
        raise ValueError(f"Unsupported data type: {dtype.simpleString()}") from None


ATTRIBUTE_SCHEMA = T.StructType([
    T.StructField("position", T.IntegerType(), False),
    T.StructField("name", T.StringType(), False),
    T.StructField("type", T.StringType(), False),
    T.StructField("precision", T.IntegerType()),
    T.StructField("scale", T.IntegerType()),
])


def schema_attributes(spark: SparkSession, schema: T.StructType) -> DataFrame:
    """The attribute rows of a Spark schema, one per column."""
    rows = []
    for i, field in enumerate(schema.fields):
        decimal = isinstance(field.dataType, T.DecimalType)
        precision, scale = (field.dataType.precision, field.dataType.scale) if decimal else (None, None)
        rows.append((i, field.name, logical_type(field.dataType), precision, scale))
    return spark.createDataFrame(rows, ATTRIBUTE_SCHEMA)
