"""Names shared by every catalog: formats, types, statuses, permissions.

Fixed values: these lists are part of the catalog's data format, so they must
be spelled exactly like this.
"""

from __future__ import annotations

from pyspark.sql import types as T

DATA_SOURCE_FORMATS = (
    "CSV", "CUSTOM", "GEO_JSON", "JDBC", "IMAGE_FOLDER", "DATA_FOLDER",
    "HAR_IMAGE_FOLDER", "HDF5", "HIVE", "JSON", "NPY", "PICKLE", "PARQUET",
    "SAV", "SHAPEFILE", "TAR_IMAGE_FOLDER", "TEXT", "VIDEO_FOLDER",
    "XML_FILE", "UNKNOWN",
)
INITIALIZATION_STATUSES = ("NO_INITIALIZED", "INITIALIZING", "INITIALIZED")
MODEL_TYPES = (
    "KERAS", "MLEAP", "PERFORMANCE_SPARK", "PERFORMANCE_KERAS",
    "SPARK_ML_CLASSIFICATION", "SPARK_ML_REGRESSION",
    "SPARK_MLLIB_CLASSIFICATION", "UNSPECIFIED",
)
DEPLOYMENT_STATUSES = (
    "NOT_DEPLOYED", "ERROR", "EDITING", "SAVED", "RUNNING", "STOPPED",
    "SUSPENDED", "PENDING", "DEPLOYED",
)
STORAGE_TYPES = (
    "MONGODB", "ELASTIC_SEARCH", "HDFS", "HIVE", "HIVE_WAREHOUSE", "KAFKA",
    "LOCAL", "JDBC", "CASSANDRA",
)
LOGICAL_TYPES = (
    "BINARY", "CHARACTER", "DATE", "DATETIME", "DECIMAL", "DOUBLE", "ENUM",
    "FILE", "FLOAT", "INTEGER", "LAT_LONG", "LONG", "TEXT", "TIME",
    "TIMESTAMP", "VECTOR",
)
PERMISSIONS = ("READ", "WRITE", "MANAGE")
TECHNIQUES = ("ENCRYPTION", "GENERALIZATION", "SUPPRESSION", "MASK", "NO_TECHNIQUE")
PRIVACY_TYPES = ("IDENTIFIER", "QUASI_IDENTIFIER", "SENSITIVE", "NON_SENSITIVE")
PRIVACY_RISK_TYPES = ("IDENTIFICATION",)
FOREIGN_KEY_DIRECTIONS = ("FROM", "TO")

# Names a catalog row may use for delimiters that cannot be typed.
NAMED_DELIMITERS = {"{tab}": "\t", "{new_line \\n}": "\n", "{new_line \\r\\n}": "\r\n"}

# Permission levels that allow an action.
READ_LEVELS = PERMISSIONS
WRITE_LEVELS = ("MANAGE", "WRITE")
SHARE_LEVELS = ("MANAGE",)

# Users that see everything: 0 is a service call, 1 the administrator.
SYSTEM_USERS = (0, 1)

PAGE_SIZE = 20
SAMPLE_ROWS = 100
SAMPLE_MAX = 1000
TEXT_ABOVE = 1000
MAX_DIGITS = 38
# Undeclared decimals: as many places as leave room for 64-bit numbers.
DEFAULT_DECIMAL = (38, 18)


def spark_type(logical: str, precision: int | None = None, scale: int | None = None) -> T.DataType:
    """The Spark type that holds a logical type."""
    if logical == "DECIMAL":
        if precision is None and scale is None:
            return T.DecimalType(*DEFAULT_DECIMAL)
        places = min(scale or 0, MAX_DIGITS)
        return T.DecimalType(max(min(precision or MAX_DIGITS, MAX_DIGITS), places), places)
    simple = {
        "BINARY": T.BinaryType(),
        "DATE": T.DateType(),
        "DATETIME": T.TimestampNTZType(),
        "TIMESTAMP": T.TimestampNTZType(),
        "DOUBLE": T.DoubleType(),
        "FLOAT": T.FloatType(),
        "INTEGER": T.IntegerType(),
        "LONG": T.LongType(),
        "VECTOR": T.ArrayType(T.StringType()),
        "LAT_LONG": T.StructType([
            T.StructField("lat", T.DoubleType()),
            T.StructField("lon", T.DoubleType()),
        ]),
    }
    if logical in simple:
        return simple[logical]
    if logical in LOGICAL_TYPES:
        return T.StringType()
    raise ValueError(f"Unknown logical type: {logical}")
