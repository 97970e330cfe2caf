"""The two tables of a code-property graph."""

from pyspark.sql.types import ArrayType, BooleanType, DoubleType, IntegerType, StringType, StructField, StructType

NODES = StructType(
    [
        StructField("id", StringType(), False),
        StructField("parent", StringType()),
        StructField("type", StringType(), False),
        StructField("name", StringType(), False),
        StructField("file", StringType()),
        StructField("is_static", BooleanType()),
        StructField("is_abstract", BooleanType()),
        StructField("return_type", StringType()),
        StructField("visibility", StringType()),
        StructField("scope", StringType()),
        StructField("data_type", StringType()),
        StructField("start_row", IntegerType()),
        StructField("start_column", IntegerType()),
        StructField("end_row", IntegerType()),
        StructField("end_column", IntegerType()),
        StructField("keywords", ArrayType(StringType())),
        StructField("description", StringType()),
    ]
)
EDGES = StructType(
    [
        StructField("id", StringType(), False),
        StructField("from_id", StringType(), False),
        StructField("to_id", StringType(), False),
        StructField("type", StringType(), False),
        StructField("call_type", StringType()),
        StructField("via", StringType()),
        StructField("argument_index", IntegerType()),
        StructField("confidence", DoubleType()),
        StructField("reason", StringType()),
    ]
)
FAILURES = StructType([StructField("file", StringType()), StructField("reason", StringType()), StructField("detail", StringType())])
