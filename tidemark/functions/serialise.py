"""Values as they leave the system."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def to_plain(df: DataFrame) -> DataFrame:
    """Dates and times as ISO text and decimals as double, in one closing projection."""
    columns = []
    for field in df.schema.fields:
        column = F.col(f"`{field.name}`")
        if isinstance(field.dataType, T.DateType):
            column = F.date_format(column, "yyyy-MM-dd")
        elif isinstance(field.dataType, T.TimestampType | T.TimestampNTZType):
            whole = F.date_format(column, "yyyy-MM-dd'T'HH:mm:ss")
            parts = F.date_format(column, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")
            column = F.when(F.date_format(column, "SSSSSS") == "000000", whole).otherwise(parts)
        elif isinstance(field.dataType, T.DecimalType):
            column = column.cast("double")
        columns.append(column.alias(field.name))
    return df.select(*columns)
