"""Canonical names and types of log rows, and the one renaming at the scan."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

ERROR_LEVELS = ("ERROR", "FATAL")

LOG = T.StructType(
    [T.StructField("_id", T.StringType()), T.StructField("ts", T.TimestampType()), T.StructField("message", T.StringType()), T.StructField("log_level", T.StringType()), T.StructField("service_name", T.StringType())]
)
#: The processed table: what ingest adds to a log row.
PROCESSED = T.StructType(
    LOG.fields
    + [T.StructField(n, T.StringType()) for n in ("extracted_timestamp", "stack_trace", "cleaned_message", "exception_type", "exception_class", "exception_message", "template")]
    + [T.StructField(n, T.IntegerType()) for n in ("template_id", "prediction", "cluster_id")]
)
VECTOR = T.StructType([T.StructField("id", T.StringType()), T.StructField("vector", T.ArrayType(T.FloatType())), T.StructField("metadata", T.MapType(T.StringType(), T.StringType()))])


@dataclass(frozen=True)
class FieldMap:
    """Physical names of the four logical columns."""

    timestamp: str = "@timestamp"
    message: str = "message"
    level: str = "log_level"
    service: str = "service_name"

    def canonical(self, df: DataFrame) -> DataFrame:
        """df with canonical names; columns that are missing stay missing. A timestamp is taken as UTC."""
        names = {self.timestamp: "ts", self.message: "message", self.level: "log_level", self.service: "service_name"}
        df = df.withColumnsRenamed({a: b for a, b in names.items() if a in df.columns})
        return df.withColumn("ts", F.to_timestamp("ts")) if "ts" in df.columns else df

    def physical(self, df: DataFrame) -> DataFrame:
        names = {"ts": self.timestamp, "message": self.message, "log_level": self.level, "service_name": self.service}
        return df.withColumnsRenamed({a: b for a, b in names.items() if a in df.columns})
