"""Canonical tables of the statistical star and of the service logs."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

VALUE = T.DecimalType(20, 6)
SCORE = T.DecimalType(5, 2)


def _schema(*fields: tuple[str, T.DataType]) -> T.StructType:
    return T.StructType([T.StructField(name, dtype, True) for name, dtype in fields])


METADATA = _schema(
    ("dataset_id", T.StringType()),
    ("dataset_name", T.StringType()),
    ("category", T.StringType()),
    ("priority", T.IntegerType()),
    ("subcategory", T.StringType()),
    ("description", T.StringType()),
    ("frequency", T.StringType()),
    ("unit_of_measure", T.StringType()),
    ("geographic_level", T.StringType()),
    ("territory_codes", T.ArrayType(T.StringType())),
    ("completeness_score", SCORE),
    ("data_quality_score", SCORE),
    ("processing_status", T.StringType()),
    ("source_file_path", T.StringType()),
    ("updated_at", T.TimestampType()),
)

SERIES = _schema(
    ("id", T.LongType()),
    ("dataset_id", T.StringType()),
    ("year", T.IntegerType()),
    ("time_period", T.StringType()),
    ("period_type", T.StringType()),
    ("territory_code", T.StringType()),
    ("territory_name", T.StringType()),
    ("measure_code", T.StringType()),
    ("measure_name", T.StringType()),
)

OBSERVATIONS = _schema(
    ("dataset_row_id", T.LongType()),
    ("dataset_id", T.StringType()),
    ("year", T.IntegerType()),
    ("territory_code", T.StringType()),
    ("obs_value", VALUE),
    ("obs_status", T.StringType()),
    ("obs_conf", T.StringType()),
    ("value_type", T.StringType()),
    ("string_value", T.StringType()),
    ("unit_multiplier", T.IntegerType()),
    ("decimals", T.IntegerType()),
    ("is_estimated", T.BooleanType()),
    ("is_provisional", T.BooleanType()),
    ("confidence_interval_lower", VALUE),
    ("confidence_interval_upper", VALUE),
    ("created_at", T.TimestampType()),
    ("source_row", T.LongType()),
)

RAW_OBSERVATIONS = _schema(
    ("dataset_id", T.StringType()),
    ("record_id", T.LongType()),
    ("ingestion_timestamp", T.TimestampType()),
    ("obs_value", T.StringType()),
    ("time_period", T.StringType()),
    ("additional_attributes", T.MapType(T.StringType(), T.StringType())),
)

REGISTRY = _schema(
    ("dataset_id", T.StringType()),
    ("name", T.StringType()),
    ("category", T.StringType()),
    ("description", T.StringType()),
    ("agency", T.StringType()),
    ("priority", T.IntegerType()),
    ("is_active", T.BooleanType()),
    ("metadata_json", T.StringType()),
    ("quality_score", T.DoubleType()),
    ("record_count", T.LongType()),
    ("created_at", T.TimestampType()),
    ("updated_at", T.TimestampType()),
    ("last_updated", T.TimestampType()),
)

RULES = _schema(
    ("rule_id", T.StringType()),
    ("category", T.StringType()),
    ("keywords", T.ArrayType(T.StringType())),
    ("priority", T.IntegerType()),
    ("is_active", T.BooleanType()),
    ("created_at", T.TimestampType()),
)

AUDIT_LOG = _schema(
    ("id", T.LongType()),
    ("user_id", T.StringType()),
    ("action", T.StringType()),
    ("resource_type", T.StringType()),
    ("resource_id", T.StringType()),
    ("details_json", T.StringType()),
    ("ip_address", T.StringType()),
    ("user_agent", T.StringType()),
    ("success", T.BooleanType()),
    ("error_message", T.StringType()),
    ("execution_time_ms", T.DoubleType()),
    ("timestamp", T.TimestampType()),
)


@dataclass(frozen=True)
class Star:
    """Dataset metadata -> series -> observations (``series.id = observations.dataset_row_id``)."""

    metadata: DataFrame
    series: DataFrame
    observations: DataFrame

    def joined(self) -> DataFrame:
        """Observations with their series and dataset columns (inner joins).

        Series meet their dataset first: then the observations, the largest table, are
        shuffled once, by series, and only series of the chosen datasets meet them.
        """
        described = self.series.join(self.metadata, "dataset_id")
        return Star(self.metadata, described, self.observations).series_observations()

    def series_observations(self) -> DataFrame:
        """Observations with their series. Columns that both have are the series' own."""
        repeated = [c for c in self.observations.columns if c in self.series.columns]
        values = self.observations.drop(*repeated)
        return self.series.join(values, F.col("id") == F.col("dataset_row_id"))
