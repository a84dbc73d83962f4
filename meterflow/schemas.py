"""Schemas at the boundaries, and the fixed names of the domain."""

from __future__ import annotations

from pyspark.sql import types as T

# Fuel codes of the source and their column names.
FUELS = {
    "NG": "natural_gas", "SUN": "solar", "WAT": "hydro", "WND": "wind", "OTH": "other", "COL": "coal", "NUC": "nuclear", "OIL": "oil",
}
RENEWABLE = ("solar", "wind", "hydro", "geothermal", "biomass", "small_hydro")
GOOD_SHARES = {"wind": "WIND", "solar": "SOLAR", "geothermal": "GEOTHERMAL", "biomass": "BIOMASS", "biogas": "BIOGAS", "small_hydro": "SMALL HYDRO"}

_s, _d, _ts = T.StringType(), T.DoubleType(), T.TimestampNTZType()


def struct(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(k, v, True) for k, v in fields.items()])


#: One record of the raw envelope. Every field is text; values are parsed with try_cast.
RECORD = T.StructType(
    [T.StructField(k, _s, True) for k in ("period", "respondent", "respondent-name", "type", "type-name", "fueltype", "value", "value-units")]
)
ENVELOPE = T.StructType(
    [
        T.StructField(
            "metadata",
            struct(
                timestamp=_s, source=_s, api_endpoint=_s, region=_s, data_type=_s, start_date=_s, end_date=_s, request_params=T.MapType(_s, _s),
                response_size_bytes=T.LongType(), record_count=T.LongType(), success=T.BooleanType(), error_message=_s,
            ),
        ),
        T.StructField("api_response", struct(response=struct(total=_s, dateFormat=_s, frequency=_s, data=T.ArrayType(RECORD)), error=_s, code=_s)),
        T.StructField("_corrupt_record", _s, True),
    ]
)
UNIFIED = struct(timestamp=_ts, region=_s, data_type=_s, fuel_type=_s, type_name=_s, value=_d, value_units=_s, source_file=_s)
OTHER_SOURCE = struct(timestamp=_ts, region=_s, data_type=_s, value=_d, value_units=_s, source_file=_s)
HARMONIZED = struct(timestamp=_ts, region=_s, data_source=_s, value=_d, unit=_s, data_type=_s)
SYNTHETIC = struct(datetime=_ts, demand_mw=_d, solar_generation_mw=_d, wind_generation_mw=_d, temperature_c=_d, price_usd_per_mwh=_d, grid_stability=_d)
DATASET = struct(name=_s, source=_s, region=_s, data_type=_s, layer=_s, path=_s, row_count=T.LongType(), start_date=_ts, end_date=_ts, saved_at=_ts)
