"""Schemas of the stored tables, as DDL."""

SCHEDULE_GRID = "source_id string, year string, row_idx int, slot string, team string, Jan string, Feb string, Mar string, Apr string, May string, Jun string, Jul string, Aug string, Sep string, Oct string, Nov string, Dec string"
SERVICE_RECORDS = "service_date date, visitors int, year int, month int, slot string, team string"
ATTENDANCE = "location_id string, service_date date, visitors int, updated_at timestamp"
WEATHER_HOURLY = "location_id string, time timestamp_ntz, temperature_2m double, apparent_temperature double, relative_humidity_2m double, wind_speed_10m double, precipitation double"
WEATHER_DAILY = "location_id string, date date, temp_10_13 double, apparent_temp_10_13 double, humidity_10_13 double, wind_10_13 double, precip_10_13 double"
BACKTEST = "location_id string, segment string, service_date date, fold int, train_rows int, actual double, pred double, pred_q double, abs_error double, is_sun int, error_message string"
MODEL_PACK = "location_id string, segment string, feature_cols array<string>, point_model binary, quantile_model binary, status string, error_message string"
LOCATIONS = "id string, name string, zip_code string, country_code string, timezone string"
