"""Fixed values of the attendance domain."""

# Fixed values
OBSERVATION_HOURS = (10, 13)
BASELINE_MEALS = 150
WASTE_REDUCTION_RATE = 0.10
MEAL_WEIGHT_KG = 0.45
CO2E_PER_KG = 3.8
DEFAULT_MEAL_BUFFER = 0.08
QUANTILE = 0.8
MIN_TRAIN_ROWS = 18
MONTHS = ("Jan", "Feb", "Mar", "Apr", "May", "Jun", "Jul", "Aug", "Sep", "Oct", "Nov", "Dec")
DEFAULT_COUNTRY = "US"
DEFAULT_TIMEZONE = "America/New_York"

CALENDAR_FEATURES = ("year_num", "month_num", "day_num", "weekday_num", "weekofyear", "is_weekend", "month_sin", "month_cos", "slot_num", "is_sun")
LAG_FEATURES = (
    "lag1", "lag2", "lag3", "rolling_mean_3", "rolling_std_3",
    "lag_same_daytype_1", "rolling_mean_daytype_3", "rolling_std_daytype_3",
    "lag_same_slot_1", "rolling_mean_slot_3", "rolling_std_slot_3",
)
WEATHER_FEATURES = ("temp_10_13", "apparent_temp_10_13", "humidity_10_13", "wind_10_13", "precip_10_13")


def feature_names(with_weather: bool) -> list[str]:
    return [*CALENDAR_FEATURES, *LAG_FEATURES, *(WEATHER_FEATURES if with_weather else ())]
