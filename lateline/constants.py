"""Thresholds, code tables, key lists and formats the results depend on."""

# --- fixed values -----------------------------------------------------------

TIME_ZONE = "Europe/Warsaw"

# Delay limits in seconds, both ends included.
SANE_MIN = -3600
SANE_MAX = 7200
ON_TIME_MIN = -30
ON_TIME_MAX = 60

# Feature windows.
WINDOW_MINUTES = 15
HEADWAY_WINDOW_MINUTES = 60
MIN_TRIPS_FOR_HEADWAY = 3
SEQUENCE_LENGTH = 8
TRAIN_SHARE = 0.7
VALIDATION_SHARE = 0.2
MIN_SEQUENCES = 10
ALARM_PERCENTILE = 99.5

FEATURES = ["d", "w", "dmax", "n", "p", "delta_d", "r", "h",
            "sin_hour", "cos_hour", "workday"]

# Fact statuses.
OBSERVED = "OBSERVED"
SKIPPED = "SKIPPED"
CANCELED = "CANCELED"

# Feed enumerations (trip and stop schedule_relationship).
TRIP_CANCELED = "CANCELED"
STOP_SKIPPED = "SKIPPED"

# Run statuses and the length error texts are cut to.
RUN_OK = "OK"
RUN_SKIPPED = "SKIPPED"
RUN_ERROR = "ERROR"
ERROR_TEXT_LENGTH = 500

# Day types: what a date without an active service gets, and how working days begin.
NO_SCHEDULE = "no schedule"
WORKDAY_PREFIX = "dni robocze"
FIRST_HOLIDAY_SERVICE = 9
LOOKBACK_DAYS = 35
HORIZON_DAYS = 14

TRANSPORT_MODES = {"0": "tram", "3": "bus", "11": "trolleybus"}
OTHER_MODE = "other"
DEFAULT_LINE_TYPE = "Normalna"
DEFAULT_STOP_TYPE = "Standardowy"

DAY_NAMES = ["poniedziałek", "wtorek", "środa", "czwartek",
             "piątek", "sobota", "niedziela"]
WEEKDAYS = ["monday", "tuesday", "wednesday", "thursday",
            "friday", "saturday", "sunday"]

# schedule_ZTM_<year>.<month>.<day>_<sequence>_<suffix>.zip
PACKAGE_NAME = r"^schedule_ZTM_(\d{4})\.(\d{2})\.(\d{2})_(\d+)_(\d+)\.zip"

PACKAGE_TABLES = [
    "agency", "routes", "routes_ext", "stops", "stops_ext",
    "stops_attributes_ext", "communities_ext", "trips", "trips_ext",
    "stop_times", "calendar", "calendar_dates", "service_ext",
    "operators_ext", "feed_info",
]

# Business keys per package table; feed_info has none (the first package's record counts).
BUSINESS_KEYS = {
    "agency": ["agency_id"],
    "routes": ["route_id"],
    "routes_ext": ["route_id"],
    "stops": ["stop_id"],
    "stops_ext": ["stop_id"],
    "stops_attributes_ext": ["stop_type_id"],
    "communities_ext": ["community_id"],
    "trips": ["trip_id"],
    "trips_ext": ["trip_id"],
    "stop_times": ["trip_id", "stop_id", "stop_sequence"],
    "calendar": ["service_id", "start_date", "end_date",
                 "monday", "tuesday", "wednesday", "thursday",
                 "friday", "saturday", "sunday"],
    "calendar_dates": ["service_id", "date", "exception_type"],
    "service_ext": ["service_id", "name"],
    "operators_ext": ["operator_id"],
}

# Federation clients and the operators each one holds.
CLIENTS = {
    "pkm_katowice": ["6"],
    "pkm_sosnowiec": ["7"],
    "tramwaje_slaskie": ["5"],
    "pkm_gliwice": ["8"],
    "pkm_swierklaniec": ["11"],
    "pkm_tychy": ["44"],
    "trolejbusy_tychy": ["45"],
    "prywatni_zachod": ["9", "10", "41", "52", "54", "56", "57", "58"],
    "prywatni_centrum_wschod": ["4", "24", "53", "55", "61", "63"],
}
MIN_CLIENTS = 6
MAX_CLIENTS = 10

# Retention and refresh windows.
FACT_RETENTION_HOURS = 48
STOP_ROLLUP_RETENTION_DAYS = 14
ROLLUP_DEFINITION_VERSION = 2
REFRESH_15MIN = ("6 hours", "10 minutes")
REFRESH_1H = ("14 days", "30 minutes")
REFRESH_DAY = ("60 days", "2 hours")
LATE_LIMIT = "6 hours"

# Audit limits.
GAP_MINUTES = 2.0
SILENCE_MINUTES = 5.0
LARGEST_GAPS = 10

# --- end of fixed values ----------------------------------------------------
