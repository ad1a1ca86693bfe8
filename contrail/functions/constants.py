"""Fixed values that must equal the reference application's for matching output.

They are stated plainly, in their natural order.
"""

# --- fixed values: carrier code -> carrier name (21 pairs) -------------------
CARRIER_NAMES = {
    "AA": "American Airlines",
    "AS": "Alaska Airlines",
    "B6": "JetBlue Airways",
    "C5": "CommutAir",
    "DL": "Delta Air Lines",
    "F9": "Frontier Airlines",
    "G4": "Allegiant Air",
    "G7": "GoJet Airlines",
    "HA": "Hawaiian Airlines",
    "MQ": "Envoy Air",
    "NK": "Spirit Airlines",
    "OH": "PSA Airlines",
    "OO": "SkyWest Airlines",
    "PT": "Piedmont Airlines",
    "QX": "Horizon Air",
    "UA": "United Airlines",
    "WN": "Southwest Airlines",
    "YV": "Mesa Airlines",
    "YX": "Republic Airways",
    "ZW": "Air Wisconsin",
    "9E": "Endeavor Air",
}

# --- fixed values: airlines reference table seed (8 rows, insert-if-absent) ---
SEED_AIRLINES = [
    ("AA", "American Airlines"),
    ("DL", "Delta Air Lines"),
    ("UA", "United Airlines"),
    ("WN", "Southwest Airlines"),
    ("B6", "JetBlue Airways"),
    ("AS", "Alaska Airlines"),
    ("NK", "Spirit Airlines"),
    ("F9", "Frontier Airlines"),
]

# --- fixed values: calendar labels ------------------------------------------
MONTH_ABBR = ["Jan", "Feb", "Mar", "Apr", "May", "Jun",
              "Jul", "Aug", "Sep", "Oct", "Nov", "Dec"]
WEEKDAY_ORDER = ["Monday", "Tuesday", "Wednesday", "Thursday",
                 "Friday", "Saturday", "Sunday"]

# --- fixed values: delay-cause columns and their display labels -------------
DELAY_CAUSES = ["carrierdelay", "weatherdelay", "nasdelay",
                "securitydelay", "lateaircraftdelay"]
DELAY_CAUSE_LABELS = ["Carrier", "Weather", "NAS", "Security", "Late Aircraft"]

# --- fixed values: risk tiers (probability thresholds) -----------------------
RISK_LOW_BELOW = 0.3
RISK_MEDIUM_BELOW = 0.6
RISK_LABELS = ("LOW RISK", "MEDIUM RISK", "HIGH RISK")

# --- fixed values: risk fallbacks when no model applies ----------------------
FALLBACK_RATE_PCT = 30.0
FALLBACK_MINUTES = 20.0
FALLBACK_DISTANCE = 1000.0

# --- fixed values: weather provider column -> stored column -------------------
WEATHER_RENAMES = {
    "time": "weather_date",
    "temp": "temp",
    "tmin": "temp_min_c",
    "tmax": "temp_max_c",
    "rhum": "relative_humidity",
    "prcp": "precipitation_mm",
    "snwd": "snow_mm",
    "wspd": "wind_speed_kmh",
    "wpgt": "wind_gust_kmh",
    "pres": "pressure_hpa",
    "tsun": "sunshine_min",
    "cldc": "cloud_cover",
}
# sparse columns the loader drops after renaming
WEATHER_DROPPED = ["wind_gust_kmh", "sunshine_min"]

# --- fixed values: live state vector, 17 positional fields --------------------
STATE_FIELDS = [
    "icao24", "callsign", "origin_country", "time_position",
    "last_contact", "longitude", "latitude", "baro_altitude",
    "on_ground", "velocity", "true_track", "vertical_rate",
    "sensors", "geo_altitude", "squawk", "spi", "position_source",
]

# --- fixed values: columns that the collector keeps of the raw flight CSV ----
COLLECTOR_COLUMNS = [
    "FlightDate", "Operating_Airline", "Tail_Number",
    "Flight_Number_Operating_Airline",
    "Origin", "OriginCityName", "OriginAirportID",
    "Dest", "DestCityName", "DestAirportID",
    "DepDelay", "DepDel15", "ArrDelay", "ArrDel15",
    "Cancelled", "Diverted",
    "Distance", "DistanceGroup",
    "CarrierDelay", "WeatherDelay", "NASDelay",
    "SecurityDelay", "LateAircraftDelay",
]

# --- fixed values: columns that the cleaning script keeps (the constant
# ``Flights``, which it drops again later, is left out) ------------------------
CLEANING_COLUMNS = [
    "FlightDate", "Operating_Airline", "Tail_Number", "Flight_Number_Operating_Airline",
    "OriginAirportID", "Origin", "OriginCityName", "DestAirportID", "Dest", "DestCityName",
    "CRSDepTime", "DepTime", "DepDelay", "DepDel15", "DepartureDelayGroups", "TaxiOut",
    "WheelsOff", "WheelsOn", "TaxiIn", "CRSArrTime", "ArrTime", "ArrDelay", "ArrDel15",
    "ArrivalDelayGroups", "Cancelled", "CancellationCode", "Diverted", "CRSElapsedTime",
    "ActualElapsedTime", "AirTime", "Distance", "DistanceGroup", "CarrierDelay",
    "WeatherDelay", "NASDelay", "SecurityDelay", "LateAircraftDelay",
]

# --- fixed values: hhmm clock columns in the raw CSV -------------------------
CLOCK_COLUMNS = ["CRSDepTime", "DepTime", "WheelsOff", "WheelsOn",
                 "CRSArrTime", "ArrTime"]

# --- fixed values: columns dropped before training (identifiers, schedule
# and everything known only after departure), in the reference's order ------
LEAKAGE_COLUMNS = [
    "operating_airline", "tail_number", "flight_number_operating_airline",
    "originairportid", "destairportid", "wheelsoff", "wheelson",
    "cancellationcode", "carrierdelay", "weatherdelay", "nasdelay",
    "securitydelay", "lateaircraftdelay", "cancelled", "taxiout", "taxiin",
    "depdelay", "departuredelaygroups", "crselapsedtime", "actualelapsedtime",
    "airtime", "arrtime", "arrdel15", "arrdelay", "arrivaldelaygroups",
    "crsdeptime", "deptime", "crsarrtime",
]

# Weather measures carried per endpoint in the training join.
WEATHER_MEASURES = ["temp", "temp_min_c", "temp_max_c", "relative_humidity",
                    "precipitation_mm", "snow_mm", "wind_speed_kmh",
                    "pressure_hpa", "cloud_cover"]

DEFAULT_COUNTRY = "United States"
