"""Fixed values that results depend on: plain lookup tables, as text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

CLASSES = ("two_wheeler", "car", "auto", "light_commercial", "heavy", "other")
COUNTS = tuple(f"count_{c}" for c in CLASSES)
CLASS_WIDTH = {"two_wheeler": 0.8, "car": 1.9, "auto": 1.3, "light_commercial": 2.3, "heavy": 2.6, "other": 1.9}
FOOTPRINT = {"heavy": 2.5, "light_commercial": 1.8, "car": 1.5, "auto": 1.2, "two_wheeler": 0.8, "other": 1.0}
OCCUPANCY = {"two_wheeler": 0.15, "car": 0.30, "auto": 0.20, "light_commercial": 0.40, "heavy": 0.50, "other": 0.25}
VEHICLE_CLASS = {
    "SCOOTER": "two_wheeler",
    "MOTOR CYCLE": "two_wheeler",
    "MOTORCYCLE": "two_wheeler",
    "MOPED": "two_wheeler",
    "CAR": "car",
    "MAXI-CAB": "car",
    "MAXI CAB": "car",
    "JEEP": "car",
    "PASSENGER AUTO": "auto",
    "GOODS AUTO": "auto",
    "LGV": "light_commercial",
    "VAN": "light_commercial",
    "TEMPO": "light_commercial",
    "PRIVATE BUS": "heavy",
    "BUS (BMTC/KSRTC)": "heavy",
    "TOURIST BUS": "heavy",
    "SCHOOL VEHICLE": "heavy",
    "FACTORY BUS": "heavy",
    "HGV": "heavy",
    "LORRY/GOODS VEHICLE": "heavy",
    "LORRY": "heavy",
    "TANKER": "heavy",
    "TRACTOR": "heavy",
    "TRAILER": "heavy",
    "OTHERS": "other",
}
SEVERITY = {
    "DOUBLE PARKING": 2.0,
    "PARKING IN A MAIN ROAD": 1.8,
    "PARKING NEAR ROAD CROSSING": 1.8,
    "PARKING NEAR TRAFFIC LIGHT OR ZEBRA CROSS": 1.8,
    "PARKING NEAR BUSTOP/SCHOOL/HOSPITAL ETC": 1.6,
    "PARKING ON FOOTPATH": 1.4,
    "PARKING OPPOSITE TO ANOTHER PARKED VEHICLE": 1.4,
    "PARKING OTHER THAN BUS STOP": 1.3,
    "NO PARKING": 1.2,
    "WRONG PARKING": 1.0,
}
STATUS_WEIGHT = {"approved": 1.0, "created1": 0.5, "processing": 0.5}
EXCLUDED_STATUS = ("rejected", "duplicate")
ROAD_WIDTH = {"motorway": 15.0, "trunk": 15.0, "primary": 12.0, "secondary": 9.0, "tertiary": 7.5, "residential": 6.0, "living_street": 6.0, "unknown": 6.0}
VULNERABILITY = {"motorway": 2.0, "trunk": 1.8, "primary": 1.5, "secondary": 1.2, "tertiary": 1.0, "residential": 0.8, "living_street": 0.7, "unknown": 0.9}
TRAFFIC_VOLUME = {"motorway": 5000, "trunk": 5000, "primary": 3000, "secondary": 1500, "tertiary": 500, "residential": 200, "living_street": 100, "unknown": 500}
BASE_SPEED = {"primary": 40, "secondary": 35, "tertiary": 25, "residential": 20}
CASCADE_COUNT = {"primary": 8, "secondary": 5, "tertiary": 3, "residential": 1}
CASCADE_SCORE = {"primary": 90, "secondary": 65, "tertiary": 40, "residential": 20}
PEAK = (8, 9, 10, 17, 18, 19, 20)
WEEKEND_PEAK = (10, 11, 12, 13, 17, 18, 19, 20, 21)
HOUR_BUCKET = {
    0: "late_night", 1: "late_night", 2: "late_night", 3: "late_night", 4: "early_morning", 5: "early_morning", 6: "morning", 7: "morning", 8: "morning_rush", 9: "morning_rush", 10: "morning_rush", 11: "midday",
    12: "midday", 13: "midday", 14: "midday", 15: "afternoon", 16: "afternoon", 17: "evening_rush", 18: "evening_rush", 19: "evening_rush", 20: "evening_rush", 21: "night", 22: "night", 23: "late_night",
}
DAMPENER = {0: 0.40, 1: 0.30, 2: 0.25, 3: 0.25, 4: 0.30, 5: 0.45, 6: 0.70, 7: 0.88, 21: 0.80, 22: 0.55, 23: 0.45}
HOLIDAYS = ("2023-11-14", "2023-11-27", "2023-12-25", "2024-01-15", "2024-01-26", "2024-03-25", "2024-03-29", "2024-04-11", "2024-04-14")
FESTIVALS = ("2023-11-12", "2023-11-13", "2023-12-31", "2024-01-01", "2024-01-14", "2024-01-15", "2024-01-16", "2024-03-24", "2024-03-25")
#: name: (hours, weekdays only)
WINDOWS = {
    "school_dropoff": ((7, 8, 9), True),
    "school_pickup": ((14, 15, 16), True),
    "lunch_market": ((12, 13, 14), False),
    "office_commute_am": ((8, 9, 10), True),
    "office_commute_pm": ((17, 18, 19), True),
    "shopping_evening": ((17, 18, 19, 20), False),
    "nightlife_peak": ((21, 22, 23, 0), False),
}
POI_GRAVITY = {
    "metro": 3.0, "railway_station": 3.0, "airport": 4.0, "commercial": 2.5, "mall": 3.5, "market": 2.5, "school": 2.0, "university": 2.5, "hospital": 2.0,
    "restaurant": 1.5, "bus_stop": 1.2, "worship": 1.5, "office": 2.5, "hotel": 2.0, "nightlife": 2.5, "park": 1.5, "stadium": 3.0,
}
POI_TYPE = {
    "airport": "airport",
    "aeroway=aerodrome": "airport",
    "mall": "mall",
    "shop=mall": "mall",
    "hotel": "hotel",
    "tourism=hotel": "hotel",
    "park": "park",
    "leisure=park": "park",
    "stadium": "stadium",
    "leisure=stadium": "stadium",
    "nightlife": "nightlife",
    "nightclub": "nightlife",
    "bar": "nightlife",
    "pub": "nightlife",
    "university": "university",
    "college": "university",
    "railway_station": "railway_station",
    "station": "railway_station",
    "metro": "metro",
    "subway": "metro",
    "commercial": "commercial",
    "retail": "commercial",
    "landuse_commercial": "commercial",
    "landuse_retail": "commercial",
    "bus_stop": "bus_stop",
    "highway_bus_stop": "bus_stop",
    "school": "school",
    "hospital": "hospital",
    "clinic": "hospital",
    "restaurant": "restaurant",
    "cafe": "restaurant",
    "fast_food": "restaurant",
    "food_court": "restaurant",
    "market": "market",
    "marketplace": "market",
    "worship": "worship",
    "place_of_worship": "worship",
    "office": "office",
}
EXCLUDED_HIGHWAYS = ("footway", "path", "pedestrian", "steps", "cycleway", "bridleway", "construction", "proposed", "raceway")
HIGHWAY_CLASS = {
    "motorway": ("motorway", "motorway_link"), "trunk": ("trunk", "trunk_link"), "primary": ("primary", "primary_link"),
    "secondary": ("secondary", "tertiary", "secondary_link", "tertiary_link", "unclassified"),
}
SNAP_PENALTY = {"motorway": 0.0005, "motorway_link": 0.0005, "trunk": 0.0005, "trunk_link": 0.0005, "primary": 0.0002, "primary_link": 0.0002}
PRIMARY_TEXT = "RING ROAD|HIGHWAY|FLYOVER|BRIDGE|MAIN ROAD|MARKET|METRO|BUS STAND"
SECONDARY_TEXT = "JUNCTION|ROAD|CROSS|STATION|CIRCLE|AVENUE|STREET"
CAPACITY_WORDS = ("yes", "no", "unknown", "many", "limited", "customers")
STRUCTURE_TEXT = r"(?i)\b(bridge|flyover|overpass|underpass|under\s+pass|underbridge|under\s+bridge|subway|tunnel|viaduct|grade\s+separator|grade-separated)\b"
FALSE_TAGS = ("", "0", "false", "no", "none", "null", "nan", "n/a", "unknown")


def lookup(column: Column, table: dict, default) -> Column:
    """``table`` at ``column``, else ``default``: a constant map, evaluated inside the generated code."""
    pairs = [F.lit(x) for kv in table.items() for x in kv]
    return F.coalesce(F.try_element_at(F.create_map(*pairs), column), F.lit(default))
