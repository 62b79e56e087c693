"""Map tags, capacities and structures as column rules."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions import refdata as R


def poi_type_of_synonym(text: Column) -> Column:
    return F.try_element_at(F.create_map(*[F.lit(x) for kv in R.POI_TYPE.items() for x in kv]), F.lower(F.trim(text)))


def poi_type_of_tags(tags: Column) -> Column:
    """Type by the first rule that fits the tag map; null where none does."""
    v = lambda k: F.lower(F.coalesce(F.try_element_at(tags, F.lit(k)), F.lit("")))
    amenity, station = v("amenity"), v("railway") == "station"
    rules = [
        (v("aeroway") == "aerodrome", "airport"), (v("shop") == "mall", "mall"), (v("tourism") == "hotel", "hotel"), (v("leisure") == "park", "park"), (v("leisure") == "stadium", "stadium"),
        (station & ((v("station") == "subway") | (v("subway") == "yes")), "metro"), (station, "railway_station"), (v("landuse").isin("commercial", "retail"), "commercial"), (v("highway") == "bus_stop", "bus_stop"),
        (amenity.isin("nightclub", "bar", "pub"), "nightlife"), (amenity.isin("university", "college"), "university"), (amenity == "school", "school"), (amenity.isin("hospital", "clinic"), "hospital"),
        (amenity.isin("restaurant", "cafe", "fast_food", "food_court"), "restaurant"), (amenity == "marketplace", "market"), (amenity == "place_of_worship", "worship"), (F.map_contains_key(tags, "office"), "office"),
    ]
    out = F.when(rules[0][0], rules[0][1])
    for test, kind in rules[1:]:
        out = out.when(test, kind)
    return out


def poi_id(given: Column, osm_type: Column, osm_id: Column, kind: Column, lat: Column, lon: Column, name: Column) -> Column:
    """The given id, else that of the map element, else one of type, place (7 decimals) and the name's first 60 characters."""
    place = F.concat_ws(":", kind, F.format_string("%.7f", lat), F.format_string("%.7f", lon), F.substring(F.coalesce(name, F.lit("")), 1, 60))
    return F.coalesce(F.nullif(F.trim(given), F.lit("")), F.when(osm_id.isNotNull(), F.concat_ws(":", F.lit("osm"), osm_type, osm_id.cast("string"))), place)


def capacity(text: Column) -> Column:
    """Number of a capacity tag: the larger of a range, else the first number over zero; null for words."""
    clean = F.lower(F.trim(text))
    numbers = F.transform(F.regexp_extract_all(clean, F.lit(r"(\d+(?:\.\d+)?)")), lambda x: x.cast("double"))
    value = F.when(clean.contains("-") & (F.size(numbers) >= 2), F.array_max(F.slice(numbers, 1, 2))).otherwise(F.try_element_at(numbers, F.lit(1)))
    return F.when(~clean.isin("", *R.CAPACITY_WORDS) & (value > 0), value)


def capacity_estimate(tagged: Column, area: Column, per_space: float = 15.0, default: float = 8.0) -> tuple[Column, Column]:
    """(capacity, where it is from): the tag, else the area's spaces (one at least), else the default."""
    by_area = F.when(area > 0, F.greatest(F.lit(1.0), area / per_space))
    source = F.when(tagged.isNotNull(), "tag").when(by_area.isNotNull(), "area").otherwise("default")
    return F.coalesce(tagged, by_area, F.lit(default)), source


def is_structure(tags: Column, *texts: Column) -> Column:
    """Whether a road is a bridge, an underpass or the like, by its tag map or by its names."""
    v = lambda k: F.lower(F.trim(F.coalesce(F.try_element_at(tags, F.lit(k)), F.lit(""))))
    yes = lambda k: ~v(k).isin(*R.FALSE_TAGS)
    by_tag = yes("bridge") | yes("tunnel") | yes("covered") | (v("man_made") == "bridge") | v("location").isin("underground", "overground", "overhead") | v("structure").isin("bridge", "flyover", "underpass", "tunnel", "viaduct")
    layer = F.coalesce(v("layer").try_cast("double"), F.lit(0.0)) != 0
    return F.coalesce(by_tag | layer, F.lit(False)) | F.concat_ws(" ", *texts).rlike(R.STRUCTURE_TEXT)


def tag_map(text: Column) -> Column:
    """Tags from JSON text, or from ``k=v;k=v`` text; keys in lower case."""
    parsed = F.when(F.ltrim(text).startswith("{"), F.from_json(text, "map<string,string>"))
    pairs = F.filter(F.split(F.coalesce(text, F.lit("")), "[;,]"), lambda p: p.contains("="))
    plain = F.map_from_entries(F.transform(pairs, lambda p: F.struct(F.trim(F.split(p, "=", 2)[0]), F.trim(F.split(p, "=", 2)[1]))))
    return F.transform_keys(F.coalesce(parsed, plain), lambda k, _: F.lower(k))


def road_key(station: Column, junction: Column, name: Column, kind: Column, way: Column) -> Column:
    """Canonical key of a road; blank and unknown parts are left out."""
    slug = lambda c: F.replace(F.lower(F.trim(F.coalesce(c, F.lit("")))), F.lit(" "), F.lit("_"))
    parts = F.filter(F.array(slug(station), slug(junction), slug(name), F.coalesce(kind, F.lit("")), F.coalesce(way.cast("string"), F.lit(""))), lambda p: ~p.isin("", "unknown"))
    return F.concat(F.lit("rk_"), F.array_join(parts, "_"))


def overflow_risk(volume: Column, distance: Column, spaces: Column, scale: Column) -> Column:
    """0..100 by volume, distance to the nearest legal parking (null: 1000 m) and its spaces."""
    d = F.coalesce(distance, F.lit(1000.0)) / 500
    pressure = volume / scale * (1 + F.greatest(F.lit(0.0), F.least(F.lit(3.0), d))) / F.greatest(F.lit(0.35), F.sqrt(F.greatest(F.coalesce(spaces, F.lit(0.0)), F.lit(1.0)) / 8))
    return 100 * (1 - F.exp(-pressure))
