"""Text rules on columns: keys, classification of map features and listings, road classes."""

from __future__ import annotations

from functools import reduce
from operator import and_, or_

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

#: Words that name or exclude kinds of places, in the order in which rules ask for them.
NAMES = {
    "milk_centre": r"(milk|\bamata\b|\bmcc\b|collection cent|dairy|laiterie|laitier)",
    "coffee_station": r"(washing station|\bcws\b|coffee|café|ikawa)",
    "cold_store": r"(cold\s?(room|store|storage|chain)|frigo|chambre froide)",
    "mill": r"(\bmill(s|ing|ers?)?\b|minoterie|moulin|flour|kawunga)",
    "cooperative": r"(cooperative|coopérative|cooperativ|koperative|\bcoop\b|\bco-op\b)",
    "warehouse": r"(warehouse|entrep[oô]t|stock|ububiko|post.?harvest)",
    "market": r"(market|march[eé]|isoko)",
    "agri": r"(maize|corn|grain|flour|food|agro|agri|farm|potato|milk|dairy|coffee|\btea\b|ibigori|ibirayi|amata|cassava|rice|beans|feed|fruit|vegetable|harvest|seed|fertili[sz]er|cooperative|koperative)",
}
LOOKALIKE = r"(super ?market|minimarket|mini.?market|marketing|restaurant|h[oô]tel|lodge|bank|sawmill|saw mill|pharmacy|school|[eé]cole|church|eglise|église|mosque|parish|paroisse|chapel|temple|hospital|clinic|bar\b|caf[eé]\b|club|campus|universit|college|institute|tourism|toilet|ubwiherero|latrine|parking|coffee ?shop)"
TEA = r"\btea\b.{0,20}\b(factory|company|estate|processing|collection|leaf)"
LISTING_EXCLUDE = r"(church|eglise|église|mosque|parish|paroisse|chapel|temple|ministr|minimarket|mini.?market|supermarket|super market|marketing|h[oô]tel|lodge|restaurant|bar\b|coffee ?shop|school|[eé]cole|education|consult|agency|hospital|clinic|pharmac|salon|boutique|bank|insurance|club|campus|universit|college|institute|tourism|football|\bf\.?c\.?(\s|$)|sports?\b|toilet|ubwiherero|latrine|parking)"
LISTING_KINDS = (
    (r"^(farmers_market|public_market|market|flea_market|food_market)$", "market"),
    (r"(agricultural_cooperative|farming_cooperative|cooperative)", "cooperative"),
    (r"(dairy|milk)", "milk_centre"),
    (r"(flour_mill|grain_mill|rice_mill|mill$|milling)", "mill"),
    (r"(cold_storage|refrigerat)", "cold_store"),
    (r"^(warehouses?|storage_facility|grain_elevator|silo|agricultural_storage)$", "warehouse"),
    (r"tea_manufactur", "tea_factory"),
    (r"(food_processing|food_manufactur|agricultural_production|food_and_beverage_manufactur|beverage_manufactur)", "agro_factory"),
    (r"(agricultural_service|agricultural_supply|farm_equipment|seed|fertilizer|feed_store|agricultural)", "agro_shop"),
)
LISTING_OFF = r"(government|religious|marketing|printing|consult|professional|computer|software|media|agency|technology|bank|financial|hotel|lodging|restaurant|coffee_shop|cafe|bar$|church|worship|school|education|hospital|clinic|pharmacy|salon|beauty|fashion|apparel|electronics|phone|real_estate|travel|insurance|supermarket|department_store|grocery|convenience|fish_farm|farm$|ranch)"
LISTING_NEVER = r"(government|religious|marketing|printing|computer|software|hotel|restaurant|coffee_shop|church|school|hospital|bank)"
LISTING_AGRI = ("warehouse", "agro_factory")
MILK_NAME, MILK_LISTED = r"(\bamata\b|\bmcc\b|milk collection)", r"(\bamata\b|\bmcc\b|milk collection|laiterie)"
MILL_LISTED, MARKET_LISTED = "(minoterie|maize mill|flour mill|kawunga)", r"(^|\s)(isoko|march[eé])(\s|$)"
#: Rules for a map feature in the order in which they are asked, as (kind or None, ways to hold); a way is a
#: list of (tag, pattern) that must all be found, a missing tag being empty. name: of the feature; not name: isn't found in it.
FEATURE_RULES = (
    (None, [("highway", ".")], [("amenity", "^(cafe|restaurant|bar|fast_food|bank|school|place_of_worship|hospital|clinic|fuel|toilets|parking|bus_station|police|townhall|post_office)$")], [("shop", "^(supermarket|coffee|convenience|butcher|bakery)$")], [("industrial", "^sawmill$")], [("craft", "^sawmill$")]),
    (None, [("office", "^(?!cooperative$)."), ("not name", NAMES["cooperative"])]),
    (None, [("name", LOOKALIKE), ("amenity", "^(?!marketplace$)"), ("industrial", "^$"), ("place", "^$")]),
    ("town", [("place", "^(town|city)$")]),
    ("village", [("place", "^village$")]),
    (None, [("place", ".")]),
    ("tea_factory", [("industrial", "^tea$")], [("product", r"\btea\b")], [("name", TEA)]),
    ("milk_centre", [("industrial", "^(dairy|milk)$")], [("product", "milk")], [("name", NAMES["milk_centre"])]),
    ("coffee_station", [("industrial", "coffee")], [("product", "coffee")], [("name", NAMES["coffee_station"]), ("shop", "^$")]),
    ("cold_store", [("industrial", "cold")], [("building", "^cold_storage$")], [("name", NAMES["cold_store"])]),
    ("mill", [("man_made", "^(watermill|windmill)$")], [("craft", "^miller$")], [("industrial", "(mill|grain)")], [("product", "(flour|maize)")], [("name", NAMES["mill"])]),
    ("cooperative", [("office", "^cooperative$")], [("cooperative", ".")], [("name", NAMES["cooperative"])]),
    ("market", [("amenity", "^marketplace$")], [("name", NAMES["market"]), ("shop", "^$")]),
    ("warehouse", [("building", "^(warehouse|silo)$")], [("industrial", "^warehouse$")], [("man_made", "^silo$")], [("name", NAMES["warehouse"])]),
    ("agro_factory", [("man_made", "^works$"), ("name", NAMES["agri"])], [("man_made", "^works$"), ("product", NAMES["agri"])], [("industrial", "^(food_industry|food|agriculture|agricultural)$")], [("product", "(tea|potato|vegetable|fruit|grain|beans)")]),
    ("agro_shop", [("shop", "^(agrarian|farm)$")]),
)
#: The same for a place listing with name, category and the last step of its hierarchy.
LISTING_RULES = (
    (None, [("name", LISTING_EXCLUDE)]),
    (None, [("category", LISTING_OFF), ("category", LISTING_NEVER)]),
    ("cooperative", [("category", LISTING_OFF), ("name", NAMES["cooperative"])]),
    ("milk_centre", [("category", LISTING_OFF), ("name", MILK_NAME)]),
    (None, [("category", LISTING_OFF)]),
    *((kind, [("category", p)], [("last", p)]) for p, kind in LISTING_KINDS),
    ("cooperative", [("name", NAMES["cooperative"])]),
    ("milk_centre", [("name", MILK_LISTED)]),
    ("cold_store", [("name", NAMES["cold_store"])]),
    ("mill", [("name", MILL_LISTED)]),
    ("market", [("name", MARKET_LISTED)]),
)
#: Keys that decide on access, the last one given counting, and their restrictions that need more than tags say.
WAY_KEYS = {"foot": ("access", "foot"), "bicycle": ("access", "vehicle", "bicycle"), "motorbike": ("access", "vehicle", "motor_vehicle", "motorcycle"), "vehicle": ("access", "vehicle", "motor_vehicle", "hgv")}
UNSUPPORTED = ("maxweight", "maxaxleload", "maxheight", "maxwidth", "maxlength", "barrier", "ford", "ice_road", "winter_road", "seasonal", "impassable")
FOOTWAYS, STEPS, ONEWAY = ("footway", "path", "corridor"), ("steps", "via_ferrata"), ("yes", "1", "true", "-1", "no", "0", "false")
SPEEDS = {
    "motorway": 70, "trunk": 60, "primary": 50, "secondary": 40, "tertiary": 30, "unclassified": 25, "road": 20,
    "residential": 20, "living_street": 10, "service": 15, "track": 15, "path": 5, "footway": 5, "bridleway": 5, "steps": 3,
    "motorway_link": 40, "trunk_link": 40, "primary_link": 35, "secondary_link": 30, "tertiary_link": 25,
}
ROAD_CLASS = {
    "motorway": "motorway", "trunk": "trunk", "primary": "primary", "secondary": "secondary", "tertiary": "tertiary",
    "residential": "residential", "living_street": "living_street", "unclassified": "unclassified", "service": "service",
    "pedestrian": "footway", "footway": "footway", "sidewalk": "footway", "crosswalk": "footway", "steps": "steps", "path": "path",
    "track": "track", "cycleway": "path", "bridleway": "bridleway", "unknown": "road",
}
PAVED = ("paved", "asphalt", "concrete", "concrete:plates", "paving_stones", "sett", "chipseal", "metal")
FIRM = ("gravel", "fine_gravel", "compacted", "pebblestone", "rock")
LOOSE = ("unpaved", "dirt", "earth", "ground", "mud", "grass", "sand", "soil", "clay", "woodchips")
MAJOR = r"^(motorway|trunk|primary|secondary)(_link)?$"


#: A word's edge where only ASCII letters, digits and _ are of words, as the rules are meant.
EDGE = r"(?:(?<![A-Za-z0-9_])(?=[A-Za-z0-9_])|(?<=[A-Za-z0-9_])(?![A-Za-z0-9_]))"


def like(c: Column, pattern: str) -> Column:
    return F.coalesce(c.rlike("(?iu)" + pattern.replace(r"\b", EDGE)), F.lit(False))


def normal_name(c: Column) -> Column:
    """Upper case, trimmed, single spaces. Compatibility characters: see nfkc."""
    return F.upper(F.trim(F.regexp_replace(c, r"\s+", " ")))


@F.pandas_udf(StringType())
def nfkc(s: pd.Series) -> pd.Series:
    return s.str.normalize("NFKC")


@F.pandas_udf(StringType())
def unaccented(s: pd.Series) -> pd.Series:
    return s.str.normalize("NFD").str.replace(r"[̀-ͯ]", "", regex=True).str.lower()


def by_rules(rules: tuple, fields) -> Column:
    """The kind of the first rule that holds in any of its ways; null where none does. fields: the column of a name.

    Patterns on names find upper and lower case alike, others are exact."""

    def found(field: str, pattern: str) -> Column:
        if field.endswith("name"):
            hit = like(fields("name"), pattern)
            return ~hit if field.startswith("not ") else hit
        value = fields(field)
        return like(value, pattern) if pattern in NAMES.values() else F.coalesce(value.rlike(pattern.replace(r"\b", EDGE)), F.lit(False))

    kind = F.lit(None).cast("string")
    for name, *ways in reversed(rules):
        holds = reduce(or_, [reduce(and_, [found(*part) for part in way]) for way in ways])
        kind = F.when(holds, F.lit(name).cast("string")).otherwise(kind)
    return kind


def feature_kind(tags: Column) -> Column:
    """The kind of place a map feature is by its tags, or null: what it surely isn't goes first, then the kinds in order."""
    t = lambda k: F.coalesce(F.try_element_at(tags, F.lit(k)), F.lit(""))
    name = F.coalesce(*[F.nullif(t(k), F.lit("")) for k in ("name", "name:en", "name:rw", "name:fr")], F.lit(""))
    return by_rules(FEATURE_RULES, lambda k: name if k == "name" else t(k))


def listing_kind(name: Column, category: Column, confidence: Column, hierarchy: Column | None = None, least: float = 0.5) -> Column:
    """The kind of a place listing, or null: confident, not excluded by name or category, by category or the last step of its
    hierarchy (an array), and then by name. Warehouses and factories must have a name that says agriculture."""
    last = F.coalesce(F.try_element_at(hierarchy, F.lit(-1)), F.lit("")) if hierarchy is not None else F.lit("")
    value = {"name": name, "category": F.coalesce(category, F.lit("")), "last": last}
    kind = by_rules(LISTING_RULES, value.__getitem__)
    off = kind.isin(*LISTING_AGRI) & ~like(name, NAMES["agri"])
    return F.when((F.coalesce(confidence, F.lit(0.0)) >= least) & ~F.coalesce(off, F.lit(False)), kind)


def class_speed(highway: Column) -> Column:
    return F.try_element_at(F.create_map(*[F.lit(x) for kv in SPEEDS.items() for x in kv]), highway)


def road_class(code: Column) -> Column:
    return F.try_element_at(F.create_map(*[F.lit(x) for kv in ROAD_CLASS.items() for x in kv]), code)


def rain_factor(highway: Column, surface: Column) -> Column:
    return F.when(surface.isin(*PAVED), 0.9).when(surface.isin(*FIRM), 0.7).when(surface.isin(*LOOSE), 0.45).when(highway.rlike(MAJOR), 0.85).when(highway.isin("track", "path", "footway", "bridleway"), 0.45).otherwise(0.6)


def speed_limit(text: Column) -> Column:
    """km/h of a limit with an optional unit, else null."""
    form = r"^([0-9]+(?:\.[0-9]+)?)(?:\s*(km/h|mph))?$"
    value = F.regexp_extract(text, form, 1).try_cast("double") * F.when(F.regexp_extract(text, form, 2) == "mph", 1.609344).otherwise(1.0)
    return F.when(value > 0, value)


def published_number(text: Column, status: Column) -> Column:
    """A published figure: null where a status is set or the text blank; anything else must be a finite number of 0 or more."""
    value = F.trim(text).try_cast("double")
    off = (F.trim(F.coalesce(text, F.lit(""))) == "") | (F.coalesce(F.trim(status), F.lit("")) != "")
    bad = value.isNull() | F.isnan(value) | (value < 0) | (value == float("inf"))
    return F.when(off, None).when(bad, F.raise_error(F.concat(F.lit("not a published number: "), text)).cast("double")).otherwise(value)


def way_policy(tags: Column, season: str, mode: str = "vehicle", allowed: tuple[str, ...] = ("yes", "permissive", "designated"), factors: dict | None = None, missing_access: str = "allow") -> Column:
    """A struct (status, forward, backward, forward_kph, backward_kph): what a mode of transport (a key of WAY_KEYS) may do on a
    way in a season.

    Reasons to reject a way are asked in order. The last access tag of the mode's keys decides; without one, missing_access
    does (allow or exclude). A surface without a factor, or with none for the season, rejects. Speeds are the class speed times
    the factor; limits cap those of motor vehicles. On foot a one-way tag counts on steps alone, and is unclear on footways."""
    factors = factors or {"UNKNOWN": {"dry": 0.8, "wet": 0.5}, "asphalt": {"dry": 1.0, "wet": 0.9}, "dirt": {"dry": 0.7, "wet": None}}
    keys = WAY_KEYS[mode]
    t = lambda k: F.try_element_at(tags, F.lit(k))
    one_sided = lambda k: (k.endswith(":forward") | k.endswith(":backward")) & ~k.isin("maxspeed:forward", "maxspeed:backward")
    odd = F.exists(F.map_keys(tags), lambda k: k.contains(":conditional") | k.isin(*UNSUPPORTED) | one_sided(k))
    access, surface, highway = F.coalesce(*[t(k) for k in reversed(keys)]), F.coalesce(t("surface"), F.lit("UNKNOWN")), t("highway")
    factor = F.lit(None).cast("double")
    for name, by in factors.items():
        factor = F.when(surface == name, F.lit(by[season]).cast("double")).otherwise(factor)
    general = F.coalesce(t("oneway"), F.when((t("junction") == "roundabout") | (highway == "motorway"), "yes"))
    own = F.coalesce(*[t(f"oneway:{k}") for k in reversed(keys[1:])], F.lit(None).cast("string"))
    unclear = F.lit(False)
    if mode == "foot":
        unclear = own.isNull() & (F.coalesce(general, F.lit("")) != "") & highway.isin(*FOOTWAYS)
        general = F.when(highway.isin(*STEPS), general)
    oneway = F.coalesce(own, general, F.lit("no"))
    limit = lambda way: F.coalesce(t(f"maxspeed:{way}"), t("maxspeed")) if mode in ("vehicle", "motorbike") else F.lit(None).cast("string")
    bad_limit = lambda way: limit(way).isNotNull() & speed_limit(limit(way)).isNull()
    speed = class_speed(highway) * factor
    reasons = (
        ("unconfigured_highway", class_speed(highway).isNull()),
        ("unsupported_restriction_review", odd),
        ("access_unknown", access.isNull() & F.lit(missing_access == "exclude")),
        ("access_restricted_or_unresolved", access.isNotNull() & ~access.isin(*allowed)),
        ("surface_unconfigured", ~surface.isin(*factors)),
        ("scenario_impassable", factor.isNull()),
        ("pedestrian_oneway_ambiguous", unclear),
        ("oneway_unresolved", ~oneway.isin(*ONEWAY)),
        ("maxspeed_unresolved", bad_limit("forward") | bad_limit("backward")),
    )
    status = F.lit("retained")
    for reason, holds in reversed(reasons):
        status = F.when(holds, reason).otherwise(status)
    kept = status == "retained"
    return F.struct(status.alias("status"), F.when(kept, oneway != "-1").alias("forward"), F.when(kept, ~oneway.isin("yes", "1", "true")).alias("backward"), *[F.when(kept, F.least(speed, speed_limit(limit(w)))).alias(f"{w}_kph") for w in ("forward", "backward")])
