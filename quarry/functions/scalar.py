"""Scalar families: text, numbers, dates, arrays, maps and JSON-like texts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def strip_leading_zeros(s: Column) -> Column:
    """A text without leading zeros; a text of zeros alone gives '0'."""
    return F.regexp_replace(s, r"^0+(?=.)", "")


def unquote(s: Column) -> Column:
    return F.btrim(s, F.lit('"'))


def joined_key(*cols: Column, sep: str = "-") -> Column:
    """Texts joined by a separator; null if any part is null."""
    missing = cols[0].isNull()
    for c in cols[1:]:
        missing = missing | c.isNull()
    return F.when(~missing, F.concat_ws(sep, *[c.cast("string") for c in cols]))


def ratio_or_zero(a: Column, b: Column) -> Column:
    """``a / b``, and 0 where b is not positive or null."""
    return F.when(b > 0, a / b).otherwise(F.lit(0.0))


def nearest_half(x: Column) -> Column:
    """Rounded to the nearest half, ties to even."""
    return F.bround(2 * x) / 2


def days_since(day: Column, today: Column) -> Column:
    return F.datediff(today, F.to_date(day))


def jaccard(a: Column, b: Column) -> Column:
    """Jaccard similarity of two arrays as sets; 0 where both are empty."""
    union = F.size(F.array_union(a, b))
    return F.when(union > 0, F.size(F.array_intersect(a, b)) / union).otherwise(F.lit(0.0))


def contains_all(basket: Column, items: Column) -> Column:
    return F.size(F.array_except(items, basket)) == 0


def bands(signature: Column, rows: int) -> Column:
    """Slices of ``rows`` elements each; the last may be shorter."""
    n = F.ceil(F.size(signature) / rows).cast("int")
    return F.when(n > 0, F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.slice(signature, i * rows + 1, rows))).otherwise(F.array())


def pairs(items: Column) -> Column:
    """All 2-combinations of an array's distinct items, each pair in order."""
    ordered = F.array_sort(F.array_distinct(items))
    each = F.transform(ordered, lambda a, i: F.transform(F.slice(ordered, i + 2, F.size(ordered)), lambda b: F.struct(a.alias("a"), b.alias("b"))))
    return F.flatten(each)


def mahalanobis(x: Column, n: Column, total: Column, squares: Column, epsilon: float = 1e-12) -> Column:
    """Distance of a point from a cluster summary (count, sums, sums of squares), diagonal covariance; variances are floored."""

    def one(point_sum, square):
        mean = point_sum["s"] / n
        return F.pow(point_sum["x"] - mean, 2) / F.greatest(square / n - mean * mean, F.lit(epsilon))

    both = F.zip_with(x, total, lambda a, s: F.struct(a.alias("x"), s.alias("s")))
    return F.sqrt(F.aggregate(F.zip_with(both, squares, one), F.lit(0.0), lambda acc, v: acc + v))


# Attributes: a map of texts whose values may be booleans or dict literals as text.


def attr_present(attributes: Column, key: str) -> Column:
    """1 where the key has a non-empty value (whatever it says), else 0."""
    return F.coalesce((F.get(F.array(attributes[key]), F.lit(0)) != "").cast("int"), F.lit(0))


def attr_true(attributes: Column, key: str) -> Column:
    """1 where the value says true, else 0."""
    return F.coalesce((F.lower(attributes[key]) == "true").cast("int"), F.lit(0))


def attr_int(attributes: Column, key: str) -> Column:
    return F.coalesce(attributes[key].try_cast("int"), F.lit(0))


def literal_flag(literal: Column, key: str) -> Column:
    """1 where a dict literal such as ``{'garage': True, u'lot': False}`` holds the key as true, else 0."""
    plain = F.regexp_replace(literal, r"\bu(?=['\"])", "")
    for said, json in (("True", "true"), ("False", "false"), ("None", "null")):
        plain = F.regexp_replace(plain, rf"(?<=[:\s]){said}\b", json)
    value = F.from_json(plain, f"struct<`{key}`:boolean>", {"allowSingleQuotes": "true"})[key]
    return F.coalesce(value.cast("int"), F.lit(0))


#: Attribute keys read as flags, by feature name; fixed values.
FLAG_ATTRIBUTES = {
    "bike_parking": "BikeParking",
    "good_for_kids": "GoodForKids",
    "has_tv": "HasTV",
    "outdoor_seating": "OutdoorSeating",
    "restaurants_delivery": "RestaurantsDelivery",
    "restaurants_good_for_groups": "RestaurantsGoodForGroups",
    "restaurants_reservations": "RestaurantsReservations",
    "restaurants_take_out": "RestaurantsTakeOut",
    "by_appointment_only": "ByAppointmentOnly",
    "wheelchair_accessible": "WheelchairAccessible",
    "open_24_hours": "Open24Hours",
    "drive_thru": "DriveThru",
    "coat_check": "CoatCheck",
    "restaurants_table_service": "RestaurantsTableService",
    "business_accepts_bitcoin": "BusinessAcceptsBitcoin",
    "business_accepts_credit_cards": "BusinessAcceptsCreditCards",
    "restaurants_counter_service": "RestaurantsCounterService",
    "dogs_allowed": "DogsAllowed",
    "caters": "Caters",
    "good_for_dancing": "GoodForDancing",
    "happy_hour": "HappyHour",
}
#: Keys inside dict-literal attributes, by attribute; fixed values.
LITERAL_ATTRIBUTES = {"BusinessParking": ("garage", "lot", "street", "validated", "valet"), "GoodForMeal": ("lunch", "dinner"), "Ambience": ("casual",)}


def attribute_features(attributes: Column, meaning: str = "present") -> dict[str, Column]:
    """Every attribute feature; ``meaning`` says whether a flag means 'present' or 'true'."""
    flag = {"present": attr_present, "true": attr_true}[meaning]
    out = {"price_range": attr_int(attributes, "RestaurantsPriceRange2")}
    out |= {name: flag(attributes, key) for name, key in FLAG_ATTRIBUTES.items()}
    for key, parts in LITERAL_ATTRIBUTES.items():
        out |= {part: literal_flag(attributes[key], part) for part in parts}
    return out
