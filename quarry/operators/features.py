"""Feature building for rating prediction: user, business and tip metrics, and the joined matrix."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.functions.scalar import attribute_features, nearest_half, ratio_or_zero
from quarry.operators.encode import label_encode
from quarry.operators.explore import joined_or_default

BUSINESS, USER = ("business_stars", "latitude", "longitude"), ("user_stars", "user_reviews", "compliments", "reviews_per_year")


def business_metrics(business: DataFrame) -> DataFrame:
    """One row per business; NaN counts as missing, stars to the nearest half."""
    clean = lambda c: F.when(~F.isnan(c), F.col(c))
    return business.select("business_id", nearest_half(clean("stars")).alias("business_stars"), clean("latitude").alias("latitude"), clean("longitude").alias("longitude"))


def user_metrics(users: DataFrame, today: str, only: DataFrame | None = None) -> DataFrame:
    """Stars, reviews, compliments per review and reviews per year of membership (days from the youngest member).

    ``only`` (user_id) restricts the users, and with them the shortest membership.
    """
    rows = users if only is None else users.join(only.select("user_id").distinct(), "user_id", "left_semi")
    days = F.datediff(F.lit(today).cast("date"), F.to_date("yelping_since"))
    rows = rows.withColumn("days", days)
    least = F.broadcast(rows.agg(F.min("days").alias("least")))  # one row
    per_year = F.col("review_count") * 365.0 / (F.col("days") - F.col("least") + 1)
    kind = ratio_or_zero((F.col("compliment_cool") + F.col("compliment_funny")).cast("double"), F.col("review_count"))
    return rows.join(least).select("user_id", F.col("average_stars").alias("user_stars"), F.col("review_count").cast("double").alias("user_reviews"), kind.alias("compliments"), per_year.alias("reviews_per_year"))


def tip_features(tips: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Likes per user, per business, and per pair: sums, means and maxima."""
    def by(*keys: str, tag: str) -> DataFrame:
        return tips.groupBy(*keys).agg(F.sum("likes").alias(f"{tag}_likes"), F.avg("likes").alias(f"{tag}_mean_likes"), F.max("likes").alias(f"{tag}_max_likes"))

    return by("user_id", tag="user"), by("business_id", tag="business"), by("user_id", "business_id", tag="pair")


def business_attributes(business: DataFrame, meaning: str = "present") -> DataFrame:
    """Attribute flags and the label codes of the place and the name, codes fitted on all businesses."""
    made = attribute_features(F.coalesce("attributes", F.create_map().cast("map<string,string>")), meaning)
    rows = business.select("business_id", "name", F.concat_ws("-", "city", "state").alias("place"), *[c.alias(n) for n, c in made.items()])
    rows = label_encode(label_encode(rows, "place", "place_code"), "name", "name_code")
    return rows.drop("place", "name")


def feature_matrix(ratings: DataFrame, business: DataFrame, users: DataFrame, extras: list[tuple[DataFrame, list[str]]] = ()) -> DataFrame:
    """Ratings with business and user metrics; unknown ones take the metrics' means, missing extras 0.  No row is lost."""
    def means(metrics: DataFrame, cols) -> dict[str, Column]:
        row = metrics.agg(*[F.avg(c).alias(c) for c in cols]).first()  # one row
        return {c: F.lit(row[c]).cast("double") for c in cols}

    out = joined_or_default(ratings, business, "business_id", means(business, BUSINESS))
    out = joined_or_default(out, users, "user_id", means(users, USER))
    for frame, keys in extras:
        new = [c for c in frame.columns if c not in keys]
        out = out.join(frame, keys, "left").fillna(0, subset=new)
    return out
