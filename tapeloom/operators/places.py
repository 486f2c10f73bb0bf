"""Places: tidying a typed location, and resolving its region with a gazetteer."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window as W, functions as F

from tapeloom.functions.text import blank_to_null, city_key, fold, title_case
from tapeloom.operators import merging


# How a city is called for short behind a venue's name.
CITY_SHORT = {"nyc": "new york", "ny": "new york", "la": "los angeles", "sf": "san francisco", "philly": "philadelphia", "dc": "washington"}
# Words that are no place by themselves.
_NOTHING = r"^(unknown( venue)?|n/a|tb[ad]|various|\?+|-+)$"
_SOURCE = r"^(sbd|d?sbd|aud|fm|mtx|matrix source|fob|soundboard|audience)$"
_DATE = r"(?:\d{4}[-./]\d{1,2}[-./]\d{1,2}|\d{1,2}[-./]\d{1,2}[-./]\d{2,4})"


def tidy(df: DataFrame) -> DataFrame:
    """X-23: repairs venue, city and state in steps, each working on what the one before left.

    1. Blanks to null, runs of blanks to one. 2. A number and a dot, or a date and a weekday in brackets, off the
    venue's head; a venue that is a date or a source's name is none. 3. "At the", "live at", "@" and a trailing
    ", The" off the venue. 4. Remarks in brackets off venue and city. 5. The city behind the venue goes, with what
    follows it, after a dash or comma, written out or for short. 6. "City, ST" typed into the city fills a missing
    state. 7. Words for nothing to null. 8. Of a state its code alone, in capitals and without dots; a state that is
    the city again is none. 9. Venues and cities in capitals only, without digits, as titles.
    """
    one = lambda c: blank_to_null(F.regexp_replace(c, r"(?U)\s+", " "))
    off = lambda c, pattern: one(F.regexp_replace(c, pattern, ""))
    for c in ("venue", "city", "state"):
        df = df.withColumn(c, one(F.col(c)))
    v = off(off(F.col("venue"), r"^\d{4,7}\.\s*"), rf"^{_DATE}\s*(?:\([A-Za-z]{{2,9}}\))?\s*")
    df = df.withColumn("venue", F.when(~F.lower(v).rlike(_SOURCE), v))
    df = df.withColumn("venue", off(F.col("venue"), r"(?i)^(?:live\s+at\s+(?:the\s+)?|at\s+the\s+|@\s*)|,\s*the$"))
    for c in ("venue", "city"):
        df = df.withColumn(c, off(F.col(c), r"\s*\([^)]*\)\s*$"))
    # The venue cut into what stands between dashes and commas: it ends before the first part that is the city.
    pieces = F.split("venue", r"(?<=\S)(?: - |, )(?=\S)")
    short = F.create_map(*[F.lit(x) for pair in CITY_SHORT.items() for x in pair])
    known = F.transform(pieces, lambda p: F.coalesce(F.nullif(F.lower(p), F.lit("")) == F.lower("city"), F.lit(False)) | F.coalesce(short[F.lower(p)] == F.lower("city"), F.lit(False)))
    at = F.array_position(known, True).cast("int")
    # A part and the separator before it are as long as they were typed.
    typed = F.transform(F.slice(pieces, F.lit(1), at - 1), lambda p: F.length(p))
    gaps = F.slice(F.transform(F.regexp_extract_all("venue", F.lit(r"(?<=\S)( - |, )(?=\S)"), F.lit(1)), lambda g: F.length(g)), F.lit(1), at - 2)
    total = lambda a: F.aggregate(a, F.lit(0), lambda n, x: n + x)
    df = df.withColumn("venue", F.when(at > 1, F.left("venue", total(typed) + F.when(at > 2, total(gaps)).otherwise(0))).otherwise(F.col("venue")))
    df = df.withColumn("venue", one(F.regexp_replace("venue", r"\s*[-,]\s*$", "")))
    code = F.nullif(F.regexp_extract("city", r",\s*([A-Z]{2})$", 1), F.lit(""))
    df = df.withColumn("state", F.coalesce("state", code)).withColumn("city", F.when(code.isNotNull(), F.regexp_replace("city", r",\s*[A-Z]{2}$", "")).otherwise(F.col("city")))
    for c in ("venue", "city", "state"):
        df = df.withColumn(c, F.when(~F.lower(F.col(c)).rlike(_NOTHING), F.col(c)))
    dotted = F.replace("state", F.lit("."), F.lit(""))
    alone = F.nullif(F.regexp_extract("state", r"^([A-Z]{2}) [a-z]+$", 1), F.lit(""))
    df = df.withColumn("state", F.coalesce(alone, F.when(F.length(dotted) == 2, F.upper(dotted)).otherwise(F.col("state"))))
    df = df.withColumn("state", F.when((F.length("state") == 2) | (F.lower("state") != F.lower(F.coalesce("city", F.lit("")))), F.col("state")))
    for c in ("venue", "city"):
        shouted = F.col(c).rlike("[A-Z]{2}") & (F.upper(F.col(c)) == F.col(c)) & ~F.col(c).rlike("[0-9]")
        df = df.withColumn(c, F.when(shouted, title_case(F.col(c))).otherwise(F.col(c)))
    return df


def resolve(df: DataFrame, places: DataFrame, states: DataFrame, countries: DataFrame, votes: DataFrame, ratio: float = 15.0) -> DataFrame:
    """R-13: key columns kept, adds region and how.

    In order: a code that exists (of the city, where the city is known); a state's name; a country's name or alias
    leads to the city's region in it; without a state, what the library says of the city (``votes``: city_key, state),
    then the dominant place of that name. Null if nothing does.
    """
    hits = places.select(city_key(F.col("name")).alias("ck"), "admin", "cc", "pop")
    any_hit = hits.groupBy("ck").agg(F.collect_set("admin").alias("admins"))  # as many as places share a name
    lone = merging.dominant(hits, ["ck"], "admin", "pop", ratio).select("ck", F.col("admin").alias("dominant"))
    inside = merging.dominant(hits, ["ck", "cc"], "admin", "pop", ratio).select("ck", "cc", F.col("admin").alias("in_country"))
    names = states.groupBy(fold(F.col("name")).alias("sk")).agg(F.min("code").alias("named"))
    lands = countries.select("code", F.explode(F.array_distinct(F.concat(F.array("name"), F.coalesce("aliases", F.array().cast("array<string>"))))).alias("alias")).select(fold(F.col("alias")).alias("sk"), F.col("code").alias("land")).distinct()
    lands = lands.groupBy("sk").agg(F.min("land").alias("land"))
    codes = states.select(F.col("code").alias("up"), F.lit(True).alias("is_code"))
    # Several spellings of a city may have one key: their votes must agree.
    voted = votes.groupBy(fold(F.col("city_key")).alias("ck")).agg(F.min("state").alias("vote"), F.max("state").alias("other")).filter("vote = other").drop("other")
    own = df.columns
    x = df.withColumn("ck", city_key(F.coalesce("city", F.lit("")))).withColumn("sk", fold(F.coalesce("state", F.lit("")))).withColumn("up", F.upper(F.trim(F.coalesce("state", F.lit("")))))
    x = x.join(any_hit, "ck", "left").join(lone, "ck", "left").join(names, "sk", "left").join(lands, "sk", "left").join(codes, "up", "left").join(voted, "ck", "left")
    x = x.join(inside.withColumnRenamed("cc", "land"), ["ck", "land"], "left")
    fits = F.col("is_code") & (F.col("admins").isNull() | F.array_contains("admins", F.col("up")))
    known = F.coalesce("state", F.lit("")) != ""
    how = F.when(fits, "code").when(F.col("named").isNotNull(), "name").when(F.col("in_country").isNotNull(), "country").when(F.col("is_code"), "code").when(~known & F.col("vote").isNotNull(), "library").when(~known & F.col("dominant").isNotNull(), "dominant")
    region = F.when(how == "code", F.col("up")).when(how == "name", F.col("named")).when(how == "country", F.col("in_country")).when(how == "library", F.col("vote")).when(how == "dominant", F.col("dominant"))
    return x.select(*own, region.alias("region"), how.alias("how"))


def shift(df: DataFrame, places: DataFrame, states: DataFrame) -> DataFrame:
    """R-14: where the state is a city's name, the city is none and the venue is missing, all moves one place up."""
    cities = places.select(city_key(F.col("name")).alias("k")).distinct()
    regions = states.select(fold(F.col("name")).alias("k")).distinct()
    own = df.columns
    x = df.withColumn("__s", city_key(F.coalesce("state", F.lit("")))).withColumn("__c", city_key(F.coalesce("city", F.lit(""))))
    x = x.join(cities.select(F.col("k").alias("__s"), F.lit(True).alias("state_is_city")), "__s", "left").join(cities.select(F.col("k").alias("__c"), F.lit(True).alias("city_is_city")), "__c", "left").join(regions.select(F.col("k").alias("__s"), F.lit(True).alias("state_is_state")), "__s", "left")
    move = F.coalesce("state_is_city", F.lit(False)) & ~F.coalesce("city_is_city", F.lit(False)) & ~F.coalesce("state_is_state", F.lit(False)) & (F.coalesce("venue", F.lit("")) == "")
    return x.select(*[c for c in own if c not in ("venue", "city", "state")], F.when(move, F.col("city")).otherwise(F.col("venue")).alias("venue"), F.when(move, F.col("state")).otherwise(F.col("city")).alias("city"), F.when(~move, F.col("state")).alias("state"), move.alias("moved"))


def best_per_name(places: DataFrame) -> DataFrame:
    """SRC-24: the most populous place of each folded name."""
    k = places.withColumn("key", city_key(F.col("name")))
    return k.withColumn("__r", F.row_number().over(W.partitionBy("key").orderBy(F.desc("pop"), "gid"))).filter("__r = 1").drop("__r")
