"""Weather lookups: known places by name, observations from a capability, every failure as a row with its reason."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .capabilities import Capability, apply

#: What a failure's text means to a reader; the first that fits.
REASONS = (("timed out|timeout", "the service took too long"), ("401", "the key was rejected"), ("404", "no such place"), ("429", "too many requests"), ("not configured", "no service is set up"))


OBSERVATION = "struct<temperature_c:double,description:string,humidity_percent:int,rain_expected:boolean>"
FOUND = "struct<lat:double,lon:double,country:string>"


def located(places: DataFrame, name: str, geocoder: Capability, country: str) -> DataFrame:
    """Places without lat and lon looked up by name: each distinct name once. Ones found in another country stay without."""
    asked = F.lower(F.trim(F.col(name)))
    names = places.where(F.col("lat").isNull() & (asked != "")).select(asked.alias("__name")).distinct()
    got = apply(names, "__name", geocoder, "__found").where(F.col("__found").isNotNull())
    here = F.upper(F.coalesce("__found.country", F.lit("")))
    got = got.where((here == "") | (here == country.upper())).select("__name", F.col("__found.lat").alias("__lat"), F.col("__found.lon").alias("__lon"))
    met = places.join(got, asked == F.col("__name"), "left").withColumns({"lat": F.coalesce("lat", "__lat"), "lon": F.coalesce("lon", "__lon")})
    return met.drop("__name", "__lat", "__lon")


def lookup(places: DataFrame, name: str, known: DataFrame, service: Capability = Capability("weather", kind=OBSERVATION), geocoder: Capability | None = None, country: str = "BD") -> DataFrame:
    """Rows with lat, lon (of ``known``: alias, lat, lon; else by the ``geocoder`` in ``country``), the observation, available and error."""
    k = known.select(F.lower("alias").alias("__a"), "lat", "lon")
    met = places.join(k, F.lower(F.trim(F.col(name))) == F.col("__a"), "left").drop("__a")
    met = met if geocoder is None else located(met, name, geocoder, country)
    asked = apply(met.where("lat is not null").withColumn("__at", F.struct("lat", "lon")), "__at", service, "weather").drop("__at")
    lost = met.where("lat is null").select("*", F.lit(None).cast(service.kind).alias("weather"), F.lit(False).alias("weather_available"), F.lit("404").alias("weather_error"))
    e = F.col("weather_error")
    reason = F.coalesce(*[F.when(e.rlike("(?i)" + p), F.lit(r)) for p, r in REASONS], F.when(e.isNotNull(), F.lit("the service failed")))
    return asked.unionByName(lost).withColumn("error", reason).drop("weather_error")
