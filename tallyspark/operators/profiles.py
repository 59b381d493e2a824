"""Which profile reads a file: the one whose required columns the file's header has."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def containing(headers: DataFrame, profiles: DataFrame) -> DataFrame:
    """(path, profile) where the header of headers(path, header) has every column of profiles(profile, required).

    Profiles meet files through the one of their columns that the fewest headers have, so a column that all have joins
    nothing; then the columns that a file has of its candidates are counted. Profiles that require nothing contain nothing.
    """
    held = headers.select("path", F.explode("header").alias("column")).distinct()
    wanted = profiles.select("profile", F.explode("required").alias("column")).distinct()
    needed = wanted.groupBy("profile").agg(F.count(F.lit(1)).alias("needed"))
    spread = held.join(wanted.select("column").distinct(), "column", "left_semi").groupBy("column").agg(F.count(F.lit(1)).alias("files"))
    rarest = wanted.join(spread, "column", "left").groupBy("profile").agg(F.min(F.struct(F.coalesce("files", F.lit(0)).alias("files"), "column"))["column"].alias("column"))
    candidates = held.join(rarest, "column").select("path", "profile")
    met = candidates.join(wanted, "profile").join(held, ["path", "column"]).groupBy("path", "profile").agg(F.count(F.lit(1)).alias("found"))
    return met.join(needed, "profile").filter("found = needed").select("path", "profile")


def select_profiles(headers: DataFrame, profiles: DataFrame, mapped: DataFrame | None = None) -> DataFrame:
    """path, profile, status and candidates of every file.

    mapped: path, profile, what the user has said. In order: mapped, matched (one profile's columns are all there),
    ambiguous (of several, with their names), only (there is but one profile), undetected.
    """
    fits = containing(headers, profiles).groupBy("path").agg(F.array_sort(F.collect_list("profile")).alias("candidates"))
    two = [r.profile for r in profiles.select("profile").distinct().limit(2).collect()]
    only = F.lit(two[0] if len(two) == 1 else None).cast("string")
    rows = headers.select("path").distinct().join(fits, "path", "left").withColumn("candidates", F.coalesce("candidates", F.array().cast("array<string>")))
    said = F.lit(None).cast("string")
    if mapped is not None:
        rows, said = rows.join(mapped.select("path", F.col("profile").alias("said")), "path", "left"), F.col("said")
    n = F.size("candidates")
    status = F.when(said.isNotNull(), "mapped").when(n == 1, "matched").when(n > 1, "ambiguous").when(only.isNotNull(), "only").otherwise("undetected")
    profile = F.when(said.isNotNull(), said).when(n == 1, F.get("candidates", F.lit(0))).when(n == 0, only)
    return rows.select("path", profile.alias("profile"), status.alias("status"), "candidates")
