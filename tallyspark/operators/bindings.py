"""Accounts that sources name, bound to owned accounts; profiles chosen by file name."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def glob_pattern(pattern: str) -> str:
    """A shell pattern as a regular expression for the whole name: * any run, ? one character, [...] and [!...] sets."""
    out, i = [], 0
    while i < len(pattern):
        end = pattern.find("]", i + 2) if pattern[i] == "[" else -1
        if pattern[i] == "*":
            out.append(".*")
        elif pattern[i] == "?":
            out.append(".")
        elif end > 0:
            inner = re.sub(r"([\\\[\]^&~])", r"\\\1", pattern[i + 1 : end].removeprefix("!"))
            out.append(f"[{'^' if pattern[i + 1] == '!' else ''}{inner}]")
            i = end
        else:
            out.append(re.sub(r"([^\w\s])", r"\\\1", pattern[i]))
        i += 1
    return "(?s)^" + "".join(out) + r"\z"


def filename_mapping(name: Column, mappings: list[tuple[str, str, str]]) -> Column:
    """struct(profile, binding, status) for a file name by (pattern, profile, binding): none, mapped or conflict.

    Every pattern is tried in one narrow pass, without a join; matches that disagree are a conflict.
    """
    none = F.lit(None).cast("string")
    if not mappings:
        return F.struct(none.alias("profile"), none.alias("binding"), F.lit("none").alias("status"))
    hits = F.array_distinct(F.array_compact(F.array(*(F.when(name.rlike(glob_pattern(p)), F.struct(F.lit(profile).alias("profile"), F.lit(binding).alias("binding"))) for p, profile, binding in mappings))))
    one = F.size(hits) == 1
    first = F.try_element_at(hits, F.lit(1))
    status = F.when(one, "mapped").when(F.size(hits) == 0, "none").otherwise("conflict")
    return F.struct(F.when(one, first["profile"]).alias("profile"), F.when(one, first["binding"]).alias("binding"), status.alias("status"))


def bind_accounts(rows: DataFrame, bindings: DataFrame) -> DataFrame:
    """rows with account_id, account and owner of their binding, and covered: whether the binding knows the account.

    rows: binding_id (null: unbound, left as they are), account_id, account, owner; bindings: binding_id,
    source_account_id, account_id, account, owner. A bound row that is not covered keeps its values; see uncovered().
    """
    b = bindings.select("binding_id", F.col("source_account_id").alias("__source"), *(F.col(c).alias(f"__{c}") for c in ("account_id", "account", "owner")))
    joined = rows.join(b, (rows["binding_id"] == b["binding_id"]) & (rows["account_id"] == b["__source"]), "left").drop(b["binding_id"])
    changed = {c: F.coalesce(f"__{c}", c).alias(c) for c in ("account_id", "account", "owner")}
    return joined.select(*(changed.get(c, F.col(c)) for c in rows.columns), (F.col("binding_id").isNull() | F.col("__source").isNotNull()).alias("covered"))


def uncovered(bound: DataFrame) -> DataFrame:
    """Bindings that miss accounts, and how many; an import is refused unless this is empty."""
    return bound.filter(~F.col("covered")).groupBy("binding_id").agg(F.countDistinct("account_id").alias("missing"))


def bound_owners(occurrences: DataFrame, groups: DataFrame) -> DataFrame:
    """canonical_id, owner and conflict: the binding owner of any source occurrence holds for its canonical rows.

    occurrences: id, group_id, owner (null: unbound); groups: group_id, canonical_id. Groups without a bound occurrence
    are left out; two owners in one group are a conflict, without an owner.
    """
    owners = occurrences.filter("owner is not null").groupBy("group_id").agg(F.min("owner").alias("low"), F.max("owner").alias("high"))
    joined = groups.join(owners, "group_id")
    return joined.select("canonical_id", F.when(F.col("low") == F.col("high"), F.col("low")).alias("owner"), (F.col("low") != F.col("high")).alias("conflict"))
