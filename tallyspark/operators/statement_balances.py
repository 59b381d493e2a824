"""Opening and closing balances that statement pages state: merged, reduced over pages, attached to rows, conflicts."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallyspark.functions.text import safe_decimal

TARGET = ["file", "account_id", "section", "currency"]
OBSERVED = "file string, account_id string, section string, currency string, kind string, value decimal(20,2), page int, line int"


def merge_observations(observed: DataFrame) -> DataFrame:
    """Values that several readers of a statement saw: TARGET, kind, value, n (the most that one reader saw), pages.

    observed: reader, TARGET, kind, value, page. Observations travel once, to their target, and one aggregate lists what saw
    a value: the import bounds the pages of a file. The currency, often one for all, does not deal them.
    """
    seen = observed.repartition(*TARGET[:3]).groupBy(*TARGET, "kind", "value").agg(F.collect_list(F.struct("reader", "page")).alias("seen"))
    by = F.col("seen.reader")
    times = F.transform(F.array_distinct(by), lambda r: F.size(F.filter(by, lambda x: x.eqNullSafe(r))))
    return seen.select(*TARGET, "kind", "value", F.array_max(times).cast("long").alias("n"), F.array_sort(F.array_distinct(F.array_compact("seen.page"))).alias("pages"))


def reduce_over_pages(observed: DataFrame) -> DataFrame:
    """Observations (TARGET, kind, value, page, line, and reader if there is one) of statements whose pages carry balances over.

    Several openings and closings of a target, as one reader sees it, are one of each if every page states one value of a
    kind, each later opening repeats a closing of an earlier page, and all closings but the last are used up so. Of the
    openings and of the closings with one value, taken by page, the first then meets the first, and so on. Otherwise all
    stay and are in conflict. A target is one section of one statement file; the import bounds the pages of a file.
    """
    key = [*TARGET, *(c for c in ("reader",) if c in observed.columns)]
    is_opening = F.col("kind") == "opening"
    page_of = lambda which, how: how(F.when(which, F.col("page")))
    sides = observed.groupBy(*key, "kind", "page").agg(F.min("value").alias("value"), F.count_distinct("value").alias("values"))
    whole = sides.groupBy(*key).agg(
        (F.max("values") == 1).alias("single"), page_of(is_opening, F.min).alias("first"), page_of(is_opening, F.max).alias("last_opening"), page_of(~is_opening, F.max).alias("last"),
        F.greatest(F.count_distinct(F.when(is_opening, F.col("value"))), F.count_distinct(F.when(~is_opening, F.col("value")))).alias("most"),
    ).filter("single and first is not null and last is not null and most > 1 and last >= last_opening")
    inner = sides.join(whole.select(*key, "first", "last"), key).filter((is_opening & (F.col("page") != F.col("first"))) | (~is_opening & (F.col("page") != F.col("last"))))
    ranked = inner.withColumn("rank", F.row_number().over(Window.partitionBy(*key, "kind", "value").orderBy("page")))
    met = ranked.groupBy(*key, "value", "rank").agg(page_of(is_opening, F.max).alias("opens"), page_of(~is_opening, F.max).alias("closed"))
    broken = met.filter(~F.coalesce(F.col("closed") < F.col("opens"), F.lit(False))).select(*key).distinct()
    carried = whole.join(broken, key, "left_anti").select(*key, "first", "last")
    joined = observed.join(carried, key, "left")
    end = F.when(is_opening, F.col("first")).otherwise(F.col("last"))
    # A page may state its value more than once.
    joined = joined.withColumn("place", F.row_number().over(Window.partitionBy(*key, "kind", "page").orderBy("line")))
    return joined.filter(F.col("first").isNull() | ((F.col("page") == end) & (F.col("place") == 1))).select(*observed.columns)


def attach_balances(rows: DataFrame, balances: DataFrame) -> DataFrame:
    """rows with opening and closing, and flags of conflicts with their pages.

    rows: id, file, account_id, section, currency, position, the array flags. balances: TARGET, kind, value, pages. The
    opening goes to the first row of a target, the closing to the last. Balances without a section that no rows have go
    to the only section of the account and currency, if there is one. Several values leave the row without a balance.
    """
    ends = rows.groupBy(*TARGET).agg(F.min_by("id", "position").alias("opening"), F.max_by("id", "position").alias("closing"))
    whole = [c for c in TARGET if c != "section"]
    lone = ends.groupBy(*whole).agg(F.count(F.lit(1)).alias("n"), F.min("opening").alias("lone_opening"), F.min("closing").alias("lone_closing")).filter("n = 1").drop("n")
    stated = balances.groupBy(*TARGET, "kind").agg(
        F.min("value").alias("low"), F.max("value").alias("high"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("pages")))).alias("pages")
    )
    # Only what has no section may go elsewhere; the texts of flags are made where they are put on a row.
    conflict = F.col("low") != F.col("high")
    at = lambda placed, pick: placed.select(pick.alias("id"), "kind", F.when(~conflict, F.col("low")).alias("value"), F.when(conflict, F.struct("kind", "pages")).alias("mark"))
    own = F.when(F.col("kind") == "opening", F.col("opening")).otherwise(F.col("closing"))
    elsewhere = F.when(F.col("kind") == "opening", F.col("lone_opening")).otherwise(F.col("lone_closing"))
    named = at(stated.filter("section <> ''").join(ends, TARGET), own)
    bare = at(stated.filter("section = ''").join(ends, TARGET, "left").join(lone, whole, "left"), F.coalesce(own, elsewhere))
    found = named.union(bare).filter("id is not null")
    by_row = found.groupBy("id").agg(*(F.max(F.when(F.col("kind") == k, F.col("value"))).alias(k) for k in ("opening", "closing")), F.collect_list("mark").alias("marks"))
    name = lambda m: F.concat(F.lit("statement_"), m["kind"], F.lit("_balance_conflict"))
    flags = F.transform("marks", lambda m: F.concat(F.array(name(m)), F.transform(m["pages"], lambda p: F.concat(name(m), F.lit("_page_"), p.cast("string")))))
    joined = rows.join(by_row.withColumn("more", F.array_sort(F.flatten(flags))).drop("marks"), "id", "left")
    return joined.withColumn("flags", F.when(F.col("more").isNotNull(), F.array_union("flags", "more")).otherwise(F.col("flags"))).drop("more")


def conflict_contexts(rows: DataFrame, kind: str, statement: list[str]) -> DataFrame:
    """Where statements contradict themselves: statement, source_file, source_page, section; distinct.

    rows: statement columns, source_file, source_page, section, flags, and statement_<kind>_balance as text. Marked rows
    count with their marked pages, or their own; rows with a balance count where the statement's balances differ.
    """
    field, mark = f"statement_{kind}_balance", f"statement_{kind}_balance_conflict"
    text = F.trim(F.coalesce(F.col(field), F.lit("")))
    value = safe_decimal(text)
    differs = rows.filter(text != "").groupBy(*statement).agg(F.bool_and(value.isNotNull()).alias("sound"), F.min(value).alias("low"), F.max(value).alias("high"))
    joined = rows.join(differs.filter("sound and low < high").select(*statement, F.lit(True).alias("__differs")), statement, "left")
    chosen = joined.filter(F.array_contains("flags", mark) | (F.col("__differs") & (text != "")))
    pages = F.transform(F.filter("flags", lambda f: f.rlike(rf"^{mark}_page_\d+\z")), lambda f: F.substring(f, len(mark) + 7, 20))
    page = F.explode(F.when(F.size(pages) > 0, pages).otherwise(F.array(F.col("source_page"))))
    return chosen.select(*statement, "source_file", page.alias("source_page"), "section").distinct()
