"""Statements of several accounts: transactions under section headings, and the balances that lines state.

What a line is (a heading, a table header, an end) is told by columns. What it means depends on the lines before it: windows
over a file's lines number the regions that headings begin, the tables that headers begin in them and the entries that
amounts complete in those, and carry days and currencies on. Files are bounded (MAX_BYTES), and many run side by side.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F



@dataclass
class Account:
    account_id: str
    account: str = ""
    currency: str = ""
    #: No amount may stand before its currency.
    currency_from_row: bool = False


@dataclass
class Sections:
    """How a statement of several accounts reads: headings with their accounts, markers, and bounds [l, r) of its columns.

    date_regex has the groups day and month; the year patterns have year, and may have statement_day and statement_month.
    """

    accounts: dict[str, Account]
    columns: dict[str, tuple[float, float]] = field(default_factory=dict)
    date_regex: str = ""
    amount_regex: str = r"^-?\d[\d,]*\.\d{2}$"
    currency_regex: str = r"^[A-Z]{3}$"
    year_regex: str = ""
    file_year_regex: str = ""
    header: list[str] = field(default_factory=list)
    ends: list[str] = field(default_factory=list)
    skip: list[str] = field(default_factory=list)
    table_ends: list[str] = field(default_factory=list)


@dataclass
class BalanceLine:
    """Patterns (group balance, and balance_sign CR or DR where it is stated) of opening and closing balances.

    With section the pattern counts below that heading only, and the heading's account is meant; currency_group names the
    group that holds the currency.
    """

    opening: str = ""
    closing: str = ""
    section: str = ""
    account_id: str = ""
    currency: str = ""
    currency_group: str = ""
    closing_requires_opening: bool = False


def _fold(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(text), r"\s+", " "))


def _plain(text: str) -> str:
    return " ".join(text.lower().split())


def _holds(markers: list[str], every: bool = False) -> Column:
    """Whether the folded line holds one (or every one) of the markers; without markers it does not."""
    test = F.forall if every else F.exists
    return test(F.array(*(F.lit(m.lower()) for m in markers)), lambda m: F.contains(F.col("folded"), m)) if markers else F.lit(False)


def _heading(sections: Sections, fits) -> Column:
    """The first heading that fits, or null."""
    return F.coalesce(*(F.when(fits(F.col("folded"), _plain(s)), s) for s in sections.accounts), F.lit(None).cast("string"))


def _plain_groups(pattern: str) -> str:
    """The pattern with plain groups: Spark's regular expressions take no names with an underscore."""
    return re.sub(r"\(\?P<\w+>", "(", pattern)


def _group(text: Column, pattern: str, *names: str) -> Column:
    """What the first of the named groups that the pattern has holds in text; '' where it holds nothing or nothing matches."""
    known = re.compile(pattern).groupindex
    held = [F.nullif(F.regexp_extract(text, _plain_groups(pattern), known[n]), F.lit("")) for n in names if n in known]
    return F.coalesce(*held, F.lit(""))


def _month(text: Column) -> Column:
    """The number of a month that is given as such or by a name that begins like the English one."""
    name = F.concat(F.upper(F.substring(text, 1, 1)), F.lower(F.substring(text, 2, 2)))
    return F.coalesce(text.try_cast("int"), F.month(F.try_to_date(F.concat(F.lit("1 "), name, F.lit(" 2000")), "d MMM yyyy")))


def _stated_year(sections: Sections) -> Column:
    """The year as text and the number of the month that the line states for its statement, after page and line; null on other lines."""
    if not sections.year_regex:
        return F.lit(None).cast("struct<page:int,line:int,year:string,month:int>")
    text = F.col("text")
    month = _month(F.nullif(_group(text, sections.year_regex, "statement_month"), F.lit("")))
    return F.when(text.rlike(_plain_groups(sections.year_regex)), F.struct("page", "line", _group(text, sections.year_regex, "year").alias("year"), month.alias("month")))


def _statement_ends(sections: Sections) -> tuple[Column, Column]:
    """Year and month in which a line's statement ends, from what its file says first (said), or else from the file's name."""
    name, said = F.element_at(F.split("path", "/"), -1), F.col("said")
    other = (lambda *names: _group(name, sections.file_year_regex, *names)) if sections.file_year_regex else (lambda *names: F.lit(""))
    year = F.nullif(F.coalesce(said["year"], other("year")), F.lit("")).cast("int")
    month = F.when(said.isNotNull(), said["month"]).otherwise(_month(F.nullif(other("statement_month"), F.lit(""))))
    return year, F.coalesce(month, F.lit(12))


def section_rows(lines: DataFrame, sections: Sections) -> DataFrame:
    """The transactions (path, page, line, date, description, deposit, withdrawal, account_id, account, section, currency) of lines (path, page, line, text, words) below the headings of their accounts.

    Below a heading the table begins after the line that holds every header marker. A line's description is kept until a
    line with an amount completes the transaction; a day holds until the next one, for each account, and so does a
    currency. A month after the statement's month belongs to the year before. Amounts of 0 and skipped descriptions go;
    both a deposit and a withdrawal, an amount without a day, and a statement without a year are errors.
    """
    inside = lambda c: F.filter("words", lambda w: (w["x0"] >= sections.columns[c][0]) & (w["x0"] < sections.columns[c][1])) if c in sections.columns else F.array().cast("array<struct<text:string,x0:double,top:double>>")
    texts = lambda c: F.transform(inside(c), lambda w: w["text"])
    amounts = lambda c: F.filter(texts(c), lambda t: t.rlike(sections.amount_regex))
    dated = F.col("text").rlike(_plain_groups(sections.date_regex)) if sections.date_regex else F.lit(False)
    told = lines.withColumn("folded", _fold(F.col("text"))).select(
        "path", "page", "line",
        _heading(sections, lambda text, s: text.isin(s, f"account: {s}")).alias("heading"), _holds(sections.ends).alias("ends"), _holds(sections.header, every=True).alias("header"),
        F.when(dated, _group(F.col("text"), sections.date_regex, "day")).alias("day"), F.when(dated, _group(F.col("text"), sections.date_regex, "month")).alias("month"),
        amounts("deposit").alias("deposits"), amounts("withdrawal").alias("withdrawals"), F.array_join(texts("description"), " ").alias("own_text"), _stated_year(sections).alias("stated_year"),
        F.get(F.filter(F.transform(texts("currency"), F.upper), lambda t: t.rlike(sections.currency_regex)), F.lit(0)).alias("own_currency"),
    )
    into, out = F.size("deposits") > 0, F.size("withdrawals") > 0
    told = told.withColumns({"amount": into | out, "into": into, "both": into & out, "figure": F.coalesce(F.get("deposits", F.lit(0)), F.get("withdrawals", F.lit(0)))}).drop("deposits", "withdrawals")
    # An end among the lines of a table is only one if nothing else stands on it.
    busy = F.col("day").isNotNull() | F.col("amount") | (F.col("own_text") != "")
    told = told.withColumns({"bare_end": F.col("heading").isNull() & F.col("ends") & ~busy, "busy_end": F.col("heading").isNull() & F.col("ends") & busy}).drop("ends")
    return _completed(_alive(_entries(_tables(told, sections), sections)), sections)


def _before(*keys: str):
    return Window.partitionBy(*keys).orderBy("page", "line").rowsBetween(Window.unboundedPreceding, -1)


def _until(*keys: str):
    return Window.partitionBy(*keys).orderBy("page", "line").rowsBetween(Window.unboundedPreceding, Window.currentRow)


def _in_runs(frame_end: int):
    """A file's lines in the order of _entries: that of pages and lines, with the run before them."""
    return Window.partitionBy("path").orderBy("run", "page", "line").rowsBetween(Window.unboundedPreceding, frame_end)


def _tables(told: DataFrame, sections: Sections) -> DataFrame:
    """Lines below headings, with region (a heading or a bare end begins one), table (a number that each region and each
    header in it raises), opened (whether a header came in the region), run (a number that each table and each amount before
    the line raises) and the statement's year and month.

    The numbers only grow over a file, so lines with the same one stand together and need no sort by it.
    """
    begins = F.col("heading").isNotNull() | F.col("bare_end")
    count = lambda which: F.coalesce(F.sum(which.cast("int")).over(_until("path")), F.lit(0))
    before = F.coalesce(F.sum((F.col("amount") & ~F.col("header")).cast("int")).over(_before("path")), F.lit(0))
    whole = Window.partitionBy("path").orderBy("page", "line").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    rows = told.withColumns({
        "region": count(begins), "headers": count(F.col("header")), "amounts": before, "said": F.min("stated_year").over(whole),
        "section": F.last(F.when(begins, F.struct("heading")), ignorenulls=True).over(_until("path"))["heading"],
        "opened": F.last(F.when(begins, False).when(F.col("header"), True), ignorenulls=True).over(_until("path")),
    })
    year, month = _statement_ends(sections)
    missing = F.raise_error(F.concat(F.lit("no statement year: "), F.col("path"))).cast("boolean")
    rows = rows.filter(F.when(year.isNull(), missing).otherwise(F.col("section").isNotNull() & ~begins))
    table = F.col("region") + F.col("headers")
    rows = rows.withColumns({"opened": F.coalesce("opened", F.lit(False)), "table": table, "run": table + F.col("amounts"), "year": year, "last_month": month})
    return rows.drop("headers", "amounts", "said", "stated_year", "heading", "bare_end")


def _entries(rows: DataFrame, sections: Sections) -> DataFrame:
    """rows with text (the description so far of its entry), skipped and closing (a skipped description that ends the table).

    Words of an entry that hold a skipped description do not count for what follows in it.
    """
    so_far = F.collect_list(F.nullif(F.when(F.col("header"), "").otherwise(F.col("own_text")), F.lit(""))).over(_until("path", "run"))
    holds = lambda text, markers: reduce(lambda a, b: a | b, (F.contains(F.lower(text), F.lit(m.lower())) for m in markers), F.lit(False))
    joined = lambda a, b: F.concat_ws(" ", F.nullif(a, F.lit("")), b)
    rest = lambda parts: F.aggregate(parts, F.lit(""), lambda text, part: F.when(holds(joined(text, part), sections.skip), "").otherwise(joined(text, part)))
    rows = rows.withColumn("parts", so_far)
    own = F.when(F.col("header") | (F.col("own_text") == ""), F.lit(None)).otherwise(F.col("own_text"))
    earlier = F.when(own.isNull(), F.col("parts")).otherwise(F.slice("parts", F.lit(1), F.size("parts") - 1))
    rows = rows.withColumn("text", joined(rest(earlier), own)).drop("parts", "own_text")
    skipped = F.col("opened") & ~F.col("header") & holds(F.col("text"), sections.skip)
    return rows.withColumns({"skipped": skipped, "closing": skipped & holds(F.col("text"), sections.table_ends)})


def _alive(rows: DataFrame) -> DataFrame:
    """The lines of tables that are open: a closing line is its table's last, and an end outside an open table is the last
    of its region's tables."""
    last = lambda which, number: F.coalesce(F.last(F.when(which, F.col(number)), ignorenulls=True).over(_in_runs(-1)) == F.col(number), F.lit(False))
    rows = rows.withColumn("closed", last(F.col("closing"), "table"))
    rows = rows.withColumn("ended", last(F.col("busy_end") & (~F.col("opened") | F.col("closed")), "region"))
    return rows.filter(F.col("opened") & ~F.col("header") & ~F.col("closed") & ~F.col("ended"))


def _completed(rows: DataFrame, sections: Sections) -> DataFrame:
    """A transaction for each line with an amount, with the day and the currency that hold there."""
    of = lambda value: reduce(lambda rest, s: F.when(F.col("section") == s, F.lit(value(sections.accounts[s]))).otherwise(rest), sections.accounts, F.lit(None))
    told = rows.withColumns({"account_id": of(lambda a: a.account_id), "account": of(lambda a: a.account), "stated": of(lambda a: a.currency), "needs": of(lambda a: a.currency_from_row)})
    month = _month(F.col("month"))
    told = told.withColumn("own_day", F.when(F.col("day").isNotNull(), F.make_date(F.col("year") - (month > F.col("last_month")).cast("int"), month, F.col("day").cast("int"))))
    ids = sorted({a.account_id for a in sections.accounts.values()})
    # One window for each account keeps the order of the file.
    held = lambda c, a: F.last(F.when(F.col("account_id") == a, F.col(c)), ignorenulls=True).over(_in_runs(Window.currentRow))
    kept = told.withColumns({f"{c}_{i}": held(c, a) for c in ("own_day", "own_currency") for i, a in enumerate(ids)})
    here = lambda c: F.coalesce(*(F.when(F.col("account_id") == a, F.col(f"{c}_{i}")) for i, a in enumerate(ids)), F.lit(None))
    done = kept.filter("amount and not skipped").withColumns({"date": here("own_day"), "currency": F.coalesce(here("own_currency"), F.col("stated"))})
    where = F.concat(F.col("path"), F.lit(" page "), F.col("page").cast("string"), F.lit(" line "), F.col("line").cast("string"))
    worth = F.regexp_replace("figure", ",", "").cast("decimal(30,2)") != 0
    early = F.col("date").isNull() | (F.col("needs") & (F.col("currency") == ""))
    problem = F.when(F.col("both"), "deposit and withdrawal in one line: ").when(worth & early, "amount before its date or currency: ")
    keep = F.when(problem.isNotNull(), F.raise_error(F.concat(problem, where)).cast("boolean")).otherwise(worth)
    return done.filter(keep).select(
        "path", "page", "line", "date", F.when(F.col("text") == "", "Bank transaction").otherwise(F.col("text")).alias("description"), F.when(F.col("into"), F.col("figure")).otherwise("").alias("deposit"),
        F.when(F.col("into"), "").otherwise(F.col("figure")).alias("withdrawal"), "account_id", "account", "section", "currency",
    )


def balance_lines(pages: DataFrame, lines: DataFrame) -> DataFrame:
    """What both readers of a page see: reader, path, page, line, text, continued (a further line within table cells).

    pages: path, page, tables (rows of cells); lines: path, page, line, text. Lines without text go.
    """
    rows = pages.select("path", "page", F.posexplode(F.flatten("tables")).alias("row", "cells"))
    parts = F.transform("cells", lambda c: F.split(F.coalesce(c, F.lit("")), "\n"))
    rows = rows.withColumn("parts", parts).select("path", "page", "row", "parts", F.explode(F.sequence(F.lit(0), F.array_max(F.transform("parts", F.size)) - 1)).alias("part"))
    text = F.array_join(F.filter(F.transform("parts", lambda p: F.trim(F.coalesce(F.get(p, F.col("part")), F.lit("")))), lambda t: t != ""), " ")
    table = rows.select(F.lit("tables").alias("reader"), "path", "page", (F.col("row") * 10_000 + F.col("part")).alias("line"), text.alias("text"), (F.col("part") > 0).alias("continued"))
    return table.unionByName(lines.select(F.lit("words").alias("reader"), "path", "page", "line", "text", F.lit(False).alias("continued"))).filter("text <> ''")


def balance_observations(lines: DataFrame, sections: Sections, mappings: list[BalanceLine]) -> DataFrame:
    """Opening and closing balances (reader, file, account_id, section, currency, kind, value, page, line) that the lines of balance_lines state, for each reader.

    A heading alone on its line always begins a section; within other text it does so, and an end marker ends one, only
    outside a table of transactions and on lines without date or amount. The header, or a line that states an opening
    balance of whatever account, begins such a table; a table end, or a line that states a closing balance, ends it.
    Sections go on over pages for words, not for tables.
    """
    dated = _plain_groups(sections.date_regex)
    shaped = F.exists(F.split(F.col("text"), r"\s+"), lambda t: t.rlike(sections.amount_regex.replace("^-?", "^[+-]?")))
    if dated:
        shaped = shaped | F.col("text").rlike(dated)
    states = lambda kind: reduce(lambda a, b: a | b, (F.col("text").rlike(_any_case(p)) for m in mappings if (p := getattr(m, kind))), F.lit(False))
    told = lines.withColumn("folded", _fold(F.col("text"))).select(
        "reader", "path", "page", "line", "text", (F.col("continued") | shaped).alias("fixed"),
        _heading(sections, lambda text, s: text == s).alias("alone"), _heading(sections, lambda text, s: F.contains(text, F.lit(s))).alias("within"),
        _holds(sections.ends).alias("ends"), _holds(sections.header, every=True).alias("header"), _holds(sections.table_ends).alias("closes"),
        states("opening").alias("opens"), states("closing").alias("shuts"),
    )
    # Tables lose their section from page to page.
    file = ["path", "reader", "part"]
    told = told.withColumn("part", F.when(F.col("reader") == "tables", F.col("page")).otherwise(-1))
    alone = F.col("alone").isNotNull() & ~F.col("fixed")
    told = told.withColumn("region", F.sum(alone.cast("int")).over(_until(*file)))
    turn = F.when(F.col("shuts") | F.col("closes"), 0).when(F.col("header") | F.col("opens"), 1)
    in_table = F.coalesce(F.last(turn, ignorenulls=True).over(_before(*file, "region")), F.lit(0)) == 1
    told = told.withColumn("in_table", in_table)
    free = ~F.col("fixed") & ~F.col("in_table")
    moved = F.when(alone, F.col("alone")).when(free & F.col("within").isNotNull(), F.col("within")).when(free & F.col("ends"), "")
    told = told.withColumn("moved", moved).withColumn("current", F.coalesce(F.last("moved", ignorenulls=True).over(_until(*file)), F.lit("")))
    return _observed(told, sections, mappings)


def _any_case(pattern: str) -> str:
    return "(?i)" + _plain_groups(pattern)


def _observed(told: DataFrame, sections: Sections, mappings: list[BalanceLine]) -> DataFrame:
    """The balances of lines whose current section is known: one projection for each pattern."""
    parts = []
    for n, m in enumerate(mappings):
        account_id = sections.accounts[m.section].account_id if m.section else m.account_id
        own = [s for s, a in sections.accounts.items() if a.account_id == account_id]
        for k, kind in enumerate(("opening", "closing")):
            if pattern := getattr(m, kind):
                text, sought = F.col("text"), f"(?i){pattern}"
                figure = F.trim(F.regexp_replace(_group(text, sought, "balance", "total_balance"), ",", ""))
                value = F.coalesce(figure.try_cast("decimal(30,10)"), F.raise_error(F.lit("a balance line without a balance")).cast("decimal(30,10)"))
                sign = F.lower(_group(text, sought, "balance_sign"))
                signed = F.when(sign == "cr", F.abs(value)).when(sign != "", -F.abs(value)).otherwise(value)
                currency = _group(text, sought, m.currency_group) if m.currency_group else F.lit(m.currency)
                rows = told.filter(text.rlike(_any_case(pattern)) & (F.col("current") == m.section if m.section else F.lit(True)))
                parts.append(rows.select(
                    "reader", F.col("path").alias("file"), F.lit(account_id).alias("account_id"), (F.lit(m.section) if m.section else F.when(F.col("current").isin(*own), F.col("current")).otherwise("")).alias("section"),
                    F.upper(currency).alias("currency"), F.lit(kind).alias("kind"), F.bround(signed, 2).cast("decimal(20,2)").alias("value"), "page", "line",
                    F.struct("page", "line", F.lit(n).alias("mapping"), F.lit(k).alias("kind")).alias("at"), F.lit(kind == "closing" and m.closing_requires_opening).alias("bound"),
                ))
    found = reduce(DataFrame.unionByName, parts)
    # A closing that needs an opening counts as the first after one, if no other closing came before.
    target = Window.partitionBy("reader", "file", "account_id", "section", "currency")
    at = lambda which: F.min(F.when(which, F.col("at"))).over(target)
    found = found.withColumns({"opened": at(F.col("kind") == "opening"), "free": at((F.col("kind") == "closing") & ~F.col("bound"))})
    found = found.withColumn("first_bound", at(F.col("bound") & (F.col("at") > F.col("opened"))))
    counts = ~F.col("bound") | ((F.col("at") == F.col("first_bound")) & (F.col("free").isNull() | (F.col("free") > F.col("at"))))
    return found.filter(counts).select("reader", "file", "account_id", "section", "currency", "kind", "value", "page", "line")
