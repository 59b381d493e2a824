"""Statement files: CSV by declared profiles, tables and words extracted from pages, and normalisation to ledger rows."""

from __future__ import annotations

import csv
import io
import json
from collections.abc import Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tallyspark.functions.text import clean_cell, money, parsed_amount

#: Largest file that is read (fixed value).
MAX_BYTES = 64 << 20
#: Budget of one file of extracted pages (fixed values).
MAX_PAGES, MAX_CHARS, MAX_ROWS = 500, 20_000_000, 100_000
BALANCE_ROW = r"(?i)\b(?:opening|closing|previous)\s+balance\b"
WORDS = "array<struct<text:string,x0:double,top:double>>"
RAW = "path string, physical_row int, logical_row int, cells map<string,string>"
#: strptime codes and the patterns Spark reads (fixed values).
DATE_CODES = {"%Y": "yyyy", "%m": "MM", "%d": "dd", "%b": "MMM", "%B": "MMMM", "%y": "yy"}


@dataclass
class Profile:
    """What a statement layout means: source columns by canonical field, formats, defaults and sign policy."""

    id: str
    columns: dict[str, str]
    date_formats: list[str] = field(default_factory=lambda: ["%Y-%m-%d"])
    currency: str | None = None
    account_id: str = ""
    account_type: str = "bank"
    institution: str = ""
    debit_values: list[str] = field(default_factory=list)
    credit_values: list[str] = field(default_factory=list)
    default_sign: str | None = None
    statement_year: int | None = None
    skip: list[str] = field(default_factory=list)


def files(spark: SparkSession, folder: str, pattern: str = "*.csv") -> DataFrame:
    """path, length and content of the files right in a folder; oversized files are refused."""
    found = spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(folder)
    guard = F.when(F.col("length") > MAX_BYTES, F.raise_error(F.concat(F.lit("file too large: "), "path"))).otherwise(F.col("content"))
    return found.select("path", "length", guard.alias("content"))


def snapshot(found: DataFrame) -> DataFrame:
    """path, length and sha256 of what was read."""
    return found.select("path", "length", F.sha2("content", 256).alias("sha256"))


def changed_files(before: DataFrame, after: DataFrame) -> DataFrame:
    """path and problem of the files of two snapshots that differ: missing, new, or changed."""
    a, b = before.select("path", F.struct("length", "sha256").alias("was")), after.select("path", F.struct("length", "sha256").alias("now"))
    problem = F.when(F.col("now").isNull(), "missing").when(F.col("was").isNull(), "new").when(F.col("was") != F.col("now"), "changed")
    return a.join(b, "path", "full_outer").select("path", problem.alias("problem")).filter("problem is not null")


def over_budget(found: DataFrame, pages: int = MAX_PAGES, chars: int = MAX_CHARS) -> Column:
    """What a file of extracted pages has too many of (pages, characters), or null; pages are counted before texts are parsed."""
    text = F.col("content").cast("string")
    many = F.coalesce(F.json_array_length(F.get_json_object(text, "$.pages")), F.lit(0)) > pages
    # Word pages hold objects with a text, table pages hold rows of cells; a file as long as its budget is not parsed at all.
    words = F.from_json(text, "pages array<array<struct<text:string>>>")["pages"]
    cells = F.from_json(text, "pages array<struct<tables:array<array<array<string>>>>>")["pages"]
    total = lambda parts: F.aggregate(parts, F.lit(0).cast("long"), lambda n, x: n + F.coalesce(F.length(x), F.lit(0)))
    held = F.coalesce(total(F.flatten(F.flatten(F.flatten(F.transform(cells, lambda p: p["tables"]))))), F.coalesce(total(F.transform(F.flatten(words), lambda w: w["text"])), F.lit(0)))
    return F.when(many, f"more than {pages} pages").when((F.length(text) > chars) & (held > chars), f"more than {chars} characters")


def within_budget(found: DataFrame, pages: int = MAX_PAGES, chars: int = MAX_CHARS) -> DataFrame:
    """found, refusing files over budget before their words or tables are parsed."""
    problem = over_budget(found, pages, chars)
    guard = F.when(problem.isNotNull(), F.raise_error(F.concat(F.lit("file over budget: "), "path", F.lit(": "), problem))).otherwise(F.col("content"))
    return found.withColumn("content", guard)


def within_rows(rows: DataFrame, order: list[str], limit: int = MAX_ROWS) -> DataFrame:
    """rows of files, refusing a file at the first row beyond the limit."""
    n = F.row_number().over(Window.partitionBy("path").orderBy(*order))
    return rows.withColumn("__n", n).filter(F.when(F.col("__n") > limit, F.raise_error(F.concat(F.lit("file over budget: "), "path", F.lit(f": more than {limit} rows"))).cast("boolean")).otherwise(True)).drop("__n")


def csv_headers(found: DataFrame) -> DataFrame:
    """path and header (names without white space around them) of CSV files; an empty file has an empty header."""

    def parse(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            first = [next(csv.reader(io.StringIO(bytes(c).decode("utf-8-sig"), newline="")), []) for c in frame.content]
            yield pd.DataFrame({"path": frame.path, "header": [[h.strip() for h in x] for x in first]})

    return found.select("path", "content").mapInPandas(parse, "path string, header array<string>")


def csv_rows(found: DataFrame) -> DataFrame:
    """One row per record, with the physical line it starts on (quoted cells may span lines) and its number in the file."""

    def parse(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for path, content in zip(frame.path, frame.content, strict=True):
                reader = csv.reader(io.StringIO(bytes(content).decode("utf-8-sig"), newline=""))
                header, out, line = None, [], 0
                for cells in reader:
                    begin, line = line + 1, reader.line_num
                    if header is None:
                        header = [c.strip() for c in cells]
                    elif cells:
                        out.append((path, begin, len(out) + 1, dict(zip(header, cells, strict=False))))
                yield pd.DataFrame(out, columns=["path", "physical_row", "logical_row", "cells"])

    return found.select("path", "content").mapInPandas(parse, RAW)


def table_rows(found: DataFrame, header: list[str], row_regex: str | None = None) -> DataFrame:
    """Rows of extracted tables ({pages: [{tables: [[[cell]]]}]}): path, page, table, row, expanded line and cells.

    Cells of several lines are expanded to as many rows, ragged ones padded with ''. With row_regex (Java named groups
    named by header) the joined cells have to match and the groups become the cells.
    """
    schema = "pages array<struct<tables:array<array<array<string>>>>>"
    pages = within_budget(found).select("path", F.posexplode(F.from_json(F.col("content").cast("string"), schema)["pages"]).alias("page", "p"))
    rows = pages.select("path", "page", F.posexplode("p.tables").alias("table", "t")).select("path", "page", "table", F.posexplode("t").alias("row", "c"))
    lines = F.transform("c", lambda x: F.split(F.coalesce(x, F.lit("")), "\n"))
    count = F.array_max(F.transform("lines", lambda x: F.size(x)))
    spread = rows.select("path", "page", "table", "row", lines.alias("lines")).select("*", F.explode(F.sequence(F.lit(0), count - 1)).alias("line"))
    at = F.transform("lines", lambda x: F.coalesce(F.get(x, F.col("line")), F.lit("")))
    spread = spread.withColumn("flat", at)
    if row_regex:
        joined = F.concat_ws(" ", "flat")
        groups = F.create_map(*(x for i, h in enumerate(header) for x in (F.lit(h), F.regexp_extract(joined, "(?s)" + row_regex, i + 1))))
        return spread.filter(joined.rlike("(?s)" + row_regex)).select("path", "page", "table", "row", "line", groups.alias("cells"))
    named = F.map_from_arrays(F.slice(F.array(*map(F.lit, header)), F.lit(1), F.least(F.size("flat"), F.lit(len(header)))), F.slice("flat", F.lit(1), F.least(F.size("flat"), F.lit(len(header)))))
    return spread.select("path", "page", "table", "row", "line", named.alias("cells"))


def text_lines(found: DataFrame, tolerance: float = 3.0) -> DataFrame:
    """Words with coordinates ({pages: [[{text, x0, top}]]}) as lines: path, page, line, text and words from left to right.

    A line is anchored at its first word: words within tolerance of that word's top belong to it. A page is a bounded group.
    """
    words = within_budget(found).select("path", F.posexplode(F.from_json(F.col("content").cast("string"), f"pages array<{WORDS}>")["pages"]).alias("page", "w"))

    def lines(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = []
            for path, page, found_words in zip(frame.path, frame.page, frame.w, strict=True):
                groups: list[list] = []
                for w in sorted(found_words, key=lambda w: (w["top"], w["x0"])):
                    if groups and w["top"] - groups[-1][0]["top"] <= tolerance:
                        groups[-1].append(w)
                    else:
                        groups.append([w])
                for n, group in enumerate(groups):
                    group.sort(key=lambda w: w["x0"])
                    out.append((path, page, n, " ".join(w["text"] for w in group), group))
            yield pd.DataFrame(out, columns=["path", "page", "line", "text", "words"])

    return words.mapInPandas(lines, f"path string, page int, line int, text string, words {WORDS}")


def word_lines(found: DataFrame, bounds: dict[str, tuple[float, float]], tolerance: float = 3.0, amounts: dict[str, str] | None = None) -> DataFrame:
    """The lines of text_lines with one cell per bound [l, r): path, page, line and cells.

    A bound that amounts names takes the first word that its pattern matches, and '' without one.
    """
    def cell(name: str) -> Column:
        low, high = bounds[name]
        inside = F.transform(F.filter("words", lambda w: (w["x0"] >= low) & (w["x0"] < high)), lambda w: w["text"])
        if name in (amounts or {}):
            inside = F.slice(F.filter(inside, lambda t: t.rlike(amounts[name])), 1, 1)
        return F.array_join(inside, " ")

    cells = [x for name in bounds for x in (F.lit(name), cell(name))]
    return text_lines(found, tolerance).select("path", "page", "line", F.create_map(*cells).alias("cells"))


def required_cells(rows: DataFrame, columns: list[str]) -> DataFrame:
    """The rows whose cells of all these columns hold text; others are headings or remarks."""
    held = [F.trim(F.coalesce(F.col("cells")[c], F.lit(""))) != "" for c in columns]
    return rows.filter(F.forall(F.array(*held), lambda x: x)) if held else rows


def joined_cells(rows: DataFrame, target: str, columns: list[str], separator: str = " ") -> DataFrame:
    """One more cell: the texts of several columns that are not empty, joined."""
    parts = F.filter(F.array(*(F.trim(F.col("cells")[c]) for c in columns)), lambda x: x.isNotNull() & (x != ""))
    others = F.map_filter("cells", lambda k, _: k != target)
    return rows.withColumn("cells", F.map_concat(others, F.create_map(F.lit(target), F.array_join(parts, separator))))


def dated_rows(rows: DataFrame, profile: Profile, fields: tuple[str, ...] = ("date", "posting_date")) -> DataFrame:
    """rows, where every text in a date column of the profile is a date and each row has one; otherwise an error at that row."""
    cells = {f: clean_cell(F.col("cells")[profile.columns[f]]) for f in fields if f in profile.columns}
    bad = [F.when((c != "") & _date(c, profile).isNull(), f) for f, c in cells.items()]
    none = F.when(F.concat(*cells.values()) == "", next(iter(cells), fields[0])) if cells else F.lit(fields[0])
    wrong = F.coalesce(*bad, none)
    place = F.concat_ws("; ", *(F.concat(F.lit(f"{c}="), F.col(c).cast("string")) for c in ("path", "page", "line") if c in rows.columns), F.concat(F.lit("field="), wrong))
    return rows.withColumn("cells", F.when(wrong.isNull(), F.col("cells")).otherwise(F.raise_error(F.concat(F.lit("invalid date: "), place))))


def display_path(path: Column, root: str) -> Column:
    """The path below root, or the file's name if it lies elsewhere."""
    base = root.rstrip("/") + "/"
    return F.when(path.startswith(base), F.substr(path, F.lit(len(base) + 1))).otherwise(F.element_at(F.split(path, "/"), -1))


def locator(path: Column, root: str) -> Column:
    """Where an absolute path lies: kind (workspace or external) and its text, relative to root within the workspace."""
    base = root.rstrip("/") + "/"
    inside = path.startswith(base)
    return F.struct(F.when(inside, "workspace").otherwise("external").alias("kind"), F.when(inside, F.substr(path, F.lit(len(base) + 1))).otherwise(path).alias("text"))


def profile_for(header: set[str], profiles: list[Profile]) -> Profile:
    """The one profile whose columns the header has."""
    fits = [p for p in profiles if set(p.columns.values()) <= header]
    if len(fits) != 1:
        raise ValueError(f"{len(fits)} profiles fit the columns")
    return fits[0]


def _date(cell: Column, profile: Profile) -> Column:
    parsed = []
    for fmt in profile.date_formats:
        pattern, text = fmt, cell
        for code, java in DATE_CODES.items():
            pattern = pattern.replace(code, java)
        if "%Y" not in fmt and "%y" not in fmt:
            pattern, text = pattern + ";yyyy", F.concat(cell, F.lit(f";{profile.statement_year or 1900}"))
        parsed.append(F.try_to_timestamp(text, F.lit(pattern)).cast("date"))
    return F.coalesce(*parsed)


def normalize(rows: DataFrame, profile: Profile) -> DataFrame:
    """Raw rows as ledger rows in their first state; balance rows and the profile's skip texts are dropped.

    Invalid amounts are 0.00 with the flag invalid_amount, unparseable dates stay as date_raw, and every row begins
    unresolved, Unknown and in review.
    """
    cell = lambda f: clean_cell(F.col("cells")[profile.columns[f]]) if f in profile.columns else F.lit("")
    if "debit" in profile.columns:
        debit, credit = parsed_amount(cell("debit")), parsed_amount(cell("credit"))
        some = lambda x: F.coalesce(x != 0, F.lit(False))
        invalid = ((cell("debit") == "") & (cell("credit") == "")) | (some(debit) & some(credit)) | ((cell("debit") != "") & debit.isNull()) | ((cell("credit") != "") & credit.isNull())
        amount = F.when(some(debit), -F.abs(debit)).when(some(credit), F.abs(credit)).otherwise(F.lit(0).cast("decimal(38,10)"))
    else:
        amount = parsed_amount(cell("amount"))
        invalid = amount.isNull()
        sign = F.lower(cell("indicator"))
        suffixed = F.upper(cell("amount")).rlike(r"(CR|DR)$")
        amount = (
            F.when(sign.isin(*[v.lower() for v in profile.debit_values] or [""]) & (sign != ""), -F.abs(amount))
            .when(sign.isin(*[v.lower() for v in profile.credit_values] or [""]) & (sign != ""), F.abs(amount))
            .when(suffixed, amount)
            .otherwise(-F.abs(amount) if profile.default_sign == "expense" else F.abs(amount) if profile.default_sign == "income" else amount)
        )
    description = cell("description")
    skipped = description.rlike(BALANCE_ROW)
    for text in profile.skip:
        skipped = skipped | F.contains(F.lower(description), F.lit(text.lower()))
    date = _date(cell("date"), profile)
    currency = F.upper(F.coalesce(F.nullif(cell("currency"), F.lit("")), F.lit(profile.currency or "")))
    return rows.filter(~skipped).select(
        *[c for c in rows.columns if c != "cells"],
        date.alias("date"), F.when(date.isNull(), cell("date")).alias("date_raw"),
        F.lit(profile.account_id).alias("account_id"), F.lit(profile.account_type).alias("account_type"), F.lit(profile.institution).alias("institution"),
        F.coalesce(money(amount), F.lit(0).cast("decimal(20,2)")).alias("posted_amount"), currency.alias("posted_currency"),
        F.coalesce(F.nullif(cell("merchant"), F.lit("")), description).alias("merchant"), description.alias("original_description"),
        F.lit("Unknown").alias("category"), F.lit("unresolved").alias("flow_type"), F.lit(True).alias("needs_review"),
        F.array_compact(F.array(F.lit("uncategorized"), F.when(invalid, "invalid_amount"))).alias("flags"),
        F.array_sort(F.array_compact(F.array(F.lit("category_decision"), F.lit("accounting_flow"), F.when(invalid, "source_data_issue")))).alias("review_reasons"),
    )


def rate_document(found: DataFrame, currencies: list[str]) -> DataFrame:
    """Observations of a daily rate document ({result: {records: [{end_of_day, usd, ...}]}}): currency, date, rate, document digest."""
    record = ",".join(["end_of_day:string", *(f"{c}:decimal(17,8)" for c in currencies)])
    schema = f"result struct<records:array<struct<{record}>>>"
    text = F.col("content").cast("string")
    rows = found.select(F.sha2("content", 256).alias("document"), F.explode(F.from_json(text, schema)["result"]["records"]).alias("r")).select("document", "r.*")
    long = rows.unpivot(["document", "end_of_day"], currencies, "currency", "rate").filter("rate is not null and rate > 0")
    return long.select(F.upper("currency").alias("currency"), F.col("end_of_day").cast("date").alias("date"), "rate", F.col("document").alias("provider"))


def model_json(path: str) -> list:
    """A small JSON document of the driver's (rules, profiles): a list of objects."""
    with open(path, encoding="utf-8") as f:
        document = json.load(f)
    if not isinstance(document, list):
        raise ValueError("a list of objects is expected")
    return document
