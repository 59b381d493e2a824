"""Columns for cells, dates, amounts, token lists and digests."""

from __future__ import annotations

import unicodedata
from functools import reduce

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

MONEY = "decimal(20,2)"
#: The marker of the reversible cell encoding, and what a spreadsheet would run: signs at the start, a tab or return before.
SAFE_PREFIX = "'safe1:"
FORMULA_START = r"^\s*[=+\-@]|^\s*[\t\r]"


def clean_cell(cell: Column) -> Column:
    """Missing is '', control characters other than tab and newline go, white space at the ends goes."""
    return F.regexp_replace(F.regexp_replace(F.coalesce(cell, F.lit("")), r"[\x00-\x08\x0B-\x1F]", ""), r"^(?U)\s+|\s+$", "")


def safe_decimal(cell: Column, kind: str = "decimal(38,10)") -> Column:
    """A finite number or null; blanks, NaN, infinities and garbage are null."""
    return F.trim(cell).try_cast(kind)


def money(amount: Column) -> Column:
    """Two places, half to even."""
    return F.bround(amount, 2).cast(MONEY)


def parsed_amount(cell: Column) -> Column:
    """Statement amounts: thousands commas, and a CR (positive) or DR (negative) suffix that overrides the sign."""
    bare = F.upper(F.regexp_replace(F.trim(cell), ",", ""))
    number = F.regexp_replace(bare, r"\s*(CR|DR)$", "").try_cast("decimal(38,10)")
    return F.when(bare.rlike("DR$"), -F.abs(number)).when(bare.rlike("CR$"), F.abs(number)).otherwise(number)


def iso_date(cell: Column) -> Column:
    """YYYY-MM-DD or null; shorter forms that a plain cast would take are refused."""
    return F.when(cell.rlike(r"^\d{4}-\d{2}-\d{2}$"), cell.try_cast("date"))


def direction(base: Column, posted: Column) -> Column:
    amount = F.coalesce(base, posted)
    return F.when(amount > 0, "inflow").when(amount < 0, "outflow")


def canonical_decimal(amount: Column) -> Column:
    """Plain notation without trailing zeros; minus zero is 0."""
    text = F.regexp_replace(F.regexp_replace(amount.cast("string"), r"(\.\d*?)0+$", "$1"), r"\.$", "")
    return F.when(amount == 0, "0").otherwise(text)


def folded(form: str):
    """Unicode normalisation, case folding and collapsed white space: Spark has none of the three in full."""

    @F.pandas_udf("string")
    def fold(cells: pd.Series) -> pd.Series:
        return cells.map(lambda c: None if c is None else " ".join(unicodedata.normalize(form, c).casefold().split()))

    return fold


def merchant_signature(cell: Column) -> Column:
    """Lower-case letters and digits, anything else one space. For full case folding pass folded('NFKC')(cell)."""
    return F.trim(F.regexp_replace(F.lower(cell), r"[^\p{L}\p{N}]+", " "))


def add_token(tokens: Column, token: Column | str, when: Column) -> Column:
    return F.when(when, F.array_union(tokens, F.array(F.lit(token) if isinstance(token, str) else token))).otherwise(tokens)


def add_tokens(tokens: Column, wanted: dict[str, Column]) -> Column:
    """Several tokens, each where its condition holds, in their order: the expression is named once, not once more for each."""
    new = F.array_compact(F.array(*(F.when(when, token) for token, when in wanted.items())))
    return F.when(reduce(lambda a, b: a | b, wanted.values()), F.array_union(tokens, new)).otherwise(tokens)


def drop_tokens(tokens: Column, *gone: str) -> Column:
    return F.array_except(tokens, F.array(*map(F.lit, gone)))


def add_reason(reason: Column, more: Column) -> Column:
    """Reasons are joined by '; '; one that the text holds already is not added again."""
    return F.when(F.contains(F.coalesce(reason, F.lit("")), more), reason).otherwise(F.concat_ws("; ", F.nullif(reason, F.lit("")), more))


def remove_reason(reason: Column, gone: str) -> Column:
    """The reasons without one of them."""
    return F.array_join(F.filter(F.split(F.coalesce(reason, F.lit("")), "; "), lambda x: (x != "") & (x != gone)), "; ")


def thousands(amount: Column) -> Column:
    """Two places, half to even, with commas between thousands."""
    return F.format_number(F.bround(amount, 2), 2)


def _sized(value: Column) -> Column:
    raw = F.encode(F.coalesce(value, F.lit("")), "UTF-8")
    return F.concat(F.unhex(F.lpad(F.hex(F.octet_length(raw)), 16, "0")), raw)


def framed(magic: bytes, domain: str, *parts: Column) -> Column:
    """The bytes that identify parts unambiguously: magic, sized domain, count, sized parts."""
    name = domain.encode()
    head = magic + len(name).to_bytes(4, "big") + name + len(parts).to_bytes(4, "big")
    return reduce(F.concat, map(_sized, parts), F.lit(head)) if parts else F.lit(head)


def framed_sha256(prefix: str, domain: str, *parts: Column, magic: bytes = b"tally1\0") -> Column:
    return F.concat(F.lit(prefix), F.sha2(framed(magic, domain, *parts), 256))


def framed_hmac(key: bytes, prefix: str, domain: str, *parts: Column, magic: bytes = b"tally1\0") -> Column:
    """HMAC-SHA-256 of the frame from two digests; the key is a constant of the plan."""
    block = key.ljust(64, b"\0")
    inner = F.sha2(F.concat(F.lit(bytes(b ^ 0x36 for b in block)), framed(magic, domain, *parts)), 256)
    return F.concat(F.lit(prefix), F.sha2(F.concat(F.lit(bytes(b ^ 0x5C for b in block)), F.unhex(inner)), 256))


def packed(identifier: Column) -> Column:
    """An id as bytes, to travel: of three letters, `_` and a digest the digest's bytes, which halves it; any other text is kept as it is."""
    named = F.concat(F.lit(b"\1"), F.substring(identifier, 1, 4).cast("binary"), F.unhex(F.substring(identifier, 5, 64)))
    return F.when(identifier.rlike(r"^[a-z]{3}_[0-9a-f]{64}\z"), named).otherwise(F.concat(F.lit(b"\0"), identifier.cast("binary")))


def unpacked(raw: Column) -> Column:
    """The id that packed() made raw of."""
    named = F.concat(F.substring(raw, 2, 4).cast("string"), F.lower(F.hex(F.substring(raw, 6, 32))))
    return F.when(F.substring(raw, 1, 1) == F.lit(b"\1"), named).otherwise(F.substr(raw, F.lit(2)).cast("string"))


def csv_safe(cell: Column) -> Column:
    """Text that a spreadsheet would run as a formula (or that looks encoded already) gets a reversible marker."""
    return F.when(cell.rlike(FORMULA_START) | cell.startswith(SAFE_PREFIX), F.concat(F.lit(SAFE_PREFIX), cell)).otherwise(cell)


def csv_plain(cell: Column) -> Column:
    return F.when(cell.startswith(SAFE_PREFIX), F.substr(cell, F.lit(len(SAFE_PREFIX) + 1))).otherwise(cell)


def snippet(cell: Column, limit: int = 120) -> Column:
    flat = F.trim(F.regexp_replace(cell, r"\s+", " "))
    return F.when(F.length(flat) > limit, F.concat(F.substring(flat, 1, limit - 1), F.lit("…"))).otherwise(flat)


def canonical_json(*columns: str) -> Column:
    """One object of text, integer, boolean, decimal, date and nested columns: keys in order, no spaces, nulls written."""
    return F.to_json(F.struct(*sorted(columns, key=lambda c: c.encode("utf-16-be"))), {"ignoreNullFields": "false"})


def digest_sums(member: Column) -> list[Column]:
    """Aggregates that identify a multiset of members: sums of parts of their digests, so partial sums travel."""
    digest = F.sha2(member.cast("string"), 256)
    return [F.sum(F.conv(F.substring(digest, 1 + 15 * i, 15), 16, 10).cast("decimal(20,0)")) for i in range(4)]
