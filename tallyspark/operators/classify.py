"""Classification: compiled rules, structural patterns, mined memory, learned rules, evaluation."""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass
class Rule:
    """A declarative rule: conditions (field, match type, patterns, case sensitive) all hold, or any of fields matches."""

    id: str
    category: str | None = None
    patterns: list[str] = field(default_factory=list)
    fields: list[str] = field(default_factory=list)
    match_type: str = "keyword"
    match_all: bool = False
    conditions: list[dict] = field(default_factory=list)
    priority: int = 0
    managed: bool = False
    enabled: bool = True
    confidence: float = 0.9
    flow_type: str | None = None
    owner: str | None = None


def validate_rules(rules: list[Rule]) -> None:
    """Ids are unique; enabled rules name a known match type, compile, and decide something."""
    ids = [r.id for r in rules]
    if len(set(ids)) != len(ids):
        raise ValueError("rule ids have to be unique")
    for r in rules:
        if r.enabled:
            if not (r.category or r.flow_type or r.owner):
                raise ValueError(f"rule {r.id} decides nothing")
            for kind, patterns in [(r.match_type, r.patterns), *((c["match_type"], c["patterns"]) for c in r.conditions)]:
                if kind not in ("exact", "keyword", "regex"):
                    raise ValueError(f"rule {r.id} has an unknown match type")
                if kind == "regex":
                    [re.compile(p) for p in patterns]


def _matches(cell: Column, kind: str, pattern: str, case_sensitive: bool) -> Column:
    if kind == "regex":
        return cell.rlike(pattern if case_sensitive else f"(?i){pattern}")
    text, wanted = (cell, pattern) if case_sensitive else (F.lower(cell), pattern.lower())
    return text == wanted if kind == "exact" else F.contains(text, F.lit(wanted))


def _any(parts: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, parts, F.lit(False))


def predicate(rule: Rule) -> Column:
    """The rule as a boolean column; conditions override fields."""
    cell = lambda name: F.coalesce(F.col(name).cast("string"), F.lit(""))
    if rule.conditions:
        tests = [_any([_matches(cell(c["field"]), c["match_type"], p, c.get("case_sensitive", False)) for p in c["patterns"]]) for c in rule.conditions]
        return reduce(lambda a, b: a & b, tests)
    tests = [_any([_matches(cell(f), rule.match_type, p, False) for p in rule.patterns]) for f in rule.fields]
    return reduce(lambda a, b: a & b, tests) if rule.match_all and tests else _any(tests)


def ranked(rules: list[Rule]) -> list[Rule]:
    """Manual before managed, higher priority, amount-specific before broad among managed, earlier in the file."""
    specific = lambda r: r.managed and any(c["field"] == "posted_amount" for c in r.conditions)
    order = sorted(enumerate(rules), key=lambda x: (x[1].managed, -x[1].priority, not specific(x[1]), x[0]))
    return [r for _, r in order if r.enabled]


def apply_rules(rows: DataFrame, rules: list[Rule]) -> DataFrame:
    """rows with rule_id, rule_category, rule_confidence of the first rule that matches. One narrow pass, no join."""
    validate_rules(rules)
    pick = F.lit(None).cast("int")
    order = ranked(rules)
    for i in reversed(range(len(order))):
        pick = F.when(predicate(order[i]), i).otherwise(pick)
    rows = rows.withColumn("__rule", pick)
    # The guard is needed: with a null index the last element would come back.
    of = lambda values, kind: F.when(F.col("__rule").isNotNull(), F.element_at(F.array(*(F.lit(v).cast(kind) for v in values)), F.col("__rule") + 1)) if values else F.lit(None).cast(kind)
    return rows.withColumns(
        {"rule_id": of([r.id for r in order], "string"), "rule_category": of([r.category for r in order], "string"), "rule_confidence": of([str(r.confidence) for r in order], "decimal(4,2)")}
    ).drop("__rule")


def structural(text: Column, amount: Column, account_type: Column) -> Column:
    """category>flow of cashback, interest, cash withdrawals and card payments; null if none fits."""
    t = F.lower(text)
    return (
        F.when(t.rlike(r"\b(cashback|cash[- ]rebate)\b") & (amount > 0), "Other>refund")
        .when(t.rlike(r"\binterest\b") & (amount > 0), "Income>income")
        .when(t.rlike(r"\b(atm|cash) withdrawal\b") & (amount < 0), "Cash>expense")
        .when(t.rlike(r"\b(credit card payment|card payment|card settlement)\b") & (amount > 0) & (account_type == "credit_card"), "Credit Card Payment>credit_card_payment")
    )


def build_memory(rows: DataFrame, keys: list[str], member: str = "id", least: int = 2) -> DataFrame:
    """Keys whose reviewed rows agree on one category, with at least two of them."""
    mined = rows.filter("category is not null").groupBy(*keys).agg(F.countDistinct("category").alias("kinds"), F.countDistinct(member).alias("seen"), F.min("category").alias("memory_category"))
    return mined.filter((F.col("kinds") == 1) & (F.col("seen") >= least)).select(*keys, "memory_category", "seen")


def apply_memory(rows: DataFrame, memory: DataFrame, keys: list[str]) -> DataFrame:
    """Unknown rows take the remembered category at confidence 0.90."""
    joined = rows.join(memory.select(*keys, "memory_category"), keys, "left")
    hit = F.coalesce("category", F.lit("Unknown")).isin("", "Unknown") & F.col("memory_category").isNotNull()
    return joined.withColumns({"category": F.when(hit, F.col("memory_category")).otherwise(F.col("category")), "remembered": hit}).drop("memory_category")


def learn_rules(rows: DataFrame, signature: list[str], finer: list[str]) -> DataFrame:
    """Signatures whose rows are all reviewed with one outcome become broad rules; where outcomes differ, finer groups do.

    rows: signature and finer columns, outcome (null: not reviewed). Result: signature, finer columns (null for broad),
    outcome, priority, covered.
    """
    group = rows.groupBy(*signature).agg(F.countDistinct("outcome").alias("kinds"), F.count_if(F.col("outcome").isNull()).alias("open"), F.count(F.lit(1)).alias("covered"), F.min("outcome").alias("outcome"))
    broad = group.filter("kinds = 1 and open = 0").select(*signature, *(F.lit(None).cast(dict(rows.dtypes)[c]).alias(c) for c in finer), "outcome", F.lit(-1000).alias("priority"), "covered")
    conflicts = group.filter("kinds >= 2").select(*signature)
    sub = rows.join(conflicts, signature, "left_semi").groupBy(*signature, *finer).agg(F.countDistinct("outcome").alias("kinds"), F.count_if(F.col("outcome").isNull()).alias("open"), F.count(F.lit(1)).alias("covered"), F.min("outcome").alias("outcome"))
    narrow = sub.filter("kinds = 1 and open = 0").select(*signature, *finer, "outcome", F.lit(-999).alias("priority"), "covered")
    return broad.unionByName(narrow)


def confusion(reference: DataFrame, candidate: DataFrame, key: str) -> DataFrame:
    """Counts by reference and candidate category; absent candidates are Missing, blanks Unknown."""
    joined = reference.select(key, F.col("category").alias("ref")).join(candidate.select(key, F.col("category").alias("cand"), F.lit(True).alias("there")), key, "left")
    label = F.when(F.col("there").isNull(), "Missing").when(F.coalesce("cand", F.lit("")) == "", "Unknown").otherwise(F.col("cand"))
    return joined.select("ref", label.alias("cand")).groupBy("ref", "cand").agg(F.count(F.lit(1)).alias("n"))


def metrics(matrix: DataFrame) -> DataFrame:
    """Rows, covered and correct counts, and the three ratios to four places."""
    covered, right = ~F.col("cand").isin("Missing", "Unknown"), F.col("ref") == F.col("cand")
    total = lambda when: F.coalesce(F.sum(F.when(when, F.col("n"))), F.lit(0))
    sums = matrix.agg(total(F.lit(True)).alias("n_rows"), total(covered).alias("n_covered"), total(right).alias("n_correct"))
    ratio = lambda a, b: F.round(F.try_divide(F.col(a).cast("double"), F.col(b)), 4)
    return sums.select("*", ratio("n_covered", "n_rows").alias("coverage"), ratio("n_correct", "n_rows").alias("accuracy"), ratio("n_correct", "n_covered").alias("covered_accuracy"))
