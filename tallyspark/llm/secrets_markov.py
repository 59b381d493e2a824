"""Secret scan: pattern spans, and random-looking tokens by character Markov models. DataFrame functions only.

Two first-order Markov models over characters are trained from labelled samples: random strings (values that the fixed
patterns matched in the corpus sample, and digests in three notations) against ordinary identifiers (words and joined
words of the sample outside such values). A candidate token is reported if the sum of log-likelihood ratios over its
character pairs exceeds THRESHOLD. The table of ratios has a fixed size (the alphabet squared) and is used as a literal.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyspark.llm.common import id_and_text

# The patterns of the contract.
ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]{24,}"  # maximal runs: the same matches as one or more, kept at 24 characters and over
KINDS = ("assign", "access", "hex", "model")
ASSIGN_MIN, ACCESS_MIN, HEX_MIN = 6, 20, 24

ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"
SIDE = len(ALPHABET) + 1  # 0 stands for the edge of a token
CANDIDATE = r"[A-Za-z0-9+/_=-]{12,}"
#: A candidate counts if it is a thousand times likelier under the model of random strings.
THRESHOLD = math.log(1000)
#: The training sample: about this many documents, chosen by a hash of doc_id, and this many digests.
SAMPLE_DOCS = 500
SAMPLE_DIGESTS = 600
SMOOTHING = 0.5
#: Every so many words of the sample, two neighbours joined by an underscore serve as a longer identifier.
JOINED_STEP = 8


def _pairs(token: F.Column) -> F.Column:
    """Cell numbers of the character pairs of a token, edges included."""
    index = lambda i: F.instr(F.lit(ALPHABET), F.substring(token, i, F.lit(1)))
    inner = F.transform(F.sequence(F.lit(1), F.length(token)), lambda i: F.when(i == 1, F.lit(0)).otherwise(index(i - 1)) * SIDE + index(i))
    return F.when(F.length(token) > 0, inner).otherwise(F.array().cast("array<int>"))


def _counts(tokens: DataFrame) -> dict[int, int]:
    """Pair counts of a table of tokens; at most SIDE * SIDE rows reach the driver."""
    distinct = tokens.groupBy("token").agg(F.count(F.lit(1)).alias("n"))
    rows = distinct.select("n", F.explode(_pairs(F.col("token"))).alias("cell")).groupBy("cell").agg(F.sum("n").alias("n")).collect()
    return {r["cell"]: r["n"] for r in rows}


def _conditional(counts: dict[int, int]) -> list[float]:
    out = []
    for a in range(SIDE):
        row = [counts.get(a * SIDE + b, 0) + SMOOTHING for b in range(SIDE)]
        total = sum(row)
        out += [math.log(x / total) for x in row]
    return out


def train(docs: DataFrame) -> list[float]:
    """Log-likelihood ratios (random over ordinary) by cell."""
    spark = docs.sparkSession
    source = id_and_text(docs)
    total = source.count()
    share = min(1.0, SAMPLE_DOCS / total) if total else 0.0
    drawn = source.filter(F.pmod(F.xxhash64("doc_id", F.lit(9)), F.lit(1 << 30)) < int(share * (1 << 30)))
    values = drawn.select(
        F.explode(
            F.concat(
                F.regexp_extract_all("text", F.lit(ACCESS), F.lit(0)),
                F.regexp_extract_all("text", F.lit(HEX), F.lit(0)),
                F.filter(F.regexp_extract_all("text", F.lit(ASSIGN), F.lit(2)), lambda v: (F.length(v) >= 16) & v.rlike("[0-9]")),
            )
        ).alias("token")
    )
    digest = F.sha2(F.col("id").cast("string"), 256)
    made = spark.range(SAMPLE_DIGESTS).select(
        F.explode(
            F.array(
                F.substring(digest, 1, 40),
                F.substring(F.base64(F.unhex(digest)), 1, 43),
                F.concat(F.lit("AKIA"), F.substring(F.upper(F.conv(F.substring(digest, 1, 15), 16, 36)), 1, 16)),
            )
        ).alias("token")
    )
    word = r"[A-Za-z]+(?:[_-][A-Za-z]+)*"
    plain = F.regexp_replace(F.regexp_replace(F.col("text"), ASSIGN, " "), r"\S*[0-9]\S*", " ")
    words = drawn.select(F.regexp_extract_all(plain, F.lit(word), F.lit(0)).alias("w"))
    joined = F.transform(F.sequence(F.lit(1), F.size("w") - 1, F.lit(JOINED_STEP)), lambda i: F.concat(F.element_at("w", i), F.lit("_"), F.element_at("w", i + 1)))
    ordinary = words.select(F.explode("w").alias("token")).unionByName(words.filter("size(w) > 1").select(F.explode(joined).alias("token")))
    random_model, ordinary_model = _conditional(_counts(values.unionByName(made))), _conditional(_counts(ordinary))
    return [a - b for a, b in zip(random_model, ordinary_model, strict=True)]


SPAN = "struct<start:int,kind:int,end:int>"


def _spans(text: F.Column, pattern: str, kind: int, group: int, counts: Callable[[F.Column], F.Column]) -> F.Column:
    """The leftmost non-overlapping matches of pattern that count, as spans in code points.

    Matches and the gaps between them alternate, so positions are running sums of lengths; only spans that count are kept.
    """
    whole = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    value = F.regexp_extract_all(text, F.lit(pattern), F.lit(group)) if group else whole
    zipped = F.filter(F.arrays_zip(F.split(text, pattern, -1).alias("gap"), whole.alias("hit"), value.alias("value")), lambda z: z["hit"].isNotNull())
    none = F.array().cast(f"array<{SPAN}>")

    def step(done: F.Column, z: F.Column) -> F.Column:
        start = done["at"] + F.length(z["gap"])
        end = start + F.length(z["hit"])
        span = F.struct(start.alias("start"), F.lit(kind).alias("kind"), end.alias("end"))
        return F.struct(end.alias("at"), F.when(counts(z["value"]), F.concat(done["found"], F.array(span))).otherwise(done["found"]).alias("found"))

    found = F.aggregate(zipped, F.struct(F.lit(0).alias("at"), none.alias("found")), step, lambda done: done["found"])
    return F.when(text.rlike(pattern), found).otherwise(none)


def find_secrets(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_model.

    Null text has no spans; the digest of no spans is that of the empty string. Every row is scanned for itself, whatever its
    doc_id; no row leaves its task. The model adds spans only where no base span is; its candidates are runs of at least 12
    characters: shorter ones hold too few character pairs to pass THRESHOLD reliably. An empty table gives an empty result;
    other columns are not read.
    """
    weights = F.split(F.lit(",".join(map(repr, train(docs)))), ",").cast("array<double>")  # a constant of SIDE * SIDE numbers
    score = lambda token: F.aggregate(_pairs(token), F.lit(0.0), lambda acc, cell: acc + F.element_at(weights, cell + 1))
    at_least = lambda n: lambda value: F.length(value) >= n
    text = F.col("text")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    base = F.concat(_spans(text, ASSIGN, 0, 2, at_least(ASSIGN_MIN)), _spans(text, ACCESS, 1, 0, at_least(ACCESS_MIN)), _spans(text, HEX, 2, 0, at_least(HEX_MIN)))
    found = rows.select("doc_id", F.array_sort(base).alias("base"), _spans(text, CANDIDATE, 3, 0, lambda value: score(value) > THRESHOLD).alias("model"))
    apart = lambda m: ~F.exists("base", lambda b: (b["start"] < m["end"]) & (b["end"] > m["start"]))
    found = found.withColumn("model", F.filter("model", apart))
    names = F.array(*(F.lit(k) for k in KINDS))
    listed = lambda spans: F.concat_ws(",", F.transform(spans, lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"], s["end"])))
    count = lambda spans, k: F.size(F.filter(spans, lambda s: s["kind"] == k)).cast("long")
    return found.select(
        "doc_id", *(count("base", i).alias(f"n_{k}") for i, k in enumerate(KINDS[:3])), F.sha2(listed("base"), 256).alias("base_sha256"),
        listed(F.array_sort(F.concat("base", "model"))).alias("spans"), F.size("model").cast("long").alias("n_model"),
    )


def base_spans_by_brute_force(text: str | None) -> list[tuple[str, int, int]]:
    """The contract's base spans, for tests."""
    import re

    text, out = text or "", []
    for kind, pattern, group, least in (("assign", ASSIGN, 2, ASSIGN_MIN), ("access", ACCESS, 0, ACCESS_MIN), ("hex", "[0-9a-f]+", 0, HEX_MIN)):
        out += [(m.start(), KINDS.index(kind), m.end()) for m in re.finditer(pattern, text, re.ASCII) if len(m[group]) >= least]
    return [(KINDS[k], a, b) for a, k, b in sorted(out)]
