"""Benchmark decontamination by template canonicalisation. DataFrame functions only.

Texts become templates: numbers, units after a number, and names (any capitalised word, wherever it stands) turn into typed
placeholders, the rest is lower-cased and stripped of punctuation. Windows of WINDOW template tokens are joined by hash
with those of the benchmark, so a question asked again with other numbers or names still meets its template. An item's
first word is looked for in both readings, as a name and in lower case, since a quotation may begin in either. For pairs
whose shared windows hold placeholders, the values that fill them must be consistent: one value of the benchmark stands
for one value of the document throughout an occurrence, and the other way round. Where no number stands among them, names
alone tell little (some languages capitalise every noun): then half of them have to be the item's own, or they have to be
a small part of the item. Windows of one document and item whose positions differ by about
the same shift are one occurrence, so a document may hold an item several times with different values.

Items none of whose windows has LEAST_LITERALS literal tokens would meet too much as templates; they are looked for with
numbers and names left in place, by windows of their words in lower case without outer punctuation.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallyspark.llm.common import SPACE_CLASS, every_row, keep_by_row, staged

WINDOW = 8
#: Benchmark items below this many template tokens say too little to be looked for; items below WINDOW are one window.
LEAST_TOKENS = 3
#: Literal (not placeholder) tokens that a window needs.
LEAST_LITERALS = 4
#: A document holds an item if it has this share of the item's distinct windows, and fills slots consistently in this share.
COVERAGE = 0.3
CONSISTENCY = 0.5
#: Other names than the item's, without any number, count if they are at most this share of the item's tokens.
NAME_SHARE = 0.2
#: Words put in or left out at one place that do not split an occurrence; copies of an item are at least LEAST_TOKENS apart.
SHIFT = 3
#: Benchmark windows up to this count (about 40 bytes each) are broadcast; a larger benchmark is joined by shuffling.
BROADCAST_WINDOWS = 500_000

NUMBER, NAME, UNIT = "⟨n⟩", "⟨p⟩", "⟨u⟩"
# Words that are units when they follow a number.
UNITS = (
    "mm cm dm m km mg g kg t ml cl l inch inches foot feet yard yards mile miles ounce ounces pound pounds ton tons litre "
    "litres liter liters gallon gallons second seconds minute minutes hour hours day days week weeks month months year "
    "years percent degree degrees dollar dollars euro euros cent cents pence watt watts volt volts meter meters metre "
    "metres gram grams kilogram kilograms kilometer kilometers kilometre kilometres"
).split()


def _spaced(text: F.Column) -> F.Column:
    return F.trim(F.regexp_replace(text, SPACE_CLASS + "+", " "))


def _template(text: F.Column) -> F.Column:
    """The template of a spaced text; words and template tokens stay in step (a token of punctuation alone becomes empty)."""
    numbered = F.regexp_replace(text, r"(?<![\p{L}\p{N}])[$€£]?[-+]?\p{N}+(?:[.,:/]\p{N}+)*%?(?![\p{L}\p{N}])", NUMBER)
    units = rf"(?i)(?<={NUMBER}\x20)(?:{'|'.join(UNITS)})(?![\p{{L}}\p{{N}}])"
    united = F.when(F.contains(numbered, F.lit(NUMBER)), F.regexp_replace(numbered, units, UNIT)).otherwise(numbered)
    named = F.regexp_replace(united, r"(?<![\p{L}\p{N}])\p{Lu}\p{Ll}[\p{L}'-]*", NAME)
    return F.lower(F.regexp_replace(named, r"[^\p{L}\p{N}\x20⟨⟩]+", ""))


def _tokens(text: F.Column) -> F.Column:
    return F.filter(F.split(_template(_spaced(text)), " "), lambda t: t != "")


def _words(text: F.Column) -> F.Column:
    """The words of a text as they stand, in lower case and without punctuation at their ends."""
    bare = F.regexp_replace(_spaced(text), r"(?<![\p{L}\p{N}])[^\p{L}\p{N}\x20]+|[^\p{L}\p{N}\x20]+(?![\p{L}\p{N}])", "")
    return F.filter(F.split(F.lower(bare), " "), lambda t: t != "")


def _hash(tokens: F.Column, exact: bool) -> F.Column:
    """Template windows and windows of words as they stand hash apart; windows of different lengths do anyway."""
    return F.xxhash64(F.lit(exact), tokens)


def _windows(tokens: F.Column, lengths: list[int], exact: bool) -> F.Column:
    """Position, length and hash of all windows of the given lengths; tokens is bound once, through a one-element array."""

    def cut(w: F.Column, n: int) -> F.Column:
        made = lambda i: F.struct((i - 1).alias("d_at"), _hash(F.slice(w, i, n), exact).alias("h"))
        none = F.array().cast("array<struct<d_at:int,h:bigint>>")
        return F.when(F.size(w) >= n, F.transform(F.sequence(F.lit(1), F.size(w) - n + 1), made)).otherwise(none)

    return F.flatten(F.transform(F.array(tokens), lambda w: F.concat(*(cut(w, n) for n in lengths))))


def benchmark_windows(benchmark: DataFrame) -> DataFrame:
    """item_id, n (tokens a window), at (position), h (hash), w (hash in the first reading), slots (whether the window holds
    placeholders), exact and tokens (of the item).

    exact windows are of the words as they stand, for items that have too few literal tokens in every template window.
    """
    text = F.coalesce("text", F.lit(""))
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), _tokens(text).alias("w"), _words(text).alias("raw"))
    items = items.filter(F.size("w") >= LEAST_TOKENS).withColumn("tokens", F.size("w"))

    def cut(words: str) -> DataFrame:
        sized = items.withColumn("n", F.least(F.size(words), F.lit(WINDOW))).filter("n > 0")
        starts = F.sequence(F.lit(1), F.size(words) - F.col("n") + 1)
        return sized.select("item_id", "tokens", "raw", "n", F.posexplode(F.transform(starts, lambda i: F.slice(words, i, F.col("n")))).alias("at", "win"))

    held = F.size(F.filter("win", lambda t: t.isin(NUMBER, NAME, UNIT)))
    first = F.regexp_replace(F.get("raw", F.lit(0)), r"[^\p{L}\p{N}]+", "")
    other = F.when((F.col("at") == 0) & (F.get("win", F.lit(0)) == NAME), F.concat(F.array(first), F.slice("win", F.lit(2), F.size("win") - 1)))
    made = lambda rows, slots, exact: rows.select("item_id", "n", "at", _hash(F.col("win"), exact).alias("h"), _hash(F.col("win"), exact).alias("w"), slots.alias("slots"), F.lit(exact).alias("exact"), "tokens")
    templates = cut("w").filter(F.col("n") - held >= LEAST_LITERALS)
    open_ = made(templates, held > 0, False)
    lower = templates.withColumn("other", other).filter("other is not null")
    lower = lower.select("item_id", "n", "at", _hash(F.col("other"), False).alias("h"), _hash(F.col("win"), False).alias("w"), F.lit(True).alias("slots"), F.lit(False).alias("exact"), "tokens")
    rest = cut("raw").join(open_.select("item_id").distinct(), "item_id", "left_anti")
    return open_.unionByName(lower).unionByName(made(rest, F.lit(False), True))


def _slot_values(id_column: str, rows: DataFrame) -> DataFrame:
    """Words and template tokens in step, for rows with id_column and text."""
    spaced = rows.select(id_column, _spaced(F.col("text")).alias("s"))
    zipped = F.arrays_zip(F.split("s", " ").alias("word"), F.split(_template(F.col("s")), " ").alias("token"))
    return spaced.select(id_column, F.filter(zipped, lambda z: z["token"] != "").alias("z"))


def contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """One row per document and benchmark item that it holds: doc_id, item_id, n_windows, n_shared, n_slots, n_consistent.

    n_windows: distinct windows of the item; n_shared: those the document has; n_slots: benchmark slot values in them, of
    which n_consistent are filled by one document value that fills no other. A pair is reported if the occurrences that
    fill their slots consistently have its share of windows (slots are then counted in these), or if all its windows
    together are filled consistently. Null or empty texts hold nothing and items of fewer than LEAST_TOKENS tokens are not
    looked for; items with too few literal tokens for a template are found as they stand, with
    their own numbers and names, and have no slots. Repeated items are reported each. Rows that share a doc_id are told apart
    by their texts, rows with the same doc_id and text count once; a row without a doc_id takes part. Empty tables give an
    empty result.
    """
    return _held(docs, benchmark).drop("row")


def _held(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """contaminated() with row."""
    source = every_row(docs)
    marks = staged(benchmark_windows(benchmark), "windows")
    n_marks = marks.count()
    lengths = sorted(tuple(r) for r in marks.select("exact", "n").distinct().collect())  # at most 2 * WINDOW rows
    by_item = marks.groupBy("item_id").agg(F.countDistinct("w").alias("n_windows"), F.max("slots").alias("has_slots"), F.max("tokens").alias("tokens"))
    keyed = marks.select("h", "w", "item_id", F.col("at").alias("b_at"), "slots")
    small = n_marks <= BROADCAST_WINDOWS
    # Every text is cut once into template tokens and, where the benchmark has exact windows, once into words.
    kinds = {exact: [n for e, n in lengths if e == exact] for exact in (False, True)}
    cuts = [_windows((_words if exact else _tokens)(F.col("text")), of, exact) for exact, of in kinds.items() if of]
    found_at = F.concat(*cuts) if cuts else F.array().cast("array<struct<d_at:int,h:bigint>>")
    rows = source.select("row", "doc_id", F.explode(found_at).alias("d")).select("row", "doc_id", "d.*")
    matches = rows.join(F.broadcast(keyed) if small else keyed, "h")
    matches = staged(matches, "matches")
    pair = ["row", "item_id"]
    pairs = (
        matches.groupBy(*pair)
        .agg(F.first("doc_id").alias("doc_id"), F.countDistinct("w").alias("n_shared"))
        .join(F.broadcast(by_item) if small else by_item, "item_id")
        .filter(F.col("n_shared") >= COVERAGE * F.col("n_windows"))
    )
    pairs = staged(pairs, "pairs")
    # Windows of about the same shift are one occurrence.
    by_shift = Window.partitionBy(*pair).orderBy("shift")
    near = matches.join(pairs.select(*pair), pair, "left_semi").withColumn("shift", F.col("d_at") - F.col("b_at"))
    jump = near.withColumn("jump", F.coalesce((F.col("shift") - F.lag("shift").over(by_shift) > SHIFT).cast("int"), F.lit(0)))
    held = staged(jump.withColumn("occurrence", F.sum("jump").over(by_shift)).select(*pair, "occurrence", "w", "d_at", "b_at", "slots"), "held")
    # Slot values are looked up only where shared windows hold placeholders.
    open_at = held.filter("slots").select(*pair, "occurrence", "d_at", "b_at")
    mine = _slot_values("row", source.join(open_at.select("row").distinct(), "row", "left_semi").dropDuplicates(["row"]))
    # Items without windows stay out, so what is broadcast has a bounded number of rows and of tokens.
    named = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.coalesce("text", F.lit("")).alias("text"))
    theirs = _slot_values("item_id", named.join(by_item.select("item_id"), "item_id", "left_semi"))
    window = lambda z, at: F.slice(F.col(z), F.col(at) + 1, WINDOW)
    doc_side = open_at.join(mine, "row").select(*pair, "occurrence", "b_at", window("z", "d_at").alias("d"))
    both = doc_side.join(F.broadcast(theirs) if small else theirs, "item_id").select(*pair, "occurrence", "d", window("z", "b_at").alias("b"))
    bare = lambda word: F.regexp_replace(F.lower(word), r"[^\p{L}\p{N}]+", "")
    slots = both.select(
        *pair, "occurrence", F.explode(F.filter(F.arrays_zip("d", "b"), lambda x: x["b"]["token"].isin(NUMBER, NAME, UNIT))).alias("x")
    ).select(*pair, "occurrence", F.col("x.b.token").alias("token"), bare(F.col("x.b.word")).alias("b_word"), bare(F.col("x.d.word")).alias("d_word"))
    slots = staged(slots.distinct(), "slots")

    def consistency(*within: str) -> DataFrame:
        filled = slots.select(*within, "token", "b_word", "d_word").distinct()
        back = filled.groupBy(*within, "d_word").agg(F.count(F.lit(1)).alias("sources"))
        values = filled.join(back, [*within, "d_word"]).groupBy(*within, "token", "b_word").agg(F.count(F.lit(1)).alias("values"), F.max("sources").alias("sources"), F.max("d_word").alias("d_word"))
        single = (F.col("values") == 1) & (F.col("sources") == 1)
        name = F.col("token") == NAME
        return values.groupBy(*within).agg(
            F.count(F.lit(1)).alias("n_slots"), F.count_if(single).alias("n_consistent"), F.count_if(F.col("token") == NUMBER).alias("numbers"),
            F.count_if(name).alias("names"), F.count_if(name & single & (F.col("b_word") == F.col("d_word"))).alias("same_names"),
        )

    filled = ["n_slots", "n_consistent", "numbers", "names", "same_names"]
    told = (F.col("numbers") > 0) | (2 * F.col("same_names") >= F.col("names")) | (F.col("names") <= NAME_SHARE * F.col("tokens"))
    sound = (F.col("n_consistent") >= CONSISTENCY * F.col("n_slots")) & told
    tokens = pairs.select(*pair, "tokens")
    found = (
        held.groupBy(*pair, "occurrence")
        .agg(F.collect_set("w").alias("ws"))
        .join(consistency(*pair, "occurrence"), [*pair, "occurrence"], "left")
        .na.fill(0, filled)
        .join(tokens, pair)
        .filter(sound)
        .groupBy(*pair)
        .agg(F.size(F.array_distinct(F.flatten(F.collect_list("ws")))).alias("n_found"), F.sum("n_slots").alias("found_slots"), F.sum("n_consistent").alias("found_consistent"))
    )
    out = pairs.join(consistency(*pair), pair, "left").join(found, pair, "left").na.fill(0, [*filled, "n_found"])
    apart = F.col("n_found") >= COVERAGE * F.col("n_windows")
    return out.filter(apart | sound).select(
        "row", "doc_id", "item_id", "n_windows", "n_shared", F.when(apart, F.col("found_slots")).otherwise(F.col("n_slots")).alias("n_slots"),
        F.when(apart, F.col("found_consistent")).otherwise(F.col("n_consistent")).alias("n_consistent"),
    )


def drop_contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of docs that hold no benchmark item, with all their columns."""
    return keep_by_row(docs, _held(docs, benchmark), "left_anti")
