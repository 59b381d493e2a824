"""Language identification by cross-parsing entropy.

For every language a suffix automaton is built over a bounded sample of labelled text. A document is parsed greedily
against each automaton into longest matches (phrases); the language whose parse needs the fewest phrases, each weighted
by the bits that point into its sample (log2 of the sample length) and divided by the document's length, wins.

Characters are lower-cased, runs of anything but letters are one gap character, and documents are parsed in blocks of
BLOCK characters so that numpy can advance all blocks of a batch together; whole texts are parsed.

Letters have classes of one byte. The FREQUENT most frequent letters of the samples have one each; the other letters of the
samples (SPELLED of them, the most frequent) are spelled by two classes, by their rank, so scripts with thousands of letters
keep them apart. Letters that no sample holds have one class, which no automaton knows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyspark.llm.common import id_and_text, raw_bytes, slices

#: The sample of labelled rows: at most this many characters a language, and TOTAL_CHARS over all of them.
SAMPLE_CHARS = 20_000
TOTAL_CHARS = 320_000
#: Rows drawn for a language before the character bound applies, and the length above which rows are drawn last.
SAMPLE_ROWS = 200
LONG_ROW = 4_000
BLOCK = 256
UNDETERMINED = "und"
#: Languages that are learned, the most frequent labels.
LANGUAGES = 1_000
#: Letters with a class of their own; the rest is spelled by one of HIGHS - 1 first and one of LOWS second classes.
FREQUENT = 61
HIGHS, LOWS = 128, 64
SPELLED = (HIGHS - 1) * LOWS

_NONE, _GAP, _PAD, _FIRST = 0, 1, 2, 3
_HIGH, _LOW = _FIRST + FREQUENT, _FIRST + FREQUENT + HIGHS
_COUNT_SHIFT, _STATE_MASK = np.uint32(30), np.uint32((1 << 30) - 1)
_letters: dict[str, np.ndarray] = {}


def _is_letter() -> np.ndarray:
    if "is" not in _letters:
        _letters["is"] = np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000)
    return _letters["is"]


def held_out() -> F.Column:
    return F.crc32(F.col("doc_id").cast("string")) % 4 == 2


def training_sample(docs: DataFrame) -> dict[str, list[str]]:
    """At most SAMPLE_CHARS of text for each language, from rows that are not held out, in the order of a hash of doc_id."""
    labelled = docs.filter(F.col("lang").isNotNull() & ~held_out())
    counts = labelled.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(LANGUAGES).collect()
    if not counts:
        return {}
    share = F.create_map(*(x for r in counts for x in (F.lit(r["lang"]), F.lit(min(1.0, SAMPLE_ROWS / r["count"])))))
    order = F.xxhash64(F.col("doc_id").cast("string"), F.lit(17))
    budget = min(SAMPLE_CHARS, TOTAL_CHARS // len(counts))
    drawn = (
        labelled.filter(F.pmod(order, F.lit(1 << 30)) < F.element_at(share, F.col("lang")) * (1 << 30))
        .select("lang", "text", order.alias("key"))
        .filter("text is not null")
        .select("lang", F.substring("text", 1, budget).alias("text"), "key", (F.length("text") > LONG_ROW).alias("long"))
    )
    out: dict[str, list[str]] = {}
    for r in sorted(drawn.collect(), key=lambda r: (r["lang"], r["long"], r["key"], r["text"])):
        have = out.setdefault(r["lang"], [])
        room = budget - sum(map(len, have))
        if room > 0:
            have.append(r["text"][:room])
    return out


def _codes_tables(samples: dict[str, list[str]]) -> tuple[np.ndarray, np.ndarray]:
    """First and second class of every code point: gap for what is no letter, one class a frequent letter (both cases).

    Other letters of the samples have two classes; where there is no second class it is 0.
    """
    seen: dict[str, int] = {}
    for texts in samples.values():
        for ch in "".join(texts).lower():
            if ch.isalpha():
                seen[ch] = seen.get(ch, 0) + 1
    first = np.where(_is_letter(), _HIGH + HIGHS - 1, _GAP).astype(np.uint8)
    second = np.full(len(first), _NONE, np.uint8)
    for i, ch in enumerate(sorted(seen, key=lambda ch: (-seen[ch], ch))[: FREQUENT + SPELLED]):
        codes = (_FIRST + i, _NONE) if i < FREQUENT else (_HIGH + (i - FREQUENT) // LOWS, _LOW + (i - FREQUENT) % LOWS)
        for form in {ch, ch.upper()}:
            if len(form) == 1:
                first[ord(form)], second[ord(form)] = codes
    return first, second


def spelled(points: np.ndarray, first: np.ndarray, second: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The classes of code points in order, and how many classes stand before each (points + 1 entries)."""
    head, tail = first[points], second[points]
    two = tail != _NONE
    before = np.zeros(len(points) + 1, np.int64)
    np.cumsum(1 + two, out=before[1:])
    if not two.any():
        return head, before
    out = np.empty(int(before[-1]), np.uint8)
    out[before[:-1]] = head
    out[before[1:][two] - 1] = tail[two]
    return out, before


def automaton(codes: list[int], width: int) -> np.ndarray:
    """The parse table of the suffix automaton of codes: entry [state, class] = phrases ended << 30 | next state * width."""
    links, lengths, edges = [-1], [0], [{}]
    last = 0
    for c in codes:
        state = len(links)
        links.append(0)
        lengths.append(lengths[last] + 1)
        edges.append({})
        p = last
        while p >= 0 and c not in edges[p]:
            edges[p][c] = state
            p = links[p]
        if p >= 0:
            q = edges[p][c]
            if lengths[q] == lengths[p] + 1:
                links[state] = q
            else:
                copy = len(links)
                links.append(links[q])
                lengths.append(lengths[p] + 1)
                edges.append(dict(edges[q]))
                links[q] = links[state] = copy
                while p >= 0 and edges[p].get(c) == q:
                    edges[p][c] = copy
                    p = links[p]
        last = state
    step = np.zeros((len(links), width), np.uint32)
    for s, out in enumerate(edges):
        for c, to in out.items():
            step[s, c] = to * width
    root = step[0].copy()
    missing = step == 0
    # No match: the phrase ends, the next starts with this character; one unknown to the sample is a phrase of its own.
    table = np.where(missing, root[None, :] | np.where(root == 0, np.uint32(2), np.uint32(1)) << _COUNT_SHIFT, step)
    table[0] = np.where(root == 0, np.uint32(1) << _COUNT_SHIFT, root)
    table[:, _PAD] = np.uint32(1) << _COUNT_SHIFT
    table[0, _PAD] = 0
    return table.astype(np.uint32).ravel()


class Model:
    """Parse tables by language, in the order of the names.

    A pickled model is its samples, at most TOTAL_CHARS of text; workers build the tables themselves.
    """

    def __init__(self, samples: dict[str, list[str]]):
        self.samples = samples
        first, second = _codes_tables(samples)
        points = {k: [np.frombuffer(t.encode("utf-32-le", "surrogatepass"), np.uint32) for t in samples[k]] for k in sorted(samples)}
        # Tables have columns for the classes of the samples; all others share the last column, which leads nowhere.
        seen = np.zeros(_LOW + LOWS, bool)
        for texts in points.values():
            for t in texts:
                seen[first[t]] = seen[second[t]] = True
        used = [c for c in np.flatnonzero(seen).tolist() if c >= _FIRST]
        self.width = _FIRST + len(used) + 1
        column = np.full(_LOW + LOWS, self.width - 1, np.uint8)
        column[:_FIRST] = np.arange(_FIRST)
        column[used] = _FIRST + np.arange(len(used))
        self.first, self.second = column[first], column[second]
        self.names, self.tables, self.bits = [], [], []
        for name, texts in points.items():
            codes = [c for t in texts for c in [*squeeze(spelled(t, self.first, self.second)[0]).tolist(), _GAP]]
            if len(codes) > 1:
                self.names.append(name)
                self.tables.append(automaton(codes, self.width))
                self.bits.append(float(np.log2(len(codes) + 1)))

    def __reduce__(self):
        return Model, (self.samples,)

    def costs(self, text: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Bits a character under every language, (rows, languages), and whether a row has a letter."""
        data, offsets = raw_bytes(text)
        points = np.frombuffer(data.tobytes().decode("utf-8", "replace").encode("utf-32-le"), np.uint32)
        chars = np.zeros(len(data) + 1, np.int64)
        np.cumsum((data & 0xC0) != 0x80, out=chars[1:])
        bounds = chars[offsets]
        letters = np.zeros(len(points) + 1, np.int64)
        np.cumsum(_is_letter()[points], out=letters[1:])
        has_letter = letters[bounds[1:]] > letters[bounds[:-1]]
        codes, before = spelled(points, self.first, self.second)
        bounds = before[bounds]
        fresh = np.ones(len(codes), bool)
        fresh[1:] = (codes[1:] != _GAP) | (codes[:-1] != _GAP)
        inner = bounds[1:-1]
        fresh[inner[inner < len(codes)]] = True
        kept = np.zeros(len(codes) + 1, np.int64)
        np.cumsum(fresh, out=kept[1:])
        codes, bounds = codes[fresh], kept[bounds]
        sizes = np.diff(bounds)
        blocks = -(-sizes // BLOCK)
        row = np.repeat(np.arange(len(sizes)), blocks)
        nth = np.arange(len(row)) - np.repeat(np.cumsum(blocks) - blocks, blocks)
        start = bounds[row] + nth * BLOCK
        length = np.minimum(BLOCK, bounds[row + 1] - start)
        order = np.argsort(-length, kind="stable")
        start, length, row = start[order], length[order], row[order]
        out = np.zeros((len(sizes), len(self.names)))
        live = np.searchsorted(-length, -np.arange(BLOCK + 1), side="right")  # blocks with at least t codes
        for k, table in enumerate(self.tables):
            state = np.zeros(len(start), np.uint32)
            ended = np.zeros(len(start), np.uint32)
            for t in range(BLOCK):
                n = live[t + 1]
                if n == 0:
                    break
                entry = table[state[:n] + codes[start[:n] + t]]
                ended[:n] += entry >> _COUNT_SHIFT
                state[:n] = entry & _STATE_MASK
            ended += state != 0
            out[:, k] = np.bincount(row, weights=ended, minlength=len(sizes)) * self.bits[k]
        return out / np.maximum(sizes, 1)[:, None], has_letter


def squeeze(codes: np.ndarray) -> np.ndarray:
    keep = np.ones(len(codes), bool)
    keep[1:] = (codes[1:] != _GAP) | (codes[:-1] != _GAP)
    return codes[keep]


def _named(m: Model, text: pa.Array) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Language, score and whether there is a letter, for every text."""
    costs, has_letter = m.costs(text)
    if not m.names:
        return [UNDETERMINED] * len(text), np.zeros(len(text)), has_letter
    best = costs.argmin(axis=1)
    ranked = np.sort(costs, axis=1)
    second = ranked[:, 1] if len(m.names) > 1 else np.full(len(ranked), np.inf)
    with np.errstate(divide="ignore", invalid="ignore"):
        margin = 1 - ranked[:, 0] / second
    scores = np.where(has_letter, np.clip(np.nan_to_num(margin), 0, 1), 0.0)
    return [m.names[b] if ok else UNDETERMINED for b, ok in zip(best.tolist(), has_letter.tolist(), strict=True)], scores, has_letter


def predict(docs: DataFrame, samples: dict[str, list[str]]) -> DataFrame:
    """doc_id, lang_pred and score of every row, by the automata of samples."""
    model = docs.sparkSession.sparkContext.broadcast(Model(samples))  # at most TOTAL_CHARS of sample text

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model.value
        for batch in batches:
            for part in slices(batch):
                names, scores, _ = _named(m, part.column("text"))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(names, pa.string()), pa.array(scores)], names=["doc_id", "lang_pred", "score"])

    return id_and_text(docs).mapInArrow(run, "doc_id long, lang_pred string, score double")


def identify(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, held_out, lang_pred, score.

    Learns from text and lang of the rows that are not held out. Null texts and texts without letters are `und` with score
    0, and so is everything if there is no labelled text. score is one minus the best cost over the second best. Ties go
    to the language whose name sorts first. Repeated rows are predicted alike; an empty table gives an empty result.
    """
    return predict(docs, training_sample(docs)).select("doc_id", held_out().alias("held_out"), "lang_pred", "score")


def drop_undetermined(docs: DataFrame) -> DataFrame:
    """The rows of docs that the automata do not call `und`, with all their columns; no shuffle.

    Every text is parsed as in predict(). If nothing is labelled no language can be named, and rows with letters stay.
    """
    model = docs.sparkSession.sparkContext.broadcast(Model(training_sample(docs)))  # at most TOTAL_CHARS of sample text

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model.value
        for batch in batches:
            for part in slices(batch):
                names, _, has_letter = _named(m, pc.fill_null(part.column("text"), ""))
                yield part.filter(pa.array([name != UNDETERMINED for name in names] if m.names else has_letter.tolist(), pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
