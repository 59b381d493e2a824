"""Repeated passages by relative Lempel-Ziv parsing against indexed reference blocks.

A window is WINDOW consecutive words of one document. Each window is represented by the leftmost smallest of its k-gram
hashes (its anchor), so equal windows have equal anchors at equal places. The windows of a document that share an anchor
form a block: the words from the first window's start to the last window's end. Every block of the corpus is a reference
block of the index, which has the anchor as its key; blocks of other anchors have no window in common.

* A block that equals a reference block elsewhere is one factor as a whole: all its windows repeat.
* A block with other versions under its anchor is parsed against all of them: from the first word on, words without a
  match of WINDOW words are literals; the first match is extended word by word to the longest one that any reference
  block supplies, which is the factor. At its boundary the parse goes on with the first window that crosses its end: if a
  reference block holds that, the next factor begins there. Windows repeat that lie inside a factor, and no others.
* A block that is alone under its anchor is literal.

One instance of each distinct block takes part, so a passage with any number of copies is indexed once. Blocks travel as
word hashes, to the task that holds their anchor, and only where an anchor has several versions. Anchors with more than
GROUP versions would be too much for one task: there the windows are counted by (anchor, window hash) in an aggregate,
which finds the same windows without the factors. Texts are shuffled twice, to cut the blocks that have to be parsed and
to write the result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyspark.llm.common import (
    WORD_PATTERN,
    gram_hashes,
    id_and_text,
    kept_words,
    mix,
    partitions,
    raw_bytes,
    signed,
    slices,
    span_sums,
    staged,
    word_bounds,
    word_hashes,
)

WINDOW = 35
#: Words of an anchor; WINDOW - GRAM + 1 k-grams compete for each window.
GRAM = 8
#: Versions of an anchor that one task parses against each other; larger anchors are counted by window.
GROUP = 1024
#: Bytes of block words that one parsing pass handles.
PARSE_BYTES = 8 << 20
#: Rows of an Arrow batch of blocks.
CUT_ROWS = 20_000

# A place is one long: 25 bits of the text's hash, which tell apart texts that share a doc_id, 6 bits for the number of
# window starts and 32 bits for the first one's word number in its document.
TAG_AT, COUNT_AT = 38, 32
TAG_BITS, COUNT_MASK, LOW_MASK = 25, 63, (1 << 32) - 1


def window_blocks(words: np.ndarray, counts: np.ndarray, window: int = WINDOW, gram: int = GRAM):
    """The blocks of documents whose word hashes are concatenated in words, with counts[i] words before document i.

    Returns arrays over the blocks: document, first and last window start (global word numbers), anchor hash and block
    hash.
    """
    n = len(words)
    span = window - gram + 1
    edge = np.zeros(n + 1, np.int32)
    roomy = np.flatnonzero(np.diff(counts) >= window)
    edge[counts[roomy]] += 1
    edge[counts[roomy + 1] - window + 1] -= 1
    at = np.flatnonzero(np.cumsum(edge[:n]))
    if len(at) == 0:
        return tuple(np.empty(0, np.int64) for _ in range(3)) + (np.empty(0, np.uint64), np.empty(0, np.uint64))
    grams = gram_hashes(words, gram)
    # Sliding minimum over span grams by doubling; the place of the leftmost minimum rides along.
    least, place, width = grams, np.arange(len(grams)), 1
    while width < span:
        step = min(width, span - width)
        left, right = least[: len(least) - step], least[step:]
        take = right < left
        place = np.where(take, place[step:], place[: len(place) - step])
        least = np.where(take, right, left)
        width += step
    anchor_at = place[at]
    new = np.ones(len(at), bool)
    new[1:] = (anchor_at[1:] != anchor_at[:-1]) | (at[1:] != at[:-1] + 1)
    first = np.flatnonzero(new)
    low = at[first]
    high = at[np.append(first[1:], len(at)) - 1]
    doc = np.searchsorted(counts, low, side="right") - 1
    ends = high + window
    return doc, low, high, least[low], span_sums(words, low, ends) + (ends - low).astype(np.uint64)


def scan_blocks(window: int, gram: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                data, offsets = raw_bytes(part.column("text"))
                starts, ends, counts = word_bounds(data, offsets)
                doc, low, high, anchor, block = window_blocks(word_hashes(data, starts, ends), counts, window, gram)
                ids, tags = part.column("doc_id").to_numpy(), part.column("tag").to_numpy()
                places = (tags[doc] << TAG_AT) | ((high - low + 1) << COUNT_AT) | (low - counts[doc])
                yield pa.RecordBatch.from_arrays(
                    [pa.array(signed(anchor)), pa.array(signed(block)), pa.array(ids[doc]), pa.array(places)],
                    names=["anchor", "block", "doc_id", "place"],
                )

    return run


def _flat(lists: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """The row of every entry of a list column, and the entries; null lists are empty."""
    sizes = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False)
    return np.repeat(np.arange(len(lists)), sizes), lists.flatten()


def _ranges(low: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """low[0], low[0] + 1, ... sizes[0] of them, then the same for the next."""
    before = np.cumsum(sizes) - sizes
    return np.repeat(low - before, sizes) + np.arange(int(sizes.sum()))


def cut_blocks(window: int):
    """The blocks named in cuts, with the hashes of their words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                data, offsets = raw_bytes(part.column("text"))
                starts, ends, counts = word_bounds(data, offsets)
                words = word_hashes(data, starts, ends)
                row, cuts = _flat(part.column("cuts"))
                place = cuts.field("place").to_numpy()
                mine = np.flatnonzero(place >> TAG_AT == part.column("tag").to_numpy()[row])
                ids = part.column("doc_id").to_numpy()
                for some in np.array_split(mine, max(1, len(mine) // CUT_ROWS)):
                    sizes = (place[some] >> COUNT_AT & COUNT_MASK) + window - 1
                    body = words[_ranges(counts[row[some]] + (place[some] & LOW_MASK), sizes)]
                    at = np.concatenate(([0], np.cumsum(8 * sizes))).astype(np.int32)
                    bodies = pa.Array.from_buffers(pa.binary(), len(some), [None, pa.py_buffer(at), pa.py_buffer(body)])
                    kept = cuts.take(pa.array(some))
                    yield pa.RecordBatch.from_arrays(
                        [kept.field("anchor"), kept.field("hot"), pa.array(ids[row[some]]), kept.field("place"), kept.field("own"), bodies],
                        names=["anchor", "hot", "doc_id", "place", "own", "words"],
                    )

    return run


CUT = "anchor long, hot boolean, doc_id long, place long, own boolean, words binary"


def _whole_groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by anchor as batches of about PARSE_BYTES that hold whole anchors."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        held.append(batch)
        if sum(b.nbytes for b in held) < PARSE_BYTES:
            continue
        rows = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
        anchor = rows.column("anchor").to_numpy()
        cut = int(np.flatnonzero(np.concatenate(([True], anchor[1:] != anchor[:-1])))[-1])
        if cut:
            yield rows.slice(0, cut)
        held = [rows.slice(cut)]
    if rows := sum(b.num_rows for b in held):
        yield from pa.Table.from_batches(held).combine_chunks().to_batches(max_chunksize=rows)


def _block_starts(rows: pa.RecordBatch, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The words of all blocks, their first words, their numbers of window starts, and all window starts."""
    bodies = rows.column("words")
    at = np.frombuffer(bodies.buffers()[1], np.int32, len(bodies) + 1, 4 * bodies.offset).astype(np.int64)
    words = np.frombuffer(bodies.buffers()[2], np.uint8)[at[0] : at[-1]].view(np.uint64)
    firsts = (at[:-1] - at[0]) // 8
    n = np.diff(at) // 8 - window + 1
    return words, firsts, n, _ranges(firsts, n)


def _classes(keys: np.ndarray, groups: np.ndarray) -> np.ndarray:
    """A number for each distinct (group, key), in the order of the entries."""
    order = np.argsort(keys, kind="stable")
    new = np.ones(len(keys), bool)
    new[1:] = (keys[order][1:] != keys[order][:-1]) | (groups[order][1:] != groups[order][:-1])
    out = np.empty(len(keys), np.int64)
    out[order] = np.cumsum(new) - 1
    return out


def parse_factors(words: np.ndarray, firsts: np.ndarray, n: np.ndarray, starts: np.ndarray, groups: np.ndarray, own: np.ndarray, window: int):
    """The greedy parse of the blocks that are own against all blocks of their group.

    Returns over starts: whether a match begins there, that is, another block of the group holds its window (the index that
    factors are looked up in), and the length of the factor that begins there (0 where none does).
    """
    block = np.repeat(np.arange(len(firsts)), n)
    ends = (firsts + n + window - 1)[block]
    group = groups[block]
    salted = mix(group.astype(np.uint64) + np.uint64(1))
    seen = _classes(mix(span_sums(words, starts, starts + window) ^ salted), group)
    matched = np.bincount(seen)[seen] > 1
    # From the first word on, words where no match begins are literals. After a factor the parse goes on with the window
    # that crosses the factor's end first: if that has a match, the next factor begins there.
    hits = np.flatnonzero(matched & own[block])
    factor = np.zeros(len(starts), np.int64)
    at, last = np.cumsum(n) - n, np.cumsum(n)
    while True:
        place = np.searchsorted(hits, at)
        open_ = place < len(hits)
        begins = hits[np.minimum(place, len(hits) - 1)] if len(hits) else np.empty(0, np.int64)
        open_ &= begins < last if len(hits) else False
        if not open_.any():
            return matched, factor
        begins = begins[open_]
        factor[begins] = extended(words, starts, ends, matched, seen, begins, window)
        at = last.copy()
        at[open_] = begins + factor[begins] - window + 1


def extended(words: np.ndarray, starts: np.ndarray, ends: np.ndarray, matched: np.ndarray, seen: np.ndarray, begins: np.ndarray, window: int) -> np.ndarray:
    """The length of the longest match of each factor that begins at begins: word by word, among the reference places that
    agree so far with the start of some factor."""
    begun = np.zeros(len(starts), bool)
    begun[begins] = True
    length_of = np.zeros(len(starts), np.int64)
    length_of[begins] = window
    live, length = np.flatnonzero(matched), window
    classes = seen[live]
    while len(live):
        wanted = np.bincount(classes, weights=begun[live]) > 0
        keep = wanted[classes] & (starts[live] + length < ends[live])
        live, classes = live[keep], classes[keep]
        if len(live) == 0:
            break
        grown = mix(words[starts[live] + length] ^ mix(classes.astype(np.uint64) + np.uint64(1)))
        classes = _classes(grown, classes)
        keep = np.bincount(classes)[classes] > 1
        live, classes, length = live[keep], classes[keep], length + 1
        length_of[live[begun[live]]] = length
    return length_of[begins]


def parse_blocks(window: int):
    """Rows sorted by anchor: the windows of own blocks that repeat, as places."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _whole_groups(batches):
            words, firsts, n, starts = _block_starts(rows, window)
            anchor = rows.column("anchor").to_numpy()
            groups = np.concatenate(([0], np.cumsum(anchor[1:] != anchor[:-1])))
            own = rows.column("own").to_numpy(zero_copy_only=False)
            _, factor = parse_factors(words, firsts, n, starts, groups, own, window)
            block = np.repeat(np.arange(len(firsts)), n)
            # What lies within a factor repeats, and nothing else does.
            begins = np.flatnonzero(factor)
            edge = np.bincount(begins, minlength=len(starts) + 1) - np.bincount(begins + factor[begins] - window + 1, minlength=len(starts) + 1)
            found = np.flatnonzero(np.cumsum(edge[:-1]) > 0)
            new = np.ones(len(found), bool)
            new[1:] = (found[1:] != found[:-1] + 1) | (block[found[1:]] != block[found[:-1]])
            first = np.flatnonzero(new)
            size = np.diff(np.append(first, len(found)))
            of, low = block[found[first]], starts[found[first]]
            place = rows.column("place").to_numpy()[of]
            place = (place >> TAG_AT << TAG_AT) | (size << COUNT_AT) | ((place & LOW_MASK) + low - firsts[of])
            yield pa.RecordBatch.from_arrays([pa.array(rows.column("doc_id").to_numpy()[of]), pa.array(place)], names=["doc_id", "place"])

    return run


def block_windows(window: int):
    """Every window of the blocks by itself: anchor, hash, doc_id, place (of this window alone), own."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            if rows.num_rows == 0:
                continue
            words, firsts, n, starts = _block_starts(rows, window)
            of = np.repeat(np.arange(len(firsts)), n)
            place = rows.column("place").to_numpy()[of]
            place = (place >> TAG_AT << TAG_AT) | (1 << COUNT_AT) | ((place & LOW_MASK) + starts - firsts[of])
            hashes = span_sums(words, starts, starts + window)
            picked = rows.select(["anchor", "doc_id", "own"]).take(pa.array(of))
            yield pa.RecordBatch.from_arrays(
                [picked.column("anchor"), pa.array(signed(hashes)), picked.column("doc_id"), pa.array(place), picked.column("own")],
                names=["anchor", "hash", "doc_id", "place", "own"],
            )

    return run


OUT_NAMES = ("doc_id", "n_words", "n_removed", "kept_sha256", "kept_text")
RESULT = "doc_id long, n_words long, n_removed long, kept_sha256 string, kept_text string"


def write_kept(window: int, texts: bool):
    """Per document what is left, given the places of the windows that repeat (whole: by whole blocks, found: by parse)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                data, offsets = raw_bytes(part.column("text"))
                starts, ends, counts = word_bounds(data, offsets)
                tags = part.column("tag").to_numpy()
                edge = np.zeros(int(counts[-1]) + 1, np.int64)
                for column in ("whole", "found"):
                    row, places = _flat(part.column(column))
                    places = places.to_numpy()
                    mine = places >> TAG_AT == tags[row]
                    low = (counts[row] + (places & LOW_MASK))[mine]
                    high = low + (places >> COUNT_AT & COUNT_MASK)[mine] + window - 1
                    edge += np.bincount(low, minlength=len(edge))[: len(edge)] - np.bincount(high, minlength=len(edge))[: len(edge)]
                gone = np.cumsum(edge[:-1]) > 0
                text, at = kept_words(data, offsets, starts, ends, counts, gone)
                removed = np.diff(np.concatenate(([0], np.cumsum(gone)))[counts])
                rows = [text[a:b] for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column("doc_id"),
                        pa.array(np.diff(counts)),
                        pa.array(removed),
                        pa.array([hashlib.sha256(x).hexdigest() for x in rows], pa.string()),
                        pa.array([x.decode() for x in rows], pa.string()) if texts else pa.nulls(len(rows), pa.string()),
                    ],
                    names=list(OUT_NAMES),
                )

    return run


def remove_repeats(docs: DataFrame, window: int = WINDOW, gram: int = GRAM, texts: bool = False, group: int = GROUP) -> DataFrame:
    """One row per document: doc_id, n_words, n_removed, kept_sha256, and with texts also kept_text.

    A word goes if a window that covers it starts anywhere else too, in the same document or another. Null text has no
    words; documents shorter than a window lose nothing; a document repeated under its own or another doc_id loses all
    words of its windows on both sides. Texts that share a doc_id are told apart by a hash. Rows without a doc_id take no
    part; other columns are not read. An empty table gives an empty result. window - gram has to be below 63.
    """
    if not 0 <= window - gram < COUNT_MASK:
        raise ValueError("window - gram has to be from 0 to 62")
    source = id_and_text(docs).withColumn("tag", F.hash("text").bitwiseAND((1 << TAG_BITS) - 1).cast("long"))
    blocks = staged(source.mapInArrow(scan_blocks(window, gram), "anchor long, block long, doc_id long, place long"), "blocks")
    # One entry per distinct block, with its number of places and the first of them.
    entries = blocks.groupBy("anchor", "block").agg(F.count(F.lit(1)).alias("places"), F.min(F.struct("doc_id", "place")).alias("shown_at"))
    anchors = entries.groupBy("anchor").agg(F.count(F.lit(1)).alias("versions"), F.sum("places").alias("total"))
    known = staged(
        entries.join(anchors.filter("total > 1"), "anchor").select("anchor", "block", "places", "shown_at", "versions"), "known"
    )
    own = F.col("places") == 1
    takes_part = (F.col("versions") > 1) & (own | (F.col("shown_at") == F.struct("doc_id", "place")))
    cut = F.struct("anchor", "place", own.alias("own"), (F.col("versions") > group).alias("hot"))
    findings = staged(
        blocks.join(known, ["anchor", "block"])
        .groupBy("doc_id")
        .agg(F.collect_list(F.when(~own, F.col("place"))).alias("whole"), F.collect_list(F.when(takes_part, cut)).alias("cuts")),
        "findings",
    )
    parsed_docs = source.join(findings.filter("size(cuts) > 0").select("doc_id", "cuts"), "doc_id")
    cuts = staged(parsed_docs.select("doc_id", "text", "tag", "cuts").mapInArrow(cut_blocks(window), CUT), "cuts")
    index = cuts.filter("not hot").repartition(partitions(docs.sparkSession), "anchor").sortWithinPartitions("anchor")
    parsed = index.mapInArrow(parse_blocks(window), "doc_id long, place long")
    # Anchors with very many versions. Rows of one key come from distinct blocks, so two of them are two places.
    windows = cuts.filter("hot").mapInArrow(block_windows(window), "anchor long, hash long, doc_id long, place long, own boolean")
    repeated = windows.groupBy("anchor", "hash").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").drop("n")
    counted = windows.filter("own").join(repeated, ["anchor", "hash"]).select("doc_id", "place")
    found = parsed.union(counted).groupBy("doc_id").agg(F.collect_list("place").alias("found"))
    out = (
        source.join(findings.select("doc_id", "whole"), "doc_id", "left")
        .join(found, "doc_id", "left")
        .select("doc_id", "text", "tag", "whole", "found")
        .mapInArrow(write_kept(window, texts), RESULT)
    )
    return out if texts else out.drop("kept_text")


def repeats_by_brute_force(docs: list[tuple[int, str | None]], window: int = WINDOW) -> list[tuple[int, int, int, str]]:
    """The contract's definition, word for word, for small inputs in tests."""
    import re
    from collections import Counter

    words = {d: re.findall(WORD_PATTERN, t or "") for d, t in docs}
    seen = Counter(tuple(w[i : i + window]) for w in words.values() for i in range(len(w) - window + 1))
    out = []
    for d, w in words.items():
        gone = {j for i in range(len(w) - window + 1) if seen[tuple(w[i : i + window])] > 1 for j in range(i, i + window)}
        kept = " ".join(x for i, x in enumerate(w) if i not in gone)
        out.append((d, len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return out
