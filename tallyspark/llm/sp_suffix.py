"""SentencePiece BPE encoding by suffix-array matching, and decoding.

Texts are cut where no piece can reach across (before a run of spaces, around other white space), and the distinct cuts
of a batch are concatenated. A suffix array over that text, sorted as deep as the longest piece, is searched for every
piece of the vocabulary by binary search; each range of suffixes gives the occurrences of a piece as edges (position,
length, piece), which are sorted by position into a table. Relaxation then follows the model's own order: in every cut the
best-scored edge that joins two neighbouring symbols, leftmost first, is taken until none is left. All cuts of a batch
relax in step; cuts of more than LONG_CUT characters use a heap over the same edges. Characters without a piece become
byte pieces. The ids equal those of the sentencepiece library.
"""

from __future__ import annotations

import heapq
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyspark.llm.common import raw_bytes, slices
from tallyspark.llm.rans import Remembered

SPACE = "▁"
_SPACE_BYTES = np.frombuffer(SPACE.encode(), np.uint8)
#: Characters of distinct cuts that one suffix array indexes, and bytes of text that share it.
BATCH_CHARS = 300_000
BATCH_BYTES = 6 << 20
LONG_CUT = 400


class Pieces(Remembered):
    """A BPE vocabulary: pieces, their order of merging, and byte pieces."""

    def __init__(self, path: str):
        import sentencepiece

        super().__init__()
        model = sentencepiece.SentencePieceProcessor(model_file=path)
        size = model.get_piece_size()
        usable = [i for i in range(size) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i))]
        self.texts = {i: model.id_to_piece(i) for i in usable}
        self.bytes = {int(model.id_to_piece(i)[3:5], 16): i for i in range(size) if model.is_byte(i)}
        self.unknown = model.unk_id()
        scores = np.full(size, -np.inf)
        for i in usable:
            scores[i] = model.get_score(i)
        self.order = np.unique(scores, return_inverse=True)[1].astype(np.int64)  # higher merges first
        self.depth = max(map(len, self.texts.values()))
        self.ids = np.array(sorted(self.texts, key=lambda i: self.texts[i]), np.int64)
        self.lengths = np.array([len(self.texts[i]) for i in self.ids], np.int64)
        self.chars = np.zeros((len(self.ids), self.depth), np.uint32)
        for row, i in enumerate(self.ids):
            self.chars[row, : self.lengths[row]] = [ord(c) for c in self.texts[i]]
        plain = [self.texts.get(i, "").replace(SPACE, " ").encode() for i in range(size)]
        for b, i in self.bytes.items():
            plain[i] = bytes([b])
        self.out_size = np.array([len(x) for x in plain], np.int64)
        self.out_first = np.cumsum(self.out_size) - self.out_size
        self.out_flat = np.frombuffer(b"".join(plain), np.uint8)

    def edges(self, text: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Position, length and id of every occurrence of a piece in text, sorted by position."""
        n = len(text)
        rank = np.unique(text, return_inverse=True)[1].astype(np.int64)
        width = 1
        while width < self.depth:
            after = np.zeros(n, np.int64)
            after[: max(n - width, 0)] = rank[width:] + 1
            key = rank * (n + 2) + after
            suffixes = np.argsort(key, kind="stable")
            step = np.concatenate(([False], key[suffixes][1:] != key[suffixes][:-1]))
            rank = np.empty(n, np.int64)
            rank[suffixes] = np.cumsum(step)
            width *= 2
        suffixes = np.argsort(rank, kind="stable")
        padded = np.concatenate((text, np.zeros(self.depth, text.dtype)))
        low, high = np.zeros(len(self.ids), np.int64), np.full(len(self.ids), n, np.int64)
        for d in range(self.depth):
            live = np.flatnonzero((self.lengths > d) & (high > low))
            want = self.chars[live, d]
            a = _bound(padded, suffixes, low[live], high[live], want, d, False)
            b = _bound(padded, suffixes, a, high[live], want, d, True)
            low[live], high[live] = a, b
        found = np.flatnonzero(high > low)
        count = (high - low)[found]
        piece = np.repeat(found, count)
        at = suffixes[np.arange(int(count.sum())) + np.repeat(low[found] - (np.cumsum(count) - count), count)]
        order = np.argsort(at, kind="stable")
        return at[order], self.lengths[piece][order], self.ids[piece][order]

    def fresh(self, words: list[str]) -> list[np.ndarray]:
        out, low, total = [], 0, 0
        for i, w in enumerate(words):
            total += len(w) + 1
            if total >= BATCH_CHARS:
                out += self._relaxed(words[low : i + 1])
                low, total = i + 1, 0
        return out + (self._relaxed(words[low:]) if low < len(words) else [])

    def _relaxed(self, cuts: list[str]) -> list[np.ndarray]:
        joined = "\0".join(c.replace(" ", SPACE).replace("\0", "￾") for c in cuts) + "\0"  # a NUL in a text has no piece
        text = np.frombuffer(joined.encode("utf-32-le"), np.uint32)
        at, length, piece = self.edges(text)
        table = np.full((len(text), self.depth + 1), -1, np.int32)
        table[at, length] = piece
        ends = np.flatnonzero(text == 0)
        starts = np.concatenate(([0], ends[:-1] + 1))
        sizes = ends - starts
        done: list[np.ndarray | None] = [None] * len(cuts)
        for k in np.flatnonzero(sizes > LONG_CUT):
            done[k] = self._named(*self._relax_long(table, int(starts[k]), int(sizes[k])), table, cuts[k], int(starts[k]))
        live = np.flatnonzero((sizes <= LONG_CUT) & (sizes > 0))
        cut = np.repeat(live, sizes[live])
        begin = np.arange(len(cut)) - np.repeat(np.cumsum(sizes[live]) - sizes[live], sizes[live]) + starts[cut]
        size = np.ones(len(cut), np.int64)
        finished = []
        while len(cut):
            merged = np.minimum(size[:-1] + size[1:], self.depth + 1)
            fits = (cut[1:] == cut[:-1]) & (merged <= self.depth)
            made = np.where(fits, table[begin[:-1], np.minimum(merged, self.depth)], -1)
            score = np.concatenate((np.where(made >= 0, self.order[made], -1), [-1]))
            first = np.flatnonzero(np.concatenate(([True], cut[1:] != cut[:-1])))
            group = np.cumsum(np.concatenate(([0], cut[1:] != cut[:-1])))
            best = np.maximum.reduceat(score, first)
            still = best[group] >= 0
            finished.append((cut[~still], begin[~still], size[~still]))
            hit = np.flatnonzero((score == best[group]) & still)
            hit = hit[np.concatenate(([True], group[hit][1:] != group[hit][:-1]))] if len(hit) else hit
            size[hit] += size[hit + 1]
            keep = still
            keep[hit + 1] = False
            cut, begin, size = cut[keep], begin[keep], size[keep]
        if finished:
            cut, begin, size = (np.concatenate(x) for x in zip(*finished, strict=True))
            order = np.argsort(begin, kind="stable")
            cut, begin, size = cut[order], begin[order], size[order]
            lows = np.searchsorted(cut, live)
            highs = np.searchsorted(cut, live, side="right")
            names = table[begin, size]
            odd = set(cut[names < 0].tolist())
            for k, a, b in zip(live.tolist(), lows.tolist(), highs.tolist(), strict=True):
                done[k] = self._named(begin[a:b], size[a:b], table, cuts[k], int(starts[k])) if k in odd else names[a:b]
        return [np.empty(0, np.int32) if d is None else d for d in done]

    def _named(self, begin: np.ndarray, size: np.ndarray, table: np.ndarray, cut: str, start: int) -> np.ndarray:
        """Ids of symbols; a character without a piece becomes its bytes."""
        out: list[int] = []
        for b, s in zip(begin.tolist(), size.tolist(), strict=True):
            piece = int(table[b, s])
            out += [piece] if piece >= 0 else [self.bytes.get(x, self.unknown) for x in cut[b - start : b - start + s].encode()]
        return np.array(out, np.int32)

    def _relax_long(self, table: np.ndarray, start: int, n: int) -> tuple[np.ndarray, np.ndarray]:
        size, following, previous = [1] * n, list(range(1, n + 1)), list(range(-1, n - 1))
        heap: list[tuple[int, int, int]] = []

        def offer(i: int) -> None:
            j = following[i]
            if i >= 0 and j < n and (total := size[i] + size[j]) <= self.depth and (piece := int(table[start + i, total])) >= 0:
                heapq.heappush(heap, (-int(self.order[piece]), i, total))

        for i in range(n - 1):
            offer(i)
        while heap:
            _, i, total = heapq.heappop(heap)
            j = following[i] if size[i] else n
            if j >= n or not size[i] or size[i] + size[j] != total:
                continue
            size[i], size[j], following[i] = total, 0, following[j]
            if following[i] < n:
                previous[following[i]] = i
            offer(i)
            if previous[i] >= 0:
                offer(previous[i])
        at = np.flatnonzero(np.array(size))
        return at + start, np.array(size)[at]

    def decode(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The bytes of all ids (the prefix space of every text included) and the number of bytes of each id."""
        size = self.out_size[ids]
        ends = np.cumsum(size)
        take = np.arange(int(ends[-1]) if len(ends) else 0) + np.repeat(self.out_first[ids] - (ends - size), size)
        return self.out_flat[take], size

    def text(self, ids: list[int]) -> str:
        """The text of ids."""
        out, _ = self.decode(np.array(ids, np.int64))
        return out.tobytes().decode("utf-8", "replace").removeprefix(" ")


def _bound(text: np.ndarray, suffixes: np.ndarray, low: np.ndarray, high: np.ndarray, want: np.ndarray, depth: int, after: bool) -> np.ndarray:
    """Binary search in each range [low, high) of suffixes for the first whose character at depth is >= want (> with after)."""
    low, high = low.copy(), high.copy()
    while True:
        open_ = np.flatnonzero(low < high)
        if len(open_) == 0:
            return low
        middle = (low[open_] + high[open_]) >> 1
        got = text[suffixes[middle] + depth]
        right = got <= want[open_] if after else got < want[open_]
        low[open_[right]] = middle[right] + 1
        high[open_[~right]] = middle[~right]


def cut_texts(text: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray]:
    """The cuts of all rows, the number of cuts before each row, and the prefixed bytes with their row offsets."""
    data, offsets = raw_bytes(text)
    full = np.flatnonzero(np.diff(offsets))
    data = np.insert(data, offsets[:-1][full], 0x20)
    added = np.zeros(len(offsets), np.int64)
    added[1:] = np.cumsum(np.diff(offsets) > 0)
    offsets = offsets + added
    blank, other = data == 0x20, np.isin(data, (9, 10, 11, 12, 13))
    cut = np.zeros(len(data), bool)
    cut[1:] = (blank[1:] & ~blank[:-1]) | other[1:] | other[:-1]
    mark = np.flatnonzero((data[2:] == _SPACE_BYTES[2]) & (data[1:-1] == _SPACE_BYTES[1]) & (data[:-2] == _SPACE_BYTES[0])) + 3
    cut[mark[mark < len(data)]] = False  # a mark in the text itself joins the spaces after it
    cut[offsets[:-1][full]] = True
    begin = np.flatnonzero(cut)
    cuts = pa.StringArray.from_buffers(len(begin), pa.py_buffer(np.append(begin, len(data)).astype(np.int32)), pa.py_buffer(data))
    return cuts, np.searchsorted(begin, offsets), data, offsets


_workers: dict[str, Pieces] = {}


def pieces(path: str) -> Pieces:
    """The worker's own vocabulary, loaded once."""
    if path not in _workers:
        _workers[path] = Pieces(path)
    return _workers[path]


def encode_batch(part: pa.RecordBatch, vocabulary: Pieces) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ids of all rows, the number of ids of each row, and whether each row's ids decode to its text again."""
    cuts, before, data, offsets = cut_texts(part.column("text"))
    ids, per_cut = vocabulary.encode(cuts)
    at = np.concatenate(([0], np.cumsum(per_cut)))[before]
    back, size = vocabulary.decode(ids)
    plain = data.tobytes()
    if SPACE.encode() in plain:  # the mark decodes to a space
        rows = [plain[a:b].replace(SPACE.encode(), b" ") for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)]
        data, offsets = np.frombuffer(b"".join(rows), np.uint8), np.concatenate(([0], np.cumsum([len(r) for r in rows])))
    reached = np.concatenate(([0], np.cumsum(size)))[at]
    same_ends = reached == offsets
    wrong = np.concatenate(([0], np.cumsum(back != data))) if len(back) == len(data) else np.zeros(1, np.int64)
    exact = same_ends[1:] & same_ends[:-1] & (np.diff(wrong[offsets]) == 0 if len(back) == len(data) else False)
    return ids, np.diff(at), exact


ENCODED = "doc_id long, n_pieces long, ids_crc32 long, round_trip boolean, ids array<int>"


def encode(docs: DataFrame, model_path: str, ids: bool = False, carry: tuple[str, ...] = ()) -> DataFrame:
    """One row per document: doc_id, n_pieces, ids_crc32 (ids as little-endian uint32), round_trip, and with ids the ids.

    carry names columns of docs that go along as text. Rows that share a doc_id or have none are rows like others.

    Null and empty texts have no pieces and round-trip. Decoding cannot tell the space mark U+2581 in a text from a space;
    round_trip compares with spaces in its place. An empty table gives an empty result; other columns are not read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = pieces(model_path)
        for batch in batches:
            for part in slices(batch, limit=BATCH_BYTES):
                found, count, exact = encode_batch(part, vocabulary)
                found, ends = found.astype("<u4"), np.cumsum(count)
                crcs = [zlib.crc32(found[a:b].tobytes()) for a, b in zip((ends - count).tolist(), ends.tolist(), strict=True)]
                if ids:
                    lists = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], ends)).astype(np.int32)), pa.array(found.view(np.int32)))
                else:
                    lists = pa.nulls(len(count), pa.list_(pa.int32()))
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), pa.array(count, pa.int64()), pa.array(crcs, pa.int64()), pa.array(exact), lists, *(part.column(f"__{c}") for c in carry)],
                    names=["doc_id", "n_pieces", "ids_crc32", "round_trip", "ids", *carry],
                )

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"), *(F.col(c).cast("string").alias(f"__{c}") for c in carry))
    out = rows.mapInArrow(run, ", ".join([ENCODED, *(f"`{c}` string" for c in carry)]))
    return out if ids else out.drop("ids")


def decode(encoded: DataFrame, model_path: str) -> DataFrame:
    """doc_id and text of encoded(doc_id, ids)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = pieces(model_path)
        for batch in batches:
            texts = [vocabulary.text(x or []) for x in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(texts, pa.string())], names=["doc_id", "text"])

    return encoded.select(F.col("doc_id").cast("long").alias("doc_id"), "ids").mapInArrow(run, "doc_id long, text string")
