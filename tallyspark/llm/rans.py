"""Token ids in files coded by a static range asymmetric numeral system (rANS).

A file is a Parquet container of segments, each a self-contained frame of whole documents in ascending doc_id order:

    header   magic, counts, length of a block, steps between checkpoints, CRC-32 of the ids and of the words
    docs     doc_id (int64) and number of ids (uint32) of every document
    table    symbols (uint32) and frequencies less one (uint16), which sum to 2**16: shared by all blocks of the segment
    states   uint32 state of every block at each checkpoint, after the uint32 word offsets of the checkpoints
    words    16-bit renormalisation words

The ids of a segment are cut into blocks of BLOCK ids with a coder state each. Blocks are independent and coded in step:
their words are interleaved, step by step, so that numpy advances all of them at once. A checkpoint holds all states and
the word offset, so a range of steps can be decoded without what comes before it. Frames are decoded in parallel.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tallyspark.llm.common import id_and_text, partitions, raw_bytes, slices, word_array, word_bounds

MAGIC = b"RANSseg1"
HEADER = struct.Struct("<8sQQIIIIII")  # magic, ids, documents, block, steps, symbols, words, crc of ids, crc of words
BLOCK = 1024
STEPS = 256
SEGMENT_IDS = 1 << 21
SCALE = 16
LOW = np.uint64(1 << 16)
END_ID = 1
#: Distinct words that a worker keeps with their ids before it starts afresh.
CACHED_WORDS = 700_000
#: Words that one call of the tokenizer takes, joined by a special token.
JOINED_WORDS = 200


def scaled(counts: np.ndarray) -> np.ndarray:
    """Frequencies of at least 1 that sum to 2**SCALE, close to the counts (all positive, at most 2**SCALE of them)."""
    total = 1 << SCALE
    freq = np.maximum(1, counts * total // counts.sum())
    order = np.argsort(-counts, kind="stable")
    excess = int(freq.sum()) - total
    while excess > 0:  # take from the largest first
        room = freq[order] - 1
        take = np.minimum(room, np.maximum(1, freq[order] * excess // total))
        reach = np.cumsum(take)
        take = np.where(reach <= excess, take, np.maximum(0, excess - (reach - take)))
        freq[order] -= take
        excess = int(freq.sum()) - total
    freq[order[0]] -= excess
    return freq


def encode(ids: np.ndarray, docs: np.ndarray, sizes: np.ndarray) -> bytes:
    """The frame of ids, which belong to documents docs with sizes ids each."""
    n = len(ids)
    blocks = -(-n // BLOCK)
    symbols, index, counts = np.unique(ids, return_inverse=True, return_counts=True)
    freq = scaled(counts.astype(np.int64)).astype(np.uint64) if n else np.empty(0, np.uint64)
    start = np.concatenate(([0], np.cumsum(freq)[:-1])).astype(np.uint64) if n else freq
    grid = np.zeros(blocks * BLOCK, np.int64)
    grid[:n] = index
    grid = np.ascontiguousarray(grid.reshape(blocks, BLOCK).T)
    tail = n - (blocks - 1) * BLOCK
    state = np.full(blocks, LOW, np.uint64)
    chunks: list[np.ndarray] = []
    saved: list[np.ndarray] = []
    for t in range(BLOCK - 1, -1, -1):
        live = blocks if t < tail else blocks - 1
        x, s = state[:live], grid[t, :live]
        f = freq[s]
        full = x >= (f << np.uint64(16))
        chunks.append(x[full].astype(np.uint16))
        x = np.where(full, x >> np.uint64(16), x)
        q = x // f
        state[:live] = (q << np.uint64(SCALE)) + (x - q * f) + start[s]
        if t % STEPS == 0:
            saved.append(state.astype(np.uint32))
    chunks.reverse()
    saved.reverse()
    lengths = np.array([len(c) for c in chunks], np.int64)
    words = np.concatenate(chunks) if chunks else np.empty(0, np.uint16)
    offsets = np.concatenate(([0], np.cumsum(lengths)))[:BLOCK:STEPS].astype(np.uint32)
    body = words.tobytes()
    head = HEADER.pack(MAGIC, n, len(docs), BLOCK, STEPS, len(symbols), len(words), zlib.crc32(ids.astype("<u4").tobytes()), zlib.crc32(body))
    return b"".join((head, docs.astype("<i8").tobytes(), sizes.astype("<u4").tobytes(), symbols.astype("<u4").tobytes(), (freq - np.uint64(1)).astype("<u2").tobytes() if n else b"", offsets.tobytes(), *(s.tobytes() for s in saved), body))


class Frame:
    """A parsed frame; decode() gives all ids, decode_steps(k) the steps after checkpoint k of every block."""

    def __init__(self, data: bytes):
        magic, self.n, n_docs, self.block, self.steps, n_symbols, n_words, self.ids_crc, words_crc = HEADER.unpack_from(data)
        if magic != MAGIC:
            raise ValueError("not a rANS segment")
        at = HEADER.size

        def take(kind: str, count: int) -> np.ndarray:
            nonlocal at
            out = np.frombuffer(data, kind, count, at)
            at += out.nbytes
            return out

        self.docs, self.sizes = take("<i8", n_docs), take("<u4", n_docs).astype(np.int64)
        self.symbols, freq = take("<u4", n_symbols), take("<u2", n_symbols).astype(np.uint64) + np.uint64(1)
        self.blocks = -(-self.n // self.block)
        self.checkpoints = self.block // self.steps
        self.offsets = take("<u4", self.checkpoints)
        self.states = take("<u4", self.checkpoints * self.blocks).reshape(self.checkpoints, self.blocks)
        self.words = take("<u2", n_words)
        if zlib.crc32(self.words.tobytes()) != words_crc:
            raise ValueError("damaged words")
        self.freq = freq
        self.start = np.concatenate(([0], np.cumsum(freq)[:-1])).astype(np.uint64) if n_symbols else freq
        self.slot = np.repeat(np.arange(n_symbols), freq.astype(np.int64))

    def decode_steps(self, k: int) -> np.ndarray:
        """(steps, blocks) symbols from checkpoint k to the next; what lies past the last id is 0."""
        out = np.zeros((self.steps, self.blocks), np.uint32)
        state, at = self.states[k].astype(np.uint64), int(self.offsets[k])
        tail = self.n - (self.blocks - 1) * self.block
        mask = np.uint64((1 << SCALE) - 1)
        for i in range(self.steps):
            live = self.blocks if k * self.steps + i < tail else self.blocks - 1
            x = state[:live]
            low = x & mask
            s = self.slot[low.astype(np.int64)]
            out[i, :live] = self.symbols[s]
            x = self.freq[s] * (x >> np.uint64(SCALE)) + low - self.start[s]
            need = np.flatnonzero(x < LOW)
            x[need] = (x[need] << np.uint64(16)) | self.words[at : at + len(need)]
            at += len(need)
            state[:live] = x
        return out

    def decode(self) -> np.ndarray:
        if self.n == 0:
            return np.empty(0, np.uint32)
        ids = np.concatenate([self.decode_steps(k) for k in range(self.checkpoints)]).T.reshape(-1)[: self.n]
        ids = np.ascontiguousarray(ids, "<u4")
        if zlib.crc32(ids.tobytes()) != self.ids_crc:
            raise ValueError("damaged ids")
        return ids


class Remembered:
    """Ids of distinct strings, computed once by fresh() and kept until CACHED_WORDS are held."""

    def __init__(self):
        self.clear()

    def fresh(self, words: list[str]) -> list:
        raise NotImplementedError

    def clear(self) -> None:
        self.place: dict[str, int] = {}
        self.flat, self.first, self.count, self.used = np.empty(1 << 16, np.uint32), np.zeros(1 << 16, np.int64), np.zeros(1 << 16, np.int64), 0

    def renew(self, words: list[str]) -> None:
        """Start afresh with the given words, as far as they are known."""
        known = [w for w in words if w in self.place]
        at = np.fromiter((self.place[w] for w in known), np.int64, len(known))
        first, count, flat = self.first[at], self.count[at], self.flat
        self.clear()
        self.used = int(count.sum())
        ends = np.cumsum(count)
        self._room("flat", self.used)[: self.used] = flat[np.arange(self.used) + np.repeat(first - (ends - count), count)]
        self._room("first", len(known))[: len(known)] = ends - count
        self._room("count", len(known))[: len(known)] = count
        self.place = dict(zip(known, range(len(known)), strict=True))

    def _room(self, name: str, n: int) -> np.ndarray:
        old = getattr(self, name)
        if n > len(old):
            grown = np.zeros(max(n, 2 * len(old)), old.dtype)
            grown[: len(old)] = old
            setattr(self, name, grown)
        return getattr(self, name)

    def encode(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the words in order, and the number of ids of each."""
        coded = words.dictionary_encode()
        distinct = coded.dictionary.to_numpy(zero_copy_only=False).tolist()  # much faster than to_pylist
        if len(self.place) + len(distinct) > CACHED_WORDS:
            self.renew(distinct)
        at = np.fromiter(map(self.place.get, distinct, repeat(-1)), np.int64, len(distinct))
        new = np.flatnonzero(at < 0)
        if len(new):
            fresh = [distinct[i] for i in new.tolist()]
            found = self.fresh(fresh)
            sizes = np.array([len(x) for x in found], np.int64)
            base, n = len(self.place), int(sizes.sum())
            flat = self._room("flat", self.used + n)
            flat[self.used : self.used + n] = np.fromiter((i for x in found for i in x), np.uint32, n)
            self._room("first", base + len(fresh))[base : base + len(fresh)] = self.used + np.cumsum(sizes) - sizes
            self._room("count", base + len(fresh))[base : base + len(fresh)] = sizes
            self.used += n
            self.place.update(zip(fresh, range(base, base + len(fresh)), strict=True))
            at[new] = np.arange(base, base + len(fresh))
        at = at[coded.indices.to_numpy()]
        count = self.count[at]
        ends = np.cumsum(count)
        take = np.arange(int(ends[-1]) if len(ends) else 0) + np.repeat(self.first[at] - (ends - count), count)
        return self.flat[take], count


_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_ALNUM, _POINT = np.zeros(256, bool), np.zeros(256, bool)
_ALNUM[[*range(48, 58), *range(65, 91), *range(97, 123)]] = True
_POINT[[x for x in range(33, 127) if not _ALNUM[x] and x != ord("'")]] = True


class WordIds(Remembered):
    """Ids of texts by the tokenizers library, word by word.

    Exact for a tokenizer that lower-cases, drops white space and whose pre-tokens hold letters, or digits, or other
    characters (apostrophes aside): none spans white space or the step between an ASCII letter or digit and ASCII
    punctuation, so the parts between such places are encoded once and remembered. Texts that spell a special token are
    left whole between spaces.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        super().__init__()
        self.tokenizer = Tokenizer.from_file(path)
        special = self.tokenizer.get_added_tokens_decoder()
        self.special = [t.content.encode() for t in special.values()]
        self.joint = min(special) if special else None
        self.glue = special[self.joint].content if special else ""
        self.whole = False

    def fresh(self, words: list[str]) -> list:
        if self.whole or self.joint is None:
            return [e.ids for e in self.tokenizer.encode_batch_fast(words, add_special_tokens=False)]
        joined = [self.glue.join(words[i : i + JOINED_WORDS]) for i in range(0, len(words), JOINED_WORDS)]
        out: list = []
        for e in self.tokenizer.encode_batch_fast(joined, add_special_tokens=False):
            ids = np.array(e.ids, np.int64)
            cuts = np.flatnonzero(ids == self.joint).tolist()
            ids = ids.tolist()
            out += [ids[a + 1 : b] for a, b in zip([-1, *cuts], [*cuts, len(ids)], strict=True)]
        return out

    def rows(self, data: np.ndarray, offsets: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all rows in order, and the number of ids before each row (rows + 1 entries)."""
        raw = data.tobytes()
        self.whole = any(s in raw for s in self.special)
        if not self.whole and len(data):
            data = _LOWER[data]
            letter, point = _ALNUM[data], _POINT[data]
            turn = np.flatnonzero((letter[:-1] & point[1:]) | (point[:-1] & letter[1:])) + 1
            edge = np.zeros(len(data) + 1, bool)
            edge[offsets] = True
            turn = turn[~edge[turn]]
            starts, ends = np.sort(np.concatenate((starts, turn))), np.sort(np.concatenate((ends, turn)))
        ids, count = self.encode(word_array(data, starts, ends))
        return ids, np.concatenate(([0], np.cumsum(count)))[np.searchsorted(starts, offsets)]


_workers: dict[str, WordIds] = {}


def word_ids(path: str) -> WordIds:
    """The worker's own tokenizer, loaded once."""
    if path not in _workers:
        _workers[path] = WordIds(path)
    return _workers[path]


def document_ids(part: pa.RecordBatch, tokenizer: WordIds) -> tuple[np.ndarray, np.ndarray]:
    """The ids of all rows' texts, each followed by END_ID, and the number of ids of each row."""
    data, offsets = raw_bytes(part.column("text"))
    starts, ends, _ = word_bounds(data, offsets)
    ids, total = tokenizer.rows(data, offsets, starts, ends)
    sizes = np.diff(total) + 1
    out = np.full(int(sizes.sum()), END_ID, np.uint32)
    body = np.ones(len(out), bool)
    body[np.cumsum(sizes) - 1] = False
    out[body] = ids
    return out, sizes


SEGMENTS = "part long, seq long, part_start long, n_ids long, frame binary"


def encode_partition(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer, part_no = word_ids(path), TaskContext.get().partitionId()
        held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        waiting = seq = done = 0

        def flush() -> pa.RecordBatch:
            nonlocal held, waiting, seq, done
            docs, ids, sizes = (np.concatenate(x) for x in zip(*held, strict=True))
            frame = encode(ids, docs, sizes)
            row = [[part_no], [seq], [done], [len(ids)], [frame]]
            held, waiting, seq, done = [], 0, seq + 1, done + len(ids)
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(row, (pa.int64(),) * 4 + (pa.binary(),), strict=True)], names=["part", "seq", "part_start", "n_ids", "frame"])

        for batch in batches:
            for part in slices(batch):
                ids, sizes = document_ids(part, tokenizer)
                held.append((part.column("doc_id").to_numpy(), ids, sizes))
                waiting += len(ids)
                if waiting >= SEGMENT_IDS:
                    yield flush()
        if held:
            yield flush()

    return run


def write_tokens(docs: DataFrame, path: str, tokenizer_path: str) -> None:
    """Write the ids of docs to path: one file a range of doc_id, in ascending order within and across files.

    Null text is empty and gives the end id alone. Rows that repeat a doc_id are ordered by text. An empty table gives
    files without segments. Other columns are not read.
    """
    ordered = id_and_text(docs).repartitionByRange(partitions(docs.sparkSession), "doc_id").sortWithinPartitions("doc_id", "text")
    ordered.mapInArrow(encode_partition(tokenizer_path), SEGMENTS).write.option("compression", "none").parquet(path)


def _decode(with_ids: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, start, data in zip(*(batch.column(k).to_pylist() for k in ("part", "part_start", "frame")), strict=True):
                frame = Frame(data)
                ids = frame.decode()
                ends = np.cumsum(frame.sizes)
                rows = [ids[a:b] for a, b in zip((ends - frame.sizes).tolist(), ends.tolist(), strict=True)]
                columns = [
                    pa.array(np.full(len(rows), part, np.int64)), pa.array(frame.docs), pa.array(start + ends - frame.sizes), pa.array(frame.sizes),
                    pa.array([zlib.crc32(r.tobytes()) for r in rows], pa.int64()), pa.array([r.astype(np.int32) if with_ids else None for r in rows], pa.list_(pa.int32())),
                ]
                yield pa.RecordBatch.from_arrays(columns, names=["part", "doc_id", "part_at", "n_tokens", "ids_crc32", "ids"])

    return run


def read_tokens(spark: SparkSession, path: str, ids: bool = False) -> DataFrame:
    """The documents of the files: doc_id, start (ids of all documents before it), n_tokens, ids_crc32, and with ids the ids."""
    segments = spark.read.schema(SEGMENTS).parquet(path)
    # One row a file: where each file starts.
    totals = segments.groupBy("part").agg(F.sum("n_ids").alias("n"))
    before = totals.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("before"))
    rows = segments.select("part", "part_start", "frame").mapInArrow(_decode(ids), "part long, doc_id long, part_at long, n_tokens long, ids_crc32 long, ids array<int>")
    out = rows.join(before, "part").select("doc_id", (F.col("before") + F.col("part_at")).alias("start"), "n_tokens", "ids_crc32", "ids")
    return out if ids else out.drop("ids")
