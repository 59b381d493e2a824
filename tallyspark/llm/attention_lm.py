"""Log-probabilities of texts: a causal self-attention model over subword ids, beside a smoothed word unigram base.

The model predicts the next subword from the last CONTEXT to CONTEXT + QUERIES - 1 subwords by one causal attention head.
What a subword offers as its value is a distribution over classes of subwords: how often each class comes next, next but
one, or a little later, by counts. The head weighs these distributions, and that of all text, by a bilinear form of the
embeddings of the last subword and the key, a bias of the key and a bias of the distance; p(id | past) is the weighted
mean times the smoothed share of the subword within its class.

Subword counts, classes, embeddings (the main directions of the counts), distributions and weights come from all training
documents, whole: each text is tokenized once and its ids are staged; counts are vectors summed over the partitions; the
weights are fitted in ROUNDS rounds, in each of which every partition takes its gradient steps over its own share of the
windows and the results are averaged by windows. After the last round every window of the corpus has been used. Texts are
scored in windows of STRIDE positions that see CONTEXT positions before them, so windows overlap and every token is scored
once, in masked batches.

Word counts of the base are exact. The most frequent words (at most HEAVY_WORDS) are broadcast; the rest of each
document's words meet their counts in a join.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from copy import copy

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyspark.llm.common import raw_bytes, signed, slices, staged, word_bounds, word_hashes
from tallyspark.llm.rans import document_ids, word_ids

CONTEXT = 16
STRIDE = 32
#: Queries that attend together; a window is cut into such blocks, so that fewer keys lie after a query.
QUERIES = 16
WIDTH = 16
#: Subwords with an embedding of their own (the most frequent), and classes: single subwords, then clusters.
EMBEDDED = 4096
SINGLES, CLUSTERS = 960, 64
CLASSES = SINGLES + CLUSTERS
#: The most frequent subwords, by which the others are told apart when they are clustered.
PROFILE = 64
#: Distances that count as next, next but one, and later.
LATER = (2, 3, 4, 5)
TABLES = 3
#: How many observations the share in all text counts for in a distribution.
PRIOR = 4.0
#: What is added to the count of every subword.
RARE = 0.1
#: Bounds of exponents and of weights.
MOST = np.float32(60)
REACH = 8.0
ROUNDS = 8
#: A corpus with fewer training windows than this is gone through several times.
LEAST_WINDOWS = 40_000
BATCH_WINDOWS = 128
#: Blocks whose weights and values are at hand at once (they stay in a core's cache), and windows whose places are looked up at once.
PASS_BLOCKS, PLACED_WINDOWS = 256, 4096
HEAVY_WORDS = 1 << 18
#: Bytes of text that one pass counts; a larger pass sends fewer partial counts.
COUNT_BYTES = 4 << 20
#: Entries of a vector that travel in one row, and the fixed point of averaged weights (sums then do not depend on order).
CHUNK = 4096
PACKED = "chunk int, at binary, v binary"
FIXED = float(1 << 48)
BEGIN_ID, END_ID = 49406, 49407
VOCABULARY = 49408
_WORD, _TEXTS = 0, 1


def held_out() -> F.Column:
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 10 == 0, F.lit(False))


def _tokenized(path: str):
    """Subword ids of every text and its end, two bytes each, beside the row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = word_ids(path)
        for batch in batches:
            for part in slices(batch):
                ids, sizes = document_ids(part, tokenizer)
                ids[np.cumsum(sizes) - 1] = END_ID
                offsets = np.concatenate(([0], np.cumsum(sizes * 2))).astype(np.int32)
                packed = pa.Array.from_buffers(pa.binary(), len(sizes), [None, pa.py_buffer(offsets), pa.py_buffer(ids.astype(np.uint16))])
                yield pa.RecordBatch.from_arrays([part.column("row"), part.column("doc_id"), part.column("text"), packed], names=["row", "doc_id", "text", "ids"])

    return run


def sequences(part: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    """The staged ids of all rows (each with its end), and the number of ids of each row."""
    data, offsets = raw_bytes(part.column("ids"))
    return np.frombuffer(data.tobytes(), np.uint16).astype(np.int64), np.diff(offsets) // 2


def _chunks(vector: np.ndarray) -> Iterator[pa.RecordBatch]:
    """The chunks of a vector that are not all zero, packed."""
    cuts = ((i // CHUNK, vector[i : i + CHUNK]) for i in range(0, len(vector), CHUNK))
    yield _packed({i: x for i, x in cuts if x.any()})


def _packed(chunks: dict[int, np.ndarray]) -> pa.RecordBatch:
    """Where the entries that are not 0 stand (two bytes each), and these in as few bytes each as the largest needs."""
    places = [np.flatnonzero(x) for x in chunks.values()]
    entries = [x[at] for x, at in zip(chunks.values(), places, strict=True)]
    kinds = [np.min_scalar_type(min(x.min(initial=0), -1 - x.max(initial=0))) for x in entries]
    columns = [pa.array([at.astype(np.uint16).tobytes() for at in places], pa.binary()), pa.array([x.astype(k).tobytes() for x, k in zip(entries, kinds, strict=True)], pa.binary())]
    return pa.RecordBatch.from_arrays([pa.array(list(chunks), pa.int32()), *columns], names=["chunk", "at", "v"])


def _unpacked(batch: pa.RecordBatch) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    for chunk, at, v in zip(*(batch.column(name).to_pylist() for name in ("chunk", "at", "v")), strict=True):
        yield chunk, np.frombuffer(at, np.uint16), np.frombuffer(v, f"i{len(v) * 2 // max(len(at), 1) or 1}")


def _added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total: dict[int, np.ndarray] = {}
    for batch in batches:
        for chunk, at, x in _unpacked(batch):
            if chunk not in total:
                total[chunk] = np.zeros(CHUNK, np.int64)
            total[chunk][at] += x
    if total:
        yield _packed(total)


def vector_sum(rows: DataFrame, of: Callable, size: int) -> np.ndarray:
    """The sum over all partitions of the integer vector that of() makes of a partition's rows; only the sum reaches the driver."""
    made = rows.mapInArrow(of, PACKED).repartition("chunk").mapInArrow(_added, PACKED)
    out = np.zeros(size, np.int64)
    for batch in made.toArrow().to_batches():
        for chunk, at, x in _unpacked(batch):
            out[chunk * CHUNK + at.astype(np.int64)] = x
    return out


def _subwords(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    n = np.zeros(VOCABULARY + 1, np.int64)
    for batch in batches:
        for part in slices(batch, "ids"):
            ids, sizes = sequences(part)
            n[:VOCABULARY] += np.bincount(ids, minlength=VOCABULARY)
            n[VOCABULARY] += (-(-sizes // STRIDE)).sum()
    yield from _chunks(n)


def subword_counts(tokens: DataFrame) -> tuple[np.ndarray, int]:
    """How often every subword id (ends included) stands in the rows of tokens, and the number of their windows."""
    n = vector_sum(tokens.select("ids"), _subwords, VOCABULARY + 1)
    return n[:VOCABULARY], int(n[VOCABULARY])


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    texts = 0
    rows = lambda kind, key, n: pa.RecordBatch.from_arrays([pa.array(np.full(len(key), kind, np.int32)), pa.array(key), pa.array(n.astype(np.int64))], names=["kind", "key", "n"])
    for batch in batches:
        for part in slices(batch, limit=COUNT_BYTES):
            data, offsets = raw_bytes(part.column("text"))
            starts, ends, _ = word_bounds(data, offsets)
            texts += part.num_rows
            key, n = np.unique(word_hashes(data, starts, ends, lower=True), return_counts=True)
            yield rows(_WORD, signed(key), n)
    yield rows(_TEXTS, np.zeros(1, np.int64), np.array([texts]))


def _order(n: np.ndarray) -> np.ndarray:
    return np.argsort(-n, kind="stable")


def _preceded(n: np.ndarray):
    """Counts of (clustered subword, frequent subword before it or none of them); the first of a text comes after an end."""
    order = _order(n)
    before = np.full(VOCABULARY, PROFILE, np.int64)
    before[order[:PROFILE]] = np.arange(PROFILE)
    place = np.full(VOCABULARY, -1, np.int64)
    place[order[SINGLES:EMBEDDED]] = np.arange(EMBEDDED - SINGLES)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((EMBEDDED - SINGLES) * (PROFILE + 1), np.int64)
        for batch in batches:
            for part in slices(batch, "ids"):
                ids, sizes = sequences(part)
                past = np.empty(len(ids), np.int64)
                past[1:] = ids[:-1]
                past[np.cumsum(sizes) - sizes] = END_ID
                at = place[ids]
                ok = at >= 0
                total += np.bincount(at[ok] * (PROFILE + 1) + before[past[ok]], minlength=len(total))
        yield from _chunks(total)

    return run


def _classes(n: np.ndarray, preceded: np.ndarray) -> np.ndarray:
    """Class of every id: the SINGLES most frequent stand alone, others are clustered by what precedes them in the corpus."""
    order = _order(n)
    out = np.full(VOCABULARY, SINGLES, np.int64)
    out[order[:SINGLES]] = np.arange(SINGLES)
    members = order[SINGLES:EMBEDDED]
    profile = preceded.reshape(len(members), -1).astype(float)
    profile = np.sqrt(profile / np.maximum(profile.sum(axis=1, keepdims=True), 1))
    centres = profile[:CLUSTERS].copy()
    for _ in range(8):
        nearest = (profile @ centres.T).argmax(axis=1)
        for c in range(CLUSTERS):
            if (nearest == c).any():
                centres[c] = profile[nearest == c].mean(axis=0)
                centres[c] /= max(np.linalg.norm(centres[c]), 1e-9)
    out[members] = SINGLES + nearest
    return out


def _rows(n: np.ndarray) -> np.ndarray:
    """Embedding row of every id: the most frequent have their own, all others share row 0."""
    out = np.zeros(VOCABULARY, np.int64)
    out[_order(n)[: EMBEDDED - 2]] = np.arange(1, EMBEDDED - 1)
    out[BEGIN_ID] = EMBEDDED - 1
    return out


def inputs(rows: np.ndarray, ids: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Embedding rows of what precedes every id; a sequence begins with the begin mark."""
    past = np.empty(len(ids), np.int64)
    past[1:] = rows[ids[:-1]]
    past[np.cumsum(sizes) - sizes] = EMBEDDED - 1
    return past


def _followed(rows: np.ndarray, classes: np.ndarray):
    """Counts of (how much later, embedding row, class): TABLES * EMBEDDED * CLASSES of them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((TABLES, EMBEDDED * CLASSES), np.int32)
        for batch in batches:
            for part in slices(batch, "ids"):
                ids, sizes = sequences(part)
                cell, target = inputs(rows, ids, sizes) * CLASSES, classes[ids]
                left = np.arange(len(ids)) - np.repeat(np.cumsum(sizes) - sizes, sizes)  # ids of the same text before
                for table, distances in enumerate((*((d,) for d in range(TABLES - 1)), LATER)):
                    met = [(cell[: max(len(cell) - d, 0)] + target[d:])[left[d:] >= d] for d in distances]
                    total[table] += np.bincount(np.concatenate(met), minlength=EMBEDDED * CLASSES)
        yield from _chunks(total.ravel())

    return run


def windows(sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First query position and sequence of every window over concatenated sequences."""
    per = -(-sizes // STRIDE)
    row = np.repeat(np.arange(len(sizes)), per)
    nth = np.arange(len(row)) - np.repeat(np.cumsum(per) - per, per)
    return (np.cumsum(sizes) - sizes)[row] + nth * STRIDE, row


class Model:
    """Distributions, embeddings and head; score() gives the natural log-probability of every id of concatenated sequences."""

    def __init__(self, n: np.ndarray, preceded: np.ndarray):
        self.classes, self.row = _classes(n, preceded), _rows(n)
        weight = n + RARE
        share = np.bincount(self.classes, weights=weight, minlength=CLASSES)
        self.within = np.log(weight / np.maximum(share, 1e-12)[self.classes]).astype(np.float32)
        self.share = share / share.sum()
        # All text is a key of its own, whose distance comes after all others.
        query, key = np.arange(QUERIES)[:, None] + CONTEXT, np.arange(CONTEXT + QUERIES)[None, :]
        self.gap = np.clip(query - key, 0, None)
        self.causal = np.where(key <= query, 0, -1e9).astype(np.float32)
        self.p = {"bilinear": np.zeros((WIDTH, WIDTH), np.float32), "key": np.zeros(EMBEDDED + 1, np.float32), "near": -np.log1p(np.arange(CONTEXT + QUERIES + 1)).astype(np.float32)}
        self.m, self.w = ({k: np.zeros_like(v) for k, v in self.p.items()} for _ in range(2))
        self.steps = 0.0
        self.learn(np.empty(0, np.int64), np.empty(0, np.int64))

    def learn(self, cells: np.ndarray, counts: np.ndarray) -> None:
        """Take the counts (all that are not 0) of classes after each embedding row: distributions and embeddings."""
        self.cells, self.counts = cells.astype(np.int32), counts.astype(np.int32 if counts.max(initial=0) < 2**31 else np.int64)
        self._spread()
        profile = np.sqrt(np.ascontiguousarray(self.offered[0].reshape(CLASSES, -1).T)) - np.sqrt(self.share)
        main = np.linalg.eigh(profile.T @ profile)[1][:, -WIDTH:]
        spread = profile @ main
        self.embedding = (spread / np.maximum(spread.std(axis=0), 1e-9)).clip(-4, 4).astype(np.float32)

    def _spread(self) -> None:
        """The distributions from the counts, by table, class and row, so that keys of one query lie near each other; the last row is all text."""
        offered = np.zeros((TABLES, CLASSES, EMBEDDED + 1), np.float32)
        row, target = np.divmod(self.cells, CLASSES)
        table, row = np.divmod(row, EMBEDDED)
        offered[table, target, row] = self.counts
        total = offered.sum(axis=1, keepdims=True) + np.float32(PRIOR)
        offered += (PRIOR * self.share).astype(np.float32)[:, None]
        offered /= total
        offered[:, :, EMBEDDED] = self.share
        self.offered = offered.reshape(TABLES, -1)

    @property
    def value(self) -> np.ndarray:
        """The distributions by table, row and class."""
        return self.offered.reshape(TABLES, CLASSES, -1).transpose(0, 2, 1).ravel()

    def __getstate__(self) -> dict:
        """Counts travel, distributions are made of them where they are used."""
        return {k: v for k, v in self.__dict__.items() if k != "offered"}

    def __setstate__(self, state: dict) -> None:
        self.__dict__.update(state)
        self._spread()

    def state(self) -> np.ndarray:
        """Weights, moments and the number of steps as one vector."""
        return np.concatenate([x.ravel() for d in (self.p, self.m, self.w) for x in d.values()] + [np.array([self.steps])]).astype(float)

    def restored(self, state: np.ndarray) -> Model:
        """A copy with the weights, moments and steps of a state."""
        out, at = copy(self), 0
        out.p, out.m, out.w = {}, {}, {}
        for d in (out.p, out.m, out.w):
            for name, x in self.p.items():
                d[name] = state[at : at + x.size].reshape(x.shape).astype(np.float32)
                at += x.size
        out.steps = float(state[at])
        return out

    def placed(self, ids: np.ndarray, begin: np.ndarray, first: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, ...]:
        """Of windows' blocks: key rows, classes of the queries, which queries exist and their places in ids."""
        begin = begin[:, None] + np.arange(0, STRIDE, QUERIES)
        window, block = np.nonzero(begin < last[:, None])
        at = begin[window, block][:, None] + np.arange(-CONTEXT, QUERIES)
        first, last = first[window][:, None], last[window][:, None]
        inside = (at >= first) & (at < last)
        x = self.row[ids[np.where(inside, at - 1, 0)]]
        x[at == first] = EMBEDDED - 1  # a sequence begins with the begin mark
        x[~inside] = EMBEDDED  # what does not exist offers what all text does
        at, exists = at[:, CONTEXT:], inside[:, CONTEXT:]
        return x.astype(np.int32), self.classes[ids[np.where(exists, at, 0)]].astype(np.int32), exists, at

    def asked(self) -> tuple[np.ndarray, np.ndarray]:
        """What every embedding row asks of a key, with a one for the key's bias; every row as a key, with its bias."""
        ask = np.column_stack((self.embedding @ self.p["bilinear"], np.ones(EMBEDDED + 1, np.float32)))
        return ask, np.column_stack((self.embedding, self.p["key"]))

    def attended(self, x: np.ndarray, target: np.ndarray, asked: tuple[np.ndarray, np.ndarray]):
        """Of blocks: vectors of the keys, weights of the keys and of all text for every query, and their values at the target."""
        keys, ask = asked[1].take(x, axis=0), asked[0].take(x[:, CONTEXT:], axis=0)
        weight = ask @ keys.transpose(0, 2, 1)
        weight += self.p["near"][self.gap] + self.causal
        if weight.max(initial=0) > MOST:
            np.minimum(weight, MOST, out=weight)
        np.exp(weight, out=weight)
        whole = np.exp(np.minimum((ask.reshape(-1, WIDTH + 1) @ asked[1][EMBEDDED]).reshape(target.shape) + self.p["near"][-1], MOST))
        # Most keys are far enough for the last table; the nearest, on diagonals, are put in after.
        cell = target * np.int32(EMBEDDED + 1)
        value = _taken(self.offered[-1], x[:, None, :] + cell[:, :, None])
        flat = value.reshape(len(x), -1)
        for gap in range(TABLES - 1):
            flat[:, CONTEXT - gap :: CONTEXT + QUERIES + 1] = _taken(self.offered[gap], x[:, CONTEXT - gap : CONTEXT - gap + QUERIES] + cell)
        return keys, weight, whole, value, self.share.astype(np.float32).take(target)

    def gradients(self, x: np.ndarray, target: np.ndarray, share: np.ndarray, asked: tuple[np.ndarray, np.ndarray]) -> dict[str, np.ndarray]:
        """Of the sum over the queries of share * -log(sum(weight * value) / sum(weight)), by the parameters of the exponents."""
        keys, weight, whole, value, offer = self.attended(x, target, asked)
        top, bottom = share / (np.vecdot(weight, value) + whole * offer), share / (_summed(weight) + whole)
        value *= -top[:, :, None]
        value += bottom[:, :, None]
        value *= weight
        whole *= bottom - offer * top
        ask = self.embedding.take(x[:, CONTEXT:].ravel(), axis=0).T
        bilinear = (ask @ (value @ keys).reshape(-1, WIDTH + 1))[:, :WIDTH] + np.outer(ask @ whole.ravel(), self.embedding[EMBEDDED])
        key = np.bincount(x.ravel(), weights=(np.ones(QUERIES, np.float32) @ value).ravel(), minlength=EMBEDDED + 1)
        near = np.bincount(self.gap.ravel(), weights=value.sum(axis=0).ravel(), minlength=CONTEXT + QUERIES + 1)
        key[EMBEDDED] += whole.sum()
        near[-1] += whole.sum()
        return {"bilinear": bilinear, "key": key, "near": near}

    def train(self, ids: np.ndarray, sizes: np.ndarray, chosen: np.ndarray, rate: float) -> None:
        """Gradient steps over the chosen windows, BATCH_WINDOWS at most in each."""
        begin, row = windows(sizes)
        low = np.cumsum(sizes) - sizes
        for pick in np.array_split(chosen, -(-len(chosen) // BATCH_WINDOWS)) if len(chosen) else []:
            x, target, exists, _ = self.placed(ids, begin[pick], low[row[pick]], (low + sizes)[row[pick]])
            share, asked = exists / np.float32(max(exists.sum(), 1)), self.asked()
            parts = [self.gradients(x[i : i + PASS_BLOCKS], target[i : i + PASS_BLOCKS], share[i : i + PASS_BLOCKS], asked) for i in range(0, len(x), PASS_BLOCKS)]
            self.steps += 1
            for name in self.p:
                g, m, w = sum(part[name] for part in parts), self.m[name], self.w[name]
                m += 0.1 * (g - m)
                w += 0.01 * (g * g - w)
                step = rate * (m / (1 - 0.9**self.steps)) / (np.sqrt(w / (1 - 0.99**self.steps)) + 1e-8)
                self.p[name] = np.clip(self.p[name] - step, -REACH, REACH).astype(np.float32)

    def score(self, ids: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        begin, row = windows(sizes)
        low = np.cumsum(sizes) - sizes
        first, last, asked = low[row], (low + sizes)[row], self.asked()
        out = np.ones(len(ids), np.float32)
        for i in range(0, len(begin), PLACED_WINDOWS):
            some = slice(i, i + PLACED_WINDOWS)
            x, target, exists, at = self.placed(ids, begin[some], first[some], last[some])
            mean = np.empty(target.shape, np.float32)
            for j in range(0, len(x), PASS_BLOCKS):
                _, weight, whole, value, offer = self.attended(x[j : j + PASS_BLOCKS], target[j : j + PASS_BLOCKS], asked)
                mean[j : j + PASS_BLOCKS] = (np.vecdot(weight, value) + whole * offer) / (_summed(weight) + whole)
            out[at[exists]] = mean[exists]
        return np.log(out) + self.within[ids]


def _summed(weight: np.ndarray) -> np.ndarray:
    """Sums over the keys."""
    return (weight.reshape(-1, weight.shape[2]) @ np.ones(weight.shape[2], np.float32)).reshape(weight.shape[:2])


def _taken(table: np.ndarray, at: np.ndarray) -> np.ndarray:
    """A new array of the table's entries at int32 places; Arrow's kernel takes them without a wider copy of the places."""
    made = pc.take(pa.Array.from_buffers(pa.float32(), len(table), [None, pa.py_buffer(table)]), pa.Array.from_buffers(pa.int32(), at.size, [None, pa.py_buffer(at)]), boundscheck=False)
    return np.frombuffer(made.buffers()[1], np.float32, at.size).reshape(at.shape)


def _trained(model, state: np.ndarray, turn: int, repeats: int, total: int):
    """What a partition makes of the model in one round, times its share of all windows; the share itself is the last entry."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model.value.restored(state)
        rng = np.random.default_rng((5, turn, TaskContext.get().partitionId()))
        rate = 0.01 * min(1.0, 4 * (1 - turn / ROUNDS))
        seen = used = 0
        for batch in batches:
            for part in slices(batch, "ids"):
                ids, sizes = sequences(part)
                n = int((-(-sizes // STRIDE)).sum())
                mine = np.arange((turn - seen) % ROUNDS, n, ROUNDS)
                seen, used = seen + n, used + len(mine)
                m.train(ids, sizes, np.concatenate([rng.permutation(mine) for _ in range(repeats)]), rate)
        if used:
            share = used / total
            yield from _chunks(np.rint(np.append(m.state(), 1.0) * share * FIXED).astype(np.int64))

    return run


def fitted(tokens: DataFrame):
    """The model of the rows of tokens, all of them: a broadcast of what was counted, and the weights as a state of it."""
    n, total = subword_counts(tokens)
    rows, size = tokens.select("ids"), (EMBEDDED - SINGLES) * (PROFILE + 1)
    model = Model(n.astype(float), vector_sum(rows, _preceded(n), size) if total else np.zeros(size, np.int64))
    if total:
        followed = vector_sum(rows, _followed(model.row, model.classes), TABLES * EMBEDDED * CLASSES)
        cells = np.flatnonzero(followed)
        model.learn(cells, followed[cells])
    sent, state = tokens.sparkSession.sparkContext.broadcast(model), model.state()  # at most TABLES * EMBEDDED * CLASSES counts
    for turn in range(ROUNDS if total else 0):
        new = vector_sum(rows, _trained(sent, state, turn, -(-LEAST_WINDOWS // total), total), len(state) + 1)
        if new[-1]:
            state = new[:-1] / new[-1]
    return sent, state


def _finder(keys: np.ndarray) -> Callable:
    """Looks hashes up in sorted, distinct keys: the place of each, and whether it is there (place 0 where not)."""
    bits = len(keys).bit_length() + 2
    begin = np.searchsorted(keys, np.arange(1 << bits, dtype=np.uint64) << np.uint64(64 - bits))
    ended = np.append(keys, np.uint64(2**64 - 1))

    def find(words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at = begin[(words >> np.uint64(64 - bits)).astype(np.int64)]
        less = np.flatnonzero(ended[at] < words)
        while len(less):  # few: hashes are spread evenly
            at[less] += 1
            less = less[ended[at[less]] < words[less]]
        known = (ended[at] == words) & (at < len(keys))
        return np.where(known, at, 0), known

    return find


def _scored(model, state: np.ndarray, heavy):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m, (keys, counts) = model.value.restored(state), heavy.value
        logs, find = np.log10(counts + 0.1), _finder(keys)
        for batch in batches:
            for part in slices(batch):
                data, offsets = raw_bytes(part.column("text"))
                starts, ends, before = word_bounds(data, offsets)
                words = word_hashes(data, starts, ends, lower=True)
                ids, sizes = sequences(part)
                at, known = find(words)
                total = lambda x: np.diff(np.concatenate(([0], np.cumsum(x)))[before])
                tail = words[~known]
                cuts = np.concatenate(([0], np.cumsum(~known)))[before].astype(np.int32)
                score = m.score(ids, sizes).astype(np.float64)
                per_text = np.add.reduceat(score, np.cumsum(sizes) - sizes) if len(sizes) else np.empty(0)
                yield pa.RecordBatch.from_arrays(
                    [part.column("row"), part.column("doc_id"), pa.array(np.diff(before) + 1), pa.array(total(known)), pa.array(total(np.where(known, logs[at], 0.0) if len(keys) else np.zeros(len(words)))),
                     pa.array(per_text / np.log(10)), pa.ListArray.from_arrays(pa.array(cuts), pa.array(signed(tail)))],
                    names=["row", "doc_id", "n_tokens", "n_heavy", "heavy_logs", "score", "tail"],
                )

    return run


def score_texts(docs: DataFrame, tokenizer_path: str) -> DataFrame:
    """One row per document: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score.

    Null text is empty: its one token is its end. Without training documents all counts are 0, the base is
    log10(0.1 / 0.1) = 0 a token, and the untrained model scores. Rows are told apart by a number, so repeated doc_ids do no
    harm; a row without a doc_id is not held out. An empty table gives an empty result; other columns are not read.
    """
    spark = docs.sparkSession
    source = docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    counted = source.filter(~held_out()).mapInArrow(_counted, "kind int, key long, n long")
    counts = staged(counted.groupBy("kind", "key").agg(F.sum("n").alias("n")), "counts")
    words = counts.filter(F.col("kind") == _WORD)
    n_words, kinds = words.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count(F.lit(1))).first()
    texts = counts.filter(F.col("kind") == _TEXTS).agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    train_tokens, distinct = n_words + texts, kinds + (texts > 0)
    norm = float(np.log10(train_tokens + 0.1 * (distinct + 1)))
    tokens = staged(source.mapInArrow(_tokenized(tokenizer_path), "row long, doc_id long, text string, ids binary"), "subwords")
    model, state = fitted(tokens.filter(~held_out()))
    # The most frequent words, by a histogram of quarter powers of two.
    level = F.floor(F.log2("n") * 4)
    room, floor = HEAVY_WORDS, None
    for r in sorted(words.groupBy(level.alias("level")).count().collect(), reverse=True):
        if r["count"] > room:
            break
        room, floor = room - r["count"], r["level"]
    top = words.filter(level >= floor if floor is not None else F.lit(False)).select("key", "n").toArrow()  # at most HEAVY_WORDS rows
    keys, amounts = top["key"].to_numpy().astype(np.int64).view(np.uint64), top["n"].to_numpy().astype(np.float64)
    order = np.argsort(keys)
    heavy = spark.sparkContext.broadcast((keys[order], amounts[order]))
    scored = staged(
        tokens.mapInArrow(_scored(model, state, heavy), "row long, doc_id long, n_tokens long, n_heavy long, heavy_logs double, score double, tail array<long>"), "scored"
    )
    tail = scored.select("row", F.explode("tail").alias("key"))
    rare = words.filter(level < floor) if floor is not None else words
    met = tail.join(rare.select("key", "n"), "key", "left")
    by_row = met.groupBy("row").agg(
        F.count("n").alias("n_rare"),
        F.sum(F.log10(F.coalesce("n", F.lit(0)) + 0.1)).alias("rare_logs"),
    )
    end = (1, float(np.log10(texts + 0.1))) if texts else (0, -1.0)
    return scored.drop("tail").join(by_row, "row", "left").select(
        "doc_id", held_out().alias("held_out"), "n_tokens",
        (F.col("n_heavy") + F.coalesce("n_rare", F.lit(0)) + end[0]).alias("n_known"),
        F.lit(train_tokens).cast("long").alias("train_tokens"),
        (F.col("heavy_logs") + F.coalesce("rare_logs", F.lit(0.0)) + end[1] - F.col("n_tokens") * norm).alias("base_score"),
        "score",
    )
