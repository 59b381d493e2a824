"""Jaccard self-join of documents over an R-tree of count vectors.

A document's distinct shingles are hashed into groups; the number in each group makes it a point. Two sets share at most
the sum over the groups of the smaller count, and a node of the tree, which keeps the largest count of each group and the
range of sizes below it, bounds so what any of its points can share with a point or with another node. Pairs that no
bound excludes are verified on the full sets.

Points of unrelated documents of one size lie close together (every group holds its share of either), so a single tree
over a corpus would compare all documents of a size. The corpus is therefore first cut into families, such that linked
documents have a family in common:

* A link at 80 % changes at most a ninth of |x| + |y| shingles. Sets of one size level are cut into groups by hash, and a
  change spoils one group. A document with more than |x| / 4 groups that are not empty keeps at least one of them
  whole, and by the prefix filter one of its |x| / 4 + 1 smallest by content. These contents are its keys. Two documents
  that both have too few groups (by chance) meet by the prefix filter over single shingles. So linked documents share a key.
* The smallest document of a text slice with some key is the key's hub there, and the smallest of these its hub in the
  corpus. A family is what has one hub, or hubs in slices that have one hub in the corpus: all documents with a key
  in common have the key's family in common. A key takes one entry a slice, and stars, not pairs, tie its documents.

A document is first compared within the family of its smallest hub, whose hub is in each of its blocks, and then
representatives of what that links. Families that are still in more than one component are joined by their points alone:
members in an order that keeps near points together, cut into blocks, the upper nodes; a task holds one block, or two
whose bounds allow a link, with 16 points a leaf. Only members that have a partner in another component left there
take their texts along and are verified. Pairs already in one component are skipped, so copies cost one comparison each;
only links that join components are written.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyspark.llm.common import HASH_BASE, every_row, mix, partitions, range_chunks, shingle_sets, signed, slices, staged
from tallyspark.llm.graph import components

#: Links need 100 * intersection >= 80 * union.
PERCENT = 80
#: Text that one pass takes.
PASS_BYTES = 2 << 20
#: Coordinates of the upper nodes (in SQL), and of the nodes of a task at least.
COARSE = 16
NODE = 64
LEAF = 16
#: A block holds sets of so many shingles in all; a set counts as BLOCK_WEIGHT / BLOCK_MEMBERS shingles at least.
BLOCK_WEIGHT = 400_000
BLOCK_MEMBERS = 500
#: A task's block of points holds sets of so many shingles in all; a set counts as POINTS_WEIGHT / POINTS at least.
POINTS_WEIGHT = 2_000_000
POINTS = 4096
#: Up to so many rows (of six numbers) go to the texts by broadcast; more meet them in a shuffle.
BROADCAST_ROWS = 200_000

#: Size levels: a level's largest set is 1.6 times its smallest, so a link reaches one level up at most.
BOUNDS = [1, 2, 3, 4]
while BOUNDS[-1] < 1 << 40:
    BOUNDS.append(BOUNDS[-1] * 8 // 5)
BOUNDS = np.array(BOUNDS, np.int64)
#: Groups of a level: 3.2 shingles of its largest sets each.
LEVEL_GROUPS = np.append(-(-BOUNDS[1:] * 5 // 16), 1)
_BASE = np.uint64(HASH_BASE)

SCANNED = "kind int, doc_id long, key long, n long, sid long, other long, near long, coarse array<int>, fine binary, bucket int, keys binary, at binary, table binary"
SCANNED_TYPES = {"kind": pa.int32(), "doc_id": pa.int64(), "key": pa.int64(), "n": pa.int64(), "sid": pa.int64(), "other": pa.int64(), "near": pa.int64(), "coarse": pa.list_(pa.int32()), "fine": pa.binary(), "bucket": pa.int32(), "keys": pa.binary(), "at": pa.binary(), "table": pa.binary()}
DOCUMENT, CELLS, EDGE = 0, 1, 2
EDGES = "a long, b long"


def _rows(count: int, **columns) -> pa.RecordBatch:
    arrays = [pa.array(columns[k], t) if k in columns else pa.nulls(count, t) for k, t in SCANNED_TYPES.items()]
    return pa.RecordBatch.from_arrays(arrays, names=list(SCANNED_TYPES))


def _edges(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct pairs of different ids."""
    differ = a != b
    pairs = np.unique(np.stack([a[differ], b[differ]], axis=1), axis=0) if differ.any() else np.empty((0, 2), np.int64)
    return pairs[:, 0], pairs[:, 1]


def set_ids(sets: list[np.ndarray]) -> np.ndarray:
    """A 64-bit id for every set, by its content alone; 0 for an empty one."""
    sizes = np.array([len(s) for s in sets], np.int64)
    out = np.zeros(len(sets), np.uint64)
    full = np.flatnonzero(sizes)
    if len(full):
        flat = np.concatenate([sets[i] for i in full])
        firsts = np.cumsum(sizes[full]) - sizes[full]
        sums = np.add.reduceat(mix(flat), firsts)
        xors = np.bitwise_xor.reduceat(mix(flat ^ _BASE), firsts)
        out[full] = mix(sums + mix(xors + sizes[full].astype(np.uint64)))
    return signed(out)


def filed_keys(flat: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The keys of concatenated non-empty sets, and the set of each key."""
    firsts = np.cumsum(sizes) - sizes
    level = np.searchsorted(BOUNDS, sizes, side="right") - 1
    # A partner may be 1.25 times as large and so one level up.
    up = np.flatnonzero(4 * BOUNDS[level + 1] <= 5 * sizes)
    doc, level = np.concatenate([np.arange(len(sizes)), up]), np.concatenate([level, level[up] + 1])
    n, groups = sizes[doc], LEVEL_GROUPS[level]
    filing = np.repeat(np.arange(len(doc)), n)
    h = mix(flat ^ np.uint64(0x6A09E667F3BCC909))[np.arange(n.sum()) + np.repeat(firsts[doc] - (np.cumsum(n) - n), n)]
    base = np.cumsum(groups) - groups
    place = base[filing] + (((h >> np.uint64(32)) * groups.astype(np.uint64)[filing]) >> np.uint64(32)).astype(np.int64)
    sums = np.zeros(int(groups.sum()), np.uint64)
    np.add.at(sums, place, mix(h))
    full = np.flatnonzero(np.bincount(place, minlength=len(sums)))
    of = np.searchsorted(base, full, side="right") - 1
    token = mix(sums[full] + mix((full - base[of]).astype(np.uint64) * _BASE + level[of].astype(np.uint64)))
    order = np.lexsort((token, of))
    token, of = token[order], of[order]
    have = np.bincount(of, minlength=len(doc))
    rank = np.arange(len(of)) - (np.cumsum(have) - have)[of]
    need = n // 4 + 1
    kept = rank < need[of]
    keys, owners = [token[kept]], [doc[of[kept]]]
    for d in np.unique(doc[have < need]).tolist():
        own = np.sort(mix(flat[firsts[d] : firsts[d] + sizes[d]] + _BASE))
        keys.append(mix(own[: int(sizes[d]) - -(-PERCENT * int(sizes[d]) // 100) + 1] ^ _BASE))
        owners.append(np.full(len(keys[-1]), d))
    return np.concatenate(keys), np.concatenate(owners)


#: From concatenated non-empty sets and their sizes to keys and the set of each.
Keys = Callable[[np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray]]


def scan_sets(buckets: int, keys_of: Keys):
    """Rows (doc_id, key, text) to documents, packed keys by bucket, and edges of keys that meet within the slice."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, limit=PASS_BYTES):
                sets = shingle_sets(part.column("text"))
                sizes, sids = np.array([len(s) for s in sets], np.int64), set_ids(sets)
                full = np.flatnonzero(sizes)
                coarse, near = np.zeros((len(sets), COARSE), np.int64), np.zeros(len(sets), np.int64)
                if len(full):
                    flat = np.concatenate([sets[i] for i in full])
                    cell = np.repeat(full, sizes[full]) * COARSE + (mix(flat) >> np.uint64(60)).astype(np.int64)
                    coarse = np.bincount(cell, minlength=len(sets) * COARSE).reshape(len(sets), COARSE)
                    near[full] = _place_of(coarse[full], sizes[full])
                fine = [point_of(own).astype(np.uint16).tobytes() if len(own) else None for own in sets]
                yield _rows(len(sets), kind=np.full(len(sets), DOCUMENT), doc_id=part.column("doc_id"), key=part.column("key"), n=sizes, sid=pa.array(sids, mask=sizes == 0), near=near, coarse=list(coarse.astype(np.int32)), fine=fine)
                if len(full):
                    _, once = np.unique(sids[full], return_index=True)
                    full = full[np.sort(once)]
                    yield from _filed(sets, full, sizes, sids, buckets, keys_of)
        pa.default_memory_pool().release_unused()  # the worker stays, beside the JVM

    return scan


def point_of(own: np.ndarray) -> np.ndarray:
    """The counts of a set's shingles by the leading bits of their hashes: about a group for every four, NODE at least.

    Points of different sizes are compared after groups of the finer one are added up.
    """
    bits = max(6, (len(own) - 1).bit_length() - 2)
    return np.minimum(np.bincount((mix(own) >> np.uint64(64 - bits)).astype(np.int64), minlength=1 << bits), 0xFFFF)


def _place_of(coarse: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Where a point lies in the packing order: by size in steps of a twentieth, then by its first coordinates."""
    out = (np.log(sizes) / np.log(1.05)).astype(np.int64)
    wide = coarse.reshape(len(sizes), 8, -1).sum(axis=2)
    width = np.sqrt(sizes / 8) * 2 + 1
    for c in range(4):
        out = out * 64 + np.clip((wide[:, c] - sizes / 8) / width + 32, 0, 63).astype(np.int64)
    return out


def _filed(sets: list[np.ndarray], full: np.ndarray, sizes: np.ndarray, sids: np.ndarray, buckets: int, keys_of: Keys) -> Iterator[pa.RecordBatch]:
    keys, owners = keys_of(np.concatenate([sets[i] for i in full]), sizes[full])
    sid = sids[full][owners]
    order = np.lexsort((sid, keys))
    keys, sid = keys[order], sid[order]
    first = np.concatenate(([True], keys[1:] != keys[:-1]))
    a, b = _edges(sid[~first], sid[first][np.cumsum(first) - 1][~first])
    yield _rows(len(a), kind=np.full(len(a), EDGE), sid=a, other=b)
    keys, sid = keys[first], sid[first]
    bucket = ((keys >> np.uint64(32)) * np.uint64(buckets)) >> np.uint64(32)
    edges = np.flatnonzero(np.concatenate(([True], bucket[1:] != bucket[:-1])))
    packed: dict[str, list] = {"keys": [], "at": [], "table": []}
    for low, high in zip(edges.tolist(), [*edges[1:].tolist(), len(keys)], strict=True):
        table, at = np.unique(sid[low:high], return_inverse=True)
        packed["keys"].append(keys[low:high].tobytes())
        packed["at"].append(at.astype(np.uint16 if len(table) <= 1 << 16 else np.uint32).tobytes())
        packed["table"].append(table.tobytes())
    yield _rows(len(edges), kind=np.full(len(edges), CELLS), bucket=bucket[edges].astype(np.int32), **packed)


def join_cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """All packed keys of some buckets: the documents of each key tied to the smallest."""
    keys, sids = [np.empty(0, np.uint64)], [np.empty(0, np.int64)]
    for batch in batches:
        for k, at, table in zip(*(batch.column(c) for c in ("keys", "at", "table")), strict=True):
            keys.append(np.frombuffer(k.as_buffer(), np.uint64))
            of = np.frombuffer(table.as_buffer(), np.int64)
            sids.append(of[np.frombuffer(at.as_buffer(), np.uint16 if len(of) <= 1 << 16 else np.uint32)])
    key, sid = np.concatenate(keys), np.concatenate(sids)
    del keys, sids
    order = np.argsort(key)
    key, sid = key[order], sid[order]
    same = key[1:] == key[:-1]
    shared = np.concatenate((same, [False])) | np.concatenate(([False], same)) if len(key) else np.empty(0, bool)
    key, sid = key[shared], sid[shared]
    if not len(key):
        return
    first = np.concatenate(([True], key[1:] != key[:-1]))
    hubs = np.minimum.reduceat(sid, np.flatnonzero(first))[np.cumsum(first) - 1]
    a, b = _edges(sid, hubs)
    for low in range(0, len(a), 100_000):
        yield pa.RecordBatch.from_arrays([pa.array(a[low : low + 100_000]), pa.array(b[low : low + 100_000])], names=["a", "b"])
    pa.default_memory_pool().release_unused()


class Tree:
    """Points in packing order, LEAF a leaf: what a leaf holds is bounded by its largest counts and its sizes."""

    def __init__(self, sids: list[int], labels: list[int], sizes: np.ndarray, points: list[np.ndarray], sets: list[np.ndarray] | None = None):
        self.sids, self.labels, self.sizes, self.sets = sids, labels, sizes, sets
        self.firsts = np.arange(0, len(sids), LEAF)
        self.points = []
        for low in self.firsts:
            own = points[low : low + LEAF]
            groups = min(len(x) for x in own)
            self.points.append(np.stack([coarser(x[None, :], groups)[0] for x in own]))
        self.most = np.stack([coarser(p, NODE).max(axis=0) for p in self.points])
        self.least_size = np.minimum.reduceat(sizes, self.firsts)
        self.most_size = np.maximum.reduceat(sizes, self.firsts)

    @classmethod
    def of_sets(cls, members: list[tuple[int, int, np.ndarray]]) -> Tree:
        sets = [m[2] for m in members]
        return cls([m[0] for m in members], [m[1] for m in members], np.array([len(s) for s in sets], np.int64), [point_of(s).astype(np.uint16) for s in sets], sets)

    def leaf(self, i: int) -> slice:
        return slice(int(self.firsts[i]), min(int(self.firsts[i]) + LEAF, len(self.sids)))

    def open_leaves(self, i: int, other: Tree, percent: int) -> list[int]:
        """The leaves of other that may have a link with leaf i; with the same tree, those from i on."""
        bound = np.minimum(self.most[i], other.most).sum(axis=1, dtype=np.int64)
        found = np.flatnonzero(may_link(bound, self.least_size[i], other.least_size, self.most_size[i], other.most_size, percent))
        return found[found >= i].tolist() if self is other else found.tolist()

    def apart_from(self, other: Tree, percent: int) -> bool:
        return self is not other and not may_link(int(np.minimum(self.most.max(0), other.most.max(0)).sum(dtype=np.int64)), self.sizes.min(), other.sizes.min(), self.sizes.max(), other.sizes.max(), percent)

    def open_pairs(self, i: int, other: Tree, j: int, percent: int) -> np.ndarray:
        """Which members of leaf i and of other's leaf j no bound excludes."""
        groups = min(self.points[i].shape[1], other.points[j].shape[1])
        a, b = coarser(self.points[i], groups), coarser(other.points[j], groups)
        shared = np.minimum(a[:, None, :], b[None, :, :]).sum(axis=2, dtype=np.int64)
        n, m = self.sizes[self.leaf(i)][:, None], other.sizes[other.leaf(j)][None, :]
        return may_link(shared, n, m, n, m, percent)


def coarser(points: np.ndarray, groups: int) -> np.ndarray:
    """The rows of points with groups added up to so many."""
    return points if points.shape[1] == groups else points.reshape(len(points), groups, -1).sum(axis=2, dtype=np.int32)


def may_link(shared, a, b, most_a, most_b, percent):
    """Whether sets of sizes from a to most_a and from b to most_b can link if they share at most so many."""
    # 100 i >= p u and u = |x| + |y| - i give (100 + p) i >= p (|x| + |y|) and 100 |x| >= p |y|.
    return ((100 + percent) * shared >= percent * (a + b)) & (100 * most_a >= percent * b) & (100 * most_b >= percent * a)


def tree_links(left: Tree, right: Tree, percent: int) -> list[tuple[int, int]]:
    """Links of members of left with members of right (or of left, if it is the same tree) that join labels."""
    root: dict[int, int] = {}

    def find(label: int) -> int:
        while (up := root.get(label, label)) != label:
            root[label] = root.get(up, up)
            label = up
        return label

    links = []
    if left.apart_from(right, percent):
        return links
    for i in range(len(left.firsts)):
        a = left.leaf(i)
        for j in left.open_leaves(i, right, percent):
            b = right.leaf(j)
            mine, other = (np.array([find(x) for x in t.labels[s]]) for t, s in ((left, a), (right, b)))
            apart = mine[:, None] != other[None, :]
            if left is right and i == j:
                apart = np.triu(apart, 1)
            if not apart.any():
                continue
            for x, y in np.argwhere(apart & left.open_pairs(i, right, j, percent)).tolist():
                x, y = x + a.start, y + b.start
                p, q = find(left.labels[x]), find(right.labels[y])
                if p != q and linked(left.sets[x], right.sets[y], percent):
                    root[max(p, q)] = min(p, q)
                    links.append((left.sids[x], right.sids[y]))
    return links


def linked(x: np.ndarray, y: np.ndarray, percent: int) -> bool:
    at = np.searchsorted(y, x)
    at[at == len(y)] = 0
    common = int((y[at] == x).sum())
    return 100 * common >= percent * (len(x) + len(y) - common)


def join_blocks(percent: int):
    """Rows sorted by (task, side, place) to the links of each task's block with itself, or of its two blocks."""

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def settle(members: dict[int, dict[int, tuple]]) -> pa.RecordBatch:
            trees = [Tree.of_sets(list(members[side].values())) for side in sorted(members)]
            links = tree_links(trees[0], trees[-1], percent) if trees else []
            return pa.RecordBatch.from_arrays([pa.array([x[i] for x in links], pa.int64()) for i in (0, 1)], names=["a", "b"])

        task, members = None, {}
        for batch in batches:
            for part in slices(batch):
                sets = shingle_sets(part.column("text"))
                columns = (part.column(c).to_pylist() for c in ("task", "side", "sid", "label", "sides"))
                for t, side, sid, label, sides, own, found in zip(*columns, sets, set_ids(sets).tolist(), strict=True):
                    if t != task:
                        if len(members) == (wanted if members else 0):
                            yield settle(members)
                        task, members, wanted = t, {}, sides
                    if found == sid:  # else another text of a repeated doc_id
                        members.setdefault(side, {})[sid] = (sid, label, own)
        if members and len(members) == wanted:
            yield settle(members)
        pa.default_memory_pool().release_unused()

    return join


def may_have_links(left: Tree, right: Tree, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Which members of left and of right have a partner with another label that no bound excludes."""
    mine, other = np.zeros(len(left.sids), bool), np.zeros(len(right.sids), bool)
    if left.apart_from(right, percent):
        return mine, other
    for i in range(len(left.firsts)):
        a = left.leaf(i)
        for j in left.open_leaves(i, right, percent):
            b = right.leaf(j)
            apart = np.array(left.labels[a])[:, None] != np.array(right.labels[b])[None, :]
            if not apart.any():
                continue
            found = apart & left.open_pairs(i, right, j, percent)
            mine[a] |= found.any(axis=1)
            other[b] |= found.any(axis=0)
    return mine, other


def open_members(percent: int):
    """Rows (points without texts) sorted by (task, side, place) to those that may have a link within their task."""

    def members(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def settle(held: list[pa.RecordBatch]) -> list[pa.RecordBatch]:
            rows = pa.Table.from_batches(held).combine_chunks()
            side, sides = rows.column("side").to_numpy(), rows.column("sides")[0].as_py()
            points = [np.frombuffer(x.as_buffer(), np.uint16) for x in rows.column("fine")]
            sizes, sids, labels = (rows.column(c).to_numpy() for c in ("n", "sid", "label"))
            trees = [Tree(sids[side == s].tolist(), labels[side == s].tolist(), sizes[side == s], [points[i] for i in np.flatnonzero(side == s)]) for s in range(sides)]
            mine, other = may_have_links(trees[0], trees[-1], percent)
            keep = np.concatenate([mine, other]) if sides == 2 else mine | other
            return rows.select(["task", "side", "sides", "place", "sid", "label"]).filter(pa.array(keep)).combine_chunks().to_batches()

        task, held = None, []
        for batch in batches:
            tasks = batch.column("task").to_numpy()
            edges = [0, *(np.flatnonzero(tasks[1:] != tasks[:-1]) + 1).tolist(), len(tasks)]
            for low, high in zip(edges[:-1], edges[1:], strict=True):
                if high > low:
                    if tasks[low] != task and held:
                        yield from settle(held)
                        held = []
                    task = tasks[low]
                    held.append(batch.slice(low, high - low))
        if held:
            yield from settle(held)
        pa.default_memory_pool().release_unused()

    return members


def _families(near_hub: DataFrame, far_hub: DataFrame) -> DataFrame:
    """(sid, family) from the hubs of documents within their slice and the hubs of those.

    All documents of a hub are in each family that the hub has in the corpus, so the hub is a family of its own only if it
    has none there or is one for others.
    """
    own = lambda df, c: df.select(F.col(c).alias("sid"), F.col(c).alias("family"))
    held = far_hub.select("hub").join(far_hub.select(F.col("family").alias("hub")), "hub", "left_anti").distinct()
    alone = near_hub.join(held, "hub", "left_anti")
    within = alone.select("sid", F.col("hub").alias("family")).union(own(alone, "hub"))
    tied = near_hub.join(far_hub, "hub").select("sid", "family").union(far_hub.select("hub", "family")).union(own(far_hub, "family"))
    return within.union(tied).distinct()


def _open(families: DataFrame, labels: DataFrame, points: DataFrame, percent: int) -> DataFrame:
    """The rows (task, side, sides, place, sid, label) to be verified: what may have a link, by its points, in the tasks of
    families with more than one label."""
    spark = families.sparkSession
    named = staged(_labelled(families, labels), "labels")
    apart = named.groupBy("family").agg(F.min("label").alias("low"), F.max("label").alias("high")).filter("low <> high").select("family")
    # Staged, since a range shuffle reads its rows twice.
    members = staged(named.join(apart, "family", "left_semi").join(points, "sid"), "members")
    blocks = staged(range_chunks(members, "family", ("near", "sid"), POINTS_WEIGHT, F.greatest("n", F.lit(POINTS_WEIGHT // POINTS))), "points")
    left, right = _nodes(blocks, "l"), _nodes(blocks, "r")
    one_label = (F.col("l_low") == F.col("l_high")) & (F.col("r_low") == F.col("r_high")) & (F.col("l_low") == F.col("r_low"))
    may = may_link(_shared("l_most", "r_most"), F.col("l_least"), F.col("r_least"), F.col("l_size"), F.col("r_size"), percent)
    pairs = staged(left.join(right, "family").filter((F.col("l_chunk") < F.col("r_chunk")) & ~one_label & may).select("family", "l_chunk", "r_chunk"), "pairs")
    rows = ("task", "side", "sides", "place", "sid", "label", "n", "fine")
    alone = _alone(blocks).select(*rows)
    both = [_of(blocks, pairs, name, side).select(*rows) for name, side in (("l", 0), ("r", 1))]
    ready = alone.union(both[0]).union(both[1]).repartition(partitions(spark), "task").sortWithinPartitions("task", "side", "place")
    return staged(ready.mapInArrow(open_members(percent), "task long, side int, sides int, place long, sid long, label long"), "open")


def _sent(rows: DataFrame) -> DataFrame:
    """Staged rows of a few numbers, to be joined with texts: by broadcast where they are few."""
    return F.broadcast(rows) if rows.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else rows


def _joined(rows: DataFrame, texts: DataFrame, percent: int) -> DataFrame:
    """Links of rows(task, side, sides, place, sid, label), written to the shared folder."""
    needed = staged(rows.select("task", "side", "sides", "place", "sid", "label"), "tasks")
    ready = texts.join(_sent(needed), "sid").repartition(partitions(rows.sparkSession), "task").sortWithinPartitions("task", "side", "place")
    return staged(ready.select("task", "side", "sides", "sid", "label", "text").mapInArrow(join_blocks(percent), EDGES), "links")


def _blocks(members: DataFrame, name: str) -> DataFrame:
    """members with the chunk of their family."""
    weight = F.greatest("n", F.lit(BLOCK_WEIGHT // BLOCK_MEMBERS))
    return staged(range_chunks(members, "family", ("near", "sid"), BLOCK_WEIGHT, weight), name)


def _place():
    """Where a row stands in its family: by slice, then within it."""
    return (F.col("slice").cast("long") * (1 << 40) + F.col("at")).alias("place")


def _alone(blocks: DataFrame) -> DataFrame:
    return blocks.select("*", F.xxhash64("family", "chunk").alias("task"), F.lit(0).alias("side"), F.lit(1).alias("sides"), _place())


def _of(blocks: DataFrame, pairs: DataFrame, name: str, side: int) -> DataFrame:
    """The members of the blocks on one side of pairs of blocks, by task."""
    met = blocks.withColumnRenamed("chunk", f"{name}_chunk").join(pairs, ["family", f"{name}_chunk"])
    return met.select("*", F.xxhash64("family", "l_chunk", "r_chunk").alias("task"), F.lit(side).alias("side"), F.lit(2).alias("sides"), _place())


def _shared(a: str, b: str):
    """What points or nodes with these counts can share at most."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: F.least(x, y)), F.lit(0).cast("long"), lambda t, x: t + x)


def _labelled(members: DataFrame, links: DataFrame) -> DataFrame:
    labels = components(links).select(F.col("id").alias("sid"), F.col("component").alias("label"))
    return members.drop("label").join(labels, "sid", "left").withColumn("label", F.coalesce("label", "sid"))


def _nodes(blocks: DataFrame, side: str) -> DataFrame:
    """The upper nodes: (family, chunk) with the range of sizes and of labels and the largest coarse counts."""
    most = F.array(*(F.max(F.get("coarse", F.lit(i))) for i in range(COARSE)))
    return blocks.groupBy("family", F.col("chunk").alias(f"{side}_chunk")).agg(
        F.min("n").alias(f"{side}_least"), F.max("n").alias(f"{side}_size"), most.alias(f"{side}_most"), F.min("label").alias(f"{side}_low"), F.max("label").alias(f"{side}_high")
    )


def linked_documents(docs: DataFrame, keys_of: Keys, percent: int) -> DataFrame:
    """row, doc_id (see every_row), n_shingles, component_id and first_row of every row of docs.

    Pairs with a key in common link if 100 * intersection >= percent * union. component_id is the smallest doc_id of a
    component, first_row the row of that document (of the smallest row, if none has a doc_id).
    """
    spark = docs.sparkSession
    n = partitions(spark)
    rows = every_row(docs).withColumnRenamed("row", "key")
    scan = staged(rows.mapInArrow(scan_sets(n, keys_of), SCANNED).withColumn("slice", F.spark_partition_id()), "sets")
    found = scan.filter(F.col("kind") == DOCUMENT)
    cells = scan.filter(F.col("kind") == CELLS).select("bucket", "keys", "at", "table").repartitionById(n, F.col("bucket"))
    near_hub = scan.filter(F.col("kind") == EDGE).select("sid", F.col("other").alias("hub"))
    far_hub = staged(cells.mapInArrow(join_cells, EDGES).distinct().select(F.col("a").alias("hub"), F.col("b").alias("family")), "hubs")
    families = staged(_families(near_hub, far_hub), "families")
    firsts = found.filter("n > 0").groupBy("sid").agg(F.min("key").alias("key"), F.first("n").alias("n"), F.first("near").alias("near"), F.first("coarse").alias("coarse"), F.first("fine").alias("fine"))
    members = staged(firsts.join(families.select("sid").distinct(), "sid", "left_semi"), "members")
    texts = staged(rows.select("key", "text").join(_sent(members.select("sid", "key")), "key").select("sid", "text"), "texts")
    points = members.drop("key").withColumn("label", F.col("sid"))

    # A document in the family of its smallest hub; the hub itself in each block of its own.
    own = staged(families.groupBy("sid").agg(F.min("family").alias("family")).join(points.select("sid", "n", "near", "label"), "sid"), "own")
    blocks = _blocks(own, "blocks")
    heads = blocks.select("family", "chunk").distinct().withColumn("sid", F.col("family")).join(points.select("sid", "n", "near", "label"), "sid").withColumns({"slice": F.lit(0), "at": F.lit(0)})
    met = blocks.filter("sid <> family").unionByName(heads)
    links = _joined(_alone(met), texts, percent)
    # One of each component that lies in several blocks of a family, or of several in one block's family.
    several = blocks.groupBy("family").agg(F.max("chunk").alias("last"), F.min("chunk").alias("first")).filter("first < last").select("family")
    parts = _labelled(own.join(several, "family", "left_semi"), links).groupBy("family", "label").agg(F.min(F.struct("near", "sid", "n")).alias("x")).select("family", "label", "x.*")
    links = links.union(_joined(_alone(_blocks(parts, "parts")), texts, percent))
    links = links.union(_joined(_open(families, links, points.drop("label"), percent), texts, percent))

    # Copies by slice: a group of copies adds one row per slice to either side of the join.
    final = components(links).select(F.col("id").alias("sid"), F.col("component").alias("label"))
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "key"))
    runs = found.filter("n > 0").groupBy("slice", "sid").agg(first.alias("low"))
    named = staged(runs.join(final, "sid", "left").withColumn("label", F.coalesce("label", "sid")), "named")
    lowest = named.groupBy("label").agg(F.min("low").alias("first"))
    by_slice = named.join(lowest, "label").select("slice", "sid", F.col("first.doc_id").alias("component_id"), F.col("first.key").alias("first_row"))
    out = found.join(by_slice, ["slice", "sid"], "left")
    return out.select(F.col("key").alias("row"), "doc_id", F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"), "first_row")


def jaccard_join(docs: DataFrame) -> DataFrame:
    """One row per row of docs: doc_id, n_shingles, component_id.

    A-Z count as a-z. Shingles are five consecutive words; a text of one to four words is one shingle; null or wordless
    texts have none and are linked with nothing. Equal sets always link. Rows that share a doc_id are told apart by their
    texts; a row without a doc_id takes part, and component_id is the smallest doc_id there is (null if there is none). An
    empty table gives an empty result; other columns are not read.
    """
    return linked_documents(docs, filed_keys, PERCENT).select("doc_id", "n_shingles", "component_id")
