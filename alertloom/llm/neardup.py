"""Near duplicates by an LSH forest of MinHash signatures, confirmed on full sets.

1. Every text gives its set of word shingles and a signature. Texts with equal
   sets are one class, represented by its smallest id.
2. Every tree of the forest is an order of the signatures: the classes are sorted
   by their values under that tree's choice of hash functions. Sorted neighbours
   with a long common prefix are candidates. A region of equal prefixes begins at
   MIN_DEPTH values; where it holds more than REGION rows it is deepened value by
   value, so depth follows density. Regions that stay larger at full depth, near
   copies of each other throughout, are compared within a window of half a REGION.
   What a deepening parts is not lost: see 5.
3. Within a region, the sketches of all rows are compared, and of the pairs that
   they put at MAYBE or more only a maximum spanning forest is kept. So a group of
   n near copies gives fewer than n pairs, the likeliest ones, not n squared.
4. The pairs kept are confirmed on the full sets: first the likeliest of each class,
   then those between parts that these do not link.
5. A cell is all rows of a tree with the same MIN_DEPTH values. In cells of more than
   REGION rows, the rows of different parts are then compared throughout, at whatever
   depth they left each other.
6. Where a pair fails, the groups that the forest held together are searched again:
   in all their cells, all pairs between parts that the sketches put at MAYBE or more
   are confirmed by the task that compares them, which has the full sets. Only the
   links leave it, fewer than it has rows.
7. Confirmed pairs and class members are joined into components.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from alertloom.llm.bytetext import lower_ascii, mix64, ragged, row_slices, span_hashes, sub_batches, text_bytes, word_spans
from alertloom.llm.components import components, least_reachable
from alertloom.storage import fits, materialise

HASHES = 128
TREES = 12
MIN_DEPTH = 3
DEPTH = 16
REGION = 500
MAYBE = 0.68  # sketch similarity (its standard error at 0.8 is 0.037) from which pairs are taken
WALK_ROWS = 2_000  # rows that a task compares at a time
BLOCK = 2_000  # rows of a crowded cell that are compared with as many others at a time
BLOCK_SHINGLES = 1_000_000  # of a block whose rows bring their full sets
MARK_BITS = 1 << 28  # at most, of the marks that say which texts are asked for
MARK_CHUNK = 1 << 16  # bits of the marks that a task packs together
SHARE = (80, 100)  # linked: 100 * intersection >= 80 * union
ID_BYTES = 5  # of each shingle hash in the sets that are compared

SIGNED = "doc_id long, n_shingles long, set_key binary, signature binary"
ROWS = "tree int, label binary, doc_id long, n_shingles long, sketch binary, component long"


def shingle_hashes(words: np.ndarray, size: int) -> np.ndarray:
    """Hashes of the runs of `size` words; of all words if there are fewer."""
    if not len(words):
        return words
    width = min(size, len(words))
    total = np.zeros(len(words) - width + 1, np.uint64)
    for k in range(width):
        total = total * np.uint64(0x9FB21C651E98DF25) + words[k : k + len(total)]
    return mix64(total + np.uint64(width))


def shingle_sets(column: pa.Array, size: int) -> Iterator[np.ndarray]:
    """The sorted distinct shingle hashes of each text."""
    data, bounds = text_bytes(column)
    for a, b in row_slices(bounds):
        edges = bounds[a : b + 1] - bounds[a]
        part = lower_ascii(data[bounds[a] : bounds[b]])
        begin, end, before = word_spans(part, edges)
        words = span_hashes(part, begin, end)
        for k in range(b - a):
            yield np.unique(shingle_hashes(words[before[k] : before[k + 1]], size))


def _coefficients() -> tuple[np.ndarray, np.ndarray]:
    draw = np.random.default_rng(20240501)
    return draw.integers(0, 1 << 32, HASHES, np.uint32) | np.uint32(1), draw.integers(0, 1 << 32, HASHES, np.uint32)


def signatures(sets: list[np.ndarray]) -> np.ndarray:
    """16-bit MinHash values, one row per non-empty set."""
    factor, shift = _coefficients()
    flat = (np.concatenate(sets) >> np.uint64(32)).astype(np.uint32)
    starts = np.cumsum([0, *map(len, sets[:-1])])
    out = np.empty((len(sets), HASHES), "<u2")
    for k in range(HASHES):
        out[:, k] = np.minimum.reduceat(flat * factor[k] + shift[k], starts) & np.uint32(0xFFFF)
    return out


def sign(docs: DataFrame, size: int) -> DataFrame:
    """doc_id, n_shingles, key of the whole set and signature of every text."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sub_batches(batches, 1, 2 << 20):
            sets = list(shingle_sets(batch.column(1), size))
            full = [s for s in sets if len(s)]
            rows = iter(signatures(full)) if full else iter(())
            signed = [next(rows).tobytes() if len(s) else None for s in sets]
            keys = [hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None for s in sets]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([len(s) for s in sets], pa.int64()), pa.array(keys, pa.binary()), pa.array(signed, pa.binary())], ["doc_id", "n_shingles", "set_key", "signature"])

    return docs.mapInArrow(work, SIGNED)


def _orders() -> np.ndarray:
    """Which hash functions each tree reads, in turn: trees share none in their first values."""
    first = np.arange(TREES * MIN_DEPTH).reshape(TREES, MIN_DEPTH)
    draw = np.random.default_rng(7)
    return np.array([[*own, *draw.permutation(np.setdiff1d(np.arange(HASHES), own))[: DEPTH - MIN_DEPTH]] for own in first])


def forest_rows(classes: DataFrame) -> DataFrame:
    """A row per class and tree: its label in that tree and the sketch.

    A sketch has four bits of every MinHash value, two values to a byte.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        orders = _orders()
        for batch in batches:
            for start in range(0, batch.num_rows, 1000):
                part = batch.slice(start, 1000)
                signed = np.frombuffer(b"".join(part.column(2).to_pylist()), "<u2").reshape(-1, HASHES)
                labels = [r.tobytes() for order in orders for r in signed[:, order].astype(">u2")]
                sketches = pa.array([r.tobytes() for r in ((signed[:, ::2] & 15) | ((signed[:, 1::2] & 15) << 4)).astype(np.uint8)], pa.binary())
                again = pa.array(np.tile(np.arange(part.num_rows), TREES))
                tree = pa.array(np.repeat(np.arange(TREES, dtype=np.int32), part.num_rows))
                columns = [part.column(k).take(again) for k in (0, 1, 3)]
                yield pa.RecordBatch.from_arrays([tree, pa.array(labels, pa.binary()), columns[0], columns[1], sketches.take(again), columns[2]], ["tree", "label", "doc_id", "n_shingles", "sketch", "component"])

    return classes.select("doc_id", "n_shingles", "signature", "component").mapInArrow(work, ROWS)


def _unpack(packed: np.ndarray) -> np.ndarray:
    out = np.empty((len(packed), HASHES), np.uint8)
    out[:, ::2], out[:, 1::2] = packed & 15, packed >> 4
    return out


class Region:
    """Sorted rows of one or several whole regions."""

    def __init__(self, tree: np.ndarray, label: np.ndarray, ids: np.ndarray, sizes: np.ndarray, sketch: np.ndarray, component: np.ndarray):
        self.tree, self.label, self.ids, self.sizes, self.sketch, self.component = tree, label, ids, sizes, sketch, component

    @classmethod
    def of(cls, table: pa.Table | pa.RecordBatch) -> Region:
        flat = lambda name, kind, width: np.frombuffer(b"".join(table.column(name).to_pylist()), kind).reshape(-1, width)
        number = lambda name: np.asarray(table.column(name).to_numpy())
        return cls(number("tree"), flat("label", ">u2", DEPTH).astype(np.uint16), number("doc_id"), number("n_shingles"), _unpack(flat("sketch", np.uint8, HASHES // 2)), number("component"))

    def __len__(self) -> int:
        return len(self.ids)

    def part(self, rows: slice) -> Region:
        return Region(*(x[rows] for x in (self.tree, self.label, self.ids, self.sizes, self.sketch, self.component)))

    @staticmethod
    def join(parts: list[Region]) -> Region:
        return Region(*(np.concatenate(x) for x in zip(*((p.tree, p.label, p.ids, p.sizes, p.sketch, p.component) for p in parts), strict=True)))

    def prefixes(self) -> np.ndarray:
        """Values that each row shares with the one before it; -1 across trees."""
        same = self.label[1:] == self.label[:-1]
        shared = np.logical_and.accumulate(same, axis=1).sum(axis=1)
        return np.concatenate([[-1], np.where(self.tree[1:] == self.tree[:-1], shared, -1)])

    def regions(self) -> np.ndarray:
        """Region number of each row, at the depth that its density asks for."""
        prefix = self.prefixes()
        cut = prefix < MIN_DEPTH
        for depth in range(MIN_DEPTH + 1, DEPTH + 1):
            number = np.cumsum(cut)
            crowded = (np.bincount(number) > REGION)[number]
            if not crowded.any():
                break
            cut |= crowded & (prefix < depth)
        return np.cumsum(cut)

    def alike(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """All pairs of MAYBE or more between components within regions (row numbers) and their likeness."""
        least = (MAYBE + (1 - MAYBE) / 16) * HASHES  # one in 16 values agrees by chance
        number = self.regions()
        crowded = (np.bincount(number) > REGION)[number]
        live, found = np.arange(len(self)), []
        for k in range(1, len(self)):
            live = live[live < len(self) - k]
            live = live[number[live] == number[live + k]]
            if k > REGION // 2:
                live = live[~crowded[live]]
            if not len(live):
                break
            left = live[self.component[live] != self.component[live + k]]
            small, large = self.sizes[left], self.sizes[left + k]
            left = left[SHARE[1] * np.minimum(small, large) >= SHARE[0] * np.maximum(small, large)]
            for some in np.array_split(left, -(-len(left) // 4096)) if len(left) else []:
                same = (self.sketch[some] == self.sketch[some + k]).sum(axis=1, dtype=np.int64)
                keep = same >= least
                found.append(np.stack([some[keep], some[keep] + k, same[keep]]))
        both = np.concatenate(found, axis=1) if found else np.zeros((3, 0), np.int64)
        return both[0], both[1], both[2]

    def pairs(self, most: int | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Pairs to confirm (row numbers) and their likeness; see likeliest_between."""
        a, b, same = self.alike()
        keep = likeliest_between(self.component[a], self.component[b], same, most)
        return a[keep], b[keep], same[keep]


def spanning_forest(n: int, a: np.ndarray, b: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Numbers of the edges (a, b) of a maximum spanning forest of n nodes.

    Every group takes its heaviest edge to another group, and groups that are so
    connected become one, until no edge leads out of a group.
    """
    kept, group = [], np.arange(n)
    rank = np.empty(len(a), np.int64)
    rank[np.lexsort((np.arange(len(a)), weight))] = np.arange(len(a))  # no two alike, so no loops
    edges = np.arange(len(a))
    while True:
        edges = edges[group[a[edges]] != group[b[edges]]]
        if not len(edges):
            return np.concatenate(kept) if kept else edges
        best = np.full(n, -1, np.int64)
        np.maximum.at(best, group[a[edges]], rank[edges])
        np.maximum.at(best, group[b[edges]], rank[edges])
        taken = edges[(best[group[a[edges]]] == rank[edges]) | (best[group[b[edges]]] == rank[edges])]
        kept.append(taken)
        parent = np.arange(n)
        for x, y in zip(group[a[taken]].tolist(), group[b[taken]].tolist(), strict=True):
            while parent[x] != x:
                parent[x] = parent[parent[x]]
                x = parent[x]
            while parent[y] != y:
                parent[y] = parent[parent[y]]
                y = parent[y]
            parent[max(x, y)] = min(x, y)
        while (parent != parent[parent]).any():
            parent = parent[parent]
        group = parent[group]


PAIRS = "a long, b long, same long, part int, head boolean, tree int, label binary, doc_id long, n_shingles long, sketch binary, component long"


def _pair_batch(region: Region, most: int | None) -> pa.RecordBatch | None:
    a, b, same = region.pairs(most)
    if not len(a):
        return None
    low, high = np.minimum(region.ids[a], region.ids[b]), np.maximum(region.ids[a], region.ids[b])
    return pa.RecordBatch.from_arrays([pa.array(low), pa.array(high), pa.array(same)], ["a", "b", "same"])


def _wide(batch: pa.RecordBatch | None, part: int, head: bool, rows: Region | None) -> Iterator[pa.RecordBatch]:
    """A pair batch or border rows in the shape of PAIRS."""
    if rows is None:
        if batch is not None:
            n = batch.num_rows
            void = [pa.nulls(n, t) for t in (pa.int32(), pa.bool_(), pa.int32(), pa.binary(), pa.int64(), pa.int64(), pa.binary(), pa.int64())]
            yield pa.RecordBatch.from_arrays([*batch.columns, *void], [c.split()[0] for c in PAIRS.split(", ")])
        return
    n = len(rows)
    first = [pa.nulls(n, pa.int64())] * 3 + [pa.array([part] * n, pa.int32()), pa.array([head] * n)]
    own = [pa.array(rows.tree), pa.array([r.tobytes() for r in rows.label.astype(">u2")], pa.binary()), pa.array(rows.ids), pa.array(rows.sizes), pa.array([r.tobytes() for r in rows.sketch[:, ::2] | (rows.sketch[:, 1::2] << 4)], pa.binary()), pa.array(rows.component)]
    yield pa.RecordBatch.from_arrays([*first, *own], [c.split()[0] for c in PAIRS.split(", ")])


def candidate_pairs(classes: DataFrame, most: int | None = 0) -> DataFrame:
    """Distinct pairs (a < b, same) of ids. classes: doc_id, n_shingles, signature, component.

    The rows of all trees are range-partitioned by their place in the order, so a
    crowded region is dealt over many tasks. A region that a border cuts is
    finished afterwards from the rows on both sides of that border.
    """

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, held, first = TaskContext.get().partitionId(), None, True
        for batch in (b.slice(at, WALK_ROWS) for b in batches for at in range(0, b.num_rows, WALK_ROWS)):
            rows = Region.of(batch)
            if first:
                yield from _wide(None, part, True, rows.part(slice(0, REGION)))
                first = False
            held = rows if held is None else Region.join([held, rows])
            cuts = np.flatnonzero(held.prefixes() < MIN_DEPTH)
            if cuts[-1] > 0:  # what stands before the last cut is whole
                yield from _wide(_pair_batch(held.part(slice(0, int(cuts[-1]))), most), part, False, None)
                held = held.part(slice(int(cuts[-1]), len(held)))
            elif len(held) > WALK_ROWS:  # one region throughout: it goes on from the rows that may still be compared
                yield from _wide(_pair_batch(held, most), part, False, None)
                held = held.part(slice(len(held) - REGION, len(held)))
        if held is not None:
            yield from _wide(_pair_batch(held, most), part, False, None)
            yield from _wide(None, part, False, held.part(slice(max(0, len(held) - REGION), len(held))))

    ordered = forest_rows(classes).repartitionByRange("tree", "label", "doc_id").sortWithinPartitions("tree", "label", "doc_id")
    walked = materialise(ordered.mapInArrow(walk, PAIRS), "forest-walk")
    border = walked.where("part is not null")
    # Tasks without rows leave gaps in the numbers; one small row per task closes them.
    parts = sorted(r["part"] for r in border.select("part").distinct().collect())
    spark = classes.sparkSession
    follow = spark.createDataFrame([(p, k) for k, p in enumerate(parts)], "part int, place int")
    sides = border.join(F.broadcast(follow), "part").withColumn("border", F.when(F.col("head"), F.col("place") - 1).otherwise(F.col("place")))

    def finish(group: pa.Table) -> pa.Table:
        kinds = pa.schema([(n, pa.int64()) for n in ("a", "b", "same")])
        made = _pair_batch(Region.of(group.sort_by([("tree", "ascending"), ("label", "ascending"), ("doc_id", "ascending")])), most)
        return pa.Table.from_batches([made] if made is not None else [], kinds)

    finished = sides.select("border", "tree", "label", "doc_id", "n_shingles", "sketch", "component").groupBy("border").applyInArrow(finish, "a long, b long, same long")
    return walked.where("part is null").select("a", "b", "same").union(finished).groupBy("a", "b").agg(F.max("same").alias("same"))


def agreeing(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Values that each row of a shares with each row of b, of sketches in 64-bit words."""
    unlike = np.zeros((len(a), len(b)), np.uint8)
    for k in range(a.shape[1]):
        bits = a[:, k, None] ^ b[None, :, k]
        bits |= bits >> np.uint64(2)
        bits |= bits >> np.uint64(1)
        unlike += np.bitwise_count(bits & np.uint64(0x1111111111111111))
    return HASHES - unlike


def likeliest_between(x: np.ndarray, y: np.ndarray, same: np.ndarray, most: int | None) -> np.ndarray:
    """Numbers of the pairs between parts x and y to confirm: a spanning forest of the
    parts if most is 0, else the likeliest `most` of any two parts, or all."""
    if most is None or not len(x):
        return np.arange(len(x))
    names, number = np.unique(np.concatenate([x, y]), return_inverse=True)
    x, y = number[: len(x)], number[len(x) :]
    if most == 0:
        return spanning_forest(len(names), x, y, same)
    both = np.minimum(x, y) * len(names) + np.maximum(x, y)
    order = np.lexsort((-same, both))
    begins = np.flatnonzero(np.diff(both[order], prepend=-1))
    place = np.arange(len(order)) - np.repeat(begins, np.diff(begins, append=len(order)))
    return order[place < most]


def _alike_across(group: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Ids and parts of the rows; row numbers and likeness of the pairs of MAYBE or more
    between parts, between two blocks or within one."""
    number = lambda name: group.column(name).to_numpy()
    ids, sizes, part, block = number("doc_id"), number("n_shingles"), number("component"), number("block")
    sketch = np.frombuffer(b"".join(group.column("sketch").to_pylist()), "<u8").reshape(len(ids), -1)
    order = np.argsort(sizes, kind="stable")
    left, right = order[block[order] == group.column("x")[0].as_py()], order[block[order] == group.column("y")[0].as_py()]
    least = (MAYBE + (1 - MAYBE) / 16) * HASHES
    found = [np.zeros((3, 0), np.int64)]
    for at in range(0, len(left), 64):
        some = left[at : at + 64]
        # Sizes ascend: what no row here can be similar enough to stands before or after.
        low = np.searchsorted(SHARE[1] * sizes[right], SHARE[0] * sizes[some[0]])
        high = np.searchsorted(SHARE[0] * sizes[right], SHARE[1] * sizes[some[-1]], "right")
        with_ = right[low:high]
        same = agreeing(sketch[some], sketch[with_])
        small, large = np.minimum.outer(sizes[some], sizes[with_]), np.maximum.outer(sizes[some], sizes[with_])
        i, j = np.nonzero((same >= least) & (part[some][:, None] != part[with_]) & (SHARE[1] * small >= SHARE[0] * large))
        found.append(np.stack([some[i], with_[j], same[i, j].astype(np.int64)]))
    return ids, part, *np.concatenate(found, axis=1)


def met_blocks(classes: DataFrame, more_than: int, sets: DataFrame | None = None) -> DataFrame:
    """Rows of the cells that hold more than that many rows, and different components,
    once for every two blocks (x, y) that are to be compared, or one with itself.

    The rows of a cell are dealt into blocks, those of its largest component apart
    from the others. Two blocks of the largest component do not meet: so a large group
    of near copies costs its size times the rows around it. Columns of sets (doc_id, ...)
    come with the rows, and blocks are smaller where these are large.
    """
    rows = forest_rows(classes).withColumn("cell", F.substring("label", 1, 2 * MIN_DEPTH)).drop("label")
    weight = F.count(F.lit(1)) / BLOCK if sets is None else F.greatest(F.count(F.lit(1)) / BLOCK, F.sum("n_shingles") / BLOCK_SHINGLES)
    parts = rows.groupBy("tree", "cell", "component").agg(F.count(F.lit(1)).alias("n"), weight.alias("blocks"))
    sizes = parts.groupBy("tree", "cell").agg(F.sum("n").alias("n"), F.sum("blocks").alias("blocks"), F.max(F.struct("n", "component", "blocks")).alias("top"))
    whole = lambda blocks: F.greatest(F.lit(1), F.ceil(F.round(blocks, 6))).cast("int")
    crowded = sizes.where((F.col("n") > more_than) & (F.col("n") > F.col("top.n")))
    crowded = materialise(crowded.select("tree", "cell", F.col("top.component").alias("top"), whole(F.col("blocks") - F.col("top.blocks")).alias("others"), whole(F.col("top.blocks")).alias("tops")), "crowded-cells")
    placed = rows.join(F.broadcast(crowded) if fits(crowded) else crowded, ["tree", "cell"])
    by_hash = lambda n: F.pmod(F.xxhash64("doc_id"), F.col(n)).cast("int")
    placed = placed.withColumn("block", F.when(F.col("component") == F.col("top"), F.col("others") + by_hash("tops")).otherwise(by_hash("others")))
    if sets is not None:
        placed = placed.join(sets, "doc_id")
    meets = lambda x, y: F.struct(x.alias("x"), y.alias("y"))
    block, none = F.col("block"), F.array().cast("array<struct<x:int,y:int>>")
    first = F.when(block < F.col("others"), F.transform(F.sequence(block, F.col("others") + F.col("tops") - 1), lambda y: meets(block, y))).otherwise(none)
    second = F.when(block > 0, F.transform(F.sequence(F.lit(0), F.least(block, F.col("others")) - 1), lambda x: meets(x, block))).otherwise(none)
    brought = [] if sets is None else [c for c in sets.columns if c != "doc_id"]
    return placed.select("tree", "cell", "block", "doc_id", "n_shingles", "sketch", "component", *brought, F.inline(F.concat(first, second)).alias("x", "y"))


def _edges(ids: np.ndarray, a: np.ndarray, b: np.ndarray) -> pa.Table:
    return pa.table({"a": np.minimum(ids[a], ids[b]), "b": np.maximum(ids[a], ids[b])}, pa.schema([("a", pa.int64()), ("b", pa.int64())]))


def crowded_pairs(classes: DataFrame) -> DataFrame:
    """Distinct pairs (a < b) to confirm between different components within crowded
    cells: a spanning forest of the components of any two blocks."""

    def compare(group: pa.Table) -> pa.Table:
        ids, part, a, b, same = _alike_across(group)
        keep = likeliest_between(part[a], part[b], same, 0)
        return _edges(ids, a[keep], b[keep])

    return met_blocks(classes, REGION).groupBy("tree", "cell", "x", "y").applyInArrow(compare, "a long, b long").distinct()


def linked_rows(elements: list[bytes], a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Whether the sets of the rows a and b (row numbers, pair by pair) are similar enough."""
    flat = np.frombuffer(b"".join(elements), np.uint8).reshape(-1, ID_BYTES)
    wide = np.zeros((len(flat), 8), np.uint8)
    wide[:, :ID_BYTES] = flat
    names, number = np.unique(wide.view("<u8").ravel(), return_inverse=True)
    sizes = np.array([len(e) // ID_BYTES for e in elements])
    starts = np.cumsum(sizes) - sizes
    linked, order = np.zeros(len(a), bool), np.argsort(a, kind="stable")
    mark = np.zeros(len(names), bool)
    for own in np.split(order, np.flatnonzero(np.diff(a[order])) + 1) if len(a) else ():
        row = a[own[0]]
        mine = number[starts[row] : starts[row] + sizes[row]]
        mark[mine] = True
        step = max(1, BLOCK_SHINGLES // int(sizes[b[own]].max()))
        for some in (own[k : k + step] for k in range(0, len(own), step)):
            size = sizes[b[some]]
            shared = np.add.reduceat(mark[number[ragged(starts[b[some]], size)]], np.cumsum(size) - size, dtype=np.int64)
            linked[some] = SHARE[1] * shared >= SHARE[0] * (sizes[row] + size - shared)
        mark[mine] = False
    return linked


def links_between_parts(classes: DataFrame, docs: DataFrame, size: int) -> DataFrame:
    """Links (a < b) that join what is linked between different components in all cells.

    All pairs of MAYBE or more are confirmed where they are found, the likeliest first;
    a pair that meets in several trees counts in the first of them.
    """

    def compare(group: pa.Table) -> pa.Table:
        ids, part, a, b, same = _alike_across(group)
        cells = np.frombuffer(b"".join(group.column("cells").to_pylist()), np.uint16).reshape(len(ids), TREES, MIN_DEPTH)
        tree = group.column("tree")[0].as_py()
        met = np.zeros(len(a), bool)
        for earlier in range(tree):
            met |= (cells[a, earlier] == cells[b, earlier]).all(axis=1)
        a, b, same = a[~met], b[~met], same[~met]
        elements = group.column("elements").to_pylist()
        tried = likeliest_between(part[a], part[b], same, 0)
        links = tried[linked_rows(elements, a[tried], b[tried])]
        now = part
        if len(links):
            names, least = least_reachable(part[a[links]], part[b[links]])
            at = np.minimum(np.searchsorted(names, part), len(names) - 1)
            now = np.where(names[at] == part, least[at], part)
        open_ = np.setdiff1d(np.flatnonzero(now[a] != now[b]), tried)
        links = np.concatenate([links, open_[linked_rows(elements, a[open_], b[open_])]])
        keep = links[likeliest_between(part[a[links]], part[b[links]], same[links], 0)]
        return _edges(ids, a[keep], b[keep])

    full = shingle_sets_of(classes.select("doc_id"), docs, size).where(F.length("elements") > 0)
    own = classes.select("doc_id", F.substring("signature", 1, 2 * TREES * MIN_DEPTH).alias("cells")).join(full.withColumnRenamed("id", "doc_id"), "doc_id")
    return met_blocks(classes, 1, materialise(own, "open-sets")).groupBy("tree", "cell", "x", "y").applyInArrow(compare, "a long, b long").distinct()


def id_marks(ids: DataFrame) -> np.ndarray:
    """Packed bits, a power of two of them: those at the hashes of the ids are set.

    About 32 bits or more for each row of ids, at most MARK_BITS; that is also what the driver gets.
    """
    bits = min(MARK_BITS, max(MARK_CHUNK, 1 << (32 * ids.count()).bit_length()))
    slot = _slot(F.col("doc_id"), bits)
    places = ids.select(slot.alias("slot")).distinct().select(F.floor(F.col("slot") / MARK_CHUNK).alias("chunk"), (F.col("slot") % MARK_CHUNK).alias("place"))

    def pack(group: pa.Table) -> pa.Table:
        on = np.zeros(MARK_CHUNK, bool)
        on[group.column("place").to_numpy()] = True
        return pa.table({"chunk": group.column("chunk").slice(0, 1), "marks": pa.array([np.packbits(on, bitorder="little").tobytes()], pa.binary())})

    marks = np.zeros(bits // 8, np.uint8)
    for row in places.groupBy("chunk").applyInArrow(pack, "chunk long, marks binary").toLocalIterator():
        at = row["chunk"] * MARK_CHUNK // 8
        marks[at : at + MARK_CHUNK // 8] = np.frombuffer(row["marks"], np.uint8)
    return marks


def _slot(column: Column, bits: int) -> Column:
    return F.pmod(F.xxhash64(column), F.lit(bits).cast("long"))


def shingle_sets_of(ids: DataFrame, docs: DataFrame, size: int) -> DataFrame:
    """id, elements (its packed set): of every row of docs with one of the ids (doc_id), and
    of a few others, which joins drop. Texts do not travel: the marks go to them."""
    marks = id_marks(ids)
    shared = docs.sparkSession.sparkContext.broadcast(marks)

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            slot = whole.column(2).to_numpy()
            asked = whole.filter(pa.array((shared.value[slot >> 3] >> (slot & 7).astype(np.uint8) & 1).astype(bool)))
            for batch in sub_batches(iter([asked]), 1, 2 << 20):
                packed = [np.ascontiguousarray((s >> np.uint64(64 - 8 * ID_BYTES)).astype("<u8").view(np.uint8).reshape(-1, 8)[:, :ID_BYTES]).tobytes() for s in shingle_sets(batch.column(1), size)]
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(packed, pa.binary())], ["id", "elements"])

    marked = docs.select("doc_id", "text", _slot(F.col("doc_id"), 8 * len(marks)).alias("slot"))
    return materialise(marked.mapInArrow(sets, "id long, elements binary"), "shingle-sets")


def _shared(a: bytes, b: bytes) -> int:
    """Elements in both of two sorted sets of ID_BYTES-byte numbers."""
    both = np.concatenate([np.frombuffer(x, np.uint8).reshape(-1, ID_BYTES) for x in (a, b)])
    number = np.zeros((len(both), 8), np.uint8)
    number[:, :ID_BYTES] = both
    values = np.sort(number.view("<u8").ravel())
    return int((values[1:] == values[:-1]).sum())


def confirm(pairs: DataFrame, docs: DataFrame, size: int) -> DataFrame:
    """pairs with `linked`: whether the full sets are similar enough."""

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            linked = []
            for x, y in zip(batch.column(2), batch.column(3), strict=True):
                a, b = x.as_py(), y.as_py()
                both = _shared(a, b)
                linked.append(SHARE[1] * both >= SHARE[0] * ((len(a) + len(b)) // ID_BYTES - both))
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(linked, pa.bool_())], ["a", "b", "linked"])

    asked = pairs.select(F.col("a").alias("doc_id")).union(pairs.select(F.col("b").alias("doc_id")))
    elements = shingle_sets_of(asked, docs, size)
    first = pairs.join(elements.select(F.col("id").alias("a"), F.col("elements").alias("left")), "a")
    both = first.join(elements.select(F.col("id").alias("b"), F.col("elements").alias("right")), "b")
    checked = both.select("a", "b", "left", "right").mapInArrow(compare, "a long, b long, linked boolean")
    # Rows that repeat an id give several sets: one that is linked is enough.
    return checked.groupBy("a", "b").agg(F.max("linked").alias("linked"))


def between_parts(pairs: DataFrame, parts: DataFrame) -> DataFrame:
    """The pairs (a, b) whose ends lie in different components (node, component)."""
    of = lambda end: parts.select(F.col("node").alias(end), F.col("component").alias(f"part_{end}"))
    both = pairs.join(of("a"), "a", "left").join(of("b"), "b", "left")
    return both.where(F.coalesce("part_a", "a") != F.coalesce("part_b", "b")).select("a", "b")


def near_duplicates(docs: DataFrame, shingle_words: int = 5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id, kept: one row per row of docs.

    Null and blank texts have no shingles and are linked with nothing; a null id is
    its own, nameless component and is kept. Rows that repeat an id are one node.
    Words are split at ASCII white space, A-Z lower-cased.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    signed = materialise(sign(rows, shingle_words), "signatures")
    usable = signed.where("doc_id is not null and set_key is not null")
    grouped = usable.groupBy("set_key").agg(F.min("doc_id").alias("rep"), F.count(F.lit(1)).alias("n"), F.first("n_shingles").alias("n_shingles"), F.first("signature").alias("signature"))
    classes = materialise(grouped, "classes")
    copied = materialise(classes.where("n > 1").select(F.col("set_key").alias("copied"), "rep"), "copied-sets")
    members = usable.select("set_key", "doc_id").join(copied, F.col("set_key") == F.col("copied")).where("doc_id <> rep").select(F.col("doc_id").alias("a"), F.col("rep").alias("b"))

    nodes = classes.select(F.col("rep").alias("doc_id"), "n_shingles", "signature", F.col("rep").alias("component"))
    pairs = materialise(candidate_pairs(nodes), "pairs")
    likeliest = F.max(F.struct("same", (-F.col("a")).alias("a"), (-F.col("b")).alias("b"))).alias("p")
    ends = pairs.select("a", "b", "same", F.col("a").alias("end")).union(pairs.select("a", "b", "same", F.col("b").alias("end")))
    best = materialise(ends.groupBy("end").agg(likeliest).select((-F.col("p.a")).alias("a"), (-F.col("p.b")).alias("b")).distinct(), "likeliest")
    first = materialise(confirm(best, rows, shingle_words), "checked-likeliest")
    rest = between_parts(pairs.join(best, ["a", "b"], "left_anti"), components(first.where("linked")))
    second = materialise(confirm(materialise(rest, "other-pairs"), rows, shingle_words), "checked-others")
    checked = first.union(second)

    def labelled(some: DataFrame, parts: DataFrame) -> DataFrame:
        known = parts.select(F.col("node").alias("doc_id"), F.col("component").alias("known"))
        return materialise(some.drop("component").join(known, "doc_id", "left").withColumn("component", F.coalesce("known", "doc_id")).drop("known"), "open-classes")

    def with_more(found: DataFrame) -> DataFrame:
        more = materialise(found.select("a", "b").distinct().join(checked.select("a", "b"), ["a", "b"], "left_anti"), "more-pairs")
        return checked.union(materialise(confirm(more, rows, shingle_words), "checked-again"))

    checked = with_more(crowded_pairs(labelled(nodes, components(checked.where("linked")))))
    linked = checked.where("linked").select("a", "b")
    # Groups that a failed pair held together are searched again, between their parts.
    parts = components(linked)
    failed = materialise(between_parts(checked.where("not linked"), parts), "failed")
    if failed.limit(1).count():
        held = components(checked)
        broken = materialise(failed.select(F.col("a").alias("node")).join(held, "node").select("component").distinct(), "broken")
        # Held groups are of any size: only the few names of the broken ones travel.
        again = held.join(F.broadcast(broken) if fits(broken) else broken, "component", "left_semi").select(F.col("node").alias("doc_id"))
        open_nodes = labelled(nodes.join(again, "doc_id", "left_semi"), parts)
        linked = linked.union(materialise(links_between_parts(open_nodes, rows, shingle_words), "links-between-parts"))
    joined = components(linked.union(members))
    out = signed.select("doc_id", "n_shingles").join(joined.select(F.col("node").alias("doc_id"), "component"), "doc_id", "left")
    component = F.coalesce("component", "doc_id")
    return out.select("doc_id", "n_shingles", component.alias("component_id"), component.eqNullSafe(F.col("doc_id")).alias("kept"))
