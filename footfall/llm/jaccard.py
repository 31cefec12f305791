"""N-gram Jaccard join: ordered n-gram sets in tries, walked with shared overlaps and length bounds.

Every text becomes the set of its word n-grams, as 64-bit hashes, in one global order: n-grams found in
many documents last, otherwise by hash. Two sets with the wanted similarity ``t`` share ``k`` of their
first ``n - ceil(t * n) + k`` n-grams, for any ``k`` up to the overlap; here an eighth of the smaller set. So

1. n-grams are counted in the tasks and per hash range, and the common ones broadcast (never more than
   ``MOST_COMMON``; they only settle the order, any choice gives the same result);
2. the leading n-grams of all sets meet per hash range; pairs under one n-gram that are near enough in
   size are counted, and those that share ``k`` get an edge. Under an n-gram with more than ``PAIRED`` sets
   only neighbours by size get one, whatever else they share. Connected components of these edges are
   clusters: linked sets share either one crowded n-gram, whose sets are chained, or ``k`` others;
3. the sets of a cluster are put into a trie and each is looked up in it: partial overlaps of shared
   beginnings are counted once, and a subtree is left as soon as what remains of the set, or of the shortest
   and longest set below, cannot reach the overlap needed. A large cluster is cut into blocks of
   ``BLOCK`` sets, and pairs of blocks are walked in tasks of their own;
4. the links leave a task as a spanning forest and as counts, never as all pairs; connected components
   of the forests are the result.

Equal sets are one set from the start, so copies cost nothing here.

Defined cases: a null or empty text has an empty set, linked with nothing; a text with fewer words than
``size`` is one n-gram, the whole sequence; repeated rows and ids are rows of their own with the same component
as any equal set; a null id sorts last when a component is named; an empty table gives no rows; other columns are
not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from footfall.llm.components import components
from footfall.llm.hashing import FINE, lean, mix, shingles, slices, words
from footfall.llm.rows import addressed, row_number, without
from footfall.operators.lookup import is_small
from footfall.session import stage

SIZE = 5
PERCENT = 75
COMMON = 24
MOST_COMMON = 1 << 22
CELL = np.uint64(32)
KEY = np.uint64(16)
FLUSH = 2_000_000
LEAST_SEGMENTS = 64
BLOCK = 512
PAIRED = 32
SURE = 1 << 40
RUN = 32

U = np.uint64


def sets_of(texts: pa.Array, size: int) -> Iterator[np.ndarray]:
    """The sorted distinct n-gram hashes of each text."""
    found = words(texts)
    hashes = found.hashes()
    grams = _all_shingles(hashes, found.first, size)
    for begin, end in zip(grams[1][:-1], grams[1][1:]):
        yield np.unique(grams[0][begin:end])


def _all_shingles(hashes: np.ndarray, first: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """n-grams of all texts at once; those that would cross an end are left out."""
    counts = np.diff(first)
    n = len(hashes)
    out = np.full(n, size, U)
    for k in range(size):
        shifted = np.zeros(n, U)
        if k < n:
            shifted[: n - k] = hashes[k:]
        out = mix(out * U(0x9E3779B97F4A7C15) + shifted)
    keep = np.ones(n, bool)
    for k in range(1, size):
        at = first[1:][counts >= k] - k
        keep[at] = False
    short = np.flatnonzero((counts > 0) & (counts < size))
    for doc in short:
        whole = hashes[first[doc] : first[doc + 1]]
        out[first[doc]] = shingles(whole, size)[0]
        keep[first[doc]] = True
    made = np.where(counts >= size, counts - size + 1, (counts > 0).astype(counts.dtype))
    return out[keep], np.concatenate(([0], np.cumsum(made)))


def signature(grams: np.ndarray) -> int:
    """One number for a set; equal sets have equal ones."""
    if not len(grams):
        return 0
    total = int(mix(grams).sum(dtype=U)) ^ len(grams) * 0x9E3779B97F4A7C15
    return int(mix(np.array([total & (2**64 - 1)], U)).view(np.int64)[0])


def pack_sorted(keys: np.ndarray) -> bytes:
    """Sorted numbers as gaps of two or four bytes, wider ones listed apart."""
    gaps = np.diff(keys, prepend=U(0))
    kind = np.uint16 if np.count_nonzero(gaps > 0xFFFF) * 12 < len(gaps) * 2 else np.uint32
    wide = np.flatnonzero(gaps > np.iinfo(kind).max)
    head = np.array([len(gaps), len(wide), np.dtype(kind).itemsize], np.int64)
    return head.tobytes() + gaps.astype(kind).tobytes() + wide.astype(np.uint32).tobytes() + gaps[wide].tobytes()


def unpack_sorted(raw: bytes) -> np.ndarray:
    n, w, item = np.frombuffer(raw, np.int64, 3)
    gaps = np.frombuffer(raw, f"u{item}", n, 24).astype(U)
    at = 24 + n * item
    gaps[np.frombuffer(raw, np.uint32, w, at)] = np.frombuffer(raw, U, w, at + 4 * w)
    return np.cumsum(gaps, dtype=U)


def _each_set(batches: Iterator[pa.RecordBatch], column: int, size: int) -> Iterator[tuple[pa.RecordBatch, list[np.ndarray]]]:
    for batch in batches:
        for begin, end in slices(batch.column(column), FINE):
            part = batch.slice(begin, end - begin)
            yield part, list(sets_of(part.column(column), size))


def _segments(values: np.ndarray, bits: int, n: int) -> np.ndarray:
    """Where each of ``n`` equal ranges begins in sorted ``values`` below ``2**bits``."""
    return np.searchsorted(values, np.arange(n + 1, dtype=object) * (1 << bits) // n)


def common_cells(texts: DataFrame, size: int, segments: int) -> np.ndarray:
    """The hash cells that hold more than ``COMMON`` n-grams of the corpus, sorted."""
    cuts = [(1 << 32) * s // segments for s in range(1, segments)]

    @lean
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []

        def flush() -> pa.RecordBatch:
            cells = np.sort(np.concatenate(held))
            held.clear()
            at = [0, *np.searchsorted(cells, np.array(cuts, U)), len(cells)]
            rows = [(s, pack_sorted(cells[a:b])) for s, (a, b) in enumerate(zip(at, at[1:])) if b > a]
            return pa.RecordBatch.from_arrays(
                [pa.array([s for s, _ in rows], pa.int32()), pa.array([c for _, c in rows], pa.binary())], names=["segment", "cells"]
            )

        for _, sets in _each_set(batches, 0, size):
            held.extend(s >> CELL for s in sets)
            if sum(map(len, held)) > FLUSH:
                yield flush()
        if sum(map(len, held)):
            yield flush()

    def total(rows: pa.Table) -> pa.Table:
        cells = np.sort(np.concatenate([unpack_sorted(r) for r in rows["cells"].to_pylist()]))
        begins = np.flatnonzero(np.concatenate(([True], cells[1:] != cells[:-1])))
        n = np.diff(np.append(begins, len(cells)))
        often = n > COMMON
        return pa.table({"cell": cells[begins][often].astype(np.int64), "n": n[often].astype(np.int64)})

    found = texts.mapInArrow(count, "segment int, cells binary").groupBy("segment").applyInArrow(total, "cell long, n long")
    found = stage(found, "jaccard-cells")
    least = COMMON
    while found.filter(F.col("n") > least).count() > MOST_COMMON:
        least *= 2
    return np.sort(found.filter(F.col("n") > least).select("cell").toArrow()["cell"].to_numpy()).astype(U)


def in_order(grams: np.ndarray, common: np.ndarray) -> np.ndarray:
    """Common n-grams last, otherwise by hash."""
    if not len(common):
        return grams
    cells = grams >> CELL
    at = np.minimum(np.searchsorted(common, cells), len(common) - 1)
    last = common[at] == cells
    return np.concatenate([grams[~last], grams[last]])


def wanted_shared(n: np.ndarray | int) -> np.ndarray | int:
    """How many leading n-grams a set shares at least with any similar set that is no smaller."""
    return np.maximum(1, n // 8)


def leading(n: int, percent: int) -> int:
    """So many first n-grams that similar sets share ``wanted_shared`` of them."""
    return min(n, n - -(-percent * n // 100) + int(wanted_shared(n)))


def needed(n: np.ndarray, m: np.ndarray, percent: int) -> np.ndarray:
    """The least intersection: ``100 * i >= percent * (n + m - i)``."""
    return -(-percent * (n + m) // (100 + percent))


def candidate_edges(texts: DataFrame, common, size: int, percent: int, segments: int) -> DataFrame:
    """``a, b``: signatures that may be linked, or that stand between two that may."""
    cuts = [(1 << 48) * s // segments for s in range(1, segments)]

    @lean
    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        often = common.value
        keys: list[np.ndarray] = []
        sets: list[tuple[int, int]] = []

        def flush() -> pa.RecordBatch:
            key = np.concatenate(keys)
            owner = np.repeat(np.arange(len(keys), dtype=np.uint32), [len(k) for k in keys])
            order = np.argsort(key, kind="stable")
            key, owner = key[order], owner[order]
            at = [0, *np.searchsorted(key, np.array(cuts, U)), len(key)]
            sigs, sizes = np.array([s for s, _ in sets], np.int64), np.array([n for _, n in sets], np.int64)
            rows = []
            for s, (a, b) in enumerate(zip(at, at[1:])):
                if b > a:
                    used, local = np.unique(owner[a:b], return_inverse=True)
                    local = local.astype(np.uint16 if len(used) <= 0xFFFF else np.uint32)
                    rows.append((s, pack_sorted(key[a:b]), local.tobytes(), sigs[used].tobytes(), sizes[used].tobytes()))
            keys.clear()
            sets.clear()
            columns = list(zip(*rows))
            return pa.RecordBatch.from_arrays(
                [pa.array(columns[0], pa.int32()), *(pa.array(c, pa.binary()) for c in columns[1:])],
                names=["segment", "keys", "owners", "sigs", "sizes"],
            )

        held: set[int] = set()
        for _, found in _each_set(batches, 0, size):
            for grams in found:
                sig = signature(grams)
                if len(grams) and sig not in held:
                    held.add(sig)
                    keys.append(in_order(grams, often)[: leading(len(grams), percent)] >> KEY)
                    sets.append((sig, len(grams)))
            if sum(map(len, keys)) > FLUSH:
                yield flush()
                held.clear()
        if keys:
            yield flush()

    def meet(rows: pa.Table) -> pa.Table:
        key, sig, n = [], [], []
        for k, o, s, z in zip(*(rows[c].to_pylist() for c in ("keys", "owners", "sigs", "sizes"))):
            k, s = unpack_sorted(k), np.frombuffer(s, np.int64)
            o = np.frombuffer(o, np.uint16 if len(s) <= 0xFFFF else np.uint32)
            key.append(k)
            sig.append(s[o])
            n.append(np.frombuffer(z, np.int64)[o])
        key, sig, n = np.concatenate(key), np.concatenate(sig), np.concatenate(n)
        begins = np.unique(key, return_inverse=True)[1]
        keep = np.bincount(begins)[begins] > 1
        key, sig, n = key[keep], sig[keep], n[keep]
        order = np.lexsort((sig, n, key))
        key, sig, n = key[order], sig[order], n[order]
        fresh = np.ones(len(key), bool)  # a set that came from several tasks counts once
        fresh[1:] = (key[1:] != key[:-1]) | (sig[1:] != sig[:-1])
        key, sig, n = key[fresh], sig[fresh], n[fresh]
        group = np.unique(key, return_inverse=True)[1]
        crowded = (np.bincount(group)[group] > PAIRED) if len(group) else np.zeros(0, bool)
        names, local = np.unique(sig, return_inverse=True)
        pairs, chained = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
        for step in range(1, PAIRED):
            same = (key[step:] == key[:-step]) & (100 * n[:-step] >= percent * n[step:])
            same &= ~crowded[step:] if step > 1 else True
            if not (key[step:] == key[:-step]).any():
                break
            x, y = local[:-step][same], local[step:][same]
            once = np.minimum(x, y) * len(names) + np.maximum(x, y)
            sure = crowded[step:][same]
            pairs.append(once[~sure])
            chained.append(once[sure])
        pairs, shared = np.unique(np.concatenate(pairs + chained), return_counts=True)
        shared = np.where(np.isin(pairs, np.concatenate(chained)), SURE, shared)
        size_of = np.zeros(len(names), np.int64)
        size_of[local] = n
        x, y = pairs // max(len(names), 1), pairs % max(len(names), 1)
        least = wanted_shared(np.minimum(size_of[x], size_of[y]))
        return pa.table({"a": names[x], "b": names[y], "shared": shared.astype(np.int64), "least": least})

    schema = "segment int, keys binary, owners binary, sigs binary, sizes binary"
    found = texts.mapInArrow(emit, schema).groupBy("segment").applyInArrow(meet, "a long, b long, shared long, least long")
    return found.groupBy("a", "b").agg(F.sum("shared").alias("shared"), F.first("least").alias("least")).filter("shared >= least").select("a", "b")


class Trie:
    """Ordered sets as runs of elements; a run ends where sets part, where one ends, or after ``RUN`` elements."""

    def __init__(self, sets: list[np.ndarray]):
        # Elements are numbered in the global order, so sets sort and compare as tuples of numbers.
        self.elements = np.unique(np.concatenate(sets)) if sets else np.empty(0, U)
        paths = [np.searchsorted(self.elements, s).astype(np.int32) for s in sets]
        order = sorted(range(len(sets)), key=lambda i: paths[i].astype(">i4").tobytes())
        self.sizes = np.array([len(s) for s in sets], np.int64)
        first, parent, begin, end, depth, low, high, self.level = [], [], [], [], [], [], [], []
        values: list[np.ndarray] = []
        total = 0
        leaves: list[tuple[int, int]] = []
        level = [(0, len(order), 0, -1)] if order else []
        while level:
            made = []
            self.level.append(len(first))
            for lo, hi, at, up in level:
                i = lo
                while i < hi:
                    path = paths[order[i]]
                    if len(path) <= at:
                        leaves.append((up, order[i]))
                        i += 1
                        continue
                    head = path[at]
                    j = i + 1
                    while j < hi and paths[order[j]][at] == head:
                        j += 1
                    other = paths[order[j - 1]]
                    most = min(len(path), len(other), at + RUN)
                    differs = np.flatnonzero(path[at:most] != other[at:most])
                    stop = at + int(differs[0]) if len(differs) else most
                    # A shorter set between the two ends where the run must end.
                    stop = min([stop, *(len(paths[order[k]]) for k in range(i, j))])
                    sizes = self.sizes[[order[k] for k in range(i, j)]]
                    values.append(path[at:stop])
                    parent.append(up)
                    begin.append(total)
                    total += stop - at
                    depth.append(stop)
                    low.append(sizes.min())
                    high.append(sizes.max())
                    made.append((i, j, stop, len(first)))
                    first.append(head)
                    i = j
            level = made
        self.values = np.concatenate(values) if values else np.empty(0, np.int32)
        self.parent, self.begin = np.array(parent, np.int64), np.array(begin, np.int64)
        self.end = np.append(self.begin[1:], total)
        self.depth, self.low, self.high = (np.array(x, np.int64) for x in (depth, low, high))
        children = np.argsort(self.parent, kind="stable")
        self.children = children
        self.child_from = np.searchsorted(self.parent[children], np.arange(-1, len(first)))
        self.child_to = np.searchsorted(self.parent[children], np.arange(-1, len(first)), "right")
        at = np.array([a for a, _ in leaves], np.int64)
        by = np.argsort(at, kind="stable")
        self.leaf_at, self.leaf_set = at[by], np.array([s for _, s in leaves], np.int64)[by]

    def look_up(self, grams: np.ndarray, percent: int) -> np.ndarray:
        """The stored sets that are similar enough to the ordered set ``grams``."""
        n = len(grams)
        at = np.searchsorted(self.elements, grams)
        at[at == len(self.elements)] = 0
        own = at[self.elements[at] == grams] if len(self.elements) else at[:0]
        member = np.zeros(len(self.elements), bool)
        member[own] = True
        nodes, overlap = np.array([-1]), np.array([0])
        found, shared = [], []
        while True:
            a, b = self.child_from[nodes + 1], self.child_to[nodes + 1]
            width = b - a
            if not width.sum():
                break
            place = np.repeat(a - np.cumsum(width) + width, width) + np.arange(width.sum())
            overlap = np.repeat(overlap, width)
            nodes = self.children[place]
            length = self.end[nodes] - self.begin[nodes]
            where = np.repeat(self.begin[nodes] - np.cumsum(length) + length, length) + np.arange(length.sum())
            hits = member[self.values[where]]
            overlap = overlap + np.add.reduceat(hits, np.cumsum(length) - length, dtype=np.int64)
            # Elements still to come: on the path down, and of the looked-up set behind this run's last one.
            behind = len(own) - np.searchsorted(own, self.values[self.end[nodes] - 1], "right")
            reach = overlap + np.minimum(self.high[nodes] - self.depth[nodes], behind)
            alive = (reach >= needed(n, self.low[nodes], percent)) & (100 * self.low[nodes] <= 100 * 100 * n // percent + 99)
            alive &= 100 * self.high[nodes] >= percent * n
            nodes, overlap = nodes[alive], overlap[alive]
            lo, hi = np.searchsorted(self.leaf_at, nodes), np.searchsorted(self.leaf_at, nodes, "right")
            ends = hi - lo
            found.append(np.repeat(lo - np.cumsum(ends) + ends, ends) + np.arange(ends.sum()))
            shared.append(np.repeat(overlap, ends))
        which = self.leaf_set[np.concatenate(found)] if found else np.empty(0, np.int64)
        shared = np.concatenate(shared) if shared else np.empty(0, np.int64)
        return which[shared >= needed(n, self.sizes[which], percent)]


def _forest(n: int, links: Iterator[tuple[int, np.ndarray]]) -> tuple[list[tuple[int, int]], np.ndarray]:
    """Edges that join what the links join, and the number of links of each."""
    up, edges, degree = list(range(n)), [], np.zeros(n, np.int64)

    def root(x: int) -> int:
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    for i, others in links:
        for j in others.tolist():
            if i != j:
                degree[i] += 1
                a, b = root(i), root(j)
                if a != b:
                    up[a] = b
                    edges.append((i, j))
    return edges, degree


def linked_sets(members: DataFrame, size: int, percent: int, common) -> DataFrame:
    """``a, b, links`` from ``task, side, sig, text``: forest edges, and a row ``a, null, links`` per set."""

    def walk(rows: pa.Table) -> pa.Table:
        sigs, sides = rows["sig"].to_numpy(), rows["side"].to_numpy()
        grams: list[np.ndarray] = []
        for begin, end in slices(rows["text"], FINE):
            grams.extend(sets_of(rows["text"].combine_chunks().slice(begin, end - begin), size))
        # Common n-grams last: their numbers get the highest place in the order.
        often = common.value
        every = np.unique(np.concatenate(grams))
        rank = np.empty(len(every), np.int64)
        ordered = in_order(every, often)
        rank[np.searchsorted(every, ordered)] = np.arange(len(every))
        grams = [np.sort(rank[np.searchsorted(every, g)]).astype(U) for g in grams]
        stored, asked = np.flatnonzero(sides != 1), np.flatnonzero(sides != 0)
        trie = Trie([grams[i] for i in stored])
        crossed = bool((sides == 1).any())
        links = ((int(i), stored[trie.look_up(grams[i], percent)]) for i in asked)
        edges, degree = _forest(len(sigs), _both(links) if crossed else links)
        a = [sigs[i] for i, _ in edges] + list(sigs)
        b = [sigs[j] for _, j in edges] + [None] * len(sigs)
        n = [0] * len(edges) + degree.tolist()
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64()), "links": pa.array(n, pa.int64())})

    return members.groupBy("task").applyInArrow(walk, "a long, b long, links long")


def _both(links: Iterator[tuple[int, np.ndarray]]) -> Iterator[tuple[int, np.ndarray]]:
    """Between two blocks a link is found from one side only; count it for both."""
    for i, others in links:
        yield i, others
        for j in others.tolist():
            yield j, np.array([i])


def similar_documents(
    docs: DataFrame, size: int = SIZE, percent: int = PERCENT, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """``row, id, root, n_shingles, component_id, n_links`` of every row.

    ``root`` tells components apart, whatever the ids: the signature of one set in each (rows without n-grams
    are components of their own and share a root that means nothing). ``n_links`` counts the other distinct sets that are similar enough; rows with an equal set are linked as well
    and not counted. ``component_id`` is the smallest id that links lead to.
    """
    spark = docs.sparkSession
    docs = addressed(docs)
    texts = docs.select(F.col(text_col).alias("text"))

    @lean
    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, sets in _each_set(batches, 2, size):
            yield pa.RecordBatch.from_arrays(
                [part.column(0), part.column(1), pa.array([len(s) for s in sets], pa.int64()), pa.array([signature(s) for s in sets], pa.int64())],
                names=["row", "id", "n", "sig"],
            )

    source = docs.select(row_number().alias("row"), F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    known = stage(source.mapInArrow(describe, "row long, id long, n long, sig long"), "jaccard-rows")
    grams = known.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    segments = LEAST_SEGMENTS
    while segments * FLUSH * 2 < grams:
        segments *= 2

    common = spark.sparkContext.broadcast(common_cells(texts, size, segments))
    edges = stage(candidate_edges(texts, common, size, percent, segments), "jaccard-candidates")
    clusters = components(edges)

    # One row per distinct set that has a candidate, and its place in the cluster.
    first = known.filter("n > 0").groupBy("sig").agg(F.min("row").alias("row"), F.first("n").alias("n"))
    placed = first.join(clusters, first.sig == clusters.v).select("row", "sig", "n", "root")
    placed = stage(_numbered(placed), "jaccard-members")
    wanted = F.broadcast(placed.select("row")) if is_small(placed.select("row")) else placed.select("row")
    held = source.select("row", "text").join(wanted, "row").join(placed.select("row", "sig", "root", "block", "blocks"), "row")
    tasks = F.transform(
        F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1),
        lambda k: F.struct(
            F.least(k, "block").alias("i"), F.greatest(k, "block").alias("j"),
            F.when(k == F.col("block"), F.lit(-1)).when(F.col("block") < k, F.lit(0)).otherwise(F.lit(1)).alias("side"),
        ),
    )
    spread = held.select("sig", "text", "root", F.explode(tasks).alias("t")).select(
        F.xxhash64("root", "t.i", "t.j").alias("task"), F.col("t.side").alias("side"), "sig", "text"
    )
    links = stage(linked_sets(spread, size, percent, common), "jaccard-links")
    joined = components(links.filter("b IS NOT NULL").select("a", "b"))
    counted = links.groupBy(F.col("a").alias("sig")).agg(F.sum("links").alias("n_links"))

    own = known.join(joined, (known.sig == joined.v) & (known.n > 0), "left").select(
        "row", "id", "n", "sig", F.coalesce("root", F.col("sig")).alias("root")
    )
    lowest = own.filter("n > 0").groupBy("root").agg(F.min("id").alias("lowest"))
    return (
        own.join(lowest, "root", "left").join(counted, "sig", "left")
        .select(
            "row", "id", "root", F.col("n").alias("n_shingles"),
            F.when(F.col("n") > 0, F.coalesce("lowest", "id")).otherwise(F.col("id")).alias("component_id"),
            F.when(F.col("n") > 0, F.coalesce("n_links", F.lit(0))).otherwise(F.lit(0)).cast("long").alias("n_links"),
        )
    )


def _numbered(placed: DataFrame) -> DataFrame:
    """``block`` and ``blocks`` of a cluster: sets of like size together, at most about ``BLOCK`` in each."""
    sizes = placed.groupBy("root").agg(F.count("*").alias("members"))
    blocks = F.ceil(F.col("members") / BLOCK)
    return placed.join(sizes, "root").withColumn("blocks", blocks).withColumn("block", F.pmod(F.xxhash64("sig"), F.col("blocks")))


def first_of_each(docs: DataFrame, id_col: str = "doc_id", **options) -> DataFrame:
    """The rows of ``docs`` with one document of each component: the smallest id, then any one of its rows."""
    docs = addressed(docs)
    found = similar_documents(docs, id_col=id_col, **options).filter("n_shingles > 0").select("row", "id", "root")
    repeated = found.groupBy("root").agg(
        F.min(F.struct(F.col("id").isNull(), "id", "row")).alias("keep"), F.count("*").alias("n")
    ).filter("n > 1")
    dropped = stage(found.join(repeated, "root").filter("row <> keep.row").select("row"), "jaccard-dropped")
    return without(docs, dropped)
