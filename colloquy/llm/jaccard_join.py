"""Exact Jaccard join of documents by their word n-gram sets.

Two documents link when ``denominator * |A & B| >= numerator * |A | B|``.
The result is one row per document with its set size and the least id that
links reach; copies are never expanded into pairs.

1. Documents with equal sets are one node, named by the least id.
2. The elements have one global order: the rarest first, by the frequency of
   their bucket in a table of fixed size that counts all documents, then by
   hash. Of a set of size s only the first ``s - ceil(t * s) + 1`` elements can
   be the first common element of a link at threshold t (the prefix principle;
   it holds for any order, so sharing a bucket costs work and no link). Nodes
   that share such an element are a group.
3. Every node meets the least node of each of its groups, and the links found
   are joined to components. A group that is one component is settled: a group
   of thousands of near copies costs a link or two each and not all pairs.
4. In every other group those outside of its largest component meet all its
   members, once for all groups with the same members or, up to the size of a
   slice, the same least member. Then any two nodes that
   could link have met or are connected already, so no link is lost.

Before sets meet, their sketches do: the numbers of elements in 256 parts of the
hash space. Two sets differ in at least as many elements as the sketches do, so
a pair whose sketches differ too much for the threshold is ruled out exactly,
at a fraction of the traffic of the sets.

Nodes meet in prefix trees: one side's sets, globally ordered, go into a tree;
the other side's sets walk it, share the overlap of common prefixes, and leave
a subtree as soon as the lengths that remain rule out a link with everything
below. Who is connected already is passed over. Both sides of a large group
are dealt into slices of bounded size that meet in separate tasks.

Defined results: a null or empty text has an empty set and no links, not even
with another one; a text with fewer words than n is one element; rows that
repeat an id are one document (the union of their links, the largest set); a
null id is no document. Hashes are of 64 bits, pairs of them name sets.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Workspace, gram_hashes, mix, saved, shuffled, signed, tidied, within, word_hashes
from .components import connected_components

SLICE = 1000  # sets on one side of a task
PARTS = 256  # of a sketch
BUCKETS = 1 << 24  # of the table of n-gram frequencies; a byte each is broadcast
RUN = 1 << 14  # buckets that are summed together
HELD = 1 << 20  # n-grams that a task holds before it counts them


def gram_sets(col: pa.Array, n: int) -> Iterator[np.ndarray]:
    """The sorted set of n-gram hashes of each text."""
    for lo, hi, words, bounds in word_hashes(col, lower=True):
        grams = gram_hashes(words, n)
        for i in range(hi - lo):
            a, b = int(bounds[i]), int(bounds[i + 1])
            if b - a >= n:
                yield np.unique(grams[a:b - n + 1])
            else:
                yield gram_hashes(words[a:b], b - a) if b > a else words[:0]


def frequency_levels(texts: DataFrame, n: int) -> np.ndarray:
    """How frequent the n-grams of each bucket are in all of ``texts(id, text)``:
    the logarithm of the number of sets, in steps of an eighth. The table has
    the same size for any input; tasks count on their own and send what is not
    zero, and the sums are streamed, a run of buckets after the other."""

    def pack(own: np.ndarray, at: np.ndarray) -> tuple[bytes, bytes]:
        """Places and counts of what is not zero, or all counts and no places
        if that is shorter; counts in as many bytes as the largest needs."""
        narrow = own.astype(np.min_scalar_type(own.max()))
        if len(at) * (2 + narrow.itemsize) < RUN * narrow.itemsize:
            return at.astype(np.uint16).tobytes(), narrow[at].tobytes()
        return b"", narrow.tobytes()

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, held, size = np.zeros(BUCKETS, np.uint32), [np.zeros(0, np.uint32)], 0

        def flush() -> None:
            at, times = np.unique(np.concatenate(held), return_counts=True)
            counts[at] += times.astype(np.uint32)

        for b in batches:
            for g in gram_sets(b.column(1), n):
                held.append((g % np.uint64(BUCKETS)).astype(np.uint32))
                size += len(g)
                if size >= HELD:
                    flush()
                    held, size = [], 0
        if size:
            flush()
        at = np.flatnonzero(counts)
        ends = np.searchsorted(at, np.arange(0, BUCKETS + 1, RUN))
        used = np.flatnonzero(np.diff(ends))
        for some in np.array_split(used, max(1, len(used) // 64)):
            packed = [pack(counts[k * RUN:(k + 1) * RUN], at[ends[k]:ends[k + 1]] - k * RUN) for k in some]
            yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array([x for x, _ in packed], pa.binary()),
                                              pa.array([x for _, x in packed], pa.binary())], ["run", "place", "times"])

    def total(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for b in batches:
            for k, place, times in zip(*(b.column(c).to_pylist() for c in ("run", "place", "times"))):
                own = sums.setdefault(k, np.zeros(RUN, np.int64))
                at = np.frombuffer(place, np.uint16) if place else slice(None)
                own[at] += np.frombuffer(times, f"u{len(times) // (len(place) // 2 or RUN)}")
        levels = [np.minimum(8 * np.log2(x + 1), 255).astype(np.uint8).tobytes() for x in sums.values()]
        yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array(levels, pa.binary())], ["run", "levels"])

    counted = texts.mapInArrow(tidied(count), "run int, place binary, times binary").repartition("run")
    found = counted.mapInArrow(tidied(total), "run int, levels binary").toArrow()
    out = np.zeros(BUCKETS, np.uint8)
    for k, levels in zip(found.column("run").to_pylist(), found.column("levels").to_pylist()):
        out[k * RUN:(k + 1) * RUN] = np.frombuffer(levels, np.uint8)
    return out


def ordered(grams: np.ndarray, levels: np.ndarray) -> np.ndarray:
    """A sorted set in the global order: by the level of its bucket, then by hash."""
    level = levels[(grams % np.uint64(len(levels))).astype(np.int64)]
    return grams[np.argsort(level, kind="stable")]


def prefix_length(size: int, numerator: int, denominator: int) -> int:
    return size + (-size * numerator // denominator) + 1


def sketch(grams: np.ndarray) -> bytes:
    counts = np.bincount((grams >> np.uint64(40)).astype(np.int64) % PARTS, minlength=PARTS)
    return np.minimum(counts, 255).astype(np.uint8).tobytes()


def may_link(a: np.ndarray, b: np.ndarray, numerator: int, denominator: int) -> np.ndarray:
    """Whether sets can link, by their (size, sketch) as rows of integers."""
    differ = np.abs(a[..., 1:] - b[..., 1:]).sum(axis=-1)
    sizes = a[..., 0] + b[..., 0]
    near = np.maximum(a[..., 0], b[..., 0]) * numerator <= np.minimum(a[..., 0], b[..., 0]) * denominator
    return near & (differ * (denominator + numerator) <= (denominator - numerator) * sizes)


def _rows(t: pa.Table | pa.RecordBatch, size: str, sketch_: str) -> np.ndarray:
    """(size, sketch) of a table's rows as one array of integers."""
    out = np.empty((t.num_rows, PARTS + 1), np.int64)
    out[:, 0] = t.column(size).to_numpy()
    out[:, 1:] = np.frombuffer(b"".join(t.column(sketch_).to_pylist()), np.uint8).reshape(-1, PARTS)
    return out


class Tree:
    """Prefix tree of sorted sets; a node holds a run of elements (a path
    without branches is one node)."""

    def __init__(self) -> None:
        # node: [elements, children by first element, names that end here, least and largest size below]
        self.root: list = [np.zeros(0, np.uint64), {}, [], 1 << 60, 0]

    def add(self, name: int, elements: np.ndarray) -> None:
        node, rest = self.root, elements
        while True:
            node[3], node[4] = min(node[3], len(elements)), max(node[4], len(elements))
            if not len(rest):
                node[2].append(name)
                return
            child = node[1].get(int(rest[0]))
            if child is None:
                node[1][int(rest[0])] = [rest, {}, [name], len(elements), len(elements)]
                return
            m = min(len(child[0]), len(rest))
            differ = np.flatnonzero(child[0][:m] != rest[:m])
            m = int(differ[0]) if len(differ) else m
            if m < len(child[0]):  # the path branches inside the run
                tail = [child[0][m:], child[1], child[2], child[3], child[4]]
                child[0], child[1], child[2] = child[0][:m], {int(tail[0][0]): tail}, []
            node, rest = child, rest[m:]

    def linked(self, elements: np.ndarray, numerator: int, denominator: int,
               skip: Callable[[int], bool]) -> Iterator[int]:
        """Names of the sets that link with ``elements``; ``skip(name)``
        passes over a set."""
        size, sorted_ = len(elements), np.sort(elements)
        # a partner's size lies in these limits
        fewest, most = -(-size * numerator // denominator), size * denominator // numerator
        stack = [(self.root, 0, 0)]
        while stack:
            (run, children, names, least, largest), depth, shared = stack.pop()
            if largest < fewest or least > most:
                continue
            if len(run):
                at = np.minimum(np.searchsorted(sorted_, run), size - 1)
                shared += int((sorted_[at] == run).sum())
                depth += len(run)
            # if all that remains below is shared, is the overlap enough for the smallest partner?
            top = min(size, shared + min(largest, most) - depth)
            if denominator * top < numerator * (size + max(least, fewest, top) - top):
                continue
            for name in names:
                if denominator * shared >= numerator * (size + depth - shared) and not skip(name):
                    yield name
            stack.extend((child, depth, shared) for child in children.values())


def forest(pivots: list[tuple[int, int, np.ndarray]], others: list[tuple[int, int, np.ndarray]], numerator: int,
           denominator: int) -> list[tuple[int, int]]:
    """Links from the others to the pivots, as many as connect what links
    connect. Sets come as (name, component known so far, elements)."""
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        while parent.setdefault(x, x) != x:
            parent[x] = x = parent[parent[x]]
        return x

    tree, out, component = Tree(), [], {n: c for n, c, _ in (*pivots, *others)}
    for name, _, elements in pivots:
        tree.add(name, elements)
    for name, own, elements in others:
        for found in tree.linked(elements, numerator, denominator, lambda x, c=own: root(component[x]) == root(c)):
            parent[root(component[found])] = root(own)
            out.append((name, found))
    return out


class Join:
    """The steps of the join for one n, threshold and global order."""

    def __init__(self, texts: DataFrame, n: int, numerator: int, denominator: int) -> None:
        self.texts, self.n, self.numerator, self.denominator = texts, n, numerator, denominator
        self.levels = texts.sparkSession.sparkContext.broadcast(frequency_levels(texts, n))

    def prefixes(self) -> DataFrame:
        """(id, size, k1, k2, prefix, sketch) of each text; k1 and k2 name its set."""
        n, numerator, denominator, levels = self.n, self.numerator, self.denominator, self.levels

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                size, k1, k2, prefix, sketches = [], [], [], [np.zeros(0, np.int64)], []
                for g in gram_sets(b.column(1), n):
                    size.append(len(g))
                    sketches.append(sketch(g))
                    sums = np.array([mix(g).sum(), np.bitwise_xor.reduce(mix(g + np.uint64(7)))], np.uint64)
                    for k, v in zip((k1, k2), signed(mix(sums)).tolist()):
                        k.append(v)
                    prefix.append(signed(ordered(g, levels.value)[:prefix_length(len(g), numerator, denominator)]) if len(g) else prefix[0])
                ends = np.cumsum([len(p) for p in prefix])
                lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(prefix)))
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(size, pa.int64()), pa.array(k1, pa.int64()),
                                                  pa.array(k2, pa.int64()), lists, pa.array(sketches, pa.binary())],
                                                 ["id", "size", "k1", "k2", "prefix", "sketch"])

        return self.texts.mapInArrow(tidied(run), "id long, size long, k1 long, k2 long, prefix array<long>, sketch binary")

    def likely(self, pairs: DataFrame) -> DataFrame:
        """The rows of ``pairs(size, sketch, size2, sketch2, ...)`` that may link."""
        numerator, denominator = self.numerator, self.denominator

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                yield b.filter(pa.array(may_link(_rows(b, "size", "sketch"), _rows(b, "size2", "sketch2"), numerator, denominator)))

        return pairs.mapInArrow(tidied(run), pairs.schema)

    def survivors(self, rows: DataFrame) -> DataFrame:
        """(gram, id) of ``rows(group, i, j, id, component, pivot, size, sketch)``
        that may link with a row of the other side in another component."""
        numerator, denominator = self.numerator, self.denominator

        def run(t: pa.Table) -> pa.Table:
            x, own = _rows(t, "size", "sketch"), t.column("component").to_numpy()
            pivot = t.column("pivot").to_numpy(zero_copy_only=False).astype(bool)
            good = np.zeros(t.num_rows, bool)
            for rows in _by_group(t):
                a, b = rows[pivot[rows]], rows[~pivot[rows]]
                b = b[np.argsort(x[b, 0], kind="stable")]
                sizes = x[b, 0]
                lo = np.searchsorted(sizes, -(-x[a, 0] * numerator // denominator), "left")
                hi = np.searchsorted(sizes, x[a, 0] * denominator // numerator, "right")
                for i, first, end in zip(a.tolist(), lo.tolist(), hi.tolist()):
                    near = b[first:end]
                    near = near[own[near] != own[i]]
                    if len(near):
                        near = near[may_link(x[near], x[i], numerator, denominator)]
                        good[near] = True
                        good[i] |= len(near) > 0
            return t.select(["group", "id"]).filter(pa.array(good))

        bundled = rows.withColumn("bundle", F.pmod(F.xxhash64("group"), F.lit(max(1, -(-rows.count() // (8 * SLICE))))))
        return bundled.groupBy("bundle", "i", "j").applyInArrow(run, "group long, id long").distinct().withColumnRenamed("group", "gram")

    def sets(self, ids: DataFrame) -> DataFrame:
        """(id, grams) of some nodes."""
        n, levels = self.n, self.levels

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                found = [signed(ordered(g, levels.value)) for g in gram_sets(b.column(1), n)]
                ends = np.cumsum([0, *(len(g) for g in found)])
                yield pa.RecordBatch.from_arrays([b.column(0), pa.ListArray.from_arrays(
                    pa.array(ends, pa.int32()), pa.array(np.concatenate([np.zeros(0, np.int64), *found])))], ["id", "grams"])

        return self.texts.join(ids, "id", "left_semi").mapInArrow(tidied(run), "id long, grams array<long>")

    def meet(self, pairs: DataFrame, sets: DataFrame) -> DataFrame:
        """Links (a, b) of the sets that meet in each slice of each group:
        ``pairs(group, i, j, id, component, pivot)``."""
        numerator, denominator = self.numerator, self.denominator

        def run(t: pa.Table) -> pa.Table:
            grams = t.column("grams").combine_chunks()
            ends, flat = grams.offsets.to_numpy(), grams.values.to_numpy().view(np.uint64)
            name, own, pivot = (t.column(c).to_pylist() for c in ("id", "component", "pivot"))
            found = []
            for rows in _by_group(t):
                two: tuple[list, list] = ([], [])
                for i in rows.tolist():
                    two[not pivot[i]].append((name[i], own[i], flat[ends[i]:ends[i + 1]]))
                found += forest(*two, numerator, denominator)
            return pa.table({"a": pa.array([x for x, _ in found], pa.int64()), "b": pa.array([x for _, x in found], pa.int64())})

        # the bundles are counted on the narrow rows
        bundles = max(1, -(-pairs.count() // SLICE))
        dealt = pairs.withColumn("bundle", F.pmod(F.xxhash64("group"), F.lit(bundles))).join(sets, "id")
        return dealt.groupBy("bundle", "i", "j").applyInArrow(run, "a long, b long")


def _by_group(t: pa.Table) -> list[np.ndarray]:
    """Places of the rows of each group."""
    group = t.column("group").to_numpy()
    order = np.argsort(group, kind="stable")
    return np.split(order, np.flatnonzero(np.diff(group[order])) + 1) if len(order) else []


def _distinct(told: DataFrame) -> DataFrame:
    """The groups of ``told(gram, id, component, ...)`` that are of several
    components, one for all groups with the same members."""
    groups = told.groupBy("gram").agg(F.count("*").alias("n"), F.sum(F.xxhash64("id").cast("decimal(38,0)")).alias("k"),
                                      F.min("component").alias("lo"), F.max("component").alias("hi"))
    return told.join(shuffled(groups.where("lo < hi").groupBy("n", "k").agg(F.min("gram").alias("gram")).select("gram")), "gram")


def _merged(told: DataFrame) -> DataFrame:
    """The groups of ``told(gram, id, ...)``, those with the same least node as
    one if it fits into a slice: texts that share a passage share many grams,
    and their sets then travel once and not once a gram."""
    least = told.join(shuffled(told.groupBy("gram").agg(F.min("id").alias("least"))), "gram")
    united = least.drop("gram").dropDuplicates(["least", "id"])
    sizes = united.groupBy("least").agg(F.count("*").alias("n"))
    joined = united.join(shuffled(sizes.where(F.col("n") <= SLICE).select("least")), "least")
    apart = least.join(shuffled(sizes.where(F.col("n") > SLICE).select("least")), "least")
    rest = [c for c in told.columns if c != "gram"]
    return joined.select(F.xxhash64("least").alias("gram"), *rest).union(apart.select("gram", *rest)).dropDuplicates(["gram", "id"])


def _dealt(told: DataFrame) -> DataFrame:
    """Rows ``told(gram, id, component, ...)`` of groups, dealt to tasks (group,
    i, j): those outside of a group's largest component as pivots in slice i,
    all of its rows as others in slice j."""
    counts = told.groupBy("gram", "component").agg(F.count("*").alias("own"))
    main = counts.groupBy("gram").agg(F.max(F.struct("own", "component")).alias("top"), F.sum("own").alias("all"))
    told = told.join(shuffled(main), "gram")
    rest = [c for c in told.columns if c not in ("gram", "top", "all")]
    ways, ways_in = F.ceil(F.col("all") / SLICE).cast("int"), F.ceil((F.col("all") - F.col("top.own")) / SLICE).cast("int")
    every = lambda x: F.explode(F.sequence(F.lit(0), x - 1))
    at = lambda x: F.pmod(F.xxhash64("id"), x).cast("int")
    inner = told.where(F.col("component") != F.col("top.component")).select(
        F.col("gram").alias("group"), at(ways_in).alias("i"), every(ways).alias("j"), *rest, F.lit(True).alias("pivot"))
    outer = told.where(ways_in > 0).select(
        F.col("gram").alias("group"), every(ways_in).alias("i"), at(ways).alias("j"), *rest, F.lit(False).alias("pivot"))
    return inner.union(outer)


def similar(docs: DataFrame, n: int = 5, numerator: int = 80, denominator: int = 100, by: str = "doc_id",
            text: str = "text") -> DataFrame:
    """(id, n_shingles, component_id) of every document."""
    with Workspace(docs.sparkSession, "jaccard") as ws:
        join = Join(docs.where(F.col(by).isNotNull()).select(F.col(by).cast("long").alias("id"), F.col(text).alias("text")),
                    n, numerator, denominator)
        made = ws.saved(join.prefixes(), "prefixes")
        # equal sets are one node
        nodes = made.where("size > 0").groupBy("size", "k1", "k2").agg(F.min("id").alias("node"))
        member = ws.saved(made.where("size > 0").select("id", "size", "k1", "k2").join(nodes, ["size", "k1", "k2"]).select("id", "node", "size"), "member")
        copies = member.groupBy("id").agg(F.max(F.col("id") == F.col("node")).alias("head")).where("not head").select("id")
        # groups: nodes that share an element of their prefixes
        one = Window.partitionBy("gram")
        posted = made.where("size > 0").join(within(copies), "id", "left_anti").select("id", "size", F.explode("prefix").alias("gram"))
        # without a neighbour of fitting size in the order of sizes there is no partner
        by_size = one.orderBy("size", "id")
        posted = posted.withColumn("below", F.lag("size").over(by_size)).withColumn("above", F.lead("size").over(by_size))
        posted = posted.where((F.col("size") * numerator <= F.col("below") * denominator) | (F.col("above") * numerator <= F.col("size") * denominator))
        grouped = ws.saved(posted.withColumn("least", F.min(F.struct("id", "size")).over(one)).select("gram", "id", "size", "least"), "groups")
        sketches = made.select("id", "size", "sketch").groupBy("id", "size").agg(F.min("sketch").alias("sketch"))

        # every node meets the least node of its groups
        fits = F.col("size") * numerator <= F.col("least.size") * denominator
        fits &= F.col("least.size") * numerator <= F.col("size") * denominator
        stars = grouped.where(fits & (F.col("id") != F.col("least.id"))).select(
            "id", "size", F.col("least.id").alias("hub"), F.col("least.size").alias("size2")).distinct()
        hubs = sketches.select(F.col("id").alias("hub"), F.col("size").alias("size2"), F.col("sketch").alias("sketch2"))
        stars = ws.saved(join.likely(stars.join(sketches, ["id", "size"]).join(hubs, ["hub", "size2"])).select("hub", "id"), "stars")
        sized = stars.join(stars.groupBy("hub").agg(F.count("*").alias("n")), "hub").withColumn(
            "slice", F.pmod(F.xxhash64("id"), F.ceil(F.col("n") / SLICE)).cast("int"))
        place = [F.col("hub").alias("group"), F.lit(0).alias("i"), F.col("slice").alias("j")]
        tasks = ws.saved(sized.select(*place, "id", F.lit(False).alias("pivot"))
                      .union(sized.select(*place, F.col("hub").alias("id"), F.lit(True).alias("pivot")).distinct())
                      .withColumn("component", F.col("id")), "tasks")
        links = ws.saved(join.meet(tasks, join.sets(tasks.select("id").distinct())), "links")
        parts = connected_components(links, ws.saved).withColumnRenamed("node", "id")

        # groups of several components: once for all groups with the same members
        told = grouped.select("gram", "id", "size").join(parts, "id", "left").withColumn("component", F.coalesce("component", "id"))
        told = ws.saved(_merged(ws.saved(_distinct(told), "several")), "open")
        rows = ws.saved(join.survivors(ws.saved(_dealt(told).join(sketches, ["id", "size"]), "dealt")), "survivors")
        left = ws.saved(_distinct(ws.saved(told.drop("size").join(shuffled(rows), ["gram", "id"]), "kept")), "left")
        more = ws.saved(_dealt(left), "dealt")
        links = ws.saved(join.meet(more, join.sets(more.select("id").distinct())), "links")

        # the components so far stand for their links; equal sets hang together too
        known = parts.select(F.col("id").alias("a"), F.col("component").alias("b"))
        whole = connected_components(links.union(known).union(member.where("id <> node").select(F.col("id").alias("a"), F.col("node").alias("b"))), ws.saved)
        sizes = made.groupBy("id").agg(F.max("size").alias("n_shingles"))
        found = saved(sizes.join(whole.withColumnRenamed("node", "id"), "id", "left").select(
            "id", "n_shingles", F.coalesce("component", "id").alias("component_id")), "similar")
        join.levels.destroy()  # read by nothing that is left
        return found
