"""Near-duplicate documents: an LSH forest over MinHash orders, confirmed on full shingle sets.

Every distinct shingle set has a path of six MinHash values in each of several trees. Sets
with a common prefix of three values in a tree are neighbours in that tree's sorted order, a
region. A linked pair misses all trees' regions with a chance below 10^-6. Regions with too
many sets for one task are followed down to the depth where they are small enough; what
that links is then one component, and only sets of different components are compared across
the region, in blocks.

Sets travel only to regions where their signatures, short and of fixed size, show a pair
that may be similar, and a pair is compared in the first tree in which it meets.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from glyphist.llm.components import components
from glyphist.llm.repeated_passages import text_key, with_key
from glyphist.llm.steps import Steps
from glyphist.llm.texts import all_slices, constants, distinct_by_text, mixed, shingles_of

SHINGLE_WORDS, PERCENT = 3, 85
DEPTH, LEAST_DEPTH = 6, 3
MISS_CHANCE = 3e-7
# Most sets, and most shingles, that are compared in one task at a time.
REGION_SETS, REGION_SHINGLES = 2048, 4 << 20

_U = np.uint64
_VALUE_BYTES = 2


def trees_for(percent: int) -> int:
    """Trees that a pair of exactly this similarity misses with ``MISS_CHANCE`` at most."""
    return math.ceil(math.log(MISS_CHANCE) / math.log(1 - (percent / 100) ** LEAST_DEPTH))


def min_hashes(hashes: np.ndarray, begins: np.ndarray, n: int) -> np.ndarray:
    """``n`` MinHash values, 16 bits each, of every set; sets are not empty."""
    factors, masks = constants(606, n), constants(707, n)
    result = np.empty((len(begins) - 1, n), np.uint16)
    for i in range(n):
        least = np.minimum.reduceat((hashes ^ masks[i]) * factors[i], begins[:-1])
        result[:, i] = mixed(least) >> _U(48)
    return result


def shingle_sets(docs: DataFrame, words: int, trees: int) -> DataFrame:
    """``(doc_id, n, g1, g2, k1, k2, sig)`` for every row of ``docs (doc_id, text)``.

    ``g1, g2`` name the set of n shingles, null if it is empty, and ``k1, k2`` the text. The
    signature is given once for the equal sets of a task.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[tuple[int, int]] = set()
        for part, texts in all_slices(batches):
            hashes, owners, _ = shingles_of(texts.lowered(), words)
            hashes, begins = distinct_by_text(hashes, owners, len(texts))
            sizes = np.diff(begins)
            filled = np.flatnonzero(sizes)
            names = np.zeros((len(texts), 2), np.int64)
            signatures: list = [None] * len(texts)
            if len(filled):
                at = begins[filled]
                for j, c in enumerate(constants(808, 2)):
                    names[filled, j] = np.add.reduceat(mixed(hashes * c), at).view(np.int64)
                values = min_hashes(hashes, np.append(at, len(hashes)), trees * DEPTH)
                for row, value in zip(filled.tolist(), values):
                    name = tuple(names[row].tolist())
                    if name not in seen:
                        seen.add(name)
                        signatures[row] = value.astype(">u2").tobytes()
            keys = np.array([text_key(texts.text(i)) for i in range(len(texts))], np.int64).reshape(-1, 2)
            empty = sizes == 0
            yield pa.RecordBatch.from_arrays(
                [part.column("doc_id"), pa.array(sizes.astype(np.int64))]
                + [pa.array(names[:, j], mask=empty) for j in range(2)]
                + [pa.array(keys[:, j]) for j in range(2)]
                + [pa.array(signatures, pa.binary())],
                ["doc_id", "n", "g1", "g2", "k1", "k2", "sig"],
            )

    schema = "doc_id long, n long, g1 long, g2 long, k1 long, k2 long, sig binary"
    return docs.select("doc_id", "text").mapInArrow(run, schema)


def groups_of(batches: Iterable[pa.RecordBatch], key: str) -> Iterator[pa.Table]:
    """Tables of the rows with one key, from rows sorted by it."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        values = batch.column(key).to_numpy(zero_copy_only=False)
        cuts = np.flatnonzero(values[1:] != values[:-1]) + 1
        for first, last in zip([0, *cuts.tolist()], [*cuts.tolist(), len(values)]):
            if last == first:
                continue
            if held and held[0].column(key)[0].as_py() != values[first]:
                yield pa.Table.from_batches(held)
                held = []
            held.append(batch.slice(first, last - first))
    if held:
        yield pa.Table.from_batches(held)


def _together(rows: DataFrame, key: str) -> DataFrame:
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rows.repartition(parts, key).sortWithinPartitions(key)


def likely(rows: DataFrame, percent: int, trees: int) -> DataFrame:
    """Rows ``(cell, g1, g2)`` of ``rows (cell, tree, g1, g2, n, sig, label)`` that need their sets.

    Those with a partner in the cell that has another label, a size that allows the
    similarity, a signature within five standard deviations of it, and no earlier tree
    where both meet.
    """
    values = trees * DEPTH
    share = percent / 100
    needed = math.floor((share - 5 * math.sqrt(share * (1 - share) / values)) * values)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for cell in groups_of(batches, "cell"):
            m = cell.num_rows
            if m < 2:
                continue
            joined = b"".join(cell["sig"].to_pylist())
            sig = np.frombuffer(joined, ">u2").astype(np.uint16).reshape(m, values)
            n, label = cell["n"].to_numpy(), cell["label"].to_numpy()
            tree = cell["tree"][0].as_py()
            wanted = np.zeros(m, bool)
            step = max(1, (1 << 20) // m)
            for first in range(0, m, step):
                own = slice(first, min(m, first + step))
                shape = (own.stop - first, m)
                small, large = np.minimum(n[own, None], n), np.maximum(n[own, None], n)
                maybe = (label[own, None] != label) & (100 * small >= percent * large)
                if not maybe.any():
                    continue
                agree, met = np.zeros(shape, np.int32), np.zeros(shape, bool)
                for t in range(trees):
                    prefix = np.ones(shape, bool)
                    for d in range(DEPTH):
                        column = sig[:, t * DEPTH + d]
                        same = column[own, None] == column
                        agree += same
                        if d < LEAST_DEPTH:
                            prefix &= same
                    if t < tree:
                        met |= prefix
                maybe &= (agree >= needed) & ~met
                wanted[own] |= maybe.any(axis=1)
                wanted |= maybe.any(axis=0)
            if wanted.any():
                yield from cell.select(["cell", "g1", "g2"]).filter(pa.array(wanted)).combine_chunks().to_batches()

    return _together(rows, "cell").mapInArrow(run, "cell long, g1 long, g2 long")


def intersections(sets: list[np.ndarray]) -> np.ndarray:
    """Size of the intersection of every two sets, exactly, by matrix products."""
    values, place = np.unique(np.concatenate(sets), return_inverse=True)
    owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    order = np.argsort(place, kind="stable")
    place, owner = place[order], owner[order]
    result = np.zeros((len(sets), len(sets)), np.float64)
    width = max(256, (4 << 20) // max(1, len(sets)))
    for first in range(0, len(values), width):
        low, high = np.searchsorted(place, [first, first + width])
        part = np.zeros((len(sets), min(width, len(values) - first)), np.float32)
        part[owner[low:high], place[low:high] - first] = 1
        result += part @ part.T
    return result.astype(np.int64)


def confirmed(rows: DataFrame, percent: int) -> DataFrame:
    """``(a1, a2, b1, b2)`` links that connect the sets of each cell of ``rows (cell, g1, g2, set)``.

    All pairs of a cell are decided on their full sets; the links given are those of a
    star for each group that the links connect, so there are fewer than sets.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for cell in groups_of(batches, "cell"):
            if cell.num_rows < 2:
                continue
            sets = [np.frombuffer(s, np.uint64) for s in cell["set"].to_pylist()]
            sizes = np.array([len(s) for s in sets])
            shared = intersections(sets)
            linked = 100 * shared >= percent * (sizes[:, None] + sizes - shared)
            root = _least_connected(linked)
            member = np.flatnonzero(root != np.arange(len(root)))
            if len(member):
                names = [cell[g].to_numpy() for g in ("g1", "g2")]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(x[root[member]]) for x in names] + [pa.array(x[member]) for x in names],
                    ["a1", "a2", "b1", "b2"],
                )

    return _together(rows, "cell").mapInArrow(run, "a1 long, a2 long, b1 long, b2 long")


def _least_connected(linked: np.ndarray) -> np.ndarray:
    """For every row of a symmetric matrix of links, the least row that it is connected with."""
    root = np.full(len(linked), -1)
    for start in range(len(linked)):
        if root[start] >= 0:
            continue
        root[start] = start
        front = np.array([start])
        while len(front):
            reached = linked[front].any(axis=0) & (root < 0)
            front = np.flatnonzero(reached)
            root[front] = start
    return root


def _path(tree: Column, depth: int) -> Column:
    return F.substring("sig", tree * (DEPTH * _VALUE_BYTES) + 1, F.lit(depth * _VALUE_BYTES))


def region(depth: int) -> Column:
    return F.xxhash64("tree", F.substring("path", 1, depth * _VALUE_BYTES)).alias("region")


class Forest:
    """The distinct sets of a corpus, and the links between them."""

    def __init__(self, docs: DataFrame, words: int, percent: int):
        """``docs (doc_id, text)``."""
        spark = docs.sparkSession
        self.docs, self.words, self.percent = docs, words, percent
        self.trees = trees_for(percent)
        self.steps = Steps(spark, "near")
        self.rows = self.steps.keep(shingle_sets(docs, words, self.trees), "rows")
        # One row for each distinct set; copies combine in each task first.
        classes = self.rows.filter("g1 IS NOT NULL").groupBy("g1", "g2").agg(
            F.min("doc_id").alias("least"),
            F.first("n").alias("n"),
            F.first("sig", ignorenulls=True).alias("sig"),
            F.min(F.struct("k1", "k2")).alias("k"),
        )
        self.classes = self.steps.keep(classes, "classes")

    def links(self) -> DataFrame:
        """``(a1, a2, b1, b2)``: links that connect what is connected."""
        trees = F.explode(F.sequence(F.lit(0), F.lit(self.trees - 1))).alias("tree")
        paths = self.classes.select("g1", "g2", "n", trees, "sig").select(
            "g1", "g2", "n", "tree", _path(F.col("tree"), DEPTH).alias("path")
        )
        regions = paths.groupBy(region(LEAST_DEPTH)).agg(F.count("*").alias("sets"), F.sum("n").alias("shingles"))
        regions = self.steps.keep(regions.filter("sets > 1"), "regions")
        alive = paths.withColumn("region", region(LEAST_DEPTH)).join(regions, "region")
        alive = self.steps.keep(alive, "alive")
        fits = F.expr(f"sets <= {REGION_SETS} AND shingles <= {REGION_SHINGLES}")
        cells = alive.filter(fits).withColumn("cell", F.col("region")).select("cell", "tree", "g1", "g2")
        large = alive.filter(~fits)
        if large.isEmpty():
            return self.compared(cells, None)
        near = self.compared(cells.unionByName(self.deepened(large)), None)
        return near.unionByName(self.compared(*self.crossed(large, near)))

    def deepened(self, large: DataFrame) -> DataFrame:
        """Cells of large regions: the least depth at which they fit, in blocks if none does."""
        fits = F.expr(f"sets <= {REGION_SETS} AND shingles <= {REGION_SHINGLES}")
        done, left = [], large
        for depth in range(LEAST_DEPTH + 1, DEPTH + 1):
            left = left.drop("region", "sets", "shingles").withColumn("region", region(depth))
            sizes = left.groupBy("region").agg(F.count("*").alias("sets"), F.sum("n").alias("shingles"))
            left = self.steps.keep(left.join(sizes, "region"), "deeper")
            done.append(left.filter(fits).withColumn("cell", F.col("region")))
            left = left.filter(~fits)
        done.append(left.withColumn("cell", F.xxhash64("region", _block())))
        return reduce(DataFrame.unionByName, [d.select("cell", "tree", "g1", "g2") for d in done])

    def crossed(self, large: DataFrame, near: DataFrame) -> tuple[DataFrame, DataFrame]:
        """Cells for pairs of different components in large regions, and the labels.

        Components that fill blocks of their own have no cell with themselves.
        """
        labels = self.steps.keep(self.labels(near), "labels")
        named = large.join(labels.select("g1", "g2", "label"), ["g1", "g2"], "left")
        own = F.coalesce("label", F.xxhash64("g1", "g2"))
        named = self.steps.keep(named.withColumn("label", own), "named")
        sizes = named.groupBy("region", "label").agg(F.sum("n").alias("weight"), F.count("*").alias("members"))
        pure = F.expr(f"members >= {REGION_SETS // 4} OR weight >= {REGION_SHINGLES // 4}")
        group = F.when(pure, F.col("label"))
        placed = named.join(sizes.select("region", "label", group.alias("pure")), ["region", "label"])
        totals = placed.groupBy("region", "pure").agg(F.sum("n").alias("weight"), F.count("*").alias("members"))
        parts = F.ceil(F.greatest(F.col("weight") / (REGION_SHINGLES // 2), F.col("members") / (REGION_SETS // 2)))
        totals = totals.withColumn("parts", parts.cast("int"))
        same = (F.col("p.region") == F.col("t.region")) & F.col("p.pure").eqNullSafe(F.col("t.pure"))
        placed = placed.alias("p").join(totals.alias("t"), same).select(
            "p.region", "tree", "g1", "g2", "p.pure",
            F.xxhash64("p.pure", F.pmod(F.xxhash64("g1", "g2"), F.col("parts"))).alias("block"),
        )
        placed = self.steps.keep(placed, "placed")
        blocks = placed.select("region", "pure", "block").distinct()
        # Pairs of blocks of one region; both sides have one row for each block, not each set.
        pairs = blocks.alias("x").join(blocks.alias("y"), "region").filter(
            "x.block <= y.block AND NOT (x.pure IS NOT NULL AND y.pure IS NOT NULL AND x.pure = y.pure)"
        ).select("region", F.col("x.block").alias("one"), F.col("y.block").alias("two"))
        pairs = pairs.withColumn("cell", F.xxhash64("region", "one", "two"))
        ends = pairs.select("region", "cell", F.explode(F.array_distinct(F.array("one", "two"))).alias("block"))
        return placed.join(ends, ["region", "block"]).select("cell", "tree", "g1", "g2"), labels

    def compared(self, cells: DataFrame, labels: DataFrame | None) -> DataFrame:
        """Confirmed links between sets of different labels that share a cell."""
        shown = cells.join(self.classes.select("g1", "g2", "n", "sig"), ["g1", "g2"])
        if labels is not None:
            shown = shown.join(labels.select("g1", "g2", "label"), ["g1", "g2"], "left")
            shown = shown.withColumn("label", F.coalesce("label", F.xxhash64("g1", "g2")))
        else:
            shown = shown.withColumn("label", F.xxhash64("g1", "g2"))
        wanted = self.steps.keep(likely(shown, self.percent, self.trees), "wanted")
        sets = self.steps.keep(self.sets(wanted.select("g1", "g2").distinct()), "sets")
        links = self.steps.keep(confirmed(wanted.join(sets, ["g1", "g2"]), self.percent).distinct(), "links")
        self.steps.drop(sets, wanted)
        return links

    def sets(self, names: DataFrame) -> DataFrame:
        """``(g1, g2, set)``: the sorted shingles of the named sets, from one text of each."""
        words = self.words
        keys = self.classes.join(names, ["g1", "g2"]).select("k.k1", "k.k2", "g1", "g2")
        texts = with_key(self.docs.filter("text IS NOT NULL").select("text"), F.col("text"))
        single = texts.groupBy("k1", "k2").agg(F.first("text").alias("text"))

        def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for part, texts in all_slices(batches):
                hashes, owners, _ = shingles_of(texts.lowered(), words)
                hashes, begins = distinct_by_text(hashes, owners, len(texts))
                rows = [hashes[a:b].tobytes() for a, b in zip(begins, begins[1:])]
                yield pa.RecordBatch.from_arrays(
                    [part.column("g1"), part.column("g2"), pa.array(rows, pa.binary())], ["g1", "g2", "set"]
                )

        chosen = single.join(keys, ["k1", "k2"]).select("g1", "g2", "text")
        return chosen.mapInArrow(run, "g1 long, g2 long, set binary")

    def labels(self, links: DataFrame) -> DataFrame:
        """``(g1, g2, r1, r2, label)``: the least set connected with each linked set, itself included."""
        edges = links.select(F.struct("a1", "a2").alias("u"), F.struct("b1", "b2").alias("v"))
        edges = edges.select(*[F.col(c).cast("struct<g1:long,g2:long>").alias(c) for c in ("u", "v")])
        found = components(self.steps, edges)
        every = found.union(found.select("root", "root").distinct())
        return every.select(
            "node.g1", "node.g2", F.col("root.g1").alias("r1"), F.col("root.g2").alias("r2"),
            F.xxhash64("root.g1", "root.g2").alias("label"),
        )

    def membership(self) -> DataFrame:
        """``(doc_id, n, k1, k2, component_id, c1, c2)`` for every row; c1, c2 name the component."""
        labels = self.steps.keep(self.labels(self.links()), "labels")
        self.steps.leave(self.rows, self.classes, labels)
        linked = self.classes.select("g1", "g2", "least").join(labels, ["g1", "g2"])
        lowest = linked.groupBy("r1", "r2").agg(F.min("least").alias("component_id"))
        moved = linked.join(lowest, ["r1", "r2"]).select("g1", "g2", "component_id", "r1", "r2")
        alone = self.classes.select("g1", "g2", F.col("least").alias("_least"))
        named = alone.join(moved, ["g1", "g2"], "left").select(
            "g1", "g2",
            F.when(F.col("r1").isNull(), F.col("_least")).otherwise(F.col("component_id")).alias("component_id"),
            F.coalesce("r1", "g1").alias("c1"), F.coalesce("r2", "g2").alias("c2"),
        )
        named = self.steps.keep(named, "named")
        self.steps.leave(self.rows, named)
        joined = self.rows.drop("sig").join(named, ["g1", "g2"], "left")
        own = F.when(F.col("g1").isNull(), F.col("doc_id")).otherwise(F.col("component_id"))
        return joined.select("doc_id", "n", "k1", "k2", own.alias("component_id"), "c1", "c2")


def _block() -> Column:
    """A block of about half a cell's sets, by hash: for regions that no depth makes small."""
    parts = F.ceil(F.greatest(F.col("sets") / (REGION_SETS // 2), F.col("shingles") / (REGION_SHINGLES // 2)))
    return F.pmod(F.xxhash64("g1", "g2"), parts.cast("int"))


def near_duplicates(
    docs: DataFrame,
    words: int = SHINGLE_WORDS,
    percent: int = PERCENT,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """``(doc_id, n_shingles, component_id, kept)`` for every row.

    Texts are lower-cased (A-Z) and cut into words; a text's set is its distinct
    shingles of ``words`` words, or of all its words if there are fewer. Texts whose sets
    have a Jaccard similarity of ``percent`` or more are linked, and ``component_id`` is the
    least id that links lead to. Null, empty and wordless texts have an empty set and are
    linked with nothing. ``kept`` marks rows with the id of their component, repeated rows
    alike. Other columns are not read; an empty table gives no rows.
    """
    rows = docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].alias("text"))
    found = Forest(rows, words, percent).membership()
    return found.select(
        "doc_id",
        F.col("n").alias("n_shingles"),
        "component_id",
        F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"),
    )


def one_of_each(
    docs: DataFrame, words: int, percent: int, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """The rows of ``docs``, with all their columns, without near-duplicates.

    Of every component the row with the least id stays, of several with that id the one with
    the least hash of its text, and of rows equal in both any one. Texts without words all stay.
    """
    marked = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"),
        docs[id_col].cast("long").alias("doc_id"),
        F.coalesce(docs[text_col], F.lit("")).alias("text"),
    )
    forest = Forest(marked.select("doc_id", "text"), words, percent)
    members = forest.steps.keep(forest.membership(), "members")
    forest.steps.leave(members)
    key = ["doc_id", "k1", "k2"]
    winners = members.filter("n > 0").groupBy("c1", "c2").agg(F.min(F.struct(*key)).alias("w")).select("w.*")
    stays = forest.steps.keep(winners.union(members.filter("n = 0").select(*key).distinct()), "stays")
    keyed = with_key(marked, F.col("text")).alias("d")
    same = reduce(lambda x, y: x & y, [F.col(f"d.{c}").eqNullSafe(F.col(f"s.{c}")) for c in key])
    result = keyed.join(stays.alias("s"), same, "left_semi")
    repeated = members.filter("n > 0").groupBy(*key).agg(F.count("*").alias("rows")).filter("rows > 1")
    twice = not repeated.join(stays, key, "left_semi").isEmpty()
    forest.steps.leave(stays)
    if twice:
        wordless = ~F.col("text").rlike(r"[^ \x09-\x0d]")
        result = result.withColumn("_own", F.when(wordless, F.monotonically_increasing_id()))
        result = result.dropDuplicates([*key, "_own"])
    return result.select("row.*")
