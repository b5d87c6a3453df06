"""Similarity self-join of shingle sets on count vectors packed in R-trees.

A text's set holds its distinct word shingles.  Shingles are hashed into ``GROUPS`` groups, and the
numbers of a set's shingles in each group are a point.  The summed coordinate minima of two points
bound the overlap of their sets from above; for a leaf of an R-tree its largest coordinates bound all its
points.  Pairs that the bound lets through are bounded again on about as many groups as the sets have
shingles, as 64 don't tell long texts apart, and then verified on the texts' whole sets.

One tree over all points does not prune: the counts of unrelated long texts lie too close for boxes
of many points to keep apart.  So there is a forest, one tree for each shingle, and a point stands only in the
trees of its rarest shingles, by the exact rule of prefix filtering: of two linked sets, the first
``n - ceil(8n/9) + 1`` shingles of the smaller and the first ``n - ceil(8n/10) + 1`` of the larger share
one (for 80 per cent), if both are sorted by one order.

1. Texts with equal sets become one node.
2. A node's order: shingles by hash, but hot ones (in more than ``LEAF`` nodes' heads) last.  Its head, the
   first shingles by hash, is a quarter longer than its prefix, so that hot ones can be left out.
3. Nodes whose heads are too hot for that (families of copies, mostly common lines) post all their
   shingles.  Then any prefix of another node meets them, and among themselves they are sorted by true
   frequency.
4. Trees of up to ``LEAF`` points are one leaf.  In larger ones, which only such families make, every point first
   meets the tree's hub, and then, round by round, its next point of another class in a random order of the tree; links
   join them to classes.  This ends only when every tree is of one class or after ``MIX_ROUNDS``.  Where classes still
   differ, the points of trees that hang together are packed into leaves in the order of size and coordinates; pairs of
   leaves that the boxes let through are compared, and pairs within one class left out.

Every linked pair is verified or lies in one class already.  Null texts and texts without words are
linked with nothing; a text of fewer words than a shingle is one shingle.  Repeated rows and equal
texts are one class.  Null ids are kept; a class's id is its smallest id that is not null.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import text as tx
from .blank_words import blank_words, ranges
from .components import connected_components
from .scratch import drop, tidy, write

SHINGLE, PERCENT, GROUPS, LEAF = 5, 80, 64, 128
MIX_ROUNDS = 2           # rounds, after that of the hubs, that make classes large before the rest of the pairs is looked at
CHUNK = 1 << 18          # pairs compared at a time
PACKED = "zstd"          # how the two large tables, of points, are stored
PAIRS, TASKS = 500, 24   # pairs that a task tests, and tasks at least: fewer than the shuffle has if pairs are few


def sets(texts: pa.Array, shingle: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct shingles of every text: owner and hash, by owner and hash, and the n + 1 offsets of the texts."""
    w = blank_words(texts, lower=True)
    value, at = tx.shingles(w, shingle)
    owner = tx.text_of(w, at)
    short = np.flatnonzero((w.count > 0) & (w.count < shingle))
    owner = np.concatenate((owner, short))
    value = np.concatenate((value, tx.sequence_hash(w)[short, 0]))
    order = np.lexsort((value, owner))
    owner, value = owner[order], value[order]
    once = np.ones(len(owner), dtype=bool)
    once[1:] = (owner[1:] != owner[:-1]) | (value[1:] != value[:-1])
    owner, value = owner[once], value[once]
    return owner, value, np.searchsorted(owner, np.arange(len(w.first)))


def index_length(n, percent: int):
    """Shingles of the smaller set that are enough: n - ceil(2 percent n / (100 + percent)) + 1."""
    return n - -(-2 * percent * n // (100 + percent)) + 1


def probe_length(n, percent: int):
    """Shingles of the larger set that are enough: n - ceil(percent n / 100) + 1."""
    return n - -(-percent * n // 100) + 1


def _head_length(n, percent: int):
    p = probe_length(n, percent)
    return np.minimum(n, p + p // 4 + 4)


def _fine_groups(n: np.ndarray) -> np.ndarray:
    """Groups of a set's fine point: the power of two at its size or above."""
    return np.left_shift(1, np.ceil(np.log2(np.maximum(n, 64))).astype(np.int64))


def _numbers(x: np.ndarray) -> bytes:
    """A point's coordinates in a byte each, or in four if one is over 255."""
    return x.astype("u1" if x.max(initial=0) < 256 else "<u4").tobytes()


def _read(point: bytes, groups: int) -> np.ndarray:
    return np.frombuffer(point, "u1" if len(point) == groups else "<u4")


def _sign(batches: Iterator[pa.RecordBatch], shingle: int, percent: int, groups: int) -> Iterator[pa.RecordBatch]:
    """(id, tk, text) -> (id, tk, fp, n, head, point, fine)"""
    for batch in tx.slices(batches, "text"):
        owner, value, first = sets(batch.column("text"), shingle)
        n, rows = np.diff(first), batch.num_rows
        fp = np.zeros((rows, 2), np.uint64)
        np.add.at(fp[:, 0], owner, tx.mix(value))
        np.add.at(fp[:, 1], owner, tx.mix(value ^ np.uint64(0xA0761D6478BD642F)))
        fp = tx.mix(fp + n.astype(np.uint64)[:, None]).tobytes()
        size = np.where(n > 0, _head_length(n, percent), 0)
        heads = value[ranges(first[:-1], size)].view(np.int64)
        point = np.bincount(owner * groups + (value % np.uint64(groups)).astype(np.int64), minlength=rows * groups)
        many = _fine_groups(n)
        begin = np.cumsum(many) - many
        fine = np.bincount(begin[owner] + (value % many[owner].astype(np.uint64)).astype(np.int64), minlength=int(many.sum()))
        yield pa.RecordBatch.from_arrays(
            [batch.column("id"), batch.column("tk"),
             pa.array([None if not c else fp[16 * i:16 * i + 16] for i, c in enumerate(n.tolist())], pa.binary()),
             pa.array(n, pa.int64()),
             pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(size))).astype(np.int32)), pa.array(heads)),
             pa.array([_numbers(x) for x in point.reshape(-1, groups)], pa.binary()),
             pa.array([_numbers(x) for x in np.split(fine, begin[1:])] if rows else [], pa.binary())],
            ["id", "tk", "fp", "n", "head", "point", "fine"])


def _all_shingles(batches: Iterator[pa.RecordBatch], shingle: int) -> Iterator[pa.RecordBatch]:
    """(node, text) -> (token, node, n) of every shingle."""
    for batch in tx.slices(batches, "text"):
        owner, value, first = sets(batch.column("text"), shingle)
        node = batch.column("node").to_numpy()
        yield pa.RecordBatch.from_arrays([pa.array(value.view(np.int64)), pa.array(node[owner]), pa.array(np.diff(first)[owner])],
                                         ["token", "node", "n"])


def _verify_rows(batches: Iterator[pa.RecordBatch], shingle: int, percent: int) -> Iterator[pa.RecordBatch]:
    """(a, b, text_a, text_b) -> (a, b) of linked pairs."""
    for half in tx.slices(batches, "text_a"):
        for batch in tx.slices(iter([half]), "text_b"):
            sides = [sets(batch.column(c), shingle) for c in ("text_a", "text_b")]
            owner = np.concatenate([s[0] for s in sides])
            value = np.concatenate([s[1] for s in sides])
            order = np.lexsort((value, owner))
            owner, value = owner[order], value[order]
            both = (owner[1:] == owner[:-1]) & (value[1:] == value[:-1])
            same = np.bincount(owner[1:][both], minlength=batch.num_rows)
            total = np.diff(sides[0][2]) + np.diff(sides[1][2])
            linked = pa.array((100 + percent) * same >= percent * total)
            yield batch.select(["a", "b"]).filter(linked)


def _passes(x: np.ndarray, y: np.ndarray, points: np.ndarray, n: np.ndarray, percent: int) -> np.ndarray:
    """True for pairs of points whose sizes and summed coordinate minima allow a link."""
    out = np.zeros(len(x), dtype=bool)
    for i in range(0, len(x), CHUNK):
        a, b = x[i:i + CHUNK], y[i:i + CHUNK]
        ok = np.minimum(n[a], n[b]) * 100 >= percent * np.maximum(n[a], n[b])
        a, b = a[ok], b[ok]
        bound = np.minimum(points[a], points[b]).sum(axis=1, dtype=np.int64)
        ok[ok] = (100 + percent) * bound >= percent * (n[a] + n[b])
        out[i:i + CHUNK] = ok
    return out


def _fine_allows(n: tuple[int, int], fine: tuple[bytes, bytes], percent: int) -> bool:
    """Whether the summed coordinate minima of two fine points allow a link; the finer point is folded."""
    groups = _fine_groups(np.array(n)).tolist()
    x, y = (_read(p, g).astype(np.int64).reshape(-1, min(groups)).sum(axis=0) for p, g in zip(fine, groups, strict=True))
    return (100 + percent) * int(np.minimum(x, y).sum()) >= percent * sum(n)


def _fine_rows(batches: Iterator[pa.RecordBatch], percent: int) -> Iterator[pa.RecordBatch]:
    """(a, b, n_a, n_b, fine_a, fine_b) -> (a, b) whose fine points allow a link."""
    for batch in batches:
        n_a, n_b, fine_a, fine_b = (batch.column(c).to_pylist() for c in ("n_a", "n_b", "fine_a", "fine_b"))
        good = [_fine_allows(n, fine, percent) for n, fine in zip(zip(n_a, n_b, strict=True), zip(fine_a, fine_b, strict=True), strict=True)]
        yield batch.select(["a", "b"]).filter(pa.array(good, pa.bool_()))


def _points(column: pa.Array, groups: int) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    found = column.to_pylist()
    if all(len(x) == groups for x in found):
        return np.frombuffer(b"".join(found), "u1").reshape(-1, groups)
    return np.stack([_read(x, groups).astype("<u4") for x in found])


def _whole_trees(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted rows in batches that end between two trees."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        token = batch.column("token").to_numpy()
        last = int(np.searchsorted(token, token[-1]))
        if last:
            held.append(batch.slice(0, last))
            yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            held = []
        held.append(batch.slice(last))
    if held:
        yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]


def _leaf_pairs(batches: Iterator[pa.RecordBatch], percent: int, groups: int) -> Iterator[pa.RecordBatch]:
    """Rows (token, node, n, first, point), sorted by token, size and node, of trees of one leaf -> (a, b) that pass.

    ``first``: the row is in its node's index prefix; the smaller of a pair must be.
    """
    for batch in _whole_trees(batches):
        token, node, n = (batch.column(c).to_numpy() for c in ("token", "node", "n"))
        index = batch.column("first").to_numpy(zero_copy_only=False)
        points = _points(batch.column("point"), groups)
        stop = np.searchsorted(token, token, side="right")
        # larger sets that may still be linked: up to n * 100 / percent
        own = np.flatnonzero(index)
        for some in np.array_split(own, max(1, len(own) * 8 // CHUNK)):
            count = stop[some] - some - 1
            x, y = np.repeat(some, count), ranges(some + 1, count)
            good = _passes(x, y, points, n, percent)
            a, b = node[x[good]], node[y[good]]
            yield pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], ["a", "b"])


_LEAF_TYPES = ("cluster bigint, leaf bigint, nodes array<bigint>, sizes array<bigint>, classes array<bigint>, firsts array<boolean>, points binary, "
               "fines array<binary>, least bigint, most bigint, box array<bigint>, box_classes array<bigint>, any_first boolean")


def _leaves(batches: Iterator[pa.RecordBatch], groups: int, leaf: int) -> Iterator[pa.RecordBatch]:
    """Rows (cluster, node, n, class, first, point, fine) in order -> a row for every ``leaf`` of them."""
    from pyspark import TaskContext

    number = TaskContext.get().partitionId() << 33
    for batch in batches:
        cluster = batch.column("cluster").to_numpy()
        starts = np.flatnonzero(np.concatenate(([True], cluster[1:] != cluster[:-1]))) if len(cluster) else []
        cuts = sorted({c for i, j in zip(starts, [*starts[1:], len(cluster)], strict=True) for c in range(i, j, leaf)})
        for i, j in zip(cuts, [*cuts[1:], len(cluster)], strict=True):
            part = batch.slice(i, j - i)
            n, of = part.column("n").to_numpy(), part.column("class").to_numpy()
            points = _points(part.column("point"), groups)
            yield pa.RecordBatch.from_pylist([{
                "cluster": int(cluster[i]), "leaf": number, "nodes": part.column("node").to_pylist(), "sizes": n.tolist(),
                "classes": of.tolist(), "firsts": part.column("first").to_pylist(), "points": points.astype("<u4").tobytes(),
                "fines": part.column("fine").to_pylist(), "least": int(n.min()), "most": int(n.max()),
                "box": points.max(axis=0).tolist(), "box_classes": [int(of.min()), int(of.max())],
                "any_first": any(part.column("first").to_pylist())}], pa.schema(
                    [("cluster", pa.int64()), ("leaf", pa.int64()), ("nodes", pa.list_(pa.int64())), ("sizes", pa.list_(pa.int64())),
                     ("classes", pa.list_(pa.int64())), ("firsts", pa.list_(pa.bool_())), ("points", pa.binary()),
                     ("fines", pa.list_(pa.binary())), ("least", pa.int64()), ("most", pa.int64()),
                     ("box", pa.list_(pa.int64())), ("box_classes", pa.list_(pa.int64())), ("any_first", pa.bool_())]))
            number += 1


def _compare_leaves(batches: Iterator[pa.RecordBatch], percent: int, groups: int) -> Iterator[pa.RecordBatch]:
    """Pairs of leaves -> pairs (a, b) of points of different classes that pass, their fine points too."""
    for batch in batches:
        for row in batch.to_pylist():
            same = row["leaf_x"] == row["leaf_y"]
            node, n, of, first = (np.array(row[c + "_x"] + ([] if same else row[c + "_y"])) for c in ("nodes", "sizes", "classes", "firsts"))
            points = np.frombuffer(row["points_x"] + (b"" if same else row["points_y"]), "<u4").reshape(-1, groups)
            m = len(row["nodes_x"])
            x, y = np.triu_indices(m, 1) if same else (np.repeat(np.arange(m), len(node) - m), np.tile(np.arange(m, len(node)), m))
            apart = (of[x] != of[y]) & (first[x] | first[y])
            x, y = x[apart], y[apart]
            good = _passes(x, y, points, n, percent)
            x, y, fine = x[good], y[good], row["fines_x"] + ([] if same else row["fines_y"])
            good = np.fromiter((_fine_allows((n[i], n[j]), (fine[i], fine[j]), percent) for i, j in zip(x.tolist(), y.tolist(), strict=True)),
                               bool, len(x))
            a, b = node[x[good]], node[y[good]]
            yield pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], ["a", "b"])


class _Join:
    """The steps of the join over the nodes of one table."""

    def __init__(self, keyed: DataFrame, nodes: DataFrame, shingle: int, percent: int, groups: int, leaf: int):
        self.keyed, self.nodes = keyed, nodes
        self.shingle, self.percent, self.groups, self.leaf = shingle, percent, groups, leaf

    def texts(self, need: DataFrame, name: str) -> DataFrame:
        """(node, text) of the nodes in ``need``, found again by id and text key; each node once."""
        need = write(self.nodes.select("node", "id", F.col("tk.x").alias("x"), F.col("tk.y").alias("y")).join(need, "node"), "needed")
        rows = self.keyed.select(F.col("id").alias("id_"), F.col("tk.x").alias("x"), F.col("tk.y").alias("y"), "text")
        found = write(rows.join(need.hint("merge"), (rows.x == need.x) & (rows.y == need.y) & rows.id_.eqNullSafe(need.id))
                      .select("node", "text"), name)
        tidy(found.sparkSession)
        # rows alike in id and text give their node's text again
        return found if found.count() == need.count() else write(found.dropDuplicates(["node"]), name)

    def verified(self, pairs: DataFrame, texts: DataFrame | None = None) -> DataFrame:
        """Links among ``pairs`` (a, b) that join all linked ones to their classes.

        First each node's pair with its least partner, then the pairs that are not in one class by these.
        """
        # the shuffles that find the pairs are given up before those that bring their fine points
        met = write(pairs.distinct(), "pairs")
        tidy(met.sparkSession)
        pairs = write(self.within_bound(met), "candidates")
        drop(met)
        most = pairs.count()
        own = texts is None
        if own:
            texts = self.texts(pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct(), "texts")
        some = pairs.groupBy("b").agg(F.min("a").alias("a")).select("a", "b")
        found = self.linked(some, texts, most)
        classes = write(connected_components(found), "classes")
        x, y = (classes.select(F.col("node").alias(c), F.col("component").alias(f"of_{c}")) for c in "ab")
        rest = (pairs.join(some, ["a", "b"], "left_anti").join(x, "a", "left").join(y, "b", "left")
                .filter(F.coalesce("of_a", "a") != F.coalesce("of_b", "b")).select("a", "b"))
        links = write(found.unionByName(self.linked(rest, texts, most)), "links")
        if own:
            drop(texts)
        return links

    def linked(self, pairs: DataFrame, texts: DataFrame, most: int) -> DataFrame:
        """Pairs, at most ``most``, whose whole sets are similar enough."""
        both = (pairs.join(texts.select(F.col("node").alias("a"), F.col("text").alias("text_a")), "a")
                .join(texts.select(F.col("node").alias("b"), F.col("text").alias("text_b")), "b"))
        shingle, percent = self.shingle, self.percent
        both = both.select("a", "b", "text_a", "text_b").coalesce(max(TASKS, most // PAIRS))
        return write(both.mapInArrow(lambda it: _verify_rows(it, shingle, percent), "a bigint, b bigint"), "links")

    def allowed(self, x: DataFrame, y: DataFrame) -> DataFrame:
        """(a, b) of rows of x and y of one tree that sizes allow."""
        n, m = F.col("x.n"), F.col("y.n")
        return (x.alias("x").join(y.alias("y"), F.col("x.token") == F.col("y.token"))
                .filter((F.col("x.node") != F.col("y.node")) & (F.least(n, m) * 100 >= F.greatest(n, m) * self.percent))
                .select(F.least("x.node", "y.node").alias("a"), F.greatest("x.node", "y.node").alias("b")))

    def within_bound(self, pairs: DataFrame, nodes: DataFrame | None = None, most: int | None = None) -> DataFrame:
        """Pairs (a, b) whose fine points allow a link; ``nodes``: a part of the nodes that has those of the pairs, at most ``most``."""
        # the join has one form at every size, unless the part is small
        p = (self.nodes if nodes is None else nodes).select("node", "n", "fine")
        p = p.hint("merge") if nodes is None else p
        both = (pairs.distinct().join(p.select(F.col("node").alias("a"), F.col("n").alias("n_a"), F.col("fine").alias("fine_a")), "a")
                .join(p.select(F.col("node").alias("b"), F.col("n").alias("n_b"), F.col("fine").alias("fine_b")), "b"))
        percent = self.percent
        both = both.select("a", "b", "n_a", "n_b", "fine_a", "fine_b")
        both = both if most is None else both.coalesce(max(TASKS, most // PAIRS))
        return both.mapInArrow(lambda it: _fine_rows(it, percent), "a bigint, b bigint")

    def leaf_pairs(self, rows: DataFrame) -> DataFrame:
        """Pairs (a, b) that pass, of trees that are one leaf: rows (token, node, n, first)."""
        several = rows.groupBy("token").agg(F.count("*").alias("m"), F.max("first").alias("f")).filter("m > 1 and f").select("token")
        rows = rows.join(several, "token").join(self.nodes.select("node", "point").hint("merge"), "node").select("token", "node", "n", "first", "point")
        groups, percent = self.groups, self.percent
        return (rows.repartition("token").sortWithinPartitions("token", "n", "node")
                .mapInArrow(lambda it: _leaf_pairs(it, percent, groups), "a bigint, b bigint"))

    def heads(self) -> DataFrame:
        """Shingles of heads that several nodes hold: token, node, n, rank without hot ones, hot, and whether the node is common.

        Common nodes have too few shingles in their head that are not hot.
        """
        probe = probe_length_sql("n", self.percent)
        posts = self.nodes.select("node", F.posexplode("head").alias("place", "token"))
        # counted where the token's rows are: posts, the largest rows here, are shuffled once
        often = F.count("*").over(Window.partitionBy("token"))
        met = posts.withColumn("often", often).filter("often > 1").select("token", "node", "place", (F.col("often") > self.leaf).alias("hot"))
        met = met.join(self.nodes.select("node", "n"), "node")
        by_node = Window.partitionBy("node")
        hot = F.col("hot").cast("int")
        before = F.sum(hot).over(by_node.orderBy("place").rowsBetween(Window.unboundedPreceding, Window.currentRow))
        head = F.least(F.col("n"), F.expr(f"{probe} + ({probe}) div 4 + 4"))
        return write(met.select("token", "node", "n", "hot", (F.col("place") - before).alias("rank"),
                                (head - F.sum(hot).over(by_node) < F.expr(probe)).alias("common")), "heads")

    def common_posts(self, texts: DataFrame) -> DataFrame:
        """All shingles of common nodes that several of them hold, with rank by frequency."""
        shingle = self.shingle
        posts = write(texts.mapInArrow(lambda it: _all_shingles(it, shingle), "token bigint, node bigint, n bigint"), "common")
        often = posts.groupBy("token").agg(F.count("*").alias("often"))
        rank = F.row_number().over(Window.partitionBy("node").orderBy("often", "token")) - 1
        return write(posts.join(often, "token").select("token", "node", "n", "often", rank.alias("rank")), "common_posts")

    def families(self, big: DataFrame, texts: DataFrame) -> DataFrame:
        """Links of trees of more than one leaf: rows (token, node, n, first)."""
        score = big.groupBy("node").agg(F.count("*").alias("score"), F.max("first").alias("first"))
        nodes = write(self.nodes.select("node", "n", "point", "fine").join(score.select("node", "first"), "node"), "family_nodes")
        members = write(big.join(score.select("node", "score"), "node").select("token", "node", "n", "score"), "members")
        hubs = self.hubs(members)
        most = members.count()               # every member meets one other a round
        met = self.allowed(members, hubs)
        links = None
        for turn in range(MIX_ROUNDS + 1):
            met = write(self.within_bound(met, nodes, most), "candidates")
            new = self.linked(met, texts, met.count())
            links = new if links is None else links.unionByName(new)
            classes = write(connected_components(links), "classes")
            # pairs that are left out are in one class only where the whole tree is
            if self.other_classes(members, hubs, classes).isEmpty():
                return links
            met = self.mixed_pairs(members, classes, turn)
        met = members.join(hubs.select("token", F.col("node").alias("hub")), "token").filter("node != hub")
        clusters = connected_components(met.select(F.col("node").alias("a"), F.col("hub").alias("b")).distinct())
        classed = (nodes.select("node", "n", "point", "fine", "first").join(clusters.withColumnRenamed("component", "cluster"), "node")
                   .join(classes, "node", "left").withColumn("class", F.coalesce("component", "node")))
        mixed = classed.groupBy("cluster").agg(F.min("class").alias("l"), F.max("class").alias("m")).filter("l < m").select("cluster")
        rest = write(classed.join(mixed, "cluster").select("cluster", "node", "n", "class", "first", "point", "fine"), "mixed")
        met = write(self.packed_pairs(rest), "candidates")
        return links.unionByName(self.linked(met, texts, met.count()))

    @staticmethod
    def hubs(members: DataFrame) -> DataFrame:
        """(token, node, n): the member of each tree that stands in most trees."""
        return write(members.groupBy("token").agg(F.max(F.struct("score", "node", "n")).alias("hub"), F.count("*").alias("m"))
                     .filter("m > 1").select("token", F.col("hub.node").alias("node"), F.col("hub.n").alias("n")), "hubs")

    @staticmethod
    def other_classes(members: DataFrame, hubs: DataFrame, classes: DataFrame) -> DataFrame:
        """Members that are not in their tree's hub's class."""
        own = classes.select("node", F.col("component").alias("own"))
        its = classes.select(F.col("node").alias("hub"), F.col("component").alias("its"))
        return (members.join(hubs.select("token", F.col("node").alias("hub")), "token").filter("node != hub")
                .join(own, "node", "left").join(its, "hub", "left")
                .filter(F.coalesce("own", "node") != F.coalesce("its", "hub")).select("token", "node", "n", "score"))

    def mixed_pairs(self, members: DataFrame, classes: DataFrame, turn: int) -> DataFrame:
        """(a, b) that sizes allow of each member and the next one in a random order of its tree, if that is of another class."""
        order = Window.partitionBy("token").orderBy(F.xxhash64(F.lit(turn), "token", "node"), "node")
        own = F.coalesce("component", "node").alias("class")
        rows = members.join(classes, "node", "left").select("token", F.struct("node", "n", own).alias("x"), "node")
        n, m = F.col("x.n"), F.col("y.n")
        return (rows.withColumn("y", F.lead("x").over(order)).filter(F.col("x.class") != F.col("y.class"))
                .filter(F.least(n, m) * 100 >= F.greatest(n, m) * self.percent)
                .select(F.least("x.node", "y.node").alias("a"), F.greatest("x.node", "y.node").alias("b")))

    def packed_pairs(self, rows: DataFrame) -> DataFrame:
        """Pairs (a, b) that pass, of different classes of one cluster: leaves of a packed R-tree, joined by their boxes."""
        groups, leaf, percent = self.groups, self.leaf, self.percent
        packed = (rows.repartitionByRange("cluster", "n", "point").sortWithinPartitions("cluster", "n", "point")
                  .mapInArrow(lambda it: _leaves(it, groups, leaf), _LEAF_TYPES))
        packed = write(packed, "leaves")

        def side(s: str) -> DataFrame:
            return packed.select("cluster", *[F.col(c).alias(f"{c}_{s}") for c in packed.columns if c != "cluster"])

        x, y = side("x"), side("y")
        least, most = F.least("most_x", "most_y"), F.greatest("least_x", "least_y")
        bound = F.expr("aggregate(zip_with(box_x, box_y, (p, q) -> least(p, q)), 0L, (s, v) -> s + v)")
        one = ((F.col("box_classes_x") == F.col("box_classes_y")) & (F.col("box_classes_x")[0] == F.col("box_classes_x")[1]))
        pairs = (x.join(y, "cluster").filter((F.col("leaf_x") <= F.col("leaf_y")) & (least * 100 >= most * percent) & ~one
                                              & (F.col("any_first_x") | F.col("any_first_y")))
                 .filter(bound * (100 + percent) >= (F.col("least_x") + F.col("least_y")) * percent))
        kept = [f"{c}_{s}" for s in "xy" for c in ("leaf", "nodes", "sizes", "classes", "firsts", "points", "fines")]
        return pairs.select(*kept).mapInArrow(lambda it: _compare_leaves(it, percent, groups), "a bigint, b bigint")

    def links(self) -> DataFrame:
        """Links (a, b) that join all linked nodes to their classes."""
        heads = self.heads()
        tidy(heads.sparkSession)
        probe, index = probe_length_sql("n", self.percent), index_length_sql("n", self.percent)
        own = (heads.filter("not common and not hot").filter(F.col("rank") < F.expr(probe))
               .select("token", "node", "n", (F.col("rank") < F.expr(index)).alias("first")))
        common = write(heads.filter("common").select("node").distinct(), "common_nodes")
        pairs = self.leaf_pairs(own)
        if common.isEmpty():
            return self.verified(pairs)
        texts = self.texts(common, "common_texts")
        posts = self.common_posts(texts)
        prefix = posts.filter(F.col("rank") < F.expr(probe)).filter("often > 1").select(
            "token", "node", "n", "often", (F.col("rank") < F.expr(index)).alias("first"))
        alone = self.single_heads(heads, posts, common)
        pairs = (pairs.unionByName(self.leaf_pairs(prefix.filter(F.col("often") <= self.leaf).drop("often")))
                 .unionByName(self.allowed(own.unionByName(alone, allowMissingColumns=True), posts)))
        found = self.verified(pairs)
        big = prefix.filter(F.col("often") > self.leaf).drop("often")
        big = write(big.join(big.filter("first").select("token").distinct(), "token", "left_semi"), "big")
        return found if big.isEmpty() else found.unionByName(self.families(big, texts))

    def single_heads(self, heads: DataFrame, posts: DataFrame, common: DataFrame) -> DataFrame:
        """Prefix shingles of nodes that are not common, which no other head holds but some common node does.

        A common node holds them beyond its own head, so only shingles beyond the least end of the heads of common
        nodes of about that size (classes of sizes, a ratio of 100 / percent wide) can be such.
        """
        probe = probe_length_sql("n", self.percent)
        ratio = 100 / self.percent if self.percent < 100 else 2.0
        scale = F.floor(F.log(F.col("n").cast("double")) / F.log(F.lit(ratio))).cast("int")
        half = F.shiftrightunsigned                              # unsigned hashes compared without their last bit
        ends = (self.nodes.join(common, "node").filter(F.size("head") < F.col("n"))
                .select(F.explode(F.array(*(scale + k for k in range(-2, 3)))).alias("scale"), half(F.element_at("head", -1), 1).alias("end"))
                .groupBy("scale").agg(F.min("end").alias("end")))
        own = (self.nodes.select("node", "n", scale.alias("scale"), "head").join(ends, "scale")
               .withColumn("head", F.transform("head", lambda x, i: F.struct(i.alias("place"), x.alias("token"))))
               .select("node", "n", F.inline(F.filter("head", lambda x: half(x["token"], 1) >= F.col("end"))))
               .join(posts.select("token").distinct(), "token", "left_semi")
               .join(heads.select("token").distinct(), "token", "left_anti").join(common, "node", "left_anti"))
        hot = heads.filter("hot").groupBy("node").agg(F.count("*").alias("hots"))
        return (own.join(hot, "node", "left").filter(F.col("place") - F.coalesce("hots", F.lit(0)) < F.expr(probe))
                .select("token", "node", "n"))


def probe_length_sql(n: str, percent: int) -> str:
    return f"{n} - ({percent} * {n} + 99) div 100 + 1"


def index_length_sql(n: str, percent: int) -> str:
    return f"{n} - ({2 * percent} * {n} + {99 + percent}) div {100 + percent} + 1"


def linked_sets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, percent: int = PERCENT,
                groups: int = GROUPS, leaf: int = LEAF) -> DataFrame:
    """Per row: id, n_shingles (set size) and component_id, the smallest id reachable by links, itself included.

    Two rows are linked if 100 * intersection >= ``percent`` * union of their sets (50 to 100).
    """
    key = F.struct(F.xxhash64("text").alias("x"), F.xxhash64(F.lit("again"), F.col("text")).alias("y"))
    source = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    keyed = source.select("id", key.alias("tk"), "text")
    kind = source.schema["id"].dataType.simpleString()
    signed = keyed.mapInArrow(lambda it: _sign(it, shingle, percent, groups),
                              f"id {kind}, tk struct<x:bigint,y:bigint>, fp binary, n bigint, head array<bigint>, "
                              "point binary, fine binary")
    signed = write(signed.withColumn("row", F.monotonically_increasing_id()), "signed", PACKED)
    least = write(signed.filter("n > 0").groupBy("fp").agg(F.min("row").alias("row"), F.min("id").alias("id")), "sets")
    rows = write(signed.select("id", "fp", F.col("n").alias("n_shingles")), "rows")
    nodes = write(signed.drop("fp").join(least.select("row").hint("merge"), "row").withColumnRenamed("row", "node"), "nodes", PACKED)
    drop(signed)
    classes = connected_components(_Join(keyed, nodes, shingle, percent, groups, leaf).links())
    of = write(least.withColumnRenamed("row", "node").join(classes, "node", "left")
               .select("fp", "id", F.coalesce("component", "node").alias("component")), "of")
    named = of.join(of.groupBy("component").agg(F.min("id").alias("component_id")), "component").select("fp", "component_id")
    return (rows.filter("fp is not null").join(named, "fp").select("id", "n_shingles", "component_id")
            .unionByName(rows.filter("fp is null").select("id", "n_shingles", F.col("id").alias("component_id"))))
