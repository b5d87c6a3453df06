"""Near duplicates: BagMinHash signatures over word shingles, banding, exact multiset overlap.

``near_duplicates`` returns one row per input row with its class.  Steps:

1. One pass over the texts gives each row a hash of its whole word sequence and its band keys.
   Rows with equal word sequences become one node, so groups of copies shrink to a single row
   before any join.
2. Nodes that share a band key form a bucket.  A bucket's hub is the node that shares most
   buckets with most other nodes (for edited copies of one text: the text itself or the copy
   nearest to it).  Only (member, hub) pairs are compared, never all pairs of a bucket.
3. A pair is a link if the exact weighted Jaccard similarity of its shingle multisets reaches the
   threshold.  Links are joined to classes by connected components.
4. Members of a bucket that did not join their hub's class get a new hub among themselves, once
   (``ROUNDS``).  These rounds only make the classes large.
5. Members of buckets that still hold several classes meet by a prefix filter, which loses no link:
   the shingles of a text (copies numbered) are ordered from the rarest among those members on; of
   two linked texts the smaller one's first ``(1 - t) / (1 + t)`` share of shingles holds one of the
   larger one's first ``1 - t`` share (less where the sizes are close).  Shingles that only one
   member has fill places but are never joined, so members that their own edits keep under the
   threshold give next to no pairs, however large their family.  Candidates by place and size
   are compared exactly, so the classes are those of all links within buckets.

With 25 bands of 5 components, a pair of similarity 0.8 shares a bucket with probability 0.99995.
A text of fewer than ``shingle`` words is one shingle.  Null texts and texts without words are
classes of their own.  Repeated rows are copies like any others; null ids are allowed.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import bagminhash, text as tx
from .components import connected_components
from .scratch import write

SHINGLE, THRESHOLD, BANDS, ROWS = 5, 0.8, 25, 5
ROUNDS = 2               # rounds of hubs before the prefix filter
STEP = 1.06              # sizes of one band of the prefix filter differ by at most this factor


def text_bags(w: tx.Words, shingle: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Shingle multisets of a batch: owner, value, weight; a shorter text is one shingle."""
    value, at = tx.shingles(w, shingle)
    owner = tx.text_of(w, at)
    short = np.flatnonzero((w.count > 0) & (w.count < shingle))
    if len(short):
        value = np.concatenate((value, tx.sequence_hash(w)[short, 0]))
        owner = np.concatenate((owner, short))
    return bagminhash.bags(value, owner)


def sign(batches: Iterator[pa.RecordBatch], shingle: int = SHINGLE, bands: int = BANDS,
         rows: int = ROWS) -> Iterator[pa.RecordBatch]:
    """(id, tk, text) -> (id, tk, fp, bands, size); fp and bands are null for texts without words; size: shingles."""
    for batch in tx.slices(batches, "text"):
        w = tx.words(batch.column("text"))
        owner, value, weight = text_bags(w, shingle)
        sig = bagminhash.signatures(owner, value, weight, batch.num_rows, bands * rows)
        keys = bagminhash.band_keys(sig, bands, rows)
        empty = w.count == 0
        fp = tx.sequence_hash(w).tobytes()
        fp = [None if e else fp[16 * i:16 * i + 16] for i, e in enumerate(empty)]
        offsets = pa.array(np.arange(batch.num_rows + 1, dtype=np.int32) * bands)
        lists = pa.ListArray.from_arrays(offsets, pa.array(keys.ravel()), mask=pa.array(empty))
        yield pa.RecordBatch.from_arrays(
            [batch.column("id"), batch.column("tk"), pa.array(fp, pa.binary()), lists,
             pa.array(np.bincount(owner, weights=weight, minlength=batch.num_rows).astype(np.int64))],
            ["id", "tk", "fp", "bands", "size"])


def compare(batches: Iterator[pa.RecordBatch], shingle: int = SHINGLE) -> Iterator[pa.RecordBatch]:
    """(a, b, text_a, text_b) -> (a, b, similarity), exact."""
    for half in tx.slices(batches, "text_a"):
        for batch in tx.slices(iter([half]), "text_b"):
            sides = []
            for name in ("text_a", "text_b"):
                owner, value, weight = text_bags(tx.words(batch.column(name)), shingle)
                first = np.searchsorted(owner, np.arange(batch.num_rows + 1))
                sides.append((value, weight, first))
            (va, wa, fa), (vb, wb, fb) = sides
            same = [bagminhash.overlap((va[fa[i]:fa[i + 1]], wa[fa[i]:fa[i + 1]]),
                                       (vb[fb[i]:fb[i + 1]], wb[fb[i]:fb[i + 1]])) for i in range(batch.num_rows)]
            yield pa.RecordBatch.from_arrays(
                [batch.column("a"), batch.column("b"), pa.array(same, pa.float64())], ["a", "b", "similarity"])


def tokens(batches: Iterator[pa.RecordBatch], shingle: int = SHINGLE) -> Iterator[pa.RecordBatch]:
    """(node, text) -> (node, token): a row per shingle, equal shingles of a text told apart by number."""
    for batch in tx.slices(batches, "text"):
        owner, value, weight = text_bags(tx.words(batch.column("text")), shingle)
        copy = np.arange(weight.sum()) - np.repeat(np.cumsum(weight) - weight, weight)
        token = tx.mix(np.repeat(value, weight) ^ tx.mix(copy.astype(np.uint64)))
        yield pa.RecordBatch.from_arrays([batch.column("node").take(pa.array(np.repeat(owner, weight))),
                                          pa.array(token.view(np.int64))], ["node", "token"])


def posts(rows: DataFrame, sizes: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(node, token) and (node, size, component) -> (node, size, component, token, band, place, probe): prefixes of all nodes.

    Rows with ``probe`` false are a text's post as the smaller one of a pair, under its own size band; the
    others as the larger one, under the band of each size that can be linked.  Tokens of one node alone have no row.
    """
    often = write(rows.groupBy("token").agg(F.count("*").alias("n")).filter("n > 1"), "often")
    node = Window.partitionBy("node")
    placed = (rows.join(often, "token").join(sizes, "node")
              .withColumn("place", F.col("size") - F.count("*").over(node) + F.row_number().over(node.orderBy("n", "token")) - 1))
    size, share = F.col("size"), threshold / (1 + threshold)
    band = lambda x: F.floor(F.log(x) / math.log(STEP) + 1e-9)
    ceil = lambda x: F.ceil(x - 1e-6)
    least = F.greatest(F.pow(F.lit(STEP), F.col("band")) - 1e-3, size * threshold)
    bands = F.sequence(band(ceil(size * threshold).cast("double")), band(size.cast("double")))
    out = (placed.filter(F.col("place") <= size - ceil(size * threshold))
           .withColumn("band", F.explode(bands))
           .withColumn("probe", F.explode(F.array(F.lit(False), F.lit(True)))))
    return (out.filter(F.when(F.col("probe"), F.col("place") <= size - ceil((least + size) * share))
                       .otherwise((F.col("band") == band(size.cast("double"))) & (F.col("place") <= size - ceil(size * 2 * share))))
            .select("node", "size", "component", "token", "band", "place", "probe"))


def _text_key(column: str = "text"):
    """128 bits of a text, for finding a row again without its text."""
    return F.struct(F.xxhash64(column).alias("x"), F.xxhash64(F.lit("again"), F.col(column)).alias("y"))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE,
                    threshold: float = THRESHOLD, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """One row per row of ``docs``: id, tk (text key), class_id, class_size, representative (the class
    keeps one text key of one id: true on that text's rows) and n_links (verified links of its text).

    ``class_id`` is the smallest id of the class, ``representative`` marks the rows with that id and
    the smallest text key.
    """
    source = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    kind = source.schema["id"].dataType.simpleString()
    keyed = source.select("id", _text_key().alias("tk"), "text")
    key_type = "struct<x:bigint,y:bigint>"
    signed = write(keyed.mapInArrow(lambda it: sign(it, shingle, bands, rows),
                                    f"id {kind}, tk {key_type}, fp binary, bands array<bigint>, size bigint"), "signatures")
    nodes = write(signed.filter("fp is not null").groupBy("fp")
                  .agg(F.min(F.struct(F.col("id").isNull().alias("none"), "id", "tk")).alias("best"),
                       F.first("bands").alias("bands"), F.first("size").alias("size"), F.count("*").alias("copies"))
                  .select(F.monotonically_increasing_id().alias("node"), "fp", "best.id", "best.tk", "bands", "size", "copies"),
                  "nodes")
    entries = nodes.select("node", F.explode("bands").alias("key"))
    sizes = write(entries.groupBy("key").agg(F.count("*").alias("n")).filter("n > 1"), "buckets")
    shared = write(entries.join(sizes, "key"), "shared")
    score = write(shared.groupBy("node").agg(F.sum("n").alias("score")), "scores")
    texts = _texts(score, nodes, keyed)
    left = write(shared.select("key", "node").join(score, "node"), "members")
    links = classes = None
    for _ in range(ROUNDS):
        hubs = write(left.groupBy("key").agg(F.max(F.struct("score", "node")).alias("hub"), F.count("*").alias("n"))
                     .filter("n > 1").select("key", F.col("hub.node").alias("hub")), "hubs")
        met = left.join(hubs, "key").filter("node != hub")
        if links is not None:
            met = _of_other_classes(met, classes)
        pairs = met.select(F.least("node", "hub").alias("a"), F.greatest("node", "hub").alias("b")).distinct()
        if links is not None:
            pairs = pairs.join(tried, ["a", "b"], "left_anti")
        found = write(_verify(pairs, texts, shingle), "pairs")
        new = found.filter(F.col("similarity") >= threshold)
        if links is None:
            first = hubs
        tried = found if links is None else tried.unionByName(found)
        links = new if links is None else links.unionByName(new)
        if new.isEmpty():
            break
        classes = _joined(new, classes)
        left = write(_of_other_classes(left.join(hubs, "key").filter("node != hub"), classes)
                     .select("key", "node", "score"), "members")
        if left.isEmpty():
            break
    rest = _unmet(shared, nodes, classes, first, texts, shingle, threshold).join(tried, ["a", "b"], "left_anti")
    new = write(_verify(rest, texts, shingle), "pairs").filter(F.col("similarity") >= threshold)
    if not new.isEmpty():
        links, classes = links.unionByName(new), _joined(new, classes)
    return _classes(signed, nodes, links, classes)


def _joined(new: DataFrame, classes: DataFrame | None) -> DataFrame:
    """Classes (node, component) of the links ``new`` and of the classes so far."""
    base = new.select("a", "b")
    if classes is not None:
        base = base.unionByName(classes.select(F.col("node").alias("a"), F.col("component").alias("b")))
    return write(connected_components(base), "classes")


def _of_other_classes(met: DataFrame, classes: DataFrame) -> DataFrame:
    """Rows (key, node, hub, ...) whose node and hub are not yet in one class."""
    own = classes.select("node", F.col("component").alias("own"))
    its = classes.select(F.col("node").alias("hub"), F.col("component").alias("its"))
    return (met.join(own, "node", "left").join(its, "hub", "left")
            .filter(~F.coalesce(F.col("own"), F.col("node")).eqNullSafe(F.coalesce(F.col("its"), F.col("hub"))))
            .drop("own", "its"))


def _unmet(shared: DataFrame, nodes: DataFrame, classes: DataFrame | None, hubs: DataFrame, texts: DataFrame,
           shingle: int, threshold: float) -> DataFrame:
    """Pairs (a, b) of different classes that may be links by the prefix filter, among members of buckets of several classes.

    Posts of a token's largest class only meet those outside it.
    """
    if classes is None:
        classes = nodes.sparkSession.createDataFrame([], "node bigint, component bigint")
    met = write(shared.select("key", "node").join(hubs, "key").filter("node != hub").join(classes, "node", "left")
                .select("key", "node", F.coalesce("component", "node").alias("component")), "met")
    mixed = met.groupBy("key").agg(F.min("component").alias("low"), F.max("component").alias("high")).filter("low != high")
    members = write(met.join(mixed.select("key"), "key").select("node", "component").distinct()
                    .join(nodes.select("node", "size"), "node"), "mixed")
    rows = write(texts.join(members.select("node"), "node", "left_semi")
                 .mapInArrow(lambda it: tokens(it, shingle), "node bigint, token bigint"), "tokens")
    post = write(posts(rows, members, threshold), "posts")
    at = ["token", "band"]
    largest = (post.groupBy(*at, "component").agg(F.count("*").alias("n"))
               .groupBy(*at).agg(F.max(F.struct("n", "component")).alias("most"), F.count("*").alias("n"))
               .filter("n > 1").select(*at, F.col("most.component").alias("largest")))
    post = write(post.join(largest, at).withColumn("outside", F.col("component") != F.col("largest")), "met")
    columns = ("node", "size", "component", "outside", "place")
    small = post.filter("not probe").select(*at, *[F.col(c).alias(f"{c}_a") for c in columns])
    large = post.filter("probe").select(*at, *[F.col(c).alias(f"{c}_b") for c in columns])
    whole = F.least(F.col("size_a") - F.col("place_a"), F.col("size_b") - F.col("place_b"))    # shingles they can still share
    near = ((F.col("component_a") != F.col("component_b")) & (F.col("size_a") <= F.col("size_b"))
            & (whole >= (F.col("size_a") + F.col("size_b")) * (threshold / (1 + threshold)) - 1e-6))
    pairs = [x.join(y, [x[c] == y[c] for c in at] + [near])
             for x, y in ((small.filter("outside_a"), large), (small.filter("not outside_a"), large.filter("outside_b")))]
    pairs = [p.select(F.least("node_a", "node_b").alias("a"), F.greatest("node_a", "node_b").alias("b")) for p in pairs]
    return pairs[0].unionByName(pairs[1]).distinct()


def _texts(need: DataFrame, nodes: DataFrame, keyed: DataFrame) -> DataFrame:
    """(node, text) of the nodes of ``need``, written once for all rounds."""
    need = nodes.select("node", "id", F.col("tk.x").alias("x"), F.col("tk.y").alias("y"), "copies").join(need.select("node"), "node")
    need = write(need, "needed")
    rows = keyed.select(F.col("id").alias("id_"), F.col("tk.x").alias("x"), F.col("tk.y").alias("y"), "text")
    own = rows.join(need.hint("merge"), (rows.x == need.x) & (rows.y == need.y) & rows.id_.eqNullSafe(need.id))
    more = own.filter("copies > 1").select("node", "text").dropDuplicates(["node"])                # a row may repeat
    return write(own.filter("copies = 1").select("node", "text").unionByName(more), "texts")


def _with_texts(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """(a, b, text_a, text_b); only the texts of nodes in a pair are shuffled."""
    need = pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    own = texts.join(need, "node", "left_semi")
    return (pairs.join(own.select(F.col("node").alias("a"), F.col("text").alias("text_a")), "a")
            .join(own.select(F.col("node").alias("b"), F.col("text").alias("text_b")), "b")
            .select("a", "b", "text_a", "text_b"))


def _verify(pairs: DataFrame, texts: DataFrame, shingle: int) -> DataFrame:
    """Exact similarity of node pairs."""
    return (_with_texts(write(pairs, "candidates"), texts)
            .mapInArrow(lambda it: compare(it, shingle), "a bigint, b bigint, similarity double"))


def _classes(signed: DataFrame, nodes: DataFrame, links: DataFrame, classes: DataFrame | None) -> DataFrame:
    spark = signed.sparkSession
    if classes is None:
        classes = spark.createDataFrame([], "node bigint, component bigint")
    degree = (links.select("a", "b").distinct().select(F.explode(F.array("a", "b")).alias("node"))
              .groupBy("node").agg(F.count("*").alias("n_links")))
    of = write(nodes.select("node", "fp", "id", "tk", "copies").join(classes, "node", "left").join(degree, "node", "left")
               .withColumn("component", F.coalesce("component", "node")), "of")
    best = (of.groupBy("component")
            .agg(F.min(F.struct(F.col("id").isNull().alias("none"), "id", "tk")).alias("best"),
                 F.sum("copies").alias("class_size")))
    best = write(best, "best")
    fate = write(of.join(best, "component")
                 .select("fp", F.col("best.id").alias("class_id"), F.col("best.tk").alias("best_tk"), "class_size",
                         F.coalesce("n_links", F.lit(0)).cast("bigint").alias("n_links")), "fate")
    alone = signed.filter("fp is null").select(
        "id", "tk", F.col("id").alias("class_id"), F.lit(1).cast("bigint").alias("class_size"),
        F.lit(True).alias("representative"), F.lit(0).cast("bigint").alias("n_links"))
    return (signed.filter("fp is not null").select("id", "tk", "fp").join(fate, "fp")
            .select("id", "tk", "class_id", "class_size",
                    (F.col("id").eqNullSafe(F.col("class_id")) & (F.col("tk") == F.col("best_tk"))).alias("representative"),
                    "n_links")
            .unionByName(alone))


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """``docs`` with one row of every class: that with the smallest id; all columns as they were.

    Of rows with that id and equal text one stays.  Rows without words all stay.
    """
    fate = near_duplicates(docs, id_col, text_col, **options).filter("representative")
    keys = write(fate.groupBy("id", "tk").agg(F.count("*").alias("rows_"), F.max("class_size").alias("size_"))
                 .select("id", F.col("tk.x").alias("x_"), F.col("tk.y").alias("y_"),
                         ((F.col("rows_") > 1) & (F.col("size_") > 1)).alias("repeated_")), "keep")
    row = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    tk = _text_key(f"row.`{text_col}`")
    hit = row.join(keys, F.col(f"row.`{id_col}`").eqNullSafe(keys["id"]) & (tk["x"] == keys["x_"]) & (tk["y"] == keys["y_"]))
    once = hit.filter("repeated_").dropDuplicates(["id", "x_", "y_"])
    return hit.filter("not repeated_").unionByName(once).select("row.*")
