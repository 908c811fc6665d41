"""Near-duplicates by BagMinHash signatures of word shingles, with verified overlap.

A document is the multiset of its runs of five words. Every distinct shingle has a Poisson
process over the weight axis, built hierarchically: the axis is cut at 1, 2, 4, 8, ..., each piece
has its first point, and a piece is halved only while its first point can still lower the
signature, down to weights of one. A document sees the points below its counts, so two
signatures agree in a place with a probability equal to the weighted Jaccard similarity.

Bands of the signature propose pairs. Documents with equal multisets are one node first. In every
bucket the nodes are compared with a few representatives, never all with each other. The nodes
of buckets that then hold more than one class are dealt out anew by the rarest shingles of each,
of which two similar documents share at least one, and meet other representatives there in
turns until a turn links nothing. Then all pairs of different classes that still share a rare
shingle meet, except those whose sizes or places of the shingle rule the overlap out. Proposed pairs
are verified on the full multisets; classes are the connected components of the links.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from clinicflow.llm.arrays import GOLDEN, mix, slices, text_bytes, words
from clinicflow.llm.shared import forget, held, text_of, whole, written

SHINGLE = 5
SIMILARITY = 0.8
# 25 bands of 5 places: a pair at 0.8 shares no band with a probability of 5e-5.
BANDS, ROWS = 25, 5
PLACES = 128
# Nodes of a bucket that the others are compared with in one round.
REPRESENTATIVES = 3
# Nodes of a bucket that meet all others as one block in one join.
BLOCK = 256
# Points drawn per process and round while few processes are open.
BURST = 32


def shingles(batch: pa.RecordBatch, column: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document, shingle, count) of a slice, sorted. A text of fewer words is one shingle."""
    w = words(*text_bytes(batch.column(column)))
    hashes = w.hashes()
    n_words = np.diff(w.first)
    n_shingles = np.where(n_words > 0, np.maximum(n_words - SHINGLE + 1, 1), 0)
    owner = np.repeat(np.arange(len(n_words)), n_shingles)
    start = np.arange(len(owner)) - np.repeat(np.cumsum(n_shingles) - n_shingles - w.first[:-1], n_shingles)
    size = np.minimum(n_words, SHINGLE)[owner]
    total = np.zeros(len(owner), np.uint64)
    with np.errstate(over="ignore"):
        for k in range(SHINGLE):
            inside = k < size
            part = hashes[np.minimum(start + k, len(hashes) - 1)] + np.uint64(k + 1) if len(hashes) else total
            total = np.where(inside, mix(total * GOLDEN + part), total)
    # One sort of document number and 44 bits of the hash; a slice has fewer than 2^20 texts.
    key = np.sort(owner.astype(np.uint64) << np.uint64(44) | total >> np.uint64(20))
    new = np.ones(len(key), bool)
    new[1:] = key[1:] != key[:-1]
    at = np.flatnonzero(new)
    key = key[at]
    element = mix(key & np.uint64((1 << 44) - 1))
    return (key >> np.uint64(44)).astype(np.int64), element, np.diff(np.append(at, len(owner)))


def _uniform(bits: np.ndarray) -> np.ndarray:
    """Numbers in (0, 1] from the upper 53 bits."""
    return ((bits >> np.uint64(11)).astype(float) + 1) * 2.0**-53


def _seed(element: np.ndarray, low: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The random state of a piece (low, low + size] of an element's weight axis."""
    place = low.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93) + size.astype(np.uint64)
    return mix(element ^ mix(place * GOLDEN))


def signatures(owner: np.ndarray, element: np.ndarray, count: np.ndarray, n_docs: int) -> np.ndarray:
    """BagMinHash signatures: for each document and place the earliest point that it sees there."""
    with np.errstate(over="ignore"):
        out = np.full((n_docs, PLACES), np.inf)
        flat = out.reshape(-1)
        # Pieces (0, 1], (1, 2], (2, 4], ... up to the count, each with its first point.
        doc, low, size = owner, np.zeros(len(owner), np.int64), np.ones(len(owner), np.int64)
        index, more = [np.arange(len(owner))], np.flatnonzero(count > 1)
        lows, sizes, edge = [low], [size], 1
        while len(more):
            index.append(more)
            lows.append(np.full(len(more), edge))
            sizes.append(np.full(len(more), edge))
            edge *= 2
            more = more[count[more] > edge]
        index, low, size = np.concatenate(index), np.concatenate(lows), np.concatenate(sizes)
        doc, element, count = owner[index], element[index], count[index]
        seed = _seed(element, low, size)
        time = -np.log(_uniform(seed)) / size
        drawn = np.zeros(len(doc), np.uint64)
        latest = out.max(axis=1)
        while len(doc):
            keep = time < latest[doc]
            doc, element, count, low, size, seed, time, drawn = (
                x[keep] for x in (doc, element, count, low, size, seed, time, drawn)
            )
            unit = size == 1
            parts = []
            if not unit.all():
                # A half that holds the first point inherits it; the other one waits on from there.
                d, e, c, lo, half, s, t = (x[~unit] for x in (doc, element, count, low, size // 2, seed, time))
                right = (mix(s + GOLDEN) & np.uint64(1)).astype(bool)
                for upper in (False, True):
                    begin = lo + half * upper
                    own = _seed(e, begin, half)
                    first = np.where(right == upper, t, t - np.log(_uniform(own)) / half)
                    seen = begin < c
                    parts.append([x[seen] for x in (d, e, c, begin, half, own, first, np.zeros(len(d), np.uint64))])
            u = [x[unit] for x in (doc, element, count, low, size, seed, time, drawn)]
            d, s, t, k = u[0], u[5], u[6], u[7]
            for _ in range(BURST if len(d) < 20_000 else 1):
                bits = mix(s + (k * np.uint64(2) + np.uint64(1)) * GOLDEN)
                np.minimum.at(flat, d * PLACES + (bits & np.uint64(PLACES - 1)).astype(np.int64), t)
                k = k + np.uint64(1)
                t = t - np.log(_uniform(mix(s + k * np.uint64(2) * GOLDEN)))
            u[6], u[7] = t, k
            parts.append(u)
            doc, element, count, low, size, seed, time, drawn = (
                np.concatenate(x) for x in zip(*parts, strict=True)
            )
            latest = out.max(axis=1)
        return out


def bands(signature: np.ndarray) -> np.ndarray:
    """The bucket keys of each signature; the number of the band is part of the key."""
    with np.errstate(over="ignore"):
        bits = signature.view(np.uint64)
        keys = np.empty((len(signature), BANDS), np.uint64)
        for b in range(BANDS):
            key = np.full(len(signature), b + 1, np.uint64)
            for r in range(ROWS):
                key = mix(key * GOLDEN + bits[:, b * ROWS + r])
            keys[:, b] = key
        return keys.view(np.int64)


def _lists(values: np.ndarray, sizes: np.ndarray, kind: pa.DataType) -> pa.Array:
    offsets = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
    return pa.ListArray.from_arrays(offsets, pa.array(values, kind))


def _sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held(None)
    for batch in slices(batches):
        owner, element, count = shingles(batch, "_text")
        n = batch.num_rows
        with np.errstate(over="ignore"):
            # Equal multisets have equal sums; two sums make 128 bits.
            sums = []
            for salt in (1, 2):
                total = np.zeros(n, np.uint64)
                np.add.at(total, owner, mix(element + np.uint64(salt) * GOLDEN) * count.astype(np.uint64))
                sums.append(total.view(np.int64))
        sizes = np.bincount(owner, minlength=n)
        filled = sizes > 0
        keys = np.zeros((n, BANDS), np.int64)
        keys[filled] = bands(signatures(owner, element, count, n)[filled])
        yield pa.RecordBatch.from_arrays(
            [
                *(batch.column(c) for c in ("doc_id", "h1", "h2")),
                pa.array(sums[0]),
                pa.array(sums[1]),
                pa.array(np.bincount(owner, count, n).astype(np.int64)),
                _lists(keys[filled].reshape(-1), filled * BANDS, pa.int64()),
            ],
            ["doc_id", "h1", "h2", "bag1", "bag2", "size", "keys"],
        )


def _bags(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The multiset of every text as sorted 32-bit numbers; repeats of a shingle are numbered apart."""
    for batch in slices(batches):
        owner, element, count = shingles(batch, "_text")
        repeat = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
        with np.errstate(over="ignore"):
            tagged = mix(np.repeat(element, count) + repeat.astype(np.uint64) * GOLDEN) >> np.uint64(32)
        owner = np.repeat(owner, count)
        tagged = np.sort(owner.astype(np.uint64) << np.uint64(32) | tagged).astype(np.uint32)
        offsets = (np.searchsorted(owner, np.arange(batch.num_rows + 1)) * 4).astype(np.int32)
        packed = pa.Array.from_buffers(
            pa.binary(), batch.num_rows, [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(tagged.tobytes())]
        )
        yield pa.RecordBatch.from_arrays(
            [*(batch.column(c) for c in ("doc_id", "h1", "h2")), packed], ["doc_id", "h1", "h2", "bag"]
        )


def _similar(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        linked = np.zeros(batch.num_rows, bool)
        for k, (a, b) in enumerate(zip(batch.column("bag_a"), batch.column("bag_b"), strict=True)):
            x = np.frombuffer(a.as_buffer(), np.uint32)
            y = np.frombuffer(b.as_buffer(), np.uint32)
            least, most = sorted((len(x), len(y)))
            if least >= SIMILARITY * most:
                both = np.concatenate([x, y])
                both.sort(kind="stable")
                common = int((both[1:] == both[:-1]).sum())
                linked[k] = common >= SIMILARITY * (len(x) + len(y) - common)
        ends = [batch.column("label_a"), batch.column("label_b")]
        yield pa.RecordBatch.from_arrays(ends, ["label_a", "label_b"]).filter(pa.array(linked))


def _identified(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """doc_id, two hashes of the text, and the text of every row."""
    value = text_of(text)
    return docs.select(
        F.col(doc_id).alias("doc_id"),
        F.xxhash64(value).alias("h1"),
        F.xxhash64(F.lit(1), value).alias("h2"),
        value.alias("_text"),
    )


ROW = ("doc_id", "h1", "h2")


def components(edges: DataFrame) -> DataFrame:
    """(node, label) of every node of the edges (a, b): the label is the least node it is connected to.

    Labels spread along edges and then jump to the label of the label, so chains shorten by
    half in each round. Every round is a written table.
    """
    both = written(edges.union(edges.select("b", "a")).distinct())
    labels = written(both.groupBy(F.col("a").alias("node")).agg(F.min(F.least("a", "b")).alias("label")))
    while True:
        near = both.join(labels, F.col("b") == F.col("node")).groupBy("a").agg(F.min("label").alias("near"))
        spread = labels.join(near, F.col("node") == F.col("a")).select(
            "node", "label", F.least("label", "near").alias("next")
        )
        jump = labels.select(F.col("node").alias("next"), F.col("label").alias("further"))
        moved = written(
            spread.join(jump, "next").select("node", F.least("next", "further").alias("label"), F.col("label").alias("was"))
        )
        labels = moved.select("node", "label")
        if moved.filter("label <> was").count() == 0:
            return labels


def _node_bags(docs: DataFrame, nodes: DataFrame, keys: DataFrame) -> DataFrame:
    """(node, bag) of the nodes in shared buckets."""
    columns = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in docs.schema if f.name != "_text")
    texts = docs.mapInArrow(_bags, f"{columns}, bag binary").alias("t")
    asked = keys.select("node").distinct().join(nodes.select("node", *ROW), "node").alias("n")
    same = [F.col(f"n.{c}").eqNullSafe(F.col(f"t.{c}")) for c in ROW]
    found = asked.join(texts, same[0] & same[1] & same[2]).select("node", "bag")
    return written(found.dropDuplicates(["node"]))


def _verified(pairs: DataFrame, bags: DataFrame) -> DataFrame:
    """The labels of those pairs (a, b, label_a, label_b) whose multisets overlap enough."""
    a = bags.select(F.col("node").alias("a"), F.col("bag").alias("bag_a"))
    b = bags.select(F.col("node").alias("b"), F.col("bag").alias("bag_b"))
    both = pairs.join(a, "a").join(b, "b").select("a", "b", "label_a", "label_b", "bag_a", "bag_b")
    return both.mapInArrow(_similar, "label_a bigint, label_b bigint")


def _elements(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for node, bag in zip(batch.column("node").to_pylist(), batch.column("bag"), strict=True):
            own = np.frombuffer(bag.as_buffer(), np.uint32).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(own), node)), pa.array(own)], ["node", "key"])


def _prefixes(bags: DataFrame) -> DataFrame:
    """(key, node, size, place): the shared ones among the rarest shingles of each node, with their rank.

    Two bags of which the one with n shingles shares at least 0.8 n with the other have a shingle in
    common among the n - ceil(0.8 n) + 1 rarest of each.
    """
    rows = bags.mapInArrow(_elements, "node bigint, key bigint")
    counts = rows.groupBy("key").agg(F.count(F.lit(1)).alias("n"))
    own = Window.partitionBy("node")
    size = F.count(F.lit(1)).over(own)
    ranked = rows.join(counts, "key").select(
        "key", "node", "n", size.alias("size"), F.row_number().over(own.orderBy("n", "key")).alias("place")
    )
    longest = F.col("size") - F.ceil(F.col("size") * SIMILARITY) + 1
    return written(ranked.filter((F.col("place") <= longest) & (F.col("n") > 1)).select("key", "node", "size", "place"))


def _representatives(keys: DataFrame, turn: int) -> DataFrame:
    """For each key a few nodes, as key and an array of (node, label).

    In turn 0 one is the node with the fewest shingles: documents that share no more than a
    common passage are linked to each other only if they are linked to the shortest of them. In
    buckets of rare shingles another one has the least place, as the original of edited copies has
    no shingles of its own before the shared ones. The others have the least hash, another one in
    every turn.
    """
    chosen = []
    for k in range(REPRESENTATIVES):
        least = F.xxhash64(F.lit(turn * REPRESENTATIVES + k), "node")
        if turn == 0 and k < 2 and ("size", "place")[k] in keys.columns:
            least = F.col(("size", "place")[k])
        chosen.append(F.min(F.struct(least.alias("least"), "node", "label")))
    first = keys.groupBy("key").agg(F.array(*chosen).alias("chosen"))
    ends = F.transform("chosen", lambda c: F.struct(c["node"].alias("node"), c["label"].alias("label")))
    return first.select("key", F.array_distinct(ends).alias("chosen"))


def _labelled(keys: DataFrame, labels: DataFrame | None) -> DataFrame:
    """The keys with the class of each node, which is itself until it is linked."""
    if labels is None:
        return keys.withColumn("label", F.col("node"))
    return keys.join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))


def _met(keys: DataFrame, labels: DataFrame | None, turn: int) -> DataFrame:
    """The pairs (a, b, label_a, label_b) of every node and the representatives of its buckets."""
    known = _labelled(keys, labels)
    met = known.join(_representatives(known, turn), "key").select("node", "label", F.explode("chosen").alias("c"))
    return _pairs(met.filter("label <> c.label"), "node", "label", "c.node", "c.label")


def _pairs(rows: DataFrame, a: str, label_a: str, b: str, label_b: str) -> DataFrame:
    return rows.select(
        F.least(a, b).alias("a"),
        F.greatest(a, b).alias("b"),
        F.least(label_a, label_b).alias("label_a"),
        F.greatest(label_a, label_b).alias("label_b"),
    ).distinct()


def _unmet(finer: DataFrame, labels: DataFrame | None) -> DataFrame:
    """All pairs (a, b, label_a, label_b) of different classes in a bucket that may overlap enough.

    Nodes outside the largest class of a bucket meet all its nodes, block by block, so a bucket is
    not the work of one task. At the first shingle that two nodes share, what follows it bounds what
    they have in common; a pair that is ruled out there or by its sizes is not alike.
    """
    known = written(_labelled(finer, labels))
    counts = known.groupBy("key", "label").agg(F.count(F.lit(1)).alias("n"))
    mixed = (
        counts.groupBy("key")
        .agg(F.max(F.struct("n", "label")).alias("most"), F.sum("n").alias("n"))
        .filter("most.n < n")
        .select(
            "key",
            F.col("most.label").alias("most"),
            F.ceil((F.col("n") - F.col("most.n")) / BLOCK).alias("others"),
            F.ceil(F.col("n") / BLOCK).alias("all"),
        )
    )
    rows = known.join(mixed, "key").withColumns(
        {
            # Sizes of similar nodes differ by at most 1 / SIMILARITY, so by at most one step.
            "step": F.floor(F.log("size") / F.log(F.lit(1.01 / SIMILARITY))),
            "hash": F.xxhash64("node"),
        }
    )
    steps = F.explode(F.array(*(F.col("step") + d for d in (-1, 0, 1)))).alias("step")
    blocks = ["key", "step", "block_a", "block_b"]
    own = ("node", "label", "size", "place")
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("bigint"), F.col(n) - 1))
    left = (
        rows.filter("label <> most")
        .withColumn("block_a", F.pmod("hash", "others"))
        .withColumn("block_b", every("all"))
        .select("key", steps, "block_a", "block_b", *(F.col(c).alias(f"{c}_a") for c in own))
    )
    right = (
        rows.withColumn("block_b", F.pmod("hash", "all"))
        .withColumn("block_a", every("others"))
        .select(*blocks, "most", *(F.col(c).alias(f"{c}_b") for c in own))
    )
    # Two nodes outside the largest class meet twice.
    once = (F.col("label_b") == F.col("most")) | (F.col("node_a") < F.col("node_b"))
    common = 1 + F.least(F.col("size_a") - F.col("place_a"), F.col("size_b") - F.col("place_b"))
    enough = common * (1 + SIMILARITY) + 1e-6 >= (F.col("size_a") + F.col("size_b")) * SIMILARITY
    met = left.join(right, blocks).filter((F.col("label_a") != F.col("label_b")) & once & enough)
    return _pairs(met, "node_a", "label_a", "node_b", "label_b")


def _joined(pairs: DataFrame, bags: DataFrame, labels: DataFrame | None) -> DataFrame | None:
    """New labels after the pairs (a, b, label_a, label_b) met; None if nothing was linked."""
    links = written(_verified(pairs, bags).distinct())
    forget(links.sparkSession)
    if links.count() == 0:
        return None
    # Classes are joined as a graph of their labels, which is small after the first turn.
    joined = components(links.select(F.col("label_a").alias("a"), F.col("label_b").alias("b")))
    if labels is None:
        return joined
    own = joined.select("node", F.col("node").alias("label")).join(labels, "node", "left_anti")
    new = joined.select(F.col("node").alias("label"), F.col("label").alias("further"))
    both = labels.unionByName(own).join(new, "label", "left")
    return written(both.select("node", F.coalesce("further", "label").alias("label")))


def _labels(docs: DataFrame, nodes: DataFrame, keys: DataFrame) -> DataFrame:
    """(node, label): the class of every node that is linked to another."""
    bags = _node_bags(docs, nodes, keys)
    labels = _joined(_met(keys, None, 0), bags, None)
    # Where a bucket holds several classes, two of its nodes may be alike that no representative is
    # like. There the rare shingles that such nodes must share make finer buckets.
    mixed = _labelled(keys, labels).groupBy("key").agg(F.min("label").alias("l"), F.max("label").alias("h"))
    unsure = keys.join(mixed.filter("l <> h").select("key"), "key", "left_semi").select("node").distinct()
    finer = _prefixes(bags.join(unsure, "node", "left_semi"))
    turn = 0
    while (more := _joined(_met(finer, labels, turn), bags, labels)) is not None:
        labels, turn = more, turn + 1
    # No turn proves that a bucket holds no more links; the pairs that have not met do.
    labels = _joined(_unmet(finer, labels), bags, labels) or labels
    forget(docs.sparkSession)
    if labels is None:
        return keys.select("node", F.col("node").alias("label")).limit(0)
    return labels


def classes(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, h1, h2 (hashes of the text), class_id, class_size, kept: one row per document."""
    docs = _identified(docs, doc_id, text)
    id_type = docs.schema["doc_id"].dataType.simpleString()
    sketches = docs.mapInArrow(
        _sketch,
        f"doc_id {id_type}, h1 bigint, h2 bigint, bag1 bigint, bag2 bigint, size bigint, keys array<bigint>",
    )
    rows = written(sketches.withColumn("row", F.monotonically_increasing_id()))
    # Texts without words have no shingles; they are only equal to the same text.
    bag = [F.when(F.col("size") > 0, F.col(b)).otherwise(F.col(h)).alias(b) for b, h in (("bag1", "h1"), ("bag2", "h2"))]
    members = rows.select("row", *ROW, *bag, "size")
    equal = written(members.groupBy("bag1", "bag2", "size").agg(F.min("row").alias("node")))
    nodes = equal.select("node").join(rows, F.col("node") == F.col("row")).select("node", *ROW, "size", "keys")
    all_keys = nodes.select("node", "size", F.explode("keys").alias("key"))
    shared = all_keys.groupBy("key").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("key")
    keys = written(all_keys.join(shared, "key").select("key", "node", "size"))
    labels = _labels(docs, nodes, keys)
    placed = members.join(equal, ["bag1", "bag2", "size"]).select("row", *ROW, "node")
    placed = placed.join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row"))
    best = placed.groupBy("label").agg(first.alias("first"), F.count(F.lit(1)).alias("class_size"))
    return placed.join(best, "label").select(
        *ROW,
        F.col("first.doc_id").alias("class_id"),
        "class_size",
        (F.col("row") == F.col("first.row")).alias("kept"),
    )


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: doc_id, class_id, class_size, kept.

    Two documents are linked if the multisets of their runs of five words (of 0-9, a-z with A-Z
    lower-cased, and characters beyond ASCII) overlap by at least 0.8 (weighted Jaccard). A text
    of one to four words is one run; a text without words, null and empty ones included, is linked
    to equal texts only. class_id is the least doc_id of a class, and of each class one row is
    kept: the one with that id. Null ids come last; of repeated rows one is kept. Other columns are
    not read. No rows give no rows.
    """
    return classes(docs, doc_id, text).select("doc_id", "class_id", "class_size", "kept")


def drop_near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row of `docs` of each class, with all its columns."""
    kept = classes(docs, doc_id, text).filter("kept").select(*ROW).alias("k")
    value = text_of(text)
    tagged = docs.select(
        whole(docs),
        F.col(doc_id).alias("_id"),
        F.xxhash64(value).alias("_h1"),
        F.xxhash64(F.lit(1), value).alias("_h2"),
    )
    same = F.col("_id").eqNullSafe(F.col("k.doc_id")) & (F.col("_h1") == F.col("k.h1")) & (F.col("_h2") == F.col("k.h2"))
    # Repeated rows are equal in id and text; the join has brought them together.
    return tagged.join(kept, same, "left_semi").dropDuplicates(["_id", "_h1", "_h2"]).select("_doc.*")
