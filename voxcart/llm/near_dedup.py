"""Near-duplicates by MinHash: banding, signature check, exact check, components.

A document's set holds the hashes of its distinct runs of five words.  Two documents
are linked if their sets have a Jaccard similarity of at least 0.75, which is decided
on full sets.  What is found here are the components of that relation.

1. Sketch.  Each text gives ``BANDS * ROWS`` minima of universal hash functions
   (``a * x + b`` modulo 2**32).  ``ROWS`` minima make a band; the signature keeps one
   byte of each minimum.  Texts with equal sets form a class, and only the class's
   smallest doc_id goes on.
2. Buckets.  Classes that share a band are in a bucket.  Within a bucket, members are
   compared with hubs (the members of smallest salted hash), never all with all.
3. Checks.  Pairs whose signatures agree too little are dropped: ``LEAST_AGREEMENT``
   lies more than five standard errors below the bound.  All others are decided by
   their full sets, built again from their texts.
4. Components of the links, by alternating large-star and small-star.
5. The rest.  A bucket whose members lie in one component is done.  In others, pairs of
   different components remain.  Small buckets compare them all.  Larger ones form
   groups around their most central members, and what a member has other than its hub
   decides: with ``r`` runs of the hub's ``h`` gone and ``a`` new ones, members x and y
   are linked if and only if ``q(x) + q(y) <= h + 7 * s``, where ``q = 4 * r + 3 * a`` and
   ``s`` counts the differences that they share.  A member that is not linked to its hub
   has ``q > h``, so its partners share a known number of differences with it, and a
   prefix of each member's differences, rarest first, finds them.  So no pair that
   shares a band goes unchecked, unless it is connected already.

A pair of similarity 0.75 shares no band with probability (1 - 0.75**6)**64 = 4e-6.

Defined results: a NULL or empty text, or one of white space only, has an empty set
and no links; a text of fewer than five words is one run; a row without doc_id has no
links, a NULL component and is kept; rows of one doc_id are decided each by its own text,
equal ones alike; an empty table gives no rows; further columns are not looked at.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxcart.llm.common import arrow_rows, fresh, scratch_scope, written

SHINGLE = 5
BANDS = 64
ROWS = 6
HUBS = 4
# Buckets up to this size compare all pairs that are still apart.
SMALL_BUCKET = 32
LEAST_AGREEMENT = 0.64
SEED = 20240229
# Differences held by one in so many members of a group are told apart by their counts.
FREQUENT = 16
# Set sizes that are hashed at once; longer sets go in several steps.
STEP = 512
# Rows with whole texts that go to Python at once.
TEXT_ROWS = 256
# Sets that a task remembers while it compares.
KNOWN = 64

_MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)
_BASE = np.uint64(0x100000001B3)


def _functions(count: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(SEED)
    odd = rng.integers(0, 1 << 31, count, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
    return odd[:, None], rng.integers(0, 1 << 32, count, dtype=np.uint64).astype(np.uint32)[:, None]


class _Powers:
    """Powers of the base modulo 2**64 and of its inverse, as far as texts have needed."""

    def __init__(self) -> None:
        self.up = self.down = np.ones(1, dtype=np.uint64)

    def get(self, size: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < size:
            inverse = np.uint64(pow(int(_BASE), -1, 1 << 64))
            count = max(size, 1 << 16)
            self.up, self.down = (
                np.cumprod(np.concatenate([[np.uint64(1)], np.full(count, b, dtype=np.uint64)]))
                for b in (_BASE, inverse)
            )
        return self.up[:size], self.down[:size]


_POWERS = _Powers()


def _mix(x: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit hashes."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingles(text: str | None) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the runs of five words."""
    # bytes: lower() changes A-Z alone, split() cuts at ASCII white space alone.
    words = (text or "").encode("utf-8").lower().split()
    if not words:
        return np.empty(0, dtype=np.uint64)
    joined = np.frombuffer(b" ".join(words), dtype=np.uint8)
    size = len(joined)
    up, down = _POWERS.get(size + 1)
    sums = np.zeros(size + 1, dtype=np.uint64)
    np.cumsum((joined.astype(np.uint64) + np.uint64(1)) * up[:size], out=sums[1:])
    gaps = np.flatnonzero(joined == 32)
    starts = np.concatenate([[0], gaps + 1])
    ends = np.concatenate([gaps, [size]])
    runs = max(1, len(starts) - SHINGLE + 1)
    first, last = starts[:runs], ends[-runs:]
    hashes = (sums[last] - sums[first]) * down[first]
    return np.unique(_mix(hashes + (last - first).astype(np.uint64) * _MULTIPLIER))


def minima(shingle_set: np.ndarray, count: int = BANDS * ROWS) -> np.ndarray:
    """The least value of each universal hash function over a set that is not empty."""
    odd, shift = _FUNCTIONS if count == BANDS * ROWS else _functions(count)
    low = np.full(count, np.iinfo(np.uint32).max, dtype=np.uint32)
    values = (shingle_set >> np.uint64(32)).astype(np.uint32)
    for at in range(0, len(values), STEP):
        hashed = values[None, at : at + STEP] * odd
        hashed += shift
        np.minimum(low, hashed.min(axis=1), out=low)
    return low


_FUNCTIONS = _functions(BANDS * ROWS)


def band_hashes(low: np.ndarray) -> np.ndarray:
    """One 64-bit hash for each band of minima."""
    rows = low.reshape(BANDS, ROWS).astype(np.uint64)
    total = np.arange(1, BANDS + 1, dtype=np.uint64) * _MULTIPLIER
    for r in range(ROWS):
        total = _mix(total + rows[:, r] * _MULTIPLIER + np.uint64(r + 1))
    return total.view(np.int64)


def sketch(docs: DataFrame) -> DataFrame:
    """``doc_id, n_shingles, set_digest, bands, signature``; NULLs for an empty set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, digests, bands, signatures = [], [], [], []
            for text in batch.column(1):
                own = shingles(text.as_py())
                sizes.append(len(own))
                if len(own):
                    low = minima(own)
                    digests.append(hashlib.blake2b(own.tobytes(), digest_size=16).digest())
                    bands.append(band_hashes(low))
                    signatures.append((low >> np.uint32(11)).astype(np.uint8).tobytes())
                else:
                    digests.append(None)
                    bands.append(None)
                    signatures.append(None)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    pa.array(sizes, pa.int64()),
                    pa.array(digests, pa.binary()),
                    pa.array(bands, pa.list_(pa.int64())),
                    pa.array(signatures, pa.binary()),
                ],
                ["doc_id", "n_shingles", "set_digest", "bands", "signature"],
            )

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(
        run,
        "doc_id long, n_shingles long, set_digest binary, bands array<long>, signature binary",
    )


def _agree(pairs: DataFrame, classes: DataFrame) -> DataFrame:
    """The pairs ``a, b`` whose signatures agree often enough."""
    signatures = classes.select("node", "signature")
    joined = (
        pairs.join(signatures.toDF("a", "signature_a"), "a")
        .join(signatures.toDF("b", "signature_b"), "b")
        .select("a", "b", "signature_a", "signature_b")
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sides = [
                np.frombuffer(b"".join(batch.column(c).to_pylist()), dtype=np.uint8).reshape(
                    batch.num_rows, -1
                )
                for c in (2, 3)
            ]
            enough = (sides[0] == sides[1]).mean(axis=1) >= LEAST_AGREEMENT
            yield batch.select(["a", "b"]).filter(pa.array(enough))

    return joined.mapInArrow(run, "a long, b long")


def _linked(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """The pairs ``a, b`` whose full sets are similar enough."""
    joined = (
        pairs.join(texts.toDF("a", "text_a"), "a")
        .join(texts.toDF("b", "text_b"), "b")
        .select("a", "b", "text_a", "text_b")
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[int, np.ndarray] = {}
        for batch in batches:
            kept: list[bool] = []
            for row in range(batch.num_rows):
                sides = []
                for side in (0, 1):
                    node = batch.column(side)[row].as_py()
                    if node not in known:
                        if len(known) >= KNOWN:
                            known.clear()
                        known[node] = shingles(batch.column(2 + side)[row].as_py())
                    sides.append(known[node])
                both = len(np.intersect1d(*sides, assume_unique=True))
                kept.append(100 * both >= 75 * (len(sides[0]) + len(sides[1]) - both))
            yield batch.select(["a", "b"]).filter(pa.array(kept, pa.bool_()))

    return joined.mapInArrow(run, "a long, b long")


def _buckets(nodes: DataFrame) -> DataFrame:
    """``key, node, hub`` of all buckets with more than one member.

    The salt of the hash changes with the key, so that a large group meets up to
    ``HUBS`` different members of itself and not the same one in every bucket.
    """
    members = nodes.select("node", F.explode("bands").alias("key"))
    salted = F.struct(F.xxhash64("node", F.pmod("key", F.lit(HUBS))).alias("h"), "node")
    hubs = (
        members.groupBy("key")
        .agg(F.min(salted).alias("hub"), F.count("*").alias("size"))
        .where("size > 1")
        .select("key", F.col("hub.node").alias("hub"))
    )
    return members.join(hubs, "key")


def _hub_pairs(buckets: DataFrame) -> DataFrame:
    return (
        buckets.where("node != hub")
        .select(F.least("node", "hub").alias("a"), F.greatest("node", "hub").alias("b"))
        .distinct()
    )


def _apart(members: DataFrame, labels: DataFrame) -> DataFrame:
    """Members of buckets that still have more than one component, with ``label``."""
    labelled = members.join(labels, "node", "left").select(
        "key", "node", F.coalesce("label", "node").alias("label")
    )
    mixed = (
        labelled.groupBy("key")
        .agg(F.min("label").alias("low"), F.max("label").alias("high"), F.count("*").alias("size"))
        .where("low != high")
        .select("key", "size")
    )
    return labelled.join(mixed, "key")


def _cross_pairs(members: DataFrame, sizes: DataFrame) -> DataFrame:
    """Pairs of one bucket and different components whose set sizes allow a link."""
    sized = members.join(sizes, "node")
    left = sized.select("key", *(F.col(c).alias(f"{c}_a") for c in ("node", "label", "n_shingles")))
    right = sized.select("key", *(F.col(c).alias(f"{c}_b") for c in ("node", "label", "n_shingles")))
    return (
        left.join(right, "key")
        .where("node_a < node_b AND label_a != label_b")
        .where("4 * least(n_shingles_a, n_shingles_b) >= 3 * greatest(n_shingles_a, n_shingles_b)")
        .select(F.col("node_a").alias("a"), F.col("node_b").alias("b"))
        .distinct()
    )


def _groups(members: DataFrame, labels: DataFrame) -> DataFrame:
    """``hub, node, label, hub_label``: all members of buckets with the hub of each bucket.

    The hub is the member with the most company over all its buckets, so the buckets of
    one large group mostly agree on it.
    """
    company = members.groupBy("node").agg(F.sum("size").alias("company"))
    members = members.join(company, "node")
    hubs = members.groupBy("key").agg(F.max(F.struct("company", "node")).alias("hub"))
    return (
        members.join(hubs.select("key", F.col("hub.node").alias("hub")), "key")
        .where("node != hub")
        .select("hub", "node", "label")
        .distinct()
        .join(labels.toDF("hub", "hub_label"), "hub", "left")
        .withColumn("hub_label", F.coalesce("hub_label", "hub"))
    )


def _differences(groups: DataFrame, texts: DataFrame) -> DataFrame:
    """``hub, node, label, hub_label, hub_size, q, added, items``.

    ``items`` holds the ``added`` runs that the hub lacks, then those that it has alone.
    """
    joined = (
        groups.join(texts.toDF("node", "text"), "node")
        .join(texts.toDF("hub", "hub_text"), "hub")
        .select("hub", "node", "label", "hub_label", "text", "hub_text")
    )
    names = ["hub", "node", "label", "hub_label", "hub_size", "q", "added", "items"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, hub_set = None, None
        for batch in batches:
            rows: list[tuple] = []
            held = 0
            longs = zip(*(c.to_pylist() for c in batch.columns[:4]), strict=True)
            for row, (hub, node, label, hub_label) in enumerate(longs):
                if hub_set is None or hub != last:
                    last, hub_set = hub, shingles(batch.column(5)[row].as_py())
                own = shingles(batch.column(4)[row].as_py())
                new = np.setdiff1d(own, hub_set, assume_unique=True)
                gone = np.setdiff1d(hub_set, own, assume_unique=True)
                items = np.concatenate([new, gone]).view(np.int64)
                q = 4 * len(gone) + 3 * len(new)
                rows.append((hub, node, label, hub_label, len(hub_set), q, len(new), items))
                held += len(items)
                if held > 1 << 20:
                    yield _batch(rows, names)
                    rows, held = [], 0
            if rows:
                yield _batch(rows, names)

    return joined.mapInArrow(
        run, ", ".join(f"{n} long" for n in names[:-1]) + ", items array<long>"
    )


def _batch(rows: list[tuple], names: list[str]) -> pa.RecordBatch:
    """Rows of longs whose last column is a list of longs."""
    *longs, lists = zip(*rows, strict=True)
    return pa.RecordBatch.from_arrays(
        [*(pa.array(c, pa.int64()) for c in longs), pa.array(lists, pa.list_(pa.int64()))], names
    )


def _prefixes(differences: DataFrame) -> DataFrame:
    """``hub, node, label, hub_size, q, n_items, outside, short, long``.

    ``short`` are the differences that meet any partner which is not linked to the hub;
    ``long``, of members outside the hub's component, those that meet any partner at all.
    The order is one for the whole group: frequent differences last.  Of these a hub has
    at most ``FREQUENT`` times the mean number of differences, whatever the group's size.
    """
    sizes = differences.groupBy("hub").agg(F.count("*").alias("members"))
    frequent = (
        differences.select("hub", F.explode("items").alias("item"))
        .groupBy("hub", "item")
        .agg(F.count("*").alias("n"))
        .where("n > 1")
        .join(sizes, "hub")
        .where(F.col("n") * FREQUENT >= F.col("members"))
        .groupBy("hub")
        .agg(F.sort_array(F.collect_list(F.struct("item", "n"))).alias("counts"))
        .select("hub", F.col("counts.item").alias("frequent"), F.col("counts.n").alias("n"))
    )
    # A table of its own, so that the join below can split the members of a hot hub.
    frequent = written(frequent, "frequent")
    names = ["hub", "node", "label", "hub_size", "q", "n_items"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hubs, nodes, labels, hub_labels, sizes, qs, added = (
                batch.column(c).to_pylist() for c in range(7)
            )
            lengths, outside, short, long = [], [], [], []
            for at in range(batch.num_rows):
                items, keys, counts = (
                    np.asarray(batch.column(c)[at].values or [], dtype=np.int64)
                    for c in (7, 8, 9)
                )
                held = np.ones(len(items), dtype=np.int64)
                if len(keys):
                    place = np.minimum(np.searchsorted(keys, items), len(keys) - 1)
                    held = np.where(keys[place] == items, counts[place], 1)
                items = items[np.lexsort((items, np.arange(len(items)) >= added[at], held))]
                linked = qs[at] <= sizes[at]
                if linked:
                    labels[at] = hub_labels[at]
                outside.append(labels[at] != hub_labels[at])
                lengths.append(len(items))
                short.append(items[: len(items) - qs[at] // 7])
                least = max(1, -((sizes[at] - qs[at]) // 7))
                long.append(items[: len(items) - least + 1] if outside[-1] else items[:0])
            columns = (hubs, nodes, labels, sizes, qs, lengths)
            yield pa.RecordBatch.from_arrays(
                [
                    *(pa.array(c, pa.int64()) for c in columns),
                    pa.array(outside, pa.bool_()),
                    pa.array(short, pa.list_(pa.int64())),
                    pa.array(long, pa.list_(pa.int64())),
                ],
                [*names, "outside", "short", "long"],
            )

    return (
        differences.join(frequent, "hub", "left")
        .select(
            "hub", "node", "label", "hub_label", "hub_size", "q", "added", "items", "frequent", "n"
        )
        .mapInArrow(
            run,
            ", ".join(f"{n} long" for n in names)
            + ", outside boolean, short array<long>, long array<long>",
        )
    )


def _difference_pairs(prefixes: DataFrame) -> DataFrame:
    """Pairs of one group, apart from each other, that share a difference of their prefixes."""
    columns = ("node", "label", "q", "n_items")
    left = prefixes.where("outside").select(
        "hub", "hub_size", *(F.col(c).alias(f"{c}_a") for c in columns), F.explode("long").alias("item")
    )
    right = prefixes.select(
        "hub", *(F.col(c).alias(f"{c}_b") for c in columns), F.explode("short").alias("item")
    )
    return (
        left.join(right, ["hub", "item"])
        .where("label_a != label_b AND q_a + q_b <= hub_size + 7 * least(n_items_a, n_items_b)")
        .select(F.least("node_a", "node_b").alias("a"), F.greatest("node_a", "node_b").alias("b"))
        .distinct()
    )


def components(links: DataFrame) -> DataFrame:
    """``node, label`` of all linked nodes; the label is the smallest node reachable.

    Alternates large-star (larger neighbours to the smallest) and small-star (smaller
    neighbours and the node itself to the smallest) until no edge changes.  Each step
    is an aggregate and a join on the node; a hot node is split by the skew-join rule.
    """
    edges = written(
        links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(),
        "edges",
    )
    before = None
    while True:
        both = edges.union(edges.select("v", "u").toDF("u", "v"))
        lowest = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = written(
            both.join(lowest, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
            .where("u != v").distinct(),
            "large-star",
        )
        lowest = large.groupBy("u").agg(F.min("v").alias("m"))
        small = (
            large.join(lowest, "u")
            .select(F.col("v").alias("u"), F.col("m").alias("v"))
            .union(lowest.select("u", F.col("m").alias("v")))
            .where("u != v")
            .distinct()
        )
        edges = written(small, "small-star")
        now = edges.agg(
            F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))
        ).first()
        if now == before:
            break
        before = now
    stars = edges.groupBy("u").agg(F.min("v").alias("label")).toDF("node", "label")
    roots = stars.select(F.col("label").alias("node"), "label").distinct()
    return stars.union(roots)


def _links(nodes: DataFrame, texts: DataFrame) -> DataFrame:
    """The linked pairs ``a, b`` of classes: enough of them to connect all components."""
    spark = nodes.sparkSession
    buckets = written(_buckets(nodes), "buckets")

    def confirmed(pairs: DataFrame) -> DataFrame:
        close = written(_agree(written(pairs, "pairs"), nodes), "close-pairs")
        with arrow_rows(spark, TEXT_ROWS):
            return written(_linked(close, texts), "links")

    links = confirmed(_hub_pairs(buckets))
    labels = written(components(links), "labels")
    rest = written(_apart(buckets, labels), "apart")
    groups = written(_groups(rest.where(F.col("size") > SMALL_BUCKET), labels), "groups")
    with arrow_rows(spark, TEXT_ROWS):
        # Dealt by member, so that the members of a hot hub lie in many tasks.
        differences = written(
            _differences(groups, texts).repartition("hub", "node"), "differences"
        )
        prefixes = written(_prefixes(differences).repartition("hub", "node"), "prefixes")
    hub_links = differences.where("q <= hub_size").select(
        F.least("node", "hub").alias("a"), F.greatest("node", "hub").alias("b")
    )
    small = _cross_pairs(
        rest.where(F.col("size") <= SMALL_BUCKET), nodes.select("node", "n_shingles")
    )
    pairs = small.union(_difference_pairs(prefixes)).distinct()
    return links.union(hub_links).union(confirmed(pairs))


def mark(docs: DataFrame) -> DataFrame:
    """``doc_id, n_shingles, component_id, kept`` per document."""
    spark = docs.sparkSession
    with arrow_rows(spark, TEXT_ROWS):
        sketches = written(sketch(docs), "minhash")
    usable = sketches.where("doc_id IS NOT NULL AND n_shingles > 0")
    classes = usable.groupBy("set_digest").agg(F.min("doc_id").alias("class_id"))
    texts = docs.select(F.col("doc_id").cast("long").alias("node"), "text")
    with scratch_scope(spark) as scope:
        # One row per class; a class's rows differ in nothing but doc_id.
        nodes = written(
            usable.join(classes, "set_digest")
            .where("doc_id = class_id")
            .groupBy(F.col("doc_id").alias("node"), "set_digest")
            .agg(*(F.first(c).alias(c) for c in ("bands", "signature", "n_shingles"))),
            "classes",
        )
        labels = scope.keep(written(components(_links(nodes, texts)), "labels"))

    doc_classes = sketches.select("doc_id", "n_shingles", "set_digest").join(
        classes, "set_digest", "left"
    )
    return (
        doc_classes.join(labels, doc_classes.class_id == labels.node, "left")
        .select(
            "doc_id",
            "n_shingles",
            F.when(
                F.col("doc_id").isNotNull(), F.coalesce("label", "class_id", "doc_id")
            ).alias("component_id"),
        )
        .withColumn(
            "kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True))
        )
    )


def keep_one(docs: DataFrame) -> DataFrame:
    """The documents that stay, one of each component, with all their columns."""
    lost = fresh(docs, "lost_id")
    losers = written(
        mark(docs).where("NOT kept").select(F.col("doc_id").alias(lost)).distinct(), "near-copies"
    )
    return docs.join(losers, docs.doc_id == losers[lost], "left_anti")
