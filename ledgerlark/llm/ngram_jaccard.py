"""N-gram Jaccard join by PartEnum signatures (Arasu, Ganti, Kaushik, VLDB 2006).

Sets are banded by size so that two sets of similarity t or more lie in one band or in neighbouring
ones. A band's instance splits the hash domain of shingles into n parts; two such sets differ in at
most k shingles, so fewer than n parts can differ, and they share the content of a part. A signature
names band, part and content. This is the scheme's case of one-part subsets, which gives the fewest
signatures.

Empty parts, and parts of one common shingle, would match for very many sets that share little else.
A set therefore signs only parts of two shingles or more. That suffices when it has more than k such
parts. A set that hasn't ("weak") signs the next level as well, with another hash of the domain; at
the last level weak sets sign all parts. Of two similar sets, take the first level at which either
is strong: both sign there, and one of the strong set's signed parts agrees.

Pairs that share a signature are held against odd sketches first (Mitzenmacher, Pagh, Pham, 2014): a
bit for the parity of each hash bin. Every shingle in which two sets differ flips one bit, so sketches
that differ in more bits than a similar pair may in shingles rule the pair out for certain.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerlark.llm.components import connected_components
from ledgerlark.llm.storage import bounded_batches, sent_if_small, stored
from ledgerlark.llm.text_arrays import LOWER, U64, mix, span_hashes, text_chunks, tidily, window_hashes, words

LEVELS = 6
#: 64-bit words of the short sketch. It rules out unlike sets of up to some 64 * SHORT * 2 shingles.
SHORT = 8


def shingle_sets(column: pa.Array, width: int) -> Iterator[np.ndarray]:
    """The sorted distinct shingle hashes of every text of a column, in order."""
    for _, data, offsets in text_chunks(column):
        data = LOWER[data]
        starts, ends, rows = words(data, offsets)
        hashes = span_hashes(data, starts, ends)
        shingles = window_hashes(hashes, width)
        bounds = np.searchsorted(rows, np.arange(len(offsets)))
        for low, high in zip(bounds[:-1], bounds[1:]):
            if high - low >= width:
                yield np.unique(shingles[low : high - width + 1])
            else:
                yield window_hashes(hashes[low:high], int(high - low))[:1] if high > low else np.zeros(0, U64)


def set_keys(hashes: np.ndarray) -> tuple[int, int]:
    """Two 64-bit digests of a set."""
    return tuple(int((mix(hashes * U64(c)).sum(dtype=U64) + U64(len(hashes))).view(np.int64)) for c in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F))


class Bands:
    """Size bands, and for each the parts of its instance, for a similarity of percent / 100."""

    def __init__(self, percent: int):
        self.percent, self.tops = percent, [0]

    def find(self, size: int) -> int:
        while self.tops[-1] < size:
            self.top(len(self.tops))
        return int(np.searchsorted(self.tops, size))

    def top(self, band: int) -> int:
        while len(self.tops) <= band:
            self.tops.append((self.tops[-1] + 1) * 100 // self.percent)
        return self.tops[band]

    def differ(self, size: int, top: int) -> int:
        """Most shingles in which a set of this size differs from a similar one of at most ``top``."""
        return (size + min(top, size * 100 // self.percent)) * (100 - self.percent) // (100 + self.percent)

    def parts(self, band: int) -> int:
        """Some more than the k + 1 that must be, so that few sets are weak; 0 if similar means equal."""
        k = self.differ(self.top(band), self.top(band))
        return k + 2 + k // 8 if k else 0


def signatures(hashes: np.ndarray, bands: Bands) -> list[np.ndarray]:
    """All signatures of a set; none if only an equal set is similar to it."""
    found, own = [], bands.find(len(hashes))
    for band in (own, own + 1):
        n = bands.parts(band)
        if not n or not len(hashes):
            continue
        k = bands.differ(len(hashes), bands.top(band))
        for level in range(LEVELS):
            spread = hashes if level == 0 else np.sort(mix(hashes + U64(level)))
            part = ((spread >> U64(32)) * U64(n)) >> U64(32)
            starts = np.flatnonzero(np.concatenate([[True], part[1:] != part[:-1]]))
            content, where = np.add.reduceat(mix(spread ^ U64(0x632BE59BD9B4E019)), starts), part[starts]
            salt = mix(np.array([band * LEVELS + level], U64))
            signed = np.diff(np.append(starts, len(spread))) > 1
            strong = signed.sum() > k
            if not strong and level == LEVELS - 1:
                found.append(mix(mix(np.setdiff1d(np.arange(n, dtype=U64), where) + salt) + U64(1)))
                signed[:] = True
            found.append(mix(content[signed] ^ mix(where[signed] + salt)))
            if strong:
                break
    return found


def odd_sketch(hashes: np.ndarray) -> np.ndarray:
    """Parities of hash bins, at least as many as the set has members, as 64-bit words."""
    bins = max(64, 1 << int(len(hashes) - 1).bit_length()) if len(hashes) else 64
    odd = np.bincount((mix(hashes) & U64(bins - 1)).astype(np.int64), minlength=bins) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


def short_sketch(hashes: np.ndarray) -> np.ndarray:
    """Parities of a fixed number of bins, for tests inside the join of buckets."""
    odd = np.bincount((mix(hashes) & U64(64 * SHORT - 1)).astype(np.int64), minlength=64 * SHORT) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


def _differ(a: Column, b: Column) -> Column:
    """Bits in which two sketches differ; a sketch of twice as many bins is folded first."""

    def fold(x: Column) -> Column:
        half = (F.size(x) / 2).cast("int")
        return F.zip_with(F.slice(x, F.lit(1), half), F.slice(x, half + 1, half), lambda p, q: p.bitwiseXOR(q))

    def bits(x: Column, y: Column) -> Column:
        return F.aggregate(F.zip_with(x, y, lambda p, q: F.bit_count(p.bitwiseXOR(q))), F.lit(0), lambda s, v: s + v)

    return F.when(F.size(a) == F.size(b), bits(a, b)).when(F.size(a) > F.size(b), bits(fold(a), b)).otherwise(bits(a, fold(b)))


def _keys(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[pa.RecordBatch]:
    for batch in tidily(batches):
        rows = [(len(s), *set_keys(s), odd_sketch(s), short_sketch(s)) for s in shingle_sets(batch.column(1), width)]
        *numbers, sketches, short = zip(*rows) if rows else ((),) * 5
        words_ = pa.list_(pa.int64())
        yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(x, pa.int64()) for x in numbers), pa.array(sketches, words_), pa.array(short, words_)], ["id", "n", "k1", "k2", "sketch", "short"])


def _signature_rows(batches: Iterator[pa.RecordBatch], width: int, percent: int) -> Iterator[pa.RecordBatch]:
    bands, seen = Bands(percent), set()
    sigs: list[np.ndarray] = []
    keys: list[np.ndarray] = []

    def out() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate(sigs).view(np.int64)), pa.array(np.concatenate(keys))], ["sig", "k1"])

    for batch in tidily(batches):
        for s in shingle_sets(batch.column(0), width):
            key = set_keys(s)[0] if len(s) else None
            if key is None or key in seen:  # copies within a task sign once
                continue
            seen.add(key)
            own = signatures(s, bands)
            sigs += own
            keys += [np.full(len(x), key, np.int64) for x in own]
            if len(sigs) >= 500:
                yield out()
                sigs, keys = [], []
    if sigs:
        yield out()


def _shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From rows sorted by signature and set, those whose signature more than one set has."""
    last: tuple | None = None
    told = False
    for batch in tidily(batches):
        sig, key = (batch.column(i).to_numpy() for i in (0, 1))
        if last is not None:
            sig, key = np.concatenate([[last[0]], sig]), np.concatenate([[last[1]], key])
        if not len(sig):
            continue
        new = np.ones(len(sig), bool)
        new[1:] = (sig[1:] != sig[:-1]) | (key[1:] != key[:-1])
        sig, key = sig[new], key[new]
        like_next = np.zeros(len(sig), bool)
        like_next[:-1] = sig[1:] == sig[:-1]
        keep = like_next.copy()
        keep[1:] |= like_next[:-1]
        if last is not None and told:
            keep[0] = False  # it went out with the batch before
        told = bool(len(sig) > 1 and like_next[-2]) or (len(sig) == 1 and last is not None and told)
        last = (sig[-1], key[-1])
        if keep.any():
            yield pa.RecordBatch.from_arrays([pa.array(sig[keep]), pa.array(key[keep])], ["sig", "k1"])


def _compare(batches: Iterator[pa.RecordBatch], width: int, percent: int) -> Iterator[pa.RecordBatch]:
    """Rows sorted by hub with the hub's own text first: the members that are similar to it."""
    hub, own = None, []
    for batch in tidily(batches):
        hubs, members, ids = batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist()
        links = []
        for h, member, i, s in zip(hubs, members, ids, shingle_sets(batch.column(3), width)):
            if h != hub:
                hub, own = h, []
            if not member:
                own.append(s)
            else:
                for o in own:
                    if min(len(s), len(o)) * 100 >= percent * max(len(s), len(o)) > 0:
                        common = len(np.intersect1d(s, o, assume_unique=True))
                        if 100 * common >= percent * (len(s) + len(o) - common):
                            links.append((i, h))
                            break
        if links:
            yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in links], pa.int64()) for k in (0, 1)], ["id", "hub"])


def _sizes(percent: int) -> Column:
    """Whether sets of n and n_ members can be similar."""
    return percent * F.greatest("n", "n_") <= 100 * F.least("n", "n_")


def _bound(percent: int) -> Column:
    """Most members in which similar sets of n and n_ members differ."""
    return ((F.col("n") + F.col("n_")) * (100 - percent) / (100 + percent)).cast("int")


def _possible(pairs: DataFrame, sketches: DataFrame, percent: int) -> DataFrame:
    """The pairs (id, hub) that sizes and sketches don't rule out."""
    other = sketches.select(F.col("id").alias("hub"), F.col("n").alias("n_"), F.col("sketch").alias("sketch_"))
    both = pairs.join(sketches, "id").join(other, "hub")
    return both.where(_sizes(percent) & (_differ(F.col("sketch"), F.col("sketch_")) <= _bound(percent))).select("id", "hub").distinct()


def _verified(docs: DataFrame, pairs: DataFrame, width: int, percent: int) -> DataFrame:
    """The pairs (id, hub) that are similar. The hub's text goes once to each task that holds members
    of it: a hub with very many members is dealt over several."""
    pairs = stored(pairs)
    slots = pairs.withColumn("slot", F.pmod(F.xxhash64("id"), F.lit(16)))
    hubs = slots.select("hub", "slot").distinct().select(F.col("hub").alias("id"), "hub", "slot", F.lit(0).alias("member"))
    roles = slots.select("id", "hub", "slot", F.lit(1).alias("member")).unionByName(hubs)
    return stored(
        docs.join(sent_if_small(roles), "id")
        .select("hub", "member", "id", "text", "slot")
        .repartition("hub", "slot")
        .sortWithinPartitions("hub", "slot", "member")
        .select("hub", "member", "id", "text")
        .mapInArrow(partial(_compare, width=width, percent=percent), "id long, hub long")
        .distinct()
    )


def ngram_jaccard_components(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, width: int = 5, percent: int = 80) -> DataFrame:
    """One row for each document: its id, n_shingles (long) and component_id (long), the smallest id
    that links reach, where 100 * |intersection| >= percent * |union| of the shingle sets links.

    A-Z counts as a-z. Null, empty and blank texts have an empty set and no link; with fewer than
    ``width`` words the whole sequence is the one shingle. Equal texts, or texts with equal sets,
    link; only one of them is signed. A repeated id is one node with each of its texts, and comes back
    once for each row. A row whose id is null links with nothing and has a null component. Further
    columns are left out. Pairs that share a signature are compared exactly, set by set.
    """
    bounded_batches(documents.sparkSession)
    docs = documents.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    keys = stored(docs.mapInArrow(partial(_keys, width=width), "id long, n long, k1 long, k2 long, sketch array<long>, short array<long>"))
    nodes = keys.where("id is not null and n > 0")
    classes = stored(nodes.groupBy("k1", "k2").agg(F.min("id").alias("rep"), F.first("n").alias("n"), F.first("sketch").alias("sketch"), F.first("short").alias("short")))
    shared = (
        docs.where("id is not null").select("text")
        .mapInArrow(partial(_signature_rows, width=width, percent=percent), "sig long, k1 long")
        .repartition("sig").sortWithinPartitions("sig", "k1")
        .mapInArrow(_shared, "sig long, k1 long")
    )
    clash = classes.groupBy("k1").agg(F.count("*").alias("c")).where("c > 1").select(F.col("k1").alias("sig"), "k1")
    buckets = stored(shared.unionByName(clash).join(classes.select("k1", "rep"), "k1").select("sig", "rep").distinct())

    sketches = classes.select(F.col("rep").alias("id"), "n", "sketch")
    hubs = buckets.groupBy("sig").agg(F.min("rep").alias("hub"))
    first = buckets.join(hubs, "sig").where("hub < rep").groupBy("rep").agg(F.min("hub").alias("hub")).select(F.col("rep").alias("id"), "hub")
    first = stored(first)
    links = _verified(docs, _possible(first, sketches, percent), width, percent)
    found = connected_components(links, "id", "hub")

    # Sets of one bucket that the first links don't join: each such pair is compared.
    label = buckets.join(found.withColumnRenamed("node", "rep"), "rep", "left").select("sig", "rep", F.coalesce("component", "rep").alias("component"))
    mixed = label.groupBy("sig").agg(F.min("component").alias("low"), F.max("component").alias("high")).where("low < high").select("sig")
    parts = [f"s{i}" for i in range(SHORT)]
    short = classes.select("rep", "n", *(F.col("short")[i].alias(c) for i, c in enumerate(parts)))
    left = stored(label.join(mixed, "sig").join(short, "rep"))
    right = left.select("sig", F.col("rep").alias("hub"), F.col("component").alias("other"), F.col("n").alias("n_"), *(F.col(c).alias(f"{c}_") for c in parts))
    apart = sum((F.bit_count(F.col(c).bitwiseXOR(F.col(f"{c}_"))) for c in parts), F.lit(0))
    near = (F.col("other") < F.col("component")) & _sizes(percent) & (apart <= _bound(percent))
    rest = left.alias("l").join(right, (F.col("l.sig") == right["sig"]) & near).select(F.col("rep").alias("id"), "hub").distinct()
    tested = first.unionByName(first.select(F.col("hub").alias("id"), F.col("id").alias("hub")))
    rest = rest.join(tested, ["id", "hub"], "left_anti")
    more = _verified(docs, _possible(rest, sketches, percent), width, percent)

    twice = nodes.groupBy("id", "k1", "k2").count().groupBy("id").agg(F.count("*").alias("c")).where("c > 1").select("id")
    same = nodes.join(twice, "id").join(classes, ["k1", "k2"]).select("id", F.col("rep").alias("hub"))
    component = connected_components(links.unionByName(more).unionByName(same), "id", "hub")

    by_class = classes.join(component.withColumnRenamed("node", "rep"), "rep", "left").select("k1", "k2", F.coalesce("component", "rep").alias("component_id"))
    own = keys.where("id is not null and n > 0").join(by_class, ["k1", "k2"]).select("id", "n", "component_id")
    none = keys.where("id is null or n = 0").select("id", "n", F.col("id").alias("component_id"))
    # a repeated id may stand in an empty row as well
    component = component.join(twice, component.node == twice.id, "left_semi").select(F.col("node").alias("id"), "component")
    none = none.join(component, "id", "left").select("id", "n", F.coalesce("component", "component_id").alias("component_id"))
    return own.unionByName(none).select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), "component_id")
