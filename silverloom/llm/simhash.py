"""SimHash near-duplicates through vantage-point trees (operator 9).

Fingerprints: 64 bits, each the majority of the XXH64 bits of a text's word shingles. Equal
fingerprints are one class, held by its smallest doc_id, so copies never meet each other.

Links are found between classes. The bits are cut into ``radius // 2 + 1`` disjoint bands; a pair
within ``radius`` bits is within ``radius // bands`` (1) in at least one band, so a tree a band finds
every pair. Each level of a shard tree has a vantage point that measures the Hamming distance over
its own slice of the band; the path of these distances is the shard. By the triangle inequality,
added up over disjoint slices, paths of fingerprints within 1 in the band differ by at most one step
at one level: a fingerprint is a member of its own shard and queries the shards that this bound
reaches (those above its own; the ones below query it). Within a shard a vantage-point tree over all
64 bits splits members at the median distance and prunes both ways. A shard gives only the edges of a
spanning forest, at most one a fingerprint, and the components are joined by ``connected_components``.

Sizes: a fingerprint makes about 27 short rows (3 trees of 11 levels); a shard holds at most about
n / 1400 of evenly spread fingerprints. ``slice_bits = 1`` makes shards finer for far larger tables.

Defined results: null and empty texts have fingerprint zero, linked like any other; rows with one
doc_id count as one document; a null doc_id links with nothing and has a null component; ties go to
the smallest id; columns other than doc_id and text are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from silverloom.operators.components import connected_components

from .common import map_batches, settle, text_bytes

SHINGLE, RADIUS, SEED, SLICE_BITS = 4, 4, 42, 2
#: A fixed vantage point; each slice of bits takes its part.
VANTAGE = 0x9E3779B97F4A7C15
BITS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").astype(np.int64)
LEAF = 64


def fingerprint(text: bytes, shingle: int = SHINGLE, seed: int = SEED) -> int:
    words = text.lower().split()  # of bytes: A-Z only, at \x20 and \x09-\x0D only
    n = len(words)
    if not n:
        return 0
    if n <= shingle:
        return xxhash.xxh64_intdigest(b" ".join(words), seed)
    whole, digest = b" ".join(words), xxhash.xxh64_intdigest
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, n) + 1) - 1
    starts = np.empty(n, np.int64)
    starts[0], starts[1:] = 0, ends[:-1] + 1
    pairs = zip(starts[: n - shingle + 1].tolist(), ends[shingle - 1 :].tolist())
    hashes = np.array([digest(whole[a:b], seed) for a, b in pairs], np.uint64)
    counts = np.concatenate([np.bincount(column, minlength=256) @ BITS for column in hashes.view(np.uint8).reshape(-1, 8).T])
    return int(np.packbits(2 * counts > len(hashes), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, shingle: int = SHINGLE, seed: int = SEED) -> DataFrame:
    """doc_id and fp, the fingerprint's 64 bits as a long."""

    def each(batch: pa.RecordBatch) -> dict:
        made = np.array([fingerprint(x, shingle, seed) for x in text_bytes(batch.column("text"))], np.uint64)
        return {"doc_id": batch.column("doc_id"), "fp": made.view(np.int64)}

    kind = docs.schema["doc_id"].dataType.simpleString()
    return map_batches(docs.select("doc_id", "text"), f"doc_id {kind}, fp long", each)


def slices(radius: int, slice_bits: int) -> list[list[tuple[int, int]]]:
    """For each tree the (shift, width) of its levels' slices."""
    trees, cuts = radius // 2 + 1, []
    edges = [64 * i // trees for i in range(trees + 1)]
    for low, high in zip(edges, edges[1:]):
        cuts.append([(at, min(slice_bits, high - at)) for at in range(low, high, slice_bits)])
    return cuts


def shard_rows(fp: np.ndarray, rep: np.ndarray, radius: int, slice_bits: int) -> dict[str, np.ndarray]:
    """Each fingerprint in its own shard of every tree, and as a query in those it overlaps above."""
    out: dict[str, list] = {"shard": [], "fp": [], "rep": [], "query": []}

    def put(shard: np.ndarray, pick, query: bool) -> None:
        out["shard"].append(shard)
        out["fp"].append(fp[pick])
        out["rep"].append(rep[pick])
        out["query"].append(np.full(len(shard), query))

    away = fp.view(np.uint64) ^ np.uint64(VANTAGE)
    for tree, levels in enumerate(slices(radius, slice_bits)):
        steps = [np.bitwise_count((away >> np.uint64(shift)) & np.uint64((1 << width) - 1)).astype(np.int64) for shift, width in levels]
        base, path = [], np.zeros(len(fp), np.int64)
        for (_, width), step in zip(levels, steps):
            path = path * (width + 1) + step
        weight = 1
        for _, width in reversed(levels):
            base.append(weight)
            weight *= width + 1
        path += tree << 56
        put(path, slice(None), False)
        for (_, width), step, weight in zip(levels, steps, reversed(base)):
            inside = np.flatnonzero(step < width)
            put(path[inside] + weight, inside, True)
    return {k: np.concatenate(v) for k, v in out.items()}


class Forest:
    """Union-find over the places of a shard's rows."""

    def __init__(self, n: int):
        self.root = np.arange(n)

    def find(self) -> np.ndarray:
        while True:
            up = self.root[self.root]
            if (up == self.root).all():
                return self.root
            self.root = up

    def join(self, a: np.ndarray, b: np.ndarray) -> None:
        """Links of a to b: reduced to pairs of roots first, so a dense group costs little."""
        while len(a):
            root = self.find()
            a, b = root[a], root[b]
            low, high = np.minimum(a, b), np.maximum(a, b)
            keep = low < high
            if not keep.any():
                return
            pairs = np.unique(np.stack([high[keep], low[keep]]), axis=1)
            a, b = pairs
            np.minimum.at(self.root, a, b)


def pairs_within(bits: np.ndarray, members: np.ndarray, queries: np.ndarray, radius: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Each query with every member within the radius: a vantage-point tree, built as it is searched. bits:
    a fingerprint a row, of one word or of several."""
    differ = np.bitwise_count if bits.ndim == 1 else lambda x: np.bitwise_count(x).sum(-1, dtype=np.int64)
    todo = [(members, queries)]
    while todo:
        own, ask = todo.pop()
        if not len(own) or not len(ask):
            continue
        if len(own) > LEAF and len(ask) > 1:
            vantage = bits[own[len(own) // 2]]
            there, here = differ(bits[own] ^ vantage), differ(bits[ask] ^ vantage).astype(np.int64)
            middle = int(np.median(there))
            inner = there <= middle
            if 0 < inner.sum() < len(own):
                todo.append((own[inner], ask[here - radius <= middle]))
                todo.append((own[~inner], ask[here + radius > middle]))
                continue
        for at in range(0, len(ask), max(1, (1 << 20) // len(own))):
            some = ask[at : at + max(1, (1 << 20) // len(own))]
            q, m = np.nonzero(differ(bits[some][:, None] ^ bits[own][None, :]) <= radius)
            yield some[q], own[m]


def link_within(bits: np.ndarray, members: np.ndarray, queries: np.ndarray, radius: int, forest: Forest) -> None:
    """Join each query to every member within the radius."""
    for q, m in pairs_within(bits, members, queries, radius):
        forest.join(q, m)


def shard_links(fp: np.ndarray, rep: np.ndarray, query: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Spanning links (class, class) of one shard's members and queries."""
    if query.all():
        return rep[:0], rep[:0]
    order = np.argsort(rep, kind="stable")  # so that the root of a tree is its smallest class
    bits, rep, query = fp[order].view(np.uint64), rep[order], query[order]
    forest = Forest(len(bits))
    link_within(bits, np.flatnonzero(~query), np.arange(len(bits)), radius, forest)
    root = forest.find()
    child = np.flatnonzero(root != np.arange(len(root)))
    return rep[child], rep[root[child]]


def class_links(classes: DataFrame, radius: int = RADIUS, slice_bits: int = SLICE_BITS) -> DataFrame:
    """Links (a, b) that connect whatever lies within the radius; classes: fp and rep, both unique."""

    def route(batch: pa.RecordBatch) -> dict:
        return shard_rows(batch.column("fp").to_numpy(), batch.column("rep").to_numpy(), radius, slice_bits)

    rows = map_batches(classes.select("fp", "rep"), "shard long, fp long, rep long, query boolean", route)
    dealt = rows.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), "shard").sortWithinPartitions("shard")

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def done(shard: np.ndarray, fp: np.ndarray, rep: np.ndarray, query: np.ndarray) -> Iterator[pa.RecordBatch]:
            cuts = np.flatnonzero(np.diff(shard)) + 1
            found = [shard_links(fp[a:b], rep[a:b], query[a:b], radius) for a, b in zip([0, *cuts], [*cuts, len(shard)]) if b - a > 1]
            if found:
                a, b = (np.concatenate(x) for x in zip(*found))
                if len(a):
                    yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])

        held: list[tuple[np.ndarray, ...]] = []
        for batch in batches:
            now = tuple(batch.column(c).to_numpy(zero_copy_only=False) for c in ("shard", "fp", "rep", "query"))
            if not len(now[0]):
                continue
            last = np.searchsorted(now[0], now[0][-1])  # the last shard may go on in the next batch
            if last or held and held[-1][0][-1] != now[0][0]:
                whole = [*held, tuple(x[:last] for x in now)]
                yield from done(*(np.concatenate(x) for x in zip(*whole)))
                held = [tuple(x[last:] for x in now)]
            else:
                held.append(now)
        if held:
            yield from done(*(np.concatenate(x) for x in zip(*held)))

    return dealt.mapInArrow(search, "a long, b long")


def near_duplicates(docs: DataFrame, radius: int = RADIUS, shingle: int = SHINGLE, slice_bits: int = SLICE_BITS) -> DataFrame:
    """doc_id, fp (long) and component_id (the smallest doc_id reachable) of each row."""
    prints = settle(fingerprints(docs, shingle), "fingerprints")
    classes = settle(prints.filter("doc_id is not null").groupBy("fp").agg(F.min("doc_id").cast("long").alias("rep")), "fingerprint-classes")
    parts = settle(connected_components(class_links(classes, radius, slice_bits)), "fingerprint-components")
    named = classes.join(parts, F.col("rep") == F.col("node"), "left").select(F.col("fp").alias("class_fp"), F.coalesce("component", "rep").alias("component_id"))
    found = prints.join(named, F.col("fp") == F.col("class_fp"), "left")
    return found.select("doc_id", "fp", F.when(F.col("doc_id").isNotNull(), F.col("component_id")).alias("component_id"))


def near_duplicate_digest(found: DataFrame) -> DataFrame:
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame, radius: int = RADIUS, shingle: int = SHINGLE) -> DataFrame:
    """The document with the smallest doc_id of each group, one row of it, with docs' own columns;
    rows without a doc_id stay."""
    return keep_smallest(docs, near_duplicates(docs, radius, shingle).filter("doc_id is not null"))


def keep_smallest(docs: DataFrame, found: DataFrame) -> DataFrame:
    """One row of each document that is its component's smallest; found: doc_id and component_id."""
    ids = settle(found.groupBy(F.col("doc_id").alias("kept_id")).agg(F.min("component_id").alias("component_id"), F.count("*").alias("n_rows")), "kept-ids")
    own = "an id that stays or goes"  # no name of docs' columns
    drop = ids.filter("kept_id <> component_id").select(F.col("kept_id").alias(own)).hint("merge")  # one plan at every size: the ids grow with the table
    stay = docs.join(drop, F.col("doc_id") == F.col(own), "left_anti")
    again = ids.filter("kept_id = component_id and n_rows > 1").select(F.col("kept_id").alias(own))
    if again.isEmpty():
        return stay
    single = stay.join(again, F.col("doc_id") == F.col(own), "left_anti")
    return single.unionByName(stay.join(again, F.col("doc_id") == F.col(own), "left_semi").dropDuplicates(["doc_id"]))
