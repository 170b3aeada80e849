"""Embedding near-duplicates by hierarchical navigable small-world graphs (operator 3).

Equal vectors are one class. Classes are dealt to shards by hash; each shard's graph is built in one
task and stored in the shared folder. Every class queries every shard, in blocks: a beam search down
the graph's layers, then a flood from the hits over neighbours that hit, so that groups wider than
the beam are found whole. In each block queries are held against brute force over the shard, until
``AUDIT_LINKED`` of them have links there or all were; itself is no link. While the mean recall of
queries with about as many links (a power of two) is below ``AUDIT_RECALL`` for any such number, the
beam is widened and the block searched again (a beam as wide as the shard reads all of it). Hits are verified by cosine in double precision. A
block returns counts of links and the edges of a spanning forest, never all pairs.

Defined results: vectors that are null, empty, zero or hold null or non-finite components link with
nothing; vectors of different lengths don't link; a null vec_id links with nothing and has no
component (kept is false); rows that share a vec_id are one node; equal vectors link with each
other; columns other than vec_id and embedding are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import heapq
import io
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from silverloom.operators.components import connected_components

from .common import settle
from .simhash import Forest

THRESHOLD, AUDIT_RECALL, AUDIT_QUERIES, AUDIT_LINKED = 0.9, 0.995, 256, 64
#: Links of a node (twice as many in the lowest layer), beam while building, first beam of a search.
LINKS, BUILD_BEAM, SEARCH_BEAM = 12, 64, 32
#: Shards: this many at least, more for more than so many rows, or so many bytes of vectors, each. A
#: block of queries is as large as a shard, so that a graph is sent as often as its vectors ask.
SHARDS, SHARD_ROWS, SHARD_BYTES = 8, 100_000, 1 << 26
#: Bytes that the marks of seen nodes may take while queries go in step; hits that they may have;
#: nodes whose neighbours are looked at together in a flood.
MARKS, HITS, FRONT = 1 << 25, 1 << 21, 1 << 16


class Graph:
    """A navigable small world over the rows of ``unit`` (vectors of length one, float32)."""

    def __init__(self, unit: np.ndarray, layers: list[np.ndarray], entry: int):
        self.unit, self.layers, self.entry = unit, layers, entry
        self.back: tuple[np.ndarray, np.ndarray] | None = None

    @classmethod
    def build(cls, unit: np.ndarray, links: int = LINKS, beam: int = BUILD_BEAM) -> "Graph":
        """Inserts the rows one after the other; layers are drawn by a fixed seed."""
        n = len(unit)
        tops = np.minimum((-np.log(np.random.default_rng(11).random(n)) / np.log(links)).astype(int), 8)
        layers = [np.full((n, 2 * links if k == 0 else links), -1, np.int32) for k in range(int(tops.max()) + 1)]
        graph = cls(unit, layers, 0)
        high = int(tops[0])
        for i in range(1, n):
            near, top = graph.entry, int(tops[i])
            for k in range(high, top, -1):
                near = graph._descend(unit[i], near, k)
            start = [near]
            for k in range(min(top, high), -1, -1):
                found = graph._beam(unit[i], start, k, beam)
                picked = graph._diverse([x for _, x in found], [s for s, _ in found], links)
                layers[k][i, : len(picked)] = picked
                for j in picked:
                    graph._link(j, i, k)
                start = [x for _, x in found]
            if top > high:
                high, graph.entry = top, i
        return graph

    def _descend(self, q: np.ndarray, at: int, k: int) -> int:
        best = float(self.unit[at] @ q)
        while True:
            around = self.layers[k][at]
            around = around[around >= 0]
            if not len(around):
                return at
            sims = self.unit[around] @ q
            j = int(sims.argmax())
            if sims[j] <= best:
                return at
            at, best = int(around[j]), float(sims[j])

    def _beam(self, q: np.ndarray, start: list[int], k: int, beam: int) -> list[tuple[float, int]]:
        sims = self.unit[start] @ q
        seen = set(start)
        todo = [(-float(s), x) for s, x in zip(sims, start)]
        heapq.heapify(todo)
        held = [(-s, x) for s, x in todo]
        heapq.heapify(held)
        while len(held) > beam:
            heapq.heappop(held)
        links = self.layers[k]
        while todo:
            s, x = heapq.heappop(todo)
            if -s < held[0][0] and len(held) >= beam:
                break
            fresh = [y for y in links[x].tolist() if y >= 0 and y not in seen]
            if not fresh:
                continue
            seen.update(fresh)
            for t, y in zip((self.unit[fresh] @ q).tolist(), fresh):
                if len(held) < beam or t > held[0][0]:
                    heapq.heappush(todo, (-t, y))
                    heapq.heappush(held, (t, y))
                    if len(held) > beam:
                        heapq.heappop(held)
        return sorted(held, reverse=True)

    def _diverse(self, ids: list[int], sims: list[float], most: int) -> list[int]:
        """The nearest that are nearer to the new node than to what is picked; then the nearest rest."""
        among = self.unit[ids] @ self.unit[ids].T
        picked: list[int] = []
        for a in range(len(ids)):
            if len(picked) >= most:
                break
            if not picked or among[a, picked].max() <= sims[a]:
                picked.append(a)
        for a in range(len(ids)):
            if len(picked) >= most:
                break
            if a not in picked:
                picked.append(a)
        return [ids[a] for a in picked]

    def _link(self, j: int, i: int, k: int) -> None:
        row = self.layers[k][j]
        free = np.flatnonzero(row < 0)
        if len(free):
            row[free[0]] = i
            return
        ids = [i, *row.tolist()]
        sims = self.unit[ids] @ self.unit[j]
        order = np.argsort(-sims, kind="stable")
        row[:] = self._diverse([ids[o] for o in order], sims[order].tolist(), len(row))

    def reversed_links(self) -> tuple[np.ndarray, np.ndarray]:
        """Where the nodes that link to each node begin, and those nodes, in the lowest layer."""
        if self.back is None:
            ends = self.layers[0].ravel()
            whose = np.repeat(np.arange(len(self.unit)), self.layers[0].shape[1])[ends >= 0]
            ends = ends[ends >= 0]
            order = np.argsort(ends, kind="stable")
            self.back = np.searchsorted(ends[order], np.arange(len(self.unit) + 1)), whose[order]
        return self.back

    def search(self, q: np.ndarray, beam: int, floor: float, most: int | None = None) -> tuple[np.ndarray, np.ndarray] | None:
        """(place of the query, node) of what lies at floor or above; all queries go in step. None: more
        than ``most`` were found, too many to go on together."""
        n, b = len(self.unit), len(q)
        at = np.full(b, self.entry)
        best = self.unit[at[:1]] @ q.T
        best = best[0].copy()
        for links in self.layers[:0:-1]:
            going = np.arange(b)
            while len(going):
                around = links[at[going]]
                sims = np.where(around >= 0, np.einsum("bkd,bd->bk", self.unit[around], q[going]), -2)
                j = sims.argmax(1)
                s = sims[np.arange(len(going)), j]
                better = s > best[going]
                going, around, j, s = going[better], around[better], j[better], s[better]
                at[going], best[going] = around[np.arange(len(going)), j], s
        beam = min(beam, n)
        seen = np.zeros((b, n), bool)
        ids, sims = np.full((b, beam), -1), np.full((b, beam), -2, np.float32)
        ids[:, 0], sims[:, 0] = at, best
        seen[np.arange(b), at] = True
        read = np.zeros((b, beam), bool)
        hits = [np.flatnonzero(best >= floor) * n + at[best >= floor]]
        going = np.arange(b)
        while len(going):
            ahead = np.where(read[going] | (ids[going] < 0), -2, sims[going])
            j = ahead.argmax(1)
            live = ahead[np.arange(len(going)), j] > -2
            going, j = going[live], j[live]
            if not len(going):
                break
            node = ids[going, j]
            read[going, j] = True
            around = self.layers[0][node]
            fresh = (around >= 0) & ~seen[going[:, None], around]
            seen[going[:, None], np.where(around >= 0, around, node[:, None])] = True
            got = np.where(fresh, np.einsum("bkd,bd->bk", self.unit[around], q[going]), -2).astype(np.float32)
            r, c = np.nonzero(got >= floor)
            hits.append(going[r] * n + around[r, c])
            every = np.concatenate([sims[going], got], 1)
            top = np.argpartition(-every, beam - 1, 1)[:, :beam]
            pick = np.arange(len(going))[:, None]
            names = np.concatenate([ids[going], np.where(got > -2, around, -1)], 1)
            done = np.concatenate([read[going], np.zeros_like(fresh)], 1)
            ids[going], sims[going], read[going] = names[pick, top], every[pick, top], done[pick, top]
        front = np.unique(np.concatenate(hits))
        found, total, todo = [front], len(front), [front]
        flat = seen.reshape(-1)
        back_from, back = self.reversed_links()
        while todo:  # flood: neighbours of hits, by links of either way, though the beam had no room
            if most is not None and total > most:
                return None
            front = todo.pop()
            if len(front) > FRONT:
                todo += [front[FRONT:], front[:FRONT]]
                continue
            who, node = np.divmod(front, n)
            around = self.layers[0][node]
            size, first = back_from[node + 1] - back_from[node], back_from[node]
            place = np.arange(size.sum()) + np.repeat(first - np.cumsum(size) + size, size)
            key = np.concatenate([(who[:, None] * n + around)[around >= 0], np.repeat(who, size) * n + back[place]])
            key = np.unique(key[~flat[key]])
            flat[key] = True
            who, node = np.divmod(key, n)
            near = np.concatenate([np.einsum("xd,xd->x", self.unit[node[i : i + 65536]], q[who[i : i + 65536]]) for i in range(0, len(key), 65536)] or [np.zeros(0)])
            front = key[near >= floor]
            if len(front):
                found.append(front)
                todo.append(front)
                total += len(front)
        return np.divmod(np.sort(np.concatenate(found)), n)

    def dump(self, raw: np.ndarray, **more: np.ndarray) -> bytes:
        """raw: the vectors that ``unit`` was made of, which is not stored itself."""
        out = io.BytesIO()
        np.savez(out, raw=raw, entry=self.entry, **{f"layer{k}": x for k, x in enumerate(self.layers)}, **more)
        return out.getvalue()

    @classmethod
    def load(cls, data: bytes) -> tuple["Graph", np.ndarray, dict[str, np.ndarray]]:
        """The graph, its vectors at length one in double precision, and what else was stored."""
        got = np.load(io.BytesIO(data))
        exact = normal(got["raw"].astype(float))
        layers = [got[f"layer{k}"] for k in range(sum(f.startswith("layer") for f in got.files))]
        return cls(exact.astype(np.float32), layers, int(got["entry"])), exact, {f: got[f] for f in got.files if f not in ("raw", "entry") and not f.startswith("layer")}


def normal(vectors: np.ndarray) -> np.ndarray:
    """Each row at length one; scaled first, so that neither large nor small numbers are lost."""
    scaled = vectors / np.abs(vectors).max(1, keepdims=True)
    return scaled / np.sqrt((scaled * scaled).sum(1, keepdims=True))


def verified(unit: np.ndarray, queries: np.ndarray, who: np.ndarray, node: np.ndarray, threshold: float) -> np.ndarray:
    """Whether the cosine of each pair, in double precision, reaches the threshold."""
    out = [np.einsum("xd,xd->x", queries[who[i : i + 65536]], unit[node[i : i + 65536]]) >= threshold for i in range(0, len(who), 65536)]
    return np.concatenate(out) if out else np.zeros(0, bool)


def audited_search(graph: Graph, exact: np.ndarray, queries: np.ndarray, threshold: float, beam: int = SEARCH_BEAM, recall: float = AUDIT_RECALL, own: np.ndarray | None = None, names: np.ndarray | None = None) -> Iterator[tuple[int, np.ndarray, np.ndarray, int]]:
    """(first query, place of the query in the part, node, beam) part by part, with a beam that
    passed the audit. own, names: numbers of the queries and of the nodes; equal ones are no evidence."""
    n, single = len(exact), queries.astype(np.float32)
    largest = size = max(16, min(1024, MARKS // n))
    order, sample, links = np.random.default_rng(13).permutation(len(queries)), np.zeros(0, int), np.zeros(0, int)
    for i in range(0, len(order), AUDIT_QUERIES):
        part = order[i : i + AUDIT_QUERIES]
        true = queries[part] @ exact.T >= threshold
        if own is not None:
            true &= own[part][:, None] != names
        count = true.sum(1)
        sample, links = np.append(sample, part[count > 0]), np.append(links, count[count > 0])
        if len(sample) >= AUDIT_LINKED:
            break
    kinds = np.log2(np.maximum(links, 1)).astype(int)

    def searched(picked: np.ndarray, beam: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
        """(first and number of queries, place of the query among these, node); as many queries go in
        step as their hits allow."""
        nonlocal size
        at = 0
        while at < len(picked):
            part = picked[at : at + size]
            if beam >= n:
                part = part[: max(1, min(len(part), HITS // n))]
                who, node = np.nonzero(queries[part] @ exact.T >= threshold)
            else:
                got = graph.search(single[part], beam, threshold - 1e-3, HITS if len(part) > 1 else None)
                if got is None:
                    size = max(1, len(part) // 2)
                    continue
                who, node = got
                keep = verified(exact, queries[part], who, node, threshold)
                who, node = who[keep], node[keep]
                if len(who) < HITS // 4:
                    size = min(largest, 2 * size)
            yield at, len(part), who, node
            at += len(part)

    while len(sample) and beam < n:
        found = np.zeros(len(sample))
        for at, count, who, node in searched(sample, beam):
            if own is not None:
                who = who[own[sample[at : at + count]][who] != names[node]]
            found[at : at + count] = np.bincount(who, minlength=count)
        by_kind = np.bincount(kinds, found / links)[np.unique(kinds)] / np.bincount(kinds)[np.unique(kinds)]
        if by_kind.min() >= recall:
            break
        beam = min(2 * beam, n)
    for at, _, who, node in searched(np.arange(len(queries)), beam):
        yield at, who, node, beam


def raw_rows(table: pa.Table) -> np.ndarray:
    column = table["embedding"].combine_chunks()
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def rows_of(table: pa.Table) -> np.ndarray:
    return raw_rows(table).astype(float)


def vector_classes(vectors: DataFrame) -> DataFrame:
    """cid (unique), embedding, rep (its smallest vec_id), copies, dim: each distinct vector that can link."""
    value = F.col("embedding")
    bad = F.exists(value, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    fine = vectors.filter(F.col("vec_id").isNotNull() & value.isNotNull() & ~bad & F.exists(value, lambda x: x != 0))
    classes = fine.groupBy("embedding").agg(F.min("vec_id").cast("long").alias("rep"), F.count("*").alias("copies"))
    return settle(classes.select(F.monotonically_increasing_id().alias("cid"), "embedding", "rep", "copies", F.size("embedding").alias("dim")), "vector-classes")


def build_shards(classes: DataFrame, shards: int) -> DataFrame:
    """dim, shard, graph: the stored graph of each shard, with its members' numbers."""
    placed = classes.withColumn("shard", F.pmod(F.xxhash64("cid"), F.lit(shards)).cast("int"))

    def build(table: pa.Table) -> pa.Table:
        table = table.sort_by("cid")
        graph = Graph.build(normal(rows_of(table)).astype(np.float32))
        stored = graph.dump(raw_rows(table), **{c: table[c].to_numpy() for c in ("cid", "rep", "copies")})
        return pa.table({"dim": table["dim"].slice(0, 1), "shard": table["shard"].slice(0, 1), "graph": pa.array([stored], pa.binary())})

    return settle(placed.groupBy("dim", "shard").applyInArrow(build, "dim int, shard int, graph binary"), "vector-graphs")


def search_shards(classes: DataFrame, graphs: DataFrame, shards: int, blocks: int, threshold: float) -> DataFrame:
    """Counts of links (cid, n) and spanning edges (a, b) from every block of queries at every shard."""
    asked = classes.withColumn("block", F.pmod(F.xxhash64(F.lit("block"), "cid"), F.lit(blocks)).cast("int")).withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(shards - 1))))
    held = graphs.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))

    def search(queries: pa.Table, graph: pa.Table) -> pa.Table:
        cid, n, a, b = ([np.zeros(0, np.int64)] for _ in range(4))
        beam = 0
        if len(queries) and len(graph):
            queries = queries.sort_by("cid")
            made, exact, got = Graph.load(graph["graph"][0].as_py())
            own, mine = queries["cid"].to_numpy(), queries["rep"].to_numpy()
            names = np.unique(np.concatenate([mine, got["rep"]]))
            forest = Forest(len(names))
            ask, node_of = np.searchsorted(names, mine), np.searchsorted(names, got["rep"])
            for first, who, node, beam in audited_search(made, exact, normal(rows_of(queries)), threshold, own=own, names=got["cid"]):
                other = own[first + who] != got["cid"][node]
                who, node = who[other], node[other]
                count = np.bincount(who, got["copies"][node]).astype(np.int64)
                some = np.flatnonzero(count)
                cid.append(own[first + some])
                n.append(count[some])
                forest.join(ask[first + who], node_of[node])
            root = forest.find()
            child = np.flatnonzero(root != np.arange(len(root)))
            a.append(names[child])
            b.append(names[root[child]])
        cid, n, a, b = (np.concatenate(x) for x in (cid, n, a, b))
        none = lambda k: pa.nulls(k, pa.int64())
        return pa.table({"cid": pa.chunked_array([pa.array(cid), none(len(a))]), "n": pa.chunked_array([pa.array(n), none(len(a))]), "a": pa.chunked_array([none(len(cid)), pa.array(a)]), "b": pa.chunked_array([none(len(cid)), pa.array(b)]), "beam": pa.array([beam] * (len(cid) + len(a)), pa.int32())})

    keys = ["dim", "shard", "block"]
    met = asked.select(*keys, "cid", "rep", "embedding").groupBy(*keys).cogroup(held.groupBy(*keys))
    return settle(met.applyInArrow(search, "cid long, n long, a long, b long, beam int"), "vector-links")


def near_vectors(vectors: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """vec_id, n_links, component_id, kept of each row."""
    classes = vector_classes(vectors)
    n, dim = classes.agg(F.count("*"), F.coalesce(F.max("dim"), F.lit(1))).first()
    rows = max(1, min(SHARD_ROWS, SHARD_BYTES // (4 * dim)))
    shards, blocks = max(SHARDS, -(-n // rows)), max(1, -(-n // rows))
    found = search_shards(classes, build_shards(classes, shards), shards, blocks, threshold)
    counts = found.filter("cid is not null").groupBy(F.col("cid").alias("of")).agg(F.sum("n").alias("n"))
    parts = settle(connected_components(found.filter("a is not null").select("a", "b")), "vector-components")
    named = classes.join(counts, F.col("cid") == F.col("of"), "left").join(parts, F.col("rep") == F.col("node"), "left")
    named = named.select(F.col("embedding").alias("class"), (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n"), F.coalesce("component", "rep").alias("component"))
    out = vectors.select("vec_id", "embedding").join(named, F.col("vec_id").isNotNull() & (F.col("embedding") == F.col("class")), "left")
    component = F.when(F.col("vec_id").isNotNull(), F.coalesce(F.col("component"), F.col("vec_id").cast("long")))
    linked = F.when(F.col("vec_id").isNull(), 0).otherwise(F.coalesce("n", F.lit(0))).cast("long")
    return out.select("vec_id", linked.alias("n_links"), component.alias("component_id"), F.coalesce(F.col("vec_id") == component, F.lit(False)).alias("kept"))
