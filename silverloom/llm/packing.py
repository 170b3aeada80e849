"""Best-fit packing with large-item matching (operator 4).

Texts become pieces of at most ``capacity`` tokens. How pieces share sequences depends on their
lengths alone, so the plan is made on the counts by length (at most ``capacity`` numbers, whatever
the corpus): pieces above one third of the capacity are matched greedily, the largest with the
largest that fits, two to a sequence at most; smaller ones, longest first, go to the tightest gap.
Whole runs of equal lengths and equal gaps are placed at once, so the plan is a bounded table of runs:
(length, ranks from, to) -> (first sequence, offset). A piece's rank among those of its length comes
from counts by (length, hash bucket) and a row number within the bucket, so no length is ever
gathered in one task.

Defined results: a null or empty text is the end token alone; repeated rows are packed each for
itself; equal pieces are interchangeable; other columns are ignored; an empty table gives an empty
result. Only texts longer than the capacity are cut, and only their first piece may be shorter.
"""

from __future__ import annotations

import base64
import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window as W, functions as F

from .common import map_batches, settle, text_bytes

CAPACITY, END = 1024, 2
RANKS = "byte_bpe_50k.tiktoken"
#: A fixed value: the vocabulary's split of texts, with possessive runs, which match the same and need no way back.
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}++| ?\p{N}++| ?[^\s\p{L}\p{N}]++|\s++$|\s+(?!\S)|\s"
#: Pieces that a bucket of one length holds, about.
BUCKET = 200_000


class Tokenizer:
    """The byte-level BPE vocabulary: the same ids as the ``tokenizers`` library gives without added
    special tokens, by the ranks of that vocabulary, which is several times as fast."""

    def __init__(self, ranks: str | None = None):
        import public_tokenizers
        import tiktoken

        with open(ranks or public_tokenizers.path(RANKS), "rb") as file:
            merges = {base64.b64decode(a): int(b) for a, b in map(bytes.split, file)}
        self.made = tiktoken.Encoding("byte_bpe", pat_str=PATTERN, mergeable_ranks=merges, special_tokens={"<|endoftext|>": len(merges)})

    def ids(self, text: str) -> bytes:
        """Little-endian unsigned 32-bit numbers."""
        return self.made.encode_to_numpy(text, allowed_special="all").astype("<u4", copy=False).tobytes()


def cut(n: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of n tokens; only the first may be shorter than the capacity."""
    first = n % capacity or capacity
    return [(0, first), *((at, capacity) for at in range(first, n, capacity))]


def pieces(docs: DataFrame, capacity: int = CAPACITY, end: int = END, ranks: str | None = None) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 of every piece of every document."""
    made: list[Tokenizer] = []
    tail = np.array([end], "<u4").tobytes()

    def prepare() -> None:
        made[:] = made or [Tokenizer(ranks)]

    def each(batch: pa.RecordBatch) -> dict:
        row, out = [], {"piece": [], "start": [], "length": [], "ids_crc32": []}
        for at, text in enumerate(text_bytes(batch.column("text"))):
            ids = memoryview((made[0].ids(text.decode()) if text else b"") + tail)
            for number, (start, length) in enumerate(cut(len(ids) // 4, capacity)):
                row.append(at)
                out["piece"].append(number)
                out["start"].append(start)
                out["length"].append(length)
                out["ids_crc32"].append(zlib.crc32(ids[4 * start : 4 * (start + length)]))
        return {"doc_id": batch.column("doc_id").take(pa.array(row, pa.int64()))} | out

    kind = docs.schema["doc_id"].dataType.simpleString()
    return map_batches(docs.select("doc_id", "text"), f"doc_id {kind}, piece int, start long, length long, ids_crc32 long", each, prepare)


class Plan:
    """Runs of sequences of equal filling; placing a run of equal lengths moves it to its new gap."""

    def __init__(self, capacity: int):
        self.capacity, self.used = capacity, 0
        self.open: dict[int, list[tuple[int, int]]] = defaultdict(list)  # gap: runs (first sequence, how many)
        self.rank: dict[int, int] = defaultdict(int)
        self.rows: list[tuple[int, int, int, int, int]] = []  # length, rank from, to, first sequence, offset

    def new(self, n: int) -> None:
        if n:
            self.open[self.capacity].append((self.used, n))
            self.used += n

    def place(self, length: int, gap: int, n: int) -> None:
        """n pieces of the length, one to a sequence, in sequences that have this gap."""
        runs = self.open[gap]
        while n:
            first, size = runs.pop()
            k = min(n, size)
            self.rows.append((length, self.rank[length], self.rank[length] + k, first, self.capacity - gap))
            self.rank[length] += k
            if gap > length:
                self.open[gap - length].append((first, k))
            if size > k:
                runs.append((first + k, size - k))
            n -= k

    def held(self, gap: int) -> int:
        return sum(n for _, n in self.open[gap])


def plan_packing(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, int, int, int, int]]:
    """The runs that pack so many pieces of each length."""
    plan, left = Plan(capacity), {k: v for k, v in counts.items() if v}
    large = sorted((k for k in left if 3 * k > capacity), reverse=True)
    for a in large:
        while left[a]:
            b = next((x for x in large if x <= min(a, capacity - a) and left[x] > (x == a)), None)
            if b is None:
                n = left[a]
                plan.new(n)
                plan.place(a, capacity, n)
                left[a] = 0
                break
            n = left[a] // 2 if a == b else min(left[a], left[b])
            plan.new(n)
            plan.place(a, capacity, n)
            plan.place(b, capacity - a, n)
            left[a] -= n
            left[b] -= n
    for a in sorted((k for k in left if 3 * k <= capacity), reverse=True):
        n, gap = left[a], a
        while n:
            while gap < capacity and not plan.open.get(gap):
                gap += 1
            if gap >= capacity:  # no sequence has room: new ones, each filled with as many as it holds
                each = capacity // a
                plan.new(-(-n // each))
                for at in range(each):
                    k = min(n, plan.held(capacity - at * a))
                    plan.place(a, capacity - at * a, k)
                    n -= k
                break
            k = min(n, plan.held(gap))
            plan.place(a, gap, k)
            n -= k
            gap = a  # what is left of a gap may be the tightest now
    return plan.rows


def ranked(cuts: DataFrame, bucket: int = BUCKET) -> DataFrame:
    """Each piece's place among those of its length, without gathering a length in one task."""
    n = max(64, cuts.count() // bucket)
    dealt = cuts.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(n)))
    sums = dealt.groupBy("length", "bucket").agg(F.count("*").alias("n"))
    before = W.partitionBy("length").orderBy("bucket").rowsBetween(W.unboundedPreceding, -1)
    sums = sums.select(F.col("length").alias("l"), F.col("bucket").alias("b"), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    place = F.row_number().over(W.partitionBy("length", "bucket").orderBy("doc_id", "piece", "ids_crc32"))
    numbered = dealt.withColumn("place", place)
    return numbered.join(sums, (F.col("length") == F.col("l")) & (F.col("bucket") == F.col("b"))).withColumn("rank", F.col("before") + F.col("place") - 1).drop("l", "b", "before", "place", "bucket")


def pack(docs: DataFrame, capacity: int = CAPACITY, end: int = END, ranks: str | None = None) -> DataFrame:
    """A row for each piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset."""
    cuts = settle(pieces(docs, capacity, end, ranks), "pieces")
    counts = {r["length"]: r["count"] for r in cuts.groupBy("length").count().collect()}  # at most ``capacity`` rows
    rows = np.array(sorted(plan_packing(counts, capacity)), np.int64).reshape(-1, 5)
    starts = (rows[:, 0] << 44) + rows[:, 1]
    names = ["doc_id", "piece", "start", "length", "ids_crc32"]

    def each(batch: pa.RecordBatch) -> dict:
        length, rank = batch.column("length").to_numpy(), batch.column("rank").to_numpy()
        run = np.searchsorted(starts, (length << 44) + rank, side="right") - 1
        return {c: batch.column(c) for c in names} | {"sequence_id": rows[run, 3] + rank - rows[run, 1], "offset": rows[run, 4]}

    kind = docs.schema["doc_id"].dataType.simpleString()
    return map_batches(ranked(cuts).select(*names, F.col("rank").cast("long").alias("rank")), f"doc_id {kind}, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long", each)
