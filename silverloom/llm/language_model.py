"""Scores of whole texts by a gated recurrent language model (operator 5).

Words are counted over all training documents. The model's outputs are the most frequent words, of
which it takes more the more distinct words there are, and the endings (``ENDING`` letters) of all
other words: P(class | state) * P(output | class, state), with classes of like frequency and of about
the square root of the number of outputs. A word that is no output has its share of its ending by
absolute discounting: (c - d) / T of the ending's T tokens, and d * types / T for all words with that
ending that training never saw. So the model is a distribution over the word types of training and an
unseen one for each ending; the unigram base has one unseen type for all.

A GRU reads the text; it is trained by truncated backpropagation in numpy: ``ROUNDS`` rounds, in each
of which shards of the training documents are trained from the same parameters in parallel, state
carried from window to window, and the parameters averaged. Every training document is in one of
the rounds. Texts are scored whole, many in step, with state carried across windows.

Counts of the most frequent words (``HEAD`` at most) are known to every worker; what texts hold of all
other words goes through a join with the table of counts, which is never broadcast or collected.

Defined results: a null or empty text is the end token alone; a null doc_id has the remainder of an
empty text (0: held out); without training documents the counts are zero, the base is even over one
unseen type and the model knows the end token and the unseen type alone; repeated rows each get their row; a doc_id's
rows are all in training or none; columns other than doc_id and text are ignored; an empty table gives
an empty result.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from .common import remainder, schema_with, settle, text_bytes, to_arrow

END = b"\n"  # no word holds white space
HIDDEN, HEAD = 32, 200_000
#: Words of the model: so many times the square root of the distinct words, but at least the second;
#: endings: at most so many, of so many bytes, on as much of the text as their own words have.
WORDS_A_ROOT, FEWEST_WORDS, ENDINGS, ENDING = 1.5, 512, 256, 3
#: Training: rounds, tokens a shard has about, streams, windows that a shard has at least, steps back, rates.
ROUNDS, SHARD_TOKENS, STREAMS, WINDOWS, STEPS = 3, 2_000_000, 512, 150, 24
RATES = (0.006, 0.004, 0.002)
#: Scoring: documents in step, tokens a block holds, tokens a window holds.
TOGETHER, BLOCK_TOKENS, WINDOW_TOKENS = 4096, 3_000_000, 32_768
#: Rows that go through the outputs together, so that they stay in a core's cache.
PIECE = 512
#: Words that a counting task holds before it passes them on.
HELD = 300_000


def tokens_of(text: bytes) -> list[bytes]:
    words = text.lower().split()  # of bytes: A-Z only, at \x20 and \x09-\x0D only
    words.append(END)
    return words


def exp_sums(logits: np.ndarray) -> tuple[np.ndarray, np.ndarray] | None:
    """exp and its sums by row, unless one overflows or has nothing left."""
    with np.errstate(over="ignore"):
        got = np.exp(logits)
        sums = got @ np.ones(got.shape[1], got.dtype)
    return (got, sums) if sums.min() > 1e-20 and sums.max() < 1e30 else None


def softmax(logits: np.ndarray) -> np.ndarray:
    """By row, maybe in place; with the largest taken out first where it overflows or nothing is left."""
    if plain := exp_sums(logits):
        got, sums = plain
        got *= (1 / sums)[:, None]
        return got
    logits -= logits.max(1, keepdims=True)
    np.exp(logits, out=logits)
    logits /= logits.sum(1, keepdims=True)
    return logits


def log_sums(logits: np.ndarray) -> np.ndarray:
    """Log of the sum of exp, by row; with the largest taken out first where it overflows or nothing is left."""
    if plain := exp_sums(logits):
        return np.log(plain[1])
    top = logits.max(1)
    return top + np.log(np.exp(logits - top[:, None]).sum(1))


@dataclass
class Vocabulary:
    """The model's outputs in order of their tokens: words, END among them, and endings (None: all other
    endings), with their tokens; of the endings also the types, and the discount d."""

    words: dict[bytes, int]
    endings: dict[bytes | None, int]
    tokens: np.ndarray
    types: dict[int, int]
    discount: float

    def place(self, word: bytes) -> int:
        got = self.words.get(word)
        return got if got is not None else self.ending(word)

    def ending(self, word: bytes) -> int:
        got = self.endings.get(word[-ENDING:])
        return got if got is not None else self.endings[None]

    def share(self, place: int, count: float) -> float:
        """log10 of the share that a word of such a count has of its ending; 0: all unseen words."""
        whole = max(self.tokens[place], 1e-9)
        part = count - self.discount if count else self.discount * self.types[place]
        return float(np.log10(part / whole)) if part > 0 and self.tokens[place] else 0.0

    @property
    def class_size(self) -> int:
        return 1 << max(3, round(np.log2(len(self.tokens)) / 2))


class Places(dict):
    """The outputs of words, remembered."""

    def __init__(self, vocabulary: Vocabulary):
        super().__init__(vocabulary.words)
        self.of = vocabulary

    def __missing__(self, word: bytes) -> int:
        got = self.of.ending(word)
        if len(self) < HEAD:
            self[word] = got
        return got


class Recurrent:
    """Parameters of the network, and its passes."""

    def __init__(self, parameters: dict[str, np.ndarray]):
        self.p = parameters
        self.rooms: dict[str, np.ndarray] = {}

    def room(self, name: str, *shape: int) -> np.ndarray:
        """Memory of that shape, the same each time: what is new from the system costs more than what is done in it."""
        got = self.rooms.get(name)
        if got is None or got.shape != shape or got.dtype != self.p["loop"].dtype:
            got = self.rooms[name] = np.empty(shape, self.p["loop"].dtype)
        return got

    @classmethod
    def fresh(cls, words: Vocabulary, hidden: int = HIDDEN, seed: int = 7) -> "Recurrent":
        rng, k, size = np.random.default_rng(seed), len(words.tokens), words.class_size
        c = -(-k // size)
        mass = np.zeros(c * size)
        mass[:k] = words.tokens + 0.1
        by_class = mass.reshape(c, size)
        with np.errstate(divide="ignore"):
            inner = np.log(by_class)
        normal = lambda *shape, scale: (rng.standard_normal(shape) * scale).astype(np.float32)
        return cls(
            {
                "embed": normal(k, hidden, scale=0.3),
                "into": normal(hidden, 3 * hidden, scale=hidden**-0.5),
                "bias": np.zeros(3 * hidden, np.float32),
                "loop": normal(hidden, 3 * hidden, scale=hidden**-0.5),
                "class": normal(hidden, c, scale=0.05),
                "class_bias": np.log(by_class.sum(1)).astype(np.float32),
                "word": normal(c, hidden, size, scale=0.05),
                "word_bias": np.where(np.isfinite(inner), inner, -1e9).astype(np.float32),
            }
        )

    @property
    def class_size(self) -> int:
        return self.p["word"].shape[2]

    def inputs(self) -> np.ndarray:
        """The gates' part of every word, once for all."""
        return self.p["embed"] @ self.p["into"] + self.p["bias"]

    def step(self, x: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, ...]:
        """x: the input's part of the gates, as inputs() has it. New state, and what the way back needs."""
        return advance(gate_by_gate(x), h, gate_by_gate(self.p["loop"]), np.empty((5, *h.shape), h.dtype))

    def outputs(self) -> tuple[np.ndarray, np.ndarray]:
        """Weights of classes and of words, biases below them: for states with a one behind."""
        return np.concatenate([self.p["class"], self.p["class_bias"][None]]), np.concatenate([self.p["word"], self.p["word_bias"][:, None]], 1)

    def log_probabilities(self, h: np.ndarray, ids: np.ndarray) -> np.ndarray:
        """Natural log of P(output | state)."""
        to_class, to_word = self.outputs()
        classes, inside = np.divmod(ids, self.class_size)
        order, runs = by_class(classes, len(to_word))
        out, every = np.empty(len(ids), h.dtype), np.arange(PIECE)
        for c, rows in runs:
            at = order[rows]
            some = with_ones(h.take(at, 0))
            logits, inner = some @ to_class, some @ to_word[c]
            out[at] = logits[:, c] + inner[every[: len(at)], inside[at]] - log_sums(logits) - log_sums(inner)
        return out

    def gradients(self, ids: np.ndarray, before: np.ndarray, state: np.ndarray, end: int) -> tuple[float, dict[str, np.ndarray], np.ndarray]:
        """Loss and gradients over a window. ids: (steps, streams); before: the tokens ahead of them;
        the state restarts after an END. Returns the state that the next window goes on from."""
        p, (steps, streams), n = self.p, ids.shape, state.shape[1]
        table, loop, kind = gate_by_gate(self.inputs()), gate_by_gate(p["loop"]), p["loop"].dtype
        ends = [np.flatnonzero(x == end) for x in before]
        ahead, states, kept = self.room("ahead", steps, streams, n), self.room("states", steps, streams, n + 1), self.room("kept", steps, 5, streams, n)
        x, states[:, :, n] = self.room("x", 3, streams, n), 1
        for t in range(steps):
            ahead[t] = states[t - 1, :, :n] if t else state
            ahead[t, ends[t]] = 0
            table.take(before[t], 1, out=x, mode="clip")
            states[t, :, :n] = advance(x, ahead[t], loop, kept[t])[0]
        to_class, to_word = self.outputs()
        from_class, from_word = np.ascontiguousarray(p["class"].T), np.ascontiguousarray(p["word"].transpose(0, 2, 1))
        classes, inside = np.divmod(ids.ravel(), self.class_size)
        g_class, g_word = np.zeros_like(to_class), np.zeros_like(to_word)
        flat, d, hits, every = states.reshape(-1, n + 1), self.room("d", steps * streams, n), np.empty((2, ids.size), kind), np.arange(PIECE)
        for a in range(0, len(flat), PIECE):
            some = flat[a : a + PIECE]
            share, hit = softmax(some @ to_class), (every[: len(some)], classes[a : a + PIECE])
            hits[0, a : a + PIECE] = share[hit]
            share[hit] -= 1
            g_class += some.T @ share
            np.matmul(share, from_class, out=d[a : a + PIECE])
        order, runs = by_class(classes, len(to_word))
        for c, rows in runs:
            at = order[rows]
            some, hit = flat.take(at, 0), (every[: len(at)], inside[at])
            inner = softmax(some @ to_word[c])
            hits[1, rows] = inner[hit]
            inner[hit] -= 1
            g_word[c] += some.T @ inner
            d[at] += inner @ from_word[c]
        loss = -np.log(np.maximum(hits, 1e-30)).sum()
        d = d.reshape(steps, streams, n)
        down = np.zeros((streams, n), kind)
        into, looped = self.room("into", 3, steps, streams, n), self.room("looped", steps, 3, streams, n)
        loop = np.ascontiguousarray(p["loop"].reshape(n, 3, n).transpose(1, 2, 0))
        for t in reversed(range(steps)):
            z, r, back, new, over = kept[t]
            dz, dr, dnew = into[:, t]
            dh, rest = d[t], 1 - z
            dh += down
            np.multiply(new, new, out=dnew)
            np.subtract(1, dnew, out=dnew)
            dnew *= rest
            dnew *= dh
            np.multiply(over, z, out=dz)
            dz *= rest
            dz *= dh
            np.multiply(dnew, r, out=looped[t, 2])
            np.subtract(1, r, out=dr)
            dr *= back
            dr *= looped[t, 2]
            looped[t, :2] = into[:2, t]
            np.multiply(dh, z, out=down)
            for x in looped[t] @ loop:
                down += x
            down[ends[t]] = 0
        g_loop = sum(ahead[t].T @ looped[t] for t in range(steps))
        words = sums_by_word(before.ravel(), into.reshape(3, -1, n), len(table[0]))
        g = {
            "embed": words @ p["into"].T,
            "into": p["embed"].T @ words,
            "bias": words.sum(0),
            "loop": g_loop.transpose(1, 0, 2).reshape(n, 3 * n),
            "class": g_class[:-1],
            "class_bias": g_class[-1],
            "word": g_word[:, :-1],
            "word_bias": g_word[:, -1],
        }
        return float(loss), g, states[-1, :, :n].copy()


def gate_by_gate(x: np.ndarray) -> np.ndarray:
    """Columns of the three gates, each apart; those of the sigmoids halved, as ``advance`` takes them."""
    got = np.ascontiguousarray(x.reshape(len(x), 3, -1).transpose(1, 0, 2))
    got[:2] *= 0.5
    return got


def advance(x: np.ndarray, h: np.ndarray, loop: np.ndarray, room: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """x, loop: gate by gate. New state, and room with what the way back needs. A sigmoid is (1 + tanh of the half) / 2."""
    gates, (z, r, back, new, over) = room[:2], room
    np.matmul(h, loop, out=room[:3])
    gates += x[:2]
    np.tanh(gates, out=gates)
    gates *= 0.5
    gates += 0.5
    np.multiply(r, back, out=new)
    new += x[2]
    np.tanh(new, out=new)
    np.subtract(h, new, out=over)
    out = z * over
    out += new
    return out, room


def with_ones(h: np.ndarray) -> np.ndarray:
    """The states, each with a one behind."""
    out = np.ones((len(h), h.shape[1] + 1), h.dtype)
    out[:, :-1] = h
    return out


def sums_by_word(ids: np.ndarray, x: np.ndarray, n: int) -> np.ndarray:
    """x: (gates, tokens, columns). Sums over the tokens of each word, gates side by side: products with
    rows of a single one, for 32 words together."""
    one, blocks = np.eye(32, dtype=x.dtype), -(-n // 32)
    order, runs = by_class(ids // 32, blocks)
    inside = (ids % 32)[order]
    out = np.zeros((len(x), blocks, 32, x.shape[2]), x.dtype)
    for k, rows in runs:
        out[:, k] += one.take(inside[rows], 0).T @ x.take(order[rows], 1)
    return out.reshape(len(x), -1, x.shape[2])[:, :n].transpose(1, 0, 2).reshape(n, -1)


def by_class(classes: np.ndarray, n: int) -> tuple[np.ndarray, list[tuple[int, slice]]]:
    """The order that brings equal classes together, and where each of them then lies, PIECE rows at most together."""
    order = np.argsort(classes.astype(np.int16), kind="stable")  # of 16 bits: sorted by radix
    edges = np.searchsorted(classes[order], np.arange(n + 1)).tolist()
    return order, [(c, slice(i, min(i + PIECE, b))) for c, (a, b) in enumerate(zip(edges, edges[1:])) for i in range(a, b, PIECE)]


def train(model: Recurrent, ids: np.ndarray, end: int, rate: float) -> Recurrent:
    """One pass over a sequence of documents, each closed by END, dealt to streams that are read in step."""
    streams = int(max(1, min(max(8, min(STREAMS, len(ids) // (WINDOWS * STEPS))), len(ids) // STEPS)))
    length = len(ids) // streams
    rows = ids[: length * streams].reshape(streams, length).T
    ahead = np.vstack([np.full((1, streams), end, rows.dtype), rows[:-1]])
    state = np.zeros((streams, model.p["loop"].shape[0]), np.float32)
    first = {k: np.zeros_like(v) for k, v in model.p.items()}
    second = {k: np.zeros_like(v) for k, v in model.p.items()}
    windows = range(0, length, STEPS)
    for number, at in enumerate(windows, 1):
        some, before = rows[at : at + STEPS].astype(np.int64), ahead[at : at + STEPS].astype(np.int64)
        _, g, state = model.gradients(some, before, state, end)
        size = 1 / some.size
        norm = size * float(np.sqrt(sum((v.astype(np.float64) ** 2).sum() for v in g.values())))
        size /= max(1.0, norm)
        speed = rate * min(1.0, number / 20) * (1 - 0.7 * number / len(windows))
        for k, v in model.p.items():
            grad = g[k] * np.float32(size)
            first[k] += np.float32(0.1) * (grad - first[k])
            second[k] += np.float32(0.01) * (grad * grad - second[k])
            v -= np.float32(speed / (1 - 0.9**number)) * first[k] / (np.sqrt(second[k] / np.float32(1 - 0.99**number)) + np.float32(1e-6))
    return model


def score_documents(model: Recurrent, documents: list[np.ndarray], end: int) -> np.ndarray:
    """Natural log probability of each document (ids with END last), all read in step."""
    sizes = np.array([len(x) for x in documents], np.int64)
    order = np.argsort(-sizes, kind="stable")
    lengths, flat = sizes[order], np.concatenate(documents) if documents else np.zeros(0, np.uint16)
    starts = (np.cumsum(sizes) - sizes)[order]
    table, loop, out = gate_by_gate(model.inputs()), gate_by_gate(model.p["loop"]), np.zeros(len(order))
    h = np.zeros((len(order), len(model.p["loop"])), table.dtype)
    room, last = np.empty((5, *h.shape), h.dtype), np.full(len(order), end, np.int64)
    longest = int(lengths[0]) if len(order) else 0
    live = np.searchsorted(-lengths, -np.arange(longest))  # documents that have a token at each place
    at = 0
    while at < longest:
        states, ids, size, first = [], [], 0, at
        while at < longest and (not size or size + live[at] <= WINDOW_TOKENS):
            n = int(live[at])
            h = advance(table.take(last[:n], 1), h[:n], loop, room[:, :n])[0]
            last = flat[starts[:n] + at].astype(np.int64, copy=False)
            states.append(h)
            ids.append(last)
            size += n
            at += 1
        got = model.log_probabilities(np.concatenate(states), np.concatenate(ids))
        done = 0
        for n in live[first:at].tolist():
            out[:n] += got[done : done + n]
            done += n
    scores = np.empty(len(order))
    scores[order] = out
    return scores


def count_words(docs: DataFrame) -> DataFrame:
    """word, c: how often each word stands in the texts, END once in each."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter[bytes] = Counter()
        put = lambda: pa.RecordBatch.from_arrays([pa.array(list(seen), pa.binary()), pa.array(list(seen.values()), pa.int64())], names=["word", "c"])
        for batch in batches:
            for text in text_bytes(batch.column("text")):
                seen.update(tokens_of(text))
                if len(seen) > HELD:
                    yield put()
                    seen.clear()
        if seen:
            yield put()

    return docs.select("text").mapInArrow(count, "word binary, c long").groupBy("word").agg(F.sum("c").alias("c"))


def frequent(counts: DataFrame, most: int) -> tuple[list[bytes], np.ndarray]:
    """At most so many of the most frequent words, those of equal counts together or not at all; by
    count, then word. The counts of words by size of count (a bounded table) give the threshold."""
    size = F.floor(16 * F.log2("c"))
    sizes = {r["size"]: (r["n"], r["low"]) for r in counts.groupBy(size.alias("size")).agg(F.count("*").alias("n"), F.min("c").alias("low")).collect()}
    total, low = 0, None
    for s in sorted(sizes, reverse=True):
        total += sizes[s][0]
        if total > most:
            break
        low = sizes[s][1]
    if low is None:
        return [], np.zeros(0)
    got = counts.filter(F.col("c") >= low).toArrow()  # ``most`` rows at most
    rows = sorted(zip(got["word"].to_pylist(), got["c"].to_pylist()), key=lambda r: (-r[1], r[0]))
    return [w for w, _ in rows], np.array([c for _, c in rows], float)


def model_words(words: list[bytes], counts: np.ndarray, types: int) -> tuple[dict[bytes, int], np.ndarray]:
    """The words that are outputs, END among them, and their counts."""
    most = max(FEWEST_WORDS, round(WORDS_A_ROOT * types**0.5))
    picked = words[:most] if END in words[:most] else [*words[: most - 1], END]
    by = dict(zip(words, counts))
    return picked, np.array([by.get(w, 0.0) for w in picked])


def model_endings(counts: DataFrame, picked: list[bytes]) -> list[tuple[bytes | None, int, int, int, int]]:
    """ending, tokens, types, types seen once and twice, of the words that are no outputs: the ENDINGS
    with most tokens, and None for all others."""
    own = counts.sparkSession.createDataFrame([(w,) for w in picked], "w binary")  # as many as the model's words
    rest = counts.join(F.broadcast(own), F.col("word") == F.col("w"), "left_anti")
    sums = (F.sum("c").alias("tokens"), F.count("*").alias("types"), F.count_if(F.col("c") == 1).alias("once"), F.count_if(F.col("c") == 2).alias("twice"))
    by = rest.groupBy(F.substring("word", -ENDING, ENDING).alias("ending")).agg(*sums)
    top = settle(by, "word-endings").orderBy(F.desc("tokens"), "ending")
    rows = [(bytes(r["ending"]), r["tokens"], r["types"], r["once"], r["twice"]) for r in top.limit(ENDINGS).collect()]
    every = top.agg(*(F.coalesce(F.sum(c), F.lit(0)) for c in ("tokens", "types", "once", "twice"))).first()
    return [*rows, (None, *(int(x) - sum(r[i] for r in rows) for i, x in enumerate(every, 1)))]


def make_vocabulary(picked: list[bytes], counts: np.ndarray, endings: list[tuple[bytes | None, int, int, int, int]]) -> Vocabulary:
    items = [(float(c), w, 0) for w, c in zip(picked, counts)] + [(float(r[1]), r[0], i + 1) for i, r in enumerate(endings)]
    items.sort(key=lambda x: (-x[0], x[2] > 0, x[1] or b"", x[1] is None))
    words, places, types = {}, {}, {}
    for place, (_, name, of) in enumerate(items):
        if of:
            places[name], types[place] = place, endings[of - 1][2]
        else:
            words[name] = place
    once, twice = (sum(r[i] for r in endings) for i in (3, 4))
    return Vocabulary(words, places, np.array([x[0] for x in items]), types, min(0.95, max(0.05, once / max(once + 2 * twice, 1))))


def train_model(docs: DataFrame, words: Vocabulary, tokens: int, rounds: int = ROUNDS) -> Recurrent:
    """docs: the training documents. Rounds of parallel training over shards, then averaging."""
    model = Recurrent.fresh(words)
    if not tokens or not rounds:
        return model
    end = words.words[END]
    shards = max(1, round(tokens / rounds / SHARD_TOKENS))
    used = docs.select("doc_id", "text", F.pmod(F.xxhash64(F.lit("round"), "doc_id"), F.lit(rounds)).cast("int").alias("round"), F.pmod(F.xxhash64(F.lit("shard"), "doc_id"), F.lit(shards)).alias("shard"))
    schema = schema_with(used, ["round", "shard"], "order long, ids binary")

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Places(words)
        for batch in batches:
            made = [np.array([known[w] for w in tokens_of(x)], np.int32).tobytes() for x in text_bytes(batch.column("text"))]
            keys = [int.from_bytes(x[:7], "little") ^ len(x) for x in made]
            yield pa.RecordBatch.from_arrays([batch.column("round"), batch.column("shard"), pa.array(keys, pa.int64()), pa.array(made, pa.binary())], schema=to_arrow(schema))

    encoded = settle(used.mapInArrow(encode, schema), "training-ids")
    for number in range(rounds):
        parameters = model.p

        def learn(table: pa.Table) -> pa.Table:
            rows = sorted(zip(table["order"].to_pylist(), table["ids"].to_pylist()))
            rng = np.random.default_rng(number)
            rows = [rows[i][1] for i in rng.permutation(len(rows))]
            one = train(Recurrent({k: v.copy() for k, v in parameters.items()}), np.frombuffer(b"".join(rows), np.int32), end, RATES[min(number, len(RATES) - 1)])
            names = list(one.p)
            return pa.table({"name": names, "n": pa.array([1] * len(names), pa.int64()), "v": pa.array([one.p[k].tobytes() for k in names], pa.binary())})

        def add(sums: dict[str, list], batch: pa.RecordBatch | pa.Table) -> None:
            for name, n, v in zip(batch["name"].to_pylist(), batch["n"].to_pylist(), batch["v"]):
                v = np.frombuffer(v.as_buffer(), np.float32)
                if name in sums:
                    sums[name][0] += n
                    sums[name][1] += v
                else:
                    sums[name] = [n, v.astype(float)]

        def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            """One sum a task, so that what meets below doesn't grow with the shards."""
            sums: dict[str, list] = {}
            for batch in batches:
                add(sums, batch)
            if sums:
                yield pa.RecordBatch.from_pydict({"name": list(sums), "n": pa.array([n for n, _ in sums.values()], pa.int64()), "v": pa.array([v.astype(np.float32).tobytes() for _, v in sums.values()], pa.binary())})

        def average(table: pa.Table) -> pa.Table:
            sums: dict[str, list] = {}
            add(sums, table)
            return pa.table({"name": list(sums), "v": pa.array([(v / n).astype(np.float32).tobytes() for n, v in sums.values()], pa.binary())})

        kind = "name string, n long, v binary"
        learnt = encoded.filter(F.col("round") == number).groupBy("shard").applyInArrow(learn, kind).mapInArrow(summed, kind)
        got = learnt.groupBy("name").applyInArrow(average, "name string, v binary").collect()  # one row a parameter
        if got:
            model = Recurrent({r["name"]: np.frombuffer(r["v"], np.float32).reshape(parameters[r["name"]].shape).copy() for r in got})
    return model


def read_texts(docs: DataFrame, keep: list[str], words: list[bytes], counts: np.ndarray, vocabulary: Vocabulary, model: Recurrent) -> DataFrame:
    """For each document: keep, n_tokens, n_head (known tokens among frequent words), base_head and
    lm_head (sums of log10), and tail: its other words with their numbers, log10 of their ending's
    tokens, and of the share that unseen words have of it."""
    kept = docs.select(*keep, "text")
    schema = schema_with(kept, keep, "n_tokens long, n_head long, base_head double, lm_head double, tail array<struct<word: binary, n: long, whole: double, unseen: double>>")
    place = {w: i for i, w in enumerate(words)}
    weight = np.log10(counts + 0.1)
    own = np.array([vocabulary.place(w) for w in words] + [0], np.int64)  # the model's output for each frequent word
    inner = np.array([0.0 if w in vocabulary.words else vocabulary.share(vocabulary.ending(w), c) for w, c in zip(words, counts)] + [0.0])
    whole = np.log10(np.maximum(vocabulary.tokens, 1.0))
    unseen = {i: vocabulary.share(i, 0) for i in vocabulary.types}
    end, ln10 = vocabulary.words[END], np.log(10)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        get, target, rest_place = place.get, to_arrow(schema), vocabulary.endings[None]
        held: list[pa.RecordBatch] = []
        rows: list[tuple] = []
        ids: list[np.ndarray] = []
        tails: list[bytes] = []
        numbers: list[int] = []
        of: list[int] = []
        edges, size = [0], 0

        def done() -> pa.RecordBatch:
            columns = list(zip(*rows))
            columns[3] = np.array(columns[3]) + score_documents(model, ids, end) / ln10
            first = [pa.concat_arrays([b.column(c) for b in held]) for c in keep]
            plain = [pa.array(v, target.field(len(keep) + i).type) for i, v in enumerate(columns)]
            kind = target.field(len(target) - 1).type
            parts = [pa.array(tails, pa.binary()), pa.array(numbers, pa.int64()), pa.array(whole[of], pa.float64()), pa.array([unseen[i] for i in of], pa.float64())]
            rest = pa.StructArray.from_arrays(parts, fields=list(kind.value_type))
            return pa.RecordBatch.from_arrays([*first, *plain, pa.ListArray.from_arrays(pa.array(edges, pa.int32()), rest, type=kind)], schema=target)

        for batch in batches:
            fresh = 0
            for at, text in enumerate(text_bytes(batch.column("text"))):
                tokens = tokens_of(text)
                found = np.array([get(w, -1) for w in tokens], np.int64)
                known, lost = found[found >= 0], np.flatnonzero(found < 0).tolist()
                mine = own[found]
                if lost and lost[-1] == len(tokens) - 1 and END not in place:  # END is an output in any case
                    lost.pop()
                    tail = Counter([tokens[i] for i in lost])
                    tail[END] = 1
                    mine[-1] = end
                else:
                    tail = Counter([tokens[i] for i in lost])
                ends = {w: vocabulary.ending(w) for w in tail if w != END}
                for i in lost:
                    mine[i] = ends[tokens[i]]
                tails += tail.keys()
                numbers += tail.values()
                of += [ends.get(w, rest_place) for w in tail]
                edges.append(len(tails))
                rows.append((len(tokens), len(known), float(weight[known].sum()), float(inner[known].sum())))
                ids.append(mine)
                size += len(tokens)
                if len(ids) >= TOGETHER or size >= BLOCK_TOKENS:
                    held.append(batch.slice(fresh, at + 1 - fresh))
                    yield done()
                    held, rows, ids, tails, numbers, of, edges, size, fresh = [], [], [], [], [], [], [0], 0, at + 1
            if fresh < batch.num_rows:
                held.append(batch.slice(fresh))
        if ids:
            yield done()

    return kept.mapInArrow(read, schema)


def score_texts(docs: DataFrame, held_out: Column, rounds: int = ROUNDS) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of each document; held_out
    tells which documents no count and no training may see."""
    docs = docs.select("doc_id", "text", held_out.alias("held_out"))
    training = docs.filter("not held_out")
    counts = settle(count_words(training), "word-counts")
    total, types = counts.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*")).first()
    words, frequency = frequent(counts, HEAD)
    picked, own = model_words(words, frequency, types)
    vocabulary = make_vocabulary(picked, own, model_endings(counts, picked))
    model = train_model(training, vocabulary, total, rounds)
    named = docs.withColumn("row", F.monotonically_increasing_id())
    read = settle(read_texts(named, ["row", "doc_id", "held_out"], words, frequency, vocabulary, model), "texts-read")
    tail = read.select("row", F.inline("tail")).join(counts.withColumnRenamed("word", "w"), F.col("word") == F.col("w"), "left")
    c = F.coalesce("c", F.lit(0))
    share = F.when(F.col("word") == END, 0.0).when(c > 0, F.log10(c - vocabulary.discount) - F.col("whole")).otherwise(F.col("unseen"))
    sums = tail.groupBy(F.col("row").alias("of")).agg(F.sum(F.col("n") * F.log10(c + 0.1)).alias("tail_sum"), F.sum(F.when(c > 0, F.col("n")).otherwise(0)).alias("tail_known"), F.sum(F.col("n") * share).alias("tail_share"))
    found = read.drop("tail").join(sums, F.col("row") == F.col("of"), "left")
    zero = lambda x: F.coalesce(F.col(x), F.lit(0))
    return found.select(
        "doc_id",
        "held_out",
        "n_tokens",
        (F.col("n_head") + zero("tail_known")).cast("long").alias("n_known"),
        F.lit(total).cast("long").alias("train_tokens"),
        (F.col("base_head") + zero("tail_sum") - F.col("n_tokens") * float(np.log10(total + 0.1 * (types + 1)))).alias("base_score"),
        (F.col("lm_head") + zero("tail_share")).alias("score"),
    )


def held_out_tenth(column: str = "doc_id") -> Column:
    return remainder(column, 10) == 0
