"""The recurrent model: gradients, a proper distribution, reading in step; counts against brute force."""

import math
import re
import time
import zlib
from collections import Counter

import numpy as np
import pytest

from silverloom.llm import language_model as lm

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def vocabulary(tokens):
    n = len(tokens) - 1
    return lm.Vocabulary({str(i).encode(): i for i in range(n)}, {None: n}, tokens.astype(float), {n: 5}, 0.5)


def small_model(double=True, seed=1):
    rng = np.random.default_rng(seed)
    words = vocabulary(np.append(rng.integers(1, 50, 100), 30.0))
    model = lm.Recurrent.fresh(words, hidden=5)
    if double:
        model.p = {k: v.astype(float) for k, v in model.p.items()}
    return model


def test_gradients_by_finite_differences():
    model, rng = small_model(), np.random.default_rng(2)
    ids = rng.integers(0, 101, (6, 3))
    before = np.vstack([rng.integers(0, 101, (1, 3)), ids[:-1]])
    before[2, 1] = 4  # an end inside the window
    state = rng.standard_normal((3, 5)) / 3
    loss = lambda: model.gradients(ids, before, state, 4)[0]
    _, g, _ = model.gradients(ids, before, state, 4)
    for name, value in model.p.items():
        flat, slope = value.reshape(-1), g[name].reshape(-1)
        picks = [*rng.integers(0, flat.size, 12), *np.argsort(-np.abs(slope))[:6]]
        for i in picks:
            if flat[i] < -1e8:
                continue
            old = flat[i]
            flat[i] = old + 1e-5
            up = loss()
            flat[i] = old - 1e-5
            down = loss()
            flat[i] = old
            assert slope[i] == pytest.approx((up - down) / 2e-5, rel=1e-4, abs=1e-6), name


def test_a_proper_distribution():
    model = small_model()
    h = np.random.default_rng(3).standard_normal((4, 5))
    total = sum(np.exp(model.log_probabilities(h, np.full(4, i))) for i in range(101))
    assert total == pytest.approx(1)


def test_reading_in_step_equals_one_by_one(monkeypatch):
    model, rng = small_model(), np.random.default_rng(4)
    docs = [np.append(rng.integers(0, 101, n), 4) for n in (0, 1, 7, 7, 40, 300)]
    monkeypatch.setattr(lm, "WINDOW_TOKENS", 16)
    got = lm.score_documents(model, docs, 4)
    for doc, score in zip(docs, got):
        h, last, want = np.zeros((1, 5)), 4, 0.0
        for i in doc:
            h = model.step(model.inputs()[[last]], h)[0]
            want += model.log_probabilities(h, np.array([i]))[0]
            last = i
        assert score == pytest.approx(want)


def test_training_learns_a_pattern():
    words = vocabulary(np.append(np.full(10, 100.0), 1.0))
    model = lm.Recurrent.fresh(words, hidden=16)
    one = np.array([1, 2, 3, 4, 5, 6, 7, 0], np.int32)
    before = -lm.score_documents(model, [one], 0)[0] / len(one)
    after = -lm.score_documents(lm.train(model, np.tile(one, 40_000), 0, 0.01), [one], 0)[0] / len(one)
    assert after < 0.3 < 2 < before


def brute(rows):
    lower = lambda t: "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t)
    held = lambda i: zlib.crc32(("" if i is None else str(i)).encode()) % 10 == 0
    tokens = [(r.doc_id, held(r.doc_id), WORD.findall(lower(r.text or "")) + ["\n"]) for r in rows]
    count = Counter(w for _, h, t in tokens if not h for w in t)
    n, v = sum(count.values()), len(count)
    return sorted((-1 if i is None else i, h, len(t), sum(count[w] > 0 for w in t), n, sum(math.log10((count[w] + 0.1) / (n + 0.1 * (v + 1))) for w in t)) for i, h, t in tokens)


@pytest.mark.parametrize("head", [200_000, 50])
def test_counts_and_base(odd_docs, small_docs, head, monkeypatch):
    monkeypatch.setattr(lm, "HEAD", head)
    monkeypatch.setattr(lm, "FEWEST_WORDS", 40)
    for docs in (odd_docs, small_docs):
        got = lm.score_texts(docs, lm.held_out_tenth(), rounds=1).collect()
        rows = sorted((-1 if r.doc_id is None else r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, r.base_score) for r in got)
        for a, b in zip(rows, brute(docs.collect()), strict=True):
            assert a[:5] == b[:5] and a[5] == pytest.approx(b[5])
        assert all(r.score < 0 for r in got)


def test_score_needs_no_head(small_docs, monkeypatch):
    """The same scores, whether words are among the frequent ones or go through the join."""
    monkeypatch.setattr(lm, "FEWEST_WORDS", 40)
    monkeypatch.setattr(lm, "WORDS_A_ROOT", 0.1)
    monkeypatch.setattr(lm, "ENDINGS", 300)
    out = []
    for head in (200_000, 60):
        monkeypatch.setattr(lm, "HEAD", head)
        out.append({r.doc_id: r.score for r in lm.score_texts(small_docs, lm.held_out_tenth(), rounds=0).collect()})
    assert out[0] == pytest.approx(out[1])


def test_shares_of_an_ending_add_up(spark):
    """Seen words of an ending and its unseen type have all of it; so the model is a distribution over
    the words of training and an unseen type an ending."""
    from pyspark.sql import functions as F

    count = Counter({b"a": 900, b"the": 800, b"ming": 7, b"ling": 1, b"ning": 1, b"zzz": 2, b"qq": 1, b"\xc3\xa9t\xc3\xa9": 3, b"\n": 5})
    counts = spark.createDataFrame(list(count.items()), "word binary, c long").withColumn("c", F.col("c"))
    picked = [b"a", b"the", b"\n"]
    endings = lm.model_endings(counts, picked)
    made = lm.make_vocabulary(picked, np.array([900.0, 800.0, 5.0]), endings)
    assert made.words.keys() == set(picked) and endings[0] == (b"ing", 9, 3, 2, 0)
    assert made.ending(b"ming") == made.ending(b"sing") != made.ending(b"qq") and made.ending(b"other") == made.endings[None]
    for place, types in made.types.items():
        own = [c for w, c in count.items() if w not in picked and made.place(w) == place]
        assert len(own) == types and (not own or sum(10 ** made.share(place, c) for c in [*own, 0]) == pytest.approx(1))


def test_every_training_document_is_trained_on(small_docs, monkeypatch):
    """At production parameters: what reaches the network is all text that is not held out."""
    settle, seen = lm.settle, {}

    def keep(frame, name):
        seen[name] = settle(frame, name)
        return seen[name]

    monkeypatch.setattr(lm, "settle", keep)
    scored = lm.score_texts(small_docs, lm.held_out_tenth()).filter("not held_out").collect()
    sizes = sorted(len(r.ids) // 4 for r in seen["training-ids"].collect())
    assert sizes == sorted(r.n_tokens for r in scored) and sum(sizes) == scored[0].train_tokens


def test_production_parameters_beat_the_base(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = [r for r in lm.score_texts(docs, lm.held_out_tenth()).collect() if r.held_out]
    assert sum(r.score for r in rows) > 0.9 * sum(r.base_score for r in rows)


def test_no_documents(no_docs, odd_docs):
    assert lm.score_texts(no_docs, lm.held_out_tenth()).count() == 0
    from pyspark.sql import functions as F

    rows = lm.score_texts(odd_docs, F.lit(True)).collect()
    assert len(rows) == odd_docs.count() and {(r.train_tokens, r.n_known) for r in rows} == {(0, 0)}
    assert all(r.base_score == pytest.approx(0) for r in rows)


@pytest.mark.parametrize("kind", [np.float32, float])
def test_shares_of_any_logits(kind):
    """Whether they overflow, vanish or neither, and with places that no output has."""
    for shift in (0, 55, 300, -40, -300):
        logits = (np.random.default_rng(5).standard_normal((7, 9)) * 3 + shift).astype(kind)
        logits[:, -2:] = -1e9
        want = logits.astype(float) - logits.astype(float).max(1, keepdims=True)
        want = np.exp(want) / np.exp(want).sum(1, keepdims=True)
        assert lm.softmax(logits.copy()) == pytest.approx(want, rel=1e-4, abs=1e-12)
    mixed = np.array([[0, 1, 2], [-200, -201, -202], [80, 0, 0]], kind)
    assert lm.softmax(mixed[:2].copy())[:, 0] == pytest.approx([0.09003057, 0.66524096], rel=1e-4)
    assert lm.softmax(mixed.copy()).sum(1) == pytest.approx(np.ones(3), rel=1e-5)


def plain_window(model, ids, before, state, end):
    """The window's gradients by the equations as they stand, whole arrays at once."""
    p, (steps, streams), n, size = model.p, ids.shape, state.shape[1], model.class_size
    sigmoid = lambda x: 1 / (1 + np.exp(-x))
    shares = lambda x: (got := np.exp(x)) / got.sum(1, keepdims=True)
    table, h, kept, states = p["embed"] @ p["into"] + p["bias"], state, [], []
    for t in range(steps):
        h = h * (before[t] != end)[:, None]
        x, back = table.take(before[t], 0), h @ p["loop"]
        gates = sigmoid(x[:, : 2 * n] + back[:, : 2 * n])
        z, r, back = gates[:, :n], gates[:, n:], back[:, 2 * n :]
        new = np.tanh(x[:, 2 * n :] + r * back)
        kept.append((h, z, r, new, back))
        h = new + z * (h - new)
        states.append(h)
    flat, ys, every = np.concatenate(states), ids.ravel(), np.arange(ids.size)
    g = {k: np.zeros_like(v) for k, v in p.items()}
    classes, inside = ys // size, ys % size
    share = shares(flat @ p["class"] + p["class_bias"])
    loss = -np.log(share[every, classes]).sum()
    share[every, classes] -= 1
    g["class"], g["class_bias"], d = flat.T @ share, share.sum(0), share @ p["class"].T
    order = np.argsort(classes, kind="stable")
    for c in np.unique(classes):
        rows = order[slice(*np.searchsorted(classes[order], [c, c + 1]))]
        inner, at = shares(flat[rows] @ p["word"][c] + p["word_bias"][c]), (np.arange(len(rows)), inside[rows])
        loss -= np.log(inner[at]).sum()
        inner[at] -= 1
        g["word"][c], g["word_bias"][c] = flat[rows].T @ inner, inner.sum(0)
        d[rows] += inner @ p["word"][c].T
    d, down, into = d.reshape(steps, streams, n), 0, np.empty((steps, streams, 3 * n), flat.dtype)
    for t in reversed(range(steps)):
        h, z, r, new, back = kept[t]
        dh = d[t] + down
        dnew = dh * (1 - z) * (1 - new * new)
        dr, dz = dnew * back * r * (1 - r), dh * (h - new) * z * (1 - z)
        into[t], looped = np.concatenate([dz, dr, dnew], 1), np.concatenate([dz, dr, dnew * r], 1)
        g["loop"] += h.T @ looped
        down = (dh * z + looped @ p["loop"].T) * (before[t] != end)[:, None]
    into, ahead = into.reshape(-1, 3 * n), before.ravel()
    g["bias"], g["into"], embed = into.sum(0), p["embed"].take(ahead, 0).T @ into, into @ p["into"].T
    order = np.argsort(ahead, kind="stable")
    first = np.flatnonzero(np.r_[True, np.diff(ahead[order]) > 0])
    g["embed"][ahead[order][first]] = np.add.reduceat(embed.take(order, 0), first, axis=0)
    return float(loss), g, states[-1]


def test_a_window_equals_the_plain_form_and_costs_less():
    """At the size that training has: the same gradients, more than one piece of a class among them, in less CPU time."""
    rng, end, streams = np.random.default_rng(6), 4, lm.STREAMS
    model = lm.Recurrent.fresh(vocabulary(np.sort(1e6 / np.arange(1.0, 3001))[::-1]))
    made = np.minimum(rng.zipf(1.3, (lm.STEPS + 1, streams)) - 1, 2999)
    ids, before, state = made[1:], made[:-1], (rng.standard_normal((streams, lm.HIDDEN)) / 3).astype(np.float32)
    assert np.bincount(ids.ravel() // model.class_size)[0] > 2 * lm.PIECE
    took, results = {plain_window: [], lm.Recurrent.gradients: []}, {}
    for _ in range(15):
        for form, seconds in took.items():
            began = time.process_time()
            got = form(model, ids, before, state, end)
            seconds.append(time.process_time() - began)
            results[form] = got
    want, last = results.values()
    assert last[0] == pytest.approx(want[0], rel=1e-4)
    assert last[2] == pytest.approx(want[2], abs=1e-5)
    for name, slope in want[1].items():
        assert last[1][name] == pytest.approx(slope, rel=1e-3, abs=1e-4 * float(np.abs(slope).max())), name
    plain, own = (min(x) for x in took.values())
    assert own < 0.75 * plain
