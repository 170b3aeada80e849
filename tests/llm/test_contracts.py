"""Each query as the driver calls it: rows, columns and types of its contract, and what ties them together."""

import math
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

import __spark_entry__
from silverloom.llm import simhash

COLUMNS = {
    "op1_quality_classifier": {"doc_id": "bigint", "held_out": "boolean", "score": "double", "predicted": "int"},
    "op2_wrapper_induction": {"page_id": "bigint", "url": "string", "text": "string", "n_chars": "bigint"},
    "op3_hnsw_near_dedup": {"vec_id": "bigint", "n_links": "bigint", "component_id": "bigint", "kept": "boolean"},
    "op4_best_fit_packing": {"doc_id": "bigint", "piece": "int", "start": "bigint", "length": "bigint", "ids_crc32": "bigint", "sequence_id": "bigint", "offset": "bigint"},
    "op5_recurrent_lm": {"doc_id": "bigint", "held_out": "boolean", "n_tokens": "bigint", "n_known": "bigint", "train_tokens": "bigint", "base_score": "double", "score": "double"},
    "op6_quality_rules": {"doc_id": "bigint", "n_words": "bigint", "word_chars": "bigint", "n_symbols": "bigint", "n_dup_lines": "bigint", "n_repeat_words": "bigint", "base_failed": "boolean", "kept": "boolean"},
    "op7_source_mixing": {"doc_id": "bigint", "n_tokens": "bigint", "rate": "double", "copies": "bigint"},
    "op8_license_scan": {"doc_id": "bigint", "n_words": "bigint", "n_base": "bigint", "first_word": "bigint", "last_word": "bigint", "base_labels": "string", "labels": "string", "score": "double"},
    "op9_simhash_near_dedup": {"doc_id": "bigint", "fingerprint": "string", "component_id": "bigint"},
    "op10_secret_scan": {"doc_id": "bigint", "n_assign": "bigint", "n_access": "bigint", "n_hex": "bigint", "base_sha256": "string", "spans": "string"},
}


@pytest.fixture(scope="module")
def ran(spark, small):
    held = {}

    def run(name):
        if name not in held:
            frame = __spark_entry__.queries()[name](spark, small)
            held[name] = dict(frame.dtypes), frame.collect()
        return held[name]

    return run


def fold(doc_id, n):
    return zlib.crc32(str(doc_id).encode()) % n == 0


@pytest.mark.parametrize("name", sorted(COLUMNS))
def test_columns_and_rows(ran, spark, small, name):
    kinds, rows = ran(name)
    assert {c: kinds.get(c) for c in COLUMNS[name]} == COLUMNS[name]
    source, key = {"op2": ("pages", "page_id"), "op3": ("embeddings", "vec_id")}.get(name.split("_")[0], ("documents", "doc_id"))
    want = Counter(r[0] for r in spark.read.parquet(f"{small}/{source}.parquet").select(key).collect())
    got = Counter(r[key] for r in rows)
    assert got == want if "packing" not in name else got.keys() == want.keys()
    if "spans" not in name:
        assert all(r[c] is not None for r in rows for c in COLUMNS[name] if c not in ("first_word", "last_word", "url"))


def test_op1(ran):
    assert all(r.held_out == fold(r.doc_id, 5) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in ran("op1_quality_classifier")[1])


def test_op2(ran):
    assert all(r.n_chars == len(r.text) and "\n\n" not in r.text and r.text == r.text.strip() for r in ran("op2_wrapper_induction")[1])


def test_op3(ran, spark, small):
    vectors = {r.vec_id: np.array(r.embedding, float) for r in spark.read.parquet(f"{small}/embeddings.parquet").collect()}
    unit = {i: v / np.linalg.norm(v) for i, v in vectors.items()}
    for r in ran("op3_hnsw_near_dedup")[1]:
        assert r.n_links == sum(unit[r.vec_id] @ unit[i] >= 0.9 for i in unit if i != r.vec_id) and r.kept == (r.vec_id == r.component_id)


def test_op4(ran):
    fill, pieces = defaultdict(list), defaultdict(list)
    for r in ran("op4_best_fit_packing")[1]:
        fill[r.sequence_id].append((r.offset, r.length))
        pieces[r.doc_id].append((r.piece, r.start, r.length))
    for parts in [*fill.values()]:
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 1024
    for parts in pieces.values():
        at = 0
        for n, (piece, start, length) in enumerate(sorted(parts)):
            assert (piece, start) == (n, at) and (length == 1024 or n == 0)
            at += length


def test_op5(ran):
    rows = ran("op5_recurrent_lm")[1]
    assert all(r.held_out == fold(r.doc_id, 10) and r.n_known <= r.n_tokens and math.isfinite(r.score) and r.score < 0 and r.base_score < 0 for r in rows)
    assert len({r.train_tokens for r in rows}) == 1 and rows[0].train_tokens == sum(r.n_tokens for r in rows if not r.held_out)


def test_op6(ran):
    assert all(r.base_failed == (r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words) and not (r.kept and r.base_failed) for r in ran("op6_quality_rules")[1])


def test_op7(ran):
    rows = ran("op7_source_mixing")[1]
    assert all(r.rate >= 0 and r.copies in (math.floor(r.rate), math.floor(r.rate) + 1) for r in rows)
    assert rows[0].goal_clean + rows[0].goal_poor + rows[0].goal_toxic == pytest.approx(1)
    assert sum(r.rate * r.n_tokens * r.p_clean for r in rows) / sum(r.n_tokens for r in rows) == pytest.approx(rows[0].met_clean, abs=1e-6)


def test_op8(ran):
    for r in ran("op8_license_scan")[1]:
        labels = [r.base_labels.split(",") if r.base_labels else [], r.labels.split(",") if r.labels else []]
        assert set(labels[0]) <= set(labels[1]) and all(x == sorted(set(x)) for x in labels) and 0 <= r.score <= 1
        assert (r.first_word is None) == (r.last_word is None) == (r.n_base == 0) and (r.n_base == 0) == (not labels[0])


def test_op9(ran, spark, small):
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{small}/documents.parquet").collect()}
    rows = {r.doc_id: r for r in ran("op9_simhash_near_dedup")[1]}
    prints = {i: simhash.fingerprint(t.encode()) for i, t in texts.items()}
    assert all(r.fingerprint == f"{prints[i]:016x}" for i, r in rows.items())
    for i in rows:
        for j in rows:
            if (prints[i] ^ prints[j]).bit_count() <= 4:
                assert rows[i].component_id == rows[j].component_id <= min(i, j)


def test_op10(ran):
    for r in ran("op10_secret_scan")[1]:
        spans = [s.split(":") for s in r.spans.split(",") if s]
        assert len(spans) >= r.n_assign + r.n_access + r.n_hex and all(len(s) == 3 and int(s[1]) < int(s[2]) for s in spans) and len(r.base_sha256) == 64


def test_pipeline_is_registered():
    assert set(COLUMNS) | {"pipeline"} <= set(__spark_entry__.queries())
