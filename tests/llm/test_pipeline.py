"""Each stage against a plain form of it on its own input, and the whole run."""

import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

import corpus_pipeline
from silverloom.llm import mixing, quality_rules, secrets
from silverloom.llm.common import settle

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


@pytest.fixture(scope="module")
def stages(spark, small):
    docs, out = spark.read.parquet(f"{small}/documents.parquet"), []
    for name, function in corpus_pipeline.STAGES:
        after = settle(function(spark, docs, small), f"test-{name}")
        out.append((name, docs, after))
        docs = after
    return {name: (before, after) for name, before, after in out}


def rows(frame):
    return Counter(tuple(r[c] for c in COLUMNS) for r in frame.collect())


def test_names_and_columns(stages):
    names = list(stages)
    assert names == ["quality_rules", "simhash_near_dedup", "secret_scan", "source_mixing", "best_fit_packing"]
    assert all(stages[n][1].columns == COLUMNS for n in names[:-1])


def test_rules_keep_what_they_say(stages, small_labels):
    before, after = stages["quality_rules"]
    kept = {r.doc_id for r in quality_rules.apply_rules(before, small_labels).filter("kept").collect()}
    assert rows(after) == Counter({k: n for k, n in rows(before).items() if k[0] in kept})
    words = {r.doc_id: len((r.text or "").encode().split()) for r in after.collect()}
    assert words and min(words.values()) >= 50


def test_one_document_of_each_group(stages):
    """Five words, Jaccard of 0.8 or more, by comparing all sets."""
    before, after = stages["simhash_near_dedup"]
    texts = [(r.doc_id, (r.text or "").encode().lower().split()) for r in before.collect()]
    sets = sorted((i, {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))}) for i, w in texts)
    group = {}
    for i, (doc, x) in enumerate(sets):
        near = {group[d] for d, y in sets[:i] if 5 * len(x & y) >= 4 * len(x | y)}
        group[doc] = min(near, default=doc)
        for d in group:
            if group[d] in near:
                group[d] = group[doc]
    assert sorted(r.doc_id for r in after.collect()) == sorted(set(group.values()))
    assert rows(after) <= rows(before)


def test_no_secret_is_left(stages):
    before, after = stages["secret_scan"]
    old, new = ({r.doc_id: r for r in f.collect()} for f in (before, after))
    assert old.keys() == new.keys()
    for i, r in new.items():
        assert not secrets.base_spans(r.text.encode()) and (r.text == old[i].text or r.n_chars == len(r.text))
        if not secrets.base_spans(old[i].text.encode()) and not secrets.tested_tokens(old[i].text.encode(), []):
            assert r == old[i]


def test_mixing_takes_whole_rows(stages, small_labels):
    before, after = stages["source_mixing"]
    copies = {r.doc_id: r.copies for r in mixing.mix(before, small_labels.withColumn("domain", mixing.label_domain()), repeat=mixing.STAGE_REPEAT).collect()}
    assert rows(after) == Counter({k: n * copies[k[0]] for k, n in rows(before).items() if copies[k[0]]})
    assert sum(rows(after).values()) >= 0.8 * sum(rows(before).values())


def test_packing_holds_every_token(stages):
    import public_tokenizers
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    before, after = stages["best_fit_packing"]
    want = Counter()
    for r in before.collect():
        ids = tokenizer.encode(r.text or "", add_special_tokens=False).ids + [2]
        first = len(ids) % 1024 or 1024
        for n, (a, b) in enumerate([(0, first)] + [(s, s + 1024) for s in range(first, len(ids), 1024)]):
            want[r.doc_id, n, zlib.crc32(np.array(ids[a:b], "<u4").tobytes())] += 1
    assert Counter((r.doc_id, r.piece, r.ids_crc32) for r in after.collect()) == want
    fill = defaultdict(list)
    for r in after.collect():
        fill[r.sequence_id].append((r.offset, r.length))
    for parts in fill.values():
        assert [o for o, _ in sorted(parts)] == [sum(n for _, n in sorted(parts)[:i]) for i in range(len(parts))] and sum(n for _, n in parts) <= 1024


def test_run_is_the_stages_in_turn(spark, small, stages):
    last = stages["best_fit_packing"][1]
    key = lambda r: (r.doc_id, r.piece, r.ids_crc32, r.length)
    assert Counter(map(key, corpus_pipeline.run(spark, small).collect())) == Counter(map(key, last.collect()))


def test_stages_take_odd_and_empty_documents(spark, small, odd_docs, no_docs):
    for docs in (odd_docs.select(COLUMNS), no_docs):
        for name, function in corpus_pipeline.STAGES:
            docs = settle(function(spark, docs, small), f"odd-{name}")
        assert docs.count() >= 0
