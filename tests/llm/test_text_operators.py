"""Quality rules, license scan, secret scan, quality classifier against plain brute force."""

import hashlib
import math
import random
import re
import time
import zlib
from collections import Counter

import numpy as np
import pytest

from silverloom.llm import licenses, quality_classifier, quality_rules, secrets

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute_rules(text):
    text = text or ""
    words = WORD.findall(text)
    windows = Counter(tuple(words[i : i + 3]) for i in range(len(words) - 2))
    inside = {j for i in range(len(words) - 2) if windows[tuple(words[i : i + 3])] > 1 for j in (i, i + 1, i + 2)}
    lines = text.split("\n")
    dup = sum(1 for i, x in enumerate(lines) if WORD.search(x) and x in lines[:i])
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(inside)


def test_rule_counts(odd_docs, small_docs, labels):
    for docs in (odd_docs, small_docs):
        texts = Counter((r.doc_id, brute_rules(r.text)) for r in docs.collect())
        got = quality_rules.apply_rules(docs, labels).collect()
        assert Counter((r.doc_id, (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words)) for r in got) == texts
        for r in got:
            assert r.base_failed == (r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words)
            assert not (r.kept and r.base_failed)


def test_rules_empty_and_rows(no_docs, labels, odd_docs):
    assert quality_rules.apply_rules(no_docs, labels).count() == 0
    kept = quality_rules.keep_rows(odd_docs, labels)
    assert kept.columns == odd_docs.columns
    assert {r.doc_id for r in kept.collect()} == {r.doc_id for r in quality_rules.apply_rules(odd_docs, labels).filter("kept").collect()}


def test_exact_bound():
    assert quality_rules.upper_bound(0, 100, 0.05) == pytest.approx(1 - 0.05 ** (1 / 100), abs=1e-9)
    for k, n in ((3, 50), (10, 400)):
        p = quality_rules.upper_bound(k, n, 0.01)
        tail = sum(__import__("math").comb(n, i) * p**i * (1 - p) ** (n - i) for i in range(k + 1))
        assert tail == pytest.approx(0.01, rel=1e-6)


def test_bound_at_large_counts():
    """Against plain sums of all terms, and where a few thousand terms would not do."""
    tail = lambda k, n, p: sum(math.exp(math.lgamma(n + 1) - math.lgamma(i + 1) - math.lgamma(n - i + 1) + i * math.log(p) + (n - i) * math.log1p(-p)) for i in range(k + 1))
    for k, n in ((0, 10), (900, 100_000), (49_000, 5_000_000)):
        p = quality_rules.upper_bound(k, n, 0.01)
        assert tail(k, n, p) == pytest.approx(0.01, rel=1e-3)
    k, n = 10**7, 10**9
    spread = (k * (1 - k / n)) ** 0.5 / n
    assert quality_rules.upper_bound(k, n, 0.01) - k / n == pytest.approx(2.326 * spread, rel=0.01)


def test_fixed_sequence_keeps_the_joint_bound():
    """Simulated strata: the share of good documents that the certified set rejects, all rules together,
    is above the bound no more often than delta; every set is stricter than the one before."""
    rng, wrong = np.random.default_rng(9), 0
    sizes = [len(quality_rules.CUTOFFS[r]) for r in quality_rules.RATIOS]
    one = np.ones(600, int)
    for _ in range(300):
        chance = rng.uniform(0, 0.004, len(sizes))  # of a good document to exceed any cutoff of a rule
        draw = lambda n: np.stack([np.where(rng.random(n) < c, rng.integers(1, m + 1, n), 0) for c, m in zip(chance, sizes)], 1)
        bad = np.stack([rng.integers(0, m + 1, 40) for m in sizes], 1)
        path = quality_rules.order_of_notches(bad, np.ones(40, int))
        assert all((b <= a).all() and (b < a).sum() == 1 for a, b in zip(path, path[1:]))
        held = quality_rules.certified(draw(600), one, path, 0.05, 0.01)
        wrong += held is not None and (draw(60_000) >= held).any(1).mean() > 0.01
    assert wrong <= 0.05 * 300 + 8


def test_verdict_by_brute_force(spark):
    """kept and broken_rules at production parameters, from ratios and cutoffs by hand."""
    docs, marks = (spark.read.parquet(f"/root/testdata/sf0.01/{x}.parquet") for x in ("documents", "labels"))
    stats = quality_rules.document_stats(quality_rules.stratified(docs), ["doc_id", "stratum"])
    cuts = {r.stratum: r for r in quality_rules.fit_cutoffs(stats, marks, 0.05).collect()}
    told = {r.doc_id: r.mark for r in marks.groupBy("doc_id").agg({"quality": "max"}).withColumnRenamed("max(quality)", "mark").collect()}
    got = {r.doc_id: r for r in quality_rules.apply_rules(docs, marks, 0.05).collect()}
    lost = Counter()
    for r in stats.collect():
        ratios = {"symbols": (100 * r.n_symbols, r.n_words), "dup_lines": (100 * r.n_dup_lines, r.n_lines), "repeats": (100 * r.n_repeat_words, r.n_words), "long_words": (r.word_chars, r.n_words), "shouting": (100 * r.n_upper, r.word_chars), "bangs": (100 * r.n_bangs, r.n_words)}
        cut = cuts.get(r.stratum)
        broken = [k for k, (a, b) in ratios.items() if cut and cut[f"cut_{k}"] is not None and b and a / b > cut[f"cut_{k}"]]
        assert got[r.doc_id].broken_rules == ",".join(broken) and got[r.doc_id].kept == (not broken and not got[r.doc_id].base_failed)
        if r.doc_id in told and not got[r.doc_id].base_failed:
            lost[told[r.doc_id], bool(broken)] += 1
    assert lost[0, True] > 0.5 * lost[0, False] and lost[1, True] <= 0.05 * lost[1, False]


def test_cutoffs_hold_their_risk(spark):
    """500 good documents with few symbols, one of them with many; 50 bad ones full of symbols."""
    good = [(i, "plain words only here " * 20 + f"w{i} x{i} y{i}", "en") for i in range(2000)]
    bad = [(5000 + i, " ".join(f"a{i}{j}###" for j in range(80)), "en") for i in range(50)]
    docs = spark.createDataFrame(good + bad, "doc_id long, text string, lang string")
    marks = spark.createDataFrame([(i, int(i < 5000)) for i, *_ in good + bad], "doc_id long, quality int")
    out = {r.doc_id: r for r in quality_rules.apply_rules(docs, marks).collect()}
    assert not any(out[i].kept for i, *_ in bad)
    assert "symbols" in out[5000].broken_rules
    assert all(out[i].broken_rules == "" for i, *_ in good)


LICENSE_WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)


def test_license_base(odd_docs, small_docs):
    for docs in (odd_docs, small_docs):
        want = Counter()
        for r in docs.collect():
            words = LICENSE_WORD.findall(lower(r.text or ""))
            at = [(i, label) for p, label in licenses.PHRASES.items() for i in range(len(words)) if words[i : i + len(p.split())] == p.split()]
            starts = [i for i, _ in at]
            want[(r.doc_id, len(words), len(at), min(starts, default=None), max(starts, default=None), ",".join(sorted({x for _, x in at})))] += 1
        got = licenses.license_digest(licenses.scan_licenses(docs)).collect()
        assert Counter((r.doc_id, r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) for r in got) == want
        assert all(0 <= r.score <= 1 and set(filter(None, r.base_labels.split(","))) <= set(filter(None, r.labels.split(","))) for r in got)


def all_matches(sequences, text, least):
    """(sequence, end, end in the sequence, length) of what can't go on to either side, by comparing all."""
    same = lambda s, i, j: 0 <= i < len(s) and 0 <= j < len(text) and s[i] == text[j]
    out = []
    for number, s in enumerate(sequences):
        for i in range(len(s)):
            for j in range(len(text)):
                n = 0
                while same(s, i + n, j + n):
                    n += 1
                if n >= least and not same(s, i - 1, j - 1):
                    out.append((number, j + n, i + n, n))
    return sorted(out)


def best_cover(matches, gap):
    """What the best sequence of matches covers, over all sequences."""

    def go(i):
        end, reached, _ = matches[i]
        more = [min(n, e - end, r - reached) + go(j) for j, (e, r, n) in enumerate(matches) if e > end and r > reached and e - n - end <= gap and r - n - reached <= gap]
        return max(more, default=0)

    return max((m[2] + go(i) for i, m in enumerate(matches)), default=0)


def test_matches_and_chains_against_brute_force():
    rng = random.Random(1)
    for _ in range(60):
        sequences = [[rng.randrange(1, 4) for _ in range(rng.randrange(3, 15))] for _ in range(5)]
        automaton = licenses.Automaton(sequences)
        text = [rng.randrange(1, 4) for _ in range(rng.randrange(30))]
        got = automaton.matches(text, 2)
        assert sorted(got) == all_matches(sequences, text, 2)
        for number in range(5):
            some = sorted((e, r, n) for k, e, r, n in got if k == number)[:14]
            assert max((c for c, _, _ in licenses.best_chains(some, 3)), default=0) == best_cover(some, 3)


def test_edited_notices_against_brute_force():
    """Random edits of notices: the score is that of the best chain of all."""
    rng, scanner = random.Random(2), licenses.Scanner()
    texts = [[scanner.ids[w] for w in licenses.words_of(t.encode())] for _, t in licenses.TEMPLATES]
    names = {i: w for w, i in scanner.ids.items()}
    for _ in range(40):
        number = rng.randrange(len(texts))
        words = [names[i] for i in texts[number]][:45]
        for _ in range(rng.randrange(6)):
            at = rng.randrange(len(words) + 1)
            words[at : at + rng.randrange(3)] = rng.choices([b"other", b"words", b"license", *words], k=rng.randrange(4))
        found = all_matches(texts, [scanner.ids.get(w, -1) for w in words], licenses.MIN_MATCH)
        want = max((best_cover([m[1:] for m in found if m[0] == k], licenses.MAX_GAP) / len(texts[k]) for k in range(len(texts))), default=0)
        got = scanner.scan(b" ".join(words))
        assert abs(got["score"] - (1 if got["base"] else want)) < 1e-12


def test_apart_takes_most():
    chains = [(3, 0, 4), (5, 2, 9), (4, 4, 10), (3, 10, 13)]
    assert licenses.apart(chains) == [(3, 0, 4), (4, 4, 10), (3, 10, 13)]
    assert licenses.apart([]) == []


@pytest.mark.parametrize("inserted", ["(see copies of the software)", "x y the rights to use copies of the software"])
def test_an_inserted_phrase_of_the_notice_itself(inserted):
    mit = next(t for label, t in licenses.TEMPLATES if label == "mit" and "hereby" in t)
    words, scanner = mit.split(), licenses.Scanner()
    for at in range(0, len(words), 5):
        found = scanner.scan(" ".join([*words[:at], inserted, *words[at:]]).encode())
        assert [label for _, _, label in found["spans"]] == ["mit"] and found["score"] >= 0.9
    twice = scanner.scan(f"{mit} {mit}".encode())
    n = len(licenses.words_of(mit.encode()))
    assert twice["spans"] == [(0, n, "mit"), (n, 2 * n, "mit")]


def test_many_notices_take_linear_time():
    scanner, began = licenses.Scanner(), time.perf_counter()
    assert len(scanner.scan(b"Released under the MIT License. " * 20_000)["spans"]) == 20_000
    scanner.scan(b"copies of the software " * 50_000)
    assert time.perf_counter() - began < 20


def test_license_spans():
    scanner = licenses.Scanner()
    text = "Intro words. Licensed under CC BY-NC 4.0. More words follow."
    found = scanner.scan(text.encode())
    assert found["spans"] == [(2, 9, "cc-by-nc")] and found["score"] == 1  # "4.0" is two words
    gpl = next(t for label, t in licenses.TEMPLATES if label == "gpl" and "redistribute" in t)
    changed = gpl.replace("Foundation,", "Foundation of ours,")
    assert any(label == "gpl" for _, _, label in scanner.scan(changed.encode())["spans"])
    assert scanner.scan(b"the of to and under this is a")["spans"] == []


ASSIGN = re.compile(r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.A)


def brute_spans(text):
    out = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6 and m[1].isascii()]
    out += [(m.start(), 1, m.end()) for m in re.finditer(r"AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    out += [(m.start(), 2, m.end()) for m in re.finditer(r"[0-9a-f]+", text) if len(m[0]) >= 24]
    return sorted(out)


def test_secret_base(odd_docs, small_docs):
    for docs in (odd_docs, small_docs):
        want = Counter()
        for r in docs.collect():
            spans = brute_spans(r.text or "")
            counts = [sum(k == kind for _, k, _ in spans) for kind in range(3)]
            said = ",".join(f"{secrets.KINDS[k]}:{s}:{e}" for s, k, e in spans)
            want[(r.doc_id, *counts, hashlib.sha256(said.encode()).hexdigest())] += 1
        got = secrets.secret_digest(secrets.find_secrets(docs)).collect()
        assert Counter((r.doc_id, r.n_assign, r.n_access, r.n_hex, r.base_sha256) for r in got) == want


def test_random_tokens_are_found(spark):
    import random

    rng = random.Random(3)
    keys = ["".join(rng.choice("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789") for _ in range(40)) for _ in range(60)]
    plain = [f"see-the-page-number-{i}-of-the-annual-report-section-{i}" for i in range(60)] + ["a1" * 20, "aaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaa1", "1234567890" * 4, "notEncodedJustVeryLongCamelCaseWords"]
    rows = [(i, f"é key {x} end") for i, x in enumerate(keys + plain)]
    out = {r.doc_id: r.spans for r in secrets.secret_digest(secrets.find_secrets(spark.createDataFrame(rows, "doc_id long, text string"))).collect()}
    assert sum(out[i] == "random:6:46" for i in range(60)) >= 55
    assert sum("random" in out[i] for i in range(60, 124)) <= 3
    masked = secrets.mask_rows(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sum(r.text == "é key [secret] end" for r in masked) >= 55


def test_masking(odd_docs, no_docs):
    out = {r.doc_id: r for r in secrets.mask_rows(odd_docs).collect()}
    assert out[7].text == "[secret] and [secret] then [secret] é" and out[7].n_chars == len(out[7].text)
    assert out[3].text is None and out[4].n_chars is None and out[1].text.startswith("the quick")
    assert secrets.mask_rows(no_docs).count() == 0 and secrets.find_secrets(no_docs).count() == 0


def test_classifier_learns(small_docs, small_labels, spark):
    from silverloom.llm.common import remainder

    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    marks = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    model = quality_classifier.train_classifier(docs, marks.filter(remainder("doc_id", 5) != 0))
    quality = {r.doc_id: r.quality for r in marks.collect() if zlib.crc32(str(r.doc_id).encode()) % 5 == 0}
    scored = {r.doc_id: r.score for r in quality_classifier.score_quality(docs, model).collect()}
    good = [scored[i] for i, q in quality.items() if q == 1]
    bad = [scored[i] for i, q in quality.items() if q == 0]
    assert sum(g > b for g in good for b in bad) / (len(good) * len(bad)) > 0.95
    assert sum(g >= 0.3 for g in good) / len(good) > 0.97


def test_classifier_edges(odd_docs, no_docs, labels):
    none = quality_classifier.train_classifier(odd_docs, labels.filter("false"))
    assert {r.score for r in quality_classifier.score_quality(odd_docs, none).collect()} == {0.5}
    few = quality_classifier.train_classifier(odd_docs, labels)
    rows = quality_classifier.score_quality(odd_docs, few).collect()
    assert len(rows) == odd_docs.count() and all(0 <= r.score <= 1 for r in rows)
    assert quality_classifier.score_quality(no_docs, none).count() == 0
