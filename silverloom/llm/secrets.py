"""Secret scan: fixed patterns, and a battery of randomness tests over encoded-looking tokens (operator 10).

Base kinds are three patterns. The method adds ``random`` spans: runs of 20 or more characters of the
base64 alphabets whose smallest fitting alphabet (hex, base32, base36, base64) is inferred. Three
tests of "symbols drawn evenly and independently from that alphabet" are made: Pearson's chi-squared
against its exact mean and variance, Wald-Wolfowitz runs about the middle of the alphabet, and
lag-one serial correlation; Fisher's method joins them to one p-value. Ordinary text fails it. Within
each class of length, Benjamini-Hochberg over all tokens of the corpus decides which are declared
ordinary (at most a share ``FDR`` of those in error); the rest, if their length carries
``MIN_BITS`` bits or more, are spans. The step-up threshold comes from counts of p-values in fixed
bins, so what reaches the driver has a fixed size.

Defined results: a null or empty text has no spans; repeated rows each get their row; spans of the
method that meet a base span are dropped; equal starts are ordered by kind; columns other than
doc_id and text are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import math
import re

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import map_batches, settle, text_bytes

KINDS = ("assign", "access", "hex", "random")
ASSIGN = re.compile(rb"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I)
ASSIGN_WORDS = (b"password", b"passwd", b"secret", b"token", b"apikey", b"api_key")
ACCESS = re.compile(rb"AKIA[A-Z0-9]+")
HEX = re.compile(rb"[0-9a-f]+")
TOKEN = re.compile(rb"[A-Za-z0-9+/_-]{20,}={0,2}")
#: The alphabets that are inferred, smallest first.
ALPHABETS = {"hex": b"0123456789abcdef", "HEX": b"0123456789ABCDEF", "base32": b"ABCDEFGHIJKLMNOPQRSTUVWXYZ234567", "base36": b"0123456789abcdefghijklmnopqrstuvwxyz", "BASE36": b"0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ", "base64": b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/", "base64url": b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789-_"}
FDR, MIN_BITS, BINS = 0.05, 80, 400
#: Classes of length begin at these numbers of symbols.
LENGTHS = (20, 32, 48, 96)
HEX_MAP = bytes(104 if c in b"0123456789abcdef" else 32 for c in range(256))
TOKEN_MAP = bytes(116 if c in ALPHABETS["base64"] + b"-_" else 32 for c in range(256))


def normal_p(z: float) -> float:
    return math.erfc(abs(z) / math.sqrt(2))


def gamma_two_sided(x: float, mean: float, variance: float) -> float:
    """p of a value of about gamma distribution, by the Wilson-Hilferty cube root."""
    shape = mean * mean / variance
    return normal_p(((x / mean) ** (1 / 3) - (1 - 1 / (9 * shape))) * math.sqrt(9 * shape))


def infer_alphabet(token: bytes) -> bytes | None:
    """The smallest alphabet of the token; letters alone or digits alone are no encoded bytes."""
    if token.isdigit() or not any(48 <= c <= 57 for c in token):
        return None
    return next((a for a in ALPHABETS.values() if not token.translate(None, a)), None)


def battery(token: bytes, alphabet: bytes) -> float:
    """The joint p-value of the three tests that the symbols are random."""
    symbols = [alphabet.index(c) for c in token]
    n, k = len(symbols), len(alphabet)
    counts = [0] * k
    for s in symbols:
        counts[s] += 1
    chi = sum(c * c for c in counts) * k / n - n
    ps = [gamma_two_sided(max(chi, 1e-9), k - 1, 2 * (k - 1) * (n - 1) / n)]
    high = [2 * s >= k for s in symbols]
    up, runs = sum(high), 1 + sum(a != b for a, b in zip(high, high[1:]))
    down = n - up
    if up and down:
        mean = 2 * up * down / n + 1
        ps.append(normal_p((runs - mean) / math.sqrt(max((mean - 1) * (mean - 2) / (n - 1), 1e-9))))
    else:
        ps.append(1e-12)
    mid = sum(symbols) / n
    spread = sum((s - mid) ** 2 for s in symbols)
    if spread:
        lag = sum((a - mid) * (b - mid) for a, b in zip(symbols, symbols[1:])) / spread
        ps.append(normal_p((lag + 1 / n) * math.sqrt(n)))
    else:
        ps.append(1e-12)
    half = -sum(math.log(max(p, 1e-300)) for p in ps)  # half of Fisher's statistic, with 6 degrees of freedom
    return min(1.0, math.exp(-half) * (1 + half + half * half / 2))


def length_class(n: int) -> int:
    return max(x for x in LENGTHS if x <= n)


def base_spans(text: bytes) -> list[tuple[int, int, int]]:
    """(start, end, kind) in bytes."""
    out = []
    low = text.lower()
    if any(w in low for w in ASSIGN_WORDS):
        out += [(m.start(), m.end(), 0) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 6]
    if b"AKIA" in text:
        out += [(m.start(), m.end(), 1) for m in ACCESS.finditer(text) if m.end() - m.start() >= 20]
    if b"h" * 24 in text.translate(HEX_MAP):
        out += [(m.start(), m.end(), 2) for m in HEX.finditer(text) if m.end() - m.start() >= 24]
    return sorted(out)


def tested_tokens(text: bytes, base: list[tuple[int, int, int]]) -> list[tuple[int, int, float, int]]:
    """(start, end, p, class of length) in bytes of the tokens that the battery can judge."""
    out = []
    if b"t" * 20 not in text.translate(TOKEN_MAP):
        return out
    for m in TOKEN.finditer(text):
        token = m[0].rstrip(b"=")
        alphabet = infer_alphabet(token)
        if alphabet and len(token) * math.log2(len(alphabet)) >= MIN_BITS and not any(s < m.end() and m.start() < e for s, e, _ in base):
            out.append((m.start(), m.end(), battery(token, alphabet), length_class(len(token))))
    return out


def code_points(text: bytes, spans: list[tuple]) -> list[tuple]:
    """The spans with start and end in code points; they come ordered by start."""
    out, at, points = [], 0, 0
    for start, end, *rest in spans:
        points += len(text[at:start].decode()) if start >= at else -len(text[start:at].decode())
        at = start
        out.append((points, points + len(text[start:end].decode()), *rest))
    return out


def p_bin(p: float) -> int:
    """Bins of equal width in -log10 p, 0.05 each; 0 has the p-values next to 1."""
    return min(BINS - 1, int(-20 * math.log10(max(p, 1e-300))))


def ordinary_from(counts: dict[int, int], fdr: float = FDR) -> int:
    """The lowest bin whose tokens Benjamini-Hochberg declares ordinary; BINS if none. Each bin
    counts with its largest p, so the bound errs to the safe side."""
    total, seen, found = sum(counts.values()), 0, BINS
    for b in sorted(counts, reverse=True):
        seen += counts[b]
        if 10 ** (-b / 20) <= fdr * seen / total:
            found = b
    return found


def scan_texts(docs: DataFrame) -> DataFrame:
    """doc_id, base spans, and the tested tokens with their p-values, in code points."""

    def each(batch: pa.RecordBatch) -> dict:
        texts = text_bytes(batch.column("text"))
        base = [base_spans(x) for x in texts]
        tried = [tested_tokens(x, b) for x, b in zip(texts, base)]
        return {
            "doc_id": batch.column("doc_id"),
            "base": [[{"start": s, "end": e, "kind": k} for s, e, k in code_points(x, b)] for x, b in zip(texts, base)],
            "tried": [[{"start": s, "end": e, "kind": 3, "p_bin": p_bin(p), "length": n} for s, e, p, n in code_points(x, t)] for x, t in zip(texts, tried)],
        }

    kind = docs.schema["doc_id"].dataType.simpleString()
    span = "start: long, end: long, kind: int"
    return settle(map_batches(docs.select("doc_id", "text"), f"doc_id {kind}, base array<struct<{span}>>, tried array<struct<{span}, p_bin: int, length: int>>", each), "secret-spans")


def ordinary_limits(seen: DataFrame, fdr: float = FDR) -> dict[int, int]:
    """For each class of length, the lowest bin that is ordinary."""
    counts = seen.select(F.inline("tried")).groupBy("length", "p_bin").count().collect()  # 4 x BINS rows at most
    return {n: ordinary_from({r["p_bin"]: r["count"] for r in counts if r["length"] == n}, fdr) for n in LENGTHS}


def find_secrets(docs: DataFrame, fdr: float = FDR) -> DataFrame:
    """doc_id, base and spans: arrays of (start, end, kind), ordered, in code points of the text."""
    seen = scan_texts(docs)
    limits = ordinary_limits(seen, fdr)
    random = F.filter("tried", lambda x: x["p_bin"] < limit_of(x["length"], limits))
    random = F.transform(random, lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"), x["kind"].alias("kind")))
    return seen.select("doc_id", "base", F.array_sort(F.concat("base", random)).alias("spans"))


def mask_rows(docs: DataFrame, mask: str = "[secret]", fdr: float = FDR) -> DataFrame:
    """docs with each span of its texts replaced by the mask, and n_chars, if it is there, anew."""
    limits = ordinary_limits(scan_texts(docs), fdr)

    def each(batch: pa.RecordBatch) -> dict:
        out = {c: batch.column(c) for c in batch.schema.names}
        texts = text_bytes(batch.column("text"))
        changed = {}
        for at, text in enumerate(texts):
            base = base_spans(text)
            random = [(s, e) for s, e, p, n in tested_tokens(text, base) if p_bin(p) < limits[n]]
            if base or random:
                changed[at] = masked(text, [(s, e) for s, e, _ in base] + random, mask.encode()).decode()
        if changed:
            old = out["text"].to_pylist()
            out["text"] = [changed.get(at, x) for at, x in enumerate(old)]
            if "n_chars" in out:
                out["n_chars"] = [len(changed[at]) if at in changed else n for at, n in enumerate(out["n_chars"].to_pylist())]
        return out

    return map_batches(docs, docs.schema, each)


def limit_of(length, limits: dict[int, int]):
    out = F.lit(BINS)
    for n, b in limits.items():
        out = F.when(length == n, F.lit(b)).otherwise(out)
    return out


def span_text(spans: str):
    """kind:start:end of each span, comma-joined."""
    name = F.array(*(F.lit(k) for k in KINDS))
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", F.get(name, x["kind"]), x["start"], x["end"])), ",")


def secret_digest(found: DataFrame) -> DataFrame:
    count = lambda kind: F.size(F.filter("base", lambda x: x["kind"] == kind)).cast("long")
    return found.select("doc_id", count(0).alias("n_assign"), count(1).alias("n_access"), count(2).alias("n_hex"), F.sha2(span_text("base"), 256).alias("base_sha256"), span_text("spans").alias("spans"))


def masked(text: bytes, spans: list[tuple[int, int]], mask: bytes) -> bytes:
    """The text with each span replaced; spans that meet are one."""
    out, at = [], 0
    for start, end in sorted(spans):
        if start >= at:
            out += [text[at:start], mask]
        at = max(at, end)
    return b"".join(out) + text[at:]
