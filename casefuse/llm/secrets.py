"""Secrets: fixed patterns, and strings that a battery of randomness tests finds random.

A candidate is a long run of encoding characters, or a part of one between its signs (a path and one
of its segments can both be found, so spans may overlap). Its encoding (hex, base 32, letters and digits,
base 64) is inferred from the characters used. Three tests, each against the hypothesis that the
string is ordinary (names, paths, counters) and not random:
- chi-squared: ordinary strings prefer some characters. The statistic is compared with its
  noncentral distribution for the preference of ordinary text in that alphabet;
- runs: ordinary strings keep to one class of characters (digits, capitals, small letters) longer;
- serial correlation: ordinary sequences have neighbours that depend on each other.
The three are combined as a weighted sum of normal scores, in which the first counts double and the
others are bounded, so that they alone never make a string random. Long strings give the tests more
power by themselves; the false discovery rate is controlled over the whole corpus by Benjamini and
Hochberg inside each stratum of encoding and length band.
"""

import hashlib
import math
import re

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window
from pyspark.sql import functions as F

from casefuse.llm.common import written

# The three base patterns.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?"""
                    r"""([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")
KINDS = ["assign", "access", "hex", "random"]
_WORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")

CANDIDATE = re.compile(r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{16,}={0,2}")
_DIGITS, _CAPITALS = "0123456789", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_SMALL = _CAPITALS.lower()
# Alphabets by name, and how far ordinary text is from using them evenly: k * sum(p^2) - 1.
ENCODINGS = [("hex", _DIGITS + "abcdef", 1.0), ("hex", _DIGITS + "ABCDEF", 1.0),
             ("base32", _CAPITALS + "234567", 1.2), ("alnum", _CAPITALS + _SMALL + _DIGITS, 2.7),
             ("base64", _CAPITALS + _SMALL + _DIGITS + "+/", 2.8),
             ("base64url", _CAPITALS + _SMALL + _DIGITS + "-_", 2.8)]
_SETS = [(name, frozenset(a), {c: i for i, c in enumerate(a)}, bias) for name, a, bias in ENCODINGS]
#: p-values are rounded up to the grid 10^(-j / GRID), j to STEPS.
GRID, STEPS = 20, 400
#: The runs and serial scores count up to this.
BOUND = 2.0


def _normal_cdf(z: float) -> float:
    return 0.5 * math.erfc(-z / math.sqrt(2))


def noncentral_score(x: float, df: int, shift: float) -> float:
    """A noncentral chi-squared value as a normal score (Sankaran's approximation)."""
    mean, spread = df + shift, df + 2 * shift
    h = 1 - 2 * mean * (df + 3 * shift) / (3 * spread * spread)
    p = spread / (mean * mean)
    m = (h - 1) * (1 - 3 * h)
    at = (x / mean) ** h if x > 0 else 0.0
    mu = 1 + h * p * (h - 1 - 0.5 * (2 - h) * m * p)
    return (at - mu) / (h * math.sqrt(2 * p) * (1 + 0.5 * m * p))


def infer(token: str):
    """(name, position of each character, bias) of the narrowest alphabet; None for plain words."""
    body = token.rstrip("=")
    if body.isalpha() and (body[1:].islower() or body.isupper()) or body.isdigit():
        return None
    used = frozenset(body)
    for name, members, place, bias in _SETS:
        if used <= members and (name != "base32" or used & frozenset("234567")):
            return name, place, bias
    return None


def _kind(c: str) -> int:
    return 0 if c.isdigit() else 1 if c.isupper() else 2 if c.islower() else 3


def battery(token: str, place: dict, bias: float) -> float:
    """The p-value of the combined tests: how likely an ordinary string looks this random."""
    body = token.rstrip("=")
    n, k = len(body), len(place)
    counts = {}
    for c in body:
        counts[c] = counts.get(c, 0) + 1
    chi = k / n * sum(v * v for v in counts.values()) - n
    even = -noncentral_score(chi, k - 1, n * bias)
    kinds = [_kind(c) for c in body]
    shares = [kinds.count(i) / n for i in range(4)]
    same = sum(s * s for s in shares)
    expected = 1 + (n - 1) * (1 - same)
    spread = math.sqrt(max((n - 1) * same * (1 - same), 0.25))
    runs = 1 + sum(a != b for a, b in zip(kinds, kinds[1:]))
    broken = (runs - 0.6 * expected) / spread
    at = [place[c] for c in body]
    mean = sum(at) / n
    total = sum((a - mean) ** 2 for a in at)
    serial = sum((a - mean) * (b - mean) for a, b in zip(at, at[1:])) / total if total else 1.0
    apart = (0.5 - abs(serial)) * math.sqrt(n)
    score = (2 * even + min(broken, BOUND) + min(apart, BOUND)) / math.sqrt(6)
    return _normal_cdf(-score)


def step_of(p: float) -> int:
    """Largest grid step whose value is not below p."""
    if p <= 10 ** (-STEPS / GRID):
        return STEPS
    return max(0, math.floor(-GRID * math.log10(p) + 1e-9))


def base_spans(text: str) -> list:
    """(start, kind number, end) of the fixed patterns, in order."""
    found = [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    if "AKIA" in text:
        found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text)
                  if m.end() - m.start() >= 20]
    low = text.lower()
    if any(w in low for w in _WORDS):
        found += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text)
                  if m.end(2) - m.start(2) >= 6]
    return sorted(found)


def tested_parts(run: str, start: int = 0):
    """(start, end, what `infer` knows) of what is tested of a run.

    The run itself, if an alphabet holds it. A run with '/', or one that no alphabet holds, is cut
    at the first of / - _ + that it has, and parts of 16 or more characters are treated alike.
    """
    known = infer(run)
    if known:
        yield start, start + len(run), known
    sign = next((c for c in ("/" if known else "/-_+") if c in run), None)
    if sign:
        for part in run.split(sign):
            if len(part.rstrip("=")) >= 16:
                yield from tested_parts(part, start)
            start += len(part) + 1


def scan(text: str) -> tuple:
    """Base spans, and candidates (start, end, stratum, step) that no base span touches."""
    base = base_spans(text)
    candidates = []
    for m in CANDIDATE.finditer(text):
        for start, end, known in tested_parts(m.group(), m.start()):
            if not any(s < end and start < e for s, _, e in base):
                p = battery(text[start:end], known[1], known[2])
                band = int(2 * math.log2(end - start))
                candidates.append((start, end, f"{known[0]}/{band}", step_of(p)))
    return base, candidates


def span_list(spans) -> str:
    """kind:start:end, comma-joined."""
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in spans)


_SPAN = "struct<start: long, kind: int, stop: long>"
_CANDIDATE = "struct<start: long, stop: long, stratum: string, step: int>"


def scanned_text(text: Column) -> Column:
    """`base, base_sha256, candidates` of a text as one struct; null counts as empty."""
    span = pa.struct([("start", pa.int64()), ("kind", pa.int32()), ("stop", pa.int64())])
    candidate = pa.struct([("start", pa.int64()), ("stop", pa.int64()),
                           ("stratum", pa.string()), ("step", pa.int32())])
    kind = pa.struct([("base", pa.list_(span)), ("base_sha256", pa.string()),
                      ("candidates", pa.list_(candidate))])

    @F.arrow_udf(f"struct<base: array<{_SPAN}>, base_sha256: string, "
                 f"candidates: array<{_CANDIDATE}>>")
    def scanned(texts: pa.Array) -> pa.Array:
        out = []
        for t in texts.to_pylist():
            base, candidates = scan(t or "")
            out.append({
                "base": [dict(zip(("start", "kind", "stop"), b)) for b in base],
                "base_sha256": hashlib.sha256(span_list(base).encode()).hexdigest(),
                "candidates": [dict(zip(("start", "stop", "stratum", "step"), c))
                               for c in candidates]})
        return pa.array(out, kind)
    return scanned(text)


def discoveries(scanned: DataFrame, rate: float) -> dict:
    """Per stratum the grid step from which on a candidate is a discovery.

    Counts of (stratum, step) are all that is aggregated: at most 6 encodings, a few dozen length
    bands and STEPS + 1 steps, whatever the size of the corpus.
    """
    counts = scanned.select(F.explode("s.candidates").alias("c")).groupBy(
        "c.stratum", "c.step").agg(F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy("stratum")
    smaller = w.orderBy(F.col("step").desc())
    ranked = counts.select("stratum", "step", F.sum("n").over(smaller).alias("rank"),
                           F.sum("n").over(w).alias("m"))
    passing = ranked.where(F.pow(F.lit(10.0), -F.col("step") / GRID)
                           <= F.lit(rate) * F.col("rank") / F.col("m"))
    return {r[0]: r[1] for r in passing.groupBy("stratum").agg(F.min("step")).collect()}


def find_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                 rate: float = 0.001) -> DataFrame:
    """Secrets of every row: counts and digest of the base spans, and all spans.

    Offsets are code points of the whole text, ends exclusive; `found` has the spans as structs,
    `spans` as text. A null text is empty and has none (the digest is that of the empty string).
    Repeated rows each give a row, an empty table none; further columns are ignored.
    `rate` is the false discovery rate of the added `random` spans.
    """
    scanned = written(docs.select(F.col(id_col).alias("doc_id"),
                                  scanned_text(F.col(text_col)).alias("s")), "scanned")
    limits = discoveries(scanned, rate)
    if limits:
        table = F.create_map(*[F.lit(x) for kv in sorted(limits.items()) for x in kv])
        added = F.filter("s.candidates", lambda c: c["step"] >= F.element_at(table, c["stratum"]))
    else:
        added = F.filter("s.candidates", lambda c: F.lit(False))
    random = F.transform(added, lambda c: F.struct(
        c["start"].alias("start"), F.lit(3).alias("kind"), c["stop"].alias("stop")))
    found = F.array_sort(F.concat("s.base", random))
    names = F.array(*map(F.lit, KINDS))
    return scanned.select(
        "doc_id", *[_kind_count(i).alias(f"n_{KINDS[i]}") for i in range(3)],
        F.col("s.base_sha256").alias("base_sha256"),
        F.array_join(F.transform(found, lambda x: F.concat_ws(
            ":", F.element_at(names, x["kind"] + 1), x["start"], x["stop"])), ",").alias("spans"),
        found.alias("found"))


def _kind_count(kind: int) -> Column:
    return F.size(F.filter("s.base", lambda x: x["kind"] == kind)).cast("long")
