"""Secret scans: fixed patterns, and sliding-window Shannon entropy per character class.

The entropy scan takes candidate strings, slides a window over each class of characters that the candidate fits and
keeps the window's entropy by incremental counts: one character enters, one leaves, and only their two terms change.
Candidates on the allow-list are suppressed.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_right
from collections import Counter

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import row_map, sha

#: Kinds in the order that breaks ties, the base patterns and their least lengths.
KINDS = ("assign", "access", "hex", "entropy")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII | re.IGNORECASE)
ASSIGN_WORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]+")
LEAST = {"assign": 8, "access": 16, "hex": 32}

CANDIDATE = re.compile(r"[A-Za-z0-9+/_=-]+")
#: Character classes by name: what a candidate consists of, and the entropy in bits a character that a window must reach.
CLASSES = {"hex": (re.compile(r"[0-9a-fA-F]+"), 3.0), "base64": (re.compile(r"[A-Za-z0-9+/_=-]+"), 3.7)}
#: Candidates that are no secrets: words, numbers, runs of separators, UUIDs, dates, and paths or names of words.
ALLOW = tuple(map(re.compile, (r"[A-Za-z]+", r"[0-9]+", r"[+/_=-]+", r"[0-9a-fA-F]{8}(-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}", r"[0-9]{4}-[0-9]{2}-[0-9]{2}\w*", r"([A-Za-z]*[+/_=-])+[A-Za-z]*[0-9]{0,4}")))


def window_entropy(text: str, window: int) -> float:
    """The largest Shannon entropy, in bits a character, of any window of the text (the whole text if shorter)."""
    n = min(window, len(text))
    if not n:
        return 0.0
    counts = Counter(text[:n])
    total = sum(c * math.log2(c) for c in counts.values())  # entropy = log2(n) - total / n
    least = total
    for i in range(n, len(text)):
        for char, by in ((text[i - n], -1), (text[i], 1)):
            c = counts[char]
            counts[char] = c + by
            total += ((c + by) * math.log2(c + by) if c + by > 0 else 0.0) - (c * math.log2(c) if c > 0 else 0.0)
        least = min(least, total)
    return math.log2(n) - least / n


def is_random(candidate: str, window: int) -> bool:
    if any(a.fullmatch(candidate) for a in ALLOW):
        return False
    return any(kind.fullmatch(candidate) and window_entropy(candidate, window) >= bits for kind, bits in CLASSES.values())


def base_spans(text: str, longest: int) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the fixed patterns; longest: no run without white space is longer."""
    out = []
    lower = text.lower()
    if any(w in lower for w in ASSIGN_WORDS):
        out += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= LEAST["assign"]]
    if longest >= LEAST["access"] and "AKIA" in text:
        out += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if len(m[0]) >= LEAST["access"]]
    if longest >= LEAST["hex"]:
        out += [(m.start(), 2, m.end()) for m in HEX.finditer(text) if len(m[0]) >= LEAST["hex"]]
    return sorted(out)


def covered(spans: list[tuple[int, int, int]]) -> tuple[list[int], list[int]]:
    """Starts and ends of the stretches that the sorted spans cover; no two touch or overlap."""
    starts, ends = [], []
    for s, _, e in spans:
        if ends and s <= ends[-1]:
            ends[-1] = max(ends[-1], e)
        else:
            starts.append(s)
            ends.append(e)
    return starts, ends


def uncovered(start: int, end: int, taken: tuple[list[int], list[int]]) -> list[tuple[int, int]]:
    """The parts of start to end outside the covered stretches; only those that it meets are looked at."""
    out, k = [], bisect_right(taken[1], start)
    while k < len(taken[0]) and taken[0][k] < end:
        if start < taken[0][k]:
            out.append((start, taken[0][k]))
        start = taken[1][k]
        k += 1
    return [*out, (start, end)] if start < end else out


def entropy_spans(text: str, pieces: list[str], least: int, window: int, taken: tuple[list[int], list[int]]) -> list[tuple[int, int, int]]:
    """Spans of random-looking candidates of at least `least` characters; base spans cut a candidate, and each part counts by itself."""
    out, at = [], 0
    for piece in pieces:
        at = text.index(piece, at)
        if len(piece) >= least and not piece.isalpha():
            for m in CANDIDATE.finditer(piece):
                start, end = at + m.start(), at + m.end()
                if end - start >= least:
                    out += [(a, 3, b) for a, b in uncovered(start, end, taken) if b - a >= least and is_random(text[a:b], window)]
        at += len(piece)
    return out


def spans_of(text: str | None, least: int, window: int) -> tuple[list, list]:
    """(base spans, entropy spans) of a text."""
    if not text:
        return [], []
    pieces = text.split()
    longest = max(map(len, pieces), default=0)
    base = base_spans(text, longest)
    return base, entropy_spans(text, pieces, least, window, covered(base)) if longest >= least else []


def joined(spans: list) -> list[str]:
    return [f"{KINDS[k]}:{s}:{e}" for s, k, e in sorted(spans)]


def redacted(text: str, spans: list) -> str:
    """The text with each span, overlapping ones taken together, replaced by its first kind's name."""
    out, at = [], 0
    for start, kind, end in sorted(spans):
        if start >= at:
            out += [text[at:start], f"[{KINDS[kind]}]"]
        at = max(at, end)
    return "".join([*out, text[at:]])


def scanned(docs: DataFrame, *, text: str = "text", least: int = 20, window: int = 20) -> DataFrame:
    """All columns of docs, then n_assign, n_access, n_hex, base_sha256, spans and redacted_text.

    Offsets are code points, ends exclusive; null texts count as empty, and then redacted_text is null.  Each row
    is scanned by itself, whole, so repeated rows give repeated results and an empty table an empty one.  The six
    new columns replace columns of the same name.
    """
    new = {"n_assign": "bigint", "n_access": "bigint", "n_hex": "bigint", "base_sha256": "string", "spans": "string", "redacted_text": "string"}

    def scan(texts):
        rows = []
        for value in texts:
            base, more = spans_of(value, least, window)
            kinds = Counter(k for _, k, _ in base)
            rows.append((kinds[0], kinds[1], kinds[2], sha(joined(base)), ",".join(joined(base + more)), redacted(value, base + more) if base or more else value))
        return list(zip(*rows, strict=True)) or [[]] * len(new)

    return row_map(docs, new, scan, text)


def secret_spans(docs: DataFrame, **options) -> DataFrame:
    """One row per row of docs: doc_id, n_assign, n_access, n_hex, base_sha256, spans."""
    return scanned(docs.select("doc_id", "text"), **options).drop("text", "redacted_text")


def without_secrets(docs: DataFrame, **options) -> DataFrame:
    """The rows and columns of docs with secrets in the text replaced; n_chars, if there, follows the text."""
    found = scanned(docs, **options)
    changed = F.col("spans") != ""
    out = {c: F.col(f"`{c}`") for c in docs.columns} | {"text": F.when(changed, F.col("redacted_text")).otherwise(F.col("text"))}
    if "n_chars" in docs.columns:
        kind = docs.schema["n_chars"].dataType
        out["n_chars"] = F.when(changed, F.length("redacted_text").cast(kind)).otherwise(F.col("n_chars"))
    return found.select(*[value.alias(c) for c, value in out.items()])
