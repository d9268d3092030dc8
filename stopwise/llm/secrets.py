"""Secret scans with multipart credential linking.

Strong candidates (kinds ``assign``, ``access``, ``hex``) are reported wherever they occur. Weak ones, which
alone would mostly be noise, are parts of a credential: an identifier (user or client id), a bare key
of secret length, an endpoint (URL with host, host and port, IPv4 address). Each part, strong ones too, has an interval:
itself and ``REACH`` code points to both sides, within its scope (text between blank lines). An interval join
finds the parts that lie within reach of each other; a weak part is reported only where the complementary
parts co-occur: a bare key with an identifier or endpoint, an identifier with a secret, an endpoint
with both. No number of parts in a scope makes the join quadratic: for each kind of role only the nearest neighbour matters.

Spans are code points, end exclusive. Edge cases: null and empty texts have no span; equal spans of one kind count
once; a weak part that overlaps a strong one is left out; no text is cut.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_arrow, texts

REACH = 240
# Patterns of the strong kinds, in the order in which they are listed, with the least length.
STRONG = (
    ("assign", re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A), 2, 12),
    ("access", re.compile(r"AKIA[A-Z0-9]+"), 0, 18),
    ("hex", re.compile(r"[0-9a-f]{16,}"), 0, 16),
)
# Patterns of the weak kinds.
IDENT = re.compile(r"""\b(?:user(?:name)?|login|account|client_?id|access_?key(?:_?id)?)["']?\x20*[:=]\x20*["']?([A-Za-z0-9_.@-]{3,})""", re.I | re.A)
KEY = re.compile(r"(?<![A-Za-z0-9+/=_-])(?=[A-Za-z0-9+/]*[a-z])(?=[A-Za-z0-9+/]*[A-Z])(?=[A-Za-z0-9+/]*[0-9])[A-Za-z0-9+/]{32,64}={0,2}(?![A-Za-z0-9+/=_-])")
URL = re.compile(r"https?://[A-Za-z0-9.-]+(?::[0-9]{1,5})?")
IPV4 = re.compile(r"(?<![0-9.])[0-9]{1,3}\.(?:[0-9]{1,3}\.){2}[0-9]{1,3}(?::[0-9]{1,5})?(?![0-9.])")
# possessive, and begun only where a run of host letters begins, so that each letter is read once
HOST = re.compile(r"(?<![A-Za-z0-9_.-])[a-z0-9-]++(?:\.[a-z0-9-]++)++:[0-9]{2,5}\b", re.A)
KINDS = ("assign", "access", "hex", "ident", "key", "endpoint")
#: What a part can serve as: identifier, secret, endpoint.
ROLE = {"assign": "s", "access": "i", "hex": "s", "ident": "i", "key": "s", "endpoint": "e"}
_SCOPE_END = re.compile(r"\n[\x20\x09\x0B-\x0D]*\n")

Span = tuple[int, int, str]


def strong_spans(text: str) -> list[Span]:
    out = []
    assigned = ":" in text or "=" in text
    for kind, pattern, group, least in STRONG:
        if kind == "assign" and not assigned:
            continue
        out += [(*m.span(), kind) for m in pattern.finditer(text) if m.end(group) - m.start(group) >= least]
    return out


def _near(parts: list[Span], role: str, among: dict[str, list[Span]]) -> list[bool]:
    """For each part, whether one of that role, not itself, lies within reach: the gap between them is at most REACH."""
    others = among[role]
    starts = [o[0] for o in others]
    high, reach = -1, []
    for o in others:  # the farthest end so far, so that one look to the left is enough
        high = max(high, o[1])
        reach.append(high)
    out = []
    for a, b, kind in parts:
        k = bisect_left(starts, a)
        own = k < len(others) and others[k] == (a, b, kind)
        right = k + own < len(others) and starts[k + own] - b <= REACH
        left = k > 0 and a - reach[k - 1] <= REACH
        out.append(right or left)
    return out


def weak_spans(text: str, strong: list[Span]) -> list[Span]:
    """Weak parts that overlap no strong one. Each pattern is tried only where a character it needs occurs."""
    colon = ":" in text
    tries = [
        ("ident", IDENT, colon or "=" in text),
        ("key", KEY, max(map(len, text.split()), default=0) >= 32),
        ("endpoint", URL, "://" in text),
        ("endpoint", IPV4, "." in text),
        ("endpoint", HOST, colon),
    ]
    out = []
    starts, reach, high = [s[0] for s in sorted(strong)], [], -1
    for s in sorted(strong):
        high = max(high, s[1])
        reach.append(high)
    for kind, pattern, may in tries:
        for m in pattern.finditer(text) if may else ():
            a, b = m.span()
            k = bisect_left(starts, b)
            if not (k and reach[k - 1] > a):
                out.append((a, b, kind))
    return out


def linked_spans(text: str, strong: list[Span]) -> list[Span]:
    """Weak parts that complementary parts vouch for."""
    weak = weak_spans(text, strong)
    if not weak:
        return []
    ends = [m.end() for m in _SCOPE_END.finditer(text)]
    scopes: dict[int, list[Span]] = {}
    for part in sorted({*weak, *strong}):
        scopes.setdefault(bisect_left(ends, part[0] + 1), []).append(part)
    out = []
    for parts in scopes.values():
        by = {r: [p for p in parts if ROLE[p[2]] == r] for r in "ise"}
        mine = [p for p in parts if p[2] in ("ident", "key", "endpoint")]
        near = {r: _near(mine, r, by) for r in "ise"}
        for k, part in enumerate(mine):
            i, s, e = near["i"][k], near["s"][k], near["e"][k]
            if {"ident": s, "key": i or e, "endpoint": i and s}[part[2]]:
                out.append(part)
    return out


def written(spans: list[Span]) -> str:
    """``kind:start:end`` by start, then kind as listed, comma-joined."""
    return ",".join(f"{k}:{a}:{b}" for a, b, k in sorted(set(spans), key=lambda s: (s[0], KINDS.index(s[2]), s[1])))


def scan(text: str) -> tuple[int, int, int, str, str]:
    strong = strong_spans(text)
    counts = [sum(s[2] == kind for s in strong) for kind in KINDS[:3]]
    every = strong + linked_spans(text, strong)
    return *counts, hashlib.sha256(written(strong).encode()).hexdigest(), written(every)


def scanned(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_assign, n_access, n_hex, base_sha256, spans) of every text."""

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        cols = list(zip(*map(scan, texts(batch.column(1))), strict=True))
        arrays = [pa.array(c, pa.int64()) for c in cols[:3]] + [pa.array(c, pa.string()) for c in cols[3:]]
        return pa.RecordBatch.from_arrays([batch.column(0), *arrays], ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"])

    narrow = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    kind = narrow.schema["doc_id"].dataType.simpleString()
    return map_arrow(narrow, f"doc_id {kind}, n_assign long, n_access long, n_hex long, base_sha256 string, spans string", work)
