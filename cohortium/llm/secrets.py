"""Secrets in texts: base patterns, and parts of credentials that only count together.

Base patterns (assignments, access identifiers, long hex runs) are reported as they are. Weak candidates, a bare secret of
an access key's shape or a service endpoint, are reported only when complementary parts lie in their scope (a block between
blank lines): the parts are joined as intervals by binary search over their sorted starts. The operators let the scope alone
bound the join; a ``reach`` in code points narrows it. Everything happens inside the row's text, so no row is shuffled and
memory follows the longest text.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .texts import importable

REACH = 400  # of ``secret_spans`` called by itself; the operators have no reach unless one is given

# The patterns of the base kinds, in the order of the kinds
KINDS = ("assign", "access", "hex", "secret", "endpoint", "pair")
ASSIGN = re.compile(r"""(?ai:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{32,}")
WORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")

BARE = re.compile(r"(?<![A-Za-z0-9+/])[A-Za-z0-9+/]{40}(?![A-Za-z0-9+/=])")
ENDPOINT = re.compile(r"(?ai:https?://)[A-Za-z0-9.-]+(?::[0-9]+)?(?:/[!-~]*)?|(?<![a-z0-9.-])[a-z0-9.-]+\.amazonaws\.com(?::[0-9]+)?")
ENDS_URL = re.compile(r"""["'`<>,;{}|\\]""")  # what ends an address inside a run that the endpoint's pattern takes whole
BLANK = re.compile(r"\n[ \t\r]*\n")


def base_spans(text: str) -> list[tuple[int, int, str, tuple[int, int]]]:
    """(start, end, kind, span of the value) of the base kinds."""
    found = []
    lowered = text.lower()  # only to skip texts without any of the words
    if any(word in lowered for word in WORDS):
        found += [(*m.span(), "assign", m.span(2)) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 8]
    if "AKIA" in text:
        found += [(*m.span(), "access", m.span()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 16]
    found += [(*m.span(), "hex", m.span()) for m in HEX.finditer(text)]
    return found


def near(starts: np.ndarray, ends: np.ndarray, left: np.ndarray, right: np.ndarray, reach: int) -> np.ndarray:
    """For each interval, whether one of the intervals [left, right) begins or ends within ``reach`` of it.

    An interval join of two sorted sides: the nearest beginning behind each start and the furthest end before it decide.
    """
    if not len(left):
        return np.zeros(len(starts), bool)
    order = np.argsort(left, kind="stable")
    left, right = left[order], np.maximum.accumulate(right[order])
    at = np.searchsorted(left, ends + reach, side="right")
    return (at > 0) & (right[np.maximum(at - 1, 0)] >= starts - reach)


def outside(spans: list[tuple[int, int]], others: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Those of ``spans`` that lie in none of ``others``, by binary search for the furthest end of what begins before."""
    if not spans or not others:
        return spans
    left, right = np.array(sorted(others), np.int64).T
    start, end = np.array(spans, np.int64).T
    at = np.searchsorted(left, start, side="right")
    within = (at > 0) & (np.maximum.accumulate(right)[np.maximum(at - 1, 0)] >= end)
    return [span for span, hidden in zip(spans, within.tolist()) if not hidden]


def linked_spans(text: str, base: list, reach: int | None = None) -> list[tuple[int, int, str]]:
    """Weak candidates with their complements: secrets and endpoints near their other parts, and the pairs they make.

    A bare secret needs an access identifier or an endpoint in its scope, and is no secret of an endpoint whose address it
    lies in; an endpoint needs an access identifier, an assignment or a confirmed secret. A pair spans an access identifier
    and a secret (bare or assigned) of the scope: each identifier with its nearest secret, each secret with its nearest
    identifier. Without ``reach`` the scope alone bounds all this.
    """
    bare = outside([m.span() for m in BARE.finditer(text)], [v for _, _, kind, v in base if kind in ("hex", "access")])
    if not base and not bare:  # nothing that an endpoint could complement
        return []
    reach = len(text) if reach is None else reach
    endpoints = [m.span() for m in ENDPOINT.finditer(text)] if "://" in text or "amazonaws" in text else []
    edges = np.array([m.end() for m in BLANK.finditer(text)], np.int64)

    def columns(spans):
        table = np.array(spans, np.int64).reshape(-1, 2)
        return table[:, 0], table[:, 1], np.searchsorted(edges, table[:, 0], side="right")

    def of(part, scope):
        first, last = np.searchsorted(part[2], [scope, scope + 1])
        return [x[first:last] for x in part[:2]]

    out: list[tuple[int, int, str]] = []
    access = columns([v for _, _, kind, v in base if kind == "access"])
    assigned = columns([v for _, _, kind, v in base if kind == "assign"])
    weak, service = columns(bare), columns(endpoints)
    address_ends = np.array([m.start() if (m := ENDS_URL.search(text, i, j)) else j for i, j in endpoints], np.int64)
    at = np.searchsorted(service[0], weak[0], side="right")
    within = (at > 0) & (address_ends[at - 1] > weak[0]) if len(endpoints) else np.zeros(len(bare), bool)
    for scope in np.unique(np.concatenate([access[2], assigned[2], weak[2]])).tolist():
        a, s, w, e = (of(part, scope) for part in (access, assigned, weak, service))
        sure = near(*w, *a, reach) | (near(*w, *e, reach) & ~of((within, within, weak[2]), scope)[0])
        w = [x[sure] for x in w]
        out += [(i, j, "secret") for i, j in zip(*(x.tolist() for x in w))]
        parts = [np.concatenate(x) for x in zip(a, s, w)]
        kept = near(*e, *parts, reach)
        out += [(i, j, "endpoint") for i, j in zip(*(x[kept].tolist() for x in e))]
        secret = [np.concatenate(x) for x in zip(s, w)]
        out += pairs(a, secret, reach) + pairs(secret, a, reach)
    return out


def pairs(own: list[np.ndarray], other: list[np.ndarray], reach: int) -> list[tuple[int, int, str]]:
    """The span over each of ``own`` and its nearest of ``other`` within ``reach``; the earlier one of two as near."""
    if not len(own[0]) or not len(other[0]):
        return []
    order = np.argsort(other[0], kind="stable")
    left, right = other[0][order], other[1][order]
    at = np.searchsorted(left, own[0])
    before, behind = np.maximum(at - 1, 0), np.minimum(at, len(left) - 1)
    far = np.iinfo(np.int64).max
    gap_before = np.where(at > 0, np.maximum(own[0] - right[before], 0), far)
    gap_behind = np.where(at < len(left), np.maximum(left[behind] - own[1], 0), far)
    pick, gap = np.where(gap_before <= gap_behind, before, behind), np.minimum(gap_before, gap_behind)
    good = gap <= reach
    begin, end = np.minimum(own[0], left[pick])[good], np.maximum(own[1], right[pick])[good]
    return [(i, j, "pair") for i, j in zip(begin.tolist(), end.tolist())]


def secret_spans(text: str, reach: int | None = REACH) -> list[tuple[int, int, str]]:
    """All spans (start, end, kind) of a text in code points, by start, then by kind in the order of ``KINDS``."""
    base = base_spans(text)
    found = [(start, end, kind) for start, end, kind, _ in base] + linked_spans(text, base, reach)
    return sorted(set(found), key=lambda x: (x[0], KINDS.index(x[2]), x[1]))


def find_secrets(df: DataFrame, text: str = "text", to: str = "secrets", reach: int | None = None) -> DataFrame:
    """``df`` with the column ``to``: array of (kind, start, end) by start, then kind. Null counts as empty. No shuffle.

    Offsets are code points, ends exclusive. An existing column ``to`` is replaced.
    """
    importable(df)

    @F.arrow_udf("array<struct<kind:string,start:long,end:long>>")
    def spans(column: pa.Array) -> pa.Array:
        rows = [[{"kind": kind, "start": start, "end": end} for start, end, kind in secret_spans(t.as_py() or "", reach)]
                for t in column]
        return pa.array(rows, pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())])))

    return df.withColumn(to, spans(F.col(text)))


def without_secrets(df: DataFrame, text: str = "text", reach: int | None = None) -> DataFrame:
    """``df`` with every secret of ``text`` replaced by ``[kind]``; all rows and columns stay, null stays null.

    Of overlapping spans the union is replaced, under the kind that begins first.
    """
    importable(df)

    @F.arrow_udf("string")
    def redacted(column: pa.Array) -> pa.Array:
        return pa.array([None if (t := v.as_py()) is None else redact(t, secret_spans(t, reach)) for v in column], pa.string())

    return df.withColumn(text, redacted(F.col(text)))


def redact(text: str, spans: list[tuple[int, int, str]]) -> str:
    spans = [s for s in spans if s[2] not in ("pair", "endpoint")]  # a pair's parts are spans of their own
    out, done = [], 0
    for start, end, kind in spans:
        if start >= done:
            out += [text[done:start], f"[{kind}]"]
        done = max(done, end)
    return "".join([*out, text[done:]])
