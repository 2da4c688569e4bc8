"""Secrets in texts: what stands out by itself, and weak candidates that a complementary part bears out.

A credential has up to three parts: an access identifier, a secret and an endpoint. Some forms are reported
wherever they stand (the base spans). Weaker ones, such as a user name, a short password or a host, are common in
clean text, so these are only candidates; one counts if a part that complements it stands within reach in
the same scope, a paragraph. The parts of many texts are laid out on one axis on which scopes lie further apart
than the reach, and each kind is joined to the others by two binary searches in sorted ends: an interval join
that sends nothing anywhere, as no scope reaches over a text.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from .common import slices

# The base kinds, with the form of each and the least length of what counts.
ASSIGN = r"""((?ai:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ASSIGN_VALUE = 12
ACCESS, ACCESS_LENGTH = r"AKIA[A-Z0-9]+", 18
HEX, HEX_LENGTH = r"[0-9a-f]+", 16

# Weak forms. A value after a name is an identifier, a secret or an endpoint by the name; names have no case.
NAMES = {
    "identifier": "user|user_?name|user_?id|login|account|account_?id|client_?id|access_?key|access_?key_?id",
    "secret": "password|passwd|pwd|pass|passphrase|secret|secret_?key|client_?secret|token|api_?key|auth",
    "endpoint": "host|host_?name|server|endpoint|url|uri",
}
NAMED = r"""(?<![A-Za-z0-9])(?ai:%s)["']?\x20{0,8}[:=](?!//)\x20{0,8}["']?[^\s"'<>,;]{3,}"""
KEY_IDS = "AKIA|ASIA|AIDA|AROA"
FORMS = {
    "identifier": rf"(?<![A-Za-z0-9])(?:{KEY_IDS})[A-Z0-9]{{8,}}",
    "secret": r"(?<![A-Za-z0-9+/_=-])(?=[A-Za-z+/_=-]*[0-9])(?=[a-z0-9+/_=-]*[A-Z])(?=[A-Z0-9+/_=-]*[a-z])[A-Za-z0-9+/_=-]{20,}",
    "endpoint": r"(?<![A-Za-z0-9+.-])[A-Za-z][A-Za-z0-9+.-]{1,15}://[^\s\"'<>]+|(?<![0-9.])[0-9]{1,3}(?:\.[0-9]{1,3}){3}(?::[0-9]{1,5})?(?![0-9.])",
}
#: Code points between two parts of a credential at most.
REACH = 200
#: What parts a scope from the next: a line without a word.
SCOPE_END = re.compile(r"\n[\x20\t\r]*\n")

BASE_KINDS = ("assign", "access", "hex")
KINDS = (*BASE_KINDS, *NAMES)
#: The part that each base kind is.
ROLE = {"assign": "secret", "access": "identifier", "hex": "secret"}
ROLES = tuple(NAMES)

_ASSIGN, _ACCESS = re.compile(ASSIGN), re.compile(ACCESS)
_HEX = re.compile(HEX[:-1] + f"{{{HEX_LENGTH},}}")  # runs are maximal, so looking for long ones finds the same
_WEAK = {role: [re.compile(NAMED % NAMES[role]), re.compile(FORMS[role])] for role in ROLES}
#: For the search of whole batches: linear in the text, and true of each text with a match.
_MAY_ASSIGN = r"(?i)(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]"
_MAY_HEX = f"[0-9a-f]{{{HEX_LENGTH}}}"
_MAY_IDENTIFY = rf"(?i:{NAMES['identifier']})[\"']?\x20*[:=]|{KEY_IDS}"


class Parts(NamedTuple):
    """Parts of many texts, as arrays: the text's place, kind, start, end (code points) and scope within the text."""

    text: np.ndarray
    kind: np.ndarray
    start: np.ndarray
    end: np.ndarray
    scope: np.ndarray


def base_spans(text: str, assign: bool = True, access: bool = True, hexes: bool = True) -> list[tuple[int, int, int]]:
    """Start, place of the kind and end of each base span, by start and kind; the flags say what may occur at all."""
    found = [(m.start(), 0, m.end()) for m in _ASSIGN.finditer(text) if len(m[2]) >= ASSIGN_VALUE] if assign else []
    found += [(m.start(), 1, m.end()) for m in _ACCESS.finditer(text) if m.end() - m.start() >= ACCESS_LENGTH] if access else []
    found += [(m.start(), 2, m.end()) for m in _HEX.finditer(text)] if hexes else []
    return sorted(found)


def weak_spans(text: str, base: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """Candidates, as base_spans() gives its spans: without those that overlap a base span, or an earlier one of their kind."""
    taken = sorted((b, e) for b, _, e in base)
    starts, reach = [b for b, _ in taken], np.maximum.accumulate([e for _, e in taken]).tolist() if taken else []
    found = []
    for role, forms in _WEAK.items():
        spans = sorted((m.start(), -m.end()) for form in forms for m in form.finditer(text))
        last = 0
        for b, e in spans:
            k = int(np.searchsorted(starts, -e)) - 1  # the last base span that begins before this one ends
            if b >= last and (k < 0 or reach[k] <= b):
                found.append((b, KINDS.index(role), -e))
                last = -e
    return sorted(found)


def _near(points: np.ndarray, lows: np.ndarray, highs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each closed interval the places, in sorted ``points``, of the first point in it and of the one after the last."""
    return np.searchsorted(points, lows, "left"), np.searchsorted(points, highs, "right")


def nearest_complement(parts: Parts, of: np.ndarray, to: np.ndarray, reach: int = REACH) -> np.ndarray:
    """For each part of ``of`` the part of ``to`` nearest to it: apart from it, of the same scope and within ``reach``.

    ``of`` and ``to`` are places in ``parts``; so is the result, or -1 where there is none. Of two as near
    it is the one before.
    """
    if not len(of) or not len(to):
        return np.full(len(of), -1)
    # one axis: a scope's own coordinates, moved so far that parts of two scopes are never within reach
    order = np.lexsort((parts.start, parts.scope, parts.text))
    changes = np.append(True, (np.diff(parts.text[order]) != 0) | (np.diff(parts.scope[order]) != 0))
    rank = np.empty(len(order), np.int64)
    rank[order] = np.cumsum(changes)
    shift = rank * (int(parts.end.max()) + reach + 1)
    begins, ends = parts.start + shift, parts.end + shift
    by_begin, by_end = to[np.argsort(begins[to], kind="stable")], to[np.argsort(ends[to], kind="stable")]
    first, past = _near(begins[by_begin], ends[of], ends[of] + reach)
    after = np.where(first < past, by_begin[np.minimum(first, len(to) - 1)], -1)
    first, past = _near(ends[by_end], begins[of] - reach, begins[of])
    before = np.where(first < past, by_end[np.maximum(past, 1) - 1], -1)
    gap_after = np.where(after >= 0, begins[after] - ends[of], reach + 1)
    gap_before = np.where(before >= 0, begins[of] - ends[before], reach + 1)
    return np.where(gap_before <= gap_after, before, after)


def link(parts: Parts, reach: int = REACH) -> tuple[np.ndarray, np.ndarray]:
    """Which parts count, and for each secret that has an identifier the places of both and of an endpoint (or -1).

    Base spans count always. An identifier counts with a secret in reach, a secret with an identifier in reach, an
    endpoint with both. Each secret is linked to the identifier nearest to it.
    """
    roles = np.array([ROLES.index(ROLE.get(k, k)) for k in KINDS])[parts.kind]
    identifiers, secrets, endpoints = (np.flatnonzero(roles == k) for k in range(3))
    identifier = nearest_complement(parts, secrets, identifiers, reach)
    secret = nearest_complement(parts, identifiers, secrets, reach)
    counts = parts.kind < len(BASE_KINDS)
    counts[secrets[identifier >= 0]] = counts[identifiers[secret >= 0]] = True
    both = (nearest_complement(parts, endpoints, identifiers, reach) >= 0) & (nearest_complement(parts, endpoints, secrets, reach) >= 0)
    counts[endpoints[both]] = True
    linked = secrets[identifier >= 0]
    endpoint = nearest_complement(parts, linked, endpoints[both], reach)
    return counts, np.column_stack([identifier[identifier >= 0], linked, endpoint])


ENDS = [f"{role}_{side}" for role in ROLES for side in ("start", "end")]
SPANS = T.ArrayType(T.StructType().add("kind", "string").add("start", "long").add("end", "long"))
CREDENTIALS = T.ArrayType(T.StructType([T.StructField(name, T.LongType()) for name in ENDS]))


def _may(texts: pa.Array, pattern: str) -> list[bool]:
    return pc.fill_null(pc.match_substring_regex(texts, pattern), False).to_pylist()


def scan(texts: list[str]) -> tuple[list[list[tuple[int, int, int]]], list[list[tuple]]]:
    """For each text its spans as (start, place of the kind, end), and its credentials as (start, end) of their three parts."""
    column = pa.array(texts, pa.large_string())
    assign, access, hexes, weak = _may(column, _MAY_ASSIGN), _may(column, "AKIA"), _may(column, _MAY_HEX), _may(column, _MAY_IDENTIFY)
    spans, rows, scopes = [], [], []
    for k, text in enumerate(texts):
        own = base_spans(text, assign[k], access[k], hexes[k]) if assign[k] or access[k] or hexes[k] else []
        if weak[k]:  # without an identifier no candidate counts
            own = sorted(own + weak_spans(text, own))
            breaks = [m.start() for m in SCOPE_END.finditer(text)]
            rows += [(k, kind, b, e) for b, kind, e in own]
            scopes += np.searchsorted(breaks, [b for b, _, _ in own], "right").tolist()
        spans.append(own)
    credentials: list[list[tuple]] = [[] for _ in texts]
    if rows:
        parts = Parts(*np.array(rows, np.int64).T, np.array(scopes, np.int64))
        counts, linked = link(parts)
        for k in set(parts.text.tolist()):
            spans[k] = []
        for (k, kind, b, e), counted in zip(rows, counts.tolist(), strict=True):
            if counted:
                spans[k].append((b, kind, e))
        for row in linked.tolist():
            credentials[rows[row[1]][0]].append(tuple(x for part in row for x in (rows[part][2:] if part >= 0 else (None, None))))
    return spans, credentials


def with_secrets(df: DataFrame, text: str = "text") -> DataFrame:
    """The columns of ``df`` but its ``text`` as a struct ``columns``, and ``spans`` and ``credentials`` of the text.

    spans: kind, start and end (code points, end exclusive) by start, then kind in the order of KINDS. A null
    text is empty and has none. credentials: for each secret near an identifier the spans of both and of
    an endpoint near by, which may be null. Each row depends on its own text alone, rows keep their number, and a
    very long text is scanned whole.
    """
    rest = [c for c in df.columns if c != text] or [text]
    carried = df.select(F.struct(*(F.col(f"`{c}`") for c in rest)).alias("columns"), F.col(f"`{text}`").alias("text"))
    schema = T.StructType([carried.schema["columns"], T.StructField("spans", SPANS), T.StructField("credentials", CREDENTIALS)])
    kinds, ends = to_arrow_type(SPANS), to_arrow_type(CREDENTIALS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, at = [t or "" for t in batch.column(1).to_pylist()], 0
            for part in slices(texts):
                spans, credentials = scan(part)
                named = [[{"kind": KINDS[kind], "start": b, "end": e} for b, kind, e in own] for own in spans]
                told = [[dict(zip(ENDS, c, strict=True)) for c in own] for own in credentials]
                columns = [batch.column(0).slice(at, len(part)), pa.array(named, kinds), pa.array(told, ends)]
                yield pa.RecordBatch.from_arrays(columns, ["columns", "spans", "credentials"])
                at += len(part)

    return carried.mapInArrow(run, schema)


def joined(spans: Column, kinds: tuple[str, ...] = KINDS) -> Column:
    """``spans`` of ``kinds`` as text: kind:start:end, joined by commas."""
    own = F.filter(spans, lambda x: x["kind"].isin(*kinds))
    return F.array_join(F.transform(own, lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])), ",")


def count(spans: Column, kind: str) -> Column:
    return F.size(F.filter(spans, lambda x: x["kind"] == kind)).cast("long")
