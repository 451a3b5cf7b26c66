"""Secret scans by assignment-aware lexing.

Base patterns find `assign`, `access` and `hex` spans. On top, assignments in source or configuration syntax are lexed
into name-literal pairs: `name = literal`, `name: literal`, `"name": "literal"`, `name := literal`, `name => literal`,
`<name>literal</name>`, with literals quoted or bare, joined by `+`, or given through a name assigned before (constants
are propagated in reading order; a name that gets an unknown value is no constant any more). A pair is scored by the words
of its target name and by its literal's length, entropy and character classes; pairs above the threshold add `pair` spans
over their literals.

A joined or propagated value is kept as what its score needs: length, counts of characters, first and last few characters, and the
values it was joined from. So a value may be joined from any number of literals and doubled any number of times; its literals
are walked once a text, when a pair above the threshold needs them. A name whose new value uses its own old one is data, not a
constant: its pair gives no span.

Distribution: one map over whole texts without a shuffle. Patterns are run only where a character they need occurs.

Defined results: null or empty text has no spans; repeated rows are scanned alike; a very long text is one call, scanned
whole in time linear in its length; spans that start together are in the order of their kinds; an empty table gives an empty
result; extra columns are ignored, whatever their names. Spans are counted in code points, end exclusive.
"""

from __future__ import annotations

import hashlib
import math
import re
from bisect import bisect_right
from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame

from matchloom.llm._spark import small_batches

KINDS = ("assign", "access", "hex", "pair")
ASSIGN = re.compile(r"((?i:password|passwd|secret|token|api_?key))[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{32,}")
OPERATOR = re.compile(r"(?<![=!<>:+*/%&|^~-])(?::=|=>|=(?![=~])|:(?![:/=]))")
ELEMENT = re.compile(r"<([A-Za-z_][\w.-]*)>([^<>\s]+)</\1>", re.ASCII)
OPERAND = re.compile(r"[ \t]*(?:\"((?:[^\"\\\n]|\\.)*)\"|'((?:[^'\\\n]|\\.)*)'|`([^`]*)`|([^\s\"'`,;(){}\[\]<>]+))")
JOIN = re.compile(r"[ \t]*\+(?=[ \t]*[\"'`A-Za-z_$])")
NAME = re.compile(r"[A-Za-z_$][\w$]*(?:[.-][\w$]+)*", re.ASCII)
SUBWORD = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+|[0-9]+")
#: Weights of the words of a target name.
SENSITIVE = {
    "password": 1.0, "passwd": 1.0, "passphrase": 1.0, "pwd": 0.9, "pass": 0.7, "secret": 0.9, "token": 0.8, "apikey": 0.9, "credential": 0.9,
    "credentials": 0.9, "key": 0.4, "api": 0.2, "auth": 0.5, "bearer": 0.6, "private": 0.4, "access": 0.2, "signing": 0.3, "encryption": 0.3, "jwt": 0.6,
    "salt": 0.5, "pin": 0.4, "public": -0.6, "name": -0.5, "file": -0.5, "path": -0.5, "url": -0.5, "length": -0.6, "type": -0.5, "count": -0.6, "id": -0.2,
}
PLACEHOLDER = re.compile(r"(?i)change.?me|example|placeholder|your|dummy|sample|redacted|xxx|\*\*\*|todo|none$|null$|true$|false$|undefined|\$\{|\{\{|<|%\(")
THRESHOLD = 0.55
EDGE = 16  # longer than any placeholder


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, end, kind number) of the base patterns, unsorted."""
    out = []
    if "=" in text or ":" in text:
        out += [(*m.span(), 0) for m in ASSIGN.finditer(text) if len(m[2]) >= 8]
    if "AKIA" in text:
        out += [(*m.span(), 1) for m in ACCESS.finditer(text) if len(m[0]) >= 16]
    out += [(*m.span(), 2) for m in HEX.finditer(text)]
    return out


def name_score(name: str) -> float:
    return min(1.0, max(0.0, sum(SENSITIVE.get(w.lower(), 0.0) for w in SUBWORD.findall(name))))


class Value:
    """A literal, or values joined one after the other, with what its score needs."""

    __slots__ = ("counts", "head", "parts", "placeholder", "size", "span", "tail")

    def __init__(self, text: str, span: tuple[int, int]) -> None:
        self.size, self.counts, self.span, self.parts = len(text), Counter(text), span, ()
        self.head, self.tail = text[:EDGE], text[-EDGE:]
        self.placeholder = bool(PLACEHOLDER.search(text))

    @classmethod
    def joined(cls, parts: list[Value]) -> Value:
        if len(parts) == 1:
            return parts[0]
        out = cls("", (0, 0))
        out.span, out.parts = None, tuple(parts)
        for p in parts:
            out.placeholder |= p.placeholder or bool(PLACEHOLDER.search(out.tail + p.head))
            out.size += p.size
            out.counts.update(p.counts)
            out.head = (out.head + p.head)[:EDGE]
            out.tail = (out.tail + p.tail)[-EDGE:]
        return out

    def score(self) -> float:
        """0 to 1 by length, entropy and character classes; 0 for short values and placeholders."""
        if self.size < 8 or self.placeholder:
            return 0.0
        n = self.size
        entropy = -sum(c / n * math.log2(c / n) for c in self.counts.values())
        kinds = {("a" <= c <= "z") + 2 * ("A" <= c <= "Z") + 3 * ("0" <= c <= "9") for c in self.counts}
        return min(1.0, 0.25 * min(n / 16, 1) + 0.5 * min(entropy / 4, 1) + 0.25 * min((len(kinds) - 1) / 2, 1))

    def spans(self, seen: set[int]) -> list[tuple[int, int]]:
        """Spans of its literals, of those values that are not in `seen` yet."""
        out, todo = [], [self]
        while todo:
            v = todo.pop()
            if id(v) not in seen:
                seen.add(id(v))
                todo += v.parts
                out += [v.span] if v.span else []
        return out


def target(text: str, at: int, floor: int) -> str:
    """The name written just before position `at`, not before `floor`; empty if there is none."""
    i = at
    while i > floor and text[i - 1] in " \t":
        i -= 1
    while i > floor and text[i - 1] in "\"'`]":
        i -= 1
    j = i
    while j > floor and (text[j - 1].isascii() and (text[j - 1].isalnum() or text[j - 1] in "_$.-")):
        j -= 1
    return text[j:i].strip(".-")


def pairs(text: str) -> list[tuple[str, Value]]:
    """(target name, value) of every assignment whose value is known, constants propagated."""
    known: dict[str, Value] = {}
    out, floor = [], 0
    for op in OPERATOR.finditer(text):
        if op.start() < floor:
            continue
        name = target(text, op.start(), floor)
        if not NAME.fullmatch(name):
            continue
        parts, at, literal = [], op.end(), True
        while m := OPERAND.match(text, at):
            group = m.lastindex
            part = m[group]
            bare = group == 4
            used = part.rstrip(".:") if bare else ""
            if bare and used in known and used != name:
                parts.append(known[used])
            elif bare and (used == name or NAME.fullmatch(part) and not any(c.isdigit() for c in part)):
                literal = False
                break
            else:
                part = part.rstrip(".") if bare else part
                parts.append(Value(part, (m.start(group), m.start(group) + len(part))))
            at = m.end()
            if not (j := JOIN.match(text, at)):
                break
            at = j.end()
        if literal and any(p.size for p in parts):
            known[name] = Value.joined(parts)
            out.append((name, known[name]))
            floor = at
        elif not literal:
            known.pop(name, None)
    if "</" in text:
        out += [(m[1], Value(m[2], m.span(2))) for m in ELEMENT.finditer(text)]
    return out


def pair_spans(text: str, threshold: float = THRESHOLD) -> list[tuple[int, int]]:
    found, seen = set(), set()
    if "=" in text or ":" in text or "</" in text:
        values = pairs(text)  # held, so the numbers of values stay theirs
        for name, value in values:
            sensitive = name_score(name)
            if sensitive >= 0.4 and (quality := value.score()) > 0 and 0.6 * sensitive + 0.4 * quality >= threshold:
                found.update(value.spans(seen))
    return sorted(found)


def inside(base: list[tuple[int, int, int]], spans: list[tuple[int, int]]) -> list[bool]:
    """Which spans lie in a base span; spans of a kind do not overlap."""
    out = [False] * len(spans)
    for k in range(len(KINDS) - 1):
        own = sorted((a, b) for a, b, kind in base if kind == k)
        starts = [a for a, _ in own]
        for i, (a, b) in enumerate(spans):
            at = bisect_right(starts, a) - 1
            out[i] |= at >= 0 and b <= own[at][1]
    return out


def written_spans(spans: list[tuple[int, int, int]], kinds: tuple[str, ...]) -> str:
    return ",".join(f"{kinds[k]}:{a}:{b}" for a, b, k in sorted(spans, key=lambda x: (x[0], x[2], x[1])))


def scan_text(text: str | None) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int]]]:
    """Base spans and added spans; an added span inside a base span is left out."""
    if not text:
        return [], []
    base = base_spans(text)
    found = pair_spans(text)
    added = [(a, b, 3) for (a, b), held in zip(found, inside(base, found), strict=True) if not held]
    return base, added


def scan(docs: DataFrame) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_pair of every document."""

    def run(batches):
        for b in batches:
            rows = []
            for text in b.column(1).to_pylist():
                base, added = scan_text(text)
                n = Counter(k for _, _, k in base)
                rows.append((n[0], n[1], n[2], hashlib.sha256(written_spans(base, KINDS).encode()).hexdigest(), written_spans(base + added, KINDS), len(added)))
            cols = list(zip(*rows, strict=True)) or [()] * 6
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64()), strict=True))], names=["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_pair"])

    small_batches(docs.sparkSession)
    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_pair long")
