"""Secret scans through a trigram index.

Every rule is a regular expression. From its syntax tree follows a Boolean query over trigrams that each match must
contain. The documents of a batch are indexed by the trigrams that any rule asks for (A-Z lower-cased), the postings are
intersected and united as the query says, and the expression runs over the whole texts of the candidates only. A rule
without mandatory trigrams scans every document.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T
from re import _constants as C  # type: ignore[attr-defined]  # the names of the syntax tree's nodes
from re import _parser as P  # type: ignore[attr-defined]

from tidemark.llm.text import plain_names

#: Exact strings that one part of an expression may stand for; beyond that its trigrams are asked for at once.
MOST_STRINGS = 64
#: Bytes indexed at once.
SEGMENT_BYTES = 8_000_000


@dataclass(frozen=True)
class Rule:
    """``least`` characters in ``group`` (0: the whole match); shorter matches are dropped after matching."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 1
    any_case: bool = False

    def compiled(self) -> re.Pattern:
        return re.compile(self.pattern, re.ASCII | (re.IGNORECASE if self.any_case else 0))


BASE_RULES = (
    Rule("assign", r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6, True),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 20),
    # A match of [0-9a-f]+ is a whole run, so runs of 24 and more are the same as all runs with the shorter ones dropped.
    Rule("hex", r"[0-9a-f]{24,}", 0, 24),
)
#: Public formats of keys and tokens.
MORE_RULES = (
    Rule("private_key", r"-----BEGIN [A-Z ]*PRIVATE KEY-----"),
    Rule("git_token", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("chat_token", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("map_key", r"AIza[A-Za-z0-9_-]{35}"),
    Rule("pay_key", r"[rs]k_live_[A-Za-z0-9]{16,}"),
    Rule("web_token", r"eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
)

#: A query: True (no condition), a trigram, ("and", parts) or ("or", parts).
Query = bool | str | tuple


def _both(*parts: Query) -> Query:
    kept = list(dict.fromkeys(p for p in parts if p is not True))
    return True if not kept else kept[0] if len(kept) == 1 else ("and", tuple(kept))


def _either(*parts: Query) -> Query:
    kept = list(dict.fromkeys(parts))
    return True if True in kept else kept[0] if len(kept) == 1 else ("or", tuple(kept))


def _of_strings(strings: set[str]) -> Query:
    return _either(*[_both(*[s[i : i + 3] for i in range(len(s) - 2)]) for s in sorted(strings)])


def _low(char: int) -> str:
    return chr(char).lower() if char < 128 else chr(char)


def _members(node) -> set[str] | None:
    """The characters of a class, if they are few."""
    out: set[str] = set()
    for kind, value in node:
        if kind is C.LITERAL:
            out.add(_low(value))
        elif kind is C.RANGE and value[1] - value[0] < MOST_STRINGS:
            out |= {_low(c) for c in range(value[0], value[1] + 1)}
        else:
            return None
    return out if len(out) <= 8 else None


def _read(nodes) -> tuple[set[str] | None, Query]:
    """The strings that the nodes can match, if they are few, else None; and a query that holds for every match."""
    exact: set[str] | None = {""}
    query: Query = True
    tails: set[str] | None = {""}  # exact strings since the last part that is not exact
    for kind, value in nodes:
        strings, inner = _one(kind, value)
        query = _both(query, inner)
        if strings is not None and len(tails) * len(strings) <= MOST_STRINGS:
            tails = {a + b for a, b in product(tails, strings)}
            exact = {a + b for a, b in product(exact, strings)} if exact is not None else None
        else:
            query = _both(query, _of_strings(tails))
            tails = strings if strings is not None and len(strings) <= MOST_STRINGS else {""}
            exact = None
    return exact, query if exact is not None else _both(query, _of_strings(tails))


def _one(kind, value) -> tuple[set[str] | None, Query]:
    if kind is C.LITERAL:
        return {_low(value)}, True
    if kind is C.IN:
        return _members(value), True
    if kind is C.AT:
        return {""}, True
    if kind is C.SUBPATTERN:
        return _read(value[-1])
    if kind is C.BRANCH:
        read = [_read(branch) for branch in value[1]]
        if all(strings is not None for strings, _ in read):
            return set().union(*[s for s, _ in read]), _either(*[q for _, q in read])
        return None, _either(*[_both(q, _of_strings(s)) if s is not None else q for s, q in read])
    if kind in (C.MAX_REPEAT, C.MIN_REPEAT):
        low, high, body = value
        strings, inner = _read(body)
        if low == 0:
            return (strings | {""} if strings is not None and high == 1 else None), True
        if low == high == 1:
            return strings, inner
        return None, _both(inner, _of_strings(strings)) if strings is not None else inner
    return None, True


def trigram_query(pattern: str) -> Query:
    """What the lower-cased text has to contain for the expression to match; True if nothing follows."""
    strings, query = _read(P.parse(pattern))
    return _both(query, _of_strings(strings)) if strings is not None else query


def trigrams(query: Query) -> set[str]:
    if isinstance(query, str):
        return {query}
    return set() if query is True else set().union(*map(trigrams, query[1]))


class Segment:
    """Postings of the wanted trigrams over a batch of lower-cased UTF-8 texts."""

    def __init__(self, texts: list[bytes], wanted: dict[bytes, int], table: np.ndarray):
        self.n = len(texts)
        # A byte that no text holds parts the texts, so no trigram spans two of them.
        flat = np.frombuffer(b"\xff".join(texts), np.uint8)
        ends = np.cumsum([len(t) + 1 for t in texts])
        found = np.zeros(0, np.int64)
        if len(flat) >= 3:
            codes = (flat[:-2].astype(np.uint32) << 16) | (flat[1:-1].astype(np.uint32) << 8) | flat[2:]
            hit = table[codes]
            at = np.flatnonzero(hit)
            found = np.unique(hit[at].astype(np.int64) * self.n + np.searchsorted(ends, at, side="right"))
        bounds = np.searchsorted(found, np.arange(len(wanted) + 2) * self.n)
        self.postings = {gram: found[bounds[i] : bounds[i + 1]] - i * self.n for gram, i in wanted.items()}

    def candidates(self, query: Query) -> np.ndarray:
        if query is True:
            return np.arange(self.n)
        if isinstance(query, str):
            return self.postings[query.encode()]
        lists = [self.candidates(part) for part in query[1]]
        out = lists[0]
        for other in lists[1:]:
            out = np.intersect1d(out, other, assume_unique=True) if query[0] == "and" else np.union1d(out, other)
        return out


class Scanner:
    def __init__(self, rules: tuple[Rule, ...]):
        self.rules = [(rule, rule.compiled(), trigram_query(rule.pattern)) for rule in rules]
        grams = sorted(set().union(*[trigrams(query) for *_, query in self.rules]))
        self.wanted = {gram.encode(): i + 1 for i, gram in enumerate(grams) if len(gram.encode()) == 3}
        if len(self.wanted) != len(grams):
            raise ValueError("rules with other than ASCII literals are not supported")
        self.table = np.zeros(1 << 24, np.uint16)
        for gram, i in self.wanted.items():
            self.table[int.from_bytes(gram, "big")] = i

    def scan(self, texts: list[str]) -> list[list[tuple[str, int, int]]]:
        """(kind, start, end) of each text in code points, by start and then by rule."""
        segment = Segment([t.encode().lower() for t in texts], self.wanted, self.table)
        out: list[list[tuple[int, int, int]]] = [[] for _ in texts]
        for order, (rule, pattern, query) in enumerate(self.rules):
            for at in segment.candidates(query).tolist():
                for match in pattern.finditer(texts[at]):
                    if match.end(rule.group) - match.start(rule.group) >= rule.least:
                        out[at].append((match.start(), order, match.end()))
        return [[(self.rules[order][0].kind, start, end) for start, order, end in sorted(found)] for found in out]


SPAN = T.ArrayType(
    T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.LongType()), T.StructField("end", T.LongType())])
)


@plain_names
def scan(documents: DataFrame, rules: tuple[Rule, ...] = BASE_RULES + MORE_RULES, text_column: str = "text", spans_column: str = "spans") -> DataFrame:
    """``documents`` with the spans of all rules: array of (kind, start, end), code points, end exclusive.

    Spans of one rule are leftmost and do not overlap; those of different rules may. They are sorted by start, then in the
    order of the rules. A null or empty text has no spans. A column of the name of ``spans_column`` is replaced.
    """
    kept = [c for c in documents.columns if c.lower() != spans_column.lower()]
    at = [c.lower() for c in kept].index(text_column.lower())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(rules)
        kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))
        for batch in batches:
            texts = [t or "" for t in batch.column(at).to_pylist()]
            start = 0
            while start < len(texts):
                end, held = start, 0
                while end < len(texts) and (end == start or held + len(texts[end]) <= SEGMENT_BYTES):
                    held += len(texts[end])
                    end += 1
                spans = [[dict(zip(("kind", "start", "end"), s, strict=True)) for s in found] for found in scanner.scan(texts[start:end])]
                yield pa.RecordBatch.from_arrays([*batch.slice(start, end - start).columns, pa.array(spans, kind)], names=[*kept, spans_column])
                start = end

    rows = documents.select(*[f"`{c}`" for c in kept])
    return rows.mapInArrow(run, T.StructType([*rows.schema.fields, T.StructField(spans_column, SPAN)]))
