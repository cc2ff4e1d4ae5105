"""Secret scan: Boolean trigram queries, derived from each rule's expression, over inverted indexes.

For every rule a query over trigrams is derived from its regular expression, such that every
text with a match satisfies it: what must stand in a match is known as sets of exact texts,
or of possible beginnings and ends, which are joined along a concatenation and united over
alternatives; texts of three bytes or more become trigrams, all of one text (and), for one
text or another (or). Texts are indexed in segments, the batches of a task: for each trigram
that some query asks for, a posting list has the texts of the segment it occurs in. A query
intersects and unites postings; only its candidates are read by the expression itself. A
rule without a mandatory trigram has every text as candidate.

The index folds A-Z to a-z, which a query can only widen, so that rules with and without case
share their trigrams. A segment is as large as its batch, whatever the corpus.
"""

from __future__ import annotations

import hashlib
import itertools
import re
import re._constants as C
import re._parser as parser
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from turnout.llm.common import buffers_of, by_bytes, frugal

#: Texts in a set, and members of a character class, beyond which they count as unknown.
MANY, WIDE = 64, 8


@dataclass(frozen=True)
class Rule:
    """Matches of `pattern`, left to right without overlap, whose `group` has `least` characters or more."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 0


#: The rules whose counts and spans are asked for, in their order.
BASE = (
    Rule("assign", r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 12),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 18),
    Rule("hex", r"[0-9a-f]+", 0, 16),
)

#: Forms of keys and tokens that are known by their prefix or frame.
RULES = BASE + (
    Rule("github", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("google", r"AIza[A-Za-z0-9_-]{35}"),
    Rule("stripe", r"[sr]k_live_[A-Za-z0-9]{16,}"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
    Rule("bearer", r"[Bb]earer\x20+[A-Za-z0-9._~+/-]{20,}=*"),
    Rule("private", r"-----BEGIN (?:[A-Z]+ )*PRIVATE KEY-----"),
    Rule("login", r"[a-z][a-z0-9+.-]*://[^\x00-\x20/:@\"']+:[^\x00-\x20/@\"']+@"),
)


# ------------------------------------------------------------------ queries of expressions
#: A query is None (every text), a trigram, or ("and" | "or", frozenset of queries).
Query = None | bytes | tuple


def both(*queries: Query) -> Query:
    parts = {q for x in queries if x is not None for q in (x[1] if isinstance(x, tuple) and x[0] == "and" else [x])}
    # an alternative that holds anyway says nothing more
    parts = {p for p in parts if not (isinstance(p, tuple) and p[1] & parts)}
    return None if not parts else next(iter(parts)) if len(parts) == 1 else ("and", frozenset(parts))


def either(*queries: Query) -> Query:
    if any(q is None for q in queries):
        return None
    parts = {q for x in queries for q in (x[1] if isinstance(x, tuple) and x[0] == "or" else [x])}
    parts = {p for p in parts if not (isinstance(p, tuple) and p[1] & parts)}
    return next(iter(parts)) if len(parts) == 1 else ("or", frozenset(parts))


def contains(texts: Iterable[bytes]) -> Query:
    """That one of the texts occurs."""
    return either(*(both(*(t[i : i + 3] for i in range(len(t) - 2))) for t in texts))


def trigrams(query: Query) -> set[bytes]:
    if isinstance(query, tuple):
        return set().union(*map(trigrams, query[1]))
    return set() if query is None else {query}


@dataclass(frozen=True)
class Known:
    """What is known of the texts an expression matches: all of them, or how they begin and end, and a query."""

    exact: frozenset[bytes] | None
    begin: frozenset[bytes] = frozenset([b""])
    end: frozenset[bytes] = frozenset([b""])
    query: Query = None

    @property
    def begins(self) -> frozenset[bytes]:
        return self.begin if self.exact is None else self.exact

    @property
    def ends(self) -> frozenset[bytes]:
        return self.end if self.exact is None else self.exact

    def loose(self) -> Known:
        """The same without an exact set."""
        if self.exact is None:
            return self
        return Known(None, few(self.exact), few(self.exact, at_end=True), contains(self.exact))


ANY, EMPTY = Known(None), Known(frozenset([b""]))


def few(texts: Iterable[bytes], at_end: bool = False) -> frozenset[bytes]:
    """Ends (or beginnings) that stand for the texts, shorter while there are too many."""
    kept = frozenset(texts)
    for size in (8, 4, 3, 2, 1, 0):
        if len(kept) <= MANY // 4:
            break
        kept = frozenset(t[len(t) - min(size, len(t)) :] if at_end else t[:size] for t in kept)
    return kept


def joined(a: Known, b: Known) -> Known:
    """One after the other."""
    if a.exact is not None and b.exact is not None and len(a.exact) * len(b.exact) <= MANY:
        return Known(frozenset(x + y for x in a.exact for y in b.exact))
    if len(a.ends) * len(b.begins) <= 4 * MANY:
        across = contains({x + y for x in a.ends for y in b.begins})
    else:
        across = None
    begin = a.begin if a.exact is None else few(x + y for x, y in itertools.product(a.exact, b.begins))
    end = b.end if b.exact is None else few((x + y for x, y in itertools.product(a.ends, b.exact)), at_end=True)
    return Known(None, begin, end, both(a.loose().query, b.loose().query, across))


def united(parts: list[Known]) -> Known:
    """One or the other."""
    if all(p.exact is not None for p in parts):
        exact = frozenset().union(*(p.exact for p in parts))
        if len(exact) <= MANY:
            return Known(exact)
    loose = [p.loose() for p in parts]
    return Known(None, few(t for p in loose for t in p.begin), few((t for p in loose for t in p.end), at_end=True), either(*(p.query for p in loose)))


def repeated(a: Known, least: int, most: int | None) -> Known:
    """`a` as many times in a row; what comes after the third time is not followed."""
    if not least:
        return united([EMPTY, a]) if most == 1 else ANY
    out = a
    for _ in range(min(least, 3) - 1):
        out = joined(out, a)
    return out if least == most and least <= 3 else joined(joined(out, ANY), a)


def folded(code: int) -> bytes:
    return chr(code).encode("utf-8", "surrogatepass").lower()


def _members(items: list, ignoring: bool) -> Known:
    """A character class: its members if they are few."""
    found: set[bytes] = set()
    for kind, value in items:
        if kind is C.LITERAL:
            codes = [value]
        elif kind is C.RANGE and value[1] - value[0] < 2 * WIDE:
            codes = range(value[0], value[1] + 1)
        else:
            return ANY
        found |= {folded(c) for c in codes}
        if ignoring and any(c > 127 or chr(c) in "iIkKsS" for c in codes):
            return ANY  # other letters count as these where case is ignored
    return Known(frozenset(found)) if len(found) <= WIDE else ANY


def known(tree, flags: int) -> Known:
    """Of a parsed expression; whatever is not understood may match anything."""
    out = EMPTY
    ignoring = bool(flags & re.I) and not flags & re.A
    for kind, value in tree:
        if kind is C.LITERAL:
            part = _members([(kind, value)], ignoring)
        elif kind is C.IN:
            part = _members(value, ignoring)
        elif kind is C.BRANCH:
            part = united([known(x, flags) for x in value[1]])
        elif kind is C.SUBPATTERN:
            _, add, drop, x = value
            part = known(x, (flags | add) & ~drop)
        elif kind is C.ATOMIC_GROUP:
            part = known(value, flags)
        elif kind in (C.MAX_REPEAT, C.MIN_REPEAT, C.POSSESSIVE_REPEAT):
            least, most, x = value
            part = repeated(known(x, flags), int(least), None if most is C.MAXREPEAT else int(most))
        elif kind in (C.AT, C.ASSERT, C.ASSERT_NOT):
            continue  # stands for no text
        else:
            part = ANY
        out = joined(out, part)
    return out


def query_of(pattern: str) -> Query:
    """A trigram query that every text with a match of `pattern` satisfies; None if there is no trigram it must have."""
    tree = parser.parse(pattern)
    return known(tree, tree.state.flags).loose().query


# --------------------------------------------------------------------------------- index
@dataclass
class Index:
    """Posting lists of the texts of one segment, for the trigrams asked for."""

    size: int
    postings: dict[bytes, np.ndarray] = field(default_factory=dict)

    def candidates(self, query: Query) -> np.ndarray:
        """Texts, rising, that satisfy a query."""
        if query is None:
            return np.arange(self.size)
        if isinstance(query, bytes):
            return self.postings.get(query, np.zeros(0, np.int64))
        found = None
        # the shortest lists first: what they leave bounds the work of the others
        for part in sorted((self.candidates(q) for q in query[1]), key=len):
            if found is None:
                found = part
            else:
                found = np.intersect1d(found, part, assume_unique=True) if query[0] == "and" else np.union1d(found, part)
        return np.zeros(0, np.int64) if found is None else found


class Trigrams:
    """Finds given trigrams in the bytes of many texts at once, through a code for each byte that occurs in one."""

    def __init__(self, wanted: Iterable[bytes]):
        self.wanted = sorted(set(wanted))
        letters = sorted({c for t in self.wanted for c in t})
        self.code = np.zeros(256, np.int32)
        for i, c in enumerate(letters):
            self.code[c] = i + 1
            if 0x61 <= c <= 0x7A:
                self.code[c - 32] = i + 1
        self.base = len(letters) + 1
        self.number = np.full(self.base**3, -1, np.int16)
        for k, t in enumerate(self.wanted):
            a, b, c = (int(self.code[x]) for x in t)
            self.number[(a * self.base + b) * self.base + c] = k

    def index(self, col: pa.Array, step: int = 1 << 18) -> Index:
        data, offsets = buffers_of(col)
        pairs = [np.zeros(0, np.int64)]
        for lo in range(0, max(0, len(data) - 2), step):
            code = self.code[data[lo : lo + step + 2]]
            number = self.number[(code[:-2] * self.base + code[1:-1]) * self.base + code[2:]]
            at = np.flatnonzero(number >= 0)
            text = np.searchsorted(offsets, at + lo, side="right") - 1
            inside = at + lo + 3 <= offsets[text + 1]
            pairs.append(np.unique(number[at[inside]].astype(np.int64) * len(col) + text[inside]))
        every = np.unique(np.concatenate(pairs))
        which, text = every // max(1, len(col)), every % max(1, len(col))
        cut = np.searchsorted(which, np.arange(len(self.wanted) + 1))
        return Index(len(col), {t: text[cut[k] : cut[k + 1]] for k, t in enumerate(self.wanted) if cut[k] < cut[k + 1]})


class Scanner:
    """Rules with their expressions and queries."""

    def __init__(self, rules: Iterable[Rule] = RULES):
        self.rules = tuple(rules)
        self.expressions = [re.compile(r.pattern) for r in self.rules]
        self.queries = [query_of(r.pattern) for r in self.rules]
        self.trigrams = Trigrams(set().union(*map(trigrams, self.queries)) if self.queries else ())

    def scan(self, col: pa.Array) -> list[list[tuple[int, int, int]]]:
        """(start, place of the rule, end) of the matches in each text, in code points, by start, then rule."""
        out: list[list[tuple[int, int, int]]] = [[] for _ in range(len(col))]
        index = self.trigrams.index(col)
        read: dict[int, str] = {}
        for k, (rule, expression, query) in enumerate(zip(self.rules, self.expressions, self.queries, strict=True)):
            for i in index.candidates(query).tolist():
                text = read.get(i)
                if text is None:
                    text = read[i] = col[i].as_py() or ""
                for m in expression.finditer(text):
                    a, b = m.span(rule.group)
                    if b - a >= rule.least:
                        out[i].append((m.start(), k, m.end()))
        return [sorted(x) for x in out]


def secrets(docs: DataFrame, rules: Iterable[Rule] = RULES) -> DataFrame:
    """doc_id, found (array of kind, start, end) of the whole text: one row for each document.

    Spans are in code points, end exclusive, by start, then in the order of the rules; matches
    of one rule don't overlap, those of different rules may. A null or empty text has none.
    Repeated rows are read alike; further columns are ignored; an empty table gives an empty
    result.
    """
    rules = tuple(rules)
    kinds = [r.kind for r in rules]
    struct = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(rules)
        for b in by_bytes(batches, "text"):
            rows = [[{"kind": kinds[k], "start": a, "end": z} for a, k, z in spans] for spans in scanner.scan(b.column(1))]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(rows, struct)], ["doc_id", "found"])

    return docs.selectExpr("cast(doc_id as long) doc_id", "text").mapInArrow(frugal(run), "doc_id long, found array<struct<kind: string, start: bigint, end: bigint>>")


def digests(docs: DataFrame) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256 (of the BASE rules' spans), spans (of all).

    Spans are written kind:start:end and joined by commas.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(RULES)
        for b in by_bytes(batches, "text"):
            rows = []
            for spans in scanner.scan(b.column(1)):
                said = [(k, f"{RULES[k].kind}:{a}:{z}") for a, k, z in spans]
                n = [sum(k == j for k, _ in said) for j in range(len(BASE))]
                base = ",".join(x for k, x in said if k < len(BASE))
                rows.append((*n, hashlib.sha256(base.encode()).hexdigest(), ",".join(x for _, x in said)))
            cols = list(zip(*rows, strict=True))
            yield pa.RecordBatch.from_arrays(
                [b.column(0), *(pa.array(c, pa.int64()) for c in cols[:3]), *(pa.array(c, pa.string()) for c in cols[3:])],
                ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"],
            )

    return docs.selectExpr("cast(doc_id as long) doc_id", "text").mapInArrow(
        frugal(run), "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string"
    )
