"""Search within document shards: every task answers all requests over its own documents.

A shard is a bounded set of documents: its postings and what ranking needs of
its documents and programs are brought together once, requests are dealt to the
shards, and only the best rows of each request leave it. So no exchange carries
a row for each matching document. In a shard, documents lie in blocks, those
with the largest weights first, and each term knows its largest weight in each
block: a block is passed over when its terms together cannot beat the last row
that a request has found, and in the others only documents that reach it are
looked at further.

All documents of a source are in one shard, so a source's figures are whole
there; a source too large for that is sliced over shards, and its rows always
leave the shard, to be united behind.

The expanded leg needs no common term, so blocks seldom help there. Terms that
many documents have are rows over all documents of the shard: added up in whole
steps, they and the postings of the other terms give the most that each
document can rank. Only documents that reach the last row which the best of
them are known to fill are ranked exactly.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cached_property, partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Documents of a shard, unless the session sets ``quarrylight.index.shard_docs``, and of its first block; each further one ends at nine times as many.
SHARD_DOCS, BLOCK_DOCS = 65_536, 512
#: Filter and intent combinations whose programs a shard remembers.
HELD_CLASSES = 64
EXACT, EXPANDED, SOURCE, PROXIMITY = "exact", "expanded", "source", "proximity"
#: Terms further apart do not count together. What each distance leaves of one, as a logarithm.
FAR_APART = 100
LEFT = np.log1p(-0.1 * np.sqrt(1 / (1.005 + 0.05 * np.exp(np.arange(FAR_APART + 1) / 1.5 - 2))))
#: Documents whose positions are put in order at once, pairs of positions that are compared at once, and rows of proximity that a shard remembers by their terms.
COMPARED, PAIRS, HELD_ROWS = 4096, 1 << 18, 1 << 21
FOUND = (
    "query_id long, leg string, program_id long, doc_id long, source_id long, rank_millionths long, intent_score long, "
    "confidence double, page_quality long, newest_crawl long, latest_document_at long, proximity double"
)
_FOUND = [("query_id", pa.int64()), ("leg", pa.string())] + [(n, pa.int64()) for n in ("program_id", "doc_id", "source_id", "rank_millionths", "intent_score")] + [
    ("confidence", pa.float64()), ("page_quality", pa.int64()), ("newest_crawl", pa.int64()), ("latest_document_at", pa.int64()), ("proximity", pa.float64())
]

# Harmonic-square sums 1 + 1/4 + ... + 1/n^2, the damping of repeated terms.
MAX_TF = 255
_DAMPED = np.concatenate([[0.0], np.cumsum(1.0 / np.arange(1, MAX_TF + 1, dtype=float) ** 2)])
WEIGHTS = _DAMPED * 0.1 / 1.64493406685
#: Weights in whole steps, never rounded down but for what a float leaves: 4 for a term that occurs once, 7 at most, so that most sums fit in a byte.
STEP = WEIGHTS[1] / 4
STEPS = np.ceil(WEIGHTS / STEP - 1e-9).astype(np.uint8)
#: Terms in more than one of so many documents of a shard have a row there, the most frequent ones, so many at most.
ROW_SHARE, ROWS = 32, 1024
#: Postings that are weighed at once while a shard is made.
AT_ONCE = 1 << 20
#: Documents, rich ones first, among which the first guess of a request's best is made.
PROBED = 4096
#: A point of intent counts more than any rank. No rank is above one.
LEAD, TOP_RANK = 2_000_000, 1_000_000
_NONE = np.iinfo(np.int64).min
FIELDS = ("days_per_week", "specialization", "experience_level", "progression_type", "split_type")
INTENTS = (("days_per_week", "intent_days", 3), ("experience_level", "intent_experience", 3), ("split_type", "intent_split", 2))


def millionths(x: np.ndarray) -> np.ndarray:
    """Rounded to six digits, half up, as whole numbers: ties are ties in every partitioning."""
    return np.floor(x * 1e6 + 0.5).astype(np.int64)


class Term:
    """Postings of a lexeme in a shard: places of documents, weights, and per block its first posting and largest weight."""

    def __init__(self, places: np.ndarray, tf: np.ndarray, positions: pa.ListArray | list | None, edges: list[int]):
        if not (positions is not None and len(positions)) and ROW_SHARE * len(places) > edges[-1]:
            # A frequent term is put in order by marking its documents.
            marked = np.zeros(edges[-1], np.uint8)
            marked[places] = np.minimum(tf, MAX_TF)
            places = np.flatnonzero(marked)
            order, tf = slice(None), marked[places]
        else:
            order = np.argsort(places, kind="stable")
        self.held, self.order = positions, order
        self.edges, self.row, self.tf = edges, -1, np.minimum(tf[order], MAX_TF).astype(np.uint8)
        self.places, self.weights = places[order].astype(np.int64), WEIGHTS[self.tf]

    @cached_property
    def positions(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(first, number, all): where each place's positions lie in one array."""
        held = self.held if isinstance(self.held, pa.Array) else pa.array(self.held, pa.list_(pa.int32()))
        sizes, flat = held.value_lengths().to_numpy().astype(np.int64), held.flatten().to_numpy()
        first = np.cumsum(sizes) - sizes
        return first[self.order], sizes[self.order], flat

    def positions_at(self, places: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(row of ``places``, position) of the term in documents that have it."""
        first, sizes, flat = self.positions
        own = self.places.searchsorted(places)
        n = sizes[own]
        at = np.repeat(first[own] - np.cumsum(n) + n, n) + np.arange(n.sum())
        return np.repeat(np.arange(len(places)), n), flat[at].astype(np.int64)

    @cached_property
    def starts(self) -> list[int]:
        return np.searchsorted(self.places, self.edges).tolist()

    @cached_property
    def most(self) -> list[float]:
        return [float(self.weights[a:b].max()) if b > a else 0.0 for a, b in zip(self.starts, self.starts[1:], strict=False)]

    def in_block(self, b: int) -> tuple[np.ndarray, np.ndarray]:
        part = slice(self.starts[b], self.starts[b + 1])
        return self.places[part], self.weights[part]


def summed(terms: list[Term], b: int, low: int, size: int) -> np.ndarray:
    """The weights of the terms, summed for each document of a block."""
    parts = [t.in_block(b) for t in terms]
    places = np.concatenate([p for p, _ in parts])
    places -= low
    return np.bincount(places, np.concatenate([w for _, w in parts]), size)


def common(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """(places, summed weights) of the documents in all lists, from the shortest list on."""
    parts = sorted(parts, key=lambda p: len(p[0]))
    places, total = parts[0][0], parts[0][1].copy()
    for other, weights in parts[1:]:
        if not len(places):
            break
        at = np.minimum(np.searchsorted(other, places), max(len(other) - 1, 0))
        here = other[at] == places if len(other) else np.zeros(len(places), bool)
        places, total = places[here], total[here] + weights[at[here]]
    return places, total


def nearness(terms: list[Term], places: np.ndarray) -> np.ndarray:
    """For documents that have all of the terms, one minus the product of what the near places of different terms leave."""
    bits = (len(terms) - 1).bit_length()
    # A document's row, a position of 32 bits and the term are one number; many terms leave less room for rows.
    room = 1 << (31 - bits)
    if len(places) > room:
        return np.concatenate([nearness(terms, places[low : low + room]) for low in range(0, len(places), room)])
    parts = []
    for number, term in enumerate(terms):
        row, at = term.positions_at(places)
        parts.append((row << 32 | at) << bits | number)
    at = np.sort(np.concatenate(parts))
    term, at, out = at & ((1 << bits) - 1), at >> bits, np.zeros(len(places))
    # Positions of other documents are too far.
    ends = np.cumsum(at.searchsorted(at + FAR_APART, "right") - np.arange(1, len(at) + 1))
    low, done = 0, 0
    while low < len(at):
        high = max(low + 1, int(ends.searchsorted(done + PAIRS, "right")))
        n = np.diff(ends[low:high], prepend=done)
        one = np.repeat(np.arange(low, high), n)
        two = one + 1 + np.arange(len(one)) - np.repeat(np.cumsum(n) - n, n)
        other = term[one] != term[two]
        one, two = one[other], two[other]
        out += np.bincount(at[one] >> 32, LEFT[at[two] - at[one]], len(places))
        low, done = high, int(ends[high - 1])
    return -np.expm1(out)


class Terms(dict):
    """The terms of a shard by lexeme, each put in order when it is first asked for; all postings lie in one array."""

    def __init__(self, postings: list[tuple], ids: np.ndarray):
        super().__init__()
        self.number = {p[0]: i for i, p in enumerate(postings)}
        self.where = [p[3] for p in postings]
        self.starts = np.concatenate([[0], np.cumsum([len(p[1]) for p in postings], dtype=np.int64)]).astype(np.int64)
        self.places, self.tf = np.empty(self.starts[-1], np.int32), np.empty(self.starts[-1], np.uint8)
        self.rich, self.edges = np.zeros(len(ids)), [0]
        cuts = np.searchsorted(self.starts, np.arange(0, self.starts[-1] + AT_ONCE, AT_ONCE))
        cuts = np.unique(np.minimum(cuts, len(postings))).tolist()
        for low, high in zip(cuts, cuts[1:], strict=False):
            part = slice(self.starts[low], self.starts[high])
            at = np.searchsorted(ids, np.concatenate([p[1] for p in postings[low:high]]))
            self.places[part], self.tf[part] = at, np.minimum(np.concatenate([p[2] for p in postings[low:high]]), MAX_TF)
            self.rich += np.bincount(at, WEIGHTS[self.tf[part]], len(ids))

    def moved(self, place: np.ndarray, edges: list[int]) -> None:
        """Documents lie at new places."""
        self.edges = edges
        for low in range(0, len(self.places), AT_ONCE):
            self.places[low : low + AT_ONCE] = place[self.places[low : low + AT_ONCE]]

    def __missing__(self, lexeme: str) -> Term:
        i = self.number[lexeme]
        part = slice(self.starts[i], self.starts[i + 1])
        self[lexeme] = term = Term(self.places[part], self.tf[part], self.where[i], self.edges)
        return term

    def all_of(self, lexemes: list[str]) -> list[Term]:
        """The terms of the lexemes; none where the shard lacks one."""
        for x in lexemes:
            if x not in self.number:
                return []
        return [self[x] for x in lexemes]

    def some_of(self, lexemes: list[str]) -> list[Term]:
        """The terms of those lexemes that the shard has."""
        return [self[x] for x in lexemes if x in self.number]

    def frequent(self) -> list[Term]:
        """The terms that have a row, the most frequent ones first."""
        sizes = np.diff(self.starts)
        often = np.flatnonzero(ROW_SHARE * sizes > self.edges[-1])
        often = often[np.argsort(-sizes[often], kind="stable")][:ROWS]
        lexemes = list(self.number)
        return [self[lexemes[i]] for i in often.tolist()]


class Shard:
    """The documents, programs and postings of one shard. Documents lie in the order of their summed weights, largest first."""

    def __init__(self, docs: list[dict], postings: list[tuple], block: int):
        docs = sorted(docs, key=lambda d: d["doc_id"])
        ids = np.array([d["doc_id"] for d in docs], np.int64)
        self.terms = Terms(postings, ids)
        order = np.argsort(-self.terms.rich, kind="stable")
        docs, self.ids, place = [docs[i] for i in order.tolist()], ids[order], np.empty(len(docs), np.int64)
        place[order] = np.arange(len(docs))
        edges = [0]
        while edges[-1] < max(1, len(docs)):
            edges.append(min(9 * edges[-1] or block, max(1, len(docs))))
        self.edges, self.blocks = edges, len(edges) - 1
        self.created = np.array([_NONE if d["created"] is None else d["created"] for d in docs], np.int64)
        sources = {d["source_id"]: d for d in docs}
        self.source_ids = np.array(sorted(sources), np.int64)
        self.source_of = np.searchsorted(self.source_ids, np.array([d["source_id"] for d in docs], np.int64))
        own = [sources[s] for s in self.source_ids.tolist()]
        self.quality = np.array([d["page_quality"] for d in own], np.int64)
        self.sliced = np.array([d["sliced"] for d in own], bool)
        self.codes: dict[str, dict] = {f: {} for f in (*FIELDS, "domain")}
        self.domain = self._coded("domain", [d["source_domain"] for d in own])
        programs = [(at, p) for at, d in enumerate(docs) for p in d["programs"] or ()]
        self.program_doc = np.array([at for at, _ in programs], np.int64)
        self.program_domain = self.domain[self.source_of[self.program_doc]]
        self.program_ids = np.array([p["program_id"] for _, p in programs], np.int64)
        self.confidence = np.array([np.nan if p["confidence"] is None else p["confidence"] for _, p in programs], float)
        self.newest = np.array([_NONE if p["newest"] is None else p["newest"] for _, p in programs], np.int64)
        self.fields = {f: self._coded(f, [p[f"p_{f}"] for _, p in programs]) for f in FIELDS}
        self.terms.moved(place, self.edges)
        self.held: dict[tuple, list[Class]] = {}
        self.near: dict[tuple, tuple[np.ndarray, np.ndarray]] = {}
        self.near_rows = 0

    def _coded(self, field: str, values: list) -> np.ndarray:
        known = self.codes[field]
        return np.array([-1 if v is None else known.setdefault(v, len(known)) for v in values], np.int64)

    def _code(self, field: str, value) -> int:
        """A number that no program has, where no program has the value."""
        return self.codes[field].get(value, -2)

    # -- matching -------------------------------------------------------------
    def bounds(self, terms: list[Term], count: int, every: bool) -> np.ndarray:
        """The most a document of each block can rank; below zero where a needed term is not in the block."""
        if not terms:
            return np.full(self.blocks, -1, np.int64)
        most = np.array([t.most for t in terms])
        # One millionth more, as sums may round either way.
        out = millionths(most.sum(axis=0) / count) + 1
        return np.where((most > 0).all(axis=0) if every else (most > 0).any(axis=0), out, -1)

    def exact(self, terms: list[Term], b: int) -> tuple[np.ndarray, np.ndarray]:
        """(places, ranks) of the documents of a block with all terms."""
        places, total = common([t.in_block(b) for t in terms])
        return places, millionths(total / len(terms))

    def all_exact(self, terms: list[Term]) -> tuple[np.ndarray, np.ndarray]:
        """(places, ranks) of the documents with all terms: the two rarest decide first, longer lists are only looked into."""
        terms = sorted(terms, key=lambda t: len(t.places))
        places, total = terms[0].places, terms[0].weights
        for term in terms[1:]:
            at = term.places.searchsorted(places)
            # Past the end is no place of the term.
            here = (term.places.take(at, mode="clip") == places).nonzero()[0]
            if not len(here):
                return np.zeros(0, np.int64), np.zeros(0, np.int64)
            places, total = places[here], total[here] + term.weights[at[here]]
        return places, millionths(total / len(terms))

    def expanded(self, terms: list[Term], groups: list[list[Term]], count: int, b: int) -> tuple[np.ndarray, np.ndarray]:
        """(places, ranks) of the documents of a block with all terms of any group."""
        low, size = self.edges[b], self.edges[b + 1] - self.edges[b]
        total, fits = summed(terms, b, low, size), np.zeros(size, bool)
        alone = [g[0].in_block(b)[0] for g in groups if len(g) == 1]
        if alone:
            fits[np.concatenate(alone) - low] = True
        for group in groups:
            if len(group) > 1:
                fits[self.exact(group, b)[0] - low] = True
        places = np.flatnonzero(fits)
        return places + low, millionths(total[places] / count)

    @cached_property
    def rows(self) -> tuple[np.ndarray, np.ndarray]:
        """How often each document has the terms that have a row, and the steps of their weights."""
        often = self.terms.frequent()
        times, steps = np.zeros((len(often), len(self.ids)), np.uint8), np.zeros((len(often), len(self.ids)), np.uint8)
        for row, term in enumerate(often):
            term.row = row
            times[row, term.places] = term.tf
            steps[row] = STEPS[times[row]]
        return times, steps

    # -- selection ------------------------------------------------------------
    def classes(self, ask: dict, leg: str) -> list[Class]:
        """The programs that pass the filters, by what their intents count, highest first. The exact leg has no intents."""
        wishes = tuple(ask[wish] if leg == EXPANDED else None for _, wish, _ in INTENTS)
        key = (*(ask[f] for f in (*FIELDS, "domain")), *wishes)
        if key not in self.held:
            if len(self.held) >= HELD_CLASSES:
                self.held.clear()
            good = np.ones(len(self.program_ids), bool)
            for f in FIELDS:
                if ask[f] is not None:
                    good &= self.fields[f] == self._code(f, ask[f])
            if ask["domain"] is not None:
                good &= self.program_domain == self._code("domain", ask["domain"])
            kept = np.flatnonzero(good)
            points = np.zeros(len(kept), np.int64)
            for (field, _, worth), wish in zip(INTENTS, wishes, strict=True):
                if wish is not None:
                    points += worth * (self.fields[field][kept] == self._code(field, wish))
            self.held[key] = [Class(self, int(p), kept[points == p]) for p in np.flatnonzero(np.bincount(points))[::-1]]
        return self.held[key]

    def best(self, leg: str, rows: tuple[np.ndarray, ...], limit: int) -> tuple[np.ndarray, ...]:
        """The first ``limit`` of (program, rank, intent) in the order of the leg."""
        programs, ranks, intents = rows
        if len(programs) > 4 * limit:
            # What lies below the last of the first rows in the leading keys needs no sorting.
            lead = intents * LEAD + ranks
            kept = lead >= np.partition(lead, -limit)[-limit]
            programs, ranks, intents = programs[kept], ranks[kept], intents[kept]
        confidence = np.where(np.isnan(self.confidence[programs]), -np.inf, self.confidence[programs])
        if leg == EXACT:
            quality = self.quality[self.source_of[self.program_doc[programs]]]
            # The earliest number stands for no time; its negative does not exist, so the order is turned by complement.
            keys = (self.program_ids[programs], ~self.newest[programs], -confidence, -quality, -ranks)
        else:
            keys = (self.program_ids[programs], -confidence, -ranks, -intents)
        first = np.lexsort(keys)[:limit]
        return programs[first], ranks[first], intents[first]

    def search(self, ask: dict, leg: str, limit: int) -> tuple[np.ndarray, ...]:
        """The best programs (program, rank, intent) of a leg; what can't reach them is passed over."""
        nothing = tuple(np.zeros(0, np.int64) for _ in range(3))
        lexemes = ask["exact"] if leg == EXACT else sorted({x for g in ask["groups"] for x in g})
        terms = self.terms.all_of(lexemes) if leg == EXACT else self.terms.some_of(lexemes)
        if not terms:
            return nothing
        if leg == EXACT and min([len(t.places) for t in terms]) <= self.edges[1]:
            places, ranks = self.all_exact(terms)
            found = [c.programs(places, ranks) for c in self.classes(ask, leg)] if len(places) else []
            return self.best(leg, (*found[0], np.zeros(len(found[0][0]), np.int64)), limit) if found else nothing
        out = nothing
        if leg == EXPANDED:
            sums = Sums(self, terms, [found for found in map(self.terms.all_of, ask["groups"]) if found], len(lexemes))
            # Classes of higher intent come first as a whole; in each of them the rank counts.
            # Rows below the floor can't be among the best of all shards.
            floor = ask.get("floor") or 0
            for own in self.classes(ask, leg):
                need, least = limit - len(out[0]), max(0, floor - own.points * LEAD)
                if least > TOP_RANK:
                    break
                places, ranks = sums.reaching(own, need, least)
                found, ranks = own.programs(places[ranks >= least], ranks[ranks >= least])
                rows = self.best(leg, (found, ranks, np.full(len(found), own.points)), need)
                out = tuple(np.concatenate(x) for x in zip(out, rows, strict=True))
                if len(out[0]) == limit:
                    break
            return out
        bounds = self.bounds(terms, len(lexemes), True)
        for own in self.classes(ask, leg):
            for b in np.argsort(-bounds, kind="stable").tolist():
                if bounds[b] < max(int(out[1][-1]) if len(out[0]) == limit else -1, 0):
                    break
                if own.starts[b] == own.starts[b + 1]:
                    continue
                found, ranks = own.programs(*self.exact(terms, b), b)
                if len(found):
                    more = (found, ranks, np.full(len(found), own.points))
                    out = self.best(leg, tuple(np.concatenate(x) for x in zip(out, more, strict=True)), limit)
        return out

    def matches(self, ask: dict, leg: str) -> tuple[np.ndarray, np.ndarray]:
        """(places, ranks) of all documents that a leg matches."""
        lexemes = ask["exact"] if leg == EXACT else sorted({x for g in ask["groups"] for x in g})
        terms = self.terms.all_of(lexemes) if leg == EXACT else self.terms.some_of(lexemes)
        if not terms:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        if leg == EXACT:
            return self.all_exact(terms)
        groups = [found for found in map(self.terms.all_of, ask["groups"]) if found]
        parts = [self.expanded(terms, groups, len(lexemes), b) for b in np.flatnonzero(self.bounds(terms, len(lexemes), False) >= 0)]
        return tuple(np.concatenate([p[k] for p in parts]) if parts else np.zeros(0, np.int64) for k in (0, 1))

    def proximity(self, ask: dict) -> tuple[np.ndarray, np.ndarray]:
        """(places, ranks) of the documents with all terms, by the distances between their positions; alike requests are answered once."""
        key = tuple(sorted(ask["exact"]))
        if key not in self.near:
            places, ranks = self.matches(ask, EXACT)
            terms = [self.terms[x] for x in key] if len(places) else []
            if len(terms) < 2:
                return places, ranks / 1e6
            parts = [nearness(terms, places[low : low + COMPARED]) for low in range(0, len(places), COMPARED)]
            self.near_rows += len(places)
            if self.near_rows > HELD_ROWS:
                self.near.clear()
                self.near_rows = len(places)
            self.near[key] = places, np.concatenate(parts)
        return self.near[key]

    def sources(self, ask: dict, limit: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(source, rank, time of its newest match): the best ``limit``, and every sliced source that matches."""
        places, ranks = self.matches(ask, EXACT)
        if not len(places):
            return places, places, places
        own, at = np.unique(self.source_of[places], return_inverse=True)
        rank, latest = np.full(len(own), _NONE), np.full(len(own), _NONE)
        np.maximum.at(rank, at, ranks)
        np.maximum.at(latest, at, self.created[places])
        if ask["domain"] is not None:
            good = self.domain[own] == self._code("domain", ask["domain"])
            own, rank, latest = own[good], rank[good], latest[good]
        order = np.lexsort((self.source_ids[own], ~latest, -self.quality[own], -rank))
        kept = np.concatenate([order[:limit], order[limit:][self.sliced[own[order[limit:]]]]])
        return own[kept], rank[kept], latest[kept]


class Sums:
    """The summed weights of a request's terms in the documents of a shard: their upper bounds at once, themselves on demand."""

    def __init__(self, shard: Shard, terms: list[Term], groups: list[list[Term]], count: int):
        self.groups, self.count, self.size = groups, count, len(shard.ids)
        self.times, self.steps = shard.rows
        self.often, rare = np.array([t.row for t in terms if t.row >= 0], np.intp), [t for t in terms if t.row < 0]
        # Each term of its own is enough: then every document with any term fits.
        self.any = len({id(g[0]) for g in groups if len(g) == 1}) == len(terms)
        self.rare = np.concatenate([t.places for t in rare]) if rare else None
        self.others = np.bincount(self.rare, np.concatenate([t.weights for t in rare]), self.size) if rare else None

    @cached_property
    def most(self) -> np.ndarray:
        """The most that each document can rank, in steps."""
        # The steps of the terms that have rows, and of the others together, rounded up once.
        rare = None if self.rare is None else np.ceil(self.others[self.rare] * (1 / STEP) - 1e-9)
        top = int(STEPS[MAX_TF]) * len(self.often) + (0 if rare is None else int(rare.max()))
        most = np.zeros(self.size, np.min_scalar_type(top))
        if rare is not None:
            # A document that several terms have is written as often, each time with the same sum.
            most[self.rare] = rare
        for row in self.often.tolist():
            np.add(most, self.steps[row], out=most)
        return most

    def ranked(self, places: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(places, ranks) of those of the documents that have all terms of any group."""
        total = np.zeros(len(places)) if self.others is None else self.others[places]
        if len(self.often):
            total = total + WEIGHTS[self.times[self.often[:, None], places]].sum(axis=0)
        fits = total > 0
        if not self.any:
            near, fits = np.flatnonzero(fits), np.zeros(len(places), bool)
            # Single frequent terms settle most documents.
            for group in sorted(self.groups, key=lambda g: (len(g), -len(g[0].places))):
                open_ = near[~fits[near]]
                if not len(open_):
                    break
                here, sought = np.ones(len(open_), bool), places[open_]
                for term in group:
                    if term.row >= 0:
                        here &= self.times[term.row, sought] > 0
                    else:
                        here &= term.places[np.minimum(term.places.searchsorted(sought), len(term.places) - 1)] == sought
                fits[open_[here]] = True
        return places[fits], millionths(total[fits] / self.count)

    def reaching(self, own: Class, need: int, least: int = 0) -> tuple[np.ndarray, np.ndarray]:
        """(places, ranks) of the documents that may be among the best ``need`` of a class and rank ``least``, all of whose documents have at least one program."""
        if len(own.places) <= 4 * need:
            return self.ranked(own.places)
        # One millionth less, as sums may round either way.
        near, low = own.places[:PROBED], max(1, int((least - 1) * self.count / 1e6 / STEP))
        if least:
            few = own.reaching(self.most, low)
            if len(few) <= 8 * need:
                return self.ranked(few)
        for whole in (len(own.places) <= PROBED, True):
            bound = self.most[near]
            if len(near) > 4 * need:
                # The most promising ones are ranked first; so many as are needed rank no lower than the last of them.
                ranks = self.ranked(near[np.argpartition(bound, -2 * need)[-2 * need :]])[1]
                if len(ranks) >= need:
                    least = int(np.partition(ranks, -need)[-need])
                    low = max(low, int((least - 1) * self.count / 1e6 / STEP))
            if whole:
                return self.ranked(near[bound >= low])
            near = own.reaching(self.most, low)


class Class:
    """Programs of a shard that pass the same filters and count the same intents, by document."""

    def __init__(self, shard: Shard, points: int, programs: np.ndarray):
        self.points, self.own, self.docs = points, programs, shard.program_doc[programs]
        self.starts = np.searchsorted(self.docs, shard.edges).tolist()
        # The documents that have any.
        self.places = self.docs[np.diff(self.docs, prepend=-1) > 0]
        self.has = None

    def reaching(self, bound: np.ndarray, low: int) -> np.ndarray:
        """The class's documents at ``low`` or above, by the bounds of all documents of the shard."""
        if 8 * len(self.places) < len(bound):
            return self.places[bound[self.places] >= low]
        if self.has is None:
            self.has = np.zeros(len(bound), bool)
            self.has[self.places] = True
        return np.flatnonzero((bound >= low) & self.has)

    def programs(self, places: np.ndarray, ranks: np.ndarray, b: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """(program, its document's rank) of the matched documents, of one block or all."""
        part = slice(None) if b is None else slice(self.starts[b], self.starts[b + 1])
        own, docs = self.own[part], self.docs[part]
        if not len(own) or not len(places):
            return own[:0], ranks[:0]
        if len(places) < len(docs) // 8:
            # Few documents: their programs lie together.
            low, high = np.searchsorted(docs, places, "left"), np.searchsorted(docs, places, "right")
            sizes = high - low
            at = np.repeat(low - np.cumsum(sizes) + sizes, sizes) + np.arange(sizes.sum())
            return own[at], np.repeat(ranks, sizes)
        at = np.minimum(np.searchsorted(places, docs), len(places) - 1)
        good = places[at] == docs
        return own[good], ranks[at[good]]


def _lists(column: pa.Array) -> list[np.ndarray]:
    # A copy of its own, as the batch's memory goes back to the reader.
    flat, ends = column.values.to_numpy(zero_copy_only=False).copy(), column.offsets.to_numpy()
    return [flat[a:b] for a, b in zip(ends, ends[1:], strict=False)]


def _positions(column: pa.ListArray) -> list[pa.ListArray]:
    """The positions of each term's postings."""
    lists, ends = pa.concat_arrays([column.flatten()]), column.offsets.to_numpy()
    # One number for each position; a copy of its own, as above.
    lists = pa.ListArray.from_arrays(pa.array(lists.offsets.to_numpy().copy()), pa.array(lists.values.to_numpy().copy()))
    ends = (ends - ends[0]).tolist()
    return [lists.slice(a, b - a) for a, b in zip(ends, ends[1:], strict=False)]


def _words(column: pa.ListArray) -> list[list[str]]:
    """The lists of a column of words; each distinct word is made once."""
    found, ends = column.flatten().dictionary_encode(), column.offsets.to_numpy()
    words = np.array(found.dictionary.to_pylist(), object)[found.indices.to_numpy()].tolist() if len(found) else []
    ends = (ends - ends[0]).tolist()
    return [words[a:b] for a, b in zip(ends, ends[1:], strict=False)]


def _records(column: pa.StructArray, **made: list) -> list[dict]:
    """The rows of a column of records, by field; ``made`` has fields that are made already. No record is null."""
    values = {f.name: column.field(f.name).to_pylist() for f in column.type if f.name not in made} | made
    return [dict(zip(values, row, strict=True)) for row in zip(*values.values(), strict=True)]


def _requests(column: pa.StructArray) -> list[dict]:
    """The requests of a batch; words are made by column, as most of a request is words. No list of them is null."""
    column = pa.concat_arrays([column])
    groups = column.field("groups")
    single, ends = _words(groups.flatten()), groups.offsets.to_numpy()
    ends = (ends - ends[0]).tolist()
    return _records(column, exact=_words(column.field("exact")), groups=[single[a:b] for a, b in zip(ends, ends[1:], strict=False)])


def _documents(column: pa.StructArray) -> list[dict]:
    """The documents of a batch with their programs; none where there is no list of them."""
    column = pa.concat_arrays([column])
    programs = column.field("programs")
    every, ends = _records(programs.flatten()), np.cumsum(programs.value_lengths().fill_null(0).to_numpy()).tolist()
    return _records(column, programs=[every[a:b] for a, b in zip([0, *ends], ends, strict=False)])


def _answered(batches: Iterator[pa.RecordBatch], exact: int, expanded: int, sources: int, legs: tuple[str, ...], proximity: bool, block: int) -> Iterator[pa.RecordBatch]:
    """Rows come by shard: its documents, then its postings, then the requests."""
    at, docs, postings, shard, rows = None, [], [], None, []

    def taken() -> Iterator[pa.RecordBatch]:
        """The rows kept so far, one batch for each kind of them; columns are made at once for all requests."""
        for kind in (EXACT, EXPANDED, SOURCE, PROXIMITY, "match"):
            own = [r for r in rows if r[0] == kind]
            if not own:
                continue
            sizes = [len(r[3]) for r in own]
            found, ranks = np.concatenate([r[3] for r in own]).astype(np.int64), np.concatenate([r[4] for r in own])
            columns = {"query_id": np.repeat(np.array([r[1] for r in own], np.int64), sizes), "leg": np.repeat(np.array([r[2] for r in own], object), sizes)}
            if kind in (EXACT, EXPANDED):
                places = shard.program_doc[found]
                sources = shard.source_of[places]
                columns |= {
                    "program_id": shard.program_ids[found], "doc_id": shard.ids[places], "source_id": shard.source_ids[sources], "rank_millionths": ranks,
                    "intent_score": np.concatenate([r[5] for r in own]), "page_quality": shard.quality[sources],
                    "confidence": pa.array(shard.confidence[found], mask=np.isnan(shard.confidence[found])), "newest_crawl": pa.array(shard.newest[found], mask=shard.newest[found] == _NONE),
                }
            elif kind == SOURCE:
                latest = np.concatenate([r[5] for r in own])
                columns |= {
                    "source_id": shard.source_ids[found], "rank_millionths": ranks, "page_quality": shard.quality[found], "latest_document_at": pa.array(latest, mask=latest == _NONE),
                }
            else:
                columns |= {"doc_id": shard.ids[found], "proximity" if kind == PROXIMITY else "rank_millionths": ranks}
            yield pa.record_batch([pa.array(columns[n], t) if n in columns else pa.nulls(len(found), t) for n, t in _FOUND], names=[n for n, _ in _FOUND])
        rows.clear()

    for batch in batches:
        kinds, numbers = batch.column("kind").to_pylist(), batch.column("shard").to_pylist()
        edges = [0, *[i for i in range(1, len(kinds)) if (kinds[i], numbers[i]) != (kinds[i - 1], numbers[i - 1])], len(kinds)]
        for low, high in zip(edges, edges[1:], strict=False):
            if low == high:
                continue
            if numbers[low] != at:
                at, docs, postings, shard = numbers[low], [], [], None
            part = batch.slice(low, high - low)
            if kinds[low] == 0:
                docs += _documents(part.column("doc"))
                continue
            if kinds[low] == 1:
                post = part.column("post").combine_chunks() if isinstance(part.column("post"), pa.ChunkedArray) else part.column("post")
                parts = [_lists(pa.concat_arrays([post.field(f)])) if f != "lexeme" else post.field(f).to_pylist() for f in ("lexeme", "docs", "tfs")]
                where = _positions(post.field("positions")) if proximity else [None] * len(post)
                postings += zip(*parts, where, strict=True)
                continue
            shard = shard or Shard(docs, postings, block)
            docs, postings = [], []
            held = 0
            for ask in _requests(part.column("ask")):
                query = ask["query_id"]
                rows += [("match", query, leg, *shard.matches(ask, leg)) for leg in legs]
                rows += [(leg, query, leg, *shard.search(ask, leg, limit)) for leg, limit in ((EXACT, exact), (EXPANDED, expanded)) if limit]
                if sources:
                    rows.append((SOURCE, query, SOURCE, *shard.sources(ask, sources)))
                if proximity:
                    rows.append((PROXIMITY, query, PROXIMITY, *shard.proximity(ask)))
                held += sum(len(r[3]) for r in rows[-2:])
                if held > 50_000:
                    yield from taken()
                    held = 0
            # Before another shard takes its place.
            yield from taken()


def place_documents(keys: DataFrame, count: int, size: int) -> DataFrame:
    """``keys`` (id, source_id, ...) with ``shard`` and ``sliced``: sources stay whole unless they hold more than a quarter of a shard."""
    shards = max(1, -(-count // size))
    per = keys.groupBy("source_id").agg(F.ceil(F.count("*") / F.lit(max(1, size // 4))).alias("slices"))
    cut = F.when(F.col("slices") > 1, F.pmod(F.xxhash64("id"), F.col("slices"))).otherwise(F.lit(0))
    return keys.join(per, "source_id").withColumn("shard", F.pmod(F.xxhash64("source_id", cut.cast("long")), F.lit(shards)).cast("int")).withColumn(
        "sliced", F.col("slices") > 1
    ).drop("slices")


def _dealt(batches: Iterator[pa.RecordBatch], shares: int) -> Iterator[pa.RecordBatch]:
    """(shard, post): each row's postings dealt by document to the ``shares`` parts of its shard."""
    for batch in batches:
        post = pa.concat_arrays([batch.column("post")])
        docs = post.field("docs")
        n = len(post)
        row = np.repeat(np.arange(n), docs.value_lengths().to_numpy())
        part = row * shares + docs.flatten().to_numpy() % shares
        order = np.argsort(part, kind="stable")
        sizes = np.bincount(part, minlength=n * shares)
        kept = np.flatnonzero(sizes)
        ends, order = pa.array(np.concatenate([[0], np.cumsum(sizes[kept])]).astype(np.int32)), pa.array(order)
        fields = [
            post.field(f.name).take(pa.array(kept // shares)) if f.name == "lexeme" else pa.ListArray.from_arrays(ends, post.field(f.name).flatten().take(order))
            for f in post.type
        ]
        shard = batch.column("shard").to_numpy().astype(np.int64)[kept // shares] * shares + kept % shares
        yield pa.record_batch([pa.array(shard, pa.int32()), pa.StructArray.from_arrays(fields, [f.name for f in post.type])], names=["shard", "post"])


def divided(shards: int, docs: DataFrame, postings: DataFrame, asks: DataFrame, shares: int) -> tuple[int, DataFrame, DataFrame, DataFrame]:
    """The arguments of ``search_shards`` with each shard cut into ``shares`` by document: for matches and proximity, that no other document decides.

    Each posting goes to one part, each request to all parts of its shards.
    """
    if shares < 2:
        return shards, docs, postings, asks
    own = F.pmod(F.col("doc.doc_id"), F.lit(shares))
    parts = docs.withColumn("shard", (F.col("shard") * shares + own).cast("int"))
    kind = postings.schema["post"].dataType.simpleString()
    cut = postings.select("shard", "post").mapInArrow(partial(_dealt, shares=shares), f"shard int, post {kind}")
    every = F.sequence(F.col("shard") * shares, F.col("shard") * shares + (shares - 1)).cast("array<int>")
    return shards * shares, parts, cut, asks.select(F.explode(every).alias("shard"), "ask")


def search_shards(
    shards: int, docs: DataFrame, postings: DataFrame, asks: DataFrame, *, exact: int = 0, expanded: int = 0, sources: int = 0,
    legs: tuple[str, ...] = (), proximity: bool = False, block: int = BLOCK_DOCS, shares: int = 1,
) -> DataFrame:
    """``FOUND`` rows of every shard: the best ``exact`` and ``expanded`` programs and the best ``sources`` of each request.

    ``docs`` has (shard, doc), ``postings`` (shard, post) for the lexemes that are
    asked for, ``asks`` (shard, ask) for each shard that a request goes to. For
    ``legs`` every matching document is returned with its rank. ``shares``
    tasks have each shard, with a part of its requests each.
    """
    each = F.explode(F.sequence(F.lit(0), F.lit(shares - 1)))
    kinds = [(docs.withColumn("share", each), 0, "doc"), (postings.withColumn("share", each), 1, "post"),
             (asks.withColumn("share", F.pmod(F.xxhash64("ask.query_id"), F.lit(shares)).cast("int")), 2, "ask")]
    types = {name: df.schema[name].dataType for df, _, name in kinds}
    parts = [
        df.select((F.col("shard") * shares + F.col("share")).cast("int").alias("shard"), F.lit(kind).alias("kind"), *[F.col(n) if n == name else F.lit(None).cast(t).alias(n) for n, t in types.items()])
        for df, kind, name in kinds
    ]
    rows = parts[0].unionByName(parts[1]).unionByName(parts[2])
    # Requests with the same filters come together, as the programs that pass them are remembered.
    alike = [F.col(f"ask.{f}") for f in (*FIELDS, "domain", *[wish for _, wish, _ in INTENTS])]
    return rows.repartitionById(shards * shares, "shard").sortWithinPartitions("shard", "kind", *alike).mapInArrow(
        partial(_answered, exact=exact, expanded=expanded, sources=sources, legs=legs, proximity=proximity, block=block), FOUND
    )
