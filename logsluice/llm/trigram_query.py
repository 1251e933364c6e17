"""Boolean trigram queries that every match of a regular expression satisfies.

A query is a set of clauses, one of which must hold; a clause is a set of trigrams, all of which the
lower-cased text must contain. No clauses at all mean that nothing is demanded, so the rule scans fully.
Only small patterns of our own are analysed, on the driver; what the analysis doesn't know demands nothing.
"""

from __future__ import annotations

from itertools import product
from re import _constants as op, _parser

MAX_STRINGS = 64
Clauses = frozenset[frozenset[str]]
ANYTHING: Clauses = frozenset()


def _trigrams(text: str) -> frozenset[str]:
    return frozenset(text[i:i + 3] for i in range(len(text) - 2))


def _least(clauses) -> Clauses:
    """Without clauses that demand more than another one."""
    return frozenset(c for c in clauses if not any(other < c for other in clauses))


def _demand(strings: set[str]) -> Clauses:
    """A clause per string; one string without a trigram leaves nothing demanded."""
    clauses = {_trigrams(s) for s in strings}
    return ANYTHING if frozenset() in clauses else _least(clauses)


def _both(a: Clauses, b: Clauses) -> Clauses:
    if not a or not b:
        return a or b
    return _least({x | y for x, y in product(a, b)})


def _strings(item) -> set[str] | None:
    """All lower-cased strings that one item matches, if they are few; None if not."""
    kind, value = item
    if kind is op.LITERAL:
        return {chr(value).lower()}
    if kind is op.IN:
        found = set()
        for inner, v in value:
            if inner is op.LITERAL:
                found.add(chr(v).lower())
            else:
                return None
        return found if len(found) <= 8 else None
    if kind is op.SUBPATTERN:
        return _sequence_strings(value[3])
    if kind is op.BRANCH:
        every = [_sequence_strings(branch) for branch in value[1]]
        return None if any(s is None for s in every) else set().union(*every)
    if kind in (op.MAX_REPEAT, op.MIN_REPEAT):
        low, high, inner = value
        one = _sequence_strings(inner)
        if one is None or high is op.MAXREPEAT or high > 2:
            return None
        return {"".join(p) for n in range(low, high + 1) for p in product(one, repeat=n)}
    return None


def _sequence_strings(items) -> set[str] | None:
    found = {""}
    for item in items:
        more = _strings(item)
        if more is None or len(found) * len(more) > MAX_STRINGS:
            return None
        found = {a + b for a, b in product(found, more)}
    return found


def _sequence(items) -> Clauses:
    """Runs of items with few strings demand their trigrams; the rest is looked into."""
    demand, run = ANYTHING, {""}
    for item in items:
        strings = _strings(item)
        if strings is not None and len(run) * len(strings) <= MAX_STRINGS:
            run = {a + b for a, b in product(run, strings)}
            continue
        demand, run = _both(demand, _demand(run)), {""}
        if strings is not None:
            run = strings
            continue
        kind, value = item
        if kind is op.SUBPATTERN:
            demand = _both(demand, _sequence(value[3]))
        elif kind is op.BRANCH:
            branches = [_sequence(branch) for branch in value[1]]
            if all(branches):
                demand = _both(demand, _least(frozenset().union(*branches)))
        elif kind in (op.MAX_REPEAT, op.MIN_REPEAT) and value[0] > 0:
            demand = _both(demand, _sequence(value[2]))
    return _both(demand, _demand(run))


def trigram_query(pattern: str) -> Clauses:
    """The clauses of a pattern; empty if it has no mandatory trigrams."""
    return _sequence(_parser.parse(pattern))
