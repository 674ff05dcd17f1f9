"""Boolean trigram queries of regular expressions: what a text must hold, in lower case, for a match to be possible."""

from __future__ import annotations

import re
from itertools import product

try:
    from re import _constants as C
    from re import _parser as parser
except ImportError:  # before Python 3.11
    import sre_constants as C
    import sre_parse as parser

#: An OR of ANDs; None: no condition.
Query = frozenset[frozenset[str]] | None
MOST = 64


def simplify(query: Query) -> Query:
    """Drops conditions that another, weaker one makes needless; an empty condition means none at all."""
    if query is None or frozenset() in query:
        return None
    return frozenset(a for a in query if not any(b < a for b in query))


def both(a: Query, b: Query) -> Query:
    if a is None or b is None:
        return b if a is None else a
    got = simplify(frozenset(x | y for x, y in product(a, b)))
    return got if got is not None and len(got) <= MOST else min(a, b, key=len)


def of_strings(strings: set[str]) -> Query:
    return simplify(frozenset(frozenset(s[i : i + 3] for i in range(len(s) - 2)) for s in strings))


def query(pattern: str) -> Query:
    """Sound for any text lower-cased as a whole: every match's text satisfies it."""

    def sequence(nodes) -> tuple[set[str] | None, Query]:
        """(all strings that may match, None) while these are few, else (None, condition)."""
        strings, found, whole = {""}, None, True
        for op, arg in nodes:
            own, condition = node(op, arg)
            if own is not None and len(own) * len(strings) <= MOST:
                strings = {a + b for a, b in product(strings, own)}
                continue
            found, strings, whole = both(found, of_strings(strings)), {""}, False
            if own is None:
                found = both(found, condition)
            else:
                strings = own
        return (strings, None) if whole else (None, both(found, of_strings(strings)))

    def node(op, arg) -> tuple[set[str] | None, Query]:
        if op is C.LITERAL:
            return {chr(arg).lower()}, None
        if op is C.AT or op in (C.ASSERT, C.ASSERT_NOT):
            return {""}, None
        if op is C.SUBPATTERN:
            return sequence(arg[3])
        if op is C.BRANCH:
            parts = [sequence(x) for x in arg[1]]
            if all(s is not None for s, _ in parts) and sum(len(s) for s, _ in parts) <= MOST:
                return set().union(*(s for s, _ in parts)), None
            conditions = [q if s is None else of_strings(s) for s, q in parts]
            return None, None if None in conditions else simplify(frozenset().union(*conditions))
        if op is C.IN:
            chars: set[str] = set()
            for kind, x in arg:
                if kind is C.LITERAL:
                    chars.add(chr(x).lower())
                elif kind is C.RANGE and x[1] - x[0] < 8:
                    chars |= {chr(c).lower() for c in range(x[0], x[1] + 1)}
                else:
                    return None, None
            return (chars, None) if len(chars) <= 8 else (None, None)
        if op in (C.MAX_REPEAT, C.MIN_REPEAT):
            least, most, body = arg
            own, condition = sequence(body)
            if own is not None and most == 1:
                return own | {""} if least == 0 else own, None
            if not least:
                return None, None
            if own is not None and len(own) ** least <= MOST:
                full = {"".join(x) for x in product(own, repeat=least)}
                return (full, None) if least == most else (None, of_strings(full))
            return None, condition if own is None else of_strings(own)
        return None, None

    strings, condition = sequence(parser.parse(pattern))
    return of_strings(strings) if strings is not None else condition


def as_alternation(trigrams: list[str]) -> str:
    """A look-ahead that captures whichever of the trigrams begins at a place, branching by first letter."""
    heads: dict[str, list[str]] = {}
    for t in sorted(trigrams):
        heads.setdefault(t[0], []).append(t[1:])
    return "(?=(" + "|".join(re.escape(h) + "(?:" + "|".join(map(re.escape, rest)) + ")" for h, rest in heads.items()) + "))"
