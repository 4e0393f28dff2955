"""Boolean trigram queries derived from regular expressions.

A query is ``True`` (no trigram is mandatory), a trigram, or ``("and" | "or", [queries])``. A text
that matches the expression, lower-cased, satisfies the query; the converse need not hold.
"""

from __future__ import annotations

from re import _constants as kinds, _parser as parser

#: A class or a product of classes of at most so many strings is spelled out.
MOST_STRINGS = 64


def both(a, b, word: str):
    """Conjunction or disjunction, with ``True`` simplified away."""
    if word == "and":
        parts = [x for x in (a, b) if x is not True]
        if not parts:
            return True
    else:
        parts = [a, b]
        if a is True or b is True:
            return True
    flat = []
    for x in parts:
        for y in x[1] if isinstance(x, tuple) and x[0] == word else [x]:
            if y not in flat:
                flat.append(y)
    return flat[0] if len(flat) == 1 else (word, flat)


def of_strings(strings: set[str]):
    """One of the strings occurs: for each, all of its trigrams.

    A string whose trigrams hold all those of another adds nothing to the disjunction.
    """
    sets = {s: {s[i : i + 3] for i in range(len(s) - 2)} for s in strings}
    query = None
    for s in sorted(strings, key=lambda s: (len(sets[s]), s)):
        if any(t != s and (sets[t] < sets[s] or sets[t] == sets[s] and t < s) for t in strings):
            continue
        own = True
        for i in range(len(s) - 2):
            own = both(own, s[i : i + 3], "and")
        query = own if query is None else both(query, own, "or")
    return True if query is None else query


def thinned(query, most: int):
    """Keeps at most so many trigrams of each conjunction, evenly spread: a weaker query, still
    mandatory, that needs fewer postings."""
    if not isinstance(query, tuple):
        return query
    word, parts = query
    if word == "and" and len(parts) > most and all(isinstance(x, str) for x in parts):
        parts = [parts[i * (len(parts) - 1) // (most - 1)] for i in range(most)]
    smaller = [thinned(x, most) for x in parts]
    parts = [x for i, x in enumerate(smaller) if x not in smaller[:i]]
    return parts[0] if len(parts) == 1 else (word, parts)


def _class(items) -> set[str] | None:
    """The characters of a class, lower-cased, or None if they are many or unknown."""
    out: set[str] = set()
    for op, arg in items:
        if op is kinds.LITERAL:
            out.add(chr(arg).lower())
        elif op is kinds.RANGE and arg[1] - arg[0] < MOST_STRINGS:
            out |= {chr(x).lower() for x in range(arg[0], arg[1] + 1)}
        else:
            return None
    return out if len(out) <= 8 else None


def _walk(tree) -> tuple[set[str] | None, object]:
    """The exact set of strings a node matches (None if open), and a query besides."""
    run, query, closed = {""}, True, True
    for op, arg in tree:
        exact, more = _node(op, arg)
        query = both(query, more, "and")
        if exact is not None and len(run) * len(exact) <= MOST_STRINGS:
            run = {a + b for a in run for b in exact}
        else:
            query = both(query, of_strings(run), "and")
            run = exact if exact is not None else {""}
            closed = False
        if exact is None or more is not True:
            closed = False
    if closed:
        return run, query
    return None, both(query, of_strings(run), "and")


def _node(op, arg) -> tuple[set[str] | None, object]:
    if op is kinds.LITERAL:
        return {chr(arg).lower()}, True
    if op is kinds.IN:
        return _class(arg), True
    if op is kinds.SUBPATTERN:
        return _walk(arg[3])
    if op is kinds.BRANCH:
        strings: set[str] | None = set()
        query = None
        for branch in arg[1]:
            exact, more = _walk(branch)
            strings = None if strings is None or exact is None else strings | exact
            own = both(more, of_strings(exact), "and") if exact is not None else more
            query = own if query is None else both(query, own, "or")
        if strings is not None and len(strings) <= MOST_STRINGS:
            return strings, True
        return None, query
    if op in (kinds.MAX_REPEAT, kinds.MIN_REPEAT):
        low, high, body = arg
        exact, more = _walk(body)
        if (low, high) == (0, 1) and exact is not None and len(exact) < 8:
            return exact | {""}, True
        if low == 0:
            return None, True
        return None, both(more, of_strings(exact), "and") if exact is not None else more
    if op is kinds.AT:
        return {""}, True
    return None, True


def query_of(regex: str):
    """The Boolean trigram query of a regular expression."""
    exact, query = _walk(parser.parse(regex))
    return of_strings(exact) if exact is not None else query


def grams_of(query) -> set[str]:
    if query is True:
        return set()
    if isinstance(query, str):
        return {query}
    return set().union(*map(grams_of, query[1]))
