"""Model formulas: `y ~ a + b + a:b + C(k) * x - 1` as columns of a design.

Grammar: label `~` terms joined by `+` and `-`; a term is factors joined by `:` (their product) or `*`
(all products of some of them); a factor is a column or `C(column)`, a categorical one; `1`, `0` and `-1`
say whether there is an intercept.

A categorical factor has a dummy for each level but the first, or for every level where the
term without that factor is no term of the model (the intercept being the empty term), so
that the design has full rank. The levels come from one bounded aggregate over the rows;
the dummies and products are JVM column expressions.
"""

from __future__ import annotations

import itertools
import re
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelcast.operators.encode import MAX_LEVELS, dummy_name, levels

_TOKEN = re.compile(r"\s*(?:(C\(\s*[^()]+?\s*\))|([A-Za-z_]\w*)|([01])|([~+\-:*]))")


@dataclass(frozen=True)
class Formula:
    label: str
    terms: tuple[tuple[str, ...], ...]  # factors of each term, as written
    intercept: bool


def _tokens(text: str) -> list[str]:
    out, at = [], 0
    text = text.rstrip()
    while at < len(text):
        m = _TOKEN.match(text, at)
        if not m:
            raise ValueError(f"cannot read the formula from here: {text[at:]!r}")
        token = m.group().strip()
        out.append(re.sub(r"\s+", "", token) if token.startswith("C(") else token)
        at = m.end()
    return out


def parse(text: str) -> Formula:
    """The formula's label, terms (each once, in the order of their number of factors) and intercept."""
    tokens = _tokens(text)
    if len(tokens) < 3 or tokens[1] != "~":
        raise ValueError(f"a formula reads 'label ~ terms', not {text!r}")
    label, rest = tokens[0], ["+", *tokens[2:]] if tokens[2] not in "+-" else tokens[2:]
    terms, intercept, at = [], True, 0
    while at < len(rest):
        sign = rest[at]
        if sign not in "+-" or at + 1 == len(rest):
            raise ValueError(f"expected + or - and a term in {text!r}")
        end = at + 1
        while end < len(rest) and rest[end] not in "+-":
            end += 1
        part, at = rest[at + 1:end], end
        if part in (["0"], ["1"]):
            intercept = (part == ["1"]) == (sign == "+")
            continue
        if len(part) % 2 == 0 or any(t not in (":", "*") for t in part[1::2]) or any(t in "~:*01" for t in part[::2]):
            raise ValueError(f"cannot read the term {''.join(part)!r}")
        groups = [[part[0]]]  # factors joined by ':' stay together, '*' lists the groups
        for op, factor in zip(part[1::2], part[2::2], strict=True):
            if op == ":":
                groups[-1].append(factor)
            else:
                groups.append([factor])
        for n in range(1, len(groups) + 1):
            if "*" not in part and n < len(groups):
                continue
            for some in itertools.combinations(groups, n):
                term = tuple(dict.fromkeys(f for g in some for f in g))
                same = [t for t in terms if set(t) == set(term)]
                if sign == "+" and not same:
                    terms.append(term)
                elif sign == "-":
                    terms = [t for t in terms if t not in same]
    return Formula(label, tuple(sorted(terms, key=len)), intercept)


def _column(factor: str) -> str | None:
    return factor[2:-1] if factor.startswith("C(") else None


def design(df: DataFrame, formula: str | Formula, keep: tuple[str, ...] = (),
           max_levels: int = MAX_LEVELS) -> tuple[DataFrame, list[str], Formula]:
    """(label, keep.. and one column per term column), the term columns' names, the parsed formula."""
    f = parse(formula) if isinstance(formula, str) else formula
    known = {frozenset(t) for t in f.terms} | ({frozenset()} if f.intercept else set())
    every = {}
    for factor in dict.fromkeys(x for t in f.terms for x in t):
        if (c := _column(factor)) is not None:
            every[factor] = levels(df, c, max_levels)
    columns, names = [], []
    for term in f.terms:
        parts = []
        for k, factor in enumerate(term):
            c = _column(factor)
            if c is None:
                parts.append([(factor, F.col(f"`{factor}`").cast("double"))])
                continue
            # without the intercept's term the first main effect has all levels, the next ones see it
            smaller = frozenset(term[:k] + term[k + 1:])
            lead = not smaller and not f.intercept and [t for t in f.terms if len(t) == 1 and _column(t[0])][0] == term
            full = lead if not smaller else smaller not in known
            used = every[factor] if full else every[factor][1:]
            parts.append([(dummy_name(c, v), (F.col(f"`{c}`") == F.lit(v)).cast("double")) for v in used])
        for some in itertools.product(*parts):
            value = some[0][1]
            for _, more in some[1:]:
                value = value * more
            names.append(":".join(n for n, _ in some))
            columns.append(value.alias(names[-1]))
    return df.select(F.col(f"`{f.label}`"), *[F.col(f"`{c}`") for c in keep if c != f.label], *columns), names, f
