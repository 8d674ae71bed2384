"""Which rules can match a text: one pass over it with an Aho-Corasick automaton over the literals that rules need.

Each rule gives sets of literals; of each set one has to stand in the event's texts (in lower case) for it to hold: a plain pattern itself, or
what every match of a regex contains. The automaton finds all literals of all rules in one pass, whatever their number. A rule is looked at
when a literal of the set that it shares with the fewest rules was found, and evaluated when one of each of its other sets was found too. A rule without
any literal is evaluated for every event, one that can't hold for none.

Patterns mean what Python's ``re`` takes them to mean and are run by Java: what differs in spelling is translated, and a
pattern that either of them refuses matches nothing.
"""

from __future__ import annotations

import re
from collections import Counter
from re import _constants as op
from re import _parser as parser

import pandas as pd
from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

#: Shorter literals stand in nearly every text; a rule with only such ones counts as one without.
SHORTEST = 3


def java_regex(body: str, any_case: bool = False) -> str | None:
    """The pattern as Java spells it; None when Python or Java refuses it."""
    try:
        re.compile(body)
    except (re.error, OverflowError, RecursionError):
        return None
    if "(?P=" in body or "(?P>" in body:  # Java names can't hold every Python name
        return None
    text = re.sub(r"\(\?P<\w+>", "(", body)
    text = re.sub(r"(?<!\\)((?:\\\\)*)\\Z", r"\1\\z", text)
    spark = SparkSession.getActiveSession()
    if spark is not None:
        try:
            spark._jvm.java.util.regex.Pattern.compile(text)
        except Py4JJavaError:
            return None
    return ("(?i)" if any_case else "") + text


def split_pattern(pattern: str) -> tuple[str, str]:
    """``contains`` and a text in lower case, ``regex`` and a Java pattern, or ``never``."""
    pattern = pattern.strip()
    end = pattern.rfind("/")
    if pattern.startswith("/") and end > 0:
        text = java_regex(pattern[1:end], "i" in pattern[end + 1 :])
        return ("never", "") if text is None else ("regex", text)
    return "contains", pattern.lower()


def _of_sequence(items) -> list[str] | None:
    """Literals of which each match contains one; the best that this sequence of pattern items gives."""
    best: list[str] | None = None
    run = ""

    def weigh(found):
        nonlocal best
        if found and (best is None or min(map(len, found)) > min(map(len, best))):
            best = found

    for kind, value in items:
        if kind is op.LITERAL and value < 128:
            run += chr(value).lower()
            continue
        weigh([run] if run else None)
        run = ""
        if kind is op.SUBPATTERN:
            weigh(_of_sequence(value[3]))
        elif kind in (op.MAX_REPEAT, op.MIN_REPEAT, op.POSSESSIVE_REPEAT) and value[0] > 0:
            weigh(_of_sequence(value[2]))
        elif kind is op.ATOMIC_GROUP:
            weigh(_of_sequence(value))
        elif kind is op.BRANCH:
            each = [_of_sequence(b) for b in value[1]]
            weigh(sorted({x for found in each for x in found}) if all(each) else None)
    weigh([run] if run else None)
    return best


def needed(body: str) -> list[str] | None:
    """Literals (lower case) of which every match of this Python pattern contains one."""
    try:
        found = _of_sequence(parser.parse(body))
    except (re.error, OverflowError, RecursionError):
        return None
    return found if found and min(map(len, found)) >= SHORTEST else None


def _flat(items):
    """Pattern items with plain groups opened: a group's literals go on behind it."""
    for kind, value in items:
        if kind is op.SUBPATTERN:
            yield from _flat(value[3])
        else:
            yield kind, value


def _clauses_of(items) -> list[list[str]]:
    """Sets of literals of which each match contains one of each."""
    out, run = [], ""
    for kind, value in [*_flat(items), (None, None)]:
        if kind is op.LITERAL and value < 128:
            run += chr(value).lower()
            continue
        if run:
            out.append([run])
        run = ""
        if kind in (op.MAX_REPEAT, op.MIN_REPEAT, op.POSSESSIVE_REPEAT) and value[0] > 0:
            out += _clauses_of(value[2])
        elif kind is op.ATOMIC_GROUP:
            out += _clauses_of(value)
        elif kind is op.BRANCH and (found := _of_sequence([(kind, value)])):
            out.append(found)
    return out


def clauses(body: str) -> list[list[str]]:
    """Sets of literals (lower case): every match of this Python pattern contains one of each."""
    try:
        return _clauses_of(parser.parse(body))
    except (re.error, OverflowError, RecursionError):
        return []


def rule_clauses(rule) -> list[list[str]] | None:
    """The sets of literals of all of a rule's tests; None for a rule that can't hold."""
    out = []
    for pattern in (rule.message_pattern, rule.event_type_pattern, rule.source_type):
        if pattern:
            kind, given = split_pattern(pattern)
            text = pattern.strip()
            if kind == "never":
                return None
            out += clauses(text[1 : text.rfind("/")]) if kind == "regex" else [[given]]
    for c in rule.conditions or []:
        if c.op in ("eq", "contains", "contains_any", "startswith_any"):
            out.append([v.lower() for v in (c["values"][:1] if c.op == "eq" else c["values"])])
        elif c.op in ("regex", "regex_any"):
            each = [clauses(v) for v in c["values"]]  # one of the patterns has to match: a set of each
            out.append([x for found in each for x in max(found, key=lambda f: min(map(len, f)))] if all(each) else [])
    return [sorted(set(c)) for c in out if c and all(x and x.isascii() for x in c)]


def candidates(rules: list) -> tuple[list[int], dict[str, list[int]], list[list[frozenset]]]:
    """Positions of the rules that every event has to be tried with, literals with the positions of the rules that are looked at
    when they are found, and for each rule the sets of which one literal has to be found besides."""
    wanted = [rule_clauses(r) for r in rules]
    shared = Counter(x for found in wanted for clause in found or () for x in clause)
    always, by_literal, besides = [], {}, []
    for i, found in enumerate(wanted):
        best = min(found, key=lambda c: (sum(shared[x] for x in c), -min(map(len, c))), default=None) if found is not None else ()
        if best is None:
            always.append(i)
        for literal in best or ():
            by_literal.setdefault(literal, []).append(i)
        besides.append([frozenset(c) for c in found or () if c is not best])
    return always, by_literal, besides


def candidate_rules(text: Column, rules: list) -> Column:
    """Positions of the rules that may hold for a text in lower case, in order."""
    always, by_literal, besides = candidates(rules)
    if not by_literal:
        return F.array(*map(F.lit, always)).cast("array<int>")
    literals = sorted({*by_literal, *(x for sets in besides for clause in sets for x in clause)})
    built: list = []

    def automaton():
        if not built:
            try:
                import ahocorasick
            except ImportError:  # slower, the same answer
                built.append(lambda s: {x for x in literals if x in s})
            else:
                machine = ahocorasick.Automaton()
                for literal in literals:
                    machine.add_word(literal, literal)
                machine.make_automaton()
                built.append(lambda s: {x for _, x in machine.iter(s)})
        return built[0]

    def holding(seen):
        for literal in seen:
            for i in by_literal.get(literal, ()):
                if not any(clause.isdisjoint(seen) for clause in besides[i]):
                    yield i

    @F.pandas_udf("array<int>")
    def found(texts: pd.Series) -> pd.Series:
        search = automaton()
        return texts.map(lambda s: sorted({*always, *holding(search(s))}))

    return found(text)
