"""Column expressions for arithmetic, comparison and conversion of terms."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..plans.terms import TAGS, Atom, Col, Compound, Float, Int, ListTerm, Str, Term, Var, show, tagged

EPSILON = 2.220446049250313e-16


class TermError(ValueError):
    """A goal that can't be evaluated: an unbound, ill-typed or undefined operand."""


def literal(t: Term) -> tuple[Column, str]:
    if isinstance(t, Atom):
        return F.lit(t.name), "atom"
    if isinstance(t, Str):
        return F.lit(t.value), "str"
    if isinstance(t, Int):
        return F.lit(t.value).cast("long"), "int"
    if isinstance(t, Float):
        return F.lit(t.value).cast("double"), "float"
    return F.lit(tagged(t)), "term"


def column(t: Term) -> tuple[Column, str]:
    """A term of columns and constants as one column and its kind."""
    if isinstance(t, Col):
        return F.col(t.name), t.kind
    if isinstance(t, ListTerm) and t.tail is None:
        parts = [column(x) for x in t.items]
        kinds = {k for _, k in parts}
        if len(kinds) == 1 and not next(iter(kinds)).startswith("list:"):
            return F.array(*(c for c, _ in parts)), f"list:{kinds.pop()}"
        if not parts:
            return F.array().cast("array<string>"), "list:term"
        return F.array(*(as_term(c, k) for c, k in parts)), "list:term"
    if isinstance(t, Compound):
        parts = [as_term(*column(x)) for x in t.args]
        return F.concat(F.lit(f"$t:{t.name}("), F.concat_ws(", ", *parts), F.lit(")")), "term"
    if isinstance(t, Var):
        raise TermError(f"{t.name} is unbound")
    return literal(t)


def as_term(c: Column, kind: str) -> Column:
    """The tagged text of a column, for columns of mixed kinds."""
    if kind == "term":
        return c
    if kind.startswith("list:"):
        return F.concat(F.lit("$t:["), F.array_join(F.transform(c, lambda x: as_term(x, kind[5:])), ", "), F.lit("]"))
    return F.concat(F.lit(TAGS[kind]), c.cast("string"))


def plain(c: Column, kind: str) -> Column:
    """The value as it is shown in an answer row: tags are dropped."""
    return F.regexp_replace(c, r"^\$[asif]:", "") if kind == "term" else c


def number(t: Term) -> tuple[Column | int | float, str]:
    """The value of an arithmetic expression and whether it is an int or a float; constants are folded.

    Integers are 64-bit and an overflow is an error, as Spark's ANSI mode has it.
    ``mod`` and ``//`` are Euclidean, ``rem`` truncates, ``/`` gives a float.
    """
    if isinstance(t, Int):
        return t.value, "int"
    if isinstance(t, Float):
        return t.value, "float"
    if isinstance(t, Col):
        if t.kind in ("int", "float"):
            return F.col(t.name), t.kind
        if t.kind == "term":
            return F.regexp_replace(F.col(t.name), r"^\$[if]:", "").cast("double"), "float"
        raise TermError(f"a number is expected, not a column of {t.kind}")
    if isinstance(t, Var):
        raise TermError(f"{t.name} is unbound")
    if isinstance(t, Compound) and len(t.args) == 1:
        v, k = number(t.args[0])
        if t.name == "+":
            return v, k
        if t.name == "-":
            return -v, k
        if t.name == "abs":
            return (F.abs(v) if isinstance(v, Column) else abs(v)), k
    if isinstance(t, Compound) and len(t.args) == 2 and t.name in ("+", "-", "*", "/", "//", "mod", "rem", "min", "max"):
        (a, ka), (b, kb) = number(t.args[0]), number(t.args[1])
        ints = ka == kb == "int"
        if t.name in ("//", "mod", "rem") and not ints:
            raise TermError(f"{t.name} needs integers")
        fixed = not isinstance(a, Column) and not isinstance(b, Column)
        if fixed:
            return _folded(t.name, a, b, ints)
        if not ints:
            a, b = _double(a), _double(b)
        a, b = (x if isinstance(x, Column) else F.lit(x).cast("long" if ints else "double") for x in (a, b))
        if t.name == "/":
            return a.cast("double") / b.cast("double"), "float"
        if t.name == "mod":
            return F.pmod(a, F.abs(b)), "int"
        if t.name == "rem":
            return a % b, "int"
        if t.name == "//":
            return F.call_function("div", a - F.pmod(a, F.abs(b)), b), "int"
        out = {"+": lambda: a + b, "-": lambda: a - b, "*": lambda: a * b, "min": lambda: F.least(a, b), "max": lambda: F.greatest(a, b)}[t.name]()
        return out, "int" if ints else "float"
    raise TermError(f"not an arithmetic expression: {show(t)}")


def _double(x):
    return x.cast("double") if isinstance(x, Column) else float(x)


def _folded(op: str, a, b, ints: bool) -> tuple[int | float, str]:
    if op in ("/", "//", "mod", "rem") and b == 0:
        raise TermError("division by zero")
    if op == "/":
        return a / b, "float"
    if op == "mod":
        return a % abs(b), "int"
    if op == "rem":
        return int(math.fmod(a, b)) if abs(a) < 2**53 else a - b * (abs(a) // abs(b)) * (1 if a * b > 0 else -1), "int"
    if op == "//":
        return (a - a % abs(b)) // b, "int"
    v = {"+": lambda: a + b, "-": lambda: a - b, "*": lambda: a * b, "min": lambda: min(a, b), "max": lambda: max(a, b)}[op]()
    if ints and not -(2**63) <= v < 2**63:
        raise TermError("integer overflow")
    return (v, "int") if ints else (float(v), "float")


def compared(op: str, a, b) -> Column | bool:
    """A numeric comparison in double precision; equality has a tolerance of one epsilon."""
    tests = {"<": lambda x, y: x < y, ">": lambda x, y: x > y, "=<": lambda x, y: x <= y, ">=": lambda x, y: x >= y}
    if not isinstance(a, Column) and not isinstance(b, Column):
        a, b = float(a), float(b)
        return abs(a - b) < EPSILON if op == "=:=" else abs(a - b) >= EPSILON if op == "=\\=" else tests[op](a, b)
    a, b = (x.cast("double") if isinstance(x, Column) else F.lit(float(x)) for x in (a, b))
    return F.abs(a - b) < EPSILON if op == "=:=" else F.abs(a - b) >= EPSILON if op == "=\\=" else tests[op](a, b)


def rank(kind: str) -> int:
    """Place of a kind in the standard order: variables, numbers, atoms and strings, compounds."""
    return 1 if kind in ("int", "float") else 2 if kind in ("atom", "str") else 3


def ordered(op: str, x: Term, y: Term) -> Column | bool:
    """The standard order of terms; numbers compare by value, atoms and strings by text."""
    (a, ka), (b, kb) = column(x), column(y)
    if "term" in (ka, kb) or rank(ka) == rank(kb) == 3:
        key = lambda c, k: F.struct(F.when(c.rlike(r"^\$[if]:"), 1).when(c.rlike(r"^\$[as]:"), 2).otherwise(3) if k == "term" else F.lit(rank(k)), F.regexp_extract(as_term(c, k), r"^\$[if]:(.*)$", 1).try_cast("double"), F.regexp_replace(as_term(c, k), r"^\$[asif]:", ""))
        left, right = key(a, ka), key(b, kb)
    elif rank(ka) != rank(kb):
        left, right = F.lit(rank(ka)), F.lit(rank(kb))
    elif rank(ka) == 1:
        left, right = a.cast("double"), b.cast("double")
    else:
        left, right = a, b
    return {"@<": lambda: left < right, "@>": lambda: left > right, "@=<": lambda: left <= right, "@>=": lambda: left >= right}[op]()


def fnv1a(data: bytes) -> int:
    """The 64-bit FNV-1a hash, unsigned."""
    h = 0xCBF29CE484222325
    for b in data:
        h = (h ^ b) * 0x100000001B3 & 0xFFFFFFFFFFFFFFFF
    return h


def fnv1a_hex(texts):
    """A pandas function of a text column: 16 hexadecimal digits of FNV-1a, null for null."""
    return texts.map(lambda t: None if t is None else f"{fnv1a(t.encode()):016x}")
