"""Reading terms, rules, queries and fact files.

Operators are split, not climbed: a body at its leftmost ``:-``, then ``->``,
then ``;``, then at commas, so ``a -> b ; c`` is a condition whose second part
is the disjunction. A sum is split at its last ``+``, else its last ``-``; a
product at its first ``mod``, its first ``rem``, its last ``//``, ``*``, ``/``.
A query is split at its commas first.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

from .terms import Atom, Compound, Float, Int, ListTerm, Obj, Str, Term, Var

_TOKEN = re.compile(
    r"""(?P<space>\s+|%[^\n]*)|(?P<num>\d+\.\d+(?:[eE][+-]?\d+)?|\d+(?:[eE][+-]?\d+)?)|(?P<str>"(?:\\.|[^"\\])*")|(?P<quoted>'(?:\\.|[^'\\])*')
    |(?P<var>[A-Z_]\w*)|(?P<name>[^\W\dA-Z_]\w*)|(?P<op>:-|->|\\\+|=\.\.|=:=|=\\=|==|\\==|\\=|@=<|@>=|@<|@>|=<|>=|//|[-+*/<>=;,|!()\[\]{}:.^])""",
    re.X,
)
COMPARE = ("=:=", "=\\=", "==", "\\==", "=..", "\\=", "@=<", "@>=", "@<", "@>", "=<", ">=", "<", ">", "=", "is")


class ParseError(ValueError):
    pass


@dataclass(frozen=True)
class Rule:
    head: Term
    body: tuple[Term, ...]


@dataclass(frozen=True)
class Query:
    goals: tuple[Term, ...]


@dataclass(frozen=True)
class Directive:
    goal: Term


_ESCAPES = {"n": "\n", "t": "\t", "r": "\r"}


def _unquote(text: str) -> str:
    return re.sub(r"\\(.)", lambda m: _ESCAPES.get(m[1], m[1]), text[1:-1], flags=re.S)


def tokenize(text: str) -> list[tuple[str, str]]:
    out, at = [], 0
    while at < len(text):
        m = _TOKEN.match(text, at)
        if not m:
            raise ParseError(f"unexpected {text[at]!r} at {at}")
        if m.lastgroup != "space":
            out.append((m.lastgroup, m[0]))
        at = m.end()
    return out


_OPEN, _CLOSE = {"(", "[", "{"}, {")", "]", "}"}


def _places(tokens: list[tuple[str, str]], texts: tuple[str, ...]) -> list[int]:
    """Positions of operators outside brackets."""
    depth, out = 0, []
    for i, (kind, text) in enumerate(tokens):
        if kind == "op" and text in _OPEN:
            depth += 1
        elif kind == "op" and text in _CLOSE:
            depth -= 1
            if depth < 0:
                raise ParseError(f"unmatched {text}")
        elif not depth and text in texts and kind in ("op", "name"):
            out.append(i)
    if depth:
        raise ParseError("unclosed bracket")
    return out


def _binary(tokens: list[tuple[str, str]], i: int) -> bool:
    """Whether a sign stands between operands."""
    if not 0 < i < len(tokens) - 1:
        return False
    kind, text = tokens[i - 1]
    return (kind != "op" and (kind, text) not in (("name", "mod"), ("name", "rem"), ("name", "is"))) or text in (")", "]", "}", "!")


def split_commas(tokens: list[tuple[str, str]]) -> list[list[tuple[str, str]]]:
    at = _places(tokens, (",",))
    return [tokens[a:b] for a, b in zip([0, *(i + 1 for i in at)], [*at, len(tokens)])]


def expression(tokens: list[tuple[str, str]]) -> Term:
    if not tokens:
        raise ParseError("empty term")
    for op in (":-", "->", ";"):
        if at := _places(tokens, (op,)):
            i = at[0]
            return Compound(op, (expression(tokens[:i]), expression(tokens[i + 1 :])))
    parts = split_commas(tokens)
    if len(parts) > 1:
        return Compound(",", (expression(parts[0]), expression([x for k, p in enumerate(parts[1:]) for x in ([("op", ",")] if k else []) + p])))
    if tokens[0] == ("op", "\\+"):
        return Compound("\\+", (expression(tokens[1:]),))
    for op in COMPARE:
        if at := [i for i in _places(tokens, (op,)) if 0 < i < len(tokens) - 1]:
            i = at[0]
            return Compound(op, (arithmetic(tokens[:i]), arithmetic(tokens[i + 1 :])))
    return arithmetic(tokens)


def arithmetic(tokens: list[tuple[str, str]]) -> Term:
    for op, last in (("+", True), ("-", True), ("mod", False), ("rem", False), ("//", True), ("*", True), ("/", True)):
        at = [i for i in _places(tokens, (op,)) if _binary(tokens, i)]
        if at:
            i = at[-1] if last else at[0]
            return Compound(op, (arithmetic(tokens[:i]), arithmetic(tokens[i + 1 :])))
    if tokens and tokens[0] in (("op", "-"), ("op", "+")) and len(tokens) > 1:
        inner = arithmetic(tokens[1:])
        if isinstance(inner, (Int, Float)):
            return inner if tokens[0][1] == "+" else type(inner)(-inner.value)
        return Compound(tokens[0][1], (inner,))
    return primary(tokens)


def primary(tokens: list[tuple[str, str]]) -> Term:
    if not tokens:
        raise ParseError("empty term")
    (kind, text), rest = tokens[0], tokens[1:]
    if not rest:
        if kind == "num":
            return Float(float(text)) if any(c in text for c in ".eE") else Int(int(text))
        if kind == "str":
            return Str(_unquote(text))
        if kind == "var":
            return Var(text)
        if kind == "quoted":
            return Atom(_unquote(text))
        if kind == "name" or text in ("!", *COMPARE, "+", "-", "*", "/", "//", ";", "->", ":-", "\\+"):
            return Atom(text)
        raise ParseError(f"unexpected {text!r}")
    if text == "(" and kind == "op" and rest[-1] == ("op", ")"):
        _places(tokens, ())
        return expression(tokens[1:-1])
    if text == "[" and kind == "op" and rest[-1] == ("op", "]"):
        inner = tokens[1:-1]
        if not inner:
            return ListTerm(())
        bar = _places(inner, ("|",))
        head = inner[: bar[0]] if bar else inner
        tail = expression(inner[bar[0] + 1 :]) if bar else None
        items = tuple(expression(p) for p in split_commas(head))
        if isinstance(tail, ListTerm):
            return ListTerm(items + tail.items, tail.tail)
        return ListTerm(items, tail)
    if text == "{" and kind == "op" and rest[-1] == ("op", "}"):
        pairs = []
        for p in split_commas(tokens[1:-1]) if len(tokens) > 2 else []:
            if len(p) < 3 or p[1] != ("op", ":"):
                raise ParseError("an object needs key: value pairs")
            pairs.append((_unquote(p[0][1]) if p[0][0] in ("str", "quoted") else p[0][1], expression(p[2:])))
        return Obj(tuple(pairs))
    if rest[0] == ("op", "(") and rest[-1] == ("op", ")") and (kind in ("name", "quoted") or text in (*COMPARE, "+", "-", "*", "/", "//", ";", "->", "\\+", ",")):
        name = _unquote(text) if kind == "quoted" else text
        inner = rest[1:-1]
        if not inner:
            raise ParseError(f"{name}() has no arguments")
        return Compound(name, tuple(expression(p) for p in split_commas(inner)))
    raise ParseError(f"unexpected {' '.join(t for _, t in tokens)!r}")


def parse_term(text: str) -> Term:
    return expression(tokenize(text))


def conjuncts(t: Term) -> tuple[Term, ...]:
    out = []
    while isinstance(t, Compound) and t.name == "," and len(t.args) == 2:
        out.append(t.args[0])
        t = t.args[1]
    return (*out, t)


def as_clause(t: Term) -> Rule:
    """A rule of ``Head :- Body`` or a fact."""
    if isinstance(t, Compound) and t.name == ":-" and len(t.args) == 2:
        return Rule(t.args[0], conjuncts(t.args[1]))
    return Rule(t, ())


def statements(chunks: Iterable[str]) -> Iterator[str]:
    """Statements of a fact or rule file, streamed: cut at a period that ends a clause, outside quotes, comments and brackets."""
    held, quote, comment, depth, escape = [], "", False, 0, False
    pending = False
    for chunk in chunks:
        for c in chunk:
            if pending:
                pending = False
                if c.isspace() or c == "%":
                    text = "".join(held[:-1]).strip()
                    if text:
                        yield text
                    held = []
            if comment:
                comment = c != "\n"
                continue
            if quote:
                held.append(c)
                if escape:
                    escape = False
                elif c == "\\":
                    escape = True
                elif c == quote:
                    quote = ""
                continue
            if c == "%":
                comment = True
                held.append(" ")
                continue
            if c in "\"'":
                quote = c
            elif c in _OPEN:
                depth += 1
            elif c in _CLOSE:
                depth -= 1
            held.append(c)
            pending = c == "." and depth == 0
    text = "".join(held).strip()
    if pending:
        text = text[:-1].strip()
    if text:
        if not pending:
            raise ParseError(f"unfinished statement: {text[:60]}")
        yield text


def parse_program(text: str | Iterable[str]) -> list[Rule | Query | Directive]:
    out: list[Rule | Query | Directive] = []
    for s in statements([text] if isinstance(text, str) else text):
        if s.startswith(":-"):
            name, _, rest = s[2:].strip().partition(" ")
            prefix = name in ("table", "dynamic") and rest.strip()
            out.append(Directive(Compound(name, (parse_term(rest),)) if prefix else parse_term(s[2:])))
        elif s.startswith("?"):
            out.append(parse_query(s))
        else:
            out.append(as_clause(parse_term(s)))
    return out


def parse_query(text: str) -> Query:
    """``? goals.`` split at its top-level commas before anything else."""
    text = text.strip().removeprefix("?-").removeprefix("?").strip().removesuffix(".")
    return Query(tuple(g for p in split_commas(tokenize(text)) for g in conjuncts(expression(p))))
