"""Terms of the rule language. Atoms and strings, like integers and floats, are different constants."""

from __future__ import annotations

import json
from dataclasses import dataclass
from typing import Union


@dataclass(frozen=True)
class Var:
    name: str


@dataclass(frozen=True)
class Atom:
    name: str


@dataclass(frozen=True)
class Str:
    value: str


@dataclass(frozen=True)
class Int:
    value: int


@dataclass(frozen=True)
class Float:
    value: float


@dataclass(frozen=True)
class Compound:
    name: str
    args: tuple["Term", ...]


@dataclass(frozen=True)
class ListTerm:
    items: tuple["Term", ...]
    tail: "Term | None" = None


@dataclass(frozen=True)
class Obj:
    items: tuple[tuple[str, "Term"], ...]


@dataclass(frozen=True)
class Col:
    """A column of the current frame: kind is atom, str, int, float, term (tagged text) or list:kind."""

    name: str
    kind: str


Term = Union[Var, Atom, Str, Int, Float, Compound, ListTerm, Obj, Col]
TAGS = {"atom": "$a:", "str": "$s:", "int": "$i:", "float": "$f:"}


def goal_key(t: Term) -> tuple[str, int]:
    if isinstance(t, Compound):
        return t.name, len(t.args)
    if isinstance(t, Atom):
        return t.name, 0
    raise ValueError(f"not a goal: {show(t)}")


def args_of(t: Term) -> tuple[Term, ...]:
    return t.args if isinstance(t, Compound) else ()


def variables(t: Term) -> list[str]:
    """Variable names in order of appearance, each once."""
    out: dict[str, None] = {}

    def walk(x: Term) -> None:
        if isinstance(x, Var):
            out.setdefault(x.name)
        elif isinstance(x, Compound):
            for a in x.args:
                walk(a)
        elif isinstance(x, ListTerm):
            for a in (*x.items, *([x.tail] if x.tail is not None else [])):
                walk(a)
        elif isinstance(x, Obj):
            for _, a in x.items:
                walk(a)

    walk(t)
    return list(out)


def rename(t: Term, suffix: str) -> Term:
    """The term with fresh variables."""
    return replace(t, lambda v: Var(f"{v.name}#{suffix}"))


def replace(t: Term, f) -> Term:
    if isinstance(t, Var):
        return f(t)
    if isinstance(t, Compound):
        return Compound(t.name, tuple(replace(a, f) for a in t.args))
    if isinstance(t, ListTerm):
        return ListTerm(tuple(replace(a, f) for a in t.items), None if t.tail is None else replace(t.tail, f))
    if isinstance(t, Obj):
        return Obj(tuple((k, replace(a, f)) for k, a in t.items))
    return t


def ground(t: Term) -> bool:
    return not variables(t)


def _atom_text(name: str) -> str:
    plain = name and (name[0].islower() and all(c.isalnum() or c == "_" for c in name)) or name in ("[]", "!")
    return name if plain else "'" + name.replace("\\", "\\\\").replace("'", "\\'") + "'"


def show(t: Term) -> str:
    """Source text that reads back as the same term."""
    if isinstance(t, Var):
        return t.name
    if isinstance(t, Atom):
        return _atom_text(t.name)
    if isinstance(t, Str):
        return json.dumps(t.value, ensure_ascii=False)
    if isinstance(t, (Int, Float)):
        return repr(t.value)
    if isinstance(t, Compound):
        return f"{_atom_text(t.name)}({', '.join(map(show, t.args))})"
    if isinstance(t, ListTerm):
        return "[" + ", ".join(map(show, t.items)) + (f"|{show(t.tail)}" if t.tail is not None else "") + "]"
    if isinstance(t, Obj):
        return "{" + ", ".join(f"{k}: {show(v)}" for k, v in t.items) + "}"
    return f"<{t.name}>"


def tagged(t: Term) -> str:
    """The text by which a constant is compared where kinds are mixed."""
    if isinstance(t, Atom):
        return TAGS["atom"] + t.name
    if isinstance(t, Str):
        return TAGS["str"] + t.value
    if isinstance(t, Int):
        return TAGS["int"] + str(t.value)
    if isinstance(t, Float):
        return TAGS["float"] + repr(t.value)
    return "$t:" + show(t)
