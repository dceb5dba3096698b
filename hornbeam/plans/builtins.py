"""Builtin predicates on frames. Each takes (engine, frame, *args), the arguments resolved, and returns a frame or None."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import functions as F

from ..functions.scalars import TermError, as_term, column, compared, number, ordered
from .terms import Atom, Col, Compound, Float, Int, ListTerm, Obj, Str, Term, Var, show, variables


def _fixed(v, kind: str) -> Term:
    return Int(v) if kind == "int" else Float(v)


def is_(e, f, x, expr):
    v, kind = number(expr)
    if isinstance(v, (int, float)):
        return e.unify(f, x, _fixed(v, kind))
    f, c = e.bind(f, v, kind)
    return e.unify(f, x, c)


def _comparison(op):
    def run(e, f, a, b):
        return e.keep(f, compared(op, number(a)[0], number(b)[0]))

    return run


def _order(op):
    def run(e, f, a, b):
        return e.keep(f, ordered(op, a, b))

    return run


def equal(e, f, a, b):
    return e.unify(f, a, b)


def not_unifiable(e, f, a, b):
    if variables(a) or variables(b):
        return None if e.unify(f, a, b) is not None and not (isinstance(a, Compound) and isinstance(b, Compound)) else e._without(Compound("=", (a, b)), f)
    return not_identical(e, f, a, b)


def identical(e, f, a, b):
    if a == b:
        return f
    if isinstance(a, Var) or isinstance(b, Var):
        return None
    return e.unify(f, a, b) if not variables(a) and not variables(b) else None


def not_identical(e, f, a, b):
    if a == b:
        return None
    if variables(a) or variables(b) or not (_cols(a) or _cols(b)):
        return f
    (x, kx), (y, ky) = column(a), column(b)
    if kx == ky:
        return e.keep(f, x != y)
    return e.keep(f, as_term(x, kx) != as_term(y, ky)) if "term" in (kx, ky) else f


def _cols(t) -> bool:
    if isinstance(t, Col):
        return True
    if isinstance(t, Compound):
        return any(map(_cols, t.args))
    return isinstance(t, ListTerm) and any(map(_cols, t.items))


_SORT = {Atom: "atom", Str: "str", Int: "int", Float: "float", Compound: "compound", ListTerm: "compound", Obj: "compound"}


def _type_test(*kinds):
    """A test of the kind of a bound term; a tagged column is tested row by row."""

    def run(e, f, x):
        if isinstance(x, Var):
            return f if "var" in kinds else None
        if isinstance(x, Col) and x.kind == "term":
            tags = {"atom": "a", "str": "s", "int": "i", "float": "f", "compound": "t"}
            return e.keep(f, F.col(x.name).rlike(r"^\$[" + "".join(tags[k] for k in kinds if k in tags) + "]:") if any(k in tags for k in kinds) else F.lit(False))
        kind = ("compound" if x.kind.startswith("list:") else x.kind) if isinstance(x, Col) else "atom" if x == ListTerm(()) and "compound" not in kinds else _SORT[type(x)]
        return f if kind in kinds else None

    return run


def ground_(e, f, x):
    return f if not variables(x) else None


def functor(e, f, t, name, arity):
    if isinstance(t, Var):
        if not isinstance(arity, Int):
            raise TermError("functor/3 needs a bound term or name and arity")
        if arity.value == 0:
            return e.unify(f, t, name)
        if not isinstance(name, Atom):
            raise TermError("functor/3 needs an atom as name")
        return e.unify(f, t, Compound(name.name, tuple(Var(f"_A#{e.fresh()}") for _ in range(arity.value))))
    if isinstance(t, Compound):
        return e.unify(e.unify(f, name, Atom(t.name)), arity, Int(len(t.args)))
    return e.unify(e.unify(f, name, t), arity, Int(0))


def arg(e, f, n, t, a):
    if not isinstance(n, Int) or n.value < 1:
        raise TermError("arg/3 needs a bound index of at least 1")
    if not isinstance(t, Compound):
        raise TermError("arg/3 needs a compound")
    return e.unify(f, a, t.args[n.value - 1]) if n.value <= len(t.args) else None


def univ(e, f, t, parts):
    if isinstance(t, Compound):
        return e.unify(f, parts, ListTerm((Atom(t.name), *t.args)))
    if not isinstance(t, Var):
        return e.unify(f, parts, ListTerm((t,)))
    if not isinstance(parts, ListTerm) or not parts.items or parts.tail is not None:
        raise TermError("=../2 needs a bound term or list")
    head, rest = parts.items[0], parts.items[1:]
    if not rest:
        return e.unify(f, t, head)
    if not isinstance(head, Atom):
        raise TermError("=../2 needs an atom as name")
    return e.unify(f, t, Compound(head.name, rest))


# -- lists


def _plain_list(t) -> bool:
    return isinstance(t, ListTerm) and t.tail is None


def _is_list(t) -> bool:
    return _plain_list(t) or (isinstance(t, Col) and t.kind.startswith("list:"))


def _exploded(e, f, c, kind, position=False):
    """A row for each element of an array column; with its index from 0 if asked for."""
    name, place = e.fresh(), e.fresh()
    rows = e._rows(f)
    df = rows.select("*", F.posexplode(c).alias(place, name)) if position else rows.select("*", F.explode(c).alias(name))
    out = type(f)(df, f.binds)
    return (out, Col(name, kind), Col(place, "int")) if position else (out, Col(name, kind))


def member(e, f, x, items):
    if _plain_list(items):
        kinds = {type(i) for i in items.items}
        if len(items.items) > 1 and len(kinds) == 1 and kinds <= {Atom, Str, Int, Float}:
            c, k = column(items)
            f, v = _exploded(e, f, c, k[5:])
            return e.unify(f, x, v)
        return e._union([e.unify(f, x, i) for i in items.items], f, [*variables(x), *variables(items)])
    if _is_list(items):
        f, v = _exploded(e, f, F.col(items.name), items.kind[5:])
        return e.unify(f, x, v)
    if isinstance(items, (ListTerm, Var)):
        raise TermError("member/2 needs a bound list")
    return None


def append(e, f, a, b, c):
    if _plain_list(a) and (_plain_list(b) or isinstance(b, (Var, ListTerm))):
        return e.unify(f, c, ListTerm(a.items + b.items, b.tail) if isinstance(b, ListTerm) else ListTerm(a.items, b))
    if _is_list(a) and _is_list(b):
        (x, kx), (y, ky) = column(a), column(b)
        kind = kx if kx == ky else "list:term"
        side = lambda v, k: v if k == kind else F.transform(v, lambda z: as_term(z, k[5:]))
        f, v = e.bind(f, F.concat(side(x, kx), side(y, ky)), kind)
        return e.unify(f, c, v)
    if _plain_list(c):
        return e._union([e.unify(e.unify(f, a, ListTerm(c.items[:i])), b, ListTerm(c.items[i:])) for i in range(len(c.items) + 1)], f, [v for t in (a, b, c) for v in variables(t)])
    if _is_list(c):
        whole = F.col(c.name)
        f, n = _exploded(e, f, F.sequence(F.lit(0), F.size(whole)), "int")
        f, left = e.bind(f, F.slice(whole, F.lit(1), F.col(n.name)), c.kind)
        f, right = e.bind(f, F.slice(whole, F.col(n.name) + 1, F.size(whole) - F.col(n.name)), c.kind)
        return e.unify(e.unify(f, a, left), b, right)
    raise TermError("append/3 needs its first or last list bound")


def length(e, f, items, n):
    if _plain_list(items):
        return e.unify(f, n, Int(len(items.items)))
    if _is_list(items):
        f, v = e.bind(f, F.size(F.col(items.name)).cast("long"), "int")
        return e.unify(f, n, v)
    if isinstance(n, Int) and n.value >= 0:
        head, tail = (items.items, items.tail) if isinstance(items, ListTerm) else ((), items)
        if n.value < len(head):
            return None
        return e.unify(f, tail, ListTerm(tuple(Var(f"_L#{e.fresh()}") for _ in range(n.value - len(head)))))
    raise TermError("length/2 needs a bound list or length")


def reverse(e, f, a, b):
    if not _is_list(a):
        a, b = b, a
    if _plain_list(a):
        return e.unify(f, b, ListTerm(a.items[::-1]))
    if _is_list(a):
        f, v = e.bind(f, F.reverse(F.col(a.name)), a.kind)
        return e.unify(f, b, v)
    raise TermError("reverse/2 needs a bound list")


def select(e, f, x, items, rest):
    if _plain_list(items):
        return e._union([e.unify(e.unify(f, x, v), rest, ListTerm(items.items[:i] + items.items[i + 1 :])) for i, v in enumerate(items.items)], f, [v for t in (x, items, rest) for v in variables(t)])
    if _is_list(items):
        whole = F.col(items.name)
        f, v, at = _exploded(e, f, whole, items.kind[5:], True)
        f, r = e.bind(f, F.filter(whole, lambda _, i: i != F.col(at.name)), items.kind)
        return e.unify(e.unify(f, x, v), rest, r)
    if _plain_list(rest):
        return e._union([e.unify(f, items, ListTerm((*rest.items[:i], x, *rest.items[i:]))) for i in range(len(rest.items) + 1)], f, [v for t in (x, items, rest) for v in variables(t)])
    raise TermError("select/3 needs a bound list")


def _nth(base):
    def run(e, f, n, items, x):
        if isinstance(n, Var):
            raise TermError(f"nth{base}/3 needs a bound index")
        if isinstance(n, Int) and _plain_list(items):
            i = n.value - base
            return e.unify(f, x, items.items[i]) if 0 <= i < len(items.items) else None
        if not _is_list(items):
            raise TermError(f"nth{base}/3 needs a bound list")
        c, k = column(items)
        i = (F.lit(n.value) if isinstance(n, Int) else F.col(n.name)).cast("int") - base
        f = e.keep(f, (i >= 0) & (i < F.size(c)))
        f, v = e.bind(f, F.get(c, i), k[5:])
        return e.unify(f, x, v)

    return run


# -- conversions


def _text_of(t):
    """The text of an atom or string, constant or column."""
    if isinstance(t, (Atom, Str)):
        return F.lit(t.name if isinstance(t, Atom) else t.value)
    if isinstance(t, Col) and t.kind in ("atom", "str"):
        return F.col(t.name)
    if isinstance(t, Col) and t.kind == "term":
        return F.regexp_replace(F.col(t.name), r"^\$[as]:", "")
    return None


def _constant(t) -> str | None:
    return t.name if isinstance(t, Atom) else t.value if isinstance(t, Str) else None


_MAKE = {"atom": Atom, "str": Str, "int": Int}


def atom_string(e, f, a, s):
    for x, y, kind in ((a, s, "str"), (s, a, "atom")):
        if (v := _constant(x)) is not None:
            return e.unify(f, y, _MAKE[kind](v))
        if isinstance(x, (Int, Float)):
            return e.unify(f, y, _MAKE[kind](str(x.value)))
        if _text_of(x) is not None:
            f, c = e.bind(f, _text_of(x), kind)
            return e.unify(f, y, c)
    raise TermError("atom_string/2 needs a bound side")


def _letters(whole: str, part: str):
    """atom_chars and its kin: ``whole`` is the kind of the text, ``part`` that of its list's elements."""

    def run(e, f, text, items):
        if (v := _constant(text)) is not None:
            return e.unify(f, items, ListTerm(tuple(_MAKE[part](ord(c) if part == "int" else c) for c in v)))
        c = _text_of(text)
        if c is not None:
            chars = F.filter(F.split(c, ""), lambda x: x != "")
            f, v = e.bind(f, F.transform(chars, lambda x: F.ascii(x).cast("long")) if part == "int" else chars, f"list:{part}")
            return e.unify(f, items, v)
        if _plain_list(items) and not _cols(items) and not variables(items):
            return e.unify(f, text, _MAKE[whole]("".join(chr(i.value) if isinstance(i, Int) else _constant(i) for i in items.items)))
        if _is_list(items):
            c, k = column(items)
            f, v = e.bind(f, F.array_join(F.transform(c, lambda x: F.char(x)) if k == "list:int" else c, ""), whole)
            return e.unify(f, text, v)
        raise TermError("a text or its list must be bound")

    return run


def number_string(e, f, n, s):
    if isinstance(s, (Str, Atom)):
        text = _constant(s).strip()
        try:
            return e.unify(f, n, Int(int(text)))
        except ValueError:
            try:
                return e.unify(f, n, Float(float(text)))
            except ValueError:
                return None
    if isinstance(n, (Int, Float)):
        return e.unify(f, s, Str(repr(n.value)))
    if isinstance(n, Col):
        f, v = e.bind(f, F.col(n.name).cast("string"), "str")
        return e.unify(f, s, v)
    c = _text_of(s)
    if c is None:
        raise TermError("number_string/2 needs a bound side")
    whole = F.trim(c).rlike(r"^[+-]?[0-9]+$")
    tagged = F.when(whole, F.concat(F.lit("$i:"), F.trim(c).try_cast("long").cast("string"))).otherwise(F.concat(F.lit("$f:"), F.trim(c).try_cast("double").cast("string")))
    f, v = e.bind(f, tagged, "term")
    return e.unify(e.keep(f, F.col(v.name).isNotNull()), n, v)


# -- stored graph


def _degree(out: bool, into: bool):
    """Edge counts, parallel edges included; nodes without edges count 0, as does a bound id that is no node."""

    def run(e, f, x, n):
        from .catalog import Relation

        edges, nodes = e.catalog.all_edges(), e.catalog.nodes()
        if edges is None and nodes is None:
            return None if isinstance(x, Var) else e.unify(f, n, Int(0))
        ends = []
        if edges is not None:
            ends = [edges.select(F.col(c).alias("id")) for c, some in (("source", out), ("target", into)) if some]
        if isinstance(x, Atom):
            ends = [d.filter(F.col("id") == x.name) for d in ends]
            counted = reduce(lambda a, b: a.unionAll(b), ends).agg(F.count("*").alias("n")).select(F.lit(x.name), "n")
        else:
            counted = reduce(lambda a, b: a.unionAll(b), ends).groupBy("id").agg(F.count("*").alias("n"))
            if nodes is not None:
                counted = nodes.join(counted, "id", "left").select("id", F.coalesce("n", F.lit(0)).cast("long"))
        return e._join(Relation.of(counted, ["atom", "int"]), (x, n), f, Compound("degree", (x, n)))

    return run


def neighbors(e, f, x, y, kind=None):
    from .catalog import Relation

    edges = e.catalog.all_edges(kind.name if isinstance(kind, Atom) else None)
    if edges is None:
        return None
    rel = Relation.of(edges.select("source", "target", "edge_type"), ["atom"] * 3)
    return e._join(rel, (x, y, kind if kind is not None else Var("_")), f, Atom("neighbors"))


def neighbors3(e, f, x, kind, y):
    return neighbors(e, f, x, y, kind)


def labels(e, f, x, out):
    from .catalog import Relation

    rel = e.catalog.find("label", 2)
    if rel is None:
        return None
    df = rel.df.filter(F.col("c0") == x.name) if isinstance(x, Atom) else rel.df
    return e._join(Relation.of(df.groupBy("c0").agg(F.array_sort(F.collect_set("c1"))), ["atom", "list:atom"]), (x, out), f, Atom("labels"))


def _object_relation(e, x, columns):
    from .catalog import Relation
    from ..operators.graph import node_views

    return Relation.of(node_views(e.catalog, x.name if isinstance(x, Atom) else None).select("id", F.to_json(F.struct(*columns)) if columns != ["properties"] else F.to_json("properties")), ["atom", "str"])


def properties(e, f, x, out):
    return e._join(_object_relation(e, x, ["properties"]), (x, out), f, Atom("properties"))


def node_view(e, f, x, out):
    return e._join(_object_relation(e, x, ["id", "labels", "properties", "out_edges", "in_edges"]), (x, out), f, Atom("node_view"))


def _edge_lists(end: str):
    def run(e, f, x, *rest):
        from .catalog import Relation
        from ..operators.graph import edge_lists

        kind, out = (rest[0], rest[1]) if len(rest) == 2 else (None, rest[0])
        df = edge_lists(e.catalog, end, x.name if isinstance(x, Atom) else None, kind.name if isinstance(kind, Atom) else None, bound=not isinstance(x, Var))
        return e._join(Relation.of(df.select("id", "edge_type", "edges"), ["atom", "atom", "str"]), (x, kind if isinstance(kind, Var) else Var("_"), out), f, Atom("edges"))

    return run


def reachable(e, f, x, y, depth=None):
    from .catalog import Relation
    from ..operators.graph import MAX_DEPTH, reachable_from

    if isinstance(x, Var):
        return None
    limit = depth.value if isinstance(depth, Int) else MAX_DEPTH
    if isinstance(x, Atom) and x == y:
        return f
    starts = e._rows(f).select(F.col(x.name).alias("id")).distinct() if isinstance(x, Col) else e.spark.createDataFrame([(x.name,)], "id string")
    pairs = reachable_from(e.spark, e.catalog.all_edges(), starts, limit)
    return e._join(Relation.of(pairs.select("source", "target"), ["atom", "atom"]), (x, y), f, Atom("reachable"))


def shortest_path(e, f, x, y, path):
    from .catalog import Relation
    from ..operators.graph import MAX_DEPTH, shortest_paths

    if isinstance(x, Var):
        return None
    starts = e._rows(f).select(F.col(x.name).alias("id")).distinct() if isinstance(x, Col) else e.spark.createDataFrame([(x.name,)], "id string")
    found = shortest_paths(e.spark, e.catalog.all_edges(), starts, MAX_DEPTH, y.name if isinstance(x, Atom) and isinstance(y, Atom) else None)
    if isinstance(x, Atom) and x == y:
        return e.unify(f, path, ListTerm((x,)))
    return e._join(Relation.of(found.select("source", "target", "path"), ["atom", "atom", "list:atom"]), (x, y, path), f, Atom("shortest_path"))


# -- introspection and updates


def clause(e, f, head, body):
    """The first rule of a predicate."""
    from .terms import goal_key, rename

    for r in e.rules.get(goal_key(head), [])[:1]:
        s = e.fresh()
        goals = [rename(g, s) for g in r.body] or [Atom("true")]
        whole = reduce(lambda b, a: Compound(",", (a, b)), reversed(goals[:-1]), goals[-1])
        return e.unify(e.unify(f, head, rename(r.head, s)), body, whole)
    return None


def _facts(e, f, rows: list[tuple], kinds: list[str], args, name):
    from .catalog import Relation

    if not rows:
        return None
    types = {"int": "long", "float": "double"}
    df = e.spark.createDataFrame(rows, ", ".join(f"c{i} {types.get(k, 'string')}" for i, k in enumerate(kinds)))
    return e._join(Relation(df, kinds), args, f, Atom(name))


def current_predicate(e, f, spec):
    keys = sorted({*e.rules, *e.catalog.relations, *((k, 1) for k in e.catalog.labels), *((k, 2) for k in e.catalog.edges), *((f"prop_{k}", 2) for k in e.catalog.properties)})
    if isinstance(spec, Compound) and spec.name == "/" and len(spec.args) == 2:
        return _facts(e, f, keys, ["atom", "int"], spec.args, "current_predicate")
    if isinstance(spec, (Atom, Str)):
        text = _constant(spec)
        return f if text in {f"{n}/{a}" for n, a in keys} or text in {n for n, _ in keys} else None
    return _facts(e, f, [(f"{n}/{a}",) for n, a in keys], ["atom"], (spec,), "current_predicate")


def predicate(e, f, name, arity, kind):
    rows = [(*k, "rule") for k in e.rules] + [(*k, "relation") for k in e.catalog.relations] + [(k, 1, "label") for k in e.catalog.labels] + [(k, 2, "edge") for k in e.catalog.edges] + [(f"prop_{k}", 2, "property") for k in e.catalog.properties]
    return _facts(e, f, sorted(rows), ["atom", "int", "atom"], (name, arity, kind), "predicate")


def builtin_predicate(e, f, name, arity, kind):
    from .engine import CONTROL

    return _facts(e, f, sorted({(*k, "control" if k in CONTROL else "builtin") for k in [*e.builtins, *CONTROL]}), ["atom", "int", "atom"], (name, arity, kind), "builtin_predicate")


def rule_(e, f, name, arity, text):
    rows = [(*k, source(r)) for k, rs in sorted(e.rules.items()) for r in rs if r.body]
    return _facts(e, f, rows, ["atom", "int", "str"], (name, arity, text), "rule")


def source(r) -> str:
    """A rule's text, which reads back as the same rule."""
    return show(r.head) + (" :- " + ", ".join(map(show, r.body)) if r.body else "") + "."


def rule_depends_on(e, f, a, b):
    rows = sorted({(f"{k[0]}/{k[1]}", f"{d[0]}/{d[1]}") for k in e.rules for d in e.calls(k)})
    return _facts(e, f, rows, ["atom", "atom"], (a, b), "rule_depends_on")


def rule_reaches(e, f, a, b):
    rows = sorted({(f"{k[0]}/{k[1]}", f"{d[0]}/{d[1]}") for k in e.rules for d in e.reaches(k)})
    return _facts(e, f, rows, ["atom", "atom"], (a, b), "rule_reaches")


def assertz(e, f, t):
    from .parser import as_clause

    if variables(t) and not (isinstance(t, Compound) and t.name == ":-"):
        raise TermError("a fact must be ground")
    e.add(as_clause(t))
    return f


def retract(e, f, t):
    return f if e.retract(show(t)) else None


def retractall(e, f, t):
    from .terms import args_of, goal_key

    e.retract(show(t)) if not all(isinstance(a, Var) for a in args_of(t)) else e.retractall(*goal_key(t))
    return f


BUILTINS = {
    ("is", 2): is_, ("=", 2): equal, ("\\=", 2): not_unifiable, ("==", 2): identical, ("\\==", 2): not_identical,
    **{(op, 2): _comparison(op) for op in ("<", "=<", ">", ">=", "=:=", "=\\=")},
    **{(op, 2): _order(op) for op in ("@<", "@=<", "@>", "@>=")},
    ("var", 1): _type_test("var"), ("nonvar", 1): _type_test("atom", "str", "int", "float", "compound"), ("atom", 1): _type_test("atom"), ("integer", 1): _type_test("int"), ("float", 1): _type_test("float"),
    ("number", 1): _type_test("int", "float"), ("atomic", 1): _type_test("atom", "str", "int", "float"), ("compound", 1): _type_test("compound"), ("string", 1): _type_test("str"), ("ground", 1): ground_,
    ("functor", 3): functor, ("arg", 3): arg, ("=..", 2): univ,
    ("member", 2): member, ("append", 3): append, ("length", 2): length, ("reverse", 2): reverse, ("select", 3): select, ("nth0", 3): _nth(0), ("nth1", 3): _nth(1),
    ("atom_string", 2): atom_string, ("atom_chars", 2): _letters("atom", "atom"), ("string_chars", 2): _letters("str", "atom"), ("atom_codes", 2): _letters("atom", "int"), ("string_codes", 2): _letters("str", "int"), ("number_string", 2): number_string,
    ("out_degree", 2): _degree(True, False), ("in_degree", 2): _degree(False, True), ("degree", 2): _degree(True, True), ("neighbors", 2): neighbors, ("neighbors", 3): neighbors3,
    ("labels", 2): labels, ("properties", 2): properties, ("node_view", 2): node_view, ("out_edges", 2): _edge_lists("source"), ("out_edges", 3): _edge_lists("source"), ("in_edges", 2): _edge_lists("target"), ("in_edges", 3): _edge_lists("target"),
    ("reachable", 2): reachable, ("reachable", 3): reachable, ("shortest_path", 3): shortest_path,
    ("clause", 2): clause, ("current_predicate", 1): current_predicate, ("predicate", 3): predicate, ("builtin_predicate", 3): builtin_predicate, ("rule", 3): rule_, ("rule_depends_on", 2): rule_depends_on, ("rule_reaches", 2): rule_reaches,
    ("assertz", 1): assertz, ("asserta", 1): assertz, ("retract", 1): retract, ("retractall", 1): retractall,
}
