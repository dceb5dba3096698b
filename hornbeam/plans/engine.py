"""Goals to DataFrames.

A frame is a DataFrame whose columns are the bound variables of a conjunction.
Each goal extends it: relations join on shared variables, comparisons filter,
negation anti-joins, clauses of one head are a union, and recursive predicates
are semi-naive fixpoints whose rounds are written tables. Nothing is executed
until an answer is read, except those rounds.
"""

from __future__ import annotations

import hashlib
import itertools
import uuid
from collections import OrderedDict
from dataclasses import dataclass, field
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..functions.scalars import TermError, as_term, column, literal, plain
from ..operators.stored import Log
from ..shared import ship, stage_some, stage_table
from .catalog import Catalog, Relation
from .parser import Directive, Query, Rule, as_clause, conjuncts, parse_program, parse_query
from .terms import Atom, Col, Compound, Float, Int, ListTerm, Obj, Str, Term, Var, args_of, goal_key, rename, replace, show, tagged, variables

MAX_ITERATIONS = 10_000
CONTROL = {(",", 2), (";", 2), ("->", 2), ("\\+", 1), ("once", 1), ("true", 0), ("fail", 0), ("false", 0), ("!", 0)}


@dataclass(frozen=True)
class Frame:
    """``df`` is None for the one empty row; ``binds`` maps variables to terms over its columns."""

    df: DataFrame | None = None
    binds: dict[str, Term] = field(default_factory=dict)


#: Answer tables that an engine keeps; the least recently used go first.
MOST_TABLES = 10_000


#: What a rule's step in a proof begins with before its body is solved.
_BEGIN = "begin "


def proof_tree(steps: list[str]) -> list[dict]:
    """Steps in which each rule is begun, then followed by the steps of its body, then named again, as nodes with parents."""
    out: list[dict] = []
    open_: list[int] = []
    for s in steps:
        if s.startswith("rule "):
            open_.pop()
            continue
        kind, _, rest = s.partition(" ")
        what, _, given = rest.partition("(")
        out.append({"id": len(out), "parent": open_[-1] if open_ else None, "kind": "rule" if s.startswith(_BEGIN) else kind, "what": what, "substitution": given[:-1] if given else None})
        if s.startswith(_BEGIN):
            open_.append(len(out) - 1)
    return out


class TableStore:
    """Answer tables in a folder, by call, by the text of the rules behind it and by a version of the stored relations, which the caller names."""

    FORMAT = 1

    def __init__(self, spark: SparkSession, path: str, data_version: str):
        self.spark, self.path, self.data_version = spark, path.rstrip("/"), data_version

    def name(self, call: tuple, rules: dict[tuple[str, int], list[Rule]]) -> str:
        text = repr((self.FORMAT, self.data_version, call, sorted((k, [repr(r) for r in rs]) for k, rs in rules.items())))
        return hashlib.sha256(text.encode()).hexdigest()[:32]

    def get(self, name: str) -> Relation | None:
        n, held = Log(self.spark, f"{self.path}/{name}/log").last()
        if not n:
            return None
        return Relation(self.spark.read.schema(held["schema"]).parquet(f"{self.path}/{name}/{held['rows']}"), held["kinds"])

    def put(self, name: str, rel: Relation) -> None:
        """A table is written under a name of its own, then named by a commit; of two writers the later one is dropped."""
        rows = uuid.uuid4().hex
        rel.df.write.parquet(f"{self.path}/{name}/{rows}")
        schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rel.df.schema)
        try:
            Log(self.spark, f"{self.path}/{name}/log").append(1, {"rows": rows, "schema": schema, "kinds": list(rel.kinds)})
        except ValueError:
            return


class Engine:
    """Rules, facts and stored relations, queried with goals."""

    def __init__(self, spark: SparkSession, catalog: Catalog | None = None, max_answers: int | None = None, tables: TableStore | None = None):
        """``tables`` keeps the answers of tabled and recursive predicates for other sessions over the same data."""
        self.spark, self.catalog = spark, catalog or Catalog(spark)
        self.rules: dict[tuple[str, int], list[Rule]] = {}
        self.tabled: set[tuple[str, int]] = set()
        self.external: dict[tuple[str, int], object] = {}
        self.max_answers = max_answers
        self._ids = itertools.count()
        self._tables: OrderedDict[tuple, tuple[tuple, Relation]] = OrderedDict()
        self.store = tables
        self.directives: dict[str, object] = {}
        self.exhausted: list[str] = []
        #: How often answer tables were computed, found in this engine, or read from the store.
        self.metrics = {"computed": 0, "found": 0, "read": 0}
        self._override: dict[tuple[str, int], Relation] = {}
        self._versions: dict[tuple[str, int], int] = {}
        self._facts: dict[tuple[str, int], tuple[int, Relation | None]] = {}
        self.proving = False
        from .builtins import BUILTINS

        self.builtins = BUILTINS

    # -- programs

    def consult(self, text: str) -> Engine:
        """Adds the rules and facts of a program.

        ``:- table p/n`` marks predicates as tabled, ``:- dynamic p/n`` changes
        nothing; others are given to ``directives`` by name, or ignored.
        """
        return self.load(parse_program(text))

    def load(self, program: list[Rule | Query | Directive]) -> Engine:
        """Adds a program that was read before."""
        for s in program:
            if isinstance(s, Rule):
                self.add(s)
            elif isinstance(s, Directive):
                g = s.goal
                if isinstance(g, Compound) and g.name in self.directives:
                    self.directives[g.name](*g.args)
                    continue
                if isinstance(g, Compound) and g.name == "dynamic":
                    continue
                if isinstance(g, Compound) and g.name == "table":
                    g = g.args[0]
                if isinstance(g, Compound) and g.name == "/" and isinstance(g.args[0], Atom) and isinstance(g.args[1], Int):
                    self.tabled.add((g.args[0].name, g.args[1].value))
            elif isinstance(s, Query):
                raise ValueError("a program has no queries; use query()")
        return self

    def add(self, rule: Rule) -> None:
        key = goal_key(rule.head)
        self.rules.setdefault(key, [])
        if rule.body or rule not in self.rules[key]:
            self.rules[key].append(rule)
        self._versions[key] = self._versions.get(key, 0) + 1

    def assertz(self, text: str | Rule) -> None:
        self.add(text if isinstance(text, Rule) else as_clause(Engine._term(text)))

    def retract(self, text: str) -> int:
        """Removes the clauses equal to the given one; of a fact with variables, all facts that match it. Returns how many went."""
        rule = as_clause(Engine._term(text))
        key = goal_key(rule.head)
        before = self.rules.get(key, [])
        same = (lambda r: r == rule) if rule.body else (lambda r: not r.body and _matches(rule.head, r.head))
        self.rules[key] = [r for r in before if not same(r)]
        gone = len(before) - len(self.rules[key])
        if not self.rules[key]:
            del self.rules[key]
        if gone:
            self._versions[key] = self._versions.get(key, 0) + 1
        return gone

    def retractall(self, name: str, arity: int) -> int:
        gone = len(self.rules.pop((name, arity), []))
        self._versions[name, arity] = self._versions.get((name, arity), 0) + 1
        return gone

    def touch(self, name: str, arity: int) -> None:
        """Marks a stored relation as changed, so that tables that depend on it are computed anew."""
        self._versions[name, arity] = self._versions.get((name, arity), 0) + 1

    @staticmethod
    def _term(text: str) -> Term:
        from .parser import parse_term

        return parse_term(text.strip().removesuffix("."))

    # -- queries

    def query(self, text: str) -> DataFrame:
        """The distinct answers of a query, one column a variable, by name; ``_`` is left out, a query without variables has one column ``success``."""
        names, frame = self._answers(text)
        if frame is None:
            return self._empty([*names] or ["success"])
        if not names:
            df = self._rows(frame)
            return df.limit(1).select(F.lit(True).alias("success"))
        return self._rows(frame).select(*(self._shown(self.resolve(Var(v), frame)).alias(v) for v in names)).distinct()

    def _answers(self, text: str) -> tuple[list[str], Frame | None]:
        goals = parse_query(text).goals
        goal = reduce(lambda a, b: Compound(",", (b, a)), reversed(goals))
        return sorted(v for v in variables(goal) if v != "_"), self.solve_all(goals, Frame())

    def ask(self, text: str) -> bool:
        return not self.query(text).isEmpty()

    def aggregate(self, text: str, by: list[str], **aggs: Column) -> DataFrame:
        """Groups a query's distinct answers; an extension of the language."""
        return self.query(text).groupBy(*by).agg(*(c.alias(k) for k, c in aggs.items()))

    def _proved(self, text: str) -> DataFrame:
        self.proving = True
        try:
            names, frame = self._answers(text)
        finally:
            self.proving = False
        if frame is None:
            return self.spark.createDataFrame([], ", ".join([*(f"`{n}` string" for n in names), "proof array<string>"]))
        df = self._rows(frame)
        proof = F.col("__proof") if "__proof" in df.columns else F.array().cast("array<string>")
        return df.select(*(self._shown(self.resolve(Var(v), frame)).alias(v) for v in names), proof.alias("proof"))

    def prove(self, text: str) -> DataFrame:
        """The answers with ``proof``: for each derivation, the facts, rules and builtins it used, in order."""
        return self._proved(text).withColumn("proof", F.filter("proof", lambda x: ~x.startswith(_BEGIN)))

    def prove_tree(self, text: str) -> DataFrame:
        """The answers with ``proof`` as a tree: (id, parent, kind, what, substitution) of each step, the query's goals having no parent.

        ``kind`` is rule, fact, builtin or index; ``what`` is the clause (its
        predicate and place) or the predicate, ``substitution`` the arguments of
        a fact. Steps are numbered from the root.
        """
        ship(self.spark)

        @F.pandas_udf("array<struct<id:int,parent:int,kind:string,what:string,substitution:string>>")
        def tree(steps: pd.Series) -> pd.Series:
            return steps.map(lambda x: proof_tree(list(x)))

        return self._proved(text).withColumn("proof", tree("proof"))

    def explain(self, text: str) -> list[dict]:
        """For each goal: its predicate, what each argument is when it is reached, the access path, and whether a bound argument is pushed into it."""
        seen: set[str] = set()
        out = []
        for g in parse_query(text).goals:
            key = goal_key(g)
            modes = ["bound" if all(v in seen for v in variables(a)) else "free" for a in args_of(g)]
            out.append({"goal": show(g), "predicate": f"{key[0]}/{key[1]}", "arguments": modes, "access": self.access_path(key, modes), "pushed_down": "bound" in modes and (key in self.rules or key not in self.builtins)})
            seen.update(variables(g))
        return out

    def access_path(self, key: tuple[str, int], modes: list[str]) -> str:
        name, arity = key
        if key in self.rules:
            return "table" if self.recursive(key) or key in self.tabled else "rule"
        if key in self.external:
            return "index"
        if key in self.builtins or key in CONTROL:
            return "builtin"
        if name in ("node", "label") or (arity == 1 and name in self.catalog.labels):
            return "label_scan" if modes[:1] != ["bound"] else "node_lookup"
        if name == "property" or name.startswith("prop_"):
            return "entity_property" if modes[:1] == ["bound"] else "property_index" if modes[-1:] == ["bound"] else "property_scan"
        if arity in (2, 3, 4) and (name in self.catalog.edges or name in ("edge", "edge_id")):
            return "outgoing_edges" if modes[:1] == ["bound"] else "incoming_edges" if "bound" in modes else "edge_scan"
        return "relation_scan" if self.catalog.find(name, arity) else "undefined"

    def _empty(self, names: list[str]) -> DataFrame:
        return self.spark.createDataFrame([], ", ".join(f"`{n}` string" for n in names))

    def _rows(self, frame: Frame) -> DataFrame:
        return frame.df if frame.df is not None else self.spark.range(1).select(F.lit(1).alias("__unit"))

    def _shown(self, t: Term) -> Column:
        if isinstance(t, Var):
            return F.lit(None).cast("string")
        if isinstance(t, Compound):
            return F.to_json(F.struct(F.lit(t.name).alias("name"), F.array(*(self._shown(a).cast("string") for a in t.args)).alias("args")))
        if isinstance(t, Obj):
            return F.to_json(F.struct(*(self._shown(v).alias(k) for k, v in t.items)))
        return plain(*column(t))

    # -- unification

    def fresh(self) -> str:
        return f"_{next(self._ids)}"

    def resolve(self, t: Term, frame: Frame) -> Term:
        return replace(t, lambda v: self.resolve(frame.binds[v.name], frame) if v.name in frame.binds else v)

    def keep(self, frame: Frame, test: Column | bool) -> Frame | None:
        if isinstance(test, bool):
            return frame if test else None
        return Frame(self._rows(frame).filter(test), frame.binds)

    def bind(self, frame: Frame, c: Column, kind: str) -> tuple[Frame, Col]:
        """The frame with one more column."""
        name = self.fresh()
        return Frame(self._rows(frame).withColumn(name, c), frame.binds), Col(name, kind)

    def unify(self, frame: Frame | None, a: Term, b: Term) -> Frame | None:
        if frame is None:
            return None
        a, b = self.resolve(a, frame), self.resolve(b, frame)
        if a == b:
            return frame
        if isinstance(b, Var):
            a, b = b, a
        if isinstance(a, Var):
            return Frame(frame.df, {**frame.binds, a.name: b})
        if isinstance(b, Col):
            a, b = b, a
        if isinstance(a, Col):
            if isinstance(b, ListTerm) and a.kind.startswith("list:"):
                return self._unify_list(frame, a, b)
            if isinstance(b, (Compound, Obj, ListTerm)) and a.kind != "term":
                return None
            if isinstance(b, Compound) and variables(b):
                raise TermError("a column can't be taken apart into a compound with variables")
            (x, kx), (y, ky) = column(a), column(b)
            if kx == ky:
                return self.keep(frame, x == y)
            return self.keep(frame, as_term(x, kx) == as_term(y, ky)) if "term" in (kx, ky) else None
        if isinstance(a, Compound) and isinstance(b, Compound) and a.name == b.name and len(a.args) == len(b.args):
            for x, y in zip(a.args, b.args):
                frame = self.unify(frame, x, y)
            return frame
        if isinstance(a, ListTerm) and isinstance(b, ListTerm):
            if not a.items and a.tail is not None:
                return self.unify(frame, a.tail, b)
            if not b.items and b.tail is not None:
                return self.unify(frame, a, b.tail)
            if not a.items or not b.items:
                return frame if a.items == b.items and a.tail is b.tail is None else None
            rest = lambda t: ListTerm(t.items[1:], t.tail)
            return self.unify(self.unify(frame, a.items[0], b.items[0]), rest(a), rest(b))
        if isinstance(a, Obj) and isinstance(b, Obj) and [k for k, _ in a.items] == [k for k, _ in b.items]:
            for (_, x), (_, y) in zip(a.items, b.items):
                frame = self.unify(frame, x, y)
            return frame
        return None

    def _unify_list(self, frame: Frame, a: Col, b: ListTerm) -> Frame | None:
        c, n = F.col(a.name), len(b.items)
        out: Frame | None = self.keep(frame, F.size(c) == n if b.tail is None else F.size(c) >= n)
        for i, item in enumerate(b.items):
            out, e = self.bind(out, F.element_at(c, i + 1), a.kind[5:])
            out = self.unify(out, item, e)
            if out is None:
                return None
        if b.tail is not None:
            out, e = self.bind(out, F.slice(c, n + 1, F.greatest(F.size(c) - n, F.lit(0))), a.kind)
            out = self.unify(out, b.tail, e)
        return out

    # -- solving

    def solve_all(self, goals: tuple[Term, ...], frame: Frame | None) -> Frame | None:
        for i, g in enumerate(goals):
            if frame is None:
                return None
            if g == Atom("!"):
                frame = self._first(Frame(), frame)
                continue
            frame = self.solve(g, frame)
        return frame

    def solve(self, goal: Term, frame: Frame) -> Frame | None:
        goal = self.resolve(goal, frame)
        if isinstance(goal, Var):
            raise TermError(f"{goal.name} is unbound where a goal is expected")
        key = goal_key(goal)
        args = args_of(goal)
        if key == (",", 2):
            return self.solve_all(conjuncts(goal), frame)
        if key == ("true", 0):
            return frame
        if key in (("fail", 0), ("false", 0)):
            return None
        if key == (";", 2):
            return self._union([self.solve(a, frame) for a in args], frame, variables(goal))
        if key == ("->", 2):
            return self.solve_all((Compound("once", (args[0],)), args[1]), frame)
        if key == ("once", 1):
            out = self.solve(args[0], frame)
            return None if out is None else self._first(frame, out)
        if key == ("\\+", 1):
            return self._without(args[0], frame)
        if key[0] == "call" and key[1] >= 1:
            g = args[0]
            return self.solve(Compound(goal_key(g)[0], (*args_of(g), *args[1:])) if len(args) > 1 else g, frame)
        if key in self._override:
            return self._join(self._override[key], args, frame, goal)
        if key in self.rules:
            if self.recursive(key) or (key in self.tabled and not self.proving):
                return self._join(self._fixpoint(key, args), args, frame, goal)
            return self._clauses(key, args, frame)
        if key in self.builtins:
            out = self.builtins[key](self, frame, *args)
            return self._noted(out, f"builtin {key[0]}/{key[1]}")
        if key in self.external:
            return self.external[key](self, frame, *args)
        rel = self.catalog.find(*key, {i: a.name for i, a in enumerate(args) if isinstance(a, Atom)})
        return None if rel is None else self._join(rel, args, frame, goal)

    def _noted(self, frame: Frame | None, what: str | Column) -> Frame | None:
        if frame is None or not self.proving:
            return frame
        df = self._rows(frame)
        step = F.array(F.lit(what) if isinstance(what, str) else what)
        return Frame(df.withColumn("__proof", F.concat("__proof", step) if "__proof" in df.columns else step), frame.binds)

    def _join(self, rel: Relation, args: tuple[Term, ...], frame: Frame, goal: Term) -> Frame | None:
        """The frame joined with a relation: constants filter it, shared columns are equated, free variables are bound to its columns."""
        names = [self.fresh() for _ in rel.kinds]
        df = rel.df.select(*(F.col(f"c{i}").alias(n) for i, n in enumerate(names)))
        binds, on, used, later = dict(frame.binds), [], [], []
        first: dict[str, tuple[str, str]] = {}
        for name, kind, a in zip(names, rel.kinds, args):
            a = self.resolve(a, frame)
            if isinstance(a, Var):
                if a.name in first:
                    other, k = first[a.name]
                    if k != kind and "term" not in (k, kind):
                        return None
                    df = df.filter(F.col(other) == F.col(name) if k == kind else as_term(F.col(other), k) == as_term(F.col(name), kind))
                else:
                    first[a.name] = (name, kind)
                    if a.name != "_":
                        binds[a.name] = Col(name, kind)
                    used.append(name)
            elif isinstance(a, Col):
                if a.kind != kind and "term" not in (a.kind, kind):
                    return None
                left, right = (F.col(a.name), F.col(name)) if a.kind == kind else (as_term(F.col(a.name), a.kind), as_term(F.col(name), kind))
                on.append(left == right)
            elif isinstance(a, (Atom, Str, Int, Float)):
                value, k = literal(a)
                if k != kind and kind != "term":
                    return None
                df = df.filter(F.col(name) == (value if k == kind else F.lit(tagged(a))))
            else:
                later.append((a, Col(name, kind)))
                used.append(name)
        if "_" in first:
            used = [u for u in used if u != first["_"][0]]
        if frame.df is None or (not on and frame.df.columns == ["__unit"]):
            out = Frame(df, binds)
        elif on:
            out = Frame(frame.df.join(df, reduce(lambda x, y: x & y, on)).select(*frame.df.columns, *used), binds)
        else:
            out = Frame(frame.df.crossJoin(df.select(*used) if used else df.limit(1).select()), binds)
        for a, c in later:
            out = self.unify(out, a, c)
        if out is not None and self.proving:
            shown = [self._shown(self.resolve(a, out)).cast("string") if not isinstance(a, Var) or a.name in out.binds else F.lit("_") for a in args]
            out = self._noted(out, F.concat(F.lit(f"fact {goal_key(goal)[0]}("), F.concat_ws(", ", *shown), F.lit(")")))
        return out

    def _clauses(self, key: tuple[str, int], args: tuple[Term, ...], frame: Frame) -> Frame | None:
        """The union of the clauses of a head, each with the frame's bindings passed in; after a cut, later clauses see only rows it didn't reach."""
        parts: list[Frame | None] = []
        start = frame
        facts = self._fact_relation(key)
        rules = self.rules[key]
        if facts is not None:
            parts.append(self._join(facts, args, frame, Compound(key[0], args) if args else Atom(key[0])))
            rules = [r for r in rules if r.body]
        for k, r in enumerate(rules, 1):
            s = str(next(self._ids))
            out: Frame | None = frame
            for a, h in zip(args, args_of(rename(r.head, s))):
                out = self.unify(out, a, h)
            body = tuple(rename(g, s) for g in r.body)
            out = self._noted(out, f"{_BEGIN}{key[0]}/{key[1]}#{k}")
            if out is not None and Atom("!") in body:
                i = body.index(Atom("!"))
                reached = self.solve_all(body[:i], out)
                if reached is not None:
                    reached = self._first(out, reached)
                    parts.append(self._noted(self.solve_all(body[i + 1 :], reached), f"rule {key[0]}/{key[1]}#{k}"))
                    rows = [c for c in out.df.columns if c != "__proof"] if out.df is not None else []
                    left = self._rows(frame)
                    gone = self._rows(reached).select(*(F.col(c).alias(f"{c}~") for c in rows if c in left.columns)).distinct()
                    shared = [c for c in rows if c in left.columns]
                    frame = Frame(left.join(gone, reduce(lambda x, y: x & y, [F.col(c).eqNullSafe(F.col(f"{c}~")) for c in shared], F.lit(True)), "left_anti"), frame.binds)
                continue
            parts.append(self._noted(self.solve_all(body, out), f"rule {key[0]}/{key[1]}#{k}"))
        return self._union(parts, start, [v for a in args for v in variables(a)])

    def _fact_relation(self, key: tuple[str, int]) -> Relation | None:
        """Facts of one predicate whose arguments are constants as one local relation."""
        at = self._versions.get(key, 0)
        if key in self._facts and self._facts[key][0] == at:
            return self._facts[key][1]
        rows = [args_of(r.head) for r in self.rules[key] if not r.body]
        rel = None
        if len(rows) > 1 and key[1] and all(isinstance(a, (Atom, Str, Int, Float)) for row in rows for a in row):
            kinds = []
            for i in range(key[1]):
                found = {literal_kind(row[i]) for row in rows}
                kinds.append(found.pop() if len(found) == 1 else "term")
            types = {"int": "long", "float": "double"}
            data = [tuple(tagged(a) if k == "term" else a.name if isinstance(a, Atom) else a.value for a, k in zip(row, kinds)) for row in rows]
            rel = Relation(self.spark.createDataFrame(data, ", ".join(f"c{i} {types.get(k, 'string')}" for i, k in enumerate(kinds))), kinds)
        self._facts[key] = (at, rel)
        return rel

    def _union(self, parts: list[Frame | None], frame: Frame, visible: list[str]) -> Frame | None:
        """One frame of several that extend ``frame``: variables bound in any become columns, null where a branch leaves them free."""
        found = [p for p in parts if p is not None]
        if not found:
            return None
        if len(found) == 1:
            return found[0]
        base = frame.df.columns if frame.df is not None else []
        own = [v for v in dict.fromkeys(visible) if v != "_"]
        own += [v for v in self._open_vars(frame, found) if v not in own]
        kinds: dict[str, str] = {}
        values: list[dict[str, Term]] = []
        for p in found:
            row = {v: self.resolve(Var(v), p) for v in own}
            values.append(row)
        own = [v for v in own if any(not isinstance(row[v], Var) for row in values)]
        for v in own:
            ks = {column(row[v])[1] for row in values if not variables(row[v]) and row[v] != ListTerm(())} or {"list:term"}
            empty = any(row[v] == ListTerm(()) for row in values)
            kinds[v] = ks.pop() if len(ks) == 1 and (not empty or next(iter(ks)).startswith("list:")) else "term"
        cols = {v: self.fresh() for v in own}
        types = {"int": "long", "float": "double"}
        dfs = []
        proof = any("__proof" in self._rows(p).columns for p in found)
        for p, row in zip(found, values):
            df = self._rows(p)
            out = [F.col(c) for c in base]
            for v in own:
                if variables(row[v]):
                    t = types.get(kinds[v], "string") if not kinds[v].startswith("list:") else f"array<{types.get(kinds[v][5:], 'string')}>"
                    out.append(F.lit(None).cast(t).alias(cols[v]))
                elif row[v] == ListTerm(()) and kinds[v].startswith("list:"):
                    out.append(F.array().cast(f"array<{types.get(kinds[v][5:], 'string')}>").alias(cols[v]))
                else:
                    c, k = column(row[v])
                    out.append((c if k == kinds[v] else as_term(c, k)).alias(cols[v]))
            if proof and "__proof" not in base:
                out.append((F.col("__proof") if "__proof" in df.columns else F.array().cast("array<string>")).alias("__proof"))
            dfs.append(df.select(*out) if out else df.select(F.lit(1).alias("__unit")))
        return Frame(reduce(DataFrame.unionAll, dfs), {**frame.binds, **{v: Col(cols[v], kinds[v]) for v in own}})

    def _open_vars(self, frame: Frame, found: list[Frame]) -> list[str]:
        """Variables inside terms that the frame had bound to something open."""
        return [v for t in frame.binds.values() for v in variables(self.resolve(t, frame))]

    def _first(self, frame: Frame, out: Frame) -> Frame:
        """One solution for each row of ``frame``: the smallest by the columns that are new."""
        df = self._rows(out)
        keys = [c for c in (frame.df.columns if frame.df is not None else []) if c in df.columns]
        new = [c for c in df.columns if c not in keys]
        if not keys:
            return Frame(df.orderBy(*new).limit(1) if new else df.limit(1), out.binds)
        n = self.fresh()
        w = W.partitionBy(*keys).orderBy(*(new or keys))
        return Frame(df.withColumn(n, F.row_number().over(w)).filter(F.col(n) == 1).drop(n), out.binds)

    def _without(self, goal: Term, frame: Frame) -> Frame | None:
        """Negation as failure: rows for which the goal has no solution; its own variables stay free."""
        if frame.df is None:
            proving, self.proving = self.proving, False
            out = self.solve(goal, frame)
            self.proving = proving
            return frame if out is None or self._rows(out).isEmpty() else None
        keys = sorted({c for c in _columns(self.resolve(goal, frame))})
        base = frame.df.select(*keys).distinct() if keys else None
        proving, self.proving = self.proving, False
        out = self.solve(goal, Frame(base, frame.binds))
        self.proving = proving
        if out is None:
            return frame
        if not keys:
            return Frame(frame.df.join(self._rows(out).limit(1).select(F.lit(1).alias(self.fresh())), F.lit(True), "left_anti"), frame.binds)
        gone = self._rows(out).select(*(F.col(k).alias(f"{k}~") for k in keys)).distinct()
        return Frame(frame.df.join(gone, reduce(lambda x, y: x & y, [F.col(k).eqNullSafe(F.col(f"{k}~")) for k in keys]), "left_anti"), frame.binds)

    # -- recursion

    def calls(self, key: tuple[str, int]) -> set[tuple[str, int]]:
        """Predicates that a predicate's rules call, also inside control goals."""
        out: set[tuple[str, int]] = set()

        def walk(g: Term) -> None:
            if isinstance(g, Var):
                return
            k = goal_key(g)
            if k in CONTROL or k[0] == "call":
                for a in args_of(g):
                    if isinstance(a, (Atom, Compound)):
                        walk(a)
            else:
                out.add(k)

        for r in self.rules.get(key, []):
            for g in r.body:
                walk(g)
        return out

    def reaches(self, key: tuple[str, int]) -> set[tuple[str, int]]:
        seen: set[tuple[str, int]] = set()
        todo = [key]
        while todo:
            for k in self.calls(todo.pop()):
                if k not in seen:
                    seen.add(k)
                    todo.append(k)
        return seen

    def recursive(self, key: tuple[str, int]) -> bool:
        return key in self.reaches(key)

    def component(self, key: tuple[str, int]) -> set[tuple[str, int]]:
        """The predicates that call each other in a cycle with this one."""
        return {k for k in self.reaches(key) if key in self.reaches(k)} | {key}

    def _fixpoint(self, key: tuple[str, int], args: tuple[Term, ...]) -> Relation:
        """The answers of a tabled or recursive predicate, kept until a rule or relation it depends on changes."""
        consts = {i: a for i, a in enumerate(args) if isinstance(a, (Atom, Str, Int, Float))}
        scc = self.component(key)
        clauses = {k: [Rule(r.head, r.body) for r in self.rules[k]] for k in scc}
        if scc == {key}:
            clauses[key] = [_linear(_left_linear(r, key, self.rules[key]), key, self.rules[key], consts) for r in clauses[key]]
            stable = {i: c for i, c in consts.items() if all(_keeps(r, key, i) for r in clauses[key])}
        else:
            stable = {}
        state = tuple(sorted((k, self._versions.get(k, 0)) for k in self.reaches(key) | scc))
        call = (key, tuple(sorted((i, tagged(c)) for i, c in stable.items())))
        if call in self._tables and self._tables[call][0] == state:
            self._tables.move_to_end(call)
            self.metrics["found"] += 1
            return self._tables[call][1]
        name = self.store.name(call, {k: self.rules.get(k, []) for k in self.reaches(key) | scc}) if self.store is not None else None
        if name is not None and (held := self.store.get(name)) is not None:
            self._tables[call] = (state, held)
            self.metrics["read"] += 1
            return held
        for r in (r for rs in clauses.values() for r in rs):
            if any(_negates(g, scc) for g in r.body):
                raise TermError(f"negation of {key[0]}/{key[1]} through itself")
        if stable:
            clauses[key] = [_specialised(r, key, stable) for r in clauses[key]]
            clauses[key] = [r for r in clauses[key] if r is not None]
        found = self._semi_naive(scc, clauses)
        self.metrics["computed"] += 1
        for k, rel in found.items():
            where = call if k == key else (k, ())
            if rel is not None and (k == key or not stable):
                self._tables[where] = (state if k == key else tuple(sorted((x, self._versions.get(x, 0)) for x in self.reaches(k) | scc)), rel)
                while len(self._tables) > MOST_TABLES:
                    self._tables.popitem(last=False)
        if name is not None and found.get(key) is not None:
            self.store.put(name, found[key])
        return self._tables[call][1] if found.get(key) is not None else Relation(self._empty([f"c{i}" for i in range(key[1])]), ["term"] * key[1])

    def _semi_naive(self, scc: set[tuple[str, int]], clauses: dict[tuple[str, int], list[Rule]]) -> dict[tuple[str, int], Relation | None]:
        before = dict(self._override)
        proving, self.proving = self.proving, False
        kinds: dict[tuple[str, int], list[str]] = {}
        done: dict[tuple[str, int], list[DataFrame]] = {k: [] for k in scc}
        try:
            delta: dict[tuple[str, int], DataFrame] = {}
            for k in scc:
                base = [self._heads(r) for r in clauses[k] if not any(goal_key(g) in scc for g in _goals(r.body))]
                base = [b for b in base if b is not None]
                if base:
                    kinds[k] = [ks.pop() if len(ks := {b.kinds[i] for b in base}) == 1 else "term" for i in range(k[1])]
                    delta[k] = stage_table(self.spark, reduce(DataFrame.unionAll, [_cast(b, kinds[k]) for b in base]).distinct(), "delta")
                    done[k].append(delta[k])
            for round_ in range(MAX_ITERATIONS + 1):
                if round_ == MAX_ITERATIONS:
                    raise RuntimeError("maximum table iterations exceeded")
                new: dict[tuple[str, int], list[DataFrame]] = {}
                for k in scc:
                    for r in clauses[k]:
                        for i, g in enumerate(r.body):
                            at = goal_key(g) if isinstance(g, (Atom, Compound)) else None
                            if at not in scc or at not in delta:
                                continue
                            self._override = {**before, **{x: Relation(reduce(DataFrame.unionAll, done[x]), kinds[x]) for x in scc if done[x]}}
                            mark = (f"$delta:{at[0]}", at[1])
                            self._override[mark] = Relation(delta[at], kinds[at])
                            for x in scc:
                                self._override.setdefault(x, Relation(self._empty([f"c{j}" for j in range(x[1])]), ["term"] * x[1]))
                            # The changed goal goes first: it is the small side.
                            body = (Compound(mark[0], args_of(g)) if args_of(g) else Atom(mark[0]), *r.body[:i], *r.body[i + 1 :])
                            out = self._heads(Rule(r.head, body if all(_movable(x) for x in r.body[:i]) else (*r.body[:i], body[0], *r.body[i + 1 :])))
                            if out is not None:
                                kinds.setdefault(k, out.kinds)
                                new.setdefault(k, []).append(_cast(out, kinds[k]))
                delta = {}
                for k, parts in new.items():
                    rows = reduce(DataFrame.unionAll, parts).distinct()
                    if done[k]:
                        rows = rows.join(reduce(DataFrame.unionAll, done[k]), [f"c{i}" for i in range(k[1])], "left_anti")
                    rows = stage_some(self.spark, rows, "delta")
                    if rows is not None:
                        delta[k] = rows
                        done[k].append(rows)
                        if len(done[k]) > 12:
                            done[k] = [stage_table(self.spark, reduce(DataFrame.unionAll, done[k]).coalesce(max(1, self.spark.sparkContext.defaultParallelism)), "table")]
                if not delta:
                    break
                if self.max_answers is not None and any(reduce(DataFrame.unionAll, done[k]).count() > self.max_answers for k in delta):
                    raise RuntimeError("maximum table answers exceeded")
        finally:
            self._override = before
            self.proving = proving
        return {k: Relation(reduce(DataFrame.unionAll, done[k]), kinds[k]) if done[k] else None for k in scc}

    def _heads(self, r: Rule) -> Relation | None:
        """The head rows of a clause; answers that leave a head variable open are dropped."""
        s = str(next(self._ids))
        head = rename(r.head, s)
        frame = self.solve_all(tuple(rename(g, s) for g in r.body), Frame())
        if frame is None:
            return None
        args = [self.resolve(a, frame) for a in args_of(head)]
        if any(variables(a) for a in args):
            return None
        cols = [column(a) for a in args]
        return Relation(self._rows(frame).select(*(c.alias(f"c{i}") for i, (c, _) in enumerate(cols))), [k for _, k in cols])


def literal_kind(t: Term) -> str:
    return literal(t)[1]


def _cast(rel: Relation, kinds: list[str]) -> DataFrame:
    return rel.df.select(*((F.col(f"c{i}") if a == b else as_term(F.col(f"c{i}"), a)).alias(f"c{i}") for i, (a, b) in enumerate(zip(rel.kinds, kinds))))


def _columns(t: Term) -> list[str]:
    if isinstance(t, Col):
        return [t.name]
    if isinstance(t, (Compound, ListTerm)):
        items = t.args if isinstance(t, Compound) else (*t.items, *([t.tail] if t.tail is not None else []))
        return [c for a in items for c in _columns(a)]
    if isinstance(t, Obj):
        return [c for _, a in t.items for c in _columns(a)]
    return []


def _goals(body: tuple[Term, ...]) -> list[Term]:
    out: list[Term] = []
    for g in body:
        if isinstance(g, Var):
            continue
        if goal_key(g) in CONTROL and args_of(g):
            out += _goals(args_of(g))
        else:
            out.append(g)
    return out


def _negates(g: Term, scc: set[tuple[str, int]], inside: bool = False) -> bool:
    if isinstance(g, Var):
        return False
    k = goal_key(g)
    if k in scc:
        return inside
    return k in CONTROL and any(_negates(a, scc, inside or k == ("\\+", 1)) for a in args_of(g))


def _movable(g: Term) -> bool:
    """Whether a goal is a plain relation, which may come after the one that changed."""
    from .builtins import BUILTINS

    return isinstance(g, (Atom, Compound)) and goal_key(g) not in CONTROL and goal_key(g) not in BUILTINS


def _keeps(r: Rule, key: tuple[str, int], i: int) -> bool:
    """Whether every recursive call of a clause passes the head's argument i on unchanged."""
    calls = [g for g in _goals(r.body) if goal_key(g) == key]
    return not calls or all(args_of(g)[i] == args_of(r.head)[i] and isinstance(args_of(g)[i], Var) for g in calls)


def _specialised(r: Rule, key: tuple[str, int], consts: dict[int, Term]) -> Rule | None:
    head = args_of(r.head)
    swap: dict[str, Term] = {}
    for i, c in consts.items():
        if isinstance(head[i], Var):
            if swap.setdefault(head[i].name, c) != c:
                return None
        elif head[i] != c:
            return None
    f = lambda t: replace(t, lambda v: swap.get(v.name, v))
    return Rule(f(r.head), tuple(f(g) for g in r.body))


def _left_linear(r: Rule, key: tuple[str, int], rules: list[Rule]) -> Rule:
    """p(X,Y) :- e(X,Z), p(Z,Y) as p(X,Y) :- p(X,Z), e(Z,Y), where the only other clause is p(X,Y) :- e(X,Y)."""
    if key[1] != 2 or len(rules) != 2 or len(r.body) != 2:
        return r
    base = next((x for x in rules if len(x.body) == 1), None)
    e, p = r.body
    if base is None or not all(isinstance(t, Compound) and len(t.args) == 2 and all(isinstance(a, Var) for a in t.args) for t in (r.head, e, p, base.head, base.body[0])):
        return r
    if base.body[0].args != base.head.args or base.body[0].name != e.name or p.name != key[0] or e.name == key[0]:
        return r
    (x, y), (ex, ez), (pz, py) = r.head.args, e.args, p.args
    if (ex, ez, py) != (x, pz, y) or len({x, y, ez}) != 3:
        return r
    return Rule(r.head, (Compound(p.name, (x, ez)), Compound(e.name, (ez, y))))


def _linear(r: Rule, key: tuple[str, int], rules: list[Rule], bound: dict[int, Term]) -> Rule:
    """p(X,Y) :- p(X,Z), p(Z,Y), where the only other clause is p(X,Y) :- e(X,Y), with e for the p that doesn't hold the bound argument.

    So the bound argument is passed on; a free call keeps its rounds of doubling.
    """
    if not bound or key[1] != 2 or len(rules) != 2 or len(r.body) != 2:
        return r
    base = next((x for x in rules if len(x.body) == 1), None)
    a, b = r.body
    if base is None or not all(isinstance(t, Compound) and len(t.args) == 2 and all(isinstance(v, Var) for v in t.args) for t in (r.head, a, b, base.head, base.body[0])):
        return r
    e = base.body[0].name
    if base.body[0].args != base.head.args or a.name != key[0] or b.name != key[0] or e == key[0]:
        return r
    (x, y), (ax, az), (bz, by) = r.head.args, a.args, b.args
    if (ax, az, by) != (x, bz, y) or len({x, y, az}) != 3 or "_" in (x.name, y.name, az.name):
        return r
    return Rule(r.head, (a, Compound(e, b.args)) if 0 in bound else (Compound(e, a.args), b))


def _matches(pattern: Term, fact: Term, seen: dict[str, Term] | None = None) -> bool:
    seen = {} if seen is None else seen
    if isinstance(pattern, Var):
        return pattern.name == "_" or seen.setdefault(pattern.name, fact) == fact
    if isinstance(pattern, Compound) and isinstance(fact, Compound) and pattern.name == fact.name and len(pattern.args) == len(fact.args):
        return all(_matches(a, b, seen) for a, b in zip(pattern.args, fact.args))
    return pattern == fact
