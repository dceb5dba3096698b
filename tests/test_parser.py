import pytest

from hornbeam.plans.builtins import source
from hornbeam.plans.parser import ParseError, Rule, as_clause, parse_program, parse_query, parse_term, statements
from hornbeam.plans.terms import Atom, Compound, Float, Int, ListTerm, Obj, Str, Var, show


@pytest.mark.parametrize(
    "text, shown",
    [
        ("a -> b ; c", "'->'(a, ';'(b, c))"),
        ("10 - 2 - 3", "'-'('-'(10, 2), 3)"),
        ("a // b * c", "'//'(a, '*'(b, c))"),
        ("7 mod 3 mod 2", "mod(7, mod(3, 2))"),
        ("7 mod -3", "mod(7, -3)"),
        ("1 + 2 * 3", "'+'(1, '*'(2, 3))"),
        ("p(X, [a, b|T], {k: 1.5})", "p(X, [a, b|T], {k: 1.5})"),
        ("X \\= Y", "'\\\\='(X, Y)"),
    ],
)
def test_operators_are_split(text, shown):
    assert show(parse_term(text)) == shown


def test_constants_keep_their_kind():
    assert [parse_term(t) for t in ("a", '"a"', "1", "1.0", "'A b'", "[]")] == [Atom("a"), Str("a"), Int(1), Float(1.0), Atom("A b"), ListTerm(())]
    assert parse_term("{a: X}") == Obj((("a", Var("X")),))


def test_query_splits_at_commas_first():
    assert parse_query("? a, b ; c.").goals == (Atom("a"), Compound(";", (Atom("b"), Atom("c"))))


def test_statements_stream_across_chunks():
    assert list(statements(["p(a). % no. end\nq('x.", "y', 1.5", "). r :- s."])) == ["p(a)", "q('x.y', 1.5)", "r :- s"]
    with pytest.raises(ParseError):
        list(statements(["p(a"]))


def test_rules_read_back():
    rule = as_clause(parse_term("r(X) :- p(X, \"a\\\"b\"), '>'(X, 1)"))
    assert isinstance(rule, Rule)
    assert parse_program(source(rule)) == [rule]


@pytest.mark.parametrize("bad", ["p(", "p(a))", "", "f()", "{a}"])
def test_bad_terms_are_refused(bad):
    with pytest.raises(ParseError):
        parse_term(bad)


def test_plain_facts_need_no_parser(monkeypatch):
    from hornbeam.plans import parser
    from hornbeam.sources import graph_files

    texts = ["'placed'('c:1', 'o:2')", "'rich'('c:1')", "''('', '')", "'x'('a % b', 'c. d')", "'o'('(', ')')"]
    odd = ["'x'('a\\'b', 'c')", "'prop_k'('a', 'b')", "placed(a, b)", "'x'('a','b')", "'node'('a', ['l'], {\"k\": 1})"]
    assert not any(graph_files._PLAIN.fullmatch(t) for t in odd)
    fast, slow = graph_files.facts_of_statements(texts + odd), []
    with monkeypatch.context() as m:
        m.setattr(graph_files, "_PLAIN", __import__("re").compile("(?!)"))
        slow = graph_files.facts_of_statements(texts + odd)
    assert fast == slow
    monkeypatch.setattr(parser, "parse_term", lambda t: 1 / 0)
    assert graph_files.facts_of_statements(texts)[1] == ("rich", "c:1", None, None)

