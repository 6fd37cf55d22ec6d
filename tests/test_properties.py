"""Properties of texts, constants and codecs over generated cases."""

import math

from hypothesis import example, given, settings
from hypothesis import strategies as st

from chronolith.lang import ast as A
from chronolith.lang.errors import ParseError
from chronolith.lang.parser import parse_condition, parse_expression, parse_statement, parse_statements
from chronolith.plans.bind import bind, constant_ns, divide, reduce
from chronolith.sources import codecs as C

names = st.text(st.characters(blacklist_categories=("Cs",), blacklist_characters="\x00"), min_size=1, max_size=6)
plain = st.sampled_from(["cpu", "host", "select", "a b", "time", "x_1", "é", 'q"q', "back\\slash", "line\nend"])
ref = st.builds(A.VarRef, names | plain, st.none() | st.sampled_from(A.CASTS))
literal = st.one_of(
    st.builds(lambda v: A.Literal("integer", v), st.integers(0, (1 << 63) - 1)),
    st.builds(lambda v: A.Literal("float", v), st.floats(0.001, 1e6).filter(lambda v: v != int(v))),
    st.builds(lambda v: A.Literal("string", v), st.text(st.characters(blacklist_categories=("Cs",)), max_size=8)),
    st.builds(lambda v: A.Literal("duration", v), st.integers(0, 10**18)),
    st.builds(lambda v: A.Literal("boolean", v), st.booleans()),
)
expression = st.recursive(
    ref | literal,
    lambda e: st.one_of(
        st.builds(A.Nested, e),
        # a left-leaning chain of one level is what its text reads as
        st.builds(lambda a, op, b: A.Binary(A.Nested(a), op, A.Nested(b)), e, st.sampled_from("+-*/%&|^"), e),
        st.builds(A.Call, st.sampled_from(["mean", "count", "my_fn"]), st.lists(e, max_size=3)),
    ),
    max_leaves=6,
)


@settings(max_examples=1000)
@given(expression)
@example(A.Literal("string", '"'))
@example(A.Literal("string", 'a"b\\"\'\n'))
def test_expressions_survive_their_text(e):
    assert parse_expression(str(e)) == e


@given(ref, st.sampled_from(["=", "!=", "<", "<=", ">", ">="]), literal, st.sampled_from(["AND", "OR"]), st.lists(st.sampled_from(["a", "/", ".", "\\\\", "\\w", "+"]), max_size=6).map("".join))
def test_conditions_survive_their_text(r, op, v, logic, pattern):
    c = A.Condition(A.Condition(A.Operand(r), op, A.Operand(v)), logic, A.Group(A.Condition(A.Operand(r), "=~", A.Operand(A.Literal("regex", "x" + pattern)))))
    assert str(parse_condition(str(c))) == str(c)


@given(st.lists(plain, min_size=1, max_size=3), plain, st.integers(0, 10**6), st.integers(0, 10**6), st.booleans())
def test_statements_survive_their_text(fields, source, limit, offset, down):
    s = A.Select(A.Fields([A.Field(A.VarRef(f), f) for f in fields]), A.Sources([A.Source(None, None, A.Name(source))]), order_by=A.OrderBy(down), limit=A.Count("LIMIT", limit), offset=A.Count("OFFSET", offset))
    assert parse_statement(str(s)) == s


@given(st.text(max_size=60) | st.text(alphabet="SELECTFROMWHERE abc=*,()'\"/-1.:;\n", max_size=60))
def test_any_text_parses_or_fails_properly(text):
    try:
        parse_statements(text)
    except ParseError as e:
        assert 0 <= e.pos <= len(text.encode())


@given(st.text(max_size=10), st.integers(-(1 << 62), 1 << 62))
def test_parameters_stay_values(text, number):
    s = bind(parse_statement("SELECT a FROM m WHERE host = $h AND n = $n"), {"h": text, "n": number})
    found = [n for n in (s.where.condition.left.right.expr, s.where.condition.right.right.expr)]
    assert [n.value for n in found] == [text, number]


@given(st.integers(-(10**12), 10**12), st.integers(-(10**6), 10**6))
def test_constant_division(a, b):
    q = divide(a, b)
    assert q == 0 if b == 0 else abs(a - q * b) < abs(b) and (q == 0 or (q > 0) == ((a > 0) == (b > 0)))
    assert reduce(A.Binary(A.Literal("integer", a), "/", A.Literal("integer", b))).value == q


@given(st.integers(-(1 << 62), 1 << 62))
def test_durations_survive_their_text(n):
    assert constant_ns(parse_expression(A.duration_text(n)), 0) == n


@settings(max_examples=200)
@given(st.lists(st.integers(-(1 << 63), (1 << 63) - 1), max_size=40) | st.lists(st.integers(-5, 5), max_size=300))
def test_integers_round_trip(values):
    assert C.decode_integers(C.encode_integers(values)) == values
    assert C.decode_times(C.encode_times(sorted(values))) == sorted(values)
    assert C.count_times(C.encode_times(values)) == len(values)


@given(st.lists(st.floats(allow_nan=False), max_size=60))
def test_floats_round_trip(values):
    got = C.decode_floats(C.encode_floats(values))
    assert got == values and [math.copysign(1, a) for a in got] == [math.copysign(1, a) for a in values]


@given(st.lists(st.text(st.characters(blacklist_categories=("Cs",)), max_size=20), max_size=20), st.lists(st.booleans(), max_size=40))
def test_texts_and_flags_round_trip(texts, flags):
    assert C.decode_strings(C.encode_strings(texts)) == texts and C.decode_booleans(C.encode_booleans(flags)) == flags


@given(st.binary(max_size=40))
def test_damaged_bytes_fail_properly(data):
    for decode in (C.decode_times, C.decode_integers, C.decode_floats, C.decode_booleans):
        if len(data) > 1 and data[0] >> 4 == C.REPEATED:
            continue  # a huge count is valid there
        try:
            decode(data)
        except C.CodecError:
            pass
