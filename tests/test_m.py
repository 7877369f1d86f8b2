import pytest
from hypothesis import given
from hypothesis import strategies as st

from weftline.m import MSyntaxError, from_json, parse, to_json
from weftline.m import nodes as N

leaf = st.one_of(
    st.integers(0, 10**6).map(N.Lit), st.text("ab \"#é\n", max_size=6).map(N.Lit), st.sampled_from([True, False, None]).map(N.Lit),
    st.sampled_from(["x", "Table.A", "#date", "y z"]).map(N.Ident), st.sampled_from(["A", "Order Date"]).map(lambda f: N.FieldAccess(None, f)),
)


def inner(child):
    few = st.lists(child, max_size=3).map(tuple)
    return st.one_of(
        few.map(N.ListExpr), st.tuples(st.sampled_from(["+", "-", "*", "/", "&", "=", "<", "and", "or", "??"]), child, child).map(lambda t: N.BinOp(*t)),
        st.tuples(child, child, child).map(lambda t: N.If(*t)), child.map(lambda b: N.Lambda(("_",), b)), st.tuples(child, child).map(lambda t: N.TryExpr(*t)),
        few.map(lambda a: N.Invoke(N.Ident("f"), a)), st.lists(st.tuples(st.sampled_from(["a", "b c"]), child), min_size=1, max_size=3).map(lambda f: N.RecordExpr(tuple(f))),
        st.tuples(st.lists(st.tuples(st.sampled_from(["s", "t u"]), child), min_size=1, max_size=2), child).map(lambda t: N.LetExpr(tuple(t[0]), t[1])),
    )


def name(s):
    return s if s.replace(".", "").replace("#", "").isidentifier() else f'#"{s}"'


def show(n):
    if isinstance(n, N.Lit):
        return {True: "true", False: "false", None: "null"}[n.value] if n.value is None or isinstance(n.value, bool) else str(n.value) if isinstance(n.value, int) else '"' + n.value.replace("#", "#(#)").replace('"', '""').replace("\n", "#(lf)") + '"'
    if isinstance(n, N.Ident):
        return name(n.name)
    if isinstance(n, N.FieldAccess):
        return f"[{n.field}]"
    if isinstance(n, N.ListExpr):
        return "{" + ", ".join(map(show, n.items)) + "}"
    if isinstance(n, N.RecordExpr):
        return "[" + ", ".join(f"{k} = {show(v)}" for k, v in n.fields) + "]"
    if isinstance(n, N.BinOp):
        return f"(({show(n.left)}) {n.op} ({show(n.right)}))"
    if isinstance(n, N.If):
        return f"(if {show(n.cond)} then {show(n.then)} else {show(n.orelse)})"
    if isinstance(n, N.Lambda):
        return f"(each {show(n.body)})"
    if isinstance(n, N.TryExpr):
        return f"(try {show(n.body)} otherwise {show(n.otherwise)})"
    if isinstance(n, N.Invoke):
        return f"f({', '.join(map(show, n.args))})"
    return "(let " + ", ".join(f"{name(k)} = {show(v)}" for k, v in n.steps) + f" in {show(n.body)})"


@given(st.recursive(leaf, inner, max_leaves=12))
def test_parse_reads_what_is_shown(node):
    assert parse(show(node)) == node


@given(st.recursive(leaf, inner, max_leaves=12))
def test_json_round_trip(node):
    assert from_json(to_json(node)) == node


def test_precedence():
    assert parse("not a = b") == N.BinOp("=", N.UnaryOp("not", N.Ident("a")), N.Ident("b"))
    assert parse("1 + 2 * 3 & x ?? y") == N.BinOp("??", N.BinOp("&", N.BinOp("+", N.Lit(1), N.BinOp("*", N.Lit(2), N.Lit(3))), N.Ident("x")), N.Ident("y"))


@pytest.mark.parametrize("text", ["", "let a = 1", "(1", "f(1,", "a b", '"open', "{1", "[a = ]"])
def test_bad_text_is_refused(text):
    with pytest.raises(MSyntaxError):
        parse(text)


def test_types_comments_and_quoted_names():
    n = parse('let #"a b" = /* c */ type nullable text, // d\n f = (x as number, optional y) as any => x in #"a b"')
    assert n.steps[0] == ("a b", N.TypeLit("nullable text"))
    assert n.steps[1][1] == N.Lambda(("x", "y"), N.Ident("x"))
