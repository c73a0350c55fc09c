"""Per-text structural tokenizer: FIXTURES §2 goldens (Python 3.13) and option semantics."""
import ast
import itertools
import os

import pytest

from shapeindex.config import DEFAULT_OPTIONS, TokenizerOptions
from shapeindex.functions import pyast
from shapeindex.functions.pyast import analyze, dump_text, terms_of
from shapeindex.plans.fixtures import NODES, TEMPLATES, TERMS, template_text

T0_POS0 = ("Assign(targets=[Name(ctx=Store())], value=Call(func=Attribute(value=Name(ctx=Load()), attr='load', "
           "ctx=Load()), args=[], keywords=[]), type_comment=None)")
T2_POS4 = ("Call(func=Attribute(value=Attribute(value=Name(ctx=Load()), attr='items', ctx=Load()), attr='append', "
           "ctx=Load()), args=[Name(ctx=Load())], keywords=[])")
T7_POS1 = ("Expr(value=Call(func=Attribute(value=Name(ctx=Load()), attr='fast', ctx=Load()), "
           "args=[Constant(value=3, kind=None)], keywords=[]))")
T7_POS2 = ("ExceptHandler(type=Name(ctx=Load()), body=[Expr(value=Call(func=Attribute(value=Name(ctx=Load()), "
           "attr='warn', ctx=Load()), args=[Name(ctx=Load())], keywords=[])), Raise(exc=None, cause=None)])")


@pytest.mark.parametrize("t", sorted(NODES))
def test_template_counts(t):
    p = analyze(template_text(t, 7), DEFAULT_OPTIONS)
    assert len(p) == NODES[t]
    assert sum(h is not None for h in p.term_hash) == TERMS[t]
    assert len({h for h in p.term_hash if h is not None}) == TERMS[t]


def test_invalid_template_raises():
    with pytest.raises(SyntaxError):
        analyze(template_text(3, 1), DEFAULT_OPTIONS)


def test_term_text_goldens():
    assert terms_of(template_text(0, 1), DEFAULT_OPTIONS)[0] == T0_POS0
    assert terms_of(template_text(2, 1), DEFAULT_OPTIONS)[4] == T2_POS4
    t7 = terms_of(template_text(7, 1), DEFAULT_OPTIONS)
    assert t7[1] == T7_POS1 and t7[2] == T7_POS2


def test_root_types():
    def roots(t):
        p = analyze(template_text(t, 1), DEFAULT_OPTIONS)
        return [p.node_type[i] for i in range(len(p)) if p.term_hash[i] is not None]
    assert roots(2) == ["ClassDef", "FunctionDef", "For", "Expr", "Call"]
    assert roots(7) == ["Try", "Expr", "ExceptHandler", "Expr"]
    assert roots(1) == ["FunctionDef", "Return", "BinOp"]


def test_type_depth_height_of_t0():
    p = analyze(template_text(0, 1), DEFAULT_OPTIONS)
    assert " ".join(p.node_type) == ("Module Assign Name Store Call Attribute Name Load Load Assign Name Store "
                                     "BinOp Name Load Add Constant")
    assert list(zip(p.depth, p.height)) == [(0, 5), (1, 4), (2, 1), (3, 0), (2, 3), (3, 2), (4, 1), (5, 0), (4, 0),
                                            (1, 3), (2, 1), (3, 0), (2, 2), (3, 1), (4, 0), (3, 0), (3, 0)]


@pytest.mark.parametrize("src,height,terms", [
    ("x = 1", 2, 0), ("x = f()", 3, 0), ("x = f(1)", 3, 0), ("x = a.f()", 4, 1), ("x = f(a.b)", 4, 1),
    ("f(x)(y)", 4, 1), ("def f(): pass", 1, 0), ("def f(x): return x", 3, 0), ("def f(x): return x - 2", 4, 1),
    ("if a.b: pass", 3, 0), ("if a.b.c: pass", 4, 1), ("import os", 1, 0), ("x = [a.b for a in c]", 4, 1),
    ("with a.b() as c: pass", 5, 2)])
def test_statement_heights(src, height, terms):
    p = analyze(src, DEFAULT_OPTIONS)
    assert p.height[1] == height
    assert sum(h is not None for h in p.term_hash) == terms


def test_name_rule():
    h = lambda s: [x for x in analyze(s, DEFAULT_OPTIONS).term_hash if x is not None]
    assert h("v = cfg.load()") == h("zz = other.load()")
    assert h("v = cfg.load()") != h("v = cfg.save()")


def test_repeated_term_positions():
    p = analyze("a.go()\nb.go()\n", DEFAULT_OPTIONS, with_text=True)
    terms = [(p.pos[i], p.term_hash[i]) for i in range(len(p)) if p.term_hash[i] is not None]
    assert [t[0] for t in terms] == [0, 1] and terms[0][1] == terms[1][1]
    assert p.term_text[1].startswith("Expr(value=Call(")


def test_hash_equality_matches_text_equality():
    """The bottom-up hash distinguishes exactly what the printed dump distinguishes."""
    srcs = list(TEMPLATES.values()) + ["x = a.f(1)", "x = a.f('1')", "x = a.f(1.0)", "y = b.f(1)",
                                       "x = [a.f, b.g]", "x = (a.f, b.g)", "del a.b[c]", "a.b += c.d"]
    by_hash, by_text = {}, {}
    for s in srcs:
        try:
            p = analyze(s.replace("{k}", "1"), DEFAULT_OPTIONS, with_text=True)
        except SyntaxError:
            continue
        for h, t in zip(p.term_hash, p.term_text):
            if h is not None:
                by_hash.setdefault(h, set()).add(t)
                by_text.setdefault(t, set()).add(h)
    assert all(len(v) == 1 for v in by_hash.values())
    assert all(len(v) == 1 for v in by_text.values())


def test_options_annotate_fields_false_ignores_drops():
    o = TokenizerOptions(annotate_fields=False)
    t = terms_of("v = cfg.load()", o)[0]
    assert t.startswith("Assign([Name('v', Store())], Call(Attribute(Name('cfg', Load()), 'load', Load()), [], [])")


def test_options_max_depth_prints_type_names():
    o = TokenizerOptions(max_depth=6)
    t = terms_of("v = cfg.load()", o)[0]
    assert "Name(ctx=Load)" in t or "ctx=Load" in t
    with pytest.raises(AssertionError):
        TokenizerOptions(min_depth=4, max_depth=3)


def test_options_include_attributes():
    o = TokenizerOptions(include_attributes=True)
    t = terms_of("v = cfg.load()", o)[0]
    assert "lineno=1, col_offset=0" in t


def test_options_drop_field_values():
    o = TokenizerOptions(drop_field_values=frozenset({"None"}))
    t = terms_of("v = cfg.load()", o)[0]
    assert "type_comment" not in t


def test_parse_failures_are_reported():
    for src, exc in [("-" * 20000 + "1", (MemoryError, RecursionError, SyntaxError)),
                     ("a" + ".b" * 20000, (RecursionError, MemoryError, SyntaxError)),
                     ("x = 1\x00", (SyntaxError, ValueError))]:
        with pytest.raises(exc):
            analyze(src, DEFAULT_OPTIONS)


# ------------------------------------------------------------------ dumps made from the leaves up

OPTIONS = [TokenizerOptions(annotate_fields=a, include_attributes=i, drop_field_values=d, drop_field_names=n, min_depth=m, max_depth=x)
           for a, i, d, n, (m, x) in itertools.product((True, False), (True, False), (frozenset(), frozenset({"None", "[]"})), (frozenset(), frozenset({"id", "arg", "name"})),
                                                      ((None, None), (None, 0), (None, 1), (2, 4), (4, 30)))]


def plain_dump(value, o, depth=0):
    """The definition of a dump, top down."""
    if o.max_depth is not None and depth > o.max_depth:
        return type(value).__name__
    if isinstance(value, list):
        return "[" + ", ".join(plain_dump(x, o, depth + 1) for x in value) + "]"
    if not isinstance(value, ast.AST):
        return repr(value)
    shown = [(f, plain_dump(v, o, depth + 1)) for f, v in ast.iter_fields(value)]
    if o.annotate_fields:
        shown = [f"{f}={t}" for f, t in shown if f not in o.drop_field_names and t not in o.drop_field_values]
    else:
        shown = [t for _, t in shown]
    text = type(value).__name__ + "(" + ", ".join(shown)
    if o.include_attributes and value._attributes:
        text += (", " if list(ast.iter_fields(value)) else " ") + ", ".join(f"{a}={plain_dump(getattr(value, a), o, depth + 1)}" for a in value._attributes)
    return text + ")"


@pytest.mark.parametrize("k", range(len(OPTIONS)))
def test_dumps_equal_the_definition(k):
    o = OPTIONS[k]
    sources = [t.replace("{k}", "1") for n, t in TEMPLATES.items() if n != 3]
    for name in ("bisect.py",):
        with open(os.path.join(os.path.dirname(os.__file__), name), encoding="utf-8") as f:
            sources.append(f.read())
    for source in sources:
        tree = ast.parse(source)
        for node in ast.walk(tree):
            if isinstance(node, ast.stmt):
                assert dump_text(node, o) == plain_dump(node, o)
        p = analyze(source, o, with_text=True)
        texts = [t for t in p.term_text if t is not None]
        assert len(texts) == p.n_terms
        assert len({(h, c) for h, c in zip(p.term_hash, p.term_check) if h is not None}) == len({h for h in p.term_hash if h is not None}) == len(set(texts))


@pytest.mark.parametrize("o", [TokenizerOptions(), TokenizerOptions(include_attributes=True), TokenizerOptions(max_depth=6), TokenizerOptions(max_depth=5000),
                               TokenizerOptions(drop_field_values=frozenset({"None"})), TokenizerOptions(annotate_fields=False)])
def test_deep_trees_and_long_integers_under_all_options(o):
    """Neither the depth of a tree nor the length of a number makes a valid file invalid."""
    deep = "x = a" + ".b" * 2000
    p = analyze(deep, o, with_text=True)
    assert p.n_terms and all(p.term_text[i] for i in range(len(p)) if p.term_hash[i] is not None)
    number = int("f" * 4000, 16)
    p = analyze(f"x = a.f(0x{'f' * 4000})", o, with_text=True)
    digits = next(t for t in p.term_text if t)
    if o.max_depth is None or o.max_depth > 6:
        found = digits[digits.index("Constant(") :].split("value=")[-1] if o.annotate_fields else digits[digits.index("Constant(") + 9 :]
        head, value = found.split(",")[0].split(")")[0], 0
        for i in range(0, len(head), 4000):  # the interpreter reads no longer number at once
            value = value * 10 ** len(head[i : i + 4000]) + int(head[i : i + 4000])
        assert value == number


@pytest.mark.parametrize("min_depth", [None, 1, 2, 4])
def test_counts_and_types_are_those_of_the_analysis(min_depth):
    opts = TokenizerOptions(min_depth=min_depth, drop_node_names=frozenset({"Module", "Call"}))
    for text in ("", "x", "a.b(c, *d, e=-1)[2:3] = not f and g or h < i <= j", "@d\nclass A(B, m=C):\n    def f[T](self, /, *a: b, **k) -> c:\n        global z\n        return lambda: (yield)",
                 "match x:\n    case [1, *y] if z: pass\n    case {'a': _, **r}: del y", "async def f():\n    async with a as b: x += [i async for i in f'{i!r:>{w}}']"):
        p = pyast.analyze(text, opts)
        assert pyast.counts(text, opts) == (len(p), p.n_terms)
        assert pyast.node_types(text, opts) == (len(p), p.n_terms, p.node_type)
        assert pyast.node_types(text, opts, terms_only=True) == (len(p), p.n_terms, [p.node_type[i] for i in p.term_at])


def test_index_records_are_those_of_the_full_analysis():
    """The index's own pass numbers, hashes and picks nodes as the full analysis and ``_line_nodes`` do."""
    from shapeindex.operators.terms import _line_nodes

    texts = [template_text(t, 7) for t in NODES] + [
        "", "pass", "x = []\n", "a" + " + a" * 1500, "f(x)(y)(z)(\n1)\n", "lambda: (yield)", "a < b < c and not d", "s = 'é'\nf'{a!r:>{w}}'\n",
        "match a:\n case {1: 2, **r}:\n  pass\n case [a, *b] | c if d:\n  x.y.z()\n case A(1, k=2):\n  break_(y)\n",
        "async def f[T](a, /, *b, c=1, **d) -> int:\n  async with x as y, z:\n    await q\n  return {**a, 1: -2}\n",
        "def f():\n  while a:\n    if b: continue\n    else: break\n  def g():\n    return (1,\n 2,\n [k for k in x\n if k])\n"]
    for opts in (DEFAULT_OPTIONS, TokenizerOptions(min_depth=2), TokenizerOptions(min_depth=3, drop_field_names=frozenset(), drop_node_names=frozenset())):
        assert pyast.has_index_records(opts)
        for text in texts:
            p = analyze(text, opts)
            kept = _line_nodes(p)
            columns = tuple([column[i] for i in kept] for column in (range(len(p)), p.size, p.lineno, p.term_hash, p.first_term_hash))
            positions = {}
            for at, i in enumerate(p.term_at):
                positions.setdefault(p.term_hash[i], []).append(at)
            assert pyast.index_records(text, opts) == (len(p), p.n_terms, columns, positions), text
    assert not pyast.has_index_records(TokenizerOptions(min_depth=1)) and not pyast.has_index_records(TokenizerOptions(max_depth=5))
    with pytest.raises(SyntaxError):
        pyast.index_records(template_text(3, 1), DEFAULT_OPTIONS)
