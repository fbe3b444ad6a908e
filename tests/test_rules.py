import pytest

from ruleloom.plans import analysis, rewrites
from ruleloom.plans.rules import Atom, Const, Var, alpha_equivalent, substitute, unify
from ruleloom.plans.text import ParseError, parse_atom, parse_program, parse_rule


def test_both_arrows_parse_equal():
    a = parse_rule("ships(?who, ?port) <- [docked(?port, ?who, 2.5), crew(?who, ?who), !sunk(?who)]")
    b = parse_rule("[docked(?port, ?who, 2.5), crew(?who, ?who), !sunk(?who)] -> ships(?who, ?port)")
    assert a == b and a.body[0] == Atom("docked", (Var("port"), Var("who"), Const(2.5))) and a.body[2] == Atom("sunk", (Var("who"),), False)


def test_terms():
    assert parse_atom('p(?x, -4.1, -5, abc1, rdf:type, "a \\"b\\" .", true, _)').terms == (Var("x"), Const(-4.1), Const(-5), Const("abc1"), Const("rdf:type"), Const('a "b" .'), Const(True), Const("_"))
    assert parse_atom("t()").terms == ()
    assert Const(1) != Const(1.0) and Const(1) != Const(True) and Const("1") != Const(1)


def test_rules_print_as_they_parse():
    for rule in parse_program('h(?x, "a b") <- [a(?x, 1), !b(?x)] # note\n e(1, 2) <- []'):
        assert parse_rule(str(rule)) == rule


@pytest.mark.parametrize(("text", "line", "column"), [("p(?x) <- q(?x)", 1, 10), ("p(?x)\n<- [q(?x) r(?x)]", 2, 11), ("p(?x <- []", 1, 6), ("p(%) <- []", 1, 3)])
def test_errors_have_positions(text, line, column):
    with pytest.raises(ParseError) as e:
        parse_rule(text)
    assert e.value.position == (line, column)


def test_alpha_equivalence():
    same = lambda x, y: alpha_equivalent(parse_rule(x), parse_rule(y))
    assert same("far(?from, 9, ?to) <- [hop(?from, ?via), !shut(?via), hop(?via, ?to)]", "far(?a, 9, ?c) <- [hop(?a, ?b), !shut(?b), hop(?b, ?c)]")
    assert not same("far(?a, ?b) <- [hop(?a, ?b)]", "far(?a, ?b) <- [hop(?b, ?a)]") and not same("far(?a, ?a) <- [hop(?a, ?a)]", "far(?a, ?b) <- [hop(?a, ?b)]")
    assert not same("on(?a) <- [lamp(?a)]", "on(?a) <- [lamp(?a), lamp(?a)]") and not same("on(1) <- []", "on(1.0) <- []")
    assert alpha_equivalent(parse_atom("!off(?q, x)"), parse_atom("!off(?r, x)")) and not alpha_equivalent(parse_atom("!off(?q)"), parse_atom("off(?q)")) and not alpha_equivalent(parse_atom("on(?q)"), parse_rule("on(?q) <- [lamp(?q)]"))


def test_unify_and_substitute():
    assert unify(parse_atom("p(?x, ?y, ?x, 3)"), (1, 2, 1, 3)) == {Var("x"): Const(1), Var("y"): Const(2)}
    assert unify(parse_atom("p(?x, ?x)"), (1, 2)) is None and unify(parse_atom("p(?x)"), (1, 2)) is None and unify(parse_atom("p(1)"), (True,)) is None
    assert substitute(parse_atom("p(?x, ?y)"), {Var("x"): Const(7)}) == parse_atom("p(7, ?y)")


def test_safety():
    for text in ("h(?x, ?y) <- [a(?x)]", "h(?x) <- [a(?x), !b(?y)]", "h(?x) <- []"):
        with pytest.raises(analysis.UnsafeRuleError):
            analysis.check_safety(parse_program(text))


def test_negative_cycles_are_refused():
    for text in ("win(?x) <- [move(?x, ?y), !win(?y)]", "raining() <- [clouds(), !dry()] dry() <- [shelter(), raining()]"):
        with pytest.raises(analysis.NotStratifiableError):
            analysis.strata(parse_program(text))
    groups = lambda text: [g for g, _ in analysis.strata(parse_program(text))]
    assert groups("idle(?m) <- [staff(?m), !busy(?m)] busy(?m) <- [task(?m, ?t), !done(?t)] done(?t) <- [report(?t)]") == [["done"], ["busy"], ["idle"]]
    assert groups("left(?x) <- [right(?x)] right(?x) <- [middle(?x)] middle(?x) <- [left(?x)] end(?x) <- [middle(?x), !start(?x)]") == [["left", "middle", "right"], ["end"]]


def test_schemas():
    known = {"q": ("bigint", "string")}
    assert analysis.infer_schemas(parse_program("p(?y, 1.5, ?x) <- [q(?x, ?y)] r(?x) <- [p(?x, ?y, ?z)]"), known)["p"] == ("string", "double", "bigint")
    with pytest.raises(analysis.SchemaConflictError):
        analysis.infer_schemas(parse_program("p(?x) <- [q(?x, ?y)] p(?y) <- [q(?x, ?y)]"), known)
    with pytest.raises(analysis.SchemaConflictError):
        analysis.infer_schemas(parse_program("p(?x) <- [q(?x)]"), known)


def test_specialised_constants():
    program = rewrites.specialised(parse_program("owns(?x) <- [S(?x, has, car), S(ann, ?x, ?y), !S(?x, has, ?x)] S(?x, is, ?y) <- [S(?y, has, ?x)]"))
    assert list(map(str, program)) == [
        "owns(?x) <- [S__has_car(?x), S_ann(?x, ?y), !S(?x, \"has\", ?x)]",
        "S(?x, \"is\", ?y) <- [S__has(?y, ?x)]",
        'S__has_car(?x0) <- [S(?x0, "has", "car")]',
        'S_ann(?x1, ?x2) <- [S("ann", ?x1, ?x2)]',
        'S__has(?x0, ?x2) <- [S(?x0, "has", ?x2)]',
    ]
    assert [r.view for r in program] == [False, False, True, True, True]


def test_goals_are_pushed_where_recursion_passes_them_on():
    up = "over(?x, ?y, ?k) <- [boss(?x, ?y, ?k)] over(?x, ?z, ?k) <- [boss(?x, ?y, ?j), over(?y, ?z, ?k)]"
    pushed = lambda goal, text=up: list(map(str, rewrites.narrowed(parse_program(text), parse_atom(goal))))
    assert pushed("over(?a, eve, ?b)") == ['over(?x, "eve", ?k) <- [boss(?x, "eve", ?k)]', 'over(?x, "eve", ?k) <- [boss(?x, ?y, ?j), over(?y, "eve", ?k)]']
    assert pushed("over(ann, ?y, 3)") == ["over(?x, ?y, 3) <- [boss(?x, ?y, 3)]", "over(?x, ?z, 3) <- [boss(?x, ?y, ?j), over(?y, ?z, 3)]"]
    assert pushed("over(ann, ?y, ?z)") == pushed("over(?x, ?y, ?z)") == list(map(str, parse_program(up)))
    other = up + " top(?x) <- [over(?x, ?y, 1)]"
    assert pushed("over(?a, eve, ?b)", other) == list(map(str, parse_program(other)))
    assert pushed("is(?x, big)", "is(?x, small) <- [mouse(?x)] is(?x, big) <- [whale(?x)]") == ['is(?x, "big") <- [whale(?x)]']
