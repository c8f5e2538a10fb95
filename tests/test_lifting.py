import json

import pytest
from pyspark.sql import functions as F

from sigweave.operators import detection, lifting
from sigweave.operators.lifting import MEMBER, METHODS, OPERAND, STATEMENTS, VALUE

PLAT, APP, PH, INT = ("java.util.List", "platform"), ("app.A", "app"), ("ph.P", "phantom"), ("int", None)
loc = lambda t: (t, None)
const = lambda x: (None, x)
method = lambda owner, name, ret, *params, idx=None: (owner, name, ret, list(params), idx)


def value(kind, text=None, op=None, index=None, type=None, base=None, args=None, member=None):
    return (kind, text, op, index, type, base, args, member)


CASES = [
    (value("local", args=[loc(APP)]), "<#>", ["app.A"]),
    (value("local", args=[loc(PLAT)]), "<java.util.List>", []),
    (value("local", args=[loc(("app.A[]", None))]), "<app.A[]>", []),
    (value("constant", text='"x"'), '"x"', []),
    (value("binop", op=" + ", args=[loc(INT), const("1")]), "<int> + 1", []),
    (value("field", base=loc(APP), member=(APP, "f", PH, None, None)), "<#>.<#: # #>", ["app.A", "app.A", None]),
    (value("field", member=(PLAT, "size", INT, None, None)), "<java.util.List: int size>", []),
    (value("invoke", op="virtual", base=loc(APP), args=[loc(PH), const("2")], member=method(APP, "go", PLAT, PH, INT, idx=3)), "virtualinvoke <#>.<#: java.util.List #(#,int)>(<#>,2)", ["app.A", "app.A", None, None]),
    (value("invoke", op="static", args=[], member=method(PLAT, "of", PLAT)), "staticinvoke <java.util.List: java.util.List of()>()", []),
    (value("invoke", op="strange", args=[], member=method(PLAT, "of", PLAT)), "invoke <java.util.List: java.util.List of()>()", []),
    (value("this"), "@this", []),
    (value("parameter", index=2, type=APP), "@parameter2: #", ["app.A"]),
    (value("caughtexception"), "@caughtexception", []),
    (value("cast", type=APP, args=[loc(PH)]), "(#) <#>", ["app.A", None]),
    (value("array", args=[loc(("int[]", None)), loc(INT)]), "<int[]>[<int>]", []),
    (value("new", type=APP), "new #", ["app.A"]),
    (value("newarray", type=PLAT, args=[const("5")]), "newarray (java.util.List)[5]", []),
    (value("neg", args=[loc(INT)]), "neg <int>", []),
    (value("lengthof", args=[loc(("int[]", None))]), "lengthof <int[]>", []),
    (value("instanceof", type=APP, args=[loc(PH)]), "<#> instanceof #", [None, "app.A"]),
    (value("multiarray", text="newmultiarray (int)[3][4]"), "newmultiarray (int)[3][4]", []),
]


def test_values_and_their_references(spark):
    df = spark.createDataFrame([(i, v) for i, (v, *_) in enumerate(CASES)], f"i int, v {VALUE}")
    got = df.select("i", lifting.value_text(F.col("v")).alias("t"), lifting.value_refs(F.col("v")).alias("r")).orderBy("i").collect()
    assert [(r.t, r.r) for r in got] == [(t, r) for _, t, r in CASES]
    assert OPERAND in VALUE and MEMBER in VALUE


def lines(cls, idx, *rows):
    """Statements of a method from (block, kind, left, right, keys)."""
    place, out = {}, []
    for block, kind, left, right, keys in rows:
        place[block] = place.get(block, -1) + 1
        out.append(("a", cls, idx, block, place[block], kind, left, right, keys))
    return out


OBJ = ("java.lang.Object", "platform")
SUPER = value("invoke", op="special", base=loc(APP), args=[], member=method(OBJ, "<init>", ("void", None)))
DEFAULT = [(0, "identity", value("local", args=[loc(APP)]), value("this"), None), (0, "invoke", SUPER, None, None), (0, "return", None, None, None)]
BODY = [
    (0, "assign", value("local", args=[loc(PLAT)]), CASES[8][0], None), (0, "if", CASES[4][0], None, None),
    (1, "tableswitch", value("local", args=[loc(INT)]), None, ["1", "2", "7"]), (1, "lookupswitch", value("local", args=[loc(INT)]), None, ["1", "9"]), (1, "goto", None, None, None),
    (2, "throw", value("local", args=[loc(PH)]), None, None), (2, "nop", None, None, None), (2, "invoke", CASES[7][0], None, None), (2, "assign", value("local", args=[loc(INT)]), CASES[6][0], None),
    (2, "return", value("local", args=[loc(INT)]), None, None),
]
TEXTS = [["<java.util.List> = staticinvoke <java.util.List: java.util.List of()>()", "if <int> + 1"], ["tableswitch (<int>) {1 - 7}", "lookupswitch (<int>) {1, 9}", "goto"], ["throw <#>", "nop", CASES[7][1], "<int> = <java.util.List: int size>", "<int>"]]


@pytest.fixture(scope="module")
def tables(spark):
    classes = [("a", n, s, u, i) for n, s, u, i in [("app.A", "app", "app.B", ["app.I", "java.util.List"]), ("app.B", "app", "ph.P", []), ("ph.P", "phantom", "java.util.X", None), ("app.C", "app", "ph.Q", []), ("ph.Q", "phantom", None, []), ("app.I", "app", "java.lang.Object", None), ("java.util.X", "platform", "java.lang.Object", []), ("java.lang.Object", "platform", None, []), ("java.util.List", "platform", "java.lang.Object", [])]]
    methods = [("a", "app.A", 0, "<init>", [], True), ("a", "app.A", 1, "<init>", [INT], True), ("a", "app.A", 2, "go", [APP, PLAT, ("app.A[]", None)], True), ("a", "app.A", 3, "none", [], False), ("a", "app.B", 0, "<init>", [], True)]
    statements = lines("app.A", 0, *DEFAULT) + lines("app.A", 1, *DEFAULT[:2], (0, "nop", None, None, None), DEFAULT[2]) + lines("app.A", 2, *BODY) + lines("app.B", 0, *DEFAULT)
    edges = [("a", "app.A", 2, 0, 1), ("a", "app.A", 2, 0, 2), ("a", "app.A", 2, 1, 1), ("a", "app.A", 2, 1, 2)]
    return (
        spark.createDataFrame(classes, "artifact string, cls string, status string, superclass string, interfaces array<string>"), spark.createDataFrame(methods, METHODS),
        spark.createDataFrame(statements, STATEMENTS), spark.createDataFrame(edges, "artifact string, cls string, method int, src int, dst int"),
    )


def java_hash(text):
    return detection._hash(text)


def test_method_records(tables):
    _, methods, statements, edges = tables
    rows = {(r.cls, r.idx): r for r in lifting.method_records(methods, statements, edges).collect()}
    go = rows["app.A", 2]
    assert (go.fix_types, go.weight) == (["#", "java.util.List", "app.A[]"], 10)
    assert go.refs == ["<java.util.List: java.util.List of()>", "<java.util.List: int size>"]
    record = json.loads(go.record)
    assert [[u[0] for u in b] for b in record["blocks"]] == TEXTS and record["blockSuccs"] == {"0": [1, 2], "1": [1, 2]}
    assert record["blocks"][2][2] == [CASES[7][1], CASES[7][2], True, "app.A", 3] and record["blocks"][0][0][1:] == [[], False, None, None]
    fold = lambda hs: __import__("functools").reduce(lambda a, h: (a * 31 + h) % 2**32, hs, 1)
    succs = (0 ^ (1 + 2)) + (1 ^ (1 + 2))
    assert go.hash == java_hash("go") ^ fold(fold(map(java_hash, b)) for b in TEXTS) ^ succs
    assert (rows["app.A", 3].weight, json.loads(rows["app.A", 3].record)["blocks"], rows["app.A", 3].hash) == (0, [], java_hash("none") ^ 1)
    assert rows["app.B", 0].hash == lifting.DEFAULT_CONSTRUCTOR != rows["app.A", 1].hash


def test_class_records(spark, tables):
    rows = {r.cls: r for r in lifting.class_records(*tables).collect()}
    assert set(rows) == {"app.A", "app.B", "app.C", "app.I"}
    a = rows["app.A"]
    assert (a.lib_super, a.app_super, a.interfaces, a.weight) == ("java.util.X", "app.B", ["app.I"], 14)
    assert (rows["app.B"].lib_super, rows["app.B"].app_super) == ("java.util.X", None) and rows["app.C"].lib_super is None and rows["app.I"].lib_super == "java.lang.Object"
    record = json.loads(a.record)
    assert [m["idx"] for m in record["methods"]] == [1, 2, 3]  # without the default constructor
    assert (record["super"], record["superType"], record["interfaces"]) == ("java.util.X", "app.B", ["app.I"]) and "super" not in json.loads(rows["app.C"].record)
    loaded = detection.load_class(record, 5)
    assert loaded.weight == 14 and [m.name for m in loaded.methods] == ["<init>", "go", "none"]
    assert json.loads(rows["app.C"].record)["methods"] == []


def test_walk_up_a_long_hierarchy(spark):
    rows = [("a", f"c{i}", "app", f"c{i + 1}", []) for i in range(100)] + [("a", "c100", "platform", "top", []), ("a", "top", "platform", None, [])]
    rows += [("a", "x", "app", "nowhere", []), ("b", "c0", "app", None, [])]
    got = {(r.artifact, r.cls): r.lib_super for r in lifting.platform_superclass(spark.createDataFrame(rows, "artifact string, cls string, status string, superclass string, interfaces array<string>")).collect()}
    assert {got["a", f"c{i}"] for i in range(100)} == {"c100"} and got["a", "c100"] == "top" and got["a", "x"] is None and got["b", "c0"] is None
