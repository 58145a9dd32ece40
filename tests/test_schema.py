import pytest

from strandlog.ddl import compile_schema, declared_hash, parse
from strandlog.errors import DuplicateName, MissingField, ReservedName, SchemaError, TypeMismatch, UnknownField, UnknownTable
from strandlog.functions.hashing import fnv1a64
from strandlog.schema import DatabaseSchema, Field, Id, Text, table

TEXT = """
// accounts and what hangs on them
schema! {
  accounts { id id; email text; login_count int; trust_score float; disabled bool; lookup email unique; lookup disabled; }
  sessions {
    id id
    account_id id
    started_at int
    lookup account_id
  }
}
"""


def test_compiles_all_kinds():
    s = compile_schema(TEXT)
    assert list(s.tables) == ["accounts", "sessions"]
    t = s.table("accounts")
    assert [(f.name, f.kind) for f in t.fields] == [("id", "id"), ("email", "text"), ("login_count", "int"), ("trust_score", "float"), ("disabled", "bool")]
    assert t.lookup("email").unique and not t.lookup("disabled").unique and t.lookup("id").unique
    assert [f.dataType.simpleString() for f in t.struct()] == ["string", "string", "bigint", "double", "boolean"]


@pytest.mark.parametrize(
    "text,line,why",
    [
        ("schema! { users { id uuid } }", 1, "unknown type"),
        ("schema! { users { id id; id int } }", 0, "declares .id. twice"),
        ("schema! { users { id id }\n users { id id } }", 0, "second table"),
        ("schema! { users { name text } }", 0, "has none"),
        ("schema! { users { id id; lookup email } }", 0, "to look up"),
        ("schema! { users { id id; lookup id; lookup id } }", 0, "its lookup on"),
        ("schema! { users { id id; _tx int } }", 0, "reserved"),
        ("schema! { Users { id id } }", 0, "cannot name a table"),
        ("schema! { users { id id; a__b int } }", 0, "cannot name a field"),
        ("schema! {\n users { id: id } }", 2, "unexpected character"),
        ("users { id id }", 0, "breaks off"),
        ("schema! { users { id id }", 0, "breaks off"),
        ("schema! { / }", 1, "unexpected character"),
        ("schema! { users id }", 1, "expected"),
    ],
)
def test_rejects(text, line, why):
    with pytest.raises(SchemaError, match=why) as e:
        compile_schema(text)
    assert e.value.line == line


def test_uppercase_inside_a_name_passes():
    assert compile_schema("schema! { users { id id; lastName text } }").table("users").kind("lastName") == "text"


def test_hash_is_fnv_over_sorted_signatures():
    a, b = table("b", "id: id", "x: int", many=("x",)), table("a", "id: id")
    expected = fnv1a64(b"a|id:id|lookup:id:unique\nb|id:id|x:int|lookup:id:unique|lookup:x:many\n")
    assert DatabaseSchema.of(a, b).hash() == f"{expected:016x}"
    assert fnv1a64(b"") == 0xCBF29CE484222325 and fnv1a64(b"b", fnv1a64(b"a")) == fnv1a64(b"ab")


def test_declared_hash_follows_declaration_order():
    one = parse("schema! { b { id id } a { id id } }")
    two = parse("schema! { a { id id } b { id id } }")
    assert declared_hash(one) != declared_hash(two)
    assert declared_hash(two) == compile_schema("schema! { a { id id } b { id id } }").hash()


def test_table_rules():
    with pytest.raises(MissingField):
        table("t", "name: text")
    with pytest.raises(TypeMismatch):
        table("t", "id: text")
    with pytest.raises(DuplicateName):
        table("t", "id: id", "id: int")
    with pytest.raises(ReservedName):
        Field("_tx", "int")
    with pytest.raises(ReservedName):
        Field("", "int")
    with pytest.raises(UnknownField):
        table("t", "id: id", many=("x",))
    with pytest.raises(DuplicateName):
        DatabaseSchema.of(table("t", "id: id"), table("t", "id: id"))
    with pytest.raises(UnknownTable):
        DatabaseSchema().table("t")


def test_record_validation():
    t = table("m", "id: id", "body: text", "n: int", "x: float", "b: bool")
    good = {"id": "1", "body": "hi", "n": 1, "x": 1.0, "b": True}
    assert t.check(good) == good
    for change, error in (
        ({"n": "1"}, TypeMismatch), ({"n": True}, TypeMismatch), ({"n": 1 << 63}, TypeMismatch), ({"x": 1}, TypeMismatch), ({"b": 1}, TypeMismatch),
        ({"body": Id("a")}, TypeMismatch), ({"id": Text("a")}, TypeMismatch), ({"id": 3}, TypeMismatch), ({"body": None}, TypeMismatch), ({"extra": 1}, UnknownField),
    ):
        with pytest.raises(error):
            t.check(good | change)
    for name in good:
        with pytest.raises(MissingField):
            t.check({k: v for k, v in good.items() if k != name})
    assert t.check(good | {"x": float("nan"), "id": ""})


def test_frame_validation(spark):
    t = table("m", "id: id", "n: int")
    assert t.check_frame(spark.createDataFrame([("a", 1)], "id string, n int")).dtypes == [("id", "string"), ("n", "bigint")]
    with pytest.raises(TypeMismatch):
        t.check_frame(spark.createDataFrame([("a", "1")], "id string, n string"))
    with pytest.raises(MissingField):
        t.check_frame(spark.createDataFrame([("a",)], "id string"))
    with pytest.raises(UnknownField):
        t.check_frame(spark.createDataFrame([("a", 1, 2)], "id string, n long, m long"))
    with pytest.raises(Exception, match="m.n is null"):
        t.check_frame(spark.createDataFrame([("a", None)], "id string, n long")).collect()
