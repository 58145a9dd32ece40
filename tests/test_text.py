import math
import random

import pytest
from pyspark.sql import functions as F

from strandlog.errors import FormatError
from strandlog.functions import text as fn
from strandlog.schema import table
from strandlog.sources import jsonl, pack, segment

MESSAGES = table("messages", "id: id", "body: text", "created_at: int")
WIDE = table("wide", "id: id", "t: text", "n: int", "x: float", "b: bool")


def _log(spark, rows, t):
    schema = "_batch long, _pos long, _tx long, _op string, " + ", ".join(f"{f.name} {segment.value_type(f.kind)}" for f in t.fields)
    return spark.createDataFrame(rows, schema)


def test_escape_round_trip(spark):
    random.seed(1)
    cells = ["".join(random.choices("a\\\t\n\rnt", k=random.randint(0, 12))) for _ in range(300)]
    df = spark.createDataFrame([(c,) for c in cells], "c string")
    for c, e, u in df.select("c", fn.escape(F.col("c")).alias("e"), fn.unescape(fn.escape(F.col("c"))).alias("u")).collect():
        assert e == fn.escape_text(c) and u == c and fn.unescape_text(e) == c


@pytest.mark.parametrize("bad", ["a\\", "\\q", "\\\\\\"])
def test_bad_escapes_raise(spark, bad):
    with pytest.raises(FormatError):
        fn.unescape_text(bad)
    with pytest.raises(Exception, match="bad escape"):
        spark.createDataFrame([(bad,)], "c string").select(fn.unescape(F.col("c"))).collect()


def test_float_text(spark):
    random.seed(2)
    xs = [1.0, -0.0, 0.0, 1e21, 1.5, -2.25, 1e-7, 123456789.125, 1e300, float("inf"), float("-inf"), float("nan"), 0.1, 100.0, 1234567.0, 12345678.9]
    xs += [random.uniform(-1, 1) * 10 ** random.randint(-20, 20) for _ in range(300)]
    df = spark.createDataFrame([(x,) for x in xs], "x double").select("x", fn.float_column_text(F.col("x")).alias("t"))
    for x, t in df.collect():
        assert t == fn.float_text(x)
        assert math.isnan(x) or float(t) == x
    assert fn.float_text(1e21) == "1" + "0" * 21 and fn.float_text(1.0) == "1" and fn.float_text(-0.0) == "-0"


@pytest.mark.parametrize("kind,text,value", [("int", "5", 5), ("int", "+5", 5), ("int", "-9223372036854775808", -(1 << 63)), ("float", "1e3", 1000.0), ("float", ".5", 0.5), ("float", "-inf", float("-inf")), ("bool", "true", True), ("text", " x ", " x ")])
def test_cells_parse(spark, kind, text, value):
    assert spark.createDataFrame([(text,)], "c string").select(fn.parse_cell(F.col("c"), kind, "f")).first()[0] == value


@pytest.mark.parametrize("kind,text", [("int", " 5 "), ("int", "5.0"), ("int", "9223372036854775808"), ("int", ""), ("int", "5\n"), ("float", "1,5"), ("float", "0x1p3"), ("float", ""), ("float", "1d"), ("bool", "yes"), ("bool", "TRUE")])
def test_bad_cells_raise(spark, kind, text):
    with pytest.raises(Exception, match="is no"):
        spark.createDataFrame([(text,)], "c string").select(fn.parse_cell(F.col("c"), kind, "f")).collect()


def test_chunk_names(spark):
    ks = [0, 1, 35, 36, 1295, 46655]
    got = spark.createDataFrame([(k,) for k in ks], "k long").select("k", fn.chunk_name(F.col("k")).alias("n")).withColumn("b", fn.chunk_number(F.col("n"))).collect()
    assert [r["n"] for r in got] == [fn.chunk_name_text(k) for k in ks] and [r["b"] for r in got] == ks
    assert got[0]["n"] == "zzz" and got[1]["n"] == "zzy" and got[-1]["n"] == "000"
    with pytest.raises(FormatError):
        fn.chunk_name_text(46656)
    with pytest.raises(Exception, match="no name for chunk"):
        spark.range(46656, 46657).select(fn.chunk_name(F.col("id"))).collect()


def test_segment_lines(spark):
    log = _log(spark, [(0, 0, 1, "R", "m1", "hello\tworld\nagain", 42), (0, 1, 3, "D", "m1", None, None)], MESSAGES)
    assert [r["line"] for r in segment.encode(log, MESSAGES).orderBy("_pos").collect()] == ["R\t1\tm1\thello\\tworld\\nagain\t42", "D\t3\tm1"]
    assert segment.header(MESSAGES) == "id\tbody\tcreated_at"
    assert segment.preamble(MESSAGES, "h").splitlines()[0] == "SIX\t1\ttable\tmessages\th"
    assert segment.preamble(table("m", "id: id", "n: int", many=("n",)), "h").endswith("@lookup\tid\tunique\n@lookup\tn\tmany\n@data\n")


def test_segment_files_round_trip(spark, tmp_path):
    rows = [(b, p, b * 10 + p + 1, "D" if p == 3 else "R", f"k{p}", None if p == 3 else "é\\\t" * p, None if p == 3 else p, None if p == 3 else p / 4, None if p == 3 else p % 2 == 0) for b in range(6) for p in range(5)]
    log = _log(spark, rows, WIDE)
    n = segment.export(log, WIDE, "hash", "file://" + str(tmp_path / "s"), cap=150)
    assert n > 1 and sorted(x.name for x in (tmp_path / "s").glob("*.6"))[-1] == "zzz.6"
    back = segment.load(spark, str(tmp_path / "s"), WIDE).orderBy(F.col("_batch"), "_pos").collect()
    assert [tuple(r)[2:] for r in back] == [r[2:] for r in rows]


def test_batches_never_split_over_chunks():
    assert segment.plan_chunks([60, 60, 10, 200, 5], cap=100) == [0, 1, 1, 2, 3]
    assert segment.plan_chunks([10], cap=100, first=4, room=95) == [5]
    assert segment.plan_chunks([], cap=100) == []


def test_segment_scan_rules(spark):
    lines = ["id\tbody\tcreated_at", "", "SIX\t1\ttable\tmessages\th", "@field\tid\tid", "a\tlegacy\t1", "R\t7\tb\tx\t2", "D\t9\ta"]
    df = spark.createDataFrame([("zzz", i, x) for i, x in enumerate(lines)], "_chunk string, _pos int, line string")
    got = segment.decode(df, MESSAGES).orderBy("_pos").collect()
    assert [(r["_tx"], r["_op"], r["id"], r["created_at"]) for r in got] == [(0, "R", "a", 1), (7, "R", "b", 2), (9, "D", "a", None)]


@pytest.mark.parametrize("line", ["R\tx\ta\tb\t1", "R\t1", "R\t1\ta\tb", "R\t1\ta\tb\t1\t2", "R\t1\ta\tb\tno", "R\t1\ta\\q\tb\t1", "X\t1\ta"])
def test_broken_lines_raise(spark, line):
    df = spark.createDataFrame([("zzz", 0, line)], "_chunk string, _pos int, line string")
    with pytest.raises(Exception):
        segment.decode(df, MESSAGES).collect()


def test_header_check_and_repair(spark):
    df = spark.createDataFrame([("zzz", 0, "junk"), ("zzz", 1, "D\t1")], "_chunk string, _pos int, line string")
    with pytest.raises(FormatError):
        segment.check_header(df, MESSAGES)
    ok = spark.createDataFrame([("zzz", 0, "D\t1\ta"), ("zzz", 1, "D\t"), ("zzy", 0, "D\t2\tb"), ("zzy", 1, "")], "_chunk string, _pos int, line string")
    assert segment.decode(segment.repair(ok, MESSAGES), MESSAGES).count() == 2
    ends = {"R\t1\ta\tb\t1": True, "R\t1\ta\tb\t": False, "R\t1\ta\tb": False, "R\t1\ta\tb\\\t1": False, "R\t1\ta\t\\t\t1": True, "D\t1\ta": True, "D\t1\t": False, "D\t": False, "R": False}
    rows = spark.createDataFrame([(f"c{i}", 0, x) for i, x in enumerate(ends)], "_chunk string, _pos int, line string")
    assert {r["line"] for r in segment.repair(rows, MESSAGES).collect()} == {x for x, whole in ends.items() if whole}


def test_repair_rewrites_files(spark, tmp_path):
    log = _log(spark, [(0, 0, 1, "R", "a", "x", 1), (0, 1, 2, "R", "b", "y", 2)], MESSAGES)
    folder = "file://" + str(tmp_path / "s")
    segment.export(log, MESSAGES, "h", folder)
    whole = (tmp_path / "s" / "zzz.6").read_text()
    head = segment.preamble(MESSAGES, "h")
    for name, text in (("zzy.6", head + "R\t7\tc\tz\t3"), ("zzx.6", head + "R\t9\td\thalf"), ("zzw.6", head)):
        (tmp_path / "s" / name).write_text(text)
    assert segment.repair_files(spark, folder, MESSAGES) == {"files": 2, "operations": 3, "next_tx": 8}
    assert (tmp_path / "s" / "zzz.6").read_text() == whole and (tmp_path / "s" / "zzy.6").read_text().endswith("\tz\t3\n") and (tmp_path / "s" / "zzx.6").read_text() == head
    assert sorted(r["id"] for r in segment.load(spark, folder, MESSAGES).collect()) == ["a", "b", "c"]
    assert segment.repair_files(spark, folder, MESSAGES)["files"] == 0


def test_a_large_batch_is_split_in_order(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(segment, "WHOLE", 2)
    log = _log(spark, [(0, p, p + 1, "R", f"k{p:03d}", "x" * 20, p) for p in range(200)] + [(1, 0, 300, "R", "k000", "last", 7)], MESSAGES)
    assert segment.export(log, MESSAGES, "h", "file://" + str(tmp_path / "s"), cap=1000) > 3
    back = segment.load(spark, str(tmp_path / "s"), MESSAGES).orderBy("_batch", "_pos").collect()
    assert [r["_tx"] for r in back] == [*range(1, 201), 300]


def test_a_large_batch_has_no_more_parts_than_positions(spark, tmp_path, monkeypatch):
    log = _log(spark, [(b, b, 1, "R", f"k{b}{i}", "x" * 200, b) for b in range(3) for i in range(9)], MESSAGES)
    found = segment.chunked(log, MESSAGES, 1)
    assert {(r["_chunk_no"], r["_batch"]) for r in found.collect()} == {(0, 0), (1, 1), (2, 2)} and found.count() == 27
    gap = _log(spark, [(0, p, 1, "R", f"k{p}{i}", "x" * 200, p) for p in (0, 2) for i in range(9)], MESSAGES)
    assert segment.export(gap, MESSAGES, "h", "file://" + str(tmp_path / "g"), cap=1) == 3
    assert segment.load(spark, str(tmp_path / "g"), MESSAGES).count() == 18
    monkeypatch.setattr(fn, "LAST_CHUNK", 1)
    assert segment.chunked(log, MESSAGES, 1).count() == 27
    with pytest.raises(FormatError, match="no name for chunk 2"):
        segment.export(log, MESSAGES, "h", "file://" + str(tmp_path / "s"), cap=1)
    assert not (tmp_path / "s").exists()


def test_json_log(spark):
    log = _log(spark, [(0, 0, 1, "R", "a", "t", 1, 1.5, True), (0, 1, 2, "D", "a", "t", 1, 1.5, True)], WIDE)
    lines = jsonl.encode(log, WIDE, F.lit(9).cast("long")).select("line")
    assert lines.first()[0] == '{"_v":1,"_tx":1,"_op":"put","_ts":9,"table":"wide","data":{"b":true,"id":"a","n":1,"t":"t","x":1.5}}'
    assert [(r["_tx"], r["_op"], r["x"]) for r in jsonl.decode(lines, WIDE).collect()] == [(1, "R", 1.5), (2, "D", 1.5)]
    bad = spark.createDataFrame([('{"_v":2,"_tx":1,"_op":"put","_ts":1,"table":"wide","data":{}}',)], "line string")
    with pytest.raises(Exception, match="unsupported version"):
        jsonl.decode(bad, WIDE).collect()


def _records(spark, *lines):
    return pack.records(spark.createDataFrame([("f", i, x) for i, x in enumerate(lines)], "_file string, _pos int, line string"))


def test_pack(spark):
    r = _records(spark, "SIX\t1\tchatpack\tx", "@role\tu\tuser", "C\t1\t1\t2\t0", "M\t0\tu\thello\tworld", "M\t1\ta\tline one\\nline two", "G\t4", "P\tlicense\tinternal", "T\t1\t0\t1\tx=1", "R\t2\t0\t228", "C\t2\t0\t0\t0", "M\t0\tu\thi", "U\t1\tflags\t4", "U\t1\tP.license\topen", "D\t2")
    assert [tuple(x) for x in pack.messages(r).orderBy("cid", "turn").collect()] == [(1, 0, "u", "hello\tworld"), (1, 1, "a", "line one\nline two"), (2, 0, "u", "hi")]
    assert [tuple(x) for x in pack.tags(r).collect()] == [(1, 4)]
    assert [tuple(x) for x in pack.calls(r).collect()] == [(1, 1, 0, 1, "x=1")]
    assert [tuple(x) for x in pack.results(r).collect()] == [(1, 2, 0, "228")]
    convs, props = pack.with_updates(r)
    assert [tuple(x) for x in convs.collect()] == [(1, 1, 2, 4)] and [tuple(x) for x in props.collect()] == [(1, "license", "open")]


@pytest.mark.parametrize("lines,why", [(["M\t0\tu\thello"], "outside a block"), (["C\t1\t1\t2"], "needs"), (["C\t1\t1\t2\t0", "M\t0\tu\t\\q"], "bad escape"), (["Z\t1"], "unknown record")])
def test_pack_rejects(spark, lines, why):
    with pytest.raises(Exception, match=why):
        _records(spark, *lines).collect()


def test_pack_turn_twice(spark):
    with pytest.raises(Exception, match="turn twice"):
        pack.messages(_records(spark, "C\t1\t1\t2\t0", "M\t0\tu\ta", "M\t0\ta\tb")).collect()


def test_pack_writes_all_records(spark, tmp_path):
    convs = spark.createDataFrame([(i, 0, 0, i) for i in range(3)], "cid long, source_id long, domain_id long, flags long")
    msgs = spark.createDataFrame([(i, 0, "u", "x") for i in range(3)], "cid long, turn long, role string, text string")
    tags = spark.createDataFrame([(0, 4), (0, 5)], "cid long, tag_id long")
    props = spark.createDataFrame([(0, "license", "a\tb"), (2, "k", "v")], "cid long, key string, value string")
    calls = spark.createDataFrame([(1, 1, 0, 7, "x=1\n")], "cid long, turn long, call long, tool_id long, args string")
    results = spark.createDataFrame([(1, 2, 0, "228")], "cid long, turn long, call long, text string")
    path = str(tmp_path / "p")
    pack.write(convs, msgs, path, {"role": {"u": "us\ter"}, "tag": {"4": "four"}}, tagged=tags, props=props, called=calls, told=results)
    updates = spark.createDataFrame([(0, "P.license", "open"), (1, "flags", "9")], "cid long, path string, value string")
    pack.write_updates(path, updates, spark.createDataFrame([(2,)], "cid long"))
    found = pack.lines(spark, path)
    r = pack.records(found)
    same = lambda a, b: sorted(map(tuple, a.collect())) == sorted(map(tuple, b.collect()))
    assert same(pack.tags(r), tags) and same(pack.calls(r), calls) and same(pack.results(r), results) and same(pack.properties(r), props)
    assert {tuple(x) for x in pack.dictionaries(found).collect()} == {("role", "u", "us\ter"), ("tag", "4", "four")}
    convs2, props2 = pack.with_updates(r)
    assert sorted((x["cid"], x["flags"]) for x in convs2.collect()) == [(0, 0), (1, 9)] and [tuple(x) for x in props2.collect()] == [(0, "license", "open")]


def test_pack_files(spark, tmp_path):
    convs = spark.createDataFrame([(i, 0, 0, i) for i in range(20)], "cid long, source_id long, domain_id long, flags long")
    msgs = spark.createDataFrame([(i, t, "u", f"x\n{t}") for i in range(20) for t in range(3)], "cid long, turn long, role string, text string")
    pack.write(convs, msgs, str(tmp_path / "p"))
    r = pack.records(pack.lines(spark, str(tmp_path / "p")))
    assert sorted(map(tuple, pack.messages(r).collect())) == sorted(map(tuple, msgs.collect()))
    assert sorted(map(tuple, pack.conversations(r).collect())) == sorted(map(tuple, convs.collect()))


def test_toml_text():
    assert fn.toml_text('a "b" \\ c') == 'a \\"b\\" \\\\ c' and fn.toml_text("") == ""


def test_older_projection(spark, tmp_path):
    from strandlog.sources import projection

    path = tmp_path / "p"
    path.write_text("SIXB\t1\tmessages\tschema\tsource\nrow\tm1\tzzz.6\t42\t18\t7\n\nrow\tm\\t2\tzzy.6\t0\t5\t8\nlookup\tconversation_id\tcv1\tm1\n")
    head, rows, lookups = projection.read(spark, str(path))
    assert head == {"version": 1, "table": "messages", "schema_hash": "schema", "source_hash": "source"}
    assert sorted(map(tuple, rows.collect())) == [("m\t2", "zzy.6", 0, 5, 8), ("m1", "zzz.6", 42, 18, 7)]
    assert [tuple(r) for r in lookups.collect()] == [("conversation_id", "cv1", "m1")]
    path.write_text("junk\n")
    with pytest.raises(FormatError):
        projection.read(spark, str(path))
    path.write_text("SIXB\t1\tm\ts\ts\nrow\tonly\n")
    with pytest.raises(Exception, match="no entry"):
        projection.read(spark, str(path))[1].collect()
