import json
from datetime import datetime

from voltloom.operators import drift
from voltloom.operators.drift import canonical_names, changes, consistent, promote

SCHEMA = "series string, file_name string, exported_at timestamp_ntz, line_no int, record string, FIELD string"


def rows(spark, files):
    out = []
    for k, (series, name, lines) in enumerate(files):
        for i, x in enumerate(lines):
            out.append((series, name, datetime(2031, 1, 1 + k), i, x if x is None or isinstance(x, str) else json.dumps(x), "x"))
    return spark.createDataFrame(out, SCHEMA)


def items(n, /, **fields):
    return [{"item": f"i{k}", **{f: (v(k) if callable(v) else v) for f, v in fields.items()}} for k in range(n)]


def test_changes(spark):
    a = items(10, ns=lambda k: f"n{k}", flag=True, old=1, mixed="t", sparse=None)
    b = items(10, namespace=lambda k: f"n{k}" if k else "other", flag="Yes", mixed="t", sparse=2, new={"b": 1, "a": 2})
    b += [b[0], None, "", "{", '{"item": "i1", "flag": ', '[1]', '{"item":"i1","ghost":1} x', '{"item":"i1","ghost":1} }', '{"item":"i1","ghost":1}{"item":"i2"}', '{"item":"i1","ghost":1},{"item":"i2"}', "3"]
    b[2]["mixed"] = 5
    c = items(2, namespace=lambda k: f"n{k}", flag="Yes", mixed="t", sparse=2, new={"a": 2, "b": 1})
    c2 = items(2, ns2=lambda k: f"n{k}", flag="Yes", mixed="t", sparse=2, new={"a": 2, "b": 1})
    got = {tuple(r)[1:] for r in changes(rows(spark, [("S", "a", a), ("S", "b", b), ("T", "c", c), ("T", "d", c2), ("T", "e", ["{"])])).collect()}
    assert got == {
        ("b", "renamed", "ns", "namespace"), ("b", "removed", "old", ""), ("b", "added", "sparse", ""), ("b", "added", "new", ""), ("b", "type_changed", "flag", ""),
        # two items are too few for a rename
        ("d", "removed", "namespace", ""), ("d", "added", "ns2", ""),
        ("e", "removed", "ns2", ""), ("e", "removed", "flag", ""), ("e", "removed", "mixed", ""), ("e", "removed", "sparse", ""), ("e", "removed", "new", ""),
    }


def test_consistent(spark):
    a = items(5, ns=lambda k: f"n{k}", n=1, **{"Odd name": 2.5})
    b = items(5, namespace=lambda k: f"n{k}", n="x", flag=True)
    df = rows(spark, [(s, f"{s}{f}", x) for s in "ST" for f, x in (("a", a), ("b", b))] + [("S", "c", [None, "{}", '{"other": [1]}'])])
    t = consistent(df)
    assert dict(t.dtypes)["odd_name"] == "double" and dict(t.dtypes)["n"] == "string" and dict(t.dtypes)["flag"] == "boolean"
    got = t.collect()
    assert len(got) == 22
    name = "namespace" if "namespace" in t.columns else "ns"
    assert sum(1 for r in got if r[name]) == 20 and not {"namespace", "ns"} <= set(t.columns)
    narrow = consistent(df, max_columns=2)
    assert any(r.other_fields for r in narrow.collect())


def test_empty(spark):
    assert changes(spark.createDataFrame([], SCHEMA)).count() == 0
    assert consistent(spark.createDataFrame([], SCHEMA)).count() == 0


def test_lattice():
    assert promote({"boolean": 0}) == "boolean" and promote({"number": 0}) == "bigint" and promote({"number": 1}) == "double"
    assert promote({"boolean": 0, "number": 0}) == "string" and promote({"array": 0}) == "string"
    assert canonical_names([("a", "b", 5), ("b", "c", 1)], {"a": 1, "b": 9, "c": 3}) == {"a": "b", "b": "b", "c": "c"}


def test_records_without_item_and_repeated_keys(spark):
    a = [*items(4, kept=1), '{"gone": true, "kept": "x"}']
    b = [*items(4, kept=1), '{"come": 1}', '{"item": null, "come": 2.5}', '{"item":"i9","twice":"x","twice":7}']
    df = rows(spark, [("S", "a", a), ("S", "b", b)])
    assert {tuple(r)[1:] for r in changes(df).collect()} == {("b", "removed", "gone", ""), ("b", "added", "come", ""), ("b", "added", "twice", "")}
    t = consistent(df)
    got = t.collect()
    assert dict(t.dtypes)["come"] == "double" and len(got) == 12
    assert {r.come for r in got} == {None, 1.0, 2.5} and {r.twice for r in got} == {None, 7} and {r.gone for r in got} == {None, True}
    assert spark.conf.get("spark.sql.variant.allowDuplicateKeys") == "false"


def test_no_values_go_to_the_driver(spark, monkeypatch, tmp_path):
    """Whatever Spark estimates: fields of variants look small to it, and were broadcast."""
    plans = []
    cut = drift.cut

    def seen(df):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return cut(df)

    monkeypatch.setattr(drift, "cut", seen)
    double = [f'{{"item":"i{k}","old":0,"old":"n{k}"}}' for k in range(5)]
    df = rows(spark, [("S", "a", double), ("S", "b", items(5, new=lambda k: f"n{k}")), (None, "c", items(3, x=1)), ("S", None, items(3, x=1))])
    df.write.parquet(f"{tmp_path}/t")
    out = changes(spark.read.parquet(f"{tmp_path}/t"))
    plans.append(out._jdf.queryExecution().executedPlan().toString())
    assert {tuple(r)[1:] for r in out.where("file_name is not null").collect()} == {("b", "renamed", "old", "new")}
    assert len(plans) > 1 and not [p for p in plans if "Broadcast" in p]
