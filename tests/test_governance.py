import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from palisade.functions import masks, scalar
from palisade.operators import anomaly, quality, relational, scan
from palisade.plans import dag, policy, render

EDGES = ["john.doe@x.com", "a@b", "x@y@z.com", "noat", "", None, "é@b.fr", "@x.com", "a@b\n"]


def one(spark, values, column):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string")
    return [r[0] for r in df.orderBy("i").select(column(F.col("v"))).collect()]


def test_mask_edges(spark):
    assert one(spark, EDGES, masks.mask_email) == ["j****@x.com", "a****@b", "x****@z.com", "noat", "", None, "é****@b.fr", "@x.com", "a@b\n"]
    assert one(spark, ["abc", "a", "", None], masks.partial) == ["ab***", "a***", "***", "***"]
    assert one(spark, ["abc", "é", None], masks.entity_preserving) == ["[PRESERVED_3]", "[PRESERVED_1]", "[PRESERVED_]"]
    assert one(spark, ["x", None], masks.redact) == ["REDACTED", "REDACTED"]
    assert one(spark, ["x", None], masks.nullify) == [None, None]
    assert one(spark, [None], masks.hashed) == [None]
    assert one(spark, [None, "a"], lambda c: masks.hashed(c, "s"))[0] is not None


def test_mask_boundary(spark):
    df = spark.createDataFrame([(1, "a@b.c", 10.0)], "id int, Email string, pay double")
    out = policy.mask(df, policy.PolicySet({"email": "mask_email", "pay": "redact"}))
    assert out.columns == ["id", "Email", "pay"] and out.first()["Email"] == "a****@b.c" and out.first()["pay"] == "REDACTED"
    assert policy.mask(df, policy.PolicySet()) is df
    assert policy.mask(df, policy.PolicySet({c: "drop" for c in df.columns})).count() == 0


def test_policies():
    with pytest.raises(ValueError):
        policy.parse_policy("hsh")
    with pytest.raises(ValueError):
        policy.SecurityLevel.parse("secret")
    assert policy.SecurityLevel.parse("Restricted") > policy.SecurityLevel.INTERNAL
    assert policy.fuzzy_policy("user_email", [(".*email.*", "hash")]) == "hash"
    assert policy.fuzzy_policy("user_email_hash", [(".*email.*", "hash")]) is None
    assert not policy.PolicySet({"a": "drop"}).is_masked("a")
    assert policy.can_transition("active", "deprecated") and not policy.can_transition("active", "provisioning")


@settings(max_examples=15, deadline=None)
@given(st.lists(st.emails(), min_size=1, max_size=5))
def test_masked_addresses_are_none(spark, addresses):
    for mask in (masks.hashed, masks.redact, masks.entity_preserving):
        assert not any(re.search(scan.EMAIL, v) for v in one(spark, addresses, mask))


def test_row_counts_and_z_scores(spark):
    check = anomaly.row_count_check
    assert [check(1040, 1000, 0.05), check(1100, 1000, 0.05), check(900, 1000, 0.05), check(100, None), check(5, 0)] == ["ok", "anomaly", "anomaly", "no_history", "ok"]
    assert anomaly.MetricState().add(0.5) == anomaly.MetricState(0.5, 0.0, 1)
    state = anomaly.MetricState(0.5, 0.01, 10)
    assert anomaly.z_update(0.6, state)[1].count == 11
    assert anomaly.z_update(0.9, state) == ("anomaly", state)
    series = [0.24, 0.26, 0.25, 0.23, 0.27, 0.25, 0.24, 0.26, 0.25, 0.25, 0.25, 0.95, 0.25]
    state, verdicts = None, []
    for x in series:
        verdict, state = anomaly.z_update(x, state)
        verdicts.append(verdict)
    assert verdicts == ["no_history"] * 2 + ["ok"] * 9 + ["anomaly", "ok"] and state.count == 12
    df = spark.createDataFrame([("k", i, x) for i, x in enumerate(series)], "k string, t int, v double")
    assert [r["verdict"] for r in anomaly.z_fold(df, "t", "v", ["k"]).orderBy("t").collect()] == verdicts


def test_scan_and_guard(spark):
    text = "Please write to ceo@example.org to discuss."
    assert [v.matched for v in scan.scan_text(text)] == ["ceo@example.org"]
    assert scan.scan_text(text, enabled=False) == []
    with pytest.raises(re.error):
        scan.Pattern("bad", "(")
    df = spark.createDataFrame([(1, text), (2, None), (3, "none")], "id int, t string")
    assert [(r["id"], r["matched"]) for r in scan.scan(df, "t", keep=["id"]).collect()] == [(1, "ceo@example.org")]
    block = [scan.Violation("s", "high", "block", "SECRET")]
    with pytest.raises(scan.GovernanceError):
        scan.audit(block, strict=True)
    assert len(scan.audit(block, strict=False)) == 1
    assert scan.audit([scan.Violation("s", "low", "ignore", "x")], strict=True) == []
    with pytest.raises(scan.GovernanceError):
        scan.check_boundary("public", block)
    scan.check_boundary("restricted", block)
    assert scan.lint(df, []) == ["t"] and scan.lint(df, ["t"]) == []


def test_data_tests(spark):
    df = spark.createDataFrame([(1, None), (2, None), (2, "x")], "id int, v string")
    with pytest.raises(quality.DataTestError, match="NULL"):
        quality.run_tests(df, {"v": ["not_null"]})
    with pytest.raises(quality.DataTestError, match="DUPLICATE"):
        quality.run_tests(df, {"id": ["unique"]})
    with pytest.raises(quality.DataTestError, match="DUPLICATE"):
        quality.run_tests(df, {"v": ["unique"]})
    said = []
    assert quality.run_tests(df, {"id": ["strange", "not_null"]}, said.append) == 3 and len(said) == 1
    assert quality.undocumented(df, ["ID"]) == ["v"]


def test_measures_and_repeated_keys_are_one_query(spark, monkeypatch):
    df = spark.createDataFrame([(1, None, "a"), (2, None, "b"), (2, "x", "c")], "id int, v string, `odd.name` string")
    firsts, first = [], type(df).first
    monkeypatch.setattr(type(df), "first", lambda self: firsts.append(self) or first(self))
    monkeypatch.setattr(type(df), "count", lambda self: pytest.fail("a job of its own"))
    tests = {"id": ["not_null"], "odd.name": ["unique", "not_null"]}
    assert quality.run_tests(df, tests) == 3 and len(firsts) == 1
    assert quality.measure(df, quality.test_measures({}), ["id", "v", "odd.name"]) == {"rows": 3, "repeated id": 1, "repeated v": 1, "repeated odd.name": 0}
    assert quality.measure(df, {}) == {}
    grouped = df.groupBy("id").agg({"v": "max"})
    assert quality.run_tests(grouped, {"id": ["unique"]}) == 2
    firsts[-1].collect()
    assert firsts[-1]._jdf.queryExecution().executedPlan().toString().count("ReusedExchange") == 1


def test_plans(spark):
    assert dag.layers({"a": [], "b": ["a"], "c": ["b"]}) == [["a"], ["b"], ["c"]]
    with pytest.raises(dag.CycleError):
        dag.layers({"a": ["b"], "b": ["a"]})
    with pytest.raises(dag.MissingModelError):
        dag.layers({"a": ["z"]})
    assert dag.select([["a"], ["b"]], "b") == [["b"]] and dag.select([["a"]], "z") == []
    assert render.render("SELECT * FROM {{ ref('m') }} JOIN {{ source('d', 'n') }} {{ who | upper }}{{ nobody }}", {"who": "x"}) == 'SELECT * FROM "m" JOIN "d_n" X'
    assert render.references("-- ref('a')\n{{ ref(\"b\") }}") == {"a", "b"}
    text = """{# none of this #}SELECT {% for c in columns -%}
        {{ c | upper }}{% if not loop.last %}, {% endif %}
    {%- endfor %} FROM {{ ref('m') }}{% if limit is defined and limit > 5 %} LIMIT {{ limit }}{% elif kind == 'all' %} ALL{% else %} NONE{% endif %}"""
    assert render.render(text, {"columns": ["a", "b"], "limit": 7}) == 'SELECT A, B FROM "m" LIMIT 7'
    assert render.render(text, {"columns": [], "kind": "all"}) == 'SELECT  FROM "m" ALL'
    assert render.render("{% set n = 2 %}{{ n + 1 }} {{ nobody | default('x') }} {{ ['a', 'b'] | join('-') }} {{ true }} {% for k, v in pairs %}{{ k }}={{ v }};{% endfor %}", {"pairs": {"p": 1}}) == "3 x a-b true p=1;"
    for bad in ("{{ open('x') }}", "{{ ref('a', 'b') }}", "{{ x.__class__() }}", "{% if x %}", "{% endif %}", "{% import x %}", "{{ a | nope }}", "{{ (lambda: 1)() }}", "{{ x", "{% for x %}{% endfor %}"):
        with pytest.raises(render.TemplateError):
            render.render(bad)


def test_scalar_and_asof(spark):
    assert one(spark, ["abc", "a.c", "b"], lambda c: scalar.similar_to(c, "a_c")) == [True, True, False]
    assert one(spark, ["a.c", "abc"], lambda c: scalar.similar_to(c, "a.c")) == [True, False]
    assert one(spark, ["00", None], lambda c: scalar.replace_first(c, "0", "x")) == ["x0", None]
    scalar.register_error(spark)
    with pytest.raises(Exception, match="boom"):
        spark.sql("SELECT error('boom')").collect()
    left = spark.createDataFrame([("a", 5), ("a", 1), (None, 9)], "k string, t int")
    right = spark.createDataFrame([("a", 2, 1), ("a", 5, 2), ("a", 5, 3), (None, 1, 4)], "k string, t int, v int")
    rows = relational.asof_join(left, right, ["k"], "t", "t", ["v"], "left").collect()
    assert sorted((r["k"] or "", r["t"], r["right_v"]) for r in rows) == [("", 9, None), ("a", 1, None), ("a", 5, 3)]
