import json

import pytest
import yaml

from palisade import cli
from palisade.plans import lineage, pipeline, policy, project
from palisade.sources.connector import ConnectorError, SparkConnector
from palisade.sources.storage import ConflictError, TableStore

USERS = "user_id,email,name,signup_date,tier\n" + "".join(f"u{i},user{i}@example.org,User {i},2024-01-{i % 28 + 1:02d},pro\n" for i in range(40))
ACTIVITY = "activity_id,user_id,duration\n" + "".join(f"a{i},u{i % 40},{i}\n" for i in range(100))


def make(tmp_path, users=USERS, **models):
    (tmp_path / "data/raw").mkdir(parents=True, exist_ok=True)
    (tmp_path / "data/raw/users.csv").write_text(users)
    (tmp_path / "data/raw/activity.csv").write_text(ACTIVITY)
    (tmp_path / "palisade.yaml").write_text("name: shop\nmodels:\n  staging: {materialized: table}\n")
    (tmp_path / "config").mkdir()
    (tmp_path / "config/policies.yml").write_text("column_policies:\n  - {pattern: '.*email.*', policy: hash}\n")
    files = {
        "staging/stg_users.sql": "SELECT user_id, email, name, CAST(signup_date AS DATE) AS signup_date FROM {{ source('raw', 'users') }}",
        "staging/stg_activity.sql": "SELECT activity_id, user_id, duration FROM {{ source('raw', 'activity') }}",
        "marts/engagement.sql": "SELECT u.user_id, u.email, count(*) AS n, avg(a.duration) AS mean FROM {{ ref('stg_users') }} u JOIN {{ ref('stg_activity') }} a ON u.user_id = a.user_id GROUP BY 1, 2",
    }
    contracts = {
        "staging/stg_users.yml": {"models": [{"name": "stg_users", "columns": [{"name": "user_id", "tests": ["unique", "not_null"]}, {"name": "email"}, {"name": "name", "policy": "partial"}, {"name": "signup_date"}]}]},
        "marts/engagement.yml": {"models": [{"name": "engagement", "config": {"materialized": "view"}, "columns": [{"name": "user_id", "tests": ["not_null"]}, {"name": "email"}, {"name": "n"}, {"name": "mean"}],
            "compliance": {"post_flight": [{"check": "row_count_anomaly", "threshold": 0.05}, {"check": "z_score_anomaly", "column": "mean"}]}}]},
    }
    contracts.update(models)
    for name, text in files.items():
        (tmp_path / "models" / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / "models" / name).write_text(text)
    for name, data in contracts.items():
        (tmp_path / "models" / name).write_text(yaml.safe_dump(data))
    project.generate_sources(tmp_path, tmp_path / "data")
    return tmp_path


def test_run_masks_and_keeps_state(spark, tmp_path):
    root = make(tmp_path)
    result = pipeline.run(spark, root)
    assert result.success, result.errors
    assert result.models_executed == ["stg_activity", "stg_users", "engagement"]
    rows = TableStore(spark, f"{root}/target/data").read("stg_users").collect()
    assert len(rows) == 40 and not any("@" in r["email"] for r in rows) and all(r["name"] == "Us***" for r in rows)
    state = json.loads((root / "target/state.json").read_text())
    assert state["engagement"]["row_count"] == 40 and state["engagement"]["ml_metrics"]["mean"]["count"] == 1
    assert (root / "models/staging/stg_activity.yml").exists() and (root / "target/compiled/staging/stg_users.sql").exists()
    assert pipeline.run(spark, root, select="stg_users").models_executed == ["stg_users"]
    assert pipeline.run(spark, root, select="nobody").models_executed == []
    (root / "data/raw/users.csv").write_text(USERS + "u99,x@example.org,X,2024-01-01,pro\n" * 1)
    (root / "data/raw/activity.csv").write_text(ACTIVITY + "".join(f"b{i},u99,1\n" for i in range(3)))
    assert pipeline.run(spark, root).success  # 41 of 40 rows: within 5 %


def test_tables_have_versions(spark, tmp_path):
    store = TableStore(spark, f"file://{tmp_path}/data")
    with pytest.raises(FileNotFoundError):
        store.read("t")
    frames = []
    for n in range(1, 5):
        assert store.publish("t", store.stage("t", spark.range(n))) == n
        frames.append(store.read("t"))
        assert frames[-1].count() == n
    assert frames[-2].count() == 3  # what was read from the version before stays readable
    assert len(list((tmp_path / "data/t").glob("data-*"))) == 2
    staged = store.stage("t", spark.range(9))
    assert store.read("t").count() == 4
    (tmp_path / "data/t/_versions/.claim-0000000005").touch()
    with pytest.raises(ConflictError):
        store.publish("t", staged)
    assert store.read("t").count() == 4


def write(path, data):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(data if isinstance(data, str) else yaml.safe_dump(data))


def test_quality_rules_of_a_project(spark, tmp_path):
    root = make(tmp_path)
    good = [
        {"name": "no_null_primary_keys"}, {"name": "max_value", "column": "duration", "max_value": 99}, {"name": "min_value", "column": "duration", "min_value": 0},
        {"name": "accepted_values", "column": "name", "values": ["Us***"]}, {"name": "regex_match", "column": "user_id", "pattern": "^u[0-9]+$"},
        {"name": "date_validity", "column": "signup_date"}, {"name": "date_range", "column": "signup_date", "min_date": "2024-01-01", "max_date": "2024-01-31"},
        {"name": "sum_check", "columns": ["duration"], "expected_sum": "< 100"}, {"name": "unique_ids", "column": "activity_id"}, {"name": "not_null_columns", "columns": ["user_id", "email"]},
        {"name": "referential_integrity", "column": "user_id", "reference_table": "raw_users", "reference_column": "user_id"}, {"name": "max_value", "column": "nowhere", "max_value": 1},
    ]
    write(root / "config/quality.yml", {"rules": good})
    result = pipeline.run(spark, root)
    assert result.success and not [w for w in result.warnings if "rule" in w], (result.errors, result.warnings)
    for bad, models in (({"name": "max_value", "column": "duration", "max_value": 90}, "stg_activity"), ({"name": "sum_check", "columns": ["duration"], "expected_sum": "<= 98"}, "stg_activity"), ({"name": "unique_ids", "column": "user_id"}, "stg_activity")):
        write(root / "config/quality.yml", {"rules": [bad]})
        result = pipeline.run(spark, root)
        assert not result.success and any(e.startswith(models) and bad["name"] in e for e in result.errors), result.errors
        write(root / "config/quality.yml", {"rules": [bad | {"severity": "warn"}]})
        result = pipeline.run(spark, root)
        assert result.success and any(bad["name"] in w for w in result.warnings)
    write(root / "config/quality.yml", {"rules": [{"name": "unique_ids", "column": "user_id"}], "data_quality": {"environments": {"dev": {"enabled": False}}}})
    assert pipeline.run(spark, root).success
    write(root / "config/quality.yml", {"rules": [{"name": "odd", "column": "user_id"}, {"name": "max_value", "column": "duration"}, {"name": "referential_integrity", "column": "user_id", "reference_table": "gone", "reference_column": "x"}]})
    result = pipeline.run(spark, root)
    assert result.success and sum("rule" in w for w in result.warnings) >= 3


def test_embedding_rules_of_a_project(spark, tmp_path):
    rows = [(1, [1.0, 0.0], "2024-01-01"), (2, [0.0, 1.0], "2024-01-02"), (3, [0.0, 0.0], "2024-03-01"), (4, [3.0, float("nan")], "2024-03-01"), (5, None, "2024-03-01"), (6, [2.0, 0.0], "2024-03-01")]
    spark.createDataFrame(rows, "id int, embedding array<double>, day string").write.parquet(str(tmp_path / "data/raw/vectors.parquet"))
    write(tmp_path / "palisade.yaml", "strict: false\n")
    write(tmp_path / "models/vectors.sql", "SELECT * FROM {{ source('raw', 'vectors') }}")
    write(tmp_path / "models/vectors.yml", {"name": "vectors", "columns": [{"name": "id", "tests": ["unique"]}]})
    e = "embedding_"
    wanted = [
        ({"name": e + "dimension_check", "expected_dimensions": 2, "check_normalization": True}, 3), ({"name": e + "normalization_check"}, 3), ({"name": e + "nan_check"}, 1), ({"name": e + "null_check"}, 1),
        ({"name": e + "zero_vector_check"}, 1), ({"name": e + "range_check", "min_value": -1, "max_value": 1}, 2), ({"name": e + "sparsity_check", "sparsity_threshold": 0.6}, 1),
        ({"name": e + "similarity_check", "reference_embeddings": [1, 0], "similarity_threshold": 0.5}, 1), ({"name": e + "duplicates_check", "duplicate_threshold": 0.9}, None), ({"name": e + "uniqueness_check", "uniqueness_threshold": 1.01}, 1),
        ({"name": e + "completeness_check", "completeness_threshold": 0.9}, 1), ({"name": e + "consistency_check", "reference_models": ["raw_vectors"], "consistency_threshold": 1.01}, None),
        ({"name": e + "distribution_check", "mean": 0, "std_dev": 1}, 2), ({"name": e + "drift_check", "reference_period": "2024-01-01 to 2024-01-31", "date_column": "day", "drift_threshold": 0.1}, 1), ({"name": e + "outlier_check", "outlier_threshold": 3}, None),
        ({"name": e + "similarity_check", "reference_embeddings": ["named"], "similarity_threshold": 0.5}, "numbers"),
    ]
    write(tmp_path / "config/quality.yml", {"rules": [r for r, _ in wanted]})
    project.generate_sources(tmp_path, tmp_path / "data")
    result = pipeline.run(spark, tmp_path)
    assert result.success, result.errors
    for rule, n in wanted:
        if isinstance(n, int):
            assert any(w == f"vectors: {n} violations of {rule['name']}" for w in result.warnings), (rule, result.warnings)
    assert any("numbers of one vector" in w for w in result.warnings)


def test_pre_flight_checks_and_audit(spark, tmp_path):
    root = make(tmp_path)
    marts = root / "models/marts/engagement.yml"
    entry = yaml.safe_load(marts.read_text())
    entry["models"][0]["compliance"]["pre_flight"] = [{"check": "strict_schema_validation"}, {"check": "pii_detection"}]
    write(marts, entry)
    policies = {"column_policies": [{"column_name_pattern": ".*email.*", "policy": "hash"}], "pii_detection": {"enabled": True, "patterns": [{"name": "user", "regex": "^u[0-9]+$", "severity": "low", "action": "warn"}]},
        "audit": {"enabled": True, "log_events": ["pii_detected", "model_executed", "data_blocked"], "retention_days": 90}, "environments": {"prod": {"pii_detection": {"fail_on_detection": True}}, "uat": {"pii_detection": {"auto_mask": True}}}}
    write(root / "config/policies.yml", policies)
    result = pipeline.run(spark, root)
    assert result.success and any("user (low, warn)" in w for w in result.warnings), (result.errors, result.warnings)
    events = [json.loads(line) for line in (root / "target/audit.jsonl").read_text().splitlines()]
    assert {e["event"] for e in events} == {"pii_detected", "model_executed"} and [e["rows"] for e in events if e["event"] == "pii_detected"] == [40]
    write(root / "palisade.yaml", "name: shop\nprofile: prod\nmodels:\n  staging: {materialized: table}\n")
    result = pipeline.run(spark, root)
    assert not result.success and "personal data" in result.errors[0]
    assert "data_blocked" in (root / "target/audit.jsonl").read_text() and len((root / "target/audit.jsonl").read_text().splitlines()) > len(events)
    policies["pii_detection"]["patterns"][0] |= {"action": "block", "severity": "critical"}
    write(root / "config/policies.yml", policies)
    write(root / "palisade.yaml", "name: shop\nmodels:\n  staging: {materialized: table}\n")
    assert "blocked" in pipeline.run(spark, root).errors[0]
    policies["pii_detection"]["patterns"][0] |= {"action": "mask", "severity": "low"}
    write(root / "config/policies.yml", policies)
    write(root / "palisade.yaml", "name: shop\nprofile: uat\nmodels:\n  staging: {materialized: table}\n")
    result = pipeline.run(spark, root)
    assert result.success and {r["user_id"] for r in spark.table("engagement").collect()} == {"[REDACTED]"}
    entry["models"][0]["columns"].append({"name": "gone"})
    write(marts, entry)
    assert "missing" in pipeline.run(spark, root).errors[0]
    write(root / "config/policies.yml", {"pii_detection": {"patterns": [{"name": "x", "regex": "("}]}})
    with pytest.raises(project.ProjectError):
        project.ProjectConfig.load(root)


def test_tables_go_where_the_data_path_says(spark, tmp_path):
    root = make(tmp_path / "p")
    write(root / "palisade.yaml", f"name: shop\ndata-path: file://{tmp_path}/shared\nmodels:\n  staging: {{materialized: table}}\n")
    assert pipeline.run(spark, root).success
    assert TableStore(spark, f"file://{tmp_path}/shared/data").read("stg_users").count() == 40 and not (root / "target/data").exists()


def test_duplicate_stops_and_leaves_nothing(spark, tmp_path):
    root = make(tmp_path, users=USERS + "u0,dup@example.org,User,2024-01-01,pro\n")
    result = pipeline.run(spark, root)
    assert not result.success and "DUPLICATE" in result.errors[0]
    assert TableStore(spark, f"{root}/target/data").current("stg_users") is None and not list((root / "target/data/stg_users").glob("data-*")) and not (root / "target/state.json").exists()


def test_row_count_anomaly_stops(spark, tmp_path):
    root = make(tmp_path)
    assert pipeline.run(spark, root).success
    before = (root / "target/state.json").read_text()
    (root / "data/raw/users.csv").write_text("\n".join(USERS.split("\n")[:21]) + "\n")
    result = pipeline.run(spark, root)
    assert not result.success and "rows after" in result.errors[0] and (root / "target/state.json").read_text() == before


def test_lint_stops_unflagged_data(spark, tmp_path):
    root = make(tmp_path)
    (root / "config/policies.yml").write_text("{}")
    result = pipeline.run(spark, root)
    assert not result.success and "unflagged" in result.errors[0]


def test_bad_contracts_abort(tmp_path):
    root = make(tmp_path, **{"staging/stg_users.yml": {"models": [{"name": "stg_users", "columns": [{"name": "email", "policy": "hsh"}]}]}})
    with pytest.raises(project.ProjectError):
        project.discover(root, project.ProjectConfig.load(root))


def test_contract_versions(tmp_path):
    path = tmp_path / "m.yml"
    project.create_contract(path, "m", ["id", "email"], [("email", "hash")], "me")
    entry = project.contract_entries(path)[0]
    assert entry["status"] == "provisioning" and entry["latest"] and entry["columns"][1]["policy"] == "hash"
    assert project.append_columns(path, "m", ["ID", "extra"]) == ["extra"]
    project.set_status(path, "m", "active")
    project.add_version(path, "m", 2)
    assert [e["name"] for e in project.contract_entries(path) if e["latest"]] == ["m_v2"]
    for version, status in ((2, "provisioning"), (4, "provisioning"), (3, "erased"), (3, "active")):
        with pytest.raises(project.ProjectError):
            project.add_version(path, "m", version, status)
    with pytest.raises(project.ProjectError):
        project.set_status(path, "m_v2", "active")
    project.set_status(path, "m", "deprecated")
    project.set_status(path, "m_v2", "active")


def test_lineage(tmp_path, capsys):
    def model(name, level, refs=(), **columns):
        return project.Model(name, "", refs=list(refs), security=policy.SecurityLevel.parse(level), columns=[project.ColumnContract(c, policy=p) for c, p in columns.items()])

    leak = lineage.analyze(project.Manifest("p", {m.name: m for m in (model("a", "internal", email="hash"), model("b", "internal", ["a"], email=None))}))
    assert [(v.column, v.target) for v in leak.violations] == [("email", "b")] and "-. leak .->" in lineage.mermaid(leak)
    fall = lineage.analyze(project.Manifest("p", {m.name: m for m in (model("a", "restricted"), model("b", "public", ["a"]))}))
    assert [v.column for v in fall.violations] == ["*"]
    rise = lineage.analyze(project.Manifest("p", {m.name: m for m in (model("a", "internal"), model("b", "restricted", ["a"]))}))
    assert not rise.violations and rise.nodes[1]["critical"]
    root = make(tmp_path)
    assert cli.main(["--project-dir", str(root), "lineage", "--check", "--format", "json-ld"]) == 0
    graph = json.loads((root / "target/metadata_context.jsonld").read_text())["@graph"]
    assert [n["@id"] for n in graph] == ["model:engagement", "model:stg_activity", "model:stg_users"]
    (root / "target/state.json").write_text(json.dumps({"stg_users": {"row_count": 40, "columns": [["user_id", "string"], ["email", "string"]]}}))
    assert cli.main(["--project-dir", str(root), "docs"]) == 0 and "<i>string</i>" in (root / "target/index.html").read_text() and "stg_users" in (root / "target/index.html").read_text()
    assert cli.main(["--project-dir", str(root), "clean"]) == 0 and not (root / "target").exists()
    with pytest.raises(project.ProjectError):
        project.clean(root, ["../elsewhere"])
    capsys.readouterr()


def test_sources(tmp_path):
    root = make(tmp_path)
    assert [s["name"] for s in project.load_sources(root)] == ["raw_activity", "raw_users"]
    (root / "data/raw/users.csv").unlink()
    sources, warnings = project.generate_sources(root, root / "data")
    assert len(sources) == 2 and len(warnings) == 1
    assert len(project.generate_sources(root, root / "data", prune=True)[0]) == 1
    (root / "connections.yml").write_text("dev: {threads: 8}\n")
    assert project.load_connection(root / "connections.yml", "dev") == {"type": "spark", "threads": 8}


def test_connector(spark, tmp_path):
    c = SparkConnector(spark, tmp_path)
    df = spark.createDataFrame([(1, "Alice", 30), (2, "Bob", 25)], "id int, name string, age int")
    c.materialize("test_users", df, "view")
    assert c.query_scalar("SELECT count(*) FROM test_users") == 2 and c.fetch_columns("test_users")[0] == ("id", "int", True)
    assert c.fetch_column_averages("test_users", ["age"]) == {"age": 27.5}
    c.materialize("kept", df, "table", protected=True)
    assert c.materialize("kept", df.limit(1), "table", protected=True).count() == 2
    assert c.fetch_sample("SELECT * FROM test_users", 1).count() == 1
    c.execute("SELECT * FROM test_users")
    for call in (lambda: c.fetch_columns("nobody"), lambda: c.materialize("x", df, "strange"), lambda: c.query_scalar("SELECT id FROM test_users WHERE id > 5")):
        with pytest.raises(ConnectorError):
            call()
    with pytest.raises(ValueError):
        cli.query(spark, "  ")
    assert cli.query(spark, "SELECT 1 AS a")[0].first()["a"] == 1


def test_streams(spark, tmp_path):
    from palisade.operators import anomaly
    from palisade.streaming import guarded

    source = tmp_path / "in"
    rows = [("k", i, 1.0 + i % 3) for i in range(12)] + [("k", 12, 99.0)]
    spark.createDataFrame(rows, "k string, t int, v double").coalesce(1).write.parquet(str(source))
    stream = spark.readStream.schema("k string, t int, v double").parquet(str(source))
    guarded.write_guarded(stream, str(tmp_path / "out"), str(tmp_path / "cp"), policy.PolicySet({"k": "hash"}), {"t": ["unique"]}).awaitTermination(60)
    out = spark.read.parquet(str(tmp_path / "out"))
    assert out.count() == 13 and len(out.first()["k"]) == 64
    query = guarded.z_scores(stream, "k", "t", "v").writeStream.format("memory").queryName("verdicts").option("checkpointLocation", str(tmp_path / "cp2")).trigger(availableNow=True).start()
    query.awaitTermination(60)
    got = {int(r["time"]): r["verdict"] for r in spark.table("verdicts").collect()}
    state = None
    for _, t, v in rows:
        verdict, state = anomaly.z_update(v, state)
        assert got[t] == verdict
