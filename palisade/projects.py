"""Named queries that run a project, a connector or a stream on the driver's tables and return what came of it, with oracles."""

from __future__ import annotations

import atexit
import json
import shutil
import tempfile
from collections.abc import Callable, Sequence
from concurrent.futures import ThreadPoolExecutor
from pathlib import Path

import yaml
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palisade import cli
from palisade.catalogue import Query
from palisade.operators import quality, scan
from palisade.plans import dag, lineage, pipeline, policy, project, render
from palisade.sources.connector import ConnectorError, SparkConnector
from palisade.sources.storage import TableStore, shared_folder

#: Runs of a project at a time, where a query makes many of them.
_RUNS_AT_ONCE = 4

_QUERIES: dict[str, Query] = {}
_ORACLES: dict[str, str] = {}


def _register(name: str, oracle: str) -> Callable[[Query], Query]:
    def put(query: Query) -> Query:
        _QUERIES[name], _ORACLES[name] = query, oracle
        return query

    return put


def queries() -> dict[str, Query]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_ORACLES)


def _values(columns: str, rows: Sequence[tuple]) -> str:
    text = lambda v: "NULL" if v is None else f"'{v}'" if isinstance(v, str) else str(v).lower()
    return f"SELECT * FROM (VALUES {', '.join('(' + ', '.join(map(text, r)) + ')' for r in rows)}) t({columns})"


def _table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def _scratch() -> Path:
    """A folder for project files, which only the driver reads."""
    path = tempfile.mkdtemp(prefix="palisade_project_")
    atexit.register(shutil.rmtree, path, ignore_errors=True)
    return Path(path)


def _apart(spark: SparkSession) -> SparkSession:
    """A session with the settings of ``spark`` and views of its own."""
    own = spark.newSession()
    for key, value in spark.conf.getAll.items():
        if own.conf.isModifiable(key):
            own.conf.set(key, value)
    return own


def _write(path: Path, data: object) -> None:
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(data if isinstance(data, str) else yaml.safe_dump(data, sort_keys=False), encoding="utf-8")


# Sources and sinks


@_register("source_csv", "SELECT * FROM customer")
def _(spark, d):
    """A CSV with a header and inferred types."""
    path = f"{shared_folder(spark)}/customer"
    _table(spark, d, "customer").write.csv(path, header=True)
    return SparkConnector(spark, shared_folder(spark)).register_source("csv_customer", path).select(F.col("c_custkey").cast("bigint"), "c_name", "c_nationkey", "c_acctbal", "c_mktsegment")


@_register("source_csv_schema", "SELECT * FROM orders")
def _(spark, d):
    """A CSV read with a given schema."""
    path, orders = f"{shared_folder(spark)}/orders", _table(spark, d, "orders")
    orders.write.option("header", True).option("timestampNTZFormat", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS").csv(path)
    return SparkConnector(spark, shared_folder(spark)).register_source("csv_orders", path, ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in orders.schema))


@_register("source_parquet", "SELECT * FROM part")
def _(spark, d):
    SparkConnector(spark, shared_folder(spark)).register_source("parquet_part", f"{d}/part.parquet")
    return spark.table("parquet_part")


@_register("sink_table", "SELECT * FROM lineitem")
def _(spark, d):
    return SparkConnector(spark, shared_folder(spark)).materialize("sink_lineitem", _table(spark, d, "lineitem"), "table")


@_register("sink_incremental", "SELECT s_suppkey, s_name FROM supplier")
def _(spark, d):
    """Incremental models replace the table."""
    c, df = SparkConnector(spark, shared_folder(spark)), _table(spark, d, "supplier")
    c.materialize("sink_supplier", df, "incremental")
    return c.materialize("sink_supplier", df.select("s_suppkey", "s_name"), "incremental")


@_register("materialize_view", "SELECT o_custkey, count(*) AS n FROM orders GROUP BY o_custkey")
def _(spark, d):
    c = SparkConnector(spark, shared_folder(spark))
    c.materialize("view_orders", _table(spark, d, "orders"), "view")
    return c.materialize("view_counts", spark.sql("SELECT o_custkey, count(*) AS n FROM view_orders GROUP BY o_custkey"), "ephemeral")


@_register("protected_table", "SELECT * FROM nation")
def _(spark, d):
    """A protected table that exists is kept."""
    c = SparkConnector(spark, shared_folder(spark))
    c.materialize("kept_nation", _table(spark, d, "nation"), "table")
    return c.materialize("kept_nation", _table(spark, d, "region"), "table", protected=True)


@_register("protected_view", "SELECT * FROM region")
def _(spark, d):
    c = SparkConnector(spark, shared_folder(spark))
    c.materialize("kept_region", _table(spark, d, "region"), "view")
    c.materialize("kept_region", _table(spark, d, "nation"), "view", protected=True)
    return spark.table("kept_region")


@_register("fetch_columns", "SELECT column_name, replace(replace(lower(column_type), 'varchar', 'string'), 'integer', 'int') AS type FROM (DESCRIBE SELECT * FROM part)")
def _(spark, d):
    c = SparkConnector(spark, shared_folder(spark))
    c.register_source("described_part", f"{d}/part.parquet")
    return spark.createDataFrame([(n, t) for n, t, _ in c.fetch_columns("described_part")], "column_name string, type string")


@_register("fetch_rows", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 500")
def _(spark, d):
    """The connector's sample of a query: its first 500 rows."""
    c = SparkConnector(spark, shared_folder(spark))
    c.register_source("fetched_orders", f"{d}/orders.parquet")
    c.execute("SELECT count(*) FROM fetched_orders")
    return c.fetch_sample("SELECT o_orderkey, o_totalprice FROM fetched_orders ORDER BY o_totalprice DESC, o_orderkey")


@_register("fetch_scalar", "SELECT count(*) AS n FROM lineitem")
def _(spark, d):
    c = SparkConnector(spark, shared_folder(spark))
    c.register_source("scalar_lineitem", f"{d}/lineitem.parquet")
    return spark.createDataFrame([(c.query_scalar("SELECT count(*) FROM scalar_lineitem"),)], "n bigint")


@_register("unknown_materialization", _values("kind, accepted", [("ephemeral", True), ("incremental", True), ("strange", False), ("table", True), ("view", True)]))
def _(spark, d):
    c, out = SparkConnector(spark, shared_folder(spark)), []
    for kind in ("view", "table", "ephemeral", "incremental", "strange"):
        try:
            out.append((kind, c.materialize("strategy_region", _table(spark, d, "region"), kind).count() == 5))
        except ConnectorError:
            out.append((kind, False))
    return spark.createDataFrame(out, "kind string, accepted boolean")


@_register("source_discovery", _values("name, path, warned", [("crm_users", "data/crm/users.csv", False), ("crm_users_1", "data/old/crm/users.csv", False), ("gone", "data/gone.csv", True), ("orders", "data/orders.parquet", False)]))
def _(spark, d):
    """Files found below a folder, with stable names; a known source whose file is gone stays with a warning."""
    root = _scratch()
    for name in ("crm/users.csv", "old/crm/users.csv", "orders.parquet", "notes.txt"):
        _write(root / "data" / name, "x\n")
    _write(root / "models/sources.yaml", {"sources": [{"name": "gone", "path": "data/gone.csv"}]})
    _, warnings = project.generate_sources(root, root / "data")
    return spark.createDataFrame([(s["name"], s["path"], any(s["name"] in w for w in warnings)) for s in project.load_sources(root)], "name string, path string, warned boolean")


@_register("source_pruning", _values("name, owner", [("a", "ann")]))
def _(spark, d):
    root = _scratch()
    _write(root / "data/a.csv", "x\n")
    _write(root / "models/sources.yaml", {"sources": [{"name": "gone", "path": "data/gone.csv"}]})
    _write(root / "palisade.yaml", "name: p\n")
    cli.main(["--project-dir", str(root), "generate", "--owner", "ann", "--prune"])
    return spark.createDataFrame([(s["name"], s["owner"]) for s in project.load_sources(root)], "name string, owner string")


@_register("connection_profile", _values("setting, value", [("database", "lake"), ("threads", "8"), ("type", "spark")]))
def _(spark, d):
    root = _scratch()
    _write(root / "connections.yml", {"dev": {"database": "lake", "threads": 8}})
    return spark.createDataFrame([(k, str(v)) for k, v in project.load_connection(root / "connections.yml", "dev").items()], "setting string, value string")


# A project over the driver's tables

_MODELS = {
    "staging/stg_customers": "SELECT c_custkey, c_name, concat(c_name, '@example.com') AS email, c_nationkey, c_acctbal, c_mktsegment FROM {{ source('shop', 'customer') }}",
    "staging/stg_orders": "SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice, CAST(o_orderdate AS DATE) AS day FROM {{ source('shop', 'orders') }}",
    "intermediate/int_spend": "SELECT o_custkey, count(*) AS orders, round(sum(o_totalprice), 2) AS spent FROM {{ ref('stg_orders') }} GROUP BY 1",
    "marts/customer_value": "SELECT c.c_custkey, c.email, {% for c in ['orders', 'spent'] %}coalesce(s.{{ c }}, 0) AS {{ c }}{% if not loop.last %}, {% endif %}{% endfor %} FROM {{ ref('stg_customers') }} c LEFT JOIN {{ ref('int_spend') }} s ON c.c_custkey = s.o_custkey",
    "marts/open_orders": "SELECT o_orderkey, o_custkey, day FROM {{ ref('stg_orders') }} WHERE o_orderstatus = {% if model_name == 'open_orders' %}'O'{% else %}'F'{% endif %}",
}
_CONTRACTS = {
    "staging/stg_customers": {"config": {"governance": {"security_level": "restricted"}, "protected": False}, "tech_owner": "data", "columns": [{"name": "c_custkey", "tests": ["unique", "not_null", "odd_test"]}, {"name": "c_name", "policy": "partial"}, {"name": "email"}, {"name": "c_nationkey"}, {"name": "c_acctbal"}]},
    "intermediate/int_spend": {"config": {"materialized": "view"}, "columns": [{"name": "o_custkey", "tests": ["unique"]}, {"name": "orders"}, {"name": "spent"}]},
    "marts/customer_value": {
        "config": {"materialized": "incremental"}, "description": "What customers spend.", "columns": [{"name": "c_custkey", "tests": ["not_null"]}, {"name": "email"}, {"name": "orders"}, {"name": "spent"}],
        "compliance": {"pre_flight": [{"check": "strict_schema_validation"}, {"check": "pii_detection"}], "post_flight": [{"check": "row_count_anomaly"}, {"check": "z_score_anomaly", "column": "spent"}, {"check": "strange"}]},
    },
}
_RULES = [
    {"name": "max_value", "column": "o_totalprice", "max_value": 300000}, {"name": "min_value", "column": "c_acctbal", "min_value": 0}, {"name": "accepted_values", "column": "o_orderstatus", "values": ["O", "F"]},
    {"name": "regex_match", "model": "stg_customers", "column": "c_mktsegment", "pattern": "^[A-M]"}, {"name": "date_range", "model": "stg_orders", "column": "day", "min_date": "1993-01-01", "max_date": "1997-06-30"},
    {"name": "sum_check", "model": "customer_value", "columns": ["spent", "orders"], "expected_sum": "< 1000000"}, {"name": "surrogate_key_uniqueness", "model": "stg_orders", "column": "o_custkey"},
    {"name": "referential_integrity", "model": "int_spend", "column": "o_custkey", "reference_table": "open_customers", "reference_column": "k"}, {"name": "not_null_columns", "model": "stg_customers", "columns": ["c_custkey", "c_mktsegment"]},
    {"name": "no_null_primary_keys"}, {"name": "date_validity", "model": "stg_customers", "column": "c_mktsegment"},
]


def _shop(d: str, data: str, **changes: object) -> Path:
    """The files of the project; ``changes`` replaces or adds some of them, by path."""
    root = _scratch()
    _write(root / "palisade.yaml", {"name": "shop", "data-path": data, "models": {"staging": {"materialized": "table"}, "marts": {"materialized": "table"}}})
    _write(root / "config/policies.yml", {"column_policies": [{"column_name_pattern": ".*email.*", "policy": "hash"}], "audit": {"enabled": True}})
    _write(root / "models/sources.yaml", {"sources": [{"name": f"shop_{t}", "path": f"{d}/{t}.parquet"} for t in ("customer", "orders")] + [{"name": "shop_gone", "path": f"{d}/gone.parquet"}]})
    for name, sql in _MODELS.items():
        _write(root / f"models/{name}.sql", sql)
    for name, contract in _CONTRACTS.items():
        _write(root / f"models/{name}.yml", {"models": [{"name": name.rpartition("/")[2]} | contract]})
    for name, data in changes.items():
        _write(root / name, data)
    return root


_RUNS: dict[tuple[str, str], tuple[Path, str, pipeline.RunResult]] = {}


def _run_shop(spark: SparkSession, d: str) -> tuple[Path, TableStore, pipeline.RunResult]:
    """The project after one run, which the queries about it share."""
    key = (spark.sparkContext.applicationId, d)
    if key not in _RUNS:
        data = shared_folder(spark)
        root = _shop(d, data)
        _RUNS[key] = root, data, pipeline.run(spark, root)
    root, data, result = _RUNS[key]
    if not result.success:
        raise RuntimeError("; ".join(result.errors))
    return root, TableStore(spark, f"{data}/data"), result


@_register("project_staging", "SELECT c_custkey, left(c_name, 2) || '***' AS c_name, sha256(c_name || '@example.com') AS email, c_nationkey, c_acctbal, c_mktsegment FROM customer")
def _(spark, d):
    return _run_shop(spark, d)[1].read("stg_customers")


@_register("project_mart", """
    SELECT c_custkey, sha256(sha256(c_name || '@example.com')) AS email, count(o_orderkey) AS orders, coalesce(round(sum(o_totalprice), 2), 0) AS spent
    FROM customer LEFT JOIN orders ON c_custkey = o_custkey GROUP BY c_custkey, c_name""")
def _(spark, d):
    return _run_shop(spark, d)[1].read("customer_value").withColumn("spent", F.round("spent", 2))


@_register("project_template", "SELECT o_orderkey, o_custkey, CAST(o_orderdate AS DATE) AS day FROM orders WHERE o_orderstatus = 'O'")
def _(spark, d):
    return _run_shop(spark, d)[1].read("open_orders")


@_register("project_state", """
    SELECT 'stg_customers' AS model, count(*) AS row_count, NULL::DOUBLE AS mean_spent FROM customer UNION ALL SELECT 'stg_orders', count(*), NULL FROM orders
    UNION ALL SELECT 'int_spend', count(DISTINCT o_custkey), NULL FROM orders UNION ALL SELECT 'open_orders', count(*), NULL FROM orders WHERE o_orderstatus = 'O'
    UNION ALL SELECT 'customer_value', (SELECT count(*) FROM customer), round((SELECT sum(o_totalprice) FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer)) / (SELECT count(*) FROM customer), 4)""")
def _(spark, d):
    """What a run keeps of each model for the next one."""
    state = pipeline.load_state(_run_shop(spark, d)[0] / "target/state.json")
    rows = [(name, s["row_count"], round(s["ml_metrics"]["spent"]["mean"], 4) if "spent" in s["ml_metrics"] else None) for name, s in state.items()]
    return spark.createDataFrame(rows, "model string, row_count bigint, mean_spent double")


@_register("project_order", _values("place, model", [(1, "stg_customers"), (2, "stg_orders"), (3, "int_spend"), (4, "open_orders"), (5, "customer_value")]))
def _(spark, d):
    return spark.createDataFrame(list(enumerate(_run_shop(spark, d)[2].models_executed, 1)), "place int, model string")


@_register("project_warnings", _values("warning, n", [("incremental", 1), ("missing source", 1), ("new columns", 1), ("unknown test", 1)]))
def _(spark, d):
    """A missing source, an unknown test, undocumented columns and an incremental model are warned of; an unknown check after publishing is not."""
    kinds = {"is missing": "missing source", "unknown test": "unknown test", "incremental models": "incremental", "new columns": "new columns"}
    found = [next((k for text, k in kinds.items() if text in w), w) for w in _run_shop(spark, d)[2].warnings]
    return spark.createDataFrame([(k, found.count(k)) for k in sorted(set(found))], "warning string, n int")


@_register("project_artifacts", _values("kind, layer, model", [(k, l, m) for k in ("compiled", "run") for l, m in (("intermediate", "int_spend"), ("marts", "customer_value"), ("marts", "open_orders"), ("staging", "stg_customers"), ("staging", "stg_orders"))] + [("manifest", None, m) for m in ("customer_value", "int_spend", "open_orders", "stg_customers", "stg_orders")]))
def _(spark, d):
    target = _run_shop(spark, d)[0] / "target"
    rows = [(kind, f.parent.name, f.stem) for kind in ("compiled", "run") for f in (target / kind).rglob("*.sql")]
    rows += [("manifest", None, m) for m in json.loads((target / "manifest.json").read_text())["nodes"]]
    return spark.createDataFrame(rows, "kind string, layer string, model string")


@_register("project_contracts", _values("model, col, status", [(m, c, s) for m, cs, s in (("stg_customers", ("c_custkey", "c_name", "email", "c_nationkey", "c_acctbal", "c_mktsegment"), "active"), ("stg_orders", ("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "day"), "provisioning")) for c in cs]))
def _(spark, d):
    """The contracts after a run: new columns are appended, a missing contract is created."""
    root, rows = _run_shop(spark, d)[0], []
    for model in ("stg_customers", "stg_orders"):
        for e in project.contract_entries(root / f"models/staging/{model}.yml"):
            rows += [(model, c["name"], e.get("status", "active")) for c in e["columns"]]
    return spark.createDataFrame(rows, "model string, col string, status string")


@_register("project_catalog", "SELECT 'stg_orders' AS model, * FROM (VALUES ('o_orderkey', 'bigint', NULL::VARCHAR), ('o_custkey', 'bigint', NULL), ('o_orderstatus', 'string', NULL), ('o_totalprice', 'double', NULL), ('day', 'date', NULL)) t(col, type, policy) UNION ALL SELECT 'customer_value', * FROM (VALUES ('c_custkey', 'bigint', NULL), ('email', 'string', 'hash'), ('orders', 'bigint', NULL), ('spent', 'double', NULL)) t(col, type, policy)")
def _(spark, d):
    root = _run_shop(spark, d)[0]
    cli.main(["--project-dir", str(root), "docs"])
    data = json.loads((root / "target/catalog.json").read_text())
    rows = [(a["name"], c["name"], c["type"], c["policy"]) for a in data["assets"] if a["name"] in ("stg_orders", "customer_value") for c in a["columns"]]
    return spark.createDataFrame(rows, "model string, col string, type string, policy string")


@_register("project_catalog_stats", _values("models, sources, masked_columns", [(5, 3, 3)]))
def _(spark, d):
    root = _run_shop(spark, d)[0]
    stats = lineage.catalog(project.discover(root, project.ProjectConfig.load(root)), {})["stats"]
    return spark.createDataFrame([(stats["models"], stats["sources"], stats["masked_columns"])], "models int, sources int, masked_columns int")


@_register("project_lineage", _values("parent, child, col, kind", [("int_spend", "customer_value", None, "edge"), ("stg_customers", "customer_value", None, "edge"), ("stg_orders", "int_spend", None, "edge"), ("stg_orders", "open_orders", None, "edge"), ("stg_customers", "customer_value", "email", "secured"), ("stg_customers", "customer_value", "*", "violation")]))
def _(spark, d):
    """Edges, flows of personal data, and falls of the security level, as the lineage file lists them."""
    root = _run_shop(spark, d)[0]
    cli.main(["--project-dir", str(root), "lineage", "--format", "json"])
    found = json.loads((root / "target/lineage.json").read_text())
    rows = [(*e, None, "edge") for e in found["edges"]] + [(f["source"], f["target"], f["column"], "secured" if f["secured"] else "leak") for f in found["flows"]]
    return spark.createDataFrame(rows + [(v["source"], v["target"], v["column"], "violation") for v in found["violations"]], "parent string, child string, col string, kind string")


@_register("project_lineage_check", _values("format, code, first_line", [("json", 1, "{"), ("json-ld", 1, "{"), ("mermaid", 1, "graph LR")]))
def _(spark, d):
    """The exit code of ``lineage --check`` where there are violations, in every format."""
    import contextlib
    import io

    root, rows = _run_shop(spark, d)[0], []
    for kind in ("mermaid", "json", "json-ld"):
        said = io.StringIO()
        with contextlib.redirect_stdout(said):
            code = cli.main(["--project-dir", str(root), "lineage", "--check", "--format", kind])
        rows.append((kind, code, said.getvalue().split("\n")[0]))
    return spark.createDataFrame(rows, "format string, code int, first_line string")


@_register("project_json_ld", _values("id, title, derived_from, description", [("model:customer_value", "customer_value", "model:int_spend model:stg_customers", "What customers spend."), ("model:int_spend", "int_spend", "model:stg_orders", None), ("model:open_orders", "open_orders", "model:stg_orders", None), ("model:stg_customers", "stg_customers", None, None), ("model:stg_orders", "stg_orders", None, None)]))
def _(spark, d):
    root = _run_shop(spark, d)[0]
    graph = json.loads(lineage.json_ld(project.discover(root, project.ProjectConfig.load(root))))["@graph"]
    rows = [(n["@id"], n["dct:title"], " ".join(x["@id"] for x in n["prov:wasDerivedFrom"]) if "prov:wasDerivedFrom" in n else None, n.get("dct:description")) for n in graph]
    return spark.createDataFrame(rows, "id string, title string, derived_from string, description string")


@_register("project_audit", _values("event, n", [("model_executed", 5), ("pii_masked", 2)]))
def _(spark, d):
    events = [json.loads(line)["event"] for line in (_run_shop(spark, d)[0] / "target/audit.jsonl").read_text().splitlines()]
    return spark.createDataFrame([(e, events.count(e)) for e in sorted(set(events))], "event string, n int")


@_register("project_rules", """
    WITH v AS (SELECT c_custkey, count(o_orderkey) AS orders, coalesce(round(sum(o_totalprice), 2), 0) AS spent FROM customer LEFT JOIN orders ON c_custkey = o_custkey GROUP BY c_custkey),
    found AS (SELECT 'stg_orders' AS model, 'max_value' AS rule, count(*) AS n FROM orders WHERE o_totalprice > 300000 UNION ALL SELECT 'stg_customers', 'min_value', count(*) FROM customer WHERE c_acctbal < 0
      UNION ALL SELECT 'stg_orders', 'accepted_values', count(*) FROM orders WHERE o_orderstatus NOT IN ('O', 'F') UNION ALL SELECT 'stg_customers', 'regex_match', count(*) FROM customer WHERE NOT regexp_matches(c_mktsegment, '^[A-M]')
      UNION ALL SELECT 'stg_orders', 'date_range', count(*) FROM orders WHERE CAST(o_orderdate AS DATE) NOT BETWEEN DATE '1993-01-01' AND DATE '1997-06-30' UNION ALL SELECT 'customer_value', 'sum_check', count(*) FROM v WHERE spent + orders >= 1000000
      UNION ALL SELECT 'stg_orders', 'surrogate_key_uniqueness', count(*) FROM (SELECT o_custkey FROM orders GROUP BY o_custkey HAVING count(*) > 1)
      UNION ALL SELECT 'int_spend', 'referential_integrity', count(DISTINCT o_custkey) FROM orders WHERE o_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'O')
      UNION ALL SELECT 'stg_customers', 'date_validity', count(*) FROM customer)
    SELECT * FROM found WHERE n > 0""")
def _(spark, d):
    """The violations that a run of the project with quality rules warns of."""
    _table(spark, d, "orders").where("o_orderstatus = 'O'").select(F.col("o_custkey").alias("k")).createOrReplaceTempView("open_customers")
    root = _shop(d, shared_folder(spark), **{"config/quality.yml": {"rules": [r | {"severity": "warn"} for r in _RULES]}})
    result = pipeline.run(spark, root)
    if not result.success:
        raise RuntimeError("; ".join(result.errors))
    found = [w.split(": ", 1) for w in result.warnings if " violations of " in w]
    return spark.createDataFrame([(m, text.split()[-1], int(text.split()[0])) for m, text in found], "model string, rule string, n bigint")


@_register("project_outcomes", _values("change, success, error", [
    ("none", True, None), ("duplicates", False, "DUPLICATE"), ("nulls", False, "NULL values"), ("row count", False, "rows after"), ("row count, severity warn", True, None), ("row count, not strict", True, None), ("row count, not strict, variable", False, "rows after"),
    ("average", False, "average of"), ("unflagged address", False, "unflagged"), ("missing source", False, "stg_customers"), ("cycle", False, "circle"), ("select", True, None), ("select nobody", True, None), ("boundary", False, "severe"), ("schema", False, "missing"),
]))
def _(spark, d):
    """How runs of the project end after a change: what stops them, and what is only warned of."""
    import os

    stg, mart = "models/staging/stg_customers", "models/marts/customer_value"
    history = lambda **s: json.dumps({"customer_value": {"row_count": 1, "ml_metrics": {}} | s})
    entry = lambda **c: {"models": [{"name": "customer_value"} | _CONTRACTS["marts/customer_value"] | c]}
    loose = lambda: {"name": "shop", "strict": False, "data-path": shared_folder(spark), "models": {"staging": {"materialized": "table"}}}
    twice = _MODELS["staging/stg_customers"]
    cases: dict[str, tuple[dict, str]] = {
        "none": ({}, ""), "duplicates": ({f"{stg}.sql": f"{twice} UNION ALL {twice}"}, "DUPLICATE"), "nulls": ({f"{stg}.sql": twice.replace("SELECT c_custkey", "SELECT nullif(c_custkey, 1) AS c_custkey")}, "NULL values"),
        "row count": ({"target/state.json": history()}, "rows after"), "row count, severity warn": ({"target/state.json": history(), f"{mart}.yml": entry(compliance={"post_flight": [{"check": "row_count_anomaly", "severity": "warning"}]})}, ""),
        "row count, not strict": ({"target/state.json": history(), "palisade.yaml": loose()}, ""), "row count, not strict, variable": ({"target/state.json": history(), "palisade.yaml": loose()}, "rows after"),
        "average": ({"target/state.json": history(row_count=None, ml_metrics={"spent": {"mean": -5.0, "variance": 1.0, "count": 9}})}, "average of"),
        "unflagged address": ({"config/policies.yml": {}}, "unflagged"), "missing source": ({"models/sources.yaml": {"sources": [{"name": "shop_nothing", "path": f"{d}/orders.parquet"}]}}, "stg_customers"),
        "cycle": ({"models/intermediate/int_spend.sql": "SELECT * FROM {{ ref('customer_value') }}"}, "circle"), "select": ({}, ""), "select nobody": ({}, ""),
        "boundary": ({"config/policies.yml": {"column_policies": [{"pattern": ".*email.*", "policy": "hash"}], "pii_detection": {"patterns": [{"name": "hex", "regex": "^Cu", "severity": "high", "action": "warn"}]}}, f"{mart}.sql": _MODELS["marts/customer_value"].replace("c.email,", "c.email, 'Customer' AS who,"), f"{mart}.yml": entry(columns=[{"name": c} for c in ("c_custkey", "email", "who", "orders", "spent")])}, "severe"),
        "schema": ({f"{mart}.yml": entry(columns=[{"name": c} for c in ("c_custkey", "email", "orders", "spent", "gone")])}, "missing"),
    }

    def end(name: str) -> tuple:
        changes, expected = cases[name]
        data = changes.get("palisade.yaml", {}).get("data-path") or shared_folder(spark)
        root = _shop(d, data, **changes)
        try:
            result = pipeline.run(_apart(spark), root, {"select": "stg_orders", "select nobody": "nobody"}.get(name))
            errors = result.errors
            if name.startswith("select") and result.models_executed != (["stg_orders"] if name == "select" else []):
                errors = [f"ran {result.models_executed}"]
        except (dag.CycleError, project.ProjectError) as e:
            errors = [str(e)]
        finally:
            TableStore(spark, data).discard(data)
        said = "; ".join(errors)
        return name, not errors, None if not errors else expected if expected and expected in said else said

    # The variable holds for the whole process. It makes runs strict, as all are but one, so it is set when that one is over.
    loose_one, strict_one = "row count, not strict", "row count, not strict, variable"
    with ThreadPoolExecutor(_RUNS_AT_ONCE) as pool:
        ends = {name: pool.submit(end, name) for name in sorted(cases, key=lambda n: n != loose_one) if name != strict_one}
        ends[loose_one].result()
        os.environ["PALISADE_STRICT"] = "1"
        try:
            rows = [e.result() for e in [*ends.values(), pool.submit(end, strict_one)]]
        finally:
            os.environ.pop("PALISADE_STRICT", None)
    return spark.createDataFrame(rows, "change string, success boolean, error string")


# Contracts, graphs and configuration


@_register("contract_versions", _values("step, outcome", [("activate", "ok"), ("add active", "refused"), ("add erased", "refused"), ("add version 2", "ok"), ("add version 2 again", "refused"), ("add version 4", "refused"), ("deprecate", "ok"), ("erase at once", "refused"), ("latest", "orders_v2"), ("two latest", "refused")]))
def _(spark, d):
    """The guards of contract versions and their lifecycle."""
    path, rows = _scratch() / "orders.yml", []

    def step(name: str, act: Callable[[], object]) -> None:
        try:
            act()
            rows.append((name, "ok"))
        except project.ProjectError:
            rows.append((name, "refused"))

    project.create_contract(path, "orders", _table(spark, d, "orders").columns, [(".*key.*", "hash")], "ann")
    step("erase at once", lambda: project.set_status(path, "orders", "erased"))
    step("activate", lambda: project.set_status(path, "orders", "active"))
    step("add version 4", lambda: project.add_version(path, "orders", 4))
    step("add erased", lambda: project.add_version(path, "orders", 2, "erased"))
    step("add active", lambda: project.add_version(path, "orders", 2, "active"))
    step("add version 2", lambda: project.add_version(path, "orders", 2))
    step("add version 2 again", lambda: project.add_version(path, "orders", 2))
    step("deprecate", lambda: project.set_status(path, "orders", "deprecated"))
    rows.append(("latest", next(e["name"] for e in project.contract_entries(path) if e["latest"])))
    step("two latest", lambda: project.check_family([{"name": "a", "latest": True}, {"name": "a_v2", "latest": True}], path))
    return spark.createDataFrame(rows, "step string, outcome string")


@_register("contract_created", "SELECT column_name AS col, CASE WHEN column_name LIKE '%key%' THEN 'hash' END AS policy, 1 AS version, 'provisioning' AS status FROM (DESCRIBE SELECT * FROM lineitem)")
def _(spark, d):
    path = _scratch() / "lineitem.yml"
    project.create_contract(path, "lineitem", _table(spark, d, "lineitem").columns, [(".*key.*", "hash")], "ann")
    entry = project.contract_entries(path)[0]
    return spark.createDataFrame([(c["name"], c.get("policy"), entry["version"], entry["status"]) for c in entry["columns"]], "col string, policy string, version int, status string")


@_register("contract_updated", "SELECT column_name AS col FROM (DESCRIBE SELECT * FROM customer)")
def _(spark, d):
    """A contract that lacked columns, after they were appended."""
    path, columns = _scratch() / "customer.yml", _table(spark, d, "customer").columns
    project.create_contract(path, "customer", columns[:2], owner="ann")
    project.append_columns(path, "customer", [columns[0].upper(), *quality.undocumented(_table(spark, d, "customer"), columns[:2])])
    return spark.createDataFrame([(c["name"],) for c in project.contract_entries(path)[0]["columns"]], "col string")


_STATES = ("provisioning", "active", "deprecated", "erased")


@_register("lifecycle", f"WITH s AS (SELECT unnest({list(_STATES)}) AS name, unnest([0, 1, 2, 3]) AS place) SELECT a.name AS before, b.name AS after, b.place - a.place IN (0, 1) AS allowed FROM s a, s b")
def _(spark, d):
    return spark.createDataFrame([(a, b, policy.can_transition(a, b)) for a in _STATES for b in _STATES], "before string, after string, allowed boolean")


_GRAPH = {"a": [], "b": ["a"], "c": ["a"], "d": ["b", "c"], "e": ["d", "a"], "f": []}


@_register("dag_layers", f"""
    WITH RECURSIVE n AS ({_values('name', [(n,) for n in _GRAPH])}), e AS ({_values('child, parent', [(c, p) for c, ps in _GRAPH.items() for p in ps])}),
    r AS (SELECT name, 0 AS depth FROM n UNION SELECT e.child, r.depth + 1 FROM r JOIN e ON e.parent = r.name)
    SELECT name AS model, max(depth)::INTEGER AS layer FROM r GROUP BY name""")
def _(spark, d):
    return spark.createDataFrame([(m, i) for i, layer in enumerate(dag.layers(_GRAPH)) for m in layer], "model string, layer int")


@_register("dag_refusals", _values("graph, outcome", [("cycle", "CycleError"), ("dangling", "MissingModelError"), ("select", "b"), ("select nobody", "")]))
def _(spark, d):
    rows = []
    for name, graph in (("cycle", {"a": ["b"], "b": ["a"]}), ("dangling", {"a": ["z"]})):
        try:
            dag.layers(graph)
        except ValueError as e:
            rows.append((name, type(e).__name__))
    for name, wanted in (("select", "b"), ("select nobody", "z")):
        rows.append((name, " ".join(m for layer in dag.select(dag.layers(_GRAPH), wanted) for m in layer)))
    return spark.createDataFrame(rows, "graph string, outcome string")


@_register("template_references", _values("name", [("orders",), ("customers",), ("old",)]))
def _(spark, d):
    """References are found in the raw text, comments included, each once."""
    text = "-- {{ ref('old') }}\nSELECT * FROM {{ ref('orders') }} JOIN {{ ref(\"customers\") }} JOIN {{ ref('orders') }}"
    return spark.createDataFrame([(n,) for n in render.references(text)], "name string")


@_register("flagged_columns", _values("policy, flagged", [(p, p in policy.MASKING) for p in policy.POLICIES] + [("none", False)]))
def _(spark, d):
    """Which policies count as masking: encryption and drop don't."""
    rows = [(p, policy.PolicySet({"x": p}).is_masked("x")) for p in policy.POLICIES]
    return spark.createDataFrame([*rows, ("none", policy.PolicySet().is_masked("x"))], "policy string, flagged boolean")


@_register("column_policies", _values("col, policy", [("email", "hash"), ("phone_number", "hash"), ("ssn", "drop"), ("email_hash", None), ("name", None)]))
def _(spark, d):
    root = _scratch()
    _write(root / "palisade.yaml", "name: p\n")
    listed = [{"column_name_pattern": p, "policy": a, "environments": ["dev"]} for p, a in ((".*email.*", "hash"), (".*phone.*", "hash"), (".*ssn.*", "drop"))]
    _write(root / "config/policies.yml", {"pii_detection": {"column_policies": listed}})
    patterns = project.ProjectConfig.load(root).column_policies
    return spark.createDataFrame([(c, policy.fuzzy_policy(c, patterns)) for c in ("email", "phone_number", "ssn", "email_hash", "name")], "col string, policy string")


@_register("security_boundary", """
    SELECT level, severity, level IN ('public', 'internal') AND severity IN ('high', 'critical') AS refused
    FROM (SELECT unnest(['public', 'internal', 'confidential', 'restricted']) AS level), (SELECT unnest(['low', 'medium', 'high', 'critical']) AS severity)""")
def _(spark, d):
    rows = []
    for level in policy.SecurityLevel:
        for severity in scan.SEVERITIES:
            try:
                scan.check_boundary(str(level), [scan.Violation("x", severity, "warn", "x")])
                rows.append((str(level), severity, False))
            except scan.GovernanceError:
                rows.append((str(level), severity, True))
    return spark.createDataFrame(rows, "level string, severity string, refused boolean")


@_register("project_defaults", _values("setting, value", [("clean_targets", "target"), ("profile", "dev"), ("row_count_threshold", "0.1"), ("security_level", "internal"), ("strict", "true"), ("target_path", "target")]))
def _(spark, d):
    root = _scratch()
    _write(root / "palisade.yml", "name: p\n")
    c = project.ProjectConfig.load(root)
    rows = [("profile", c.profile), ("target_path", c.target_path), ("clean_targets", " ".join(c.clean_targets)), ("strict", str(c.strict).lower()), ("row_count_threshold", str(c.row_count_threshold)), ("security_level", c.security_level)]
    return spark.createDataFrame(rows, "setting string, value string")


@_register("project_overrides", _values("setting, value", [("fail_on_detection", "true"), ("name", "shop"), ("profile", "prod"), ("target_path", "elsewhere")]))
def _(spark, d):
    """The process's variables override target and profile; the profile's environment overrides the detection of personal data."""
    import os

    root = _scratch()
    _write(root / "palisade.yaml", {"name": "shop", "profile": "dev", "target-path": "t"})
    _write(root / "config/policies.yml", {"pii_detection": {"fail_on_detection": False}, "environments": {"prod": {"pii_detection": {"fail_on_detection": True}}}})
    os.environ |= {"PALISADE_TARGET_PATH": "elsewhere", "PALISADE_PROFILE": "prod"}
    try:
        c = project.ProjectConfig.load(root)
    finally:
        del os.environ["PALISADE_TARGET_PATH"], os.environ["PALISADE_PROFILE"]
    return spark.createDataFrame([("name", c.name), ("profile", c.profile), ("target_path", c.target_path), ("fail_on_detection", str(c.pii["fail_on_detection"]).lower())], "setting string, value string")


@_register("project_clean", _values("target, outcome", [("../elsewhere", "refused"), (".", "refused"), ("build", "deleted"), ("nothing", "absent")]))
def _(spark, d):
    root, rows = _scratch(), []
    _write(root / "build/x", "x")
    for target in ("build", "nothing", "../elsewhere", "."):
        try:
            rows.append((target, "deleted" if project.clean(root, [target]) else "absent"))
        except project.ProjectError:
            rows.append((target, "refused"))
    return spark.createDataFrame(rows, "target string, outcome string")


@_register("command_query", "SELECT c_mktsegment, count(*) AS n FROM customer GROUP BY c_mktsegment")
def _(spark, d):
    """The helper behind the command ``query``."""
    SparkConnector(spark, shared_folder(spark)).register_source("asked_customer", f"{d}/customer.parquet")
    return cli.query(spark, "SELECT c_mktsegment, count(*) AS n FROM asked_customer GROUP BY c_mktsegment")[0]


# Streams


def _stream(spark: SparkSession, d: str, name: str) -> DataFrame:
    """A table's file as a stream: one of its folder, which is what a stream reads."""
    return spark.readStream.schema(_table(spark, d, name).schema).option("pathGlobFilter", f"{name}.parquet").parquet(d)


@_register("stream_masked", "SELECT event_id, sha256(cast(user_id AS varchar)) AS user_id, event_type, value FROM events")
def _(spark, d):
    """Micro-batches of the events, masked and tested before they are written."""
    from palisade.streaming import guarded

    folder = shared_folder(spark)
    stream = _stream(spark, d, "events")
    guarded.write_guarded(stream, f"{folder}/out", f"{folder}/checkpoint", policy.PolicySet({"user_id": "hash"}), {"event_id": ["unique", "not_null"]}).awaitTermination()
    return spark.read.parquet(f"{folder}/out").select("event_id", "user_id", "event_type", "value")


@_register("stream_zscores", """
    WITH RECURSIVE r AS (SELECT event_type, event_id, value AS v, row_number() OVER (PARTITION BY event_type ORDER BY event_id) AS i FROM events),
    f AS (SELECT event_type, event_id, v, i, 'no_history' AS verdict, v AS mean, 0.0::DOUBLE AS var, 1::BIGINT AS n FROM r WHERE i = 1
      UNION ALL SELECT event_type, event_id, v, i, verdict, CASE WHEN verdict = 'anomaly' THEN mean ELSE m2 END, CASE WHEN verdict = 'anomaly' THEN var ELSE (var * n + (v - mean) * (v - m2)) / (n + 1) END,
          CASE WHEN verdict = 'anomaly' THEN n ELSE n + 1 END FROM (
        SELECT r.event_type, r.event_id, r.v, r.i, f.mean, f.var, f.n, f.mean + (r.v - f.mean) / (f.n + 1) AS m2,
            CASE WHEN f.n < 2 THEN 'no_history' WHEN sqrt(f.var) <= 1e-9 THEN 'ok' WHEN abs(r.v - f.mean) / sqrt(f.var) > 3 THEN 'anomaly' ELSE 'ok' END AS verdict
        FROM f JOIN r ON r.event_type = f.event_type AND r.i = f.i + 1))
    SELECT event_type, verdict, count(*) AS n FROM f GROUP BY ALL""")
def _(spark, d):
    """The verdicts of a stream that keeps each key's history, counted."""
    from palisade.streaming import guarded

    folder = shared_folder(spark)
    stream = _stream(spark, d, "events")
    verdicts = guarded.z_scores(stream, "event_type", "event_id", "value")
    verdicts.writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(f"{folder}/out").groupBy(F.col("key").alias("event_type"), "verdict").agg(F.count("*").alias("n"))
