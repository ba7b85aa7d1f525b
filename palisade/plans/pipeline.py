"""Running a project: layers of models, each rendered, masked, checked, published and compared with its history."""

from __future__ import annotations

import json
import time
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from dataclasses import asdict, dataclass, field
from datetime import datetime, timedelta, timezone
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from palisade.operators import anomaly, quality, scan
from palisade.plans import dag, policy, project, render, rules
from palisade.sources.connector import SparkConnector

CONCURRENCY = 8


@dataclass
class RunResult:
    success: bool
    models_executed: list[str] = field(default_factory=list)
    errors: list[str] = field(default_factory=list)
    warnings: list[str] = field(default_factory=list)
    seconds: float = 0.0


class ComplianceError(RuntimeError):
    """A check before or after publishing failed."""


def artifact_layer(name: str) -> str:
    return "staging" if name.startswith("stg_") else "intermediate" if name.startswith("int_") else "marts"


def load_state(path: Path) -> dict:
    """The state of earlier runs; a file that can't be read counts as none."""
    try:
        return json.loads(path.read_text(encoding="utf-8"))
    except (OSError, ValueError):
        return {}


class Audit:
    """Events of a run, appended to a log of JSON lines; entries older than the retention go."""

    def __init__(self, path: Path, settings: dict) -> None:
        self.path, self.settings = path, settings
        self.events: list[dict] = []

    def add(self, event: str, **details: object) -> None:
        wanted = self.settings.get("log_events")
        if self.settings.get("enabled", False) and (wanted is None or event in wanted):
            self.events.append({"at": datetime.now(timezone.utc).isoformat(), "event": event} | details)

    def save(self) -> None:
        if not self.settings.get("enabled", False):
            return
        oldest = (datetime.now(timezone.utc) - timedelta(days=self.settings.get("retention_days", 90))).isoformat()
        kept = [line for line in self.path.read_text(encoding="utf-8").splitlines() if json.loads(line)["at"] >= oldest] if self.path.exists() else []
        project.write_atomic(self.path, "".join(f"{line}\n" for line in [*kept, *map(json.dumps, self.events)]))


class _Run:
    def __init__(self, spark: SparkSession, root: Path, config: project.ProjectConfig, warn: Callable[[str], None]) -> None:
        self.spark, self.root, self.config, self.warn = spark, root, config, warn
        self.target = root / config.target_path
        self.connector = SparkConnector(spark, config.data_path or str(self.target))
        self.manifest = project.discover(root, config)
        self.state = load_state(self.target / "state.json")
        self.after: dict[str, dict] = {}
        self.audit = Audit(self.target / "audit.jsonl", config.audit)

    def register_sources(self) -> None:
        """A missing file is a warning: only models that use it fail."""
        for source in self.manifest.sources:
            path = str(source["path"])
            if "://" not in path and not path.startswith(("/", "file:")):
                path = str(self.root / path)
            if not self.connector.path_exists(path):
                self.warn(f"source {source['name']}: {path} is missing")
                continue
            self.connector.register_source(source["name"], path, source.get("schema"))

    def build(self, model: project.Model) -> None:
        sql = render.render(model.sql, {"model_name": model.name})
        layer = artifact_layer(model.name)
        project.write_atomic(self.target / "compiled" / layer / f"{model.name}.sql", sql)
        masked = policy.mask(self.spark.sql(sql), model.policies)
        project.write_atomic(self.target / "run" / layer / f"{model.name}.sql", sql)
        if self.config.strict and model.security > policy.SecurityLevel.PUBLIC:
            if found := scan.lint(masked, [c.name for c in model.columns if model.policies.is_masked(c.name)]):
                self.audit.add("data_blocked", model=model.name, columns=found)
                raise scan.GovernanceError(f"{model.name}: personal data in unflagged columns {found}")
        if len(model.policies):
            self.audit.add("pii_masked", model=model.name, columns=[c.name for c in model.columns if c.policy])
        if self._searched(model) and self.config.pii.get("auto_mask"):
            masked = scan.mask_matches(masked, self._texts(model, masked), self.config.patterns)
        if model.materialized == "incremental":
            self.warn(f"{model.name}: incremental models are rebuilt")
        if model.materialized in ("table", "incremental"):
            self._publish(model, masked)
        else:
            self._check(model, self.connector.materialize(model.name, masked, model.materialized, model.protected))
        self.audit.add("model_executed", model=model.name, rows=self.after[model.name]["row_count"])

    def _publish(self, model: project.Model, masked: DataFrame) -> None:
        """Write a version aside, check what was written, then publish it: a table that fails its tests is never seen."""
        tables = self.connector.tables
        if model.protected and tables.current(model.name):
            self._check(model, self.connector.open(model.name))
            return
        staged = tables.stage(model.name, masked)
        try:
            self._check(model, self.spark.read.parquet(staged))
        except BaseException:
            tables.discard(staged)
            raise
        tables.publish(model.name, staged)
        self.connector.open(model.name)

    # Checks: all that one pass over the table can answer is asked at once

    @staticmethod
    def _searched(model: project.Model) -> bool:
        return any(c.get("check") == "pii_detection" for c in model.pre_flight)

    @staticmethod
    def _texts(model: project.Model, built: DataFrame) -> list[str]:
        """Text columns that no policy masks."""
        return [f.name for f in built.schema.fields if isinstance(f.dataType, StringType) and not model.policies.is_masked(f.name)]

    def _check(self, model: project.Model, built: DataFrame) -> None:
        self._contract(model, built)
        keys = quality.test_keys(model.tests)
        bearing = [r for r in self.config.quality_rules if rules.bears_on(r, model.name, built.columns, keys)]
        context = rules.Context(lambda name: self.spark.table(name) if self.connector.exists(name) else None, keys)
        report = lambda rule, what: self.warn(f"{model.name}: rule {rule.get('name')!r} {what}")
        averaged = sorted({c["column"] for c in model.post_flight if c.get("check") == "z_score_anomaly" and c.get("column")})
        searched = [(c, p) for c in self._texts(model, built) for p in self.config.patterns if p.action != "ignore"] if self._searched(model) and self.config.pii.get("enabled", True) else []
        measured = quality.measure(
            built,
            quality.test_measures(model.tests) | rules.row_measures(bearing, context, report)
            | {f"mean {c}": F.avg(F.col(f"`{c}`").cast("double")) for c in averaged}
            | {(c, p): F.count_if(F.col(f"`{c}`").rlike(p.regex)) for c, p in searched},
            keys,
        )
        self._detect(model, [(c, p, measured[c, p]) for c, p in searched if measured[c, p]])
        try:
            count = quality.run_tests(built, model.tests, self.warn, measured)
        except quality.DataTestError as e:
            self.audit.add("quality_check_failed", model=model.name, error=str(e))
            raise
        found = {i: measured[i] for i in range(len(bearing)) if measured.get(i)} | {i: n for i, n in rules.table_violations(built, bearing, context, report).items() if n}
        for i in sorted(found):
            self.audit.add("quality_check_failed", model=model.name, rule=bearing[i]["name"], violations=found[i])
            self._route(f"{model.name}: {found[i]} violations of {bearing[i]['name']}", bearing[i].get("severity", "error"))
        self._post_flight(model, count, {c: measured[f"mean {c}"] for c in averaged if measured[f"mean {c}"] is not None})
        self.after[model.name]["columns"] = [[f.name, f.dataType.simpleString()] for f in built.schema.fields]

    def _contract(self, model: project.Model, built: DataFrame) -> None:
        new = quality.undocumented(built, [c.name for c in model.columns])
        if any(c.get("check") == "strict_schema_validation" for c in model.pre_flight):
            have = {c.lower() for c in built.columns}
            gone = [c.name for c in model.columns if c.name.lower() not in have and c.policy != "drop"]
            if new or gone:
                self._route(f"{model.name}: columns {new} are in no contract, {gone} are missing", "error")
        contract = (self.root / model.path).with_suffix(".yml")
        if new and contract.exists() and any(e.get("name") == model.name for e in project.contract_entries(contract)):
            project.append_columns(contract, model.name, new)
            self.warn(f"{model.name}: new columns {new} were added to the contract")
        elif not contract.exists() and not (self.root / model.path).with_suffix(".yaml").exists():
            project.create_contract(contract, model.name, built.columns, self.config.column_policies)

    def _detect(self, model: project.Model, hits: list[tuple[str, scan.Pattern, int]]) -> None:
        """What the search for personal data found: the guard, the boundary, and the environment's settings decide."""
        for column, pattern, n in hits:
            self.audit.add("pii_detected", model=model.name, column=column, rule=pattern.name, rows=n)
        found = [scan.Violation(p.name, p.severity, p.action, f"{n} rows of {c}") for c, p, n in hits]
        try:
            for message in scan.audit(found, self.config.pii.get("strict_mode", self.config.strict), model.name):
                self.warn(message)
            scan.check_boundary(str(model.security), found)
            if found and self.config.pii.get("fail_on_detection"):
                raise scan.GovernanceError(f"{model.name}: personal data in {sorted({c for c, _, _ in hits})}")
        except scan.GovernanceError:
            self.audit.add("data_blocked", model=model.name, rules=sorted({v.rule for v in found}))
            raise

    def _route(self, problem: str, severity: str) -> None:
        """An error stops a strict run; anything else is a warning."""
        if severity == "error" and self.config.strict:
            raise ComplianceError(problem)
        self.warn(problem)

    def _post_flight(self, model: project.Model, rows: int, means: dict[str, float]) -> None:
        before = self.state.get(model.name, {})
        metrics = {k: anomaly.MetricState(**v) for k, v in before.get("ml_metrics", {}).items()}
        for check in model.post_flight:
            severity = check.get("severity", "error")
            if check.get("check") == "row_count_anomaly":
                if anomaly.row_count_check(rows, before.get("row_count"), check.get("threshold", self.config.row_count_threshold)) == "anomaly":
                    self._route(f"{model.name}: {rows} rows after {before['row_count']}", severity)
            elif check.get("check") == "z_score_anomaly":
                column = check.get("column")
                if not column:
                    raise ComplianceError(f"{model.name}: z_score_anomaly needs a column")
                if column in means:
                    verdict, metrics[column] = anomaly.z_update(means[column], metrics.get(column), check.get("threshold", 3.0))
                    if verdict == "anomaly":
                        self._route(f"{model.name}: average of {column} is {means[column]}", severity)
        self.after[model.name] = {"last_run_at": datetime.now(timezone.utc).isoformat(), "row_count": rows, "ml_metrics": {k: asdict(v) for k, v in metrics.items()}}


def run(spark: SparkSession, project_dir: str | Path, select: str | None = None) -> RunResult:
    """Run a project, or one model of it. The first failing model ends the run after its layer; state is kept only of a run
    without failure."""
    began = time.time()
    root = Path(project_dir)
    config = project.ProjectConfig.load(root)
    result = RunResult(True)
    quoted = spark.conf.get("spark.sql.ansi.doubleQuotedIdentifiers")
    spark.conf.set("spark.sql.ansi.doubleQuotedIdentifiers", "true")
    try:
        job = _Run(spark, root, config, result.warnings.append)
        project.write_atomic(job.target / "manifest.json", json.dumps(job.manifest.to_dict(), indent=2))
        job.register_sources()
        planned = dag.select(dag.layers({n: m.refs for n, m in job.manifest.models.items()}), select)
        with ThreadPoolExecutor(CONCURRENCY) as pool:
            for layer in planned:
                for name, future in [(n, pool.submit(job.build, job.manifest.models[n])) for n in layer]:
                    try:
                        future.result()
                        result.models_executed.append(name)
                    except Exception as e:
                        result.errors.append(f"{name}: {e}")
                if result.errors:
                    break
        result.success = not result.errors
        job.audit.save()
        if result.success:
            project.write_atomic(job.target / "state.json", json.dumps(job.state | job.after, indent=2))
    finally:
        spark.conf.set("spark.sql.ansi.doubleQuotedIdentifiers", quoted)
    result.seconds = time.time() - began
    project.write_atomic(root / config.target_path / "run_results.json", json.dumps(asdict(result), indent=2))
    return result
