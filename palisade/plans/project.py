"""Projects: configuration, discovery of models and contracts, and changes to contracts."""

from __future__ import annotations

import os
import re
import subprocess
import tempfile
from dataclasses import dataclass, field
from pathlib import Path

import yaml

from palisade.operators import scan
from palisade.plans import policy, render

CONFIG_NAMES = ("palisade.yaml", "palisade.yml")
MATERIALIZATIONS = ("view", "table", "ephemeral", "incremental")


class ProjectError(ValueError):
    """A project file that can't be used."""


def write_atomic(path: Path, text: str) -> None:
    """Replace a file by one rename, so that readers see the old or the new text."""
    path.parent.mkdir(parents=True, exist_ok=True)
    handle, name = tempfile.mkstemp(dir=path.parent, prefix=f".{path.name}.")
    try:
        with os.fdopen(handle, "w", encoding="utf-8") as f:
            f.write(text)
            f.flush()
            os.fsync(f.fileno())
        os.replace(name, path)
    except BaseException:
        Path(name).unlink(missing_ok=True)
        raise


def _load(path: Path) -> dict:
    try:
        data = yaml.safe_load(path.read_text(encoding="utf-8"))
    except yaml.YAMLError as e:
        raise ProjectError(f"{path}: {e}") from e
    return data or {}


@dataclass
class ProjectConfig:
    name: str = "project"
    version: str = "0.1.0"
    profile: str = "dev"
    target_path: str = "target"
    clean_targets: list[str] = field(default_factory=lambda: ["target"])
    strict: bool = True
    row_count_threshold: float = 0.1
    security_level: str = "internal"
    layers: dict[str, dict] = field(default_factory=dict)
    column_policies: list[tuple[str, str]] = field(default_factory=list)
    pii_patterns: list[dict] = field(default_factory=list)
    pii: dict = field(default_factory=dict)
    audit: dict = field(default_factory=dict)
    quality_rules: list[dict] = field(default_factory=list)
    data_path: str | None = None

    @property
    def patterns(self) -> tuple[scan.Pattern, ...]:
        """The project's patterns of personal data, or the default ones."""
        given = [scan.Pattern(p["name"], p["regex"], p.get("severity", "medium"), p.get("action", "warn"), p.get("masking_strategy", "redact")) for p in self.pii_patterns]
        return tuple(given) or scan.DEFAULT_PATTERNS

    @classmethod
    def load(cls, project: Path) -> ProjectConfig:
        """The configuration with its satellites ``config/policies.yml`` and ``config/quality.yml``.

        Variables of the process override target, profile and strictness. What ``environments`` says of the profile overrides the
        settings of ``pii_detection``, and may switch the quality rules off. Tables go to ``data-path``, a folder or URI that all
        executors share; without it to the target.
        """
        path = next((project / n for n in CONFIG_NAMES if (project / n).exists()), None)
        if path is None:
            raise ProjectError(f"no {CONFIG_NAMES[0]} in {project}")
        data = _load(path)
        out = cls()
        for key, attribute in (("name", "name"), ("version", "version"), ("profile", "profile"), ("target-path", "target_path"), ("data-path", "data_path"), ("clean-targets", "clean_targets"), ("strict", "strict"), ("row_count_threshold", "row_count_threshold")):
            if key in data:
                setattr(out, attribute, data[key])
        out.layers = data.get("models") or {}
        governance = data.get("governance") or {}
        out.security_level = governance.get("default_security_level", out.security_level)
        policy.SecurityLevel.parse(out.security_level)
        for name in ("policies.yml", "policies.yaml"):
            if (extra := project / "config" / name).exists():
                loaded = _load(extra)
                governance = governance | loaded.get("governance", loaded)
        detection = governance.get("pii_detection") or {}
        listed = [*(governance.get("column_policies") or []), *(detection.get("column_policies") or [])]
        out.column_policies = [(c["pattern"] if "pattern" in c else c["column_name_pattern"], policy.parse_policy(c["policy"])) for c in listed]
        for pattern, _ in out.column_policies:
            try:
                re.compile(pattern)
            except re.error as e:
                raise ProjectError(f"column policy {pattern!r}: {e}") from e
        out.pii_patterns = detection.get("patterns") or []
        out.audit = governance.get("audit") or {}
        quality_environments: dict = {}
        for name in ("quality.yml", "quality.yaml"):
            if (extra := project / "config" / name).exists():
                loaded = _load(extra)
                settings = loaded.get("data_quality") or {}
                out.quality_rules = [*(loaded.get("rules") or []), *(settings.get("rules") or [])]
                quality_environments = settings.get("environments") or {}
        out.target_path = os.environ.get("PALISADE_TARGET_PATH", out.target_path)
        out.profile = os.environ.get("PALISADE_PROFILE", out.profile)
        if "PALISADE_STRICT" in os.environ:
            out.strict = True
        out.data_path = os.environ.get("PALISADE_DATA_PATH", out.data_path)
        own = ((governance.get("environments") or {}).get(out.profile) or {}).get("pii_detection") or {}
        out.pii = {k: v for k, v in detection.items() if k not in ("patterns", "column_policies")} | own
        try:
            out.patterns
        except (KeyError, ValueError, re.error) as e:
            raise ProjectError(f"pii_detection: {e}") from e
        if not (quality_environments.get(out.profile) or {}).get("enabled", True):
            out.quality_rules = []
        return out


@dataclass
class ColumnContract:
    name: str
    tests: list[str] = field(default_factory=list)
    policy: str | None = None
    description: str = ""


@dataclass
class Model:
    """One relation: its SQL, contract and governance."""

    name: str
    sql: str
    path: str = ""
    layer: str = ""
    refs: list[str] = field(default_factory=list)
    columns: list[ColumnContract] = field(default_factory=list)
    materialized: str = "view"
    protected: bool = False
    security: policy.SecurityLevel = policy.SecurityLevel.INTERNAL
    status: str = "active"
    tech_owner: str | None = None
    business_owner: str | None = None
    description: str = ""
    pre_flight: list[dict] = field(default_factory=list)
    post_flight: list[dict] = field(default_factory=list)

    @property
    def policies(self) -> policy.PolicySet:
        return policy.PolicySet.from_pairs((c.name, c.policy) for c in self.columns if c.policy)

    @property
    def tests(self) -> dict[str, list[str]]:
        return {c.name: c.tests for c in self.columns if c.tests}


@dataclass
class Manifest:
    project: str
    models: dict[str, Model] = field(default_factory=dict)
    sources: list[dict] = field(default_factory=list)

    def to_dict(self) -> dict:
        nodes = {}
        for name in sorted(self.models):
            m = self.models[name]
            nodes[name] = {
                "name": name, "path": m.path, "resource_type": "model", "refs": sorted(m.refs), "materialized": m.materialized, "protected": m.protected,
                "security_level": str(m.security), "status": m.status, "columns": [{"name": c.name, "tests": c.tests, "policy": c.policy} for c in m.columns],
            }
        return {"project": self.project, "nodes": nodes, "sources": self.sources}


def _test_names(tests: list | None) -> list[str]:
    return [t if isinstance(t, str) else next(iter(t)) for t in tests or []]


def contract_entries(path: Path) -> list[dict]:
    """The model entries of a contract file: a list under ``models``, or one bare model."""
    data = _load(path)
    if isinstance(data, list):
        return data
    if "models" in data:
        return data["models"] or []
    return [data] if "name" in data else []


def check_family(entries: list[dict], path: Path) -> None:
    """At most one entry of a family of versions is the latest, and at most one active."""
    for mark, having in (("latest", lambda e: e.get("latest")), ("active", lambda e: e.get("status") == "active")):
        families: dict[str, int] = {}
        for e in entries:
            if having(e):
                base = re.sub(r"_v\d+$", "", e["name"])
                families[base] = families.get(base, 0) + 1
        if any(n > 1 for n in families.values()):
            raise ProjectError(f"{path}: more than one {mark} version")


def discover(project: Path, config: ProjectConfig) -> Manifest:
    """All models under ``models/``: SQL files with the contract beside them. A contract that can't be read is an error."""
    manifest = Manifest(config.name, sources=load_sources(project))
    root = project / "models"
    for file in sorted(root.rglob("*.sql")):
        name = file.stem
        if name in manifest.models:
            raise ProjectError(f"two models are named {name}")
        layer = file.relative_to(root).parts[0] if len(file.relative_to(root).parts) > 1 else ""
        defaults = config.layers.get(layer) or {}
        entry: dict = {}
        for suffix in (".yml", ".yaml"):
            if (beside := file.with_suffix(suffix)).exists():
                entries = contract_entries(beside)
                check_family(entries, beside)
                entry = next((e for e in entries if e.get("name") == name), next((e for e in entries if e.get("latest")), entries[0] if entries else {}))
        settings = entry.get("config") or {}
        governance = settings.get("governance") or {}
        level = governance.get("security_level", settings.get("security_level", entry.get("security_level")))
        try:
            security = policy.SecurityLevel.parse(level, policy.SecurityLevel.parse(config.security_level))
            columns = []
            for c in entry.get("columns") or []:
                given = c.get("policy") or (c.get("governance") or {}).get("policy")
                columns.append(ColumnContract(c["name"], _test_names(c.get("tests")), policy.parse_policy(given) if given else policy.fuzzy_policy(c["name"], config.column_policies), c.get("description", "")))
        except ValueError as e:
            raise ProjectError(f"{file}: {e}") from e
        materialized = settings.get("materialized", defaults.get("materialized", "view"))
        if materialized not in MATERIALIZATIONS:
            raise ProjectError(f"{file}: unknown materialization {materialized!r}")
        compliance = entry.get("compliance") or settings.get("compliance") or {}
        sql = file.read_text(encoding="utf-8")
        manifest.models[name] = Model(
            name, sql, str(file.relative_to(project)), layer, sorted(render.references(sql)), columns, materialized,
            bool(settings.get("protected", defaults.get("protected", level is not None and security > policy.SecurityLevel.PUBLIC))),
            security, entry.get("status", "active"), entry.get("tech_owner", entry.get("owner")), entry.get("business_owner"), entry.get("description", ""),
            compliance.get("pre_flight") or [], compliance.get("post_flight") or [],
        )
    return manifest


# Contracts


def git_user() -> str:
    try:
        return subprocess.run(["git", "config", "user.name"], capture_output=True, text=True, timeout=5).stdout.strip() or "unknown"
    except OSError:
        return "unknown"


def create_contract(path: Path, model: str, columns: list[str], patterns: list[tuple[str, str]] = (), owner: str | None = None) -> None:
    """Write version 1 of a contract: a table, provisioning, latest."""
    entry = {
        "name": model, "version": 1, "latest": True, "status": "provisioning", "owner": owner or git_user(), "config": {"materialized": "table"},
        "columns": [{"name": c, "tests": []} | ({"policy": p} if (p := policy.fuzzy_policy(c, patterns)) else {}) for c in columns],
    }
    write_atomic(path, yaml.safe_dump({"models": [entry]}, sort_keys=False))


def append_columns(path: Path, model: str, columns: list[str]) -> list[str]:
    """Add the columns that the contract lacks, whatever their case; returns them."""
    entries = contract_entries(path)
    entry = next((e for e in entries if e.get("name") == model), None)
    if entry is None:
        raise ProjectError(f"{path} has no model {model}")
    known = {c["name"].lower() for c in entry.get("columns") or []}
    new = [c for c in columns if c.lower() not in known]
    if new:
        entry.setdefault("columns", []).extend({"name": c, "tests": []} for c in new)
        write_atomic(path, yaml.safe_dump({"models": entries}, sort_keys=False))
    return new


def add_version(path: Path, family: str, version: int, status: str = "provisioning", columns: list[dict] | None = None) -> None:
    """Add version ``version`` of a family: its predecessor must exist, it must not, and it can't begin deprecated or erased."""
    entries = contract_entries(path)
    have = {e.get("version", 1): e for e in entries if re.sub(r"_v\d+$", "", e["name"]) == family}
    if version in have:
        raise ProjectError(f"version {version} of {family} exists")
    if version > 1 and version - 1 not in have:
        raise ProjectError(f"version {version - 1} of {family} is missing")
    if status in ("deprecated", "erased"):
        raise ProjectError(f"a version can't begin {status}")
    if status not in policy.LIFECYCLE:
        raise ProjectError(f"unknown status {status!r}")
    if status == "active" and any(e.get("status") == "active" for e in have.values()):
        raise ProjectError(f"{family} has an active version")
    for e in have.values():
        e["latest"] = False
    before = have.get(version - 1, {})
    entries.append({"name": family if version == 1 else f"{family}_v{version}", "version": version, "latest": True, "status": status, "columns": columns if columns is not None else before.get("columns", [])})
    write_atomic(path, yaml.safe_dump({"models": entries}, sort_keys=False))


def set_status(path: Path, name: str, status: str) -> None:
    """Move a version along its lifecycle; of a family only one version is active."""
    entries = contract_entries(path)
    entry = next((e for e in entries if e["name"] == name), None)
    if entry is None:
        raise ProjectError(f"{path} has no model {name}")
    if not policy.can_transition(entry.get("status", "provisioning"), status):
        raise ProjectError(f"{name} can't go from {entry.get('status')} to {status}")
    entry["status"] = status
    check_family(entries, path)
    write_atomic(path, yaml.safe_dump({"models": entries}, sort_keys=False))


# Sources


def stable_name(data_dir: Path, file: Path) -> str:
    """The stem for a file in the data folder itself, else the parent folder's name and the stem."""
    return file.stem if file.parent == data_dir else f"{file.parent.name}_{file.stem}"


def load_sources(project: Path) -> list[dict]:
    path = project / "models" / "sources.yaml"
    return (_load(path).get("sources") or []) if path.exists() else []


def generate_sources(project: Path, data_dir: Path, owner: str | None = None, pii: bool = False, security: str = "internal", prune: bool = False) -> tuple[list[dict], list[str]]:
    """Find CSV and Parquet files and merge them into ``models/sources.yaml`` by path; returns sources and warnings.

    Known sources keep what was edited. One whose file is gone stays with a warning, or goes with ``prune``.
    """
    old = {s["path"]: s for s in load_sources(project)}
    found: dict[str, dict] = {}
    names = {s["name"] for s in old.values()}
    for file in sorted(p for p in data_dir.rglob("*") if p.suffix in (".csv", ".parquet") and not any(q.suffix == ".parquet" for q in p.parents)):
        path = os.path.relpath(file, project)
        if path in old:
            found[path] = old[path]
            continue
        base = name = stable_name(data_dir, file)
        n = 0
        while name in names:
            n += 1
            name = f"{base}_{n}"
        names.add(name)
        found[path] = {"name": name, "path": path, "owner": owner, "governance": {"pii": pii, "security_level": security}}
    warnings = []
    for path, source in old.items():
        if path not in found:
            if not prune:
                found[path] = source
                warnings.append(f"source {source['name']}: {path} is missing")
    sources = sorted(found.values(), key=lambda s: s["name"])
    write_atomic(project / "models" / "sources.yaml", yaml.safe_dump({"sources": sources}, sort_keys=False))
    return sources, warnings


def load_connection(path: Path, profile: str) -> dict:
    """A connection profile: type, database, threads and so on."""
    profiles = _load(path)
    if profile not in profiles:
        raise ProjectError(f"no profile {profile!r} in {path}")
    return {"type": "spark", "threads": 4} | (profiles[profile] or {})


def clean(project: Path, targets: list[str]) -> list[str]:
    """Delete build folders; a target outside the project is an error."""
    import shutil

    gone = []
    root = project.resolve()
    for target in targets:
        path = (project / target).resolve()
        if path == root or not path.is_relative_to(root):
            raise ProjectError(f"unsafe path {target!r}")
        if path.exists():
            shutil.rmtree(path)
            gone.append(target)
    return gone
