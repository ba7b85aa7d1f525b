"""Lineage of personal data and security levels, and its renderings; the catalog."""

from __future__ import annotations

import html
import json
from dataclasses import asdict, dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palisade.plans.project import Manifest


@dataclass
class PiiFlow:
    source: str
    target: str
    column: str
    secured: bool


@dataclass
class Violation:
    source: str
    target: str
    column: str
    message: str


@dataclass
class Report:
    nodes: list[dict] = field(default_factory=list)
    edges: list[tuple[str, str]] = field(default_factory=list)
    flows: list[PiiFlow] = field(default_factory=list)
    violations: list[Violation] = field(default_factory=list)

    def to_json(self) -> str:
        return json.dumps(asdict(self), indent=2)


def analyze(manifest: Manifest) -> Report:
    """Where columns with a policy go by name, and where the security level falls.

    A downstream column of the same name is secured if it has any policy. A child below its parent's level violates with
    column ``*``; a node above one of its parents is critical. Everything is sorted.
    """
    report = Report()
    for name in sorted(manifest.models):
        node = manifest.models[name]
        parents = [manifest.models[p] for p in sorted(node.refs) if p in manifest.models]
        report.nodes.append({"name": name, "security_level": str(node.security), "critical": any(node.security > p.security for p in parents)})
        own = {c.name: c.policy for c in node.columns}
        for parent in parents:
            report.edges.append((parent.name, name))
            for c in parent.columns:
                if c.policy and c.name in own:
                    secured = own[c.name] is not None
                    report.flows.append(PiiFlow(parent.name, name, c.name, secured))
                    if not secured:
                        report.violations.append(Violation(parent.name, name, c.name, f"{c.name} has policy {c.policy} in {parent.name} and none in {name}"))
            if node.security < parent.security:
                report.violations.append(Violation(parent.name, name, "*", f"security falls from {parent.security} to {node.security}"))
    report.edges.sort()
    report.flows.sort(key=lambda f: (f.source, f.target, f.column))
    report.violations.sort(key=lambda v: (v.source, v.target, v.column))
    return report


def mermaid(report: Report) -> str:
    bad = {(v.source, v.target) for v in report.violations}
    lines = ["graph LR"]
    lines += [f'    {n["name"]}["{n["name"]} ({n["security_level"]})"]' + (":::critical" if n["critical"] else "") for n in report.nodes]
    lines += [f"    {a} {'-. leak .->' if (a, b) in bad else '-->'} {b}" for a, b in report.edges]
    return "\n".join([*lines, "    classDef critical stroke-width:3px"]) + "\n"


def json_ld(manifest: Manifest) -> str:
    """The models as DCAT datasets with PROV derivations; empty lists are left out."""
    graph = []
    for name in sorted(manifest.models):
        m = manifest.models[name]
        node: dict = {"@id": f"model:{name}", "@type": "dcat:Dataset", "dct:title": name, "securityLevel": str(m.security)}
        if m.description:
            node["dct:description"] = m.description
        if m.tech_owner:
            node["dct:publisher"] = m.tech_owner
        if m.refs:
            node["prov:wasDerivedFrom"] = [{"@id": f"model:{r}"} for r in sorted(m.refs)]
        if m.columns:
            node["columns"] = [{"name": c.name} | ({"policy": c.policy} if c.policy else {}) for c in m.columns]
        graph.append(node)
    context = {"dcat": "http://www.w3.org/ns/dcat#", "dct": "http://purl.org/dc/terms/", "prov": "http://www.w3.org/ns/prov#"}
    return json.dumps({"@context": context, "@graph": graph}, indent=2)


def frames(spark: SparkSession, manifest: Manifest) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Models, edges and columns as DataFrames."""
    models = spark.createDataFrame([(m.name, int(m.security)) for m in manifest.models.values()], "model string, level int")
    edges = spark.createDataFrame([(p, m.name) for m in manifest.models.values() for p in m.refs], "parent string, child string")
    columns = spark.createDataFrame([(m.name, c.name, c.policy) for m in manifest.models.values() for c in m.columns], "model string, column string, policy string")
    return models, edges, columns


def flow_frame(edges: DataFrame, columns: DataFrame) -> DataFrame:
    """The flows as a join of edges with the columns at both ends."""
    up = columns.where("policy IS NOT NULL").select(F.col("model").alias("parent"), "column", F.col("policy").alias("up"))
    down = columns.select(F.col("model").alias("child"), "column", F.col("policy").alias("down"))
    return edges.join(up, "parent").join(down, ["child", "column"]).select("parent", "child", "column", F.col("down").isNotNull().alias("secured"))


def level_frame(models: DataFrame, edges: DataFrame) -> DataFrame:
    """Edges with ``downgrade`` and ``critical``."""
    p, c = models.select(F.col("model").alias("parent"), F.col("level").alias("pl")), models.select(F.col("model").alias("child"), F.col("level").alias("cl"))
    return edges.join(p, "parent").join(c, "child").select("parent", "child", (F.col("cl") < F.col("pl")).alias("downgrade"), (F.col("cl") > F.col("pl")).alias("critical"))


def catalog(manifest: Manifest, state: dict, schemas: dict[str, list[tuple[str, str]]] | None = None) -> dict:
    """Assets with owners, levels, column types as the last run found them or ``schemas`` says, and the last run's row count."""
    assets = []
    for name in sorted(manifest.models):
        m = manifest.models[name]
        types = dict((schemas or {}).get(name) or state.get(name, {}).get("columns") or [])
        listed = [{"name": c.name, "type": types.get(c.name, "unknown"), "policy": c.policy, "description": c.description} for c in m.columns]
        listed += [{"name": c, "type": t, "policy": None, "description": ""} for c, t in types.items() if c not in {x.name for x in m.columns}]
        seen = state.get(name, {})
        assets.append({"name": name, "description": m.description, "owner": m.tech_owner, "security_level": str(m.security), "status": m.status, "materialized": m.materialized, "upstream": sorted(m.refs), "columns": listed, "row_count": seen.get("row_count"), "last_run_at": seen.get("last_run_at")})
    masked = sum(bool(c["policy"]) for a in assets for c in a["columns"])
    return {"project": manifest.project, "stats": {"models": len(assets), "sources": len(manifest.sources), "masked_columns": masked}, "assets": assets}


def catalog_html(data: dict) -> str:
    e = html.escape
    rows = []
    for a in data["assets"]:
        columns = "".join(f"<li>{e(c['name'])} <i>{e(c['type'])}</i>{' &#128274; ' + e(c['policy']) if c['policy'] else ''}</li>" for c in a["columns"])
        rows.append(f"<section><h2>{e(a['name'])}</h2><p>{e(a['security_level'])}, {e(a['materialized'])}, rows: {a['row_count'] if a['row_count'] is not None else '?'}</p><p>{e(a['description'])}</p><ul>{columns}</ul></section>")
    return f"<!DOCTYPE html><html><head><meta charset='utf-8'><title>{e(data['project'])}</title></head><body><h1>{e(data['project'])}</h1>{''.join(rows)}</body></html>"
