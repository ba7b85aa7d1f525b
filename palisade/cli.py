"""Command line: run, generate, docs, lineage, clean, query."""

from __future__ import annotations

import argparse
import json
import sys
import time
from pathlib import Path

from palisade.plans import lineage, pipeline, project


def _session():
    from pyspark.sql import SparkSession

    return SparkSession.builder.appName("palisade").config("spark.scheduler.mode", "FAIR").config("spark.sql.session.timeZone", "UTC").getOrCreate()


def query(spark, sql: str):
    """An ad-hoc query: its frame and how long the analysis took; an empty text is an error."""
    if not sql.strip():
        raise ValueError("the query is empty")
    began = time.time()
    return spark.sql(sql), time.time() - began


def parser() -> argparse.ArgumentParser:
    out = argparse.ArgumentParser(prog="palisade")
    out.add_argument("--project-dir", default=".")
    sub = out.add_subparsers(dest="command", required=True)
    sub.add_parser("run").add_argument("--select")
    g = sub.add_parser("generate")
    g.add_argument("--data-dir", default="data")
    g.add_argument("--owner")
    g.add_argument("--pii", action="store_true")
    g.add_argument("--security", default="internal")
    g.add_argument("--prune", action="store_true")
    sub.add_parser("docs")
    n = sub.add_parser("lineage")
    n.add_argument("--check", action="store_true")
    n.add_argument("--format", choices=("mermaid", "json", "json-ld"), default="mermaid")
    sub.add_parser("clean")
    sub.add_parser("query").add_argument("sql")
    return out


def main(argv: list[str] | None = None) -> int:
    args = parser().parse_args(argv)
    root = Path(args.project_dir)
    if args.command == "query":
        query(_session(), args.sql)[0].show()
        return 0
    config = project.ProjectConfig.load(root)
    target = root / config.target_path
    if args.command == "run":
        result = pipeline.run(_session(), root, args.select)
        print(f"{len(result.models_executed)} models in {result.seconds:.2f} s", *result.warnings, *result.errors, sep="\n")
        return int(not result.success)
    if args.command == "generate":
        sources, warnings = project.generate_sources(root, root / args.data_dir, args.owner, args.pii, args.security, args.prune)
        print(f"{len(sources)} sources", *warnings, sep="\n")
        return 0
    if args.command == "clean":
        print(*project.clean(root, config.clean_targets), sep="\n")
        return 0
    manifest = project.discover(root, config)
    if args.command == "docs":
        data = lineage.catalog(manifest, pipeline.load_state(target / "state.json"))
        project.write_atomic(target / "catalog.json", json.dumps(data, indent=2))
        project.write_atomic(target / "index.html", lineage.catalog_html(data))
        return 0
    report = lineage.analyze(manifest)
    project.write_atomic(target / "lineage.json", report.to_json())
    project.write_atomic(target / "metadata_context.jsonld", lineage.json_ld(manifest))
    print({"mermaid": lineage.mermaid(report), "json": report.to_json(), "json-ld": lineage.json_ld(manifest)}[args.format])
    return int(args.check and bool(report.violations))


if __name__ == "__main__":
    sys.exit(main())
