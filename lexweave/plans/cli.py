"""Command line: verify, extract, glossary from-report, glossary merge, config, validate. Exit codes: 0 done, 1 the gate
failed, 2 wrong use or configuration, 3 internal error."""

from __future__ import annotations

import argparse
import dataclasses
import json
import logging
import sys

from lexweave.common import scope
from lexweave.operators.glossary import from_candidates
from lexweave.operators.merge import ON_CONFLICT, ON_MATCH, MergePolicy, merge_glossaries
from lexweave.operators.tokens import MissingModel
from lexweave.plans.config import ConfigError, discover
from lexweave.plans.pipeline import from_config
from lexweave.plans.timing import timed
from lexweave.sources.files import open_source, read_suggestions, read_texts
from lexweave.sources.sinks import write_glossary, write_glossary_rows, write_json

OK, GATE, USAGE, INTERNAL = range(4)


def _parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="lexweave")
    p.add_argument("-v", "--verbose", action="store_true")
    p.add_argument("-q", "--quiet", action="store_true")
    p.add_argument("--config")
    p.add_argument("--log-level")
    p.add_argument("--log-file")
    sub = p.add_subparsers(dest="command", required=True)
    v = sub.add_parser("verify")
    v.add_argument("files", nargs="+")
    v.add_argument("--source")
    v.add_argument("--verifier", choices=("exact", "fuzzy"))
    v.add_argument("--threshold", type=float)
    v.add_argument("--output-dir")
    v.add_argument("--fail-on-quality-gate", action="store_true")
    v.add_argument("--first-file", action="store_true", help="print and gate on the first file's figures only")
    v.add_argument("--min-coverage", type=float)
    v.add_argument("--max-unknown", type=int)
    v.add_argument("--min-quality-score", type=float)
    e = sub.add_parser("extract")
    e.add_argument("files", nargs="+")
    e.add_argument("--output-dir")
    g = sub.add_parser("glossary").add_subparsers(dest="action", required=True)
    f = g.add_parser("from-report")
    f.add_argument("--report", required=True)
    f.add_argument("--out", required=True)
    f.add_argument("--min-score", type=float, default=0.0)
    f.add_argument("--min-frequency", type=int, default=1)
    f.add_argument("--namespace", default="term")
    m = g.add_parser("merge")
    for name in ("base", "updates", "out"):
        m.add_argument(f"--{name}", required=True)
    m.add_argument("--on-match", choices=ON_MATCH, default="merge-synonyms")
    m.add_argument("--on-conflict", choices=ON_CONFLICT, default="report")
    m.add_argument("--conflicts-out")
    m.add_argument("--summary-out")
    sub.add_parser("config")
    sub.add_parser("validate")
    return p


def _configured(args):
    c = discover(args.config)
    if args.command in ("verify", "extract"):
        c.output_dir = args.output_dir or c.output_dir
    if args.command == "verify":
        c.source, c.verifier = args.source or c.source, args.verifier or c.verifier
        if args.threshold is not None:
            c.fuzzy = c.fuzzy | {"threshold": args.threshold}
        given = {k: getattr(args, k) for k in ("min_coverage", "max_unknown", "min_quality_score") if getattr(args, k) is not None}
        c.quality_gates = dataclasses.replace(c.quality_gates, **given)
    if args.command == "extract":
        c.stages, c.include = ["extract", "report"], ["extraction"]
    level = args.log_level or ("ERROR" if args.quiet else "DEBUG" if args.verbose else c.log_level)
    logging.basicConfig(level=level.upper(), filename=args.log_file or c.log_file)
    return c


def _merge(spark, args) -> None:
    merged, conflicts, summary = merge_glossaries(open_source(spark, args.base), open_source(spark, args.updates), MergePolicy(args.on_match, args.on_conflict))
    if args.out.rstrip("/").endswith((".parquet", ".jsonl")):
        write_glossary_rows(merged, args.out)
    else:
        write_glossary(merged, args.out, ("side", "pos", "part"))
    if args.conflicts_out:
        write_json(args.conflicts_out, [{k: v for k, v in r.asDict().items() if k != "pos"} | {"raw_data": json.loads(r.raw_data)} for r in conflicts.orderBy("pos").collect()])
    if args.summary_out:
        write_json(args.summary_out, summary.first().asDict())


def main(argv: list[str] | None = None, spark=None, tagger=None) -> int:
    try:
        args = _parser().parse_args(argv)
    except SystemExit as e:
        return USAGE if e.code else OK
    try:
        c = _configured(args)
        if args.command == "config":
            print(json.dumps(dataclasses.asdict(c), indent=2, ensure_ascii=False))
            return OK
        if args.command == "validate":
            c.check()
            return OK
        if spark is None:
            from pyspark.sql import SparkSession

            spark = SparkSession.builder.appName("lexweave").getOrCreate()
        if args.command == "glossary" and args.action == "from-report":
            terms = read_suggestions(spark, args.report).withColumnRenamed("seq", "ord")
            write_glossary(from_candidates(terms, args.namespace, args.min_score, args.min_frequency), args.out, ("label",))
            return OK
        if args.command == "glossary":
            with scope():
                _merge(spark, args)
            return OK
        if tagger is None and "rule" in c.extractors and not c.rules.get("model"):
            logging.warning("no tagger or model given: the rule extractor is left out")
            c.extractors = [x for x in c.extractors if x != "rule"]
        with scope(), timed("run"):
            pipe, files = from_config(spark, c, tagger), args.files
            reports = pipe.run_and_collect(read_texts(spark, files))
            if args.command == "verify" and args.first_file and len(files) > 1:
                reports = pipe.run_and_collect(read_texts(spark, files[:1]), export=False)
        verification = next((r for r in reports if r["report_type"] == "verification"), None)
        if verification:
            print(f"coverage {verification['coverage_pct']:.1f} % ({verification['processed_items']} of {verification['total_items']} terms)")
        gate = next((r for r in reports if r["report_type"] == "quality_gate"), None)
        return GATE if args.command == "verify" and args.fail_on_quality_gate and not (gate and gate["quality_pass"]) else OK
    except (ConfigError, ValueError, FileNotFoundError, MissingModel) as e:
        print(f"error: {e}", file=sys.stderr)
        return USAGE
    except Exception as e:  # noqa: BLE001
        print(f"internal error: {e}", file=sys.stderr)
        return INTERNAL


if __name__ == "__main__":
    sys.exit(main())
