"""Fluent builder: documents to terms, matches and reports, as lazy DataFrames over all documents at once."""

from __future__ import annotations

import logging
from collections.abc import Callable
from dataclasses import dataclass, replace
from functools import partial
from pathlib import Path

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexweave.common import durable
from lexweave.operators import reports as R
from lexweave.operators.cvalue import extract_cvalue
from lexweave.operators.extract import extract_all, normalize
from lexweave.operators.rules import DEFAULT_PATTERNS, rule_matches
from lexweave.operators.tokens import MissingModel, model_tagger
from lexweave.operators.verify import verify_exact, verify_fuzzy
from lexweave.plans.config import Config, ConfigError
from lexweave.sources.files import open_source
from lexweave.sources.sinks import export_reports, write_rows

Stage = Callable[[DataFrame], DataFrame]


@dataclass(frozen=True)
class ReportConfig:
    include: tuple[str, ...] = ("verification", "quality_gate", "ontology_update")
    exporters: tuple[str, ...] = ("json",)
    output_dir: str | None = None
    gates: R.QualityGates = R.QualityGates()
    listed: int = 10_000  # terms that a report holds itself; longer lists go whole through write_rows into output_dir


class Pipeline:
    """``pipeline().with_cvalue().normalize().verify(glossary).report().run(documents)``."""

    def __init__(self, tagger: Stage | None = None) -> None:
        self.tagger, self._extractors, self._stages, self._report, self._glossary = tagger, [], [], None, None

    def extractors(self, *fns: Stage) -> Pipeline:
        self._extractors += fns
        return self

    def _tagger(self, model: str | None) -> Stage | None:
        """The pipeline's tagger, else that of ``model`` if it is installed."""
        return self.tagger or (model_tagger(model) if model else None)

    def with_cvalue(self, model: str | None = None, **params) -> Pipeline:
        """Without a tagger or a model the extractor falls back to its heuristic mode; a model that is missing is reported."""
        try:
            tagger = self._tagger(model) if params.get("use_ling_filter", True) else None
        except MissingModel as e:
            logging.warning("%s: the C-value extractor falls back to its heuristic mode", e)
            tagger = None
        return self.extractors(partial(extract_cvalue, tagger=tagger, **params))

    def with_rules(self, patterns=DEFAULT_PATTERNS, min_score: float = 0.5, model: str | None = None) -> Pipeline:
        """A model that is missing raises; it is never downloaded."""
        tagger = self._tagger(model)
        if tagger is None:
            raise ValueError("the rule extractor needs parts of speech: give a tagger or a model")
        return self.extractors(lambda docs: rule_matches(tagger(docs), docs, patterns, min_score))

    def normalize(self) -> Pipeline:
        return self.stage(normalize)

    def verify(self, glossary: DataFrame, kind: str = "exact", **params) -> Pipeline:
        fn = {"exact": lambda t: verify_exact(t, glossary), "fuzzy": lambda t: verify_fuzzy(t, glossary, **params)}
        if kind not in fn:
            raise ValueError(f"unknown verifier {kind!r}")
        self._glossary = glossary
        return self.stage(fn[kind])

    def stage(self, fn: Stage) -> Pipeline:
        self._stages.append(fn)
        return self

    def report(self, config: ReportConfig = ReportConfig()) -> Pipeline:
        self._report = config
        return self

    def run(self, documents: DataFrame) -> DataFrame:
        """The lazy result of extraction and all stages."""
        out = extract_all(documents, self._extractors)
        for fn in self._stages:
            out = fn(out)
        return out

    def run_and_collect(self, documents: DataFrame, export: bool = True) -> list:
        """Rows of the last stage, or the reports over all documents if a report was asked for."""
        out = self.run(documents)
        if self._report is None:
            return out.collect()
        return make_reports(out, self._report if export else replace(self._report, output_dir=None), self._glossary)


def pipeline(tagger: Stage | None = None) -> Pipeline:
    return Pipeline(tagger)


def _term_columns(df: DataFrame) -> list[Column]:
    """A term in the form of a report; what its extractor knows besides stands under ``properties``."""
    keep = [c for c in ("text", "original_text", "lemma", "score", "pos_tags", "sentence", "frequency", "extractor_type") if c in df.columns]
    more = [F.struct(F.lit(c).alias("key"), F.col(c).cast("string").alias("value")) for c in ("length", "token_count", "pattern_id") if c in df.columns]
    properties = F.map_from_entries(F.filter(F.array(*more), lambda x: x["value"].isNotNull())) if more else F.create_map().cast("map<string,string>")
    return [*keep, F.array("span_start", "span_end").alias("span"), properties.alias("properties")]


def _without_empty(row: dict) -> dict:
    """A row whose entity leaves out a null definition and source; other nulls stay."""
    if isinstance(row.get("entity"), dict):
        row["entity"] = {k: v for k, v in row["entity"].items() if v is not None or k not in ("definition", "source")}
    return row


def _put_rows(report: dict, name: str, rows: DataFrame, n: int, config: ReportConfig, order: tuple[str, ...]) -> None:
    """Adds all ``n`` rows to the report: as the list ``name``, or beyond ``listed`` as JSON lines in output_dir, written by
    the executors, whose path and count stand under ``<name>_rows``. Without an output_dir the list is always whole."""
    rows = rows.orderBy(*order)
    if n <= config.listed or not config.output_dir:
        report[name] = [_without_empty(r.asDict(recursive=True)) for r in rows.collect()]
        return
    folder = f"file://{Path(config.output_dir).resolve()}"
    write_rows(rows.withColumn("seq", F.monotonically_increasing_id()), folder, name)
    if (written := rows.sparkSession.read.text(f"{folder}/{name}").count()) != n:
        raise OSError(f"{written} of {n} rows are in {folder}/{name}: all executors have to share output_dir")
    report[f"{name}_rows"] = {"path": f"{folder}/{name}", "count": n}


def _match_rows(rows: DataFrame, entities: DataFrame | None) -> DataFrame:
    """Each term with the entity it met, whole if ``entities`` are given; what is unknown is null."""
    entity = F.struct(F.col("entity_id").alias("id"), F.col("entity_label").alias("label"))
    if entities is not None:
        fields = [c for c in ("id", "label", "synonyms", "relations", "definition", "source") if c in entities.columns]
        rows = rows.join(entities.select("entity_pos", F.struct(*fields).alias("_entity")), "entity_pos", "left")
        entity = F.col("_entity")
    met = F.when(F.col("entity_pos").isNotNull(), entity)
    return rows.select("doc_id", F.struct(*_term_columns(rows)).alias("text_entity"), met.alias("entity"), "confidence", "status", "matched_synonym")


def make_reports(rows: DataFrame, config: ReportConfig, entities: DataFrame | None = None) -> list[dict]:
    """Reports over all documents, filtered by ``include`` (empty: all), gated and exported. Verification also lists its
    matches and the same figures by document. The gate sees only included reports, so it fails where verification isn't
    among them. All are made from one durable table of the rows, so nothing is extracted or verified twice."""
    wanted = lambda k: not config.include or k in config.include
    rows, out = durable(rows), []
    if "status" not in rows.columns:
        if wanted("extraction"):
            r = R.extraction_report(rows, ()).first()
            stats = {x.extractor_type: x.n_terms for x in R.extractor_stats(rows, ()).collect()}
            scores = {k: r[f"score_{k}"] for k in ("min", "avg", "max")} if r.total_items else {}
            out.append({"report_type": "extraction", "total_items": r.total_items, "processed_items": r.processed_items, "raw_data": {"extractor_stats": stats, "score_distribution": scores}})
    else:
        by_document = R.quality_gate(R.verification_report(rows), config.gates)
        r = R.quality_gate(R.verification_report(rows, ()), config.gates).first()
        terms = lambda df: df.select("doc_id", *_term_columns(df))
        if wanted("verification"):
            report = {"report_type": "verification", "total_items": r.total_items, "processed_items": r.processed_items, "coverage_pct": r.coverage_pct, "quality_score": r.quality_score, "n_unknown": r.n_unknown}
            out.append(report)
            _put_rows(report, "unknown_terms", terms(R.unknown_terms(rows)), r.n_unknown, config, ("doc_id", "text"))
            _put_rows(report, "matches", _match_rows(rows, entities), r.total_items, config, ("doc_id", "text_entity.text"))
            _put_rows(report, "documents", by_document, by_document.count(), config, ("doc_id",))
        unknown = R.ontology_update_report(rows, ()).first()
        if unknown and wanted("ontology_update"):
            report = {"report_type": "ontology_update", "total_items": unknown.total_items, "processed_items": unknown.processed_items}
            out.append(report)
            _put_rows(report, "suggested_entities", terms(R.suggested_terms(rows)), unknown.processed_items, config, ("doc_id", "text"))
        if wanted("quality_gate"):
            seen = R.quality_gate(None, spark=rows.sparkSession).first() if not wanted("verification") else r
            out.append({"report_type": "quality_gate", "total_items": r.total_items, "processed_items": r.processed_items, "quality_pass": seen.quality_pass, "exit_code": seen.exit_code, "raw_data": {"source_reports": [x["report_type"] for x in out]}})
    if config.output_dir:
        export_reports(out, config.output_dir, config.exporters)
    return out


def from_config(spark, config: Config, tagger: Stage | None = None) -> Pipeline:
    """A pipeline as configured; unknown names raise."""
    config.check()
    p = Pipeline(tagger)
    for name in config.extractors:
        if name == "rule":
            p.with_rules(**config.rules)
        else:
            p.with_cvalue(**config.cvalue)
    for stage in config.stages:
        if stage == "normalize":
            p.normalize()
        elif stage == "verify":
            if not config.source:
                raise ConfigError("verification needs a source")
            p.verify(open_source(spark, config.source), config.verifier, **(config.fuzzy_params() if config.verifier == "fuzzy" else {}))
        elif stage == "report":
            p.report(ReportConfig(tuple(config.include), tuple(config.exporters), config.output_dir, config.quality_gates))
    return p
