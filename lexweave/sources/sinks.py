"""Reports and glossaries to JSON: small ones as one file by the driver, large ones as a distributed write."""

from __future__ import annotations

import datetime
import json
from pathlib import Path

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexweave import __version__

EXPORTERS = ("json",)


def entity_dict(row) -> dict:
    """An entity without the fields that are empty of meaning: definition and source where null."""
    out = {"id": row["id"], "label": row["label"], "synonyms": list(row["synonyms"] or []), "relations": {k: list(v) for k, v in (row["relations"] or {}).items()}}
    return out | {k: row[k] for k in ("definition", "source") if row[k] is not None}


def write_json(path: str | Path, data) -> Path:
    target = Path(path).resolve()
    target.parent.mkdir(parents=True, exist_ok=True)
    target.write_text(json.dumps(data, ensure_ascii=False, indent=2), encoding="utf-8")
    return target


def write_glossary(entities: DataFrame, path: str, order: tuple[str, ...] = ("entity_pos",)) -> Path:
    """One JSON array in order: the format is one file, so it is written by the driver, row by row."""
    rows = entities.orderBy(*[c for c in order if c in entities.columns])
    return write_json(path, [entity_dict(r) for r in rows.toLocalIterator()])


def write_glossary_rows(entities: DataFrame, path: str) -> None:
    """A large merged glossary as Parquet or JSON lines, by the executors, with ``entity_pos`` in the order of the merge."""
    names = ("id", "label", "synonyms", "relations", "definition", "source")
    rows = entities.orderBy("side", "pos", "part").select(F.monotonically_increasing_id().alias("entity_pos"), *names)
    getattr(rows.write.mode("overwrite"), "parquet" if path.rstrip("/").endswith(".parquet") else "json")(path)


def write_report(report: dict, path: str | Path) -> Path:
    meta = {"report_type": report["report_type"], "timestamp": datetime.datetime.now().isoformat(), "lexweave_version": __version__}
    return write_json(path, {"metadata": meta, "data": {k: v for k, v in report.items() if v is not None and v != {}}})


def export_reports(reports: list[dict], output_dir: str | Path, exporters: tuple[str, ...] = EXPORTERS) -> list[Path]:
    """<output_dir>/<report_type>.<exporter> for each report. An unknown exporter and a failed write raise."""
    if unknown := set(exporters) - set(EXPORTERS):
        raise ValueError(f"unknown exporters: {', '.join(sorted(unknown))}")
    return [write_report(r, Path(output_dir) / f"{r['report_type']}.{e}") for r in reports for e in exporters]


def write_rows(df: DataFrame, path: str, report_type: str) -> None:
    """Bulk export: JSON lines under <path>/<report_type>, written by the executors; nulls stay."""
    df.write.mode("overwrite").option("ignoreNullFields", "false").json(f"{path.rstrip('/')}/{report_type}")
