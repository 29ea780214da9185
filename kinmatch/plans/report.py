"""Evaluation and profile reports as Markdown or self-contained HTML, made of small collected tables."""

from __future__ import annotations

import html

from pyspark.sql import DataFrame

from kinmatch.operators import metrics


def _cell(x) -> str:
    return "" if x is None else f"{x:.4f}" if isinstance(x, float) else str(x)


def markdown(df: DataFrame, limit: int = 50) -> str:
    """The first rows of a table."""
    rows = df.limit(limit).collect()
    lines = ["| " + " | ".join(df.columns) + " |", "|" + "-|" * len(df.columns)]
    return "\n".join(lines + ["| " + " | ".join(_cell(v) for v in r) + " |" for r in rows])


def evaluation(scored: DataFrame, threshold: float) -> dict[str, DataFrame]:
    """Sections of an evaluation of (score, label): quality at a threshold, ranking, calibration, reliability."""
    return {
        "At the threshold": metrics.pr_curve(scored, [threshold]),
        "Best cut": metrics.best_f1(scored),
        "AUC": metrics.roc_auc(scored),
        "Average precision": metrics.average_precision(scored),
        "Brier": metrics.brier(scored),
        "Calibration error": metrics.calibration_error(scored),
        "Reliability": metrics.reliability(scored).orderBy("bin"),
        "Scores": metrics.score_stats(scored),
    }


def page(title: str, sections: dict[str, DataFrame], limit: int = 50) -> str:
    """One HTML page."""
    out = [f"<!doctype html><meta charset=utf-8><title>{html.escape(title)}</title><h1>{html.escape(title)}</h1>"]
    for name, df in sections.items():
        rows = df.limit(limit).collect()
        head = "".join(f"<th>{html.escape(c)}</th>" for c in df.columns)
        body = "".join("<tr>" + "".join(f"<td>{html.escape(_cell(v))}</td>" for v in r) + "</tr>" for r in rows)
        out.append(f"<h2>{html.escape(name)}</h2><table><tr>{head}</tr>{body}</table>")
    return "".join(out)
