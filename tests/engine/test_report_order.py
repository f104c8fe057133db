"""Categories of one size are listed as they first appear in the results file."""

from __future__ import annotations

import json

from corvane.plans import report
from corvane.sources import corpus as sources


def test_ties_by_first_appearance(spark, tmp_path):
    row = lambda i, kind: {"question_id": i, "question_type": kind, "answer_correct": True, "completeness_pct": 100.0}
    (tmp_path / "r.json").write_text(json.dumps({"questions": [row("q9", "late ids"), row("q1", "early ids"), row("q8", "late ids"), row("q2", "early ids"), row("q0", "single")]}))
    shown = lambda placed: [line.split("|")[1].strip() for line in report.markdown("t", sources.read_results(spark, str(tmp_path / "r.json"), placed)).splitlines() if line.startswith("|")][2:]
    assert shown(True) == ["all", "late ids", "early ids", "single"]
    assert shown(False) == ["all", "early ids", "late ids", "single"]  # by question where places are not known
