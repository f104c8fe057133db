"""Reports from small collected frames; the only place that rounds to two places."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.judging import correction_counts
from ..operators.metrics import full_coverage, group_stats, recall_at

DEPTHS = (1, 3, 5, 10, 20, 50)


def markdown(title: str, results: DataFrame, ranked: DataFrame | None = None, questions: DataFrame | None = None, leaderboard: list[dict] | None = None, corrections: DataFrame | None = None) -> str:
    """Overall and per-category scores, corrections, recall by depth with full coverage, and where the result would stand.

    Categories are listed by their number of questions, equal ones in the order they first appear in: by ordinal, the place of
    a row in its file, where results have it, else by question.
    """
    place = "ordinal" if "ordinal" in results.columns else "question_id"
    first = {r[0]: (r[1] is None, r[1]) for r in results.groupBy("question_type").agg(F.min(place)).collect()}
    stats = sorted(group_stats(results).collect(), key=lambda r: (not r["is_total"], -r["n"], first.get(r["grp"], (False, 0)) if not r["is_total"] else 0))
    lines = [f"# {title}", "", "| category | n | combined | correctness | completeness | recall | invalid extra |", "|---|---|---|---|---|---|---|"]
    for r in stats:
        values = " | ".join(str(round(r[c], 2)) for c in ("combined", "correctness", "completeness", "recall", "invalid_extra"))
        lines.append(f"| {'all' if r['is_total'] else r['grp']} | {r['n']} | {values} |")
    if corrections is not None:
        n = correction_counts(results, corrections).first()
        lines += ["", f"Corrections: {n['records']} records, {n['doc_set_changed']} change the gold set, {n['gold_answer_changed']} the gold answer; {n['uncorrected']} questions are uncorrected."]
    if ranked is not None and questions is not None:
        lines += ["", "| k | recall | invalid extra | n |", "|---|---|---|---|"]
        lines += [f"| {r['k']} | {round(r['recall_pct'], 2)} | {round(r['invalid_extra'], 2)} | {r['n']} |" for r in recall_at(ranked, questions, DEPTHS).orderBy("k").collect()]
        covered, n = full_coverage(ranked, questions).first()
        lines += ["", f"All gold documents are among the first 10 in {covered} of {n} questions."]
    if leaderboard and stats:
        own = round(stats[0]["combined"], 2)
        rows = sorted([*leaderboard, {"system": title, "overall": own}], key=lambda x: -x["overall"])
        lines += ["", "| rank | system | overall |", "|---|---|---|"] + [f"| {i} | {x['system']} | {x['overall']} |" for i, x in enumerate(rows, 1)]
    return "\n".join(lines) + "\n"
