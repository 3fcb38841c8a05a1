"""Result tables as CSV and Markdown, from few rows."""

from __future__ import annotations

import csv
import subprocess
from datetime import datetime, timezone
from pathlib import Path

from pyspark.sql import DataFrame

from corvane.config import RetrievalConfig
from corvane.experiment import BASELINE, DEPTH, Evaluation

MISSING = "—"
MOST_ROWS = 100_000
# The columns of the arm table: their heads, where they come from, and their decimals.
COLUMNS = [
    ("arm", "arm", 0), ("recall@1", "recall_1", 3), ("recall@3", "recall_3", 3), ("recall@5", "recall_5", 3), ("recall@10", "recall_10", 3), ("mrr", "mrr", 3), ("ndcg@10", "ndcg", 3),
    ("refusal_acc", "refusal_accuracy", 3), ("false_refusal", "false_refusal", 3), ("latency_ms", "mean_ms", 0), ("p95_ms", "p95_ms", 0), ("ce_calls/q", "calls_per_question", 2), ("faithfulness", "faithfulness", 3), ("answer_relevancy", "answer_relevancy", 3),
]


def cell(value: object, digits: int) -> str:
    return MISSING if value is None else f"{value:.{digits}f}" if isinstance(value, float) else str(value)


def small_rows(table: DataFrame) -> list[dict]:
    """The rows of a result table; more than MOST_ROWS are refused."""
    rows = table.limit(MOST_ROWS + 1).collect()
    if len(rows) > MOST_ROWS:
        raise ValueError(f"more than {MOST_ROWS} rows are no report")
    return [r.asDict() for r in rows]


def markdown(rows: list[dict], columns: list[str], digits: int = 3) -> str:
    head = ["| " + " | ".join(columns) + " |", "|" + " --- |" * len(columns)]
    return "\n".join(head + ["| " + " | ".join(cell(r.get(c), digits) for c in columns) + " |" for r in rows]) + "\n"


def metadata() -> dict[str, str]:
    """When and from which commit a result was made."""
    done = subprocess.run(["git", "-C", str(Path(__file__).parent), "rev-parse", "--short", "HEAD"], capture_output=True, text=True, check=False)
    return {"made_at": datetime.now(timezone.utc).strftime("%Y-%m-%dT%H:%M:%SZ"), "commit": done.stdout.strip() or "unknown"}


def in_order(rows: list[dict], arms: list[str]) -> list[dict]:
    return sorted(rows, key=lambda r: arms.index(r["arm"]))


def arm_rows(evaluation: Evaluation, latencies: DataFrame | None = None, generation: DataFrame | None = None) -> list[dict]:
    """The arm table's rows under its heads, numbers as text; what wasn't measured is missing."""
    arms = list(evaluation.chosen)
    merged: dict[str, dict] = {a: {} for a in arms}
    for table in (evaluation.table(), latencies, generation):
        for r in small_rows(table) if table is not None else []:
            merged[r["arm"]] |= r
    return [{head: cell(r.get(column), digits) for head, column, digits in COLUMNS} for r in in_order(list(merged.values()), arms)]


def significance_lines(evaluation: Evaluation, *, exact: bool = True) -> str:
    found = evaluation.significance(exact=exact)
    if found is None:
        return f"(no {BASELINE} arm, so nothing to compare with)\n"
    rows = [
        {
            "arm": r["arm"],
            "recall@5 won/lost": f"+{r['won']}/−{r['lost']}",
            "McNemar p": f"{r['p_value']:.3f}",
            "MRR gain [95 %]": f"{r['delta_mrr']:+.3f} [{r['low']:+.3f}, {r['high']:+.3f}]",
            "significant": "yes" if r["significant"] else "no",
        }
        for r in in_order(small_rows(found), list(evaluation.chosen))
    ]
    return markdown(rows, ["arm", "recall@5 won/lost", "McNemar p", "MRR gain [95 %]", "significant"])


def type_lines(evaluation: Evaluation) -> str:
    rows = small_rows(evaluation.by_type())
    kinds = sorted({r["type"] or "" for r in rows})
    heads = {k: f"{k} recall@5 / MRR (n)" for k in kinds}
    told = {(r["arm"], r["type"] or ""): f"{r['recall_5']:.2f} / {r['mrr']:.2f} ({r['n']})" for r in rows}
    return markdown([{"arm": a, **{heads[k]: told.get((a, k)) for k in kinds}} for a in evaluation.chosen], ["arm", *heads.values()])


def risk_lines(evaluation: Evaluation) -> str:
    rows = sorted(small_rows(evaluation.risk_coverage()), key=lambda r: r["threshold"])
    return markdown([{"threshold": f"{r['threshold']:.2f}", "refusal_acc": r["refusal_accuracy"], "false_refusal": r["false_refusal"]} for r in rows], ["threshold", "refusal_acc", "false_refusal"])


def whole(evaluation: Evaluation, rows: list[dict], *, judged: bool) -> str:
    """The report: arms, significance, kinds of item, and what other bars would refuse."""
    about, config = metadata(), RetrievalConfig()
    kinds = small_rows(evaluation.refusals())
    answerable = evaluation.answerable.count()
    head = f"{about['made_at']}, commit {about['commit']}, {answerable} answerable and {kinds[0]['n_refuse'] if kinds else 0} others, depth {DEPTH}, embedder {evaluation.engine.config.embedder}, chunks {evaluation.engine.config.chunk_size}/{evaluation.engine.config.chunk_overlap}"
    parts = [
        "### Arms\n", head + "\n", markdown(rows, [c[0] for c in COLUMNS]),
        f"refusal_acc: right refusals of items that have no answer here; false_refusal: refusals of others. All arms but the corrective one refuse where the best cosine is under {config.refusal_cosine}.\n",
        "#### Against the baseline, paired\n", significance_lines(evaluation),
        "#### By kind of item\n", type_lines(evaluation),
        "#### Other bars for refusing\n", risk_lines(evaluation),
        "Answers judged." if judged else "Answers not judged (--generate).",
    ]
    return "\n".join(parts) + "\n"


def write(folder: str, rows: list[dict], text: str) -> None:
    """results.csv and results.md in a local folder."""
    out = Path(folder)
    out.mkdir(parents=True, exist_ok=True)
    with (out / "results.csv").open("w", newline="", encoding="utf-8") as f:
        writer = csv.DictWriter(f, [c[0] for c in COLUMNS])
        writer.writeheader()
        writer.writerows(rows)
    (out / "results.md").write_text(text, encoding="utf-8")


def trace_lines(rounds: list[dict]) -> str:
    """A question's rounds for the console, ids and query cut short."""
    return "\n".join(f"round {r['round_idx']}: {r['n_candidates']} candidates for {r['query'][:200]!r}{', scored again' if r['reranked'] else ''}, {r['action']}, kept {len(r['kept_chunk_ids'])}, {r['correction'] or 'end'}" for r in sorted(rounds, key=lambda r: r["round_idx"]))


def chunk_lines(chunks: list[dict]) -> str:
    return "\n".join(f"{r['rank'] + 1}. [{r['chunk_id']}] {r['score']:.3f} {r['text'][:200]}" for r in sorted(chunks, key=lambda r: r["rank"]))
