"""python -m tracequarry.cli VERB DATA [--format json|csv|markdown] [--limit N] [--out FOLDER]: a query over a folder of tables, all its rows as text or written to a folder. Verbs: --list."""

from __future__ import annotations

import argparse

from tracequarry.plans import dialogue, problems, reference
from tracequarry.session import get_spark
from tracequarry.sources import sinks

# The verbs, and the query that answers each.
VERBS = {
    "stats": "span_totals", "list-sessions": "session_listing", "session-metrics": "session_metrics", "tools": "tool_statistics", "failures": "failure_summary", "churn": "file_churn", "analyze-tokens": "session_tokens",
    "coverage": "session_coverage", "chain-list": "conversation_chains", "reconstruct": "thread_summary", "status": "span_statistics", "session-context": "session_context", "suggest": "suggestions", "export-events": "transcript_events",
    "claude-session-logs-to-markdown": "transcript_markdown", "cluster": "embedding_clusters", "query-spans": "filter_errors_in_time", "query-events": "filter_events", "chain-export": "chain_markdown", "reconstruct-session": "chain_markdown", "reconstruct-live": "live_events", "ticket-sessions": "sessions_by_ticket", "analyze-duplicates": "deletable_sessions", "summarize": "session_batches", "working-sessions": "p4_found",
}


def main(argv: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(description=__doc__)
    p.add_argument("verb", nargs="?")
    p.add_argument("data", nargs="?")
    p.add_argument("--list", action="store_true")
    p.add_argument("--format", default="markdown", choices=sorted(sinks.FORMATS))
    p.add_argument("--limit", type=int, default=None, help="so many rows; what is cut off is said")
    p.add_argument("--out", help="folder to write all rows to, through Spark")
    a = p.parse_args(argv)
    every = problems.QUERIES | reference.QUERIES | dialogue.QUERIES
    if a.list or not a.verb or not a.data:
        print("\n".join(sorted([*VERBS, *every])))
        return 0
    name = VERBS.get(a.verb, a.verb)
    if name not in every:
        p.error(f"no such verb: {a.verb}")
    df = every[name](get_spark(), a.data)
    if a.out:
        sinks.write(df if a.limit is None else df.limit(a.limit), a.format, a.out)
    else:
        print(sinks.export(df, a.format, a.limit))
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
