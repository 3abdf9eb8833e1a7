"""auditloom: a PySpark-native engine for auditing text and source corpora.

The public names are loaded when they are first asked for.
"""

from __future__ import annotations

import importlib
from typing import Any

__version__ = "0.1.0"

_NAMES = {
    "config": ("Ai", "Config", "ConfigError", "LocalReview", "commit_prompt", "flag", "from_dict", "load", "system_prompt"),
    "functions.format": ("format_bytes", "format_duration"),
    "operators.cache": ("cache_key", "look_up", "new_entries"),
    "operators.classify": ("classify", "code_file", "git_source", "ignore_rules", "path_reason", "relative"),
    "operators.commits": ("changed_paths", "distinct_files", "filter_commits", "match_patterns", "parse_log", "review_commits"),
    "operators.diff": ("budget", "cap_files", "line_counts", "patch_or_synthetic", "skip_reason", "synthetic_diff", "truncate"),
    "operators.graph": ("ancestors", "branch_commits", "commit_graph", "merge_bases", "reaches"),
    "operators.patch": ("apply", "patch_column", "patched_column", "unified"),
    "operators.progress": ("Progress",),
    "operators.provider": ("Provider", "ProviderError", "Settings", "audit", "audit_commits", "make"),
    "operators.rank": ("ranked",),
    "operators.redact": ("redact", "redaction_totals", "security_results"),
    "operators.report": ("commentable", "console_lines", "exit_code", "failed", "issue_rows", "json_report", "markdown_lines", "run_code", "summary"),
    "operators.scan": ("payload_summary", "suspicious_lines"),
    "operators.tokens": ("RankCounter", "chunk_lines", "estimate", "gate", "limit"),
    "operators.verdict": ("parse_verdicts", "strip_fences"),
    "plans.review": ("Review", "review", "token_gate"),
    "sources.posting": ("comments", "post"),
    "sources.tables": ("discover", "filter_paths", "load_rules", "read_files", "read_listed", "size_capped", "walk"),
    "sources.versioned": ("compact", "current", "upsert", "vacuum"),
}
_WHERE = {name: module for module, names in _NAMES.items() for name in names}
__all__ = sorted(_WHERE)


def __getattr__(name: str) -> Any:
    if name not in _WHERE:
        raise AttributeError(f"module {__name__!r} has no attribute {name!r}")
    return getattr(importlib.import_module(f"{__name__}.{_WHERE[name]}"), name)


def __dir__() -> list[str]:
    return sorted({*globals(), *__all__})
