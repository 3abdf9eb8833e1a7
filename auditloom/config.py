"""Settings of an audit, checked when made."""

from __future__ import annotations

import json
import os
from dataclasses import dataclass, field, fields, replace
from typing import Any

from auditloom import constants as K
from auditloom.operators.commits import valid

FILES = (".auditloomrc.json", ".auditrc.json")
FORMATS = ("console", "json", "markdown")


class ConfigError(ValueError):
    """One line for each field that is wrong."""


@dataclass(frozen=True)
class Ai:
    enabled: bool | None = None
    max_files: int = K.MAX_FILES
    max_diff_lines: int = K.MAX_DIFF_LINES
    max_chars_per_file: int = K.MAX_CHARS_PER_FILE
    prompt_version: str = "1"


@dataclass(frozen=True)
class LocalReview:
    commit_count: int = 1
    include_merge_commits: bool = False
    filter_by_pattern: bool = False
    pattern_match_mode: str = "any"
    commit_patterns: tuple[tuple[str, str, bool], ...] = ()
    skip_patterns: tuple[str, ...] = ()
    exclude_patterns: tuple[str, ...] = ()


@dataclass(frozen=True)
class Config:
    tech_stack: str = ""
    rules: tuple[str, ...] = ()
    max_concurrency: int = 5
    cache_enabled: bool = True
    ai: Ai = field(default_factory=Ai)
    local_review: LocalReview = field(default_factory=LocalReview)

    def __post_init__(self) -> None:
        wrong = []
        for name, value in (("max_concurrency", self.max_concurrency), ("ai.max_files", self.ai.max_files), ("ai.max_diff_lines", self.ai.max_diff_lines), ("ai.max_chars_per_file", self.ai.max_chars_per_file), ("local_review.commit_count", self.local_review.commit_count)):
            if isinstance(value, bool) or not isinstance(value, int) or value < 1:
                wrong.append(f"{name}: must be a positive whole number")
        if self.local_review.pattern_match_mode not in ("any", "all"):
            wrong.append("local_review.pattern_match_mode: must be any or all")
        for name in ("skip_patterns", "exclude_patterns"):
            if not all(isinstance(x, str) for x in getattr(self.local_review, name)):
                wrong.append(f"local_review.{name}: must be strings")
        for p in [*self.local_review.exclude_patterns, *(p for _, p, _ in self.local_review.commit_patterns)]:
            if not isinstance(p, str) or not valid(p):
                wrong.append(f"local_review: {p!r} is no valid pattern")
        if not isinstance(self.tech_stack, str):
            wrong.append("tech_stack: must be a string")
        if wrong:
            raise ConfigError("\n".join(wrong))

    def floors(self) -> Config:
        """With guardrails raised to their least values."""
        a = self.ai
        return replace(self, ai=replace(a, max_files=max(K.FLOOR_FILES, a.max_files), max_diff_lines=max(K.FLOOR_DIFF_LINES, a.max_diff_lines), max_chars_per_file=max(K.FLOOR_CHARS, a.max_chars_per_file)))


def _made(kind: type, values: dict[str, Any], where: str) -> Any:
    known = {f.name for f in fields(kind)}
    if unknown := [f"{where}{k}: unknown" for k in values if k not in known]:
        raise ConfigError("\n".join(unknown))
    return kind(**{k: tuple(tuple(x) if isinstance(x, list) else x for x in v) if isinstance(v, list) else v for k, v in values.items()})


def from_dict(values: dict[str, Any]) -> Config:
    if not isinstance(values, dict):
        raise ConfigError("the configuration must be an object")
    values = dict(values)
    for name, kind in (("ai", Ai), ("local_review", LocalReview)):
        if name in values:
            values[name] = _made(kind, values[name], f"{name}.")
    return _made(Config, values, "")


def load(folder: str = ".") -> Config:
    """The first configuration file there is, over the defaults."""
    for name in FILES:
        path = os.path.join(folder, name)
        if os.path.exists(path):
            with open(path, encoding="utf-8") as file:
                try:
                    return from_dict(json.load(file))
                except json.JSONDecodeError as e:
                    raise ConfigError(f"{name}: {e}") from e
    return Config()


def flag(value: str | None) -> bool | None:
    """A switch from the environment: None if it isn't one."""
    low = (value or "").strip().lower()
    return True if low in ("1", "true", "yes", "on") else False if low in ("0", "false", "no", "off") else None


def system_prompt(config: Config, skills: str = "") -> str:
    """Instructions for a model: stack, skills, the first rules, the form of the answer."""
    parts = ["You review source changes for defects and security problems."]
    if config.tech_stack:
        parts.append(f"Technology: {config.tech_stack}")
    if skills:
        parts.append(skills)
    if config.rules:
        parts.append("Rules:\n" + "\n".join(f"{i}. {r}" for i, r in enumerate(config.rules[: K.RULES_MOST], 1)))
    parts.append('Answer in JSON: {"status": "PASS|FAIL", "message": "...", "issues": [{"line": 1, "severity": "CRITICAL|WARNING|INFO", "message": "...", "suggestion": "..."}]}')
    return "\n\n".join(parts)


def commit_prompt(commit_format: str = "") -> str:
    """Instructions for a model that judges commit messages: a format of one's own or conventional commits, the form of the answer."""
    if commit_format:
        rules = f'You check commit messages. Reject every message that does not follow this format:\n"{commit_format}"'
    else:
        rules = "You check commit messages against conventional commits: `<type>(<scope>): <subject>`, of type feat, fix, docs, style, refactor, perf, test, build, ci, chore or revert. The subject is lower-case, imperative and says what changed."
    return rules + '\n\nAnswer in JSON: {"status": "PASS|FAIL", "message": "reason of a failure", "suggestion": "corrected message"}'
