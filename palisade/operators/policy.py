"""Policy: validated settings, fail closed, and rules as data."""

from __future__ import annotations

import re
from dataclasses import dataclass, field, fields

from palisade.functions.globs import to_regex
from palisade.functions.re2 import to_java

MODES = ("enforce", "warn", "ci_strict")
SEVERITIES = ("error", "warn", "info")


@dataclass(frozen=True)
class BudgetOverride:
    paths: tuple[str, ...]
    max_lines: int = 0
    max_files: int = 0
    max_new_files: int = 0


@dataclass(frozen=True)
class Rule:
    rule_id: str
    pattern: str
    severity: str
    message: str
    retry_hint: str
    positives: tuple[str, ...]
    negatives: tuple[str, ...]
    #: A text that the pattern finds holds one of these; lines without any are spared the pattern. None: no such text.
    needles: tuple[str, ...] = ()
    #: What a person might do about it, and a change that a program can make by itself.
    suggestion: str = ""
    fix: str = ""


# Patterns, names and severities that results depend on.
RULES = (
    Rule(
        "no-new-lint-suppressions",
        r"eslint-disable|#\s*noqa|//\s*nolint|@ts-ignore|@ts-nocheck|#\s*pragma\s+warning\s+disable",
        "error",
        "this line silences a linter or type checker",
        "Take the suppression out and repair what it hides.",
        ("import os  #noqa: F401", "err = run() // nolint", "/* eslint-disable */", "// @ts-nocheck", "# pragma  warning disable 612"),
        ("# a note on linting", "lint = disable()", "total += 1"),
        ("eslint-disable", "noqa", "nolint", "@ts-ignore", "@ts-nocheck", "pragma"),
    ),
    Rule(
        "no-broad-catch",
        r"(\bexcept\s*:|\bexcept\s+Exception\s*:\s*(pass)?\s*$|catch\s*\([^)]*\)\s*\{\s*\}|catch\s*\{\s*\})",
        "warn",
        "this handler catches everything and may hide failures",
        "Catch the error that is expected, and log or raise it again.",
        ("except :", "except Exception: pass", "catch (Error err) { }", "} catch {}"),
        ("except KeyError:", "except Exception as e: raise", "catch (err) { report(err) }"),
        ("except", "catch"),
    ),
)


@dataclass(frozen=True)
class Policy:
    """Defaults hold where a setting is left out; :func:`load` refuses unknown names and bad values.

    The default limits, branches, trailers and prefixes are fixed values.
    """

    mode: str = "enforce"
    max_lines: int = 300
    max_files: int = 20
    max_new_files: int = 10
    overrides: tuple[BudgetOverride, ...] = ()
    protected: tuple[str, ...] = ("main", "release/*")
    trailers: tuple[str, ...] = ("Claude", "GitHub Copilot", "Cursor", "Devin", "Aider")
    prefixes: tuple[str, ...] = ("agent/", "ai/")
    heuristics: tuple[str, ...] = ()
    apply_gates_to: str = "all-commits"
    allow_always: tuple[str, ...] = ()
    declared: tuple[str, ...] | None = None
    require_manifest: bool = False
    disabled_rules: tuple[str, ...] = ()
    severities: dict[str, str] = field(default_factory=dict)
    stop_on_first_block: bool = False

    def __post_init__(self):
        if self.mode not in MODES:
            raise ValueError(f"mode {self.mode!r} is not one of {MODES}")
        if self.apply_gates_to not in ("all-commits", "agent-only", ""):
            raise ValueError(f"apply_gates_to {self.apply_gates_to!r}")
        for name in ("max_lines", "max_files", "max_new_files"):
            if any(getattr(x, name) < 0 for x in (self, *self.overrides)):
                raise ValueError(f"{name} is negative")
        for glob in [*self.protected, *self.allow_always, *(self.declared or ()), *(p for o in self.overrides for p in o.paths)]:
            to_regex(glob)
        for pattern in self.heuristics:
            to_java(pattern)
            re.compile(pattern)
        for key, value in self.severities.items():
            if value not in SEVERITIES:
                raise ValueError(f"severity {value!r} of {key}")


def from_environment(settings: dict, environment: dict[str, str], prefix: str = "PALISADE_") -> dict:
    """``settings`` with the mode, and rules to be left out (comma-separated), that the environment gives; a strict mode given there holds."""
    out = dict(settings)
    if mode := environment.get(f"{prefix}MODE", "").strip():
        out["mode"] = mode
    given = [x.strip() for x in environment.get(f"{prefix}OVERRIDE", "").split(",")]
    if out.get("mode") != "ci_strict" and any(given):
        out["disabled_rules"] = [*out.get("disabled_rules", ()), *(x for x in given if x)]
    return out


def load(settings: dict) -> Policy:
    """A policy from plain settings; unknown names are all named, sorted."""
    known = {f.name for f in fields(Policy)}
    if unknown := sorted(set(settings) - known):
        raise ValueError(f"unknown settings: {', '.join(unknown)}")
    values = {k: tuple(v) if isinstance(v, list) else v for k, v in settings.items()}
    if "overrides" in values:
        values["overrides"] = tuple(o if isinstance(o, BudgetOverride) else BudgetOverride(**{k: tuple(v) if isinstance(v, list) else v for k, v in o.items()}) for o in values["overrides"])
    return Policy(**values)


#: The settings of a policy file by their dotted names, with the field of :class:`Policy` each one sets, and the kind of value it takes.
SETTINGS = {
    "version": ("", "int"), "mode": ("mode", "string"), "stop_on_first_block": ("stop_on_first_block", "boolean"),
    "provenance.branch_prefixes": ("prefixes", "list"), "provenance.trailers": ("trailers", "list"), "provenance.apply_gates_to": ("apply_gates_to", "string"), "provenance.heuristics": ("heuristics", "list"),
    "gates.diff_budget.max_lines": ("max_lines", "int"), "gates.diff_budget.max_files": ("max_files", "int"), "gates.diff_budget.max_new_files": ("max_new_files", "int"), "gates.diff_budget.overrides": ("overrides", "list"),
    "gates.branch_policy.protected": ("protected", "list"), "gates.ai_patterns.enabled": ("", "boolean"), "gates.ai_patterns.disable_rules": ("disabled_rules", "list"),
    "gates.scope.require_task_manifest": ("require_manifest", "boolean"), "gates.scope.allow_always": ("allow_always", "list"),
}
#: A namespace of its own: severities by rule.
REMAPPED = "rule_overrides"
