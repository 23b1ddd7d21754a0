"""Detection rules: the grammar, its checks, and the YAML source."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from pathlib import Path
from typing import Any

import yaml

# Operators of the grammar, id formats and limits.
SCALAR_OPS = ("equals", "not_equals", "contains", "not_contains", "startswith", "endswith", "regex", "gt", "gte", "lt", "lte")
LIST_OPS = ("in", "not_in")
FORMATS = {"id": r"[a-z0-9]([a-z0-9-]*[a-z0-9])?", "attack": r"T\d{4}(\.\d{3})?", "nist_csf": r"[A-Z]{2}\.[A-Z]{2}(-\d{2})?", "d3fend": r"D3-[A-Za-z]+"}
MAX_WINDOW, MAX_COUNT, MAX_CHILDREN, MAX_LIST = 86_400, 100_000, 64, 16
LIBRARY = Path(__file__).parent.parent / "rules_library"


class RuleError(ValueError):
    """A rule or rule file that does not follow the grammar."""


@dataclass(frozen=True)
class Leaf:
    path: str
    op: str
    value: Any


@dataclass(frozen=True)
class Group:
    kind: str  # all, any or not
    children: tuple


@dataclass(frozen=True)
class Threshold:
    match: Leaf | Group
    window_seconds: int
    count: int
    group_by: str


@dataclass(frozen=True)
class Rule:
    id: str
    title: str
    description: str
    severity: int
    attack: tuple[str, ...]
    nist_csf: tuple[str, ...]
    condition: Leaf | Group | Threshold
    d3fend: tuple[str, ...] = ()
    references: tuple[str, ...] = ()
    throttle: tuple[int, int] | None = field(default=None)  # (window seconds, alerts)
    enabled: bool = True

    @property
    def match(self) -> Leaf | Group:
        return self.condition.match if isinstance(self.condition, Threshold) else self.condition


def _need(ok: bool, message: str) -> None:
    if not ok:
        raise RuleError(message)


def _whole(value: Any, low: int, high: int, name: str) -> int:
    _need(isinstance(value, int) and not isinstance(value, bool) and low <= value <= high, f"{name} must be a whole number from {low} to {high}")
    return value


def _text(value: Any, most: int, name: str) -> str:
    _need(isinstance(value, str) and 1 <= len(value) <= most, f"{name} must be text of 1 to {most} characters")
    return value


def _keys(node: Any, allowed: set[str], name: str) -> dict:
    _need(isinstance(node, dict), f"{name} must be a mapping")
    _need(not (extra := set(map(str, node)) - allowed), f"unknown keys in {name}: {sorted(extra)}")
    return node


def parse_condition(node: Any, root: bool = False) -> Leaf | Group | Threshold:
    """One node of the grammar: exactly one of field, all, any, not, threshold."""
    node = _keys(node, {"field", "op", "value", "all", "any", "not", "threshold"}, "condition")
    forms = [k for k in ("field", "all", "any", "not", "threshold") if node.get(k) is not None]
    _need(len(forms) == 1, "a condition is exactly one of field, all, any, not, threshold")
    form = forms[0]
    _need(form == "field" or ("op" not in node and "value" not in node), "op and value go with field only")
    if form == "field":
        path, op, value = _text(node["field"], 200, "field"), node.get("op"), node.get("value")
        _need(op in SCALAR_OPS + LIST_OPS, f"unknown operator: {op!r}")
        _need(value is not None, "a field condition needs a value")
        many = isinstance(value, list)
        _need(many == (op in LIST_OPS), f"{op} needs a {'list' if op in LIST_OPS else 'scalar'}")
        _need(all(isinstance(v, (str, int, float, bool)) for v in (value if many else [value])), "values are text, numbers or booleans")
        if op == "regex":
            check_pattern(value)
        return Leaf(path, op, tuple(value) if many else value)
    if form == "not":
        return Group("not", (parse_condition(node["not"]),))
    if form in ("all", "any"):
        children = node[form]
        _need(isinstance(children, list) and 1 <= len(children) <= MAX_CHILDREN, f"{form} needs 1 to {MAX_CHILDREN} conditions")
        return Group(form, tuple(map(parse_condition, children)))
    _need(root, "a threshold stands at the root of a rule: its window has no meaning below")
    body = _keys(node["threshold"], {"match", "window_seconds", "count", "group_by"}, "threshold")
    return Threshold(parse_condition(body.get("match")), _whole(body.get("window_seconds"), 1, MAX_WINDOW, "window_seconds"), _whole(body.get("count"), 2, MAX_COUNT, "count"), _text(body.get("group_by"), 100, "group_by"))


def check_pattern(pattern: Any) -> None:
    """A pattern must compile here; the compiler decides where it can run."""
    import regex

    _need(isinstance(pattern, str), "a regex is text")
    try:
        regex.compile(pattern)
    except regex.error as err:
        raise RuleError(f"bad regex {pattern!r}: {err}") from err


def parse_rule(node: Any) -> Rule:
    node = _keys(node, {"id", "title", "description", "severity", "attack", "nist_csf", "d3fend", "references", "condition", "throttle", "enabled"}, "rule")
    lists = {}
    for name in ("attack", "nist_csf", "d3fend", "references"):
        values = node.get(name) or []
        _need(isinstance(values, list) and len(values) <= MAX_LIST and all(isinstance(v, str) for v in values), f"{name} must be a list of up to {MAX_LIST} texts")
        _need(bool(values) or name in ("d3fend", "references"), f"{name} is required")
        for v in values if name in FORMATS else ():
            _need(re.fullmatch(FORMATS[name], v) is not None, f"malformed {name} id: {v!r}")
        lists[name] = tuple(values)
    ident = _text(node.get("id"), 64, "id")
    _need(re.fullmatch(FORMATS["id"], ident) is not None, f"rule id {ident!r} must be lower-case kebab-case")
    throttle = None
    if node.get("throttle") is not None:
        body = _keys(node["throttle"], {"window_seconds", "max_alerts"}, "throttle")
        throttle = _whole(body.get("window_seconds"), 1, MAX_WINDOW, "window_seconds"), _whole(body.get("max_alerts", 1), 1, 10_000, "max_alerts")
    enabled = node.get("enabled", True)
    _need(isinstance(enabled, bool), "enabled is true or false")
    return Rule(id=ident, title=_text(node.get("title"), 200, "title"), description=_text(node.get("description"), 2_000, "description"), severity=_whole(node.get("severity"), 0, 7, "severity"), condition=parse_condition(node.get("condition"), root=True), throttle=throttle, enabled=enabled, **lists)


def load_rules(folder: str | Path = LIBRARY) -> list[Rule]:
    """Rules of all YAML files of a folder in file order; any fault fails the whole load."""
    rules: dict[str, Rule] = {}
    for path in sorted(p for p in Path(folder).iterdir() if p.suffix in (".yml", ".yaml")):
        try:
            rule = parse_rule(yaml.safe_load(path.read_text(encoding="utf-8")))
        except (RuleError, yaml.YAMLError, OSError, UnicodeDecodeError) as err:
            raise RuleError(f"{path.name}: {err}") from err
        _need(rule.id not in rules, f"{path.name}: duplicate rule id {rule.id!r}")
        rules[rule.id] = rule
    return list(rules.values())


def leaves(node: Leaf | Group | Threshold) -> Iterator[Leaf]:
    if isinstance(node, Leaf):
        yield node
    else:
        for child in node.children if isinstance(node, Group) else (node.match,):
            yield from leaves(child)
