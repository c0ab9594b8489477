"""Strict reading of policy documents: a document that is not exactly right is refused, by the name of its field."""

from __future__ import annotations

import math
import re
from collections.abc import Callable

from lakeward.functions.hints import DIRECT

# What the fields of policies may hold.
SEVERITIES, ACTIONS = ("low", "medium", "high", "critical"), ("connect", "auth_failure", "read", "write", "ddl", "dcl")
ENGINES = ("postgresql", "mysql", "mariadb", "mongodb", "sqlite", "sqlserver", "firebird", "redis", "valkey", "openldap", "cas")
MOST_ITEMS, MOST_TEXT, MOST_NOTIFY = 100, 256, 10
_SELECTOR, _CHANNEL = re.compile(r"[a-z]+(?:_[a-z]+)*(?:\.(?:[a-z]+(?:_[a-z]+)*|\*))?"), re.compile(r"[a-z0-9][a-z0-9-]{0,63}")


class PolicyError(ValueError):
    """The field of a document that is wrong; its value is not told."""


def _texts(test: Callable[[str], bool] = lambda s: True) -> Callable[[object], bool]:
    def right(value: object) -> bool:
        listed = isinstance(value, (list, tuple)) and 1 <= len(value) <= MOST_ITEMS
        return listed and all(isinstance(v, str) and 0 < len(v) <= MOST_TEXT and "\0" not in v and test(v) for v in value) and len(set(value)) == len(value)

    return right


def _number(low: float, high: float, whole: bool = False) -> Callable[[object], bool]:
    def right(value: object) -> bool:
        known = isinstance(value, (int, float)) and not isinstance(value, bool) and math.isfinite(value)
        return known and low <= value <= high and (not whole or float(value).is_integer())

    return right


def _hours(value: object) -> bool:
    return isinstance(value, (list, tuple)) and len(value) == 2 and all(_number(0, 23, True)(v) for v in value)


_SHARED = {"engines": _texts(lambda s: s in ENGINES), "targets": _texts(), "objects": _texts()}
FINDING_FIELDS = {
    **_SHARED, "classifiers": _texts(lambda s: s in DIRECT), "min_confidence": _number(0, 1), "min_match_ratio": _number(0, 1), "min_matched": _number(0, 10_000, True),
}
EVENT_FIELDS = {
    **_SHARED, "actions": _texts(lambda s: s in ACTIONS), "classifiers": _texts(lambda s: s in DIRECT), "principals": _texts(), "signals": _texts(lambda s: bool(_SELECTOR.fullmatch(s))), "min_rows": _number(0, 2**53 - 1, True),
    "min_score": _number(0, 1_000_000), "anomaly": lambda v: isinstance(v, bool), "hours": _hours,
}


def checked_conditions(conditions: object, fields: dict[str, Callable[[object], bool]]) -> dict:
    """The conditions, if each is known and right; a condition that is null does not count as absent."""
    if not isinstance(conditions, dict) or not all(isinstance(k, str) for k in conditions):
        raise PolicyError("conditions")
    for name, value in conditions.items():
        if name not in fields:
            raise PolicyError(f"unknown condition {name!r}")
        if not fields[name](value):
            raise PolicyError(name)
    return conditions


def checked_actions(actions: object) -> list[dict]:
    """One `create_incident` at most and at least, and some `notify` to different channels."""
    if not isinstance(actions, (list, tuple)) or not 1 <= len(actions) <= 1 + MOST_NOTIFY:
        raise PolicyError("actions")
    channels: set[str] = set()
    opened = 0
    for a in actions:
        if not isinstance(a, dict) or a.get("type") not in ("create_incident", "notify"):
            raise PolicyError("actions.type")
        name = "severity" if a["type"] == "create_incident" else "channel"
        if set(a) != {"type", name} or not isinstance(a[name], str):
            raise PolicyError(f"actions.{name}")
        if name == "severity":
            opened += 1
            if a[name] not in SEVERITIES:
                raise PolicyError("actions.severity")
        elif not _CHANNEL.fullmatch(a[name]) or a[name] in channels:
            raise PolicyError("actions.channel")
        else:
            channels.add(a[name])
    if opened != 1:
        raise PolicyError("actions")
    return list(actions)
