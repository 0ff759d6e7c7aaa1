"""robots.txt: groups of agents and rules, and what they allow."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType

_LINE = re.compile(r"^([A-Za-z-]+)\s*:\s*(.*)$")
Group = tuple[list[str], list[tuple[bool, str]]]


def parse(text: str) -> list[Group]:
    """Groups in order; agents that follow each other share one, a disallow without a path says nothing."""
    groups: list[Group] = []
    agents_open = False
    for raw in re.split(r"\r?\n", text):
        found = _LINE.match(raw.split("#", 1)[0].strip())
        if not found:
            continue
        key, value = found[1].lower(), found[2].strip()
        if key == "user-agent":
            if not groups or not agents_open:
                groups.append(([], []))
            groups[-1][0].append(value.lower())
        elif key in ("allow", "disallow") and groups and (value or key == "allow"):
            groups[-1][1].append((key == "allow", value))
        agents_open = key == "user-agent"
    return groups


def matches(pattern: str, path: str) -> bool:
    """`*` stands for anything, `$` for the end."""
    return re.match("".join(".*" if c == "*" else "$" if c == "$" else re.escape(c) for c in pattern), path) is not None


def allows(groups: list[Group], path: str, agent: str) -> bool:
    """The longest matching rule of the agent's own groups, else of `*`; allow wins ties, no rule allows."""
    agent = agent.lower()
    own = [g for g in groups if any(a == agent or a != "*" and agent.startswith(a) for a in g[0])] or [g for g in groups if "*" in g[0]]
    fitting = [(len(rule), allow) for _, rules in own for allow, rule in rules if matches(rule, path)]
    return max(fitting)[1] if fitting else True


@F.pandas_udf(BooleanType())
def robots_allows(batches: Iterator[tuple[pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    """Whether robots text (null: none) lets an agent fetch a path."""
    known: dict[str, list[Group]] = {}
    for text, path, agent in batches:
        out = []
        for t, p, a in zip(text, path, agent, strict=True):
            if t not in known:
                if len(known) > 1000:
                    known.clear()
                known[t] = parse(t or "")
            out.append(allows(known[t], p or "/", a or ""))
        yield pd.Series(out, dtype="bool")
