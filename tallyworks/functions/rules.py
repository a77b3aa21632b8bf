"""Rules of distil profiles and of command rewriting as rows, and their compiled form.

A rule row has profile, role, ord and pattern; a setting row has profile, key
and value. The rows below are the built-in set; ``RuleBook.read`` takes rows of
a user's own from a table, which replace those of the same profile and role.
"""

from __future__ import annotations

import json
from collections import defaultdict
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import patterns

#: More rows than this are no rule set; they would be compiled into the plan.
MOST_RULES = 10_000
RULE_SCHEMA = "profile string, role string, ord int, pattern string, name string"
SETTING_SCHEMA = "profile string, key string, value string"
REWRITE = "rewrite"
ROLES = (
    "relevant", "summary", "hit", "region", "primary_pass", "primary_fail", "secondary_pass", "secondary_fail", "heading", "allow", "deny"
)

#: What each profile keeps, the region that its entity gate holds it to, and its verdict vocabulary.
BUILT_IN: list[tuple[str, str, list[str]]] = [
    ("build-log", "relevant", [patterns.BUILD_LOG["relevant"]]),
    ("build-log", "region", [patterns.BUILD_LOG["relevant"]]),
    ("build-log", "primary_pass", patterns.BUILD_LOG["pass"]),
    ("build-log", "primary_fail", patterns.BUILD_LOG["fail"]),
    ("build-log", "secondary_fail", patterns.BUILD_LOG["fail2"]),
    ("test-output", "relevant", [patterns.TEST_OUTPUT["relevant"]]),
    ("test-output", "summary", [patterns.TEST_OUTPUT["summary"]]),
    ("test-output", "region", ["FAIL[ :]|AssertionError"]),
    ("test-output", "primary_pass", patterns.TEST_OUTPUT["pass"]),
    ("test-output", "primary_fail", patterns.TEST_OUTPUT["fail"]),
    ("test-output", "secondary_fail", patterns.TEST_OUTPUT["fail2"]),
    ("doc-search", "region", [r"\S"]),
    ("file-skeleton", "hit", [patterns.DECLARATION, patterns.PLAIN_DECLARATION]),
]
#: Settings of the profiles; one that is missing is off, but for the size ratio of 0.4.
SETTINGS: dict[str, dict[str, str]] = {
    "build-log": {"distiller": "contract", "region_lines": "1", "entity_ratio": "1", "verdict": "on", "pass_if_no_fail": "on", "least_bytes": "12"},
    "test-output": {"distiller": "relevant-lines", "most_lines": "60", "entity_ratio": "1", "verdict": "on", "pass_if_no_fail": "on", "least_bytes": "12"},
    "generic-stdout": {"distiller": "head-tail", "head": "15", "tail": "10", "least_bytes": "20"},
    "search-results": {"distiller": "ranked-hits", "files": "10", "hits": "3", "least_bytes": "40"},
    "file-skeleton": {"distiller": "skeleton", "least_bytes": "40"},
    "doc-search": {"distiller": "first-hits", "hits": "24", "entities": "prose", "entity_ratio": "1", "region_lines": "12", "size_ratio": "1.5", "least_bytes": "40"},
    "doc-serve": {"distiller": "document", "sections": "4", "section_lines": "120", "entities": "prose", "entity_ratio": "1", "size_ratio": "1.2", "least_bytes": "40"},
    "doc-skeleton": {"distiller": "document", "entities": "prose", "entity_ratio": "1", "size_ratio": "0.4", "least_bytes": "40", "map": "fitted"},
    "html-skeleton": {"distiller": "document", "entities": "prose", "entity_ratio": "1", "size_ratio": "0.4", "least_bytes": "40", "map": "fitted"},
}


@dataclass
class RuleBook:
    """Rules by (profile, role) in order, and settings by profile."""

    rules: dict[tuple[str, str], list[tuple[str, str]]] = field(default_factory=dict)
    settings: dict[str, dict[str, str]] = field(default_factory=dict)

    @staticmethod
    def built_in() -> RuleBook:
        book = RuleBook({(p, role): [(x, "") for x in given] for p, role, given in BUILT_IN}, {p: dict(s) for p, s in SETTINGS.items()})
        book.rules[REWRITE, "allow"] = [(x, name) for name, x in patterns.REWRITE_ALLOW]
        book.rules[REWRITE, "deny"] = [(x, name) for name, x in patterns.REWRITE_DENY]
        return book

    def read(self, rules: DataFrame | None = None, settings: DataFrame | None = None) -> RuleBook:
        """This book with a user's rows. A bad row raises with its place; a set above MOST_RULES rows is refused."""
        book = RuleBook(dict(self.rules), {p: dict(s) for p, s in self.settings.items()})
        if rules is not None:
            mine: dict = defaultdict(list)
            for r in _few(rules.select("profile", "role", "ord", "pattern", "name").orderBy("profile", "role", "ord")):
                where = f"rule {r['ord']} of profile {r['profile']}, role {r['role']}"
                if r["profile"] is None or r["role"] not in ROLES or r["ord"] is None or not r["pattern"]:
                    raise ValueError(f"{where}: profile, a known role, ord and pattern are needed")
                _compiles(rules.sparkSession, r["pattern"], where)
                mine[r["profile"], r["role"]].append((r["pattern"], r["name"] or ""))
            book.rules.update(mine)
        if settings is not None:
            for r in _few(settings.select("profile", "key", "value").orderBy("profile", "key")):
                if not r["profile"] or not r["key"] or r["value"] is None:
                    raise ValueError(f"setting {r['key']} of profile {r['profile']}: profile, key and value are needed")
                book.settings.setdefault(r["profile"], {})[r["key"]] = r["value"]
        return book

    def rows(self, spark: SparkSession) -> DataFrame:
        """The rules as a table."""
        told = [(p, role, k, x, name) for (p, role), given in self.rules.items() for k, (x, name) in enumerate(given)]
        return spark.createDataFrame(told, RULE_SCHEMA)

    def fingerprint(self) -> str:
        """A text that changes with any rule or setting, for audit rows."""
        return json.dumps({"rules": sorted((*k, v) for k, v in self.rules.items()), "settings": self.settings}, sort_keys=True)

    def profiles(self) -> list[str]:
        return sorted(self.settings)

    def has(self, profile: str, role: str) -> bool:
        return bool(self.rules.get((profile, role)))

    def alternation(self, profile: str, role: str, flags: str = "im") -> str:
        """All patterns of a role as one: one scan of a text."""
        return f"(?{flags})" + "|".join(f"(?:{x})" for x, _ in self.rules[profile, role])

    def hits(self, text: Column, profile: str, role: str, flags: str = "im") -> Column:
        """Whether any rule of the role matches somewhere; without rules, no."""
        return text.rlike(self.alternation(profile, role, flags)) if self.has(profile, role) else F.lit(False)

    def setting(self, profile: str, key: str, default: str | None = None) -> str | None:
        return self.settings.get(profile, {}).get(key, default)

    def number(self, profile: str, key: str, default: float) -> float:
        return float(self.setting(profile, key, str(default)))

    def first_named(self, text: Column, profile: str, allow: str = "allow", deny: Column | None = None) -> Column:
        """Name of the first rule of ``allow`` that matches; null where ``deny`` holds or none does."""
        named = F.when(deny, None) if deny is not None else F.when(F.lit(False), F.lit(None).cast("string"))
        for pattern, name in self.rules.get((profile, allow), []):
            named = named.when(text.rlike("(?i)" + pattern), F.lit(name))
        return named


def _few(rows: DataFrame) -> list:
    found = rows.limit(MOST_RULES + 1).collect()
    if len(found) > MOST_RULES:
        raise ValueError(f"more than {MOST_RULES} rows are no rule set")
    return found


def _compiles(spark: SparkSession, pattern: str, where: str) -> None:
    try:
        spark._jvm.java.util.regex.Pattern.compile(pattern)
    except Exception as bad:
        raise ValueError(f"{where}: the pattern {pattern!r} is not valid") from bad
