"""Settings of a scan."""

from __future__ import annotations

from dataclasses import dataclass, field

from .rules import RULES, SEVERITIES, Rule

IGNORED = ("*.bundle.js", "*.min.js", "*.min.mjs", ".git", ".next", ".nuxt", ".venv", "__pycache__", "build", "coverage", "dist", "node_modules", "package-lock.json", "pnpm-lock.yaml", "vendor", "venv", "yarn.lock")
INCLUDED = ("**/*.{cjs,js,jsx,mjs,py,ts,tsx}",)


@dataclass(frozen=True)
class Config:
    """``rules``: a severity or "off" for a rule's id; anything else there leaves the rule as it is."""

    rules: dict[str, str] = field(default_factory=dict)
    ignore: tuple[str, ...] = IGNORED
    include: tuple[str, ...] = INCLUDED

    def active(self) -> list[Rule]:
        return [r for r in RULES if self.rules.get(r.id) != "off"]

    def severity(self, rule: Rule) -> str:
        given = self.rules.get(rule.id)
        return given if given in SEVERITIES else rule.severity

    def only(self, *ids: str) -> Config:
        """The same settings with all other rules off."""
        return Config(self.rules | {r.id: "off" for r in RULES if r.id not in ids}, self.ignore, self.include)
