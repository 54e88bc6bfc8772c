"""Project settings: which rules are off, and other severities."""

from __future__ import annotations

import os
from dataclasses import dataclass, field

from ..rules import Rule, RuleError, read_rules


@dataclass
class Config:
    off: set[str] = field(default_factory=set)
    severities: dict[str, str] = field(default_factory=dict)

    def disabled(self, rule: str) -> bool:
        return rule in self.off

    def severity(self, rule: str) -> str | None:
        return self.severities.get(rule)


def read_config(text: str) -> Config:
    """Lines ``disable = ["a", "b"]``, and ``severity = "error"`` or ``enabled = false`` under ``[rules.ID]``.

    A comment after a value is part of the value, so such a line sets nothing; ``enabled = true`` undoes no ``disable``.
    """
    config, section = Config(), ""
    for raw in text.splitlines():
        line = raw.strip()
        if not line or line.startswith("#"):
            continue
        if line.startswith("[") and line.endswith("]"):
            section = line[1:-1].strip()
            continue
        key, sign, value = (x.strip() for x in line.partition("="))
        if not sign:
            continue
        if key == "disable" and value.startswith("[") and value.endswith("]"):
            config.off |= {x.strip().strip("\"'") for x in value[1:-1].split(",")} - {""}
        elif section.startswith("rules."):
            rule = section[6:].strip().strip("\"'")
            if key == "severity" and value.strip("\"'") in ("error", "warning", "info"):
                config.severities[rule] = value.strip("\"'")
            elif key == "enabled" and value == "false":
                config.off.add(rule)
    return config


def load_rules(folder: str) -> tuple[list[Rule], list[str]]:
    """Rules of all rule files directly in a folder, by name, and what is wrong with the others. No folder: none."""
    rules, errors = [], []
    for name in sorted(os.listdir(folder)) if os.path.isdir(folder) else []:
        if name.endswith(".lint"):
            path = os.path.join(folder, name)
            try:
                with open(path, encoding="utf-8") as f:
                    rules += read_rules(f.read(), path)
            except (RuleError, OSError, UnicodeDecodeError) as e:
                errors.append(str(e))
    return rules, errors


def load_config(root: str) -> Config:
    for name in (".lint.toml", "lint.toml"):
        if os.path.isfile(path := os.path.join(root, name)):
            with open(path, encoding="utf-8") as f:
                return read_config(f.read())
    return Config()
