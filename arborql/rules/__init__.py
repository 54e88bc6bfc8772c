"""The rule language: text to a model."""

from .model import Case, Matcher, Predicate, Relation, Rule, RuleError
from .reader import read_rules

__all__ = ["Case", "Matcher", "Predicate", "Relation", "Rule", "RuleError", "read_rules"]
