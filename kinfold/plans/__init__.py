"""Declarative definitions, matching rules and execution contexts."""
