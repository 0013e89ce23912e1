"""Guardrail analytics over large tables of prompts and responses, on Spark."""

__version__ = "0.1.0"
