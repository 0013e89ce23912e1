"""Column expressions: text rules, verdicts, redaction."""
