"""Operators for text and sequence corpora; nothing outside this subpackage imports it."""

PLANS = [f"lavra.llm.plan_{name}" for name in ("copies", "runs", "lookalike", "nearest", "tokens", "mixture", "sentences")]
