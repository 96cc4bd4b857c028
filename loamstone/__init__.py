"""Retrieval, guardrail and conversation analytics as Spark DataFrame operators."""
