"""Spark jobs over agent-session logs, text artifacts, document corpora and ledgers."""
