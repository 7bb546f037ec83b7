"""Readers and writers of JSON lines, nested documents, dialogue strings, logs and reports."""
