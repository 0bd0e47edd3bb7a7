"""Prompt prefixes."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def apply_prompt(
    payload: Column, task: Column, query_prompt: Column, document_prompt: Column
) -> Column:
    """The payload behind its model's prompt for the task; no trimming on either side."""
    return F.concat(F.when(task == "query", query_prompt).otherwise(document_prompt), payload)
