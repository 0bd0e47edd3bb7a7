"""Column expressions. All of them are JVM-side."""

from vectorloom.functions.failures import classify_failure
from vectorloom.functions.prompts import apply_prompt
from vectorloom.functions.tokens import (
    fit_text,
    kept_tokens,
    tokenize,
    truncate_tokens,
)
from vectorloom.functions.validation import (
    check_dimensions,
    check_payloads,
    request_error,
    unknown_model,
)
from vectorloom.functions.vectors import (
    dot,
    finalize,
    l2_norm,
    l2_normalize,
    truncate_dims,
)

__all__ = [
    "apply_prompt",
    "check_dimensions",
    "check_payloads",
    "classify_failure",
    "dot",
    "finalize",
    "fit_text",
    "kept_tokens",
    "l2_norm",
    "l2_normalize",
    "request_error",
    "tokenize",
    "truncate_dims",
    "truncate_tokens",
    "unknown_model",
]
