"""Redaction of personal data and secrets."""

from __future__ import annotations

import json
import re
from dataclasses import dataclass, field, replace

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

HIDDEN = "[REDACTED]"


@dataclass(frozen=True)
class Pattern:
    name: str
    regex: str
    replacement: str = HIDDEN
    enabled: bool = True


# Patterns in the order in which they are applied.
DEFAULT_PATTERNS = (
    Pattern("email", r"\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}\b", "[EMAIL_REDACTED]"),
    Pattern("phone_us", r"\b(?:\+1[-.\s]?)?\(?[0-9]{3}\)?[-.\s]?[0-9]{3}[-.\s]?[0-9]{4}\b", "[PHONE_REDACTED]"),
    Pattern("ssn", r"\b[0-9]{3}[-.\s]?[0-9]{2}[-.\s]?[0-9]{4}\b", "[SSN_REDACTED]"),
    Pattern("credit_card", r"\b(?:[0-9]{4}[-.\s]?){3}[0-9]{4}\b", "[CC_REDACTED]"),
    Pattern("aws_account_id", r"\b[0-9]{12}\b", "[AWS_ACCOUNT_REDACTED]"),
    Pattern(
        "api_key",
        r"(?i)\b(?:sk|pk|api|key|token|secret|password|bearer)[-_]?[A-Za-z0-9_-]{16,}\b",
        "[API_KEY_REDACTED]",
    ),
    Pattern("aws_access_key", r"\bAKIA[0-9A-Z]{16}\b", "[AWS_KEY_REDACTED]"),
    Pattern("aws_secret_key", r"\b[A-Za-z0-9/+=]{40}\b", "[AWS_SECRET_REDACTED]", enabled=False),
    Pattern("ipv4", r"\b(?:[0-9]{1,3}\.){3}[0-9]{1,3}\b", "[IP_REDACTED]", enabled=False),
)

# Keys whose values are always hidden, whatever they hold.
SENSITIVE_KEYS = frozenset(
    ["password", "secret", "token", "api_key", "apikey", "api-key", "authorization", "auth",
     "credential", "private_key", "privatekey", "access_token", "refresh_token", "ssn",
     "social_security", "credit_card", "card_number"]
)

# Keys exempt from the rule above.
ALLOWED_KEYS = frozenset(
    ["span_id", "parent_span_id", "trace_id", "request_id", "message_id", "session_id",
     "correlation_id", "component", "operation", "ts_start", "ts_end", "timestamp", "attempt",
     "error_type", "status_code"]
)


@dataclass(frozen=True)
class RedactionConfig:
    enabled: bool = True
    patterns: tuple[Pattern, ...] = DEFAULT_PATTERNS
    sensitive_keys: frozenset[str] = field(default=SENSITIVE_KEYS)
    allowed_keys: frozenset[str] = field(default=ALLOWED_KEYS)

    def with_pattern(self, name: str, enabled: bool) -> RedactionConfig:
        """The same config with one pattern switched on or off."""
        changed = tuple(replace(p, enabled=enabled) if p.name == name else p for p in self.patterns)
        return replace(self, patterns=changed)

    def active(self) -> list[Pattern]:
        return [p for p in self.patterns if p.enabled] if self.enabled else []

    def hidden_keys(self) -> list[str]:
        if not self.enabled:
            return []
        allowed = {k.lower() for k in self.allowed_keys}
        return sorted({k.lower() for k in self.sensitive_keys} - allowed)


def redact_text(text: Column, config: RedactionConfig = RedactionConfig()) -> Column:
    """Replace every pattern in a text; stays inside the JVM."""
    for p in config.active():
        text = F.regexp_replace(text, F.lit(p.regex), F.lit(p.replacement))
    return text


def redact_map(record: Column, config: RedactionConfig = RedactionConfig()) -> Column:
    """Redact a flat MAP: hidden keys whole, other values by pattern."""
    hidden = config.hidden_keys()
    return F.transform_values(
        record,
        lambda k, v: F.when(F.lower(k).isin(hidden), F.lit(HIDDEN)).otherwise(redact_text(v, config))
        if hidden
        else redact_text(v, config),
    )


def redact_json(text: Column, config: RedactionConfig = RedactionConfig()) -> Column:
    """Redact nested JSON text by key and pattern. Rows that are not JSON objects or
    arrays are redacted as plain text, without entering Python."""
    patterns = [(re.compile(p.regex), p.replacement) for p in config.active()]
    hidden = frozenset(config.hidden_keys())

    def clean(value):
        if isinstance(value, str):
            for regex, replacement in patterns:
                value = regex.sub(replacement, value)
            return value
        if isinstance(value, dict):
            return {k: HIDDEN if k.lower() in hidden else clean(v) for k, v in value.items()}
        if isinstance(value, list):
            return [clean(v) for v in value]
        return value

    @F.pandas_udf("string")
    def run(texts: pd.Series) -> pd.Series:
        def one(t):
            if t is None:
                return None
            try:
                return json.dumps(clean(json.loads(t)), ensure_ascii=False)
            except (ValueError, RecursionError):
                return None

        return pd.Series([one(t) for t in texts], dtype=object)

    if not config.enabled:
        return text
    nested = F.when(text.rlike(r"^\s*[\{\[]"), text)
    return F.coalesce(run(nested), redact_text(text, config))


def pattern_hits(text: Column, patterns: tuple[Pattern, ...] = DEFAULT_PATTERNS) -> Column:
    """MAP of pattern name to the number of matches in the unredacted text."""
    return F.create_map(
        *[x for p in patterns for x in (F.lit(p.name), F.regexp_count(text, F.lit(p.regex)))]
    )
