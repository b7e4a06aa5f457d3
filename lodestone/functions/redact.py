"""Masks for what points out of a text: addresses, paths, names in code. Column functions without Python code."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The masks in their order (what is reported, pattern, replacement) and the names that may stay.
MASKS = [
    ("an email address", r"\b[\w.\-+]+@[\w.\-]+\.[A-Za-z]{2,}\b", "[email]"),
    ("a URL", r"\bhttps?://\S+|\bwww\.\S+\b", "[url]"),
    ("a filesystem path", r"\b(?:[\w.\-]+[/\\])+[\w.\-]+\b", "[path]"),
    ("a filename", r"\b[\w\-]+\.(?:py|js|jsx|mjs|cjs|ts|tsx|go|java|rb|php|cs|rs|kt|kts|swift|scala|c|cc|cpp|h|hpp|m|mm|sh|sql|yml|yaml|toml|json)\b", "[file]"),
    ("an object hash", r"\b[0-9a-f]{7,40}\b", "[hash]"),
    ("a quoted string", r"\"[^\"]{1,200}\"|(?<![A-Za-z])'[^']{1,200}'", ""),
    ("code punctuation", r"[{}]|=>|->|::|`", ""),
    ("an identifier", r"\b[a-zA-Z_]\w+(?:\.[a-zA-Z_]\w+)+\b", "[identifier]"),
    ("an identifier", r"\b[A-Za-z][A-Za-z0-9]*(?:_[A-Za-z0-9]+)+\b", "[identifier]"),
    ("a camelCase identifier", r"\b[a-z]+(?:[A-Z][a-z0-9]*)+\b", "[identifier]"),
    ("an uppercase identifier", r"\b(?:[A-Z][A-Z0-9]*(?:_[A-Z0-9]+)+|[A-Z][A-Z0-9]+)\b", "[identifier]"),
]
TECHNOLOGIES = [
    "PostgreSQL", "MySQL", "MariaDB", "SQLite", "MongoDB", "DynamoDB", "ClickHouse", "BigQuery", "RedShift", "Snowflake",
    "ElasticSearch", "OpenSearch", "RabbitMQ", "GraphQL", "OpenAPI", "JavaScript", "TypeScript", "WebSocket", "WebAssembly",
    "PowerShell", "NoSQL", "OAuth", "GitHub", "GitLab", "BitBucket", "DevOps", "Kubernetes", "TensorFlow", "PyTorch", "NumPy",
    "SciPy", "DataDog", "NewRelic", "PagerDuty", "PayPal", "QuickBooks", "SalesForce", "Shopify", "Stripe", "Twilio", "SendGrid",
    "MacOS", "AppStore", "PlayStore", "AirFlow", "SpringBoot", "DjangoREST", "FastAPI", "NextJS", "NuxtJS", "SvelteKit", "DotNet",
    "AspNet", "Python", "Java", "Kotlin", "Swift", "Scala", "Rust", "Ruby", "React", "Angular", "Django", "Flask", "Fastapi",
    "Terraform", "Ansible", "Docker", "Maven", "Gradle",
]
MOST_CHARS = 2000
# End of the fixed values.

_KNOWN = "|".join(TECHNOLOGIES)
#: Possessive, so that a mixed-caps word is taken whole, as a known name must be.
_MIXED = rf"\b(?!(?:{_KNOWN})\b)[A-Z][a-z]+(?:[A-Z][a-z0-9]*)++\b"
_LONE = rf"^(?!(?:{_KNOWN})$)[A-Z][a-z]{{2,}}$"
#: Letters of every script are word characters, as in the masks' own dialect.
_U = "(?U)"


def scrubbed(text: Column) -> Column:
    """The text with every mask applied in order, spaces squeezed, repeated marks joined, cut at a word near MOST_CHARS.

    Null and empty texts give the empty text.
    """
    out = F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), _U + r"\s+", " "))
    for _, pattern, mark in MASKS:
        out = F.regexp_replace(out, _U + pattern, mark)
    out = F.regexp_replace(out, _U + _MIXED, "[identifier]")
    out = F.when(out.rlike(_LONE), "[identifier]").otherwise(out)
    out = F.regexp_replace(F.trim(F.regexp_replace(out, _U + r"\s{2,}", " ")), r"(\[\w+\])(\s+\1)+", "$1")
    cut = F.regexp_replace(F.regexp_replace(F.substring(out, 1, MOST_CHARS), " [^ ]*$", ""), "[ ,;:]+$", "")
    return F.when(F.length(out) > MOST_CHARS, F.concat(cut, F.lit("..."))).otherwise(out)


def leak(text: Column) -> Column:
    """What the first mask that still finds something is called; null where none does."""
    found = [F.when(text.rlike(_U + pattern), F.lit(called)) for called, pattern, _ in MASKS]
    return F.coalesce(*found, F.when(text.rlike(_U + _MIXED), F.lit("a class name")), F.when(text.rlike(_LONE), F.lit("a proper name")))
