"""Row-wise text functions: personal data, statistics, topics, chunks, URLs."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from .dims import contains_any

# Patterns of personal data by category, tried in this order.
PII_PATTERNS = {
    "credit_card": [r"\b(?:4[0-9]{12}(?:[0-9]{3})?|5[1-5][0-9]{14}|3[47][0-9]{13}|6(?:011|5[0-9]{2})[0-9]{12})\b"],
    "ssn": [r"\b\d{3}-\d{2}-\d{4}\b", r"\b\d{9}\b"],
    "api_key": [r"(?i)\b(?:sk|pk|api|key|token|secret|password)[_-]?[a-zA-Z0-9]{16,}\b", r"\b[A-Za-z0-9]{32,}\b"],
    "email": [r"\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Z|a-z]{2,}\b"],
    "phone": [r"\b(?:\+1[-.\s]?)?\(?\d{3}\)?[-.\s]?\d{3}[-.\s]?\d{4}\b"],
}
STOPWORDS = (
    "the", "a", "an", "and", "or", "but", "in", "on", "at", "to", "for", "of", "with", "by", "from", "is", "are", "was", "were", "been", "be", "have",
    "has", "had", "do", "does", "did", "will", "would", "could", "should", "may", "might", "this", "that", "it", "its", "they", "them", "their", "we",
    "our", "you", "your",
)
TOPICS = {
    "software engineering": ["function", "class", "variable", "algorithm", "api", "code", "programming", "software", "developer", "github", "debug", "refactor", "lint", "test", "deploy", "build"],
    "machine learning and AI": ["model", "training", "neural", "embedding", "inference", "llm", "gpt", "pytorch", "tensorflow", "dataset", "accuracy", "loss", "gradient", "fine-tune", "transformer"],
    "DevOps and infrastructure": ["docker", "kubernetes", "ci/cd", "pipeline", "deployment", "server", "cloud", "aws", "gcp", "azure", "terraform", "monitoring", "logs", "container"],
    "data science": ["dataframe", "pandas", "numpy", "visualization", "chart", "analysis", "statistics", "correlation", "regression", "jupyter", "notebook", "csv", "sql query"],
    "cybersecurity": ["vulnerability", "exploit", "cve", "attack", "encryption", "firewall", "authentication", "token", "breach", "pentest"],
    "design and UX": ["figma", "wireframe", "prototype", "ui", "ux", "user experience", "typography", "color", "mockup", "component", "design system"],
    "finance and business": ["revenue", "profit", "investor", "funding", "valuation", "budget", "roi", "kpi", "market", "startup", "saas"],
    "health and wellness": ["health", "fitness", "sleep", "nutrition", "exercise", "mental health", "stress", "meditation", "diet"],
}


def pii_counts(text: Column) -> dict[str, Column]:
    """Matches by category; of a category's patterns, the first that matches counts."""
    out = {}
    for category, patterns in PII_PATTERNS.items():
        counts = [F.regexp_count(text, F.lit(p)) for p in patterns]
        n = counts[-1]
        for c in reversed(counts[:-1]):
            n = F.when(c > 0, c).otherwise(n)
        out[category] = F.coalesce(n, F.lit(0)).cast("long")
    return out


def redact(text: Column, categories: tuple[str, ...] = ("credit_card", "ssn", "api_key", "email", "phone")) -> Column:
    """Matches replaced by ``[CATEGORY_REDACTED]``, category by category in order."""
    for category in categories:
        for p in PII_PATTERNS[category]:
            text = F.regexp_replace(text, p, f"[{category.upper()}_REDACTED]")
    return text


def words(text: Column) -> Column:
    """Words between runs of ASCII white space; none for a text without any."""
    return F.filter(F.split(text, r"[ \t\n\r\x0B\f]+"), lambda w: w != "")


def text_stats(text: Column, per_minute: int = 200) -> dict[str, Column]:
    """Words, characters, sentences (pieces between runs of ``.!?``), reading time and difficulty of 0 to 1."""
    w = words(text)
    n = F.size(w)
    sentences = F.greatest(F.lit(1), F.size(F.split(text, r"[.!?]+", -1)))
    syllables = F.aggregate(F.slice(w, 1, 1000), F.lit(0), lambda s, x: s + F.greatest(F.lit(1), F.regexp_count(F.regexp_replace(F.lower(x), "e+$", ""), F.lit("[aeiou]+"))))
    grade = 0.39 * (n / sentences) + 11.8 * (syllables / F.nullif(n, F.lit(0))) - 15.59
    return {
        "word_count": n.cast("long"), "char_count": F.length(text).cast("long"), "sentence_count": sentences.cast("long"),
        "reading_seconds": F.greatest(F.lit(1), F.ceil(n / per_minute * 60)).cast("long"), "complexity": F.when(n == 0, 0.5).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), grade / 16))),
    }


def once(value: Column, make: Callable[[Column], Column]) -> Column:
    """``make`` of a value that is found once for each row; inside a lambda it would be found again for each element."""
    return F.get(F.transform(F.array(value), make), 0)


def topic_scores(text: Column) -> dict[str, Column]:
    """How many hints of each topic a lower-case text contains."""
    return {t: F.size(F.filter(F.array(*[F.lit(h) for h in hints]), lambda h: F.contains(text, h))) for t, hints in TOPICS.items()}


def topic(text: Column) -> Column:
    """Struct of the topic with most hints (the first of equal ones), its confidence, and up to three others with
    two hints or more; "general" at 0.5 without any."""
    ranked = once(F.lower(text), _ranked)

    def named(ranked: Column) -> Column:
        first = F.get(ranked, 0)
        others = F.transform(F.filter(F.slice(ranked, 2, 3), lambda x: x["n"] <= -2), lambda x: x["t"])
        return F.struct(F.coalesce(first["t"], F.lit("general")).alias("topic"), F.when(first.isNull(), 0.5).otherwise(F.least(F.lit(0.95), -first["n"] / 10)).alias("confidence"), others.alias("secondary"))

    return once(ranked, named)


def _ranked(low: Column) -> Column:
    """Topics with hints in a lower-case text, most hints first."""
    listed = F.array(*[F.struct((-n).alias("n"), F.lit(i).alias("i"), F.lit(t).alias("t")) for i, (t, n) in enumerate(topic_scores(low).items())])
    return F.array_sort(F.filter(listed, lambda x: x["n"] < 0))


def chunks(text: Column, size: int = 1000, overlap: int = 100) -> Column:
    """Array of (position, text) of windows of ``size`` words that overlap by ``overlap``."""
    w = words(text)
    step = size - overlap
    starts = F.sequence(F.lit(0), F.greatest(F.size(w) - 1, F.lit(0)), F.lit(step))
    return F.transform(starts, lambda s: F.struct((s / step).cast("int").alias("position"), F.array_join(F.slice(w, s + 1, F.lit(size)), " ").alias("chunk")))


def url_domain(url: Column) -> Column:
    """Lower-case host without ``www.``."""
    return F.regexp_replace(F.lower(F.regexp_extract(url, r"^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#:]*)", 1)), r"^www\.", "")


def url_title(url: Column) -> Column:
    """The last part of the path without its extension, hyphens and underscores as spaces; else the host."""
    path = F.regexp_extract(url, r"^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*([^?#]*)", 1)
    last = F.regexp_extract(path, r"([^/]+)/*$", 1)
    clean = F.translate(F.regexp_replace(last, r"\.[A-Za-z0-9]+$", ""), "-_", "  ")
    return F.when(clean == "", url_domain(url)).otherwise(clean)


def mask_email(text: Column) -> Column:
    """The first character of each address' name, then stars and the host."""
    return F.regexp_replace(text, r"\b([A-Za-z0-9])[A-Za-z0-9._%+-]*@([A-Za-z0-9.-]+\.[A-Za-z]{2,})\b", "$1***@$2")


def document_type(url: Column, title: Column) -> Column:
    """Kind of a document by the first rule that its URL or title passes."""
    both = F.lower(F.concat_ws(" ", url, title))
    return F.when(both.rlike(contains_any(["arxiv", "doi.org", "paper"])), "paper").when(both.rlike(contains_any(["github.com", "gitlab.com"])), "code").when(both.rlike(contains_any(["docs.", "documentation", "/docs"])), "documentation").when(both.rlike(contains_any(["mail."])), "email").otherwise("web")
