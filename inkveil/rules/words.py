"""Word lists: keywords by category, entity labels and the whitelist."""

from __future__ import annotations

# The sensitive keywords of each category, in order.
KEYWORDS: dict[str, tuple[str, ...]] = {
    "company_names": (
        "Optiv", "ClientCorp", "Project Titan", "Arbortext",
        "Accenture", "Infosys", "TCS", "Wipro", "Cognizant",
        "Microsoft", "Google", "Amazon", "Meta", "Apple",
    ),
    "person_names": (
        "Kavitha", "Heather Trujillo", "Chris C. Christopherson",
        "John Doe", "Jane Smith",
    ),
    "locations": (
        "Vengadamangalam", "Chengalpattu", "Chennai", "Mumbai",
        "Bangalore", "Hyderabad", "Delhi", "Kolkata",
    ),
    "banks": (
        "SBI", "HDFC", "ICICI", "Axis Bank", "PNB", "Bank of Baroda",
        "Canara Bank", "Union Bank", "IDBI", "Kotak Mahindra",
    ),
    "technical": (
        "root", "admin", "administrator", "superuser", "sa",
        "postgres", "mysql", "oracle", "mongodb",
    ),
    "projects": (
        "Project Alpha", "Project Beta", "Confidential Project",
        "Internal System", "Production Database",
    ),
    "medical": (
        "diagnosis", "prescription", "medical record", "patient",
        "treatment", "medication", "health insurance",
    ),
}

# Categories whose keywords are redacted in running text.
REDACTED_CATEGORIES: tuple[str, ...] = (
    "company_names", "person_names", "banks", "projects",
)

# Categories that only count in a telling context, and what tells.
GATED_CATEGORIES: tuple[str, ...] = ("technical", "medical")
GATE_WORDS: tuple[str, ...] = (
    "password", "credential", "login", "auth", "patient", "diagnosis",
)

# Tag of each entity label; None means known but not redacted.
ENTITY_TAGS: dict[str, str | None] = {
    "PERSON": "<person>",
    "ORG": "<organization>",
    "GPE": "<location>",
    "LOC": "<location>",
    "DATE": "<date>",
    "MONEY": "<amount>",
    "CARDINAL": None,
    "FAC": "<facility>",
    "PRODUCT": "<product>",
}

# Words a tagger mistakes for persons, and the years that make a
# date worth flagging.
NOT_PERSONS: tuple[str, ...] = ("the", "and", "for")
TELLING_YEARS: tuple[str, ...] = (
    "1950", "1960", "1970", "1980", "1990", "2000", "2010", "2020",
)

# Words that are never redacted as a whole.
WHITELIST: tuple[str, ...] = (
    "the", "and", "for", "with", "from", "this", "that", "these", "those",
    "have", "has", "had", "will", "would", "could", "should", "may", "might",
    "can", "must", "shall", "being", "been", "were", "was", "are", "is",
    "data", "file", "document", "report", "analysis", "system", "process",
    "method", "approach", "solution", "problem", "issue", "error", "warning",
    "info", "information", "details", "summary", "overview", "introduction",
    "conclusion", "reference", "example", "sample", "test", "demo", "template",
)


def keyword_tag(category: str) -> str:
    """The tag of a category: its name without the plural letter."""
    return f"<{category[:-1]}>"
