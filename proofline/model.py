"""The data model as Spark schemas, and its fixed dimensions. Nothing is inferred from data."""

from __future__ import annotations

# Categories of issues and their subtypes.
SUBTYPES = {
    "spelling": ["misspelling", "typo", "accent", "capitalization"],
    "grammar": ["agreement", "conjugation", "syntax", "gender_number", "missing_word"],
    "punctuation": ["punctuation", "spacing"],
    "style": ["awkward", "too_long", "unclear", "wordy", "informal_register", "local_repetition"],
    "coherence": ["terminology_variant", "acronym", "tense_shift", "contradiction", "naming_inconsistency", "global_repetition"],
    "structure": ["heading_wording", "heading_numbering", "weak_transition", "incomplete_paragraph", "possibly_missing_section", "unbalanced_section", "toc_mismatch"],
}
CATEGORIES = list(SUBTYPES)
NATURES = ["error", "suggestion", "potential", "verify"]
SEVERITIES = ["minor", "major", "critical"]
CONFIDENCES = ["high", "medium", "low"]
STATUSES = ["open", "accepted", "ignored", "verified", "edited"]
SOURCES = ["rules", "local", "context", "global", "verify"]
STAGES = ["QUEUED", "EXTRACTING", "ANALYZING_LOCAL", "ANALYZING_CONTEXT", "ANALYZING_GLOBAL", "FINALIZING", "COMPLETED", "FAILED", "CANCELED"]
TERMINAL = ["COMPLETED", "FAILED", "CANCELED"]
#: Categories of which only one issue may stand at a place.
LANGUAGE = ["spelling", "grammar", "punctuation"]

# Ranks by which issues are ordered.
NATURE_RANK = {"error": 4, "suggestion": 3, "potential": 2, "verify": 1}
CONFIDENCE_RANK = {"high": 3, "medium": 2, "low": 1}
SEVERITY_RANK = {"critical": 3, "major": 2, "minor": 1}
SOURCE_RANK = {"rules": 5, "verify": 4, "local": 3, "context": 2, "global": 1}

# Issues that a rule may report per document, and how many more per thousand words.
RULE_CAPS = {
    "repeated_word": (30, 1.0),
    "long_sentence": (15, 0.5),
    "double_space": (10, 0.5),
    "space_before_punctuation": (10, 0.5),
    "doubled_punctuation": (10, 0.5),
    "missing_space_after_comma": (10, 0.5),
    "misspelling": (60, 5.0),
    "grammar": (80, 5.0),
    "accent_confusion": (20, 0.5),
}
MAX_ISSUES = 500

BLOCK = "doc_id long, ord int, kind string, part string, text string"
ISSUE = (
    "issue_id long, doc_id long, block int, start int, end int, category string, subtype string, nature string, severity string, confidence string, "
    "source string, status string, original string, suggestion string"
)
