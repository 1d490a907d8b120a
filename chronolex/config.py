"""Thresholds of the engine in one place; the values are fixed by the semantics it reproduces."""

from __future__ import annotations

from dataclasses import dataclass

# Word lists, patterns and numbers that results depend on.
IDENTITY_STOP_WORDS = (
    "and", "anr", "another", "appeal", "appeals", "court", "etc", "for", "from", "has", "have", "in", "judgment", "law", "ltd", "limited", "of", "or",
    "ors", "others", "state", "the", "this", "to", "union", "v", "versus", "with",
)
PROCEDURAL_STOP_WORDS = (
    "a", "an", "and", "appeal", "appeals", "appellate", "appellant", "appellants", "application", "applications", "are", "arising", "at", "been",
    "before", "by", "case", "cases", "civil", "company", "companynsel", "companyrt", "consideration", "court", "dated", "directed", "from", "for",
    "granted", "has", "have", "hearing", "high", "in", "is", "it", "judgment", "jurisdiction", "learned", "leave", "matter", "no", "of", "on", "order",
    "original", "parties", "petition", "petitions", "respondent", "respondents", "special", "supreme", "the", "these", "this", "to", "under", "versus",
    "v", "was", "were", "with",
)
TITLE_STOP_WORDS = ("and", "anr", "another", "ors", "others", "etc", "of", "the")
MARGIN = r"^[A-H]$"
NUMBER = r"^[0-9]{1,6}$"
HEADER = r"(?i)^(?:[A-H]\s+)?SUPREME COURT REPORTS\b"
SECTION_HEADER = r"^[ \t]*(?:final[ \t]+)?(?:order|held|conclusion|operative[ \t]+(?:order|part)|decision)[ \t]*[:\-\x{2013}\x{2014}]?[ \t]*$"
DISPOSITIVE = (
    r"\b(?:the[ \t]+)?(?:civil[ \t]+)?(?:appeal(?:s)?|petition(?:s)?|application(?:s)?|writ[ \t]+petition(?:s)?|special[ \t]+leave[ \t]+petition(?:s)?)[ \t]*(?:(?:fail(?:s)?[ \t]+and[ \t]+)?(?:is|are|stand)[ \t,]*)?(?:(?:therefore|accordingly|thus|hence|hereby)[ \t,]*)?(?:allowed|dismissed|disposed[ \t]+of|accepted|rejected|granted)\b",
    r"\b(?:we|i)[ \t,]+(?:(?:therefore|accordingly|thus|hence)[ \t,]+)?(?:allow|dismiss|dispose[ \t]+of|grant|reject)[ \t]+(?:(?:both|the)[ \t]+)?(?:appeal(?:s)?|petition(?:s)?|application(?:s)?|writ[ \t]+petition(?:s)?|special[ \t]+leave[ \t]+petition(?:s)?)\b",
    r"\b(?:in[ \t]+the[ \t]+result|for[ \t]+the[ \t]+foregoing[ \t]+reasons)\b[^.]{0,200}\b(?:allow|dismiss|dispose|grant|reject|set[ \t]+aside)\b",
    r"\b(?:the[ \t]+)?impugned[ \t]+(?:judg(?:e)?ment|order)[ \t]+(?:is[ \t]+)?(?:hereby[ \t]+)?(?:set[ \t]+aside|affirmed|upheld|quashed)\b",
)


def _marked_letters() -> tuple[str, str]:
    """Letters that Unicode composes of one plain letter and marks, and the plain ones in the same order; then the marks, which have none."""
    import unicodedata

    found = {}
    for c in map(chr, [*range(0xC0, 0x250), *range(0x370, 0x530), *range(0x1E00, 0x2000)]):
        parts = unicodedata.normalize("NFD", c)
        plain = "".join(x for x in parts if not unicodedata.combining(x))
        if len(parts) > 1 and len(plain) == 1 and plain.isalpha():
            found[c] = plain
    marks = "".join(chr(x) for x in range(0x300, 0x370) if unicodedata.combining(chr(x)))
    return "".join(found) + marks, "".join(found.values())


ACCENTED, UNACCENTED = _marked_letters()


@dataclass(frozen=True)
class Config:
    top_k: int = 100
    selected: int = 5
    k1: float = 1.2
    b: float = 0.75
    least_idf: float = 1e-6
    query_terms: int = 32
    legal_boost: float = 10.0
    shingle: int = 6
    shared_phrases: int = 100
    phrase_coverage: float = 0.8
    shared_terms: int = 2
    identity_coverage: float = 0.8
    rare_token: int = 50
    lines_per_page: int = 5
    edge_lines: int = 4
    furniture_pages: int = 3
    chunk_words: int = 220
    chunk_sentences: int = 4
    aligned_chars: int = 240
    retained: float = 0.6
    least_retained: float = 0.1
    least_words: int = 100
    window: int = 510
    overlap: int = 50


CONFIG = Config()
