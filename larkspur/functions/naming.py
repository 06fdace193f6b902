"""Column names: normal form, tokens, and what they say about a column's meaning."""

from __future__ import annotations

import re
import unicodedata
from dataclasses import dataclass, field

# The semantic types, the patterns and the keyword rules (type, words, score), in their order.
IDENTIFIER, NUMERICAL, CATEGORICAL, SURVIVAL, DATETIME, FREE_TEXT = "Identifier", "Numerical", "Categorical", "Survival", "DateTime", "Free Text"
EVENT, TIME, DATETIME_FROM, DATETIME_TO = "Event", "Time", "DateTime From", "DateTime To"
TYPES = (IDENTIFIER, NUMERICAL, CATEGORICAL, SURVIVAL, DATETIME, FREE_TEXT)
SURVIVAL_ROLES = (EVENT, TIME, DATETIME_FROM, DATETIME_TO)
DATETIME_PATTERN = "date|time|timestamp|dob"
IDENTIFIER_PATTERN = "(?:^id$|identifier|code|record|.*_id$|[a-z0-9]+id$)"
TYPE_WORDS = (
    (IDENTIFIER, "id identifier patient_id sample_id subject_id code number num record", 0.35),
    (DATETIME, "date time datetime timestamp year month day week dob created updated admission discharge", 0.25),
    (SURVIVAL, "os pfs dfs rfs efs follow followup fu months month days day weeks week years year duration event events status censor censored outcome death progression relapse alive dead", 0.30),
    (NUMERICAL, "age score count pct percent rate ratio index value level concentration titre titer", 0.20),
    (CATEGORICAL, "sex gender stage grade arm group cohort class type category subtype treatment therapy histology diagnosis site", 0.25),
    (FREE_TEXT, "note comment description remark narrative summary text", 0.35),
)
TYPE_PAIRS = (
    ("os pfs dfs rfs efs", "months month days day weeks week years year time duration", SURVIVAL, 0.45),
    ("os pfs dfs rfs efs", "event events status censor censored outcome", SURVIVAL, 0.45),
)
ROLE_WORDS = (
    (TIME, "os pfs dfs rfs efs ttf ttp ttr ttd lfs time duration follow followup fu months month days day weeks week years year", 0.30),
    (EVENT, "event events status censor censored outcome indicator flag death progression relapse recurrence failure response alive dead deceased", 0.30),
    (DATETIME_FROM, "start begin baseline index enrol enroll enrollment rand randomisation randomization randomised randomized registration diagnosis dx surgery treatment therapy date_from from_date start_date date_start date_of", 0.35),
    (DATETIME_TO, "end last final contact last_contact progression date_to to_date end_date date_end date_last last_date censored censor follow followup fu", 0.35),
)
ROLE_PAIRS = (
    ("os pfs dfs rfs efs ttf ttp ttr ttd lfs", "months month days day weeks week years year time duration", TIME, 0.50),
    ("os pfs dfs rfs efs ttf ttp ttr ttd lfs", "event events status censor censored outcome indicator flag death progression relapse", EVENT, 0.50),
    ("date dt", "start begin baseline diagnosis dx surgery treatment therapy enrol enroll rand registration", DATETIME_FROM, 0.50),
    ("date dt", "death last end contact progression relapse censor censored fu followup", DATETIME_TO, 0.50),
)


@dataclass(frozen=True)
class Reading:
    """What a name says: the best type (None if nothing matches), its score, and all scores."""

    type: str | None
    score: float
    tokens: list[str]
    normalized: str
    matched: list[str] = field(default_factory=list)
    scores: dict[str, float] = field(default_factory=dict)


def normalized(name) -> str:
    """Lower-case words joined by underscores; capitals and other characters separate words."""
    text = re.sub(r"\W+", "_", str(name).strip())
    text = re.sub(r"(?<=[a-z0-9])(?=[A-Z])", "_", text)
    text = re.sub(r"(?<=[A-Z])(?=[A-Z][a-z])", "_", text)
    return "_".join(tokens_of(text.lower()))


def tokens_of(text: str) -> list[str]:
    return [t for t in text.split("_") if t]


def tokens(name) -> list[str]:
    return tokens_of(normalized(name))


def _read(name, words, pairs) -> Reading:
    plain = normalized(name)
    own, scores, matched = set(tokens_of(plain)), {}, []
    for kind, keywords, score in words:
        if hit := sorted(own & set(keywords.split())):
            scores[kind] = scores.get(kind, 0.0) + score
            matched.append(f"{kind}: {' '.join(hit)}")
    for left, right, kind, score in pairs:
        if own & set(left.split()) and own & set(right.split()):
            scores[kind] = scores.get(kind, 0.0) + score
            matched.append(f"{kind}: pair")
    best = max(scores, key=scores.get) if scores else None  # of equals the one scored first
    return Reading(best, scores.get(best, 0.0), tokens_of(plain), plain, matched, scores)


def semantic_type(name) -> Reading:
    return _read(name, TYPE_WORDS, TYPE_PAIRS)


def survival_role(name) -> Reading:
    return _read(name, ROLE_WORDS, ROLE_PAIRS)


def names_date(name) -> bool:
    return re.search(DATETIME_PATTERN, normalized(name)) is not None


def names_identifier(name) -> bool:
    return re.search(IDENTIFIER_PATTERN, normalized(name)) is not None


def sanitized(text: str) -> str:
    """Each character that is neither letter nor digit becomes an underscore."""
    return "".join(c if c.isalnum() else "_" for c in text)


def label(text) -> str:
    """A label to match by: compatibility form, straight quotes, single spaces."""
    plain = unicodedata.normalize("NFKC", str(text)).translate({0x2018: "'", 0x2019: "'", 0x201C: '"', 0x201D: '"'})
    return " ".join(plain.split())
