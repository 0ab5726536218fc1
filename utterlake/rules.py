"""Rule tables and limits of the jobs. Texts that belong to an installation are inputs."""

from __future__ import annotations

import json
from dataclasses import dataclass, field, fields
from pathlib import Path

# Column aliases of external files, in order of preference.
TEXT_ALIASES = ["text", "query", "question", "utterance"]
INTENT_ALIASES = ["intent", "label", "category", "class"]
RESPONSE_ALIASES = ["response", "answer", "reply"]

# Defaults of optional columns.
DEFAULT_LANGUAGE = "en"
DEFAULT_CHANNEL = "mobile"
REGIONAL_SOURCE = "regional_aug"
UNKNOWN_SOURCE = "unknown"
SEED_SOURCE = "synthetic_seed"

# Words that a focus phrase leaves out, and the phrase of an empty text.
STOP_WORDS = [
    "please", "help", "with", "from", "that", "this", "your", "what", "when",
    "where", "which", "need", "want", "about", "still", "now", "how", "can",
]
NO_FOCUS = "your request"

# Keywords and source of the regional focus filter.
FOCUS_KEYWORDS = [
    "cambodia", "phnom penh", "siem reap", "battambang", "kampot", "khqr", "bakong", "aba",
    "acleda", "wing", "riel", "khmer", "knyom", "ban te", "ot ban",
]
FOCUS_SOURCE = "asia_custom"
FOCUS_FORMAT = "cambodia {words} in phnom penh sample_{number}"
FOCUS_SEED_SOURCE = "synthetic_seed_cambodia"

# Sources whose composed answers always have three sentences.
FULL_LENGTH_SOURCES = ["asia_custom", "regional_aug", "synthetic_seed"]

# Core intents and the source labels they take; the last listing of a label wins.
TAXONOMY = {
    "balance_inquiry": [
        "beneficiary_not_verified", "beneficiary_not_allowed",
        "balance_not_updated_after_cheque_or_bank_transfer",
    ],
    "fund_transfer": [
        "beneficiary_not_allowed", "beneficiary_not_verified", "wrong_bank_transfer",
        "pending_bank_transfer", "transfer_not_received_by_recipient", "declined_transfer",
    ],
    "fraud_report": ["cash_withdrawal_not_recognised", "card_payment_not_recognised"],
    "card_issue": [
        "card_not_working", "card_not_received", "card_arrival", "cash_withdrawal_card",
        "beneficiary_not_allowed",
    ],
    "transaction_status": [
        "pending_bank_transfer", "declined_transfer", "transfer_not_received_by_recipient",
        "card_payment_reverted", "cash_withdrawal", "beneficiary_not_allowed",
    ],
    "fee_inquiry": ["cash_withdrawal_charge", "card_payment_fee_charged", "exchange_fee"],
    "cash_withdrawal": ["cash_withdrawal", "cash_withdrawal_not_recognised", "cash_withdrawal_charge"],
    "wallet_topup": [
        "top_up_by_bank_card", "top_up_by_bank_card_pending", "top_up_by_bank_card_declined",
    ],
}

# Gates of the answer ladders, split shares, seed and classifier smoothing.
CONFIDENCE_GATE = 0.40
SIMILARITY_GATE = 0.60
SIMILARITY_FLOOR = 0.10
EVAL_SHARE = 0.2
CORPUS_EVAL_SHARE = 0.1
SEED = 42
MIN_PER_INTENT = 40
MIN_TEXT_LENGTH = 2
NB_ALPHA = 0.5
MODEL_ORDER = ["logreg", "naive_bayes", "svm"]
STOP_MESSAGES = ["exit", "quit"]
LOW_CONFIDENCE_MARK = "N/A (confidence too low)"


@dataclass
class Rules:
    """Texts and tables an installation supplies. ``templates`` is also the list of known intents."""

    templates: dict[str, str] = field(default_factory=dict)
    default_response: str = "Please contact support for this request."
    variants: dict[str, list[str]] = field(default_factory=dict)
    patterns: dict[str, list[str]] = field(default_factory=dict)
    follow_ups: list[str] = field(default_factory=list)
    regionals: list[str] = field(default_factory=list)
    generic: dict[str, str] = field(default_factory=dict)
    no_information: str = "Nothing is known about this yet. Please rephrase the question."
    clarification: str = "The question is not clear. Please rephrase it or add details."
    taxonomy: dict[str, list[str]] = field(default_factory=lambda: dict(TAXONOMY))
    keywords: list[str] = field(default_factory=lambda: list(FOCUS_KEYWORDS))
    focus_source: str = FOCUS_SOURCE
    focus_format: str = FOCUS_FORMAT
    focus_seed_source: str = FOCUS_SEED_SOURCE
    stop_words: list[str] = field(default_factory=lambda: list(STOP_WORDS))
    full_length_sources: list[str] = field(default_factory=lambda: list(FULL_LENGTH_SOURCES))
    routes: list[dict] = field(default_factory=list)

    @classmethod
    def from_json(cls, path: str) -> Rules:
        """Rules from one JSON document; keys that are left out keep their defaults."""
        given = json.loads(Path(path).read_text(encoding="utf-8"))
        known = {f.name for f in fields(cls)}
        extra = sorted(set(given) - known)
        if extra:
            raise ValueError(f"unknown rule names: {extra}")
        return cls(**given)
