"""Values that results depend on."""

# Field names in schema order, and the descriptions that prompts carry.
FIELD_DESCRIPTIONS = {
    "claim_number": "The insurer's claim number (e.g. CLM-2025-004817). Not an invoice number.",
    "policy_number": "The insurance policy number.",
    "claimant_name": "Full name of the claimant / policyholder / patient being billed.",
    "date_of_loss": "Date of the incident, or the date of service on an invoice. Not a date of birth, report date or invoice date.",
    "provider_name": "Name of the repair shop, contractor or clinic providing the service.",
    "incident_type": "Type of incident as written on a claim form (e.g. 'Auto collision').",
    "total_amount": "Final total amount claimed or billed (after tax). Not a subtotal or line item.",
}
FIELDS = tuple(FIELD_DESCRIPTIONS)
REQUIRED_FIELDS = ("claimant_name", "date_of_loss", "total_amount")

#: How a field's values are brought to a common form.
KIND_OF_FIELD = {"date_of_loss": "date", "total_amount": "amount", "claim_number": "id", "policy_number": "id"}

# Versions, thresholds and weights.
EVALUATOR_VERSION = "1.1"
FIRST_EVALUATOR_VERSION = "1.0"
GENERATOR_VERSION = "1.0"
PROMPT_VERSION = "v2"
IOU_THRESHOLD = 0.5
NEAR_MISS = 0.8
REWARD_WEIGHTS = {"format": 0.1, "accuracy": 0.6, "grounding": 0.3}
DEFAULT_COSTS = {"correct": 1.0, "correct_null": 1.0, "miss": -0.5, "wrong": -1.0, "hallucination": -1.0, "invalid": -1.0}
GROUNDING_SHARE = 0.5
SCHEMA_NUDGE = 0.1
GENESIS = "0" * 64
PAGE_WIDTH, PAGE_HEIGHT = 980, 1260

# Error types, and the release gate's (split, metric, higher is better, slack).
ERROR_TYPES = (
    "correct", "correct_null", "missed", "hallucinated", "distractor_for_absent", "distractor_confusion",
    "field_swap", "diacritics", "near_miss", "wrong_value", "unparseable",
)
GATE = (
    ("test", "field_accuracy", True, 0.005),
    ("test", "grounded_accuracy", True, 0.01),
    ("test", "hallucination_rate", False, 0.005),
    ("holdout", "field_accuracy", True, 0.01),
    ("holdout", "grounded_accuracy", True, 0.02),
    ("holdout", "hallucination_rate", False, 0.01),
)

# The comparison's metrics (key, title, higher is better).
HEADLINE = (
    ("json_valid_rate", "Valid JSON", True),
    ("field_accuracy", "Field accuracy", True),
    ("grounded_accuracy", "Grounded accuracy", True),
    ("evidence_supported_rate", "Evidence supported", True),
    ("hallucination_rate", "Hallucination rate", False),
    ("miss_rate", "Miss rate", False),
    ("doc_exact_match", "Document exact match", True),
    ("mean_reward", "Mean reward", True),
)
REGISTRY_METRICS = ("field_accuracy", "grounded_accuracy", "hallucination_rate", "miss_rate", "doc_exact_match", "mean_reward", "latency_ms_p50")
