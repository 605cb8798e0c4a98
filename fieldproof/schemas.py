"""Table shapes, as DDL."""

FIELD = "struct<value: string, evidence_text: string, page: int, bbox: array<double>>"
SEGMENT = "struct<text: string, bbox: array<double>, role: string, field: string>"
PARSED = f"struct<json_valid: boolean, schema_valid: boolean, error: string, fields: array<{FIELD}>>"
META = (
    "line_of_business string, `group` string, gender string, handwritten boolean, quality string, skew_deg double, "
    "date_format string, amount_format string, set_id string, generator_version string"
)

MANIFEST = f"doc_id string, doc_type string, image string, label string, {META}"
LABEL = (
    "doc_id string, doc_type string, width int, height int, image string, "
    f"fields struct<claim_number: {FIELD}, policy_number: {FIELD}, claimant_name: {FIELD}, date_of_loss: {FIELD}, "
    f"provider_name: {FIELD}, incident_type: {FIELD}, total_amount: {FIELD}>, layout array<{SEGMENT}>, "
    "meta struct<line_of_business: string, `group`: string, gender: string, handwritten: boolean, quality: string, "
    "skew_deg: double, date_format: string, amount_format: string, set_id: string, generator_version: string>"
)
AUDIT = (
    "run_id string, doc_id string, split string, image_sha256 string, dataset_hash string, model_id string, "
    "model_revision string, prompt_version string, prompt_hash string, code_version string, raw_output string, "
    "latency_ms double, input_tokens bigint, output_tokens bigint, timestamp_utc string, prev_hash string, record_hash string"
)
RUN_CONFIG = (
    "run_id string, model_id string, model_revision string, prompt_version string, prompt_hash string, decoding string, "
    "data_dir string, split string, dataset_hash string, n_docs int, code_version string, started_utc string"
)
RUN_METRICS = (
    "run_id string, model string, split string, evaluator_version string, field_accuracy double, grounded_accuracy double, "
    "hallucination_rate double, miss_rate double, doc_exact_match double, mean_reward double, latency_ms_p50 double, "
    "counterfactual_sets int, counterfactual_consistency double"
)
TRAINING_CARD = (
    "adapter_name string, adapter_sha256 string, mode string, base_model string, base_revision string, "
    "parent_adapter struct<name: string, sha256: string>, quick_test boolean, training struct<quick_test: boolean>"
)
STEP_HISTORY = (
    "step int, doc_id string, reward_mean double, reward_std double, rewards array<double>, null_fields_mean double, "
    "box_area_mean double, answer_tokens_mean double, kl double, note string, minutes double"
)
