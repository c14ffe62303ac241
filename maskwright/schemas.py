"""Explicit schemas of the row kinds that cross file boundaries."""



EXAMPLE = "id STRING, text STRING, words ARRAY<STRING>, labels ARRAY<INT>, task_label STRING, source STRING"
PREPARED = (
    "id STRING, text STRING, words ARRAY<STRING>, task_label STRING, source STRING, source_split STRING, "
    "desired_split STRING, policy_version STRING, dataset_name STRING, sentence1 STRING, sentence2 STRING, "
    "pair_id STRING, text_a STRING, text_b STRING"
)
ANNOTATION = "id STRING, labels ARRAY<INT>, types ARRAY<STRING>, selected_words ARRAY<STRING>, source STRING"
RULE_ROW = EXAMPLE + (
    ", dataset_name STRING, teacher_policy STRING, rule_manifest STRUCT<version: STRING, masker: STRING, "
    "code_sha256: STRING, task: STRING, max_length: INT>"
)
_TARGET = "STRUCT<start: INT, end: INT>"
PAIR = (
    "id STRING, pair_id STRING, source_id STRING, dataset_name STRING, teacher_policy STRING, noise_type STRING, "
    "noise_group STRING, clean_text STRING, clean_words ARRAY<STRING>, clean_labels ARRAY<INT>, "
    f"clean_target {_TARGET}, clean_target_words ARRAY<INT>, text STRING, words ARRAY<STRING>, labels ARRAY<INT>, "
    f"noisy_target {_TARGET}, target_words ARRAY<INT>, edit MAP<STRING, STRING>"
)
PREDICTION = "pair_id STRING, labels ARRAY<INT>"
REQUEST = "id STRING, text STRING, words ARRAY<STRING>, task_label STRING, system_prompt STRING, user_prompt STRING"
# labels is read as text so that a wrong element type can be told apart from a missing field
RESPONSE = "id STRING, model STRING, labels STRING, response STRING, output STRING, content STRING"
REVIEW = (
    "id STRING, text STRING, words ARRAY<STRING>, task_label STRING, candidates MAP<STRING, STRUCT<labels: ARRAY<INT>, "
    "types: ARRAY<STRING>, selected_words: ARRAY<STRING>>>, candidate_disagreement BOOLEAN, human_labels ARRAY<INT>, "
    "human_types ARRAY<STRING>, human_reviewed BOOLEAN, human_review_reason STRING"
)
ENTITY_SPAN = "id STRING, start INT, end INT, type STRING, span_order INT, surface STRING"
TEMPORAL_CANDIDATE = (
    "id STRING, source_id STRING, text STRING, task_label STRING, source STRING, source_split STRING, "
    f"temporal_defect STRING, introduced_in STRING, target {_TARGET}, target_text STRING"
)
