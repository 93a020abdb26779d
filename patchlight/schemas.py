"""Declared schemas of every input and output table, in the DDL form Spark reads."""

PR_FILES = "pr_url string, filename string, patch string, additions int, deletions int"

# One stored reply of the code host: the JSON array of changed files of a review.
PR_BODIES = "pr_url string, body string"

RAW_CODE = "review_key string, code string, filename string"

REVIEW_EXAMPLES = "explanation string, label string, patch string, repo string, pr_number bigint"

TRAINING_DATA = "code string, label string, original_label string, repo string, pr_number bigint"

LABELLED_DATA = (
    "key string, code string, label string, original_label string, repo string, "
    "pr_number bigint, judge_label string, judge_confidence string"
)

REPLIES = "key string, response_text string, error string, attempts int"

PREDICTIONS = "key string, fold int, label string, prediction string"

FINDINGS = (
    "review_key string, filename string, language string, additions int, deletions int, "
    "chunk_index int, chunk string, category string, confidence double, feedback string"
)
