"""Fixed values.

Everything in this module is a word list, look-up table, pattern, text template
or limit whose exact value decides the result, so it is stated as plain text.
"""

# Category domain; the position in the list is the class index.
CATEGORIES = ["bug", "style", "performance", "security", "ok"]

# Order in which the weak labeller tries the categories.
WEAK_LABEL_PRIORITY = ["security", "bug", "performance", "style"]

# Order of the rows in the findings summary.
SUMMARY_ORDER = ["bug", "security", "performance", "style"]

# Weak-label patterns, matched against the lower-cased explanation.
WEAK_LABEL_PATTERNS = {
    "security": [
        r"\bsecurity\b", r"\bvulnerab\w*\b", r"\binjection\b", r"\bsanitiz\w*\b",
        r"\bauth\w*\b", r"\bcredential\w*\b", r"\bpassword\b", r"\btoken\b",
        r"\bexploit\b", r"\bunsafe\b", r"\bcve\b", r"\bxss\b",
    ],
    "bug": [
        r"\bbug\b", r"\bfix(?:es|ed)?\b", r"\berror\b", r"\bcrash\w*\b",
        r"\bfail\w*\b", r"\bincorrect\b", r"\bwrong\b", r"\bbroken\b",
        r"\bnull\b", r"\bundefined\b", r"\bedge case\b", r"\boff[- ]by[- ]one\b",
        r"\bregression\b", r"\bdoes not (?:work|handle)\b",
    ],
    "performance": [
        r"\bperformance\b", r"\bslow\b", r"\befficien\w*\b", r"\boptimiz\w*\b",
        r"\bmemory leak\b", r"\blatency\b", r"\bbottleneck\b", r"\bredundant\b",
        r"\bcomplexity\b", r"\bo\(n", r"\bcache\b", r"\bthroughput\b",
    ],
    "style": [
        r"\bstyle\b", r"\bnaming\b", r"\bconvention\w*\b", r"\breadab\w*\b",
        r"\bformat\w*\b", r"\btypo\b", r"\bdocstring\b", r"\bcomment\w*\b",
        r"\blint\w*\b", r"\bconsisten\w*\b", r"\bclean\s?up\b",
    ],
}

# Heuristic keywords, matched as substrings of the lower-cased chunk.
HEURISTIC_KEYWORDS = {
    "bug": [
        "null", "none", "undefined", "except", "error", "fail",
        "index", "overflow", "divide", "zero", "nan", "inf",
        "off by", "wrong", "incorrect", "broken",
    ],
    "security": [
        "password", "secret", "token", "api_key", "eval(",
        "exec(", "shell", "subprocess", "sql", "inject",
        "sanitize", "escape", "hash", "encrypt", "auth",
        "hardcoded", "plaintext",
    ],
    "performance": [
        "for loop", "nested", "o(n", "sleep", "wait", "block",
        "global", "cache", "memory", "leak", "redundant",
        "duplicate", "inefficient", "slow", "recompute",
        "n+1", "query inside loop",
    ],
    "style": [
        "naming", "comment", "docstring", "magic number",
        "long line", "unused", "import", "whitespace",
        "camel", "snake", "consistent", "readable",
    ],
}

# Language by lower-cased file extension.
LANGUAGE_BY_EXTENSION = {
    "py": "Python",
    "js": "JavaScript",
    "ts": "TypeScript",
    "java": "Java",
    "cpp": "C++",
    "c": "C",
    "go": "Go",
    "rs": "Rust",
    "rb": "Ruby",
    "cs": "C#",
    "php": "PHP",
    "kt": "Kotlin",
    "swift": "Swift",
    "sh": "Shell",
    "sql": "SQL",
    "html": "HTML",
    "css": "CSS",
}
UNKNOWN_LANGUAGE = "Unknown"

# Address pattern of a pull request: owner, repository, number.
PR_URL_PATTERN = r"github\.com/([^/]+)/([^/]+)/pull/(\d+)"

# Prompt sent to the judge; {code} is the only placeholder.
JUDGE_PROMPT = """You are an expert code reviewer. Classify this code diff into EXACTLY ONE of these 5 categories based on what it primarily represents:

- bug: Fixes incorrect logic, crashes, null/undefined handling, edge cases, off-by-one errors, or any code that was producing wrong behavior
- security: Addresses vulnerabilities, injection risks, unsafe authentication, hardcoded credentials, unsanitized input, or other security weaknesses
- performance: Improves speed, reduces memory usage, removes redundant computation, optimizes loops/algorithms, or addresses scalability
- style: Improves naming, formatting, readability, comments, documentation, or code organization without changing behavior
- ok: The diff has no significant issues - it's a clean addition/change with nothing notably wrong (new feature, routine update, etc.)

Respond in EXACTLY this format, nothing else, no explanation:
LABEL: <category>
CONFIDENCE: <high/medium/low>

If the diff doesn't clearly fit one category, pick the closest match and mark confidence as low.

Here is the diff:

{code}
"""

# Prompt sent for a review comment; placeholders {category} and {chunk}.
FEEDBACK_PROMPT = """You are a code reviewer. Analyse this code and give ONE specific,
                    concise review comment focused on {category} issues.
                    Be direct and actionable. Max 2 sentences.

        Code:
        {chunk}

        Review comment:"""

# Alternative feedback prompts, one opening per category, followed by the chunk.
CATEGORY_PROMPTS = {
    "bug": "Review this code and identify potential bugs, off-by-one errors, null pointer issues, or incorrect logic:\n\n",
    "security": "Review this code for security vulnerabilities such as hardcoded credentials, injection risks, or insecure patterns:\n\n",
    "performance": "Review this code for performance issues such as inefficient loops, redundant computations, or memory problems:\n\n",
    "style": "Review this code for style and readability issues such as naming conventions, missing docstrings, or magic numbers:\n\n",
    "ok": "Briefly confirm this code looks clean and note anything worth keeping:\n\n",
}

# Display name of a category.
DISPLAY_NAMES = {
    "bug": "Bug",
    "security": "Security",
    "performance": "Performance",
    "style": "Style",
    "ok": "Clean",
}

# Sentinels and defaults.
APPROVED = "APPROVE"
PARSE_FAILED = "PARSE_FAILED"
NO_CONFIDENCE = "none"
UNKNOWN_CONFIDENCE = "unknown"
DEFAULT_WEAK_LABEL = "bug"
PASTED_CODE = "pasted_code"

# Limits.
MAX_CHUNK_LINES = 30
MAX_PATCH_CHARS = 2000
MAX_JUDGE_CHARS = 1500
MAX_TOKENS = 512
MAX_ATTEMPTS = 3
PREVIEW_CHARS = 200
FILE_LIST_CHARS = 28
N_FOLDS = 5
FOLD_SEED = 42
EMBEDDING_SIZE = 768

# Cells a CSV reader of the pandas family takes for a missing value.
NA_TOKENS = [
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan",
    "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None",
    "n/a", "nan", "null",
]
