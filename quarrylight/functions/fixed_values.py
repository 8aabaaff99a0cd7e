"""Values that results depend on: word lists, lookup tables, thresholds.

Everything in this module is a fixed value; nothing here is logic.
"""

# File suffixes that never lead to a page worth crawling.
ASSET_SUFFIXES = (
    ".jpg", ".jpeg", ".png", ".gif", ".webp", ".svg", ".ico", ".pdf",
    ".zip", ".xml", ".css", ".js", ".json", ".woff", ".woff2", ".ttf",
)

# Path segments that are not followed during discovery.
BLOCKED_PATH_TOKENS = (
    "wp-admin", "wp-json", "feed", "cart", "checkout", "my-account", "privacy-policy",
    "terms", "cookie-policy", "login", "register", "author", "tag",
)

# URL fragments that lower or raise the page quality score.
LISTING_URL_PARTS = ("/category/", "/tag/", "/author/", "/blog/best-", "/product-category/")
DETAIL_URL_PARTS = ("/program", "/template", "/how-to-", "/shop/")

# URL fragments of program pages.
PROGRAM_URL_PARTS = ("/program", "program-", "-program", "bundle", "template")

# Ordered substring -> label tables (first match wins).
SPECIALIZATION = (
    ("bench", "bench"),
    ("squat", "squat"),
    ("deadlift", "deadlift"),
    ("powerlift", "powerlifting"),
    ("hypertrophy", "hypertrophy"),
    ("strength", "strength"),
    ("general", "general"),
)
EXPERIENCE_LEVEL = (
    ("beginner", "beginner"),
    ("novice", "beginner"),
    ("intermediate", "intermediate"),
    ("advanced", "advanced"),
    ("expert", "advanced"),
)
PROGRESSION_TYPE = (
    ("linear", "linear"),
    ("undulat", "undulating"),
    ("wave", "undulating"),
    ("autoreg", "autoregulated"),
    ("rpe", "autoregulated"),
    ("block", "block"),
    ("conjugate", "conjugate"),
)
SPLIT_TYPE = (
    ("full body", "full-body"),
    ("full-body", "full-body"),
    ("upper lower", "upper-lower"),
    ("upper-lower", "upper-lower"),
    ("push pull legs", "push-pull-legs"),
    ("push-pull-legs", "push-pull-legs"),
    ("body part", "body-part"),
    ("body-part", "body-part"),
)

# Phrases an extraction tool writes about itself.
META_TEXT_PHRASES = (
    "the extracted data",
    "i have extracted",
    "saved to a json file",
    "file path:",
    "json includes",
    "complete data has been saved",
    "summary:",
)

# Alternative payload keys, in order of preference.
TITLE_KEYS = ("title", "page_title", "headline", "name")
AUTHOR_KEYS = ("author", "byline")
SOURCE_TYPE_KEYS = ("source_type", "type")
TEXT_KEYS = ("text", "raw_text", "content", "main_text", "body", "markdown")
SUMMARY_KEYS = ("summary", "description", "excerpt")
HTML_KEYS = ("raw_html", "html", "page_html")
PROGRAM_NAME_KEYS = ("name", "program_name", "title")
PROGRAM_COACH_KEYS = ("coach_name", "coach", "author")
PROGRAM_SUMMARY_KEYS = ("summary", "description")
SPECIALIZATION_KEYS = ("specialization", "focus")
EXPERIENCE_KEYS = ("experience_level", "experience")
PROGRESSION_KEYS = ("progression_type", "progression")
SPLIT_KEYS = ("split_type", "split")
CLAIM_TYPE_KEYS = ("claim_type", "type")
CLAIM_TEXT_KEYS = ("raw_text", "text", "claim")
CLAIM_VALUE_KEYS = ("normalized_value", "normalized")
URL_LIST_KEYS = ("urls", "candidate_urls", "links")

# Query expansion by phrase and by single token.
PHRASE_EXPANSIONS = (
    ("bench press", ("bench", "bench press")),
    ("bench-focused", ("bench", "bench press")),
    ("powerlifting", ("powerlifting", "powerlift")),
    ("powerbuilding", ("powerbuilding", "powerbuild", "strength", "hypertrophy")),
    ("hypertrophy", ("hypertrophy", "bodybuilding", "muscle")),
    ("bodybuilding", ("bodybuilding", "hypertrophy", "muscle")),
    ("meet prep", ("meet", "competition", "peaking", "powerlifting")),
    ("first meet", ("meet", "competition", "novice", "beginner", "powerlifting")),
    ("rehabilitation", ("rehab", "return", "injury")),
    ("injury", ("injury", "rehab", "return")),
    ("limited time", ("time", "minimal", "efficient", "low volume")),
    ("minimum effective dose", ("minimal", "minimum", "low volume", "efficient")),
    ("home gym", ("home", "equipment", "gym")),
    ("full body", ("full-body", "full body")),
    ("upper lower", ("upper-lower", "upper lower")),
    ("post novice", ("intermediate", "novice")),
)
TOKEN_EXPANSIONS = (
    ("novice", ("novice", "beginner")),
    ("beginner", ("beginner", "novice")),
    ("intermediate", ("intermediate", "post-novice")),
    ("advanced", ("advanced", "experienced")),
    ("squat", ("squat", "squatting")),
    ("deadlift", ("deadlift", "deadlifting")),
    ("peaking", ("peaking", "competition", "meet")),
)
DAY_WORDS = (("two", 2), ("three", 3), ("four", 4), ("five", 5), ("six", 6))
EMPTY_EXPANSION_QUERY = "program"

# Ordered error-message rules (code, message fragments).
ERROR_RULES = (
    ("blocked_active_crawl", ("already has active crawl",)),
    ("dns_resolution_failed", ("nodename nor servname provided", "failed to resolve host")),
    ("rate_limited", ("429", "rate limit", "too many requests")),
    ("auth_failed", ("401", "unauthorized", "invalid api key")),
    ("timeout", ("did not complete within", "timeout")),
    ("schema_invalid", ("schema_invalid",)),
    ("low_quality_output", ("low_quality_output",)),
    ("no_programs_on_program_page", ("no_programs_on_program_page",)),
    ("source_not_found", ("source not found",)),
    ("event_loop_closed", ("event loop is closed",)),
    ("value_too_long", ("stringdatarighttruncation", "value too long for type character varying")),
    ("unique_violation", ("unique constraint", "duplicate key value violates unique constraint")),
    ("not_null_violation", ("not null violation",)),
    ("fk_violation", ("foreign key constraint", "violates foreign key")),
    ("config_missing_browser_use_api_key", ("_browser_use_api_key is required",)),
    ("config_missing_database_url", ("_database_url is required",)),
)
TIMEOUT_ERROR_TYPES = ("TimeoutError",)
RETRYABLE_ERROR_TYPES = ("TimeoutError", "ConnectionError", "gaierror", "HTTPError")
RETRYABLE_CODES = ("timeout", "retryable_browser_use", "dns_resolution_failed", "rate_limited")

# English stop words of the Snowball project.
STOP_WORDS = (
    "i me my myself we our ours ourselves you your yours yourself yourselves he him his himself "
    "she her hers herself it its itself they them their theirs themselves what which who whom this "
    "that these those am is are was were be been being have has had having do does did doing a an "
    "the and but if or because as until while of at by for with about against between into through "
    "during before after above below to from up down in out on off over under again further then "
    "once here there when where why how all any both each few more most other some such no nor not "
    "only own same so than too very s t can will just don should now"
).split()

# Manual error-analysis categories.
ERROR_CATEGORIES = (
    "experience_level_mismatch",
    "frequency_mismatch",
    "goal_mismatch",
    "lexical_without_semantic_match",
    "multiple_constraints_not_satisfied",
    "important_metadata_ignored",
    "redundant_results",
    "partially_relevant_misranked",
    "other",
)
DATASET_STATUSES = ("draft", "frozen")
CANDIDATE_COLLECTIONS = ("program", "source_evidence")

# Label reasons and candidate origins.
HUMAN_REASON = "human_authoritative_v1"
TEACHER_REASON = "teacher_distilled_v1"
HARD_CANDIDATE = "retriever_hard_candidate"
RANDOM_NEGATIVE = "random_negative"

# Service and job defaults.
SHORT_TEXT_LIMIT = 64
SENTENCE_LIMIT = 220
META_SAMPLE = 800
SNIPPET_CHARS = 220
SNIPPET_LEAD = 70
PROGRAM_TEXT_LIMIT = 4000
EVIDENCE_TEXT_LIMIT = 6000
MAX_CANDIDATES = 200
RERANK_DEPTH = 50
MAX_RERANK_DEPTH = 200
PER_DOMAIN_LIMIT = 10
REEXTRACT_LIMIT = 25
GLOBAL_LIMIT = 50
FAILURE_RATE_THRESHOLD = 0.35
RECENT_WINDOW = 20
STALE_AFTER_DAYS = 14
MAX_RETRIES = 2
ASK_LIFETIME_LIMIT = 5
RATE_WINDOW_SECONDS = 60
USER_RATE_MAX = 20
IP_RATE_MAX = 30

# Answer and status texts.
INSUFFICIENT_TEXT = "Insufficient evidence in indexed corpus for this query."

# Suffixes of the published stemmer and what takes their place, by step.
STEM_PLURALS = (("sses", "ss"), ("ies", "i"), ("ss", "ss"), ("s", ""))
STEM_DOUBLE_SUFFIXES = (
    ("ational", "ate"), ("tional", "tion"), ("enci", "ence"), ("anci", "ance"), ("izer", "ize"), ("abli", "able"), ("alli", "al"),
    ("entli", "ent"), ("eli", "e"), ("ousli", "ous"), ("ization", "ize"), ("ation", "ate"), ("ator", "ate"), ("alism", "al"),
    ("iveness", "ive"), ("fulness", "ful"), ("ousness", "ous"), ("aliti", "al"), ("iviti", "ive"), ("biliti", "ble"),
)
STEM_SUFFIXES = (("icate", "ic"), ("ative", ""), ("alize", "al"), ("iciti", "ic"), ("ical", "ic"), ("ful", ""), ("ness", ""))
STEM_ENDINGS = (
    "al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "ion", "ou", "ism", "ate", "iti", "ous", "ive", "ize",
)
