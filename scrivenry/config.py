"""Named limits and thresholds. Those marked "ours" are not documented anywhere and are choices."""

VIEW_VERSION = 6
CHUNK_CHARS = 4000
OVERLAP_CHARS = 200
MAX_CONCEPTS = 12
MAX_TARGETED = 8
MAX_REPORT_ROWS = 20
MAX_IN_SPAN = 5
EXCERPT_CHARS = 300  # ours
LOW_TEXT_CHARS = 200  # ours
DOMINANCE = 0.5  # ours: share of candidates that may be source entities
NOISE_SYMBOL_SHARE = 0.05  # ours
TABLE_DIGIT_SHARE = 0.5  # ours
MAX_OUTPUT_TOKENS = 1024  # for providers that talk to a model
TIMEOUT_S = 300
KEEP_ALIVE_MAX_S = 3600
LOOPBACK = ("localhost", "127.0.0.1", "[::1]", "::1")

# Fixed values that results depend on.
WRAPPERS = ("architecture", "framework", "system", "mechanism", "method", "approach")
ROOT_WORDS = ("method", "methods", "methodology", "approach", "architecture")
ROOT_EXCLUDED = ("related", "existing", "prior", "previous", "other", "alternative", "experiment", "evaluation")
SUBSECTION_EXCLUDED = (
    "experiment", "dataset", "evaluation", "implementation", "result", "ablation", "analysis", "hyperparameter",
)
WARNINGS = ("reading_order", "table_layout", "formula_layout", "word_joining", "rotated_text")
NOTE_TYPES = (
    "source", "concept", "project", "area", "decision", "idea", "question", "daily", "meeting", "person", "report",
    "template", "index",
)  # the first seven are documented; the rest are ours
ORIGINS = ("external", "me", "ai")
STATUSES = ("raw", "processed", "understood", "applied", "archived")  # the last is ours
COVERING_ROLES = ("mechanism", "component")
GENERIC_TITLES = ("method", "model", "system", "framework", "approach", "results", "introduction")  # ours
EXTRA_SUFFIX = "... (+{n} more)"
OMISSION = "> [... omitted from AI extraction"
WIKI_DIR = "Library/Concepts"  # the only folder that machines write to; name is ours
EXITS = {"ok": 0, "unexpected": 2, "ocr": 3, "llm": 4, "technical": 5, "quality": 6}
