"""Fixed values of the search and graph operators: word lists, patterns, lookup tables, constants."""

from __future__ import annotations

import unicodedata

# File patterns and excluded folders of a source.
DEFAULT_PATTERNS = [
    "*.md", "*.txt", "*.rst", "*.go", "*.py", "*.js", "*.ts", "*.java", "*.rs", "*.rb", "*.c", "*.cpp", "*.h", "*.hpp", "*.cs", "*.swift", "*.kt",
    "*.sh", "*.bash", "*.zsh", "*.fish", "*.ps1", "*.bat", "*.cmd", "*.json", "*.yaml", "*.yml", "*.xml", "*.jsonld", "*.toml", "*.ini", "*.cfg",
    "*.csv", "*.tsv", "*.pdf", "*.doc", "*.docx", "*.odt", "*.rtf",
]
DEFAULT_EXCLUDES = ["node_modules", ".git", ".svn", ".hg", "__pycache__", ".pytest_cache", "vendor", "dist", "build", "target", ".DS_Store", "Thumbs.db"]

# MIME types by extension.
MIME_TYPES = {
    ".md": "text/markdown", ".txt": "text/plain", ".rst": "text/x-rst",
    ".go": "text/x-go", ".py": "text/x-python", ".js": "text/javascript", ".ts": "text/typescript", ".java": "text/x-java", ".rs": "text/x-rust",
    ".rb": "text/x-ruby", ".c": "text/x-c", ".cpp": "text/x-c++", ".h": "text/x-c", ".hpp": "text/x-c++", ".cs": "text/x-csharp", ".swift": "text/x-swift",
    ".kt": "text/x-kotlin", ".sh": "text/x-shellscript", ".bash": "text/x-shellscript", ".zsh": "text/x-shellscript", ".fish": "text/x-shellscript",
    ".ps1": "text/x-powershell", ".bat": "text/x-batch", ".cmd": "text/x-batch",
    ".json": "application/json", ".jsonld": "application/ld+json", ".yaml": "text/x-yaml", ".yml": "text/x-yaml", ".xml": "application/xml",
    ".toml": "text/x-toml", ".ini": "text/x-ini", ".cfg": "text/x-ini", ".csv": "text/csv", ".tsv": "text/tab-separated-values",
    ".pdf": "application/pdf", ".doc": "application/msword", ".docx": "application/vnd.openxmlformats-officedocument.wordprocessingml.document",
    ".odt": "application/vnd.oasis.opendocument.text", ".rtf": "application/rtf",
}

# Extensions by kind of content.
CODE_EXTENSIONS = [".go", ".py", ".js", ".ts", ".java", ".rs", ".rb", ".c", ".cpp", ".h", ".hpp", ".cs", ".swift", ".kt", ".scala", ".php", ".sh", ".bash", ".zsh"]
MARKDOWN_EXTENSIONS = [".md", ".markdown", ".rst"]

# Boilerplate of documents, each replaced by a space. (?d) and \z keep Java's line rules as elsewhere.
BOILERPLATE = [
    r"(?i)this content downloaded from[ \t\n\f\r]+[\d\.]+.*?(?:UTC|GMT)",
    r"(?i)all use subject to.*?terms",
    r"(?i)jstor.*?conditions",
    r"(?i)downloaded from[ \t\n\f\r]+[^ \t\n\f\r]+[ \t\n\f\r]+on[ \t\n\f\r]+\w+,[ \t\n\f\r]+\d+[ \t\n\f\r]+\w+[ \t\n\f\r]+\d+",
    r"(?i)copyright[ \t\n\f\r]*©?[ \t\n\f\r]*\d{4}(?:[ \t\n\f\r]*-[ \t\n\f\r]*\d{4})?(?:[ \t\n\f\r]+[^.]+)?",
    r"(?i)all rights reserved\.?",
    r"(?i)©[ \t\n\f\r]*\d{4}",
    r"(?i)^[ \t\n\f\r]*page[ \t\n\f\r]+\d+[ \t\n\f\r]*(?:of[ \t\n\f\r]+\d+)?[ \t\n\f\r]*\z",
    r"(?m)^[ \t\n\f\r]*-[ \t\n\f\r]*\d+[ \t\n\f\r]*-[ \t\n\f\r]*$",
    r"(?i)^[ \t\n\f\r]*table of contents[ \t\n\f\r]*\z",
    r"\.{5,}",
    r"(?i)^[ \t\n\f\r]*\[?\d+\]?[ \t\n\f\r]*\z",
    r"(?m)^[-_=]{10,}[ \t\n\f\r]*$",
    r"(?i)click here to[ \t\n\f\r]+\w+",
    r"(?i)visit[ \t\n\f\r]+[^ \t\n\f\r]+[ \t\n\f\r]+for more",
    r"\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3}",
    r"\x00",
    r"(?i)^[ \t\n\f\r]*\d+[ \t\n\f\r]+of[ \t\n\f\r]+\d+[ \t\n\f\r]*\z",
]
# Boilerplate of results, each replaced by a space.
RESULT_BOILERPLATE = [
    r"(?i)^[ \t\n\f\r]*page[ \t\n\f\r]+\d+[ \t\n\f\r]*(of[ \t\n\f\r]+\d+)?[ \t\n\f\r]*\z",
    r"(?m)^[ \t\n\f\r]*\d+[ \t\n\f\r]*$",
    r"(?i)^[ \t\n\f\r]*table of contents[ \t\n\f\r]*\z",
    r"(?i)this content downloaded from[\s\S]*?terms and conditions",
    r"(?i)all rights reserved",
    r"(?i)copyright[ \t\n\f\r]*©?[ \t\n\f\r]*\d{4}",
    r"(?i)^[ \t\n\f\r]*\[?\d+\]?[ \t\n\f\r]*\z",
    r"(?i)all use subject to.*?terms",
    r"(?i)jstor.*?conditions",
    r"(?m)^[-_=]{10,}[ \t\n\f\r]*$",
    r"(\w)-[ \t\n\f\r]*\n[ \t\n\f\r]*(\w)",
]
# Misread words and their repairs.
OCR_WORDS = [
    ("staSs", "staffs"), ("aSect", "affect"), ("eSect", "effect"), ("eSorts", "efforts"), ("diSerent", "different"), ("diScult", "difficult"),
    ("ofSce", "office"), ("ofScial", "official"), ("Sourish", "flourish"), ("Sow", "flow"), ("Soor", "floor"), ("Sat", "flat"),
    ("Scal", "fiscal"), ("Snance", "finance"), ("Snancial", "financial"), ("Sgure", "figure"), ("Sle", "file"), ("Snd", "find"), ("Srst", "first"),
]
# Spacing and character repairs, after the words.
OCR_MARKS = [
    (r"[ \t\n\f\r]+([.,;:!?])", r"$1"), (r"([.,;:!?])(\w)", r"$1 $2"), (r"(?i)\brn\b", "m"), (r"\bl[ \t\n\f\r]+l\b", "ll"), (r"(?i)\bvv\b", "w"),
]

# Patterns that classify queries.
CONCEPTUAL = [r"(?i)^(how|why|what|when|where|who|which)\b", r"(?i)\b(explain|describe|understand|concept|meaning)\b", r"(?i)\b(difference|compare|versus|vs\.?)\b"]
FACTUAL = [r"\b\d{4}\b", r"(?i)\b(price|cost|revenue|amount|number)\b", r"(?i)\b(version|release|date|when was)\b", r"(?i)\b(how much|how many|percentage|ratio)\b"]
# Capitalised words that are no entities.
SKIP_WORDS = (
    "The A An In On At To For Of And Or But Is Are Was Were Be Been Being Have Has Had Do Does Did Will Would Could Should May Might Must Can "
    "What Where When Why How Who Which That This These Those I You He She It We They My Your"
).split()
# Words that graph queries leave out.
STOP_WORDS = (
    "a an and are as at be by for from has he in is it its of on or that the to was were will with this these those what which who whom how "
    "about into through during before after above below between under summary details information explain describe list show find get"
).split()
# Marks around words of entities and of diversification tokens.
WORD_MARKS = "\"'.,;:!?()[]{}"

# Fusion weights (semantic, lexical) by kind of query.
WEIGHTS = {"exact_quote": (0.1, 0.9), "entity": (0.4, 0.6), "conceptual": (0.8, 0.2), "factual": (0.5, 0.5), "exploratory": (0.7, 0.3)}
# Recall presets (diversify, its lambda, rerank, score floor, candidates to rerank).
PRESETS = {"high": (False, 0.7, True, 0.0, 50), "balanced": (True, 0.7, True, 0.001, 30), "precise": (True, 0.5, True, 0.01, 30)}

# Entity and relation types and their aliases.
ENTITY_ALIASES = {
    "concept": ["concept", "idea", "topic", "theme"],
    "organization": ["organization", "company", "institution", "org", "group"],
    "person": ["person", "individual", "human", "people"],
    "section": ["section", "heading", "chapter"],
    "document": ["document", "doc", "file"],
    "technology": ["technology", "tech", "tool", "framework", "protocol", "software"],
    "location": ["location", "place", "region", "country", "city"],
    "event": ["event", "incident", "occurrence"],
}
RELATION_ALIASES = {
    "mentions": ["mentions", "reference", "refers_to", "cites"],
    "defines": ["defines", "definition", "explains"],
    "relates_to": ["relates_to", "related", "associated", "connected"],
    "contains": ["contains", "includes", "has"],
    "part_of": ["part_of", "belongs_to", "member_of"],
    "implements": ["implements", "uses", "applies"],
    "depends_on": ["depends_on", "requires", "needs"],
    "created_by": ["created_by", "authored_by", "developed_by"],
    "used_by": ["used_by", "utilized_by", "employed_by"],
    "similar_to": ["similar_to", "like", "resembles"],
}
# Content that an extracted entity must not have.
SUSPICIOUS = [
    r"(?i)ignore[ \t\n\f\r]+(previous|all|above)", r"(?i)disregard[ \t\n\f\r]+(the|all|previous)", r"(?i)forget[ \t\n\f\r]+(everything|all|previous)", r"(?i)<script",
    r"(?i)javascript:", r"(?i)on(error|load|click)=", r"(?i)eval[ \t\n\f\r]*\(", r"(?i)exec[ \t\n\f\r]*\(", r"(?i)system[ \t\n\f\r]*\(", r"(?i)__proto__", r"(?i)constructor[ \t\n\f\r]*\[",
]
# Strings that are filtered from prompts.
DANGEROUS = [
    "</text_to_analyze>", "</document_context>", "</extraction_rules>", "</output_format>", "<text_to_analyze>", "<document_context>", "<extraction_rules>", "<output_format>",
    "Ignore previous instructions", "ignore all previous", "disregard the above", "forget everything", "system:", "assistant:", "user:",
]
# Classes of extraction errors, by the strings they hold, in order.
ERROR_CLASSES = [
    ("Incomplete JSON", ["incomplete json", "incomplete"]), ("Invalid escape", ["invalid escape", "\\_"]), ("Schema mismatch", ["array", "schema", "type mismatch"]),
    ("Timeout", ["timeout"]), ("Connection", ["connection", "unavailable"]), ("Parse error", ["parse json", "no json found"]),
]
# Lawful changes of an instance's state.
TRANSITIONS = {
    "CREATED": ["AUDITING"], "AUDITING": ["BLOCKED", "INSTALLED"], "BLOCKED": ["REMOVING"], "INSTALLED": ["STARTING", "DISABLED", "REMOVING", "UPDATING"],
    "STARTING": ["RUNNING", "DEGRADED", "STOPPED"], "RUNNING": ["DEGRADED", "STOPPING", "DISABLED"], "DEGRADED": ["RUNNING", "STOPPING", "DISABLED"],
    "STOPPING": ["STOPPED"], "STOPPED": ["STARTING", "REMOVING", "UPDATING"], "UPDATING": ["INSTALLED", "BLOCKED"], "DISABLED": ["INSTALLED", "REMOVING"],
    "REMOVING": ["REMOVED"], "REMOVED": [],
}


def _folded() -> tuple[str, str]:
    """Letters that the index writes without their mark, and what stands for them: letters that decompose into a letter and one mark, and other forms of small letters. Marks that stand alone are dropped, as nothing stands for them."""
    letters, marks = {}, set()
    for code in range(0x80, 0x2000):
        c = chr(code)
        d = unicodedata.normalize("NFD", c.casefold() if len(c.casefold()) == 1 else c)
        if unicodedata.category(c) == "Ll" and (len(d) == 1 or len(d) == 2 and d[0].isascii() and unicodedata.combining(d[1])):
            letters[c] = d[0]
        marks |= {x for x in unicodedata.normalize("NFD", c)[1:] if "\u0300" <= x < "\u0370"}
    pairs = {c: d for c, d in letters.items() if c != d}
    return "".join(pairs) + "".join(sorted(marks)), "".join(pairs.values())


MARKED, PLAIN = _folded()
# Starts of functions and classes by extension (function, class), on a line without the space around it.
CODE_STARTS = {
    ".go": (r"^func\s+", r"^type\s+\w+\s+struct"),
    ".py": (r"^def\s+", r"^class\s+"),
    ".js": (r"^(async\s+)?function\s+|^(const|let|var)\s+\w+\s*=\s*(async\s+)?\(|^(const|let|var)\s+\w+\s*=\s*(async\s+)?function", r"^class\s+"),
    ".ts": (r"^(async\s+)?function\s+|^(const|let|var)\s+\w+\s*=\s*(async\s+)?\(|^(const|let|var)\s+\w+\s*=\s*(async\s+)?function", r"^class\s+"),
    ".java": (r"^\s*(public|private|protected)?\s*(static)?\s*\w+\s+\w+\s*\(", r"^\s*(public|private)?\s*class\s+"),
    ".kt": (r"^\s*(public|private|protected)?\s*(static)?\s*\w+\s+\w+\s*\(", r"^\s*(public|private)?\s*class\s+"),
    ".scala": (r"^\s*(public|private|protected)?\s*(static)?\s*\w+\s+\w+\s*\(", r"^\s*(public|private)?\s*class\s+"),
    ".rs": (r"^(pub\s+)?fn\s+", r"^(pub\s+)?struct\s+|^(pub\s+)?impl\s+"),
    ".rb": (r"^def\s+", r"^class\s+"),
    ".c": (r"^\w+[\s\*]+\w+\s*\([^)]*\)\s*\{?$", r"^class\s+\w+|^struct\s+\w+"),
    ".cpp": (r"^\w+[\s\*]+\w+\s*\([^)]*\)\s*\{?$", r"^class\s+\w+|^struct\s+\w+"),
    ".h": (r"^\w+[\s\*]+\w+\s*\([^)]*\)\s*\{?$", r"^class\s+\w+|^struct\s+\w+"),
    ".hpp": (r"^\w+[\s\*]+\w+\s*\([^)]*\)\s*\{?$", r"^class\s+\w+|^struct\s+\w+"),
}

# Paths that are never granted, paths below them that may be, and folders of a home that are never granted.
FORBIDDEN_PATHS = ["/", "/etc", "/var", "/root", "/System", "/Library", "/private", "C:\\Windows", "C:\\Program Files", "C:\\ProgramData"]
ALLOWED_PATHS = ["/tmp", "/var/folders", "/private/var/folders", "/var/tmp"]
FORBIDDEN_IN_HOME = [".ssh", ".gnupg", ".aws", ".config/gcloud", ".azure", ".kube", ".docker", "Library/Keychains", "AppData/Roaming"]
