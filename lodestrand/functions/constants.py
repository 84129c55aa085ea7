"""Codes, labels, weights, word lists and limits that results depend on."""

KINDS = ("function", "method", "class", "struct", "enum", "typedef", "variable", "macro", "include", "namespace", "unknown")
FUNCTION, METHOD, CLASS, STRUCT, ENUM, TYPEDEF, VARIABLE, MACRO, INCLUDE, NAMESPACE, UNKNOWN = range(11)
KIND_LABELS = ("fn", "method", "class", "struct", "enum", "typedef", "var", "macro", "include", "ns", "node")
KIND_LIST_LABELS = (*KIND_LABELS[:10], "?")
KIND_IMPORTANCE = (10, 10, 8, 8, 6, 6, 4, 4, 1, 5, 0)
#: Of equally placed candidates for a name: functions and methods, classes and structs, enums and typedefs, the rest.
KIND_RESOLUTION = {FUNCTION: 5, METHOD: 5, CLASS: 4, STRUCT: 4, ENUM: 3, TYPEDEF: 3, MACRO: 2, VARIABLE: 2, INCLUDE: 1, NAMESPACE: 1}

CALLS, INCLUDES, DEFINES, REFERENCES, INHERITS = range(5)
EDGE_LABELS = ("calls", "includes", "defines", "refs", "inherits")
EDGE_GROUPS = ("calls", "called-by", "includes", "included-by", "defines", "refs", "inherits")

LANG_LABELS = ("C", "C++", "Python", "JavaScript", "TypeScript", "Go", "Rust", "unknown")
LANG_SHORT = ("C", "C++", "Py", "JS", "TS", "Go", "Rust", "?")
EXTENSIONS = {"c": 0, "h": 0, "cpp": 1, "cc": 1, "cxx": 1, "hpp": 1, "hxx": 1, "py": 2, "js": 3, "mjs": 3, "jsx": 3, "ts": 4, "tsx": 4, "go": 5, "rs": 6}
UNKNOWN_LANG = 7

STOPWORDS = "the a an is are of to in on for and or how why does do where what when with this that it as be if has have any all its not but can was were".split()

INTENT_RULES = (
    ("review", ("review", "audit")),
    ("edit", ("fix", "implement", "refactor", "change", "add ", "remove")),
    ("debug", ("bug", "crash", "freeze", "debug", "why", "failing")),
    ("trace", ("trace", "path", "call chain", "flow")),
    ("explain", ("how", "explain", "where", "what")),
)

#: Identifiers of five letters or more that never become references; shorter ones never do.
NOISE_WORDS = (
    "float double short unsigned signed const static struct class union return false size_t delete public private protected "
    "virtual override template typename namespace using include define ifdef endif while switch break continue sizeof inline "
    "extern volatile register typedef default width height depth count index value error start flags color style state level "
    "group entry child first right"
).split()

SKIPPED_DIRS = ("node_modules", ".git", "build", "bin", "__pycache__", ".cache", "dist", "target", ".svn", ".hg")
MOST_FILE_BYTES = 10 * 1024 * 1024
VENDOR_DIRS = ("vendor", "vendors", "third_party", "thirdparty", "external", "deps")
PUBLIC_PREFIXES = ("ctx_", "Ctx")

MOST_TERMS, MOST_SEEDS, MOST_SET, DEPTH, SIBLINGS, DIR_PEERS, LEAST_SCORE = 24, 128, 128, 4, 8, 8, 6.0
PACKET_TARGETS, PACKET_CARDS, PACKET_FILES, PACKET_RELATIONS, PACKET_OMITTED = 6, 24, 12, 4, 16
FILE_ENTRYPOINTS, FILE_INTERNALS, FILE_OMITTED = 24, 32, 24
PAGE_SIZE, GRAPH_NODES, GRAPH_EDGES = 80, 1200, 6000
SEED_SPREAD, HOP_SCORES = 16, (50.0, 40.0, 30.0, 20.0)
SIBLING_PUBLIC, SIBLING_OTHER, INCLUDE_CHAIN, ENTRYPOINT_SCORE, ENTRYPOINT_FILES = 45.0, 20.0, 15.0, 46.0, 32

SCHEMA_VERSION, SEMANTIC_VERSION = "2", "5"
