"""Settings of the engine and the values other parts rely on."""

# File extension to language. Anything else is text.
LANGUAGE_BY_EXTENSION = {
    ".py": "python",
    ".js": "javascript",
    ".jsx": "javascript",
    ".ts": "typescript",
    ".tsx": "typescript",
    ".java": "java",
    ".rs": "rust",
    ".go": "go",
    ".cpp": "cpp",
    ".c": "c",
    ".php": "php",
    ".rb": "ruby",
}

# Patterns that apply to every repository.
DEFAULT_IGNORE = [".git", ".git/**", "uv.lock"]
IGNORE_FILE = ".gitignore"

# Chunk limits. Code in lines and characters, text in characters.
CODE_CHUNK_LINES = 40
CODE_CHUNK_OVERLAP = 15
CODE_CHUNK_CHARS = 1500
TEXT_CHUNK_CHARS = 1024
TEXT_CHUNK_OVERLAP = 200

# File limits.
MAX_FILE_MB = 1.0
BINARY_SAMPLE_CHARS = 8192

# Retrieval.
EMBEDDING_DIM = 1536
TOP_K_BM25 = 3
TOP_K_EMBEDDING = 3
JOIN_MODE = "reciprocal_rank_fusion"
SCORE_JOIN_MODE = "distribution"
PREVIEW_CHARS = 500
RULE_WIDTH = 80

# What Python's str.strip() removes.
WHITESPACE = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)

# BM25 and rank fusion constants of the published papers.
BM25_K1 = 1.2
BM25_B = 0.75
RRF_K = 60

# Tie-safe ranking: scores are compared after rounding to this many decimals.
SCORE_DECIMALS = 6
FUSED_DECIMALS = 9

# A side is broadcast only when a probe shows that it stays under both bounds.
BROADCAST_MAX_ROWS = 200_000
BROADCAST_MAX_BYTES = 64 * 1024 * 1024

# Query vectors sent to each task of a vector search; a larger set is spread over tasks.
DENSE_MAX_QUERIES = 2048

# Text in a partition of lines: at most, and at least while there are cores without one.
PARTITION_TEXT_BYTES = 4 * 1024 * 1024
PARTITION_LEAST_BYTES = 128 * 1024

# Copies of the small side when a lookup is salted instead of broadcast.
LOOKUP_SALTS = 32

# Buckets per repository in a stored index: the unit an incremental run rewrites.
INDEX_PATH_BUCKETS = 8

# Buckets of a stored postings table: the unit a keyword search reads.
POSTINGS_BUCKETS = 64

# Chunks of a posting block, about, and places a block search scores before it has a threshold.
BLOCK_CHUNKS = 256
BLOCK_FIRST_PLACES = 4

# Buckets per model in a store of vectors by content.
VECTOR_STORE_BUCKETS = 16
