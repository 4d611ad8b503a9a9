"""Settings and fixed values.

The block marked FIXED VALUES holds literals that must equal the answering
service being replicated for results to agree (labels, templates, defaults,
histogram bounds).  Everything else is a tunable of this engine.
"""

# ---------------------------------------------------------------------------
# FIXED VALUES (must match the replicated service exactly)
# ---------------------------------------------------------------------------

# Document categories, chosen by doc_id modulo 4, in this order.
CATEGORIES = ["technical", "billing", "shipping", "general"]

# Synthetic corpus templates (the modulus for the issue number is 100).
CORPUS_TITLE = "Document {i}"
CORPUS_CONTENT = ("This is the content of document {i}. It contains information "
                  "about customer support issue {m}.")
CORPUS_ISSUE_MODULUS = 100

# Retrieval / generation defaults.
TOP_K = 10
TRUNCATE_CHARS = 512
MAX_NEW_TOKENS = 128
NPROBE = 64
NLIST = 4096
VECTOR_DIM = 768
CONTEXT_DOCS = 3
CONTEXT_CHARS = 200
SCORER_INPUT_CHARS = 512
REUSE_TTL_SECONDS = 60
BATCH_SIZE = 32
NUM_CHUNKS = 4

# Prompt template.
SYSTEM_PROMPT = "When given Context and Question, reply as 'Answer: <final answer>' only."
CONTEXT_LINE = "- {title}: {content}"
USER_PROMPT = "Context:\n{context}\n\nQuestion: {query}\n\nAnswer:"

# Sentiment: classifier star label -> sentiment; unknown labels map to neutral.
SENTIMENT_LABELS = {
    "1 star": "very negative",
    "2 stars": "negative",
    "3 stars": "neutral",
    "4 stars": "positive",
    "5 stars": "very positive",
}
SENTIMENT_DEFAULT = "neutral"

# Toxicity: flag when score is strictly above the threshold; the flag is a string.
TOXIC_THRESHOLD = 0.5
TOXIC_MASK = "[Content Filtered due to toxicity]"
TOXIC_DEFAULT = "false"

# Adaptive batching policy.
ADAPTIVE_HISTORY = 10
ADAPTIVE_KEEP = 0.7
ADAPTIVE_MIN_DELAY_SEC = 0.01

# Histogram upper bounds (seconds, or item counts for batch sizes).
LATENCY_BUCKETS = [0.01, 0.05, 0.1, 0.25, 0.5, 1.0, 2.0, 5.0, 10.0, 30.0, 60.0]
BATCH_SIZE_BUCKETS = [1, 2, 4, 8, 16, 32, 64]
RPC_BUCKETS = [0.01, 0.05, 0.1, 0.25, 0.5, 1.0, 2.0, 5.0, 10.0]
RATIO_BUCKETS = [1.0, 1.5, 2.0, 3.0, 5.0, 10.0, 20.0]
GATEWAY_BATCH_BUCKETS = [1, 2, 4, 8, 16, 32]
GATEWAY_LATENCY_BUCKETS = [0.1, 0.5, 1.0, 2.0, 5.0, 10.0, 30.0, 60.0]
GATEWAY_RPC_BUCKETS = [0.05, 0.1, 0.5, 1.0, 2.0, 5.0, 10.0]

# Metric flattening: a missing label becomes this value.
UNKNOWN_LABEL = "unknown"

# ---------------------------------------------------------------------------
# Engine tunables (not part of the replicated semantics)
# ---------------------------------------------------------------------------

# Hashed bag-of-tokens embedding width used by the default text embedder.
EMBED_DIM = 256
# Token pattern shared by every default scorer: runs of letters or digits.
TOKEN_PATTERN = r"[\p{L}\p{N}]+"
# Sentence pattern for the extractive answerer.
SENTENCE_PATTERN = r"[^.!?\n]+[.!?]?"
# Upper bound (bytes) for anything shipped to executors as a broadcast.
BROADCAST_LIMIT_BYTES = 64 * 1024 * 1024
# Rows per block in blocked (shuffle) vector search.
KNN_BLOCK_ROWS = 20000
