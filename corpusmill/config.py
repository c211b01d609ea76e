"""Constants that define semantics."""

TARGET_TOKENS, MAX_TOKENS, OVERLAP_TOKENS, WORDS_PER_TOKEN = 500, 800, 50, 0.75
BM25_K1, BM25_B, TITLE_BOOST, HEADING_BOOST = 1.5, 0.75, 0.5, 0.3
RRF_K, OVERSAMPLE, RERANK_POOL = 60, 4, 40
SEED_FILES, PER_HOP, EXPAND_FLOOR, HOP_DECAY = 5, 3, 3.0, 0.5
WEIGHT_CONCEPT, WEIGHT_TAG, WEIGHT_LINK, WEIGHT_EMBEDDING, WEIGHT_SECOND = 1.0, 0.5, 3.0, 2.0, 4.0
MIN_COSINE, MIN_EDGE, TOP_NEIGHBOURS = 0.88, 1.0, 10
ISOLATED_BELOW, SPARSE_BELOW, SPARSE_SIZE, BRIDGE_COMMUNITIES, SURPRISING_TOP = 0.5, 0.15, 5, 3, 20
#: Prefixes of tracking parameters.
TRACKING = ["utm_", "ref", "fbclid", "gclid", "mc_cid", "mc_eid"]
#: Names of documents about the collection itself, at its root: a parameter of the collection. Most collections have these two.
META_DOCUMENTS = ["README.md", "log.md"]
RECALL_AT, NDCG_AT, MRR_AT = 20, 10, 10
#: Marks of page metadata in an author field, and titles that only name a site.
SUSPECT_AUTHORS = ["Authority control databases", "CONTRIBUTORS ", "MusicBrainz"]
SITE_TITLES = ["lesswrong", "wikipedia", "reddit", "twitter", "x", "github"]
LONGEST_AUTHOR = 200
#: Acronyms that a query is expanded by, both ways.
ACRONYMS = {
    "RLHF": "reinforcement learning from human feedback", "RSP": "responsible scaling policy", "ASL": "AI safety level", "CBRN": "chemical biological radiological nuclear", "ELK": "eliciting latent knowledge",
    "RMU": "representation misdirection unlearning", "CoT": "chain of thought", "SAE": "sparse autoencoder", "DPO": "direct preference optimization", "PPO": "proximal policy optimization",
    "MMLU": "massive multitask language understanding", "FSF": "frontier safety framework", "CCL": "critical capability level", "RAG": "retrieval augmented generation",
}
