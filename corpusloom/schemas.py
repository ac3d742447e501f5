"""Schemas of the engine's tables, as DDL."""

DOCUMENTS = "doc_id string, source string, folder string, corpus string, user_id string, doc_type string, law_name string, content_hash string, created_at timestamp"
BLOCKS = "doc_id string, `order` int, type string, content string, level int, language string, page int, headers array<string>, rows array<array<string>>, meta map<string,string>"
CHUNKS = (
    "chunk_id string, doc_id string, text string, `order` int, token_count int, chunk_level string, heading_path array<string>, block_ids array<string>, "
    "parent_chunk_id string, child_chunk_ids array<string>, prev_chunk_id string, next_chunk_id string, articles array<string>, article_no string, "
    "corpus string, folder string, user_id string, law_name string, doc_type string, extra map<string,string>"
)
VECTORS = "chunk_id string, content_hash string, model string, dimension int, vector array<float>"
POSTINGS = "chunk_id string, term string, tf bigint, dl int, weight double"
BM25_TERMS = "term string, df bigint, idf double"
BM25_STATS = "n_docs bigint, avgdl double, k1 double, b double"
HITS = "query_id string, chunk_id string, arm string, score double, rank int"
PII_SPANS = "doc_id string, category string, value string, start int, end int, preview string"
MASK_MAP = "doc_id string, id string, placeholder string, category string, original string, masked_value string, method string, start int, end int"
RULES = (
    "rule_id string, dimension string, trigger struct<patterns:array<string>>, risk_level string, risk_desc string, suggestion_template string, "
    "basis array<struct<law:string,article:string>>, source string, status string"
)
MANIFEST = "relpath string, doc_id string, content_hash string, size bigint, indexed_at timestamp, chunk_count int"
MESSAGES = "id bigint, session_id string, role string, msg_kind string, content string, tool_calls string, token_count int, created_at timestamp"
