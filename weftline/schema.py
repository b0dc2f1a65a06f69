"""Tables of a knowledge base."""

from __future__ import annotations

TEXT_CHUNKS = "chunk_id string, content string, tokens int, chunk_order_index int, full_doc_id string, file_path string"
FULL_DOCS = "full_doc_id string, content string, file_path string, chunks_count int, chunks_list array<string>"
ENTITY_FACTS = "full_doc_id string, name string, type string, description string, source_id string, file_path string, timestamp bigint, chunk_ord int, ord int"
RELATION_FACTS = "full_doc_id string, source_id string, target_id string, keywords string, description string, weight float, source_chunk_id string, file_path string, timestamp bigint, chunk_ord int, ord int"
NODES = "entity_id string, entity_type string, description string, source_id string, file_path string, created_at bigint, truncate string, labels array<string>"
EDGES = "src string, tgt string, description string, keywords string, weight double, source_id string, file_path string, created_at bigint, truncate string"
VECTORS = "id string, vector array<float>, name string"
TASKS = "task_id string, document_id int, rag_document_id string, content string, file_path string, status string, current_stage string, progress int, error_message string, created_at timestamp, started_at timestamp, completed_at timestamp, priority int, retry_count int, max_retries int"
DOCUMENTS = "id int, file_name string, content string, file_size bigint, upload_time timestamp, last_modified timestamp, is_in_rag_system boolean, rag_added_time timestamp, rag_status string, rag_error_message string, rag_progress int, rag_document_id string, file_url string, file_hash string"
