"""Schemas (DDL) of the records that the engine reads and writes."""

SEARCH_HISTORY = "user_id string, query string, algorithm string, files array<string>, matches_count long, duration_ms double, run_at timestamp"
PERFORMANCE_LOGS = "algorithm string, file_path string, text_size_bytes long, duration_ms double, matches_count long, user_id string, created_at timestamp"
USERS = "id string, username string, email string, password_hash string, role string, is_active boolean, created_at timestamp, updated_at timestamp"
UPLOADS = "file_name string, file_path string, size_bytes long, uploaded_by string, created_at timestamp"
ENTITY = "struct<type:string,value:string,start:int,end:int>"
ENRICHED = f"array<struct<byte_offset:long,char_offset:long,snippet:string,entities:array<{ENTITY}>>>"
PROFILE = "struct<length:long,unique_bytes:int,entropy:double,is_monotone:boolean,is_natural:boolean,has_non_ascii:boolean,top_byte_freq:double>"
MONITOR_EVENT = "watch_id string, file string, pattern string, algorithm string, new_matches array<long>, all_matches array<long>, timestamp double, error string"
