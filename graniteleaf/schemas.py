"""Explicit schemas of the tables that are read from JSON lines."""

CHUNK = "chunk_id string, kind string, unit_id string, citation string, title string, chapter string, chapter_title string, section string, section_title string, part int, n_parts int, body string, text string, n_tokens int, url string, meta map<string,string>"
QUESTION = "id string, type string, question string, gold_units array<string>, reference string, probe string"
EVAL_ROW = "id string, type string, question string, answer string, abstained boolean, gold_units array<string>, retrieved_units array<string>, cited_units array<string>, contexts array<string>, citation_validity double, latency_s double, retrieval struct<hit_rate:double,recall:double,full_recall:double,precision:double,mrr:double,ndcg:double>, grade string, faithfulness double, n_claims int, unsupported_claims array<struct<claim_index:int,supported:boolean,reason:string>>, grade_reason string, failure string, gen_model string, judge_model string"
VERDICTS = "array<struct<claim_index:int,supported:boolean,reason:string>>"
