"""Explicit schemas of everything that is read or written."""

from __future__ import annotations

ENTITY = "struct<start:int,end:int,text:string,label:string,normalized_term:string>"
ENTITIES = f"array<{ENTITY}>"
ANNOTATION = "filename string, mark string, label string, off0 int, off1 int, span string"
ANNOTATION_LINKED = ANNOTATION + ", codes string, semantic_relation string"
DOCUMENT = f"doc_id string, text string, entities {ENTITIES}"
SPLIT_DOCUMENT = DOCUMENT + ", split string"
TOKENS = "doc_id string, tokens array<string>, ner_tags array<string>"
SEQ2SEQ = "doc_id string, input_text string, target_text string"
TRAINING_LOG = "step int, epoch double, loss double, eval_loss double, eval_f1 double"
METRICS = "struct<precision:double,recall:double,f1:double>"
RESULTS = f"model_key string, checkpoint string, baseline {METRICS}, finetuned {METRICS}"
