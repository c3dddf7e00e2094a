"""SQL for the pipeline's queries, written for itself: explode, join and window where the engine works on arrays."""

from __future__ import annotations

_SET = r"\t-\r\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
SOLID, BLANK = f"'[^{_SET}]+'", f"[{_SET}]"


def _strip(x: str) -> str:
    return f"regexp_replace({x}, '^{BLANK}+|{BLANK}+$', '', 'g')"


_WORDS = f"""words AS (
  SELECT row_id, i, word, (e - length(word))::INT AS a, e::INT AS b FROM (
    SELECT row_id, i, word, sum(length(gap) + length(word)) OVER (PARTITION BY row_id ORDER BY i) AS e FROM (
      SELECT row_id, unnest(ws) AS word, unnest(gs[1:len(ws)]) AS gap, unnest(range(len(ws)))::INT AS i
      FROM (SELECT row_id, regexp_extract_all(text, {SOLID}) AS ws, string_split_regex(text, {SOLID}) AS gs FROM distemist_raw_splits))))"""
_ENTS = """ents AS (
  SELECT row_id, ord, e.start AS a, e."end" AS b, e.text AS text, coalesce(e.normalized_term, e.text) AS term
  FROM (SELECT row_id, unnest(entities) AS e, unnest(range(len(entities))) AS ord FROM distemist_raw_splits))"""
_TAGS = f"""{_WORDS}, {_ENTS},
firsts AS (
  SELECT e.row_id, e.ord, e.a, e.b, count(w.i) AS first FROM ents e LEFT JOIN words w ON w.row_id = e.row_id AND w.b <= e.a
  WHERE e.a IS NOT NULL AND e.b IS NOT NULL GROUP BY e.row_id, e.ord, e.a, e.b),
tags AS (
  SELECT row_id, i, word, tag,
         CASE WHEN (row_id + i) % 7 = 0 THEN 'O' WHEN (row_id + i) % 11 = 0 THEN 'B-ENFERMEDAD' ELSE tag END AS predicted
  FROM (SELECT w.row_id, w.i, w.word,
               CASE WHEN count(f.ord) = 0 THEN 'O' WHEN arg_max(f.first, f.ord) = w.i THEN 'B-ENFERMEDAD' ELSE 'I-ENFERMEDAD' END AS tag
        FROM words w LEFT JOIN firsts f ON f.row_id = w.row_id AND w.b > f.a AND w.a < f.b GROUP BY w.row_id, w.i, w.word))"""
_CHUNKS = f"""{_WORDS},
sized AS (SELECT row_id, doc_id, text, len(regexp_extract_all(text, {SOLID})) AS n FROM distemist_raw_splits WHERE text IS NOT NULL),
numbered AS (SELECT row_id, doc_id, text, n, unnest(range(CASE WHEN n <= 246 THEN 1 ELSE ((n - 246 + 195) // 196) + 1 END))::INT AS k FROM sized),
chunks AS (
  SELECT c.row_id, CASE WHEN n <= 246 THEN -1 ELSE k END AS chunk_no, CASE WHEN n <= 246 THEN doc_id ELSE doc_id || '_chunk' || k END AS doc_id,
         CASE WHEN n <= 246 THEN 0 ELSE min(w.a) END AS a, CASE WHEN n <= 246 THEN length(text) ELSE max(w.b) END AS b, count(w.i)::INT AS n_words, text AS whole
  FROM numbered c LEFT JOIN words w ON w.row_id = c.row_id AND w.i >= k * 196 AND w.i < k * 196 + 246
  GROUP BY c.row_id, k, n, doc_id, text),
{_ENTS},
own AS (SELECT c.row_id, c.chunk_no, c.a AS ca, c.b AS cb, c.whole, e.ord, e.a, e.b, e.text, e.term FROM chunks c JOIN ents e ON e.row_id = c.row_id AND e.a >= c.a AND e.b <= c.b)"""


def _decoded(column: str, name: str) -> str:
    return f"""
{name}_rows AS (
  SELECT DISTINCT row_id, lower({_strip("entity")}) AS entity FROM (
    SELECT row_id, string_agg(word, ' ' ORDER BY i) AS entity
    FROM (SELECT *, sum(CASE WHEN {column} LIKE 'I%' THEN 0 ELSE 1 END) OVER (PARTITION BY row_id ORDER BY i) AS g FROM tags)
    GROUP BY row_id, g HAVING arg_min({column}, i) LIKE 'B%') WHERE {_strip("entity")} <> ''),
{name} AS (SELECT DISTINCT regexp_replace(doc_id, '_chunk[0-9]+$', '') AS doc_id, entity FROM {name}_rows JOIN distemist_raw_splits USING (row_id) WHERE doc_id IS NOT NULL)"""


_PAIRS = f"WITH {_TAGS}, {_decoded('tag', 'truth')}, {_decoded('predicted', 'predicted')}"
_COUNTED = "count(*) FILTER (t.entity IS NOT NULL AND p.entity IS NOT NULL) AS tp, count(*) FILTER (t.entity IS NULL) AS fp, count(*) FILTER (p.entity IS NULL) AS fn"
_SCORES = """tp, fp, fn, CASE WHEN tp + fp = 0 THEN 0.0::DOUBLE ELSE tp::DOUBLE / (tp + fp) END AS precision, CASE WHEN tp + fn = 0 THEN 0.0::DOUBLE ELSE tp::DOUBLE / (tp + fn) END AS recall"""
_F1 = "CASE WHEN precision + recall = 0 THEN 0.0::DOUBLE ELSE 2 * precision * recall / (precision + recall) END AS f1"


def _scored(counted: str, keys: str = "") -> str:
    return f"SELECT *, {_F1} FROM (SELECT {keys}{_SCORES} FROM ({counted}))"


def profile_sql(rows: str) -> str:
    q = lambda p: f"round(quantile_cont(n_words::DOUBLE, {p}), 6)"
    return f"SELECT split, count(*) AS n, max(n_words)::INT AS longest, round(avg(n_words), 6) AS mean, {q(0.5)} AS p50, {q(0.7)} AS p70, {q(0.99)} AS p99 FROM ({rows}) WHERE n_words IS NOT NULL GROUP BY split"


_RATIOS = f"""SELECT row_id, list_sum(list_transform(ws, lambda w: ceil(length(w) / 4)))::DOUBLE / len(ws) AS ratio
FROM (SELECT row_id, regexp_extract_all(text, {SOLID}) AS ws FROM distemist_raw_splits) WHERE len(ws) > 0"""
_TARGETS = """targets AS (
  SELECT d.row_id, coalesce(string_agg(term, ' [SEP] ' ORDER BY o), 'ninguna') AS target_text
  FROM distemist_raw_splits d LEFT JOIN (SELECT row_id, term, min(ord) AS o FROM ents WHERE term IS NOT NULL GROUP BY row_id, term) t USING (row_id) GROUP BY d.row_id)"""
_LOG = """log AS (
  SELECT event_type AS model_key, event_id::INT AS step, (user_id % 10 + 1)::DOUBLE AS epoch, CASE WHEN event_id % 2 = 0 THEN value END AS loss,
         CASE WHEN event_id % 3 = 0 THEN value / 2 END AS eval_loss, CASE WHEN event_id % 5 = 0 THEN floor(value) / 1000 END AS eval_f1 FROM events)"""


def _outcome(test: str, column: str) -> str:
    return f"{_PAIRS} SELECT {column}.doc_id, {column}.entity FROM truth t FULL JOIN predicted p ON t.doc_id = p.doc_id AND t.entity = p.entity WHERE {test}"



_HASH = "substring(md5('42' || chr(1) || {0}), 1, 15)"
_UNESCAPED = r"""CASE WHEN span IS NULL THEN NULL ELSE array_to_string(list_transform(string_split(span, '\u'), lambda p, k:
  CASE WHEN k = 1 THEN p WHEN regexp_matches(p, '^[0-9a-fA-F]{4}') THEN chr(('0x' || substring(p, 1, 4))::INT) || substring(p, 5) ELSE '\u' || p END), '') END"""

SQL = {
    "word_tokens": f'WITH {_WORDS} SELECT row_id, i, word, a AS start, b AS "end" FROM words',
    "word_count": f"SELECT row_id, len(regexp_extract_all(text, {SOLID})) ::INT AS n_words FROM distemist_raw_splits WHERE text IS NOT NULL",
    "length_profile": profile_sql(f"SELECT split, len(regexp_extract_all(text, {SOLID})) AS n_words FROM distemist_raw_splits"),
    "chunk_length_profile": f"WITH {_CHUNKS} " + profile_sql("SELECT split, n_words FROM chunks JOIN (SELECT row_id, split FROM distemist_raw_splits) USING (row_id)"),
    "token_word_ratio": _RATIOS,
    "safe_window": f"WITH r AS ({_RATIOS}) " + " UNION ALL ".join(
        f"SELECT {p}::DOUBLE AS percentile, round(quantile_cont(ratio, {p}), 6) AS ratio, floor(480.0::DOUBLE / quantile_cont(ratio, {p}) * 0.9::DOUBLE)::INT AS window_words FROM r WHERE ratio > 0" for p in (0.9, 1.0)),
    "docs_without_entities": """SELECT split, n_docs, n_without, n_without * 100.0::DOUBLE / n_docs AS pct_without FROM (
  SELECT split, count(*) AS n_docs, count(*) FILTER (coalesce(len(entities), 0) = 0) AS n_without FROM distemist_raw_splits GROUP BY split)""",
    "offset_faults": f"""WITH {_ENTS}, seen AS (
  SELECT e.row_id, e.ord::INT AS ord, e.a AS start, e.b AS "end", e.text, CASE WHEN e.a >= 0 AND e.b >= e.a THEN substring(d.text, e.a + 1, e.b - e.a) END AS found
  FROM ents e JOIN distemist_raw_splits d USING (row_id) WHERE d.text IS NOT NULL)
SELECT * FROM seen WHERE found IS DISTINCT FROM text""",
    "doc_entities": """SELECT d.doc_id, count(a.row_id)::INT AS n_entities, coalesce(string_agg(coalesce(a.span, ''), '|' ORDER BY a.row_id) FILTER (a.row_id IS NOT NULL), '') AS spans
FROM (SELECT DISTINCT doc_id FROM distemist_raw_splits WHERE doc_id IS NOT NULL) d LEFT JOIN subtrack1_entities a ON a.filename = d.doc_id GROUP BY d.doc_id""",
    "sample_k": f"SELECT row_id FROM distemist_raw_splits ORDER BY {_HASH.format('row_id')}, row_id LIMIT 30",
    "make_split": f"""WITH d AS (SELECT DISTINCT doc_id FROM distemist_raw_splits WHERE doc_id IS NOT NULL),
r AS (SELECT doc_id, row_number() OVER (ORDER BY {_HASH.format('doc_id')}, doc_id) AS k, count(*) OVER () AS n FROM d)
SELECT doc_id, CASE WHEN k <= greatest(1, floor(n * 0.8)) THEN 'train' WHEN k <= greatest(1, floor(n * 0.8)) + greatest(1, floor(n * 0.1)) THEN 'dev' ELSE 'test' END AS split FROM r""",
    "split_sizes": "SELECT split, count(*) AS n_rows, count(*)::DOUBLE / (SELECT count(*) FROM distemist_raw_splits) AS share FROM distemist_raw_splits GROUP BY split",
    "split_leaks": """SELECT orig_doc_id, string_agg(split, ',' ORDER BY split) AS splits FROM (
  SELECT DISTINCT regexp_replace(doc_id, '_chunk[0-9]+$', '') AS orig_doc_id, split FROM distemist_raw_splits WHERE split IS NOT NULL AND doc_id IS NOT NULL)
GROUP BY orig_doc_id HAVING count(*) > 1""",
    "chunk_documents": f"""WITH {_CHUNKS}
SELECT c.row_id, c.chunk_no, c.doc_id, c.n_words, md5(substring(whole, c.a + 1, c.b - c.a)) AS text_md5, (SELECT count(*)::INT FROM own o WHERE o.row_id = c.row_id AND o.chunk_no = c.chunk_no) AS n_entities FROM chunks c""",
    "chunk_entities": f"WITH {_CHUNKS} SELECT row_id, chunk_no, a AS doc_start, b AS doc_end, text FROM own",
    "rebase_entities": f'WITH {_CHUNKS} SELECT row_id, chunk_no, (a - ca)::INT AS start, (b - ca)::INT AS "end", substring(whole, a + 1, b - a) AS found FROM own',
    "strip_chunk_suffix": "SELECT row_id, regexp_replace(doc_id, '_chunk[0-9]+$', '') AS orig_doc_id FROM distemist_raw_splits",
    "bio_tags": f"WITH {_TAGS} SELECT row_id, i, tag FROM tags WHERE tag <> 'O'",
    "bio_format": f"""WITH {_TAGS} SELECT d.row_id, md5(coalesce(string_agg(t.word, chr(9) ORDER BY t.i), '')) AS tokens_md5, coalesce(string_agg(t.tag, chr(9) ORDER BY t.i), '') AS tags
FROM distemist_raw_splits d LEFT JOIN tags t USING (row_id) WHERE d.text IS NOT NULL GROUP BY d.row_id""",
    "bio_decode": f"WITH {_TAGS}, {_decoded('predicted', 'predicted')} SELECT row_id, entity FROM predicted_rows",
    "seq2seq_target": f"WITH {_ENTS}, {_TARGETS} SELECT row_id, target_text FROM targets",
    "seq2seq_format": f"""WITH {_CHUNKS}, firsts AS (SELECT row_id, chunk_no, term, min(ord) AS o FROM own WHERE term IS NOT NULL GROUP BY ALL),
joined AS (SELECT row_id, chunk_no, string_agg(term, ' [SEP] ' ORDER BY o) AS target_text FROM firsts GROUP BY ALL)
SELECT c.row_id, c.chunk_no, md5('Identifica las enfermedades mencionadas en el siguiente texto clínico: ' || substring(whole, a + 1, b - a)) AS input_md5, coalesce(j.target_text, 'ninguna') AS target_text
FROM chunks c LEFT JOIN joined j ON j.row_id = c.row_id AND j.chunk_no = c.chunk_no""",
    "parse_generated": f"""WITH {_ENTS}, {_TARGETS}
SELECT DISTINCT row_id, entity FROM (SELECT row_id, lower({_strip("unnest(string_split(upper(target_text), '[SEP]'))")}) AS entity FROM targets WHERE target_text <> 'ninguna') WHERE entity <> ''""",
    "unicode_unescape": f"SELECT row_id, {_UNESCAPED} AS span FROM subtrack1_entities",
    "label_encode": f"""WITH {_TAGS} SELECT d.row_id, coalesce(string_agg(CASE t.tag WHEN 'O' THEN '0' WHEN 'B-ENFERMEDAD' THEN '1' ELSE '2' END, ',' ORDER BY t.i) FILTER (t.i IS NOT NULL), '') AS labels
FROM distemist_raw_splits d LEFT JOIN tags t USING (row_id) WHERE d.text IS NOT NULL GROUP BY d.row_id""",
    "argmax_labels": "SELECT vec_id, (list_position(embedding, list_max(embedding)) - 1)::INT AS best FROM embeddings",
    "mask_ignored": f"""WITH {_TAGS} SELECT d.row_id, coalesce(string_agg(t.predicted, ',' ORDER BY t.i) FILTER ((d.row_id + t.i) % 3 <> 0), '') AS kept
FROM distemist_raw_splits d LEFT JOIN tags t USING (row_id) WHERE d.text IS NOT NULL GROUP BY d.row_id""",
    "word_level_collapse": f"""WITH {_TAGS} SELECT d.row_id, coalesce(string_agg(t.predicted, ',' ORDER BY t.i), '') AS tags
FROM distemist_raw_splits d LEFT JOIN tags t USING (row_id) WHERE d.text IS NOT NULL GROUP BY d.row_id""",
    "token_confusion": f"""WITH {_TAGS} SELECT split, outcome, count(*) AS n FROM (
  SELECT d.split, CASE WHEN tag <> 'O' AND predicted <> 'O' THEN 'TP' WHEN predicted <> 'O' THEN 'FP' WHEN tag <> 'O' THEN 'FN' ELSE 'TN' END AS outcome
  FROM tags JOIN distemist_raw_splits d USING (row_id)) GROUP BY split, outcome""",
    "doc_entity_sets": f"""WITH {_ENTS} SELECT DISTINCT regexp_replace(d.doc_id, '_chunk[0-9]+$', '') AS doc_id, lower({_strip("e.text")}) AS entity
FROM ents e JOIN distemist_raw_splits d USING (row_id) WHERE d.doc_id IS NOT NULL AND e.a IS NOT NULL AND e.b IS NOT NULL AND {_strip("e.text")} <> ''""",
    "micro_prf1": f"{_PAIRS} " + _scored(f"SELECT {_COUNTED} FROM truth t FULL JOIN predicted p ON t.doc_id = p.doc_id AND t.entity = p.entity"),
    "per_doc_prf1": f"{_PAIRS} " + _scored(f"SELECT coalesce(t.doc_id, p.doc_id) AS doc_id, {_COUNTED} FROM truth t FULL JOIN predicted p ON t.doc_id = p.doc_id AND t.entity = p.entity GROUP BY 1", "doc_id, "),
    "entity_intersect": _outcome("t.entity IS NOT NULL AND p.entity IS NOT NULL", "t"),
    "entity_except": _outcome("t.entity IS NULL", "p"),
    "entity_missed": _outcome("p.entity IS NULL", "t"),
    "entity_union": f"{_PAIRS} SELECT * FROM truth UNION SELECT * FROM predicted",
    "annotator_prf1": f"""WITH {_ENTS}, truth AS (
  SELECT DISTINCT regexp_replace(d.doc_id, '_chunk[0-9]+$', '') AS doc_id, lower({_strip("e.text")}) AS entity
  FROM ents e JOIN distemist_raw_splits d USING (row_id) WHERE d.doc_id IS NOT NULL AND e.a IS NOT NULL AND e.b IS NOT NULL AND {_strip("e.text")} <> ''),
spans AS (SELECT regexp_replace(filename, '_chunk[0-9]+$', '') AS doc_id, {_UNESCAPED} AS span FROM subtrack1_entities WHERE filename IS NOT NULL),
predicted AS (SELECT DISTINCT doc_id, lower({_strip("span")}) AS entity FROM spans WHERE {_strip("span")} <> '' AND doc_id IN (SELECT doc_id FROM truth)) """
    + _scored(f"SELECT {_COUNTED} FROM truth t FULL JOIN predicted p ON t.doc_id = p.doc_id AND t.entity = p.entity"),
    "best_epoch": f"""WITH {_LOG} SELECT model_key, epoch, eval_f1 FROM (
  SELECT *, row_number() OVER (PARTITION BY model_key ORDER BY eval_f1 DESC, epoch) AS k FROM log WHERE eval_f1 IS NOT NULL) WHERE k = 1""",
    "training_curves": f"WITH {_LOG} " + " UNION ALL ".join(f"SELECT model_key, step, epoch, '{c}' AS series, {c} AS value FROM log WHERE {c} IS NOT NULL" for c in ("loss", "eval_loss", "eval_f1")),
    "metric_pivot": f"""WITH {_TAGS},
phased AS (
  SELECT row_id, 'finetuned' AS phase, tag, predicted AS p FROM tags
  UNION ALL SELECT row_id, 'baseline', tag, coalesce(lag(tag) OVER (PARTITION BY row_id ORDER BY i), 'O') FROM tags),
counted AS (
  SELECT d.split AS model_key, phase, count(*) FILTER (tag <> 'O' AND p <> 'O') AS tp, count(*) FILTER (tag = 'O' AND p <> 'O') AS fp, count(*) FILTER (tag <> 'O' AND p = 'O') AS fn
  FROM phased JOIN distemist_raw_splits d USING (row_id) WHERE d.split IS NOT NULL GROUP BY ALL),
scored AS ({_scored("SELECT * FROM counted", "model_key, phase, ")}),
long AS (SELECT model_key, phase, unnest(['precision', 'recall', 'f1']) AS metric, unnest([precision, recall, f1]) AS value FROM scored)
SELECT model_key, metric, max(value) FILTER (phase = 'baseline') AS baseline, max(value) FILTER (phase = 'finetuned') AS finetuned FROM long GROUP BY model_key, metric""",
}
