"""DuckDB SQL of those numbered queries that SQL can express."""

from __future__ import annotations

import math
import re

from barloom.llm.embedding_dedup import THRESHOLD as NEAR
from barloom.llm.license_texts import KEYS, TEMPLATES
from barloom.llm.licenses import PHRASES, THRESHOLD, longer, step_of

_WORDS = r"'[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'"


def _list(words: list[str]) -> str:
    return "[" + ", ".join(f"'{w}'" for w in words) + "]"


def licenses_sql() -> str:
    """Every block of every text against every template, and every place of every phrase."""
    phrases = ", ".join(f"({_list(p.split())}, '{label}')" for p, label in PHRASES.items())
    rows = []
    above = longer(TEMPLATES)
    for i, (label, text) in enumerate(TEMPLATES):
        words = re.findall("[0-9a-z]+", text.lower())
        own = sorted(set(words))
        rows.append(f"({i}, {above[i] or '[-1]'}, {_list(own)}, '{label}', {step_of(len(words))}, {math.ceil(THRESHOLD * len(own) - 1e-9)})")
    keys = " ".join(
        f"WHEN label = '{label}' THEN " + " OR ".join("(" + " AND ".join(f"contains(t, ' {p} ')" for p in ps) + ")" for ps in lists) for label, lists in KEYS.items()
    )
    return f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
w AS MATERIALIZED (SELECT r, doc_id, regexp_extract_all(t, {_WORDS}) AS w FROM d),
phrases(ws, label) AS (VALUES {phrases}),
places AS (
  SELECT r, label, list_filter(range(0, greatest(0, len(w) - len(ws) + 1)), lambda i: w[i + 1 : i + len(ws)] = ws) AS places FROM w, phrases),
base AS (
  SELECT r, CAST(sum(len(places)) AS BIGINT) AS n_base, min(list_min(places)) AS first_word, max(list_max(places)) AS last_word,
         coalesce(list(DISTINCT label) FILTER (WHERE len(places) > 0), []) AS base FROM places GROUP BY r),
templates(i, above, ws, label, step, need) AS (VALUES {', '.join(rows)}),
blocks AS (
  SELECT r, i, above, label, need, len(ws) AS n, concat(' ', array_to_string(w, ' '), ' ') AS t,
         list_max([len(list_intersect(w[k * step + 1 : (k + 2) * step], ws)) for k in range(0, (len(w) - 1) // step + 1)]) AS held FROM w, templates WHERE len(w) >= need),
met AS MATERIALIZED (SELECT r, i, above, label, CAST(held AS DOUBLE) / n AS share FROM blocks WHERE held >= need AND CASE {keys} ELSE true END),
found AS (
  SELECT r, list(DISTINCT label) AS found, max(share) AS most FROM met WHERE NOT EXISTS (SELECT 1 FROM met o WHERE o.r = met.r AND list_contains(met.above, o.i)) GROUP BY r)
SELECT w.doc_id, CAST(len(w.w) AS BIGINT) AS n_words, n_base, first_word, last_word,
       array_to_string(list_sort(base), ',') AS base_labels,
       array_to_string(list_sort(list_distinct(list_concat(base, coalesce(found, [])))), ',') AS labels,
       CASE WHEN n_base > 0 THEN 1.0::DOUBLE ELSE coalesce(most, 0.0::DOUBLE) END AS score
FROM w JOIN base USING (r) LEFT JOIN found USING (r)"""


def embeddings_sql() -> str:
    """All pairs of a label, then the smallest id that each vector reaches."""
    return f"""
WITH RECURSIVE e AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings),
usable AS (
  SELECT * FROM e WHERE label IS NOT NULL AND len(v) > 0 AND len(list_filter(v, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(v, lambda x: x <> 0)) > 0),
pairs AS MATERIALIZED (
  SELECT a.vec_id AS u, b.vec_id AS w FROM usable a JOIN usable b
    ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.v) = len(b.v) AND list_cosine_similarity(a.v, b.v) >= {NEAR}),
reach(u, w) AS (SELECT vec_id, vec_id FROM e UNION SELECT r.u, p.w FROM reach r JOIN pairs p ON p.u = r.w),
least AS (SELECT u, min(w) AS component_id FROM reach GROUP BY u),
links AS (SELECT u, count(*) AS n FROM pairs GROUP BY u)
SELECT vec_id, coalesce(n, 0) AS n_links, component_id, vec_id = component_id AS kept
FROM e JOIN least ON least.u = vec_id LEFT JOIN links ON links.u = vec_id"""


ORACLES = {"op2_licenses": licenses_sql(), "op7_embedding_dedup": embeddings_sql()}
