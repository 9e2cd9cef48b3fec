"""The licence scan of ``documents`` as DuckDB SQL."""

from __future__ import annotations

from .licenses import TEMPLATES


def document_path() -> str:
    """A path for each document, in the SQL that Spark and DuckDB share.

    Directories are source, language and blocks of a thousand ids; every
    twentieth document is a licence file one to three levels deep.
    """
    return """concat(coalesce(source, ''), CASE WHEN doc_id % 20 <> 0 OR doc_id % 40 = 0 THEN concat('/', coalesce(lang, '')) ELSE '' END,
      CASE WHEN doc_id % 20 <> 0 OR doc_id % 80 = 0 THEN concat('/', CAST(floor(doc_id / 1000) AS BIGINT)) ELSE '' END,
      CASE WHEN doc_id % 20 = 0 THEN concat('/LICENSE-', doc_id) ELSE concat('/', doc_id, '.txt') END)"""


def oracle() -> str:
    values = ", ".join(f"({i}, '{name}', '{kind}', '{text}')" for i, (name, kind, text) in enumerate(TEMPLATES))
    return rf"""
WITH templates(template, name, kind, said) AS (VALUES {values}),
files AS (SELECT doc_id, {document_path()} AS path, coalesce(text, '') AS text FROM documents),
words AS (SELECT template, name, kind, term, count(*) AS tf FROM (
  SELECT template, name, kind, unnest(regexp_extract_all(lower(said), '\p{{L}}+|[0-9]+(?:\.[0-9]+)*')) AS term FROM templates) GROUP BY ALL),
total AS (SELECT (SELECT count(*) FROM files) + (SELECT count(*) FROM templates) AS n),
held AS (SELECT term, count(*) AS files FROM (
  SELECT DISTINCT doc_id, unnest(regexp_extract_all(lower(text), '\p{{L}}+|[0-9]+(?:\.[0-9]+)*')) AS term FROM files
  UNION ALL SELECT DISTINCT -1 - template, term FROM words) GROUP BY 1),
idfs AS (SELECT term, ln((n + 1)::DOUBLE / (files + 1)) AS idf FROM held, total),
weights AS (SELECT template, name, kind, term, tf * idf / sqrt(sum(tf * idf * tf * idf) OVER (PARTITION BY template)) AS weight FROM words JOIN idfs USING (term)),
parts AS (
  SELECT doc_id, i AS part, s[i] AS said FROM (
    SELECT doc_id, s, unnest(range(1, len(s) + 1)) AS i FROM (
      SELECT doc_id, list_concat(string_split(regexp_replace(text, '([.!?])[ \t\r\n]+', '\1' || chr(10), 'g'), chr(10)),
        list_filter(string_split_regex(text, '\n[^\p{{L}}\p{{N}}\n]*\n'), lambda x: contains(x, chr(10)))) AS s FROM files))
  UNION ALL SELECT doc_id, -1, text FROM files WHERE doc_id % 20 = 0),
terms AS (SELECT doc_id, part, term, count(*) AS tf FROM (
  SELECT doc_id, part, unnest(regexp_extract_all(lower(said), '\p{{L}}+|[0-9]+(?:\.[0-9]+)*')) AS term FROM parts) GROUP BY ALL),
weighed AS (SELECT doc_id, part, term, tf * idf AS w FROM terms JOIN idfs USING (term)),
norms AS (SELECT doc_id, part, sqrt(sum(w * w)) AS norm FROM weighed GROUP BY ALL),
scores AS (
  SELECT doc_id, template, name, kind, sum(w * weight) / any_value(norm) AS score
  FROM weighed JOIN weights USING (term) JOIN norms USING (doc_id, part)
  WHERE (kind = 'text') = (part = -1) AND (kind <> 'title' OR doc_id % 20 = 0) GROUP BY doc_id, part, template, name, kind),
own AS (
  SELECT doc_id, name AS own_license, round(score, 6) AS own_score FROM scores WHERE round(score, 9) >= 0.6
  QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY kind <> 'notice' DESC, round(score, 9) DESC, template) = 1),
named AS (SELECT doc_id, path, regexp_replace(path, '/?[^/]*$', '') AS dir, own_license, own_score FROM files LEFT JOIN own USING (doc_id)),
given AS (
  SELECT dir AS above, own_license AS given FROM named WHERE doc_id % 20 = 0 AND own_license IS NOT NULL
  QUALIFY row_number() OVER (PARTITION BY dir ORDER BY own_score DESC, own_license) = 1),
ways AS (
  SELECT DISTINCT dir, d AS depth, array_to_string(steps[1:d], '/') AS above FROM (
    SELECT dir, steps, unnest(range(0, len(steps) + 1)) AS d FROM (SELECT DISTINCT dir, string_split(dir, '/') AS steps FROM named))),
nearest AS (
  SELECT dir, above, given FROM ways JOIN given USING (above) QUALIFY row_number() OVER (PARTITION BY dir ORDER BY depth DESC) = 1)
SELECT doc_id, path, own_license, own_score, CASE WHEN own_license IS NULL THEN above END AS inherited_from, coalesce(own_license, given) AS license
FROM named LEFT JOIN nearest USING (dir)
"""
