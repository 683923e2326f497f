"""The queries of this subpackage, and SQL for those that SQL can express.

Without SQL, and tested against brute force instead: recurrent scores (op1), fuzzy notices (op4), path templates (op7), merges of a tokenizer
file (op8), image descriptors (op9), and the iterated mix (op10).
"""

from __future__ import annotations

from .byte_pair import op8_byte_pair
from .image_copies import op9_media_columns
from .license_scan import op4_license_scan
from .lm_scoring import op1_lm_scoring
from .mixing import op10_mixing
from .ngram_join import op6_ngram_join
from .quality_rules import HOST_LIMIT, MAX_REPEAT_PERCENT, MIN_WORDS, SOFT_RULES, op5_quality_rules
from .token_files import op3_token_counts
from .url_templates import op7_url_templates
from .warc import op2_warc

QUERIES = {
    "op1_lm_scoring": op1_lm_scoring,
    "op2_warc": op2_warc,
    "op3_token_counts": op3_token_counts,
    "op4_license_scan": op4_license_scan,
    "op5_quality_rules": op5_quality_rules,
    "op6_ngram_join": op6_ngram_join,
    "op7_url_templates": op7_url_templates,
    "op8_byte_pair": op8_byte_pair,
    "op9_media_columns": op9_media_columns,
    "op10_mixing": op10_mixing,
}

_SPACE = r"[\x20\x09-\x0D]"
_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def _words(text: str) -> str:
    return f"list_filter(string_split_regex({text}, '{_SPACE}+'), lambda x: x <> '')"


def _base32(digits: str) -> str:
    """Upper-case base32 of 40 hexadecimal digits."""
    letter = "substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + ((CAST('0x' || substr({d}, {at}, 5) AS BIGINT) >> {shift}) & 31), 1)"
    return " || ".join(letter.format(d=digits, at=5 * k + 1, shift=s) for k in range(8) for s in (15, 10, 5, 0))


_OP2 = f"""
WITH p AS (SELECT page_id, coalesce(html, '') AS body FROM pages),
f AS (SELECT body, min(page_id) AS first FROM p GROUP BY body)
SELECT page_id, CAST(octet_length(encode(body)) AS BIGINT) AS payload_bytes, {_base32("sha1(body)")} AS payload_digest, CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id <> first THEN first END AS refers_to, true AS intact
FROM p JOIN f USING (body)
"""

_OP3 = f"SELECT doc_id, CAST(len({_words("coalesce(text, '')")}) AS BIGINT) AS n_tokens FROM documents"

_MOMENTS = ", ".join(f"sum({r}) / sum(docs) AS {r}_m, greatest(sum({r} / docs * {r}) / sum(docs) - (sum({r}) / sum(docs)) * (sum({r}) / sum(docs)), 0) AS {r}_v" for r in SOFT_RULES)


def _shrunk(r: str) -> str:
    strength = f"(CASE WHEN {r}_v > 0 THEN least(greatest({r}_m * (1 - {r}_m) / {r}_v - 1, 1), 1000) ELSE 1000 END)"
    return f"({r} + {r}_m * {strength}) / (docs + {strength})"


_OP5 = f"""
WITH w AS (SELECT doc_id, source, coalesce(text, '') AS text, {_words("coalesce(text, '')")} AS w FROM documents),
windows AS (SELECT doc_id, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM w WHERE len(w) >= 3)),
twice AS (SELECT doc_id, i FROM windows JOIN (SELECT doc_id, g FROM windows GROUP BY ALL HAVING count(*) > 1) USING (doc_id, g)),
repeated AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS p FROM twice) GROUP BY 1),
m AS (SELECT w.doc_id, source, CAST(len(w) AS BIGINT) AS n_words, CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars, CAST(length(text) - length(translate(text, '#*$%&|<>', '')) AS BIGINT) AS n_symbols,
    list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS lines, CAST(coalesce(n, 0) AS BIGINT) AS n_repeat_words FROM w LEFT JOIN repeated ON repeated.doc_id = w.doc_id),
l AS (SELECT * EXCLUDE lines, CAST(len(lines) AS BIGINT) AS n_lines, CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines FROM m),
r AS (SELECT *, n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_REPEAT_PERCENT} * n_words AS base_failed, {", ".join(f"CAST({rule} AS INT) AS {name}" for name, rule in SOFT_RULES.items())} FROM l),
h AS (SELECT source, count(*) AS docs, {", ".join(f"sum({r}) AS {r}" for r in SOFT_RULES)} FROM r GROUP BY 1),
v AS (SELECT source, docs, greatest({", ".join(_shrunk(r) for r in SOFT_RULES)}, 0) > {HOST_LIMIT} AS strict FROM h CROSS JOIN (SELECT {_MOMENTS} FROM h))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND {" + ".join(f"r.{x}" for x in SOFT_RULES)} <= (CASE WHEN strict THEN 0 ELSE 1 END) AS kept, n_lines, docs AS host_docs, strict
FROM r JOIN v ON r.source IS NOT DISTINCT FROM v.source
"""

_OP6 = f"""
WITH RECURSIVE w AS (SELECT doc_id, {_words(_LOWER.format("coalesce(text, '')"))} AS w FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) >= 5 THEN list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS g FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 80 * (x.n + y.n - c)),
r(id, top) AS (SELECT doc_id, doc_id FROM documents UNION SELECT l.b, r.top FROM r JOIN l ON l.a = r.id)
SELECT id AS doc_id, coalesce(any_value(n.n), 0) AS n_shingles, min(top) AS component_id FROM r LEFT JOIN n ON n.doc_id = id GROUP BY id
"""

SQL: dict[str, str] = {"op2_warc": _OP2, "op3_token_counts": _OP3, "op5_quality_rules": _OP5, "op6_ngram_join": _OP6}
