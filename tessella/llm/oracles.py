"""DuckDB SQL for the training-data queries that SQL can express."""

from __future__ import annotations

_WORDS = r"regexp_extract_all({text}, '[^\x20\x09-\x0D]+')"
_DOCS = "d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents), w AS (SELECT doc_id, text, " + _WORDS.format(text="text") + " AS ws FROM d)"


def _windows(name: str, n: int) -> str:
    return f"{name} AS (SELECT doc_id, i, ws[i:i + {n - 1}] AS k FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - {n - 2})) AS i FROM w WHERE len(ws) >= {n}))"


#: A-Z only are folded: other letters stay as they are.
_FOLDED = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
OP4 = f"""WITH RECURSIVE w AS (SELECT doc_id, {_WORDS.format(text=_FOLDED)} AS ws FROM documents),
sh AS (SELECT DISTINCT doc_id, ws[i:i + 3] AS k FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 2)) AS i FROM w WHERE len(ws) >= 4) UNION SELECT doc_id, ws FROM w WHERE len(ws) BETWEEN 1 AND 3),
n AS (SELECT doc_id, count(*) AS n FROM sh GROUP BY doc_id),
both_ AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM sh a JOIN sh b ON a.k = b.k AND a.doc_id <> b.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM both_ JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 80 * (x.n + y.n - c)),
r(doc_id, o) AS (SELECT doc_id, doc_id FROM documents UNION SELECT r.doc_id, l.b FROM r JOIN l ON l.a = r.o),
m AS (SELECT doc_id, min(o) AS component_id FROM r GROUP BY doc_id)
SELECT doc_id, coalesce(n, 0) AS n_shingles, component_id, doc_id = component_id AS kept FROM m LEFT JOIN n USING (doc_id)"""

OP6 = f"""WITH {_DOCS}, {_windows("win", 13)},
f AS (SELECT k, min(doc_id) AS first FROM win GROUP BY k),
gone AS (SELECT DISTINCT doc_id, i + o AS pos FROM win JOIN f USING (k), range(13) t(o) WHERE first < doc_id),
x AS (SELECT doc_id, unnest(ws) AS word, unnest(range(1, len(ws) + 1)) AS pos FROM w),
s AS (SELECT doc_id, string_agg(word, ' ' ORDER BY pos) AS t, count(*) AS n FROM x ANTI JOIN gone USING (doc_id, pos) GROUP BY doc_id)
SELECT w.doc_id, CAST(len(ws) AS BIGINT) AS n_words, len(ws) - coalesce(n, 0) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256 FROM w LEFT JOIN s USING (doc_id)"""


def _repeat(n: int) -> str:
    """Positions and characters inside n-word windows that their text has twice or more."""
    return f"""{_windows(f"win{n}", n)},
cov{n} AS (SELECT DISTINCT doc_id, i + o AS pos FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, k) AS c FROM win{n}), range({n}) t(o) WHERE c > 1),
rep{n} AS (SELECT doc_id, count(*) AS n, sum(length(word)) AS c FROM x JOIN cov{n} USING (doc_id, pos) GROUP BY doc_id)"""


OP7 = f"""WITH {_DOCS}, x AS (SELECT doc_id, unnest(ws) AS word, unnest(range(1, len(ws) + 1)) AS pos FROM w),
tot AS (SELECT doc_id, count(*) AS n, sum(length(word)) AS c FROM x GROUP BY doc_id), {_repeat(5)}, {_repeat(8)}, {_repeat(13)},
ln AS (SELECT doc_id, line, count(*) AS k FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM d) WHERE regexp_matches(line, '[^\\x20\\x09-\\x0D]') GROUP BY doc_id, line),
li AS (SELECT doc_id, sum(k) AS lines, sum(k - 1) AS dup, sum((k - 1) * length(line)) AS chars FROM ln GROUP BY doc_id),
rn AS (SELECT doc_id, r, unnest(range(1, len(runs[r]) - 1)) AS o, runs[r] AS run FROM (SELECT doc_id, runs, unnest(range(1, len(runs) + 1)) AS r FROM (SELECT doc_id, regexp_extract_all(text, '[^\\p{{L}}\\p{{N}}]{{3,}}') AS runs FROM d))),
mw AS (SELECT doc_id, r, o, count(*) OVER (PARTITION BY doc_id, run[o:o + 2]) AS k FROM rn WHERE regexp_matches(run[o:o + 2], '[^\\x20\\x09-\\x0D]')),
mk AS (SELECT doc_id, count(*) AS marks FROM (SELECT DISTINCT doc_id, r, o + s FROM mw, range(3) t(s) WHERE k > 1) GROUP BY doc_id),
a AS (SELECT d.doc_id, d.text, coalesce(marks, 0) AS marks, coalesce(tot.n, 0) AS n, coalesce(tot.c, 0) AS c, coalesce(rep8.n, 0) AS r8, coalesce(lines, 0) AS lines, coalesce(dup, 0) AS dup, coalesce(chars, 0) AS chars,
  CAST(coalesce(rep5.c, 0) AS DOUBLE) / greatest(coalesce(tot.c, 0), 1) AS s5, CAST(coalesce(rep8.c, 0) AS DOUBLE) / greatest(coalesce(tot.c, 0), 1) AS s8, CAST(coalesce(rep13.c, 0) AS DOUBLE) / greatest(coalesce(tot.c, 0), 1) AS s13
  FROM d LEFT JOIN tot USING (doc_id) LEFT JOIN rep5 USING (doc_id) LEFT JOIN rep8 USING (doc_id) LEFT JOIN rep13 USING (doc_id) LEFT JOIN li USING (doc_id) LEFT JOIN mk USING (doc_id)),
b AS (SELECT *, n < 20 OR 100 * r8 > 30 * n AS base_failed FROM a)
SELECT doc_id, CAST(n AS BIGINT) AS n_words, CAST(c AS BIGINT) AS word_chars, CAST(length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols, CAST(dup AS BIGINT) AS n_dup_lines,
  CAST(r8 AS BIGINT) AS n_repeat_words, base_failed, greatest(s5, s8, s13) AS max_ngram_share, CAST(chars AS BIGINT) AS dup_line_chars, CAST(marks AS BIGINT) AS mark_chars,
  NOT (base_failed OR s5 > 0.3e0 OR s8 > 0.3e0 OR s13 > 0.25e0 OR marks > 0.1e0 * length(text) OR dup > 0.5e0 * lines OR chars > 0.4e0 * length(text)) AS kept FROM b"""

OP9 = """WITH RECURSIVE v AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
g AS (SELECT * FROM v WHERE label IS NOT NULL AND e IS NOT NULL AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(e, lambda x: x <> 0)) > 0),
l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM g a JOIN g b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e) WHERE list_cosine_similarity(a.e, b.e) >= 0.93e0),
r(vec_id, o) AS (SELECT vec_id, vec_id FROM v UNION SELECT r.vec_id, l.b FROM r JOIN l ON l.a = r.o),
m AS (SELECT vec_id, min(o) AS component_id FROM r GROUP BY vec_id), n AS (SELECT a AS vec_id, count(*) AS n FROM l GROUP BY a)
SELECT vec_id, coalesce(n, 0) AS n_links, component_id, vec_id = component_id AS kept FROM m LEFT JOIN n USING (vec_id)"""

_SAID = "'<|im_end|><|im_start|>assistant ok'"
#: The escape lengthens a text by one for each place with ``<``, backslashes and ``|``; a header by one for each of three characters.
OP11 = rf"""WITH t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
UNION ALL SELECT -1, 0, 'user', {_SAID} UNION ALL SELECT -1, 1, 'assistant', {_SAID}),
p AS (SELECT conv_id, count(*) AS n, string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text) AS told,
  coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '') AS learned,
  sum({len("<|im_start|>" + "<|im_end|>") + 2} + length(role) + length(regexp_replace(role, '[^\\<' || chr(10) || ']', '', 'g')) + length(regexp_replace(text, '<(\\*)\|', '<\1++', 'g'))) AS chars FROM t GROUP BY conv_id)
SELECT conv_id, n AS n_turns, sha256(told) AS turns_sha256, length(learned) AS loss_chars, sha256(learned) AS loss_sha256, CAST(chars AS BIGINT) AS formatted_chars FROM p"""

#: CRC-32 of a decimal number, bit by bit.
_CRC = """xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), list_transform(string_split(CAST({0} AS VARCHAR), ''), lambda c: CAST(ascii(c) AS BIGINT))),
  lambda a, b: list_reduce(list_prepend(xor(a, b), list_transform(range(8), lambda i: CAST(i AS BIGINT))), lambda x, i: xor(x >> 1, (x & 1) * 3988292384))), 4294967295)"""
OP13 = f"""WITH t AS (SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS p FROM conversations WHERE conv_id IS NOT NULL),
c AS (SELECT conv_id, {_CRC.format("conv_id")} % 6 AS h FROM (SELECT DISTINCT conv_id FROM t)),
b AS (SELECT c.conv_id, p, role, text FROM c JOIN t ON t.conv_id = c.conv_id - c.conv_id % 100 AND p <= h UNION ALL SELECT conv_id, p, role, text FROM t JOIN c USING (conv_id) WHERE p > h),
s AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY p) AS d, sha256(length(role) || ':' || role || text) AS item, length(text) AS n FROM b),
x AS (SELECT conv_id, 0 AS d, '' AS k, 0 AS n FROM c UNION ALL SELECT conv_id, d, string_agg(item, '') OVER (PARTITION BY conv_id ORDER BY d ROWS UNBOUNDED PRECEDING), n FROM s),
e AS (SELECT arg_max(k, d) AS k, conv_id FROM x GROUP BY conv_id), es AS (SELECT k, string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) AS ids FROM e GROUP BY k),
v AS (SELECT k, d, min(conv_id) AS conv_id, count(*) AS n_convs, max(n) AS n FROM x GROUP BY k, d),
ch AS (SELECT left(k, 64 * (d - 1)) AS k, count(*) AS n_children FROM v WHERE d > 0 GROUP BY 1),
sub AS (SELECT a.k, count(*) FILTER (ch.k IS NULL) AS n_leaves, sum((b.n_convs - 1) * b.n) AS saved FROM v a JOIN v b ON b.d >= a.d AND left(b.k, 64 * a.d) = a.k LEFT JOIN ch ON ch.k = b.k GROUP BY a.k)
SELECT v.conv_id, CAST(v.d AS BIGINT) AS depth, u.conv_id AS parent_conv_id, v.n_convs, coalesce(n_children, 0) AS n_children, n_leaves, CAST(saved AS BIGINT) AS saved_tokens, sha256(coalesce(ids, '')) AS ends_sha256
FROM v JOIN sub USING (k) LEFT JOIN v u ON v.d > 0 AND u.k = left(v.k, 64 * (v.d - 1)) LEFT JOIN ch ON ch.k = v.k LEFT JOIN es ON es.k = v.k"""

ORACLES = {"op4_minhash": OP4, "op6_substrings": OP6, "op7_quality_rules": OP7, "op9_embeddings": OP9, "op11_chat": OP11, "op13_prefix_trie": OP13}
