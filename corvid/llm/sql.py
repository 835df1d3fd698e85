"""SQL of the corpus operators' queries where SQL can express them."""

OP3 = r"""
WITH d AS (SELECT doc_id, row_number() OVER () AS r, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
s AS (SELECT r, unnest(range(1, len(w) - 33)) AS p, w FROM d WHERE len(w) >= 35),
h AS (SELECT r, p, md5(array_to_string(list_slice(w, p, p + 34), ' ')) AS h FROM s),
again AS (SELECT h FROM h GROUP BY h HAVING count(*) > 1),
hits AS (SELECT r, p FROM h WHERE h IN (SELECT h FROM again)),
gone AS (SELECT r, list_sort(list_distinct(flatten(list(range(p, p + 35))))) AS g FROM hits GROUP BY r),
flat AS (SELECT r, unnest(g) AS p FROM gone),
words AS (SELECT r, unnest(range(1, len(w) + 1)) AS p, unnest(w) AS x FROM d),
kept AS (SELECT r, string_agg(x, ' ' ORDER BY p) AS t FROM words ANTI JOIN flat USING (r, p) GROUP BY r)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(len(g), 0)::BIGINT AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
FROM d LEFT JOIN gone USING (r) LEFT JOIN kept USING (r)
"""

OP4 = r"""
WITH d AS (
  SELECT doc_id, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM documents
), i AS (
  SELECT item_id, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM benchmark
), k AS (SELECT DISTINCT least(len(w), 5) AS k FROM i WHERE len(w) > 0), ds AS (
  SELECT DISTINCT doc_id, k, array_to_string(list_slice(w, p, p + k - 1), ' ') AS s FROM (SELECT doc_id, k, w, unnest(range(1, len(w) - k + 2)) AS p FROM d JOIN k ON len(w) >= k)
), its AS (
  SELECT DISTINCT item_id, k, array_to_string(list_slice(w, p, p + k - 1), ' ') AS s FROM (SELECT item_id, least(len(w), 5) AS k, w, unnest(range(1, len(w) - least(len(w), 5) + 2)) AS p FROM i WHERE len(w) > 0)
), n AS (
  SELECT item_id, count(*) AS n_item FROM its GROUP BY item_id
)
SELECT ds.doc_id, its.item_id, count(*)::BIGINT AS n_matched, any_value(n.n_item)::BIGINT AS n_item, count(*) / any_value(n.n_item) AS containment
FROM ds JOIN its USING (k, s) JOIN n ON n.item_id = its.item_id
GROUP BY ds.doc_id, its.item_id HAVING count(*) * 100 >= any_value(n.n_item) * 75
"""

OP6 = r"""
WITH RECURSIVE d AS (SELECT doc_id, row_number() OVER () AS r, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
s AS (
  SELECT DISTINCT r, array_to_string(list_slice(w, p, p + 4), ' ') AS x FROM (SELECT r, w, unnest(range(1, len(w) - 3)) AS p FROM d WHERE len(w) >= 5)
  UNION ALL SELECT r, array_to_string(w, ' ') FROM d WHERE len(w) BETWEEN 1 AND 4
),
n AS (SELECT r, count(*) AS n FROM s GROUP BY r),
pairs AS (SELECT a.r AS a, b.r AS b, count(*) AS shared FROM s a JOIN s b ON a.x = b.x AND a.r <> b.r GROUP BY ALL),
links AS MATERIALIZED (SELECT a, b FROM pairs JOIN n x ON x.r = a JOIN n y ON y.r = b WHERE 100 * shared >= 75 * (x.n + y.n - shared)),
reach AS (SELECT r, r AS o FROM d UNION SELECT reach.r, links.b FROM reach JOIN links ON links.a = reach.o),
least AS (SELECT reach.r, min(d.doc_id) AS component_id FROM reach JOIN d ON d.r = reach.o GROUP BY reach.r)
SELECT doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, component_id FROM d LEFT JOIN n USING (r) JOIN least USING (r)
"""

_ESCAPE = r"regexp_replace({0}, '([<\[])(\\*)(\||/?s>|/?INST\]|<SYS>>|</SYS>>|/?think>|/?tool_call>)', '\1\\\2\3', 'g')"

OP5 = rf"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL VALUES (-1, 0, 'user', '</s>[INST] ok [/INST]'), (-1, 1, 'assistant', '</s>[INST] ok [/INST]')
)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars, sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  sum(24 + length({_ESCAPE.format(r"replace(replace(role, '\', '\\'), chr(10), '\n')")}) + length({_ESCAPE.format("text")}))::BIGINT AS formatted_chars
FROM c GROUP BY conv_id
"""

_OP2_SPACES = r"[\x20\x09-\x0D]+"
OP2 = rf"""
WITH a AS (SELECT doc_id, coalesce(source::VARCHAR, '') AS host, coalesce(text, '') AS t FROM documents),
x AS (SELECT row_number() OVER () AS r, host, t, list_filter(regexp_split_to_array(t, '{_OP2_SPACES}'), lambda x: x <> '') AS w FROM (SELECT DISTINCT host, t FROM a)),
win AS (SELECT r, p, array_to_string(list_slice(w, p, p + 4), ' ') AS s FROM (SELECT r, w, unnest(range(1, len(w) - 3)) AS p FROM x WHERE len(w) >= 5)),
twice AS (SELECT r, s FROM win GROUP BY r, s HAVING count(*) > 1),
rep AS (SELECT r, count(DISTINCT q) AS n FROM (SELECT r, unnest(range(p, p + 5)) AS q FROM win JOIN twice USING (r, s)) GROUP BY r),
ln AS (SELECT r, host, l, trim(regexp_replace(regexp_replace(translate(l, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9]', '0', 'g'), '{_OP2_SPACES}', ' ', 'g')) AS norm FROM (SELECT r, host, unnest(string_split(t, chr(10))) AS l FROM x)),
dup AS (SELECT r, count(*) - count(DISTINCT l) AS n FROM ln WHERE norm <> '' GROUP BY r),
docs_of AS (SELECT host, count(*) AS docs FROM x GROUP BY host),
often AS (SELECT host, norm FROM ln JOIN docs_of USING (host) WHERE norm <> '' GROUP BY host, norm, docs HAVING count(DISTINCT r) > 10 AND count(DISTINCT r) > docs * 1.0 / 100),
lost AS (SELECT r, sum(length(norm) - length(replace(norm, ' ', '')) + 1) AS n FROM ln JOIN often USING (host, norm) GROUP BY r),
v AS (SELECT host, t, len(w)::BIGINT AS n_words, coalesce(list_sum(list_transform(w, lambda y: length(y))), 0)::BIGINT AS word_chars, (length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
  coalesce(dup.n, 0)::BIGINT AS n_dup_lines, coalesce(rep.n, 0)::BIGINT AS n_repeat_words, coalesce(lost.n, 0)::BIGINT AS n_line_words FROM x LEFT JOIN rep USING (r) LEFT JOIN dup USING (r) LEFT JOIN lost USING (r)),
f AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM v)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND 100 * (n_words - n_line_words) >= 30 * n_words AS kept, n_line_words
FROM a JOIN f USING (host, t)
"""

_FIELDS = " || ".join(f"coalesce(strlen({c}::VARCHAR) || ':' || {c}::VARCHAR, '-')" for c in ("doc_id", "source", "lang", "n_chars", "{text}"))
_CRC = """list_reduce(list_concat([4294967295::UBIGINT], list_transform(range(1, length(doc_id::VARCHAR) + 1), lambda i: ascii(substr(doc_id::VARCHAR, i, 1))::UBIGINT)),
  lambda c, b: list_reduce(list_concat([xor(c, b)], list_transform(range(8), lambda k: k::UBIGINT)), lambda x, k: xor(x >> 1, 3988292384::UBIGINT * (x & 1))))"""
OP11 = f"""
WITH RECURSIVE d AS MATERIALIZED (SELECT doc_id, lang, sha256({_FIELDS.format(text="text")}) AS leaf,
  CASE WHEN xor({_CRC}, 4294967295) % 3 = 0 THEN sha256({_FIELDS.format(text="translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")}) END AS other FROM documents),
g AS (SELECT lang, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS tree, count(*) AS n FROM d GROUP BY lang),
p AS MATERIALIZED (SELECT doc_id, leaf, coalesce(other, leaf) AS found, tree, n, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos FROM d JOIN g ON d.lang IS NOT DISTINCT FROM g.lang),
lv AS (
  SELECT 0 AS l, tree, pos, leaf AS node, n FROM p
  UNION ALL SELECT l + 1, tree, pos // 8, sha256(string_agg(node, '' ORDER BY pos)), (n + 7) // 8 FROM lv WHERE n > 1 GROUP BY l, tree, pos // 8, n
), inner_runs AS MATERIALIZED (SELECT l, tree, pos // 8 AS run, string_agg(node, '' ORDER BY pos) AS members FROM lv WHERE n > 1 GROUP BY l, tree, pos // 8),
subs AS MATERIALIZED (SELECT tree, node AS subroot FROM lv WHERE n = 1),
up AS (
  SELECT 0 AS l, tree AS pos, subroot AS node, (SELECT count(*) FROM subs) AS n FROM subs
  UNION ALL SELECT l + 1, pos // 8, sha256(string_agg(node, '' ORDER BY pos)), (n + 7) // 8 FROM up WHERE n > 1 GROUP BY l, pos // 8, n
), outer_runs AS MATERIALIZED (SELECT l, pos // 8 AS run, string_agg(node, '' ORDER BY pos) AS members FROM up WHERE n > 1 GROUP BY l, pos // 8),
fold AS (
  SELECT 0 AS l, tree, pos, pos AS here, found AS node, '' AS proof FROM p
  UNION ALL SELECT f.l + 1, f.tree, f.pos, f.here // 8, sha256(substr(members, 1, 64 * (here % 8)) || node || substr(members, 64 * (here % 8) + 65)), proof || substr(members, 1, 64 * (here % 8)) || substr(members, 64 * (here % 8) + 65)
  FROM fold f JOIN inner_runs r ON r.l = f.l AND r.tree = f.tree AND r.run = f.here // 8
), inside AS MATERIALIZED (SELECT tree, pos, arg_max(node, l) AS node, arg_max(proof, l) AS proof FROM fold GROUP BY tree, pos),
fold2 AS (
  SELECT 0 AS l, tree, pos, tree AS here, node, proof FROM inside
  UNION ALL SELECT f.l + 1, f.tree, f.pos, f.here // 8, sha256(substr(members, 1, 64 * (here % 8)) || node || substr(members, 64 * (here % 8) + 65)), proof || substr(members, 1, 64 * (here % 8)) || substr(members, 64 * (here % 8) + 65)
  FROM fold2 f JOIN outer_runs r ON r.l = f.l AND r.run = f.here // 8
), done AS (SELECT tree, pos, arg_max(node, l) AS folded_root, sha256(arg_max(proof, l)) AS proof_sha256 FROM fold2 GROUP BY tree, pos)
SELECT doc_id, leaf, subroot, (SELECT node FROM up WHERE n = 1) AS root, proof_sha256, folded_root, folded_root = (SELECT node FROM up WHERE n = 1) AS verified
FROM p JOIN subs USING (tree) JOIN done USING (tree, pos)
"""


def op12(parts: int = 8, entries: int = 16, rounds: int = 6, scale: int = 4096) -> str:
    """The rounds of the codebooks, one after the other."""
    near = f"""SELECT r, p, min(d * {entries} + k) AS m FROM (
  SELECT r, p, k, list_sum(list_transform(list_zip(v, c), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::BIGINT AS d FROM parts JOIN b{{0}} USING (p)) GROUP BY r, p"""
    ctes = [
        """kept AS MATERIALIZED (SELECT row_number() OVER (ORDER BY vec_id, embedding) AS r, vec_id, label, embedding AS e FROM embeddings
  WHERE embedding IS NOT NULL AND list_bool_and(list_transform(embedding, lambda x: x IS NOT NULL AND isfinite(x))))""",
        f"""parts AS MATERIALIZED (SELECT r, p, list_transform(list_slice(e, p * len(e) // {parts} + 1, (p + 1) * len(e) // {parts}), lambda x: floor({scale} * x::DOUBLE)::BIGINT) AS v
  FROM kept, (SELECT unnest(range({parts})) AS p))""",
        f"b0 AS MATERIALIZED (SELECT p, r - 1 AS k, v AS c FROM parts WHERE r <= {entries})",
    ]
    for t in range(rounds):
        ctes.append(f"a{t} AS MATERIALIZED ({near.format(t)})")
        ctes.append(f"""b{t + 1} AS MATERIALIZED (SELECT p, k, coalesce(n.c, b{t}.c) AS c FROM b{t} LEFT JOIN (
  SELECT p, k, list(((s - ((s % n) + n) % n) // n)::BIGINT ORDER BY i) AS c FROM (
    SELECT p, k, i, sum(x) AS s, count(*) AS n FROM (SELECT p, m % {entries} AS k, unnest(range(len(v))) AS i, unnest(v) AS x FROM a{t} JOIN parts USING (r, p)) GROUP BY p, k, i)
  GROUP BY p, k) n USING (p, k))""")
    return f"""
WITH {", ".join(ctes)}, a AS ({near.format(rounds)}),
codes AS (SELECT r, string_agg(printf('%02x', m % {entries}), '' ORDER BY p) AS code, sum(m // {entries})::BIGINT AS error FROM a GROUP BY r),
books AS (SELECT sha256(string_agg(array_to_string(c, ','), ',' ORDER BY p, k)) AS codebooks_sha256 FROM b{rounds})
SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error, codebooks_sha256 FROM kept JOIN codes USING (r), books
"""
