"""DuckDB SQL for the queries that SQL can express."""

LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
WORDS = "regexp_extract_all(" + LOWER.format("coalesce(text, '')") + r", '[^\x20\x09-\x0D]+')"

_SETS = f"""
words AS (SELECT doc_id, {WORDS} AS w FROM {{docs}}),
sets AS (SELECT doc_id, CASE WHEN len(w) >= 5 THEN list_distinct([array_to_string(w[i:i+4], ' ') FOR i IN range(1, len(w) - 3)])
                             WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END AS s FROM words)"""

_LINKS = """
items AS (SELECT doc_id, len(s) AS n, unnest(s) AS g FROM sets),
links AS (SELECT x.doc_id AS a, y.doc_id AS b FROM items x JOIN items y ON x.g = y.g AND x.doc_id < y.doc_id
          GROUP BY 1, 2, x.n, y.n HAVING 100 * count(*) >= 75 * (x.n + y.n - count(*))),
edges AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach(id, other) AS (SELECT a, b FROM edges UNION SELECT r.id, e.b FROM reach r JOIN edges e ON r.other = e.a)"""

JACCARD_JOIN = f"""WITH RECURSIVE {_SETS.format(docs="documents")}, {_LINKS}
SELECT s.doc_id, len(s.s)::BIGINT AS n_shingles, least(s.doc_id, coalesce(min(r.other), s.doc_id)) AS component_id
FROM sets s LEFT JOIN reach r ON r.id = s.doc_id GROUP BY s.doc_id, s.s"""

_W = r"\x20\x09-\x0D"
_PIECE = rf"[{_W}]*(?:[^{_W}]*[^{_W}.!?][\x20\x09\x0B-\x0D]+)*[^{_W}]+"

SPAN_DEDUP = rf"""WITH docs AS (SELECT row_number() OVER () AS row, doc_id, text, regexp_extract_all(coalesce(text, ''), '{_PIECE}') AS parts FROM documents),
sentences AS (SELECT row, doc_id, unnest(parts) AS raw, unnest(range(1, len(parts) + 1)) AS i FROM docs),
counted AS (SELECT row, doc_id, i, raw, list_transform(regexp_extract_all(raw, '[^{_W}]+'), lambda w: {LOWER.format("w")}) AS w FROM sentences),
summed AS (SELECT *, sum(len(w)) OVER (PARTITION BY row ORDER BY i) AS total FROM counted),
ends AS (SELECT a.row, a.i, min(b.i) AS j FROM summed a JOIN summed b ON a.row = b.row AND b.i >= a.i AND b.total >= a.total - len(a.w) + 20 GROUP BY 1, 2),
starts AS (SELECT a.row, max(b.i) AS i, a.i AS j FROM summed a JOIN summed b ON a.row = b.row AND b.i <= a.i AND a.total - b.total + len(b.w) >= 20 GROUP BY 1, 3),
runs AS (SELECT row, i, j FROM ends UNION SELECT row, i, j FROM starts),
spans AS (SELECT e.row, any_value(s.doc_id) AS doc_id, e.i, e.j, string_agg(array_to_string(s.w, ' '), ' ' ORDER BY s.i) AS key FROM runs e JOIN counted s ON s.row = e.row AND s.i BETWEEN e.i AND e.j GROUP BY e.row, e.i, e.j),
later AS (SELECT row, i, j FROM spans QUALIFY doc_id > min(doc_id) OVER (PARTITION BY key) OR row_number() OVER (PARTITION BY key, row ORDER BY i) > 1),
gone AS (SELECT DISTINCT row, unnest(range(i, j + 1)) AS i FROM later),
kept AS (SELECT c.row, count(*) AS n, count(g.i) AS removed, coalesce(string_agg(CASE WHEN g.i IS NULL THEN c.raw END, '' ORDER BY c.i), '') AS text FROM counted c LEFT JOIN gone g USING (row, i) GROUP BY 1)
SELECT d.doc_id, CASE WHEN coalesce(removed, 0) = 0 THEN d.text ELSE k.text || regexp_extract(d.text, '[{_W}]*$') END AS text, coalesce(n, 0)::BIGINT AS n_sentences, coalesce(removed, 0)::BIGINT AS n_removed, coalesce(removed, 0) > 0 AS changed
FROM docs d LEFT JOIN kept k USING (row)"""

LINE_DEDUP = rf"""WITH docs AS (SELECT row_number() OVER () AS row, doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
cut AS (SELECT row, unnest(lines) AS line, unnest(range(len(lines))) AS place FROM docs),
keyed AS (SELECT *, {LOWER.format(f"regexp_replace(line, '^[{_W}]+|[{_W}]+$', '', 'g')")} AS key FROM cut),
common AS (SELECT key FROM keyed WHERE length(key) >= 1 GROUP BY key HAVING count(DISTINCT row) >= 10),
kept AS (SELECT row, string_agg(line, chr(10) ORDER BY place) AS text, count(*) AS n FROM keyed ANTI JOIN common USING (key) GROUP BY row)
SELECT doc_id, len(lines)::BIGINT AS n_lines, (len(lines) - coalesce(n, 0))::BIGINT AS n_dropped, sha256(coalesce(text, '')) AS kept_sha256 FROM docs LEFT JOIN kept USING (row)"""

#: crc32 of a string of digits; its polynomial is a fixed value.
_CRC = "xor(4294967295, list_reduce(list_concat([4294967295], list_transform(string_split({0}, ''), lambda c: ascii(c)::BIGINT)), lambda s, b: list_reduce(list_concat([xor(s, b)], list_transform(range(8), lambda i: i)), lambda t, _: xor(t >> 1, 3988292384 * (t & 1)))))"


def _leaf(text: str) -> str:
    fields = ("doc_id::VARCHAR", "source", "lang", "n_chars::VARCHAR", text)
    return "sha256(" + " || ".join(f"coalesce(strlen({f})::VARCHAR || ':' || {f}, '-')" for f in fields) + ")"


def _tree(name: str, leaves: str) -> str:
    """Levels of trees (tree, place, n, digest, presented), the siblings' digests of every leaf, and its way up, as {name}_nodes, _proofs and _path."""
    return f"""{name}_nodes(tree, level, place, n, digest) AS (SELECT tree, 0, place, n, digest FROM {leaves}
  UNION ALL SELECT tree, level + 1, place // 3, (n + 2) // 3, sha256(string_agg(digest, '' ORDER BY place)) FROM {name}_nodes WHERE n > 1 GROUP BY tree, level, place // 3, n),
{name}_proofs AS (SELECT l.tree, l.place, coalesce(string_agg(x.digest, '' ORDER BY x.level, x.place), '') AS proof FROM {leaves} l
  LEFT JOIN {name}_nodes x ON x.tree = l.tree AND x.place // 3 = l.place // pow(3, x.level + 1)::BIGINT AND x.place <> l.place // pow(3, x.level)::BIGINT GROUP BY 1, 2),
{name}_path(tree, leaf_place, level, place, n, presented) AS (SELECT tree, place, 0, place, n, presented FROM {leaves}
  UNION ALL SELECT p.tree, p.leaf_place, p.level + 1, p.place // 3, (p.n + 2) // 3, sha256(string_agg(CASE WHEN x.place = p.place THEN p.presented ELSE x.digest END, '' ORDER BY x.place))
  FROM {name}_path p JOIN {name}_nodes x ON x.tree = p.tree AND x.level = p.level AND x.place // 3 = p.place // 3
  WHERE p.n > 1 GROUP BY p.tree, p.leaf_place, p.level, p.place, p.n, p.presented)"""


MERKLE = f"""WITH RECURSIVE cut AS (SELECT *, CASE WHEN {_CRC.format("doc_id::VARCHAR")} % 2 = 0 THEN replace(text, chr(10), '') ELSE text END AS less FROM documents),
digests AS (SELECT doc_id, source, {_leaf("text")} AS digest, {_leaf("less")} AS presented FROM cut),
numbered AS (SELECT *, dense_rank() OVER (ORDER BY source NULLS FIRST) - 1 AS tree, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, digest) - 1 AS place, count(*) OVER (PARTITION BY source) AS n FROM digests),
{_tree("low", "numbered")},
subroots AS (SELECT tree, digest FROM low_nodes WHERE n = 1),
tops AS (SELECT 0 AS tree, tree AS place, (SELECT count(*) FROM subroots) AS n, digest, NULL::VARCHAR AS presented FROM subroots),
{_tree("high", "tops")},
reached AS (SELECT tree, leaf_place, presented FROM low_path WHERE n = 1),
ends AS (SELECT r.tree, r.leaf_place, r.presented = s.digest AS same FROM reached r JOIN subroots s USING (tree)),
changed AS (SELECT 0 AS tree, e.leaf_place AS leaf_place, e.tree AS low_tree, r.presented FROM ends e JOIN reached r USING (tree, leaf_place) WHERE NOT e.same),
up(low_tree, leaf_place, level, place, n, presented) AS (SELECT low_tree, leaf_place, 0, low_tree, (SELECT count(*) FROM subroots), presented FROM changed
  UNION ALL SELECT u.low_tree, u.leaf_place, u.level + 1, u.place // 3, (u.n + 2) // 3, sha256(string_agg(CASE WHEN x.place = u.place THEN u.presented ELSE x.digest END, '' ORDER BY x.place))
  FROM up u JOIN high_nodes x ON x.level = u.level AND x.place // 3 = u.place // 3 WHERE u.n > 1 GROUP BY u.low_tree, u.leaf_place, u.level, u.place, u.n, u.presented),
root AS (SELECT digest FROM high_nodes WHERE n = 1),
folds AS (SELECT low_tree AS tree, leaf_place AS place, presented FROM up WHERE n = 1)
SELECT doc_id, l.digest AS leaf, s.digest AS subroot, root.digest AS root, sha256(p.proof || h.proof) AS proof_sha256, coalesce(f.presented, root.digest) AS folded_root, coalesce(f.presented, root.digest) = root.digest AS verified
FROM numbered l JOIN subroots s USING (tree) JOIN low_proofs p USING (tree, place) JOIN high_proofs h ON h.place = l.tree LEFT JOIN folds f ON f.tree = l.tree AND f.place = l.place CROSS JOIN root"""


def license_scan() -> str:
    """The scan in SQL; grams are compared as words, not as hashes."""
    from feedloom.llm.license_scan import K, SHARE, SLIP, STRETCH, template_rows

    rows = ", ".join(f"({t}, {base}, '{label}', {length}, {total}, {place}, '{' '.join(g)}')" for t, base, label, length, total, place, *g in template_rows())
    return rf"""WITH templates(template, base, label, length, total, place, gram) AS (VALUES {rows}),
words AS (SELECT row_number() OVER () AS row, doc_id, regexp_extract_all({LOWER.format("coalesce(text, '')")}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
places AS (SELECT row, w, unnest(range(0, len(w) - {K - 1})) AS p FROM words),
grams AS (SELECT row, p, array_to_string(w[p + 1:p + {K}], ' ') AS gram FROM places),
diagonals AS (SELECT row, template, base, label, length, total, p - place AS diagonal, count(*) AS votes, min(p) AS first, max(p) AS last FROM grams JOIN templates USING (gram) GROUP BY 1, 2, 3, 4, 5, 6, 7),
marked AS (SELECT *, CASE WHEN base AND votes = total THEN diagonal END AS spot, CASE WHEN diagonal - lag(diagonal) OVER (PARTITION BY row, template ORDER BY diagonal) > {SLIP} THEN 1 ELSE 0 END AS new FROM diagonals),
merged AS (SELECT *, sum(new) OVER (PARTITION BY row, template ORDER BY diagonal ROWS UNBOUNDED PRECEDING) AS span FROM marked),
spans AS (SELECT row, label, count(spot) AS places, min(spot) AS first_spot, max(spot) AS last_spot, least(1.0, sum(votes) / total) AS cover,
  NOT base AND least(1.0, sum(votes) / total) >= {SHARE} AND max(last) - min(first) + {K} <= {STRETCH} * length AS fits FROM merged GROUP BY row, template, base, label, length, total, span),
found AS (SELECT row, sum(places) AS n_base, min(first_spot) AS first_word, max(last_spot) AS last_word, string_agg(DISTINCT CASE WHEN places > 0 THEN label END, ',' ORDER BY CASE WHEN places > 0 THEN label END) AS base_labels,
  string_agg(DISTINCT CASE WHEN places > 0 OR fits THEN label END, ',' ORDER BY CASE WHEN places > 0 OR fits THEN label END) AS labels,
  max(CASE WHEN places > 0 THEN 1.0 WHEN fits THEN cover END) AS score, count(*) FILTER (places > 0 OR fits) AS n_spans FROM spans GROUP BY 1)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_base, 0)::BIGINT AS n_base, first_word::BIGINT AS first_word, last_word::BIGINT AS last_word, coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels,
  coalesce(score, 0.0)::DOUBLE AS score, coalesce(n_spans, 0)::BIGINT AS n_spans FROM words LEFT JOIN found USING (row)"""
