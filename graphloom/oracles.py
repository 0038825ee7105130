"""DuckDB SQL for the registered queries that SQL can express."""

from __future__ import annotations

SPACE = r"[\s\x0b\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
NAMES = r"list_transform(regexp_extract_all(text, '(?:^|[^\p{L}])(\p{Lu}\p{L}{2,})', 1), lambda x: lower(x))"

WINDOWS = rf"""
pieces AS (SELECT doc_id, string_split(regexp_replace(text, '([.!?]){SPACE}+', '\1' || chr(1), 'g'), chr(1)) AS s FROM documents),
spread AS (SELECT doc_id, unnest(s) AS s, generate_subscripts(s, 1) - 1 AS win_idx FROM pieces),
paired AS (SELECT doc_id, win_idx, s, lead(s) OVER (PARTITION BY doc_id ORDER BY win_idx) AS nxt FROM spread),
windows AS (
  SELECT * FROM (SELECT doc_id, CAST(win_idx AS INTEGER) AS win_idx, regexp_replace(concat_ws(' ', s, nxt), '^{SPACE}+|{SPACE}+$', '', 'g') AS text FROM paired)
  WHERE text <> ''
)"""
MENTIONS = rf"""{WINDOWS},
named AS (SELECT doc_id, win_idx, array_to_string(list_filter(regexp_split_to_array(text, '{SPACE}+'), lambda w: w <> ''), ' ') AS descr, list_sort(list_distinct({NAMES})) AS names FROM windows),
ents AS (SELECT doc_id, win_idx, name, CASE WHEN length(name) <= 5 THEN 'SHORT' ELSE 'LONG' END AS etype, descr FROM (SELECT doc_id, win_idx, descr, unnest(names) AS name FROM named)),
rels AS (
  SELECT a.doc_id, a.win_idx, a.name AS src, b.name AS dst, 'co_' || a.name[1:1] || b.name[1:1] AS rel, a.descr
  FROM ents a JOIN ents b ON a.doc_id = b.doc_id AND a.win_idx = b.win_idx AND a.name < b.name
)"""
MERGED = rf"""{MENTIONS},
ent AS (SELECT doc_id, name, etype, string_agg(DISTINCT descr, ' | ' ORDER BY descr) AS descr, min(win_idx) AS first_win, count(*) AS mentions FROM ents GROUP BY ALL),
rel AS (SELECT doc_id, dst, src, rel, string_agg(DISTINCT descr, ' | ' ORDER BY descr) AS descr, count(*) AS mentions FROM rels GROUP BY ALL)"""
EDGES = rf"""{MERGED},
flat AS (SELECT least(src, dst) AS src, greatest(src, dst) AS dst, rel, regexp_replace(descr, '^{SPACE}+|{SPACE}+$', '', 'g') AS d FROM rel WHERE src <> '' AND dst <> ''),
edges AS (
  SELECT src, dst, string_agg(DISTINCT rel, '|' ORDER BY rel) AS label, coalesce(string_agg(DISTINCT d, ' | ' ORDER BY d) FILTER (WHERE d <> ''), '') AS descr FROM flat GROUP BY ALL
)"""
FINAL = rf"""{EDGES},
fin AS (
  SELECT e.label, src AS source_id, dst AS target_id, descr AS relationship_description, count(*) OVER (PARTITION BY e.label) AS cluster_size FROM edges e
),
adj AS (
  SELECT source_id AS src, target_id AS dst, label AS rel, relationship_description AS descr FROM fin
  UNION ALL SELECT target_id, source_id, label, relationship_description FROM fin WHERE source_id <> target_id
)"""
STATS = rf"""{FINAL},
degs AS (SELECT name, (SELECT count(*) FROM adj WHERE src = name) AS degree FROM (SELECT DISTINCT name FROM ent)),
stats AS (
  SELECT count(*) AS nodes, CAST(sum(CASE WHEN degree = 0 THEN 1 ELSE 0 END) AS BIGINT) AS isolated, max(degree) AS max_degree, round(avg(degree), 6) AS avg_degree,
         (SELECT count(*) FROM fin) AS edges FROM degs
)"""


def propagation(rounds: int = 60) -> str:
    """Unrolled rounds over ``links``, more than it takes to settle; of two states that take turns the smaller label stays."""
    out = ", links AS MATERIALIZED (SELECT DISTINCT src, dst FROM adj WHERE src <> dst), l0 AS MATERIALIZED (SELECT DISTINCT src AS node, src AS label FROM links)"
    for k in range(rounds):
        out += f""", l{k + 1} AS MATERIALIZED (
  SELECT src AS node, arg_min(label, key) AS label FROM (SELECT src, label, {{'n': -count(*), 'label': label}} AS key FROM links JOIN l{k} ON node = dst GROUP BY src, label) GROUP BY src
)"""
    return out + f", labels AS MATERIALIZED (SELECT node, least(a.label, b.label) AS label FROM l{rounds} a JOIN l{rounds - 1} b USING (node))"


def _tokens(c: str) -> str:
    return f"list_filter(regexp_split_to_array({c}, '{SPACE}+'), lambda w: w <> '')"


def _answer(c: str) -> str:
    return f"array_to_string({_tokens(rf"regexp_replace(lower({c}), '[^\p{{L}}\p{{N}}_{SPACE[1:-1]}]', '', 'g')")}, ' ')"


TURNS = "turns AS (SELECT c.conv_id || ':' || c.turn AS id, n.text AS answer, c.text AS gold FROM conversations c JOIN conversations n ON n.conv_id = c.conv_id AND n.turn = c.turn + 1 WHERE c.role = 'user')"
NORMAL = f"{TURNS}, norm AS (SELECT id, {_answer('answer')} AS a, {_answer('gold')} AS g FROM turns)"
F1 = """words AS (SELECT id, unnest(string_split(a, ' ')) AS w, 1 AS p, 0 AS q FROM norm WHERE a <> '' UNION ALL SELECT id, unnest(string_split(g, ' ')), 0, 1 FROM norm WHERE g <> ''),
shared AS (SELECT id, sum(least(p, q)) AS m, sum(p + q) AS n FROM (SELECT id, w, sum(p) AS p, sum(q) AS q FROM words GROUP BY ALL) GROUP BY ALL),
f AS (SELECT norm.id, CASE WHEN coalesce(m, 0) > 0 THEN 2.0 * m / n ELSE 0.0 END::DOUBLE AS f1 FROM norm LEFT JOIN shared ON norm.id = shared.id)"""
SCORES = "sc AS (SELECT id, CAST(a = g AS INTEGER) AS exact, CAST(contains(a, g) AS INTEGER) AS held, CAST(contains(array_to_string(string_split(a, ' ')[1:10], ' '), g) AS INTEGER) AS hit FROM norm)"
VECTORS = """vecs AS (SELECT vec_id, label, embedding::DOUBLE[] AS v FROM embeddings WHERE embedding IS NOT NULL),
units AS (SELECT vec_id, label, list_transform(v, lambda x: x / (sqrt(list_dot_product(v, v)) + 1e-10)) AS v FROM vecs),
spread AS (SELECT label, unnest(v) AS x, generate_subscripts(v, 1) AS i FROM units),
cents AS (SELECT label AS question_id, list(x ORDER BY i) AS m FROM (SELECT label, i, avg(x) AS x FROM spread GROUP BY ALL) GROUP BY label),
sims AS (SELECT question_id, vec_id, round(list_dot_product(m, v) / (sqrt(list_dot_product(m, m)) + 1e-10), 6) AS sim FROM cents, units)"""


GLOBAL = rf"""{FINAL},
once AS (SELECT lower(name) AS name, coalesce(descr, '') AS d, min({{'a': doc_id, 'b': first_win, 'c': lower(etype)}}) AS ord FROM ent GROUP BY ALL),
lists AS (SELECT name, list(d ORDER BY ord, d) AS ds, min(ord).c AS label FROM once GROUP BY name),
whole AS MATERIALIZED (SELECT name, label, list_reduce(ds, lambda acc, x: CASE WHEN x = '' OR contains(acc, x) THEN acc WHEN acc = '' THEN x ELSE acc || ' ' || x END, '') AS entity_description FROM lists)"""
STAR = """flat AS (
  SELECT lower(c_name) AS a, lower(n_name) AS b, 'lives in' AS rel, c_mktsegment AS d FROM customer JOIN nation ON c_nationkey = n_nationkey
  UNION ALL SELECT lower(o_orderpriority), lower(c_name), 'ordered', o_orderstatus FROM orders JOIN customer ON o_custkey = c_custkey),
star AS (SELECT least(a, b) AS src, greatest(a, b) AS dst, string_agg(DISTINCT rel, '|' ORDER BY rel) AS label, string_agg(DISTINCT d, ' | ' ORDER BY d) AS descr FROM flat GROUP BY 1, 2)"""
INITIALS = f"""{FINAL} {propagation()},
coms AS (
  SELECT 0 AS level, label AS cluster_id, node FROM labels
  UNION ALL SELECT 1, label || '/' || node[1:1], node FROM labels WHERE label IN (SELECT label FROM labels GROUP BY label HAVING count(*) > 20)
),
tree AS (SELECT p.cluster_id AS parent, c.cluster_id AS child, count(*) AS n_nodes FROM coms p JOIN coms c ON p.node = c.node AND c.level = p.level + 1 GROUP BY ALL)"""


def _top(where: str) -> str:
    return f"WITH {VECTORS} SELECT question_id, CAST(rank AS INTEGER) AS rank, vec_id, sim FROM (SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY sim DESC, vec_id) AS rank FROM sims {where}) WHERE rank <= 10"


SQL: dict[str, str] = {
    "sentence_windows": f"WITH {WINDOWS} SELECT * FROM windows",
    "window_entities": f"WITH {MENTIONS} SELECT * FROM ents",
    "window_relations": f"WITH {MENTIONS} SELECT * FROM rels",
    "chunk_entity_merge": f"WITH {MERGED} SELECT * FROM ent",
    "chunk_relation_merge": f"WITH {MERGED} SELECT * FROM rel",
    "extraction_stats": f"""WITH {MENTIONS}
SELECT (SELECT CAST(sum(m) AS BIGINT) FROM (SELECT count(DISTINCT descr) - 1 AS m FROM ents GROUP BY doc_id, name, etype)) AS entity_merges,
       (SELECT count(*) FROM (SELECT DISTINCT doc_id, name, etype FROM ents)) AS entities,
       (SELECT CAST(sum(m) AS BIGINT) FROM (SELECT count(DISTINCT descr) - 1 AS m FROM rels GROUP BY doc_id, src, dst, rel)) AS relation_merges,
       (SELECT count(*) FROM rels) AS raw_relations,
       (SELECT count(*) FROM (SELECT DISTINCT doc_id, src, dst, rel FROM rels r WHERE NOT EXISTS (SELECT 1 FROM ents e WHERE e.doc_id = r.doc_id AND e.name = r.src) OR NOT EXISTS (SELECT 1 FROM ents e WHERE e.doc_id = r.doc_id AND e.name = r.dst))) AS unknown_entity_relations""",
    "entity_canon": "SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN lower(source) ELSE lower(lang) END AS name FROM documents",
    "parse_entity_blocks": f"WITH {MENTIONS} SELECT doc_id, win_idx, name, 'term' AS etype, 'a term' AS descr FROM ents",
    "parse_relation_blocks": f"WITH {MENTIONS} SELECT doc_id, win_idx, src, dst, 'next_to' AS rel, 'stands beside' AS descr FROM (SELECT doc_id, win_idx, name AS src, lead(name) OVER (PARTITION BY doc_id, win_idx ORDER BY name) AS dst FROM ents) WHERE dst IS NOT NULL",
    "global_entities": f"WITH {GLOBAL} SELECT * FROM whole",
    "undirected_edges": f"WITH {EDGES} SELECT * FROM edges",
    "star_edges": f"WITH {STAR} SELECT * FROM star",
    "star_expand": f"""WITH RECURSIVE {STAR},
ways AS (SELECT src, dst FROM star UNION SELECT dst, src FROM star),
enter AS (SELECT src, dst FROM ways WHERE dst NOT IN (SELECT lower(c_name) FROM customer WHERE c_mktsegment = 'BUILDING')),
walk(question_id, node, hop) AS (
  SELECT n_nationkey::BIGINT, lower(n_name), 0 FROM nation
  UNION SELECT question_id, dst, hop + 1 FROM walk JOIN enter ON node = src WHERE hop < 3
)
SELECT question_id, node, CAST(min(hop) AS INTEGER) AS hop FROM walk GROUP BY question_id, node""",
    "edge_label_members": f"WITH {EDGES} SELECT DISTINCT label, src AS source_id, dst AS target_id FROM edges",
    "entity_type_counts": f"WITH {GLOBAL} SELECT label, count(*) AS n FROM whole GROUP BY label",
    "entity_descriptions": f"WITH {GLOBAL} SELECT name, d AS descr, ord.a AS doc_id, ord.b AS first_win, ord.c AS label FROM once",
    "label_tree": f"WITH {INITIALS} SELECT * FROM tree",
    "label_leaves": f"WITH {INITIALS} SELECT DISTINCT cluster_id FROM coms WHERE cluster_id NOT IN (SELECT parent FROM tree)",
    "community_elements": f"""WITH {GLOBAL} {propagation()},
texts AS (
  SELECT label_of.label AS cluster_id, 'node' AS kind, g.name AS src, '' AS dst, 'Node ' || g.name || ': ' || g.entity_description AS text FROM labels label_of JOIN whole g ON g.name = label_of.node
  UNION ALL SELECT a.label, 'edge', e.src, e.dst, e.src || ' -> ' || e.dst || ' : ' || e.rel || ' | ' || e.descr FROM adj e JOIN labels a ON a.node = e.src JOIN labels b ON b.node = e.dst AND a.label = b.label
)
SELECT *, CAST(len({_tokens('text')}) AS INTEGER) AS tokens FROM texts""",
    "token_pack": f"""WITH counted AS (SELECT source, doc_id, len({_tokens('text')}) AS n FROM documents),
folded AS (
  SELECT source, list_reduce(list({{'out': []::STRUCT(d BIGINT, w BIGINT)[], 'd': 0::BIGINT, 'w': 0::BIGINT, 'n': n::BIGINT}} ORDER BY doc_id), lambda s, x:
    CASE WHEN x.n > 2000 THEN {{'out': list_append(s.out, {{'d': 1::BIGINT, 'w': x.n}}), 'd': s.d, 'w': s.w, 'n': 0::BIGINT}}
         WHEN s.w + x.n > 2000 THEN {{'out': list_append(s.out, {{'d': s.d, 'w': s.w}}), 'd': 1::BIGINT, 'w': x.n, 'n': 0::BIGINT}}
         ELSE {{'out': s.out, 'd': s.d + 1, 'w': s.w + x.n, 'n': 0::BIGINT}} END,
    {{'out': []::STRUCT(d BIGINT, w BIGINT)[], 'd': 0::BIGINT, 'w': 0::BIGINT, 'n': 0::BIGINT}}) AS s
  FROM counted GROUP BY source
),
every AS (SELECT source, list_filter(list_append(s.out, {{'d': s.d, 'w': s.w}}), lambda p: p.d > 0) AS packs FROM folded)
SELECT source, 0::BIGINT AS chunk, CAST(i - 1 AS INTEGER) AS pack, packs[i].d AS documents, packs[i].w AS words FROM (SELECT source, packs, unnest(range(1, len(packs) + 1)) AS i FROM every)""",
    "map_scores": f"""WITH {TURNS},
parts AS (SELECT id, list_distinct({_tokens('lower(gold)')}) AS q, answer, string_split(regexp_replace(answer, '([.!?]){SPACE}+', '\\1' || chr(1), 'g'), chr(1)) AS s FROM turns),
rated AS (SELECT id, unnest(s) AS s, generate_subscripts(s, 1) AS i, q, answer FROM parts),
best AS (SELECT id, arg_max(array_to_string({_tokens('s')}, ' '), {{'n': len(list_intersect(q, {_tokens('lower(s)')})), 'i': -i}}) AS answer, any_value(q) AS q, any_value(answer) AS a FROM rated GROUP BY id)
SELECT id, answer, CASE WHEN len(q) > 0 THEN CAST(floor(100 * len(list_intersect(q, {_tokens('lower(a)')})) / len(q)) AS BIGINT) ELSE 0 END AS score FROM best""",
    "edge_label_groups": f"WITH {EDGES} SELECT label, count(*) AS members, min(src) AS first_src, max(dst) AS last_dst FROM edges GROUP BY label",
    "final_relations": f"WITH {FINAL} SELECT * FROM fin",
    "adjacency": f"WITH {FINAL} SELECT * FROM adj",
    "graph_stats": f"WITH {STATS} SELECT * FROM stats",
    "dynamic_cluster_size": f"WITH {STATS} SELECT nodes, edges, CAST(greatest(500, least(floor(nodes / (10 + edges / nodes)), 3000)) AS BIGINT) AS max_cluster_size FROM stats",
    "label_propagation": f"WITH {FINAL} {propagation()} SELECT * FROM labels",
    "budget_prefix": f"""SELECT question_id, ord, score, CAST(running AS BIGINT) AS running FROM (
  SELECT source AS question_id, doc_id AS ord, n_chars AS score, sum(len({_tokens('text')})) OVER (PARTITION BY source ORDER BY n_chars DESC, doc_id ROWS UNBOUNDED PRECEDING) AS running FROM documents WHERE n_chars > 0
) WHERE running <= 20000""",
    "cosine_topk": _top(""),
    "threshold_topk": _top("WHERE sim >= 0.2"),
    "zero_query_fallback": f"""{_top("")[:-len(" WHERE rank <= 10")].replace("SELECT question_id, CAST(rank AS INTEGER) AS rank, vec_id, sim FROM", "SELECT question_id, CAST(rank AS INTEGER) AS rank, vec_id FROM")} WHERE rank <= 10 AND question_id % 2 = 0
UNION ALL SELECT question_id, CAST(rank AS INTEGER), vec_id FROM (SELECT DISTINCT label AS question_id FROM embeddings WHERE embedding IS NOT NULL AND label % 2 <> 0), (SELECT vec_id, row_number() OVER (ORDER BY vec_id) AS rank FROM embeddings WHERE embedding IS NOT NULL) WHERE rank <= 10""",
    "string_match": f"""WITH t AS (SELECT DISTINCT p_type AS text_id FROM part UNION SELECT n_name FROM nation),
n AS (SELECT DISTINCT p_name AS node FROM part UNION SELECT n_name FROM nation),
w AS (SELECT text_id, node, lower(text_id) AS x, lower(node) AS y, list_distinct({_tokens('lower(text_id)')}) AS xs, list_distinct({_tokens('lower(node)')}) AS ys FROM t, n)
SELECT text_id, node, round(CASE WHEN x = y THEN 1.2 WHEN contains(y || ' ', x) THEN 1.0 ELSE 0.6 * len(list_intersect(xs, ys)) / len(xs) END, 6)::DOUBLE AS score
FROM w WHERE contains(y || ' ', x) OR len(list_intersect(xs, ys)) > 0""",
    "final_parse": r"""SELECT conv_id, turn,
  CASE WHEN turn % 3 = 0 THEN trim(regexp_extract(cut, '(?s)FINAL ANSWER:\s*(.*?)\s*SELECTED SUMMARY:', 1)) ELSE 'Insufficient information to answer based on the available summaries.' END AS answer,
  CASE WHEN turn % 3 = 2 THEN '' ELSE role END AS summary
FROM (SELECT *, 'FINAL ANSWER: ' || text || chr(10) || 'SELECTED SUMMARY: ' || role AS cut FROM conversations)""",
    "judge_parse": "SELECT conv_id, turn, CAST(CASE WHEN turn % 2 = 0 THEN 1 WHEN turn % 3 = 0 THEN 0 ELSE conv_id % 2 END AS INTEGER) AS judged FROM conversations",
    "answer_scores": f"WITH {NORMAL}, {SCORES} SELECT * FROM sc",
    "token_f1": f"WITH {NORMAL}, {F1} SELECT id, round(f1, 6) AS f1 FROM f",
    "evaluation": f"WITH {NORMAL}, {F1}, {SCORES} SELECT round(avg(exact), 6) AS exact_match, round(avg(held), 6) AS contains_answer, round(avg(hit), 6) AS hit_at_10, (SELECT round(avg(f1), 6) FROM f) AS f1, round(avg(held), 6) AS llm_score FROM sc",
    "stratified_sample": "SELECT doc_id, lang FROM (SELECT doc_id, lang, row_number() OVER (PARTITION BY lang ORDER BY doc_id) AS n FROM documents) WHERE n <= CASE WHEN lang IN ('en', 'de') THEN 13 WHEN lang IN ('fr', 'es') THEN 12 ELSE 0 END",
    "doc_build_musique": "SELECT conv_id AS row_idx, string_agg(role || ': ' || text || chr(10), '' ORDER BY turn, role, text) AS text FROM conversations GROUP BY conv_id",
    "doc_build_hotpot": rf"SELECT conv_id AS row_idx, string_agg(role || ': ' || regexp_replace(text, '([.!?]){SPACE}+', '\1 ', 'g'), '' ORDER BY turn, role, text) AS text FROM conversations GROUP BY conv_id",
    "doc_build_2wiki": rf"SELECT conv_id AS row_idx, string_agg(role || ': ' || regexp_replace(text, '([.!?]){SPACE}+', '\1 ', 'g') || chr(10), '' ORDER BY turn, role, text) AS text FROM conversations GROUP BY conv_id",
    "graph_json_roundtrip": f"WITH {FINAL} SELECT source_id || '|' || label || '|' || target_id AS id, label, source_id, target_id, relationship_description FROM fin",
}
