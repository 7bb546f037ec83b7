"""DuckDB statements that give the same rows as the queries of ``queries.py``, by brute force."""

from __future__ import annotations

_WORDS = r"regexp_extract_all(lower(txt), '[\p{L}\p{N}]+')"


def _stack(parts: list[tuple[str, str, str, str]]) -> str:
    return " UNION ".join(f"SELECT '{side}' AS side, '{field}' AS f, id, {column} AS txt FROM {tab}" for side, field, tab, column in parts)


def _alike(parts: list[tuple[str, str, str, str]], on: str) -> str:
    return f"""WITH t AS ({_stack(parts)}),
w AS (SELECT side, f, id, unnest({_WORDS}) AS w FROM t WHERE id IS NOT NULL),
e AS (SELECT side, f, id, w, row_number() OVER (PARTITION BY side, f, id, w) AS o FROM w),
n AS (SELECT side, f, id, count(*) AS n FROM e GROUP BY ALL HAVING count(*) >= 12),
k AS (SELECT e.* FROM e JOIN n USING (side, f, id)),
s AS (SELECT a.f, a.side AS sa, a.id AS x, b.side AS sb, b.id AS y, count(*) AS shared FROM k a JOIN k b ON a.f = b.f AND a.w = b.w AND a.o = b.o AND {on} GROUP BY ALL),
r AS (SELECT s.f, x, y FROM s JOIN n a ON a.side = sa AND a.f = s.f AND a.id = x JOIN n b ON b.side = sb AND b.f = s.f AND b.id = y WHERE shared * 1.0 / (a.n + b.n - shared) >= 0.7)"""


_P4 = _alike([("", "v1_b.candidate_message", "v1_b", "candidate_message"), ("", "human_boundary.leaky_candidate", "human_boundary", "leaky_candidate"), ("", "human_boundary.safe_rewrite", "human_boundary", "safe_rewrite")], "a.id < b.id")
_P5 = _alike([(side, f, tab, f) for side, tab in (("test", "v1_test"), ("train", "v1_b")) for f in ("candidate_message", "problem")], "a.side = 'test' AND b.side = 'train'")


_LABELS = ["adequate", "gives_final_answer", "gives_away_key_step", "mismatched_calibration", "vague_unhelpful"]


def _named(text: str) -> str:
    flat = f"('_' || regexp_replace(lower({text}), '[^a-z0-9]+', '_', 'g') || '_')"
    hits = [f"contains({flat}, '_{name}_')" for name in _LABELS]
    chosen = " ".join(f"WHEN {h} THEN '{name}'" for h, name in zip(hits, _LABELS))
    return f"CASE WHEN {' + '.join(f'{h}::INT' for h in hits)} = 1 THEN CASE {chosen} END END"


_P1_VOTES = f"""WITH e AS (SELECT DISTINCT id, unnest(map_entries(votes)) AS e FROM train_flagged),
v AS (SELECT id, e.key AS annotator, {_named("e.value")} AS label FROM e),
c AS (SELECT id, label, count(*) AS n FROM v WHERE label IS NOT NULL GROUP BY ALL),
r AS (SELECT *, max(n) OVER (PARTITION BY id) AS top FROM c),
w AS (SELECT id, min(label) AS label, min(top) AS top FROM r WHERE n = top GROUP BY id HAVING count(*) = 1)"""
_P1 = f"""{_P1_VOTES},
m AS (SELECT id, min({_named("majority")}) AS said FROM train_flagged GROUP BY id)
SELECT id, label FROM w JOIN m USING (id) WHERE top >= 2 AND said IS DISTINCT FROM label"""
_P2 = f"""WITH r AS (SELECT DISTINCT id, slice, {_named("gold_verdict")} AS gold_verdict FROM v1_test),
n AS (SELECT ceil(count(DISTINCT id) / 5) AS n FROM v1_test),
a AS (SELECT slice, gold_verdict, count(DISTINCT id) AS available FROM r GROUP BY ALL),
p AS (SELECT t.slice, t.gold_verdict, target_share, min_rows, greatest(min_rows, ceil(round(target_share * n, 9)))::BIGINT AS wanted, coalesce(available, 0) AS available FROM sample_targets t CROSS JOIN n LEFT JOIN a USING (slice, gold_verdict))"""


_TEXT_WORDS = r"regexp_extract_all(lower(text), '[\p{L}\p{N}]+')"
_GRAMS = "unnest([array_to_string(w[k:k + 11], ' ') for k in range(1, len(w) - 10)])"
_P8 = f"""WITH d AS (SELECT DISTINCT doc_id, {_TEXT_WORDS} AS w FROM documents WHERE text IS NOT NULL),
dg AS (SELECT doc_id, {_GRAMS} AS g FROM d WHERE len(w) >= 12),
f AS (UNPIVOT (SELECT id AS item_id, problem, correct_solution, candidate_message FROM gives_away_probe) ON problem, correct_solution, candidate_message INTO NAME field VALUE text),
i AS (SELECT DISTINCT item_id, field, {_TEXT_WORDS} AS w FROM f),
ig AS (SELECT item_id, field, {_GRAMS} AS g FROM i WHERE len(w) >= 12),
hit AS (SELECT DISTINCT doc_id, item_id, field FROM dg JOIN ig USING (g))"""
_P8_SPANS = """dw AS (SELECT doc_id, unnest(w) AS w, generate_subscripts(w, 1) - 1 AS dp FROM d WHERE doc_id IN (SELECT doc_id FROM hit)),
iw AS (SELECT item_id, field, unnest(w) AS w, generate_subscripts(w, 1) - 1 AS ip FROM i),
m AS (SELECT doc_id, item_id, field, dp - ip AS shift, dp FROM hit JOIN dw USING (doc_id) JOIN iw USING (item_id, field, w)),
run AS (SELECT *, dp - row_number() OVER (PARTITION BY doc_id, item_id, field, shift ORDER BY dp) AS grp FROM m),
span AS (SELECT doc_id, item_id, field, count(*) AS n_words, min(dp) AS start_word FROM run GROUP BY doc_id, item_id, field, shift, grp),
best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, item_id, field ORDER BY n_words DESC, start_word) AS rn FROM span) WHERE rn = 1)"""


def oracle_sql() -> dict[str, str]:
    return {
        "p1_found": _P1,
        "p2_found": f"{_P2} SELECT slice, gold_verdict FROM p WHERE available < wanted",
        "p1_agreement": f"""{_P1_VOTES}, i AS (SELECT id, sum(n)::BIGINT AS n_votes, sum(n * (n - 1))::BIGINT AS equal, max(n) AS plurality_votes FROM c GROUP BY id)
SELECT id, n_votes, CASE WHEN n_votes > 1 THEN equal / (n_votes * (n_votes - 1)) END AS agreement, w.label AS plurality, plurality_votes FROM i LEFT JOIN w USING (id)""",
        "p2_report": f"""{_P2} SELECT slice, gold_verdict, target_share, min_rows::BIGINT AS min_rows, wanted, available, least(wanted, available) AS taken, wanted - least(wanted, available) AS gap,
CASE WHEN available > 0 AND wanted >= available THEN 1.0 WHEN available > 0 THEN round(wanted / available, 9) ELSE 0.0 END AS probability FROM p""",
        "p4_groups": f"""{_P4.replace("WITH t AS", "WITH RECURSIVE t AS", 1)}, both_ AS (SELECT f, x, y FROM r UNION SELECT f, y, x FROM r),
reach AS (SELECT f, x, x AS y FROM both_ UNION SELECT reach.f, reach.x, both_.y FROM reach JOIN both_ ON both_.f = reach.f AND both_.x = reach.y),
g AS (SELECT f, x AS id, min(y) AS group_id FROM reach GROUP BY f, x), bag AS (SELECT f, id, list_sort(list(w)) AS b FROM k GROUP BY f, id), copies AS (SELECT f, b, count(*) AS n_copies FROM bag GROUP BY f, b)
SELECT f AS field_name, id, group_id, n_copies FROM g JOIN bag USING (f, id) JOIN copies USING (f, b)""",
        "p7_sizes": rf"""SELECT doc_id, n AS n_tokens, greatest(1, ceil(n / m))::INT AS n_parts FROM (SELECT doc_id, max(coalesce(len(regexp_extract_all(text, '[\p{{L}}\p{{N}}]+|[^\s]')), 0)) AS n FROM documents GROUP BY doc_id), (SELECT min(max_tokens) AS m FROM token_limits WHERE purpose = 'container')""",
        "p4_found": f"{_P4} SELECT f AS field_name, x AS id_a, y AS id_b FROM r",
        "p5_found": f"{_P5} SELECT x AS test_id, y AS train_id, f AS field_name FROM r",
        "p8_found": f"{_P8} SELECT DISTINCT doc_id, item_id FROM hit",
        "p8_spans": f"{_P8}, {_P8_SPANS} SELECT doc_id, item_id, field, n_words, start_word FROM best",
        "p8_items": f"{_P8}, {_P8_SPANS} SELECT item_id, count(DISTINCT doc_id) AS n_docs, max(n_words) AS longest_words, string_agg(DISTINCT field, ',' ORDER BY field) AS fields FROM best GROUP BY item_id",
        "p9_found": r"SELECT DISTINCT doc_id FROM documents, (SELECT min(max_tokens) AS m FROM token_limits WHERE purpose = 'piece') WHERE len(regexp_extract_all(text, '[\p{L}\p{N}]+|[^\s]')) > m",
        "p5_report": f"""{_P5},
p AS (SELECT 'test' AS split, id, min(slice) AS source FROM v1_test GROUP BY id UNION ALL SELECT 'train', id, min(slice) FROM v1_b GROUP BY id),
tot AS (SELECT split, source, count(*) AS n_records FROM p GROUP BY ALL),
ends AS (SELECT f, 'test' AS split, x AS id FROM r UNION ALL SELECT f, 'train', y FROM r),
per AS (SELECT f, split, id, count(*) AS n FROM ends GROUP BY ALL),
h AS (SELECT f, split, source, sum(n)::BIGINT AS n_pairs, count(*) AS n_overlapping FROM per JOIN p USING (split, id) GROUP BY ALL)
SELECT g.f AS field_name, tot.split, tot.source, n_records, coalesce(n_overlapping, 0) AS n_overlapping, coalesce(n_pairs, 0) AS n_pairs
FROM tot CROSS JOIN (SELECT DISTINCT f FROM r) g LEFT JOIN h ON h.f = g.f AND h.split = tot.split AND h.source IS NOT DISTINCT FROM tot.source""",
    }
