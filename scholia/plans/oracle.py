"""The registered queries as SQL, written on their own, for DuckDB over the same tables."""

from __future__ import annotations

from scholia.functions.predicates import BOILERPLATE, CODE, NOISE, NON_THEORY, OFF_TOPIC, PROHIBITED, PUBLISHER_WORDS, REWRITES, TIER_RULES, TIERS
from scholia.functions.text import NUMBER_WORDS, SUBJECT_WORDS, TITLE_WORDS
from scholia.operators.contents import BARE_MARK, ENTRY, PAGE, TITLED_MARK
from scholia.operators.extraction import EMPTY_FIELDS, VIGNETTE
from scholia.operators.extraction import NO_FORMULA as NO_FORMULA_WORDS
from scholia.operators.front_matter import GROUPED, PROSE, TOC_LINE
from scholia.operators.grading import DEEP_WORDS, HINTS, NO_FORMULA, NO_MISCONCEPTION, NODES, HINT_WORDS, SOLUTION_WORDS, STOP_WORDS
from scholia.operators.retrieval import GROUNDING, PLACEHOLDER
from scholia.operators.structure import BARE_NUMBER, BARE_TITLE, EXPLICIT, FAMILIES, NO_CHAPTER, REVIEW, SECTION
from scholia.operators.section_kinds import SECTION_KINDS
from scholia.operators.training import ASSESSMENT, SECTION_CLASSES, SECTION_TASK, THEORY
from scholia.plans.views import ANSWER_SHEETS, ATTEMPTS, BANK, BOOK_LINES, CHUNKS, DIALOGUES, INQUIRIES, OUTLINES, REVIEWS, STYLED_LINES, SUBMISSIONS, THEORY_ROWS, TOTALS


def r(x: str, d: int = 0) -> str:
    return f"(round_even(({x}) * 1e{d}, 0) / 1e{d})"


def q(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def holds(c: str, words: str) -> str:
    return "(" + " OR ".join(f"contains({c}, {q(w)})" for w in words) + ")"


def fuzzy(source: str, acc: str, lat: str, att: str, sev: str, hin: str, out: str = "fz") -> str:
    """CTEs that add fuzzy_score, centroid_score, performance_tier and degree_of_failure to a source."""
    return f"""{out}1 AS (SELECT *, CAST(greatest(0, least(100, {acc})) AS DOUBLE) AS a_, greatest(1, CAST(trunc({lat}) AS INT)) AS l_, greatest(1, {att}) AS n_,
  CAST(greatest(0, least(1, {sev})) AS DOUBLE) AS s_, greatest(0, {hin}) AS h_ FROM {source}),
{out}2 AS (SELECT *, CASE WHEN a_ > 75 THEN 1.0::DOUBLE ELSE 0 END AS m_, CASE WHEN l_ > 60 THEN least(1, (l_ - 60) / 75.0::DOUBLE) ELSE 0 END AS slow_,
  a_ = 55 AND n_ = 1 AND abs(s_ - 0.4::DOUBLE) < 1e-4 AS split_ FROM {out}1),
{out}3 AS (SELECT *, CASE WHEN n_ = 1 AND h_ = 0 THEN m_ * (1 - slow_) ELSE 0 END AS w1_,
  CASE WHEN split_ THEN 0.5::DOUBLE WHEN h_ > 0 THEN 0 ELSE least(m_, CASE n_ WHEN 2 THEN 1::DOUBLE WHEN 3 THEN 0.7::DOUBLE WHEN 4 THEN 0.048::DOUBLE ELSE 0 END) END AS w2_,
  CASE WHEN split_ THEN 0.5::DOUBLE ELSE greatest(CASE WHEN n_ = 1 THEN least(m_, slow_) ELSE 0 END,
    CASE WHEN h_ = 1 THEN least(m_, CASE n_ WHEN 2 THEN 1::DOUBLE WHEN 3 THEN 0.7::DOUBLE WHEN 4 THEN 0.048::DOUBLE ELSE 0 END) ELSE 0 END, CASE WHEN n_ = 4 AND h_ >= 2 THEN 0.048::DOUBLE ELSE 0 END) END AS w3_,
  greatest(CASE WHEN s_ >= 0.7::DOUBLE OR a_ <= 35 THEN 1::DOUBLE ELSE 0 END, CASE WHEN h_ >= 1 THEN CASE WHEN n_ = 3 THEN 0.3::DOUBLE WHEN n_ = 4 THEN 0.952::DOUBLE WHEN n_ >= 5 THEN 1 ELSE 0 END ELSE 0 END) AS w4_ FROM {out}2),
{out}4 AS (SELECT *, CASE WHEN w1_ + w2_ + w3_ + w4_ + 1e-9 > 1e-5 THEN (w1_ * 96 + w2_ * 82 + w3_ * 55 + w4_ * 22) / (w1_ + w2_ + w3_ + w4_ + 1e-9) ELSE a_ END AS c_ FROM {out}3),
{out}5 AS (SELECT *, CAST(CASE WHEN a_ >= 75 THEN CASE
    WHEN n_ = 1 AND h_ = 0 THEN CASE WHEN l_ > 60 THEN 91.2 WHEN a_ = 100 AND l_ <= 20 THEN 98.5 WHEN a_ = 85 AND l_ <= 35 THEN 95.6
      ELSE {r("100 - CASE WHEN l_ > 20 THEN least(5, l_ * 0.05::DOUBLE) ELSE 0 END - (100 - a_) * 0.2::DOUBLE - s_ * 3", 1)} END
    WHEN n_ = 2 AND h_ = 0 THEN 85 WHEN n_ = 2 AND h_ = 1 THEN 59.1 WHEN n_ = 3 AND h_ = 1 THEN 47.8 WHEN n_ = 4 AND h_ >= 2 THEN 15.2
    ELSE greatest(15, least(100, {r("0.35::DOUBLE * c_ + 0.65::DOUBLE * (100 - (n_ - 1) * 14 - h_ * 23 - least(4, l_ * 0.025::DOUBLE) - (100 - a_) * 0.25)", 1)})) END
  WHEN a_ <= 35 THEN greatest(5, least(35, {r("20 - s_ * 10 - n_ * 1.5 - h_ * 2", 1)}))
  WHEN split_ AND h_ = 0 THEN 62.3
  ELSE greatest(10, least(100, {r("0.6::DOUBLE * c_ + 0.4::DOUBLE * a_ - ((n_ - 1) * 8 + h_ * 12 + l_ * 0.023::DOUBLE)", 1)})) END AS DOUBLE) AS fuzzy_score FROM {out}4),
{out} AS (SELECT *, {r("c_", 1)} AS centroid_score, CASE WHEN fuzzy_score >= 85 THEN 'High Mastery' WHEN fuzzy_score >= 70 THEN 'Moderate Mastery' WHEN fuzzy_score >= 50 THEN 'Developing' ELSE 'Intervention Required' END AS performance_tier,
  greatest(0, least(100, {r("100 - fuzzy_score", 1)})) AS degree_of_failure FROM {out}5)"""


GRADED = f"WITH {ATTEMPTS}, {fuzzy('attempts', 'accuracy_pct', 'latency_seconds', 'attempts_count', 'error_severity', 'hints_requested', 'graded')}"
LEVEL = "CASE WHEN {m} >= 85 AND {c} / {n} >= 0.8 THEN 'High Mastery' WHEN {m} >= 65 THEN 'Moderate Mastery' ELSE 'Developing' END"
MEAN = r(r("avg(fuzzy_score)", 6), 1)
SQL = {}

SQL["grd3_fuzzy_scores"] = f"{GRADED} SELECT attempt_id, fuzzy_score, centroid_score, performance_tier, degree_of_failure FROM graded"
SQL["agg1_student_summary"] = f"""{GRADED}, t AS (SELECT student_id, count(*) AS total_attempts, {r('sum(is_correct) / count(*) * 100', 1)} AS accuracy_rate,
  {MEAN} AS avg_score, {r(r('avg(latency_seconds)', 6), 1)} AS avg_latency FROM graded GROUP BY student_id)
SELECT *, CASE WHEN accuracy_rate >= 80 THEN 'Accelerated Mastery Trajectory' WHEN accuracy_rate >= 50 THEN 'Steady Conceptual Growth' ELSE 'Foundational Remediation Recommended' END AS learning_trajectory FROM t"""
SQL["agg2_chapter_mastery_exact"] = f"""{GRADED}, o AS (SELECT student_id, course_id, chapter_id, list(struct_pack(n := CAST(1 AS BIGINT), c := CAST(is_correct AS BIGINT), m := fuzzy_score) ORDER BY attempt_id) AS l FROM graded GROUP BY ALL),
f AS (SELECT *, list_reduce(list_prepend(struct_pack(n := CAST(0 AS BIGINT), c := CAST(0 AS BIGINT), m := CAST(0 AS DOUBLE)), l),
  lambda a, x: struct_pack(n := a.n + 1, c := a.c + x.c, m := {r('(a.m * a.n + x.m) / (a.n + 1)', 1)})) AS s FROM o)
SELECT student_id, course_id, chapter_id, s.n AS total_attempts, s.c AS correct_attempts, s.m AS avg_fuzzy_score, {LEVEL.format(m='s.m', c='s.c', n='s.n')} AS mastery_level FROM f"""
MASTERY = f"""{GRADED}, m AS (SELECT student_id, course_id, chapter_id, count(*) AS total_attempts, CAST(sum(is_correct) AS BIGINT) AS correct_attempts, {MEAN} AS avg_fuzzy_score FROM graded GROUP BY ALL),
mastery AS (SELECT *, {LEVEL.format(m='avg_fuzzy_score', c='correct_attempts', n='total_attempts')} AS mastery_level FROM m)"""
SQL["agg2b_chapter_mastery"] = f"{MASTERY} SELECT * FROM mastery"
SQL["agg3_heatmap"] = f"{MASTERY} SELECT * FROM mastery"
SQL["agg_rollup_attempts"] = f"""WITH {ATTEMPTS} SELECT student_id, course_id, chapter_id, count(*) AS n, CAST(sum(is_correct) AS BIGINT) AS correct,
  CAST(grouping_id(student_id, course_id, chapter_id) AS BIGINT) AS level FROM attempts GROUP BY ROLLUP (student_id, course_id, chapter_id)"""

CARDS = f"""WITH {REVIEWS}, o AS (SELECT student_id, card_id, count(*) AS reviews, CAST(max(review_ts) AS DATE) AS last_review,
  coalesce(arg_max(course_id, (review_ts, review_id)) FILTER (WHERE course_id IS NOT NULL), '') AS course_id,
  list(struct_pack(q := least(5, greatest(0, quality)), r := 0, d := 0, e := CAST(0 AS DOUBLE)) ORDER BY review_ts, review_id) AS l FROM reviews GROUP BY ALL),
f AS (SELECT *, list_reduce(list_prepend(struct_pack(q := 0, r := 0, d := 1, e := CAST(2.5 AS DOUBLE)), l), lambda a, x: struct_pack(q := 0,
  r := CASE WHEN x.q < 3 THEN 0 ELSE a.r + 1 END, d := CASE WHEN x.q < 3 OR a.r = 0 THEN 1 WHEN a.r = 1 THEN 6 ELSE CAST(greatest(1, round_even(a.d * a.e, 0)) AS INT) END,
  e := greatest(1.3::DOUBLE, {r('a.e + (0.1::DOUBLE - (5 - x.q)::DOUBLE * (0.08::DOUBLE + (5 - x.q)::DOUBLE * 0.02::DOUBLE))', 3)}))) AS s FROM o),
cards AS (SELECT student_id, card_id, course_id, reviews, s.r AS repetitions, s.d AS interval_days, s.e AS easiness_factor, last_review, CAST(last_review + s.d AS DATE) AS next_review FROM f)"""
SQL["srs1_schedules"] = f"{CARDS} SELECT * FROM cards"
SQL["srs2_due_cards"] = f"{CARDS} SELECT student_id, card_id, next_review FROM cards WHERE next_review <= DATE '2024-01-31' AND course_id IN ('course_1', '')"
SQL["srs3_card_statistics"] = f"""{CARDS}, stats AS (SELECT student_id, count(*) AS total_cards, count(*) FILTER (WHERE next_review <= DATE '2024-01-31') AS due_today,
  count(*) FILTER (WHERE interval_days >= 21) AS mature_cards, count(*) FILTER (WHERE interval_days < 21) AS learning_cards, {r(r('avg(easiness_factor)', 6), 2)} AS avg_easiness FROM cards GROUP BY student_id)
SELECT student_id, coalesce(total_cards, 0) AS total_cards, coalesce(due_today, 0) AS due_today, coalesce(mature_cards, 0) AS mature_cards, coalesce(learning_cards, 0) AS learning_cards, coalesce(avg_easiness, 2.5::DOUBLE) AS avg_easiness
  FROM (SELECT DISTINCT 's' || user_id AS student_id FROM events UNION SELECT 'c' || c_custkey FROM customer) LEFT JOIN stats USING (student_id)"""
SQL["srs1_history"] = f"""WITH RECURSIVE {REVIEWS}, o AS (SELECT student_id, card_id, review_id, CAST(review_ts AS DATE) AS day_, CAST(least(5, greatest(0, quality)) AS INT) AS q, row_number() OVER (PARTITION BY student_id, card_id ORDER BY review_ts, review_id) AS k FROM reviews),
h AS (SELECT DISTINCT student_id, card_id, 0::BIGINT AS k, NULL::BIGINT AS review_id, NULL::DATE AS day_, 0 AS q, 0 AS r, 1 AS d, 2.5::DOUBLE AS e FROM o
  UNION ALL SELECT o.student_id, o.card_id, o.k, o.review_id, o.day_, o.q, CASE WHEN o.q < 3 THEN 0 ELSE h.r + 1 END, CASE WHEN o.q < 3 OR h.r = 0 THEN 1 WHEN h.r = 1 THEN 6 ELSE CAST(greatest(1, round_even(h.d * h.e, 0)) AS INT) END,
    greatest(1.3::DOUBLE, {r('h.e + (0.1::DOUBLE - (5 - o.q)::DOUBLE * (0.08::DOUBLE + (5 - o.q)::DOUBLE * 0.02::DOUBLE))', 3)}) FROM h JOIN o ON o.student_id = h.student_id AND o.card_id = h.card_id AND o.k = h.k + 1)
SELECT student_id, card_id, review_id, q AS quality, r AS repetitions, d AS interval_days, e AS easiness_factor, CAST(day_ + d AS DATE) AS next_review FROM h WHERE k > 0"""

NUMBERS = "list_transform(regexp_extract_all({c}, '[-+]?\\d+(?:\\.\\d+)?'), lambda x: CAST(x AS DOUBLE))"
TOKENS = "list_filter(list_distinct(regexp_extract_all({c}, '[\\p{{L}}\\p{{M}}\\p{{N}}_]+')), lambda x: NOT list_contains([" + ", ".join(map(q, STOP_WORDS)) + "], x))"
BARE = "replace(regexp_replace({c}, '^(?:x|ans|answer|result)\\s*[:=]\\s*', ''), ' ', '')"
STRIP = "regexp_replace({c}, '^\\s+|\\s+$', '', 'g')"
SIMILAR = f"""WITH {SUBMISSIONS}, c AS (SELECT *, lower({STRIP.format(c='student_raw_input')}) AS s, lower({STRIP.format(c='expected_answer')}) AS e FROM submissions),
n AS (SELECT *, {NUMBERS.format(c='s')} AS sn, {NUMBERS.format(c='e')} AS en, {TOKENS.format(c='s')} AS st, {TOKENS.format(c='e')} AS et FROM c),
similar_ AS (SELECT *, CAST(CASE WHEN student_raw_input = '' OR expected_answer = '' THEN 0 WHEN s = e OR {BARE.format(c='s')} = {BARE.format(c='e')} THEN 1
  WHEN length(e) >= 3 AND contains(s, e) THEN 0.95 WHEN length(s) >= 3 AND contains(e, s) AND length(s) / length(e) >= 0.7 THEN {r('0.75 + 0.2::DOUBLE * (length(s) / length(e))', 2)}
  WHEN len(sn) > 0 AND len(sn) = len(en) AND len(list_filter(list_zip(sn, en), lambda x: abs(x[1] - x[2]) > greatest(abs(x[2]) * 0.05::DOUBLE, 1e-4))) = 0 THEN 0.92
  WHEN len(st) > 0 AND len(et) > 0 THEN {r('len(list_intersect(st, et)) / len(list_distinct(list_concat(st, et)))', 3)} ELSE 0 END AS DOUBLE) AS similarity FROM n)"""
SQL["grd1_similarity"] = f"{SIMILAR} SELECT submission_id, similarity FROM similar_"
FLAT = "regexp_replace(lower({c}), ' |{p}', '', 'g')"
SQL["grd4_graded_submissions"] = f"""{SIMILAR}, g AS (SELECT *, {FLAT.format(c=STRIP.format(c='student_raw_input'), p='x=|ans=|answer=')} = {FLAT.format(c=STRIP.format(c='expected_answer'), p='x=')} OR similarity >= 0.7::DOUBLE AS is_correct FROM similar_),
h AS (SELECT *, CAST(CASE WHEN is_correct THEN greatest(92, {r('similarity * 100', 1)}) WHEN similarity >= 0.4::DOUBLE THEN {r('similarity * 75', 1)} ELSE {r('similarity * 50', 1)} END AS DOUBLE) AS accuracy_pct,
  CAST(CASE WHEN is_correct THEN greatest(0, {r('(1 - similarity) * 0.4::DOUBLE', 2)}) WHEN similarity >= 0.4::DOUBLE THEN least(0.65, greatest(0.3, {r('1 - similarity', 2)})) ELSE least(1, greatest(0.6, {r('1 - similarity', 2)})) END AS DOUBLE) AS error_severity FROM g),
{fuzzy('h', 'accuracy_pct', 'seconds_spent', 'attempts_count', 'error_severity', 'hints_requested')}
SELECT submission_id, is_correct, accuracy_pct, error_severity, fuzzy_score, performance_tier FROM fz"""
SQL["grd5_pathway"] = f"""WITH t AS (SELECT conv_id, CASE WHEN conv_id % 5 > 0 THEN count(*) FILTER (WHERE role = 'user') ELSE 0 END AS n, CAST(conv_id * 7 % 101 AS DOUBLE) AS score FROM conversations GROUP BY conv_id),
u AS (SELECT conv_id, n, CASE WHEN n > 0 THEN {r('score - greatest(30, 100 - n * 12.5)', 1)} ELSE CAST(0 AS DOUBLE) END AS score_delta_pct FROM t)
SELECT conv_id, CASE WHEN n > 0 THEN 'A' ELSE 'B' END AS pathway, score_delta_pct, CASE WHEN n = 0 THEN 'skipped' WHEN score_delta_pct > 15 THEN 'significant' WHEN score_delta_pct > 0 THEN 'moderate' ELSE 'negligible' END AS insight FROM u"""
DETAILS = f"{GRADED}, details AS (SELECT attempt_id, CAST(substr(student_id, 2) AS BIGINT) * 100 + day(ts) AS submission_id, question_id AS qId, is_correct, attempts_count, latency_seconds, fuzzy_score, error_severity FROM graded)"
SQL["jon1_exam_answers"] = f"""{DETAILS}, {BANK} SELECT attempt_id, d.qId, coalesce(nullif(moduleOrigin, ''), 'Core Topic') AS topic, coalesce(nullif(text, ''), 'Exam Problem') AS question, coalesce(formula, '') AS formula
  FROM details d LEFT JOIN bank b ON d.qId = b.qId"""
SQL["grd6_exam_reports"] = f"""{DETAILS}, e AS (SELECT submission_id, count(*) AS total_questions, CAST(sum(is_correct) AS BIGINT) AS correct_answers, {r('avg(fuzzy_score)', 6)} AS accuracy,
  CAST(floor({r('avg(latency_seconds)', 6)}) AS INT) AS average_latency, CAST(round_even(avg(attempts_count), 0) AS INT) AS average_attempts, {r('avg(error_severity)', 6)} AS sev FROM details GROUP BY submission_id),
{fuzzy('e', 'accuracy', 'average_latency', 'average_attempts', 'sev', '0')}
SELECT submission_id, total_questions, correct_answers, average_latency, average_attempts, fuzzy_score, performance_tier, 'B' AS pathway FROM fz"""
OFF = " OR ".join(f"regexp_matches(q1, {q('(?i)' + p)})" for p in OFF_TOPIC)
SQL["cls1_routed_inquiries"] = f"""WITH {INQUIRIES}, i1 AS (SELECT *, {STRIP.format(c='q')} AS q1 FROM inquiries), i2 AS (SELECT *, lower(q1) AS low FROM i1),
i3 AS (SELECT *, length(q1) >= 2 AND ({OFF}) AS off_, inquiry_type = 'solution' OR {holds('low', SOLUTION_WORDS)} AS sol, inquiry_type = 'hint' OR {holds('low', HINT_WORDS)} AS hint,
  len(list_filter(string_split_regex(low, '\\s+'), lambda w: w <> '')) >= 8 OR {holds('low', DEEP_WORDS)} AS deep FROM i2),
i4 AS (SELECT *, CAST(CASE WHEN sol THEN 20 WHEN hint THEN 55 WHEN consecutive_errors >= 2 THEN 30 WHEN deep THEN 90 ELSE 70 END AS DOUBLE) AS acc,
  CAST(CASE WHEN sol THEN 0.85 WHEN hint THEN 0.35 WHEN consecutive_errors >= 2 THEN 0.7 WHEN deep THEN 0.1 ELSE 0.35 END AS DOUBLE) AS sev FROM i3),
{fuzzy('i4', 'acc', 'time_taken', 'consecutive_errors + 1', 'sev', 'CASE WHEN hint THEN 1 ELSE 0 END')}
SELECT inquiry_id, CASE WHEN off_ THEN 'guardrail_deflection' WHEN hint AND NOT sol THEN 'hint' WHEN sol THEN 'solution' WHEN acc >= 85 OR performance_tier IN ('High Mastery', 'Moderate Mastery') THEN 'deep' ELSE 'surface' END AS depth_level, hint AS hint_requested,
  CASE WHEN off_ THEN 'This question isn''t about Course ' || (inquiry_id % 3) || '. Let''s stay with Chapter ' || (inquiry_id % 5) || ' and what it teaches about Science: which step of it is unclear to you?' END AS deflection,
  CAST(CASE WHEN off_ THEN 0 ELSE degree_of_failure END AS DOUBLE) AS degree_of_failure, CASE WHEN off_ THEN 50 ELSE fuzzy_score END AS fuzzy_score, CASE WHEN off_ THEN 'Developing' ELSE performance_tier END AS performance_tier, NOT off_ AND sol AS requires_remedial_routing FROM fz"""
_INQ = SQL["cls1_routed_inquiries"]
_AT = _INQ.index("SELECT inquiry_id, CASE WHEN off_")
SQL["cls1_routed_inquiries"] = f"{_INQ[:_AT].rstrip()}, routed AS ({_INQ[_AT:]}) SELECT *, CASE depth_level {' '.join(f'WHEN {q(k)} THEN {q(v)}' for k, v in NODES.items())} END AS active_node FROM routed"
SQL["src6_interactions"] = """SELECT event_id AS row_id, CASE WHEN event_id % 4 > 0 THEN CAST(user_id AS VARCHAR) ELSE 's' || user_id END AS "user",
  CASE WHEN event_type = 'view' THEN 'QA' ELSE event_type END AS action, event_id * 37 % 60000 AS elapsed_time FROM events"""
SQL["src7_first_log_rows"] = "SELECT event_id AS row_id, event_id * 37 % 60000 AS elapsed_time FROM events ORDER BY event_id LIMIT 5000"
CLEAN = STRIP.format(c=r"regexp_replace(regexp_replace(regexp_replace(regexp_replace(text, '\r\n?', chr(10), 'g'), '--- Page \d+ ---', '', 'g'), '\n{3,}', chr(10) || chr(10), 'g'), '[\x00-\x08\x0b\x0c\x0e-\x1f\x7f]', '', 'g')")
SQL["prj_text_forms"] = f"""WITH t AS (SELECT *, {STRIP.format(c=chr(114) + "egexp_replace(text, '\\s+', ' ', 'g')")} AS flat, {STRIP.format(c='text')} AS bare FROM documents), u AS (SELECT *, substr(flat, 1, 2400) AS head FROM t)
SELECT doc_id, md5({CLEAN}) AS cleaned,
  md5(CASE WHEN length(flat) <= 2400 THEN flat WHEN contains(head, '.') AND 2400 - instr(reverse(head), '.') > 2100 THEN substr(head, 1, 2401 - instr(reverse(head), '.')) ELSE head END) AS sample,
  md5(CASE WHEN length(bare) <= 7500 THEN bare ELSE substr(bare, 1, 3375) || chr(10) || chr(10) || '[... Core Section Analysis ...]' || chr(10) || chr(10)
    || substr(bare, CAST(greatest(3375, (length(bare) - 2625) // 2) AS BIGINT) + 1, 2625) || chr(10) || chr(10) || '[... Key Applications & Review ...]' || chr(10) || chr(10) || right(bare, 1500) END) AS "window",
  CAST(least(20000, length(text)) AS INT) AS capped, length(text) > 20000 AS truncated, CAST(length(text) AS INT) AS full_length,
  CASE WHEN length(text) > 400 THEN substr(text, 1, 400) || '...' ELSE text END AS preview,
  coalesce(nullif(substr(regexp_replace(regexp_replace(lower(text), '[^a-z0-9]+', '_', 'g'), '^_+|_+$', '', 'g'), 1, 48), ''), 'book') AS slug, substr(sha256(bare), 1, 16) AS content_hash FROM u"""
SQL["prj7_titles"] = "SELECT p_partkey, p_name AS title FROM part"
SQL["prj12_tiers"] = "SELECT event_id, CASE event_id % 9 WHEN 0 THEN 'introductory' WHEN 2 THEN 'advanced' WHEN 3 THEN 'introductory' WHEN 5 THEN 'advanced' WHEN 8 THEN 'introductory' ELSE 'standard' END AS tier FROM events"
_TIER_ROWS = ", ".join(f"({i}, {q(k)}, {q(x)}, {q(a)}, " + ", ".join(q("; ".join(v) if isinstance(v, tuple) else v) for v in TIER_RULES[k]) + ")" for i, (k, x, a) in enumerate(TIERS))
GUARDS = f"guards AS (SELECT * FROM (VALUES {_TIER_ROWS}) t(i, tier_key, label, audience, tone, math_ceiling, prohibitions, requirements))"
SQL["prj13_guardrails"] = f"WITH {GUARDS} SELECT doc_id, guards.* EXCLUDE (i) FROM documents JOIN guards ON doc_id % 3 = i"


def _count(name: str) -> str:
    return " + ".join(f"(length(c) - length(replace(c, {q(w)}, ''))) / {len(w)}" for w in SUBJECT_WORDS[name])


_TITLE = " ".join(f"WHEN {holds('lower(title)', ws)} THEN {q(name)}" for name, ws in TITLE_WORDS)
_BEST = " ".join(f"WHEN best >= 4 AND n{i} = best THEN {q(name)}" for i, name in enumerate(SUBJECT_WORDS))
SQL["prj14_subjects"] = f"""WITH t AS (SELECT doc_id, CASE WHEN doc_id % 13 = 0 THEN 'Organic matters' ELSE 'Notes' END AS title,
  CASE doc_id % 7 WHEN 0 THEN ' velocity force energy momentum wave' WHEN 1 THEN ' enzyme protein cell cell dna' ELSE '' END || ' ' || text AS body FROM documents),
u AS (SELECT *, lower(title || chr(10) || substr(body, 1, 20000)) AS c FROM t), v AS (SELECT doc_id, title, {', '.join(f'{_count(k)} AS n{i}' for i, k in enumerate(SUBJECT_WORDS))} FROM u),
w AS (SELECT *, greatest({', '.join(f'n{i}' for i in range(len(SUBJECT_WORDS)))}) AS best FROM v) SELECT doc_id, CASE {_TITLE} {_BEST} ELSE 'Computer Science' END AS subject FROM w"""
NON = f"(regexp_matches(b, {q(NON_THEORY)}) OR {holds('lower(b)', BOILERPLATE)})"
SQL["flt_line_predicates"] = f"""WITH {BOOK_LINES}, l AS (SELECT *, {STRIP.format(c='line')} AS b FROM book_lines), m AS (SELECT *, len(list_filter(string_split_regex(b, '\\s+'), lambda w: w <> '')) AS n FROM l)
SELECT book_id, CAST(sum(CASE WHEN length(b) BETWEEN 3 AND 95 AND regexp_matches(b, '[a-zA-Z]{{3,}}') AND NOT {NON} AND n <= 13 AND NOT (b LIKE '%.' AND n > 5) THEN 1 ELSE 0 END) AS BIGINT) AS heading,
  CAST(sum(CASE WHEN {NON} THEN 1 ELSE 0 END) AS BIGINT) AS non_theory,
  CAST(sum(CASE WHEN length(line) BETWEEN 90 AND 1400 AND NOT {holds('lower(line)', PUBLISHER_WORDS)} AND length(regexp_replace(line, '[^\\p{{L}}]', '', 'g')) / length(line) > 0.55::DOUBLE THEN 1 ELSE 0 END) AS BIGINT) AS educational,
  CAST(sum(CASE WHEN b = '' OR {' OR '.join(f'regexp_matches(b, {q(p)})' for p in NOISE)} THEN 1 ELSE 0 END) AS BIGINT) AS noise FROM m GROUP BY book_id"""
FORM = "lower(regexp_replace(regexp_replace(" + STRIP.format(c="line") + ", '[ \\t]{2,}', ' ', 'g'), '\\d+', '#', 'g'))"
HEADERS = f"""headers AS (SELECT book_id, {FORM} AS form, count(*) AS n FROM book_lines WHERE length({STRIP.format(c='line')}) BETWEEN 8 AND 90 AND regexp_matches(line, '[A-Za-z]{{3}}') AND regexp_matches(line, '\\d')
  GROUP BY ALL HAVING count(*) >= 5)"""
SQL["str2_running_headers"] = f"WITH {BOOK_LINES}, {HEADERS} SELECT * FROM headers"
SQL["str3_body_lines"] = f"""WITH {BOOK_LINES}, {HEADERS}, l AS (SELECT *, {STRIP.format(c='line')} AS b FROM book_lines)
SELECT book_id, count(*) AS lines, CAST(sum(pos) AS BIGINT) AS pos_sum FROM l WHERE NOT (b = '' OR {' OR '.join(f'regexp_matches(b, {q(p)})' for p in NOISE)})
  AND NOT EXISTS (SELECT 1 FROM headers h WHERE h.book_id = l.book_id AND h.form = {FORM.replace('(line', '(l.line')}) GROUP BY book_id"""
def _roman(n: int) -> str:
    ones = ("", "I", "II", "III", "IV", "V", "VI", "VII", "VIII", "IX")
    tens = [x.replace("X", "C").replace("V", "L").replace("I", "X") for x in ones]
    return "C" * (n // 100) + tens[n // 10 % 10] + ones[n % 10]


def _worded(n: int) -> str:
    if n <= 20:
        return NUMBER_WORDS[n - 1]
    tens, ones = divmod(n, 10)
    return " ".join([("twenty", "thirty")[tens - 2], *([NUMBER_WORDS[ones - 1]] if ones else [])])


def _family(kind: str, pattern: str, style: str) -> str:
    """One family's lines: kind, position, number and title."""
    token = f"regexp_extract(line, {q(pattern)}, 1)"
    named = f"(SELECT min(n) FROM names WHERE name = lower(regexp_replace({token}, '[ \\-]+', ' ', 'g')))"
    number = {"digits": f"CAST(nullif({token}, '') AS INT)", "roman": named, "word": named, "hash": f"CAST(length({token}) AS INT)"}.get(style, "0")
    title = STRIP.format(c=f"regexp_extract(line, {q(pattern)}, {1 if style == 'order' else 2})")
    return f"SELECT book_id, pos, line_no, line, '{kind}' AS kind, {number} AS number, {title} AS title FROM book_lines WHERE length(line) <= 110 AND regexp_matches(line, {q(pattern)})"


NAMES = ", ".join([f"('{_roman(n).lower()}', {n})" for n in range(1, 201)] + [f"('{_worded(n)}', {n})" for n in range(1, 36)])
VALID = f"length(b) BETWEEN 3 AND 95 AND regexp_matches(b, '[a-zA-Z]{{3,}}') AND NOT {NON} AND len(list_filter(string_split_regex(b, '\\s+'), lambda w: w <> '')) <= 13 AND NOT (b LIKE '%.' AND len(string_split_regex(b, '\\s+')) > 5)"
HEADS = f"""{BOOK_LINES}, names AS (SELECT * FROM (VALUES {NAMES}) t(name, n)),
found AS ({" UNION ALL ".join(_family(k, p, style) for k, p, style, _ in FAMILIES)}
  UNION ALL SELECT n.book_id, n.pos, n.line_no, n.line, 'bare_num_title', CAST(regexp_extract(n.line, {q(BARE_NUMBER)}, 1) AS INT), {STRIP.format(c=f"regexp_extract(t.line, {q(BARE_TITLE)}, 1)")}
  FROM book_lines n JOIN book_lines t ON n.book_id = t.book_id AND n.line_no + 1 = t.line_no WHERE regexp_matches(n.line, {q(BARE_NUMBER)}) AND regexp_matches(t.line, {q(BARE_TITLE)})),
prose AS (SELECT * FROM found WHERE NOT ({" OR ".join(f"regexp_matches(title, {q(p)})" for p in CODE)})),
behind AS (SELECT p.book_id, p.kind, p.line_no, arg_min({STRIP.format(c="l.line")}, l.line_no) AS t FROM prose p JOIN book_lines l ON l.book_id = p.book_id AND l.line_no BETWEEN p.line_no + 1 AND p.line_no + 4 AND {STRIP.format(c="l.line")} <> '' WHERE p.title = '' GROUP BY ALL),
counted AS (SELECT p.* REPLACE (CASE WHEN p.title = '' AND length(t) <= 95 AND NOT regexp_matches(t, '^\\d+$') THEN regexp_replace(t, '\\s{{2,}}', ' ', 'g') ELSE p.title END AS title)
  FROM prose p LEFT JOIN behind b ON b.book_id = p.book_id AND b.kind = p.kind AND b.line_no = p.line_no WHERE p.kind NOT IN ('hash_headings', 'titled_caps') AND number BETWEEN 1 AND 200),
marked AS (SELECT *, count(*) OVER (PARTITION BY book_id, number) AS n FROM prose WHERE kind = 'hash_headings' AND NOT (pos <= 200 AND number = 1 AND NOT regexp_matches(title, '(?i)\\d|chapter|unit|lesson'))),
capital AS (SELECT p.*, {STRIP.format(c="regexp_replace(title, '^#+', '')")} AS b FROM prose p WHERE kind = 'titled_caps' AND lower(title) NOT IN ({", ".join(map(q, NO_CHAPTER))})
  AND NOT EXISTS (SELECT 1 FROM counted c WHERE c.book_id = p.book_id AND {FORM.replace("(line", "(c.line")} = {FORM.replace("(line", "(p.line")})),
heads AS (SELECT book_id, kind, pos, line_no, number, title FROM counted
  UNION ALL SELECT book_id, kind, pos, line_no, CAST(row_number() OVER (PARTITION BY book_id ORDER BY pos) AS INT), title FROM (SELECT *, min(number) FILTER (WHERE n >= 3) OVER (PARTITION BY book_id) AS top FROM marked) WHERE number = top
  UNION ALL SELECT book_id, kind, pos, line_no, CAST(row_number() OVER (PARTITION BY book_id ORDER BY pos) AS INT), title FROM capital WHERE {VALID})"""
SQL["str7_heading_candidates"] = f"WITH {HEADS} SELECT book_id, kind, pos, number, title FROM heads"
PLACES = ", ".join(f"('{k}', {i})" for i, k in enumerate([*[k for k, *_ in FAMILIES][:7], "bare_num_title", *[k for k, *_ in FAMILIES][7:]])) + ", ('grouped_numdot', 9.5)"
EXPLICITS = ", ".join(map(q, EXPLICIT))
#: The texts hold no printed contents and no numbers twice, so both have no part here.
BEST = f"""{HEADS}, gaps AS (SELECT *, pos - lag(pos) OVER (PARTITION BY book_id, kind ORDER BY pos, line_no) AS gap FROM heads),
steps AS (SELECT book_id, kind, gap, lag(gap) OVER (PARTITION BY book_id, kind ORDER BY gap) AS small, count(*) OVER (PARTITION BY book_id, kind) AS k FROM gaps WHERE gap > 0),
jumps AS (SELECT * FROM (SELECT book_id, kind, gap / small AS ratio, sqrt(CAST(small AS DOUBLE) * gap) AS bound, row_number() OVER (PARTITION BY book_id, kind ORDER BY gap / small DESC, gap) AS rn FROM steps WHERE small IS NOT NULL AND k >= 4) WHERE rn = 1),
runs AS (SELECT g.*, ratio, sum(CASE WHEN gap IS NULL OR gap >= bound THEN 1 ELSE 0 END) OVER (PARTITION BY g.book_id, g.kind ORDER BY pos, line_no) AS run FROM gaps g LEFT JOIN jumps j ON g.book_id = j.book_id AND g.kind = j.kind),
flags AS (SELECT *, coalesce(ratio >= 4 AND count(*) OVER (PARTITION BY book_id, kind, run) >= 3 AND count(*) OVER (PARTITION BY book_id, kind) >= 5, FALSE) AS dense FROM runs),
shares AS (SELECT *, dense AND count(*) FILTER (WHERE dense) OVER (PARTITION BY book_id, kind) <= 0.8::DOUBLE * count(*) OVER (PARTITION BY book_id, kind) AS listed FROM flags),
body AS (SELECT book_id, kind, pos, line_no, number, title FROM (SELECT *, bool_or(NOT listed) OVER (PARTITION BY book_id, kind, number) AS told, row_number() OVER (PARTITION BY book_id, kind, number, listed ORDER BY pos DESC) AS rn FROM shares) WHERE NOT listed OR (NOT told AND rn = 1)),
chars AS (SELECT book_id, max(pos + length(line)) AS chars FROM book_lines GROUP BY book_id),
seqs AS (SELECT *, sum(CASE WHEN number = before + 1 THEN 0 ELSE 1 END) OVER (PARTITION BY book_id, kind ORDER BY pos, line_no) AS seq_run FROM (SELECT *, lag(number) OVER (PARTITION BY book_id, kind ORDER BY pos, line_no) AS before FROM body)),
longest AS (SELECT book_id, kind, max(n) AS longest FROM (SELECT book_id, kind, seq_run, count(*) AS n FROM seqs GROUP BY ALL) GROUP BY ALL),
fams AS (SELECT book_id, kind, count(*) AS n, (max(pos) - min(pos)) / greatest(max(chars), 1) AS spread,
  avg(CASE WHEN title = '' THEN CASE WHEN kind IN ('hash_headings', 'titled_caps') THEN 0.2::DOUBLE ELSE 0.85::DOUBLE END WHEN length(title) BETWEEN 3 AND 85 THEN 1 ELSE 0.4::DOUBLE END) AS quality
  FROM body JOIN chars USING (book_id) GROUP BY ALL HAVING count(*) BETWEEN 3 AND 120),
scored AS (SELECT book_id, kind, n, longest / n AS seq, spread, {r("greatest(0, 0.4::DOUBLE * (longest / n) + 0.22::DOUBLE * spread + 0.23::DOUBLE * quality + 0.15::DOUBLE * least(n, 12) / 12 + CASE WHEN kind LIKE 'unit%' THEN -0.08::DOUBLE WHEN kind = 'hash_headings' AND spread < 0.35::DOUBLE THEN -0.35::DOUBLE WHEN kind = 'titled_caps' AND spread < 0.35::DOUBLE THEN -0.15::DOUBLE ELSE 0 END)", 6)} AS score FROM fams JOIN longest USING (book_id, kind)),
best AS (SELECT * FROM (SELECT s.*, row_number() OVER (PARTITION BY book_id ORDER BY score DESC, p.place) AS rn FROM scored s JOIN (VALUES {PLACES}) p(kind, place) ON s.kind = p.kind
  WHERE s.kind <> 'grouped_numdot' OR s.book_id NOT IN (SELECT book_id FROM scored WHERE kind IN ({EXPLICITS}) AND (seq >= 0.45::DOUBLE OR kind = 'hash_headings') AND spread >= 0.35::DOUBLE)) WHERE rn = 1),
chapters AS (SELECT h.book_id, 'ch_' || number || CASE WHEN row_number() OVER (PARTITION BY h.book_id, number ORDER BY pos) > 1 THEN '_' || row_number() OVER (PARTITION BY h.book_id, number ORDER BY pos) ELSE '' END AS chapter_id,
  CAST(row_number() OVER w AS INT) AS chapter_index, number, pos AS start, coalesce(lead(pos) OVER w, chars) AS "end" FROM body h JOIN best b ON h.book_id = b.book_id AND h.kind = b.kind JOIN chars c ON c.book_id = h.book_id WINDOW w AS (PARTITION BY h.book_id ORDER BY pos))"""
SQL["str14_family_scores"] = f"WITH {BEST} SELECT book_id, kind, n, score FROM best"
_T = STRIP.format(c="line")
#: What follows the number can't be a full stop anyway; the SQL engine knows no look-ahead.
_TITLED = TITLED_MARK.replace(r"(?!\.)", "")
TOC = f"""fronts AS (SELECT book_id, max(pos) * 0.35::DOUBLE AS part_ FROM book_lines GROUP BY 1),
opens AS (SELECT book_id, min(line_no) AS o FROM book_lines JOIN fronts USING (book_id) WHERE regexp_matches(line, '(?i)^\\s*(?:table of |brief )?contents\\s*$') AND pos <= greatest(6000, part_) GROUP BY 1),
near_ AS (SELECT l.*, o FROM book_lines l JOIN opens USING (book_id) WHERE line_no > o AND line_no <= o + 400),
walls AS (SELECT book_id, min(CASE WHEN length(line) > {PROSE} THEN line_no END) AS w FROM near_ GROUP BY 1),
tends AS (SELECT book_id, max(pos + length(line)) AS e FROM near_ JOIN walls USING (book_id) WHERE (w IS NULL OR line_no < w) AND regexp_matches(line, {q(TOC_LINE)}) GROUP BY 1)"""
def _unpaged(c: str) -> str:
    return f"trim(regexp_replace({c}, {q(PAGE)}, ''))"


CONTENTS = f"""{TOC}, clines AS (SELECT book_id, line_no, {_T} AS t FROM near_ JOIN tends USING (book_id) WHERE pos < e AND {_T} <> ''),
kinds AS (SELECT *, CASE WHEN regexp_matches(t, {q(ENTRY)}) THEN 'entry' WHEN regexp_matches(t, {q(BARE_MARK)}) THEN 'bare' WHEN regexp_matches(t, {q(_TITLED)}) THEN 'titled' WHEN regexp_matches(t, '[A-Za-z]{{3,}}') THEN 'plain' END AS k,
  CAST(nullif(regexp_extract(t, {q(PAGE)}, 1), '') AS INT) AS page FROM clines),
marks AS (SELECT *, CASE k WHEN 'bare' THEN TRY_CAST(regexp_extract(t, {q(BARE_MARK)}, 1) AS INT) WHEN 'titled' THEN TRY_CAST(regexp_extract(t, {q(_TITLED)}, 1) AS INT) END AS mark FROM kinds),
owned AS (SELECT *, last_value(CASE WHEN mark IS NOT NULL THEN line_no END IGNORE NULLS) OVER w AS at_, last_value(mark IGNORE NULLS) OVER w AS chapter FROM marks WINDOW w AS (PARTITION BY book_id ORDER BY line_no)),
fits AS (SELECT * FROM owned WHERE at_ IS NOT NULL AND (k IS DISTINCT FROM 'entry' OR TRY_CAST(regexp_extract(t, {q(ENTRY)}, 1) AS INT) = chapter)),
stops AS (SELECT *, least(min(CASE WHEN k = 'entry' THEN line_no - 1 END) OVER w, min(CASE WHEN k = 'plain' AND page IS NOT NULL THEN line_no END) OVER w) AS stop FROM fits WINDOW w AS (PARTITION BY book_id, at_)),
chaps_ AS (SELECT book_id, at_, chapter, coalesce(max(CASE WHEN k = 'titled' THEN {_unpaged(f"regexp_extract(t, {q(_TITLED)}, 2)")} END),
    nullif(trim(regexp_replace(string_agg({_unpaged("t")}, ' ' ORDER BY line_no) FILTER (WHERE k = 'plain' AND (stop IS NULL OR line_no <= stop)), '\\s{{2,}}', ' ', 'g')), '')) AS title,
  CASE WHEN NOT bool_or(coalesce(k = 'titled', FALSE)) THEN arg_min(page, line_no) FILTER (WHERE k = 'plain' AND page IS NOT NULL AND (stop IS NULL OR line_no <= stop)) END AS page,
  coalesce(string_agg(TRY_CAST(regexp_extract(t, {q(ENTRY)}, 2) AS INT) || ' ' || {_unpaged(f"regexp_extract(t, {q(ENTRY)}, 3)")}, '; ' ORDER BY line_no) FILTER (WHERE k = 'entry'), '') AS sections,
  arg_min(TRY_CAST(regexp_extract(t, {q(ENTRY)}, 2) AS INT), line_no) FILTER (WHERE k = 'entry') AS first_section FROM stops GROUP BY ALL),
once AS (SELECT * FROM chaps_ WHERE title IS NOT NULL AND (sections <> '' OR page IS NOT NULL) QUALIFY row_number() OVER (PARTITION BY book_id, chapter ORDER BY at_) = 1),
paged AS (SELECT *, coalesce(page < last_value(page IGNORE NULLS) OVER (PARTITION BY book_id ORDER BY at_ ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), FALSE) AS back FROM once),
cplan AS (SELECT * FROM paged QUALIFY count(*) OVER (PARTITION BY book_id) >= 3 AND (count(page) OVER (PARTITION BY book_id) < 3 OR NOT bool_or(back) OVER (PARTITION BY book_id)))"""
ANCHORS = f"""{CONTENTS}, hits_ AS (SELECT h.book_id, number AS chapter, min(pos) AS at_heading FROM heads h JOIN tends USING (book_id) WHERE pos >= e AND regexp_matches(kind, '^(chapter|unit|lesson)_') GROUP BY ALL),
labels_ AS (SELECT l.book_id, CAST(regexp_extract(line, '^\\s*(\\d+)\\.(\\d+)', 1) AS INT) AS chapter, CAST(regexp_extract(line, '^\\s*(\\d+)\\.(\\d+)', 2) AS INT) AS first_section, min(pos) AS at_label FROM book_lines l JOIN tends USING (book_id)
  WHERE pos >= e AND regexp_matches(line, '^\\s*\\d{{1,3}}\\.\\d{{1,3}}\\s+[A-Z]') GROUP BY ALL),
placed_ AS (SELECT p.book_id, p.chapter, title, coalesce(at_heading, at_label) AS start, at_heading IS NULL AS by_label FROM cplan p LEFT JOIN hits_ h ON h.book_id = p.book_id AND h.chapter = p.chapter
  LEFT JOIN labels_ l ON l.book_id = p.book_id AND l.chapter = p.chapter AND l.first_section = p.first_section WHERE coalesce(at_heading, at_label) IS NOT NULL),
anchored AS (SELECT book_id, 'ch_' || chapter AS chapter_id, CAST(row_number() OVER w AS INT) AS chapter_index, title, start, coalesce(lead(start) OVER w, ends_) AS "end", by_label FROM placed_ JOIN (SELECT book_id, max(pos + length(line)) AS ends_ FROM book_lines GROUP BY 1) USING (book_id)
  WINDOW w AS (PARTITION BY book_id ORDER BY start, chapter) QUALIFY count(*) OVER (PARTITION BY book_id) >= 3)"""
#: The texts hold no hash heading and no chapter outline before a numbered section.
_GROUP = f"""ghits AS (SELECT l.book_id, pos, line_no, CAST(regexp_extract(line, {q(GROUPED)}, 1) AS INT) AS number, {STRIP.format(c=f"regexp_replace(regexp_extract(line, {q(GROUPED)}, 3), '\\s+\\d{{1,4}}$', '')")} AS own, coalesce(pos < e, FALSE) AS ahead,
  count(*) OVER (PARTITION BY l.book_id) AS every FROM book_lines l LEFT JOIN tends USING (book_id) WHERE regexp_matches(line, {q(GROUPED)})),
ggroups AS (SELECT book_id, number, arg_min(pos, (ahead, pos)) AS pos, arg_min(line_no, (ahead, pos)) AS line_no, arg_min(own, (ahead, pos)) AS own FROM ghits WHERE every >= 4 AND NOT {holds('lower(own)', BOILERPLATE)} GROUP BY ALL),
gruns AS (SELECT *, CASE WHEN lag(number) OVER (PARTITION BY book_id ORDER BY number) + 1 = number THEN 1 ELSE 0 END AS follows FROM ggroups),
gkept AS (SELECT * FROM gruns QUALIFY count(*) OVER (PARTITION BY book_id) BETWEEN 3 AND 120 AND sum(follows) OVER (PARTITION BY book_id) >= 0.4::DOUBLE * count(*) OVER (PARTITION BY book_id)),
gback AS (SELECT g.book_id, g.number, list(struct_pack(l := l.line_no, p := l.pos, t := {STRIP.format(c="l.line")}) ORDER BY l.line_no DESC) AS b FROM gkept g JOIN book_lines l ON l.book_id = g.book_id AND l.line_no BETWEEN g.line_no - 6 AND g.line_no - 1
  AND {STRIP.format(c="l.line")} <> '' AND g.pos - l.pos <= 800 GROUP BY ALL),
gheads AS (SELECT g.book_id, 'grouped_numdot' AS kind, CASE WHEN told THEN b[2].p ELSE pos END AS pos, CASE WHEN told THEN b[2].l ELSE line_no END AS line_no, number,
  {STRIP.format(c="regexp_replace(CASE WHEN told THEN b[1].t ELSE own END, '\\s+\\d{1,4}\\s*$', '')")} AS title
  FROM (SELECT g.*, b, coalesce(regexp_matches(b[1].t, '^[A-Z].{{3,80}}$') AND b[2].t = CAST(g.number AS VARCHAR) AND NOT {holds('lower(b[1].t)', BOILERPLATE)}, FALSE) AS told FROM gkept g LEFT JOIN gback k ON k.book_id = g.book_id AND k.number = g.number) g)"""
_AFTER_HEADS = BEST[len(HEADS):].replace("FROM heads)", "FROM inbody)").replace("body AS (SELECT book_id, kind, pos", "body0 AS (SELECT book_id, kind, pos", 1)
_CHARS = _AFTER_HEADS[_AFTER_HEADS.index("chars AS ("):_AFTER_HEADS.index("seqs AS (")]
STYLED_BEST = f"""{HEADS}, {TOC}, inbody AS (SELECT book_id, kind, pos, line_no, number, title FROM (SELECT h.*, coalesce(pos >= e, TRUE) AS inside FROM heads h LEFT JOIN tends USING (book_id)) QUALIFY inside OR count(*) FILTER (WHERE inside) OVER (PARTITION BY book_id, kind) < 3)""" + _AFTER_HEADS.replace(_CHARS, _CHARS + f"""tight AS (SELECT b.*, CASE WHEN pos - lag(pos) OVER (PARTITION BY b.book_id, kind ORDER BY pos) > greatest(400, chars * 0.005::DOUBLE) THEN 1 ELSE 0 END AS far FROM body0 b JOIN chars USING (book_id)),
leads_ AS (SELECT *, sum(far) OVER (PARTITION BY book_id, kind ORDER BY pos ROWS UNBOUNDED PRECEDING) = 0 AS front FROM tight),
body1 AS (SELECT book_id, kind, pos, line_no, number, title FROM leads_ QUALIFY NOT (front AND count(*) FILTER (WHERE front) OVER (PARTITION BY book_id, kind) >= 3 AND count(*) FILTER (WHERE front) OVER (PARTITION BY book_id, kind) < count(*) OVER (PARTITION BY book_id, kind)
  AND count(*) OVER (PARTITION BY book_id, kind) >= 4 AND max(pos) OVER (PARTITION BY book_id, kind, number) > pos)),
{_GROUP}, body AS (SELECT * FROM body1 UNION ALL SELECT book_id, kind, pos, line_no, number, title FROM gheads),
""")
_HASHES = "length(regexp_extract(line, '^[ \\t]*(#*)', 1))"
_COUNTS = ", ".join(
    f"count(DISTINCT CASE WHEN regexp_matches(line, {q(p)}) AND TRY_CAST(regexp_extract(line, {q(p)}, 1) AS INT) = number THEN regexp_extract(line, {q(p)}, 2) END) AS {k}" if k.startswith("numdot") else f"count(*) FILTER (WHERE regexp_matches(line, {q(p)})) AS {k}"
    for k, p, *_ in SECTION_KINDS
)
_RAW = ", ".join(f"0.7::DOUBLE * avg(CASE WHEN {k} BETWEEN 2 AND 15 THEN 1 ELSE 0 END) + 0.3::DOUBLE * least(avg({k}), 8) / 8 AS {k}" for k, *_ in SECTION_KINDS)
_TOTALS = ", ".join(f"{{'total': {k} + {weight}::DOUBLE, 'place': -{i}, 'kind': '{k}', 'raw': {k}}}" for i, (k, _, _, weight) in enumerate(SECTION_KINDS))
KINDS = f"""{STYLED_BEST}, clines_ AS (SELECT l.book_id, line_no, pos, line, c.chapter_id, c.number, c.start, b.kind AS ckind FROM book_lines l JOIN chapters c ON c.book_id = l.book_id AND pos >= c.start AND pos < c."end" JOIN best b ON b.book_id = l.book_id),
tops_ AS (SELECT book_id, min({_HASHES}) FILTER (WHERE pos = start AND ckind = 'hash_headings') AS top FROM clines_ GROUP BY 1),
counts_ AS (SELECT book_id, chapter_id, top, {_COUNTS}, count(*) FILTER (WHERE regexp_matches(line, '^[ \\t]*#+[ \\t]*[^# \\t]') AND {_HASHES} >= top + 1) AS hashes FROM clines_ JOIN tops_ USING (book_id) GROUP BY ALL),
books_ AS (SELECT book_id, top, count(*) AS n, avg(CASE WHEN hashes BETWEEN 2 AND 15 THEN 1 ELSE 0 END) AS hashed, {_RAW} FROM counts_ GROUP BY book_id, top),
bests_ AS (SELECT *, list_max([{_TOTALS}]) AS b, top IS NOT NULL AND n >= 2 AND hashed >= 0.6::DOUBLE AS by_hash FROM books_),
skinds AS (SELECT book_id, CASE WHEN by_hash THEN 'hash_headings' WHEN n >= 2 AND b.raw >= 0.6::DOUBLE AND b.total > 0 THEN b.kind ELSE 'chunk' END AS kind, {r("CASE WHEN by_hash THEN hashed ELSE b.raw END", 6)} AS score, CASE WHEN by_hash THEN CAST(top + 1 AS INT) END AS level FROM bests_)"""
_S = STRIP.format(c="line")
_NAMES = " ".join(
    f"WHEN k.kind = '{k}' AND regexp_matches({_S}, {q(p)})"
    + (f" AND (ckind IN ('hash_headings', 'titled_caps') OR TRY_CAST(regexp_extract({_S}, {q(p)}, 1) AS INT) = number)" if k.startswith("numdot") else "")
    + f" AND regexp_matches({_unpaged(f'regexp_extract({_S}, {q(p)}, {g})')}, '[A-Za-z]{{3,}}') THEN {_unpaged(f'regexp_extract({_S}, {q(p)}, {g})')}"
    for k, p, g, _ in SECTION_KINDS
)
_NUMDOT = SECTION_KINDS[0][1]
KIND_SECTIONS = f"""{KINDS}, named AS (SELECT c.*, k.kind AS skind, CASE WHEN pos = start OR length({_S}) NOT BETWEEN 1 AND 110 THEN NULL
    WHEN k.kind = 'hash_headings' AND length(regexp_extract({_S}, '^(#*)', 1)) >= level AND length(trim(regexp_replace({_S}, '^#+[ \\t]*|[ \\t]*#*[ \\t]*$', '', 'g'))) >= 3 THEN trim(regexp_replace({_S}, '^#+[ \\t]*|[ \\t]*#*[ \\t]*$', '', 'g')) {_NAMES} END AS name
  FROM clines_ c JOIN skinds k ON k.book_id = c.book_id AND k.kind <> 'chunk'),
tagged AS (SELECT *, CASE WHEN name IS NOT NULL AND skind LIKE 'numdot%' THEN CAST(regexp_extract({_S}, {q(_NUMDOT)}, 1) AS INT) || '.' || regexp_extract({_S}, {q(_NUMDOT)}, 2) END AS tag FROM named),
unique_ AS (SELECT * REPLACE (CASE WHEN tag IS NULL OR row_number() OVER (PARTITION BY book_id, chapter_id, tag ORDER BY line_no) = 1 THEN name END AS name) FROM tagged),
run_ AS (SELECT *, count(name) OVER (PARTITION BY book_id, chapter_id ORDER BY line_no) AS sec, coalesce(line_no >= min(CASE WHEN lower({_S}) IN ({", ".join(map(q, REVIEW))}) THEN line_no END) OVER (PARTITION BY book_id, chapter_id), FALSE) AS rest FROM unique_),
parts_ AS (SELECT * REPLACE (CASE WHEN rest THEN 0 ELSE sec END AS sec), sec AS every FROM run_),
ktexts AS (SELECT book_id, chapter_id, CASE WHEN rest THEN number || '.r' WHEN sec = 0 THEN number || '.0' ELSE max(CASE WHEN name IS NOT NULL THEN coalesce(tag, number || '.' || every) END) END AS label,
  CASE WHEN rest THEN 'Glossary, Summary & Exercises' WHEN sec = 0 THEN 'Introduction' ELSE max(name) END AS title, count(*) AS lines,
  coalesce({STRIP.format(c="string_agg(line, chr(10) ORDER BY line_no) FILTER (WHERE pos <> start AND (name IS NULL OR rest))")}, '') AS content, CASE WHEN rest THEN 201 WHEN sec = 0 THEN 121 ELSE 80 END AS least FROM parts_ GROUP BY book_id, chapter_id, number, rest, sec)"""


def styled(sql: str) -> str:
    return sql.replace(BOOK_LINES, STYLED_LINES)


SQL["str10_grouped_headings"] = f"WITH {STYLED_LINES}, {TOC}, {_GROUP} SELECT book_id, number, pos, title FROM gheads"
SQL["str19_contents_plan"] = f"WITH {STYLED_LINES}, {CONTENTS} SELECT book_id, chapter, title, page, sections FROM cplan"
SQL["str20_anchored_chapters"] = styled(f'WITH {HEADS}, {ANCHORS} SELECT book_id, chapter_id, chapter_index, title, start, "end", by_label FROM anchored')
SQL["str20_styled_chapters"] = styled(f'WITH {STYLED_BEST} SELECT c.book_id, kind, chapter_id, chapter_index, start, "end", CAST((chapter_index - 1) // 7 + 1 AS INT) AS unit_index FROM chapters c JOIN best USING (book_id)')
SQL["str21_section_kinds"] = styled(f"WITH {KINDS} SELECT * FROM skinds")
SQL["str22_styled_sections"] = styled(f"WITH {KIND_SECTIONS} SELECT book_id, chapter_id, label, title, lines, md5(content) AS content FROM ktexts WHERE length(content) >= least")
SQL["str7_styled_headings"] = SQL["str7_heading_candidates"].replace(BOOK_LINES, STYLED_LINES)
SQL["str14_styled_scores"] = f"WITH {BEST} SELECT book_id, kind, n, score FROM scored".replace(BOOK_LINES, STYLED_LINES)
SQL["str20_chapters"] = f'WITH {BEST} SELECT book_id, chapter_id, chapter_index, start, "end", CAST((chapter_index - 1) // 7 + 1 AS INT) AS unit_index FROM chapters'
SQL["str23_sections"] = f"""WITH {BEST}, own AS (SELECT l.book_id, chapter_id, c.number, line_no, line, pos = start AS head, CASE WHEN length(line) <= 110 AND regexp_matches(line, {q(SECTION)}) AND regexp_extract(line, {q(SECTION)}, 1) = CAST(c.number AS VARCHAR)
    AND regexp_matches(regexp_extract(line, {q(SECTION)}, 3), '[A-Za-z]{{3,}}') AND NOT regexp_matches(line, '[•·ò]') THEN CAST(regexp_extract(line, {q(SECTION)}, 2) AS INT) END AS label
  FROM book_lines l JOIN chapters c ON l.book_id = c.book_id AND pos >= start AND pos < "end"),
firsts AS (SELECT *, CASE WHEN row_number() OVER (PARTITION BY book_id, chapter_id, label ORDER BY line_no) = 1 THEN label END AS mark, min(CASE WHEN lower({STRIP.format(c="line")}) IN ({", ".join(map(q, REVIEW))}) THEN line_no END) OVER (PARTITION BY book_id, chapter_id) AS review FROM own),
placed AS (SELECT *, coalesce(line_no >= review, FALSE) AS rest, coalesce(last_value(mark IGNORE NULLS) OVER (PARTITION BY book_id, chapter_id ORDER BY line_no), 0) AS sec FROM firsts),
texts AS (SELECT book_id, chapter_id, number || '.' || CASE WHEN rest THEN 'r' ELSE CAST(sec AS VARCHAR) END AS label, CASE WHEN rest THEN 'Glossary, Summary & Exercises' WHEN sec = 0 THEN 'Introduction' ELSE max(CASE WHEN mark IS NOT NULL THEN {STRIP.format(c=f"regexp_extract(line, {q(SECTION)}, 3)")} END) END AS title,
  count(*) AS lines, coalesce({STRIP.format(c="string_agg(line, chr(10) ORDER BY line_no) FILTER (WHERE NOT head AND (mark IS NULL OR rest))")}, '') AS content, CASE WHEN rest THEN 201 WHEN sec = 0 THEN 121 ELSE 80 END AS least FROM (SELECT * REPLACE (CASE WHEN rest THEN 0 ELSE sec END AS sec) FROM placed) GROUP BY book_id, chapter_id, number, rest, sec)
SELECT book_id, chapter_id, label, title, lines, md5(content) AS content FROM texts WHERE length(content) >= least"""
PLAN = f"""{OUTLINES}, ranked AS (SELECT *, dense_rank() OVER (PARTITION BY book_id ORDER BY level) AS place FROM outlines),
inner_ AS (SELECT *, lag(page) OVER (PARTITION BY book_id, level ORDER BY seq) AS before FROM ranked WHERE place <= 2 AND title NOT IN ('Preface', 'Index')),
chosen AS (SELECT book_id, min(level) AS top FROM (SELECT book_id, level FROM inner_ GROUP BY ALL HAVING count(*) >= 3 AND NOT coalesce(bool_or(page < before), FALSE)) GROUP BY book_id),
chaps AS (SELECT i.book_id, seq, top, CAST(regexp_extract(title, '^\\w+ (\\d+): (.*)$', 1) AS INT) AS chapter, regexp_extract(title, '^\\w+ (\\d+): (.*)$', 2) AS chapter_title, page, lead(page) OVER (PARTITION BY i.book_id ORDER BY seq) AS stop,
  FROM inner_ i JOIN chosen c ON i.book_id = c.book_id AND i.level = c.top)"""
SQL["str16_ladder"] = f"""WITH {PLAN}, {BOOK_LINES} SELECT book_id, CASE WHEN book_id IN (SELECT book_id FROM chaps) AND book_id LIKE '%1-%' THEN 'outline' WHEN max(part) >= 3 THEN 'headings' ELSE 'chunks' END AS rung FROM book_lines GROUP BY book_id"""
SQL["str17_outline_plan"] = f"""WITH {PLAN}, tops AS (SELECT o.*, top, (SELECT max(seq) FROM outlines x WHERE x.book_id = o.book_id AND x.level <= top AND x.seq <= o.seq) AS g FROM outlines o JOIN chosen USING (book_id)),
kids AS (SELECT t.book_id, t.seq, t.title, t.page, c.chapter, c.chapter_title, c.stop, min(CASE WHEN t.title = 'Chapter Review' THEN t.page END) OVER (PARTITION BY t.book_id, c.seq) AS review, t.level = c.top + 1 AS next_level, c.seq AS cseq FROM tops t JOIN chaps c ON c.book_id = t.book_id AND c.seq = t.g WHERE t.level > t.top),
secs AS (SELECT *, row_number() OVER w AS k, coalesce(lead(page) OVER w, review, stop) AS stop_page FROM kids WHERE title <> 'Chapter Review' AND (regexp_matches(title, '^\\d+\\.\\d+') OR (next_level AND title <> 'Summary')) WINDOW w AS (PARTITION BY book_id, cseq ORDER BY seq)),
{BOOK_LINES}, wc AS (SELECT book_id, part, sum(len(list_filter(string_split_regex(line, '\\s+'), lambda w: w <> ''))) AS words FROM book_lines GROUP BY ALL)
SELECT s.book_id, chapter, chapter_title, CASE WHEN title LIKE '%Named%' THEN split_part(title, ' ', 1) ELSE chapter || '.' || k END AS label, CASE WHEN title LIKE '%Named%' THEN substr(title, instr(title, ' ') + 1) ELSE title END AS title, page AS first_page, stop_page, CAST(sum(words) AS BIGINT) AS words
FROM secs s JOIN wc ON wc.book_id = s.book_id AND part >= page AND part < greatest(coalesce(stop_page, 1 << 30), page + 1) GROUP BY ALL"""
SQL["str18_outline_sections"] = """WITH p AS (SELECT source AS book_id, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS page, text FROM documents)
SELECT book_id, CAST((page - 1) // 5 + 1 AS BIGINT) AS chapter, ((page - 1) // 5 + 1) || '.' || ((page - 1) % 5 + 1) AS label, CAST(page AS INT) AS first_page, CAST(len(list_filter(string_split_regex(text, '\\s+'), lambda w: w <> '')) AS BIGINT) AS words FROM p"""
SQL["chk1_paragraphs"] = f"""WITH c AS (SELECT doc_id, unnest(list_filter(list_transform(string_split(text, chr(10)), lambda x: {STRIP.format(c='x')}), lambda x: length(x) > 40)) AS chunk FROM documents)
SELECT doc_id, count(*) AS chunks, CAST(sum(length(chunk)) AS BIGINT) AS chars FROM c GROUP BY doc_id"""
SQL["chk5_deduplicated_chunks"] = f"""WITH {CHUNKS} SELECT course_id, chapter_id, substr(sha256({STRIP.format(c='document')}), 1, 16) AS content_hash, count(*) AS copies,
  course_id || '_' || chapter_id || '_' || substr(sha256({STRIP.format(c='document')}), 1, 16) AS chunk_key FROM chunks WHERE length({STRIP.format(c='document')}) > 40 GROUP BY ALL"""
SQL["snk4_upsert"] = f"WITH d AS ({SQL['chk5_deduplicated_chunks']}) SELECT chunk_key, copies, CASE WHEN copies > 1 THEN 'new' ELSE 'old' END AS version FROM d"
SQL["flt9_verified_chunks"] = f"WITH {CHUNKS} SELECT chunk_id, chapter_id FROM chunks WHERE status = 'verified' AND course_id = 'src1' AND chapter_id = 'ch_2'"
SPLIT = "list_filter(string_split_regex(lower({c}), '\\s+'), lambda w: w <> '')"
SQL["ret1_bm25_top"] = f"""WITH t AS (SELECT doc_id, unnest({SPLIT.format(c='text')}) AS term FROM documents), tf AS (SELECT doc_id, term, count(*) AS tf FROM t GROUP BY ALL), dl AS (SELECT doc_id, sum(tf) AS dl FROM tf GROUP BY doc_id),
df AS (SELECT term, count(*) AS df FROM tf GROUP BY term), k AS (SELECT (SELECT count(*) FROM documents) AS n, (SELECT sum(dl) FROM dl) / (SELECT count(*) FROM documents) AS mean),
qt AS (SELECT item_id AS query_id, unnest({SPLIT.format(c='text')}) AS term FROM benchmark), qs AS (SELECT query_id, term, count(*) AS times FROM qt GROUP BY ALL),
sc AS (SELECT query_id, doc_id, {r('sum(times * ln((n - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE) + 1) * tf * 2.5::DOUBLE / (tf + 1.5::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * dl / mean)))', 6)} AS score
  FROM qs JOIN tf USING (term) JOIN df USING (term) JOIN dl USING (doc_id), k GROUP BY ALL)
SELECT * FROM (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS INT) AS rank FROM sc) WHERE rank <= 5"""
DIST = "list_sum(list_transform(range(1, 65), lambda i: (CAST(a.embedding[i] AS DOUBLE) - CAST(b.embedding[i] AS DOUBLE)) * (CAST(a.embedding[i] AS DOUBLE) - CAST(b.embedding[i] AS DOUBLE))))"
DENSE = f"""WITH d AS (SELECT a.vec_id AS query_id, b.vec_id AS doc_id, {r(DIST, 6)} AS distance FROM embeddings a, embeddings b WHERE a.vec_id % 50 = 0),
dense AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY distance, doc_id) AS INT) AS rank FROM d)"""
SQL["ret3_dense_top"] = f"{DENSE} SELECT * FROM dense WHERE rank <= 8"
SQL["ret3c_dense_all_pairs"] = f"{DENSE.replace(' WHERE a.vec_id % 50 = 0', '')} SELECT * FROM dense WHERE rank <= 3"
DOT = "list_sum(list_transform(range(1, 65), lambda i: CAST({a}.embedding[i] AS DOUBLE) * CAST({b}.embedding[i] AS DOUBLE)))"
SQL["ret3b_dense_same_label"] = f"""WITH d AS (SELECT a.vec_id AS query_id, b.vec_id AS doc_id, {r('1 - ' + DOT.format(a='a', b='b') + ' / sqrt(' + DOT.format(a='a', b='a') + ') / sqrt(' + DOT.format(a='b', b='b') + ')', 6)} + 0 AS distance
  FROM embeddings a JOIN embeddings b ON a.label = b.label WHERE a.vec_id % 50 = 0), e AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY distance, doc_id) AS INT) AS rank FROM d) SELECT * FROM e WHERE rank <= 8"""
SQL["ret5_hybrid"] = f"""{DENSE}, c AS (SELECT query_id, d.doc_id, rank, x.text AS text, y.text AS asked FROM dense d JOIN documents x ON x.doc_id = d.doc_id JOIN documents y ON y.doc_id = d.query_id WHERE rank <= 8),
qt AS (SELECT query_id, term, count(*) AS times FROM (SELECT DISTINCT query_id, asked FROM c), unnest({SPLIT.format(c='asked')}) AS u(term) GROUP BY ALL),
tf AS (SELECT query_id, doc_id, term, count(*) AS tf FROM c, unnest({SPLIT.format(c='text')}) AS u(term) GROUP BY ALL), dl AS (SELECT query_id, doc_id, len({SPLIT.format(c='text')}) AS dl FROM c),
k AS (SELECT query_id, count(*) AS n, avg(dl) AS mean FROM dl GROUP BY query_id), df AS (SELECT query_id, term, count(*) AS df FROM tf GROUP BY ALL),
s AS (SELECT query_id, doc_id, {r('sum(times * ln((n - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE) + 1) * tf * 2.5::DOUBLE / (tf + 1.5::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * dl / mean)))', 9)} AS bm25
  FROM qt JOIN tf USING (query_id, term) JOIN df USING (query_id, term) JOIN dl USING (query_id, doc_id) JOIN k USING (query_id) GROUP BY ALL),
m AS (SELECT c.query_id, c.doc_id, rank AS dense_rank, CAST(row_number() OVER (PARTITION BY c.query_id ORDER BY coalesce(bm25, 0) DESC, rank) AS INT) AS bm25_rank FROM c LEFT JOIN s USING (query_id, doc_id)),
f AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY {r('1 / (60 + dense_rank)::DOUBLE + 1 / (60 + bm25_rank)::DOUBLE', 12)} DESC, dense_rank) AS INT) AS fused_rank FROM m) SELECT * FROM f WHERE fused_rank <= 4"""
SQL["ret6_prompt_contexts"] = f"""{DENSE} SELECT query_id, count(text) AS excerpts, md5(coalesce(string_agg(text, chr(10) || '---' || chr(10) ORDER BY rank), 'No specific textbook excerpt retrieved.')) AS context
  FROM dense LEFT JOIN documents USING (doc_id) WHERE rank <= 3 GROUP BY query_id"""
_BULLETS = lambda items: "\n".join(f"- {x}" for x in items)
_RULES = ", ".join(f"({i}, {q(k)}, {q(f'{label} ({audience})')}, {q(TIER_RULES[k][0])}, {q(TIER_RULES[k][1])}, {q(_BULLETS(TIER_RULES[k][2]))}, {q(_BULLETS(TIER_RULES[k][3]))})" for i, (k, label, audience) in enumerate(TIERS))
SQL["ret6_system_prompts"] = f"""{DENSE}, near AS (SELECT query_id, count(text) AS excerpts, string_agg(text, chr(10) || '---' || chr(10) ORDER BY rank) AS context FROM dense LEFT JOIN documents USING (doc_id) WHERE rank <= 3 AND query_id % 250 > 0 GROUP BY query_id),
asks AS (SELECT vec_id AS query_id FROM embeddings WHERE vec_id % 50 = 0)
SELECT query_id, tier_key, coalesce(excerpts, 0) AS excerpts, md5(concat_ws(chr(10) || chr(10), 'You are the tutor for Physics.' || chr(10) || 'Course: Course ' || (query_id % 3) || chr(10) || 'Chapter: Chapter ' || (query_id % 7) || chr(10) || 'Learners: ' || who,
  '# Excerpts of the course' || chr(10) || coalesce(context, {q(PLACEHOLDER)}), '# Style' || chr(10) || tone || chr(10) || 'Mathematics: ' || most, '# Not allowed' || chr(10) || bans, '# Required' || chr(10) || duties, '# Grounding' || chr(10) || {q(_BULLETS(GROUNDING))},
  CASE WHEN query_id % 100 = 0 THEN '# Question' || chr(10) || 'What is ' || query_id END)) AS prompt
FROM asks JOIN (VALUES {_RULES}) t(i, tier_key, who, tone, most, bans, duties) ON query_id // 50 % 3 = i LEFT JOIN near USING (query_id)"""
TURNS = f"""{DIALOGUES}, k AS (SELECT *, count(*) OVER (PARTITION BY conv_id) AS n, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS i FROM dialogues),
v AS (SELECT conv_id, topic, turn, {STRIP.format(c='text')} AS text, CASE WHEN role = 'Teacher' THEN 'assistant' ELSE 'user' END AS role FROM k WHERE n >= 4 AND i <= 6),
turns AS (SELECT * FROM (SELECT *, lag(role, 1, 'user') OVER (PARTITION BY conv_id ORDER BY turn) AS before FROM v WHERE text <> '') WHERE before <> role)"""
SQL["win2_collapsed_turns"] = f"WITH {TURNS} SELECT conv_id, turn, role FROM turns"
MARK = "'<|start_header_id|>' || {r} || '<|end_header_id|>' || chr(10) || chr(10) || {c} || '<|eot_id|>'"
SQL["trn4_tutor_examples"] = f"""WITH {TURNS}, x AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS e FROM turns), y AS (SELECT * FROM x WHERE NOT (e = 1 AND role = 'user')),
z AS (SELECT conv_id, topic, count(*) AS n, string_agg({MARK.format(r='role', c='text')}, '' ORDER BY turn) AS t FROM y GROUP BY ALL), c AS (SELECT *, row_number() OVER (PARTITION BY topic ORDER BY conv_id) AS i FROM z)
SELECT conv_id, topic, CAST(n + 2 AS INT) AS messages, md5({MARK.format(r="'system'", c="'You are a patient tutor who teaches by questions.' || chr(10) || 'Topic: ' || topic")} || {MARK.format(r="'user'", c="'Can you teach me about ' || topic || '?'")} || t) AS text FROM c WHERE i <= 5"""
SQL["trn5_topic_lessons"] = f"WITH {DIALOGUES} SELECT DISTINCT topic, 3 AS messages FROM dialogues"
COURSES = """courses AS (SELECT doc_id, 'c' || doc_id AS course_id, 'Course ' || CASE WHEN doc_id % 2 = 0 THEN ' ' ELSE '' END || (doc_id // 3) AS title, lang AS subject, source AS academic_tier, doc_id * 7919 % 1000 AS mtime FROM documents)"""
KEYT = "lower(regexp_replace(title, '\\s+', ' ', 'g'))"
SQL["cat2_catalogue"] = f"""WITH {COURSES}, o AS (SELECT *, row_number() OVER (PARTITION BY {KEYT} ORDER BY mtime DESC, course_id) AS rn FROM courses WHERE doc_id % 10 <> 0)
SELECT course_id, title, TRUE AS is_builtin FROM courses WHERE doc_id % 10 = 0 UNION ALL SELECT course_id, title, FALSE FROM o WHERE rn = 1"""
SQL["cat3_superseded"] = f"WITH {COURSES}, o AS (SELECT *, row_number() OVER (PARTITION BY {KEYT} ORDER BY mtime DESC, course_id) AS rn FROM courses) SELECT course_id, mtime FROM o WHERE rn > 1"
SQL["cat5_search"] = f"WITH {COURSES} SELECT course_id, title FROM courses WHERE subject = 'en' AND contains(lower(title), 'rse 1')"
CHAPS = """chaps AS (SELECT source AS course_id, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS chapter_index, doc_id FROM documents), chapters AS (SELECT *, (chapter_index - 1) // 7 + 1 AS unit_index FROM chaps)"""
SQL["agg5_course_rollups"] = f"""WITH {CHAPS} SELECT course_id, count(*) AS chapters, CAST(sum(1 + doc_id % 6) AS BIGINT) AS sections, count(DISTINCT unit_index) AS units, CAST(sum(doc_id % 4) AS BIGINT) AS cards,
  array_to_string(list_sort(list_distinct(list(unit_index))), ',') AS unit_list FROM chapters GROUP BY course_id"""
SQL["agg6_coverage"] = f"""WITH {CHAPS} SELECT course_id, count(*) FILTER (WHERE doc_id % 3 = 0) AS enriched, count(*) AS total, count(*) FILTER (WHERE doc_id % 3 <> 0) AS pending, count(*) FILTER (WHERE doc_id % 3 <> 0) = 0 AS complete FROM chapters GROUP BY course_id"""
SQL["cat4_pending_chapters"] = f"WITH {CHAPS} SELECT course_id, 'c' || doc_id AS chapter_id FROM chapters WHERE doc_id % 3 <> 0"
SQL["cat6_chapters_by_unit"] = f"""WITH {CHAPS}, n AS (SELECT *, CASE WHEN doc_id % 11 = 0 THEN 'Own unit' WHEN unit_index % 2 = 0 THEN 'Declared ' || unit_index ELSE 'Unit ' || unit_index END AS unit FROM chapters)
SELECT course_id, unit, string_agg('c' || doc_id, ',' ORDER BY chapter_index) AS chapters FROM n GROUP BY course_id, unit_index, unit"""
SQL["agg10_document_sizes"] = f"SELECT source, CAST(sum(len({SPLIT.format(c='text')})) AS BIGINT) AS words, CAST(sum(length(text)) AS BIGINT) AS chars FROM documents GROUP BY source"
TOLD = r"(?i)(?:the\s+)?(?:correct|final|expected)\s+answer\s+is\s+"
PUT = "'[find this step on your own]', 'g')"
#: Word boundaries know all letters, so the sign after the answer is matched and put back.
EDGED = PUT.replace("]'", "]\\1'")
REST = TOLD + r"[^\n.]+"
SQL["flt11_safe_hints"] = rf"""WITH b AS (SELECT item_id, text, array_to_string(string_split(text, ' ')[1:2], ' ') AS answer FROM benchmark),
h AS (SELECT *, regexp_escape(answer) AS safe, CASE WHEN regexp_matches(answer, '[\p{{L}}\p{{M}}\p{{N}}_]$') THEN '($|[^\p{{L}}\p{{M}}\p{{N}}_])' ELSE '([\p{{L}}\p{{M}}\p{{N}}_])' END AS edge, 'Look again. The final answer is ''' || answer || '''. So x = ' || answer || ' and ' || text AS h0 FROM b),
h1 AS (SELECT *, CASE WHEN answer <> '' THEN regexp_replace(h0, {q(TOLD)} || '[''"]?' || safe || '[''"]?', {PUT} ELSE h0 END AS h1 FROM h),
h2 AS (SELECT *, CASE WHEN answer <> '' THEN regexp_replace(h1, '(?i)=\s*' || safe || edge, {EDGED} ELSE h1 END AS h2 FROM h1),
h3 AS (SELECT *, CASE WHEN answer <> '' THEN regexp_replace(h2, '(?i)therefore[,]?\s+(?:the\s+answer\s+is\s+)?' || safe || edge, {EDGED} ELSE h2 END AS h3 FROM h2),
h4 AS (SELECT item_id, regexp_replace(h3, {q(REST)}, 'take the steps that are left', 'g') AS hint FROM h3)
SELECT item_id, {STRIP.format(c="hint")} AS hint FROM h4"""


def no_answer(source: str, c: str, out: str) -> str:
    """CTEs that take the expected answer out of column c of a source; the result is column safe_."""
    edge = "CASE WHEN regexp_matches(expected_answer, '[\\p{L}\\p{M}\\p{N}_]$') THEN '($|[^\\p{L}\\p{M}\\p{N}_])' ELSE '([\\p{L}\\p{M}\\p{N}_])' END"
    has = "expected_answer <> ''"
    return rf"""{out}0 AS (SELECT *, regexp_escape(expected_answer) AS lit_, {edge} AS edge_, {c} AS safe0 FROM {source}),
{out}1 AS (SELECT * EXCLUDE (safe0), CASE WHEN {has} THEN regexp_replace(safe0, {q(TOLD)} || '[''"]?' || lit_ || '[''"]?', {PUT} ELSE safe0 END AS safe1 FROM {out}0),
{out}2 AS (SELECT * EXCLUDE (safe1), CASE WHEN {has} THEN regexp_replace(safe1, '(?i)=\s*' || lit_ || edge_, {EDGED} ELSE safe1 END AS safe2 FROM {out}1),
{out}3 AS (SELECT * EXCLUDE (safe2), CASE WHEN {has} THEN regexp_replace(safe2, '(?i)therefore[,]?\s+(?:the\s+answer\s+is\s+)?' || lit_ || edge_, {EDGED} ELSE safe2 END AS safe3 FROM {out}2),
{out} AS (SELECT * EXCLUDE (safe3, lit_, edge_), {STRIP.format(c=f"regexp_replace(safe3, {q(REST)}, 'take the steps that are left', 'g')")} AS safe_ FROM {out}3)"""


_GAP = "regexp_replace(regexp_replace(replace(replace(replace(CASE WHEN expected_answer <> '' THEN regexp_replace(g, '(?i)expected answer\\s+is\\s+[''\"]?' || regexp_escape(expected_answer) || '[''\"]?', 'value asked for is another', 'g') ELSE g END, {0}), {1}), {2}), '(?i)the (?:correct|expected|right) answer (?:is|was)\\s+[^\\n.]+', 'your answer needs another look', 'g'), '(?i)but the expected answer[^\\n.]*', 'but the way or the result has to change', 'g')"
for _i, _form in enumerate(("expected_answer", "lower(expected_answer)", "upper(expected_answer)")):
    _GAP = _GAP.replace("{%d}" % _i, f"CASE WHEN expected_answer <> '' THEN '''' || {_form} || '''' ELSE chr(0) END, 'the value asked for'")
_WITHIN = SQL["grd4_graded_submissions"].replace(SUBMISSIONS, ANSWER_SHEETS)
_WITHIN = _WITHIN[: _WITHIN.rindex("SELECT submission_id, is_correct")]
_FORMULA = ["coalesce(nullif(hint_formula, ''), " + q(x) + ")" for x in NO_FORMULA]
_LEAK = " OR ".join(f"regexp_matches(h, {q(p)})" for p in PROHIBITED)
_PLAIN = "h"
for _p, _put in REWRITES:
    _PLAIN = f"regexp_replace({_PLAIN}, {q(_p)}, {q(_put)}, 'g')"
SQL["grd4_answer_records"] = f"""{_WITHIN}, told AS (SELECT *, CASE WHEN similarity >= 0.4::DOUBLE THEN 'The answer ''' || student_raw_input || ''' is on the way, but parts or steps are missing.'
  ELSE 'The answer ''' || student_raw_input || ''' doesn''t follow from the rule behind the question.' END AS g FROM fz),
gaps AS (SELECT *, CASE WHEN is_correct THEN 'The answer says what was asked for.' ELSE {STRIP.format(c=_GAP)} END AS gap_analysis FROM told),
lined AS (SELECT *, CASE hint_level WHEN 1 THEN '- ' || {q(HINTS[0][0])} || chr(10) || '- ' || {q(HINTS[0][1])} || coalesce(nullif(hint_misconception, ''), {q(NO_MISCONCEPTION)}) || chr(10) || '- ' || {q(HINTS[0][2])}
  WHEN 2 THEN '- ' || {q(HINTS[1][0])} || {_FORMULA[0]} || chr(10) || '- ' || {q(HINTS[1][2])}
  ELSE '- ' || {q(HINTS[2][0])} || gap_analysis || chr(10) || '- ' || {q(HINTS[2][1])} || {_FORMULA[1]} || chr(10) || '- ' || {q(HINTS[2][2])} END AS raw_hint FROM gaps),
{no_answer("lined", "raw_hint", "sf")},
final AS (SELECT *, CASE WHEN is_correct THEN 'Right! Your score is ' || fuzzy_score || ' % (' || performance_tier || ').' ELSE safe_ END AS h FROM sf)
SELECT submission_id, coalesce(nullif(student_id, ''), 'default_student') AS student_id, coalesce(course_id, '') AS course_id, coalesce(nullif(chapter_id, ''), 'ch_1') AS chapter_id, substr(question_text, 1, 40) AS question_id, 'short_answer' AS question_type,
  is_correct, accuracy_pct, fuzzy_score, error_severity, hint_level, CAST(seconds_spent AS DOUBLE) AS latency_seconds, degree_of_failure, gap_analysis, CASE WHEN tier = 'Class 9' AND ({_LEAK}) THEN {_PLAIN} ELSE h END AS assigned_hint FROM final"""
_ENTRY = "concat_ws('|', attempt_id, qId, topic, md5(question), formula, misconception, attempts_count, CAST(round_even(score * 10, 0) AS BIGINT))"
SQL["grd6_exam_profiles"] = f"""{DETAILS}, {BANK}, {TOTALS}, e AS (SELECT submission_id, count(*) AS total_questions, CAST(sum(is_correct) AS BIGINT) AS correct_answers, {r('avg(fuzzy_score)', 6)} AS accuracy,
  CAST(floor({r('avg(latency_seconds)', 6)}) AS INT) AS average_latency, CAST(round_even(avg(attempts_count), 0) AS INT) AS average_attempts, {r('avg(error_severity)', 6)} AS sev FROM details GROUP BY submission_id
  UNION ALL SELECT submission_id, total_questions, correct_answers, correct_answers / total_questions * 100, CAST(total_elapsed_time // total_questions AS INT), 1, CASE WHEN correct_answers / total_questions * 100 >= 80 THEN 0 ELSE 0.6::DOUBLE END FROM totals),
{fuzzy('e', 'accuracy', 'average_latency', 'average_attempts', 'sev', '0')},
paths AS (SELECT *, submission_id > 0 AND submission_id % 3 > 0 AND submission_id % 5 > 0 AS guided, {r('fuzzy_score - greatest(30, 100 - (submission_id % 5) * 12.5::DOUBLE)', 1)} AS delta FROM fz),
named AS (SELECT d.submission_id AS sid, d.* EXCLUDE (submission_id, fuzzy_score), d.fuzzy_score AS score, coalesce(nullif(moduleOrigin, ''), CASE WHEN attempt_id % 2 = 0 THEN 'Own topic' END, 'Core Topic') AS topic, coalesce(nullif(text, ''), 'Exam Problem') AS question, coalesce(formula, '') AS formula, 'mixes up ' || d.qId AS misconception
  FROM details d LEFT JOIN bank b ON d.qId = b.qId),
lists AS (SELECT sid, coalesce(string_agg({_ENTRY}, ';' ORDER BY attempt_id) FILTER (WHERE is_correct = 1), '') AS good, coalesce(string_agg({_ENTRY}, ';' ORDER BY attempt_id) FILTER (WHERE is_correct <> 1), '') AS bad FROM named GROUP BY sid)
SELECT submission_id, total_questions, correct_answers, average_latency, average_attempts, fuzzy_score, performance_tier, CASE WHEN guided THEN 'A' ELSE 'B' END AS pathway, CAST(CASE WHEN guided THEN delta ELSE 0 END AS DOUBLE) AS score_delta_pct,
  CASE WHEN NOT guided THEN 'skipped' WHEN delta > 15 THEN 'significant' WHEN delta > 0 THEN 'moderate' ELSE 'negligible' END AS insight, CAST(CASE performance_tier WHEN 'High Mastery' THEN 4 WHEN 'Moderate Mastery' THEN 3 WHEN 'Developing' THEN 2 ELSE 1 END AS INT) AS study_level,
  coalesce(good, '') AS correct_details, coalesce(bad, '') AS incorrect_details FROM paths LEFT JOIN lists ON sid = submission_id"""


_LEAKS = lambda c: " OR ".join(f"regexp_matches({c}, {q(p)})" for p in PROHIBITED)


def graded(c: str) -> str:
    """SQL: a text as its tier may hold it."""
    out = c
    for p, put in REWRITES:
        out = f"regexp_replace({out}, {q(p)}, {q(put)}, 'g')"
    return f"CASE WHEN tier = 'Class 9' AND ({_LEAKS(c)}) THEN {out} ELSE {c} END"


_SET = lambda c: f"nullif({STRIP.format(c=c)}, '')"
_DEF = lambda c, name: f"coalesce({_SET(c)}, {q(EMPTY_FIELDS[name])})"
_ROW = lambda items, *fields: "coalesce(array_to_string(list_transform(" + items + ", lambda x: concat_ws('|', " + ", ".join(f"x.{f}" for f in fields) + ")), ';'), '')"
SQL["ext8_grounded_merge"] = f"""WITH {THEORY_ROWS}, j AS (SELECT theory.*, model.* EXCLUDE (i) FROM theory LEFT JOIN model USING (i)),
own AS (SELECT *, list_transform(list_filter(coalesce(m_principles, []), lambda p: {_SET('p.title')} IS NOT NULL AND {_SET('p.content')} IS NOT NULL), lambda p: {{'title': {_SET('p.title')}, 'content': {graded(_SET('p.content'))}, 'tag': {_DEF('p.tag', 'tag')}}}) AS ps,
  list_transform(list_filter(defs, lambda p: NOT {holds('lower(p.text)', VIGNETTE)})[1:3], lambda p: {{'title': p.concept, 'content': {graded("CASE WHEN starts_with(lower(p.text), lower(p.concept)) THEN p.text ELSE p.concept || ' is defined as ' || p.text || '.' END")}, 'tag': 'Definition'}}) AS own_ps,
  list_transform(list_filter(coalesce(m_formulations, []), lambda p: {_SET('p.formula')} IS NOT NULL OR {_SET('p.title')} IS NOT NULL), lambda p: {{'title': {graded(_DEF('p.title', 'formula_title'))}, 'formula': {graded(f"coalesce({_SET('p.formula')}, {_SET('p.content')}, '')")}, 'derivation': {graded(_DEF('p.derivation', 'derivation'))}, 'variables': {graded(_DEF('p.variables', 'variables'))}}}) AS fs,
  list_transform(list_filter(eqs, lambda p: length(p.lhs || ' = ' || p.rhs) < 65 AND NOT {holds("lower(p.lhs || ' = ' || p.rhs)", NO_FORMULA_WORDS)})[1:3], lambda p: {{'title': 'Equation for ' || p.lhs, 'formula': p.lhs || ' = ' || p.rhs, 'derivation': 'Stands in the chapter''s text.', 'variables': p.lhs || ' is ' || p.rhs}}) AS own_fs,
  list_concat(list_transform(exs, lambda p: {{'title': p.title, 'content': {graded('p.content')}}}), list_transform(list_filter(coalesce(m_examples, []), lambda p: {_SET('p.title')} IS NOT NULL OR {_SET('p.content')} IS NOT NULL), lambda p: {{'title': {_DEF('p.title', 'example')}, 'content': {graded(f"coalesce({_SET('p.content')}, {_SET('p.solution')}, {_SET('p.explanation')}, '')")}}})) AS es,
  list_transform(list_filter(coalesce(m_models, []), lambda p: {_SET('p.concept')} IS NOT NULL OR {_SET('p.analogy')} IS NOT NULL), lambda p: {{'concept': {_DEF('p.concept', 'concept')}, 'analogy': {graded(f"coalesce({_SET('p.analogy')}, '')")}, 'takeaway': {graded(_DEF('p.takeaway', 'takeaway'))}}}) AS ms,
  list_transform(list_filter(coalesce(m_traps, []), lambda p: {_SET('p.trap')} IS NOT NULL OR {_SET('p.correction')} IS NOT NULL), lambda p: {{'trap': {graded(_DEF('p.trap', 'trap'))}, 'correction': {graded(_DEF('p.correction', 'correction'))}}}) AS ts,
  list_filter(list_transform(coalesce(m_objectives, []), lambda x: {_SET('x')}), lambda x: x IS NOT NULL) AS os FROM j)
SELECT chapter_id, md5({graded(f"coalesce({_SET('m_summary')}, summary)")}) AS summary,
  array_to_string(list_transform(CASE WHEN len(os) > 0 THEN os ELSE ['Say what ' || title || ' means.', 'Use the rules of ' || title || ' in a problem.', 'Recognise ' || title || ' in a case from life.'] END, lambda x: {graded('x')}), ';') AS objectives,
  md5({_ROW("CASE WHEN len(ps) > 0 THEN ps[1:4] ELSE own_ps END", 'title', 'content', 'tag')}) AS principles, {_ROW("CASE WHEN len(fs) > 0 THEN fs[1:3] ELSE own_fs END", 'title', 'formula', 'derivation', 'variables')} AS formulations,
  md5({_ROW("es[1:3]", 'title', 'content')}) AS worked_examples, {_ROW("ms", 'concept', 'analogy', 'takeaway')} AS mental_models, {_ROW("ts", 'trap', 'correction')} AS misconceptions,
  CASE WHEN len(ps) > 0 OR len(fs) > 0 THEN 'blueprint' ELSE 'extracted' END AS theory_source FROM own"""

_CC = """cc AS (SELECT source AS course_id, CAST(row_number() OVER (PARTITION BY source ORDER BY doc_id) AS INT) AS chapter_index, 'c' || doc_id AS chapter_id FROM documents)"""
SQL["flt10_selected_chapters"] = f"""WITH {_CC}, sp AS (SELECT course_id, (['all', '3', '2-4', '1,3,5-8,x', '90000-99999', '4-2,?', NULL])[coalesce(TRY_CAST(regexp_extract(course_id, '[0-9]+') AS INT), 0) % 7 + 1] AS spec FROM (SELECT DISTINCT course_id FROM cc)),
pt AS (SELECT course_id, spec, unnest(string_split(spec, ',')) AS p FROM sp),
rg AS (SELECT course_id, CASE WHEN regexp_full_match(spec, '\\d+') THEN 1 ELSE TRY_CAST(split_part(p, '-', 1) AS INT) END AS a, TRY_CAST(CASE WHEN contains(p, '-') THEN split_part(p, '-', 2) ELSE p END AS INT) AS b FROM pt WHERE regexp_full_match(p, '\\d+(-\\d+)?')),
nm AS (SELECT cc.*, EXISTS (SELECT 1 FROM rg WHERE rg.course_id = cc.course_id AND chapter_index BETWEEN a AND b) AS named FROM cc),
se AS (SELECT course_id, chapter_index FROM nm QUALIFY named OR NOT bool_or(named) OVER (PARTITION BY course_id)),
ru AS (SELECT *, chapter_index - row_number() OVER (PARTITION BY course_id ORDER BY chapter_index) AS run FROM se), mm AS (SELECT course_id, min(chapter_index) AS a, max(chapter_index) AS b, count(*) AS n FROM ru GROUP BY course_id, run)
SELECT course_id, string_agg(CASE WHEN a = b THEN CAST(a AS VARCHAR) ELSE a || '-' || b END, ', ' ORDER BY a) || ' (' || CAST(sum(n) AS BIGINT) || ' of ' || any_value(t) || ')' AS label FROM mm JOIN (SELECT course_id, count(*) AS t FROM cc GROUP BY 1) USING (course_id) GROUP BY course_id"""
SQL["flt8_length_gates"] = f"WITH {CHUNKS} SELECT course_id, " + ", ".join(f"count(*) FILTER (WHERE length(document) >= {n}) AS {k}" for k, n in (("chunk", 41), ("body", 500), ("section", 80), ("intro", 121), ("review", 201), ("training", 120), ("training_book", 250), ("training_append", 200))) + " FROM chunks GROUP BY course_id"
_TITLED_NAME = "array_to_string(list_transform(string_split(p_name, ' '), lambda w: upper(w[1]) || lower(w[2:])), ' ')"
SQL["prj9_prj10_ids"] = f"""SELECT p_partkey, {_TITLED_NAME} AS subject, p_name || '_standard_' || lpad(CAST(p_partkey % 20000 AS VARCHAR), CAST(greatest(4, length(CAST(p_partkey % 20000 AS VARCHAR))) AS INT), '0') AS builtin,
  'sec_' || (p_partkey % 9) || '_' || (p_partkey % 9) || '.' || (p_partkey % 5) AS section, 'ch_' || lower(substr(p_name, 1, 3)) || '_standard_' || substr(md5(p_type), 1, 10) AS card FROM part"""
SQL["jon3_quizzes_with_cards"] = f"""WITH {_CC}, cards AS (SELECT course_id, chapter_index - 1 AS at_, 'topic ' || (chapter_index % 9) AS topic, chapter_id AS card_id FROM cc),
q AS (SELECT course_id, at_, card_id AS placed, CASE WHEN at_ % 4 = 0 THEN 'unknown' ELSE 'topic ' || (at_ % 11) END AS concept FROM cards), f AS (SELECT course_id, topic, arg_min(card_id, at_) AS named FROM cards GROUP BY ALL)
SELECT q.course_id, at_ AS "at", concept, coalesce(named, placed) AS card_id FROM q LEFT JOIN f ON f.course_id = q.course_id AND f.topic = q.concept"""
SQL["jon10_chapter_lookup"] = f"""WITH {_CC}, a AS (SELECT DISTINCT course_id, CASE chapter_index % 3 WHEN 0 THEN chapter_id WHEN 1 THEN CAST(chapter_index AS VARCHAR) ELSE 'none' END AS ref FROM cc)
SELECT a.course_id, ref, 'T ' || coalesce(x.chapter_id, y.chapter_id) AS title FROM a LEFT JOIN cc x ON x.course_id = a.course_id AND x.chapter_id = ref LEFT JOIN cc y ON y.course_id = a.course_id AND CAST(y.chapter_index AS VARCHAR) = ref"""
SQL["jon2_enriched"] = f"""WITH {_CC} SELECT course_id, chapter_index, CASE WHEN chapter_index % 4 = 2 THEN 'Canonical ' || chapter_index ELSE 'T ' || chapter_id END AS title,
  CASE WHEN chapter_index % 2 = 0 AND chapter_index % 6 > 0 THEN 'canonical' ELSE 'own' END AS full_text FROM cc"""
SQL["cat1_bank_courses"] = """SELECT 'subject_' || item_id || '_class_' || (item_id % 3 + 9) AS course_id, 'Subject ' || item_id AS subject, 'Class ' || (item_id % 3 + 9) AS academic_tier, CAST(n AS INT) AS chapter_index,
  CASE n WHEN 1 THEN 'Topic ' || item_id ELSE 'More' END AS title, md5(CASE n WHEN 1 THEN text ELSE 'q' END) AS question, CASE n WHEN 1 THEN 'a' ELSE 'b' END AS answer FROM benchmark, (VALUES (1), (2)) t(n)"""
_CLASS = "CASE " + " ".join(f"WHEN regexp_matches(title, {q(p)}) THEN '{k}'" for k, p in SECTION_CLASSES) + f" ELSE '{THEORY}' END"
_TASK = SECTION_TASK.format(", ".join(k for k, _ in (*SECTION_CLASSES, (THEORY, ""))))
_CHAT = lambda *parts: " || ".join(MARK.format(r=q(role), c=f"({c})") for role, c in zip(("system", "user", "assistant"), parts, strict=True))
_NO_THEORY = "CASE WHEN section_class = '" + THEORY + "' THEN output ELSE '{\"is_theory\":false,\"reason\":\"Section class ' || section_class || '\"}' END"
SQL["trn6_section_prompts"] = f"""WITH x AS (SELECT doc_id AS section_id, (['Waves', 'Appendix B', 'Preface', 'References', 'Answers to odd problems', 'Contents of the sea'])[doc_id % 6 + 1] AS title, text, 'About ' || doc_id AS output FROM documents),
k AS (SELECT *, {_CLASS} AS section_class FROM x)
SELECT section_id, section_class, md5({_CHAT(q(_TASK), "'Title: ' || title || chr(10) || 'Content:' || chr(10) || substr(text, 1, 3500)", _NO_THEORY)}) AS text FROM k"""
_SOME = lambda name, n: f"list_filter(['{name} 1', '{name} 2', '{name} 3'], lambda x: CAST(right(x, 1) AS INT) <= {n})[1:2]"
_JSON = lambda c: f"'[' || array_to_string(list_transform({c}, lambda x: '\"' || x || '\"'), ',') || ']'"
SQL["trn2_assessments"] = f"""SELECT CAST(item_id AS VARCHAR) AS course_id, {_CHAT(q(ASSESSMENT), "'Generate summative assessment questions for course module: ''Course ' || item_id || '''.'", "'{\"quizzes\":' || " + _JSON(_SOME('quiz', 'item_id % 4')) + " || ',\"finalExam\":' || " + _JSON(_SOME('exam', 'item_id % 3')) + " || '}'")} AS text
  FROM benchmark WHERE item_id % 4 > 0 OR item_id % 3 > 0"""
SQL["top5_newest_courses"] = "SELECT 'c' || doc_id AS course_id, doc_id * 7919 % 1000 AS mtime FROM documents"


_PARTS = f"list_transform(string_split(regexp_replace({STRIP.format(c='document')}, '([.!?])\\s+', '\\1' || chr(1), 'g'), chr(1)), lambda x: x)"
_DEFINED, _HEADED = r"(?i)^(.{8,72}?)\s+(?:is|are|refers to|means|describes|defines)\s", r"^([A-Z][A-Za-z0-9\s\-,:()]{4,70})"
_LONG = f"list_filter(list_transform(parts, lambda x: {STRIP.format(c='x')}), lambda x: length(x) > 24)[1:4]"
SQL["ret7_cards"] = f"""WITH {CHUNKS}, c AS (SELECT course_id || '/' || chapter_id AS query_id, chunk_id AS rank, document FROM chunks
  WHERE length(document) BETWEEN 90 AND 1400 AND NOT {holds('lower(document)', PUBLISHER_WORDS)} AND length(regexp_replace(document, '[^\\p{{L}}]', '', 'g')) / length(document) > 0.55::DOUBLE),
p AS (SELECT *, {_PARTS} AS parts FROM c), s AS (SELECT *, parts[1] AS first, {_LONG} AS lines FROM p),
t AS (SELECT query_id, rank, CASE WHEN regexp_matches(first, {q(_DEFINED)}) THEN regexp_replace({STRIP.format(c=f"regexp_extract(first, {q(_DEFINED)}, 1)")}, '^"+|"+$', '', 'g') WHEN regexp_matches(first, {q(_HEADED)}) THEN {STRIP.format(c=f"regexp_extract(first, {q(_HEADED)}, 1)")}
    ELSE {STRIP.format(c='substr(first, 1, 72)')} || CASE WHEN length(first) > 72 THEN '...' ELSE '' END END AS topic,
  CASE WHEN len(lines) = 0 THEN '• ' || substr({STRIP.format(c='document')}, 1, 500) ELSE array_to_string(list_transform(lines, lambda x: '• ' || x || CASE WHEN regexp_matches(x, '[.!?]$') THEN '' ELSE '.' END), chr(10)) END AS answer FROM s),
u AS (SELECT * FROM t QUALIFY row_number() OVER (PARTITION BY query_id, lower(topic) ORDER BY rank, answer) = 1)
SELECT query_id, topic, md5(answer) AS answer FROM u QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY rank, topic) <= 3"""
_TEXT8 = "'Momentum is defined as the product of the mass and the velocity. Here F' || (doc_id % 5) || ' = m * a, and the Speed equals ' || (doc_id % 90) || ' m/s. Example ' || (doc_id % 9) || ' A cart rolls down a slope and stops after a while on level ground.' || chr(10) || text"
SQL["trn8_combined"] = f"""WITH tutors AS ({SQL["trn4_tutor_examples"]}), lessons AS ({SQL["trn5_topic_lessons"]}), ch AS (SELECT length({_TEXT8}) AS n FROM documents)
SELECT CAST(source AS INT) AS source, examples, CAST(messages AS BIGINT) AS messages FROM (SELECT 0 AS source, count(*) AS examples, 3 * count(*) AS messages FROM ch WHERE n >= 120 UNION ALL SELECT 1, count(*), 3 * count(*) FROM ch WHERE n >= 250
  UNION ALL SELECT 2, count(*), sum(messages) FROM tutors UNION ALL SELECT 3, count(*), sum(messages) FROM lessons) WHERE examples > 0"""


_PARAS = f"list_transform(string_split(replace(text, chr(10), chr(10) || chr(10)), chr(10) || chr(10)), lambda x: {STRIP.format(c='x')})"
_GATHER = "list_reduce(list_prepend({{'out': []::VARCHAR[], 'now': '', 'size': 0::BIGINT}}, list_transform({0}, lambda x: {{'out': []::VARCHAR[], 'now': x, 'size': length(x)}})), lambda a, x: CASE WHEN {1} THEN {{'out': list_append(a.out, CASE WHEN a.now = '' THEN x.now ELSE a.now || chr(10) || chr(10) || x.now END), 'now': '', 'size': 0::BIGINT}} ELSE {{'out': a.out, 'now': CASE WHEN a.now = '' THEN x.now ELSE a.now || chr(10) || chr(10) || x.now END, 'size': a.size + x.size}} END)"
SQL["chk3_balanced_chunks"] = f"""WITH p AS (SELECT doc_id, text, list_filter({_PARAS}, lambda x: x <> '') AS ps FROM documents),
q AS (SELECT doc_id, CASE WHEN len(ps) > 1 THEN ps ELSE list_filter(list_transform(string_split(regexp_replace(replace(text, chr(10), chr(10) || chr(10)), '([.!?])\\s+', '\\1' || chr(1), 'g'), chr(1)), lambda x: {STRIP.format(c='x')}), lambda x: x <> '') END AS ps FROM p),
g AS (SELECT doc_id, {_GATHER.format("ps", "a.size + x.size >= 600 AND len(a.out) < 9")} AS g FROM q),
c AS (SELECT doc_id, CASE WHEN g.now <> '' THEN list_append(g.out, g.now) ELSE g.out END AS cs FROM g)
SELECT doc_id, CAST(i - 1 AS INT) AS chunk_index, md5(cs[i]) AS chunk FROM (SELECT doc_id, cs, unnest(range(1, len(cs) + 1)) AS i FROM c)"""
_FIRST = "list_filter(list_transform(string_split(content, chr(10)), lambda x: " + STRIP.format(c="x") + "), lambda x: length(x) > 15 AND NOT regexp_matches(x, '^[#\\*\\d\\.\\-:=\\s]+$'))[1]"
SQL["chk4_titled_sections"] = f"""WITH p AS (SELECT doc_id, coalesce(text, '') AS text, {_PARAS.replace('text', "coalesce(text, '')")} AS ps FROM documents),
q AS (SELECT doc_id, CASE WHEN len(list_filter(ps, lambda x: length(x) > 80)) > 0 THEN list_filter(ps, lambda x: length(x) > 80) WHEN len(list_filter(ps, lambda x: length(x) > 30)) > 0 THEN list_filter(ps, lambda x: length(x) > 30) ELSE [replace(text, chr(10), chr(10) || chr(10))] END AS ps FROM p),
g AS (SELECT doc_id, {_GATHER.format("ps", "a.size + x.size >= 5000")} AS g FROM q),
c AS (SELECT doc_id, CASE WHEN length(g.now) < 200 THEN g.out WHEN len(g.out) > 0 AND length(g.now) < 1000 THEN list_append(g.out[1:len(g.out) - 1], g.out[len(g.out)] || chr(10) || chr(10) || g.now) ELSE list_append(g.out, g.now) END AS cs FROM g),
s AS (SELECT doc_id, i, cs[i] AS content FROM (SELECT doc_id, cs, unnest(range(1, len(cs) + 1)) AS i FROM c)),
t AS (SELECT *, {STRIP.format(c=f"regexp_replace(substr(coalesce({_FIRST}, ''), 1, 80), '^[#\\*\\d\\.\\-:]+\\s*', '')")} AS first FROM s)
SELECT doc_id, CAST(i AS INT) AS section_index, 'Section ' || i || ': ' || CASE WHEN length(first) > 10 THEN first ELSE 'Theory' END AS title, md5(content) AS content FROM t"""


SQL["str2_headers_by_page"] = f"WITH {BOOK_LINES}, {HEADERS.replace('count(*)', 'count(DISTINCT part)')} SELECT * FROM headers"
SQL["str26_weak_chapters"] = f"SELECT book_id, chapter_id, count(*) AS n FROM ({SQL['str22_styled_sections']}) GROUP BY ALL HAVING count(*) <= 1"
SQL["ret4_chapter_else_course"] = f"""WITH {CHUNKS}, c AS (SELECT chunk_id, course_id, CASE WHEN chunk_id % 3 > 0 THEN chapter_id ELSE 'ch_1' END AS chapter FROM chunks WHERE status = 'verified'),
q AS (SELECT item_id AS query_id, 'src' || (item_id % 20) AS course_id, 'ch_' || (item_id % 9) AS chapter FROM benchmark), h AS (SELECT *, chapter IN (SELECT c.chapter FROM c WHERE c.course_id = q.course_id) AS has FROM q)
SELECT query_id, count(*) AS chunks, CAST(sum(chunk_id) AS BIGINT) AS ids FROM h JOIN c ON c.course_id = h.course_id AND (NOT has OR c.chapter = h.chapter) GROUP BY query_id"""
SQL["agg1_new_students"] = f"""WITH known AS ({SQL["agg1_student_summary"]}) SELECT * EXCLUDE (avg_latency) FROM known UNION ALL SELECT 'c' || c_custkey, 0, 0, 0, 'New Student (No History)' FROM customer"""
SQL["snk5_without_course"] = f"WITH {CHUNKS} SELECT course_id, count(*) AS chunks FROM chunks WHERE course_id IS DISTINCT FROM 'src3' GROUP BY course_id"
SQL["str16_styled_ladder"] = f"""SELECT book_id, CASE WHEN book_id LIKE '%1-%' AND book_id IN (SELECT book_id FROM (WITH {PLAN} SELECT book_id FROM chaps)) THEN 'outline'
  WHEN book_id IN (SELECT book_id FROM ({SQL["str20_anchored_chapters"]})) THEN 'contents' WHEN book_id IN (SELECT book_id FROM ({SQL["str20_styled_chapters"]})) THEN 'headings' ELSE 'chunks' END AS rung
FROM (SELECT DISTINCT book_id FROM (WITH {STYLED_LINES} SELECT book_id FROM book_lines))"""
