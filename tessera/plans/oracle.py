"""DuckDB SQL for the queries of ``catalogue``: written from the definitions, not from the Spark code."""

from __future__ import annotations

from ..functions import domain as d
from .bindings import LABELS, LIFECYCLE, MATERIALS
from .catalogue import ANSWER

_M = MATERIALS.format(part="part")
_LABELS = LABELS.format(part="part")
_L = LIFECYCLE.format(orders="orders", lineitem="lineitem")


def _norm(x: str) -> str:
    return f"trim(regexp_replace(upper(replace(strip_accents({x}), 'ß', 'ss')), '[^A-Z0-9]+', ' ', 'g'))"


def _list(words) -> str:
    return "(" + ", ".join(f"'{w}'" for w in words) + ")"


def _array(words) -> str:
    return "[" + ", ".join(f"'{w}'" for w in words) + "]"


def _long_form(t: str) -> str:
    known = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in d.ABBREVIATIONS.items())
    full = f"(CASE {t} {known} ELSE {t} END)"
    return f"(CASE WHEN {full} LIKE 'SEXTAVAD%' THEN 'SEXTAVADO' ELSE {full} END)"


_KEEP = f"c <> '' AND c NOT IN {_list(d.STOP_WORDS)} AND NOT regexp_full_match(c, '[0-9]+')"
_INCHES = "(CASE WHEN c LIKE 'POLEGAD%' THEN 'POLEGADA' ELSE c END)"
_CANON = f"[{_long_form('t')} FOR t IN string_split(full_n, ' ')]"

#: Materials with normalised texts, words, numbers and category.
_F = f"""
m AS ({_M}),
n AS (
  SELECT *, {_norm("description_short")} AS short_n, {_norm("unit")} AS unit_n, {_norm("manufacturer")} AS mf, {_norm("manufacturer_part_number")} AS mpn,
    {_norm("material_group")} AS grp, {_norm("description_short || ' ' || long_description")} AS full_n FROM m),
f AS (
  SELECT *, list_distinct([{_INCHES} FOR c IN {_CANON} IF {_KEEP}]) AS words, list_distinct(regexp_extract_all(full_n, '[0-9]+')) AS nums,
    coalesce([c FOR c IN {_CANON} IF {_KEEP}][1], '') AS cat, string_split(full_n, ' ') AS toks, string_split(short_n, ' ') AS short_toks FROM n)
"""

_MSG = d.MESSAGES
_TECHNICAL = f"""CASE
  WHEN list_contains(toks, 'CABO') AND NOT regexp_matches(full_n, '{d.VOLTAGE}') THEN '{d.MISSING["CABO"]}'
  WHEN list_contains(toks, 'MOTOR') AND NOT (regexp_matches(full_n, '{d.VOLTAGE}') AND regexp_matches(full_n, '{d.FREQUENCY}')) THEN '{d.MISSING["MOTOR"]}'
  WHEN list_contains(toks, 'FILTRO') AND trim(manufacturer_part_number) = '' AND NOT list_has_any(toks, {_array(d.FILTER_WORDS)}) THEN '{d.MISSING["FILTRO"]}'
  WHEN list_contains(toks, 'MANOMETRO') AND NOT list_has_any(toks, {_array(d.GAUGE_WORDS)}) THEN '{d.MISSING["MANOMETRO"]}' END"""

#: Issues of the row rules with their place in rule order.
_RULES = {
    "required": " UNION ALL ".join(
        f"SELECT ord, material_id, {i} AS rule, 'MISSING_CRITICAL_FIELD' AS issue_type, '{c}' AS field_name, '{_MSG['required']}{c}' AS message, 'BLOCKING' AS severity FROM f WHERE trim({c}) = ''"
        for i, c in enumerate(d.REQUIRED)
    ),
    "unit": f"""SELECT ord, material_id, 10 AS rule, 'INVALID_UNIT' AS issue_type, 'unit' AS field_name, '{_MSG["unit"]}' || unit AS message, 'BLOCKING' AS severity FROM f
      WHERE unit_n <> '' AND unit_n NOT IN {_list(d.UNITS)}
      UNION ALL SELECT ord, material_id, 11, 'SUSPICIOUS_UNIT', 'unit', '{_MSG["liquid"]}', 'WARNING' FROM f
      WHERE unit_n IN {_list(d.PIECES)} AND list_has_any(toks, {_array(d.LIQUIDS)})""",
    "status": f"""SELECT ord, material_id, 12 AS rule, 'INVALID_STATUS' AS issue_type, 'status' AS field_name, '{_MSG["status"]}' || status AS message, 'BLOCKING' AS severity FROM f
      WHERE trim(status) <> '' AND upper(trim(status)) NOT IN {_list(d.STATUSES)}""",
    "ambiguity": f"""SELECT ord, material_id, 13 AS rule, 'AMBIGUOUS_DESCRIPTION' AS issue_type, 'description_short' AS field_name, '{_MSG["generic"]}' AS message, 'WARNING' AS severity FROM f
      WHERE trim(long_description) = '' AND trim(manufacturer_part_number) = '' AND list_has_any(short_toks, {_array(d.GENERIC)})""",
    "technical": f"""SELECT ord, material_id, 14 AS rule, 'MISSING_TECHNICAL_ATTRIBUTE' AS issue_type, 'long_description' AS field_name, '{_MSG["technical"]}' || why AS message, 'WARNING' AS severity
      FROM (SELECT ord, material_id, {_TECHNICAL} AS why FROM f) WHERE why IS NOT NULL""",
}

_PART = "i.mpn <> '' AND i.mf <> '' AND i.mpn = e.mpn AND i.mf = e.mf"
_LEXICAL = "i.grp = e.grp AND i.cat = e.cat AND len(list_intersect(i.nums, e.nums)) >= 2 AND len(list_intersect(i.words, e.words)) >= 1"
_BOTH = "SELECT i.ord AS i_ord, i.material_id AS incoming, e.ord AS e_ord, e.material_id AS existing FROM f i JOIN f e ON {on} AND i.material_id <> e.material_id AND {when}"


def _pairs(when: str = "e.ord < i.ord", part: bool = True, lexical: bool = True) -> str:
    parts = [_BOTH.format(on=_PART, when=when)] * part + [_BOTH.format(on=_LEXICAL, when=when)] * lexical
    return " UNION ".join(parts)


_D = f"p AS ({_pairs()}), cands AS (SELECT i_ord AS ord, string_agg(existing, '|' ORDER BY e_ord) AS candidates FROM p GROUP BY i_ord)"
_I = f"""issues AS ({" UNION ALL ".join(_RULES.values())}
  UNION ALL SELECT f.ord, material_id, 20, 'POSSIBLE_DUPLICATE', 'description_short', '{_MSG["duplicate"]}', 'WARNING' FROM f JOIN cands ON f.ord = cands.ord)"""
_COMPLETE = " + ".join(f"CAST(trim({c}) <> '' AS INTEGER)" for c in d.REQUIRED)
_A = f"""per AS (SELECT ord, count(*) AS n, count(*) FILTER (severity = 'BLOCKING') AS b, string_agg(issue_type, '|' ORDER BY rule) AS kinds,
    list_sort(list(DISTINCT issue_type)) AS said FROM issues GROUP BY ord),
a AS (
  SELECT f.ord, f.material_id, ({_COMPLETE}) / CAST(4 AS DOUBLE) AS completeness, coalesce(n, 0) AS n, coalesce(b, 0) AS b,
    CASE WHEN coalesce(b, 0) > 0 THEN 'REJECT' WHEN coalesce(n, 0) > 0 THEN 'REVIEW' ELSE 'APPROVE' END AS decision,
    short_n AS normalized_description, grp AS suggested_group, coalesce(kinds, '') AS issues, coalesce(candidates, '') AS candidates, coalesce(said, ['VALID']) AS said
  FROM f LEFT JOIN per ON f.ord = per.ord LEFT JOIN cands ON f.ord = cands.ord)"""
_ALL = f"WITH {_F}, {_D}, {_I}, {_A}"
_DOUBLE = "CAST({} AS DOUBLE)".format
_CONFIDENCE = f"""CASE decision WHEN 'APPROVE' THEN {_DOUBLE(d.SURE_APPROVE)} WHEN 'REJECT' THEN {_DOUBLE(d.SURE_REJECT)}
  ELSE greatest({_DOUBLE(d.REVIEW_LEAST)}, {_DOUBLE(d.REVIEW_FROM)} - {_DOUBLE(d.REVIEW_STEP)} * n) END"""
_WHY = f"""CASE decision WHEN 'REJECT' THEN printf('{d.RATIONALE["REJECT"]}', b, n - b) WHEN 'REVIEW' THEN printf('{d.RATIONALE["REVIEW"]}', n - b) ELSE '{d.RATIONALE["APPROVE"]}' END"""
_O = f"o AS (SELECT a.*, l.expected_issue, list_contains(said, l.expected_issue) AS hit, said = [l.expected_issue] AS exact FROM a JOIN ({_LABELS}) l ON a.ord = l.ord)"

_ANSWERS = f"ans AS (SELECT material_id, unit, ord, {ANSWER} AS raw FROM ({_M}) m)"
_GOOD = "ord % 16 IN (0, 13, 14, 15)"

#: The faults of the synthetic answers, by the row's number.
_FAULTS = """CASE ord % 16 WHEN 1 THEN 'malformed' WHEN 2 THEN 'not_object' WHEN 3 THEN 'missing:summary' WHEN 4 THEN 'decision' WHEN 5 THEN 'confidence' WHEN 6 THEN 'issues' WHEN 7 THEN 'summary'
  WHEN 8 THEN 'evidence' WHEN 9 THEN 'extra_key' WHEN 10 THEN 'material_id' WHEN 12 THEN 'confidence' ELSE 'ok' END"""
_SAID = f"""said AS (
  SELECT material_id, 1 AS pos, CASE ord % 16 WHEN 13 THEN 'INVALID_UNIT' ELSE 'SUSPICIOUS_UNIT' END AS issue_type, CASE ord % 16 WHEN 13 THEN 'unit ' ELSE 'a ' END || unit AS observation FROM ({_M}) m WHERE {_GOOD}
  UNION ALL SELECT material_id, 2, 'INVALID_STATUS', 'b' FROM ({_M}) m WHERE {_GOOD} AND ord % 16 <> 13)"""

_REVIEWS = f"""l AS ({_L}),
r AS (
  SELECT seq, event_id, 'R-' || CAST(seq AS VARCHAR) AS review_id, material_id, 'S' || CAST(seq % 7 AS VARCHAR) AS specialist_id, event_at, decision, human_decision, seq % 19 AS n,
    (human_decision = 'REQUEST_CORRECTION' AND seq % 19 <> 10) OR seq % 19 IN (11, 3) AS fixed, seq % 19 NOT IN (6, 7, 8, 9) AS reasoned
  FROM l WHERE kind = 'CONCLUDED'),
v AS (
  SELECT *, CASE WHEN n = 2 THEN 'specialist_id must not be empty' WHEN n = 3 THEN 'correction needs field_name and reason' WHEN n = 1 THEN 'material_id must not be empty'
    WHEN n = 4 THEN 'verified_at is later than reviewed_at' WHEN n = 5 THEN 'system_recommendation is unknown'
    WHEN human_decision IN ('REJECT', 'REQUEST_CORRECTION') AND NOT reasoned THEN human_decision || ' requires justification'
    WHEN human_decision = 'REQUEST_CORRECTION' AND NOT fixed THEN 'REQUEST_CORRECTION requires at least one correction'
    WHEN human_decision = 'APPROVE' AND fixed THEN 'APPROVE cannot include corrections' ELSE 'ok' END AS violation FROM r)"""
_AGREES = "(decision = 'APPROVE' AND human_decision = 'APPROVE' OR decision = 'REJECT' AND human_decision = 'REJECT' OR decision = 'REVIEW' AND human_decision = 'REQUEST_CORRECTION')"

#: Admission by windows.
_ADMITTED = f"""l AS ({_L}),
w1 AS (
  SELECT *, min(seq) FILTER (kind = 'OPENED') OVER w AS o_seq, first_value(material_id) OVER k AS o_mat, first_value(decision) OVER k AS o_dec, first_value(event_at) OVER k AS o_at
  FROM l WINDOW w AS (PARTITION BY workflow_id), k AS (PARTITION BY workflow_id ORDER BY kind = 'OPENED' DESC, seq)),
w2 AS (
  SELECT *, kind = 'CONCLUDED' AND seq > o_seq AND material_id = o_mat AND decision = o_dec AND event_at >= o_at AS fits FROM w1),
w3 AS (SELECT *, min(seq) FILTER (fits) OVER (PARTITION BY workflow_id) AS a_seq FROM w2),
w4 AS (SELECT *, min(seq) FILTER (seq = o_seq OR seq = a_seq) OVER (PARTITION BY workflow_id, event_id) AS k_seq FROM w3),
adm AS (
  SELECT *, CASE WHEN k_seq < seq THEN 'dup' WHEN kind = 'OPENED' AND o_seq < seq THEN 'already_opened' WHEN kind = 'OPENED' THEN 'ok'
    WHEN o_seq IS NULL OR o_seq > seq THEN 'not_opened' WHEN a_seq < seq THEN 'already_concluded' WHEN material_id <> o_mat THEN 'material'
    WHEN decision <> o_dec THEN 'recommendation' WHEN event_at < o_at THEN 'temporal' ELSE 'ok' END AS outcome FROM w4),
ok AS (SELECT * FROM adm WHERE outcome = 'ok')"""
_STATE = f"""WITH {_ADMITTED}, s AS (
  SELECT workflow_id, max(material_id) FILTER (kind = 'OPENED') AS material_id, max(decision) FILTER (kind = 'OPENED') AS decision, max(epoch_us(event_at)) FILTER (kind = 'OPENED') AS opened_us,
    max(epoch_us(event_at)) FILTER (kind = 'CONCLUDED') AS end_us, max(human_decision) FILTER (kind = 'CONCLUDED') AS human_decision FROM ok GROUP BY workflow_id)
SELECT workflow_id, material_id, decision, CASE WHEN end_us IS NULL THEN '{d.PENDING}' ELSE '{d.REVIEWED}' END AS status, opened_us, coalesce(end_us, -1) AS closed_us,
  coalesce(end_us - opened_us, -1) AS lead_time_us, human_decision FROM s"""

#: The faults of the synthetic records, by their number: what comes back is checked, not the parser against another.
_BROKEN = f"""l AS ({_L}), x AS (SELECT seq, kind, workflow_id, seq % 23 AS n FROM l),
      y AS (SELECT *, CASE n WHEN 1 THEN 'malformed' WHEN 2 THEN 'schema_version is not 1' WHEN 3 THEN 'workflow_id is missing'
        WHEN 4 THEN CASE kind WHEN 'OPENED' THEN 'opened_at is no time with an offset' ELSE 'review.reviewer_identity.verified_at is no time with an offset' END
        WHEN 5 THEN CASE kind WHEN 'OPENED' THEN 'event_type is unknown' ELSE 'ok' END ELSE 'ok' END AS violation FROM x)"""

_RULE = "WITH {f} SELECT material_id, issue_type, field_name, message, severity FROM ({rule})"

SQL: dict[str, str] = {
    "text_normalize": f"SELECT doc_id, {_norm('text')} AS normalized FROM documents",
    "text_numeric_tokens": f"SELECT doc_id, array_to_string(list_sort(list_distinct(regexp_extract_all({_norm('text')}, '[0-9]+'))), '|') AS numbers FROM documents",
    "text_word_tokens": f"WITH {_F} SELECT material_id, array_to_string(list_sort(words), '|') AS tokens FROM f",
    "text_category": f"WITH {_F} SELECT material_id, cat AS category FROM f",
    "text_material_numbers": f"WITH {_F} SELECT material_id, array_to_string(list_sort(nums), '|') AS numbers FROM f",
    "completeness": f"SELECT material_id, ({_COMPLETE}) / CAST(4 AS DOUBLE) AS completeness FROM ({_M}) m",
    "completeness_custom": f"SELECT material_id, (CAST(trim(long_description) <> '' AS INTEGER) + CAST(trim(manufacturer_part_number) <> '' AS INTEGER)) / CAST(3 AS DOUBLE) AS completeness FROM ({_M}) m",
    **{f"rule_{k}": _RULE.format(f=_F, rule=v) for k, v in _RULES.items()},
    "issues_long": f"WITH {_F}, {_D}, {_I} SELECT material_id, row_number() OVER (PARTITION BY ord ORDER BY rule) AS pos, issue_type, field_name, message, severity FROM issues",
    "dup_part_branch": f"WITH {_F} SELECT incoming, existing FROM ({_pairs(lexical=False)})",
    "dup_lexical_branch": f"WITH {_F} SELECT incoming, existing FROM ({_pairs(part=False)})",
    "dup_candidates": f"WITH {_F}, {_D} SELECT material_id, candidates FROM f JOIN cands ON f.ord = cands.ord",
    "dup_against_catalog": f"WITH {_F} SELECT incoming, existing FROM ({_pairs(when='i.ord % 5 = 0 AND e.ord % 5 <> 0')})",
    "assess": f"{_ALL} SELECT material_id, completeness, {_CONFIDENCE} AS confidence, decision, normalized_description, suggested_group, issues, candidates FROM a",
    "evidence_long": f"""WITH {_F}, {_D}, {_I} SELECT material_id, row_number() OVER (PARTITION BY ord ORDER BY rule) AS pos,
      CASE issue_type WHEN 'POSSIBLE_DUPLICATE' THEN 'DUPLICATE' ELSE 'RULE' END AS source, issue_type, message AS observation, severity FROM issues""",
    "recommend": f"{_ALL} SELECT material_id, decision, {_WHY} AS rationale FROM a",
    "recommend_long": f"{_ALL} SELECT material_id, decision, {_WHY} AS rationale FROM a",
    "decision_counts": f"{_ALL} SELECT decision, count(*) AS n FROM a GROUP BY decision",
    "eval_report": f"""{_ALL}, {_O}, s AS (
      SELECT count(*) AS total, count(*) FILTER (exact) AS correct, count(*) FILTER (hit) AS label_hits,
        count(*) FILTER (expected_issue = 'POSSIBLE_DUPLICATE' AND list_contains(said, 'POSSIBLE_DUPLICATE')) AS duplicate_true_positives,
        count(*) FILTER (expected_issue <> 'POSSIBLE_DUPLICATE' AND list_contains(said, 'POSSIBLE_DUPLICATE')) AS duplicate_false_positives,
        count(*) FILTER (expected_issue = 'POSSIBLE_DUPLICATE' AND NOT list_contains(said, 'POSSIBLE_DUPLICATE')) AS duplicate_false_negatives,
        count(*) FILTER (expected_issue = 'VALID' AND decision = 'REVIEW') AS unnecessary_reviews FROM o)
      SELECT *, coalesce(correct / CAST(nullif(total, 0) AS DOUBLE), 0) AS exact_match_accuracy, coalesce(label_hits / CAST(nullif(total, 0) AS DOUBLE), 0) AS label_hit_rate,
        coalesce(duplicate_true_positives / CAST(nullif(duplicate_true_positives + duplicate_false_positives, 0) AS DOUBLE), 0) AS duplicate_precision,
        coalesce(duplicate_true_positives / CAST(nullif(duplicate_true_positives + duplicate_false_negatives, 0) AS DOUBLE), 0) AS duplicate_recall,
        duplicate_false_negatives * {d.COST_MISSED_DUPLICATE} + unnecessary_reviews * {d.COST_NEEDLESS_REVIEW} AS weighted_error_cost FROM s""",
    "eval_errors": f"""{_ALL}, {_O} SELECT material_id, material_id || ': esperado=' || expected_issue || ', previsto=[''' || array_to_string(said, ''', ''') || ''']' AS line FROM o WHERE NOT exact""",
    "llm_prompt": "SELECT material_id, concat_ws(chr(10), "
    + ", ".join([f"'{x}'" for x in d.PROMPT] + [f"'{c}: ' || {c}" for c in d.FIELDS])
    + f") AS prompt FROM ({_M}) m",
    "llm_contract": f"""SELECT material_id, {_FAULTS} AS violation, CASE WHEN ord % 16 = 11 THEN CAST(0.9 AS DOUBLE) WHEN ord % 16 = 13 THEN CAST(0.25 AS DOUBLE) WHEN {_GOOD} THEN CAST(0.75 AS DOUBLE) END AS confidence
      FROM ({_M}) m""",
    "llm_identity_guard": f"SELECT material_id, material_id AS expected, 'OTHER-' || material_id AS received FROM ({_M}) m WHERE ord % 16 = 11",
    "llm_evidence": f"WITH {_SAID} SELECT material_id, CAST(pos AS BIGINT) AS pos, 'LLM' AS source, issue_type, observation, 'WARNING' AS severity FROM said",
    "llm_recommend": f"WITH {_SAID} SELECT material_id, 'REVIEW' AS decision, printf('{d.RATIONALE['REVIEW']}', count(*)) AS rationale FROM said GROUP BY material_id",
    "review_validate": f"WITH {_REVIEWS} SELECT seq, violation FROM v",
    "review_agreement": f"WITH l AS ({_L}) SELECT decision, human_decision, {_AGREES} AS agrees, count(*) AS n FROM l WHERE kind = 'CONCLUDED' GROUP BY ALL",
    "audit_events": f"""WITH {_REVIEWS} SELECT event_id, '{d.AUDIT_EVENT}' AS event_type, material_id, specialist_id AS actor_id, review_id, epoch_us(event_at) AS occurred_us, {_AGREES} AS agrees_with_system,
      CAST(fixed AS BIGINT) AS correction_count, human_decision, decision AS system_recommendation FROM v WHERE violation = 'ok'""",
    "audit_by_material": f"WITH {_REVIEWS} SELECT event_id, review_id FROM v WHERE violation = 'ok' AND material_id = 'MAT-7'",
    "audit_by_event": f"WITH {_REVIEWS} SELECT event_id, review_id, specialist_id AS actor_id FROM v WHERE violation = 'ok' ORDER BY encode(event_id), seq LIMIT 1",
    "log_read_audit": f"""WITH {_REVIEWS}, e AS (SELECT event_id, min(seq) AS seq, arg_min(review_id, seq) AS review_id, epoch_us(arg_min(event_at, seq)) AS occurred_us FROM v WHERE violation = 'ok' GROUP BY event_id)
      SELECT row_number() OVER (ORDER BY seq) AS line_no, event_id, review_id, occurred_us FROM e""",
    "log_read_lifecycle": f"WITH {_ADMITTED} SELECT row_number() OVER (ORDER BY seq) AS line_no, event_id, kind, workflow_id FROM ok",
    "log_opened_by_event": f"WITH {_ADMITTED} SELECT seq, event_id, workflow_id FROM ok WHERE kind = 'OPENED' AND event_id IN ('EO-100', 'EC-10-1')",
    "log_opened_by_workflow": f"WITH {_ADMITTED} SELECT seq, event_id, kind FROM ok WHERE kind = 'OPENED' AND workflow_id = 'WF-100'",
    "log_opened_by_material": f"WITH {_ADMITTED} SELECT seq, event_id, kind FROM ok WHERE kind = 'OPENED' AND material_id = 'MAT-7'",
    "log_all_events": f"WITH {_ADMITTED} SELECT seq, event_id, kind, workflow_id, material_id FROM ok",
    "scan_materials": f"SELECT m.ord, {', '.join('m.' + c for c in d.FIELDS)}, expected_issue FROM ({_M}) m JOIN ({_LABELS}) l ON m.ord = l.ord",
    "report_lines": f"""{_ALL} SELECT material_id, printf('%-11s | %-7s | %10.2f | %9.2f | %s', material_id, decision, completeness, {_CONFIDENCE}, CASE issues WHEN '' THEN 'VALID' ELSE replace(issues, '|', ',') END) AS line FROM a""",
    "evidence_invariants": f"""SELECT material_id, CASE ord % 13 WHEN 1 THEN 'evidências de outro material' WHEN 2 THEN 'source inválido' WHEN 3 THEN 'issue_type inválido' WHEN 4 THEN 'observation não pode ser vazia'
      WHEN 5 THEN 'severity inválida' WHEN 7 THEN 'observation não pode ser vazia' WHEN 8 THEN 'source inválido' WHEN 9 THEN 'issue_type inválido' WHEN 10 THEN 'severity inválida' WHEN 11 THEN '{d.EMPTY_ID}'
      WHEN 12 THEN 'severity inválida' ELSE 'ok' END AS violation FROM ({_M}) m""",
    "recommendation_invariants": f"""SELECT material_id, CASE WHEN ord % 9 IN (1, 5) THEN '{d.EMPTY_ID}' WHEN ord % 9 = 2 THEN 'decision inválida' WHEN ord % 9 IN (3, 6) THEN 'rationale vazio'
      WHEN ord % 9 IN (4, 7) THEN 'falta a decisão humana' ELSE 'ok' END AS violation FROM ({_M}) m""",
    "audit_roundtrip": f"WITH {_REVIEWS} SELECT review_id, 'ok' AS violation, true AS same FROM v WHERE violation = 'ok'",
    "review_event_consistency": f"WITH {_REVIEWS} SELECT review_id, event_id, 'actor_id' AS violation FROM v WHERE violation = 'ok' AND review_id LIKE '%7'",
    "log_admission": f"WITH {_ADMITTED} SELECT seq, outcome FROM adm",
    "log_store_append": f"WITH {_ADMITTED} SELECT seq, outcome FROM adm",
    "log_admission_stream": f"WITH {_ADMITTED} SELECT seq, outcome FROM adm",
    "log_store_lookups": f"""WITH {_ADMITTED}, x AS (
      SELECT 'by_event' AS lookup, * FROM ok WHERE event_id = 'EO-100' UNION ALL SELECT 'by_workflow', * FROM ok WHERE workflow_id = 'WF-100' UNION ALL SELECT 'by_material', * FROM ok WHERE material_id = 'MAT-7'
      UNION ALL SELECT 'opened_by_event', * FROM ok WHERE kind = 'OPENED' AND event_id = 'EO-100' UNION ALL SELECT 'opened_by_workflow', * FROM ok WHERE kind = 'OPENED' AND workflow_id = 'WF-100'
      UNION ALL SELECT 'opened_by_material', * FROM ok WHERE kind = 'OPENED' AND material_id = 'MAT-7' UNION ALL SELECT 'opened', * FROM ok WHERE kind = 'OPENED' UNION ALL SELECT 'listed', * FROM ok)
      SELECT turn, lookup, event_id, kind, workflow_id, material_id FROM x, (VALUES ('batches'), ('compacted')) t(turn)""",
    "log_by_material": f"WITH {_ADMITTED} SELECT seq, event_id, kind FROM ok WHERE material_id = 'MAT-7'",
    "log_by_workflow": f"WITH {_ADMITTED} SELECT seq, event_id, kind FROM ok WHERE workflow_id = 'WF-100'",
    "log_by_event": f"WITH {_ADMITTED} SELECT seq, event_id, workflow_id FROM ok WHERE event_id = 'EO-100' ORDER BY seq LIMIT 1",
    "log_opened_all": f"WITH {_ADMITTED} SELECT seq, event_id, workflow_id, material_id FROM ok WHERE kind = 'OPENED'",
    "workflow_state": _STATE,
    "workflow_state_stream": _STATE,
    "workflow_state_table": _STATE,
    "specialist_measures": f"""WITH l AS ({_L}),
      a AS (SELECT 'MAT-' || CAST(o_custkey AS VARCHAR) AS material_id, o_orderdate AS assessed_at, max({{'d': CASE o_orderstatus WHEN 'O' THEN 'REVIEW' WHEN 'F' THEN 'REJECT' ELSE 'APPROVE' END, 'g': o_orderpriority}}) AS said FROM orders GROUP BY ALL),
      j AS (SELECT said.d AS decision, said.g AS "group", human_decision, {_AGREES.replace("decision = ", "said.d = ").replace("human_said.d", "human_decision")} AS alike FROM (SELECT * FROM l WHERE kind = 'CONCLUDED') r ASOF JOIN a ON r.material_id = a.material_id AND r.event_at >= a.assessed_at)
      SELECT CASE grouping_id("group", decision) WHEN 0 THEN 'group and decision' WHEN 1 THEN 'group' WHEN 2 THEN 'decision' ELSE 'all' END AS "of", "group", decision, count(*) AS reviewed,
        count(*) FILTER (alike) AS agreed, coalesce(count(*) FILTER (alike) / CAST(nullif(count(*), 0) AS DOUBLE), 0) AS accuracy,
        count(*) FILTER (decision = 'REVIEW') AS to_review, coalesce(count(*) FILTER (decision = 'REVIEW') / CAST(nullif(count(*), 0) AS DOUBLE), 0) AS review_rate,
        count(*) FILTER (decision = 'APPROVE' AND human_decision <> 'APPROVE') AS false_accepts,
        coalesce(count(*) FILTER (decision = 'APPROVE' AND human_decision <> 'APPROVE') / CAST(nullif(count(*) FILTER (decision = 'APPROVE'), 0) AS DOUBLE), 0) AS false_accept_rate,
        count(*) FILTER (decision = 'REJECT' AND human_decision = 'APPROVE') AS false_rejects,
        coalesce(count(*) FILTER (decision = 'REJECT' AND human_decision = 'APPROVE') / CAST(nullif(count(*) FILTER (decision = 'REJECT'), 0) AS DOUBLE), 0) AS false_reject_rate
      FROM j GROUP BY GROUPING SETS (("group", decision), ("group"), (decision), ())""",
    "workflow_pending": f"WITH {_ADMITTED} SELECT workflow_id, material_id, decision, '{d.PENDING}' AS status, epoch_us(event_at) AS opened_us FROM ok WHERE kind = 'OPENED'",
    "workflow_conclude": f"""WITH l AS ({_L}), o AS (SELECT * FROM l WHERE kind = 'OPENED'),
      e AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY workflow_id ORDER BY seq) AS n FROM l WHERE kind = 'CONCLUDED') WHERE n = 1),
      x AS (SELECT o.workflow_id, e.seq AS e_seq, epoch_us(e.event_at) - epoch_us(o.event_at) AS lead, CASE WHEN e.seq IS NULL THEN 'ok' WHEN o.material_id <> e.material_id THEN 'material mismatch'
        WHEN o.decision <> e.decision THEN 'recommendation mismatch' WHEN e.event_at < o.event_at THEN 'reviewed before opened' ELSE 'ok' END AS violation FROM o LEFT JOIN e ON o.workflow_id = e.workflow_id)
      SELECT workflow_id, CASE WHEN violation = 'ok' AND e_seq IS NOT NULL THEN '{d.REVIEWED}' ELSE '{d.PENDING}' END AS status, violation,
        CASE WHEN violation = 'ok' AND e_seq IS NOT NULL THEN lead ELSE -1 END AS lead_time_us FROM x""",
    "history_violations": f"""WITH l AS ({_L}), g AS (
      SELECT workflow_id, arg_min(kind, seq) AS first_kind, count(*) FILTER (kind = 'OPENED') AS o, count(*) FILTER (kind = 'CONCLUDED') AS c,
        arg_min(material_id, seq) AS m1, arg_max(material_id, seq) AS m2, arg_min(decision, seq) AS d1, arg_max(decision, seq) AS d2, arg_min(event_at, seq) AS t1, arg_max(event_at, seq) AS t2
      FROM l GROUP BY workflow_id)
      SELECT * FROM (SELECT workflow_id, CASE WHEN first_kind <> 'OPENED' THEN 'first event is not an opening' WHEN o <> 1 THEN printf('expected one opening, got %d', o)
        WHEN c > 1 THEN printf('expected at most one conclusion, got %d', c) WHEN m1 <> m2 THEN 'material mismatch' WHEN d1 <> d2 THEN 'recommendation mismatch' WHEN t2 < t1 THEN 'reviewed before opened' END AS violation FROM g)
      WHERE violation IS NOT NULL""",
    "log_read_failclosed": f"WITH {_BROKEN}, z AS (SELECT *, row_number() OVER (ORDER BY seq) AS line_no FROM y) SELECT line_no, violation FROM z WHERE violation <> 'ok' ORDER BY line_no LIMIT 1",
    "lifecycle_roundtrip": f"""WITH {_BROKEN}
      SELECT seq, violation, CASE WHEN violation = 'ok' THEN kind END AS kind, CASE WHEN violation = 'ok' THEN workflow_id END AS workflow_id FROM y""",
}
