"""SQL that states each registered query independently, over the same tables.

Written for DuckDB. Money is compared in whole cents and percents in whole
tenths, so that no statement depends on floating point rounding.
"""

from __future__ import annotations

from ..functions import model_json, texts
from ..functions.lexicon import INTENTS, SIGNALS
from ..operators.decide import ADJUSTMENTS, BASE, CRITERIA, DESCRIPTIONS, ESCALATION_VALUE, MENU
from ..sources.schemas import DOMAINS
from .catalogue import PHRASES, PROSE, STATUS_OF

STEMS = ("premium", "deductible", "building", "contents", "flood_cov", "flood_ded")
LIMITS = {
    "premium": (15, 5), "deductible": (50, 20), "building": (20, 10),
    "contents": (20, 10), "flood_cov": (20, 10), "flood_ded": (50, 20),
}


def lit(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def stamp(column: str) -> str:
    return f"strftime({column}, '%Y-%m-%d %H:%M:%S.%f')"


def cents(column: str) -> str:
    return f"CAST({column} * 100 AS BIGINT)"


def tenths(old: str, new: str) -> str:
    """|percent change| in tenths, halves up; NULL on a zero or missing side."""
    a, b = cents(old), cents(new)
    return (
        f"CASE WHEN {old} IS NULL OR {new} IS NULL OR {old} = 0 THEN NULL "
        f"ELSE CAST((abs({b} - {a})::HUGEINT * 2000 + {a}) // (2 * {a}) AS BIGINT) END"
    )


def percent(old: str, new: str) -> str:
    return f"(CASE WHEN {new} < {old} THEN -1 ELSE 1 END) * ({tenths(old, new)}) / 10.0"


def tenths_text(value: str) -> str:
    return f"CAST(({value}) // 10 AS BIGINT)::VARCHAR || '.' || CAST(({value}) % 10 AS BIGINT)::VARCHAR"


def whole(amount: str) -> str:
    """Rounded to whole units with separators, from cents."""
    return f"format('{{:,}}', CAST((abs({cents(amount)}) + 50) // 100 AS BIGINT))"


def severity(old: str, new: str, stem: str) -> str:
    major, moderate = LIMITS[stem]
    a, b = cents(old), cents(new)
    guard = ""
    if stem.startswith("flood"):
        guard = f"WHEN coalesce({old}, 0) = 0 AND coalesce({new}, 0) = 0 THEN 'UNCHANGED' "
    return (
        f"CASE {guard}WHEN {old} <> 0 AND abs({b} - {a})::HUGEINT * 100 > {a}::HUGEINT * {major} THEN 'MAJOR' "
        f"WHEN {old} <> 0 AND abs({b} - {a})::HUGEINT * 100 > {a}::HUGEINT * {moderate} THEN 'MODERATE' "
        f"WHEN {new} <> {old} THEN 'MINOR' ELSE 'UNCHANGED' END"
    )


def worst(columns: list[str], floor: str) -> str:
    levels = ["MAJOR", "MODERATE", "MINOR", "UNCHANGED"]
    picked = levels[: levels.index(floor)]
    whens = " ".join(f"WHEN '{level}' IN ({', '.join(columns)}) THEN '{level}'" for level in picked)
    return f"CASE {whens} ELSE '{floor}' END"


def rank(column: str) -> str:
    return f"CASE {column} WHEN 'HIGH' THEN 3 WHEN 'MEDIUM' THEN 2 ELSE 1 END"


def direction(old: str, new: str) -> str:
    return f"CASE WHEN {old} = {new} THEN 'UNCHANGED' WHEN {rank(new)} > {rank(old)} THEN 'UP' ELSE 'DOWN' END"


def band(value: str, medium: int, high: int) -> str:
    return f"CASE WHEN {value} >= {high} THEN 'HIGH' WHEN {value} >= {medium} THEN 'MEDIUM' ELSE 'LOW' END"


def pick(index: str, *values: str) -> str:
    return f"([{', '.join(map(lit, values))}])[{index} + 1]"


K = "CAST(json_extract(props, '$.k') AS INTEGER)"
# Ratings and reason of an event read as a risk assessment.
EVENT_RISK = f"""
    event_id AS risk_assessment_id, user_id AS property_id, CAST(ts AS DATE) AS assessment_date,
    {band('value', 25, 75)} AS flood_risk, {band(K, 34, 67)} AS fire_risk,
    CASE event_type WHEN 'error' THEN 'HIGH' WHEN 'purchase' THEN 'MEDIUM' WHEN 'click' THEN 'MEDIUM'
         ELSE 'LOW' END AS earthquake_risk,
    CAST(value AS DECIMAL(12,2)) AS overall_risk_score, event_type || ' ' || props AS risk_reason"""

MEASURES = {
    "premium": "annual_premium", "deductible": "deductible", "building": "building_coverage",
    "contents": "contents_coverage", "flood_cov": "flood_coverage", "flood_ded": "flood_deductible",
}
SIDES = {"cur": "CURRENT", "ren": "RENEWAL"}
PAIR_COLUMNS = {
    "assessment_id": "risk_assessment_id", "assessment_date": "assessment_date", "flood_risk": "flood_risk",
    "fire_risk": "fire_risk", "earthquake_risk": "earthquake_risk", "risk_score": "overall_risk_score",
    "risk_reason": "risk_reason",
}


def _pivot_sql() -> str:
    columns = {**MEASURES, "exclusions": "exclusions", "effective": "effective_date", "expiry": "expiry_date"}
    picked = [
        f"max(CASE WHEN policy_version = '{name}' THEN {column} END) AS {side}_{stem}"
        for side, name in SIDES.items()
        for stem, column in columns.items()
    ]
    return (
        f"SELECT customer_id, policy_id, {', '.join(picked)} FROM policy_version_t "
        "GROUP BY 1, 2 HAVING count(DISTINCT policy_version) = 2"
    )


def _comparison_sql() -> str:
    columns = ["p.customer_id", "c.name", "p.policy_id"]
    for s in STEMS:
        old, new = f"cur_{s}", f"ren_{s}"
        columns += [
            old, new, f"{new} - {old} AS {s}_change", f"{percent(old, new)} AS {s}_change_pct",
            f"{severity(old, new, s)} AS {s}_severity",
        ]
    columns += [
        "cur_exclusions", "ren_exclusions",
        "coalesce(cur_exclusions <> ren_exclusions, FALSE) AS exclusions_changed",
        "cur_effective", "cur_expiry", "ren_effective", "ren_expiry",
    ]
    graded = ", ".join(columns)
    overall = worst([f"{s}_severity" for s in STEMS], "UNCHANGED")
    return (
        f"SELECT *, {overall} AS overall_severity FROM "
        f"(SELECT {graded} FROM pivot_t p JOIN customer_t c ON c.customer_id = p.customer_id)"
    )


def _change_sql() -> str:
    sides = ", ".join(
        f"{alias}.{column} AS {prefix}_{suffix}"
        for alias, prefix in (("b", "prev"), ("a", "curr"))
        for suffix, column in PAIR_COLUMNS.items()
    )
    return f"""
    SELECT c.customer_id, c.name, p.property_id, p.location, p.property_type, {sides},
           {direction('b.flood_risk', 'a.flood_risk')} AS flood_direction,
           {direction('b.fire_risk', 'a.fire_risk')} AS fire_direction,
           {direction('b.earthquake_risk', 'a.earthquake_risk')} AS earthquake_direction,
           a.overall_risk_score - b.overall_risk_score AS risk_score_change,
           {percent('b.overall_risk_score', 'a.overall_risk_score')} AS risk_score_change_pct,
           CASE WHEN a.overall_risk_score > b.overall_risk_score THEN 'INCREASED'
                WHEN a.overall_risk_score < b.overall_risk_score THEN 'DECREASED' ELSE 'UNCHANGED' END
             AS overall_direction
    FROM ranked_risk_t a JOIN ranked_risk_t b ON a.property_id = b.property_id AND a.rn = 1 AND b.rn = 2
    JOIN property_t p ON p.property_id = a.property_id JOIN customer_t c ON c.customer_id = p.customer_id"""


def finding_sql(stem: str) -> str:
    extra = f" || ' ($' || {whole(f'{stem}_change')} || '/year)'" if stem == "premium" else ""
    return (
        f"CASE WHEN {stem}_change <> 0 THEN {lit(texts.FINDING_SUBJECTS[stem] + ' ')} || "
        f"CASE WHEN {stem}_change > 0 THEN 'increased' ELSE 'decreased' END || ' by ' || "
        f"{tenths_text(tenths(f'cur_{stem}', f'ren_{stem}'))} || '%'{extra} END"
    )


FINDINGS = [finding_sql(s) for s in STEMS] + [
    f"CASE WHEN exclusions_changed THEN {lit(texts.EXCLUSIONS_CHANGED)} END"
]
FINDING_LIST = f"list_filter([{', '.join(FINDINGS)}], lambda x: x IS NOT NULL)"


def _score_text(column: str) -> str:
    return f"CAST({column} AS VARCHAR)"


CAUSES = [
    f"CASE WHEN {d}_direction <> 'UNCHANGED' THEN '{d.capitalize()} risk changed from ' || prev_{d}_risk "
    f"|| ' to ' || curr_{d}_risk END"
    for d in ("flood", "fire", "earthquake")
] + [
    f"'Overall risk score changed from ' || {_score_text('prev_risk_score')} || ' to ' || "
    f"{_score_text('curr_risk_score')} || ' (' || CASE WHEN risk_score_change > 0 THEN '+' "
    f"WHEN risk_score_change_pct < 0 THEN '-' ELSE '' END || "
    f"{tenths_text(tenths('prev_risk_score', 'curr_risk_score'))} || '%)'"
]
CAUSE_LIST = f"list_filter([{', '.join(CAUSES)}], lambda x: x IS NOT NULL)"
POINTS = [
    lit(text) if d is None else f"CASE WHEN {d}_direction = 'UP' THEN {lit(text)} END"
    for d, text in texts.COMMUNICATION_POINTS
]
POINT_LIST = f"list_filter([{', '.join(POINTS)}], lambda x: x IS NOT NULL)"


def _lexicon_values() -> str:
    return ", ".join(f"({lit(w)}, {lit(k)}, {lit(e)}, {v}::DOUBLE)" for w, k, e, v in PROSE.entries())


def _hits_sql(source: str) -> str:
    intents = ", ".join(
        f"count(*) FILTER (kind = 'intent' AND entry = '{i}') AS intent_{i}" for i in PROSE.intent
    )
    signals = ", ".join(
        f"count(*) FILTER (kind = 'signal' AND entry = '{s}' AND by_customer) AS signal_{s}" for s in SIGNALS
    )
    return f"""
    SELECT t.interaction_id, sum(weight) FILTER (kind = 'sentiment') AS tone_sum,
           count(*) FILTER (kind = 'sentiment') AS tone_hits, {intents}, {signals}
    FROM (SELECT DISTINCT interaction_id FROM {source}) t
    LEFT JOIN (SELECT interaction_id, speaker = 'Customer' AS by_customer,
                      unnest(regexp_extract_all(lower(text), @words)) AS word FROM {source}) w
           ON w.interaction_id = t.interaction_id
    LEFT JOIN lexicon_t l ON l.word = w.word
    GROUP BY 1"""


def _level(column: str, levels: tuple[tuple[str, int], ...], none: str) -> str:
    return "CASE " + " ".join(f"WHEN {column} >= {n} THEN '{name}'" for name, n in levels) + f" ELSE '{none}' END"


def _scores_sql(hits: str) -> str:
    best = "greatest(" + ", ".join(f"intent_{i}" for i in PROSE.intent) + ")"
    intent = (
        f"CASE WHEN {best} = 0 THEN '{INTENTS[-1]}' "
        + " ".join(f"WHEN intent_{i} = {best} THEN '{i}'" for i in INTENTS if i in PROSE.intent)
        + " END"
    )
    concern = ", ".join(
        f"signal_{name} >= {n} AS {name}_{'signal' if name == 'complaint' else 'concern'}"
        for name, n in PROSE.concern_hits.items()
    )
    return f"""
    SELECT interaction_id, sign(s) * floor(abs(s) * 10000 + 0.5) / 10000 AS sentiment,
           CASE WHEN s > 0.3 THEN 'Positive' WHEN s > 0 THEN 'Neutral' WHEN s > -0.3 THEN 'Mildly Concerned'
                WHEN s > -0.6 THEN 'Concerned' ELSE 'Very Negative' END AS sentiment_label,
           intent, urgency, churn_signal, pricing_concern, coverage_concern, complaint_signal,
           CASE WHEN churn_signal = 'high' THEN 'retention-focused' WHEN urgency IN ('critical', 'high') THEN 'urgent'
                WHEN complaint_signal THEN 'empathetic' WHEN pricing_concern OR coverage_concern THEN 'reassuring'
                ELSE 'informational' END AS recommended_tone,
           CASE WHEN complaint_signal AND s < -0.3 THEN 'angry' WHEN complaint_signal THEN 'frustrated'
                WHEN urgency IN ('critical', 'high') THEN 'anxious'
                WHEN pricing_concern OR coverage_concern THEN 'concerned'
                WHEN s > 0.3 THEN 'satisfied' ELSE 'calm' END AS customer_emotion,
           CASE WHEN churn_signal = 'high' THEN 'HIGH' WHEN churn_signal = 'moderate' OR s < -0.3 THEN 'ELEVATED'
                WHEN churn_signal = 'low' OR s < 0 THEN 'LOW' ELSE 'MINIMAL' END AS retention_risk
    FROM (SELECT interaction_id, {intent} AS intent, {concern},
                 {_level('signal_urgency', PROSE.urgency_levels, 'low')} AS urgency,
                 {_level('signal_churn', PROSE.churn_levels, 'none')} AS churn_signal,
                 coalesce(greatest(-1.0, least(1.0, tone_sum / nullif(tone_hits, 0))), 0.0)::DOUBLE AS s
          FROM {hits})"""


# Stands for @words in statements: runs of letters and digits of any script.
WORDS = r"'[\p{L}\p{N}]+'"
SENTENCE = "'[^.!?\\n]+[.!?]*'"


def _sentences_sql(source: str) -> str:
    return f"""
    SELECT interaction_id, turn_no, speaker, i - 1 AS sentence_no, parts[i] AS sentence
    FROM (SELECT *, unnest(generate_series(1, len(parts))) AS i
          FROM (SELECT interaction_id, turn_no, speaker,
                       list_filter(list_transform(regexp_extract_all(text, {SENTENCE}), lambda x: trim(x)),
                                   lambda x: x <> '') AS parts
                FROM {source}))"""


def _summary_sql(sentences: str) -> str:
    return f"""
    SELECT interaction_id, string_agg(sentence, ' ' ORDER BY turn_no, sentence_no) AS summary
    FROM (SELECT s.*, row_number() OVER (PARTITION BY interaction_id
                 ORDER BY score DESC, turn_no, sentence_no) AS rn
          FROM {sentences} s
          JOIN (SELECT interaction_id, turn_no, sentence_no,
                       CAST(sum(n * frequency) AS DOUBLE) / CAST(sum(n) AS DOUBLE) AS score
                FROM (SELECT *, sum(n) OVER (PARTITION BY interaction_id, word) AS frequency
                      FROM (SELECT interaction_id, turn_no, sentence_no, word, count(*) AS n
                            FROM (SELECT interaction_id, turn_no, sentence_no,
                                         unnest(regexp_extract_all(lower(sentence), @words)) AS word
                                  FROM {sentences}) GROUP BY ALL))
                GROUP BY ALL) USING (interaction_id, turn_no, sentence_no))
    WHERE rn <= 3 GROUP BY 1"""


SIGNAL_WORDS = ", ".join(lit(w) for w in sorted({w for ws in PROSE.signal.values() for w in ws}))


def _phrases_sql(sentences: str) -> str:
    return f"""
    SELECT interaction_id, row_number() OVER (PARTITION BY interaction_id
               ORDER BY hits DESC, turn_no, sentence_no) AS rank, sentence AS phrase, hits
    FROM (SELECT *, CAST(len(list_filter(regexp_extract_all(lower(sentence), @words),
                     lambda w: w IN ({SIGNAL_WORDS}))) AS BIGINT) AS hits
          FROM {sentences} WHERE speaker = 'Customer')
    WHERE hits > 0 QUALIFY rank <= 5"""


FACTS = {
    "likely_to_leave": "churn_risk_label = 'HIGH' OR coalesce(retention_risk = 'HIGH', FALSE)",
    "major_change": "coalesce(overall_severity = 'MAJOR', FALSE)",
    "small_change": "coalesce(overall_severity IN ('MINOR', 'UNCHANGED'), FALSE)",
    "risk_up": "coalesce('UP' IN (flood_direction, fire_direction, earthquake_direction), FALSE)",
    "open_claim": "open_claims > 0",
    "many_claims_or_lapsed": "total_claims >= 3 OR coalesce(policy_status = 'LAPSED', FALSE)",
    "incomplete": "property_type IS NULL OR location IS NULL OR building_age IS NULL OR construction_type IS NULL "
    "OR current_flood_risk IS NULL OR current_fire_risk IS NULL OR current_earthquake_risk IS NULL "
    "OR current_risk_score IS NULL",
}
SUPPORTED = {
    "A": "TRUE",
    "B": "overall_severity IS NOT NULL OR coalesce(policy_status = 'LAPSED', FALSE)",
    "C": "overall_severity IS NOT NULL",
    "D": "coalesce('HIGH' IN (current_flood_risk, current_fire_risk, current_earthquake_risk), FALSE)",
    "E": f"churn_risk_label = 'HIGH' AND coalesce(customer_value >= {ESCALATION_VALUE}, FALSE)",
    "F": "open_claims > 0 OR total_claims >= 2 OR coalesce(policy_status = 'LAPSED', FALSE) "
    "OR coalesce(coverage_concern, FALSE)",
    "G": FACTS["incomplete"],
}


def _candidates_sql() -> str:
    rows = []
    for code, title in MENU.items():
        points = []
        for i, criterion in enumerate(CRITERIA):
            added = [
                f"CASE WHEN {FACTS[fact]} THEN {n} ELSE 0 END"
                for fact, action, on, n in ADJUSTMENTS
                if (action, on) == (code, criterion)
            ]
            points.append(f"greatest(1, least(10, {' + '.join([str(BASE[code][i]), *added])})) AS {criterion}")
        rows.append(
            f"SELECT customer_id, interaction_id, '{code}' AS code, {lit(title)} AS title, "
            f"({SUPPORTED[code]}) AS eligible, {', '.join(points)} FROM context_t"
        )
    total = " + ".join(CRITERIA)
    return f"SELECT *, {total} AS composite FROM ({' UNION ALL '.join(rows)})"


def _ranked_sql() -> str:
    return (
        "SELECT *, row_number() OVER (PARTITION BY customer_id ORDER BY composite DESC, code) AS place "
        "FROM candidates_t WHERE eligible"
    )


ID_BUCKET = (
    "substring(md5(concat_ws('|', CAST(customer_id AS VARCHAR), CAST(interaction_id AS VARCHAR), action_taken)), 1, 3)"
)
STATUS_SQL = pick(f"customer_id % {len(STATUS_OF)}", *STATUS_OF)
PREFIX_SQL = (
    "CASE status WHEN 'PENDING' THEN 'Pending review: ' "
    "ELSE substring(status, 1, 1) || lower(substring(status, 2)) || ': ' END"
)

# Named parts in dependency order; a query pulls in the parts it mentions.
PARTS: dict[str, str] = {
    "customer_t": """
    SELECT c_custkey AS customer_id, c_name AS name, c_custkey % 60 + 20 AS age,
           CAST((c_custkey % 120) / 10.0 AS DECIMAL(4,1)) AS tenure_years,
           CAST(c_acctbal AS DECIMAL(12,2)) AS customer_value,
           (['EXCELLENT', 'GOOD', 'FAIR', 'POOR'])[c_custkey % 4 + 1] AS payment_history,
           CAST((c_custkey * 37 % 101) / 100.0 AS DECIMAL(3,2)) AS churn_risk_score FROM customer""",
    "property_t": """
    SELECT c_custkey AS property_id, c_custkey AS customer_id, c_mktsegment AS property_type,
           n_name AS location, c_custkey % 60 AS building_age,
           (['WOOD_FRAME', 'BRICK', 'CONCRETE', 'MIXED'])[c_custkey % 4 + 1] AS construction_type
    FROM customer LEFT JOIN nation ON n_nationkey = c_nationkey""",
    "order_measures_t": """
    SELECT l_orderkey, sum(CAST(floor(l_extendedprice * l_tax * 100 + 0.5) AS BIGINT)) AS deductible,
           sum(CAST(floor(l_extendedprice * 100 + 0.5) AS BIGINT)) AS building,
           sum(CAST(floor(l_quantity * 100 + 0.5) AS BIGINT)) AS contents,
           sum(CASE WHEN l_returnflag = 'R' THEN CAST(floor(l_extendedprice * 100 + 0.5) AS BIGINT) ELSE 0 END)
             AS flood_cov,
           sum(CASE WHEN l_returnflag = 'R' THEN CAST(floor(l_quantity * 100 + 0.5) AS BIGINT) ELSE 0 END) AS flood_ded,
           array_to_string(list_sort(list(DISTINCT l_returnflag || l_linestatus)), ', ') AS exclusions
    FROM lineitem GROUP BY 1""",
    "policy_version_t": """
    SELECT o_custkey AS policy_id, o_custkey AS customer_id,
           CASE rn WHEN 1 THEN 'RENEWAL' ELSE 'CURRENT' END AS policy_version,
           o_orderpriority AS policy_type,
           CASE WHEN rn = 1 THEN 'PROPOSED' WHEN o_orderstatus = 'F' THEN 'LAPSED' ELSE 'ACTIVE' END AS policy_status,
           CAST(o_orderdate AS DATE) AS effective_date, CAST(o_orderdate AS DATE) + 364 AS expiry_date,
           CAST(o_totalprice AS DECIMAL(18,2)) AS annual_premium,
           CAST(deductible / 100.0 AS DECIMAL(18,2)) AS deductible,
           CAST(building / 100.0 AS DECIMAL(18,2)) AS building_coverage,
           CAST(contents / 100.0 AS DECIMAL(18,2)) AS contents_coverage,
           CAST(flood_cov / 100.0 AS DECIMAL(18,2)) AS flood_coverage,
           CAST(flood_ded / 100.0 AS DECIMAL(18,2)) AS flood_deductible, exclusions,
           CAST(o_orderdate AS DATE) + 364 AS renewal_date
    FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS rn
          FROM orders QUALIFY rn <= 2)
    LEFT JOIN order_measures_t ON l_orderkey = o_orderkey""",
    "risk_t": f"SELECT {EVENT_RISK} FROM events",
    "ranked_risk_t": """
    SELECT *, row_number() OVER (PARTITION BY property_id
               ORDER BY assessment_date DESC, risk_assessment_id DESC) AS rn FROM risk_t""",
    "claim_t": """
    SELECT l_orderkey * 10 + l_linenumber AS claim_id, o_custkey AS customer_id, o_custkey AS policy_id,
           (['FLOOD', 'FIRE', 'THEFT', 'LIABILITY', 'OTHER'])[l_partkey % 5 + 1] AS claim_type,
           CASE o_orderstatus WHEN 'O' THEN 'OPEN' WHEN 'F' THEN 'CLOSED' ELSE 'DENIED' END AS claim_status,
           CAST(l_extendedprice AS DECIMAL(12,2)) AS claim_amount, CAST(l_shipdate AS DATE) AS claim_date
    FROM lineitem JOIN orders ON o_orderkey = l_orderkey WHERE l_returnflag = 'R'""",
    "claims_t": """
    SELECT customer_id, count(*) AS total_claims, count(*) FILTER (claim_status = 'OPEN') AS open_claims,
           sum(claim_amount) AS total_claim_amount, max(claim_date) AS last_claim_date FROM claim_t GROUP BY 1""",
    "interaction_t": """
    SELECT event_id AS interaction_id, user_id AS customer_id,
           CASE event_type WHEN 'error' THEN 'CALL' WHEN 'purchase' THEN 'EMAIL' WHEN 'signup' THEN 'CHAT'
                ELSE 'NOTE' END AS interaction_type,
           ts AS interaction_timestamp, props AS raw_transcript,
           CASE WHEN event_type = 'error' THEN 'event ' || event_id END AS agent_note FROM events""",
    "last_said_t": """
    SELECT * FROM interaction_t
    QUALIFY row_number() OVER (PARTITION BY customer_id ORDER BY interaction_timestamp DESC, interaction_id DESC) = 1""",
    "c360_t": """
    SELECT c.*, CASE WHEN churn_risk_score >= 0.7 THEN 'HIGH' WHEN churn_risk_score >= 0.4 THEN 'MODERATE'
                     WHEN churn_risk_score >= 0.2 THEN 'LOW' ELSE 'MINIMAL' END AS churn_risk_label,
           p.property_id, p.property_type, p.location, p.building_age, p.construction_type,
           cur.policy_id, cur.policy_status, cur.effective_date, cur.expiry_date, cur.annual_premium, cur.deductible,
           cur.building_coverage, cur.contents_coverage, cur.flood_coverage, cur.flood_deductible, cur.exclusions,
           cur.renewal_date,
           EXISTS (SELECT 1 FROM policy_version_t o WHERE o.customer_id = c.customer_id AND o.policy_version = 'RENEWAL') AS has_renewal_proposal,
           coalesce(total_claims, 0) AS total_claims, coalesce(open_claims, 0) AS open_claims,
           coalesce(total_claim_amount, 0) AS total_claim_amount, last_claim_date,
           r.flood_risk AS current_flood_risk, r.fire_risk AS current_fire_risk,
           r.earthquake_risk AS current_earthquake_risk, r.overall_risk_score AS current_risk_score,
           r.risk_reason AS current_risk_reason, r.assessment_date AS risk_assessment_date,
           s.interaction_id AS last_interaction_id, s.interaction_type AS last_interaction_type,
           s.interaction_timestamp AS last_interaction_timestamp, s.raw_transcript AS last_interaction_transcript,
           s.agent_note AS last_interaction_note
    FROM customer_t c
    LEFT JOIN property_t p ON p.customer_id = c.customer_id
    LEFT JOIN policy_version_t cur ON cur.customer_id = c.customer_id AND cur.policy_version = 'CURRENT'
    LEFT JOIN claims_t k ON k.customer_id = c.customer_id
    LEFT JOIN ranked_risk_t r ON r.property_id = p.property_id AND r.rn = 1
    LEFT JOIN last_said_t s ON s.customer_id = c.customer_id""",
    "pivot_t": _pivot_sql(),
    "comparison_t": _comparison_sql(),
    "change_t": _change_sql(),
    "requested_t": "SELECT p_partkey AS customer_id FROM part",
    "turn_t": """
    SELECT conv_id AS interaction_id, turn AS turn_no,
           CASE role WHEN 'user' THEN 'Customer' ELSE 'Agent' END AS speaker, text FROM conversations""",
    "doc_turn_t": "SELECT doc_id AS interaction_id, 0 AS turn_no, 'Customer' AS speaker, text FROM documents",
    "lexicon_t": f"SELECT * FROM (VALUES {_lexicon_values()}) v(word, kind, entry, weight)",
    "turn_hits_t": _hits_sql("turn_t"),
    "turn_scores_t": _scores_sql("turn_hits_t"),
    "doc_hits_t": _hits_sql("doc_turn_t"),
    "doc_scores_t": _scores_sql("doc_hits_t"),
    "turn_sentences_t": _sentences_sql("turn_t"),
    "doc_sentences_t": _sentences_sql("doc_turn_t"),
    "turn_phrases_t": _phrases_sql("turn_sentences_t"),
    "turn_summary_t": _summary_sql("turn_sentences_t"),
    "context_t": """
    SELECT c.*, t.conv_id AS interaction_id, v.overall_severity, v.cur_premium, v.ren_premium, v.premium_change,
           v.cur_flood_cov, v.ren_flood_cov, v.flood_cov_change, v.cur_flood_ded, v.ren_flood_ded, v.flood_ded_change,
           v.cur_exclusions, v.ren_exclusions, r.flood_direction, r.fire_direction, r.earthquake_direction,
           r.prev_flood_risk, r.curr_flood_risk, r.prev_fire_risk, r.curr_fire_risk, r.prev_earthquake_risk,
           r.curr_earthquake_risk, r.curr_risk_reason, s.retention_risk, s.coverage_concern, s.sentiment_label, s.intent
    FROM c360_t c LEFT JOIN (SELECT DISTINCT conv_id FROM conversations) t ON t.conv_id = c.customer_id
    LEFT JOIN comparison_t v ON v.customer_id = c.customer_id
    LEFT JOIN change_t r ON r.customer_id = c.customer_id
    LEFT JOIN turn_scores_t s ON s.interaction_id = t.conv_id""",
    "candidates_t": _candidates_sql(),
    "ranked_t": _ranked_sql(),
    "log_t": f"""
    SELECT 'ACT-' || strftime(ts, '%Y%m%d-%H%M%S') || '-' || event_id AS action_id, user_id AS customer_id,
           event_id AS interaction_id, substring('ABCDEFG', {K} % 7 + 1, 1) AS code,
           '{{"recommended_action":{{"code":"' || code || '"}}}}' AS recommended_action, event_type AS action_taken,
           ts AS action_timestamp,
           CASE event_type WHEN 'purchase' THEN 'EXECUTED' WHEN 'error' THEN 'ESCALATED' WHEN 'signup' THEN 'DECLINED'
                ELSE 'PENDING' END AS status FROM events""",
    "asked_t": f"""
    SELECT q.customer_id, t.conv_id AS interaction_id, code,
           {STATUS_SQL.replace('customer_id', 'q.customer_id')} AS status, title
    FROM requested_t q LEFT JOIN ranked_t r ON r.customer_id = q.customer_id AND place = 1
    LEFT JOIN (SELECT DISTINCT conv_id FROM conversations) t ON t.conv_id = r.customer_id""",
    "logged_t": f"""
    SELECT *, 'ACT-' || second || '-' || CASE WHEN n < 1000 THEN lpad(CAST(n AS VARCHAR), 3, '0')
                                             ELSE CAST(n AS VARCHAR) END AS action_id
    FROM (SELECT *, strftime(made_at, '%Y%m%d-%H%M%S') AS second,
                 row_number() OVER (PARTITION BY made_at ORDER BY bucket, customer_id, interaction_id) AS n
          FROM (SELECT *, {ID_BUCKET} AS bucket,
                       TIMESTAMP '2024-03-01 00:00:00' + to_seconds(customer_id % 3) AS made_at
                FROM (SELECT a.*, {PREFIX_SQL} || title AS action_taken FROM asked_t a
                      JOIN customer ON c_custkey = a.customer_id)))""",
}


def _with(body: str, changed: dict[str, str] | None = None) -> str:
    """Prefix a statement with the parts it needs, transitively; ``changed`` replaces some."""
    needed: set[str] = set()
    all_parts = PARTS | (changed or {})

    def visit(text: str) -> None:
        for name, sql in all_parts.items():
            if name not in needed and name in text:
                needed.add(name)
                visit(sql)

    visit(body)
    parts = [f"{name} AS ({all_parts[name]})" for name in all_parts if name in needed]
    return (f"WITH {', '.join(parts)} " if parts else "") + body


def _flat(source: str, columns: str) -> str:
    """Columns by kind: plain, d:number, t:text of a date, s:timestamp."""
    out = []
    for item in columns.split():
        kind, _, name = item.rpartition(":")
        out.append(
            {
                "": name,
                "d": f"CAST({name} AS DOUBLE) AS {name}",
                "t": f"CAST({name} AS VARCHAR) AS {name}",
                "s": f"{stamp(name)} AS {name}",
                "b": f"CAST({name} AS BIGINT) AS {name}",
            }[kind]
        )
    return f"SELECT {', '.join(out)} FROM {source}"


PIVOT_COLUMNS = " ".join(
    [f"{side}_{x}" if x == "exclusions" else f"{k}:{side}_{x}" for side in SIDES
     for x, k in [*[(s, "d") for s in STEMS], ("exclusions", ""), ("effective", "t"), ("expiry", "t")]]
)
COMPARISON_COLUMNS = (
    "customer_id name policy_id "
    + " ".join(f"d:cur_{s} d:ren_{s} d:{s}_change d:{s}_change_pct {s}_severity" for s in STEMS)
    + " cur_exclusions ren_exclusions exclusions_changed t:cur_effective t:cur_expiry t:ren_effective t:ren_expiry"
    " overall_severity"
)
CHANGE_COLUMNS = (
    "customer_id name property_id location property_type "
    + " ".join(
        f"{p}_assessment_id t:{p}_assessment_date {p}_flood_risk {p}_fire_risk {p}_earthquake_risk d:{p}_risk_score "
        f"{p}_risk_reason"
        for p in ("prev", "curr")
    )
    + " flood_direction fire_direction earthquake_direction d:risk_score_change d:risk_score_change_pct"
    " overall_direction"
)
ITEMS = "list_filter(string_split(lower(coalesce({0}_exclusions, '')), ', '), lambda x: x <> '')"


def _report_sql() -> str:
    labels = {
        "premium": "Annual Premium", "deductible": "General Deductible", "building": "Building Coverage",
        "contents": "Contents Coverage", "flood_cov": "Flood Coverage", "flood_ded": "Flood Deductible",
    }
    rows = []
    for i, (s, label) in enumerate(labels.items()):
        sign = f"CASE WHEN {s}_change > 0 THEN '+' ELSE '' END"
        minus = f"CASE WHEN {s}_change < 0 THEN '-' ELSE '' END"
        pct = tenths(f"cur_{s}", f"ren_{s}")
        pct_sign = f"CASE WHEN {s}_change > 0 THEN '+' WHEN ({pct}) > 0 THEN '-' ELSE '' END"
        money_sign = f"CASE WHEN {whole(f'{s}_change')} = '0' THEN '' ELSE {minus} END"
        rows.append(
            f"SELECT customer_id, policy_id, {i} AS position, '{label}' AS field, "
            f"'$' || {whole(f'coalesce(cur_{s}, 0)')} AS current, '$' || {whole(f'coalesce(ren_{s}, 0)')} AS renewal, "
            f"CASE WHEN {s}_change = 0 THEN '—' ELSE {sign} || '$' || {money_sign} || {whole(f'{s}_change')} END AS change, "
            f"CASE WHEN {s}_change = 0 THEN '—' ELSE {pct_sign} || {tenths_text(pct)} || '%' END AS percent, "
            f"{s}_severity AS severity FROM comparison_t"
        )
    return " UNION ALL ".join(rows)


BLOCKS = {
    "premium": "premium", "deductible": "deductible", "building_coverage": "building",
    "contents_coverage": "contents", "flood_coverage": "flood_cov", "flood_deductible": "flood_ded",
}


def joined(items: str, separator: str = "chr(10)") -> str:
    return f"array_to_string({items}, {separator})"


def _item_changes() -> dict[str, str]:
    cur, ren = ITEMS.format("cur"), ITEMS.format("ren")
    return {
        "added": f"list_filter({ren}, lambda x: NOT list_contains({cur}, x))",
        "removed": f"list_filter({cur}, lambda x: NOT list_contains({ren}, x))",
    }


def _policy_docs_sql() -> str:
    columns = ", ".join(
        f"CAST(cur_{s} AS DOUBLE) AS {b}_current, CAST(ren_{s} AS DOUBLE) AS {b}_renewal, "
        f"CAST({s}_change AS DOUBLE) AS {b}_change, CAST({s}_change_pct AS DOUBLE) AS {b}_change_pct, "
        f"{s}_severity AS {b}_severity"
        for b, s in BLOCKS.items()
    )
    listed = ", ".join(
        f"CASE WHEN overall_severity IS NOT NULL THEN {joined(f'list_sort(list_distinct({items}))', lit('|'))} END AS exclusions_{name}"
        for name, items in _item_changes().items()
    )
    return f"""
    SELECT q.customer_id, CASE WHEN c.customer_id IS NULL THEN 'not_found' WHEN overall_severity IS NULL
               THEN 'no_renewal' ELSE 'ok' END AS status, c.name AS customer_name,
           CASE WHEN c.customer_id IS NULL THEN {lit(texts.CUSTOMER_NOT_FOUND)} WHEN overall_severity IS NULL
               THEN {lit(texts.NO_RENEWAL)} END AS message, policy_id,
           {columns}, cur_exclusions AS exclusions_current, ren_exclusions AS exclusions_renewal, exclusions_changed, {listed},
           CAST(cur_effective AS VARCHAR) AS current_effective, CAST(cur_expiry AS VARCHAR) AS current_expiry,
           CAST(ren_effective AS VARCHAR) AS renewal_effective, CAST(ren_expiry AS VARCHAR) AS renewal_expiry, overall_severity,
           CASE WHEN overall_severity IS NOT NULL THEN {joined(FINDING_LIST)} END AS findings
    FROM requested_t q LEFT JOIN customer_t c ON c.customer_id = q.customer_id
    LEFT JOIN (SELECT * EXCLUDE (customer_id, name), customer_id AS id FROM comparison_t) v ON v.id = q.customer_id"""


def _risk_docs_sql() -> str:
    impact = worst(["premium_severity", "flood_cov_severity", "flood_ded_severity"], "MINOR")
    changed = "overall_direction IS NOT NULL"
    kinds = {"assessment_id": "assessment_id", "assessment_date": "assessment_date", "flood_risk": "flood_risk", "fire_risk": "fire_risk",
             "earthquake_risk": "earthquake_risk", "overall_risk_score": "risk_score", "risk_reason": "risk_reason"}

    def typed(column: str) -> str:
        if column.endswith("date"):
            return f"CAST({column} AS VARCHAR)"
        return f"CAST({column} AS DOUBLE)" if column.endswith("score") else column

    sides = ", ".join(
        f"{typed(f'{short}_{column}')} AS {side}_{name}"
        for side, short in (("previous", "prev"), ("current", "curr"))
        for name, column in kinds.items()
    )
    only = ", ".join(f"{typed(f'one.{name}')} AS only_{name}" for name in list(kinds)[1:])
    moves = ", ".join(
        f"prev_{d}_risk AS {d}_previous, curr_{d}_risk AS {d}_current, {d}_direction" for d in ("flood", "fire", "earthquake")
    )
    effects = ", ".join(
        f"CASE WHEN {changed} THEN {value} END AS impact_{name}"
        for name, value in {
            "policy_id": "v.policy_id", "premium_change_pct": "CAST(premium_change_pct AS DOUBLE)",
            "premium_change": "CAST(premium_change AS DOUBLE)", "flood_coverage_change_pct": "CAST(flood_cov_change_pct AS DOUBLE)",
            "flood_coverage_change": "CAST(flood_cov_change AS DOUBLE)",
            "flood_deductible_change_pct": "CAST(flood_ded_change_pct AS DOUBLE)",
            "flood_deductible_change": "CAST(flood_ded_change AS DOUBLE)", "exclusions_changed": "exclusions_changed",
            "overall_severity": f"CASE WHEN overall_severity IS NOT NULL THEN {impact} END",
            "message": f"CASE WHEN overall_severity IS NULL THEN {lit(texts.NO_POLICY_IMPACT)} END",
        }.items()
    )
    return f"""
    SELECT q.customer_id, CASE WHEN c.customer_id IS NULL THEN 'not_found' WHEN {changed} THEN 'ok'
               WHEN one.property_id IS NOT NULL THEN 'no_risk_change' ELSE 'no_risk_data' END AS status,
           CASE WHEN c.customer_id IS NULL THEN {lit(texts.CUSTOMER_NOT_FOUND)} WHEN {changed}
               THEN NULL WHEN one.property_id IS NOT NULL THEN {lit(texts.NO_RISK_CHANGE)}
               ELSE {lit(texts.NO_RISK_DATA)} END AS message,
           r.property_id, r.location, r.property_type, {sides}, {only}, {moves},
           CAST(prev_risk_score AS DOUBLE) AS score_previous, CAST(curr_risk_score AS DOUBLE) AS score_current,
           CAST(risk_score_change AS DOUBLE) AS score_change, CAST(risk_score_change_pct AS DOUBLE) AS score_change_pct,
           overall_direction AS score_direction, curr_risk_reason AS root_cause, {effects},
           CASE WHEN {changed} THEN {joined(CAUSE_LIST)} END AS causes,
           CASE WHEN {changed} THEN {joined(POINT_LIST)} END AS points
    FROM requested_t q LEFT JOIN customer_t c ON c.customer_id = q.customer_id
    LEFT JOIN (SELECT * EXCLUDE (customer_id, name), customer_id AS id FROM change_t) r ON r.id = q.customer_id
    LEFT JOIN (SELECT * EXCLUDE (customer_id, name), customer_id AS pid FROM comparison_t
               QUALIFY row_number() OVER (PARTITION BY customer_id ORDER BY policy_id) = 1) v ON v.pid = q.customer_id
    LEFT JOIN (SELECT k.*, h.customer_id AS owner FROM ranked_risk_t k JOIN property_t h ON h.property_id = k.property_id
               WHERE k.property_id IN (SELECT property_id FROM risk_t GROUP BY 1 HAVING count(*) = 1)
                 AND h.customer_id NOT IN (SELECT customer_id FROM change_t)) one ON one.owner = q.customer_id"""


def _listed(source: str, array: str, name: str, condition: str = "TRUE") -> str:
    return (
        f"SELECT customer_id, i - 1 AS position, items[i] AS {name} FROM (SELECT customer_id, items, "
        f"unnest(generate_series(1, len(items))) AS i FROM (SELECT customer_id, {array} AS items FROM {source} "
        f"WHERE customer_id IN (SELECT customer_id FROM requested_t) AND {condition}))"
    )


def _signals_sql() -> str:
    """Model text by event: what parses is read field by field, what does not falls back whole."""
    defaults = {name: value for name, _, value in model_json.SIGNAL_FIELDS}

    def read(name: str) -> str:
        kind = dict((n, k) for n, k, _ in model_json.SIGNAL_FIELDS)[name]
        value = f"json_extract_string(doc, '$.{name}')"
        default = defaults[name]
        if kind == "boolean":
            value, default = f"CAST({value} AS BOOLEAN)", str(default).upper()
        else:
            default = lit(default)
        return f"CASE WHEN bad THEN {default} ELSE {value} END AS {name}"

    fields = ", ".join(read(n) for n, k, _ in model_json.SIGNAL_FIELDS if "array" not in k)
    return f"""
    SELECT event_id, {fields},
           CASE WHEN bad THEN '' WHEN event_id % 6 = 0 THEN event_type || '|' || k END AS key_phrases,
           bad AS parse_error, CASE WHEN bad THEN raw END AS raw_output
    FROM (SELECT *, coalesce(raw IS NOT NULL AND trim(raw) <> '' AND TRY_CAST(raw AS JSON) IS NULL, FALSE) AS bad,
                 TRY_CAST(raw AS JSON) AS doc
          FROM (SELECT *, CASE event_id % 6
                  WHEN 0 THEN '{{"urgency": "' || CASE WHEN k >= 67 THEN 'high' WHEN k >= 34 THEN 'medium' ELSE 'low' END
                       || '", "churn_signal": "' || event_type || '", "pricing_concern": '
                       || CASE WHEN k % 2 = 0 THEN 'true' ELSE 'false' END || ', "key_phrases": ["' || event_type
                       || '", "' || k || '"]}}'
                  WHEN 1 THEN props WHEN 2 THEN '```json ' || props || '```' WHEN 3 THEN substring(props, 1, 5)
                  WHEN 4 THEN ' ' END AS raw
                FROM (SELECT event_id, event_type, props, {K} AS k FROM events)))"""


def _recommendation_sql() -> str:
    f = model_json.FALLBACK_ACTION
    return f"""
    SELECT event_id,
           CASE src WHEN 'good' THEN substring('ABCDEFG', k % 7 + 1, 1) WHEN 'bad' THEN {lit(f['code'])} ELSE '?' END AS code,
           CASE src WHEN 'good' THEN event_type WHEN 'bad' THEN {lit(f['title'])} ELSE 'No recommendation' END AS title,
           CASE src WHEN 'bad' THEN {lit(f['description'])} ELSE '' END AS description,
           'MEDIUM' AS priority,
           CASE src WHEN 'bad' THEN {lit(model_json.FALLBACK_WHY)} ELSE '' END AS why_this_action,
           CASE src WHEN 'good' THEN CAST(k AS VARCHAR) WHEN 'bad' THEN {lit(model_json.FALLBACK_EVIDENCE[0])} ELSE '' END
             AS evidence,
           0 AS alternatives,
           CASE src WHEN 'bad' THEN {lit(model_json.FALLBACK_FLAGS[0])} ELSE '' END AS risk_flags,
           src = 'bad' AS parse_error, CASE src WHEN 'bad' THEN '{{oops ' || event_type END AS raw_output
    FROM (SELECT event_id, event_type, {K} AS k,
                 CASE event_id % 5 WHEN 2 THEN 'bad' WHEN 4 THEN 'blank' ELSE 'good' END AS src FROM events)"""


def _text_search_sql() -> str:
    return """
    WITH doc AS (SELECT doc_id, lang, source, regexp_extract_all(lower(text), @words) AS ws FROM documents),
    total AS (SELECT count(*) AS n, avg(len(ws)) AS mean FROM doc),
    posting AS (SELECT doc_id, word, count(*) AS tf, any_value(size) AS size
                FROM (SELECT doc_id, len(ws) AS size, unnest(ws) AS word FROM doc) GROUP BY ALL),
    asked AS (SELECT query_id, word, count(*) AS qtf
              FROM (SELECT item_id AS query_id, unnest(regexp_extract_all(lower(text), @words)) AS word FROM benchmark)
              GROUP BY ALL),
    found AS (SELECT word, count(*) AS df FROM posting GROUP BY 1),
    scored AS (SELECT query_id, doc_id,
                 floor(sum(qtf * ln(1 + (n - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE)) * (tf * 2.2::DOUBLE
                   / (tf + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * size / mean)))) * 10000 + 0.5) / 10000 AS text_match
               FROM asked JOIN found USING (word) JOIN posting USING (word), total GROUP BY ALL)
    SELECT doc_id, lang, source, query_id, rank, text_match
    FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY text_match DESC, doc_id) AS rank FROM scored)
    JOIN doc USING (doc_id) WHERE rank <= 5"""


def _vector_search_sql() -> str:
    return """
    WITH part_t AS (SELECT label, i, avg(CAST(embedding[i] AS DOUBLE)) AS x
                    FROM (SELECT label, embedding, unnest(generate_series(1, len(embedding))) AS i FROM embeddings)
                    GROUP BY ALL),
    centroid AS (SELECT CAST(label AS BIGINT) AS query_id, list(x ORDER BY i) AS q FROM part_t GROUP BY 1),
    scored AS (SELECT query_id, vec_id,
                 floor(list_dot_product(e, q) / (sqrt(list_dot_product(e, e)) * sqrt(list_dot_product(q, q)))
                       * 1000000 + 0.5) / 1000000 AS cosine_similarity
               FROM (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings), centroid)
    SELECT * FROM (SELECT query_id, row_number() OVER (PARTITION BY query_id
                     ORDER BY cosine_similarity DESC, vec_id) AS rank, vec_id, cosine_similarity FROM scored)
    WHERE rank <= 5"""


def _substring_sql() -> str:
    def pattern(phrase: str) -> str:
        return lit("%" + phrase.replace("\\", "\\\\").replace("%", "\\%").replace("_", "\\_") + "%") + " ESCAPE '\\'"

    return " UNION ALL ".join(
        f"SELECT doc_id, {lit(p)} AS phrase FROM documents WHERE text ILIKE {pattern(p)}" for p in PHRASES
    )


def _reason_sql(n: int) -> str:
    gaps = ", ".join(f"b.{c} - a{n}.{c}" for c in CRITERIA)
    weakest = (
        "CASE greatest(" + gaps + ") "
        + " ".join(f"WHEN b.{c} - a{n}.{c} THEN '{c}'" for c in CRITERIA)
        + " END"
    )
    return f"'Scored ' || a{n}.composite || ' against ' || b.composite || '; weakest on ' || {weakest}"


PRIORITY_SQL = (
    "CASE WHEN coalesce(overall_severity = 'MAJOR', FALSE) OR churn_risk_label = 'HIGH' OR open_claims > 0 THEN 'HIGH' "
    "WHEN (overall_severity IS NULL OR overall_severity IN ('MINOR', 'UNCHANGED')) "
    "AND churn_risk_label IN ('LOW', 'MINIMAL') THEN 'LOW' ELSE 'MEDIUM' END"
)


def _kept(items: list[str]) -> str:
    return f"array_to_string(list_filter([{', '.join(items)}], lambda x: x IS NOT NULL), chr(10))"


RISK_FLAGS = [
    "CASE WHEN open_claims > 0 THEN 'Open claim on file' END",
    "CASE WHEN churn_risk_label = 'HIGH' THEN 'High churn risk' END",
    "CASE WHEN policy_status = 'LAPSED' THEN 'Policy has lapsed' END",
    f"CASE WHEN {FACTS['incomplete']} THEN 'Property or risk data is incomplete' END",
]
# Over a context row c and its best action b.
TALKING_POINTS = (
    "array_to_string(list_concat(list_filter(['Next step: ' || b.title, CASE WHEN tenure_years >= 5 AND payment_history = 'EXCELLENT' "
    "THEN 'Thank the customer for the long and reliable relationship' END], lambda x: x IS NOT NULL), "
    f"CASE WHEN flood_direction IS NULL THEN [] ELSE {POINT_LIST} END), chr(10))"
)
WHY = "b.title || ' scores ' || b.composite || ' of 40, the most of all actions the data supports'"
DESCRIBED = "CASE b.code " + " ".join(f"WHEN '{c}' THEN {lit(d)}" for c, d in DESCRIPTIONS.items()) + " END"


def _explanations_sql() -> str:
    added = f"list_filter({ITEMS.format('ren')}, lambda x: NOT list_contains({ITEMS.format('cur')}, x))"
    lines = [
        "'Customer for ' || tenure_years || ' years, payment history ' || payment_history",
        f"total_claims || ' claims on file, ' || open_claims || ' open, total $' || {whole('total_claim_amount')}",
        finding_sql("premium"), finding_sql("flood_cov"), finding_sql("flood_ded"),
        f"CASE WHEN overall_severity IS NOT NULL AND len({added}) > 0 THEN 'Exclusions added: ' || "
        f"array_to_string(list_sort({added}), ', ') END",
        *[
            f"CASE WHEN {d}_direction = 'UP' THEN '{d.capitalize()} risk rose from ' || prev_{d}_risk || ' to ' || "
            f"curr_{d}_risk || ': ' || curr_risk_reason END"
            for d in ("flood", "fire", "earthquake")
        ],
        "CASE WHEN policy_status = 'LAPSED' THEN 'The policy has lapsed' END",
    ]
    said = [
        "'Churn risk: ' || churn_risk_label", "'Retention risk: ' || retention_risk",
        "'Tone of the last contact: ' || sentiment_label", "'Intent of the last contact: ' || intent",
    ]

    return (
        f"SELECT c.customer_id, {_kept(lines)} AS facts, {_kept(said)} AS interpretation, "
        f"{_kept(RISK_FLAGS)} AS risk_flags, {TALKING_POINTS} AS talking_points "
        "FROM context_t c JOIN ranked_t b ON b.customer_id = c.customer_id AND b.place = 1"
    )


def _quality_sql() -> str:
    tables = {
        "customer": "customer_t", "property": "property_t", "policy_version": "policy_version_t",
        "risk_history": "risk_t", "claim": "claim_t", "interaction": "interaction_t", "action_log": "log_t",
    }
    rows = []

    def add(test: str, passed: str, details: str, source: str) -> None:
        rows.append(
            f"SELECT '{test}' AS test_id, CASE WHEN {passed} THEN 'PASS' ELSE 'FAIL' END AS result, "
            f"{details} AS details FROM ({source})"
        )

    for name, part in tables.items():
        add(f"row_count:{name}", "n > 0", "'rows=' || n", f"SELECT count(*) AS n FROM {part}")
    gap = "tenure_years IS NULL OR payment_history IS NULL OR location IS NULL OR policy_id IS NULL OR current_flood_risk IS NULL"
    add(
        "customer_360_completeness", "g = 0", "'customers=' || n || ', incomplete=' || g || ', with_renewal=' || w",
        f"SELECT count(*) AS n, count(*) FILTER ({gap}) AS g, count(*) FILTER (has_renewal_proposal) AS w FROM c360_t",
    )
    add(
        "scenario_coverage", "l >= 3 AND w >= 4 AND c >= 4 AND n >= 4",
        "'churn_labels=' || l || ', with_renewal=' || w || ', with_claims=' || c || ', without_claims=' || n || ', lapsed=' || p",
        "SELECT count(DISTINCT churn_risk_label) AS l, count(*) FILTER (has_renewal_proposal) AS w, "
        "count(*) FILTER (total_claims > 0) AS c, count(*) FILTER (total_claims = 0) AS n, "
        "count(*) FILTER (policy_status = 'LAPSED') AS p FROM c360_t",
    )
    pct = f"CASE WHEN ren_premium < cur_premium THEN -1 ELSE 1 END * ({tenths('cur_premium', 'ren_premium')})"
    text = "CASE WHEN {0} < 0 THEN '-' ELSE '' END || " + tenths_text("abs({0})")
    add(
        "policy_comparison_range", "u = 0",
        f"'renewals=' || n || ', without_percent=' || u || ', lowest=' || {text.format('lo')} || ', highest=' || {text.format('hi')}",
        f"SELECT count(*) AS n, count(*) FILTER (({pct}) IS NULL) AS u, min({pct}) AS lo, max({pct}) AS hi FROM comparison_t",
    )
    add(
        "risk_change_directions", "n > 0 AND m = 0",
        "'changes=' || n || ', flood_up=' || f || ', fire_up=' || r || ', earthquake_up=' || e || ', missing=' || m",
        "SELECT count(*) AS n, count(*) FILTER (flood_direction = 'UP') AS f, count(*) FILTER (fire_direction = 'UP') AS r, "
        "count(*) FILTER (earthquake_direction = 'UP') AS e, (SELECT count(*) FROM customer_t WHERE customer_id % 50 = 0 "
        "AND customer_id NOT IN (SELECT customer_id FROM change_t WHERE flood_direction = 'UP')) AS m FROM change_t",
    )
    add(
        "policy_comparison_values", "n > 0 AND d = 0", "'rows=' || n || ', different=' || d",
        "SELECT count(*) AS n, count(*) FILTER (NOT coalesce(overall_severity = 'MAJOR' AND exclusions_changed, FALSE)) AS d "
        "FROM customer_t c LEFT JOIN (SELECT customer_id AS id, overall_severity, exclusions_changed FROM comparison_t) ON id = customer_id "
        "WHERE customer_id % 50 = 0",
    )
    add(
        "risk_change_values", "n > 0 AND d = 0", "'rows=' || n || ', different=' || d",
        "SELECT count(*) AS n, count(*) FILTER (NOT coalesce(overall_direction = 'INCREASED', FALSE)) AS d "
        "FROM customer_t c LEFT JOIN (SELECT customer_id AS id, overall_direction FROM change_t) ON id = customer_id "
        "WHERE customer_id % 50 = 0",
    )
    for child, part, column, parent in (
        ("property", "property_t", "customer_id", "customer_t"),
        ("policy_version", "policy_version_t", "customer_id", "customer_t"),
        ("claim", "claim_t", "customer_id", "customer_t"),
        ("interaction", "interaction_t", "customer_id", "customer_t"),
        ("risk_history", "risk_t", "property_id", "property_t"),
    ):
        add(
            f"foreign_key:{child}.{column}", "n = 0", "'orphans=' || n",
            f"SELECT count(*) AS n FROM {part} x WHERE NOT EXISTS "
            f"(SELECT 1 FROM {parent} y WHERE y.{column} = x.{column})",
        )
    keys = {
        "customer": "customer_id", "property": "property_id", "policy_version": "policy_id, policy_version",
        "risk_history": "risk_assessment_id", "claim": "claim_id", "interaction": "interaction_id",
        "action_log": "action_id",
    }
    for name, key in keys.items():
        unset = " OR ".join(f"{k.strip()} IS NULL" for k in key.split(","))
        add(
            f"primary_key:{name}", "n = 0", "'bad_keys=' || n",
            f"SELECT count(*) AS n FROM (SELECT {key}, count(*) AS c FROM {tables[name]} GROUP BY ALL) WHERE c > 1 OR {unset}",
        )
    for name, columns in DOMAINS.items():
        for column, codes in columns.items():
            inside = ", ".join(map(lit, codes))
            add(
                f"domain:{name}.{column}", "n = 0", "'outside=' || n",
                f"SELECT count(*) FILTER ({column} NOT IN ({inside})) AS n FROM {tables[name]}",
            )
    lengths = {
        "customer": {"customer_id": 20, "name": 100, "payment_history": 20},
        "property": {"property_id": 20, "customer_id": 20, "property_type": 30, "location": 100, "construction_type": 30},
        "policy_version": {
            "policy_id": 20, "customer_id": 20, "policy_version": 20, "policy_type": 30, "policy_status": 20, "exclusions": 500,
        },
        "risk_history": {
            "risk_assessment_id": 20, "property_id": 20, "flood_risk": 10, "fire_risk": 10, "earthquake_risk": 10, "risk_reason": 500,
        },
        "claim": {"claim_id": 20, "customer_id": 20, "policy_id": 20, "claim_type": 30, "claim_status": 20},
        "interaction": {
            "interaction_id": 20, "customer_id": 20, "interaction_type": 20, "raw_transcript": 5000, "agent_note": 2000,
        },
        "action_log": {
            "action_id": 40, "customer_id": 20, "interaction_id": 20, "recommended_action": 16000, "action_taken": 4000, "status": 20,
        },
    }
    for name, columns in lengths.items():
        counts = ", ".join(f"count(*) FILTER (length(CAST({c} AS VARCHAR)) > {n}) AS {c}" for c, n in columns.items())
        add(
            f"length:{name}", " AND ".join(f"{c} = 0" for c in columns),
            " || ', ' || ".join(f"'{c}=' || {c}" for c in columns), f"SELECT {counts} FROM {tables[name]}",
        )
    return " UNION ALL ".join(rows)


INTERACTION_DOCS = f"""
    SELECT q.c_custkey AS interaction_id,
           CASE WHEN i.conv_id IS NULL THEN 'not_found' ELSE 'ok' END AS status, i.conv_id AS customer_id,
           CASE WHEN i.conv_id IS NULL THEN {lit(texts.INTERACTION_NOT_FOUND)} END AS message,
           CASE WHEN i.conv_id IS NOT NULL THEN q.c_name END AS customer_name, s.sentiment, s.sentiment_label,
           array_to_string(list_transform(string_split(s.intent, '_'),
               lambda w: upper(substring(w, 1, 1)) || substring(w, 2)), ' ') AS intent_title,
           s.urgency, s.churn_signal,
           array_to_string(list_transform(string_split(s.recommended_tone, '-'),
               lambda w: upper(substring(w, 1, 1)) || substring(w, 2)), ' ') AS tone_title,
           s.customer_emotion, s.retention_risk,
           CASE WHEN i.conv_id IS NOT NULL THEN coalesce(p.phrases, '') END AS key_phrases,
           CASE WHEN i.conv_id IS NOT NULL THEN coalesce(y.summary, '') END AS summary,
           CASE WHEN i.conv_id IS NOT NULL THEN 'CHAT' END AS interaction_type, s.pricing_concern, s.coverage_concern, s.complaint_signal
    FROM customer q LEFT JOIN (SELECT DISTINCT conv_id FROM conversations) i ON i.conv_id = q.c_custkey
    LEFT JOIN turn_scores_t s ON s.interaction_id = i.conv_id
    LEFT JOIN (SELECT interaction_id, string_agg(phrase, ' | ' ORDER BY rank) AS phrases FROM turn_phrases_t GROUP BY 1) p
           ON p.interaction_id = i.conv_id
    LEFT JOIN turn_summary_t y ON y.interaction_id = i.conv_id"""

DIALOGUE = """
    SELECT doc_id AS interaction_id, i - 1 AS turn_no, CASE WHEN i % 2 = 1 THEN 'Customer' ELSE 'Agent' END AS speaker,
           CASE WHEN i = 1 AND doc_id % 3 = 0 THEN source END AS subject, trim(lines[i]) AS text
    FROM (SELECT doc_id, source, lines, unnest(generate_series(1, len(lines))) AS i
          FROM (SELECT doc_id, source, string_split(text, chr(10)) AS lines FROM documents))"""

NBA_STATUS = """
    FROM requested_t q LEFT JOIN context_t c ON c.customer_id = q.customer_id
    LEFT JOIN (SELECT property_id, count(*) AS n FROM risk_t GROUP BY 1) h ON h.property_id = c.property_id"""
RISK_STATUS = (
    "CASE WHEN c.customer_id IS NULL THEN 'not_found' WHEN n >= 2 THEN 'ok' WHEN n = 1 THEN 'no_risk_change' "
    "ELSE 'no_risk_data' END"
)
POLICY_STATUS = (
    "CASE WHEN c.customer_id IS NULL THEN 'not_found' WHEN overall_severity IS NULL THEN 'no_renewal' ELSE 'ok' END"
)

C360_COLUMNS = (
    "customer_id name age d:tenure_years d:customer_value payment_history d:churn_risk_score churn_risk_label "
    "property_id property_type location building_age construction_type policy_id policy_status t:effective_date "
    "t:expiry_date d:annual_premium d:deductible d:building_coverage d:contents_coverage d:flood_coverage "
    "d:flood_deductible exclusions t:renewal_date has_renewal_proposal total_claims open_claims d:total_claim_amount "
    "t:last_claim_date current_flood_risk current_fire_risk current_earthquake_risk d:current_risk_score "
    "current_risk_reason t:risk_assessment_date last_interaction_id last_interaction_type "
    "s:last_interaction_timestamp last_interaction_transcript last_interaction_note"
)
SIGNAL_COLUMNS = (
    "interaction_id urgency churn_signal pricing_concern coverage_concern complaint_signal recommended_tone "
    "customer_emotion"
)

STATEMENTS: dict[str, str] = {
    "customer_360": _flat("c360_t", C360_COLUMNS),
    "customer_list": _flat("c360_t", "customer_id name churn_risk_label has_renewal_proposal d:tenure_years"),
    "churn_band": _flat("c360_t", "customer_id d:churn_risk_score churn_risk_label"),
    "claim_summary": _flat("claims_t", "customer_id total_claims open_claims d:total_claim_amount t:last_claim_date"),
    "latest_risk_per_property": _flat(
        "ranked_risk_t",
        "risk_assessment_id property_id t:assessment_date flood_risk fire_risk earthquake_risk d:overall_risk_score "
        "risk_reason",
    )
    + " WHERE rn = 1",
    "latest_interaction_per_customer": _flat(
        "last_said_t",
        "interaction_id customer_id interaction_type s:interaction_timestamp raw_transcript agent_note",
    ),
    "renewal_flag": _flat("c360_t", "customer_id has_renewal_proposal"),
    "policy_pivot": _flat("pivot_t", f"customer_id policy_id {PIVOT_COLUMNS}"),
    "policy_comparison": _flat("comparison_t", COMPARISON_COLUMNS),
    "exclusion_diff": f"""
    SELECT customer_id, policy_id, 'added' AS change, unnest(list_filter({ITEMS.format('ren')},
           lambda x: NOT list_contains({ITEMS.format('cur')}, x))) AS item FROM comparison_t
    UNION ALL
    SELECT customer_id, policy_id, 'removed' AS change, unnest(list_filter({ITEMS.format('cur')},
           lambda x: NOT list_contains({ITEMS.format('ren')}, x))) AS item FROM comparison_t""",
    "compare_policy_docs": _policy_docs_sql(),
    "key_findings": _listed("comparison_t", FINDING_LIST, "finding"),
    "renewal_report": _report_sql(),
    "risk_change": _flat("change_t", CHANGE_COLUMNS),
    "analyze_risk_docs": _risk_docs_sql(),
    "causal_chain": _listed("change_t", CAUSE_LIST, "cause"),
    "communication_points": _listed("change_t", POINT_LIST, "point"),
    "dialogue_turns": DIALOGUE,
    "sentiment_score": _flat("turn_scores_t", "interaction_id d:sentiment sentiment_label"),
    "intent_label": _flat("turn_scores_t", "interaction_id intent"),
    "deep_signals": _flat("turn_scores_t", SIGNAL_COLUMNS),
    "retention_risk": _flat("turn_scores_t", "interaction_id retention_risk"),
    "document_signals": _flat(
        "doc_scores_t", "d:sentiment sentiment_label intent retention_risk " + SIGNAL_COLUMNS
    ),
    "extractive_summary": _summary_sql("doc_sentences_t"),
    "key_phrases": _flat("turn_phrases_t", "interaction_id rank phrase hits"),
    "model_json_fallback": _signals_sql(),
    "recommendation_fallback": _recommendation_sql(),
    "interaction_docs": INTERACTION_DOCS,
    "text_search": _text_search_sql(),
    "vector_search": _vector_search_sql(),
    "substring_search": _substring_sql(),
    "nba_context": f"""
    SELECT q.customer_id, c.interaction_id, c.name, c.total_claims,
           CAST(c.current_risk_score AS DOUBLE) AS current_risk_score, {POLICY_STATUS} AS policy_status,
           {RISK_STATUS} AS risk_status,
           CASE WHEN t.conv_id IS NULL THEN 'no_interaction' ELSE 'ok' END AS interaction_status, s.retention_risk
    {NBA_STATUS}
    LEFT JOIN (SELECT DISTINCT conv_id FROM conversations) t ON t.conv_id = q.customer_id
    LEFT JOIN turn_scores_t s ON s.interaction_id = t.conv_id""",
    "nba_context_multi": f"""
    SELECT q.customer_id, h.property_id, p.policy_id, h.property_id AS described_property, p.policy_id AS described_policy,
           v.policy_id AS compared_policy, r.property_id AS changed_property,
           CASE WHEN r.property_id IS NOT NULL THEN v.policy_id END AS impact_policy, h.location,
           CAST(k.overall_risk_score AS DOUBLE) AS current_risk_score, CAST(r.curr_risk_score AS DOUBLE) AS changed_score,
           CASE WHEN c.customer_id IS NULL THEN 'not_found' WHEN v.policy_id IS NULL THEN 'no_renewal' ELSE 'ok' END AS policy_status,
           CASE WHEN c.customer_id IS NULL THEN 'not_found' WHEN r.property_id IS NOT NULL THEN 'ok'
                WHEN k.property_id IS NOT NULL THEN 'no_risk_change' ELSE 'no_risk_data' END AS risk_status
    FROM requested_t q LEFT JOIN customer_t c ON c.customer_id = q.customer_id
    LEFT JOIN (SELECT x.*, n FROM property_t x LEFT JOIN (SELECT property_id, count(*) AS n FROM risk_t GROUP BY 1) USING (property_id)
               QUALIFY row_number() OVER (PARTITION BY customer_id ORDER BY coalesce(n, 0) > 1 DESC, property_id) = 1) h
           ON h.customer_id = c.customer_id
    LEFT JOIN (SELECT customer_id, policy_id FROM (
                 SELECT customer_id, policy_id, bool_or(policy_version = 'CURRENT') AS cur, bool_or(policy_version = 'RENEWAL') AS ren
                 FROM policy_version_t GROUP BY 1, 2) WHERE cur
               QUALIFY row_number() OVER (PARTITION BY customer_id ORDER BY ren DESC, policy_id) = 1) p
           ON p.customer_id = c.customer_id
    LEFT JOIN comparison_t v ON v.policy_id = p.policy_id
    LEFT JOIN change_t r ON r.property_id = h.property_id
    LEFT JOIN ranked_risk_t k ON k.property_id = h.property_id AND k.rn = 1""",
    "nba_prompts": f"""
    SELECT c.customer_id, c.interaction_id, total_claims, c.name, payment_history, churn_risk_label, location,
           policy_status AS customer_policy_status, {POLICY_STATUS} AS policy_status, overall_severity,
           CASE WHEN overall_severity IS NOT NULL THEN {severity('cur_premium', 'ren_premium', 'premium')} END AS premium_severity,
           CASE WHEN overall_severity IS NULL THEN {lit(texts.NO_RENEWAL)} END AS policy_message,
           {RISK_STATUS} AS risk_status, flood_direction, curr_risk_reason AS root_cause,
           CASE WHEN n = 1 THEN {lit(texts.NO_RISK_CHANGE)} WHEN n IS NULL THEN {lit(texts.NO_RISK_DATA)} END AS risk_message,
           CASE WHEN c.interaction_id IS NULL THEN 'no_interaction' ELSE 'ok' END AS interaction_status,
           sentiment_label AS tone, intent, CASE WHEN c.interaction_id IS NOT NULL THEN coalesce(y.summary, '') END AS summary,
           {lit(chr(10).join(f"{code}. {title}" for code, title in MENU.items()))} AS menu
    FROM context_t c LEFT JOIN (SELECT property_id, count(*) AS n FROM risk_t GROUP BY 1) h ON h.property_id = c.property_id
    LEFT JOIN turn_summary_t y ON y.interaction_id = c.interaction_id""",
    "nba_scores": "SELECT customer_id, interaction_id, code, eligible, composite, "
    + ", ".join(CRITERIA)
    + " FROM candidates_t",
    "nba_ranked": f"""
    SELECT c.customer_id, b.code, {PRIORITY_SQL} AS priority, a2.code AS second, {_reason_sql(2)} AS second_reason,
           a3.code AS third, {_reason_sql(3)} AS third_reason
    FROM context_t c JOIN ranked_t b ON b.customer_id = c.customer_id AND b.place = 1
    LEFT JOIN ranked_t a2 ON a2.customer_id = c.customer_id AND a2.place = 2
    LEFT JOIN ranked_t a3 ON a3.customer_id = c.customer_id AND a3.place = 3""",
    "nba_explanations": _explanations_sql(),
    "nba_documents": f"""
    SELECT q.customer_id, c.interaction_id, CASE WHEN c.customer_id IS NULL THEN 'not_found' ELSE 'ok' END AS status,
           CASE WHEN c.customer_id IS NULL THEN {lit(texts.CUSTOMER_NOT_FOUND)} END AS message,
           c.name AS customer_name,
           CASE WHEN c.customer_id IS NOT NULL THEN {POLICY_STATUS} END AS policy_status,
           CASE WHEN c.customer_id IS NOT NULL THEN {RISK_STATUS} END AS risk_status, b.code, b.title, {DESCRIBED} AS description,
           CASE WHEN c.customer_id IS NOT NULL THEN {PRIORITY_SQL} END AS priority, {WHY} AS why,
           CASE WHEN c.customer_id IS NOT NULL THEN {TALKING_POINTS} END AS talking_points,
           CASE WHEN c.customer_id IS NOT NULL THEN {_kept(RISK_FLAGS)} END AS risk_flags, total_claims,
           CASE WHEN c.customer_id IS NULL THEN NULL WHEN c.interaction_id IS NULL THEN 'no_interaction' ELSE 'ok' END AS interaction_status,
           CASE WHEN c.interaction_id IS NOT NULL THEN coalesce(y.summary, '') END AS summary
    {NBA_STATUS} LEFT JOIN ranked_t b ON b.customer_id = q.customer_id AND b.place = 1
    LEFT JOIN turn_summary_t y ON y.interaction_id = c.interaction_id""",
    "action_log_append": f"""
    SELECT l.action_id, l.customer_id, l.interaction_id, l.action_taken, {stamp('l.made_at')} AS action_timestamp, l.status,
           b.code AS action_code, b.title AS action_title, {DESCRIBED} AS action_description, {PRIORITY_SQL} AS action_priority,
           {WHY} AS why, x.facts AS evidence
    FROM logged_t l JOIN context_t c ON c.customer_id = l.customer_id
    JOIN ranked_t b ON b.customer_id = l.customer_id AND b.place = 1
    JOIN ({_explanations_sql()}) x ON x.customer_id = l.customer_id""",
    "action_log_batches": f"""
    SELECT 'ACT-' || second || '-' || CASE WHEN n < 1000 THEN lpad(CAST(n AS VARCHAR), 3, '0') ELSE CAST(n AS VARCHAR) END AS action_id,
           customer_id, action_taken, 'PENDING' AS status, {stamp('made_at')} AS action_timestamp, TRUE AS confirmed, n AS number
    FROM (SELECT *, strftime(made_at, '%Y%m%d-%H%M%S') AS second,
                 row_number() OVER (PARTITION BY made_at ORDER BY customer_id % 2, bucket, customer_id) AS n
          FROM (SELECT *, {ID_BUCKET} AS bucket FROM (
                  SELECT q.customer_id, q.customer_id AS interaction_id, 'Call ' || q.customer_id AS action_taken,
                         TIMESTAMP '2024-03-01 00:00:00' + to_seconds(q.customer_id % 3) AS made_at
                  FROM requested_t q JOIN customer ON c_custkey = q.customer_id)))""",
    "action_log_results": f"""
    SELECT 'ok' AS status, action_id, customer_id, status AS action_status, {lit(texts.ACTION_LOGGED)} AS message
    FROM logged_t
    UNION ALL
    SELECT 'error', NULL, customer_id, NULL, {lit(texts.CUSTOMER_NOT_FOUND)} FROM requested_t
    WHERE customer_id NOT IN (SELECT c_custkey FROM customer)""",
    "action_history": f"""
    SELECT action_id, customer_id, name AS customer_name, interaction_id, action_taken, status,
           {stamp('action_timestamp')} AS action_timestamp FROM log_t JOIN customer_t USING (customer_id)""",
    "action_history_top10": f"""
    SELECT customer_id, row_number() OVER (PARTITION BY customer_id ORDER BY action_timestamp DESC, action_id DESC) AS rank,
           action_id, name AS customer_name, action_taken, status, {stamp('action_timestamp')} AS action_timestamp
    FROM (SELECT action_id, customer_id, name, action_taken, status, action_timestamp
          FROM log_t JOIN customer_t USING (customer_id)) QUALIFY rank <= 10""",
    "action_outcomes": """
    SELECT code, actions, pending, executed, declined, escalated,
           floor(pending * 10000 / actions + 0.5) / 10000 AS pending_rate,
           floor(executed * 10000 / actions + 0.5) / 10000 AS executed_rate,
           floor(declined * 10000 / actions + 0.5) / 10000 AS declined_rate,
           floor(escalated * 10000 / actions + 0.5) / 10000 AS escalated_rate
    FROM (SELECT code, count(*) AS actions, count(*) FILTER (status = 'PENDING') AS pending,
                 count(*) FILTER (status = 'EXECUTED') AS executed, count(*) FILTER (status = 'DECLINED') AS declined,
                 count(*) FILTER (status = 'ESCALATED') AS escalated FROM log_t GROUP BY 1)""",
    "action_outcome_cube": """
    SELECT code, channel, level, actions, pending, executed, declined, escalated,
           floor(pending * 10000 / actions + 0.5) / 10000 AS pending_rate,
           floor(executed * 10000 / actions + 0.5) / 10000 AS executed_rate,
           floor(declined * 10000 / actions + 0.5) / 10000 AS declined_rate,
           floor(escalated * 10000 / actions + 0.5) / 10000 AS escalated_rate
    FROM (SELECT code, channel, grouping(code, channel) AS level, count(*) AS actions, count(*) FILTER (status = 'PENDING') AS pending,
                 count(*) FILTER (status = 'EXECUTED') AS executed, count(*) FILTER (status = 'DECLINED') AS declined,
                 count(*) FILTER (status = 'ESCALATED') AS escalated
          FROM (SELECT code, status, interaction_type AS channel FROM log_t LEFT JOIN interaction_t USING (interaction_id))
          GROUP BY CUBE (code, channel))""",
    "quality_report": _quality_sql(),
    "fk_orphans": """
    SELECT 'property' AS child, 'customer_id' AS child_column, count(*) AS orphans FROM property_t
    WHERE customer_id NOT IN (SELECT customer_id FROM customer_t)
    UNION ALL SELECT 'policy_version', 'customer_id', count(*) FROM policy_version_t
    WHERE customer_id NOT IN (SELECT customer_id FROM customer_t)
    UNION ALL SELECT 'claim', 'customer_id', count(*) FROM claim_t
    WHERE customer_id NOT IN (SELECT customer_id FROM customer_t)
    UNION ALL SELECT 'interaction', 'customer_id', count(*) FROM interaction_t
    WHERE customer_id NOT IN (SELECT customer_id FROM customer_t)
    UNION ALL SELECT 'risk_history', 'property_id', count(*) FROM risk_t
    WHERE property_id NOT IN (SELECT property_id FROM property_t)""",
    "stream_postings": """
    SELECT doc_id, word, length, count(*) AS tf
    FROM (SELECT doc_id, len(ws) AS length, unnest(ws) AS word
          FROM (SELECT doc_id, regexp_extract_all(lower(text), @words) AS ws FROM documents)) GROUP BY ALL""",
    "stream_risk_alerts": _flat(
        "change_t",
        "property_id prev_assessment_id curr_assessment_id flood_direction fire_direction earthquake_direction "
        "d:risk_score_change d:risk_score_change_pct overall_direction",
    ),
    "stream_hourly_status": f"""
    SELECT {stamp('hour')} AS hour, status, count(*) AS actions
    FROM (SELECT date_trunc('hour', action_timestamp) AS hour, status FROM log_t) GROUP BY ALL""",
}


def _stream_interactions_sql() -> str:
    return (
        "SELECT interaction_id, sentiment, sentiment_label, intent, retention_risk FROM ("
        + _scores_sql(f"({_hits_sql(f'({DIALOGUE})')})")
        + ")"
    )


def _search_interactions_sql() -> str:
    search = (
        _text_search_sql()
        .replace("doc_id, lang, source, regexp_extract_all(lower(text)", "doc_id, customer_id, interaction_type, heard, regexp_extract_all(lower(text)")
        .replace("FROM documents)", "FROM call_t)")
        .replace("SELECT item_id AS query_id", "SELECT CAST(n_nationkey AS BIGINT) AS query_id")
        .replace("regexp_extract_all(lower(text), @words)) AS word FROM benchmark",
                 "regexp_extract_all('k ' || n_nationkey, @words)) AS word FROM nation")
        .replace("SELECT doc_id, lang, source, query_id", "SELECT doc_id AS interaction_id, customer_id, interaction_type, heard AS interaction_timestamp, query_id")
    )
    calls = (
        f"call_t AS (SELECT interaction_id AS doc_id, customer_id, interaction_type, {stamp('interaction_timestamp')} AS heard, "
        "raw_transcript AS text FROM interaction_t WHERE interaction_type = 'CALL')"
    )
    return search.replace("WITH doc AS", f"WITH interaction_t AS ({PARTS['interaction_t']}), {calls}, doc AS", 1)


# Other plans for large request sides; the results are the same.
STATEMENTS["text_search_shuffled"] = STATEMENTS["text_search_topk"] = STATEMENTS["stream_text_search"] = STATEMENTS["text_search"]
STATEMENTS["vector_search_grid"] = STATEMENTS["vector_search"]
STATEMENTS["action_log_writers"] = """
    SELECT '2024-03-01 00:00:0' || customer_id % 3 || '.000000' AS action_timestamp, count(*) AS actions, count(*) AS ids,
           count(DISTINCT customer_id) AS customers
    FROM requested_t JOIN customer_t USING (customer_id) GROUP BY 1"""
STATEMENTS["tables_replaced"] = " UNION ALL ".join(
    f"SELECT '{name}' AS name, count(*) AS n, count(DISTINCT ({keys})) AS keys, min(CAST({keys.split(',')[0]} AS VARCHAR)) AS first_key, "
    f"max(CAST({keys.split(',')[0]} AS VARCHAR)) AS last_key FROM {table}"
    for name, table, keys in (
        ("customer", "customer_t", "customer_id"), ("property", "property_t", "property_id"),
        ("policy_version", "policy_version_t", "policy_id, policy_version"), ("risk_history", "risk_t", "risk_assessment_id"),
        ("claim", "claim_t", "claim_id"), ("interaction", "interaction_t", "interaction_id"), ("action_log", "log_t", "action_id"),
    )
)
STATEMENTS["literal_customers"] = """
    SELECT CAST(customer_id AS VARCHAR) AS customer_id, name, CAST(age AS BIGINT) AS age, CAST(churn_risk_score AS DOUBLE) AS churn_risk_score,
           payment_history FROM customer_t
    UNION ALL SELECT 'L1', 'By position', 41, 0.5, 'GOOD' UNION ALL SELECT 'L2', 'By name', NULL, NULL, NULL"""
STATEMENTS["customer_documents"] = "SELECT customer_id, name, CAST(churn_risk_score AS DOUBLE) AS churn_risk_score, payment_history FROM customer_t"
STATEMENTS["newest_actions"] = f"""
    SELECT action_id, customer_id, status, {stamp('action_timestamp')} AS action_timestamp FROM log_t JOIN customer_t USING (customer_id)
    ORDER BY log_t.action_timestamp DESC, action_id DESC LIMIT 100"""
STATEMENTS["default_requests"] = "SELECT DISTINCT customer_id, last_interaction_id AS interaction_id FROM c360_t"
STATEMENTS["current_time"] = """
    SELECT customer_id, TRUE AS is_now, 'Call the' AS short_text FROM requested_t JOIN customer_t USING (customer_id)"""
STATEMENTS["applied_model"] = "SELECT doc_id AS interaction_id, coalesce(length(text), 0) AS characters, 'v1' AS model_version FROM documents"
STATEMENTS["customer_360_bucketed"] = STATEMENTS["customer_360"]
STATEMENTS["fk_orphans_filtered"] = STATEMENTS["fk_orphans"]
STATEMENTS["stream_risk_alerts_state"] = STATEMENTS["stream_risk_alerts"]
STATEMENTS["stream_interactions"] = _stream_interactions_sql()
STATEMENTS["stream_action_log"] = (
    f"SELECT action_id, customer_id, action_taken, status, {stamp('action_timestamp')} AS action_timestamp FROM log_t"
)
STATEMENTS["search_interactions"] = _search_interactions_sql()
STATEMENTS["vector_search_interactions"] = (
    _vector_search_sql()
    .replace("SELECT CAST(label AS BIGINT) AS query_id, list(x", "SELECT 'Q' || label AS query_id, list(x")
    .replace("SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings",
             "SELECT 'INT' || vec_id AS vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings WHERE label < 5")
)
STATEMENTS["vector_search_indexed"] = """
    SELECT count(*) AS queries, sum(least(5, (SELECT count(*) FROM embeddings WHERE embedding IS NOT NULL)))::BIGINT AS results,
           TRUE AS recall_reached, TRUE AS similarities_exact
    FROM embeddings WHERE vec_id % 20 = 0 AND embedding IS NOT NULL"""
STATEMENTS["substring_requests"] = """
    SELECT DISTINCT doc_id, phrase FROM documents JOIN (
      SELECT DISTINCT array_to_string(string_split(text, ' ')[1:3], ' ') AS phrase FROM benchmark WHERE item_id > 0) ON contains(lower(text), lower(phrase))
    WHERE phrase <> ''"""
STATEMENTS["phrase_search_large"] = """
    SELECT DISTINCT doc_id, phrase FROM documents JOIN (
      SELECT DISTINCT phrase FROM (SELECT string_split(text, ' ')[1:4] AS ws, array_to_string(ws, ' ') AS phrase FROM documents)
      WHERE len(ws) = 4 AND length(phrase) >= 16) ON contains(lower(text), lower(phrase))"""

# The first of every three customers holds the homes and policies of all three.
POOLED = "c_custkey - (c_custkey - 1) % 3 AS customer_id"
POOLED_PARTS = {
    "property_t": PARTS["property_t"].replace("c_custkey AS customer_id", POOLED),
    "policy_version_t": PARTS["policy_version_t"].replace("o_custkey AS customer_id", POOLED.replace("c_custkey", "o_custkey")),
}
POOLED_STATEMENTS = {
    "customer_360_multi": STATEMENTS["customer_360"],
    "compare_policy_docs_multi": STATEMENTS["compare_policy_docs"],
    "analyze_risk_docs_multi": STATEMENTS["analyze_risk_docs"],
    "nba_context_multi": STATEMENTS.pop("nba_context_multi"),
}


def statements() -> dict[str, str]:
    return {name: sql.replace("@words", WORDS) for name, sql in _statements().items()}


def _statements() -> dict[str, str]:
    out = {name: _with(sql.strip()) if not sql.lstrip().startswith("WITH") else sql.strip() for name, sql in STATEMENTS.items()}
    return out | {name: _with(sql.strip(), POOLED_PARTS) for name, sql in POOLED_STATEMENTS.items()}
