"""Personal data: patterns propose spans, checksums confirm them, words nearby adjust the score.

DataFrame expressions only. The places of a pattern's matches come from cutting
the text at them: the pieces between the matches and the matches themselves
alternate, so running sums of their lengths are the code point positions.
Patterns are written without backtracking over long runs (possessive
quantifiers, starts only where a run or the previous match ends); they match
exactly what the plain forms in ``KINDS`` would. Matches are walked in blocks
of about the root of their number, each beside its own part of the text, so that a text full of them takes
little more than its length.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import free_names, table

#: Code points before and after a span that are searched for context words.
CONTEXT = 40
#: Added kinds are reported from this score.
LEAST_SCORE = 0.5

#: Letters and digits of an account number by country.
IBAN_LENGTHS = {
    15: "NO", 16: "BE", 18: "DK FI FK FO GL NL SD", 19: "MK SI", 20: "AT BA EE KZ LT LU MN XK", 21: "CH HR LI LV",
    22: "BG BH CR DE GB GE IE ME RS VA", 23: "AE GI IL IQ OM SO TL", 24: "AD CZ ES MD PK RO SA SE SK TN VG",
    25: "LY PT ST", 26: "IS TR", 27: "BI DJ FR GR IT MC MR SM", 28: "AL AZ BY CY DO GT HN HU LB NI PL SV", 29: "BR EG PS QA UA",
    30: "JO KW MU YE", 31: "MT SC", 32: "LC", 33: "RU",
}


def _iban() -> str:
    """An account number as long as its country's, with no letter or digit directly around it; of other codes, a run."""
    ends = "(?![A-Za-z0-9])"
    known = "|".join(IBAN_LENGTHS.values()).replace(" ", "|")
    forms = [
        f"(?:{codes.replace(' ', '|')})[0-9]{{2}}(?:[\\x20]?[A-Z0-9]{{4}}){{{size // 4 - 1}}}"
        + (f"[\\x20]?[A-Z0-9]{{{size % 4}}}" if size % 4 else "") + ends
        for size, codes in IBAN_LENGTHS.items()
    ]
    other = rf"(?!{known})[A-Z]{{2}}[0-9]{{2}}(?:[\x20]?[A-Z0-9]{{4}}){{2,7}}(?:[\x20]?[A-Z0-9]{{1,3}})?"
    return "(?:" + "|".join([*forms, other]) + ")"


IBAN = _iban()
#: Country and check digits alone, so that a number that fails its check does not take one behind it along.
IBAN_START = f"(?:(?<![A-Za-z0-9])|(?!{'|'.join(IBAN_LENGTHS.values()).replace(' ', '|')}))[A-Z]{{2}}[0-9]{{2}}"
#: More code points than an account number with blanks has.
IBAN_REACH = 50


#: A name of a secret with a value behind it, or a key that is known by its start.
SECRET = (
    r"(?:(?i:token|secret|password|passwd|api[_-]?key|access[_-]?key)[\x22']?[\x20]?[:=][\x20]?[\x22']?[A-Za-z0-9/+_.-]{16,}"
    r"|gh[opsu]_[A-Za-z0-9]{36}|AKIA[0-9A-Z]{16})"
)
#: The value; words and repeated characters are none.
SECRET_VALUE, SECRET_KINDS = r"[A-Za-z0-9/+_.-]{16,}$", 8


@dataclass(frozen=True)
class Kind:
    """A kind of personal data: when a text is worth searching, what proposes spans, how they are scored."""

    name: str
    gate: str
    pattern: str
    score: float
    context: str
    bonus: float
    base: bool = True


KINDS = (
    # [A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+
    Kind(
        "email", "@",
        r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
        0.9, r"(?i)(?:e-?mail|contact|write to|kontakt|correo|courriel)", 0.1,
    ),
    # [0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)
    Kind(
        "ip", r"[0-9]\.[0-9]",
        r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
        0.6, r"(?i)(?:host|server|address|adresse|login)", 0.3,
    ),
    # [0-9]([\x20-]?[0-9])+
    Kind(
        "card", r"[0-9](?:[\x20-]?[0-9]){11}",
        r"[0-9](?:[\x20-]?[0-9])++",
        0.8, r"(?i)(?:card|visa|credit|karte|tarjeta|carte)", 0.2,
    ),
    # \+[0-9][\x20().0-9-]+[0-9]
    Kind(
        "phone", r"\+[0-9]",
        r"\+[0-9][\x20().0-9-]+[0-9]",
        0.7, r"(?i)(?:phone|tel:|call|mobile|fax|telefon)", 0.3,
    ),
    Kind(
        "iban", r"[A-Z]{2}[0-9]{2}",
        IBAN_START,
        0.8, r"(?i)(?:iban|account|konto|cuenta|compte|bank)", 0.2, base=False,
    ),
    Kind(
        "ssn", r"[0-9]{3}-[0-9]{2}-[0-9]{4}",
        r"[0-9][0-9-]*+",
        0.4, r"(?i)(?:ssn|social security|tax id|identity)", 0.5, base=False,
    ),
    Kind(
        "secret", r"(?i)token|secret|passw|key|gh[opsu]_|AKIA",
        SECRET,
        0.6, r"(?i)(?:login|credential|auth|bearer)", 0.3, base=False,
    ),
)

SPAN = "array<struct<start:bigint,rank:int,end:bigint,score:double>>"


def luhn(digits: Column) -> Column:
    """True if the digits pass the Luhn check: from the right, every second one doubled, its digits summed."""
    each = F.split(F.reverse(digits), "(?!^)(?!$)")
    values = F.transform(
        each,
        lambda d, i: F.when(i % 2 == 0, d.cast("int")).otherwise(d.cast("int") * 2 - F.when(d.cast("int") > 4, 9).otherwise(0)),
    )
    return F.aggregate(values, F.lit(0), lambda a, x: a + x) % 10 == 0


def mod_97(code: Column) -> Column:
    """True for an account number whose check digits are right (remainder 1 modulo 97, letters as 10 to 35)."""
    turned = F.concat(F.substring(code, 5, 40), F.substring(code, 1, 4))
    step = lambda a, c: F.when(
        c.rlike("[0-9]"), (a * 10 + c.cast("int")) % 97
    ).otherwise((a * 100 + F.ascii(c) - 55) % 97)
    return F.aggregate(F.split(turned, "(?!^)(?!$)"), F.lit(0), step) == 1


def _confirmed(kind: Kind, found: Column) -> Column:
    digits = F.regexp_replace(found, "[^0-9]", "")
    if kind.name == "ip":
        small = lambda part: F.regexp_replace(part, "^0+(?=[0-9])", "")
        return F.forall(
            F.split(found, r"\."), lambda p: (F.length(small(p)) <= 3) & (F.substring(small(p), 1, 3).cast("int") <= 255)
        )
    if kind.name == "card":
        return F.when(F.length(digits).between(12, 19), luhn(digits)).otherwise(F.lit(False))
    if kind.name == "phone":
        return F.length(digits).between(9, 15)
    if kind.name == "iban":
        return mod_97(F.replace(found, F.lit(" "), F.lit("")))
    if kind.name == "ssn":
        return found.rlike("^[0-9]{3}-[0-9]{2}-[0-9]{4}$") & ~digits.rlike("^(?:000|666|9)|^...00|0000$")
    if kind.name == "secret":
        value = F.regexp_extract(found, SECRET_VALUE, 0)
        return value.rlike("[0-9]") & (F.size(F.array_distinct(F.split(value, "(?!^)(?!$)"))) >= SECRET_KINDS)
    return F.lit(True)


#: Fewest matches of a block.
LEAST_BLOCK = 64
PLACED = "array<struct<start:bigint,end:bigint>>"


def _let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is worked out once: what a lambda names is worked out again for every element."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _blocks(items: Column) -> tuple[Column, Column]:
    """(items in a block, their number of blocks): about as many of either."""
    size = F.greatest(F.ceil(F.sqrt(F.size(items))), F.lit(LEAST_BLOCK)).cast("int")
    return size, F.ceil(F.size(items) / size).cast("int")


def _numbered(blocks: Column) -> Column:
    """0, 1, … for every block; empty if there is none."""
    return F.when(blocks > 0, F.sequence(F.lit(0), blocks - 1)).otherwise(F.array().cast("array<int>"))


def _matches(text: Column, pattern: str) -> Column:
    """Blocks of matches: (at, matches (piece, match)), ``at`` being the code points before the first piece."""
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    # the last piece has no match
    pairs = F.filter(F.arrays_zip(F.split(text, pattern, -1).alias("piece"), found.alias("match")), lambda p: p["match"].isNotNull())
    length = lambda block: F.aggregate(
        block, F.lit(0).cast("bigint"), lambda n, p: n + F.length(p["piece"]) + F.length(p["match"])
    )

    def cut(pairs: Column) -> Column:
        size, blocks = _blocks(pairs)
        return F.transform(_numbered(blocks), lambda b: F.slice(pairs, b * size + 1, size))

    def placed(sized: Column) -> Column:
        before = lambda i: F.aggregate(F.slice(sized, F.lit(1), i), F.lit(0).cast("bigint"), lambda n, x: n + x["length"])
        return F.transform(sized, lambda x, i: F.struct(before(i).alias("at"), x["matches"].alias("matches"), x["length"].alias("length")))

    sized = F.transform(_let(pairs, cut), lambda block: F.struct(block.alias("matches"), length(block).alias("length")))
    return _let(sized, placed)


def _spans(text: Column, kind: Kind, rank: int) -> Column:
    """The confirmed spans of one kind; an empty array for most texts, which fail the gate."""
    # a block's own part of the text, with room for context before and for an account number and context behind
    origin = lambda x: F.greatest(x["at"] - CONTEXT, F.lit(0).cast("bigint"))
    reach = IBAN_REACH + CONTEXT
    own = F.transform(
        _matches(text, kind.pattern),
        lambda x: F.struct(
            x["at"].alias("at"), x["matches"].alias("matches"), origin(x).alias("origin"),
            F.substring(text, (origin(x) + 1).cast("int"), (x["at"] - origin(x) + x["length"] + reach).cast("int")).alias("around"),
        ),
    )

    def walk(x: Column) -> Column:
        nothing = F.struct(x["at"].alias("at"), F.array().cast(PLACED).alias("out"))

        def step(acc: Column, p: Column) -> Column:
            start = acc["at"] + F.length(p["piece"])
            whole, fits = p["match"], F.lit(True)
            if kind.name == "iban":
                here = F.substring(x["around"], (start - x["origin"] + 1).cast("int"), F.lit(IBAN_REACH))
                whole = F.regexp_extract(here, f"^{IBAN}", 0)
                fits = F.length(whole) > 0
            span = F.array(F.struct(start.alias("start"), (start + F.length(whole)).alias("end")))
            found = F.when(fits & _confirmed(kind, whole), F.concat(acc["out"], span)).otherwise(acc["out"])
            return F.struct((start + F.length(p["match"])).alias("at"), found.alias("out"))

        return F.aggregate(x["matches"], nothing, step, lambda acc: acc["out"])

    def scored(x: Column, span: Column) -> Column:
        first = span["start"] - x["origin"]
        near = F.concat(
            F.substring(x["around"], F.greatest(first - CONTEXT + 1, F.lit(1)).cast("int"), F.least(first, F.lit(CONTEXT)).cast("int")),
            F.lit(" "),
            F.substring(x["around"], (span["end"] - x["origin"] + 1).cast("int"), F.lit(CONTEXT)),
        )
        score = F.lit(kind.score) + F.when(near.rlike(kind.context), kind.bonus).otherwise(0.0)
        return F.struct(span["start"].alias("start"), F.lit(rank).alias("rank"), span["end"].alias("end"), score.alias("score"))

    found = F.flatten(F.transform(own, lambda x: F.transform(walk(x), lambda span: scored(x, span))))
    if kind.name == "iban":
        found = _let(found, _apart)
    if not kind.base:
        found = F.filter(found, lambda s: s["score"] >= LEAST_SCORE)
    return F.when(text.rlike(kind.gate), found).otherwise(F.array().cast(SPAN))


def _apart(spans: Column) -> Column:
    """Without spans that begin inside an earlier one that is kept. Hardly any text has some; only those are walked one by one."""
    inside = F.exists(
        F.arrays_zip(spans.alias("s"), F.slice(spans, F.lit(2), F.greatest(F.size(spans) - 1, F.lit(0))).alias("next")),
        lambda p: F.coalesce(p["next"]["start"] < p["s"]["end"], F.lit(False)),
    )
    step = lambda out, s: F.when(
        F.coalesce(F.try_element_at(out, F.lit(-1))["end"], F.lit(0)) <= s["start"], F.concat(out, F.array(s))
    ).otherwise(out)
    return F.when(inside, F.aggregate(spans, F.array().cast(SPAN), step)).otherwise(spans)


def find_personal_data(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with ``pii_spans``: array of (start, rank, end, score) by start, then kind.

    ``rank`` is the place of the kind in ``KINDS``; positions are code points,
    ends exclusive. NULL, empty and clean texts have an empty array. Matches
    that fail their check are left out; base kinds are kept at any score.
    Spans of different kinds may overlap. All columns and rows stay; an added
    column replaces one of the same name. An empty table stays empty.
    """
    return docs.withColumn("pii_spans", _found(F.col(text).cast("string")))


def _found(text: Column) -> Column:
    body = F.coalesce(text, F.lit(""))
    return F.array_sort(F.concat(*[_spans(body, kind, rank) for rank, kind in enumerate(KINDS)]))


def _written(spans: Column) -> Column:
    names = F.array(*[F.lit(k.name) for k in KINDS])
    return F.array_join(
        F.transform(
            spans,
            lambda s: F.concat_ws(":", F.get(names, s["rank"]), s["start"].cast("string"), s["end"].cast("string")),
        ),
        ",",
    )


def redact(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with every span replaced by its kind in brackets; overlapping spans become the first one's kind.

    Texts without spans, NULL texts and all other columns stay as they are.
    """
    names = F.array(*[F.lit(f"[{k.name.upper()}]") for k in KINDS])
    (held,) = free_names(docs.columns, "found_spans")
    body, spans = F.col(text).cast("string"), F.col(held)
    zero = F.lit(0).cast("bigint")

    def cut(spans: Column) -> Column:
        size, blocks = _blocks(spans)
        furthest = lambda block: F.array_max(F.transform(block, lambda s: s["end"]))
        blocked = F.transform(_numbered(blocks), lambda b: F.slice(spans, b * size + 1, size))
        return F.transform(blocked, lambda block: F.struct(block.alias("spans"), furthest(block).alias("end")))

    def placed(blocked: Column) -> Column:
        """Every block with the end of all spans before it, and its own part of the text from there."""
        covered = lambda i: F.coalesce(F.array_max(F.transform(F.slice(blocked, F.lit(1), i), lambda x: x["end"])), zero)
        ranged = F.transform(blocked, lambda x, i: F.struct(x["spans"].alias("spans"), covered(i).alias("at")))
        room = lambda x: F.greatest(F.element_at(x["spans"], -1)["start"] - x["at"], zero)
        part = lambda x: F.substring(body, (x["at"] + 1).cast("int"), room(x).cast("int"))
        return F.transform(ranged, lambda x: F.struct(x["spans"].alias("spans"), x["at"].alias("at"), part(x).alias("part")))

    def rewritten(x: Column) -> Column:
        step = lambda acc, s: F.when(
            s["start"] < acc["at"],
            F.struct(F.greatest(acc["at"], s["end"]).alias("at"), acc["out"].alias("out")),
        ).otherwise(
            F.struct(
                s["end"].alias("at"),
                F.concat(
                    acc["out"],
                    F.array(
                        F.substring(x["part"], (acc["at"] - x["at"] + 1).cast("int"), (s["start"] - acc["at"]).cast("int")),
                        F.get(names, s["rank"]),
                    ),
                ).alias("out"),
            )
        )
        nothing = F.struct(x["at"].alias("at"), F.array().cast("array<string>").alias("out"))
        return F.aggregate(x["spans"], nothing, step, lambda acc: F.array_join(acc["out"], ""))

    furthest = F.array_max(F.transform(spans, lambda s: s["end"]))
    rest = F.substring(body, (furthest + 1).cast("int"), F.lit(2**31 - 1))
    whole = F.concat(F.array_join(F.transform(_let(_let(spans, cut), placed), rewritten), ""), rest)
    cleaned = F.when(F.size(spans) > 0, whole).otherwise(body)
    found = docs.withColumn(held, _found(body))
    return found.withColumn(text, cleaned).drop(held)


def op9_pii(spark, sf_dir: str) -> DataFrame:
    """The contract's columns for all of ``documents``."""
    found = find_personal_data(table(spark, sf_dir, "documents"))
    base = F.filter("pii_spans", lambda s: s["rank"] < 4)
    count = lambda rank: F.size(F.filter("pii_spans", lambda s: s["rank"] == rank)).cast("long")
    return found.select(
        "doc_id",
        *[count(rank).alias(f"n_{kind.name}") for rank, kind in enumerate(KINDS[:4])],
        F.sha2(F.encode(_written(base), "UTF-8"), 256).alias("base_sha256"),
        _written(F.col("pii_spans")).alias("spans"),
    )


def _sql_kind(rank: int, kind: Kind, pattern: str, check: str) -> str:
    """Confirmed spans of one kind in DuckDB: pieces and matches alternate, their lengths add up to places."""
    score = "1.0" if kind.base else f"""{kind.score} + CASE WHEN regexp_matches(
        substring(text, greatest(s - {CONTEXT} + 1, 1)::BIGINT, least(s, {CONTEXT})::BIGINT) || ' ' || substring(text, e::BIGINT + 1, {CONTEXT}),
        '{kind.context}') THEN {kind.bonus} ELSE 0 END"""
    return f"""
SELECT doc_id, {rank} AS rank, '{kind.name}' AS kind, s, e FROM (
  SELECT doc_id, text, m, regexp_replace(m, '[^0-9]', '', 'g') AS d, e - length(m) AS s, e FROM (
    SELECT doc_id, text, m, sum(length(p) + length(m)) OVER (PARTITION BY doc_id ORDER BY i) AS e FROM (
      SELECT doc_id, text, i, ps[i] AS p, ms[i] AS m FROM (
        SELECT doc_id, text, ps, ms, unnest(generate_series(1, len(ms))) AS i FROM (
          SELECT doc_id, text, string_split_regex(text, '{pattern}') AS ps, regexp_extract_all(text, '{pattern}') AS ms
          FROM documents WHERE regexp_matches(text, '{kind.gate}')))))
) WHERE {check} AND {score} >= {LEAST_SCORE}"""


_LUHN = """length(d) BETWEEN 12 AND 19 AND list_sum([
    CASE WHEN (length(d) - i) % 2 = 0 THEN substring(d, i, 1)::INT
         ELSE substring(d, i, 1)::INT * 2 - CASE WHEN substring(d, i, 1)::INT > 4 THEN 9 ELSE 0 END END
    FOR i IN generate_series(1, length(d))]) % 10 = 0"""
_IP = "list_bool_and([length(ltrim(x, '0')) <= 3 AND ('0' || left(ltrim(x, '0'), 3))::INT <= 255 FOR x IN string_split(m, '.')])"
_MOD_97 = """list_reduce([
    CASE WHEN c BETWEEN '0' AND '9' THEN c::INT ELSE ascii(c) - 55 END
    FOR c IN list_concat([0::VARCHAR], string_split(substring(replace(m, ' ', ''), 5) || left(replace(m, ' ', ''), 4), ''))],
    lambda a, b: (a * CASE WHEN b > 9 THEN 100 ELSE 10 END + b) % 97) = 1"""


def _iban_sql() -> str:
    """Account numbers from every possible start: as long as their country says and standing alone; of other codes, a run."""
    known = " ".join(IBAN_LENGTHS.values()).split()
    listed = lambda codes: ", ".join(f"'{c}'" for c in codes)
    form = lambda size: (
        f"^([A-Z]{{2}}[0-9]{{2}}(?:[\\x20]?[A-Z0-9]{{4}}){{{size // 4 - 1}}}" + (f"[\\x20]?[A-Z0-9]{{{size % 4}}}" if size % 4 else "") + ")(?:[^A-Za-z0-9]|$)"
    )
    of_country = "\n".join(
        f"WHEN left(c, 2) IN ({listed(codes.split())}) THEN regexp_extract(c, '{form(size)}', 1)" for size, codes in IBAN_LENGTHS.items()
    )
    other = r"^[A-Z]{2}[0-9]{2}(?:[\x20]?[A-Z0-9]{4}){2,7}(?:[\x20]?[A-Z0-9]{1,3})?"
    start = "[A-Z]{2}[0-9]{2}"
    return f"""
SELECT doc_id, 4 AS rank, 'iban' AS kind, s, s + length(m) AS e FROM (
  SELECT doc_id, s, CASE WHEN left(c, 2) IN ({listed(known)}) AND regexp_matches(before, '[A-Za-z0-9]') THEN ''
    {of_country} ELSE regexp_extract(c, '{other}') END AS m FROM (
    SELECT doc_id, e - 4 AS s, substring(text, e::BIGINT - 3, {IBAN_REACH}) AS c, CASE WHEN e > 4 THEN substring(text, e::BIGINT - 4, 1) ELSE '' END AS before FROM (
      SELECT doc_id, text, sum(length(ps[i]) + 4) OVER (PARTITION BY doc_id ORDER BY i) AS e FROM (
        SELECT doc_id, text, ps, unnest(generate_series(1, len(ps) - 1)) AS i FROM (
          SELECT doc_id, text, string_split_regex(text, '{start}') AS ps FROM documents WHERE regexp_matches(text, '{start}')))))
) WHERE length(m) > 0 AND {_MOD_97}"""


_SSN = "regexp_full_match(m, '[0-9]{3}-[0-9]{2}-[0-9]{4}') AND NOT regexp_matches(d, '^(?:000|666|9)|^...00|0000$')"
_SECRET = f"""regexp_matches(regexp_extract(m, '{SECRET_VALUE}'), '[0-9]')
    AND len(list_distinct(string_split(regexp_extract(m, '{SECRET_VALUE}'), ''))) >= {SECRET_KINDS}"""

OP9_SQL = (
    "WITH span AS ("
    + " UNION ALL ".join(
        _sql_kind(rank, kind, pattern, check)
        for (rank, kind), (pattern, check) in zip(
            enumerate(KINDS),
            (
                (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "true"),
                (r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", _IP),
                (r"[0-9]([\x20-]?[0-9])+", _LUHN),
                (r"\+[0-9][\x20().0-9-]+[0-9]", "length(d) BETWEEN 9 AND 15"),
                (None, None),
                (r"[0-9][0-9-]*", _SSN),
                (SECRET.replace("'", "''"), _SECRET),
            ),
        )
        if pattern
    )
    + " UNION ALL " + _iban_sql()
    + """
), per AS (
  SELECT doc_id, count(*) FILTER (rank = 0) AS n_email, count(*) FILTER (rank = 1) AS n_ip, count(*) FILTER (rank = 2) AS n_card,
    count(*) FILTER (rank = 3) AS n_phone,
    string_agg(kind || ':' || s::BIGINT || ':' || e::BIGINT, ',' ORDER BY s, rank) FILTER (rank < 4) AS base,
    string_agg(kind || ':' || s::BIGINT || ':' || e::BIGINT, ',' ORDER BY s, rank) AS spans
  FROM span GROUP BY doc_id
)
SELECT doc_id, coalesce(n_email, 0)::BIGINT AS n_email, coalesce(n_ip, 0)::BIGINT AS n_ip, coalesce(n_card, 0)::BIGINT AS n_card,
  coalesce(n_phone, 0)::BIGINT AS n_phone, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM documents LEFT JOIN per USING (doc_id)"""
)
