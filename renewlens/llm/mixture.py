"""Mixing sources to target weights by iterative proportional fitting.

DataFrame operations only. Documents are counted into cells (source, language,
topic) of tokens. Cell weights are raked: scaled to the source targets, then to
the language targets, then to the topic targets, again and again, until all
three marginals agree within a tolerance. A document of a cell is then taken at the rate raked
weight / tokens of the cell: once with that probability, or, for a cell that
has to grow, as many times as the rate says.
"""

from __future__ import annotations

import warnings

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import free_names, stored, table

MARGINS = ("source", "lang", "topic")
NONE = "(none)"
#: Target weights are the observed shares to this power: 1 keeps the mixture, 0 makes it even.
TEMPER = 0.5
#: Tokens wanted, as a share of those there are.
BUDGET = 0.5
#: Sweeps end when no marginal share is further from its target; targets that contradict each other never get there.
TOLERANCE, MOST_SWEEPS = 1e-12, 400
#: Up to this many cells are raked in one task without any exchange, several sweeps a job; more are joined to their sums.
CELLS_AT_ONCE, SWEEPS_AT_ONCE = 100_000, 8
#: Rates are rounded to this many decimals, so that the order of sums cannot decide about a document.
DECIMALS = 6


def tokens(text: Column) -> Column:
    """Words between white space; NULL has none.

    A word and the white space behind it become one character, so that no array of words is made.
    """
    start = F.regexp_replace(text, r"^[\x20\x09-\x0D]+", "")
    return F.coalesce(F.length(F.regexp_replace(start, r"[^\x20\x09-\x0D]+[\x20\x09-\x0D]*", "x")), F.lit(0)).cast("long")


def topic(text: Column) -> Column:
    """What a text is made of, by its characters: table, symbols, shouting, prose, or nothing."""
    size = F.length(text)
    count = lambda chars: F.length(F.regexp_replace(text, f"[^{chars}]+", ""))
    return (
        F.when(F.coalesce(size, F.lit(0)) == 0, "empty")
        .when(count("|") * 40 > size, "table")
        .when(count("#$%&*") * 20 > size, "symbols")
        .when(count("!A-Z") * 3 > size, "shouting")
        .otherwise("prose")
    )


def cells(docs: DataFrame) -> DataFrame:
    """(source, lang, topic, tokens): map-side combined, so no cell is gathered anywhere."""
    return docs.groupBy(*MARGINS).agg(F.sum("n_tokens").cast("double").alias("tokens")).filter("tokens > 0")


def tempered_targets(cell: DataFrame, margin: str, power: float = TEMPER) -> DataFrame:
    """(margin, target): observed shares to a power, scaled to sum to one."""
    shares = cell.groupBy(margin).agg(F.sum("tokens").alias("tokens")).withColumn("raised", F.pow("tokens", F.lit(power)))
    whole = shares.agg(F.sum("raised")).first()[0] or 1.0
    return shares.select(margin, (F.col("raised") / whole).alias("target"))


def _sweep(weights: DataFrame, margins: list[str], at_once: bool) -> DataFrame:
    """``weight`` scaled to every margin's goals in turn."""
    for margin in margins:
        if at_once:
            now = F.sum("weight").over(Window.partitionBy(margin))
            weights = weights.withColumn("now", now)
        else:  # a category may hold very many cells: they meet its sum, they are not gathered
            sums = weights.groupBy(margin).agg(F.sum("weight").alias("now"))
            weights = weights.join(sums.hint("shuffle_hash"), margin)
        scaled = F.when(F.col("now") > 0, F.col("weight") * F.col(f"goal_{margin}") / F.col("now")).otherwise(0.0)
        weights = weights.withColumn("weight", scaled).drop("now")
    return weights


def deviation(weights: DataFrame, margins: list[str]) -> float:
    """The largest distance of a marginal share from its goal."""
    off = 0.0
    for margin in margins:
        sums = weights.groupBy(margin).agg(F.abs(F.sum("weight") - F.first(f"goal_{margin}")).alias("off"))
        off = max(off, sums.agg(F.max("off")).first()[0] or 0.0)
    return off


def rake(cell: DataFrame, targets: dict[str, DataFrame], most: int = MOST_SWEEPS, tolerance: float = TOLERANCE) -> DataFrame:
    """``cell`` with ``weight``, whose marginals meet the targets (shares of one).

    ``targets`` has a table (margin, target) per margin; rows of one category
    add up. Categories of cells without a target have target 0; targets
    without a cell are left out, and the others of that margin are scaled up
    to one. Sweeps go on until every marginal is within ``tolerance``. Targets that cannot be
    met together (as when the only cell of a category has to be both large and
    small) end after ``most`` sweeps with a warning that says how far off they are; then
    the last margin is met and the others are not.
    """
    margins = list(targets)
    weights = cell.withColumn("weight", F.col("tokens"))
    for margin, wanted in targets.items():
        once = wanted.groupBy(margin).agg(F.sum("target").alias("target"))
        had = once.join(cell.select(margin).distinct(), margin, "left_semi")
        whole = had.agg(F.sum("target")).first()[0] or 1.0
        goal = had.select(margin, (F.col("target") / whole).alias(f"goal_{margin}"))
        weights = weights.join(goal, margin, "left")
    weights = stored(weights.na.fill(0.0, [f"goal_{m}" for m in margins]), "mix-goals")
    at_once = weights.limit(CELLS_AT_ONCE + 1).count() <= CELLS_AT_ONCE
    step, done, off = SWEEPS_AT_ONCE if at_once else 1, 0, 0.0
    while done < most:
        if at_once:
            weights = weights.coalesce(1)
        for _ in range(step):
            weights = _sweep(weights, margins, at_once)
        weights, done = stored(weights, f"mix-{done}"), done + step
        off = deviation(weights.coalesce(1) if at_once else weights, margins)
        if off <= tolerance:
            break
    else:
        warnings.warn(f"the targets are not met together: a marginal share is off by {off:.3g} after {done} sweeps", stacklevel=2)
    return weights.drop(*[f"goal_{m}" for m in margins])


def category(name: str) -> Column:
    """A category as it enters the cells; NULL is one of its own."""
    return F.coalesce(F.col(name).cast("string"), F.lit(NONE))


def prepared(docs: DataFrame, text: str = "text") -> DataFrame:
    return docs.select(
        "doc_id",
        category("source").alias("source"),
        category("lang").alias("lang"),
        topic(F.col(text)).alias("topic"),
        tokens(F.col(text)).alias("n_tokens"),
    )


def cell_rates(rows: DataFrame, targets: dict[str, DataFrame] | None, budget: float) -> DataFrame:
    """(source, lang, topic, rate) of every cell with tokens."""
    cell = stored(cells(rows), "mix-cells")
    weights = rake(cell, targets or {m: tempered_targets(cell, m) for m in MARGINS})
    whole = cell.agg(F.sum("tokens")).first()[0] or 0.0
    rate = F.round(F.col("weight") * (budget * whole) / F.col("tokens"), DECIMALS)
    return stored(weights.select(*MARGINS, rate.alias("rate")), "mix-rates")


def copies(rate: Column, doc_id: Column) -> Column:
    """The whole part of the rate, plus one with the probability of the rest."""
    return F.floor(rate) + (draw(doc_id) < rate - F.floor(rate)).cast("long")


def draw(doc_id: Column) -> Column:
    """A number in [0, 1) that depends on the id alone; NULL ids share one."""
    mark = F.md5(F.coalesce(doc_id.cast("string"), F.lit(NONE)).cast("binary"))
    return F.conv(F.substring(mark, 1, 8), 16, 10).cast("long") / F.lit(float(1 << 32))


def mix(
    docs: DataFrame,
    targets: dict[str, DataFrame] | None = None,
    budget: float = BUDGET,
    text: str = "text",
) -> DataFrame:
    """(doc_id, source, lang, topic, n_tokens, rate, copies) per row of ``docs``.

    ``rate`` is the expected number of copies in a sample of ``budget`` times
    all tokens whose shares meet the targets; ``copies`` is what was drawn: the
    whole part of the rate, plus one with the probability of the rest. Without ``targets`` the observed
    shares are tempered. Rows with equal ids get equal draws. Texts without tokens carry no
    weight and get rate 0. An empty table gives an empty table. Extra columns are not read.
    """
    rows = stored(prepared(docs, text), "mix-rows")
    rate = F.when(F.col("n_tokens") > 0, F.coalesce("rate", F.lit(0.0))).otherwise(0.0)
    return (
        rows.join(cell_rates(rows, targets, budget), list(MARGINS), "left")
        .withColumn("rate", rate)
        .select("doc_id", *MARGINS, "n_tokens", "rate", copies(F.col("rate"), F.col("doc_id")).alias("copies"))
    )


def sample(
    docs: DataFrame, targets: dict[str, DataFrame] | None = None, budget: float = BUDGET, text: str = "text"
) -> DataFrame:
    """Rows of ``docs`` that are drawn, all columns, with ``mix_rate`` and ``mix_copies`` (see ``mix``)."""
    kept = [c for c in docs.columns if c not in ("mix_rate", "mix_copies")]
    names = dict(zip((*MARGINS, "rate"), free_names(docs.columns, *[f"mix_{m}" for m in MARGINS], "cell_rate")))
    rates = cell_rates(prepared(docs, text), targets, budget).select(*[F.col(c).alias(n) for c, n in names.items()])
    cell = {"source": category("source"), "lang": category("lang"), "topic": topic(F.col(text))}
    rate = F.col(names["rate"])
    return (
        docs.filter(F.col(text).rlike(r"[^\x20\x09-\x0D]"))  # the others have no tokens
        .select("*", *[value.alias(names[m]) for m, value in cell.items()])
        .join(rates, [names[m] for m in MARGINS])
        .select(*kept, rate.alias("mix_rate"), copies(rate, F.col("doc_id")).alias("mix_copies"))
        .filter("mix_copies > 0")
    )


def op1_mixture(spark, sf_dir: str) -> DataFrame:
    """Rate and copies of all of ``documents`` for tempered source, language and topic shares."""
    return mix(table(spark, sf_dir, "documents"))


#: Sweeps of the SQL, which cannot look at the marginals: three times what the tempered targets need.
SQL_SWEEPS = 24


def _op1_sql(source: str = "documents") -> str:
    """The same raking, sweep by sweep, over the cells of a table."""
    parts = [f"""
row_ AS (
  SELECT doc_id, coalesce(source, '{NONE}') AS source, coalesce(lang, '{NONE}') AS lang,
    CASE WHEN coalesce(length(text), 0) = 0 THEN 'empty'
      WHEN (length(text) - length(translate(text, '|', ''))) * 40 > length(text) THEN 'table'
      WHEN (length(text) - length(translate(text, '#$%&*', ''))) * 20 > length(text) THEN 'symbols'
      WHEN (length(text) - length(translate(text, '!ABCDEFGHIJKLMNOPQRSTUVWXYZ', ''))) * 3 > length(text) THEN 'shouting'
      ELSE 'prose' END AS topic,
    coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0)::BIGINT AS n_tokens
  FROM {source}
)""", """
w0 AS MATERIALIZED (
  SELECT source, lang, topic, sum(n_tokens)::DOUBLE AS tokens, sum(n_tokens)::DOUBLE AS weight
  FROM row_ GROUP BY ALL HAVING sum(n_tokens) > 0
)"""]
    for m in MARGINS:
        parts.append(f"""
t_{m} AS MATERIALIZED (
  SELECT {m}, r / sum(r) OVER () AS target FROM (SELECT {m}, pow(sum(tokens), {TEMPER}) AS r FROM w0 GROUP BY {m})
)""")
    last = 0
    for _ in range(SQL_SWEEPS):
        for m in MARGINS:
            parts.append(f"""
w{last + 1} AS MATERIALIZED (
  SELECT source, lang, topic, tokens, weight * target / sum(weight) OVER (PARTITION BY {m}) AS weight
  FROM w{last} JOIN t_{m} USING ({m})
)""")
            last += 1
    parts.append(f"""
rates AS (
  SELECT source, lang, topic, round(weight * {BUDGET} * (SELECT sum(tokens) FROM w0) / tokens, {DECIMALS}) AS rate FROM w{last}
), rated AS (
  SELECT doc_id, source, lang, topic, n_tokens, CASE WHEN n_tokens > 0 THEN coalesce(rate, 0.0) ELSE 0.0 END AS rate
  FROM row_ LEFT JOIN rates USING (source, lang, topic)
)
SELECT doc_id, source, lang, topic, n_tokens, rate, (floor(rate) + CASE WHEN
  ('0x' || left(md5(coalesce(doc_id::VARCHAR, '{NONE}')), 8))::BIGINT / 4294967296.0 < rate - floor(rate) THEN 1 ELSE 0 END)::BIGINT AS copies
FROM rated""")
    return "WITH " + ",".join(parts)


OP1_SQL = _op1_sql()
