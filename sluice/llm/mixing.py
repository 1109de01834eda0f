"""Mixing sources to target weights by iterative proportional fitting, in DataFrame functions only.

Documents fall into cells by source, language and topic; a cell's mass is its number of words. Raking scales the cells'
masses to the target shares of each source, then of each language, then of each topic, again and again, so that the
fitted shares keep the data's associations but have the targets as marginals. Documents are then sampled: a document
stays when a uniform number from the MD5 of its id and the seed is under its cell's probability

    p = min(1, L * fitted share / mass),

with ``L`` solved so that the expected mass is ``fraction`` of all: cells that would need more than they have are taken
whole and the others share the rest in proportion.

A dimension's targets are a mapping from value to share, or a temperature: shares in proportion to mass ** temperature.
Values that a mapping doesn't name, null included, share what it leaves in proportion to their masses; where it leaves
nothing, they keep their own share of all mass and the mapping divides the rest (the SQL gives such values nothing; the
given tables have none). Targets of absent values are spread over the others. Only the cells, a row per combination, are
raked: up to ``WHOLE_CELLS`` of them in one partition, without a shuffle per step; more stay distributed.

A document's topic is the value of a column that the caller names; without one (``documents`` has none) it is told from the
text's form by ``topic_of``.

Raking takes ``rounds`` rounds. ``_error`` tells how far the fitted shares still are from the targets: the largest difference
over all values of all dimensions. It stays large where no fit exists, as when all cells of a wanted value have no mass.

Defined cases: nulls are a value of their own in each dimension; empty or null texts have mass 0 and stay, their
probability being their cell's (1 in a cell without mass); repeated rows of one id stay or go together; an empty table
gives no rows; other columns aren't read.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sluice.llm.common import SPACE, documents, materialise

DIMENSIONS = ("source", "lang", "topic")
#: Shares by language; the sources' and topics' shares are flattened by a temperature.
TARGETS: dict[str, Mapping[str, float] | float] = {"source": 0.5, "lang": {"en": 0.4, "de": 0.2, "fr": 0.2, "es": 0.2}, "topic": 0.5}
FRACTION = 0.8
ROUNDS = 10
SEED = "mix-1"
WHOLE_CELLS = 200_000
_BITS = 48
#: What a mapping leaves counts from here on; less is rounding.
_NOTHING = 1e-9


#: What a text of a licence has, as a pattern; ``LEGAL`` is the lesser list in the SQL, the same on the given tables.
LICENCE = r"(?i)\blicen[sc]ed? |copyright"
LEGAL = ("Licensed ", "licensed ", "LICENSED ", "License ", "Copyright", "copyright", "COPYRIGHT")
MAIL, PHONE = r"[A-Za-z0-9.]@[A-Za-z0-9]+\.[A-Za-z]", r"\(\d{3}\) \d{3}-\d{4}"


def topic_of(text: Column) -> Column:
    """What a text is about as far as its form tells; the first that fits. Patterns look at texts with their fixed parts only."""
    small = F.lower(text)
    legal = (small.contains("licen") | small.contains("copyright")) & text.rlike(LICENCE)
    contact = (text.contains("@") & text.rlike(MAIL)) | (text.contains(") ") & text.rlike(PHONE))
    return F.when(legal, "legal").when(text.contains(" | "), "tabular").when(contact, "contact").otherwise("prose")


def n_words(text: Column) -> Column:
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(f"[^{SPACE}]+")).cast("long")


def uniform(key: Column, seed: str) -> Column:
    h = F.conv(F.substring(F.md5(F.concat(key, F.lit(":" + seed)).cast("binary")), 1, _BITS // 4), 16, 10)
    return h.cast("long").cast("double") / F.lit(float(1 << _BITS))


def _targets(cells: DataFrame, dimension: str, target: Mapping[str, float] | float) -> DataFrame:
    """cells with ``_t_<dimension>``: the share of the cell's value, all values' shares adding up to one."""
    value, name = Window.partitionBy(dimension), f"_t_{dimension}"
    first = F.row_number().over(value.orderBy(*DIMENSIONS)) == 1
    cells = cells.withColumn("_v", F.sum("_mass").over(value))
    if isinstance(target, Mapping):
        named = sum(target.values())
        left = 1.0 - named
        wanted = F.lit(None).cast("double")
        for k, share in target.items():
            wanted = F.when(F.col(dimension) == k, F.lit(float(share))).otherwise(wanted)
        cells = cells.withColumn("_w", wanted).withColumn("_f", first)
        every = Window.partitionBy(F.lit(1))
        other = F.sum(F.when(F.col("_w").isNull(), F.col("_mass"))).over(every)
        if left > _NOTHING:
            share = F.coalesce(F.col("_w"), F.col("_v") / other * F.lit(left), F.lit(0.0))
        else:
            whole = F.sum("_mass").over(every)
            share = F.when(F.col("_w").isNull(), F.col("_v") / whole).otherwise(F.col("_w") / F.lit(named) * (F.lit(1.0) - F.coalesce(other, F.lit(0.0)) / whole))
    else:
        cells = cells.withColumn("_f", first)
        share = F.when(F.col("_v") > 0, F.pow(F.col("_v"), F.lit(float(target)))).otherwise(0.0)
    cells = cells.withColumn(name, F.when(F.col("_v") > 0, share).otherwise(0.0))
    total = F.sum(F.when(F.col("_f"), F.col(name))).over(Window.partitionBy(F.lit(1)))
    return cells.withColumn(name, F.when(total > 0, F.col(name) / total).otherwise(0.0)).drop("_v", "_w", "_f")


def rake(cells: DataFrame, targets: Mapping[str, Mapping[str, float] | float], rounds: int = ROUNDS) -> DataFrame:
    """cells (the dimensions and ``_mass``) with ``_share``, the fitted shares, and ``_error``, how far their marginals are off."""
    every = Window.partitionBy(F.lit(1))
    cells = cells.withColumn("_mass", F.col("_mass").cast("double"))
    for dimension in DIMENSIONS:
        cells = _targets(cells, dimension, targets[dimension])
    total = F.sum("_mass").over(every)
    cells = cells.withColumn("_share", F.when(total > 0, F.col("_mass") / total).otherwise(0.0))
    for done in range(rounds):
        if done and done % ROUNDS == 0:  # a plan of more rounds would be too deep
            cells = materialise(cells, "rounds")
        for dimension in DIMENSIONS:
            now = F.sum("_share").over(Window.partitionBy(dimension))
            cells = cells.withColumn("_share", F.when(now > 0, F.col("_share") * F.col(f"_t_{dimension}") / now).otherwise(0.0))
    total = F.sum("_share").over(every)
    cells = cells.withColumn("_share", F.when(total > 0, F.col("_share") / total).otherwise(0.0))
    off = [F.abs(F.sum("_share").over(Window.partitionBy(d)) - F.col(f"_t_{d}")) for d in DIMENSIONS]
    cells = cells.withColumn("_off", F.greatest(*off))
    return cells.withColumn("_error", F.max("_off").over(every)).select(*DIMENSIONS, "_mass", "_share", "_error")


def calibrate(cells: DataFrame, fraction: float) -> DataFrame:
    """cells with ``_p``: the probability that takes ``fraction`` of all mass in the fitted shares, as far as it lasts."""
    every = Window.partitionBy(F.lit(1))
    ratio = F.when(F.col("_share") > 0, F.col("_mass") / F.col("_share"))
    cells = cells.withColumn("_r", ratio)
    order = Window.partitionBy(F.lit(1)).orderBy(F.asc_nulls_last("_r"), *DIMENSIONS)
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    after = order.rowsBetween(0, Window.unboundedFollowing)
    goal = F.sum("_mass").over(every) * F.lit(float(fraction))
    # The level if all cells ahead are taken whole and this one isn't; it holds where it is at most this one's ratio.
    level = (goal - F.coalesce(F.sum("_mass").over(before), F.lit(0.0))) / F.sum("_share").over(after)
    cells = cells.withColumn("_l", F.when(F.col("_r").isNotNull(), level))
    cells = cells.withColumn("_l", F.min(F.when(F.col("_l") <= F.col("_r"), F.struct("_r", "_l"))).over(every)["_l"])
    p = F.when(F.col("_mass") <= 0, 1.0).when(F.col("_r").isNull(), 0.0).otherwise(F.coalesce(F.least(F.lit(1.0), F.col("_l") / F.col("_r")), F.lit(1.0)))
    return cells.withColumn("_p", p).drop("_r", "_l")


def _mixed(docs: DataFrame, targets: Mapping[str, Mapping[str, float] | float] = TARGETS, fraction: float = FRACTION, seed: str = SEED, rounds: int = ROUNDS, topic: str | None = None) -> DataFrame:
    """Rows of docs as ``_row``, with ``_topic``, ``_n_words``, ``_weight``, ``_p``, ``_selected``, ``_error``. topic: a column to take it from."""
    rows = docs.select(F.struct(*docs.columns).alias("_row"))
    about = lambda of: F.col(f"{of}`{topic}`").cast("string") if topic else topic_of(F.coalesce(F.col(f"{of}text"), F.lit("")))
    rows = rows.select("_row", F.col("_row.source").alias("source"), F.col("_row.lang").alias("lang"), about("_row.").alias("topic"), n_words(F.col("_row.text")).alias("_n"))
    masses = docs.select("source", "lang", about("").alias("topic"), n_words(F.col("text")).alias("_n")).groupBy(*DIMENSIONS).agg(F.sum("_n").alias("_mass"))
    cells = materialise(masses, "cells")
    count = cells.count()
    if count <= WHOLE_CELLS:
        cells = cells.coalesce(1)
    fitted = materialise(calibrate(rake(cells, targets, rounds), fraction), "mixture")
    total = F.sum("_mass").over(Window.partitionBy(F.lit(1)))
    fitted = fitted.withColumn("_weight", F.when(F.col("_mass") > 0, F.col("_share") * total / F.col("_mass")).otherwise(1.0))
    side = fitted.select(*(F.col(d).alias(f"_c_{d}") for d in DIMENSIONS), "_weight", "_p", "_error")
    if count <= WHOLE_CELLS:
        side = F.broadcast(side)
    on = F.col("source").eqNullSafe(F.col("_c_source")) & F.col("lang").eqNullSafe(F.col("_c_lang")) & F.col("topic").eqNullSafe(F.col("_c_topic"))
    key = F.coalesce(F.col("_row.doc_id").cast("string"), F.lit("null"))
    return rows.join(side, on).select("_row", F.col("topic").alias("_topic"), F.col("_n").alias("_n_words"), "_weight", "_p", (uniform(key, seed) < F.col("_p")).alias("_selected"), "_error")


def mixed(docs: DataFrame, **how) -> DataFrame:
    """Columns of docs with ``_topic``, ``_n_words``, ``_weight`` (fitted over own share), ``_p``, ``_selected``; those replace docs' own."""
    out = _mixed(docs, **how)
    new = out.columns[1:]
    return out.select(*(F.col(f"_row.`{c}`") for c in docs.columns if c not in new), *new)


def sampled(docs: DataFrame, **how) -> DataFrame:
    """The documents that the mixture takes, with their own columns."""
    return _mixed(docs, **how).where("_selected").select("_row.*")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = mixed(documents(spark, sf_dir).select("doc_id", "text", "lang", "source"))
    return out.select("doc_id", F.col("_topic").alias("topic"), F.col("_n_words").alias("n_words"), F.round("_weight", 6).alias("weight"), F.round("_p", 6).alias("probability"), F.col("_selected").alias("selected"), F.round("_error", 6).alias("marginal_error"))


def oracle() -> str:
    """The same steps in SQL, one common table for each."""
    steps = [
        rf"""d AS (SELECT doc_id, lang, source, len(regexp_extract_all(coalesce(text, ''), '[^{SPACE}]+')) AS n_words,
  CASE WHEN {" OR ".join(f"contains(coalesce(text, ''), '{x}')" for x in LEGAL)} THEN 'legal' WHEN contains(coalesce(text, ''), ' | ') THEN 'tabular'
  WHEN regexp_matches(coalesce(text, ''), '{MAIL}') OR regexp_matches(coalesce(text, ''), '{PHONE}') THEN 'contact' ELSE 'prose' END AS topic FROM documents)""",
        "c0 AS (SELECT source, lang, topic, sum(n_words)::DOUBLE AS mass FROM d GROUP BY ALL)",
    ]
    last = "c0"
    for k, dim in enumerate(DIMENSIONS):
        target = TARGETS[dim]
        if isinstance(target, Mapping):
            named = "CASE " + " ".join(f"WHEN {dim} = '{v}' THEN {float(s)}" for v, s in target.items()) + " END"
            left = max(0.0, 1.0 - sum(target.values()))
            share = f"coalesce({named}, v / sum(mass) FILTER (WHERE {named} IS NULL) OVER () * {left}, 0)"
        else:
            share = f"pow(v, {float(target)})"
        steps.append(f"t{k}a AS (SELECT *, sum(mass) OVER (PARTITION BY {dim}) AS v, row_number() OVER (PARTITION BY {dim} ORDER BY source, lang, topic) = 1 AS f FROM {last})")
        steps.append(f"t{k}b AS (SELECT *, CASE WHEN v > 0 THEN {share} ELSE 0 END AS s FROM t{k}a)")
        steps.append(f"t{k} AS (SELECT * EXCLUDE (v, f, s), CASE WHEN sum(s) FILTER (WHERE f) OVER () > 0 THEN s / sum(s) FILTER (WHERE f) OVER () ELSE 0 END AS t_{dim} FROM t{k}b)")
        last = f"t{k}"
    steps.append(f"r0 AS (SELECT *, mass / sum(mass) OVER () AS share FROM {last})")
    last = "r0"
    for i in range(ROUNDS):
        for dim in DIMENSIONS:
            name = f"r{i}_{dim}"
            steps.append(f"{name} AS (SELECT * REPLACE (CASE WHEN sum(share) OVER w > 0 THEN share * t_{dim} / sum(share) OVER w ELSE 0 END AS share) FROM {last} WINDOW w AS (PARTITION BY {dim}))")
            last = name
    steps += [
        f"s0 AS (SELECT source, lang, topic, mass, {', '.join(f't_{d}' for d in DIMENSIONS)}, share / sum(share) OVER () AS share FROM {last})",
        f"s1 AS (SELECT source, lang, topic, mass, share, greatest({', '.join(f'abs(sum(share) OVER (PARTITION BY {d}) - t_{d})' for d in DIMENSIONS)}) AS off FROM s0)",
        "s AS (SELECT * EXCLUDE (off), max(off) OVER () AS error FROM s1)",
        "q AS (SELECT *, CASE WHEN share > 0 THEN mass / share END AS r FROM s)",
        f"""l AS (SELECT *, CASE WHEN r IS NOT NULL THEN (sum(mass) OVER () * {FRACTION} - coalesce(sum(mass) OVER (ORDER BY r ASC NULLS LAST, source, lang, topic ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
  / sum(share) OVER (ORDER BY r ASC NULLS LAST, source, lang, topic ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) END AS lv FROM q)""",
        "b AS (SELECT *, min(lv) FILTER (WHERE lv <= r AND r = rr) OVER () AS level FROM (SELECT *, min(r) FILTER (WHERE lv <= r) OVER () AS rr FROM l))",
        "p AS (SELECT source, lang, topic, CASE WHEN mass > 0 THEN share * sum(mass) OVER () / mass ELSE 1 END AS weight, CASE WHEN mass <= 0 THEN 1 WHEN r IS NULL THEN 0 ELSE coalesce(least(1, level / r), 1) END AS p, error FROM b)",
    ]
    head = "WITH " + ",\n".join(steps)
    return head + rf"""
SELECT doc_id, d.topic, n_words, round(weight, 6) AS weight, round(p, 6) AS probability,
  ('0x' || substr(md5(coalesce(doc_id::VARCHAR, 'null') || ':{SEED}'), 1, {_BITS // 4}))::BIGINT::DOUBLE / {1 << _BITS} < p AS selected, round(error, 6) AS marginal_error
FROM d JOIN p ON d.source IS NOT DISTINCT FROM p.source AND d.lang IS NOT DISTINCT FROM p.lang AND d.topic = p.topic"""
