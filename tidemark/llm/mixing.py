"""Mixing sources to target weights.

Words are summed per source, a target per source gives its repetition rate, and each document is taken
``floor(rate)`` times plus once more if its own hash-seeded draw lies below the fraction.

Targets share ``share`` of all words by weight; none exceeds ``most`` times its source's words, and what
lies above is dealt again by weight until none does. That is a water level: ``min(weight * level, most *
words)``. The level is found by repeated sums over the table of sources; each round sends two numbers to
the driver. Sources are ranked by a distributed sort with the counts of its partitions as offsets.

Defined cases: a null source is a source of its own, ranked last; null and empty texts have no words and
are taken ``floor(rate)`` times or once more like others; rows that repeat an id but differ in text draw
apart, equal rows draw alike; a source without words has target 0 and rate 0; an empty table gives an
empty mix. Columns of the input may have any names: the plan is joined on its own names.
"""

from __future__ import annotations

from collections.abc import Sequence
from fractions import Fraction

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.base import WORD, column
from tidemark.llm.registry import query
from tidemark.session import cut_lineage

WEIGHTS = (5, 2, 1)
SHARE = Fraction(3, 2)
MOST = 2
SEED = "mix-1"
DIGITS = 13  # hex digits of a draw: 52 bits


def words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def draw(id_: Column, text: Column, seed: str) -> Column:
    """A number in [0, 1) that depends on the row and the seed alone."""
    name = F.concat(F.lit(seed + ":"), F.coalesce(id_.cast("string"), F.lit("-")), F.lit(":"), F.coalesce(text, F.lit("")))
    return F.conv(F.substring(F.md5(name), 1, DIGITS), 16, 10).cast("double") / F.lit(float(16**DIGITS))


def ranked(df: DataFrame, order: str) -> DataFrame:
    """``df`` with ``rank`` from 0 along ``order``, nulls last, without gathering the rows in one task."""
    low = (1 << 33) - 1
    placed = cut_lineage(
        df.orderBy(F.col(order).asc_nulls_last()).withColumn("m_place", F.monotonically_increasing_id())
    )
    part, inside = F.shiftright("m_place", 33), F.col("m_place").bitwiseAND(F.lit(low))
    # One row per partition of the sort, however many rows there are.
    offsets = placed.groupBy(part.alias("m_part")).agg(F.count("*").alias("m_n"))
    before = Window.orderBy("m_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = offsets.select("m_part", F.coalesce(F.sum("m_n").over(before), F.lit(0)).alias("m_before"))
    return (
        placed.withColumn("m_part", part).join(offsets, "m_part")
        .withColumn("rank", (F.col("m_before") + inside).cast("long")).drop("m_part", "m_before", "m_place")
    )


def targets(
    sources: DataFrame, weights: Sequence[int] = WEIGHTS, share: Fraction = SHARE, most: int = MOST,
) -> DataFrame:
    """(source, source_size, weight, target) from (source, source_size)."""
    turn = F.array(*[F.lit(int(w)) for w in weights])
    weighed = ranked(sources, "source").withColumn(
        "weight", F.element_at(turn, (F.col("rank") % len(weights) + 1).cast("int")).cast("long")
    )
    weighed = cut_lineage(weighed)
    total = weighed.agg(F.sum("source_size")).first()[0] or 0
    if Fraction(share) > most:
        share = Fraction(most)
    top, below = Fraction(share).numerator, Fraction(share).denominator
    # level = (top * total - below * most * words of full sources) / (below * weight of the others)
    full = F.lit(False)
    over, under = 0, 1
    while total:
        got = weighed.agg(
            F.sum(F.when(full, F.col("source_size"))).alias("s"), F.sum(F.when(~full, F.col("weight"))).alias("w")
        ).first()
        spent, left = got["s"] or 0, got["w"] or 0
        if not left:
            break
        now = (top * total - below * most * spent, below * left)
        if now == (over, under):
            break
        over, under = now
        full = F.col("weight").cast("decimal(38,0)") * over > F.col("source_size").cast("decimal(38,0)") * most * under
    target = F.when(full, F.col("source_size").cast("double") * most).otherwise(
        (F.col("weight") * F.lit(over)).cast("double") / F.lit(float(under))
    )
    return weighed.select("source", "source_size", "weight", target.alias("target"))


def mix_plan(
    df: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
    weights: Sequence[int] = WEIGHTS, share: Fraction = SHARE, most: int = MOST, seed: str = SEED,
    keep: Sequence[str] = (),
) -> DataFrame:
    """One row per document: m_id, m_source, m_size, m_source_size, m_target, m_copies, and ``keep``."""
    text = column(text_col)
    sized = df.select(
        column(id_col).alias("m_id"), column(source_col).cast("string").alias("m_source"),
        words(text).alias("m_size"), draw(column(id_col), text, seed).alias("m_draw"),
        *[column(c).alias(f"m_keep{i}") for i, c in enumerate(keep)],
    )
    if not keep:
        sized = cut_lineage(sized)  # a few bytes a document, read twice
    sources = sized.groupBy(F.col("m_source").alias("source")).agg(F.sum("m_size").alias("source_size"))
    rates = targets(sources, weights, share, most).withColumn(
        "rate", F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    )
    # Joined on a key without nulls, so that a hot source is split like any skewed join.
    rates = rates.withColumn("m_key", F.concat_ws("", F.lit("s"), "source")).withColumn("m_key", F.when(F.col("source").isNull(), "-").otherwise(F.col("m_key")))
    sized = sized.withColumn("m_key", F.when(F.col("m_source").isNull(), "-").otherwise(F.concat(F.lit("s"), "m_source")))
    copies = F.floor("rate") + (F.col("m_draw") < F.col("rate") - F.floor("rate")).cast("long")
    return sized.join(rates, "m_key").select(
        "m_id", "m_source", "m_size", F.col("source_size").alias("m_source_size"),
        F.col("target").alias("m_target"), copies.cast("long").alias("m_copies"),
        *[f"m_keep{i}" for i in range(len(keep))],
    )


def mix(df: DataFrame, **how) -> DataFrame:
    """The mixed corpus: every row of ``df`` as often as its plan says, columns unchanged."""
    plan = mix_plan(df, keep=df.columns, **how)
    rows = plan.where("m_copies > 0").withColumn("m_turn", F.explode(F.sequence(F.lit(1), F.col("m_copies").cast("int"))))
    return rows.select(*[F.col(f"m_keep{i}").alias(c) for i, c in enumerate(df.columns)])


@query(
    "op1_mixing",
    r"""
    WITH sized AS (
      SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size,
        CAST('0x' || substr(md5('mix-1:' || coalesce(CAST(doc_id AS VARCHAR), '-') || ':' || coalesce(text, '')), 1, 13) AS BIGINT)
          / 4503599627370496.0 AS draw
      FROM documents
    ), sums AS (
      SELECT source, CAST(sum(size) AS BIGINT) AS words,
        CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS weight
      FROM sized GROUP BY source
    ), filled AS (
      SELECT *, CAST(sum(words) OVER () AS BIGINT) AS total,
        CAST(coalesce(sum(words) OVER w, 0) AS BIGINT) AS spent,
        CAST(sum(weight) OVER () - coalesce(sum(weight) OVER w, 0) AS BIGINT) AS rest
      FROM sums
      WINDOW w AS (ORDER BY CAST(words AS DOUBLE) / weight, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
    ), level AS (
      SELECT 3 * total - 4 * spent AS over, 2 * rest AS under FROM filled
      WHERE weight * (3 * total - 4 * spent) <= 2 * words * (2 * rest)
      ORDER BY spent, rest DESC LIMIT 1
    ), aims AS (
      SELECT source, words, CASE WHEN weight * over > 2 * words * under THEN CAST(2 * words AS DOUBLE)
        ELSE CAST(weight * over AS DOUBLE) / CAST(under AS DOUBLE) END AS target
      FROM sums, level
    ), rated AS (
      SELECT doc_id, size, words, target, draw, CASE WHEN words > 0 THEN target / CAST(words AS DOUBLE) ELSE 0 END AS rate
      FROM sized JOIN aims ON sized.source IS NOT DISTINCT FROM aims.source
    )
    SELECT doc_id, CAST(size AS BIGINT) AS size, words AS source_size, target,
      CAST(size * (floor(rate) + CASE WHEN draw < rate - floor(rate) THEN 1 ELSE 0 END) AS BIGINT) AS taken
    FROM rated
    """,
)
def mixing(t):
    plan = mix_plan(t.documents)
    return plan.select(
        F.col("m_id").alias("doc_id"), F.col("m_size").alias("size"), F.col("m_source_size").alias("source_size"),
        F.col("m_target").alias("target"), (F.col("m_size") * F.col("m_copies")).alias("taken"),
    )
