"""Mixing sources to target weights that vary over the training run."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weft.llm._text import col, row_hash, unpack, whole_row
from weft.plans.scratch import cut

#: Knots of the curriculum: at each time every source weighs as its share of the tokens to this power.
KNOTS = ((0.0, 1.0), (1.0, 0.7))
SEED = 17
_SLACK = 1 - 1e-12


def order_key(id_col: Column, other: Column, seed: int) -> Column:
    """The place of a document in its source; ``other`` stands for a null id."""
    return F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(id_col.cast("string"), F.concat(F.lit("\0"), other.cast("string")))))


def _schedule(totals: dict[str, int], knots: tuple[tuple[float, float], ...], weights: dict[str, list[float]] | None) -> list[tuple[str, list[tuple[float, float, float, float]]]]:
    """(source, segments): segments are (time, weight, slope, integral so far), weights sum to 1 at every time."""
    tokens = sum(totals.values()) or 1
    at = [t for t, _ in knots]
    raw = {s: [weights[s][k] if weights else (n / tokens) ** p if n else 0.0 for k, (_, p) in enumerate(knots)] for s, n in totals.items()}
    whole = [sum(raw[s][k] for s in raw) or 1.0 for k in range(len(at))]
    out = []
    for s in raw:
        w = [raw[s][k] / whole[k] for k in range(len(at))]
        done, own = 0.0, []
        for k in range(len(at) - 1):
            span = at[k + 1] - at[k]
            own.append((at[k], w[k], (w[k + 1] - w[k]) / span, done))
            done += span * (w[k] + w[k + 1]) / 2
        own.append((at[-1], w[-1], 0.0, done))
        out.append((s, own))
    return out


def mix_sources(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", knots: tuple[tuple[float, float], ...] = KNOTS, weights: dict[str, list[float]] | None = None, budget: float | None = None, seed: int = SEED) -> DataFrame:
    """Give each document its positions in a run whose source weights follow a schedule, and sort by position.

    Time runs from 0 to 1. At the knots the weights are the sources' token
    shares to the knot's power, or ``weights[source][knot]``, normalised to
    sum 1; between knots they are linear. A source's integrated weight times
    ``budget`` (tokens in the run) is what it must have delivered by a time;
    its documents, in the order of a seeded hash, are delivered one after
    another, and a document's position is the time at which its first token
    is due. A source goes round again (epoch 1, 2, ...) while tokens are due,
    and stops where none are. By default the budget is the least with which
    every document is used at least once.

    Result: the columns of docs, whatever they are called, then n_tokens,
    epoch and position (columns of docs called so are replaced), sorted by
    position; ties go by the hash, the id and the epoch. Tokens are runs of
    other than blanks, the longest texts are counted whole. A null text, an
    empty one or one of blanks has no tokens and is placed with the document
    that follows it; a null source is a source of its own; rows with the
    same id, null ids and rows that repeat are documents each. A source that
    has no tokens at all comes at time 0, once. An empty table gives an
    empty one. The number of sources has to fit in the driver's memory; a
    source's documents are numbered in 65536 ranges of the hash, so no
    source is one task's work.
    """
    base = docs.select(*[col(c) for c in docs.columns if c.lower() not in ("n_tokens", "epoch", "position")])
    tok = base.select(
        whole_row(base).alias("row"),
        row_hash(base).alias("other"),
        col(id_col).alias("id"),
        F.coalesce(F.regexp_count(col(text_col), F.lit("[^ \t\r\n\f]+")), F.lit(0)).alias("n_tokens"),
        F.coalesce(col(source_col).cast("string"), F.lit("\0none")).alias("src"),
    ).withColumn("key", order_key(F.col("id"), F.col("other"), seed)).withColumn("part", F.substring("key", 1, 4))
    sums = tok.groupBy("src", "part").agg(F.sum("n_tokens").alias("own"))
    before = Window.partitionBy("src").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    ahead = cut(sums.select("src", "part", F.coalesce(F.sum("own").over(before), F.lit(0)).alias("ahead"), F.sum("own").over(Window.partitionBy("src")).alias("all")))
    totals = {r["src"]: r["n"] for r in ahead.groupBy("src").agg(F.max("all").alias("n")).collect()}
    plan = _schedule(dict(sorted(totals.items())), knots, weights)
    every_one = budget is None
    if every_one:
        budget = max((totals[s] / own[-1][3] for s, own in plan if totals[s] and own[-1][3] > 0), default=0.0)
    table = docs.sparkSession.createDataFrame([(s, own) for s, own in plan], "src string, segments array<struct<t:double,w:double,slope:double,done:double>>")
    order = Window.partitionBy("src", "part").orderBy("key", "id", "other")
    local = F.sum("n_tokens").over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("n_tokens")
    placed = tok.withColumn("local", local).join(ahead, ["src", "part"]).join(table, "src")
    due = F.element_at("segments", -1)["done"] * F.lit(float(budget)) * F.lit(_SLACK)
    begin = (F.col("ahead") + F.col("local")).cast("double")
    rounds = F.when(F.col("all") == 0, F.lit(1)).otherwise(F.ceil((due - begin) / F.col("all"))).cast("int")
    if every_one:  # one without tokens at the end of the source that sets the budget begins where all is delivered
        rounds = F.when(F.col("n_tokens") == 0, F.greatest(rounds, F.lit(1))).otherwise(rounds)
    every = placed.withColumns({"begin": begin, "rounds": rounds}).where("rounds > 0").withColumn("epoch", F.explode(F.sequence(F.lit(0), F.col("rounds") - 1)))
    y = (F.col("begin") + F.col("epoch") * F.col("all")) / F.lit(float(budget) or 1.0)
    seg = F.element_at(F.filter("segments", lambda s: s["done"] <= F.col("y")), -1)
    rest = F.col("y") - F.col("s.done")
    root = F.col("s.w") + F.sqrt(F.greatest(F.lit(0.0), F.col("s.w") * F.col("s.w") + 2 * F.col("s.slope") * rest))
    at = F.when((rest <= 0) | (root <= 0), F.col("s.t")).otherwise(F.col("s.t") + 2 * rest / root)
    done = every.withColumn("y", y).withColumn("s", seg).withColumn("position", F.round(F.least(F.lit(1.0), at), 9))
    return done.orderBy("position", "key", "id", "epoch").select(*unpack("row", base.columns), "n_tokens", "epoch", "position")


SQL = f"""
WITH t AS (
  SELECT *, len(regexp_extract_all(text, '[^ \\t\\r\\n\\f]+'))::INTEGER AS n_tokens, md5('{SEED}:' || doc_id) AS k FROM documents
), c AS (
  SELECT *, sum(n_tokens) OVER (PARTITION BY source ORDER BY k, doc_id ROWS UNBOUNDED PRECEDING) - n_tokens AS before,
         sum(n_tokens) OVER (PARTITION BY source) AS n_all FROM t
), s AS (SELECT source, sum(n_tokens)::DOUBLE AS n FROM t GROUP BY source),
w AS (
  SELECT source, n, n / sum(n) OVER () AS a, pow(n / sum(n) OVER (), {KNOTS[1][1]}) AS raw FROM s
), v AS (SELECT source, n, a, raw / sum(raw) OVER () AS b FROM w),
d AS (SELECT *, (a + b) / 2 AS d, max(n / ((a + b) / 2)) OVER () AS budget FROM v),
e AS (
  SELECT c.*, d.a, d.b, d.budget, unnest(range(greatest(0, ceil((d.d * d.budget * (1 - 1e-12) - before) / n_all))::BIGINT)) AS epoch
  FROM c JOIN d ON c.source = d.source
), y AS (SELECT *, (before + epoch * n_all) / budget AS y FROM e)
SELECT doc_id, text, lang, source, n_chars, n_tokens, epoch::INTEGER AS epoch,
       round(least(1.0, CASE WHEN y <= 0 THEN 0.0 ELSE 2 * y / (a + sqrt(greatest(0.0, a * a + 2 * (b - a) * y))) END), 9) AS position
FROM y
"""
