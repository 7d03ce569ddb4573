"""Line deduplication across documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weft.llm._text import col, whole_row
from weft.plans.scratch import cut

#: A line in more documents than this is boilerplate.
MOST = 10
#: Shared lines that go to every task, 16 bytes each.
BROADCAST = 1_000_000


def normal(line: Column) -> Column:
    return F.lower(F.trim(F.regexp_replace(line, "[ \t\r]+", " ")))


def _hashes(text: Column) -> Column:
    """Hash of each normalised line, by position; null for blank ones."""
    norm = F.transform(F.split(text, "\n"), normal)
    return F.transform(norm, lambda x: F.when(x != "", F.xxhash64(x)))


def dedup_lines(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", most: int = MOST, keep_first: bool = True) -> DataFrame:
    """Drop the lines that over ``most`` documents share.

    Lines are compared by a hash of their lower-case form with runs of
    blanks as one. Documents are counted by distinct id, so a line that a
    document repeats, or a row that repeats, counts once. With keep_first
    the document with the least id keeps such a line, wherever it stands.
    Blank lines are neither counted nor dropped; what stays is joined again
    by position, and a text that loses nothing is as it was.

    Result: the columns of docs, whatever they are called, with the new
    text, then n_lines and n_dropped (columns of docs that are called so are
    replaced). A null text stays null with no lines; a row with a null id
    isn't counted and keeps all its lines. A document that loses every line
    has an empty text. The longest texts are taken whole, in time that grows
    with their lines; rows with one id and different texts keep theirs
    apart; there are no ties but of ids, and an empty table gives an empty
    one.

    Texts are cut into lines once, and the hashes kept in the shared folder.
    The shared hashes go to every task while they are few (BROADCAST), else
    they meet the lines in a shuffle.
    """
    base = docs.select(*[col(c) for c in docs.columns if c.lower() not in ("n_lines", "n_dropped")])
    text = base.select(whole_row(base).alias("row"), col(id_col).alias("id"), F.xxhash64(col(text_col)).alias("print"), col(text_col).alias("text"))
    line = cut(text.where("id is not null").select("id", "print", F.posexplode(_hashes(F.col("text"))).alias("pos", "h")).where("h is not null"))
    over = cut(line.groupBy("h", "id").agg(F.lit(1).alias("x")).groupBy("h").agg(F.count("*").alias("n"), F.min("id").alias("first")).where(F.col("n") > most).drop("n"))
    hit = line.join(F.broadcast(over) if over.count() <= BROADCAST else over, "h")
    if keep_first:
        hit = hit.where("id <> first")
    gone = hit.groupBy("id", "print").agg(F.collect_set("pos").alias("gone"))

    def stay(lines: Column) -> Column:
        at = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), F.col("gone"))
        return F.struct(F.array_join(F.transform(at, lambda p: F.get(lines, p)), "\n").alias("text"), (F.size(lines) - F.size(at)).alias("dropped"))

    own = F.get(F.transform(F.array(F.split("text", "\n")), stay), F.lit(0))
    joined = text.join(gone, ["id", "print"], "left").withColumn("new", F.when(F.col("gone").isNotNull(), own))
    n_lines = F.when(F.col("text").isNull(), 0).otherwise(F.size(F.split("text", "\n")))
    new_text = F.coalesce("new.text", "text")
    return joined.select(*[new_text.alias(c) if c == text_col else F.col("row").getField(c).alias(c) for c in base.columns], n_lines.alias("n_lines"), F.coalesce("new.dropped", F.lit(0)).alias("n_dropped"))


SQL = f"""
WITH l AS (
  SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS pos FROM documents
), k AS (
  SELECT *, lower(trim(regexp_replace(line, '[ \\t\\r]+', ' ', 'g'))) AS norm FROM l
), o AS (
  SELECT norm, min(doc_id) AS first FROM k WHERE norm <> '' GROUP BY norm HAVING count(DISTINCT doc_id) > {MOST}
), j AS (
  SELECT k.*, o.first IS NULL OR o.first = k.doc_id AS keep FROM k LEFT JOIN o ON k.norm = o.norm
), r AS (
  SELECT doc_id, coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE keep), '') AS text,
         count(*)::INTEGER AS n_lines, count(*) FILTER (WHERE NOT keep)::INTEGER AS n_dropped
  FROM j GROUP BY doc_id
)
SELECT r.*, d.lang, d.source, d.n_chars FROM r JOIN documents d ON d.doc_id = r.doc_id
"""
