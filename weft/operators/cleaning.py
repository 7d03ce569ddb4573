"""The cleaning job: tagged rows to kept and rejected ones, reports and examples."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weft.operators.analysis import first_examples, reasons, rejections
from weft.operators.dedup import clean_three_keys, copies_problem
from weft.operators.sampling import shuffle_key
from weft.plans.scratch import cut


@dataclass(frozen=True)
class Cleaned:
    kept: DataFrame
    rejected: DataFrame
    overall: DataFrame
    by_lang: DataFrame
    by_reason: DataFrame
    examples: DataFrame


def clean(rows: DataFrame, *, id_col: str = "index", seed: int = 666, copies: bool = False, per_reason: int = 5) -> Cleaned:
    """Shuffle by a seed, drop rows whose seed, problem or solution was kept before, and report.

    rows have id_col, lang, seed, problem and solution; kept has their
    columns in shuffled order, rejected those and ``reason``. With copies,
    rows whose solution repeats a code block of the problem go too. examples
    has (file, text), the first ``per_reason`` rejected rows of every
    language and reason in the shuffled order.
    """
    own = rows.columns
    tagged = clean_three_keys(rows.withColumn("_ord", F.concat(shuffle_key(id_col, seed), F.lpad(F.col(id_col).cast("string"), 20, "0"))), "_ord")
    if copies:
        same = copies_problem("problem", "solution") & F.col("keep")
        tagged = tagged.withColumns({"reason": F.when(same, "copied code block").otherwise(F.col("reason")), "keep": F.col("keep") & ~same})
    tagged = cut(tagged)
    gone = tagged.where("not keep")
    text = F.concat(F.lit("[Seed]\n"), "seed", F.lit("\n\n[Problem]\n"), "problem", F.lit("\n\n[Solution]\n"), "solution")
    name = F.concat("lang", F.lit("-"), F.replace("reason", F.lit(" "), F.lit("_")), F.lit("-"), (F.col("example_no") - 1).cast("string"))
    examples = first_examples(gone, ["lang", "reason"], "_ord", per_reason).select(name.alias("file"), text.alias("text"))
    return Cleaned(tagged.where("keep").orderBy("_ord").select(*own), gone.select(*own, "reason"), rejections(tagged), rejections(tagged, "lang"), reasons(tagged, "lang"), examples)


def write_examples(examples: DataFrame, path: str) -> None:
    """A folder for each example with its text in one file."""
    examples.repartition("file").write.mode("errorifexists").option("lineSep", "\n").partitionBy("file").text(path)
