"""Token id arrays for supervised fine-tuning."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

IGNORE = -100


def tokenizer_udf(encode: Callable[[str], list[int]]):
    """An Arrow UDF from text to token ids around any tokenizer."""

    @F.pandas_udf("array<int>")
    def run(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: None if t is None else encode(t))

    return run


def code_points(text: Column) -> Column:
    """A tokenizer that needs no vocabulary: a token for each character."""
    return F.transform(F.filter(F.split(text, ""), lambda c: c != ""), lambda c: F.ascii(c))


def marked(ids: Column, bos: int | None = None, eos: int | None = None) -> Column:
    parts = [*([F.array(F.lit(bos))] if bos is not None else []), ids, *([F.array(F.lit(eos))] if eos is not None else [])]
    return F.concat(*parts)


def examples(df: DataFrame, prompt: Column, completion: Column, most: int) -> DataFrame:
    """df with input_ids, labels (IGNORE over the prompt) and exceeding_length, cut to ``most``."""
    ids = F.concat(prompt, completion)
    labels = F.concat(F.array_repeat(F.lit(IGNORE), F.size(prompt)), completion)
    return df.withColumns({"input_ids": F.slice(ids, 1, most), "labels": F.slice(labels, 1, most), "exceeding_length": F.size(ids) > most})


def pad(ids: Column, to: Column | int, value: int, side: str = "right") -> Column:
    size = F.lit(to) if isinstance(to, int) else to
    if side not in ("left", "right"):
        raise ValueError("a side is left or right")
    room = F.when(F.size(ids) > size, F.raise_error(F.lit("a row is longer than the padded length")).cast("int")).otherwise(size - F.size(ids))
    fill = F.array_repeat(F.lit(value), room)
    return F.concat(ids, fill) if side == "right" else F.concat(fill, ids)


def collate(df: DataFrame, batch_col: str, pad_id: int, to: int | None = None) -> DataFrame:
    """Pad the rows of each batch to its longest (or to a length), with the mask of what isn't padding."""
    width = F.lit(to) if to is not None else F.max(F.size("input_ids")).over(Window.partitionBy(batch_col))
    own = df.withColumn("_w", width)
    own = own.withColumns({"input_ids": pad(F.col("input_ids"), F.col("_w"), pad_id), "labels": pad(F.col("labels"), F.col("_w"), IGNORE)})
    return own.withColumn("attention_mask", F.transform("input_ids", lambda x: (x != pad_id).cast("int"))).drop("_w")


def budget(prompt_tokens: Column, context: int, most_new: int, slack: int = 10) -> Column:
    """Tokens left for an answer; rows with none should go."""
    return F.least(F.lit(most_new), F.lit(context) - prompt_tokens - slack)


def decoder_udf(decode: Callable[[list[int]], str], special: set[int] = frozenset()):
    """An Arrow UDF from token ids to text around any tokenizer; special ids are skipped."""

    @F.pandas_udf("string")
    def run(rows: pd.Series) -> pd.Series:
        return rows.map(lambda ids: None if ids is None else decode([int(i) for i in ids if i not in special]))

    return run


def text_of_code_points(ids: Column, special: tuple[int, ...] = (1, 2)) -> Column:
    """The text of code_points() ids, special ones skipped."""
    return F.array_join(F.transform(F.filter(ids, lambda x: ~x.isin(*special)), lambda x: F.decode(F.unhex(F.lpad(F.hex(x.cast("bigint")), 8, "0")), "UTF-32")), "")


#: (key, family, context) of the models that prompts and budgets are made for.
MODELS = (
    ("bigcode/starcoder", "star", 8192),
    ("WizardLM/WizardCoder-15B-V1.0", "star", 8192),
    *((f"WizardLM/WizardCoder-Python-{n}-V1.0", "llama", 16384) for n in ("7B", "13B", "34B")),
    *((f"codellama/CodeLlama-{n}-Python-hf", "llama", 16384) for n in ("7b", "13b", "34b")),
    *((f"deepseek-ai/deepseek-coder-{n}-base", "deepseek", 16384) for n in ("1.3b", "6.7b", "33b")),
)
#: These can't fill a hole.
NO_INFILLING = frozenset(k for k, _, _ in MODELS if k.startswith("codellama/"))


def context_of(key: str) -> int:
    for k, _, size in MODELS:
        if k == key:
            return size
    raise ValueError(f"unknown model: {key}")


@dataclass(frozen=True)
class Generation:
    """How an answer is drawn; most_length bounds prompt and answer together."""

    most_new: int = 200
    top_p: float = 1.0
    temperature: float = 1.0
    most_length: int | None = None

    @property
    def sampled(self) -> bool:
        return self.temperature != 0.0

    def for_new(self, most_new: int) -> Generation:
        """The same with another bound for the answer alone."""
        return Generation(most_new, self.top_p, self.temperature)

    def room(self, prompt_tokens: Column, context: int) -> Column:
        """Tokens that an answer may take; a prompt that fills the context is an error."""
        bounds = [F.lit(context) - prompt_tokens, F.lit(self.most_new), *([F.lit(self.most_length) - prompt_tokens] if self.most_length is not None else [])]
        return F.when(prompt_tokens >= context, F.raise_error(F.lit("a prompt fills the context")).cast("bigint")).otherwise(F.least(*bounds))

    def options(self, eos: int, pad: int) -> dict:
        """What a generation library is given."""
        return {"max_new_tokens": self.most_new, "top_p": self.top_p, "eos_token_id": eos, "pad_token_id": pad, "do_sample": self.sampled} | ({"temperature": self.temperature} if self.sampled else {})
