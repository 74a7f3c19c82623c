"""What a loader yields per row (PR-13), as one plan: ids, mask, caption and image file."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import small, stored
from .assets import strict_lookup, unique_names
from .tokens import encode, first_words, pad_truncate


def samples(df: DataFrame, manifest: DataFrame, vocab: DataFrame, caption_col: str = "caption", id_col: str = "national_number",
            max_len: int = 256, fail: bool = True, words_col: str | None = None) -> DataFrame:
    """``(id, input_ids, attention_mask, image_path, caption)`` per row, in the order a loader returns them.

    The file is looked up by its strict name, and a row without one fails the job in the plan (``fail=False``: a null path), as does a
    row whose ids or mask are not ``max_len`` long or whose mask does not mark the ids that are not padding. The manifest is reduced to
    one row a name and broadcast while it is small, so that captions meet it where they are. ``words_col``: the words, where they are cut already.
    """
    files = small(stored(unique_names(manifest), "manifest"))
    found = strict_lookup(df, files, id_col, fail=fail, unique=True)
    # A word has one id at least, so those after the first ``max_len - 2`` have no place in a sample.
    words = F.col(words_col) if words_col else first_words(caption_col, max_len - 2)
    ids, mask, n = pad_truncate("_ids", max_len)
    coded = encode(found.select(id_col, caption_col, "image_path", words.alias("_words")), vocab, words_col="_words", out_col="_ids", id_col=id_col)
    coded = coded.select(id_col, caption_col, "image_path", ids.alias("input_ids"), mask.alias("attention_mask"), n.alias("_n"))
    marked = F.aggregate("attention_mask", F.lit(0), lambda a, m: a + m)
    whole = (F.size("input_ids") == max_len) & (F.size("attention_mask") == max_len) & (marked == F.col("_n"))
    checked = F.when(whole, F.col("input_ids")).otherwise(F.raise_error(F.concat(F.lit("Malformed sample #"), F.col(id_col).cast("string"))))
    return coded.select(id_col, checked.alias("input_ids"), "attention_mask", "image_path", caption_col)
