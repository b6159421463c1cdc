"""Texts for people: translated statuses, yes/no, title words."""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerrecon.labels import NO_LABEL, NO_WORDS, STATUS_TRANSLATION, YES_LABEL, YES_WORDS


def translate_status(col: Column) -> Column:
    """Label of a status; unknown statuses stay as they are."""
    labels = F.create_map(*[F.lit(x) for x in chain.from_iterable(STATUS_TRANSLATION.items())])
    return F.coalesce(F.try_element_at(labels, F.trim(col)), col)


def yes_no(col: Column, dtype: T.DataType) -> Column:
    """Sim / Não for flags and yes/no words; other text stays; missing is ''."""
    if isinstance(dtype, T.BooleanType):
        label = F.when(col, YES_LABEL).when(~col, NO_LABEL)
    elif isinstance(dtype, T.NumericType):
        label = F.when(F.abs(col) >= 1, YES_LABEL).when(col.isNotNull(), NO_LABEL)
    else:
        word = F.lower(F.trim(col))
        label = F.when(word.isin(*YES_WORDS), YES_LABEL).when(word.isin(*NO_WORDS), NO_LABEL).otherwise(col)
    return F.coalesce(label, F.lit(""))


def title_words(col: Column) -> Column:
    """UPPER_SNAKE names as Title Words; anything else trimmed; missing is ''."""
    text = F.trim(col)
    shouting = (F.upper(text) == text) & (text.contains("_") | text.rlike(r"\p{Lu}"))
    words = F.filter(F.split(text, "_"), lambda w: F.length(w) > 0)
    titled = F.transform(
        words, lambda w: F.concat(F.upper(F.substring(w, 1, 1)), F.lower(w.substr(F.lit(2), F.length(w))))
    )
    return F.coalesce(F.when(shouting, F.array_join(titled, " ")).otherwise(text), F.lit(""))
