"""Text expressions: retrieval text, tokens, JSON fields, templates."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from hibiki import constants as C

# Letters written without spaces between words; every other letter or digit forms words.
_UNSPACED = r"\p{IsHan}\p{IsHiragana}\p{IsKatakana}ー"
# Where all of them lie; a plain range is found much faster than a script.
_FROM_UNSPACED = r"[\x{2E80}-\x{10FFFF}]"
_WORD = rf"[\p{{L}}\p{{N}}&&[^{_UNSPACED}]]+"
_PLAIN_WORD = r"[a-z0-9\p{L}\p{N}]+"
_PAIR = rf"(?=([{_UNSPACED}]{{2}}))"
_SINGLE = rf"(?<![{_UNSPACED}])[{_UNSPACED}](?![{_UNSPACED}])"


def tokens(text: Column) -> Column:
    """Lower-cased words, and overlapping character pairs where words are not spaced."""
    low = F.lower(F.coalesce(text, F.lit("")))
    # Most texts have no unspaced letters; for them one plain class gives the same words at a third of the time.
    spaced = F.regexp_extract_all(low, F.lit(_PLAIN_WORD), F.lit(0))
    plain = ~low.rlike(_FROM_UNSPACED) | ~low.rlike(f"[{_UNSPACED}]")
    return F.when(plain, spaced).otherwise(F.concat(
        F.regexp_extract_all(low, F.lit(_WORD), F.lit(0)),
        F.regexp_extract_all(low, F.lit(_PAIR), F.lit(1)),
        F.regexp_extract_all(low, F.lit(_SINGLE), F.lit(0)),
    ))


def silver_text(category: Column, question: Column, answer: Column) -> Column:
    """Labelled lines joined by newlines; a null part leaves its whole line out."""
    parts = (category, question, answer)
    return F.concat_ws(
        "\n", *[F.concat(F.lit(label), part) for (_, label), part in zip(C.SILVER_LABELS, parts)]
    )


def shorten(text: Column, length: int) -> Column:
    """The first ``length`` characters, always followed by three dots."""
    return F.concat(F.left(text, F.lit(length)), F.lit("..."))


def final_answer(content: Column) -> Column:
    """The model's answer, or the fixed apology where it is null or empty."""
    return F.coalesce(F.nullif(content, F.lit("")), F.lit(C.ANSWER_FALLBACK))


def or_empty(text: Column) -> Column:
    return F.coalesce(text, F.lit(""))


def json_list(text: Column) -> Column:
    """JSON text to an array of strings; broken JSON gives null."""
    return F.from_json(text, T.ArrayType(T.StringType()))


def as_json(*columns: Column) -> Column:
    """A JSON object that keeps null fields and non-ASCII letters."""
    return F.to_json(F.struct(*columns), {"ignoreNullFields": "false"})


def first_id(text: Column, letter: str) -> Column:
    """The first id such as ``C001`` in free text, null where there is none."""
    return F.nullif(F.regexp_extract(text, rf"{letter}\d{{3,}}", 0), F.lit(""))


def slash_date(text: Column) -> Column:
    """``yyyy/MM/dd`` text to a date, null where it is not one."""
    return F.try_to_date(text, "yyyy/MM/dd")


def fill_template(template: str, values: dict[str, Column]) -> Column:
    """Put columns in the place of ``{name}``.

    The template is cut once, here, so text that is put in is never scanned for names itself.
    """
    pieces = re.split(r"\{(%s)\}" % "|".join(map(re.escape, values)), template)
    return F.concat(
        *[or_empty(values[p]) if i % 2 else F.lit(p) for i, p in enumerate(pieces)]
    )
