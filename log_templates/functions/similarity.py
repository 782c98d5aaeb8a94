"""Comparing two templates token by token."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from log_templates.functions.text import BLANK, PLACEHOLDER, as_column

# Punctuation that separates tokens, and marks that stay tokens.
SEPARATORS = r"""!"#$%&'()+,\-/:;=?@.\[\\\]^_`{|}~"""
DROPPED = r"""[!"#$%&'+,\-/:;?@.\[\\\]^_`{}~ ]"""


def _is_word(run: Column) -> Column:
    """A run that begins with an ASCII letter or digit: no separator or blank is in it."""
    code = F.ascii(run)
    return code.between(97, 122) | code.between(65, 90) | code.between(48, 57)


def similarity_tokens(template: Column | str) -> Column:
    """Words and kept marks of a template; neighbouring placeholders become one."""
    source = as_column(template)
    runs = F.regexp_extract_all(
        source, F.lit(rf"(?U)[^\s\x1c-\x1f{SEPARATORS}]+|[\s\x1c-\x1f{SEPARATORS}]+"), F.lit(0)
    )
    marked = F.transform(
        runs,
        lambda t: F.when(F.contains(t, F.lit(PLACEHOLDER)), PLACEHOLDER)
        .when(_is_word(t), t)
        .when(t == " ", "")
        .otherwise(F.regexp_replace(t, DROPPED, "")),
    )
    tokens = F.transform(
        F.filter(marked, lambda t: t != ""),
        lambda t: F.when(_is_word(t) | (t == PLACEHOLDER), t).otherwise(
            F.regexp_replace(t, rf"(?U)^{BLANK}+|{BLANK}+\z", "")
        ),
    )
    # A placeholder after a placeholder goes; the token before is found by shifting.
    shifted = F.concat(F.array(F.lit("")), tokens)
    paired = F.filter(
        F.arrays_zip(tokens.alias("token"), shifted.alias("before")),
        lambda p: p["token"].isNotNull()
        & ~((p["token"] == PLACEHOLDER) & (p["before"] == PLACEHOLDER)),
    )
    return F.transform(paired, lambda p: p["token"])


def template_similarity(left: Column | str, right: Column | str) -> Column:
    """Shared distinct tokens over all tokens minus the shared; null if both have none."""
    a, b = similarity_tokens(left), similarity_tokens(right)
    shared = F.size(F.array_intersect(a, b))
    return F.try_divide(shared.cast("double"), F.size(a) + F.size(b) - shared)


def token_equal(truth: Column | str, parsed: Column | str) -> Column:
    """Equal word by word once words of ``truth`` that hold a placeholder count as one."""
    abstracted = F.transform(
        F.split(as_column(truth), " "),
        lambda t: F.when(F.contains(t, F.lit(PLACEHOLDER)), PLACEHOLDER).otherwise(t),
    )
    return abstracted == F.split(as_column(parsed), " ")
