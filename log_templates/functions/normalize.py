"""Template normalisation: five rule sets as native expressions.

``base`` and ``large`` clean inferred templates, ``oracle`` and ``light``
clean ground truth, ``general`` irons out differences between labellings.
The rules widen a template and never narrow it.  ``base`` and ``large`` are
not idempotent, so apply them once.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from log_templates.functions.text import (
    PLACEHOLDER,
    as_column,
    bind,
    collapse_ws,
    count_of,
    is_digit_heavy,
)

# Characters that end a path, and those that also end a token.
PATH_ENDS = r"""\s,!;:=|"'\[\](){}"""
PATH_ENDS_LARGE = PATH_ENDS + "+"
TOKEN_ENDS = PATH_ENDS + r".\-+@#$%&"
# Words that always stand for a variable.
VARIABLE_WORDS = ("true", "false", "null", "root", "admin")

# What counts as a path, without and with a slash at its end, and as a dotted name.
PATH = r"^(\/[^\/]+)+$"
PATH_OR_FOLDER = r"^(\/[^\/]+)+\/?$"
DOTTED_NAME = r"^([a-z0-9-]+\.){2,}[a-z]+$"

# What a text must hold for the path rules to change it.
PATH_HINT = r"/|\.[a-z0-9-]+\."

RULESETS = ("base", "large", "oracle", "light", "general")


def _cut(text: Column, ends: str) -> Column:
    """Tokens and the runs of delimiters between them, nothing lost.

    The text's blanks are collapsed, so a space is the only one it can hold.
    """
    ends = ends.replace(r"\s", " ")
    return F.regexp_extract_all(text, F.lit(f"[^{ends}]+|[{ends}]+"), F.lit(0))


def _merge_runs(text: Column, separator: str) -> Column:
    """Placeholders joined by the separator become one."""
    return F.regexp_replace(text, rf"<\*>(?:{separator}<\*>)+", PLACEHOLDER)


def _paths(text: Column, ruleset: str) -> Column:
    def rule(token: Column) -> Column:
        if ruleset == "oracle":
            variable = token.rlike(PATH)
        else:
            mixed = (
                F.contains(token, F.lit(PLACEHOLDER))
                & F.contains(token, F.lit("."))
                & F.contains(token, F.lit("/"))
            )
            variable = token.rlike(PATH_OR_FOLDER) | token.rlike(DOTTED_NAME) | mixed
        return F.when(variable, PLACEHOLDER).otherwise(token)

    ends = PATH_ENDS_LARGE if ruleset == "large" else PATH_ENDS
    return F.array_join(F.transform(_cut(text, ends), rule), "")


def _words(text: Column, ruleset: str, user_strings: Iterable[str]) -> Column:
    if ruleset == "light":
        names = []
    else:
        names = [*VARIABLE_WORDS, *user_strings]
    if ruleset != "large":
        names = [name.lower() for name in names]

    def rule(token: Column) -> Column:
        if ruleset in ("base", "large"):
            variable = is_digit_heavy(token)
        else:
            variable = token.rlike(r"(?U)^\d+\z")
        if names:
            word = token if ruleset == "large" else F.lower(token)
            variable = word.isin(names) | variable
        glued = F.contains(token, F.lit(PLACEHOLDER)) & ~F.contains(token, F.lit("/"))
        return F.when(glued | variable, PLACEHOLDER).otherwise(token)

    return F.array_join(F.transform(_cut(text, TOKEN_ENDS), rule), "")


def _may_hold_variables(text: Column, ruleset: str, user_strings: Iterable[str]) -> Column:
    """What a text must hold for the word rules to change it: a digit, a placeholder, or one of the words."""
    lower = F.lower(text)
    hint = F.contains(text, F.lit(PLACEHOLDER)) | text.rlike(r"(?U)\d")
    for name in () if ruleset == "light" else (*VARIABLE_WORDS, *user_strings):
        # Outside ASCII a letter's lower case can depend on the letters around it.
        hint = hint | (F.contains(lower, F.lit(name.lower())) if name.isascii() else F.lit(True))
    return hint


def _unwrap_hashes(text: Column) -> Column:
    """Peel ``#<*>#`` from the inside out until none is left."""
    layers = F.when(
        F.contains(text, F.lit("#<*>#")),
        F.sequence(F.lit(1), F.greatest(F.lit(1), count_of(text, "#") / 2).cast("int")),
    ).otherwise(F.array().cast("array<int>"))
    return F.aggregate(
        layers, text, lambda acc, _: F.replace(acc, F.lit("#<*>#"), F.lit(PLACEHOLDER))
    )


def _between_blanks(text: Column, mark: str) -> Column:
    return F.regexp_replace(text, rf"(?<= ){mark}<\*>{mark}(?= )", PLACEHOLDER)


def _quoted(text: Column) -> Column:
    return _between_blanks(_between_blanks(text, '"'), "'")


def _units(text: Column) -> Column:
    return F.regexp_replace(text, r"(?U)<\*> [KGTM]?B\b", PLACEHOLDER)


def _hash_before(text: Column) -> Column:
    return F.regexp_replace(text, r"(?<= )#<\*>(?= )", PLACEHOLDER)


def _general_pass(text: Column) -> Column:
    # What the cross-label rules replace, in their order.
    rules = (
        (r"<\*><\*>", PLACEHOLDER),
        (r"<\*>:<\*>", PLACEHOLDER),
        (r"<\*> <\*>", PLACEHOLDER),
        (r"'<\*>'", PLACEHOLDER),
        (r"<\*> [KGTM]?B", PLACEHOLDER),
        (r"node-<\*>", PLACEHOLDER),
        (r"node-\[<\*>\]", PLACEHOLDER),
        (r"<\*>##<\*>", PLACEHOLDER),
        (r"<\*>,<\*>", PLACEHOLDER),
        (r"GET <\*>", PLACEHOLDER),
        (r"POST <\*>", PLACEHOLDER),
        (r"DELETE <\*>", PLACEHOLDER),
        (r"tty=ssh", "tty=<*>"),
        (r"tty=NODEVssh", "tty=<*>"),
    )
    for pattern, value in rules:
        text = F.regexp_replace(text, pattern, value)
    return text


def _general(text: Column) -> Column:
    """Repeat the cross-label pass until a text stays the same.

    A pass that changes a text shortens it or rewrites a ``tty``, so half the
    length bounds the passes; a settled text is carried through untouched.
    """
    start = F.struct(_merge_runs(text, r"\.").alias("text"), F.lit(False).alias("settled"))

    def again(state: Column, _: Column) -> Column:
        changed = _general_pass(state["text"])
        return F.when(state["settled"], state).otherwise(
            F.struct(changed.alias("text"), (changed == state["text"]).alias("settled"))
        )

    passes = F.sequence(F.lit(0), (F.length(text) / 2).cast("int") + 1)
    needed = F.contains(text, F.lit(PLACEHOLDER)) | F.contains(text, F.lit("tty="))
    settled = F.aggregate(passes, start, again, lambda state: state["text"])
    return F.when(needed, _merge_runs(settled, ":")).otherwise(text)


def normalized(
    template: Column | str, ruleset: str = "base", user_strings: Iterable[str] = ()
) -> Column:
    """A template under one of the `RULESETS`."""
    if ruleset not in RULESETS:
        raise ValueError(f"unknown rule set {ruleset!r}, expected one of {RULESETS}")
    user_strings = tuple(user_strings)  # read more than once below
    source = as_column(template)
    if ruleset == "general":
        return _general(source)
    text = collapse_ws(source)
    # Most texts hold nothing a rule applies to; one look saves cutting them up.
    if ruleset != "light":
        text = bind(
            text, lambda t: F.when(t.rlike(PATH_HINT), _paths(t, ruleset)).otherwise(t)
        )
    text = bind(
        text,
        lambda t: F.when(_may_hold_variables(t, ruleset, user_strings), _words(t, ruleset, user_strings)).otherwise(t),
    )
    # Merging concerns texts with a placeholder only.
    return bind(
        text,
        lambda t: F.when(F.contains(t, F.lit(PLACEHOLDER)), _merged(t, ruleset)).otherwise(t),
    )


def _merged(text: Column, ruleset: str) -> Column:
    """Join neighbouring placeholders by the separators of a rule set, in its order."""
    text = _merge_runs(_merge_runs(text, r"\."), "")
    if ruleset == "base":
        text = _merge_runs(_merge_runs(text, ":"), "/")
        return _units(F.replace(text, F.lit(" -<*>"), F.lit(" <*>")))
    if ruleset == "large":
        text = bind(text, _unwrap_hashes)
        text = _merge_runs(_merge_runs(text, ":"), "/")
        text = _merge_runs(_hash_before(text), ":")
        for separator in ("#", "/", "@", r"\."):
            text = _merge_runs(text, separator)
        return _units(_merge_runs(_quoted(text), ""))
    if ruleset == "light":
        text = _hash_before(F.regexp_replace(text, r"(?<= )#<\*>#(?= )", PLACEHOLDER))
        for separator in (":", "#", "/", "@", r"\."):
            text = _merge_runs(text, separator)
        return _merge_runs(_quoted(text), "")
    return text


def normalize_templates(
    df: DataFrame,
    ruleset: str = "base",
    user_strings: Iterable[str] = (),
    template_col: str = "event_template",
    output_col: str | None = None,
) -> DataFrame:
    """Normalise a template column in place, or into ``output_col``.

    It stays a projection: no shuffle.  Callers that hold many copies of few
    templates should normalise the distinct ones and join back.
    """
    return df.withColumn(
        output_col or template_col, normalized(template_col, ruleset, user_strings)
    )
