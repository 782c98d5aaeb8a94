"""Matching one line against one template, as native expressions.

A template is constants joined by ``<*>``.  A line fits when it starts with
the first constant, ends with the last one, and the constants in between can
be placed from left to right, each at its leftmost free position.  This gives
the variables an anchored lazy regular expression would give, in linear time
and without compiling a pattern per row.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from log_templates.functions.text import PLACEHOLDER, as_column, bind, collapse_ws


def template_parts(template: Column | str) -> Column:
    """The constants of a template, k variables giving k + 1 of them."""
    return F.split(as_column(template), r"<\*>")


def _place(line: Column, parts: Column, start: Column, step) -> Column:
    """Fold the constants after the first one over the line.

    The state is ``(cursor, found)``; ``cursor`` is the one-based position after
    the last placed constant, 0 once the line does not fit.  ``step`` merges the
    text between two constants into ``found``.
    """
    last = F.element_at(parts, -1)
    middle = F.slice(parts, 2, F.greatest(F.size(parts) - 2, F.lit(0)))
    miss = F.struct(F.lit(0).alias("cursor"), start.alias("found"))

    def advance(state: Column, part: Column) -> Column:
        found_at = F.when(part == "", state["cursor"]).otherwise(
            F.position(part, line, state["cursor"])
        )
        moved = bind(
            found_at,
            lambda at: F.when(at < 1, miss).otherwise(
                F.struct(
                    (at + F.length(part)).alias("cursor"),
                    step(state["found"], state["cursor"], at, part).alias("found"),
                )
            ),
        )
        return F.when(state["cursor"] < 1, state).otherwise(moved)

    def close(state: Column) -> Column:
        return bind(
            F.length(line) - F.length(last) + 1,
            lambda at: F.when(
                (state["cursor"] >= 1) & (at >= state["cursor"]),
                step(state["found"], state["cursor"], at, last),
            ),
        )

    first = parts[0]
    opened = F.struct((F.length(first) + 1).alias("cursor"), start.alias("found"))
    return F.when(
        F.startswith(line, first) & F.endswith(line, last),
        F.aggregate(middle, opened, advance, close),
    )


def variables_in(line: Column, parts: Column) -> Column:
    """Variables of a blank-collapsed line, null if it does not fit."""
    nothing = F.array().cast("array<string>")
    fitted = _place(
        line,
        parts,
        nothing,
        lambda found, cursor, at, part: F.concat(
            found, F.array(F.substring(line, cursor, at - cursor))
        ),
    )
    return F.when(
        F.size(parts) == 1, F.when(line == parts[0], nothing)
    ).otherwise(fitted)


def filled_template(line: Column, parts: Column) -> Column:
    """The template without the placeholders that are empty in this line.

    Null if the blank-collapsed line does not fit.
    """
    fitted = _place(
        line,
        parts,
        parts[0],
        lambda found, cursor, at, part: F.concat(
            found, F.when(at > cursor, PLACEHOLDER).otherwise(""), part
        ),
    )
    return F.when(
        F.size(parts) == 1, F.when(line == parts[0], parts[0])
    ).otherwise(fitted)


def fits(line: Column, parts: Column) -> Column:
    """True if the blank-collapsed line fits the template."""
    return filled_template(line, parts).isNotNull()


def extract_variables(content: Column | str, template: Column | str) -> Column:
    """Variables of a raw line under a template, null if it does not fit."""
    return variables_in(collapse_ws(content), template_parts(template))


def collapse_empty_variables(template: Column | str, variables: Column | str) -> Column:
    """Drop the placeholders whose variable is empty."""
    parts = template_parts(template)
    tails = F.slice(parts, 2, F.greatest(F.size(parts) - 1, F.lit(0)))
    joined = F.zip_with(
        as_column(variables),
        tails,
        lambda value, part: F.concat(F.when(value == "", "").otherwise(PLACEHOLDER), part),
    )
    return F.concat(parts[0], F.array_join(joined, ""))


def align_empty_values(content: Column | str, template: Column | str) -> Column:
    """A label without the placeholders that are empty in its own, uncollapsed line."""
    label = as_column(template)
    return F.coalesce(filled_template(as_column(content), template_parts(label)), label)
