"""Column expressions over raw log text.

Every function takes and returns a Spark ``Column`` built from native
expressions, so the work stays in the JVM and inside the scan stage.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

# Blanks as the Unicode standard and the C1 separators define them.
BLANK = r"[\s\x1c-\x1f]"
# A word character is a letter, a number or an underscore.
WORD_CHAR = r"[\p{L}\p{N}_]"
PLACEHOLDER = "<*>"

# Words that carry no meaning for the token vocabulary.
STOP_WORDS = (
    "a", "an", "and", "i", "ie", "so", "to", "the",
    "Monday", "Tuesday", "Wednesday", "Thursday", "Friday", "Saturday", "Sunday",
    "Mon", "Tue", "Wed", "Thu", "Fri", "Sat", "Sun",
    "January", "February", "March", "April", "May", "June", "July",
    "August", "September", "October", "November", "December",
    "Jan", "Feb", "Mar", "Apr", "Jun", "Jul", "Aug", "Sep", "Oct", "Nov", "Dec",
)

# Whole and decimal numbers, digits, and the marks that are blanked before words are counted.
NUMBER = r"(?U)\d+(\.\d+)?"
DIGITS = r"(?U)\d+"
CLEANED_MARKS = r'[:()=,"{}@\[\]|;]|\.?!'

# The separators a log line is cut at before clustering.
TOKEN_SEPARATORS = r"[ ,|]"


def as_column(value: Column | str) -> Column:
    """A column, or the column of that name."""
    return value if isinstance(value, Column) else F.col(value)


def collapse_ws(text: Column | str) -> Column:
    """Trim, and turn every run of blanks into one space."""
    return F.trim(F.regexp_replace(as_column(text), rf"(?U){BLANK}+", " "))


def strip_blanks(text: Column | str) -> Column:
    """Drop blanks at both ends, leaving inner runs alone."""
    return F.regexp_replace(as_column(text), rf"(?U)^{BLANK}+|{BLANK}+\z", "")


def split_words(text: Column | str) -> Column:
    """Blank-separated words; an empty array for a blank text."""
    return F.filter(F.split(collapse_ws(text), " "), lambda w: w != "")


def count_flat_words(flat: Column | str) -> Column:
    """How many words a blank-collapsed text has."""
    text = as_column(flat)
    return F.when(text == "", F.lit(0)).otherwise(count_of(text, " ") + 1)


def count_words(text: Column | str) -> Column:
    """How many blank-separated words a text has."""
    return count_flat_words(collapse_ws(text))


def bind(value: Column, use: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once and hand it to ``use``, also inside a lambda."""
    return F.transform(F.array(value), use)[0]


def count_of(text: Column, char: str) -> Column:
    """How often one character occurs."""
    return F.length(text) - F.length(F.replace(text, F.lit(char), F.lit("")))


def mask_numbers(text: Column | str) -> Column:
    """Replace whole and decimal numbers by ``0``."""
    return F.regexp_replace(as_column(text), NUMBER, "0")


def drop_digits(text: Column | str) -> Column:
    """The text without any digit."""
    return F.regexp_replace(as_column(text), DIGITS, "")


def has_digit(text: Column) -> Column:
    return text.rlike(r"(?U)\d")


def cluster_tokens(
    text: Column | str, pattern: str = TOKEN_SEPARATORS, remove_digits: bool = True
) -> Column:
    """Tokens that describe the constant part of a line.

    ``key=value`` keeps the key, words with several ``=``, with a digit (when
    ``remove_digits``) or with a slash are dropped.  A line left without tokens
    is represented by its number-masked text.
    """
    source = as_column(text)

    def keep(word: Column) -> Column:
        equals = count_of(word, "=")
        constant = F.when(F.contains(word, F.lit("/")), "").otherwise(word)
        if remove_digits:
            constant = F.when(has_digit(word), "").otherwise(constant)
        return (
            F.when(equals == 1, F.substring_index(word, "=", 1))
            .when(equals > 1, "")
            .otherwise(constant)
        )

    kept = F.filter(F.transform(F.split(source, pattern), keep), lambda w: w != "")
    return bind(
        kept, lambda words: F.when(F.size(words) > 0, words).otherwise(F.array(mask_numbers(source)))
    )


def clean_words(text: Column | str) -> Column:
    """Words of a line once punctuation is blanked and words with digits are gone."""
    blanked = F.regexp_replace(as_column(text), CLEANED_MARKS, " ")
    return F.filter(split_words(blanked), lambda w: ~has_digit(w))


def clean_line(text: Column | str) -> Column:
    """`clean_words` joined by single spaces."""
    return F.array_join(clean_words(text), " ")


def format_signature(text: Column | str) -> Column:
    """The sorted distinct characters that are no ASCII letter, digit, comma or space."""
    marks = F.regexp_replace(as_column(text), r"[0-9A-Za-z, ]+", "")
    return F.array_join(F.sort_array(F.array_distinct(F.split(marks, ""))), "")


def drop_stop_words(words: Column, stop_words: Iterable[str] = STOP_WORDS) -> Column:
    """Words longer than two characters that are no stop words."""
    stops = list(stop_words)
    return F.filter(words, lambda w: (F.length(w) > 2) & ~w.isin(stops))


def word_tokens(text: Column | str) -> Column:
    """Lower-case runs of at least two word characters."""
    return F.regexp_extract_all(
        F.lower(as_column(text)), F.lit(f"{WORD_CHAR}{WORD_CHAR}+"), F.lit(0)
    )


def is_valid_template(template: Column | str) -> Column:
    """True if something other than placeholders, spaces and punctuation is left."""
    rest = F.replace(
        F.replace(as_column(template), F.lit(PLACEHOLDER), F.lit("")), F.lit(" "), F.lit("")
    )
    return rest.rlike(r"[^!-/:-@\[-`{-~]")


def is_digit_heavy(token: Column | str) -> Column:
    """At least four digits, or no capital and digits above three tenths of the length."""
    word = as_column(token)
    digits = F.length(F.regexp_replace(word, r"(?U)\D", ""))
    return has_digit(word) & (
        (digits >= 4)
        | (~word.rlike(r"\p{IsUppercase}") & (digits / F.length(word) > 0.3))
    )
