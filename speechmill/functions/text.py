"""Text normalisers and matchers as native column expressions.

There are three word normalisers on purpose; the callers depend on their
differences (edge trim, letters+digits, letters only) and must not be merged.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .rows import let

# Fixed value: whitespace class shared by the tokenizer here and in SQL.
WHITESPACE = "[ \\t\\n\\r\\f]+"


def norm_edge(word: Column) -> Column:
    """Trim non-alphanumerics off both ends, ASCII lower case."""
    trimmed = F.regexp_replace(word, "^[^A-Za-z0-9]+|[^A-Za-z0-9]+$", "")
    return ascii_lower(trimmed)


def ascii_lower(value: Column) -> Column:
    """Lower-case A-Z only; accented capitals stay as they are."""
    return F.translate(value, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def norm_alnum(word: Column) -> Column:
    """Keep letters and digits of any script, Unicode lower case."""
    return F.lower(F.regexp_replace(word, "[^\\p{L}\\p{N}]", ""))


def norm_letters(word: Column) -> Column:
    """Keep letters only, Unicode lower case (digits are dropped)."""
    return F.regexp_replace(F.lower(word), "[^\\p{L}]", "")


def tokens(text: Column) -> Column:
    """Whitespace tokens without empties."""
    return F.filter(F.split(text, WHITESPACE), lambda w: w != "")


def normalized_words(text: Column) -> Column:
    """Edge-trimmed lower-case words without empties."""
    return F.filter(F.transform(tokens(text), norm_edge), lambda w: w != "")


def safe_filename(value: Column) -> Column:
    """Lower-case dash-separated stem; ``clip`` when nothing usable is left."""
    dashed = F.regexp_replace(ascii_lower(F.trim(value)), "[^a-z0-9]+", "-")
    return F.coalesce(F.nullif(F.regexp_replace(dashed, "^-+|-+$", ""), F.lit("")), F.lit("clip"))


def squeeze(value: Column) -> Column:
    """Trim and collapse inner whitespace to single spaces."""
    return F.trim(F.regexp_replace(value, WHITESPACE, " "), F.lit(" "))


def _capitalised(value: Column) -> Column:
    flat = squeeze(value)
    return F.concat(F.upper(F.substring(flat, 1, 1)), F.substr(flat, F.lit(2)))


def sentence_case(value: Column) -> Column:
    """Capital first letter and a final period unless one is there."""
    text = _capitalised(value)
    return F.when(F.endswith(text, F.lit(".")), text).otherwise(F.concat(text, F.lit(".")))


def compact_case(value: Column) -> Column:
    """As :func:`sentence_case`, but ``?`` and ``!`` also count as an ending."""
    text = _capitalised(value)
    return F.when((text == "") | text.rlike("[.?!]$"), text).otherwise(F.concat(text, F.lit(".")))


def contains_run(words: Column, phrase: Column) -> Column:
    """True where ``phrase`` (array) occurs as a contiguous run of ``words``.

    Both arrays are joined with a separator that no token holds, so one string
    search replaces the nested scan; an empty phrase matches nothing.
    """
    sep = "\u0001"
    hay = F.concat(F.lit(sep), F.array_join(words, sep), F.lit(sep))
    needle = F.concat(F.lit(sep), F.array_join(phrase, sep), F.lit(sep))
    return (F.size(phrase) > 0) & F.contains(hay, needle)


def tail_has_phrase(words: Column, phrase: Column, slack: int = 2) -> Column:
    """True where ``phrase`` ends within ``slack`` words of the end of ``words``."""
    def at_tail(w: Column) -> Column:
        n, m = F.size(w), F.size(phrase)
        # Only the last m + slack words can hold a match that ends late enough.
        keep = F.least(n, m + slack)
        tail = F.slice(w, F.greatest(n - keep + 1, F.lit(1)), keep)
        return (m > 0) & (n >= m) & contains_run(tail, phrase)

    return let(words, at_tail)


def prompt_lines(script: Column) -> Column:
    """Non-empty trimmed lines of a script."""
    return F.filter(F.transform(F.split(script, "\\r?\\n"), lambda x: F.trim(x)), lambda x: x != "")


def phrase_or_slug(phrase: Column, slug: Column) -> Column:
    """The stored phrase, else the slug with blanks for underscores."""
    return F.coalesce(phrase, F.replace(slug, F.lit("_"), F.lit(" ")))


def remap_path(path: Column, root: str) -> Column:
    """Rewrite a stored container data path onto ``root``."""
    return F.regexp_replace(path, "^(/work)?/data/", root.rstrip("/") + "/")


def rounded_ms(seconds: Column) -> Column:
    """Seconds to whole milliseconds, half away from zero."""
    return F.round(seconds * 1000.0).cast("bigint")


def run_stamp(ts: Column) -> Column:
    """Compact UTC run id, ``yyyyMMddTHHmmssZ``."""
    return F.date_format(ts, "yyyyMMdd'T'HHmmss'Z'")


def parse_run_stamp(stamp: Column) -> Column:
    return F.try_to_timestamp(stamp, F.lit("yyyyMMdd'T'HHmmss'Z'"))


def last_percent(line: Column) -> Column:
    """The last ``NN%`` of a progress line, clamped to 100; null without one.

    Runs of five or more digits overflow the source's 16-bit parse and are no
    percentage; values that do not fit are skipped the same way.
    """
    found = F.filter(
        F.regexp_extract_all(line, F.lit("([0-9]+)%"), F.lit(1)),
        lambda d: (F.length(F.ltrim(d, F.lit("0"))) <= 5)
        & (F.concat(F.lit("0"), F.right(d, F.lit(6))).cast("bigint") <= 65535),
    )
    last = F.get(found, F.size(found) - 1).cast("bigint")
    return F.when(last > 100, F.lit(100).cast("bigint")).otherwise(last)


def line_step(line: Column) -> Column:
    """1-based stage of a progress line, from its banner or its description."""
    banner = F.regexp_extract(line, "Step (.*?)/6", 1)
    number = F.when(F.trim(banner).rlike("^\\+?0*[1-6]$"), F.regexp_extract(banner, "([1-6]) *$", 1).cast("int"))
    return (
        F.when(number.isNotNull(), number)
        .when(F.contains(line, F.lit("Synthesizing clips")) | F.contains(line, F.lit("VoxCPM clips"))
              | F.contains(line, F.lit("Background (")), 1)
        .when(F.contains(line, F.lit("Augmenting ")), 2)
        .when(F.contains(line, F.lit("Features ")), 3)
        .when(F.contains(line, F.lit("Phase ")), 4)
    )


def progress_label(line: Column) -> Column:
    """Description before the bar of a progress line; empty without a bar."""
    at = F.instr(line, "%|")
    head = F.rtrim(F.regexp_replace(F.rtrim(F.substr(line, F.lit(1), F.greatest(at - 1, F.lit(0)))), "[0-9]+$", ""))
    cut = F.regexp_replace(head, ":[^:]*$", "")
    return F.when(at == 0, F.lit("")).otherwise(F.trim(cut))
