"""Text predicates, redaction and classifiers as column expressions."""

from __future__ import annotations

import unicodedata
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidewrack.functions import patterns as P

#: Unicode white space, as the classifiers trim it; SQL-side predicates trim blanks only.
LEADING_SPACE = r"^[\s\u00A0\u1680\u2000-\u200A\u2028\u2029\u202F\u205F\u3000\uFEFF]+"


def trim_start(text: Column) -> Column:
    return F.regexp_replace(text, LEADING_SPACE, "")


def is_noise(text: Column, blanks_only: bool = False) -> Column:
    """Whether an agent runtime put the text there. False for null and empty text."""
    lead = "^ *" if blanks_only else LEADING_SPACE.removesuffix("+") + "*"
    return F.coalesce(text.rlike(lead + "(?:" + "|".join(rf"\Q{p}\E" for p in P.INJECTED_PREFIXES) + ")"), F.lit(False))


def redact(text: Column, extra: tuple[tuple[str, str, str], ...] = ()) -> Column:
    """The text with secrets replaced by [REDACTED:name]; ``extra`` rules follow the built-in ones."""
    return reduce(lambda t, rule: F.regexp_replace(t, rule[1], rule[2]), (*P.REDACTIONS, *extra), text)


def redaction_counts(text: Column, extra: tuple[tuple[str, str, str], ...] = ()) -> dict[str, Column]:
    """How often each rule fires, later rules seeing what earlier ones left."""
    counts: dict[str, Column] = {}
    for name, pattern, replacement in (*P.REDACTIONS, *extra):
        counts[name] = F.coalesce(F.regexp_count(text, F.lit(pattern)), F.lit(0))
        text = F.regexp_replace(text, pattern, replacement)
    return counts


def error_category(output: Column, tool: Column) -> Column:
    low = F.lower(F.coalesce(output, F.lit("")))
    return reduce(lambda rest, c: F.when(low.rlike(c[1]), c[0]).otherwise(rest), reversed(P.ERROR_CATEGORIES), F.lit("unclassified"))


def correction(text: Column) -> Column:
    """struct(kind, confidence) of a user turn, null where no rule matches."""
    out = F.lit(None).cast("struct<kind: string, confidence: double>")
    for kind, confidence, tests in reversed(P.CORRECTIONS):
        # Patterns that begin a text pass over white space before it; one evaluation each, no trimmed copy.
        anchored = (x.replace("(?i)^", "(?i)" + LEADING_SPACE.removesuffix("+") + "*", 1) if x.startswith("(?i)^") else x for x in tests)
        fits = reduce(lambda a, b: a & b, (text.rlike(x) for x in anchored))
        out = F.when(fits, F.struct(F.lit(kind).alias("kind"), F.lit(confidence).alias("confidence"))).otherwise(out)
    return out


def interruption_reason(text: Column) -> Column:
    return F.when(text.rlike(P.INTERRUPT_REJECT), "correction").when(text.rlike(P.INTERRUPT_PIVOT), "pivot").otherwise("unknown")


def prompt_template(text: Column) -> Column:
    """A prompt with what varies taken out: code, paths, numbers, hex ids, white space, case. The order matters:
    numbers go before hex ids, single backticks before fences."""
    steps = ((r"`[^`]*`", "<code>"), (r"```[\s\S]*?```", "<code>"), (r"(?:/[A-Za-z0-9._-]+)+", "<path>"), (r"[0-9]+", "<n>"), (r"(?i)(?<![A-Za-z0-9_])[0-9a-f]{8,}(?![A-Za-z0-9_])", "<id>"), (r"\s+", " "))
    return F.lower(F.trim(reduce(lambda t, s: F.regexp_replace(t, *s), steps, F.trim(text))))


def words(text: Column) -> Column:
    """Search tokens: lower case, marks folded off Latin letters, split at everything that is no letter or digit."""
    return F.regexp_extract_all(fold(F.lower(F.coalesce(text, F.lit("")))), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))


def _folding() -> tuple[str, str]:
    """Letters that are an ASCII letter with one mark, and those letters; marks that stand alone are at the end of the
    first and have nothing in the second. Letters with two marks, and other scripts, stay as they are."""
    apart = ((chr(c), unicodedata.normalize("NFD", chr(c))) for c in range(0xC0, 0x2000))
    pairs = [(c, d[0]) for c, d in apart if len(d) == 2 and d[0].isascii() and d[0].islower() and unicodedata.combining(d[1])]
    return "".join(c for c, _ in pairs) + "".join(map(chr, range(0x300, 0x370))), "".join(d for _, d in pairs)


MARKED, FOLDED = _folding()


def fold(text: Column) -> Column:
    return F.translate(text, MARKED, FOLDED)
