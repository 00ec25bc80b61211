"""Row-wise text expressions; all are Catalyst expressions."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import and_

from pyspark.sql import Column
from pyspark.sql import functions as F

from .patterns import WILDCARD, Mask, class_patterns, holds

SPACE = r"(?U)[\s\x1c-\x1f]"
LINE_BREAK = r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85\u2028\u2029]"
PLACEHOLDER = "<VAR:[A-Z0-9]+>"
_DIGIT = r"[0-9]|[^\x00-\x7f]"  # or a character that may be one
# Characters that count as digits beside decimal ones.
DIGITS = r"[\d²³¹⁰⁴-⁹₀-₉①-⑨⑴-⑼⒈-⒐⓪⓵-⓽⓿❶-❾➀-➈➊-➒]"


#: What normalising replaces, in this order, and by what.
HEX_RUN, NUMBER_RUN = (r"(?U)\b(?:0x)?[0-9A-Fa-f]{4,}\b", "#H#"), (r"(?U)\d+", "#N#")
# What scrubbing replaces, in this order, and by what.
SCRUBBED = ((r"(?U)/[\w\-_/]+", "/anon/path"), (r"[A-Za-z0-9_.-]+@[A-Za-z0-9_.-]+", "anon@example.com"), (r"(?U)hostname=[^,\s]+", "hostname=anon"))


def strip(text: Column) -> Column:
    return F.regexp_replace(text, r"(?U)^[\s\x1c-\x1f]+|[\s\x1c-\x1f]+$", "")


def is_blank(text: Column) -> Column:
    return ~text.rlike(r"(?U)[^\s\x1c-\x1f]")


def split_lines(text: Column) -> Column:
    """Lines of a text at every line break that Python knows; no line after a last break."""
    parts = F.split(text, LINE_BREAK)
    last_empty = F.element_at(parts, -1) == ""
    return F.when(last_empty, F.slice(parts, 1, F.size(parts) - 1)).otherwise(parts)


def tokens(text: Column) -> Column:
    return F.filter(F.split(text, f"{SPACE}+"), lambda x: x != "")


def _masked(mask: Mask, text: Column) -> Column:
    """text with the mask's matches replaced. The pattern is tried only where the text holds what each match holds; the text is the variable of a
    function, as it stands three times."""
    strings, digit = holds(mask)
    if not strings and not digit:
        return F.regexp_replace(text, mask.java, mask.placeholder)

    def step(t: Column) -> Column:
        tests = [t.contains(x) for x in strings] + [t.rlike(_DIGIT)] * digit
        return F.when(reduce(and_, tests), F.regexp_replace(t, mask.java, mask.placeholder)).otherwise(t)

    return F.get(F.transform(F.array(text), step), F.lit(0))


def apply_masks(text: Column, masks: Sequence[Mask]) -> Column:
    """Each mask in turn over what the ones before have left."""
    for m in masks:
        text = _masked(m, text)
    return text


def classify(token: Column) -> Column:
    """Name of the first class that the whole token matches, or null."""
    out = F.lit(None).cast("string")
    for name, pattern in reversed(class_patterns().items()):
        out = F.when(token.rlike(f"(?U){pattern}"), F.lit(name)).otherwise(out)
    return out


def mask_tokens(found: Column) -> Column:
    """Tokens of a class become <CLASS>."""
    return F.transform(found, lambda t: F.coalesce(F.concat(F.lit("<"), classify(t), F.lit(">")), t))


def key_token(token: Column) -> Column:
    """A placeholder or all-digit token is a wildcard in a bucket key."""
    variable = (token.startswith("<VAR:") & token.endswith(">")) | token.rlike(f"(?U)^{DIGITS}+$")
    return F.when(variable, WILDCARD).otherwise(token)


def bucket_key(found: Column, depth: int) -> Column:
    return F.array_join(F.transform(F.slice(found, 1, depth), key_token), " ")


def wildcards(template: Column) -> Column:
    """A typed template with every placeholder as a wildcard."""
    return F.regexp_replace(template, PLACEHOLDER, WILDCARD)


def normalise(text: Column) -> Column:
    """Hex-like runs of four or more become #H#, then numbers #N#."""
    return F.regexp_replace(F.regexp_replace(text, *HEX_RUN), *NUMBER_RUN)


def sampling_tokens(text: Column) -> Column:
    return F.regexp_extract_all(normalise(text), F.lit(r"([A-Za-z0-9_./:%@#-]+)"), F.lit(1))


def entropy(found: Column) -> Column:
    """Shannon entropy in bits of the tokens' distribution; 0 without tokens."""
    n = F.size(found).cast("double")
    share = F.transform(F.array_distinct(found), lambda t: F.size(F.filter(found, lambda u: u == t)) / n)
    return F.when(n <= 0, 0.0).otherwise(F.aggregate(share, F.lit(0.0), lambda s, p: s - p * F.log2(p)))


def jaccard(a: Column, b: Column) -> Column:
    """Jaccard similarity of two token arrays as sets; two empty ones are alike."""
    union = F.size(F.array_union(a, b))
    return F.when(union == 0, 1.0).otherwise(F.size(F.array_intersect(a, b)) / union)


def merge_tokens(a: Column, b: Column) -> Column:
    """Position by position the common token or a wildcard, as far as the shorter goes."""
    n = F.least(F.size(a), F.size(b))
    return F.zip_with(F.slice(a, F.lit(1), n), F.slice(b, F.lit(1), n), lambda x, y: F.when(x == y, x).otherwise(WILDCARD))


def pair_template(a: Column, b: Column, least: float = 0.1) -> Column:
    """Template of two token arrays, empty unless their Jaccard similarity exceeds `least`."""
    return F.when(jaccard(a, b) > least, merge_tokens(a, b)).otherwise(F.array().cast("array<string>"))


def similarity(template: Column, found: Column) -> Column:
    """Share of the template's positions that are wildcards or equal the token there."""
    n = F.least(F.size(template), F.size(found))
    same = F.zip_with(F.slice(template, F.lit(1), n), F.slice(found, F.lit(1), n), lambda t, x: ((t == x) | (t == WILDCARD)).cast("int"))
    return F.aggregate(same, F.lit(0), lambda s, x: s + x) / F.size(template)


def after_time(text: Column) -> Column:
    """What follows the first HH:MM:SS, or the whole text."""
    end = F.regexp_instr(text, F.lit(r"(?U)\d{2}:\d{2}:\d{2}"))
    return F.when(end > 0, F.substr(text, end + 8)).otherwise(text)


def scrub(text: Column) -> Column:
    """Paths, then mail addresses, then host names are replaced."""
    for pattern, by in SCRUBBED:
        text = F.regexp_replace(text, pattern, by)
    return text
