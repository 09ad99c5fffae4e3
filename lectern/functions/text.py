"""Column functions on text and times. White space, case and word edges are Unicode's throughout."""

from __future__ import annotations

import unicodedata

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

#: White space in Java's and RE2's regular expressions alike.
SPACE = r"[\t\n\x0b\f\r \x1c-\x1f\x{85}\p{Z}]"
#: Line boundaries besides CR LF.
BREAK = r"\r\n|[\n\r\x0b\f\x1c-\x1e\x{85}\x{2028}\x{2029}]"
# Words of slugs that titles write in capitals.
ACRONYMS = ("iam", "ec2", "s3", "vpc", "ebs", "efs", "alb", "nlb", "rds", "sns", "sqs", "kms", "sts", "cli", "sdk", "api", "aws", "ecs", "eks")


def _col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def folded(text: str) -> str:
    """Lower case without accents: decomposed, non-spacing marks dropped, and đ as d, which doesn't decompose."""
    if text.isascii():
        return text.lower()
    apart = unicodedata.normalize("NFD", text)
    return "".join(c for c in apart if unicodedata.category(c) != "Mn").lower().replace("đ", "d")


@F.arrow_udf(StringType())
def fold(a: pa.Array) -> pa.Array:
    """:func:`folded` of a column; null for null."""
    return pa.array([None if x is None else folded(x) for x in a.to_pylist()], pa.string())


def strip(c: str | Column) -> Column:
    return F.regexp_replace(_col(c), rf"^{SPACE}+|{SPACE}+$", "")


def one_line(c: str | Column) -> Column:
    """Lines joined by a space each, without white space around."""
    return strip(F.regexp_replace(_col(c), BREAK, " "))


def tokens(c: str | Column) -> Column:
    """What white space parts; no empty ones."""
    return F.filter(F.split(_col(c), rf"{SPACE}+"), lambda x: x != "")


def ngrams(words: Column, most: int = 3) -> Column:
    """All runs of 1 to ``most`` words, joined by a space."""

    def of(w: Column, n: int) -> Column:
        at = F.sequence(F.lit(1), F.greatest(F.size(w) - n + 1, F.lit(1)))
        return F.when(F.size(w) >= n, F.transform(at, lambda i: F.array_join(F.slice(w, i, n), " "))).otherwise(F.array().cast("array<string>"))

    # bound by an array of one, so that the words are made once and not for every run
    return F.transform(F.array(words), lambda w: F.concat(*[of(w, n) for n in range(1, most + 1)]))[0]


def digit_runs(c: str | Column) -> Column:
    return F.regexp_extract_all(_col(c), F.lit(r"(?U)(\d+)"), 1)


def slugify(c: str | Column, longest: int = 80) -> Column:
    """Folded letters and digits with a hyphen between, at most ``longest`` characters; ``video`` if none is left."""
    x = F.regexp_replace(F.regexp_replace(fold(_col(c)), "[^a-z0-9]+", "-"), "^-+|-+$", "")
    x = F.regexp_replace(F.substring(x, 1, longest), "-+$", "")
    return F.when(_col(c).isNotNull(), F.when(x == "", F.lit("video")).otherwise(x))


def title_of(slug: str | Column) -> Column:
    """Words of a slug with their first letter in capitals, acronyms wholly."""
    words = F.filter(F.split(F.translate(_col(slug), "_", "-"), "-"), lambda w: w != "")
    upper = F.transform(words, lambda w: F.when(F.lower(w).isin(*ACRONYMS), F.upper(w)).otherwise(F.concat(F.upper(F.substring(w, 1, 1)), F.substring(w, 2, (1 << 31) - 1))))
    return F.array_join(upper, " ")


def millis(seconds: str | Column) -> Column:
    """Whole milliseconds, halves to even, never below 0."""
    return F.greatest(F.lit(0), F.rint(_col(seconds) * 1000).cast("bigint"))


def srt_time(seconds: str | Column) -> Column:
    ms = millis(seconds)
    whole = F.floor(ms / 1000)
    return F.format_string("%02d:%02d:%02d,%03d", F.floor(whole / 3600), F.floor(whole / 60) % 60, whole % 60, ms % 1000)


def clock(seconds: str | Column) -> Column:
    """Hours, minutes and seconds, halves to even."""
    s = F.greatest(F.lit(0), F.rint(_col(seconds)).cast("bigint"))
    return F.format_string("%02d:%02d:%02d", F.floor(s / 3600), F.floor(s / 60) % 60, s % 60)


def duration(seconds: str | Column) -> Column:
    """As people write it: 1h05m20s, 46m12s, 20s; 0s for null and what isn't above 0."""
    c = _col(seconds)
    s = F.rint(c).cast("bigint")
    h, m = F.floor(s / 3600), F.floor(s / 60) % 60
    x = F.when(h > 0, F.format_string("%dh%02dm%02ds", h, m, s % 60)).when(m > 0, F.format_string("%dm%02ds", m, s % 60)).otherwise(F.format_string("%ds", s))
    return F.when(c.isNull() | (c <= 0), F.lit("0s")).otherwise(x)


def salvage_json(c: str | Column) -> Column:
    """The text where it is JSON, else what stands from its first to its last brace where that is; null otherwise."""
    x = _col(c)
    inner = F.regexp_extract(x, r"(?s)\{.*\}", 0)
    valid = lambda t: F.try_parse_json(t).isNotNull()
    return F.when(valid(x), x).when(valid(inner), inner)
