"""Column functions for names and texts. Case folding here is ASCII only, as the filter language defines it."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = "abcdefghijklmnopqrstuvwxyz"


def ascii_fold(c: Column) -> Column:
    """A-Z lower-cased; lower() would also fold letters such as the Kelvin sign."""
    return F.translate(c, UPPER, LOWER)


def fold_text(s: str) -> str:
    return s.translate(str.maketrans(UPPER, LOWER))


def contains_fold(c: Column, needle: str) -> Column:
    """Unanchored substring test without regard to ASCII case; the empty needle is in everything."""
    return F.contains(ascii_fold(c), F.lit(fold_text(needle)))


def glob_regex(pattern: str) -> str:
    """A Java pattern over the Latin-1 view of UTF-8 bytes for a glob of ``*`` and ``?`` (one byte each).

    Every segment between stars is matched lazily inside an atomic group, so a pattern of many stars cannot
    backtrack; each byte is written as an escape, so none has a meaning of its own.
    """

    def escaped(segment: str) -> str:
        return "".join("." if b == ord("?") else chr(b) if chr(b).isascii() and chr(b).isalnum() else f"\\x{b:02x}" for b in segment.encode("utf-8"))

    first, *others = pattern.split("*")
    out = "(?is)\\A" + escaped(first)
    if not others:
        return out + "\\z"
    for segment in others[:-1]:
        if segment:
            out += f"(?>.*?{escaped(segment)})"
    return out + ".*" + escaped(others[-1]) + "\\z"


def glob_match(c: Column, pattern: str) -> Column:
    """Anchored glob match, without regard to ASCII case."""
    return F.rlike(F.decode(F.encode(c, "UTF-8"), "ISO-8859-1"), F.lit(glob_regex(pattern)))


def extension(name: Column) -> Column:
    """What follows the last dot; null if that is the first or last character, or there is none."""
    return F.nullif(F.regexp_extract(name, r"(?s)^.+\.([^.]+)$", 1), F.lit(""))


def normalize_key(path: Column, fold_case: bool = False) -> Column:
    """The key that usage and hash records share: backslashes as slashes, on request in lower case."""
    key = F.translate(path, "\\", "/")
    return F.lower(key) if fold_case else key


def human(size: Column) -> Column:
    """A size for people; unknown is ``-``. Halves round to even, and a unit never rolls over."""
    v = size.cast("double")

    def in_unit(power: int, unit: str) -> Column:
        return F.format_string(f"%.1f {unit}", F.bround(v / 1024.0**power, 1))

    return (
        F.when(size.isNull(), F.lit("-"))
        .when(v < 1024, F.concat(size.cast("string"), F.lit(" B")))
        .when(v < 1024.0**2, in_unit(1, "KB"))
        .when(v < 1024.0**3, in_unit(2, "MB"))
        .when(v < 1024.0**4, in_unit(3, "GB"))
        .otherwise(in_unit(4, "TB"))
    )


def ago(seconds: Column) -> Column:
    """How long ago, in words; times to come count as now, months have 30 days."""
    s = F.greatest(seconds.cast("long"), F.lit(0).cast("long"))

    def whole(n: int, word: str) -> Column:
        return F.concat(F.floor(s / n).cast("string"), F.lit(word))

    return F.when(s < 60, F.lit("방금")).when(s < 3600, whole(60, "분 전")).when(s < 86400, whole(3600, "시간 전")).when(s < 2592000, whole(86400, "일 전")).otherwise(whole(2592000, "개월 전"))


def decayed(score: Column, seconds: Column, half_life_days: float) -> Column:
    """A score after so many seconds; it never grows."""
    h = max(half_life_days, 0.001) * 86400.0
    return score * F.pow(F.lit(0.5), F.greatest(seconds.cast("double"), F.lit(0.0)) / F.lit(h))


def filetime_seconds(filetime: Column) -> Column:
    """Unix seconds of a count of 100 ns since 1601; 0 for what lies before 1970."""
    return F.greatest(F.expr("0L"), F.floor((filetime.cast("long") - F.lit(116444736000000000)) / F.lit(10000000)).cast("long"))


def volume_root(text: Column) -> Column:
    """``c:`` or ``c:\\`` as the root path ``C:\\``."""
    return F.concat(F.upper(F.regexp_replace(text, r"[\\/]+$", "")), F.lit("\\"))


def volume_device(text: Column) -> Column:
    """``c:`` or ``c:\\`` as the device ``\\\\.\\C:``."""
    return F.concat(F.lit("\\\\.\\"), F.upper(F.regexp_replace(text, r"[\\/]+$", "")))


#: All marks at the end at once. 진짜최종 is 진짜 and 최종, so no mark reads in two ways, and nothing is tried again.
VERSION_MARKS = r"(?i)(?:[ _-]*(?:최종본?|진짜|수정본?|복사본|사본|copy|final|rev|draft)|[ _-]+v\d+(?:\.\d+)*|\s*\(\d+\))++$"


def family_stem(name: Column) -> Column:
    """A name without extension and without the marks of a version at its end, however many; real numbers stay."""
    ext = extension(name)
    stem = F.when(ext.isNull(), name).otherwise(F.substring(name, F.lit(1), F.length(name) - F.length(ext) - 1))
    return F.lower(F.regexp_replace(stem, VERSION_MARKS, ""))


def family_key(name: Column) -> Column:
    """Files of one key are probably versions of one document; the extension is part of it."""
    return F.concat_ws("|", family_stem(name), F.coalesce(F.lower(extension(name)), F.lit("")))


def progress(done: Column, total: Column, seconds: Column) -> list[Column]:
    """A scan's progress as a voyage to the moon: km to go, km/h, and seconds to go."""
    left, speed = total - done, done / seconds
    return [(384400.0 * left / total).alias("km_left"), (speed * 384400.0 / total * 3600).alias("km_per_hour"), (left / speed).alias("seconds_left")]
