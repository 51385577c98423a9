"""Text columns: white space, counting, captures, first-match defaults."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Unicode white space and the four ASCII separators, as Java's regular expressions write it.
WHITE_SPACE = r"[\t-\r\x1c-\x20\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]+"


def flat(text: Column) -> Column:
    """Runs of white space as one space."""
    return F.regexp_replace(text, WHITE_SPACE, " ")


def literal(term: str) -> str:
    """A pattern that matches the term itself, in Java's and RE2's dialect."""
    return "".join("\\" + c if c in r"\.^$|?*+()[]{}-" else c for c in term)


def folded(text: Column) -> Column:
    """Lower case in which a pattern finds what it does regardless of case: the long s is an s, the dotted capital and the dotless i are an i."""
    return F.lower(F.translate(text, "\u0130\u0131\u017f", "iis"))


def occurrences(low: Column, term: str) -> Column:
    """Non-overlapping occurrences of an ASCII term in a folded text."""
    term = term.lower()
    return F.floor((F.length(low) - F.length(F.replace(low, F.lit(term), F.lit("")))) / len(term)).cast("long")


def count(text: Column, body: str) -> Column:
    """Non-overlapping matches, whatever their case."""
    return F.regexp_count(text, F.lit("(?iu)" + body))


def has(text: Column, body: str) -> Column:
    return F.rlike(text, F.lit("(?iu)" + body))


def required(body: str) -> str:
    """The longest string that every match of a simple pattern holds, empty where none is known.

    Classes, groups, dots and what a quantifier follows hold none; an alternative at any level leaves nothing.
    """
    if re.search(r"[|()\\]", body):
        return ""
    plain = re.sub(r"(\[[^]]*\]|.)(\{[^}]*\}|[*+?])|\[[^]]*\]|[.^$]", "\0", body)
    return max(plain.split("\0"), key=len)


def count_folded(low: Column, body: str) -> Column:
    """As ``count``, in a folded text; a text without what the pattern needs isn't searched."""
    need = required(body)
    if need == body:
        return occurrences(low, body)
    found = F.regexp_count(low, F.lit(body))
    return F.when(F.contains(low, F.lit(need)), found).otherwise(F.when(low.isNotNull(), F.lit(0))) if need else found


def has_folded(low: Column, body: str) -> Column:
    """As ``has``, in a folded text."""
    need = required(body)
    there = F.contains(low, F.lit(need))
    return there if need == body else there & F.rlike(low, F.lit(body)) if need else F.rlike(low, F.lit(body))


def any_word(text: Column, words: Sequence[str], lowered: bool = False) -> Column:
    """Whether one of the words is a substring of the text, whatever its case; ``lowered``: the text is in lower case."""
    low = text if lowered else F.lower(text)
    out = F.lit(False)
    for w in words:
        out = out | F.contains(low, F.lit(w.lower()))
    return out


def first_filled(*columns: Column) -> Column:
    """The first that is neither null nor empty."""
    return F.coalesce(*(F.nullif(c, F.lit("")) for c in columns))


def safe_key(text: Column, most: int, collapse: bool = False) -> Column:
    """Characters outside ``[A-Za-z0-9._-]`` as ``_``, one each or one a run, cut at ``most``."""
    return F.substring(F.regexp_replace(text, r"[^A-Za-z0-9._-]" + ("+" if collapse else ""), "_"), 1, most)


def title_guess(text: Column, lines: int, longest: int, cut: int, stop: Sequence[str] = (), default: Column | None = None) -> Column:
    """The first of the leading lines that looks like a title: over 18 and under ``longest`` characters, no stop word in front."""
    trimmed = F.transform(F.slice(F.split(text, "\n"), 1, lines), lambda x: F.trim(x))

    def fits(x: Column) -> Column:
        ok = (F.length(x) > 18) & (F.length(x) < longest)
        for s in stop:
            ok = ok & ~F.lower(x).startswith(s)
        return ok

    found = F.get(F.filter(trimmed, fits), F.lit(0))
    return F.substring(F.coalesce(found, default if default is not None else F.lit("")), 1, cut)


def frame_list(spec: Column) -> Column:
    """``range:start:stop:step`` (stop exclusive) or a comma list of numbers as an array; null for what is neither."""
    part = lambda k: F.split_part(spec, F.lit(":"), F.lit(k)).try_cast("long")
    start, stop, step = part(2), part(3), part(4)
    ranged = F.when((step > 0) & (stop > start), F.filter(F.sequence(start, F.greatest(stop, start), F.greatest(step, F.lit(1).cast("long"))), lambda x: x < stop))
    listed = F.transform(F.split(spec, ","), lambda x: F.trim(x).try_cast("long"))
    empty = F.array().cast("array<bigint>")
    return F.when(spec.startswith("range:"), F.when((step > 0) & (stop <= start), empty).otherwise(ranged)).otherwise(F.when(F.forall(listed, lambda x: x.isNotNull()), listed))


def numbers(text: Column) -> Column:
    """The numbers of a text that white space parts, as doubles; null for what is none."""
    return F.transform(F.split(F.trim(F.regexp_replace(text, r"\s+", " ")), " "), lambda x: x.try_cast("double"))


def intrinsics(cells: Column) -> Column:
    """``fx fy cx cy`` (more may follow) as a 3x3 matrix by row; null if there are fewer."""
    c = lambda k: F.get(cells, F.lit(k))
    zero = F.lit(0.0)
    return F.when(F.size(cells) >= 4, F.array(c(0), zero, c(2), zero, c(1), c(3), zero, zero, F.lit(1.0)))


def device_processes(report: Column) -> Column:
    """An array ``pid, name`` of a device report's process rows, whose cells are device and chip, pid, name; a pid of 0 is no process."""
    cells = F.transform(F.split(report, r"\r?\n"), lambda line: F.transform(F.split(line, r"\|"), lambda cell: F.trim(cell)))
    place = lambda c: F.transform(F.split(F.get(c, 1), " +"), lambda x: x.try_cast("long"))
    rows = F.filter(cells, lambda c: (F.size(c) >= 5) & (F.get(c, 0) == "") & (F.size(place(c)) == 2) & F.forall(place(c), lambda x: x.isNotNull()) & (F.get(c, 3) != ""))
    return F.filter(F.transform(rows, lambda c: F.struct(F.get(c, 2).try_cast("long").alias("pid"), F.get(c, 3).alias("name"))), lambda x: x["pid"] > 0)


def csv_processes(report: Column) -> Column:
    """An array ``pid, name`` of lines ``pid, name``; blank lines are left out."""
    lines = F.filter(F.split(report, r"\r?\n"), lambda x: F.trim(x) != "")
    return F.transform(lines, lambda x: F.struct(F.trim(F.split_part(x, F.lit(","), F.lit(1))).try_cast("long").alias("pid"), F.trim(F.substring_index(x, ",", -1)).alias("name")))


def local_time(ts: Column, hours: int) -> Column:
    """A UTC time stamp as ISO with the offset of a zone ``hours`` from it."""
    shifted = ts + F.expr(f"INTERVAL '{hours}' HOUR")
    return F.concat(F.date_format(shifted, "yyyy-MM-dd'T'HH:mm:ss"), F.lit(f"{hours:+03d}:00"))
