"""Reading names and roles out of a line of text, token by token.

A line is cut into words (runs of ASCII letters, digits and ``_``), white space and runs of anything else, so that the
tokens joined give the line again. A reader looks for a lead phrase, whose words stand with white space between and
behind them, and takes what follows: a name as far as its characters go, a role up to the first stop word.
Everything is array and string functions of Spark SQL; nothing runs in Python a row.

null and empty lines have no tokens and give null; of several lead phrases the leftmost with a proper follower counts.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from trackwise import fixed
from trackwise.functions import patterns as P


def bind(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is worked out once a row."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def tokens(line: Column) -> Column:
    return F.regexp_extract_all(line, F.lit(P.TOKEN), F.lit(0))


def _places(t: Column) -> Column:
    return F.sequence(F.lit(1), F.greatest(F.size(t), F.lit(1)))


def _from(t: Column, j: Column) -> Column:
    """The line from token ``j`` on."""
    return F.array_join(F.slice(t, j, F.size(t)), "")


def _led(t: Column, j: Column, phrases: list[str], any_case: bool) -> Column:
    """Whether one of ``phrases`` ends right before token ``j``."""
    found = F.lit(False)
    for n in sorted({len(p.split()) for p in phrases}):
        before = F.regexp_replace(F.array_join(F.slice(t, F.greatest(j - 2 * n, F.lit(1)), F.lit(2 * n)), ""), P.WS + "+", " ")
        before = F.lower(before) if any_case else before
        found = found | ((j > 2 * n) & before.isin(*[p + " " for p in phrases if len(p.split()) == n]))
    return found


def _first(t: Column, reader: Callable[[Column], Column], proper: Callable[[Column], Column]) -> Column:
    """The leftmost text that ``reader`` gives for a token's place and that is ``proper``."""
    return F.get(F.filter(F.transform(_places(t), reader), proper), F.lit(0))


def name_after(t: Column, phrases: list[str], any_case: bool = True) -> Column:
    """The name behind a lead phrase: two or more characters that names have, a letter or digit first (a capital, where
    the case of the phrase counts)."""
    head = "^[A-Za-z0-9]." if any_case else "^[A-Z]."
    return _first(
        t,
        lambda j: F.when(_led(t, j, phrases, any_case), F.regexp_extract(_from(t, j), P.NAME_HEAD, 0)),
        lambda name: name.rlike(head),
    )


def _without_article(t: Column, j: Column, any_case: bool) -> Column:
    """The line from token ``j`` on, without a leading "the" that something follows."""
    word = F.lower(F.get(t, j - 1)) if any_case else F.get(t, j - 1)
    return F.when((word == "the") & (F.size(t) >= j + 2) & F.get(t, j).rlike(P.WS), _from(t, j + 2)).otherwise(_from(t, j))


def rest_after(t: Column, phrases: list[str]) -> Column:
    """All that follows a lead phrase and an article."""
    return _first(t, lambda j: F.when(_led(t, j, phrases, True), _without_article(t, j, True)), lambda x: x != "")


def rest_after_label(t: Column, labels: list[str]) -> Column:
    """All that follows a label word and its colon or hyphen."""

    def reader(j: Column) -> Column:
        behind = F.regexp_replace(_from(t, j + 1), "^" + P.WS + "+", "")
        value = F.regexp_replace(F.substring(behind, 2, 1 << 30), "^" + P.WS + "+", "")
        return F.when(F.lower(F.get(t, j - 1)).isin(*labels) & F.substring(behind, 1, 1).isin(":", "-"), value)

    return _first(t, reader, lambda x: x != "")


def phrase_after(t: Column, word: str) -> Column:
    """The last part of a line behind ``word`` (case counts): a capital first, and no mark that ends a phrase."""
    return _first(
        t,
        lambda j: F.when(_led(t, j, [word], False), _without_article(t, j, False)),
        lambda x: x.rlike("^[A-Z]") & (F.translate(x, fixed.PHRASE_END_MARKS, "") == x),
    )


def until_stop(line: Column, stops: list[str]) -> Column:
    """The line up to the first stop word: one that white space precedes, or one glued to the letters before it (the
    space was lost); ``@`` stops where a word follows it directly."""

    def kept(u: Column, w: Column, i: Column) -> Column:
        """What stays of token ``i`` if the line ends in it, else null."""
        before = F.when(i > 0, F.get(u, i - 1))
        spaced = before.rlike(P.WS + "\\z")
        word = F.lower(w)
        out = F.when(word.isin(*[s for s in stops if s != "@"]) & spaced, "")
        if "@" in stops:
            out = out.when((w == "@") & (spaced | before.rlike("[A-Za-z]\\z")) & F.get(u, i + 1).rlike("^[A-Za-z0-9_]"), "")
        for s in stops:
            if s != "@":
                stem = F.substring(w, F.lit(1), F.length(w) - len(s))
                out = out.when(word.endswith(s) & stem.rlike("[A-Za-z]\\z"), stem)
        return out

    def cut(u: Column, ends: Column) -> Column:
        k = F.get(F.filter(_places(u), lambda k: F.get(ends, k - 1).isNotNull()), F.lit(0))
        return bind(
            k, lambda k: F.when(k.isNull(), F.array_join(u, "")).otherwise(
                F.concat(F.array_join(F.slice(u, F.lit(1), F.coalesce(k, F.lit(1)) - 1), ""), F.get(ends, k - 1))
            )
        )

    return bind(tokens(line), lambda u: bind(F.transform(u, lambda w, i: kept(u, w, i)), lambda ends: cut(u, ends)))


def names_behind(text: Column, phrase: str) -> Column:
    """The leftmost name that stands behind ``phrase`` anywhere in a long text, which is cut at the phrase instead of
    into tokens."""
    parts = F.split(text, "(?i)" + P.escape(phrase))
    names = F.transform(
        F.slice(parts, F.lit(2), F.size(parts)),
        lambda p: F.when(p.rlike("^" + P.WS), F.regexp_extract(F.regexp_replace(p, "^" + P.WS + "+", ""), P.NAME_HEAD, 0)),
    )
    return F.get(F.filter(names, lambda n: n.rlike("^[A-Za-z].")), F.lit(0))
