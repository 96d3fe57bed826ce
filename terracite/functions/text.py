"""Column expressions over names and texts.

All are built-in functions, so they stay in generated code; only ``normalize_name`` takes an Arrow function, for names
that are not ASCII, as Spark has no Unicode decomposition.
"""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from terracite import vocab


@F.pandas_udf(T.StringType())
def _decomposed(names: pd.Series) -> pd.Series:
    def bare(x: str | None) -> str | None:
        return None if x is None else "".join(c for c in unicodedata.normalize("NFKD", x) if not "̀" <= c <= "ͯ")

    return names.map(bare, na_action="ignore")


def trimmed(c: Column) -> Column:
    """Without white space of any kind at the ends."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def _spaced(c: Column) -> Column:
    return F.trim(F.regexp_replace(F.regexp_replace(c, r"[\p{P}\p{S}]+", " "), r"(?U)\s+", " "))


def normalize_name(c: Column, unicode: bool = False) -> Column:
    """Lower case, without marks of accent, punctuation and symbols as single spaces. Null stays null.

    unicode: names may hold more than ASCII. Such names alone go through Python.
    """
    low = trimmed(F.lower(c))
    if not unicode:
        return _spaced(low)
    return _spaced(F.when(low.rlike(r"^[\x00-\x7F]*$"), low).otherwise(_decomposed(low)))


def grams(c: Column, n: int) -> Column:
    """Distinct character n-grams of a text with n - 1 spaces at both ends; empty for an empty text."""
    padded = F.concat(F.lit(" " * (n - 1)), c, F.lit(" " * (n - 1)))
    every = F.transform(F.sequence(F.lit(1), F.length(padded) - (n - 1)), lambda i: F.substring(padded, i, F.lit(n)))
    return F.when(F.length(c) > 0, F.array_distinct(every)).otherwise(F.array().cast("array<string>"))


def dice(a: Column, b: Column) -> Column:
    """Twice the shared members over all members of two sets; 0 where either is empty."""
    total = F.size(a) + F.size(b)
    return F.when((F.size(a) > 0) & (F.size(b) > 0), 2.0 * F.size(F.array_intersect(a, b)) / total).otherwise(0.0)


def similarity(a: Column, b: Column) -> Column:
    """Dice of the distinct trigrams of two names."""
    return dice(grams(a, 3), grams(b, 3))


def tokens_of(c: Column) -> Column:
    """Estimated tokens: a quarter of the characters, rounded up."""
    return F.ceil(F.length(c) / 4)


def quoted(c: Column) -> Column:
    """A pattern that matches the text itself."""
    return F.regexp_replace(c, r"([\\.\[\]{}()<>*+\-=!?^$|])", r"\\$1")


def word_pattern(needle: Column) -> Column:
    return F.concat(F.lit(r"(?iu)(^|[^\p{L}\p{N}])"), quoted(needle), F.lit(r"(?=$|[^\p{L}\p{N}])"))


def has_word(text: Column, needle: Column) -> Column:
    """Whether the text holds the needle, in any case, with no letter or digit beside it. False for an empty needle."""
    return F.coalesce((F.length(needle) > 0) & F.regexp(text, word_pattern(needle)), F.lit(False))


def words_of(c: Column) -> Column:
    """The distinct runs of letters and digits of a text, folded so that runs which ``has_word`` takes for equal are equal."""
    folded = lambda w: F.replace(F.lower(F.upper(F.lower(w))), F.lit("\u0307"), F.lit(""))  # noqa: E731  a lower-case İ has a dot of its own
    return F.array_distinct(F.transform(F.regexp_extract_all(c, F.lit(r"[\p{L}\p{N}]+"), F.lit(0)), folded))


def replace_word(text: Column, needle: Column, by: Column) -> Column:
    return F.when(F.length(needle) > 0, F.regexp_replace(text, word_pattern(needle), F.concat(F.lit("$1"), by))).otherwise(text)


def excerpt(text: Column, needle: Column, width: int = 500) -> Column:
    """A window of ``width`` characters about the first place of the needle, with … where it was cut."""
    at = F.instr(F.lower(text), F.lower(needle))
    middle = F.when(at > 0, at - 1 + F.floor(F.length(needle) / 2)).otherwise(F.lit(0))
    start = F.greatest(F.lit(0), F.least(middle - width // 2, F.length(text) - width)).cast("int")
    body = F.trim(F.substring(text, start + 1, F.lit(width)))
    return F.concat(F.when(start > 0, "…").otherwise(""), body, F.when(start + width < F.length(text), "…").otherwise(""))


def clip(text: Column, width: int) -> Column:
    """At most ``width`` characters, the last of them … where more was there."""
    return F.when(F.length(text) <= width, text).otherwise(F.concat(F.rtrim(F.substring(text, 1, width - 1)), F.lit("…")))


def clip_around(text: Column, needle: Column, width: int = 220) -> Column:
    """``width`` characters that begin a third of a window before the needle."""
    at = F.instr(F.lower(text), F.lower(needle)) - 1
    start = F.greatest(F.lit(0), at - width // 3).cast("int")
    cut = F.concat(F.when(start > 0, "…").otherwise(""), F.trim(F.substring(text, start + 1, F.lit(width))), F.when(start + width < F.length(text), "…").otherwise(""))
    return F.when((at < 0) | (F.length(text) <= width), clip(text, width)).otherwise(cut)


def trim_sentence(c: Column, n: int) -> Column:
    """At most n characters, ended after the last sentence beyond the half, else at the last space beyond a third."""
    text = F.trim(c)
    head = F.substring(text, 1, n)
    stop = F.length(head) - F.instr(F.reverse(head), " .") - 1
    space = F.length(head) - F.instr(F.reverse(head), " ")
    has_stop, has_space = F.instr(F.reverse(head), " .") > 0, F.instr(F.reverse(head), " ") > 0
    return (
        F.when(F.length(text) <= n, text)
        .when(has_stop & (stop > n / 2), F.substring(head, F.lit(1), (stop + 1).cast("int")))
        .when(has_space & (space > n / 3), F.concat(F.substring(head, F.lit(1), space.cast("int")), F.lit("…")))
        .otherwise(head)
    )


def clock(seconds: Column) -> Column:
    s = F.floor(seconds).cast("int")
    two = lambda x: F.lpad(x.cast("int").cast("string"), 2, "0")
    return F.when(s >= 3600, F.concat_ws(":", two(F.floor(s / 3600)), two(F.floor(s % 3600 / 60)), two(s % 60))).otherwise(F.concat_ws(":", two(F.floor(s / 60)), two(s % 60)))


def time_range(a: Column, b: Column) -> Column:
    """``mm:ss-mm:ss``, or with hours; only the start where the end is null; null without a start."""
    return F.when(a.isNull(), None).when(b.isNull(), clock(a)).otherwise(F.concat_ws("-", clock(a), clock(b)))


def strip_honorifics(c: Column) -> Column:
    titles = F.array(*[F.lit(t) for t in vocab.HONORIFICS])
    return F.array_join(F.filter(F.split(c, " "), lambda t: ~F.array_contains(titles, t)), " ")


def surname(c: Column) -> Column:
    """Last word, if it has two characters or more."""
    last = F.element_at(F.split(F.trim(c), " "), -1)
    return F.when(F.length(last) >= 2, last)


def _best_pair(a: Column, b: Column, least_a: int, least_b: int) -> Column:
    long = lambda c, n: F.filter(F.split(c, " "), lambda t: F.length(t) >= n)
    return F.coalesce(F.array_max(F.flatten(F.transform(long(a, least_a), lambda x: F.transform(long(b, least_b), lambda y: similarity(x, y))))), F.lit(0.0))


def person_anchor_method(raw: Column, canonical: Column, anchor: Column) -> Column:
    """How a person's name matches an anchor: exact, anchor_inferred (surname, whole name or a token alike), or null.

    The three are normalized names.
    """
    r, c, a = strip_honorifics(raw), strip_honorifics(canonical), strip_honorifics(anchor)
    s = surname(a)
    last = lambda x: F.coalesce((surname(x) == s) | (similarity(surname(x), s) >= 0.40), F.lit(False))
    whole = lambda x: similarity(x, a) >= 0.35
    token = lambda x: _best_pair(a, x, 3, 2) >= 0.45
    return F.when((raw == anchor) | (canonical == anchor) | (r == a) | (c == a), "exact").when(last(r) | last(c) | whole(r) | whole(c) | token(r) | token(c), "anchor_inferred")


def org_anchor_method(raw: Column, canonical: Column, anchor: Column) -> Column:
    """How an organization's name matches an anchor: exact, anchor_inferred, or null."""
    alike = lambda x: (similarity(x, anchor) >= 0.55) | (_best_pair(anchor, x, 3, 3) >= 0.60)
    return F.when((raw == anchor) | (canonical == anchor), "exact").when(alike(raw) | alike(canonical), "anchor_inferred")


def relation_from_title(c: Column) -> Column:
    """Relation type that a job title implies, or null."""
    low = F.lower(F.trim(c))
    out = F
    for kind, pattern in vocab.TITLE_RELATIONS:
        out = out.when(low.rlike(pattern), kind)
    return out


_BLANK = r"[\s&&[^\n]]"
#: White space at either end of a line; a run inside a line is left at once.
_ENDS = rf"(?U)(?<!{_BLANK}){_BLANK}++(?=\n|\z)|(?<=\n|\A){_BLANK}++"
_CAPITAL, _LETTER = "A-ZÁÉÍÓÚÜÑ", "a-záéíóúüñA-ZÁÉÍÓÚÜÑ"
#: What a line of a question, of either side of questions and answers, and of a speaker begins with; within a line of a whole text.
ASKS = r"(?i:Q|P|Pregunta|Question)[^\S\n]*:"
ANSWERS = r"(?i:A|R|Respuesta|Answer)[^\S\n]*:"
ASKS_OR_ANSWERS = r"(?i:Q|P|Pregunta|Question|A|R|Respuesta|Answer)[^\S\n]*:"
SPEAKS = rf"[{_CAPITAL}][{_LETTER}]+([^\S\n][{_CAPITAL}][{_LETTER}]+)*[^\S\n]*:"


def trimmed_lines(c: Column) -> Column:
    """A text of which every line is without white space at its ends."""
    return F.regexp_replace(c, _ENDS, "")


def structure(c: Column) -> Column:
    """qa_structured, speaker_transcript, article_style or freeform, by the lines of a text."""
    return structure_of(trimmed_lines(c), c)


def structure_of(lines: Column, c: Column) -> Column:
    """``structure`` of a text whose trimmed lines are known. Only texts with a colon have their lines counted."""
    count = lambda p: F.regexp_count(lines, F.lit(p))
    speaks = count(rf"(?dm)^{SPEAKS}")
    article = F.when(F.contains(c, F.lit("\n\n")) & ~lines.rlike(r"\A\n*\z"), "article_style").otherwise("freeform")
    labelled = F.when(count(rf"(?dm)^{ASKS}") >= 2, "qa_structured").when((speaks >= 3) & (speaks >= 0.1 * count(r"[^\n]+")), "speaker_transcript")
    return F.when(F.contains(c, F.lit(":")), F.coalesce(labelled, article)).otherwise(article)


def valid_from(date: Column, precision: Column) -> Column:
    """Lower bound of a validity interval; null is unbounded."""
    return F.when(precision != "unknown", date)


def valid_to(date: Column, precision: Column, state: Column) -> Column:
    """Upper bound; an unknown end is unbounded only while the state is active."""
    return F.when(~((precision == "unknown") & (state == "active")), date)


def freshness(ts: Column, as_of: Column) -> Column:
    """fresh below 6 calendar months, stale below 12, else old; unknown for a null time."""
    months = (F.year(as_of) - F.year(ts)) * 12 + F.month(as_of) - F.month(ts)
    return F.when(ts.isNull(), "unknown").when(months < 6, "fresh").when(months < 12, "stale").otherwise("old")


def degraded(from_precision: Column, to_precision: Column) -> Column:
    """Whether a bound of the interval is not exact."""
    return (F.coalesce(from_precision, F.lit("unknown")) != "exact") | (F.coalesce(to_precision, F.lit("unknown")) != "exact")


def link_kind(origin: Column) -> Column:
    return F.when(origin.isin(*vocab.ANCHOR_ORIGINS), "anchor").otherwise("source_entity")


def role_label(link: Column) -> Column:
    known = F.create_map(*[F.lit(v) for kv in vocab.LINK_LABELS.items() for v in kv])
    return F.coalesce(F.try_element_at(known, link), F.initcap(F.translate(link, "_", " ")))


def role_order(link: Column, origin: Column) -> Column:
    known = F.create_map(*[F.lit(v) for kv in vocab.ANCHOR_PLACES.items() for v in kv])
    return F.when(origin.isin(*vocab.ANCHOR_ORIGINS), F.coalesce(F.try_element_at(known, link), F.lit(4))).otherwise(5)


def metadata_summary(c: Column) -> Column:
    """The lists of a JSON object's roles, facts and topics as one line."""
    parsed = F.from_json(c, "roles array<string>, facts array<string>, topics array<string>")
    part = lambda label, field: F.when(F.size(parsed[field]) > 0, F.concat(F.lit(f"{label}: "), F.array_join(parsed[field], ", ")))
    return F.concat_ws(" | ", part("Roles", "roles"), part("Facts", "facts"), part("Topics", "topics"))


def anchor_variants(c: Column) -> Column:
    """An anchor's own spelling and the one without punctuation, of three characters or more, the longest first."""
    plain = F.trim(F.regexp_replace(F.regexp_replace(c, r"[\p{P}\p{S}]+", " "), r"\s+", " "))
    kept = F.array_distinct(F.filter(F.array(F.trim(c), plain), lambda v: F.length(v) >= 3))
    return F.array_sort(kept, lambda a, b: F.length(b) - F.length(a))


def question_scope(c: Column) -> Column:
    return F.when(c.rlike(f"(?i){vocab.ONE_SOURCE}"), "this_interview").when(c.rlike(f"(?i){vocab.ONE_PROJECT}"), "this_project").otherwise("global")


def title_from_text(c: Column, width: int = 80) -> Column:
    """First line that is not blank, cut to ``width``; a default where there is none."""
    line = F.get(F.filter(F.transform(F.split(c, "\n"), trimmed), lambda x: F.length(x) > 0), F.lit(0))
    return F.coalesce(F.when(F.length(line) > width, F.concat(F.substring(line, 1, width - 1), F.lit("…"))).otherwise(line), F.lit("New conversation"))


def speaker_label(code: Column, names: Column) -> Column:
    """Display name of a speaker's code from a map; ``Speaker <code>`` for one-letter codes, else the code itself."""
    known = F.nullif(F.trim(F.try_element_at(names, code)), F.lit(""))
    return F.coalesce(known, F.when(F.length(code) <= 2, F.concat(F.lit("Speaker "), code)).otherwise(code))


def shares_token(a: Column, b: Column, least: int = 4) -> Column:
    """Whether two names share, in any case, a word of at least four characters that is no stop word."""
    stop = F.array(*[F.lit(w) for w in vocab.STOP_WORDS])
    words = lambda c: F.filter(F.split(F.lower(c), r"\s+"), lambda w: (F.length(w) >= least) & ~F.array_contains(stop, w))
    return F.coalesce(F.arrays_overlap(words(a), words(b)), F.lit(False))
