"""Predicates on one row: plausible values, junk, reserved names, searches. Null gives null unless said otherwise."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, functions as F

from tapeloom.functions import text

# Fixed values.
FILLERS = "tuning tune-up intro crowd applause banter chatter announcements encore-break set-break soundcheck outro silence filler noodling talk".split()
#: What a line with a date holds, and words of lines that are no venue's.
DATE_LIKE = "[0-9]{4}-[0-9]{2}-[0-9]{2}|[0-9]{1,2}[./-][0-9]{1,2}[./-][0-9]{2,4}"
NO_VENUE = "\\b(sbd|aud|dat|flac|shn|mp3|mics?|source|lineage|taper|taped|recorded|transfer|set|encore|disc|support|opening|opener|tour)\\b"
NO_CITY = "\\b(sbd|aud|dat|flac|shn|mics?|guitars?|bass|drums|vocals|keyboards?|piano|sax|fiddle|banjo)\\b"
CREDIT = "^(shared|recorded|taped|transferred|uploaded|seeded|mastered) by\\b"
SMALL = ("the", "and", "with", "for", "from")
DATED = "(19|20)[0-9][0-9]-[0-9][0-9]|(Jan|Feb|Mar|Apr|May|Jun|Jul|Aug|Sep|Oct|Nov|Dec)[a-z]*[.,]? [0-9]"
STATES = (
    "alabama alaska arizona arkansas california colorado connecticut delaware florida georgia hawaii idaho illinois indiana iowa kansas kentucky louisiana maine maryland massachusetts michigan minnesota mississippi missouri montana"
    " nebraska nevada ohio oklahoma oregon pennsylvania tennessee texas utah vermont virginia washington wisconsin wyoming"
).split() + ["new hampshire", "new jersey", "new mexico", "new york", "north carolina", "north dakota", "rhode island", "south carolina", "south dakota", "west virginia"]
PROGRAMS = ("exe", "bat", "scr", "com", "lnk", "vbs")
RESERVED = ("sbd", "aud", "mtx", "fm", "live")


def visible(name: Column) -> Column:
    """F-4: not hidden, not set aside."""
    return ~name.rlike("^[._]")


def reserved_prefix(name: Column) -> Column:
    """F-24."""
    return F.lower(name).rlike(f"^({'|'.join(RESERVED)})[^a-z]")


def filler(title: Column) -> Column:
    """F-5: made of filler words only, joined by signs or "and"."""
    bare = F.regexp_replace(F.lower(title), r"^[ \-–—*>~]+|[ \-–—*>~]+$", "")
    parts = F.filter(F.split(bare, r"\s*(?:[/&+,>]|\band\b)\s*"), lambda p: p != "")
    letters = lambda p: F.regexp_replace(F.regexp_replace(p, "^the ", ""), "[^a-z0-9]", "")
    return (F.size(parts) > 0) & F.forall(parts, lambda p: letters(p).isin(*[f.replace("-", "") for f in FILLERS]))


def junk_title(title: Column) -> Column:
    """F-6: a label, a file name, or mostly digits."""
    return title.rlike(r"(?i)^(set|disc|track|source|lineage)\b") | F.endswith(title, F.lit(":")) | title.rlike("(?i)[.](flac|shn|mp3|wav)") | (text.digit_share(title) > 0.5)


def junk_on_recheck(title: Column) -> Column:
    """F-7: junk, and also nothing, a placeholder, a leading time or a disc's and track's number."""
    t = F.coalesce(title, F.lit(""))
    return junk_title(t) | (F.trim(t) == "") | F.lower(F.trim(t)).rlike("^(track|untitled|unknown|title|song)[ _-]?[0-9]*$") | t.rlike("^[0-9]{1,2}:[0-9]{2}") | F.lower(t).rlike("^d[0-9]+t[0-9]+")


def _words(c: Column) -> Column:
    return F.filter(F.split(F.trim(c), r"\s+"), lambda w: w != "")


def _told(c: Column) -> Column:
    """How many of a text's words are lower case and no small ones: sentences have several, names hardly any."""
    return F.size(F.filter(_words(c), lambda w: w.rlike("^[a-z]{3,}[^A-Za-z]*$") & ~F.regexp_replace(w, "[^a-z]", "").isin(*SMALL)))


def plausible_artist(c: Column) -> Column:
    """F-8: of a name's length and letters; no markup, label, file or address, no sentence, no "City, ST" or "City, State", and without a date."""
    letters = F.length(F.regexp_replace(c, "[^A-Za-z]", ""))
    sentence = (F.endswith(c, F.lit(".")) & (F.size(_words(c)) > 1) & ~c.rlike(r"\b[A-Z]\.$")) | F.contains(c, F.lit("...")) | c.rlike("[!?]$") | c.rlike(r"([a-z]['\"]|[a-z]{3,})\. [A-Z]") | (_told(c) > 2)
    return (
        F.length(c).between(2, 60) & (letters >= 2) & ~c.rlike("[<>{}@]") & ~c.rlike(r"^[;'\"*#-]") & ~c.rlike(r"^[A-Za-z ]{2,15}:") & ~F.lower(c).rlike(CREDIT)
        & ~sentence & ~c.rlike(", [A-Z]{2}$") & ~F.lower(c).rlike(f", ({'|'.join(STATES)})[.]?$") & ~c.rlike(DATED)
    )


def plausible_venue(c: Column) -> Column:
    """F-9: of a venue's length; no date, no source word or word for nothing at its head, and no sentence."""
    return F.length(F.trim(c)).between(2, 90) & ~c.rlike("^[0-9 ./-]+$") & ~F.lower(c).rlike("^(sbd|aud|fm|mtx|unknown|tba|tbd)") & ~((F.size(_words(c)) > 5) & (_told(c) > 2))


def venue_line(c: Column) -> Column:
    """F-12: a line that may name a venue: short, begins with a capital or a digit, has no date, and speaks of no source, set, support act or tour."""
    t = F.trim(c)
    return F.length(t).between(3, 60) & t.rlike("^[A-Z0-9]") & ~t.rlike(DATE_LIKE) & ~F.lower(t).rlike(NO_VENUE) & ~t.rlike("[:>=]")


def plausible_city(c: Column) -> Column:
    """F-10."""
    digits = F.length(F.regexp_replace(c, "[^0-9]", ""))
    return F.length(F.trim(c)).between(2, 40) & ~F.lower(c).rlike(NO_CITY) & ~c.rlike("[!?;:_/@#]") & (digits <= 1) & (F.size(F.split(F.trim(c), " ")) <= 5) & c.rlike("[A-Za-z]{2}")


def archive_id(c: Column) -> Column:
    """F-13."""
    return F.length(c).between(8, 200) & ~c.rlike("[ ,()]") & c.rlike("[0-9]{4}-[0-9][0-9]-[0-9][0-9]")


def unsafe_suffix(ext: Column) -> Column:
    """F-19."""
    return ext.isin(*PROGRAMS)


def holds_all(hay: Column, search: str) -> Column:
    """F-20: every word of the search stands in the text; an empty search holds everywhere."""
    return reduce(lambda a, w: a & F.contains(hay, F.lit(w)), search.lower().split(), F.lit(True))


def suspect_flags() -> Column:
    """F-16: over the columns state, city, folder_name, venue, date, artist."""
    some = lambda c: F.coalesce(F.trim(c), F.lit("")) == ""
    return F.array_compact(
        F.array(
            F.when(some("state"), "no state"),
            F.when(F.col("city").rlike(" - |, "), "dash city"),
            F.when(~F.col("folder_name").rlike(r"\["), "no bracket"),
            F.when(F.lower("venue").rlike("(unknown|private|house|radio)"), "suspect venue"),
            F.when(F.coalesce("date", F.lit("")) == "", "no date"),
            F.when(F.lower("venue") == F.lower("city"), "repeated part"),
            F.when(~plausible_artist(F.col("artist")), "odd artist"),
        )
    )
