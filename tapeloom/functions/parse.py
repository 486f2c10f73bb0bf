"""Parsers of names and texts, as column expressions: dates, sources, ids, places, track numbers, folder names.

Where several patterns may apply, they are tried in the order of their reliability and the first that gives
a value wins (``coalesce``). Nothing found is null.
"""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from tapeloom.functions.text import blank_to_null, camel_split, clean_artist, name_case

# The months' names, in order; their short forms are the first three letters, and "sept".
MONTHS = ("january", "february", "march", "april", "may", "june", "july", "august", "september", "october", "november", "december")
# Classes of sources, best evidence first, with the words that tell of them and the endings that do.
SOURCES = (
    ("SBD.FM", ("fm", "broadcast", "broadcasts", "simulcast"), ("broadcast", "simulcast")),
    ("MTX", ("matrix", "mtx"), ()),
    ("SBD", ("sbd", "dsbd", "sdb", "board", "soundboard"), ("board",)),
    ("AUD.FOB", ("fob",), ()),
    ("AUD", ("aud", "audience", "taper", "mic", "mics", "microphone", "microphones", "omni", "omnis", "cardioid", "cardioids", "binaural"), ("audience", "taper")),
)
# How a line on who recorded begins.
TAPER_LABELS = ("taper", "taped by", "recorded by", "recordist")


def _pieces(c: Column) -> Column:
    """A lower-case text cut into runs of letters, of digits and of other signs."""
    return F.regexp_extract_all(F.lower(c), F.lit("([a-z]+|[0-9]+|[^a-z0-9]+)"), F.lit(1))


def _once(value: Column, of) -> Column:
    """``of(value)``, with the value computed once however often it is used."""
    return F.get(F.transform(F.array(value), of), F.lit(0))


def extract_date(c: Column) -> Column:
    """X-25: the first valid date of the most reliable kind, as yyyy-mm-dd.

    The text is cut into words, numbers and signs, and every three values with two signs between them are looked at:
    a month's name and day and year, in either order; year, month, day; month, day, year (US); numbers of two digits
    as year, month, day and else as month, day, year, over 40 being 19xx. A reading counts if it is a day of the
    calendar between 1900 and 2099 (Q-3).
    """
    # "21st" is 21.
    pieces = _pieces(F.regexp_replace(F.lower(c), r"([0-9])(st|nd|rd|th)(?![a-z0-9_])", "$1"))
    month_of = F.create_map(*[F.lit(x) for n, m in enumerate(MONTHS, 1) for short in {m, m[:3], "sept" if n == 9 else m} for x in (short, n)])
    day = lambda y, m, d: F.try_to_date(F.concat_ws("-", y, m.cast("string"), d), "yyyy-M-d")
    in_range = lambda d: F.when(F.year(d).between(1900, 2099), d)
    full = lambda y: y.rlike("^(19|20)[0-9]{2}$")
    short = lambda y: F.concat(F.when(y > "40", "19").otherwise("20"), y)
    few = lambda n: n.rlike("^[0-9]{1,2}$")
    two = lambda n: n.rlike("^[0-9]{2}$")

    def readings(p: Column) -> Column:
        at = lambda i: F.coalesce(F.get(p, i), F.lit(""))

        def read(i: Column) -> Column:
            before, x, s, y, u, z, after = (at(i + k) for k in range(-1, 6))
            word_before, word_after = before.rlike("[a-z0-9_]$"), after.rlike("^[a-z0-9_]")
            alone = ~word_before & ~word_after & full(z)
            comma, dot = r"^,?\s+$", r"^\.?\s+$"
            month_first = F.when(alone & few(y) & s.rlike(dot) & u.rlike(comma), day(z, month_of[x], y))
            day_first = F.when(alone & few(x) & s.rlike(r"^\s+$") & u.rlike(r"^\.?,?\s+$"), day(z, month_of[y], x))
            sign = (s == u) & (F.length(s) == 1)
            year_first = F.when(sign & s.rlike("[-/._* ]") & full(x) & few(y) & few(z) & ~before.rlike("[a-z]$"), day(x, y, z))
            year_last = F.when(sign & s.rlike("[-/._ ]") & full(z) & few(x) & few(y) & ~word_after, day(z, x, y))
            pair = F.when(sign & s.rlike("[-.]") & two(x) & two(y) & two(z), F.coalesce(in_range(day(short(x), y, z)), in_range(day(short(z), x, y))))
            return F.array(*[in_range(d) for d in (month_first, day_first, year_first, year_last)], pair)

        every = F.transform(F.sequence(F.lit(0), F.size(p) - 1), read)

        def first_of(kind: int):
            return lambda rs: F.get(F.array_compact(F.transform(rs, lambda r: F.get(r, F.lit(kind)))), F.lit(0))

        best = lambda rs: F.coalesce(*[first_of(kind)(rs) for kind in range(5)])
        return _once(every, best)

    # A text with less than five pieces holds no date; a number of one piece has none beside it.
    return F.when(F.size(pieces) >= 5, F.date_format(_once(pieces, readings), "yyyy-MM-dd"))


def source_type(c: Column) -> Column:
    """X-26: a source's class from its own label: broadcast, matrix, soundboard, front of board, audience; '' if none."""

    def rank(word: Column) -> Column:
        out = F
        for n, (_, words, endings) in enumerate(SOURCES):
            out = out.when(word.isin(*words) | (word.rlike(f"({'|'.join(endings)})$") if endings else F.lit(False)), n)
        return out

    best = F.array_min(F.transform(F.regexp_extract_all(F.lower(F.coalesce(c, F.lit(""))), F.lit("([a-z0-9_]+)"), F.lit(1)), rank))
    return F.coalesce(F.get(F.array(*[F.lit(kind) for kind, *_ in SOURCES]), best), F.lit(""))


def infer_source(c: Column) -> Column:
    """X-27: a source's class from the evidence in a whole text: both a board and an audience make a matrix."""
    t = F.lower(F.coalesce(c, F.lit("")))
    fm = t.rlike(r"\b(broadcast(ed)?|simulcast|pre-?fm|air ?check)\b|\b(fm|radio|tv) broadcast\b") | F.coalesce(c, F.lit("")).rlike(r"\b[KW][A-Z]{2,3}-?(FM|AM)\b")
    mtx = t.rlike(r"\b(matrix|mtx)\b")
    board = t.rlike(r"\b(d?sbd|soundboard|sound board|board (feed|tape|patch)|house (desk|mix)|desk feed|monitor mix)\b")
    fob = t.rlike(r"\bfob\b")
    aud = t.rlike(r"\baud\b|\baudience (recording|tape|source|master)\b|\b(omnis?|cardioids?|binaural)\b|\bmics? (at|on|in)\b") | fob
    return F.when(fm, "SBD.FM").when(mtx | (board & aud), "MTX").when(board, "SBD").when(fob, "AUD.FOB").when(aud, "AUD").otherwise("")


def official_label(c: Column, labels: tuple[str, ...] = ("official", "archive series", "label release")) -> Column:
    """X-28: the official release's label as it is spelled in brackets or after "label:"; '' if none."""
    alternatives = "|".join(map(str, labels))
    return F.coalesce(F.regexp_extract(c, rf"(?i)[\[(]\s*({alternatives})\b[^\])]*[\])]", 1), F.lit(""))


def shnid(c: Column) -> Column:
    """X-29: a circulation number of 4 to 7 digits after its marker or alone in brackets' end, padded to six."""
    d = F.coalesce(F.nullif(F.regexp_extract(c, r"(?i)\bshn(?:id)?[\s:#.-]*(\d{4,7})(?!\d)", 1), F.lit("")), F.nullif(F.regexp_extract(c, r"[\[(][^\])]*?(?<!\d)(\d{4,7})[\])]", 1), F.lit("")))
    return F.lpad(d, F.greatest(F.lit(6), F.length(d)), F.lit("0"))


def recorder(c: Column) -> Column:
    """X-30: who recorded: the last word of a taper's line, unless it is gear."""
    lines = F.transform(F.split(F.coalesce(c, F.lit("")), r"\r?\n"), lambda x: F.trim(x))
    said = lambda x: F.array_max(F.array(*[F.when(F.lower(x).startswith(label), len(label)) for label in TAPER_LABELS]))
    rests = F.transform(F.filter(lines, lambda x: said(x).isNotNull()), lambda x: F.regexp_replace(F.substring(x, said(x) + 1, F.length(x)), r"^[\s:=]+", ""))
    last = F.element_at(F.split(F.get(F.filter(rests, lambda x: x != ""), F.lit(0)), r"\s+"), -1)
    return F.when(~last.rlike(r"\d") & (F.length(last) > 1), last)


def _numbers(name: Column, of) -> Column:
    """``of(pieces, i)`` for every number among the pieces of a file's name without its ending: the first that is not null."""
    stem = F.regexp_replace(name, r"\.[A-Za-z0-9]{2,5}$", "")
    of_pieces = lambda p: F.get(F.array_compact(F.transform(F.sequence(F.lit(0), F.size(p) - 1), lambda i: of(p, i))), F.lit(0))
    pieces = _pieces(stem)
    return F.when(F.size(pieces) > 0, _once(pieces, of_pieces))


def track_number(name: Column) -> Column:
    """X-37: a file name's track number, by its place among the pieces: after a disc and "t", after "t" or "track", at the
    beginning before a sign, at the end after a blank; never of a date."""
    at = lambda p, i: F.coalesce(F.get(p, i), F.lit(""))
    number = lambda p, i: at(p, i).rlike("^[0-9]{1,3}$")

    def after_disc(p: Column, i: Column) -> Column:
        return F.when(number(p, i) & (at(p, i - 1) == "t") & at(p, i - 2).rlike("^[0-9]{1,2}$") & at(p, i - 3).rlike("(d|s)$"), at(p, i))

    def after_word(p: Column, i: Column) -> Column:
        word = F.when(at(p, i - 1).rlike(r"^[\s._-]+$"), at(p, i - 2)).otherwise(at(p, i - 1))
        return F.when(number(p, i) & word.isin("t", "track"), at(p, i))

    def at_start(p: Column, i: Column) -> Column:
        # "05 - Song" and "05.Song", but not "05-06": a lone sign before a digit is a date's.
        return F.when((i == 0) & number(p, i) & at(p, 1).rlike(r"^[\s._-]") & ~((F.length(at(p, 1)) == 1) & at(p, 2).rlike("^[0-9]")), at(p, i))

    def at_end(p: Column, i: Column) -> Column:
        return F.when((i == F.size(p) - 1) & number(p, i) & at(p, i - 1).rlike(r"\s[-–]?\s*$"), at(p, i))

    return F.coalesce(*[_numbers(name, f) for f in (after_disc, after_word, at_start, at_end)]).cast("int")


def disc_number(name: Column) -> Column:
    """X-37: a file name's disc number, the number between a disc's letter or word and "t" with a number; 1 if it has none."""
    at = lambda p, i: F.coalesce(F.get(p, i), F.lit(""))

    def between(p: Column, i: Column) -> Column:
        word = F.when(at(p, i - 1).rlike(r"^\s+$"), F.when(at(p, i - 2) == "disc", "disc")).otherwise(at(p, i - 1))
        return F.when(at(p, i).rlike("^[0-9]{1,2}$") & word.isin("d", "cd", "disc", "s") & (at(p, i + 1) == "t") & at(p, i + 2).rlike("^[0-9]"), at(p, i))

    return F.coalesce(_numbers(name, between).cast("int"), F.lit(1))


def show_part(name: Column) -> Column:
    """X-38: early or late, said after the date in a name; '' if neither or both."""
    after = F.lower(F.regexp_replace(name, r"^.*?(?:(?:19|20)\d\d[-._]\d\d[-._]\d\d|(?<!\d)\d\d[-._]\d\d[-._]\d\d(?!\d))", ""))
    early, late = (after.rlike(rf"(?<![a-z]){w}(?:[\s._-]*(?:show|set))?(?![a-z])") for w in ("early", "late"))
    return F.when(early & ~late, "early").when(late & ~early, "late").otherwise("")


def location_line(c: Column) -> Column:
    """X-35: a struct of venue, city, state from "City, ST @ Venue", "Venue, City, ST" or "Recorded live at Venue"."""
    at = r"^\s*([^,@]+),\s*([A-Z]{2})\s*(?:@|--)\s*(.+?)\s*$"
    three = r"^\s*([^,]+),\s*([^,]+),\s*([A-Z]{2})\s*$"
    live = r"(?i)^\s*(?:recorded\s+)?live\s+at\s+(?:the\s+)?(.+?)\s*$"
    x = lambda p, k: F.nullif(F.regexp_extract(c, p, k), F.lit(""))
    return F.struct(F.coalesce(x(at, 3), x(three, 1), x(live, 1)).alias("venue"), F.coalesce(x(at, 1), x(three, 2)).alias("city"), F.coalesce(x(at, 2), x(three, 3)).alias("state"))


def album_string(c: Column) -> Column:
    """X-31: a struct of date, venue, city, state, source_type, shnid, complete from "1998-11-06 Venue, City, ST [SBD 012345]"."""
    bracket = F.regexp_extract(c, r"\[([^\]]*)\]\s*$", 1)
    body = F.trim(F.regexp_replace(F.regexp_replace(c, r"\[[^\]]*\]\s*$", ""), r"^.*?(?<!\d)(?:\d{4}[-.]\d\d[-.]\d\d|\d\d-\d\d-\d\d)(?!\d)", ""))
    parts = F.array_distinct(F.filter(F.transform(F.split(body, ","), lambda p: F.trim(p)), lambda p: p != ""))
    n = F.size(parts)
    at = lambda i: F.try_element_at(parts, F.lit(i))
    state = F.when(n >= 3, at(-1))
    city = F.when(n >= 3, at(-2)).when(n == 2, at(2))
    venue = F.when(n >= 4, F.array_join(F.slice(parts, F.lit(1), n - 2), ", ")).when(n >= 1, at(1))
    return F.struct(extract_date(c).alias("date"), venue.alias("venue"), city.alias("city"), state.alias("state"), source_type(bracket).alias("source_type"), F.when(bracket != "", F.lpad(F.nullif(F.regexp_extract(bracket, r"(\d{4,7})$", 1), F.lit("")), 6, "0")).alias("shnid"), (n >= 3).alias("complete"))


def folder_name(c: Column) -> Column:
    """X-32: a struct of artist, date, rest from a folder's name in the dotted, joined or descriptive style.

    The date is joined as it stands and not checked (Q-3): month 13 survives here.
    """
    date = r"^(.*?)(?<!\d)(?:(\d{4})[-.](\d\d)[-.](\d\d)|(\d\d)-(\d\d)-(\d\d))(?!\d)(.*)$"
    x = lambda k: F.regexp_extract(c, date, k)
    year = F.when(x(2) != "", x(2)).when(x(5) != "", F.concat(F.when(x(5) > "40", F.lit("19")).otherwise(F.lit("20")), x(5)))
    head = F.trim(F.regexp_replace(camel_split(x(1)), r"[\s._-]+$", ""))
    head = F.when(F.contains(head, F.lit(" ")), head).otherwise(F.replace(head, F.lit("."), F.lit(" ")))
    code = F.length(F.regexp_replace(head, "[^A-Za-z]", "")) <= 5
    return F.struct(
        F.when(~code, name_case(blank_to_null(head))).alias("artist"),
        F.when(year.isNotNull(), F.concat_ws("-", year, F.when(x(2) != "", x(3)).otherwise(x(6)), F.when(x(2) != "", x(4)).otherwise(x(7)))).alias("date"),
        blank_to_null(x(8)).alias("rest"),
    )


def formats_list(c: Column) -> Column:
    """X-39: audio formats as distinct sorted tokens."""
    named = lambda f: F.when(f.rlike("(?i)24.?bit"), "flac24").when(f.rlike("(?i)flac"), "flac16").when(f.rlike("(?i)shorten|shn"), "shn").when(f.rlike("(?i)mp3|vbr"), "mp3").when(f.rlike("(?i)ogg"), "ogg")
    return F.array_sort(F.array_distinct(F.array_compact(F.transform(F.coalesce(c, F.array().cast("array<string>")), named))))


def info_text(c: Column) -> Column:
    """X-34: a struct of an information text: artist (first line), date, location line, source, track titles with numbers.

    Lines of tracks are numbered lines, or a list after "Set n:"; the rest of the first non-blank lines is the head.
    """
    lines = F.filter(F.transform(F.split(F.coalesce(c, F.lit("")), r"\r?\n"), lambda x: F.trim(x)), lambda x: x != "")
    head = F.slice(lines, 1, 15)
    titles = F.transform(F.filter(lines, lambda x: x.rlike(r"^\d{1,2}[.)]?\s+\S")), lambda x: F.regexp_replace(x, r"^\d{1,2}[.)]?\s+", ""))
    sets = F.transform(F.flatten(F.transform(F.filter(lines, lambda x: x.rlike(r"(?i)^(?:set|encore)[^:]{0,12}:")), lambda x: F.split(F.regexp_replace(x, r"(?i)^(?:set|encore)[^:]{0,12}:", ""), r"\s*(?:,|>)\s*"))), lambda x: F.trim(x))
    return F.struct(
        clean_artist(F.get(head, F.lit(0))).alias("artist"),
        extract_date(F.array_join(head, " ")).alias("date"),
        F.get(F.filter(head, lambda x: x.rlike(r"^[^,:]+,\s*[A-Z]{2}$")), F.lit(0)).alias("place"),
        infer_source(c).alias("source_type"),
        F.when(F.size(titles) > 0, titles).otherwise(sets).alias("titles"),
    )


# Labels of an information text's fields, with the field each gives.
FIELD_LABELS = {"artist": "artist", "band": "artist", "venue": "venue", "date": "date", "city": "city", "location": "city", "source": "source", "lineage": "source", "src": "source"}


def info_header(c: Column) -> Column:
    """X-34, the head: a struct of artist, date (as said), day (as read), venue, city, state, source and songs of an information text.

    Only the lines up to the first blank one are read. A labelled line gives its field. Of the others the first is
    either "act / date / city", or the act, followed by date, venue and "City, ST" on lines of their own; what
    comes then are songs: a line each, numbered or not, or a set's list after its heading.
    """
    lines = F.transform(F.split(F.replace(F.coalesce(c, F.lit("")), F.lit("\r"), F.lit("")), "\n"), lambda x: F.trim(x))
    blank = F.array_position(lines, "")
    block = F.when(blank > 0, F.slice(lines, F.lit(1), (blank - 1).cast("int"))).otherwise(lines)
    labelled = rf"(?i)^({'|'.join(FIELD_LABELS)})\s*[:=]\s*(.*)$"

    def of_block(b: Column) -> Column:
        told = lambda field: F.get(F.filter(F.transform(b, lambda x: F.when(F.lower(F.regexp_extract(x, labelled, 1)).isin(*[k for k, f in FIELD_LABELS.items() if f == field]), F.trim(F.regexp_extract(x, labelled, 2)))), lambda x: x != ""), F.lit(0))
        plain = F.filter(b, lambda x: ~x.rlike(labelled))
        at = lambda i: F.get(plain, F.lit(i))
        three = F.split(at(0), " / ")
        joined = F.coalesce(F.size(three) == 3, F.lit(False))
        said = told("artist").isNotNull()
        stacked = ~joined & ~said
        place = F.when(joined, F.get(three, F.lit(2))).when(stacked, F.when(at(3).rlike("^[^,:]+, [A-Z]{2}$"), at(3)))
        city = F.coalesce(told("city"), F.trim(F.get(F.split(place, ","), F.lit(0))))
        head = F.when(said, 0).when(joined, 1).otherwise(F.when(place.isNotNull(), 4).otherwise(3))
        rest = F.filter(plain, lambda x, i: i >= head)
        one = lambda x: F.regexp_replace(F.regexp_replace(F.regexp_replace(x, r"(?i)^(?:d\d+t)?\d{1,3}[.)]?\s+", ""), r"\s+\d{1,2}:\d{2}$", ""), r"\s*>$", "")
        several = lambda x: F.split(F.regexp_replace(x, r"(?i)^(?:set|encore)[^:]{0,12}:\s*", ""), r"\s*[,>]\s*")
        songs = F.flatten(F.transform(rest, lambda x: F.when(x.rlike(r"(?i)^(?:set|encore)[^:]{0,12}:"), several(x)).otherwise(F.array(one(x)))))
        date = F.coalesce(told("date"), F.when(joined, F.get(three, F.lit(1))).when(stacked, at(1)))
        return F.struct(
            F.coalesce(told("artist"), F.when(joined, F.get(three, F.lit(0))).otherwise(at(0))).alias("artist"),
            date.alias("date"),
            F.coalesce(told("venue"), F.when(stacked, at(2))).alias("venue"),
            city.alias("city"),
            F.nullif(F.regexp_extract(place, ", ([A-Z]{2})$", 1), F.lit("")).alias("state"),
            told("source").alias("source"),
            F.filter(songs, lambda x: x != "").alias("songs"),
        )

    return _once(block, of_block)
