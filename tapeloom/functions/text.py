"""Scalar text functions, as column expressions that stay inside the JVM.

Missing text is null; functions of null are null unless they say otherwise. Java's regular expressions are
ASCII-only by default, so patterns that look at letters of any script carry ``(?U)``.
"""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# Letters that decomposition leaves alone, and accented Latin letters with their base letters.
_FOLD_FROM = "àáâãäåāăąçćčďèéêëēęěìíîïīñńňòóôõöōőřŕśšťțùúûüūůűýÿźżžğĺľ"
_FOLD_TO = "aaaaaaaaacccdeeeeeeeiiiiinnnooooooorrssttuuuuuuuyyzzzgll"
SMALL_WORDS = ("the", "a", "an", "and", "of", "in", "at", "on", "for", "to")
STOP_WORDS = ("the", "and", "of", "at", "in")


def blank_to_null(c: Column) -> Column:
    """Trimmed text; null where nothing is left."""
    return F.nullif(F.trim(c), F.lit(""))


def norm_key(c: Column) -> Column:
    """X-1: lower case, only a-z and 0-9 kept. Accented letters are dropped, not folded (Q-4)."""
    return F.regexp_replace(F.lower(c), "[^a-z0-9]", "")


def fold(c: Column) -> Column:
    """X-2: like norm_key, but accented Latin letters keep their base letter and a leading saint is "st"."""
    low = F.translate(F.lower(c), _FOLD_FROM, _FOLD_TO)
    for a, b in (("ß", "ss"), ("æ", "ae"), ("œ", "oe"), ("ø", "o"), ("ł", "l"), ("đ", "d"), ("ð", "d"), ("þ", "th")):
        low = F.replace(low, F.lit(a), F.lit(b))
    return F.regexp_replace(F.regexp_replace(low, r"^\s*(?:saint|st)[\s.-]+", "st"), "[^a-z0-9]", "")


def city_key(c: Column) -> Column:
    """X-3: fold without what stands in brackets."""
    return fold(F.regexp_replace(c, r"\s*\([^)]*\)\s*", " "))


def song_norm(c: Column) -> Column:
    """X-4: the song's own key: up to the first segue or alternative sign, without article and without words like reprise."""
    first = F.regexp_extract(F.lower(c), r"^([^>/→]*)", 1)
    bare = F.regexp_replace(first, r"\b(reprise|jam|tease|intro|outro|acoustic|electric)\b", "")
    return norm_key(F.regexp_replace(F.trim(bare), r"^the\s+", ""))


def tokens(c: Column) -> Column:
    """All runs of a-z and 0-9 in lower case, in order; an empty array for null."""
    return F.coalesce(F.regexp_extract_all(F.lower(c), F.lit("([a-z0-9]+)"), F.lit(1)), F.array().cast("array<string>"))


def norm_words(c: Column) -> Column:
    """X-5: distinct words longer than one letter, without stop words."""
    return F.array_distinct(F.filter(tokens(c), lambda w: (F.length(w) > 1) & ~w.isin(*STOP_WORDS)))


def words(c: Column) -> Column:
    """X-6: distinct words without small words, of any length."""
    return F.array_distinct(F.filter(tokens(c), lambda w: ~w.isin(*SMALL_WORDS)))


def initials(c: Column, skip_small: bool = False) -> Column:
    """X-7: first letters of the words."""
    t = F.filter(tokens(c), lambda w: ~w.isin(*SMALL_WORDS)) if skip_small else tokens(c)
    return F.array_join(F.transform(t, lambda w: F.substring(w, 1, 1)), "")


def initial_forms(c: Column) -> Column:
    """X-8: for the words, with and without small ones: the initials of the first k and the rest in full, for all k."""

    def forms(t: Column) -> Column:
        ks = F.when(F.size(t) > 0, F.sequence(F.lit(1), F.size(t))).otherwise(F.array().cast("array<int>"))
        return F.transform(
            ks,
            lambda k: F.concat(
                F.array_join(F.transform(F.slice(t, F.lit(1), k), lambda w: F.substring(w, 1, 1)), ""),
                F.array_join(F.filter(t, lambda _, i: i >= k), ""),
            ),
        )

    return F.array_distinct(F.concat(forms(tokens(c)), forms(F.filter(tokens(c), lambda w: ~w.isin(*SMALL_WORDS)))))


def contains_either(a: Column, b: Column, least: int = 4) -> Column:
    """X-11: whether one key holds the other, the shorter having at least ``least`` letters."""
    return (F.least(F.length(a), F.length(b)) >= least) & (F.contains(a, b) | F.contains(b, a))


def digit_share(c: Column) -> Column:
    """X-24: digits over length, from 0 to 1; 0 for empty text (X-55: the denominator is at least 1)."""
    return F.length(F.regexp_replace(c, "[^0-9]", "")) / F.greatest(F.length(c), F.lit(1))


def plain_punctuation(c: Column) -> Column:
    """X-14, the part of characters: typographic signs to ASCII, zero-width characters removed."""
    t = F.replace(F.translate(c, "‘’‚“”„–—−", "'''\"\"\"---"), F.lit("…"), F.lit("..."))
    return F.regexp_replace(t, "[\\u200b-\\u200d\\u2060\\ufeff\\u00ad]", "")


def clean_title(c: Column) -> Column:
    """X-15: a track title without trailing time, segue arrows, footnote marks, and said once where it was said twice."""
    t = F.regexp_replace(F.trim(c), r"\s*(?:-+>|>+|→)\s*$", "")
    t = F.regexp_replace(t, r"\s*[\[(]?\d{1,2}:\d{2}(?::\d{2})?[\])]?\s*$", "")
    t = F.regexp_replace(t, r"[\s*#^+]+$", "")
    return F.regexp_replace(F.trim(t), r"^(.{3,}?)\s+\1$", "$1")


def title_case(c: Column) -> Column:
    """X-19: a capital after everything that is no letter ("O'Brien"), small letters otherwise."""
    runs = F.regexp_extract_all(c, F.lit(r"(\p{L}+|\P{L}+)"), F.lit(1))
    return F.array_join(F.transform(runs, lambda r: F.concat(F.upper(F.substring(r, 1, 1)), F.lower(F.substring(r, 2, 1 << 20)))), "")


def name_case(c: Column) -> Column:
    """X-18: mixed case is kept; text all in one case is put in title case."""
    return F.when((c == F.upper(c)) | (c == F.lower(c)), title_case(c)).otherwise(c)


def smart_title(c: Column) -> Column:
    """X-17: text all in capitals to title case, keeping initials with dots, words of up to two letters with digits, and small words small but for the first."""
    small = ("The", "A", "An", "And", "Of", "In", "At", "On", "For", "To", "De", "La")

    def word(w: Column, i: Column) -> Column:
        t = title_case(w)
        return F.when(w.rlike(r"^(?:\p{L}\.)+$") | w.rlike(r"\d"), w).when((i > 0) & t.isin(*small), F.lower(t)).otherwise(t)

    return F.when((c == F.upper(c)) & (c != F.lower(c)), F.array_join(F.transform(F.split(c, " "), word), " ")).otherwise(c)


def camel_split(c: Column) -> Column:
    """X-20: a blank before an inner capital but after Mc or Mac; underscores, and dots between words, are blanks."""
    t = F.regexp_replace(c, r"_|(?<=\p{Ll})\.(?=\p{Lu})", " ")
    return F.regexp_replace(t, r"(?<=\p{Ll})(?<!Mc)(?<!Mac)(?=\p{Lu})", " ")


def safe_name(c: Column) -> Column:
    """X-21: a file name: reserved characters to dashes, no dots or blanks at the ends, never empty."""
    t = F.regexp_replace(c, r'[<>:"/\\|?*\x00-\x1f]', "-")
    return F.coalesce(F.nullif(F.regexp_replace(t, r"^[\s.]+|[\s.]+$", ""), F.lit("")), F.lit("Unknown"))


def strip_label(c: Column) -> Column:
    """X-22: the value after a field's label ("Venue: …")."""
    return F.trim(F.regexp_replace(c, r"(?i)^\s*(?:artist|band|venue|location|place|city|state|date|source|lineage|taper)\s*[:=]\s*", ""))


def clean_artist(c: Column) -> Column:
    """X-16: an artist's name without label, trailing brackets, date or year; capitals put in title case."""
    t = strip_label(c)
    t = F.regexp_replace(t, r"\s*[\[(][^\])]*[\])]\s*$", "")
    t = F.regexp_replace(t, r"[\s_.-]*(?:(?:19|20)\d\d[-./]\d\d[-./]\d\d|\d\d[-.]\d\d[-.]\d\d|(?:19|20)\d\d)\s*$", "")
    return smart_title(F.trim(t))


def html_lines(c: Column) -> Column:
    """X-42: HTML to lines, only where a known tag is there: block ends are line ends, other tags go, common entities are read."""
    t = F.regexp_replace(c, r"(?i)<br\s*/?>|</(?:p|div|li|tr|h[1-6]|table|ul|ol)>", "\n")
    t = F.regexp_replace(t, r"<[^<>]{1,400}>", "")
    for name, char in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")):
        t = F.replace(t, F.lit(name), F.lit(char))
    return F.when(c.rlike(r"(?i)</?(?:html|body|p|br|div|span|table|tr|td|li|ul|b|i|a|h[1-6])\b[^>]*>"), t).otherwise(c)


def redact(c: Column) -> Column:
    """X-40: passwords, keys and tokens in addresses, headers and pairs of key and value are blotted out."""
    t = F.regexp_replace(c, r"(?i)(\w+://[^/\s:@]+:)[^@\s/]+@", "$1***@")
    t = F.regexp_replace(t, r"(?i)(authorization\s*:\s*(?:bearer|basic)?\s*)\S+", "$1***")
    t = F.regexp_replace(t, r"(?i)([?&](?:api_?key|token|key|password|secret)=)[^&\s]+", "$1***")
    return F.regexp_replace(t, r"(?i)(\"?(?:password|passwd|secret|api_?key|token)\"?\s*[:=]\s*\"?)[^\s\",}&]+", "$1***")


def magnet_hash(c: Column) -> Column:
    """X-41: the 40 hexadecimal digits of a magnet link's hash, in lower case; null if there are none."""
    return F.nullif(F.lower(F.regexp_extract(c, r"(?i)btih:([0-9a-f]{40})(?![0-9a-f])", 1)), F.lit(""))


def label_slug(c: Column) -> Column:
    """X-41: a label in small letters, blanks to dashes, other signs dropped."""
    return F.regexp_replace(F.regexp_replace(F.lower(F.trim(c)), r"\s+", "-"), "[^a-z0-9_-]", "")


def list_text(c: Column) -> Column:
    """X-43: a list as text with commas, without blanks and nulls; '' for null."""
    return F.coalesce(F.array_join(F.filter(c, lambda x: x.isNotNull() & (F.trim(x) != "")), ", "), F.lit(""))


def common_prefix(texts: Column) -> Column:
    """X-13: the longest beginning that all texts of an array share: that of the least and the greatest of them."""
    a, b = F.array_min(texts), F.array_max(texts)
    n = F.least(F.length(a), F.length(b))
    ks = F.sequence(F.lit(0), n)
    return F.substring(a, F.lit(1), F.array_max(F.filter(ks, lambda k: F.substring(a, F.lit(1), k) == F.substring(b, F.lit(1), k))))


def clock(seconds: Column) -> Column:
    """X-47: seconds as m:ss; '?' for null."""
    s = F.round(seconds).cast("long")
    return F.when(s.isNull(), F.lit("?")).otherwise(F.format_string("%d:%02d", F.floor(s / 60), s % 60))


def size_text(b: Column) -> Column:
    """X-47: bytes in B, KB, MB or GB with one decimal."""
    return F.when(b >= 1 << 30, F.format_string("%.1f GB", b / (1 << 30))).when(b >= 1 << 20, F.format_string("%.1f MB", b / (1 << 20))).when(b >= 1 << 10, F.format_string("%.1f KB", b / (1 << 10))).otherwise(F.format_string("%d B", b.cast("long")))
