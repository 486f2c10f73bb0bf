"""A family of queries: each with its operators' inventory ids and, where SQL can say it, its SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

#: The shows once, with the scalar fields of their meta, in SQL.
SHOWS_SQL = """(select distinct id as show_id, folder_name, status, confidence, meta->>'$.artist' as artist, meta->>'$.date' as date,
 meta->>'$.venue' as venue, meta->>'$.city' as city, meta->>'$.state' as state, meta->>'$.source_type' as source_type,
 meta->>'$.shnid' as shnid, meta->>'$.recorder' as recorder from shows where json_valid(meta))"""
RELEASES_SQL = """(select distinct id, indexer, release_id, artist_id, data.artist as artist, data.title as title, data.date as date, data.venue as venue,
 data.location as location, data.source_type as source_type, data.owned as owned, data.downloads as downloads, data.added as added, status, reason, first_seen, updated_at from releases)"""

#: A song's own key, a title's parts without signs for the test of filler words, and a source's class from words and from a text, in SQL.
SONG_KEY = r"regexp_replace(regexp_replace(trim(regexp_replace(regexp_extract(lower({}), '^([^>/→]*)', 1), '\b(reprise|jam|tease|intro|outro|acoustic|electric)\b', '', 'g')), '^the\s+', ''), '[^a-z0-9]', '', 'g')"
FILLER_PARTS = r"list_transform(list_filter(string_split_regex(regexp_replace(lower(coalesce({}, '')), '^[ \-–—*>~]+|[ \-–—*>~]+$', '', 'g'), '\s*(?:[/&+,>]|\band\b)\s*'), lambda p: p <> ''), lambda p: regexp_replace(regexp_replace(p, '^the ', ''), '[^a-z0-9]', '', 'g'))"
STATED = r"""case when regexp_matches(lower({0}), '\b(fm|broadcasts|[a-z0-9_]*(broadcast|simulcast))\b') then 'SBD.FM' when regexp_matches(lower({0}), '\b(matrix|mtx)\b') then 'MTX' when regexp_matches(lower({0}), '\b(sbd|dsbd|sdb|[a-z0-9_]*board)\b') then 'SBD'
 when regexp_matches(lower({0}), '\bfob\b') then 'AUD.FOB' when regexp_matches(lower({0}), '\b(aud|[a-z0-9_]*(audience|taper)|mics?|microphones?|omnis?|cardioids?|binaural)\b') then 'AUD' end"""
TOLD = r"""case when regexp_matches(lower({0}), '\b(broadcast(ed)?|simulcast|pre-?fm|air ?check)\b|\b(fm|radio|tv) broadcast\b') or regexp_matches({0}, '\b[KW][A-Z]{{2,3}}-?(FM|AM)\b') then 'SBD.FM'
 when regexp_matches(lower({0}), '\b(matrix|mtx)\b') or (regexp_matches(lower({0}), '\b(d?sbd|soundboard|sound board|board (feed|tape|patch)|house (desk|mix)|desk feed|monitor mix)\b') and regexp_matches(lower({0}), '\baud\b|\baudience (recording|tape|source|master)\b|\b(omnis?|cardioids?|binaural)\b|\bmics? (at|on|in)\b|\bfob\b')) then 'MTX'
 when regexp_matches(lower({0}), '\b(d?sbd|soundboard|sound board|board (feed|tape|patch)|house (desk|mix)|desk feed|monitor mix)\b') then 'SBD' when regexp_matches(lower({0}), '\bfob\b') then 'AUD.FOB'
 when regexp_matches(lower({0}), '\baud\b|\baudience (recording|tape|source|master)\b|\b(omnis?|cardioids?|binaural)\b|\bmics? (at|on|in)\b') then 'AUD' end"""


class Family:
    """Queries by name, their SQL, and what of the inventory each covers."""

    def __init__(self) -> None:
        self.queries: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
        self.oracle: dict[str, str] = {}
        self.covers: dict[str, tuple[str, ...]] = {}

    def query(self, *ids: str, sql: str | None = None):
        def register(f):
            self.queries[f.__name__] = f
            self.covers[f.__name__] = ids
            if sql:
                self.oracle[f.__name__] = sql.replace("{SHOWS}", SHOWS_SQL).replace("{RELEASES}", RELEASES_SQL)
            return f

        return register
