"""Joins (J-…): lookups, cascades, containment, pairing, best and unambiguous matches."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window as W, functions as F

from tapeloom.functions import fuzzy, parse, text
from tapeloom.operators import matching, nested
from tapeloom.plans.base import release_fields, show_fields, show_tracks
from tapeloom.plans.registry import Family
from tapeloom.tables import table

family = Family()
query = family.query


@query("J-1", sql="select r.id, r.indexer, m.name as monitored from {RELEASES} r left join monitored_artists m on m.id = r.artist_id where r.status = 'wanted'")
def wanted_left_join(spark: SparkSession, d: str) -> DataFrame:
    """Wanted releases with the artist they are watched for, or null."""
    m = table(spark, d, "monitored_artists").select(F.col("id").alias("artist_id"), F.col("name").alias("monitored"))
    return release_fields(spark, d).filter("status = 'wanted'").join(m, "artist_id", "left").select("id", "indexer", "monitored")


@query("J-2", sql="select r.id, m.name from {RELEASES} r join monitored_artists m on m.id = r.artist_id and r.first_seen >= m.added_at")
def inner_with_range(spark: SparkSession, d: str) -> DataFrame:
    """An equi-join with a range condition on time."""
    m = table(spark, d, "monitored_artists").select(F.col("id").alias("artist_id"), "name", "added_at")
    return release_fields(spark, d).join(m, "artist_id").filter("first_seen >= added_at").select("id", "name")


@query("J-3", sql="""select m.id, m.name, (select count(*) from {RELEASES} r where r.artist_id = m.id) as releases,
 (select count(*) from {RELEASES} r where r.artist_id = m.id and r.status = 'wanted') as wanted from monitored_artists m""")
def list_with_child_counts(spark: SparkSession, d: str) -> DataFrame:
    """Watched artists with two counts of children: one aggregate, then a left join, instead of two correlated queries."""
    n = release_fields(spark, d).filter("artist_id is not null").groupBy(F.col("artist_id").alias("id")).agg(F.count("*").alias("releases"), F.count_if(F.col("status") == "wanted").alias("wanted"))
    return table(spark, d, "monitored_artists").select("id", "name").join(n, "id", "left").fillna(0, ["releases", "wanted"])


@query("J-4", sql="select id from {RELEASES} r where exists (select 1 from artists a where a.name = r.artist)")
def seen_semi(spark: SparkSession, d: str) -> DataFrame:
    """Releases of an artist that is known by exactly that name."""
    return release_fields(spark, d).join(table(spark, d, "artists").select(F.col("name").alias("artist")), "artist", "left_semi").select("id")


@query("F-22", sql="select id from {RELEASES} r where status = 'grabbed' and first_seen <= (select max(first_seen) from releases) - interval 30 day and not exists (select 1 from {SHOWS} s where s.folder_name = r.release_id)")
def import_candidates(spark: SparkSession, d: str) -> DataFrame:
    """Releases that were fetched, are old enough and in no ledger of folders."""
    r = release_fields(spark, d)
    newest = r.agg(F.max("first_seen").alias("newest"))
    old = r.filter("status = 'grabbed'").crossJoin(F.broadcast(newest)).filter(F.expr("first_seen <= newest - interval 30 days"))  # one row
    return old.join(show_fields(spark, d).select(F.col("folder_name").alias("release_id")), "release_id", "left_anti").select("id")


@query("J-5", sql="select id from {RELEASES} r where not exists (select 1 from artists a where a.name = r.artist) and r.artist is not null")
def unseen_anti(spark: SparkSession, d: str) -> DataFrame:
    """Releases of an artist not known by that name."""
    return release_fields(spark, d).filter("artist is not null").join(table(spark, d, "artists").select(F.col("name").alias("artist")), "artist", "left_anti").select("id")


_KNOWN = """(select regexp_replace(lower(venue), '[^a-z0-9]', '', 'g') as norm, arg_min(venue, venue_id) as venue, arg_min(city, venue_id) as city, arg_min(state, venue_id) as state from ref_venues group by 1)"""
_N = "regexp_replace(lower({}), '[^a-z0-9]', '', 'g')"


def _known(spark: SparkSession, d: str) -> DataFrame:
    """Listed venues by key: the first of namesakes."""
    first = lambda c: F.min_by(c, "venue_id").alias(c)
    return table(spark, d, "ref_venues").groupBy(text.norm_key(F.col("venue")).alias("norm")).agg(first("venue"), first("city"), first("state"))


@query("J-6", sql=f"select s.show_id, v.venue as known, v.city from {{SHOWS}} s join {_KNOWN} v on v.norm = {_N.format('s.venue')} where {_N.format('s.venue')} <> ''")
def normalised_key_join(spark: SparkSession, d: str) -> DataFrame:
    """Shows joined to the listed venues on the generated key."""
    v = _known(spark, d).select(F.col("norm").alias("k"), F.col("venue").alias("known"), "city")
    s = show_fields(spark, d).select("show_id", text.norm_key(F.col("venue")).alias("k")).filter("k <> ''")
    return s.join(v, "k").select("show_id", "known", "city")


@query("J-7", sql=f"""with r as (select distinct artist from {{RELEASES}} where artist is not null), k as (select artist, {_N.format('artist')} as k from r)
 select k.artist, coalesce(a.name, b.name, c.name) as canonical, case when a.name is not null then 'exact' when b.name is not null then 'without the' when c.name is not null then 'with the' end as how
 from k left join artists a on a.norm = k.k left join artists b on b.norm = regexp_replace(k.k, '^the', '') and starts_with(k.k, 'the') left join artists c on c.norm = 'the' || k.k where coalesce(a.name, b.name, c.name) is not null""")
def variant_cascade(spark: SparkSession, d: str) -> DataFrame:
    """A name's canonical spelling: exact key, without the article, with it; the first that hits."""
    names = release_fields(spark, d).filter("artist is not null").select("artist").distinct()
    return matching.variant_cascade(names, table(spark, d, "artists"), "artist").filter("canonical is not null")


@query("J-7", "X-10", "Q-8")
def fuzzy_cascade(spark: SparkSession, d: str) -> DataFrame:
    """The cascade's last leg: the most similar known spelling, at 0.88 or more."""
    names = release_fields(spark, d).filter("artist is not null").select("artist").distinct()
    known = table(spark, d, "artists").select("name")
    missed = matching.variant_cascade(names, table(spark, d, "artists"), "artist").filter("canonical is null").select("artist")
    return matching.best_fuzzy(missed, known, "artist", "name", cutoff=0.88)


@query("J-8", sql=f"""select distinct s.show_id, r.id as rel_id from {{SHOWS}} s join {{RELEASES}} r on r.date = s.date and r.date <> ''
 where length({_N.format('r.artist')}) > 0 and contains({_N.format('s.folder_name')} || {_N.format('s.artist')}, left({_N.format('r.artist')}, 12))""")
def owned_containment(spark: SparkSession, d: str) -> DataFrame:
    """Releases that a show's text contains by the first twelve letters of the artist's key, on the same date: the date is the equi key, so nothing is crossed."""
    s = show_fields(spark, d).select("show_id", "date", F.concat(text.norm_key(F.col("folder_name")), text.norm_key(F.col("artist"))).alias("hay")).filter("date <> ''")
    r = release_fields(spark, d).select(F.col("id").alias("rel_id"), "date", F.left(text.norm_key(F.col("artist")), F.lit(12)).alias("needle")).filter("needle <> ''")
    return s.join(r, "date").filter(F.contains("hay", "needle")).select("show_id", "rel_id").distinct()


@query("J-9", "W-2", "X-38", sql=f"""with h as (select show_id, {_N.format('artist')} as k, date, source_type from {{SHOWS}} where source_type in ('AUD','SBD')),
 n as (select k, date, count(*) filter (where source_type = 'AUD') as a, count(*) filter (where source_type = 'SBD') as b, max(show_id) filter (where source_type = 'AUD') as first, max(show_id) filter (where source_type = 'SBD') as second from h where k <> '' group by k, date)
 select k as artist_key, date, first, second from n where a = 1 and b = 1""")
def pair_exactly_one(spark: SparkSession, d: str) -> DataFrame:
    """Of one act's night, the two recordings of two kinds, where there is exactly one of each."""
    s = show_fields(spark, d).filter("source_type in ('AUD', 'SBD')").select("show_id", text.norm_key(F.col("artist")).alias("artist_key"), "date", "source_type").filter("artist_key <> ''")
    return matching.pair_one_of_each(s, ["artist_key", "date"], "source_type", "AUD", "SBD", "show_id")


@query("J-9")
def early_late_pairs(spark: SparkSession, d: str) -> DataFrame:
    """Early and late folders of one act's night, paired by grouped map in folder order, initials counting as the artist."""
    s = show_fields(spark, d).select(F.col("folder_name").alias("folder"), "artist", "date", F.when(F.col("source_type") == "AUD", "early").when(F.col("source_type") == "SBD", "late").otherwise("").alias("part"))
    return matching.early_late(s)


@query("J-10")
def fuzzy_within_date(spark: SparkSession, d: str) -> DataFrame:
    """The most similar folder for each release on its date: a similarity of 0.6 with the artist's key, else 0.85."""
    r = release_fields(spark, d).select("id", "date", F.lower(F.concat_ws(" ", "artist", "date")).alias("a"), text.norm_key(F.col("artist")).alias("k")).filter("date <> '' and k <> ''")
    s = show_fields(spark, d).select("show_id", "date", F.lower(F.concat_ws(" ", "artist", "date")).alias("b"), text.norm_key(F.col("artist")).alias("k"))
    return matching.best_within(r, s, "id", "show_id", ["date"], "k", "a", "b", 0.6, 0.85)


@query("J-11")
def near_duplicate_names(spark: SparkSession, d: str) -> DataFrame:
    """Each key's closest other key at 0.87 or more, reported once per pair."""
    return matching.near_duplicates(table(spark, d, "artists").select("norm"), "norm", cutoff=0.87)


@query("J-12", "U-3", sql="""with t as (select artist_norm, list_distinct(list(title_norm)) as songs from song_titles where title_norm <> '' group by 1),
 w as (select artist_norm, unnest(songs) as s from t), p as (select a.artist_norm as a, b.artist_norm as b, count(*) as shared from w a join w b on a.s = b.s and a.artist_norm <> b.artist_norm group by all),
 r as (select *, rank() over (partition by a order by shared desc) as place, count(*) over (partition by a, shared) as ties from p) select a as artist_norm, b as other, shared from r where place = 1 and ties = 1 and shared >= 2""")
def ambiguity_guarded_match(spark: SparkSession, d: str) -> DataFrame:
    """The other act with which an act shares most songs: at least two, and no tie."""
    songs = table(spark, d, "song_titles").filter("title_norm <> ''").select("artist_norm", "title_norm").distinct()
    other = songs.withColumnRenamed("artist_norm", "other")
    n = songs.join(other, "title_norm").filter("artist_norm <> other").groupBy("artist_norm", "other").agg(F.count("*").alias("shared"))
    return matching.only_best(n, ["artist_norm"], "shared").filter("shared >= 2").select("artist_norm", "other", "shared")


@query("J-12", "SRC-17", "U-3")
def reverse_lookup(spark: SparkSession, d: str) -> DataFrame:
    """The other record of a show's city and date that its venue or songs point to, if only one does."""
    songs = show_tracks(spark, d).groupBy("show_id").agg(F.collect_set(F.nullif(text.song_norm(F.col("title")), F.lit(""))).alias("songs"))
    s = show_fields(spark, d).select("show_id", text.city_key(F.col("city")).alias("city"), "date", "venue").join(songs, "show_id", "left")
    return matching.guarded_lookup(s, s.withColumnRenamed("show_id", "other"), ["city", "date"], "venue", "songs", "show_id", "other")


@query("J-13", "O-11", sql="""with rules(remote, local) as (values ('/data', '/mnt/a'), ('/data/live', '/mnt/b'), ('/data/live/aud', '/mnt/c')),
 p as (select show_id, '/data/' || case source_type when 'AUD' then 'live/aud/' when 'SBD' then 'live/' else 'livestock/' end || coalesce(date, 'x') as path from {SHOWS}),
 h as (select *, row_number() over (partition by show_id order by length(remote) desc) as k from p join rules on path = remote or starts_with(path, remote || '/')) select show_id, path, local || substr(path, length(remote) + 1) as mapped from h where k = 1""")
def longest_prefix_map(spark: SparkSession, d: str) -> DataFrame:
    """Paths moved by the longest mapped prefix that ends at a segment's border."""
    rules = spark.createDataFrame([("/data", "/mnt/a"), ("/data/live", "/mnt/b"), ("/data/live/aud", "/mnt/c")], "remote string, local string")
    paths = show_fields(spark, d).select("show_id", F.concat(F.lit("/data/"), F.when(F.col("source_type") == "AUD", "live/aud/").when(F.col("source_type") == "SBD", "live/").otherwise("livestock/"), F.coalesce("date", F.lit("x"))).alias("path"))
    return matching.longest_prefix(paths, rules, "show_id", "path")


@query("J-14", sql="""with p as (select show_id, list_reverse(string_split(concat_ws('/', 'a', state, city, venue), '/')) as x, list_reverse(string_split(concat_ws('/', 'b', upper(state), city, venue), '/')) as y from {SHOWS})
 select show_id, list_max(list_filter(range(0, least(len(x), len(y)) + 1), lambda k: list_slice(x, 1, k) = list_slice(y, 1, k))) as segments from p""")
def tail_path_match(spark: SparkSession, d: str) -> DataFrame:
    """For each path, how many of its last segments stand at the end of the other, from the end on."""
    s = show_fields(spark, d).select("show_id", F.concat_ws("/", F.lit("a"), "state", "city", "venue").alias("x"), F.concat_ws("/", F.lit("b"), F.upper("state"), "city", "venue").alias("y"))
    return s.select("show_id", matching.common_tail(F.col("x"), F.col("y")).alias("segments"))


@query("J-15", sql=f"""with g as (select id, {_N.format('release_id')} as k1, regexp_replace(lower(artist || ' ' || date), '[^a-z0-9]', '', 'g') as k2 from {{RELEASES}}), t as (select show_id, regexp_replace(lower(regexp_extract(folder_name, '^(.*[0-9]{{4}}-[0-9][0-9]-[0-9][0-9])', 1)), '[^a-z0-9]', '', 'g') as k from {{SHOWS}}),
 u as (select k, min(show_id) as show_id from t where k <> '' group by k) select g.id, coalesce(a.show_id, b.show_id) as show_id, case when a.show_id is not null then 'id' else 'name' end as how
 from g left join u a on a.k = g.k1 left join u b on b.k = g.k2 where coalesce(a.show_id, b.show_id) is not null""")
def fallback_attach(spark: SparkSession, d: str) -> DataFrame:
    """Releases attached to folders by the id's key, else by artist and date; the first folder of a name."""
    g = release_fields(spark, d).select("id", text.norm_key(F.col("release_id")).alias("k1"), text.norm_key(F.concat("artist", F.lit(" "), "date")).alias("k2"))
    t = show_fields(spark, d).select(text.norm_key(F.regexp_extract("folder_name", "^(.*[0-9]{4}-[0-9][0-9]-[0-9][0-9])", 1)).alias("k"), "show_id").filter("k <> ''").groupBy("k").agg(F.min("show_id").alias("show"))
    both = g.join(t.select(F.col("k").alias("k1"), F.col("show").alias("a")), "k1", "left").join(t.select(F.col("k").alias("k2"), F.col("show").alias("b")), "k2", "left")
    return both.select("id", F.coalesce("a", "b").alias("show_id"), F.when(F.col("a").isNotNull(), "id").otherwise("name").alias("how")).filter("show_id is not null")


@query("J-16", sql="""with v as (select rid, lower(trim(city)) as k from venues where trim(coalesce(city, '')) <> ''), p as (select lower(name) as k, count(*) as n, max(pop) as pop from places group by 1)
 select v.rid, coalesce(a.n, b.n) as places, coalesce(a.pop, b.pop) as pop, a.n is null as by_city_suffix from v left join p a on a.k = v.k left join p b on b.k = v.k || ' city' where coalesce(a.n, b.n) is not null""")
def gazetteer_lookup(spark: SparkSession, d: str) -> DataFrame:
    """A typed city's entries in the gazetteer; with the word city put to it only where there is none without."""
    v = table(spark, d, "venues").select("rid", F.lower(F.trim("city")).alias("k")).filter("k <> ''")
    p = table(spark, d, "places").groupBy(F.lower("name").alias("k")).agg(F.count("*").alias("n"), F.max("pop").alias("pop"))
    a = p.select("k", F.col("n").alias("n1"), F.col("pop").alias("p1"))
    b = p.select(F.col("k").alias("kc"), F.col("n").alias("n2"), F.col("pop").alias("p2"))
    got = v.join(a, "k", "left").join(b, F.concat("k", F.lit(" city")) == F.col("kc"), "left")
    return got.select("rid", F.coalesce("n1", "n2").alias("places"), F.coalesce("p1", "p2").alias("pop"), F.col("n1").isNull().alias("by_city_suffix")).filter("places is not null")


@query("J-17", sql=f"""select s.show_id, coalesce(nullif(trim(s.city), ''), nullif(v.city, '')) as city, coalesce(nullif(trim(s.state), ''), nullif(v.state, '')) as state,
 case when nullif(trim(s.city), '') is not null then 'own' when nullif(v.city, '') is not null then 'venues' end as city_from from {{SHOWS}} s left join {_KNOWN} v on v.norm = {_N.format('s.venue')}""")
def gazetteer_completion(spark: SparkSession, d: str) -> DataFrame:
    """Missing city and state filled in from a known venue, with provenance."""
    v = _known(spark, d).select(F.col("norm").alias("k"), F.nullif("city", F.lit("")).alias("vc"), F.nullif("state", F.lit("")).alias("vs"))
    s = show_fields(spark, d).select("show_id", text.norm_key(F.col("venue")).alias("k"), text.blank_to_null(F.col("city")).alias("c"), text.blank_to_null(F.col("state")).alias("s"))
    return s.join(v, "k", "left").select("show_id", F.coalesce("c", "vc").alias("city"), F.coalesce("s", "vs").alias("state"), F.when(F.col("c").isNotNull(), "own").when(F.col("vc").isNotNull(), "venues").alias("city_from"))


@query("J-18", "Q-22", sql=f"""with s as (select distinct id, provenance, meta->>'$.venue' as venue, meta->>'$.city' as city from shows where json_valid(meta)), p as (select *, case when json_valid(provenance) then provenance->>'$.venue' end as src from s)
 select p.id as show_id, coalesce(v.venue, p.venue) as venue, case when p.src in ('sidecar', 'curated_tags') then p.city else coalesce(nullif(v.city, ''), p.city) end as city from p left join {_KNOWN} v on v.norm = {_N.format('p.venue')}""")
def correction_application(spark: SparkSession, d: str) -> DataFrame:
    """Learned rules: the venue's name always, the city not where a trusted source gave it."""
    raw = table(spark, d, "shows").select(F.col("id").alias("show_id"), "meta", "provenance").distinct()
    s = nested.parse_documents(raw, "meta").filter("doc is not null").select("show_id", nested.text_of(F.col("doc"), "venue").alias("sv"), nested.text_of(F.col("doc"), "city").alias("sc"), F.get_json_object("provenance", "$.venue").alias("src"))
    v = _known(spark, d).select(F.col("norm").alias("k"), F.col("venue").alias("vv"), F.nullif("city", F.lit("")).alias("vc"))
    j = s.withColumn("k", text.norm_key(F.col("sv"))).join(v, "k", "left")
    return j.select("show_id", F.coalesce("vv", "sv").alias("venue"), F.when(F.col("src").isin("sidecar", "curated_tags"), F.col("sc")).otherwise(F.coalesce("vc", "sc")).alias("city"))


@query("J-20", "W-11", sql="""with a as (select artist_norm, title, row_number() over (partition by artist_norm order by rid) as k from song_titles), b as (select artist_norm as other, release_id from (select distinct regexp_replace(lower(data.artist), '[^a-z0-9]', '', 'g') as artist_norm, id, release_id from releases)),
 c as (select other, release_id, row_number() over (partition by other order by release_id) as k from b) select a.artist_norm, a.k, a.title, c.release_id from a join c on c.other = a.artist_norm and c.k = a.k""")
def positional_zip(spark: SparkSession, d: str) -> DataFrame:
    """Two lists of one act put side by side by position."""
    a = table(spark, d, "song_titles").select("artist_norm", "title", F.row_number().over(W.partitionBy("artist_norm").orderBy("rid")).cast("long").alias("k"))
    r = release_fields(spark, d).select("id", "release_id", text.norm_key(F.col("artist")).alias("artist_norm")).distinct()
    b = r.select("artist_norm", "release_id", F.row_number().over(W.partitionBy("artist_norm").orderBy("release_id")).cast("long").alias("k"))
    return a.join(b, ["artist_norm", "k"]).select("artist_norm", "k", "title", "release_id")


@query("J-21", sql="select s.show_id, count(*) as folders from {SHOWS} s join (select distinct id, regexp_extract(folder_name, '((19|20)[0-9][0-9]-[0-9][0-9]-[0-9][0-9])', 1) as day from shows) f on f.day = s.date where s.date <> '' group by s.show_id")
def records_by_folder_date(spark: SparkSession, d: str) -> DataFrame:
    """Records joined to the folders of their date: a plain equi-join on the date in the name."""
    f = table(spark, d, "shows").select("id", F.regexp_extract("folder_name", "((19|20)[0-9][0-9]-[0-9][0-9]-[0-9][0-9])", 1).alias("date")).distinct().filter("date <> ''").groupBy("date").agg(F.count("*").alias("folders"))
    return show_fields(spark, d).join(f, "date").select("show_id", "folders")


@query("J-22", sql="""with p as (select distinct regexp_extract(release_id, '^([a-z]+)', 1) as prefix from {RELEASES}), a as (select distinct norm, name from monitored_artists)
 select p.prefix, a.name from p join a on p.prefix <> '' and (p.prefix = a.norm or (length(p.prefix) >= 4 and starts_with(a.norm, p.prefix)) or p.prefix = array_to_string(list_transform(regexp_extract_all(lower(a.name), '[a-z0-9]+'), lambda w: left(w, 1)), ''))""")
def prefix_owner(spark: SparkSession, d: str) -> DataFrame:
    """Which watched acts a prefix may stand for: the key, its beginning, or the initials. The keys of each act are exploded, so the join is on equal keys."""
    a = table(spark, d, "monitored_artists").select("norm", "name")
    keys = F.array_distinct(F.concat(F.array("norm", text.initials(F.col("name"))), F.transform(F.sequence(F.lit(4), F.greatest(F.lit(4), F.length("norm"))), lambda k: F.substring("norm", F.lit(1), k))))
    p = release_fields(spark, d).select(F.regexp_extract("release_id", "^([a-z]+)", 1).alias("prefix")).filter("prefix <> ''").distinct()
    return p.join(a.select("name", F.explode(keys).alias("prefix")).distinct(), "prefix").select("prefix", "name")


@query("J-23", "J-24", sql=f"""with k as (select show_id, {_N.format('artist')} as a, date, count(*) over (partition by {_N.format('artist')}, date) as n, min(show_id) over (partition by {_N.format('artist')}, date) as first from {{SHOWS}} where {_N.format('artist')} <> '' and date <> '') select show_id, first, n from k where n > 1""")
def duplicates_by_artist_and_date(spark: SparkSession, d: str) -> DataFrame:
    """Shows of which there are several by act and date, with the first of them: an aggregate and a join, so a hot key is no single task's."""
    s = show_fields(spark, d).select("show_id", text.norm_key(F.col("artist")).alias("a"), "date").filter("a <> '' and date <> ''")
    n = s.groupBy("a", "date").agg(F.count("*").alias("n"), F.min("show_id").alias("first")).filter("n > 1")
    return s.join(n, ["a", "date"]).select("show_id", "first", "n")


@query("J-25", sql="""with f as (select id, regexp_replace(release_id, '[.][0-9]+$', '') as stem, data.formats as formats from (select distinct id, release_id, data from releases)),
 g as (select stem, count(*) as n, count(distinct id) as ids from f group by stem) select f.id, g.n from f join g on g.stem = f.stem where g.n > 1""")
def sibling_stems(spark: SparkSession, d: str) -> DataFrame:
    """Rows that share the stem of their name with others."""
    f = release_fields(spark, d).select("id", F.regexp_replace("release_id", "[.][0-9]+$", "").alias("stem"))
    return f.join(f.groupBy("stem").agg(F.count("*").alias("n")).filter("n > 1"), "stem").select("id", "n")


@query("R-4", "R-23", "R-24", "X-36", "F-14")
def related_names(spark: SparkSession, d: str) -> DataFrame:
    """Whether a folder's name and the meta's artist can be one act: equal, contained, a word in common, initials, or similar."""
    s = show_fields(spark, d).select("show_id", "artist", parse.folder_name(F.col("folder_name"))["artist"].alias("head")).filter("artist is not null and head is not null")
    return s.select("show_id", "artist", "head", fuzzy.names_related(F.col("artist"), F.col("head")).alias("related"))


QUERIES, ORACLE, COVERS = family.queries, family.oracle, family.covers
