import pytest
from pyspark.sql import functions as F

from tapeloom.functions import fuzzy, parse, text
from tapeloom.operators import predicates


def one(spark, f, value, kind="string"):
    return spark.createDataFrame([(value,)], f"c {kind}").select(f(F.col("c")).alias("r")).first()["r"]


CASES = [
    (text.norm_key, "Motörhead & Co.", "motrheadco"),
    (text.norm_key, None, None),
    (text.fold, "São Łódź", "saolodz"),
    (text.fold, "Saint Mary", "stmary"),
    (text.city_key, "Paris (Le Zénith)", "paris"),
    (text.song_norm, "The Long Road (reprise) > Next", "longroad"),
    (text.initials, "The Purple Sage", "tps"),
    (text.digit_share, "1234ab78", 0.75),
    (text.digit_share, "", 0.0),
    (text.clean_title, "Long Road [4:33] ->", "Long Road"),
    (text.clean_title, "Twice Twice", "Twice"),
    (text.title_case, "o'brien and ÉLAN", "O'Brien And Élan"),
    (text.name_case, "mcCoy", "mcCoy"),
    (text.name_case, "JOHN DOE", "John Doe"),
    (text.camel_split, "HenryMcCoy_Band", "Henry McCoy Band"),
    (text.safe_name, 'a/b:c?.', "a-b-c-"),
    (text.safe_name, " . ", "Unknown"),
    (text.safe_name, None, "Unknown"),
    (text.strip_label, "Venue: Orvan Hall", "Orvan Hall"),
    (text.clean_artist, "Artist: THE ORVANS (live)", "The Orvans"),
    (text.html_lines, "<p>a<br>b &amp; c</p>", "a\nb & c\n"),
    (text.html_lines, "a < b", "a < b"),
    (text.magnet_hash, "magnet:?xt=urn:btih:" + "A" * 40, "a" * 40),
    (text.redact, "https://me:pw@h/x?api_key=k1&y=2", "https://me:***@h/x?api_key=***&y=2"),
    (text.clock, 125, "2:05"),
    (text.clock, None, "?"),
    (parse.extract_date, "recorded March 21st, 2021", "2021-03-21"),
    (parse.extract_date, "21 Mar 2021", "2021-03-21"),
    (parse.extract_date, "gd77-05-08", "1977-05-08"),
    (parse.extract_date, "03/21/2021 and 2020.1.2", "2020-01-02"),
    (parse.extract_date, "3-21-2021", "2021-03-21"),
    (parse.extract_date, "12-31-99", "1999-12-31"),
    (parse.extract_date, "2021-02-30", None),
    (parse.extract_date, "nothing", None),
    (parse.extract_date, "sept. 3, 1999", "1999-09-03"),
    (parse.extract_date, "2001-02-30 or 1 June 1999", "1999-06-01"),
    (parse.extract_date, "99-02-30, 98-11-06", "1998-11-06"),
    (parse.extract_date, "06-11-98", "1998-06-11"),
    (parse.extract_date, "12/31/99", None),
    (parse.extract_date, "1899-01-01 2000_01_02", "2000-01-02"),
    (parse.extract_date, "abc2000-01-02", None),
    (parse.extract_date, "3-21-2021x", None),
    (parse.extract_date, "2000-01/02", None),
    (parse.extract_date, "", None),
    (parse.extract_date, None, None),
    (parse.source_type, "DSBD master", "SBD"),
    (parse.source_type, "FM broadcast", "SBD.FM"),
    (parse.source_type, "front FOB mics", "AUD.FOB"),
    (parse.source_type, None, ""),
    (parse.source_type, "Matrix of SBD + AUD", "MTX"),
    (parse.source_type, "sound board", "SBD"),
    (parse.source_type, "two omnis", "AUD"),
    (parse.source_type, "hi-fi", ""),
    (parse.infer_source, "soundboard feed mixed with omnis", "MTX"),
    (parse.infer_source, "audience recording", "AUD"),
    (parse.shnid, "show [SBD 12345]", "012345"),
    (parse.shnid, "shn 1234567", "1234567"),
    (parse.track_number, "gd77-05-08d1t05.flac", 5),
    (parse.track_number, "05 - Song.flac", 5),
    (parse.track_number, "1977-05-08.flac", None),
    (parse.track_number, "Track 07.flac", 7),
    (parse.track_number, "Song - 12.shn", 12),
    (parse.track_number, "05-06-77.flac", None),
    (parse.track_number, "t1234.flac", None),
    (parse.track_number, "", None),
    (parse.track_number, None, None),
    (parse.disc_number, "cd3t04", 3),
    (parse.disc_number, "x disc 2t04", 2),
    (parse.disc_number, None, 1),
    (parse.disc_number, "d2t01.flac", 2),
    (parse.disc_number, "song.flac", 1),
    (parse.show_part, "The Early Years 1978-03-25 late show", "late"),
    (parse.show_part, "x 1978-03-25 early late", ""),
    (parse.recorder, "a\nTaped by: Sam Orvan\n", "Orvan"),
    (parse.recorder, "taper = Kesten", "Kesten"),
    (parse.recorder, "Recordist:\nTaper: MK4", None),
    (parse.recorder, None, None),
    (predicates.filler, "Crowd / Tuning", True),
    (predicates.filler, "Crowded Room", False),
]


@pytest.mark.parametrize("f, value, want", CASES, ids=[f"{f.__name__}-{str(v)[:20]}" for f, v, _ in CASES])
def test_scalar(spark, f, value, want):
    assert one(spark, f, value, "int" if isinstance(value, int) else "string") == want


def test_folder_and_album(spark):
    f = one(spark, parse.folder_name, "Henry.Orvan1998.13.06.sbd")
    assert (f["artist"], f["date"]) == ("Henry Orvan", "1998-13-06")  # month 13 survives
    a = one(spark, parse.album_string, "1998-11-06 Orvan Hall, Kesten Falls, ST [SBD 012345]")
    assert (a["date"], a["venue"], a["city"], a["state"], a["source_type"], a["shnid"], a["complete"]) == ("1998-11-06", "Orvan Hall", "Kesten Falls", "ST", "SBD", "012345", True)
    line = one(spark, parse.location_line, "Kesten, ST @ Orvan Hall")
    assert tuple(line) == ("Orvan Hall", "Kesten", "ST")


def test_ratio_is_asymmetric(spark):
    df = spark.createDataFrame([("tide", "diet"), ("diet", "tide"), (None, "x"), ("", "")], "a string, b string")
    assert [r[0] for r in df.select(fuzzy.ratio(F.col("a"), F.col("b"))).collect()] == [0.25, 0.5, None, 1.0]


@pytest.mark.parametrize("a, b, want", [("Jerry Orvan", "Jerry Orvan Band", True), ("nrps", "New Riders of the Purple Sage", True), ("Toad Sprocket", "Quiet Kings", False), ("", "x", False), (None, "x", False)])
def test_related(spark, a, b, want):
    df = spark.createDataFrame([(a, b)], "a string, b string")
    assert df.select(fuzzy.names_related(F.col("a"), F.col("b"))).first()[0] is want
