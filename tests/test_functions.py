"""Scalar functions against literal expectations."""

import datetime as dt

from pyspark.sql import functions as F

from folioscan.functions import dates as D
from folioscan.functions import text as T
from folioscan.functions import values as V
from folioscan.operators.chunking import split_text


def one(spark, *columns):
    return tuple(spark.range(1).select(*columns).first())


def test_fuzzy_reference(spark):
    got = one(spark, *(T.fuzzy_reference(F.lit(x)) for x in ("CSSF Circular 11/498", "CSSF 11-498", " eba  GL/2021_05 ", "Directive", "")))
    assert got == ("11/498", "11/498", "gl/2021/05", "", "")


def test_topic_rules_differ_on_parts_of_words(spark):
    assert one(spark, T.topic_by_substring(F.lit("jurisdiction")), T.topic_by_word(F.lit("On jurisdictions"), F.lit("")), T.topic_by_word(F.lit("ICT risk"), F.lit(""))) == (True, False, True)


def test_bands(spark):
    days = (-1, 10, 30, 60, 200, 800)
    assert one(spark, *(D.band(F.lit(d)) for d in days)) == ("OVERDUE", "RED", "RED", "AMBER", "BLUE", "GREY")


def test_lifecycle(spark):
    def stage(title, celex=None, url="", applies=None):
        return one(spark, T.lifecycle(F.lit(title), F.lit(celex), F.lit(url), F.lit(applies).cast("date"), F.lit("2026-01-01").cast("date")))[0]

    assert stage("x", "52022PC0123") == "PROPOSAL"
    assert stage("x", "32022R2554", applies="2027-01-01") == "ADOPTED_NOT_IN_FORCE"
    assert stage("x", "32022R2554") == "IN_FORCE"
    assert stage("x", url="http://data.legilux.public.lu/eli/etat/projet-de-loi/7") == "DRAFT_BILL"
    assert stage("A Consultation Paper") == "CONSULTATION"


def test_severity(spark):
    rows = ((True, True, "Amending x", "CRITICAL"), (False, True, "repeal", "MATERIAL"), (True, False, "x", "INFORMATIONAL"), (True, True, "x", "MATERIAL"))
    for topic, force, title, want in rows:
        assert one(spark, T.severity(F.lit(title), F.lit(topic), F.lit(force)))[0] == want


def test_dates(spark):
    now = F.lit("2030-01-01").cast("timestamp")
    got = one(spark, *(D.feed_date(F.lit(x), F.lit(None).cast("string"), now) for x in ("Tue, 05 Mar 2024 10:00:00 +0200", "05 Mar 2024 10:00:00", None)))
    assert got == (dt.datetime(2024, 3, 5, 8), dt.datetime(2024, 3, 5, 10), dt.datetime(2030, 1, 1))
    assert one(spark, D.dotted_date(F.lit("31.02.2024")), D.worded_date(F.lit("5 Mar 2024")), D.worded_date(F.lit("5 March 2024"))) == (None, dt.date(2024, 3, 5), dt.date(2024, 3, 5))


def test_noisy_json(spark):
    got = one(spark, *(V.json_object(F.lit(x)) for x in ('```json\n{"a": 1}\n```', "no object", '{"a": 1} and }')))
    assert got == ('{"a": 1}', None, None)


def test_coerce_dates_are_whole(spark):
    v, e = V.coerce(F.lit("2026"), F.lit("DATE"), F.array(F.lit("")))
    assert one(spark, v, e) == (None, "not a date")


def test_snippet_and_headings(spark):
    assert one(spark, T.snippet(F.lit("a" * 70 + " HIT " + "b" * 70), F.lit("HIT")))[0] == "a" * 59 + " HIT " + "b" * 59
    assert one(spark, *(T.heading_level(F.lit(x)) for x in ("Chapter IV", "Kapitel 2", "§ 5a", "Art. 3", "Chapters of life"))) == (0, 0, 1, 1, None)
    assert one(spark, T.cross_references(F.lit("see Article 5(1)(a), § 7 and Art. 5(1)(a)")))[0] == ["5(1)(a)", "7"]


def test_splitter_keeps_all_words_and_sizes():
    text = "one two three. " * 50 + "\n\n" + "x" * 500
    got = split_text(text, 100, 20)
    assert max(map(len, got)) <= 100
    assert set("one two three".split()) <= set(" ".join(got).replace(".", " ").split())
    assert split_text("", 10, 2) == []
