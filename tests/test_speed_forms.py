"""Faster forms of text functions give what the plain ones gave."""

import random
import re
from datetime import date

from pyspark.sql import functions as F

from linksift.functions import dates, text

C = F.col


def test_runs_equal_replacing_what_lies_between(spark):
    draw = random.Random(5)
    rows = [("".join(draw.choice("aZ9 +&#@.\t\n 　﻿<é-") for _ in range(draw.randrange(12))),) for _ in range(400)] + [(None,), ("",), (" ",)]
    df = spark.createDataFrame(rows, "t string")
    old = {"match": F.trim(F.regexp_replace(text.fold_accents(C("t")), "[^a-z0-9+&#@]+", " ")), "title": F.trim(F.regexp_replace(text.fold_accents(C("t")), "[^a-z0-9]+", " ")),
           "space": F.trim(F.regexp_replace("t", text._NO_SPACE.replace("[^", "[", 1), " "))}
    new = {"match": text.match_text(C("t")), "title": text.title_text(C("t")), "space": text.collapse_space(C("t"))}
    assert df.filter(F.lit(False) if not old else ~F.struct(*old.values()).eqNullSafe(F.struct(*[c.alias(f"col{i + 1}") for i, c in enumerate(new.values())]))).count() == 0
    assert "regexp_replace(" not in df.select(new["space"])._jdf.queryExecution().optimizedPlan().toString()


def test_bare_years_are_looked_for_at_years_only(spark):
    """The form before, with the look-around first, finds the same years."""
    before = dates._BARE_YEAR.replace(f"(?=20[0-9]{{2}}{dates._END})", "", 1) + dates._END
    assert before != dates._BARE_YEAR + dates._END
    draw = random.Random(7)
    pieces = ["2019", "2020 ", "event", " dinner ", "x" * 70, " ", "12020", "2021a", "\n", "luma", "-2018-", "demo2017"]
    rows = [("".join(draw.choice(pieces) for _ in range(draw.randrange(9))),) for _ in range(500)]
    df = spark.createDataFrame(rows, "t string")
    found = [F.regexp_extract_all("t", F.lit(p), F.lit(0)) for p in (before, dates._BARE_YEAR)]
    assert df.filter(found[0] != found[1]).count() == 0
    assert df.filter(F.size(found[0]) > 0).count() > 50


def test_explicit_dates_evaluate_their_text_once(spark):
    found = dates.explicit_dates(F.concat("t", F.lit(" on july 4th")), date(2024, 6, 15))
    df = spark.createDataFrame([("2024-05-01 and",), (None,)], "t string")
    assert [r["d"] for r in df.select(found.alias("d")).collect()] == [[date(2024, 5, 1), date(2024, 7, 4)], []]
    assert len(re.findall("lower\\(", df.select(found.alias("d"))._jdf.queryExecution().optimizedPlan().toString())) == 1
