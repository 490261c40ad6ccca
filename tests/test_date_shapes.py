"""Dates in many spellings against a general parser."""

import random
from datetime import datetime, timedelta

import pytest

from daygrain.functions import dates as D

parser = pytest.importorskip("dateutil.parser")

DATES = ["%Y-%m-%d", "%d/%m/%Y", "%d/%m/%y", "%d.%m.%Y", "%m.%d.%Y", "%Y.%m.%d", "%d-%m-%Y", "%m-%d-%Y", "%d.%m.%y", "%b %d %Y", "%B %d, %Y", "%d %b %Y",
         "%d %B %Y", "%d-%b-%Y", "%d-%b-%y", "%Y %b %d", "%Y-%b-%d", "%a %b %d %Y", "%A, %d %B %Y", "%a, %d %b %Y", "%Y%m%d", "%d%b%Y", "%b. %d, %Y", "%d. %B %Y"]
CLOCKS = ["", " %H:%M", " %H:%M:%S", "T%H:%M:%S", " %H:%M:%S.%f", " %I:%M %p", " %I:%M:%S%p", " %I %p", " %H:%M:%SZ", " %H:%M:%S UTC", " %H:%M:%S+02:00", ", %H:%M"]
WHOLE = ["%Y%m%d%H%M%S", "%Y%m%d%H%M", "%Y%m%dT%H%M%S", "%Y%m%dT%H%M", "%a %b %d %H:%M:%S %Y"]
PLAIN = ["Feb 3rd, 2020", "21st of March 2019 8:05", "3 feb 2020 8pm", "3.2.2020", "13.2.2020", "1-2-2020", "Sept 9 2019", "9 MAY 2019", "Thursday 2 January 2020 6:05 am"]
UNREAD = ["", "   ", "Feb 2020", "08:15", "tomorrow", "32.13.2020", "Feb 30 2020", "3.2", "2020", "20201301", "31 Foo 2020", "~02~ x"]


def expected(text):
    """Day first exactly where there is a slash; the zone is dropped."""
    found = parser.parse(text, dayfirst="/" in text).replace(tzinfo=None)
    return found.replace(microsecond=found.microsecond // 1000 * 1000)


def texts():
    draw = random.Random(3)
    out = list(PLAIN)
    for _ in range(1200):
        t = datetime(2000, 1, 1) + timedelta(milliseconds=draw.randrange(30 * 365 * 86_400_000))
        shape, clock = (draw.choice(WHOLE), "") if draw.random() < 0.1 else (draw.choice(DATES), draw.choice(CLOCKS))
        out.append(draw.choice([str, str.lower, str.upper])(t.strftime(shape)) + t.strftime(clock))
    return out


def test_shapes_are_read_like_a_general_parser(spark):
    rows = spark.createDataFrame(list(enumerate(texts())), "i int, t string").select("i", "t", D.std_ts("t").alias("ts"))
    wrong = [(r["t"], r["ts"], expected(r["t"])) for r in rows.collect() if r["ts"] != expected(r["t"])]
    assert not wrong, (len(wrong), wrong[:8])


def test_bounds_read_the_same_shapes(spark):
    wrong = []
    for text in texts():
        try:
            if D._parse_bound(text)[0] != expected(text):
                wrong.append(text)
        except ValueError:
            wrong.append(text)
    assert not wrong, (len(wrong), wrong[:8])


def test_other_texts_are_null(spark):
    rows = spark.createDataFrame([(t,) for t in UNREAD], "t string").select("t", D.std_ts("t").alias("ts"))
    assert [(r["t"], r["ts"]) for r in rows.collect() if r["ts"] is not None] == []
    assert all(D.day_of(t) is None for t in UNREAD)
