from datetime import datetime, timezone

from mailweave.operators.instants import to_instants

MAIL = "row_idx long, date_text string, source_file string, mailbox string"
BOXES = "mailbox string, home_zone string, day_first boolean"


def us(*parts):
    return int(datetime(*parts, tzinfo=timezone.utc).timestamp() * 1_000_000)


CASES = [
    ("Thu, 29 Mar 2001 21:05:09 -0600", us(2001, 3, 30, 3, 5, 9)),
    ("Thu, 29 Mar 2001 21:05:09 -0000", us(2001, 3, 29, 21, 5, 9)),
    ("Sun, 13 May 2001 19:14:15 +0900 (CDT)", us(2001, 5, 13, 10, 14, 15)),
    ("2003-03-11 00:24:08.153 -0600", us(2003, 3, 11, 6, 24, 8) + 153_000),
    ("2002-06-26 09:01:32[Europe/London]", us(2002, 6, 26, 8, 1, 32)),
    ("2001-10-28 01:52:25[America/Chicago]", None),
    ("2001-04-01 02:55:41", None),
    ("2001-05-01 02:55:41", us(2001, 5, 1, 7, 55, 41)),
    ("Fri May 30 11:54:54 CDT 2003", us(2003, 5, 30, 16, 54, 54)),
    ("Fri May 30 11:54:54 XYZ 2003", None),
    ("Tuesday, May 27, 2003 3:23 PM EDT", us(2003, 5, 27, 19, 23)),
    ("Tue, 31 Jun 2000 09:03:11 -0600", None),
    ("2002-13-06T08:00:00Z", None),
    ("963186699095", 963186699095000),
    ("963186699", 963186699000000),
    ("25 Sep 01 19:14:46 -0500", us(2001, 9, 26, 0, 14, 46)),
    ("Thu, 28 Feb", None),
    (" 03/04/2001 05:00 pm ", us(2001, 3, 4, 23, 0)),
    ("1969-07-20 20:17:40", us(1969, 7, 21, 1, 17, 40)),
    ("2101-07-20 20:17:40[America/New_York]", us(2101, 7, 21, 0, 17, 40)),
    ("2001-05-01 02:55:41 Nowhere/Town", None),
    ("", None),
    (None, None),
]


def test_notations(spark):
    rows = [(i, t, "maildir/a/inbox/1.", "clash") for i, (t, _) in enumerate(CASES)] + [(100, "03/04/2001 05:00 PM", "maildir/b/inbox/2.", None), (101, "2001-05-01 02:55:41", "maildir/unknown/x/1.", None), (102, "2001-05-01 02:55:41Z", None, None)]
    boxes = [("a", "America/Chicago", False), ("b", "Europe/Berlin", True)]
    got = {r.row_idx: r.utc_us for r in to_instants(spark.createDataFrame(rows, MAIL), spark.createDataFrame(boxes, BOXES)).collect()}
    assert {i: got.get(i) for i in range(len(CASES))} == {i: want for i, (_, want) in enumerate(CASES)}
    assert got[100] == us(2001, 4, 3, 15, 0) and 101 not in got and got[102] == us(2001, 5, 1, 2, 55, 41)


def test_empty(spark):
    assert to_instants(spark.createDataFrame([], MAIL), spark.createDataFrame([], BOXES)).collect() == []
