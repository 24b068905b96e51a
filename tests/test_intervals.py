import datetime as dt
import random

from pyspark.sql import functions as F

from veristrata.operators.intervals import first_day, last_day, spans

SCHEMA = "report_id bigint, date_start string, date_end string, day string, x int, _s string, _entity int"


def run(spark, rows):
    df = spark.createDataFrame([(*r, "clash", 1, "clash", 2) for r in rows], SCHEMA)
    return sorted((r[0], r[1], str(r[2]), str(r[3])) for r in spans(df, "report_id", "date_start", "date_end").where("report_id is not null").collect())


def brute(rows):
    days = {}
    for r, s, e in rows:
        if r is not None:
            days.setdefault(r, set()).update(s + dt.timedelta(i) for i in range((e - s).days + 1))
    out = []
    for r, d in days.items():
        d, start = sorted(d), None
        for i, x in enumerate(d):
            if start is None:
                start = x
            if i + 1 == len(d) or d[i + 1] - x > dt.timedelta(1):
                out.append((r, "period", str(start), str(x)))
                start = None
                if i + 1 < len(d):
                    out.append((r, "gap", str(x + dt.timedelta(1)), str(d[i + 1] - dt.timedelta(1))))
    return sorted(out)


def test_against_brute_force(spark):
    rnd = random.Random(1)
    rows = []
    for _ in range(400):
        s = dt.date(2020, 1, 1) + dt.timedelta(rnd.randrange(200))
        rows.append((rnd.randrange(12), s, s + dt.timedelta(rnd.choice([0, 0, 1, 3, 9]))))
    rows += rows[:50]  # repeated rows
    assert run(spark, [(r, str(s), str(e)) for r, s, e in rows]) == brute(rows)


def test_dirty_bounds(spark):
    rows = [
        (1, "2020-01-01", "2020-01-05"), (1, " 2020-01-06 ", "2020-01-06"), (1, "2020-02", "2020-02"), (1, "2021", "2021"), (1, None, "2020-03-01"), (1, "2020-02-30", "2020-03-01"),
        (1, "2020-05-02", "2020-05-01"), (1, "", ""), (1, "x" * 100_000, "2020"), (2, "0000-01-01", "2020"), (None, "2020", "2020"), (3, "2020-13", "2021"), (4, "至今", "present"),
    ]
    assert run(spark, rows) == [(1, "gap", "2020-01-07", "2020-01-31"), (1, "gap", "2020-03-01", "2020-12-31"), (1, "period", "2020-01-01", "2020-01-06"), (1, "period", "2020-02-01", "2020-02-29"), (1, "period", "2021-01-01", "2021-12-31")]


def test_empty(spark):
    assert run(spark, []) == []


def test_one_hot_entity_and_ties(spark):
    rows = [(7, "2020-01-01", "2020-01-02")] * 500 + [(7, "2020-01-04", "2020-01-04")]
    assert run(spark, rows) == [(7, "gap", "2020-01-03", "2020-01-03"), (7, "period", "2020-01-01", "2020-01-02"), (7, "period", "2020-01-04", "2020-01-04")]


def test_bounds_of_months_and_years(spark):
    r = spark.createDataFrame([("2024-02", "2023")], "m string, y string").select(first_day(F.col("m")), last_day(F.col("m")), first_day(F.col("y")), last_day(F.col("y"))).first()
    assert [str(x) for x in r] == ["2024-02-01", "2024-02-29", "2023-01-01", "2023-12-31"]
