import itertools
import random

import pytest

from veristrata.operators import timestamps as T

CASES = [
    ("2024-03-10T02:30:00", "America/New_York", "2024-03-10T07:30:00Z"), ("2024-11-03 01:30:00", "America/New_York", "2024-11-03T05:30:00Z"), ("2024-03-31 02:15:00", "Europe/Berlin", "2024-03-31T01:15:00Z"),
    ("2017-01-01T00:27:24+08:00[Asia/Shanghai]", None, "2016-12-31T16:27:24Z"), ("2016-11-09 12:31:12.988348 +05:45", None, "2016-11-09T06:46:12Z"), ("2018-09-09T06:16:35-0400", None, "2018-09-09T10:16:35Z"),
    ("北京时间2019-12-17 02:47:49", "America/New_York", "2019-12-16T18:47:49Z"), ("2018年6月15日 上午12:25", "Asia/Shanghai", "2018-06-14T16:25:00Z"), ("2017年2月2日 下午10:54", "UTC", "2017-02-02T22:54:00Z"), ("2021年5月26日 下午12:13", "UTC", "2021-05-26T12:13:00Z"),
    ("Tue, 03 May 2022 01:28:46 GMT", None, "2022-05-03T01:28:46Z"), ("09-Jul-2022 09:30:27 UTC", None, "2022-07-09T09:30:27Z"), ("Mar 26, 2017, 12:05 AM", "UTC", "2017-03-26T00:05:00Z"), ("2019-11-03 05:34:27 PST", None, "2019-11-03T13:34:27Z"), ("2024-03-19 14:51:58 Asia/Shanghai", None, "2024-03-19T06:51:58Z"),
    ("1714000799", None, "2024-04-24T23:19:59Z"), ("1607656727973", None, "2020-12-11T03:18:47Z"), ("20210429", None, "2021-04-29"), ("201201", None, "2012-01"), ("2014", None, "2014"), ("2020年", None, "2020"), ("10/2017", None, "2017-10"), ("2025.7", None, "2025-07"),
    ("13.05.2021", None, "2021-05-13"), ("20200102T030405Z", None, "2020-01-02T03:04:05Z"), ("2020/1/2 下午3:04", "Asia/Shanghai", "2020-01-02T07:04:00Z"), ("31/12/2018", None, "2018-12-31"), ("12/31/2018", None, "2018-12-31"), ("7/7/2021", None, "2021-07-07"), ("２０１６－１１－１８", None, "2016-11-18"), ("发布时间：2022-09-23", None, "2022-09-23"),
    ("二〇二〇年十二月", None, "2020-12"), ("二〇一七年六月二十四日", None, "2017-06-24"), ("二〇一五年十月三十一日", None, "2015-10-31"), ("2017.06 至 至今", None, "2017-06/.."), ("2022.05-至今", None, "2022-05/.."), ("2021.12–2022.02", None, "2021-12/2022-02"), ("2014.11 — 2016.11", None, "2014-11/2016-11"), ("September 2018", None, "2018-09"), ("Wed, 24 October 2012", None, "2012-10-24"),
]


@pytest.mark.parametrize("value, tz, normal", CASES)
def test_one_reading(value, tz, normal):
    assert [r[0] for r in T.readings(value, tz) if not r[3]] == [normal]


@pytest.mark.parametrize("value", [None, "", "  ", "yesterday", "刚刚", "3天前", "N/A", "2021-02-30", "2009-13", "31/02/2020", "0000-00-00 00:00:00", "2023-04-31T08:15:00Z", "x" * 200_000, "2024-01-01 25:00:00", "时间不详"])
def test_no_reading(value):
    assert T.readings(value, "UTC") == []


def test_zoneless_needs_a_zone():
    assert T.readings("2024-01-01 10:00:00", None) == T.readings("2024-01-01 10:00:00", "No/Where") == []


def test_two_readings():
    assert [r[0] for r in T.readings("3/4/2020")] == ["2020-04-03", "2020-03-04"]
    assert [r[0] for r in T.readings("03.04.2020")] == ["2020-04-03", "2020-03-04"]
    assert [(r[0], r[3] > 0) for r in T.readings("2020-07-02 10:00:00 EST", "Australia/Brisbane")] == [("2020-07-02T15:00:00Z", True), ("2020-07-02T00:00:00Z", False)]


def test_viterbi_is_the_best_path():
    chain = [T.readings(v) for v in ("15/3/2020", "3/4/2020", "5/4/2020", "2020-04-20", "4/5/2020")]

    def cost(path):
        return sum(T.step_cost(a[i], b[j]) for a, b, i, j in zip(chain, chain[1:], path, path[1:])) + sum(T.own_costs(c)[i] for c, i in zip(chain, path))

    best = min(itertools.product(*[range(len(c)) for c in chain]), key=cost)
    assert cost(T.viterbi(chain)) == cost(best)
    assert [c[k][0] for c, k in zip(chain, T.viterbi(chain))][:3] == ["2020-03-15", "2020-04-03", "2020-04-05"]


def frame(spark, rows):
    return spark.createDataFrame([(*r, "clash", 1) for r in rows], "tab string, row_id bigint, field string, source string, tz string, value string, block string, normal int")


def test_operator(spark):
    rows = [("e", 1, "f", "s", "UTC", "15/3/2020"), ("e", 2, "f", "s", "UTC", "3/4/2020"), ("e", 2, "f", "s", "UTC", "3/4/2020"), ("e", 3, "f", "s", "UTC", "20/4/2020"), ("e", 4, "f", None, None, "2020-01-01 10:00:00"), ("e", 5, "f", None, None, "2020-01-01"), ("e", None, "f", "s", "UTC", "2020"), ("e", 6, "f", "s", "UTC", None), (None, 7, None, "s", "UTC", "2021")]
    got = sorted((r["row_id"], r["normal"], r["n_readings"]) for r in T.normalise(frame(spark, rows)).collect())
    assert got == [(1, "2020-03-15", 1), (2, "2020-04-03", 2), (3, "2020-04-20", 1), (5, "2020-01-01", 1), (7, "2021", 1)]


def planted(rnd, n):
    """Records of four sources, most with days that can be read in two ways."""
    out = []
    for source in ("a", "b", "c", None):
        for i in range(n):
            y, m, d, k = 2015 + i // 60, rnd.randint(1, 12), rnd.randint(13, 28), rnd.random()
            two = f"{rnd.randint(1, 12):02d}/{rnd.randint(1, 12):02d}/{y}" if k < 0.5 else f"{rnd.randint(1, 12)}.{rnd.randint(1, 12)}.{y}"
            out.append(("t", i, "f", source, "UTC", two if source == "a" or k < 0.8 else f"{d}/{m}/{y}" if k < 0.85 else f"{m}/{d}/{y}" if k < 0.9 else f"{y}-{m:02d}-{d:02d}"))
    return out


def test_blocks_do_not_matter(spark):
    """Also where a source is undecided throughout, and where a run reaches over several blocks."""
    df = frame(spark, planted(random.Random(5), 150) * 2)
    got = [sorted(map(str, T.normalise(df, b).collect())) for b in (1, 7, 64, 10**6)]
    assert len(got[0]) == 600 and got[0] == got[1] == got[2] == got[3]


def test_the_chain_decides(spark):
    """Sources that write month or day first throughout: the chain reads the days that could be either as the source writes them."""
    rows = [("t", i, "f", s, "UTC", f"{m}/{d}/2020" if s == "us" else f"{d}/{m}/2020") for s in ("us", "eu") for i, (m, d) in enumerate([(1, 20), (2, 3), (3, 4), (5, 2), (6, 25), (8, 7), (9, 30)])]
    got = {(r["row_id"], r["notation"]): r["normal"] for r in T.normalise(frame(spark, rows)).collect()}
    days = [(1, 20), (2, 3), (3, 4), (5, 2), (6, 25), (8, 7), (9, 30)]
    assert got == {(i, n): f"2020-{m:02d}-{d:02d}" for n in ("mdy/", "dmy/") for i, (m, d) in enumerate(days)}


def test_matrix_composes():
    rnd = random.Random(2)
    chain = [T.readings(f"{rnd.randint(1, 12)}/{rnd.randint(1, 12)}/20{rnd.randint(10, 20)}") for _ in range(9)]
    ids = list(range(9))
    whole = T.viterbi(chain, ids)
    parts = [(b, 0, chain[3 * b], chain[3 * b + 2], [x for r in T.matrix(chain[3 * b : 3 * b + 3], ids[3 * b : 3 * b + 3]) for x in r]) for b in range(3)]
    given = T.ends(parts)
    assert [k for b in range(3) for k in T.viterbi(chain[3 * b : 3 * b + 3], ids[3 * b : 3 * b + 3], *given[b, 0])] == whole


def test_empty(spark):
    assert T.normalise(frame(spark, [])).collect() == []


def test_hours_of_several_zones_in_one_partition():
    import pyarrow as pa

    cols = [["e", "e", "e"], [1, 2, 3], ["f"] * 3, ["a", "b", "c"], [0] * 3, ["Asia/Shanghai", "UTC", "America/New_York"], ["2024年3月5日15时"] * 3]
    batch = pa.RecordBatch.from_arrays([pa.array(c) for c in cols], names=["tab", "row_id", "field", "source", "block", "tz", "value"])
    got = [x for b in T._decide(iter([batch])) for x in b.column(3).to_pylist()]
    assert got == ["2024-03-05T07:00:00Z", "2024-03-05T15:00:00Z", "2024-03-05T20:00:00Z"]
