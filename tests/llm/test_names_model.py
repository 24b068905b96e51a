"""Links of names do not rest on blocks or on how often others are written."""

import pytest

from veristrata.llm import names
from veristrata.tables import table


def links(spark, values, known, block):
    return sorted(map(str, names.link(values, known, block).collect()))


@pytest.fixture(scope="module")
def known(spark, folder):
    return table(spark, folder, "known_names")


def test_blocks_do_not_change_links(spark, folder, known):
    c = table(spark, folder, "claims")
    values = c.selectExpr("'claims' as tab", "claim_key as row_id", "'org' as field", "'org' as kind", "entities['org'] as value").unionByName(c.selectExpr("'claims' as tab", "claim_key as row_id", "'advisor' as field", "'person' as kind", "entities['advisor'] as value"))
    one = links(spark, values, known, names.NAME_BLOCK)
    assert one and one == links(spark, values, known, 60)


ROWS = [(1, "person", "Samuel Yarlund", "Samuel Yarlund"), (2, "person", "Samuel Yarham", "Samuel Yarham"), (3, "person", "Nina Yarmont", "Nina Yarmont"), (4, "person", "Nina Kerlund", "Nina Kerlund"), (5, "person", "Olga Kerham", "Olga Kerham"), (6, "person", "Olga Kermont", "Olga Kermont"), (7, "person", "Ivan Grislund", "Ivan Grislund"), (8, "person", "Ivan Grisham", "Ivan Grisham"), (9, "person", "Ivan Grismont", "Ivan Grismont"), (10, "org", "泠陂科技有限公司", "Lingbei Technology Co., Ltd.")]


def frame(spark, data):
    return spark.createDataFrame([("t", i, "advisor", "person", v, "c") for i, v in enumerate(data)], "tab string, row_id bigint, field string, kind string, value string, full_name string")


def test_frequent_error_links(spark):
    """One site writes an error thousands of times; the entry never stands without it."""
    known = spark.createDataFrame(ROWS, "name_id bigint, kind string, full_name string, latin_name string")
    got = names.link(frame(spark, ["Samuel Yarlnud"] * 50), known).collect()
    assert len(got) == 50 and {r["name_id"] for r in got} == {1}


def test_doubtful_links_only_where_rare(spark):
    """Grisham, one letter from a made-up Grismam, is a name of its own where it is written as often as the entry."""
    known = spark.createDataFrame(ROWS, "name_id bigint, kind string, full_name string, latin_name string")
    right = ["S. Yarlund"] * 20
    assert {r["name_id"] for r in names.link(frame(spark, right + ["Samuel Zarlund"]), known).collect() if r["row_id"] == 20} == {1}
    assert not [r for r in names.link(frame(spark, right + ["Samuel Zarlund"] * 15), known).collect() if r["row_id"] >= 20]


def test_long_values_and_common_words():
    index = names.Index([*ROWS, *[(100 + i, "org", f"{c}川大学", f"{n}chuan University") for i, (c, n) in enumerate(zip("兰青白金", "Lan Qing Bai Jin".split()))]]).compile()
    assert index.resolve("word " * 50_000, "org") == (99.0, None) and index.resolve("字" * 50_000, "org") == (99.0, None)
    assert index.resolve("Lanch. University", "org")[1] == 100  # by its beginning alone
    assert index.resolve("University", "org")[1] is None


def test_ties_over_blocks_link_to_none(spark):
    known = spark.createDataFrame([(i, "person", n, n) for i, n in enumerate(["Anna Berg", "Anton Berg", "Olga Stone", "Nina Wood"])], "name_id bigint, kind string, full_name string, latin_name string")
    assert names.link(frame(spark, ["A. Berg", "O. Stone"]), known, 1).collect()[0]["name_id"] == 2
    assert names.link(frame(spark, ["A. Berg", "O. Stone"]), known, 1).count() == 1


def test_model_is_of_all_names(spark, folder, known, monkeypatch):
    """Names beyond MODEL_NAMES count too: the same model, the same places, the same links."""
    odd = [*ROWS, (20, "org", "海", None), (21, "org", "海大", ""), (22, "org", "青川大学", "Qingchuan University"), (22, "org", "青川大学", "Qingchuan University"), (23, None, "No Kind", None), (24, "person", "Solo", None), (25, "org", "𠀀川大学 A", "Ba Chuan"), (26, "org", "青河大学", "Qinghe University")]
    names_ = known.selectExpr("name_id", "kind", "full_name", "latin_name").unionByName(spark.createDataFrame(odd, "name_id bigint, kind string, full_name string, latin_name string"))
    rows = [tuple(r) for r in names_.collect()]
    want, (model, placed) = names.Model(rows), names.Model.of_all(names_, len(rows))
    for x in "most_words most_chars common wide heads tails kinds pool syllables".split():
        assert getattr(want, x) == getattr(model, x), x
    placed = [tuple(r) for r in placed.collect()]
    assert sorted(map(str, (r[:4] for r in placed))) == sorted(map(str, rows))
    assert all(r[4] == len(want.parts(names.plain(r[2]))[0]) for r in placed if r[1] == "org" and names._HAN.search(names.plain(r[2])))
    c = table(spark, folder, "claims")
    values = c.selectExpr("'claims' as tab", "claim_key as row_id", "'org' as field", "'org' as kind", "entities['org'] as value").unionByName(c.selectExpr("'claims' as tab", "claim_key as row_id", "'advisor' as field", "'person' as kind", "entities['advisor'] as value"))
    one = links(spark, values, known, names.NAME_BLOCK)
    monkeypatch.setattr(names, "MODEL_NAMES", 10)
    assert one and one == links(spark, values, known, names.NAME_BLOCK) == links(spark, values, known, 60)
