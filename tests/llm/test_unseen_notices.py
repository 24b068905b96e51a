"""Notices in wordings that no list holds as they stand, and text that only looks like one: recall and precision on unseen lines."""

import pytest

from veristrata.llm import residue

UNSEEN = [
    "This domain is for sale.", "This account has been suspended.", "Service Unavailable", "Our server is down, come back later.", "You don't have permission to view this directory or page.", "Verifying your browser before proceeding", "Acceso denegado.", "Veuillez vous connecter pour continuer.", "Wartungsarbeiten – bitte später wiederkommen", "ページが見つかりません", "页面飞走了", "您的账号存在风险，请稍后再试。",
    "The requested page does not exist.", "The resource you are looking for has been removed or is temporarily unavailable.", "Your connection has expired.", "This video is no longer available", "You are not authorized to view this content.", "Please check back soon.", "Página no encontrada", "Sitio en construcción", "La page n'existe plus", "Diese Seite ist derzeit nicht erreichbar.", "Страница не найдена", "Доступ запрещён", "ログインが必要です。", "페이지를 찾을 수 없습니다", "该域名已过期", "本店铺已关闭", "Bad Gateway", "The website is under maintenance. Please try again later.",
]


def test_unseen_recall():
    found = [residue.is_evidence(x) for x in UNSEEN]
    assert sum(found) >= 0.9 * len(found), [x for x, f in zip(UNSEEN, found) if not f]


@pytest.mark.parametrize("line", ["The server was moved to the second floor in May 2019.", "This account of the flood is kept by the archive.", "The page boy was closed to nobody at court.", "The site is open to visitors from ten to four.", "Our service is held on Sundays in the chapel.", "You don't have permission slips? Ask the front desk for one of the forms before Friday noon.", "Forbidden fruits were drawn by twelve students for the exhibition.", "该网站由计算机学院维护，介绍历届获奖名单。", "账号系统的设计获得一等奖。", "页面设计由学生完成，展示了三个项目。", "Der Zugang zur Seite führt durch den Garten.", "The article is available in the library and was read aloud."])
def test_text_is_no_notice(line):
    assert not residue.is_evidence(line)


SCHEMA = "tab string, row_id bigint, host string, title string, text string"


def test_the_counts_decide(spark, monkeypatch):
    """Lines with the look of furniture are subtracted because they recur, by their first words; one that stands nowhere else is content."""
    words = "amber birch cedar delta ember flint grove heath inlet jetty".split()
    data = [("t", i, "h", None, f"Next: the {words[i % 10]} {words[i // 10]}\nVisits: {i * 37}\nThe {words[i % 10]} of the {words[i // 10]} was read aloud in the hall.") for i in range(60)]
    data += [("t", 100, "h", None, "Next: a page that is nowhere else\nVisits: 5\n404 Not Found"), ("t", 101, "h", None, "Impressum der Schule am See\n404 Not Found"), ("t", 102, "h", None, "404 Not Found")]
    df = spark.createDataFrame(data, SCHEMA)
    got = lambda: {r["row_id"] for r in residue.exclude(df).collect()}
    assert got() == {100, 102}
    monkeypatch.setattr(residue, "RECURRENT", 9.0)
    monkeypatch.setattr(residue, "RECURRENT_ALL", 9.0)
    assert got() == {102}
