"""Personal information in free text: found, replaced by typed placeholders or by surrogates.

Texts are read through a plain view, in which width forms, look-alike letters, separate
accents, invisible characters and kinds of blanks are resolved; every character of the view
knows where it stands in the text, so items are cut from the text exactly as they stand.
Kinds: ``email``, ``phone``, ``id_number``, ``address``, ``name``. Numbers are taken by their
shape and what stands before them; names by their surname or given name, their boundaries and
the words around them.

What the items are replaced by, and that different items stay different, is decided in
``surrogates``; ``written`` puts the surrogates into the texts.

Defined results: null and blank texts have no items; texts are read whole at any length;
equal items of a row give one row of ``items`` and are all replaced; a row delivered twice
counts once; values masked with stars are left alone; extra columns are ignored.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veristrata.llm.lookalike import SAME_SHAPE

#: Frequent surnames (fixed values), compound ones first.
COMPOUND = "欧阳 司马 上官 诸葛 尉迟 端木 钟离 皇甫 慕容 令狐 宇文 长孙 司徒 东方 独孤 南宫 夏侯 公孙 轩辕 百里 澹台 公冶 宗政 濮阳".split()
SURNAMES = set("赵钱孙李周吴郑王冯陈褚卫蒋沈韩杨朱秦尤许何吕施张孔曹严华金魏陶姜戚谢邹喻柏窦章苏潘葛奚范彭郎鲁韦马苗凤花方俞任袁柳鲍史唐费廉岑薛雷贺倪汤滕殷罗毕郝邬安常乐傅皮齐康伍余顾孟黄穆萧尹姚邵湛汪祁毛禹狄米贝臧戴宋庞熊纪舒屈项祝董梁杜阮蓝闵席季贾路江童颜郭梅盛林刁钟徐邱骆高夏蔡田樊胡凌霍虞万柯管卢莫房裘缪解丁宣邓郁洪包左石崔吉龚程邢裴陆荣翁荀羊惠曲翟谌封储靳段巫焦谷车侯宓全班仲伊宁仇栾甘厉祖武符刘景詹龙叶司黎薄白蒲邰赖卓蔺屠蒙池乔闻谭姬申扶冉郦雍桑桂牛边尚农温庄晏柴瞿阎充慕茹习艾鱼容向易戈廖居衡步耿满匡文寇广东利师巩聂晁勾冷辛那简饶曾关相查荆游竺权盖桓隋佟鄢冀宗郗商")
#: Words of two or three characters that begin like a name (fixed values).
NOT_NAMES = set("关键词 关键 文字 白色 党员 高校 高中 方法 方向 时间 安全 成绩 任职 金额 金奖 文件 文科 车队 车间 商务 商学 宗旨 明细 华东 华南 江苏 常务 项目 项 应用 应聘 程序 通讯 通信 经济 计算 农业 农学 简历 简介 相关 查询 全部 全文 全国 广东 广告 利用 师范 师生 易错 向上 温度 湿度 封面 游戏 关于 权限 满分 连续 居住 容量 武术 石油 路由 路线 米色 马上 左右 阅读 阎王 习题 包括 包邮 万元 段落 谷物 田野 花费 黄色 蓝色 红色 康复 史学 钟表 章程 龙头 平台 白天 安排 安装 管理 管理员 盛会 项目组 成员 高级 高等 高级工程师 任务 任课 方案 文学 文书 常用 车辆 程度 申请 申报 申请人 景观 景点 荣誉 祝贺 曲目 司机 司法 宣传 宣布 解决 解释 储备 符合 施工 冷却 温馨 游客 权益 那么 简单 广播 东南 东北 牛奶 边界 尚未 农村 艾滋 步骤 容易 易于 向导 满意 居民 武器 祖国 仲裁 宁静 伊始 全面 班长 班级 班主任 仇恨 厉害 甘肃 金融 金属 华侨 张贴 孔径 严格 何时 施行 许可 吕梁".split())
#: Roles that follow a word for holding them, which is a surname too (fixed values).
ROLES = set("部长 编辑 队长 干事 班长 讲师 助教 主席 教授 组长 志愿 前端 产品 算法 研究 学生 项目 会长 社长 主编 秘书 队员 组员 顾问 主任 院长 校长 科长 处长 经理 总监 助理 实习 教师 老师 导师 馆长 团长 书记 委员 理事 记者".split())
#: Given names that are frequent in many countries, and the gender they are taken for (fixed values); names of other people are told by the frames they stand in.
FEMALE = "Aisha Alice Ana Anna Barbara Camila Charlotte Chiara Clara Elena Elizabeth Emily Emma Eva Fatima Grace Hannah Helen Ines Ingrid Isabel Jane Jennifer Josephine Julia Karen Katherine Kateryna Laura Leila Linda Lucy Margaret Maria Marie Mary Mei Nina Olga Olivia Patricia Priya Rebecca Ruth Sakura Sarah Sofia Susan Victoria Yuki Zoe".split()
MALE = "Adam Ahmed Alan Andrew Anthony Benjamin Carlos Charles Christopher Daniel David Diego Edward Eric Francesco Frank George Hans Henry Hiroshi Ivan Jack James Jean John Joseph Juan Kevin Lars Luca Mark Martin Michael Mohammed Nikolai Oliver Omar Paul Peter Pierre Rajesh Richard Robert Samuel Simon Sven Thomas Walter William Yusuf".split()
_GIVEN = set(FEMALE + MALE)
#: Words that are no part of a person's name (fixed values).
NOT_PERSON = set("The University College School Institute Press Foundation Technology Polytechnic Academic Academy Medal Prize Scholarship Graduate Poster Award Awards List Week Cup Port East West North South Bay Avenue Road Street Lane Row Court Close Faculty Dept Department Merit Second First Third Best Silver Gold Bronze Outstanding Modelling Harbour Coding Dean Dean's Innovation Engineering Medical Normal Finance Work Worked Paper Built Received Candidate Photo Interview Profile By In Our Each Applicants Budget Results Visitors No Note Excerpt Hidden White Forget Reviewer Team Club Teaching Research Software Project Data Open Campus Lecture Gazette Ledger Post Watch Harbor Society Centre Center Library Hall Museum Company Ltd Co Inc Group Journal Conference Workshop Selected Position Education Abstract Keywords January February March April May June July August September October November December Monday Tuesday Wednesday Thursday Friday Saturday Sunday Email Tel Phone Address Flat Unit Apt Room HTTP Status Error New San Los Saint St Lake Mount River United Great Old International National State City County General Chief Senior Junior Vice President Director Manager Engineer Member Language Computer Science Studies Day Year This That These Those We You They She It He His Her A An Is Are Was Der Die Das Diese Dieser Dieses Ein Eine Bitte Hier Cette Ce Le La Les Un Une Contact Dear With Author Authors Speaker Teacher Student Reporter Editor Lecturer Winner And ID SSN DOI ISBN URL".split())

_ODD = re.compile("[­͏؜᠎ -‏ -   -⁯　﻿０-９Ａ-Ｚａ-ｚ＠．－＋＿Ͱ-ӿⅠ-ⅿ⼀-⿟豈-﫿ﬀ-ﬆ̀-ͯ‐-―−]")
_LATIN_TWIN = {o: base for base, others in SAME_SHAPE.items() for o in others if base.isalnum() or base in "-"}
_DASHES = "‐‑‒–—―−"


class _Plain(dict):
    """Each code point's plain character; NUL where a text needs more than a translation (signs that go, accents, letters written with several)."""

    def __missing__(self, code: int) -> str:
        c = chr(code)
        if c.isascii():
            x = c
        elif c in _DASHES:
            x = "-"
        elif c in _LATIN_TWIN:
            x = _LATIN_TWIN[c]
        else:
            kind = unicodedata.category(c)
            x = "\0" if kind in ("Cf", "Mn") else " " if kind == "Zs" else unicodedata.normalize("NFKC", c) if c not in "，（）：；？！" and _ODD.match(c) else c
            x = x if len(x) == 1 else "\0"
        self[code] = x
        return x


_plain_of = _Plain()


class View:
    """The plain view of a text, with the place of each of its characters."""

    __slots__ = ("text", "begin", "end")

    def __init__(self, text: str):
        if not _ODD.search(text):
            self.text, self.begin, self.end = text, None, None
            return
        s = text.translate(_plain_of)
        if "\0" not in s:
            self.text, self.begin, self.end = s, None, None
            return
        out: list[str] = []
        begin: list[int] = []
        end: list[int] = []
        at = 0
        while True:
            i = s.find("\0", at)
            j = len(s) if i < 0 else i
            out += s[at:j]
            begin += range(at, j)
            end += range(at + 1, j + 1)
            if i < 0:
                break
            c, at = text[i], i + 1
            kind = unicodedata.category(c)
            if kind == "Cf" or c == "\0":
                continue
            if kind == "Mn" and out:
                whole = unicodedata.normalize("NFC", out[-1] + c)
                if len(whole) == 1:
                    out[-1], end[-1] = whole, i + 1
                    continue
            for x in unicodedata.normalize("NFKC", c) if kind != "Mn" else c:
                out.append(x)
                begin.append(i)
                end.append(i + 1)
        self.text, self.begin, self.end = "".join(out), begin, end

    def span(self, a: int, b: int) -> tuple[int, int]:
        return (a, b) if self.begin is None else (self.begin[a], self.end[b - 1])


#: Signs that stand around a written-out sign of an address.
_L, _R = r"[\[({<（【《#*_~|-]{1,2}\s?", r"\s?[\])}>）】》#*_~|-]{1,2}"
_AT = rf"\s?{_L}at{_R}\s?"
_DOT = rf"\s?{_L}dot{_R}\s?"
_AT_HINT = re.compile(_AT)
_LOCAL = r"[A-Za-z0-9](?:[A-Za-z0-9._%+-]*[A-Za-z0-9_])?"
_EMAIL = re.compile(
    rf"(?<![A-Za-z0-9._%+-]){_LOCAL}(?:\s?@\s?|{_AT})[A-Za-z0-9-]+(?:(?:\.|{_DOT})[A-Za-z0-9-]+)*(?:\.|{_DOT})[A-Za-z]{{2,24}}(?![A-Za-z0-9-])"
    rf"|(?<![A-Za-z0-9._%+-]){_LOCAL} at [A-Za-z0-9-]+(?: dot [A-Za-z0-9-]+)* dot [A-Za-z]{{2,24}}(?![A-Za-z0-9-])",
    re.I,
)
_N = r"(?<![A-Za-z0-9*.@/_-])"
_E = r"(?![0-9*A-Za-z@_]|[.-]\d)"
_ID = re.compile(rf"{_N}\d{{6}}[ -]?(?:18|19|20)\d{{2}}(?:0[1-9]|1[0-2])(?:0[1-9]|[12]\d|3[01])[ -]?\d{{3}}[\dXx]{_E}|{_N}\d{{6}}\d{{2}}(?:0[1-9]|1[0-2])(?:0[1-9]|[12]\d|3[01])\d{{3}}{_E}|{_N}\d{{3}}-\d{{2}}-\d{{4}}{_E}|{_N}[A-Z]{{1,2}}\d{{7,8}}{_E}")
_ID_LABEL = re.compile(r"(?:身份证|证件|护照|passport|identity|\bID\b|social security|SSN|通行证)[^0-9A-Z]{0,12}(?:card|no\.?|number|号码?|ID)?[^0-9A-Z]{0,6}$", re.I)
_OTHER_LABEL = re.compile(r"(?:学号|编号|证书|备案|合同|订单|准考证|档案|工号|流水|金额|ISBN|ISSN|doi|student|certificate|grant|contract|file|order|ref\.?|invoice|No\.|书号|账号|卡号|字〔\d+〕第)[^0-9A-Za-z。！？；;，,、.\n]{0,8}(?:no\.?|number|号码?)?[^0-9A-Za-z。！？；;，,、\n]{0,4}$", re.I)
_PHONE = re.compile(
    rf"(?<![A-Za-z0-9*.@/_+-])(?:(?:\(\+?86\)|（\+?86）|\+86|0086)[ -]?)?1[3-9]\d([ -]?)\d{{4}}\1\d{{4}}{_E}"
    rf"|(?<![A-Za-z0-9*.@/_+-])(?:\(\+\d{{1,3}}\)|\+\d{{1,3}})[ -]?(?:\(\d{{2,4}}\)[ -]?)?\d{{2,4}}(?:[ .-]\d{{2,4}}){{1,4}}{_E}"
    rf"|(?<![A-Za-z0-9*.@/_+-])(?:\(0\d{{2,3}}\)|（0\d{{2,3}}）)[ -]?\d{{3,4}}[ -]?\d{{4}}{_E}|{_N}0\d{{2,3}}[ -]\d{{3,4}}[ -]?\d{{4}}{_E}"
    rf"|{_N}(?:\(\d{{3}}\) ?\d{{3}}-\d{{4}}|\d{{3}}\.\d{{3}}\.\d{{4}}|\d{{3}}-\d{{3}}-\d{{4}}|\d{{3}} \d{{3}} \d{{4}}){_E}"
)
_H = "一-鿿"
_LEADIN = r"(?:材料|包裹|信件|证书)?(?:寄至|寄往|寄到|邮寄至|送至|家住|住址|居住地|居住在|现住|住在|住于|通讯地址|联系地址|家庭地址|收件地址|地址|位于|搬到|搬至|住)[:：为是]?\s*"
_ADDRESS_ZH = re.compile(
    rf"(?:{_LEADIN})?(?P<a>(?:[{_H}]{{2,8}}(?:省|自治区))?(?:[{_H}]{{2,7}}?市)?(?:[{_H}]{{1,5}}?[区县])?[{_H}]{{1,8}}?(?:大道|胡同|[路街巷道弄里])(?:[东南西北中]?[路街段])?\s?\d+号"
    rf"(?:院|弄)?(?:[{_H}]{{2,8}}?(?:小区|公寓|大厦|花园|新村|家园|[里苑园庭府城村寓]))?(?:\s?\d+(?:号楼|[栋幢座楼]))?(?:\d+单元)?(?:\s?\d+(?:层|楼)?\d*[室户])?(?:\d+-\d+(?:-\d+)?(?!\d))?)"
)
_CUT_LEADIN = re.compile(rf"^.*(?:{_LEADIN})")
_STREET = "Road|Street|Lane|Avenue|Row|Close|Court|Drive|Causeway|Wharf|Way|Place|Square|Terrace|Hill|Mews|Crescent|Boulevard|Gardens|Walk|Parade|Quay|Rd|St|Ave|Blvd|Ln|Dr"
_ADDRESS_EN = re.compile(rf"(?<![A-Za-z0-9.,/-])\d{{1,5}}[A-Za-z]? (?:[A-Z][\w'’-]* ){{1,4}}(?:{_STREET})\b\.?(?:,? (?:Unit|Flat|Apt|Apartment|Suite|Floor|Room)\.? ?\w+)?(?:, (?:[A-Z][a-zà-ÿ]+(?: [A-Z][a-zà-ÿ]+)?)(?![\w'’])(?:,? [A-Z]{{1,2}}\d[\dA-Z]?(?: \d[A-Z]{{2}})?\b|,? [A-Z]{{2}} \d{{5}}\b)?)?")
_STREET_HINT = re.compile(rf"\d[A-Za-z]? [A-Z][\w'’ -]{{2,40}}\b(?:{_STREET})\b")
_Z_NAME = rf"(?:(?:{'|'.join(COMPOUND)})[{_H}]{{1,2}}|[{''.join(sorted(SURNAMES))}][{_H}]{{1,2}})"
_ZH_LABEL = r"(?:联系人|申请人|候选人|当事人|负责人|证明人|推荐人|指导教师|指导老师|导师|教师|作者|队友|学生|选手|记者|主讲人|姓名|发件人|收件人|名叫|他叫|她叫|名为|署名|通讯员|编辑|责编|撰文|摄影)[:：]?\s?"
_ZH_AFTER = r"(?=老师|同学|教授|先生|女士|博士|主任|院长|合作|等[人名]|同志|报道|表示|介绍|指出|认为|告诉|毕业于|任职|出生|获得|说[，：:])"
_NAME_ZH = re.compile(
    rf"(?:{_ZH_LABEL}|(?<=与)|(?<=和)|(?<![{_H}]))(?P<a>{_Z_NAME})(?:{_ZH_AFTER}|(?![{_H}]))"
)
_U = "A-ZÀ-ÖØ-ÞŁŚŽČ"
_CAP = rf"[{_U}][\w'’]*(?:-[{_U}][\w'’]*)*"
_NAME_EN = re.compile(rf"(?<![\w'’.@-])(?!(?:By|Candidate|Photo|Prof|Dr|Mr|Ms|Mrs|The|In|With|And|Interview|Profile)\b)(?:{_CAP}|[{_U}]\.(?:[{_U}]\.)?)(?: [{_U}]\.)*(?: {_CAP}){{1,2}}(?![\w@]|\.\w)")
#: What stands before and after the name of a person in a sentence: titles, roles and prepositions; verbs of what people do, and appositions.
_EN_BEFORE = re.compile(
    r"(?:\b(?:Candidate|Photo|Interview with|Profile of|By|by|referee|supervised by|advis[oe]rs?|advised by|with|authors?|editor|contact|Contact|named|called|signed|Dear|reporter|colleague|teammates?|student|teacher|researcher|lecturer|winner|speaker|Prof|Professor|Dr|Mr|Ms|Mrs|Miss|Sir|Herr|Frau|Mme)[.:]?|: ) ?$"
)
_EN_AFTER = re.compile(r" (?:joined|wrote|writes|said|says|worked|works|served|serves|taught|teaches|studied|studies|received|won|wins|led|leads|spoke|graduated|published|presented|founded|edited|lives|lived|was born|is an?|was an?)\b| \((?:née|born|School|Faculty|Dept)|, Worked\b|, (?:co-)?[a-zà-ÿ]+(?:[ -][a-zà-ÿ]+){0,2}(?:[.;,]|$)")
#: What follows the name that a line of a résumé begins with.
_EN_HEAD = re.compile(rf"[，,] ?(?:\d{{4}}|[{_H}《]|[A-Z])")
_EN_BESIDE = re.compile(r"(?:,| and|,? &|;|、) ?")
_SENTENCE_START = re.compile(r"(?:^|[.!?。！？;；\n,，)）] ?)$")
#: Words that may follow a name at once, though they belong to things.
_AFTER_NAME = set("Worked Team Received Built Paper In The No This That We She He It ID SSN DOI ISBN URL".split())
_THING_AFTER = re.compile(r" (?:Prize|Award|Scholarship|Medal|Cup|Hall|Library|Foundation|Street|Road|Avenue|Lane|Row|Lecture|Fellowship|College|University|School|Institute|Building|Centre|Fund|Trophy|Lab|Laborator)|奖|杯|楼|路|基金|图书馆|实验室|学院|大学|工作室|中心|讲座")


def _ordered(hits: list[tuple[int, int, str]]) -> list[tuple[int, int, str]]:
    """Hits that do not overlap: earlier kinds win over later ones."""
    taken: list[tuple[int, int, str]] = []
    for h in hits:
        if all(h[1] <= t[0] or h[0] >= t[1] for t in taken):
            taken.append(h)
    return sorted(taken)


def _english(s: str, out: list[tuple[int, int, str]]) -> None:
    """Names of persons in Latin letters: runs of capitalised words without words of things, told by a known given name, by the frame they stand in, or beside another one in a list."""
    runs: list[tuple[int, int, bool, bool]] = []
    for m in _NAME_EN.finditer(s):
        a, words = m.start(), m.group().split(" ")
        while words and words[0] in NOT_PERSON:  # as in "Photo Anouk ..." or "By C. Achterberg"
            a += len(words[0]) + 1
            words = words[1:]
        for i, w in enumerate(words):
            if w in NOT_PERSON:
                words = words[:i]
                break
        if len(words) < 2 or len(words[-1]) < 2 or words[-1].endswith(".") or (words[-1].isupper() and len(words[-1]) < 4):
            continue
        b = a + len(" ".join(words))
        if m.end() != b and s[b : b + 1] == " " and s[b + 1 : m.end()].split(" ")[0] in NOT_PERSON - _AFTER_NAME:
            continue  # the first words of a longer proper name
        if _THING_AFTER.match(s, b):
            continue
        initial = words[0][1:2] == "."
        before = s[max(0, a - 24) : a]
        start = bool(_SENTENCE_START.search(before))
        sure = words[0] in _GIVEN or bool(_EN_BEFORE.search(before)) or (start and bool(_EN_AFTER.match(s, b))) or (a == 0 and (b == len(s) or bool(_EN_HEAD.match(s, b)) and not initial))
        runs.append((a, b, sure, initial))
    # lists: a name beside a name is one
    for order in (range(1, len(runs)), range(len(runs) - 2, -1, -1)):
        for i in order:
            j = i - 1 if order.step > 0 else i + 1
            if runs[j][2] and not runs[i][2] and _EN_BESIDE.fullmatch(s, min(runs[i][1], runs[j][1]), max(runs[i][0], runs[j][0])):
                runs[i] = (*runs[i][:2], True, runs[i][3])
    out += [(a, b, "name") for a, b, sure, _ in runs if sure]


def find(text: str) -> list[tuple[int, int, str]]:
    """Items of a text: (begin, end, kind), in order and without overlap."""
    v = View(text)
    s = v.text
    out: list[tuple[int, int, str]] = []
    low = s.lower()
    if "@" in s or "at" in low and ("dot" in low or _AT_HINT.search(low)):
        out += [(*m.span(), "email") for m in _EMAIL.finditer(s)]
    if re.search(r"\d[\d ().）-]{5,}", s):
        for m in _ID.finditer(s):
            x, before = m.group(), s[max(0, m.start() - 24) : m.start()]
            labelled = bool(_ID_LABEL.search(before))
            digits = sum(c.isdigit() for c in x)
            if labelled or (not _OTHER_LABEL.search(before) and (digits >= 17 or (x[3:4] == "-" and x[6:7] == "-"))):
                out.append((*m.span(), "id_number"))
        for m in _PHONE.finditer(s):
            a = m.start() + (len(m.group()) - len(m.group().lstrip(" -")))
            if not _OTHER_LABEL.search(s[max(0, a - 16) : a]):
                out.append((a, m.end(), "phone"))
    if "号" in s:
        for m in _ADDRESS_ZH.finditer(s):
            a, b = m.span("a")
            if c := _CUT_LEADIN.match(s[a:b]):
                a += c.end()
            city = s.find("市", a, b)
            if city - a > 3 and s[city - 1] in s[a:b]:
                a = max(a, city - 2) if not re.search("省|自治区", s[a:city]) else a
            if re.match(rf"[{_H}]{{2,}}", s[a:b]):
                out.append((a, b, "address"))
    if _STREET_HINT.search(s):
        out += [(*m.span(), "address") for m in _ADDRESS_EN.finditer(s)]
    if not s.isascii():
        for m in _NAME_ZH.finditer(s):
            name = m.group("a")
            if name in NOT_NAMES or name[:2] in NOT_NAMES or (name[0] in "任为于" and name[1:] in ROLES) or _THING_AFTER.match(s, m.end("a")):
                continue
            out.append((*m.span("a"), "name"))
    _english(s, out)
    return [(*v.span(a, b), kind) for a, b, kind in _ordered(out)]


_ITEMS = pa.schema([("tab", pa.string()), ("row_id", pa.int64()), ("kind", pa.string()), ("found_text", pa.string())])


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        cols: tuple[list, list, list, list] = ([], [], [], [])
        for tab, row_id, text in zip(*(c.to_pylist() for c in b.columns)):
            for x in {(kind, text[i:j]) for i, j, kind in find(text)}:
                for col, y in zip(cols, (tab, row_id, *x)):
                    col.append(y)
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, _ITEMS)], schema=_ITEMS)


def items(rows: DataFrame) -> DataFrame:
    """Distinct (tab, row_id, kind, found_text) of rows(tab, row_id, text)."""
    own = rows.where("row_id is not null and text is not null").select("tab", "row_id", "text")
    return own.mapInArrow(_scan, "tab string, row_id bigint, kind string, found_text string").distinct()


def redact(text: str) -> str:
    out, at = [], 0
    for a, b, kind in find(text):
        out += (text[at:a], f"[{kind.upper()}]")
        at = b
    return "".join((*out, text[at:]))


def redacted(rows: DataFrame) -> DataFrame:
    """(tab, row_id, redacted) of rows(tab, row_id, text), with placeholders in place of items."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([None if t is None else redact(t) for t in b.column(2).to_pylist()], pa.string())], names=["tab", "row_id", "redacted"])

    return rows.select("tab", "row_id", "text").mapInArrow(run, "tab string, row_id bigint, redacted string")


_SPANS = pa.schema([("tab", pa.string()), ("row_id", pa.int64()), ("at", pa.int32()), ("upto", pa.int32()), ("kind", pa.string()), ("found_text", pa.string())])


def spans(rows: DataFrame) -> DataFrame:
    """(tab, row_id, at, upto, kind, found_text) of rows(tab, row_id, text): where each item stands, in characters."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = [(tab, row_id, i, j, kind, text[i:j]) for tab, row_id, text in zip(*(c.to_pylist() for c in b.columns)) for i, j, kind in find(text)]
            yield pa.RecordBatch.from_arrays([pa.array([g[i] for g in got], f.type) for i, f in enumerate(_SPANS)], schema=_SPANS)

    own = rows.where("row_id is not null and text is not null").select("tab", "row_id", "text")
    return own.mapInArrow(run, "tab string, row_id bigint, at int, upto int, kind string, found_text string")


def written(rows: DataFrame, given: DataFrame) -> DataFrame:
    """(tab, row_id, replaced) of rows(tab, row_id, text) that hold items, with the surrogates of given(kind, found_text, surrogate) in their places.

    Only the items of a row are put together in one place, so nothing grows with the corpus.
    """
    own = rows.where("row_id is not null and text is not null").dropDuplicates(["tab", "row_id"]).select("tab", "row_id", "text")
    places = spans(own).join(given.select("kind", "found_text", "surrogate"), ["kind", "found_text"])
    places = places.groupBy("tab", "row_id").agg(F.array_sort(F.collect_list(F.struct("at", "upto", "surrogate"))).alias("places"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            done = []
            for text, found in zip(b.column(2).to_pylist(), b.column(3).to_pylist()):
                out, at = [], 0
                for x in found:
                    out += (text[at : x["at"]], x["surrogate"])
                    at = x["upto"]
                done.append("".join((*out, text[at:])))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(done, pa.string())], names=["tab", "row_id", "replaced"])

    return own.join(places, ["tab", "row_id"]).select("tab", "row_id", "text", "places").mapInArrow(run, "tab string, row_id bigint, replaced string")
