"""Each operator on dirty, empty, repeated and very long rows, and against brute force."""

import random
import re
import unicodedata
from collections import Counter

import pytest

from veristrata.llm import boilerplate, leaks, lookalike, names, packing, personal, residue, stuffing
from veristrata.llm import lines as L

LONG = "word " * 60_000


def rows(spark, data, schema, clash="clash string, key string, n int, value_ int"):
    return spark.createDataFrame([(*r, "c", "k", 1, 2) for r in data], f"{schema}, {clash}")


def got(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


# ---------------------------------------------------------------- look-alikes


SAME = [("Ａｂｃ", "Abc"), ("Аbс", "Abc"), ("a​b­c", "abc"), ("a  b ", "a b"), ("a　b", "a b"), ("cafe\u0301", "café"), ("cafе\u0301", "café"), ("ﬁle", "file"), ("⽣命", "生命"), ("\uf90a", "金"), ("a‑b", "a-b"), ("a，b", "a,b"), ("οne", "one"), ("ρ", "p"), ("ν", "v"), ("օ", "o"), ("ɡ", "g"), ("Ꭺ", "A"), ("ꓮ", "A"), ("ⲟ", "o"), ("Ιn", "In"), ("ӓ", "ä"), ("𝐀𝐛", "Ab"), ("q\u0323\u0307", "q\u0307\u0323")]
OTHER = [("Abc", "abc"), ("O", "0"), ("l", "1"), ("I", "l"), ("a.b", "a。b"), ("国", "國"), ("ab", "a b"), ("a–b", "a-b"), ("x²", "x2"), ("…", "..."), ("土", "士"), ("rn", "m"), ("٥", "o"), ("é", "e")]


@pytest.fixture(scope="module")
def plain_rewriter(spark):
    used = Counter(unicodedata.normalize("NFC", "".join(x for p in SAME + OTHER for x in p))) + Counter({x: 50 for x in map(chr, range(33, 127))}) + Counter({"é": 60, "生": 9, "金": 9, "ä": 9})
    return lookalike.Rewriter(used, lookalike.confusables(spark, [ord(c) for c in used])).compile()


@pytest.mark.parametrize("a, b", SAME)
def test_same_look(plain_rewriter, a, b):
    assert plain_rewriter(a) == plain_rewriter(b)


@pytest.mark.parametrize("a, b", OTHER)
def test_other_look(plain_rewriter, a, b):
    assert plain_rewriter(a) != plain_rewriter(b)


def test_rewriting_ends_and_is_stable(spark):
    """Over strings of members, marks and blanks of all of Unicode, whatever the representatives."""
    rnd = random.Random(3)
    pool = [chr(c) for c in range(0x80, 0x20000) if unicodedata.category(chr(c)) not in ("Cn", "Cs", "Co")]
    shapes = lookalike.confusables(spark, [ord(c) for c in pool])
    assert len(shapes) > 500
    marks = [c for c in pool if unicodedata.combining(c)]
    for seed in range(3):
        rewrite = lookalike.Rewriter({c: rnd.randint(1, 99) for c in pool} | {chr(i): rnd.randint(1, 99) for i in range(128)}, shapes).compile()
        for _ in range(4000):
            s = "".join(rnd.choice(pool if rnd.random() < 0.6 else marks) if rnd.random() < 0.8 else chr(rnd.randint(32, 126)) for _ in range(9))
            assert rewrite(rewrite(s)) == rewrite(s)


def test_classed(spark):
    data = [("t", 1, "abc"), ("t", 2, "аbc"), ("t", 3, "ab​c"), ("t", 3, "ab​c"), ("t", 4, "abc"), ("t", 5, None), ("t", 6, ""), ("u", 8, "abc"), ("t", None, "abc")]
    df = rows(spark, data, "tab string, row_id bigint, text string")
    out = lookalike.classed(df, lookalike.rewriter(df.select("text"))).collect()
    assert {(r["tab"], r["row_id"]): (r["n_rows"], r["n_spellings"], r["n_links"]) for r in out} == {("t", 1): (4, 3, 2), ("t", 2): (4, 3, 3), ("t", 3): (4, 3, 3), ("t", 4): (4, 3, 2), ("u", 8): (1, 1, 0)}
    assert len({r["class_id"] for r in out}) == 1 and len(out) == 5


def test_large_classes_are_parted(spark, monkeypatch):
    df = rows(spark, [("t", i, "ab" + "​" * (i % 3) + "c") for i in range(60)], "tab string, row_id bigint, text string")
    rewrite = lookalike.rewriter(df.select("text"))
    whole = got(lookalike.twins(df, rewrite))
    monkeypatch.setattr(lookalike, "PAIRED", 7)
    assert whole == got(lookalike.twins(df, rewrite)) and len(whole) == 60 * 40 // 2


def test_twins(spark):
    data = [("t", 1, "abc"), ("t", 2, "аbc"), ("t", 3, "ab​c"), ("t", 3, "ab​c"), ("t", 4, "abc"), ("t", 5, None), ("t", 6, ""), ("t", 7, " "), ("u", 8, "abc"), ("t", None, "abc"), ("t", 9, LONG), ("t", 10, LONG + "​")]
    df = rows(spark, data, "tab string, row_id bigint, text string")
    assert got(lookalike.twins(df, lookalike.rewriter(df.select("text")))) == sorted([("t", 1, 2), ("t", 1, 3), ("t", 2, 3), ("t", 2, 4), ("t", 3, 4), ("t", 9, 10)], key=str)
    empty = df.limit(0)
    assert got(lookalike.twins(empty, lookalike.rewriter(empty.select("text")))) == []


# ---------------------------------------------------------------- residue


@pytest.mark.parametrize("line", ["404 Not Found nginx-like", "Please enable JavaScript to view this page.", "{{title}} {{author}}", "Dear ${name}, your record for ${x} is ready.", "undefined undefined undefined", "null | null | null", "[object Object]", "加载中 · · ·", "此处填写正文内容。", "示例文字示例文字示例文字", "错误代码：502，服务器开小差了，请稍后再试。", "gw9.example: Session expired. Please log in again.", "! Loading... !", "Ultrem venat sapir noctua loremus dolenti sapir noctua.", "登录后查看全文。还没有账号？立即注册", "xxxx年xx月xx日 某某学院 某某同学", "SQL error 1064 near 'level'"])
def test_is_evidence(line):
    assert residue.is_evidence(line)


@pytest.mark.parametrize("line", ["Room 404 hosts the student help desk; visitors sign in at the front counter.", "Her library fills placeholders such as ${name} before the letters are printed.", "该组开发的模板引擎支持 {{变量}} 占位写法，已在校内三个站点使用。", "The judges noted that access was denied to none of the applicants this year.", "学生自制的错误页检测工具可识别 502 与 503 状态，获课程设计优秀。", "", "   ", "Béla Fenwicke (Dept. of Linguistics)", "the " + LONG])
def test_is_no_evidence(line):
    assert not residue.is_evidence(line)


def test_exclude(spark):
    menu = "Quiet corner\nStaff room"
    data = [("t", i, "h", None, f"{menu}\nA report of {i} pages was read aloud in the hall.") for i in range(1, 8)]
    data += [("t", 20, "h", None, f"{menu}\n404 Not Found"), ("t", 20, "h", None, f"{menu}\n404 Not Found"), ("t", 21, "h", None, "404 Not Found\nThe hall was closed for repairs in May."), ("t", 22, None, None, "Loading..."), ("t", 23, "h", None, None), ("t", 24, "h", None, ""), ("t", None, "h", None, "Loading..."), ("t", 25, "h", "Quiet corner", "Quiet corner\nLoading...")]
    df = rows(spark, data, "tab string, row_id bigint, host string, title string, text string")
    assert got(residue.exclude(df)) == [("t", 20), ("t", 22)]
    assert got(residue.exclude(df.limit(0))) == []


def test_exclude_keeps_recurring_text(spark):
    rule = "The dean reads every report aloud in the hall before it is filed."
    data = [("t", i, "h", None, f"{rule}\n1. dialect speech\nBy the lake\nReport {'abcdefghijklmnopqrst'[i]} has its own sentence in the hall.") for i in range(20)]
    data += [("t", 100 + i, "h", None, f"Line {chr(97 + i % 26) * (1 + i // 26)} x\nAnother sentence of this page stands here, number {i}.") for i in range(300)]
    data += [("t", 500, "h", None, f"Loading...\n{rule}"), ("t", 501, "h", None, "Loading...\n1. dialect speech"), ("t", 502, "h", None, "Loading...")]
    # one text under many keys is one page
    data += [("t", 600 + i, "g", None, "Loading...\nOlive stairs") for i in range(30)] + [("t", 700 + i, "g", None, f"A hall for all of us was opened today.\nRoom {'abcdefghij'[i]}") for i in range(10)]
    df = rows(spark, data, "tab string, row_id bigint, host string, title string, text string")
    assert got(residue.exclude(df)) == [("t", 502)]


# ---------------------------------------------------------------- boilerplate


SITE = "tab string, row_id bigint, host string, title string, lines array<string>"


def test_page_branches():
    f = L.page(["Home", "A | B | C", "The title", "A sentence that is long enough to count.", "1. entry", "Back to top"], "The title")
    assert f[0] & L.HEAD and f[1] & L.NAV and f[2] & L.TITLE and f[3] & L.SENT and f[4] & L.NUMBERED and f[5] & L.FURN


def test_remove(spark):
    page = lambda i: ["Corner", f"Title {i}", f"The number {i} was read aloud in the hall today.", "Staff room"]
    data = [("t", i, "h", f"Title {i}", page(i)) for i in range(1, 12)] + [("t", 1, "h", "Title 1", page(1)), ("t", 50, "h", None, None), ("t", 51, "h", None, []), ("t", 52, None, None, [None, ""]), ("t", None, "h", None, ["x"])]
    out = got(boilerplate.remove(rows(spark, data, SITE)).distinct())
    assert out == sorted([("t", i, n) for i in range(1, 12) for n in (0, 3)], key=str)




def site(n):
    """Pages with furniture that no list has the wording of, above, below and in the middle, one of it a sentence."""
    words = "amber birch cedar delta ember flint grove heath inlet jetty".split()
    w = lambda i, k: words[(i * 7 + k) % 10] + words[(i // 10 + k) % 10]
    return [("t", i, "h", f"Notes on {w(i, 1)}", ["Quiet corner", "Staff room", f"Notes on {w(i, 1)}", f"The {w(i, 2)} of the {w(i, 3)} was read aloud in hall {i}.", *(["Tap to enlarge the picture"] if i % 2 else []), f"Nobody in the {w(i, 4)} asked for the {w(i, 5)} of {w(i, 6)}.", "The wardens lock every gate of this house at ten.", "House rules"]) for i in range(n)]


def want(n):
    return sorted([("t", i, k) for i in range(n) for k in ((0, 1, 6, 7) if i % 2 else (0, 1, 5, 6))], key=str)


def test_the_tree_decides(spark, monkeypatch):
    df = rows(spark, site(60), SITE)
    assert got(boilerplate.remove(df)) == want(60)
    monkeypatch.setattr(boilerplate, "W_CONTENT", 0.0)
    monkeypatch.setattr(boilerplate, "W_BRANCH", 0.0)
    assert got(boilerplate.remove(df)) != want(60)


def test_one_look_does_not_decide(spark):
    """A sentence with the wording of a notice that stands once, in the text, is text."""
    data = site(40)
    data[3][4][3] = "Copyright of the notes stays with those who read them aloud."
    assert ("t", 3, 3) not in got(boilerplate.remove(rows(spark, data, SITE)))


def test_size_does_not_matter(spark):
    small, large = (set(got(boilerplate.remove(rows(spark, site(n), SITE)))) for n in (40, 400))
    assert small == {r for r in large if r[1] < 40}


def test_remove_nothing(spark):
    assert got(boilerplate.remove(rows(spark, [], SITE))) == []


# ---------------------------------------------------------------- personal items


def found(text):
    return {(k, text[a:b]) for a, b, k in personal.find(text)}


@pytest.mark.parametrize(
    "text, items",
    [
        ("write to luo.che30@stu.lanqiao.edu.example; build core@0.8.7", {("email", "luo.che30@stu.lanqiao.edu.example")}),
        ("来信请寄sang71(at)inbox(dot)test，x", {("email", "sang71(at)inbox(dot)test")}),
        ("phone: (+86)14300034799; student no. S243956", {("phone", "(+86)14300034799")}),
        ("致电+1 (918) 555-0194；手机 138****0000", {("phone", "+1 (918) 555-0194")}),
        ("Tel (0558) 555 7312；身份证20099519890621163X；ISBN 978-0-53149-226-6", {("phone", "(0558) 555 7312"), ("id_number", "20099519890621163X")}),
        ("身份证号：290269 19791010 5355，证书编号 323396135，合同金额 37016663 元", {("id_number", "290269 19791010 5355")}),
        ("identity card E57188463; passport/ID: 933-16-8414", {("id_number", "E57188463"), ("id_number", "933-16-8414")}),
        ("材料寄至岚桥市青溪区白鹭北街54号；松影路校区", {("address", "岚桥市青溪区白鹭北街54号")}),
        ("家住汐湾市北渚区松影路395号槐荫小区11-3-677", {("address", "汐湾市北渚区松影路395号槐荫小区11-3-677")}),
        ("lives at 9 Kestrel Row, Unit 9, Port Ansley; room 404, Foxglove Avenue campus", {("address", "9 Kestrel Row, Unit 9, Port Ansley")}),
        ("post to 121 Alder Wharf Lane, Apt 29, Grenmoor. Visitors", {("address", "121 Alder Wharf Lane, Apt 29, Grenmoor")}),
        ("申请人卓霆笙 请；申请人应在6月29日前提交。指导教师：骆芷樾（证书）", {("name", "卓霆笙"), ("name", "骆芷樾")}),
        ("Best Poster prize: Noël Fenwicke, A. Okonjwa and Béla H. Brandtmoor (Dept. of Statistics).", {("name", "Noël Fenwicke"), ("name", "A. Okonjwa"), ("name", "Béla H. Brandtmoor")}),
        ("By Nathaniel L. Rathmullen, co-editor. Visitors from Port Ansley joined.", {("name", "Nathaniel L. Rathmullen")}),
        ("mail ab​c＠inbox.test", {("email", "ab​c＠inbox.test")}),
        ("", set()), (" ", set()), (LONG, set()),
    ],
)
def test_items(text, items):
    assert found(text) == items


def test_redacted_keeps_the_rest():
    assert personal.redact("Tel 165-0000-8868；x  y 联系人冀珩老师。") == "Tel [PHONE]；x  y 联系人[NAME]老师。"


def test_items_operator(spark):
    data = [("t", 1, "call 165-0000-8868 or 165-0000-8868"), ("t", 1, "call 165-0000-8868 or 165-0000-8868"), ("t", 2, None), ("t", None, "a@b.test"), (None, 3, "a@b.test")]
    df = rows(spark, data, "tab string, row_id bigint, text string")
    assert got(personal.items(df)) == sorted([("t", 1, "phone", "165-0000-8868"), (None, 3, "email", "a@b.test")], key=str)
    assert got(personal.items(df.limit(0))) == []


# ---------------------------------------------------------------- names

KNOWN = [(1, "org", "霁汀学术出版社", "Jiting Academic Press"), (2, "org", "霁汀大学", "Jiting University"), (3, "org", "砚渡医科大学", "Yandu Medical University"), (4, "org", "砚渡学术出版社", "Yandu Academic Press"), (5, "org", "珞桥大学", "Luoqiao University"), (6, "org", "珞桥学术出版社", "Luoqiao Academic Press"), (7, "org", "汐溪医科大学", "Xixi Medical University"), (8, "org", "鹭屿医科大学", "Luyu Medical University"), (9, "org", "荻桥大学", "Diqiao University"), (20, "person", "冀昀琅", "Yunlang Ji"), (21, "person", "Josephine Wickdale", "Josephine Wickdale")]


@pytest.fixture(scope="module")
def index():
    return names.Index(KNOWN).compile()


@pytest.mark.parametrize("value, kind, want", [
    ("Jiting Acad. Press", "org", 1), ("Academic Press, Jiting", "org", 1), ("jiting acadmic press", "org", 1), ("Ji Ting Academic Press", "org", 1), ("Jiting AP", "org", 1), ("霁汀出版社", "org", 1), ("霁汀 学术出版社", "org", 1), ("霁汀学学术出版社", "org", 1), ("霁汀学术出社版", "org", 1), ("汀霁学术出版社", "org", 1), ("霽汀學術出版社", "org", 1), ("霁汀学术出版社(Jiting)", "org", 1), ("（霁川）霁汀学术出版社", "org", 1),
    ("Yandu Med University", "org", 3), ("砚渡医科大学（临泽校区）", "org", 3), ("砚渡大学", "org", None), ("砚溪学术出版社", "org", None), ("Yandu University", "org", None), ("", "org", None), ("x" * 50_000, "org", None), ("岚桥晚报", "org", None),
    ("Ji Yun-Lang", "person", 20), ("JI Yunlang", "person", 20), ("Y.L. Ji", "person", 20), ("冀 昀琅教授", "person", 20), ("冀琅昀", "person", None), ("Wickdale, Jo", "person", 21), ("Prof. J. Wickdale", "person", 21), ("Josephine Wicdkale", "person", 21), ("Josephine Wickese", "person", None),
])
def test_names(index, value, kind, want):
    assert index.resolve(value, kind)[1] == want


def test_one_edit_against_brute_force():
    rnd = random.Random(5)

    def distance(a, b):
        d = {(i, 0): i for i in range(len(a) + 1)} | {(0, j): j for j in range(len(b) + 1)}
        for i in range(1, len(a) + 1):
            for j in range(1, len(b) + 1):
                d[i, j] = min(d[i - 1, j] + 1, d[i, j - 1] + 1, d[i - 1, j - 1] + (a[i - 1] != b[j - 1]))
                if i > 1 and j > 1 and a[i - 1] == b[j - 2] and a[i - 2] == b[j - 1]:
                    d[i, j] = min(d[i, j], d[i - 2, j - 2] + 1)
        return d[len(a), len(b)]

    for _ in range(3000):
        a, b = ("".join(rnd.choice("abc") for _ in range(rnd.randrange(1, 6))) for _ in "12")
        assert names.one_edit(a, b) == (distance(a, b) == 1)
        assert not names.one_edit(a, b) or names.deletes(a) & names.deletes(b)


def test_link(spark):
    known = rows(spark, KNOWN, "name_id bigint, kind string, full_name string, latin_name string")
    data = [("t", 1, "org", "org", "Jiting AP"), ("t", 1, "org", "org", "Jiting AP"), ("t", 2, "org", "org", "霁汀学术出版社"), ("t", 3, "org", "org", None), ("t", 4, "org", "org", " "), ("t", None, "org", "org", "Jiting AP"), ("t", 5, "advisor", "person", "冀昀琅老师")]
    values = rows(spark, data, "tab string, row_id bigint, field string, kind string, value string")
    assert got(names.link(values, known)) == sorted([("t", 1, "org", 1), ("t", 5, "advisor", 20)], key=str)
    assert got(names.link(values.limit(0), known)) == [] and got(names.link(values, known.limit(0))) == []


def test_link_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(names, "NAME_BLOCK", 4)
    known = rows(spark, KNOWN, "name_id bigint, kind string, full_name string, latin_name string")
    values = rows(spark, [("t", 1, "org", "org", "Jiting AP"), ("t", 2, "org", "org", "Yandu Med University")], "tab string, row_id bigint, field string, kind string, value string")
    assert ("t", 1, "org", 1) in got(names.link(values, known))


# ---------------------------------------------------------------- packing


def test_filling_is_the_best_subset():
    rnd = random.Random(7)
    for _ in range(200):
        left = Counter(rnd.randrange(1, 40) for _ in range(8))
        room = rnd.randrange(1, 120)
        sums = {0}
        for x, n in left.items():
            for _ in range(n):
                sums |= {s + x for s in sums if s + x <= room}
        counts = packing.best_filling(room, dict(left))
        assert sum(x * n for x, n in counts.items()) == max(sums) and all(n <= left[x] for x, n in counts.items())


def test_plan_places_everything_once():
    rnd = random.Random(8)
    h = Counter(rnd.randrange(1, 101) for _ in range(5000))
    plan, containers = packing.plan(dict(h), 100)
    room, seen = Counter(), Counter()
    for x, _, n, per, first, _ in plan:
        seen[x] += n
        for r in range(n):
            room[first + r // per] += x
    assert seen == h and max(room.values()) <= 100 and len(room) == containers
    assert containers <= 1.01 * sum(x * n for x, n in h.items()) / 100 + 1


def test_pack(spark):
    data = [(1, 2048), (2, 5000), (3, 0), (4, None), (5, 1000), (6, 1048), (7, 10), (7, 10), (8, 2047)]
    out = packing.pack(rows(spark, data, "doc_id bigint, n_tokens bigint")).collect()
    room, places = Counter(), Counter()
    for r in out:
        room[r["container"]] += r["n_tokens"]
        places[r["container"], r["position"]] += 1
    assert max(room.values()) <= 2048 and set(places.values()) == {1} and sum(room.values()) == 2048 + 5000 + 1000 + 1048 + 20 + 2047
    assert all(p == 0 or (c, p - 1) in places for c, p in places)
    assert sorted(r["n_tokens"] for r in out if r["doc_id"] == 2) == [904, 2048, 2048] and sorted(r["doc_id"] for r in out if r["n_tokens"] == 0) == [3, 4]
    assert packing.pack(rows(spark, [], "doc_id bigint, n_tokens bigint")).collect() == []
    only = packing.pack(rows(spark, [(1, 0), (2, None)], "doc_id bigint, n_tokens bigint")).collect()
    assert sorted((r["container"], r["position"]) for r in only) == [(0, 0), (0, 1)]


def test_tokens(spark):
    df = rows(spark, [(1, "Hello world"), (2, ""), (3, None)], "doc_id bigint, text string")
    assert got(packing.count_tokens(df)) == [(1, 2), (2, 0), (3, 0)]


# ---------------------------------------------------------------- leaks


def brute_leaks(docs, items):
    tok = lambda t: re.findall(r"[a-z0-9]+|[一-鿿]", unicodedata.normalize("NFKC", t or "").lower())
    out = set()
    for i, lang, t in items:
        n, w = 20 if lang == "zh" else 12, tok(t)
        grams = {tuple(w[k : k + n]) for k in range(len(w) - n + 1)}
        for d, x in docs:
            v = tok(x)
            if any(tuple(v[k : k + n]) in grams for k in range(len(v) - n + 1)):
                out.add((d, i))
    return sorted(out)


def test_leaks(spark):
    rnd = random.Random(9)
    w = [f"w{i}" for i in range(30)]
    items = [(i, "en", " ".join(rnd.choice(w) for _ in range(40))) for i in range(12)] + [(20, "zh", "".join(chr(0x4E00 + rnd.randrange(40)) for _ in range(60))), (21, "en", "too short"), (22, None, None)]
    docs = []
    for d in range(60):
        t = " ".join(rnd.choice(w) for _ in range(50))
        if d % 3 == 0:
            s = items[rnd.randrange(12)][2].split(" ")
            k = rnd.randrange(25)
            t += " , ".join(["", *s[k : k + rnd.choice([11, 12, 15])]]).upper() + ". " + t
        if d % 7 == 0:
            t += "\n" + items[12][2][5:24] + ("Ｗ" if d % 2 else items[12][2][24])
        docs.append((d, t))
    docs += [(100, None), (101, ""), (0, docs[0][1]), (102, LONG)]
    got_ = got(leaks.find(rows(spark, docs, "doc_id bigint, text string"), rows(spark, items, "item_id bigint, lang string, text string")))
    assert sorted(got_) == brute_leaks([d for d in docs if d[0] not in (102,)], [i for i in items if i[2]])
    assert got(leaks.find(rows(spark, [], "doc_id bigint, text string"), rows(spark, items, "item_id bigint, lang string, text string"))) == []
    assert got(leaks.find(rows(spark, docs[:3], "doc_id bigint, text string"), rows(spark, [], "item_id bigint, lang string, text string"))) == []


def test_proximity(spark):
    item = "one two three four five six seven eight nine ten eleven twelve thirteen"
    docs = [(1, "x one two three four five other six seven eight nine ten eleven twelve y"), (2, "one three five seven nine eleven one three")]
    assert got(leaks.proximity(rows(spark, docs, "doc_id bigint, text string"), rows(spark, [(1, "en", item)], "item_id bigint, lang string, text string"))) == [(1, 1)]


def near_by_definition(doc, item, slop=2, missing=2):
    """Some window, at some place of the document, has all but ``missing`` words within ``slop`` of their place, one exactly there."""
    v, w, n = doc.split(), item.split(), 12
    for i in range(len(w) - n + 1):
        for b in range(-n, len(v)):
            near = [any(v[max(b + j + s, 0) : b + j + s + 1] == [w[i + j]] for s in range(-slop, slop + 1) if b + j + s >= 0) for j in range(n)]
            if sum(near) >= n - missing and any(0 <= b + j < len(v) and v[b + j] == w[i + j] for j in range(n)):
                return True
    return False


def test_proximity_of_changed_rare_words():
    rnd = random.Random(6)
    items = [" ".join(rnd.choice([f"c{rnd.randrange(6)}", f"r{i}x{j}"]) for j in range(14)) for i in range(6)]
    block = leaks.Items([(i, "en", t) for i, t in enumerate(items)]).compile()
    docs = []
    for d in range(60):
        w = rnd.choice(items).split()
        for _ in range(d % 5):
            at = rnd.randrange(len(w))
            w[at : at + 1] = rnd.choice([["unknown"], ["c1"], [], [w[at], "added"], [f"r{rnd.randrange(6)}x{rnd.randrange(14)}"]])
        docs.append("before it " + " ".join(w) + " behind it")
    want = {(d, i) for d, x in enumerate(docs) for i, y in enumerate(items) if near_by_definition(x, y)}
    assert len(want) > 30 and leaks.near(leaks.Segment.of_texts(list(range(60)), docs, block), block, 2, 2) == want
    # whatever shares the segment
    assert set().union(*(leaks.near(leaks.Segment.of_texts([d], [x], block), block, 2, 2) for d, x in enumerate(docs))) == want
    # the rarest word of every window is another one
    item = "the old of the an in rarest to of the in an old the"
    block = leaks.Items([(1, "en", item)]).compile()
    for word in ("other", "old"):
        assert leaks.near(leaks.Segment.of_texts([1, 2], [item.replace("rarest", word), "rarest old"], block), block, 2, 2) == {(1, 1)}
        assert leaks.near(leaks.Segment.of_texts([1], [item.replace("rarest", word)], block), block, 2, 2) == {(1, 1)}


# ---------------------------------------------------------------- stuffing

SPAM = [
    "cheap transcript " * 40, "证书办理2023 软著申请2022 " * 20, "\n".join(f"[degree online](http://my-{i}.test/p/{i})" for i in range(20)), "\n".join(f"pen blue {i * 7} USD visa letter add to cart" for i in range(15)),
    "Looking for visa letter? Our visa letter is the best visa letter, get visa letter today with visa letter. " * 8, "标签：" + "；".join(["奖杯定制", "证书夹", "笔记本", "钢笔", "台历"] * 6),
]
GOOD = [
    "Selected publications\n" + "\n".join(f"[{i}] {a} {b}. campus room scheduling: a study. 20{10 + i}. https://doi.example/10.9999/{i * 991}" for i, (a, b) in enumerate(zip("Ada Bea Cid Dan Eve Fay Gus Hal Ivy Jon".split(), "Moss Nash Orr Pike Quin Rowe Shaw Tate Ure Vane".split()))),
    "Merit Scholarship roster\n" + "\n".join(f"{i}. {a} {b}, Faculty of Law" for i, (a, b) in enumerate(zip("Ada Bea Cid Dan Eve Fay Gus Hal Ivy Jon".split(), "Moss Nash Orr Pike Quin Rowe Shaw Tate Ure Vane".split()))),
    "专业技能\n数据可视化\nPython / SQL / Spark\n速记\nLinux 运维\nKotlin, Go", "The hall was closed for repairs in May, and the registry moved its files to another floor until the work was done in June.", "", " ", "one two",
]


def test_stuffing(spark):
    data = [(i, t) for i, t in enumerate(SPAM)] + [(100 + i, t) for i, t in enumerate(GOOD)] + [(0, SPAM[0]), (None, SPAM[0]), (200, None), (201, SPAM[0] * 300)]
    df = rows(spark, data, "doc_id bigint, text string")
    assert got(stuffing.found(df)) == [(0,), (1,), (2,), (201,), (3,), (4,), (5,)]
    assert got(stuffing.found(df.limit(0))) == []


HEADLINES = ["River quality alerts move to another building", "New museum catalogue opens for visiting scholars", "Sparse retrieval team wins seed money again", "Handwritten rosters recognised by students of law", "Harbour lights return after seven dark winters", "Library hours grow longer during exam weeks"]
HEADLINES_ZH = ["低碳混凝土配比工作坊顺利举行", "古籍断句模型团队完成中期检查", "多光谱图像分割成果入选案例集", "微电网负荷预测队伍赴外地交流", "场地预约调度系统上线试运行", "方言语音标注课程开放报名通道"]


def test_links_with_long_labels(spark):
    far = "https://news.test/" + "a/b-c/" * 60
    bad = ["\n".join(f"[{x}](http://n.test/{i})" for i, x in enumerate(HEADLINES)), "\n".join(f"{x} http://n.test/{chr(97 + i)}" for i, x in enumerate(HEADLINES)), "\n".join(f"{x}：https://n.test/{chr(97 + i)}" for i, x in enumerate(HEADLINES_ZH)), "cheap transcript " * 30 + "http://n.test/x", GOOD[3] + ("\n" + far) * 2]
    good = [*GOOD[:3], "\n".join(f"The {x.lower()} and it was read in the hall, see http://n.test/{i}." for i, x in enumerate(HEADLINES)), (GOOD[3] + "\n") * 2 + far]
    good += ["代表论文\n" + "\n".join(f"[{i}] {a}. {b}. {2010 + i}. https://doi.example/10.9999/{i * 991}" for i, (a, b) in enumerate(zip(["钟离皎", "祁沁葭", "辛珩弈", "商宥旻", "车琅蓁", "祁沁葭"], ["微电网负荷预测研究", "长文本稀疏检索方法探讨", "微电网负荷预测研究", "长文本稀疏检索方法探讨", "微电网负荷预测研究", "长文本稀疏检索方法探讨"])))]
    df = rows(spark, [*enumerate(bad), *((100 + i, x) for i, x in enumerate(good))], "doc_id bigint, text string")
    assert got(stuffing.found(df)) == [(i,) for i in range(len(bad))]


def test_gaps_against_brute_force():
    import numpy as np

    rnd = random.Random(4)
    key = np.array([rnd.randrange(6) << 40 for _ in range(500)], np.uint64)
    nxt, near, count = stuffing._recur(key)
    for i in range(500):
        same = [j for j in range(500) if key[j] == key[i]]
        after, before = [j - i for j in same if j > i], [i - j for j in same if j < i]
        assert count[i] == len(same) and (nxt[i] == min(after) if after else nxt[i] > 1 << 30) and (near[i] == min(after + before) if after + before else near[i] > 1 << 30)


def test_stuffing_of_any_length_and_tags():
    share = lambda t: stuffing._measure([1], [t]).column(1).to_pylist()[0]
    assert share("buy shoes " * 4) > 0.5 and share("Tags: python, sql, pottery, swimming, jazz, violin, chess, cooking, rowing") > 0.5 and share("#python #sql #pottery #swimming #jazz #violin #chess") > 0.5
    assert share("Skills: Python, SQL, pottery, swimming, jazz, violin, chess, cooking") == 0 and share("One word") == 0
    assert share("The group published its records.\nKeywords: peer review; load forecasts; soil moisture; museum catalogue") < 0.5
    assert stuffing._measure([1], [" \n"]).num_rows == 0


def test_stuffing_by_autocorrelation(monkeypatch):
    """Text in step with a period beyond the recurrence lag, without separators, is found by its autocorrelation alone."""
    rnd = random.Random(4)
    period = "".join(chr(0x4E00 + x) for x in rnd.sample(range(3000, 9000), 260))
    share = lambda t: stuffing._measure([1], [t]).column(1).to_pylist()[0]
    assert share(period * 6) > 0.5
    monkeypatch.setattr(stuffing, "IN_STEP", 9)
    assert share(period * 6) < 0.5


def test_an_index_serves_several_test_sets(spark, tmp_path, monkeypatch):
    """The texts are gone when the second set is searched; many items make several blocks with the same result."""
    rnd = random.Random(11)
    vocabulary = [f"{a}{b}" for a in "ka lo mi nu pe ra".split() for b in "st rd ng lk".split()]
    docs = [(i, " ".join(rnd.choice(vocabulary) for _ in range(80))) for i in range(50)] + [(60, None), (61, ""), (0, "again " * 3)]
    cut = lambda d, k: " ".join(docs[d][1].split()[k : k + 14])
    path = str(tmp_path / "index")
    leaks.write_index(rows(spark, docs, "doc_id bigint, text string"), path)
    index = leaks.read_index(spark, path)
    sets = [[(d, "en", cut(d, k)) for d, k in ((1, 3), (7, 20), (33, 60))], [(d, "en", cut(d, 5)) for d in range(20)] + [(99, "en", "not here " * 20), (98, None, None)]]
    for items in sets:
        want = {(d, i) for i, _, t in items if t for d, x in docs if x and t in x}
        frame = rows(spark, items, "item_id bigint, lang string, text string")
        assert set(got(leaks.search(index, frame))) == want
        monkeypatch.setattr(leaks, "ITEM_CHARS", 300)
        assert set(got(leaks.search(index, frame))) == want
        monkeypatch.undo()
    assert got(leaks.search(index, frame.limit(0))) == []


def test_rows_of_the_index_are_bounded(spark, tmp_path, monkeypatch):
    """However much a segment holds, its postings lie in rows of few kilobytes, and a passage is found across them."""
    rnd = random.Random(12)
    vocabulary = ["the", "of", *(f"term{i}" for i in range(3000))]
    word = lambda: vocabulary[min(int(rnd.expovariate(0.004)), rnd.randrange(len(vocabulary)))]
    docs = [(i, " ".join(word() for _ in range(4000))) for i in range(10)]
    items = [(d, "en", " ".join(docs[d][1].split()[k : k + 13])) for d, k in ((1, 0), (4, 2000), (9, 3987))]
    path = str(tmp_path / "index")
    leaks.write_index(rows(spark, docs, "doc_id bigint, text string").coalesce(1), path)
    index = leaks.read_index(spark, path)
    size = index.where("bucket >= 0").selectExpr("sum(size(gaps)) as n", "max(size(gaps)) as most", "max(size(terms)) as terms").first()
    assert size["n"] == 40_000 and size["most"] <= 512 and size["terms"] <= 512
    frame = rows(spark, items, "item_id bigint, lang string, text string")
    want = brute_leaks(docs, items)
    assert len(want) >= 3 and sorted(got(leaks.search(index, frame))) == want
    monkeypatch.setattr(leaks, "PAIRS", 2)
    block = leaks.Items(items).compile()
    assert sorted(leaks.exact(leaks.Segment.of_texts([d for d, _ in docs], [t for _, t in docs], block), block)) == want


def test_words_by_pieces(monkeypatch):
    texts = ["one two", "...", "three", "", "四五 six", "?", ""]
    want = leaks.words(texts)
    for size in (1, 4, 9, 100):
        monkeypatch.setattr(leaks, "PIECE_CHARS", size)
        assert all((a == b).all() and a.dtype == b.dtype for a, b in zip(leaks.words_by_pieces(texts), want))
