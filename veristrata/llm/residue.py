"""Template residue, filler, error pages and script notices in place of real content.

Lines are normalised (digits apart) and counted by host: on what share of the host's distinct
texts a line stands. A line is evidence if error messages, unfilled placeholders, filler or notices
that scripts, a log-in or a check are required are all it says; a line that merely mentions
such things says more. Of a record that has evidence, lines that recur on its host, or over
all hosts, are subtracted as boilerplate; the record is excluded if nothing else is left. Lines
that look like the furniture of a page vary behind their first words, as a counter or the
title of the next page does, and are counted by these; it is the counts that decide, not the
look. Sentences, dated and numbered entries are text, however often they recur.

Only lines that such records have left are counted, by a semi-join before the shuffle, and the
counts combine on the map side, so a host with a third of all records is no single task.

Defined results: null and blank fields are no cases; very long texts are read whole, line by
line; a record delivered twice counts once; extra columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veristrata.llm import lines as L
from veristrata.tables import cut

#: Share of the other texts of the host a line must stand on to be boilerplate.
RECURRENT = 0.2
#: The same over the texts of all hosts, for lines of a template that few texts of each host show.
RECURRENT_ALL = 0.005
#: Distinct texts that a share can rest on: the text itself and two others.
LEAST_TEXTS = 3
#: Words outside placeholders, for each of them, that still count as their surrounding phrase.
AROUND = 5

_PLACEHOLDER = re.compile(r"\{\{[^{}\n]{0,40}\}\}|[$#]\{[^{}\n]{1,40}\}|<%=?[^%\n]{1,40}%>|\[\[[^\[\]\n]{1,40}\]\]|\{%[^%\n]{1,40}%\}|%\([^()\n]{1,40}\)[sd]|%%[\w.]{1,30}%%|__[^\W_][\w.]*?__|\{[\w.一-鿿]{1,40}\}|@@[\w.]{1,30}@@|[【\[（(<《]\s*(?:请?(?:填写|输入|插入|补充)|待(?:填写|补充|定)|insert |enter |your |todo|tbd)[^】\]）)>》\n]{0,30}[】\]）)>》]", re.I)
#: Notices by their wording, each to the end of its sentence (fixed values).
_NOTICE = re.compile(
    r"(?:error\s*)?\b[45]\d\d\b[\s:–-]*(?:not found|forbidden|gone|bad gateway|service (?:temporarily )?unavailable|internal server error|unauthori[sz]ed|gateway time-?out|bad request|too many requests)(?:\s*(?:nginx|apache|gateway|edge node|cloud|proxy|server)[\w-]*(?:\s*\d+)?)?"
    r"|(?:error \d+\.?\s*)?(?:sorry,? )?we (?:could not|couldn't|can't|cannot) find (?:the|that|this) page[^.\n]*\.?(?:\s*back to \w+\.?)?|http status \d+[^.\n]*\.?|(?:the )?page (?:you (?:asked|are looking) for )?(?:was |is )?not found\.?(?: back to \w+\.?)?|this (?:page|content|site) (?:isn't|is not|is no longer|is currently|is temporarily)? ?(?:un)?available[^.\n]*\.?"
    r"|(?:please )?(?:enable|activate|turn on|allow) (?:java ?scripts?|scripts|cookies)[^.\n]*\.?|(?:for the best view, )enable javascript\.?|some parts of this page need scripts\.?|java ?script (?:seems|appears|is|must)[^.\n]*\.?|some features will not load\.?|reload after enabling it\.?|you need to (?:turn on|enable|activate)[^.\n]*(?:scripts?|cookies)[^.\n]*\.?|cette page ne s'affiche pas[^.\n]*\.?|diese seite ben[öo]tigt[^.\n]*(?:script|cookies)[^.\n]*\.?|bitte (?:aktivieren|schalten)[^.\n]*\.?"
    r"|(?:your |this )?(?:request|access|ip(?: address)?|connection) (?:was |has been |is )?(?:blocked|rejected|declined|refused|restricted|forbidden|timed out|not allowed)\b[^\n]*|you (?:have been|are) blocked[^\n]*|incident (?:id|no|number)?\W*[\w-]+\.?|(?:ray|support|reference|request|error) id\W+[\w-]+|(?:unusual|suspicious|automated) (?:traffic|activity)[^.\n]*\.?|are you (?:a )?(?:robot|human)\??|just a moment[^\n]*|(?:oops|whoops)\W[^\n]{0,80}|something went wrong[^\n]{0,60}|an? (?:unexpected |unknown |internal )?error (?:has )?occurred[^\n]{0,60}|(?:connection|gateway|request|operation) tim(?:ed|e-?) ?out[^\n]{0,40}|(?:you )?must be (?:logged|signed) in[^.\n]*\.?|(?:subscribe|register|log in|sign in) to (?:read|continue|view|see)[^.\n]*\.?|members only\W*$|captcha\b[^\n]{0,40}|no (?:content|results?|data) (?:found|available)\W*$|to ?do\W*$|tbd\W*$|placeholder(?: text)?\W*$|zugriff verweigert[^\n]*|seite nicht gefunden[^\n]*|page (?:introuvable|non trouvée)[^\n]*|accès refusé[^\n]*"
    r"|access (?:is |was )?denied\.|access denied\b(?!\s+to)|your request looked automated\.?|complete the (?:check|captcha)[^.\n]*\.?|(?:verify|confirm) (?:that )?you are (?:a )?human[^.\n]*\.?|checking your browser[^.\n]*\.?|redirecting (?:you )?to[^.\n]*\.?|if nothing happens, click here\.?|(?:your )?session (?:has )?expired\.?|please (?:log|sign) in(?: again)?(?: to [^.\n]*)?\.?|too many requests[^.\n]*\.?|loading(?:\.{2,}|…|\W*$)|please wait\W*$"
    r"|(?:this site is )?(?:down for|under) (?:scheduled )?maintenance[^.\n]*\.?|coming soon\W*$|insert your text here\.?|replace this (?:paragraph|text)[^.\n]*\.?|sample (?:heading|paragraph|text|title|content)\.?|text to be supplied(?: \(tbs\))?|headline goes here|(?:your|add) (?:text|title|content) (?:goes )?here\.?|beispieltext(?: – bitte ersetzen)?\.?|hier steht später[^.\n]*\.?|lorem ipsum[^\n]*"
    r"|\b(?:undefined|null|nan|none)(?:[\s|,/;·-]+(?:undefined|null|nan|none))+|(?:undefined|null|nan)\W*$|\[object object\]|warning: undefined [^\n]*line \d+|(?:fatal|parse) error: [^\n]*|traceback[^\n]*|sql(?:state)? ?error[^\n]*|java\.[\w.]+(?:exception|error)[^\n]*|\w+(?:exception|error) (?:at|in) [\w./()]+[^\n]*"
    r"|(?:本站|本页|该页面|页面)?(?:需要|须|请)(?:启用|开启|打开|允许)(?:浏览器)?(?:的)?(?:脚本|javascript)[^。\n]*。?|如页面显示异常[^。\n]*。?|部分功能需要启用脚本[^。\n]*。?|(?:您|你)的浏览器(?:禁用|不支持|未启用|关闭)[^。\n]*。?|正在(?:加载|跳转|载入)[^。\n]*。?|加载中[\s·….。]*|(?:会话|登录)(?:已)?(?:过期|失效|超时)[^。\n]*。?|检测到异常[^。\n]*。?|请完成(?:滑块|安全)?验证[^。\n]*。?|(?:您|你)所在的网络[^。\n]*。?|登录后(?:查看|可见|阅读)[^。\n]*。?(?:还没有账号？)?(?:立即注册)?"
    r"|(?:该|此|本)(?:内容|文章|页面|信息)已(?:下架|删除|过期|失效|被删除)[^。\n]*。?|系统(?:繁忙|错误|异常)[^。\n]*。?|错误代码\s*[:：]\s*\w+[^。\n]*。?|服务器(?:开小差|错误|内部错误|繁忙)[^。\n]*。?|数据库连接(?:失败|错误)[^。\n]*。?|找不到(?:该|您要的|此)?页面[^。\n]*。?|(?:网站|系统|页面|服务)(?:正在)?(?:维护|升级)中?[^。\n]*。?|(?:抱歉|对不起)，(?:您|你)(?:访问|查找|请求)的(?:页面|内容)[^。\n]*。?|\d+\s*秒后(?:自动)?(?:跳转|返回)[^。\n]*。?"
    r"|(?:您的|你的|该)?(?:请求|访问|IP|操作)(?:已)?(?:被)?(?:拦截|拒绝|禁止|阻止|限制|受限)[^。\n]*。?|(?:无权|没有权限|禁止)访问[^。\n]*。?|请(?:先|重新)?登录(?:后)?(?:再|查看|访问|继续)?[^。\n]{0,16}。?|请输入验证码[^。\n]*。?|(?:人机|安全|滑动)验证[^。\n]{0,24}。?|(?:网络|连接|请求)(?:异常|超时|失败|错误)[^。\n]*。?|(?:页面|内容|数据|资源)(?:加载|获取|请求)?(?:失败|出错|错误|不存在|已失效|走丢了)[^。\n]*。?|(?:出错|出错啦|出错了|哎呀)[^。\n]{0,24}。?|暂无(?:内容|数据|信息|正文|简介)。?|敬请期待[^。\n]{0,8}。?|(?:页面|栏目|网站)?(?:正在)?建设中[^。\n]{0,16}。?|(?:暂时)?无法(?:显示|访问|查看|打开)(?:该|此)?(?:页面|内容)?[^。\n]{0,8}。?|待(?:补充|完善|填写|更新)。?$"
    r"|[xX]{2,4}年[xX]{1,2}月[xX]{1,2}日|某某(?:学院|同学|大学|公司|老师|单位)|标题\s*[:：]\s*无标题|作者\s*[:：]\s*匿名|内容\s*[:：]\s*$|nan\s*条结果|共\s*nan\s*页|此处填写[^。\n]*。?|请在此(?:处)?(?:输入|填写)[^。\n]*。?|(?:示例|占位|样例)(?:文字|文本|内容)|测试测试|测试(?:内容|文字|数据)",
    re.I,
)
#: The same by parts: what is spoken of and the state it is in, in several languages (fixed values); a sentence that says more, as when and where, does not fit.
_SUBJECT = r"(?:(?:this|the|our|your|that) )?(?:requested |web ?|user )?(?:domain(?: name)?|web ?site|site|web ?page|page|url|resource|file|document|account|profile|shop|store|server|service|system|application|app|blog|forum|listing|article|video|content|link|session|connection|browser|ip(?: address)?|host)s?"
_STATE = r"(?:for sale|suspended|parked|closed|disabled|deactivated|deleted|removed|blocked|banned|expired|offline|down|unavailable|unreachable|inactive|restricted|forbidden|private|empty|missing|outdated|unsupported|not (?:found|available|supported|accessible|responding|working)|no longer (?:available|active|exists?|supported)|under (?:construction|maintenance)|being (?:updated|moved|redirected)|busy|overloaded)"
_PARTS = re.compile(
    rf"{_SUBJECT}(?:,? (?:you (?:requested|asked for|are looking for|tried to (?:open|reach)))?,? ?(?:is|are|has|have|was|were|may|might|could|has been|have been|may have been|does|do)(?: (?:been|be|currently|temporarily|permanently|now|either|not))* )(?:{_STATE}|exist)(?:(?:,| or| and|;) ?(?:{_STATE}|come back later|(?:please )?(?:try|check) (?:again|back)(?: later| soon)?))*\W*"
    r"|(?:service (?:temporarily )?unavailable|bad gateway|gateway time-?out|internal server error|access forbidden|forbidden|page not found|not found|unauthori[sz]ed|permission denied|access denied|account suspended|domain (?:for sale|expired)|connection (?:lost|failed|refused)|login required|members only)\W*(?=$|[.!。\n])"
    r"|you (?:do not|don't|no longer) have (?:the )?(?:permissions?|access|rights|authori[sz]ation|privileges)(?: (?:to|for|on) [^.?!\n]{0,60})?(?=[.!\n]|$)\.?|you (?:are|were) not (?:authori[sz]ed|allowed|permitted|logged in|signed in)[^.\n]{0,60}\.?|(?:verifying|checking|validating|confirming) (?:your |that you |if the )[^.\n]{0,60}\.?|(?:please )?(?:come|check|try) (?:back|again)(?: later| soon| in a (?:few )?(?:moments?|minutes?))?\W*|(?:please )?(?:log|sign) in (?:first|required|to your account)[^.\n]{0,30}\.?"
    r"|acceso (?:denegado|restringido|prohibido)\W*|página no (?:encontrada|disponible)[^.\n]{0,40}\.?|(?:por favor,? )?(?:inicie|inicia) sesión[^.\n]{0,40}\.?|(?:por favor,? )?(?:active|activa|habilite|habilita) (?:java ?script|las cookies)[^.\n]{0,60}\.?|sitio en (?:construcción|mantenimiento)[^.\n]{0,40}\.?|página não encontrada[^.\n]{0,40}\.?|acesso negado\W*|pagina non trovata[^.\n]{0,40}\.?|accesso negato\W*"
    r"|veuillez (?:vous (?:connecter|identifier)|activer|patienter|réessayer|vérifier)[^.\n]{0,60}\.?|(?:page|site) en (?:construction|maintenance)[^.\n]{0,40}\.?|(?:cette |la )?page (?:n'existe (?:pas|plus)|est introuvable)[^.\n]{0,40}\.?|accès (?:interdit|réservé)[^.\n]{0,30}\.?"
    r"|wartungsarbeiten(?: – [^.\n]{0,50}|[^.\n]{0,30})\.?|bitte (?:melden sie sich an|loggen sie sich ein|warten|versuchen sie es)[^.\n]{0,40}\.?|(?:die|diese) seite (?:wurde nicht gefunden|ist (?:nicht|derzeit nicht) (?:verfügbar|erreichbar)|existiert nicht)[^.\n]{0,30}\.?|kein zugriff\W*"
    r"|страница не (?:найдена|существует)[^.\n]{0,30}\.?|доступ (?:запрещен|запрещён|закрыт|ограничен)[^.\n]{0,30}\.?|(?:пожалуйста,? )?включите javascript[^.\n]{0,40}\.?|сайт (?:на обслуживании|временно недоступен)[^.\n]{0,30}\.?"
    r"|(?:お探しの|この)?ページ(?:が|は)(?:見つかりません|存在しません|表示できません)(?:でした)?[。！]?|(?:この)?(?:コンテンツ|ページ)を(?:見る|閲覧する)には[^。\n]{0,30}[。！]?|ログイン(?:してください|が必要です)[。！]?|(?:ただいま|現在)?、?メンテナンス中です?[^。\n]{0,20}[。！]?|javascript ?を有効にしてください[。！]?|페이지를 찾을 수 없습니다[.!]?|접근이 (?:거부|제한)되었습니다[.!]?"
    r"|页面(?:飞走|走丢|跑丢|丢失|消失|不见|找不到|去火星)了?[^。\n]{0,12}[。！]?|(?:您|你)?的?(?:账号|帐号|账户|帐户|设备|网络|浏览器)(?:存在|出现|有|处于)?(?:异常|风险|安全风险|被冻结|被封禁|已停用|版本过低|不受支持)[^。\n]{0,24}[。！]?|请稍[后候](?:再试|重试|再来|访问)?[。！]?|(?:该|此|本)?(?:域名|网站|店铺|账号|服务)(?:正在|已|已经|已被|暂时|现已)?(?:出售|停用|关闭|下线|过期|到期|停止服务|被封|被冻结|无法访问|不可用)[^。\n]{0,12}[。！]?",
    re.I,
)
_DECORATION = re.compile(r"^\W+|\W+$|\b[\w-]+\d*\.(?:example|test|invalid|com|cn|org|net)\b|\[[\d:.\s-]+\]|\(\s*ref\.?\s*[0-9a-f]+\s*\)|请求编号\s*[:：]\s*\w*|/[\w./-]+\.html?\b|</?\w{1,6}>|\b(?=\w*\d)[0-9a-f-]{4,}\b|\bviews?\b")
_LEAD = re.compile(r"(?:[^\w\[]+|\b[\w-]+\d+\.(?:example|test|invalid|com|cn|org|net)\b)*")
_GAP = re.compile(r"[^\w\[]*")
_WORD = re.compile(r"[^\W\d_一-鿿]+|[一-鿿]")
_LATIN = re.compile(r"[^\W\d_一-鿿]{2,}")
_REPEAT = re.compile(r"^\W*([一-鿿]{1,6})\1{2,}\W*$")
#: Short words one of which any stretch of real text in these languages has (fixed values).
_GLUE = set("the of and to in a an for on with that by is was are were be at as it its from or this which who has have had not but after before while when once into der die das und von zu mit für auf ist im des den ein eine le la les et de du des un une pour dans sur est".split())


def _words(s: str) -> float:
    return sum(0.5 if "一" <= w[0] <= "鿿" else 1 for w in _WORD.findall(s))


def _is_filler(s: str) -> bool:
    """Words without any glue between them, mostly in lower case: text that only fills space."""
    if not s.isascii():
        return bool(_REPEAT.match(s))
    if len(s) < 30 or " the " in s or " of " in s or " and " in s or " to " in s or " in " in s or " a " in s:
        return False
    w = _LATIN.findall(s)
    if len(w) < 6 or any(x.lower() in _GLUE for x in w):
        return False
    small = sum(x.islower() for x in w)
    return small >= 0.7 * len(w) and (len(w) >= 8 or len(set(map(str.lower, w))) < 0.8 * len(w)) and not any(c.isdigit() for c in _DECORATION.sub(" ", s))


def is_evidence(line: str) -> bool:
    """True if residue, filler or a notice is all that the line says."""
    s = line.strip()
    if not s:
        return False
    if "{" in s or "<%" in s or "[[" in s or "__" in s or "%(" in s or "@@" in s or "%%" in s or "【" in s or "[" in s or "待" in s or "请" in s:
        holes, n = _PLACEHOLDER.subn(" ", s)
        if n and _words(_DECORATION.sub(" ", holes)) <= AROUND * n:
            return True
        if re.fullmatch(r"[\W_]*(?:_{2,}\W*[年月日号]?\W*){2,}\w{0,6}\W*", _DECORATION.sub(" ", s)):
            return True  # a form left blank
    at, found = _LEAD.match(s).end(), False
    while at < len(s) and (m := _NOTICE.match(s, at) or _PARTS.match(s, at)) and m.end() > at:
        found, at = True, _GAP.match(s, m.end()).end()
    if found:
        return _words(_DECORATION.sub(" ", s[at:])) <= 2.5
    if _is_filler(s):
        return True
    if len(s) < 1000 and (s[-1] in "])!" or s[:1] == "!" or "|" in s or ": " in s[:32] or ".example" in s or ".htm" in s or "请求编号" in s):
        return _is_filler(_DECORATION.sub(" ", s).strip())
    return False


_OUT = pa.schema([("tab", pa.string()), ("row_id", pa.int64()), ("host", pa.string()), ("open", pa.list_(pa.int64()))])


_PARTS_OF = re.compile(r"[:：©|｜>»·/、&]|\d+|\s{2,}|[-–—] ")


def head(line: str) -> str:
    """The first words of a line of furniture, up to what varies."""
    s = line.strip().lower()
    return next((p.strip() for p in _PARTS_OF.split(s) if len(p.strip()) > 1), s)


_line_keys: dict[str, int] = {}


def line_key(line: str) -> int:
    """The key that a line is counted by: of its first words where it looks like furniture, else of all of it."""
    k = _line_keys.get(line)
    if k is None:
        k = L.key("\x02" + head(line)) if L.look(line) & (L.FURN | L.NAV) else L.key(line)
        if len(line) <= 60:
            if len(_line_keys) > 100_000:
                _line_keys.clear()
            _line_keys[line] = k
    return k


_IDS = re.compile(r"\W*(?=\w*\d)[0-9a-f-]{4,}\W*")


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Records with evidence, each with the keys of its other lines.

    A record with a sentence or an entry among these, that is no furniture by its look, has real text and is left out. The record's own title is no boilerplate, however often it recurs; its key is counted nowhere.
    """
    memo: dict[str, bool] = {}

    def evidence(line: str) -> bool:
        e = memo.get(line)
        if e is None:
            e = is_evidence(line)
            if len(line) < 80:
                if len(memo) > 50_000:
                    memo.clear()
                memo[line] = e
        return e

    for b in L.pieces(batches):
        out: tuple[list, list, list, list] = ([], [], [], [])
        for tab, row_id, title, host, text in zip(*(b.column(i).to_pylist() for i in (0, 1, 3, 2, 4))):
            lines = [x for x in text.split("\n") if x and not x.isspace()]
            own = (title or "").strip()
            # a sentence or an entry that is no evidence is real text; the longest lines tell soonest
            if len(lines) > 1 and any(L.look(x) & (L.SENT | L.ENTRY | L.NUMBERED) and not L.look(x) & (L.FURN | L.NAV) and not _IDS.fullmatch(x) and not evidence(x) for x in sorted(lines, key=len, reverse=True)):
                continue
            others = [x for x in lines if not evidence(x)]
            if len(others) < len(lines):  # so a text of one line has none left
                rest = [row_id ^ 0x5DEECE66D if x.strip() == own else line_key(x) for x in others if x.strip() == own or not _IDS.fullmatch(x)]
                for col, x in zip(out, (tab, row_id, host, rest)):
                    col.append(x)
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(out, _OUT)], schema=_OUT)


def _keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in L.pieces(batches):
        k = [sorted({line_key(x) for x in t.split("\n") if x and not x.isspace()}) for t in b.column(3).to_pylist()]
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), pa.array(k, pa.list_(pa.int64()))], names=["tab", "content", "host", "keys"])


def exclude(rows: DataFrame) -> DataFrame:
    """Distinct (tab, row_id) of rows(tab, row_id, host, title, text) whose text is no real content."""
    rows = rows.where("row_id is not null and text is not null").select("tab", "row_id", F.coalesce("host", F.lit("")).alias("host"), "title", "text")
    seen = cut(rows.mapInArrow(_scan, "tab string, row_id bigint, host string, open array<bigint>"))
    sure = seen.where(F.size("open") == 0).select("tab", "row_id")
    asked = seen.where(F.size("open") > 0).select("tab", "row_id", "host", F.explode(F.array_distinct("open")).alias("key")).distinct()
    pages = rows.where(F.instr("text", "\n") > 0).select("tab", F.xxhash64("text").alias("content"), "host", "text")
    lines = pages.mapInArrow(_keys, "tab string, content bigint, host string, keys array<bigint>")
    # lines that are asked about alone go on to the counts
    lines = lines.select("tab", "host", "content", F.explode("keys").alias("key")).join(asked.select("key").distinct(), "key", "left_semi")
    by_host = cut(lines.distinct().groupBy("tab", "host", "key").agg(F.count("*").alias("n")))
    sizes = cut(pages.select("tab", "host", "content").distinct().groupBy("tab", "host").agg(F.count("*").alias("m")))
    often = lambda share: F.col("n") >= F.greatest(1 + share * (F.col("m") - 1), F.lit(LEAST_TEXTS))
    everywhere = by_host.groupBy("tab", "key").agg(F.sum("n").alias("n")).join(sizes.groupBy("tab").agg(F.sum("m").alias("m")), "tab").where(often(RECURRENT_ALL)).select("tab", "key")
    here = by_host.join(sizes, ["tab", "host"]).where(often(RECURRENT)).select("tab", "host", "key")
    left = asked.join(here, ["tab", "host", "key"], "left_anti").join(everywhere, ["tab", "key"], "left_anti").select("tab", "row_id").distinct()
    cleared = asked.select("tab", "row_id").distinct().join(left, ["tab", "row_id"], "left_anti")
    return sure.unionByName(cleared).distinct()
