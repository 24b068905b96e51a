"""Lines of pages: how a line is normalised, what it looks like and where on the page it hangs.

Shared by the operators for residue and for boilerplate. Everything here looks at one page.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
import xxhash

#: Texts of page furniture in several languages (fixed values).
FURNITURE = re.compile(
    r"^(?:©|\(c\)\s|copyright\b|版权所有|主办单位|承办单位)|all rights reserved|ICP[备证]|公网安备|^(?:访问量|浏览次数|点击数|阅读次数|浏览量)\s*[:：]|^(?:友情链接|技术支持|快速链接|相关链接|快捷入口|快捷链接|常用链接)\s*[:：]|^建议使用.{0,24}(?:分辨率|浏览)"
    r"|^powered by\b|^(?:back to|nach|zum) (?:top|oben|seitenanfang)|^nach oben$|^follow us|^subscribe\b|newsletter|^privacy\b|^datenschutz|^impressum|^accessibility|无障碍(?:浏览|阅读)|\bcookies?\b|缓存文件|扫一扫|微信公众号|关注我们"
    r"|^(?:上|下)一[篇条页]\s*[:：]|^(?:previous|next|prev)\s*[:：]|^(?:zurück|weiter|vorheriger|nächster)\w*\s*[:：]|^(?:当前|您的|您所在的|你的)?位置\s*[:：]|^您所在的位置|^you are here|^sie sind hier|^分享(?:到|至)?\s*[:：]?|打印本页|关闭窗口|^字体\s*[:：]|^【?字号|^(?:站内|全文)?搜索$|^登录\s*[/|]?\s*注册$"
    r"|^(?:sign|log) (?:in|up|out)\b.{0,24}$|^skip to\b|^search(?: this)?(?: site)?$|^suche$|^listen to this|^share\b.{0,40}$|^teilen\b|^menu$|^menü$|^\d+ min read|\d+ views$|^(?:quick|useful) links\b|^report a problem|设为首页|加入收藏|^(?:移动|手机|电脑|英文)版$|^english$|^deutsch$|^A A A$"
    r"|^advertis|^anzeige$|^werbung$|^sponsored|^广告$|^推广$|^story continues|^continue reading|^read more|^点击(?:图片)?查看|展开全文|^查看更多|^更多\s*(?:>|»)*$"
    r"|^(?:most read|you may also like|related (?:stories|articles|posts|news)|latest news|trending|popular)\b|^(?:meistgelesen|mehr zum thema|das könnte sie)|^(?:猜你喜欢|最新公告|热门文章|相关阅读|推荐阅读|热点推荐|相关新闻|最新动态|热门推荐|图片新闻)$"
    r"|(?:need|enable|require)s? (?:java)?scripts?\b|浏览器脚本|启用脚本|^terms\b|sitemap|^网站地图|^联系我们$|^contact us$|^giving$",
    re.I,
)
_DIGITS = re.compile(r"\d+")
_PIECES = re.compile(r"\s*(?:[>|｜/·»•]|\s{2,}|\t)\s*")
_SENTENCE = re.compile(r"[。！？!?.…][”\"'）)\]]*$")
_ENTRY = re.compile(r"^(?:\d{4}\s*[.年/-]|\d{4}\s)\s*\S|^(?:19|20)\d\d$")
_NUMBERED = re.compile(r"^\s*(?:\d{1,3}[.、)）]|[（(]\d{1,3}[)）]|[-*•])\s*\S")
TITLE, NAV, FURN, SENT, ENTRY, NUMBERED, HEAD, BODY, FOOT, END, BLANK = 1, 2, 4, 8, 16, 32, 64, 128, 256, 512, 1024


#: Pages, and bytes of them on average, that are made objects of at once.
PIECE_ROWS, PIECE_BYTES = 500, 4 << 20


def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches in pieces: Arrow's are counted in rows, however long these are, and all objects of one would be held at once."""
    for b in batches:
        n = max(1, min(PIECE_ROWS, PIECE_BYTES * b.num_rows // max(b.nbytes, 1)))
        for at in range(0, b.num_rows, n):
            yield b.slice(at, n)


_keys: dict[str, int] = {}


def key(line: str) -> int:
    """A short line without its digits, a long one as it is."""
    if len(line) > 60:
        return _key(line)
    k = _keys.get(line)
    if k is None:
        if len(_keys) > 100_000:
            _keys.clear()
        k = _keys[line] = _key(line)
    return k


def _key(line: str) -> int:
    s = line.strip().lower()
    return xxhash.xxh64_intdigest(_DIGITS.sub("0", s) if len(s) <= 40 else s) - (1 << 63)


def is_navigation(line: str) -> bool:
    """Several short labels with separators between them."""
    s = line.strip()
    if len(s) > 160 or _SENTENCE.search(s) or "，" in s or ", " in s:
        return False
    pieces = [p for p in _PIECES.split(s) if p]
    return len(pieces) >= 3 and all(len(p) <= (20 if p.isascii() else 8) for p in pieces) and not any(c.isdigit() for c in s)


_LONG_FURNITURE = re.compile(r"^©|^版权所有|all rights reserved|\bcookies?\b|缓存文件|浏览器脚本", re.I)
_memo: dict[str, int] = {}


def look(line: str) -> int:
    f = _memo.get(line)
    if f is None:
        f = _look(line)
        if len(line) <= 60:
            if len(_memo) > 100_000:
                _memo.clear()
            _memo[line] = f
    return f


def _look(line: str) -> int:
    s = line.strip()
    f = 0
    if len(s) <= 60 and FURNITURE.search(s) or 60 < len(s) <= 130 and _LONG_FURNITURE.search(s):
        f |= FURN
    elif is_navigation(s):
        f |= NAV
    elif _ENTRY.match(s):
        f |= ENTRY
    elif _NUMBERED.match(s):
        f |= NUMBERED
    if not f & (NAV | ENTRY | NUMBERED) and len(s) >= (12 if not s.isascii() else 30) and _SENTENCE.search(s):
        f |= SENT
    return f


def page(lines: list[str | None], title: str | None) -> list[int]:
    """The look of each line and the branch it hangs in: before, in or after the page's own text.

    The text starts with the title where it stands among the lines, else with the first
    sentence or entry; it ends with the last of these, which is a branch of its own, as it is
    in the text by its own look alone.
    """
    looks = [look(x) if x and x.strip() else BLANK for x in lines]
    name = (title or "").strip()
    first = None
    if name:
        for i, x in enumerate(lines):
            s = (x or "").strip()
            if s and (s == name or (len(s) >= 2 and name.startswith(s) and name[len(s) :][:1] in ("-", "_", "|", "–", "—", " ") and not looks[i] & (FURN | NAV))):
                looks[i] = TITLE
                first = i
                break
    own = [i for i, f in enumerate(looks) if f & (SENT | ENTRY | TITLE) and not f & FURN]
    if first is None:
        first = own[0] if own else len(lines)
    last = own[-1] if own else -1
    return [f | (HEAD if i < first else END if i == last and not f & TITLE else BODY if i <= last else FOOT) for i, f in enumerate(looks)]
