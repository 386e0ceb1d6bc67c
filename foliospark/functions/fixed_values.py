"""Word lists, constants and patterns that results depend on. Patterns are written for Java with (?U)."""

QUOTES = "“”‘’「」『』\"'"
MAX_AD_LENGTH = 40
WEB_TLDS = "com|net|org|cn|cc|la|info|top|xyz|me|tw|hk|co|io|vip|club|site|biz|so|tv|in|us|online|wang|ink|pw|ws|win|fun|life|live|app|link"
URL = (
    r"(?<![a-z0-9_.@-])(?:https?://)?(?:[a-z0-9](?:[a-z0-9-]*[a-z0-9])?\.)+(?:" + WEB_TLDS + r")(?![a-z0-9-])"
    r"(?::[0-9]{1,5})?(?:/[a-z0-9_~:/?#\[\]@!$&()*+,;=%.-]*)?"
)
SITE_NOTICE = r"(?:请)?记住本站(?:域名|网址)?(?:\s*[:：]?\s*(?:https?://|www\.)[a-z0-9.-]+(?:/[a-z0-9/?=&_%#.-]*)?)?"
PAGE_NOTICE = r"本章未完[，,；;]?\s*(?:请)?点击下一[页頁](?:继续阅读)?"
#: Whole-line templates that always apply, in order: (rule, pattern, ignore case).
LINE_TEMPLATES = (
    ("站点提示", rf"(?:{SITE_NOTICE}|{PAGE_NOTICE})[。.!！]?", True),
    ("求票推广", r"(?:(?:求(?:推荐票|月票|订阅|收藏|打赏)|投推荐票)[，,、\s]*)+[。.!！]?", False),
    ("符号行", r"[\W_]{1,12}", False),
    ("页码", r"第?\s*[（(]?\s*\d{1,3}\s*/\s*\d{1,3}\s*[）)]?\s*[页頁]", False),
    ("分隔线", r"[-—_=~*·#＝－]{3,200}[:：]?", False),
    (
        "站点推广",
        r"(?:更多|最新|全本|免费|精校|好书|欢迎|本书|本站)[^。！？]{0,30}(?:尽在|请访问|请到|请上|访问|下载|首发于)"
        r"(?=.*(?:电子书|小说|藏书|书城|书库|书屋|txt|网站|网址|中文网|书网|本站|https?://|www\.))[^。！？]{0,80}"
        r"|本书由.{0,16}(?:藏书|书城|书库|小说|电子书|论坛|txt|网站|中文网).{0,16}(?:整理|收集|制作|提供)[^。！？]{0,30}",
        True,
    ),
    (
        "站点导航",
        r"(?:(?:上一[章页頁节節回话話]|下一[章页頁节節回话話]|章[节節]目[录錄]|目[录錄]|返回目[录錄]|返回书页|加入书签|投推荐票|章节报错)[\s|｜/·]*){2,}",
        False,
    ),
    ("站点提示", r"温馨提示[:：].{0,120}(?:回车|Enter|←|→|书签|翻页).{0,120}", True),
    (
        "版权声明",
        r"(?:Copyright\b|©|版权所有).{0,80}|.{0,60}All Rights Reserved\.?|.{0,30}(?:本站所有小说为转载作品|所有章节均由网友上传).{0,100}",
        True,
    ),
    ("页码", r"[\s\d０-９]{1,12}", False),
    (
        "站点导航",
        r"(?:回|返回|前往)?(?:目[录錄]|下一[回章節话頁页]|上一[回章節话頁页]|下一[页頁]|上一[页頁]|章节目录|加入书签|收藏本站|顶部|底部|编辑|編輯|展開|收起)",
        False,
    ),
)
#: Templates for lines of at most MAX_AD_LENGTH characters besides white space, full-width ASCII folded.
AD_TEMPLATES = (
    (
        "站点推广",
        r"(?:天才)?一秒记住本站(?:地址|域名|网址)?(?:[:：]\s*\S+)?[。.!！]?"
        r"|(?:最新章节|看最新章节)请到\s*(?:【(?:笔趣阁|顶点小说|[^】]{1,16}小说网)】|(?:https?://)?(?:[a-z0-9-]+\.)+[a-z]{2,24}(?:/[a-z0-9_/?=&.%#-]*)?)\s*(?:阅读)?[。.!！]?"
        r"|手机用户请(?:浏览|访问|到)\s*(?:https?://)?(?:[a-z0-9-]+\.)+[a-z]{2,24}(?:/[a-z0-9_/?=&.%#-]*)?\s*阅读(?:[，,]更优质的阅读体验)?[。.!！]?"
        r"|更多精彩(?:小说|TXT电子书)[，,]?(?:尽在|请访问)\s*(?:[㐀-鿿]{1,12}小说网\s*)?(?:https?://)?(?:[a-z0-9-]+\.)+[a-z]{2,24}[。.!！]?"
        r"|【[㐀-鿿A-Za-z0-9_-]{1,16}(?:中文网|小说网|阅读网|文学网)首发】"
        r"|(?:笔趣阁|顶点小说|[㐀-鿿]{1,12}(?:小说网|中文网))(?:首发|无弹窗)[。.!！]?"
        r"|本书由【[^】]{1,16}】整理[，,]版权归作者所有[，,]请勿用作商业用途[。.!！]?"
        r"|如果觉得本书不错[，,]请收藏本站[，,]加入书签[，,]方便下次阅读[。.!！]?"
        r"|百度搜索\s*[㐀-鿿A-Za-z0-9_-]{1,15}\s*(?:八一中文网|笔趣阁|顶点小说)\s*即可找到本书最新章节[。.!！]?"
        r"|[→>]+点击下载APP[，,]免费看全本[←<]+",
        True,
    ),
    ("求票推广", r"(?:(?:求(?:推荐票|月票|订阅|收藏|打赏|推荐)|投推荐票|加入书签|收藏本站)[，,、!！。\s]*)+", False),
    (
        "章节提示",
        r"(?:[（(]?本章完[）)]?|本章未完[，,]?(?:请)?翻页|本章未完[，,]?(?:请)?点击下一页继续阅读\s*>+\s*(?:https?://)?(?:[a-z0-9-]+\.)+[a-z]{2,24})[。.!！]?",
        True,
    ),
    ("站点标识", r"(?:笔趣阁|顶点小说|无弹窗)[。.!！]?", False),
    ("分隔线", r"[-—_=]{3,40}", False),
    ("社群推广", r"(?:加入|关注|添加|加)?(?:QQ群|书友群|公众号|微信)(?:号|群|号码)?(?:[:：]\s*[a-z0-9_-]+)?[。.!！]?", True),
)
SITE_SIGNATURE = (
    r"(?:【[㐀-鿿A-Za-z0-9_-]{2,24}(?:小说网|阅读网|文学网|中文网|书库|书城|书阁)】|[㐀-鿿A-Za-z0-9_-]{2,24}(?:小说网|阅读网|文学网|中文网|书库|书城|书阁))(?:首发|版权所有)?"
)
PROSE_WORDS = "[我你他她它说走去来进从在是了把被让给望看想问叫着过]"
RECOMMEND = r"(?:猜你喜欢|相关推荐|热门推荐|推荐阅读|本书相关|大家都在看|热门小说)(?:[:：].*)?|章节报错.{0,10}|存书签|验证码[:：].{0,20}"
CHAPTER_MARK = r"第\s*[0-9零〇一二三四五六七八九十百千万两]{1,12}\s*[章节回话卷篇]|[Cc]hapter\s*\d{1,6}"
NUMBER_PATTERNS = (
    r"第\s*([0-9]{1,6})\s*[章节回话卷篇]",
    r"第\s*([零〇一二三四五六七八九十百千万两]{1,12})\s*[章节回话卷篇]",
    r"[Cc]hapter\s*([0-9]{1,6})",
    r"^\s*([0-9]{1,4})\s*[、.．，:：]\s*\S",
)
TITLE_SPLIT = r"\s*[|｜\-–—·_]\s*"
CN_DIGITS = "零〇一二两三四五六七八九"
CN_VALUES = (0, 0, 1, 2, 2, 3, 4, 5, 6, 7, 8, 9)
CN_UNITS = {"十": 10, "百": 100, "千": 1000, "万": 10000}
CJK = r"[㐀-䶿一-鿿豈-﫿]"
PUNCTUATION = r"[，。！？；：、“”‘’（）《》〈〉…—,.!?;:\"'()\[\]·]"
FULL_WIDTH = ((",", "，"), (".", "。"), ("!", "！"), ("?", "？"), (":", "："), (";", "；"))
ZERO_WIDTH = "\u200b\u200c\u200d\u2060\ufeff"
OCR_FIXES = (("｡", "。"), ("､", "、"), ("･", "·"), ("‧", "·"))
TERMINAL = r"[。！？；…：”’」』）】]$"
LINE_END = "。！？!?…”」』》）)～~"
HEADING = r"^第[〇一二三四五六七八九十百千万零两\d]+[章回节卷](?:\s|$|[^\s].*)"
SPECIAL_HEADING = r"^(?:序章|序言|前言|楔子|尾声|后记|番外)(?:\s.*)?$"
ENGLISH_HEADING = r"^(?i:chapter)\s+\d+(?:\s+[^。！？!?]*)?$"
NEXT_PAGE_WORDS = ("下一页", "下一頁", "下页", "次页", "后一页", "nextpage")
NEXT_CHAPTER_WORDS = ("下一章", "下一節", "下一节", "下一回", "下一话", "下一話", "下章", "nextchapter")
NAV_WORDS = (
    "首页", "主页", "目录", "章节目录", "返回目录", "上一章", "下一章", "上一页", "下一页", "尾页", "末页", "返回", "书架", "登录", "注册",
    "排行", "排行榜", "分类", "搜索", "作家", "作者", "投推荐票", "加入书签", "手机版", "电脑版", "顶部", "底部", "close", "more",
)
CATEGORY_PATH = r"^/(?i:c|cat|cats|category|categories|sort|sorts|fenlei|type|types|tag|tags|rank|paihang|search|author|zuozhe)(?:/|\.html?$)"
LIST_HINTS = r"(?:^|[\s_-])(chapter|chapters|list|listmain|catalog|mulu|zhangjie|volume|dir)\b"
PAGE_PARAMS = ("page", "p", "pg", "pageno", "page_num", "pageindex")
URL_BLACKLIST = (
    r"(?i)(?:^|[/_.\-])(logo|avatar|icon|favicon|banner|ad|ads|advert|adv|spacer|blank|loading|placeholder|ph\.|grey|gray|pixel|1x1|transparent|"
    r"qrcode|qr_|erweima|weixin|wechat|share|btn|button|arrow|bullet|dot|template|templets|skin|float|floatw|gotop|totop|prev|next)(?:[/_.\-]|$|\d)"
)
LAZY_ATTRIBUTES = (
    "data-src", "data-original", "data-lazy-src", "data-lazyload", "data-echo", "data-url", "data-cfsrc", "data-actualsrc", "data-image", "data-img", "data-origin", "_src", "src",
)
MANGA_URL = r"(?i)manhua|manga|comic|cartoon|(?<![a-z])mh(?![a-z])"
NOVEL_URL = r"(?i)xiaoshuo|novel|biquge|bqg|txt|wenxue|quanben|shu(?:ge|wu|ku|ba)|(?<![a-z])xs(?![a-z])|book"
CLOTH_COLORS = ("#2E4A62", "#3D5A4C", "#7A2E2A", "#2B3A55", "#8A5A2B", "#4A3B52", "#5B6B3A", "#6E2F3F", "#3A4A4A", "#7B6A4A")
DROP_TAGS = ("script", "style", "noscript", "template", "nav", "footer", "header", "aside", "form", "iframe", "button", "select", "textarea", "svg", "canvas")
DROP_CLASSES = (
    "noprint", "no-print", "mw-editsection", "editsection", "printfooter", "catlinks", "navbox", "hidden", "screen-reader-text", "visually-hidden",
    "advertisement", "ads", "licensetpl", "license", "licence", "copyright",
)
BLOCK_TAGS = (
    "p", "div", "br", "li", "h1", "h2", "h3", "h4", "h5", "h6", "blockquote", "pre", "section", "article", "table", "tr", "td", "th", "dd", "dt", "figure", "figcaption", "hr",
)
CONTAINER_TAGS = ("article", "main", "div", "section", "td", "body")
CONTENT_NAMES = ("content", "chapter-content", "chapter_content", "read-content", "read_content", "muye-reader-content")
COMMENT_NAME = r"(?:^|[\s_-])(?:comments?|replies|reply)(?:$|[\s_-])"
