"""Scalar text functions as Column expressions: nothing leaves the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Characters dropped from a normalised query.
NOISE = r"""[？?。.！!，,；;：:"'\s]+"""
# How greetings and acknowledgements begin.
GREETING = r"(?i)^(你好|hi|hello|hey|嗨|哈喽|您好|早上好|下午好|晚上好|在吗|在不在|谢谢|感谢|thanks|thank|ok|好的|明白了|收到|再见|拜拜|bye)"
# Words that tell a question's intent, in the order they are tried.
INTENTS = [
    ("exploratory", 0.85, "全面|详细|深入|系统|完整|综合|总结|梳理|整理|盘点|概览|所有|全部|方方面面|来龙去脉|整体"),
    ("analytical", 0.85, "区别|对比|比较|为什么|为何|原理|优缺点|利弊|异同|差异|哪个好|哪个快|选择|权衡|分析|深入|详解|剖析|底层|机制"),
    ("procedural", 0.85, "如何|怎么|怎样|步骤|教程|方法|实现|配置|部署|安装|搭建|使用|操作|设置|编写|创建|引入|集成|调用|运行|启动"),
    ("factoid", 0.9, "什么是|是什么|有哪些|定义|含义|概念|作用|功能|特点|类型|分类|版本|区别"),
]
CLAUSES = "[，,；;、和与及或以]"
# How names of laws and rules are made, how sources are cited, and
# what is put under an answer at medium risk, at high risk, and before its claims.
LAW = r"(?:中华人民共和国)?[一-鿿]{2,20}(?:法|条例|规定|办法|决定|意见|通知|细则|准则|通则|方案|标准)(?:（[^）]+）)?"
CITED = [r"\[来源\s*(\d+)\]", r"\[(\d+)\]", r"【来源\s*(\d+)】", r"参考\s*(\d+)"]
DISCLAIMERS = ["⚠️ 部分内容可能缺乏文档支撑，请谨慎参考。", "⚠️ 该回答可能包含未经文档验证的内容。", "\n以下内容可能缺乏支撑：\n"]
CODE = r"[.\[\](){}\-><_]"
#: A Chinese character, or a run of other letters and digits.
WORD = r"[一-鿿]|[\p{L}\p{N}&&[^一-鿿]]+"


def tokens(text: Column) -> Column:
    """Lower-cased runs of letters and digits; Chinese characters singly, as no
    blank parts their words."""
    return F.regexp_extract_all(F.lower(text), F.lit(WORD), F.lit(0))


def normalize_query(query: Column) -> Column:
    return F.regexp_replace(F.lower(query), NOISE, "")


def cache_key(query: Column) -> Column:
    return F.md5(normalize_query(query))


def content_key(*parts: Column) -> Column:
    return F.left(F.sha2(F.concat_ws("\u0001", *parts), 256), F.lit(16))


def is_small_talk(query: Column) -> Column:
    """A greeting, or three characters at most without a code mark."""
    q = F.trim(query)
    return q.rlike(GREETING) | ((F.char_length(q) <= 3) & ~q.rlike(r"[.()\[\]{}=<>_]"))


def intent(query: Column) -> Column:
    """Struct (intent_type, confidence): key words first, then length and marks."""

    def of(name: str, confidence: float) -> Column:
        return F.struct(F.lit(name).alias("intent_type"), F.lit(confidence).alias("confidence"))

    q = F.trim(query)
    out = F.when(q.rlike(INTENTS[0][2]), of(*INTENTS[0][:2]))
    for name, confidence, words in INTENTS[1:]:
        out = out.when(q.rlike(words), of(name, confidence))
    return out.when(F.char_length(q) <= 15, of("factoid", 0.7)).when(q.rlike("[？?]"), of("factoid", 0.65)).otherwise(of("analytical", 0.6))


def complexity(query: Column) -> Column:
    q = F.trim(query)
    n, clauses = F.char_length(q), F.regexp_count(q, F.lit(CLAUSES))
    simple = (n <= 12) & (clauses == 0)
    return (
        F.when(simple & ~q.rlike(CODE), "simple")
        .when(simple | ((n <= 30) & (clauses <= 1)), "medium")
        .when(((clauses >= 2) & (n > 30)) | (clauses >= 3) | (n > 60), "complex")
        .otherwise("medium")
    )


def jaccard(a: Column, b: Column) -> Column:
    union = F.size(F.array_union(a, b))
    return F.when(union == 0, 0.0).otherwise(F.size(F.array_intersect(a, b)) / union)


def cosine(a: Column, b: Column) -> Column:
    """From -1 to 1. The root is taken once, of the product, so that equal
    vectors have exactly 1 whatever they are, and 0 for a vector of zeros."""

    def dot(x: Column, y: Column) -> Column:
        return F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)

    norm = F.sqrt(dot(a, a) * dot(b, b))
    found = dot(a, b) / norm
    return F.when(norm == 0, 0.0).when(found > 1, 1.0).when(found < -1, -1.0).otherwise(found)


def greedy_distinct(variants: Column, threshold: float = 0.7) -> Column:
    """Variants in order, without those whose word Jaccard with a kept one is
    over the threshold."""

    def words(x: Column) -> Column:
        return F.array_distinct(F.regexp_extract_all(F.lower(x), F.lit("[a-z0-9]+|[一-鿿]"), F.lit(0)))

    return F.aggregate(
        variants, F.array().cast("array<string>"), lambda kept, v: F.when(F.exists(kept, lambda k: jaccard(words(k), words(v)) > threshold), kept).otherwise(F.array_append(kept, v))
    )


def law_names(text: Column) -> Column:
    """Names of laws and other rules: a Chinese name with its kind, and what stands in brackets after it."""
    return F.array_distinct(F.regexp_extract_all(text, F.lit(LAW), F.lit(0)))


def query_variants(reply: Column, most: int = 3) -> Column:
    """A rewriter's reply, a variant each line: numbering and marks in front are dropped, blank lines too."""
    lines = F.transform(F.split(reply, "\n"), lambda x: F.trim(F.regexp_replace(F.trim(x), r"^(?:\d+[.)、]\s*|[-*•]\s*)", "")))
    return F.slice(F.filter(lines, lambda x: x != ""), 1, most)


def entity_lines(reply: Column) -> Column:
    """Entities of a reply's lines ``(entity|name|type|description)``."""
    return _lines(reply, r"\A\(entity\|(.+?)\|(.+?)\|(.+?)\)", ["name", "type", "description"])


def relation_lines(reply: Column) -> Column:
    """Relations of a reply's lines ``(relation|source|target|description)``, with
    weight and keywords (parted by ;) where they are told, else 1 and none."""
    full = _lines(reply, r"\A\(relation\|(.+?)\|(.+?)\|([^|]+?)(?:\|(\d+)\|(.+?))?\)", ["source", "target", "description", "weight", "keywords"])

    def one(x: Column) -> Column:
        words = F.filter(F.transform(F.split(x["keywords"], ";"), lambda k: F.trim(k)), lambda k: k != "")
        return F.struct(x["source"].alias("source"), x["target"].alias("target"), x["description"].alias("description"), F.coalesce(x["weight"].try_cast("int"), F.lit(1)).alias("weight"), words.alias("keywords"))

    return F.transform(full, one)


def _lines(reply: Column, pattern: str, names: list[str]) -> Column:
    lines = F.filter(F.transform(F.split(reply, "\n"), lambda x: F.trim(x)), lambda x: x.rlike(pattern))
    return F.transform(lines, lambda x: F.struct(*(F.trim(F.regexp_extract(x, pattern, i + 1)).alias(n) for i, n in enumerate(names))))


def positive_counts(reply: Column) -> Column:
    """A reply's JSON object of tags and counts, those over 0; empty where it is none."""
    found = F.coalesce(lenient_json(reply, "map<string,string>"), F.create_map().cast("map<string,string>"))
    numbers = F.transform_values(found, lambda k, v: F.coalesce(v.try_cast("double").try_cast("int"), F.lit(0)))
    return F.map_filter(numbers, lambda k, v: v > 0)


def disclaimer(risk: Column, unsupported: Column, most: int = 3, length: int = 50) -> Column:
    """What is put under an answer: nothing at low risk; at high risk the first
    unsupported claims too, cut short."""
    shown = F.transform(F.slice(unsupported, 1, most), lambda x: F.concat(F.lit("- "), F.when(F.char_length(x) > length, F.concat(F.left(x, F.lit(length)), F.lit("..."))).otherwise(x)))
    medium, begins, claims = DISCLAIMERS
    high = F.concat(F.lit(begins), F.when(F.size(shown) > 0, F.concat(F.lit(claims), F.array_join(shown, "\n"))).otherwise(""))
    return F.when(risk == "low", "").when(risk == "medium", medium).otherwise(high)


def coerced(value: str) -> int | float | bool | str:
    """A setting as told on a command line: a whole number, a number, true or false, or text."""
    for kind in (int, float):
        try:
            return kind(value)
        except ValueError:
            continue
    return value.lower() == "true" if value.lower() in ("true", "false") else value


def expired(at: Column, now: Column, seconds: Column | int) -> Column:
    """Whether an entry of a time is older than it may be."""
    return F.coalesce(now.cast("double") - at.cast("double") > seconds, F.lit(True))


def _cited(answer: Column, group: int) -> Column:
    return F.concat(*(F.regexp_extract_all(answer, F.lit(p), F.lit(group)) for p in CITED))


def citations(answer: Column) -> Column:
    """Distinct cited numbers, pattern by pattern, in order of their first place."""
    return F.array_distinct(F.transform(_cited(answer, 1), lambda x: x.try_cast("int")))


def citation_marks(answer: Column) -> Column:
    """(index, marker, position) of each cited number's first place, pattern by pattern; positions count from 0."""
    pairs = F.transform(F.arrays_zip(_cited(answer, 0).alias("m"), _cited(answer, 1).alias("n")), lambda x: F.struct(x["n"].try_cast("int").alias("index"), x["m"].alias("marker"), (F.instr(answer, x["m"]) - 1).alias("position")))
    return F.aggregate(pairs, F.array().cast("array<struct<index:int,marker:string,position:int>>"), lambda kept, x: F.when(F.exists(kept, lambda k: k["index"] == x["index"]), kept).otherwise(F.array_append(kept, x)))


def keyword_coverage(answer: Column, keywords: Column) -> Column:
    found = F.size(F.filter(keywords, lambda k: F.contains(F.lower(answer), F.lower(k))))
    return F.when(F.size(keywords) == 0, 0.0).otherwise(found / F.size(keywords))


def safe_filename(url: Column) -> Column:
    """A URL's path as a Markdown file name of 120 characters at most."""
    path = F.regexp_replace(F.regexp_replace(F.coalesce(F.parse_url(url, F.lit("PATH")), F.lit("")), "^/+|/+$", ""), "/", "_")
    name = F.regexp_replace(F.when(path == "", F.md5(url)).otherwise(path), r'[<>:"|?*\\]', "")
    return F.concat(F.left(name, F.lit(120)), F.lit(".md"))


def section_prefix(source: Column, section: Column, text: Column) -> Column:
    return F.concat(F.lit("["), source, F.when(section != "", F.concat(F.lit(" - "), section)).otherwise(""), F.lit("]\n"), text)


def distance(score: Column) -> Column:
    return F.when(score > 0, F.greatest(F.lit(0.0), 1 - score)).otherwise(1.0)


def match_tags(text: Column, tags: list[str], most: int = 3) -> Column:
    """Tags that a text contains, in their given order."""
    return F.slice(F.filter(F.array(*map(F.lit, tags)), lambda t: F.contains(F.lower(text), F.lower(t))), 1, most)


def lenient_json(text: Column, schema: str) -> Column:
    """A reply's JSON: as it stands, in a fence, or from its first brace on."""
    fenced = F.regexp_extract(text, r"(?s)```(?:json)?\s*(\{.*?\})\s*```", 1)
    braced = F.regexp_extract(text, r"(?s)(\{.*\})", 1)
    return F.coalesce(*(F.from_json(F.when(F.trim(x).startswith("{"), x), schema) for x in (text, fenced, braced)))


def split_keywords(text: Column) -> Column:
    return F.filter(F.transform(F.split(text, "[,，]"), lambda x: F.trim(x)), lambda x: x != "")


def topics(text: Column, most: int = 5) -> Column:
    """The first headings of the first three levels, else the first line's first hundred characters."""
    found = F.transform(F.slice(F.regexp_extract_all(text, F.lit(r"(?m)^#{1,3}\s+(.+)$"), F.lit(1)), 1, most), lambda x: F.trim(x))
    line = F.trim(F.split(F.left(text, F.lit(100)), "\n")[0])
    return F.when(F.size(found) > 0, found).when(F.trim(text) != "", F.array(line)).otherwise(F.array().cast("array<string>"))
