"""Text expressions: safety, keywords, entities, glossary, splitting, lenient JSON."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

# The patterns that mark a graph injection, then a prompt injection.
GRAPH_INJECTION = [
    r"\.drop\s*\(", r"\.addV\s*\(", r"\.addE\s*\(", r"\.property\s*\(", r"\.sideEffect\s*\(",
    r"g\s*\.\s*V\s*\(", r"g\s*\.\s*E\s*\(", r"\.bothE\s*\(", r"\.outE\s*\(", r"\.inE\s*\(",
]
PROMPT_INJECTION = [
    r"ignore\s+(all\s+)?(previous|above|prior)\s+(instructions?|rules?|prompts?)",
    r"forget\s+(all\s+)?(previous|your)\s+(instructions?|rules?)",
    r"you\s+are\s+(now|a)\s+",
    r"(act|behave|respond)\s+as\s+(if\s+you\s+are|a)\s+",
    r"(system|시스템)\s*(prompt|프롬프트|역할|role)",
    r"(disregard|override|bypass)\s+(the\s+)?(system|rules?|instructions?)",
    r"(reveal|show|print|output)\s+(your\s+)?(system\s+)?(prompt|instructions?)",
    r"이전\s*(지시|명령|규칙).*무시",
    r"(역할|모드)\s*(변경|바꿔|전환)",
]
# Phrases that deny a payment.
NEGATIONS = [
    r"보험금[을를]?\s*못\s*받", r"보장[을를]?\s*못\s*받", r"보장받지\s*못",
    r"보험금[이가]?\s*(안|못)\s*(나오|지급)", r"(지급|보장)[이가을를]?\s*(안|못)\s*(되|받|나)",
]
# Product names, and the particles taken off their end.
PRODUCTS = [r"한화생명\s*\S+", r"\S+종신보험\S*", r"\S+정기보험\S*", r"\S+암보험\S*", r"\S+건강보험\S*", r"[eEHh]\S+보험\S*"]
PARTICLES = ["이랑", "에서", "부터", "까지", "에게", "으로", "하고", "이나", "보다", "과", "와", "의", "은", "는", "을", "를", "이", "가", "에", "도", "만", "로", "나"]
COMPLEX_WORDS = ["규제", "상계", "법", "조항", "예외", "단서", "위반", "면책", "계산식", "산출", "가입 조건", "특약"]
# Words that a topic search leaves out.
STOPWORDS = [
    "어떤", "어떻게", "무엇", "뭐", "알려주세요", "하나요", "인가요", "건가요", "될까요", "있나요", "없나요", "줘", "주세요", "궁금합니다",
    "받으려면", "해야", "하면", "할", "있다", "없다", "위해", "대해", "통해", "위한", "대한", "것", "때", "경우", "관련", "대하여",
    "가입해야", "가입하면", "가입", "확인", "문의", "보험", "보험상품", "상품", "보장", "특약", "보험료", "보험금", "계약", "약관", "조건", "내용", "사항",
]
# Words in the file names of laws.
LAW_WORDS = ["법률", "시행령", "시행규칙", "세칙", "관리법", "의료법", "보호에 관한 법률", "보험업법"]
# The intents that are complex by themselves, those that need regulations, and the
# words that do.
COMPLEX_INTENTS = ["dividend_check", "exclusion_exception", "regulation_inquiry", "loan_inquiry", "policy_comparison", "calculation_inquiry"]
REGULATED_INTENTS, REGULATED_WORDS = ["dividend_check", "exclusion_exception", "regulation_inquiry"], ["규제", "법", "의무", "위반"]
# Least scores for a keyword alone, a keyword at all, and an embedding.
KEYWORD_SURE, KEYWORD_LIKELY, EMBEDDING_SURE = 0.95, 0.8, 0.75


def any_match(text: Column, patterns: list[str]) -> Column:
    """Whether any pattern is found, regardless of case."""
    return F.coalesce(text.rlike("(?i)(?:" + ")|(?:".join(patterns) + ")"), F.lit(False))


def blocked_reason(text: Column) -> Column:
    """``graph_injection``, ``prompt_injection`` or null."""
    return F.when(any_match(text, GRAPH_INJECTION), "graph_injection").when(any_match(text, PROMPT_INJECTION), "prompt_injection")


def keyword_intent(text: Column, keywords: dict[str, list[str]]) -> Column:
    """A struct (score, intent): 0.9 and 0.02 for each keyword of the intent that is contained,
    1 at most; ties go to the intent that is listed first, and a denial to exclusions.

    (0.0, ``general``) if no keyword is contained.
    """
    table = F.array(*[F.struct(F.lit(-i).alias("ord"), F.lit(intent).alias("intent"), F.array(*map(F.lit, words)).alias("words")) for i, (intent, words) in enumerate(keywords.items())])

    def score(entry: Column) -> Column:
        n = F.size(F.filter(entry["words"], lambda w: F.contains(text, w)))
        return F.struct(F.when(n > 0, F.least(F.lit(1.0), F.round(0.9 + 0.02 * n, 4))).otherwise(0.0).alias("score"), entry["ord"].alias("ord"), entry["intent"].alias("intent"))

    # a table and not a condition for each word, which generated code could not hold
    scored = F.transform(table, score)
    best = F.array_max(scored)
    general = F.struct(F.lit(0.0).alias("score"), F.lit("general").alias("intent"))
    found = F.when(best["score"] > 0, F.struct(best["score"].alias("score"), best["intent"].alias("intent"))).otherwise(general)
    return F.when(any_match(text, NEGATIONS), F.struct(F.lit(0.95).alias("score"), F.lit("exclusion_exception").alias("intent"))).otherwise(found)


def disambiguate(text: Column, intent: Column, rules: list[tuple[list[str], list[str], str]]) -> Column:
    """The intent of the first rule with a word of both its lists in the text, else a comparison if
    it names three products or more, else ``intent``."""
    has = lambda words: text.rlike("|".join(words))
    many = F.when(F.size(product_names(text)) >= 3, F.lit("policy_comparison"))
    return F.coalesce(*[F.when(has(a) & has(b), F.lit(then)) for a, b, then in rules], many, intent)


def is_complex(text: Column, intent: Column) -> Column:
    """Whether the intent is complex by itself or the text has a word that makes it so."""
    return intent.isin(COMPLEX_INTENTS) | text.rlike("|".join(COMPLEX_WORDS))


def needs_regulation(text: Column, intent: Column) -> Column:
    """Whether an answer needs regulations."""
    return intent.isin(REGULATED_INTENTS) | text.rlike("|".join(REGULATED_WORDS))


def decide_intent(keyword: Column, keyword_score: Column, resolved: Column, embedding: Column, embedding_score: Column, model: Column) -> Column:
    """A struct (intent, confidence, tier) from three classifiers.

    A sure keyword decides.  A likely one decides, a little surer if the embedding agrees with
    ``resolved`` (the keyword's intent after disambiguation), unless a sure embedding disagrees;
    then, and where neither is sure, the ``model`` (a struct of intent and confidence) does.
    Without a keyword (null) a sure embedding decides.
    """
    pick = lambda intent, score, tier: F.struct(intent.alias("intent"), F.round(score, 6).alias("confidence"), F.lit(tier).alias("tier"))
    sure, likely = F.coalesce(keyword_score >= KEYWORD_SURE, F.lit(False)) & keyword.isNotNull(), F.coalesce(keyword_score >= KEYWORD_LIKELY, F.lit(False)) & keyword.isNotNull()
    strong = F.coalesce(embedding_score >= EMBEDDING_SURE, F.lit(False)) & embedding.isNotNull()
    deferred = pick(model["intent"], model["confidence"], "model")
    return (
        F.when(sure, pick(resolved, keyword_score, "keyword"))
        .when(likely & embedding.eqNullSafe(resolved), pick(resolved, F.least(keyword_score + 0.05, F.lit(1.0)), "agreed"))
        .when(likely & strong, deferred).when(likely, pick(resolved, keyword_score, "keyword"))
        .when(strong, pick(embedding, embedding_score, "embedding")).otherwise(deferred)
    )


def product_names(text: Column) -> Column:
    """Distinct product names in order of pattern and place, one particle taken off."""
    found = F.flatten(F.array(*[F.regexp_extract_all(text, F.lit(f"({p})"), 1) for p in PRODUCTS]))
    return F.array_distinct(F.transform(found, strip_particle))


def strip_particle(name: Column) -> Column:
    """The name without the longest particle that ends it, if anything is left."""
    return F.coalesce(*[F.when(name.endswith(p) & (F.length(name) > len(p)), F.substring(name, F.lit(1), F.length(name) - len(p))) for p in PARTICLES], name)


def topic_words(text: Column) -> Column:
    """The query without particles, question marks and stop words; the query itself if none is left."""
    cleaned = F.regexp_replace(text, r"([가-힣]+?)(을|를|에|가|이|은|는|의|도|에서|으로|와|과|이나|나|에게|한테|까지|부터)(?=\s|$|[?.])", "$1")
    words = F.split(F.trim(F.translate(cleaned, "?.", "")), r"\s+")
    kept = F.filter(words, lambda w: ~w.isin(STOPWORDS) & (F.length(w) > 1))
    return F.when(F.size(kept) > 0, F.array_join(kept, " ")).otherwise(text)


def expand_glossary(text: Column, abbreviations: dict[str, str], synonyms: dict[str, list[str]], limit: int = 3) -> Column:
    """Abbreviations replaced in order, then for each contained term its first synonym that is not
    contained, appended; the result is cut at ``limit`` times the length."""
    out = text
    for short, long in abbreviations.items():
        out = F.replace(out, F.lit(short), F.lit(long))
    table = F.array(*[F.struct(F.lit(k).alias("term"), F.array(*map(F.lit, v)).alias("words")) for k, v in synonyms.items()])

    def add(acc: Column, entry: Column) -> Column:
        word = F.filter(entry["words"], lambda w: ~F.contains(acc, w))
        longer = F.concat(acc, F.lit(" "), F.try_element_at(word, F.lit(1)))
        return F.when(F.contains(acc, entry["term"]) & (F.size(word) > 0), longer).otherwise(acc)

    return F.substring(F.aggregate(table, out, add), F.lit(1), F.length(text) * limit)


def lenient_json(text: Column, schema: str) -> Column:
    """The struct in a text that is JSON, holds a fenced block of it, or an object somewhere."""
    fenced = F.regexp_extract(text, r"(?s)```(?:json)?\s*(.*?)```", 1)
    inner = F.regexp_extract(text, r"(?s)(\{.*\})", 1)
    tried = [F.when(F.try_parse_json(c).isNotNull() & (F.trim(c) != ""), F.from_json(c, schema)) for c in (text, fenced, inner)]
    return F.coalesce(*tried)


def lenient_json_array(text: Column, schema: str) -> Column:
    """The array in a text that is JSON, holds a fenced block of it, or an array somewhere."""
    fenced = F.regexp_extract(text, r"(?s)```(?:json)?\s*(.*?)```", 1)
    inner = F.regexp_extract(text, r"(?s)(\[.*\])", 1)
    return F.coalesce(*[F.when(F.try_parse_json(c).isNotNull() & F.trim(c).startswith("["), F.from_json(c, f"ARRAY<{schema}>")) for c in (text, fenced, inner)])


def is_law(file_name: Column) -> Column:
    """Whether a file's name is a law's."""
    return F.coalesce(file_name.rlike("|".join(LAW_WORDS)), F.lit(False))


def sub_split(text: Column, size: int = 50_000, heading: str = r"### |## ■ ") -> Column:
    """A long section in parts that begin at its headings, each as long as it may be.

    Headings are taken in order; a part ends before the one that would make it longer than
    ``size``.  What stands before the first heading belongs to the first part; parts are trimmed,
    empty ones dropped; a section that is never split stays as it is, and so does one without
    headings, however long.
    """
    pieces = F.split(text, f"(?m)(?=^(?:{heading}))")
    rest = F.slice(pieces, F.lit(2), F.greatest(F.size(pieces) - 1, F.lit(0)))
    begin = F.struct(F.array().cast("array<string>").alias("done"), pieces[0].alias("open"))

    def add(acc: Column, piece: Column) -> Column:
        full = F.length(acc["open"]) + F.length(piece) > size
        return F.when(full, F.struct(F.concat(acc["done"], F.array(acc["open"])).alias("done"), piece.alias("open"))).otherwise(F.struct(acc["done"].alias("done"), F.concat(acc["open"], piece).alias("open")))

    parts = F.aggregate(rest, begin, add, lambda acc: F.concat(acc["done"], F.array(acc["open"])))
    trimmed = F.filter(F.transform(parts, lambda p: F.regexp_replace(p, r"(?s)^\s+|\s+$", "")), lambda p: p != "")
    return F.when(F.size(trimmed) > 1, trimmed).otherwise(F.array(text))


def within_budget(sections: Column, budget: int = 100_000, least: int = 1000) -> Column:
    """Texts in order until the next one passes the budget; of that one the part that fits, with
    ``...``, if it is longer than ``least``."""
    begin = F.struct(F.array().cast("array<string>").alias("out"), F.lit(0).alias("used"), F.lit(False).alias("full"))

    def add(acc: Column, text: Column) -> Column:
        left = F.lit(budget) - acc["used"]
        over = F.length(text) > left
        cut = F.concat(F.substring(text, F.lit(1), left), F.lit("..."))
        out = F.when(acc["full"], acc["out"]).when(~over, F.concat(acc["out"], F.array(text))).when(left > least, F.concat(acc["out"], F.array(cut))).otherwise(acc["out"])
        return F.struct(out.alias("out"), F.when(acc["full"] | over, acc["used"]).otherwise(acc["used"] + F.length(text)).alias("used"), (acc["full"] | over).alias("full"))

    return F.aggregate(sections, begin, add, lambda acc: acc["out"])


def split_sections(text: Column, heading: str = r"## \d+\.") -> Column:
    """Sections (number, title, body): split at lines that begin with a heading.

    What stands before the first heading is put in front of it; without any, one section
    ``full``.
    """
    parts = F.split(text, f"(?m)(?=^{heading})")
    count = F.size(F.filter(parts, lambda p: p.rlike(f"(?s)^{heading}")))
    lead = F.when(parts[0].rlike(f"(?s)^{heading}"), F.lit("")).otherwise(parts[0])
    body = F.filter(parts, lambda p: p.rlike(f"(?s)^{heading}"))
    sections = F.transform(body, lambda p, i: F.struct((i + 1).alias("number"), F.regexp_extract(p, r"^([^\n]*)", 1).alias("title"), F.when(i == 0, F.concat(lead, p)).otherwise(p).alias("body")))
    return F.when(count > 0, sections).otherwise(F.array(F.struct(F.lit(1).alias("number"), F.lit("full").alias("title"), text.alias("body"))))


def product_name(file_name: Column) -> Column:
    """A file's product: without ``.md``, a date and a small number at its end."""
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(file_name, r"\.md$", ""), r"_\d{8}$", ""), r"_\d{1,2}$", "")


def slices(text: Column, size: int = 40) -> Column:
    """A text in pieces of ``size`` characters."""
    n = F.ceil(F.length(text) / size).cast("int")
    return F.when(n > 0, F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.substring(text, i * size + 1, F.lit(size)))).otherwise(F.array().cast("array<string>"))


def jaro(a: str, b: str) -> float:
    """Jaro similarity with half-transpositions counted as fractions."""
    if a == b:
        return 1.0
    if not a or not b:
        return 0.0
    window = max(len(a), len(b)) // 2 - 1
    if window < 0:
        return 0.0
    taken, left = [False] * len(b), []
    for i, c in enumerate(a):
        for j in range(max(0, i - window), min(len(b), i + window + 1)):
            if not taken[j] and b[j] == c:
                taken[j] = True
                left.append(c)
                break
    if not left:
        return 0.0
    right = [c for c, t in zip(b, taken, strict=True) if t]
    m = len(left)
    moved = sum(x != y for x, y in zip(left, right, strict=True)) / 2
    return (m / len(a) + m / len(b) + (m - moved) / m) / 3


def jaro_winkler_of(a: str, b: str, scale: float = 0.1) -> float:
    """Jaro similarity raised by up to four equal first characters."""
    base = jaro(a, b)
    prefix = 0
    for x, y in zip(a[:4], b[:4], strict=False):
        if x != y:
            break
        prefix += 1
    return base + prefix * scale * (1 - base)


@F.pandas_udf(DoubleType())
def jaro_winkler(a: pd.Series, b: pd.Series) -> pd.Series:
    """Jaro-Winkler similarity of two columns; null if either is."""
    return pd.Series([None if x is None or y is None else jaro_winkler_of(x, y) for x, y in zip(a, b, strict=True)], dtype="float64")
