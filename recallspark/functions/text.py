"""Text functions as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Very frequent words of English and Russian, which carry no meaning for ranking.
STOP_WORDS = (
    "a about above after again all also am an and any are as at be because been before being below between both but by can could did do does "
    "doing down during each few for from further had has have having he her here hers him his how i if in into is it its just me more most my no "
    "nor not of off on once only or other our out over own same she should so some such than that the their them then there these they this those "
    "through to too under until up very was we were what when where which while who whom why will with would you your "
    "и в во не что он на я с со как а то все она так его но да ты к у же вы за бы по только ее мне было вот от меня еще нет о из ему теперь когда "
    "даже ну вдруг ли если уже или ни быть был него до вас нибудь опять уж вам ведь там потом себя ничего ей может они тут где есть надо ней для мы "
    "тебя их чем была сам чтоб без будто чего раз тоже себе под будет ж тогда кто этот"
).split()


def words(text: Column) -> Column:
    """Lower-case runs of letters, ASCII digits and underscores."""
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(r"[\p{L}0-9_]+"), 0)


def tokens(text: Column, stem=None) -> Column:
    """Words of over two letters that aren't stop words; ``stem`` maps an array of words to their stems."""
    kept = F.filter(words(text), lambda w: (F.length(w) > 2) & ~w.isin(*STOP_WORDS))
    return kept if stem is None else F.filter(stem(kept), lambda w: F.length(w) > 2)


# Letters that upper case makes several of, and the one capital that each has (sharp s, Greek with iota subscript).
_SUBSCRIPTS = [chr(i + j) for i in (0x1F80, 0x1F90, 0x1FA0) for j in range(8)]
_SEVERAL = "ß" + "".join(_SUBSCRIPTS) + "ᾳῃῳ"
_CAPITAL = "ẞ" + "".join(chr(ord(c) + 8) for c in _SUBSCRIPTS) + "ᾼῌῼ"


def capitalized(word: Column) -> Column:
    """The word with its first letter as one capital, as SQL's ``upper`` makes it letter by letter; a letter without a capital of its own stays."""
    first = F.left(word, F.lit(1))
    upper = F.when(F.length(F.upper(first)) == 1, F.upper(first)).otherwise(F.translate(first, _SEVERAL, _CAPITAL))
    return F.concat(upper, F.substr(word, F.lit(2), F.length(word)))


def plain_words(text: Column) -> Column:
    """Distinct lower-case words of two characters or more, split at anything but letters and numbers."""
    return F.array_distinct(F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+"), lambda w: F.length(w) >= 2))


def ascii_words(text: Column) -> Column:
    """Words of over two characters after everything but ASCII letters, digits and white space is dropped."""
    return F.filter(F.split(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"[^a-z0-9\s]+", ""), r"\s+"), lambda w: F.length(w) > 2)


def jaccard(a: Column, b: Column) -> Column:
    """Common share of two arrays taken as sets; 0 if either is empty."""
    both, either = F.size(F.array_intersect(a, b)), F.size(F.array_union(a, b))
    return F.when((F.size(a) > 0) & (F.size(b) > 0), both / either).otherwise(F.lit(0.0))


def entity_key(name: Column) -> Column:
    """Lower case, without possessive 's, white space as single blanks."""
    bare = F.regexp_replace(F.lower(name), "['’]s(?![A-Za-z0-9_])", "")
    return F.trim(F.regexp_replace(bare, r"\s+", " "))


def context_key(name: Column) -> Column:
    """Lower case with white space as underscores: the key form of entity contexts."""
    return F.trim(F.regexp_replace(F.lower(name), r"\s+", "_"))


def has_phrase(text: Column, phrase: Column) -> Column:
    """Whether a phrase of several words stands in the text; punctuation and runs of white space don't matter."""

    def flat(x: Column) -> Column:
        return F.trim(F.regexp_replace(F.regexp_replace(F.lower(x), r"\s+", " "), r"[^\p{L}\p{N}\s]", ""))

    return (F.instr(F.trim(phrase), " ") > 0) & (F.length(flat(phrase)) > 0) & F.contains(flat(text), flat(phrase))


# Tags in which models leave their reasoning.
THINK_TAGS = "think|thinking|thought|reasoning|reflection|scratchpad"


def strip_thinking(text: Column) -> Column:
    """Text without paired reasoning tags in angle or square brackets, starred thoughts, and what precedes a closing tag without an opening one."""
    out = F.regexp_replace(text, rf"(?is)<({THINK_TAGS})(\s[^>]*)?>.*?</\1>", "")
    out = F.regexp_replace(out, rf"(?is)\[({THINK_TAGS})\].*?\[/\1\]", "")
    out = F.regexp_replace(out, r"(?is)\*thinks?:.*?\*", "")
    out = F.regexp_replace(out, rf"(?is)^.*</({THINK_TAGS})>", "")
    return F.trim(out)


def strip_fences(text: Column) -> Column:
    """The inside of a Markdown code fence, or the text without a fence that is only opened or only closed."""
    out = F.regexp_replace(F.trim(text), r"(?s)^```[A-Za-z0-9]*\s*\n?(.*?)\n?\s*```$", "$1")
    return F.trim(F.regexp_replace(F.regexp_replace(out, r"^```[A-Za-z0-9]*\s*", ""), r"\s*```$", ""))


def clean_controls(text: Column) -> Column:
    """Without control characters but tab and line ends; U+2028 and U+2029 become line ends."""
    return F.regexp_replace(F.regexp_replace(text, "[\\u2028\\u2029]", "\n"), r"[\x00-\x08\x0B\x0C\x0E-\x1F\x7F]", "")


def join_concatenated(text: Column) -> Column:
    """Strings written as ``"a" + "b"`` become one string."""
    return F.regexp_replace(text, r'"\s*\+\s*"', "")


def strip_ids(text: Column) -> Column:
    """Without identifiers such as (msg_12) or [ev_3] that leak from prompts."""
    return F.trim(F.regexp_replace(F.regexp_replace(text, r"\s*[\[(](?:msg|ev|mem|ref|event)_[A-Za-z0-9_]+(?:,\s*(?:msg|ev|mem|ref|event)_[A-Za-z0-9_]+)*[\])]", ""), r"\s{2,}", " "))


def leading_id(text: Column) -> Column:
    """The id of a text that starts with ``[ID:x]``; null without one."""
    return F.nullif(F.regexp_extract(text, r"^\[ID:([^\]]+)\]", 1), F.lit(""))


def truncate(text: Column, limit: int) -> Column:
    return F.when(F.length(text) > limit, F.concat(F.substring(text, 1, limit - 3), F.lit("..."))).otherwise(text)


def escape_html(text: Column) -> Column:
    for plain, safe in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#39;")):
        text = F.replace(text, F.lit(plain), F.lit(safe))
    return text


def stars(importance: Column) -> Column:
    """Five stars, as many filled as the importance (3 where it is missing or 0, at most 5)."""
    n = F.least(F.lit(5), F.greatest(F.lit(0), F.coalesce(F.nullif(importance, F.lit(0)), F.lit(3)))).cast("int")
    return F.concat(F.repeat(F.lit("★"), n), F.repeat(F.lit("☆"), 5 - n))


def token_count(text: Column) -> Column:
    """Estimated model tokens: a quarter of the characters, rounded up."""
    return F.ceil(F.length(F.coalesce(text, F.lit(""))) / 4).cast("long")


def mostly_foreign(text: Column) -> Column:
    """Whether letters outside the Latin script number over half the Latin ones, in the first 2,000 characters."""
    text = F.left(text, F.lit(2000))
    latin = F.regexp_count(text, F.lit(r"\p{IsLatin}"))
    return (F.regexp_count(text, F.lit(r"\p{L}")) - latin) > 0.5 * latin


def truncated_json(text: Column) -> Column:
    """Whether more brackets are opened than closed."""
    return F.regexp_count(text, F.lit(r"[\[{]")) > F.regexp_count(text, F.lit(r"[\]}]"))


# Requests for the wide picture, and what tells a passing state. English and Russian.
MACRO_INTENT = r"(?i)(summarize|recap|story so far|overall|time skip|what has happened|lately|dynamic|вкратце|что было|расскажи|итог|наполни|напомни)"
TRANSIENT = [
    r"\b(chose|decided|picked|opted)\s+to\s+wear\b",
    r"\b(wearing|wore|dressed\s+in|put\s+on)\s+(a|the|some|their)\s+(shirt|dress|jacket|coat|hat|shoes|boots|outfit|sweater|hoodie|jeans|pants|skirt|suit|tie|glasses|accessor)",
    r"\b(changed|switched)\s+(into|out\s+of|their)\s+(clothes|outfit|attire)\b",
    r"\bdoing\s+(their|her|his|its)\s+(hair|makeup|nails)\b",
    r"\b(glanced|looked|peeked|stared)\s+(at|out|around|toward|towards|into)\b",
    r"\b(noticed|spotted|caught\s+sight\s+of)\s+(a|the|some)\b",
    r"\b(gazed|stared)\s+(at|out|into)\b.*\b(seeing|watching|observing)\b",
    r"\b(sat\s+down|stood\s+up|leaned\s+(against|on)|paced|wandered\s+(around|over|to))\b",
    r"\b(stretched|yawned|sighed|shrugged|crossed\s+(their|her|his|its)\s+(arms|legs))\b",
    r"\b(felt|feeling)\s+(a\s+bit|slightly|momentarily|suddenly|briefly|a\s+little)\s+(tired|hungry|thirsty|cold|warm|bored|annoyed|distracted)\b",
    r"\b(woke\s+up|went\s+to\s+(sleep|bed)|dozed\s+off|napped)\b(?!.*(?:nightmare|dreamt|dreamed\s+(of|about)|couldn['']t\s+sleep|insomnia))",
    r"\b(grabbed|ordered|poured|made|brewed|fixed)\s+(a|some|the|their)\s+(coffee|tea|drink|snack|sandwich|meal|breakfast|lunch|dinner)\b",
    r"\b(ate|drank|sipped|finished|nibbled|munched)\s+(a|the|some|their)\b",
    r"\b(brushed\s+(their|her|his|its)\s+(hair|teeth)|took\s+a\s+shower|took\s+a\s+bath|washed\s+(their|her|his|its)\s+(face|hands))\b",
    r"\b(smiled|nodded|chuckled|laughed|grinned|winked|rolled\s+(their|her|his|its)\s+eyes)\b",
    r"\b(it\s+was\s+(a\s+bit|slightly|kind\s+of)\s+(cold|warm|hot|cool|breezy|windy|rainy|sunny|cloudy))\b",
    r"\b(the\s+(sun|moon)\s+(was|is)\s+(shining|out|bright))\b",
]


def macro_intent(text: Column) -> Column:
    return text.rlike(MACRO_INTENT)


def looks_transient(text: Column) -> Column:
    found = F.lit(False)
    for pattern in TRANSIENT:
        found = found | text.rlike("(?i)" + pattern)
    return F.coalesce(found, F.lit(False))


def dossier_key(name: Column) -> Column:
    """As ``entity_key``, and without any apostrophe or opening quote that is left."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(name), "['’‘]s(?![A-Za-z0-9_])|[‘]", ""), r"\s+", " "))


def name_stems(name: Column, stem) -> Column:
    """Distinct stems of a name's words of letters and digits, stop words included; of two letters or more."""
    found = F.regexp_extract_all(F.lower(F.coalesce(name, F.lit(""))), F.lit(r"[\p{L}0-9]+"), 0)
    return F.array_distinct(F.filter(stem(found), lambda w: F.length(w) >= 2))


def witnesses(names: Column) -> Column:
    return F.when(F.size(names) > 0, F.concat(F.lit("Witnesses: "), F.array_join(names, ", "))).otherwise("")


def emotion_source(first: Column, last: Column) -> Column:
    """(from message n) or (from messages n-m)."""
    span = F.concat(first.cast("string"), F.when(first == last, "").otherwise(F.concat(F.lit("-"), last.cast("string"))))
    return F.when(first.isNotNull(), F.concat(F.when(first == last, "(from message ").otherwise("(from messages "), span, F.lit(")"))).otherwise("")


def day(millis: Column) -> Column:
    """The date of a time in milliseconds, or ``Unknown``."""
    return F.coalesce(F.date_format(F.timestamp_millis(F.nullif(millis, F.lit(0))), "yyyy-MM-dd"), F.lit("Unknown"))


def newest_lines(text: Column, n: int = 10) -> Column:
    """The last ``n`` lines that aren't blank, newest first."""
    lines = F.filter(F.split(F.coalesce(text, F.lit("")), "\n"), lambda x: F.length(F.trim(x)) > 0)
    return F.reverse(F.slice(lines, F.greatest(F.lit(1), F.size(lines) - n + 1), F.lit(n)))


def examples(rows, language: str, column: str = "example"):
    """The few-shot examples of a language (or of all, ``auto``), as one text in their order; the rows (lang, ord, ...) are few by nature."""
    kept = rows if language == "auto" else rows.filter(F.col("lang") == language)
    return kept.agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ord", column))), lambda x: x[column]), "\n\n").alias("examples"))


def half_up(x: Column) -> Column:
    """Rounded to the nearest integer, halves upwards."""
    return F.floor(x + 0.5)


def two_places(x: Column) -> Column:
    return F.floor(x * 100 + 0.5) / 100
