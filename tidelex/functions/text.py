"""Text as Column expressions. Java's \\s and \\w are ASCII, so patterns that mean all white space carry (?U)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Patterns that results depend on.
SENTENCE_END = r"""(?U)(?<=[.!?…])\s+(?=[A-Z"'(])"""
#: Possessive after the third link, so that Java goes on in a loop and not by recursion.
NAV_RUN = r"(?U)(?:[^\s][^|»·]{0,45}?\s*(?:\s[-–—|·]\s|»)\s*){3}(?:[^\s][^|»·]{0,45}?\s*(?:\s[-–—|·]\s|»)\s*)*+"
NAV_SEPARATOR = r"(?U)\s[-–—|·]\s|»"
TERMINAL = "[.!?…]"
URL_LIKE = r"(?i)^https?://|^/|\.(?:png|jpg|jpeg|gif|webp|svg|mp4|woff|ico)(?:\?|$)"
#: Chrome that old pages carry at the start of their text; any of it may follow any other.
CHROME_BEFORE = [
    r"Hello\.?\s*Sign in[^.]*\.?\s*",
    r"Your Amazon Careers Profile\s*Sign in to existing careers profile\s*",
    r"New customer\?\s*Start here\s*\.?\s*",
    r"FREE (?:Two-Day|2-Day) Shipping[^.]*\.?\s*",
    r"Save on everything you need for college[^.]*\.?\s*",
    r"Sponsored by [^.]+\s*",
    r"Your Amazon\.com\s+",
    r"(?:Today's Deals|Gifts & Wish Lists|Gift Cards|Your Account)\s*(?:\|\s*Help\s*)?",
    r"(?:Search for Jobs(?:\s+at Amazon)?|Apply Now\s*›|Careers Home|About Amazon|Amazon Values|Inside Amazon|Locations|Benefits|University Recruiting(?:\s+Home)?|Military Recruiting(?:\s+Home)?|How to Apply|FAQ|Disability Accommodations|E-Verify|Code Ninjas|Amazonians on Amazon|Careers at Amazon)[›|\s]*",
    r"com\s+",
]
CHROME_START = r"(?i)^(?:Hello\.?\s*Sign in|New customer\?|FREE (?:Two-Day|2-Day)|Your Amazon\.com|Today's Deals|Sponsored by|com\b)"
MISSION = [
    "At Amazon,", r"Work hard\. Have fun\.", "Build your future with Amazon", "Invent the future with Amazon", "Our mission is to be", "We're a company of pioneers", "Come build the future", "Every Amazonian,",
    "Can one conversation change the world", "At Google, our strategy", "Enjoy what you do", "Let's work together", "Google's mission is",
]
NAV_WORDS = r"(?i)\b(?:sign in|today's deals|gift cards|your account|apply now|careers home|careers at amazon|university recruiting)\b"
MENU_LEFT = r"(?i)\b(?:How to Apply|FAQ|Careers Home|Help)\b"
CHROME_BEHIND = [
    r"Amazon\.com Home\s*\|\s*Directory of All Stores", r"Your Recent History\s*\(", r"›\s*View and edit your browsing history", "Amazon ranked America's most reputable company!",
    "After viewing product detail pages", "Conditions of Use Privacy Notice", "Canada China France Germany Italy Japan United Kingdom",
]
LINK_CONTENT = r"(?i)(teams?|students?|benefits|culture|life|locations?|how-we|diversity|belonging|perks|values|mission|intern|grad|veterans|disability|accessibility|care-for|hiring|about)"
LINK_JOB = r"(?i)(/jobs/results|/jobs/\d|/job/\d|/positions?/|joblisting|search\?|/api/|\.pdf$|\.jpg$|\.png$|\.css$|\.js$|mailto:|javascript:)"
_BEFORE = "(?iU)^(?:" + "|".join(CHROME_BEFORE) + ")++"
_MISSION = "(?:" + "|".join(MISSION) + ")"
_BEHIND = r"(?iU)\s*(?:" + "|".join(CHROME_BEHIND) + ").*$"
MIN_SENTENCE_WORDS = 6
MIN_ENGLISH_CHARS = 40


def squeeze(text: Column) -> Column:
    """White space runs to one blank, none at the ends."""
    return F.trim(F.regexp_replace(text, r"(?U)\s+", " "))


def words(text: Column) -> Column:
    return F.filter(F.split(squeeze(text), " "), lambda w: w != "")


def word_count(text: Column) -> Column:
    return F.size(words(text))


def strip_nav_runs(text: Column) -> Column:
    """Without runs of three or more short fragments joined by separators; texts with fewer separators aren't searched."""
    some = F.regexp_count(text, F.lit(NAV_SEPARATOR)) >= 3
    return squeeze(F.when(some, F.regexp_replace(text, NAV_RUN, " ")).otherwise(text))


def without_chrome(text: Column) -> Column:
    """A squeezed text without the site chrome before and behind what it says.

    Chrome before it is any number of ``CHROME_BEFORE`` in a row. What is left is cut at the first ``MISSION`` phrase in it if the
    words before that look like a menu. Whatever follows the first of ``CHROME_BEHIND`` is dropped.
    """
    begun = squeeze(F.when(text.rlike(_BEFORE), F.regexp_replace(text, _BEFORE, "")).otherwise(text))

    def from_mission(t: Column) -> Column:
        parts = F.split(t, f"(?i)(?={_MISSION})", 2)

        def cut(p: Column) -> Column:
            head = F.element_at(p, 1)
            hits = F.regexp_count(head, F.lit(NAV_WORDS))
            menu = t.rlike(CHROME_START) | head.rlike(MENU_LEFT) | (hits >= 2) | ((hits >= 1) & (word_count(head) >= 8))
            return F.when((F.size(p) > 1) & ~t.rlike(f"(?i)^{_MISSION}") & menu, F.trim(F.element_at(p, -1))).otherwise(t)

        return F.when(t.rlike(f"(?i){_MISSION}"), let(parts, cut)).otherwise(t)

    return let(begun, lambda t: squeeze(F.regexp_replace(from_mission(t), _BEHIND, "")))


def is_prose(text: Column) -> Column:
    """Whether a string of an application's state reads like prose: words enough, mostly letters, no address and no JSON."""

    def judged(t: Column) -> Column:
        letters = F.length(F.regexp_replace(t, r"(?U)[^\p{L}\s]", ""))
        return (F.length(t) >= 25) & (word_count(t) >= 10) & ~t.rlike(URL_LIKE) & ~t.rlike(r"^[{\[]") & (letters >= 0.75 * F.length(t)) & t.rlike("[A-Za-z]{3,}")

    return let(squeeze(text), judged)


def is_link_list(text: Column) -> Column:
    """Six words or more, no sentence end, and 60 % of the words that start with a letter start with a capital."""
    alpha = F.filter(words(text), lambda w: w.rlike(r"^\p{L}"))
    capital = F.filter(alpha, lambda w: w.rlike(r"^\p{Lu}"))
    return ~text.rlike(TERMINAL) & (word_count(text) >= 6) & (F.size(alpha) > 0) & (F.size(capital) >= F.size(alpha) * 0.6)


def sentences(text: Column, min_words: int = MIN_SENTENCE_WORDS) -> Column:
    """Sentences of at least ``min_words`` words; the whole text if none is left and it is long enough."""
    clean = squeeze(text)
    long = lambda s: F.size(F.split(s, " ")) >= min_words
    whole = F.when(long(clean), F.array(clean)).otherwise(F.array().cast("array<string>"))
    return let(F.filter(F.transform(F.split(clean, SENTENCE_END), lambda s: F.trim(s)), long), lambda kept: F.when(F.size(kept) > 0, kept).otherwise(whole))


def short_id(*parts: Column, length: int = 16) -> Column:
    """The first hex digits of the SHA-256 of the parts joined by ``|``."""
    return F.substring(F.sha2(F.concat_ws("|", *[p.cast("string") for p in parts]), 256), 1, length)


def let(value: Column, fn) -> Column:
    """fn(value) with the value computed once: a lambda would compute an outer expression anew for each element."""
    return F.element_at(F.transform(F.array(value), fn), 1)


def ngrams(text: Column, n: int = 5) -> Column:
    """Distinct sequences of n words ([a-z0-9']+ of the lower-cased text)."""

    def of(w: Column) -> Column:
        last = F.size(w) - n
        at = F.when(last >= 0, F.sequence(F.lit(0), last)).otherwise(F.array().cast("array<int>"))
        return F.array_distinct(F.transform(at, lambda i: F.array_join(F.slice(w, i + 1, n), " ")))

    return let(F.regexp_extract_all(F.lower(text), F.lit(r"([a-z0-9']+)"), 1), of)


def ascii_ratio(text: Column) -> Column:
    size = F.length(text)
    return F.when(size == 0, F.lit(1.0)).otherwise(F.length(F.regexp_replace(text, r"[^\x00-\x7F]", "")) / size)


# Frequent words by which the vote tells English from the other fixture languages.
STOP_WORDS = {
    "en": ["the", "and", "of", "to", "in", "is", "that", "for", "it", "with", "on", "this", "are", "was"],
    "de": ["der", "die", "und", "das", "ein", "nicht", "mit", "sich", "auf", "von", "zu", "den"],
    "fr": ["le", "la", "les", "et", "des", "une", "un", "du", "que", "dans", "est", "pour"],
    "es": ["el", "los", "las", "una", "que", "para", "con", "por", "del", "al", "y", "es"],
}


def language_votes(words: Column, language: str) -> Column:
    """How many of the lower-cased words are frequent ones of a language."""
    return F.size(F.filter(words, lambda w: w.isin(STOP_WORDS[language])))


def is_english(text: Column, min_chars: int = MIN_ENGLISH_CHARS) -> Column:
    """Short texts pass; below 85 % ASCII fails; then English needs no fewer stop words than any other language.

    The vote stands in for a statistical detector; where no stop word occurs, 92 % ASCII decides.
    """
    t = F.trim(text)
    listed = ["en", *[x for x in STOP_WORDS if x != "en"]]
    votes = let(F.split(F.lower(squeeze(t)), " "), lambda w: F.array(*[language_votes(w, x) for x in listed]))  # words once for all languages
    voted = let(votes, lambda v: F.when(F.array_max(v) == 0, ascii_ratio(t) >= 0.92).otherwise(v[0] == F.array_max(v)))
    return F.when(F.length(t) < min_chars, F.lit(True)).when(ascii_ratio(t) < 0.85, F.lit(False)).otherwise(voted)


def is_content_url(url: Column) -> Column:
    return ~url.rlike(LINK_JOB) & url.rlike(LINK_CONTENT)


def host_of(url: Column) -> Column:
    return F.regexp_replace(F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1)), r"^www\.", "")


def on_hosts(url: Column, hosts: Column) -> Column:
    """Whether the URL's host is one of ``hosts`` or below one."""
    host = host_of(url)
    return F.exists(hosts, lambda h: (host == h) | host.endswith(F.concat(F.lit("."), h)))


def bare_url(url: Column) -> Column:
    """Without query and fragment."""
    return F.regexp_replace(url, r"[?#].*$", "")


def contains_any(text: Column, terms: list[str]) -> Column:
    return reduce(lambda a, b: a | b, [F.contains(text, F.lit(t)) for t in terms]) if terms else F.lit(False)


# Sections of annual filings; of several patterns of one section the first that is found counts.
HUMAN_CAPITAL = [
    r"(?is)Culture and Workforce(.*?)(?:Government Regulation|Intellectual Property|Available Information|ITEM\s*1A)",
    r"(?is)Human Capital Management(.*?)(?:Government Regulation|Intellectual Property|Available Information|ITEM\s*1A)",
    r"(?is)Human Capital Resources(.*?)(?:Government Regulation|Intellectual Property|Available Information|ITEM\s*1A)",
    r"(?is)Human Capital(.*?)(?:Available Information|Government Regulation|Intellectual Property|ITEM\s*1A)",
]
RISK_FACTORS = r"(?is)ITEM\s*1A\.?\s*RISK\s*FACTORS(.*?)(?:ITEM\s*1B\.|ITEM\s*2\.|ITEM\s*3\.)"
BUSINESS = r"(?is)ITEM\s*1\.?\s*BUSINESS(.*?)(?:ITEM\s*1A\.|ITEM\s*2\.)"


def filing_sections(text: Column, cap: int | None = 12_000) -> Column:
    """array<struct<section,text>> of a filing's plain text: Human Capital and Risk Factors, or Business if it has neither; each cut to ``cap`` characters, whole without one."""
    flat = F.regexp_replace(text, r"(?U)\s+", " ")
    whole = lambda p: F.trim(F.regexp_extract(flat, p, 1))
    found = lambda p: F.when(flat.rlike(p), whole(p) if cap is None else F.substring(whole(p), 1, cap))
    one = lambda name, value: F.struct(F.lit(name).alias("section"), value.alias("text"))
    people, risks = F.coalesce(*[found(p) for p in HUMAN_CAPITAL]), found(RISK_FACTORS)
    business = F.when(people.isNull() & risks.isNull(), found(BUSINESS))
    return F.filter(F.array(one("Human Capital", people), one("Risk Factors", risks), one("Business", business)), lambda x: x["text"].isNotNull())
