"""Classification by ordered rules. A cascade is data: (label, condition) pairs of which the first that holds wins."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidelex.functions.text import CHROME_START, contains_any, word_count


@dataclass(frozen=True)
class Rule:
    """Holds if one term of every list in ``all_of`` occurs in the lower-cased text, none of ``none_of`` and, if given, ``pattern`` matches the text as it is."""

    label: str
    all_of: tuple[tuple[str, ...], ...] = ()
    none_of: tuple[str, ...] = ()
    pattern: str | None = None
    negate: bool = field(default=False)

    def condition(self, text: Column) -> Column:
        low = F.lower(text)
        out = F.lit(True)
        for terms in self.all_of:
            out = out & contains_any(low, list(terms))
        if self.none_of:
            out = out & ~contains_any(low, list(self.none_of))
        if self.pattern:
            out = out & text.rlike(self.pattern)
        return ~out if self.negate else out


def cascade(text: Column, rules: list[Rule], default: str) -> Column:
    out = None
    for rule in rules:
        out = (F if out is None else out).when(rule.condition(text), F.lit(rule.label))
    return F.lit(default) if out is None else F.when(text.isNotNull(), out.otherwise(F.lit(default)))


# Registers and stances with the terms that decide them.
REGISTERS = ["explicit_demographic", "structural_process", "aspirational_vague", "belonging_culture", "meritocracy", "civilizational_mission", "absent"]
ACTIVE_REGISTERS = REGISTERS[:4]
COUNTER_REGISTERS = ["meritocracy", "civilizational_mission"]
STANCES = ["affirming_dei", "neutral", "mission_focus_apolitical", "performance_elite", "civilizational_mission"]
CIVILIZATIONAL = r"(?i)\b(?:future of the west|the west'?s most important|western (?:tech )?institutions|warfighters?|battlefield|build with consequence|tinker at the margins|technological republic|most important institutions|empower the world'?s most important institutions)\b"
_OUTCOMES = ("judged by outcomes", "work will speak for itself", "uncompromising engineering", "best and the brightest", "rigorous hiring standards")
_APOLITICAL = ("social or political activism", "refuge from division", "unrelated to our mission while at work", "don't engage in social", "do not engage in social")
_TOPIC = ("divers", "inclus", "belong", "equity", "represent", "underrepresented", "bias", "merit", "whole self", "women in tech", "girl geek", "scholarship for women")
_GROUPS = ("black", "latinx", "hispanic", "lgbtq", "veteran", "disabilit")
_TARGETS = ("representation", "target", "percent", "%")
_CARE = ("breast cancer", "mammograph", "patient", "screening")
REGISTER_RULES = [
    Rule("civilizational_mission", pattern=CIVILIZATIONAL),
    Rule("meritocracy", (_OUTCOMES,)),
    Rule("meritocracy", (_APOLITICAL,)),
    Rule("absent", (_TOPIC,), negate=True),
    Rule("explicit_demographic", (_GROUPS, (*_TARGETS, "workforce data", "increase"))),
    Rule("aspirational_vague", (_GROUPS,)),
    Rule("aspirational_vague", (("women",), ("lean in", "partner", "encouragement", "support to achieve", "scholarship", "girl geek")), _CARE),
    Rule("explicit_demographic", (("women",), _TARGETS), _CARE),
    Rule("structural_process", (("audit", "structured interview", "pay gap", "promotion process", "bias training"),)),
    Rule("meritocracy", (("regardless of background", "same criteria", "don't lower our standards", "best people, period", "identity politics", "don't do dei", "not identity", "meritocracy", "merit, not"),)),
    Rule("belonging_culture", (("whole self", "bring your", "culture of", "feel welcome"),)),
]
STANCE_RULES = [
    Rule("civilizational_mission", pattern=CIVILIZATIONAL),
    Rule("mission_focus_apolitical", (("political activism", "refuge from division", "apolitical", "unrelated to our mission while at work", "social or political", "don't engage in social"),)),
    Rule("performance_elite", (("judged by outcomes", "work will speak for itself", "uncompromising engineering", "championship team", "generous severance", "not a family", "stunning colleagues", "high expectations for performance", "faint of heart", "dream team"),)),
    Rule("affirming_dei", (("scholarship for women", "girl geek", "women in technology", "belonging", "whole self", "representation", "underrepresented", "commitment to diversity"),)),
    Rule("affirming_dei", (("inclusion",), ("diversity", "belonging", "equity"))),
]
NAV_TOKENS = r"(?i)\b(?:sign in|today's deals|gift cards|your account|start here|apply now|careers home|browsing history|sponsored by)\b"
LOCATION_HEADING = r"^[A-Z][\w\s.'-]+,\s*(?:Washington|California|Texas|Spain|China|India|Kentucky|UK|Germany|France|Ireland|Australia|Japan|Brazil|Mexico|Ontario|British Columbia)\s*$"
LOCATION_BODY = r"(?i)\b(?:population|metropolitan area|capital of|located on|office is located|great place to (?:work|live))\b"


def register(text: Column) -> Column:
    return cascade(text, REGISTER_RULES, "aspirational_vague")


def stance(text: Column) -> Column:
    return cascade(text, STANCE_RULES, "neutral")


def coerce(label: Column, allowed: list[str], default: str) -> Column:
    """A label from outside, or the default where it is none of ``allowed``."""
    return F.when(label.isin(allowed), label).otherwise(F.lit(default))


def relabelled(chunks: DataFrame, nav_tokens: str = NAV_TOKENS, chrome: str = CHROME_START, low: float = 0.08, high: float = 0.12, watched: str = "mission_brand", junk: str = "navigation_junk") -> DataFrame:
    """chunks (text, heading, label) with ``new_label`` and ``reason`` (null where the label stays)."""
    n = word_count(F.col("text"))
    share = F.when(n == 0, F.lit(0.0)).otherwise(F.regexp_count("text", F.lit(nav_tokens)) / n)
    place = F.trim(F.coalesce("heading", F.lit(""))).rlike(LOCATION_HEADING) & F.col("text").rlike(LOCATION_BODY)
    reason = F.when(F.col("text").rlike(chrome) & (share > low), "nav chrome prefix").when(share > high, "high nav token fraction").when(place, "location page")
    reason = F.when(F.col("label") == watched, reason)
    return chunks.withColumn("reason", reason).withColumn("new_label", F.when(F.col("reason").isNotNull(), F.lit(junk)).otherwise(F.col("label")))


def change_log(relabels: DataFrame, id_col: str = "chunk_id") -> DataFrame:
    return relabels.where(F.col("new_label") != F.col("label")).select(id_col, F.col("label").alias("from"), F.col("new_label").alias("to"), "reason")


def era(year: Column) -> Column:
    return F.when(year < 2015, "early").when(year < 2020, "middle").otherwise("late")


# Stances of quotable texts, with the pattern that finds them and the sources that they are looked for in.
PERFORMANCE_STANCES = [
    ("work_hard_play_hard", "Work hard, play hard", r"(?is)work hard.*(?:play hard|have fun|make history)|play here.*dream here", ("careers",)),
    ("raise_the_bar", "Raise the bar", r"(?i)raise the bar|relentlessly high standards|unreasonably high", ("careers", "investor")),
    ("flexible_autonomy", "Trust over hours", r"(?i)no set hours|whatever schedule suits you", ("careers",)),
    ("move_fast", "Move fast", r"(?i)move fast|milliseconds and terabytes|immediate impact", ("careers",)),
    ("mission_intensity", "Mission intensity", r"(?i)future of the West|mission-critical|optimize for impact|hardest problems.*smartest", ("careers",)),
    ("not_a_family", "Not a family", r"(?i)not a family|dream team|stunning colleagues|keeper test|adequate performance", ("careers",)),
    ("high_performer", "High-performer ultimatum", r"(?i)outsized reward|generous severance|championship team|faint of heart|pushed beyond what you think", ("careers",)),
    ("mission_focused", "Mission-focused", r"(?i)mission.?focused|apolitical|political activism|refuge from division|stay focused on making progress toward the mission", ("careers",)),
    ("investor_tone", "Investor-facing", r"(?i)perform at a high level|competition for qualified personnel|work hard to create|talented personnel|high.?performing", ("investor",)),
]
DEI_STANCES = [
    ("explicit_inclusion", "Explicit inclusion", r"(?i)\b(?:diversity|inclusion|belonging|equity|underrepresented|representation|accessibility)\b", ("careers", "investor")),
    ("apolitical", "Apolitical workplace", r"(?i)political activism|refuge from division|apolitical|unrelated to our mission while at work", ("careers", "investor")),
    ("not_a_family", "Not a family", r"(?i)not a family|professional sports team|stunning colleagues", ("careers", "investor")),
    ("meritocracy", "Meritocracy rhetoric", r"(?i)meritocracy|best idea wins|best person|A players|top talent", ("careers", "investor")),
    ("civilizational_mission", "Civilizational mission", r"(?i)future of the West|West's most important|mission-critical outcomes|judged by outcomes|uncompromising engineering|build with consequence", ("careers", "investor")),
]
#: What distinctive phrasing adds to a score: stance, pattern, bonus; the first that is found counts.
BONUS = [("mission_intensity", r"(?i)future of the West|optimize for impact", 0.08), ("mission_intensity", r"(?i)hardest problems.*smartest", 0.05)]
INCLUSION_TERMS = r"(?i)\b(?:diversity|inclusion|belonging|equity|underrepresented|black|latinx|hispanic|women|lgbtq|disability|accessibility|bias|representation|affirmative)\w*\b"


def stance_hits(quotes: DataFrame, stances: list[tuple], text: str = "text", source: str = "source") -> DataFrame:
    """The quotes with each stance whose pattern is found in them and that their source is looked through for."""
    found = [F.when(F.col(text).rlike(pattern) & F.col(source).isin(*sources), F.struct(F.lit(name).alias("stance"), F.lit(label).alias("stance_label"))) for name, label, pattern, sources in stances]
    return quotes.withColumn("__hit", F.explode(F.filter(F.array(*found), lambda x: x.isNotNull()))).select(*quotes.columns, "__hit.*")


def with_bonus(score: Column, stance: Column, text: Column) -> Column:
    out = F.lit(0.0)
    for name, pattern, bonus in reversed(BONUS):
        out = F.when((stance == name) & text.rlike(pattern), F.lit(bonus)).otherwise(out)
    return score + out
