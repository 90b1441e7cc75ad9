"""Tolerant name matching: case, spaces, underscores, hyphens and English plurals."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# English: words that are their own singular, and plurals that no ending explains.
UNCHANGED = (
    "alias", "atlas", "bias", "canvas", "chaos", "cosmos", "data", "diabetes", "equipment", "fish", "gas", "headquarters", "information", "lens", "media",
    "money", "news", "rice", "series", "sheep", "species",
)
IRREGULAR = {
    "bacteria": "bacterium", "children": "child", "criteria": "criterion", "dice": "die", "feet": "foot", "geese": "goose", "lice": "louse", "men": "man", "mice": "mouse",
    "movies": "movie", "oxen": "ox", "people": "person", "phenomena": "phenomenon", "quizzes": "quiz", "teeth": "tooth", "women": "woman",
}
# Where a word of a name begins: after a separator, or at an inner capital.
_START = r"(?:^|[ _-]|(?-i:(?<=[a-z0-9])(?=[A-Z])))"
# Ordered endings (pattern, what replaces them behind the captured part); the first match decides.
SUFFIX_RULES = (
    (r"(?i)(alias|atlas|bias|bonus|bus|campus|canvas|census|chorus|corpus|focus|gas|genius|iris|lens|minus|plus|radius|status|surplus|virus)es$", ""),
    (rf"(?i)({_START}(?:emu|gnu|guru|haiku|menu|tofu|tutu))s$", ""),
    (rf"(?i)((?:avalan|ca|cli|cre|heada|mousta|musta|ni|psy|qui|tootha|{_START}a)che)s$", ""),
    (r"(?i)(append|direct|matr)ices$", "ix"),
    (rf"(?i)(ind|vert|vort|cort|{_START}ap|{_START}cod)ices$", "ex"),
    (rf"(?i)({_START}ax)es$", "is"),
    (rf"(?i)({_START}(?:analy|ba|cri|diagno|ellip|empha|hypothe|metamorpho|neuro|oa|paraly|parenthe|progno|synop|synthe|the))ses$", "sis"),
    (r"(?i)(ss|x|ch|sh|tz|zz)es$", ""),
    (rf"(?i)({_START}(?:birdi|browni|calori|cooki|geni|hoodi|movi|pixi|prairi|rooki|selfi|zombi|bro|[dlpt]i))es$", "e"),
    (r"(?i)([^aeiou]|qu)ies$", "y"),
    (rf"(?i)(shel|hal|wol|thie|scar|dwar|loa|hoo|shea|{_START}cal|{_START}el|{_START}lea|sel)ves$", "f"),
    (rf"(?i)(kni|wi|{_START}li)ves$", "fe"),
    (r"(?i)(her|potat|tomat|ech|torped|vet|embarg|mosquit|volcan|carg)oes$", "o"),
    (r"(?i)(chair|crafts|fire|fresh|gentle|police|post|sales|spokes|trades|work)men$", "man"),
    (r"(?i)(ss|us|is)$", ""),
    (r"(?i)([^s])s$", ""),
)


def normalize_name(name: Column) -> Column:
    return F.lower(F.translate(name, " _-", ""))


def singularize(name: Column) -> Column:
    """English singular of the last word, first letter's case kept; singular input is unchanged."""
    chain = F.when(name.rlike(rf"(?i){_START}({'|'.join(UNCHANGED)})$"), name)
    for plural, singular in IRREGULAR.items():
        # A word boundary keeps "specimen" and "customers" out of the "men" rule.
        pattern = rf"(?i)({_START})({plural[0]}){plural[1:]}$"
        if plural[0] == singular[0]:
            chain = chain.when(name.rlike(pattern), F.regexp_replace(name, pattern, f"$1$2{singular[1:]}"))
    for pattern, ending in SUFFIX_RULES:
        chain = chain.when(name.rlike(pattern), F.regexp_replace(name, pattern, "$1" + ending))
    return chain.otherwise(name)


def name_matches(given: Column, logical: Column) -> Column:
    target = normalize_name(logical)
    return (normalize_name(given) == target) | (normalize_name(singularize(given)) == target)


def strip_pattern(name: Column, pattern: str) -> Column:
    """Drop a convention prefix and suffix; the suffix only where something remains before it."""
    if "{Name}" not in pattern:
        return name
    prefix, suffix = pattern.split("{Name}", 1)
    if prefix:
        name = F.regexp_replace(name, rf"(?i)^{re.escape(prefix)}", "")
    if suffix:
        name = F.regexp_replace(name, rf"(?is)^(.+){re.escape(suffix)}$", "$1")
    return name


def expand_pattern(pattern: str, name: Column) -> Column:
    return F.replace(F.lit(pattern), F.lit("{Name}"), name)
