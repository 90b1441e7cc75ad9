"""Fallback values by property name, then by property type."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .draws import Draws, alphanumeric, chance, pattern_fill, pick_random
from .identity import joined_name, uuid5_name

# Ordered name rules (rule, how, fragments); the first match decides.
NAME_RULES = (
    ("email", "contains", ("email",)),
    ("first_name", "contains", ("firstname",)),
    ("last_name", "contains", ("lastname", "surname")),
    ("company", "contains", ("company",)),
    ("company", "equals", ("name",)),
    ("full_name", "contains", ("fullname",)),
    ("full_name", "ends", ("name",)),
    ("phone", "contains", ("phone",)),
    ("street", "contains", ("street", "address")),
    ("city", "contains", ("city",)),
    ("postcode", "contains", ("postcode", "zip")),
    ("country", "contains", ("country",)),
    ("sku", "contains", ("sku",)),
    ("url", "contains", ("url", "website")),
    ("sentence", "contains", ("description", "notes", "comment")),
    ("currency", "contains", ("currency",)),
    ("iban", "contains", ("iban",)),
    ("code", "contains", ("code", "reference", "number")),
)
FALLBACK_RULE = "word"
# Decimal properties that read as a price.
PRICE_FRAGMENTS = ("price", "amount", "total", "cost", "limit", "balance")

# Vocabularies per locale. The locale picks the vocabulary, never the draw.
VOCABULARY = {
    "en": {
        "first_name": ("Alice", "Ben", "Clara", "David", "Emma", "Frank", "Grace", "Henry"),
        "last_name": ("Adams", "Baker", "Clark", "Davies", "Evans", "Foster", "Green", "Hughes"),
        "company": ("Ashford Ltd", "Brightwater Inc", "Copperfield Group", "Dunmore and Sons",
                    "Eastgate LLC", "Fairview Partners", "Granville Ltd", "Hillcrest Inc"),
        "street": ("Church Lane", "High Street", "Mill Road", "Park Avenue", "Station Road", "Victoria Street"),
        "city": ("Bristol", "Cambridge", "Exeter", "Leeds", "Norwich", "Oxford", "York"),
        "country": ("Canada", "France", "Germany", "Ireland", "Japan", "Norway", "Spain", "United Kingdom"),
        "word": ("amber", "bridge", "candle", "delta", "ember", "forest", "garden", "harbour"),
    },
    "de": {
        "first_name": ("Anna", "Bernd", "Clara", "Dieter", "Eva", "Felix", "Greta", "Hans"),
        "last_name": ("Bauer", "Fischer", "Hoffmann", "Keller", "Meyer", "Schmidt", "Wagner", "Weber"),
        "company": ("Adler GmbH", "Bergmann AG", "Eichen KG", "Falken GmbH", "Linden AG", "Nordwind GmbH",
                    "Quelle KG", "Sonnental AG"),
        "street": ("Bahnhofstrasse", "Dorfweg", "Gartenstrasse", "Hauptstrasse", "Kirchweg", "Lindenallee"),
        "city": ("Berlin", "Bremen", "Dresden", "Freiburg", "Hamburg", "Leipzig", "Ulm"),
        "country": ("Belgien", "Deutschland", "Frankreich", "Italien", "Kanada", "Norwegen", "Spanien", "Ungarn"),
        "word": ("abend", "blume", "donner", "eiche", "feder", "garten", "himmel", "insel"),
    },
    "fr": {
        "first_name": ("Alain", "Brigitte", "Camille", "Denis", "Elise", "Fabien", "Gabrielle", "Hugo"),
        "last_name": ("Bernard", "Dubois", "Fournier", "Girard", "Lambert", "Moreau", "Petit", "Rousseau"),
        "company": ("Aubert SA", "Beaulieu SARL", "Chevalier et Fils", "Durand SA", "Etoile SARL",
                    "Fontaine SA", "Gauthier SARL", "Horizon SA"),
        "street": ("Avenue des Fleurs", "Place du Moulin", "Quai Nord", "Rue de la Gare", "Rue du Parc", "Rue Neuve"),
        "city": ("Bordeaux", "Dijon", "Lille", "Lyon", "Nantes", "Rennes", "Toulouse"),
        "country": ("Allemagne", "Belgique", "Canada", "Espagne", "France", "Italie", "Norvège", "Suisse"),
        "word": ("arbre", "bateau", "ciel", "dune", "etoile", "fleur", "goutte", "herbe"),
    },
}
CURRENCIES = ("AUD", "CAD", "CHF", "EUR", "GBP", "JPY", "NOK", "PLN", "SEK", "USD")


def vocabulary(locale: str, topic: str) -> tuple[str, ...]:
    language = locale.replace("-", "_").split("_")[0].lower()
    if language not in VOCABULARY:
        raise ValueError(f"unknown locale '{locale}': {', '.join(sorted(VOCABULARY))}")
    return VOCABULARY[language][topic]


def name_rule(property_name: str) -> str:
    """Rule for one property, decided on the driver from its name alone."""
    name = property_name.lower()
    for rule, how, fragments in NAME_RULES:
        for fragment in fragments:
            if {"contains": fragment in name, "equals": name == fragment, "ends": name.endswith(fragment)}[how]:
                return rule
    return FALLBACK_RULE


def name_rule_column(property_name: Column) -> Column:
    """The same rule choice over a column of property names."""
    name = F.lower(property_name)
    chain = None
    for rule, how, fragments in NAME_RULES:
        tests = []
        for fragment in fragments:
            value = F.lit(fragment)
            tests.append({"contains": F.contains(name, value), "equals": name == value,
                          "ends": F.endswith(name, value)}[how])
        condition = tests[0]
        for test in tests[1:]:
            condition = condition | test
        chain = F.when(condition, rule) if chain is None else chain.when(condition, rule)
    return chain.otherwise(FALLBACK_RULE)


def fake_text(draws: Draws, prop: str, locale: str = "en", rule: str | None = None) -> Column:
    """String value for a property, chosen by its name."""
    rule = rule or name_rule(prop)

    def word(topic: str, k: int = 0) -> Column:
        return pick_random(draws.u(prop, k), vocabulary(locale, topic))

    if rule in ("first_name", "last_name", "company", "city", "country", "word"):
        return word(rule)
    if rule == "full_name":
        return F.concat(word("first_name"), F.lit(" "), word("last_name", 1))
    if rule == "email":
        local = F.concat(word("first_name"), F.lit("."), word("last_name", 1), draws.index(prop, 100, 2).cast("string"))
        return F.concat(F.lower(local), F.lit("@example.com"))
    if rule == "phone":
        return pattern_fill(draws, prop, "+00 ### ### ####")
    if rule == "street":
        return F.concat((draws.index(prop, 200) + 1).cast("string"), F.lit(" "), word("street", 1))
    if rule == "postcode":
        return pattern_fill(draws, prop, "#####")
    if rule == "sku":
        return pattern_fill(draws, prop, "SKU-####-??")
    if rule == "url":
        return F.concat(F.lit("https://"), word("word"), F.lit(".example.com"))
    if rule == "sentence":
        return F.concat(F.initcap(word("word", 0)), *[x for k in range(1, 6) for x in (F.lit(" "), word("word", k))],
                        F.lit("."))
    if rule == "currency":
        return pick_random(draws.u(prop), CURRENCIES)
    if rule == "iban":
        return F.concat(F.lit("XX00"), pattern_fill(draws, prop, "################"))
    return alphanumeric(draws, prop, 10)


def fake_typed(draws: Draws, prop: str, data_type: T.DataType, anchor: Column,
               enum_values: tuple[str, ...] | None = None) -> Column | None:
    """Value by type; None for a type that is left to references. ``anchor`` is the recent-past end."""
    u = draws.u(prop)

    def whole(low: int, high: int) -> Column:
        return (F.floor(u * F.lit(float(high - low + 1))) + low)

    if enum_values:
        return pick_random(u, enum_values)
    if isinstance(data_type, T.DecimalType):
        price = any(fragment in prop.lower() for fragment in PRICE_FRAGMENTS)
        return F.bround(u * F.lit(1000.0 if price else 10000.0), 2).cast(data_type)
    if isinstance(data_type, T.IntegerType):
        return whole(1, 1000).cast("int")
    if isinstance(data_type, T.LongType):
        return whole(1, 1_000_000).cast("bigint")
    if isinstance(data_type, T.ShortType):
        return whole(1, 1000).cast("smallint")
    if isinstance(data_type, T.ByteType):
        return whole(0, 127).cast("tinyint")
    if isinstance(data_type, (T.DoubleType, T.FloatType)):
        return F.bround(u * F.lit(10000.0), 2).cast(data_type)
    if isinstance(data_type, T.BooleanType):
        return chance(u)
    if isinstance(data_type, T.TimestampType):
        return recent(u, anchor, 30)
    if isinstance(data_type, T.DateType):
        return F.to_date(recent(u, anchor, 30))
    if isinstance(data_type, T.DayTimeIntervalType):
        return F.make_dt_interval(F.lit(0), F.lit(0), whole(1, 24 * 60).cast("int"))
    return None


def recent(u: Column, anchor: Column, days: int) -> Column:
    """A whole second in the ``days`` before the anchor."""
    back = F.floor(u * F.lit(float(days * 86400))).cast("bigint")
    return F.timestamp_seconds(F.unix_seconds(anchor) - back)


def fake_time(draws: Draws, prop: str) -> Column:
    """Time of day as ``HH:mm:ss`` text."""
    return F.date_format(F.timestamp_seconds(draws.index(prop, 86400)), "HH:mm:ss")


def fake_guid(draws: Draws, prop: str) -> Column:
    """Random-looking but seeded GUID text in lower case."""
    return uuid5_name(joined_name("guid", draws.seed, draws.domain, draws.entity, prop, draws.ordinal))


def fake_byte(draws: Draws, prop: str) -> Column:
    return draws.index(prop, 256)


# Values of kinds that the Spark type does not tell apart.
BY_KIND = {"guid": fake_guid, "time": fake_time, "byte": fake_byte}
