"""Queries of the seeded generation section. Ordinals come from the keys of the driver tables."""

from __future__ import annotations

import math

from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import autofake, draws as dr
from ..functions.canonical import canonical_text
from ..operators import generate as gen
from ..operators.linking import reference_findings, reference_for
from ..operators.profiling import generate_like
from ..operators.references import external_reference
from ..session import scratch_path
from ..sources import readers
from ..spec import EntitySpec, ForeignKey
from .base import Registry, dbl, sql_draw, sql_normal, sql_pick, sql_uuid5, sql_weighted
from .references import CONTEXT_SQL, ORDER_KEYS_SQL, context, customers, order_keys

reg = Registry()

SCOPE = "Orders|Order"
SEED = 42
STATUS = {"New": 0.45, "Packed": 0.35, "Sent": 0.2}
TYPICAL_TOTAL, TOTAL_SPREAD = 85, 0.9
ANCHOR = "2024-06-30 12:00:00"

ORDER = EntitySpec(
    "Orders", "Order",
    T.StructType([
        T.StructField("Id", T.StringType()),
        T.StructField("OrderNumber", T.StringType()),
        T.StructField("CustomerId", T.StringType()),
        T.StructField("Status", T.StringType()),
        T.StructField("OrderDate", T.TimestampType()),
        T.StructField("Total", T.DoubleType()),
    ]),
    key="Id", natural_key="OrderNumber", foreign_keys=(ForeignKey("CustomerId", "Customer", "Orders"),))

SHIPMENT = EntitySpec(
    "Fulfilment", "Shipment",
    T.StructType([
        T.StructField("ShipmentNumber", T.StringType()),
        T.StructField("Carrier", T.StringType()),
        T.StructField("ServiceLevel", T.StringType()),
        T.StructField("Weight", T.DoubleType()),
        T.StructField("Parcels", T.IntegerType()),
    ]),
    key="ShipmentNumber", id_strategy="db_generated")


def _order_draws():
    return dr.Draws(SEED, "Orders", "Order", F.col("o_orderkey"))


def _u(prop, k=0, scope=SCOPE, ordinal="o_orderkey", seed=SEED):
    return sql_draw(seed, scope, prop, ordinal, k)


def _event_u(prop, k=0, seed=7):
    return sql_draw(seed, "Ops|Event", prop, "event_id", k)


def _event_draws(seed=7):
    return dr.Draws(seed, "Ops", "Event", F.col("event_id"))


# --- flagship --------------------------------------------------------------------------------

_TOTAL_SQL = (f"round_even(exp({sql_normal(SEED, SCOPE, 'Total', 'o_orderkey', math.log(TYPICAL_TOTAL), TOTAL_SPREAD)}), 2)")
_STATUS_SQL = sql_weighted(_u("Status"), STATUS)
_KEY_SQL = ("'ORD-' || CASE WHEN length(o_orderkey::VARCHAR) < 8 THEN lpad(o_orderkey::VARCHAR, 8, '0') "
            "ELSE o_orderkey::VARCHAR END")


def _digits(column):
    return F.sum(F.conv(F.substring(column, 1, 7), 16, 10).cast("bigint"))


def order_plan(**changes) -> gen.GenerationPlan:
    base = dict(
        spec=ORDER, seed=SEED, scenario="bulk", anchor=F.lit(ANCHOR).cast("timestamp"),
        rules=(
            ("OrderNumber", lambda d: dr.index_key("ORD-", d.ordinal, 8)),
            ("OrderDate", lambda d: autofake.recent(d.u("OrderDate"), F.lit(ANCHOR).cast("timestamp"), 30)),
        ),
        statistics={"Status": {"weights": STATUS}, "Total": {"distribution": "lognormal", "mean": TYPICAL_TOTAL, "sigma": TOTAL_SPREAD}})
    base.update(changes)
    return gen.GenerationPlan(**base)


@reg.add("flagship_orders_by_status", f"""
SELECT status, count(*) AS orders, count(customer_id) AS linked,
  CAST(sum(CAST(total AS DECIMAL(18,2))) AS DOUBLE) AS total, CAST(sum(('0x' || substr(order_id, 1, 7))::BIGINT) AS BIGINT) AS order_id_sum, CAST(sum(('0x' || substr(customer_id, 1, 7))::BIGINT) AS BIGINT) AS customer_id_sum
FROM (SELECT {_STATUS_SQL} AS status, {_TOTAL_SQL} AS total, {sql_uuid5("'Orders|Order|' || " + _KEY_SQL)} AS order_id,
        CASE WHEN c_name IS NOT NULL THEN {sql_uuid5("'Orders|Customer|' || c_name")} END AS customer_id
      FROM orders LEFT JOIN customer ON o_custkey = c_custkey) GROUP BY status""")
def flagship(t):
    """Orders generated for the stored customers: weighted status, lognormal total, derived ids."""
    named = t.orders.select(F.col("o_orderkey").alias("ordinal"), "o_custkey").join(
        t.customer.select("c_custkey", "c_name"), F.col("o_custkey") == F.col("c_custkey"), "left")
    rows = gen.generate(named, order_plan())
    rows = rows.withColumn("CustomerId", external_reference("Orders", "Customer", F.col("c_name")))
    return rows.groupBy(F.col("Status").alias("status")).agg(
        F.count(F.lit(1)).alias("orders"), F.count("CustomerId").alias("linked"),
        F.sum(F.col("Total").cast("decimal(18,2)")).cast("double").alias("total"),
        # sums over the leading digits check every id and, unlike a minimum, keep the hash aggregate
        _digits("Id").alias("order_id_sum"), _digits("CustomerId").alias("customer_id_sum"))


_LINKED_SQL = f"""(SELECT k.o_orderkey, customer_name, coalesce(ctx, CASE WHEN c_name IS NOT NULL THEN {sql_uuid5("'Orders|Customer|' || c_name")} END) AS customer_id,
  CASE WHEN ctx IS NOT NULL THEN 'contextBag' WHEN c_name IS NOT NULL THEN 'database' END AS resolved_from
FROM {ORDER_KEYS_SQL} k LEFT JOIN (SELECT key, max_by(id, event_id) AS ctx FROM {CONTEXT_SQL} WHERE entity = 'customer' GROUP BY key) ON customer_name = key
LEFT JOIN customer ON customer_name = c_name)"""


def _linked_orders(t):
    """Orders generated with the customer that each names: of the scenario so far, else stored."""
    reference = reference_for(ORDER, "Customer", "customer_name", table=customers(t), natural_key="c_name", row_id="id")
    asked = order_keys(t).withColumnRenamed("o_orderkey", "ordinal")
    return gen.generate(asked, order_plan(references=(reference,)), context=context(t)), (reference,)


@reg.add("gen1_generate", f"""
SELECT o_orderkey AS ordinal, {_KEY_SQL} AS order_number, {_STATUS_SQL} AS status, {_TOTAL_SQL} AS total,
  {sql_uuid5("'Orders|Order|' || " + _KEY_SQL)} AS id, customer_id, resolved_from FROM {_LINKED_SQL}""")
def _(t):
    rows, _ = _linked_orders(t)
    return rows.select("ordinal", F.col("OrderNumber").alias("order_number"), F.col("Status").alias("status"),
                       F.col("Total").alias("total"), F.col("Id").alias("id"), F.col("CustomerId").alias("customer_id"),
                       F.col("CustomerId_reference.resolved_from").alias("resolved_from"))


@reg.add("gen1_reference_findings", f"""
SELECT o_orderkey AS "row", 'Customer' AS entity, customer_name AS key, 'not found' AS problem FROM {_LINKED_SQL} WHERE resolved_from IS NULL""")
def _(t):
    rows, references = _linked_orders(t)
    return reference_findings(rows, references, "ordinal")


@reg.add("gen2_draw", f"SELECT o_orderkey, {_u('Total')} AS u0, {_u('Total', 1)} AS u1 FROM orders")
def _(t):
    d = _order_draws()
    return t.orders.select("o_orderkey", d.u("Total").alias("u0"), d.u("Total", 1).alias("u1"))


@reg.add("gen3_normal", f"""
SELECT o_orderkey, round_even({sql_normal(SEED, SCOPE, 'Weight', 'o_orderkey', 100.0, 10.0)}, 2) AS weight FROM orders""")
def _(t):
    d = _order_draws()
    return t.orders.select("o_orderkey", dr.round_to_type(
        dr.normal(d.u("Weight"), d.u("Weight", 1), 100, 10), "double").alias("weight"))


@reg.add("gen4_lognormal", f"SELECT o_orderkey, {_TOTAL_SQL} AS total FROM orders")
def _(t):
    d = _order_draws()
    return t.orders.select("o_orderkey", dr.round_to_type(
        dr.lognormal(d.u("Total"), d.u("Total", 1), TYPICAL_TOTAL, TOTAL_SPREAD), "double").alias("total"))


@reg.add("gen5_uniform", f"""
SELECT o_orderkey, round_even({dbl(5.0)} + {_u('Rate')} * {dbl(20.0)}, 2) AS rate FROM orders""")
def _(t):
    return t.orders.select("o_orderkey", dr.round_to_type(
        dr.uniform(_order_draws().u("Rate"), 5, 25), "double").alias("rate"))


@reg.add("gen6_exponential", f"""
SELECT o_orderkey, round_even(-ln({dbl(1.0)} - {_u('Wait')}) * {dbl(40.0)}, 2) AS wait FROM orders""")
def _(t):
    return t.orders.select("o_orderkey", dr.round_to_type(
        dr.exponential(_order_draws().u("Wait"), 40), "double").alias("wait"))


@reg.add("gen7_clamp", f"""
SELECT o_orderkey, round_even(least(greatest({sql_normal(SEED, SCOPE, 'Score', 'o_orderkey', 50.0, 30.0)},
  {dbl(0.0)}), {dbl(100.0)}), 2) AS score FROM orders""")
def _(t):
    config = {"distribution": "normal", "mean": 50, "sigma": 30, "min": 0, "max": 100}
    return t.orders.select("o_orderkey", dr.round_to_type(
        dr.distribution(_order_draws(), "Score", config), "double").alias("score"))


@reg.add("gen8_round_to_type", f"""
SELECT event_id, round_even({_event_u('Raw')} * {dbl(1000.0)}, 2) AS two_places,
  round_even({_event_u('Raw')} * {dbl(1000.0)}, 4) AS four_places,
  CAST(round_even({_event_u('Raw')} * {dbl(1000.0)}, 0) AS INTEGER) AS whole,
  CAST(round_even(event_id / {dbl(2.0)}, 0) AS BIGINT) AS half_even FROM events""")
def _(t):
    raw = _event_draws().u("Raw") * F.lit(1000.0)
    return t.events.select(
        "event_id", dr.round_to_type(raw, "double").alias("two_places"),
        dr.round_to_type(raw, "double", 4).alias("four_places"),
        dr.round_to_type(raw, "int").alias("whole"),
        dr.round_to_type(F.col("event_id") / F.lit(2.0), "bigint").alias("half_even"))


@reg.add("gen9_weighted", f"""
SELECT o_orderkey, {_STATUS_SQL} AS status,
  {sql_weighted(_u('Tier'), {'Gold': 3.0, 'Silver': 5.0, 'bronze': 2.5, 'Basic': 9.0, 'None': 0.0})} AS tier FROM orders""")
def _(t):
    d = _order_draws()
    return t.orders.select("o_orderkey", dr.weighted(d.u("Status"), STATUS).alias("status"), dr.weighted(
        d.u("Tier"), {"Gold": 3.0, "Silver": 5.0, "bronze": 2.5, "Basic": 9.0, "None": 0.0}).alias("tier"))


_PLACES_SQL = ("(SELECT row_number() OVER (ORDER BY n_name, r_name) - 1 AS row_id, n_name, r_name, count(*) OVER () AS n "
               "FROM nation JOIN region ON n_regionkey = r_regionkey)")


def _places(t):
    """The places as files of a dataset: two CSV files, read back in their order."""
    table = t.nation.join(t.region, F.col("n_regionkey") == F.col("r_regionkey")).select("n_name", "r_name")
    folder = scratch_path(t.spark, "places")
    table.repartitionByRange(2, "n_name").sortWithinPartitions("n_name", "r_name").write.option("header", True).option("quoteAll", True).option("escape", '"').csv(folder)
    return readers.load_dataset(t.spark, "places", folder)


@reg.add("gen10_correlated", f"""
SELECT o_orderkey AS ordinal, n_name AS carrier, r_name AS service_level FROM orders
JOIN {_PLACES_SQL} ON row_id = floor({sql_draw(SEED, 'Fulfilment|Shipment', 'dataset:places', 'o_orderkey')} * n::DOUBLE)::BIGINT""")
def _(t):
    rows = t.orders.select(F.col("o_orderkey").alias("ordinal"))
    source = dr.Draws(SEED, "Fulfilment", "Shipment", F.col("ordinal"))
    picked = {SHIPMENT.schema["Carrier"]: "N_NAME", SHIPMENT.schema["ServiceLevel"]: "r_name"}
    out = gen.correlated(rows, _places(t), source, picked, SHIPMENT)
    return out.select("ordinal", F.col("Carrier").alias("carrier"), F.col("ServiceLevel").alias("service_level"))


_SHIP = "Fulfilment|Shipment"


@reg.add("gen11_apply_statistics", f"""
SELECT o_orderkey AS ordinal, n_name AS carrier, r_name AS service_level,
  round_even(least(greatest({sql_normal(SEED, _SHIP, 'Weight', 'o_orderkey', 12.0, 4.0)}, {dbl(0.5)}), {dbl(30.0)}), 1) AS weight,
  CAST({sql_weighted(sql_draw(SEED, _SHIP, 'Parcels', 'o_orderkey'), {'1': 7.0, '2': 2.0, '3': 1.0})} AS INTEGER) AS parcels
FROM orders JOIN {_PLACES_SQL}
  ON row_id = floor({sql_draw(SEED, _SHIP, 'dataset:places', 'o_orderkey')} * n::DOUBLE)::BIGINT""")
def _(t):
    plan = gen.GenerationPlan(spec=SHIPMENT, seed=SEED, datasets={"places": _places(t)}, statistics={
        "carrier": {"dataset": "places", "column": "n_name"},
        "service level": {"dataset": "Places", "column": "r_name"},
        "Weight": {"distribution": "normal", "mean": 12, "sigma": 4, "min": 0.5, "max": 30, "decimals": 1},
        "Parcels": {"weights": {"1": 7.0, "2": 2.0, "3": 1.0}}})
    rows = t.orders.select(F.col("o_orderkey").alias("ordinal"))
    out = gen.apply_statistics(rows, plan, dr.Draws(SEED, "Fulfilment", "Shipment", F.col("ordinal")))
    return out.select("ordinal", F.col("Carrier").alias("carrier"), F.col("ServiceLevel").alias("service_level"),
                      F.col("Weight").alias("weight"), F.col("Parcels").alias("parcels"))


_PROPERTY_NAMES = ("Email", "FirstName", "Surname", "CompanyTitle", "Name", "NickName", "HomePhone", "StreetLine",
                   "BillingAddress", "City", "PostCode", "ZipExtra", "Country", "SkuRef", "WebsiteUrl", "Notes",
                   "CurrencyLabel", "IbanText", "CostCode", "OrderNumber", "Colour", "FullNameText", "Reference", "Memo")


def _rule_sql(name: str) -> str:
    tests = {"contains": "contains({n}, '{f}')", "equals": "{n} = '{f}'", "ends": "suffix({n}, '{f}')"}
    arms = []
    for rule, how, fragments in autofake.NAME_RULES:
        condition = " OR ".join(tests[how].format(n=name, f=f) for f in fragments)
        arms.append(f"WHEN {condition} THEN '{rule}'")
    return f"CASE {' '.join(arms)} ELSE '{autofake.FALLBACK_RULE}' END"


@reg.add("gen12_autofake_by_name", f"""
SELECT p_partkey, property, {_rule_sql('lower(property)')} AS rule,
  {sql_pick(sql_draw(3, 'Orders|Product', 'City', 'p_partkey'), autofake.VOCABULARY['en']['city'])} AS city
FROM (SELECT p_partkey, {sql_pick("(p_partkey % 24) / 24.0", _PROPERTY_NAMES)} || '' AS property FROM part)""")
def _(t):
    names = F.array(*[F.lit(n) for n in _PROPERTY_NAMES])
    rows = t.part.select("p_partkey", F.element_at(names, (F.col("p_partkey") % 24 + 1).cast("int")).alias("property"))
    source = dr.Draws(3, "Orders", "Product", F.col("p_partkey"))
    return rows.select("p_partkey", "property", autofake.name_rule_column(F.col("property")).alias("rule"),
                       autofake.fake_text(source, "City").alias("city"))


def _whole_sql(prop, low, high, kind):
    return f"CAST(floor({_event_u(prop)} * {dbl(float(high - low + 1))}) + {low} AS {kind})"


def _recent_sql(prop, days):
    return f"(TIMESTAMP '{ANCHOR}' - to_seconds(floor({_event_u(prop)} * {dbl(float(days * 86400))})::BIGINT))"


@reg.add("gen13_autofake_by_type", f"""
SELECT event_id, {_whole_sql('Count', 1, 1000, 'INTEGER')} AS count_int, {_whole_sql('Big', 1, 1000000, 'BIGINT')} AS big,
  {_whole_sql('Small', 1, 1000, 'SMALLINT')} AS small, round_even({_event_u('Ratio')} * {dbl(10000.0)}, 2) AS ratio,
  {_event_u('Flag')} < {dbl(0.5)} AS flag,
  CAST(round_even({_event_u('UnitPrice')} * {dbl(1000.0)}, 2) AS DOUBLE) AS price,
  CAST(round_even({_event_u('Mass')} * {dbl(10000.0)}, 2) AS DOUBLE) AS mass,
  {sql_pick(_event_u('Kind'), ('Site', 'Aisle', 'Bin'))} AS kind,
  strftime({_recent_sql('Seen', 30)}, '%Y-%m-%d %H:%M:%S') AS seen,
  strftime({_recent_sql('Day', 30)}, '%Y-%m-%d') AS day,
  {_whole_sql('Span', 1, 1440, 'INTEGER')} AS span_minutes,
  strftime(TIMESTAMP '1970-01-01' + to_seconds(floor({_event_u('At')} * {dbl(86400.0)})::BIGINT), '%H:%M:%S') AS at_time,
  CAST(floor({_event_u('Level')} * {dbl(256.0)}) AS INTEGER) AS level,
  {sql_uuid5("'guid|7|Ops|Event|Token|' || event_id::VARCHAR")} AS token FROM events""")
def _(t):
    d, anchor = _event_draws(), F.lit(ANCHOR).cast("timestamp")

    def typed(prop, data_type, **more):
        return autofake.fake_typed(d, prop, data_type, anchor, **more)

    span = typed("Span", T.DayTimeIntervalType())
    return t.events.select(
        "event_id", typed("Count", T.IntegerType()).alias("count_int"), typed("Big", T.LongType()).alias("big"),
        typed("Small", T.ShortType()).alias("small"), typed("Ratio", T.DoubleType()).alias("ratio"),
        typed("Flag", T.BooleanType()).alias("flag"),
        typed("UnitPrice", T.DecimalType(18, 2)).cast("double").alias("price"),
        typed("Mass", T.DecimalType(18, 2)).cast("double").alias("mass"),
        typed("Kind", T.StringType(), enum_values=("Site", "Aisle", "Bin")).alias("kind"),
        F.date_format(typed("Seen", T.TimestampType()), "yyyy-MM-dd HH:mm:ss").alias("seen"),
        F.date_format(typed("Day", T.DateType()), "yyyy-MM-dd").alias("day"),
        (F.unix_seconds(F.lit("1970-01-01").cast("timestamp") + span) / 60).cast("int").alias("span_minutes"),
        autofake.fake_time(d, "At").alias("at_time"), autofake.fake_byte(d, "Level").alias("level"),
        autofake.fake_guid(d, "Token").alias("token"))


def _char_sql(u, alphabet):
    return f"substr('{alphabet}', (floor({u} * {dbl(float(len(alphabet)))}) + 1)::BIGINT, 1)"


def _pattern_sql(prop, pattern, draw=lambda prop, k: sql_draw(SEED, "Orders|Product", prop, "p_partkey", k)):
    parts, k = [], 0
    for ch in pattern:
        if ch in "#?":
            u = draw(prop, k)
            parts.append(_char_sql(u, "0123456789" if ch == "#" else "ABCDEFGHIJKLMNOPQRSTUVWXYZ"))
            k += 1
        else:
            parts.append(f"'{ch.upper()}'")
    return " || ".join(parts)


CONTACT = EntitySpec("Crm", "Contact", T.StructType([
    T.StructField("Id", T.StringType()), T.StructField("OwnerId", T.StringType()),
    T.StructField("FullName", T.StringType()), T.StructField("Email", T.StringType()),
    T.StructField("City", T.StringType()), T.StructField("Sku", T.StringType()),
    T.StructField("Notes", T.StringType()), T.StructField("CreditLimit", T.DecimalType(18, 2)),
    T.StructField("Kind", T.StringType()), T.StructField("CreatedUtc", T.TimestampType()),
    T.StructField("Active", T.BooleanType())]),
    key="Id", foreign_keys=(ForeignKey("OwnerId", "Customer"),), enums={"Kind": ("Lead", "Client", "Partner")})


def _contact_word(prop, topic, k=0):
    return sql_pick(sql_draw(11, "Crm|Contact", prop, "c_custkey", k), autofake.VOCABULARY["de"][topic])


def _contact_u(prop, k=0):
    return sql_draw(11, "Crm|Contact", prop, "c_custkey", k)


_CONTACT_SQL = f"""
SELECT c_custkey AS ordinal, {_contact_word('FullName', 'first_name')} || ' ' || {_contact_word('FullName', 'last_name', 1)} AS "FullName",
  lower({_contact_word('Email', 'first_name')} || '.' || {_contact_word('Email', 'last_name', 1)} ||
    floor({_contact_u('Email', 2)} * 100)::INT::VARCHAR) || '@example.com' AS "Email",
  {_contact_word('City', 'city')} AS "City", {_pattern_sql('Sku', 'SKU-####-??', _contact_u)} AS "Sku",
  upper(substr({_contact_word('Notes', 'word')}, 1, 1)) || substr({_contact_word('Notes', 'word')}, 2)
    || {" || ".join("' ' || " + _contact_word('Notes', 'word', k) for k in range(1, 6))} || '.' AS "Notes",
  CAST(CAST(round_even({_contact_u('CreditLimit')} * {dbl(1000.0)}, 2) AS DECIMAL(18,2)) AS VARCHAR) AS "CreditLimit",
  {sql_pick(_contact_u('Kind'), CONTACT.enums['Kind'])} AS "Kind",
  strftime(TIMESTAMP '{ANCHOR}' - to_seconds(floor({_contact_u('CreatedUtc')} * {dbl(30 * 86400.0)})::BIGINT), '%Y-%m-%dT%H:%M:%S.%f') AS "CreatedUtc",
  CASE WHEN {_contact_u('Active')} < {dbl(0.5)} THEN 'true' ELSE 'false' END AS "Active" FROM customer"""


@reg.add("gen14_autofake", _CONTACT_SQL)
def _(t):
    plan = gen.GenerationPlan(spec=CONTACT, seed=11, locale="de", anchor=F.lit(ANCHOR).cast("timestamp"))
    rows = t.customer.select(F.col("c_custkey").alias("ordinal"))
    out = gen.autofake_columns(rows, plan, dr.Draws(11, "Crm", "Contact", F.col("ordinal")))
    return out.select("ordinal", *[canonical_text(F.col(f.name), f.dataType).alias(f.name)
                                   for f in CONTACT.generated_fields])


def _locale_sql(topic):
    arms = " ".join(f"WHEN '{name}' THEN " + sql_pick(sql_draw(5, "Crm|Contact", topic, "c_custkey"), words[topic])
                    for name, words in autofake.VOCABULARY.items())
    return f"CASE locale {arms} END"


@reg.add("gen15_locale_vocab", f"""
SELECT c_custkey, locale, {_locale_sql('city')} AS city, {_locale_sql('first_name')} AS first_name
FROM customer CROSS JOIN (VALUES ('de'), ('en'), ('fr')) v(locale)""")
def _(t):
    d = dr.Draws(5, "Crm", "Contact", F.col("c_custkey"))

    def by_locale(topic):
        chain = None
        for name in autofake.VOCABULARY:
            word = autofake.fake_text(d, topic, name, rule=topic)
            chain = F.when(F.col("locale") == name, word) if chain is None else chain.when(F.col("locale") == name, word)
        return chain

    rows = t.customer.select("c_custkey", F.explode(F.array(*[F.lit(n) for n in sorted(autofake.VOCABULARY)])).alias("locale"))
    return rows.select("c_custkey", "locale", by_locale("city").alias("city"), by_locale("first_name").alias("first_name"))


@reg.add("gen16_pattern_fill", f"SELECT p_partkey, {_pattern_sql('Sku', 'sku-####-??')} AS sku FROM part")
def _(t):
    d = dr.Draws(SEED, "Orders", "Product", F.col("p_partkey"))
    return t.part.select("p_partkey", dr.pattern_fill(d, "Sku", "sku-####-??").alias("sku"))


@reg.add("gen17_index_key", """
SELECT event_id, 'SHP-' || CASE WHEN length(event_id::VARCHAR) < 3 THEN lpad(event_id::VARCHAR, 3, '0')
  ELSE event_id::VARCHAR END AS number FROM events""")
def _(t):
    return t.events.select("event_id", dr.index_key("SHP-", F.col("event_id"), 3).alias("number"))


@reg.add("gen18_rule_set", f"""
SELECT ordinal, number, strftime(TIMESTAMP '2024-01-01' + to_hours(start_hour), '%H:%M:%S') AS window_start,
  strftime(TIMESTAMP '2024-01-01' + to_hours(start_hour + 2), '%H:%M:%S') AS window_end, carrier FROM (
  SELECT o_orderkey AS ordinal, {_KEY_SQL.replace('ORD-', 'SHP-')} AS number,
    CAST(8 + floor({sql_draw(SEED, _SHIP, 'WindowStart', 'o_orderkey')} * 10) AS INTEGER) AS start_hour,
    {sql_pick(sql_draw(SEED, _SHIP, 'Carrier', 'o_orderkey'), ('North', 'South', 'West'))} AS carrier FROM orders)""")
def _(t):
    def clock(hours):
        return F.date_format(F.timestamp_seconds(hours * 3600), "HH:mm:ss")
    rules = (
        ("number", lambda d: dr.index_key("SHP-", d.ordinal, 8)),
        ("start_hour", lambda d: d.index("WindowStart", 10) + 8),
        ("window_start", lambda d: clock(F.col("start_hour"))),
        ("window_end", lambda d: clock(F.col("start_hour") + 2)),
        ("carrier", lambda d: dr.pick_random(d.u("Carrier"), ("North", "South", "West"))),
    )
    rows = t.orders.select(F.col("o_orderkey").alias("ordinal"))
    return gen.rule_set(rows, rules, dr.Draws(SEED, "Fulfilment", "Shipment", F.col("ordinal"))).drop("start_hour")


@reg.add("gen19_pick_random", f"""
SELECT o_orderkey, {sql_pick(_u('Category'), ('Books', 'Games', 'Garden', 'Tools'))} AS category,
  {_u('Discontinued')} < {dbl(0.1)} AS discontinued FROM orders""")
def _(t):
    d = _order_draws()
    return t.orders.select("o_orderkey", dr.pick_random(d.u("Category"), ("Books", "Games", "Garden", "Tools")).alias("category"),
                           dr.chance(d.u("Discontinued"), 0.1).alias("discontinued"))


@reg.add("gen20_overrides", f"""
SELECT o_orderkey AS ordinal, 'Cancelled' AS status, 12.5::DOUBLE AS total, '2024-03-01 00:00:00' AS order_date,
  {sql_uuid5("'Orders|Order|' || " + _KEY_SQL)} AS id FROM orders""")
def _(t):
    plan = order_plan(overrides={"status": "Cancelled", "TOTAL": "12.50", "order date": "2024-03-01"})
    rows = gen.generate(t.orders.select(F.col("o_orderkey").alias("ordinal")), plan)
    return rows.select("ordinal", F.col("Status").alias("status"), F.col("Total").alias("total"),
                       F.date_format("OrderDate", "yyyy-MM-dd HH:mm:ss").alias("order_date"), F.col("Id").alias("id"))


@reg.add("gen21_source_marker", """
SELECT o_orderkey, 'auto+plugin:sku,vat' || CASE WHEN o_orderstatus = 'O' THEN '+distributions' ELSE '' END
  || CASE WHEN o_orderkey % 2 = 0 THEN '+datasets' ELSE '' END AS source FROM orders""")
def _(t):
    return t.orders.select("o_orderkey", gen.source_marker(
        "auto", ("sku", "vat"), distributions=F.col("o_orderstatus") == "O",
        datasets=F.col("o_orderkey") % 2 == 0).alias("source"))


@reg.add("gen22_generate_scenarios", f"""
SELECT scenario, ordinal, {sql_weighted(sql_draw('seed', SCOPE, 'Status', 'ordinal'), STATUS)} AS status,
  {sql_uuid5("'Orders|Order|' || ord_key")} AS id FROM (
  SELECT scenario, seed, ordinal, 'ORD-' || CASE WHEN length(ordinal::VARCHAR) < 8 THEN lpad(ordinal::VARCHAR, 8, '0')
    ELSE ordinal::VARCHAR END AS ord_key FROM (
    SELECT scenario, seed, unnest(range(1, n + 1)) AS ordinal FROM (
      SELECT event_type AS scenario, min(event_id) AS seed, count(*) AS n FROM events GROUP BY event_type)))""")
def _(t):
    scenarios = t.events.groupBy(F.col("event_type").alias("scenario")).agg(
        F.min("event_id").alias("seed"), F.count(F.lit(1)).alias("count"))
    rows = gen.generate_scenarios(scenarios, order_plan())
    return rows.select("scenario", "ordinal", F.col("Status").alias("status"), F.col("Id").alias("id"))


@reg.add("gen23_profile_then_generate", f"""
WITH w AS (SELECT label, share, sum(share) OVER (ORDER BY label) AS running FROM (
    SELECT o_orderstatus AS label, round_even(count(*) / (SELECT count(*) FROM orders)::DOUBLE, 4) AS share FROM orders GROUP BY 1)),
g AS (SELECT o_orderkey, min(label) AS label FROM (
    SELECT o_orderkey, {sql_draw(SEED, 'Profiled|Entity', 'o_orderstatus', 'o_orderkey')} * (SELECT max(running) FROM w) AS roll FROM orders)
  JOIN w ON roll < running GROUP BY o_orderkey)
SELECT 'o_orderstatus' AS property, w.label, any_value(w.share) AS source_share,
  round_even(count(g.label) / (SELECT count(*) FROM orders)::DOUBLE, 4) AS generated_share FROM w LEFT JOIN g ON w.label = g.label GROUP BY w.label""")
def _(t):
    """Shares per status in the stored orders and in rows generated from their profile."""
    return generate_like(t.orders, "o_orderkey", ["o_orderstatus", "o_totalprice"], seed=SEED).select(
        "property", "label", "source_share", "generated_share")


@reg.add("udf1_value_plugins", f"""
SELECT o_orderkey AS ordinal, CASE WHEN o_orderkey % 3 = 0 THEN 'EXPRESS'
  ELSE {sql_pick(sql_draw(SEED, _SHIP, 'Carrier', 'o_orderkey'), autofake.VOCABULARY['en']['word'])} END AS carrier,
  {sql_pick(sql_draw(SEED, _SHIP, 'ServiceLevel', 'o_orderkey'), ('Next day', 'Two days'))} AS service_level
FROM orders""")
def _(t):
    plugins = (
        gen.ValuePlugin("express", lambda spec, f: f.name == "Carrier",
                        lambda d, f: F.when(d.ordinal % 3 == 0, "EXPRESS")),
        gen.ValuePlugin("levels", lambda spec, f: spec.entity == "Shipment" and f.name == "ServiceLevel",
                        lambda d, f: dr.pick_random(d.u(f.name), ("Next day", "Two days"))),
    )
    plan = gen.GenerationPlan(spec=SHIPMENT, seed=SEED, plugins=plugins)
    rows = t.orders.select(F.col("o_orderkey").alias("ordinal"))
    out = gen.autofake_columns(rows, plan, dr.Draws(SEED, "Fulfilment", "Shipment", F.col("ordinal")))
    return out.select("ordinal", F.col("Carrier").alias("carrier"), F.col("ServiceLevel").alias("service_level"))


_RULES_BY_ENTITY = {"Shipment": (("ShipmentNumber", lambda d: dr.index_key("SHP-", d.ordinal, 6)),
                                 ("Parcels", lambda d: d.index("Parcels", 5) + 1))}


@reg.add("udf2_entity_rules", f"""
SELECT event_id AS ordinal, 'SHP-' || CASE WHEN length(event_id::VARCHAR) < 6 THEN lpad(event_id::VARCHAR, 6, '0')
  ELSE event_id::VARCHAR END AS number,
  CAST(floor({sql_draw(SEED, _SHIP, 'Parcels', 'event_id')} * {dbl(5.0)}) AS INTEGER) + 1 AS parcels FROM events""")
def _(t):
    plan = gen.GenerationPlan(spec=SHIPMENT, seed=SEED, rules=_RULES_BY_ENTITY[SHIPMENT.entity])
    rows = gen.generate(t.events.select(F.col("event_id").alias("ordinal")), plan)
    return rows.select("ordinal", F.col("ShipmentNumber").alias("number"), F.col("Parcels").alias("parcels"))
