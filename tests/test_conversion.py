import datetime as dt

import pytest
from pyspark.sql import functions as F

from synthframe.functions import convert as cv, names as nm
from synthframe.functions.canonical import values_equal

NOW = dt.datetime(2024, 3, 31, 15, 30)


def convert(spark, raw, target, **options):
    row = spark.range(1).select(cv.typed_convert(F.lit(raw), target, now=F.lit(NOW), **options).alias("c")).first()["c"]
    return row["value"], row["error"]


@pytest.mark.parametrize("raw,target,expected", [
    ("12", "int", 12), (" 12 ", "int", 12), ("255", "byte", 255), ("1.5", "double", 1.5), ("1e3", "double", 1000.0), ("TRUE", "boolean", True),
    ("9:05", "time", "09:05:00"), ("23:59:58.5", "time", "23:59:58"), ("2024-02-29", "date", dt.date(2024, 2, 29)),
    ("2/29/2024", "date", dt.date(2024, 2, 29)), ("today", "date", dt.date(2024, 3, 31)), ("today-1m", "date", dt.date(2024, 2, 29)),
    ("today+1y", "date", dt.date(2025, 3, 31)), ("now-1w", "date", dt.date(2024, 3, 24)), ("null", "string", None), ("NULL", "int", None),
    ("{8F1B9C6E-2A4D-5E7F-9B3C-6D8E0F2A4B5C}", "guid", "8f1b9c6e-2a4d-5e7f-9b3c-6d8e0f2a4b5c"),
    ("1.02:03:04", "timespan", dt.timedelta(days=1, hours=2, minutes=3, seconds=4)), ("-00:30", "timespan", dt.timedelta(minutes=-30)),
    ("3", "timespan", dt.timedelta(days=3)),
])
def test_values_that_fit(spark, raw, target, expected):
    assert convert(spark, raw, target) == (expected, None)


@pytest.mark.parametrize("raw,target", [
    ("1.5", "int"), ("99999999999", "int"), ("256", "byte"), ("-1", "byte"), ("yes", "boolean"), ("24:00", "time"), ("2023-02-29", "date"),
    ("yesterday", "date"), ("today+3", "date"), ("8f1b", "guid"), ("", "int"), ("Unknown", "enum")])
def test_values_that_do_not_fit_are_reported(spark, raw, target):
    options = {"enum_values": ("Draft", "Paid")} if target == "enum" else {}
    value, error = convert(spark, raw, target, **options)
    assert value is None and error == f'Cannot convert "{raw}" to {target}'


def test_null_for_a_required_value_is_an_error(spark):
    assert convert(spark, "null", "int", nullable=False) == (None, 'Cannot convert "null" to int')


@pytest.mark.parametrize("raw", ["Written_Off", "written_off", "WRITTEN _OFF", "2"])
def test_enum_spellings(spark, raw):
    assert convert(spark, raw, "enum", enum_values=("Draft", "Paid", "Written_Off"))[0] == "Written_Off"


@pytest.mark.parametrize("a,b,same", [
    ("7", "7", True), ("007", "7", False), ("633.80", "633.8", True), ("1", "1.0", True), (None, None, True), (None, "", False), ("x", "X", False),
    ("2024-01-02T03:04:05Z", "2024-01-02 03:04:05", True), ("2024-01-02T03:04:05.0000001", "2024-01-02T03:04:05", True),
    ("2024-01-02T03:04:05.000001", "2024-01-02T03:04:05", False), (".", ".", True), (".", "0.0", False)])
def test_values_equal(spark, a, b, same):
    df = spark.createDataFrame([(a, b)], "a string, b string")
    assert df.select(values_equal(F.col("a"), F.col("b"))).first()[0] is same


@pytest.mark.parametrize("plural,singular", [
    ("Customers", "Customer"), ("Categories", "Category"), ("Boxes", "Box"), ("status", "status"), ("Statuses", "Status"), ("People", "Person"),
    ("specimens", "specimen"), ("Addresses", "Address"), ("Customer", "Customer"), ("Invoices", "Invoice"), ("series", "series"), ("analyses", "analysis"),
    ("databases", "database"), ("cookies", "cookie"), ("olives", "olive"), ("movies", "movie"), ("ties", "tie"), ("lives", "life"), ("House Wives", "House Wife"),
    ("leaves", "leaf"), ("phases", "phase"), ("theses", "thesis"), ("bases", "basis"), ("replies", "reply"), ("genies", "genie"), ("valves", "valve")])
def test_singular(spark, plural, singular):
    assert spark.range(1).select(nm.singularize(F.lit(plural))).first()[0] == singular


# A hundred plurals of names that tables have.
PLURALS = """
index:indices index:indexes appendix:appendices matrix:matrices vertex:vertices vortex:vortices cortex:cortices codex:codices apex:apices cache:caches niche:niches
headache:headaches avalanche:avalanches axis:axes gas:gases bus:buses virus:viruses status:statuses alias:aliases bonus:bonuses canvas:canvases lens:lenses bias:biases campus:campuses
focus:focuses house:houses cause:causes clause:clauses expense:expenses purchase:purchases lease:leases license:licenses response:responses warehouse:warehouses course:courses
address:addresses class:classes process:processes box:boxes tax:taxes fax:faxes branch:branches match:matches batch:batches patch:patches search:searches dish:dishes brush:brushes
waltz:waltzes quiz:quizzes size:sizes prize:prizes crisis:crises analysis:analyses diagnosis:diagnoses hypothesis:hypotheses thesis:theses parenthesis:parentheses category:categories company:companies
city:cities country:countries policy:policies entry:entries inquiry:inquiries soliloquy:soliloquies cookie:cookies movie:movies tie:ties day:days key:keys survey:surveys shelf:shelves
bookshelf:bookshelves half:halves wolf:wolves thief:thieves knife:knives wife:wives life:lives leaf:leaves loaf:loaves olive:olives sleeve:sleeves hero:heroes potato:potatoes
photo:photos shoe:shoes toe:toes menu:menus guru:gurus salesman:salesmen woman:women child:children person:people mouse:mice foot:feet tooth:teeth criterion:criteria phenomenon:phenomena
price:prices service:services device:devices invoice:invoices office:offices slice:slices user:users order:orders item:items specimen:specimen series:series news:news lens:lens gas:gas
SalesPerson:SalesPeople OrderStatus:OrderStatuses PriceIndex:PriceIndices order_item:order_items HouseWife:HouseWives UserChild:UserChildren data:data iris:iris
"""


def test_a_hundred_plurals(spark):
    pairs = [tuple(p.split(":")) for p in PLURALS.split()]
    assert len(pairs) > 100
    made = spark.createDataFrame(pairs, "singular string, plural string").withColumn("got", nm.singularize(F.col("plural"))).collect()
    assert [(r["plural"], r["got"]) for r in made if r["got"] != r["singular"]] == []
    # what is singular already stays
    again = spark.createDataFrame([(a,) for a, _ in pairs], "singular string").withColumn("got", nm.singularize(F.col("singular"))).collect()
    assert [(r["singular"], r["got"]) for r in again if r["got"] != r["singular"]] == []


def test_strip_and_expand(spark):
    row = spark.range(1).select(
        nm.strip_pattern(F.lit("CustomerENTITY"), "{Name}Entity"), nm.strip_pattern(F.lit("Entity"), "{Name}Entity"),
        nm.strip_pattern(F.lit("Customer"), "no placeholder"), nm.expand_pattern("I{Name}Repository", F.lit("Order"))).first()
    assert tuple(row) == ("Customer", "Entity", "Customer", "IOrderRepository")
