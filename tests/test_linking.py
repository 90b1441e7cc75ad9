"""References inside generation and update, teardown of a whole run, datasets from files."""

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from synthframe.functions.identity import uuid5_natural
from synthframe.operators import cleanup, generate as gen, verbs as vb
from synthframe.operators.linking import Reference, link, reference_findings, reference_for
from synthframe.sources import readers as rd
from synthframe.spec import EntitySpec, ForeignKey

TEXT = T.StringType()
ORDER = EntitySpec("Sales", "Order", T.StructType([T.StructField(n, TEXT) for n in ("Id", "Number", "CustomerId", "Note")]), key="Id", natural_key="Number",
                   foreign_keys=(ForeignKey("CustomerId", "Customer", "Sales"),))


@pytest.fixture(scope="module")
def stored(spark):
    return spark.createDataFrame([("c1", "Ann"), ("c2", "Bob"), ("c3", "Twin"), ("c4", "Twin"), ("c5", None)], "id string, name string")


@pytest.fixture(scope="module")
def context(spark):
    return spark.createDataFrame([("customers", "Cid", "x0", 1), ("Customer", "Cid", "x1", 2), ("Customer", "Cid", "x2", 3), ("Customers", "Ann", "x9", 9), ("Order", "Bob", "o1", 4), ("customer", None, "n", 5)],
                                 "entity string, key string, id string, seq long")


def test_context_then_table_then_finding(spark, stored, context):
    refs = spark.createDataFrame([(1, "Ann"), (2, "Bob"), (3, "Cid"), (4, "Twin"), (5, "Nobody"), (6, None), (7, "Bob")], "n long, who string")
    reference = Reference("CustomerId", "Customers", "who", stored, "name", "id")
    linked = link(refs, [reference], context)
    got = {r["n"]: (r["CustomerId"], r["CustomerId_reference"]["resolved_from"]) for r in linked.collect()}
    assert got == {1: ("x9", "contextBag"), 2: ("c2", "database"), 3: ("x0", "contextBag"), 4: (None, None), 5: (None, None), 6: (None, None), 7: ("c2", "database")}
    assert sorted(map(tuple, reference_findings(linked, [reference], "n").collect())) == [(4, "Customers", "Twin", "ambiguous"), (5, "Customers", "Nobody", "not found")]


def test_the_name_as_given_goes_before_its_singular(spark, context):
    refs = spark.createDataFrame([(1, "Cid")], "n long, who string")
    assert link(refs, [Reference("fk", "customer", "who")], context).first()["fk"] == "x2"


def test_outside_entities_are_computed(spark, stored):
    refs = spark.createDataFrame([(1, "Ann"), (2, "Zoe"), (3, None), (4, "Twin")], "n long, who string")
    linked = link(refs, [Reference("fk", "Customer", "who", stored, "name", "id", domain="Crm")])
    zoe = spark.range(1).select(uuid5_natural("Crm", "Customer", F.lit("Zoe"))).first()[0]
    assert {r["n"]: (r["fk"], r["fk_reference"]["resolved_from"], r["fk_reference"]["problem"]) for r in linked.collect()} == {
        1: ("c1", "database", None), 2: (zoe, "identityContract", None), 3: (None, None, None), 4: (None, None, "ambiguous")}


def test_generation_links_before_identity(spark, stored):
    rows = spark.createDataFrame([(1, "Ann"), (2, "Nobody")], "ordinal long, who string")
    reference = reference_for(ORDER, "Customer", "who", table=stored, natural_key="name", row_id="id")
    plan = gen.GenerationPlan(spec=ORDER, seed=1, rules=(("Number", lambda d: F.concat(F.lit("O-"), d.ordinal.cast("string"))),), references=(reference,))
    out = {r["ordinal"]: r for r in gen.generate(rows, plan).collect()}
    assert out[1]["CustomerId"] == "c1" and out[2]["CustomerId"] is None and out[2]["Id"] is not None
    assert [r["key"] for r in reference_findings(gen.generate(rows, plan), [reference], "ordinal").collect()] == ["Nobody"]
    with pytest.raises(ValueError, match="no foreign key"):
        reference_for(ORDER, "Carrier", "who")


def test_two_references_and_one_hot_key(spark, stored):
    rows = spark.range(4000).select(F.col("id").alias("n"), F.lit("Ann").alias("who"), F.when(F.col("id") % 2 == 0, "Bob").alias("other"))
    linked = link(rows, [Reference("a", "Customer", "who", stored, "name", "id"), Reference("b", "Customer", "other", stored, "name", "id")])
    assert [tuple(r) for r in linked.groupBy("a", "b").count().orderBy("b").collect()] == [("c1", None, 2000), ("c1", "c2", 2000)]


def test_update_sets_a_foreign_key_by_name(spark, stored):
    orders = spark.createDataFrame([("o1", "N1", "c9", "a"), ("o2", "N2", "c9", "b"), ("o3", "N3", "c9", "c"), ("o4", "N3", "c9", "d"), ("o5", "N5", "c9", "e")], "Id string, Number string, CustomerId string, Note string")
    changes = spark.createDataFrame([("N1", 1, "Ann", None), ("N1", 2, "Bob", "z"), ("N2", 1, "Nobody", "y"), ("N3", 1, "Ann", "x"), ("N5", 1, None, "w"), ("N9", 1, "Nobody", "v")], "Number string, seq int, who string, Note string")
    references = (Reference("CustomerId", "Customer", "who", stored, "name", "id"),)
    out = vb.update_by_key(orders, changes, "Number", ["Note"], ["seq"], references)
    assert sorted(map(tuple, out.collect())) == [("o1", "N1", "c2", "z"), ("o2", "N2", "c9", "y"), ("o3", "N3", "c9", "c"), ("o4", "N3", "c9", "d"), ("o5", "N5", "c9", "w")]
    assert [tuple(r) for r in vb.update_findings(orders, changes, "Number", references, ["seq"]).collect()] == [("N2", "Customer", "Nobody", "not found")]


def spec(entity, *fks, key="id"):
    return EntitySpec("D", entity, T.StructType([T.StructField(key, TEXT)] + [T.StructField(c, TEXT) for c, _ in fks]), key=key, foreign_keys=tuple(ForeignKey(c, e) for c, e in fks))


def run_teardown(spark, specs, tables, ids):
    entities = spark.createDataFrame([("D", e, i, "Create") for e, i in ids] + [("D", e, i, "Update") for e in tables for i in ("u",)], "domain string, entity string, id string, verb string")
    bulk = spark.createDataFrame([(1, "D", "A", 10, 4, 6), (2, "D", "A", 3, 3, 0)], "scenario_seq int, domain string, entity string, count long, sampled_rows long, hashed_rows long")
    frames = {f"D.{e}": spark.createDataFrame(rows, ", ".join(f"{f.name} string" for f in next(s for s in specs if s.entity == e).schema.fields)) for e, rows in tables.items()}
    done = cleanup.teardown_run(entities, bulk, specs, frames)
    rest = {n: sorted(r["id"] for r in df.collect()) for n, df in done.rest.items()}
    return rest, {r["entity"]: (r["wanted"], r["deleted"], r["gone"], r["orphaned"]) for r in done.counts.collect()}, {(r["entity"], r["id"]): (r["children"], r["reason"]) for r in done.orphans.collect()}, done.warnings.collect()


def test_children_go_before_parents_and_blocked_rows_block_their_parents(spark):
    specs = [spec("A"), spec("B", ("a", "A")), spec("C", ("b", "B"))]
    assert [[s.entity for s in c] for c in cleanup.teardown_components(specs)] == [["C"], ["B"], ["A"]]
    tables = {"A": [("a1",), ("a2",), ("a3",)], "B": [("b1", "a1"), ("b2", "a2"), ("b3", None)], "C": [("c1", "b1"), ("c2", "b2"), ("c3", "b2")]}
    rest, counts, orphans, warnings = run_teardown(spark, specs, tables, [("A", "a1"), ("A", "a2"), ("A", "a3"), ("B", "b1"), ("B", "b2"), ("B", "b9"), ("C", "c1"), ("Ghost", "g")])
    assert rest == {"D.A": ["a2"], "D.B": ["b2", "b3"], "D.C": ["c2", "c3"]}
    assert counts == {"A": (3, 2, 0, 1), "B": (3, 1, 1, 1), "C": (1, 1, 0, 0)}
    assert orphans == {("B", "b2"): (2, "2 row(s) of C refer to it"), ("A", "a2"): (1, "1 row(s) of B refer to it"), ("Ghost", "g"): (None, "entity not configured")}
    assert [w["warning"] for w in warnings] == ["only 4 of 10 A rows were recorded one by one and can be removed"]


def test_a_circle_of_foreign_keys(spark):
    specs = [spec("A", ("b", "B")), spec("B", ("a", "A"))]
    assert len(cleanup.teardown_components(specs)) == 1
    # a1 and b1 refer to each other and go; b4 stays, so a4 does, and so do b3 and a3 that a chain leads to
    tables = {"A": [("a1", "b1"), ("a3", None), ("a4", "b3"), ("a5", None)], "B": [("b1", "a1"), ("b3", "a3"), ("b4", "a4")]}
    rest, counts, orphans, _ = run_teardown(spark, specs, tables, [("A", "a1"), ("A", "a3"), ("A", "a4"), ("A", "a5"), ("B", "b1"), ("B", "b3")])
    assert rest == {"D.A": ["a3", "a4"], "D.B": ["b3", "b4"]}
    assert counts == {"A": (4, 2, 0, 2), "B": (2, 1, 0, 1)} and set(orphans) == {("A", "a3"), ("A", "a4"), ("B", "b3")}


def test_a_table_that_refers_to_itself(spark):
    specs = [spec("E", ("boss", "E"))]
    rest, counts, _, _ = run_teardown(spark, specs, {"E": [("e1", None), ("e2", "e1"), ("e3", "e2"), ("f1", None), ("f2", "f1"), ("s", "s")]}, [("E", e) for e in ("e1", "e2", "f1", "f2", "s")])
    assert rest == {"D.E": ["e1", "e2", "e3"]} and counts == {"E": (5, 3, 0, 2)}


def test_dataset_of_several_files(spark, tmp_path):
    (tmp_path / "a.csv").write_text('City,Zip\n"Up\ntown",1\nB,2\n')
    (tmp_path / "b.csv").write_text('City,Zip\n\nC,3\nD,\n"E ""x""",5\n')
    made = rd.load_dataset(spark, "cities", str(tmp_path))
    assert made.rows == 5 and [tuple(r) for r in made.table.orderBy("row_id").collect()] == [("Up\ntown", "1", 0), ("B", "2", 1), ("C", "3", 2), ("D", "", 3), ('E "x"', "5", 4)]
    assert made.column("zip") == "Zip"
    (tmp_path / "c.csv").write_text("Town,Zip\nF,6\n")
    with pytest.raises(Exception, match="(?i)header|schema"):
        rd.load_dataset(spark, "cities", str(tmp_path))
