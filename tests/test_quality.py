"""Audits of keys and references against brute force, and deletion along a graph."""

import random
from collections import Counter

import pytest

from factloom.operators import quality
from factloom.sources import rules


def frame(spark, rows, ddl):
    return spark.createDataFrame(rows, ddl).repartition(3)


@pytest.fixture(scope="module")
def data():
    r = random.Random(8)
    one = lambda *x: r.choice(x)
    parents = [(i, one("x", "y", None, "x"), one(1, 2, None)) for i in [*range(40), 3, 3, None]]
    # a third of the children refer to one parent
    children = [(i % 90, one(7, r.randrange(60), r.randrange(60), None), one("x", "y", "z", None, "a,b", "a"), one(1, 2, 3, None)) for i in range(300)]
    return parents, children


def test_unique(spark, data):
    parents, children = data
    p, c = frame(spark, parents, "id long, name string, n int"), frame(spark, children, "id long, parent long, name string, n int")
    rules_of = {"p(id)": (parents, [0]), "p(name,n)": (parents, [1, 2]), "c(id)": (children, [0]), "c(parent,name)": (children, [1, 2]), "c(id,parent,name,n)": (children, [0, 1, 2, 3])}
    found = quality.audit_unique([(p, {"p(id)": ["id"], "p(name,n)": ["name", "n"]}), (c, {"c(id)": ["id"], "c(parent,name)": ["parent", "name"], "c(id,parent,name,n)": ["id", "parent", "name", "n"]})])
    wanted = {}
    for name, (rows, at) in rules_of.items():
        n = [x for x in Counter(k for k in (tuple(row[i] for i in at) for row in rows) if None not in k).values() if x > 1]
        wanted[name] = (len(n), sum(n))
    assert {r.rule: (r.groups, r.rows) for r in found.collect()} == wanted
    none = quality.audit_unique([(p.limit(0), {"p(id)": ["id"]}), (c, {})])
    assert [tuple(r) for r in none.collect()] == [("p(id)", 0, 0)]


def test_keys_of_joined_texts_differ(spark):
    """'a' and 'b,c' are not 'a,b' and 'c'."""
    df = frame(spark, [("a", "b,c"), ("a,b", "c"), ("a", "b,c")], "x string, y string")
    assert [tuple(r) for r in quality.audit_unique([(df, {"k": ["x", "y"]})]).collect()] == [("k", 1, 2)]


def test_references(spark, data):
    parents, children = data
    tables = {"p": frame(spark, parents, "id long, name string, n int"), "c": frame(spark, children, "id long, parent int, name string, n int")}
    references = [("r1", "c", ["parent"], "p", ["id"]), ("r2", "c", ["name", "n"], "p", ["name", "n"]), ("r3", "c", ["id"], "p", ["id"]), ("r4", "c", ["parent"], "c", ["id"]), ("r5", "p", ["id"], "c", ["parent"])]
    at = {"p": {"id": 0, "name": 1, "n": 2}, "c": {"id": 0, "parent": 1, "name": 2, "n": 3}}
    rows = {"p": parents, "c": children}
    pick = lambda name, columns: [tuple(row[at[name][c]] for c in columns) for row in rows[name]]
    wanted = {rule: sum(None not in k and k not in set(pick(parent, keys)) for k in pick(child, columns)) for rule, child, columns, parent, keys in references}
    assert {r.rule: r.orphans for r in quality.audit_foreign_keys(tables, references).collect()} == wanted
    empty = {"p": tables["p"].limit(0), "c": tables["c"]}
    assert {r.rule: r.orphans for r in quality.audit_foreign_keys(empty, references[:1]).collect()} == {"r1": sum(x[1] is not None for x in children)}


def deleted(spark, tables, references, seed_table, seeds):
    frames = {name: (frame(spark, rows, ddl), key) for name, (rows, ddl, key) in tables.items()}
    key = frames[seed_table][1]
    ddl = ", ".join(f"{c} long" for c in ([key] if isinstance(key, str) else key))
    return {tuple(r) for r in quality.propagate_deletes(frames, references, seed_table, spark.createDataFrame(seeds, ddl)).collect()}


def test_a_chain_of_ten(spark):
    """A table that refers to itself, over ten rows, and one beside that is in use."""
    topics = [(i, i - 1 if i else None) for i in range(10)] + [(20, None), (21, 20), (22, 21)]
    tables = {"topics": (topics, "topic_id long, parent_id long", "topic_id"), "notes": ([(1, 22), (2, 5)], "note_id long, topic_id long", "note_id")}
    links = [("topics", ["parent_id"], "topics", ["topic_id"], "CASCADE"), ("notes", ["topic_id"], "topics", ["topic_id"], "SET_NULL")]
    assert deleted(spark, tables, links, "topics", [(0,)]) == {("topics", str(i), "DELETE") for i in range(10)} | {("notes", "2", "SET_NULL")}
    links[1] = (*links[1][:4], "RESTRICT")
    assert deleted(spark, tables, links, "topics", [(6,), (20,)]) == {("topics", str(i), "DELETE") for i in range(6, 10)} | {("topics", "20", "BLOCKED")}
    restricted = [rules.REFERENCES[0]]
    assert deleted(spark, tables, restricted, "topics", [(9,), (8,), (22,)]) == {("topics", "9", "DELETE"), ("topics", "22", "DELETE"), ("topics", "8", "BLOCKED")}


def test_a_circle(spark):
    tables = {"a": ([(1, 2), (2, 3), (3, 1), (4, 4), (5, None)], "id long, next long", "id")}
    assert deleted(spark, tables, [("a", ["next"], "a", ["id"], "CASCADE")], "a", [(1,), (4,)]) == {("a", str(i), "DELETE") for i in (1, 2, 3, 4)}


def test_composite_and_mixed(spark):
    """Declared references of several columns, to a key and to columns beside it; an item's own reference to its option stops nothing."""
    tables = {
        "claim_extraction_runs": ([(1,), (2,), (3,)], "run_id long", "run_id"),
        "claim_extraction_claims": ([(1, 10), (1, 11), (2, 10)], "run_id long, claim_id long", ["run_id", "claim_id"]),
        "claim_extraction_evidence": ([(1, 7), (2, 7)], "run_id long, evidence_id long", ["run_id", "evidence_id"]),
        "claim_extraction_citations": ([(1, 10, 7), (1, 11, 7), (2, 10, 7), (2, 99, 7), (2, None, 7)], "run_id long, claim_id long, evidence_id long", ["run_id", "claim_id", "evidence_id"]),
        "question_bank_items": ([(5, 50), (6, 60)], "item_id long, correct_option_id long", "item_id"),
        "question_bank_options": ([(50, 5), (51, 5), (60, 6)], "option_id long, item_id long", "option_id"),
        "content_package_question_bank_items": ([(1, 6)], "package_id long, item_id long", ["package_id", "item_id"]),
    }
    run = deleted(spark, tables, rules.REFERENCES, "claim_extraction_runs", [(1,), (3,)])
    assert run == {(f"claim_extraction_{t}", i, "DELETE") for t, i in [("runs", "1"), ("runs", "3"), ("claims", "1:10"), ("claims", "1:11"), ("evidence", "1:7"), ("citations", "1:10:7"), ("citations", "1:11:7")]}
    assert deleted(spark, tables, rules.REFERENCES, "claim_extraction_evidence", [(2, 7)]) == {("claim_extraction_evidence", "2:7", "DELETE"), ("claim_extraction_citations", "2:10:7", "DELETE"), ("claim_extraction_citations", "2:99:7", "DELETE"), ("claim_extraction_citations", "2:7", "DELETE")}
    items = deleted(spark, tables, rules.REFERENCES, "question_bank_items", [(5,), (6,)])
    assert items == {("question_bank_items", "6", "BLOCKED"), ("question_bank_items", "5", "DELETE"), ("question_bank_options", "50", "DELETE"), ("question_bank_options", "51", "DELETE")}
    assert deleted(spark, tables, rules.REFERENCES, "question_bank_options", [(50,), (51,)]) == {("question_bank_options", "50", "BLOCKED"), ("question_bank_options", "51", "DELETE")}


def test_what_two_seeds_reach(spark):
    """A row that a seed that stays and one that goes both reach goes."""
    tables = {"a": ([(1,), (2,)], "id long", "id"), "b": ([(7, 1), (7, 2)], "id long, a long", "id"), "c": ([(1, 1)], "id long, a long", "id")}
    links = [("b", ["a"], "a", ["id"], "CASCADE"), ("c", ["a"], "a", ["id"], "RESTRICT")]
    assert deleted(spark, tables, links, "a", [(1,), (2,)]) == {("a", "1", "BLOCKED"), ("a", "2", "DELETE"), ("b", "7", "DELETE")}
    assert deleted(spark, tables, links, "a", []) == set()


def test_every_declared_check_runs(spark):
    """Each check reads columns of its own table, holds for no row of nulls as broken, and counts one of each kind that is."""
    from factloom.sources import schemas

    for name in ("source_snapshots", "source_fetch_runs", "ai_execution_runs", "ai_prompt_versions", "note_drafts"):
        empty = spark.sql("SELECT " + ", ".join(f"CAST(NULL AS {k}) AS {c}" for c, k in schemas.kinds(name).items()))
        assert {r.rule: r.violations for r in quality.audit_checks(empty, schemas.CHECKS[name]).collect()} == dict.fromkeys(schemas.CHECKS[name], 0)
    run = spark.sql("SELECT 'SUCCEEDED' AS status, CAST(NULL AS STRING) AS error_code, ' ' AS requested_url, 'https://a.org' AS final_url, 404 AS http_status, 1L AS run_id, 1L AS source_id, current_timestamp() AS created_at")
    found = {r.rule for r in quality.audit_checks(run, schemas.CHECKS["source_fetch_runs"]).where("violations > 0").collect()}
    assert found == {"source_fetch_runs.requested_url", "source_fetch_runs.succeeded"}
