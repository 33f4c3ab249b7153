"""Pages whose character references lack a semicolon, are cut short or are numbers: the SQL states HTML's rule, as the queries do."""

import html
from pathlib import Path

import duckdb
import pytest

from factloom import plans

FOLDER = Path("/root/testdata/sf0.001")
BODIES = ["a&amp<p>b", "a &am<b>p; c</b>", "cut &qu", "&copy2024 &middot &notit; &notin;", "&#65&#x42; &#8364 &#150; &#xD800; &#99999999999999999999;", "R&D & more &unknown; &", "&lt;p&gt; &nbsp &AMP"]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    own = tmp_path_factory.mktemp("references")
    for file in FOLDER.glob("*.parquet"):
        if file.stem != "pages":
            (own / file.name).symlink_to(file)
    rows = [(k, f"https://a.example.org/{k}", f"<html><head><title>x &amp y</title></head><body><h1>t{k}</h1><p>{x}</p></body></html>") for k, x in enumerate(BODIES)]
    spark.createDataFrame(rows, "page_id long, url string, html string").coalesce(1).write.parquet(str(own / "pages.parquet"))
    return own


@pytest.mark.parametrize("name", ["extract_html", "extract_snapshots", "extraction_sink"])
def test_pages_equal_oracle(spark, folder, name):
    duck = duckdb.connect()
    for file in folder.glob("*.parquet"):
        duck.execute(f"create view {file.stem} as select * from '{file if file.is_file() else f'{file}/*.parquet'}'")
    wanted = duck.execute(plans.ORACLES[name])
    names = [d[0] for d in wanted.description]
    found = plans.QUERIES[name](spark, str(folder)).select(*names).collect()
    assert sorted(map(str, map(tuple, found))) == sorted(map(str, wanted.fetchall()))


def test_references_as_the_library_reads_them():
    from factloom.plans.text import _REFERENCE

    cases = [c for n in html.entities.html5 for c in (n, n + "x", n[:-1])] + [f"#{n};" for n in (*range(300), 0xFFFF, 0x110000)] + [f"#x{n:x}" for n in range(300)]
    duck = duckdb.connect()
    found = duck.execute(f"select p, {_REFERENCE} from (select unnest($1) as p)", [cases]).fetchall()
    assert [(p, text) for p, text in found if text != html.unescape("&" + p)] == []
