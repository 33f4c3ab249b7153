"""Characters that regular expressions, XML and Python's white space judge differently: the SQL states the rule of the queries over them."""

from pathlib import Path

import duckdb
import pytest

from factloom import plans

FOLDER = Path("/root/testdata/sf0.001")
TEXTS = ["a\u0890b \u0891", "a\U00013439b\U0001343f", "\0", "", " \u200b\n", "a\0\rb", "a" * 500 + "\u3000" * 3_000 + " " + "b" * 500, "\u3000" * 600 + " " + "b" * 2_000]
OPTIONS = ["a\x01b", "x\ufffe", "x\uffff", "a]]>b", "a]]b>", "a\tb\rc\x7f\x85", "\u0890 a & b < c > d", ""]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    own = tmp_path_factory.mktemp("odd")
    rows = {
        "documents": ([(168 * k + 1, x, "en", "src1", len(x)) for k, x in enumerate(TEXTS)], "doc_id long, text string, lang string, source string, n_chars long"),
        "pages": ([(k, f"https://a.example.org/{k}", f"<html><head></head><body><p>{x}</p></body></html>") for k, x in enumerate(TEXTS)], "page_id long, url string, html string"),
        "conversations": ([(3 * k + 1, 0, "user", x) for k, x in enumerate(OPTIONS)], "conv_id long, turn long, role string, text string"),
    }
    for file in FOLDER.glob("*.parquet"):
        if file.stem not in rows:
            (own / file.name).symlink_to(file)
    for name, (data, schema) in rows.items():
        spark.createDataFrame(data, schema).coalesce(1).write.parquet(str(own / f"{name}.parquet"))
    return own


@pytest.mark.parametrize("name", ["extract_snapshots", "extraction_sink", "chunk_text"])
def test_rows_equal_oracle(spark, folder, name):
    duck = duckdb.connect()
    for file in folder.glob("*.parquet"):
        duck.execute(f"create view {file.stem} as select * from '{file if file.is_file() else f'{file}/*.parquet'}'")
    wanted = duck.execute(plans.ORACLES[name])
    names = [d[0] for d in wanted.description]
    found = plans.QUERIES[name](spark, str(folder)).select(*names).collect()
    assert sorted(map(str, map(tuple, found))) == sorted(map(str, wanted.fetchall()))
