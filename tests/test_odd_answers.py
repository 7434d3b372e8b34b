"""Answers around documents without letters, text or language: the rows of the SQL, whole."""

import duckdb
import pytest

from tests.test_oracles import rows
from tidewell.functions import markdown as M
from tidewell.plans import queries as plans

ODD = [(1, "", "en"), (2, "4539 3880-8820 =", "de"), (3, None, "fr"), (4, "some words", None), (5, None, None), (6, "one", ""), (7, " =(a)= b. ", "="), (8, "--", ""), (9, "two\nWörter", "es"), (10, " ", "fr")]


@pytest.mark.parametrize("name", ["answer_bullets", "parsed_answers"])
def test_same_rows_of_odd_documents(spark, tmp_path, name):
    path = f"{tmp_path}/documents.parquet"
    spark.createDataFrame(ODD, "doc_id long, text string, lang string").write.parquet(path)
    df = plans.QUERIES[name](spark, str(tmp_path))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{path}/*.parquet'")
    result = con.execute(plans.ORACLE_SQL[name])
    assert rows(df.columns, df.collect()) == rows([x[0] for x in result.description], result.fetchall())


def test_the_grammar_trims():
    """As in the reference: a bullet without words of its own starts with what follows them."""
    assert M.split_bullets("## A\n- \r\n  more")[0]["text"] == "more"
    assert M.parse_answer("## First\n-  [One](https://a.example/)")["themes"][0]["points"][0]["text"] == "[One](https://a.example/)"
