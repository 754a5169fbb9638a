"""Rationales, curves and packing read whole answers, and their SQL has no bound on words."""

import os

import duckdb
import pytest

from tidemark.plans import bindings, catalogue

NAMES = ("topk_rationale", "comp_suff", "deletion_auc", "perturbation", "minmax_scores", "head_tail")


@pytest.fixture(scope="module")
def duck(data):
    c = duckdb.connect()
    for f in os.listdir(data):
        c.execute(f"create view {f.split('.')[0]} as select * from '{data}/{f}'")
    return c


@pytest.mark.parametrize("name", NAMES)
def test_whole_answers_agree_with_the_sql(spark, data, duck, name):
    sql = catalogue.oracle_sql()[name]
    want = duck.execute(sql)
    cols = [d[0] for d in want.description]
    key = ("pair_id", "position") if "position" in cols else ("pair_id",)
    want = {tuple(r[cols.index(k)] for k in key): r for r in want.fetchall()}
    got = {tuple(r[k] for k in key): r for r in catalogue.queries()[name](spark, data).collect()}
    assert got.keys() == want.keys()
    for k, w in want.items():
        for c, v in zip(cols, w):
            g = got[k][c]
            assert g == (pytest.approx(v, abs=2e-6) if isinstance(v, float) else v), (k, c)  # sums in another order may round a last digit the other way


def test_no_answer_with_words_is_left_out(spark, data, duck):
    whole = {r[0] for r in duck.execute(catalogue.oracle_sql()["minmax_scores"]).fetchall()}
    sizes = {r["pair_id"]: len(r["tokens"]) for r in bindings.tokens(spark, data).collect()}
    assert set(sizes) == whole and max(sizes.values()) > 40
    r = catalogue.queries()["random_rationale"](spark, data).collect()
    assert {x["pair_id"] for x in r} == whole and all(x["random_n"] == 25 for x in r)
