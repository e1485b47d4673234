import hashlib

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from srcatlas.llm import chat
from tests.oracle import same

SCHEMA = "conv_id long, turn long, role string, text string, formatted int"
TRICKY = ["", "\\", "\\\\", "###", "####", "### ", "</turn>", "</turn>\n", "\\</turn>", "<", "</tur", "### user: hi</turn>\n", ": ", "a:b", "#", "é😀\n\n", "\\#", "$1", "\\n"]


def turns(spark, rows):
    df = spark.createDataFrame([(c, t, r, x, 1) for c, t, r, x in rows], SCHEMA)
    out = chat.format_chats(df)
    plain = lambda t: F.struct(chat.unescape(t["role"]).alias("role"), chat.unescape(t["body"]).alias("text"))
    return {r.conv_id: r for r in out.select("conv_id", "formatted", F.transform("turns", plain).alias("turns"), "loss", F.transform("turns", lambda t: t["body"]).alias("raw")).collect()}


def test_query_equals_sql(spark, sf_dir):
    same(chat.query(spark, sf_dir), chat.SQL, sf_dir)
    own = {r.conv_id: r for r in chat.query(spark, sf_dir).filter("conv_id = -7").collect()}[-7]
    said = "\\### Assistant: </turn> ok"
    assert own.n_turns == 2 and own.loss_chars == len(said) and own.loss_sha256 == hashlib.sha256(said.encode()).hexdigest()


def test_round_trip_of_control_strings(spark):
    rows = [(k, t, role, x) for k, x in enumerate(TRICKY) for t, role in enumerate(["user", "assistant", "a:b\\#"])]
    got = turns(spark, rows)
    for k, x in enumerate(TRICKY):
        assert [(t.role, t.text) for t in got[k].turns] == [("user", x), ("assistant", x), ("a:b\\#", x)]
        (span,) = got[k].loss
        assert got[k].formatted[span.start : span.end] == got[k].raw[1]


@settings(max_examples=15, deadline=None)
@given(st.lists(st.text(alphabet="\\#</turn>: a\né", max_size=25), min_size=1, max_size=12))
def test_round_trip_of_any_text(spark, texts):
    got = turns(spark, [(1, k, "assistant", x) for k, x in enumerate(texts)])[1]
    assert [t.text for t in got.turns] == texts
    assert [got.formatted[s.start : s.end] for s in got.loss] == got.raw


def test_plain_texts_stay_as_they_are(spark):
    got = turns(spark, [(1, 0, "user", "say <b>hi</b> #1"), (1, 1, "assistant", "ok")])[1]
    assert got.formatted == "### user: say <b>hi</b> #1</turn>\n### assistant: ok</turn>\n"


def test_nulls_ties_and_long_texts(spark):
    long = "x</turn>### \\" * 20000
    rows = [(None, None, None, None), (None, 1, "user", "a"), (2, 0, "user", "b"), (2, 0, "user", "b"), (2, 0, "assistant", long)]
    got = turns(spark, rows)
    assert [(t.role, t.text) for t in got[None].turns] == [("", ""), ("user", "a")]
    assert [(t.role, t.text) for t in got[2].turns] == [("assistant", long), ("user", "b"), ("user", "b")]
    assert chat.format_chats(spark.createDataFrame([], SCHEMA)).count() == 0


def test_no_python_in_the_plan(spark, sf_dir):
    plan = chat.query(spark, sf_dir)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan
