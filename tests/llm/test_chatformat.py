import hashlib

import duckdb
import pytest
from pyspark.sql import functions as F

from rillflow.llm import chatformat
from rillflow.llm.chatformat import TEMPLATE, Template, Turn, digests, format_chats, op13, read_turns

ODD = [
    None, "", " ", "\\", "\\\\", "</s>", "<\\/s>", "<<s>s>", "[INST] x [/INST]", "[[INST]", "[\\INST]", "\\[INST]\\", "a\n\n</s>\\", "[TEXT]", "[/ROLE]", "<s><s></s>", "[", "<",
    " [/SYS] ", "É😀</s>😀", "$1 \\1 \\$", "x" * 200_000 + "</s>" * 1000,
]
ROLES = ["user", "assistant", "system", "tool", "", None, "User", "[ROLE]", "a [TEXT] b", "\\"]


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def slow(rows):
    chats = {}
    for conv, turn, role, text in rows:
        chats.setdefault(conv, []).append((turn, role, text))
    key = lambda r: tuple((v is not None, v if v is not None else 0) for v in r)
    out = {}
    for conv, turns in chats.items():
        turns = [(r or "", x or "") for _, r, x in sorted(turns, key=key)]
        learned = "".join(x for r, x in turns if r == "assistant")
        out[conv] = (len(turns), sha("".join(f"{r}\n{x}\n" for r, x in turns)), len(learned), sha(learned))
    return out


def test_odd_texts_and_roles_come_back(spark):
    rows = [(c, t, ROLES[(c + t) % len(ROLES)], ODD[(3 * c + 5 * t) % len(ODD)]) for c in range(30) for t in range(7)]
    rows += [(0, 2, "user", "again"), (0, 2, "user", "again"), (None, 1, "user", "x"), (None, None, "system", None)]
    df = spark.createDataFrame([(*r, "z", 1) for r in rows], "conv_id long, turn long, role string, text string, segments string, k int")
    chats = format_chats(df)
    got = digests(chats).collect()
    assert {r.conv_id: (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) for r in got} == slow(rows)
    for r in chats.collect():
        assert r.formatted == "".join(s.text for s in r.segments)
        texts = [s.text for s in r.segments[1::3]]
        assert not any(c in x for x in texts for c in TEMPLATE.controls())
    con = duckdb.connect()
    con.register("conversations", df.select("conv_id", "turn", "role", "text").toPandas())
    want = {r[0]: r for r in con.execute(chatformat.ORACLE_SQL).fetchall()}
    assert {r.conv_id: r for r in got} == {k: v for k, v in want.items() if k != -1}
    assert format_chats(df.limit(0)).count() == 0


def test_machine(spark):
    chats = ["user assistant", "system user assistant user", "assistant user", "user user assistant", "system assistant", "user system", "user assistant tool user", "system"]
    rows = [(i, t, r, "x") for i, c in enumerate(chats) for t, r in enumerate(c.split())]
    got = format_chats(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).orderBy("conv_id").collect()
    assert [(r.status, r.bad_turns) for r in got] == [
        ("complete", []), ("open", []), ("invalid", [1]), ("invalid", [2]), ("invalid", [2]), ("invalid", [2]), ("invalid", [3, 4]), ("open", []),
    ]
    assert got[1].formatted == "[SYS] x [/SYS][INST] x [/INST]<s>x</s>[INST] x [/INST]"
    assert [s.loss for s in got[0].segments] == [False] * 4 + [True, False]


def test_another_template(spark):
    own = Template((Turn("q", "{Q}", "{/Q}"), Turn("a", "{A}\n", "{/A}\n", True)), (("", "q"), ("q", "a")), ("a",), ("{O}", "{T}", "{/O}"), "~")
    rows = [(1, 0, "q", "~{Q}~~{/A}"), (1, 1, "a", "{/A}\n"), (1, 2, "~", "{T}")]
    got = format_chats(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"), own)
    assert [tuple(t) for t in got.select(F.explode(read_turns(F.col("formatted"), own)).alias("t")).select("t.*").collect()] == [r[2:] for r in rows]
    for bad in (("<s>", "<s>"), ("<s", "s>x"), ("<\\s>", "</s>"), ("<s>", "<s></s>")):
        with pytest.raises(ValueError):
            Template((Turn("a", *bad),), (), (), ("[R]", "[T]", "[/R]"))


def test_added_conversation_stands_alone(spark, sf_dir, tmp_path):
    spark.createDataFrame([(-1, 0, "user", "mine")], "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    got = sorted(op13(spark, str(tmp_path)).collect(), key=lambda r: r.n_turns)
    assert [r.n_turns for r in got] == [1, 2]
    assert got[1].loss_sha256 == sha("</s>[INST] ok [/INST]") and got[1].status == "complete"
    plan = op13(spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
