import hashlib

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from hornbeam.llm import chat

EVENTS = "conv_id long, message long, role string, seq long, kind string, text string"


def test_edits_and_regenerations_fold(spark):
    log = [(1, 0, "user", 0, "start", None), (1, 0, "user", 2, "delta", "lo"), (1, 0, "user", 1, "delta", "hel"), (1, 1, "assistant", 3, "start", ""), (1, 1, "assistant", 4, "delta", "bad"), (1, 1, "assistant", 5, "regenerate", None),
           (1, 1, "assistant", 6, "delta", "good"), (1, 1, "assistant", 7, "edit", "better"), (1, 1, "assistant", 8, "delta", "!"), (1, 2, "user", 9, "start", ""), (1, 2, "user", 10, "delete", None), (2, 5, "user", 1, "delta", "x")]
    got = chat.fold(spark.createDataFrame(log[::-1], EVENTS)).orderBy("conv_id", "first").collect()
    assert [(r["conv_id"], r["role"], r["text"]) for r in got] == [(1, "user", "hello"), (1, "assistant", "better!"), (2, "user", "x")]


def expected(turns):
    h, loss, n, size = hashlib.sha256(), hashlib.sha256(), 0, 0
    for role, text in turns:
        h.update(f"{role}\n{text}\n".encode())
        if role == "assistant":
            loss.update(text.encode())
            n += len(text)
    return len(turns), h.hexdigest(), n, loss.hexdigest()


def test_round_trip_of_control_strings(spark):
    odd = ["\\### Assistant: </turn> ok", "### x\n</turn>\n", "\\\\#\\<n\\n", "", "é\n\n"]
    turns = [(7, i, r, t) for i, (r, t) in enumerate((r, t) for t in odd for r in ("user", "assistant", "### sys\n"))]
    df = spark.createDataFrame([*turns, (None, None, None, None), (3, 1, "user", None), (3, 1, "user", None)], "conv_id long, turn long, role string, text string").withColumn("seq", F.lit(1))
    segments = chat.format_turns(df)
    whole = "".join(r["segment"] for r in segments.filter("conv_id = 7").orderBy("first", "message").collect())
    assert chat.parse(whole) == [(r, t) for *_, r, t in turns]
    assert "### x" not in whole and whole.count("\n</turn>\n") == len(turns)
    got = {r["conv_id"]: r for r in chat.read_back(segments).collect()}
    assert tuple(got[7])[1:5] == expected([(r, t) for *_, r, t in turns]) and got[7]["formatted_chars"] == len(whole)
    assert got[3]["n_turns"] == 2 and got[None]["n_turns"] == 1
    assert chat.read_back(chat.format_turns(df.limit(0))).count() == 0


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="#<\\/turn>n a\né", max_size=30))
def test_escapes_are_reversible(text):
    masked = text.replace("\\", "\\\\").replace("#", "\\h").replace("<", "\\l")
    assert chat.unescape(masked) == text and "#" not in masked and "<" not in masked
