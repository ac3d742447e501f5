import hashlib

import pytest
from hypothesis import given
from hypothesis import strategies as st

from corpusloom.llm import chat_format as chat
from corpusloom.llm import queries as q

PARTS = st.sampled_from([*chat.TEMPLATE.controls, "\\", "<", "[", "s>", "INST]", "é", "\U0001f600", " ", "\n", "a"])
TEXT = st.lists(PARTS, max_size=12).map("".join)


@given(TEXT)
def test_escape_is_reversed_and_leaves_no_control_string(text):
    escaped = chat.TEMPLATE.escape(text)
    assert chat.TEMPLATE.unescape(escaped) == text
    assert not any(c in escaped for c in chat.TEMPLATE.controls)


@given(st.lists(st.tuples(st.sampled_from(["user", "assistant", "system", "tool", "", "<s>"]), TEXT), max_size=5))
def test_turns_come_back_from_the_ids(said):
    import numpy as np

    with open(chat.VOCABULARY, "rb") as file:
        codec = chat._codec(file.read(), (chat.TEMPLATE.begin, tuple(chat.TEMPLATE.frames.items()), chat.TEMPLATE.other, chat.TEMPLATE.learnt))
    segments, learnt = [codec.encode("")[:0]], []
    segments[0] = np.array([codec.ids["<s>"]], codec.dtype)
    for role, text in said:
        own, at = codec.segments(role, codec.encode(role), codec.encode(text))
        if role == "assistant":
            learnt.append(len(segments) + at)
        segments += own
    ids = np.concatenate(segments)
    assert list(codec.turns(ids)) == said
    assert "".join(codec.learnt_text(ids, chat.loss_mask(segments, learnt))) == "".join(t for r, t in said if r == "assistant")
    parts = {"user": ("[INST]", "[/INST]"), "assistant": ("", "</s>"), "system": ("<<SYS>>", "<</SYS>>")}
    esc = chat.TEMPLATE.escape
    want = "<s>" + "".join((parts[r][0] if r in parts else f"<|role|>{esc(r)}<|says|>") + esc(t) + (parts[r][1] if r in parts else "<|end|>") for r, t in said)
    assert codec.written_out(ids) == want


def test_templates_whose_control_strings_hold_one_another_are_refused():
    with pytest.raises(ValueError):
        chat.Template(begin="<s>", other=("<<s>", "<|says|>", "<|end|>"))
    with pytest.raises(ValueError):
        chat.Template(frames={"user": (None, "</u>"), "assistant": (None, "</s>")})


ROWS = [
    (1, 2, "assistant", "</s> and [INST]"), (1, None, "system", "first"), (1, 1, "user", None), (1, 1, "user", None),
    (2, 0, None, "no role"), (2, 1, "tool", "<|end|>"), (3, 0, "assistant", ""), (4, 0, "user", "word " * 30_000), (4, 1, "assistant", "a" * 50_000),
    (None, 0, "user", "no conversation"),
]


@pytest.fixture(scope="module")
def said(spark):
    return spark.createDataFrame([(*r, "x", 1, True) for r in ROWS], "conv_id long, turn int, role string, text string, ids string, block int, last boolean")


@pytest.mark.parametrize("most", [1, 1 << 16])
def test_digests(spark, said, most):
    blocks = chat.formatted(said, block_tokens=most).cache()
    want = {}
    for conv in {r[0] for r in ROWS}:
        rows = sorted(((r[1] if r[1] is not None else -1, r[2] or "", r[3] or "") for r in ROWS if r[0] == conv))
        loss = "".join(t for _, r, t in rows if r == "assistant")
        want[conv] = (len(rows), hashlib.sha256("".join(f"{r}\n{t}\n" for _, r, t in rows).encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest())
    got = {r[0]: tuple(r)[1:5] for r in chat.digests(blocks).collect()}
    assert got == want
    back = sorted((r.conv_id if r.conv_id is not None else -1, r.block, r.number, r.role, r.text) for r in chat.turns(blocks).collect())
    assert [(c, r, t) for c, _, _, r, t in back] == sorted(((r[0] if r[0] is not None else -1, r[2] or "", r[3] or "") for r in ROWS), key=lambda x: [b[0:1] + b[3:] for b in back].index(x))
    assert blocks.where("block > 0").count() == (5 if most == 1 else 0)


def test_stop_can_be_learnt(spark, said):
    one = lambda stop: {(r.conv_id, r.block): sum(r["mask"]) for r in chat.formatted(said, learn_stop=stop).collect()}
    plain, stopped = one(False), one(True)
    assert stopped[1, 0] == plain[1, 0] + 1 and stopped[2, 0] == plain[2, 0] == 0 and stopped[3, 0] == 1 > plain[3, 0]


def test_no_rows(spark, said):
    assert chat.digests(chat.formatted(said.limit(0))).count() == 0


def test_query_has_its_own_conversation(spark):
    row = q.op13_chat_tokens(spark, "/root/testdata/sf0.001").where("conv_id = -7").collect()[0]
    text = "</s>[INST] ok [/INST]"
    assert (row.n_turns, row.loss_chars, row.loss_sha256) == (2, len(text), hashlib.sha256(text.encode()).hexdigest())
    assert row.formatted_chars == 3 + 6 + 7 + 4 + 2 * (len(text) + 3)
