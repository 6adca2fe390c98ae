import random

import public_tokenizers
import pytest
from tokenizers import Tokenizer

from tempora.llm.edit_counts import CountTree, edited_counts, pre_tokens
from tempora.llm.encoder import Encoder
from tempora.llm.tool_calls import canonical, linked, violations

PATH = public_tokenizers.path("byte_bpe_50k.json")
PIECES = ["The", " word", " and", "\n", "\n\n", "  ", " ", "'s", "'", "'re", "don't", ",", ".", " 12", "é", "日本", "\t", "!!", " ", "a", "🙂", "<|endoftext|>"]


@pytest.fixture(scope="module")
def whole():
    t = Tokenizer.from_file(PATH)
    t.encode_special_tokens = True
    return lambda x: len(t.encode(x, add_special_tokens=False).ids)


def test_trees_follow_edits(whole):
    r = random.Random(4)
    counter = pre_tokens(PATH, public_tokenizers.PATTERN)
    for _ in range(150):
        text = "".join(r.choice(PIECES) for _ in range(r.randint(0, 60)))
        tree = CountTree(text, counter)
        assert tree.tokens[1] == whole(text)
        for _ in range(5):
            at, remove, insert = r.randint(0, len(text)), r.choice([0, 0, 1, 3, 9, 50]), "".join(r.choice(PIECES) for _ in range(r.randint(0, 4)))
            text = text[:at] + insert + text[at + remove :]
            tree.edit(at, remove, insert)
            assert tree.text() == text
            assert tree.tokens[1] == whole(text), (text, at, remove, insert)


def test_a_long_text_is_not_encoded_again(whole):
    text = "Some words of a long text, and more. " * 5000
    tree = CountTree(text, pre_tokens(PATH, public_tokenizers.PATTERN))
    tree.edit(90_000, 7, " other")
    assert tree.encoded < 50 and tree.tokens[1] == whole(text[:90_000] + " other" + text[90_007:])


def test_edit_edges(spark):
    schema = "doc_id long, text string, edits array<struct<at:long,remove:long,insert:string>>, n_tokens string"
    rows = [(1, None, None, "x"), (2, "", [(5, 3, "a b")], None), (None, "a b", [None, (None, None, None), (-4, 1, "c")], "")]
    got = {r.doc_id: (r.n_tokens, r.n_tokens_edited, r.n_edits) for r in edited_counts(spark.createDataFrame(rows, schema), PATH, public_tokenizers.PATTERN).collect()}
    assert got == {1: (0, 0, 0), 2: (0, 2, 1), None: (2, 2, 2)}
    assert edited_counts(spark.createDataFrame([], schema), PATH, public_tokenizers.PATTERN).count() == 0


def test_encoder_is_the_library():
    e, r = Encoder(PATH, keep=50), random.Random(1)
    texts = ["".join(r.choice(PIECES) for _ in range(r.randint(0, 40))) for _ in range(400)]
    texts += [" ".join(r.choice(["Word", "other,", "x.", "a.b", "3rd", "É."]) for _ in range(30)).replace(" x. ", "\n") for _ in range(50)]
    for a in range(0, len(texts), 7):
        assert e.encode(texts[a : a + 7]) == [e.whole(t) for t in texts[a : a + 7]]


def test_calls(spark):
    schema = "conv_id long, turn long, role string, content string, call_id string, name string, arguments string, answers string, status int"
    schemas = {"f": {"type": "object", "required": ["x"], "properties": {"x": {"type": "integer"}, "y": {"type": "string"}}, "additionalProperties": False}}
    rows = [
        (1, 0, "system", "s", None, None, None, None),
        (1, 1, "assistant", None, "a", "f", '{"y": "z", "x": 1.0}', None),
        (1, 2, "tool", "r", None, None, None, "a"),
        (1, 3, "assistant", None, "b", "f", '{"x": 2, "y": "@a"}', None),
        (1, 4, "assistant", None, "c", "f", '{"x": 2, "y": "@b"}', None),
        (1, 5, "tool", "again", None, None, None, "a"),
        (1, 6, "tool", "lost", None, None, None, "q"),
        (2, 1, "assistant", None, "a", "f", '{"x": 1, "y": "@b"}', None),
        (2, 2, "assistant", None, "b", "f", '{"x": 1, "y": "@a"}', None),
        (2, 3, "assistant", None, "d", "g", "{broken", None),
        (2, 4, "assistant", None, "e", "f", '{"y": "@nowhere", "w": 1}', None),
        (None, None, None, None, None, None, None, None),
    ]
    got = {(r.conv_id, r.turn): r for r in linked(spark.createDataFrame([(*x, 1) for x in rows], schema), schemas).collect()}
    assert len(got) == len(rows)
    assert {k: (r.status, r.level, r.linked_turn) for k, r in got.items()} == {
        (1, 0): ("message", None, None), (1, 1): ("linked", 0, 2), (1, 2): ("linked", 0, 1), (1, 3): ("pending", 1, None),
        (1, 4): ("pending", 2, None), (1, 5): ("repeated", 0, 1), (1, 6): ("orphan", None, None), (2, 1): ("cycle", None, None),
        (2, 2): ("cycle", None, None), (2, 3): ("pending", 0, None), (2, 4): ("unknown", None, None), (None, None): ("message", None, None),
    }
    assert got[2, 4].errors == ["$.x: missing", "$.w: unknown"] and not got[2, 3].valid
    assert got[1, 1].json == '{"content":null,"role":"assistant","tool_call":{"arguments":{"x":1,"y":"z"},"id":"a","name":"f"}}'
    assert got[1, 1].errors == []  # in JSON, 1.0 is the integer 1
    assert linked(spark.createDataFrame([], schema), schemas).count() == 0


def test_canonical():
    assert canonical({"b": 1.0, "a": [True, None, "é", 1.5]}) == '{"a":[true,null,"é",1.5],"b":1}'
    assert violations(True, {"type": "integer"}) == ["$: not integer"]
