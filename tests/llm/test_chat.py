"""Chat formatting: round trips, spans, templates that rewrite history."""

import random
import time

import __spark_entry__ as entry
from compare import connect, difference
from missive.llm import chat

PARTS = ["<|", "|>", "<|turn|>", "<|text|>", "<|end|>\n", "</s>", "[INST]", "\\", "\\\\", "<", "|", "é🙂", "ok", "\n", " ", "<<SYS>>", "["]


def turns_of(rng):
    roles = ["user", "assistant", "system", "", "<|text|>", "a\\"]
    return [(rng.choice(roles), "".join(rng.choices(PARTS, k=rng.randint(0, 6)))) for _ in range(rng.randint(0, 6))]


def test_round_trip_and_spans():
    rng = random.Random(2)
    for _ in range(400):
        turns = turns_of(rng)
        whole, spans, rewritten = chat.locate(turns, chat.render)
        assert chat.parsed(whole) == turns and rewritten == []
        assert "".join(whole[b:e] for _, b, e, _, _ in spans) == whole
        assert [(r, chat.unescaped(whole[s:t])) for r, _, _, s, t in spans] == turns
        for text in (t for _, t in turns):
            assert not any(c in chat.escaped(text) for c in chat.CONTROLS)


def test_rewriting_template_is_found():
    def forgetful(turns):
        return "".join(f"({r}:{t if k > len(turns) - 3 else '...'})" for k, (r, t) in enumerate(turns))

    turns = [("user", "one"), ("assistant", "two"), ("user", "three"), ("assistant", "four")]
    whole, spans, rewritten = chat.locate(turns, forgetful)
    assert rewritten == [2, 3] and whole.endswith("(assistant:four)")
    assert whole[spans[3][3] : spans[3][4]] == "four" and spans[0][3] <= spans[0][4] <= len("(user:")


def test_template_that_changes_texts_has_no_text_span():
    _, spans, _ = chat.locate([("user", " a "), ("assistant", "b")], lambda ts: "".join(f"<{t.strip()}>" for _, t in ts))
    assert spans[1][3:] == (4, 5) and spans[0][3:] == (1, 2)
    _, spans, _ = chat.locate([("user", "secret")], lambda ts: "[hidden]" if ts[-1][1] == "secret" else f"<{ts[-1][1]}>")
    assert spans[0][3] == spans[0][4]


def test_slices_equal_whole_prefixes():
    rng = random.Random(4)

    def answered(turns):
        # what a turn adds depends on the turn before it
        return "".join(f"<{r}{'=' if k and turns[k - 1][0] == r else '!'}{t}>" for k, (r, t) in enumerate(turns))

    def opened(turns):
        return "<s>" + chat.render(turns)

    def forgetful(turns):
        return "".join(f"({r}:{t if k > len(turns) - 3 else '...'})" for k, (r, t) in enumerate(turns))

    def late(turns):
        return chat.render(turns[-1:] if len(turns) > 40 else turns)

    def doubled(turns):
        # no prefix of a slice shows it, the whole rendering does
        return "".join(f"({t * (2 if k > 30 else 1)})" for k, (_, t) in enumerate(turns))

    for length in (0, 1, chat.SLICE, chat.SLICE + 1, 5 * chat.SLICE + 3):
        turns = [turn for _ in range(60) for turn in turns_of(rng)][:length]
        assert len(turns) == length
        for template, stated in [(chat.render, 0), (chat.render, 3), (answered, 1), (opened, 1)]:
            assert chat.locate(turns, template, stated) == chat.locate(turns, template)
        # stated wrongly: found out, and rendered from the first turn on
        for template in (answered, opened, forgetful, late, doubled):
            assert chat.locate(turns, template, 0) == chat.locate(turns, template)


def test_conversation_of_twenty_thousand_turns():
    turns = [("user" if k % 2 else "assistant", f"turn {k} </s>") for k in range(20_000)]
    began = time.monotonic()
    whole, spans, rewritten = chat.locate(turns, chat.render, 0)
    assert time.monotonic() - began < 60
    assert chat.parsed(whole) == turns and rewritten == [] and len(spans) == len(turns)
    assert chat.unescaped(whole[spans[-1][3] : spans[-1][4]]) == turns[-1][1]


def test_rows(spark):
    rows = [
        (1, 1, "assistant", "b", "x"), (1, 0, "user", None, "x"), (1, 1, "assistant", "b", "x"), (1, None, None, "z", "x"),
        (None, 0, "assistant", "n", "x"), (2, 0, "assistant", "w " * 50_000, "x"),
    ]
    table = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, formatted string")
    made = chat.formatted(table)
    got = {r.conv_id: r for r in chat.read_back(made).collect()}
    assert [tuple(t) for t in got[1].turns] == [("user", ""), ("assistant", "b"), ("assistant", "b"), ("", "z")]
    assert got[1].loss_text == "bb" and got[None].loss_text == "n" and got[2].loss_text == "w " * 50_000
    assert all(r.rewritten == [] for r in made.collect())
    assert chat.formatted(table.limit(0)).count() == 0


def test_query_equals_sql(spark):
    sf = "/root/testdata/sf0.001"
    assert difference(entry.queries()["op6_chat_prefixes"](spark, sf), connect(sf), entry.oracle_sql()["op6_chat_prefixes"]) is None
