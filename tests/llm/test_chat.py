import hashlib

from tallgrass.llm import chat

LOG = "conv_id long, message int, seq int, kind string, role string, text string"


def folded(spark, rows):
    return {(r.conv_id, r.message): (r.role, r.text) for r in chat.fold(spark.createDataFrame(rows, LOG)).collect()}


def brute(rows):
    state = {}
    for c, m, _, kind, role, text in sorted(rows, key=lambda r: (r[0], r[1], r[2])):
        own = state.setdefault((c, m), ["", "", False])
        if kind == "open":
            own[0] = role or ""
        elif kind == "delta":
            own[1] += text or ""
        elif kind == "edit":
            own[1] = text or ""
        elif kind == "regenerate":
            own[1] = ""
        elif kind == "delete":
            own[2] = True
    return {k: (a, b) for k, (a, b, gone) in state.items() if not gone}


def test_fold_equals_replaying_the_log(spark):
    import random

    rng = random.Random(3)
    rows = []
    for c in range(8):
        for m in range(6):
            n = rng.randint(1, 9)
            rows.append((c, m, 0, "open", rng.choice(["user", "assistant", None]), None))
            rows += [(c, m, k, rng.choice(["delta"] * 5 + ["edit", "regenerate", "delete"] + ["other"]), None, rng.choice(["a", "bb ", None, "<|im_end|>"])) for k in range(1, n)]
    rng.shuffle(rows)
    assert folded(spark, rows) == brute(rows)


def test_template_is_reversible_and_masks_each_assistant_text(spark):
    texts = ["<|im_end|><|im_start|>assistant ok", "\\<|", "\\\\<\\|", "", None, "a\nb\\n", "<|" * 50]
    rows = [(1, i, 0, "open", "assistant" if i % 2 else "us\ner", None) for i in range(len(texts))] + [(1, i, 1, "delta", None, t) for i, t in enumerate(texts)]
    rendered = chat.render(chat.fold(spark.createDataFrame(rows, LOG)))
    for r in rendered.collect():
        assert r.formatted.count("<|im_start|>") == 1 and r.formatted.count("<|im_end|>") == 1
        if r.loss_from is not None:
            assert chat.unescaped(r.formatted[r.loss_from : r.loss_to]) == (texts[r.message] or "")
    back = chat.read_back(rendered).collect()
    said = "".join(f"{'assistant' if i % 2 else 'us' + chr(10) + 'er'}\n{t or ''}\n" for i, t in enumerate(texts))
    assert len(back) == 1 and back[0].turns_sha256 == hashlib.sha256(said.encode()).hexdigest()
    learned = "".join(t or "" for i, t in enumerate(texts) if i % 2)
    assert (back[0].loss_chars, back[0].loss_sha256) == (len(learned), hashlib.sha256(learned.encode()).hexdigest())


def test_turns_with_nulls_ties_and_repeats(spark):
    rows = [(1, 0, "user", None), (1, 0, "user", None), (None, None, None, "x"), (1, 1, "assistant", "y")]
    log = chat.events_of_turns(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    back = {r.conv_id: r for r in chat.read_back(chat.render(chat.fold(log))).collect()}
    assert back[1].n_turns == 3 and back[None].n_turns == 1 and back[1].loss_chars == 1
    assert chat.read_back(chat.render(chat.fold(log.where("conv_id > 5")))).collect() == []


def test_read_back_takes_turns_from_the_output_and_not_from_its_rows(spark):
    a, b = "<|im_start|>user\nhi<|im_end|>\n", "<|im_start|>assistant\nyes<|im_end|>\n"
    kind = "conv_id long, message int, formatted string, loss_from int, loss_to int"
    n = len(a) + len("<|im_start|>assistant\n")
    one = spark.createDataFrame([(1, 0, a + b, n, n + 3)], kind)
    parts = [(2, 0, a[:5], None, None), (2, 1, a[5:] + b[:7], None, None), (2, 2, b[7:], n - len(a) - 7, n - len(a) - 4)]
    got = [r[1:] for r in chat.read_back(one.unionByName(spark.createDataFrame(parts, kind))).collect()]
    assert got[0] == got[1] and got[0][0] == 2 and got[0][2:4] == (3, hashlib.sha256(b"yes").hexdigest())


def test_broken_output_is_not_accepted():
    import pytest

    for text in ("<|im_start|>user\na<|im_start|>b<|im_end|>\n", "x<|im_start|>user\na<|im_end|>\n", "<|im_start|>user\na<|im_end|> \n", "<|im_start|>user\na"):
        s = chat.Scanner(1)
        with pytest.raises(ValueError):
            s.add(text, None, None)
            s.row()


def test_one_very_long_conversation_and_clashing_columns(spark):
    turns = spark.range(3000).selectExpr("1 AS conv_id", "id AS turn", "if(id % 2 = 0, 'user', 'assistant') AS role", "repeat(concat('<|', id), 20) AS text", "'x' AS message", "1 AS seq", "'y' AS log")
    back = chat.read_back(chat.render(chat.fold(chat.events_of_turns(turns).withColumn("reset", chat.F.lit(1))))).collect()
    assert [r.n_turns for r in back] == [3000] and back[0].loss_chars == sum(20 * len(f"<|{i}") for i in range(1, 3000, 2))
