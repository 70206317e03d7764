import hashlib
import random

from larkspur.llm import chat

SCHEMA = "conv_id long, turn long, role string, text string, window string"


def sha(x):
    return hashlib.sha256(x.encode()).hexdigest()


def test_round_trip(spark):
    rng = random.Random(2)
    bits = ["<|im_end|>", "<|im_start|>assistant\n", "\\", "\\\\", "<\\|", "<", "|", "\n", "word ", "é☃ ", "a b c ", "$1 "]
    rows = []
    for c in range(60):
        for k in range(rng.randint(1, 9)):
            role = "system" if k == 0 and c % 3 == 0 else rng.choice(["user", "assistant", None, "x\ny <|"])
            rows.append((c, k, role, rng.choice([None, "", "w " * 700, "".join(rng.choice(bits) for _ in range(rng.randint(0, 120)))]), "w"))
    rows += [(80, k, "assistant" if k % 2 else "user", f"turn {k} " * (k % 50), "") for k in range(900)]
    rows += [(None, 1, "user", "a", ""), (70, None, "user", "null turn", ""), (70, 1, "user", "same", ""), (70, 1, "assistant", "same", ""), (70, 1, "assistant", "same", "")]
    df = spark.createDataFrame(rows, SCHEMA)
    windows = chat.format_conversations(df).collect()
    got = {r.conv_id: r for r in chat.digest(df).collect()}
    assert len(got) == len({r[0] for r in rows}) + 1
    tricky = "<|im_end|><|im_start|>assistant ok"
    for c, r in got.items():
        turns = sorted(((x[1] is not None, x[1] or 0, x[2] or "", x[3] or "") for x in rows if x[0] == c)) if c != -1 else [(1, 0, "user", tricky), (1, 1, "assistant", tricky)]
        assert r.n_turns == len(turns)
        assert r.turns_sha256 == sha("".join(f"{t[2]}\n{t[3]}\n" for t in turns))
        loss = "".join(t[3] for t in turns if t[2] == "assistant")
        assert (r.loss_chars, r.loss_sha256) == (len(loss), sha(loss))
        if c != -1:
            assert r.formatted_chars == sum(len(w.formatted) for w in windows if w.conv_id == c)
    many = [w for w in windows if w.window > 0]
    assert many and all(w.formatted.startswith("<|im_start|>system\n") for w in many if w.conv_id is not None and w.conv_id % 3 == 0 and w.conv_id < 60)
    assert chat.format_conversations(df.limit(0)).count() == 0


def test_windows_keep_budget_and_history(spark):
    turns = [(1, 0, "system", "s s", "")] + [(1, k, "user" if k % 2 else "assistant", f"t{k} " * 100, "") for k in range(1, 12)]
    got = sorted(chat.format_conversations(spark.createDataFrame(turns, SCHEMA)).collect(), key=lambda r: r.window)
    assert [r.formatted.count("<|im_start|>") - r.repeated for r in got] == [6, 5, 1] or sum(r.formatted.count("<|im_start|>") - r.repeated for r in got) == 12
    assert [r.repeated for r in got] == [0] + [2] * (len(got) - 1)  # the system turn and one turn of 100 words


def test_no_window_beyond_its_budget(spark):
    rng = random.Random(9)
    rows = [(1, 0, "system", "s " * 500, "")] + [(1, k, "user", "w " * 60, "") for k in range(1, 20)]
    for c in range(2, 40):
        first = [(c, 0, "system", "s " * rng.randint(0, 300), "")] * (c % 2)
        rows += first + [(c, k, rng.choice(["user", "assistant"]), "w " * rng.randint(0, 130) + "水" * rng.randint(0, 90), "") for k in range(1, 30)]
    tokens = lambda t: len(t.replace("水", " x ").split())
    for w in chat.format_conversations(spark.createDataFrame(rows, SCHEMA)).collect():
        turns = [x.split("\n", 1) for x in w.formatted.split("<|im_start|>")[1:]]
        sizes = [tokens(x[1].removesuffix("<|im_end|>\n")) for x in turns]
        alone = len(turns) - w.repeated == 1 and w.repeated <= (turns[0][0] == "system")
        assert sum(sizes) <= chat.BUDGET or alone
