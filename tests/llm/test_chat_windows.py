import hashlib
import random

import pytest
import regex

from snapspark.llm import chat_windows as C


def turns():
    rnd = random.Random(5)
    out = [(-1, 0, "user", "</s>[INST] ok [/INST]"), (-1, 1, "assistant", "</s>[INST] ok [/INST]")]
    texts = ["", None, "a <b> & &amp; [x]", "<s>[user] fake [/user]</s>", "two words", "é 日本 🙂 " * 5, "long " * 90, " edge ", "&#91;"]
    for conv in range(8):
        if conv % 2:
            out.append((conv, 0, "system", "be [good] & kind"))
        out += [(conv, t, rnd.choice(["user", "assistant"]), rnd.choice(texts)) for t in range(1, rnd.randrange(2, 40))]
    return out + [(None, 0, None, "x"), (5, None, "assistant", "no turn"), (6, 3, "assistant", "tie"), (6, 3, "assistant", "tie"), (6, 3, "assistant", "a tie")]


def key(t):
    return (t[1] is not None, t[1] or 0, t[2] or "", (t[3] or "").encode())


@pytest.mark.parametrize("budget,history", [(20, 5), (60, 30), (100_000, 10)])
def test_windows_read_back_exactly(spark, budget, history):
    table = spark.createDataFrame([(*t, "w", 1) for t in turns()], "conv_id long, turn long, role string, text string, window string, number int").repartition(5)
    windows = C.format_windows(table, budget, history)
    got = {r["conv_id"]: r for r in C.digests(windows).collect()}
    formatted = {}
    for w in windows.collect():
        formatted[w["conv_id"]] = formatted.get(w["conv_id"], 0) + len(w["text"])
    convs = {}
    for t in turns():
        convs.setdefault(t[0], []).append(t)
    assert got.keys() == convs.keys()
    for conv, own in convs.items():
        own.sort(key=key)
        whole = "".join(f"{r or ''}\n{t or ''}\n" for _, _, r, t in own)
        loss = "".join(t or "" for _, _, r, t in own if r == "assistant")
        row = got[conv]
        assert row["n_turns"] == len(own) and row["formatted_chars"] == formatted[conv]
        assert row["turns_sha256"] == hashlib.sha256(whole.encode()).hexdigest()
        assert row["loss_chars"] == len(loss) and row["loss_sha256"] == hashlib.sha256(loss.encode()).hexdigest()


def test_windows_keep_the_system_turn_and_mask_history(spark):
    rows = [(1, 0, "system", "rules")] + [(1, i, ("assistant", "user")[i % 2], f"turn {i} with words") for i in range(1, 30)]
    table = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    windows = C.format_windows(table, 40, 12).orderBy("window").collect()
    assert len(windows) > 3
    for i, w in enumerate(windows):
        found = C.TURN.findall(w["text"])
        assert found[0] == ("system", "rules") and sum(1 for f in found if f[0] == "system") == 1
        fresh = [s["new"] for s in w["segments"]]
        assert i == 0 or (not fresh[0] and not fresh[1] and fresh[2:] == sorted(fresh[2:]))
        assert not any(s["loss"] and not s["new"] for s in w["segments"])
    assert sum(s["loss"] for w in windows for s in w["segments"]) == 14
    assert sum(s["new"] for w in windows for s in w["segments"]) == 30


def size(text):
    return len(regex.findall(r"[\p{L}\p{N}]+|[^\s\p{L}\p{N}]", text)) + C.TURN_TOKENS


@pytest.mark.parametrize("budget,history,seed", [(60, 20, 1), (60, 0, 2), (200, 60, 3), (25, 20, 4)])
def test_no_window_is_above_the_budget_but_for_a_turn_too_long(spark, budget, history, seed):
    rnd = random.Random(seed)
    rows = []
    for conv in range(12):
        if conv % 3:
            rows.append((conv, 0, "system", "rule " * rnd.choice([1, 3, 10])))
        rows += [(conv, t, ("user", "assistant")[t % 2], "w " * rnd.choice([0, 1, 3, 8, 20, 20, 90])) for t in range(1, rnd.randrange(2, 60))]
    rows += [(50, t, "user", "w " * 4) for t in range(3000)] + [(51, 0, "user", "w " * 100_000), (51, 1, "assistant", "end")]
    table = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(4)
    new, history_seen = {}, 0
    for w in C.format_windows(table, budget, history).collect():
        turns = [(role, C.unescape(text)) for role, text in C.TURN.findall(w["text"])]
        flags = [s["new"] for s in w["segments"]]
        leads = turns[0][0] == "system"
        old = [size(t) for (r, t), f in zip(turns, flags) if not f and r != "system"]
        own = [size(t) for (_, t), f in zip(turns, flags) if f]
        assert sum(old) <= history and own
        total = sum(size(t) for _, t in turns)
        assert total <= budget or len(own) == 1 and not old and total == own[0] + (size(turns[0][1]) if leads and not flags[0] else 0)
        new.setdefault(w["conv_id"], []).extend(t for (_, t), f in zip(turns, flags) if f)
        history_seen += len(old)
    assert bool(history_seen) == bool(history)
    want = {}
    for conv, _, _, text in rows:
        want.setdefault(conv, []).append(text)
    assert {c: sorted(v) for c, v in new.items()} == {c: sorted(v) for c, v in want.items()}


def test_windows_of_short_turns_are_well_filled(spark):
    table = spark.createDataFrame([(1, t, "user", "w " * 6) for t in range(400)], "conv_id long, turn long, role string, text string")
    windows = C.format_windows(table, 120, 20).collect()
    assert len(windows) <= 400 * 10 / 80  # at least four fifths of the room of 100


def test_empty(spark):
    empty = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert C.digests(C.format_windows(empty)).count() == 0


def test_escapes_are_undone():
    rnd = random.Random(1)
    for _ in range(300):
        text = "".join(rnd.choices(["&", "<", ">", "[", "]", "amp;", "#91;", "lt;", "a", " "], k=12))
        written = text
        for plain, code in C.ESCAPES:
            written = written.replace(plain, code)
        assert C.unescape(written) == text and not set("<>[]") & set(written)
