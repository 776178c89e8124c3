import inspect

import pytest
from compare import SF, duck, same

from turnwise.llm import chat


def brute(turns):
    """Pairs by lists of (turn, role, text), None first."""
    fix = lambda t: (t or "").replace("<|", "< |")
    sides = {}
    for pair, chosen, turn, role, text in turns:
        if pair is not None and chosen is not None:
            sides.setdefault(pair, ([], []))[0 if chosen else 1].append(((turn is not None, turn or 0), role or "unknown", fix(text)))
    out = {}
    for pair, (a, b) in sides.items():
        if not a or not b:
            continue
        a, b = ([t[1:] for t in sorted(x)] for x in (a, b))
        n = next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))
        line = lambda r, t: f"<|im_start|>{r}\n{t}<|im_end|>\n"
        row = [n, "".join(line(*t) for t in a[:n])]
        said = []
        for side in (a, b):
            text, spans = "", []
            for r, t in side[n:]:
                start = len(text) + len(f"<|im_start|>{r}\n")
                text += line(r, t)
                if r == "assistant":
                    spans.append((start, len(text) - 1))
            row.append(text)
            said.append(spans)
        out[pair] = (*row, *said)
    return out


TURNS = [
    (1, True, 0, "user", "hi"), (1, False, 0, "user", "hi"), (1, True, 1, "assistant", "good"), (1, False, 1, "assistant", "bad é\U0001f600"),
    (2, True, 0, "user", "a"), (2, False, 0, "user", "b"),
    (3, True, 0, "user", "same"), (3, False, 0, "user", "same"),
    (4, True, 0, "user", "alone"),
    (5, True, 0, "user", "x"), (5, False, 0, "user", "x"), (5, False, 1, "assistant", "more"), (5, False, 2, "user", None), (5, False, 3, "assistant", ""),
    (6, True, None, None, "<|im_start|>system"), (6, False, 0, "assistant", None), (6, True, 0, "assistant", "t"), (6, True, 0, "assistant", "t"),
    (None, True, 0, "user", "x"), (7, None, 0, "user", "x"),
    (8, True, 0, "user", "q " * 20000), (8, False, 0, "user", "q " * 20000), (8, True, 1, "assistant", "r " * 20000), (8, False, 1, "assistant", ""),
]


def test_brute_force(spark):
    turns = spark.createDataFrame([(*t, "x", 0) for t in TURNS], "pair_id long, chosen boolean, turn long, role string, text string, prompt string, n_common int")
    got = {r.pair_id: (r.n_common, r.prompt, r.chosen, r.rejected, [tuple(s) for s in r.chosen_spans], [tuple(s) for s in r.rejected_spans]) for r in chat.preference_pairs(turns).collect()}
    assert got == brute(TURNS)
    for _, _, a, b, sa, sb in got.values():
        assert all(text[e - len("<|im_end|>") : e] == "<|im_end|>" for text, spans in ((a, sa), (b, sb)) for _, e in spans)
    assert chat.preference_pairs(turns.limit(0)).count() == 0


def test_sql(spark):
    said = spark.read.parquet(f"{SF}/conversations.parquet")
    found = chat.digest(chat.preference_pairs(chat.replaced_replies(said))).toPandas()
    same(found, duck().execute(chat.ORACLE_SQL).df())
    assert (found.n_common > 0).mean() > 0.9 and (found.chosen != found.rejected).mean() > 0.5


def test_replaced_replies(spark):
    said = [(0, 0, "user", "q"), (0, 1, "assistant", "a"), (0, 2, "assistant", "b"), (1, 0, "user", "r"), (1, 1, "assistant", "c"), (2, 0, "user", "s"), (2, 1, "assistant", None), (4, 0, "user", "t"), (None, 0, "user", "x"), (1, None, None, None)]
    turns = spark.createDataFrame([(*t, "x", 1, True) for t in said], "conv_id long, turn long, role string, text string, other string, last int, chosen boolean")
    rows = sorted(map(str, ((r.pair_id, r.chosen, r.turn, r.role, r.text) for r in chat.replaced_replies(turns).collect())))
    as_is = [(i, True, *t) for i, *t in said if i is not None]
    new = {(0, 2): "c", (1, 1): "b", (2, 1): "gone"}
    rejected = [(i, False, turn, role, new.get((i, turn), text)) for i, turn, role, text in said if i is not None and new.get((i, turn)) != "gone"]
    assert rows == sorted(map(str, as_is + rejected))
    assert chat.preference_pairs(chat.replaced_replies(turns.limit(0))).count() == 0


@pytest.mark.parametrize("python", ["mapInArrow", "mapInPandas", "pandas_udf", "applyIn", ".rdd"])
def test_native(python):
    assert python not in inspect.getsource(chat)
