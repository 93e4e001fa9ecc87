import hashlib

from hypothesis import given, settings
from hypothesis import strategies as st

from tarnbridge.llm import chat as C

PARTS = [*'\\<>|/[]sn\nISTYa ', '<s>', '</s>', '[INST]', '[/INST]', '<<SYS>>', '<|im_end|>', '<|im_start|>']
HARD = st.lists(st.sampled_from(PARTS), max_size=25).map(''.join)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.tuples(HARD, HARD), max_size=4))
def test_escapes_are_reversible(turns):
    text = "".join(f"{C.START}{C.escape_role(r)}\n{C.escape(t)}{C.END}" for r, t in turns)
    assert C.parse(text) == turns
    for _, t in turns:
        assert not any(x in C.escape(t) for x in ("<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "<|"))


def frame(spark, rows):
    return spark.createDataFrame([(*r, "x") for r in rows], "conv_id bigint, turn bigint, role string, text string, n_turns string")


def digest(rows):
    turns = [(r or "", t or "") for _, _, r, t in sorted(rows, key=lambda x: (x[1] is not None, x[1] or 0, x[2] or "", x[3] or ""))]
    loss = "".join(t for r, t in turns if r == "assistant")
    return len(turns), hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in turns).encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest()


def test_windows(spark):
    system = (1, 0, "system", "be brief")
    rows = [system, *[(1, i, "user" if i % 2 else "assistant", f"turn {i} " + "word " * (i % 17)) for i in range(1, 80)], (1, 80, "assistant", "long " * 900)]
    windows = C.format_windows(frame(spark, rows), budget=200, history=60).orderBy("window").collect()
    assert len(windows) > 5
    seen = []
    for w in windows:
        turns = C.parse(w["text"])
        assert len(turns) == w["n_turns"] and turns[0] == ("system", "be brief")
        assert w["n_tokens"] <= 200 or turns == [("system", "be brief"), turns[-1]]
        repeated = turns[1 : w["n_repeated"]]
        assert repeated == seen[len(seen) - len(repeated) :]
        fresh = turns[w["n_repeated"] :]
        assert [C.unescape(w["text"][s["first"] : s["last"]]) for s in w["loss"]] == [t for r, t in fresh if r == "assistant"]
        seen += fresh
    assert seen == [(r, t) for _, _, r, t in rows]
    assert any(w["n_repeated"] > 1 for w in windows)


def test_windows_keep_the_budget(spark):
    """A window exceeds the budget only where the system turn and one new turn do, whatever the lengths."""
    encode = C.encoding(C.VOCABULARY).encode_ordinary
    lengths = [(20, 100, 50, 170, 10), (20, 190, 30, 30, 30, 150, 60, 60, 60), (0, 199, 1, 199, 1), (20, 250, 10, 250)]
    rows = [(c, i, "system" if i == 0 and n else "user" if i % 2 else "assistant", "word " * n) for c, own in enumerate(lengths) for i, n in enumerate(own) if n]
    for w in C.format_windows(frame(spark, rows), budget=200, history=60).collect():
        turns = C.parse(w["text"])
        tokens = [len(encode(f"{C.START}{r}\n{t}{C.END}")) for r, t in turns]
        assert w["n_tokens"] == sum(tokens)
        new, system = turns[w["n_repeated"] :], turns[0][0] == "system"
        assert sum(tokens) <= 200 or len(turns) == 1 + system
        assert sum(tokens[system : w["n_repeated"]]) <= 60 and new


def test_read_back(spark):
    rows = [(1, 1, "assistant", "</s>[INST] ok [/INST]"), (1, 0, "user", None), (2, 5, None, "\\<|im_end|>\n"), (2, 5, None, "\\<|im_end|>\n"), (2, None, "assistant", ""), (None, 0, "a\nb", "x"), (3, 0, "system", "only"), (4, 0, "assistant", "y" * 30_000)]
    got = {r["conv_id"]: r for r in C.read_back(C.format_windows(frame(spark, rows))).collect()}
    for conv in (None, 1, 2, 3, 4):
        r = got.pop(conv)
        assert (r["n_turns"], r["turns_sha256"], r["loss_chars"], r["loss_sha256"]) == digest([x for x in rows if x[0] == conv])
    assert not got and C.read_back(C.format_windows(frame(spark, []))).count() == 0


def test_query_against_the_table(spark, data):
    from tarnbridge.llm.queries import QUERIES

    groups = {}
    for r in spark.read.parquet(f"{data}/conversations.parquet").collect():
        groups.setdefault(r["conv_id"], []).append((r["conv_id"], r["turn"], r["role"], r["text"]))
    groups[-1] = [(-1, 0, "user", "</s>[INST] ok [/INST]"), (-1, 1, "assistant", "</s>[INST] ok [/INST]")]
    rows = QUERIES["op8_chat_formatting"](spark, data).collect()
    assert len(rows) == len(groups)
    for r in rows:
        assert (r["n_turns"], r["turns_sha256"], r["loss_chars"], r["loss_sha256"]) == digest(groups[r["conv_id"]])
