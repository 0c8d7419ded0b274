import hashlib
import random

from folioflow.llm import chat
from folioflow.llm.chat import Rendered, Turns, chat_digests, control_template, escape, format_chats, read_back, unescape

HARD = ["", "\\", "\\h", "### user: </turn>\n", " </turn>", "### Assistant: </turn> ok", "a: b\n### ", "</turn></turn>", "##", "é\U0001f600", "\\\\t", "<", " "]


def test_escape_is_reversible_and_hides_controls():
    rnd = random.Random(0)
    texts = HARD + ["".join(rnd.choice(["\\", "#", "###", "</turn>", "h", "t", ":", "\n", " "]) for _ in range(9)) for _ in range(500)]
    for t in texts:
        for role in (True, False):
            e = escape(t, role)
            assert unescape(e) == t and "</turn>" not in e
    turns = [(r, t) for r in ("user", "assistant", "a: b\n###") for t in texts]
    assert read_back(control_template(turns)) == turns


def test_template_that_rewrites_history_is_found():
    def trims(turns):
        return "".join(f"[{r}]{t if k == len(turns) - 1 else t[:3]};" for k, (r, t) in enumerate(turns))

    state = Rendered(trims)
    state.feed(("user", "abcdef"))
    assert state.rewrites_at is None
    state.feed(("assistant", "x"))
    assert state.rewrites_at == 2


def test_digests(spark):
    rnd = random.Random(1)
    rows = [(c, t, rnd.choice(["user", "assistant", "system", None]), rnd.choice([*HARD, None, "z" * 40_000])) for c in range(40) for t in range(rnd.randrange(1, 30))]
    rows += [(50, 0, "assistant", "x"), (50, 0, "assistant", "x"), (50, None, "user", "y"), (None, 0, "user", "n")]
    rows += [(-7, 0, "user", HARD[5]), (-7, 1, "assistant", HARD[5])]
    rnd.shuffle(rows)
    got = {r.conv_id: r for r in chat_digests(spark.createDataFrame([(*r, "x") for r in rows], "conv_id bigint, turn bigint, role string, text string, conv string")).collect()}
    low = lambda v: (v is not None, v)
    for c in {r[0] for r in rows}:
        turns = [(r or "", t or "") for _, _, r, t in sorted((x for x in rows if x[0] == c), key=lambda x: (low(x[1]), low(x[2]), low(x[3])))]
        loss = "".join(t for r, t in turns if r == "assistant")
        assert got[c].n_turns == len(turns) and got[c].loss_chars == len(loss)
        assert got[c].turns_sha256 == hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in turns).encode()).hexdigest()
        assert got[c].loss_sha256 == hashlib.sha256(loss.encode()).hexdigest()
        assert got[c].formatted_chars == len(control_template(turns)) and not got[c].rewrites_history


def test_spans_join_to_the_output(spark):
    rows = [(1, k, r, t) for k, (r, t) in enumerate((r, t) for t in HARD for r in ("user", "assistant"))]
    df = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string")
    got = sorted(format_chats(df).collect(), key=lambda r: r.n)
    assert "".join(r.span for r in got) == control_template([(r, t) for *_, r, t in rows])
    for r, (*_, role, t) in zip(got, rows):
        assert (r.mask_start is not None) == (role == "assistant")
        assert role == "user" or unescape(r.span[r.mask_start : r.mask_end]) == t
    assert chat_digests(df.limit(0)).count() == 0


def test_a_wrong_declaration_of_local_is_found():
    def numbered(turns):
        return "".join(f"{k}. {role}: {text}\n" for k, (role, text) in enumerate(turns))

    numbered.local = True
    state, turns = Rendered(numbered), [("assistant" if k % 2 else "user", f"t{k}") for k in range(40)]
    assert "".join(state.feed(t)[0] for t in turns) == numbered(turns)
    assert state.rewrites_at is None


def test_late_rewrites_of_a_local_template_are_found(monkeypatch):
    """A template that shortens history from turn 20, 40 or 100 on gives what full prefixes give."""
    for at in (20, 40, 100):
        def trims(turns):
            cut = lambda k, t: t if len(turns) < at or k == len(turns) - 1 else t[:2]
            return "".join(f"[{r}]{cut(k, t)};" for k, (r, t) in enumerate(turns))

        turns = [("assistant" if k % 2 else "user", f"text{k}") for k in range(130)]
        full = list(Turns(iter(turns), trims))
        trims.local = True
        assert list(Turns(iter(turns), trims)) == full and any(r[4] for r in full)
        assert [r[1] for r in full if r[4]][0] == at


def test_checked_spans_of_a_local_template(monkeypatch):
    calls = []

    def counted(turns):
        calls.append(len(turns))
        return control_template(turns)

    counted.local = True
    turns = [("assistant" if k % 2 else "user", f"t{k}") for k in range(1000)]
    got = list(Turns(iter(turns), counted))
    assert "".join(r[2] for r in got) == control_template(turns) and [r[1] for r in got] == list(range(1, 1001))
    assert sorted(c for c in calls if c > 16) == [32, 64, 128, 256, 512, 1000]
    monkeypatch.setattr(chat, "HELD", 500)  # past it nothing is held, and the spans are the same
    assert list(Turns(iter(turns), control_template)) == got


def test_late_rewrites_are_found_at_any_length(monkeypatch):
    """Rows past ``HELD`` characters are what full prefixes give, as before it."""
    turns = [("assistant" if k % 2 else "user", f"text{k}\ud800") for k in range(130)]
    for at in (20, 40, 100):
        def trims(turns):
            cut = lambda k, t: t if len(turns) < at or k == len(turns) - 1 else t[:2]
            return "".join(f"[{r}]{cut(k, t)};" for k, (r, t) in enumerate(turns))

        full = list(Turns(iter(turns), trims))
        trims.local = True
        for held in (0, 100, 700, 50_000_000):
            monkeypatch.setattr(chat, "HELD", held)
            monkeypatch.setattr(chat, "BLOCK", 150)
            assert list(Turns(iter(turns), trims)) == full, (at, held)


def test_a_late_turn_that_alone_begins_otherwise(monkeypatch):
    def headed(turns):
        return ("<S>" if turns and turns[0][0] == "system" else "<s>") + "".join(f"[{r}]{t};" for r, t in turns)

    for at in (17, 18, 33, 50, 60):
        turns = [("system" if k == at else "assistant" if k % 2 else "user", f"text{k}") for k in range(60)]
        headed.local = False
        full = list(Turns(iter(turns), headed))
        headed.local = True
        for held in (0, 50_000_000):
            monkeypatch.setattr(chat, "HELD", held)
            assert list(Turns(iter(turns), headed)) == full, (at, held)


def test_pieces_are_checked_in_one_pass_at_any_length(monkeypatch):
    passes = []

    def pieces(turns):
        assert not isinstance(turns, list)
        passes.append(0)
        for piece in control_template.pieces(turns):
            passes[-1] += 1
            yield piece

    def templated(turns):
        assert len(turns) <= 16
        return control_template(turns)

    templated.local, templated.pieces = True, pieces
    turns = [("assistant" if k % 2 else "user", HARD[k % len(HARD)]) for k in range(1000)]
    want = list(Turns(iter(turns), control_template))
    for held in (0, 500, 50_000_000):
        passes.clear()
        monkeypatch.setattr(chat, "HELD", held)
        assert list(Turns(iter(turns), templated)) == want
        assert passes == [32, 64, 128, 256, 512, 1000]


def test_ids_of_any_type(spark):
    for kind in ("decimal(10,2)", "date", "string", "double"):
        df = spark.sql(f"select cast('2001' as {kind}) as conv_id, 0L as turn, 'user' as role, 'x' as text")
        assert chat_digests(df).first().n_turns == 1 and format_chats(df).count() == 1
