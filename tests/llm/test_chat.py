"""Folding chat logs and rendering them, against a plain fold."""

import hashlib
import random

import pytest

pytest.importorskip("sessionloom.llm.queries")

from sessionloom.llm import chat  # noqa: E402

LOG = "conv_id bigint, seq bigint, part int, kind string, message string, role string, text string, c string, turn string"


def plain_fold(events):
    """conv_id -> [(role, text)], one event after the other."""
    out = {}
    rows = [e for e in events if e[4] is not None and e[3] in ("message", "delta", "edit", "regenerate")]
    for conv in {e[0] for e in rows}:
        own = sorted((e for e in rows if e[0] == conv), key=lambda e: (-(1 << 63) if e[1] is None else e[1], e[2] or 0, e[4], e[6] or ""))
        opened, gone = {}, set()
        for e in own:
            at, name = (-(1 << 63) if e[1] is None else e[1], e[2] or 0), e[4]
            m = opened.setdefault(name, {"at": at, "role": None, "text": ""})
            if m["role"] is None:
                m["role"] = e[5]
            m["text"] = (m["text"] if e[3] == "delta" else "") + (e[6] or "")
            if e[3] in ("edit", "regenerate"):
                gone |= {o for o, x in opened.items() if m["at"] < x["at"] < at}
        out[conv] = [(m["role"] or "", m["text"]) for name, m in sorted(opened.items(), key=lambda kv: (kv[1]["at"], kv[0])) if name not in gone]
    return out


def logs(seed, convs=6, n=60):
    rng = random.Random(seed)
    texts = ["", None, "a", "</s>", "[INST] x [/INST]", "\\e", "\\", "<s", "<", "end <", "[", "é\n🎉" * 40, "x\\\\</s>\\"]
    out = []
    for conv in [*range(convs), None]:
        for seq in range(n):
            kind = rng.choice(["message", "delta", "delta", "delta", "edit", "regenerate", "other", None]) if seq % 3 else "message"
            name = f"m{rng.randrange(max(1, seq - 6), seq + 1)}" if kind != "message" else f"m{seq}"
            out.append((conv, seq if rng.random() > 0.02 else None, rng.choice([0, 0, None, 1]), kind, name if rng.random() > 0.03 else None, rng.choice(["user", "assistant", "sys</s>tem", None]), rng.choice(texts), "c", "t"))
    return out


@pytest.mark.parametrize("span", [1024, 7])
def test_fold(spark, monkeypatch, span):
    monkeypatch.setattr(chat, "SPAN", span)
    # one order for all events of a conversation: equal places differ between messages only
    for seed in range(2):
        events = list({(e[0], e[1], e[2] or 0, e[4]): e for e in logs(seed)}.values())
        got = {}
        for r in chat.fold_events(spark.createDataFrame(events, LOG).repartition(5)).collect():
            got.setdefault(r["conv_id"], []).append((r["turn"], r["role"], r["text"]))
        want = {c: [(i + 1, *m) for i, m in enumerate(ms)] for c, ms in plain_fold(events).items() if ms}
        assert {c: sorted(v) for c, v in got.items()} == want


@pytest.mark.parametrize("template", [chat.ChatTemplate(), chat.IM_TEMPLATE], ids=["inst", "im"])
def test_round_trip(spark, monkeypatch, template):
    monkeypatch.setattr(chat, "PART_TURNS", 5)
    texts = ["", "a", *template.controls, *(c[:-1] for c in template.controls), *(c * 3 for c in template.controls), "\\e", "\\\\e</s>\\", "\\", "<\\e/s>", "é🎉\n" * 500, "$1", "  \t", template.end + template.open, template.open[0] * 5]
    turns = [(k, i + 1, ("assistant", "user", template.close, "")[i % 4], t) for k in (1, 2) for i, t in enumerate(texts[:: -1 if k == 2 else 1])]
    rendered = chat.render(spark.createDataFrame(turns, "conv_id bigint, turn bigint, role string, text string"), template)
    for r in rendered.collect():
        own = [t for t in turns if t[0] == r["conv_id"]][5 * r["part"] : 5 * r["part"] + 5]
        assert r["formatted"].count(template.end) == len(own) and len(r["loss_spans"]) == sum(t[2] == "assistant" for t in own)
    for r in chat.read_rendered(rendered, template).collect():
        own = [t[2:] for t in turns if t[0] == r["conv_id"]][5 * r["part"] : 5 * r["part"] + 5]
        assert [tuple(t) for t in r["turns"]] == own and r["loss_text"] == "".join(t for role, t in own if role == "assistant")
    with pytest.raises(ValueError):
        chat.ChatTemplate(open="<s>", end="><")


def test_turns_to_digests(spark, tmp_path):
    long = "wörd " * 3000
    rows = [(1, 0, "system", "s"), (1, 1, "user", None), (1, 2, "assistant", "x" * 700), (1, 2, "assistant", "x" * 700), (1, 2, "user", "tie"), (2, None, None, None), (None, 0, "assistant", long), (3, 5, "assistant", "")]
    rows += [(4, i, ("user", "assistant")[i % 2], f"turn {i}") for i in range(300)]
    frame = spark.createDataFrame([(*r, "t", "h") for r in rows], "conv_id bigint, turn bigint, role string, text string, message string, kind string")
    chat.write_chats(chat.turn_events(frame), f"{tmp_path}/out")
    parts = chat.read_chats(spark, f"{tmp_path}/out")
    assert parts.where("conv_id = 4").count() == 5
    got = {r["conv_id"]: r for r in chat.digests(parts).collect()}
    for conv in (1, 2, 3, 4, None):
        own = sorted(((-1 if t is None else t), hashlib.sha256(f"{role or ''}\n{text or ''}".encode()).hexdigest(), role or "", text or "") for c, t, role, text in rows if c == conv)
        said = "".join(f"{role}\n{text}\n" for _, _, role, text in own)
        learnt = "".join(text for _, _, role, text in own if role == "assistant")
        r = got[conv]
        assert (r["n_turns"], r["turns_sha256"], r["loss_chars"], r["loss_sha256"]) == (len(own), hashlib.sha256(said.encode()).hexdigest(), len(learnt), hashlib.sha256(learnt.encode()).hexdigest())
    assert chat.fold_events(chat.turn_events(frame.limit(0))).count() == 0
