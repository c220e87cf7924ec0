"""Operator 8: the template language, and an exact round trip."""

from __future__ import annotations

import hashlib
from itertools import groupby

import pytest

from returnlens.llm import chat, queries
from returnlens.llm.template import ESCAPE, Const, If, Out, Template, TemplateError, fold, parse

from ..conftest import SF_SMALL


def sha(x: str) -> str:
    return hashlib.sha256(x.encode()).hexdigest()


def test_language():
    t = Template("a{# no #}{{ 1 }}{% set x = 'q' %}{% for m in messages %}{% if m.role == 'u' and not loop.first %}U{{ m['text'] | trim | upper }}"
                 "{% elif m.role in 'ab' %}AB{% else %}{{ x + '-' }}{% endif %}{% if loop.last %}!{% endif %}{% endfor %}{{ none }}")
    msgs = [{"role": "u", "text": "x"}, {"role": "u", "text": " y "}, {"role": "a"}]
    assert t.render(msgs)[0] == "a1q-UYAB!"
    assert t.render(iter([]))[0] == "a1"


def test_constants_are_folded():
    tree = fold(parse("x{{ 'a' + 'b' | upper }}{% if 'a' == 'a' or y %}{{ 'c' }}{% else %}{{ z }}{% endif %}{% if y and true %}d{% endif %}").body)
    assert tree[0] == Out(Const("xaBc")) and isinstance(tree[1], If) and len(tree) == 2


def test_generation_spans():
    text, spans = Template("{% for m in messages %}<{% generation %}{{ m.t }}{{ '.' }}{% endgeneration %}>{% endfor %}").render([{"t": "ab"}, {"t": "é🙂"}])
    assert [text[a:b] for a, b in spans] == ["ab.", "é🙂."]


@pytest.mark.parametrize("bad", ["{% for x %}{% endfor %}", "{% if a %}", "{% endif %}", "{{ a( ) }}", "{{ a.__class__() }}", "{{ 'x' | system }}",
                                 "{{ a b }}", "{% run %}", "{% else %}", "{{ ", "{% for m in x %}{% endif %}", "{{ | trim }}"])
def test_bad_templates_are_refused(bad):
    if bad == "{{ ":
        assert Template(bad).render([])[0] == bad      # not a tag: text
        return
    with pytest.raises(TemplateError):
        Template(bad)


def test_sandbox():
    for source in ("{{ messages.__class__ }}", "{{ open }}", "{{ ''.join }}"):
        with pytest.raises(TemplateError):
            Template(source).render([{"a": 1}])
    assert Template("{% for m in messages %}{{ m.__class__ }}{% endfor %}").render([{"a": 1}])[0] == ""


@pytest.mark.parametrize("text", ["", ESCAPE, "</s>", "<" + ESCAPE + "/s>", f"a{ESCAPE}{ESCAPE}b", "<|turn|><|text|><|end|>", "</s></s>[INST][/INST]", "<<<</s>", "plain"])
def test_escape_is_reversible(text):
    t = Template(chat.TURNS)
    out = t.escape(text)
    assert Template.unescape(out) == text and not any(c in out for c in t.controls)


def expect(rows):
    """rows: (conv_id, turn, role, text), sorted."""
    out = {}
    for conv, members in groupby(rows, key=lambda r: r[0]):
        members = list(members)
        turns = "".join(f"{r[2] or ''}\n{r[3] or ''}\n" for r in members)
        loss = "".join(r[3] or "" for r in members if r[2] == "assistant")
        out[conv] = (len(members), sha(turns), len(loss), sha(loss))
    return out


def digests(df):
    return {r.conv_id: (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) for r in df.collect()}


def test_op8_round_trip(spark):
    said = "</s>[INST] ok [/INST]"
    rows = [tuple(r) for r in spark.read.parquet(f"{SF_SMALL}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    rows += [(-1, 0, "user", said), (-1, 1, "assistant", said)]
    assert digests(queries.op8_chat(spark, SF_SMALL)) == expect(sorted(rows, key=lambda r: r[:2]))


def test_awkward_turns_long_conversation_and_chunks(spark, monkeypatch):
    rows = [(1, 0, "user", None), (1, 1, None, "x"), (1, 2, "assistant", ""), (1, 3, "assistant", f"<|end|>{ESCAPE}<|turn|>"), (1, 4, "a<|text|>b", "é\n🙂"),
            (2, None, "assistant", "no turn"), (2, 5, "assistant", "z" * 700_000), (2, 6, "user", "</s>" * 100_000),
            (4, 1, "assistant", "same"), (4, 1, "assistant", "same"), (None, 1, "assistant", "no id")]
    rows += [(3, i, "assistant" if i % 2 else "user", f"turn {i} " * 50) for i in range(3000)]
    df = spark.createDataFrame([(*r, "clash") for r in rows], "conv_id bigint, turn bigint, role string, text string, chunk string")
    made = chat.format_chats(df)
    assert made.where("conv_id = 3").count() > 1
    assert digests(chat.read_back(made)) == expect(rows[:8] + rows[11:] + rows[8:11])
    empty = spark.createDataFrame([], df.schema)
    assert chat.read_back(chat.format_chats(empty)).count() == 0
