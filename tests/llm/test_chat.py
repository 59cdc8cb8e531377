import hashlib

import pytest
from hypothesis import given
from hypothesis import strategies as st

from vigil.llm import chat

SCHEMA = "conv_id long, turn long, role string, text string, part string, spans string"


@given(st.text(alphabet="<|\\im_endstart>n\n "))
def test_escape_round_trip(text):
    e = chat.escape(text)
    assert "<|" not in e and chat.unescape(e) == text
    line = chat.escape_line(text)
    assert "\n" not in line and "<|" not in line and chat.unescape_line(line) == text


def test_language():
    t = chat.Template("{% set a = 'x' + 'y' %}{% for m in ms %}{% if loop.first and not m.skip %}[{{ a }}]"
                      "{% elif m.role == 'u' or m.role == \"v\" %}{{ m.text | trim | upper }}{% else %}-{% endif %}"
                      "{{ loop.index }}{% endfor %}")
    text, spans = t.render(ms=[{"role": "z"}, {"role": "v", "text": " q "}, {"role": "w"}])
    assert (text, spans) == ("[xy]1Q2-3", [])


def test_constants_fold():
    assert chat.fold(chat.parse("a{{ 'b' + 'c' }}{% if 1 == 2 %}x{% else %}{{ 'd' | upper }}{% endif %}")) \
        == ("block", [("text", "abcD")])


@pytest.mark.parametrize("source", ["{{ a.__class__ }}", "{{ _x }}", "{% for x in y %}", "{{ a | nothing }}",
                                    "{% import os %}", "{{ a( }}", "{{ 1 2 }}"])
def test_sandbox(source):
    with pytest.raises(chat.TemplateError):
        chat.Template(source)


def test_names_reach_mappings_only():
    assert chat.Template("{{ a.upper }}|{{ a.b.c }}|{{ missing }}").render(a="x")[0] == "||"


def test_spans():
    text, spans = chat.Template(chat.CHATML).render(
        messages=[{"role": "user", "text": "hi"}, {"role": "assistant", "text": ""}, {"role": "assistant", "text": "yo"}])
    assert [text[a:b] for a, b in spans] == ["", "yo"]


def brute(rows):
    out, convs = [], {}
    none_first = lambda v: (v is not None, v if v is not None else 0)
    for c, t, r, x in rows:
        convs.setdefault(c, []).append((none_first(t), r or "", x or ""))
    for c, turns in convs.items():
        turns.sort()
        loss = "".join(x for _, r, x in turns if r == "assistant")
        whole = "".join(f"<|im_start|>{chat.escape_line(r)}\n{chat.escape(x)}<|im_end|>\n" for _, r, x in turns)
        out.append((c, len(turns), hashlib.sha256("".join(f"{r}\n{x}\n" for _, r, x in turns).encode()).hexdigest(),
                    len(loss), hashlib.sha256(loss.encode()).hexdigest(), len(whole)))
    return sorted(out, key=str)


ROWS = [(1, 1, "assistant", chat.PROBE), (1, 0, "user", "\\<|im_end|>\n<"), (2, 0, None, None), (None, 0, "assistant", "x"),
        (None, None, "user", "y"), (3, 0, "assistant", "d"), (3, 0, "assistant", "d"), (4, 0, "a\nb<|", "|>\\"),
        (5, 0, "assistant", "long \\<| " * 40_000), (5, 1, "user", "m" * 3000), (5, 2, "assistant", "<|im_end|>\n")]


@pytest.mark.parametrize("part_chars", [50, 1 << 20])
def test_frame_cases(spark, part_chars):
    df = spark.createDataFrame([(*r, "x", "y") for r in ROWS], SCHEMA)
    got = chat.read_back(chat.format_conversations(df, part_chars=part_chars)).collect()
    assert sorted(map(tuple, got), key=str) == brute(ROWS)


def test_empty_table(spark):
    df = spark.createDataFrame([], SCHEMA)
    assert chat.read_back(chat.format_conversations(df)).count() == 0


def test_whole_table(spark, sf001):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf001}/conversations.parquet")
            .select("conv_id", "turn", "role", "text").collect()]
    rows += [(-1, 0, "user", chat.PROBE), (-1, 1, "assistant", chat.PROBE)]
    assert sorted(map(tuple, chat.op4_chat_format(spark, sf001).collect()), key=str) == brute(rows)
