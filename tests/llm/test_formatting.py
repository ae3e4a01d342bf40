"""Layouts by fingerprint, and exact round trips through the template."""

import hashlib
import json
import random

import pytest
from pyspark.sql import functions as F

from tidemark.llm import formatting
from tidemark.llm.formatting import Template

TABLE = "conv_id bigint, turn bigint, role string, text string, piece string, done string, layout string"


def table(spark, rows, parts=4):
    df = spark.createDataFrame([(*r, "p", "d", "l") for r in rows], TABLE)
    return df.repartition(parts) if rows else df


def turns(df):
    return formatting.canonical_turns(df.select("conv_id", "turn", F.struct("role", "text").alias("record")), "conv_id", "turn", "record")


def expected(rows, template):
    """From the definition, without the library's columns."""
    by = {}
    for conv, turn, role, text in rows:
        by.setdefault(conv, []).append((turn is None, turn or 0, role or "", text or ""))
    out = {}
    for conv, items in by.items():
        items.sort()
        all_text = "".join(f"{r}\n{t}\n" for _, _, r, t in items)
        loss = "".join(t for _, _, r, t in items if r == "assistant")
        chars = sum(len(mark(r, template)) + len(mark(t, template)) + len(template.opening + template.middle + template.closing) for _, _, r, t in items)
        out[conv] = (len(items), hashlib.sha256(all_text.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest(), chars)
    return out


def mark(text, template):
    """Escapes character by character."""
    out, at, codes = [], 0, template.escapes()
    while at < len(text):
        if text[at] == "\\":
            out.append("\\\\")
        elif any(text.startswith(c, at) for c in template.controls()):
            out.append(codes[text[at]])
        else:
            out.append(text[at])
        at += 1
    return "".join(out)


def check(spark, rows, template=None):
    got = formatting.read_back(formatting.format_turns(turns(table(spark, rows)), template), template).collect()
    assert {r["conv_id"]: tuple(r)[1:] for r in got} == expected(rows, template or Template()) and len(got) == len({r[0] for r in rows})


def test_round_trip_of_odd_rows(spark):
    rng = random.Random(4)
    bits = ["\\", "<", "[", "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<|im_start|>", "<|im_sep|>", "<|im_end|>", "<|im_", "l", "b", " ok ", "é", "\U0001f600", "\n", "\\l", "\\\\b"]
    text = lambda: "".join(rng.choices(bits, k=rng.randint(0, 12)))
    rows = [(i % 60, rng.randint(0, 9), rng.choice(["user", "assistant", "system", text()]), text()) for i in range(700)]
    rows += [(None, 0, "user", "x"), (None, None, None, None), (100, None, "assistant", None), (101, 5, None, "no role"), (102, 0, "assistant", "")]
    rows += [(103, 1, "assistant", "again")] * 5 + [(104, 0, "user", "long " * 500_000), (104, 1, "assistant", "<s>" * 400_000)]
    check(spark, rows)


def test_one_conversation_holds_a_third_of_all_rows(spark):
    rows = [(7, i, "assistant" if i % 2 else "user", f"turn {i} " + "y" * 3000) for i in range(1500)]
    rows += [(100 + i // 3, i % 3, "user", f"t{i}") for i in range(3000)]
    check(spark, rows)


def test_other_template_and_empty_table(spark):
    other = Template(opening="[BOS]", middle="]:", closing="{EOS}", others=("{PAD}",), learned=("bot",))
    rows = [(1, 0, "user", "[BOS]]:]{EOS}{PAD}\\"), (1, 1, "bot", "{E]:")]
    got = formatting.read_back(formatting.format_turns(turns(table(spark, rows)), other), other).first()
    assert got["loss_chars"] == 4 and got["loss_sha256"] == hashlib.sha256(b"{E]:").hexdigest()
    assert got["turns_sha256"] == hashlib.sha256("user\n[BOS]]:]{EOS}{PAD}\\\nbot\n{E]:\n".encode()).hexdigest()
    assert formatting.read_back(formatting.format_turns(turns(table(spark, [])))).count() == 0


def test_no_control_string_is_left_in_a_text(spark):
    template = Template()
    rows = [(i, 0, "user", a + b) for i, (a, b) in enumerate((x, y) for x in template.controls() for y in ("", "<", "\\", *template.controls()))]
    for r in formatting.format_turns(turns(table(spark, rows))).collect():
        inner = r["piece"].removeprefix(template.opening).removesuffix(template.closing).partition(template.middle)[2]
        assert not any(c in inner for c in template.controls())


RECORDS = [
    ({"messages": [{"role": "user", "content": "q"}, {"role": "assistant", "content": "a"}]}, "messages", [("user", "q"), ("assistant", "a")]),
    ({"id": 5, "messages": [{"role": "user", "content": "q", "name": "bo"}, {"role": "assistant", "content": None}]}, "messages", [("user", "q"), ("assistant", "")]),
    ({"messages": []}, "messages", []),
    ({"conversations": [{"from": "human", "value": "q"}, {"from": "gpt", "value": "a"}, {"from": "system", "value": "s"}]}, "conversations", [("user", "q"), ("assistant", "a"), ("system", "s")]),
    ({"dialog": {"turns": [{"speaker": {"role": "user"}, "utterance": "hi"}]}}, "dialog", [("user", "hi")]),
    ({"instruction": "do", "input": "this", "output": "done"}, "instruction", [("user", "do\n\nthis"), ("assistant", "done")]),
    ({"instruction": "do", "output": None}, "instruction", [("user", "do"), ("assistant", "")]),
    ({"instruction": "do", "input": None, "output": 5, "system": "be"}, "instruction", [("system", "be"), ("user", "do"), ("assistant", "5")]),
    ({"prompt": "p", "response": "r"}, "prompt", [("user", "p"), ("assistant", "r")]),
    ({"prompt": "p", "completion": "c", "id": "x"}, "completion", [("user", "p"), ("assistant", "c")]),
    ({"question": "q", "answer": "a", "context": "c"}, "question", [("user", "c\n\nq"), ("assistant", "a")]),
    ({"role": "user", "text": "t"}, "turn", [("user", "t")]),
    ({"text": None, "role": None}, "turn", [("", "")]),
    ({"prompt": "p"}, None, [(None, None)]),
    ({"messages": [{"role": "user", "content": [{"text": "q"}]}]}, None, [(None, None)]),
    ({"a b": 1, "c`d": {"e: STRING, f": [1, "x"]}}, None, [(None, None)]),
]


def test_layouts_of_json_records(spark):
    rows = [(i, 0, json.dumps(r)) for i, (r, _, _) in enumerate(RECORDS)] + [(90, 0, None), (91, 0, "not json"), (92, 0, "[1]"), (93, 0, "3")]
    got = formatting.canonical_turns(spark.createDataFrame(rows, "conv_id bigint, n bigint, body string"), "conv_id", "n", "body")
    by = {}
    for r in got.orderBy("conv_id", "item").collect():
        by.setdefault(r["conv_id"], []).append((r["layout"], r["role"], r["text"]))
    for i, (_, layout, want) in enumerate(RECORDS):
        assert by.get(i, []) == [(layout, *t) for t in want], i
    assert all(by[i] == [(None, None, None)] for i in (90, 91, 92, 93))
    with pytest.raises(Exception, match="no layout"):
        formatting.format_turns(got).collect()
    assert formatting.format_turns(got, leave_unknown=True).count() == sum(len(w) for _, x, w in RECORDS if x)


def test_struct_and_json_have_the_same_fingerprint(spark):
    body = '{"id": 1, "messages": [{"role": "user", "content": "q"}], "odd name": {"x": 1.5, "y": [[true]]}}'
    typed = spark.createDataFrame([(body,)], "s string").select(F.from_json("s", "id bigint, messages array<struct<role:string,content:string>>, `odd name` struct<x:double,y:array<array<boolean>>>").alias("r"))
    paths = ["messages[].content", "id", "messages[].role", "odd name.y[][]", "odd name.x"]
    native = spark.createDataFrame([(body,)], "s string").select(formatting.fingerprint_of_variant(F.parse_json("s"))).first()[0]
    assert native == formatting.fingerprint(paths) == formatting.fingerprint_of_schema(typed.schema["r"].dataType)


def test_layouts_of_struct_columns(spark):
    body = '{"messages": [{"role": "user", "content": "q"}, {"role": null, "content": "a"}]}'
    df = spark.createDataFrame([(1, 0, body), (2, 0, None)], "c bigint, n bigint, s string")
    df = df.select("c", "n", F.from_json("s", "messages array<struct<role:string,content:string>>").alias("r"))
    got = formatting.canonical_turns(df, "c", "n", "r").orderBy("item").collect()
    assert [(r["layout"], r["role"], r["text"]) for r in got] == [("messages", "user", "q"), ("messages", "", "a")]


def test_layouts_do_not_share_fingerprints():
    seen = {}
    for layout in formatting.LAYOUTS:
        for f in layout.fingerprints():
            assert seen.setdefault(f, layout.name) == layout.name
