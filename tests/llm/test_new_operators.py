"""Filter interactions, fill-in-middle and chat formatting against brute force: nulls, empty and long texts, ties, repeats, odd columns."""

import hashlib
import random
import re
from itertools import permutations

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from terncove.llm import chat_format as chat
from terncove.llm import fill_middle as fim
from terncove.llm import filter_audit as audit

rnd = random.Random(3)
WORDS = [f"w{i}" for i in range(90)]
DOCS = "doc_id long, text string, source string"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


# --- 11 ---
def text_of(kind: int) -> str | None:
    n = rnd.choice([0, 3, 49, 50, 51, 80])
    words = rnd.choices(WORDS if kind % 2 else WORDS[:20], k=n)
    return None if kind == 0 else " ".join(words) + rnd.choice(["", "\x1c# ", "ABC" * 20, "é🙂|", "\n"])


def fails(text: str) -> str:
    words = WORD.findall(text)
    return "".join([
        "A" * (len(words) < 50), "B" * (100 * len(set(words)) < 65 * len(words)), "C" * (100 * sum("A" <= c <= "Z" for c in text) > 5 * len(text)),
        "D" * any(c in "#$%&*|" for c in text),
    ])


def audited(rows, labels) -> dict:
    ids: dict = {}
    for i, t, _ in rows:
        if i is not None:
            ids[t or ""] = min(i, ids.get(t or "", i))
    good, toxic = ({d for d, *q in labels if q[k] == 1 and d is not None} for k in (0, 1))
    out = {}
    for part in {p or "" for _, _, p in rows}:
        docs = [(i, fails(t or "") + "E" * (i is not None and i > ids[t or ""])) for i, t, p in rows if (p or "") == part]
        for order in permutations("ABCDE"):
            for k, letter in enumerate(order):
                gone = lambda f, k=k, order=order: any(c in f for c in order[:k])
                took = [i for i, f in docs if letter in f and not gone(f)]
                out[part, "".join(order), k + 1] = [
                    sum(letter not in f and not gone(f) for _, f in docs), len(took), sum(letter in f and gone(f) for _, f in docs), sum(f == letter for _, f in docs),
                    sum(i in good for i in took), sum(i in toxic for i in took),
                ]
    for (part, order, step), v in list(out.items()):
        letter = order[step - 1]
        v.append(sum(w[1] for (p, o, s), w in out.items() if p == part and o[s - 1] == letter))
    return out


def test_audit_is_the_count_of_every_order(spark):
    texts = [text_of(k) for k in range(40)]
    rows = [(i, texts[i % 40] if i % 3 else texts[3], rnd.choice([None, "", "a", "b"])) for i in range(120)]
    rows += [(None, texts[3], "a"), (None, texts[3], None), (5, texts[5], "a"), (5, texts[5], "b"), (7, "x" * 20_000, "c"), (-1, texts[3], "b")]
    labels = [(i, rnd.choice([0, 1, None]), rnd.choice([0, 1, None])) for i in range(0, 150, 2)] + [(4, 1, 1), (4, 0, None), (None, 1, 1)]
    docs = spark.createDataFrame(rows, DOCS)
    for c in ("mask", "part", "good", "toxic", "n", "sha", "salt", "first", "quality"):
        docs = docs.withColumn(c, F.lit("own"))
    known = spark.createDataFrame(labels, "doc_id long, quality int, toxic int").withColumn("text", F.lit("x"))
    got = {(r.part, r.filter_order, r.step): [r.kept, r.removed, r.redundant, r.unique_fails, r.good_lost, r.toxic_lost, r.shapley] for r in audit.audit(docs, known).collect()}
    assert got == audited(rows, labels)


def test_audit_of_other_filters_and_of_nothing(spark):
    docs = spark.createDataFrame([(1, "a b", "s"), (2, "a", "s"), (3, "A", "s")], DOCS)
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    two = {"X": lambda t: t.rlike("b"), "Y": lambda t: F.length(t) < 2}
    got = {(r.filter_order, r.step): (r.kept, r.removed, r.shapley) for r in audit.audit(docs, labels, two).collect()}
    assert got == {("XY", 1): (2, 1, 2), ("XY", 2): (0, 2, 4), ("YX", 1): (1, 2, 4), ("YX", 2): (0, 1, 2)}
    assert audit.audit(docs.where("false"), labels).count() == 0
    with pytest.raises(ValueError):
        audit.mask_histograms(docs, labels, {"A": None, "B": None})


def test_outcomes_add_up():
    made = audit.outcome_matrices("ABC")
    assert made["kept"].shape == (8, 18)
    passed = np.concatenate([np.ones((8, 6, 1), int), made["kept"].reshape(8, 6, 3)[:, :, :2]], axis=2)
    assert (passed == (made["kept"] + made["removed"]).reshape(8, 6, 3)).all()


# --- 12 ---
TEXTS = [None, "", "\n", "a", "a\n", "a\nb", "\n\nx\n\n", "é🙂\n日本\nx", "has <P> in it\nx", "<M", "<P\n>S>\n<S", "x" * 30_000, *("\n".join(rnd.choices(WORDS, k=rnd.randint(1, 30))) for _ in range(60))]
LINE = re.compile(r"[^\n]*\n|[^\n]+")


def by_definition(doc_id, text, rate=100, spm=50, units=LINE.findall):
    text = text or ""
    lines = units(text)
    n, digest = len(lines), hashlib.sha256(f"7:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(digest[k : k + 8], 16) for k in range(0, 32, 8)]
    lo, hi = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    p, m, s = "".join(lines[:lo]), "".join(lines[lo:hi]), "".join(lines[hi:])
    if not text or any(x in text for x in ("<P>", "<S>", "<M>")) or h[2] % 100 >= rate:
        return n, "plain", None, None, text
    out = f"<S>{s}<P>{p}<M>{m}" if h[3] % 100 < spm else f"<P>{p}<S>{s}<M>{m}"
    return n, "spm" if h[3] % 100 < spm else "psm", len(p), len(m), out


@pytest.mark.parametrize("rate, spm", [(100, 50), (60, 0), (100, 100)])
def test_fill_middle_is_its_definition(spark, rate, spm):
    rows = [(i, t) for i, t in enumerate(TEXTS)] + [(None, "a\nb\nc"), (3, "a\nb\nc"), (3, "a\nb\nc")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    for c in ("n", "form", "Output", "restored", "own"):
        docs = docs.withColumn(c, F.lit("own"))
    made = fim.restore(fim.fill_middle(docs, rate=rate, spm_rate=spm))
    assert made.columns == ["doc_id", "text", "own", "n", "form", "prefix_chars", "middle_chars", "output", "restored"]
    got = made.collect()
    assert len(got) == len(rows) and all(r.restored == (r.text or "") and r.own == "own" for r in got)
    key = lambda x: str(x)
    assert sorted(((r.doc_id, r.n, r.form, r.prefix_chars, r.middle_chars, r.output) for r in got), key=key) == sorted(((i, *by_definition(i, t, rate, spm)) for i, t in rows), key=key)
    assert fim.fill_middle(docs.where("false")).count() == 0


@pytest.mark.parametrize("units, pattern", [(fim.WORDS, r"[ \t-\r]*[^ \t-\r]+[ \t-\r]*(?=[^ \t-\r]|$)|[ \t-\r]+$"), (fim.CHARACTERS, r"(?s).")])
def test_other_units(units, pattern):
    texts = ["", "a", "a b  c", "x\ty z", "éa🙂日", "ab cd ef gh"]
    made = fim.transform(pa.array(texts), list(range(len(texts))), units)
    split = re.compile(pattern).findall
    assert list(zip(made["n"].to_pylist(), made["form"].to_pylist(), made["prefix_chars"].to_pylist(), made["middle_chars"].to_pylist(), made["output"].to_pylist(), strict=True)) == [by_definition(i, t, units=split) for i, t in enumerate(texts)]


def test_slices_nulls_and_bad_sentinels():
    column = pa.array(["zz", None, "a\nb", "", "c"]).slice(1)
    made = fim.transform(column, [1, 2, 3, 4])
    assert fim.rebuild(made["output"], made["form"].to_pylist()).to_pylist() == ["", "a\nb", "", "c"]
    assert fim.transform(pa.array([], pa.string()), [])["n"].to_pylist() == []
    for bad in (("<P>", "<P>", "<M>"), ("aa", "b", "c"), ("", "b", "c"), ("ab", "bc", "x"), ("abc", "b", "x")):
        with pytest.raises(ValueError):
            fim._check(bad)
    with pytest.raises(ValueError):
        fim.rebuild(pa.array(["no sentinels"]), ["psm"])


# --- 13 ---
J = chat.JOINER
SAID = ["", " ", "ok", "</s>[INST] ok [/INST]", f"<{J}s>", f"{J}{J}", "<<SYS>>\n<</SYS>>\n", "a\nb\\1 $0", "[[INST]", "[/INST", "é🙂 " * 400, "[ROLE]x[/ROLE] ", "</s", None]
ROLES = ["user", "assistant", "system", "tool", "", None, "[/ROLE] x", f"{J}r"]


def formatted_by_hand(turns):
    def safe(t):
        t = t.replace(J, J * 2)
        return re.sub(r"<(?=s>|/s>|<SYS>>|</SYS>>)|\[(?=INST\]|/INST\]|ROLE\]|/ROLE\])", lambda m: m[0] + J, t)

    out, at, mask = "", 0, []
    for role, text in turns:
        a, b = {"system": ("<<SYS>>\n", "\n<</SYS>>\n"), "user": ("<s>[INST] ", " [/INST]"), "assistant": (" ", " </s>")}.get(role, (f"<s>[ROLE]{safe(role)}[/ROLE] ", " </s>"))
        piece = a + safe(text) + b
        mask.append((at, at + len(a), at + len(a) + (len(safe(text)) if role == "assistant" else 0)))
        out, at = out + piece, at + len(piece)
    return out, mask


def test_chat_is_read_back(spark):
    rows = [(c, k, rnd.choice(ROLES), rnd.choice(SAID)) for c in range(30) for k in range(rnd.randint(1, 9))]
    rows += [(None, 1, "user", "x"), (None, None, "assistant", "last"), (50, 1, "user", "b"), (50, 1, "user", "a"), (50, 1, "user", "a"), (51, 0, "assistant", None)]
    rows += [(60, k, ("user", "assistant")[k % 2], f"turn {k} [INST]") for k in range(300)]  # one long conversation
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    for c in ("piece", "start", "ps", "formatted", "mask", "p"):
        df = df.withColumn(c, F.lit("own"))
    got = {r.conv_id: r for r in chat.read_back(chat.format_turns(chat.canonical_turns(df))).collect()}
    want: dict = {}
    for c, k, role, text in sorted(rows, key=lambda r: (str(r[0]), r[1] is None, r[1] or 0, r[2] or "", r[3] or "")):
        want.setdefault(c, []).append((role or "", text or ""))
    assert got.keys() == want.keys()
    for c, turns in want.items():
        text, mask = formatted_by_hand(turns)
        assert got[c].formatted == text and [tuple(m) for m in got[c].mask] == mask and got[c].n_turns == len(turns)
        assert [tuple(t) for t in got[c].turns] == turns
        assert "".join(got[c].learned) == "".join(t for role, t in turns if role == "assistant")
    assert chat.format_turns(chat.canonical_turns(df.where("false"))).count() == 0


def test_another_template(spark):
    rows = [(1, 0, "user", "<|im_end|>\nx"), (1, 1, "assistant", "<|im_start|>"), (1, 2, "a\nb", "")]
    found = chat.read_back(chat.format_turns(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"), chat.CHATML), chat.CHATML).first()
    assert [tuple(t) for t in found.turns] == [("user", "<|im_end|>\nx"), ("assistant", "<|im_start|>"), ("a b", "")]
    assert found.learned == ["<|im_start|>"] and found.formatted.count("<|im_end|>") == 3


ASKED = [("user", "q"), ("assistant", "a")]
LAYOUTS = {
    "messages": ("conv_id long, messages array<struct<role: string, content: string>>", (1, ASKED)),
    "exchanges": ("conv_id long, conversations array<struct<value: string, `from`: string, weight: int>>", (1, [("q", "human", 1), ("a", "gpt", 0)])),
    "completion": ("completion string, conv_id long, prompt string", ("a", 1, "q")),
    "response": ("conv_id long, prompt string, response string, score double", (1, "q", "a", 0.5)),
    "bare instruction": ("conv_id long, instruction string, output string", (1, "q", "a")),
    "rows": ("conv_id long, turn int, role string, text string, prompt string", None),
}


@pytest.mark.parametrize("name", LAYOUTS)
def test_layouts_by_fingerprint(spark, name):
    schema, row = LAYOUTS[name]
    df = spark.createDataFrame([row] if row else [(1, 0, "user", "q", "x"), (1, 1, "assistant", "a", "x")], schema)
    assert chat.layout_of(T.StructType([f for f in df.schema if f.name != "conv_id"])).name == name
    assert [(r.role, r.text) for r in chat.canonical_turns(df).orderBy("turn").collect()] == ASKED


def test_longer_instructions_and_unknown_layouts(spark):
    df = spark.createDataFrame([(1, "do", "this", "a"), (2, "do", "", "a"), (3, None, None, None)], "conv_id long, instruction string, input string, output string")
    got = [(r.conv_id, r.role, r.text) for r in chat.canonical_turns(df).orderBy("conv_id", "turn").collect()]
    assert got == [(1, "user", "do\n\nthis"), (1, "assistant", "a"), (2, "user", "do"), (2, "assistant", "a"), (3, "user", ""), (3, "assistant", "")]
    with pytest.raises(ValueError):
        chat.canonical_turns(spark.createDataFrame([(1, "x")], "conv_id long, unknown string"))
    with pytest.raises(ValueError):  # two layouts explain two paths each
        chat.canonical_turns(spark.createDataFrame([(1, "x", "y", "z")], "conv_id long, prompt string, completion string, response string"))


def test_json_of_mixed_layouts(spark):
    rows = [
        (1, '{"messages": [{"role": "user", "content": "q"}, {"role": "assistant", "content": "a", "name": "n"}], "id": 7}'),
        (2, '{"conversations": [{"from": "human", "value": "q"}, {"from": "gpt", "value": "a"}]}'),
        (3, '{"prompt": "q", "completion": "a", "meta": {"role": "x"}}'),
        (4, '{"instruction": "q", "input": "", "output": "a"}'), (5, '{"instruction": "q", "output": "a"}'),
        (6, '{"other": 1}'), (7, "no json"), (8, None), (9, '{"system_prompt": "", "question": "q", "response": "a"}'), (10, '{"messages": "x"}'),
    ]
    df = spark.createDataFrame(rows, "conv_id long, json string")
    got: dict = {}
    for r in chat.json_turns(df).orderBy("conv_id", "turn").collect():
        got.setdefault(r.conv_id, []).append((r.role, r.text))
    assert got == {k: ASKED for k in (1, 2, 3, 4, 5, 9)}
    counted = {r.layout: r.n for r in chat.layouts(df).groupBy("layout").agg(F.sum("n").alias("n")).collect()}
    assert counted == {"messages": 1, "exchanges": 1, "completion": 1, "instruction": 1, "bare instruction": 1, "question": 1, None: 4}


def test_fingerprint_is_of_paths_not_of_order():
    assert chat.fingerprint({"a", "b"}) == chat.fingerprint({"b", "a"}) != chat.fingerprint({"a", "b.c"})
    assert len({x.fingerprint for x in chat.LAYOUTS}) == len(chat.LAYOUTS)
